"""Evaluation of predictions: accuracy, F1, abstention, calibration, grounding, quantiles."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators import quantiles as selection

BINS = 10


def label_counts(df: DataFrame, truth: str, predicted: str, *by: str, weight: str | None = None) -> DataFrame:
    """by..., label, tp, fp, fn over the union of true and predicted labels (null is a label). weight: a column of counts, where a row stands for several equal ones."""
    t, p = (F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in (truth, predicted))
    rows = df.select(*by, t.alias("_t"), p.alias("_p"), (F.lit(1) if weight is None else F.col(weight)).cast("long").alias("_w"))
    one, no = F.col("_w"), F.lit(0).cast("long")
    same = F.col("_t") == F.col("_p")
    parts = F.when(same, F.array(F.struct(F.col("_t").alias("label"), one.alias("tp"), no.alias("fp"), no.alias("fn")))).otherwise(F.array(F.struct(F.col("_t").alias("label"), no.alias("tp"), no.alias("fp"), one.alias("fn")), F.struct(F.col("_p").alias("label"), no.alias("tp"), one.alias("fp"), no.alias("fn"))))
    return rows.select(*by, F.inline(parts)).groupBy(*by, "label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    d = 2 * tp + fp + fn
    return F.when(d > 0, 2 * tp / d).otherwise(0.0)


def macro_f1(df: DataFrame, truth: str, predicted: str, *by: str) -> DataFrame:
    return label_counts(df, truth, predicted, *by).groupBy(*by).agg(F.round(F.avg(f1(F.col("tp"), F.col("fp"), F.col("fn"))), 6).alias("macro_f1"), F.count(F.lit(1)).alias("n_labels"))


def micro_f1(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return label_counts(df, truth, predicted).agg(F.round(f1(F.sum("tp"), F.sum("fp"), F.sum("fn")), 6).alias("micro_f1"))


def binary_scores(truth: Column, predicted: Column) -> list[Column]:
    """positives, precision, recall, f1 as aggregates; the scores are null without true positives to find."""
    tp, fp, fn = F.count_if(truth & predicted), F.count_if(~truth & predicted), F.count_if(truth & ~predicted)
    some = F.count_if(truth) > 0
    return [
        F.count_if(truth).alias("positives"),
        F.when(some, F.round(F.coalesce(tp / F.nullif(tp + fp, F.lit(0)), F.lit(0.0)), 6)).alias("precision"),
        F.when(some, F.round(tp / F.nullif(tp + fn, F.lit(0)), 6)).alias("recall"),
        F.when(some, F.round(f1(tp, fp, fn), 6)).alias("f1"),
    ]


def accuracy_report(df: DataFrame, key: str, same: str) -> DataFrame:
    """exact_field and exact_record accuracy of long predictions (key, field, same)."""
    per = df.groupBy(key).agg(F.count_if(F.col(same)).alias("_k"), F.count(F.lit(1)).alias("_n"))
    return per.agg(F.round(F.sum("_k") / F.sum("_n"), 6).alias("exact_field"), F.round(F.avg((F.col("_k") == F.col("_n")).cast("double")), 6).alias("exact_record"))


def bin_edges() -> list[tuple[float, float]]:
    """Lower edges in ten equal steps and each plus a tenth, with the rounding of double arithmetic: the bins shift and leave gaps, and a confidence of 0.6 is in none."""
    return [(i * (1.0 / BINS), i * (1.0 / BINS) + 1.0 / BINS) for i in range(BINS)]


def calibration(df: DataFrame, confidence: str, correct: str) -> DataFrame:
    """One row: n, brier, ece (10 half-open bins, the last closed; confidences in a gap count in n only)."""
    c, o = F.col(confidence).cast("double"), F.col(correct).cast("double")
    at = F.lit(None).cast("int")
    for i, (lo, hi) in reversed(list(enumerate(bin_edges()))):
        last = i == BINS - 1
        at = F.when((c >= lo) & ((c <= hi) if last else (c < hi)), i).otherwise(at)
    per = df.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("k"), F.avg(c).alias("c"), F.avg(o).alias("o"), F.sum((c - o) ** 2).alias("sq"))
    gap = F.when(F.col("bin").isNotNull(), F.col("k") * F.abs(F.col("c") - F.col("o"))).otherwise(0.0)
    return per.agg(F.sum("k").alias("n"), F.round(F.sum("sq") / F.sum("k"), 6).alias("brier"), F.round(F.sum(gap) / F.sum("k"), 6).alias("ece"))


def grounding(df: DataFrame, evidence: str, text: str) -> DataFrame:
    """One row: n_evidence and grounding_rate, the share of snippets that are exact substrings (1 without any)."""
    e = df.select(F.explode(evidence).alias("snippet"), F.col(text).alias("_text"))
    return e.agg(F.count(F.lit(1)).alias("n_evidence"), F.coalesce(F.round(F.avg(F.col("_text").contains(F.col("snippet")).cast("double")), 6), F.lit(1.0)).alias("grounding_rate"))


def latency_summary(df: DataFrame, column: str, *by: str) -> DataFrame:
    """Exact mean, median, p95 (linear interpolation) and sum of each group, of any size; nulls (and, for the quantiles, NaN) are left out."""
    keys = [f"k{i}" for i in range(len(by))]
    rows = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], F.col(column).alias("x"))
    sums = rows.groupBy(*keys).agg(F.round(F.avg("x"), 6).alias("mean_value"), F.round(F.sum("x"), 6).alias("total_value"))
    told = selection.quantiles(rows, "x", [0.5, 0.95], *keys)
    at = {name: F.round(F.max(F.when(F.col("share") == q, F.col("value"))), 6).alias(name) for name, q in (("median_value", 0.5), ("p95_value", 0.95))}
    told = told.groupBy(*keys).agg(*at.values()).withColumnsRenamed({k: f"{k}_" for k in keys})
    both = sums.join(told, reduce(and_, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys], F.lit(True)), "left")
    return both.select(*[F.col(k).alias(b) for b, k in zip(by, keys)], "mean_value", "median_value", "p95_value", "total_value")


def quantiles(df: DataFrame, column: str, shares: list[float], *by: str) -> DataFrame:
    """by..., share, value: exact quantiles by linear interpolation."""
    return selection.quantiles(df, column, shares, *by).select(*by, "share", F.round("value", 6).alias("value"))


def majority(df: DataFrame, label: str, *by: str) -> DataFrame:
    """by..., label, n, confidence: the most frequent label (the smallest of equals) and its share."""
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    out = counts.groupBy(*by).agg(F.min_by(F.struct(F.col(label).alias("label"), "n"), F.struct(-F.col("n"), F.col(label))).alias("best"), F.sum("n").alias("total"))
    return out.select(*by, "best.label", "best.n", F.round(F.col("best.n") / F.col("total"), 6).alias("confidence"))

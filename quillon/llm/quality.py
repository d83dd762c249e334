"""Quality classifier: importance resampling with hashed n-gram models and Gumbel top-k.

Two bag-of-n-grams models over the same hash buckets: the target (documents
labelled good) and the raw text (all documents).  A document's log weight is the
mean log ratio of its n-grams, tempered to the weight of EFFECTIVE of them, so
that short and long texts compare.  A document's key is its log weight plus
Gumbel noise from a hash of its row; the k largest keys are kept, which draws k
documents without replacement by weight.  k is the number of documents whose log
weight is above the cut that parts the labelled good from the labelled bad.

n-grams: single words (lower-cased, with their case shape), and pairs and
triples of shapes, where a mark stands for itself, a word for its case and
length, and a word equal to the one before for "again".
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.textops import U64, Chunk, by_chunk, grams, mix
from quillon.llm.workdir import mapped, unused, written

BUCKETS = 1 << 14
EFFECTIVE = 32.0
#: At most this many labelled documents of each class fit the target model and the cut.
LABELLED = 10_000

_CLASS = np.zeros(256, np.uint8)  # 0 white space and control, 1 word, 2 mark
_CLASS[0x21:0x7F] = 2
for _a, _b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _CLASS[_a : _b + 1] = 1
_UPPER = np.zeros(256, np.int32)
_UPPER[0x41:0x5B] = 1
_LOWER = np.zeros(256, np.int32)
_LOWER[0x61:0x7B] = 1
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, and the index of the text of each."""
    chunk = Chunk(texts)
    cls = _CLASS[chunk.buf]
    if not len(cls):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero((cls != 0) & (cls != np.concatenate(([0], cls[:-1]))))
    ends = np.flatnonzero((cls != 0) & (cls != np.concatenate((cls[1:], [0])))) + 1
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    up = np.concatenate(([0], np.cumsum(_UPPER[chunk.buf])))
    low = np.concatenate(([0], np.cumsum(_LOWER[chunk.buf])))
    n_up, n_low = up[ends] - up[starts], low[ends] - low[starts]
    word = cls[starts] == 1
    case = (n_up > 0).astype(np.int64) * 2 + (n_low > 0)
    size = ends - starts
    shape = 16 + case * 3 + (size > 3) + (size > 8)
    chunk.buf = _FOLD[chunk.buf]
    h = chunk.hash(starts, ends)
    doc = chunk.doc_of(starts)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]) & word[1:]
    coarse = np.where(again, U64(7), np.where(word, shape.astype(U64), h))
    out, docs = [mix(h + case.astype(U64))], [doc]
    for k in (2, 3):
        if len(h) >= k:
            whole = doc[: len(h) - k + 1] == doc[k - 1 :]
            out.append(grams(coarse, k)[whole] + U64(k))
            docs.append(doc[: len(h) - k + 1][whole])
    return (np.concatenate(out) % U64(BUCKETS)).astype(np.int64), np.concatenate(docs)


@dataclass(frozen=True)
class Model:
    ratio: bytes  # float64 log ratio of each bucket
    key_cut: float = float("-inf")


def _flagged(docs: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """docs with _good: 1, 0 or null (not in the bounded labelled sample). The sample has 2 * LABELLED rows at most and is broadcast."""
    own = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("_good"))
    order = F.xxhash64("doc_id")
    sample = own.where("_good = 1").orderBy(order).limit(LABELLED).unionByName(own.where("_good = 0").orderBy(order).limit(LABELLED))
    return docs.join(F.broadcast(sample.withColumnRenamed("doc_id", "_id")), docs[id_col] == F.col("_id"), "left").drop("_id")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Log ratios of the buckets: n-grams of the labelled good over those of all documents, both with one added."""
    rows = _flagged(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels, "doc_id").select("text", "_good")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)

        def one(b: pa.RecordBatch) -> None:
            at, doc = features(b.column(0))
            total[0] += np.bincount(at, minlength=BUCKETS)
            good = np.asarray(b.column(1).fill_null(0).to_numpy(zero_copy_only=False)) == 1
            total[1] += np.bincount(at[good[doc]], minlength=BUCKETS)

        for _ in by_chunk(one)(batches):
            pass
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[0, at]), pa.array(total[1, at])], ["bucket", "n_raw", "n_target"])

    sums = mapped(rows, run, "bucket int, n_raw long, n_target long").groupBy("bucket").agg(F.sum("n_raw"), F.sum("n_target")).toArrow()
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    at = sums.column(0).to_numpy()
    raw[at] += sums.column(1).to_numpy()
    target[at] += sums.column(2).to_numpy()
    if target.sum() == BUCKETS:  # nothing is labelled good: every document weighs the same
        return Model(np.zeros(BUCKETS).tobytes())
    return Model((np.log(target / target.sum()) - np.log(raw / raw.sum())).tobytes())


def weighed(docs: DataFrame, model: Model, text_col: str = "text", name: str = "log_weight") -> DataFrame:
    """docs with the log weight as a last column; a text without n-grams (null, empty) has 0."""
    told = model.ratio
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = np.frombuffer(told)

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            at, doc = features(b.column(b.schema.get_field_index(text_col)))
            n = np.bincount(doc, minlength=b.num_rows)
            w = EFFECTIVE * np.bincount(doc, ratio[at], minlength=b.num_rows) / np.maximum(n, 1)
            return pa.RecordBatch.from_arrays([*b.columns, pa.array(w)], schema.names)

        return by_chunk(one, text_col)(batches)

    return mapped(docs, run, schema)


def gumbel(*cols: Column) -> Column:
    """Standard Gumbel noise from a hash of the row, the same in every run."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(271828), *cols), 11) + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def parting(good: np.ndarray, bad: np.ndarray, lost_share: float = 2.0) -> float:
    """The cut of least cost between two samples, the share of good ones lost counting lost_share times that of bad ones kept; the middle of the widest best gap."""
    if not len(good) or not len(bad):
        return float("-inf")
    x = np.concatenate((good, bad))
    cost = np.concatenate((np.full(len(good), lost_share / len(good)), np.full(len(bad), -1.0 / len(bad))))
    order = np.argsort(x, kind="stable")
    x, lost = x[order], np.cumsum(cost[order])
    gaps = np.diff(x)
    free = gaps > 0
    if not free.any() or lost[:-1][free].min() >= 0:
        return float("-inf")
    best = np.flatnonzero(free & (lost[:-1] <= lost[:-1][free].min() + 1e-12))
    i = best[np.argmax(gaps[best])]
    return float(x[i] + x[i + 1]) / 2


def kth_largest(rows: DataFrame, col: str, k: int, lo: float = -4096.0, hi: float = 4096.0) -> float:
    """A cut with exactly the rows of the k largest values at or above it (and all ties with the k-th): histograms of 4096 bins, the bin that holds the k-th refined until it is a point."""
    for _ in range(5):
        width = (hi - lo) / 4096
        at = F.floor((F.greatest(F.lit(lo), F.least(F.col(col), F.lit(hi))) - lo) / width)
        bins = sorted(rows.where(F.col(col).between(lo, hi)).groupBy(at.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(col).alias("x"), F.max(col).alias("y")).collect(), reverse=True)
        for b in bins:
            if k <= b.n:
                lo, hi = b.x, b.y
                break
            k -= b.n
        else:
            return bins[-1].x if bins else float("-inf")
        if lo == hi or k == b.n:
            return lo
    return lo


def classified(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Model]:
    """(doc_id, log_weight, key, kept) per row of docs, and the model with its key cut.

    Equal rows have equal keys and are kept or rejected together.  Without
    labels of both classes everything is kept; no rows give no rows.
    """
    model = fit(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scored = weighed(rows, model).select("doc_id", "log_weight", (F.col("log_weight") + gumbel(F.col("doc_id"), F.col("text"))).alias("key"))
    scored = written(scored, "quality-keys")
    judged = _flagged(scored, labels, "doc_id").where("_good is not null").groupBy("doc_id", "_good").agg(F.min("log_weight").alias("log_weight")).select("_good", "log_weight").toArrow()
    good = judged.column(0).to_numpy() == 1
    w = judged.column(1).to_numpy()
    cut = parting(w[good], w[~good])
    k = scored.where(F.col("log_weight") >= cut).count()
    key_cut = kth_largest(scored, "key", k) if k and np.isfinite(cut) else float("-inf")
    return scored.withColumn("kept", F.col("key") >= key_cut), Model(model.ratio, key_cut)


def kept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the classifier keeps, with their own columns."""
    _, model = classified(docs, labels, id_col, text_col)
    (name,) = unused(docs, "log_weight")
    key = F.col(name) + gumbel(F.col(id_col), F.col(text_col))
    return weighed(docs, model, text_col, name).where(key >= model.key_cut).drop(name)

"""Agreement between raters: percentages, Cohen's and quadratic kappa, set overlap, diagnostics, gates.

Ratings are in long form: key, field, status, value (text).  All counts are
grouped aggregates; the tables of label pairs are small by nature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TINY = 1e-12


def aligned(left: DataFrame, right: DataFrame, key: str | list[str]) -> DataFrame:
    """One row per key with structs l and r. Keys must be unique and the same on both sides; otherwise it raises."""
    keys = [key] if isinstance(key, str) else key
    l = left.select(*keys, F.struct(*[c for c in left.columns if c not in keys]).alias("l"))
    r = right.select(*keys, F.struct(*[c for c in right.columns if c not in keys]).alias("r"))
    both = l.join(r, keys, "full_outer")
    bad = both.agg(F.count_if(F.col("l").isNull() | F.col("r").isNull()).alias("missing"), (F.count(F.lit(1)) - F.count_distinct(F.struct(*keys))).alias("repeated")).first()
    if bad.missing or bad.repeated:
        raise ValueError(f"{bad.missing} keys on one side only, {bad.repeated} repeated")
    return both


def aligned_all(raters: dict[str, DataFrame], key: str | list[str]) -> DataFrame:
    """key..., ratings (a struct with one slot a rater, null where the rater has no row or several) and issues (array of rater, rule, n).

    Any number of raters meet in one shuffle: rows are tagged with their rater
    and grouped by key. rule is missing or repeated; a key without issues is
    rated once by every rater. Raters have the same columns.
    """
    keys = [key] if isinstance(key, str) else key
    names = list(raters)
    if len(names) < 2:
        raise ValueError("two raters at least are compared")
    own = [c for c in raters[names[0]].columns if c not in keys]
    for name, df in raters.items():
        if sorted(df.columns) != sorted([*keys, *own]):
            raise ValueError(f"the columns of {name} differ: {df.columns}")
    tagged = [df.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], F.lit(r).alias("rater"), F.struct(*[F.col(f"`{c}`") for c in own]).alias("row")) for r, df in enumerate(raters.values())]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t)
    of = lambda r: F.when(F.col("rater") == r, F.col("row"))
    per = every.groupBy(*[f"k{i}" for i in range(len(keys))]).agg(*[F.count_if(F.col("rater") == r).alias(f"n{r}") for r in range(len(names))], *[F.first(of(r), ignorenulls=True).alias(f"row{r}") for r in range(len(names))])
    slots = F.struct(*[F.when(F.col(f"n{r}") == 1, F.col(f"row{r}")).alias(name) for r, name in enumerate(names)])
    wrong = [F.when(F.col(f"n{r}") != 1, F.struct(F.lit(name).alias("rater"), F.when(F.col(f"n{r}") == 0, "missing").otherwise("repeated").alias("rule"), F.col(f"n{r}").alias("n"))) for r, name in enumerate(names)]
    return per.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], slots.alias("ratings"), F.array_compact(F.array(*wrong)).alias("issues"))


def alignment_issues(told: DataFrame, key: str | list[str]) -> DataFrame:
    """key..., rater, rule, n of the keys that not every rater has rated once. told: of `aligned_all`."""
    keys = [key] if isinstance(key, str) else key
    return told.select(*keys, F.inline("issues"))


def fully_aligned(told: DataFrame, strict: bool = True) -> DataFrame:
    """Keys that every rater has rated once, a column a rater. strict: raise if there are others, or none at all."""
    if strict:
        n = told.agg(F.count_if(F.size("issues") > 0).alias("bad"), F.count(F.lit(1)).alias("n")).first()
        if n.bad or not n.n:
            raise ValueError(f"{n.bad} of {n.n} keys aren't rated once by everyone")
    keys = [c for c in told.columns if c not in ("ratings", "issues")]
    return told.where(F.size("issues") == 0).select(*keys, "ratings.*")


def diagnose_third(left: DataFrame, right: DataFrame, third: DataFrame, key: str, value: str, *by: str, strict: bool = True) -> DataFrame:
    """`third_rater` over three submissions (key, value and the columns of by, which are the first rater's), aligned at once."""
    rows = fully_aligned(aligned_all({"l": left, "r": right, "c": third}, key), strict)
    flat = rows.select(*[F.col("l")[b].alias(b) for b in by], *[F.col(x)[value].alias(f"{x}_value") for x in "lrc"])
    return third_rater(flat, "l_value", "r_value", "c_value", *by)


def _labels(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


def percent_agreement(df: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """by..., n, agreement (6 decimals; null for no rows). Nulls agree with nulls."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col(a).eqNullSafe(F.col(b)).cast("double")), 6).alias("agreement"))


def _weight(weight: str | None) -> Column:
    return (F.lit(1) if weight is None else F.col(weight)).cast("long")


def _mean(c: Column) -> Column:
    return F.sum(F.col("_w") * c.cast("double")) / F.sum("_w")


def cohen_kappa(df: DataFrame, a: str, b: str, *by: str, weight: str | None = None) -> DataFrame:
    """by..., n, observed (rounded to 6 decimals first), kappa (6 decimals; null where chance agreement is total).

    Three grouped counts: of pairs that agree and of each rater's labels. weight:
    a column of counts, where a row stands for several equal pairs.
    """
    rows = df.select(*by, _labels(F.col(a)).alias("_a"), _labels(F.col(b)).alias("_b"), _weight(weight).alias("_w"))
    totals = rows.groupBy(*by).agg(F.sum("_w").alias("n"), F.round(_mean(F.col("_a") == F.col("_b")), 6).alias("observed"))
    none = F.lit(0).cast("long")
    ends = rows.select(*by, F.explode(F.array(F.struct(F.col("_a").alias("label"), F.col("_w").alias("x"), none.alias("y")), F.struct(F.col("_b").alias("label"), none.alias("x"), F.col("_w").alias("y")))).alias("e"))
    margins = ends.groupBy(*by, "e.label").agg(F.sum("e.x").alias("x"), F.sum("e.y").alias("y"))
    chance = margins.groupBy(*by).agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("xy"))
    out = totals.join(chance, list(by)) if by else totals.crossJoin(chance)  # one row each
    e = F.col("xy") / (F.col("n").cast("double") * F.col("n"))
    return out.select(*by, "n", "observed", F.when(F.abs(1 - e) >= TINY, F.round((F.col("observed") - e) / (1 - e), 6)).alias("kappa"))


def quadratic_kappa(df: DataFrame, a: str, b: str, levels: list[str], *by: str, weight: str | None = None) -> DataFrame:
    """by..., n, qwk: agreement on ordered levels, quadratic weights; null where the expected disagreement is zero. A label outside the levels raises when the result is computed. weight: as for `cohen_kappa`.

    Needs no table of pairs: the mean squared difference and the first two moments of each rater.
    """
    index = F.create_map(*[x for i, v in enumerate(levels) for x in (F.lit(v), F.lit(float(i)))])

    def level(c: str) -> Column:
        return F.coalesce(index[F.col(c)], F.raise_error(F.concat(F.lit("outside the ordinal scale: "), F.coalesce(F.col(c).cast("string"), F.lit("null")))).cast("double"))

    if len(set(levels)) != len(levels) or len(levels) < 2:
        raise ValueError("an ordinal scale has two different levels at least")
    rows = df.select(*by, level(a).alias("x"), level(b).alias("y"), _weight(weight).alias("_w"))
    x, y = F.col("x"), F.col("y")
    m = rows.groupBy(*by).agg(F.sum("_w").alias("n"), _mean((x - y) ** 2).alias("d"), _mean(x).alias("mx"), _mean(y).alias("my"), _mean(x**2).alias("xx"), _mean(y**2).alias("yy"))
    scale = float((len(levels) - 1) ** 2)
    expected = F.col("xx") + F.col("yy") - 2 * F.col("mx") * F.col("my")
    return m.select(*by, "n", F.when(expected / scale >= TINY, F.round(1 - F.col("d") / expected, 6)).alias("qwk"))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets as arrays; two empty sets overlap fully."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def exact_agreement(df: DataFrame, key: str) -> DataFrame:
    """One row: exact_field and exact_record over aligned ratings (key, field, same)."""
    per = df.groupBy(key).agg(F.avg(F.col("same").cast("double")).alias("_f"), F.count(F.lit(1)).alias("_n"), F.bool_and("same").alias("_r"))
    return per.agg(F.round(F.sum(F.col("_f") * F.col("_n")) / F.sum("_n"), 6).alias("exact_field"), F.round(F.avg(F.col("_r").cast("double")), 6).alias("exact_record"))


def third_rater(df: DataFrame, l: str, r: str, third: str, *by: str) -> DataFrame:
    """Counts by group: how often two raters agree, and whom a third one joins when they do and don't."""
    a, b, c = (F.col(x) for x in (l, r, third))
    same, left, right = a.eqNullSafe(b), c.eqNullSafe(a), c.eqNullSafe(b)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(same).alias("n_agree"),
        F.count_if(~same).alias("n_disagree"),
        F.count_if(same & left).alias("third_with_both"),
        F.count_if(same & ~left).alias("third_against_both"),
        F.count_if(~same & left).alias("third_with_left"),
        F.count_if(~same & right).alias("third_with_right"),
        F.count_if(~same & ~left & ~right).alias("third_with_neither"),
    )


def disagreements(df: DataFrame, keys: list[str], l: str, r: str) -> DataFrame:
    return df.where(~F.col(l).eqNullSafe(F.col(r))).select(*keys, F.struct(F.col(l).alias("left"), F.col(r).alias("right")).alias("ratings"))


def quality_gate(metrics: DataFrame, kappa: float = 0.70, exact: float = 0.80, least_n: int = 5) -> DataFrame:
    """metrics: name, kind (kappa/exact), value, n. Adds status: passed, failed (null kappas fail) or insufficient; all but passed block."""
    limit = F.when(F.col("kind") == "exact", exact).otherwise(kappa)
    status = F.when(F.col("n") < least_n, "insufficient").when(F.coalesce(F.col("value") >= limit, F.lit(False)), "passed").otherwise("failed")
    return metrics.withColumn("status", status).withColumn("blocks", F.col("status") != "passed")

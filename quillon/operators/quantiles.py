"""Exact quantiles of any number of groups of any size, by selection through refined histograms.

A quantile needs the values at one or two ranks of its group.  Each wanted rank
starts with the whole range of its group; a round counts the rows of that range
in BINS bins and keeps the bin that holds the rank, from its smallest to its
largest value.  Ranges of a group that coincide are counted once.  As soon as a
range has few rows (or one value) its values are counted one by one and the rank
is read off.  So rows are only ever counted where they are, and what meets in
one place is the bins of a range or the FEW rows that are left of it, however
large or lopsided a group is.

Ranges are tables in the shared folder, as many rows as groups times ranks.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.sources.shared import written

#: Rows of a range that are sorted in one place; bins of a range in a round.
FEW, BINS = 100_000, 1024


def _meet(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(and_, [left[k].eqNullSafe(right[k]) for k in keys], F.lit(True))


def _within(values: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, x, lo, hi of the rows of values that lie in a range of their group. A range table of a few groups is broadcast by its size, a large one joins by group."""
    r = ranges.select(*keys, "lo", "hi").distinct()
    inside = _meet(values, r, keys) & values["x"].between(r["lo"], r["hi"])
    return values.join(r, inside).select(*[values[k] for k in keys], "x", "lo", "hi")


def _picked(ranges: DataFrame, counts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each rank with the row of counts (keys, lo, order, n, ...) that holds it; below: the rows before that row in the group."""
    # ranges that begin with one value may differ in their end, so both bounds tell them apart
    run = Window.partitionBy(*keys, "lo", "hi").orderBy(order)
    c = counts.withColumn("before", F.sum("n").over(run) - F.col("n")).withColumnsRenamed({"n": "n_in", "lo": "lo_", "hi": "hi_"})
    hit = _meet(ranges, c, keys) & (ranges["lo"] == c["lo_"]) & (ranges["hi"] == c["hi_"])
    hit = hit & (ranges["rank"] >= ranges["below"] + c["before"]) & (ranges["rank"] < ranges["below"] + c["before"] + c["n_in"])
    return ranges.join(c, hit).select(*[ranges[k] for k in keys], "rank", (F.col("below") + F.col("before")).alias("below"), *[c[x] for x in c.columns if x not in (*keys, "before", "lo_", "hi_")])


def _bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """The bin of x among bins of [lo, hi]; it never falls as x rises, and lo and hi are in different ones.

    A range of values of like size has bins of equal width (halves are taken
    first, so that no width overflows).  One that spans sizes or signs has bins
    that widen with the distance from zero, so lopsided groups take few rounds.
    """
    top = F.greatest(F.abs(lo), F.abs(hi))
    spread = (lo <= 0) & (hi >= 0) | (F.least(F.abs(lo), F.abs(hi)) < top / 16)
    scaled = lambda v: F.signum(v) * F.log1p(F.abs(v) / F.greatest(top / 2.0**50, F.lit(5e-324)))
    wide = (scaled(x) - scaled(lo)) / (scaled(hi) - scaled(lo))
    even = (x / 2 - lo / 2) / (hi / 2 - lo / 2)
    return F.least(F.floor(F.when(spread, wide).otherwise(even) * bins), F.lit(bins - 1))


def at_ranks(values: DataFrame, wanted: DataFrame, keys: list[str], few: int = FEW, bins: int = BINS) -> DataFrame:
    """keys, rank, x: the value of each wanted rank (from 0) in its group.

    values: keys, x (double); wanted: keys, rank, lo, hi (smallest and largest
    value of the group), n (its rows), below (0).
    """
    ranges = written(wanted.select(*keys, "rank", "lo", "hi", "n", "below"), "quantile-ranges")
    while True:
        large = (F.col("n") > few) & (F.col("lo") < F.col("hi"))
        coarse, fine = ranges.where(large), ranges.where(~large)
        if not coarse.limit(1).count():
            break
        rows = _within(values, coarse, keys)
        counts_at = _bin(F.col("x"), F.col("lo"), F.col("hi"), bins)
        counts = rows.groupBy(*keys, "lo", "hi", counts_at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("first"), F.max("x").alias("last"))
        finer = _picked(coarse, counts, keys, "bin").select(*keys, "rank", F.col("first").alias("lo"), F.col("last").alias("hi"), F.col("n_in").alias("n"), "below")
        ranges = written(finer.unionByName(fine), "quantile-ranges")
    flat = ranges.where("lo = hi").select(*keys, "rank", F.col("lo").alias("x"))
    rest = ranges.where("lo < hi")
    counts = _within(values, rest, keys).groupBy(*keys, "lo", "hi", "x").agg(F.count(F.lit(1)).alias("n"))
    return flat.unionByName(_picked(rest, counts, keys, "x").select(*keys, "rank", "x"))


def quantiles(df: DataFrame, column: str, shares: list[float], *by: str, few: int = FEW, bins: int = BINS) -> DataFrame:
    """by..., share, value, n: exact quantiles by linear interpolation between ranks. Nulls and NaN are left out; a group without values has no rows."""
    keys = [f"k{i}" for i in range(len(by))]
    x = F.col(column).cast("double")
    values = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    groups = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).where("n > 0")
    place = F.col("share") * (F.col("n") - 1)
    wanted = groups.select(*keys, "n", "lo", "hi", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"))
    wanted = written(wanted.select("*", F.floor(place).alias("rank"), (place - F.floor(place)).alias("part")), "quantiles")
    both = wanted.withColumn("rank", F.explode(F.array(F.col("rank"), F.least(F.col("rank") + 1, F.col("n") - 1))))
    found = at_ranks(values, both.select(*keys, "rank", "lo", "hi", "n", F.lit(0).cast("long").alias("below")).distinct(), keys, few, bins)
    found = written(found, "quantile-values")
    low, high = (found.withColumnsRenamed({"rank": f"{a}_rank", "x": f"{a}_x", **{k: f"{a}_{k}" for k in keys}}) for a in ("low", "high"))
    for side, name, rank in ((low, "low", F.col("rank")), (high, "high", F.least(F.col("rank") + 1, F.col("n") - 1))):
        wanted = wanted.join(side, reduce(and_, [wanted[k].eqNullSafe(side[f"{name}_{k}"]) for k in keys], rank == F.col(f"{name}_rank")))
    value = F.col("low_x") + (F.col("high_x") - F.col("low_x")) * F.col("part")
    return wanted.select(*[F.col(k).alias(b) for b, k in zip(by, keys)], "share", F.when(F.col("part") == 0, F.col("low_x")).otherwise(value).alias("value"), "n")

"""Mixing sources to target weights: hash-threshold histograms, DataFrame functions only.

Each row has a place in [0, 2**36) from a hash of its id.  A source that shall
give `target` words takes every row floor(target / size) times, and once more
the rows below a threshold.  The threshold is found without sorting: words are
summed by source and the first 12 bits of the place, the bucket in which the
running sum crosses the rest is refined by the next 12 bits, and again by the
last 12.  Only sums of at most 4096 buckets a source meet in one place, so a
source with a third of all rows costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.workdir import written

WORD = r"[^\x20\x09-\x0D]+"
BITS = 12
#: Sources whose thresholds are broadcast; beyond it the join is shuffled and left to adaptive skew handling.
BROADCAST_SOURCES = 50_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(doc_id: Column) -> Column:
    """36 bits of a hash of the id, the same in every run."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 9), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per source: source_size and target. sizes: source, size.

    Sources in code-point order (null last) weigh `weights`, repeating; together
    they are to give `share` times all words, none more than `most` times its
    own.  The excess of those that reach their bound goes to the others by
    weight: in the order of bound/weight, each source is held against what would
    be left for it.  One row a source goes through the unpartitioned windows.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")))
    per = per.withColumn("_bound", most * F.col("source_size"))
    order = Window.orderBy(F.col("_bound") / F.col("_w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (share * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("_bound").over(before), F.lit(0.0))) / F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("_full", F.col("_bound") <= level * F.col("_w"))
    # the level of the first source below its bound holds for all that follow
    per = per.withColumn("_level", level)
    free = F.min(F.when(~F.col("_full"), F.struct((F.col("_bound") / F.col("_w")).alias("o"), F.col("_level").alias("l")))).over(Window.partitionBy())["l"]
    return per.select("source", "source_size", F.when(F.col("_full"), F.col("_bound")).otherwise(free * F.col("_w")).alias("target"))


def _matched(rows: DataFrame, small: DataFrame, extra: Column | None = None, source: str = "source") -> DataFrame:
    """rows with the columns of their source in small (one row a source)."""
    few = small.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    s = small.withColumnRenamed("source", "_key")
    on = rows[source].eqNullSafe(s["_key"])
    return rows.join(F.broadcast(s) if few else s, on if extra is None else on & extra).drop("_key")


def thresholds(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(plan, sizes): per source source_size, target, whole (times every row is taken) and below (rows whose place is below it once more);
    per row doc_id, source, size, place."""
    sizes = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), place(F.col(id_col)).alias("place")), "mix-sizes")
    plan = targets(sizes, weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = written(plan.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")
    # the sought bucket: its first place (`low`) and the words that are still missing when it begins (`rest`)
    found = plan.where("rest > 0").select("source", F.lit(0).cast("long").alias("low"), "rest")
    for level in (2, 1, 0):
        width = 1 << (BITS * level)
        rows = sizes if level == 2 else _matched(sizes, found.select("source", F.col("low").alias("_low")), F.col("place").between(F.col("_low"), F.col("_low") + (width << BITS) - 1))
        cells = rows.groupBy("source", (F.floor(F.col("place") / width) * width).alias("cell")).agg(F.sum("size").alias("n"))
        cells = _matched(cells, found.select("source", "rest"))
        after = F.sum("n").over(Window.partitionBy("source").orderBy("cell"))
        half = F.lit(0) if level else F.col("n") / 2.0  # at the end: nearer with it or without it
        cells = cells.withColumn("_before", after - F.col("n")).withColumn("_crosses", (F.col("_before") + (half if level == 0 else F.col("n")) > F.col("rest")))
        found = cells.groupBy("source").agg(F.min(F.when(F.col("_crosses"), F.struct("cell", (F.col("rest") - F.col("_before")).alias("rest")))).alias("c"), F.max("cell").alias("end"))
        found = written(found.select("source", F.coalesce(F.col("c.cell"), F.col("end") + width).alias("low"), F.coalesce(F.col("c.rest"), F.lit(0.0)).alias("rest")), f"mix-level{level}")
    p, f = plan.alias("p"), found.withColumnRenamed("source", "_source").alias("f")
    plan = p.join(f, F.col("p.source").eqNullSafe(F.col("f._source")), "left").select("p.source", "source_size", "target", "whole", F.coalesce("low", F.lit(0)).alias("below"))
    return written(plan, "mix-plan"), sizes


def copies(place_col: Column, whole: str = "whole", below: str = "below") -> Column:
    return F.col(whole) + F.when(place_col < F.col(below), 1).otherwise(0)


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """Per row of docs: doc_id, size, source, source_size, target, taken (words the mix takes of it, repeats counted).

    A null text has no words and a null source is a source of its own; rows with
    the same id have the same place and are taken together; a source without
    words has target 0; an empty table gives no rows.
    """
    plan, sizes = thresholds(docs, **options)
    out = _matched(sizes, plan)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * copies(F.col("place"))).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """The rows of the mix: each row of docs as often as it is taken (0 to 2 times with most=2)."""
    plan, _ = thresholds(docs, id_col=id_col, source_col=source_col, **options)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), place(F.col(id_col)).alias("place"), F.col(source_col).alias("source"))
    out = _matched(rows, plan.select("source", "whole", "below")).withColumn("n", copies(F.col("place"))).where("n > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy")).select("row.*")

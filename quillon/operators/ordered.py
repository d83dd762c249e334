"""Running sums, ranks and earlier rows along an order, without one task for all rows or for all rows of one key.

Rows are dealt once by ranges of their order and written with the number of the
range (`dealt`).  What a range has to know of those before it is one row a range
of sums; inside a range Spark's windows do the rest.  Along a key, only the first
key of a range can go on from the range before, so what is handed on is again
one row a range: a key of any size is spread over as many tasks as it needs.

The caller's columns travel as one struct, so no name of theirs can clash with
the names used here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.sources.shared import written


def dealt(df: DataFrame, *order: Column, **also: Column) -> DataFrame:
    """row (struct of all columns), o0, o1, ... (the order), `also`, and part: rows of a smaller part come first. Rows of equal order share a part.

    Written once: Spark's range bounds come from a sample, so they must not be
    drawn twice.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rows = df.select(row.alias("row"), *[c.alias(f"o{i}") for i, c in enumerate(order)], *[c.alias(n) for n, c in also.items()])
    keys = [f"o{i}" for i in range(len(order))]
    return written(rows.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "dealt")


def running(df: DataFrame, order: Column, weight: Column) -> DataFrame:
    """row, idx (from 1), cum, total, n_rows of each row along the order; rows of equal order are taken one after another."""
    rows = dealt(df, order, n=weight)
    per = rows.groupBy("part").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    before, whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()  # a row a range
    base = per.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("k0"), F.sum("n").over(whole).alias("total"), F.sum("k").over(whole).alias("n_rows"))
    w = Window.partitionBy("part").orderBy("o0")
    own = rows.select("row", "part", F.row_number().over(w).alias("i"), F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("c"))
    return own.join(F.broadcast(base), "part").select("row", (F.col("k0") + F.col("i")).alias("idx"), (F.col("n0") + F.col("c")).alias("cum"), "total", "n_rows")


def along_key(df: DataFrame, key: Column, order: Column, **values: Column) -> tuple[DataFrame, DataFrame]:
    """The rows dealt by key and order, with values; and what each range's first key brings along from the ranges before.

    The second table has at most a row a range: part, o0 (the key), n (rows of
    the key before), and for each value its first, its last and its sum there
    (first_v, last_v, sum_v; sums of numbers only).
    """
    rows = dealt(df, key, order, **values)
    numbers = [n for n in values if rows.schema[n].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint", "float", "double") or rows.schema[n].dataType.simpleString().startswith("decimal")]
    # values in structs, so that a null that is first or last counts as such
    ends = [f(F.struct(v), F.col("o1")).alias(f"{name}_{v}") for v in values for name, f in (("first", F.min_by), ("last", F.max_by))]
    per = rows.groupBy("part", "o0").agg(F.count(F.lit(1)).alias("n"), *ends, *[F.sum(v).alias(f"sum_{v}") for v in numbers])
    w = Window.partitionBy("o0").orderBy("part")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.first(f"first_{v}").over(before)[v].alias(f"first_{v}") for v in values] + [F.lag(f"last_{v}").over(w)[v].alias(f"last_{v}") for v in values]
    carried += [F.sum(f"sum_{v}").over(before).alias(f"sum_{v}") for v in numbers]
    told = per.select("part", "o0", F.sum("n").over(before).alias("n"), *carried)
    return rows, told.where("n is not null")


def with_carried(rows: DataFrame, carried: DataFrame) -> DataFrame:
    """rows with the columns of carried (null where a key begins in its range)."""
    c = carried.withColumnsRenamed({"part": "part_", "o0": "o0_", "n": "n_before"})
    return rows.join(F.broadcast(c), (rows["part"] == c["part_"]) & rows["o0"].eqNullSafe(c["o0_"]), "left").drop("part_", "o0_")


def previous(df: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """df with the value of the row before it in its key (null in the first) as `name`, which takes the place of a column of that name."""
    rows, carried = along_key(df, F.col(f"`{key}`"), F.col(f"`{order}`"), v=F.col(f"`{value}`"))
    w = Window.partitionBy("part", "o0").orderBy("o1")
    own = with_carried(rows, carried).withColumn("found", F.when(F.row_number().over(w) == 1, F.col("last_v")).otherwise(F.lag("v").over(w)))
    return own.select(*[F.col("row")[c].alias(c) for c in df.columns if c != name], F.col("found").alias(name))

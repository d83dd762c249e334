"""Single-pass profiles of a table under a contract, named checks, roll-ups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.contracts import ColumnContract, TableContract
from quillon.functions.casting import is_empty, is_finite

MEASURES = ("empty_count", "parse_error_count", "non_finite_count", "below_count", "above_count", "distinct_count", "min_value", "max_value")


@dataclass(frozen=True)
class Check:
    """A named row condition that should not hold; only errors make a table invalid."""

    name: str
    violated: Column
    severity: str = "error"
    description: str = ""


def _measures(c: ColumnContract, v: Column) -> dict[str, Column]:
    raw = c.raw()
    finite = is_finite(v) if c.kind == "float" else v.isNotNull()
    no = F.lit(0).cast("long")
    out = {
        "empty_count": F.count_if(is_empty(raw)),
        "parse_error_count": F.count_if(~is_empty(raw) & v.isNull()) if c.kind != "text" else no,
        "non_finite_count": F.count_if(~is_finite(v)) if c.kind == "float" else no,
        "below_count": F.count_if(finite & (v < c.minimum)) if c.minimum is not None else no,
        "above_count": F.count_if(finite & (v > c.maximum)) if c.maximum is not None else no,
    }
    if c.kind == "float":
        low, high = (f(F.when(finite, v + 0.0)) for f in (F.min, F.max))
        out |= {"min_value": low.cast("string"), "max_value": high.cast("string")}
    elif c.kind == "text":
        out |= {"min_value": F.lit(None).cast("string"), "max_value": F.lit(None).cast("string")}
    else:
        out |= {"min_value": F.min(v).cast("string"), "max_value": F.max(v).cast("string")}
    return out


def profile_wide(df: DataFrame, contract: TableContract, checks: Sequence[Check] = ()) -> DataFrame:
    """One row: row_count, invalid_row_count, each column's measures, each check's count; one scan, one aggregation.

    Exact distinct counts take a second scan: the cells as (column, text) rows,
    made distinct in each task before they are shuffled, then counted by column.
    (In one aggregation Spark would copy every row once for each such column.)
    Leave `distinct` off for columns that are nearly unique.
    """
    stacked = [c for c in contract.columns if c.distinct]
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(c.name).alias("name"), F.when(~is_empty(c.raw()), c.raw()).alias("cell")) for c in stacked]))) if stacked else None
    values = {c.name: F.col(f"__value{i}") for i, c in enumerate(contract.columns)}
    df = df.withColumns({f"__value{i}": c.value() for i, c in enumerate(contract.columns)})  # each cell is parsed once
    aggs = [F.count(F.lit(1)).alias("row_count"), F.count_if(contract.row_invalid(True, values)).alias("invalid_row_count")]
    for c in contract.columns:
        aggs += [m.alias(f"{c.name}__{k}") for k, m in _measures(c, values[c.name]).items()]
    aggs += [F.count_if(k.violated).alias(f"check__{k.name}") for k in checks]
    out = df.agg(*aggs)
    no = [F.lit(None).cast("long").alias(f"{c.name}__distinct_count") for c in contract.columns if not c.distinct]
    if cells is None:
        return out.select("*", *no)
    n = cells.where("cell is not null").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    n = n.agg(*[F.coalesce(F.max(F.when(F.col("name") == c.name, F.col("n"))), F.lit(0)).alias(f"{c.name}__distinct_count") for c in stacked])
    return out.crossJoin(n).select("*", *no)  # one row each


def profile_long(df: DataFrame, contract: TableContract) -> DataFrame:
    """One row per column: column_name, kind and the measures."""
    wide = profile_wide(df, contract)
    rows = [F.struct(F.lit(c.name).alias("column_name"), F.lit(c.kind).alias("kind"), *[F.col(f"{c.name}__{k}").alias(k) for k in MEASURES]) for c in contract.columns]
    return wide.select(F.inline(F.array(*rows)))


def profile_summary(df: DataFrame, contract: TableContract) -> DataFrame:
    return df.agg(F.lit(contract.name).alias("table_name"), F.count(F.lit(1)).alias("row_count"), F.count_if(contract.row_invalid()).alias("invalid_row_count"))


def run_checks(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """One row per check: check_name, severity, violation_count."""
    wide = df.agg(*[F.count_if(k.violated).alias(f"c{i}") for i, k in enumerate(checks)])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(k.name).alias("check_name"), F.lit(k.severity).alias("severity"), F.col(f"c{i}").alias("violation_count")) for i, k in enumerate(checks)])))


def dataset_summary(members: DataFrame, checks: DataFrame) -> DataFrame:
    """total_rows and is_valid of a dataset: no invalid row in any member, no violated check of severity error."""
    m = members.agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_rows"), F.coalesce(F.bool_and(F.col("invalid_row_count") == 0), F.lit(True)).alias("m"))
    c = checks.agg(F.coalesce(F.bool_and((F.col("severity") != "error") | (F.col("violation_count") == 0)), F.lit(True)).alias("c"))
    return m.crossJoin(c).select("total_rows", (F.col("m") & F.col("c")).alias("is_valid"))  # one row each


def duplicate_rows(df: DataFrame, key: str) -> Column:
    """count(*) minus the distinct keys; null keys count as duplicates."""
    return F.count(F.lit(1)) - F.count_distinct(F.col(key))


def engine_stamp(spark) -> dict[str, str]:
    return {"engine": "spark", "version": spark.version}


def as_report(spark, members: DataFrame, columns: DataFrame, checks: DataFrame) -> dict:
    """A nested dictionary of aggregates for a JSON sink; a row per member, column and check only."""
    return {"engine": engine_stamp(spark), "members": [r.asDict() for r in members.collect()], "columns": [r.asDict() for r in columns.collect()], "checks": [r.asDict() for r in checks.collect()]}


def first_failure(tests: Sequence[tuple[str, Column]], accepted: str = "accepted") -> Column:
    """The name of the first test that fails, for a rejection histogram (fail-fast, so the reasons exclude each other)."""
    c = F.lit(accepted)
    for name, failed in reversed(tests):
        c = F.when(failed, name).otherwise(c)
    return c

"""Referential lineage: dimensions, unknown references, mismatches, accepted rows.

Joins carry no hints: Spark broadcasts a dimension whose size it knows to be
small and re-plans on measured sizes otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.contracts import TableContract


def dimension(df: DataFrame, key: str, *carried: str) -> DataFrame:
    """One row per key: the smallest carried values and how many rows it had."""
    return df.groupBy(key).agg(*[F.min(c).alias(c) for c in carried], F.count(F.lit(1)).alias("n_rows"))


def unknown(fact: DataFrame, dim: DataFrame, on: str | Sequence[tuple[str, str]]) -> DataFrame:
    """Rows of fact without a partner; null keys have none."""
    if isinstance(on, str):
        return fact.join(dim.select(on).distinct(), on, "left_anti")
    keys = dim.select(*[F.col(d).alias(f"_{d}") for _, d in on]).distinct()
    cond = None
    for f, d in on:
        c = F.col(f) == F.col(f"_{d}")
        cond = c if cond is None else cond & c
    return fact.join(keys, cond, "left_anti")


def unmatched_count(fact: DataFrame, dim: DataFrame, key: str, name: str) -> DataFrame:
    """A left join to a deduplicated dimension, and how many rows found nothing."""
    d = dim.select(key).distinct().withColumn("_hit", F.lit(True))
    return fact.join(d, key, "left").agg(F.count_if(F.col("_hit").isNull()).alias(name))


def mismatched(fact: DataFrame, dim: DataFrame, key: str, column: str) -> DataFrame:
    """Rows whose reference exists but whose column differs from the dimension's."""
    d = dim.select(key, F.col(column).alias("_d"))
    return fact.join(d, key).where(F.col(column) != F.col("_d")).drop("_d")


@dataclass(frozen=True)
class Step:
    """One table of a lineage: rows that meet the contract and refer to accepted rows of `parent` by the pairs of `on`."""

    name: str
    rows: DataFrame
    valid: Column
    parent: str | None = None
    on: tuple[tuple[str, str], ...] = ()


def accepted(steps: Sequence[Step], distinct_parents: bool = True) -> dict[str, DataFrame]:
    """Accepted rows of each table; a rejected parent rejects its children all the way down.

    Parents are deduplicated by key, so a key that occurs twice never multiplies
    the rows below it; distinct_parents=False keeps the multiplying join.
    """
    out: dict[str, DataFrame] = {}
    for s in steps:
        rows = s.rows.where(s.valid)
        if s.parent:
            keys = out[s.parent].select(*[F.col(p).alias(f"_{p}") for _, p in s.on])
            cond = None
            for c, p in s.on:
                x = F.col(c) == F.col(f"_{p}")
                cond = x if cond is None else cond & x
            rows = rows.join(keys, cond, "left_semi") if distinct_parents else rows.join(keys, cond).drop(*keys.columns)
        out[s.name] = rows
    return out


def acceptance_report(steps: Sequence[Step], distinct_parents: bool = True) -> DataFrame:
    """Per table: table_name, total_rows, accepted_rows, rejected_rows."""
    good = accepted(steps, distinct_parents)
    out = None
    for s in steps:
        n = s.rows.agg(F.lit(s.name).alias("table_name"), F.count(F.lit(1)).alias("total_rows"))
        a = good[s.name].agg(F.lit(s.name).alias("table_name"), F.count(F.lit(1)).alias("accepted_rows"))
        row = n.join(a, "table_name").select("table_name", "total_rows", "accepted_rows", (F.col("total_rows") - F.col("accepted_rows")).alias("rejected_rows"))
        out = row if out is None else out.unionByName(row)
    return out


def contract_steps(tables: dict[str, DataFrame], contracts: dict[str, TableContract], chain: Sequence[tuple[str, str | None, tuple[tuple[str, str], ...]]], strict_null: bool = True) -> list[Step]:
    """Steps whose validity is the contract's. With strict_null a nullable numeric cell that is empty is dropped, as the plain filter does."""
    return [Step(name, tables[name], ~contracts[name].row_invalid(strict_null), parent, on) for name, parent, on in chain]


#: The lineage of the six trace tables: machine, virtual machine, then its facts.
TRACE_CHAIN = (
    ("PM", None, ()),
    ("VM", "PM", (("pm_name", "pm_name"), ("site_id", "site_id"))),
    ("VM_CPU", "VM", (("vm_id", "vm_id"), ("site_id", "site_id"))),
    ("VM_BANDWIDTH", "VM", (("vm_id", "vm_id"), ("site_id", "site_id"))),
    ("VM_BW_THREE_MONTHS", "VM", (("vm_id", "vm_id"),)),
)


def trace_acceptance(tables: dict[str, DataFrame], strict_null: bool = True) -> DataFrame:
    """Acceptance of a whole trace; round-trip rows need accepted sites at both ends."""
    from quillon.contracts import TRACE

    steps = contract_steps(tables, TRACE, TRACE_CHAIN, strict_null)
    report = acceptance_report(steps)
    sites = accepted(steps[:1])["PM"].select("site_id").distinct()
    rtt = tables["SITE_RTT"]
    good = rtt.where(~TRACE["SITE_RTT"].row_invalid(strict_null)).join(sites.withColumnRenamed("site_id", "_a"), F.col("from_site_id") == F.col("_a"), "left_semi").join(sites.withColumnRenamed("site_id", "_b"), F.col("to_site_id") == F.col("_b"), "left_semi")
    n = rtt.agg(F.lit("SITE_RTT").alias("table_name"), F.count(F.lit(1)).alias("total_rows")).join(good.agg(F.lit("SITE_RTT").alias("table_name"), F.count(F.lit(1)).alias("accepted_rows")), "table_name")
    return report.unionByName(n.withColumn("rejected_rows", F.col("total_rows") - F.col("accepted_rows")))


def trace_reference_checks(tables: dict[str, DataFrame]) -> DataFrame:
    """Reference checks of a trace: check_name, severity, violation_count."""
    pm, vm = tables["PM"], tables["VM"]
    pm_dim, vm_dim = dimension(pm, "pm_name", "site_id"), dimension(vm, "vm_id", "site_id")
    sites = pm.select("site_id").distinct()

    def row(name: str, severity: str, df: DataFrame) -> DataFrame:
        return df.agg(F.lit(name).alias("check_name"), F.lit(severity).alias("severity"), F.count(F.lit(1)).alias("violation_count"))

    def duplicates(name: str, df: DataFrame, key: str) -> DataFrame:
        return df.agg(F.lit(name).alias("check_name"), F.lit("error").alias("severity"), (F.count(F.lit(1)) - F.count_distinct(key)).alias("violation_count"))

    out = [duplicates("duplicate_pm_rows", pm, "pm_name"), duplicates("duplicate_vm_rows", vm, "vm_id"), row("vm_unknown_pm_rows", "error", unknown(vm, pm_dim, "pm_name")), row("vm_site_mismatch_rows", "error", mismatched(vm, pm_dim, "pm_name", "site_id"))]
    for t in ("VM_CPU", "VM_BANDWIDTH"):
        out += [row(f"{t.lower()}_unknown_vm_rows", "error", unknown(tables[t], vm_dim, "vm_id")), row(f"{t.lower()}_site_mismatch_rows", "error", mismatched(tables[t], vm_dim, "vm_id", "site_id"))]
    out.append(row("vm_bw_three_months_unknown_vm_rows", "error", unknown(tables["VM_BW_THREE_MONTHS"], vm_dim, "vm_id")))
    for end in ("from", "to"):
        out.append(row(f"site_rtt_unknown_{end}_site_rows", "error", unknown(tables["SITE_RTT"], sites, ((f"{end}_site_id", "site_id"),))))
    total = out[0]
    for x in out[1:]:
        total = total.unionByName(x)
    return total

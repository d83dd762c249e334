"""Guarded casts, emptiness, finiteness, tiers: expressions for checking untyped text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Only plain decimal spellings are numbers, so that engines with looser casts give the same result.
NUMBER = r"^ *[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)? *$"
NON_FINITE = r"^ *[+-]?(nan|inf|infinity) *$"
INTEGER = r"^ *[+-]?[0-9]+ *$"


def is_empty(c: Column) -> Column:
    """Null, or nothing but spaces."""
    return c.isNull() | (F.trim(c) == "")


def guarded_cast(c: Column, kind: str) -> Column:
    """text, integer, float or timestamp from text; null where the spelling isn't one."""
    if kind == "text":
        return c
    if kind == "integer":
        return F.when(c.rlike(INTEGER), F.trim(c).try_cast("bigint"))
    if kind == "float":
        return F.when(c.rlike(NUMBER) | F.lower(c).rlike(NON_FINITE), F.trim(c).try_cast("double"))
    if kind == "timestamp":
        return F.trim(c).try_cast("timestamp_ntz")
    raise ValueError(f"unknown kind: {kind}")


def is_finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def latency_class(ms: Column) -> Column:
    """Below 50 hard_real_time, to 200 real_time, to 1000 interactive, else relaxed; null stays null."""
    return F.when(ms < 50, "hard_real_time").when(ms <= 200, "real_time").when(ms <= 1000, "interactive").when(ms.isNotNull(), "relaxed")


def reliability_tier(p: Column) -> Column:
    return F.when(p >= 0.999, "mission_critical").when(p >= 0.99, "high").when(p.isNotNull(), "standard")


def same_value(a: Column, b: Column, numeric: bool) -> Column:
    """Null-safe equality; numbers within 1e-9."""
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.abs(a - b) <= 1e-9) if numeric else a.eqNullSafe(b)


def is_ip(c: Column) -> Column:
    """IPv4 (four decimal parts up to 255, no leading zeros) or IPv6 (full, compressed or with an IPv4 tail)."""
    part = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    v4 = rf"{part}(\.{part}){{3}}"
    h = "[0-9a-fA-F]{1,4}"
    forms = [rf"({h}:){{7}}{h}", rf"({h}:){{6}}{v4}", rf"::({h}:){{0,5}}{v4}", rf"(({h}:){{0,6}}{h})?::(({h}:){{0,6}}{h})?", rf"({h}:){{1,5}}:({h}:){{0,4}}{v4}"]
    groups = F.size(F.filter(F.split(c, ":"), lambda x: x != "")) + F.when(c.contains("."), 1).otherwise(0)
    v6 = c.rlike(f"^({'|'.join(forms)})(%[^ /%]+)?$") & (~c.contains("::") | (groups <= 7))
    return F.coalesce(c.rlike(f"^{v4}$") | v6, F.lit(False))

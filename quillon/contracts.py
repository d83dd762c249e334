"""Declared table contracts: what each column holds, and the expressions that check it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.casting import guarded_cast, is_empty, is_finite

KINDS = {"text": T.StringType(), "integer": T.LongType(), "float": T.DoubleType(), "timestamp": T.TimestampNTZType()}


@dataclass(frozen=True)
class ColumnContract:
    name: str
    kind: str = "text"
    nullable: bool = False
    minimum: float | None = None
    maximum: float | None = None
    distinct: bool = True  # count distinct values in profiles
    source: str | None = None  # the header's name, if another
    unit: str | None = None
    provenance: str | None = None

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind: {self.kind}")

    @property
    def header(self) -> str:
        return self.name if self.source is None else self.source

    def raw(self) -> Column:
        return F.col(f"`{self.name.replace('`', '``')}`")

    def value(self) -> Column:
        return guarded_cast(self.raw(), self.kind)

    @property
    def numeric(self) -> bool:
        return self.kind in ("integer", "float")

    def invalid(self, strict_null: bool = True, value: Column | None = None) -> Column:
        """Whether a cell breaks the contract. value: the cell's value, if a column already holds it.

        In a nullable numeric column an empty cell makes the range comparisons
        null.  As a count that is 'not invalid', as a filter `not invalid` drops
        the row; strict_null keeps that, otherwise null counts as valid.
        """
        v = self.value() if value is None else value
        tests = [(~is_empty(self.raw()) & v.isNull())] if self.kind != "text" else []
        if not self.nullable:
            tests.append(is_empty(self.raw()))
        if self.kind == "float":
            tests.append(~is_finite(v))
        if self.minimum is not None:
            tests.append(v < self.minimum)
        if self.maximum is not None:
            tests.append(v > self.maximum)
        out = reduce(or_, tests) if tests else F.lit(False)
        return out if strict_null else F.coalesce(out, F.lit(False))


@dataclass(frozen=True)
class TableContract:
    name: str
    columns: tuple[ColumnContract, ...]

    def column(self, name: str) -> ColumnContract:
        return next(c for c in self.columns if c.name == name)

    @property
    def header(self) -> list[str]:
        return [c.header for c in self.columns]

    def text_schema(self) -> T.StructType:
        """All columns as text, under the header's names."""
        return T.StructType([T.StructField(c.header, T.StringType()) for c in self.columns])

    def schema(self) -> T.StructType:
        """Typed columns with unit and provenance as metadata."""
        return T.StructType([T.StructField(c.name, KINDS[c.kind], c.nullable, {k: v for k, v in (("unit", c.unit), ("provenance", c.provenance)) if v}) for c in self.columns])

    def row_invalid(self, strict_null: bool = True, values: dict[str, Column] | None = None) -> Column:
        return reduce(or_, [c.invalid(strict_null, values and values[c.name]) for c in self.columns])

    def as_text(self, df: DataFrame) -> DataFrame:
        """A typed table as text, for checking it like a file."""
        return df.select(*[F.col(c.header).cast("string").alias(c.name) for c in self.columns])

    def typed(self, df: DataFrame) -> DataFrame:
        return df.select(*[c.value().alias(c.name) for c in self.columns])


def _c(name: str, kind: str, lo: float | None = None, hi: float | None = None, nullable: bool = False, **more) -> ColumnContract:
    return ColumnContract(name, kind, nullable, lo, hi, **more)


# The six tables of an edge-platform trace.
TRACE = {
    t.name: t
    for t in (
        TableContract("PM", (_c("pm_name", "text"), _c("site_id", "text"), _c("cores", "integer", 1), _c("memory", "integer", 1), _c("storage", "integer", 1))),
        TableContract("VM", (_c("vm_id", "text"), _c("uid", "text", nullable=True), _c("pm_name", "text"), _c("site_id", "text"), _c("status", "text", nullable=True), _c("image_id", "text", nullable=True), _c("cores", "integer", 0), _c("memory", "integer", 0), _c("storage", "integer", 0), _c("os_type", "text", nullable=True), _c("os_name", "text", nullable=True), _c("start_time", "integer", 0), _c("end_time", "integer", 0))),
        TableContract("VM_CPU", (_c("vm_id", "text", distinct=False), _c("site_id", "text", distinct=False), _c("cpu_rate", "float", 0, 1), _c("report_ts", "integer", 1, distinct=False))),
        TableContract("VM_BANDWIDTH", (_c("vm_id", "text", distinct=False), _c("site_id", "text", distinct=False), _c("pub_down_flow", "integer", 0), _c("pub_up_flow", "integer", 0), _c("pub_down_bw", "float", 0), _c("pub_up_bw", "float", 0), _c("pri_down_flow", "integer", 0), _c("pri_up_flow", "integer", 0), _c("pri_down_bw", "float", 0), _c("pri_up_bw", "float", 0), _c("report_ts", "integer", 1, distinct=False))),
        TableContract("VM_BW_THREE_MONTHS", (_c("vm_id", "text", distinct=False), _c("report_time", "timestamp", distinct=False), _c("pub_down_bw", "float", 0), _c("pub_up_bw", "float", 0), _c("pri_down_bw", "float", 0), _c("pri_up_bw", "float", 0))),
        TableContract("SITE_RTT", (_c("row_index", "integer", 0, distinct=False, source=""), _c("from_site_id", "text"), _c("to_site_id", "text"), _c("rtt", "float", 0), _c("loss", "float", 0, 100, True), _c("type", "text", nullable=True), _c("biz_ts", "integer", 1, distinct=False), _c("biz_time", "timestamp", distinct=False), _c("create_time", "timestamp", distinct=False))),
    )
}

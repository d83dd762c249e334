"""Strict readers of files: contract CSV, headerless logs, JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.contracts import TRACE, TableContract
from quillon.functions import casting, identity
from quillon.sources import splits

CITIES = ("beijing", "guangzhou", "shanghai")


class SourceError(ValueError):
    pass


def _paths(spark: SparkSession, folder: str) -> dict[str, str]:
    """Names and paths of what lies in a folder, by Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise SourceError(f"no folder {folder}")
    return {s.getPath().getName(): s.getPath().toString() for s in fs.listStatus(p)}


def resolve_root(spark: SparkSession, folder: str, names: set[str]) -> dict[str, str]:
    """Paths of exactly the named files, in the folder or in the only folder inside it."""
    found = _paths(spark, folder)
    if len(found) == 1 and next(iter(found)) not in names:
        found = _paths(spark, next(iter(found.values())))
    files = {n: p for n, p in found.items() if not n.startswith((".", "_"))}
    if set(files) != names:
        raise SourceError(f"missing: {sorted(names - set(files))}; not expected: {sorted(set(files) - names)}")
    return files


def read_header(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise SourceError(f"{path} is empty")
    import csv

    return next(csv.reader([first[0].value.lstrip("﻿")]))


def read_contract_csv(spark: SparkSession, path: str, contract: TableContract) -> DataFrame:
    """A CSV file as text columns under the contract's names.  The header must be the contract's (a byte-order mark is allowed); short and long rows raise when they are read."""
    got = read_header(spark, path)
    if got != contract.header:
        raise SourceError(f"header of {path}: {got}, expected {contract.header}")
    names = [c.name for c in contract.columns]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("mode", "FAILFAST").option("quote", '"').option("escape", '"').option("nullValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return df


def read_trace(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The six tables of a trace folder: exactly the expected files, each with its header."""
    files = resolve_root(spark, folder, {f"{n}.csv" for n in TRACE})
    return {n: read_contract_csv(spark, files[f"{n}.csv"], c) for n, c in TRACE.items()}


_LOG_TESTS = ("row must have 18 fields and a tail", "device is empty", "city isn't supported", "a number is not a non-negative integer", "a time can't be read", "end before start", "a port is above 65535", "an address isn't an IP")


def parse_log(lines: DataFrame, key: bytes, cities: tuple[str, ...] = CITIES, value: str = "value", path: str = "source_path", row: str = "source_row_number") -> DataFrame:
    """Headerless log lines (18 fields, then free text with commas) to pseudonymous records.

    lines: value, source_path, source_row_number. Columns of the result: error
    (null for a good row, else the first reason) and the record's fields, null
    for bad rows. No raw identifier, address or free text is returned.
    """
    f = F.split(F.regexp_replace(F.col(value), r"[\r\n]+$", ""), ",", 19)
    at = lambda i: F.get(f, F.lit(i))
    number = lambda i: F.when(at(i).rlike(r"^ *[0-9]+ *$"), F.trim(at(i)).try_cast("bigint"))
    time = lambda i: F.trim(at(i)).try_cast("timestamp_ntz")
    city = F.lower(F.element_at(F.split(F.col(path), "/"), -2))
    p = lines.withColumn("_f", f).withColumn("_city", city)
    numbers = {n: number(i) for n, i in (("lac", 1), ("cell", 2), ("duration_s", 9), ("up", 10), ("down", 11), ("rat", 12), ("sport", 14), ("dport", 16), ("status", 17))}
    p = p.withColumns({f"_{k}": v for k, v in numbers.items()} | {"_start": time(7), "_end": time(8)})
    some_null = F.lit(False)
    for k in numbers:
        some_null = some_null | F.col(f"_{k}").isNull()
    ip = casting.is_ip(at(5)) & casting.is_ip(at(6)) & casting.is_ip(at(13)) & casting.is_ip(at(15))
    tests = (F.size("_f") != 19, at(0) == "", ~F.coalesce(F.col("_city").isin(*cities), F.lit(False)), some_null, F.col("_start").isNull() | F.col("_end").isNull(), F.col("_end") < F.col("_start"), (F.col("_sport") > 65535) | (F.col("_dport") > 65535), ~ip)
    from quillon.operators.profile import first_failure

    p = p.withColumn("error", F.nullif(first_failure(list(zip(_LOG_TESTS, tests)), ""), F.lit("")))
    good = F.col("error").isNull()
    fields: dict[str, Column] = {
        "sample_id": identity.sha256_id(F.col(path), F.col(row)),
        "city": F.col("_city"),
        "device_id": identity.hmac_sha256(key, "device", at(0)),
        "station_id": identity.hmac_sha256(key, "station", F.concat_ws(":", "_city", "_lac", "_cell")),
        "arrival_time": F.col("_start"),
        "duration_s": F.col("_duration_s"),
        "input_bits": F.col("_up") * 8,
        "output_bits": F.col("_down") * 8,
        "radio_access_type": F.col("_rat"),
        "destination_port": F.col("_dport"),
        "status_code": F.col("_status"),
    }
    return p.select("error", F.col(path).alias("source_path"), F.col(row).alias("source_row_number"), *[F.when(good, c).alias(n) for n, c in fields.items()])


def json_rows(spark: SparkSession, path: str | list[str], schema: T.StructType, split_bytes: int = splits.SPLIT_BYTES) -> DataFrame:
    """source_path, source_row_number, issue, record of JSON lines: record under the schema, or what is wrong with the line.

    A record must be an object on one line with values of the schema's kinds;
    each line is parsed once, by the task that reads it.
    """
    lines = splits.numbered_lines(spark, path, split_bytes)
    bad = "_bad_" + "_".join(schema.fieldNames())[:20]
    read = F.from_json("value", T.StructType([*schema.fields, T.StructField(bad, T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad})
    rows = lines.withColumn("r", read)
    text = F.trim("value", F.lit(" \t"))
    issue = F.when(text == "", "blank line").when(~text.startswith("{"), "not an object").when(F.col("r").isNull() | F.col("r")[bad].isNotNull(), "invalid JSON or another type")
    record = F.struct(*[F.col("r")[f].alias(f) for f in schema.fieldNames()])
    return rows.select("source_path", "source_row_number", issue.alias("issue"), F.when(issue.isNull(), record).alias("record"))


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType, split_bytes: int = splits.SPLIT_BYTES) -> DataFrame:
    """JSON lines under a schema, strictly: an empty file raises now, a line with an issue raises with its number when it is read."""
    for name, length in splits.listed(spark, path):
        if not length:
            raise SourceError(f"{name} is empty")
    rows = json_rows(spark, path, schema, split_bytes)
    message = F.concat("source_path", F.lit(", line "), F.col("source_row_number").cast("string"), F.lit(": "), F.col("issue"))
    good = F.when(F.col("issue").isNull(), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return rows.where(good).select("record.*")


def checksum_matches(spark: SparkSession, path: str, expected: str) -> bool:
    """Whether the one file at path has this SHA-256."""
    found = splits.checksums(spark, path).select("sha256").collect()
    return [r[0] for r in found] == [expected.lower()]

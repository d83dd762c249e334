"""Sinks: canonical JSON lines, verified atomic JSON, write-once files, resumable members."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.identity import canonical_json


def write_canonical_jsonl(df: DataFrame, path: str, fields: dict[str, Column], one_file: bool = False) -> None:
    """Rows as canonical JSON text (sorted keys, compact). one_file gathers all rows in one task: only for small results."""
    lines = df.select(canonical_json(fields).alias("value"))
    (lines.coalesce(1) if one_file else lines).write.mode("errorifexists").text(path)


def write_json_atomic(path: str | Path, value: object) -> None:
    """Write beside the file, read again, then rename: readers see the old file or the whole new one."""
    path = Path(path)
    text = json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2, allow_nan=False) + "\n"
    tmp = path.with_name(path.name + ".tmp")
    tmp.write_text(text, encoding="utf-8")
    if json.loads(tmp.read_text(encoding="utf-8")) != json.loads(text):
        tmp.unlink()
        raise OSError(f"{path} was not written as it is")
    os.replace(tmp, path)


def write_once(path: str | Path, content: bytes) -> bool:
    """True if written; False if the same bytes were there; other bytes raise."""
    path = Path(path)
    try:
        with path.open("xb") as f:
            f.write(content)
        return True
    except FileExistsError:
        if path.read_bytes() != content:
            raise ValueError(f"{path} is locked with other content") from None
        return False


def run_members(spark: SparkSession, path: str, members: Iterable[str], version: str, compute: Callable[[str], DataFrame]) -> list[str]:
    """Compute each member and append it under its name and version; members already there are skipped, so an interrupted run goes on where it stopped."""
    jvm = spark.sparkContext._jvm
    done: list[str] = []
    for m in members:
        out = f"{path}/version={version}/member={m}"
        p = jvm.org.apache.hadoop.fs.Path(f"{out}/_SUCCESS")
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            continue
        compute(m).write.mode("overwrite").parquet(out)
        done.append(m)
    return done


def prediction_rows(df: DataFrame, version: str, payload: list[str]) -> DataFrame:
    """Rows to store: a version and the payload; timings stay behind."""
    return df.select(F.lit(version).alias("schema_version"), F.struct(*payload).alias("annotation"))

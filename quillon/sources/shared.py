"""Intermediate tables of the sources: in the folder that driver and executors share, spark.checkpoint.dir.

The setting is read from the session; only where it is unset and the master is
local (tests on one machine) a folder under the temporary directory is used.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_made: list[str] = []

#: Arrow batches between the JVM and Python hold at most so much (one row may hold more); Spark's default of 10,000 rows lets a batch grow with the texts.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2_000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def bounded_batches(spark: SparkSession) -> None:
    """Let Python get its rows in small batches. The session keeps the setting: it is read when a plan runs."""
    for key, most in BATCH.items():
        now = re.fullmatch(r"(\d+)b?", str(spark.conf.get(key)).lower())
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(key, str(most))


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not told:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="quillon-sources-"))
        told = _local[0]
    _made.append(f"{told.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: its lineage ends there and survives lost executors."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> int:
    """Delete what this process has put into the shared folder so far, and return how many tables that were. For the caller to call once their results are read or written: a result not read yet may need them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while _made:
        p = jvm.org.apache.hadoop.fs.Path(_made.pop())
        n += bool(p.getFileSystem(conf).delete(p, True))
    return n

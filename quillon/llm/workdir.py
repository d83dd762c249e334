"""Where operators keep intermediate tables: the shared folder of spark.checkpoint.dir.

The setting is read from the session; only where it is unset (tests on one
machine) a folder under the system's temporary directory is used.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


#: Arrow batches between the JVM and Python hold at most so much (one row may hold more); Spark's default of 10,000 rows has no bound in bytes.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2_000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow in bounded batches. The session keeps the smaller batches: they are read when the plan runs."""
    conf = df.sparkSession.conf
    for key, most in BATCH.items():
        now = re.fullmatch(r"(\d+)b?", str(conf.get(key)).lower())
        if not now or not 0 < int(now[1]) <= most:
            conf.set(key, str(most))
    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="quillon-"))
    return _local[0]


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """df as a table in the shared folder, read again: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Intermediate tables of one call, in one folder of the shared folder, dropped together once nothing reads them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, table_path(spark, name)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        dropped(self.spark, self.path)


def unused(df: DataFrame, *stems: str) -> list[str]:
    """A column name for each stem that df doesn't have (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name = stem
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out

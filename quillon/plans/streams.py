"""Run a streaming plan over data that is there, to completion, and give the result as a table."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _folder(spark: SparkSession) -> str:
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not told:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        told = "file://" + tempfile.mkdtemp(prefix="quillon-")
    return f"{told.rstrip('/')}/stream-{uuid.uuid4().hex}"


def run_available(spark: SparkSession, df: DataFrame, plan: Callable[[DataFrame], DataFrame], order: Sequence[str] = (), rows: int = 1_000_000) -> DataFrame:
    """What a plan makes of df as a stream.

    order: columns that rows follow one another by. Then df comes in ranges of
    this order, of about so many rows, each a run of its own that goes on from
    the state of the one before: a micro-batch stays small whatever df's size.
    """
    at = _folder(spark)
    n = -(-df.count() // rows) if order else 1
    if n > 1:
        df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()).write.partitionBy("_range").parquet(f"{at}/ranges")
        parts = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_range", T.IntegerType())])).parquet(f"{at}/ranges")
    for i in range(max(n, 1)):
        (df if n <= 1 else parts.where(F.col("_range") == i).drop("_range")).write.mode("append").parquet(f"{at}/in")
        out = plan(spark.readStream.schema(df.schema).parquet(f"{at}/in"))
        q = out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out")

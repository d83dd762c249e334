"""A training-corpus pipeline: five stages, each one of the operators of quillon.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet in the shared folder and read again as the next stage's docs.  All but
the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import binary_output, decontam, mixing, neardup, quality
from quillon.llm.queries import END_ID, table, tokenizer_path
from quillon.llm.workdir import table_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return neardup.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them (none, once or twice)."""
    return mixing.mixed(docs)


def output_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids written in the binary format; what reading them back gives for each document."""
    path = binary_output.write_ids(docs, table_path(spark, "corpus-ids"), tokenizer_path(), END_ID)
    return binary_output.read_ids(spark, path, digest_only=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicates", neardup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage),
    ("binary output", output_stage),
]

#: SQL can't express the stages (fitted models, sampled signatures, Huffman files). Tests hold each operator against a plain version or planted rows; of the stages as they follow one another they look at columns and row counts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = table_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

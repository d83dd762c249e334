"""Target-distribution importance resampling over a persisted sparse document-by-bucket count matrix.

Features are all runs of 1 to ORDERS consecutive words, joined by one space; a
feature's bucket is the CRC-32 of its UTF-8 bytes modulo BUCKETS.  The counts of
the documents are written once as CSR blocks (one a chunk of texts: where each
row ends, buckets, counts).  Column sums over the blocks give the bucket
distribution of the raw and of the target text, their log ratios are the gains,
and the product of the matrix with the gains gives each document's weight.
Gumbel noise from a hash of the id turns the weights into keys, of which the
largest are drawn: a sample without replacement by weight.

What meets in one place is bounded: BUCKETS sums on the driver, and one row a
distinct score (whole numbers within some tens of thousands, whatever the
corpus) in the one window without a key.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.textops import by_chunk, lists
from quillon.llm.workdir import Scratch, mapped, table_path

BUCKETS = 10_000
ORDERS = 2
SEED = 7
#: Documents of fewer words are weighed but never drawn.
LEAST_WORDS = 20
DRAWN_PERCENT = 25

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: ASCII letters and digits (lower-cased) and every byte of a non-ASCII character.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def features(text: str | None, buckets: int = BUCKETS, orders: int = ORDERS) -> tuple[int, np.ndarray]:
    """The number of words of a text, and the bucket of each of its features, repeats included."""
    words = _WORD.findall((text or "").encode().translate(_FOLD))
    sums = list(map(crc32, words))
    found = [sums]
    for k in range(1, min(orders, len(words))):
        sums = list(map(crc32, words[k:], map(crc32, repeat(b" "), sums[: len(words) - k])))
        found.append(sums)
    return len(words), np.concatenate([np.array(x, np.int64) for x in found]) % buckets


def _index_type(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def count_matrix(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, orders: int = ORDERS) -> DataFrame:
    """Write the counts of all rows as CSR blocks to path and read them again.

    A block has doc_ids and n_words (one each a row), row_ends (where a row's
    entries end, int64), buckets and counts (one each an entry, ascending within
    a row), the last three as little-endian bytes.  A null text has no entries.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType
    schema = T.StructType().add("doc_ids", T.ArrayType(kind)).add("n_words", T.ArrayType(T.LongType())).add("row_ends", "binary").add("buckets", "binary").add("counts", "binary")
    index = _index_type(buckets)

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [features(t, buckets, orders) for t in b.column(1).to_pylist()]
        own = np.repeat(np.arange(len(found)), [len(x) for _, x in found])
        cells, counts = np.unique(own * buckets + np.concatenate([x for _, x in found]), return_counts=True)
        ends = np.searchsorted(cells, (np.arange(len(found)) + 1) * buckets)
        whole = np.array([len(found)])
        ids = pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), b.column(0))
        raw = [x.tobytes() for x in (ends.astype("<i8"), (cells % buckets).astype(index), counts.astype("<u4"))]
        return pa.RecordBatch.from_arrays([ids, lists(np.array([n for n, _ in found], np.int64), whole, pa.int64()), *(pa.array([x], pa.binary()) for x in raw)], schema.names)

    mapped(rows, by_chunk(one), schema).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _bytes(cell: pa.Scalar, kind: str) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), kind)


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows fall in each bucket: summed within each task, then over the tasks."""
    index = _index_type(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for at, n in zip(b.column(0), b.column(1)):
                np.add.at(total, _bytes(at, index), _bytes(n, "<u4").astype(np.int64))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    sums = mapped(matrix.select("buckets", "counts"), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of target to raw frequency of each bucket, one added to each count, rounded down."""
    k, s, t = len(raw), int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000.0 * math.log(((b + 1.0) * (s + k)) / ((a + 1.0) * (t + k)))) for a, b in zip(raw.tolist(), target.tolist())], np.int64)


def weights(matrix: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row: the matrix times the gains, over the row's features, rounded down (no features: 0)."""
    kind = matrix.schema["doc_ids"].dataType.elementType
    schema = T.StructType().add("doc_id", kind).add("n_words", "long").add("n_features", "long").add("weight", "long")
    index = _index_type(len(gain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ends, at, n = (_bytes(b.column(k)[i], t) for k, t in ((2, "<i8"), (3, index), (4, "<u4")))
                counts = n.astype(np.int64)
                per = [np.diff(np.concatenate(([0], np.cumsum(x)))[np.concatenate(([0], ends))]) for x in (counts, counts * gain[at])]
                mean = np.where(per[0] > 0, per[1] // np.maximum(per[0], 1), 0)
                yield pa.RecordBatch.from_arrays([b.column(0)[i].values, b.column(1)[i].values, pa.array(per[0]), pa.array(mean)], schema.names)

    return mapped(matrix, run, schema)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of standard Gumbel noise from a hash of seed and id (a null id: of the seed alone), rounded down."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(scored: DataFrame, percent: int = DRAWN_PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored (doc_id, n_words, score, ...) with the rank of the drawn rows as last column, null for the others.

    A row's rank is the number of rows of higher scores plus its place among
    the rows of its own score by doc_id (null last), so rows meet by score only.
    """
    fit = F.col("n_words") >= least_words
    per = scored.where(fit).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.col("score").desc())
    per = per.select("score", F.lit(True).alias("fit"), (F.sum("n").over(order) - F.col("n")).alias("above"), F.sum("n").over(Window.partitionBy()).alias("total"))
    drawn = F.floor(F.col("total") * percent / 100)
    per = per.where(F.col("above") < drawn).select("score", "fit", "above", drawn.alias("drawn"))
    place = F.col("above") + F.row_number().over(Window.partitionBy("score", "fit").orderBy(F.col("doc_id").asc_nulls_last()))
    return scored.withColumn("fit", fit).join(per, ["score", "fit"], "left").select(*scored.columns, F.when(place <= F.col("drawn"), place).cast("long").alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs, drawn towards the texts of target.

    The matrix of docs stays in the shared folder only until the scores are
    written; the table of scores is what the result reads.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "resampling")
    matrix = count_matrix(docs, f"{scratch.path}/documents", id_col, text_col)
    goal = count_matrix(target, f"{scratch.path}/target", target_col, target_col)
    gain = gains(column_sums(matrix), column_sums(goal))
    scored = weights(matrix, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id")))
    path = table_path(spark, "resampling-scores")
    scored.write.parquet(path)
    scratch.drop()
    return ranked(spark.read.schema(scored.schema).parquet(path)).select("doc_id", "n_features", "weight", "score", "rank")

"""Files of any size in splits: numbered lines, byte chunks, checksums.

A text file is cut into byte ranges by Spark's own reader, each read by one
task.  What a row needs to know of the ranges before its own (how many lines,
how many bytes) is counted per range in a first scan, summed up along each file,
and added in the second; so no task reads a whole file, and nothing but one row
a range is ever brought together.

Bytes of any file are read the same way: between line feeds the reader returns
them as they are, and a line feed follows each but perhaps the last.  A stretch
of 2 GB or more without a line feed can't be read.

Both scans must cut the files alike, whatever the cluster is doing, so they are
made in a session of their own in which the size of a range is fixed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of a range, unless the caller says otherwise.
SPLIT_BYTES = 128 << 20
#: Bytes of a chunk (one more stretch between line feeds may follow).
CHUNK_BYTES = 1 << 20
_ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
CHUNK_SCHEMA = "source_path string, offset long, size long, bytes binary"


def _scan(spark: SparkSession, path: str | list[str], split_bytes: int, raw: bool) -> DataFrame:
    """value, source_path, size, split (where its range begins), at (ascending by one along a range)."""
    own = spark.newSession()
    for key, value in {"spark.sql.files.maxPartitionBytes": str(split_bytes), "spark.sql.files.minPartitionNum": "1", **_ARROW}.items():
        own.conf.set(key, value)
    reader = own.read.option("lineSep", "\n") if raw else own.read
    meta = F.col("_metadata")
    return reader.text(path).select("value", meta["file_path"].alias("source_path"), meta["file_size"].alias("size"), meta["file_block_start"].alias("split"), F.monotonically_increasing_id().alias("at"))


def listed(spark: SparkSession, path: str | list[str]) -> list[tuple[str, int]]:
    """Path and length of every file that a path (or pattern, or folder) names, empty ones too, which Spark's readers pass over."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for one in [path] if isinstance(path, str) else path:
        p = jvm.org.apache.hadoop.fs.Path(one)
        fs = p.getFileSystem(conf)
        todo = list(fs.globStatus(p) or [])
        while todo:
            s = todo.pop()
            if s.isDirectory():
                todo += [x for x in fs.listStatus(s.getPath()) if not x.getPath().getName().startswith((".", "_"))]
            else:
                out.append((s.getPath().toString(), s.getLen()))
    return out


def _ranges(scan: DataFrame, spark: SparkSession) -> DataFrame:
    """One row a range, local: source_path, split, size, first (its smallest at), lines and bytes before it in its file, and of its file."""
    sums = scan.groupBy("source_path", "split").agg(F.max("size").alias("size"), F.min("at").alias("first"), F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value") + F.lit(1).cast("long")).alias("n_bytes"))
    order = Window.partitionBy("source_path").orderBy("split")
    file = Window.partitionBy("source_path")
    told = sums.select("source_path", "split", "size", "first", (F.sum("n").over(order) - F.col("n")).alias("lines_before"), (F.sum("n_bytes").over(order) - F.col("n_bytes")).alias("bytes_before"), F.sum("n_bytes").over(file).alias("file_bytes"))
    # one row a range of SPLIT_BYTES reaches the driver; as a local table its size is known to the planner, which broadcasts it if it is small
    return spark.createDataFrame(told.toArrow())


def numbered_lines(spark: SparkSession, path: str | list[str], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """value, source_path, source_row_number (from 1) of the lines of text files.

    Lines end with \\n, \\r or \\r\\n; a last line without an end counts, an empty
    file has none; a byte-order mark isn't part of the first line.  Compressed
    files can't be split and are read by one task each.  The files are scanned
    once when this is called and again when the result is read.
    """
    scan = _scan(spark, path, split_bytes, raw=False)
    ranges = _ranges(scan, spark).select("source_path", "split", "first", "lines_before")
    number = F.col("at") - F.col("first") + F.col("lines_before") + 1
    return ranges.join(scan.select("value", "source_path", "split", "at"), ["source_path", "split"]).select("value", "source_path", number.alias("source_row_number"))


def byte_chunks(spark: SparkSession, path: str | list[str], split_bytes: int = SPLIT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """source_path, offset, size (of the file), bytes: every byte of the files once, in chunks.

    Empty files have no chunk.  Rows of a range are gathered in order within the
    task that reads it; nothing is shuffled.
    """
    scan = _scan(spark, path, split_bytes, raw=True)
    ranges = _ranges(scan, spark)
    # a byte-order mark at the beginning of a file is left out by the reader: it is what is missing from the sum
    mark = F.col("size") - F.col("file_bytes") >= 2
    base = F.col("bytes_before") + F.when(mark & (F.col("split") > 0), 3).otherwise(0)
    ranges = ranges.select("source_path", "split", base.alias("base"), (mark & (F.col("split") == 0)).alias("marked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, at = [], 0, (None, None, 0)

        def out() -> pa.RecordBatch:
            path, start, size, offset = *at[0], at[1]
            return pa.RecordBatch.from_pydict({"source_path": [path], "split": [start], "offset": [offset], "size": [size], "bytes": [b"".join(held)]}, schema=_RAW)

        for b in batches:
            for key, value in zip(zip(b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(2).to_pylist()), b.column(0).to_pylist()):
                if held and (key != at[0] or n >= chunk_bytes):
                    yield out()
                    at = (at[0], at[1] + n)
                    held, n = [], 0
                if key != at[0]:
                    at = (key, 0)
                held += (value, b"\n")
                n += len(value) + 1
        if held:
            yield out()

    raw = scan.select(F.col("value").cast("binary").alias("value"), "source_path", "size", "split")
    chunks = raw.mapInArrow(run, "source_path string, split long, offset long, size long, bytes binary")
    content = F.when(F.col("marked") & (F.col("offset") == 0), F.concat(F.unhex(F.lit("EFBBBF")), F.col("bytes"))).otherwise(F.col("bytes"))
    offset = F.col("offset") + F.col("base") + F.when(F.col("marked") & (F.col("offset") > 0), 3).otherwise(0)
    joined = ranges.join(chunks, ["source_path", "split"]).select("source_path", offset.alias("offset"), "size", content.alias("bytes"))
    # the line feed after the last stretch is in the file only if it is within its size
    left = (F.col("size") - F.col("offset")).cast("int")
    cut = F.when(F.octet_length("bytes") > F.col("size") - F.col("offset"), F.substring(F.col("bytes"), F.lit(1), left)).otherwise(F.col("bytes"))
    joined = joined.select("source_path", "offset", "size", cut.alias("bytes")).where(F.octet_length("bytes") > 0)
    # of a file that is nothing but a byte-order mark the reader has no row at all
    marks = spark.read.format("binaryFile").load(path).where("length = 3").where(F.col("content") == F.unhex(F.lit("EFBBBF")))
    return joined.unionByName(marks.select(F.col("_metadata.file_path").alias("source_path"), F.lit(0).cast("long").alias("offset"), F.col("length").alias("size"), F.col("content").alias("bytes")))


_RAW = pa.schema([("source_path", pa.string()), ("split", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("bytes", pa.binary())])


def checksums(spark: SparkSession, path: str | list[str], split_bytes: int = SPLIT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """source_path, length, sha256 of files of any size.

    A file is read by as many tasks as it has ranges; its chunks then pass one
    task in order, as the hash demands, one chunk at a time.
    """
    chunks = byte_chunks(spark, path, split_bytes, chunk_bytes).repartition("source_path").sortWithinPartitions("source_path", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h, n, size = None, None, 0, 0

        def out() -> pa.RecordBatch:
            if n != size:
                raise ValueError(f"{now}: {n} bytes read of {size}")
            return pa.RecordBatch.from_pydict({"source_path": [now], "sha256": [h.hexdigest()]})

        for b in batches:
            for file, offset, total, part in zip(*(b.column(k).to_pylist() for k in range(4))):
                if file != now:
                    if now is not None:
                        yield out()
                    now, h, n, size = file, hashlib.sha256(), 0, total
                if offset != n:
                    raise ValueError(f"{file}: bytes from {n} to {offset} are missing")
                h.update(part)
                n += len(part)
        if now is not None:
            yield out()

    sums = chunks.mapInArrow(run, "source_path string, sha256 string")
    files = spark.createDataFrame(listed(spark, path), "source_path string, length long")
    return files.join(sums, "source_path", "left").select("source_path", "length", F.when(F.col("length") == 0, hashlib.sha256().hexdigest()).otherwise(F.col("sha256")).alias("sha256"))

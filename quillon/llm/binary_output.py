"""Token-id output: canonical Huffman blocks of ids, written in document order and read back.

The written dataset has two Parquet tables: `codebook` (one row: the code length
of each id, one byte each) and `blocks`.  A block is self-contained given the
codebook: its place in the sequence of all ids, its documents' ids and lengths,
the packed bits, and a bit offset for every 64th id from which reading can begin.
It holds whole documents (piece -1), or one piece of a document of more than
LONGEST ids (piece 0, 1, ...), so no block grows with a text.
Everything is written by Spark's own writer, so a lost task is simply run again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm import huffman
from quillon.llm.textops import by_chunk, lists
from quillon.llm.workdir import dropped, mapped, table_path

BLOCK_IDS = 1 << 16
LONGEST = 2 * BLOCK_IDS
#: Bytes of the texts that are encoded together and make a block.
BLOCK_BYTES = 1 << 19


@lru_cache(2)
def _ids(path: str):
    from quillon.llm.pretokens import Ids

    return Ids(path)


def _tokenised(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Raw blocks of ids. Rows are dealt by ranges of doc_id, so (part, block) is the document order."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    kind = rows.schema["doc_id"].dataType
    schema = T.StructType().add("part", "integer").add("block", "integer").add("piece", "integer").add("doc_offset", "long").add("offset", "long").add("doc_ids", T.ArrayType(kind)).add("n_tokens", T.ArrayType(T.IntegerType())).add("ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, state = _ids(tokenizer), TaskContext.get().partitionId(), {"block": 0, "offset": 0}

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            ids, per = encoder.of(b.column(1))
            ends = np.cumsum(per + 1)
            every = np.full(int(ends[-1]), end_id, np.uint32)
            own = np.ones(len(every), bool)
            own[ends - 1] = False
            every[own] = ids
            total, at = int(ends[-1]), state["offset"]
            if len(per) > 1 or total <= LONGEST:
                cuts, pieces = [(0, total)], [-1]
            else:
                cuts = [(x, min(x + BLOCK_IDS, total)) for x in range(0, total, BLOCK_IDS)]
                pieces = list(range(len(cuts)))
            counts = [(per + 1).astype(np.int32) if k < 0 else np.array([e - s], np.int32) for k, (s, e) in zip(pieces, cuts)]
            sizes = np.array([len(c) for c in counts])
            blocks = range(state["block"], state["block"] + len(cuts))
            state["block"] += len(cuts)
            state["offset"] += total
            own_ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), b.column(0) if len(cuts) == 1 else b.column(0).take(pa.array([0] * len(cuts))))
            cols = [[part] * len(cuts), list(blocks), pieces, [at] * len(cuts), [at + s for s, _ in cuts]]
            cols = [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))]
            return pa.RecordBatch.from_arrays([*cols, own_ids, lists(np.concatenate(counts), sizes, pa.int32()), pa.array([every[s:e].tobytes() for s, e in cuts], pa.binary())], schema.names)

        return by_chunk(one, limit=BLOCK_BYTES)(batches)

    return mapped(rows, run, schema)


def _histogram(blocks: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs: counted within each task, then summed; `size` numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), np.uint32), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["id", "n"])

    sums = mapped(blocks.select("ids"), run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size, np.int64)
    counts[sums.column("id").to_numpy()] = sums.column("n").to_numpy()
    return counts


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write the ids of all documents (each with end_id at its end) to `path`, in ascending doc_id order.

    Null texts are empty (only the end id); null doc_ids come first; rows with
    the same doc_id are ordered by text; repeated rows are all written; no rows
    give an empty dataset.  Returns path.
    """
    spark = docs.sparkSession
    raw = table_path(spark, "token-ids")
    _tokenised(docs, tokenizer, end_id, id_col, text_col).write.option("compression", "zstd").parquet(raw)
    blocks = spark.read.parquet(raw)
    size = max(_ids(tokenizer).tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
    lengths = huffman.code_lengths(_histogram(blocks, size))
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/codebook")
    # where each part begins: one row per range of documents, as many as shuffle partitions
    bases, at = [], 0
    for part, n in sorted(blocks.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()):
        bases.append((part, at))
        at += n
    base = spark.createDataFrame(bases, "part int, base long")
    placed = blocks.join(F.broadcast(base), "part").select("part", "block", "piece", (F.col("base") + F.col("doc_offset")).alias("doc_start"), (F.col("base") + F.col("offset")).alias("start"), "doc_ids", "n_tokens", "ids")
    schema = T.StructType([f for f in placed.schema if f.name != "ids"]).add("n_ids", "integer").add("checkpoints", "binary").add("bits", "binary")
    told = lengths.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.frombuffer(told, np.uint8)
        codes = huffman.canonical(width)
        for b in batches:
            for i in range(b.num_rows):
                ids = np.frombuffer(b.column(7)[i].as_buffer(), np.uint32)
                bits, marks = huffman.pack(ids, codes, width)
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, 1) for k in range(7)), pa.array([len(ids)], pa.int32()), pa.array([marks.tobytes()], pa.binary()), pa.array([bits], pa.binary())], schema.names)

    mapped(placed, run, schema).write.option("compression", "none").parquet(f"{path}/blocks")
    dropped(spark, raw)
    return path


def _shift(crc: int, n: int) -> int:
    """A CRC-32 after n more zero bytes, without its start and end inversions: a linear map over bits, squared for each binary digit of n."""
    zero = [1 << i for i in range(32)]
    step = [zlib.crc32(b"\0", x ^ 0xFFFFFFFF) ^ 0xFFFFFFFF for x in zero]

    def times(m: list[int], x: int) -> int:
        out = 0
        for i in range(32):
            if x >> i & 1:
                out ^= m[i]
        return out

    while n:
        if n & 1:
            crc = times(step, crc)
        step = [times(step, x) for x in step]
        n >>= 1
    return crc


def joined_crc32(parts: list[tuple[int, int]]) -> int:
    """The CRC-32 of byte strings one after another, from the CRC-32 and length of each."""
    total = 0
    for crc, n in parts:
        total = _shift(total, n) ^ crc
    return total


def _decoded(blocks: DataFrame, told: bytes, digest_only: bool) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, piece, doc_start and, unless digest_only, ids of what the blocks hold."""
    kind = blocks.schema["doc_ids"].dataType.elementType
    schema = T.StructType().add("doc_id", kind).add("start", "long").add("n_tokens", "long").add("ids_crc32", "long").add("piece", "integer").add("doc_start", "long")
    if not digest_only:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = huffman.Reader(np.frombuffer(told, np.uint8))
        for b in batches:
            for i in range(b.num_rows):
                start, n_ids, piece, doc_start = (b.column(k)[i].as_py() for k in (0, 3, 6, 7))
                ids = reader.read(b.column(5)[i].as_py(), n_ids, np.frombuffer(b.column(4)[i].as_buffer(), np.uint32))
                per = b.column(2)[i].values.to_numpy().astype(np.int64)
                ends = np.cumsum(per)
                raw = ids.astype("<u4").tobytes()
                sums = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip((ends - per).tolist(), ends.tolist())]
                cols = [b.column(1)[i].values, pa.array(start + ends - per), pa.array(per), pa.array(sums, pa.int64()), pa.array(np.full(len(per), piece, np.int32)), pa.array(np.full(len(per), doc_start, np.int64))]
                if not digest_only:
                    cols.append(lists(ids.astype(np.int32), per, pa.int32()))
                yield pa.RecordBatch.from_arrays(cols, schema.names)

    return mapped(blocks, run, schema)


def read_ids(spark: SparkSession, path: str, digest_only: bool = False) -> DataFrame:
    """The documents of a written dataset: doc_id, start, n_tokens, ids_crc32 and, unless digest_only, ids (array<int>).

    The pieces of a long document are read apart and put together.
    """
    told = bytes(spark.read.parquet(f"{path}/codebook").first()["lengths"])
    blocks = spark.read.parquet(f"{path}/blocks").select("start", "doc_ids", "n_tokens", "n_ids", "checkpoints", "bits", "piece", "doc_start")
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *([] if digest_only else ["ids"])]
    whole = _decoded(blocks.where("piece < 0"), told, digest_only).select(*names)
    cut = blocks.where("piece >= 0")
    if not cut.limit(1).count():
        return whole
    per = _decoded(cut, told, digest_only).groupBy("doc_start").agg(F.array_sort(F.collect_list(F.struct("piece", *[c for c in names if c != "start"]))).alias("p"))
    crc = F.transform("p", lambda x: F.struct(x["ids_crc32"].alias("crc"), (4 * x["n_tokens"]).alias("n")))
    own = per.select(F.element_at("p", 1)["doc_id"].alias("doc_id"), F.col("doc_start").alias("start"), F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["n_tokens"]).alias("n_tokens"), crc.alias("crc"), *([] if digest_only else [F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids")]))
    schema = T.StructType([T.StructField("ids_crc32", T.LongType()) if f.name == "crc" else f for f in own.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = [joined_crc32([(x["crc"], x["n"]) for x in parts]) for parts in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sums, pa.int64()), *b.columns[4:]], schema.names)

    return whole.unionByName(mapped(own, run, schema))

"""Cross-tokenizer alignment by byte-owner arrays.

Two tokenizers cut the same bytes (a space and the text).  For each, the index
of every token is repeated over the token's bytes: the owner of each byte.
Where the pair of owners changes, an overlapping pair of tokens (a link) begins;
where both owners change at once, both tokenizers end a token there (a cut).

The first pass encodes every text once and writes blocks: for each document its
digests and its links as (slot of an id pair, times), and the block's table of
distinct id pairs with the number of its documents that hold each.  Only these
tables are counted over the corpus and joined back, so a pair that every
document holds costs one row a block, and blocks are bounded by the bytes of
their texts (one text may exceed the bound on its own).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.pretokens import Ids, _byte_of_char
from quillon.llm.textops import by_chunk, lists
from quillon.llm.workdir import Scratch, mapped, table_path

#: Bytes of the texts of a block.
BLOCK_BYTES = 1 << 21
_A = 32  # bits below the A id in a pair


def _tables(spelt: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each id: its bytes, how many, and its decimal digits."""
    n = len(spelt)
    tables = [np.empty(n, object), np.fromiter(map(len, spelt), np.int64, n), np.empty(n, object)]
    tables[0][:] = spelt
    tables[2][:] = [str(i) for i in range(n)]
    return tuple(tables)


class ByteLevel(Ids):
    """Ids of a byte-level tokenizer for a space and each text, special strings as plain text, and the bytes of each id."""

    def __init__(self, path: str):
        super().__init__(path)
        from tokenizers import Tokenizer

        self.tokenizer, self.added = Tokenizer.from_file(path), {}
        self.tokenizer.encode_special_tokens = True
        of = _byte_of_char()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        spelt = [b""] * (max(vocab.values(), default=-1) + 1)
        for token, i in vocab.items():
            spelt[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        self.spelt, self.width, self.named = _tables(spelt)

    def spaced(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.of(pa.array([" " + t for t in texts], pa.string()))


class Pieces:
    """Ids of a piece tokenizer for each text, which it begins with a space of its own, and the bytes of each id."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        spelt = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.model.id_to_piece, range(n)))]
        self.spelt, self.width, self.named = _tables(spelt)

    def spaced(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.model.encode(texts, num_threads=1)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int64, int(counts.sum())), counts


@lru_cache(2)
def _loaded(a: str, b: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(a), Pieces(b)


def _ends(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts)))


def _without(ids: np.ndarray, counts: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return ids[np.repeat(good, counts)], np.where(good, counts, 0)


class Aligned:
    """The alignment of some texts: ids and counts of both tokenizers (none for texts whose bytes either doesn't give back), and where links and groups begin."""

    def __init__(self, texts: list[str], a: ByteLevel, b: Pieces):
        full = [bool(t) for t in texts]
        some = [t for t in texts if t]
        sides = []
        for coder in (a, b):
            ids, per = coder.spaced(some) if some else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            counts = np.zeros(len(texts), np.int64)
            counts[full] = per
            sides.append((ids.astype(np.int64), counts))
        raw = [b"".join(coder.spelt[ids].tolist()) for coder, (ids, _) in zip((a, b), sides)]
        width = [coder.width for coder in (a, b)]
        at = [_ends(w[ids])[_ends(n)].tolist() for w, (ids, n) in zip(width, sides)]
        good = np.zeros(len(texts), bool)
        for i, t in enumerate(texts):
            want = b" " + t.encode()
            good[i] = full[i] and all(r[x[i] : x[i + 1]] == want for r, x in zip(raw, at))
        (self.a, self.n_a), (self.b, self.n_b) = (_without(*s, good) for s in sides)
        owner_a, owner_b = (np.repeat(np.arange(len(ids), dtype=np.int32), w[ids]) for w, ids in zip(width, (self.a, self.b)))
        new_a, new_b = (np.concatenate(([True], o[1:] != o[:-1])) if len(o) else np.zeros(0, bool) for o in (owner_a, owner_b))
        links, cuts = np.flatnonzero(new_a | new_b), np.flatnonzero(new_a & new_b)
        #: indices of the tokens of each link, and of the first tokens of each group
        self.link_a, self.link_b = owner_a[links], owner_b[links]
        self.group_a, self.group_b = owner_a[cuts], owner_b[cuts]
        self.named = a.named, b.named
        self.doc_of_a = np.repeat(np.arange(len(texts)), self.n_a)
        self.n_links = np.bincount(self.doc_of_a[self.link_a], minlength=len(texts))
        self.n_groups = np.bincount(self.doc_of_a[self.group_a], minlength=len(texts))

    def groups(self) -> list[str]:
        """The groups of each text as `a1,a2|b1;a3|b2,b3`: every id with the mark after it, A's before B's in each group."""
        n = np.diff(np.concatenate((self.group_a, [len(self.a)]))), np.diff(np.concatenate((self.group_b, [len(self.b)])))
        start = _ends(n[0] + n[1])[:-1]
        parts = np.empty(2 * (len(self.a) + len(self.b)), object)
        for names, ids, size, first, last in ((self.named[0], self.a, n[0], start, "|"), (self.named[1], self.b, n[1], start + n[0], ";")):
            at = np.arange(len(ids)) + np.repeat(first - _ends(size)[:-1], size)
            parts[2 * at] = names[ids]
            parts[2 * at + 1] = ","
            parts[2 * (first + size - 1) + 1] = last
        ends = (2 * _ends(self.n_a + self.n_b)).tolist()
        return ["".join(parts[i : max(j - 1, i)].tolist()) for i, j in zip(ends, ends[1:])]


def _block(b: pa.RecordBatch, block: int, schema: T.StructType, coders: tuple[ByteLevel, Pieces]) -> pa.RecordBatch:
    x = Aligned([t or "" for t in b.column(1).to_pylist()], *coders)
    n = b.num_rows
    pairs, slot = np.unique(x.a[x.link_a] << _A | x.b[x.link_b], return_inverse=True)
    often = np.argsort(-np.bincount(slot, minlength=len(pairs)), kind="stable")  # frequent pairs get small slots, which pack well
    rank = np.empty(len(pairs), np.int64)
    rank[often] = np.arange(len(pairs))
    held, times = np.unique(x.doc_of_a[x.link_a] * max(len(pairs), 1) + rank[slot], return_counts=True)
    doc, slots = np.divmod(held, max(len(pairs), 1))
    shas = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in x.groups()]
    whole = np.array([n])
    cols = [pa.array([block], pa.int64()), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), b.column(0))]
    cols += [lists(c.astype(np.int64), whole, pa.int64()) for c in (x.n_a, x.n_b, x.n_groups, x.n_links)]
    cols += [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.array(shas, pa.string()))]
    raw = (np.searchsorted(doc, np.arange(n), side="right").astype("<i8"), slots.astype("<u4"), times.astype("<u4"), pairs[often].astype("<i8"), np.bincount(slots, minlength=len(pairs)).astype("<i8"))
    return pa.RecordBatch.from_arrays([*cols, *(pa.array([r.tobytes()], pa.binary()) for r in raw)], schema.names)


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first pass: one row a block of texts (see the module), not yet written."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    long = T.ArrayType(T.LongType())
    schema = T.StructType().add("block", "long").add("doc_ids", T.ArrayType(rows.schema["doc_id"].dataType)).add("n_a", long).add("n_b", long).add("n_groups", long).add("n_links", long).add("groups_sha256", T.ArrayType(T.StringType()))
    for name in ("doc_ends", "slots", "times", "pairs", "n_docs"):
        schema = schema.add(name, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coders, at = _loaded(path_a, path_b), TaskContext.get().partitionId() << 32
        state = {"block": at}

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            state["block"] += 1
            return _block(b, state["block"], schema, coders)

        return by_chunk(one, limit=BLOCK_BYTES)(batches)

    return mapped(rows, run, schema)


def _pairs(blocks: DataFrame) -> DataFrame:
    """block, slot, pair, n of the pair tables of all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, pairs, n in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                pair = np.frombuffer(pairs.as_buffer(), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), block)), pa.array(np.arange(len(pair), dtype=np.int32)), pa.array(pair), pa.array(np.frombuffer(n.as_buffer(), "<i8"))], ["block", "slot", "pair", "n"])

    return mapped(blocks.select("block", "pairs", "n_docs"), run, "block long, slot int, pair long, n long")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, count (documents of the corpus that hold it linked) and best: whether no pair of the same A id is in more."""
    counts = _pairs(blocks).groupBy("pair").agg(F.sum("n").alias("count"))
    counts = counts.withColumn("a", F.shiftrightunsigned("pair", _A))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))  # at most as many rows as A has ids
    return counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs.

    A null or empty text, or one whose bytes either tokenizer doesn't give back,
    has zeros and an empty digest.  A document's links are those of its own row;
    repeated rows each count as a document.
    """
    scratch = Scratch(docs.sparkSession, "alignment")
    path = f"{scratch.path}/blocks"
    first = aligned_blocks(docs, path_a, path_b, id_col, text_col)
    first.write.option("compression", "zstd").parquet(path)
    blocks = docs.sparkSession.read.schema(first.schema).parquet(path)
    totals = scratch.written(pair_counts(blocks), "pairs")
    told = _pairs(blocks).select("block", "slot", "pair").join(totals, "pair").select("block", "slot", "count", "best")
    kind = first.schema["doc_ids"].dataType.elementType
    schema = T.StructType().add("doc_id", kind)
    for name in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"):
        schema = schema.add(name, "long")
    schema = schema.add("groups_sha256", "string")

    def run(own: pa.Table, pairs: pa.Table) -> pa.Table:
        parts = []
        count, best = np.zeros(pairs.num_rows, np.int64), np.zeros(pairs.num_rows, np.int64)
        slot = pairs.column("slot").to_numpy()
        count[slot], best[slot] = pairs.column("count").to_numpy(), pairs.column("best").to_numpy(zero_copy_only=False)
        for r in range(own.num_rows):
            cell = {c: own.column(c)[r] for c in own.column_names}
            ends, slots, times = (np.frombuffer(cell[c].as_buffer(), t) for c, t in (("doc_ends", "<i8"), ("slots", "<u4"), ("times", "<u4")))
            sums = [np.diff(np.concatenate(([0], np.cumsum(times * x[slots])))[np.concatenate(([0], ends))]) for x in (best, count)]
            lists_ = [cell[c].values for c in ("doc_ids", "n_a", "n_b", "n_groups", "n_links")]
            parts.append(pa.RecordBatch.from_arrays([*lists_, *map(pa.array, sums), cell["groups_sha256"].values], schema.names))
        return pa.Table.from_batches(parts) if parts else pa.table({f: [] for f in schema.names})

    out = blocks.drop("pairs", "n_docs").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, schema)
    done = table_path(docs.sparkSession, "alignment-documents")
    out.write.parquet(done)
    scratch.drop()
    return docs.sparkSession.read.schema(schema).parquet(done)

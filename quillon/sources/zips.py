"""ZIP archives of any path that Spark reads, a member to a task, nested ones too.

An archive is a table of byte chunks (`splits.byte_chunks`).  Its directory is
read from the chunks at its end, each chunk is sent to the members it holds bytes
of, and a member is inflated as a stream, chunk after chunk, with its size and
CRC checked at its end.  What comes out are chunks again, so a ZIP inside a ZIP
is opened the same way.  Neither an archive nor a member is ever whole in memory
or on a local disk; a task holds some chunks and one row of a CSV.
"""

from __future__ import annotations

import codecs
import csv
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.sources.splits import CHUNK_BYTES
from quillon.sources.shared import written

# Signatures and layouts of the ZIP format.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
END_SIZE, LOCATOR_SIZE, END64_SIZE, ENTRY_SIZE, LOCAL_SIZE = 22, 20, 56, 46, 30
LONGEST_COMMENT = 65_535
STORED, DEFLATED = 0, 8
#: Bytes of a stretch by which chunks and members meet.
STRETCH = 1 << 20

MEMBER_SCHEMA = "source_path string, member string, number int, method int, encrypted boolean, crc long, packed long, length long, start long, stop long"


class ZipError(ValueError):
    pass


def _joined(rows: pa.Table) -> tuple[int, bytes]:
    """Where the chunks of some rows begin, and their bytes, which must follow one another."""
    order = sorted(zip(rows.column("offset").to_pylist(), rows.column("bytes").to_pylist()))
    return order[0][0], b"".join(part for _, part in order)


def _directory_place(rows: pa.Table) -> tuple[int, int, int]:
    """(offset, bytes, entries) of the directory of an archive, from the chunks at its end."""
    base, tail = _joined(rows)
    at = tail.rfind(END)
    while at >= 0 and (len(tail) < at + END_SIZE or at + END_SIZE + int.from_bytes(tail[at + 20 : at + 22], "little") != len(tail)):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ZipError(f"{rows.column('source_path')[0]} is no ZIP archive")
    n, size, offset = struct.unpack_from("<HII", tail, at + 10)
    if at >= LOCATOR_SIZE and tail[at - LOCATOR_SIZE : at - LOCATOR_SIZE + 4] == LOCATOR64:
        where = int.from_bytes(tail[at - LOCATOR_SIZE + 8 : at - LOCATOR_SIZE + 16], "little") - base
        if not 0 <= where <= len(tail) - END64_SIZE or tail[where : where + 4] != END64:
            raise ZipError(f"{rows.column('source_path')[0]}: its end can't be read")
        n, size, offset = struct.unpack_from("<QQQ", tail, where + 32)
    return offset, size, n


def _entries(path: str, directory: bytes, stop: int) -> list[tuple]:
    """Members in the order of the directory. A member's bytes end where the next one's begin, the last one's at the directory."""
    found, at = [], 0
    while at < len(directory):
        if directory[at : at + 4] != ENTRY or len(directory) < at + ENTRY_SIZE:
            raise ZipError(f"{path}: entry {len(found)} of its directory can't be read")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        crc, packed, length, n, extra, comment = struct.unpack_from("<IIIHHH", directory, at + 16)
        start = int.from_bytes(directory[at + 42 : at + 46], "little")
        name = directory[at + ENTRY_SIZE : at + ENTRY_SIZE + n]
        more = directory[at + ENTRY_SIZE + n : at + ENTRY_SIZE + n + extra]
        while len(more) >= 4:
            kind, size = struct.unpack_from("<HH", more)
            if kind == 1:  # what doesn't fit in 32 bits, in this order
                wide = iter(struct.unpack_from(f"<{size // 8}Q", more, 4))
                length, packed, start = (next(wide) if x == 0xFFFFFFFF else x for x in (length, packed, start))
            more = more[4 + size :]
        found.append((name.decode("utf-8" if flags & 0x800 else "cp437"), method, bool(flags & 1), crc, packed, length, start))
        at += ENTRY_SIZE + n + extra + comment
    starts = sorted({m[-1] for m in found})
    after = dict(zip(starts, [*starts[1:], stop]))
    return [(path, m[0], k, *m[1:], after[m[-1]]) for k, m in enumerate(found)]


def members(chunks: DataFrame) -> DataFrame:
    """source_path, member, number (in the directory), method, encrypted, crc, packed, length, start, stop of every archive.

    chunks: source_path, offset, size, bytes; it is read three times, so it should be a written table.
    A directory (46 bytes and a name a member) is read by one task an archive.
    """
    end = F.col("offset") + F.octet_length("bytes")
    tails = chunks.where(end > F.col("size") - (END_SIZE + LONGEST_COMMENT + LOCATOR_SIZE + END64_SIZE))

    def place(rows: pa.Table) -> pa.Table:
        return pa.table(dict(zip(("source_path", "from", "bytes_", "entries"), ([x] for x in (rows.column("source_path")[0].as_py(), *_directory_place(rows))))))

    places = tails.groupBy("source_path").applyInArrow(place, "source_path string, from long, bytes_ long, entries long")
    own = chunks.join(places, "source_path").where((F.col("offset") < F.col("from") + F.col("bytes_")) & (end > F.col("from")))
    kinds = pa.schema([("source_path", pa.string()), ("member", pa.string()), ("number", pa.int32()), ("method", pa.int32()), ("encrypted", pa.bool_()), ("crc", pa.int64()), ("packed", pa.int64()), ("length", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])

    def read(rows: pa.Table) -> pa.Table:
        base, every = _joined(rows)
        path, start, size, n = (rows.column(c)[0].as_py() for c in ("source_path", "from", "bytes_", "entries"))
        found = _entries(path, every[start - base : start - base + size], start)
        if len(found) != n:
            raise ZipError(f"{path}: {len(found)} entries found, {n} told")
        return pa.table([pa.array(c, t) for c, t in zip(zip(*found), kinds.types)], schema=kinds)

    return own.groupBy("source_path").applyInArrow(read, MEMBER_SCHEMA)


def _dealt(chunks: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """The chunks that hold bytes of each member, in order, a member to a task. Both meet by stretches of the archive, and a pair at its first common stretch only."""
    stretch = lambda a, b: F.sequence(F.floor(a / STRETCH), F.floor((b - 1) / STRETCH))
    end = F.col("offset") + F.octet_length("bytes")
    left = chunks.select("source_path", "offset", "bytes", F.floor(F.col("offset") / STRETCH).alias("c0"), F.explode(stretch(F.col("offset"), end)).alias("stretch"))
    right = found.select(*keys, F.floor(F.col("start") / STRETCH).alias("m0"), F.explode(stretch(F.col("start"), F.col("stop"))).alias("stretch"))
    meet = (F.col("stretch") == F.greatest("c0", "m0")) & (F.col("offset") < F.col("stop")) & (end > F.col("start"))
    pairs = left.join(right, ["source_path", "stretch"]).where(meet).select(*keys, "offset", "bytes")
    return pairs.repartition("source_path", "number").sortWithinPartitions("source_path", "number", "offset")


class _Inflated:
    """The bytes of one member out of its chunks."""

    def __init__(self, told: dict):
        self.told, self.head, self.packed, self.out, self.crc = told, b"", told["packed"], 0, 0
        self.started, self.next = False, None
        if told["encrypted"] or told["method"] not in (STORED, DEFLATED):
            raise ZipError(f"{self.name()}: method {told['method']} isn't supported")
        self.inflate = zlib.decompressobj(-15) if told["method"] == DEFLATED else None

    def name(self) -> str:
        return f"{self.told['source_path']}, {self.told['member']}"

    def feed(self, offset: int, part: bytes, most: int) -> Iterator[bytes]:
        lo = max(self.told["start"] - offset, 0)
        part = part[lo : max(self.told["stop"] - offset, 0)]
        if self.next is not None and self.next != offset + lo:
            raise ZipError(f"{self.name()}: bytes from {self.next} to {offset + lo} are missing")
        self.next = offset + lo + len(part)
        if not self.started:
            self.head += part
            if len(self.head) < LOCAL_SIZE or len(self.head) < (after := LOCAL_SIZE + sum(struct.unpack_from("<HH", self.head, 26))):
                return
            if self.head[:4] != LOCAL:
                raise ZipError(f"{self.name()}: no member where the directory tells one")
            self.started, part, self.head = True, self.head[after:], b""
        part = part[: self.packed]
        self.packed -= len(part)
        try:
            while part:
                got, part = (self.inflate.decompress(part, most), self.inflate.unconsumed_tail) if self.inflate else (part, b"")
                yield from self._count(got)
        except zlib.error as e:
            raise ZipError(f"{self.name()}: {e}") from e

    def _count(self, got: bytes) -> Iterator[bytes]:
        if got:
            self.crc = zlib.crc32(got, self.crc)
            self.out += len(got)
            yield got

    def end(self) -> Iterator[bytes]:
        if self.inflate and self.started:
            yield from self._count(self.inflate.flush())
        if not self.started or self.packed or self.out != self.told["length"] or self.crc != self.told["crc"]:
            raise ZipError(f"{self.name()}: its size or CRC isn't what the directory tells")


_KEYS = ("source_path", "member", "number", "method", "encrypted", "crc", "packed", "length", "start", "stop")


def _streams(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[_Inflated, Iterator[bytes]]]:
    """Each member of a task with the stream of its bytes, which is read before the next is asked for."""
    rows = ((dict(zip(_KEYS, key)), offset, part) for b in batches for *key, offset, part in zip(*(c.to_pylist() for c in b.columns)))
    state = {"row": next(rows, None)}
    while state["row"] is not None:
        one = _Inflated(state["row"][0])

        def stream(one=one) -> Iterator[bytes]:
            while state["row"] is not None and state["row"][0] == one.told:
                _, offset, part = state["row"]
                yield from one.feed(offset, part, most)
                state["row"] = next(rows, None)
            yield from one.end()

        parts = stream()
        yield one, parts
        for _ in parts:
            pass


def member_chunks(chunks: DataFrame, found: DataFrame, most: int = CHUNK_BYTES) -> DataFrame:
    """The bytes of members as chunks: source_path is archive!member, size its length. A member of no bytes has no chunk."""
    schema = pa.schema([("source_path", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, parts in _streams(batches, most):
            at = 0
            for part in parts:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([f"{one.told['source_path']}!{one.told['member']}"], [at], [one.told["length"]], [part]), schema.types)], schema=schema)
                at += len(part)

    return _dealt(chunks, found, *_KEYS).mapInArrow(run, "source_path string, offset long, size long, bytes binary")


_LINE = re.compile(r"[^\r\n]*(?:\r\n|\n|\r(?!\Z))")


def _lines(parts: Iterator[bytes]) -> Iterator[str]:
    """Lines as csv.reader takes them, with their ends, decoded as they come; a byte-order mark is left out."""
    decode, held = codecs.getincrementaldecoder("utf-8-sig")(), ""
    for part in parts:
        held += decode.decode(part)
        at = 0
        for m in _LINE.finditer(held):
            yield m[0]
            at = m.end()
        held = held[at:]
    held += decode.decode(b"", True)
    if held:
        yield held


def member_rows(chunks: DataFrame, found: DataFrame, most: int = CHUNK_BYTES) -> DataFrame:
    """source_path, member, source_row_number (from 1), fields of the rows of members that are CSV in UTF-8."""
    schema = pa.schema([("source_path", pa.string()), ("member", pa.string()), ("source_row_number", pa.int64()), ("fields", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, parts in _streams(batches, most):
            held: list[tuple[int, list[str]]] = []

            def out() -> pa.RecordBatch:
                n = len(held)
                cols = ([one.told["source_path"]] * n, [one.told["member"]] * n, [k for k, _ in held], [f for _, f in held])
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)

            for k, fields in enumerate(csv.reader(_lines(parts)), 1):
                held.append((k, fields))
                if len(held) == 2000:
                    yield out()
                    held = []
            if held:
                yield out()

    return _dealt(chunks, found, *_KEYS).mapInArrow(run, "source_path string, member string, source_row_number long, fields array<string>")


def kept_chunks(chunks: DataFrame) -> DataFrame:
    """chunks as a table of the shared folder; scans of it skip what is outside the offsets they ask for."""
    return written(chunks, "archive-chunks")

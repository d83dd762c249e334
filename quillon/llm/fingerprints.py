"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into dictionary phrases (each the shortest stretch not yet in
the dictionary); the set of phrases is hashed and its SLOTS smallest hashes are
the fingerprint.  Texts that compress each other share phrases, and the overlap
of two fingerprints estimates the overlap of their phrase sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.textops import Chunk
from quillon.llm.workdir import mapped

SLOTS = 128
_FIRST = -(1 << 63)


def phrases(text: str, known: set[str] | None = None) -> set[str]:
    """The dictionary after parsing text; `known` (the dictionary so far) is extended in place. An unfinished last phrase counts as one."""
    seen = set() if known is None else known
    add, w = seen.add, ""
    for c in text:
        w += c
        if w not in seen:
            add(w)
            w = ""
    return seen


def phrases_from(text: str, start: int, seen: set[str], w: str) -> tuple[set[str], str]:
    """Go on parsing at `start` with an unfinished phrase w."""
    add = seen.add
    for c in text[start:] if start else text:
        w += c
        if w not in seen:
            add(w)
            w = ""
    return seen, w


def smallest(found: set[str]) -> np.ndarray:
    """The SLOTS smallest 32-bit hashes of the phrases, ascending."""
    if not found:
        return np.zeros(0, np.uint32)
    raw = [p.encode("utf-8", "surrogatepass") for p in found]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    ends = np.cumsum(size)
    c = Chunk.__new__(Chunk)
    c.buf, c._sums = np.frombuffer(b"".join(raw), np.uint8), None
    h = (c.hash(ends - size, ends) >> np.uint64(32)).astype(np.uint32)
    h = np.unique(h)
    return h[:SLOTS]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated overlap of two phrase sets: of the SLOTS smallest hashes of both together, the share that both have. Two empty texts are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:SLOTS]
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum()) / len(union)


def fingerprint(text: str) -> np.ndarray:
    seen, w = phrases_from(text, 0, set(), "")
    return smallest(seen)


def as_text(f: np.ndarray) -> str:
    return f.astype(">u4").tobytes().hex()


def edited_pair(text: str, after: str) -> tuple[str, np.ndarray, np.ndarray]:
    """The edited text (its last third replaced by the beginning of `after`), and both fingerprints; the part they share is parsed once."""
    n = len(text)
    third = n // 3
    shared, tail = text[: n - third], after[:third]
    seen, w = phrases_from(shared, 0, set(), "")
    own = phrases_from(text[n - third :], 0, set(seen), w)[0] if third else seen
    edit = phrases_from(tail, 0, seen, w)[0] if tail else seen
    a = smallest(own)
    return shared + tail, a, (a if edit is own else smallest(edit))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows dealt so that each document meets the next one (descending id) in one task.

    Ranges of ids get buckets, each a task of its own; the last document of a
    bucket also goes, as a guest, to the bucket that needs it.  One shuffle of the
    texts.  Ids are whole numbers, or texts of them.  Columns:
    bucket, guest, k (the id, null first), doc_id, text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST)).alias("k"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * 2)
    bounds = rows.select(F.percentile_approx("k", [i / n for i in range(1, n)] or [0.5], 100 * n).alias("p")).first()["p"] or []
    bounds = sorted(set(bounds))
    bucket = F.array_size(F.filter(F.array(*[F.lit(x) for x in bounds]).cast("array<long>"), lambda x: x < F.col("k"))) if bounds else F.lit(0)
    rows = rows.withColumn("bucket", bucket.cast("int"))
    tops = [(r.bucket, r.k) for r in rows.groupBy("bucket").agg(F.max("k").alias("k")).orderBy("bucket").collect()]  # a row a bucket
    to = {k: tops[(i + 1) % len(tops)][0] for i, (_, k) in enumerate(tops)}
    guest_of = F.create_map(*[F.lit(x) for kv in to.items() for x in kv]) if to else F.create_map().cast("map<bigint,int>")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest"))
    visit = F.struct(guest_of[F.col("k")].cast("int").alias("bucket"), F.lit(True).alias("guest"))
    places = F.when(F.col("k").isin(list(to)), F.array(own, visit)).otherwise(F.array(own))
    rows = rows.withColumn("_p", F.explode(places)).select(F.col("_p.bucket").alias("bucket"), F.col("_p.guest").alias("guest"), "k", "doc_id", "text")
    return rows.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", F.col("guest").desc(), "k", "text")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document of a row is the one before it in ascending (id, text)
    order, null ids first; after the last comes the first again, so a single
    document is its own next.  A null text is empty; its fingerprint is the empty
    string, and it is like another empty text (1) and unlike any other (0).
    """
    rows = with_next(docs, id_col, text_col)
    schema = T.StructType([rows.schema["doc_id"]]).add("n_chars", "long").add("edited_sha256", "string").add("fingerprint", "string").add("edited_fingerprint", "string").add("near_edited", "double").add("near_next", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, before, before_print = None, "", None
        for b in batches:
            ids: list = []
            out: list[list] = [[] for _ in range(6)]
            size = 0
            for i, (bucket, guest, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(4))):
                text = text.as_py()
                if bucket != at or guest:  # guests come first; the last of them is the neighbour
                    at, before, before_print = bucket, text, None
                    if guest:
                        continue
                if before_print is None:
                    before_print = fingerprint(before)
                edited, own, edit = edited_pair(text, before)
                ids.append(i)
                for col, x in zip(out, (len(text), hashlib.sha256(edited.encode()).hexdigest(), as_text(own), as_text(edit), likeness(own, edit), likeness(own, before_print))):
                    col.append(x)
                before, before_print = text, own
                size += 1
            yield pa.RecordBatch.from_arrays([b.column(3).take(pa.array(ids, pa.int64())), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())))], schema.names)

    return mapped(rows, run, schema)

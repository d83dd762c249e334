"""Near-duplicate detection: consistent weighted sampling over TF-IDF shingles.

1. Document frequencies of all five-word shingles, counted by hash in two rows of
   CELLS counters.  A counter also holds other shingles; their expected number is
   taken off, and of a shingle's two counters the smaller counts.  A shingle's
   weight is its count in the text times 1 + STRENGTH * idf.  The idf goes by the
   share of all texts that hold the shingle, from 0 (all of them) to 1 (a share of
   RARE or less), so it means the same at every size of the input.
2. BANDS * ROWS improved consistent weighted samples a text; two texts agree in
   a sample with a probability equal to their weighted Jaccard similarity.  Each
   ROWS samples form a band; texts that agree in a band share a bucket.
3. Texts with the same words are one content.  In each bucket every content is
   held against the bucket's leader, and every such pair is verified by the exact
   weighted Jaccard similarity.  Links make classes (connected components).  The
   leader is the member that shares its buckets with most others: copies of one
   original are nearest to the one with fewest edits, and that one sits in the
   fullest buckets, so nearly all links of a large group are found here, one pair
   a member.
4. Buckets that still hold several classes go on until every pair of members of
   different classes is verified or ruled out.  With up to SMALL members all such
   pairs are verified.  The members of larger ones meet in an exact prefix filter:
   shingles in one global order, rarest first, two texts of similarity t share one
   before either has too little weight left to reach t.  Texts that only share a
   template differ in more than that, so they meet at no shingle of it.  Members
   take part in turns of growing size (PARTS): what has been linked to a class in
   one turn makes no more pairs with it in the next.
The filter makes pairs only where texts of different classes share a shingle that
early; their number is that of the pairs it can't rule out, and none is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.textops import U64, WORD, Chunk, by_chunk, grams, lists, mix, splitmix
from quillon.llm.workdir import Scratch, mapped, written

SHINGLE = 5
THRESHOLD = 0.8
CELLS = 1 << 17
RARE = 1 / 1024
STRENGTH = 0.25
BANDS, ROWS = 12, 3
SMALL = 8
#: Turns of the prefix filter: the members whose hash lies between two of these are held against all.
PARTS = (0.0, 1 / 32, 1 / 4, 1.0)
#: Relative rounding error allowed for in sums of weights.
SLACK = 1e-9
#: Candidate contents whose keys are broadcast to fetch their texts; beyond it the join is shuffled.
BROADCAST_ROWS = 500_000

_TABLE = 1 << 16


def _uniform(seed: int, n: int) -> np.ndarray:
    return ((splitmix(seed, n) >> U64(11)).astype(np.float64) + 0.5) / float(1 << 53)


#: Tables of random numbers by rule: r ~ Gamma(2, 1), log c with c ~ Gamma(2, 1), beta ~ Uniform(0, 1).
_R = -np.log(_uniform(1, _TABLE) * _uniform(2, _TABLE))
_LOG_C = np.log(-np.log(_uniform(3, _TABLE) * _uniform(4, _TABLE)))
_BETA = _uniform(5, _TABLE)
_MULTIPLIER = splitmix(6, 4096) | U64(1)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(document, hash, count) of the distinct shingles, sorted by document then hash; where each document begins; and a content key a document.

    Words are runs of letters, digits and non-ASCII characters, lower-cased. A
    text of one to four words is one shingle. Texts with the same words in order
    have the same key; texts without words, if they are equal byte by byte.
    """
    chunk = Chunk(pc.utf8_lower(pc.fill_null(texts, "")))
    starts, ends = chunk.segments(WORD)
    h, doc = chunk.hash(starts, ends), chunk.doc_of(starts)
    n = np.bincount(doc, minlength=chunk.n)
    g = grams(h, SHINGLE)
    whole = np.flatnonzero(doc[: len(g)] == doc[SHINGLE - 1 :]) if len(g) else np.zeros(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    first = np.cumsum(n) - n
    # an order-dependent sum of all words: the content key, and the only shingle of a short text
    rank = (np.arange(len(h)) - first[doc]).astype(U64)
    keys = []
    for seed in (U64(0x51ED27), U64(0xA5A5A5)):
        s = np.concatenate((np.zeros(1, U64), np.cumsum(mix(h ^ mix(rank * U64(2) + seed)))))
        keys.append(mix((s[first + n] - s[first]) + n.astype(U64)))
    blank = np.flatnonzero(n == 0)
    for k, seed in enumerate((1, 2)):
        if len(blank):
            keys[k][blank] = mix(chunk.hash(chunk.offsets[blank], chunk.offsets[blank + 1]) + U64(seed))
    key = np.stack(keys, axis=1).astype(">u8").tobytes()
    d = np.concatenate((doc[whole], short))
    v = np.concatenate((g[whole], keys[0][short]))
    order = np.lexsort((v, d))
    d, v = d[order], v[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(d)))
    d, v = d[at], v[at]
    begin = np.searchsorted(d, np.arange(chunk.n + 1))
    return d, v, count, begin, [key[16 * i : 16 * i + 16] for i in range(chunk.n)]


@dataclass(frozen=True)
class Weights:
    """Log weights log(1 + STRENGTH * idf) of the counters, two rows of CELLS (float32)."""

    raw: bytes

    def log(self, v: np.ndarray) -> np.ndarray:
        """The log weight of each shingle."""
        table = np.frombuffer(self.raw, np.float32).reshape(2, CELLS)
        a, b = _cells(v)
        return np.maximum(table[0, a], table[1, b]).astype(np.float64)


def _cells(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (v % U64(CELLS)).astype(np.int64), ((v >> U64(32)) % U64(CELLS)).astype(np.int64)


def document_frequencies(rows: DataFrame) -> Weights:
    """The weights of the shingles of all rows (text). 2 * CELLS numbers reach the driver, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * CELLS + 1, np.int64)

        def one(b: pa.RecordBatch) -> None:
            _, v, _, _, _ = shingles(b.column(0))
            for k, cell in enumerate(_cells(v)):
                total[k * CELLS : (k + 1) * CELLS] += np.bincount(cell, minlength=CELLS)
            total[2 * CELLS] += b.num_rows

        for _ in by_chunk(one)(batches):
            pass
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["cell", "n"])

    sums = mapped(rows.select("text"), run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(2 * CELLS + 1, np.float64)
    df[sums.column(0).to_numpy()] = sums.column(1).to_numpy()
    n = max(df[2 * CELLS], 1)
    df = df[: 2 * CELLS].reshape(2, CELLS)
    others = (df.sum(axis=1, keepdims=True) - df) / (CELLS - 1)
    share = np.clip((df - others) / n, 1 / n, 1)
    return Weights(np.log1p(STRENGTH * np.clip(np.log(share) / np.log(RARE), 0, 1)).astype(np.float32).tobytes())


def samples(v: np.ndarray, log_w: np.ndarray, begin: np.ndarray, k: int) -> np.ndarray:
    """The k-th consistent weighted sample of each document that has shingles (begin: where they start, none empty)."""
    x = v * _MULTIPLIER[2 * k] + _MULTIPLIER[2 * k + 1]
    r = _R[x >> U64(48)]
    beta = _BETA[(x >> U64(32)) & U64(0xFFFF)]
    t = np.floor(log_w / r + beta)
    log_a = _LOG_C[(x >> U64(16)) & U64(0xFFFF)] - r * (t - beta + 1.0)
    least = np.minimum.reduceat(log_a, begin[:-1])
    at = np.flatnonzero(log_a == np.repeat(least, np.diff(begin)))
    at = at[np.searchsorted(at, begin[:-1])]
    return mix(v[at] + t[at].astype(np.int64).astype(U64) * U64(0x9E3779B97F4A7C15))


def signatures(rows: DataFrame, weights: Weights) -> DataFrame:
    """Per row (doc_id, th, text): doc_id, th, content, bands (BANDS bucket numbers; none for a text without words)."""
    schema = T.StructType([rows.schema["doc_id"], rows.schema["th"]]).add("content", "binary").add("bands", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            d, v, count, begin, keys = shingles(b.column(2))
            n = np.diff(begin)
            has = np.flatnonzero(n)
            bands = np.zeros((len(has), BANDS), U64)
            if len(has):
                log_w = np.log(count) + weights.log(v)
                own = np.append(begin[has], begin[-1])
                for band in range(BANDS):
                    acc = np.full(len(has), U64(band + 1))
                    for row in range(ROWS):
                        acc = mix(acc * U64(0xD1342543DE82EF95) + samples(v, log_w, own, band * ROWS + row))
                    bands[:, band] = acc
            return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.binary()), lists(bands.reshape(-1).astype(np.int64), np.where(n > 0, BANDS, 0), pa.int64())], schema.names)

        return by_chunk(one)(batches)

    return mapped(rows, run, schema)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the smaller over the sum of the larger weights; (sorted hashes, weights) each."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    hit = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    low = np.minimum(a[1][hit], b[1][at[hit]]).sum()
    return float(low / (a[1].sum() + b[1].sum() - low)) if len(a[0]) or len(b[0]) else 0.0


def verified(pairs: DataFrame, texts: DataFrame, weights: Weights) -> DataFrame:
    """pairs (a, b) with the similarity of their contents. texts: content, text."""
    rows = pairs.join(texts.select(F.col("content").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("content").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        held = 0

        def of(key: bytes, text: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
            nonlocal held
            if key not in known:
                _, v, count, _, _ = shingles(pa.array([text.as_py()], pa.string()))
                if held + len(v) > 2_000_000:  # bounded memory
                    known.clear()
                    held = 0
                known[key] = v, count * np.exp(weights.log(v))
                held += len(v)
            return known[key]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sims = [weighted_jaccard(of(x, batch.column(2)[i]), of(y, batch.column(3)[i])) for i, (x, y) in enumerate(zip(a, b))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64())], ["a", "b", "sim"])

    return mapped(rows, run, "a binary, b binary, sim double")


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """node, label (the smallest node of its component) for all nodes of the edges (a, b).

    Each round a node takes the smallest label around it and then that label's
    own label; rounds are written out, so no plan grows and a lost executor
    costs one round.
    """
    both = scratch.written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges")
    labels = scratch.written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        stepped = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = scratch.written(stepped.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), f"{name}-{turn}")
        if not new.where("label <> old").limit(1).count():
            return new.select("node", "label")
        labels = new.select("node", "label")


def _buckets(contents: DataFrame, scratch: Scratch) -> DataFrame:
    """bucket, content, leader of the buckets with several members; the leader is the one whose buckets hold most members together."""
    members = contents.select("content", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    shared = scratch.written(members.join(sizes, "bucket"), "buckets")
    ranked = shared.join(shared.groupBy("content").agg(F.sum("m").alias("rank")), "content")
    leaders = ranked.groupBy("bucket").agg(F.max(F.struct("rank", "content"))["content"].alias("leader"))
    return shared.join(leaders, "bucket").select("bucket", "content", "leader")


def _held(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """groups (bucket, content) with each content's label and m, the members of its bucket; only buckets with several classes."""
    rows = _labelled(groups.select("bucket", "content"), labels)
    several = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket", "m")
    return rows.join(several, "bucket")


def _small_pairs(held: DataFrame) -> DataFrame:
    """In buckets of up to SMALL members: all pairs of members of different classes."""
    few = held.where(F.col("m") <= SMALL)
    other = few.select("bucket", F.col("content").alias("other"), F.col("label").alias("other_label"))
    return few.join(other, "bucket").where("content < other and label <> other_label").select(F.col("content").alias("a"), F.col("other").alias("b"))


def prefixes(texts: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """Per row (content, text): content, k (shingle), total (weight of the text), rest (weight from k on), for the shingles at which a text of similarity threshold can be met first.

    The order is by weight (rarest first), then hash: the same for all texts.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            d, v, count, begin, _ = shingles(b.column(1))
            log_w = weights.log(v)
            w = count * np.exp(log_w)
            order = np.lexsort((v, -log_w, d))  # documents stay where they are
            d, v, w = d[order], v[order], w[order]
            until = np.concatenate((np.zeros(1), np.cumsum(w)))
            total = (until[begin[1:]] - until[begin[:-1]])[d]
            rest = until[begin[1:]][d] - until[:-1]
            at = np.flatnonzero(rest >= threshold * total * (1 - SLACK))
            return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(d[at])), pa.array(v[at].view(np.int64)), pa.array(total[at]), pa.array(rest[at])], ["content", "k", "total", "rest"])

        return by_chunk(one)(batches)

    return mapped(texts.select("content", "text"), run, "content binary, k long, total double, rest double")


def _shared(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows (see prefixes, with label) at the shingles that several classes have, with aside: whether its class is not the shingle's largest."""
    most = rows.groupBy("k", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("k").agg(F.max(F.struct("n", "label"))["label"].alias("most"), F.count(F.lit(1)).alias("q")).where("q > 1")
    return scratch.written(rows.join(most, "k").select("content", "k", "total", "rest", (F.col("label") != F.col("most")).alias("aside")), "shared")


def _wide_pairs(shared: DataFrame, labels: DataFrame, threshold: float, low: float, high: float) -> DataFrame:
    """Pairs of contents that are now of different classes, without those the prefix filter rules out, of which one has its place (by hash) in [low, high).

    Two rows of different classes are not both of a shingle's largest class, so
    the others are held against all: as much work as there are such pairs.
    """
    rows = _labelled(shared, labels)
    x = rows.where("aside").select("k", *[F.col(c).alias(f"x_{c}") for c in ("content", "label", "total", "rest")])
    place = F.pmod(F.xxhash64("content"), F.lit(1 << 20)) / float(1 << 20)
    rows = rows.where((place >= low) & (place < high))
    enough = F.least("rest", "x_rest") >= threshold / (1 + threshold) * (1 - SLACK) * (F.col("total") + F.col("x_total"))
    return rows.join(x, "k").where((F.col("label") != F.col("x_label")) & enough).select(*_order("content", "x_content")).distinct()


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows (content) with label: a content without links is its own class."""
    return rows.join(labels.withColumnRenamed("node", "content"), "content", "left").withColumn("label", F.coalesce("label", "content"))


def _order(*cols: str | Column) -> tuple[Column, Column]:
    return F.least(*cols).alias("a"), F.greatest(*cols).alias("b")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs: doc_id, th (hash of the text), class_id (smallest doc_id of its class), class_size (rows), first (the one row value (doc_id, th) that stands for the class).

    A null text is empty; texts without words are alike only if equal; repeated
    rows are one class; null ids come first; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.col(text_col).alias("text"))
    weights = document_frequencies(rows)
    signed = written(signatures(rows, weights), "neardup-signatures")
    contents = scratch.written(signed.groupBy("content").agg(F.min(F.struct("doc_id", "th")).alias("first"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands")), "contents")
    inside = scratch.written(_buckets(contents, scratch), "led")
    pairs = scratch.written(inside.where("content <> leader").select(*_order("content", "leader")).distinct(), "pairs")
    # the texts of all contents that share a bucket
    wanted = scratch.written(contents.join(inside.select("content").distinct(), "content", "left_semi").select("content", F.col("first.doc_id").alias("w_id"), F.col("first.th").alias("w_th")), "wanted")
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    texts = rows.join(F.broadcast(wanted) if few else wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("th") == F.col("w_th"))).groupBy("content").agg(F.first("text").alias("text"))
    texts = scratch.written(texts, "texts")
    tested, turn = scratch.written(verified(pairs, texts, weights), "tested"), 0

    def judged(more: DataFrame) -> DataFrame:
        nonlocal tested, turn
        turn += 1
        more = scratch.written(more.join(tested.select("a", "b"), ["a", "b"], "left_anti"), f"more{turn}")
        tested = scratch.written(tested.union(verified(more, texts, weights)), f"tested{turn}")
        return components(tested.where(F.col("sim") >= threshold), scratch, f"classes{turn}")

    labels = components(tested.where(F.col("sim") >= threshold), scratch, "classes")
    # buckets that hold several classes: every pair of different classes is verified or ruled out
    held = scratch.written(_held(inside, labels), "held")
    wide = held.where(F.col("m") > SMALL).select("content", "label").distinct()
    shared = _shared(prefixes(texts.join(wide.select("content"), "content", "left_semi"), weights, threshold).join(wide, "content"), scratch)
    for low, high in zip(PARTS, PARTS[1:]):
        more = _wide_pairs(shared, labels, threshold, low, high)
        labels = judged(more if low else more.union(_small_pairs(held)).distinct())
    known = _labelled(contents.select("content", "first", "n"), labels)
    per = known.groupBy("label").agg(F.min("first").alias("first"), F.sum("n").alias("class_size"))
    known = written(known.select("content", "label").join(per, "label").select("content", "first", "class_size").where("class_size > 1"), "neardup-known")
    scratch.drop()
    own = F.struct("doc_id", "th")
    out = signed.select("doc_id", "th", "content").join(known, "content", "left").withColumn("first", F.coalesce("first", own))
    return out.select("doc_id", "th", F.col("first.doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), "first")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs with one of each class (the smallest id; of repeated rows one)."""
    firsts = written(classes(docs, id_col, text_col, threshold).select(F.col("first.doc_id").alias("id"), F.col("first.th").alias("th")).distinct(), "neardup-firsts")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("own_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("own_th"))
    stay = rows.join(firsts, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_th") == F.col("th")), "left_semi")
    return stay.dropDuplicates(["own_id", "own_th"]).select("row.*")

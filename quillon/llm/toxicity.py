"""Toxicity: cumulative-link ordinal regression over sparse text features.

P(grade > k) = sigmoid(w . x - theta_k): one weight a feature for all ordered
thresholds theta_0 < theta_1 < ...  The features are the distinct words of a text
and their beginnings of 4, 5 and 6 bytes, hashed.  The expected severity is the
sum of P(grade > k) over the thresholds.  The model is fitted on the driver from
a bounded sample of labelled rows (SAMPLE a class); scoring covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.quality import parting
from quillon.llm.textops import U64, WORD, Chunk, by_chunk, lists, mix
from quillon.llm.workdir import mapped

FEATURES = 1 << 18
PREFIXES = (4, 5, 6)
#: At most this many labelled documents of each label are fitted on.
SAMPLE = 3_000
RIDGE = 0.0005
STEPS = 300
#: A feature takes part if its log odds ratio between the labels is this many standard errors from none.
TELLING = 3.0


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) pairs, distinct, sorted by document."""
    chunk = Chunk(pc.utf8_lower(pc.fill_null(texts, "")))
    starts, ends = chunk.segments(WORD)
    doc = chunk.doc_of(starts)
    h = [chunk.hash(starts, ends)]
    docs = [doc]
    for k in PREFIXES:
        long = np.flatnonzero(ends - starts > k)
        h.append(mix(chunk.hash(starts[long], starts[long] + k) ^ U64(k)))
        docs.append(doc[long])
    cell = np.unique(np.concatenate(docs) * FEATURES + (np.concatenate(h) % U64(FEATURES)).astype(np.int64))
    return cell // FEATURES, cell % FEATURES


@dataclass(frozen=True)
class Ordinal:
    weights: bytes  # float32, one a feature
    thresholds: tuple[float, ...]
    cut: float  # scores above it are flagged: the best parting of the fitted rows

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) by row and threshold."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - np.array(self.thresholds), -40, 40)))


def telling(row: np.ndarray, feature: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Which features differ clearly between the labels, one boolean a feature."""
    with_1 = np.bincount(feature[positive[row]], minlength=FEATURES) + 0.5
    with_0 = np.bincount(feature[~positive[row]], minlength=FEATURES) + 0.5
    n1, n0 = positive.sum() + 1.0, (~positive).sum() + 1.0
    odds = np.log(with_1 / np.maximum(n1 - with_1, 0.5)) - np.log(with_0 / np.maximum(n0 - with_0, 0.5))
    error = np.sqrt(1 / with_1 + 1 / with_0 + 1 / np.maximum(n1 - with_1, 0.5) + 1 / np.maximum(n0 - with_0, 0.5))
    return (np.abs(odds) > TELLING * error) & (with_1 + with_0 >= 4)


def fit_ordinal(row: np.ndarray, feature: np.ndarray, grade: np.ndarray, weight: np.ndarray, grades: int) -> Ordinal:
    """Penalised maximum likelihood by Adam; deterministic. Thresholds are kept ordered by positive steps between them."""
    n = len(grade)
    keep = telling(row, feature, grade > 0)[feature]
    row = row[keep]
    seen, at = np.unique(feature[keep], return_inverse=True)
    w, cut = np.zeros(len(seen)), np.zeros(grades - 1)
    for k in range(grades - 1):
        p = np.clip((weight * (grade > k)).sum() / weight.sum(), 1e-4, 1 - 1e-4)
        cut[k] = -np.log(p / (1 - p))
    theta = np.concatenate((cut[:1], np.log(np.maximum(np.diff(cut), 0.1))))
    weight = weight / weight.sum()
    m, v = np.zeros(len(w) + len(theta)), np.zeros(len(w) + len(theta))
    for step in range(1, STEPS + 1):
        cuts = np.concatenate((theta[:1], theta[0] + np.cumsum(np.exp(theta[1:]))))
        score = np.bincount(row, w[at], minlength=n)
        upper = 1 / (1 + np.exp(-np.clip(score[:, None] - cuts, -30, 30)))  # P(grade > k)
        edge = np.concatenate((np.ones((n, 1)), upper, np.zeros((n, 1))), axis=1)
        each = np.arange(n)
        hi, lo = edge[each, grade], edge[each, grade + 1]
        p = np.maximum(hi - lo, 1e-9)
        slope = edge * (1 - edge)
        d_hi, d_lo = slope[each, grade] / p, slope[each, grade + 1] / p
        g_score = -weight * (d_hi - d_lo)
        g_cut = np.zeros(grades + 1)
        np.add.at(g_cut, grade, weight * d_hi)
        np.add.at(g_cut, grade + 1, -weight * d_lo)
        g_cut = g_cut[1:-1]
        g_w = np.bincount(at, g_score[row], minlength=len(w)) + RIDGE * w
        g_theta = np.concatenate(([g_cut.sum()], [g_cut[k:].sum() * np.exp(theta[k]) for k in range(1, len(theta))]))
        g = np.concatenate((g_w, g_theta))
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        change = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w -= change[: len(w)]
        theta -= change[len(w) :]
    full = np.zeros(FEATURES, np.float32)
    full[seen] = w
    score = np.bincount(row, w[at], minlength=n)
    cuts = np.concatenate((theta[:1], theta[0] + np.cumsum(np.exp(theta[1:]))))
    cut = parting(score[grade > 0], score[grade == 0], (grade > 0).sum() / max((grade == 0).sum(), 1))  # an error of either kind counts one
    return Ordinal(full.tobytes(), tuple(float(x) for x in cuts), cut if np.isfinite(cut) else float(cuts[0]))


def _evidence_grades(row: np.ndarray, feature: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Grades 0, 1, 2 where labels are only 0 and 1: a toxic document is graded 2 if it has more distinct features that speak for the label (four times as frequent there, in 5 documents or more) than the middle toxic document."""
    pos = np.bincount(feature[toxic[row] == 1], minlength=FEATURES)
    neg = np.bincount(feature[toxic[row] == 0], minlength=FEATURES)
    n1, n0 = max((toxic == 1).sum(), 1), max((toxic == 0).sum(), 1)
    tell = (pos >= 5) & ((pos + 0.5) / n1 >= 4 * (neg + 0.5) / n0)
    hits = np.bincount(row[tell[feature]], minlength=len(toxic))
    middle = np.median(hits[toxic == 1]) if (toxic == 1).any() else 0
    return np.where(toxic == 1, 1 + (hits > middle), 0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Ordinal | None:
    """The model, or None if the labels don't hold both classes. labels: doc_id, toxic (0/1)."""
    own = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    order = F.xxhash64("doc_id")
    sample = own.where("_toxic = 1").orderBy(order).limit(SAMPLE).unionByName(own.where("_toxic = 0").orderBy(order).limit(SAMPLE))
    totals = {r["_toxic"]: r["n"] for r in own.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return None
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(sample.withColumnRenamed("doc_id", "_s")), F.col("_id") == F.col("_s")).groupBy("_id", "_toxic").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            d, f = features(b.column(2))
            return pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1).cast(pa.int32()), lists(f.astype(np.int32), np.bincount(d, minlength=b.num_rows), pa.int32())], ["id", "toxic", "f"])

        return by_chunk(one)(batches)

    got = mapped(rows, run, "id string, toxic int, f array<int>").toArrow().combine_chunks().sort_by([("id", "ascending")])
    if not got.num_rows:
        return None
    f = got.column("f").combine_chunks()
    f = f if isinstance(f, pa.ListArray) else f.chunk(0)
    per = pc.list_value_length(f).to_numpy(zero_copy_only=False).astype(np.int64)
    feature = pc.list_flatten(f).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(per)), per)
    toxic = got.column("toxic").to_numpy().astype(np.int64)
    grade = _evidence_grades(row, feature, toxic)
    share = np.array([totals.get(0, 0), totals.get(1, 0)], float)
    weight = share[toxic] / np.maximum(np.bincount(toxic, minlength=2), 1)[toxic]
    return fit_ordinal(row, feature, grade, weight, 3)


def severity(docs: DataFrame, model: Ordinal | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, p_toxic (grade above 0), expected_severity (0 to 2), severity (the likeliest grade), toxic (the score is above the cut that parts the fitted rows best).

    Null and empty texts have no features and get the model's base rate; without
    a model (labels of one class only) every row has severity 0.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("p_toxic"), F.lit(0.0).alias("expected_severity"), F.lit(0).alias("severity"), F.lit(False).alias("toxic"))
    schema = T.StructType([rows.schema["doc_id"]]).add("p_toxic", "double").add("expected_severity", "double").add("severity", "integer").add("toxic", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(model.weights, np.float32).astype(np.float64)

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            d, f = features(b.column(1))
            score = np.bincount(d, w[f], minlength=b.num_rows)
            up = model.probabilities(score)
            n = b.num_rows
            each = np.concatenate((np.ones((n, 1)), up), axis=1) - np.concatenate((up, np.zeros((n, 1))), axis=1)
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(up[:, 0]), pa.array(up.sum(axis=1)), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(score > model.cut)], schema.names)

        return by_chunk(one)(batches)

    return mapped(rows, run, schema)

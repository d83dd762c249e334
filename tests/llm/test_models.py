"""Near duplicates, quality, toxicity: brute force, held-out accuracy, odd rows; then the pipeline."""

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import neardup, quality, toxicity
from quillon.llm.workdir import Scratch


def brute_classes(texts: list[str], weight: np.ndarray) -> list[int]:
    d, v, c, begin, keys = neardup.shingles(pa.array(texts, pa.string()))
    w = c * np.exp(weight.log(v))
    rows = [(v[begin[i] : begin[i + 1]], w[begin[i] : begin[i + 1]]) for i in range(len(texts))]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i, (h, _) in enumerate(rows):
        for x in h.tolist():
            holders[x].append(i)
    pairs = {(l[0] if k == 0 else l[k - 1], x) for l in holders.values() for k, x in enumerate(l[1:], 1)} | {(a, b) for l in holders.values() if len(l) < 60 for k, a in enumerate(l) for b in l[k + 1 :]}
    for a, b in pairs:
        if neardup.weighted_jaccard(rows[a], rows[b]) >= 0.8:
            root[max(find(a), find(b))] = min(find(a), find(b))
    first = {}
    for i, k in enumerate(keys):
        j = first.setdefault(k, i)
        root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def test_classes_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    odd = [(10_000, None), (10_001, ""), (10_002, "!!"), (10_003, "one two"), (10_004, "One  two."), (10_005, "three")]
    docs = docs.unionByName(spark.createDataFrame([(i, t, "x") for i, t in odd], docs.schema)).unionByName(docs.limit(1))
    rows = docs.orderBy("doc_id").collect()
    weight = neardup.document_frequencies(docs)
    want = brute_classes([r.text or "" for r in rows], weight)
    got = neardup.classes(docs).collect()
    assert len(got) == len(rows)
    of = {r.doc_id: r.class_id for r in got}
    assert {r.doc_id: rows[w].doc_id for r, w in zip(rows, want)} == of
    assert of[10_003] == of[10_004] and of[10_000] == of[10_001] != of[10_002]
    stay = neardup.deduplicated(docs)
    assert stay.columns == docs.columns
    assert sorted(r.doc_id for r in stay.collect()) == sorted(set(of.values()))


def test_samples_agree_as_often_as_the_weighted_jaccard():
    rnd = np.random.default_rng(1)
    v = np.sort(rnd.integers(1, 1 << 63, 400).astype(np.uint64))
    wa, wb = rnd.uniform(0.5, 3, 400), rnd.uniform(0.5, 3, 400)
    true = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    one = np.array([0, 400])
    same = np.mean([neardup.samples(v, np.log(wa), one, k)[0] == neardup.samples(v, np.log(wb), one, k)[0] for k in range(1000)])
    assert abs(same - true) < 0.05


def test_a_large_group_of_copies_is_one_class(spark):
    base = [f"word{i}" for i in range(200)]
    rows = [(i, " ".join(base[:40] + [f"own{i}"] + base[41:])) for i in range(300)] + [(1000 + i, " ".join(base)) for i in range(300)] + [(5000, "something else entirely made of other words")]
    out = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in out if r.doc_id < 5000} == {0}
    assert {r.class_size for r in out if r.doc_id < 5000} == {600}


def all_pairs_classes(texts: list[str], weight: np.ndarray) -> list[int]:
    """Classes by every pair of texts, in rows of a dense matrix; no pair is left out."""
    d, v, c, begin, _ = neardup.shingles(pa.array(texts, pa.string()))
    w = c * np.exp(weight.log(v))
    names, col = np.unique(v, return_inverse=True)
    dense = np.zeros((len(texts), len(names)))
    dense[d, col] = w
    total = dense.sum(axis=1)
    root = np.arange(len(texts))
    for i in range(len(texts)):
        low = np.minimum(dense[i], dense[i + 1 :]).sum(axis=1)
        for j in np.flatnonzero(low >= 0.8 * (total[i] + total[i + 1 :] - low)) + i + 1:
            root[root == max(root[i], root[j])] = min(root[i], root[j])
    return root.tolist()


def template_group(n: int, own: int, extra: int, seed: int) -> list[str]:
    """n texts that share a passage, each with own words; from every tenth an edited copy with extra other words."""
    rnd = np.random.default_rng(seed)
    passage = [f"shared{i}" for i in range(160)]
    out = []
    for i in range(n):
        words = [f"w{x}" for x in rnd.integers(0, 1 << 40, own)]
        out.append(" ".join(passage + words))
        if i % 10 == 0:
            out.append(" ".join(passage + words[: own - extra] + [f"w{x}" for x in rnd.integers(0, 1 << 40, extra)]))
    return out


@pytest.mark.parametrize("own, extra", [(36, 15), (40, 18)])
def test_planted_pairs_in_a_large_group_of_alike_texts(spark, own, extra):
    texts = template_group(400, own, extra, own)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = all_pairs_classes(texts, neardup.document_frequencies(docs))
    assert len(set(want)) < len(texts) - 30  # the planted pairs, and the group is not one class
    assert len(set(want)) > 100
    got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_small_buckets_verify_members_that_are_no_heads(spark):
    held = spark.createDataFrame([(1, b"a", b"a", 4), (1, b"b", b"a", 4), (1, b"c", b"c", 4), (1, b"d", b"c", 4)], "bucket long, content binary, label binary, m long")
    pairs = {(bytes(r.a), bytes(r.b)) for r in neardup._small_pairs(held).collect()}
    assert pairs == {(b"a", b"c"), (b"a", b"d"), (b"b", b"c"), (b"b", b"d")}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(40)] + [(b"\xf0", b"\xf1")], "a binary, b binary")
    out = {bytes(r.node): bytes(r.label) for r in neardup.components(edges, Scratch(spark, "components")).collect()}
    assert {out[bytes([i])] for i in range(41)} == {b"\x00"} and out[b"\xf1"] == b"\xf0"


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert neardup.classes(none).count() == 0
    assert quality.classified(none, labels)[0].count() == 0
    assert toxicity.severity(none, toxicity.fit(none, labels)).count() == 0


def test_quality_keeps_the_good_and_rejects_the_bad(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where("doc_id % 2 = 1")
    out = quality.classified(docs, labels.where("doc_id % 2 = 0"))[0].join(held, "doc_id").toPandas()
    assert out[out.quality == 1].kept.mean() > 0.97
    assert out[out.quality == 0].kept.mean() < 0.2
    kept = quality.kept(docs, labels)
    assert kept.columns == docs.columns


def test_quality_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "word"), (3, "word"), (None, "x")]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, log_weight double")
    labels = spark.createDataFrame([(3, 1)], "doc_id long, quality int")
    out, _ = quality.classified(docs, labels)
    assert out.count() == 5 and out.where("kept").count() == 5
    assert quality.kept(docs, labels).columns == docs.columns


@pytest.mark.parametrize("k", [1, 10, 500, 999, 1000])
def test_kth_largest(spark, k):
    df = spark.range(1000).selectExpr("cast(sqrt(id) * 3 - 20 as double) as x")
    cut = quality.kth_largest(df, "x", k)
    assert df.where(f"x >= {cut!r}").count() == k


def test_gumbel_top_k_draws_by_weight(spark):
    from pyspark.sql import functions as F

    df = spark.range(20000).withColumn("w", F.when(F.col("id") % 2 == 0, F.log(F.lit(3.0))).otherwise(0.0)).withColumn("key", F.col("w") + quality.gumbel(F.col("id")))
    top = df.where(F.col("key") >= quality.kth_largest(df, "key", 1000))
    share = top.where("id % 2 = 0").count() / 1000
    assert abs(share - 0.75) < 0.06


def test_ordinal_model_orders_grades_and_holds_out():
    rnd = np.random.default_rng(0)
    n, grade = 1500, rnd.integers(0, 3, 1500)
    row, feature = [], []
    for i in range(n):
        f = set(rnd.integers(100, 2000, 30).tolist()) | ({1} if grade[i] >= 1 and rnd.random() < 0.9 else set()) | ({2} if grade[i] == 2 and rnd.random() < 0.9 else set())
        row += [i] * len(f)
        feature += sorted(f)
    row, feature = np.array(row), np.array(feature)
    half = row < 1000
    m = toxicity.fit_ordinal(row[half], feature[half], grade[:1000], np.ones(1000), 3)
    assert m.thresholds[0] < m.thresholds[1]
    w = np.frombuffer(m.weights, np.float32)
    expected = m.probabilities(np.bincount(row, w[feature], minlength=n)).sum(axis=1)[1000:]
    g = grade[1000:]
    assert expected[g == 0].mean() < expected[g == 1].mean() < expected[g == 2].mean()
    assert ((expected > 0.5) == (g > 0)).mean() > 0.85


def test_toxicity_held_out(spark):
    from pathlib import Path

    sf = "/root/testdata/sf0.01"
    if not Path(sf).exists():
        pytest.skip("no test tables here")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels.where("doc_id % 4 > 0"))
    held = labels.where("doc_id % 4 = 0").withColumnRenamed("toxic", "truth").select("doc_id", "truth")
    out = toxicity.severity(docs, model).join(held, "doc_id").toPandas()
    assert (out[out.truth == 0].toxic).mean() < 0.05
    assert out[out.truth == 1].expected_severity.mean() > 3 * out[out.truth == 0].expected_severity.mean()


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (2, "", 1), (3, "fine", 1)], "doc_id long, text string, toxic int")
    one = spark.createDataFrame([(3, 0)], "doc_id long, toxic int")
    assert toxicity.severity(docs, toxicity.fit(docs, one)).where("severity = 0 and not toxic").count() == 4


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns
        path = f"{c.table_path(spark, 'test')}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "mixing sources":
            assert 0 < docs.count() <= before
            before = docs.count()
    out = c.STAGES[-1][1](spark, docs, sf_dir)
    assert out.count() == docs.count()

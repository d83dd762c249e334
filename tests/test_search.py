"""The seeded search against the same rule, one attempt at a time."""

import hashlib
from collections import Counter

import pytest

from quillon.operators import search

ROWS = [(i, "abc"[i % 3], "xyzw"[(i * 7) % 4], [f"p{i % 11}", f"q{i % 5}"] if i % 6 else []) for i in range(120)]
DEMANDS = search.Demands({"a": 4, "b": 3, "c": 3}, {"x": 3, "y": 3, "z": 2, "w": 2}, tuple([f"p{i}" for i in range(11)] + [f"q{i}" for i in range(5)]))


def plain(rows, demands, seed, attempts):
    best = None
    for attempt in range(attempts):
        picked = []
        for stratum, quota in demands.quotas.items():
            own = sorted((hashlib.sha256(f"{seed + attempt}:{r[0]}".encode()).hexdigest(), r[0], r) for r in rows if r[1] == stratum)
            picked += [r for _, _, r in own[:quota]]
        counts, features = Counter(r[2] for r in picked), {f for r in picked for f in r[3]}
        imbalance, missing = sum(abs(counts[c] - n) for c, n in demands.targets.items()), len(set(demands.covered) - features)
        told = (imbalance + 100 * missing, sorted(r[0] for r in picked), attempt, imbalance, missing)
        if best is None or told[:2] < best[:2]:
            best = told
            if told[0] == 0:
                break
    return best[2], best[0], best[3], best[4], best[1]


@pytest.fixture(scope="module")
def candidates(spark):
    return spark.createDataFrame(ROWS, "id int, stratum string, class string, features array<string>")


@pytest.mark.parametrize("covered, attempts, wave", [(DEMANDS.covered, 2000, 700), (("p1", "q1"), 300, 16), ((), 600, 60)])
def test_best_attempt(candidates, covered, attempts, wave):
    demands = search.Demands(DEMANDS.quotas, DEMANDS.targets, covered)
    got = search.stratified_search(candidates, demands, 42, attempts, wave).collect()
    assert [tuple(r) for r in got] == [plain(ROWS, demands, 42, attempts)]
    assert len(got[0].selected) == 10 and (covered or got[0].score == 0)


def test_what_cannot_be_met(candidates, spark):
    demands = search.Demands({"a": 2}, {"x": 2}, ("nowhere",))
    assert search.stratified_search(candidates, demands, 1, 20).first().missing == 1
    with pytest.raises(ValueError, match="demands"):
        search.stratified_search(candidates, demands, 1, 20, whole=True)
    assert search.stratified_search(candidates.limit(0), demands, 1, 5).count() == 0
    with pytest.raises(ValueError):
        search.stratified_search(candidates, demands, 1, 0)


def test_large_strata_are_not_sorted_whole(spark, monkeypatch):
    rows = [(i, "abc"[i % 3], "xyzw"[(i * 7) % 4], [f"p{i % 11}"]) for i in range(3000)]
    demands = search.Demands({"a": 4, "b": 3, "c": 3}, {"x": 3, "y": 3, "z": 2, "w": 2})
    df = spark.createDataFrame(rows, "id int, stratum string, class string, features array<string>")
    sorted_rows = []
    first = search._first
    monkeypatch.setattr(search, "_first", lambda near, d: sorted_rows.append(near.count()) or first(near, d))
    got = search.stratified_search(df, demands, 5, 40, 40).collect()
    assert [tuple(r) for r in got] == [plain(rows, demands, 5, 40)]
    assert sum(sorted_rows) < 40 * 3000 / 10
    # attempts whose near rows are too few draw from all
    monkeypatch.setattr(search, "_limit", lambda quota, size: "004")
    assert [tuple(r) for r in search.stratified_search(df, demands, 5, 40, 40).collect()] == [plain(rows, demands, 5, 40)]

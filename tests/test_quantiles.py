"""Quantiles by selection against numpy, over groups that many rounds must refine."""

import random

import numpy as np
import pytest

from quillon.operators import metrics, quantiles

SHARES = [0.0, 0.1, 0.25, 0.5, 0.9, 0.95, 0.999, 1.0]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    groups = {
        "normal": [r.gauss(0, 1) for _ in range(3000)],
        "heavy": [r.choice([-1, 1]) * 10 ** r.uniform(-300, 300) for _ in range(800)],
        "ties": [r.choice([1.0, 1.0, 1.0, 2.0, 5.5]) for _ in range(2000)],
        "one": [7.25],
        "two": [1.0, 4.0],
        "wide": [-1.7e308, 1.7e308, *range(500)],
        "close": [1.0 + i * 2.0**-52 for i in range(900)],
        None: [float(i) for i in range(50)],
    }
    return groups, [(g, float(x)) for g, v in groups.items() for x in v] + [("normal", None), ("normal", float("nan")), ("empty", None)]


def test_quantiles_equal_numpy(spark, rows):
    groups, flat = rows
    df = spark.createDataFrame(flat, "share string, x double")  # the group has a name of the result's own
    got = {(r.g, r.share): (r.value, r.n) for r in quantiles.quantiles(df.withColumnRenamed("share", "g"), "x", SHARES, "g", few=100, bins=64).collect()}
    assert set(got) == {(g, s) for g in groups for s in SHARES}
    for (g, s), (value, n) in got.items():
        assert n == len(groups[g])
        v = sorted(groups[g])
        k = s * (n - 1)
        low, high = v[int(np.floor(k))], v[min(int(np.floor(k)) + 1, n - 1)]
        assert value == (low if k == int(k) else low + (high - low) * (k - np.floor(k))), (g, s)
        if g not in ("heavy", "wide"):
            assert value == pytest.approx(np.quantile(groups[g], s), rel=1e-12)


def test_whole_table_and_no_rows(spark):
    df = spark.range(1001).selectExpr("cast(id as double) x")
    got = [(r.share, r.value) for r in metrics.quantiles(df, "x", [0.5, 0.999]).orderBy("share").collect()]
    assert got == [(0.5, 500.0), (0.999, 999.0)]
    assert metrics.quantiles(df.limit(0), "x", [0.5]).count() == 0


def test_no_percentile_in_the_plan(spark):
    df = spark.range(100).selectExpr("id % 3 g", "cast(id as double) x")
    for out in (metrics.latency_summary(df, "x", "g"), metrics.quantiles(df, "x", [0.5])):
        assert "percentile" not in out._jdf.queryExecution().toString().lower()
    r = {x.g: x for x in metrics.latency_summary(df, "x", "g").collect()}
    assert r[0].median_value == 49.5 and r[0].p95_value == pytest.approx(np.quantile(np.arange(0, 100, 3), 0.95)) and r[1].total_value == sum(range(1, 100, 3))

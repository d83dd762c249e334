import pytest

from quillon.operators import agreement, metrics


def pairs(spark, a, b):
    return spark.createDataFrame(list(zip(a, b)), "a string, b string")


@pytest.mark.parametrize("a, b, kappa", [("aabb", "abab", 0.0), ("aabb", "aabb", 1.0), ("aaaa", "aaaa", None)])
def test_kappa(spark, a, b, kappa):
    assert agreement.cohen_kappa(pairs(spark, a, b), "a", "b").first().kappa == kappa


def test_quadratic_kappa(spark):
    assert agreement.quadratic_kappa(pairs(spark, "123", "321"), "a", "b", ["1", "2", "3"]).first().qwk == -1.0
    assert agreement.quadratic_kappa(pairs(spark, "123", "123"), "a", "b", ["1", "2", "3"]).first().qwk == 1.0
    assert agreement.quadratic_kappa(pairs(spark, "111", "111"), "a", "b", ["1", "2", "3"]).first().qwk is None


def test_alignment(spark):
    l = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert agreement.aligned(l, l, "k").count() == 2
    for r in (l.where("k = 1"), l.union(l)):
        with pytest.raises(ValueError):
            agreement.aligned(l, r, "k")


def test_gate(spark):
    m = spark.createDataFrame([("a", "kappa", 0.7, 9), ("b", "kappa", None, 9), ("c", "exact", 0.79, 9), ("d", "kappa", 1.0, 4)], "name string, kind string, value double, n long")
    assert {r.name: r.status for r in agreement.quality_gate(m).collect()} == {"a": "passed", "b": "failed", "c": "failed", "d": "insufficient"}


def test_third_rater(spark):
    df = spark.createDataFrame([("a", "a", "a"), ("a", "a", "b"), ("a", "b", "a"), ("a", "b", "b"), ("a", "b", "c")], "l string, r string, t string")
    x = agreement.third_rater(df, "l", "r", "t").first()
    assert (x.n, x.n_agree, x.third_with_both, x.third_against_both, x.third_with_left, x.third_with_right, x.third_with_neither) == (5, 2, 1, 1, 1, 1, 1)


def test_jaccard_of_empty_sets(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([], []), (["a"], []), (["a", "b"], ["b"])], "x array<string>, y array<string>")
    assert [r[0] for r in df.select(agreement.jaccard(F.col("x"), F.col("y"))).collect()] == [1.0, 0.0, 0.5]


def test_perfect_predictions(spark):
    df = spark.createDataFrame([("t1", "f1", "a", "a", True), ("t1", "f2", "b", "b", True), ("t2", "f1", "a", "a", True)], "k string, field string, y string, p string, same boolean")
    assert tuple(metrics.accuracy_report(df, "k", "same").first()) == (1.0, 1.0)
    assert metrics.macro_f1(df, "y", "p").first().macro_f1 == 1.0 and metrics.micro_f1(df, "y", "p").first().micro_f1 == 1.0
    c = spark.createDataFrame([(1.0, 1.0)] * 3, "c double, o double")
    assert tuple(metrics.calibration(c, "c", "o").first()) == (3, 0.0, 0.0)
    lat = spark.createDataFrame([(1.0,), (4.0,)], "ms double")
    assert metrics.latency_summary(lat, "ms").first().mean_value == 2.5


def test_a_confidence_of_six_tenths_is_in_no_bin(spark):
    df = spark.createDataFrame([(0.6, 0.0), (0.3, 0.0), (0.7, 0.0)], "c double, o double")
    assert metrics.calibration(df, "c", "o").first().ece == pytest.approx((0.3 + 0.7) / 3, abs=1e-6)


def test_binary_scores_without_positives(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(False, True), (False, False)], "t boolean, p boolean")
    assert tuple(df.agg(*metrics.binary_scores(F.col("t"), F.col("p"))).first()) == (0, None, None, None)


def test_grounding_without_evidence(spark):
    df = spark.createDataFrame([([], "text")], "e array<string>, t string")
    assert tuple(metrics.grounding(df, "e", "t").first()) == (0, 1.0)


def test_labels_outside_an_ordinal_scale_raise(spark):
    df = spark.createDataFrame([("low", "high"), ("low", "odd")], "a string, b string")
    with pytest.raises(Exception, match="outside the ordinal scale: odd"):
        agreement.quadratic_kappa(df, "a", "b", ["low", "high"]).collect()
    with pytest.raises(ValueError):
        agreement.quadratic_kappa(df, "a", "b", ["low", "low"])

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import splits


def cuts(sizes, ratio=splits.RATIO):
    """The rule, one group at a time."""
    n, total, cum = len(sizes), sum(sizes), np.cumsum(sizes)
    first = min(range(1, n - 1), key=lambda i: (abs(cum[i - 1] - ratio[0] * total), i))
    second = min(range(first + 1, n), key=lambda j: (abs(cum[j - 1] - (ratio[0] + ratio[1]) * total), j))
    return ["train"] * first + ["validation"] * (second - first) + ["test"] * (n - second)


@pytest.mark.parametrize("sizes", [[1, 1, 1], [100, 1, 1], [1, 1, 100], [3, 5, 2, 8, 1, 9, 4, 7], [1] * 37])
def test_cuts(spark, sizes):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "k int, n long")
    assert [r.split for r in splits.weighted_cuts(df, "k").orderBy("k").collect()] == cuts(sizes)


def test_two_groups_cannot_be_split(spark):
    df = spark.createDataFrame([(1, 5), (2, 5)], "k int, n long")
    assert {r.split for r in splits.weighted_cuts(df, "k").collect()} == {None}


def test_equal_times_stay_together_and_order_is_irrelevant(spark):
    rows = [(i, float(i // 3), f"g{i % 7}") for i in range(60)]
    a = splits.chronological_split(spark.createDataFrame(rows, "id int, t double, g string"), "t")
    b = splits.chronological_split(spark.createDataFrame(rows[::-1], "id int, t double, g string"), "t")
    of = {r.id: r.split for r in a.collect()}
    assert of == {r.id: r.split for r in b.collect()}
    assert all(of[i] == of[i // 3 * 3] for i in of)
    issues = {r.rule: r.n for r in splits.audit_split(a, "id", "id", time="t").collect()}
    assert not any(issues.values())
    splits.assert_no_leakage(splits.audit_split(a, "id", "id", time="t"))


def test_groups_are_disjoint_and_leaks_are_found(spark):
    df = spark.createDataFrame([(i, f"g{i % 9}", f"h{i}") for i in range(90)], "id int, g string, h string")
    out = splits.group_holdout_split(df, "g", 3)
    assert splits.leaks(out, "g").count() == 0 and out.select("split").distinct().count() == 3
    broken = out.withColumn("split", F.when(F.col("id") == 0, "test").when(F.col("id") == 9, "train").otherwise(F.col("split"))).withColumn("h", F.when(F.col("id") < 10, "same").otherwise(F.col("h")))
    issues = {r.rule: r.n for r in splits.audit_split(broken, "id", "h", group="g").collect()}
    assert issues["group_in_two_splits"] == 1 and issues["content_in_two_splits"] == 1
    with pytest.raises(ValueError):
        splits.assert_no_leakage(splits.audit_split(broken, "id", "h", group="g"))


def test_scaler(spark):
    df = spark.createDataFrame([("train", 0.0, 0.1), ("train", 2.0, 0.1), ("validation", 100.0, 0.1), ("validation", 102.0, 5.1)], "split string, x double, c double")
    stats = splits.fit_scaler(df, ["x", "c"])
    z = splits.apply_scaler(df, stats, ["x", "c"]).where("split = 'validation'").orderBy("x").collect()
    assert [r.x_z for r in z] == [99.0, 101.0] and [r.c_z for r in z] == pytest.approx([0.0, 5.0])
    told = splits.scaler_to_dict(stats, ["x", "c"])
    assert splits.scaler_to_dict(splits.scaler_from_dict(spark, told), ["x", "c"]) == told
    for bad in ({"scale": [0.0, 1.0]}, {"columns": ["x", "x"]}, {"mean": [1.0]}, {"fitted_on": "test"}):
        with pytest.raises(ValueError):
            splits.scaler_from_dict(spark, told | bad)


def test_presentation_order_and_subset(spark):
    df = spark.range(50)
    order = [r.presentation_order for r in splits.presentation_order(df, "id", "s").collect()]
    assert sorted(order) == list(range(1, 51))
    assert [r.id for r in splits.ordered_subset(df, "id", [7, 3, 40]).collect()] == [7, 3, 40]
    for ids in ([1, 1], [1, 99]):
        with pytest.raises(ValueError):
            splits.ordered_subset(df, "id", ids)


@pytest.mark.parametrize("rows", [1_000_000])
def test_orders_of_many_rows_are_whole(spark, rows):
    """More rows than a sampled range partitioning sees, and only some columns read: the order is still 1..n."""
    df = spark.range(rows).withColumn("extra", F.rand(1))
    got = splits.presentation_order(df, "id", "s").select("presentation_order").agg(F.count_distinct("presentation_order").alias("d"), F.min("presentation_order").alias("a"), F.max("presentation_order").alias("b")).first()
    assert (got.d, got.a, got.b) == (rows, 1, rows)
    groups = splits.group_holdout_groups(df, "id", 7)
    n = groups.agg(F.count_distinct("idx").alias("d"), F.max("idx").alias("b"), F.count_if(F.col("split") == "train").alias("t"), F.count_if(F.col("split") == "validation").alias("v")).first()
    assert (n.d, n.b, n.t, n.v) == (rows, rows, 700_000, 150_000)


def test_running_sums_by_time_equal_brute_force(spark):
    from quillon.operators import ordered

    rows = [((i * 7919) % 5003, 1 + i % 5) for i in range(5003)]
    df = spark.createDataFrame(rows, "t long, n long").select(F.timestamp_seconds("t").alias("t"), "n")
    got = {r.x: (r.idx, r.cum) for r in ordered.running(df, F.col("t"), F.col("n")).select(F.unix_seconds("row.t").alias("x"), "idx", "cum").collect()}
    want, cum = {}, 0
    for i, (t, n) in enumerate(sorted(rows), 1):
        cum += n
        want[t] = (i, cum)
    assert got == want


def test_ranges_of_texts_with_a_common_prefix(spark):
    from quillon.operators import ordered

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small parts stay apart
    df = spark.range(20_000).select(F.concat(F.lit("2024-01-01T00:00:"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("t"))
    assert ordered.dealt(df, F.col("t")).groupBy("part").count().where("count < 15000").count() > 1
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


NAMES = ["total", "n", "cum", "idx", "split", "row", "part", "o0", "_p", "_o", "n_rows", "k", "presentation_order", "s", "i", "t", "v", "found"]


def test_names_of_the_caller_stay(spark):
    rows = [(i, float(i), *[f"{c}{i}" for c in NAMES]) for i in range(30)]
    df = spark.createDataFrame(rows, ", ".join(["id long", "time double", *[f"{c} string" for c in NAMES]]))

    def same(out, but=()):
        got = {r["id"]: r for r in out.collect()}
        assert len(got) == len(out.collect())
        for r in rows:
            for c, v in zip(df.columns, r):
                assert r[0] not in got or c in but or got[r[0]][c] == v
        return got

    assert sorted(r.presentation_order for r in same(splits.presentation_order(df, "id", 1), ["presentation_order"]).values()) == list(range(1, 31))
    for out in (splits.chronological_split(df, "time"), splits.group_holdout_split(df, "n", 5), splits.group_holdout_split(df, "split", 5)):
        assert {r.split for r in same(out, ["split"]).values()} == {"train", "validation", "test"}
    assert len(same(splits.stratified_quota(df.withColumn("even", F.col("id") % 2), "even", "id", 4, 1))) == 8
    with pytest.raises(ValueError, match="rename"):
        splits.chronological_groups(df, "n")


def test_rows_without_a_time_are_unassigned(spark):
    df = spark.createDataFrame([(i, None if i == 5 else float(i)) for i in range(20)], "id int, t double")
    out = splits.chronological_split(df, "t")
    assert out.count() == 20 and [r.id for r in out.where("split is null").collect()] == [5]
    assert {r.rule: r.n for r in splits.audit_split(out, "id", "id", time="t").collect()}["unassigned_sample"] == 1


def test_audit_equals_brute_force(spark):
    import random

    r = random.Random(8)
    rows = [(r.choice([None, *range(150)]), f"h{r.randrange(120)}", f"g{r.randrange(300)}", r.choice(["train", "train", "validation", "test", "holdout", None]), float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, h string, g string, split string, t double")
    plan = splits.audit_split(df, "id", "h", "g", "t")
    got = {x.rule: x.n for x in plan.collect()}

    def two(k):
        of = {}
        for row in rows:
            of.setdefault(row[k], set()).add(row[3])
        return sum(len(v - {None}) > 1 for v in of.values())

    ids = {row[0] for row in rows} - {None}
    assert got == {"duplicate_sample_id": 200 - len(ids), "unassigned_sample": sum(row[3] is None for row in rows), "missing_split": 0, "content_in_two_splits": two(1), "group_in_two_splits": two(2), "times_overlap": 1}
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 5


def test_plans_that_cannot_be_repeated_are_refused():
    splits.check_plan("chronological")
    splits.check_plan("group_holdout", "device_id", 3)
    for bad in (("group_holdout",), ("group_holdout", "device_id"), ("group_holdout", None, 3), ("group_holdout", "x", -1), ("chronological", "x"), ("random",), ("chronological", None, None, (0.5, 0.5, 0.5)), ("chronological", None, None, (1.0, 0.0, 0.0))):
        with pytest.raises(ValueError):
            splits.check_plan(*bad)


def test_earlier_rows_of_a_key_that_holds_a_third(spark):
    from quillon.operators import corpus, ordered, sim

    n = 9000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, 0).otherwise(1 + F.col("id") % 50).alias("e"), F.col("id").alias("step"), F.when(F.col("id") % 7 != 0, F.concat(F.lit("a"), F.col("id"))).alias("action"), "id")
    df = df.unionByName(spark.createDataFrame([(None, i, f"n{i}", n + i) for i in range(5)], df.schema))
    from pyspark.sql import Window

    want = df.withColumn("w", F.lag("action").over(Window.partitionBy("e").orderBy("step"))).select("id", "w")
    got = corpus.previous_action(df, "e", "step", "action")
    assert got.count() == n + 5 and got.join(want, "id").where(~F.col("w").eqNullSafe(F.col("previous_action"))).count() == 0
    sizes = [r["count"] for r in ordered.dealt(df, F.col("e"), F.col("step")).groupBy("part").count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < n / 3 + 5 and len(sizes) > 2
    # arrivals one apart but for some that are moved
    events = df.where("e is not null").withColumn("arrival_s", F.row_number().over(Window.partitionBy("e").orderBy("step")) + F.when(F.col("id") % 1000 == 500, 0.5).otherwise(0.0)).withColumn("next_interarrival_s", F.lit(1.0))
    issues = sim.timeline_issues(events, "e").collect()
    assert {x.key for x in issues} == {f"{r.e}:{r.step}" for r in events.where("id % 1000 = 500").collect()} and len(issues) == 9

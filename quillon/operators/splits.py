"""Chronological and group-holdout splits, audits of splits, quotas, train-only scaling.

The order-dependent part runs on one row per time or group, in ranges of the
order (`ordered.running`), so no single task holds all groups.  Columns of the
caller never meet names of ours: rows travel as a struct or keep their own table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators import ordered
from quillon.sources.shared import written

RATIO = (0.7, 0.15, 0.15)
SPLITS = ("train", "validation", "test")


def check_plan(strategy: str, group_field: str | None = None, seed: int | None = None, ratio: tuple[float, float, float] = RATIO) -> None:
    """Raises unless a plan of splits can be made and repeated: a group split names its field and a seed, a chronological one neither."""
    if strategy not in ("chronological", "group_holdout"):
        raise ValueError(f"unknown strategy {strategy}")
    if strategy == "group_holdout" and (not group_field or seed is None):
        raise ValueError("a group split needs a field and a seed")
    if strategy == "chronological" and (group_field or seed is not None):
        raise ValueError("a chronological split has no group and no seed")
    if isinstance(seed, int) and seed < 0:
        raise ValueError("the seed must not be negative")
    if len(ratio) != 3 or min(ratio) <= 0 or abs(sum(ratio) - 1) > 1e-9:
        raise ValueError("three positive shares that sum to 1 are needed")


def _labelled(groups: DataFrame, order: Column, n: Column, ratio: tuple[float, float, float]) -> DataFrame:
    """row, idx, cum, split of the groups along the order."""
    run = written(ordered.running(groups, order, n), "running")
    train, both = ratio[0], ratio[0] + ratio[1]
    first = run.where("idx < n_rows - 1").agg(F.min_by("idx", F.struct(F.abs(F.col("cum") - train * F.col("total")), "idx")).alias("cut1"))
    second = run.crossJoin(first).where("idx > cut1 and idx < n_rows").agg(F.min_by("idx", F.struct(F.abs(F.col("cum") - both * F.col("total")), "idx")).alias("cut2"))
    cuts = first.crossJoin(second)  # one row
    split = F.when(F.col("cut2").isNull(), None).when(F.col("idx") <= F.col("cut1"), "train").when(F.col("idx") <= F.col("cut2"), "validation").otherwise("test")
    return run.crossJoin(cuts).select("row", "idx", "cum", split.alias("split"))


def weighted_cuts(groups: DataFrame, order: str, ratio: tuple[float, float, float] = RATIO) -> DataFrame:
    """groups with idx, cum, split: the cuts are those whose running share is nearest to the ratio (the earlier of two), each part keeping one group at least.

    groups: order (distinct values), n.  Fewer than three groups can't be split: all get a null split.
    """
    return _labelled(groups, F.col(order), F.col("n"), ratio).select("row.*", "idx", "cum", "split")


def _named(name: str) -> str:
    if name.lower() in ("n", "idx", "cum", "split", "order_key"):
        raise ValueError(f"a column {name} can't be told from the result's own; rename it")
    return name


def _groups(df: DataFrame, key: str, order: Column, ratio: tuple[float, float, float]) -> DataFrame:
    """k (the values of key, without null), n, idx, cum, split; order is a function of k."""
    groups = df.select(F.col(f"`{key}`").alias("k")).where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return _labelled(groups, order, F.col("n"), ratio).select("row.k", "row.n", "idx", "cum", "split")


def _assigned(df: DataFrame, key: str, groups: DataFrame) -> DataFrame:
    """df with the split of each row's group as `split` (in place of a column of that name); a null key has none."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{key}`").alias("k"))
    return rows.join(groups.select("k", "split"), "k", "left").select(*[F.col("row")[c].alias(c) for c in df.columns if c != "split"], "split")


def chronological_groups(df: DataFrame, time: str, ratio: tuple[float, float, float] = RATIO) -> DataFrame:
    """One row per distinct time with its n, idx, cum and split; equal times stay together."""
    return _groups(df, time, F.col("k"), ratio).withColumnRenamed("k", _named(time))


def chronological_split(df: DataFrame, time: str, ratio: tuple[float, float, float] = RATIO) -> DataFrame:
    check_plan("chronological", ratio=ratio)
    return _assigned(df, time, _groups(df, time, F.col("k"), ratio))


def group_order(field: str, seed: int | str, value: Column | None = None) -> Column:
    """The seeded order of groups: SHA-256 of seed, field and value."""
    value = F.col(field) if value is None else value
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(field), value.cast("string")).cast("binary"), 256)


def group_holdout_groups(df: DataFrame, field: str, seed: int | str, ratio: tuple[float, float, float] = RATIO) -> DataFrame:
    order = group_order(field, seed, F.col("k"))
    return _groups(df, field, order, ratio).withColumn("order_key", order).withColumnRenamed("k", _named(field))


def group_holdout_split(df: DataFrame, field: str, seed: int | str, ratio: tuple[float, float, float] = RATIO) -> DataFrame:
    check_plan("group_holdout", field, seed, ratio)
    return _assigned(df, field, _groups(df, field, group_order(field, seed, F.col("k")), ratio))


def leaks(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys in more than one split: key, n_splits, n_rows."""
    return df.groupBy(key).agg(F.count_distinct(split).alias("n_splits"), F.count(F.lit(1)).alias("n_rows")).where("n_splits > 1")


def split_bounds(df: DataFrame, time: str, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n_rows"), F.min(time).alias("first_ts"), F.max(time).alias("last_ts"))


def audit_split(df: DataFrame, sample_id: str, content_hash: str, group: str | None = None, time: str | None = None, split: str = "split") -> DataFrame:
    """Issues: rule, n. All zero means the split is clean.

    One pass: each row is counted under its sample, its content and its group at
    once, a row a key, and those are summed up.
    """
    s = F.col(f"`{split}`")
    keys = {"sample": sample_id, "content": content_hash} | ({"group": group} if group else {})
    told = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(f"`{c}`").cast("string").alias("key")) for kind, c in keys.items()])
    rows = df.select(F.explode(told).alias("k"), s.alias("s"), *([F.col(f"`{time}`").alias("t")] if time else []))
    sample = F.col("k.kind") == "sample"
    flags = [F.max((F.col("s") == x).cast("int")).alias(f"in_{x}") for x in SPLITS] + [F.max((~F.col("s").isin(*SPLITS)).cast("int")).alias("in_other")]
    bounds = [f(F.when(sample & (F.col("s") == x), F.col("t"))).alias(f"{n}_{x}") for x in SPLITS for n, f in (("lo", F.min), ("hi", F.max))] if time else []
    per = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("s").isNull()).alias("n_null"), *flags, *bounds)
    several = sum((F.coalesce(F.col(f"in_{x}"), F.lit(0)) for x in (*SPLITS, "other")), F.lit(0)) > 1
    of = lambda kind: F.col("k.kind") == kind
    present = sum((F.coalesce(F.max(f"in_{x}"), F.lit(0)) for x in SPLITS), F.lit(0))
    rules = {
        "duplicate_sample_id": F.coalesce(F.sum(F.when(of("sample"), F.col("n") - F.col("k.key").isNotNull().cast("int"))), F.lit(0)),
        "unassigned_sample": F.coalesce(F.sum(F.when(of("sample"), F.col("n_null"))), F.lit(0)),
        "missing_split": 3 - present,
        "content_in_two_splits": F.count_if(of("content") & several),
    }
    if group:
        rules["group_in_two_splits"] = F.count_if(of("group") & several)
    if time:
        edge = {f"{n}_{x}": f(f"{n}_{x}") for x in SPLITS for n, f in (("lo", F.min), ("hi", F.max))}
        apart = (edge["hi_train"] < edge["lo_validation"]) & (edge["hi_validation"] < edge["lo_test"])
        rules["times_overlap"] = F.coalesce(~apart, F.lit(True))
    one = per.agg(*[n.cast("long").alias(rule) for rule, n in rules.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(rule).alias("n")) for rule in rules])))


def assert_no_leakage(issues: DataFrame) -> None:
    bad = issues.where("n > 0").limit(20).collect()
    if bad:
        raise ValueError("the split isn't clean: " + ", ".join(f"{r.rule}={r.n}" for r in bad))


def presentation_order(df: DataFrame, id_col: str, seed: int | str) -> DataFrame:
    """df with presentation_order 1..n (in place of a column of that name) in the seeded hash order of the ids."""
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(f"`{id_col}`").cast("string")).cast("binary"), 256)
    run = ordered.running(df, order, F.lit(1))
    return run.select(*[F.col("row")[c].alias(c) for c in df.columns if c != "presentation_order"], F.col("idx").alias("presentation_order"))


def stratified_quota(df: DataFrame, stratum: str, id_col: str, quota: int, seed: int | str) -> DataFrame:
    """The first `quota` rows of each stratum in the seeded order, equal ids in no certain order. A quota is the feature; strata are combined before they are ranked."""
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(f"`{id_col}`").cast("string")).cast("binary"), 256)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{stratum}`").alias("s"), order.alias("o"), F.col(f"`{id_col}`").alias("i"))
    w = Window.partitionBy("s").orderBy("o", "i")
    return rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= quota).select("row.*")


def coverage_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """side, n: keys that only one side has. Both zero: the sets are equal."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").agg(F.lit("left_only").alias("side"), F.count(F.lit(1)).alias("n")).unionByName(b.join(a, key, "left_anti").agg(F.lit("right_only").alias("side"), F.count(F.lit(1)).alias("n")))


def ordered_subset(df: DataFrame, key: str, ids: list) -> DataFrame:
    """The rows of an explicit list of ids, in its order; a missing or repeated id raises."""
    if len(set(ids)) != len(ids):
        raise ValueError("an id is listed twice")
    spark = df.sparkSession
    wanted = spark.createDataFrame([(x, i) for i, x in enumerate(ids)], df.select(key).schema.add("_pos", "integer"))
    out = df.join(wanted, key)
    n = out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("d")).first()
    if n.n != len(ids) or n.d != len(ids):
        raise ValueError("ids are missing or not unique in the table")
    return out.orderBy("_pos").drop("_pos")


# --- scaling ---------------------------------------------------------------


def fit_scaler(df: DataFrame, columns: list[str], split: str = "split") -> DataFrame:
    """One row: mean and scale (population standard deviation, 1 for a constant column) of each column over the training rows.

    A constant column is one whose smallest and largest values are equal; this
    doesn't depend on rounding in the deviation.
    """
    train = df.where(F.col(split) == "train")
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"{c}__mean"), F.when(F.min(x) == F.max(x), 1.0).otherwise(F.stddev_pop(x)).alias(f"{c}__scale")]
    return train.agg(*aggs)


def apply_scaler(df: DataFrame, stats: DataFrame, columns: list[str], suffix: str = "_z") -> DataFrame:
    """df with (x - mean) / scale; stats is the one row of fit_scaler."""
    out = df.crossJoin(F.broadcast(stats.limit(1)))
    return out.select(*df.columns, *[((F.col(c) - F.col(f"{c}__mean")) / F.col(f"{c}__scale")).alias(c + suffix) for c in columns])


def scaler_to_dict(stats: DataFrame, columns: list[str]) -> dict:
    r = stats.first()
    return {"fitted_on": "train", "columns": columns, "mean": [r[f"{c}__mean"] for c in columns], "scale": [r[f"{c}__scale"] for c in columns]}


def scaler_from_dict(spark, told: dict) -> DataFrame:
    import math

    names, mean, scale = told["columns"], told["mean"], told["scale"]
    if told.get("fitted_on") != "train":
        raise ValueError("statistics must come from the training split")
    if len(set(names)) != len(names) or not len(names) == len(mean) == len(scale):
        raise ValueError("names must be unique and lengths equal")
    if not all(isinstance(x, (int, float)) and math.isfinite(x) for x in [*mean, *scale]) or min(scale, default=1) <= 0:
        raise ValueError("statistics must be finite, scales positive")
    flat = {k: float(v) for c, m, s in zip(names, mean, scale) for k, v in ((f"{c}__mean", m), (f"{c}__scale", s))}
    return spark.createDataFrame([tuple(flat.values())], ", ".join(f"`{k}` double" for k in flat))

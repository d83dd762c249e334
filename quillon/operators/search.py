"""Seeded stratified search: many random draws by quota, scored side by side, the best one kept.

An attempt draws each stratum's quota in an order of its own, the SHA-256 of
seed, attempt and id, so any attempt can be drawn again on its own and in any
order of rows.  Attempts are rows: a wave of them is drawn, scored and compared
in one job, and the search ends with the wave in which a draw meets all demands.
Of each stratum only the rows with the first digests are kept before anything is
sorted or shuffled, so a wave sorts a few times what it draws, not what it draws
from; an attempt that these don't serve is drawn from all rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.sources.shared import written

MISSING_WEIGHT = 100


@dataclass(frozen=True)
class Demands:
    """quotas: how many rows of each stratum; targets: how many drawn rows of each class; covered: features of which each must be drawn."""

    quotas: dict[str, int]
    targets: dict[str, int]
    covered: tuple[str, ...] = ()


def _number(of: dict[str, int], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in of.items() for x in kv]), key)


def drawn(candidates: DataFrame, demands: Demands, seed: int, attempts: range, sizes: dict[str, int] | None = None) -> DataFrame:
    """attempt, id, class, features of what each attempt draws. candidates: id, stratum, class, features (array).

    sizes: how many candidates each stratum has.  An order is a digest, so the
    first `quota` of a large stratum lie in a small share of all digests; rows
    beyond that share are passed over before any sort, and an attempt whose share
    holds fewer than the quota draws from all of its rows.
    """
    own = candidates.where(F.col("stratum").isin(list(demands.quotas)) & F.col("id").isNotNull())
    if sizes is None:
        return _first(_ordered(own, seed, attempts), demands)
    limits = {s: _limit(demands.quotas[s], n) for s, n in sizes.items()}
    if not limits:
        return _first(_ordered(own, seed, attempts), demands)
    # as a table, since a wave's few near rows are counted, drawn and looked over
    near = written(_ordered(own, seed, attempts).where(F.col("order") < _number(limits, F.col("stratum"))), "near-draws")
    enough = F.lit(True)
    for s, n in sizes.items():
        enough = enough & (F.count_if(F.col("stratum") == s) >= min(n, demands.quotas[s]))
    told = {r.attempt for r in near.groupBy("attempt").agg(enough.alias("enough")).where("enough").collect()}  # one row an attempt
    short = sorted(set(attempts) - told)
    out = _first(near.where(~F.col("attempt").isin(short)) if short else near, demands)
    return out.unionByName(_first(_ordered(own, seed, short), demands)) if short else out


def _limit(quota: int, size: int) -> str:
    """Where the first digests of a stratum end: twice the quota and 24 more are expected below (fewer than the quota are so once in millions of times)."""
    share = (2 * quota + 24) / size if size else 1
    return "g" if share >= 1 else f"{int(share * 2**52):013x}"


def _ordered(own: DataFrame, seed: int, attempts: Sequence[int]) -> DataFrame:
    """own once an attempt, with attempt and order: few candidates become many rows, so they are dealt to all tasks first."""
    n = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = F.sequence(F.lit(attempts.start), F.lit(attempts.stop - 1)) if isinstance(attempts, range) else F.array(*map(F.lit, attempts))
    rows = own.repartition(n).withColumn("attempt", F.explode(each))
    return rows.withColumn("order", F.sha2(F.concat_ws(":", (F.lit(seed) + F.col("attempt")).cast("string"), F.col("id").cast("string")).cast("binary"), 256))


def _first(rows: DataFrame, demands: Demands) -> DataFrame:
    w = Window.partitionBy("attempt", "stratum").orderBy("order", "id")
    most = max(demands.quotas.values(), default=0)
    rows = rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    return rows.where(F.col("place") <= _number(demands.quotas, F.col("stratum"))).select("attempt", "id", "class", "features")


def scored(draws: DataFrame, demands: Demands, weight: int = MISSING_WEIGHT) -> DataFrame:
    """attempt, score, imbalance, missing, selected (sorted ids): distances from the targets, and features that no drawn row has times weight."""
    per_class = [F.count_if(F.col("class") == c).alias(f"class_{i}") for i, c in enumerate(demands.targets)]
    per = draws.groupBy("attempt").agg(*per_class, F.array_distinct(F.flatten(F.collect_list("features"))).alias("features"), F.array_sort(F.collect_list("id")).alias("selected"))
    imbalance = sum((F.abs(F.col(f"class_{i}") - n) for i, n in enumerate(demands.targets.values())), F.lit(0))
    missing = F.size(F.array_except(F.array(*map(F.lit, demands.covered)).cast("array<string>"), F.col("features")))
    told = per.select("attempt", imbalance.cast("long").alias("imbalance"), missing.cast("long").alias("missing"), "selected")
    return told.select("attempt", (F.col("imbalance") + weight * F.col("missing")).alias("score"), "imbalance", "missing", "selected")


def stratified_search(candidates: DataFrame, demands: Demands, seed: int, attempts: int = 2000, wave: int = 500, weight: int = MISSING_WEIGHT, whole: bool = False) -> DataFrame:
    """One row (attempt, score, imbalance, missing, selected): the first attempt of score 0, or else the smallest (score, selected) of all.

    whole: raise if no attempt meets all demands.  Without candidates there is
    no row.  A draw is `quotas` rows together, and one draw a wave reaches the
    driver.
    """
    if attempts < 1 or wave < 1:
        raise ValueError("at least one attempt is needed")
    best, schema = None, None
    known = candidates.where(F.col("stratum").isin(list(demands.quotas)) & F.col("id").isNotNull())
    sizes = {r.stratum: r.n for r in known.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a stratum
    for start in range(0, attempts, wave):
        told = scored(drawn(candidates, demands, seed, range(start, min(start + wave, attempts)), sizes), demands, weight)
        schema = told.schema
        # of those that meet all demands the first, of the others the smallest selection
        rank = F.struct("score", F.when(F.col("score") == 0, F.col("attempt")), "selected")
        found = told.groupBy().agg(F.min_by(F.struct(*told.columns), rank).alias("b")).first().b
        if found is not None and (best is None or (found.score, list(found.selected)) < (best.score, list(best.selected)) or (found.score == 0 and best.score)):
            best = found
        if best is not None and best.score == 0:
            break
    if whole and (best is None or best.score):
        raise ValueError("no attempt meets all demands")
    return candidates.sparkSession.createDataFrame([] if best is None else [tuple(best)], schema)

import duckdb
import pytest

from quillon.llm.mixing import mix_report, mixed
from quillon.llm.queries import OP3_SQL, op3_mixing


def by_sql(rows, schema_sql):
    c = duckdb.connect()
    c.sql(f"CREATE TABLE documents ({schema_sql})")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    return {(r[0], r[1], r[2], round(r[3], 6), r[4]) for r in c.sql(OP3_SQL).fetchall()}


ROWS = [(i, "w " * (i % 17), f"s{i % 5}" if i % 11 else None) for i in range(400)] + [(1000, None, "s1"), (1001, "", None), (1002, "x " * 3000, "big"), (1003, "only", "z"), (3, "w w w ", "s3")]


def test_report_equals_sql(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    out = mix_report(df).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert len(out) == len(ROWS)
    assert {(r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in out} == by_sql(ROWS, "doc_id BIGINT, text VARCHAR, source VARCHAR")


def test_targets_and_bounds(spark, sf_dir):
    out = op3_mixing(spark, sf_dir).toPandas()
    assert (out.taken <= 2 * out["size"]).all()
    again = op3_mixing(spark, sf_dir).toPandas()
    assert out.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))
    assert abs(out.taken.sum() - 1.5 * out["size"].sum()) < 0.05 * out["size"].sum()


def test_mixed_rows_are_the_reported_copies_and_clashing_names_do_no_harm(spark):
    df = spark.createDataFrame([(i, "a b c", f"s{i % 3}", "x", 1, 2) for i in range(90)], "doc_id long, text string, source string, whole string, size int, below int")
    report = {r.doc_id: r.taken // 3 for r in mix_report(df).collect()}
    rows = mixed(df)
    assert rows.columns == df.columns
    got = {r.doc_id: r["count"] for r in rows.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in report.items() if v}


def test_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix_report(df).count() == 0 and mixed(df).count() == 0


@pytest.mark.parametrize("weights", [(3, 1, 2), (1,), (5, 1)])
def test_water_filling_equals_the_step_by_step_rule(spark, weights):
    from quillon.llm.mixing import targets

    sizes = {"a": 100, "b": 1000, "c": 10, "d": 500, "e": 0}
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in targets(df, weights).collect()}
    names = sorted(sizes)
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    left, want, free = 1.5 * sum(sizes.values()), {}, set(names)
    while True:
        unit = left / sum(w[n] for n in free)
        full = {n for n in free if w[n] * unit >= 2 * sizes[n]}
        if not full:
            want |= {n: w[n] * unit for n in free}
            break
        for n in full:
            want[n] = 2.0 * sizes[n]
            left -= 2 * sizes[n]
        free -= full
        if not free:
            break
    assert got == pytest.approx(want)

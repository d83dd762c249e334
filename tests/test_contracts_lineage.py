"""Contracts, strict CSV, profiles, lineage on small files with one valid row each."""

import pytest

from quillon.contracts import TRACE, ColumnContract
from quillon.operators import lineage, profile
from quillon.sources.files import SourceError, read_contract_csv, read_trace

ROWS = {
    "PM": "pm1,s1,8,64,1000",
    "VM": "v1,u1,pm1,s1,on,i1,2,4,40,linux,x,10,20",
    "VM_CPU": "v1,s1,0.5,100",
    "VM_BANDWIDTH": "v1,s1,1,2,0.1,0.2,3,4,0.3,0.4,100",
    "VM_BW_THREE_MONTHS": "v1,2024-01-01 00:00:00,0.1,0.2,0.3,0.4",
    "SITE_RTT": "0,s1,s1,1.5,0.0,t,100,2024-01-01 00:00:00,2024-01-01 00:00:01",
}


def write(folder, **changed):
    for name, c in TRACE.items():
        lines = [",".join(c.header), *changed.get(name, ROWS[name]).split("\n")]
        (folder / f"{name}.csv").write_text("\n".join(lines) + "\n")
    return str(folder)


def summary(spark, folder):
    tables = read_trace(spark, folder)
    return tables, {n: profile.profile_summary(t, TRACE[n]).first() for n, t in tables.items()}


def test_valid_trace(spark, tmp_path):
    tables, s = summary(spark, write(tmp_path))
    assert all(r.row_count == 1 and r.invalid_row_count == 0 for r in s.values())
    accepted = {r.table_name: r.accepted_rows for r in lineage.trace_acceptance(tables).collect()}
    assert accepted == dict.fromkeys(TRACE, 1)
    checks = lineage.trace_reference_checks(tables)
    assert checks.where("violation_count > 0").count() == 0
    members = spark.createDataFrame([(n, r.row_count, r.invalid_row_count) for n, r in s.items()], "table_name string, row_count long, invalid_row_count long")
    assert profile.dataset_summary(members, checks).first() == (6, True)


@pytest.mark.parametrize("cell", ["not-number", "-0.1", "1.1", "nan"])
def test_bad_cpu_is_invalid_and_not_accepted(spark, tmp_path, cell):
    tables, s = summary(spark, write(tmp_path, VM_CPU=f"v1,s1,{cell},100"))
    assert s["VM_CPU"].invalid_row_count == 1
    assert {r.table_name: r.accepted_rows for r in lineage.trace_acceptance(tables).collect()}["VM_CPU"] == 0


def test_unknown_machine(spark, tmp_path):
    tables = read_trace(spark, write(tmp_path, VM_CPU="v9,s1,0.5,100"))
    found = {r.check_name: r.violation_count for r in lineage.trace_reference_checks(tables).collect()}
    assert found["vm_cpu_unknown_vm_rows"] == 1 and found["vm_unknown_pm_rows"] == 0


def test_rejected_machine_rejects_all_below_it(spark, tmp_path):
    tables = read_trace(spark, write(tmp_path, PM="pm1,s1,0,64,1000"))
    accepted = {r.table_name: r.accepted_rows for r in lineage.trace_acceptance(tables).collect()}
    assert accepted == dict.fromkeys(TRACE, 0)


def test_empty_nullable_number_counts_as_valid_and_is_dropped(spark, tmp_path):
    tables, s = summary(spark, write(tmp_path, SITE_RTT=ROWS["SITE_RTT"].replace(",0.0,", ",,")))
    assert s["SITE_RTT"].invalid_row_count == 0
    assert {r.table_name: r.accepted_rows for r in lineage.trace_acceptance(tables).collect()}["SITE_RTT"] == 0
    assert {r.table_name: r.accepted_rows for r in lineage.trace_acceptance(tables, strict_null=False).collect()}["SITE_RTT"] == 1


def test_header_files_and_short_rows(spark, tmp_path):
    folder = write(tmp_path)
    (tmp_path / "more.csv").write_text("x")
    with pytest.raises(SourceError):
        read_trace(spark, folder)
    (tmp_path / "more.csv").unlink()
    (tmp_path / "PM.csv").write_text("pm_name,site_id,cores,memory\n")
    with pytest.raises(SourceError):
        read_trace(spark, folder)
    short = tmp_path / "short.csv"
    short.write_text("pm_name,site_id,cores,memory,storage\na,b\n")
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        read_contract_csv(spark, str(short), TRACE["PM"]).collect()


def test_measures(spark):
    from quillon.contracts import TableContract

    t = TableContract("t", (ColumnContract("x", "float", minimum=0, maximum=10), ColumnContract("s", "text")))
    df = spark.createDataFrame([("1", "a"), ("-0.0", "a"), ("11", "b"), ("nan", None), ("", " "), ("bad", "c"), ("-3", "c")], "x string, s string")
    x, s = profile.profile_long(df, t).orderBy("kind").collect()
    assert (x.empty_count, x.parse_error_count, x.non_finite_count, x.below_count, x.above_count, x.distinct_count, x.min_value, x.max_value) == (1, 1, 1, 1, 1, 6, "-3.0", "11.0")
    assert (s.empty_count, s.distinct_count) == (2, 3)


def test_duplicate_parents_never_multiply(spark):
    p = spark.createDataFrame([("a",), ("a",)], "k string")
    c = spark.createDataFrame([("a",)], "f string")
    from pyspark.sql import functions as F

    steps = [lineage.Step("p", p, F.lit(True)), lineage.Step("c", c, F.lit(True), "p", (("f", "k"),))]
    assert lineage.accepted(steps)["c"].count() == 1
    assert lineage.accepted(steps, distinct_parents=False)["c"].count() == 2

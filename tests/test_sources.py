import hashlib
import hmac
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quillon.functions.casting import is_ip
from quillon.sources import archives, files, sinks

KEY = b"0123456789abcdef0123"
LINE = "device,12,34,apn,imei,10.0.0.1,10.0.0.2,2024-01-01 00:00:00,2024-01-01 00:00:09,9,125,50,4,10.1.2.3,1000,2001:db8::1,443,200,http://x/y,agent, with commas"


def test_log_lines(spark):
    bad = {1: ("12", "x"), 9: ("9", "-1"), 14: ("1000", "70000"), 5: ("10.0.0.1", "10.0.0.300"), 7: ("2024-01-01 00:00:00", "2025-01-01 00:00:00"), 0: ("device", "")}
    lines = [LINE] + [",".join(b if k == i else v for k, v in enumerate(LINE.split(","))) for i, (_, b) in bad.items()] + ["too,short"]
    df = spark.createDataFrame([(l, "/data/beijing/a.csv", i + 1) for i, l in enumerate(lines)] + [(LINE, "/data/elsewhere/a.csv", 1)], "value string, source_path string, source_row_number int")
    out = files.parse_log(df, KEY).collect()
    good = [r for r in out if r.error is None]
    assert len(good) == 1 and len({r.error for r in out}) == 8
    r = good[0]
    sign = lambda ns, s: hmac.new(KEY, f"{ns}:{s}".encode(), hashlib.sha256).hexdigest()
    assert (r.input_bits, r.output_bits, r.city) == (1000, 400, "beijing")
    assert r.device_id == sign("device", "device") and r.station_id == sign("station", "beijing:12:34")
    assert r.sample_id == hashlib.sha256(b"/data/beijing/a.csv:1").hexdigest()
    assert not any(x in str(r) for x in ("10.1.2.3", "http", "agent", "imei"))
    with pytest.raises(ValueError):
        files.parse_log(df, b"short")


def test_ip_addresses_agree_with_the_standard_library(spark):
    import ipaddress

    tests = ["1.2.3.4", "256.1.1.1", "01.2.3.4", "1.2.3", "::", "::1", "2001:db8::1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1::2::3", "::ffff:1.2.3.4", "fe80::1", "g::1", "", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:1.2.3.4"]

    def real(s):
        try:
            ipaddress.ip_address(s)
            return True
        except ValueError:
            return False

    got = {r.s: r.ok for r in spark.createDataFrame([(s,) for s in tests], "s string").select("s", is_ip(F.col("s")).alias("ok")).collect()}
    assert got == {s: real(s) for s in tests}


def nested(tmp_path, rows="Thu Nov 26 14:47:38 2020,0.25\n", header="Time,Execution Time\n", drop=0, name="outer.zip"):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("TATDescriptionDataset/", "")
        for member in list(archives.SERVERS)[drop:]:
            z.writestr(member, header + rows)
    path = tmp_path / name
    with zipfile.ZipFile(path, "w") as z:
        z.writestr(archives.INNER, inner.getvalue())
    return str(path)


def test_nested_archive(spark, tmp_path):
    many = "".join(f"Thu Nov {1 + i % 28:2d} 14:47:{i % 60:02d} 2020,{i + 1}e-3\r\n" for i in range(3000))
    path = nested(tmp_path, many)
    got = archives.execution_times(spark, path, split_bytes=2000)
    rows = got.orderBy("server_id", "source_row_number").collect()
    assert len(rows) == 12_000 and {r.server_id for r in rows} == set(archives.SERVERS.values())
    for k, r in enumerate(rows):
        i = k % 3000
        assert (r.source_row_number, r.turnaround_time_s) == (i + 2, (i + 1) / 1000) and (r.observed_at.day, r.observed_at.second) == (1 + i % 28, i % 60)
        assert archives.SERVERS[r.source_member] == r.server_id and r.sample_id == hashlib.sha256(f"{r.source_member}:{i + 2}".encode()).hexdigest()


@pytest.mark.parametrize("change", [{"header": "A,B\n"}, {"rows": "bad,0.25\n"}, {"rows": "Thu Nov 26 14:47:38 2020,x\n"}, {"rows": "Thu Nov 26 14:47:38 2020,0\n"}, {"rows": "Thu Nov 31 14:47:38 2020,1\n"}, {"rows": "Thu Nov 26 14:47:38 2020,1,2\n"}, {"rows": "Thu Nov 26 14:47:38 2020,1f\n"}, {"drop": 1}])
def test_nested_archive_errors(spark, tmp_path, change):
    with pytest.raises(Exception, match="header|execution time|expected"):
        archives.execution_times(spark, nested(tmp_path, **change)).collect()


def test_ctime_agrees_with_the_standard_library(spark):
    from datetime import datetime

    tests = ["Thu Nov 26 14:47:38 2020", "thu  nov  6 4:7:8 2020", "Thu Nov 31 14:47:38 2020", "Thu Feb 29 00:00:00 2020", "Thu Feb 29 00:00:00 2021", "Xyz Nov 26 14:47:38 2020", "Thu Nov 26 24:47:38 2020", "Thu Nov 26 14:47 2020", "", "Thu Nov 26 14:47:38 2020 x"]

    def real(s):
        try:
            return datetime.strptime(" ".join(s.split()), "%a %b %d %H:%M:%S %Y")
        except ValueError:
            return None

    got = {r.s: r.t for r in spark.createDataFrame([(s,) for s in tests], "s string").select("s", archives.ctime(F.col("s")).alias("t")).collect()}
    assert got == {s: real(s) for s in tests}


def places(tmp_path, lat="-37.8", extra=None, header=None):
    path = tmp_path / "p.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("r/edge-servers/site.csv", "\ufeff" + ",".join(header or archives.SITES[2]) + f'\n1,{lat},144.9,"n, with\nlines",VIC,1,3000,p,1,h\n')
        z.writestr("r/users/users-aus.csv", ",".join(archives.USERS[2]) + "\n1.2.3.4,-37.9,145.0,3000,M,VIC,AU\n")
        if extra:
            z.writestr(extra, "x")
    return str(path)


def test_locations(spark, tmp_path):
    rows = archives.locations(spark, places(tmp_path)).orderBy("entity_kind").collect()
    assert [(r.entity_kind, r.latitude_deg, r.source_row_number) for r in rows] == [("edge_server", -37.8, 2), ("user", -37.9, 2)]
    assert "1.2.3.4" not in str(rows)
    for change in ({"lat": "95"}, {"lat": "nan"}, {"extra": "../evil.csv"}, {"header": ["A"] * 10}):
        with pytest.raises(Exception, match="header|location|within the archive"):
            archives.locations(spark, places(tmp_path, **change)).collect()


def test_jsonl(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType().add("a", "long").add("b", "string")
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1, "b": "é"}\n{"a": 2, "b": null}\n')
    assert [tuple(r) for r in files.read_jsonl(spark, str(p), schema).orderBy("a").collect()] == [(1, "é"), (2, None)]
    for content, told in (('{"a": 1}\n\n{"a": 2}\n', "line 2: blank"), ('{"a": 1}\n[1]\n', "line 2: not an object"), ("", "is empty"), ('{"a": 1\n', "line 1: invalid"), ('{"a": "x"}\n', "line 1: invalid"), ("null\n", "line 1: not an object")):
        p.write_text(content)
        with pytest.raises(Exception, match=told):
            files.read_jsonl(spark, str(p), schema).collect()


def test_json_rows_tell_every_bad_line(spark, tmp_path):
    from pyspark.sql import types as T

    lines = [f'{{"a": {i}}}' if i % 7 else ("[1]" if i % 2 else '{"a": }') for i in range(2000)]
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    got = files.json_rows(spark, str(tmp_path / "x.jsonl"), T.StructType().add("a", "long"), split_bytes=500)
    assert got.rdd.getNumPartitions() > 10
    for r in got.collect():
        i = r.source_row_number - 1
        assert (r.record.a if r.record else None, r.issue) == ((i, None) if i % 7 else (None, "not an object" if i % 2 else "invalid JSON or another type"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'q"é\n'), (2, None)], "n int, s string")
    sinks.write_canonical_jsonl(df, str(tmp_path / "c"), {"s": F.col("s"), "#n": F.col("n")}, one_file=True)
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "c")).collect())
    assert lines == ['{"n":1,"s":"q\\"é\\n"}', '{"n":2,"s":null}']
    sinks.write_json_atomic(tmp_path / "v.json", {"b": 1, "a": [2]})
    assert (tmp_path / "v.json").read_text().startswith('{\n  "a"')
    assert sinks.write_once(tmp_path / "l", b"x") and not sinks.write_once(tmp_path / "l", b"x")
    with pytest.raises(ValueError):
        sinks.write_once(tmp_path / "l", b"y")
    calls = []
    make = lambda m: calls.append(m) or df
    assert sinks.run_members(spark, str(tmp_path / "m"), ["a", "b"], "1", make) == ["a", "b"]
    assert sinks.run_members(spark, str(tmp_path / "m"), ["a", "b", "c"], "1", make) == ["c"] and calls == ["a", "b", "c"]
    assert files.checksum_matches(spark, str(tmp_path / "l"), hashlib.sha256(b"x").hexdigest().upper())
    assert not files.checksum_matches(spark, str(tmp_path / "l"), hashlib.sha256(b"y").hexdigest())


def test_ranges_of_the_file_queries_grow_with_the_files(spark, tmp_path, monkeypatch):
    from quillon.plans import file_queries

    (tmp_path / "a.txt").write_text("x" * 99 + "\n" + "y\n" * 100_000)
    assert file_queries.range_bytes(spark, str(tmp_path)) == file_queries.SPLIT_BYTES
    monkeypatch.setattr(file_queries, "RANGES", 2)
    assert file_queries.range_bytes(spark, str(tmp_path)) == 100_050
    monkeypatch.setattr("quillon.sources.splits.SPLIT_BYTES", 80_000)
    assert file_queries.range_bytes(spark, str(tmp_path)) == 80_000

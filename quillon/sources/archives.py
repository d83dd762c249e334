"""The two archives of the reference data: nested ZIP of execution times, ZIP of locations.

Members are read a task each, from any path that Spark reads (`zips`).  What an
archive must hold is checked before its rows are read; a row that doesn't fit
raises when it is read, with its member and number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import identity
from quillon.sources import zips
from quillon.sources.shared import written
from quillon.sources.splits import byte_chunks

# Members of the archives, their headers, and the names they stand for.
INNER = "TATDescriptionDataset.zip"
SERVERS = {
    "TATDescriptionDataset/MacBookPro1.csv": "macbook_pro_1",
    "TATDescriptionDataset/MacBookPro2.csv": "macbook_pro_2",
    "TATDescriptionDataset/RasberryPi.csv": "raspberry_pi_4b",
    "TATDescriptionDataset/VM.csv": "ubuntu_virtualbox_vm",
}
HEADER = ["Time", "Execution Time"]
SITES = ("/edge-servers/site.csv", "edge_server", ["SITE_ID", "LATITUDE", "LONGITUDE", "NAME", "STATE", "LICENSING_AREA_ID", "POSTCODE", "SITE_PRECISION", "ELEVATION", "HCIS_L2"])
USERS = ("/users/users-aus.csv", "user", ["IP", "Latitude", "Longitude", "PostCode", "City", "State", "Country"])
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_CTIME = r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun) (" + "|".join(MONTHS) + r") ([0-9]{1,2}) ([0-9]{1,2}):([0-9]{1,2}):([0-9]{1,2}) ([0-9]{4})$"
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


class ArchiveError(ValueError):
    pass


def _refuse(bad: DataFrame, told: str) -> None:
    """bad: source_path and names; the first of them is told."""
    for r in bad.limit(1).collect():
        raise ArchiveError(f"{r[0]}: {told}, found {r[1]}")


def _files(found: DataFrame) -> DataFrame:
    """Members that aren't folders. A name that leaves the archive is refused."""
    path = F.replace(F.col("member"), F.lit("\\"), F.lit("/"))
    unsafe = path.startswith("/") | F.array_contains(F.split(path, "/"), "..")
    _refuse(found.where(unsafe).select("source_path", "member"), "names within the archive are expected")
    return found.where(~F.col("member").endswith("/"))


def _only(files: DataFrame, archives: DataFrame, names: list[str], told: str) -> None:
    """Each archive has each of the names once and no further member."""
    known = F.col("member").isin(names)
    per = archives.select("source_path").distinct().join(files, "source_path", "left").groupBy("source_path")
    per = per.agg(F.count("member").alias("n"), F.count_distinct(F.when(known, F.col("member"))).alias("k"))
    _refuse(per.where((F.col("n") != len(names)) | (F.col("k") != len(names))), told)


def _opened(spark: SparkSession, path: str | list[str], split_bytes: int | None) -> tuple[DataFrame, DataFrame]:
    chunks = zips.kept_chunks(byte_chunks(spark, path, **({"split_bytes": split_bytes} if split_bytes else {})))
    return chunks, written(zips.members(chunks), "members")


def _checked(rows: DataFrame, good: Column, what: str) -> DataFrame:
    """rows; reading one for which `good` isn't true raises with its member and number."""
    message = F.concat(F.lit(f"{what}: "), F.col("member"), F.lit(", row "), F.col("source_row_number").cast("string"), F.lit(": "), F.to_json("fields"))
    return rows.where(F.when(F.coalesce(good, F.lit(False)), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def _body(rows: DataFrame, header: list[str], members_of: Column | None = None) -> DataFrame:
    """Rows under a header, which must be the first row of the member (of those that `members_of` picks)."""
    first = F.col("source_row_number") == 1
    named = F.col("fields") == F.array(*map(F.lit, header))
    rows = rows if members_of is None else rows.where(members_of)
    return _checked(rows, ~first | named, "header").where(~first)


def number(text: Column) -> Column:
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def ctime(text: Column) -> Column:
    """A time such as Thu Nov 26 14:47:38 2020, with any white space between its parts; null if it is none."""
    t = F.regexp_replace(F.trim(text), r"\s+", " ")
    part = lambda k: F.regexp_extract(t, _CTIME, k)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(part(1)))
    numbers = [part(k).try_cast("int") for k in (6, 2, 3, 4, 5)]
    made = F.try_make_timestamp_ntz(numbers[0], month.cast("int"), *numbers[1:4], numbers[4].cast("decimal(8,6)"))
    return F.when(t.rlike(_CTIME), made)


def execution_times(spark: SparkSession, path: str | list[str], split_bytes: int | None = None) -> DataFrame:
    """sample_id, server_id, source_member, source_row_number (from 2), observed_at, turnaround_time_s of nested archives."""
    chunks, outer = _opened(spark, path, split_bytes)
    files = _files(outer)
    _only(files, chunks, [INNER], f"one inner archive {INNER} is expected")
    inside = zips.kept_chunks(zips.member_chunks(chunks, files))
    inner = _files(written(zips.members(inside), "members"))
    tables = inner.where(F.lower("member").endswith(".csv"))
    _only(tables, inside, list(SERVERS), f"members {sorted(SERVERS)} are expected")
    rows = _body(zips.member_rows(inside, inner), HEADER, F.col("member").isin(list(SERVERS)))
    at, seconds = ctime(F.get("fields", F.lit(0))), number(F.get("fields", F.lit(1)))
    good = (F.size("fields") == 2) & at.isNotNull() & (seconds > 0) & (seconds < float("inf"))
    server = F.element_at(F.create_map(*[F.lit(x) for kv in SERVERS.items() for x in kv]), F.col("member"))
    own = identity.sha256_id(F.col("member"), F.col("source_row_number"))
    return _checked(rows, good, "execution time").select(own.alias("sample_id"), server.alias("server_id"), F.col("member").alias("source_member"), "source_row_number", at.alias("observed_at"), seconds.alias("turnaround_time_s"))


def locations(spark: SparkSession, path: str | list[str], split_bytes: int | None = None) -> DataFrame:
    """source_entity_id, entity_kind, source_member, source_row_number (from 2), latitude_deg, longitude_deg of archives with one table of each kind."""
    chunks, found = _opened(spark, path, split_bytes)
    files = _files(found)
    parts = []
    for suffix, kind, header in (SITES, USERS):
        mine = F.col("member").endswith(suffix)
        per = chunks.select("source_path").distinct().join(files.where(mine), "source_path", "left").groupBy("source_path").agg(F.count("member").alias("n"))
        _refuse(per.where("n <> 1"), f"one member {suffix} is expected")
        rows = _body(zips.member_rows(chunks, files.where(mine)), header)
        lat, lon = (number(F.get("fields", F.lit(next(i for i, h in enumerate(header) if h.lower() == n)))) for n in ("latitude", "longitude"))
        good = (F.size("fields") == len(header)) & lat.between(-90, 90) & lon.between(-180, 180)
        own = identity.sha256_id(F.col("member"), F.col("source_row_number"))
        parts.append(_checked(rows, good, "location").select(own.alias("source_entity_id"), F.lit(kind).alias("entity_kind"), F.col("member").alias("source_member"), "source_row_number", lat.alias("latitude_deg"), lon.alias("longitude_deg")))
    return parts[0].unionByName(parts[1])

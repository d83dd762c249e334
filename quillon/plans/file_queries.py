"""Queries over files: each writes the given tables as files into the shared folder and reads them back with the library's sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators import schemas
from quillon.plans.catalog import ORACLE, ORDERS, as_file, profiled, query, read
from quillon.sources import files, splits
from quillon.sources.shared import folder

#: Bytes of a range in these queries where files are small, so that those of the small tables have several.
SPLIT_BYTES = 64 << 10
#: Ranges that the files of a query are cut into, about (besides one a file): each costs a task and a row on the driver.
RANGES = 256


def range_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a range of the files at path: as many as RANGES ranges of all bytes hold, within SPLIT_BYTES and the library's own size."""
    total = sum(n for _, n in splits.listed(spark, path))
    return min(max(SPLIT_BYTES, -(-total // RANGES)), splits.SPLIT_BYTES)


def in_order(rows: DataFrame, key: str, line, name: str) -> str:
    """Write a line for each row into text files whose names, and lines within a file, follow the key."""
    path = folder(rows.sparkSession, name)
    rows.repartitionByRange(key).sortWithinPartitions(key).select(line.alias("value")).write.text(path)
    return path


def place(numbered: DataFrame) -> DataFrame:
    """numbered with line_number: the place of a line in all files taken in the order of their names (one row a file is summed up)."""
    per = numbered.groupBy("source_path").agg(F.count(F.lit(1)).alias("n"))
    before = per.select("source_path", (F.sum("n").over(Window.orderBy("source_path")) - F.col("n")).alias("before"))
    return numbered.join(before, "source_path").withColumn("line_number", F.col("before") + F.col("source_row_number")).drop("before")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey)::BIGINT AS line_number, length(o_orderpriority)::BIGINT AS n_chars FROM orders")
def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines of text, each with its number as counted over the ranges of the files."""
    path = in_order(read(spark, sf_dir, "orders"), "o_orderkey", F.concat_ws(",", "o_orderkey", "o_orderpriority"), "order-lines")
    lines = place(splits.numbered_lines(spark, path, range_bytes(spark, path)))
    part = F.split("value", ",")
    return lines.select(part[0].cast("long").alias("o_orderkey"), "line_number", F.length(part[1]).cast("long").alias("n_chars"))


def _log_line() -> Column:
    k, c = F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long")
    ip = lambda x: F.concat_ws(".", F.lit("10"), *[(x / n).cast("long") % 256 for n in (65536, 256, 1)])
    start = F.to_timestamp(F.col("o_orderdate").cast("date")) + F.make_dt_interval(secs=(k % 86400).cast("decimal(18,6)"))
    text = lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss")
    end = F.when(k % 53 == 0, start - F.expr("INTERVAL 1 SECOND")).otherwise(start + F.expr("INTERVAL 9 SECONDS"))
    fields = [
        F.when(k % 97 == 0, "").otherwise(F.concat(F.lit("d"), c)), c % 1000, k % 7000, F.lit("apn"), F.lit("imei"), ip(c), ip(k), text(start), text(end), F.lit(9),
        F.when(k % 89 == 0, "-1").otherwise((k * 3).cast("string")), c * 2, F.lit(4), ip(c), k % 65536, F.when(k % 83 == 0, "1.2.3.999").otherwise(ip(k)), F.when(k % 79 == 0, 65536).otherwise(F.lit(443)), F.lit(200), F.lit("http://x/y,agent, with commas"),
    ]
    return F.concat_ws(",", *[f.cast("string") for f in fields])


@query("""
WITH l AS (SELECT o_orderkey k, o_custkey c, CASE o_orderkey % 3 WHEN 0 THEN 'beijing' WHEN 1 THEN 'guangzhou' ELSE 'nowhere' END AS city FROM orders),
e AS (SELECT *, CASE WHEN k % 97 = 0 THEN 'device is empty' WHEN city = 'nowhere' THEN 'city isn''t supported' WHEN k % 89 = 0 THEN 'a number is not a non-negative integer'
  WHEN k % 53 = 0 THEN 'end before start' WHEN k % 79 = 0 THEN 'a port is above 65535' WHEN k % 83 = 0 THEN 'an address isn''t an IP' END AS error FROM l)
SELECT city AS folder, error, count(*)::BIGINT AS n, sum(CASE WHEN error IS NULL THEN k * 24 END)::BIGINT AS input_bits, sum(CASE WHEN error IS NULL THEN c * 16 END)::BIGINT AS output_bits,
  count(DISTINCT CASE WHEN error IS NULL THEN c END)::BIGINT AS n_devices, round(sum(CASE WHEN error IS NULL THEN 9 END), 6)::BIGINT AS duration_s FROM e GROUP BY ALL
""")
def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as headerless log lines in a folder a city, some broken; what the parser makes of them by folder and reason."""
    orders, root = read(spark, sf_dir, "orders"), folder(spark, "log-lines")
    for i, city in enumerate(("beijing", "guangzhou", "nowhere")):
        orders.where(F.col("o_orderkey") % 3 == i).select(_log_line().alias("value")).write.text(f"{root}/{city}")
    out = files.parse_log(splits.numbered_lines(spark, f"{root}/*", range_bytes(spark, f"{root}/*")), b"a key of 16 bytes or more")
    of = F.element_at(F.split("source_path", "/"), -2).alias("folder")
    return out.groupBy(of, "error").agg(F.count(F.lit(1)).alias("n"), F.sum("input_bits").alias("input_bits"), F.sum("output_bits").alias("output_bits"), F.count_distinct("device_id").alias("n_devices"), F.sum("duration_s").cast("long").alias("duration_s"))


@query(r"""
SELECT row_number() OVER (ORDER BY doc_id)::BIGINT AS line_number, CASE WHEN doc_id % 31 = 0 THEN 'not an object' WHEN doc_id % 29 = 0 THEN 'blank line' WHEN doc_id % 23 = 0 THEN 'invalid JSON or another type' END AS issue,
  CASE WHEN doc_id % 31 = 0 OR doc_id % 29 = 0 OR doc_id % 23 = 0 THEN NULL ELSE doc_id END::BIGINT AS doc_id,
  CASE WHEN doc_id % 31 = 0 OR doc_id % 29 = 0 OR doc_id % 23 = 0 THEN NULL ELSE sha256(coalesce(text, '')) END AS text_sha256 FROM documents
""")
def json_line_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON lines, some broken, read with the number and the issue of every line."""
    k = F.col("doc_id").cast("long")
    line = F.when(k % 31 == 0, "[1]").when(k % 29 == 0, "  ").when(k % 23 == 0, '{"doc_id": "one"}').otherwise(F.to_json(F.struct(k.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))))
    path = in_order(read(spark, sf_dir, "documents"), "doc_id", line, "json-lines")
    rows = place(files.json_rows(spark, path, T.StructType().add("doc_id", "long").add("text", "string"), range_bytes(spark, path)))
    return rows.select("line_number", "issue", "record.doc_id", F.sha2(F.col("record.text").cast("binary"), 256).alias("text_sha256"))


@query("SELECT (o_custkey % 64)::BIGINT AS part, sum(strlen(o_comment) + 1)::BIGINT AS length, sha256(string_agg(o_comment || chr(10), '' ORDER BY o_orderkey)) AS sha256 FROM (SELECT o_custkey, o_orderkey, o_orderkey::VARCHAR || ',' || o_orderpriority AS o_comment FROM orders) GROUP BY o_custkey % 64")
def file_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders dealt to 64 files; the digest and length of each file, read in ranges."""
    path = folder(spark, "order-files")
    rows = read(spark, sf_dir, "orders").withColumn("part", F.col("o_custkey").cast("long") % 64)
    rows.repartition("part").sortWithinPartitions("part", "o_orderkey").select("part", F.concat_ws(",", "o_orderkey", "o_orderpriority").alias("value")).write.partitionBy("part").text(path)
    part = F.regexp_extract("source_path", "part=([0-9]+)", 1).cast("long")
    return splits.checksums(spark, f"{path}/*/*.txt", range_bytes(spark, path)).select(part.alias("part"), "length", "sha256")


#: What a document's record must be; the query breaks some by rule.
DOCUMENT = {
    "type": "object", "additionalProperties": False, "required": ["doc_id", "lang", "source", "tags"],
    "properties": {
        "doc_id": {"type": "integer", "minimum": 0}, "lang": {"$ref": "#/$defs/lang"}, "source": {"type": "string", "pattern": "^[a-z]", "maxLength": 40},
        "n_chars": {"type": ["integer", "null"], "maximum": 20000}, "tags": {"type": "array", "uniqueItems": True, "minItems": 1, "items": {"type": "string", "minLength": 2}},
    },
    "if": {"properties": {"lang": {"const": "en"}}}, "then": {"properties": {"n_chars": {"minimum": 40}}}, "else": {"required": ["n_chars"]},
    "$defs": {"lang": {"enum": ["en", "de", "fr", "es"]}},
}


@query(r"""
WITH d AS (SELECT doc_id k, lang, source, n_chars n, CASE WHEN doc_id % 17 = 0 THEN 'xx' ELSE lang END AS l FROM documents),
i AS (
  SELECT k, '' AS path, 'json' AS rule FROM d WHERE k % 61 = 0
  UNION ALL SELECT k, '', 'additionalProperties' FROM d WHERE k % 13 = 0
  UNION ALL SELECT k, '', 'required' FROM d WHERE k % 19 = 0
  UNION ALL SELECT k, '', 'required' FROM d WHERE (k % 11 = 0 OR n IS NULL) AND l IS DISTINCT FROM 'en' AND l IS NOT NULL
  UNION ALL SELECT k, '/lang', 'enum' FROM d WHERE l NOT IN ('en', 'de', 'fr', 'es')
  UNION ALL SELECT k, '', 'required' FROM d WHERE l IS NULL
  UNION ALL SELECT k, '', 'required' FROM d WHERE source IS NULL
  UNION ALL SELECT k, '/source', 'pattern' FROM d WHERE NOT regexp_matches(source, '^[a-z]')
  UNION ALL SELECT k, '/source', 'maxLength' FROM d WHERE length(source) > 40
  UNION ALL SELECT k, '/n_chars', 'maximum' FROM d WHERE n > 20000 AND k % 11 <> 0
  UNION ALL SELECT k, '/n_chars', 'minimum' FROM d WHERE n < 40 AND k % 11 <> 0 AND (l = 'en' OR l IS NULL)
  UNION ALL SELECT k, '/tags', 'uniqueItems' FROM d WHERE k % 7 = 0 AND k % 19 <> 0
  UNION ALL SELECT k, '/tags/2', 'minLength' FROM d WHERE k % 5 = 0 AND k % 19 <> 0)
SELECT k AS key, path, rule, count(*)::BIGINT AS n FROM i WHERE k % 61 <> 0 OR rule = 'json' GROUP BY ALL
""")
def schema_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON records, some broken, against a compiled schema: every demand that a record breaks."""
    k = F.col("doc_id").cast("long")
    tags = F.when(k % 19 != 0, F.array(F.lit("t1"), F.when(k % 7 == 0, "t1").otherwise(F.lit("t2")), F.when(k % 5 == 0, "x").otherwise(F.lit("t3"))))
    record = F.struct(k.alias("doc_id"), F.when(k % 17 == 0, "xx").otherwise(F.col("lang")).alias("lang"), "source", F.when(k % 11 != 0, F.col("n_chars")).alias("n_chars"), tags.alias("tags"), F.when(k % 13 == 0, F.lit(1)).alias("more"))
    text = F.when(k % 61 == 0, '{"doc_id": ').otherwise(F.to_json(record))
    rows = read(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    return schemas.schema_issues(rows, "doc_id", "text", DOCUMENT).groupBy("key", "path", "rule").agg(F.count(F.lit(1)).alias("n"))


@query(ORACLE["profile_orders"])
def contract_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, some cells broken, as CSV files under their contract's header, read strictly and profiled."""
    path = folder(spark, "orders-csv")
    own = {"header": True, "quote": '"', "escape": '"', "nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    as_file(spark, sf_dir, ORDERS, "o_orderkey").write.options(**own).csv(path)
    return profiled(files.read_contract_csv(spark, path, ORDERS), ORDERS)

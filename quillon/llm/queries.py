"""The thin queries of the numbered operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every text, read off the last entry of its prefix counts. Null and empty texts have 0 tokens and 0 bytes; repeated rows give repeated rows; an empty table gives none."""
    from quillon.llm.token_counts import prefix_counts, total_tokens

    n = total_tokens(F.col("prefix_tokens"))
    return prefix_counts(table(spark, sf_dir, "documents"), tokenizer_path()).select("doc_id", "n_bytes", n.alias("n_tokens"), (n > 512).alias("over_limit"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every text by the model of all labels. Null and empty texts get the base rate; equal texts equal results; labels of one class only (or none) give severity 0; no rows give none."""
    from quillon.llm.toxicity import fit, severity

    docs = table(spark, sf_dir, "documents")
    return severity(docs, fit(docs, table(spark, sf_dir, "labels")))


def op8_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the file of coded ids says of every document. A null or empty text has its end id alone; null doc_ids come first, rows of one doc_id in order of text, repeated rows all count; an empty table gives no rows."""
    from quillon.llm.binary_output import read_ids, write_ids
    from quillon.llm.workdir import table_path

    path = write_ids(table(spark, sf_dir, "documents"), table_path(spark, "op8-ids"), tokenizer_path(), END_ID)
    return read_ids(spark, path, digest_only=True)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document. A null text has no words, a null source is a source of its own (last); rows of one doc_id are taken together; an empty table gives no rows."""
    from quillon.llm.mixing import mix_report

    return mix_report(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every text. Null and empty texts have none (empty strings, counts 0); equal texts have equal base results and, as what is known is one for the corpus, equal spans; an empty table gives no rows."""
    from quillon.llm.pii import pii_report

    return pii_report(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 9))::BIGINT AS place
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0 ELSE 2.0 END AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
  FROM s),
t AS (
  SELECT source, source_size, (CASE WHEN 2.0 * source_size <= lev * w THEN 2.0 * source_size
    ELSE w * (SELECT arg_min(lev, 2.0 * source_size / w) FROM o WHERE 2.0 * source_size > lev * w) END)::DOUBLE AS target
  FROM o),
q AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
c AS (
  SELECT d.doc_id, d.size, q.source_size, q.target, q.whole, q.target - q.whole * q.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place) AS after,
         sum(d.size) OVER (PARTITION BY d.source, d.place) AS cell
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN rest > 0 AND after - cell / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""

def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, key and decision of every document. Null and empty texts have no n-grams (weight of a neutral text); equal rows are kept or rejected together; without labels of both classes all are kept; no rows give none."""
    from quillon.llm.quality import classified

    return classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[0]


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of every text. Null and empty texts have no words, no labels (empty strings) and score 0; equal rows have equal results; an empty table gives no rows."""
    from quillon.llm.licenses import license_report

    return license_report(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item it holds. Null and empty texts hold nothing; equal rows are one row; items without an id are found (item_id null); an empty table on either side gives no rows."""
    from quillon.llm.decontam import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("k1", "k2")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document. Null and empty texts are one class; texts without words are alike only if equal; repeated rows share their class; a class is named by its smallest doc_id (null first); no rows give none."""
    from quillon.llm.neardup import classes

    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edit. A null text is empty and has an empty fingerprint, like another empty one (1), unlike any other (0); rows of one doc_id are in order of text; a single row is its own next; no rows give none."""
    from quillon.llm.fingerprints import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document, drawn towards the benchmark. A null or empty text has no features and weight 0 and is never drawn; a null doc_id has the noise of the seed alone and loses ties; equal rows take ranks one after another; an empty benchmark leaves gains of raw counts; no rows give none."""
    from quillon.llm.resampling import resampled

    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers on every text. Null and empty texts and texts that either tokenizer doesn't give back have zeros and an empty digest; repeated rows each count as a document and have equal results; an empty table gives no rows."""
    from quillon.llm.alignment import alignment

    return alignment(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page. A null or empty html has an empty text; a page without a url belongs to no site, so nothing of it recurs; equal pages have equal texts; an empty table gives no rows."""
    from quillon.llm.pages import main_texts

    return main_texts(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_token_counts, op3_mixing, op4_license_scan, op5_decontamination, op6_near_duplicates, op7_toxicity, op8_binary_output, op9_fingerprints, op10_pii, op11_importance_resampling, op12_tokenizer_alignment, op13_html_extraction)}

ORACLE: dict[str, str] = {"op3_mixing": OP3_SQL}

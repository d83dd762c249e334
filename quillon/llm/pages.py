"""Main text of HTML pages: removal of site templates.

First pass: every element subtree of every page that could belong to the site
rather than to the article is hashed (tags and texts), and Spark counts on how
many pages of the host it stands.  Second pass: subtrees that recur on MIN_PAGES
pages or more of one host are deleted, with what tags and attributes mark as no
part of the article, and what is left of the article is the text.

Pages count as one when their article is the same, so many copies of one article
on a host don't make a template of it.  Where a page marks its article (article,
main, or a name that says so), plain text blocks in it are never deleted for
recurring: a passage that many articles of a host share is text, not template.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.htmltree import Page
from quillon.llm.textops import by_chunk
from quillon.llm.workdir import Scratch, mapped, table_path

#: A subtree on so many different pages of a host belongs to the site.
MIN_PAGES = 3
#: Recurring subtrees (8 bytes each) that are sent to every task; with more, each page is joined to its own.
BROADCAST_SUBTREES = 500_000


def host(url: Column) -> Column:
    """The host of a url, lower-cased; null if it has none."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(found != "", found)


def _rows(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return rows.withColumn("host", host(F.col("url")))


def _signed(values) -> np.ndarray:
    return np.array(list(values), np.uint64).view(np.int64)


def _subtrees(rows: DataFrame, keyed: bool = False) -> DataFrame:
    """host, subtree, page of the candidate subtrees of each page with a host; keyed: with the page's own key."""
    rows = rows.where("host is not null").select("html", "host", *([F.md5(F.concat_ws("\0", "host", "html")).alias("page_key")] if keyed else []))
    names = ["host", "subtree", "page", *(["page_key"] if keyed else [])]

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [Page(h).subtrees(s) for h, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        take = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
        flat = [pair for x in found for pair in x]
        cols = [b.column(1).take(take), pa.array(_signed(s for s, _ in flat)), pa.array(_signed(p for _, p in flat))]
        return pa.RecordBatch.from_arrays([*cols, *([b.column(2).take(take)] if keyed else [])], names)

    return mapped(rows, by_chunk(one, "html"), "host string, subtree long, page long" + (", page_key string" if keyed else ""))


def site_templates(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES) -> DataFrame:
    """host, subtree, n_pages of the subtrees that recur on min_pages different pages of a host or more.

    A subtree's pages are made distinct before they are counted, so no host and
    no subtree that all its pages share meets in one task.
    """
    seen = _subtrees(_rows(pages, id_col, url_col, html_col)).distinct()
    return seen.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n_pages")).where(F.col("n_pages") >= min_pages)


def _texts(rows: DataFrame, known: bytes | None) -> DataFrame:
    """page_id, url, text of rows, without the subtrees in `known` (sorted, 8 bytes each), or else in the rows' own column `subtrees`."""
    kinds = [rows.schema[c] for c in ("page_id", "url")]
    schema = T.StructType([*kinds, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = frozenset(np.frombuffer(known, np.uint64).tolist()) if known is not None else None

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            sites, html = b.column(3).to_pylist(), b.column(2).to_pylist()
            own = b.column(4).to_pylist() if every is None else [every] * len(html)
            own = [x if every is not None else frozenset(v & (1 << 64) - 1 for v in x or ()) for x in own]
            texts = [Page(h).main_text(s or "", r if s is not None else frozenset()) for h, s, r in zip(html, sites, own)]
            return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], schema.names)

        return by_chunk(one, "html")(batches)

    return mapped(rows, run, schema)


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, broadcast_subtrees: int = BROADCAST_SUBTREES) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages.

    A null or empty html has an empty text; a page without a host has nothing
    that recurs; further columns of pages are not read; repeated rows have equal
    texts and count as one page.
    """
    spark = pages.sparkSession
    rows = _rows(pages, id_col, url_col, html_col)
    scratch = Scratch(spark, "site-templates")
    known = scratch.written(site_templates(pages, id_col, url_col, html_col, min_pages), "recurring")
    if known.count() <= broadcast_subtrees:
        told = known.select("subtree").toArrow().column(0).to_numpy()
        texts = _texts(rows.select("page_id", "url", "html", "host"), np.sort(told.view(np.uint64)).tobytes())
    else:
        own = _subtrees(rows, keyed=True).select("page_key", "subtree").distinct().join(known.select("subtree"), "subtree", "left_semi")
        own = own.groupBy("page_key").agg(F.collect_list("subtree").alias("subtrees"))
        keyed = rows.withColumn("page_key", F.md5(F.concat_ws("\0", "host", "html")))
        texts = _texts(keyed.join(own, "page_key", "left").select("page_id", "url", "html", "host", "subtrees"), None)
    path = table_path(spark, "main-texts")
    out = texts.withColumn("n_chars", F.length("text").cast("long"))
    out.write.parquet(path)
    scratch.drop()
    return spark.read.schema(out.schema).parquet(path)

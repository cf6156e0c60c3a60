"""Page sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webquarry.functions import text as T
from webquarry.functions.urls import url_domain

MIN_HTML_LENGTH = 500
MIN_MARKDOWN_LENGTH = 100


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("page_id long, url string, html string").parquet(path)


def usable_pages(pages: DataFrame) -> DataFrame:
    """Pages long enough to matter that look like HTML."""
    html = F.col("html")
    looks_like_html = F.contains(html, F.lit("<html")) | F.contains(html, F.lit("<body")) | F.contains(html, F.lit("<!DOCTYPE"))
    return pages.filter((F.length(html) >= MIN_HTML_LENGTH) & looks_like_html)


def bucketed_pages(pages: DataFrame, table: str, buckets: int) -> None:
    """Pages saved bucketed by page_id, so the token operators start without an exchange."""
    pages.write.bucketBy(buckets, "page_id").sortBy("page_id").mode("overwrite").format("parquet").saveAsTable(table)


def append_pages(pages: DataFrame, path: str, site_buckets: int = 64, spread: int = 8) -> None:
    """Append to the page store, laid out by a fixed number of site buckets.

    A site holding a third of all pages still spreads over `spread` writers.
    """
    bucket = F.pmod(F.xxhash64(url_domain(F.col("url"))), F.lit(site_buckets)).cast("int")
    laid_out = pages.withColumn("site_bucket", bucket).withColumn("__salt", F.pmod(F.xxhash64("page_id"), F.lit(spread)))
    (
        laid_out.repartition("site_bucket", "__salt")
        .drop("__salt")
        .write.mode("append")
        .partitionBy("site_bucket")
        .parquet(path)
    )


def markdown_pages(docs: DataFrame, key: str = "doc_id", col: str = "markdown", description_chars: int | None = None) -> DataFrame:
    """Markdown-first pages: short or failed ones rejected, title, description (cut, if asked) and text derived."""
    md = F.col(col)
    kept = docs.filter(
        (F.length(md) >= MIN_MARKDOWN_LENGTH) & ~F.contains(md, F.lit("Error:")) & ~F.contains(md, F.lit("Failed to"))
    )
    blocks = F.filter(
        F.split(md, F.lit("\n\n")), lambda p: (T.js_trim(p) != "") & ~F.startswith(p, F.lit("#"))
    )
    return kept.select(
        key,
        T.js_trim(F.regexp_extract(md, r"(?m)^#[\t\n\x0B\f\r \x{00A0}]+(.+)$", 1)).alias("title"),
        F.coalesce(F.get(blocks, 0) if description_chars is None else F.substring(F.get(blocks, 0), 1, description_chars), F.lit("")).alias("description"),
        _plain(md).alias("text"),
    )


def _plain(md: Column) -> Column:
    # Markers removed from reader markdown, in this order.
    steps = [
        (r"(?m)^#+[\t\n\x0B\f\r \x{00A0}]+", ""), (r"\*\*|__", ""), (r"\*|_", ""),
        (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"!\[([^\]]*)\]\([^)]+\)", ""), (r"```[\s\S]*?```", ""), (r"`[^`]+`", ""),
    ]
    for pattern, replacement in steps:
        md = T.sub(md, pattern, replacement)
    return T.js_trim(md)


def longer_text(pipeline_text: Column, raw_text: Column, captured: Column | None = None) -> Column:
    """The pipeline text unless the raw text with captured payloads is at least as long."""
    other = raw_text if captured is None else F.concat(raw_text, F.coalesce(captured, F.lit("")))
    return F.when(F.length(pipeline_text) > F.length(other), pipeline_text).otherwise(other)


def site_document(pages: DataFrame, text: Column, order: Column, depth: Column, chunk: Column) -> DataFrame:
    """domain, part, pages, document: the pages of a site, in crawl order, under their headers.

    A site may hold a large share of all pages, so its document is written in parts:
    `chunk` cuts the crawl order into bounded pieces; reading the parts in order gives
    the whole document.
    """
    entry = F.concat(
        F.lit("\n--- Page: "), F.col("url"), F.lit(" (depth "), depth.cast("string"), F.lit(") ---\n"), text
    )
    rows = pages.select(
        url_domain(F.col("url")).alias("domain"), chunk.cast("long").alias("part"),
        F.struct(order.alias("ord"), entry.alias("entry")).alias("e"),
    )
    listed = F.array_sort(F.collect_list("e"))
    return rows.groupBy("domain", "part").agg(
        F.count("*").alias("pages"),
        F.array_join(F.transform(listed, lambda e: e["entry"]), "\n").alias("document"),
    )


def site_preamble(stats: DataFrame) -> DataFrame:
    """The statistics heading that goes before the first part of a crawl document."""
    rate = F.format_number(F.col("success_rate") * 100, 1)
    lines = [
        F.lit("# Crawl results\n"),
        F.concat(F.lit("**Pages visited:** "), F.col("visited").cast("string")),
        F.concat(F.lit("**Max depth reached:** "), F.col("max_depth").cast("string")),
        F.concat(F.lit("**Links discovered:** "), F.col("links").cast("string")),
        F.concat(F.lit("**Duplicates detected:** "), F.col("duplicates").cast("string")),
        F.concat(F.lit("**Success rate:** "), rate, F.lit("%")),
    ]
    return stats.select("*", F.concat_ws("\n", *lines).alias("preamble"))

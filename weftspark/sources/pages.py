"""Tables of crawled pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored_pages(rows: DataFrame, *keep: str) -> DataFrame:
    """Typed pages from stored strings, with the columns `keep` as they are; rows without a url, html or valid status are left out."""
    p = rows.select(*keep, F.col("normalized_url").alias("url"), "html", "content_type", F.col("status_code").try_cast("int").alias("status_code"), text.from_rfc1123(F.col("last_crawled")).alias("last_crawled"))
    return p.filter("url is not null and html is not null and status_code is not null")


def page_row(pages: DataFrame, *keep: str) -> DataFrame:
    """Pages as stored strings, with the columns `keep` as they are."""
    return pages.select(*keep, F.col("url").alias("normalized_url"), "html", "content_type", F.col("status_code").cast("string").alias("status_code"), text.to_rfc1123(F.col("last_crawled")).alias("last_crawled"))

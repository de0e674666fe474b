"""Captured pages: lookup by theatre, rating pages by subject id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions import fixed_values as fv
from marquee.operators.enrich import rating_page, subject_columns

SUBJECT_ID = r"/subject/(\d+)/"


def scan_pages(theaters: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per theatre and captured page; a theatre without a page has NULL page_id and html.

    Pages are joined with the small theatre table once, which Spark broadcasts when it is measured
    to be small; the HTML is not shuffled then. Theatres without a page come from a join on addresses alone.
    """
    addresses = pages.select(F.col("url").alias("schedule_url")).join(
        theaters.select("schedule_url").distinct(), "schedule_url", "left_semi").distinct()
    found = pages.withColumnRenamed("url", "schedule_url").join(theaters, "schedule_url")
    return found.unionByName(theaters.join(addresses, "schedule_url", "left_anti"), allowMissingColumns=True)


def subject_pages(pages: DataFrame) -> DataFrame:
    """Rating pages with their subject id."""
    return (pages
            .withColumn("id", F.regexp_extract("url", SUBJECT_ID, 1))
            .filter(F.col("id") != ""))


def scan_subjects(pages: DataFrame, wanted: DataFrame | None = None, reviews: int = fv.REVIEWS_KEPT) -> DataFrame:
    """Parsed rating pages, one row per id (the first capture by page_id).

    ``wanted`` (column id) limits the pages parsed, ``reviews`` the reviews kept of each. The HTML is parsed before the shuffle, so
    only the short fields move.
    """
    hits = subject_pages(pages)
    if wanted is not None:
        hits = hits.join(wanted.select("id").distinct(), "id", "left_semi")
    parsed = (hits.select("id", "page_id", rating_page(F.col("html")).alias("page"))
              .select("id", "page_id", F.struct(*subject_columns(F.col("page"), reviews)).alias("s")))
    return parsed.groupBy("id").agg(F.min_by("s", "page_id").alias("s")).select("id", "s.*")

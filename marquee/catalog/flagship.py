"""The flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.catalog.scans import scored_films
from marquee.functions.scoring import rank_label
from marquee.operators.rank import top_n


def top_films(spark: SparkSession, sf: str, n: int = 10) -> DataFrame:
    """Records merged by title, counted, scored, ranked; the first n with their theatres."""
    return top_n(scored_films(spark, sf), n).select(
        "rank", rank_label(F.col("rank")).alias("label"), "title_key", "title_jp", "title_cn", "screening_count",
        "rec_score", "theaters")

"""JSON export of the ranked films."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXPORT_COLUMNS = (
    "title_jp", "title_cn", "director", "cast", "year", "genre", "duration", "rating_score",
    "rating_votes", "rating_url", "recommendation_score", "screening_count", "is_new_release",
    "theaters", "short_reviews")


def export_rows(films: DataFrame) -> DataFrame:
    """The fifteen export fields, in order; theatres distinct and sorted."""
    return films.select(
        "title_jp", "title_cn", "director", "cast", "year", "genre", "duration",
        F.col("score").alias("rating_score"),
        F.col("votes").alias("rating_votes"),
        F.col("url").alias("rating_url"),
        F.col("rec_score").alias("recommendation_score"),
        "screening_count", "is_new_release",
        F.col("theater_names").alias("theaters"),
        F.col("reviews").alias("short_reviews"))


def export_json(films: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line in ranked order; the part files' name order keeps the order."""
    ranked = films.orderBy(F.desc("rec_score"), "first_seen.sched_ord", "first_seen.pos")
    export_rows(ranked).write.mode(mode).option("ignoreNullFields", False).json(path)

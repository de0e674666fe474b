"""Rating suggestions: a JSON list per query to one row per suggestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUGGESTIONS = "array<struct<id:string,type:string,year:string,rating:struct<value:string>>>"


def scan_candidates(responses: DataFrame, query: Column, payload: Column) -> DataFrame:
    """Suggestions in payload order; text that is not such a JSON list gives no rows."""
    rows = responses.select(query.alias("query"), F.posexplode(F.from_json(payload, SUGGESTIONS)).alias("pos", "c"))
    return rows.filter(F.col("c").isNotNull()).select(
        "query", "pos",
        F.coalesce("c.id", F.lit("")).alias("id"),
        F.coalesce("c.type", F.lit("")).alias("type"),
        F.coalesce("c.year", F.lit("")).alias("year"),
        F.col("c.rating").isNotNull().alias("has_rating"),
        F.col("c.rating.value").alias("rating"))

"""Theatre dimension: chain location lists to one table with schedule addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions import fixed_values as fv
from marquee.functions.html import resolve_url
from marquee.functions.text import fill

# Chains keep their order; a chain has room for this many theatres (ord is an int).
CHAIN_STRIDE = 1 << 32
LOCATION_SCHEMA = "ord int, theater_id string, theater_name string, base_url string, schedule_path string"


def _theaters(locations: DataFrame, source: str, chain_no: int, base: Column, url: Column,
              enabled: Column) -> DataFrame:
    return locations.filter(enabled).select(
        F.lit(source).alias("source"),
        (F.lit(chain_no * CHAIN_STRIDE).cast("long") + F.col("ord")).alias("sched_ord"),
        F.coalesce(F.col("theater_id"), F.lit("")).alias("theater_id"),
        "theater_name",
        base.alias("base_url"),
        url.alias("schedule_url"),
        F.lit(True).alias("enabled"))


def chain_theaters(locations: DataFrame, source: str, chain_no: int, base_url: str, path: str,
                   enabled: Column | bool = True) -> DataFrame:
    """Theatres whose schedule address is base + path pattern with the theatre's id."""
    url = F.concat(F.lit(base_url), fill(path, theater_id=F.col("theater_id")))
    return _theaters(locations, source, chain_no, F.lit(base_url), url, _as_column(enabled))


def independent_theaters(locations: DataFrame, source: str, chain_no: int,
                         enabled: Column | bool = True) -> DataFrame:
    """Theatres with their own site; the schedule path is resolved against it ('/' if none is given)."""
    url = resolve_url(F.col("base_url"), F.coalesce("schedule_path", F.lit("/")))
    return _theaters(locations, source, chain_no, F.col("base_url"), url, _as_column(enabled))


def theater_dim(spark: SparkSession, config: dict) -> DataFrame:
    """All enabled theatres of a configuration, chain A, chain B, independents."""

    def locations(chain: dict) -> DataFrame:
        rows = [(i, loc.get("id"), loc["name"], loc.get("url"), loc.get("schedule_path"))
                for i, loc in enumerate(chain.get("locations", []))]
        return spark.createDataFrame(rows, LOCATION_SCHEMA)

    a, b, own = (config.get(k, {}) for k in ("toho", "united", "independent"))
    return (
        chain_theaters(locations(a), fv.CHAIN_A_SOURCE, 0, a.get("base_url", fv.CHAIN_A_BASE),
                       fv.CHAIN_A_PATH, bool(a.get("enabled")))
        .unionByName(chain_theaters(locations(b), fv.CHAIN_B_SOURCE, 1, b.get("base_url", fv.CHAIN_B_BASE),
                                    fv.CHAIN_B_PATH, bool(b.get("enabled"))))
        .unionByName(independent_theaters(locations(own), fv.INDEPENDENT_SOURCE, 2, bool(own.get("enabled"))))
    )


def _as_column(flag: Column | bool) -> Column:
    return flag if isinstance(flag, Column) else F.lit(flag)

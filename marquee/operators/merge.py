"""Merging equal titles of all sources, and what the merged film's showings say.

Groups are aggregated partially before every shuffle, so a title that holds a large part of
all rows reaches its task as one row per map task.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions import fixed_values as fv
from marquee.functions.text import normalize_title
from marquee.operators.stages import stage

FIRST_SEEN = ("sched_ord", "pos")
STATS = ("screening_count", "dated", "this_week", "next_week")
THEATER_COUNT = "theater_count"  # in the statistics where it is asked for


def with_title_key(df: DataFrame) -> DataFrame:
    return df.withColumn("title_key", normalize_title(F.col("title_jp")))


def first_value(column: str, missing: str = "", order: tuple[str, ...] = FIRST_SEEN) -> Column:
    """First value of a group, in order, that is not the missing mark; the mark if none."""
    ordering = F.when(F.col(column) != missing, F.struct(*order))
    return F.coalesce(F.min_by(F.col(column), ordering), F.lit(missing))


def merge_titles(films: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """One film per title key: the first-seen record's fields, the first poster there is."""
    scope = scope or []
    has_poster = "poster_url" in films.columns
    keyed = _first_records(with_title_key(films), [*scope, "title_key"], has_poster)
    fields = [c for c in films.columns if c not in (*scope, "poster_url", "title_key")]
    aggregates = [F.min_by(F.struct(*fields), F.struct(*FIRST_SEEN)).alias("f")]
    if has_poster:
        aggregates.append(first_value("poster_url").alias("poster_url"))
    return (keyed.groupBy(*scope, "title_key").agg(*aggregates)
            .select(*scope, "title_key", F.struct("f.sched_ord", "f.pos").alias("first_seen"),
                    *[F.col(f"f.{c}").alias(c) for c in fields if c not in FIRST_SEEN],
                    *(["poster_url"] if has_poster else [])))


def _first_records(films: DataFrame, keys: list[str], has_poster: bool) -> DataFrame:
    """A group's records at its first place, and at its first place with a poster: no others can be the first seen.

    Whole records can be grouped by sorting only. Places are numbers, which a hash table holds; the first ones are written and
    read back, so that Spark knows their size before it plans the join. Broadcast, they leave about a record per group and task
    to sort, wherever a title's records lie. ``films`` is read twice.
    """
    order = F.col("sched_ord").cast("decimal(19,0)") * F.lit(Decimal(10 ** 19)) + F.col("pos").cast("decimal(19,0)")
    first = [F.min(order).alias("_first")]
    if has_poster:
        first.append(F.min(F.when(F.col("poster_url") != "", order)).alias("_first_poster"))
    known = stage(films.groupBy(*keys).agg(*first), "first_places")
    named = known.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in known.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    wanted = order.isNull() | (order == F.col("_first"))  # NULL comes before all others
    if has_poster:
        wanted = wanted | (order == F.col("_first_poster"))
    return films.join(named, same).filter(wanted).select(*films.columns)


def screening_counts(screenings: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Showings per title key; nothing is deduplicated.

    Counted per written title first, so that the key is computed once per title, not per showing.
    """
    scope = scope or []
    per_title = screenings.groupBy(*scope, "title_jp").agg(F.count("*").alias("n"))
    return with_title_key(per_title).groupBy(*scope, "title_key").agg(F.sum("n").alias("screening_count"))


def film_stats(screenings: DataFrame, scope: list[str] | None = None, week_start: Column | None = None,
               showings: Column | None = None, theater_count: bool = False) -> DataFrame:
    """Per film: showing count, theatre list, known dates, showings this and next week.

    Two levels: (written title, theatre) first, which spreads a hot film over many tasks and
    leaves few titles to normalise, then film. What is collected last are distinct theatre names.
    ``showings`` is the number of showings a row stands for, 1 if not given. ``theater_count`` adds the number of distinct
    theatres, counted per (title, theatre) on all tasks: a reader that needs no names takes it instead of the list's size, and
    Spark then leaves out the list, which for a hot film holds all its theatres in one task.
    """
    scope = scope or []
    n = F.lit(1).cast("long") if showings is None else showings
    day = F.lit(None).cast("int") if week_start is None else F.datediff("show_date", week_start)
    rows = screenings.select(*scope, "title_jp", "theater_name", "show_date", n.alias("n"), day.alias("day"))

    def counted(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    per_theater = rows.groupBy(*scope, "title_jp", "theater_name").agg(
        F.sum("n").alias("n"), counted(F.col("show_date").isNotNull()).alias("dated"),
        counted(F.col("day").between(0, 6)).alias("this_week"), counted(F.col("day").between(7, 13)).alias("next_week"))
    counts = [F.count_distinct("theater_name").alias(THEATER_COUNT)] if theater_count else []
    return (with_title_key(per_theater).groupBy(*scope, "title_key").agg(
        F.sum("n").alias("screening_count"), F.sum("dated").alias("dated"),
        F.sum("this_week").alias("this_week"), F.sum("next_week").alias("next_week"), *counts,
        F.array_sort(F.collect_set("theater_name")).alias("theater_names"))
        .withColumn("theaters", F.array_join("theater_names", fv.THEATER_SEPARATOR)))


def with_stats(films: DataFrame, stats: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Merged films with their statistics; films without showings get zeros and no theatres."""
    counts = [*STATS, *[c for c in stats.columns if c == THEATER_COUNT]]
    own = [c for c in films.columns if c in (*counts, "theater_names", "theaters")]
    joined = films.drop(*own).join(stats, [*(scope or []), "title_key"], "left")
    none = F.expr("cast(array() as array<string>)")
    return joined.withColumns({
        **{c: F.coalesce(c, F.lit(0)) for c in counts},
        "theater_names": F.coalesce("theater_names", none), "theaters": F.coalesce("theaters", F.lit(""))})


def theater_list(screenings: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct theatre names per key, sorted by code point and joined."""
    distinct = screenings.select(*keys, "theater_name").distinct()
    return distinct.groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_list("theater_name")), fv.THEATER_SEPARATOR).alias("theaters"))

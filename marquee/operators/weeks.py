"""Films of the week: membership by showing dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions.dates import as_date, next_week_start, week_start
from marquee.operators.merge import film_stats, with_stats
from marquee.operators.rank import top_n_per_group


def is_this_week():
    """A showing in the week, or no known date at all."""
    return (F.col("this_week") > 0) | (F.col("dated") == 0)


def is_next_week():
    """A showing in the next week; films without dates do not count."""
    return F.col("next_week") > 0


def with_weeks(films: DataFrame, screenings: DataFrame, day, scope: list[str] | None = None) -> DataFrame:
    """Merged films with statistics relative to the week that holds ``day``."""
    return with_stats(films, film_stats(screenings, scope, week_start(day)), scope)


def this_week(films: DataFrame) -> DataFrame:
    return films.filter(is_this_week())


def next_week(films: DataFrame) -> DataFrame:
    return films.filter(is_next_week())


def next_week_preview(films: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    """The first n of next week's films, per key, in rank order."""
    return top_n_per_group(next_week(films), keys, n)


def in_week(screenings: DataFrame, day, next_one: bool = False) -> DataFrame:
    """Showings with a date in the week of ``day`` or in the week after; prunes at the scan."""
    start = next_week_start(day) if next_one else week_start(as_date(day))
    return screenings.filter(F.col("show_date").between(start, F.date_add(start, 6)))

"""Date columns. Every rule that needs "today" takes it as ``as_of``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.functions.text import ascii_digits

MONTH_DAY = r"(\d{1,2})/(\d{1,2})"


def as_date(value) -> Column:
    """Date column from a Column, date or 'yyyy-mm-dd'."""
    if isinstance(value, Column):
        return value
    return F.lit(value if isinstance(value, dt.date) else dt.date.fromisoformat(value))


def parse_month_day(c: Column, as_of, year: Column | None = None) -> Column:
    """First M/D in the text as a date near ``as_of``; NULL if none or not a real date.

    A January date read in December belongs to the next year.
    """
    today = as_date(as_of)
    base_year = F.year(today) if year is None else year
    text = ascii_digits(c)
    month = F.regexp_extract(text, MONTH_DAY, 1).try_cast("int")
    rolls_over = (F.month(today) == 12) & (month == 1)
    full_year = base_year + F.when(rolls_over, 1).otherwise(0)
    month_day = F.replace(F.regexp_extract(text, MONTH_DAY, 0), F.lit("/"), F.lit("-"))
    return F.concat(full_year.cast("string"), F.lit("-"), month_day).try_cast("date")


def is_recent(show_date: Column, as_of, days: int = 7) -> Column:
    """True when the date is at most ``days`` before ``as_of`` or later; NULL when unknown."""
    return show_date >= F.date_sub(as_date(as_of), days)


def date_wanted(show_date: Column, dates) -> Column:
    """Keep a showing unless a list is given, its date is known and not in the list."""
    if not dates:
        return F.lit(True)
    return show_date.isNull() | show_date.isin([dt.date.fromisoformat(d) if isinstance(d, str) else d
                                                for d in dates])


def week_start(d) -> Column:
    """Monday of the week that holds ``d``."""
    return F.date_trunc("week", as_date(d)).cast("date")


def week_end(d) -> Column:
    return F.date_add(week_start(d), 6)


def next_week_start(d) -> Column:
    return F.date_add(week_start(d), 7)


def next_week_end(d) -> Column:
    return F.date_add(week_start(d), 13)


def date_label(d: Column) -> Column:
    """'4月13日', no padding."""
    return F.concat(F.month(d).cast("string"), F.lit("月"), F.dayofmonth(d).cast("string"), F.lit("日"))

"""Text columns of the report: stars, reviews, film blocks, ranking rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.functions import fixed_values as fv
from marquee.functions.text import (
    display_title, fill, fixed_decimals, or_default, short_title)


def stars(score: Column) -> Column:
    """Five-place star string with the rating behind it."""
    known = F.coalesce(score, F.lit(0.0))
    halves = known / F.lit(2)
    full = F.floor(halves).cast("int")
    half = F.when(halves - full >= 0.5, 1).otherwise(0)
    text = F.concat(
        F.repeat(F.lit("★"), full),
        F.repeat(F.lit("☆"), half),
        F.repeat(F.lit("　"), F.lit(5) - full - half),
        F.lit("  "), fixed_decimals(known, 1))
    return F.when(known == 0, F.lit(fv.NO_RATING)).otherwise(text)


def rating_text(score: Column) -> Column:
    known = F.coalesce(score, F.lit(0.0))
    return F.when(known == 0, F.lit(fv.MISSING)).otherwise(fixed_decimals(known, 1))


def review_block(reviews: Column, shown: int) -> Column:
    """The first reviews as quote lines, each ended by a newline; '' when there is none."""
    lines = F.transform(F.slice(reviews, 1, shown), lambda r: F.concat(F.lit(fv.REVIEW_PREFIX), r, F.lit("\n")))
    return F.coalesce(F.array_join(lines, ""), F.lit(""))


def movie_block(film: dict[str, Column], reviews_shown: int, prefix: Column | None = None,
                template: str = fv.FILM_BLOCK) -> Column:
    """Heading and table of one film; ``film`` maps the schema's names to columns."""
    return fill(
        template,
        prefix=F.lit(fv.FILM_PREFIX) if prefix is None else prefix,
        display_title=display_title(film["title_jp"], film["title_cn"]),
        title_jp=film["title_jp"],
        stars=stars(film["score"]),
        url=or_default(film["url"], fv.RATING_SITE),
        director=or_default(film["director"], fv.MISSING),
        cast=or_default(film["cast"], fv.MISSING),
        genre=or_default(film["genre"], fv.MISSING),
        theaters=or_default(film["theaters"], fv.MISSING),
        reviews=review_block(film["reviews"], reviews_shown))


def ranking_row(label: Column, film: dict[str, Column], template: str = fv.RANKING_ROW) -> Column:
    return fill(
        template,
        label=label,
        title=short_title(film["title_jp"], film["title_cn"]),
        score=fixed_decimals(film["rec_score"], 0),
        rating=rating_text(film["score"]),
        theaters=or_default(film["theaters"], fv.MISSING))


def issue_title(template: str, issue_number: Column, start_label: Column, end_label: Column) -> Column:
    """Replace the three placeholders of a title template."""
    c = F.lit(template)
    for name, value in (("issue_number", issue_number.cast("string")), ("week_start", start_label),
                        ("week_end", end_label)):
        c = F.replace(c, F.lit("{" + name + "}"), value)
    return c


def top_summary_line(rank: Column, title_jp: Column, title_cn: Column, score: Column,
                     rec: Column) -> Column:
    known = F.coalesce(score, F.lit(0.0))
    rating = F.when(known == 0, F.lit(fv.TOP_SUMMARY_NO_RATING)).otherwise(
        fill(fv.TOP_SUMMARY_RATING, rating=known))
    return fill(fv.TOP_SUMMARY, rank=rank, title=short_title(title_jp, title_cn), rating=rating,
                score=fixed_decimals(rec, 0))

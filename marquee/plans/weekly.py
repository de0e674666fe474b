"""The weekly job: captured pages and ratings to ranked films and reports, many issues at once.

Film and showing tables carry ``issue_number``: one issue is one capture of all theatres.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions.dates import week_start
from marquee.operators.enrich import best_match, enrich
from marquee.operators.extract import all_rules, extract_pages, match_rules, page_movies, page_screenings
from marquee.operators.merge import film_stats, merge_titles, with_stats
from marquee.operators.rank import with_score
from marquee.operators.report import ReportOptions, issue_document, issue_parts
from marquee.operators.stages import shared_dir, stage, stage_folder  # noqa: F401

SCOPE = ["issue_number"]
# Film columns no page carries; '' and 0 mean missing.
UNRATED = {
    "title_cn": "''", "director": "''", "cast": "''", "genre": "''", "url": "''", "year": "0",
    "duration": "0", "score": "0D", "votes": "0L", "reviews": "cast(array() as array<string>)"}


def extract_all(pages: DataFrame, as_of, profiles: dict | None = None, generic: dict | None = None, rules: DataFrame | None = None) -> DataFrame:
    """Film rows of all pages (source, sched_ord, theater_name, base_url, html); sched_ord carries the chains' order.

    Each page is read once, by the first rule of its source that fits its address. ``rules`` (see ``rule_table``) replaces the known ones.
    """
    known = all_rules(pages.sparkSession, profiles, generic) if rules is None else rules
    return extract_pages(match_rules(pages, known), as_of)


def raw_tables(page_films: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(films, showings) of extracted pages, in the shape the merge works on."""
    films = page_movies(page_films, [*SCOPE, "sched_ord", "theater_name"]).select(
        "*", *[F.expr(value).alias(c) for c, value in UNRATED.items()])
    return films, page_screenings(page_films)


def rate(films: DataFrame, candidates: DataFrame, subjects: DataFrame) -> DataFrame:
    """Enrich merged films; a title shown in many issues is looked up once."""
    keyed = films.withColumn("lookup", F.struct("title_jp", "year"))
    titles = keyed.select("lookup", "title_jp", "year").distinct()
    return enrich(keyed, best_match(titles, candidates, "lookup"), subjects, "lookup").drop("lookup")


def weekly_stats(screenings: DataFrame, issues: DataFrame) -> DataFrame:
    """Statistics of every issue's films relative to the issue's week.

    Showings that carry week_start need no join. Others are counted per day first: the join with
    the issues then moves one row per title, theatre and day.
    """
    if "week_start" in screenings.columns:
        return film_stats(screenings, SCOPE, week_start(F.col("week_start")))
    per_day = screenings.groupBy(*SCOPE, "title_jp", "theater_name", "show_date").agg(F.count("*").alias("showings"))
    dated = per_day.join(issues.select("issue_number", "week_start"), "issue_number")
    return film_stats(dated, SCOPE, week_start(F.col("week_start")), F.col("showings"))


def scored_films(films: DataFrame, screenings: DataFrame, issues: DataFrame,
                 weights: dict[str, float] | None = None) -> DataFrame:
    """Merged, counted and scored films of every issue, with week statistics."""
    merged = films if "title_key" in films.columns else merge_titles(films, SCOPE)
    return with_score(with_stats(merged, weekly_stats(screenings, issues), SCOPE), weights)


def generate_reports(films: DataFrame, screenings: DataFrame, issues: DataFrame,
                     options: ReportOptions | None = None, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, ranked films) of every issue; scored films are written as in ``weekly_job``."""
    o = options or ReportOptions()
    scored = stage(scored_films(films, screenings, issues, o.weights), "scored_films", folder)
    return issue_document(issues, scored, o), scored


def weekly_job(theater_pages: DataFrame, candidates: DataFrame, subjects: DataFrame | None, issues: DataFrame,
               as_of, options: ReportOptions | None = None, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(document parts, ranked films) from captured pages; ``subjects=None`` skips the ratings.

    Extracted and scored films are written below ``folder``, by default a new ``stage_folder``; the results read them from there.
    """
    o, folder = options or ReportOptions(), folder or stage_folder(theater_pages.sparkSession)
    page_films = stage(extract_all(theater_pages, as_of), "page_films", folder)
    raw, screenings = raw_tables(page_films)
    merged = merge_titles(raw.drop("screening_count"), SCOPE)
    rated = merged if subjects is None else rate(merged, candidates, subjects)
    scored = stage(scored_films(rated, screenings, issues, o.weights), "scored_films", folder)
    return issue_parts(issues, scored, o), scored

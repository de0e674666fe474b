"""Enrichment: best rating record per film, then overlay of the rating page's fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions import fixed_values as fv
from marquee.functions.html import STRIPPED, TEXT, select_fields
from marquee.functions.text import (
    ascii_digits, clean_text, fill, first_token, join_names, lookup_query, missing_as_null, strip_text)


# ---- parsing of a rating page: its elements are read in one walk, what they say are columns over their texts

RATING_FIELDS = {
    "rating": ("strong.rating_num", STRIPPED), "votes": ("span[property='v:votes']", STRIPPED), "directors": ("a[rel='v:directedBy']", STRIPPED),
    "cast": ("a[rel='v:starring']", STRIPPED), "genres": ("span[property='v:genre']", STRIPPED), "year": ("span.year", TEXT),
    "runtime": ("span[property='v:runtime']", TEXT), "item": ("span[property='v:itemreviewed']", TEXT), "heading": ("h1 span", TEXT),
    "reviews": (".comment-item .short", TEXT)}


def rating_page(html: Column, *names: str) -> Column:
    """The texts of a rating page's elements (or of the named ones), as struct<name: array<string>>."""
    return select_fields(html, {n: RATING_FIELDS[n] for n in names or RATING_FIELDS})


def _first(texts: Column) -> Column:
    return F.coalesce(F.get(texts, F.lit(0)), F.lit(""))


def parse_rating(page: Column) -> tuple[Column, Column]:
    """(score, votes): 0 where the page has none or no number."""
    digits = F.regexp_replace(ascii_digits(_first(page["votes"])), r"\D", "")
    return F.coalesce(_first(page["rating"]).try_cast("double"), F.lit(0.0)), F.coalesce(digits.try_cast("long"), F.lit(0).cast("long"))


def parse_people(page: Column, cast_shown: int = fv.CAST_SHOWN) -> tuple[Column, Column, Column]:
    """(director, cast, genre): names joined by ' / ', the cast cut to its first names."""
    return join_names(page["directors"]), join_names(page["cast"], cast_shown), join_names(page["genres"])


def first_number(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract(ascii_digits(text), pattern, 0).try_cast("int"), F.lit(0))


def parse_year_duration(page: Column) -> tuple[Column, Column]:
    """(year, duration): first four digits, first run of digits; 0 where absent."""
    return first_number(_first(page["year"]), r"\d{4}"), first_number(_first(page["runtime"]), r"\d+")


def local_title(page: Column) -> Column:
    """First word of the reviewed item's name, else of the heading; NULL if neither exists."""
    return first_token(F.coalesce(F.get(page["item"], F.lit(0)), F.get(page["heading"], F.lit(0))))


def top_reviews(texts: Column, n: int = fv.REVIEWS_KEPT) -> Column:
    """First n texts that are not empty, order kept."""
    return F.slice(F.filter(texts, lambda t: t != ""), 1, n)


def first_reviews(reviews: DataFrame, keys: list[str], order: str, text: str, n: int = fv.REVIEWS_KEPT) -> DataFrame:
    """First n non-empty cleaned texts per key from a table of reviews, numbered from 1.

    The window's limit is applied on every task before the shuffle, so a key with very many
    reviews moves only n rows per task.
    """
    cleaned = reviews.withColumn(text, clean_text(F.col(text))).filter(F.col(text) != "")
    place = Window.partitionBy(*keys).orderBy(order)
    return cleaned.withColumn("n", F.row_number().over(place)).filter(F.col("n") <= n).select(*keys, "n", text)


def subject_columns(page: Column, reviews: int = fv.REVIEWS_KEPT) -> list[Column]:
    score, votes = parse_rating(page)
    director, cast, genre = parse_people(page)
    year, duration = parse_year_duration(page)
    return [local_title(page).alias("title_cn"), director.alias("director"), cast.alias("cast"),
            genre.alias("genre"), year.alias("year"), duration.alias("duration"), score.alias("score"),
            votes.alias("votes"), top_reviews(F.transform(page["reviews"], clean_text), reviews).alias("reviews")]


# ---- lookup

def quick_rating(value: Column) -> Column:
    """Rating of a suggestion: 0 if missing or empty, NULL (no new rating) if it is no number."""
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit(0.0)).otherwise(value.try_cast("double"))


def thin_candidates(candidates: DataFrame) -> DataFrame:
    """Keep, per query, type class and year, the first candidate: no other can ever be chosen.

    The ranking limit runs before the shuffle, so a query that holds a large part of all
    candidates is cut on every task and reaches the join with one row per year.
    """
    first = Window.partitionBy("query", "_wanted", "year").orderBy("pos")
    return (candidates.withColumn("_wanted", F.col("type") == fv.WANTED_TYPE)
            .withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "_wanted"))


def lookup_attempts(films: DataFrame, key: str) -> DataFrame:
    """The queries to try for a film: title with year, then title alone."""
    queries = F.array_distinct(F.array(lookup_query(F.col("title_jp"), F.col("year")), F.col("title_jp")))
    return films.select(key, F.col("year").alias("film_year"), F.posexplode(queries).alias("attempt", "query"))


def two_stage_lookup(films: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """Candidates of the first attempt that has any, per film.

    Which attempts have any is decided on the distinct queries, so the candidates themselves are
    joined once.
    """
    asked = candidates.select("query").distinct()
    answered = lookup_attempts(films, key).join(asked, "query", "left_semi")
    first = answered.groupBy(key).agg(F.min_by(F.struct("film_year", "attempt", "query"), "attempt").alias("a"))
    return first.select(key, "a.*").join(candidates, "query")


def best_match(films: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """One candidate per film: earliest attempt, wanted type first, then year, then list order.

    The attempt leads the ordering, which makes the two-stage lookup a single join.
    """
    hits = lookup_attempts(films, key).join(thin_candidates(candidates), "query")
    return pick_best(hits, [key], [F.col("attempt")], F.col("film_year"))


def pick_best(hits: DataFrame, keys: list[str], lead: list[Column], year: Column) -> DataFrame:
    """First row per key by (lead, wrong type, wrong year, pos)."""
    wrong_type = F.when(F.col("type") == fv.WANTED_TYPE, 0).otherwise(1)
    right_year = (F.coalesce(year, F.lit(0)) == 0) | F.contains(F.col("year"), year.cast("string"))
    wrong_year = F.when(right_year, 0).otherwise(1)
    order = Window.partitionBy(*keys).orderBy(*lead, wrong_type, wrong_year, "pos")
    return hits.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


# ---- overlay

def overlay(found: Column, rules: dict[str, tuple[Column, Column, str]]) -> dict[str, Column]:
    """Column per name from (old, new, rule), applied where ``found``.

    ``always`` takes the new value, ``known`` only when it is neither NULL, '' nor 0.
    """
    out = {}
    for name, (old, new, rule) in rules.items():
        if rule == "known":
            empty = F.lit(0) if name in ("year", "duration", "score", "votes") else F.lit("")
            new = F.coalesce(F.nullif(new, empty), old)
        out[name] = F.when(found, new).otherwise(old)
    return out


PAGE_RULES = {
    "title_cn": "known", "director": "always", "cast": "always", "genre": "always", "year": "known",
    "duration": "known", "score": "known", "votes": "always", "reviews": "always"}


def enrich(films: DataFrame, matches: DataFrame, subjects: DataFrame, key: str) -> DataFrame:
    """Overlay matches (key, id, has_rating, rating) and their pages on the films.

    A film without a match or with an empty id stays as it is. A match alone sets id, url and
    the quick rating; its page then overwrites by PAGE_RULES. Films must be merged first, so
    that each is looked up once.
    """
    page = subjects.select(F.col("id").alias("rating_id"), F.lit(True).alias("p_found"),
                           *[F.col(c).alias(f"p_{c}") for c in PAGE_RULES])
    match = matches.filter(F.col("id") != "").select(
        key, F.col("id").alias("rating_id"),
        F.when(F.col("has_rating"), quick_rating(F.col("rating"))).alias("m_score"))
    base = films.drop("rating_id")
    # Matches meet their pages first: only matched films take part, so no NULL id gathers the others.
    joined = base.join(match.join(page, "rating_id", "left"), key, "left")
    found = F.col("p_found")
    quick = F.coalesce("m_score", "score")
    rules = {c: (quick if c == "score" else F.col(c), F.col(f"p_{c}"), rule) for c, rule in PAGE_RULES.items()}
    new = overlay(found, rules)
    new["url"] = F.when(F.col("rating_id").isNotNull(), fill(fv.SUBJECT_URL, id=F.col("rating_id"))).otherwise(
        F.col("url"))
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in base.columns],
                         F.coalesce("rating_id", F.lit("")).alias("rating_id"))


def enrich_all(films: DataFrame, candidates: DataFrame, subjects: DataFrame, key: str = "title_key",
               skip: bool = False) -> DataFrame:
    """Lookup and overlay of merged films; ``skip`` leaves them unrated."""
    return films if skip else enrich(films, best_match(films, candidates, key), subjects, key)

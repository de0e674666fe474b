"""Report assembly for many issues at once.

A document is first a table of ordered parts (issue_number, part_key, text): the scalable form,
which ``write_issues`` stores without ever holding an issue in one row. ``issue_document``
joins the parts of each issue to one string for consumers that need it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions import fixed_values as fv
from marquee.functions.archive_text import issue_filename
from marquee.functions.dates import date_label, next_week_end, next_week_start, week_end, week_start
from marquee.functions.report_text import issue_title, movie_block, ranking_row
from marquee.functions.scoring import rank_label
from marquee.functions.text import fill
from marquee.operators.rank import top_n_per_group
from marquee.operators.weeks import is_next_week, is_this_week, next_week_preview, this_week

FILM_COLUMNS = ("title_jp", "title_cn", "score", "url", "director", "cast", "genre", "theaters", "reviews",
                "rec_score")


@dataclass
class ReportOptions:
    """Wording and limits of a report."""

    title_template: str = "第{issue_number}期｜{week_start} ~ {week_end}"
    subtitle: str = ""
    footer: str = ""
    top_n: int = 10
    reviews_to_show: int = 3
    include_next_week: bool = True
    weights: dict = field(default_factory=dict)


def film_columns() -> dict[str, Column]:
    return {c: F.col(c) for c in FILM_COLUMNS}


def part_key(section: int, score: Column | None = None, sched_ord: Column | None = None,
             pos: Column | None = None) -> Column:
    """Sortable place of a part: section, then rank order inside it."""
    zero = F.lit(0)
    return F.struct(
        F.lit(section).alias("section"),
        (-(F.lit(0.0) if score is None else score)).alias("order_score"),
        (zero if sched_ord is None else sched_ord).cast("long").alias("sched_ord"),
        (zero if pos is None else pos).cast("long").alias("pos"))


def film_parts(films: DataFrame, section: int, reviews: int) -> DataFrame:
    """One part per film of a section, in rank order."""
    return films.select(
        "issue_number",
        part_key(section, F.col("rec_score"), F.col("first_seen.sched_ord"), F.col("first_seen.pos")).alias("part_key"),
        movie_block(film_columns(), reviews).alias("text"))


def ranking_parts(films: DataFrame, section: int, top_n: int) -> DataFrame:
    """One part per row of the ranking table."""
    top = top_n_per_group(films, ["issue_number"], top_n)
    return top.select("issue_number", part_key(section, pos=F.col("rank")).alias("part_key"),
                      ranking_row(rank_label(F.col("rank")), film_columns()).alias("text"))


def issue_labels(issues: DataFrame, options: ReportOptions) -> DataFrame:
    """Issues (issue_number, week_start) with title and date labels."""
    w = F.col("week_start")
    return (issues.withColumn("week_start", week_start(w))
            .withColumn("start_label", date_label(w))
            .withColumn("end_label", date_label(week_end(w)))
            .withColumn("next_start_label", date_label(next_week_start(w)))
            .withColumn("next_end_label", date_label(next_week_end(w)))
            .withColumn("title", issue_title(options.title_template, F.col("issue_number"),
                                             F.col("start_label"), F.col("end_label"))))


def fixed_parts(issues: DataFrame, films: DataFrame, o: ReportOptions) -> DataFrame:
    """Head, section headings and footer of every issue, from one row per issue."""
    labels = issue_labels(issues, o)
    filled = films.groupBy("issue_number").agg(
        F.count("*").alias("ranked"), F.count_if(is_this_week()).alias("now"), F.count_if(is_next_week()).alias("coming"))
    head = labels.join(filled, "issue_number", "left").fillna(0, ["ranked", "now", "coming"])
    c = {n: F.col(n) for n in head.columns}

    def blank_line_if_empty(count: Column) -> Column:
        return F.when(count == 0, F.lit("\n")).otherwise(F.lit(""))

    texts = [
        (1, fill(fv.ISSUE_HEAD, title=c["title"], subtitle=F.lit(o.subtitle), week_start=c["start_label"],
                 week_end=c["end_label"])),
        (3, F.concat(blank_line_if_empty(c["now"]), fill(fv.RANKING_HEAD, top_n=F.lit(o.top_n)),
                     F.lit("\n" + fv.RANKING_HEADER), blank_line_if_empty(c["ranked"]))),
        (7, F.lit(fv.FOOTER_RULE + "\n" + o.footer)),
    ]
    if o.include_next_week:
        heading = fill(fv.NEXT_WEEK_HEAD, next_start=c["next_start_label"], next_end=c["next_end_label"])
        texts.append((5, F.when(c["coming"] > 0, heading)))
    parts = F.array(*[F.struct(part_key(section).alias("part_key"), text.alias("text")) for section, text in texts])
    return head.select("issue_number", F.explode(parts).alias("p")).select("issue_number", "p.*").filter(
        F.col("text").isNotNull())


def issue_parts(issues: DataFrame, films: DataFrame, options: ReportOptions | None = None) -> DataFrame:
    """All parts of all issues; films carry issue_number, rank columns and week statistics.

    Joined with newlines in part_key order, an issue's parts are its document. An issue without
    films still has its fixed parts. ``films`` is read once per section: stage it first.
    """
    o = options or ReportOptions()
    parts = (fixed_parts(issues, films, o)
             .unionByName(film_parts(this_week(films), 2, o.reviews_to_show))
             .unionByName(ranking_parts(films, 4, o.top_n)))
    if o.include_next_week:
        coming = next_week_preview(films, ["issue_number"], fv.NEXT_WEEK_SHOWN)
        parts = parts.unionByName(film_parts(coming, 6, fv.NEXT_WEEK_REVIEWS))
    return parts


def section_text(parts: DataFrame, keys: list[str], order: str, text: str = "text",
                 separator: str = "\n") -> DataFrame:
    """Texts of a group joined in order. Cut the rows (top n, this week) before joining them."""
    gathered = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("_p"))
    return gathered.select(*keys, F.array_join(F.col("_p")[text], separator).alias(text))


def issue_document(issues: DataFrame, films: DataFrame, options: ReportOptions | None = None) -> DataFrame:
    """(issue_number, week_start, markdown): the whole document of each issue in one string.

    By definition this holds one issue in one row. Use ``issue_parts`` where an issue may be
    larger than a string should be.
    """
    text = section_text(issue_parts(issues, films, options), ["issue_number"], "part_key")
    return issues.join(text, "issue_number", "left").select(
        "issue_number", week_start(F.col("week_start")).alias("week_start"),
        F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("markdown"))


def named_parts(issues: DataFrame, parts: DataFrame, day: Column) -> DataFrame:
    """Parts with the archive name of their issue, ready for ``write_issues``."""
    names = issues.select("issue_number", issue_filename(F.col("issue_number"), day).alias("file_name"))
    return parts.join(names, "issue_number").select("file_name", "part_key", "text")

"""Scoring and ranking of merged films. Ties keep first-seen order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions.report_text import top_summary_line
from marquee.functions.scoring import rec_score

# Positions per block in rank_all: the most rows of one position range numbered together.
BLOCK = 4096


def with_score(films: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    return films.withColumn("rec_score", rec_score(
        F.col("score"), F.col("votes"), F.col("screening_count"), F.col("is_new_release"), weights))


def rank_order(films: DataFrame) -> list[Column]:
    return [F.desc("rec_score"), F.col("first_seen.sched_ord").asc(), F.col("first_seen.pos").asc()]


def rank_all(films: DataFrame, block: int = BLOCK, keys: list[str] | None = None) -> DataFrame:
    """Adds the rank over all films, or over those of each key, without one task sorting them all.

    A film's rank is the films in better scores, plus those in earlier blocks of the same
    score, plus its place in its block. Blocks are (score, source, range of positions), so even
    a score shared by a third of all films is numbered in bounded pieces. Counts are hash
    aggregates; the running sum over scores sees one row per distinct score, which two decimals
    keep to some thousands. Unknown scores and positions rank as any other value (NULL scores last). ``films`` is read twice: stage it first when it is costly.
    """
    keys = keys or []
    cell = films.withColumn("_s", F.col("first_seen.sched_ord")).withColumn(
        "_b", F.floor(F.col("first_seen.pos") / F.lit(block)))
    blocks = cell.groupBy(*keys, "rec_score", "_s", "_b").agg(F.count("*").alias("_n"))
    within = Window.partitionBy(*keys, "rec_score").orderBy("_s", "_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    scores = blocks.groupBy(*keys, "rec_score").agg(F.sum("_n").alias("_t"))
    better = Window.partitionBy(*keys).orderBy(F.desc("rec_score")).rowsBetween(Window.unboundedPreceding, -1)
    scores = scores.withColumn("_above", F.coalesce(F.sum("_t").over(better), F.lit(0))).drop("_t")
    offsets = _join_known(blocks.drop("_n"), scores, [*keys, "rec_score"])
    place = Window.partitionBy(*keys, "rec_score", "_s", "_b").orderBy("first_seen.pos")
    return (_join_known(cell, offsets, [*keys, "rec_score", "_s", "_b"])
            .withColumn("rank", F.col("_above") + F.col("_before") + F.row_number().over(place))
            .drop("_s", "_b", "_before", "_above"))


def _join_known(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys that may be NULL on both sides."""
    named = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = [left[k].eqNullSafe(named[f"_k_{k}"]) for k in keys]
    return left.join(named, same).drop(*[f"_k_{k}" for k in keys])


def top_n(films: DataFrame, n: int = 10) -> DataFrame:
    """The first n of the ranking with their rank; the full set is never sorted."""
    head = films.orderBy(*rank_order(films)).limit(n)
    return head.withColumn("rank", F.row_number().over(Window.orderBy(*rank_order(films))))


def top_n_per_group(films: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    """The first n of each group; the limit is applied on every task before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(*rank_order(films))
    return films.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def top_summary(films: DataFrame, n: int = 5) -> DataFrame:
    """Total number of films and the text lines of the first n."""
    total = films.agg(F.count("*").alias("total"))
    head = top_n(films, n)
    lines = head.select("rank", top_summary_line(
        F.col("rank"), F.col("title_jp"), F.col("title_cn"), F.col("score"), F.col("rec_score")).alias("line"))
    # both sides are bounded: n rows and one row
    return lines.crossJoin(total).select("total", "rank", "line")

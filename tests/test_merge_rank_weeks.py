import datetime as dt
import random

import demo
import pytest
from pyspark.sql import functions as F

from marquee.functions.scoring import rank_label, rec_score
from marquee.operators import merge as M
from marquee.operators import rank as R
from marquee.operators import weeks as W
from marquee.plans.weekly import scored_films

RAW = "sched_ord int, pos int, title_jp string, poster_url string, is_new_release boolean"
SHOW = "title_jp string, theater_name string, show_date date"
MONDAY = dt.date(2026, 4, 13)


def score_of(spark, *rows, weights=None):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s double, v bigint, n int, new boolean")
    out = df.select("i", rec_score(F.col("s"), F.col("v"), F.col("n"), F.col("new"), weights).alias("x")).orderBy("i")
    return [r.x for r in out.collect()]


def test_rec_score(spark):
    assert score_of(spark, (10.0, 10_000_000, 20, True), (0.0, 0, 0, None), (None, None, None, None), (0.0, 0, 1, False),
                    (5.0, 0, 21, False), (0.0, 999_999_999, 0, False)) == [100.0, 0.0, 0.0, 1.0, 45.0, 25.71]
    low, high, new = score_of(spark, (5.0, 100000, 5, False), (9.0, 100000, 5, False), (9.0, 100000, 5, True))
    assert low < high < new
    assert score_of(spark, (10.0, 0, 20, True), weights={"rating_score_weight": 1.0}) == [130.0]
    with pytest.raises(ValueError, match="rating"):
        score_of(spark, (10.0, 0, 20, True), weights={"rating": 1.0})


def test_rank_all_keeps_unknown_scores_and_positions(spark):
    rows = [("a", 10.0, 0, None), ("b", None, 0, 1), ("c", 20.0, 0, 2), ("d", 10.0, None, 3)]
    df = spark.createDataFrame(rows, "k string, rec_score double, s int, p int").select(
        "k", "rec_score", F.struct(F.col("s").alias("sched_ord"), F.col("p").alias("pos")).alias("first_seen"))
    assert {r.k: r["rank"] for r in R.rank_all(df).collect()} == {"c": 1, "d": 2, "a": 3, "b": 4}


def test_demo_scores(spark):
    got = R.rank_all(scored_films(*demo.tables(spark))).orderBy("rank").collect()
    assert {r.title_jp: r.rec_score for r in got} == demo.SCORES
    assert [r.title_jp for r in got] == list(demo.SCORES) and [r.rank for r in got] == list(range(1, 8))


def test_rank_label(values):
    assert values(rank_label, [1, 2, 3, 4, 10], "int") == ["🥇", "🥈", "🥉", "4", "10"]


def test_merge_keeps_first_seen_and_first_poster(spark):
    raw = spark.createDataFrame([
        (1, 0, "映画A（字幕版）", "late.jpg", True), (0, 5, "映画A", "", False), (0, 9, "映画 A(x)", "first.jpg", True),
        (0, 1, "B", "", None), (2, 0, "（字幕版）", "", True), (3, 0, "(y)", "", False)], RAW)
    for parts in (1, 2, 6):
        got = {r.title_key: (r.title_jp, r.poster_url, r.is_new_release) for r in M.merge_titles(raw.repartition(parts)).collect()}
        assert got == {"映画a": ("映画A", "first.jpg", False), "b": ("B", "", None), "": ("（字幕版）", "", True)}
    assert M.merge_titles(raw.limit(0)).count() == 0


def test_counts_and_theatres(spark):
    shows = spark.createDataFrame(
        [("A（1）", "x", MONDAY), ("A(2)", "x", MONDAY), ("a", "あ", None), ("A", "x", MONDAY), ("B", "z", None)], SHOW)
    assert {r.title_key: r.screening_count for r in M.screening_counts(shows).collect()} == {"a": 4, "b": 1}
    stats = {r.title_key: r for r in M.film_stats(shows).collect()}
    assert (stats["a"].screening_count, stats["a"].dated, stats["a"].theaters, stats["a"].theater_names) == (4, 3, "x、あ", ["x", "あ"])
    names = M.theater_list(shows, ["title_jp"]).filter("title_jp = 'A'").first()
    assert names.theaters == "x"


def test_film_without_showings(spark):
    films = M.merge_titles(spark.createDataFrame([(0, 0, "A", "", True), (0, 1, "B", "", True)], RAW))
    shows = spark.createDataFrame([("A", "x", MONDAY)], SHOW)
    got = {r.title_key: r for r in M.with_stats(films, M.film_stats(shows)).collect()}
    assert (got["b"].screening_count, got["b"].theaters, got["b"].theater_names, got["b"].dated) == (0, "", [], 0)


def test_theatre_count_is_the_size_of_the_list(spark):
    shows = spark.createDataFrame([("A（1）", "x", MONDAY), ("A(2)", "x", MONDAY), ("a", "あ", None), ("A", None, MONDAY), ("B", None, None), ("B", None, MONDAY),
                                   ("D", "", None), ("D", "z", None), ("D", "z", None)], SHOW)
    films = M.merge_titles(spark.createDataFrame([(0, i, t, "", True) for i, t in enumerate("ABCD")], RAW))
    for parts in (1, 5):
        got = M.with_stats(films, M.film_stats(shows.repartition(parts), theater_count=True))
        assert {r.title_key: (r.screening_count, r.dated, r.theater_count, r.theater_names) for r in got.collect()} == {
            "a": (4, 3, 2, ["x", "あ"]), "b": (2, 1, 0, []), "c": (0, 0, 0, []), "d": (3, 0, 2, ["", "z"])}
        assert {r.title_key: r.theater_count for r in got.select("title_key", "theater_count").collect()} == {"a": 2, "b": 0, "c": 0, "d": 2}
    assert "theater_count" not in M.with_stats(films, M.film_stats(shows)).columns


@pytest.mark.parametrize("block", [3, 4096])
def test_rank_all_against_a_plain_sort(spark, block):
    """A third of the films share one score; the blocks are small, so their offsets matter."""
    rng = random.Random(3)
    rows = [(k, rng.choice([10.0, 10.0, rng.randint(0, 40) / 2]), rng.randint(0, 3), i) for k in ("x", "y") for i in range(150)]
    df = (spark.createDataFrame(rows, "k string, rec_score double, s int, p int")
          .select("k", "rec_score", F.struct(F.col("s").alias("sched_ord"), F.col("p").alias("pos")).alias("first_seen")))
    for key in (None, "k"):
        order = sorted(rows, key=lambda r: (-r[1], r[2], r[3], r[0]))
        if key is None:
            df_one, order = df.filter("k = 'x'"), [r for r in order if r[0] == "x"]
            expected = {("x", r[3]): i for i, r in enumerate(order, 1)}
        else:
            df_one = df
            expected = {(k, r[3]): i for k in ("x", "y") for i, r in enumerate([r for r in order if r[0] == k], 1)}
        got = R.rank_all(df_one.repartition(5), block, [key] if key else None).collect()
        assert {(r.k, r.first_seen.pos): r["rank"] for r in got} == expected


def test_top_n_ties_keep_first_seen_order(spark):
    rows = [(f"t{i}", 50.0, 1 - i % 2, i) for i in range(20)] + [("best", 90.0, 9, 9)]
    df = spark.createDataFrame(rows, "title_jp string, rec_score double, s int, p int").select(
        "title_jp", "rec_score", F.struct(F.col("s").alias("sched_ord"), F.col("p").alias("pos")).alias("first_seen"), F.lit(1).alias("g"))
    for parts in (1, 4):
        assert [r.title_jp for r in R.top_n(df.repartition(parts), 3).orderBy("rank").collect()] == ["best", "t1", "t3"]
        assert [r.title_jp for r in R.top_n_per_group(df.repartition(parts), ["g"], 3).orderBy("rank").collect()] == ["best", "t1", "t3"]


def test_top_summary(spark):
    got = R.top_summary(scored_films(*demo.tables(spark)), 2).orderBy("rank").collect()
    assert [(r.total, r.line) for r in got] == [
        (7, "   1. 地铁花园-2 — 豆瓣 8.6，推荐指数 72/100"), (7, "   2. 灯塔看守的狗 — 豆瓣 9.0，推荐指数 70/100")]


def test_weeks(spark):
    day = {"sun_before": -1, "mon": 0, "sun": 6, "next_mon": 7, "next_sun": 13, "later": 14, "past": -30}
    titles = [*day, "undated", "unshown", "both"]
    films = M.merge_titles(spark.createDataFrame([(0, i, t, "", False) for i, t in enumerate(titles)], RAW))
    shows = [(t, "x", MONDAY + dt.timedelta(d)) for t, d in day.items()] + [
        ("undated", "x", None), ("both", "x", MONDAY), ("both", "x", MONDAY + dt.timedelta(8)), ("both", "x", None)]
    shows = spark.createDataFrame(shows, SHOW)
    weekly = W.with_weeks(films, shows, MONDAY + dt.timedelta(2))
    assert {r.title_jp for r in W.this_week(weekly).collect()} == {"mon", "sun", "undated", "unshown", "both"}
    assert {r.title_jp for r in W.next_week(weekly).collect()} == {"next_mon", "next_sun", "both"}
    scored = weekly.withColumn("rec_score", F.col("first_seen.pos") * 1.0).withColumn("issue_number", F.lit(1))
    preview = W.next_week_preview(scored, ["issue_number"], 2).orderBy("rank").collect()
    assert [r.title_jp for r in preview] == ["both", "next_sun"]
    assert {r.title_jp for r in W.in_week(shows, MONDAY).collect()} == {"mon", "sun", "both"}
    assert {r.title_jp for r in W.in_week(shows, MONDAY, next_one=True).collect()} == {"next_mon", "next_sun", "both"}


def test_input_order_does_not_matter(spark):
    films, shows, issues = demo.tables(spark)
    first = None
    for parts, seed in ((1, 1), (3, 2), (7, 3)):
        got = scored_films(films.orderBy(F.rand(seed)).repartition(parts), shows.orderBy(F.rand(seed)).repartition(parts), issues)
        rows = sorted(map(str, got.collect()))
        first = first or rows
        assert rows == first

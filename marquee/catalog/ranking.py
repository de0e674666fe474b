"""Merging, scoring, ranking and weeks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.catalog.bindings import (
    FILMS_SQL, ISSUE_SQL, KEY_SQL, MERGED_SQL, ORDER_SQL, SCREENINGS_SQL, films, issue_tables, screenings,
    table)
from marquee.catalog.flagship import top_films
from marquee.catalog.registry import query
from marquee.catalog.scans import scored_films
from marquee.functions.dates import next_week_end, next_week_start, week_end, week_start
from marquee.functions.scoring import (
    new_component, rank_label, rating_component, rec_score, screens_component, votes_component)
from marquee.functions.text import normalize_title
from marquee.operators.merge import first_value, merge_titles, screening_counts, theater_list
from marquee.operators.rank import rank_all, top_n_per_group, top_summary
from marquee.operators.weeks import in_week, next_week, next_week_preview, this_week
from marquee.plans.weekly import scored_films as issue_scored_films
from marquee.plans.weekly import stage, stage_folder


@query("normalize_title", r"""
    select doc_id, lower(regexp_replace(regexp_replace(text, '[（(][^）)]*[）)]', '', 'g'),
        '[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', '', 'g')) as title_key
    from documents""")
def normalize_title_query(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", normalize_title(F.col("text")).alias("title_key"))


@query("merge_titles", f"""with {FILMS_SQL}, keyed as (select *, {KEY_SQL} as title_key, {ORDER_SQL} as ord from films),
    first as (select * from (select *, row_number() over (partition by title_key order by ord) as n from keyed) where n = 1),
    posters as (select title_key, arg_min(poster_url, ord) as poster_url from keyed where poster_url <> '' group by title_key)
    select f.title_key, sched_ord, pos, title_jp, title_cn, director, "cast", genre, url, year, duration, score, votes, is_new_release,
           array_to_string(reviews, '|') as reviews, coalesce(p.poster_url, '') as poster_url
    from first f left join posters p on p.title_key = f.title_key""")
def merge_titles_query(spark: SparkSession, sf: str) -> DataFrame:
    merged = merge_titles(films(spark, sf))
    return (merged.withColumn("reviews", F.array_join("reviews", "|"))
            .withColumns({"sched_ord": F.col("first_seen.sched_ord"), "pos": F.col("first_seen.pos")}).drop("first_seen"))


@query("screening_counts", f"""with {FILMS_SQL}, {SCREENINGS_SQL}
    select {KEY_SQL} as title_key, count(*) as screening_count from screenings group by 1""")
def screening_counts_query(spark: SparkSession, sf: str) -> DataFrame:
    return screening_counts(screenings(spark, sf))


@query("backfill_first", f"""with {FILMS_SQL}
    select genre, coalesce(arg_min(poster_url, {ORDER_SQL}) filter (where poster_url <> ''), '') as poster_url from films group by genre""")
def backfill_first(spark: SparkSession, sf: str) -> DataFrame:
    return films(spark, sf).groupBy("genre").agg(first_value("poster_url").alias("poster_url"))


@query("score_parts", """
    select p_partkey, round(case when p_size % 4 = 0 then 0.0 else (p_retailprice - 900) / 10 / 10.0 * 100.0 end, 4) as rating_part,
           round(case when p_size % 3 = 0 then 0.0 else log10(p_partkey * 100000 + 1) / 7.0 * 100.0 end, 4) as votes_part,
           least(p_size / 20.0::double, 1.0) * 100.0 as screens_part,
           case p_type when 'PROMO' then 100.0 else 0.0 end::double as new_part from part where p_partkey > 0
    union all select 0, 0.0, 0.0, least(p_size / 20.0::double, 1.0) * 100.0, case p_type when 'PROMO' then 100.0 else 0.0 end::double
    from part where p_partkey = 0""")
def score_parts(spark: SparkSession, sf: str) -> DataFrame:
    score = F.when(F.col("p_size") % 4 == 0, 0.0).otherwise((F.col("p_retailprice") - 900) / 10)
    votes = F.when(F.col("p_size") % 3 == 0, 0).otherwise(F.col("p_partkey") * 100000)
    new = F.when(F.col("p_type") == "PROMO", True).when(F.col("p_type") == "LARGE", F.lit(None)).otherwise(False)
    return table(spark, sf, "part").select(
        "p_partkey", F.round(rating_component(score), 4).alias("rating_part"), F.round(votes_component(votes), 4).alias("votes_part"),
        screens_component(F.col("p_size")).alias("screens_part"), new_component(new).alias("new_part"))


@query("rec_score", f"""with {MERGED_SQL} select title_key, screening_count, rec_score from scored""")
def rec_score_query(spark: SparkSession, sf: str) -> DataFrame:
    return scored_films(spark, sf).select("title_key", "screening_count", "rec_score")


@query("rec_score_weights", f"""with {FILMS_SQL}
    select p_partkey, round(0.7 * (case when score = 0 then 0.0 else score / 10.0 * 100.0 end)
        + 0.2 * (case when votes = 0 then 0.0 else log10(votes + 1) / 7.0 * 100.0 end)
        + 0.3 * (least(sched_ord / 20.0::double, 1.0) * 100.0)
        + 0.1 * (case when is_new_release then 100.0 else 0.0 end), 2) as rec_score from films""")
def rec_score_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Two weights given, two at their defaults; the sum is not re-normalised."""
    weights = {"rating_score_weight": 0.7, "screening_count_weight": 0.3}
    return films(spark, sf, "p_partkey").select("p_partkey", rec_score(
        F.col("score"), F.col("votes"), F.col("sched_ord"), F.col("is_new_release"), weights).alias("rec_score"))


@query("rank_all", f"""with {MERGED_SQL}
    select title_key, rec_score, row_number() over (order by rec_score desc, ord) as rank from scored""")
def rank_all_query(spark: SparkSession, sf: str) -> DataFrame:
    scored = scored_films(spark, sf).select("title_key", "rec_score", "first_seen")
    return rank_all(stage(scored, "scored", stage_folder(spark))).select("title_key", "rec_score", F.col("rank").cast("long").alias("rank"))


@query("top_n", f"""with {MERGED_SQL}, r as (select *, row_number() over (order by rec_score desc, ord) as rank from scored)
    select rank::integer as rank, case rank when 1 then '🥇' when 2 then '🥈' when 3 then '🥉' else rank::varchar end as label,
           title_key, title_jp, title_cn, screening_count, rec_score, theaters from r where rank <= 10""")
def top_n_query(spark: SparkSession, sf: str) -> DataFrame:
    return top_films(spark, sf)


@query("rank_label", f"""with {MERGED_SQL}, r as (select *, row_number() over (order by rec_score desc, ord) as rank from scored)
    select title_key, case rank when 1 then '🥇' when 2 then '🥈' when 3 then '🥉' else rank::varchar end as label from r""")
def rank_label_query(spark: SparkSession, sf: str) -> DataFrame:
    ranked = rank_all(stage(scored_films(spark, sf).select("title_key", "rec_score", "first_seen"), "scored", stage_folder(spark)))
    return ranked.select("title_key", rank_label(F.col("rank")).alias("label"))


@query("top5_summary", f"""with {MERGED_SQL}, r as (select *, row_number() over (order by rec_score desc, ord) as rank from scored)
    select (select count(*) from scored) as total, rank::integer as rank,
           concat('   ', rank, '. ', coalesce(nullif(title_cn, ''), title_jp), ' — ',
                  case when score = 0 then '暂无豆瓣评分' else concat('豆瓣 ', score) end, '，推荐指数 ', printf('%.0f', rec_score), '/100') as line
    from r where rank <= 5""")
def top5_summary(spark: SparkSession, sf: str) -> DataFrame:
    return top_summary(scored_films(spark, sf))


@query("top_n_per_group", f"""with {ISSUE_SQL}
    select issue_number, rank::integer as rank, title_key, screening_count, rec_score from ranked where rank <= 5""")
def top_n_per_group_query(spark: SparkSession, sf: str) -> DataFrame:
    scored = issue_scored_films(*issue_tables(spark, sf))
    return top_n_per_group(scored, ["issue_number"], 5).select(
        "issue_number", "rank", "title_key", "screening_count", "rec_score")


@query("week_bounds", """
    select l_orderkey, l_partkey, l_suppkey, date_trunc('week', l_shipdate)::date as week_start,
           (date_trunc('week', l_shipdate)::date + 6) as week_end from lineitem""")
def week_bounds(spark: SparkSession, sf: str) -> DataFrame:
    day = F.col("l_shipdate").cast("date")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", week_start(day).alias("week_start"), week_end(day).alias("week_end"))


@query("next_week_bounds", """
    select o_orderkey, date_trunc('week', o_orderdate)::date + 7 as next_start, date_trunc('week', o_orderdate)::date + 13 as next_end
    from orders""")
def next_week_bounds(spark: SparkSession, sf: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders").select(
        "o_orderkey", next_week_start(day).alias("next_start"), next_week_end(day).alias("next_end"))


@query("this_week", f"""with {MERGED_SQL}
    select title_key, this_week, dated, rec_score from scored where this_week > 0 or dated = 0""")
def this_week_query(spark: SparkSession, sf: str) -> DataFrame:
    return this_week(scored_films(spark, sf)).select("title_key", "this_week", "dated", "rec_score")


@query("next_week_movies", f"""with {MERGED_SQL} select title_key, next_week, rec_score from scored where next_week > 0""")
def next_week_movies(spark: SparkSession, sf: str) -> DataFrame:
    return next_week(scored_films(spark, sf)).select("title_key", "next_week", "rec_score")


@query("showings_in_week", f"""with {FILMS_SQL}, {SCREENINGS_SQL}
    select title_jp, count(*) as showings from screenings where show_date between date '1998-06-08' and date '1998-06-14' group by title_jp""")
def showings_in_week(spark: SparkSession, sf: str) -> DataFrame:
    return in_week(screenings(spark, sf), "1998-06-03", next_one=True).groupBy("title_jp").agg(F.count("*").alias("showings"))


@query("next_week_preview", f"""with {ISSUE_SQL},
    coming as (select *, row_number() over (partition by issue_number order by rec_score desc, ord) as n from scored where next_week > 0)
    select issue_number, n::integer as rank, title_key, next_week from coming where n <= 5""")
def next_week_preview_query(spark: SparkSession, sf: str) -> DataFrame:
    scored = issue_scored_films(*issue_tables(spark, sf))
    return next_week_preview(scored, ["issue_number"]).select("issue_number", "rank", "title_key", "next_week")


@query("theater_list", """
    select l_partkey, array_to_string(list_sort(list_distinct(list(s_name))), '、') as theaters
    from lineitem join supplier on l_suppkey = s_suppkey group by l_partkey""")
def theater_list_query(spark: SparkSession, sf: str) -> DataFrame:
    shown = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()
    names = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("theater_name"))
    return theater_list(shown.join(names, "l_suppkey"), ["l_partkey"])


@query("rank_within_issues", f"""with {ISSUE_SQL} select issue_number, title_key, rec_score, rank from ranked""")
def rank_within_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Every film of every issue with its place; an issue's films are one merged row per title."""
    scored = issue_scored_films(*issue_tables(spark, sf)).select("issue_number", "title_key", "rec_score", "first_seen")
    return rank_all(stage(scored, "scored", stage_folder(spark)), keys=["issue_number"]).select(
        "issue_number", "title_key", "rec_score", F.col("rank").cast("long").alias("rank"))

"""Plans push filters down and limit groups before they are shuffled."""

import re
from pathlib import Path

import demo
from pyspark.sql import functions as F

import marquee
from marquee.operators.enrich import best_match
from marquee.operators.merge import film_stats
from marquee.operators.extract import extract_independent
from marquee.operators.merge import merge_titles
from marquee.operators.rank import rank_all, top_n, top_n_per_group
from marquee.operators.weeks import in_week
from marquee.plans.weekly import scored_films


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_group_limits_run_before_the_shuffle(spark):
    films = scored_films(*demo.tables(spark))
    assert plan(top_n_per_group(films, ["issue_number"], 3)).count("WindowGroupLimit") == 2
    assert "TakeOrderedAndProject" in plan(top_n(films, 3))
    candidates = spark.createDataFrame([], "query string, pos int, id string, type string, year string, has_rating boolean, rating string")
    assert plan(best_match(films, candidates, "title_key")).count("WindowGroupLimit") >= 3


def test_rank_numbers_only_blocks(spark):
    films = scored_films(*demo.tables(spark)).select("title_key", "rec_score", "first_seen")
    unpartitioned = [line for line in plan(rank_all(films)).splitlines() if "Exchange SinglePartition" in line]
    assert len(unpartitioned) == 1  # the running sum over distinct scores


def test_week_filter_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "shows")
    demo.tables(spark)[1].write.parquet(path)
    text = plan(in_week(spark.read.parquet(path), "2026-04-15").select("title_jp"))
    pushed = re.search(r"PushedFilters: \[(.*?)\]", text)[1]
    assert "GreaterThanOrEqual(show_date,2026-04-13)" in pushed and "LessThanOrEqual(show_date,2026-04-19)" in pushed
    assert "theater_name" not in text.split("ReadSchema")[1]


def test_small_tables_are_broadcast_by_size_not_by_hint():
    for source in Path(marquee.__file__).parent.rglob("*.py"):
        if source.parent.name == "llm":
            continue
        code = source.read_text(encoding="utf-8")
        assert not re.search(r"broadcast\(|localCheckpoint|\.collect\(\)|toPandas", code), source


def test_theatre_statistics_shuffle_partial_counts(spark):
    _, shows, _ = demo.tables(spark)
    text = plan(film_stats(shows, ["issue_number"], F.lit("2026-04-13").cast("date")))
    assert text.count("partial_sum") >= 2


def test_pages_are_dealt_to_tasks_of_bounded_size(spark, monkeypatch, tmp_path):
    from marquee.catalog import bindings, extraction
    monkeypatch.setattr(bindings, "PAGES_PER_TASK", 10)
    narrow = spark.range(200).coalesce(1)
    assert bindings.spread(narrow).rdd.getNumPartitions() == 20
    assert sorted(r.id for r in bindings.spread(narrow).collect()) == list(range(200))
    assert bindings.spread(narrow.repartition(30)).rdd.getNumPartitions() == 30
    spark.range(200).coalesce(1).selectExpr(
        "id as p_partkey", "'n' as p_name", "'b' as p_brand", "'SMALL' as p_type", "1 as p_size", "1.0D as p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    assert extraction.part_pages(spark, str(tmp_path)).rdd.getNumPartitions() == 20


def test_rules_leave_pages_of_one_address_in_their_splits(spark):
    pages = spark.range(300).repartition(6).selectExpr(
        "id as page_id", "'https://uplink.example/' as base_url", "concat('<article class=movie><h2>Film ', id, '</h2></article>') as html")
    found = extract_independent(pages, "2026-04-13")
    assert found.rdd.getNumPartitions() == 6
    assert found.count() == 300


def test_records_are_thinned_before_they_are_sorted(spark):
    films = spark.range(2000).selectExpr("cast(id % 50 as int) as sched_ord", "cast(id as int) as pos", "concat('t', id % 4) as title_jp",
                                         "case when id < 1000 then '' else concat('/', id) end as poster_url")
    films = films.unionByName(spark.sql("select cast(null as int) as sched_ord, 7 as pos, 't3' as title_jp, '' as poster_url"))
    rows = sorted((r.title_jp, r.first_seen.sched_ord, r.first_seen.pos, r.poster_url) for r in merge_titles(films).collect())
    assert rows == [("t0", 0, 0, "/1000"), ("t1", 1, 1, "/1001"), ("t2", 0, 50, "/1050"), ("t3", None, 7, "/1051")]
    text = plan(merge_titles(films))
    assert text.index("Join") > text.index("SortAggregate") and "_first_poster" in text


def test_theatres_are_counted_without_listing_them_in_one_task(spark, tmp_path):
    from marquee.catalog.reports import pages_to_films
    spark.sql("select id as o_orderkey, id as o_custkey, 'F' as o_orderstatus, timestamp_ntz'1998-06-03 00:00:00' as o_orderdate, 'HOT' as o_orderpriority "
              "from range(40) union all select id, 7, 'F', timestamp_ntz'1998-06-04 00:00:00', 'HOT' from range(10)").write.parquet(f"{tmp_path}/orders.parquet")
    films = pages_to_films(spark, str(tmp_path))
    rows = sorted((r.title_key, r.first_page, r.poster_url, r.screening_count, r.theaters) for r in films.collect())
    assert rows == [("f", 0, "https://cdn.example/0.png", 50, 40), ("hot&片", 0, "https://a.example/img/0.jpg", 100, 40)]
    assert "collect_" not in films._jdf.queryExecution().optimizedPlan().toString()

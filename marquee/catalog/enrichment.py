"""Lookup of rating records and overlay of their fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.catalog.bindings import FILMS_SQL, KEY_SQL, ORDER_SQL, WS_SQL, films, table
from marquee.catalog.registry import query
from marquee.functions.text import first_token, lookup_query
from marquee.operators.enrich import (
    best_match, enrich, enrich_all, first_reviews, local_title, parse_people, parse_rating, parse_year_duration,
    pick_best, rating_page, quick_rating, top_reviews, two_stage_lookup)
from marquee.operators.merge import merge_titles


@query("lookup_query", """
    select p_partkey, case when p_size > 25 then concat(p_name, ' ', p_size + 1975) else p_name end as query from part""")
def lookup_query_query(spark: SparkSession, sf: str) -> DataFrame:
    year = F.when(F.col("p_size") > 25, F.col("p_size") + 1975).otherwise(0)
    return table(spark, sf, "part").select("p_partkey", lookup_query(F.col("p_name"), year).alias("query"))


# Customers are films, orders are candidates: urgent ones answer the query with the year.
LOOKUP_SQL = """films as (select c_custkey, c_name as title_jp, case when c_nationkey < 5 then 0 else c_nationkey end as film_year from customer),
    candidates as (
        select concat('Customer#', lpad(o_custkey::varchar, 9, '0'),
                      case when o_orderpriority = '1-URGENT' then concat(' ', o_orderkey % 25) else '' end) as query,
               o_orderkey as pos, o_orderkey::varchar as id, case o_orderstatus when 'F' then 'movie' else 'tv' end as type,
               case o_orderpriority when '5-LOW' then '' else concat('y', o_orderkey % 25) end as year, o_totalprice from orders),
    hits as (
        select c_custkey, film_year, 0 as attempt, c.* from films
        join candidates c on c.query = case when film_year = 0 then title_jp else concat(title_jp, ' ', film_year) end
        union all
        select c_custkey, film_year, 1, c.* from films join candidates c on c.query = title_jp where film_year <> 0),
    staged as (select *, min(attempt) over (partition by c_custkey) as first_attempt from hits)"""


def _lookup_films(spark: SparkSession, sf: str) -> DataFrame:
    year = F.when(F.col("c_nationkey") < 5, 0).otherwise(F.col("c_nationkey"))
    return table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("title_jp"), year.alias("year"))


def _lookup_candidates(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    number = (F.col("o_orderkey") % 25).cast("string")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return table(spark, sf, "orders").select(
        F.when(urgent, F.concat(name, F.lit(" "), number)).otherwise(name).alias("query"),
        F.col("o_orderkey").alias("pos"), F.col("o_orderkey").cast("string").alias("id"),
        F.when(F.col("o_orderstatus") == "F", "movie").otherwise("tv").alias("type"),
        F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.concat(F.lit("y"), number)).alias("year"),
        F.lit(True).alias("has_rating"), F.col("o_totalprice").cast("string").alias("rating"))


@query("two_stage_lookup", f"""with {LOOKUP_SQL}
    select c_custkey, attempt, count(*) as candidates, min(pos) as first_pos, max(pos) as last_pos
    from staged where attempt = first_attempt group by c_custkey, attempt""")
def two_stage_lookup_query(spark: SparkSession, sf: str) -> DataFrame:
    hits = two_stage_lookup(_lookup_films(spark, sf), _lookup_candidates(spark, sf), "c_custkey")
    return hits.groupBy("c_custkey", "attempt").agg(
        F.count("*").alias("candidates"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


@query("best_match", f"""with {LOOKUP_SQL},
    typed as (select *, max(case when type = 'movie' then 1 else 0 end) over (partition by c_custkey) as has_movie
              from staged where attempt = first_attempt),
    kept as (select * from typed where has_movie = 0 or type = 'movie'),
    dated as (select *, contains(year, film_year::varchar) and film_year <> 0 as year_hit from kept),
    picked as (select *, row_number() over (partition by c_custkey order by year_hit desc, pos) as n from dated)
    select c_custkey, attempt, id, type, year from picked where n = 1""")
def best_match_query(spark: SparkSession, sf: str) -> DataFrame:
    return best_match(_lookup_films(spark, sf), _lookup_candidates(spark, sf), "c_custkey").select(
        "c_custkey", "attempt", "id", "type", "year")


@query("prefer_type", r"""
    with c as (select user_id, event_id, event_type, regexp_extract(props, '[0-9]+') as year,
                      max((event_type = 'purchase')::integer) over (partition by user_id) as has_wanted from events),
    kept as (select *, contains(year, (user_id % 10)::varchar) and user_id % 10 <> 0 as hit from c where has_wanted = 0 or event_type = 'purchase'),
    p as (select *, row_number() over (partition by user_id order by hit desc, event_id) as n from kept)
    select user_id, event_id as pos, case event_type when 'purchase' then 'movie' else event_type end as type, year from p where n = 1""")
def prefer_type(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "movie").otherwise(F.col("event_type"))
    hits = table(spark, sf, "events").select(
        "user_id", F.col("event_id").alias("pos"), kind.alias("type"), F.regexp_extract("props", "[0-9]+", 0).alias("year"))
    return pick_best(hits, ["user_id"], [], F.col("user_id") % 10)


@query("quick_rating", """
    select event_id, case when event_type = 'error' then null when event_type in ('view', 'click') then 0.0 else coalesce(value, 0.0) end as score from events""")
def quick_rating_query(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    text = (F.when(kind == "error", F.lit("n/a")).when(kind == "view", F.lit("")).when(kind == "click", F.lit(None))
            .otherwise(F.col("value").cast("string")))
    return table(spark, sf, "events").select("event_id", quick_rating(text).alias("score"))


@query("parse_rating", """
    select p_partkey, case when p_size % 4 = 0 then 0.0 else round((p_retailprice - 900) / 10, 1) end as score,
           case when p_size % 7 = 0 then 0 else p_partkey * 1000 + p_size end as votes from part""")
def parse_rating_query(spark: SparkSession, sf: str) -> DataFrame:
    rating = F.round((F.col("p_retailprice") - 900) / 10, 1).cast("string")
    votes = F.format_number(F.col("p_partkey") * 1000 + F.col("p_size"), 0)
    html = F.concat(
        F.lit("<div><strong class=\"ll rating_num\" property=\"v:average\">\n "),
        F.when(F.col("p_size") % 4 == 0, F.lit("none")).otherwise(rating), F.lit(" </strong>"),
        F.when(F.col("p_size") % 7 == 0, F.lit("<span>12</span>")).otherwise(
            F.concat(F.lit("<a><span property='v:votes'>"), votes, F.lit("</span>人评价</a>"))), F.lit("</div>"))
    page = table(spark, sf, "part").select("p_partkey", rating_page(html, "rating", "votes").alias("page"))
    score, found = parse_rating(F.col("page"))
    return page.select("p_partkey", score.alias("score"), found.alias("votes"))


@query("join_top5", r"""
    select p_partkey, p_brand as director,
           array_to_string([concat(p_name, i) for i in range(1, least(p_size % 8, 5) + 1)], ' / ') as "cast",
           concat(p_type, ' / ', 'A & B') as genre from part""")
def join_top5(spark: SparkSession, sf: str) -> DataFrame:
    many = F.array_join(F.transform(
        F.filter(F.sequence(F.lit(1), F.lit(8)), lambda i: i <= F.col("p_size") % 8),
        lambda i: F.concat(F.lit("<a href='/c' rel=\"v:starring\"> "), F.col("p_name"), i.cast("string"), F.lit(" </a> / "))), "")
    html = F.concat(
        F.lit("<span class='attrs'><a rel=\"v:directedBy\">"), F.col("p_brand"), F.lit("</a></span>"), many,
        F.lit("<span property=\"v:genre\">"), F.col("p_type"), F.lit("</span> / <span property=\"v:genre\">A &amp; B</span>"))
    page = table(spark, sf, "part").select("p_partkey", rating_page(html, "directors", "cast", "genres").alias("page"))
    director, cast, genre = parse_people(F.col("page"))
    return page.select("p_partkey", director.alias("director"), cast.alias("cast"), genre.alias("genre"))


@query("parse_year", """
    select p_partkey, case when p_size % 5 = 0 then 0 else 1950 + p_size end as year,
           case when p_size % 3 = 0 then 0 else p_size + 60 end as duration from part""")
def parse_year(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    html = F.concat(
        F.lit("<h1><span class=\"year\">("), F.when(size % 5 == 0, F.lit("日本")).otherwise((size + 1950).cast("string")),
        F.lit(")</span></h1>"),
        F.when(size % 3 == 0, F.lit("")).otherwise(F.concat(
            F.lit("<span property=\"v:runtime\" content=\"9\">"), F.translate((size + 60).cast("string"), "0123456789", "０１２３４５６７８９"),
            F.lit("分钟 / 90分钟</span>"))))
    page = table(spark, sf, "part").select("p_partkey", rating_page(html, "year", "runtime").alias("page"))
    year, duration = parse_year_duration(F.col("page"))
    return page.select("p_partkey", year.alias("year"), duration.alias("duration"))


@query("local_title", """
    select p_partkey, case when p_size % 4 = 3 then null else string_split(p_name, ' ')[1] end as title_cn from part""")
def local_title_query(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    html = F.concat(
        F.when(size % 4 == 0, F.concat(F.lit("<h1><span property=\"v:itemreviewed\">  "), F.replace("p_name", F.lit(" "), F.lit("　"))))
        .when(size % 4 == 1, F.concat(F.lit("<h1>x<span>"), F.col("p_name")))
        .when(size % 4 == 2, F.concat(F.lit("<h1><span>no</span></h1><b><span property='v:itemreviewed'>"), F.col("p_name")))
        .otherwise(F.lit("<h1>plain")), F.lit("</span></h1>"))
    page = table(spark, sf, "part").select("p_partkey", rating_page(html, "item", "heading").alias("page"))
    return page.select("p_partkey", local_title(F.col("page")).alias("title_cn"))


@query("first_token", f"""
    select doc_id, nullif(string_split(trim(regexp_replace(text, '{WS_SQL}', ' ', 'g')), ' ')[1], '') as word from documents""")
def first_token_query(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", first_token(F.col("text")).alias("word"))


@query("top_reviews", f"""
    with c as (select conv_id, turn, trim(regexp_replace(text, '{WS_SQL}', ' ', 'g')) as text from conversations),
    p as (select *, row_number() over (partition by conv_id order by turn) as n from c where text <> '')
    select conv_id, n::integer as n, text from p where n <= 3""")
def top_reviews_query(spark: SparkSession, sf: str) -> DataFrame:
    return first_reviews(table(spark, sf, "conversations"), ["conv_id"], "turn", "text", 3)


@query("top_reviews_array", """
    select p_partkey, array_to_string([t for t in [p_name, case when p_size % 2 = 0 then '' else p_brand end, p_type, 'x', 'y']
                                       if t <> ''][1:3], '|') as reviews from part""")
def top_reviews_array(spark: SparkSession, sf: str) -> DataFrame:
    texts = F.array(F.col("p_name"), F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_brand")), F.col("p_type"),
                    F.lit("x"), F.lit("y"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(top_reviews(texts, 3), "|").alias("reviews"))


@query("enrich", """
    select d.doc_id, concat(lang, doc_id) as title_jp,
        case when found and quality = 1 then concat('q', toxic) else concat('cn', lang) end as title_cn,
        case when found then case toxic when 1 then '' else 'dir' end else 'old' end as director,
        case when found then 'cast' else '' end as "cast", case when found then 'g' else 'old' end as genre,
        case when found and quality = 1 then 2000 else 1 end as year, case when found and toxic = 1 then 99 else 2 end as duration,
        case when found and toxic = 1 then 7.5 when matched and lang in ('en', 'fr') then round(n_chars / 10.0::double, 1)
             when matched and lang = 'de' and doc_id % 2 = 1 then 0.0 else 1.5 end as score,
        case when found then 100::bigint * quality else 3 end as votes,
        case when matched then concat('https://movie.douban.com/subject/', doc_id, '/') else '' end as url,
        case when found then 'r1|r2' else 'old' end as reviews,
        case when matched then doc_id::varchar else '' end as rating_id
    from (select d.*, l.quality, l.toxic, d.source not in ('src0', 'src1') as matched,
                 d.source not in ('src0', 'src1') and l.doc_id is not null as found
          from documents d left join labels l on l.doc_id = d.doc_id) d""")
def enrich_query(spark: SparkSession, sf: str) -> DataFrame:
    """Documents are films, their own ids the matches (two sources have none), labels the rating pages."""
    d = table(spark, sf, "documents")
    old = d.select(
        "doc_id", F.concat("lang", F.col("doc_id").cast("string")).alias("title_jp"), F.concat(F.lit("cn"), "lang").alias("title_cn"),
        F.lit("old").alias("director"), F.lit("").alias("cast"), F.lit("old").alias("genre"), F.lit(1).alias("year"),
        F.lit(2).alias("duration"), F.lit(1.5).alias("score"), F.lit(3).cast("long").alias("votes"), F.lit("").alias("url"),
        F.array(F.lit("old")).alias("reviews"))
    rating = (F.when(F.col("lang").isin("en", "fr"), F.round(F.col("n_chars") / 10, 1).cast("string"))
              .when(F.col("lang") == "de", F.when(F.col("doc_id") % 2 == 0, "?").otherwise("")))
    matches = d.filter(F.col("source") != "src1").select(
        "doc_id", F.when(F.col("source") == "src0", "").otherwise(F.col("doc_id").cast("string")).alias("id"),
        (F.col("lang") != "es").alias("has_rating"), rating.alias("rating"))
    quality, toxic = F.col("quality"), F.col("toxic")
    subjects = table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("id"),
        F.when(quality == 1, F.concat(F.lit("q"), toxic.cast("string"))).alias("title_cn"),
        F.when(toxic == 1, "").otherwise("dir").alias("director"), F.lit("cast").alias("cast"), F.lit("g").alias("genre"),
        (quality * 2000).alias("year"), (toxic * 99).alias("duration"), (toxic * F.lit(7.5)).alias("score"),
        (quality * 100).cast("long").alias("votes"), F.array(F.lit("r1"), F.lit("r2")).alias("reviews"))
    return enrich(old, matches, subjects, "doc_id").withColumn("reviews", F.array_join("reviews", "|"))


@query("enrich_all", f"""with {FILMS_SQL},
    keyed as (select *, {KEY_SQL} as title_key, {ORDER_SQL} as ord from films),
    merged as (select * from (select *, row_number() over (partition by title_key order by ord) as n from keyed) where n = 1),
    candidates as (select "title_jp" as query, p_partkey, genre, case when genre in ('PROMO', 'LARGE') then 'movie' else 'tv' end as type, year, score from films),
    tried as (select m.title_key, m.year as film_year, c.*, row_number() over (
                  partition by m.title_key order by case type when 'movie' then 0 else 1 end,
                  case when m.year = 0 or contains(c.year::varchar, m.year::varchar) then 0 else 1 end, c.p_partkey) as n
              from merged m join candidates c on c.query = m.title_jp)
    select m.title_key, m.title_jp, coalesce(t.p_partkey::varchar, '') as rating_id,
           case when t.genre in ('PROMO', 'SMALL', 'ECONOMY') then concat('dir', t.p_partkey) else m.director end as director,
           case when t.genre in ('PROMO', 'SMALL', 'ECONOMY') then t.p_partkey * 10 else m.votes end as votes,
           case when t.genre in ('PROMO', 'SMALL', 'ECONOMY') and t.p_partkey % 20 <> 0 then (t.p_partkey % 20) / 2.0::double else t.score end as score
    from merged m left join tried t on t.title_key = m.title_key and t.n = 1""")
def enrich_all_query(spark: SparkSession, sf: str) -> DataFrame:
    """Film records merged first, then each looked up once among the records of its own title."""
    records = films(spark, sf)
    merged = merge_titles(records)
    candidates = records.select(
        F.col("title_jp").alias("query"), "pos", F.col("pos").cast("string").alias("id"),
        F.when(F.col("genre").isin("PROMO", "LARGE"), "movie").otherwise("tv").alias("type"),
        F.col("year").cast("string").alias("year"), F.lit(True).alias("has_rating"), F.col("score").cast("string").alias("rating"))
    subjects = table(spark, sf, "part").filter("p_type in ('PROMO', 'SMALL', 'ECONOMY')").select(
        F.col("p_partkey").cast("string").alias("id"), F.lit("").alias("title_cn"),
        F.concat(F.lit("dir"), F.col("p_partkey").cast("string")).alias("director"), F.lit("").alias("cast"), F.lit("").alias("genre"),
        F.lit(0).alias("year"), F.lit(0).alias("duration"), ((F.col("p_partkey") % 20) / 2).alias("score"),
        (F.col("p_partkey") * 10).alias("votes"), F.expr("cast(array() as array<string>)").alias("reviews"))
    return enrich_all(merged, candidates, subjects).select("title_key", "title_jp", "rating_id", "director", "votes", "score")

"""The driver tables seen in the shape of the domain, for Spark and as SQL for the oracle.

Parts are film records of many sources, line items are showings, suppliers are theatres. A
showing belongs to the capture (issue) of the week it is shown in, or of one or two weeks
before, so that every issue has films of this week, of next week and of neither.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


AS_OF = "1998-12-15"
WEEK = "1998-06-03"
FIRST_MONDAY = "1994-12-12"
_SCHEMAS: dict = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table. Its schema is read once; later reads start no job for it."""
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


# ---- films

FILM_FIELDS = {
    # name: (Spark SQL, DuckDB SQL if it differs)
    "sched_ord": "p_size",
    "pos": "cast(p_partkey as int)",
    "title_jp": "concat(p_name, ' ', p_brand, case p_type when 'PROMO' then '（字幕版）' "
                "when 'ECONOMY' then ' (吹替版)' else '' end)",
    "title_cn": "case p_type when 'STANDARD' then '' when 'SMALL' then concat(p_name, ' ', p_brand) "
                "else concat(p_brand, '片') end",
    "director": "case when p_type = 'LARGE' then '' else concat('D', cast(p_size as string)) end",
    "cast": "case when p_size < 10 then '' else concat('C', cast(p_size as string), ' / ', p_brand) end",
    "genre": "p_type",
    "poster_url": "case when p_size % 2 = 0 then '' else concat('/p/', cast(p_partkey as string), '.jpg') end",
    "url": "case when p_size > 40 then '' else concat('https://r.example/', cast(p_partkey as string)) end",
    "year": "case when p_size > 25 then p_size + 1975 else 0 end",
    "duration": "p_size * 3",
    "score": "round((p_retailprice - 900) / 10, 1)",
    "votes": "cast(p_partkey * p_size * 10 as bigint)",
    "is_new_release": "p_type = 'PROMO'",
    "reviews": "case when p_size < 15 then cast(array() as array<string>) when p_size < 30 then array(p_name) "
               "else array(p_name, p_brand, concat(p_type, '!'), 'more') end",
}
DUCK_REVIEWS = ("case when p_size < 15 then []::varchar[] when p_size < 30 then [p_name] "
                "else [p_name, p_brand, concat(p_type, '!'), 'more'] end")


def _duck(name: str) -> str:
    if name == "reviews":
        return DUCK_REVIEWS
    return FILM_FIELDS[name].replace("as string", "as varchar")


FILMS_SQL = "films as (select p_partkey, " + ", ".join(
    f'{_duck(n)} as "{n}"' for n in FILM_FIELDS) + " from part)"


def films(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr(*extra, *[f"{sql} as {name}" for name, sql in FILM_FIELDS.items()])


# ---- showings

SHOW_DATE = "case when l_quantity = 50 then null else cast(l_shipdate as date) end"


def screenings(spark: SparkSession, sf: str) -> DataFrame:
    """Showings with title and theatre name; all issues together."""
    titles = films(spark, sf, "p_partkey").select("p_partkey", "title_jp")
    theaters = table(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("theater_name"))
    shown = table(spark, sf, "lineitem").select(
        "l_partkey", "l_suppkey", F.expr(SHOW_DATE).alias("show_date"), capture_week().alias("week_start"))
    return (shown.join(titles, F.col("l_partkey") == F.col("p_partkey"))
            .join(theaters, F.col("l_suppkey") == F.col("s_suppkey"))
            .select("week_start", issue_number(F.col("week_start")).alias("issue_number"), "l_partkey", "title_jp",
                    "theater_name", "show_date"))


def capture_week() -> Column:
    return F.expr("cast(date_trunc('week', date_sub(cast(l_shipdate as date), 7 * (l_linenumber % 3))) as date)")


def issue_number(week: Column) -> Column:
    return (F.datediff(week, F.lit(FIRST_MONDAY).cast("date")) / 7).cast("int")


SCREENINGS_SQL = f"""screenings as (
    select cast(date_trunc('week', cast(l_shipdate as date) - cast(7 * (l_linenumber % 3) as integer)) as date) as week_start,
           l_partkey, title_jp, s_name as theater_name,
           case when l_quantity = 50 then null else cast(l_shipdate as date) end as show_date
    from lineitem join films on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey),
issue_shows as (
    select *, cast(date_diff('day', date '{FIRST_MONDAY}', week_start) / 7 as integer) as issue_number from screenings)"""

KEY_SQL = r"lower(regexp_replace(regexp_replace(title_jp, '[（(][^）)]*[）)]', '', 'g'), '\s+', '', 'g'))"
ORDER_SQL = "sched_ord * 1000000000::bigint + pos"

# Films of all issues taken as one: merged, counted, scored.
MERGED_SQL = f"""{FILMS_SQL}, {SCREENINGS_SQL},
keyed as (select *, {KEY_SQL} as title_key, {ORDER_SQL} as ord from films),
merged as (
    select title_key, min(ord) as ord, coalesce(arg_min(poster_url, ord) filter (where poster_url <> ''), '') as poster
    from keyed group by title_key),
stats as (
    select {KEY_SQL} as title_key, count(*) as n, count(show_date) as dated,
           count(*) filter (where show_date between date '1998-06-01' and date '1998-06-07') as this_week,
           count(*) filter (where show_date between date '1998-06-08' and date '1998-06-14') as next_week,
           list_sort(list_distinct(list(theater_name))) as names
    from screenings group by 1),
full_films as (
    select m.title_key, m.ord, m.poster, k.sched_ord, k.pos, k.title_jp, k.title_cn, k.director, k."cast" as actors, k.genre,
           k.url, k.year, k.duration, k.score, k.votes, k.is_new_release, k.reviews,
           coalesce(s.n, 0) as screening_count, coalesce(s.dated, 0) as dated, coalesce(s.this_week, 0) as this_week,
           coalesce(s.next_week, 0) as next_week, coalesce(s.names, []) as names,
           coalesce(array_to_string(s.names, '、'), '') as theaters
    from merged m join keyed k on k.title_key = m.title_key and k.ord = m.ord left join stats s on s.title_key = m.title_key),
scored as (
    select *, round(
        0.5 * (case when score = 0 then 0.0 else score / 10.0 * 100.0 end)
      + 0.2 * (case when votes = 0 then 0.0 else log10(votes + 1) / 7.0 * 100.0 end)
      + 0.2 * (least(screening_count / 20.0::double, 1.0) * 100.0)
      + 0.1 * (case when is_new_release then 100.0 else 0.0 end), 2) as rec_score
    from full_films)"""
SCORE_EXPRESSION = MERGED_SQL[MERGED_SQL.index("round(\n"):MERGED_SQL.index(" as rec_score")]

# The same per issue.
ISSUE_SQL = f"""{FILMS_SQL}, {SCREENINGS_SQL},
issues as (select distinct issue_number, week_start from issue_shows),
keyed as (
    select i.issue_number, f.*, {KEY_SQL} as title_key, {ORDER_SQL} as ord
    from (select distinct issue_number, l_partkey from issue_shows) i join films f on f.p_partkey = i.l_partkey),
merged as (select issue_number, title_key, min(ord) as ord from keyed group by all),
stats as (
    select issue_number, {KEY_SQL} as title_key, count(*) as n, count(show_date) as dated,
           count(*) filter (where show_date - week_start between 0 and 6) as this_week,
           count(*) filter (where show_date - week_start between 7 and 13) as next_week,
           array_to_string(list_sort(list_distinct(list(theater_name))), '、') as theaters
    from issue_shows group by all),
full_films as (
    select m.issue_number, m.title_key, m.ord, k.title_jp, k.title_cn, k.director, k."cast" as actors, k.genre, k.url, k.score,
           k.votes, k.is_new_release, k.reviews, s.n as screening_count, s.dated, s.this_week, s.next_week, s.theaters
    from merged m join keyed k on k.issue_number = m.issue_number and k.ord = m.ord
    join stats s on s.issue_number = m.issue_number and s.title_key = m.title_key),
scored as (select *, {SCORE_EXPRESSION} as rec_score from full_films),
ranked as (
    select *, row_number() over (partition by issue_number order by rec_score desc, ord) as rank from scored)"""


def issue_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(film records, showings, issues) of every weekly capture."""
    captured = table(spark, sf, "lineitem").select("l_partkey", capture_week().alias("week_start")).distinct()
    records = (captured.select(issue_number(F.col("week_start")).alias("issue_number"), "l_partkey")
               .join(films(spark, sf, "p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
               .drop("l_partkey", "p_partkey"))
    issues = captured.select("week_start").distinct().select(issue_number(F.col("week_start")).alias("issue_number"), "week_start")
    return records, screenings(spark, sf).drop("l_partkey"), issues


# ---- pages made from orders: two film blocks in chain A's markup

#: Pages that one task reads, at most: some tens of seconds.
PAGES_PER_TASK = 20_000


def spread(df: DataFrame) -> DataFrame:
    """Narrow rows dealt out before wide pages are made of them: over all cores, and to tasks of a bounded number of pages however many there are.

    Rows that lie in enough splits stay where they are. They are counted from the files' footers.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // PAGES_PER_TASK))
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)


def order_pages(spark: SparkSession, sf: str) -> DataFrame:
    o = spread(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"))
    key = F.col("o_orderkey").cast("string")
    day = F.concat(F.month("o_orderdate").cast("string"), F.lit("/"), F.dayofmonth("o_orderdate").cast("string"))
    second = (F.when(F.col("o_orderstatus") == "F", F.lit("<tr><td>2/30</td><td>8:05</td><td>-</td></tr>"))
              .when(F.col("o_orderstatus") == "O", F.concat(F.lit("<tr><td>"), day, F.lit("</td><td> × </td></tr>")))
              .otherwise(F.concat(F.lit("<tr><td>"), day, F.lit("<td>21:00<tr><td>"), day, F.lit("<td>late</tr>"))))
    html = F.concat(
        F.lit("<html><script>'<div class=\"schedule-movie-detail\">'</script><!-- <h3>no</h3> -->"
              "<div class=\"x schedule-movie-detail\"><div><h3 class='schedule-movie-title'> <b>"),
        F.col("o_orderpriority"), F.lit("</b>　&amp;  &#x7247;</h3></div><div>ad</div><img alt=\"\" src=\"/img/"), key,
        F.lit(".jpg\"><table class=\"schedule-table\"><tr><th>日</th><th>時</th></tr><tr><td>"), day,
        F.lit("(月)</td><td>10:"), F.lpad((F.col("o_custkey") % 60).cast("string"), 2, "0"),
        F.lit("</td><td>―</td><td> 19:00 </td></tr><tr><td>note</td></tr></table></div>"
              "<div class=m-schedule-movie-detail><h4>"), F.col("o_orderstatus"),
        F.lit("</h4><img src=\"https://cdn.example/"), key, F.lit(".png\"><table class='m-schedule-table'>"),
        second, F.lit("</table></div></html>"))
    return o.select(
        F.lit("TOHO").alias("source"), F.col("o_orderkey").alias("page_id"), F.col("o_orderkey").alias("sched_ord"),
        F.concat(F.lit("T"), key).alias("theater_name"), F.lit("https://a.example").alias("base_url"), html.alias("html"))


# What the pages above hold, straight from the orders.
ORDER_DATE_SQL = """try_cast(concat(case when month(o_orderdate) = 1 then 1999 else 1998 end, '-',
    lpad(month(o_orderdate)::varchar, 2, '0'), '-', lpad(day(o_orderdate)::varchar, 2, '0')) as date)"""
ORDER_SHOWS_SQL = f"""shows as (
    select o_orderkey as page_id, 0 as pos, concat(o_orderpriority, ' & 片') as title_jp, 0 as slot, {ORDER_DATE_SQL} as show_date,
           concat('10:', lpad((o_custkey % 60)::varchar, 2, '0')) as start_time from orders
    union all select o_orderkey, 0, concat(o_orderpriority, ' & 片'), 1, {ORDER_DATE_SQL}, '19:00' from orders
    union all select o_orderkey, 1, 'F', 0, null, '8:05' from orders where o_orderstatus = 'F'
    union all select o_orderkey, 1, 'P', 0, {ORDER_DATE_SQL}, '21:00' from orders where o_orderstatus = 'P'
    union all select o_orderkey, 1, 'P', 1, {ORDER_DATE_SQL}, 'late' from orders where o_orderstatus = 'P')"""

# Page text without scripts, styles and comments, as the oracle sees it.
CLEAN_PAGES_SQL = r"""clean_pages as (
    select page_id, url, regexp_replace(html, '(?s)<script>.*?</script>|<style>.*?</style>|<!--.*?-->', '', 'g') as html
    from pages)"""
WS_SQL = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def text_sql(expression: str) -> str:
    """Cleaned text of an HTML fragment, in the oracle's SQL."""
    tags = f"regexp_replace({expression}, '</?[a-zA-Z!][^>]*>', '', 'g')"
    named = tags
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        named = f"replace({named}, '{entity}', '{char}')"
    return f"trim(regexp_replace({named}, '{WS_SQL}', ' ', 'g'))"

"""Theatres, pages, candidates, exports and the archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.catalog.bindings import (
    MERGED_SQL, WEEK, films, screenings, table)
from marquee.catalog.registry import query
from marquee.functions import fixed_values as fv
from marquee.functions.archive_text import issue_filename
from marquee.functions.dates import week_start
from marquee.operators.enrich import quick_rating
from marquee.operators.merge import film_stats, merge_titles, with_stats
from marquee.operators.rank import with_score
from marquee.plans.weekly import stage_folder
from marquee.sources.archive import next_issue, read_archive, scan_archive, write_issues
from marquee.sources.candidates import scan_candidates
from marquee.sources.export import export_rows
from marquee.sources.pages import scan_pages, scan_subjects
from marquee.sources.theaters import chain_theaters, independent_theaters


@query("theater_urls", """
    with t as (select *, s_nationkey % 3 as chain from supplier where s_acctbal > 0)
    select 'TOHO' as source, s_suppkey as sched_ord, lpad(s_suppkey::varchar, 6, '0') as theater_id, s_name as theater_name,
           'https://hlo.tohotheater.jp' as base_url,
           concat('https://hlo.tohotheater.jp/net/movie/', lpad(s_suppkey::varchar, 6, '0'), '/schedule/list.do') as schedule_url,
           true as enabled from t where chain = 0
    union all
    select 'United', 4294967296 + s_suppkey, lpad(s_suppkey::varchar, 6, '0'), s_name, 'https://www.unitedcinemas.jp',
           concat('https://www.unitedcinemas.jp/', lpad(s_suppkey::varchar, 6, '0'), '/daily.php'), true from t where chain = 1
    union all
    select '独立影院', 8589934592 + s_suppkey, lpad(s_suppkey::varchar, 6, '0'), s_name,
           concat('https://t', s_suppkey, '.example/tokyo/home'),
           concat('https://t', s_suppkey, '.example', case s_nationkey % 5 when 0 then '/' when 1 then '/schedule/'
                  when 2 then '/tokyo/now.html?d=1' when 3 then '/list' else '/tokyo/a' end), true from t where chain = 2""")
def theater_urls(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    path = (F.when(F.col("s_nationkey") % 5 == 0, None).when(F.col("s_nationkey") % 5 == 1, "/schedule/")
            .when(F.col("s_nationkey") % 5 == 2, "now.html?d=1").when(F.col("s_nationkey") % 5 == 3, "../list")
            .otherwise("./a"))
    locations = s.select(
        F.col("s_suppkey").cast("int").alias("ord"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("theater_id"),
        F.col("s_name").alias("theater_name"),
        F.concat(F.lit("https://t"), F.col("s_suppkey").cast("string"), F.lit(".example/tokyo/home")).alias("base_url"),
        path.alias("schedule_path"), (F.col("s_nationkey") % 3).alias("chain"), "s_acctbal")
    on = F.col("s_acctbal") > 0
    parts = [locations.filter(F.col("chain") == i) for i in range(3)]
    return (chain_theaters(parts[0], fv.CHAIN_A_SOURCE, 0, fv.CHAIN_A_BASE, fv.CHAIN_A_PATH, on)
            .unionByName(chain_theaters(parts[1], fv.CHAIN_B_SOURCE, 1, fv.CHAIN_B_BASE, fv.CHAIN_B_PATH, on))
            .unionByName(independent_theaters(parts[2], fv.INDEPENDENT_SOURCE, 2, on)))


@query("page_lookup", r"""
    with theaters as (select distinct regexp_replace(url, '[?#].*', '') as schedule_url from pages)
    select t.schedule_url, p.page_id, coalesce(length(p.html), 0) as html_length
    from theaters t left join pages p on p.url = t.schedule_url""")
def page_lookup(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    theaters = pages.select(F.regexp_replace("url", r"[?#].*", "").alias("schedule_url")).distinct()
    return scan_pages(theaters, pages).select(
        "schedule_url", "page_id", F.coalesce(F.length("html"), F.lit(0)).cast("long").alias("html_length"))


@query("json_candidates", r"""
    select event_id::varchar as query, n as pos, case n when 0 then event_id::varchar else 'x' end as id,
           case n when 0 then event_type else '' end as type,
           case n when 0 then regexp_extract(props, '[0-9]+') else '' end as year,
           n = 0 as has_rating, case when n = 0 then coalesce(value, 0) else 0 end as rating
    from events cross join (select unnest([0, 1])::integer as n) where event_type <> 'error'""")
def json_candidates(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("type"),
        F.regexp_extract("props", "[0-9]+", 0).alias("year"), F.struct(F.col("value").cast("string").alias("value")).alias("rating"))
    payload = F.concat(F.lit("["), F.to_json(F.struct("id", "type", "year", "rating")), F.lit(', {"id": "x"}]'))
    payload = F.when(F.col("type") == "error", F.concat(F.lit("<html>"), payload)).otherwise(payload)
    c = scan_candidates(e, F.col("id"), payload)
    return c.withColumn("rating", quick_rating(F.col("rating")))


@query("subject_pages", r"""
    with s as (select page_id, regexp_extract(url, '/([0-9]+)', 1) as id from pages),
    f as (select id, min(page_id) as p from s where id <> '' group by id)
    select id, case when p % 3 = 0 then null else concat('t', p) end as title_cn, concat('D', p, ' / ', 'E & F') as director,
           case when p % 2 = 0 then '' else 'a / b / c / d / e' end as "cast", 'G' as genre,
           case when p % 5 = 0 then 0 else (1990 + p % 30)::integer end as year, (90 + p % 60)::integer as duration,
           case when p % 4 = 0 then 0.0 else round((p % 100) / 10.0::double, 1) end as score,
           case when p % 7 = 0 then 0 else 1000 + p end as votes,
           case when p % 2 = 0 then 'fine' else 'fine|so so' end as reviews
    from f""")
def subject_pages_query(spark: SparkSession, sf: str) -> DataFrame:
    """Rating pages made from the captured pages: their own HTML with the rating markup in front."""
    p = F.col("page_id")
    t = p.cast("string")

    def unless(condition, *parts):
        return F.when(condition, F.lit("")).otherwise(F.concat(*parts))

    markup = F.concat(
        unless(p % 3 == 0, F.lit("<h1><span property=\"v:itemreviewed\"> t"), t, F.lit("　x y</span>")),
        unless(p % 5 == 0, F.lit("<span class=\"year\">("), (1990 + p % 30).cast("string"), F.lit(")</span>")), F.lit("</h1>"),
        F.lit("<a href='/d' rel=\"v:directedBy\"> D"), t, F.lit(" </a><a rel=\"v:directedBy\">E &amp; F</a>"),
        unless(p % 2 == 0, F.lit("".join(f"<a rel=\"v:starring\">{c}</a>" for c in "abcdefg"))),
        F.lit("<span property=\"v:genre\">G</span><span property=\"v:runtime\" content=\"1\">"), (90 + p % 60).cast("string"),
        F.lit("分钟 / 3</span>"),
        unless(p % 4 == 0, F.lit("<strong class=\"ll rating_num\" property=\"v:average\"> "),
               F.round((p % 100) / 10, 1).cast("string"), F.lit("</strong>")),
        unless(p % 7 == 0, F.lit("<span property=\"v:votes\">"), F.format_number(p + 1000, 0), F.lit("人</span>")),
        F.lit("<div class=\"comment-item\"><p><span class=\"short\"> fine </span></p></div><div class=\"comment-item\">"),
        unless(p % 2 == 0, F.lit("<span class=\"short\">so<br>  so</span>")), F.lit("</div>"))
    pages = table(spark, sf, "pages").select(
        "page_id", F.concat(F.lit("https://r.example/subject/"), F.regexp_extract("url", "/([0-9]+)", 1), F.lit("/")).alias("url"),
        F.concat(F.replace(markup, F.lit("so<br>  so"), F.lit("so  <i>so</i>")), "html").alias("html"))
    return scan_subjects(pages).withColumn("reviews", F.array_join("reviews", "|"))


@query("export_rows", f"""with {MERGED_SQL}
    select title_jp, title_cn, director, actors as "cast", year, genre, duration, score as rating_score, votes as rating_votes,
           url as rating_url, rec_score as recommendation_score, screening_count, is_new_release,
           array_to_string(names, '|') as theaters, array_to_string(reviews, '|') as short_reviews
    from scored""")
def export_rows_query(spark: SparkSession, sf: str) -> DataFrame:
    rows = export_rows(scored_films(spark, sf))
    return (rows.withColumn("theaters", F.array_join("theaters", "|"))
            .withColumn("short_reviews", F.array_join("short_reviews", "|")))


def scored_films(spark: SparkSession, sf: str) -> DataFrame:
    """All part records merged, counted over all showings, scored; week flags for one fixed week."""
    merged = merge_titles(films(spark, sf))
    return with_score(with_stats(merged, film_stats(screenings(spark, sf).drop("week_start"), None, week_start(WEEK))))


@query("issue_filename", """
    select doc_id, concat('briefing_', case when doc_id < 1000 then lpad(doc_id::varchar, 3, '0') else doc_id::varchar end,
                          '_2026-04-13.md') as file_name from documents""")
def issue_filename_query(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", issue_filename(F.col("doc_id"), F.lit("2026-04-13").cast("date")).alias("file_name"))


# One archived report per source and language; its parts are the documents, whole.
ARCHIVE_SQL = """archive as (
    select concat('briefing_', case when n < 1000 then lpad(n::varchar, 3, '0') else n::varchar end, '_2026-04-13.md') as file_name,
           n as issue_number, doc_id, text
    from (select doc_id, text, 10 * substr(source, 4)::integer + (case lang when 'de' then 1 when 'en' then 2 when 'es' then 3 else 4 end) as n
          from documents))"""


def _archive(spark: SparkSession, sf: str) -> str:
    """Write the archive to a new folder below the one that the cluster shares, and return its path. Every source is written twice, at first with a draft."""
    lang = F.when(F.col("lang") == "de", 1).when(F.col("lang") == "en", 2).when(F.col("lang") == "es", 3).otherwise(4)
    number = F.substring("source", 4, 9).cast("int") * 10 + lang
    parts = table(spark, sf, "documents").select(
        issue_filename(number, F.lit("2026-04-13").cast("date")).alias("file_name"), F.col("doc_id").alias("part_key"), "text")
    path = f"{stage_folder(spark)}/archive"
    write_issues(parts.select("file_name").distinct().select("file_name", F.lit(0).alias("part_key"), F.lit("draft").alias("text")), path)
    write_issues(parts, path)
    return path


@query("archive_catalog", f"""with {ARCHIVE_SQL}
    select file_name, round(sum(strlen(text) + 1) / 1024.0::double, 1) as size_kb from archive group by file_name""")
def archive_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return scan_archive(spark, _archive(spark, sf)).select("file_name", "size_kb")


@query("archive_text", f"""with {ARCHIVE_SQL},
    texts as (select file_name, concat(string_agg(text, chr(10) order by doc_id), chr(10)) as text from archive group by file_name),
    wanted as (select file_name from texts union all select 'briefing_9' || file_name from texts)
    select w.file_name, length(coalesce(t.text, '')) as n_chars, md5(coalesce(t.text, '')) as digest
    from wanted w left join texts t on t.file_name = w.file_name""")
def archive_text(spark: SparkSession, sf: str) -> DataFrame:
    path = _archive(spark, sf)
    names = scan_archive(spark, path).select("file_name")
    wanted = names.unionByName(names.select(F.concat(F.lit("briefing_9"), "file_name").alias("file_name")))
    return read_archive(spark, path, wanted).select(
        "file_name", F.length("text").cast("long").alias("n_chars"), F.md5(F.encode("text", "UTF-8")).alias("digest"))


@query("next_issue", """
    select coalesce(max(case when doc_id % 3 = 0 then null else doc_id end), 0) + 1 as next_issue from documents""")
def next_issue_query(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    number = F.col("doc_id").cast("string")
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("step"), number, F.lit("_2026-04-13.md"))).otherwise(
        F.concat(F.lit("briefing_0"), number, F.lit("_2026-04-13.md")))
    return next_issue(d.select(name.alias("file_name")))

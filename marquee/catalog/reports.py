"""Report columns, sections, whole issues, and columns over archived reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.catalog.bindings import (
    AS_OF, FILMS_SQL, ISSUE_SQL, MERGED_SQL, SCORE_EXPRESSION, WEEK, films, issue_tables, order_pages, spread, table)
from marquee.catalog.registry import query
from marquee.catalog.scans import scored_films
from marquee.functions import fixed_values as fv
from marquee.functions.archive_text import draft_payload, extract_title, restyle_headings, valid_name
from marquee.functions.dates import date_label
from marquee.functions.report_text import issue_title, movie_block, ranking_row, review_block, stars
from marquee.functions.scoring import rank_label
from marquee.functions.text import display_title, short_title
from marquee.operators.rank import rank_all
from marquee.operators.report import (
    ReportOptions, film_columns, issue_labels, issue_parts, section_text)
from marquee.plans.weekly import generate_reports, raw_tables, stage, stage_folder, weekly_job
from marquee.plans.weekly import scored_films as issue_scored_films
from marquee.operators.extract import extract_chain_a
from marquee.operators.merge import film_stats, merge_titles, with_stats
from marquee.operators.rank import with_score
from marquee.sources.candidates import scan_candidates
from marquee.sources.pages import scan_subjects

OPTIONS = ReportOptions(title_template="Report {issue_number}: {week_start} ~ {week_end}", subtitle="weekly", footer="end")

STARS_SQL = """case when score = 0 then '暂无评分' else concat(
    repeat('★', floor(score / 2)::bigint), case when score / 2 - floor(score / 2) >= 0.5 then '☆' else '' end,
    repeat('　', 5 - floor(score / 2)::bigint - case when score / 2 - floor(score / 2) >= 0.5 then 1 else 0 end),
    '  ', printf('%.1f', score)) end"""
DISPLAY_SQL = "case when title_cn = '' then title_jp when title_cn = title_jp then title_cn else concat(title_cn, '（', title_jp, '）') end"


def reviews_sql(n: int) -> str:
    return f"coalesce(array_to_string([concat('> 💬 ', r, chr(10)) for r in reviews[1:{n}]], ''), '')"


def block_sql(n: int) -> str:
    lines = ["'### ◆. ', " + DISPLAY_SQL, "''", "'| 项目 | 内容 |'", "'|------|------|'", "'| 🎬 原题 | ', title_jp, ' |'",
             "'| 🌐 豆瓣 | [', " + STARS_SQL + ", '](', coalesce(nullif(url, ''), 'https://movie.douban.com'), ') |'",
             "'| 👤 导演 | ', coalesce(nullif(director, ''), '—'), ' |'", "'| 🎭 主演 | ', coalesce(nullif(actors, ''), '—'), ' |'",
             "'| 🏷️ 类型 | ', coalesce(nullif(genre, ''), '—'), ' |'", "'| 📍 上映影院 | ', coalesce(nullif(theaters, ''), '—'), ' |'", "''"]
    return "concat(" + ", chr(10), ".join(lines) + ", chr(10), " + reviews_sql(n) + ")"


ROW_SQL = """concat('| ', case rank when 1 then '🥇' when 2 then '🥈' when 3 then '🥉' else rank::varchar end, ' | ',
    coalesce(nullif(title_cn, ''), title_jp), ' | ', printf('%.0f', rec_score), '/100 | ',
    case when score = 0 then '—' else printf('%.1f', score) end, ' | ', coalesce(nullif(theaters, ''), '—'), ' |')"""


@query("stars", f"with {FILMS_SQL} select p_partkey, {STARS_SQL} as stars from films")
def stars_query(spark: SparkSession, sf: str) -> DataFrame:
    return films(spark, sf, "p_partkey").select("p_partkey", stars(F.col("score")).alias("stars"))


@query("display_title", f"with {FILMS_SQL} select p_partkey, {DISPLAY_SQL} as title from films")
def display_title_query(spark: SparkSession, sf: str) -> DataFrame:
    return films(spark, sf, "p_partkey").select("p_partkey", display_title(F.col("title_jp"), F.col("title_cn")).alias("title"))


@query("short_title", f"with {FILMS_SQL} select p_partkey, coalesce(nullif(title_cn, ''), title_jp) as title from films")
def short_title_query(spark: SparkSession, sf: str) -> DataFrame:
    return films(spark, sf, "p_partkey").select("p_partkey", short_title(F.col("title_jp"), F.col("title_cn")).alias("title"))


@query("date_label", "select o_orderkey, concat(month(o_orderdate), '月', day(o_orderdate), '日') as label from orders")
def date_label_query(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", date_label(F.col("o_orderdate")).alias("label"))


@query("review_block", f"with {FILMS_SQL} select p_partkey, {reviews_sql(3)} as three, {reviews_sql(1)} as one from films")
def review_block_query(spark: SparkSession, sf: str) -> DataFrame:
    return films(spark, sf, "p_partkey").select(
        "p_partkey", review_block(F.col("reviews"), 3).alias("three"), review_block(F.col("reviews"), 1).alias("one"))


@query("movie_block", f"with {MERGED_SQL} select title_key, {block_sql(3)} as block from scored")
def movie_block_query(spark: SparkSession, sf: str) -> DataFrame:
    return scored_films(spark, sf).select("title_key", movie_block(film_columns(), 3).alias("block"))


@query("ranking_row", f"""with {MERGED_SQL}, r as (select *, row_number() over (order by rec_score desc, ord) as rank from scored)
    select rank, {ROW_SQL} as row_text from r""")
def ranking_row_query(spark: SparkSession, sf: str) -> DataFrame:
    ranked = rank_all(stage(scored_films(spark, sf), "scored", stage_folder(spark)))
    return ranked.select(
        F.col("rank").cast("long").alias("rank"), ranking_row(rank_label(F.col("rank")), film_columns()).alias("row_text"))


@query("section_text", """
    select conv_id, string_agg(text, chr(10) order by turn) as text from conversations group by conv_id""")
def section_text_query(spark: SparkSession, sf: str) -> DataFrame:
    return section_text(table(spark, sf, "conversations"), ["conv_id"], "turn")


@query("issue_title", f"""with {ISSUE_SQL}
    select issue_number, concat('Report ', issue_number, ': ', month(week_start), '月', day(week_start), '日 ~ ',
        month(week_start + 6), '月', day(week_start + 6), '日') as title,
        concat(month(week_start + 7), '月', day(week_start + 7), '日') as next_start_label from issues""")
def issue_title_query(spark: SparkSession, sf: str) -> DataFrame:
    _, _, issues = issue_tables(spark, sf)
    return issue_labels(issues, OPTIONS).select("issue_number", "title", "next_start_label")


def label_sql(days: int) -> str:
    return f"concat(month(week_start + {days}), '月', day(week_start + {days}), '日')"


PARTS_OF_SCORED = f"""
    flags as (select issue_number, bool_or(this_week > 0 or dated = 0) as now, bool_or(next_week > 0) as coming from scored group by all),
    head as (select i.*, coalesce(now, false) as now, coalesce(coming, false) as coming from issues i left join flags f on f.issue_number = i.issue_number),
    next_films as (select *, row_number() over (partition by issue_number order by rec_score desc, ord) as n from scored where next_week > 0),
    parts as (
        select issue_number, 1 as section, 0 as place, concat('# Report ', issue_number, ': ', {label_sql(0)}, ' ~ ', {label_sql(6)}, chr(10), '> weekly',
            chr(10), chr(10), '---', chr(10), chr(10), '## 📅 本周上映（', {label_sql(0)}, ' ～ ', {label_sql(6)}, '）', chr(10)) as text from head
        union all select issue_number, 2, rank, {block_sql(3)} from ranked where this_week > 0 or dated = 0
        union all select issue_number, 3, 0, concat(case when now then '' else chr(10) end, chr(10), '---', chr(10), chr(10), '## 🏆 本周推荐榜 Top 10', chr(10),
            chr(10), '| 排名 | 电影 | 推荐指数 | 豆瓣评分 | 上映影院 |', chr(10), '|------|------|----------|----------|----------|') from head
        union all select issue_number, 4, rank, {ROW_SQL} from ranked where rank <= 10
        union all select issue_number, 5, 0, concat(chr(10), '---', chr(10), chr(10), '## 📌 下周预告（', {label_sql(7)}, ' ～ ', {label_sql(13)}, '）', chr(10)) from head where coming
        union all select issue_number, 6, n, {block_sql(1)} from next_films where n <= 5
        union all select issue_number, 7, 0, concat(chr(10), '---', chr(10), chr(10), 'end') from head)"""

PARTS_SQL = f"{ISSUE_SQL},{PARTS_OF_SCORED}"


@query("issue_parts", f"with {PARTS_SQL} select issue_number, section, text from parts")
def issue_parts_query(spark: SparkSession, sf: str) -> DataFrame:
    records, shown, issues = issue_tables(spark, sf)
    scored = stage(issue_scored_films(records, shown, issues), "scored_films", stage_folder(spark))
    return issue_parts(issues, scored, OPTIONS).select("issue_number", "part_key.section", "text")


@query("issue_document", f"""with {PARTS_SQL}
    select p.issue_number, i.week_start, concat(string_agg(text, chr(10) order by section, place), chr(10)) as markdown
    from parts p join issues i on i.issue_number = p.issue_number group by all""")
def issue_document_query(spark: SparkSession, sf: str) -> DataFrame:
    documents, _ = generate_reports(*issue_tables(spark, sf), OPTIONS, stage_folder(spark))
    return documents


@query("valid_name", """
    select doc_id, doc_id % 5 in (0, 1) as valid from documents""")
def valid_name_query(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    kind = F.col("doc_id") % 5
    name = (F.when(kind == 0, F.concat(F.lit("briefing_"), n, F.lit("_2026-04-13.md")))
            .when(kind == 1, F.concat(F.lit("step"), n, F.lit("_2026-04-13.md")))
            .when(kind == 2, F.concat(F.lit("briefing_"), n, F.lit("_2026-04-13.md\n")))
            .when(kind == 3, F.concat(F.lit("../briefing_"), n, F.lit("_2026-04-13.md")))
            .otherwise(F.concat(F.lit("briefing_"), n, F.lit("_2026-4-13.md"))))
    return table(spark, sf, "documents").select("doc_id", valid_name(name).alias("valid"))


@query("extract_title", r"""
    with lines as (select doc_id, unnest(regexp_split_to_array(text, '\r\n|[\n\x{0b}\f\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]')) as line,
                          unnest(range(0, len(regexp_split_to_array(text, '\r\n|[\n\x{0b}\f\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]')))) as i from documents),
    first as (select doc_id, arg_min(line, i) as line from (select doc_id, trim(line) as line, i from lines) where line <> '' group by doc_id)
    select d.doc_id, case when doc_id % 3 = 0 and line is not null then trim(line) else 'untitled' end as title
    from documents d left join first using (doc_id)""")
def extract_title_query(spark: SparkSession, sf: str) -> DataFrame:
    """The first line that is not blank becomes a heading in a third of the documents."""
    heading = F.regexp_replace("text", r"\A(?U)(\s*)(\S)", "$1  # $2")
    other = F.regexp_replace("text", r"\A(?U)(\s*)(\S)", "$1#$2")
    markdown = F.when(F.col("doc_id") % 3 == 0, heading).otherwise(other)
    return table(spark, sf, "documents").select("doc_id", extract_title(markdown, "untitled").alias("title"))


@query("restyle_headings", f"""
    select page_id, concat('<div style="', $style${fv.ARTICLE_STYLE}$style$, '">',
        regexp_replace(html, '<h1>([^\\n]*?)</h1>', '<p style="{fv.HEADING_STYLES["h1"]}">\\1</p>', 'g'), '</div>') as html from pages""")
def restyle_headings_query(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", restyle_headings(F.col("html")).alias("html"))


@query("draft_payload", r"""
    select doc_id, concat('{"articles":[{"title":"', source, '","author":"', lang, '","digest":"', case lang when 'en' then source else 'd' end,
        '","content":', to_json(concat('<p>', text, '</p>'))::varchar, ',"content_source_url":"","need_open_comment":0,"only_fans_can_comment":0',
        case lang when 'fr' then ',"thumb_media_id":"m1"' else '' end, '}]}') as payload from documents""")
def draft_payload_query(spark: SparkSession, sf: str) -> DataFrame:
    """The payload of every document, with its whole text as content."""
    lang = F.col("lang")
    return table(spark, sf, "documents").select("doc_id", draft_payload(
        F.col("source"), lang, F.when(lang == "en", "").otherwise("d"),
        F.concat(F.lit("<p>"), "text", F.lit("</p>")),
        F.when(lang == "fr", "m1").when(lang == "de", "")).alias("payload"))


@query("pages_to_films", """
    with shows as (
        select concat(o_orderpriority, ' & 片') as title_jp, o_orderkey, 0 as pos, concat('T', o_orderkey) as theater, 2 as n,
               concat('https://a.example/img/', o_orderkey, '.jpg') as poster from orders
        union all select o_orderstatus, o_orderkey, 1, concat('T', o_orderkey), case o_orderstatus when 'F' then 1 else 2 end,
               concat('https://cdn.example/', o_orderkey, '.png') from orders where o_orderstatus <> 'O')
    select lower(replace(title_jp, ' ', '')) as title_key, arg_min(title_jp, o_orderkey) as title_jp, min(o_orderkey)::bigint as first_page,
           arg_min(poster, o_orderkey) as poster_url, sum(n)::bigint as screening_count, count(distinct theater) as theaters,
           round(0.2 * least(sum(n) / 20.0::double, 1.0) * 100.0, 2) + 0.0 as score_without_new
    from shows group by 1""")
def pages_to_films(spark: SparkSession, sf: str) -> DataFrame:
    """Pages to extracted, merged, counted and scored films in one plan."""
    pages = order_pages(spark, sf).withColumn("issue_number", F.lit(1))
    page_films = stage(extract_chain_a(pages.drop("page_id"), AS_OF), "page_films", stage_folder(spark))
    raw, shown = raw_tables(page_films)
    merged = merge_titles(raw.drop("screening_count"), ["issue_number"])
    scored = with_score(with_stats(merged, film_stats(shown, ["issue_number"], theater_count=True), ["issue_number"]))
    return scored.select(
        "title_key", "title_jp", F.col("first_seen.sched_ord").alias("first_page"), "poster_url", "screening_count",
        F.col("theater_count").alias("theaters"),
        F.round(F.col("rec_score") - F.when(F.col("is_new_release"), 10.0).otherwise(0.0), 2).alias("score_without_new"))


# The whole job. Customers are theatres with one captured page each, nations are issues. Pages are of five
# kinds: chain A, chain B, an independent theatre, chain A with links only, an independent one with headings only.
JOB_SQL = f"""base as (select c_custkey as k, c_nationkey as issue_number, c_name as theater, c_custkey % 40 as n, c_custkey % 5 as kind from customer),
issues as (select distinct issue_number, cast(date '1998-06-01' - cast(7 * (issue_number % 3) as integer) as date) as week_start from base),
rows as (select *, case kind when 0 then concat('Film ', n, '（字幕版）') when 4 then concat('上映 Film ', n) else concat('Film ', n) end as title_jp,
                case kind when 4 then concat('上映film', n) else concat('film', n) end as title_key from base),
merged as (select issue_number, title_key, min(k) as ord from rows group by all),
shows as (select issue_number, title_key, theater, date '1998-06-03' as d, case kind when 2 then 1 else 2 end as c from rows where kind in (0, 1, 2)
          union all select issue_number, title_key, theater, date '1998-06-09', 1 from rows where kind = 0),
stats as (select s.issue_number, title_key, sum(c)::bigint as n, coalesce(sum(c) filter (where d - week_start between 0 and 6), 0)::bigint as this_week,
                 coalesce(sum(c) filter (where d - week_start between 7 and 13), 0)::bigint as next_week,
                 array_to_string(list_sort(list_distinct(list(theater))), '、') as theaters
          from shows s join issues i on i.issue_number = s.issue_number group by all),
rated as (select m.*, title_jp, n, kind in (0, 1) as is_new_release, kind in (1, 2, 3) and n % 4 <> 0 as matched, kind in (1, 2, 3) and n % 4 <> 0 and n % 3 = 0 as found
          from merged m join rows r on r.issue_number = m.issue_number and r.k = m.ord),
full_films as (
    select r.issue_number, r.title_key, r.ord, r.title_jp, case when found then concat('CN', r.n) else '' end as title_cn,
           case when found then 'D' else '' end as director, '' as actors, case when found then 'G' else '' end as genre,
           case when matched then concat('https://movie.douban.com/subject/', r.n, '/') else '' end as url,
           case when found then 8.5 when matched and r.n % 4 = 2 then r.n / 10.0::double else 0.0 end as score,
           case when found then 1000 * r.n else 0 end as votes, is_new_release, case when found then ['r'] else []::varchar[] end as reviews,
           coalesce(s.n, 0) as screening_count, coalesce(s.n, 0) as dated, coalesce(s.this_week, 0) as this_week, coalesce(s.next_week, 0) as next_week,
           coalesce(s.theaters, '') as theaters
    from rated r left join stats s on s.issue_number = r.issue_number and s.title_key = r.title_key),
scored as (select *, {SCORE_EXPRESSION} as rec_score from full_films),
ranked as (select *, row_number() over (partition by issue_number order by rec_score desc, ord) as rank from scored)"""


@query("weekly_job", f"with {JOB_SQL},{PARTS_OF_SCORED} select issue_number, section, text from parts")
def weekly_job_query(spark: SparkSession, sf: str) -> DataFrame:
    """Captured pages of all chains to the report parts of every issue, in one job."""
    key, n, kind = F.col("c_custkey").cast("string"), F.col("c_custkey") % 40, F.col("c_custkey") % 5
    title = F.concat(F.lit("Film "), n.cast("string"))
    a = F.concat(F.lit("<div class=schedule-movie-detail><h3>"), title, F.lit("（字幕版）</h3><img src='/"), key,
                 F.lit(".jpg'><table class=schedule-table><tr><td><b>6</b>/3</td><td>10:00</td><td>12:00</td></tr><tr><td>6/9</td><td>9:00</td></tr></table></div>"))
    b = F.concat(F.lit("<div class=programBox><h2>"), title, F.lit("</h2><span class=showtime>13:20～</span><time>売切</time></div>"))
    own = F.concat(F.lit("<article class=movie><h2>"), title, F.lit("</h2><span class=time>19:00</span></article>"))
    links = F.concat(F.lit("<a href='/net/movie/"), key, F.lit("'>"), title, F.lit("</a><a href='/about'>about</a>"))
    headings = F.concat(F.lit("<section><h2 class=title>上映 "), title, F.lit("</h2></section>"))
    source = F.when(kind.isin(0, 3), fv.CHAIN_A_SOURCE).when(kind == 1, fv.CHAIN_B_SOURCE).otherwise(fv.INDEPENDENT_SOURCE)
    customers = spread(table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey"))
    pages = customers.select(
        F.col("c_nationkey").alias("issue_number"), source.alias("source"), F.col("c_custkey").alias("sched_ord"), F.col("c_name").alias("theater_name"),
        F.when(kind.isin(2, 4), "https://uplink.example/").otherwise("https://a.example").alias("base_url"),
        F.when(kind == 0, a).when(kind == 1, b).when(kind == 2, own).when(kind == 3, links).otherwise(headings).alias("html"))
    titles = table(spark, sf, "customer").select(n.alias("n"), title.alias("title")).distinct()
    number = F.col("n").cast("string")
    rating = F.when(F.col("n") % 4 == 1, F.lit("n/a")).when(F.col("n") % 4 == 2, (F.col("n") / 10).cast("string")).otherwise("")
    answers = titles.filter("n % 4 <> 0").select("title", F.concat(
        F.lit('[{"id": "0", "type": "tv"}, '), F.to_json(F.struct(number.alias("id"), F.lit("movie").alias("type"), F.struct(rating.alias("value")).alias("rating"))), F.lit("]")).alias("payload"))
    subjects = titles.filter("n % 3 = 0").select(
        F.col("n").alias("page_id"), F.concat(F.lit("https://r.example/subject/"), number, F.lit("/")).alias("url"),
        F.concat(F.lit("<h1><span property='v:itemreviewed'>CN"), number, F.lit("</span></h1><a rel='v:directedBy'>D</a><span property='v:genre'>G</span>"
                 "<strong class='ll rating_num'>8.5</strong><span property='v:votes'>"), (F.col("n") * 1000).cast("string"),
                 F.lit("人</span><div class=comment-item><span class=short>r</span></div>")).alias("html"))
    issues = table(spark, sf, "customer").select(F.col("c_nationkey").alias("issue_number")).distinct().withColumn(
        "week_start", F.date_sub(F.lit("1998-06-01").cast("date"), (F.col("issue_number") % 3) * 7))
    parts, _ = weekly_job(pages, scan_candidates(answers, F.col("title"), F.col("payload")), scan_subjects(subjects), issues, WEEK, OPTIONS, stage_folder(spark))
    return parts.select("issue_number", "part_key.section", "text")

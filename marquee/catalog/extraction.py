"""Text, date and page extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.catalog.bindings import (
    AS_OF, CLEAN_PAGES_SQL, ORDER_DATE_SQL, ORDER_SHOWS_SQL, SHOW_DATE, WS_SQL, order_pages, spread, table, text_sql)
from marquee.catalog.registry import query
from marquee.functions import fixed_values as fv
from marquee.functions.dates import parse_month_day
from marquee.functions.html import TEXT, absolute_link, select_all
from marquee.functions.text import clean_text, parse_time_lenient, parse_time_strict
from marquee.operators.extract import (
    anchor_titles, block_titles, drop_placeholders, explode_blocks, extract_chain_a, extract_chain_b, extract_independent,
    filter_dates, generic_titles, page_movies, page_screenings, row_cells, selector_profile, theater_coverage,
    union_sources)


@query("clean_text", f"select doc_id, trim(regexp_replace(text, '{WS_SQL}', ' ', 'g')) as text from documents")
def clean_text_query(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", clean_text(F.col("text")).alias("text"))


@query("page_blocks", f"""with {CLEAN_PAGES_SQL},
    pieces as (select page_id, string_split(html, '<p>') as p from clean_pages),
    blocks as (select page_id, unnest(range(0, len(p) - 1)) as pos, unnest(p[2:]) as block from pieces)
    select page_id, pos::integer as pos, {text_sql("regexp_replace(block, '(?s)(</p>|</article>|</body>).*', '')")} as block_text from blocks""")
def page_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs, many of which lack their end tag, in page order."""
    texts = select_all(F.col("html"), "p", TEXT)
    return table(spark, sf, "pages").select("page_id", F.posexplode(texts).alias("pos", "text")).select("page_id", "pos", clean_text(F.col("text")).alias("block_text"))


@query("page_titles", f"""with {CLEAN_PAGES_SQL}
    select page_id, {text_sql("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} as title_jp from clean_pages
    where length({text_sql("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")}) >= 2""")
def page_titles(spark: SparkSession, sf: str) -> DataFrame:
    blocks = explode_blocks(table(spark, sf, "pages"), "article, .movie")
    return block_titles(blocks, "h1, .movie-title", min_length=2).select("page_id", "title_jp")


LINKS_SQL = f"""{CLEAN_PAGES_SQL},
    anchors as (select page_id, url, unnest(regexp_extract_all(html, '<a href="[^"]*"')) as a,
                       unnest(range(0, len(regexp_extract_all(html, '<a href="[^"]*"')))) as pos from clean_pages),
    hrefs as (select page_id, url, pos::integer as pos, replace(regexp_extract(a, '"([^"]*)"', 1), '&amp;', '&') as href from anchors)"""


@query("absolute_links", f"""with {LINKS_SQL}
    select page_id, pos,
        case pos % 5 when 0 then regexp_extract(url, '^https?://[^/]+') || href
            when 1 then regexp_replace(regexp_replace(url, '[?#].*', ''), '[^/]*$', '') || substr(href, 2)
            when 2 then 'https://cdn.example' || href
            when 3 then regexp_extract(url, '^https?:') || '//cdn.example' || href
            else regexp_replace(url, '[?#].*', '') || '?q=' || substr(href, 2) end as link,
        'https://b.example' || href as joined
    from hrefs""")
def absolute_links(spark: SparkSession, sf: str) -> DataFrame:
    """Anchor links of every page, in the five forms a link can take, resolved against the page."""
    rows = table(spark, sf, "pages").select("page_id", "url", F.posexplode(select_all(F.col("html"), "a[href]", "@href")).alias("pos", "href"))
    form = F.col("pos") % 5
    link = (F.when(form == 0, F.col("href")).when(form == 1, F.substr("href", F.lit(2)))
            .when(form == 2, F.concat(F.lit("https://cdn.example"), "href"))
            .when(form == 3, F.concat(F.lit("//cdn.example"), "href"))
            .otherwise(F.concat(F.lit("?q="), F.substr("href", F.lit(2)))))
    rows = rows.withColumn("form", link)
    return rows.select("page_id", "pos", absolute_link(F.col("form"), F.col("url"), join_links=True).alias("link"),
                       absolute_link(F.col("href"), F.lit("https://b.example"), join_links=False).alias("joined"))


@query("row_cells", """
    select o_orderkey as page_id, 0 as pos, 0 as row_no,
           concat(month(o_orderdate), '/', day(o_orderdate), '(月)|10:', lpad((o_custkey % 60)::varchar, 2, '0'), '|―|19:00') as cells
    from orders
    union all
    select o_orderkey, 1, n::integer, case o_orderstatus when 'F' then '2/30|8:05|-'
           when 'O' then concat(month(o_orderdate), '/', day(o_orderdate), '|×')
           else concat(month(o_orderdate), '/', day(o_orderdate), case n when 0 then '|21:00' else '|late' end) end
    from orders cross join (select unnest([0, 1]) as n) where n = 0 or o_orderstatus not in ('F', 'O')""")
def row_cells_query(spark: SparkSession, sf: str) -> DataFrame:
    cells = row_cells(F.col("html"), fv.CHAIN_A_BLOCK, ".schedule-table tr, .m-schedule-table tr")
    blocks = order_pages(spark, sf).select("page_id", F.posexplode(cells).alias("pos", "rows"))
    rows = blocks.select("page_id", "pos", F.posexplode("rows").alias("row_no", "c"))
    return rows.select("page_id", "pos", "row_no", F.array_join(F.transform("c", clean_text), "|").alias("cells"))


@query("parse_month_day", f"""select o_orderkey, {ORDER_DATE_SQL} as show_date from orders""")
def parse_month_day_query(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("～"), F.month("o_orderdate").cast("string"), F.lit("/"), F.dayofmonth("o_orderdate").cast("string"),
                    F.lit("(日) 1/1"))
    full_width = F.translate(text, "0123456789", "０１２３４５６７８９")
    text = F.when(F.col("o_orderkey") % 2 == 0, text).otherwise(full_width)
    return table(spark, sf, "orders").select("o_orderkey", parse_month_day(text, AS_OF).alias("show_date"))


@query("filter_dates", """
    with shows as (select l_orderkey, l_partkey, l_suppkey, case when l_quantity = 50 then null else cast(l_shipdate as date) end as show_date
                   from lineitem),
    dates as (select distinct cast(o_orderdate as date) as d from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'F')
    select * from shows where show_date is null or show_date in (select d from dates)""")
def filter_dates_query(spark: SparkSession, sf: str) -> DataFrame:
    shows = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.expr(SHOW_DATE).alias("show_date"))
    wanted = (table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'")
              .select(F.col("o_orderdate").cast("date").alias("show_date")))
    return filter_dates(shows, wanted)


@query("drop_placeholders", """
    select event_id, strftime(ts, '%H:%M') as start_time from events where event_type = 'purchase'""")
def drop_placeholders_query(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    cell = (F.when(kind == "error", "-").when(kind == "view", "―").when(kind == "click", "×").when(kind == "signup", "")
            .otherwise(F.date_format("ts", "HH:mm")))
    return drop_placeholders(table(spark, sf, "events").select("event_id", cell.alias("start_time")))


def _time_text(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    text = (F.when(kind == "error", F.lit("　sold out ")).when(kind == "view", F.lit("  "))
            .when(kind == "click", F.date_format("ts", "H:mm"))
            .otherwise(F.concat(F.lit("開演 "), F.date_format("ts", "HH:mm"), F.lit("～23:59"))))
    return table(spark, sf, "events").select("event_id", text.alias("text"))


@query("parse_time", """
    select event_id, case event_type when 'error' then 'sold out' when 'click' then concat(hour(ts), strftime(ts, ':%M'))
                     else strftime(ts, '%H:%M') end as start_time
    from events where event_type <> 'view'""")
def parse_time(spark: SparkSession, sf: str) -> DataFrame:
    return (_time_text(spark, sf).select("event_id", parse_time_lenient(F.col("text")).alias("start_time"))
            .filter("start_time <> ''"))


@query("parse_time_strict", """
    select event_id, case event_type when 'click' then concat(hour(ts), strftime(ts, ':%M')) else strftime(ts, '%H:%M') end as start_time
    from events where event_type not in ('view', 'error')""")
def parse_time_strict_query(spark: SparkSession, sf: str) -> DataFrame:
    return (_time_text(spark, sf).select("event_id", parse_time_strict(F.col("text")).alias("start_time"))
            .filter("start_time <> ''"))


@query("new_release_flag", f"""with {ORDER_SHOWS_SQL}
    select page_id, pos, title_jp, show_date >= date '1998-12-08' as is_new_release from shows where slot = 0""")
def new_release_flag(spark: SparkSession, sf: str) -> DataFrame:
    """First kept showing of each film at most a week old; NULL when its date is unknown."""
    return extract_chain_a(order_pages(spark, sf), AS_OF).select("page_id", "pos", "title_jp", "is_new_release")


@query("page_movies", f"""with {ORDER_SHOWS_SQL}
    select page_id, pos, title_jp,
           case pos when 0 then concat('https://a.example/img/', page_id, '.jpg') else concat('https://cdn.example/', page_id, '.png') end as poster_url,
           bool_or(slot = 0 and show_date >= date '1998-12-08') filter (where slot = 0 and show_date is not null) as is_new_release,
           count(*) as screening_count
    from shows group by page_id, pos, title_jp""")
def page_movies_query(spark: SparkSession, sf: str) -> DataFrame:
    return page_movies(extract_chain_a(order_pages(spark, sf), AS_OF), ["page_id"])


@query("page_screenings", f"""with {ORDER_SHOWS_SQL}
    select page_id as sched_ord, concat('T', page_id) as theater_name, pos, title_jp, slot, show_date, start_time from shows""")
def page_screenings_query(spark: SparkSession, sf: str) -> DataFrame:
    return page_screenings(extract_chain_a(order_pages(spark, sf), AS_OF))


OWN_PROFILE = {"block": "article", "title": "h1", "time": ".time"}


def _plain_pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.col("url").alias("base_url"), "html")


@query("independent_pages", f"""with {CLEAN_PAGES_SQL}
    select page_id, 0 as pos, {text_sql("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} as title_jp, '' as poster_url,
           false as is_new_release, 0::bigint as screening_count
    from clean_pages where length({text_sql("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")}) >= 2""")
def independent_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Films of pages with the selectors given for them; films without showings are kept."""
    return page_movies(extract_independent(_plain_pages(spark, sf), AS_OF, profiles={}, generic=OWN_PROFILE), ["page_id"])


PART_PAGES_SQL = """part_films as (
    select p_partkey as page_id, 0 as pos, p_name as title_jp,
           case when p_size % 2 = 0 then concat('https://b.example/', p_partkey, '.png') else '' end as poster_url,
           p_type not in ('PROMO', 'LARGE') as is_new_release,
           case p_type when 'PROMO' then 0 when 'LARGE' then 0 when 'SMALL' then 3 else 2 end::bigint as screening_count
    from part where p_type <> 'LARGE' and p_type <> 'PROMO'
    union all
    select p_partkey, 0, p_brand, '', false, 0 from part where p_type = 'PROMO'
    union all
    select p_partkey, 1, concat(p_name, '!'), '', false, 0 from part where p_type = 'PROMO')"""


@query("chain_b_pages", f"with {PART_PAGES_SQL} select * from part_films")
def chain_b_pages(spark: SparkSession, sf: str) -> DataFrame:
    return page_movies(extract_chain_b(part_pages(spark, sf), AS_OF), ["page_id"])


def part_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A page per part in chain B's markup: films with times, films without, or only links."""
    kind = F.col("p_type")
    image = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("<img src='/"), F.col("p_partkey").cast("string"), F.lit(".png'>"))).otherwise("")
    extra = F.when(kind == "SMALL", F.lit("<div class='movie-block'><h3>%</h3><span class='time'>9:00</span></div>")).otherwise("")
    block = F.concat(
        F.lit("<div class=programBox><div><h2> "), F.col("p_name"), F.lit("</h2>"), image,
        F.lit("</div><span class='showtime'>13:20～</span><time>売切</time><time> </time></div>"))
    links = F.concat(
        F.lit("<div class=programBox><h2>no times</h2></div><a href='/film/1'>"), F.col("p_brand"),
        F.lit("</a><a href='/movie/2'> "), F.col("p_name"), F.lit("!</a><a href='/film/3'>x</a><a href='/movie/2'>"), F.col("p_brand"),
        F.lit("</a><a href='/about'>about</a>"))
    html = F.when(kind == "PROMO", links).when(kind == "LARGE", F.lit("<p>closed</p>")).otherwise(
        F.concat(block, F.replace(extra, F.lit("%"), F.col("p_name"))))
    parts = spread(table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"))
    return parts.select(
        F.col("p_partkey").alias("page_id"), F.lit("https://b.example").alias("base_url"), html.alias("html"))


ANCHOR_SQL = f"""{CLEAN_PAGES_SQL},
    anchors as (select page_id, unnest(regexp_extract_all(html, '(?s)<a href="[^"]*e[^"]*">(.*?)</a>', 1)) as a,
                       unnest(range(0, len(regexp_extract_all(html, '(?s)<a href="[^"]*e[^"]*">(.*?)</a>', 1)))) as i from clean_pages),
    titles as (select page_id, {text_sql('a')} as title_jp, min(i) as i from anchors group by all)"""


@query("anchor_fallback", f"""with {ANCHOR_SQL}
    select page_id, title_jp, (row_number() over (partition by page_id order by i) - 1)::integer as pos
    from titles where length(title_jp) >= 2""")
def anchor_fallback(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    return pages.select("page_id", F.posexplode(anchor_titles(F.col("html"), ("e",), 2)).alias("pos", "title_jp"))


@query("selector_profile", """
    select page_id, case when contains(url, 'blog') then 'blog' when contains(url, '/en/') then '/en/'
                         when contains(url, '.org') then '.org' else 'generic' end as profile from pages""")
def selector_profile_query(spark: SparkSession, sf: str) -> DataFrame:
    return selector_profile(table(spark, sf, "pages").select("page_id", "url"), ("blog", "/en/", ".org"), "url").select("page_id", "profile")


@query("generic_titles", f"""with {CLEAN_PAGES_SQL},
    li as (select page_id, 1 as sel, unnest(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1)) as t,
                  unnest(range(0, len(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1)))) as i from clean_pages),
    h1 as (select page_id, 2 as sel, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) as t, 0 as i from clean_pages),
    texts as (select page_id, sel, {text_sql('t')} as title_jp, i from (select * from li union all select * from h1)),
    accepted as (select page_id, sel, title_jp, min(i) as i from texts
                 where length(title_jp) >= 3 and (length(title_jp) >= 6 or regexp_matches(title_jp, '[぀-ヿ一-鿿]')) group by all),
    best as (select *, min(sel) over (partition by page_id) as first_sel from accepted),
    numbered as (select page_id, title_jp, row_number() over (partition by page_id order by i) - 1 as pos from best where sel = first_sel)
    select page_id, pos::integer as pos, title_jp from numbered where pos < 20""")
def generic_titles_query(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    titles = generic_titles(F.col("html"), ("h2.title", ".movie-title", "li", "h1"))
    return pages.select("page_id", F.posexplode(titles).alias("pos", "title_jp"))


@query("theater_coverage", """
    select s_suppkey, s_name, count(distinct p_name) as films
    from supplier left join (select l_suppkey, p_name from lineitem join part on l_partkey = p_partkey) on l_suppkey = s_suppkey and s_nationkey <> 3
    group by s_suppkey, s_name""")
def theater_coverage_query(spark: SparkSession, sf: str) -> DataFrame:
    """All showings; the pages of one nation's theatres count as not captured."""
    theaters = table(spark, sf, "supplier")
    # Distinct on every task first: a theatre and film meet once, however often it is shown there.
    shown = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct().join(
        theaters.filter("s_nationkey <> 3").select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey")
    found = (shown.join(
        table(spark, sf, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
        .select(F.col("l_suppkey").alias("s_suppkey"), "p_name"))
    return theater_coverage(theaters.select("s_suppkey", "s_name"), found, "s_suppkey", "p_name")


@query("union_sources", f"""with {ORDER_SHOWS_SQL}, {CLEAN_PAGES_SQL},
    a as (select distinct page_id, pos, title_jp from shows), {PART_PAGES_SQL}
    select 0 as chain, 'T' as theater, count(*) as films, (select count(*) from shows) as slots from a
    union all select 1, 'P', count(*), sum(screening_count)::bigint from part_films
    union all select 2, 'I', count(*), 0 from clean_pages where length({text_sql("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")}) >= 2""")
def union_sources_query(spark: SparkSession, sf: str) -> DataFrame:
    """The films of three chains' pages in one table, counted by chain."""
    a = extract_chain_a(order_pages(spark, sf).select("page_id", "base_url", "html"), AS_OF)
    b = extract_chain_b(part_pages(spark, sf), AS_OF)
    own = extract_independent(_plain_pages(spark, sf), AS_OF, profiles={}, generic=OWN_PROFILE)
    named = [page_movies(films, ["page_id"]).select("page_id", "pos", F.lit(i).alias("chain"), F.lit(t).alias("theater"), "screening_count")
             for i, (films, t) in enumerate(((a, "T"), (b, "P"), (own, "I")))]
    return union_sources(*named).groupBy("chain", "theater").agg(
        F.count("*").alias("films"), F.sum("screening_count").alias("slots"))


# A page per customer in the markup that one of the six profiles, or the generic one, looks for.
PROFILE_PAGES = (
    ("uplink", "<div class='a event-item'>", "<h3>", "</h3>", "<i class=showtime>", "</i>", "</div>"),
    ("imageforum", "<div class=nowShowing>", "<p class='movie-title'>", "</p>", "<b class='time'>", "</b>", "</div>"),
    ("cinemavera", "<div class=program>", "<h2>", "</h2>", "<span class=time>", "</span>", "</div>"),
    ("pole2", "<article>", "<h2>", "</h2>", "<span class='x showtime'>", "</span>", "</article>"),
    ("ks-cinema", "<table><tr>", "<td>", "</td>", "<td>", "</td>", "</tr></table>"),
    ("wasedashochiku", "<div class='program-item'>", "<h2>", "</h2>", "<span class=time>", "</span>", "</div>"),
    ("other", "<article>", "<h2>", "</h2>", "<span class=time>", "</span>", "</article>"),
)


@query("independent_theaters", """
    with p as (select *, c_custkey % 7 as kind from customer)
    select c_custkey as page_id, 0 as pos, c_name as title_jp,
           case c_custkey % 3 when 0 then concat('https://cdn.example/', c_custkey, '.png')
                when 1 then concat('https://', site, '.example/now/img/', c_custkey, '.png') else '' end as poster_url,
           false as is_new_release, (case when c_custkey % 5 = 0 then 1 else 2 end)::bigint as screening_count
    from p join (values (0, 'uplink'), (1, 'imageforum'), (2, 'cinemavera'), (3, 'pole2'), (4, 'ks-cinema'), (5, 'wasedashochiku'), (6, 'other')) s(k, site)
    on kind = k where c_nationkey <> 4
    union all
    select c_custkey, 0, concat('上映', c_custkey), '', false, 0 from customer where c_nationkey = 4""")
def independent_theaters_query(spark: SparkSession, sf: str) -> DataFrame:
    """Independent theatres by their real profiles, with times and posters; some pages have headings only."""
    key = F.col("c_custkey").cast("string")
    poster = (F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("<img src='https://cdn.example/"), key, F.lit(".png'>")))
              .when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("<img alt=x src=img/"), key, F.lit(".png>"))).otherwise(""))
    site, html = F.lit(None), F.lit(None)
    for i, (name, block, title, title_end, time, time_end, end) in enumerate(PROFILE_PAGES):
        chosen = F.col("c_custkey") % len(PROFILE_PAGES) == i
        second = F.when(F.col("c_custkey") % 5 == 0, F.lit("sold out")).otherwise(F.lit("19:05～"))
        page = F.concat(F.lit(f"<body>{block}{title} "), F.col("c_name"), F.lit(f"{title_end}<p>"), poster, F.lit(f"{time}開映 9:30{time_end}{time}"),
                        second, F.lit(f"{time_end}{end}</body>"))
        if name == "ks-cinema":
            page = F.concat(F.lit(f"<body>{block}{title} "), F.col("c_name"), poster, F.lit(f"{title_end}{time}開映 9:30{time_end}{time}"), second, F.lit(f"{time_end}{end}</body>"))
        site, html = F.when(chosen, F.lit(name)).otherwise(site), F.when(chosen, page).otherwise(html)
    bare = F.concat(F.lit("<div><h2 class=title>上映"), key, F.lit("</h2><h3 class=title>no</h3></div>"))
    customers = spread(table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey"))
    pages = customers.select(
        F.col("c_custkey").alias("page_id"), F.concat(F.lit("https://"), site, F.lit(".example/now/")).alias("base_url"),
        F.when(F.col("c_nationkey") == 4, bare).otherwise(html).alias("html"))
    return page_movies(extract_independent(pages, AS_OF), ["page_id"])

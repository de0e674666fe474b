"""Extraction of films and showings from captured pages, by rules that are rows of a table.

A rule says how the pages of a source, or of addresses with a keyword, are read: selectors of blocks, titles and times, and
what to look for on pages without films. Each address is matched with its rule once (``match_rules``); a page is then parsed
inside its row and read by the rule that came with it (functions/html.py), in one walk. The plan holds
one reading of a page, however many rules there are; what it gives are short texts, and dates, times, flags and fallbacks are
expressions over them. The HTML is never shuffled, and the fallbacks look at
the same row's result instead of an anti join. The only shuffle merges equal titles of a page, on short rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions import fixed_values as fv
from marquee.functions.dates import as_date, date_wanted, is_recent, parse_month_day
from marquee.functions.html import TEXT, absolute_link, let, read_page, select_all, select_fields, select_first
from marquee.functions.text import clean_text, is_placeholder, parse_time_lenient, parse_time_strict
from marquee.operators.stages import stage

#: What a page rule holds. ``row`` is NULL where times stand alone; ``new`` is 'recent', 'always' or 'never'.
RULE = ("source string, keyword string, ord int, block string, title string, row string, time string, strict boolean, join_links boolean, "
        "min_title int, needs_showings boolean, new string, fallback array<string>, fallback_min int, fallback_plain int, fallback_cap int")
RULE_FIELDS = [f.split()[0] for f in RULE.split(", ")]
SHOWINGS = "array<struct<show_date:date,start_time:string>>"


# ---- parts usable on their own

def explode_blocks(pages: DataFrame, wanted: str, html: str = "html") -> DataFrame:
    """One row per matching element of a page, as HTML, with its position on the page; html is dropped."""
    keep = [c for c in pages.columns if c != html]
    return pages.select(*keep, F.posexplode(select_all(F.col(html), wanted)).alias("pos", "block"))


def block_title(block: Column, wanted: str) -> Column:
    """Cleaned text of the first title element in the block, '' if none."""
    return clean_text(select_first(block, wanted, TEXT))


def block_titles(blocks: DataFrame, wanted: str, min_length: int = 1) -> DataFrame:
    """Adds title_jp; blocks with no title, or a shorter one, are dropped."""
    return (blocks.withColumn("title_jp", block_title(F.col("block"), wanted))
            .filter(F.length("title_jp") >= min_length))


def row_cells(html: Column, block: str, row: str) -> Column:
    """Per block of a page, the cells' texts of each table row with at least two of them: array<array<array<string>>>."""
    rule = {"block": F.lit(block), "title": F.lit("h1"), "row": F.lit(row), "time": F.lit(None).cast("string"),
            "fallback": F.expr("cast(array() as array<string>)")}
    return F.transform(read_page(html, rule)["blocks"], lambda b: b["cells"])


def table_showings(cells: Column, as_of, dates=None) -> Column:
    """Showings of a table's rows: first cell is the date, every further cell one time."""

    def of_row(row: Column) -> Column:
        times = F.transform(F.slice(row, F.lit(2), F.size(row)), clean_text)
        shown = F.filter(times, lambda t: ~is_placeholder(t))
        return let(parse_month_day(F.get(row, F.lit(0)), as_of), lambda d: F.transform(shown, lambda t: F.struct(
            d.alias("show_date"), t.alias("start_time"))))

    showings = F.flatten(F.transform(cells, of_row))
    if not dates:
        return showings
    return F.filter(showings, lambda s: date_wanted(s["show_date"], dates))


def accepted_titles(texts: Column, min_length, plain_length) -> Column:
    """Distinct cleaned texts, in page order; those below ``plain_length`` need a kana or Han character."""
    return F.array_distinct(F.filter(F.transform(texts, clean_text), lambda t: (F.length(t) >= min_length) & (
        (F.length(t) >= plain_length) | t.rlike(fv.KANA_OR_HAN))))


def first_titles(found: Column, min_length, plain_length, cap) -> Column:
    """Of the texts under each selector, those of the first that gives any title, at most ``cap`` of them (NULL: all)."""
    def look(titles: Column, texts: Column) -> Column:
        return F.when(F.size(titles) > 0, titles).otherwise(accepted_titles(texts, min_length, plain_length))

    titles = F.aggregate(found, F.expr("cast(array() as array<string>)"), look)
    return let(titles, lambda f: F.slice(f, F.lit(1), F.coalesce(cap, F.size(f))))


def anchor_selector(parts: tuple[str, ...]) -> str:
    """Anchors whose link contains one of ``parts``."""
    return ", ".join(f"a[href*='{p}']" for p in parts)


def anchor_titles(html: Column, parts: tuple[str, ...], min_length: int = 1) -> Column:
    """Distinct texts of a page's anchors whose link contains one of ``parts``, in page order."""
    return accepted_titles(select_all(html, anchor_selector(parts), TEXT), min_length, min_length)


def generic_titles(html: Column, selectors=fv.GENERIC_TITLE_SELECTORS, cap: int = fv.GENERIC_TITLE_CAP,
                   min_length: int = 3, plain_length: int = 6) -> Column:
    """Titles of a page under the first selector that gives any; short ones need a kana or Han character."""
    found = let(select_fields(html, {f"s{i}": (s, TEXT) for i, s in enumerate(selectors)}), lambda f: F.array(*[f[f"s{i}"] for i in range(len(selectors))]))
    return first_titles(found, min_length, plain_length, F.lit(cap))


# ---- rules

def chain_a_rule() -> dict:
    """Film blocks of a chain A page: tables of dates and times."""
    row = ", ".join(f"{t.strip()} tr" for t in fv.CHAIN_A_TABLE.split(","))
    return dict(source=fv.CHAIN_A_SOURCE, keyword="", ord=0, block=fv.CHAIN_A_BLOCK, title=fv.CHAIN_A_TITLE, row=row, time="td", strict=False,
                join_links=False, min_title=1, needs_showings=True, new="recent", fallback=[anchor_selector(fv.CHAIN_A_ANCHORS)],
                fallback_min=1, fallback_plain=1, fallback_cap=None)


def chain_b_rule() -> dict:
    """Film blocks of a chain B page: times of the day of capture."""
    return dict(source=fv.CHAIN_B_SOURCE, keyword="", ord=0, block=fv.CHAIN_B_BLOCK, title=fv.CHAIN_B_TITLE, row=None, time=fv.CHAIN_B_TIME, strict=False,
                join_links=False, min_title=1, needs_showings=True, new="always", fallback=[anchor_selector(fv.CHAIN_B_ANCHORS)],
                fallback_min=2, fallback_plain=2, fallback_cap=None)


def independent_rules(profiles: dict | None = None, generic: dict | None = None) -> list[dict]:
    """Film blocks of independent theatres: a rule per keyword, in order, and one for every other address."""
    profiles = fv.SELECTOR_PROFILES if profiles is None else profiles
    every = [*profiles.items(), ("", fv.GENERIC_PROFILE if generic is None else generic)]
    return [dict(source=fv.INDEPENDENT_SOURCE, keyword=keyword, ord=i, block=p["block"], title=p["title"], row=None, time=p["time"], strict=True,
                 join_links=True, min_title=2, needs_showings=False, new="never", fallback=list(fv.GENERIC_TITLE_SELECTORS),
                 fallback_min=3, fallback_plain=6, fallback_cap=fv.GENERIC_TITLE_CAP) for i, (keyword, p) in enumerate(every)]


def rule_table(spark: SparkSession, rules: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r[f] for f in RULE_FIELDS) for r in rules], RULE)


def all_rules(spark: SparkSession, profiles: dict | None = None, generic: dict | None = None) -> DataFrame:
    return rule_table(spark, [chain_a_rule(), chain_b_rule(), *independent_rules(profiles, generic)])


#: Keywords meet addresses at grams of this many characters.
GRAM = 3


def first_keyword(addresses: DataFrame, keywords: DataFrame, on: list[str], address: str = "address") -> DataFrame:
    """The first keyword, by ``ord``, that each address contains, with the columns of its row as ``rule``; none: no row.

    ``keywords`` has the columns ``on``, ``keyword`` and ``ord``; '' is contained in every address. Addresses are cut into the grams
    at every place, and keywords begin with theirs, so the two meet in an equi-join; what a keyword says beyond its
    gram is compared there. Work per address does not grow with the number of keywords that begin otherwise.
    """
    lengths = F.array(*[F.lit(n) for n in range(1, GRAM + 1)])
    places = F.sequence(F.lit(1), F.greatest(F.length(address), F.lit(1)))
    at = addresses.select(*on, address, F.explode(places).alias("_at")).select(
        *on, address, "_at", F.explode(F.concat(F.when(F.col("_at") == 1, F.array(F.lit(0))).otherwise(F.expr("cast(array() as array<int>)")), lengths)).alias("_n"))
    grams = at.filter(F.col("_at") + F.col("_n") - 1 <= F.length(address)).select(
        *on, address, "_at", F.substr(address, F.col("_at"), F.col("_n")).alias("_gram"))
    known = keywords.select(*on, F.left("keyword", F.lit(GRAM)).alias("_gram"), F.struct("ord", *[c for c in keywords.columns if c not in ("ord", *on)]).alias("rule"))
    hits = grams.join(known, [*on, "_gram"]).filter(F.substr(address, F.col("_at"), F.length("rule.keyword")) == F.col("rule.keyword"))
    return hits.groupBy(*on, address).agg(F.min_by("rule", "rule.ord").alias("rule"))


def selector_profile(pages: DataFrame, keywords: DataFrame | tuple = tuple(fv.SELECTOR_PROFILES), address: str = "base_url") -> DataFrame:
    """Adds ``profile``: the first keyword, in order, contained in the address; 'generic' if none.

    ``keywords``: a tuple, or a table (keyword, ord) of any size.
    """
    if not isinstance(keywords, DataFrame):
        keywords = pages.sparkSession.createDataFrame([(k, i) for i, k in enumerate(keywords)], "keyword string, ord int")
    distinct = pages.select(F.coalesce(address, F.lit("")).alias("_address")).distinct()
    found = first_keyword(distinct, keywords, [], "_address").select("_address", F.col("rule.keyword").alias("_profile"))
    named = pages.withColumn("_address", F.coalesce(address, F.lit(""))).join(found, "_address", "left")
    return named.select(*pages.columns, F.coalesce("_profile", F.lit("generic")).alias("profile"))


def match_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``_rule``, the first rule of the page's source whose keyword its base_url contains; pages without one go.

    Rules are matched on the distinct addresses, which are read without the HTML. The matches are written and read back, so that Spark
    knows their size before it plans the join: it broadcasts a small table and leaves the pages, however few addresses they share, in their splits.
    """
    keyed = pages.withColumn("_address", F.coalesce("base_url", F.lit("")))
    found = first_keyword(keyed.select("source", "_address").distinct(), rules, ["source"], "_address")
    known = stage(found.select("source", "_address", F.col("rule").alias("_rule")), "page_rules")
    return keyed.join(known, ["source", "_address"]).drop("_address")


def filter_dates(showings: DataFrame, dates) -> DataFrame:
    """Drop showings whose known date is not in ``dates``: a list, or a DataFrame with show_date."""
    if isinstance(dates, DataFrame):
        wanted = dates.select("show_date").distinct().withColumn("_wanted", F.lit(True))
        return (showings.join(wanted, "show_date", "left").filter("_wanted or show_date is null")
                .select(*showings.columns))
    return showings.filter(date_wanted(F.col("show_date"), dates))


def drop_placeholders(showings: DataFrame, column: str = "start_time") -> DataFrame:
    return showings.filter(~is_placeholder(F.col(column)))


# ---- whole pages

def _block_films(blocks: Column, rule: Column, as_of, dates) -> Column:
    """Title, image and showings of the film blocks that count as films."""
    def time_showings(times: Column) -> Column:
        parsed = F.transform(times, lambda t: F.when(rule["strict"], parse_time_strict(clean_text(t))).otherwise(parse_time_lenient(t)))
        return F.transform(F.filter(parsed, lambda t: t != ""), lambda t: F.struct(as_date(as_of).alias("show_date"), t.alias("start_time")))

    def film(b: Column) -> Column:
        return F.struct(
            clean_text(b["title_jp"]).alias("title_jp"), b["src"].alias("src"),
            F.when(rule["row"].isNotNull(), table_showings(b["cells"], as_of, dates)).otherwise(time_showings(b["times"])).alias("showings"))

    def wanted(f: Column) -> Column:
        return (F.length(f["title_jp"]) >= rule["min_title"]) & (~rule["needs_showings"] | (F.size(f["showings"]) > 0))

    return F.filter(F.transform(blocks, film), wanted)


def extract_pages(pages: DataFrame, as_of, dates=None) -> DataFrame:
    """Film rows of pages that carry their rule (``_rule``, see ``match_rules``); html and rule are dropped.

    Only html and rule reach the worker that reads the page. What depends on a film's first showing and
    address is worked out on the film rows.
    """
    kept = [c for c in pages.columns if c not in ("html", "_rule")]
    rule = F.col("_rule")
    read = pages.select(*kept, "_rule", read_page(F.col("html"), rule).alias("_page"))
    films = read.select(*kept, "_rule", "_page.bare", _block_films(F.col("_page.blocks"), rule, as_of, dates).alias("_films"))
    bare = F.transform(
        first_titles(F.col("bare"), rule["fallback_min"], rule["fallback_plain"], rule["fallback_cap"]),
        lambda t: F.struct(t.alias("title_jp"), F.lit(None).cast("string").alias("src"), F.lit(None).cast(SHOWINGS).alias("showings")))
    found = films.select(*kept, "_rule", F.when(F.size("_films") > 0, F.col("_films")).otherwise(bare).alias("_films"))
    # outer, so that Spark does not infer (and compute) a size filter on the parsed array
    rows = found.select(*kept, F.struct("_rule.new", "_rule.join_links").alias("_rule"), F.posexplode_outer("_films").alias("pos", "film"))
    first_day = F.try_element_at("film.showings", F.lit(1))["show_date"]
    is_new = F.when(F.col("film.showings").isNull(), False).when(F.col("_rule.new") == "recent", is_recent(first_day, as_of)).otherwise(F.col("_rule.new") == "always")
    poster = F.when(F.col("film.src").isNull(), "").otherwise(absolute_link(F.col("film.src"), F.col("base_url"), F.col("_rule.join_links")))
    return rows.filter(F.col("film").isNotNull()).select(
        *kept, "pos", "film.title_jp", poster.alias("poster_url"), "film.showings", is_new.alias("is_new_release"))


def _by_one_rule(pages: DataFrame, rule: dict) -> DataFrame:
    literal = F.struct(*[F.lit(rule[f]).cast(kind).alias(f) if not isinstance(rule[f], list) else F.array(*map(F.lit, rule[f])).alias(f)
                         for f, kind in (x.split() for x in RULE.split(", "))])
    return pages.withColumn("_rule", literal)


def extract_chain_a(pages: DataFrame, as_of, dates=None) -> DataFrame:
    return extract_pages(_by_one_rule(pages, chain_a_rule()), as_of, dates)


def extract_chain_b(pages: DataFrame, as_of) -> DataFrame:
    """Titles that come from plain links are not marked as new."""
    return extract_pages(_by_one_rule(pages, chain_b_rule()), as_of)


def extract_independent(pages: DataFrame, as_of, profiles: dict | None = None,
                        generic: dict | None = None) -> DataFrame:
    rules = independent_rules(profiles, generic)
    if len(rules) == 1:
        return extract_pages(_by_one_rule(pages, rules[0]), as_of)
    kept = pages.columns
    sourced = pages.drop("source").withColumn("source", F.lit(fv.INDEPENDENT_SOURCE))
    found = extract_pages(match_rules(sourced, rule_table(pages.sparkSession, rules)), as_of)
    return found if "source" in kept else found.drop("source")


def page_movies(page_films: DataFrame, keys: list[str]) -> DataFrame:
    """One film per page and title; fields of its first block, showings of all counted."""
    first = F.struct("poster_url", "is_new_release")
    return (page_films.groupBy(*keys, "title_jp")
            .agg(F.min("pos").alias("pos"), F.min_by(first, "pos").alias("f"),
                 F.sum(F.greatest(F.size("showings"), F.lit(0))).alias("screening_count"))
            .select(*keys, "pos", "title_jp", "f.*", "screening_count"))


def page_screenings(page_films: DataFrame) -> DataFrame:
    """The showings of extracted films as a flat table."""
    kept = [c for c in ("issue_number", "sched_ord", "theater_name", "pos", "title_jp") if c in page_films.columns]
    rows = page_films.select(*kept, F.posexplode_outer("showings").alias("slot", "s"))
    return rows.filter(F.col("s").isNotNull()).select(*kept, "slot", "s.*")


def theater_coverage(theaters: DataFrame, films: DataFrame, key: str = "sched_ord",
                     title: str = "title_jp") -> DataFrame:
    """Distinct titles found per theatre, 0 where the page failed or was empty."""
    # distinct first: a theatre with very many rows is reduced on every task before it is counted
    counts = films.select(key, title).distinct().groupBy(key).agg(F.count("*").alias("films"))
    return theaters.join(counts, key, "left").withColumn("films", F.coalesce("films", F.lit(0)))


def union_sources(*sources: DataFrame) -> DataFrame:
    """Append the sources' films; sched_ord carries the order of the sources."""
    out = sources[0]
    for other in sources[1:]:
        out = out.unionByName(other)
    return out

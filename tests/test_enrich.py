import random

from pyspark.sql import functions as F

from marquee.operators import enrich as E
from marquee.sources.candidates import scan_candidates
from marquee.sources.pages import scan_pages, scan_subjects

CANDIDATE = "query string, pos int, id string, type string, year string, has_rating boolean, rating string"
FILM = ("title_key string, title_jp string, title_cn string, director string, cast string, genre string, year int, duration int, "
        "score double, votes bigint, url string, reviews array<string>")
PAGE = ('<h1><span property="v:itemreviewed">利益区域 関心領域</span><span class="year">(2023)</span></h1>'
        '<strong class="ll rating_num">8.3</strong><span property="v:votes">180,000</span><a rel="v:directedBy">D1</a><a rel="v:directedBy">D2</a>'
        + "".join(f'<a rel="v:starring">{i}</a>' for i in range(6)) +
        '<span property="v:genre">G</span><span property="v:runtime" content="105">105分钟</span>'
        + "".join(f'<div class="comment-item"><span class="short"> r{i} </span></div>' for i in range(3))
        + '<div class="comment-item"><span class="short"> </span></div>'
        + "".join(f'<div class="comment-item"><span class="short">s{i}</span></div>' for i in range(4)))


def film(spark, *rows):
    return spark.createDataFrame(rows, FILM)


def test_suggestions(spark):
    payloads = ['[{"id":"1","type":"movie","year":"2023","rating":{"value":"8.0"}},{"id":"2"}]', "<html>", "[]", '{"id":"3"}',
                '[{"rating":null,"year":1999}]']
    df = spark.createDataFrame([(str(i), p) for i, p in enumerate(payloads)], "q string, p string")
    rows = scan_candidates(df, F.col("q"), F.col("p")).orderBy("query", "pos").collect()
    assert [tuple(r) for r in rows if r.query != "3"] == [
        ("0", 0, "1", "movie", "2023", True, "8.0"), ("0", 1, "2", "", "", False, None), ("4", 0, "", "", "1999", False, None)]


def test_quick_rating(values):
    assert values(E.quick_rating, ["8.0", "", None, "n/a", "7"]) == [8.0, 0.0, 0.0, None, 7.0]


def test_subject_page_fields(spark):
    pages = spark.createDataFrame([
        (2, "https://r/subject/1/", "<p>later capture</p>"), (1, "https://r/subject/1/", PAGE), (3, "https://r/subject/7/", "<h1><span> 标题 x</span></h1>"),
        (4, "https://r/other/9/", PAGE)], "page_id long, url string, html string")
    got = {r.id: r for r in scan_subjects(pages).collect()}
    assert set(got) == {"1", "7"}
    one = got["1"]
    assert (one.title_cn, one.director, one["cast"], one.genre, one.year, one.duration, one.score, one.votes) == (
        "利益区域", "D1 / D2", "0 / 1 / 2 / 3 / 4", "G", 2023, 105, 8.3, 180000)
    assert one.reviews == ["r0", "r1", "r2", "s0", "s1"]
    assert (got["7"].title_cn, got["7"].director, got["7"].year, got["7"].score, got["7"].votes, got["7"].reviews) == ("标题", "", 0, 0.0, 0, [])
    assert {r.id: r for r in scan_subjects(pages, reviews=7).collect()}["1"].reviews == ["r0", "r1", "r2", "s0", "s1", "s2", "s3"]
    wanted = spark.createDataFrame([("7",), ("7",)], "id string")
    assert [r.id for r in scan_subjects(pages, wanted).collect()] == ["7"]


def brute_force_match(title, year, candidates):
    """Straight reading of the rules over a list, for comparison."""
    results = [c for c in candidates if c[0] == (f"{title} {year}" if year else title)] or [c for c in candidates if c[0] == title]
    movies = [c for c in results if c[3] == "movie"] or results
    right = [c for c in movies if str(year) in c[4]] if year else []
    return (right or movies or [None])[0]


def test_best_match_against_brute_force(spark):
    rng = random.Random(7)
    films = [(f"k{i}", f"t{i % 6}", rng.choice([0, 0, 1999, 2023])) for i in range(60)]
    candidates, pos = [], 0
    for _ in range(300):
        title = f"t{rng.choice([0, 0, 0, 1, 2, 3, 4])}" + rng.choice(["", "", " 1999", " 2023"])  # t0 is hot, t5 has none
        candidates.append((title, pos, str(pos), rng.choice(["movie", "tv", ""]), rng.choice(["", "1999", "2023", "1998-1999"]), True, "5"))
        pos += 1
    got = {r.title_key: r.id for r in E.best_match(
        spark.createDataFrame(films, "title_key string, title_jp string, year int"),
        spark.createDataFrame(candidates, CANDIDATE).repartition(3), "title_key").collect()}
    expected = {k: m[2] for k, t, y in films if (m := brute_force_match(t, y, candidates))}
    assert got == expected and len(got) < len(films)


def test_only_a_missing_film_year_is_free(spark):
    hits = spark.createDataFrame([("a", 0, "movie", None, 2000), ("a", 1, "movie", "2000", 2000), ("b", 0, "movie", None, None), ("b", 1, "movie", "1", None)],
                                 "k string, pos int, type string, year string, film_year int")
    assert sorted((r.k, r.pos) for r in E.pick_best(hits, ["k"], [], F.col("film_year")).collect()) == [("a", 1), ("b", 0)]


def test_two_stage_lookup_returns_only_the_first_attempt_with_rows(spark):
    films = spark.createDataFrame([("a", "x", 2000), ("b", "x", 0), ("c", "y", 2000)], "title_key string, title_jp string, year int")
    c = spark.createDataFrame([("x 2000", 0, "1", "tv", "", True, ""), ("x", 0, "2", "tv", "", True, ""), ("y", 0, "3", "", "", True, "")], CANDIDATE)
    assert sorted((r.title_key, r.attempt, r.id) for r in E.two_stage_lookup(films, c, "title_key").collect()) == [
        ("a", 0, "1"), ("b", 0, "2"), ("c", 1, "3")]


def test_overlay_rules(spark):
    old = ("old", "olddir", "oldcast", "oldgenre", 1990, 90, 5.0, 7, "oldurl", ["oldreview"])
    films = film(spark, *[(k, k, *old) for k in ("nomatch", "emptyid", "nopage", "full", "bare", "badrating")])
    matches = spark.createDataFrame([
        ("emptyid", "", True, "9"), ("nopage", "1", True, "6.5"), ("full", "2", True, "6.5"), ("bare", "3", True, None), ("badrating", "9", True, "n/a")],
        "title_key string, id string, has_rating boolean, rating string")
    subjects = spark.createDataFrame([
        ("2", "新", "", "c", "g", 2001, 100, 8.0, 9, ["r"]), ("3", None, "d", "", "", 0, 0, 0.0, 0, [])],
        "id string, title_cn string, director string, cast string, genre string, year int, duration int, score double, votes bigint, reviews array<string>")
    got = {r.title_key: r for r in E.enrich(films, matches, subjects, "title_key").collect()}

    def fields(key):
        r = got[key]
        return (r.title_cn, r.director, r["cast"], r.genre, r.year, r.duration, r.score, r.votes, r.url, r.reviews)

    assert fields("nomatch") == fields("emptyid") == old
    url = "https://movie.douban.com/subject/{}/"
    assert fields("nopage") == ("old", "olddir", "oldcast", "oldgenre", 1990, 90, 6.5, 7, url.format(1), ["oldreview"])
    assert fields("full") == ("新", "", "c", "g", 2001, 100, 8.0, 9, url.format(2), ["r"])
    assert fields("bare") == ("old", "d", "", "", 1990, 90, 0.0, 0, url.format(3), [])
    assert fields("badrating")[6] == 5.0 and got["badrating"].rating_id == "9"
    assert [got[k].rating_id for k in ("nomatch", "emptyid", "nopage")] == ["", "", "1"]


def test_enrich_all_can_be_skipped(spark):
    films = film(spark, ("k", "t", "", "", "", "", 0, 0, 0.0, 0, "", []))
    assert E.enrich_all(films, None, None, skip=True) is films


def test_first_reviews_per_key(spark):
    df = spark.createDataFrame([("a", 3, " z "), ("a", 1, "　"), ("a", 2, "y"), ("a", 4, "w"), ("b", 1, "")], "k string, t int, text string")
    got = E.first_reviews(df, ["k"], "t", "text", 2).orderBy("n").collect()
    assert [(r.k, r.n, r.text) for r in got] == [("a", 1, "y"), ("a", 2, "z")]


def test_scan_pages_keeps_theatres_without_page(spark):
    theaters = spark.createDataFrame([("u1", "A"), ("u2", "B"), ("u1", "C")], "schedule_url string, theater_name string")
    pages = spark.createDataFrame([(1, "u1", "<p>"), (2, "u3", "<p>")], "page_id long, url string, html string")
    got = scan_pages(theaters, pages).orderBy("theater_name").collect()
    assert [(r.theater_name, r.page_id) for r in got] == [("A", 1), ("B", None), ("C", 1)]


def test_scan_pages_never_shuffles_html(spark):
    theaters = spark.range(50).selectExpr("concat('https://t/', id) as schedule_url", "concat('T', id) as theater_name")
    plan = scan_pages(theaters, spark.read.parquet("/root/testdata/sf0.01/pages.parquet").selectExpr("page_id", "url", "html"))._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    scans = [x for x in plan.split("\n\n") if "ReadSchema" in x]
    assert sum("html" in x for x in scans) == 1
    shuffled = [x for x in plan.split("\n\n") if x.split(") ", 1)[-1].startswith("Exchange")]
    assert not any("html" in x for x in shuffled)

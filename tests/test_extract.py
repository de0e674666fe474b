import datetime as dt
import re

from pyspark.sql import functions as F

from marquee.operators import extract as X

AS_OF = "2026-04-13"
SCHEMA = "sched_ord int, theater_name string, base_url string, html string"


def pages(spark, *htmls, base="https://a.jp"):
    return spark.createDataFrame([(i, f"T{i}", base, h) for i, h in enumerate(htmls)], SCHEMA)


def films(df):
    rows = df.orderBy("sched_ord", "pos").collect()
    return [(r.sched_ord, r.title_jp, r.poster_url, r.is_new_release,
             [(str(s.show_date) if s.show_date else None, s.start_time) for s in r.showings or []]) for r in rows]


CHAIN_A = ('<div class="schedule-movie-detail"><h3>映画A</h3><img src="/p.jpg"><table class="schedule-table">'
           '<tr><th>日</th></tr><tr><td>4/1(水)</td><td>10:00</td><td>―</td><td>×</td></tr><tr><td>4/13</td><td> 満席　</td></tr></table></div>'
           '<div class="m-schedule-movie-detail"><h4>映画B</h4><table class="m-schedule-table"><tr><td>4/14</td><td>-</td></tr></table></div>'
           '<div class="m-schedule-movie-detail"><h4> </h4><table class="m-schedule-table"><tr><td>4/14</td><td>9:00</td></tr></table></div>'
           '<div class="schedule-movie-detail"><h3>映画C</h3><table class="schedule-table"><tr><td>?</td><td>9:00</td></tr></table></div>')


def test_chain_a(spark):
    got = films(X.extract_chain_a(pages(spark, CHAIN_A), AS_OF))
    assert got == [
        (0, "映画A", "https://a.jp/p.jpg", False, [("2026-04-01", "10:00"), ("2026-04-13", "満席")]),
        (0, "映画C", "", None, [(None, "9:00")])]


def test_dates_split_over_tags_are_read(spark):
    page = CHAIN_A.replace("4/1(水)", "<span>4</span> / <span> 1 </span>(水)")
    assert films(X.extract_chain_a(pages(spark, page), AS_OF))[0][4][0] == ("2026-04-01", "10:00")


def test_one_pass_over_all_chains(spark):
    from marquee.plans.weekly import extract_all

    b = '<div class="programBox"><h2>映画B</h2><time>13:20</time></div>'
    own = "<table><tr><td>映画K</td><td>10:30</td></tr></table><tr><td>outside</td><td>9:00</td></tr>"
    rows = [("TOHO", 0, "a", "https://a.jp", CHAIN_A), ("United", 1, "b", "https://b.jp", b), ("独立影院", 2, "c", "https://www.ks-cinema.com", own)]
    df = extract_all(spark.createDataFrame(rows, "source string, sched_ord long, theater_name string, base_url string, html string"), AS_OF)
    assert [(t, len(s)) for _, t, _, _, s in films(df)] == [("映画A", 2), ("映画C", 1), ("映画B", 1), ("映画K", 1)]


def test_html_is_read_once_and_not_shuffled(spark, tmp_path):
    """Rules are matched on addresses read without the HTML; the plan is the same for many rules."""
    from marquee.plans.weekly import extract_all

    rows = [("TOHO", i, "a", "https://a.jp", CHAIN_A) for i in range(20)]
    path = str(tmp_path / "pages")
    spark.createDataFrame(rows, "source string, sched_ord long, theater_name string, base_url string, html string").write.parquet(path)
    few = extract_all(spark.read.parquet(path), AS_OF)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert len([line for line in plan.splitlines() if "FileScan" in line and re.search(r"ReadSchema: .*html:", line)]) == 1
    assert not any("html" in line for line in plan.splitlines() if "Exchange" in line)
    known = {f"site{i}.example": {"block": f".b{i}", "title": f"h{i % 6 + 1}", "time": f".t{i}"} for i in range(1000)}
    many = extract_all(spark.read.parquet(path), AS_OF, profiles=known)
    sizes = [len(df._jdf.queryExecution().analyzed().toString()) for df in (few, many)]
    assert sizes[0] < 200_000 and abs(sizes[0] - sizes[1]) < 100


def test_a_thousand_profiles(spark):
    known = {f"site{i}.example": {"block": f".b{i}", "title": "h2", "time": ".t"} for i in range(1000)}
    html = "".join(f"<div class=b{i}><h2>映画{i}</h2></div>" for i in (7, 70, 700))
    df = spark.createDataFrame([(i, f"T{i}", f"https://www.site{i}.example/x", html) for i in (7, 70, 700, 8)], SCHEMA)
    got = films(X.extract_independent(df, AS_OF, profiles=known))
    assert [(i, t) for i, t, *_ in got] == [(7, "映画7"), (8, "映画7"), (8, "映画70"), (8, "映画700"), (70, "映画70"), (700, "映画700")]


def test_chain_a_date_list_keeps_unknown_dates(spark):
    got = films(X.extract_chain_a(pages(spark, CHAIN_A), AS_OF, ["2026-04-13"]))
    assert [(t, s) for _, t, _, _, s in got] == [("映画A", [("2026-04-13", "満席")]), ("映画C", [(None, "9:00")])]
    assert got[0][3] is True


def test_chain_a_falls_back_to_links_only_without_films(spark):
    links = '<a href="/net/movie/1">L1</a><a href="/net/movie/2"> </a><a href="/net/movie/3">L1</a><a href="/x">no</a>'
    got = films(X.extract_chain_a(pages(spark, CHAIN_A + links, links, None, ""), AS_OF))
    assert [(p, t) for p, t, *_ in got] == [(0, "映画A"), (0, "映画C"), (1, "L1")]
    assert got[2] == (1, "L1", "", False, [])


def test_chain_b(spark):
    html = ('<div class="programBox"><h2>映画A</h2><span class="showtime">13:20～</span><time> </time><span class="time"> 満席 </span></div>'
            '<article class="movie"><h3>空</h3></article>')
    links = '<a href="/film/1">F</a><a href="/film/2">FF</a><a href="/movie/2">MM</a>'
    got = films(X.extract_chain_b(pages(spark, html, links), AS_OF))
    assert got == [(0, "映画A", "", True, [(AS_OF, "13:20"), (AS_OF, "満席")]), (1, "FF", "", False, []), (1, "MM", "", False, [])]


def test_independent_keeps_films_without_showings(spark):
    html = ('<article class="movie"><h2>映画Z</h2><img src="q.png"><span class="time">19:00</span><span class="time">x</span></article>'
            '<article class="movie"><h2>映画Z</h2><span class="showtime">21:00</span></article>'
            '<article class="movie"><h2>無し</h2></article><article class="movie"><h2>短</h2></article>')
    page_films = X.extract_independent(pages(spark, html, base="https://jk.uplink.co.jp/s/"), AS_OF)
    merged = X.page_movies(page_films, ["sched_ord"]).orderBy("pos").collect()
    assert [(r.title_jp, r.poster_url, r.is_new_release, r.screening_count) for r in merged] == [
        ("映画Z", "https://jk.uplink.co.jp/s/q.png", False, 2), ("無し", "", False, 0)]
    shown = X.page_screenings(page_films).orderBy("pos", "slot").collect()
    assert [(r.title_jp, r.start_time) for r in shown] == [("映画Z", "19:00"), ("映画Z", "21:00")]


def test_profiles(spark):
    urls = ["https://www.ks-cinema.com", "https://x.jp", "https://imageforum.uplink.jp", "", None, "up", "uplink"]
    df = spark.createDataFrame(list(enumerate(urls)), "i int, base_url string")
    assert [r.profile for r in X.selector_profile(df).orderBy("i").collect()] == ["ks-cinema", "generic", "uplink", "generic", "generic", "generic", "uplink"]
    short = spark.createDataFrame([("k", 2), ("ks", 1), ("jp", 0), ("x.jp", 3)], "keyword string, ord int")
    assert [r.profile for r in X.selector_profile(df, short).orderBy("i").collect()] == ["ks", "jp", "jp", "generic", "generic", "generic", "k"]
    table = "<table><tr><td>映画K</td><td>10:30</td></tr><tr><td>映画L</td><td>n/a</td></tr></table>"
    got = films(X.extract_independent(pages(spark, table, base="https://www.ks-cinema.com"), AS_OF))
    assert [(t, s) for _, t, _, _, s in got] == [("映画K", [(AS_OF, "10:30")]), ("映画L", [])]


def test_generic_titles(values):
    many = "".join(f"<h2>映画その{i}</h2>" for i in range(25))
    cases = [many, "<h2>abc</h2><h2>かなだ</h2><h2>abcdef</h2><h2>かなだ</h2>", "<h2>abc</h2><h3>映画です</h3>",
             "<h2>映画です</h2><h1 class='title'>第一候補</h1>", "<p>none</p>"]
    got = values(lambda c: X.generic_titles(c), cases)
    assert got == [[f"映画その{i}" for i in range(20)], ["かなだ", "abcdef"], ["映画です"], ["第一候補"], []]


def test_filter_dates_with_list_and_table(spark):
    d = dt.date(2026, 4, 13)
    shows = spark.createDataFrame([(1, d), (2, d + dt.timedelta(1)), (3, None)], "i int, show_date date")
    wanted = spark.createDataFrame([(d,), (d,)], "show_date date")
    assert sorted(r.i for r in X.filter_dates(shows, [d]).collect()) == [1, 3]
    assert sorted(r.i for r in X.filter_dates(shows, wanted).collect()) == [1, 3]
    assert X.filter_dates(shows, []).count() == 3


def test_coverage_counts_zero_for_missing_theatres(spark):
    theaters = spark.createDataFrame([(0, "A"), (1, "B")], "sched_ord int, theater_name string")
    found = spark.createDataFrame([(0, "x"), (0, "x"), (0, "y")], "sched_ord int, title_jp string")
    got = X.theater_coverage(theaters, found).orderBy("sched_ord").collect()
    assert [(r.theater_name, r.films) for r in got] == [("A", 2), ("B", 0)]


def test_blocks_titles_and_placeholders(spark):
    blocks = X.explode_blocks(pages(spark, "<article><h1>One</h1></article><article>no</article><article><h1>2</h1></article>"), "article")
    assert [(r.pos, r.title_jp) for r in X.block_titles(blocks, "h1").orderBy("pos").collect()] == [(0, "One"), (2, "2")]
    assert X.block_titles(blocks, "h1", 2).count() == 1
    times = spark.createDataFrame([("",), ("-",), ("10:00",)], "start_time string")
    assert [r.start_time for r in X.drop_placeholders(times).collect()] == ["10:00"]


def test_pages_with_control_characters_keep_their_films(spark):
    page = "<div class=programBox><h2>映画その一</h2><span class='showtime'>13:20</span></div>"
    got = films(X.extract_chain_b(pages(spark, page, page.replace("<h2>", "\x01<h2>")), AS_OF))
    assert len(got) == 2 and got[0][1:] == got[1][1:] and got[0][1] == "映画その一"

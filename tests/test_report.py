import datetime as dt

import demo
from pyspark.sql import functions as F

from marquee.functions import report_text as RT
from marquee.operators.merge import merge_titles
from marquee.operators.report import ReportOptions, film_columns, issue_document, issue_parts, named_parts
from marquee.plans.weekly import generate_reports, rate, scored_films, weekly_job
from marquee.sources.archive import next_issue, read_archive, scan_archive, write_issues
from marquee.sources.candidates import scan_candidates
from marquee.sources.export import EXPORT_COLUMNS, export_json, export_rows
from marquee.sources.pages import scan_pages, scan_subjects
from marquee.sources.theaters import theater_dim

OPTIONS = ReportOptions(title_template="第{issue_number}期 {week_start} ~ {week_end}", subtitle="副标题", footer="## end", top_n=2)


def test_stars(values):
    cases = {0.0: "暂无评分", 10.0: "★★★★★  10.0", 8.3: "★★★★　  8.3", 7.1: "★★★☆　  7.1", 5.0: "★★☆　　  5.0", 0.9: "　　　　　  0.9",
             12.0: "★★★★★★  12.0", 8.25: "★★★★　  8.2"}
    assert values(RT.stars, list(cases), "double") == list(cases.values())
    assert values(RT.stars, [None], "double") == ["暂无评分"]


def test_review_block(values):
    got = values(lambda c: RT.review_block(c, 2), [["a", "b", "c"], [], None], "array<string>")
    assert got == ["> 💬 a\n> 💬 b\n", "", ""]


def test_film_block_and_ranking_row_defaults(spark):
    df = spark.createDataFrame(
        [("原", "", 0.0, "", "", "", "", "", [], 70.5), ("原", "译", 8.3, "u", "D", "C", "G", "甲、乙", ["r"], 69.52)],
        "title_jp string, title_cn string, score double, url string, director string, cast string, genre string, theaters string, "
        "reviews array<string>, rec_score double")
    rows = df.select(RT.movie_block(film_columns(), 3).alias("b"), RT.ranking_row(F.lit("🥇"), film_columns()).alias("r")).collect()
    assert rows[0].b == ("### ◆. 原\n\n| 项目 | 内容 |\n|------|------|\n| 🎬 原题 | 原 |\n| 🌐 豆瓣 | [暂无评分](https://movie.douban.com) |\n"
                         "| 👤 导演 | — |\n| 🎭 主演 | — |\n| 🏷️ 类型 | — |\n| 📍 上映影院 | — |\n\n")
    assert rows[1].b.startswith("### ◆. 译（原）\n") and "[★★★★　  8.3](u)" in rows[1].b and rows[1].b.endswith("甲、乙 |\n\n> 💬 r\n")
    assert [r.r for r in rows] == ["| 🥇 | 原 | 70/100 | — | — |", "| 🥇 | 译 | 70/100 | 8.3 | 甲、乙 |"]


GOLDEN = """# 第1期 4月13日 ~ 4月19日
> 副标题

---

## 📅 本周上映（4月13日 ～ 4月19日）

{now}

---

## 🏆 本周推荐榜 Top 2

| 排名 | 电影 | 推荐指数 | 豆瓣评分 | 上映影院 |
|------|------|----------|----------|----------|
| 🥇 | 地铁花园-2 | 72/100 | 8.6 | 西館 |
| 🥈 | 灯塔看守的狗 | 70/100 | 9.0 | 北館 |

---

## 📌 下周预告（4月20日 ～ 4月26日）

{coming}

---

## end
"""


def block(jp, cn, stars, theaters, reviews):
    lines = "".join(f"> 💬 {r}\n" for r in reviews)
    return (f"### ◆. {cn}（{jp}）\n\n| 项目 | 内容 |\n|------|------|\n| 🎬 原题 | {jp} |\n| 🌐 豆瓣 | [{stars}](https://movie.douban.com) |\n"
            f"| 👤 导演 | D |\n| 🎭 主演 | — |\n| 🏷️ 类型 | G |\n| 📍 上映影院 | {theaters} |\n\n{lines}")


def test_golden_document(spark):
    films, shows, issues = demo.tables(spark)
    keep = F.col("title_jp").isin("地下鉄の庭-2", "灯台守の犬")
    later = spark.createDataFrame([(1, "灯台守の犬", "北館", dt.date(2026, 4, 26))], demo.SHOW_SCHEMA)
    # one showing is moved to the next week, so the counts and scores stay those of the demo
    moved = shows.filter(keep & ~((F.col("title_jp") == "灯台守の犬") & (F.col("show_date") > demo.DAY))).unionByName(later)
    documents, _ = generate_reports(films.filter(keep), moved, issues, OPTIONS)
    first = ("地下鉄の庭-2", "地铁花园-2", "★★★★　  8.6", "西館")
    second = ("灯台守の犬", "灯塔看守的狗", "★★★★☆  9.0", "北館")
    now = block(*first, ["m1", "m2"]) + "\n" + block(*second, ["k1", "k2"])
    assert documents.first().markdown == GOLDEN.format(now=now, coming=block(*second, ["k1"]))


EMPTY = """# 第{n}期 {a} ~ {b}
> 副标题

---

## 📅 本周上映（{a} ～ {b}）



---

## 🏆 本周推荐榜 Top 2

| 排名 | 电影 | 推荐指数 | 豆瓣评分 | 上映影院 |
|------|------|----------|----------|----------|


---

## end
"""


def test_issue_without_films_and_without_week(spark):
    films, shows, _ = demo.tables(spark, issue=2)
    issues = spark.createDataFrame([(1, dt.date(2026, 4, 14)), (2, dt.date(2020, 1, 1))], "issue_number int, week_start date")
    documents, _ = generate_reports(films, shows, issues, OPTIONS)
    got = {r.issue_number: r for r in documents.collect()}
    assert got[1].markdown == EMPTY.format(n=1, a="4月13日", b="4月19日")
    assert got[1].week_start == dt.date(2026, 4, 13)
    # films shown only outside both weeks are ranked but in no section
    assert "上映（12月30日 ～ 1月5日）\n\n\n\n---\n" in got[2].markdown and "| 🥇 | 地铁花园-2 |" in got[2].markdown
    assert "###" not in got[2].markdown and "下周预告" not in got[2].markdown


def test_next_week_can_be_left_out(spark):
    films, shows, issues = demo.tables(spark)
    scored = scored_films(films, shows.withColumn("show_date", F.date_add("show_date", 7)), issues)
    assert "下周预告" in issue_document(issues, scored, OPTIONS).first().markdown
    off = ReportOptions(include_next_week=False)
    assert "下周预告" not in issue_document(issues, scored, off).first().markdown


def test_undated_films_belong_to_this_week_of_their_own_issue_only(spark):
    films, shows, issues = demo.tables(spark)
    issues = issues.unionByName(issues.select(F.lit(2).alias("issue_number"), F.date_add("week_start", 7).alias("week_start")))
    scored = scored_films(films, shows.withColumn("show_date", F.lit(None).cast("date")), issues)
    parts = issue_parts(issues, scored, OPTIONS).filter("part_key.section = 2")
    assert [(r.issue_number, r["count"]) for r in parts.groupBy("issue_number").count().collect()] == [(1, 7)]


def test_export(spark, tmp_path):
    scored = scored_films(*demo.tables(spark))
    assert tuple(export_rows(scored).columns) == EXPORT_COLUMNS
    path = str(tmp_path / "films")
    export_json(scored, path)
    rows = spark.read.json(path)
    assert rows.filter("title_jp = '八月の硝子'").first().theaters == ["南館", "東館", "西館"]
    first_line = sorted(tmp_path.glob("films/part-*.json"))[0].read_text(encoding="utf-8").splitlines()[0]
    assert first_line.startswith('{"title_jp":"地下鉄の庭-2","title_cn":"地铁花园-2","director":"D"')


def test_pages_to_document(spark, tmp_path):
    chain_a = ('<div class="schedule-movie-detail"><h3>映画A（字幕版）</h3><img src="/p.jpg"><table class="schedule-table">'
               '<tr><td>4/13(月)</td><td>10:00</td></tr><tr><td>4/21</td><td>11:00</td></tr></table></div>')
    chain_b = '<div class="programBox"><h2>映画A（吹替版）</h2><span class="showtime">13:20～</span></div>'
    own = '<article class="movie"><h2>映画Z</h2><span class="time">19:00</span></article>'
    pages = spark.createDataFrame(
        [(1, "TOHO", 0, "A1", "https://a.jp", chain_a), (1, "United", 10, "B1", "https://b.jp", chain_b),
         (1, "独立影院", 20, "I1", "https://jk.uplink.co.jp", own), (1, "独立影院", 21, "I2", "https://x.jp", None)],
        "issue_number int, source string, sched_ord int, theater_name string, base_url string, html string")
    answers = spark.createDataFrame([("映画A（字幕版）", '[{"id":"1","type":"movie","rating":{"value":"8.0"}}]')], "q string, p string")
    candidates = scan_candidates(answers, F.col("q"), F.col("p"))
    subjects = scan_subjects(spark.createDataFrame(
        [(1, "https://r/subject/1/", '<strong class="rating_num">8.3</strong><span property="v:votes">180,000</span>')],
        "page_id long, url string, html string"))
    issues = spark.createDataFrame([(1, demo.DAY)], "issue_number int, week_start date")
    for folder in (None, str(tmp_path / "stage")):
        parts, films = weekly_job(pages, candidates, subjects, issues, "2026-04-13", OPTIONS, folder)
        got = {r.title_jp: r for r in films.collect()}
        a = got["映画A（字幕版）"]
        assert (a.screening_count, a.theaters, a.score, a.votes, a.poster_url, a.is_new_release, a.next_week) == (
            3, "A1、B1", 8.3, 180000, "https://a.jp/p.jpg", True, 1)
        assert (got["映画Z"].screening_count, got["映画Z"].score, got["映画Z"].rating_id) == (1, 0.0, "")
        sections = [r.section for r in parts.select("part_key.section").orderBy("section").collect()]
        assert sections == [1, 2, 2, 3, 4, 4, 5, 6, 7]
    unrated = weekly_job(pages, candidates, None, issues, "2026-04-13", OPTIONS)[1]
    assert {r.score for r in unrated.collect()} == {0.0}


def test_same_title_in_two_issues_is_rated_in_both(spark):
    films, shows, issues = demo.tables(spark)
    both = films.unionByName(films.withColumn("issue_number", F.lit(2))).withColumn("year", F.lit(0))
    candidates = spark.createDataFrame(
        [("灯台守の犬", 0, "9", "movie", "", True, "6.0")],
        "query string, pos int, id string, type string, year string, has_rating boolean, rating string")
    subjects = spark.createDataFrame([], "id string, title_cn string, director string, cast string, genre string, year int, duration int, "
                                         "score double, votes bigint, reviews array<string>")
    rated = rate(merge_titles(both, ["issue_number"]), candidates, subjects)
    assert rated.count() == 14
    assert [(r.issue_number, r.score) for r in rated.filter("rating_id = '9'").orderBy("issue_number").collect()] == [(1, 6.0), (2, 6.0)]


def test_config_to_archive(spark, tmp_path):
    """Theatre list, captured pages, job, archive, and the archive read back."""
    config = {"toho": {"enabled": True, "base_url": "https://a.jp", "locations": [{"id": "1", "name": "A1"}, {"id": "2", "name": "A2"}]},
              "independent": {"enabled": True, "locations": [{"name": "I1", "url": "https://i.jp/x/", "schedule_path": "now.html"}]}}
    captured = spark.createDataFrame([
        (1, "https://a.jp/net/movie/1/schedule/list.do", '<a href="/net/movie/9">映画L</a>'),
        (2, "https://i.jp/x/now.html", '<article><h2>映画Z</h2><b class="time">9:30</b></article>'),
        (3, "https://else.jp/", "<h2>other</h2>")], "page_id long, url string, html string")
    pages = scan_pages(theater_dim(spark, config), captured).withColumn("issue_number", F.lit(12))
    issues = spark.createDataFrame([(12, demo.DAY)], "issue_number int, week_start date")
    parts, films = weekly_job(pages, None, None, issues, "2026-04-13", OPTIONS, str(tmp_path / "stage"))
    assert {(r.title_jp, r.screening_count, r.theaters) for r in films.collect()} == {("映画L", 0, ""), ("映画Z", 1, "I1")}
    path = str(tmp_path / "archive")
    write_issues(named_parts(issues, parts, F.col("week_start")), path)
    names = scan_archive(spark, path).select("file_name")
    assert [r.file_name for r in names.collect()] == ["briefing_012_2026-04-13.md"]
    text = read_archive(spark, path, names).first().text
    assert text == issue_document(issues, films, OPTIONS).first().markdown
    assert text.startswith("# 第12期 4月13日 ~ 4月19日\n") and "| 🥇 | 映画Z | 1/100 | — | I1 |" in text
    assert next_issue(names).first()[0] == 13

import json
import os
import re

import pytest
from pyspark.sql import functions as F

from marquee.functions import archive_text as A
from marquee.operators.report import named_parts
from marquee.sources import archive as S
from marquee.sources.theaters import theater_dim


def test_valid_name(values):
    good = ["briefing_001_2026-04-13.md", "step1_2026-04-13.md", "briefing_1234_2026-99-99.md"]
    bad = ["../../etc/passwd", "secrets.md", "briefing_001_2026-04-13", "subdir/briefing_001_2026-04-13.md", "briefing_001_2026-04-13.md\n",
           "xbriefing_001_2026-04-13.md", "briefing__2026-04-13.md", "", "step_2026-04-13.md", "briefing_001_2026-04-13.mdx", "briefing_1_2026-04-13xmd"]
    assert values(A.valid_name, good + bad) == [True] * len(good) + [False] * len(bad)


def test_issue_filename(spark):
    df = spark.createDataFrame([(7, "2026-04-13"), (1234, "2026-01-01")], "n int, d string")
    got = [r[0] for r in df.select(A.issue_filename(F.col("n"), F.col("d").cast("date"))).collect()]
    assert got == ["briefing_007_2026-04-13.md", "briefing_1234_2026-01-01.md"]


def test_next_issue(spark):
    names = spark.createDataFrame([("briefing_009_2026-01-01.md",), ("briefing_010_x.md",), ("step99_2026-01-01.md",),
                                   ("old_briefing_050_x.md",), ("briefing_060_x.txt",)], "file_name string")
    assert S.next_issue(names).first()[0] == 11
    assert S.next_issue(names.limit(0)).first()[0] == 1


def test_extract_title(values):
    cases = ["# One\n# Two", "text\n  # Indented  \n", "#x\n## y", "# \n# Real", "", "a\r\n# Win\r\n", "a # b\n # U"]
    assert values(lambda c: A.extract_title(c, "none"), cases) == ["One", "Indented", "none", "Real", "none", "Win", "U"]


def test_restyle_headings(values):
    out = values(A.restyle_headings, ["<h1>A $1 \\ b</h1><h2>B</h2><h3>C</h3><h4>D</h4><h1 id=x>E</h1><h1>F\n</h1>"])[0]
    assert out.startswith('<div style="font-family:-apple-system') and out.endswith("</div>")
    assert '<p style="font-size:1.6em;font-weight:bold;text-align:center;">A $1 \\ b</p>' in out
    assert 'border-left:4px solid #e8ac48;padding-left:8px;margin-top:1em;">B</p>' in out and '<p style="font-size:1.1em;font-weight:bold;">C</p>' in out
    assert "<h4>D</h4><h1 id=x>E</h1><h1>F\n</h1>" in out


def test_draft_payload(spark):
    df = spark.createDataFrame([("标题", "", "<p>\"x\"</p>", "m"), ("T", "D", "", ""), ("T", None, "", None)], "t string, d string, c string, thumb string")
    got = [json.loads(r[0]) for r in df.select(A.draft_payload(F.col("t"), F.lit("me"), F.col("d"), F.col("c"), F.col("thumb"))).collect()]
    assert got[0] == {"articles": [{
        "title": "标题", "author": "me", "digest": "标题", "content": "<p>\"x\"</p>", "content_source_url": "", "need_open_comment": 0,
        "only_fans_can_comment": 0, "thumb_media_id": "m"}]}
    assert [g["articles"][0]["digest"] for g in got] == ["标题", "D", "T"]
    assert ["thumb_media_id" in g["articles"][0] for g in got] == [True, False, False]


@pytest.fixture
def many_files(spark):
    """Every issue spread over several tasks, as a large one would be."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_issue_written_by_many_tasks_reads_back_in_order(spark, tmp_path, many_files):
    path = str(tmp_path / "archive")
    lines = spark.range(6000).select(
        F.when(F.col("id") % 3 > 0, "briefing_001_2026-04-13.md").otherwise("step2_2026-04-13.md").alias("file_name"),
        F.struct((6000 - F.col("id")).alias("k")).alias("part_key"), F.concat(F.lit("line\n "), F.col("id").cast("string")).alias("text"))
    S.write_issues(lines.repartition(7), path)
    assert len(list((tmp_path / "archive").glob("data/version=*/file_name=briefing_001*/part-*"))) > 1
    catalog = S.scan_archive(spark, path)
    wanted = catalog.select("file_name").unionByName(spark.createDataFrame([("briefing_404_2026-04-13.md",)], "file_name string"))
    got = {r.file_name: r.text for r in S.read_archive(spark, path, wanted).collect()}
    expected = {name: "".join(f"line\n {i}\n" for i in range(5999, -1, -1) if (i % 3 > 0) == (name[0] == "b"))
                for name in ("briefing_001_2026-04-13.md", "step2_2026-04-13.md")}
    assert got == {**expected, "briefing_404_2026-04-13.md": ""}
    sizes = {r.file_name: r.size_kb for r in catalog.collect()}
    assert sizes == {n: round(len(t) / 1024, 1) for n, t in expected.items()}


def test_an_issue_can_be_added_and_written_again(spark, tmp_path):
    path = str(tmp_path / "archive")
    one, two = "briefing_001_2026-04-13.md", "briefing_002_2026-04-20.md"

    def write(name, *lines):
        rows = [(name, i, line) for i, line in enumerate(lines)]
        S.write_issues(spark.createDataFrame(rows, "file_name string, part_key int, text string"), path)

    write(one, "first", "issue")
    write(two, "second", "with", "a", "mistake")
    write(two, "second")
    texts = {r.file_name: r.text for r in S.read_archive(spark, path, [one, two, "briefing_404_2026-04-13.md"]).collect()}
    assert texts == {one: "first\nissue\n", two: "second\n", "briefing_404_2026-04-13.md": ""}


@pytest.mark.parametrize("as_table", [False, True])
def test_only_the_wanted_issues_are_opened(spark, tmp_path, as_table):
    path = str(tmp_path / "archive")
    rows = [(f"briefing_{i:03d}_2026-04-13.md", 0, "x") for i in range(40)]
    S.write_issues(spark.createDataFrame(rows, "file_name string, part_key int, text string"), path)
    wanted = [rows[3][0], rows[30][0], "briefing_404_2026-04-13.md"]
    got = S.read_archive(spark, path, spark.createDataFrame([(n,) for n in wanted], "file_name string") if as_table else wanted)
    assert {r.file_name: r.text for r in got.collect()} == {wanted[0]: "x\n", wanted[1]: "x\n", wanted[2]: ""}
    opened = {re.search("file_name=([^/]*)/", f)[1] for f in got.inputFiles() if "/data/" in f}
    assert opened == set(wanted[:2])


def test_readers_see_the_old_or_the_new_issue(spark, tmp_path):
    path = str(tmp_path / "archive")
    one = "briefing_001_2026-04-13.md"

    def parts(text):
        return spark.createDataFrame([(one, 0, text)], "file_name string, part_key int, text string")

    S.write_issues(parts("old"), path)
    begun = S.read_archive(spark, path, [one])
    # a write that has not reached its manifest, as one that failed half way
    parts("half").select("file_name", "text").write.partitionBy("file_name").text(f"{path}/data/version=v99999999999999999999-x")
    assert S.read_archive(spark, path, [one]).first().text == "old\n"
    S.write_issues(parts("new"), path)
    assert S.read_archive(spark, path, [one]).first().text == "new\n"
    assert begun.first().text == "old\n"  # a reader that began before keeps its version
    assert len(list((tmp_path / "archive" / "manifest").glob("*.parquet"))) == 2
    assert S.read_archive(spark, path, []).count() == 0 and S.scan_archive(spark, path).count() == 1


def test_catalogue_of_plain_files(spark, tmp_path):
    for i, name in enumerate(["briefing_001_2026-04-13.md", "step1_2026-04-13.md", "notes.md", "briefing_x.md", "briefing_2.txt"]):
        (tmp_path / name).write_text("x" * (i + 1) * 600, encoding="utf-8")
        os.utime(tmp_path / name, (1_700_000_000 + i * 60, 1_700_000_000 + i * 60))
    rows = S.scan_archive(spark, str(tmp_path), S.FILES).collect()
    assert [(r.file_name, r.size_kb, r.modified) for r in rows] == [
        ("briefing_x.md", 2.3, "2023-11-14 22:16"), ("step1_2026-04-13.md", 1.2, "2023-11-14 22:14"), ("briefing_001_2026-04-13.md", 0.6, "2023-11-14 22:13")]
    wanted = spark.createDataFrame([("step1_2026-04-13.md",), ("briefing_404_2026-04-13.md",)], "file_name string")
    got = {r.file_name: r.text for r in S.read_archive(spark, str(tmp_path), wanted, S.FILES).collect()}
    assert got == {"step1_2026-04-13.md": "x" * 1200, "briefing_404_2026-04-13.md": ""}


def test_catalogue_reads_no_content(spark, tmp_path):
    (tmp_path / "briefing_001_2026-04-13.md").write_text("x", encoding="utf-8")
    plan = S.scan_archive(spark, str(tmp_path), S.FILES)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def test_named_parts(spark):
    issues = spark.createDataFrame([(3,)], "issue_number int")
    parts = spark.createDataFrame([(3, 1, "a")], "issue_number int, part_key int, text string")
    got = named_parts(issues, parts, F.lit("2026-04-13").cast("date")).collect()
    assert [tuple(r) for r in got] == [("briefing_003_2026-04-13.md", 1, "a")]


def test_theater_dim(spark):
    config = {
        "toho": {"enabled": True, "locations": [{"id": "076", "name": "A"}, {"id": "036", "name": "B"}]},
        "united": {"enabled": False, "locations": [{"id": "toyosu", "name": "C"}]},
        "independent": {"enabled": True, "locations": [
            {"name": "D", "url": "https://d.jp", "schedule_path": "/schedule/"}, {"name": "E", "url": "https://e.jp/x/"}]}}
    rows = theater_dim(spark, config).orderBy("sched_ord").collect()
    assert [(r.source, r.theater_name, r.schedule_url) for r in rows] == [
        ("TOHO", "A", "https://hlo.tohotheater.jp/net/movie/076/schedule/list.do"),
        ("TOHO", "B", "https://hlo.tohotheater.jp/net/movie/036/schedule/list.do"),
        ("独立影院", "D", "https://d.jp/schedule/"), ("独立影院", "E", "https://e.jp/")]
    config["independent"]["locations"][1]["schedule_path"] = ""
    assert [r.schedule_url for r in theater_dim(spark, config).filter("theater_name = 'E'").collect()] == ["https://e.jp/x/"]
    config["united"].update(enabled=True, base_url="https://u.jp")
    assert [r.schedule_url for r in theater_dim(spark, config).filter("source = 'United'").collect()] == ["https://u.jp/toyosu/daily.php"]
    assert theater_dim(spark, {}).count() == 0

import re

from pyspark.sql import functions as F

from marquee.functions import text as T

SPACES = ["　", "\xa0", "\x1c", "\x1f", "\x85", " ", "\t", "\x0b"]


def test_clean_text_matches_unicode_whitespace_rules(values):
    cases = [f"{s}a{s}{s} b{s}" for s in SPACES] + ["", "  ", "映画　タイトル", "a​b"]
    assert values(T.clean_text, cases) == [re.sub(r"\s+", " ", c.replace("　", " ")).strip() for c in cases]


def test_strip_text_keeps_inner_whitespace(values):
    cases = ["　a  b\x1c", "", " \n", "x"]
    assert values(T.strip_text, cases) == [c.strip() for c in cases]


def test_normalize_title(values):
    cases = {"映画A（字幕版）": "映画a", "映画A(吹替版)": "映画a", "映画（x)B(y）": "映画b", "Movie　ONE\xa0\x1c2": "movieone2",
             "（字幕版）": "", "": "", "a(b": "a(b", "(x)(y)z": "z"}
    assert values(T.normalize_title, list(cases)) == list(cases.values())


def test_times(values):
    cases = ["10:00～", "9:05", "sold out ", "", "  ", "starts 13:20 or 15:00", "１０:００", "123:456"]
    assert values(T.parse_time_lenient, cases) == ["10:00", "9:05", "sold out", "", "", "13:20", "１０:００", "23:45"]
    assert values(T.parse_time_strict, cases) == ["10:00", "9:05", "", "", "", "13:20", "１０:００", "23:45"]


def test_placeholders(values):
    assert values(T.is_placeholder, ["", "-", "―", "×", "x", "10:00", "--"]) == [True] * 4 + [False] * 3


def test_first_token(values):
    assert values(T.first_token, ["利益区域 関心領域", "　a　b", "", "   ", "one"]) == ["利益区域", "a", None, None, "one"]


def test_titles_and_queries(spark):
    df = spark.createDataFrame(
        [("原", "", 0), ("原", "原", 2023), ("原", "译", 5)], "jp string, cn string, y int")
    jp, cn = F.col("jp"), F.col("cn")
    rows = df.select(T.display_title(jp, cn), T.short_title(jp, cn), T.lookup_query(jp, F.col("y"))).collect()
    assert [tuple(r) for r in rows] == [("原", "原", "原"), ("原", "原", "原 2023"), ("译（原）", "译", "原 5")]


def test_fixed_decimals_round_ties_to_even(values):
    cases = [8.25, 8.35, 70.5, 71.5, 0.0]
    assert values(lambda c: T.fixed_decimals(c, 0), cases, "double") == ["8", "8", "70", "72", "0"]
    assert values(lambda c: T.fixed_decimals(c, 1), [8.25, 8.75, 9.0], "double") == ["8.2", "8.8", "9.0"]


def test_fill_treats_braces_and_null_as_text(spark):
    df = spark.range(1)
    got = df.select(T.fill("a{x}b{y}", x=F.lit("{y}"), y=F.lit(None).cast("string"))).first()[0]
    assert got == "a{y}b"

"""Seven invented films and seventeen showings with known scores."""

import datetime as dt

DAY = dt.date(2026, 4, 13)
FILMS = [
    # title_jp, title_cn, score, votes, new, reviews, [(theatre, day offset)]
    ("潮の時刻表", "潮汐时刻", 6.4, 12000, True, ["x1"], [("東館", 0), ("西館", 2)]),
    ("灯台守の犬", "灯塔看守的狗", 9.0, 40000, True, ["k1", "k2"], [("北館", 0), ("北館", 1)]),
    ("八月の硝子", "八月玻璃", 7.7, 9000, False, ["h1", "h2", "h3"], [("南館", 0), ("東館", 0), ("西館", 1)]),
    ("地下鉄の庭-2", "地铁花园-2", 8.6, 650000, True, ["m1", "m2"], [("西館", 0), ("西館", 3)]),
    ("夜行バス", "夜行巴士", 5.9, 300, False, [], [("東館", 0)]),
    ("雨と定規・改", "雨与尺", 8.1, 2000000, False, ["r1", "r2", "r3"], [("南館", 0), ("南館", 0), ("南館", 0), ("南館", 0), ("南館", 0)]),
    ("郵便局前", "邮局前", 7.0, 99999, False, ["p1"], [("北館", 0), ("南館", 4)]),
]
# Worked out by hand from the formula: 5 per point, 20 per 7 decades of votes, 1 per showing, 10 if new.
SCORES = {"地下鉄の庭-2": 71.61, "灯台守の犬": 70.15, "雨と定規・改": 63.5, "潮の時刻表": 55.65, "八月の硝子": 52.8, "郵便局前": 51.29, "夜行バス": 37.58}
FILM_SCHEMA = ("issue_number int, sched_ord int, pos int, title_jp string, title_cn string, director string, cast string, genre string, "
               "poster_url string, url string, year int, duration int, score double, votes bigint, is_new_release boolean, reviews array<string>")
SHOW_SCHEMA = "issue_number int, title_jp string, theater_name string, show_date date"


def tables(spark, issue=1):
    films = [(issue, 0, i, jp, cn, "D", "", "G", "", "", 2023, 100, score, votes, new, reviews)
             for i, (jp, cn, score, votes, new, reviews, _) in enumerate(FILMS)]
    shows = [(issue, f[0], theater, DAY + dt.timedelta(off)) for f in FILMS for theater, off in f[6]]
    issues = spark.createDataFrame([(issue, DAY)], "issue_number int, week_start date")
    return spark.createDataFrame(films, FILM_SCHEMA), spark.createDataFrame(shows, SHOW_SCHEMA), issues

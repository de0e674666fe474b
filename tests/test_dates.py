import datetime as dt

from pyspark.sql import functions as F

from marquee.functions import dates as D

DAY = dt.date


def test_parse_month_day(values):
    cases = {"4/13(日)": DAY(2026, 4, 13), "12/31": DAY(2026, 12, 31), "2/30": None, "no": None, "": None,
             "４/１３": DAY(2026, 4, 13), "x 1/2 3/4": DAY(2026, 1, 2), "13/1": None, "0/5": None, "123/45": None}
    assert values(lambda c: D.parse_month_day(c, "2026-04-13"), list(cases)) == list(cases.values())


def test_january_read_in_december_is_next_year(values):
    got = values(lambda c: D.parse_month_day(c, "2026-12-20"), ["1/1", "12/31", "2/1", "01/05"])
    assert got == [DAY(2027, 1, 1), DAY(2026, 12, 31), DAY(2026, 2, 1), DAY(2027, 1, 5)]


def test_leap_day_depends_on_the_year(values):
    assert values(lambda c: D.parse_month_day(c, "2024-02-01"), ["2/29"]) == [DAY(2024, 2, 29)]
    assert values(lambda c: D.parse_month_day(c, "2026-02-01"), ["2/29"]) == [None]


def test_week_bounds_on_every_weekday(values):
    days = [DAY(2026, 4, 13) + dt.timedelta(i) for i in range(-1, 9)]
    monday = [d - dt.timedelta(d.weekday()) for d in days]
    for fn, shift in ((D.week_start, 0), (D.week_end, 6), (D.next_week_start, 7), (D.next_week_end, 13)):
        assert values(fn, days, "date") == [m + dt.timedelta(shift) for m in monday]


def test_recent_and_label(values):
    days = [DAY(2026, 4, 6), DAY(2026, 4, 5), DAY(2026, 4, 20), None]
    assert values(lambda c: D.is_recent(c, "2026-04-13"), days, "date") == [True, False, True, None]
    assert values(D.date_label, [DAY(2026, 4, 3), DAY(2026, 12, 31)], "date") == ["4月3日", "12月31日"]


def test_date_wanted(spark):
    df = spark.createDataFrame([(DAY(2026, 4, 13),), (DAY(2026, 4, 14),), (None,)], "d date")
    kept = df.filter(D.date_wanted(F.col("d"), ["2026-04-13"])).collect()
    assert [r.d for r in kept] == [DAY(2026, 4, 13), None]
    assert df.filter(D.date_wanted(F.col("d"), None)).count() == 3

"""Capture times in all their layouts, and every format character, by goldens and against Python's calendar."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from filewright.functions import dates

TIMES = [
    ("2024:01:20 12:10:05", "2024-01-20 12:10:05.000000"), ("2024-01-20 12:10:05", "2024-01-20 12:10:05.000000"), ("2024/01/20 12:10:05", "2024-01-20 12:10:05.000000"), ("2024-01-20T12:10:05", "2024-01-20 12:10:05.000000"),
    ("2024-01-20T12:10:05Z", "2024-01-20 12:10:05.000000"), ("2024-01-20 12:10:05+02:00", "2024-01-20 12:10:05.000000"), ("2024:01:20 12:10:05 -0530", "2024-01-20 12:10:05.000000"), ("2024-01-20 12:10", "2024-01-20 12:10:00.000000"),
    ("2024-01-20", "2024-01-20 00:00:00.000000"), ("2024/1/2", "2024-01-02 00:00:00.000000"), ("2024-01-20 12:10:05.25", "2024-01-20 12:10:05.250000"), ("2024-01-20 12:10:05.1234567", "2024-01-20 12:10:05.123456"),
    ("2024:02:30 12:10:05", "2024-03-01 12:10:05.000000"), ("2023-02-31", "2023-03-03 00:00:00.000000"), ("2024:04:31 24:00:00", "2024-05-02 00:00:00.000000"), ("2023:12:31 23:59:60", "2024-01-01 00:00:00.000000"), (" 2024-01-20 ", "2024-01-20 00:00:00.000000"),
    ("0000:00:00 00:00:00", None), ("2024:00:20 12:10:05", None), ("2024-13-01", None), ("2024-01-32", None), ("2024:01:20", None), ("2024-01/20", None), ("2024-01-20 25:00:00", None), ("2024-01-20 12:60:00", None), ("yesterday", None), ("", None), (None, None),
]


def test_layouts(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TIMES)], "i int, t string")
    got = dict(df.select("i", F.date_format(dates.capture_time(F.col("t"), F.lit(None).cast("string")), "yyyy-MM-dd HH:mm:ss.SSSSSS")).collect())
    assert [(t, got[i]) for i, (t, _) in enumerate(TIMES)] == TIMES


FORMATS = [
    ("jS", "20th"), ("W o", "03 2024"), ("t L", "31 1"), ("e T", "UTC UTC"), ("O P p Z I", "+0000 +00:00 Z 0 0"), ("c", "2024-01-20T12:10:05+00:00"), ("r", "Sat, 20 Jan 2024 12:10:05 +0000"), ("U", "1705752605"), ("B", "548"), ("x X", "2024 +2024"), (r"\c\r", "cr"), ("D, d M Y", "Sat, 20 Jan 2024"),
]


@pytest.mark.parametrize("format_, expected", FORMATS)
def test_formats(spark, format_, expected):
    name = dates.capture_renamed(F.lit("2024:01:20 12:10:05"), F.lit(None).cast("string"), F.lit("j"), format_)
    assert spark.range(1).select(name).first()[0] == expected + ".j"


@pytest.mark.parametrize("zone, expected", [("+02:00", "+02:00 +02:00 +0200 +02:00 +02:00 7200 1705745405"), ("-0530", "-05:30 -05:30 -0530 -05:30 -05:30 -19800 1705772405"), ("Z", "Z Z +0000 +00:00 Z 0 1705752605"), ("UTC", "UTC UTC +0000 +00:00 Z 0 1705752605")])
def test_zones(spark, zone, expected):
    name = dates.capture_renamed(F.lit("2024-01-20 12:10:05" + zone), F.lit(None).cast("string"), F.lit("j"), "e T O P p Z U")
    assert spark.range(1).select(name).first()[0] == expected + ".j"


def test_calendar_characters_against_python(spark):
    days = [dt.date(2019, 12, 1) + dt.timedelta(days=9 * k) for k in range(260)]
    df = spark.createDataFrame([(d.isoformat(),) for d in days], "t string")
    got = dict(df.select("t", dates.capture_renamed(F.col("t"), F.lit(None).cast("string"), F.lit(""), "o-W-N z t L S U")).collect())

    def suffix(n):
        return "th" if 11 <= n <= 13 else {1: "st", 2: "nd", 3: "rd"}.get(n % 10, "th")

    for d in days:
        year, week, weekday = d.isocalendar()
        last = (d.replace(day=28) + dt.timedelta(days=4)).replace(day=1) - dt.timedelta(days=1)
        leap = int(d.year % 4 == 0 and (d.year % 100 != 0 or d.year % 400 == 0))
        since = int(dt.datetime(d.year, d.month, d.day, tzinfo=dt.UTC).timestamp())
        assert got[d.isoformat()] == f"{year}-{week:02}-{weekday} {d.timetuple().tm_yday - 1} {last.day} {leap} {suffix(d.day)} {since}."

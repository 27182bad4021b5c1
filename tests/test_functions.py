from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from paddock.functions import text, timing
from paddock.functions.scoring import points_for


def values(spark, rows, ddl, column):
    return [r[0] for r in spark.createDataFrame(rows, ddl).coalesce(1).select(column).collect()]


def test_gaps(spark):
    texts = ["+1:02.5", "+5", "+12,345", "DNF", "dnf", "+99", "+1:23.4567", "bad", "5.0", None]
    found = values(spark, [(100.0, t) for t in texts], "l double, g string", timing.parse_gap(F.col("l"), F.col("g")))
    assert found == [162.5, 105.0, 112.345, None, None, 109.0, 100.0 + 83.456, None, None, None]
    loose = values(spark, [(t,) for t in texts], "g string", timing.is_valid_gap(F.col("g")))
    strict = values(spark, [(t,) for t in texts], "g string", timing.is_valid_gap(F.col("g"), strict=True))
    assert loose == [True] * 7 + [False] * 3
    assert strict == [True] * 5 + [False] * 5


def test_times(spark):
    texts = ["83:05.123", "1:02", "1:02.5", "0:59.050", "x", "1:2:3", None]
    found = values(spark, [(t,) for t in texts], "t string", timing.parse_time(F.col("t")))
    assert found == [4985.123, 62.0, 62.005, 59.05, None, None, None]
    seconds = [4990.0, 62.25, 59.0, 0.5, None]
    shown = values(spark, [(s,) for s in seconds], "s double", timing.format_time(F.col("s")))
    assert shown == ["83:10", "1:02.250", "0:59", "0:00.500", None]


def test_format_gap(spark):
    rows = [(100.0, 100.0), (100.0, 162.25), (100.0, None), (None, 5.0), (None, None), (100.0, 3800.5)]
    shown = values(spark, rows, "l double, t double", timing.format_gap(F.col("l"), F.col("t")))
    assert shown == ["1:40", "+01:02.250", "DNF", None, None, "+61:40.500"]


def test_gap_round_trip_on_quarter_seconds(spark):
    rows = spark.range(1, 14400).select((F.col("id") / 4).alias("gap"))
    back = timing.gap_seconds(timing.format_gap(F.lit(1000.0), F.col("gap") + 1000.0))
    assert rows.filter(~back.eqNullSafe(F.col("gap"))).count() == 0


@pytest.mark.parametrize(
    ("rank", "sprint", "time", "dsq", "fastest", "expected"),
    [
        (1, False, 1.0, False, True, 26),
        (10, False, 1.0, False, True, 2),
        (11, False, 1.0, False, True, 0),
        (1, True, 1.0, False, True, 8),
        (8, True, 1.0, False, False, 1),
        (9, True, 1.0, False, False, 0),
        (1, None, 1.0, False, True, 25),
        (1, False, None, False, True, 0),
        (1, False, 1.0, True, True, 0),
        (5, False, 1.0, None, None, 10),
    ],
)
def test_points(spark, rank, sprint, time, dsq, fastest, expected):
    rows = [(rank, sprint, time, dsq, fastest)]
    ddl = "rank int, sprint boolean, time double, dsq boolean, fastest boolean"
    found = values(spark, rows, ddl, points_for(*[F.col(c) for c in ("rank", "sprint", "time", "dsq", "fastest")]))
    assert found == [expected]


def test_videos(spark):
    pairs = [
        ("https://www.youtube.com/watch?v=abc", "https://www.youtube.com/embed/abc"),
        ("https://www.youtube.com/watch?v=abc&t=30", "https://www.youtube.com/embed/abc?start=30"),
        ("https://m.youtube.com/watch?start=5&v=abc", "https://www.youtube.com/embed/abc?start=5"),
        ("https://www.youtube.com/live/xyz?t=9", "https://www.youtube.com/embed/xyz?start=9"),
        ("https://www.youtube.com/@channel", None),
        ("https://youtu.be/abc", "https://www.youtube.com/embed/abc"),
        ("https://youtu.be/", None),
        ("https://streamable.com/s1", "https://streamable.com/e/s1"),
        ("https://medal.tv/games/x/clips/1", "https://medal.tv/games/x/clip/1"),
        ("https://outplayed.tv/o1", "https://outplayed.tv/o1"),
        ("https://clips.twitch.tv/Clip", "https://clips.twitch.tv/embed?clip=Clip&parent=p.example"),
        ("https://example.com/?u=https://youtu.be/abc", None),
        ("not a url at all", None),
        ("https://bad host/%zz?v=%", None),
        ("", None),
    ]
    found = values(
        spark,
        [(url,) for url, _ in pairs],
        "url string",
        text.embed_url(F.col("url"), text.url_host(F.col("url")), "p.example"),
    )
    assert found == [player for _, player in pairs]


def test_uuid(spark):
    good = "0f8fad5b-d9cb-469f-a165-70867728950e"
    texts = [good, good.upper(), good.replace("-", ""), f"{{{good}}}", good + "\n", "x", None]
    assert values(spark, [(t,) for t in texts], "t string", text.is_canonical_uuid(F.col("t"))) == [True] + [False] * 6


def test_names(spark):
    names = ["Season 1", "a/b~c*d", "Ročník 2", "1+1"]
    encoded = values(spark, [(n,) for n in names], "n string", text.encode_name(F.col("n")))
    assert encoded == ["Season%201", "a/b~c%2Ad", "Ro%C4%8Dn%C3%ADk%202", "1%2B1"]
    back = values(spark, [(e,) for e in encoded], "n string", text.decode_name(F.col("n")))
    assert back == names
    assert values(spark, [("a+b",)], "n string", text.decode_name(F.col("n"))) == ["a+b"]


def test_local_start(spark):
    texts = ["2024-07-01T20:00", "2024-01-01T20:00", "2024-10-27T02:30", "tomorrow"]
    found = values(spark, [(t,) for t in texts], "t string", timing.local_to_utc(F.col("t")))
    assert found == [
        dt.datetime(2024, 7, 1, 18, 0),
        dt.datetime(2024, 1, 1, 19, 0),
        dt.datetime(2024, 10, 27, 0, 30),
        None,
    ]


def test_deadline(spark):
    dates = [dt.datetime(2024, 5, 4, 16, 0), dt.datetime(2024, 5, 4, 23, 30, 15, 250000)]
    rows = [(d,) for d in dates]
    utc = values(spark, rows, "d timestamp_ntz", timing.report_deadline(F.col("d")))
    assert utc == [dt.datetime(2024, 5, 5, 23, 59, 59)] * 2
    local = values(spark, rows, "d timestamp_ntz", timing.report_deadline(F.col("d"), "Europe/Budapest"))
    assert local == [dt.datetime(2024, 5, 5, 21, 59, 59), dt.datetime(2024, 5, 6, 21, 59, 59)]


def test_has_been_raced_after_three_hours(spark):
    rows = [(dt.datetime(2024, 5, 4, 12, 0),), (dt.datetime(2024, 5, 4, 11, 59, 59),)]
    as_of = F.lit("2024-05-04 15:00:00").cast("timestamp_ntz")
    assert values(spark, rows, "d timestamp_ntz", timing.has_been_raced(F.col("d"), as_of)) == [False, True]

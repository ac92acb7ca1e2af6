import pytest

from cuefold.functions import timecode as C


@pytest.mark.parametrize("seconds, out", [
    (5.9996, "00:00:06,000"), (0.0, "00:00:00,000"), (-3.0, "00:00:00,000"), (3661.5, "01:01:01,500"), (360000.25, "100:00:00,250"),
    (float("nan"), "00:00:00,000"), (None, "00:00:00,000"),
])
def test_srt_time(spark, seconds, out):
    df = spark.createDataFrame([(seconds,)], "s double")
    assert df.select(C.srt_time(df.s)).first()[0] == out


@pytest.mark.parametrize("text, out", [
    ("00:00:01,5", 1.5), (" 1:02.25 ", 62.25), ("100:00:00,001", 360000.001), ("12", None), ("1:2:3", None), ("", None), (None, None),
])
def test_parse_timecode(one, text, out):
    assert one(C.parse_timecode, text) == out


@pytest.mark.parametrize("text, out", [("00:00:01,500", 1.5), ("1:00:00.000", 3600.0), ("00:00:01,5", None), ("00:01,500", None)])
def test_strict_time(one, text, out):
    assert one(C.parse_srt_time, text) == out


@pytest.mark.parametrize("text, out", [("", 23.976), (None, 23.976), ("25", 25.0), ("24000 / 1001", 24000 / 1001), ("0", None), ("x", None), ("1d", None), ("1/0", None)])
def test_fps(one, text, out):
    assert one(lambda c: C.parse_fps(c, strict=False), text) == out
    if out is None:
        with pytest.raises(Exception, match="unusable frame rate"):
            one(C.parse_fps, text)
    else:
        assert one(C.parse_fps, text) == out


@pytest.mark.parametrize("text, out", [
    ("0:00:01:12", 1.5), ("00:00:02;06", 2.25), ("00:00:01.5", 1.5), ("1.5h", 5400.0), ("2m", 120.0), ("250ms", 0.25), ("48f", 2.0), ("3s", 3.0), ("1.5", 1.5), ("x", None), (None, None),
])
def test_ttml_time(one, text, out):
    from pyspark.sql import functions as F

    assert one(lambda t: C.ttml_time(t, F.lit(24.0)), text) == out


def test_required_timecode_fails(one):
    assert one(lambda t: C.require_timecode(t, "start"), "0:01") == 1.0
    with pytest.raises(Exception, match="not a start timecode"):
        one(lambda t: C.require_timecode(t, "start"), "soon")


def test_names_of_times(one):
    assert one(C.filename_time, 12.5) == "0000012500"
    assert one(C.minutes_seconds, 61000.0) == "1m 01s"
    assert one(C.percent, 0.00664) == "0.66%"

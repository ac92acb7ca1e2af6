import pytest
from pyspark.sql import functions as F

from cuefold.sources import formats as X
from cuefold.sources import srt_sink as S


def cues(spark, raw, name=None, fps=23.976):
    df = spark.createDataFrame([(raw, name)], "raw string, name string")
    out = X.cues(df, X.parse(df.raw, df.name, F.lit(fps)), ["name"]).orderBy("ord").collect()
    return [(r.start, r.end, r.text) for r in out]


CASES = {
    "vtt": ("WEBVTT\n\nNOTE x\n\n1\n00:01.000 --> 00:02.250 line:0\nA first line\n", [(1.0, 2.25, "A first line")]),
    "srt": ("﻿1\r\n00:00:01,000 --> 00:00:02,000\r\nHi\r\n\r\n2\r\n00:00:03,000-->00:00:04,000 X1:2\r\na\r\nb\r\n", [(1.0, 2.0, "Hi"), (3.0, 4.0, "a\nb")]),
    "srt with [Events] inside": ("1\n00:00:01,000 --> 00:00:02,000\n[Events]\n", [(1.0, 2.0, "[Events]")]),
    "ass": ("[Events]\nFormat: Start, End, Text\nDialogue: 0:00:01.50,0:00:02.00,a,b\nFormat: End, Start, Text\nDialogue: 0:00:04.00,0:00:03.00,c\nFormat: Start, Text\nDialogue: 1,2\n", [(1.5, 2.0, "a,b"), (3.0, 4.0, "c")]),
    "microdvd": ("{1}{1}25\n{25}{50}a|b\n{1}{1}50\n{50}{100}c\n", [(1.0, 2.0, "a\nb"), (1.0, 2.0, "c")]),
    "mpl2": ("[10][25]a|b\n", [(1.0, 2.5, "a\nb")]),
    "ttml": (
        '<tt xmlns="http://www.w3.org/ns/ttml" ttp:frameRate="25" ttp:frameRateMultiplier="1000 1001"><p begin="00:00:01:00" dur="2s"><![CDATA[a]]></p>'
        '<p style="x>y" begin="1.5" end="3.5">b<br/>c</p><p end="2s">no begin</p><p begin="soon" end="2s">bad</p><p begin="1s" end="2s"> </p></tt>',
        [(1.0, 3.0, "a"), (1.5, 3.5, "b\nc")],
    ),
    "sami": ("<SAMI><SYNC Start=1000>a<SYNC Start=\"2000\">&nbsp;<SYNC Start=5000>b</SAMI>", [(1.0, 2.0, "a"), (5.0, 8.0, "b")]),
    "stamped": ("[0:01] a\n(1:02:03.5) b\n[[2:00:00]] c", [(1.0, 3723.5, "a"), (3723.5, 7200.0, "b"), (7200.0, 7204.0, "c")]),
    "plain": ("\n a \n\nb\n", [(0.0, 3.0, "a"), (3.5, 6.5, "b")]),
    "empty": ("", []),
}


@pytest.mark.parametrize("kind", CASES)
def test_formats(spark, kind):
    raw, want = CASES[kind]
    assert cues(spark, raw) == want


def test_extension_wins(spark):
    assert cues(spark, "WEBVTT\n\n00:01.000 --> 00:02.000\nx", "a.SRT") == [(1.0, 2.0, "x")]
    assert cues(spark, None) == []


def test_microdvd_default_rate(spark):
    assert cues(spark, "{24}{48}x", fps=24.0) == [(1.0, 2.0, "x")]


def test_unreadable_times(spark):
    df = spark.createDataFrame([("1\nxx --> 00:00:02,000\na\n",)], "raw string")
    assert X.cues(df, X.srt(df.raw), [], strict=False).first().readable is False
    with pytest.raises(Exception, match="unreadable timecode"):
        X.cues(df, X.srt(df.raw), []).collect()


def test_metrics_scan(spark):
    raw = "﻿7\n00:00:01,000 --> 00:00:02,000\n a \n\nno arrow\n\n\n00:00:03.000-->00:00:04.000\nb\n\nx\n00:00:05,0 --> 00:00:06,000\nbad\n"
    df = spark.createDataFrame([(raw,)], "raw string")
    got = [tuple(r.c) for r in df.select(F.explode(X.srt_metrics(df.raw)).alias("c")).collect()]
    assert got == [(0, 7.0, 1.0, 2.0, "00:00:01,000 --> 00:00:02,000", "a"), (2, 3.0, 3.0, 4.0, "00:00:03.000-->00:00:04.000", "b")]


def test_srt_output(spark):
    rows = [("f", 1, 3.0, 4.0, "b"), ("f", 0, 1.0, 2.0, "<b>a</b>"), ("f", 2, 5.0, 5.0, "no length"), ("f", 3, 6.0, 7.0, " "), ("f", 4, 8.0, 9.0, "<x>"), ("f", 5, 8.0, 9.0, None)]
    df = spark.createDataFrame(rows, "file string, ord int, start double, end double, text string")
    r = S.srt_bodies(df, ["file"], "ord").first()
    assert r.body == "1\n00:00:01,000 --> 00:00:02,000\n<b>a</b>\n\n2\n00:00:03,000 --> 00:00:04,000\nb\n\n3\n00:00:08,000 --> 00:00:09,000\n\n"
    assert r.cues == 3
    raw = S.srt_bodies(df, ["file"], "ord", recognised=True).first()
    assert raw.cues == 5 and "<x>" in raw.body


def test_documents_and_names(one):
    assert one(S.srt_document, "a\nb\r\n") == "﻿a\r\nb\r\n"
    assert one(S.srt_document, " \n") == "﻿"
    assert one(S.srt_document, None) == "﻿"
    assert one(S.output_name, "x.vtt") == "x.srt"
    assert one(S.output_name, "x.srt") == "x-converted.srt"
    assert one(S.recognised_name, "/a/b.sup", "eng", None, None) == "/a/b-eng.srt"
    assert one(S.recognised_name, "/a/b.sup", "eng", "/o", "/z.srt") == "/o/b-eng.srt"
    assert one(S.cue_count, "1 --> 2 --> 3") == 2

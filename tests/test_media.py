import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuefold.operators import histogram, recognition, reuse, timing, tracks
from cuefold.sources import images, pgs, png, recognisers, report
from cuefold.streaming import progress


def bar(h=12, w=40):
    a = np.zeros((h, w), np.uint8)
    a[1:-1, 1:-1] = 1
    return a


def test_runs_round_trip():
    rng = np.random.default_rng(1)
    for width in (1, 7, 64, 20_000):
        pixels = np.repeat(rng.integers(0, 3, (5, width)), 1, 1).astype(np.uint8)
        pixels[0] = 2
        assert (pgs.decode_runs(pgs.encode_runs(pixels), width, 5) == pixels).all()


def test_runs_wrap_and_stop():
    assert pgs.decode_runs(bytes([0, 0x85, 3]), 2, 3).tolist() == [[3, 3], [3, 3], [3, 0]]
    assert pgs.decode_runs(b"\x01\x01\0\0\x02", 2, 2).tolist() == [[1, 1], [2, 0]]
    assert pgs.decode_runs(b"\0", 2, 1).tolist() == [[0, 0]]


def test_streams(spark):
    good = pgs.encode_set(1.0, bar()) + b"junk" + pgs.encode_set(3.0, None) + pgs.encode_set(4.0, bar(), cropped=True) + pgs.encode_set(6.5, bar(5, 5))
    blank = pgs.encode_set(1.0, bar(), palette=[(1, 235, 128, 128, 0)])
    df = spark.createDataFrame([("a", bytearray(good)), ("b", bytearray(b"no stream")), ("c", None), ("d", bytearray(blank)), ("e", bytearray(good[:-20]))], "file string, content binary")
    rows = pgs.scan(df).orderBy("file", "ord").collect()
    assert [(r.file, r.pts, r.usable) for r in rows if r.file == "a"] == [("a", 1.0, True), ("a", 3.0, False), ("a", 4.0, True), ("a", 6.5, False)]
    assert rows[0].content_width == 38 and rows[0].width == 38 + 48
    assert [(r.file, r.usable) for r in rows if r.file in "bcd"] == [("d", False)]
    assert {r.file: r.sets for r in pgs.count_sets(df).collect()} == {"a": 4, "b": 0, "c": 0, "d": 1, "e": 3}
    first = {(r.file, r.number): (r.pts, r.end_pts) for r in pgs.preview(df, 2).collect()}
    assert first == {("a", 1): (1.0, 3.0), ("a", 2): (4.0, None), ("e", 1): (1.0, 3.0), ("e", 2): (4.0, None)}
    assert {(r.pts, r.end_pts) for r in pgs.preview(df, 9).where("file = 'a'").collect()} == {(1.0, 3.0), (4.0, 6.5)}
    assert pgs.preview(df, 0).count() == 0
    ends = {r.pts: r.end_ms for r in timing.display_ends(pgs.scan(df, False).where("file = 'a'"), F.col("usable")).collect()}
    assert ends == {1.0: 3.0, 4.0: 6.5}


def test_equal_sets_are_rendered_once(monkeypatch):
    """Sets that differ in palette, place or pixels are told apart, wherever batches end."""
    dim = [(1, 100, 128, 128, 255)]
    kinds = [pgs.encode_set(1.0, bar()), pgs.encode_set(2.0, bar(), cropped=True), pgs.encode_set(1.0, bar(), palette=dim), pgs.encode_set(1.0, bar(12, 41)), pgs.encode_set(3.0, None), pgs.encode_set(1.0, bar(), x=5)]
    want = [[(pts, shown and (shown[0].tolist(), *shown[1:])) for pts, shown in pgs.display_sets(k)] for k in kinds]
    encode, coded = png.encode, []
    monkeypatch.setattr(png, "encode", lambda image: coded.append(1) or encode(image))
    monkeypatch.setattr(pgs, "BATCH_ROWS", 4)
    pgs._coded.cache_clear()
    streams = pa.RecordBatch.from_arrays([pa.array(["a", "b", None]), pa.array([b"".join(kinds) * 20, None, kinds[2]], pa.binary())], ["file", "content"])
    batches = list(pgs._scan(True)(iter([streams])))
    rows = [r for b in batches for r in b.to_pylist()]
    assert max(b.num_rows for b in batches) == 4 and [(r["file"], r["ord"]) for r in rows] == [("a", k) for k in range(120)] + [(None, 0)]
    flat = [x for k in want for x in k] * 20 + want[2]
    assert [(r["pts"], r["png"] and (png.decode(r["png"]).tolist(), r["content_width"], r["content_height"])) for r in rows] == flat
    assert len(coded) == 4


def test_palette_update():
    first = {1: (255, 1, 2, 3)}
    assert pgs.parse_palette(b"\0\0" + bytes([2, 16, 128, 128, 255]), first).keys() == {1, 2}
    assert pgs.parse_palette(b"\0\0" + bytes([2, 235, 128, 128, 0]), None) == {2: (0, 255, 255, 255)}


def test_png():
    image = np.arange(3 * 5 * 3, dtype=np.uint8).reshape(3, 5, 3)
    assert (png.decode(png.encode(image)) == image).all()
    with pytest.raises(ValueError):
        png.decode(b"nothing")


def test_pixels():
    a = np.zeros((20, 30), np.uint8)
    a[5:9, 5:9] = 255
    a[12:15, 12:20] = 255
    assert images.trim(a).shape == (10, 15)
    assert images.prepare_frame(a).shape == (58, 63)
    assert images.components(a > 0).max() == 2 or len(np.unique(images.components(a > 0))) == 3
    assert images.is_blank(np.full((3, 3), 7, np.uint8)) and not images.is_blank(a)
    assert (images.erode(images.dilate(a > 0), 1.0) == (a > 0)).all()
    ring = np.full((30, 30), 255, np.uint8)
    ring[5:20, 5:20] = 0
    ring[8:17, 8:17] = 255
    filled = images.fill_hollow(ring)
    assert filled[48, 48] == 0 and filled[0, 0] == 255


def test_histogram_decisions(spark):
    bins = [0] * 256
    bins[255], bins[200], bins[40] = 5000, 1000, 1000
    df = spark.createDataFrame([(bins, sum(bins)), ([0] * 256, 0)], "b array<bigint>, t bigint")
    rows = df.select(histogram.shadow_strip(df.b, df.t).alias("s"), histogram.fill_threshold(df.b, df.t).alias("f"), histogram.hollow_fill(df.b, df.t).alias("h")).collect()
    assert tuple(rows[0].s) == (47, 89) and rows[0].f is None and rows[0].h is False
    assert rows[1].s is None and rows[1].f is None and rows[1].h is False


def test_probe_and_choice(spark, one):
    assert one(recognition.score, "", 90.0) == 0.0
    for text, conf, want in [("[door opens]", 10.0, True), ("I just...", 35.0, True), ("H...", 10.0, True), ("ab", 99.0, False), ("abc", 45.0, True), ("abc", 44.0, False), (None, 99.0, False)]:
        assert one(recognition.usable, text, conf) is want
    sampled = spark.createDataFrame([("t", "y0u h&ve", 70.0, "you have"), ("t", None, None, None), ("u", "you have", 70.0, "you have"), ("v", "y0u h&ve", 95.0, "you have")], "t string, d_text string, d_conf double, c_text string")
    got = {r.t: (r.use_challenger, r.readable) for r in recognition.probe(sampled, ["t"]).collect()}
    assert got == {"t": (True, 1), "u": (False, 1), "v": (False, 1)}
    r = spark.createDataFrame([("i", 1, "", 0.0, "psm6"), ("i", 2, "hello there", 50.0, "psm13"), ("j", 3, "ab", 90.0, "psm6"), ("j", 4, "a good line", 85.0, "threshold-dilate"), ("k", 5, None, None, "psm6")], "img string, id bigint, text string, confidence double, variant string")
    assert {x.img: x.id for x in recognition.choose_reading(r, ["img"]).collect()} == {"i": 2, "j": 4, "k": None}


def test_choice_by_mode(spark):
    """Repairs compete on score in accurate mode; in hybrid mode only a weak first reading is tried again."""
    schema = "img string, id bigint, text string, confidence double, variant string, height int"
    rows = [
        ("repair", 1, "Whet wes thet", 70.0, "psm6", 90), ("repair", 2, "What was that", 95.0, "hollow-repair", 90),
        ("two letters", 3, "", 0.0, "psm6", 90), ("two letters", 4, "Ok", 85.0, "resize2-psm7", 90),
        ("single", 5, None, None, "psm11", 90), ("single", 6, "Ok", 85.0, "psm10", 90), ("single", 7, "Okay then", 60.0, "psm13", 90),
        ("strong", 8, "Two words here", 90.0, "psm6", 90), ("strong", 9, "Two words here and more of them", 82.0, "threshold-dilate", 90),
        ("tall", 10, "Two words here", 90.0, "psm6", 160), ("tall", 11, "Two words here and more of them", 82.0, "threshold-dilate", 160),
        ("unsure", 12, "a line of text", 50.0, "psm6", 90), ("unsure", 13, "a line", 44.0, "fill-select", 90),
        ("tie", 15, "same", 80.0, "psm11", 90), ("tie", 14, "same", 80.0, "psm11", 90), ("tie", 16, "same", 80.0, "psm6", 90),
        ("none", 17, "", 1.0, "psm6", 90), ("none", 18, "x", 99.0, "threshold-dilate", 90),
    ]
    df = spark.createDataFrame(rows, schema)
    pick = lambda *a: {x.img: x.id for x in recognition.choose_reading(df, ["img"], *a).collect()}
    assert pick() == {"repair": 2, "two letters": None, "single": 6, "strong": 9, "tall": 11, "unsure": 12, "tie": 16, "none": None}
    assert pick("hybrid", "height") == {"repair": 1, "two letters": None, "single": 6, "strong": 8, "tall": 11, "unsure": 12, "tie": 16, "none": None}
    assert recognition.choose_reading(df.limit(0), ["img"]).count() == 0


def test_command_output(one):
    f = recognition.parse_command_output
    assert tuple(one(f, '{"text":"a","confidence":"91.5","model":"m"}')) == ("a", 91.5, "m")
    assert tuple(one(f, " plain ")) == ("plain", 0.0, None)
    assert tuple(one(f, '{"text":"a","confidence":"x"}')) == ("a", 0.0, None)


def test_recogniser_hook(spark):
    df = spark.createDataFrame([(1, "h1", bytearray(b"x")), (2, "h1", bytearray(b"x")), (3, "h2", bytearray(b"bad"))], "id int, sha1 string, png binary")

    def reader(image, language):
        if image == b"bad":
            raise RuntimeError("broken")
        return '{"text":"' + language + '","confidence":50}'

    got = {r.id: (r.text, r.confidence, r.warnings) for r in recognisers.recognise(df, reader).collect()}
    assert got == {1: ("eng", 50.0, []), 2: ("eng", 50.0, []), 3: ("", 0.0, ["external-failed: RuntimeError"])}
    recognisers.register("mine", reader)
    assert recognisers.resolve("mine") is reader
    with pytest.raises(ValueError):
        recognisers.resolve("none")


def test_tracks(spark):
    info = {"tracks": [
        {"id": 0, "type": "video", "codec": "x"}, {"id": 2, "type": "subtitles", "codec": "S_HDMV/PGS", "properties": {"language": "eng"}},
        {"id": 3, "type": "subtitles", "properties": {"codec_id": "S_VOBSUB", "language": "eng"}}, {"id": 4, "type": "subtitles", "properties": {"codec_id": "S_DVBSUB"}},
        {"id": 5, "type": "subtitles", "properties": {"codec_id": "S_HDMV/PGS", "language": "fre", "forced_track": True}},
    ]}
    df = spark.createDataFrame([("m", json.dumps(info)), ("n", "no json"), ("o", None)], "file string, info string")
    t = tracks.parse_tracks(df, "info", "file")
    assert [(r.track_id, r["index"], r.stem_index, r.label) for r in t.orderBy("index").collect()] == [(2, 0, 0, "English (eng)"), (3, 1, 1, "English (eng)"), (5, 2, 0, "French (fre) forced")]
    plan = tracks.checked_plan(t, "/o")
    assert {r.track_id: r.outputs for r in plan.collect()} == {2: ["/o/m.sup"], 3: ["/o/m1.sub", "/o/m1.idx"], 5: ["/o/m-fre-forced.sup"]}
    with pytest.raises(ValueError):
        tracks.checked_plan(t.withColumn("stem_index", F.lit(0)).withColumn("codec", F.lit("S_VOBSUB")).withColumn("language_code", F.lit("eng")), "/o")
    left = tracks.without_outputs(plan, spark.createDataFrame([("/o/m1.sub",), ("/o/m.sup",)], "path string"))
    assert {r.track_id for r in left.collect()} == {3, 5}
    files = spark.createDataFrame([("/a/x.idx",), ("/a/x.sub",), ("/b/p.idx",), ("/b/q.sub",), ("/c/z.idx",)], "path string")
    assert {tuple(r) for r in tracks.pair_idx_sub(files).collect()} == {("/a/x.idx", "/a/x.sub"), ("/b/p.idx", "/b/q.sub")}


def test_cache_and_upsert(spark):
    ask = spark.createDataFrame([(k,) for k in "abcdefg"], "cache_key string")
    e = spark.createDataFrame([("a", "e1", 0, True, "x"), ("b", "e0", 0, True, "x"), ("c", "absent", 0, True, "x"), ("d", None, 1, True, "x"), ("e", "e1", 0, False, "x"), ("f", "e1", None, None, "")], "cache_key string, engine_version string, output_revision int, vision_available boolean, srt string")
    got = {r.cache_key: r.outcome for r in reuse.cache_lookup(ask, e, "e1", 0, True).collect()}
    assert got == {"a": "hit", "b": "engine", "c": "hit", "d": "revision", "e": "vision", "f": "malformed", "g": "miss"}
    q = spark.createDataFrame([("x", "fre", 1, False), ("y", "eng", 1, False)], "name string, language string, h int, selected boolean")
    i = spark.createDataFrame([("x", "eng", 2), ("z", "ger", 3)], "name string, language string, h int")
    assert {tuple(r) for r in reuse.upsert(q, i, "name", ["language"], ["h"]).collect()} == {("x", "fre", 2, True), ("y", "eng", 1, False), ("z", "ger", 3, True)}


@pytest.mark.parametrize("n, count", [(1, 5), (5, 5), (10, 2), (10, 7), (100, 24), (25, 24)])
def test_even_sample(spark, n, count):
    df = spark.createDataFrame([(k, n) for k in range(n)], "k int, n int")
    want = set(range(n)) if n <= count else {int(i * ((n - 1) / (count - 1)) + 0.5) for i in range(count)}
    assert {r.k for r in reuse.even_sample(df, "k", "n", count).collect()} == want


def test_timing(spark):
    f = spark.createDataFrame([("a", k, p) for k, p in enumerate([0, 0, 5, 5, 9])], "file string, ord int, pts bigint")
    assert {r.ord: r.end_ms for r in timing.next_later(f).collect()} == {0: 5, 1: 5, 2: 9, 3: 9, 4: 2509}
    d = f.withColumn("use", ~F.col("ord").isin(1, 3))
    assert {r.ord: r.end_ms for r in timing.display_ends(d, F.col("use")).collect()} == {0: 5, 2: 9, 4: None}
    g = spark.createDataFrame([("a", 0, None, None), ("a", 1, 7.0, 8.0), ("a", 2, 9.0, None)], "file string, ord int, pts double, end_pts double")
    assert {r.ord: (r.start_s, r.end_s) for r in timing.fallback_timing(g).collect()} == {0: (0.0, 7.0), 1: (7.0, 8.0), 2: (9.0, 11.5)}


def test_reports(spark, one):
    assert one(lambda a, b: report.csv_line(a, b), 'x "y"', None) == '"x ""y""",'
    boxes = spark.createDataFrame([([(0.9, 0.5, 0), (0.89, 0.1, 1), (0.2, 0.0, 2)],)], "b array<struct<y:double,x:double,id:int>>")
    assert boxes.select(report.reading_order(boxes.b)).first()[0] == [1, 0, 2]
    meta = '{"set":{"m":{"status":"partial","knownReferenceGaps":[{"start":1.0,"end":2.0}]}}}'
    assert one(lambda j, g, n: report.fixture_metadata(j, g, n)["status"], meta, "/x/set/", "m") == "partial"
    assert one(lambda j, g, n: report.fixture_metadata(j, g, n), meta, "/x/other", "m") is None


def test_progress_stream(spark, tmp_path):
    lines = ['{"type":"started","timestamp":"2025-01-01T00:00:00.000Z","job":"a"}', "noise", '{"type":"finished","job":"a","output":"o","duration_ms":5}', '{"job":"a"}', '{"type":"failed","job":"b"}']
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.jsonl").write_text("\n".join(lines))
    p = progress.job_progress(progress.parse_events(spark.readStream.text(str(tmp_path / "in"))))
    q = p.writeStream.outputMode("complete").format("memory").queryName("progress_test").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.job: (r.started, r.finished, r.failed, r.has_failed) for r in spark.table("progress_test").collect()}
    assert got == {"a": (1, 1, 0, False), "b": (0, 0, 1, True)}
    batch = progress.job_progress(progress.parse_events(spark.read.text(str(tmp_path / "in"))))
    assert {r.job: r.finished for r in batch.collect()} == {"a": 1, "b": 0}

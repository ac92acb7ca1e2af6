import numpy as np
from pyspark.sql import functions as F

from cuefold.functions import text as T
from cuefold.operators import summary
from cuefold.plans import extras
from cuefold.plans.extras import _parts
from cuefold.sources import formats as X
from cuefold.sources import images, pgs, report


def test_check_summary(spark):
    rows = [("a", True, True), ("a", True, None), ("a", False, False), ("b", None, False), ("b", True, True)]
    df = spark.createDataFrame(rows, "g string, required boolean, ok boolean")
    assert {r.g: (r.checks, r.failures, r.warnings, r.ok) for r in summary.check_summary(df, ["g"]).collect()} == {"a": (3, 1, 1, False), "b": (2, 0, 1, True)}
    assert summary.check_summary(df.limit(0), ["g"]).count() == 0


def test_name_order(spark):
    df = spark.createDataFrame([("g", k, n) for k, n in enumerate(["Zebra", "apple", "Émile", "Echo", "fox", "Echo", None])], "g string, id int, name string")
    got = summary.name_order(df, ["g"], "name", "id").collect()
    assert [r.name for r in sorted(got, key=lambda r: r.reader_rank)] == [None, "apple", "Echo", "Echo", "Émile", "fox", "Zebra"]
    assert [r.id for r in sorted(got, key=lambda r: r.code_rank)] == [6, 3, 5, 0, 1, 4, 2]


def test_partial_run_and_jobs(spark):
    df = spark.createDataFrame([(0, 8), (1, 1), (2, 64), (None, 4)], "ord int, cores int")
    assert [(r.ord, r.cacheable) for r in summary.partial_run(df, "ord", 2).collect()] == [(0, False), (1, False)]
    assert summary.partial_run(df, "ord", None).where("cacheable").count() == 4
    assert [r.j for r in df.select(summary.job_count(F.col("cores")).alias("j")).collect()] == [7, 1, 16, 3]
    assert [r.j for r in df.select(summary.job_count(F.col("cores"), F.col("ord")).alias("j")).collect()] == [1, 1, 2, 3]


def test_contractions_are_words(one):
    assert one(T.text_health, "don't it's I'm") == 1.0 and one(T.text_health, "xq'zt") == 0.5


def test_listings(spark, tmp_path):
    stream = pgs.encode_set(1.0, np.ones((10, 20), np.uint8))
    for name, data in (("a.SUP", stream), ("b.sup", b"x"), ("c.txt", stream), ("d.MKV", b"123")):
        (tmp_path / name).write_bytes(data)
    (tmp_path / "deeper.mkv").mkdir()
    assert {r.file: len(r.content) for r in pgs.read(spark, str(tmp_path)).collect()} == {"a.SUP": len(stream), "b.sup": 1}
    assert [(r.path.rsplit("/")[-1], r.length) for r in report.find_files(spark, str(tmp_path), "mkv").collect()] == [("d.MKV", 3)]


def test_csv_is_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", text'), (2, "plain"), (3, None)], "id int, text string")
    report.write_csv(df.coalesce(1), str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True, quote='"', escape='"', schema="id int, text string")
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in df.collect()}
    assert [r.line for r in report.report_line(df).collect()] == ['{"id":1,"text":"a \\"quoted\\", text"}', '{"id":2,"text":"plain"}', '{"id":3}']


def test_preparations_of_images():
    image = np.array([[0, 50, 100], [100, 150, 250], [10, 200, 60]], np.uint8)
    assert images.auto_level(image).min() == 0 and images.auto_level(image).max() == 255 and (images.auto_level(image[:1, :1]) == image[:1, :1]).all()
    assert (images.resize(image, 2)[::2, ::2] == image).all() and images.resize(image, 2).shape == (6, 6)
    # Only 250 is light; thickened by one pixel up, down, left and right.
    assert images.threshold_dilate(image).tolist() == [[0, 0, 255], [0, 255, 255], [0, 0, 255]]
    assert images.band(image, 30, 60).tolist() == [[255, 255, 0], [0, 0, 255], [255, 255, 255]]
    assert images.above(image, 60).tolist() == [[255, 255, 255], [255, 255, 0], [255, 0, 255]]


def test_pixels_of_a_stream_in_parts():
    """Fragments, two objects, an object never completed, a palette update and a new palette, pixel by pixel."""
    class Row:
        cue_id, start = 3, 2.0

    sets = list(pgs.display_sets(_parts(Row)))
    assert [t for t, _ in sets] == [2.0, 2.25, 2.5]
    red, green, blue, white = [238, 14, 14], [134, 246, 134], [16, 15, 239], [255, 255, 255]
    first, second, third = (shown[0][24:-24, 24:-24].tolist() for _, shown in sets)
    assert first[0] == [red] * 10 + [green] * 10 + [white] * 23 and first[9] == [red] * 10 + [green] * 10 + [white] * 13 + [green] * 10
    assert first[12] == [white] * 33 + [green] * 10 and len(first) == 13
    assert second == [[blue] * 10 + [green] * 10] * 10
    assert third == [[red] * 10] * 10


def test_streams_in_parts_past_the_clock(spark, tmp_path):
    """Starts that the 32-bit clock cannot hold, one where it starts again within the cue and one before 0."""
    starts = [2.0, 2**32 / 90_000 - 0.3, 50_000.0, 147_863.661, -1.0]
    rows = [(k, "f", s, s + 1) for k, s in enumerate(starts)]
    spark.createDataFrame(rows, "cue_id long, file string, start double, end double").write.parquet(str(tmp_path / "ref_cue.parquet"))
    got = sorted(tuple(r) for r in extras.pgs_parts(spark, str(tmp_path)).collect())
    red, green, blue = "238 14 14", "134 246 134", "16 15 239"
    want = []
    for cue in [4, 0, 1, 2, 3]:
        want += [(40 + cue % 5, 13, f"{red}, {green}"), (20, 10, f"{blue}, {green}"), (10, 10, f"{red}, {red}")]
    assert got == [("f#0", k, w, h, True, corners) for k, (w, h, corners) in enumerate(want)]


def test_objects_are_kept_until_others_come():
    """A composition without objects shows nothing and keeps the store; one with objects empties it."""
    def composition(*objects):
        return bytes([7, 128, 4, 56, 16, 0, 0, 128, 0, 0, len(objects)]) + b"".join(bytes([0, i, 0, 0, 0, 0, 0, 0]) for i in objects)

    def segment(kind, body):
        return b"PG" + bytes(8) + bytes([kind]) + len(body).to_bytes(2, "big") + body

    # One fragment: id 1, 10 by 8, eight lines of ten pixels of colour 1.
    runs = b"\0\x8a\1\0\0" * 8
    thing = b"\0\1\0\xc0" + (len(runs) + 4).to_bytes(3, "big") + b"\0\x0a\0\x08" + runs
    palette = b"\0\0" + bytes([1, 235, 128, 128, 255])
    start = segment(0x16, composition(1)) + segment(0x14, palette) + segment(0x15, thing) + segment(0x80, b"")
    clear, again = segment(0x16, composition()) + segment(0x80, b""), segment(0x16, composition(1)) + segment(0x80, b"")
    assert [shown is not None for _, shown in pgs.display_sets(start + clear + again)] == [True, False, False]
    broken = segment(0x16, b"\0") + segment(0x80, b"")
    assert [shown is not None for _, shown in pgs.display_sets(start + broken + again)] == [True, False, False]


def test_unreadable_documents_fail_unless_set_apart(spark):
    df = spark.createDataFrame([(1, "1\n00:00:01,000 --> 00:00:02,000\na\n\n2\nx --> 00:00:03,000\nb")], "id int, raw string")
    rows = X.cues(df, X.srt(df.raw), ["id"], strict=False).orderBy("ord").collect()
    assert [(r.ord, r.readable) for r in rows] == [(0, True), (1, False)]
    try:
        X.cues(df, X.srt(df.raw), ["id"]).count()
        raise AssertionError("must fail")
    except Exception as e:
        assert "unreadable timecode" in str(e)


def test_rate_as_text(spark):
    df = spark.createDataFrame([("{24000}{48000}x",)], "raw string")
    got = df.select(X.parse(df.raw, F.lit("a.txt"), F.lit("24000/1001")).alias("c")).first().c
    assert abs(got[0].start - 1001.0) < 1e-9 and abs(got[0].end - 2002.0) < 1e-9

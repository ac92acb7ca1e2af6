"""Queries over caption documents: scans, dispatch, cleaning, SRT output, timecodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuefold.functions import text as T
from cuefold.functions import timecode as C
from cuefold.plans import formats_sql
from cuefold.session import spread, table
from cuefold.sources import formats as X
from cuefold.sources import srt_sink as S

#: Cues of one made-up document, so that no document grows with the data.
CHUNK = 200


def _no_name():
    return F.lit(None).cast("string")


def _docs(spark, sf, source=None):
    d = table(spark, sf, "documents").select("doc_id", "source", "text").where("text is not null")
    return spread(d.where(F.col("source") == source) if source else d)


def _cues(df, parsed, keys=("doc_id",)):
    """All cues, unreadable times as null."""
    return X.cues(df, parsed, list(keys), strict=False).select(*keys, "ord", "start", "end", "text")


def format_sniff(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", X.sniff(F.replace("text", F.lit("\ufeff"), F.lit("")), _no_name()).alias("fmt"))


def scan_srt(spark, sf):
    return _cues(_docs(spark, sf, "disc_srt"), X.srt(F.replace("text", F.lit("\ufeff"), F.lit(""))))


def scan_srt_metrics(spark, sf):
    d = _docs(spark, sf, "disc_srt")
    return d.select("doc_id", F.explode(X.srt_metrics(F.col("text"))).alias("c")).select("doc_id", "c.*")


def scan_vtt(spark, sf):
    return _cues(_docs(spark, sf, "web_vtt"), X.vtt(F.replace("text", F.lit("\ufeff"), F.lit(""))))


def scan_plain_transcript(spark, sf):
    return _cues(_docs(spark, sf, "transcript"), X.transcript(F.col("text")))


def convert_documents(spark, sf):
    """Every document in whatever format it is, to the cues that would be written.

    A document with a time that cannot be read is rejected as a whole and stops no other.
    """
    d = _docs(spark, sf)
    out = X.cues(d, X.parse(F.col("text"), _no_name()), ["doc_id"], strict=False)
    written = (T.strip(F.col("text")) != "") & (F.col("end") > F.col("start"))
    of_written = lambda c: F.when(~F.col("bad"), c)
    return out.groupBy("doc_id").agg(
        F.max(~F.col("readable")).alias("bad"), F.count_if(written).alias("n"),
        F.sum(F.when(written, F.length(T.clean_subtitle_text(F.col("text"))))).alias("c"), F.round(F.sum(F.when(written, F.col("end") - F.col("start"))), 3).alias("s"),
    ).select(
        "doc_id", F.when(F.col("bad"), "rejected: unreadable timecode").otherwise("converted").alias("status"),
        of_written(F.col("n")).alias("cues"), of_written(F.col("c")).alias("chars"), of_written(F.col("s")).alias("seconds"),
    )


def _chunks(spark, sf, line):
    """Documents made of the reference cues of a file, ``line`` per cue, in blocks of cue ids."""
    c = (
        table(spark, sf, "ref_cue").where("start is not null and end is not null and end > start and text is not null")
        .select("cue_id", "file", F.col("start").alias("s"), F.col("end").alias("e"), F.trim(F.regexp_replace("text", r"[\s|{}\[\]<>&\\]+", " ")).alias("t"))
        .where("t <> ''").distinct().withColumn("chunk", F.floor(F.col("cue_id") / CHUNK))
    )
    return (
        c.groupBy("file", "chunk").agg(F.array_sort(F.collect_list(F.struct("cue_id", line.alias("line")))).alias("l"))
        .select("file", "chunk", F.array_join(F.col("l.line"), "\n").alias("body"))
    )


_ms = lambda c: F.round(F.col(c) * 1000).cast("long")
_frame = lambda c: F.round(F.col(c) * 25).cast("long")


def scan_ass(spark, sf):
    t = lambda c: F.format_string("%d:%02d:%02d.%02d", F.floor(_ms(c) / 3600000), F.floor(_ms(c) / 60000) % 60, F.floor(_ms(c) / 1000) % 60, F.floor(_ms(c) / 10) % 100)
    d = _chunks(spark, sf, F.concat(F.lit("Dialogue: 0,"), t("s"), F.lit(","), t("e"), F.lit(",Main,"), F.col("t")))
    raw = F.concat(F.lit("[Script Info]\nTitle: x\n[Events]\nFormat: Layer, Start, End, Style, Text\n"), F.col("body"))
    return _cues(d.select("file", "chunk", raw.alias("raw")), X.ass(F.col("raw")), ("file", "chunk"))


def scan_microdvd(spark, sf):
    d = _chunks(spark, sf, F.concat(F.lit("{"), _frame("s"), F.lit("}{"), _frame("e"), F.lit("}"), F.col("t")))
    raw = F.concat(F.lit("{1}{1}25\n"), F.col("body"), F.lit("\n{1}{1}12.5\n{25}{50}half rate"))
    return _cues(d.select("file", "chunk", raw.alias("raw")), X.microdvd(F.col("raw"), F.lit(C.DEFAULT_FPS)), ("file", "chunk"))


def scan_mpl2(spark, sf):
    tenth = lambda c: F.round(F.col(c) * 10).cast("long")
    d = _chunks(spark, sf, F.concat(F.lit("["), tenth("s"), F.lit("]["), tenth("e"), F.lit("]"), F.col("t"), F.lit("|x")))
    return _cues(d, X.mpl2(F.col("body")), ("file", "chunk"))


def scan_ttml(spark, sf):
    p = F.concat(
        F.lit('<p style="a>b" begin="'), F.floor(_ms("s") / 1000), F.lit('s" dur="'), F.round((F.col("e") - F.col("s")) * 1000).cast("long"),
        F.lit('ms">'), F.col("t"), F.lit("</p>"),
    )
    d = _chunks(spark, sf, p)
    raw = F.concat(F.lit('<tt xmlns="http://www.w3.org/ns/ttml" ttp:frameRate="24"><body>'), F.col("body"), F.lit("</body></tt>"))
    return _cues(d.select("file", "chunk", raw.alias("raw")), X.ttml(F.col("raw"), F.lit(C.DEFAULT_FPS)), ("file", "chunk"))


def scan_ttml_frames(spark, sf):
    """Clock times with frames, at a declared rate with a multiplier."""
    clock = lambda c: F.format_string("%02d:%02d:%02d:%02d", F.floor(_ms(c) / 3600000), F.floor(_ms(c) / 60000) % 60, F.floor(_ms(c) / 1000) % 60, _ms(c) % 24)
    d = _chunks(spark, sf, F.concat(F.lit('<p begin="'), clock("s"), F.lit('" end="'), clock("e"), F.lit('">'), F.col("t"), F.lit("</p>")))
    raw = F.concat(F.lit('<tt xmlns="http://www.w3.org/ns/ttml" ttp:frameRate="24" ttp:frameRateMultiplier="1000 1001"><body>'), F.col("body"), F.lit("</body></tt>"))
    return _cues(d.select("file", "chunk", raw.alias("raw")), X.ttml(F.col("raw"), F.lit(C.DEFAULT_FPS)), ("file", "chunk"))


def scan_sami(spark, sf):
    d = _chunks(spark, sf, F.concat(F.lit("<SYNC Start="), _ms("s"), F.lit("><P Class=X>"), F.col("t")))
    raw = F.concat(F.lit("<SAMI><BODY>\n"), F.col("body"), F.lit("</BODY></SAMI>"))
    return _cues(d.select("file", "chunk", raw.alias("raw")), X.sami(F.col("raw")), ("file", "chunk"))


def scan_stamped_transcript(spark, sf):
    stamp = F.format_string("[%d:%02d.%03d] %s", F.floor(_ms("s") / 60000) % 60, F.floor(_ms("s") / 1000) % 60, _ms("s") % 1000, F.col("t"))
    return _cues(_chunks(spark, sf, stamp), X.transcript(F.col("body")), ("file", "chunk"))


def srt_render(spark, sf):
    """SRT documents of the converted cues, one per file and block of 1,000 cues."""
    c = table(spark, sf, "cue").distinct().withColumn("part", F.floor(F.col("ord") / 1000))
    out = S.srt_bodies(c, ["file", "part"], "ord")
    return out.select(
        "file", "part", "cues", F.sha2(S.srt_document(F.col("body")), 256).alias("sha"), S.cue_count(F.col("body")).alias("arrows"),
        S.output_name(F.concat("file", F.lit(".srt"))).alias("name"),
    )


def srt_roundtrip(spark, sf):
    """What the metrics scan reads from the documents just written."""
    c = table(spark, sf, "cue").distinct().withColumn("part", F.floor(F.col("ord") / 1000))
    out = S.srt_bodies(c, ["file", "part"], "ord").select("file", "part", S.srt_document(F.col("body")).alias("d"))
    return (
        out.select("file", "part", F.explode(X.srt_metrics(F.col("d"))).alias("c"))
        .select("file", "part", "c.number", "c.start", "c.end", F.col("c.timing"))
    )


def timecode_format(spark, sf):
    li = table(spark, sf, "lineitem")
    s = F.col("l_extendedprice")
    stamp = F.col("stamp")
    return spread(li.select("l_orderkey", "l_linenumber", "l_extendedprice")).withColumn("stamp", C.srt_time(s)).select(
        "l_orderkey", "l_linenumber", "stamp", C.parse_timecode(stamp).alias("back"), C.parse_srt_time(stamp).alias("strict"), C.filename_time(s).alias("file_time"),
        C.ttml_time(F.concat(F.floor(s), F.lit("f")), F.lit(25.0)).alias("frames"), C.minutes_seconds(s * 1000).alias("took"),
    )


def timing_parse(spark, sf):
    """Start and end read again from the timing lines of the cue tables."""
    r = table(spark, sf, "ref_cue").unionByName(table(spark, sf, "cand_cue")).where("timing is not null").select("cue_id", "timing").distinct()
    part = F.split("timing", "-->", -1)
    return r.select(
        "cue_id", C.parse_timecode(F.get(part, F.lit(0))).alias("start"),
        C.parse_timecode(F.regexp_extract(T.strip(F.get(part, F.lit(1))), r"\A(\S*)", 1)).alias("end"),
    )


def clean_markup(spark, sf):
    c = table(spark, sf, "cue").where("text is not null").select("file", "ord", "text").distinct()
    return c.select("file", "ord", T.clean_subtitle_text(F.col("text")).alias("clean"), T.decode_entities(F.col("text")).alias("decoded"))


def clean_ocr(spark, sf):
    o = table(spark, sf, "ocr_result").where("text is not null").select("ocr_id", "text").distinct()
    return o.select("ocr_id", T.clean_ocr_text(F.col("text")).alias("clean"))


def clean_ocr_fitted(spark, sf):
    o = table(spark, sf, "ocr_result").where("text is not null").select("ocr_id", "text").distinct()
    return o.select("ocr_id", T.clean_ocr_text(F.col("text"), "fitted").alias("clean"))


def text_health(spark, sf):
    o = table(spark, sf, "ocr_result").select("ocr_id", "text").distinct()
    return o.select("ocr_id", T.text_health(F.col("text")).alias("health"))


def names(spark, sf):
    """Safe, upload and unique names and paths of the parts."""
    p = table(spark, sf, "part")
    raw = F.concat(F.lit('" /in box/'), F.col("p_name"), F.lit("#"), F.col("p_brand"), F.lit('.sup"'))
    return p.select(
        "p_partkey", T.safe_name(raw).alias("safe"), T.safe_upload_name(raw).alias("upload"), T.local_path(raw).alias("path"),
        T.first_useful_line(F.concat(F.lit("\n\n  "), F.col("p_name"), F.lit(" \nx"))).alias("first_line"),
        T.below_version(F.concat(F.lit("tool v"), F.col("p_size"), F.lit(".3")), "25.3.1").alias("old"),
        T.last_meaningful_line(F.concat(F.col("p_name"), F.lit("\n at x\n\n"))).alias("last_line"),
    )


QUERIES = {f.__name__: f for f in (
    format_sniff, scan_srt, scan_srt_metrics, scan_vtt, scan_plain_transcript, convert_documents, scan_ass, scan_microdvd, scan_mpl2,
    scan_ttml, scan_ttml_frames, scan_sami, scan_stamped_transcript, srt_render, srt_roundtrip, timecode_format, timing_parse, clean_markup, clean_ocr,
    clean_ocr_fitted, text_health, names,
)}
ORACLE = formats_sql.ORACLE

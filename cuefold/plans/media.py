"""Queries over frames, tracks, readings, caches, histograms, streams of bytes and events."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from cuefold.functions import text as T
from cuefold.functions.binding import let
from cuefold.operators import compare as M
from cuefold.operators import blocked, histogram, inspection, recognition, reuse, timing, tracks
from cuefold.plans import media_sql
from cuefold.session import ensure_checkpoint_dir, table
from cuefold.sources import pgs, png, report
from cuefold.streaming import progress

IMAGE = ["file", "track_id", "ord"]
ENGINE, REVISION = "engine-2", 3


def _frames(spark, sf):
    """Events as frames: a file per user, times of whole hours, so that many are equal."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("file"), F.col("event_id").alias("ord"), F.unix_millis(F.date_trunc("hour", F.col("ts").cast("timestamp"))).alias("pts"), "event_type", "value"
    )


def next_later_pts(spark, sf):
    return timing.next_later(_frames(spark, sf).select("file", "ord", "pts"))


def display_end(spark, sf):
    return timing.display_ends(_frames(spark, sf), F.col("event_type") != "view").select("file", "ord", "pts", "end_ms")


def timing_fallback(spark, sf):
    s = F.col("pts") / 1000
    f = _frames(spark, sf).select("file", "ord", F.when(F.col("event_type") != "error", s).alias("pts"), F.when(F.col("event_type") == "purchase", s + 1.5).alias("end_pts"))
    return timing.fallback_timing(f).select("file", "ord", "start_s", "end_s")


def frame_numbers(spark, sf):
    """Frames numbered within their file, with the last error value before each (running state)."""
    f = blocked.numbered(_frames(spark, sf), ["file"], F.floor(F.col("ord") / timing.BLOCK), ["ord"], "number")
    f = blocked.carry(f, ["file"], F.floor(F.col("ord") / timing.BLOCK), ["ord"], F.when(F.col("event_type") == "error", F.col("value")), "rate")
    return f.select("file", "ord", "number", "rate")


def output_status(spark, sf):
    """Per track whether its frames give an output, an empty one or an error."""
    o = table(spark, sf, "ocr_result").select(*IMAGE, "ocr_id", "text").distinct()
    seen = o.groupBy("file", "track_id").agg(F.count_distinct("ord").alias("found"), F.count_if(T.strip(F.coalesce("text", F.lit(""))) != "").alias("visible"))
    t = table(spark, sf, "track").select("file", "track_id", "codec", "forced_track").distinct().join(seen, ["file", "track_id"], "left").fillna(0, ["found", "visible"])
    kind = F.when(tracks.subtitle_format(F.col("codec")) == "sup", "sup").otherwise("sub")
    return t.select("file", "track_id", "found", "visible", timing.output_status(kind, F.col("found"), F.col("visible"), F.col("forced_track")).alias("status"))


def _hashed(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.sha1("text").alias("sha1"))


def dedup_first(spark, sf):
    return reuse.first_of_equals(_hashed(spark, sf), ["sha1"], "doc_id")


def dedup_fanout(spark, sf):
    """The expensive work (here a health score) once per text, fanned out to all documents."""
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", F.sha1("text").alias("sha1"), "text")
    once = d.groupBy("sha1").agg(F.min("doc_id").alias("representative"), F.first("text").alias("text"))
    read = once.select("sha1", "representative", T.text_health(F.col("text")).alias("health"))
    return reuse.fan_out(d.select("doc_id", "sha1"), read, ["sha1"]).select("doc_id", "representative", "health")


def _tracks(spark, sf):
    return table(spark, sf, "track").distinct()


def mkv_tracks(spark, sf):
    """Tracks read from the JSON description of each container."""
    t = _tracks(spark, sf).select("file", "track_id", F.struct(
        F.col("track_id").alias("id"), F.lit("subtitles").alias("type"), F.lit("VobSub").alias("codec"),
        F.struct(F.col("codec").alias("codec_id"), F.col("language_code").alias("language"), "language_ietf", "forced_track", "default_track").alias("properties"),
    ).alias("t"))
    audio = F.from_json(F.lit('{"id":99,"type":"audio","codec":"A_AAC"}'), "id int, type string, codec string, properties struct<codec_id:string,language:string,language_ietf:string,forced_track:boolean,default_track:boolean>")
    info = t.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("track_id", "t"))).alias("l"))
    info = info.select("file", F.to_json(F.struct(F.array_append(F.col("l.t"), audio).alias("tracks"))).alias("info"))
    return tracks.parse_tracks(info, "info", "file")


def track_select(spark, sf):
    t = _tracks(spark, sf)
    langs = ["fre", "de"]
    return t.where(tracks.wanted(langs, F.col("language_code"), F.col("language_ietf"))).select("file", "track_id", tracks.language_label(F.col("language_code")).alias("language"))


def _plan(spark, sf):
    t = _tracks(spark, sf).withColumn("language_code", F.coalesce("language_code", F.lit("und")))
    return tracks.extract_plan(t, "/out")


def extract_plan(spark, sf):
    return _plan(spark, sf).select("file", "track_id", "output", "spec", F.size("outputs").alias("n_outputs"))


def plan_clashes(spark, sf):
    return tracks.clashes(_plan(spark, sf))


def skip_existing(spark, sf):
    """Tracks still to extract: some output of theirs is not there; those with blank readings lost their index file."""
    plan = _plan(spark, sf)
    blank = table(spark, sf, "ocr_result").where("text is null or trim(text) = ''").select("file", "track_id").distinct().withColumn("lost", F.lit(True))
    there = plan.join(blank, ["file", "track_id"], "left").select(F.explode("outputs").alias("path"), "lost").where("lost is null or not endswith(path, '.idx')")
    return tracks.without_outputs(plan, there).select("file", "track_id", "output")


def pair_idx_sub(spark, sf):
    plan = _plan(spark, sf)
    files = plan.select(F.explode("outputs").alias("path"), "forced_track").where("not (forced_track and endswith(path, '.idx'))")
    return tracks.pair_idx_sub(files.select("path"))


def language_groups(spark, sf):
    """Per language its tracks, in order of first appearance."""
    t = _tracks(spark, sf)
    g = t.groupBy(F.coalesce("language_code", F.lit("und")).alias("language_code")).agg(F.count("*").alias("tracks"), F.min(F.struct("file", "index")).alias("first"), F.count_distinct("file").alias("files"))
    # One row per language code.
    return g.select("language_code", "tracks", "files", F.row_number().over(Window.orderBy("first", "language_code")).alias("place"))


def cache_lookup(spark, sf):
    """Texts asked for against a cache that holds the ones with a known language."""
    d = table(spark, sf, "documents").where("text is not null")
    asked = d.select("doc_id", reuse.cache_key(F.col("text"), F.lit("generic"), F.lit(None)).alias("cache_key"))
    e = d.where("lang is not null").groupBy(reuse.cache_key(F.col("text"), F.lit("generic"), F.lit(None)).alias("cache_key")).agg(F.min(F.struct("doc_id", "lang", "source", "file")).alias("m"))
    entries = e.select(
        "cache_key", F.when(F.col("m.lang") == "en", ENGINE).when(F.col("m.lang") == "fr", F.lit(None)).when(F.col("m.lang") == "de", "absent").otherwise("engine-1").alias("engine_version"),
        F.when(F.col("m.source") == "qc_report", 2).otherwise(REVISION).alias("output_revision"), (F.coalesce("m.source", F.lit("")) != "forum_note").alias("vision_available"),
        F.when(F.col("m.file").isNotNull(), F.concat(F.lit("srt of "), F.col("m.doc_id").cast("string"))).alias("srt"),
    )
    return reuse.cache_lookup(asked, entries, ENGINE, REVISION, True).select("doc_id", "outcome", "srt")


def cache_store(spark, sf):
    """Entries per language after the documents of one source were done again."""
    d = table(spark, sf, "documents").where("text is not null").select(F.sha2("text", 256).alias("cache_key"), "source", F.lit("old").alias("srt"))
    entries = d.groupBy("cache_key").agg(F.max("source").alias("source"), F.first("srt").alias("srt"))
    fresh = entries.where("source = 'transcript'").withColumn("srt", F.lit("new"))
    return reuse.cache_store(entries, fresh).groupBy("srt").agg(F.count("*").alias("entries"), F.count_distinct("cache_key").alias("different"))


def queue_upsert(spark, sf):
    c = table(spark, sf, "customer")
    queue = c.where("c_acctbal >= 0").select("c_custkey", F.col("c_nationkey").alias("language"), F.lit("old").alias("handle"), F.lit(False).alias("selected"))
    incoming = c.where("c_mktsegment in ('BUILDING', 'MACHINERY')").select("c_custkey", F.lit(-1).alias("language"), F.col("c_name").alias("handle"))
    return reuse.upsert(queue, incoming, "c_custkey", ["language"], ["handle"])


def _images(spark, sf):
    """Images of each track with their place and the readings of two engines."""
    o = table(spark, sf, "ocr_result").select(*IMAGE, "ocr_id", "text", "confidence", "engine").distinct()
    pick = lambda e, c: F.max_by(c, F.when(F.col("engine") == e, F.col("ocr_id")))
    return o.groupBy(*IMAGE).agg(
        pick("tesseract-fast", "text").alias("d_text"), pick("tesseract-fast", "confidence").alias("d_conf"), pick("vision-accurate", "text").alias("c_text")
    )


def _sampled(spark, sf, count):
    i = blocked.numbered(_images(spark, sf), ["file", "track_id"], F.floor(F.col("ord") / timing.BLOCK), ["ord"], "number")
    n = i.groupBy("file", "track_id").agg(F.count("*").alias("total"))
    i = i.join(n, ["file", "track_id"]).withColumn("number", F.col("number") - 1)
    return reuse.even_sample(i, "number", "total", count)


def even_sample(spark, sf):
    return _sampled(spark, sf, 7).select(*IMAGE, "number")


def engine_probe(spark, sf):
    return recognition.probe(_sampled(spark, sf, recognition.PROBE_SAMPLE), ["file", "track_id"])


def _readings(spark, sf):
    return table(spark, sf, "ocr_result").select(*IMAGE, F.col("ocr_id").alias("id"), "text", "confidence", "variant").distinct()


def candidate_select(spark, sf):
    return recognition.choose_reading(_readings(spark, sf), IMAGE).select(*IMAGE, "readings", "id", "variant")


def candidate_select_hybrid(spark, sf):
    """As candidate_select in hybrid mode, an image's height made of its number."""
    readings = _readings(spark, sf).withColumn("height", F.pmod("ord", F.lit(7)) * 30)
    return recognition.choose_reading(readings, IMAGE, "hybrid", "height").select(*IMAGE, "readings", "id", "variant")


def reading_flags(spark, sf):
    t, c = F.col("text"), F.col("confidence")
    return _readings(spark, sf).select(
        "id", F.round(recognition.score(t, c), 6).alias("score"), recognition.usable(t, c).alias("usable"), recognition.precise_line(t, c).alias("precise"),
        recognition.dilated_usable(t, c).alias("dilated"), F.coalesce(recognition.weak(t, F.col("variant"), F.length("variant") * 20), F.lit(False)).alias("weak"),
    )


def line_regroup(spark, sf):
    """Texts as word tables and back; every second line has the same key, so keys return."""
    r = _readings(spark, sf).where("text is not null")
    lines = F.split("text", "\n", -1)
    words = F.flatten(F.transform(lines, lambda l, i: F.transform(F.filter(F.split(l, " ", -1), lambda w: w != ""), lambda w: F.concat(
        F.lit("5\t1\t1\t1\t"), (i % 2).cast("string"), F.lit("\t1\t0\t0\t0\t0\t"), (F.length(w) * 10 - 10).cast("string"), F.lit("\t"), w))))
    tsv = F.array_join(F.concat(F.array(F.lit("level\tpage_num")), words), "\r\n")
    parsed = recognition.parse_words(tsv)
    return r.select("id", F.round(recognition.mean_confidence(parsed), 6).alias("confidence"), recognition.regroup_lines(parsed).alias("text"), F.size(parsed).alias("words"))


def command_output(spark, sf):
    """Outputs of a recogniser, JSON for some engines and plain for others."""
    o = table(spark, sf, "ocr_result").select("ocr_id", "text", "confidence", "engine").where("text is not null").distinct()
    out = F.when(F.col("engine") == "vision-accurate", F.to_json(F.struct("text", F.col("confidence").cast("string").alias("confidence")))).otherwise(F.col("text"))
    return o.select("ocr_id", recognition.parse_command_output(out).alias("r")).select("ocr_id", "r.text", "r.confidence")


def batch_defaults(spark, sf):
    """Every image with the result of one engine, blank with a warning where it has none."""
    o = table(spark, sf, "ocr_result").select(*IMAGE, "ocr_id", "text", "engine", "warnings").distinct()
    results = o.where("engine = 'vision-accurate'").groupBy(*IMAGE).agg(F.max_by(F.struct("text", "warnings"), "ocr_id").alias("r"))
    out = o.select(*IMAGE).distinct().join(results, IMAGE, "left")
    return out.select(
        *IMAGE, F.coalesce("r.text", F.lit("")).alias("text"),
        F.array_join(F.when(F.col("r").isNull(), F.array(F.lit("vision-missing-result"))).otherwise(F.col("r.warnings")), ";").alias("warnings"),
    )


def engine_failures(spark, sf):
    """Tracks whose images all failed in one engine would stop; blank readings don't count as failed."""
    b = batch_defaults(spark, sf).withColumn("failed", recognition.engine_failed(F.split("warnings", ";")))
    return b.groupBy("file", "track_id").agg(F.count_if("failed").alias("failed"), F.count("*").alias("images"), F.every("failed").alias("all_failed"))


def histogram256(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "x"))
    g = e.select("vec_id", F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("x").cast("double") + 0.5) * 255))).alias("g"))
    h = histogram.histogram(g, "vec_id", "g")
    return h.select("vec_id", "total", F.round("mean", 9).alias("mean"), F.round("deviation", 9).alias("deviation"), (F.array_position("bins", F.array_max("bins")) - 1).alias("mode"))


def repair_decisions(spark, sf):
    """Which repairs glyph images of made-up tones would get, one image per customer."""
    o = table(spark, sf, "customer").select("c_custkey", F.floor(F.abs("c_acctbal") * 37).cast("long").alias("v"))
    tone = lambda name, lo, hi, mass: F.struct((F.col("v") % (hi - lo) + lo).cast("int").alias("g"), (F.floor(F.col("v") / mass) % 900).cast("long").alias("n"))
    parts = F.array(tone("dark", 0, 127, 7), tone("light", 128, 250, 11), F.struct(F.lit(255).alias("g"), (F.col("v") % 3000).cast("long").alias("n")), F.struct(F.lit(8).alias("g"), (F.col("v") % 41 * 50).cast("long").alias("n")))
    bins = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda g: F.aggregate(F.filter(parts, lambda p: p["g"] == g), F.lit(0).cast("long"), lambda a, p: a + p["n"]))
    add = lambda h: F.aggregate(h, F.lit(0).cast("long"), lambda a, x: a + x)
    decided = let(bins, lambda h: let(add(h), lambda n: F.struct(
        histogram.shadow_strip(h, n).alias("strip"), histogram.fill_threshold(h, n).alias("fill"), histogram.hollow_fill(h, n).alias("hollow"))))
    return o.select("c_custkey", decided.alias("d")).select("c_custkey", "d.strip.low", "d.strip.high", "d.fill", "d.hollow")


def reading_order(spark, sf):
    """The boxes of each vector, two values a box, in reading order."""
    e = table(spark, sf, "embeddings")
    box = lambda i: F.struct(F.get("embedding", i * 2).cast("double").alias("y"), F.get("embedding", i * 2 + 1).cast("double").alias("x"), i.cast("int").alias("id"))
    # A vector of fewer than two values has no box; sequence() would count down.
    boxes = F.filter(F.sequence(F.lit(0), F.floor(F.size("embedding") / 2).cast("int")), lambda i: i < F.floor(F.size("embedding") / 2))
    return e.select("vec_id", F.array_join(F.transform(report.reading_order(F.transform(boxes, box)), lambda i: i.cast("string")), ",").alias("ids"))


def listing_pairs(spark, sf):
    """Streams of the reference files with their reference and candidate files."""
    name = lambda t, suffix: table(spark, sf, t).select(F.concat("file", F.lit(suffix)).alias("name")).distinct()
    return report.pair_listing(name("cue", ".sup"), name("ref_cue", "-eng.srt"), name("cand_cue", ".srt").unionByName(name("track", "-eng.srt")))


def fixture_gaps(spark, sf):
    """Gaps declared in JSON metadata, one document per file, read back by group and name."""
    r = table(spark, sf, "ref_cue").where("start is not null and startswith(text, '[')").select("file", "cue_id", "start").distinct()
    doc = F.concat(F.lit('{"set":{"'), F.col("file"), F.lit('":{"status":"partial","knownReferenceGaps":[{"start":'), F.col("start"), F.lit(',"end":'), F.col("start") + 1, F.lit("}]}}}"))
    found = report.fixture_metadata(doc, F.lit("a\\b/set"), F.col("file"))
    return r.select("cue_id", found["status"].alias("status"), found["knownReferenceGaps"][0]["start"].alias("start"), report.fixture_metadata(doc, F.lit("other"), F.col("file")).isNull().alias("elsewhere"))


def csv_report(spark, sf):
    c = table(spark, sf, "cue").select("file", "ord", "text", "start").distinct()
    return c.select("file", "ord", report.csv_line(F.col("ord"), F.col("text"), F.lit(None), F.col("file")).alias("line"))


def json_report(spark, sf):
    """Readings written as JSON lines and read again as detail rows."""
    o = table(spark, sf, "ocr_result").select("ocr_id", "text", "confidence").distinct()
    docs = o.select(F.to_json(F.struct(F.array(F.struct("ocr_id", "text", "confidence")).alias("rows"))).alias("d"))
    return report.detail_rows(docs, "d", "struct<ocr_id:bigint,text:string,confidence:double>")


def _missing(spark, sf):
    ref, cand = M.tracked(table(spark, sf, "ref_cue")), M.tracked(table(spark, sf, "cand_cue"))
    return M.pairing(ref, cand), cand


def inspection_manifest(spark, sf):
    """Missing references with the image to look at: the last candidate that starts when they do."""
    paired, cand = _missing(spark, sf)
    targets = inspection.targets(paired, "missing").withColumn("stream", report.stream_path(F.col("file"), F.lit(None), "/set"))
    images = cand.select("file", F.floor("start").alias("at"), F.col("ord"), F.col("id").alias("image"))
    out = inspection.with_images(targets.withColumn("at", F.floor("start")), images, ["file", "at"])
    return out.select("file", "ref_id", "start", "image", "stream", inspection.manifest_line(F.col("file"), F.col("start"), F.col("image")).alias("line"))


def inspection_limits(spark, sf):
    """Missing references within a budget of 100 that is used up file by file."""
    paired, _ = _missing(spark, sf)
    return inspection.within_budget(inspection.targets(paired, "missing"), 100).select("file", "ref_id")


def unique_names(spark, sf):
    """Names of uploads, later ones of the same name numbered."""
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.regexp_replace("p_name", " ", "_"), F.lit(".srt")).alias("name"))
    return inspection.unique_names(p, "name", "p_partkey").select("p_partkey", "unique")


def batch_outcomes(spark, sf):
    """Counters of a batch over containers: tracks planned, done before, failed."""
    t = _tracks(spark, sf)
    seen = table(spark, sf, "ocr_result").select("file", "track_id").distinct().withColumn("read", F.lit(True))
    j = t.join(seen, ["file", "track_id"], "left")
    return j.groupBy("file").agg(
        F.count("*").alias("tracks"), F.count_if(F.col("read")).alias("extracted"), F.count_if(F.col("read").isNull()).alias("failures"),
        F.array_join(F.array_sort(F.collect_set(F.coalesce("language_code", F.lit("und")))), ",").alias("languages"),
    )


def pgs_decode(spark, sf):
    """Reference cues written as bitmap streams and decoded: times, sizes, usability and end of each set."""
    c = (
        table(spark, sf, "ref_cue").where("start is not null and end is not null and end > start").select("file", "cue_id", "start", "end").distinct()
        .withColumn("chunk", F.floor(F.col("cue_id") / 100))
    )

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        out = b""
        for row in pdf.sort_values(["start", "cue_id"]).itertuples():
            shape = np.zeros((8 + row.cue_id % 5, 30 + row.cue_id % 7), np.uint8)
            shape[1:-1, 2:-3] = 1
            out += pgs.encode_set(row.start, shape, cropped=bool(row.cue_id % 2)) + pgs.encode_set(row.end, None)
        return pd.DataFrame({"file": [f"{pdf.file.iloc[0]}#{pdf.chunk.iloc[0]}"], "content": [out]})

    # As many tasks as cores: rows are few, but pixels are many.
    c = c.repartition(2 * spark.sparkContext.defaultParallelism, "file", "chunk")
    streams = c.groupBy("file", "chunk").applyInPandas(write, "file string, content binary")
    return pgs.scan(streams, with_png=False).select("file", "ord", "pts", "content_width", "content_height", "usable")


def png_roundtrip(spark, sf):
    """Embeddings as 8 x 8 gray images, encoded and decoded."""

    @F.pandas_udf("boolean")
    def same(v: pd.Series) -> pd.Series:
        out = []
        for x in v:
            image = np.repeat(((np.asarray(x[:64]) + 0.6) * 200).clip(0, 255).astype(np.uint8).reshape(8, 8, 1), 3, 2)
            out.append(bool((png.decode(png.encode(image)) == image).all()))
        return pd.Series(out)

    return table(spark, sf, "embeddings").select("vec_id", same("embedding").alias("same"))


def _event_lines(events):
    kind = F.when(F.col("event_type") == "signup", "started").when(F.col("event_type") == "purchase", "finished").when(F.col("event_type") == "error", "failed").otherwise(F.lit(None))
    line = progress.format_event(kind, F.col("ts").cast("timestamp"), job=F.col("user_id").cast("string"), output=F.col("props"), duration_ms=F.col("value"))
    return events.select(F.when(F.col("event_type") == "click", "not json").otherwise(line).alias("value"))


_PROGRESS = ["job", "started", "finished", "failed", "has_failed"]


def job_progress(spark, sf):
    p = progress.job_progress(progress.parse_events(_event_lines(table(spark, sf, "events"))))
    return p.select(*_PROGRESS, F.round("duration_ms", 3).alias("duration_ms"))


def _streamed(spark, sf, operator):
    """``operator`` of the events from a stream, run until all that is there was read; its state is kept in the shared folder."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/progress-{uuid.uuid4().hex}"
    events = table(spark, sf, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events*.parquet")
    p = operator(progress.parse_events(_event_lines(stream)))

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{base}/out")

    q = p.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(p.schema).parquet(f"{base}/out")


def job_progress_stream(spark, sf):
    """The same from a stream."""
    return _streamed(spark, sf, progress.job_progress).select(*_PROGRESS, F.round("duration_ms", 3).alias("duration_ms"))


def _outputs(outputs):
    return progress.in_order(outputs).select("job", "position", "output", F.unix_millis("first_finished").alias("first_ms"))


def job_outputs(spark, sf):
    """The distinct outputs of each job's finished events, in order of first finish."""
    return _outputs(progress.job_outputs(progress.parse_events(_event_lines(table(spark, sf, "events")))))


def job_outputs_stream(spark, sf):
    """The same from a stream."""
    return _outputs(_streamed(spark, sf, progress.job_outputs))


QUERIES = {f.__name__: f for f in (
    next_later_pts, display_end, timing_fallback, frame_numbers, output_status, dedup_first, dedup_fanout, mkv_tracks, track_select, extract_plan,
    plan_clashes, skip_existing, pair_idx_sub, language_groups, cache_lookup, cache_store, queue_upsert, even_sample, engine_probe, candidate_select, candidate_select_hybrid,
    reading_flags, line_regroup, command_output, batch_defaults, engine_failures, histogram256, repair_decisions, reading_order, listing_pairs,
    fixture_gaps, csv_report, json_report, inspection_manifest, inspection_limits, unique_names, batch_outcomes, pgs_decode, png_roundtrip, job_progress, job_progress_stream,
    job_outputs, job_outputs_stream,
)}
ORACLE = media_sql.ORACLE

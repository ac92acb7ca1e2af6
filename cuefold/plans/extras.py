"""Queries of small operators: output names, bitmap streams in parts, progress frames, orders and summaries."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cache, lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from cuefold.functions import timecode as C
from cuefold.operators import summary, tracks
from cuefold.plans import media, scoring_sql
from cuefold.plans.scoring import benchmark_summary
from cuefold.session import table
from cuefold.sources import images, pgs, png, report
from cuefold.sources import srt_sink as S
from cuefold.streaming import progress


def language_lists(spark, sf):
    """Lists of codes as a user would type them, one per track."""
    t = table(spark, sf, "track").select("file", "track_id", "language_code", "language_ietf").distinct()
    typed = F.concat(F.lit(" "), F.upper(F.coalesce("language_code", F.lit(""))), F.lit(" ,, "), F.coalesce("language_ietf", F.lit("")))
    return t.select("file", "track_id", F.array_join(tracks.parse_languages(typed), "|").alias("languages")).distinct()


def ocr_srt(spark, sf):
    """Readings of one engine written as they are, three seconds each, one document per track."""
    o = table(spark, sf, "ocr_result").where("engine = 'vision-accurate' and ord is not null").select("file", "track_id", "ord", "ocr_id", "text").distinct()
    best = o.groupBy("file", "track_id", "ord").agg(F.max_by("text", "ocr_id").alias("text"))
    cues = best.select("file", "track_id", "ord", (F.col("ord") * 4.0).alias("start"), (F.col("ord") * 4.0 + 3.0).alias("end"), "text")
    out = S.srt_bodies(cues, ["file", "track_id"], "ord", recognised=True)
    path = F.concat(F.lit("/in/"), F.col("file"), F.lit(".SUP"))
    null = F.lit(None).cast("string")
    return out.select(
        "file", "track_id", "cues", F.sha2("body", 256).alias("sha"), S.recognised_name(path, F.lit("eng"), null, null).alias("beside"),
        S.recognised_name(path, F.lit("eng"), F.lit("/out"), F.lit("x.srt")).alias("in_folder"), S.recognised_name(path, F.lit("eng"), null, F.lit("x.srt")).alias("named"),
    )


def required_times(spark, sf):
    """Start times that must be readable, from the timing lines of cues that have one."""
    r = table(spark, sf, "ref_cue").where("start is not null").select("cue_id", "timing").distinct()
    return r.select("cue_id", C.require_timecode(F.get(F.split("timing", "-->", -1), F.lit(0)), "cue").alias("start"))


def frame_rates(spark, sf):
    """Frame rates as fractions, decimals, blanks and nothing."""
    p = table(spark, sf, "part").select("p_partkey", "p_size")
    kind = F.col("p_partkey") % 4
    typed = F.when(kind == 0, F.concat("p_size", F.lit("000 / 1001"))).when(kind == 1, F.concat("p_size", F.lit(".5"))).when(kind == 2, F.lit(""))
    return p.select("p_partkey", F.round(C.parse_fps(typed), 6).alias("fps"))


class Cue(NamedTuple):
    cue_id: int
    start: float
    end: float


def _streams(spark, sf, write):
    """Streams of up to 100 reference cues each, written by ``write(cue) -> bytes``."""
    c = (
        table(spark, sf, "ref_cue").where("start is not null and end is not null and end > start")
        .select("file", F.floor(F.col("cue_id") / 100).alias("chunk"), "cue_id", "start", "end")
        # Rows are few, but pixels are many.  Repeated rows have one chunk, so this is the only exchange.
        .repartition(2 * spark.sparkContext.defaultParallelism, "file", "chunk").distinct()
        .sortWithinPartitions("file", "chunk", "start", "cue_id", "end")
    )

    def batch(streams: list[tuple]) -> pa.RecordBatch:
        names, contents = zip(*streams, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], ["file", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, done, held = None, [], [], 0
        for b in batches:
            file, chunk, *cue = (b.column(n).to_pylist() for n in ("file", "chunk", "cue_id", "start", "end"))
            for key, row in zip(zip(file, chunk, strict=True), map(Cue, *cue), strict=True):
                if key != now:
                    if out:
                        done.append((f"{now[0]}#{now[1]}", b"".join(out)))
                        held += len(done[-1][1])
                    now, out = key, []
                    if held >= pgs.BATCH_BYTES:
                        yield batch(done)
                        done, held = [], 0
                out.append(write(row))
        if out:
            done.append((f"{now[0]}#{now[1]}", b"".join(out)))
        if done:
            yield batch(done)

    return c.mapInArrow(run, "file string, content binary")


def _shown(row) -> bytes:
    """A bar, usable for four of five cues, and the clear after it."""
    shape = np.zeros((8 + row.cue_id % 5, 30 + row.cue_id % 7), np.uint8)
    shape[1:-1, 2:-3] = 1
    return pgs.encode_set(row.start, shape) + pgs.encode_set(row.end, None)


def pgs_counts(spark, sf):
    """Display sets of streams whose last bytes are cut off."""
    cut_off = _streams(spark, sf, _shown).withColumn("content", F.expr("substring(content, 1, length(content) - 3)"))
    return pgs.count_sets(cut_off)


def pgs_preview(spark, sf):
    """The first three usable images of each stream and when they end."""
    return pgs.preview(_streams(spark, sf, _shown), 3).select("file", "number", "pts", "end_pts", "width", "height")


# Colours of the streams in parts: luma, red and blue difference, opacity.
RED, GREEN, BLUE = (81, 240, 90, 255), (145, 34, 54, 128), (41, 110, 240, 255)


@cache
def _sets(k: int) -> tuple[list[bytes], ...]:
    """Three sets, byte by byte: an object in two fragments beside another one, a palette update, a palette of its own; segments from the byte behind their time."""
    two = b"".join(b"\0\x8a\1\0\x8a\2\0\0" for _ in range(10))
    one = b"".join(b"\0\x8a\2\0\0" for _ in range(8))
    segment = lambda kind, body: struct.pack(">IBH", 0, kind, len(body)) + body
    screen = lambda flag, *objects: segment(0x16, struct.pack(">HHBHBBB", 1920, 1080, 16, 0, 0x80, flag, 0) + bytes([len(objects)]) + b"".join(struct.pack(">HBBHH", i, 0, 0, x, y) for i, x, y in objects))
    first = lambda i, flags, w, h, data, size: segment(0x15, struct.pack(">HBB", i, 0, flags) + (size + 4).to_bytes(3, "big") + struct.pack(">HH", w, h) + data)
    colours = lambda *entries: segment(0x14, b"\0\0" + b"".join(bytes([n, *c]) for n, c in entries))
    whole, end = first(7, 0xC0, 20, 10, two, len(two)), segment(0x80, b"")
    return (
        [
            screen(0, (7, 100, 800), (9, 130 + k, 805)), colours((1, RED), (2, GREEN)), first(7, 0x80, 20, 10, two[:13], len(two)),
            segment(0x15, struct.pack(">HBB", 7, 0, 0x40) + two[13:]), first(9, 0xC0, 10, 8, one, len(one)), first(8, 0x80, 5, 5, one, len(one)), end,
        ],
        [screen(0x80, (7, 10, 20)), colours((1, BLUE)), whole, end],
        [screen(0, (7, 10, 20), (9, 50, 20)), colours((1, RED)), whole, end],
    )


def _parts(row) -> bytes:
    """The three sets of a cue, a quarter second apart."""
    out = []
    for n, segments in enumerate(_sets(row.cue_id % 5)):
        # The clock of a stream has 32 bits and starts again every 13 hours; the images don't depend on it.
        head = b"PG" + (int((row.start + n / 4) * 90_000 + 0.5) & 0xFFFFFFFF).to_bytes(4, "big")
        out += [head, head.join(segments)]
    return b"".join(out)


@lru_cache(pgs.REMEMBERED)
def _corner(coded: bytes) -> str:
    image = png.decode(coded)
    at = lambda k: " ".join(str(int(v)) for v in image[k, k])
    return at(pgs.PADDING) + ", " + at(-1 - pgs.PADDING)


def _corners(coded: pd.Series) -> pd.Series:
    """First and last pixel inside the padding."""
    return coded.map(lambda b: None if b is None else _corner(bytes(b)))


def pgs_parts(spark, sf):
    """Streams written byte by byte: fragments, two objects, an object never completed, palettes kept and replaced."""
    found = pgs.scan(_streams(spark, sf, _parts))
    return found.select("file", "ord", "content_width", "content_height", "usable", F.pandas_udf(_corners, "string")("png").alias("corners"))


def blank_frames(spark, sf):
    """Embeddings as gray images, every fifth one without any contrast."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")

    @F.pandas_udf("boolean")
    def blank(ident: pd.Series, v: pd.Series) -> pd.Series:
        gray = lambda i, x: np.full((8, 8), 7, np.uint8) if i % 5 == 0 else ((np.asarray(x[:64]) + 0.6) * 200).clip(0, 255).astype(np.uint8).reshape(8, 8)
        return pd.Series([images.is_blank(gray(i, x)) for i, x in zip(ident, v, strict=True)])

    return e.select("vec_id", blank("vec_id", "embedding").alias("blank"))


def progress_frames(spark, sf):
    """Events written as frames of a server-sent stream and read again, by type."""
    lines = media._event_lines(table(spark, sf, "events"))
    frames = lines.select(progress.sse_frame(F.col("value")).alias("value"))
    return progress.parse_frames(frames).groupBy("type").agg(F.count("*").alias("events"), F.count_distinct("job").alias("jobs"))


def job_eta(spark, sf):
    """Remaining time of each job at its throughput so far."""
    p = progress.job_progress(progress.parse_events(media._event_lines(table(spark, sf, "events"))))
    return p.select("job", progress.eta_ms(F.col("finished"), F.col("started") + F.col("finished"), F.round("duration_ms")).cast("long").alias("eta_ms"))


def summary_csv(spark, sf):
    """The comparison of all files as CSV lines, the total row among them."""
    return benchmark_summary(spark, sf).select("file", report.csv_line(*[F.col(n) for n in _SUMMARY]).alias("line"))


def check_summary(spark, sf):
    """Orders as checks of their customer: urgent ones are required, finished ones passed."""
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("custkey"), F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderpriority").startswith("1").alias("required"), (F.col("o_orderstatus") == "F").alias("ok"),
    )
    return summary.check_summary(o, ["custkey"]).select("custkey", "checks", "failures", "warnings", "ok")


def names_in_order(spark, sf):
    """Parts of a manufacturer in the order of their names, as a reader would sort them and by code."""
    p = table(spark, sf, "part").select("p_brand", "p_partkey", F.initcap("p_name").alias("name"))
    return summary.name_order(p, ["p_brand"], "name", "p_partkey").select("p_brand", "p_partkey", "reader_rank", "code_rank")


def first_frames(spark, sf):
    """A partial run: the first 20 images of each track, none of which may be taken from or put into the cache."""
    o = table(spark, sf, "ocr_result").select("file", "track_id", "ord").distinct()
    return summary.partial_run(o, "ord", 20).groupBy("file", "track_id").agg(F.count("*").alias("images"), F.max("cacheable").alias("cacheable"))


def job_counts(spark, sf):
    """Jobs for a number of cores, detected or asked for."""
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("cores"))
    asked = F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey") % 40)
    return p.select("p_partkey", summary.job_count(F.col("cores"), asked).alias("jobs"))


QUERIES = {f.__name__: f for f in (
    language_lists, ocr_srt, required_times, frame_rates, pgs_counts, pgs_preview, pgs_parts, blank_frames, progress_frames, job_eta, summary_csv,
    check_summary, names_in_order, first_frames, job_counts,
)}

_STREAMS = """c as (select distinct file, cue_id, "start" s, "end" e, cue_id // 100 chunk from ref_cue where "start" is not null and "end" is not null and "end" > "start"),
  n as (select *, file || '#' || chunk as stream, row_number() over (partition by file, chunk order by s, cue_id) - 1 k from c)"""
_CLOCK = lambda t: f"floor({t} * 90000 + 0.5::double) / 90000"


def _rgb(luma: int, cr: int, cb: int, alpha: int) -> str:
    """SQL text of a colour blended over white."""
    r, g, b = f"{luma} + 1.402 * ({cr} - 128)", f"{luma} - 0.344136 * ({cb} - 128) - 0.714136 * ({cr} - 128)", f"{luma} + 1.772 * ({cb} - 128)"
    one = lambda v: f"least(255, greatest(0, floor(255 + ({v} - 255) * {alpha} / 255.0 + 0.5)))::int"
    return f"{one(r)} || ' ' || {one(g)} || ' ' || {one(b)}"


_SUMMARY = ["file", "reference_cues", "candidate_cues", "missing", "extra", "unverified", "shifted", "end_mismatches", "verdict"]

ORACLE = {
    "summary_csv": f"select file, concat_ws(',', {', '.join(f'{n}::varchar' for n in _SUMMARY)}) as line from ({scoring_sql.ORACLE['benchmark_summary']})",
    "language_lists": """with t as (select distinct file, track_id, string_split(lower(' ' || coalesce(language_code, '') || ' ,, ' || coalesce(language_ietf, '')), ',') l from track),
      c as (select file, track_id, list_filter(list_transform(l, lambda x: trim(x)), lambda x: x <> '') l from t)
      select distinct file, track_id, case when len(l) = 0 then 'eng' else array_to_string(l, '|') end as languages from c""",
    "ocr_srt": """with o as (select file, track_id, ord, arg_max({'t': text}, ocr_id).t as text from (select distinct * from ocr_result) where engine = 'vision-accurate' and ord is not null and text is not null group by all),
      n as (select *, row_number() over (partition by file, track_id order by ord) k, ord * 4 s from o where text is not null),
      f as (select *, printf('%02d:%02d:%02d,000 --> %02d:%02d:%02d,000', s // 3600, s // 60 % 60, s % 60, (s + 3) // 3600, (s + 3) // 60 % 60, (s + 3) % 60) t from n)
      select file, track_id, count(*)::int as cues, sha256(string_agg(k || chr(10) || t || chr(10) || text, chr(10) || chr(10) order by ord) || chr(10)) as sha,
        '/in/' || file || '-eng.srt' as beside, '/out/' || file || '-eng.srt' as in_folder, 'x.srt' as named from f group by file, track_id""",
    "required_times": """select distinct cue_id, "start" from ref_cue where "start" is not null""",
    "frame_rates": """select p_partkey, round(case p_partkey % 4 when 0 then p_size * 1000 / 1001::double when 1 then p_size + 0.5::double else 23.976::double end, 6) as fps from part""",
    "pgs_counts": f"with {_STREAMS} select stream as file, 2 * count(*) - 1 as sets from n group by stream",
    "pgs_preview": f"""with {_STREAMS}, u as (select *, row_number() over (partition by stream order by k) number from n where cue_id % 5 > 0)
      select stream as file, number::int as number, {_CLOCK('s')} as pts, case when number < 3 then {_CLOCK('e')} end as end_pts,
        (73 + cue_id % 7)::int as width, (54 + cue_id % 5)::int as height from u where number <= 3""",
    "pgs_parts": f"""with {_STREAMS}
      select stream as file, (3 * k)::int as ord, (40 + cue_id % 5)::int as content_width, 13 as content_height, true as usable, {_rgb(*RED)} || ', ' || {_rgb(*GREEN)} as corners from n
      union all select stream, (3 * k + 1)::int, 20, 10, true, {_rgb(*BLUE)} || ', ' || {_rgb(*GREEN)} from n
      union all select stream, (3 * k + 2)::int, 10, 10, true, {_rgb(*RED)} || ', ' || {_rgb(*RED)} from n""",
    "blank_frames": """with q as (select vec_id, list_transform(embedding[1:64], lambda x: least(255, greatest(0, floor((x::double + 0.6) * 200)))) g from embeddings)
      select vec_id, vec_id % 5 = 0 or list_aggregate(g, 'stddev_pop') / 255 <= 0.001 as blank from q""",
    "progress_frames": """select case event_type when 'signup' then 'started' when 'purchase' then 'finished' else 'failed' end as type, count(*) as events, count(distinct user_id) as jobs
      from events where event_type in ('signup', 'purchase', 'error') group by 1""",
    "job_eta": """with p as (select user_id::varchar job, count(*) filter (where event_type = 'signup') st, count(*) filter (where event_type = 'purchase') fi, round(sum(value)) ms
      from events where event_type in ('signup', 'purchase', 'error') group by 1)
      select job, case when fi > 0 then floor(ms / fi * st + 0.5::double)::bigint end as eta_ms from p""",
    "check_summary": """select o_custkey as custkey, count(*) as checks, count(*) filter (where o_orderpriority like '1%' and o_orderstatus <> 'F') as failures,
      count(*) filter (where o_orderpriority not like '1%' and o_orderstatus <> 'F') as warnings, count(*) filter (where o_orderpriority like '1%' and o_orderstatus <> 'F') = 0 as ok from orders group by 1""",
    "names_in_order": """select p_brand, p_partkey, row_number() over (partition by p_brand order by lower(p_name), p_partkey) as reader_rank,
      row_number() over (partition by p_brand order by array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1:1]) || w[2:]), ' '), p_partkey) as code_rank from part""",
    "first_frames": """select file, track_id, count(*) as images, false as cacheable from (select distinct file, track_id, ord from ocr_result) where ord < 20 group by all""",
    "job_counts": """select p_partkey, case when p_partkey % 3 = 0 then greatest(1, p_partkey % 40) else greatest(1, least(16, p_size - 1)) end::int as jobs from part""",
}

"""Caption formats: raw document text -> array of cues, as expressions over one row.

A parser takes the raw text of a document and gives ``array<struct<start, end, text>>``
in file order.  Nothing is exploded or shuffled before the cues are known, so all
formats of a mixed folder are read in one pass.  A cue whose timecode cannot be
read has a null time; :func:`cues` sets such cues apart or, if strict, fails.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuefold.functions.binding import let
from cuefold.functions.text import WS, clean_subtitle_text, decode_entities, strip
from cuefold.functions.timecode import DEFAULT_FPS, parse_fps, parse_srt_time, parse_timecode, ttml_time

ARROW = "-->"
#: Seconds a last cue lasts where a format has only starts.
SAMI_LAST, TRANSCRIPT_LAST = 3.0, 4.0
#: Spacing and length of the cues of a transcript without times.
PLAIN_STEP, PLAIN_LENGTH = 3.5, 3.0


def _no_cr(raw: Column) -> Column:
    return F.replace(raw, F.lit("\r"), F.lit(""))


def _cue(start: Column, end: Column, text: Column) -> Column:
    return F.struct(start.cast("double").alias("start"), end.cast("double").alias("end"), text.alias("text"))


def _timed_blocks(text: Column, skip: str | None = None) -> Column:
    """Blocks between empty lines: first the line with the arrow, then the lines after it."""
    lines = F.transform(F.split(text, r"\n{2,}", -1), lambda b: F.filter(F.split(b, "\n", -1), lambda x: x != ""))
    if skip:
        lines = F.filter(lines, lambda x: ~F.coalesce(F.get(x, F.lit(0)), F.lit("")).rlike(skip))
    at = F.transform(
        lines,
        lambda x: F.struct(x.alias("lines"), F.array_position(F.transform(x, lambda y: F.contains(y, F.lit(ARROW))), F.lit(True)).cast("int").alias("at")),
    )
    return F.transform(
        F.filter(at, lambda x: x["at"] > 0),
        lambda x: F.struct(
            F.split(F.element_at(x["lines"], x["at"]), ARROW, -1).alias("times"),
            F.array_join(F.slice(x["lines"], x["at"] + 1, F.size(x["lines"])), "\n").alias("text"),
        ),
    )


def _first_token(text: Column) -> Column:
    return F.regexp_extract(strip(text), r"\A(\S*)", 1)


def srt(raw: Column) -> Column:
    """Blocks with an arrow line; whatever follows the end time on it is dropped."""
    return F.transform(
        _timed_blocks(_no_cr(raw)),
        lambda b: _cue(parse_timecode(b["times"][0]), parse_timecode(_first_token(b["times"][1])), b["text"]),
    )


def vtt(raw: Column) -> Column:
    """As SRT, without header and without NOTE, STYLE and REGION blocks."""
    body = strip(F.regexp_replace(_no_cr(raw), r"(?i)\AWEBVTT[^\n]*(?:\n|\z)", ""))
    return F.transform(
        _timed_blocks(body, r"(?i)\A(NOTE|STYLE|REGION)(?![A-Za-z0-9_])"),
        lambda b: _cue(parse_timecode(b["times"][0]), parse_timecode(_first_token(b["times"][1])), b["text"]),
    )


# Fields of a dialogue line unless a Format line says otherwise.
ASS_FIELDS = ["layer", "start", "end", "style", "name", "marginl", "marginr", "marginv", "effect", "text"]


def _before(marks: Column, at: Column) -> Column:
    """The last mark before a line."""
    return F.try_element_at(F.filter(marks, lambda m: m["at"] < at), F.lit(-1))


def ass(raw: Column) -> Column:
    """Dialogue lines by the fields of the last Format line before them."""
    lines = F.transform(F.split(_no_cr(raw), "\n", -1), lambda x, i: F.struct(x.alias("line"), i.alias("at")))
    kept = F.filter(lines, lambda x: x["line"].rlike("(?i)^(Format|Dialogue):"))
    return let(kept, lambda own: let(_ass_formats(own), lambda formats: _ass_cues(own, formats)))


def _ass_formats(lines: Column) -> Column:
    return F.transform(
        F.filter(lines, lambda x: x["line"].rlike("(?i)^Format:")),
        lambda x: F.struct(
            x["at"].alias("at"),
            F.transform(F.split(F.regexp_replace(x["line"], r"(?i)^Format:\s*", ""), ",", -1), lambda f: F.lower(strip(f))).alias("fields"),
        ),
    )


def _ass_cues(lines: Column, formats: Column) -> Column:
    default = F.array(*[F.lit(f) for f in ASS_FIELDS])
    spoken = F.transform(
        F.filter(lines, lambda x: x["line"].rlike("(?i)^Dialogue:")),
        lambda x: F.struct(
            F.regexp_replace(x["line"], r"(?i)^Dialogue:\s*", "").alias("rest"),
            F.coalesce(_before(formats, x["at"])["fields"], default).alias("fields"),
        ),
    )
    # One field takes all commas that are left over.
    parts = F.transform(
        spoken,
        lambda x: F.struct(
            F.split(x["rest"], ",", F.size(x["fields"])).alias("parts"),
            *[F.array_position(x["fields"], F.lit(f)).cast("int").alias(f) for f in ("start", "end", "text")],
        ),
    )
    whole = F.filter(parts, lambda x: (x["start"] > 0) & (x["end"] > 0) & (x["text"] > 0))
    return F.transform(
        whole,
        lambda x: _cue(
            parse_timecode(F.try_element_at(x["parts"], x["start"])), parse_timecode(F.try_element_at(x["parts"], x["end"])),
            F.array_join(F.slice(x["parts"], x["text"], F.size(x["parts"])), ","),
        ),
    )


def _numbered(raw: Column, pattern: str) -> Column:
    """Lines of two numbers and a text."""
    found = F.transform(
        F.filter(F.transform(F.split(_no_cr(raw), "\n", -1), lambda x, i: F.struct(x.alias("line"), i.alias("at"))), lambda x: x["line"].rlike(pattern)),
        lambda x: F.struct(
            F.regexp_extract(x["line"], pattern, 1).cast("double").alias("a"), F.regexp_extract(x["line"], pattern, 2).cast("double").alias("b"),
            F.replace(F.regexp_extract(x["line"], pattern, 3), F.lit("|"), F.lit("\n")).alias("text"), x["at"].alias("at"),
        ),
    )
    return found


def microdvd(raw: Column, fps: Column) -> Column:
    """Frame numbers; a line ``{1}{1}rate`` sets the rate of the lines after it."""
    is_rate = lambda x: (x["a"] == 1) & (x["b"] == 1) & x["text"].rlike(r"^[0-9]+(?:\.[0-9]+)?\z")
    rates = lambda lines: F.transform(F.filter(lines, is_rate), lambda x: F.struct(x["at"].alias("at"), x["text"].try_cast("double").alias("fps")))

    def timed(lines: Column, marks: Column) -> Column:
        own = F.transform(
            F.filter(lines, lambda x: ~is_rate(x)),
            lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["text"].alias("text"), F.coalesce(_before(marks, x["at"])["fps"], fps).alias("fps")),
        )
        return F.transform(own, lambda x: _cue(x["a"] / x["fps"], x["b"] / x["fps"], x["text"]))

    lines = _numbered(raw, r"^\{([0-9]+)\}\{([0-9]+)\}(.*)\z")
    return let(lines, lambda own: let(rates(own), lambda marks: timed(own, marks)))


def mpl2(raw: Column) -> Column:
    """Tenths of seconds."""
    return F.transform(_numbered(raw, r"^\[([0-9]+)\]\[([0-9]+)\](.*)\z"), lambda x: _cue(x["a"] / 10, x["b"] / 10, x["text"]))


_ATTRIBUTES = r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)"""
_PARAGRAPH = rf"(?is)<(?:[A-Za-z0-9_]+:)?p(?![A-Za-z0-9_]){_ATTRIBUTES}>(.*?)</(?:[A-Za-z0-9_]+:)?p>"
_ROOT = rf"(?i)<(?:[A-Za-z0-9_]+:)?tt(?![A-Za-z0-9_]){_ATTRIBUTES}>"


def _attribute(attributes: Column, name: str) -> Column:
    """The last value of an attribute, null if it is not there."""
    pattern = rf"""(?i)(?<![A-Za-z0-9_:.-]){name}\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    last = F.try_element_at(F.regexp_extract_all(attributes, F.lit(pattern), F.lit(0)), F.lit(-1))
    return decode_entities(F.concat(F.regexp_extract(last, pattern, 1), F.regexp_extract(last, pattern, 2)))


def ttml_frame_rate(raw: Column, fps: Column) -> Column:
    """The rate a TTML document declares, times its multiplier, else ``fps``."""
    root = F.regexp_extract(raw, _ROOT, 1)
    declared = _attribute(root, "ttp:frameRate").try_cast("double")
    multiplier = strip(_attribute(root, "ttp:frameRateMultiplier"))
    a, b = (F.regexp_extract(multiplier, r"\A(\S+)\s+(\S+)", k).try_cast("double") for k in (1, 2))
    factor = F.when(a.isNotNull() & (b > 0), a / b).otherwise(F.lit(1.0))
    return F.when(declared > 0, declared * F.coalesce(factor, F.lit(1.0))).otherwise(fps)


def ttml(raw: Column, fps: Column) -> Column:
    """Paragraphs with a readable begin, an end or duration, and a text."""
    text = F.regexp_replace(_no_cr(raw), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    return let(text, lambda t: let(ttml_frame_rate(t, fps), lambda rate: _ttml_cues(t, rate)))


def _ttml_cues(text: Column, rate: Column) -> Column:
    found = F.transform(
        F.regexp_extract_all(text, F.lit(_PARAGRAPH), F.lit(0)),
        lambda p: F.struct(F.regexp_extract(p, _PARAGRAPH, 1).alias("attributes"), clean_subtitle_text(F.regexp_extract(p, _PARAGRAPH, 2)).alias("text")),
    )
    timed = F.transform(
        found,
        lambda p: F.struct(
            ttml_time(F.nullif(_attribute(p["attributes"], "begin"), F.lit("")), rate).alias("start"),
            _attribute(p["attributes"], "end").isNotNull().alias("ends"),
            ttml_time(_attribute(p["attributes"], "end"), rate).alias("end"),
            ttml_time(_attribute(p["attributes"], "dur"), rate).alias("dur"), p["text"].alias("text"),
        ),
    )
    cues = F.transform(timed, lambda p: _cue(p["start"], F.when(p["ends"], p["end"]).otherwise(p["start"] + p["dur"]), p["text"]))
    return F.filter(cues, lambda c: c["start"].isNotNull() & c["end"].isNotNull() & (c["text"] != ""))


_SYNC = r"""(?i)<sync\s+start\s*=\s*"?([0-9]+)"?(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""


def sami(raw: Column) -> Column:
    """Each sync lasts to the next one; empty ones only end the one before."""
    starts = F.transform(F.regexp_extract_all(raw, F.lit(_SYNC), F.lit(1)), lambda x: x.cast("double") / 1000)
    bodies = F.slice(F.split(raw, _SYNC, -1), 2, 2_147_483_646)

    def timed(at: Column) -> Column:
        both = F.zip_with(at, bodies, lambda s, t: F.struct(s.alias("start"), clean_subtitle_text(t).alias("text")))
        return F.transform(both, lambda x, i: _cue(x["start"], F.coalesce(F.get(at, i + 1), x["start"] + SAMI_LAST), x["text"]))

    return F.filter(let(starts, timed), lambda c: c["text"] != "")


_STAMPED = r"(?m)^\s*(?:\[{1,2}|\()([0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?(?:[,.][0-9]{1,3})?)(?:\]{1,2}|\))\s*(.+)$"


def transcript(raw: Column) -> Column:
    """Stamped lines up to the next stamp; without any stamp, lines at even distances."""
    stamps = F.transform(F.regexp_extract_all(raw, F.lit(_STAMPED), F.lit(1)), parse_timecode)
    texts = F.regexp_extract_all(raw, F.lit(_STAMPED), F.lit(2))
    lines = F.filter(F.transform(F.split(_no_cr(raw), "\n", -1), strip), lambda x: x != "")
    plain = F.transform(lines, lambda x, i: _cue(i * PLAIN_STEP, i * PLAIN_STEP + PLAIN_LENGTH, x))

    def timed(at: Column) -> Column:
        both = F.zip_with(at, texts, lambda s, t: F.struct(s.alias("start"), t.alias("text")))
        stamped = F.transform(both, lambda x, i: _cue(x["start"], F.coalesce(F.get(at, i + 1), x["start"] + TRANSCRIPT_LAST), x["text"]))
        return F.when(F.size(at) > 0, stamped).otherwise(plain)

    return let(stamps, timed)


def sniff(raw: Column, name: Column) -> Column:
    """The format of a document: by the extension of its name, else by its content."""
    n = F.lower(F.coalesce(name, F.lit("")))
    w = r"(?![A-Za-z0-9_])"
    return (
        F.when(n.endswith(".srt"), "srt").when(n.endswith(".vtt"), "vtt").when(n.rlike(r"\.(itt|ttml)\z"), "ttml")
        .when(n.rlike(r"\.(ass|ssa)\z"), "ass").when(n.rlike(r"\.(smi|sami)\z"), "sami")
        .when(raw.rlike(rf"(?i)\A{WS}*WEBVTT{w}"), "vtt")
        .when(raw.rlike(rf"(?i)<(?:[A-Za-z0-9_]+:)?tt{w}[^>]*http://www\.w3\.org/ns/ttml"), "ttml")
        .when(raw.rlike(r"(?m)^\{[0-9]+\}\{[0-9]+\}"), "microdvd").when(raw.rlike(r"(?m)^\[[0-9]+\]\[[0-9]+\]"), "mpl2")
        .when(F.contains(raw, F.lit(ARROW)), "srt").when(raw.rlike(r"(?im)^\s*\[Events\]"), "ass")
        .when(raw.rlike(rf"(?i)<sami{w}"), "sami").otherwise("transcript")
    )


PARSERS: dict[str, Callable[[Column, Column], Column]] = {
    "srt": lambda raw, fps: srt(raw), "vtt": lambda raw, fps: vtt(raw), "ttml": ttml, "ass": lambda raw, fps: ass(raw),
    "sami": lambda raw, fps: sami(raw), "microdvd": microdvd, "mpl2": lambda raw, fps: mpl2(raw),
    "transcript": lambda raw, fps: transcript(raw),
}


def parse(raw: Column, name: Column, fps: Column | None = None, formats: list[str] | None = None) -> Column:
    """Cues of a document of any format; ``fps`` is a number, or a text as :func:`parse_fps` reads it."""
    fps = F.lit(DEFAULT_FPS) if fps is None else parse_fps(fps.cast("string"))

    def by_format(d: Column) -> Column:
        out = F.lit(None)
        for k in formats or PARSERS:
            out = F.when(d["fmt"] == k, PARSERS[k](d["text"], fps)).otherwise(out)
        return out

    bare = F.replace(raw, F.lit("\ufeff"), F.lit(""))
    sniffed = let(bare, lambda t: F.struct(t.alias("text"), sniff(t, name).alias("fmt")))
    return let(sniffed, by_format)


def cues(df: DataFrame, parsed: Column, keep: list[str], strict: bool = True) -> DataFrame:
    """``keep`` columns and ``ord, start, end, text, readable`` of every parsed cue.

    A cue with a time that cannot be read fails the query; without ``strict`` it is a row that is
    not ``readable``, so that a caller can set its document apart.  Null documents have no cues.
    """
    out = df.select(*keep, F.posexplode(parsed).alias("ord", "c")).select(*keep, "ord", "c.*")
    readable = F.col("start").isNotNull() & F.col("end").isNotNull()
    if strict:
        # A condition, as a column could be pruned.
        out = out.where(F.when(readable, True).otherwise(F.raise_error(F.lit("unreadable timecode")).cast("boolean")))
    return out.withColumn("readable", readable)


def srt_metrics(raw: Column) -> Column:
    """Cues of an SRT file for scoring: strict times, blocks that fail are left out.

    ``index`` counts blocks before any is left out, ``number`` is that of the first line.
    """
    clean = strip(_no_cr(F.regexp_replace(raw, r"\A\uFEFF", "")))
    blocks = F.transform(
        F.split(clean, r"\n\n+", -1),
        lambda b, i: F.struct(i.alias("index"), F.split(b, "\n", -1).alias("lines")),
    )
    at = F.transform(
        blocks,
        lambda b: F.struct(
            b["index"].alias("index"), b["lines"].alias("lines"),
            F.array_position(F.transform(b["lines"], lambda y: F.contains(y, F.lit(ARROW))), F.lit(True)).cast("int").alias("at"),
        ),
    )
    timed = F.transform(
        F.filter(at, lambda b: b["at"] > 0),
        lambda b: F.struct(
            b["index"].alias("index"), b["lines"][0].alias("first"), F.element_at(b["lines"], b["at"]).alias("timing"),
            strip(F.array_join(F.slice(b["lines"], b["at"] + 1, F.size(b["lines"])), "\n")).alias("text"),
        ),
    )
    number = lambda b: F.when(strip(b["first"]) == "", F.lit(0.0)).otherwise(
        F.coalesce(F.when(strip(b["first"]).rlike(r"\A[+-]?[0-9.]+(?:[eE][+-]?[0-9]+)?\z"), strip(b["first"]).try_cast("double")), (b["index"] + 1).cast("double"))
    )
    out = F.transform(
        timed,
        lambda b: F.struct(
            b["index"].alias("index"), number(b).alias("number"),
            parse_srt_time(strip(F.split(b["timing"], ARROW, -1)[0])).alias("start"),
            parse_srt_time(_first_token(F.split(b["timing"], ARROW, -1)[1])).alias("end"),
            b["timing"].alias("timing"), b["text"].alias("text"),
        ),
    )
    return F.filter(out, lambda c: c["start"].isNotNull() & c["end"].isNotNull())

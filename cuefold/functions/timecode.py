"""Timecodes: Column -> Column.  All times are DOUBLE seconds, all patterns ASCII digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuefold.functions.binding import let
from cuefold.functions.text import strip

DEFAULT_FPS = 23.976

# Accepted shapes of times.
TIMECODE = r"\A(?:([0-9]+):)?([0-9]{1,2}):([0-9]{2})(?:[,.]([0-9]{1,3}))?\z"
STRICT_TIME = r"\A([0-9]+):([0-9]{2}):([0-9]{2})[,.]([0-9]{3})\z"
FRAME_TIME = r"\A([0-9]+):([0-9]{2}):([0-9]{2})[:;]([0-9]+(?:\.[0-9]+)?)\z"
CLOCK_TIME = r"\A([0-9]+):([0-9]{2}):([0-9]{2})(?:[,.]([0-9]{1,3}))?\z"
OFFSET_TIME = r"(?i)\A([0-9]+(?:\.[0-9]+)?)(h|m|s|ms|f)\z"
NUMBER = r"\A[0-9]+(?:\.[0-9]+)?\z"
FRACTION = r"\A([0-9]+(?:\.[0-9]+)?)\s*/\s*([0-9]+(?:\.[0-9]+)?)\z"


def _group(text: Column, pattern: str, k: int) -> Column:
    return F.regexp_extract(text, pattern, k)


def _number(text: Column) -> Column:
    """The number, or 0 for an unmatched group."""
    return F.coalesce(F.nullif(text, F.lit("")).cast("double"), F.lit(0.0))


def _clock(text: Column, pattern: str) -> Column:
    """Hours, minutes, seconds and up to three digits of a fraction."""
    return (
        _number(_group(text, pattern, 1)) * 3600 + _number(_group(text, pattern, 2)) * 60
        + _number(_group(text, pattern, 3)) + F.rpad(_group(text, pattern, 4), 3, "0").cast("double") / 1000
    )


def round_half_up(x: Column) -> Column:
    """floor(x + 0.5), which also rounds negative halves up."""
    return F.floor(x + F.lit(0.5))


def srt_time(seconds: Column) -> Column:
    """``HH:MM:SS,mmm``; negative, null and NaN times are zero, hours may have more digits."""
    known = F.when(seconds.isNull() | F.isnan(seconds), F.lit(0.0)).otherwise(seconds.cast("double"))
    ms = F.greatest(F.lit(0).cast("long"), round_half_up(known * 1000))
    return let(
        ms,
        lambda m: F.format_string(
            "%02d:%02d:%02d,%03d", F.floor(m / 3_600_000), F.floor(m / 60_000) % 60, F.floor(m / 1000) % 60, m % 1000
        ),
    )


def parse_timecode(text: Column) -> Column:
    """Seconds of ``[H:]M:SS[,fff]`` with any number of hour digits, else null."""
    return let(strip(text), lambda t: F.when(t.rlike(TIMECODE), _clock(t, TIMECODE)))


def require_timecode(text: Column, context: str) -> Column:
    """As :func:`parse_timecode`, but a value that is no timecode fails the query."""
    return F.coalesce(
        parse_timecode(text),
        F.raise_error(F.concat(F.lit(f"not a {context} timecode: "), F.coalesce(strip(text), F.lit("null")))).cast("double"),
    )


def parse_srt_time(text: Column) -> Column:
    """Seconds of ``H:MM:SS,mmm`` with exactly three digits of milliseconds, else null."""
    return F.when(text.rlike(STRICT_TIME), _clock(text, STRICT_TIME))


def parse_fps(text: Column, strict: bool = True) -> Column:
    """Frame rate of a number or a fraction; null and empty are the default.

    Anything else fails the query, or is null without ``strict``.
    """
    t = strip(text)
    a, b = (_group(t, FRACTION, k).try_cast("double") for k in (1, 2))
    value = F.when(t.rlike(FRACTION), F.when((a > 0) & (b > 0), a / b)).otherwise(
        F.when(t.rlike(r"\A[+]?[0-9.]+(?:[eE][+-]?[0-9]+)?\z"), t.try_cast("double"))
    )
    unusable = F.raise_error(F.concat(F.lit("unusable frame rate: "), t)) if strict else F.lit(None)
    usable = (value > 0) & (value < float("inf"))
    return F.when(text.isNull() | (text == ""), F.lit(DEFAULT_FPS)).otherwise(F.when(usable, value).otherwise(unusable.cast("double")))


def ttml_time(text: Column, fps: Column) -> Column:
    """Seconds of a frame, clock or offset time or of bare seconds, else null."""
    return let(strip(F.coalesce(text, F.lit(""))), lambda t: _ttml_seconds(t, fps))


def _ttml_seconds(t: Column, fps: Column) -> Column:
    amount, unit = _number(_group(t, OFFSET_TIME, 1)), F.lower(_group(t, OFFSET_TIME, 2))
    frames = (
        _number(_group(t, FRAME_TIME, 1)) * 3600 + _number(_group(t, FRAME_TIME, 2)) * 60
        + _number(_group(t, FRAME_TIME, 3)) + _number(_group(t, FRAME_TIME, 4)) / fps
    )
    offset = (
        F.when(unit == "h", amount * 3600).when(unit == "m", amount * 60).when(unit == "ms", amount / 1000)
        .when(unit == "f", amount / fps).otherwise(amount)
    )
    return (
        F.when(t.rlike(FRAME_TIME), frames).when(t.rlike(CLOCK_TIME), _clock(t, CLOCK_TIME))
        .when(t.rlike(OFFSET_TIME), offset).when(t.rlike(NUMBER), t.try_cast("double"))
    )


def filename_time(seconds: Column) -> Column:
    """Whole milliseconds padded to ten digits."""
    return F.format_string("%010d", round_half_up(seconds * 1000))


def minutes_seconds(ms: Column) -> Column:
    """``Nm SSs`` of a duration in milliseconds."""
    s = round_half_up(ms / 1000)
    return F.format_string("%dm %02ds", F.floor(s / 60), s % 60)


def percent(rate: Column) -> Column:
    return F.format_string("%.2f%%", rate * 100)

"""Writing cues as SRT documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuefold.functions.text import clean_subtitle_text, strip
from cuefold.functions.timecode import srt_time
from cuefold.operators.blocked import numbered

BOM = "\ufeff"


def cue_block(number: Column, start: Column, end: Column, text: Column) -> Column:
    return F.concat_ws("\n", number.cast("string"), F.concat(srt_time(start), F.lit(" --> "), srt_time(end)), text)


def emitted(df: DataFrame) -> DataFrame:
    """The cues that are written: some text and a positive length.  Cleaning comes later."""
    return df.where((strip(F.col("text")) != "") & (F.col("end") > F.col("start")))


#: Orders per block in which cues are numbered.
BLOCK = 4096


def srt_bodies(df: DataFrame, key: list[str], order: str, recognised: bool = False) -> DataFrame:
    """``key, body, cues``: one SRT text per key, cues numbered from 1 in the numeric ``order``.

    Text cues are filtered and cleaned; recognised ones (``recognised``) are written as they
    are if they have a text.  Cues are numbered in blocks of the order.  One key is one output
    file and one row in the end, so its text must stay under the 2 GB of a value: some ten
    million cues of 150 characters.
    """
    rows = df.where("text is not null") if recognised else emitted(df)
    text = F.col("text") if recognised else clean_subtitle_text(F.col("text"))
    rows = rows.select(*key, F.col(order).alias("o"), "start", "end", text.alias("text"))
    rows = numbered(rows, key, F.floor(F.col("o") / BLOCK), ["o"], "number")
    return (
        rows.select(*key, "number", cue_block(F.col("number"), F.col("start"), F.col("end"), F.col("text")).alias("block"))
        .groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("number", "block"))).alias("blocks"))
        .select(*key, F.concat(F.array_join(F.col("blocks.block"), "\n\n"), F.lit("\n")).alias("body"), F.size("blocks").alias("cues"))
    )


def srt_document(body: Column) -> Column:
    """Byte order mark and CRLF; a blank body is the mark alone."""
    unix = F.replace(F.coalesce(body, F.lit("")), F.lit("\r\n"), F.lit("\n"))
    return F.when(strip(unix) == "", F.lit(BOM)).otherwise(F.concat(F.lit(BOM), F.replace(unix, F.lit("\n"), F.lit("\r\n"))))


def output_name(name: Column) -> Column:
    """``stem.srt``, or another name where that would overwrite the input."""
    stem = F.regexp_replace(name, r"\.[^.]+\z", "")
    out = F.concat(stem, F.lit(".srt"))
    return F.when(out == name, F.concat(stem, F.lit("-converted.srt"))).otherwise(out)


def recognised_name(path: Column, language: Column, out_dir: Column, out: Column) -> Column:
    """``<base>-<language>.srt`` in the output folder, else the given output, else beside the input."""
    base = F.regexp_replace(F.regexp_extract(path, r"([^/]*)\z", 1), r"(?i)\.(sup|sub|idx)\z", "")
    name = F.concat(base, F.lit("-"), language, F.lit(".srt"))
    return F.coalesce(F.concat(out_dir, F.lit("/"), name), out, F.concat(F.regexp_extract(path, r"\A(.*/)?", 1), name))


def cue_count(document: Column) -> Column:
    """Number of arrows of a document."""
    return F.size(F.split(document, " --> ", -1)) - 1

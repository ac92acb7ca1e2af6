"""Recognised text: words to lines, usability of readings, choice of reading and engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuefold.functions.binding import let
from cuefold.functions.text import clean_ocr_text, text_health

# Limits of confidence and length by which readings are judged.
MARGIN, CONFIDENCE_FLOOR, PROBE_SAMPLE = 0.025, 88.0, 24
LENGTH_WEIGHT, LENGTH_CAP = 0.02, 120
SHORT = r"\A[A-Za-z]{1,3}\z"

# The ways an image is read, in the order that decides between equal scores.
DIRECT, DILATED = ["psm6", "psm11", "default"], "threshold-dilate"
REPAIRS = ["shadow-strip", "fill-select", "hollow-fill", "hollow-repair"]
SINGLE = "psm10"
VARIANT_ORDER = [*DIRECT, SINGLE, DILATED, *REPAIRS, "resize2-psm7", "resize2-psm13", "gray-auto-psm6", "gray-auto-psm13", "psm13"]


def parse_words(tsv: Column) -> Column:
    """Word rows ``struct<line, conf, text>`` of a recogniser's table; the text may hold tabs."""
    rows = F.slice(F.split(F.regexp_replace(F.replace(tsv, F.lit("\r"), F.lit("")), r"\A\s+|\s+\z", ""), "\n", -1), 2, 2_147_483_646)
    cols = F.transform(rows, lambda r: F.split(r, "\t", 12))
    words = F.filter(cols, lambda c: (F.size(c) >= 12) & (F.get(c, F.lit(0)) == "5") & (F.get(c, F.lit(11)) != ""))
    return F.transform(
        words,
        lambda c: F.struct(F.array_join(F.slice(c, 2, 4), ":").alias("line"), F.get(c, F.lit(10)).try_cast("double").alias("conf"), F.get(c, F.lit(11)).alias("text")),
    )


def mean_confidence(words: Column) -> Column:
    known = F.filter(words, lambda w: w["conf"].isNotNull() & ~F.isnan(w["conf"]) & (w["conf"] >= 0))
    mean = lambda k: F.aggregate(k, F.lit(0.0), lambda a, w: a + w["conf"]) / F.size(k)
    return let(known, lambda k: F.when(F.size(k) > 0, mean(k)).otherwise(F.lit(0.0)))


def regroup_lines(words: Column, profile: str = "generic") -> Column:
    """Text of the words, a new line wherever the line key changes, cleaned."""
    # Each word brings its separator: its key against that of the word before.
    parts = lambda own: F.transform(
        own,
        lambda w, i: F.concat(F.when(i == 0, "").when(w["line"] == F.get(own, i - 1)["line"], " ").otherwise("\n"), w["text"]),
    )
    return clean_ocr_text(let(words, lambda own: F.array_join(parts(own), "")), profile)


def parse_command_output(out: Column) -> Column:
    """``struct<text, confidence, model>`` of a recogniser's JSON or plain text output."""
    t = F.trim(out)
    j = F.when(t.startswith("{"), F.from_json(t, "text string, confidence string, model string"))
    is_json = j.isNotNull() & j["text"].isNotNull()
    return F.struct(
        F.when(is_json, j["text"]).otherwise(t).alias("text"),
        F.when(is_json, F.coalesce(j["confidence"].try_cast("double"), F.lit(0.0))).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(is_json, j["model"]).alias("model"),
    )


def score(text: Column, confidence: Column) -> Column:
    """Confidence with a little for length; nothing read scores 0."""
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).otherwise(F.coalesce(confidence, F.lit(0.0)) + F.least(F.length(text), F.lit(LENGTH_CAP)) * LENGTH_WEIGHT)


def lines_of(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: x != "")


def fragments(text: Column) -> Column:
    """Two or more of at least two lines have three letters or fewer."""
    lines = lines_of(text)
    return (F.size(lines) >= 2) & (F.size(F.filter(lines, lambda x: F.length(x) <= 3)) >= 2)


def usable(text: Column, confidence: Column) -> Column:
    """Whether a fallback reading is worth taking; the first rule that fits decides."""
    c = F.coalesce(confidence, F.lit(0.0))
    return (
        F.when(F.coalesce(text, F.lit("")) == "", False).when(text.rlike(r"\A\[[A-Za-z][A-Za-z -]+\]\z"), c >= 10)
        .when(text.rlike(r"(?i)(?:\A|[^A-Za-z0-9_])(?:just|think)\.\.\.\z"), c >= 35).when(text.rlike(r"\A[A-Z]\.\.\.\z"), c >= 10)
        .when(text.rlike(r"\A[A-Za-z]{1,2}\z"), False).otherwise((c >= 45) & (F.length(text) >= 3))
    )


def precise_line(text: Column, confidence: Column) -> Column:
    return F.coalesce((text != "") & ~F.contains(text, F.lit("\n")) & (confidence >= 80) & (F.length(text) >= 2), F.lit(False))


def dilated_usable(text: Column, confidence: Column) -> Column:
    return usable(text, confidence) & (~F.coalesce(text, F.lit("")).rlike(SHORT) | (F.coalesce(confidence, F.lit(0.0)) >= 80))


def weak(text: Column, variant: Column, height: Column) -> Column:
    """Whether a first reading should be tried again."""
    n = F.size(lines_of(text))
    tall = F.coalesce(height >= 150, F.lit(False)) & ((n == 1) | ((variant == "psm11") & (n <= 2)))
    return F.when(F.coalesce(text, F.lit("")) == "", False).otherwise((n >= 3) | fragments(text) | text.rlike(SHORT) | tall)


def prefer_dilated(first: Column, text: Column, confidence: Column) -> Column:
    """Whether a thresholded reading replaces the first one."""
    a, b = F.length(first), F.length(text)
    better = (
        ((F.size(lines_of(text)) > F.size(lines_of(first))) & (b >= a + 4)) | ((confidence >= 80) & (b >= a + 8))
        | (fragments(first) & (b >= a - 2)) | (first.rlike(SHORT) & (b > a))
    )
    return F.coalesce(dilated_usable(text, confidence) & (confidence >= 70) & better, F.lit(False))


def choose_reading(readings: DataFrame, image: list[str], mode: str = "accurate", height: str | None = None) -> DataFrame:
    """The reading of each image, of all the ways in which it was read.

    ``readings`` has ``id, text, confidence, variant``, and ``height`` names the column of the
    image's height if there is one.

    * ``accurate``: direct readings, a thresholded one that is usable and usable repairs compete
      on score; the thresholded one also wins by :func:`prefer_dilated`.
    * ``hybrid``: direct readings compete on score; only a :func:`weak` winner is tried again,
      and the thresholded reading wins by :func:`prefer_dilated`.  Repairs are not looked at.

    If all of these are blank, the other readings are fallbacks and the best score wins among
    those that pass the rule of their variant: :func:`precise_line` for psm10,
    :func:`dilated_usable` for the thresholded one, :func:`usable` for any other.  Equal scores
    go to the variant that comes first, then to the smaller id.  Images nothing was read of
    keep a null ``text``.
    """
    if mode not in ("accurate", "hybrid"):
        raise ValueError(f"mode {mode}")
    rank = F.coalesce(F.array_position(F.array(*[F.lit(v) for v in VARIANT_ORDER]), F.col("variant")), F.lit(99))
    key = F.struct(score(F.col("text"), F.col("confidence")), -rank, -F.col("id"))
    tall = F.col(height).cast("double") if height else F.lit(None).cast("double")
    row = F.struct("id", "text", "confidence", "variant", tall.alias("height"))
    text, conf, variant = F.col("text"), F.col("confidence"), F.coalesce("variant", F.lit(""))
    direct = variant.isin(*DIRECT) & (F.coalesce(text, F.lit("")) != "")
    dilated = (variant == DILATED) & dilated_usable(text, conf)
    repaired = variant.isin(*REPAIRS) & usable(text, conf)
    last = F.when(variant == SINGLE, precise_line(text, conf)).when(variant == DILATED, dilated_usable(text, conf)).otherwise(~variant.isin(*DIRECT, *REPAIRS) & usable(text, conf))
    best = readings.groupBy(*image).agg(
        F.max_by(row, F.when(direct | dilated | repaired if mode == "accurate" else direct, key)).alias("first"),
        F.max_by(row, F.when(dilated, key)).alias("again"), F.max_by(row, F.when(last, key)).alias("last"), F.count("*").alias("readings"),
    )
    better = F.col("again").isNotNull() & prefer_dilated(F.col("first.text"), F.col("again.text"), F.col("again.confidence"))
    if mode == "hybrid":
        better = better & F.coalesce(weak(F.col("first.text"), F.col("first.variant"), F.col("first.height")), F.lit(False))
    take = F.when(F.col("first").isNull(), F.col("last")).when(better, F.col("again")).otherwise(F.col("first"))
    return best.select(*image, "readings", take.alias("t")).select(*image, "readings", F.col("t.id").alias("id"), "t.text", "t.confidence", "t.variant")


def engine_failed(warnings: Column) -> Column:
    """A blank reading is no failure; these warnings are."""
    return F.exists(F.coalesce(warnings, F.array().cast("array<string>")), lambda w: w.startswith("vision-failed") | (w == "vision-missing-result"))


def probe(sampled: DataFrame, group: list[str], margin: float = MARGIN, floor: float = CONFIDENCE_FLOOR) -> DataFrame:
    """Which engine reads a group: the challenger only if its text is healthier and the default doubts itself.

    ``sampled`` has one row per image: ``d_text, d_conf, c_text``.
    """
    read = (F.coalesce("d_text", F.lit("")) != "") | (F.coalesce("c_text", F.lit("")) != "")
    # Scores are rounded so that the order of addition cannot tell.
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(read, F.coalesce(c, F.lit(0.0)))), F.lit(0.0)), 9)
    out = sampled.groupBy(*group).agg(
        F.count_if(read).alias("readable"), mean(text_health(F.col("d_text"))).alias("default_score"),
        mean(text_health(F.col("c_text"))).alias("challenger_score"), mean(F.col("d_conf")).alias("default_confidence"),
    )
    return out.withColumn("use_challenger", (F.col("challenger_score") > F.col("default_score") + margin) & (F.col("default_confidence") < floor))

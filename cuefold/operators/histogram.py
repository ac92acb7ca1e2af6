"""Gray histograms and what they say about a glyph image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuefold.functions.binding import let

BINS = 256
# Shares and distances of peaks by which repairs are chosen.
BACKGROUND_FROM, BACKGROUND_SHARE = 250, 0.40
LIGHT_MASS, DARK_RATIO, PEAK_GAP, LIGHT_MAX = 100, 0.85, 64, 235
FILL_LEAST, FILL_SHARE, FILL_LOW, FILL_MOST, FILL_STEP, SHOULDER = 50, 0.005, 64, 0.35, 24, 8
HOLLOW_BLACK_TO, HOLLOW_WHITE_FROM, HOLLOW_BOTH, HOLLOW_LEAST, HOLLOW_MOST = 16, 240, 0.97, 0.02, 0.5
BLANK_DEVIATION = 0.001


def histogram(df: DataFrame, key: str, value: str) -> DataFrame:
    """``key, bins, total, mean, deviation`` of gray values 0..255, one row per value.

    Values are counted before they are gathered, so a row of ``bins`` is 256 counts of
    whatever size the image.  Mean and deviation are of values scaled to 0..1.
    """
    counts = df.groupBy(key, F.col(value).cast("int").alias("g")).agg(F.count("*").alias("n")).where(F.col("g").between(0, BINS - 1))
    packed = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("g", "n"))).alias("m"))
    bins = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda g: F.coalesce(F.try_element_at(F.col("m"), g), F.lit(0)).cast("long"))
    return packed.select(key, let(bins, _described).alias("h")).select(key, "h.*")


def _described(bins: Column) -> Column:
    """``struct<bins, total, mean, deviation>``."""
    add = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)
    sums = F.struct(
        add(bins).alias("n"), add(F.transform(bins, lambda n, g: n * g)).alias("s1"), add(F.transform(bins, lambda n, g: n * g * g)).alias("s2")
    )
    return let(
        sums,
        lambda s: F.struct(
            bins.alias("bins"), s["n"].alias("total"), (s["s1"] / s["n"] / 255).alias("mean"),
            (F.sqrt(F.greatest(F.lit(0.0), s["s2"] / s["n"] - F.pow(s["s1"] / s["n"], 2))) / 255).alias("deviation"),
        ),
    )


def _mass(bins: Column, lo: int, hi: int) -> Column:
    return F.aggregate(F.slice(bins, lo + 1, hi - lo + 1), F.lit(0).cast("long"), lambda a, x: a + x)


def _peak(bins: Column, lo: int, hi: int) -> Column:
    """The smallest value with the largest count in a range."""
    part = F.slice(bins, lo + 1, hi - lo + 1)
    return F.array_position(part, F.array_max(part)).cast("int") - 1 + lo


def shadow_strip(bins: Column, total: Column) -> Column:
    """Band ``struct<low, high>``, in percent, between the two midpoints around a light glyph in a dark shadow, else null.

    The image needs a white background, a light and a dark tone of similar mass and peaks
    well apart.
    """
    light_lo = 128
    facts = lambda b: F.struct(
        _mass(b, light_lo, BACKGROUND_FROM - 1).alias("light"), _mass(b, 0, light_lo - 1).alias("dark"), _mass(b, BACKGROUND_FROM, 255).alias("back"),
        _peak(b, light_lo, BACKGROUND_FROM - 1).alias("lp"), _peak(b, 0, light_lo - 1).alias("dp"),
    )

    def band(x: Column) -> Column:
        fits = (
            (total > 0) & (x["back"] >= BACKGROUND_SHARE * total) & (x["light"] >= LIGHT_MASS) & (x["dark"] >= DARK_RATIO * x["light"])
            & (x["lp"] - x["dp"] >= PEAK_GAP) & (x["lp"] <= LIGHT_MAX)
        )
        return F.when(fits, F.struct(_percent((x["lp"] + x["dp"]) / 2).alias("low"), _percent((x["lp"] + 255) / 2).alias("high")))

    return let(bins, lambda b: let(facts(b), band))


def _percent(gray: Column) -> Column:
    return F.floor(gray / 255 * 100 + 0.5).cast("int")


def hollow_fill(bins: Column, total: Column) -> Column:
    """Whether an image is nearly all black and white with a fair share of white: glyphs drawn as outlines."""
    facts = lambda b: F.struct(_mass(b, HOLLOW_WHITE_FROM, 255).alias("white"), _mass(b, 0, HOLLOW_BLACK_TO).alias("black"))
    fits = lambda x: (
        (total > 0) & (x["black"] + x["white"] >= HOLLOW_BOTH * total) & (x["white"] >= HOLLOW_LEAST * total) & (x["white"] <= HOLLOW_MOST * total)
    )
    return let(bins, lambda b: let(facts(b), fits))


def fill_threshold(bins: Column, total: Column) -> Column:
    """Percent at which the brightest tone alone is kept, null where it is no fill."""
    least = F.greatest(F.lit(float(FILL_LEAST)), total * FILL_SHARE)
    # The values that count, and those that don't, in order.
    split = lambda b: let(
        least,
        lambda m: F.struct(
            F.filter(F.sequence(F.lit(0), F.lit(255)), lambda g: F.element_at(b, g + 1) >= m).alias("big"),
            F.filter(F.sequence(F.lit(0), F.lit(255)), lambda g: F.element_at(b, g + 1) < m).alias("small"),
        ),
    )

    def decide(b: Column, x: Column) -> Column:
        peak = F.array_max(F.filter(x["big"], lambda g: g >= FILL_LOW))
        # The cluster goes down from the peak while a value counts or is within the shoulder.
        low = lambda p: F.coalesce(F.array_max(F.filter(x["small"], lambda g: (g < p) & (p - g >= SHOULDER))), F.lit(-1))
        found = lambda p: let(
            low(p),
            lambda l: F.struct(
                p.alias("peak"), F.aggregate(F.slice(b, l + 2, p - l), F.lit(0).cast("long"), lambda a, v: a + v).alias("mass"),
                F.array_max(F.filter(x["big"], lambda g: g < l)).alias("below"),
            ),
        )
        answer = lambda r: F.when(
            (r["mass"] <= FILL_MOST * total) & (r["peak"] - r["below"] >= FILL_STEP), _percent((r["peak"] + r["below"]) / 2)
        )
        return let(peak, lambda p: F.when(p.isNotNull(), let(found(F.coalesce(p, F.lit(255))), answer)))

    return let(bins, lambda b: let(split(b), lambda x: decide(b, x)))

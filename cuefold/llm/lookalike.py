"""Texts that look the same: character tables and one consistent form per text.

The tables are built from the Unicode database by rule; only letters of other
scripts that resemble Latin ones are listed, as no property names them.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuefold.session import cut

# Letters of other scripts and the Latin letter each looks like.
CONFUSABLE = {
    # Cyrillic capitals and small letters
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ї": "Ï", "Ј": "J", "К": "K", "М": "M", "Н": "H",
    "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѵ": "V", "Ү": "Y", "Һ": "h", "Ӏ": "I",
    "Ԁ": "d", "Ԛ": "Q", "Ԝ": "W", "Ё": "Ë", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c",
    "у": "y", "х": "x", "ѕ": "s", "і": "i", "ї": "ï", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "ѵ": "v", "ӏ": "l", "ё": "ë", "ү": "y", "ѐ": "è", "Ӓ": "Ä", "ӓ": "ä", "Ӧ": "Ö", "ӧ": "ö",
    # Greek capitals and small letters
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
    "ό": "ó", "Ά": "Á", "Έ": "É", "Ή": "H́", "Ί": "Í", "Ό": "Ó", "Ύ": "Ý", "ι": "i", "α": "a", "ρ": "p",
    # Armenian, Cherokee, Coptic and Latin-like letters of other blocks
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "Ս": "U", "Օ": "O", "Ꭺ": "A", "Ꭼ": "E", "Ꮋ": "H",
    "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z", "Ꮯ": "C",
    "Ⲟ": "O", "ⲟ": "o", "ɑ": "a", "ɡ": "g", "ǀ": "l",
}
# Latin ligatures the Unicode database gives no decomposition for.
PLAIN_LIGATURE = {"œ": "oe", "Œ": "OE", "æ": "ae", "Æ": "AE"}

_LOOKS_ALIKE = {"<wide>", "<narrow>", "<font>", "<noBreak>"}
_HIDDEN_FILLERS = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0x180B, 0x180F)}
_KEPT_CONTROLS = "\n\v\f\r\x85"


@lru_cache(1)
def tables() -> tuple[dict[str, str], dict[str, str]]:
    """(one character to at most one, one character to several), from the Unicode database."""
    single: dict[str, str] = {}
    several: dict[str, str] = {}
    for cp in [*range(0x0, 0xD800), *range(0xE000, 0x1100), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0xE0000, 0xE0200)]:
        c = chr(cp)
        kind = unicodedata.category(c)
        tag, *rest = unicodedata.decomposition(c).split() or [""]
        if c == "\t" or kind == "Zs":
            single[c] = " "
        elif kind == "Cf" or cp in _HIDDEN_FILLERS or (kind == "Cc" and c not in _KEPT_CONTROLS):
            single[c] = ""
        elif tag in _LOOKS_ALIKE and len(rest) == 1:
            single[c] = unicodedata.normalize("NFKC", c)
        elif tag == "<compat>" and "LATIN" in unicodedata.name(c, "") and "LIGATURE" in unicodedata.name(c, ""):
            several[c] = unicodedata.normalize("NFKC", c)
    for c, to in (CONFUSABLE | PLAIN_LIGATURE).items():
        (single if len(to) == 1 else several)[c] = to
    for c, to in list(single.items()):
        to = CONFUSABLE.get(to, to)
        if len(to) > 1 or to == c:
            del single[c]
        else:
            single[c] = to
    return single, several


@lru_cache(1)
def translation() -> tuple[str, str]:
    """Arguments of translate(): characters that vanish come last, without a partner."""
    single, _ = tables()
    shown = sorted(c for c, to in single.items() if to)
    gone = sorted(c for c, to in single.items() if not to)
    return "".join(shown + gone), "".join(single[c] for c in shown)


@lru_cache(1)
def folding() -> tuple[str, str]:
    """translate() arguments that lower letters and strip the accents of composed ones."""
    pairs = {}
    for cp in [*range(0x41, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        c = chr(cp)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x)).lower()
        if unicodedata.category(c)[0] == "L" and len(base) == 1 and base != c:
            pairs[c] = base
    return "".join(pairs), "".join(pairs.values())


#: Images that may hold a pair are broadcast up to this many; beyond, both sides are shuffled.
MOST_IMAGES = 200_000

_NOT_PLAIN = r"[^\x20-\x7E\n]"


def mapped(text: Column) -> Column:
    """``text`` with every look-alike character mapped; accents and letter case stay.

    Composed and combining accents are not unified here: that is left to the
    accent-sensitive collation.  Null stays null, and plain ASCII passes untouched.
    """
    source, target = translation()
    _, several = tables()
    out = F.translate(F.regexp_replace(text, r"\r\n?", "\n"), source, target)
    for c, to in several.items():
        out = F.replace(out, F.lit(c), F.lit(to))
    return F.when(text.rlike(_NOT_PLAIN), out).otherwise(text)


def bare(shape: Column) -> Column:
    """Letters and digits of a look-alike-mapped text without markup, accents and case.

    Null and blank texts give null.  Plain ASCII takes a shorter way to the same result.
    """
    source, target = folding()
    shown = F.when(shape.rlike(r"[<{]"), F.regexp_replace(shape, r"<[^>]*>|\{[^}]*\}", "")).otherwise(shape)
    plain = F.regexp_replace(F.lower(shown), "[^a-z0-9]+", "")
    any_letters = F.regexp_replace(F.translate(shown, source, target), r"[^\p{L}\p{N}]+", "")
    return F.when(shape.rlike(r"\S"), F.when(shape.rlike(_NOT_PLAIN), any_letters).otherwise(plain))


def canonical_forms(texts: DataFrame, text: str, within: list[str] | None = None, several: bool = False) -> DataFrame:
    """(within, text, canonical): each distinct non-null text and the member that stands for its class.

    Look-alike-mapped texts are grouped under the accent-sensitive ``UNICODE``
    collation, so canonically equivalent sequences and characters without weight
    compare equal while case and accents separate.  The member with the fewest
    characters beyond plain ASCII, then the shortest, then the smallest, is canonical.
    Classes are those of the rows equal in the columns ``within``, else of all rows;
    ``several`` leaves out classes of a single text.
    """
    spark, keys = texts.sparkSession, within or []
    keyed = (
        texts.where(F.col(text).isNotNull()).groupBy(*keys, F.col(text).alias("text")).agg(F.lit(1).alias("one"))
        .select(*keys, "text", mapped(F.col("text")).alias("shape"))
    )
    grouped = "".join(f"`{k}`, " for k in keys)
    members = spark.sql(
        f"""
        SELECT {grouped}collate(shape, 'UNICODE') AS shape,
               min_by(text, struct(length(regexp_replace(text, '[\\\\x20-\\\\x7E\\\\n]', '')), length(text), text)) AS canonical
        FROM {{keyed}} GROUP BY {grouped}collate(shape, 'UNICODE') {"HAVING count(*) > 1" if several else ""}
        """,
        keyed=keyed,
    )
    same = "".join(f"k.`{k}` = m.`{k}` AND " for k in keys)
    return spark.sql(
        f"""
        SELECT {"".join(f"k.`{k}`, " for k in keys)}k.text, m.canonical FROM {{keyed}} k JOIN {{members}} m
        ON {same}collate(k.shape, 'UNICODE') = m.shape
        """,
        keyed=keyed, members=members,
    )


def with_canonical(df: DataFrame, text: str, out: str = "canonical") -> DataFrame:
    """``df`` with the canonical form of ``text`` in column ``out``.

    Null texts get null, the empty text itself.  Rows keep their number: repeated
    rows and every other column pass through, and an empty input stays empty.
    ``out`` must be a new column name.  A text that fills a large share of the
    rows makes one partition of the join large, which adaptive execution splits.
    """
    if out in df.columns:
        raise ValueError(f"column {out} exists")
    forms = canonical_forms(df.select(text), text).select(F.col("text").alias("__text"), F.col("canonical").alias(out))
    return df.join(forms, df[text] == F.col("__text"), "left").drop("__text")


def alike_readings(readings: DataFrame, image: list[str], reading_id: str, text: str) -> DataFrame:
    """Pairs of readings of one image whose non-empty texts differ but look the same.

    Result: ``a, b`` with a < b, ids of ``reading_id``.  Repeated rows count once;
    rows with a null in ``image`` or in the id belong to no pair.

    Only images with different texts, one of them beyond plain ASCII, can hold a pair
    (plain texts look the same only if they are), and only those are canonicalised.
    Spellings of a class are paired first and their readings after, so copies of one
    text never meet each other.
    """
    keys = [f"i{k}" for k in range(len(image))]
    rows = (
        readings.select(*[F.col(c).alias(k) for k, c in zip(keys, image, strict=True)], F.col(reading_id).alias("id"), F.col(text).alias("text"))
        .where("text <> ''").dropna()
    )
    spelt = F.xxhash64("text")
    several = (
        rows.groupBy(*keys).agg(F.min(spelt).alias("lo"), F.max(spelt).alias("hi"), F.max(F.col("text").rlike(_NOT_PLAIN)).alias("odd"))
        .where("lo <> hi and odd").select(*keys)
    )
    several = cut(several)
    if several.count() <= MOST_IMAGES:
        several = F.broadcast(several)
    rows = cut(rows.join(several, keys, "left_semi").distinct())
    forms = cut(canonical_forms(rows, "text", keys, several=True))
    pairs = forms.withColumnRenamed("text", "ta").join(forms.withColumnRenamed("text", "tb"), [*keys, "canonical"]).where("ta < tb").drop("canonical")
    a, b = rows.withColumnsRenamed({"id": "a", "text": "ta"}), rows.withColumnsRenamed({"id": "b", "text": "tb"})
    return pairs.join(a, [*keys, "ta"]).join(b, [*keys, "tb"]).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()

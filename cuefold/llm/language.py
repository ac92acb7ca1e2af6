"""Language of texts and of their segments by rank-order n-gram profiles.

A profile is the list of a language's most frequent character n-grams by rank.  A
unit's own n-grams (a line's or sentence's) are ranked likewise, and its out-of-place
distance to a language sums how far each n-gram's rank is from its rank in the
profile, or the greatest distance if the profile lacks it.  The nearest language
wins, with the relative lead over the next one as confidence.  A unit with fewer
n-grams of the nearest profile than nearly all fitted units of its size is in some
``OTHER`` language.

Which languages a group of texts is in is decided on evidence summed over the group:
the distances of all units that went to a language are added up, and only where they
are clearly nearer to it than to the group's main language does it count.  So short
units back a language together, and a few misread ones do not.

Profiles are fitted on a bounded sample of labelled texts (``SAMPLE``); labels may be
wrong, so the sample is labelled anew by the first profiles and those are fitted
again.  Everything else covers all rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuefold.llm.codes import fold
from cuefold.session import spread

#: Labelled texts that profiles are fitted on, at most, and the longest text among them.
SAMPLE, SAMPLE_CHARS = 12_000, 4_000
#: N-grams of a profile, and the distance of one that a profile lacks.
TOP = 400
#: Longest n-gram.
LONGEST = 4
#: Relative lead under which a unit counts as undecided.
LEAD = 0.02
#: Relative lead, summed over its units, that a language needs beside the main one of a group.
GROUP_LEAD = 0.25
#: And by how many n-grams, each counted as one the other profile lacks.
GROUP_GRAMS = 8
#: A unit is in no fitted language if it knows fewer n-grams than all but this share of the fitted units,
#: by this factor: texts on other matters than the sample's have fewer known n-grams too.
STRANGE, SLACK = 0.005, 0.85
#: Refits of the profiles on their own labels.
REFITS = 2
#: Characters compared at a time.
CHUNK = 150_000
#: Parts into which the copies of one text are dealt.
SALTS = 64
#: Name of any language without a profile.
OTHER = "other"

# Codes naming one language, by its bibliographic three-letter code.
CODES = {
    "eng": ["eng", "en", "english"], "fre": ["fre", "fra", "fr", "french"], "ger": ["ger", "deu", "de", "german"],
    "spa": ["spa", "es", "spanish"], "ita": ["ita", "it", "italian"], "dut": ["dut", "nld", "nl", "dutch"],
}


def language_of_code(code: Column) -> Column:
    """The bibliographic code of a label, null where it names no single known language."""
    bare = F.regexp_extract(F.lower(F.trim(code)), r"^([a-z]+)(?:[-_].*)?$", 1)
    out = F.lit(None).cast("string")
    for to, names in CODES.items():
        out = F.when(bare.isin(names), F.lit(to)).otherwise(out)
    return out


@dataclass
class Profiles:
    """``grams``: sorted n-gram codes; ``ranks[l, g]``: rank of g in language l, TOP if absent.

    ``floors[b]``: least share of known n-grams of a unit with 2^b to 2^(b+1) n-grams; 0 where unknown.
    """

    languages: list[str]
    grams: np.ndarray
    ranks: np.ndarray
    floors: np.ndarray = field(default_factory=lambda: np.zeros(64))

    @property
    def names(self) -> list[str]:
        """The languages, and ``OTHER`` behind them."""
        return [*self.languages, OTHER]


class Finder:
    """Where a profile's n-grams stand, by a table without collisions."""

    def __init__(self, grams: np.ndarray):
        rng = np.random.default_rng(3)
        for bits in range(16, 27):
            for _ in range(8):
                self.factor, self.shift = np.uint64(rng.integers(1 << 62) * 2 + 1), np.uint64(64 - bits)
                at = self._at(grams)
                if len(np.unique(at)) == len(grams):
                    self.table = np.full(1 << bits, len(grams), np.int32)
                    self.table[at] = np.arange(len(grams))
                    self.grams = np.append(grams, np.uint64(0))
                    return
        raise ValueError("n-grams repeat")

    def _at(self, grams: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (grams * self.factor) >> self.shift

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        """The number of each n-gram, -1 where the profiles lack it."""
        at = self.table[self._at(grams)]
        return np.where(self.grams[at] == grams, at, -1)


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, text number), words separated by one blank, anything but letters dropped."""
    c = fold("\n\n".join(t.replace("\n", " ").replace("\r", " ") for t in texts) + "\n\n")
    # Two line feeds end a text; single ones do not occur.
    owner = np.cumsum(np.concatenate(([0], c[:-1] == 10))) // 2
    letter = (c > 0x40) & ~((c > 0x5A) & (c < 0x61)) & ~((c > 0x7A) & (c < 0xC0)) & (c < 0x2000)
    letter |= (c >= 0x3040) & (c < 0xFF00)
    c = np.where(letter, c, 32)
    keep = letter | np.concatenate(([True], letter[:-1])) | (np.diff(owner, prepend=-1) > 0)
    return c[keep].astype(np.uint64), owner[keep]


def _grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n-gram code, text number) of all n-grams of each length; a blank only begins or ends one."""
    c, owner = _letters(texts)
    blank, g = c == 32, c
    for n in range(1, LONGEST + 1):
        if len(c) < n:
            return
        if n > 1:
            g = (g[:-1] << np.uint64(16)) | (c[n - 1 :] & np.uint64(0xFFFF))
        ok = owner[: len(g)] == owner[n - 1 :]
        if n == 1:
            ok = ~blank
        elif n == 2:
            ok &= ~(blank[:-1] & blank[1:])
        for k in range(1, n - 1):
            ok &= ~blank[k : k + len(g)]
        yield g[ok], owner[: len(g)][ok]


def fit(texts: list[str], labels: list[str], top: int = TOP) -> Profiles:
    """Rank-order profiles of the labelled texts."""
    languages = sorted(set(labels))
    parts = list(_grams(texts)) or [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    g, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
    lang = np.array([languages.index(x) for x in labels], np.int64)[owner] if len(g) else owner
    lists = []
    for k in range(len(languages)):
        grams, counts = np.unique(g[lang == k], return_counts=True)
        lists.append(grams[np.lexsort((grams, -counts))][:top])
    vocabulary = np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.uint64)
    ranks = np.full((len(languages), len(vocabulary)), top, np.int32)
    for k, grams in enumerate(lists):
        ranks[k, np.searchsorted(vocabulary, grams)] = np.arange(len(grams))
    return Profiles(languages, vocabulary, ranks)


def distances(texts: list[str], profiles: Profiles, finder: Finder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Out-of-place distance (languages x texts), n-grams of each text, and those in its nearest profile."""
    n, size = len(texts), len(profiles.grams)
    total, keys = np.zeros(n, np.int64), []
    for g, owner in _grams(texts):
        total += np.bincount(owner, minlength=n)
        at = finder(g)
        keys.append((owner * size + at)[at >= 0])
    key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    key.sort()
    first = np.flatnonzero(np.diff(key, prepend=-1))
    count = np.diff(np.append(first, len(key)))
    who, gram = np.divmod(key[first], size)
    # Rank n-grams within a text by count, then by code: one sort of packed numbers.
    most = 0xFFFF
    packed = (who << 36) | ((most - np.minimum(count, most)) << 20) | gram
    packed.sort()
    who, gram, count = packed >> 36, packed & 0xFFFFF, most - (packed >> 20 & most)
    rank = np.minimum(np.arange(len(who)) - np.searchsorted(who, np.arange(n))[who], TOP)
    dist, hits = np.empty((len(profiles.languages), n)), np.empty((len(profiles.languages), n))
    for k, ranks in enumerate(profiles.ranks):
        r = ranks[gram]
        dist[k] = np.bincount(who, weights=np.where(r < TOP, np.abs(r - rank), TOP), minlength=n)
        hits[k] = np.bincount(who, weights=count * (r < TOP), minlength=n)
    return dist, total, hits[dist.argmin(0), np.arange(n)]


def _judged(dist: np.ndarray, total: np.ndarray, hits: np.ndarray, profiles: Profiles) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language number or -1, confidence, n-grams missing from the floor) of each text; ``len(languages)`` is ``OTHER``."""
    two = np.partition(dist, 1, axis=0)
    lead = np.where(two[1] > 0, 1 - two[0] / np.maximum(two[1], 1e-9), 0.0)
    missing = profiles.floors[np.log2(np.maximum(total, 1)).astype(int)] * total - hits
    found = np.where(lead >= LEAD, dist.argmin(0), -1)
    confidence = np.where(missing > 0, missing / np.maximum(total, 1), np.where(lead >= LEAD, lead, 0.0))
    return np.where(missing > 0, len(profiles.languages), found), confidence, np.maximum(missing, 0)


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    a, size = 0, 0
    for b, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield a, b
            a, size = b, 0
        size += len(t) + 1
    if a < len(texts):
        yield a, len(texts)


def _compared(texts: list[str], profiles: Profiles, finder: Finder | None) -> tuple[np.ndarray, ...]:
    """(language number or -1, confidence, missing n-grams, distances) of each text."""
    n, languages = len(texts), len(profiles.languages)
    if finder is None or languages < 2:
        return np.full(n, 0 if languages == 1 else -1), np.zeros(n), np.zeros(n), np.zeros((languages, n))
    parts = []
    for a, b in _chunks(texts):
        d = distances(texts[a:b], profiles, finder)
        parts.append((*_judged(*d, profiles), d[0]))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros((languages, 0))
    return tuple(np.concatenate(x, axis=-1) for x in zip(*parts, strict=True))


def _finder(profiles: Profiles) -> Finder | None:
    return Finder(profiles.grams) if len(profiles.grams) else None


def classify(texts: list[str], profiles: Profiles) -> tuple[np.ndarray, np.ndarray]:
    """(language number, confidence) of each text: -1 if undecided, ``len(languages)`` if ``OTHER``."""
    return _compared(texts, profiles, _finder(profiles))[:2]


def _floors(texts: list[str], profiles: Profiles) -> np.ndarray:
    """The floors of the fitted texts, for sizes of which there are a hundred or more."""
    out, finder = np.zeros(64), _finder(profiles)
    if finder is None or len(profiles.languages) < 2:
        return out
    parts = [distances(texts[a:b], profiles, finder)[1:] for a, b in _chunks(texts)]
    total, hits = (np.concatenate(x) for x in zip(*parts, strict=True))
    size = np.log2(np.maximum(total, 1)).astype(int)
    for b in np.flatnonzero(np.bincount(size) >= 100):
        out[b] = SLACK * np.quantile(hits[size == b] / np.maximum(total[size == b], 1), STRANGE)
    return out


def fit_profiles(segments: DataFrame, text: str, label: str, sample: int = SAMPLE, refits: int = REFITS) -> Profiles:
    """Profiles from at most ``sample`` labelled texts, chosen by a hash of their text; texts over ``SAMPLE_CHARS`` are not chosen."""
    rows = (
        segments.where(F.col(text).rlike(r"\p{L}") & (F.length(text) <= SAMPLE_CHARS) & F.col(label).isNotNull())
        .select(F.col(text).alias("t"), F.col(label).alias("l"))
        .orderBy(F.xxhash64("t"), "t", "l").limit(sample).collect()
    )
    texts, labels = [r.t for r in rows], [r.l for r in rows]
    profiles = fit(texts, labels)
    for _ in range(refits):
        found, _lead = classify(texts, profiles)
        kept = [(t, profiles.languages[k]) for t, k in zip(texts, found, strict=True) if k >= 0]
        if len({x for _, x in kept}) < len(profiles.languages):
            break
        profiles = fit([t for t, _ in kept], [x for _, x in kept])
    # Lines are what is judged later on.
    profiles.floors = _floors([x for t in texts for x in _lines(t)], profiles)
    return profiles


_SENTENCE = re.compile(r"[^.!?…\n]+[.!?…]*\s*|\S[^\n]*\n?|\n")
_NOT_TEXT = re.compile(r"^[^\n]*-->[^\n]*$|^[ \t]*\d+[ \t]*\r?$|<[^>\n]*>|\{[^}\n]*\}", re.M)


def _lines(text: str) -> list[str]:
    return [x for x in text.split("\n") if x.strip()]


def _sentences(text: str) -> list[str]:
    return [x for x in _SENTENCE.findall(_NOT_TEXT.sub(" ", text)) if x.strip()]


def _units(texts: list[str], unit: str) -> tuple[list[str], np.ndarray]:
    """All units of the texts and how many each has."""
    cut_up = _lines if unit == "line" else _sentences
    parts = [cut_up(t) for t in texts]
    return [x for p in parts for x in p], np.array([len(p) for p in parts], np.int64)


def _compared_once(units: list[str], profiles: Profiles, finder: Finder | None) -> tuple[np.ndarray, ...]:
    """As :func:`_compared`, each different unit compared once."""
    number, different = pd.factorize(np.array(units, dtype=object))
    return tuple(x[..., number] for x in _compared(list(different), profiles, finder))


def _segmenter(profiles: Profiles, unit: str, width: int):
    names = np.array([*profiles.names, None], dtype=object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = _finder(profiles)
        for pdf in batches:
            units, count = _units(pdf["text"].tolist(), unit)
            if not units:
                continue
            language, confidence, _missing, _dist = _compared_once(units, profiles, finder)
            size = np.array([len(x.strip()) for x in units], float)
            owner = np.repeat(np.arange(len(pdf)), count)
            place = np.arange(len(units)) - np.repeat(np.cumsum(count) - count, count)
            # An undecided unit goes with the decided one before it, at the beginning of a text with the one after it.
            decided = language >= 0
            before = np.maximum.accumulate(np.where(decided, np.arange(len(units)), -1))
            after = np.minimum.accumulate(np.where(decided, np.arange(len(units)), len(units))[::-1])[::-1]
            own = np.where((before >= 0) & (owner[before] == owner), before, np.where((after < len(units)) & (owner[np.minimum(after, len(units) - 1)] == owner), after, -1))
            filled = np.where(own >= 0, language[own], -1)
            first = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(filled, prepend=-2) != 0))
            last = np.append(first[1:], len(units)) - 1
            chars = np.add.reduceat(size, first)
            out = {c: pdf[c].to_numpy(dtype=object)[owner[first]] for c in pdf.columns[:width]}
            out |= {
                "segment": np.arange(len(first)) - np.searchsorted(owner[first], owner[first]), "first": place[first], "last": place[last],
                "units": last - first + 1, "decided": np.add.reduceat(decided.astype(np.int64), first), "chars": chars.astype(np.int64),
                "language": names[filled[first]], "confidence": np.add.reduceat(confidence * size, first) / np.maximum(chars, 1),
            }
            yield pd.DataFrame(out)

    return run


SEGMENT = "segment int, first int, last int, units int, decided int, chars int, language string, confidence double"


def segment_languages(df: DataFrame, keys: list[str], text: str, profiles: Profiles, unit: str = "line") -> DataFrame:
    """``keys`` and, one row each, the stretches of one language of each text.

    A segment has its number and its ``first`` and ``last`` unit (lines or sentences with text,
    from 0), how many units it has and how many were decided on their own, its length, ``language``
    and ``confidence`` (0 to 1).  Units without letters or without a clear lead go with the
    stretch they stand in; a text with no decided unit has one segment without a language.
    Null and blank texts have no segment.  Rows are independent, so repeated ones repeat theirs.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    rows = df.select(*[F.col(k).alias(f"k{j}") for j, k in enumerate(keys)], F.col(text).alias("text")).where("text is not null")
    schema = ", ".join(f"k{j} {kinds[k]}" for j, k in enumerate(keys)) + f", {SEGMENT}"
    out = spread(rows).mapInPandas(_segmenter(profiles, unit, len(keys)), schema)
    return out.withColumnsRenamed({f"k{j}": k for j, k in enumerate(keys)})


def _counter(profiles: Profiles, width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = _finder(profiles)
        for pdf in batches:
            group = pdf.groupby(list(pdf.columns[:width]), dropna=False).ngroup().to_numpy()
            number, different = pd.factorize(pdf["text"])
            units, count = _units(list(different), "line")
            if not units:
                continue
            found = _compared_once(units, profiles, finder)
            # Units of each row: those of its text.
            many = count[number]
            row = np.repeat(np.arange(len(pdf)), many)
            at = (np.cumsum(count) - count)[number][row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            language, confidence, missing, dist = (x[..., at] for x in found)
            keep = language >= 0
            row, at, language, confidence, missing, dist = row[keep], at[keep], language[keep], confidence[keep], missing[keep], dist[:, keep]
            if not len(row):
                continue
            n = pdf["n"].to_numpy()[row]
            chars = np.array([len(x.strip()) for x in units])[at] * n
            _, first, of = np.unique(group[row] * (len(profiles.languages) + 1) + language, return_index=True, return_inverse=True)
            add = lambda x: np.bincount(of, weights=x)
            out = {c: pdf[c].to_numpy(dtype=object)[row[first]] for c in pdf.columns[:width]}
            out |= {
                "language": language[first], "units": add(n).astype(np.int64), "chars": add(chars).astype(np.int64),
                "sure": add(confidence * chars), "missing": add(missing * n),
            }
            out |= {f"d{k}": add(d * n) for k, d in enumerate(dist)}
            yield pd.DataFrame(out)

    return run


def count_languages(df: DataFrame, keys: list[str], ident: str, text: str, profiles: Profiles, together: list[str] | None = None) -> DataFrame:
    """Per group ``keys`` and language number the lines that are in it, and their summed evidence.

    Result: ``keys, language, units, chars, sure, missing`` and ``d0, d1, ...``, the distances
    of those lines to each language.  ``ident`` is the id of a text; a repeated row counts
    once.  Copies of a text in a group are compared once: rows are partitioned by text, dealt
    by the columns ``together`` (the id if there are none), so that a text which fills a third
    of all rows fills no partition.  Undecided lines and null texts count nowhere.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    salt = F.pmod(F.xxhash64(*(together or [ident])), F.lit(SALTS))
    rows = df.select(*[F.col(k).alias(f"k{j}") for j, k in enumerate(keys)], F.col(text).alias("text"), F.col(ident).alias("id"), salt.alias("salt"))
    names = [f"k{j}" for j in range(len(keys))]
    texts = (
        rows.where("text is not null").repartition("text", "salt").distinct()
        .groupBy(*names, "text", "salt").agg(F.count("*").alias("n")).drop("salt")
    )
    d = [f"d{k}" for k in range(len(profiles.languages))]
    schema = ", ".join(f"k{j} {kinds[k]}" for j, k in enumerate(keys)) + ", language int, units long, chars long, sure double, missing double"
    counted = texts.mapInPandas(_counter(profiles, len(keys)), ", ".join([schema, *[f"{x} double" for x in d]]))
    return (
        counted.groupBy(*names, "language").agg(*[F.sum(c).alias(c) for c in ["units", "chars", "sure", "missing", *d]])
        .withColumnsRenamed({f"k{j}": k for j, k in enumerate(keys)})
    )


def language_shares(counts: DataFrame, keys: list[str], profiles: Profiles, least_share: float) -> DataFrame:
    """Languages of each group ``keys``: those of at least ``least_share`` of its decided lines.

    ``counts`` comes from :func:`count_languages`.  The language of most lines is the main one.
    Another one counts if its lines together are nearer to it than to the main one, by
    ``GROUP_LEAD`` of the distance and by ``GROUP_GRAMS`` n-grams; ``OTHER`` counts if its
    lines together lack that many.  Lines of languages that don't count go to the one of those
    that do to which they are nearest.  Result: ``keys, language, units, share, confidence``.
    """
    languages = len(profiles.languages)
    if not languages:
        return counts.select(*keys, F.lit(None).cast("string").alias("language"), "units", F.lit(None).cast("double").alias("share"), F.lit(None).cast("double").alias("confidence")).where("false")
    known = F.col("language") < languages
    entry = F.struct("language", "units", "chars", "sure", "missing", F.array(*[f"d{k}" for k in range(languages)]).alias("d"))
    # A group has at most as many entries as there are languages and OTHER.
    groups = counts.groupBy(*keys).agg(
        F.sum("units").alias("total"), F.max(F.struct(known, "units", -F.col("language"))).alias("most"), F.collect_list(entry).alias("all")
    ).withColumn("main", -F.col("most.col3"))

    def backed(x):
        to = lambda k: F.get(x["d"], k)
        nearer = to(F.col("main")) - to(x["language"])
        alone = (nearer >= GROUP_LEAD * to(F.col("main"))) & (nearer >= GROUP_GRAMS * TOP)
        return F.when(x["language"] == F.col("main"), True).when(x["language"] == languages, x["missing"] >= GROUP_GRAMS).otherwise(alone)

    heard = F.transform(F.filter("all", backed), lambda x: x["language"])
    nearest = F.array_min(F.transform("heard", lambda k: F.struct(F.coalesce(F.get(F.col("x.d"), k), F.lit(float("inf"))).alias("far"), k.alias("language"))))
    own = F.array_contains("heard", F.col("x.language"))
    return (
        groups.withColumn("heard", heard).select(*keys, "total", "heard", F.explode("all").alias("x"))
        .withColumn("own", own).withColumn("to", F.when(F.col("own"), F.col("x.language")).otherwise(nearest["language"]))
        .groupBy(*keys, "total", "to")
        .agg(F.sum("x.units").alias("units"), F.max(F.when(F.col("own"), F.col("x.sure") / F.greatest(F.col("x.chars"), F.lit(1)))).alias("confidence"))
        .select(*keys, F.get(F.array(*[F.lit(x) for x in profiles.names]), F.col("to")).alias("language"), "units", (F.col("units") / F.col("total")).alias("share"), "confidence")
        .where(F.col("share") >= least_share - 1e-9)
    )


def label_cases(tracks: DataFrame, keys: list[str], code: str, shares: DataFrame) -> DataFrame:
    """Rows of ``shares`` whose group has a missing, unspecific or wrong label or several languages."""
    labelled = tracks.select(*keys, language_of_code(F.col(code)).alias("named")).distinct()
    per_group = shares.groupBy(*keys).agg(F.collect_set("language").alias("spoken"))
    cases = labelled.join(per_group, keys).where(
        F.col("named").isNull() | (F.size("spoken") > 1) | ~F.array_contains("spoken", F.col("named"))
    )
    return cases.select(*keys, F.explode("spoken").alias("language")).distinct()

"""Registered queries of the training-text operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuefold.llm.language import OTHER, count_languages, fit_profiles, label_cases, language_of_code, language_shares, segment_languages
from cuefold.llm.leaks import find_leaks
from cuefold.llm.lookalike import alike_readings, with_canonical
from cuefold.llm.nearest import nearest_in_time
from cuefold.llm.mixture import mix_sources
from cuefold.llm.runs import collapse_runs
from cuefold.llm.split import split_oversized
from cuefold.llm.tokens import TOKEN, token_count
from cuefold.session import millis, table

TOLERANCE_MS = 250
IMAGE = ["file", "track_id", "ord"]


def _nearest(spark, sf):
    return nearest_in_time(
        table(spark, sf, "ref_cue"), table(spark, sf, "cand_cue"), "file", millis("start"), millis("start"),
        F.col("cue_id"), F.col("cue_id"), TOLERANCE_MS,
    )


def p1_found(spark, sf):
    return _nearest(spark, sf).select(F.col("left_id").alias("ref_cue_id"), F.col("right_id").alias("cand_cue_id"))


def p1_pairs(spark, sf):
    """The pairs with both texts and the differences of start and end (candidate minus reference)."""
    pairs = _nearest(spark, sf)
    side = lambda name, key, s: (
        table(spark, sf, name)
        .select(F.col("cue_id").alias(key), F.col("text").alias(f"{s}_text"), millis("end").alias(f"{s}_end")).distinct()
    )
    return (
        pairs.join(side("ref_cue", "left_id", "ref"), "left_id").join(side("cand_cue", "right_id", "cand"), "right_id")
        .select(
            F.col("left_id").alias("ref_cue_id"), F.col("right_id").alias("cand_cue_id"), "ref_text", "cand_text",
            F.col("diff_ms").alias("start_diff_ms"), (F.col("cand_end") - F.col("ref_end")).alias("end_diff_ms"),
        )
    )


TRACK = ["file", "track_id"]
LEAST_SHARE = 0.2


def _track_profiles(spark, sf):
    labels = table(spark, sf, "track").select(*TRACK, language_of_code(F.col("language_code")).alias("label")).distinct()
    lines = table(spark, sf, "ocr_result").select(*TRACK, "text").where("text is not null")
    return fit_profiles(lines.join(labels, TRACK), "text", "label")


def p2_tracks(spark, sf):
    """The languages of each track with their share of its lines and a confidence."""
    profiles = _track_profiles(spark, sf)
    counts = count_languages(table(spark, sf, "ocr_result"), TRACK, "ocr_id", "text", profiles, IMAGE)
    return language_shares(counts, TRACK, profiles, LEAST_SHARE)


def p2_found(spark, sf):
    return label_cases(table(spark, sf, "track"), TRACK, "language_code", p2_tracks(spark, sf).where(F.col("language") != OTHER))


def p2_segments(spark, sf):
    """The stretches of one language in each reading."""
    segments = segment_languages(table(spark, sf, "ocr_result"), [*TRACK, "ord", "ocr_id"], "text", _track_profiles(spark, sf))
    return segments.select(*TRACK, "ord", "ocr_id", F.col("first").alias("first_line"), F.col("last").alias("last_line"), "language", "confidence").distinct()


def p2_documents(spark, sf):
    """The stretches of one language in each document, by sentence."""
    segments = segment_languages(table(spark, sf, "documents"), ["doc_id"], "text", _track_profiles(spark, sf), unit="sentence")
    return segments.select("doc_id", "segment", F.col("units").alias("sentences"), "language", "confidence").distinct()


def p3_found(spark, sf):
    return alike_readings(table(spark, sf, "ocr_result"), IMAGE, "ocr_id", "text").withColumnsRenamed({"a": "ocr_id_a", "b": "ocr_id_b"})


def _forms(spark, sf, *names):
    texts = None
    for name in names:
        t = table(spark, sf, name).select("text")
        texts = t if texts is None else texts.unionByName(t)
    return with_canonical(texts.where("text is not null").distinct(), "text").select("text", "canonical")


def p3_canonical(spark, sf):
    """Each distinct text of the three cue tables and its consistent form."""
    return _forms(spark, sf, "cue", "ref_cue", "cand_cue")


def p3_forms(spark, sf):
    """Each distinct text of ocr_result and the three cue tables and the one consistent form over all four."""
    return _forms(spark, sf, "ocr_result", "cue", "ref_cue", "cand_cue")


def _runs(spark, sf):
    return collapse_runs(table(spark, sf, "cue"), "file", "ord", "text", millis("start"), millis("end"))


def p4_found(spark, sf):
    return _runs(spark, sf).where("n >= 2").select("file", F.col("first").alias("first_ord"), F.col("last").alias("last_ord"))


def p4_runs(spark, sf):
    """One cue per run, single cues included, with its number of cues and duration."""
    return _runs(spark, sf).select(
        "file", F.col("first").alias("first_ord"), F.col("last").alias("last_ord"), F.col("n").alias("cues"), "duration_ms", "text"
    )


#: Share of an item's words, in order, from which a rewording is reported.
KEPT = 0.6


def _leaks(spark, sf, rewordings):
    return find_leaks(table(spark, sf, "documents"), table(spark, sf, "heldout_item"), "doc_id", "text", "item_id", "text", rewordings=rewordings, least_kept=KEPT)


def p6_leaks(spark, sf):
    """Tainted documents with the items they contain: whole runs of words, or reworded ones."""
    leaks = _leaks(spark, sf, True)
    return (
        leaks.withColumn("kind", F.when(F.col("run_words") > 0, "run").when(F.col("kept") >= 0.6, "reworded"))
        .where("kind is not null")
        .select(F.col("item").alias("item_id"), F.col("ident").alias("doc_id"), "kind", "run_words", "kept", "cosine")
    )


def p6_found(spark, sf):
    return _leaks(spark, sf, False).where("run_words > 0").select(F.col("item").alias("item_id"), F.col("ident").alias("doc_id"))


def p6_runs(spark, sf):
    """As p6_found, with the length of the longest shared run of words."""
    return _leaks(spark, sf, False).where("run_words > 0").select(F.col("item").alias("item_id"), F.col("ident").alias("doc_id"), F.col("run_words").cast("long").alias("run_words"))


def _mixture(spark, sf, tokens=None):
    tokens = token_count(F.col("text")) if tokens is None else tokens
    return mix_sources(table(spark, sf, "documents"), table(spark, sf, "mix_target"), "doc_id", "source", tokens)


def p7_found(spark, sf):
    """The sources that fall short in the drawn mixture: all their tokens are used as often as allowed, and stay below the share."""
    report = _mixture(spark, sf)[1]
    return report.where("used_tokens >= max_uses * tokens and used_tokens < weight * budget").select("source")


def p7_report(spark, sf):
    """Per source the wanted and the really reached share of the tokens of the mixture."""
    return _mixture(spark, sf)[1]


def p7_uses(spark, sf):
    """How often each document of a wanted source is used."""
    return _mixture(spark, sf)[0].withColumnRenamed("ident", "doc_id")


def _wanted():
    """Tokens wanted of a source: its share, or all it can give."""
    return F.least(F.col("weight") * F.col("budget"), (F.col("max_uses") * F.col("tokens")).cast("double"))


def p7_targets(spark, sf):
    """Per source what is wanted of it, and whether the drawn uses miss that by no more than its longest document."""
    uses, report = _mixture(spark, sf)
    longest = uses.groupBy("source").agg(F.max("tokens").alias("longest"))
    return report.join(longest, "source", "left").select(
        "source", "weight", "max_uses", "docs", "tokens", "budget", "falls_short", F.round(_wanted(), 3).alias("wanted"),
        (F.abs(F.col("used_tokens") - _wanted()) <= F.coalesce("longest", F.lit(0))).alias("reached"),
    )


def p7_limits(spark, sf):
    """Per document whether its uses are its source's expected ones, rounded down or up, and within ``max_uses``.

    ``tokens`` of a null text are null, as in the SQL.
    """
    uses, report = _mixture(spark, sf, F.when(F.col("text").isNotNull(), token_count(F.col("text"))))
    # A source without tokens has no rate: its documents are used nowhere.
    rates = report.select("source", "max_uses", F.when(F.col("tokens") > 0, _wanted() / F.col("tokens")).otherwise(F.lit(0.0)).alias("rate"))
    within = F.col("uses").between(F.floor(F.col("rate") + 1e-9), F.ceil(F.col("rate") - 1e-9)) & (F.col("uses") <= F.col("max_uses"))
    return uses.join(rates, "source").select(F.col("ident").alias("doc_id"), "source", "tokens", within.alias("within_uses"))


LIMIT, OVERLAP = 512, 64


def p8_pieces(spark, sf):
    """The ordered pieces of each oversized document."""
    return split_oversized(table(spark, sf, "documents"), "doc_id", "text", LIMIT, OVERLAP)


def p8_checked(spark, sf):
    """Per oversized document what its pieces must keep to: the limit, the overlap, their least number, and the text.

    The pieces of one document come together, so a row is as large as a document.
    """
    tokens = F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))
    fresh = F.slice("w", F.col("repeated") + 1, F.greatest(F.size("w") - F.col("repeated"), F.lit(0)).cast("int"))
    pieces = p8_pieces(spark, sf).withColumn("w", tokens).select(
        "doc_id", "doc_tokens", F.struct("piece", F.size("w").alias("n"), "repeated", F.slice("w", 1, OVERLAP).alias("head"), F.slice("w", -OVERLAP, OVERLAP).alias("tail"), fresh.alias("fresh")).alias("p"),
    )
    docs = pieces.groupBy("doc_id", "doc_tokens").agg(F.array_sort(F.collect_list("p")).alias("p"))
    overlapping = F.forall(F.sequence(F.lit(1), F.size("p") - 1), lambda k: (F.get("p.head", k) == F.get("p.tail", k - 1)) & (F.get("p.repeated", k) == OVERLAP))
    return docs.select(
        "doc_id", "doc_tokens", F.forall("p.n", lambda n: n <= LIMIT).alias("within_limit"), overlapping.alias("overlapping"),
        (F.size("p") >= F.ceil((F.col("doc_tokens") - OVERLAP) / (LIMIT - OVERLAP))).alias("enough"),
        F.md5(F.array_join(F.flatten("p.fresh"), " ")).alias("tokens_md5"),
    )


def p8_found(spark, sf):
    return p8_pieces(spark, sf).where("piece = 0").select("doc_id")


QUERIES = {
    "p1_found": p1_found, "p1_pairs": p1_pairs, "p2_found": p2_found, "p2_tracks": p2_tracks, "p2_segments": p2_segments,
    "p2_documents": p2_documents, "p3_found": p3_found, "p3_canonical": p3_canonical, "p3_forms": p3_forms,
    "p4_found": p4_found, "p4_runs": p4_runs,
    "p6_found": p6_found, "p6_leaks": p6_leaks, "p6_runs": p6_runs,
    "p7_found": p7_found, "p7_report": p7_report, "p7_uses": p7_uses, "p7_targets": p7_targets, "p7_limits": p7_limits,
    "p8_found": p8_found, "p8_pieces": p8_pieces, "p8_checked": p8_checked,
}


def _quoted(s: str) -> str:
    """A DuckDB string literal."""
    return "'" + s.replace("'", "''") + "'"


# Characters that look the same, listed for the SQL alone and not taken from the operator's tables.
_SPACES = "\t\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_UNSEEN = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufe0e\ufe0f\ufeff"
_FOREIGN = {
    "Latin": "ABCEHIJKMOPSTXYaceijopsxy",
    "Cyrillic": "\u0410\u0412\u0421\u0415\u041d\u0406\u0408\u041a\u041c\u041e\u0420\u0405\u0422\u0425\u0423\u0430\u0441\u0435\u0456\u0458\u043e\u0440\u0455\u0445\u0443",
    "Latin of Greek": "ABEZHIKMNOPTYXovi",
    "Greek": "\u0391\u0392\u0395\u0396\u0397\u0399\u039a\u039c\u039d\u039f\u03a1\u03a4\u03a5\u03a7\u03bf\u03bd\u03b9",
}
_JOINED = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\u0153": "oe", "\u0152": "OE", "\u00e6": "ae", "\u00c6": "AE"}


def _mapped(x: str) -> str:
    """SQL of a text with look-alike characters made one."""
    wide = "".join(chr(0xFF01 + k) for k in range(94))
    source = _FOREIGN["Cyrillic"] + _FOREIGN["Greek"] + wide + _SPACES + _UNSEEN
    target = _FOREIGN["Latin"] + _FOREIGN["Latin of Greek"] + "".join(chr(0x21 + k) for k in range(94)) + " " * len(_SPACES)
    x = f"translate(regexp_replace({x}, '\\r\\n?', chr(10), 'g'), {_quoted(source)}, {_quoted(target)})"
    for c, to in _JOINED.items():
        x = f"replace({x}, {_quoted(c)}, {_quoted(to)})"
    return f"nfc_normalize({x})"


_P1 = f"""
with r as (select distinct cue_id, file, cast(round("start" * 1000) as bigint) s, cast(round("end" * 1000) as bigint) e, text
           from ref_cue where "start" is not null),
c as (select distinct cue_id, file, cast(round("start" * 1000) as bigint) s, cast(round("end" * 1000) as bigint) e, text
      from cand_cue where "start" is not null),
rb as (select *, unnest([s // 1000 - 1, s // 1000, s // 1000 + 1]) b from r), cb as (select *, s // 1000 b from c),
j as (select rb.cue_id ref_cue_id, cb.cue_id cand_cue_id, rb.text ref_text, cb.text cand_text,
             cb.s - rb.s start_diff_ms, cb.e - rb.e end_diff_ms
      from rb join cb on rb.file = cb.file and rb.b = cb.b and abs(rb.s - cb.s) <= {TOLERANCE_MS}
      qualify row_number() over (partition by rb.cue_id order by abs(rb.s - cb.s), cb.cue_id) = 1)
"""
_P4 = f"""
with c0 as (select distinct * from cue where file is not null and ord is not null),
c as (select file, ord, text, cast(round("start" * 1000) as bigint) s, cast(round("end" * 1000) as bigint) e, {_mapped('text')} m from c0),
f as (select *, case when regexp_matches(m, '\\S') then regexp_replace(strip_accents(lower(regexp_replace(m, '<[^>]*>|\\{{[^}}]*\\}}', '', 'g'))),
      '[^\\p{{L}}\\p{{N}}]+', '', 'g') end fold from c),
l as (select *, lag(fold) over (partition by file order by ord) pf from f),
k as (select *, case when fold is null or pf is null then 1 when fold = pf then 0
      when 1 - levenshtein(fold, pf) / greatest(length(fold), length(pf)) >= 0.85 then 0 else 1 end br from l),
g as (select *, sum(br) over (partition by file order by ord) grp from k),
r as (select file, min(ord) first_ord, max(ord) last_ord, count(*) cues, max(e) - min(s) duration_ms, arg_min(text, ord) as text
      from g where fold is not null group by file, grp)
"""
_TOKENS = f"len(regexp_extract_all(text, '{TOKEN}'))"



def _words(x: str) -> str:
    """The words of a text as a list, without markup, cue numbers and timing."""
    t = f"regexp_replace({x}, '(?im)^(?:[ \\t]*[0-9]+[ \\t]*\\r?\\n)?[^\\n]*-->[^\\n]*$', '', 'g')"
    t = f"regexp_replace({t}, '<[^<>\\n]*>|\\{{[^{{}}\\n]*\\}}', '', 'g')"
    return f"regexp_extract_all(lower({_mapped(t)}), '[\\p{{L}}\\p{{N}}]+')"


def _grams(table_name: str, key: str) -> str:
    return f"""(select distinct {key}, array_to_string(w[k:k + 11], ' ') g from (
      select {key}, w, unnest(range(1, len(w) - 10)) k from (select {key}, {_words('text')} w from {table_name} where text is not null)))"""


ORACLE = {
    "p6_found": f"select distinct item_id, doc_id from {_grams('heldout_item', 'item_id')} i join {_grams('documents', 'doc_id')} d using (g)",
    "p1_found": _P1 + "select ref_cue_id, cand_cue_id from j",
    "p1_pairs": _P1 + "select * from j",
    "p3_found": f"""
with d as (select distinct ocr_id, file, track_id, ord, text from ocr_result where text <> ''),
m as (select *, {_mapped('text')} m from d)
select a.ocr_id ocr_id_a, b.ocr_id ocr_id_b from m a join m b using (file, track_id, ord, m)
where a.ocr_id < b.ocr_id and a.text <> b.text""",
    "p3_canonical": f"""
with d as (select text from cue union select text from ref_cue union select text from cand_cue),
m as (select text, {_mapped('text')} m from d where text is not null),
c as (select m, arg_min(text, row(length(regexp_replace(text, '[\\x20-\\x7E\\n]', '', 'g')), length(text), text)) as canonical from m group by m)
select text, canonical from m join c using (m)""",
    "p3_forms": f"""
with d as (select text from ocr_result union select text from cue union select text from ref_cue union select text from cand_cue),
m as (select text, {_mapped('text')} m from d where text is not null),
c as (select m, arg_min(text, row(length(regexp_replace(text, '[\\x20-\\x7E\\n]', '', 'g')), length(text), text)) as canonical from m group by m)
select text, canonical from m join c using (m)""",
    "p4_found": _P4 + "select file, first_ord, last_ord from r where cues >= 2",
    "p4_runs": _P4 + "select * from r",
    "p7_found": f"""
with d as (select source, {_TOKENS} n from documents where source is not null),
t as (select sum(n) total from d), s as (select source, sum(n) n from d group by source)
select m.source from mix_target m left join s on m.source = s.source, t
where m.max_uses * coalesce(s.n, 0) < m.weight * t.total""",
    "p7_targets": f"""
with d as (select source, {_TOKENS} n from documents where source is not null),
t as (select sum(n) total from d), s as (select source, sum(n) n, count(*) docs from d group by source)
select m.source, m.weight, cast(m.max_uses as bigint) max_uses, coalesce(docs, 0) docs, cast(coalesce(s.n, 0) as bigint) tokens, cast(total as bigint) budget,
       max_uses * coalesce(s.n, 0) < weight * total falls_short, round(least(weight * total, cast(max_uses * coalesce(s.n, 0) as double)), 3) wanted, true reached
from (select distinct * from mix_target) m left join s on m.source = s.source, t""",
    "p7_limits": f"select doc_id, source, {_TOKENS} tokens, true within_uses from documents join (select distinct source from mix_target) using (source)",
    "p6_runs": f"""
with i as (select item_id, {_words('text')} w from heldout_item where text is not null), d as (select distinct doc_id, {_words('text')} w from documents where text is not null),
ig as (select item_id, k i, array_to_string(w[k:k + 11], ' ') g from (select item_id, w, unnest(range(1, len(w) - 10)) k from i)),
dg as (select doc_id, k j, array_to_string(w[k:k + 11], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 10)) k from d)),
m as (select distinct item_id, doc_id, i, j from ig join dg using (g)),
n as (select *, j - row_number() over (partition by item_id, doc_id, j - i order by j) run from m),
l as (select item_id, doc_id, count(*) + 11 words from n group by item_id, doc_id, j - i, run)
select item_id, doc_id, max(words) run_words from l group by item_id, doc_id""",
    "p8_checked": f"""
with t as (select doc_id, regexp_extract_all(text, '{TOKEN}') w from documents)
select doc_id, len(w) doc_tokens, true within_limit, true overlapping, true enough, md5(array_to_string(w, ' ')) tokens_md5 from t where len(w) > {LIMIT}""",
    "p8_found": f"select doc_id from documents where {_TOKENS} > {LIMIT}",
}

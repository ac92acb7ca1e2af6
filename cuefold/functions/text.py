"""Text cleaning and scoring: Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuefold.functions.binding import let

#: White space of all scripts and the byte order mark.
WS = r"[\s\u00A0\uFEFF\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def strip(text: Column) -> Column:
    """Trim white space of all kinds."""
    return F.regexp_replace(text, rf"\A{WS}+|{WS}+\z", "")


def chain(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, to in rules:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(to))
    return text


# Character references, decoded one after the other, so that a doubly
# escaped sign is decoded twice.
ENTITIES = [
    ("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&quot;", '"'), ("(?i)&#39;", "'"),
]
#: A tag, also one with a closing bracket in a quoted attribute.
TAG = r"""<(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""


def decode_entities(text: Column) -> Column:
    return chain(text, ENTITIES)


def strip_tags(text: Column) -> Column:
    """Drop tags except bare i, b and u, which come out in lower case."""
    kept = lambda t: F.zip_with(
        F.split(t, TAG, -1), F.regexp_extract_all(t, F.lit(TAG), F.lit(0)),
        lambda part, tag: F.concat(part, F.when(tag.rlike(r"(?i)\A</?[ibu]>\z"), F.lower(tag)).otherwise(F.lit(""))),
    )
    return let(text, lambda t: F.when(F.contains(t, F.lit("<")), F.array_join(kept(t), "")).otherwise(t))


def clean_subtitle_text(text: Column) -> Column:
    """Caption text without markup; entities first, white space last."""
    t = chain(decode_entities(text), [(r"(?i)<br\s*/?>", "\n"), (r"\{\\.*?\}", "")])
    t = chain(strip_tags(t), [(r"\\[Nnh]", "\n"), ("\r", ""), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n")])
    return strip(t)


# Repairs of what recognisers of bitmap text misread, in order, (pattern,
# replacement) with $1 for the first group.  Each works on one line.
STRAIGHT_QUOTES = [("[\u2018\u2019]", "'"), ("[\u201c\u201d]", '"')]
LINE_REPAIRS = [
    (r"^['`]+", ""),
    (r"^\[['`]+([A-Za-z])", r"[$1"),
    ('^[fJ#\u00a2&]\\s+([A-Za-z".])', "\u266a $1"),
    ("\\s+[fJ\u00a3]\\z", " \u266a"),
    (r"^\|--\z", ""),
    (r"^\.\.-+([A-Za-z0-9])", "...$1"),
    (r"^\.(?:-+|\s+)([A-Za-z0-9])", "...$1"),
    (r"^\.\.\s+([A-Za-z])", "...$1"),
    (r"^\|(\s|[a-z])", "I$1"),
    (r"\s\|(\s?[A-Za-z])", " I$1"),
    (r"\.\.\.\|(\s?[A-Za-z])", "...I$1"),
    (r"^[-_]\s*", "- "),
    (r"^I([a-z][a-z ]+)\]_?,?\z", "[$1]"),
    (r"^([a-z][a-z ]+)\]_?,?\z", "[$1]"),
    (r"^\[([^\]]+)\],\z", "[$1]"),
    (r"^I([A-Z][A-Za-z ]+(?:[1IJl]|\]|\z))", "[$1"),
    (r"^\[([^\]]+?)\s*[1IJl]\z", "[$1]"),
    (r"^\[([^\]]+?)J\z", "[$1]"),
    (r"^([A-Z])(?:[A-Z]|[cz])\.\z", "$1..."),
    (r"^([A-Z])\.\.\z", "$1..."),
    (r"[ \t]{2,}", " "),
]
# Repairs fitted to one corpus, off unless asked for.
FITTED_REPAIRS = [
    (r"^\.\.{1,2}-[@&8]{1,2}\s+", "...as "),
    (r"^\.\.-0f($|[^A-Za-z0-9_])", "...of$1"),
    (r"^\.\.-1(\s)", "...I$1"),
    (r"\|(\s?[Kk]now(?:$|[^A-Za-z0-9_]))", "I$1"),
    (r"(^|[^A-Za-z0-9_])I Know($|[^A-Za-z0-9_])", "$1I know$2"),
    (r"(?i)^/(\s?want(?:$|[^A-Za-z0-9_]))", "I$1"),
]
CLEANUPS = ("generic", "fitted")


def clean_ocr_line(line: Column, profile: str = "generic") -> Column:
    if profile not in CLEANUPS:
        raise ValueError(f"unknown cleanup {profile}")
    generic = lambda x: chain(strip(chain(x, STRAIGHT_QUOTES)), LINE_REPAIRS)
    if profile == "generic":
        return generic(line)
    return chain(generic(chain(strip(line), FITTED_REPAIRS)), FITTED_REPAIRS)


def clean_ocr_text(text: Column, profile: str = "generic") -> Column:
    """Recognised text with each line repaired and empty lines dropped."""
    lines = F.transform(F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n", -1), lambda x: clean_ocr_line(x, profile))
    return strip(F.array_join(F.filter(lines, lambda x: x != ""), "\n"))


#: Contractions by rule: who before what, and verbs before n't.
_SHORTENED = [
    *[f"{who}'{what}" for who in ("i", "you", "he", "she", "it", "we", "they") for what in ("ll", "d")],
    *[f"{who}'ve" for who in ("i", "you", "we", "they")], *[f"{who}'re" for who in ("you", "we", "they")], "i'm", "let's",
    *[f"{who}'s" for who in ("he", "she", "it", "that", "what", "who", "where", "here", "there", "how")],
    *[f"{verb}n't" for verb in ("are", "ca", "could", "did", "does", "do", "had", "has", "have", "is", "must", "should", "was", "were", "wo", "would")],
]
#: Common English words, for the health score of recognised text: function words and everyday verbs, listed from general knowledge.
COMMON_WORDS = (
    "a about after all am an and any are as ask at away be because been before but by can come could did do does down each "
    "even every few find for found from get give go gone good had has have he her here him his how i if in into is it its just "
    "know last leave left let like look made make man many may me more most much must my never new no not now of off old on one "
    "only or other our out over own people put said same saw say see she should so some still such take tell than that the their "
    "them then there these they thing think this those time to told too took two under until up us very want was way we well went "
    "were what when where which who why will with without woman would year yes you your"
).split() + _SHORTENED


def token_score(token: Column, words: list[str] = COMMON_WORDS) -> Column:
    """Common word 1, number 0.75, plain word 0.5, anything else 0, nothing left null."""
    bare = chain(F.lower(token), [(r"^[^a-z0-9']+", ""), (r"'+\z", ""), (r"[^a-z0-9']+\z", "")])
    return let(
        bare,
        lambda w: F.when(w == "", F.lit(None).cast("double")).when(w.isin(words), F.lit(1.0))
        .when(w.rlike(r"^[0-9]+(?:[.,:][0-9]+)*\z"), F.lit(0.75))
        .when(w.rlike(r"^[a-z]+(?:'[a-z]+)?\z"), F.lit(0.5)).otherwise(F.lit(0.0)),
    )


def text_health(text: Column, words: list[str] = COMMON_WORDS) -> Column:
    """Mean token score of a text, null without tokens."""
    scores = F.filter(
        F.transform(F.split(F.coalesce(text, F.lit("")), rf"{WS}+", -1), lambda x: token_score(x, words)), lambda x: x.isNotNull()
    )
    # Scores are multiples of 0.25, so their sum is exact in any order.
    return let(scores, lambda s: F.when(F.size(s) > 0, F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / F.size(s)))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; two empty texts are alike.  Lengths are code points."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def safe_name(text: Column) -> Column:
    return chain(text, [(r"(?i)[^a-z0-9._-]+", "_"), (r"^_+|_+\z", "")])


def safe_upload_name(text: Column) -> Column:
    """A file name without path and odd signs; nothing left or only dots give a default."""
    base = F.regexp_extract(F.coalesce(text, F.lit("")), r"([^/]*)/*\z", 1)
    clean = strip(chain(base, [(r"[^A-Za-z0-9_ .()\[\]-]+", "_"), (r"\s+", " ")]))
    return F.when(clean.rlike(r"^\.*\z"), F.lit("subtitle-file")).otherwise(clean)


def local_path(text: Column) -> Column:
    """A pasted path: trimmed, without quotes around it and backslashes before signs."""
    t = strip(text)
    t = F.when(t.rlike(r"""\A(".*"|'.*')\z"""), F.regexp_replace(t, r"\A.|.\z", "")).otherwise(t)
    return F.regexp_replace(t, r"\\(.)", "$1")


def first_useful_line(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, "\n", -1), strip), lambda x: x != "")
    return F.coalesce(F.substring(F.get(lines, F.lit(0)), 1, 180), F.lit(""))


def last_meaningful_line(text: Column, noise: str = r"^(at |node:|\s*$)") -> Column:
    """The last trimmed line that is not of a known noise shape, else an empty one."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), strip), lambda x: (x != "") & ~x.rlike(noise))
    return F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit(""))


def version_triple(text: Column) -> Column:
    """[major, minor, patch] of the first dotted number, null without one."""
    v = F.regexp_extract(text, r"([0-9]+\.[0-9]+(?:\.[0-9]+)?)", 1)
    parts = F.transform(F.split(v, r"\."), lambda x: x.cast("int"))
    return F.when(v != "", F.when(F.size(parts) == 3, parts).otherwise(F.array_append(parts, F.lit(0))))


def below_version(text: Column, minimum: str) -> Column:
    """Whether a version is known and below the minimum."""
    return F.coalesce(version_triple(text) < version_triple(F.lit(minimum)), F.lit(False))

"""DuckDB expressions that say the same as the Column functions."""

from __future__ import annotations

from cuefold.functions import text as T

_WS = r"[\s\x0B\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_TAG = r"""<(?:[^>"'']|"[^"]*"|''[^'']*'')*>"""  # within an SQL literal
NL = "chr(10)"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str) -> str:
    """regexp_replace of all matches; ``to`` with $1 for a group."""
    return f"regexp_replace({x}, {lit(pattern)}, {lit(to.replace(chr(92), chr(92) * 2).replace('$', chr(92)))}, 'g')"


def chain(x: str, rules) -> str:
    for pattern, to in rules:
        x = sub(x, pattern, to)
    return x


def strip(x: str) -> str:
    return sub(x, rf"\A{_WS}+|{_WS}+\z", "")


def no_cr(x: str) -> str:
    return f"replace({x}, chr(13), '')"


def decode_entities(x: str) -> str:
    return chain(x, T.ENTITIES)


def strip_tags(x: str) -> str:
    # One binding of the text, its parts and its tags by way of a one-element list.
    return (
        f"(list_transform([{x}], lambda t: array_to_string(list_transform(range(1, len(string_split_regex(t, '{_TAG}')) + 1), "
        f"lambda i: string_split_regex(t, '{_TAG}')[i] || case when regexp_matches(coalesce(regexp_extract_all(t, '{_TAG}')[i], ''), "
        f"'(?i)\\A</?[ibu]>\\z') then lower(regexp_extract_all(t, '{_TAG}')[i]) else '' end), '')))[1]"
    )


def clean_subtitle_text(x: str) -> str:
    t = chain(decode_entities(x), [(r"(?i)<br\s*/?>", "\n"), (r"\{\\.*?\}", "")])
    return strip(chain(strip_tags(t), [(r"\\[Nnh]", "\n"), ("\r", ""), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n")]))


def clean_ocr_line(x: str, fitted: bool) -> str:
    generic = lambda y: chain(strip(chain(y, T.STRAIGHT_QUOTES)), T.LINE_REPAIRS)
    return chain(generic(chain(strip(x), T.FITTED_REPAIRS)), T.FITTED_REPAIRS) if fitted else generic(x)


def clean_ocr_text(x: str, fitted: bool = False) -> str:
    lines = f"list_transform(string_split({no_cr(x)}, {NL}), lambda y: {clean_ocr_line('y', fitted)})"
    return strip(f"array_to_string(list_filter({lines}, lambda y: y <> ''), {NL})")


def token_score(x: str) -> str:
    words = ", ".join(lit(w) for w in T.COMMON_WORDS)
    bare = chain(f"lower({x})", [(r"^[^a-z0-9']+", ""), (r"'+\z", ""), (r"[^a-z0-9']+\z", "")])
    return (
        f"list_transform([{bare}], lambda w: case when w = '' then null when w in ({words}) then 1.0::double "
        f"when regexp_matches(w, '^[0-9]+(?:[.,:][0-9]+)*\\z') then 0.75::double "
        f"when regexp_matches(w, '^[a-z]+(?:''[a-z]+)?\\z') then 0.5::double else 0.0::double end)[1]"
    )


def text_health(x: str) -> str:
    scores = f"list_filter(list_transform(string_split_regex(coalesce({x}, ''), {lit(_WS + '+')}), lambda t: {token_score('t')}), lambda s: s is not null)"
    return f"list_transform([{scores}], lambda l: case when len(l) > 0 then list_sum(l) / len(l) end)[1]"


def _g(x: str, pattern: str, k: int) -> str:
    return f"regexp_extract({x}, {lit(pattern)}, {k})"


def clock(x: str, pattern: str) -> str:
    n = lambda k: f"coalesce(try_cast(nullif({_g(x, pattern, k)}, '') as double), 0.0::double)"
    return f"({n(1)} * 3600 + {n(2)} * 60 + {n(3)} + rpad({_g(x, pattern, 4)}, 3, '0')::double / 1000)"


def parse_timecode(x: str) -> str:
    from cuefold.functions.timecode import TIMECODE

    t = strip(x)
    return f"case when regexp_matches({t}, {lit(TIMECODE)}) then {clock(t, TIMECODE)} end"


def parse_srt_time(x: str) -> str:
    from cuefold.functions.timecode import STRICT_TIME

    return f"case when regexp_matches({x}, {lit(STRICT_TIME)}) then {clock(x, STRICT_TIME)} end"


def srt_time(s: str) -> str:
    ms = f"greatest(0, cast(floor({s} * 1000 + 0.5::double) as bigint))"
    return f"printf('%02d:%02d:%02d,%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


def back(ms: str) -> str:
    """Seconds of whole milliseconds, added up as a clock time is."""
    return f"(({ms} // 3600000)::double * 3600 + ({ms} // 60000 % 60)::double * 60 + ({ms} // 1000 % 60)::double + ({ms} % 1000)::double / 1000)"


def first_token(x: str) -> str:
    return f"regexp_extract({strip(x)}, '\\A(\\S*)', 1)"


def timed_blocks(docs: str, skip: str | None = None, keys: str = "doc_id") -> str:
    """A query of ``keys, ord, start, end, text`` over ``docs(keys, t)``."""
    skipped = f"where not regexp_matches(coalesce(l[1], ''), '{skip}')" if skip else ""
    return f"""(
      select {keys}, row_number() over (partition by {keys} order by k) - 1 as ord, {parse_timecode('times[1]')} as "start",
             {parse_timecode(first_token('times[2]'))} as "end", array_to_string(l[ti + 1:], {NL}) as text
      from (select {keys}, k, l, ti, string_split(l[ti], '-->') times from (
        select {keys}, k, l, list_position(list_transform(l, lambda x: contains(x, '-->')), true) ti from (
          select {keys}, k, list_filter(string_split(blocks[k], {NL}), lambda x: x <> '') l from (
            select {keys}, blocks, unnest(range(1, len(blocks) + 1)) k from (
              select {keys}, string_split_regex(t, '\\n{{2,}}') blocks from {docs})))
        {skipped}) where ti > 0))"""

"""SQL of the queries over caption documents."""

from __future__ import annotations

from cuefold.plans import sql as Q

_BOM = "chr(65279)"
_TEXT = f"replace(text, {_BOM}, '')"
_WORD_END = "(?:[^A-Za-z0-9_]|\\z)"
_VTT_SKIP = f"(?i)\\A(NOTE|STYLE|REGION){_WORD_END}"


def _vtt_body(x: str) -> str:
    return Q.strip(Q.sub(Q.no_cr(x), r"(?i)\AWEBVTT[^\n]*(?:\n|\z)", ""))


_FMT = f"""case when regexp_matches({Q.strip(_TEXT)}, '(?i)\\AWEBVTT{_WORD_END}') then 'vtt'
  when regexp_matches({_TEXT}, '(?i)<(?:[A-Za-z0-9_]+:)?tt{_WORD_END}[^>]*http://www\\.w3\\.org/ns/ttml') then 'ttml'
  when regexp_matches({_TEXT}, '(?m)^\\{{[0-9]+\\}}\\{{[0-9]+\\}}') then 'microdvd'
  when regexp_matches({_TEXT}, '(?m)^\\[[0-9]+\\]\\[[0-9]+\\]') then 'mpl2'
  when contains(text, '-->') then 'srt' when regexp_matches({_TEXT}, '(?im)^\\s*\\[Events\\]') then 'ass'
  when regexp_matches({_TEXT}, '(?i)<sami{_WORD_END}') then 'sami' else 'transcript' end"""


def _plain(docs: str) -> str:
    return f"""(
      select doc_id, ord, ord * 3.5::double as "start", ord * 3.5::double + 3 as "end", l[ord + 1] as text
      from (select doc_id, l, unnest(range(len(l))) ord from (
        select doc_id, list_filter(list_transform(string_split({Q.no_cr('t')}, {Q.NL}), lambda x: {Q.strip('x')}), lambda x: x <> '') l from {docs})))"""


def _docs(source: str, body: str) -> str:
    return f"(select doc_id, {body} t from documents where source = '{source}' and text is not null)"


_CHUNK = """
with c as (
  select distinct cue_id, file, "start" s, "end" e, trim(regexp_replace(text, '[\\s|{}\\[\\]<>&\\\\]+', ' ', 'g')) t, cue_id // 200 chunk
  from ref_cue where "start" is not null and "end" is not null and "end" > "start" and text is not null),
d as (select *, cast(round(s * 1000) as bigint) ms, cast(round(e * 1000) as bigint) me, row_number() over (partition by file, chunk order by cue_id) - 1 ord,
             row_number() over (partition by file, chunk order by cue_id desc) back,
             lead(s) over (partition by file, chunk order by cue_id) nxt
      from c where t <> '')
"""
_CENTI = lambda m: f"(({m} // 3600000)::double * 3600 + ({m} // 60000 % 60)::double * 60 + ({m} // 1000 % 60)::double + ({m} // 10 % 100 * 10)::double / 1000)"
_MS = lambda m: f"(0::double * 3600 + ({m} // 60000 % 60)::double * 60 + ({m} // 1000 % 60)::double + ({m} % 1000)::double / 1000)"
_EMITTED = f"""
c as (select distinct * from cue),
k as (select *, ord // 1000 part from c where {Q.strip('text')} <> '' and "end" > "start"),
n as (select *, row_number() over (partition by file, part order by ord) num,
      {Q.srt_time('"start"')} || ' --> ' || {Q.srt_time('"end"')} timing from k)
"""
_ALL = f"""
with f as (select doc_id, text, {_FMT} fmt from documents where text is not null),
v as {Q.timed_blocks(f"(select doc_id, {_vtt_body(_TEXT)} t from f where fmt = 'vtt')", _VTT_SKIP)},
s as {Q.timed_blocks(f"(select doc_id, {Q.no_cr(_TEXT)} t from f where fmt = 'srt')")},
p as {_plain(f"(select doc_id, {_TEXT} t from f where fmt = 'transcript')")},
a as (select * from v union all select * from s union all select * from p)
"""

ORACLE = {
    "format_sniff": f"select doc_id, {_FMT} as fmt from documents where text is not null",
    "scan_srt": f"select * from {Q.timed_blocks(_docs('disc_srt', Q.no_cr(_TEXT)))}",
    "scan_vtt": f"select * from {Q.timed_blocks(_docs('web_vtt', _vtt_body(_TEXT)), _VTT_SKIP)}",
    "scan_srt_metrics": f"""
      select doc_id, k - 1 as index, case when {Q.strip('l[1]')} = '' then 0.0::double else coalesce(
               case when regexp_matches({Q.strip('l[1]')}, '\\A[+-]?[0-9.]+(?:[eE][+-]?[0-9]+)?\\z') then try_cast({Q.strip('l[1]')} as double) end, k::double) end as number,
             {Q.parse_srt_time(Q.strip('times[1]'))} as "start", {Q.parse_srt_time(Q.first_token('times[2]'))} as "end", l[ti] as timing,
             {Q.strip(f"array_to_string(l[ti + 1:], {Q.NL})")} as text
      from (select *, string_split(l[ti], '-->') times from (
        select *, list_position(list_transform(l, lambda x: contains(x, '-->')), true) ti from (
          select doc_id, k, string_split(blocks[k], {Q.NL}) l from (
            select doc_id, blocks, unnest(range(1, len(blocks) + 1)) k from (
              select doc_id, string_split_regex({Q.strip(Q.no_cr(f"regexp_replace(text, '^' || {_BOM}, '')"))}, '\\n\\n+') blocks
              from documents where source = 'disc_srt' and text is not null)))) where ti > 0)
      where "start" is not null and "end" is not null""",
    "scan_plain_transcript": f"select * from {_plain(_docs('transcript', 'text'))}",
    "convert_documents": _ALL + f""",
      w as (select *, coalesce({Q.strip('text')} <> '' and "end" > "start", false) written, "start" is null or "end" is null bad from a)
      select doc_id, case when bool_or(bad) then 'rejected: unreadable timecode' else 'converted' end as status,
        case when not bool_or(bad) then count(*) filter (where written) end as cues,
        case when not bool_or(bad) then cast(sum(length({Q.clean_subtitle_text('text')})) filter (where written) as bigint) end as chars,
        case when not bool_or(bad) then round(sum("end" - "start") filter (where written), 3) end as seconds from w group by doc_id""",
    "scan_ttml_frames": _CHUNK + """
      select file, chunk, ord, (ms // 1000)::double + (ms % 24) / (24 * (1000.0::double / 1001)) as "start", (me // 1000)::double + (me % 24) / (24 * (1000.0::double / 1001)) as "end", t as text from d""",
    "scan_ass": _CHUNK + f'select file, chunk, ord, {_CENTI("ms")} as "start", {_CENTI("me")} as "end", t as text from d',
    "scan_microdvd": _CHUNK + """
      select file, chunk, ord, round(s * 25) / 25 as "start", round(e * 25) / 25 as "end", t as text from d
      union all select file, chunk, ord + 1, 2.0, 4.0, 'half rate' from d where back = 1""",
    "scan_mpl2": _CHUNK + """select file, chunk, ord, round(s * 10) / 10 as "start", round(e * 10) / 10 as "end", t || chr(10) || 'x' as text from d""",
    "scan_ttml": _CHUNK + """
      select file, chunk, ord, (ms // 1000)::double as "start", (ms // 1000)::double + round((e - s) * 1000) / 1000 as "end", t as text from d""",
    "scan_sami": _CHUNK + """
      select file, chunk, ord, ms::double / 1000 as "start", coalesce(round(nxt * 1000) / 1000, ms::double / 1000 + 3) as "end", t as text from d""",
    "scan_stamped_transcript": _CHUNK + f""", m as (select *, lead(ms) over (partition by file, chunk order by ord) mn from d)
      select file, chunk, ord, {_MS('ms')} as "start", coalesce({_MS('mn')}, {_MS('ms')} + 4) as "end", t as text from m""",
    "srt_render": f"""with {_EMITTED},
      b as (select file, part, count(*) cues, string_agg(num || chr(10) || timing || chr(10) || {Q.clean_subtitle_text('text')}, chr(10) || chr(10) order by ord) || chr(10) body
            from n group by file, part)
      select file, part, cues, sha256({_BOM} || replace(body, chr(10), chr(13) || chr(10))) as sha, len(string_split(body, ' --> ')) - 1 as arrows,
             file || '-converted.srt' as name from b""",
    "srt_roundtrip": f"""with {_EMITTED}, b as (select *, cast(floor("start" * 1000 + 0.5::double) as bigint) ms, cast(floor("end" * 1000 + 0.5::double) as bigint) me from n)
      select file, part, num::double as number, {Q.back('greatest(0, ms)')} as "start", {Q.back('greatest(0, me)')} as "end", timing from b""",
    "timecode_format": f"""
      with x as (select *, l_extendedprice s, cast(floor(l_extendedprice * 1000 + 0.5::double) as bigint) ms,
                 cast(floor(l_extendedprice * 1000 / 1000 + 0.5::double) as bigint) whole from lineitem)
      select l_orderkey, l_linenumber, {Q.srt_time('s')} as stamp, {Q.back('ms')} as back, {Q.back('ms')} as strict, printf('%010d', ms) as file_time,
             floor(s) / 25 as frames, printf('%dm %02ds', whole // 60, whole % 60) as took from x""",
    "timing_parse": f"""
      with r as (select distinct cue_id, timing from (select cue_id, timing from ref_cue union all select cue_id, timing from cand_cue) where timing is not null),
      p as (select cue_id, string_split(timing, '-->') times from r)
      select cue_id, {Q.parse_timecode('times[1]')} as "start", {Q.parse_timecode(Q.first_token('times[2]'))} as "end" from p""",
    "clean_markup": f"""
      with c as (select distinct file, ord, text from cue where text is not null)
      select file, ord, {Q.clean_subtitle_text('text')} as clean, {Q.decode_entities('text')} as decoded from c""",
    "clean_ocr": f"with c as (select distinct ocr_id, text from ocr_result where text is not null) select ocr_id, {Q.clean_ocr_text('text')} as clean from c",
    "clean_ocr_fitted": f"with c as (select distinct ocr_id, text from ocr_result where text is not null) select ocr_id, {Q.clean_ocr_text('text', True)} as clean from c",
    "text_health": f"with c as (select distinct ocr_id, text from ocr_result) select ocr_id, {Q.text_health('text')} as health from c",
    "names": r"""
      with p as (select p_partkey, p_name, p_size, p_name || '#' || p_brand || '.sup' tail from part)
      select p_partkey, regexp_replace(regexp_replace('" /in box/' || tail || '"', '(?i)[^a-z0-9._-]+', '_', 'g'), '^_+|_+\z', '', 'g') as safe,
        regexp_replace(regexp_replace(tail || '"', '[^A-Za-z0-9_ .()\[\]-]+', '_', 'g'), '\s+', ' ', 'g') as upload,
        ' /in box/' || tail as path, trim(p_name) as first_line, p_size < 25 or (p_size = 25 and [3, 0] < [3, 1]) as old, trim(p_name) as last_line from p""",
}

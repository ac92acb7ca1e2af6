"""SQL of the scoring queries: the greedy pairing steps through the references of a file."""

from __future__ import annotations


def _side(name: str) -> str:
    return f"""select distinct file, cue_id id, index ord, "start" s, "end" e, coalesce(text, '') t from {name}
      where file is not null and "start" is not null and "end" is not null"""


def _pairs(left: str, right: str, tol: float) -> str:
    """Each left row in order takes the nearest unused right row.

    Rows are cut into islands first: the recursion steps within all islands at once.
    """
    return f"""
m as (select file, id, ord, s, 0 side from {left} union all select file, id, ord, s, 1 from {right}),
g as (select *, case when s - lag(s) over (partition by file order by s, side, ord, id) <= {tol}::double + 1e-6::double then 0 else 1 end brk from m),
i as (select *, sum(brk) over (partition by file order by s, side, ord, id) isl from g),
lr as (select *, row_number() over (partition by file, isl order by s, ord, id) rn from i where side = 0),
rr as (select file, isl, list({{'s': s, 'o': ord, 'id': id}}) cs from i where side = 1 group by file, isl),
st as (
  select lr.file, lr.isl, 0::bigint rn, []::bigint[] used, null::bigint l, null::bigint r, rr.cs from lr join rr using (file, isl) where lr.rn = 1
  union all
  select file, isl, rn, case when r is null then used else list_append(used, r) end, l, r, cs from (
    select st.file, st.isl, lr.rn, st.used, lr.id l, st.cs,
      (list_sort(list_transform(list_filter(st.cs, lambda k: k.s >= lr.s - {tol}::double and k.s - lr.s <= {tol}::double and not list_contains(st.used, k.id)),
         lambda k: {{'d': abs(k.s - lr.s), 's': k.s, 'o': k.o, 'id': k.id}}))[1]).id r
    from st join lr on st.file = lr.file and st.isl = lr.isl and lr.rn = st.rn + 1)),
pairs as (select l, r from st where r is not null)
"""


_FRAMES = """
fr as (select file, id, id as ord, s from cand where t <> ''),
m as (select file, id, ord, s, 0 side from fr union all select file, id, ord, s, 1 from ref),
g as (select *, case when s - lag(s) over (partition by file order by s) <= 0.08::double + 1e-6::double then 0 else 1 end brk from m),
i as (select *, sum(brk) over (partition by file order by s rows unbounded preceding) isl from g),
fn as (select *, row_number() over (partition by file, isl order by ord, id) rn from i where side = 0),
ft as (select file, isl, list({'s': s, 'o': ord, 'id': id}) ts from i where side = 1 group by file, isl),
st as (
  select file, isl, 0::bigint rn, []::bigint[] used, null::bigint l, null::bigint r, ts from ft
  union all
  select file, isl, rn, case when r is null then used else list_append(used, r) end, l, r, ts from (
    select st.file, st.isl, fn.rn, st.used, fn.id l, st.ts,
      (list_sort(list_transform(list_filter(st.ts, lambda k: abs(k.s - fn.s) <= 0.08::double and not list_contains(st.used, k.id)),
         lambda k: {'d': abs(k.s - fn.s), 'o': k.o, 'id': k.id}))[1]).id r
    from st join fn on st.file = fn.file and st.isl = fn.isl and fn.rn = st.rn + 1))
"""


_BASE = f"with recursive ref as ({_side('ref_cue')}), cand as ({_side('cand_cue')}),"
PAIRED = _BASE + _pairs("ref", "cand", 0.04) + """,
asc_ as (select id, regexp_replace(t, '[^\\x00-\\x7F]', '?', 'g') t from ref union all select id, regexp_replace(t, '[^\\x00-\\x7F]', '?', 'g') from cand),
p as (select ref.file, ref.id ref_id, ref.ord ref_ord, ref.s ref_start, ref.e ref_end, ref.t ref_text, cand.id cand_id, cand.e cand_end, cand.t cand_text,
      case when cand.id is null then length(ref.t) else {lev} end edit_distance
      from ref left join pairs on ref.id = pairs.l left join cand on pairs.r = cand.id),
gaps as (select file, s gs, s + 10 ge from ref where starts_with(t, '[')),
x as (select cand.*, exists (select 1 from gaps where gaps.file = cand.file and cand.s >= gs - 0.5 and cand.s <= ge + 0.5) in_gap
      from cand where id not in (select r from pairs)),
mm as (select *, case when length(ref_text) > 0 then edit_distance / length(ref_text) else 0 end cer from p where cand_id is not null and edit_distance > 0),
sh as (select p.file, p.ref_id, c.id cand_id, c.s - p.ref_start shift, 1 - {lev2} / greatest(length(p.ref_text), length(c.t)) similarity, c.ord
       from p join cand c on p.file = c.file and abs(c.s - p.ref_start) <= 3 where p.cand_id is null and p.ref_text <> ''
       and abs(length(p.ref_text) - length(c.t)) <= 0.08 * greatest(length(p.ref_text), length(c.t)) + 1),
shift as (select file, ref_id, cand_id, shift, similarity from sh where similarity >= 0.92
       qualify row_number() over (partition by ref_id order by similarity desc, abs(shift), ord, cand_id) = 1)
"""


def _chars(a: str, b: str) -> str:
    """Edit distance in characters.

    DuckDB counts bytes, so every character beyond ASCII of the pair is first given a single byte of its own.
    """
    odd = f"list_distinct(regexp_extract_all({a} || {b}, '[^\\x00-\\x7F]'))"
    to = "'\x01\x02\x03\x04\x05\x06\x07\x08\x0b\x0c\x0e\x0f\x10\x11\x12\x13\x14\x15\x16\x17\x18\x19\x1a\x1b\x1c\x1d\x1e\x1f\x7f@#$%^*+=~`|_QZXJKVWYUqzxjkvwy0123456789'"
    one = lambda x: f"translate({x}, array_to_string({odd}, ''), {to})"
    return f"levenshtein({one(a)}, {one(b)})"


PAIRED = PAIRED.replace("{lev}", _chars("cand.t", "ref.t")).replace("{lev2}", _chars("p.ref_text", "c.t"))
_ROWS = """, l as (select file, count(*) reference_cues, count(*) filter (where cand_id is null) as missing,
    count(*) filter (where cand_id is not null and abs(cand_end - ref_end) > 0.04::double) end_mismatches,
    count(*) filter (where cand_text = ref_text) exact_text_matches, sum(edit_distance)::bigint text_edit_distance, sum(length(ref_text))::bigint reference_characters
    from p group by file),
  n as (select file, count(*) candidate_cues from cand group by file), e as (select file, count(*) raw_extra, count(*) filter (where in_gap) gap_extra from x group by file),
  h as (select file, count(*) shifted from shift group by file),
  r0 as (select file, coalesce(reference_cues, 0) reference_cues, coalesce(candidate_cues, 0) candidate_cues, coalesce(missing, 0) missing,
     coalesce(raw_extra, 0) raw_extra, case when coalesce(reference_cues, 0) = 0 then coalesce(raw_extra, 0) else coalesce(gap_extra, 0) end unverified,
     coalesce(shifted, 0) shifted, coalesce(end_mismatches, 0) end_mismatches, coalesce(exact_text_matches, 0) exact_text_matches,
     coalesce(text_edit_distance, 0) text_edit_distance, coalesce(reference_characters, 0) reference_characters
     from l full join n using (file) full join e using (file) full join h using (file)),
  tot as (select 'TOTAL' as file, sum(reference_cues)::bigint reference_cues, sum(candidate_cues)::bigint candidate_cues, sum(missing)::bigint missing, sum(raw_extra)::bigint raw_extra,
     sum(unverified)::bigint unverified, sum(shifted)::bigint shifted, sum(end_mismatches)::bigint end_mismatches, sum(exact_text_matches)::bigint exact_text_matches,
     sum(text_edit_distance)::bigint text_edit_distance, sum(reference_characters)::bigint reference_characters from r0),
  r as (select *, raw_extra - unverified as extra, case when reference_characters > 0 then text_edit_distance / reference_characters else 0 end character_error_rate,
     text_edit_distance > reference_characters as exceeds_reference_length from (select * from r0 union all select * from tot))
"""

ORACLE = {
    "pair": _BASE + _pairs("ref", "cand", 0.04) + "select l as ref_id, r as cand_id from pairs",
    "frame_targets": _BASE + _FRAMES + "select l as frame_id, r as target_id from st where r is not null",
    "pair_details": PAIRED + "select file, ref_id, cand_id, edit_distance from p",
    "missing_cues": PAIRED + "select file, ref_id, ref_start from p where cand_id is null",
    "extra_cues": PAIRED + 'select file, id as cand_id, s as "start", in_gap from x',
    "shifted_matches": PAIRED + "select * from shift",
    "text_mismatch_topk": PAIRED + """, k as (select *, row_number() over (partition by file order by edit_distance desc, cer desc, ref_ord, ref_id) as rank from mm)
      select file, rank, ref_id, cand_id, edit_distance, cer from k where rank <= 5""",
    "global_topk_regroup": PAIRED + """, k as (select * from mm order by edit_distance desc, cer desc, file, ref_id limit 200)
      select file, count(*) as targets, max(edit_distance) as worst, list(ref_id order by ref_id) as ref_ids from k group by file""",
    "benchmark_summary": PAIRED + _ROWS + """select *, case when missing > 0 or extra > 0 or end_mismatches > 0 then 'check' when unverified > 0 then 'unverified' else 'ok' end as verdict from r""",
    "quality_gate": PAIRED + _ROWS + """, c as (select count(*) filter (where reference_cues > 0 and candidate_cues > 0) compared,
        count(*) filter (where reference_cues = 0 or candidate_cues = 0) unpaired from r0),
      f as (select list_filter([case when compared = 0 then 'nothing was compared' end,
        case when compared < 9 then 'files compared: ' || compared || ', at least 9 wanted' end, case when unpaired > 0 then 'files with one side only: ' || unpaired end,
        case when missing > 0 then 'missing ' || missing || ' > 0' end,
        case when extra > 0 then 'extra ' || extra || ' > 0' end, case when end_mismatches > 0 then 'end_mismatches ' || end_mismatches || ' > 0' end,
        case when character_error_rate > 0.01 then 'CER ' || printf('%.2f%%', character_error_rate * 100) || ' > 1.00%' end], lambda z: z is not null) fs from r, c where file = 'TOTAL')
      select true as enabled, len(fs) = 0 as passed, array_to_string(fs, '; ') as failures from f""",
}
_CUE = 'select distinct cue_id, index, number, "start", "end", timing, text from'
ORACLE["comparison_details"] = PAIRED + f""", k as (select *, row_number() over (partition by file order by edit_distance desc, cer desc, ref_ord, ref_id) as rank from mm),
d as (select file, 'missing' as kind, null::bigint as rank, ref_id, null::bigint as cand_id, null::bigint as edit_distance, null::bigint as reference_characters, null::double as cer, null::double as shift, null::double as similarity from p where cand_id is null
  union all select file, case when in_gap or file not in (select file from ref) then 'unverified' else 'extra' end, null, null, id, null, null, null, null, null from x
  union all select file, 'end_mismatch', null, ref_id, cand_id, null, null, null, null, null from p where cand_id is not null and abs(cand_end - ref_end) > 0.04::double
  union all select file, 'shifted', null, ref_id, cand_id, null, null, null, shift, similarity from shift
  union all select file, 'text_mismatch', rank, ref_id, cand_id, edit_distance, length(ref_text), cer, null, null from k where rank <= 100)
select d.*, {', '.join(f'{a}."{c}" as {p}_{c}' for a, p in (('r', 'ref'), ('c', 'cand')) for c in ('index', 'number', 'start', 'end', 'timing', 'text'))}
from d left join ({_CUE} ref_cue) r on r.cue_id = d.ref_id left join ({_CUE} cand_cue) c on c.cue_id = d.cand_id"""

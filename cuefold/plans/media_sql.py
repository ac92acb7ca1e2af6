"""SQL of the queries over frames, tracks, readings, caches, histograms and events."""

from __future__ import annotations

from cuefold.operators.tracks import LANGUAGES
from cuefold.plans import sql as Q
from cuefold.plans.scoring_sql import PAIRED

_FRAMES = """f as (select user_id as file, event_id as ord, epoch_ms(date_trunc('hour', ts)) as pts, event_type, value from events)"""
_TRACKS = "t as (select distinct * from track)"
_SUFFIX = "case when language_code is null or language_code in ('', 'eng') then '' else '-' || language_code end || case when forced_track then '-forced' else '' end"
_LABEL = "case language_code " + " ".join(f"when '{k}' then '{v}'" for k, v in LANGUAGES.items()) + " else language_code end"
_SUB = "starts_with(codec, 'S_VOBSUB')"
_PLAN = f"""{_TRACKS}, u as (select * replace (coalesce(language_code, 'und') as language_code) from t),
p as (select *, '/out/' || file || case when stem_index > 0 then stem_index::varchar else '' end || {_SUFFIX} || case when {_SUB} then '.sub' else '.sup' end as output from u),
o as (select file, track_id, forced_track, output, unnest(case when {_SUB} then [output, regexp_replace(output, '\\.sub$', '.idx')] else [output] end) as path from p)"""
_READINGS = "r as (select distinct file, track_id, ord, ocr_id as id, text, confidence, variant from ocr_result)"
_SHORT = "'^[A-Za-z]{1,3}$'"


def _lines(t: str) -> str:
    return f"list_filter(string_split({t}, chr(10)), lambda x: x <> '')"


def _fragments(t: str) -> str:
    return f"(len({_lines(t)}) >= 2 and len(list_filter({_lines(t)}, lambda x: length(x) <= 3)) >= 2)"


def _score(t: str, c: str) -> str:
    return f"case when coalesce({t}, '') = '' then 0 else coalesce({c}, 0) + least(length({t}), 120) * 0.02::double end"


def _usable(t: str, c: str) -> str:
    c = f"coalesce({c}, 0)"
    return (
        f"case when coalesce({t}, '') = '' then false when regexp_matches({t}, '^\\[[A-Za-z][A-Za-z -]+\\]$') then {c} >= 10 "
        f"when regexp_matches({t}, '(?i)(?:^|[^A-Za-z0-9_])(?:just|think)\\.\\.\\.$') then {c} >= 35 when regexp_matches({t}, '^[A-Z]\\.\\.\\.$') then {c} >= 10 "
        f"when regexp_matches({t}, '^[A-Za-z]{{1,2}}$') then false else {c} >= 45 and length({t}) >= 3 end"
    )


def _precise(t: str, c: str) -> str:
    return f"coalesce({t} <> '' and not contains({t}, chr(10)) and {c} >= 80 and length({t}) >= 2, false)"


def _dilated(t: str, c: str) -> str:
    return f"(({_usable(t, c)}) and (not regexp_matches(coalesce({t}, ''), {_SHORT}) or coalesce({c}, 0) >= 80))"


def _weak(t: str, v: str, h: str) -> str:
    return (
        f"(coalesce({t}, '') <> '' and (len({_lines(t)}) >= 3 or {_fragments(t)} or regexp_matches({t}, {_SHORT}) "
        f"or ({h} >= 150 and (len({_lines(t)}) = 1 or ({v} = 'psm11' and len({_lines(t)}) <= 2)))))"
    )


def _preferred(first: str, t: str, c: str) -> str:
    """A thresholded reading beats the first one: usable, sure enough and longer, in more lines, or whole where that is in pieces."""
    return (
        f"({_dilated(t, c)} and {c} >= 70 and ((len({_lines(t)}) > len({_lines(first)}) and length({t}) >= length({first}) + 4) "
        f"or ({c} >= 80 and length({t}) >= length({first}) + 8) or ({_fragments(first)} and length({t}) >= length({first}) - 2) "
        f"or (regexp_matches({first}, {_SHORT}) and length({t}) > length({first}))))"
    )


def _selected(mode: str) -> str:
    """The stages one after the other: candidates by score, the thresholded one, fallbacks by the rule of their variant."""
    order = "['psm6', 'psm11', 'default', 'psm10', 'threshold-dilate', 'shadow-strip', 'fill-select', 'hollow-fill', 'hollow-repair', 'resize2-psm7', 'resize2-psm13', 'gray-auto-psm6', 'gray-auto-psm13', 'psm13']"
    pick = f"partition by file, track_id, ord order by {_score('text', 'confidence')} desc, coalesce(list_position({order}, variant), 99), id"
    competes = "variant in ('psm6', 'psm11', 'default') and coalesce(text, '') <> ''"
    if mode == "accurate":
        competes = f"({competes}) or (variant = 'threshold-dilate' and {_dilated('text', 'confidence')}) or (variant in ('shadow-strip', 'fill-select', 'hollow-fill', 'hollow-repair') and {_usable('text', 'confidence')})"
    retry = f" and {_weak('a.text', 'a.variant', 'i.ord % 7 * 30')}" if mode == "hybrid" else ""
    return f"""with {_READINGS}, i as (select file, track_id, ord, count(*) readings from r group by all),
      a as (select * from r where {competes} qualify row_number() over ({pick}) = 1),
      t as (select * from r where variant = 'threshold-dilate' and {_dilated('text', 'confidence')} qualify row_number() over ({pick}) = 1),
      f as (select * from r where case when variant = 'psm10' then {_precise('text', 'confidence')} when variant = 'threshold-dilate' then {_dilated('text', 'confidence')}
        when variant in ('psm6', 'psm11', 'default', 'shadow-strip', 'fill-select', 'hollow-fill', 'hollow-repair') then false else {_usable('text', 'confidence')} end qualify row_number() over ({pick}) = 1),
      c as (select i.*, case when a.id is null then f.id when t.id is not null and {_preferred('a.text', 't.text', 't.confidence')}{retry} then t.id else a.id end id
        from i left join a using (file, track_id, ord) left join t using (file, track_id, ord) left join f using (file, track_id, ord))
      select c.file, c.track_id, c.ord, readings, c.id, r.variant from c left join r on c.id = r.id"""


_IMAGES = """o as (select distinct file, track_id, ord, ocr_id, text, confidence, engine from ocr_result),
i as (select file, track_id, ord, arg_max_null(text, ocr_id) filter (where engine = 'tesseract-fast') d_text,
      arg_max_null(confidence, ocr_id) filter (where engine = 'tesseract-fast') d_conf,
      arg_max_null(text, ocr_id) filter (where engine = 'vision-accurate') c_text from o group by file, track_id, ord),
n as (select *, row_number() over (partition by file, track_id order by ord) - 1 as number, count(*) over (partition by file, track_id) total from i)"""


def _sampled(count: int) -> str:
    return f"""{_IMAGES}, s as (select * from n where total <= {count}
      or list_contains(list_transform(range({count}), lambda k: floor(k * (total - 1) / {count - 1} + 0.5)), number))"""


_FOLD_SHADOW = """
h0 as (select c_custkey, cast(floor(abs(c_acctbal) * 37) as bigint) v from customer),
h1 as (select c_custkey, unnest([{'g': v % 127, 'n': v // 7 % 900}, {'g': v % 122 + 128, 'n': v // 11 % 900}, {'g': 255::bigint, 'n': v % 3000}, {'g': 8::bigint, 'n': v % 41 * 50}]) x from h0),
h as (select c_custkey, x.g g, sum(x.n)::bigint n from h1 group by 1, 2),
s as (select c_custkey, sum(n)::bigint total, greatest(50, sum(n) * 0.005::double) least_, coalesce(sum(n) filter (where g >= 250), 0) back,
  coalesce(sum(n) filter (where g between 128 and 249), 0) light, coalesce(sum(n) filter (where g < 128), 0) dark,
  coalesce(sum(n) filter (where g >= 240), 0) white, coalesce(sum(n) filter (where g <= 16), 0) black from h group by 1),
pk as (select c_custkey, coalesce(min(g) filter (where g between 128 and 249 and n > 0 and rl = 1), 128) lp, coalesce(min(g) filter (where g < 128 and n > 0 and rd = 1), 0) dp from (
  select *, rank() over (partition by c_custkey, g between 128 and 249 order by n desc) rl, rank() over (partition by c_custkey, g < 128 order by n desc) rd from h) group by 1),
fp as (select s.c_custkey, any_value(least_) least_, any_value(total) total, max(g) filter (where n >= least_ and g >= 64) peak from s join h using (c_custkey) group by 1),
al as (select fp.c_custkey, peak, least_, total, (select max(x.k) from range(256) x(k) left join h on h.c_custkey = fp.c_custkey and h.g = x.k
        where x.k < peak and peak - x.k >= 8 and coalesce(h.n, 0) < least_) low0 from fp),
lw as (select *, coalesce(low0, -1) low from al),
fd as (select lw.c_custkey, any_value(peak) peak, any_value(total) total, any_value(low) low, sum(n) filter (where g > low and g <= peak) mass, max(g) filter (where g < low and n >= least_) below
       from lw join h using (c_custkey) group by 1)
"""

ORACLE = {
    "next_later_pts": f"with {_FRAMES} select file, ord, pts, coalesce(min(pts) over (partition by file order by pts range between 1 following and unbounded following), pts + 2500) as end_ms from f",
    "display_end": f"""with {_FRAMES},
      w as (select *, last_value(case when event_type <> 'view' then {{'ord': ord, 'pts': pts}} end ignore nulls) over (partition by file order by ord rows between unbounded preceding and 1 preceding) own from f),
      e as (select file, own.ord ord, arg_min(pts, ord) end_ms from w where own is not null and pts > own.pts group by file, own.ord)
      select f.file, f.ord, f.pts, e.end_ms from f left join e using (file, ord) where f.event_type <> 'view'""",
    "timing_fallback": f"""with {_FRAMES}, g as (select file, ord, case when event_type <> 'error' then pts / 1000 end p, case when event_type = 'purchase' then pts / 1000 + 1.5 end e from f),
      h as (select *, lead(p) over (partition by file order by ord) nxt, coalesce(p, ord * 3.0) s from g)
      select file, ord, s as start_s, coalesce(e, nxt, s + 2.5) as end_s from h""",
    "frame_numbers": f"""with {_FRAMES} select file, ord, row_number() over (partition by file order by ord) as number,
      last_value(case when event_type = 'error' then value end ignore nulls) over (partition by file order by ord rows between unbounded preceding and 1 preceding) as rate from f""",
    "output_status": f"""with {_TRACKS}, s as (select file, track_id, count(distinct ord) found, count(distinct ocr_id) filter (where {Q.strip("coalesce(text, '')")} <> '') visible from ocr_result group by 1, 2),
      j as (select distinct t.file, t.track_id, codec, forced_track, coalesce(found, 0) found, coalesce(visible, 0) visible from t left join s using (file, track_id))
      select file, track_id, found, visible, case when found = 0 then 'error' when visible > 0 then 'ok' when not {_SUB} then 'empty' when forced_track then 'empty' else 'error' end as status from j""",
    "dedup_first": "select sha1(text) as sha1, min(doc_id) as first, count(*) as copies from documents where text is not null group by 1",
    "dedup_fanout": f"""with m as (select text, min(doc_id) representative, {Q.text_health('text')} health from documents where text is not null group by text)
      select doc_id, representative, health from documents join m using (text)""",
    "mkv_tracks": f"""with {_TRACKS}, u as (select * replace (coalesce(language_code, 'und') as language_code, coalesce(default_track, false) as default_track, coalesce(forced_track, false) as forced_track) from t where codec in ('S_VOBSUB', 'S_HDMV/PGS'))
      select file, track_id, codec, language_code, language_ietf, default_track, forced_track, row_number() over (partition by file order by track_id) - 1 as index,
        row_number() over (partition by file, {_SUFFIX} order by track_id) - 1 as stem_index, {_LABEL} || ' (' || language_code || ')' || case when forced_track then ' forced' else '' end as label,
        case when {_SUB} then 'sub + idx' else 'sup' end as format from u""",
    "track_select": f"""with {_TRACKS} select file, track_id, {_LABEL} as language from t
      where coalesce(lower(language_code) in ('fre', 'de'), false) or lower(string_split(coalesce(language_ietf, ''), '-')[1]) in ('fre', 'de')""",
    "extract_plan": f"with {_PLAN} select file, track_id, output, track_id || ':' || output as spec, case when {_SUB} then 2 else 1 end as n_outputs from p",
    "plan_clashes": f"with {_PLAN} select path, count(*) as tracks from o group by path having count(*) > 1",
    "skip_existing": f"""with {_PLAN}, b as (select distinct file, track_id from ocr_result where text is null or trim(text, ' ') = ''),
      th as (select path from o where not exists (select 1 from b where b.file = o.file and b.track_id = o.track_id) or not ends_with(path, '.idx'))
      select distinct file, track_id, output from o where path not in (select path from th)""",
    "pair_idx_sub": f"""with {_PLAN}, x as (select distinct path, regexp_replace(path, '\\.[^.]*$', '') base, right(path, 3) ext from o where path[-3:] in ('idx', 'sub') and not (forced_track and ends_with(path, '.idx')))
      select a.path as idx, b.path as sub from x a join x b on a.base = b.base where a.ext = 'idx' and b.ext = 'sub'""",
    "language_groups": f"""with {_TRACKS}, g as (select coalesce(language_code, 'und') language_code, count(*) tracks, count(distinct file) files, min({{'file': file, 'index': index}}) fst from t group by 1)
      select language_code, tracks, files, row_number() over (order by fst, language_code) as place from g""",
    "cache_lookup": """with a as (select doc_id, lang, source, file, sha256(sha256(text) || chr(31) || 'generic' || chr(31)) k from documents where text is not null),
      m as (select k, min(doc_id) d from a where lang is not null group by k), e as (select m.k, doc_id, lang, source, file from m join a on m.d = a.doc_id),
      c as (select k, case lang when 'en' then 'engine-2' when 'fr' then null when 'de' then 'absent' else 'engine-1' end ev, case when source = 'qc_report' then 2 else 3 end rev,
        coalesce(source, '') <> 'forum_note' vis, case when file is not null then 'srt of ' || doc_id end srt from e),
      w as (select *, case when coalesce(srt, '') = '' then 'malformed' when ev is not null and ev <> 'absent' and ev <> 'engine-2' then 'engine' when rev <> 3 then 'revision' when not vis then 'vision' else 'hit' end why from c)
      select a.doc_id, coalesce(w.why, 'miss') as outcome, case when w.why = 'hit' then w.srt end as srt from a left join w on a.k = w.k""",
    "cache_store": """with e as (select sha256(text) k, max(source) source from documents where text is not null group by 1)
      select case when source = 'transcript' then 'new' else 'old' end as srt, count(*) as entries, count(distinct k) as different from e group by 1""",
    "queue_upsert": """with q as (select * from customer where c_acctbal >= 0), i as (select * from customer where c_mktsegment in ('BUILDING', 'MACHINERY'))
      select coalesce(q.c_custkey, i.c_custkey) as c_custkey, case when q.c_custkey is not null then q.c_nationkey else -1 end as language,
        coalesce(i.c_name, 'old') as handle, i.c_custkey is not null as selected from q full join i on q.c_custkey = i.c_custkey""",
    "even_sample": f"with {_sampled(7)} select file, track_id, ord, number from s",
    "engine_probe": f"""with {_sampled(24)},
      d as (select *, coalesce(d_text, '') <> '' or coalesce(c_text, '') <> '' rd, {Q.text_health('d_text')} dh, {Q.text_health('c_text')} ch from s),
      g as (select file, track_id, count(*) filter (where rd) readable, round(coalesce(avg(coalesce(dh, 0)) filter (where rd), 0), 9) default_score,
        round(coalesce(avg(coalesce(ch, 0)) filter (where rd), 0), 9) challenger_score, round(coalesce(avg(coalesce(d_conf, 0)) filter (where rd), 0), 9) default_confidence from d group by 1, 2)
      select *, challenger_score > default_score + 0.025::double and default_confidence < 88 as use_challenger from g""",
    "candidate_select": _selected("accurate"),
    "candidate_select_hybrid": _selected("hybrid"),
    "reading_flags": f"""with {_READINGS} select id, round({_score('text', 'confidence')}, 6) as score, {_usable('text', 'confidence')} as usable, {_precise('text', 'confidence')} as precise,
      {_dilated('text', 'confidence')} as dilated, case when coalesce(text, '') = '' then false else len({_lines('text')}) >= 3 or {_fragments('text')} or regexp_matches(text, {_SHORT})
        or (length(variant) * 20 >= 150 and (len({_lines('text')}) = 1 or (variant = 'psm11' and len({_lines('text')}) <= 2))) end as weak from r""",
    "line_regroup": f"""with {_READINGS}, l as (select id, unnest(range(len(string_split(text, chr(10))))) k, string_split(text, chr(10)) ls from r where text is not null),
      w as (select id, k, list_filter(string_split(ls[k + 1], ' '), lambda x: x <> '') ws from l),
      x as (select id, k, ws, k % 2 key from w where len(ws) > 0), y as (select *, lag(key) over (partition by id order by k) pk from x),
      j as (select id, string_agg(case when pk is null then '' when pk = key then ' ' else chr(10) end || array_to_string(ws, ' '), '' order by k) t,
        sum(list_sum(list_transform(ws, lambda q: length(q) * 10.0 - 10))) c, sum(len(ws)) n from y group by id)
      select r.id, coalesce(round(c::double / n, 6), 0) as confidence, coalesce({Q.clean_ocr_text('t')}, '') as text, coalesce(n, 0)::int as words from r left join j using (id) where r.text is not null""",
    "command_output": """select distinct ocr_id, case when engine = 'vision-accurate' then text else trim(text, ' ') end as text,
      case when engine = 'vision-accurate' then coalesce(confidence, 0) else 0 end as confidence from ocr_result where text is not null""",
    "batch_defaults": """with o as (select distinct file, track_id, ord, ocr_id, text, engine, warnings from ocr_result),
      v as (select file, track_id, ord, arg_max({'t': text, 'w': warnings}, ocr_id) r from o where engine = 'vision-accurate' group by 1, 2, 3), i as (select distinct file, track_id, ord from o)
      select i.file, i.track_id, i.ord, coalesce(v.r.t, '') as text, case when v.file is null then 'vision-missing-result' else coalesce(array_to_string(v.r.w, ';'), '') end as warnings
      from i left join v on i.file = v.file and i.track_id = v.track_id and i.ord = v.ord""",
    "engine_failures": """with i as (select distinct file, track_id, ord from ocr_result), v as (select distinct file, track_id, ord from ocr_result where engine = 'vision-accurate')
      select i.file, i.track_id, count(*) filter (where v.file is null) as failed, count(*) as images, bool_and(v.file is null) as all_failed
      from i left join v on i.file = v.file and i.track_id = v.track_id and i.ord = v.ord group by 1, 2""",
    "histogram256": """with e as (select vec_id, least(255, greatest(0, floor((unnest(embedding)::double + 0.5) * 255)))::bigint g from embeddings),
      c as (select vec_id, g, count(*) n from e group by 1, 2), s as (select vec_id, sum(n)::bigint total, sum(n * g)::double s1, sum(n * g * g)::double s2, arg_max(g, {'n': n, 'g': -g}) as mode from c group by 1)
      select vec_id, total, round(s1 / total / 255, 9) as mean, round(sqrt(greatest(0, s2 / total - pow(s1 / total, 2))) / 255, 9) as deviation, mode from s""",
    "repair_decisions": f"""with {_FOLD_SHADOW}
      select s.c_custkey, case when ok then floor((dp + lp) / 2 / 255 * 100 + 0.5)::int end as low, case when ok then floor((lp + 255) / 2 / 255 * 100 + 0.5)::int end as high,
        case when fd.peak is not null and fd.mass <= 0.35::double * fd.total and fd.peak - fd.below >= 24 then floor((fd.peak + fd.below) / 2 / 255 * 100 + 0.5)::int end as fill,
        s.total > 0 and black + white >= 0.97::double * s.total and white >= 0.02::double * s.total and white <= 0.5::double * s.total as hollow
      from (select s.*, lp, dp, total > 0 and back >= 0.4::double * total and light >= 100 and dark >= 0.85::double * light and lp - dp >= 64 and lp <= 235 ok from s join pk using (c_custkey)) s
      join fd using (c_custkey)""",
    "listing_pairs": """with s as (select distinct file base, file || '.sup' as name from cue), r as (select distinct file base, file || '-eng.srt' reference from ref_cue),
      c as (select base, max_by(n, l) candidate from (select file base, file || '.srt' n, 0 l from cand_cue union all select file, file || '-eng.srt', 1 from track) group by base)
      select base, name, reference, candidate, reference is not null and candidate is not null as complete from s left join r using (base) left join c using (base)""",
    "fixture_gaps": """select distinct cue_id, 'partial' as status, "start", true as elsewhere from ref_cue where "start" is not null and starts_with(text, '[')""",
    "csv_report": """with c as (select distinct file, ord, text, "start" from cue),
      q as (select *, case when regexp_matches(coalesce(text, ''), '[,"\\n]') then '"' || replace(text, '"', '""') || '"' else coalesce(text, '') end qt from c)
      select file, ord, ord || ',' || qt || ',,' || file as line from q""",
    "json_report": "select distinct ocr_id, text, confidence from ocr_result",
    "inspection_manifest": PAIRED + """, mi as (select file, ref_id, ref_start, floor(ref_start) k from p where cand_id is null),
      im as (select file, floor(s) k, arg_max(id, {'o': ord, 'i': id}) image from cand group by 1, 2)
      select mi.file, ref_id, ref_start as "start", image, '/set/' || mi.file || '.sup' as stream,
        '{"name":"' || mi.file || '","start":' || ref_start || ',"path":"' || mi.file || '-' || printf('%010d', cast(floor(ref_start * 1000 + 0.5) as bigint)) || '.png"' || case when image is null then '' else ',"image":' || image end || '}' as line
      from mi left join im on mi.file = im.file and mi.k = im.k""",
    "inspection_limits": PAIRED + "select file, ref_id from (select * from p where cand_id is null order by file, ref_start, ref_id limit 100)",
    "unique_names": """with n as (select p_partkey, replace(p_name, ' ', '_') stem, row_number() over (partition by p_name order by p_partkey) k from part)
      select p_partkey, stem || case when k = 1 then '' else '-' || k end || '.srt' as "unique" from n""",
    "batch_outcomes": f"""with {_TRACKS}, s as (select distinct file, track_id from ocr_result)
      select t.file, count(*) as tracks, count(s.file) as extracted, count(*) - count(s.file) as failures, array_to_string(list_sort(list_distinct(list(coalesce(language_code, 'und')))), ',') as languages
      from t left join s on t.file = s.file and t.track_id = s.track_id group by t.file""",
    "png_roundtrip": "select vec_id, true as same from embeddings",
    "pgs_decode": """with c as (select distinct file, cue_id, "start" s, "end" e, cue_id // 100 chunk from ref_cue where "start" is not null and "end" is not null and "end" > "start"),
      n as (select *, row_number() over (partition by file, chunk order by s, cue_id) - 1 k from c)
      select file || '#' || chunk as file, (2 * k)::int as ord, floor(s * 90000 + 0.5) / 90000 as pts, (25 + cue_id % 7)::int as content_width, (6 + cue_id % 5)::int as content_height, cue_id % 5 > 0 as usable from n
      union all select file || '#' || chunk, (2 * k + 1)::int, floor(e * 90000 + 0.5) / 90000, null, null, false from n""",
    "job_progress": """select user_id::varchar as job, count(*) filter (where event_type = 'signup') as started, count(*) filter (where event_type = 'purchase') as finished,
      count(*) filter (where event_type = 'error') as failed, bool_or(event_type = 'error') as has_failed, round(sum(value), 3) as duration_ms
      from events where event_type in ('signup', 'purchase', 'error') group by 1""",
}
ORACLE["job_progress_stream"] = ORACLE["job_progress"]
ORACLE["job_outputs"] = """with o as (select user_id::varchar as job, props as output, min(epoch_us(ts) // 1000) as first_ms
      from events where event_type = 'purchase' and props <> '' group by 1, 2)
      select job, row_number() over (partition by job order by first_ms, output) as position, output, first_ms from o"""
ORACLE["job_outputs_stream"] = ORACLE["job_outputs"]
ORACLE["reading_order"] = """with recursive b as (select vec_id, i, embedding[2 * i + 1]::double y, embedding[2 * i + 2]::double x from (select vec_id, embedding, unnest(range(len(embedding) // 2)) i from embeddings)),
      o as (select *, row_number() over (partition by vec_id order by y desc, x, i) k from b),
      r as (select vec_id, k, i, x, y as top, 0 as line from o where k = 1
        union all
        select o.vec_id, o.k, o.i, o.x, case when abs(o.y - r.top) > 0.03::double then o.y else r.top end, r.line + (abs(o.y - r.top) > 0.03::double)::int from r join o on o.vec_id = r.vec_id and o.k = r.k + 1)
      select vec_id, string_agg(i::varchar, ',' order by line, x, i) as ids from r group by vec_id"""

"""DuckDB SQL of those queries that SQL can express."""

from __future__ import annotations

from lendscope.llm.quality_rules import MAX_REPEATED, MIN_WORDS, RULES, STOP_WORDS

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_BARE = r"""regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '[.,;:!?"()]', '', 'g')), '[^\x20\x09-\x0D]+')"""
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_RULES = " or ".join(
    f"(n_words >= {r.from_words} and 100 * {r.measure} {'<' if r.least else '>'} {r.limit} * {r.base})" for r in RULES)

#: Measures and verdict of the table or subquery ``{rows}`` (doc_id, text); rows are told apart by ``rid``.
QUALITY = rf"""
src as (select row_number() over () rid, doc_id, coalesce(text, '') t, {_WORDS} ws, {_BARE} bare,
               list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls
        from ({{rows}})),
wins as (select rid, unnest(range(1, len(ws) - 3)) i, ws from src where len(ws) >= 5),
tagged as (select rid, i, count(*) over (partition by rid, ws[i], ws[i+1], ws[i+2], ws[i+3], ws[i+4]) c from wins),
hit as (select distinct rid, i + d p from tagged, (values (0), (1), (2), (3), (4)) v(d) where c > 1),
rep as (select rid, count(*) n from hit group by rid),
m as (select src.rid, doc_id, len(ws)::bigint n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols,
             (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, coalesce(rep.n, 0)::bigint n_repeat_words,
             len(ls)::bigint n_lines, length(regexp_replace(t, '[^!]', '', 'g'))::bigint n_bangs,
             length(regexp_replace(t, '[^A-Z]', '', 'g'))::bigint n_upper,
             len(list_filter(bare, lambda w: w in ({_STOP})))::bigint n_stop_words
      from src left join rep using (rid)),
judged as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEATED} * n_words base_failed from m),
verdict as (select *, not (base_failed or {_RULES}) kept from judged)"""

#: Sizes, targets and words taken of ``{{rows}}`` (doc_id, source, text), by the sampling keys of the operator.
MIX = rf"""
drawn as (select doc_id, source, len({_WORDS})::bigint size,
                 -ln((('0x' || substr(md5('17:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint + 0.5::double) / 4503599627370496::double)
                 / greatest(length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D#*$%&|<>!]', '', 'g'))::double
                            / greatest(length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')), 1), 0.1::double) k
          from ({{rows}})),
sizes as (select source, sum(size)::bigint source_size from drawn group by source),
ranked as (select *, row_number() over (order by source nulls last) n from sizes),
weighed as (select *, [3, 1, 2][(n - 1) % 3 + 1] w from ranked),
sums as (select *, coalesce(sum(source_size) over before, 0)::bigint s_before, coalesce(sum(w) over before, 0)::bigint w_before,
                sum(source_size) over ()::bigint s_all, sum(w) over ()::bigint w_all from weighed
         window before as (order by source_size::double / w, n rows between unbounded preceding and 1 preceding)),
levels as (select *, (1.5::double * s_all - (2 * s_before)::double) / (w_all - w_before)::double lev from sums),
top as (select *, max(case when lev * w <= 2 * source_size then lev end) over () l from levels),
targets as (select source, source_size,
                   case when l is null then 2 * source_size::double else least(2 * source_size::double, l * w) end target from top),
summed as (select *, sum(size) over (partition by source order by k, doc_id)::bigint reach from drawn),
whole as (select doc_id, summed.source, size, source_size, target, reach, floor(target / greatest(source_size, 1)) full_epochs
          from summed join targets on summed.source is not distinct from targets.source),
times as (select *, case when source_size = 0 then 1 else least(full_epochs
                    + (case when reach - size::double / 2 < target - full_epochs * source_size then 1 else 0 end), 2) end::int epochs from whole)"""

#: Components of near duplicates of ``{{rows}}`` (doc_id, text) at ``{{percent}}`` per cent, by comparing all pairs that share a shingle.
NEAR = r"""
lowered as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x20\x09-\x0D]+') ws from ({rows})),
shingle as (select distinct doc_id, array_to_string(ws[i:i + 4], ' ') s from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) i
            from lowered where len(ws) > 0)),
sized as (select lowered.doc_id, count(s)::bigint n from lowered left join shingle using (doc_id) group by lowered.doc_id),
pair as (select a.doc_id x, b.doc_id y, count(*) both_have from shingle a join shingle b on a.s = b.s and a.doc_id < b.doc_id group by all),
link as (select x, y from pair join sized sx on sx.doc_id = x join sized sy on sy.doc_id = y
         where 100 * both_have >= {percent} * (sx.n + sy.n - both_have)),
edge as (select x, y from link union select y, x from link),
reach as (select doc_id origin, doc_id there from sized union select origin, y from reach join edge on there = x),
near as (select doc_id, n n_shingles, min(there)::bigint component_id from sized join reach on origin = doc_id group by doc_id, n)"""



def _crc_table() -> str:
    """The 256 table entries of CRC-32 (reversed polynomial 0xEDB88320), eight hexadecimal digits each."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(f"{c:08x}")
    return "".join(out)


#: Shards of the groups of equal texts: binary search of the capacity, a greedy pass folded into one number
#: (shards before the current one above 44 bits, its fill below), then the greedy pass itself.
#: CRC-32 is folded byte by byte.
SHARDS = """
summed as (select t, xor(list_reduce([4294967295::bigint] || list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: ('0x' || h)::bigint),
                                     lambda c, b: xor(('0x' || substr('CRC_TABLE', (xor(c, b) & 255) * 8 + 1, 8))::bigint, c >> 8)), 4294967295)::bigint text_crc32
           from (select distinct coalesce(text, '') t from documents)),
sized as (select doc_id, coalesce(text, '') t, strlen(coalesce(text, ''))::bigint + 1 size from documents),
grouped as (select t, min(doc_id) lead, sum(size)::bigint w from sized group by t),
placed as (select lead, t, w, row_number() over (order by lead) i from grouped),
whole as (select list(w order by i) ws, sum(w)::bigint total, count(*) n from placed),
search as (
  select 0::bigint lo, total hi, 0 step from whole
  union all
  select case when fits then lo else mid end, case when fits then mid else hi end, step + 1 from (
    select lo, hi, step, mid, (list_reduce(ws, lambda a, w: case when (a & 17592186044415) + w > mid
                                           then (((a >> 44) + 1) << 44) + w else a + w end) >> 44) + 1 <= 16 fits
    from (select lo, hi, step, (lo + hi) // 2 mid, ws from search, whole where hi - lo > 1))),
capacity as (select min(hi) c from search),
prefix as (select i, sum(w) over (order by i)::bigint r from placed),
cuts as (
  select 0 shard, 0::bigint after, 0::bigint r union all
  select shard + 1, next.i, next.r from (
    select shard, (select greatest(coalesce(max(p.i), 0), cuts.after + 1) from prefix p where p.r <= cuts.r + c) i from cuts, capacity
    where cuts.after < (select n from whole)) step join prefix next on next.i = step.i),
pass as (select p.i, max(cuts.shard) shard from prefix p join cuts on cuts.after < p.i group by p.i)"""

#: Masks of failed filters (``masks``: part, mask, good, toxic) of ``documents``.
AUDIT = r"""
words as (select doc_id, coalesce(source, '') part, coalesce(text, '') t,
                 regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
judged as (select words.*, min(doc_id) over (partition by t) lowest from words),
marks as (select doc_id, max((quality = 1)::int) good, max((toxic = 1)::int) toxic from labels group by doc_id),
masks as (select part, (case when len(ws) < 200 then 1 else 0 end)
                 + (case when 100 * len(list_distinct(ws)) < 50 * len(ws) then 2 else 0 end)
                 + (case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) then 4 else 0 end)
                 + (case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end)
                 + (case when doc_id > lowest then 16 else 0 end) mask,
                 coalesce(good, 0) good, coalesce(toxic, 0) toxic
          from judged left join marks using (doc_id)),
cell as (select part, mask, count(*)::bigint n, sum(good)::bigint good, sum(toxic)::bigint toxic from masks group by all),
letters as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
prefixes as (select '' prefix, '' letter, 0 bit, 0 applied, 0 step
             union all
             select prefix || l.letter, l.letter, l.bit, applied | prefixes.bit, step + 1
             from prefixes join letters l on not contains(prefix, l.letter)),
steps as (select part, prefix, letter, step,
                 coalesce(sum(n) filter (mask & (applied | bit) = 0), 0)::bigint kept,
                 coalesce(sum(n) filter (mask & bit <> 0 and mask & applied = 0), 0)::bigint removed,
                 coalesce(sum(n) filter (mask & bit <> 0 and mask & applied <> 0), 0)::bigint redundant,
                 coalesce(sum(n) filter (mask = bit), 0)::bigint unique_fails,
                 coalesce(sum(good) filter (mask & bit <> 0 and mask & applied = 0), 0)::bigint good_lost,
                 coalesce(sum(toxic) filter (mask & bit <> 0 and mask & applied = 0), 0)::bigint toxic_lost
          from prefixes, cell where step > 0 group by all),
orders as (select prefix filter_order from prefixes where step = 5),
listed as (select filter_order, steps.* from orders join steps on starts_with(filter_order, prefix))"""

#: Collocations of ``documents``: every phrase counted on its own.
PHRASES = r"""
piece as (select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) p from documents),
words as (select lang, regexp_extract_all(p, '[^\x20\x09]+') ws from piece),
gram as (select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) phrase
         from words, range(1, 5) t(k) where len(ws) >= k),
f as (select lang, k, phrase, count(*)::hugeint f from gram group by all),
n as (select lang, sum(f)::bigint n from f where k = 1 group by lang),
cand as (select lang, k, phrase, f a, string_split(phrase, ' ') ws from f where k >= 2 and f >= 30),
cut as (select cand.*, c, array_to_string(ws[:c], ' ') x, array_to_string(ws[c + 1:], ' ') y from cand, range(1, 4) t(c) where c < k),
scored as (select cut.lang, cut.phrase, a, c, fx.f l, fy.f r, (2000000::hugeint * a) // (fx.f + fy.f) score
           from cut join f fx on fx.lang = cut.lang and fx.phrase = x join f fy on fy.lang = cut.lang and fy.phrase = y),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, c) = 1),
inside as (select lang, unnest(list_transform(range(1, k - j + 2), lambda i: array_to_string(ws[i:i + j - 1], ' '))) phrase, a longer
           from cand, range(2, 4) t(j) where j < k),
held as (select lang, phrase, max(longer) longer from inside group by all),
kept as (select lowest.* from lowest left join held using (lang, phrase) where longer is null or 100 * longer < 80 * a)"""

SQL: dict[str, str] = {
    "op12_collocations": "with " + PHRASES + """
select lang, rank, phrase, a::bigint a, l::bigint l, r::bigint r, n, score::bigint score
from (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) rank from kept) join n using (lang)
where rank <= 2000""",
    "op13_filter_audit": "with recursive " + AUDIT + """
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) over (partition by part, letter))::bigint shapley from listed""",
    "op7_sharding": "with recursive " + SHARDS.replace("CRC_TABLE", _crc_table()) + """
select doc_id, size, text_crc32, 'bytes' law, shard,
       row_number() over (partition by shard order by lead, doc_id) - 1 slot, null::integer grown_shard
from sized join placed using (t) join pass using (i) join summed using (t)""",
    "op2_near_dedup": "with recursive " + NEAR.format(rows="select doc_id, text from documents", percent=85) + """
select doc_id, n_shingles, component_id, doc_id = component_id kept from near""",
    "op4_quality_rules": "with " + QUALITY.format(rows="select doc_id, text from documents") + """
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, n_bangs, n_upper,
       n_stop_words from verdict""",
    "op6_exact_dedup": """
select doc_id, max(doc_id) over same keep_id, count(*) over same group_size,
       doc_id is not distinct from max(doc_id) over same kept, sha256(coalesce(text, '')) text_sha256
from documents window same as (partition by coalesce(text, ''))""",
    "op9_mixing": "with " + MIX.format(rows="select doc_id, source, text from documents") + """
select doc_id, size, source_size, target, (epochs * size)::bigint taken from times""",
}

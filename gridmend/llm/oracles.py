"""DuckDB SQL that gives the same rows as the queries, where SQL can."""

from __future__ import annotations

from . import chat_format, sharding
from . import filter_audit as filter_audit_module
from .quality_rules import MAX_REPEAT_PERCENT, MIN_WORDS, SYMBOLS, Rules

WORD = r"[^\x20\x09-\x0D]"


def quality_rules(rules: Rules = Rules()) -> str:
    """Op 1: the same counts, histograms and fences."""
    names = [k for k, _ in rules.floors]
    value = lambda b: f"cast(case when {b} < 64 then {b} else floor(({b} - 32 * ({b} // 32 - 1)) * pow(2.0, {b} // 32 - 1)) end as bigint)"
    bucket = "case when v < 64 then v else (length(bin(v)) - 6) * 32 + cast(floor(v / pow(2.0, length(bin(v)) - 6)) as bigint) end"

    def level(keys: str) -> str:
        part = f"{keys}, k" if keys else "k"
        run = f"select {part}, b, sum(n) over (partition by {part} order by b) as upto, sum(n) over (partition by {part}) as total from (select {part}, b, sum(n) as n from sketch group by all)"
        quart = lambda q: f"min(case when upto * 4 >= total * {q} then b end)"
        return f"select {part}, n, {value('b1')} as lo, {value('b3')} as hi from (select {part}, max(total) as n, {quart(1)} as b1, {quart(3)} as b3 from ({run}) group by {part})"

    drawn = lambda k: f"((s2.n * s2.{k} + {rules.prior} * ((s1.n * s1.{k} + {rules.prior} * s0.{k}) / (s1.n + {rules.prior}))) / (s2.n + {rules.prior}))"
    floors = " ".join(f"when '{k}' then {x}" for k, x in rules.floors)
    at = ", ".join(f"max(case when k = '{k}' then {side} end) as {k}_{side}" for k in names for side in ("least", "most"))
    inside = " and ".join(f"coalesce(m.{k} between f.{k}_least and f.{k}_most, false)" for k in names)
    return f"""with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t, lang, source from documents),
w as (select *, regexp_extract_all(t, '{WORD}+') as w from d),
win as (select rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as k from (select rid, w, unnest(range(1, len(w) - 1)) as i from w)),
rep as (select rid, count(distinct p) as n from (select rid, unnest([i, i + 1, i + 2]) as p from (select *, count(*) over (partition by rid, k) as c from win) where c > 1) group by rid),
lines as (select rid, count(*) as n, count(*) - count(distinct line) as dup from (select rid, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '{WORD}') group by rid),
c as (select w.*, cast(len(w) as bigint) as n_words, cast(length(list_aggregate(list_concat([''], w), 'string_agg', '')) as bigint) as word_chars, cast(length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g')) as bigint) as n_symbols,
  coalesce(lines.dup, 0) as n_dup_lines, coalesce(lines.n, 0) as n_lines, coalesce(rep.n, 0) as n_repeat_words from w left join lines using (rid) left join rep using (rid)),
m as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed,
  case when n_words > 0 then n_symbols * 1000 // n_words else 0 end as symbol_rate, case when n_words > 0 then (word_chars * 1000 // n_words) // 10 else 0 end as word_length,
  case when n_lines > 0 then n_dup_lines * 1000 // n_lines else 0 end as dup_line_rate, case when n_words > 0 then n_repeat_words * 1000 // n_words else 0 end as repeat_rate from c),
long as ({" union all ".join(f"select lang, source, '{k}' as k, {k} as v from m where not base_failed" for k in names)}),
sketch as (select lang, source, k, b, count(*) as n from (select lang, source, k, {bucket} as b from long) group by all),
s2 as ({level("lang, source")}), s1 as ({level("lang")}), s0 as ({level("")}),
picked as (select s2.lang, s2.source, s2.k, {drawn("lo")} as lo, {drawn("hi")} as hi,
  case s2.k {floors} end as fl from s2 join s1 on s2.lang is not distinct from s1.lang and s2.k = s1.k join s0 on s2.k = s0.k),
spans as (select lang, source, k, lo - {rules.spread} * greatest(hi - lo, fl) as least, hi + {rules.spread} * greatest(hi - lo, fl) as most from picked),
f as (select lang, source, {at} from spans group by lang, source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {inside} as kept
from m left join f on m.lang is not distinct from f.lang and m.source is not distinct from f.source"""


def sharding_key(n_shards: int = 24) -> str:
    """Op 4: the same draws, and a checksum by its definition."""

    def bits(label: str) -> str:
        return f"cast('0x' || substr(md5({label}), 1, 13) as bigint)"

    def descend(node: sharding.Node) -> str:
        if node.shard is not None:
            return str(node.shard)
        if len(node.children) == 1:
            return descend(node.children[0])
        draws = ", ".join(f"-ln(({bits(f"key || ':{c.path}'")} + 1) / 4503599627370496.0) / {c.weight!r}" for c in node.children)
        whens = " ".join(f"when {i + 1} then {descend(c)}" for i, c in enumerate(node.children))
        return f"case list_position([{draws}], list_min([{draws}])) {whens} end"

    groups = f"greatest({sharding.LEAST_GROUPS}, (select count(*) from documents) // {sharding.GROUP_ROWS})"
    return f"""with steps as (select list(c order by i) as t from (select i, list_reduce(list_concat([cast(i as ubigint)], [cast(x as ubigint) for x in range(8)]), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end) as c from range(256) r(i))),
d as (select doc_id, coalesce(cast(doc_id as varchar), 'null') as key, coalesce(text, '') as text from documents),
h as (select doc_id, key, octet_length(encode(text)) + 8 as size, [cast('0x' || b as ubigint) for b in regexp_extract_all(hex(encode(text)), '..')] as bytes from d),
c as (select doc_id, key, cast(size as bigint) as size, cast(xor(list_reduce(list_concat([4294967295::ubigint], bytes), lambda c, b: xor(c >> 8, t[cast(1 + (xor(c, b) & 255) as bigint)])), 4294967295::ubigint) as bigint) as text_crc32 from h, steps),
s as (select doc_id, size, text_crc32, {descend(sharding.tree(n_shards))} as shard, {descend(sharding.tree(n_shards + 1))} as grown_shard, key from c),
g as (select *, {bits("key || ':' || size || ':' || text_crc32 || ':' || shard || ':' || grown_shard")} % {groups} as grp from s)
select doc_id, size, text_crc32, 'key' as law, cast(shard as integer) as shard, row_number() over (partition by shard order by grp, doc_id nulls first, size, text_crc32, grown_shard) - 1 as slot, cast(grown_shard as integer) as grown_shard from g"""


def chat_format_digests() -> str:
    """Op 6: what the turns are, and how long they are when formatted."""

    def escaped(x: str) -> str:
        for plain, entity in chat_format.ENTITIES:
            x = f"replace({x}, '{plain}', '{entity}')"
        return x

    frame = len(chat_format.OPEN) + len(chat_format.MID) + len(chat_format.CLOSE)
    probe = "</s>[INST] ok [/INST]"
    return f"""with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -1, 0, 'user', '{probe}' union all select -1, 1, 'assistant', '{probe}')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(case when role = 'assistant' then length(text) end), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '')) as loss_sha256,
  cast(sum({frame} + length({escaped("role")}) + length({escaped("text")})) as bigint) as formatted_chars from t group by conv_id"""


_CRC_STEPS = """steps as (select list(c order by i) as t from (select i, list_reduce(list_concat([cast(i as ubigint)], [cast(x as ubigint) for x in range(8)]), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end) as c from range(256) r(i)))"""


def structure_repair() -> str:
    """Op 11: the cheapest and then least edits by recursion from each conversation's end."""
    said = lambda c: f"coalesce(cast({c} as varchar), ' ')"
    return f"""with recursive {_CRC_STEPS},
keyed as (select conv_id, turn, {said("role")} as role, {said("text")} as text, [cast('0x' || b as ubigint) for b in regexp_extract_all(hex(encode({said("conv_id")} || ':' || {said("turn")})), '..')] as bytes from conversations),
hit as (select *, xor(list_reduce(list_concat([4294967295::ubigint], bytes), lambda c, b: xor(c >> 8, t[cast(1 + (xor(c, b) & 255) as bigint)])), 4294967295::ubigint) % 20 as h from keyed, steps),
damaged as (select conv_id, turn, case h when 4 then 'user' else role end as role, case h when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case h when 3 then [0, 1] else [0] end) as again from hit where h <> 0),
numbered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, again) as i, substr(role, 1, 1) as initial, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') as said from damaged),
faulty as (select *, case when said = '' then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate' when right(said, 1) not in ('.', '!', '?') then 'truncated' end as fault, lag(initial) over (partition by conv_id order by i) as prev from numbered),
sized as (select conv_id as cid, count(*) as n from faulty group by conv_id),
arc(s, letter, target, must_keep) as (values (0, 'D', 0, null), (1, 'D', 1, null), (2, 'D', 2, null), (3, 'D', 3, null), (0, 'R', 2, null), (1, 'R', 2, null), (3, 'R', 2, null), (2, 'R', 3, null), (0, 'K', 1, 's'), (0, 'K', 2, 'u'), (1, 'K', 2, 'u'), (3, 'K', 2, 'u'), (2, 'K', 3, 'a')),
ins(s, target, k) as (values (0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (0, 2, 1), (0, 3, 2), (1, 2, 1), (1, 3, 2), (2, 3, 1), (3, 2, 1)),
best(cid, i, s, plan) as (
  select cid, n, s, plan from sized, (values (0, '000000000'), (1, '000000004II'), (2, '000000002I'), (3, '000000000')) e(s, plan)
  union all
  select cid, i, s, min(plan) as plan from (
    select c.cid, c.i, ins.s, lpad(cast(cast(left(c.plan, 9) as bigint) + 2 * k as varchar), 9, '0') || repeat('I', k) || substr(c.plan, 10) as plan from (
      select b.cid, b.i - 1 as i, a.s, min(lpad(cast(cast(left(b.plan, 9) as bigint) + case a.letter when 'D' then 3 when 'R' then 2 else 0 end + case when f.fault = 'truncated' and a.letter <> 'D' then 1 else 0 end as varchar), 9, '0') || a.letter || substr(b.plan, 10)) as plan
      from best b join faulty f on f.conv_id is not distinct from b.cid and f.i = b.i join arc a on a.target = b.s and (a.letter = 'D' or coalesce(f.fault, '') not in ('blank', 'duplicate')) and (a.must_keep is null or a.must_keep = f.initial)
      group by b.cid, b.i, a.s) c join ins on ins.target = c.s) group by cid, i, s),
plans as (select cid, cast(left(plan, 9) as bigint) as cost, substr(plan, 10) as audit from best where i = 0 and s = 0),
letters as (select cid, unnest(range(1, length(audit) + 1)) as p, audit from plans),
spelt as (select cid, p, substr(audit, p, 1) as letter, length(replace(substr(audit, 1, p), 'I', '')) as i, length(replace(substr(audit, 1, p), 'D', '')) as o from letters),
outs as (select l.*, f.role, f.text, max(case when o = 1 and letter = 'K' and f.initial = 's' then 1 else 0 end) over (partition by l.cid) as off from spelt l left join faulty f on l.letter <> 'I' and f.conv_id is not distinct from l.cid and f.i = l.i where l.letter <> 'D'),
fixed as (select cid, string_agg(case letter when 'K' then role else case when (o - off) % 2 = 1 then 'user' else 'assistant' end end || ':' || case letter when 'I' then '' else text end, chr(10) order by p) as text from outs group by cid),
counts as (select conv_id as cid, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated, count(*) filter (i > 1 and prev || initial not in ('su', 'ua', 'au')) as illegal from faulty group by conv_id)
select c.conv_id, coalesce(n.gaps, 0) as gaps, coalesce(n.blank, 0) as blank, coalesce(n.duplicate, 0) as duplicate, coalesce(n.truncated, 0) as truncated, coalesce(n.illegal, 0) as illegal, coalesce(p.cost, 0) as cost, coalesce(p.audit, '') as audit, sha256(coalesce(f.text, '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join counts n on n.cid is not distinct from c.conv_id left join plans p on p.cid is not distinct from c.conv_id left join fixed f on f.cid is not distinct from c.conv_id"""


def filter_audit() -> str:
    """Op 12: each step of each order from the cells of masks."""
    letters = filter_audit_module.FILTERS
    bits = " union all ".join(f"select '{x}' as l, {1 << i} as b" for i, x in enumerate(letters))
    return f"""with t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '{WORD}+') as w, min(doc_id) over (partition by t) as least from t),
said as (select doc_id, bool_or(coalesce(quality = 1, false)) as good, bool_or(coalesce(toxic = 1, false)) as toxic from labels group by doc_id),
m as (select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic, case when len(w) < 200 then 1 else 0 end + case when 100 * len(list_distinct(w)) < 50 * len(w) then 2 else 0 end + case when 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) then 4 else 0 end
  + case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end + case when w.doc_id > least then 16 else 0 end as mask from w left join said using (doc_id)),
cells as (select part, mask, count(*) as n, count(*) filter (good) as g, count(*) filter (toxic) as x from m group by part, mask),
f as ({bits}),
orders as (select a.l || b.l || c.l || d.l || e.l as o from f a, f b, f c, f d, f e where a.b | b.b | c.b | d.b | e.b = 31),
steps as (select o, cast(k as integer) as step, (select b from f where l = substr(o, cast(k as bigint), 1)) as bit, coalesce((select bit_or(b) from f where contains(left(o, cast(k as bigint) - 1), l)), 0) as before from orders, range(1, 6) r(k)),
s as (select part, o, step, bit, sum(n) filter (mask & (before | bit) = 0) as kept, sum(n) filter (mask & before = 0 and mask & bit > 0) as removed, sum(n) filter (mask & before > 0 and mask & bit > 0) as redundant, sum(n) filter (mask = bit) as alone,
  sum(g) filter (mask & before = 0 and mask & bit > 0) as gl, sum(x) filter (mask & before = 0 and mask & bit > 0) as tl from cells, steps group by all),
z as (select part, o, step, bit, {", ".join(f"cast(coalesce({c}, 0) as bigint) as {c}" for c in ("kept", "removed", "redundant", "alone", "gl", "tl"))} from s)
select part, o as filter_order, step, kept, removed, redundant, alone as unique_fails, gl as good_lost, tl as toxic_lost, cast(sum(removed) over (partition by part, bit) as bigint) as shapley from z"""

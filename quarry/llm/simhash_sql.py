"""DuckDB SQL for SimHash over word shingles: XXH64 in 128-bit arithmetic, votes of bits, links by comparing all pairs, components.

For tables of a test's size only: it compares every fingerprint with every other.
"""

from __future__ import annotations

#: The five primes of XXH64.
P1, P2, P3, P4, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
MASK = "cast(18446744073709551615 as uhugeint)"


def _const(n: int) -> str:
    return f"cast({n % (1 << 64)} as uhugeint)"


def _add(*terms: str) -> str:
    return f"(({' + '.join(terms)}) & {MASK})"


def _times(a: str, n: int) -> str:
    return f"(({a} * {_const(n)}) & {MASK})"


def _rotl(a: str, r: int) -> str:
    wide = f"({a} * {_const(1 << r)})"
    return f"(({wide} & {MASK}) + ({wide} >> 64))"


def _round(acc: str, lane: str) -> str:
    return _times(_rotl(_add(acc, _times(lane, P2)), 31), P1)


def _lane(at: str, n_bytes: int) -> str:
    """n_bytes at a byte offset of the hex digits hx, the first one lowest."""
    digits = " || ".join(f"substr(hx, 2 * ({at}) + {2 * i + 1}, 2)" for i in reversed(range(n_bytes)))
    return f"cast(cast('0x' || {digits} as ubigint) as uhugeint)"


def xxh64_ctes(source: str, column: str, seed: int) -> str:
    """CTEs after which `hashes` holds (column, h): XXH64 of each different text of source.column as uhugeint."""
    starts = [_const(seed + P1 + P2), _const(seed + P2), _const(seed), _const(seed - P1)]
    lanes = ", ".join(_round(f"v{i}", _lane(f"p + {8 * i}", 8)) for i in range(4))
    mixed = _add(*[_rotl(f"v{i}", r) for i, r in enumerate((1, 7, 12, 18))])
    merged = "".join(
        f"merge{i} as (select * exclude (h), {_add(_times(f'xor(h, {_round(_const(0), f"v{i}")})', P1), _const(P4))} as h from {'mixed' if i == 0 else f'merge{i - 1}'}),\n"
        for i in range(4)
    )
    eight = _add(_times(_rotl(f"xor(h, {_round(_const(0), _lane('p', 8))})", 27), P1), _const(P4))
    four = _add(_times(_rotl(f"xor(h, {_times(_lane('p', 4), P1)})", 23), P2), _const(P3))
    one = _times(_rotl(f"xor(h, {_times(_lane('p', 1), P5)})", 11), P1)
    bytes_left = "".join(
        f"byte{i} as (select {column}, hx, n, case when p < n then {one} else h end as h, least(p + 1, n) as p from {'four' if i == 0 else f'byte{i - 1}'}),\n"
        for i in range(3)
    )
    return f"""texts as (select {column}, hex(encode({column})) as hx, octet_length(encode({column})) as n from (select distinct {column} from {source})),
stripes as (
  select {column}, hx, n, 0 as p, {', '.join(f'{s} as v{i}' for i, s in enumerate(starts))} from texts where n >= 32
  union all
  select {column}, hx, n, p + 32, {lanes} from stripes where p + 32 <= n
),
mixed as (select *, {mixed} as h from stripes where p + 32 > n),
{merged}begun as (
  select {column}, hx, n, p, {_add('h', 'cast(n as uhugeint)')} as h from merge3
  union all
  select {column}, hx, n, 0, {_add(_const(seed + P5), 'cast(n as uhugeint)')} from texts where n < 32
),
eights as (
  select * from begun
  union all
  select {column}, hx, n, p + 8, {eight} from eights where p + 8 <= n
),
four as (select {column}, hx, n, case when p + 4 <= n then {four} else h end as h, case when p + 4 <= n then p + 4 else p end as p from eights where p + 8 > n),
{bytes_left}last0 as (select {column}, {_times('xor(h, h >> 33)', P2)} as h from byte2),
last1 as (select {column}, {_times('xor(h, h >> 29)', P3)} as h from last0),
hashes as (select {column}, xor(h, h >> 32) as h from last1)"""


def simhash_sql(size: int, radius: int, seed: int = 42) -> str:
    """(doc_id, fingerprint, component_id) of documents by 64-bit SimHash of shingles of `size` words."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    votes = ",\n    ".join(f"sum(cast((h >> {b}) & 1 as integer)) * 2 > count(*) as b{b}" for b in range(64))
    bits = " + ".join(f"case when b{b} then {_const(1 << b)} else {_const(0)} end" for b in range(64))
    return f"""
with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') as w from documents),
shingles as (
  select doc_id, array_to_string(w[i:i + {size - 1}], ' ') as shingle
  from (select doc_id, w, unnest(range(1, greatest(len(w) - {size - 1}, 1) + 1)) as i from words where len(w) > 0)
),
{xxh64_ctes('shingles', 'shingle', seed)},
votes as (select doc_id,
    {votes}
  from shingles join hashes using (shingle) group by doc_id),
prints as (
  select doc_id, coalesce(f, {_const(0)}) as f
  from documents left join (select doc_id, {bits} as f from votes) using (doc_id)
),
nodes as (select f, min(doc_id) as least_id from prints group by f),
links as (select a.f as a, b.f as b from nodes a, nodes b where bit_count(cast(cast(xor(a.f, b.f) as varchar) as ubigint)) <= {radius}),
reached as (select f as start, f from nodes union select r.start, l.b from reached r join links l on l.a = r.f),
components as (select start as f, min(least_id) as component_id from reached join nodes using (f) group by start)
select doc_id, lower(printf('%016x', cast(f as ubigint))) as fingerprint, component_id from prints join components using (f)
"""

"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_DISTANCE = "list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint"


def _round(i: int) -> str:
    return f"""
a{i} as materialized (
  select rid, min(struct_pack(d := d, k := k)) as best
  from (select a.rid, b.k, {_DISTANCE} as d from kept a, c{i} b) group by rid),
m{i} as materialized (
  select k, list((s - ((s % n) + n) % n) // n order by j) as v
  from (select a.best.k as k, j, sum(t.v[j])::hugeint as s, count(*)::hugeint as n
        from a{i} a join kept t using (rid), range(1, 65) as r(j) group by all) group by k),
c{i + 1} as materialized (select c.k, coalesce(m.v, c.v)::bigint[] as v from c{i} c left join m{i} m using (k))"""


def clusters(rounds: int, k: int, seed: int) -> str:
    """op13: ``rounds`` rounds written out."""
    return f"""
with kept as materialized (
  select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v
  from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
c0 as materialized (
  select row_number() over (order by h, v) - 1 as k, v
  from (select sha256('{seed}:' || vec_id) as h, v from kept where vec_id is not null order by h, v limit {k})),
{",".join(_round(i) for i in range(rounds))},
placed as materialized (
  select rid, min(struct_pack(d := d, k := k)) as best
  from (select a.rid, b.k, {_DISTANCE} as d from kept a, c{rounds} b) group by rid)
select t.vec_id, p.best.k::integer as cluster, p.best.d as distance,
  (sum(p.best.d) over (partition by p.best.k))::bigint as cluster_inertia, (sum(p.best.d) over ())::bigint as inertia,
  sha256(array_to_string(c.v, ',')) as centroid_sha256
from placed p join kept t using (rid) join c{rounds} c on c.k = p.best.k"""


# the bits of the decimal id, low bit of each byte first, through the reflected polynomial
_CRC = """xor(list_reduce(
    flatten(list_transform(string_split({0}, ''), lambda ch: list_transform(range(8), lambda b: (ascii(ch) >> b) & 1))),
    lambda crc, bit: xor(crc >> 1, 3988292384 * (xor(crc, bit) & 1)), 4294967295::bigint), 4294967295)"""

PREFIX_NODES = f"""
with turns as materialized (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
  from conversations where conv_id is not null),
convs as materialized (
  select conv_id, conv_id - conv_id % 5 as base, {_CRC.format("conv_id::varchar")} % 9 as h
  from (select distinct conv_id from turns)),
rebuilt as materialized (
  select conv_id, role, text, row_number() over (partition by conv_id order by part, pos) as d
  from (select c.conv_id, 0 as part, t.pos, t.role, t.text from convs c join turns t on t.conv_id = c.base and t.pos <= c.h
        union all
        select c.conv_id, 1, t.pos, t.role, t.text from convs c join turns t on t.conv_id = c.conv_id and t.pos > c.h)),
prefixes as materialized (
  select conv_id, d, strlen(text) as bytes,
    md5(string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '') over (partition by conv_id order by d)) as p
  from rebuilt
  union all select conv_id, 0, 0, '' from convs),
lengths as materialized (select conv_id, max(d) as l from prefixes group by conv_id),
nodes as materialized (
  select p, any_value(d) as depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(bytes) as bytes,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where d = l), '')) as ends_sha256
  from prefixes join lengths using (conv_id) group by p),
edges as materialized (
  select n.p, q.p as parent from nodes n join prefixes q on q.conv_id = n.conv_id and q.d = n.depth - 1),
kids as materialized (select parent as p, count(*) as n_children from edges group by parent),
below as materialized (
  select q.p, sum((n.n_convs - 1) * n.bytes)::bigint as saved_tokens, count(*) filter (where k.p is null) as n_leaves
  from nodes n join prefixes q on q.conv_id = n.conv_id and q.d <= n.depth left join kids k on k.p = n.p group by q.p)
select n.conv_id, n.depth::bigint as depth, parent.conv_id as parent_conv_id, n.n_convs, coalesce(k.n_children, 0) as n_children,
  b.n_leaves, b.saved_tokens, n.ends_sha256
from nodes n join below b using (p) left join kids k using (p) left join edges e using (p) left join nodes parent on parent.p = e.parent"""

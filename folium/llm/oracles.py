"""DuckDB SQL for the rows of the queries that SQL can express, written from the definitions."""

#: What a mix takes follows from the quotas alone: a source's first `quota` blocks, again from the start after the last.
MIX_SQL = r"""
with s as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    md5(coalesce(doc_id::varchar, 'null') || ' ' || md5(coalesce(text, ''))) as key
  from documents),
p as (
  select source, sum(size)::bigint as source_size, [3.0, 1.0, 2.0][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as weight
  from s group by source),
c as (select *, source_size * 2.0::double as cap, source_size * 2.0::double / weight as ratio from p),
l as (
  select *, (sum(source_size) over ()::double * 1.5::double - coalesce(sum(cap) over w, 0)) / (sum(weight) over () - coalesce(sum(weight) over w, 0)) as own
  from c window w as (order by ratio, source rows between unbounded preceding and 1 preceding)),
t as (
  select *, (select arg_min(own, ratio) from l where own <= ratio) as level from l),
g as (
  select source, source_size, case when level is null then cap else least(cap, level * weight) end as target,
    greatest(ceil(source_size / 64.0::double), least(source_size, 32), 1)::bigint as blocks from t),
q as (
  select *, source_size::double / blocks as step,
    case when source_size > 0 then least(round(target / (source_size::double / blocks)), blocks * 2)::bigint else 0 end as quota from g),
d as (
  select s.*, q.source_size, q.target, q.blocks, q.step, q.quota,
    (coalesce(sum(size) over (partition by s.source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0))::bigint as begins
  from s join q on s.source is not distinct from q.source),
e as (
  select *, case when quota % blocks = 0 then 0 else floor((quota % blocks) * step)::bigint end as upto from d)
select doc_id, size, source_size, target,
  ((quota // blocks) * size + greatest(0, least(begins + size, upto) - begins))::bigint as taken
from e"""

FINGERPRINT_SQL = r"""
with d as (select row_number() over (order by doc_id desc nulls last, md5(coalesce(text, ''))) as n, doc_id, coalesce(text, '') as text from documents),
x as (
  select n, doc_id, text, coalesce(lead(text) over (order by n), first_value(text) over (order by n)) as following, length(text)::bigint as n_chars from d),
e as (
  select *, substring(text, 1, n_chars - n_chars // 3) || substring(following, 1, n_chars // 3) as edited from x),
v as (
  select n, 'own' as kind, text as t from e union all select n, 'changed', edited from e union all select n, 'following', following from e),
g as (
  select n, kind, list_transform(string_split(t, chr(10)), lambda p: list_transform(regexp_extract_all(p, '[^.!?]{1,128}[.!?]*|[.!?]{1,128}'), lambda x: md5(x))) as lines from v),
h as (
  select n, kind, list_transform(flatten(lines), lambda x: left(x, 12)) as leaves,
    array_to_string(list_transform(lines, lambda l: coalesce(array_to_string(list_transform(l, lambda x: left(x, 12)), ''), '')), ',') as digests,
    string_split(regexp_replace(array_to_string(list_transform(lines, lambda l: coalesce(array_to_string(list_transform(l, lambda x: left(x, 12)), ''), '') || ':' || left(md5(coalesce(array_to_string(l, ''), '')), 24)), ' '), '([01]) ', '\1|', 'g'), '|') as sections
  from g),
r as (
  select n, kind, leaves, digests, sha256(array_to_string(list_transform(sections, lambda s: sha256(s)), ' ')) as root from h),
u as (select n, kind, unnest(leaves) as leaf from r),
k as (select n, kind, leaf, count(*) as c from u group by all),
m as (
  select a.n, b.kind, sum(least(a.c, b.c)) as shared from k a join k b on a.n = b.n and a.leaf = b.leaf and a.kind = 'own' and b.kind <> 'own' group by a.n, b.kind),
f as (
  select o.n, o.leaves as own, o.root, c.leaves as changed, c.root as edited_root, w.leaves as following, o.digests, c.digests as edited_digests
  from r o join r c on o.n = c.n and c.kind = 'changed' join r w on o.n = w.n and w.kind = 'following' where o.kind = 'own')
select e.doc_id, e.n_chars, sha256(e.edited) as edited_sha256,
  f.root || ':' || f.digests as fingerprint, f.edited_root || ':' || f.edited_digests as edited_fingerprint,
  case when len(f.own) + len(f.changed) = 0 then 1.0 else 2.0::double * coalesce((select shared from m where m.n = e.n and kind = 'changed'), 0) / (len(f.own) + len(f.changed)) end::double as near_edited,
  case when len(f.own) + len(f.following) = 0 then 1.0 else 2.0::double * coalesce((select shared from m where m.n = e.n and kind = 'following'), 0) / (len(f.own) + len(f.following)) end::double as near_next
from e join f on e.n = f.n"""

#: A string of 50 bytes is 100 hex digits; a run of removed bytes ends where the next removed string starts beyond it.
REPEATS_SQL = r"""
with d as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as materialized (select r, doc_id, p, substr(h, 2 * p + 1, 100) as s from (select r, doc_id, h, unnest(range(0, len(h) // 2 - 49)) as p from d)),
m as (select s, min(doc_id) as least from w group by s),
x as (select r, p from w join m using (s) where least < doc_id),
i as (select r, p, case when p <= lag(p) over (partition by r order by p) + 50 then 0 else 1 end as new from x),
g as (select r, p, sum(new) over (partition by r order by p) as island from i),
u as (select r, min(p) as b, max(p) + 50 as e from g group by r, island),
v as (select r, b, e, coalesce(lag(e) over (partition by r order by b), 0) as since from u),
k as (
  select d.r, sum(e - b)::bigint as n_removed, count(*)::bigint as n_spans,
    string_agg(substr(h, 2 * since + 1, 2 * (b - since)), '' order by b) || substr(any_value(h), 2 * max(e) + 1) as kept
  from v join d using (r) group by d.r)
select doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256
from d left join k using (r)"""


def _vectors(scale: int, fits: str) -> str:
    """Kept rows: r (a number), vec_id, label, q."""
    return f"""v as materialized (
  select row_number() over (order by vec_id nulls last, q) as r, * from (
    select vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as q from embeddings
    where embedding is not null and {fits} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0))"""


_APART = "list_sum(list_transform(list_zip(x.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
#: The floor of a quotient also below zero.
_FLOOR = "((sum(t) - ((sum(t) % count(*)) + count(*)) % count(*)) // count(*))::bigint"


def codes_sql(rounds: int = 2) -> str:
    """Rounds unrolled: a<i> assigns all parts to codebooks c<i>, c<i+1> has their entries' floors of means."""
    out = [_vectors(256, "len(embedding) > 0 and len(embedding) % 16 = 0"),
           "x as materialized (select r, p, q[p * (len(q) // 16) + 1 : (p + 1) * (len(q) // 16)] as q from v, range(16) s(p))",
           "c0 as (select p, r - 1 as k, q from x where r <= 64)"]
    for i in range(rounds + 1):
        out.append(f"a{i} as materialized (select x.r, x.p, min({{'d': {_APART}::bigint, 'k': c.k}}) as m from x join c{i} c on x.p = c.p group by all)")
        if i < rounds:
            out.append(f"s{i} as (select x.p, a.m.k as k, unnest(range(len(q))) as j, unnest(q) as t from x join a{i} a using (r, p))")
            out.append(f"n{i} as (select p, k, list(f order by j) as q from (select p, k, j, {_FLOOR} as f from s{i} group by all) group by all)")
            out.append(f"c{i + 1} as materialized (select c.p, c.k, coalesce(n.q, c.q) as q from c{i} c left join n{i} n on n.p = c.p and n.k = c.k)")
    out.append(f"g as (select r, string_agg(lpad(lower(to_hex(m.k)), 2, '0'), '' order by p) as code, sum(m.d)::bigint as error from a{rounds} group by r)")
    out.append(f"h as (select sha256(string_agg(array_to_string(q, ','), ',' order by p, k)) as codebooks_sha256 from c{rounds})")
    return "with " + ",\n".join(out) + "\nselect vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from v join g using (r), h"


def clusters_sql(rounds: int = 3) -> str:
    out = [_vectors(64, "len(embedding) = 64"), "x as (select r, q from v)",
           "c0 as (select row_number() over (order by sha256('1:' || vec_id) nulls last, q) - 1 as k, q from v qualify k < 16)"]
    for i in range(rounds + 1):
        out.append(f"a{i} as materialized (select x.r, min({{'d': {_APART}::bigint, 'k': c.k}}) as m from x, c{i} c group by all)")
        if i < rounds:
            out.append(f"s{i} as (select a.m.k as k, unnest(range(len(q))) as j, unnest(q) as t from x join a{i} a using (r))")
            out.append(f"n{i} as (select k, list(f order by j) as q from (select k, j, {_FLOOR} as f from s{i} group by all) group by all)")
            out.append(f"c{i + 1} as materialized (select c.k, coalesce(n.q, c.q) as q from c{i} c left join n{i} n on n.k = c.k)")
    return "with " + ",\n".join(out) + f"""
select vec_id, m.k::int as cluster, m.d as distance, (sum(m.d) over (partition by m.k))::bigint as cluster_inertia, (sum(m.d) over ())::bigint as inertia, sha256(array_to_string(c.q, ',')) as centroid_sha256
from v join a{rounds} using (r) join c{rounds} c on c.k = m.k"""

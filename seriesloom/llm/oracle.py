"""DuckDB SQL for the queries that SQL can express over whole tables."""

from .decontamination import WINDOW

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = f"""
with d as (select doc_id, {_WORDS.format(_LOWER.format("text"))} w from documents),
b as (select cast(item_id as varchar) item, {_WORDS.format(_LOWER.format("text"))} w from benchmark where item_id is not null),
win as (select distinct item, least(len(w), {WINDOW}) n, w[i : i + least(len(w), {WINDOW}) - 1] win
  from (select item, w, unnest(generate_series(1, greatest(len(w) - {WINDOW - 1}, 1))) i from b where len(w) > 0)),
sizes as (select distinct n from win),
places as (select doc_id, len(w) n_words, n, i, w[i : i + n - 1] win
  from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) i from d, sizes where len(w) >= n)),
hit as (select doc_id, n_words, places.n, i, item from places join win using (win)),
cov as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(generate_series(i, i + n - 1)) p from (select distinct doc_id, i, n from hit)) group by doc_id),
items as (select doc_id, count(distinct item) n_items, string_agg(distinct item, ',' order by item) items from hit group by doc_id)
select d.doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(items, '')) items_sha256,
coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join cov using (doc_id) left join items using (doc_id)"""

# DuckDB has no crc32: the polynomial's table is made by a fold, and a text's bytes are folded through it.
OP7 = """
with t as (select list(list_reduce(range(8), lambda c, j: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) order by i) t from range(256) r(i)),
h as (select row_number() over () r, doc_id, hex(encode(coalesce(text, ''))) h from documents),
d as (select doc_id, len(h) // 2 + 16 size, xor(list_reduce(list_transform(regexp_extract_all(h, '..'), lambda x: cast('0x' || x as bigint)),
  lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), cast(4294967295 as bigint)), 4294967295) text_crc32 from h, t),
s as (select *, sum(size) over (order by doc_id nulls first, text_crc32, size rows unbounded preceding) - size first_byte, sum(size) over () total,
  row_number() over (order by doc_id nulls first, text_crc32, size) i from d),
k as (select *, least(39, cast((2 * first_byte + size) * 40 // (2 * total) as int)) shard from s)
select doc_id, size, text_crc32, 'bytes' law, shard, cast(i - min(i) over (partition by shard) as bigint) slot, cast(null as int) grown_shard from k"""

OP8 = """
with p as (select page_id, encode(coalesce(html, '')) b, sha256(coalesce(html, '')) h from pages),
f as (select h, min(page_id) first from p where octet_length(b) >= 100 group by h)
select page_id, octet_length(b) payload_bytes, p.h payload_digest,
case when first is not null and page_id is distinct from first then 'revisit' else 'response' end record_type,
case when page_id is distinct from first then first end refers_to from p left join f on p.h = f.h"""

_TERMS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12 = f"""
with d as (select row_number() over () r, doc_id, {_TERMS.format(_LOWER.format("text"))} w from documents),
q as (select distinct item_id, unnest({_TERMS.format(_LOWER.format("text"))}) t from benchmark where item_id is not null),
c as (select count(*) n_docs, cast(sum(len(w)) as bigint) n_terms from d where len(w) > 0),
tf as (select r, t, count(*) tf from (select r, unnest(w) t from d) where t in (select t from q) group by r, t),
k as (select t, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) as bigint) weight from tf, c group by t, n_docs),
s as (select item_id, r, cast(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(w) * n_docs) // n_terms)))) as bigint) score
  from q join tf using (t) join k using (t) join d using (r), c group by item_id, r),
o as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id nulls last) as int) as rank, doc_id, score
  from s join d using (r) where score > 0)
select item_id, rank, doc_id, score from o where rank <= 50"""


def _rounds(n: int) -> str:
    """Common table expressions for so many rounds: a{i}, the nearest centroid of each vector; c{i}, the centroids after it."""
    told = []
    for i in range(n + 1):
        told.append(f"""a{i} as materialized (select r, arg_min(j, (d, j)) as j, min(d) d from (
  select r, j, cast(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as bigint) d from v, c{i} c) group by r)""")
        if i < n:
            told.append(f"""m{i} as (select j, k, cast(sum(x) as bigint) s, count(*) n from (select j, unnest(v.x) x, unnest(range(64)) k from a{i} join v using (r)) group by j, k),
c{i + 1} as materialized (select c.j, coalesce(any_value(f.x), any_value(c.x)) x from c{i} c
  left join (select j, list((s - ((s % n) + n) % n) // n order by k) x from m{i} group by j) f using (j) group by c.j)""")
    return ",\n".join(told)


OP13 = f"""
with v as materialized (select row_number() over () r, vec_id, list_transform(embedding, lambda e: cast(floor(1024 * cast(e as double)) as bigint)) x from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda e: e is not null and isfinite(e))) = 64),
c0 as materialized (select row_number() over (order by sha256('3:' || coalesce(cast(vec_id as varchar), '')), x) - 1 as j, x from v
  qualify row_number() over (order by sha256('3:' || coalesce(cast(vec_id as varchar), '')), x) <= 8),
{_rounds(10)},
i as (select j, sum(d) s from a10 group by j)
select vec_id, cast(a10.j as int) as cluster, a10.d as distance, cast(i.s as bigint) cluster_inertia, cast((select sum(s) from i) as bigint) inertia,
sha256(array_to_string(c10.x, ',')) centroid_sha256 from a10 join v using (r) join c10 on c10.j = a10.j join i on i.j = a10.j"""

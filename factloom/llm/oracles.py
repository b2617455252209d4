"""DuckDB SQL for the queries of the text operators that SQL can express."""

from __future__ import annotations

from .secret_scan import BASE, RULES, Rule


def _either_case(pattern: str) -> str:
    """The inline case-insensitive group spelled out, since folding beyond ASCII differs between engines."""
    head, found, tail = pattern.partition("(?i:")
    if not found:
        return pattern
    inner, _, rest = tail.partition(")")
    return head + "(?:" + "".join(f"[{x}{x.upper()}]" if x.isalpha() else x for x in inner) + ")" + rest


def _spans_of(rule: Rule, ordinal: int) -> str:
    p = _either_case(rule.pattern).replace("'", "''")
    gap = f"list_transform(string_split_regex(t, '{p}'), lambda x: length(x))"
    size = f"list_transform(regexp_extract_all(t, '{p}', 0), lambda x: length(x))"
    got = f"list_transform(regexp_extract_all(t, '{p}', {rule.group}), lambda x: length(x))"
    return f"""select doc_id, {ordinal} as ord, '{rule.kind}' as kind, list_sum(gap[:i]) + coalesce(list_sum(size[:i-1]), 0) as s,
        list_sum(gap[:i]) + list_sum(size[:i]) as e
      from (select doc_id, {gap} as gap, {size} as size, {got} as got, unnest(range(1, len({size}) + 1)) as i from d) where got[i] >= {rule.least}"""


def secrets_sql() -> str:
    """Expects distinct doc_id, as the tables have them."""
    spans = "\n      union all ".join(_spans_of(r, i) for i, r in enumerate(RULES))
    base = len(BASE)
    counts = ", ".join(f"count(s) filter (ord = {i}) as n_{r.kind}" for i, r in enumerate(BASE))
    joined = "string_agg(kind || ':' || s::bigint || ':' || e::bigint, ',' order by s, ord)"
    return f"""with d as (select doc_id, coalesce(text, '') as t from documents),
      x as ({spans})
      select d.doc_id, {counts}, sha256(coalesce({joined} filter (ord < {base}), '')) as base_sha256, coalesce({joined} filter (s is not null), '') as spans
      from d left join x using (doc_id) group by d.doc_id"""


NEAR_DUPLICATES = r"""with recursive w as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as a from documents),
  g as (select distinct doc_id, array_to_string(a[i:i+4], ' ') as s from (select doc_id, a, unnest(range(1, greatest(len(a) - 3, 2))) as i from w where len(a) > 0)),
  n as (select doc_id, count(*) as k from g group by doc_id),
  p as (select x.doc_id as a, y.doc_id as b, count(*) as c from g x join g y on x.s = y.s and x.doc_id <> y.doc_id group by all),
  l as (select a, b from p join n as na on na.doc_id = a join n as nb on nb.doc_id = b where 100 * c >= 75 * (na.k + nb.k - c)),
  r as (select doc_id as a, doc_id as b from documents union select r.a, l.b from r join l on r.b = l.a)
  select d.doc_id, coalesce(n.k, 0) as n_shingles, m.c as component_id, d.doc_id = m.c as kept
  from documents d left join n using (doc_id) join (select a, min(b) as c from r group by a) m on m.a = d.doc_id"""

#: The same with three-word shingles at 0.9, and no row kept or dropped.
JACCARD = NEAR_DUPLICATES.replace("a[i:i+4]", "a[i:i+2]").replace("len(a) - 3", "len(a) - 1").replace(">= 75 *", ">= 90 *").replace(", d.doc_id = m.c as kept", "")


REPEATS = """with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
  w as (select doc_id, i, substr(h, 2 * i + 1, 100) as s from (select doc_id, h, unnest(range(0, n - 49)) as i from d where n >= 50)),
  f as (select s, min(doc_id) as m from w group by s), r as (select distinct doc_id, i from w join f using (s) where doc_id > m),
  g as (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 50 then 0 else 1 end as b from r),
  k as (select doc_id, i, sum(b) over (partition by doc_id order by i) as run from g), sp as (select doc_id, min(i) as a, max(i) + 50 as e from k group by doc_id, run),
  p as (select doc_id, a, e, lag(e, 1, 0) over (partition by doc_id order by a) as b from sp),
  c as (select doc_id, sum(e - a) as gone, count(*) as runs, max(e) as tail, string_agg(substr(h, 2 * b + 1, 2 * (a - b)), '' order by a) as body from p join d using (doc_id) group by doc_id)
  select d.doc_id, cast(n as bigint) as n_bytes, cast(coalesce(gone, 0) as bigint) as n_removed, coalesce(runs, 0) as n_spans, sha256(unhex(case when gone is null then h else body || substr(h, 2 * tail + 1) end)) as kept_sha256
  from d left join c using (doc_id)"""

#: Edits by a recursive step a turn: for each role that stayed last, the cheapest cost with the least audit, and its text.
REPAIR = r"""with recursive
  j as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
  h as (select conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i, 1))::bigint)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)), 4294967295::bigint) % 20 as kind from j),
  m as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
      unnest(case kind when 0 then [] when 3 then [0, 1] else [0] end) as copy from h),
  o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), copy) as i,
      row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as again, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as said from m),
  p as (select *, case when said = '' then 1 when again > 1 then 2 when right(said, 1) not in ('.', '!', '?') then 3 else 0 end as fault, substr(role, 1, 1) as c, lag(substr(role, 1, 1)) over (partition by conv_id order by i) as b from o),
  q as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate, count(*) filter (fault = 3) as truncated,
      count(*) filter (b is not null and b || c not in ('su', 'ua', 'au')) as illegal, max(i) as n from p group by conv_id),
  r as (select distinct conv_id, 0::bigint as i, [{'k': 0, 'd': '', 't': ''}, null, null, null] as s from conversations
    union all
    select r.conv_id, p.i, [
      {'k': s[1].k + 4, 'd': s[1].d || 'D', 't': s[1].t},
      list_sort(list_filter([{'k': s[2].k + 4, 'd': s[2].d || 'D', 't': s[2].t}, case when c = 's' and fault in (0, 3) then {'k': s[1].k + fault, 'd': s[1].d || 'K', 't': s[1].t || chr(10) || role || ':' || text} end], lambda x: x.k is not null))[1],
      list_sort(list_filter([{'k': s[3].k + 4, 'd': s[3].d || 'D', 't': s[3].t}] || list_transform([{'f': s[1], 'w': 0}, {'f': s[2], 'w': 0}, {'f': s[3], 'w': 1}, {'f': s[4], 'w': 0}],
        lambda x: case when fault in (0, 3) then {'k': x.f.k + 3 * x.w + fault + case when c = 'u' then 0 else 3 end, 'd': x.f.d || repeat('I', x.w) || case when c = 'u' then 'K' else 'R' end,
          't': x.f.t || repeat(chr(10) || 'assistant:', x.w) || chr(10) || case when c = 'u' then role else 'user' end || ':' || text} end), lambda x: x.k is not null))[1],
      list_sort(list_filter([{'k': s[4].k + 4, 'd': s[4].d || 'D', 't': s[4].t}] || list_transform([{'f': s[1], 'w': 1}, {'f': s[2], 'w': 1}, {'f': s[3], 'w': 0}, {'f': s[4], 'w': 1}],
        lambda x: case when fault in (0, 3) then {'k': x.f.k + 3 * x.w + fault + case when c = 'a' then 0 else 3 end, 'd': x.f.d || repeat('I', x.w) || case when c = 'a' then 'K' else 'R' end,
          't': x.f.t || repeat(chr(10) || 'user:', x.w) || chr(10) || case when c = 'a' then role else 'assistant' end || ':' || text} end), lambda x: x.k is not null))[1]]
    from r join p on p.conv_id is not distinct from r.conv_id and p.i = r.i + 1),
  e as (select conv_id, i, list_sort(list_filter([s[1], {'k': s[2].k + 6, 'd': s[2].d || 'II', 't': s[2].t || chr(10) || 'user:' || chr(10) || 'assistant:'}, {'k': s[3].k + 3, 'd': s[3].d || 'I', 't': s[3].t || chr(10) || 'assistant:'}, s[4]], lambda x: x.k is not null))[1] as z from r)
  select e.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, z.k::bigint as cost, z.d as audit, sha256(substr(z.t, 2)) as repaired_sha256
  from e left join q on q.conv_id is not distinct from e.conv_id where e.i = coalesce(q.n, 0)"""


def codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Every part against every entry, round by round. Expects distinct vec_id and vectors of one length, as the tables have them."""
    near = "select vec_id, p, arg_min(e, struct_pack(d := d, e := e)) as e, min(d) as d from (select q.vec_id, q.p, b.e, list_sum(list_transform(list_zip(q.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d from q join b{i} b using (p)) group by vec_id, p"
    steps = "".join(f""", n{i} as ({near.format(i=i)}),
  s{i} as (select p, e, pos, floor(sum(v[pos]) / count(*))::bigint as x from n{i} join q using (vec_id, p), unnest(range(1, len(v) + 1)) as u(pos) group by all),
  b{i + 1} as (select b.p, b.e, coalesce(m.v, b.v) as v from b{i} b left join (select p, e, list(x order by pos) as v from s{i} group by p, e) m using (p, e))""" for i in range(rounds))
    return f"""with k as (select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
      where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
  q as materialized (select vec_id, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] as v from k, unnest(range({parts})) as u(p)),
  b0 as (select p, dense_rank() over (order by vec_id) - 1 as e, v from q where vec_id in (select distinct vec_id from k order by vec_id limit {entries})){steps},
  f as ({near.format(i=rounds)}),
  c as (select vec_id, string_agg(lower(printf('%02x', e)), '' order by p) as code, sum(d)::bigint as error from f group by vec_id)
  select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, (select sha256(string_agg(array_to_string(v, ','), ',' order by p, e)) from b{rounds}) as codebooks_sha256 from c join k using (vec_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op6_suffix_dedup": REPEATS, "op7_oddsketch_dedup": NEAR_DUPLICATES, "op10_trigram_secrets": secrets_sql(), "op11_prefix_tree_join": JACCARD, "op12_turn_repair": REPAIR, "op13_filtering_lloyd": codes_sql()}

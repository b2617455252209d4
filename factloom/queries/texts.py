"""Text search, lines and markup over `documents` and `pages`. A document is a file: source/lang/doc_id.txt."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..functions import text as tx
from ..operators import ranked, rollup, search
from .registry import query, table

TERM, RARE = "the", "idiot"

FILES = """files as (select doc_id as file_id, source || '/' || lang || '/' || doc_id || '.txt' as rel_path, source as project, coalesce(text, '') as text from documents)"""
LINES = f"""{FILES}, lines as (select file_id, rel_path, unnest(range(1, len(l) + 1)) as line_no, unnest(l) as line from (select *, string_split(text, chr(10)) as l from files))"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return d.select(F.col("doc_id").alias("file_id"), path.alias("rel_path"), F.col("source").alias("project"), F.coalesce("text", F.lit("")).alias("text"))


@query(f"with {LINES} select file_id, line_no, cast((length(upper(line)) - length(replace(upper(line), 'THE', ''))) / 3 as bigint) as matches from lines where contains(upper(line), 'THE')")
def search_plain(spark, sf_dir):
    return search.plain_hits(files(spark, sf_dir), TERM).select("file_id", "line_no", "matches")


@query(rf"with {LINES} select file_id, line_no, cast(len(regexp_extract_all(line, '\d{{3,}}')) as bigint) as matches from lines where regexp_matches(line, '\d{{3,}}')")
def search_regex(spark, sf_dir):
    return search.regex_hits(files(spark, sf_dir), r"\d{3,}").select("file_id", "line_no", "matches")


@query(
    rf"""with {LINES}, h as (select file_id, line_no, list_transform(string_split_regex(line, '\d{{3,}}'), lambda x: length(x)) as gap, list_transform(regexp_extract_all(line, '\d{{3,}}'), lambda x: length(x)) as size from lines where regexp_matches(line, '\d{{3,}}')),
  u as (select *, unnest(range(1, len(size) + 1)) as i from h) select file_id, line_no, cast(list_sum(gap[:i]) + coalesce(list_sum(size[:i - 1]), 0) + 1 as integer) as col, cast(size[i] as integer) as len from u"""
)
def search_ranges(spark, sf_dir):
    hits = search.regex_hits(files(spark, sf_dir), r"\d{3,}")
    r = search.match_ranges(hits, r"\d{3,}").select("file_id", "line_no", F.explode("ranges").alias("r"))
    return r.select("file_id", "line_no", "r.col", "r.len")


@query(
    f"""with {FILES}, a as (select file_id, string_split(text, chr(10)) as l from files), h as (select file_id, l, unnest(range(1, len(l) + 1)) as line_no from a)
  select file_id, line_no, array_to_string(l[greatest(1, line_no - 2):line_no - 1], '|') as before, array_to_string(l[line_no + 1:line_no + 1], '|') as after from h where contains(upper(l[line_no]), 'IDIOT')"""
)
def search_context(spark, sf_dir):
    f = files(spark, sf_dir)
    rows = search.with_context(f, search.plain_hits(f, RARE), 2, 1)
    return rows.select("file_id", "line_no", F.array_join("before", "|").alias("before"), F.array_join("after", "|").alias("after"))


_CAP = f"""{LINES}, h as (select * from lines where contains(upper(line), 'IDIOT')), p as (select distinct upper(rel_path) as k from h order by k limit 20),
  c as (select * from h where upper(rel_path) in (select k from p) order by upper(rel_path), line_no limit 50)"""


@query(f"with {_CAP} select file_id, rel_path, line_no from c")
def search_capped(spark, sf_dir):
    return search.capped(search.plain_hits(files(spark, sf_dir), RARE), 20, 50).select("file_id", "rel_path", "line_no")


@query(
    f"""with {_CAP} select total, shown, shown < total as truncated, concat_ws(',', case when nfiles > 20 then 'maxFiles' end, case when total > 50 then 'maxResults' end) as reasons
  from (select count(*) as total, count(distinct rel_path) as nfiles from h), (select count(*) as shown from c)"""
)
def search_completeness(spark, sf_dir):
    hits = search.plain_hits(files(spark, sf_dir), RARE)
    return search.completeness(hits, search.capped(hits, 20, 50), 20, 50, 0).withColumn("reasons", F.array_join("reasons", ","))


@query(
    f"""with {FILES} select file_id, cast(len(string_split(text, chr(10))) as bigint) as tree_lines,
  cast(case when text = '' then 0 else len(string_split(text, chr(10))) - (case when suffix(text, chr(10)) then 1 else 0 end) end as bigint) as read_lines,
  cast(case when text = '' then 0 else len(string_split(text, chr(10))) end as bigint) as web_lines from files"""
)
def line_counts(spark, sf_dir):
    t = F.col("text")
    return files(spark, sf_dir).select("file_id", *(f(t).cast("long").alias(n) for n, f in (("tree_lines", tx.tree_lines), ("read_lines", tx.read_lines), ("web_lines", tx.web_lines))))


LIMIT = 60


@query(
    f"""with {FILES}, n as (select file_id, rel_path as path, cast(len(string_split(text, chr(10))) as bigint) as lines from files), u as (select *, round_even(100.0 * lines / {LIMIT}, 1) as utilisation from n)
  select file_id, lines, utilisation, case when utilisation >= 95 then 'critical' else 'warning' end as level from u where utilisation >= 80"""
)
def hotspots(spark, sf_dir):
    from ..functions.measures import hotspot_level

    rows = files(spark, sf_dir).select("file_id", F.col("rel_path").alias("path"), tx.tree_lines(F.col("text")).cast("long").alias("lines"))
    return rollup.hotspots(rows, LIMIT, hotspot_level(F.col("utilisation"))).select("file_id", "lines", "utilisation", "level")


@query(
    """with l as (select page_id, unnest(list_transform(string_split(coalesce(html, ''), chr(10)), lambda x: trim(x))) as line from pages) select page_id, count(*) filter (line <> '' and not starts_with(line, '//')) as code,
  count(*) filter (starts_with(line, '//')) as comment, count(*) filter (line = '') as blank from l group by page_id"""
)
def comment_density(spark, sf_dir):
    counts = table(spark, sf_dir, "pages").select("page_id", tx.comment_counts(F.coalesce("html", F.lit(""))).alias("c"))
    return counts.select("page_id", *(F.col(f"c.{k}").cast("long").alias(k) for k in ("code", "comment", "blank")))


@query(f"with {FILES} select file_id from files where contains(upper(rel_path), 'SRC1') or contains(upper(project), 'SRC1')")
def scope_filter(spark, sf_dir):
    return files(spark, sf_dir).filter(paths.in_scope(F.col("rel_path"), F.col("project"), "src1")).select("file_id")


@query(f"with {FILES} select file_id from files where regexp_matches(rel_path, '(?i)^src[^/]*/d[^/]*/[^/]*1\\.txt$')")
def glob_filter(spark, sf_dir):
    return files(spark, sf_dir).filter(paths.matches_any(F.col("rel_path"), ["src*/d*/*1.txt"], True)).select("file_id")


@query(f"with {FILES} select file_id from files where (regexp_matches(project, '(?i)^src1.*$') or regexp_matches(project, '(?i)^src2$')) and not regexp_matches(project, '(?i)^src1[0-5]$')")
def namespace_filter(spark, sf_dir):
    return files(spark, sf_dir).filter(paths.namespace_allowed(F.col("project"), ["src1*", "src2"], [f"src1{i}" for i in range(6)])).select("file_id")


@query(f"with {FILES} select file_id from files where not regexp_matches(regexp_extract(rel_path, '([^/]*)$', 1), '(?i)^1.*$') and not contains(upper('/' || rel_path), '/FR/')")
def file_exclusion(spark, sf_dir):
    return files(spark, sf_dir).filter(~paths.is_excluded(F.col("rel_path"), ["1*"], ["fr"])).select("file_id")


@query(
    """select page_id, case when regexp_matches(url, '(?i)(^|/)[^/]*tests?[^/]*/') or regexp_matches(url, '(?i)tests?\\.[a-z]+$') then true else false end as is_test,
  case when contains(upper(url), 'INTEGRATION') then 'Integration' when contains(upper(url), 'E2E') then 'E2E' when contains(upper(url), 'COMPONENT') then 'Component' else 'Unit' end as category from pages"""
)
def test_classification(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", paths.is_test_path(u).alias("is_test"), paths.test_category(F.lit(None).cast("string"), u).alias("category"))


@query(
    f"""with {FILES}, a as (select file_id, string_split(text, chr(10)) as l from files), h as (select file_id, l, unnest(range(1, len(l) + 1)) as n from a), s as (select file_id, n, greatest(1, n - 1) as lo, least(15, n + 1 - greatest(1, n - 1) + 1) as k, l from h where contains(upper(l[n]), 'IDIOT'))
  select file_id, n as line_no, array_to_string(list_transform(range(lo, least(lo + k - 1, len(l)) + 1), lambda i: i || ': ' || l[i]), chr(10)) as snippet from s"""
)
def violation_snippets(spark, sf_dir):
    f = files(spark, sf_dir)
    hits = search.plain_hits(f, RARE).join(f.select("file_id", tx.lines(F.col("text")).alias("all_lines")), "file_id")
    return hits.select("file_id", "line_no", tx.snippet(F.col("all_lines"), F.col("line_no"), 1).alias("snippet"))


#: The running depth as a fold: a struct of depth and the most so far.
@query(
    r"""with t as (select page_id, regexp_extract_all(coalesce(html, ''), '(</?[A-Za-z][^>]*>)', 1) as tags from pages),
  m as (select page_id, list_transform(tags, lambda t: case when starts_with(t, '</') then -1 when regexp_matches(t, '(?i)^<(area|base|br|col|embed|hr|img|input|link|meta|source|track|wbr)\b') or ends_with(t, '/>') then 0 else 1 end) as moves from t)
  select page_id, list_reduce(list_prepend({'d': 0, 'm': 0}, list_transform(moves, lambda x: {'d': x, 'm': 0})), lambda a, x: {'d': greatest(0, a.d + x.d), 'm': greatest(a.m, a.d + x.d)}).m as depth from m"""
)
def markup_nesting(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.nesting_depth(F.coalesce("html", F.lit(""))).alias("depth"))


@query(
    """with t as (select page_id, unnest(regexp_extract_all(coalesce(html, ''), '<([a-z][a-z0-9]*)', 1)) as tag from pages) select tag, count(*) as n, count(distinct page_id) as pages from t group by tag"""
)
def markup_tags(spark, sf_dir):
    t = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit("<([a-z][a-z0-9]*)"), F.lit(1))).alias("tag"))
    return t.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page_id").alias("pages"))


@query(
    """with s as (select page_id, unnest(regexp_extract_all(coalesce(html, ''), '<style>([^{<]+)\\{', 1)) as sel from pages)
  select page_id, cast(list_max(list_transform(string_split(sel, ','), lambda x: len(list_filter(string_split_regex(x, '[ >+~]'), lambda y: y <> '')))) as bigint) as depth from s"""
)
def selector_depth(spark, sf_dir):
    s = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"<style>([^{<]+)\{"), F.lit(1))).alias("sel"))
    return s.select("page_id", tx.selector_depth(F.col("sel")).cast("long").alias("depth"))


@query("select event_id, row_number() over (order by ts, event_id) as rank, cast(sum(octet_length(encode(props)) + 1) over (order by ts, event_id rows unbounded preceding) as bigint) as used from events")
def payload_ranks(spark, sf_dir):
    """O3: rank and running size of every row of a reply, in its order."""
    return ranked.ordered(table(spark, sf_dir, "events"), "ts", "event_id", size=F.octet_length("props") + 1).select("event_id", "rank", "used")


@query("with h as (select event_id, sum(octet_length(encode(props)) + 1) over (order by ts, event_id rows unbounded preceding) as used from events where event_type = 'error') select event_id from h where used + 1 <= 20000")
def payload_within_bytes(spark, sf_dir):
    """O3: the rows that fit a reply of 20,000 bytes."""
    errors = table(spark, sf_dir, "events").filter("event_type = 'error'")
    return ranked.ordered(errors, "ts", "event_id", size=F.octet_length("props") + 1).filter("used + 1 <= 20000").select("event_id")


@query("select event_id, row_number() over (partition by event_type order by ts, event_id) as turn, case event_type when 'error' then 0 else 1 end as side from events where event_type in ('error', 'click')")
def interleaved_events(spark, sf_dir):
    """Two ordered lists in turn."""
    one, two = (table(spark, sf_dir, "events").filter(F.col("event_type") == k).select("event_id", "ts") for k in ("error", "click"))
    return ranked.interleaved(one, two, "ts", "event_id").select("event_id", "turn", "side")

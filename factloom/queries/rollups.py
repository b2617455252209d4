"""Rollups over the region, nation and customer hierarchy, document folders and page addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import rollup
from .registry import query, table
from .texts import FILES, files


@query(
    """with m as (select lower(r_name) || '/' || lower(n_name) || '/' || c_custkey as path, c_acctbal, c_nationkey from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
  p as (select unnest(['', split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2)]) as prefix, * from m)
  select prefix, count(*) as items, round(sum(c_acctbal), 2) as c_acctbal, max(c_nationkey) as max_c_nationkey from p group by prefix"""
)
def metrics_rollup(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.select(F.concat_ws("/", F.lower("r_name"), F.lower("n_name"), F.col("c_custkey").cast("string")).alias("path"), "c_acctbal", "c_nationkey")
    return rollup.tree(rows, 2, ["c_acctbal"], ["c_nationkey"]).withColumn("c_acctbal", F.round("c_acctbal", 2))


@query(
    f"""with {FILES}, n as (select split_part(rel_path, '/', 1) || '/' || split_part(rel_path, '/', 2) as slice, cast(len(string_split(text, chr(10))) as bigint) as lines, contains(text, 'that') as f from files)
  select slice, count(*) as files, list_sort(list(lines))[count(*) // 2 + 1] as median_lines, count(*) filter (f) as flagged from n group by slice order by files desc, slice limit 5"""
)
def folder_slices_upper_median(spark, sf_dir):
    rows = files(spark, sf_dir).select(F.col("rel_path").alias("path"), tx.tree_lines(F.col("text")).cast("long").alias("lines"), F.contains("text", F.lit("that")).alias("flagged"))
    return rollup.slices(rows, "flagged")


@query(
    f"""with {FILES}, g as (select project as folder, contains(text, 'idiot') as f from files)
  select folder, count(*) filter (f) as flagged, count(*) as files, round_even(100.0 * (count(*) - count(*) filter (f)) / count(*), 1) as clean_percent from g group by folder order by flagged desc, folder limit 3"""
)
def debt_folders(spark, sf_dir):
    return rollup.folder_debt(files(spark, sf_dir).select(F.col("project").alias("folder"), F.contains("text", F.lit("idiot")).alias("flagged")))


@query("with n as (select lang as ext, count(*) as n from documents group by lang) select coalesce(n.ext, e.ext) as ext, coalesce(n, 0) as n from n full join (values ('de'), ('en'), ('it')) e(ext) on n.ext = e.ext")
def file_type_counts(spark, sf_dir):
    expected = spark.createDataFrame([("de",), ("en",), ("it",)], "ext string")
    return rollup.kinds(table(spark, sf_dir, "documents").withColumnRenamed("lang", "ext"), expected)


@query(
    """with h as (select regexp_extract(url, '//([^/]+)/', 1) as host from pages), p as (select array_to_string(list_reverse(string_split(host, '.')), '.') as ns, host from h),
  x as (select unnest([split_part(ns, '.', 1), split_part(ns, '.', 1) || '.' || split_part(ns, '.', 2)]) as namespace, host from p) select namespace, count(*) as types, count(distinct host) as projects from x group by namespace"""
)
def namespace_tree(spark, sf_dir):
    host = F.regexp_extract("url", "//([^/]+)/", 1)
    types = table(spark, sf_dir, "pages").select(F.array_join(F.reverse(F.split(host, r"\.")), ".").alias("namespace"), host.alias("project"))
    return rollup.namespaces(types, 2)


@query("select source as project, count(distinct lang) as namespaces, count(*) as types from documents group by source")
def project_overview(spark, sf_dir):
    return rollup.project_overview(table(spark, sf_dir, "documents").select(F.col("source").alias("project"), F.col("lang").alias("namespace")))


PROJECTS = [("", "root"), ("src1", "one"), ("src1/de", "one-german"), ("src2", "two"), ("src2/en", "two-english")]


@query(
    f"""with {FILES}, j as (select file_id, project, length(dir) as n from (select file_id, rel_path from files) f join (values ('', 'root'), ('src1', 'one'), ('src1/de', 'one-german'), ('src2', 'two'), ('src2/en', 'two-english')) p(dir, project) on dir = '' or starts_with(rel_path, dir || '/'))
  select file_id, max_by(project, n) as project from j group by file_id"""
)
def longest_prefix_project(spark, sf_dir):
    projects = spark.createDataFrame(PROJECTS, "dir string, project string")
    return rollup.owning_project(files(spark, sf_dir).select("file_id", F.col("rel_path").alias("path")), projects).select("file_id", "project")


@query(
    f"""with {FILES} select file_id, case when regexp_matches(rel_path, '(?i)^src1[^/]*/.*$') then 'strict' when regexp_matches(rel_path, '(?i)^.*/de/.*$') then 'german' when regexp_matches(rel_path, '(?i)^src[^/]*/en/[^/]*7\\.txt$') then 'seven' end as override from files"""
)
def first_match_override(spark, sf_dir):
    rows = files(spark, sf_dir).select("file_id", F.col("rel_path").alias("path"))
    return rollup.first_override(rows, [("src1*/**", "strict"), ("**/de/**", "german"), ("src*/en/*7.txt", "seven")]).select("file_id", "override")


@query(f"with {FILES} select file_id, string_agg(distinct rule, ', ' order by rule) as rules from (select file_id, unnest(regexp_extract_all(text, 'idiot|moron|clown|scum', 0)) as rule from files) group by file_id")
def marks_by_file(spark, sf_dir):
    marks = files(spark, sf_dir).select("file_id", F.explode(F.regexp_extract_all("text", F.lit("idiot|moron|clown|scum"), F.lit(0))).alias("rule"))
    return rollup.marks_by_file(marks)

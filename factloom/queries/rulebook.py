"""Rules over `documents`, `part` and `lineitem`: violations, suppressions, limits, severities and the gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measures as ms
from ..functions import text as tx
from ..operators import rules
from .registry import query, table
from .texts import FILES, files

RULES = [
    rules.Rule("MaxLineCount", "error", "size", lambda k: F.col("lines") > k["lines"], lambda k: F.col("lines").cast("string"), (("lines", 60),)),
    rules.Rule("MaxLineLength", "warning", "size", lambda k: F.col("longest") > k["longest"], lambda k: F.col("longest").cast("string"), (("longest", 2000),)),
    rules.Rule("AllowTabs", "info", "style", lambda k: F.contains("text", F.lit("\t")), lambda k: F.lit("tab")),
    rules.Rule("ShoutedText", "warning", "style", lambda k: F.col("text").rlike("[A-Z]{12,}"), lambda k: F.lit("capitals")),
    rules.Rule("EmptyFile", "error", "content", lambda k: F.length("text") < 20, lambda k: F.length("text").cast("string")),
]

VIOLATIONS = f"""{FILES}, facts as (select *, cast(len(l) as bigint) as lines, list_max(list_transform(l, lambda x: length(x))) as longest from (select *, string_split(text, chr(10)) as l from files)),
v as (select file_id, rel_path, 1 as line, 'MaxLineCount' as rule, cast(lines as varchar) as details, 'error' as severity, 'size' as intent from facts where lines > 60
  union all select file_id, rel_path, 1, 'MaxLineLength', cast(longest as varchar), 'warning', 'size' from facts where longest > 2000
  union all select file_id, rel_path, 1, 'AllowTabs', 'tab', 'info', 'style' from facts where contains(text, chr(9))
  union all select file_id, rel_path, 1, 'ShoutedText', 'capitals', 'warning', 'style' from facts where regexp_matches(text, '[A-Z]{{12,}}')
  union all select file_id, rel_path, 1, 'EmptyFile', cast(length(text) as varchar), 'error', 'content' from facts where length(text) < 20)"""


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).withColumn("lines", tx.tree_lines(F.col("text")).cast("long")).withColumn("longest", F.array_max(F.transform(tx.lines(F.col("text")), lambda x: F.length(x))))
    rows = rules.violations(f, RULES)
    return rules.with_severity(rows, rules.metadata(RULES, spark))


@query(f"with {VIOLATIONS} select file_id, line, rule, details, severity, intent from v")
def violations_union(spark, sf_dir):
    return found(spark, sf_dir).select("file_id", "line", "rule", "details", "severity", "intent")


@query(f"with {VIOLATIONS} select rule, count(*) as n, count(distinct file_id) as files from v group by rule")
def violations_by_rule(spark, sf_dir):
    return rules.by_rule(found(spark, sf_dir))


@query(f"with {VIOLATIONS} select file_id, count(*) as n, string_agg(distinct rule, ',' order by rule) as rules from v group by file_id")
def violations_by_file(spark, sf_dir):
    return rules.by_file(found(spark, sf_dir))


@query(f"with {VIOLATIONS} select intent, count(*) as n, string_agg(distinct rule, ', ' order by rule) as rules from v group by intent")
def violation_intents(spark, sf_dir):
    from ..operators.rollup import intents

    return intents(found(spark, sf_dir))


_RANK = "case severity when 'error' then 0 when 'warning' then 1 else 2 end"


@query(f"with {VIOLATIONS} select file_id, rule, severity from v order by {_RANK}, upper(rel_path), line, rule limit 50")
def get_violations(spark, sf_dir):
    rows = found(spark, sf_dir).join(files(spark, sf_dir).select("file_id", "rel_path"), "file_id")
    return rules.ordered(rows, 50).select("file_id", "rule", "severity")


@query(f"with {VIOLATIONS}, f as (select * from v order by {_RANK}, upper(rel_path), line, rule limit 20) select rule, count(*) as n from f group by rule")
def gate_top_issues(spark, sf_dir):
    rows = found(spark, sf_dir).join(files(spark, sf_dir).select("file_id", "rel_path"), "file_id")
    return rules.top_issue(rows, 20)


@query(
    f"""with {VIOLATIONS}, b as (select v.*, p.pattern from v join (values ('large', 'MaxLineCount'), ('large', 'MaxLineLength'), ('noise', 'ShoutedText'), ('noise', 'EmptyFile'), ('noise', 'MaxLineLength')) p(pattern, rule) on p.rule = v.rule),
  r as (select *, row_number() over (partition by pattern order by file_id, line, rule) as rn from b)
  select pattern, count(*) as n, string_agg(cast(file_id as varchar), ',' order by rn) filter (rn <= 5) as first_files, count(*) - count(*) filter (rn <= 5) as more from r group by pattern"""
)
def pattern_buckets(spark, sf_dir):
    patterns = spark.createDataFrame([("large", "MaxLineCount"), ("large", "MaxLineLength"), ("noise", "ShoutedText"), ("noise", "EmptyFile"), ("noise", "MaxLineLength")], "pattern string, rule string")
    return rules.pattern_buckets(found(spark, sf_dir), patterns, 5)


@query(
    f"""with {VIOLATIONS}, p as (select coalesce(sum(case severity when 'error' then 2.0 when 'warning' then 1.0 else 0.25 end), 0) as penalty, count(*) as violations from v),
  c as (select count(*) as classes, avg(quality * 4.0) as complexity, avg(doc_id * 1.0) as footprint, avg(case when toxic = 0 then 1.0 else 0.0 end) as sealed from labels),
  s as (select violations, classes, 10 - penalty * 1.5 / greatest(classes, 1) - greatest(0.0, complexity - 5) * 0.5 - greatest(0.0, footprint - 1000) / 1000 + sealed * 0.5 as raw from p, c)
  select violations, classes, round(greatest(0.0, least(10.0, raw)), 6) as score, greatest(0.0, least(10.0, raw)) >= 8.0 as passed from s"""
)
def gate_score(spark, sf_dir):
    classes = table(spark, sf_dir, "labels").select((F.col("quality") * 4.0).alias("complexity"), (F.col("doc_id") * 1.0).alias("footprint"), (F.col("toxic") == 0).alias("is_sealed"))
    return rules.gate_score(found(spark, sf_dir), classes).withColumn("score", F.round("score", 6))


@query(
    f"""with {VIOLATIONS}, m as (select distinct file_id, case when file_id % 3 = 0 then 'ALL' when file_id % 3 = 1 then 'MAXLINE' else 'SHOUT' end as mark from files where contains(text, 'that'))
  select file_id, rule from v where not exists (select 1 from m where m.file_id = v.file_id and (mark = 'ALL' or starts_with(upper(rule), mark)))"""
)
def suppression_anti(spark, sf_dir):
    f = files(spark, sf_dir).filter(F.contains("text", F.lit("that")))
    marks = f.select("file_id", F.when(F.col("file_id") % 3 == 0, "all").when(F.col("file_id") % 3 == 1, "MaxLine").otherwise("shout").alias("rule"))
    return rules.unsuppressed(found(spark, sf_dir), marks).select("file_id", "rule")


@query(
    f"""with {FILES}, lines as (select file_id, unnest(range(1, len(l) + 1)) as line_no, unnest(l) as line from (select file_id, string_split(text, chr(10)) as l from files)),
  h as (select file_id, line_no, string_split_regex(trim(substr(line, instr(line, 'idiot') + 5)), '[ ,;*@/]+')[1] as w from lines where contains(line, 'idiot'))
  select file_id, line_no, case when w = '' or upper(w) = 'ALL' then 'all' else w end as rule from h"""
)
def suppression_inventory(spark, sf_dir):
    from ..operators.search import source_lines

    return rules.suppressions(source_lines(files(spark, sf_dir)), "idiot").select("file_id", "line_no", "rule")


@query("select p_partkey, p_size, case when p_size > 40 then 'VIOLATION' when p_size >= 35 then 'WARN' else 'OK' end as status from part")
def threshold_status(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", ms.threshold_status(F.col("p_size"), F.lit(40), F.lit(5)).alias("status"))


ENTRIES = [{"at_most": {"l_linenumber": 2}, "at_least": {"l_tax": 0.05}, "limit": 45, "severity": None}, {"at_most": {"l_discount": 0.02}, "limit": -1, "severity": "info"}, {"at_least": {"l_tax": 0.08}, "limit": 0, "severity": "warning"}]


@query(
    """with l as (select *, case when l_linenumber <= 2 and l_tax >= 0.05 then 45 when l_discount <= 0.02 then -1 when l_tax >= 0.08 then 0 else 40 end as lim, case when l_discount <= 0.02 then 'info' end as sev from lineitem)
  select l_orderkey, l_linenumber, lim as "limit", coalesce(sev, 'error') as severity from l where lim > 0 and l_quantity > lim"""
)
def compound_relaxed_limit(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    rows = li.withColumn("limit", rules.relaxed_limit(li, ENTRIES, 40)).withColumn("severity", F.coalesce(rules.severity_override(li, ENTRIES), F.lit("error")))
    return rows.filter((F.col("limit") > 0) & (F.col("l_quantity") > F.col("limit"))).select("l_orderkey", "l_linenumber", "limit", "severity")


@query(
    """select * from (values ('MaxLineCount', 'error', 'size'), ('MaxLineLength', 'warning', 'size'), ('AllowTabs', 'info', 'style'), ('ShoutedText', 'warning', 'style'), ('EmptyFile', 'error', 'content')) t(rule, severity, intent)
  where contains(upper(rule), 'TYLE') or contains(upper(severity), 'TYLE') or contains(upper(intent), 'TYLE')"""
)
def rule_catalogue(spark, sf_dir):
    return rules.find_rules(rules.metadata(RULES, spark), "tyle")


@query(
    f"""with {FILES}, c as (select file_id, regexp_extract(text, '^([A-Za-z]+)', 1) as value from files)
  select case when regexp_matches(value, '^[A-Z][A-Za-z0-9]+$') then 'nameof_candidate' else 'magic_string' end as category, value, count(*) as n, min(file_id) as first_file from c group by category, value having count(*) >= 2"""
)
def magic_strings(spark, sf_dir):
    from ..operators.literals import grouped

    rows = files(spark, sf_dir).select(F.col("file_id"), F.regexp_extract("text", "^([A-Za-z]+)", 1).alias("value"))
    lit = rows.select(F.lit(0).alias("file_id"), F.col("file_id").alias("line"), F.lit(1).alias("col"), ms.string_kind(F.col("value"), F.lit("")).alias("category"), "value")
    return grouped(lit, 2).select("category", "value", "n", F.col("line").alias("first_file"))


@query(
    """with n as (select p_partkey, cast(p_size * 20 as integer) as v, p_brand from part), c as (select *, case when v between 100 and 599 then 'http_status' when v in (24, 60, 1000, 1024, 3600, 86400) then 'well_known' else 'magic_number' end as category from n)
  select category, count(*) as n, count(distinct v) as distinct_values, min(v) as least from c group by category"""
)
def magic_numbers(spark, sf_dir):
    n = table(spark, sf_dir, "part").select((F.col("p_size") * 20).cast("int").alias("v"), "p_brand")
    rows = n.withColumn("category", ms.number_kind(F.col("v").cast("string"), F.lit("int"), F.lit("")))
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("v").alias("distinct_values"), F.min("v").alias("least"))


@query("select p_brand as kind, cast(p_size as varchar) as value, count(distinct p_partkey % 10) as files, count(*) as n, min(p_partkey % 10) as first_file from part group by all having count(distinct p_partkey % 10) >= 2")
def duplicate_constants(spark, sf_dir):
    from ..operators.literals import duplicate_constants as twice

    return twice(table(spark, sf_dir, "part").select(F.col("p_brand").alias("kind"), F.col("p_size").cast("string").alias("value"), (F.col("p_partkey") % 10).alias("file_id")))

"""Facts extracted from source text. The driver's tables hold no code, so Spark writes a class for each part: its fields, and a method
whose types and body follow from the part's columns. The SQL beside each query computes the same facts from the columns alone, so what
is compared is the extraction."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import declaration_rules as rules
from ..operators import profile_search, structure, webrules
from ..session import shared_folder
from ..sources import declared, files, lexical, profiler, profiles
from .registry import query, table

_RETURNS = ("int", "string", "bool", "double")
_PARAMS = ("int", "string", "List<int>")
#: Bodies: text, and the features that it has.
_BODIES = (
    ("// if (never) return;\n    if (a0 == 10) { return 1; }\n    return 0;", {"cf:if": 1, "cf:return": 2, "cflowseq:if>return>return": 1, "lit:number": 1, "purity:pure": 1, "form:if": 1}),
    ('foreach (var x in this._items) { Console.WriteLine("if {x}"); }', {"cf:foreach": 1, "cflowseq:foreach": 1, "member:List<int>": 1, "lit:string": 1, "purity:io": 1, "form:direct": 1}),
    ('switch (a0) { case 1: return 3; default: throw new InvalidOperationException("x"); }', {"cf:switch": 1, "cf:return": 1, "cf:throw": 1, "cflowseq:switch>return>throw": 1, "lit:number": 1, "lit:string": 1, "purity:pure": 1, "form:switch": 1}),
    ("_total += 2; /* while */ return _total == 3 ? 1 : 2;", {"cf:return": 1, "cf:ternary": 1, "cflowseq:return>ternary": 1, "lit:number": 1, "purity:mutates": 1, "form:if": 1}),
    ("while (this._total != 0) { try { Step(); } catch { return null; } }\n    return true;", {"cf:while": 1, "cf:try": 1, "cf:catch": 1, "cf:return": 2, "cflowseq:while>try>catch>return>return": 1, "member:int": 1, "lit:number": 1, "lit:null": 1, "lit:bool": 1, "purity:stateful": 1, "form:direct": 1}),
)


def _pick(values, at):
    out = F.lit(values[-1])
    for i, v in enumerate(values[:-1]):
        out = F.when(at == i, v).otherwise(out)
    return out


def dealt_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of parts, dealt over four tasks a core: its rows take little room, so that one task may read them all, but each becomes
    a text that takes long to read."""
    return table(spark, sf_dir, "part").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")


def part_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, text: a class for each part."""
    size, key = F.col("p_size"), F.col("p_partkey")
    box = F.regexp_replace("p_brand", "[^A-Za-z0-9]", "")
    params = F.concat(_pick(_PARAMS, key % 3), F.lit(" a0, "), box, F.when(key % 2 == 0, F.lit(" a1, bool last = true")).otherwise(F.lit(" a1")))
    lines = ["using System;\nnamespace Shop;\n\n/// <summary>{ not a brace }</summary>\npublic class C", key.cast("string"), "\n{\n  private int _total = 1;\n  private readonly List<int> _items = new();\n\n  public ", _pick(_RETURNS, F.floor(size / 5) % 4), " Run(", params, ")\n  {\n    ", _pick([b for b, _ in _BODIES], size % 5), "\n  }\n}\n"]
    return dealt_parts(spark, sf_dir).select(key.cast("long").alias("file_id"), F.concat(*(F.lit(x) if isinstance(x, str) else x for x in lines)).alias("text"))


def _features_sql() -> str:
    """u, feature, w: what the extractor has to find, from the columns."""
    w, kind = profiles.WEIGHTS, {"int": "struct", "bool": "struct", "double": "struct", "string": "class", "List<int>": "class"}
    case = lambda at, values: f"case {at} " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(values)) + " end"
    ret, param = "p_size // 5 % 4", "p_partkey % 3"
    rows = [
        f"select p_partkey as u, 'ret:' || {case(ret, _RETURNS)} as feature, {w['ret']}::double as w from part",
        f"select p_partkey, 'retkind:' || {case(ret, [kind[r] for r in _RETURNS])}, {w['retkind']} from part",
        f"select p_partkey, 'param:' || {case(param, _PARAMS)}, {w['param']} from part",
        f"select p_partkey, 'paramkind:' || {case(param, [kind[p] for p in _PARAMS])}, {w['paramkind']} from part",
        f"select p_partkey, 'param:' || regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g'), {w['param']} from part",
        f"select p_partkey, 'paramkind:class', {w['paramkind']} from part",
        f"select p_partkey, unnest(['param:bool', 'paramkind:struct']), unnest([{w['param']}, {w['paramkind']}]) from part where p_partkey % 2 = 0",
        f"select p_partkey, 'target:' || {case(param, _PARAMS)}, {w['target']} from part where p_size % 5 = 2",
    ]
    for i, (_, found) in enumerate(_BODIES):
        names, weights = [f"'{k}'" for k in found], [str(w[k.partition(":")[0]] * n) for k, n in found.items()]
        rows.append(f"select p_partkey, unnest([{', '.join(names)}]), unnest([{', '.join(weights)}]) from part where p_size % 5 = {i}")
    return f"f as (select u, feature, sum(w) as w from ({' union all '.join(rows)}) group by all)"


_FEATURES = _features_sql()


@query(f"with {_FEATURES} select u as file_id, feature, round(w, 6) as weight from f")
def structure_profile_features(spark, sf_dir):
    """P33 over source text."""
    found = profiles.structure_profiles(part_sources(spark, sf_dir))
    return found.select("file_id", F.explode("features").alias("x")).select("file_id", "x.feature", F.round("x.weight", 6).alias("weight"))


@query(
    f"""with recursive {_FEATURES}, c as (select u, md5(string_agg(feature || '=' || round(w, 6), ',' order by feature)) as cls from f group by u), h as (select cls, min(u) as head from c group by cls),
  v as (select h.head as u, feature, w / sqrt(sum(w * w) over (partition by f.u)) as w from f join h on h.head = f.u),
  d as (select x.u as a, y.u as b, sum(x.w * y.w) as score from v x join v y on x.feature = y.feature and x.u < y.u group by all having score >= 0.9 - 1e-9 and bool_or(regexp_matches(x.feature, '^(ret|form|cflowseq|target):'))),
  e as (select a, b from d union select b, a from d), r as (select u, u as x from (select distinct head as u from h) union select r.u, e.b from r join e on e.a = r.x),
  s as (select u as head, min(x) as root from r group by u), m as (select c.u as unit_id, s.root from c join h using (cls) join s using (head)),
  z as (select root, count(*) as size from m group by root having count(*) > 1), k as (select s.root, min(score) as weakest from d join s on s.head = d.a group by s.root)
  select unit_id, root, size, round(coalesce(weakest, 1), 6) as weakest, case when coalesce(weakest, 1) >= 0.9 then 'Exact' else 'Near' end as bucket from m join z using (root) left join k using (root)"""
)
def structural_duplicates(spark, sf_dir):
    """J8 over the profiles of source text: sets of methods alike in structure."""
    found = profiles.structure_profiles(part_sources(spark, sf_dir)).select(F.col("file_id").alias("unit_id"), "features")
    return profile_search.structural_sets(found, 0.9).withColumn("weakest", F.round("weakest", 6))


#: A component for each part: how many of each thing it has follows from the part's number and size.
_WEB = """p as (select p_partkey as file_id, p_size as n, p_size % 4 as deep, p_partkey % 4 as loops, p_partkey % 13 as attrs, p_partkey % 5 as off from part)"""


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, rel_path, text: components with traps: braces and marks in strings, comments and text."""
    key, size = F.col("p_partkey"), F.col("p_size")
    times = lambda text, n: F.repeat(F.lit(text), n.cast("int"))
    off = F.when(key % 5 == 0, "@* lint-off RAZOR_MaxControlFlowBlocks { *@\n").when(key % 5 == 1, "<!-- LINT-OFF ALL -->\n").otherwise("@* { @foreach <div> *@\n")
    parts = [
        off, "<p>don't {count} this</p>\n", times("<div>\n", size % 4 + 4), times("<b>@(a ? b : c)</b>\n", key % 2), times("</div>\n", size % 4 + 4),
        times('@foreach (var x in Find("){"))\n{\n', key % 4), "<br/>it's\n", times("}\n", key % 4),
        times('@if (ok == "{") { <i/> }\n', size % 12), "<Grid", times(' A="1"', key % 13), times(' @onclick="() => { Go(); }"', F.when(key % 3 == 0, 1).otherwise(0)), " />\n",
        '@code {\n  string s = "}"; // }\n  /* } */\n', times("  int x;\n", size % 25), "}\n",
    ]
    text = F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    return dealt_parts(spark, sf_dir).select(key.cast("long").alias("file_id"), F.concat(F.lit("Shop/C"), key.cast("string"), F.lit(".razor")).alias("rel_path"), text.alias("text"))


_WEB_RULES = f"""{_WEB}, v as (
  select file_id, 'RAZOR_MaxMarkupNestingDepth' as rule, (deep + 4 + file_id % 2) || ' > 5' as details from p where deep + 4 + file_id % 2 > 5
  union all select file_id, 'RAZOR_MaxControlFlowBlocks', (loops + n % 12) || ' > 8' from p where loops + n % 12 > 8
  union all select file_id, 'RAZOR_MaxForeachNestingDepth', loops || ' > 2' from p where loops > 2
  union all select file_id, 'RAZOR_MaxComponentParameterCount', 'Grid ' || (attrs + case when file_id % 3 = 0 then 1 else 0 end) from p where attrs + case when file_id % 3 = 0 then 1 else 0 end > 10
  union all select file_id, 'RAZOR_MaxRazorCodeBlockLines', (n % 25 + 4)::varchar from p where n % 25 + 4 > 20
  union all select file_id, 'RAZOR_BanInlineEventLambdas', '@onclick' from p where file_id % 3 = 0
  union all select file_id, 'RAZOR_BanInlineTernaryInAttributes', '' from p where file_id % 2 = 1)"""


@query(f"with {_WEB_RULES} select file_id, rule, details from v")
def component_rules(spark, sf_dir):
    """P29 and the rules of component markup over text with traps."""
    return webrules.component_rules(components(spark, sf_dir), {"RAZOR_MaxMarkupNestingDepth": 5}).select("file_id", "rule", "details")


@query(f"with {_WEB_RULES} select file_id, rule, details from v join p using (file_id) where off > 1 or off = 0 and rule <> 'RAZOR_MaxControlFlowBlocks'")
def component_rules_in_force(spark, sf_dir):
    """what the files themselves turn off."""
    own = components(spark, sf_dir)
    return webrules.unsuppressed_web(webrules.component_rules(own, {"RAZOR_MaxMarkupNestingDepth": 5}), own, "lint-off").select("file_id", "rule", "details")


@query("select p_partkey as file_id, unnest(['BlazorRequireCodeBehind', 'BlazorRequireCssIsolation']) as rule, 'C' || p_partkey || unnest(['.razor.cs', '.razor.css']) as details from part where p_partkey % 7 <> 0")
def companion_files(spark, sf_dir):
    own = components(spark, sf_dir)
    more = own.filter("file_id % 7 = 0").select("file_id", F.explode(F.array(F.concat("rel_path", F.lit(".CS")), F.concat("rel_path", F.lit(".css")))).alias("rel_path"), F.lit("").alias("text"))
    return webrules.missing_companions(own.unionByName(more)).select("file_id", "rule", "details")


def declaring_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, text: a window class, a value object and an endpoint for each part."""
    key, size = F.col("p_partkey"), F.col("p_size")
    when = lambda test, text, other="": F.when(test, text if not isinstance(text, str) else F.lit(text)).otherwise(F.lit(other))
    parts = [
        "using System;\nusing Shop.Core;\n", when(key % 5 == 0, F.concat(F.lit("using Ghost.Lib"), (size % 3).cast("string"), F.lit(";\n"))), "namespace Shop.Core\n{\n  // public class MyClass1 : Window { }\n  [Note(\"class MyClass2\")]\n  public partial class W", key.cast("string"), " : ", when(size % 4 == 0, "Window", "Base<int>"), ", IDisposable\n  {\n    public W", key.cast("string"),
        "(int data) { InitializeComponent(); }\n    public int Run(int ", _pick(("data", "amount", "tmp"), key % 3), ", string name = \"x\")\n    {\n", when(size % 7 == 0, "      var t = Type.GetType(\"a.b\");\n"), "      return 1;\n    }\n    void Wire(object item) { app.MapGet(\"/x\", (int a, Foo b, [AsParameters] Bar c, string d", when(key % 2 == 0, ", Baz e"),
        ") => 1); }\n  }\n  public ", when(key % 2 == 0, "record", "class"), " P", key.cast("string"), "ValueObject { public int V { get; ", when(size % 3 == 0, "set", "init"), "; } = 1; }\n", when(key % 11 == 0, F.concat(F.lit("  class MyClass"), size.cast("string"), F.lit(" { }\n"))), "}\n",
    ]
    return dealt_parts(spark, sf_dir).select(key.cast("long").alias("file_id"), F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts)).alias("text"))


@query(
    """select p_partkey as file_id, 'EnforceSemanticNaming' as rule, case p_partkey % 3 when 0 then 'data' else 'tmp' end as details from part where p_partkey % 3 <> 1 union all select p_partkey, 'EnforceSemanticNaming', 'MyClass' || p_size from part where p_partkey % 11 = 0
  union all select p_partkey, 'EnforceMinimalApiAsParameters', unnest(['b of 5', 'e of 5']) from part where p_partkey % 2 = 0 union all select p_partkey, 'EnforceValueObjectContracts', 'P' || p_partkey || 'ValueObject' from part where p_partkey % 2 = 1 union all select p_partkey, 'EnforceValueObjectContracts', 'V' from part where p_size % 3 = 0
  union all select p_partkey, 'DetectAndBanPhantomDependencies', 'Ghost.Lib' || (p_size % 3) from part where p_partkey % 5 = 0 union all select p_partkey, 'DetectAndBanPhantomDependencies', 'Type.GetType' from part where p_size % 7 = 0 union all select p_partkey, 'WpfRequireMinimalCodeBehind', '2: Run(), Wire()' from part where p_size % 4 = 0"""
)
def declaration_rules(spark, sf_dir):
    """Five rules on extracted declarations."""
    facts = declared.declared_facts(declaring_sources(spark, sf_dir))
    return rules.declaration_rules(facts, spark.createDataFrame([("System",)], "name string")).select("file_id", "rule", "details")


def _written(spark: SparkSession, df: DataFrame, label: str) -> str:
    """A folder of the shared one with df's rows as JSON lines."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.json(path)
    return path


#: Lines of a log, about: a larger table has more logs, so that the places of a log's lines are one task's work at any size.
LOG_ROWS = 100_000


@query(
    """with c as (select event_type as tool, count(*) as calls, count(*) filter (event_type = 'error') as errors, cast(sum(floor(value)) as bigint) as duration_ms from events group by tool) select *, 0::bigint as misplaced from c"""
)
def log_files(spark, sf_dir):
    """Events written as logs and read back, with the lines that aren't where they were written."""
    error, events = F.col("event_type") == "error", table(spark, sf_dir, "events")
    logs = max(4, -(-events.count() // LOG_ROWS))
    rows = events.repartition(logs, "event_id").sortWithinPartitions("event_id").select(F.lit("tool_call").alias("recordType"), F.col("event_type").alias("toolName"), F.col("event_id").alias("processId"), F.floor("value").alias("durationMs"), error.alias("isErrorResult"))
    calls, _ = files.tool_calls(files.log_lines(spark, _written(spark, rows, "logs"), "*.json"))
    placed = calls.withColumn("place", F.row_number().over(Window.partitionBy("log_file").orderBy("pid")))
    return placed.groupBy("tool").agg(F.count(F.lit(1)).alias("calls"), F.count_if("is_error").alias("errors"), F.sum("duration_ms").alias("duration_ms"), F.count_if(F.col("place") != F.col("line_no")).alias("misplaced"))


@query(
    """select 'errors' as step, 1::bigint as calls, (select count(*) from events where event_type = 'error') as rows, 0::bigint as errors union all select 'late orders', 1, (select count(*) from orders where o_orderstatus = 'O'), 0
  union all select 'returns by supplier', 1, (select count(distinct l_suppkey) from lineitem where l_returnflag = 'R'), 0"""
)
def profiled_steps(spark, sf_dir):
    """Steps over the tables, their rows as observed, read back from what the profiler wrote."""
    profile = profiler.Profiler(spark, f"{shared_folder(spark)}/profile-{uuid.uuid4().hex}")
    t = lambda name: table(spark, sf_dir, name)
    for name, df in (("errors", t("events").filter("event_type = 'error'")), ("late orders", t("orders").filter("o_orderstatus = 'O'")), ("returns by supplier", t("lineitem").filter("l_returnflag = 'R'").groupBy("l_suppkey").count())):
        with profile.step(name):
            profile.watch(name, df).write.format("noop").mode("overwrite").save()
    profile.close()
    return profiler.slowest(profiler.steps(spark, profile.folder), 20).select("step", "calls", "rows", "errors")


@query(
    "select 'M:Shop.C' || p_partkey || '.Make(int?,int?)' as member_id, cast(case p_size % 3 when 0 then 2 else 3 end as bigint) as cyclomatic from part"
)
def object_initialisers(spark, sf_dir):
    """P10: methods that only fill an object get no points for `??`."""
    key, size = F.col("p_partkey"), F.col("p_size")
    body = _pick(("if (b == null) { return null; } return (new Item { A = a ?? 1, B = b ?? 2, C = 3 });", "return new Item { A = a ?? 1, B = b ?? 2, C = F(3), D = 4, E = 5 };", "if (a == null) { b = 1; } var x = b ?? 3; return x;"), size % 3)
    text = F.concat(F.lit("namespace Shop { class C"), key.cast("string"), F.lit(" { public object Make(int? a, int? b) { "), body, F.lit(" } } }"))
    own = dealt_parts(spark, sf_dir).select(key.alias("file_id"), text.alias("text"))
    return structure.cyclomatic(lexical.branching_nodes(own), profiles.object_initialisers(own)).withColumn("cyclomatic", F.col("cyclomatic").cast("long"))

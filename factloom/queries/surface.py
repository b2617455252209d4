"""The query surface and the rule catalogue over the driver's tables: parts are members of files, customers are types, documents
are files. A line of an order is a call, as in `graphs`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalogue, rules
from ..plans import catalog
from ..plans.catalog import Facts
from .graphs import _CLOSED, _DEAD, _LEVELS, _REFS, _TREE, containment, references
from .registry import query, table
from .rulebook import RULES, VIOLATIONS, found
from .texts import FILES, files

ALL = 2**31 - 1

#: Parts are members, of brands, in 200 files.
_SYMBOLS = """symbols as (select 'P' || p_partkey as symbol_id, p_brand as container_id, p_partkey % 200 as file_id, 'src/m' || (p_partkey % 200 % 7) || '/f' || (p_partkey % 200) || '.cs' as rel_path, p_name as name,
  case when p_size % 2 = 0 then 'method' else 'property' end as kind, case p_size % 3 when 0 then 'private' when 1 then 'internal' else 'public' end as visibility, p_partkey // 200 * 10 + 1 as start_line, p_partkey // 200 * 10 + 1 + p_size % 10 as end_line from part
  union all select distinct p_brand, null, -1, 'src/brands.cs', p_brand, 'class', 'public', 1, 1 from part)"""


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, key, size = table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size")
    file_id, start = key % 200, F.floor(key / 200) * 10 + 1
    path = F.concat(F.lit("src/m"), (file_id % 7).cast("string"), F.lit("/f"), file_id.cast("string"), F.lit(".cs"))
    kind = F.when(size % 2 == 0, "method").otherwise("property")
    seen = F.when(size % 3 == 0, "private").when(size % 3 == 1, "internal").otherwise("public")
    own = p.select(F.concat(F.lit("P"), key.cast("string")).alias("symbol_id"), F.col("p_brand").alias("container_id"), file_id.cast("long").alias("file_id"), path.alias("rel_path"), F.col("p_name").alias("name"), kind.alias("kind"), seen.alias("visibility"), start.cast("long").alias("start_line"), (start + size % 10).cast("long").alias("end_line"))
    brand = F.col("p_brand")
    types = p.select(brand).distinct().select(brand.alias("symbol_id"), F.lit(None).cast("string").alias("container_id"), F.lit(-1).cast("long").alias("file_id"), F.lit("src/brands.cs").alias("rel_path"), brand.alias("name"), F.lit("class").alias("kind"), F.lit("public").alias("visibility"), F.lit(1).cast("long").alias("start_line"), F.lit(1).cast("long").alias("end_line"))
    return own.unionByName(types)


@query(f"with {_SYMBOLS} select symbol_id, name, visibility from symbols where contains(upper(name), 'RING') and kind = 'method'")
def tool_find_symbol(spark, sf_dir):
    return catalog.find_symbol(Facts(symbols=symbols(spark, sf_dir)), "ring", "method", 0)[0].select("symbol_id", "name", "visibility")


@query(f"with {_REFS} select distinct caller_id, callee_id, file_id, line, 1 as level from r where callee_id = 'P11'")
def tool_find_references(spark, sf_dir):
    return catalog.find_references(Facts(symbols=symbols(spark, sf_dir), references=references(spark, sf_dir)), "P11", 0)[0]


@query(
    f"""with {_LEVELS}, k as (select n, 0 as v from l0 union all select n, 1 from l1), c as (select n, v from k order by v, n limit 200), s as (select distinct caller_id, callee_id, file_id, line from r join c on callee_id = n), t as (select count(*) as total from s)
  select total, least(total, 50) as shown, total > 50 or (select count(*) from k) > 200 as truncated, (select count(*) from k) > 200 as node_limit from t"""
)
def tool_references_completeness(spark, sf_dir):
    return catalog.find_references(Facts(symbols=symbols(spark, sf_dir), references=references(spark, sf_dir)), "P7", 50, 2)[1]


_BOTH = f"""{_TREE}, o as (select caller_id as p, callee_id as c, count(*) as sites from r group by all), oa as (select p as parent, c as child, 1 as level, sites from o where p = 'P7'),
ofr as (select c from (select child as c, row_number() over (order by sites desc, child) as rn from oa) where rn <= 10 and c <> 'P7'), ob as (select p as parent, c as child, 2 as level, sites from o join (select distinct c as q from ofr) on q = p),
tree as (select *, 'incoming' as direction from a union all select *, 'incoming' from b union all select *, 'outgoing' from oa union all select *, 'outgoing' from ob)"""


@query(f"with {_BOTH} select * from tree order by level, parent, sites desc, child, direction limit 250")
def tool_call_tree(spark, sf_dir):
    f = Facts(symbols=symbols(spark, sf_dir), references=references(spark, sf_dir))
    return catalog.get_call_tree(f, "P7", 2, 10, "both")[0].select("parent", "child", "level", "sites", "direction")


@query(
    f"""with {_REFS}, {_SYMBOLS}, h as (select * from (values ('src/m3/f3.cs', 1, 40), ('src/m4/f4.cs', 12, 12), ('src/m5/f5.cs', 900000, 900001)) t(path, lo, hi)),
  t as (select distinct symbol_id from symbols join h on rel_path = path and end_line >= lo and start_line <= hi) select distinct callee_id, caller_id, file_id, line from r where callee_id in (select symbol_id from t)"""
)
def tool_impact_of_changes(spark, sf_dir):
    changes = spark.createDataFrame([("src/m3/f3.cs", 1, 40), ("src/m4/f4.cs", 12, 12), ("src/m5/f5.cs", 900000, 900001)], "path string, start_line long, end_line long")
    return catalog.get_impact(Facts(symbols=symbols(spark, sf_dir), references=references(spark, sf_dir)), changes, max_results=0)[0]


@query(f"with recursive {_CLOSED} select src as type, node as relative, 'base' as side, level from c where src = 'N5' and level > 0 union all select node, src, 'derived', level from c where node = 'N5' and level > 0")
def tool_type_hierarchy(spark, sf_dir):
    edges = containment(spark, sf_dir).select(F.col("src").alias("type_id"), F.col("dst").alias("base_id"))
    named = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("symbol_id"), F.col("n_name").alias("name"))
    return catalog.get_type_hierarchy(Facts(symbols=named, bases=edges), "N5", 0)[0]


@query(
    """with e as (select l_suppkey as f, l_partkey % 50 as t, string_agg(distinct l_returnflag, ',' order by l_returnflag) as types, count(*) as uses from lineitem where l_suppkey <> l_partkey % 50 group by all),
  l1 as (select distinct t as n from e where f = 3 and t <> 3), k as (select 3 as n, 0 as level union all select n, 1 from l1) select f as from_file, t as to_file, types, uses, level from e join k on n = f"""
)
def tool_dependency_graph(spark, sf_dir):
    uses = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("from_file"), (F.col("l_partkey") % 50).alias("to_file"), F.col("l_returnflag").alias("type_name"))
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file_id"))
    return catalog.dependency_graph(Facts(files=nodes, type_references=uses), 3, "outgoing", 2, 0)[0].select("from_file", "to_file", "types", "uses", "level")


@query(
    f"""with {VIOLATIONS}, s as (select v.*, case when len(f.l) >= 2 then '1: ' || f.l[1] || chr(10) || '2: ' || f.l[2] else '1: ' || f.l[1] end as snippet from v join facts f using (file_id))
  select file_id, rule, severity, snippet from s order by case severity when 'error' then 0 when 'warning' then 1 else 2 end, upper(rel_path), line, rule limit 50"""
)
def tool_violations_with_snippets(spark, sf_dir):
    own = found(spark, sf_dir).drop("severity", "intent")
    f = Facts(files=files(spark, sf_dir), violations=own, metadata=rules.metadata(RULES, spark))
    return catalog.get_violations(f, None, 50, 1, True)[0].select("file_id", "rule", "severity", "snippet")


@query(
    rf"""with {FILES}, a as (select file_id, rel_path, string_split(text, chr(10)) as l from files where starts_with(rel_path, 'src1/')), h as (select file_id, rel_path, l, unnest(range(1, len(l) + 1)) as line_no from a),
  m as (select * from h where regexp_matches(l[line_no], '[0-9]{{4,}}')) select file_id, line_no, array_to_string(l[greatest(1, line_no - 1):line_no - 1], '|') as before, array_to_string(l[line_no + 1:line_no + 1], '|') as after from m order by upper(rel_path), line_no limit 200"""
)
def tool_search_pattern(spark, sf_dir):
    rows = catalog.search_pattern(Facts(files=files(spark, sf_dir)), "[0-9]{4,}", True, 200, 0, 1, include=["src1/**"])[0]
    return rows.select("file_id", "line_no", F.array_join("before", "|").alias("before"), F.array_join("after", "|").alias("after"))


@query(
    f"""with {_SYMBOLS}, m as (select 'P' || p_partkey as member_id, p_size % 20 as cyclomatic, p_size * 2 as code_lines, p_name from part where p_name in (select name from symbols where symbol_id = 'P7') or p_partkey = 9)
  select member_id, case when cyclomatic > 12 then 'VIOLATION' when cyclomatic >= 10 then 'WARN' else 'OK' end as cyclomatic_status, case when code_lines > 60 then 'VIOLATION' when code_lines >= 55 then 'WARN' else 'OK' end as code_lines_status from m"""
)
def tool_metrics_lookup(spark, sf_dir):
    own = symbols(spark, sf_dir)
    name = F.col("p_partkey") == 7
    members = table(spark, sf_dir, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("member_id"), (F.col("p_size") % 20).alias("cyclomatic"), (F.col("p_size") * 2).alias("code_lines"))
    called = table(spark, sf_dir, "part").filter(name).first()["p_name"]
    return catalog.metrics_lookup(Facts(symbols=own, members=members), [called, "P9"], {"cyclomatic": (12, 2), "code_lines": (60, 5)})[0].select("member_id", "cyclomatic_status", "code_lines_status")


#: Literals are sizes of parts; a constant is a size under its brand.
_LITERALS = """lit as (select p_partkey % 20 as file_id, p_partkey as line, p_size as col, 'magic_number' as category, cast(p_size as varchar) as value from part),
cons as (select p_brand as kind, cast(p_size as varchar) as value, p_partkey % 20 as file_id, p_partkey as line, p_size as col from part), dup as (select kind, value from cons group by all having count(distinct file_id) >= 2),
every as (select file_id, line, col, category, value from lit union all select file_id, line, col, 'duplicate_constant', value from cons where exists (select 1 from dup where dup.kind = cons.kind and dup.value = cons.value)),
g as (select category, value, file_id, count(*) as n, min(line) as line, min(col) as col from every where value not in ('0', '1', '-1', '', 'true', 'false') group by all having count(*) >= 2)"""


def _magic(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    at = [(F.col("p_partkey") % 20).alias("file_id"), F.col("p_partkey").alias("line"), F.col("p_size").alias("col")]
    value = F.col("p_size").cast("string").alias("value")
    named = p.select((F.col("p_partkey") % 20).alias("file_id"), F.concat(F.lit("f"), F.col("p_partkey") % 20).alias("rel_path"), F.lit("").alias("project")).distinct()
    f = Facts(files=named, literals=p.select(*at, F.lit("magic_number").alias("category"), value), constants=p.select(F.col("p_brand").alias("kind"), value, *at))
    return catalog.find_magic_values(f, min_occurrences=2, max_results=50)


@query(f"with {_LITERALS} select * from g order by n desc, category, value, file_id limit 50")
def tool_magic_values(spark, sf_dir):
    return _magic(spark, sf_dir)[0].select("category", "value", "file_id", "n", "line", "col")


@query(f"with {_LITERALS} select category, count(*) as groups, cast(sum(n) as bigint) as occurrences, least(count(*), 50) as shown from g group by category")
def tool_magic_summary(spark, sf_dir):
    return _magic(spark, sf_dir)[1]


@query(f"with {_DEAD} select symbol_id, name, kind from x where visibility = 'private' and kind = '1-URGENT'")
def tool_dead_code(spark, sf_dir):
    o = F.col("o_orderkey")
    own = table(spark, sf_dir, "orders").select(
        o.alias("symbol_id"), F.when(o % 10 != 0, F.floor(o / 10) * 10).cast("long").alias("container_id"), F.concat(F.lit("o"), o.cast("string")).alias("name"), F.col("o_orderpriority").alias("kind"),
        F.when(F.col("o_orderstatus") == "F", "private").otherwise("public").alias("visibility"), (o % 100).alias("file_id"), F.concat(F.lit("f"), (o % 100).cast("string")).alias("rel_path"), o.alias("start_line"))
    f = Facts(files=None, symbols=own, references=table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("callee_id")))
    return catalog.find_dead_code(f, kind="1-URGENT", max_results=ALL)[0].select("symbol_id", "name", "kind")


#: Orders are test files: what they cover, take the type of, are named after and mention follows from their numbers.
_TESTS = """tests as (select 'T' || o_orderkey as file, 'N' || o_orderkey % 90 as named, case when o_orderstatus = 'F' then 'N' || o_orderkey % 30 end as covered, case when o_orderstatus = 'P' then 'N' || o_orderkey % 40 end as typed, 'N' || o_custkey % 50 as word from orders),
hits as (select file, covered as symbol, 1 as rank from tests union all select file, typed, 2 from tests union all select file, named, 3 from tests union all select file, word, 4 from tests)"""


def _tests(spark, sf_dir):
    n = lambda c: F.concat(F.lit("N"), c.cast("string"))
    o, none, status = F.col("o_orderkey"), F.array().cast("array<string>"), F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("T"), o.cast("string")).alias("file"), F.concat(n(o % 90), F.lit("Tests")).alias("class_name"), F.array(n(F.col("o_custkey") % 50)).alias("text_words"),
        F.when(status == "F", F.array(n(o % 30))).otherwise(none).alias("covers"), F.when(status == "P", F.array(n(o % 40))).otherwise(none).alias("typeofs"))


def _customers(spark, sf_dir):
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), key.cast("string")).alias("symbol_id"), F.concat(F.lit("N"), key.cast("string")).alias("name"), (key % 9).alias("cognitive"))


@query(f"with {_TESTS} select symbol, file, case min(rank) when 1 then 'covers' when 2 then 'typeof' when 3 then 'name' else 'mention' end as reason from hits where symbol = 'N7' group by symbol, file")
def tool_test_context(spark, sf_dir):
    return catalog.get_test_context(Facts(symbols=_customers(spark, sf_dir), tests=_tests(spark, sf_dir)), "N7", 0)[0]


@query(f"with {_TESTS}, k as (select symbol, file, min(rank) as rank from hits where symbol is not null group by all), c as (select 'C' || c_custkey as symbol_id, 'N' || c_custkey as name, c_custkey % 9 as cognitive from customer) select * from c where cognitive > 3 and name not in (select symbol from k where rank < 4)")
def uncovered_symbols(spark, sf_dir):
    from ..operators.coverage import uncovered

    return uncovered(_customers(spark, sf_dir), _tests(spark, sf_dir))


@query(f"with {_SYMBOLS} select symbol_id, name, kind, start_line from symbols where container_id = 'Brand#2' order by file_id, start_line limit 50")
def tool_class_structure(spark, sf_dir):
    return catalog.get_class_structure(Facts(symbols=symbols(spark, sf_dir)), "Brand#2")[0].select("symbol_id", "name", "kind", "start_line")


@query(f"with {_SYMBOLS} select file_id, start_line, kind, visibility, name from symbols where file_id in (3, 4) and visibility = 'public'")
def tool_file_skeleton(spark, sf_dir):
    return catalog.get_file_skeleton(Facts(symbols=symbols(spark, sf_dir)), [3, 4], True)[0]


@query(
    """with t as (select 'App.' || c_mktsegment || '.N' || c_nationkey as ns, 'App.' || c_mktsegment as up, 'p' || c_custkey % 3 as project from customer), p as (select up as namespace, project from t union all select ns, project from t)
  select namespace, count(*) as types, count(distinct project) as projects from p where starts_with(namespace, 'App.B') group by namespace"""
)
def tool_namespace_tree(spark, sf_dir):
    space = F.concat(F.lit("App."), F.col("c_mktsegment"), F.lit(".N"), F.col("c_nationkey").cast("string"))
    types = table(spark, sf_dir, "customer").select(space.alias("namespace"), F.concat(F.lit("p"), (F.col("c_custkey") % 3).cast("string")).alias("project"))
    return catalog.get_namespace_tree(Facts(), types, 3, "App.B", 0)[0]


#: Documents as symbols of themselves, named by language; the first lines are the body.
def _bodies(spark, sf_dir):
    f, end = files(spark, sf_dir), F.col("file_id") % 5 + 2
    return f, f.select(F.concat(F.lit("D"), F.col("file_id").cast("string")).alias("symbol_id"), "file_id", "rel_path", F.split("rel_path", "/")[1].alias("name"), F.lit(1).alias("start_line"), end.alias("end_line"))


@query(f"with {FILES} select 'D' || file_id as symbol_id, array_to_string(string_split(text, chr(10))[1:least(4, file_id % 5 + 2)], chr(10)) as body, file_id % 5 + 2 > 4 as cut from files where string_split(rel_path, '/')[2] = 'fr'")
def tool_symbol_body(spark, sf_dir):
    f, own = _bodies(spark, sf_dir)
    return catalog.get_symbol_body(Facts(files=f, symbols=own), "fr", 4)[0]


@query(f"with {VIOLATIONS} select file_id, rule from v where string_split(rel_path, '/')[2] = 'fr'")
def tool_feature_violations(spark, sf_dir):
    f, own = _bodies(spark, sf_dir)
    none = spark.createDataFrame([], "member_id string")
    facts = Facts(files=f, symbols=own, references=references(spark, sf_dir), violations=found(spark, sf_dir), members=none, tests=_tests(spark, sf_dir))
    return catalog.get_feature_context(facts, "fr")["violations"].select("file_id", "rule")


@query("""with f as (select '.' || lang as ext, count(*) as n from documents group by all), e as (select * from (values ('.en'), ('.fr'), ('.cshtml')) t(ext)) select coalesce(f.ext, e.ext) as ext, coalesce(n, 0) as n from f full join e on e.ext = f.ext""")
def tool_index_scope(spark, sf_dir):
    f = table(spark, sf_dir, "documents").select(F.concat(F.lit("."), F.col("lang")).alias("ext"))
    return catalog.get_index_scope(Facts(files=f), spark.createDataFrame([(".en",), (".fr",), (".cshtml",)], "ext string"))[0]


_OVER = [("MaxMethodLineCount", "code_lines", 60), ("MaxMethodParameterCount", "effective_params", 4), ("MaxCyclomaticComplexity", "cyclomatic", 12), ("MaxCognitiveComplexity", "cognitive", 15), ("MaxSwitchArms", "switch_arms", 10), ("MaxBoolParameterCount", "bool_params", 1)]
_FLAGS = [("EnforceNoSilentCatch", "silent_catches > 0", "exception is swallowed"), ("BanAsyncVoid", "is_async_void", "async void"), ("BanBlockingTaskAccess", "blocking_calls > 0", "blocks on a task"), ("AllowOutParameters", "out_params > 0", "out parameter"), ("AllowDynamic", "uses_dynamic", "dynamic")]
_TYPE_OVER = [("MaxInheritanceDepth", "inheritance_depth", 2), ("MaxConstructorDependencies", "dependencies", 5), ("AIContextFootprint", "footprint", 5000), ("MaxPublicMembersPerType", "public_members", 15), ("MaxPartialClassFiles", "partial_files", 2)]
_TYPE_FLAGS = [
    ("EnforceSealedClasses", "is_class and not is_sealed and not is_static and not is_abstract", "class is open"), ("AvoidExcessiveMiddleMen", "members >= 5 and forwarder_share > 0.6", "mostly forwards"),
    ("BanPublicNestedTypes", "is_nested and visibility <> 'private'", "nested type is visible"), ("EnforcePascalCase", "not regexp_full_match(name, '[A-Z][A-Za-z0-9]*')", "name isn''t PascalCase"),
    ("EnforceXmlDocumentation", "visibility = 'public' and not has_docs", "no documentation"),
]


def _every_rule(over, flags) -> str:
    rows = [f"select file_id, '{rule}' as rule, {col} || ' > {n}' as details from facts where {col} > {n}" for rule, col, n in over]
    return " union all ".join(rows + [f"select file_id, '{rule}', '{text}' from facts where {holds}" for rule, holds, text in flags])


@query(
    f"""with facts as (select p_partkey as file_id, p_size * 2 as code_lines, p_size % 7 as effective_params, p_size % 20 as cyclomatic, p_size % 25 as cognitive, p_size % 13 as switch_arms, p_size % 3 as bool_params, case when p_partkey % 11 = 0 then 1 else 0 end as silent_catches,
  p_partkey % 13 = 0 as is_async_void, case when p_partkey % 17 = 0 then 2 else 0 end as blocking_calls, case when p_partkey % 19 = 0 then 1 else 0 end as out_params, p_partkey % 23 = 0 as uses_dynamic from part) {_every_rule(_OVER, _FLAGS)}"""
)
def catalogue_member_rules(spark, sf_dir):
    s, key = F.col("p_size"), F.col("p_partkey")
    every = lambda n, hit: F.when(key % n == 0, hit).otherwise(0)
    members = table(spark, sf_dir, "part").select(
        key.alias("file_id"), (s * 2).alias("code_lines"), (s % 7).alias("effective_params"), (s % 20).alias("cyclomatic"), (s % 25).alias("cognitive"), (s % 13).alias("switch_arms"), (s % 3).alias("bool_params"), every(11, 1).alias("silent_catches"),
        (key % 13 == 0).alias("is_async_void"), every(17, 2).alias("blocking_calls"), every(19, 1).alias("out_params"), (key % 23 == 0).alias("uses_dynamic"), F.lit(0).alias("linq_chain"), F.lit(0).alias("throws"))
    return catalogue.run({"members": members}).select("file_id", "rule", "details")


@query(
    f"""with facts as (select c_custkey as file_id, case when c_custkey % 4 = 0 then lower(c_mktsegment) || '_x' else c_mktsegment end as name, c_custkey % 5 as inheritance_depth, c_custkey % 8 as dependencies, c_custkey * 7 % 6000 as footprint, c_custkey % 21 as public_members, c_custkey % 4 as partial_files,
  c_custkey % 2 = 0 as is_class, c_custkey % 3 = 0 as is_sealed, c_custkey % 5 = 0 as is_static, c_custkey % 7 = 0 as is_abstract, c_custkey % 9 as members, c_custkey % 10 / 10.0 as forwarder_share, c_custkey % 6 = 0 as is_nested, case when c_custkey % 4 = 0 then 'private' else 'public' end as visibility,
  c_custkey % 8 < 5 as has_docs from customer) {_every_rule(_TYPE_OVER, _TYPE_FLAGS)}"""
)
def catalogue_type_rules(spark, sf_dir):
    k = F.col("c_custkey")
    name = F.when(k % 4 == 0, F.concat(F.lower("c_mktsegment"), F.lit("_x"))).otherwise(F.col("c_mktsegment"))
    types = table(spark, sf_dir, "customer").select(
        k.alias("file_id"), name.alias("name"), (k % 5).alias("inheritance_depth"), (k % 8).alias("dependencies"), (k * 7 % 6000).alias("footprint"), (k % 21).alias("public_members"), (k % 4).alias("partial_files"), (k % 2 == 0).alias("is_class"), (k % 3 == 0).alias("is_sealed"),
        (k % 5 == 0).alias("is_static"), (k % 7 == 0).alias("is_abstract"), (k % 9).alias("members"), (k % 10 / 10.0).alias("forwarder_share"), (k % 6 == 0).alias("is_nested"), F.when(k % 4 == 0, "private").otherwise("public").alias("visibility"), (k % 8 < 5).alias("has_docs"), F.lit(0).alias("settable_state"))
    return catalogue.run({"types": types}).select("file_id", "rule", "details")


@query(
    f"""with {FILES}, x as (select file_id, text, len(string_split(text, chr(10))) as n, 'a/b/c/d/e/' || file_id || case file_id % 3 when 0 then '.cs' when 1 then '.css' else '.js' end as rel_path from files), w as (select *, case when text = '' then 0 else n end as web from x)
  select file_id, 'MaxLineCount' as rule, cast(n as varchar) as details from x where n > 700 union all select file_id, 'MaxDirectoryDepth', '5' from x union all select file_id, 'EnforceNullableEnable', 'nullable context is off' from x where rel_path like '%.cs' and not contains(text, '#nullable enable')
  union all select file_id, 'CSS_MaxCssLineCount', web || ' > 300' from w where rel_path like '%.css' and web > 300 union all select file_id, 'CSS_PreferScopedCss', (length(text) - length(replace(text, '{{', ''))) || ' > 5' from w where rel_path like '%.css' and length(text) - length(replace(text, '{{', '')) > 5
  union all select file_id, 'JS_MaxJsLineCount', web || ' > 150' from w where rel_path like '%.js' and web > 150 union all select file_id, 'JS_EnforceJsModules', 'not a module' from w where rel_path like '%.js' and (not regexp_matches(text, '(?m)^\\s*(import|export)\\b') or regexp_matches(text, 'window\\.\\w+\\s*=[^=]'))"""
)
def catalogue_file_rules(spark, sf_dir):
    ext = F.when(F.col("file_id") % 3 == 0, ".cs").when(F.col("file_id") % 3 == 1, ".css").otherwise(".js")
    own = files(spark, sf_dir).withColumn("rel_path", F.concat(F.lit("a/b/c/d/e/"), F.col("file_id").cast("string"), ext))
    off = {"CSS_MaxCssSelectorComplexity": {"limit": 0}}
    return catalogue.run({"files": own}, off).select("file_id", "rule", "details")


_LINES = f"""{FILES}, n as (select *, string_split(text, chr(10)) as l from files), m as (select file_id, rel_path, project, text, cast(len(l) as bigint) as lines, len(list_filter(l, lambda x: starts_with(trim(x), '//'))) as comments from n)"""


@query(
    f"""with {_LINES}, {VIOLATIONS.removeprefix(FILES + ', ')}, c as (select file_id, count(*) as violations from v group by file_id),
  w as (select m.*, coalesce(c.violations, 0) as violations, greatest(file_id % 9, file_id % 4) as peak, file_id % 9 + file_id % 4 as complexity from m left join c using (file_id)),
  p as (select unnest(['', split_part(rel_path, '/', 1), split_part(rel_path, '/', 1) || '/' || split_part(rel_path, '/', 2)]) as prefix, * from w)
  select prefix, count(*) as items, cast(sum(lines) as bigint) as lines, cast(sum(comments) as bigint) as comments, cast(sum(violations) as bigint) as violations, cast(sum(complexity) as bigint) as complexity, max(lines) as max_lines, max(peak) as max_complexity, round(sum(complexity) / (2 * count(*)), 6) as mean_complexity, round(sum(violations) / sum(lines), 6) as violation_density from p group by prefix"""
)
def tool_metrics_tree(spark, sf_dir):
    """A5 with mean and peak complexity: each file has two members."""
    f = files(spark, sf_dir)
    a, b = F.col("file_id") % 9, F.col("file_id") % 4
    members = f.select("file_id", F.explode(F.array(a, b)).alias("cyclomatic"))
    rows = catalog.metrics_tree(Facts(files=f, violations=found(spark, sf_dir), members=members), depth=2, top=ALL // 4)[0]
    return rows.select("prefix", "items", F.col("lines").cast("long").alias("lines"), F.col("comments").cast("long").alias("comments"), "violations", "complexity", F.col("max_lines").cast("long").alias("max_lines"), F.greatest("max_complexity", F.lit(0)).alias("max_complexity"), F.round("mean_complexity", 6).alias("mean_complexity"), F.round("violation_density", 6).alias("violation_density"))


@query(
    f"""with {VIOLATIONS}, s as (select * from v where starts_with(rel_path, 'src1/')), p as (select coalesce(sum(case severity when 'error' then 2.0 when 'warning' then 1.0 else 0.25 end), 0) as penalty, count(*) as violations from s),
  c as (select count(*) as classes, avg(file_id % 9 * 1.0) as complexity, avg(file_id * 1.0) as footprint, avg(case when file_id % 2 = 0 then 1.0 else 0.0 end) as sealed from files where starts_with(rel_path, 'src1/')),
  r as (select violations, classes, 10 - penalty * 1.5 / greatest(classes, 1) - greatest(0.0, complexity - 5) * 0.5 - greatest(0.0, footprint - 1000) / 1000 + sealed * 0.5 as raw from p, c)
  select violations, classes, round(greatest(0.0, least(10.0, raw)), 6) as score, greatest(0.0, least(10.0, raw)) >= 7.0 as passed from r"""
)
def tool_safeguard(spark, sf_dir):
    """A14 to A16 within a scope that holds for violations and classes alike."""
    f, n = files(spark, sf_dir), F.col("file_id")
    classes = f.select("file_id", "rel_path", "project", (n % 9 * 1.0).alias("complexity"), (n * 1.0).alias("footprint"), (n % 2 == 0).alias("is_sealed"))
    facts = Facts(files=f, violations=found(spark, sf_dir).drop("severity", "intent"), metadata=rules.metadata(RULES, spark), classes=classes)
    return catalog.safeguard(facts, "src1/", 7.0)[0].withColumn("score", F.round("score", 6))


@query(f"with {VIOLATIONS}, b as (select v.*, p.pattern from v join (values ('large', 'MaxLineCount'), ('noise', 'ShoutedText'), ('noise', 'EmptyFile')) p(pattern, rule) on p.rule = v.rule), r as (select *, row_number() over (partition by pattern order by file_id, line, rule) as rn from b) select pattern, count(*) as n, string_agg(cast(file_id as varchar), ',' order by rn) filter (rn <= 3) as first_files, count(*) - count(*) filter (rn <= 3) as more from r group by pattern")
def tool_pattern_detect(spark, sf_dir):
    patterns = spark.createDataFrame([("large", "MaxLineCount"), ("noise", "ShoutedText"), ("noise", "EmptyFile")], "pattern string, rule string")
    return catalog.pattern_detect(Facts(files=files(spark, sf_dir), violations=found(spark, sf_dir)), patterns, None, 3)[0]


@query(f"with {FILES}, n as (select file_id, rel_path as path, cast(case when text = '' then 0 else len(string_split(text, chr(10))) - case when ends_with(text, chr(10)) then 1 else 0 end end as bigint) as lines from files) select file_id, path, lines, round_even(100.0 * lines / 50, 1) as utilisation, case when round_even(100.0 * lines / 50, 1) >= 95 then 'critical' else 'warning' end as level from n where round_even(100.0 * lines / 50, 1) >= 80")
def tool_hotspots(spark, sf_dir):
    rows = catalog.get_hotspots(Facts(files=files(spark, sf_dir)), 50)[0]
    return rows.select("file_id", "path", F.col("lines").cast("long").alias("lines"), "utilisation", "level")


@query("select event_type as tool, count(*) as calls, count(*) filter (event_type = 'error') as errors, max(ts) as last_ts from events group by tool")
def tool_server_health(spark, sf_dir):
    from .logs import calls

    return catalog.get_server_health(Facts(calls=calls(spark, sf_dir)))[0]


@query(f"with {VIOLATIONS} select file_id, rule from v where file_id % 5 <> 2")
def tool_audit(spark, sf_dir):
    """Violations in files that differ from a stored baseline: of every five files one is as it was."""
    f = files(spark, sf_dir)
    now = f.select(F.col("rel_path").alias("path"), F.sha2("text", 256).alias("sha256"), "file_id")
    was = now.select("path", F.when(F.col("file_id") % 5 == 2, F.col("sha256")).otherwise("before").alias("sha256"))
    facts = Facts(files=f, violations=found(spark, sf_dir).drop("severity", "intent"), metadata=rules.metadata(RULES, spark))
    return catalog.audit(facts, was, now.drop("file_id"))[0].select("file_id", "rule")


@query(
    """with t as (select 'App.' || c_mktsegment || '.Core.N' || c_nationkey as ns from customer), p as (select unnest(['App', array_to_string(string_split(ns, '.')[1:2], '.'), array_to_string(string_split(ns, '.')[1:3], '.'), ns]) as namespace from t), c as (select namespace, count(*) as types from p group by namespace)
  select namespace, types, case when namespace = 'App' then 'App' when len(string_split(namespace, '.')) = 3 then namespace[5:] else string_split(namespace, '.')[4] end as label from c where len(string_split(namespace, '.')) <> 2"""
)
def tool_namespace_tree_collapsed(spark, sf_dir):
    """Segments have one child each, so the link between them and the whole goes."""
    space = F.concat(F.lit("App."), F.col("c_mktsegment"), F.lit(".Core.N"), F.col("c_nationkey").cast("string"))
    types = table(spark, sf_dir, "customer").select(space.alias("namespace"), F.lit("p").alias("project"))
    return catalog.get_namespace_tree(Facts(), types, 4, None, 0, True)[0].select("namespace", "types", "label")


@query("with l as (select l_orderkey * 10 + l_linenumber as symbol_id, l_orderkey as container_id, case when l_linenumber = 7 then '_' else 'v' || l_linenumber end as name from lineitem) select distinct symbol_id, name from l where name <> '_' and symbol_id not in (select l_orderkey * 10 + l_linenumber from lineitem where l_returnflag <> 'R')")
def tool_dead_locals(spark, sf_dir):
    """`locals` of find_dead_code: a line is a local of its order, read unless it was returned."""
    li, key = table(spark, sf_dir, "lineitem"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("symbol_id")
    own = li.select(key, F.col("l_orderkey").alias("container_id"), F.when(F.col("l_linenumber") == 7, "_").otherwise(F.concat(F.lit("v"), F.col("l_linenumber").cast("string"))).alias("name")).distinct()
    return catalog.find_dead_code(Facts(locals=own, local_uses=li.select(key, (F.col("l_returnflag") == "R").alias("is_write"))), kind="locals", max_results=ALL)[0].select("symbol_id", "name")

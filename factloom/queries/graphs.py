"""Graphs over `lineitem` (parts call suppliers), `orders` and the customer hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, intervals, layers
from .registry import query, table

#: A part calls the part that follows it in an order; a sparse, cyclic graph.
_REFS = """refs as (select 'P' || l_partkey as caller_id, 'P' || lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as callee_id, l_orderkey as file_id, l_linenumber as line from lineitem),
r as (select * from refs where callee_id is not null)"""


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    p = F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    rows = table(spark, sf_dir, "lineitem").select(p.alias("caller_id"), F.lead(p).over(w).alias("callee_id"), F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("line"))
    return rows.filter("callee_id is not null")


def _start(spark: SparkSession, *nodes: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in nodes], "node string")


_LEVELS = f"""{_REFS}, e as (select distinct callee_id as s, caller_id as d from r), l0 as (select 'P7' as n), l1 as (select distinct d as n from l0 join e on s = n except select n from l0),
l2 as (select distinct d as n from l1 join e on s = n except (select n from l0 union select n from l1)), l3 as (select distinct d as n from l2 join e on s = n except (select n from l0 union select n from l1 union select n from l2))"""


@query(f"with {_LEVELS} select n as node, 0 as level from l0 union all select n, 1 from l1 union all select n, 2 from l2 union all select n, 3 from l3")
def reach_depth3(spark, sf_dir):
    edges = references(spark, sf_dir).select(F.col("callee_id").alias("src"), F.col("caller_id").alias("dst")).distinct()
    return graph.reach(edges, _start(spark, "P7"), 3)


@query(f"with {_LEVELS}, k as (select n, 0 as v from l0 union all select n, 1 from l1) select distinct caller_id, callee_id, file_id, line, v + 1 as level from r join k on callee_id = n")
def find_references_depth2(spark, sf_dir):
    return graph.callers(references(spark, sf_dir), _start(spark, "P7"), 2, None).drop("truncated")


_TREE = f"""{_REFS}, t as (select callee_id as p, caller_id as c, count(*) as sites from r group by all), a as (select p as parent, c as child, 1 as level, sites from t where p = 'P7'),
f as (select c from (select child as c, row_number() over (order by sites desc, child) as rn from a) where rn <= 10 and c <> 'P7'), b as (select p as parent, c as child, 2 as level, sites from t join (select distinct c as q from f) on q = p)"""


@query(f"with {_TREE} select * from a union all select * from b")
def call_tree(spark, sf_dir):
    return graph.call_tree(references(spark, sf_dir), _start(spark, "P7"), 2, "incoming", 10).select("parent", "child", "level", "sites")


@query(f"with {_REFS} select caller_id as parent, callee_id as child, 1 as level, count(*) as sites from r where caller_id = 'P7' group by all")
def outgoing_calls(spark, sf_dir):
    return graph.call_tree(references(spark, sf_dir), _start(spark, "P7"), 1, "outgoing").select("parent", "child", "level", "sites")


@query("select l_suppkey as from_file, l_partkey % 50 as to_file, string_agg(distinct l_returnflag, ',' order by l_returnflag) as types, count(*) as uses from lineitem where l_suppkey <> l_partkey % 50 group by all")
def dependency_edges(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("from_file"), (F.col("l_partkey") % 50).alias("to_file"), F.col("l_returnflag").alias("type_name"))
    return graph.dependencies(rows)


_CONTAIN = """e as (select 'N' || n_nationkey as s, 'R' || n_regionkey as d from nation union select 'S' || s_suppkey, 'N' || s_nationkey from supplier),
z as (select 'N' || n_nationkey as node, 'f' || (n_nationkey % 5) as file, 20 + n_nationkey as lines, n_nationkey % 2 = 0 as d from nation union all select 'R' || r_regionkey, 'g' || r_regionkey, 100, false from region union all select 'S' || s_suppkey, 'h' || (s_suppkey % 20), s_suppkey % 30 + 1, false from supplier)"""


def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    one = lambda df, p, a, q, b: df.select(F.concat(F.lit(p), F.col(a).cast("string")).alias("src"), F.concat(F.lit(q), F.col(b).cast("string")).alias("dst"))
    return one(t("nation"), "N", "n_nationkey", "R", "n_regionkey").unionByName(one(t("supplier"), "S", "s_suppkey", "N", "s_nationkey"))


_CLOSED = f"""{_CONTAIN}, c as (select s as src, s as node, 0 as level from (select s from e union select d from e) union all select c.src, e.d, c.level + 1 from c join e on e.s = c.node)"""


@query(
    f"""with recursive {_CLOSED}, m as (select src, c.node, level, file, case when level > 0 and d then least(lines, 10) else lines end as own from c join z on z.node = c.node),
  o as (select src, file, own, row_number() over (partition by src, file order by level, node) as rn from m) select src, cast(sum(own) as bigint) as footprint, count(*) as files from o where rn = 1 group by src"""
)
def type_closure_footprint(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    cat = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    n, s = F.col("n_nationkey"), F.col("s_suppkey")
    sizes = t("nation").select(cat("N", n).alias("node"), cat("f", n % 5).alias("file"), (20 + n).cast("long").alias("lines"), (n % 2 == 0).alias("declaration_only"))
    sizes = sizes.unionByName(t("region").select(cat("R", F.col("r_regionkey")).alias("node"), cat("g", F.col("r_regionkey")).alias("file"), F.lit(100).cast("long").alias("lines"), F.lit(False).alias("declaration_only")))
    sizes = sizes.unionByName(t("supplier").select(cat("S", s).alias("node"), cat("h", s % 20).alias("file"), (s % 30 + 1).cast("long").alias("lines"), F.lit(False).alias("declaration_only")))
    return graph.footprint(containment(spark, sf_dir), sizes)


@query(f"with recursive {_CLOSED} select src as type, max(level) as depth from c group by src")
def inheritance_depth(spark, sf_dir):
    return graph.inheritance_depth(containment(spark, sf_dir).select(F.col("src").alias("type_id"), F.col("dst").alias("base_id")))


@query(f"with recursive {_CLOSED} select src as type, node as relative, 'base' as side, level from c where src = 'N3' and level > 0 union all select node, src, 'derived', level from c where node = 'N3' and level > 0")
def type_hierarchy(spark, sf_dir):
    bases = containment(spark, sf_dir).select(F.col("src").alias("type_id"), F.col("dst").alias("base_id"))
    return graph.hierarchy(bases, _start(spark, "N3"))


#: Orders are symbols, in containers of ten, and every line refers to its order; some orders have none.
_DEAD = """s as (select o_orderkey as symbol_id, case when o_orderkey % 10 = 0 then null else o_orderkey // 10 * 10 end as container_id, 'o' || o_orderkey as name, o_orderpriority as kind, case when o_orderstatus = 'F' then 'private' else 'public' end as visibility from orders),
u as (select distinct l_orderkey as symbol_id from lineitem), d as (select * from s where symbol_id not in (select symbol_id from u)), x as (select * from d where container_id is null or container_id not in (select symbol_id from d))"""


def _dead(spark, sf_dir):
    o = F.col("o_orderkey")
    symbols = table(spark, sf_dir, "orders").select(o.alias("symbol_id"), F.when(o % 10 != 0, F.floor(o / 10) * 10).cast("long").alias("container_id"), F.concat(F.lit("o"), o.cast("string")).alias("name"), F.col("o_orderpriority").alias("kind"), F.when(F.col("o_orderstatus") == "F", "private").otherwise("public").alias("visibility"))
    return graph.dead_symbols(symbols, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("callee_id")))


@query(f"with {_DEAD} select symbol_id, name from x")
def dead_symbols(spark, sf_dir):
    return _dead(spark, sf_dir).select("symbol_id", "name")


@query(f"with {_DEAD} select kind, count(*) as n, count(*) filter (visibility = 'private') as certain from x group by kind")
def dead_summary(spark, sf_dir):
    return graph.dead_summary(_dead(spark, sf_dir))


_TOUCH = """d as (select event_id as symbol_id, cast(user_id as varchar) as path, event_id % 400 as lo, event_id % 400 + case when event_id % 4 = 0 then 40 else 5 end as hi from events), h as (select cast(user_id as varchar) as path, event_id % 397 as lo, event_id % 397 + 3 as hi from events where event_type = 'error'),
t as (select distinct d.* from d join h on h.path = d.path and d.hi >= h.lo and d.lo <= h.hi), i as (select t.* from t where not exists (select 1 from t x where x.path = t.path and x.lo >= t.lo and x.hi <= t.hi and (x.lo > t.lo or x.hi < t.hi)))"""


def _changed(spark, sf_dir):
    e, path = F.col("event_id"), F.col("user_id").cast("string").alias("path")
    ev = table(spark, sf_dir, "events")
    declared = ev.select(e.alias("symbol_id"), path, (e % 400).alias("start_line"), (e % 400 + F.when(e % 4 == 0, 40).otherwise(5)).alias("end_line"))
    return graph.touched(ev.filter("event_type = 'error'").select(path, (e % 397).alias("start_line"), (e % 397 + 3).alias("end_line")), declared)


@query(f"with {_TOUCH} select symbol_id, path from i")
def changed_symbols_interval(spark, sf_dir):
    return _changed(spark, sf_dir)


@query(f"with {_TOUCH} select distinct l_partkey as callee_id, l_suppkey as caller_id, l_orderkey as file_id, l_linenumber as line from lineitem where l_partkey in (select symbol_id from i)")
def diff_impact(spark, sf_dir):
    refs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("callee_id"), F.col("l_suppkey").alias("caller_id"), F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("line"))
    return graph.impact(_changed(spark, sf_dir), refs)


@query(
    r"""with l as (select user_id as diff_id, event_id as line_no, case when event_type = 'view' then '+++ b/' || (event_id % 9) || '.cs' when event_type = 'click' then '@@ -1,2 +' || (event_id % 90) || case when event_id % 2 = 0 then ',' || (event_id % 7) else '' end || ' @@' else '+x' end as line from events),
  f as (select *, last_value(nullif(regexp_extract(line, '^\+\+\+ b/(.+)$', 1), '') ignore nulls) over (partition by diff_id order by line_no rows unbounded preceding) as path from l)
  select diff_id, path, cast(regexp_extract(line, '\+(\d+)', 1) as integer) as start_line, coalesce(cast(nullif(regexp_extract(line, '\+\d+,(\d+)', 1), '') as integer), 1) as line_count from f where starts_with(line, '@@')"""
)
def diff_hunks(spark, sf_dir):
    e, text = F.col("event_id"), lambda c: c.cast("string")
    line = F.when(F.col("event_type") == "view", F.concat(F.lit("+++ b/"), text(e % 9), F.lit(".cs"))).when(F.col("event_type") == "click", F.concat(F.lit("@@ -1,2 +"), text(e % 90), F.when(e % 2 == 0, F.concat(F.lit(","), text(e % 7))).otherwise(""), F.lit(" @@"))).otherwise("+x")
    return graph.hunks(table(spark, sf_dir, "events").select(F.col("user_id").alias("diff_id"), e.alias("line_no"), line.alias("line")))


#: Parts refer to the part of half their number, and those of size 50 are referred to by the part of a quarter of it.
_LAYERED = """e as (select p_partkey as s, p_partkey // 2 as d from part where p_partkey > 0 union select p_partkey // 4, p_partkey from part where p_size = 50 and p_partkey > 3),
v as (select p_partkey as n from part), r as (select n as s, n from v union select r.s, e.d from r join e on e.s = r.n),
c as (select x.s as n, max(x.n) as comp, count(*) > 1 as cyclic from r x join r y on y.s = x.n and y.n = x.s group by x.s),
k as (select distinct a.comp as s, b.comp as d from e join c a on a.n = e.s join c b on b.n = e.d where a.comp <> b.comp),
l as (select distinct comp as n, 0 as layer from c union select k.s, l.layer + 1 from l join k on k.d = l.n)"""


def _layered(spark, sf_dir):
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    down = p.filter("p_partkey > 0").select(key.alias("src"), F.floor(key / 2).cast("long").alias("dst"))
    return down.unionByName(p.filter("p_size = 50 and p_partkey > 3").select(F.floor(key / 4).cast("long").alias("src"), key.alias("dst")))


@query(f"with recursive {_LAYERED} select c.n as node, c.comp as component, max(l.layer) as layer, c.cyclic from c join l on l.n = c.comp group by all")
def dependency_layers(spark, sf_dir):
    """The order of layers, cycles flagged."""
    return layers.layers(_layered(spark, sf_dir), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))).select("node", "component", "layer", "cyclic")


@query(f"with recursive {_LAYERED}, w as (select c.n, c.cyclic, max(l.layer) as wave from c join l on l.n = c.comp group by all) select wave, count(*) as projects, count(*) filter (cyclic) as cyclic from w group by wave")
def migration_waves(spark, sf_dir):
    """How many projects each wave has, and how many of them are in a cycle."""
    found = graph.waves(_layered(spark, sf_dir), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node")))
    return found.groupBy("wave").agg(F.count(F.lit(1)).alias("projects"), F.count_if("cyclic").alias("cyclic"))


_OWNED = """d as (select event_id as symbol_id, user_id as path, event_id % 400 as lo, event_id % 400 + case when event_id % 4 = 0 then 40 else 5 end as hi from events),
p as (select event_id as point_id, user_id as path, event_id % 397 as line from events where event_type = 'click')"""


@query(f"with {_OWNED} select point_id, arg_min(symbol_id, struct_pack(a := -lo, b := hi, c := symbol_id)) as symbol_id, count(symbol_id) as depth from p left join d on d.path = p.path and line between lo and hi group by point_id")
def line_owners(spark, sf_dir):
    """The innermost declaration around each line, and how many are open there."""
    e, path = F.col("event_id"), F.col("user_id").alias("path")
    ev = table(spark, sf_dir, "events")
    declared = ev.select(e.alias("symbol_id"), path, (e % 400).alias("d_lo"), (e % 400 + F.when(e % 4 == 0, 40).otherwise(5)).alias("d_hi"))
    return intervals.innermost(ev.filter("event_type = 'click'").select(e.alias("point_id"), path, (e % 397).alias("line")), declared)

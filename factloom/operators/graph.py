"""Call, dependency and type graphs: bounded traversals, closures, hierarchies and change impact.

Edges are DataFrames. Bounded traversals are unrolled into at most `depth` joins; closures run to their fixpoint with a
checkpoint each round."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import intervals
from .layers import layers
from .similarity import _kept

MAX_DEPTH, MAX_NODES = 3, 200


def reach(edges: DataFrame, start: DataFrame, depth: int, most_depth: int = MAX_DEPTH) -> DataFrame:
    """(node, level): nodes reached from start (node) along src -> dst, each at its least level; start is level 0."""
    depth = max(1, min(depth, most_depth))
    seen = start.select("node").distinct().withColumn("level", F.lit(0))
    front = seen
    for level in range(1, depth + 1):
        step = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        front = step.join(seen.select("node"), "node", "left_anti").withColumn("level", F.lit(level))
        if level > 1:
            front = _kept(front)
        seen = seen.unionByName(front)
    return seen


def _asked(references: DataFrame, symbols: DataFrame, depth: int) -> DataFrame:
    """(node, level): the symbols and their callers whose call sites a traversal of this depth gives."""
    depth = max(1, min(depth, MAX_DEPTH))
    # only the front's own call sites are made distinct, by reach()
    edges = references.select(F.col("callee_id").alias("src"), F.col("caller_id").alias("dst"))
    return reach(edges, symbols, depth).filter(F.col("level") < depth)


def callers(references: DataFrame, symbols: DataFrame, depth: int = 1, most_nodes: int | None = MAX_NODES) -> DataFrame:
    """Call sites of the symbols and of their callers, with level. Nodes beyond the cap, in order of level and name, are left
    out; whether there are any is in `truncated` of each row, and in node_limit. None is no cap."""
    nodes = _kept(_asked(references, symbols, depth))
    cut = nodes.agg((F.count(F.lit(1)) > most_nodes if most_nodes is not None else F.lit(False)).alias("truncated"))
    ranked = nodes.orderBy("level", "node").limit(most_nodes) if most_nodes is not None else nodes
    sites = references.join(ranked, F.col("callee_id") == F.col("node"))
    return sites.select("caller_id", "callee_id", "file_id", "line", (F.col("level") + 1).alias("level")).distinct().crossJoin(F.broadcast(cut))


def node_limit(references: DataFrame, symbols: DataFrame, depth: int = 1, most_nodes: int = MAX_NODES) -> DataFrame:
    """One row: nodes that callers() has to ask, and node_limit, whether they are over the cap."""
    return _asked(references, symbols, depth).agg(F.count(F.lit(1)).alias("nodes"), (F.count(F.lit(1)) > most_nodes).alias("node_limit"))


def call_tree(references: DataFrame, root: DataFrame, depth: int = 2, direction: str = "incoming", top: int = 10) -> DataFrame:
    """(parent, child, level, sites): a parent's children in order; only the first `top` of a level's children go deeper."""
    src, dst = ("callee_id", "caller_id") if direction == "incoming" else ("caller_id", "callee_id")
    edges = references.groupBy(F.col(src).alias("parent"), F.col(dst).alias("child")).agg(F.count(F.lit(1)).alias("sites"))
    front, seen, out = root.select(F.col("node").alias("parent")), root.select("node"), None
    for level in range(1, max(1, min(depth, 5)) + 1):
        rows = _kept(front.join(edges, "parent").withColumn("level", F.lit(level)))
        out = rows if out is None else out.unionByName(rows)
        w = Window.partitionBy("parent").orderBy(F.desc("sites"), "child")
        fresh = rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= top).select(F.col("child").alias("node")).distinct().join(seen, "node", "left_anti")
        front, seen = fresh.select(F.col("node").alias("parent")), seen.unionByName(fresh)
    return out


def dependencies(type_references: DataFrame) -> DataFrame:
    """File edges without self-edges: distinct type names in order, and number of uses."""
    rows = type_references.filter("from_file <> to_file")
    return rows.groupBy("from_file", "to_file").agg(F.array_join(F.array_sort(F.collect_set("type_name")), ",").alias("types"), F.count(F.lit(1)).alias("uses"))


def closure(edges: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(src, node, level): everything reached from each asked source (node; by default every node), itself at level 0, at its least
    level. Each round joins the pairs found last with their edges, so that only the sources' own cones are ever looked at."""
    edges = _kept(edges.select("src", "dst").distinct())
    nodes = edges.select("src").unionByName(edges.select(F.col("dst").alias("src"))).distinct()
    if asked is not None:
        nodes = nodes.join(asked.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
    seen = front = _kept(nodes.select("src", F.col("src").alias("node"), F.lit(0).alias("level")))
    for level in itertools.count(1):
        step = front.join(edges.withColumnRenamed("src", "at"), F.col("node") == F.col("at")).select("src", F.col("dst").alias("node")).distinct()
        front = _kept(step.join(seen, ["src", "node"], "left_anti").withColumn("level", F.lit(level)))
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front) if level % 32 else _kept(seen.unionByName(front))
    return seen


def footprint(edges: DataFrame, sizes: DataFrame, cap: int = 10, asked: DataFrame | None = None, blocks: int = 1) -> DataFrame:
    """Lines that a reader of each asked type (by default every type) has to know: its own in full, and those of every type it reaches, a
    declaration-only type counted with at most `cap`; each file counts once, for the type of the least level and name in it. The types
    are taken in blocks by their hash, so that only a block's reach is ever held, and its sums, a row a type, are kept.

    edges: src, dst types; sizes: node, file, lines, declaration_only."""
    edges = _kept(edges.select("src", "dst").distinct())
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    every = ends if asked is None else asked.select("node").distinct()
    own = F.when((F.col("level") > 0) & F.col("declaration_only"), F.least("lines", F.lit(cap))).otherwise(F.col("lines"))
    out = None
    for i in range(blocks):
        some = every if blocks == 1 else every.filter(F.pmod(F.xxhash64("node"), F.lit(blocks)) == i)
        rows = closure(edges, some).join(sizes, "node").withColumn("own", own)
        once = rows.groupBy("src", "file").agg(F.min_by("own", F.struct("level", "node")).alias("own"))
        part = once.groupBy("src").agg(F.sum("own").alias("footprint"), F.count(F.lit(1)).alias("files"))
        part = part if blocks == 1 else _kept(part)
        out = part if out is None else out.unionByName(part)
    return out


def hierarchy(bases: DataFrame, types: DataFrame) -> DataFrame:
    """(type, relative, side, level) of the given types: base chain and interfaces upward, subtypes downward. Only the types' own
    relatives are looked at."""
    up = bases.select(F.col("type_id").alias("src"), F.col("base_id").alias("dst"))
    down = bases.select(F.col("base_id").alias("src"), F.col("type_id").alias("dst"))
    out = None
    for side, edges in (("base", up), ("derived", down)):
        rows = closure(edges, types).filter("level > 0").select(F.col("src").alias("type"), F.col("node").alias("relative"), F.lit(side).alias("side"), "level")
        out = rows if out is None else out.unionByName(rows)
    return out


def inheritance_depth(bases: DataFrame) -> DataFrame:
    """type, depth: longest base chain of each type, within the known types. Types that derive from each other share the depth of
    their cycle, which counts as one step."""
    found = layers(bases.select(F.col("type_id").alias("src"), F.col("base_id").alias("dst")))
    return found.select(F.col("node").alias("type"), F.col("layer").alias("depth"))


def waves(project_references: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """project, wave, cyclic: the order in which projects can be taken on, those without a reference first; projects that refer to
    each other are in one wave. project_references: src refers to dst."""
    found = layers(project_references, projects)
    return found.select(F.col("node").alias("project"), F.col("layer").alias("wave"), "cyclic")


def dead_symbols(symbols: DataFrame, references: DataFrame, overrides: DataFrame | None = None, alive: list[str] | None = None) -> DataFrame:
    """Symbols without a reference, neither to them nor to a member that they override or implement, without a name that
    marks an entry point, and not inside a dead container (symbols: symbol_id, container_id, name)."""
    used = references.select(F.col("callee_id").alias("symbol_id")).distinct()
    if overrides is not None:
        used = used.unionByName(overrides.join(used.withColumnRenamed("symbol_id", "base_id"), "base_id", "left_semi").select("symbol_id")).distinct()
    rows = symbols.join(used, "symbol_id", "left_anti").filter(~F.coalesce(F.col("name").isin(alive or []), F.lit(False)))
    containers = rows.select(F.col("symbol_id").alias("container_id"))
    return rows.join(containers, "container_id", "left_anti")


# Fixed: attributes of symbols that something outside of the sources calls, and kinds of methods that are never called by name.
CALLED_FROM_OUTSIDE = ["ModuleInitializerAttribute", "DllImportAttribute", "UnmanagedCallersOnlyAttribute", "FactAttribute", "TheoryAttribute", "TestAttribute", "TestMethodAttribute", "McpServerToolAttribute", "McpToolAttribute", "ExportAttribute", "ImportAttribute", "JSInvokableAttribute", "ParameterAttribute", "InjectAttribute", "JsonConstructorAttribute", "BenchmarkAttribute"]
NEVER_BY_NAME = ["static_constructor", "destructor", "property_get", "property_set", "event_add", "event_remove", "event_raise", "operator", "conversion"]


def whitelisted(symbols: DataFrame, entry_points: list[str] | None = None) -> DataFrame:
    """symbol_id of symbols that count as alive without a reference: with an attribute that something outside asks for, with a name that a
    compiler gives, of a kind that is never called by name, entry points and their types, and the private empty constructor of a class
    that has only static members. symbols: symbol_id, container_id, name, kind, visibility, attributes (array of names as written), is_static,
    parameters (count)."""
    asked = [a.upper() for a in CALLED_FROM_OUTSIDE]
    full = F.transform(F.coalesce("attributes", F.array().cast("array<string>")), lambda a: F.upper(F.element_at(F.split(a, r"\."), -1)))
    marked = F.exists(full, lambda a: a.isin(asked) | F.concat(a, F.lit("ATTRIBUTE")).isin(asked))
    made = F.startswith("name", F.lit("<")) | F.endswith("name", F.lit("$")) | (F.col("name") == "EqualityContract")
    entry = F.col("symbol_id").isin(entry_points or [""])
    by_rule = symbols.filter(marked | made | entry | F.col("kind").isin(NEVER_BY_NAME)).select("symbol_id")
    holders = symbols.filter(entry).select(F.col("container_id").alias("symbol_id"))
    # a class of static members alone needs its private constructor to keep others from making one
    utility = symbols.filter("container_id is not null and kind <> 'constructor'").groupBy("container_id").agg(F.min(F.coalesce("is_static", F.lit(False))).alias("only_static")).filter("only_static").select("container_id")
    constructors = symbols.filter((F.col("kind") == "constructor") & (F.col("visibility") == "private") & (F.col("parameters") == 0)).join(utility, "container_id", "left_semi").select("symbol_id")
    return by_rule.unionByName(holders).unionByName(constructors).filter("symbol_id is not null").distinct()


def dead_locals(locals_: DataFrame, uses: DataFrame) -> DataFrame:
    """Locals that nothing reads: locals_ (symbol_id, container_id, name, ...) without a use (symbol_id) that isn't a write; names that begin
    with an underscore alone stand for what isn't wanted."""
    read = uses.filter(~F.coalesce("is_write", F.lit(False))).select("symbol_id") if "is_write" in uses.columns else uses.select("symbol_id")
    return locals_.filter(~F.col("name").rlike("^_+$")).join(read.distinct(), "symbol_id", "left_anti")


def dead_summary(dead: DataFrame) -> DataFrame:
    return dead.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("visibility") == "private").alias("certain"))


def hunks(diff: DataFrame) -> DataFrame:
    """(path, start_line, line_count) from the lines of a unified diff (line_no, line). The lines of one diff are in order on
    one task; a diff is a text that a person reviews."""
    named = diff.withColumn("named", F.nullif(F.regexp_extract("line", r"^\+\+\+ b/(.+)$", 1), F.lit("")))
    at = named.withColumn("path", F.last("named", True).over(Window.partitionBy("diff_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))
    found = at.filter(F.col("line").rlike(r"^@@ -\S+ \+\d+"))
    count = F.nullif(F.regexp_extract("line", r"^@@ -\S+ \+(\d+)(?:,(\d+))?", 2), F.lit(""))
    return found.select("diff_id", "path", F.regexp_extract("line", r"^@@ -\S+ \+(\d+)", 1).cast("int").alias("start_line"), F.coalesce(count.cast("int"), F.lit(1)).alias("line_count"))


def touched(changes: DataFrame, declarations: DataFrame) -> DataFrame:
    """Innermost declarations that a changed range overlaps. changes: path, start_line, end_line; declarations: symbol_id,
    path, start_line, end_line. Both steps are one pass over a path's sorted ends, whatever ranges it has."""
    d = declarations.select("symbol_id", "path", F.col("start_line").alias("d_lo"), F.col("end_line").alias("d_hi"))
    return intervals.without_outer(intervals.overlapping(d, changes.select("path", F.col("start_line").alias("c_lo"), F.col("end_line").alias("c_hi")))).select("symbol_id", "path")


def impact(changed: DataFrame, references: DataFrame) -> DataFrame:
    """Call sites of changed symbols."""
    return references.join(changed.select(F.col("symbol_id").alias("callee_id")).distinct(), "callee_id").select("callee_id", "caller_id", "file_id", "line").distinct()

"""The query surface: each query takes fact tables and parameters and returns rows and a one-row completeness table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import measures as ms
from ..functions import paths
from ..functions import text as tx
from ..operators import change, coverage, graph, literals, logs, profile_search, rollup, rules, search, similarity, structure


@dataclass
class Facts:
    """Fact tables by name; a query uses those it needs. symbols: symbol_id, container_id, file_id, rel_path, name, kind,
    visibility, start_line, end_line."""

    files: DataFrame | None = None
    symbols: DataFrame | None = None
    references: DataFrame | None = None
    violations: DataFrame | None = None
    metadata: DataFrame | None = None
    bases: DataFrame | None = None
    type_references: DataFrame | None = None
    literals: DataFrame | None = None
    constants: DataFrame | None = None
    classes: DataFrame | None = None
    members: DataFrame | None = None
    tests: DataFrame | None = None
    units: DataFrame | None = None
    profiles: DataFrame | None = None
    calls: DataFrame | None = None
    #: What lies on a line: file_id, line_no, kind, symbol_id, project.
    tokens: DataFrame | None = None
    #: Locals of members, and their uses.
    locals: DataFrame | None = None
    local_uses: DataFrame | None = None


Answer = tuple[DataFrame, DataFrame]


def _answer(rows: DataFrame, most: int, *order) -> Answer:
    """The first `most` rows, and total, shown, truncated."""
    shown = rows.orderBy(*order).limit(most) if most else rows.orderBy(*order)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    cap = F.lit(most) if most else F.col("total")
    return shown, total.select("total", F.least("total", cap).alias("shown"), (F.col("total") > cap).alias("truncated"))


def _scoped(rows: DataFrame, files: DataFrame, scope: str | None) -> DataFrame:
    named = rows if "rel_path" in rows.columns else rows.join(files.select("file_id", "rel_path", "project"), "file_id", "left")
    project = F.col("project") if "project" in named.columns else F.lit("")
    return named.filter(paths.in_scope(F.col("rel_path"), F.coalesce(project, F.lit("")), scope))


def resolve(symbols: DataFrame, identifier: str) -> DataFrame:
    """Symbols by identifier: an id, path:line:column, path:line (innermost), or a name."""
    parts = identifier.rsplit(":", 2)
    exact = symbols.filter(F.col("symbol_id") == identifier)
    if identifier[:2] in ("M:", "T:", "P:", "F:", "E:"):
        return exact
    numbers = [p for p in parts[1:] if p.isdigit()]
    if numbers:
        path, line = identifier[: -sum(len(n) + 1 for n in numbers)], int(numbers[0])
        hit = symbols.filter((F.upper("rel_path") == path.upper()) & F.lit(line).between(F.col("start_line"), F.col("end_line")))
        return hit.orderBy(F.col("end_line") - F.col("start_line"), "symbol_id").limit(1)
    return symbols.filter((F.col("symbol_id") == identifier) | (F.col("name") == identifier))


def _nodes(f: Facts, identifier: str) -> DataFrame:
    return resolve(f.symbols, identifier).select(F.col("symbol_id").alias("node"))


def find_symbol(f: Facts, pattern: str, kind: str | None = None, max_results: int = 50) -> Answer:
    return _answer(structure.find_symbols(f.symbols, pattern, kind, 2**31 - 1), max_results, F.upper("name"), "symbol_id")


def find_references(f: Facts, identifier: str, max_results: int = 50, depth: int = 1) -> Answer:
    """truncated tells of both caps: on call sites shown, and on nodes asked (node_limit), which total doesn't reach beyond."""
    nodes = _nodes(f, identifier)
    rows, done = _answer(graph.callers(f.references, nodes, depth).drop("truncated"), max_results, "level", "file_id", "line", "caller_id")
    limit = graph.node_limit(f.references, nodes, depth).select("node_limit")
    return rows, done.crossJoin(limit).select("total", "shown", (F.col("truncated") | F.col("node_limit")).alias("truncated"), "node_limit")


def get_call_tree(f: Facts, identifier: str, depth: int = 2, top: int = 10, direction: str = "incoming") -> Answer:
    both = ["incoming", "outgoing"] if direction == "both" else [direction]
    out = None
    for d in both:
        rows = graph.call_tree(f.references, _nodes(f, identifier), depth, d, top).withColumn("direction", F.lit(d))
        out = rows if out is None else out.unionByName(rows)
    return _answer(out, 250, "level", "parent", F.desc("sites"), "child")


def get_impact(f: Facts, changes: DataFrame | None = None, identifier: str | None = None, max_results: int = 50, depth: int = 1) -> Answer:
    """Either of changed line ranges (path, start_line, end_line) or a symbol."""
    if (changes is None) == (identifier is None):
        raise ValueError("name either changes or a symbol")
    if identifier is not None:
        return find_references(f, identifier, max_results, depth)
    touched = graph.touched(changes, f.symbols.select("symbol_id", F.col("rel_path").alias("path"), "start_line", "end_line"))
    return _answer(graph.impact(touched, f.references), max_results, "file_id", "line", "caller_id")


def get_type_hierarchy(f: Facts, identifier: str, max_results: int = 50) -> Answer:
    return _answer(graph.hierarchy(f.bases, _nodes(f, identifier)), max_results, "side", "level", "relative")


def dependency_graph(f: Facts, file_id: int, direction: str = "outgoing", depth: int = 1, max_results: int = 50) -> Answer:
    edges = graph.dependencies(f.type_references)
    src, dst = ("from_file", "to_file") if direction == "outgoing" else ("to_file", "from_file")
    start = f.files.filter(F.col("file_id") == file_id).select(F.col("file_id").alias("node"))
    near = graph.reach(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")), start, depth).filter(F.col("level") < depth)
    rows = edges.join(near.withColumnRenamed("node", src), src)
    return _answer(rows, max_results, "level", "from_file", "to_file")


def get_violations(f: Facts, scope: str | None = None, max_results: int = 50, context_lines: int = 2, include_snippet: bool = False) -> Answer:
    rows = _scoped(rules.with_severity(f.violations, f.metadata), f.files, scope)
    if include_snippet:
        rows = rows.join(f.files.select("file_id", tx.lines(F.col("text")).alias("all_lines")), "file_id").withColumn("snippet", tx.snippet(F.col("all_lines"), F.col("line"), context_lines)).drop("all_lines")
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return _answer(rows, max_results, rank, F.upper("rel_path"), "line", "rule")


def safeguard(f: Facts, scope: str | None = None, min_score: float = 8.0, max_violations: int = 20) -> Answer:
    """The gate; the scope holds for violations and classes alike."""
    found = _scoped(rules.with_severity(f.violations, f.metadata), f.files, scope)
    score = rules.gate_score(found, _scoped(f.classes, f.files, scope), min_score)
    return score, rules.top_issue(found, max_violations)


def search_pattern(f: Facts, pattern: str, is_regex: bool = False, max_results: int = 50, max_files: int = 0, context_lines: int = 0, max_response_bytes: int = 0, scope: str | None = None, include: list[str] | None = None, exclude: list[str] | None = None) -> Answer:
    files = _scoped(f.files, f.files, scope)
    if include:
        files = files.filter(paths.matches_any(F.col("rel_path"), include, True))
    if exclude:
        files = files.filter(~paths.matches_any(F.col("rel_path"), exclude, True))
    hits = search.regex_hits(files, pattern) if is_regex else search.plain_hits(files, pattern)
    shown = search.capped(hits, max_files, max_results, max_response_bytes)
    done = search.completeness(hits, shown, max_files, max_results, max_response_bytes)
    shown = search.match_ranges(shown, pattern) if is_regex else search.term_ranges(shown, pattern)
    if f.tokens is not None:
        shown = search.enriched(shown, f.tokens)
    return (search.with_context(files, shown, context_lines, context_lines) if context_lines else shown), done


def metrics_tree(f: Facts, root: str = "", mode: str = "lines", depth: int = 1, top: int = 10, pattern: str | None = None) -> Answer:
    """mode: lines, complexity (of members: total, peak and mean), comment_density (ascending) or violation_density. The root is
    a folder, not a bare prefix; files without members have complexity 0."""
    if not 1 <= depth <= 5:
        raise ValueError("depth is 1 to 5")
    base = root.strip("/")
    rows = f.files.filter((F.lit(base) == "") | F.startswith("rel_path", F.lit(base + "/")))
    rows = rows.filter(F.col("rel_path").rlike(paths.glob_regex(pattern, True))) if pattern else rows
    counts = tx.comment_counts(F.col("text"))
    rows = rows.select("file_id", F.substring(F.col("rel_path"), len(base) + 2 if base else 1, F.lit(2**20)).alias("path"), tx.tree_lines(F.col("text")).alias("lines"), counts["comment"].alias("comments"))
    rows = rows.join(f.violations.groupBy("file_id").agg(F.count(F.lit(1)).alias("violations")), "file_id", "left").fillna(0, ["violations"]) if f.violations is not None else rows.withColumn("violations", F.lit(0))
    if f.members is not None:
        own = f.members.groupBy("file_id").agg(F.sum("cyclomatic").cast("long").alias("complexity"), F.max("cyclomatic").cast("long").alias("peak"), F.count(F.lit(1)).alias("members"))
        rows = rows.join(own, "file_id", "left").fillna(0, ["complexity", "peak", "members"])
    elif mode == "complexity":
        raise ValueError("complexity needs members")
    else:
        rows = rows.withColumns({c: F.lit(0).cast("long") for c in ("complexity", "peak", "members")})
    tree = rollup.tree(rows, depth, ["lines", "comments", "violations", "complexity", "members"], ["lines", "peak"]).withColumnRenamed("max_peak", "max_complexity")
    tree = tree.withColumn("mean_complexity", F.coalesce(F.try_divide("complexity", "members"), F.lit(0.0)))
    tree = tree.withColumn("comment_density", F.try_divide("comments", "lines")).withColumn("violation_density", F.try_divide("violations", "lines"))
    order = {"comment_density": F.asc("comment_density"), "violation_density": F.desc("violation_density"), "complexity": F.desc("complexity")}.get(mode, F.desc("lines"))
    return _answer(tree, top * depth + 1, order, "prefix")


def metrics_lookup(f: Facts, identifiers: list[str], limits: dict[str, tuple[int, int]]) -> Answer:
    """Metrics of members with their status; limits: metric -> (limit, tolerance)."""
    rows = None
    for name in identifiers:
        hit = f.members.join(resolve(f.symbols, name).select(F.col("symbol_id").alias("member_id")), "member_id", "left_semi")
        rows = hit if rows is None else rows.unionByName(hit)
    for metric, (limit, tolerance) in limits.items():
        rows = rows.withColumn(f"{metric}_status", ms.threshold_status(F.col(metric), F.lit(limit), F.lit(tolerance)))
    return _answer(rows.distinct(), 0, "member_id")


def pattern_detect(f: Facts, patterns: DataFrame, scope: str | None = None, max_per_pattern: int = 20) -> Answer:
    return _answer(rules.pattern_buckets(_scoped(f.violations, f.files, scope), patterns, max_per_pattern), 0, "pattern")


def find_magic_values(f: Facts, scope: str | None = None, category: str = "all", min_occurrences: int = 1, max_results: int = 50, changed: DataFrame | None = None) -> Answer:
    rows = _scoped(literals.with_duplicates(f.literals, f.constants), f.files, scope)
    rows = rows.filter(~ms.is_trivial_literal(F.col("value")))
    rows = rows.filter(F.col("category") == category) if category != "all" else rows
    rows = rows.join(changed.select(F.col("path").alias("rel_path")), "rel_path", "left_semi") if changed is not None else rows
    groups = literals.grouped(rows, min_occurrences)
    return groups.orderBy(F.desc("n"), "category", "value", "file_id").limit(max_results), literals.summary(groups, max_results)


def find_dead_code(f: Facts, accessibility: tuple[str, ...] = ("private", "internal"), kind: str = "all", scope: str | None = None, max_results: int = 50, overrides: DataFrame | None = None, alive: list[str] | None = None) -> Answer:
    """kind `locals` asks for locals that nothing reads. Symbols with attributes are judged by the whitelist, and those of generated files
    are left out where the files say so."""
    if kind == "locals":
        dead = graph.dead_locals(f.locals, f.local_uses)
        return dead.orderBy("container_id", "symbol_id").limit(max_results), dead.agg(F.count(F.lit(1)).alias("total"))
    own = f.symbols
    if "attributes" in own.columns:
        own = own.join(graph.whitelisted(own), "symbol_id", "left_anti")
    if f.files is not None and "is_generated" in f.files.columns:
        own = own.join(f.files.filter("is_generated").select("file_id"), "file_id", "left_anti")
    dead = graph.dead_symbols(own, f.references, overrides, alive).filter(F.col("visibility").isin(*accessibility))
    dead = _scoped(dead if kind == "all" else dead.filter(F.col("kind") == kind), f.files, scope)
    return dead.orderBy(F.upper("rel_path"), "start_line", "symbol_id").limit(max_results), graph.dead_summary(dead)


def get_test_context(f: Facts, identifier: str, max_results: int = 30) -> Answer:
    return _answer(coverage.covering_tests(resolve(f.symbols, identifier), f.tests), max_results, "symbol", "reason", "file")


def get_feature_context(f: Facts, identifier: str, max_callers: int = 10, max_tests: int = 10) -> dict[str, DataFrame]:
    """The symbol, its callers, tests, metrics, and the violations on its lines."""
    own = resolve(f.symbols, identifier)
    spans = own.select("file_id", "start_line", "end_line")
    inside = f.violations.join(spans, "file_id").filter(F.col("line").between(F.col("start_line"), F.col("end_line"))).drop("start_line", "end_line")
    return {
        "symbol": own,
        "callers": find_references(f, identifier, max_callers)[0],
        "tests": get_test_context(f, identifier, max_tests)[0],
        "metrics": f.members.join(own.select(F.col("symbol_id").alias("member_id")), "member_id", "left_semi"),
        "violations": inside,
    }


def find_duplicates(f: Facts, mode: str = "clone", threshold: float = 0.80, min_tokens: int = 5, helper: int | None = None, callers: DataFrame | None = None, max_results: int = 50) -> Answer:
    if mode == "structural":
        return _answer(profile_search.structural_sets(f.profiles, threshold), max_results, F.desc("weakest"), "root", "unit_id")
    prints = similarity.fingerprints(f.units.filter(F.size("tokens") >= min_tokens))
    if mode == "refactoring-drift":
        return _answer(similarity.drift(prints, helper, callers, threshold), max_results, F.desc("score"), "unit_id")
    pairs = similarity._kept(similarity.clone_links(prints, threshold))
    return _answer(similarity.cluster_members(pairs), max_results, F.desc("weakest"), "root", "unit_id")


def get_namespace_tree(f: Facts, types: DataFrame, depth: int = 3, prefix: str | None = None, max_results: int = 200, collapse: bool = False) -> Answer:
    rows = rollup.namespaces(types, depth)
    rows = rollup.collapsed_namespaces(rows) if collapse else rows
    rows = rows.filter(F.startswith("namespace", F.lit(prefix))) if prefix else rows
    return _answer(rows, max_results, "namespace")


def get_class_structure(f: Facts, identifier: str, sort_by: str = "lines", max_members: int = 50) -> Answer:
    container = resolve(f.symbols, identifier).select(F.col("symbol_id").alias("container_id"))
    return _answer(structure.class_structure(f.symbols.join(container, "container_id", "left_semi"), sort_by, max_members), max_members, "start_line")


def get_file_skeleton(f: Facts, file_ids: list[int], public_only: bool = False) -> Answer:
    return _answer(structure.skeleton(f.symbols.filter(F.col("file_id").isin(file_ids)), public_only), 0, "file_id", "start_line")


def get_index_scope(f: Facts, expected: DataFrame) -> Answer:
    return _answer(rollup.kinds(f.files, expected), 0, F.desc("n"), "ext")


def get_hotspots(f: Facts, limit: int = 700, scope: str | None = None) -> Answer:
    rows = _scoped(f.files, f.files, scope).select("file_id", F.col("rel_path").alias("path"), tx.read_lines(F.col("text")).alias("lines"))
    return _answer(rollup.hotspots(rows, limit, ms.hotspot_level(F.col("utilisation"))), 0, F.desc("lines"), F.upper("path"))


def get_symbol_body(f: Facts, identifier: str, max_lines: int = 80) -> Answer:
    own = resolve(f.symbols, identifier).join(f.files.select("file_id", tx.lines(F.col("text")).alias("all_lines")), "file_id")
    size = F.col("end_line") - F.col("start_line") + 1
    body = F.array_join(F.slice("all_lines", F.col("start_line"), F.least(size, F.lit(max_lines))), "\n")
    return _answer(own.select("symbol_id", body.alias("body"), (size > max_lines).alias("cut")), 0, "symbol_id")


def get_server_health(f: Facts) -> Answer:
    return _answer(logs.health(f.calls), 0, "tool")


def audit(f: Facts, stored: DataFrame, current: DataFrame) -> Answer:
    """Violations in files that differ from the baseline."""
    rows = _scoped(rules.with_severity(f.violations, f.metadata), f.files, None).withColumn("path", F.col("rel_path"))
    return _answer(change.ratchet(rows, change.compare(stored, current)), 0, F.upper("rel_path"), "line", "rule")

"""The rule catalogue: each rule is a predicate over one fact table with default limits; a limit of 0 or less turns it off.

Fact tables and the columns that their rules read:
  members   code_lines, effective_params, cyclomatic, cognitive, switch_arms, bool_params, linq_chain, silent_catches,
            is_async_void, blocking_calls, out_params, throws, uses_dynamic
  types     name, inheritance_depth, dependencies, footprint, public_members, partial_files, is_class, is_sealed, is_static,
            is_abstract, forwarder_share, members, is_nested, visibility, has_docs, settable_state
  files     rel_path, namespace, text, ext"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions import text as tx
from . import intervals, webrules
from .rules import Rule, violations


def _over(rule: str, severity: str, intent: str, column: str, limit: int) -> Rule:
    return Rule(rule, severity, intent, lambda k: F.col(column) > k[column], lambda k: F.concat(F.col(column).cast("string"), F.lit(f" > {k[column]}")), ((column, limit),))


def _if(rule: str, severity: str, intent: str, condition, details: str) -> Rule:
    return Rule(rule, severity, intent, lambda k: condition(), lambda k: F.lit(details))


# Rule ids, severities and default limits.
MEMBERS = [
    _over("MaxMethodLineCount", "error", "size", "code_lines", 60),
    _over("MaxMethodParameterCount", "warning", "size", "effective_params", 4),
    _over("MaxCyclomaticComplexity", "error", "complexity", "cyclomatic", 12),
    _over("MaxCognitiveComplexity", "error", "complexity", "cognitive", 15),
    _over("MaxSwitchArms", "warning", "complexity", "switch_arms", 10),
    _over("MaxBoolParameterCount", "warning", "clarity", "bool_params", 1),
    _over("MaxLinqChainLength", "warning", "clarity", "linq_chain", 0),
    _if("EnforceNoSilentCatch", "error", "safety", lambda: F.col("silent_catches") > 0, "exception is swallowed"),
    _if("BanAsyncVoid", "error", "safety", lambda: F.col("is_async_void"), "async void"),
    _if("BanBlockingTaskAccess", "error", "safety", lambda: F.col("blocking_calls") > 0, "blocks on a task"),
    _if("AllowOutParameters", "warning", "clarity", lambda: F.col("out_params") > 0, "out parameter"),
    _if("EnforceResultPatternOverExceptions", "error", "safety", lambda: F.col("throws") > 0, "throws"),
    _if("AllowDynamic", "error", "safety", lambda: F.col("uses_dynamic"), "dynamic"),
]
TYPES = [
    _over("MaxInheritanceDepth", "warning", "coupling", "inheritance_depth", 2),
    _over("MaxConstructorDependencies", "warning", "coupling", "dependencies", 5),
    _over("AIContextFootprint", "warning", "coupling", "footprint", 5000),
    _over("MaxPublicMembersPerType", "warning", "size", "public_members", 15),
    _over("MaxPartialClassFiles", "warning", "size", "partial_files", 2),
    _if("EnforceSealedClasses", "error", "design", lambda: F.col("is_class") & ~F.col("is_sealed") & ~F.col("is_static") & ~F.col("is_abstract"), "class is open"),
    _if("AvoidExcessiveMiddleMen", "warning", "design", lambda: (F.col("members") >= 5) & (F.col("forwarder_share") > 0.60), "mostly forwards"),
    _if("BanPublicNestedTypes", "error", "design", lambda: F.col("is_nested") & (F.col("visibility") != "private"), "nested type is visible"),
    _if("EnforcePascalCase", "error", "naming", lambda: ~F.col("name").rlike("^[A-Z][A-Za-z0-9]*$"), "name isn't PascalCase"),
    _if("EnforceAsciiIdentifiers", "error", "naming", lambda: ~F.col("name").rlike(r"^[\x00-\x7F]*$"), "name isn't ASCII"),
    _if("EnforceXmlDocumentation", "warning", "naming", lambda: (F.col("visibility") == "public") & ~F.col("has_docs"), "no documentation"),
    _if("EnforceExplicitStateImmutability", "error", "design", lambda: F.col("settable_state") > 0, "state can be set"),
]


def _text(ext: str, condition) -> Column:
    return F.endswith(F.lower("rel_path"), F.lit(ext)) & condition


def _count(pattern: str) -> Column:
    return F.regexp_count("text", F.lit(pattern))


def _web(rule: str, severity: str, ext: str, value, limit: int) -> Rule:
    return Rule(rule, severity, "web", lambda k: _text(ext, value() > k["limit"]), lambda k: F.concat(value().cast("string"), F.lit(f" > {k['limit']}")), (("limit", limit),))


FILES = [
    Rule("MaxLineCount", "error", "size", lambda k: tx.tree_lines(F.col("text")) > k["lines"], lambda k: tx.tree_lines(F.col("text")).cast("string"), (("lines", 700),)),
    Rule("MaxDirectoryDepth", "warning", "structure", lambda k: F.size(F.split("rel_path", "/")) - 1 > k["depth"], lambda k: (F.size(F.split("rel_path", "/")) - 1).cast("string"), (("depth", 4),)),
    _if("EnforceNullableEnable", "error", "safety", lambda: _text(".cs", ~F.contains("text", F.lit("#nullable enable"))), "nullable context is off"),
    _web("CSS_MaxCssLineCount", "warning", ".css", lambda: tx.web_lines(F.col("text")), 300),
    Rule("CSS_PreferScopedCss", "warning", "web", lambda k: _text(".css", ~F.endswith(F.lower("rel_path"), F.lit(".razor.css")) & (_count(r"\{") > k["limit"])), lambda k: F.concat(_count(r"\{").cast("string"), F.lit(f" > {k['limit']}")), (("limit", 5),)),
    _web("CSS_MaxCssSelectorComplexity", "warning", ".css", lambda: F.coalesce(F.array_max(F.transform(F.regexp_extract_all("text", F.lit(r"([^{};]+)\{"), F.lit(1)), lambda s: tx.selector_depth(F.trim(s)))), F.lit(0)), 3),
    _web("JS_MaxJsLineCount", "warning", ".js", lambda: tx.web_lines(F.col("text")), 150),
    _if("JS_EnforceJsModules", "warning", "web", lambda: _text(".js", ~F.col("text").rlike(r"(?m)^\s*(import|export)\b") | F.col("text").rlike(r"window\.\w+\s*=[^=]")), "not a module"),
]
#: Rules that are off until a limit or switch turns them on.
OFF = frozenset({"MaxLinqChainLength", "EnforceResultPatternOverExceptions", "EnforceExplicitStateImmutability"})


def run(tables: dict[str, DataFrame], limits: dict[str, dict[str, int]] | None = None, on: frozenset[str] = frozenset()) -> DataFrame:
    """All violations of the tables given (members, types, files): file_id, line, rule, details. limits: rule -> metric -> n."""
    out = []
    for name, rules in (("members", MEMBERS), ("types", TYPES), ("files", FILES)):
        if name in tables:
            own = [Rule(r.rule_id, r.severity, r.intent, r.predicate, r.details, tuple((k, (limits or {}).get(r.rule_id, {}).get(k, v)) for k, v in r.limits)) for r in rules if r.rule_id not in OFF or r.rule_id in on]
            if name == "files":
                web = webrules.component_rules(tables[name], {r: n for r, own in (limits or {}).items() if r in webrules.LIMITS for n in own.values()})
                out += [web, webrules.missing_companions(tables[name])]
            line = "start_line" if "start_line" in tables[name].columns else None
            out.append(violations(tables[name], own, line=line))
    return reduce(DataFrame.unionByName, out)


def forbidden_dependencies(uses: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Uses (source, target namespaces) that a pair of globs forbids."""
    hit = F.lit(False)
    for source, target in pairs:
        hit = hit | (paths.matches_any(F.col("source"), [source]) & paths.matches_any(F.col("target"), [target]))
    return uses.filter(hit)


def misplaced_namespaces(files: DataFrame) -> DataFrame:
    """Files whose directories neither end in the last two parts of their namespace nor hold all of its parts."""
    parts = F.split("namespace", r"\.")
    folders = F.split(paths.directory(F.col("rel_path")), "/")
    k = F.least(F.lit(2), F.size(parts), F.size(folders))
    ends = (F.slice(parts, F.size(parts) - k + 1, k) == F.slice(folders, F.size(folders) - k + 1, k)) | F.forall(parts, lambda p: F.array_contains(folders, p))
    return files.filter(F.col("namespace").isNotNull() & ~ends)


def guidance(rule: Column, complexity: Column, lines: Column) -> Column:
    """What to do about a violation, from the figures of its place."""
    return (
        F.when(rule == "MaxCognitiveComplexity", F.format_string("Extract nested branches; complexity is %d.", complexity.cast("int")))
        .when((rule == "MaxLineCount") & (complexity > 10), "Split by responsibility; methods here are complex.")
        .when(rule == "MaxLineCount", F.format_string("Split the file; it has %d lines.", lines.cast("int")))
        .otherwise("See the rule.")
    )


def errors_by_file(diagnostics: DataFrame) -> DataFrame:
    """Compile errors of each file, from supplied diagnostics (rel_path, severity, code)."""
    return diagnostics.filter("severity = 'error'").groupBy("rel_path").agg(F.count(F.lit(1)).alias("errors"), F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))


def playbook_totals(members: DataFrame) -> DataFrame:
    """One row: methods that return a result, also in a task, and throws that aren't allowed."""
    result = F.col("return_type").rlike(r"^(Task<|ValueTask<)?Result(<.*>)?>?$")
    return members.agg(F.count_if(result).alias("result_methods"), F.coalesce(F.sum("throws"), F.lit(0)).alias("throws"), F.count(F.lit(1)).alias("methods"))


def nested_loops(loops: DataFrame) -> DataFrame:
    """How deep the loops of a file lie in each other (file_id, start, end; loops don't cross): the most that are open where one begins,
    itself counted."""
    found = intervals.open_depth(loops.select(F.col("file_id").alias("path"), F.col("start").alias("d_lo"), F.col("end").alias("d_hi")))
    return found.groupBy(F.col("path").alias("file_id")).agg(F.max("depth").alias("depth"))


def ignored_suppressions(marks: DataFrame, languages: list[str]) -> DataFrame:
    """Suppression marks that stay in force when those of some languages (cs, razor, js, css, all) are ignored."""
    if "all" in languages:
        return marks.limit(0)
    ends = [f".{x}" for x in languages]
    return marks.filter(~F.regexp_extract(F.lower("rel_path"), r"(\.[a-z]+)$", 1).isin(ends)) if ends else marks


def projects_allowed(name: Column, include: list[str], exclude: list[str], tests: Column, only_tests: bool = False, without_tests: bool = False) -> Column:
    ok = (name.isin(include) if include else F.lit(True)) & ~name.isin(exclude or [""])
    return ok & (tests if only_tests else F.lit(True)) & (~tests if without_tests else F.lit(True))

"""Rules on what source text declares (`sources.declared`). Each gives file_id, line, rule, details."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import staged

# Names without a meaning, names that tools give, calls that find types at run time, bases of window classes.
EMPTY_NAMES = ["data", "temp", "obj", "val", "tmp", "item", "param"]
TOOL_NAMES = r"(?i)^(s_|m_|_)?(MyRegex|NewMethod|Class1|Interface1|Struct1|Record1|MyClass|MyInterface|MyStruct|MyRecord)[0-9]*$"
REFLECTION = r"^(Type\.GetType|Assembly\.Load\w*|Activator\.CreateInstance)$"
WINDOW_BASES = ["Window", "UserControl", "Page", "NavigationWindow"]
MOST_PARAMETERS = 4


def _rows(facts: DataFrame, rule: str, where: Column, details: Column) -> DataFrame:
    return facts.filter(where).select("file_id", "line", F.lit(rule).alias("rule"), details.alias("details"))


def _is(kind: str) -> Column:
    return F.col("kind") == kind


def semantic_naming(facts: DataFrame, exempt_methods: list[str] | None = None, allow_part_of_method: bool = False) -> DataFrame:
    """Types, members and parameters with a tool's name, and parameters of public methods whose name says nothing."""
    tool = _rows(facts, "EnforceSemanticNaming", F.col("kind").isin("type", "member", "parameter") & F.col("name").rlike(TOOL_NAMES), F.col("name"))
    method = F.lower(F.element_at(F.split("owner", r"\."), -1))
    empty = _is("parameter") & F.lower("name").isin(EMPTY_NAMES) & F.array_contains("words", "public") & ~method.isin([m.lower() for m in exempt_methods or [""]])
    if allow_part_of_method:
        empty = empty & ~F.contains(method, F.lower("name"))
    return tool.unionByName(_rows(facts, "EnforceSemanticNaming", empty, F.col("name")))


def endpoint_parameters(facts: DataFrame, most: int = MOST_PARAMETERS) -> DataFrame:
    """Parameters of a named type, without the attribute that binds their parts, of endpoints with over `most` parameters."""
    rows = facts.filter(_is("endpoint"))
    many = rows.groupBy("file_id", "line", "owner").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
    named = F.col("type").rlike(r"^[A-Za-z_][\w.]*$") & ~F.col("type").isin("int", "long", "short", "byte", "bool", "char", "string", "object", "double", "float", "decimal")
    return _rows(rows.join(many, ["file_id", "line", "owner"]), "EnforceMinimalApiAsParameters", named & ~F.array_contains("words", "AsParameters"), F.concat("name", F.lit(" of "), F.col("n").cast("string")))


def value_objects(facts: DataFrame) -> DataFrame:
    """Value objects that are plain classes, and their properties that can be set."""
    types = facts.filter(_is("type") & F.endswith("name", F.lit("ValueObject")))
    plain = _rows(types, "EnforceValueObjectContracts", (F.col("type") == "class") & ~F.array_contains("words", "readonly"), F.col("name"))
    own = types.select("file_id", F.when(F.col("owner") == "", F.col("name")).otherwise(F.concat_ws(".", "owner", "name")).alias("owner")).distinct()
    settable = facts.filter(_is("member") & (F.col("type") == "property") & F.array_contains("words", "set")).join(own, ["file_id", "owner"], "left_semi")
    return plain.unionByName(_rows(settable, "EnforceValueObjectContracts", F.lit(True), F.col("name")))


def phantom_dependencies(facts: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Imports of namespaces that neither the sources declare nor `namespaces` (name) lists, and calls that find types at run time. A
    namespace stands for those above it."""
    declared = facts.filter(_is("type") & (F.col("owner") != "")).select(F.col("owner").alias("name")).distinct().unionByName(namespaces.select("name"))
    parts = F.split("name", r"\.")
    known = declared.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))).alias("name")).distinct()
    lost = facts.filter(_is("using")).join(known, "name", "left_anti")
    return _rows(lost, "DetectAndBanPhantomDependencies", F.lit(True), F.col("name")).unionByName(_rows(facts, "DetectAndBanPhantomDependencies", _is("call") & F.col("name").rlike(REFLECTION), F.col("name")))


def window_code(facts: DataFrame, bases: list[str] | None = None, exempt: list[str] | None = None) -> DataFrame:
    """Partial window classes with members beside their constructors: one row a class, at the first of them."""
    asked = [b.upper() for b in bases or WINDOW_BASES]
    windows = facts.filter(_is("base") & F.upper("name").isin(asked)).select("file_id", "owner").distinct()
    types = facts.filter(_is("type") & (F.col("type") == "class") & F.array_contains("words", "partial") & ~F.upper("name").isin([e.upper() for e in exempt or [""]]))
    types = types.select("file_id", F.when(F.col("owner") == "", F.col("name")).otherwise(F.concat_ws(".", "owner", "name")).alias("owner")).distinct()
    members = facts.filter(_is("member") & (F.col("type") != "constructor")).join(windows, ["file_id", "owner"], "left_semi").join(types, ["file_id", "owner"], "left_semi")
    shown = F.when(F.col("type") == "method", F.concat("name", F.lit("()"))).otherwise(F.col("name"))
    first = members.groupBy("file_id", "owner").agg(F.min("line").alias("line"), F.count(F.lit(1)).alias("n"))
    named = members.withColumn("shown", shown).groupBy("file_id", "owner").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("line", "shown"))), lambda x: x["shown"]), 1, 3).alias("names"))
    return _rows(first.join(named, ["file_id", "owner"]), "WpfRequireMinimalCodeBehind", F.lit(True), F.concat(F.col("n").cast("string"), F.lit(": "), F.array_join("names", ", ")))


def declaration_rules(facts: DataFrame, namespaces: DataFrame, test_files: DataFrame | None = None) -> DataFrame:
    """All of them; files of test_files (file_id) are left out, but for value objects. facts are written once, as each rule reads them."""
    facts = staged(facts, "facts")
    own = facts if test_files is None else facts.join(test_files.select("file_id"), "file_id", "left_anti")
    return reduce(DataFrame.unionByName, [semantic_naming(own), endpoint_parameters(own), value_objects(facts), phantom_dependencies(own, namespaces), window_code(own)])


def generated_files(files: DataFrame) -> DataFrame:
    """file_id of files with a type that is marked as generated."""
    return files.filter(F.col("text").rlike(r"\[\s*(?:[\w.]+\.)?GeneratedCode(?:Attribute)?\s*[\](]")).select("file_id")


def duplicate_code(members: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """One row for each set of clones of the Exact bucket, at its first member by path and line: how many it has. members: a row a unit with
    root, bucket, file_id, rel_path, line. Members without a path count and are never the first; a set of none but them names no file. marks:
    file_id of files that turn the rule off; one of them turns off the whole set."""
    exact = members.filter("bucket = 'Exact'")
    if marks is not None:
        off = exact.join(marks.select("file_id").distinct(), "file_id", "left_semi").select("root").distinct()
        exact = exact.join(off, "root", "left_anti")
    first = F.min_by(F.struct("file_id", "line"), F.when(F.col("rel_path").isNotNull(), F.struct(tx.letterwise_upper(F.col("rel_path")), "line"))).alias("x")
    rows = exact.groupBy("root").agg(first, F.min("line").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.select("x.file_id", F.coalesce("x.line", "least").cast("int").alias("line"), F.lit("DuplicateCode").alias("rule"), F.concat(F.col("n").cast("string"), F.lit(" members")).alias("details"))

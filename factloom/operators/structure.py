"""Types and members: sizes, overloads, partial types, forwarding, visibility, and directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .dealing import dealt_join


def partial_totals(parts: DataFrame, most_lines: int) -> DataFrame:
    """Partial types whose parts add up to more lines than allowed. parts: type_name, path, lines."""
    return parts.groupBy("type_name").agg(F.sum("lines").alias("lines"), F.count(F.lit(1)).alias("parts")).filter(F.col("lines") > most_lines)


def partial_spread(parts: DataFrame, most_files: int) -> DataFrame:
    """Partial types over more distinct files than allowed, in either case of the path."""
    return parts.groupBy("type_name").agg(F.countDistinct(F.upper("path")).alias("files")).filter(F.col("files") > most_files)


def first_part(parts: DataFrame) -> DataFrame:
    """The part of a type with the smallest path, for each project."""
    return parts.groupBy("type_name", "project").agg(F.min("path").alias("path"))


def crowded_directories(entries: DataFrame, most: int, exempt: list[str]) -> DataFrame:
    """Directories with more children than allowed. entries: parent, child (files and directories)."""
    name = F.element_at(F.split("parent", "/"), -1)
    return entries.filter(~name.isin(exempt)).groupBy("parent").agg(F.countDistinct("child").alias("children")).filter(F.col("children") > most)


def overloads(members: DataFrame, most: int) -> DataFrame:
    """Methods with more overloads than allowed. members: type_id, name."""
    return members.groupBy("type_id", "name").agg(F.count(F.lit(1)).alias("overloads")).filter(F.col("overloads") > most)


def confusable_overloads(members: DataFrame, primitives: list[str]) -> DataFrame:
    """Pairs of overloads that differ in primitive parameter types only: those that are alike when all of these count as one. So only
    pairs that are rows of the result meet. members: member_id, type_id, name, param_types."""
    shape = F.transform("param_types", lambda t: F.when(t.isin(primitives), primitives[0] if primitives else None).otherwise(t))
    rows = members.select(F.struct("type_id", "name", shape.alias("shape")).alias("at"), "member_id")
    rows = rows.filter(F.col("at.type_id").isNotNull() & F.col("at.name").isNotNull() & F.forall("at.shape", lambda t: t.isNotNull()))
    one, two = (rows.select("at", F.col("member_id").alias(c)) for c in "ab")
    return dealt_join(one, two, "at", "a").filter("a < b").select("at.type_id", "at.name", "a", "b")


def middle_men(members: DataFrame, share: float = 0.60, least: int = 5) -> DataFrame:
    """Types with at least `least` members, more than the share of which only pass a call on. members: type_id, forwards."""
    rows = members.groupBy("type_id").agg(F.count(F.lit(1)).alias("members"), F.count_if("forwards").alias("forwarders"))
    return rows.filter(F.col("members") >= least).withColumn("share", F.col("forwarders") / F.col("members")).filter(F.col("share") > share)


def member_counts(members: DataFrame) -> DataFrame:
    """Public members, constructors' most parameters, and boolean parameters of each type."""
    flags = F.size(F.filter("param_types", lambda t: t.isin("bool", "bool?")))
    return members.groupBy("type_id").agg(F.count_if(F.col("visibility") == "public").alias("public_members"), F.coalesce(F.max(F.when(F.col("kind") == "constructor", F.size("param_types"))), F.lit(0)).alias("dependencies"), F.max(flags).alias("bool_params"))


def cyclomatic(nodes: DataFrame, initialisers: DataFrame | None = None) -> DataFrame:
    """1 and a point for each branching node of a member; 1 for a member that only dispatches. nodes: member_id, kind. initialisers:
    member_id of members that only fill an object with values or their defaults; their `??` and choices give no points."""
    if initialisers is not None:
        marked = nodes.join(initialisers.select("member_id").distinct().withColumn("fills", F.lit(True)), "member_id", "left")
        nodes = marked.withColumn("kind", F.when(F.col("fills") & F.col("kind").isin("coalesce", "conditional"), "none").otherwise(F.col("kind")))
    branching = ["if", "while", "do", "for", "foreach", "catch", "conditional", "case", "arm", "and", "or", "coalesce"]
    return nodes.groupBy("member_id").agg((F.count_if(F.col("kind").isin(branching)) + 1).alias("points"), F.max(F.col("kind") == "dispatcher").alias("dispatcher")).select("member_id", F.when(F.col("dispatcher"), 1).otherwise(F.col("points")).alias("cyclomatic"))


def cognitive(nodes: DataFrame) -> DataFrame:
    """Points of nesting nodes grow with their depth; a run of one logical operator is a point. nodes: member_id, ord, kind,
    nesting."""
    nests = ["if", "while", "do", "for", "foreach", "catch", "conditional", "switch"]
    w = Window.partitionBy("member_id").orderBy("ord")
    logical = F.col("kind").isin("and", "or")
    run = logical & ~F.coalesce(F.lag("kind").over(w) == F.col("kind"), F.lit(False))
    points = F.when(F.col("kind").isin(nests), 1 + F.col("nesting")).when(F.col("kind") == "else", 1).when(run, 1).otherwise(0)
    return nodes.withColumn("points", points).groupBy("member_id").agg(F.sum("points").alias("cognitive"))


def code_lines(tokens: DataFrame) -> DataFrame:
    """Distinct lines that a token of the member starts on."""
    return tokens.groupBy("member_id").agg(F.countDistinct("line").alias("code_lines"))


def class_structure(members: DataFrame, order: str = "lines", most: int = 50) -> DataFrame:
    """Members by place, kind or name, those without one last; at most 200 are listed. Members alike in these are in the order of the others,
    so that the same ones are listed however the rows are dealt."""
    keys = {"lines": ["file_id", "start_line", "kind", "name"], "kind": ["kind", "name", "file_id", "start_line"], "name": ["name", "start_line", "file_id", "kind"]}[order]
    return members.orderBy(*(F.asc_nulls_last(k) for k in keys if k in members.columns)).limit(min(most, 200))


def skeleton(members: DataFrame, public_only: bool) -> DataFrame:
    rows = members.filter(F.col("visibility") == "public") if public_only else members
    return rows.select("file_id", "start_line", "kind", "visibility", "name").orderBy("file_id", "start_line")


def find_symbols(symbols: DataFrame, part: str, kind: str | None = None, most: int = 50) -> DataFrame:
    """Symbols whose name holds the text, in either case, of a kind if one is named."""
    rows = symbols.filter(F.contains(F.upper("name"), F.upper(F.lit(part))))
    return (rows.filter(F.col("kind") == kind) if kind else rows).orderBy(F.upper("name"), "symbol_id").limit(most)


def registrations(files: DataFrame, types: DataFrame, most: int = 20) -> DataFrame:
    """Types named in service registrations, with the kind of registration. types: name. The cap is the report's length."""
    call = r"Add(Scoped|Singleton|Transient)<\s*([\w.]+)(?:\s*,\s*([\w.]+))?\s*>"
    hits = files.select("file_id", F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(call), F.lit(1)).alias("life"), F.regexp_extract_all("text", F.lit(call), F.lit(2)).alias("service"), F.regexp_extract_all("text", F.lit(call), F.lit(3)).alias("impl"))).alias("r"))
    rows = hits.select("file_id", "r.life", F.explode(F.array("r.service", "r.impl")).alias("name")).filter("name <> ''")
    return rows.join(types.select("name").distinct(), "name", "left_semi").orderBy("name", "file_id").limit(most)


def companions_missing(files: DataFrame, extension: str, companion: str) -> DataFrame:
    """Files of an extension without the companion file of the same name, such as .razor and .razor.cs."""
    own = files.filter(F.endswith(F.lower("path"), F.lit(extension))).select("path", F.lower(F.concat("path", F.lit(companion))).alias("wanted"))
    return own.join(files.select(F.lower("path").alias("wanted")), "wanted", "left_anti").select("path")

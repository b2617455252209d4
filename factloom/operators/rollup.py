"""Rollups over directories, folders, namespaces and projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def upper_median(column: str) -> Column:
    """The middle value of whole numbers, the upper one of two. It is kept as counts of distinct values, not as a list of rows."""
    return (-F.expr(f"percentile_disc(0.5) within group (order by -{column})")).cast("long")


def tree(metrics: DataFrame, depth: int, sums: list[str], peaks: list[str], path: str = "path") -> DataFrame:
    """Each directory prefix down to a depth: items, sums of additive metrics, largest of the others. '' is the whole."""
    rows = metrics.withColumn("prefix", F.explode(paths.prefixes(F.col(path), depth)))
    return rows.groupBy("prefix").agg(F.count(F.lit(1)).alias("items"), *(F.sum(c).alias(c) for c in sums), *(F.max(c).alias(f"max_{c}") for c in peaks))


def slices(files: DataFrame, flag: str, most: int = 5, segments: int = 2) -> DataFrame:
    """The largest folder slices: files, upper median of lines, and flagged files."""
    key = paths.slice_key(F.col("path"), segments)
    return files.groupBy(key.alias("slice")).agg(F.count(F.lit(1)).alias("files"), upper_median("lines").alias("median_lines"), F.count_if(flag).alias("flagged")).orderBy(F.desc("files"), "slice").limit(most)


def kinds(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Files of each expected extension, also where there are none, and of any other."""
    n = files.groupBy("ext").agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(expected), "ext", "full_outer").select("ext", F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.desc("n"), "ext")


def folder_debt(files: DataFrame, most: int = 3) -> DataFrame:
    """Folders by flagged files, and the share of files that are clean."""
    rows = files.groupBy("folder").agg(F.count_if("flagged").alias("flagged"), F.count(F.lit(1)).alias("files"))
    clean = F.bround(100.0 * (F.col("files") - F.col("flagged")) / F.col("files"), 1)
    return rows.withColumn("clean_percent", clean).orderBy(F.desc("flagged"), "folder").limit(most)


def marks_by_file(marks: DataFrame) -> DataFrame:
    return marks.groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_set("rule")), ", ").alias("rules"))


def intents(found: DataFrame) -> DataFrame:
    return found.groupBy("intent").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("rule")), ", ").alias("rules")).orderBy(F.desc("n"), "intent")


def namespaces(types: DataFrame, depth: int) -> DataFrame:
    """Each namespace prefix down to a depth, with its types and those of namespaces below it."""
    rows = types.withColumn("prefix", F.explode(paths.prefixes(F.concat(F.translate("namespace", ".", "/"), F.lit("/x")), depth)))
    return rows.filter("prefix <> ''").groupBy(F.translate("prefix", "/", ".").alias("namespace")).agg(F.count(F.lit(1)).alias("types"), F.countDistinct("project").alias("projects"))


def collapsed_namespaces(tree: DataFrame) -> DataFrame:
    """namespaces() without the links of a chain: a namespace whose types are all those of its only child goes, and the child's label
    begins at the last one that stays. tree: namespace, types, ...; adds label, what is shown under the nearest one that stays."""
    parts = F.split("namespace", r"\.")
    parent = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "."))
    rows = tree.withColumn("parent", parent)
    below = rows.filter("parent is not null").groupBy(F.col("parent").alias("of")).agg(F.count(F.lit(1)).alias("children"), F.sum("types").alias("below"))
    marked = rows.join(below, F.col("namespace") == F.col("of"), "left").withColumn("goes", F.coalesce((F.col("children") == 1) & (F.col("below") == F.col("types")), F.lit(False)))
    stays = marked.filter("not goes")
    # the nearest namespace above that stays, by an equi-join on each prefix
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    up = stays.filter(F.size(parts) > 1).select("namespace", F.explode(above).alias("up")).join(stays.select(F.col("namespace").alias("up")), "up").groupBy("namespace").agg(F.max_by("up", F.length("up")).alias("up"))
    label = F.when(F.col("up").isNull(), F.col("namespace")).otherwise(F.substring(F.col("namespace"), F.length("up") + 2, F.length("namespace")))
    return stays.join(up, "namespace", "left").select(*tree.columns, label.alias("label"))


def project_overview(types: DataFrame) -> DataFrame:
    return types.groupBy("project").agg(F.countDistinct("namespace").alias("namespaces"), F.count(F.lit(1)).alias("types"))


def hotspots(files: DataFrame, limit: int, level: Column) -> DataFrame:
    """Files at 80 percent of the line limit or more, longest first."""
    use = files.withColumn("utilisation", F.bround(100.0 * F.col("lines") / limit, 1)).filter("utilisation >= 80")
    return use.withColumn("level", level).orderBy(F.desc("lines"), F.upper("path"))


def owning_project(files: DataFrame, projects: DataFrame) -> DataFrame:
    """files with the project of the longest directory that holds them. Joined on every directory prefix of a path, so it is
    an equi-join and no path meets every project."""
    rows = files.withColumn("prefix", F.explode(paths.prefixes(F.col("path"), F.size(F.split("path", "/")))))
    hit = rows.join(projects.select(F.col("dir").alias("prefix"), "project"), "prefix")
    best = hit.groupBy("path").agg(F.max_by("project", F.struct(F.length("prefix"), "project")).alias("project"))
    return files.join(best, "path", "left")


def first_override(files: DataFrame, overrides: list[tuple[str, str]]) -> DataFrame:
    """files with the value of the first glob that matches; overrides: (glob, value), compiled into one expression."""
    value = F.lit(None).cast("string")
    for pattern, own in reversed(overrides):
        value = F.when(F.col("path").rlike(paths.glob_regex(pattern, True)), own).otherwise(value)
    return files.withColumn("override", value)

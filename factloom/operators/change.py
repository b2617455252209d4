"""Change against a stored baseline, and incremental work."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def compare(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(path, status, old_path) of paths that differ: changed, removed, new, renamed. stored, current: path, sha256.

    A rename takes the first removed stored path of a hash and the first new path of it; other paths of the hash are removed
    or new. If the first stored path of the hash is still there, none of its copies counts as renamed."""
    both = stored.select("path", F.col("sha256").alias("was")).join(current.select("path", F.col("sha256").alias("now")), "path", "full_outer")
    changed = both.filter("was is not null and now is not null and was <> now").select("path", F.lit("changed").alias("status"), F.lit(None).cast("string").alias("old_path"))
    removed, fresh = both.filter("now is null").select("path", "was"), both.filter("was is null").select("path", "now")
    first_stored = stored.groupBy(F.col("sha256").alias("was")).agg(F.min("path").alias("old_path"))
    sources = first_stored.join(removed.select(F.col("path").alias("old_path")), "old_path", "left_semi")
    targets = fresh.groupBy("now").agg(F.min("path").alias("path"))
    renames = sources.join(targets, F.col("was") == F.col("now")).select("path", F.lit("renamed").alias("status"), "old_path")
    gone = removed.join(renames.select(F.col("old_path").alias("path")), "path", "left_anti").select("path", F.lit("removed").alias("status"), F.lit(None).cast("string").alias("old_path"))
    new = fresh.join(renames.select("path"), "path", "left_anti").select("path", F.lit("new").alias("status"), F.lit(None).cast("string").alias("old_path"))
    return changed.unionByName(renames).unionByName(gone).unionByName(new)


def ratchet(found: DataFrame, differences: DataFrame) -> DataFrame:
    """Violations in changed, new and renamed files only; nothing where nothing changed."""
    paths = differences.filter("status <> 'removed'").select("path").distinct()
    return found.join(paths, "path", "left_semi")


def pending(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files without a cached result for their path, content and configuration; the key holds the configuration, so a cached
    result is never reused under another."""
    return files.join(cache.select("path", "sha256", "config_hash"), ["path", "sha256", "config_hash"], "left_anti")


def refreshed(cache: DataFrame, results: DataFrame, files: DataFrame) -> DataFrame:
    """The cache after a run: new results over old ones, and only of files that are there."""
    w = Window.partitionBy("path", "config_hash").orderBy(F.desc("fresh"))
    rows = cache.withColumn("fresh", F.lit(0)).unionByName(results.withColumn("fresh", F.lit(1)))
    last = rows.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn", "fresh")
    return last.join(files.select("path", "sha256"), ["path", "sha256"], "left_semi")

"""Sources and sinks: file trees, logs, baselines, diffs and configuration."""

from __future__ import annotations

import json
import subprocess
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions import text as tx
from ..operators.rollup import owning_project


def distinct_roots(roots: list[str]) -> list[str]:
    """Roots that don't lie in another one."""
    found: list[PurePosixPath] = []
    for root in sorted({PurePosixPath(r) for r in roots}, key=lambda p: (len(p.parts), str(p))):
        if not any(root.is_relative_to(r) for r in found):
            found.append(root)
    return [str(r) for r in found]


def source_files(spark: SparkSession, roots: list[str], pattern: str = "*", projects: DataFrame | None = None, keep_generated: bool = False) -> DataFrame:
    """source_file facts of file trees; unreadable files are skipped by Spark's own setting. projects: dir, project."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(distinct_roots(roots))
    rows = raw.select(
        F.xxhash64("path").alias("file_id"), paths.normal_path(F.col("path")).alias("path"), F.regexp_extract("path", r"(\.[^./]+)$", 1).alias("ext"), F.when(~looks_binary(F.col("content")), F.decode("content", "UTF-8")).alias("text"),
        F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("mtime"),
    )
    rows = rows.withColumn("is_generated", paths.is_generated_path(F.col("path"))).withColumn("is_test", paths.is_test_path(F.col("path")))
    rows = rows if keep_generated else rows.filter("not is_generated")
    rows = owning_project(rows, projects) if projects is not None else rows.withColumn("project", F.lit(None).cast("string"))
    return rows.withColumnRenamed("path", "rel_path")


def looks_binary(content):
    """A zero byte among the first 4096, unless a UTF-16 mark starts the file."""
    head = F.hex(F.substring(content, 1, 4096))
    marked = F.startswith(head, F.lit("FFFE")) | F.startswith(head, F.lit("FEFF"))
    return head.rlike("^(..)*00") & ~marked


def log_lines(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """(log_file, line_no, value) of JSON-lines files, folders or globs; feedback logs and blank lines are left out.

    A large file is split by byte ranges at line ends, so that one log is read by many tasks. Within a range the reader's row ids are
    consecutive; a row a range, with its first id and number of lines, gives each range the lines before it. A last line without an
    end is a line like any other; what is torn in it is for the parser to tell."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path)
    at = F.monotonically_increasing_id().alias("at")
    lines = raw.select("value", F.col("_metadata.file_path").alias("log_file"), F.col("_metadata.file_block_start").alias("range_start"), at)
    lines = lines.filter(~F.endswith("log_file", F.lit(".feedback.jsonl")))
    ranges = lines.groupBy("log_file", "range_start").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("log_file").orderBy("range_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("log_file", "range_start", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return lines.filter(F.trim("value") != "").join(offsets, ["log_file", "range_start"]).select("log_file", (F.col("at") + F.col("shift") + 1).alias("line_no"), "value")


def tool_calls(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """tool_call facts, and (log_file, invalid, ignored) counts. A property of the wrong type counts as missing."""
    parsed = lines.withColumn("v", F.try_parse_json("value"))
    get = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind)
    rows = parsed.withColumn("record", get("recordType", "string")).withColumn("ok", F.col("v").isNotNull() & F.startswith(F.ltrim("value"), F.lit("{")))
    counts = rows.groupBy("log_file").agg(F.count_if(~F.col("ok")).alias("invalid"), F.count_if(F.col("ok") & (F.coalesce("record", F.lit("")) != "tool_call")).alias("ignored"))
    success, is_error = F.coalesce(get("success", "boolean"), F.lit(True)), F.coalesce(get("isErrorResult", "boolean"), F.lit(False))
    response, message = get("response", "string"), get("errorMessage", "string")
    truncated = F.coalesce(get("responseTruncated", "boolean"), F.lit(False))
    code = tx.error_code(response, message, success, is_error)
    calls = rows.filter(F.col("ok") & (F.col("record") == "tool_call")).select(
        "log_file", "line_no", F.try_to_timestamp(get("timestamp", "string")).alias("ts"), F.coalesce(get("toolName", "string"), F.lit("")).alias("tool"), F.coalesce(get("processId", "long"), F.lit(0)).alias("pid"), get("instanceId", "string").alias("instance_id"),
        F.coalesce(get("durationMs", "long"), F.lit(0)).alias("duration_ms"), (~success | is_error).alias("is_error"), code.alias("error_code"), truncated.alias("truncated"), tx.completeness(response, truncated).alias("completeness"),
        F.contains(F.lower(F.coalesce(response, F.lit(""))), F.lit("loading")).alias("is_loading"),
    )
    return calls, counts


def checksums(files: DataFrame) -> DataFrame:
    return files.select(F.col("rel_path").alias("path"), "sha256")


def write_baseline(checks: DataFrame, path: str) -> None:
    checks.select("path", "sha256").write.mode("overwrite").parquet(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("path string, sha256 string").parquet(path)


def git_diff(spark: SparkSession, repository: str, ref: str | None = None, pattern: str = "*.cs") -> DataFrame:
    """(diff_id, line_no, line) of a zero-context diff."""
    command = ["git", "-C", repository, "diff", "-U0", *([ref] if ref else []), "--", pattern]
    out = subprocess.run(command, capture_output=True, text=True, check=True).stdout
    return spark.createDataFrame([(1, i, line) for i, line in enumerate(out.split("\n"), 1)], "diff_id long, line_no long, line string")


def load_config(text: str | None, defaults: dict) -> dict:
    """Defaults with a JSON text over them, level by level; an unknown key is kept, a null takes the default."""

    def merge(base: dict, own: dict) -> dict:
        out = dict(base)
        for k, v in own.items():
            out[k] = merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else base.get(k) if v is None else v
        return out

    return merge(defaults, json.loads(text) if text else {})

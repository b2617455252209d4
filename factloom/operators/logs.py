"""Tool-call log analysis. Input: tool_call facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A call belongs to a burst if it follows the one before within this many seconds.
BURST_SECONDS = 5


def count_by(calls: DataFrame, key: str) -> DataFrame:
    """Calls of each value of key, nulls left out, in key order."""
    return calls.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(key)


def report(calls: DataFrame) -> DataFrame:
    """One row of totals; the error rate of no calls is 0."""
    n = F.count(F.lit(1))
    errors = F.count_if("is_error")
    return calls.agg(
        n.alias("calls"), F.countDistinct(F.upper("log_file")).alias("logs"), errors.alias("errors"), F.coalesce(F.try_divide(errors, n), F.lit(0.0)).alias("error_rate"), F.count_if("truncated").alias("truncated"),
        *(F.count_if(F.col("completeness") == k).alias(f"n_{k}") for k in ("complete", "truncated", "unknown")),
    )


def health(calls: DataFrame) -> DataFrame:
    """Calls and errors of each tool, and when it was last called."""
    return calls.groupBy("tool").agg(F.count(F.lit(1)).alias("calls"), F.count_if("is_error").alias("errors"), F.max("ts").alias("last_ts")).orderBy("tool")


def _place() -> Column:
    """Order of calls in a log: by time, those without one last, then by line."""
    return F.struct(F.coalesce(F.unix_micros("ts"), F.lit(2**62)).alias("ts"), F.col("line_no"))


def sessions(calls: DataFrame) -> DataFrame:
    """A row for each log, in either case of its name: span, totals, the first call's process, and the tools in order."""
    ordered = F.array_sort(F.collect_list(F.struct(_place().alias("at"), F.col("tool").alias("tool"))))
    return (
        calls.groupBy(F.upper("log_file").alias("log_key"))
        .agg(
            F.min_by("log_file", _place()).alias("log_file"), F.count(F.lit(1)).alias("calls"), F.count_if("is_error").alias("errors"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
            F.sum("duration_ms").alias("duration_ms"), F.min_by("pid", _place()).alias("pid"), F.min_by("instance_id", _place()).alias("instance_id"), F.transform(ordered, lambda x: x["tool"]).alias("tools"),
        )
        .withColumn("seconds", F.greatest(F.lit(0.0), F.coalesce(F.unix_micros(F.col("last_ts")) - F.unix_micros(F.col("first_ts")), F.lit(0)) / 1e6))
        .drop("log_key")
    )


def bursts(calls: DataFrame, seconds: float = BURST_SECONDS) -> DataFrame:
    """A row for each run of two or more calls of one tool that were all answered by "loading", each within the window of the
    one before. Any other call between two ends the run."""
    w = Window.partitionBy(F.upper("log_file")).orderBy(F.col("ts").asc_nulls_last(), "line_no")
    gap = (F.unix_micros(F.col("ts")) - F.unix_micros(F.lag("ts").over(w))) / 1e6
    goes_on = F.col("is_loading") & F.lag("is_loading").over(w) & (F.col("tool") == F.lag("tool").over(w)) & gap.between(0, seconds)
    marked = calls.withColumn("fresh", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    islands = marked.withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = islands.groupBy(F.upper("log_file").alias("log_key"), "island").agg(F.min_by("log_file", _place()).alias("log_file"), F.min_by("tool", _place()).alias("tool"), F.count(F.lit(1)).alias("calls"), F.min("ts").alias("first_ts"))
    return runs.filter("calls >= 2").select("log_file", "tool", "calls", "first_ts")


def burst_totals(calls: DataFrame, seconds: float = BURST_SECONDS) -> DataFrame:
    return bursts(calls, seconds).agg(F.count(F.lit(1)).alias("bursts"), F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"))

"""Structured Streaming: following a folder of files, and retry bursts over a stream of calls."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..facts import ddl


def call_stream(spark: SparkSession, folder: str) -> DataFrame:
    """tool_call facts as they are written to a folder of JSON lines."""
    return spark.readStream.schema(ddl("tool_call")).json(folder)


def file_stream(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Changed and new files of a folder tree: path, sha256, text."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return raw.select("path", F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("text"))


def upsert(table: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the Parquet table at a path, with the batch's rows in place of those of their paths. The new version
    is written beside the old one before that goes, so a failure leaves one of them whole; one that was written to its end but
    not yet put in place is put there first."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        jvm = spark._jvm
        base = jvm.org.apache.hadoop.fs.Path(table)
        fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
        rows = batch.dropDuplicates(["path"])
        if not fs.exists(base):
            found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{table}.next-*")) or []
            for left in sorted(found, key=lambda f: -int(f.getPath().getName().rpartition("-")[2])):
                if fs.exists(jvm.org.apache.hadoop.fs.Path(left.getPath(), "_SUCCESS")):
                    fs.rename(left.getPath(), base)
                    break
        if fs.exists(base):
            old = spark.read.parquet(table)
            rows = old.join(rows.select("path"), "path", "left_anti").select(rows.columns).unionByName(rows)
        fresh = f"{table}.next-{number}"
        rows.write.mode("overwrite").parquet(fresh)
        if fs.exists(base):
            fs.delete(base, True)
        fs.rename(jvm.org.apache.hadoop.fs.Path(fresh), base)

    return merge


def windowed_counts(calls: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Calls and errors of each tool in tumbling windows; late calls are counted up to the watermark."""
    return calls.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "tool").agg(F.count(F.lit(1)).alias("calls"), F.count_if("is_error").alias("errors")).select("w.start", "w.end", "tool", "calls", "errors")


def stream_bursts(calls: DataFrame, seconds: float = 5.0, late: str = "10 minutes") -> DataFrame:
    """Retry bursts of each log, reported when a later call has ended them or no call came within the watermark. The state of
    a log is its open run: tool, last time, calls."""
    output = "log_file string, tool string, calls long"

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tool, last, n = state.get if state.exists else (None, 0.0, 0)
        done = []
        if state.hasTimedOut:
            if n >= 2:
                done.append((key[0], tool, n))
            state.remove()
        else:
            # calls without a time belong to no run
            rows = pd.concat(list(batches)).dropna(subset=["ts"]).sort_values(["ts", "line_no"])
            for r in rows.itertuples():
                at = r.ts.timestamp()
                if r.is_loading and n and r.tool == tool and 0 <= at - last <= seconds:
                    last, n = at, n + 1
                    continue
                if n >= 2:
                    done.append((key[0], tool, n))
                tool, last, n = (r.tool, at, 1) if r.is_loading else (None, at, 0)
            state.update((tool, last, n))
            state.setTimeoutTimestamp(max(int(last * 1000) + int(seconds * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(done, columns=["log_file", "tool", "calls"])

    marked = calls.withWatermark("ts", late).groupBy("log_file")
    return marked.applyInPandasWithState(follow, output, "tool string, last double, n long", "append", GroupStateTimeout.EventTimeTimeout)

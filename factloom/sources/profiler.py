"""What a pipeline's steps cost: observed metrics of named steps, kept as JSON lines that the log reader reads back."""

from __future__ import annotations

import json
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .files import log_lines


class Profiler:
    """Steps of one run, written to a folder that driver and executors share: a file a run. A step's rows and measures are observed
    while it runs, so that nothing is computed twice."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.run = spark, folder.rstrip("/"), uuid.uuid4().hex
        self.lines: list[str] = []
        self._seen: list[tuple[str, Observation]] = []

    def watch(self, name: str, df: DataFrame, **measures) -> DataFrame:
        """df, whose rows and measures (aggregates) are taken down when the step that runs it ends."""
        seen = Observation(f"{name}-{uuid.uuid4().hex[:8]}")
        self._seen.append((name, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in measures.items()))

    @contextmanager
    def step(self, name: str):
        """A named step: an action on watched frames belongs in it. Steps that fail are written with their error."""
        self._seen, began, error = [], time.perf_counter(), None
        try:
            yield self
        except Exception as e:
            error = type(e).__name__
            raise
        finally:
            took = time.perf_counter() - began
            metrics = {} if error else {n: seen.get for n, seen in self._seen}
            self.lines.append(json.dumps({"recordType": "step", "run": self.run, "step": name, "order": len(self.lines), "durationMs": int(took * 1000), "error": error, "rows": sum(m["rows"] for m in metrics.values()), "metrics": metrics}, default=str))

    def close(self) -> str:
        """Write the run's lines; a line is written whole or not at all."""
        path = f"{self.folder}/{self.run}.jsonl"
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        draft = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/.{self.run}")
        stream = fs.create(draft, True)
        try:
            stream.write(bytearray("".join(x + "\n" for x in self.lines).encode()))
        finally:
            stream.close()
        fs.rename(draft, target)
        return path


def steps(spark: SparkSession, folder: str) -> DataFrame:
    """run, step, order, duration_ms, rows, error of all runs in a folder; other records are left out."""
    v = F.try_parse_json("value")
    get = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind)
    rows = log_lines(spark, folder).withColumn("v", v).filter(get("recordType", "string") == "step")
    return rows.select(get("run", "string").alias("run"), get("step", "string").alias("step"), get("order", "long").alias("order"), get("durationMs", "long").alias("duration_ms"), get("rows", "long").alias("rows"), get("error", "string").alias("error"))


def slowest(found: DataFrame, most: int = 20) -> DataFrame:
    """The steps that took longest over all runs: calls, total and longest time, rows."""
    rows = found.groupBy("step").agg(F.count(F.lit(1)).alias("calls"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("longest_ms"), F.sum("rows").alias("rows"), F.count("error").alias("errors"))
    return rows.orderBy(F.desc("total_ms"), "step").limit(most)

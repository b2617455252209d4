"""Intervals of lines within a path, by sweeps over sorted ends in place of joins between intervals.

Every sweep sorts a path's rows once and looks at each row once: what overlaps is told by the furthest end so far, what is nested
by the nearest end so far, and the innermost interval by a stack of those that are open."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlapping(intervals: DataFrame, ranges: DataFrame) -> DataFrame:
    """The distinct intervals (symbol_id, path, d_lo, d_hi) that overlap a range (path, c_lo, c_hi) of their path: the furthest end of all
    ranges that begin by the interval's end reaches its beginning."""
    own = intervals.select("path", F.col("d_hi").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("reach"), "symbol_id", "d_lo", "d_hi")
    none = [F.lit(None).cast(t).alias(c) for c, t in intervals.dtypes if c in ("symbol_id", "d_lo", "d_hi")]
    told = ranges.filter("c_lo <= c_hi").groupBy("path", "c_lo").agg(F.max("c_hi").cast("long").alias("reach")).select("path", F.col("c_lo").alias("at"), F.lit(0).alias("kind"), "reach", *none)
    so_far = Window.partitionBy("path").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return own.unionByName(told).withColumn("furthest", F.max("reach").over(so_far)).filter("kind = 1 and furthest >= d_lo").select("symbol_id", "path", "d_lo", "d_hi").distinct()


def without_outer(intervals: DataFrame) -> DataFrame:
    """The intervals (path, d_lo, d_hi and others) that hold no other interval of their path than their equals: those that begin later, or
    with it and end earlier, all end later."""
    distinct = intervals.select("path", "d_lo", "d_hi").distinct()
    later = Window.partitionBy("path").orderBy(F.desc("d_lo"), "d_hi").rowsBetween(Window.unboundedPreceding, -1)
    inner = distinct.withColumn("nearest", F.min("d_hi").over(later)).filter("nearest is null or nearest > d_hi").drop("nearest")
    return intervals.join(inner, ["path", "d_lo", "d_hi"], "left_semi").select(intervals.columns)


def open_depth(intervals: DataFrame) -> DataFrame:
    """path, d_lo, d_hi, depth of distinct intervals that don't cross: how many are open where each begins, itself counted. Begins and ends are
    counted along the path; of those that begin together the longest is the outermost."""
    each = intervals.select("path", "d_lo", "d_hi").distinct()
    begins = each.select("path", "d_lo", "d_hi", F.col("d_lo").alias("at"), F.lit(1).alias("step"))
    ends = each.select("path", F.lit(None).cast("long").alias("d_lo"), F.lit(None).cast("long").alias("d_hi"), (F.col("d_hi") + 1).alias("at"), F.lit(-1).alias("step"))
    so_far = Window.partitionBy("path").orderBy("at", "step", F.desc("d_hi")).rowsBetween(Window.unboundedPreceding, 0)
    return begins.unionByName(ends).withColumn("depth", F.sum("step").over(so_far)).filter("step = 1").select("path", "d_lo", "d_hi", "depth")


def innermost(points: DataFrame, intervals: DataFrame, key: str = "point_id") -> DataFrame:
    """key, symbol_id, depth: the innermost interval around each point (key, path, line), the one that begins last and of these ends first
    (ties: the least symbol_id), and how many are open there; points in no interval have a null symbol and depth 0.
    intervals: symbol_id (long), path, d_lo, d_hi.

    A path's ends are sorted and read as a stream. Open intervals are on a stack by their beginning; as lines only go up, one that
    has ended is never looked at again. What is held is the stack."""
    begins = intervals.select("path", F.col("d_lo").cast("long").alias("line"), F.lit(0).alias("kind"), F.col("d_hi").cast("long").alias("until"), F.col("symbol_id").cast("long").alias("id"))
    asked = points.select("path", F.col("line").cast("long").alias("line"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("until"), F.col(key).cast("long").alias("id"))
    rows = begins.unionByName(asked).repartition("path").sortWithinPartitions("path", "line", "kind", F.desc("until"), F.desc("id"))
    # how many are open is counted by begins and ends alone
    ends = begins.select("path", (F.col("until") + 1).alias("line"), F.lit(-1).alias("step")).unionByName(begins.select("path", "line", F.lit(1).alias("step")))
    steps = ends.groupBy("path", "line").agg(F.sum("step").alias("step")).withColumn("kind", F.lit(0))
    counted = steps.unionByName(asked.select("path", "line", "kind", "id"), allowMissingColumns=True)
    so_far = Window.partitionBy("path").orderBy("line", "kind").rowsBetween(Window.unboundedPreceding, 0)
    depth = counted.withColumn("depth", F.coalesce(F.sum("step").over(so_far), F.lit(0))).filter("kind = 1").select(F.col("id").alias("of"), "depth")

    def run(batches):
        now, stack = None, []
        for b in batches:
            ids, found = [], []
            for path, line, kind, until, i in zip(*(c.to_pylist() for c in b.columns)):
                if path != now:
                    now, stack = path, []
                if kind == 0:
                    stack.append((until, i))
                    continue
                while stack and stack[-1][0] < line:
                    stack.pop()
                ids.append(i)
                found.append(stack[-1][1] if stack else None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int64())], names=["point", "symbol_id"])

    owners = rows.mapInArrow(run, "point long, symbol_id long")
    return owners.join(depth, F.col("point").eqNullSafe(F.col("of"))).select(F.col("point").alias(key), "symbol_id", "depth")

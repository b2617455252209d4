"""Joins on keys of which a few may hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots in which rows are counted by hashed key, at any input size, and rows of a slot that a task takes at least.
SLOTS, LEAST = 1 << 14, 512


def hot_slots(rows: DataFrame, key: Column, least: int = LEAST) -> DataFrame:
    """slot, parts: the slots with over `least` rows, and over four times the mean of all slots; at most SLOTS rows."""
    counts = rows.groupBy(F.pmod(F.xxhash64(key), F.lit(SLOTS)).alias("slot_")).agg(F.count(F.lit(1)).alias("n"))
    mean = counts.agg((F.coalesce(F.sum("n"), F.lit(0)) / SLOTS).alias("mean"))
    most = F.greatest(F.lit(float(least)), 4 * F.col("mean"))
    return counts.crossJoin(F.broadcast(mean)).filter(F.col("n") > most).select("slot_", F.ceil(F.col("n") / most).cast("int").alias("parts_"))


def dealt_join(many: DataFrame, one: DataFrame, key: str, spread: str, counted: DataFrame | None = None, least: int = LEAST) -> DataFrame:
    """many joined with one on key. Rows of many in a hot slot are dealt over parts by the column spread, and one's rows of that
    slot are repeated for each part; the hot slots, a table of fixed size, are all that is broadcast. many is read twice, so it should be
written or cheap; counted is a cheaper table with the same keys."""
    hot = F.broadcast(hot_slots(many if counted is None else counted, F.col(key), least))
    slot = F.pmod(F.xxhash64(key), F.lit(SLOTS)).alias("slot_")
    parts = F.coalesce("parts_", F.lit(1))
    left = many.select("*", slot).join(hot, "slot_", "left").withColumn("part_", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("slot_", "parts_")
    right = one.select("*", slot).join(hot, "slot_", "left").withColumn("part_", F.explode(F.sequence(F.lit(0), parts - 1))).drop("slot_", "parts_")
    return left.join(right, [key, "part_"]).drop("part_")

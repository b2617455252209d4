"""Ranks and running sums over all rows in one order, without a window over the whole table.

Rows are dealt by ranges of the order and sorted within each range; a row's place in its range is then its place in the partition.
Ranges are cut into blocks of a fixed number of rows, whose totals are summed up block by block within a range and range by range. So
every window is over a block, over the block totals of one range, or over one row a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .similarity import _kept

#: Rows of a block.
BLOCK = 1024


def ordered(rows: DataFrame, *order: Column | str, size: Column | None = None, ranges: int | None = None) -> DataFrame:
    """rows with rank, their place in the order from 1, and used, the sum of size (1 by default) up to each of them. The order has to
    be total: where rows are equal in it, any of them may come first. ranges: how many ranges, by default one a shuffle partition."""
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    spread = rows.withColumn("size_", F.lit(1).cast("long") if size is None else size.cast("long")).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    # the upper bits are the partition, the lower ones count its rows
    at = F.monotonically_increasing_id()
    placed = spread.withColumn("at_", at).withColumn("range_", F.shiftright("at_", 33)).withColumn("block_", F.shiftright(F.col("at_").bitwiseAND(F.lit((1 << 33) - 1)), BLOCK.bit_length() - 1))
    # ranges are drawn from a sample, so they are fixed before they are read twice
    held = _kept(placed)
    blocks = held.groupBy("range_", "block_").agg(F.count(F.lit(1)).alias("n_"), F.coalesce(F.sum("size_"), F.lit(0)).alias("s_"))
    up_to = Window.partitionBy("range_").orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("range_", "block_", *(F.coalesce(F.sum(c).over(up_to), F.lit(0)).alias(f"{c}in") for c in ("n_", "s_")))
    totals = held.groupBy("range_").agg(F.count(F.lit(1)).alias("n_"), F.coalesce(F.sum("size_"), F.lit(0)).alias("s_"))
    # one row a range
    all_before = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("range_", *(F.coalesce(F.sum(c).over(all_before), F.lit(0)).alias(f"{c}before") for c in ("n_", "s_")))
    offsets = blocks.join(F.broadcast(totals), "range_")
    within = Window.partitionBy("range_", "block_").orderBy("at_").rowsBetween(Window.unboundedPreceding, 0)
    local = held.withColumn("i_", F.row_number().over(within)).withColumn("u_", F.coalesce(F.sum("size_").over(within), F.lit(0)))
    out = local.join(offsets, ["range_", "block_"])
    return out.select(*rows.columns, (F.col("n_before") + F.col("n_in") + F.col("i_")).alias("rank"), (F.col("s_before") + F.col("s_in") + F.col("u_")).alias("used"))


def interleaved(first: DataFrame, second: DataFrame, *order: Column | str) -> DataFrame:
    """Rows of two ordered lists in turn: turn (from 1) and side (0, 1) give the order, which is left to the reader to sort by."""
    one, two = (ordered(t, *order).drop("used").withColumnRenamed("rank", "turn").withColumn("side", F.lit(i)) for i, t in enumerate((first, second)))
    return one.unionByName(two)

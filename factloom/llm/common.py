"""What the text operators share: inputs, shared scratch tables and the checkpoint folder."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Hashable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting for removing a query's shuffle files as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. A machine's own folder is set only where there is none and
    executors are threads of the driver (tests); on a cluster a missing setting is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        base = context.getCheckpointDir()
        if not base:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="factloom-"))
            base = context.getCheckpointDir()
    return base.rstrip("/")


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Write df once as Parquet under the shared folder and return the written rows.

    It cuts lineage as checkpoint() does, but stays columnar: readers prune columns, and a lost executor costs no
    recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{label}-{uuid.uuid4().hex}"
    was = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a stage_table() that is read no more."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Slots in which the rows of keys are counted, at any input size, and rows of a key that a task takes at least.
SLOTS, GROUP = 1 << 16, 128


def salted(many: DataFrame, one: DataFrame, key: str, spread: str, n: int, counted: DataFrame | None = None) -> DataFrame:
    """many, a table of n rows, joined with one on key, where a few keys may have most of many's rows.

    Rows of many are counted by hashed key in SLOTS slots. A slot with over GROUP rows, and over four times its share, is dealt
    over several parts by the column spread, and one's rows of that slot are repeated for each part. The counts, at most SLOTS
    rows, are all that is broadcast; keys that share a slot with a hot one only have their row of one repeated. counted: a cheaper table with the same keys as many."""
    most = max(GROUP, 4 * n // SLOTS)
    slot = F.pmod(F.xxhash64(key), F.lit(SLOTS)).alias("slot_")
    hot = F.broadcast((many if counted is None else counted).groupBy(slot).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts_")).filter("parts_ > 1"))
    parts = F.coalesce("parts_", F.lit(1))
    dealt = many.select("*", slot).join(hot, "slot_", "left").withColumn("part_", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("slot_", "parts_")
    repeated = one.select("*", slot).join(hot, "slot_", "left").withColumn("part_", F.explode(F.sequence(F.lit(0), parts - 1))).drop("slot_", "parts_")
    return dealt.join(repeated, [key, "part_"]).drop("part_")


def bounded(df: DataFrame) -> DataFrame:
    """df, with its session's Arrow batches held to 1024 rows and 8 MB: texts are long, and an executor holds several batches
    at once, off the heap, for each task."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return df


@contextmanager
def large_batches(spark: SparkSession):
    """Arrow batches of 65,536 rows for rows of a few numbers; the session's settings are put back."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "65536")
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def small(batches, rows: int = 512):
    """Arrow batches cut into slices, so that Python holds the texts of few rows at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def in_worker(name: str, key: Hashable, make: Callable):
    """make(), kept for later tasks of the same Python worker, so that each task need not warm it up anew. A worker holds one
    object, the last asked for; what it holds is bounded by its own limits."""
    held = sys.__dict__.setdefault("_text_operators", {})
    found = held.get(name)
    if found is None or found[0] != key:
        held.clear()
        found = held[name] = (key, make())
    return found[1]


def once(name: str, make: Callable):
    """make(), kept in this process for good: for small tables of fixed size. Functions that are sent to executors by value
    can't hold them as cached functions, which pickle by reference to this package."""
    held = sys.__dict__.setdefault("_text_tables", {})
    if name not in held:
        held[name] = make()
    return held[name]

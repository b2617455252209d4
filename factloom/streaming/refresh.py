"""A table of source files that is kept up to date: buckets by path hash, versions, and a pointer that moves at once.

Each version is a manifest: the folder of each bucket, and the batch that made it. A batch writes the buckets that its paths fall
into, and no others, to a folder of its own; then the manifest is written beside the old ones and renamed into place, which is the
moment the version exists. A failure at any step before leaves the version before; the same batch may then be applied again, and a
batch that has been applied is not applied twice. A reader has the folders of one manifest and keeps reading them whatever is
applied later; vacuum() removes what no version worth keeping names."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = "path string, mtime timestamp, bytes long, sha256 string, text string"
BUCKETS = 256


@dataclass
class Version:
    number: int = 0
    #: Last batch applied, and by it.
    batch: int = -1
    #: Folder of each bucket that has rows.
    folders: dict[int, str] = field(default_factory=dict)


class FileTable:
    """A table of FIELDS at a folder that driver and executors share. buckets: fixed when the table is made."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, at_step: Callable[[str], None] | None = None):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._at_step = at_step or (lambda step: None)
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._paths(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # manifests
    def _numbers(self) -> list[int]:
        found = self._fs.globStatus(self._paths(f"{self.root}/versions/*.json")) or []
        return sorted(int(f.getPath().getName().removesuffix(".json")) for f in found)

    def version(self, number: int | None = None) -> Version:
        """The last version, or one by its number."""
        numbers = self._numbers()
        if number is None and not numbers:
            return Version()
        number = numbers[-1] if number is None else number
        stream = self._fs.open(self._paths(f"{self.root}/versions/{number}.json"))
        try:
            told = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        self.buckets = told["buckets"]
        return Version(number, told["batch"], {int(k): v for k, v in told["folders"].items()})

    def _publish(self, version: Version) -> None:
        """Two writers of the same number: the second finds the name taken and fails, with nothing changed."""
        target = self._paths(f"{self.root}/versions/{version.number}.json")
        draft = self._paths(f"{self.root}/versions/.{version.number}-{uuid.uuid4().hex}")
        stream = self._fs.create(draft, True)
        try:
            stream.write(bytearray(json.dumps({"buckets": self.buckets, "batch": version.batch, "folders": version.folders}).encode()))
        finally:
            stream.close()
        self._at_step("drafted")
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            raise RuntimeError(f"version {version.number} was written by someone else")

    # reading
    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, as they stay."""
        return self._rows(list(self.version(number).folders.values()))

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], FIELDS)
        return self.spark.read.schema(FIELDS).parquet(*(f"{self.root}/{x}" for x in folders))

    # writing
    def apply(self, changes: DataFrame, batch: int) -> Version:
        """The next version: changes has FIELDS and deleted. Rows with deleted go by path, others stand in place of their path's row;
        of several rows of a path the one with the latest mtime counts (a deleted one last). Also for foreachBatch."""
        now = self.version()
        if batch <= now.batch:
            return now
        last = F.max_by(F.struct(*[F.col(x.split(" ")[0]) for x in FIELDS.split(", ")], "deleted"), F.struct("mtime", F.coalesce("deleted", F.lit(False)).alias("d"), "sha256"))
        each = changes.filter("path is not null").groupBy("path").agg(last.alias("x")).select("x.*")
        marked = each.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int"))
        # at most `buckets` numbers
        touched = sorted(r["bucket"] for r in marked.select("bucket").distinct().collect())
        if not touched:
            self._publish(after := Version(now.number + 1, batch, now.folders))
            return after
        old = self._rows([now.folders[b] for b in touched if b in now.folders])
        stay = old.join(marked.select("path"), "path", "left_anti").withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int"))
        fresh = marked.filter("not coalesce(deleted, false)").drop("deleted")
        folder = f"data/{now.number + 1}-{uuid.uuid4().hex}"
        stay.unionByName(fresh).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
        self._at_step("written")
        made = {int(f.getPath().getName().removeprefix("bucket=")) for f in self._fs.globStatus(self._paths(f"{self.root}/{folder}/bucket=*")) or []}
        folders = {b: f for b, f in now.folders.items() if b not in touched} | {b: f"{folder}/bucket={b}" for b in made}
        after = Version(now.number + 1, batch, folders)
        self._publish(after)
        self._at_step("published")
        return after

    def vacuum(self, keep: int = 2) -> int:
        """Remove manifests but the last `keep`, and folders that none of these names. Readers of older versions have to be done."""
        kept = self._numbers()[-keep:]
        named = {f for n in kept for f in self.version(n).folders.values()}
        gone = 0
        for n in self._numbers()[:-keep]:
            self._fs.delete(self._paths(f"{self.root}/versions/{n}.json"), False)
        for f in self._fs.globStatus(self._paths(f"{self.root}/data/*/bucket=*")) or []:
            path = f.getPath()
            if f"data/{path.getParent().getName()}/{path.getName()}" not in named:
                self._fs.delete(path, True)
                gone += 1
        return gone


def followed(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """A stream of new and changed files of a folder tree, as changes: `.writeStream.foreachBatch(table.apply)` keeps a table up to date.
    Files that go are found by sweep()."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return raw.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("text"), F.lit(False).alias("deleted"))


def listing(spark: SparkSession, roots: list[str], pattern: str = "*") -> DataFrame:
    """path, mtime, bytes of the files below roots; contents are not read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(roots)
    return raw.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("bytes"))


def sweep(table: FileTable, roots: list[str], pattern: str = "*", projects: DataFrame | None = None) -> DataFrame:
    """The changes that bring the table up to the files below roots: files that are gone, and those that are new or whose time or size
    has changed, of which alone the contents are read; a file that was touched but has its old contents changes only its time.
    projects: dir; new files outside of every project's folder are left out."""
    spark = table.spark
    known, there = table.read().select("path", F.col("mtime").alias("known_mtime"), F.col("bytes").alias("known_bytes")), listing(spark, roots, pattern)
    both = there.join(known, "path", "full_outer")
    gone = both.filter("mtime is null").select("path", F.col("known_mtime").alias("mtime"), F.lit(0).cast("long").alias("bytes"), *(F.lit(None).cast("string").alias(c) for c in ("sha256", "text")), F.lit(True).alias("deleted"))
    due = both.filter("mtime is not null and (known_mtime is null or mtime <> known_mtime or bytes <> known_bytes)")
    if projects is not None:
        # a path's folders, each an equi-join away from being a project's
        parts = F.split("path", "/")
        dirs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
        fresh = due.filter("known_mtime is null").withColumn("dir", F.explode(dirs)).join(projects.select("dir").distinct(), "dir", "left_semi").select("path").distinct()
        due = due.filter("known_mtime is not null").select("path").unionByName(fresh)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(roots)
    new = raw.join(due.select("path"), "path", "left_semi").select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("text"), F.lit(False).alias("deleted"))
    return new.unionByName(gone)

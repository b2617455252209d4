"""Vector code compression: product codes whose codebooks come from filtering Lloyd rounds.

Each component x becomes the integer floor(256 * x), and a vector is cut into equal consecutive parts. Each part has a codebook of
whole-number entries; a vector's code is the number of the nearest entry of each part, by squared Euclidean distance, the lower
number on ties. A round replaces every entry by the componentwise floor of the mean of the parts that have it; unused ones stay.

In each round a task takes its vectors in blocks and builds a kd-tree for every part of a block: each node has its bounding box
and the count and sum of its points. The tree is walked from the root, level by level, with the entries that may still be
nearest to some point of the node: an entry goes as soon as another is nearer, or as near with a lower number, at the corner of the box
that favours it most. A node with one entry left gives it to its whole subtree, whose cached sum and count are added at once. Only the leaves
compare points one by one. All of it is whole-number arithmetic, so that ties and sums are exact and don't depend on partitions.
A task reports one sum an entry, so what the driver gets has a fixed size.

Defined results: vectors that are null or hold null or non-finite components are dropped. The length of vectors is that of the
smallest vec_id's vector whose length is a positive multiple of the parts; vectors of another length are dropped, too. Components
beyond 2^18 in size count as 2^18. Initial entries are the vectors of the smallest distinct vec_ids (null last; of rows that repeat an id,
the least vector); with fewer vectors there are fewer entries. Repeated rows are coded each. A null label is a label of its own. An empty
table gives no rows. Extra columns are ignored."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, salted, stage_table

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Scale of components, and the largest whole number of one: squared distances of parts up to 128 components then fit in a long.
SCALE, MOST = 256, 1 << 26
#: Vectors of a block, for whose parts a task builds trees at a time, and least points of a node that is split.
BLOCK, LEAF = 8192, 16


@dataclass
class KdTree:
    """A balanced tree over points. Level l has 2^l nodes, each a stretch of order; starts, boxes, sums and counts by level."""

    points: np.ndarray
    order: np.ndarray
    starts: list[np.ndarray]
    low: list[np.ndarray]
    high: list[np.ndarray]
    sums: list[np.ndarray]
    counts: list[np.ndarray]


def build(points: np.ndarray) -> KdTree:
    """Nodes are split at the median of the side on which their box is widest."""
    n = len(points)
    tree = KdTree(points, np.arange(n), [], [], [], [], [])
    level = 0
    while True:
        starts = (np.arange(1 << level) * n) >> level
        ordered = points[tree.order]
        low, high = np.minimum.reduceat(ordered, starts), np.maximum.reduceat(ordered, starts)
        counts = np.diff(np.append(starts, n))
        for held, now in ((tree.starts, starts), (tree.low, low), (tree.high, high), (tree.sums, np.add.reduceat(ordered, starts)), (tree.counts, counts)):
            held.append(now)
        if n >> (level + 1) < LEAF:
            return tree
        node = np.repeat(np.arange(1 << level), counts)
        side = (high - low).argmax(axis=1)
        tree.order = tree.order[np.lexsort((ordered[np.arange(n), side[node]], node))]
        level += 1


def _distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances (points x entries)."""
    out = np.zeros((len(points), len(entries)), np.int64)
    for d in range(points.shape[1]):
        out += (points[:, d, None] - entries[None, :, d]) ** 2
    return out


_FAR = np.iinfo(np.int64).max


def _still_nearest(low: np.ndarray, high: np.ndarray, entries: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """Which entries of open_ (nodes x entries) may be nearest to a point of each box."""
    # twice the middle keeps whole numbers; any choice of the rival is right, the nearest to the middle drops most
    middle = np.where(open_, _distances(low + high, 2 * entries), _FAR)
    rival = middle.argmin(axis=1)
    gap = np.zeros(open_.shape, np.int64)
    for d in range(entries.shape[1]):
        his = entries[rival, d][:, None]
        # the corner that is best for the entry against its rival
        corner = np.where(entries[None, :, d] > his, high[:, d, None], low[:, d, None])
        gap += (entries[None, :, d] - corner) ** 2 - (his - corner) ** 2
    beaten = (gap > 0) | ((gap == 0) & (np.arange(len(entries))[None, :] > rival[:, None]))
    return open_ & ~beaten


def assign(tree: KdTree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entry of each point, and the sum and count of each entry's points."""
    k = len(entries)
    labels = np.empty(len(tree.points), np.int64)
    sums, counts = np.zeros((k, entries.shape[1]), np.int64), np.zeros(k, np.int64)
    nodes, open_ = np.zeros(1, np.int64), np.ones((1, k), bool)
    last = len(tree.starts) - 1
    for level in range(last + 1):
        open_ = _still_nearest(tree.low[level][nodes], tree.high[level][nodes], entries, open_)
        one = open_.sum(axis=1) == 1
        whole, entry = nodes[one], open_[one].argmax(axis=1)
        np.add.at(sums, entry, tree.sums[level][whole])
        np.add.at(counts, entry, tree.counts[level][whole])
        labels[tree.order[_stretches(tree, level, whole)]] = np.repeat(entry, tree.counts[level][whole])
        nodes, open_ = nodes[~one], open_[~one]
        if not len(nodes):
            break
        if level == last:
            here = tree.order[_stretches(tree, level, nodes)]
            among = np.repeat(open_, tree.counts[level][nodes], axis=0)
            own = np.where(among, _distances(tree.points[here], entries), _FAR).argmin(axis=1)
            labels[here] = own
            np.add.at(sums, own, tree.points[here])
            counts += np.bincount(own, minlength=k)
            break
        nodes, open_ = np.concatenate([2 * nodes, 2 * nodes + 1]), np.concatenate([open_, open_])
    return labels, sums, counts


def _stretches(tree: KdTree, level: int, nodes: np.ndarray) -> np.ndarray:
    """The places in order of these nodes' points, node by node."""
    counts = tree.counts[level][nodes]
    return np.repeat(tree.starts[level][nodes] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def whole_numbers(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -MOST, MOST).astype(np.int64)


def _blocks(batches, column: str):
    """Arrow batches with the vectors of column as whole numbers, BLOCK rows at a time."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        while n >= BLOCK:
            table = pa.Table.from_batches(held)
            yield _block(table.slice(0, BLOCK), column)
            held, n = table.slice(BLOCK).to_batches(), n - BLOCK
    if n:
        yield _block(pa.Table.from_batches(held), column)


def _block(table: pa.Table, column: str) -> tuple[pa.Table, np.ndarray]:
    vectors = table.column(column).combine_chunks()
    if isinstance(vectors, pa.ChunkedArray):
        vectors = pa.concat_arrays(vectors.chunks)
    return table, whole_numbers(vectors.flatten().to_numpy(zero_copy_only=False)).reshape(table.num_rows, -1)


def kept(vectors: DataFrame, column: str = "embedding", parts: int = PARTS) -> DataFrame:
    """vec_id, label, vector: the rows that are coded."""
    rows = vectors.select("vec_id", "label", F.col(column).cast("array<double>").alias("vector"))
    fine = rows.filter(F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    sized = fine.select("vec_id", F.size("vector").alias("n")).filter((F.col("n") > 0) & (F.col("n") % parts == 0))
    first = sized.orderBy(F.col("vec_id").asc_nulls_last(), "n").first()
    return fine.filter(F.size("vector") == (first["n"] if first else -1))


def _initial(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """(parts x entries x components): the vectors of the smallest ids; a table of entries rows at most reaches the driver."""
    ids = rows.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).withColumnRenamed("vec_id", "first_id")
    mine = rows.join(F.broadcast(ids), F.col("vec_id").eqNullSafe(F.col("first_id")))
    found = mine.groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy(F.col("vec_id").asc_nulls_last()).collect()
    if not found:
        return np.zeros((parts, 0, 1), np.int64)
    return whole_numbers(np.array([r["vector"] for r in found])).reshape(len(found), parts, -1).transpose(1, 0, 2)


def _round(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The books after one round over all rows."""
    parts, k, width = books.shape

    def run(batches):
        sums, counts = np.zeros(books.shape, np.int64), np.zeros((parts, k), np.int64)
        for _, numbers in _blocks(batches, "vector"):
            cut = numbers.reshape(len(numbers), parts, width)
            for p in range(parts):
                _, s, c = assign(build(np.ascontiguousarray(cut[:, p])), books[p])
                sums[p] += s
                counts[p] += c
        part, entry = np.nonzero(counts)
        if len(part):
            yield pa.RecordBatch.from_arrays([pa.array(part * k + entry), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], names=["entry", "n", "sums"])

    told = rows.select("vector").transform(bounded).mapInArrow(run, "entry long, n long, sums array<long>")
    # one row for each component of each entry in use
    summed = told.select("entry", "n", F.posexplode("sums")).groupBy("entry", "pos").agg(F.sum("n").alias("n"), F.sum("col").alias("total")).collect()
    new = books.reshape(parts * k, width).copy()
    for r in summed:
        new[r["entry"], r["pos"]] = r["total"] // r["n"]
    return new.reshape(books.shape)


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts x entries x components) of kept() rows."""
    books = _initial(rows, parts, entries)
    for _ in range(rounds if books.size else 0):
        books = _round(rows, books)
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (one byte a part), error: a row for each of kept() rows."""
    parts, _, width = books.shape
    kinds = dict(rows.dtypes)

    def run(batches):
        for table, numbers in _blocks(batches, "vector"):
            cut = numbers.reshape(len(numbers), parts, width)
            codes, error = np.zeros((len(numbers), parts), np.uint8), np.zeros(len(numbers), np.int64)
            for p in range(parts):
                points = np.ascontiguousarray(cut[:, p])
                labels = assign(build(points), books[p])[0]
                codes[:, p] = labels
                error += ((points - books[p][labels]) ** 2).sum(axis=1)
            raw = codes.tobytes()
            code = pa.array([raw[i : i + parts] for i in range(0, len(raw), parts)], pa.binary())
            out = pa.table([table.column("vec_id"), table.column("label"), code, pa.array(error)], names=["vec_id", "label", "code", "error"])
            yield from out.combine_chunks().to_batches()

    return rows.transform(bounded).mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code binary, error long")


def decode(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """coded with approx, the vector that each code stands for."""
    parts = len(books)

    def run(batches):
        for b in batches:
            codes = np.frombuffer(b"".join(b.column(b.schema.get_field_index("code")).to_pylist()), np.uint8).reshape(b.num_rows, parts)
            near = books[np.arange(parts)[None, :], codes].reshape(b.num_rows, -1) / SCALE
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(near), pa.list_(pa.float64()))], names=[*b.schema.names, "approx"])

    return coded.transform(bounded).mapInArrow(run, ", ".join([*(f"{k} {v}" for k, v in coded.dtypes), "approx array<double>"]))


def codebook_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def code_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, code (hex), error, label_error, codebooks_sha256: train() and encode() over all rows of vectors."""
    rows = kept(vectors, column)
    books = train(rows)
    coded = stage_table(encode(rows, books).withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))), "codes")
    total = coded.groupBy("key").agg(F.sum("error").alias("label_error"))
    # a label may have most of all rows, or a row each: hot ones are dealt, none is broadcast
    both = salted(coded.withColumn("row", F.xxhash64("vec_id", "code")), total, "key", "row", coded.count())
    return both.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))

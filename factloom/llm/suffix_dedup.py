"""Suffix-array dedup of repeated 50-byte strings, by distributed prefix doubling over window minima.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller id. Places of texts are sorted by Spark
by growing prefixes: by their first 16 bytes, then by pairs of the rank so far and the name of what follows at a growing offset,
up to the 50 bytes of a window. After each sort the places are ranked anew, by where their group starts in the order, and those
in a group that only one document has are unique and drop out, so that few go on to the next offset:

1. 16 bytes. Only anchors are sorted, the places that are least in some 50-byte window by the name of their 16 bytes: equal
   windows have equal anchors, so comparing anchors (one place in 17) loses nothing.
2. Whole contexts. An anchor stands for the windows in which it is least; the bytes that these cover are its context. Anchors
   are sorted by (rank, context). Of equal contexts only the one in the smallest document goes on; the others' windows are all
   repeats.
3. 33 bytes. A window holds 17 more bytes on one side of its anchor. Anchors are sorted by (rank, name at offset -17) and by
   (rank, name at offset 16).
4. 50 bytes. The windows of what is left are sorted by (rank, name of the window).

Sorting is by ranges of keys and document, so a group of any size is spread over tasks; each task ranks its own rows, and groups
at the borders of tasks, two a task, are settled by their sums over all tasks. A group of n copies costs a row an anchor, and only
the edges of repeats are compared window by window. Names are 64-bit hashes, which count within a rank only. Each step is
written to the shared folder.

Defined results: null and empty texts have no bytes and lose none; texts under 50 bytes lose none. Rows with a null id lose
none and make no other row lose any. Rows that repeat an id count as one document: a string in both isn't in a smaller one;
a span found in either is taken from both, as far as they reach. Extra columns are ignored."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, discard, large_batches, small, stage_table

#: Length of the strings compared, and of the names of anchors.
SPAN, MER = 50, 16
#: Slices in which places are sorted, one after the other, and rows that a task sorts.
SLICES, PART = 2, 1 << 19
WIDE = SPAN - MER + 1
#: Bytes of texts that are looked at together, so that short texts share a pass and its arrays stay in the processor's cache.
TEXTS = 1 << 16

_RNG = np.random.default_rng(50)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_LEVEL = _RNG.integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_C = np.uint64(0xFF51AFD7ED558CCD)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _C
    return x ^ (x >> np.uint64(29))


def mer_ranks(raw: np.ndarray) -> np.ndarray:
    """A 64-bit name of each MER-byte string, by doubling: names of 2h bytes from pairs of names of h bytes."""
    name, h, level = _BYTE[raw], 1, 0
    while h < MER:
        name = name[:-h] * _LEVEL[level] + name[h:]
        name ^= name >> np.uint64(31)
        h, level = 2 * h, level + 1
    return name


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over each window of width items."""
    have = 1
    while 2 * have <= width:
        x = f(x[:-have], x[have:])
        have *= 2
    return f(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def anchors(name: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places whose name is least in some window of WIDE places, the first and last start of such a window, and their text. name:
    of joined texts, each of SPAN bytes at least; edge: where they start, and the end."""
    least = _slide(name, WIDE, np.minimum)
    least[(edge[1:-1, None] - np.arange(1, SPAN)).ravel()] = 0  # windows over two texts
    none = np.zeros(WIDE - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([none, least, none]), WIDE, np.maximum) == name)
    text = np.searchsorted(edge, at, "right") - 1
    # the windows of an anchor lie in one run of windows with its name, and runs are in the order of their anchors: a run's anchors
    # (several where names are tied) are alike in name, and the next run of the text has another
    first = np.append(0, np.flatnonzero(least[1:] != least[:-1]) + 1)
    last = np.append(first[1:], len(least)) - 1
    runs = np.flatnonzero(least[first])
    own = name[at]
    run = runs[np.cumsum(np.append(False, (own[1:] != own[:-1]) | (text[1:] != text[:-1])))]
    return at, np.maximum(first[run], at - (WIDE - 1)), np.minimum(last[run], at), text


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Namer:
    """Names of stretches of texts; the powers grow with the longest text seen."""

    def __init__(self) -> None:
        self.up, self.down = _powers(_BASE, 4096), _powers(_BACK, 4096)

    def stretches(self, raw: np.ndarray, lo: np.ndarray, end: np.ndarray, salt: np.ndarray) -> np.ndarray:
        if len(self.up) <= len(raw):
            self.up, self.down = _powers(_BASE, 2 * len(raw)), _powers(_BACK, 2 * len(raw))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * self.up[: len(raw)], dtype=np.uint64)])
        return _mix((sums[end] - sums[lo]) * self.down[lo] ^ _mix(salt.astype(np.uint64) + (end - lo).astype(np.uint64) * np.uint64(4099)))


def _sides(name: np.ndarray, at: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """33-byte names that end and that start with the anchor; 0 where its text, from start to end, doesn't reach so far."""
    far = MER + 1
    i = np.maximum(at, far)
    left = np.where(at - far >= start, _mix(name[i - far] * _LEVEL[6] + name[i - MER] * _LEVEL[5] + name[i] * _LEVEL[4]) | np.uint64(1), 0)
    j = np.minimum(at, len(name) - 1 - far)
    right = np.where(at + far + MER <= end, _mix(name[j] * _LEVEL[6] + name[j + MER] * _LEVEL[5] + name[j + far] * _LEVEL[4]) | np.uint64(1), 0)
    return left, right


def _usable(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc"), "text").filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= SPAN))


def _columns(names: list[str], parts: list[list[np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64) if c else np.zeros(0, np.int64)) for c in parts], names=names)


def joined(column: pa.Array):
    """For stretches of texts of about TEXTS bytes, or one longer text: the first and last + 1 row, the bytes of the texts, and where
    each starts, and the end."""
    column = column.cast(pa.large_string())
    edge = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw, i = np.frombuffer(column.buffers()[2], np.uint8), 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(edge, edge[i] + TEXTS, "right")) - 1)
        yield i, j, raw[edge[i] : edge[j]], edge[i : j + 1] - edge[i]
        i = j


def _asked(column: pa.ListArray, i: int, j: int, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The n fields of the structs that rows i to j list, and the row of each, counted from i."""
    at = column.offsets.to_numpy()[i : j + 1]
    return [column.values.field(k).to_numpy()[at[0] : at[-1]] for k in range(n)], np.repeat(np.arange(j - i), np.diff(at))


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """mer, doc, place (first and last window start and anchor, packed)."""

    def run(batches):
        for b in small(batches):
            parts: list[list[np.ndarray]] = [[], [], []]
            ids = b.column("doc").to_numpy()
            for i, j, raw, edge in joined(b.column("text")):
                name = mer_ranks(raw)
                at, lo, hi, text = anchors(name, edge)
                for part, x in zip(parts, (name[at], ids[i:j][text], (lo - edge[text]) * 4096 + (hi - lo) * 64 + (at - lo))):
                    part.append(x.view(np.int64))
            yield _columns(["mer", "doc", "place"], parts)

    return _usable(docs).transform(bounded).mapInArrow(run, "mer long, doc long, place long")


def _context_rows(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """doc, place, rank, context, left and right names, for the anchors asked for (doc, places of place and rank)."""
    names = ["doc", "place", "rank", "context", "lname", "rname"]

    def run(batches):
        namer = Namer()
        for b in small(batches):
            parts: list[list[np.ndarray]] = [[] for _ in names]
            ids = b.column("doc").to_numpy()
            for i, j, raw, edge in joined(b.column("text")):
                (place, rank), text = _asked(b.column("places"), i, j, 2)
                fits = (place >> 12) + ((place >> 6) & 63) + SPAN <= edge[text + 1] - edge[text]  # all but for rows that repeat an id
                place, rank, text = place[fits], rank[fits], text[fits]
                lo = edge[text] + (place >> 12)
                at, end = lo + (place & 63), lo + ((place >> 6) & 63) + SPAN
                row = [ids[i:j][text], place, rank, namer.stretches(raw, lo, end, at - lo), *_sides(mer_ranks(raw), at, edge[text], edge[text + 1])]
                for part, x in zip(parts, row):
                    part.append(x.view(np.int64))
            yield _columns(names, parts)

    return _usable(docs).join(asked.hint("shuffle_hash"), "doc").transform(bounded).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def window_starts(place: np.ndarray, side: np.ndarray, rank: np.ndarray, text: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows of anchors, their rank and text (size: bytes of each): with side 1 those that hold 17 bytes more before the
    anchor, with side 2 the others, which hold 17 bytes more behind it. Each window of a text is there once a rank."""
    lo, middle = place >> 12, (place >> 12) + (place & 63) - MER
    hi = lo + ((place >> 6) & 63)
    first, last = np.where(side == 1, lo, np.maximum(lo, middle)), np.where(side == 1, np.minimum(hi, middle - 1), hi)
    fits = np.flatnonzero((last >= first) & (last + SPAN <= size[text]))  # all but empty stretches and rows that repeat an id
    order = fits[np.lexsort((first[fits], rank[fits], text[fits]))]
    first, last, rank, text = first[order], last[order], rank[order], text[order]
    if not len(first):
        return first, rank, text
    # stretches of one rank overlap where names are tied
    base = np.cumsum(np.append(False, (rank[1:] != rank[:-1]) | (text[1:] != text[:-1]))) * (size.max() + 1)
    before = np.append(-1, np.maximum.accumulate(last + base)[:-1]) - base
    first = np.maximum(first, before + 1)
    n = np.maximum(last - first + 1, 0)
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum()), np.repeat(rank, n), np.repeat(text, n)


def _window_rows(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """rank, window (its name), doc, start: the windows of the anchors asked for (doc, places of place, side and rank)."""

    def run(batches):
        for b in small(batches):
            parts: list[list[np.ndarray]] = [[], [], [], []]
            ids = b.column("doc").to_numpy()
            for i, j, raw, edge in joined(b.column("text")):
                (place, side, rank), text = _asked(b.column("places"), i, j, 3)
                start, rank, text = window_starts(place, side, rank, text, np.diff(edge))
                name, at = mer_ranks(raw), start + edge[text]
                head, tail = name[at] * _LEVEL[4] + name[at + MER], name[at + SPAN - 2 * MER] * _LEVEL[4] + name[at + SPAN - MER]
                for part, x in zip(parts, (rank, _mix(_mix(head) * _LEVEL[5] + tail), ids[i:j][text], start)):
                    part.append(x.view(np.int64))
            yield _columns(["rank", "window", "doc", "start"], parts)

    return _usable(docs).join(asked.hint("shuffle_hash"), "doc").transform(bounded).mapInArrow(run, "rank long, window long, doc long, start long")


def ranked(rows: DataFrame, keys: list[str], unique: bool = False, least: bool = True, once: tuple[str, ...] = (), n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """rows (doc, keys and other columns, all long), sorted by Spark and ranked anew, and the written table behind them.

    rank: where the group of equal keys starts in the order; least: its smallest document, if asked for. Groups of one document are
    left out unless unique. once: columns that only rows of a group's smallest document need; they may be null in others. n:
    about how many rows there are, where that is known. A task sees a range of the order; its first and last group may go on in others, so their rows are given
    with their keys, and what these groups come to over all tasks, two rows a task, is looked up by task when they are read."""
    spark = rows.sparkSession
    parts = max((rows.count() if n is None else n) // PART + 1, 2 * spark.sparkContext.defaultParallelism)
    rest = [c for c in rows.columns if c not in (*keys, "doc", "rank")]
    out = ["doc", *rest, "rank", "least", "most", *(f"key{i}" for i in range(len(keys)))]

    def scan(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        doc, own, others = table["doc"].to_numpy(), [table[k].to_numpy() for k in keys], [table[c].to_numpy() for c in rest]
        new = np.ones(len(doc), bool)
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in own])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(doc)))
        low, most, border = doc[start], doc[start + size - 1], np.zeros(len(start), bool)
        border[[0, -1]] = True
        group = np.repeat(np.arange(len(start)), size)
        kept = np.flatnonzero((np.full(len(start), unique) | border | (low < most))[group])
        first = TaskContext.get().partitionId() << 32
        for i in range(0, len(kept), 1 << 16):
            at = kept[i : i + (1 << 16)]
            g = group[at]
            inner = ~border[g]
            # what no one reads is null, and takes no room
            later = inner & (doc[at] > low[g]) if once else None
            columns = [pa.array(doc[at]), *(pa.array(x[at], mask=later if c in once else None) for c, x in zip(rest, others)), pa.array(first + start[g])]
            columns += [pa.array(low[g], mask=None if least else inner), pa.array(most[g], mask=inner)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x[at], mask=inner) for x in own)], names=out)

    ordered = rows.repartitionByRange(parts, *keys, "doc").sortWithinPartitions(*keys, "doc")
    with large_batches(spark):
        table = stage_table(ordered.mapInArrow(scan, ", ".join(f"{c} long" for c in out)), "ranked")
    border = table.filter("key0 is not null")
    found = border.groupBy(*out[-len(keys) :]).agg(F.min("rank"), F.min("least"), F.max("most"), F.collect_set("rank")).collect()
    # a border group's place in the list: twice its task, and one more for the task's last group
    sums = {2 * (r >> 32) + (r & 0xFFFFFFFF > 0): x[len(keys) : -1] for x in found for r in x[-1]}
    lists = [",".join(str(sums.get(i, (0, 0, 0))[j]) for i in range(2 * parts)) for j in range(3)]
    at = 2 * F.shiftright("rank", 32) + F.col("rank").bitwiseAND(F.lit(0xFFFFFFFF)).cast("boolean").cast("int")
    whole = [F.when(F.col("key0").isNull(), F.col(c)).otherwise(F.get(F.split(F.lit(x), ",").cast("array<long>"), at.cast("int"))).alias(c) for c, x in zip(("rank", "least", "most"), lists)]
    settled = table.select("doc", *rest, *whole, F.col("key0").isNull().alias("inner"))
    return (settled if unique else settled.filter("inner or least < most")).select("doc", *rest, "rank", *["least"] * least), table


def _span(start, end):
    """Start and end in one long."""
    return (F.shiftleft(start.cast("long"), 32) + end).alias("span")


def _in_slices(rows: DataFrame, keys: list[str], unique: bool = False, least: bool = True, once: tuple[str, ...] = ()) -> tuple[DataFrame, list[DataFrame]]:
    """The ranked rows of each slice of the last key, and the tables behind them. Ranks of different slices differ."""
    n = rows.count() // SLICES  # told by the files' footers
    parts = [ranked(rows.filter(F.pmod(F.col(keys[-1]), F.lit(SLICES)) == k), keys, unique, least, once, n) for k in range(SLICES)]
    out = [part.withColumn("rank", F.col("rank") * SLICES + k) for k, (part, _) in enumerate(parts)]
    return reduce(DataFrame.unionByName, out), [table for _, table in parts]


def _places(rows: DataFrame, *columns: str) -> DataFrame:
    """doc, places (array of structs)."""
    return rows.groupBy("doc").agg(F.collect_list(F.struct(*columns)).alias("places"))


def repeats(docs: DataFrame) -> DataFrame:
    """doc, spans (array of packed start and end): stretches of bytes to remove, overlapping and in no order."""
    # places are sorted in slices, so that little of them is in flight at once
    rows = stage_table(_anchor_rows(docs), "anchors")
    met, tables = _in_slices(rows, ["mer"], least=False)
    discard(rows)
    rows = stage_table(_context_rows(docs, _places(met, "place", "rank")), "contexts")
    for done in tables:
        discard(done)
    every, placed = _in_slices(rows.withColumn("of", F.col("rank")), ["rank", "context"], unique=True, once=("of", "lname", "rname"))
    discard(rows)
    again = F.col("doc") > F.col("least")
    lo, more = F.shiftright("place", 12), F.shiftright("place", 6).bitwiseAND(F.lit(63))
    whole = every.filter(again).select("doc", _span(lo, lo + more + SPAN))
    sides, tables = [], []
    for column, side in (("lname", 1), ("rname", 2)):
        found, table = ranked(every.filter(~again & (F.col(column) != 0)).select("doc", "place", F.col("of").alias("rank"), F.col(column).alias("name")), ["rank", "name"], least=False)
        sides.append(found.select("doc", "place", F.lit(side).cast("long").alias("side"), (F.col("rank") * 2 + side - 1).alias("rank")))
        tables.append(table)
    windows = stage_table(_window_rows(docs, _places(reduce(DataFrame.unionByName, sides), "place", "side", "rank")), "windows")
    for done in tables:
        discard(done)
    single, tables = _in_slices(windows, ["rank", "window"])
    discard(windows)
    single = single.filter("doc > least").select("doc", _span(F.col("start"), F.col("start") + SPAN))
    spans = stage_table(whole.unionByName(single).groupBy("doc").agg(F.collect_list("span").alias("spans")), "spans")
    for done in (*placed, *tables):
        discard(done)
    return spans


def _cut(raw: bytes, spans: np.ndarray | None) -> tuple[bytes, int, int]:
    """What is left, bytes removed, and maximal removed runs."""
    if spans is None or not len(spans):
        return raw, 0, 0
    edge = np.zeros(len(raw) + 1, np.int64)
    edge += np.bincount(np.minimum(spans >> 32, len(raw)), minlength=len(edge))
    edge -= np.bincount(np.minimum(spans & 0xFFFFFFFF, len(raw)), minlength=len(edge))
    gone = np.cumsum(edge[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (the bytes that stay) if with_text."""
    spans = repeats(docs)

    def run(batches):
        for b in small(batches):
            texts = [t.encode() if t else b"" for t in b.column("text").to_pylist()]
            got = [_cut(t, s.values.to_numpy() if s.is_valid else None) for t, s in zip(texts, b.column("spans"))]
            out = [b.column("doc_id"), *(pa.array(x, pa.int64()) for x in ([len(t) for t in texts], [g[1] for g in got], [g[2] for g in got])), pa.array([hashlib.sha256(g[0]).hexdigest() for g in got], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                out.append(pa.array([g[0] for g in got], pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(out, names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    met = rows.join(spans.hint("shuffle_hash"), rows["doc_id"] == spans["doc"], "left").select("doc_id", "text", "spans")
    return met.transform(bounded).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)

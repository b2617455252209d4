"""N-gram Jaccard join over prefix trees.

A document is the set of its distinct three-word shingles; two link when 100 * intersection >= 90 * union.

Which sets have to meet: sets of up to b shingles that link differ by at most D = 2b / 19. The global order is that of the shingles'
hashes; cut into more than D stretches at fixed hashes, two linked sets have a stretch in common, shingle for shingle. Each set sends one
hash a stretch (of small sets, one for each two stretches), for its own class of sizes and, near its end, for the next one. Sets with a
stretch in common are candidates, and candidates that hang together are a family, whose sets are sent once to the block in which they are
joined.

In a block the sets are stored in a prefix tree, in one order for all: sets with the same beginning share its nodes, so an overlap is counted
once for all sets below. Below a node no set is reached unless the overlap so far and the shorter of both remainders can still
give a link with the smallest set there. Only links that connect are sought: a subtree whose sets all belong to the probing set's
component is left out, so a block of n near copies costs about n probes and gives n - 1 links. A family too large for a block is
dealt in parts, and its best-connected sets go to each part. If it then still has several components, its largest one and the rest are
dealt in cells of two parts, so that all sets of different components meet in one cell; a family whose rest fits a block is sent
but once or twice. No pair is a row unless it is a link.

Defined results: null texts and texts without a word have an empty set, n_shingles 0, and are alone in their component. With
fewer than three words the whole sequence is the one shingle. Documents with the same set are one node, of which the smallest
id takes part in the search. Rows that repeat a doc_id with another text each have their own text's component; texts with
the same smallest id are one node. Rows with a null id are returned with a null component. Extra columns are ignored.
Shingles are 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, discard, salted, small, stage_table
from .components import components

WORDS, LEVEL = 3, 90
#: Size classes grow by this factor. Differences up to which keys are made of two stretches; stretches more than needed beyond
#: them, of which a set may leave out empty ones.
CLASS, PAIRED, SPARE = 1.35, 4, 2
#: Shingles that a block holds in all; a family of more is dealt. Sets that go to every part of a dealt family, at most.
BLOCK, LEADERS = 1 << 17, 16
#: Bits of the bitmap that spares texts a shuffle: 1 MB.
BITMAP_BITS = 1 << 23

_STEP, _C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def shingles(text: str | None) -> np.ndarray:
    """Distinct 64-bit hashes of the text's shingles, ascending."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - WORDS + 1)
    mixed = np.full(n, np.uint64(min(len(words), WORDS)))
    for i in range(min(WORDS, len(words))):
        mixed = mixed * _STEP + h[i : i + n]
        mixed = (mixed ^ (mixed >> np.uint64(33))) * _C1
        mixed = (mixed ^ (mixed >> np.uint64(33))) * _C2
        mixed ^= mixed >> np.uint64(33)
    return np.unique(mixed)


def _classes() -> np.ndarray:
    """Least sizes of the classes. Smaller sets than the first differ from every other set by more than a tenth."""
    out = [next(n for n in range(1, 1000) if 100 * n >= LEVEL * (n + 1))]
    while out[-1] < 1 << 40:
        out.append(int(np.ceil(CLASS * out[-1])))
    return np.array(out)


_CLASSES = _classes()
_MANY = np.uint64(0xC2B2AE3D27D4EB4F)


def _scattered(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _C1
    x = (x ^ (x >> np.uint64(32))) * _C2
    return x ^ (x >> np.uint64(31))


def keys(found: np.ndarray) -> np.ndarray:
    """Hashes of the set's stretches; two linked sets have one in common."""
    n, mixed, out = len(found), _scattered(found * _STEP), []
    own = int(np.searchsorted(_CLASSES, n, "right")) - 1
    for c in (own, own + 1):
        # the next class has links only with the largest of this one
        if own < 0 or 100 * n < LEVEL * int(_CLASSES[c]):
            continue
        # two linked sets of at most so many shingles differ by at most so many
        differ = 2 * (100 - LEVEL) * (int(_CLASSES[c + 1]) - 1) // (100 + LEVEL)
        paired = differ <= PAIRED
        k = differ + (2 if paired else 1 + SPARE)
        at = ((found >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
        starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        sums = np.zeros(k, np.uint64)
        sums[at[starts].astype(np.int64)] = np.add.reduceat(mixed, starts)
        marks = _scattered(sums + (np.arange(k, dtype=np.uint64) + np.uint64(c << 32)) * _MANY)
        if paired:
            # at least two of the stretches are the same in both
            one, two = np.triu_indices(k, 1)
            out.append(_scattered(marks[one] + marks[two] * _STEP))
        else:
            full = np.zeros(k, bool)
            full[at[starts].astype(np.int64)] = True
            # SPARE + 1 stretches at least are the same in both; with more empty ones all of these could be empty
            out.append(marks[full] if k - len(starts) <= SPARE else marks)
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def needed(a: int, b: int) -> int:
    """Least intersection of linked sets of a and b shingles."""
    return -(-LEVEL * (a + b) // (100 + LEVEL))


# --- the tree of a block


class Node:
    """A stretch of shingles that all sets below share; rest: the most shingles that one of them has after it."""

    __slots__ = ("stretch", "kids", "least", "most", "rest", "component", "ends")

    def __init__(self, stretch, least, most, rest, component):
        self.stretch, self.kids, self.ends = stretch, {}, []
        #: Sizes of the sets below, and their component if they have but one.
        self.least, self.most, self.rest, self.component = least, most, rest, component


class Tree:
    """Sets of one block in their order, and the components that links between them make."""

    def __init__(self):
        self.root = Node(None, 1 << 62, 0, 0, None)
        self.parent: dict[int, int] = {}
        #: Nodes that probes have looked at.
        self.seen = 0

    def find(self, c: int) -> int:
        parent = self.parent
        while (up := parent.get(c, c)) != c:
            parent[c] = c = parent.get(up, up)
        return c

    def insert(self, order: np.ndarray, size: int, member: int, c: int) -> None:
        node, at, c = self.root, 0, self.find(c)
        if node.most == 0:
            node.component = c
        while True:
            node.least, node.most, node.rest = min(node.least, size), max(node.most, size), max(node.rest, len(order) - at)
            if node.component is not None and self.find(node.component) != c:
                node.component = None
            if at == len(order):
                node.ends.append((member, size, c))
                return
            first = int(order[at])
            kid = node.kids.get(first)
            if kid is None:
                kid = node.kids[first] = Node(order[at:], size, size, 0, c)
                kid.ends.append((member, size, c))
                return
            m = min(len(kid.stretch), len(order) - at)
            same = kid.stretch[:m] == order[at : at + m]
            k = m if same.all() else int(same.argmin())
            if k < len(kid.stretch):
                upper = Node(kid.stretch[:k], kid.least, kid.most, kid.rest + len(kid.stretch) - k, kid.component)
                kid.stretch = kid.stretch[k:]
                upper.kids[int(kid.stretch[0])] = kid
                node.kids[first] = kid = upper
            node, at = kid, at + k

    def probe(self, order: np.ndarray, has: np.ndarray, size: int, c: int) -> list[int]:
        """A member for each component that the set is linked with, other than its own; they become one. has: whether a
        shingle is in the set."""
        out, c = [], self.find(c)
        # nodes on the way down, each with its overlap and the kids that are left to look at
        stack = [(self.root, 0, iter(self.root.kids.values()))]
        while stack:
            node, overlap, kids = stack[-1]
            kid = None if node.component is not None and self.find(node.component) == c else next(kids, None)
            if kid is None:
                stack.pop()
                continue
            self.seen += 1
            if 100 * min(size, kid.most) < LEVEL * max(size, kid.least) or kid.component is not None and self.find(kid.component) == c:
                continue
            inside = overlap + int(np.count_nonzero(has[kid.stretch]))
            left = len(order) - int(np.searchsorted(order, kid.stretch[-1], "right"))
            if inside + min(left, kid.rest) < needed(size, kid.least):
                continue
            for member, n, other in kid.ends:
                other = self.find(other)
                if other != c and (100 + LEVEL) * inside >= LEVEL * (n + size):
                    out.append(member)
                    self.parent[other] = c
            # the kid that was there first leads to most sets; once one of them links, the rest of their component is left out
            stack.append((kid, inside, iter(kid.kids.values())))
        return out


def block_links(ids: list[int], parts: list[int], sides: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """(part, root) of the parts (components so far) that links between a block's sets join with others; root is the least of those joined. Sets
    of side 1 are compared with those of side 0, sets of side 2 with each other and with those of side 0."""
    size = np.array([len(s) for s in sets])
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    # a linked set has nine tenths of its shingles in common with one other set; others leave, and theirs with them
    while True:
        _, place, count = np.unique(every, return_inverse=True, return_counts=True)
        shared = count[place] > 1
        common = np.bincount(owner[shared], minlength=len(sets))
        stays = 100 * common >= LEVEL * size
        if not stays.any():
            return []
        if stays[owner].all():
            break
        keep = stays[owner]
        every, owner = every[keep], owner[keep]
    # within the block the most common shingles come first, so that sets have long beginnings in common
    by_count = np.empty(len(count), np.int64)
    by_count[np.lexsort((np.arange(len(count)), -count))] = np.arange(len(count))
    local, owner = by_count[place[shared]], owner[shared]
    local = local[np.lexsort((local, owner))]
    ends = np.cumsum(np.bincount(owner, minlength=len(sets)))
    tree, has = Tree(), np.zeros(len(count), bool)
    members = sorted(np.flatnonzero(stays).tolist(), key=lambda i: (sides[i] == 1, size[i], ids[i]))
    for i in members:
        order = local[ends[i] - common[i] : ends[i]]
        if sides[i]:
            has[order] = True
            tree.probe(order, has, int(size[i]), parts[i])
            has[order] = False
        if sides[i] != 1:
            tree.insert(order, int(size[i]), i, parts[i])
    return stars(tree.parent, tree.find)


def stars(parent: dict[int, int], find) -> list[tuple[int, int]]:
    """(node, root) of the nodes of a forest that aren't alone, root the least of their tree."""
    least: dict[int, int] = {}
    for node in parent:
        root = find(node)
        least[root] = min(node, root, least.get(root, root))
    return [(node, least[root]) for node in [*parent, *(r for r in least if r not in parent)] if (root := find(node)) in least]


# --- the search


def _scan(docs: DataFrame) -> DataFrame:
    """One pass over whole texts: doc_id, n_shingles, sig (digest of the set, null if empty), keys."""

    def run(batches):
        for b in small(batches):
            n, sig, marks = [], [], []
            for text in b.column("text").to_pylist():
                found = shingles(text)
                n.append(len(found))
                sig.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                marks.append(keys(found).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(marks, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "sig", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(bounded).mapInArrow(run, "doc_id long, n_shingles long, sig binary, keys array<long>")


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id and shingles of the texts of ids. A bitmap of hashed ids, of fixed size, spares most other texts the shuffle of the
    exact join after it; a full one lets more pass, never fewer."""
    slot = F.pmod(F.xxhash64("id"), F.lit(BITMAP_BITS))
    word, bit = F.shiftright(slot, 6), (slot.bitwiseAND(F.lit(63))).cast("int")
    bitmap = ids.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    asked = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter("id is not null").withColumn("word", word)
    asked = asked.join(F.broadcast(bitmap), "word").filter(F.call_function("shiftright", F.col("bits"), bit).bitwiseAND(F.lit(1)) == 1).select("id", "text")

    def run(batches):
        for b in small(batches):
            sets = pa.array([shingles(t).view(np.int64) for t in b.column("text").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("id"), sets], names=["id", "shingles"])

    return asked.join(ids, "id", "left_semi").transform(bounded).mapInArrow(run, "id long, shingles array<long>")


def _joined_parts(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(family, c, root) of the parts c that links within blocks join. members: family and cell (the block), id, c, side."""
    rows = members.join(sets, "id").repartition("family", "cell").sortWithinPartitions("family", "cell").select("family", "cell", "id", "c", "side", "shingles")

    def found(at, block):
        ids, parts, sides, sets_ = (list(x) for x in zip(*block))
        return [(at[0], *x) for x in block_links(ids, parts, sides, sets_)] if len(ids) > 1 else []

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["family", "c", "root"])

    def run(batches):
        now, block = None, []
        for b in batches:
            out = []
            arrays = b.column(b.schema.get_field_index("shingles"))
            flat, ends = arrays.flatten().to_numpy(zero_copy_only=False).view(np.uint64), arrays.offsets.to_numpy() - arrays.offsets[0].as_py()
            for i, (family, cell, *row) in enumerate(zip(*(b.column(k).to_pylist() for k in range(5)))):
                if (family, cell) != now:
                    if block:
                        out += found(now, block)
                    now, block = (family, cell), []
                block.append((*row, flat[ends[i] : ends[i + 1]].copy()))
            if out:
                yield batch(out)
        if block and (out := found(now, block)):
            yield batch(out)

    return bounded(rows).mapInArrow(run, "family long, c long, root long")


def _part(parts: str) -> Column:
    return F.pmod(F.xxhash64("id"), F.col(parts)).cast("int")


#: Nodes that a task joins before it tells what it has.
HELD = 1 << 18


def _forest(batches):
    """Arrow batches of edges (u, v) as the stars of the trees that they make: v, root u (of itself, too), and how many edges v had."""
    tree, times = Tree(), {}

    def told():
        rows = [(v, u, times.get(v, 0)) for v, u in stars(tree.parent, tree.find)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=["v", "u", "n"])

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            times[u], times[v] = times.get(u, 0) + 1, times.get(v, 0) + 1
            u, v = tree.find(u), tree.find(v)
            if u != v:
                tree.parent[max(u, v)] = min(u, v)
        if len(times) > HELD:
            if tree.parent:
                yield told()
            tree, times = Tree(), {}
    if tree.parent:
        yield told()


def _trees(edges: DataFrame) -> DataFrame:
    """v, u, n of edges (u, v), joined within each task."""
    return bounded(edges.select("u", "v")).mapInArrow(_forest, "v long, u long, n long")


def _connected(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (u, v): what several tasks tell of a node is joined by nodes first, which leaves few rounds."""
    return components(_trees(edges.filter("u <> v").select("u", "v").repartition("v")).select("u", "v"))


def _families(heads: DataFrame) -> DataFrame:
    """id, family, n, central of sets with a stretch in common; central: in how many stretches it met another one."""
    # the sets of a stretch hang on its smallest id: one shuffle, and no set of a stretch is held
    least = F.first("id").over(Window.partitionBy("key").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hung = heads.select("id", F.explode("keys").alias("key")).withColumn("least", least).filter("least <> id").select(F.col("least").alias("u"), F.col("id").alias("v"))

    # a task tells the trees that its own stretches make, which are far fewer than the stretches
    edges = stage_table(_trees(hung), "edges")
    part = _connected(edges)
    central = edges.groupBy(F.col("v").alias("id")).agg(F.sum("n").alias("central"))
    families = stage_table(part.select(F.col("node").alias("id"), F.col("component").alias("family")).join(heads.select("id", "n"), "id").join(central, "id", "left"), "families")
    discard(edges)
    return families


def search(docs: DataFrame, heads: DataFrame) -> DataFrame:
    """(node, component) of the heads (id, n, keys) that have a link."""
    every = _families(heads)
    sets = stage_table(_sets(docs, every.select("id").distinct()), "sets")
    n_rows = every.count()
    sizes = every.groupBy("family").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("parts"))
    dealt = stage_table(salted(every, sizes, "family", "id", n_rows), "dealt")

    # families in a block, or in parts that their leaders go to, too
    large = dealt.filter("parts > 1")
    best = F.min(F.struct(-F.coalesce("central", F.lit(0)), "id", "parts")).alias("x")
    led = large.groupBy("family", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(LEADERS)).alias("slot")).agg(best)
    led = led.select("family", F.explode(F.sequence(F.lit(0), F.col("x.parts") - 1)).alias("cell"), F.col("x.id").alias("id"))
    members = dealt.select("family", _part("parts").alias("cell"), "id").unionByName(led).dropDuplicates(["family", "cell", "id"])
    found = stage_table(_joined_parts(members.select("family", "cell", "id", F.col("id").alias("c"), F.lit(2).alias("side")), sets), "found")
    # what a family's only block has joined is final
    final = [F.col("c").alias("node"), F.col("root").alias("component")]
    if large.isEmpty():
        return _done(found.select(*final), every, sets, dealt)
    dealt_families = large.select("family").distinct()
    whole = found.join(dealt_families, "family", "left_anti").select(*final)

    # the largest component against the rest, the rest against itself
    part = _connected(found.join(dealt_families, "family", "left_semi").select(F.col("root").alias("u"), F.col("c").alias("v")))
    placed = stage_table(large.join(part, large["id"] == part["node"], "left").select("family", "id", "n", F.coalesce("component", "id").alias("c")), "placed")
    by_c = placed.groupBy("family", "c").agg(F.sum("n").alias("n"))
    of = by_c.groupBy("family").agg(F.max(F.struct("n", "c")).alias("x"), F.sum("n").alias("n")).filter("x.n < n")
    of = of.select("family", F.col("x.c").alias("most"), F.ceil(F.col("x.n") / BLOCK).cast("int").alias("own"), F.ceil((F.col("n") - F.col("x.n")) / BLOCK).cast("int").alias("rest"))
    open_ = salted(placed, of, "family", "id", n_rows)
    at = F.when(F.col("c") == F.col("most"), F.col("rest") + _part("own")).otherwise(_part("rest"))
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("c") == F.col("most"), F.col("rest")).otherwise(F.col("rest") + F.col("own")) - 1))
    cells = open_.withColumn("at", at).withColumn("other", other)
    side = F.when(F.col("at") == F.col("other"), 2).when(F.col("at") < F.col("other"), 0).otherwise(1)
    members = cells.select("family", (F.least("at", "other").cast("long") * (F.col("rest") + F.col("own")) + F.greatest("at", "other")).alias("cell"), "id", "c", side.alias("side"))
    more = stage_table(_joined_parts(members, sets), "found")
    named = placed.select(F.col("id").alias("node"), "c")
    if not more.isEmpty():
        joined_ = _connected(more.select(F.col("root").alias("u"), F.col("c").alias("v")))
        named = named.join(joined_.select(F.col("node").alias("c"), "component"), "c", "left").select("node", F.coalesce("component", "c").alias("c"))
    out = stage_table(whole.unionByName(named.select("node", F.col("c").alias("component"))), "components")
    return _done(out, every, sets, dealt, placed, found, more)


def _done(part: DataFrame, *tables: DataFrame) -> DataFrame:
    for table in tables:
        discard(table)
    return part


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: a row for each row of docs (doc_id, text)."""
    every = stage_table(_scan(docs), "scanned")
    node = every.filter("sig is not null and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("id"))
    marked = every.filter(F.size("keys") > 0).select("doc_id", F.col("sig").alias("own"), F.col("n_shingles").alias("n"), "keys")
    heads = stage_table(marked.join(node, (F.col("doc_id") == F.col("id")) & (F.col("own") == F.col("sig"))).select("id", "n", "keys").dropDuplicates(["id", "keys"]), "heads")
    part = search(docs, heads)
    discard(heads)
    of_sig = node.join(part, node["id"] == part["node"], "left").select("sig", F.coalesce("component", "id").alias("component"))
    own = every.select("doc_id", "n_shingles", "sig")
    # a set may have most of all rows: they are dealt; rows without a set or an id meet none
    known = F.col("sig").isNotNull() & F.col("doc_id").isNotNull()
    out = salted(own.filter(known), of_sig, "sig", "doc_id", every.count()).drop("sig").unionByName(own.filter(~known).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component")))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))

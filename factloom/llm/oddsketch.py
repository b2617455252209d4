"""MinHash near-dedup with odd sketches.

Every document gets K MinHash samples of its five-word shingles. Bands of R samples bring candidates together; the samples
folded into a parity bitmap (an odd sketch) reject most candidates by the population count of an XOR; what is left is
confirmed on the full shingle sets. Links need 100 * intersection >= 75 * union.

No pairs are made within a group. In rounds, every member is tried against a leader of its bucket, first the member that
shares the most buckets, and joins the leader's component if they are alike. Members of buckets that still hold several
components are then joined on their rarest shingles, which finds every link between them. So a group of n copies costs about
n trials, and no link that shares a band is lost but for those that the sketches reject; near_duplicates(exact=True) searches
by the prefix join alone and loses none.

Defined results: null texts and texts without a word have an empty set, n_shingles 0, and are alone in their component.
With fewer than five words the whole sequence is the one shingle. Documents with the same set are one node: of any number
of copies only the smallest id takes part in the search. Rows that repeat a doc_id count as one document with the links of
each; rows with a null id are returned with a null component, kept. Extra input columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, discard, salted, small, stage_table
from .components import components

WORDS = 5
#: Least similarity in hundredths.
LEVEL = 75
#: Samples a band and bands: a pair at 0.75 shares no band with probability (1 - 0.75^5)^42 = 1e-5.
ROWS, BANDS = 5, 42
SAMPLES = ROWS * BANDS
#: Bits of the odd sketch, in longs of 64.
SKETCH_LONGS = 8
#: A candidate goes on if its sketch estimates at least this similarity; 0.75 lies over five standard deviations higher.
ESTIMATE = 0.55
CHUNK = 2048
#: Bits of the bitmap that spares texts a shuffle: 1 MB, at any input size.
BITMAP_BITS = 1 << 23
#: Rounds of leaders before the rest is tried pair by pair.
ROUNDS = 6
#: Another round of leaders needs more pairs between components than so many a bucket row, and fewer than this share of
#: those before the last round.
PAIRS_A_ROW, STALL = 64, 0.7

_RNG = np.random.default_rng(20240711)
_XOR = _RNG.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_MUL = _RNG.integers(0, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)
_BAND = _RNG.integers(0, 1 << 64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_SALT = _RNG.integers(0, 1 << 64, BANDS, dtype=np.uint64)
_SLOT = _RNG.integers(0, 1 << 64, SAMPLES, dtype=np.uint64)
_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _C1
    x = (x ^ (x >> np.uint64(33))) * _C2
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None) -> np.ndarray:
    """Distinct 64-bit hashes of the text's shingles, ascending."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - WORDS + 1)
    mixed = np.full(n, np.uint64(min(len(words), WORDS)))
    for i in range(min(WORDS, len(words))):
        mixed = _mix(mixed * _STEP + h[i : i + n])
    return np.unique(mixed)


def samples(found: np.ndarray) -> np.ndarray:
    """The K MinHash samples of a non-empty set."""
    low = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, np.uint32(0xFFFFFFFF))
    for i in range(0, len(low), CHUNK):
        block = (low[i : i + CHUNK, None] ^ _XOR) * _MUL
        np.minimum(least, (block ^ (block >> np.uint32(15))).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    return _mix((_mix(least.reshape(BANDS, ROWS).astype(np.uint64) + _STEP) * _BAND).sum(axis=1, dtype=np.uint64) ^ _SALT)


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples (position and value), as SKETCH_LONGS 64-bit words."""
    bit = _mix(least.astype(np.uint64) * _STEP ^ _SLOT) % np.uint64(64 * SKETCH_LONGS)
    parity = (np.bincount(bit.astype(np.int64), minlength=64 * SKETCH_LONGS) & 1).astype(np.uint8)
    return np.packbits(parity, bitorder="little").view("<u8")


def _most_flips() -> int:
    """Differing bits that a pair at ESTIMATE is expected to show: each differing sample flips two of m bits."""
    m = 64 * SKETCH_LONGS
    return round(m * (1 - (1 - 2 / m) ** (2 * SAMPLES * (1 - ESTIMATE))) / 2)


def _close(a: str, b: str) -> Column:
    """Whether two sketches, columns of array<long>, pass the estimate."""
    flips = F.lit(0)
    for i in range(SKETCH_LONGS):
        flips = flips + F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i]))
    return flips <= _most_flips()


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, sig (digest of the set; null if empty), bands, sketch: one pass over the whole texts."""

    def run(batches):
        for b in small(batches):
            n, sig, bands, sketch = [], [], [], []
            for text in b.column("text").to_pylist():
                found = shingles(text)
                n.append(len(found))
                if not len(found):
                    sig.append(None), bands.append(None), sketch.append(None)
                    continue
                least = samples(found)
                sig.append(xxhash.xxh3_128_digest(found.tobytes()))
                bands.append(band_keys(least).view(np.int64))
                sketch.append(odd_sketch(least).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "sig", "bands", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(bounded).mapInArrow(run, "doc_id long, n_shingles long, sig binary, bands array<long>, sketch array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """id and the full set, a row for each input row (id, ..., text)."""

    def run(batches):
        for b in small(batches):
            at = b.schema.get_field_index("text")
            sets = pa.array([shingles(t).view(np.int64) for t in b.column(at).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(b.columns) if i != at), sets], names=[*(f.name for i, f in enumerate(b.schema) if i != at), "shingles"])

    rest = [f"{k} {v}" for k, v in docs.dtypes if k != "text"]
    return docs.transform(bounded).mapInArrow(run, ", ".join([*rest, "shingles array<long>"]))


def _holding(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows (id, text) of docs that may be among ids: a bitmap of hashed ids, of fixed size, spares most other texts the
    shuffle that the exact join after it makes. A full bitmap lets more pass, never fewer."""
    slot = F.pmod(F.xxhash64("id"), F.lit(BITMAP_BITS))
    word, bit = F.shiftright(slot, 6), (slot.bitwiseAND(F.lit(63))).cast("int")
    bitmap = ids.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    asked = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter("id is not null")
    return asked.withColumn("word", word).join(F.broadcast(bitmap), "word").filter(F.call_function("shiftright", F.col("bits"), bit).bitwiseAND(F.lit(1)) == 1).select("id", "text")


def confirm(docs: DataFrame, pairs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) that are links on full sets. Only texts of ids in a pair are moved; an a with very many mates is
    dealt over several tasks."""
    pairs = stage_table(pairs, "pairs")
    own = None
    if sets is None:
        ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        sets = own = stage_table(_sets(_holding(docs, ids).join(ids, "id")), "sets")
    right = pairs.join(sets, pairs["b"] == sets["id"]).select("a", "b", F.col("shingles").alias("right_set"))
    left = pairs.select("a").distinct().join(sets, F.col("a") == sets["id"]).select("a", F.col("shingles").alias("left_set"))
    # the counts for dealing come from the narrow pairs, not from the rows that carry sets
    met = salted(right, left, "a", "b", pairs.count(), pairs)
    common = F.size(F.array_intersect("left_set", "right_set"))
    union = F.size("left_set") + F.size("right_set") - common
    links = stage_table(met.filter(100 * common >= LEVEL * union).select("a", "b").distinct(), "links")
    for done in (pairs, own):
        if done is not None:
            discard(done)
    return links


def _trials(buckets: DataFrame, sketches: DataFrame, leaders: DataFrame, n: int) -> DataFrame:
    """(a, b): each bucket's leader with the members of its bucket in other components, if their sketches are close.
    buckets: key, id, c (component), n rows; leaders: key, lead, lead_c. A leader brings its sketch along: it leads no more
    buckets than there are bands, while its buckets may hold most documents."""
    his = leaders.join(sketches.select(F.col("id").alias("lead"), F.col("sketch").alias("lead_sketch")), "lead")
    tried = salted(buckets, his, "key", "id", n).filter("c <> lead_c").select("lead", "id", "lead_sketch").dropDuplicates(["lead", "id"])
    return tried.join(sketches.withColumnRenamed("sketch", "own"), "id").filter(_close("own", "lead_sketch")).select(F.col("lead").alias("a"), F.col("id").alias("b"))


def _placed(buckets: DataFrame, links: DataFrame | None, n: int) -> DataFrame:
    """Bucket members with their component so far, of buckets that hold more than one component."""
    if links is None:
        return buckets.select("key", "id", "central", F.col("id").alias("c"))
    part = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    placed = buckets.join(part, buckets["id"] == part["node"], "left").select("key", "id", "central", F.coalesce("component", "id").alias("c"))
    placed = stage_table(placed, "placed")
    several = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("key")
    still = stage_table(salted(placed, several, "key", "id", n), "open")
    discard(placed)
    return still


def search(docs: DataFrame, heads: DataFrame, exact: bool = False) -> DataFrame:
    """Links (a, b) of heads (id, bands, sketch), enough of them to connect all that belong together. exact: neither bands nor
    sketches choose the candidates, only the prefix join, which misses no link."""
    if exact:
        return _rest(docs, heads.select("id", F.col("id").alias("c")), None)
    rows = heads.select("id", F.explode("bands").alias("key"))
    keys = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = stage_table(salted(rows, keys, "key", "id", BANDS * heads.count()), "buckets")
    # the original of a family of edited copies shares buckets with most of them, so it makes the best leader
    central = met.groupBy("id").agg(F.sum("n").alias("central"))
    buckets = stage_table(met.drop("n").join(central, "id"), "buckets")
    sketches = stage_table(heads.select("id", "sketch").join(central, "id", "left_semi"), "sketches")
    discard(met)
    n_rows = buckets.count()

    links, tries, members, before = None, 0, _placed(buckets, None, n_rows), None
    while True:
        first = F.lit(0).cast("long") if tries == 0 else F.xxhash64("c", F.lit(tries))
        best = F.min(F.struct(first.alias("turn"), (-F.col("central")).alias("rank"), "id", "c"))
        leaders = members.groupBy("key").agg(best.alias("x")).select("key", F.col("x.id").alias("lead"), F.col("x.c").alias("lead_c"))
        found = confirm(docs, _trials(members, sketches, leaders, n_rows))
        if tries:
            discard(members)
        links = found if links is None else stage_table(links.unionByName(found).distinct(), "links")
        members, tries = _placed(buckets, links, n_rows), tries + 1
        per_key = members.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("pairs"))
        left = per_key.agg(F.coalesce(F.sum("pairs"), F.lit(0.0)).alias("pairs")).first()["pairs"]
        if left <= PAIRS_A_ROW * n_rows or tries >= ROUNDS or (before is not None and left > STALL * before):
            break
        before = left
    out = links.unionByName(_rest(docs, members, sketches)) if left else links
    for done in (buckets, sketches, members):
        discard(done)
    return out


def prefixes(sets: DataFrame) -> DataFrame:
    """token, id, place, n: the shingles of each set (id, shingles) that other sets have, too, with their place among all of the
    set's n shingles, rarest first; those that no other set has come before them."""
    rows = sets.select("id", F.size("shingles").alias("n"), F.explode("shingles").alias("token"))
    shared = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    own = Window.partitionBy("id")
    spread = salted(rows, shared, "token", "id", sets.agg(F.coalesce(F.sum(F.size("shingles")), F.lit(0)).alias("n")).first()["n"])
    spread = spread.withColumn("rank", F.row_number().over(own.orderBy("df", "token"))).withColumn("shared", F.count(F.lit(1)).over(own))
    return spread.select("token", "id", (F.col("rank") + F.col("n") - F.col("shared")).alias("place"), "n")


def tried_pairs(places: DataFrame, also: Column | None = None) -> DataFrame:
    """a, b of the prefix join, for each shingle in both prefixes; places: token, id, place, n. also: a condition on a's and b's
    other columns, named as in places with a or b behind.

    With all shingles in one order, two linked sets have their first common one within the first n - ceil(6/7 n) + 1 of the
    smaller set (on ties of the smaller id), as it shares 2 * 0.75 / 1.75 of its own at least, and within the first
    n - ceil(0.75 n) + 1 of the larger one. So documents that have a template in common are not paired unless it makes up 6/7
    of one and 3/4 of the other."""
    n, place = F.col("n"), F.col("place")
    low = places.filter(place <= n - F.ceil(2 * LEVEL * n / (100 + LEVEL)) + 1)
    high = stage_table(places.filter(place <= n - F.ceil(n * LEVEL / 100) + 1), "prefix")
    one, two = (t.select("token", *(F.col(k).alias(k + x) for k in places.columns if k != "token")) for t, x in ((low, "a"), (high, "b")))
    smaller = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("ida") < F.col("idb")))
    # at their first shared shingle, two sets can share no more than what either has left
    alike = (100 + LEVEL) * (1 + F.least(F.col("na") - F.col("placea"), F.col("nb") - F.col("placeb"))) >= LEVEL * (F.col("na") + F.col("nb"))
    met = salted(two, one, "token", "idb", high.count())
    return met.filter(smaller & alike if also is None else smaller & alike & also).select(F.col("ida").alias("a"), F.col("idb").alias("b"))


def _rest(docs: DataFrame, members: DataFrame, sketches: DataFrame | None) -> DataFrame:
    """Links that no leader has shown, between components (id, c) of a bucket, by the prefix join of tried_pairs()."""
    own = stage_table(members.select("id", "c").distinct(), "open")
    sets = stage_table(_sets(_holding(docs, own.select("id")).join(own, "id")), "sets")
    held = own if sketches is None else own.join(sketches, "id")
    places = stage_table(prefixes(sets).join(held, "id"), "places")
    apart = F.col("ca") != F.col("cb")
    across = tried_pairs(places, apart if sketches is None else apart & _close("sketcha", "sketchb")).distinct()
    links = confirm(docs, across, sets.select("id", "shingles"))
    for done in (own, sets, places):
        discard(done)
    return links


def near_duplicates(docs: DataFrame, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each input row. exact: without bands and sketches, which miss a pair at
    the limit with probability 1e-5; it costs a row a shingle."""
    every = stage_table(profiles(docs), "profiles")
    node = every.filter("sig is not null and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("id"))
    heads = every.filter("sig is not null").join(node.select(F.col("id").alias("doc_id"), F.col("sig").alias("own")), "doc_id").filter("sig = own").select(F.col("doc_id").alias("id"), "bands", "sketch").dropDuplicates(["id", "bands"])
    part = components(search(docs, heads, exact).select(F.col("a").alias("u"), F.col("b").alias("v")))
    of_sig = node.join(part, node["id"] == part["node"], "left").select("sig", F.coalesce("component", "id").alias("component"))
    out = every.select("doc_id", "n_shingles", "sig").join(of_sig, "sig", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs whose document is the smallest id of its component; of rows that repeat an id, one."""
    found = near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    stay = docs.join(found, docs["doc_id"].eqNullSafe(found["kept_id"]), "left_semi")
    named = stay.filter("doc_id is not null").dropDuplicates(["doc_id"])
    return named.unionByName(stay.filter("doc_id is null"))

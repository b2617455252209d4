"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the hashed n-grams of each language that has a text with letters, however few; the matrix of log
probabilities, of fixed size a language, is sent to the executors in blocks of languages, and a batch of texts is scored in
numpy as one sparse matrix of n-gram counts, block by block.

Defined results: a text that is null or has no letter is `und` with score 0, as is every text if nothing could be learned.
Ties go to the language that sorts first. Rows with a null id are scored but never learned from, and count as not held out.
Repeated rows are scored one by one; extra columns are ignored. lang is read for training only."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, discard, small, stage_table

#: Lengths of n-grams, buckets of the hash, and the added count of a bucket.
GRAMS, BUCKETS, SMOOTH = (1, 2, 3, 4), 1 << 16, 0.5
#: Documents with letters of each language to learn from: those with the smallest id hash.
SAMPLE_PER_LANG = 1500
#: Languages whose matrix is held at once, 16 MB as floats.
BLOCK = 64
#: Products held at once while a batch is scored.
CELLS = 1 << 21
#: Folds by crc32 of the id as text; fold 0 is held out.
FOLDS = 5

_LETTERS = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def letters(text: str | None) -> str:
    """Words of letters in lower case with a space around each; empty if there is no letter."""
    words = _LETTERS.findall(text.lower()) if text else []
    if not words or not any(any(map(str.isalpha, w)) for w in words):
        return ""
    return " " + " ".join(words) + " "


def buckets(flat: str) -> np.ndarray:
    """Hash buckets of all n-grams."""
    points = np.frombuffer(flat.encode("utf-32-le"), np.uint32)
    out, h = [], np.zeros(len(points), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        if len(points) < n:
            break
        h = (h[: len(points) - n + 1] + points[n - 1 :]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if n in GRAMS:
            out.append(((h * np.uint32(0x85EBCA77 + 2 * n)) >> np.uint32(16)).astype(np.int32))
    return np.concatenate(out)


@dataclass
class Model:
    langs: list[str]
    blocks: list  # of matrices, buckets x languages, or of broadcasts of them

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The texts as one sparse matrix of n-gram counts (buckets and counts of each text, one after the other), multiplied
        with each block of languages."""
        flats = [letters(t) if self.langs else "" for t in texts]
        some = [i for i, flat in enumerate(flats) if flat]
        out = [("und", 0.0)] * len(texts)
        if not some:
            return out
        at, n = [], []
        for i in some:
            # all buckets of one text at a time; what is kept are those that it has
            counts = np.bincount(buckets(flats[i]), minlength=BUCKETS)
            at.append(np.flatnonzero(counts))
            n.append(counts[at[-1]].astype(float))
        grams = np.array([x.sum() for x in n])
        # the n-grams of a text overlap: its evidence is tempered before it becomes a probability
        weight = np.minimum(grams, 40) / grams
        # of each text: best language so far, its evidence, and the sum of probabilities relative to it
        best, most, mass, first = np.zeros(len(some), np.int64), np.full(len(some), -np.inf), np.zeros(len(some)), 0
        for block in self.blocks:
            logs = block if isinstance(block, np.ndarray) else _loaded(block, len(self.blocks))
            total = _product(at, n, logs)
            own = total.argmax(1)
            peak = total[np.arange(len(some)), own]
            top = np.maximum(most, peak)
            mass = mass * np.exp((most - top) * weight) + np.exp((total - top[:, None]) * weight[:, None]).sum(1)
            best, most = np.where(peak > most, first + own, best), top
            first += logs.shape[1]
        for i, k, m in zip(some, best, mass):
            out[i] = (self.langs[k], float(1 / m))
        return out


def _product(at: list[np.ndarray], n: list[np.ndarray], logs: np.ndarray) -> np.ndarray:
    """Rows of counts, given by their buckets and values, times logs (buckets x languages), in stretches of at most CELLS
    products or one row."""
    out, ends, i = np.zeros((len(at), logs.shape[1])), np.cumsum([len(x) for x in at]), 0
    while i < len(at):
        done = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, done + CELLS // logs.shape[1], "right")))
        starts = np.append(0, ends[i : j - 1] - done)
        out[i:j] = np.add.reduceat(np.concatenate(n[i:j])[:, None] * logs[np.concatenate(at[i:j])], starts, axis=0)
        i = j
    return out


def _loaded(block, blocks: int) -> np.ndarray:
    """A broadcast matrix. Of several, a worker holds one at a time."""
    if blocks == 1 or getattr(block, "_path", None) is None:
        return block.value
    return block.load_from_path(block._path)


def train(docs: DataFrame, sample_per_lang: int = SAMPLE_PER_LANG) -> Model:
    """Learns from text and lang of documents outside the held-out fold; only languages, the last id of each one's sample and
    counts of fixed size a language reach the driver, the counts by blocks of languages."""
    spark = docs.sparkSession
    key = F.struct(F.xxhash64("doc_id").alias("h"), F.col("doc_id").alias("id"))
    usable = docs.select("doc_id", "lang", "text").filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    ids = stage_table(usable.select("doc_id", "lang"), "learned")
    sizes = {r["lang"]: r["count"] for r in ids.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    large = [lang for lang in langs if sizes[lang] > sample_per_lang]
    last = []
    for lang in large:
        part = ids.filter(F.col("lang") == lang).select(key.alias("key")).orderBy("key").limit(sample_per_lang)
        last.append((lang, *part.agg(F.max("key").alias("key")).first()["key"]))

    discard(ids)

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in small(batches):
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                if flat := letters(text):
                    x = np.bincount(buckets(flat), minlength=BUCKETS)
                    sums[lang] = sums[lang] + x if lang in sums else x
            if len(sums) > BLOCK:
                yield from counted(sums)
                sums = {}
        yield from counted(sums)

    def counted(sums):
        for lang, x in sums.items():
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(x[at], pa.int64())], names=["lang", "bucket", "n"])

    ends = F.broadcast(spark.createDataFrame(last, f"lang string, h long, id {docs.schema['doc_id'].dataType.simpleString()}"))
    chosen = usable.join(ends, "lang", "left").filter(F.col("h").isNull() | (key <= F.struct("h", "id"))).select("lang", "text")
    counts = chosen.transform(bounded).mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    parts = [langs[i : i + BLOCK] for i in range(0, len(langs), BLOCK)]
    if len(parts) > 1:
        counts = stage_table(counts, "ngrams")
    blocks = []
    for part in parts:
        own = counts.filter(F.col("lang").isin(part)).toArrow() if len(parts) > 1 else counts.toArrow()
        number = {lang: i for i, lang in enumerate(part)}
        x = np.full((BUCKETS, len(part)), SMOOTH)
        np.add.at(x, (own["bucket"].to_numpy(), np.array([number[v] for v in own["lang"].to_pylist()], np.int64)), own["n"].to_numpy())
        logs = np.log(x / x.sum(0)).astype(np.float32)
        # several are kept by Spark, not by the driver's Python
        blocks.append(logs if len(parts) == 1 else spark.sparkContext.broadcast(logs))
    if len(parts) > 1:
        discard(counts)
    return Model(langs, blocks)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    context = docs.sparkSession.sparkContext
    sent = [context.broadcast(b) if isinstance(b, np.ndarray) else b for b in model.blocks]  # BUCKETS floats a language
    langs = model.langs

    def run(batches):
        own = Model(langs, sent)
        for b in small(batches):
            got = own.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.transform(bounded).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")

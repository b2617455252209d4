"""Quality classifier: ordinal cumulative-link regression over hashed text features.

P(grade <= k | text) = sigmoid(theta_k - w . x): one weight vector w is shared by all grades, and the thresholds
theta_0 < theta_1 < ... are ordered by construction. x marks which hashed words and token shapes a text has. The model gives
an expected grade and the tail probability P(grade >= cut), by which documents are selected.

Defined results: a null text, or one without a word, has no features: its score is 0 expected grade, tail probability 0, not
kept. Without any labelled row nothing can be learned: the expected grade and the probability are null and every document
with a word is kept. Repeated rows are scored one by one; of rows
that repeat an id, the fit takes the text that sorts first. Several labels of a document count as their lowest grade. Rows
with a null id are scored as any other; labels with a null id or grade are left out. Input columns besides those named are
ignored (or carried through unchanged by select_documents)."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, in_worker, small

#: Hash space of features, and how many labelled rows of each grade the fit may use (those with the smallest id hash).
DIM = 1 << 20
SAMPLE_PER_GRADE = 1500
#: Sampled texts that a feature must occur in, standard errors by which their grades must differ, steps, rows a step, step size, ridge penalty.
MIN_TEXTS, MIN_SHIFT, STEPS, BATCH, RATE, RIDGE = 6, 5.0, 4000, 32, 0.2, 1e-4
MEMO = 150_000
#: Texts below the cut that may stay for each text above it that a floor would lose, as shares of either.
WORTH = 8

_EDGE = re.compile(r"^\W+|\W+$")
_RUNS = ((re.compile(r"[^\W\d_a-zà-öø-ÿ]+"), "A"), (re.compile(r"[^\W\d_A]+"), "a"), (re.compile(r"\d+"), "9"))


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % DIM


def _of_token(token: str) -> tuple[int, int]:
    """Buckets of a token's word and of its shape, such as Aa. or A! or 9:9."""
    shape = token
    for run, sign in _RUNS:
        shape = run.sub(sign, shape)
    shape = re.sub(r"(.)\1+", r"\1", shape[:24])
    return _bucket("w " + _EDGE.sub("", token).lower()), _bucket("s " + shape)


def _of_repeats(tokens: list[str], text: str) -> list[int]:
    """Buckets for how much a text repeats itself: the next word, and whole lines."""
    twins = sum(map(str.__eq__, tokens, tokens[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    again = len(lines) - len(set(lines))
    return [_bucket(f"r {min(9, 20 * twins // len(tokens))}"), _bucket(f"l {min(9, 10 * again // max(1, len(lines)))}")]


class Features:
    """Distinct feature buckets of texts. The memo of tokens is bounded and emptied when full."""

    def __init__(self) -> None:
        self.memo: dict[str, tuple[int, int]] = {}

    def __call__(self, text: str | None) -> list[int]:
        memo, found = self.memo, set()
        if len(memo) > MEMO:
            memo.clear()
        tokens = text.split() if text else []
        for token in set(tokens):
            pair = memo.get(token)
            if pair is None:
                pair = memo[token] = _of_token(token)
            found.update(pair)
        if tokens:
            found.update(_of_repeats(tokens, text))
        return sorted(found)


@dataclass
class OrdinalModel:
    """buckets: those with a weight, ascending; thresholds: ascending, one fewer than grades; floors: for each cut, the least
    tail probability of a selected text."""

    buckets: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    floors: list[float] = field(default_factory=list)

    def score(self, rows: list[list[int]]) -> np.ndarray:
        out = np.zeros(len(rows))
        for i, row in enumerate(rows):
            if row and len(self.buckets):
                x = np.asarray(row, np.int64)
                at = np.minimum(np.searchsorted(self.buckets, x), len(self.buckets) - 1)
                out[i] = self.weights[at[self.buckets[at] == x]].sum()
        return out

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... a column each."""
        return 1 - _sigmoid(self.thresholds[None, :] - score[:, None])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: list[list[int]], grades: list[int], n_grades: int, weights: list[float] | None = None, seed: int = 7) -> OrdinalModel:
    """Weighted maximum likelihood by AdaGrad in small batches; the same sample gives the same model."""
    y = np.asarray(grades, np.int64)
    mass = np.ones(len(y)) if weights is None else np.asarray(weights) / np.mean(weights)
    flat, sizes = np.concatenate([np.asarray(r, np.int64) for r in rows] or [np.zeros(0, np.int64)]), np.array([len(r) for r in rows], np.int64)
    names, where, counts = np.unique(flat, return_inverse=True, return_counts=True)
    # a feature takes part if the grades of the texts that have it differ from all texts' by more than chance
    shift = np.zeros(len(names))
    for k in range(n_grades - 1):
        over = (y > k).astype(float)
        shift = np.maximum(shift, np.abs(np.bincount(where, np.repeat(over - over.mean(), sizes), len(names))) / np.sqrt(np.maximum(counts, 1)) / max(over.std(), 1e-9))
    names = names[(counts >= MIN_TEXTS) & (shift >= MIN_SHIFT)]
    at = np.minimum(np.searchsorted(names, flat), max(len(names) - 1, 0))
    known = names[at] == flat if len(names) else np.zeros(len(flat), bool)
    owner = np.repeat(np.arange(len(rows)), sizes)[known]
    cols = at[known]
    start = np.searchsorted(owner, np.arange(len(rows) + 1))
    # theta_0, then logarithms of the gaps: any values are ordered thresholds
    below = np.clip([(mass * (y <= k)).mean() for k in range(n_grades - 1)], 0.02, 0.98)
    first = np.log(below / (1 - below))
    raw = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 0.05))])
    w, gw, gt = np.zeros(len(names)), np.full(len(names), 1e-2), np.full(len(raw), 1e-2)
    rng = np.random.default_rng(seed)
    for _ in range(-(-STEPS * BATCH // max(len(rows), 1))):
        order = rng.permutation(len(rows))
        for b in range(0, len(order), BATCH):
            pick = order[b : b + BATCH]
            spans = [cols[start[i] : start[i + 1]] for i in pick]
            ids, lens = np.concatenate(spans), np.array([len(x) for x in spans])
            s = np.bincount(np.repeat(np.arange(len(pick)), lens), w[ids], len(pick))
            theta = np.concatenate([raw[:1], raw[:1] + np.cumsum(np.exp(raw[1:]))])
            padded = np.concatenate([[-1e9], theta, [1e9]])
            hi, lo = _sigmoid(padded[y[pick] + 1] - s), _sigmoid(padded[y[pick]] - s)
            ds = (hi + lo - 1) * mass[pick]
            gap = np.maximum(hi - lo, 1e-9)
            dt = np.zeros(n_grades + 1)
            np.add.at(dt, y[pick] + 1, mass[pick] * hi * (1 - hi) / gap)
            np.add.at(dt, y[pick], -mass[pick] * lo * (1 - lo) / gap)
            dt = dt[1:-1]
            draw = np.array([dt.sum(), *(np.exp(raw[k]) * dt[k:].sum() for k in range(1, len(raw)))]) / len(pick)
            near = np.unique(ids)
            dw = np.bincount(np.searchsorted(near, ids), np.repeat(ds, lens), len(near)) / len(pick) - RIDGE * w[near]
            gw[near] += dw * dw
            w[near] += RATE * dw / np.sqrt(gw[near])
            gt += draw * draw
            raw = raw + RATE * draw / np.sqrt(gt)
    keep = np.abs(w) > 1e-3
    return OrdinalModel(names[keep], w[keep], np.concatenate([raw[:1], raw[:1] + np.cumsum(np.exp(raw[1:]))]))


def best_floor(tail: np.ndarray, good: np.ndarray) -> float:
    """The tail probability that parts good rows from others best on the sample; a good row lost costs WORTH others kept.
    It lies midway between the two neighbouring values; 0.5 if the sample has only one kind."""
    if good.all() or not good.any():
        return 0.5
    values, at = np.unique(tail, return_inverse=True)
    lost = np.cumsum(np.bincount(at, good, len(values))) / good.sum()
    caught = np.cumsum(np.bincount(at, ~good, len(values))) / (~good).sum()
    gain = caught - WORTH * lost
    i = int(np.argmax(gain))
    if gain[i] <= 0:
        return 0.0
    return float((values[i] + values[min(i + 1, len(values) - 1)]) / 2)


def train(docs: DataFrame, grades: DataFrame, n_grades: int, sample_per_grade: int = SAMPLE_PER_GRADE) -> OrdinalModel | None:
    """docs: doc_id, text; grades: doc_id, grade (0 .. n_grades-1). None if no labelled document has a word.

    The fit uses at most sample_per_grade rows of each grade, chosen by hashed id; only their feature lists reach the
    driver, and only their ids are broadcast, so both are bounded at any input size."""
    graded = grades.filter("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    sample = None
    for k in range(n_grades):
        part = graded.filter(F.col("grade") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_per_grade)
        sample = part if sample is None else sample.unionByName(part)

    def lists(batches):
        features = in_worker("quality_features", DIM, Features)
        for b in small(batches):
            rows = [features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("grade"), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "grade", "x"])

    # rows that repeat an id count once, with the text that sorts first, so that the sample bounds what is fitted
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text")).select(F.col("doc_id").cast("long").alias("doc_id"), "grade", "text")
    got = chosen.transform(bounded).mapInArrow(lists, "doc_id long, grade int, x array<int>").toArrow().sort_by("doc_id")
    rows, y = got["x"].to_pylist(), got["grade"].to_pylist()
    used = [i for i, r in enumerate(rows) if r]
    if not used:
        return None
    rows, y = [rows[i] for i in used], np.array([y[i] for i in used])
    model = fit(rows, y, n_grades)
    model.floors = [best_floor(tail, y >= k + 1) for k, tail in enumerate(model.tails(model.score(rows)).T)]
    return model


def _judge(model: OrdinalModel | None, texts: list, cut: int, features: Features, floor: float | None):
    rows = [features(t) for t in texts]
    some = np.array([bool(r) for r in rows], bool)
    if model is None:
        return None, None, some
    tails = model.tails(model.score(rows))
    grade, tail = np.where(some, tails.sum(1), 0.0), np.where(some, tails[:, cut - 1], 0.0)
    return grade, tail, some & (tail >= (model.floors[cut - 1] if floor is None else floor))


def score_documents(docs: DataFrame, model: OrdinalModel | None, cut: int, floor: float | None = None) -> DataFrame:
    """doc_id, expected_grade, p_tail = P(grade >= cut), kept = p_tail >= floor, by default the model's own."""

    def run(batches):
        features = in_worker("quality_features", DIM, Features)
        for b in small(batches):
            grade, tail, kept = _judge(model, b.column("text").to_pylist(), cut, features, floor)
            none = pa.nulls(b.num_rows, pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), none if grade is None else pa.array(grade), none if tail is None else pa.array(tail), pa.array(kept)], names=["doc_id", "expected_grade", "p_tail", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(bounded).mapInArrow(run, "doc_id long, expected_grade double, p_tail double, kept boolean")


def select_documents(docs: DataFrame, model: OrdinalModel | None, cut: int, floor: float | None = None) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    at = docs.columns.index("text")

    def run(batches):
        features = in_worker("quality_features", DIM, Features)
        for b in small(batches):
            yield b.filter(pa.array(_judge(model, b.column(at).to_pylist(), cut, features, floor)[2]))

    return docs.transform(bounded).mapInArrow(run, docs.schema)


def grades_of_labels(labels: DataFrame) -> DataFrame:
    """Ratings from the two label columns: 0 toxic, 1 poor, 2 good. A label without any rating is left out."""
    rated = labels.filter("quality is not null or toxic is not null")
    return rated.select("doc_id", F.when(F.col("toxic") > 0, 0).when(F.coalesce("quality", F.lit(1)) > 0, 2).otherwise(1).alias("grade"))

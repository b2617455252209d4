"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k edits is split into k + 1 pieces: a passage within k edits of the item keeps at least
one piece unchanged. An Aho-Corasick automaton over all pieces finds exact hits in one pass over a text; around each hit
Myers' bit-parallel distance verifies the item. Items and texts are compared as lower-cased words joined by one space, so
case, punctuation and white space cost no edits.

Defined results: null texts, null items and items without a letter or digit match nothing. Items too short for an error
match whole words only. Every item id of repeated items
is reported, and repeated documents are reported one by one. An item is reported for each of its disjoint occurrences, from left
to right: the first end within the budget opens one, of the ends up to 2k further the least distance counts (ties: the leftmost end,
then the latest start), and the search goes on behind it. Extra input
columns are ignored (carried through unchanged by clean_documents)."""

from __future__ import annotations

import re
from collections import defaultdict

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, discard, in_worker, small, stage_table

#: Error budget: edits a hundred characters, but never so many that pieces get shorter than PIECE characters.
RATE, PIECE = 8, 16
#: Characters of items held in memory at once; a larger benchmark is matched in blocks of about this size.
BLOCK_CHARS = 16_000_000
#: Characters of a text that are copied at a time.
PIECE_OF_TEXT = 4096

_WORD = re.compile(r"[^\W_]+")


def normal(text: str) -> str:
    return " ".join(_WORD.findall(text)).lower()


def budget(length: int) -> int:
    return max(0, min(length * RATE // 100, length // PIECE - 1))


def pieces(item: str) -> list[tuple[int, str]]:
    """(offset, piece) of k + 1 pieces of nearly equal length."""
    n = budget(len(item)) + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def bordered(item: str) -> str:
    """An item without a budget has to stand on word borders, so they are part of it."""
    return item if budget(len(item)) else f" {item} "


class Pattern:
    """Myers' bit vectors of one item: rows are bits of a Python integer of any length."""

    def __init__(self, item: str, k: int | None = None) -> None:
        self.item, self.size, self.k = item, len(item), budget(len(item)) if k is None else k
        self.full, self.high = (1 << self.size) - 1, 1 << (self.size - 1)
        self.ahead, self.back = self._masks(item), self._masks(item[::-1])

    @staticmethod
    def _masks(item: str) -> dict[str, int]:
        out: dict[str, int] = defaultdict(int)
        for i, c in enumerate(item):
            out[c] |= 1 << i
        return dict(out)

    def best(self, text: str, masks: dict[str, int]) -> tuple[int, int]:
        """Least distance of the item to a substring of text, and the first end of one."""
        full, high = self.full, self.high
        plus, minus, score = full, 0, self.size
        least, end = score, 0
        for j, c in enumerate(text, 1):
            same = masks.get(c, 0)
            across = (((same & plus) + plus) ^ plus) | same
            same |= minus
            up = minus | (full & ~(across | plus))
            down = plus & across
            if up & high:
                score += 1
            elif down & high:
                score -= 1
                if score < least:
                    least, end = score, j
            up = (up << 1) & full
            plus = ((down << 1) & full) | (full & ~(same | up))
            minus = up & same
        return least, end

    def first(self, text: str, lo: int, hi: int) -> tuple[int, int] | None:
        """(distance, end) of the first occurrence that ends in text[lo:hi]: the least distance among the first end within the
        budget and the ends up to 2k further."""
        full, high, masks = self.full, self.high, self.ahead
        plus, minus, score = full, 0, self.size
        found, until = None, hi
        for base in range(lo, hi, PIECE_OF_TEXT):
            for j, c in enumerate(text[base : min(hi, base + PIECE_OF_TEXT)], base + 1):
                same = masks.get(c, 0)
                across = (((same & plus) + plus) ^ plus) | same
                same |= minus
                up = minus | (full & ~(across | plus))
                down = plus & across
                if up & high:
                    score += 1
                elif down & high:
                    score -= 1
                if j > until:
                    return found
                if score <= self.k and (found is None or score < found[0]):
                    if found is None:
                        until = min(hi, j + 2 * self.k)
                    found = score, j
                up = (up << 1) & full
                plus = ((down << 1) & full) | (full & ~(same | up))
                minus = up & same
        return found

    def each(self, text: str, lo: int, hi: int):
        """(distance, start, end) of the disjoint occurrences in text[lo:hi], from left to right."""
        while (found := self.first(text, lo, hi)) is not None:
            least, end = found
            reach = text[max(lo, end - self.size - self.k) : end]
            yield least, end - self.best(reach[::-1], self.back)[1], end
            # items without a budget share the border between two of them
            lo = end - (self.k == 0)


class Matcher:
    """Automaton and bit vectors for a block of items (id, normalised text)."""

    def __init__(self, items: list[tuple[int | None, str]]) -> None:
        self.ids, self.patterns = [i for i, _ in items], [Pattern(bordered(t), budget(len(t))) for _, t in items]
        at: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, item) in enumerate(items):
            for offset, piece in pieces(item) if budget(len(item)) else [(0, bordered(item))]:
                at[piece].append((n, offset))
        self.found = ahocorasick.Automaton()
        for piece, places in at.items():
            self.found.add_word(piece, (len(piece), places))
        if at:
            self.found.make_automaton()

    def windows(self, text: str):
        """(item, lo, hi): stretches of text around piece hits that agree on where the item would start."""
        starts: dict[int, list[int]] = defaultdict(list)
        for end, (length, places) in self.found.iter(text):
            for n, offset in places:
                starts[n].append(end + 1 - length - offset)
        for n, at in starts.items():
            k, size = self.patterns[n].k, self.patterns[n].size
            at.sort()
            first = last = at[0]
            for s in [*at[1:], None]:
                if s is not None and s - last <= k:
                    last = s
                    continue
                yield n, max(0, first - k), last + size + k
                first = last = s

    def matches(self, text: str | None):
        """(item number, distance, start, end) in code points of the original text."""
        if not text or not self.patterns:
            return
        flat, spans, now, after = f" {normal(text)} ", None, None, 0
        for n, lo, hi in self.windows(flat):
            # windows of one item come in order and may overlap by an occurrence
            now, after = n, after if n == now else 0
            for hit in self.patterns[n].each(flat, max(lo, after), hi):
                after = hit[2] - (self.patterns[n].k == 0)
                spans = spans or _places(text)
                start, end = hit[1] + (flat[hit[1]] == " "), hit[2] - (flat[hit[2] - 1] == " ")
                yield n, hit[0], _original(spans, start - 1, False), _original(spans, end - 1, True)

    def any(self, text: str | None) -> bool:
        return any(True for _ in self.matches(text))


def _places(text: str) -> list[tuple[int, int, int, int]]:
    """(start in normalised text, end there, start in text, end in text) of each word."""
    out, at = [], 0
    for m in _WORD.finditer(text):
        length = len(m[0].lower())
        out.append((at, at + length, m.start(), m.end()))
        at += length + 1
    return out


def _original(spans: list[tuple[int, int, int, int]], at: int, is_end: bool) -> int:
    """Where a normalised offset lies in the text; inside a word whose length changed, at the word's edge."""
    import bisect

    i = max(0, bisect.bisect_right(spans, at, key=lambda s: s[0]) - 1) if not is_end else max(0, bisect.bisect_left(spans, at, key=lambda s: s[0]) - 1)
    a, b, start, end = spans[i]
    if b - a == end - start:
        return start + min(at - a, b - a)
    return end if is_end else start


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS):
    """The number of blocks, then the items as lists of (id, normalised text), each of about block_chars characters. A block is
    made when it is asked for; users write the rows of one block before they ask for the next, so that driver, plan and
    executors hold one at a time, whatever the benchmark's size."""
    usable = benchmark.select("item_id", "text").filter("text is not null")
    total = usable.agg(F.coalesce(F.sum(F.length("text") + 16), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-total // block_chars))
    yield n
    for i in range(n):
        part = usable.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else usable
        yield sorted(((r["item_id"], t) for r in part.collect() if (t := normal(r["text"]))), key=lambda x: (x[0] is None, x))


def _digest(items: list[tuple[int | None, str]]) -> str:
    return xxhash.xxh3_128_hexdigest(repr(items).encode("utf-8", "surrogatepass"))


def contaminated(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each occurrence: doc_id, item_id, distance (edits), start and end (code points of the text)."""
    out, blocks = None, item_blocks(benchmark, block_chars)
    several = next(blocks) > 1
    for items in blocks:

        def run(batches, items=items, key=_digest(items)):
            matcher = in_worker("decontam", key, lambda: Matcher(items))
            for b in small(batches):
                rows = [(d, matcher.ids[n], k, s, e) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) for n, k, s, e in matcher.matches(t)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 5, names=["doc_id", "item_id", "distance", "start", "end"])

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(bounded).mapInArrow(run, "doc_id long, item_id long, distance long, start long, end long")
        if several:
            part = stage_table(part, "matches")
        out = part if out is None else out.unionByName(part)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs without any benchmark item, with all their columns."""
    at, blocks = docs.columns.index("text"), item_blocks(benchmark, block_chars)
    several = next(blocks) > 1
    before = None
    for items in blocks:

        def run(batches, items=items, key=_digest(items)):
            matcher = in_worker("decontam", key, lambda: Matcher(items))
            for b in small(batches):
                yield b.filter(pa.array([not matcher.any(t) for t in b.column(at).to_pylist()], pa.bool_()))

        docs = docs.transform(bounded).mapInArrow(run, docs.schema)
        if several:
            docs = stage_table(docs, "clean")
            if before is not None:
                discard(before)
            before = docs
    return docs

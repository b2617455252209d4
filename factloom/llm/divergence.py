"""Quality rules by distribution divergence.

Each language of the corpus has a reference: its histogram of character classes and its histogram of common words, counted
over all documents of that language. A document is compared with every reference by Jensen-Shannon distance (0 to 1), and
passes if it is near enough to one of them in all of three histograms: of character classes, of common words with a column for
all other words, and of these two sums alone (how much of the text is common words at all). Short documents have noisy
histograms: a test is left out below a least length, and the limits of the word tests follow from the reference itself, as the
distance that nearly all texts of so many words drawn from it stay within, and an allowance for what real texts differ by.

The common words of a language are all words with at least COMMON of its words. They are found exactly without counting every
distinct word: a batch reports the words with at least COMMON/2 of its own, so a common word's reports sum to at least
COMMON/2 of the language, which at most 2/COMMON words can reach; a second pass counts just those.

Defined results: null texts have no words, and fail. Documents with a null language are in no reference, but are compared
with all. A language with fewer than LEAST_REFERENCE words has no reference, as its histograms would be noise; only the base
rules decide on its documents, and on all where there is no reference. Repeated rows and null ids are treated as any other row; extra columns are ignored."""

from __future__ import annotations

import sys
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, once, small

#: Base rules: least words, and most hundredths of words in repeated five-word windows.
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
#: Share of a language's words from which a word is common.
COMMON = 1 / 1000
#: Words from which a language has a reference: a common word then is there five times. Languages compared with at once.
LEAST_REFERENCE, BLOCK = 5000, 256
#: Least items of a histogram for its test. The limit of the character test is CHAR_LIMIT + CHAR_SLACK / sqrt(characters).
LEAST_CHARS, LEAST_TEST_WORDS = 60, 20
CHAR_LIMIT, CHAR_SLACK = 0.18, 0.9
#: Limits of the word tests are sqrt(spread^2 + allowance^2); the spread is this quantile of so many texts drawn from the
#: reference, at these lengths.
QUANTILE, DRAWS, LENGTHS = 0.995, 300, (20, 30, 45, 70, 100, 150, 250, 400, 700, 1200, 2500, 6000)
WORD_ALLOWANCE, SHARE_ALLOWANCE = 0.12, 0.2

_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
#: Class of a code point: small letter, capital, digit, space, sentence mark, other sign; beyond ASCII small letter, capital,
#: other letter, other sign.
_CLASSES = 10
_PIECE = 1 << 20


def _class_table() -> np.ndarray:
    def of(c: str) -> int:
        if c.isascii():
            return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c in _SPACES else 4 if c in ".,;:?'\"()-" else 5
        return 6 if c.islower() else 7 if c.isupper() else 8 if c.isalpha() else 9

    return np.fromiter(map(of, map(chr, range(sys.maxunicode + 1))), np.uint8, sys.maxunicode + 1)


def char_classes(text: str) -> np.ndarray:
    """Code points of each class."""
    out, table = np.zeros(_CLASSES, np.int64), once("char_classes", _class_table)
    for i in range(0, len(text), _PIECE):
        out += np.bincount(table[np.frombuffer(text[i : i + _PIECE].encode("utf-32-le"), np.uint32)], minlength=_CLASSES)
    return out


#: Words are compared in lower case and without sentence marks.
_PLAIN = bytes(32 if chr(b) in '.,;:?!"()' else b + 32 if 65 <= b <= 90 else b for b in range(256))


def plain_words(raw: bytes) -> list[bytes]:
    return raw.translate(_PLAIN).split()


def repeated_words(words: list[bytes]) -> int:
    """Words in five-word windows that the text has twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        mixed = (mixed ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    return len(lines) - len(set(lines))


@dataclass
class References:
    """Probabilities by language: chars (languages x classes), words (languages x most common words of one, and a rest column).
    own has the numbers of a language's common words in `at`; where it has fewer, the number of no word. spreads: of the word
    and of the share test, at each of LENGTHS."""

    langs: list[str]
    at: dict[bytes, int]
    chars: np.ndarray
    words: np.ndarray
    own: np.ndarray
    spreads: np.ndarray = None

    def __post_init__(self):
        self.known = set(self.langs)
        if self.spreads is None:
            self.spreads = np.array([spread(q) for q in self.words])

    def word_counts(self, words: list[bytes]) -> np.ndarray:
        """Counts of all languages' common words, and a 0 for no word."""
        out = np.zeros(len(self.at) + 1)
        for word, n in Counter(map(self.at.get, words)).items():
            if word is not None:
                out[word] += n
        return out


def _entropy_gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of p, or of each row of p, with each row of q."""
    m = (p + q) / 2

    def toward(x):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log2(x / m), 0).sum(-1)

    return np.sqrt(np.clip((toward(np.broadcast_to(p, q.shape)) + toward(q)) / 2, 0, 1))


def _shares(p: np.ndarray) -> np.ndarray:
    """The sum of all columns but the last, and the last."""
    return np.stack([p[..., :-1].sum(-1), p[..., -1]], -1)


def spread(q: np.ndarray) -> np.ndarray:
    """Distances from q, of words and of shares, that QUANTILE of texts drawn from q stay within, at each of LENGTHS."""
    rng, q = np.random.default_rng(1), np.append(q[:-1][q[:-1] > 0], q[-1])
    out = []
    for n in LENGTHS:
        drawn = rng.multinomial(n, q / q.sum(), DRAWS) / n
        out.append([np.quantile(_entropy_gap(x, np.broadcast_to(y, x.shape)), QUANTILE) for x, y in ((drawn, q), (_shares(drawn), _shares(q)))])
    return np.array(out).T


def limits(refs: References, n: int) -> np.ndarray:
    """Limits of the word and of the share test for a text of n words (languages x 2); beyond LENGTHS spreads fall with sqrt(n)."""
    at = np.interp(np.log(n), np.log(LENGTHS), np.arange(len(LENGTHS)))
    low = int(at)
    high = min(low + 1, len(LENGTHS) - 1)
    own = refs.spreads[:, :, low] * (1 - (at - low)) + refs.spreads[:, :, high] * (at - low)
    return np.sqrt((own * np.sqrt(min(1.0, LENGTHS[-1] / n))) ** 2 + np.array([WORD_ALLOWANCE, SHARE_ALLOWANCE]) ** 2)


def distances(refs: References, text: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distance from each language by character classes, common words, and the share of common words."""
    chars, counts = char_classes(text).astype(float), refs.word_counts(words)
    by_char = _entropy_gap(chars / max(chars.sum(), 1), refs.chars)
    by_word, by_share = np.zeros(len(refs.langs)), np.zeros(len(refs.langs))
    for i in range(0, len(by_word), BLOCK):
        own = counts[refs.own[i : i + BLOCK]]
        p, q = np.hstack([own, len(words) - own.sum(1, keepdims=True)]) / max(len(words), 1), refs.words[i : i + BLOCK]
        by_word[i : i + BLOCK], by_share[i : i + BLOCK] = _entropy_gap(p, q), _entropy_gap(_shares(p), _shares(q))
    return by_char, by_word, by_share


def learn(docs: DataFrame) -> References | None:
    """References over all documents; what reaches the driver is bounded by COMMON for each language that has a reference."""
    known = docs.select("lang", "text").filter("lang is not null and text is not null")

    def heavy(batches):
        for b in small(batches):
            chars, words = {}, {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                chars[lang] = chars.get(lang, 0) + char_classes(text)
                words.setdefault(lang, Counter()).update(plain_words(text.encode()))
            rows = [(lang, f"c{i}", None, int(n)) for lang, x in chars.items() for i, n in enumerate(x)]
            for lang, counted in words.items():
                total = sum(counted.values())
                rows.append((lang, "n", None, total))
                rows += [(lang, "w", w, n) for w, n in counted.items() if n >= COMMON / 2 * total]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.binary(), pa.int64()))] if rows else [pa.array([], t) for t in (pa.string(), pa.string(), pa.binary(), pa.int64())], names=["lang", "kind", "word", "n"])

    summed = known.transform(bounded).mapInArrow(heavy, "lang string, kind string, word binary, n long").groupBy("lang", "kind", "word").agg(F.sum("n").alias("n"))
    summed = summed.persist()
    try:
        totals = summed.filter("kind = 'n'").select("lang", F.col("n").alias("total"))
        kept = totals.filter(F.col("total") >= LEAST_REFERENCE)
        stats = summed.filter("kind <> 'w'").join(F.broadcast(kept), "lang").select("lang", "kind", "n").collect()
        maybe = summed.filter("kind = 'w'").join(F.broadcast(kept), "lang").filter(F.col("n") >= COMMON / 2 * F.col("total")).select("lang", "word").collect()
    finally:
        summed.unpersist()
    langs = sorted({r["lang"] for r in stats})
    if not langs:
        return None
    asked: dict[str, set[bytes]] = {lang: set() for lang in langs}
    for r in maybe:
        asked[r["lang"]].add(bytes(r["word"]))

    def count(batches):
        for b in small(batches):
            out: dict[str, Counter] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if lang in asked:
                    out.setdefault(lang, Counter()).update(filter(asked[lang].__contains__, plain_words(text.encode())))
            rows = [(lang, w, n) for lang, x in out.items() for w, n in x.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.binary(), pa.int64()))], names=["lang", "word", "n"])

    exact = known.transform(bounded).mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).collect()
    total = {r["lang"]: r["n"] for r in stats if r["kind"] == "n"}
    common: dict[str, dict[bytes, int]] = {lang: {} for lang in langs}
    for r in exact:
        if r["n"] >= COMMON * total[r["lang"]]:
            common[r["lang"]][bytes(r["word"])] = r["n"]
    at = {w: i for i, w in enumerate(sorted(set().union(*common.values())))}
    most = max(map(len, common.values()))
    words, own = np.zeros((len(langs), most + 1)), np.full((len(langs), most), len(at), np.int32)
    chars, number = np.zeros((len(langs), _CLASSES)), {lang: i for i, lang in enumerate(langs)}
    for i, lang in enumerate(langs):
        for k, (w, n) in enumerate(sorted(common[lang].items())):
            words[i, k], own[i, k] = n, at[w]
        words[i, -1] = total[lang] - words[i].sum()
        words[i] /= max(total[lang], 1)
    for r in stats:
        if r["kind"] != "n":
            chars[number[r["lang"]], int(r["kind"][1:])] = r["n"]
    return References(langs, at, chars / np.maximum(chars.sum(1, keepdims=True), 1), words, own)


def judge(refs: References | None, text: str | None, lang: str | None = None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, nearest language, three distances. lang only
    tells whether the text's language has a reference."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, _SPACES))
    repeated = repeated_words(words)
    failed = n < LEAST_WORDS or 100 * repeated > MOST_REPEATED * n
    base = (n, word_chars, sum(map(text.count, _SYMBOLS)), duplicate_lines(text), repeated, failed)
    plain = plain_words(raw)
    if refs is None or not n or (lang is not None and lang not in refs.known):
        return (*base, not failed, None, None, None, None)
    by_char, by_word, by_share = distances(refs, text, plain)
    over = (by_char - (CHAR_LIMIT + CHAR_SLACK / np.sqrt(len(text)))) * (word_chars >= LEAST_CHARS)
    if len(plain) >= LEAST_TEST_WORDS:
        most = limits(refs, len(plain))
        over = np.maximum(over, np.maximum(by_word - most[:, 0], by_share - most[:, 1]))
    near = int(np.argmin(over + (by_char + by_word) * 1e-6))
    return (*base, not failed and bool(over[near] <= 0), refs.langs[near], float(by_char[near]), float(by_word[near]), float(by_share[near]))


_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, nearest_lang string, js_chars double, js_words double, js_share double"


def apply_rules(docs: DataFrame, refs: References | None) -> DataFrame:
    """A row for each document: the base figures, base_failed, kept, and the distances from the nearest reference."""
    kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.string()] + [pa.float64()] * 3

    def run(batches):
        for b in small(batches):
            rows = [(d, *judge(refs, t, x)) for d, t, x in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "lang")))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in _SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").transform(bounded).mapInArrow(run, _SCHEMA)

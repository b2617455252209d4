"""Token counts by finite-state tokenizer compilation.

A piece vocabulary that merges by score is a finite-state matter: in a correct segmentation every two adjacent pieces are
themselves segmented into these two, and every prefix of a text has exactly one last piece. The transducer's state is the
set of vocabulary prefixes that end at the current place, each with the piece before it and the tokens counted there; it is
deterministic, compiled as texts need it, and each transition carries the tokens that it adds (or, as pieces merge, takes
back).

A chunk of text is summed up by its state map: from the state before it to the state behind it and the tokens added. Maps
compose associatively, without text, and a prefix scan over a text's chunks gives its count. A map is compiled for the state
that the characters before the chunk lead to; should another one come, the chunk is run from that, too. No piece has a space
after another character, so the machine is back in its first state at each such place, from which the map of a stretch up to
the next one is one number, kept in a bounded memo.

Defined results: null and empty texts have no bytes and no tokens. A character outside the vocabulary counts as its bytes.
Repeated rows and null ids are counted as any others; extra columns are ignored."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, in_worker, small

LIMIT = 4096
#: Characters of a chunk, and before it that its first state is taken from; entries of the memo of stretches, states of the
#: machine, and remembered pairs before they are emptied and compiled anew.
CHUNK, LEAD, MEMO, STATES, PAIRS = 1 << 13, 64, 500_000, 200_000, 500_000
SPACE = "▁"

#: The first state: no prefix but the empty one, and no piece before it.
START = ((0, None, 0),)

_STRETCH = re.compile(r" *[^ ]+| +")


class Machine:
    """scores: piece -> score; a higher score merges first, leftmost on ties."""

    def __init__(self, scores: dict[str, float]) -> None:
        #: Turn in which a piece is merged, and the two pieces that it is merged from; characters are there from the start.
        self.turn: dict[str, int] = {}
        self.halves: dict[str, tuple[str, str]] = {}
        order = {p: i for i, p in enumerate(sorted(scores, key=lambda p: -scores[p]))}
        self.trie: list[dict[str, int]] = [{}]
        self.piece_at: list[str | None] = [None]
        for piece in scores:
            halves = self._halves(piece, order)
            if halves is None and len(piece) > 1:
                continue  # never stands in a segmentation
            node = 0
            for c in piece:
                nxt = self.trie[node].get(c)
                if nxt is None:
                    nxt = self.trie[node][c] = len(self.trie)
                    self.trie.append({})
                    self.piece_at.append(None)
                node = nxt
            self.piece_at[node] = piece
            if halves:
                self.halves[piece], self.turn[piece] = halves, order[piece]
        self.pairs: dict[tuple[str, str], bool] = {}
        self._restart()

    def _restart(self) -> None:
        self.states: list[tuple] = [START]
        self.number: dict[tuple, int] = {START: 0}
        self.moves: list[dict[str, tuple[int, int]]] = [{}]

    @staticmethod
    def _halves(piece: str, order: dict[str, int]) -> tuple[str, str] | None:
        """The last merge of a piece by definition; None if it doesn't come to be."""
        parts = list(piece)
        while len(parts) > 2:
            best = min(((order[p], i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in order), default=None)
            if best is None:
                return None
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def adjacent(self, left: str, right: str) -> bool:
        """Whether the two pieces, side by side, stay as they are: going back from the later of the two merges, no merge over
        the border may have come before it."""
        key = (left, right)
        found = self.pairs.get(key)
        if found is not None:
            return found
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        turn, before, found = self.turn, len(self.turn) * 2 + 10**6, True
        while True:
            over = turn.get(left + right)
            if over is not None and over < before:
                found = False
                break
            a, b = turn.get(left, -1), turn.get(right, -1)
            if a < 0 and b < 0:
                break
            if a > b:
                before, left = a, self.halves[left][1]
            else:  # on a tie the left one came first
                before, right = b + 1, self.halves[right][0]
        self.pairs[key] = found
        return found

    def compile(self, state: tuple, c: str) -> tuple[tuple, int]:
        """The transition: next state and tokens added. A state lists (vocabulary prefix, piece before it, tokens up to
        there less tokens up to here)."""
        if c not in self.trie[0]:
            return START, len(c.encode("utf-8", "surrogatepass"))
        last, count, ahead = None, 0, []
        for node, before, tokens in state:
            nxt = self.trie[node].get(c)
            if nxt is not None:
                ahead.append((nxt, before, tokens))
                piece = self.piece_at[nxt]
                if last is None and piece is not None and (before is None or self.adjacent(before, piece)):
                    last, count = piece, tokens + 1
        return (*((n, b, t - count) for n, b, t in ahead if self.trie[n]), (0, last, 0)), count

    def _numbered(self, state: tuple) -> int:
        """A state's number; if there are too many, all others are forgotten. Numbers from before then hold no more."""
        number = self.number.get(state)
        if number is None:
            if len(self.states) >= STATES:
                self._restart()
                if state == START:
                    return 0
            number = self.number[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
        return number

    def run(self, text: str, entry: tuple = None) -> tuple[tuple, int]:
        """The state after a text, and the tokens added, from a state, by default the first."""
        state, total = self._numbered(entry or START), 0
        moves = self.moves
        for c in text:
            move = moves[state].get(c)
            if move is None:
                held, own = self.states, moves[state]
                after, add = self.compile(held[state], c)
                number = self._numbered(after)
                move = (number, add)
                if self.states is held:
                    own[c] = move
                moves = self.moves
            state, add = move
            total += add
        return self.states[state], total


@dataclass
class ChunkMap:
    """What a chunk does to the machine: moves from the states before it to the state behind it and the tokens added; other
    gives the move from a state that isn't among them."""

    moves: dict[tuple, tuple[tuple, int]]
    other: Callable[[tuple], tuple[tuple, int]]

    def __call__(self, state: tuple) -> tuple[tuple, int]:
        move = self.moves.get(state)
        if move is None:
            move = self.moves[state] = self.other(state)
        return move

    def then(self, after: ChunkMap) -> ChunkMap:
        """This map and then the other; associative."""

        def both(state: tuple) -> tuple[tuple, int]:
            between, n = self(state)
            end, m = after(between)
            return end, n + m

        return ChunkMap({state: both(state) for state in self.moves}, both)


class Counter:
    def __init__(self, scores: dict[str, float]) -> None:
        self.machine, self.memo = Machine(scores), {}

    def stretch(self, text: str) -> int:
        found = self.memo.get(text)
        if found is None:
            found = self.machine.run(text.replace(" ", SPACE))[1]
            if len(text) <= 64:
                if len(self.memo) > MEMO:
                    self.memo.clear()
                self.memo[text] = found
        return found

    def between(self, stretches: list[str]) -> int:
        memo = self.memo
        try:
            return sum([memo[s] for s in stretches])
        except KeyError:
            return sum(map(self.stretch, stretches))

    def run(self, parts: list[str], entry: tuple) -> tuple[tuple, int]:
        """The move over stretches, the first of which goes on from entry and the others each start in the first state."""
        state, n = self.machine.run(parts[0].replace(" ", SPACE), entry)
        if len(parts) == 1:
            return state, n
        state, last = self.machine.run(parts[-1].replace(" ", SPACE))
        return state, n + self.between(parts[1:-1]) + last

    def chunk_map(self, text: str, lo: int, hi: int) -> ChunkMap:
        """The map of text[lo:hi]. A boundary is where a space follows another character."""
        parts = _STRETCH.findall(text[lo:hi])
        if lo == 0 or text[lo] == " " and text[lo - 1] != " ":
            move = self.run(parts, START)
            return ChunkMap({START: move}, lambda state: move)
        before = _STRETCH.findall(text[max(0, lo - LEAD) : lo])[-1]
        entry = self.machine.run(before.replace(" ", SPACE))[0]
        return ChunkMap({entry: self.run(parts, entry)}, lambda state: self.run(parts, state))

    def scan(self, maps: list[ChunkMap]) -> list[ChunkMap]:
        """Maps of all prefixes, by doubling: log(n) rounds in which all places are independent of each other."""
        step = 1
        while step < len(maps):
            maps = maps[:step] + [maps[i - step].then(maps[i]) for i in range(step, len(maps))]
            step *= 2
        return maps

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = " " + (text.replace(SPACE, " ") if SPACE in text else text)  # the model's own prefix
        if len(text) <= CHUNK:
            return self.between(_STRETCH.findall(text))
        return self.scan([self.chunk_map(text, i, min(i + CHUNK, len(text))) for i in range(0, len(text), CHUNK)])[-1](START)[1]


def piece_scores(path: str) -> dict[str, float]:
    """The pieces that text can become, with their scores."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    scores = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not any(f(i) for f in odd)}
    if any(SPACE in p.lstrip(SPACE) for p in scores):
        raise ValueError("pieces that reach over a space have no fixed boundary state")
    return scores


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""
    scores = docs.sparkSession.sparkContext.broadcast(piece_scores(path))  # as large as the vocabulary

    def run(batches):
        counter = in_worker("fst_count", path, lambda: Counter(scores.value))
        for b in small(batches):
            texts = b.column("text").to_pylist()
            n = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(bounded).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

"""Conversation structure repair by a programme over retained subsequences.

A conversation's turns are repaired to the pattern (s?(ua)+)? of role initials: an optional system turn, then user and assistant
in turn, or nothing at all. Keeping a turn is free, giving it another role (user or assistant) costs REROLE, deleting it DELETE,
and an empty turn of user or assistant may be inserted anywhere for INSERT. Blank turns and turns whose role and text were there
before must be deleted; one that breaks off costs INCOMPLETE more if it stays.

The programme chooses the turns that stay, kept or reroled. If the last one that stayed has role q, the next may have role r;
the pair fixes how many turns must be inserted between them (GAP). All turns between the two are deleted, so a gap costs the
difference of two prefix sums of deletions: for each q only the least cost less its prefix sum has to be held, a running
minimum. Equal costs are decided by the audit, the edits' initials in order (D, I, K, R), of which the ASCII-least wins. No
audits are compared for that: the running minima are held in the order of their audits, and a longer audit is ordered by what
it extends and by what it adds. So a turn costs a constant time, and a conversation holds four bytes a turn, never its texts.

The work is two passes over sorted turns, each a stream. plans() sees roles, faults and digests only and gives each
conversation's audit; repaired_turns() lets the texts pass along the audit. A conversation is a sequence and its audit one value
of a row, so one task reads it, however long, batch by batch; nothing of it is collected.

Defined results: null roles and texts are one space; null turns come first and count in no gap; null conversation ids are one
conversation. Turns with the same number are ordered by role and SHA-256 of text, so repeated rows are duplicates of the
first. A role is known by its first character: roles other than s, u and a can only be reroled or deleted. Empty texts are
blank. An empty table has no rows; a conversation all of whose rows have copies = 0 has an empty audit. Extra columns are ignored."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, stage_table

REROLE, DELETE, INSERT, INCOMPLETE = 3, 4, 3, 3
#: Faults of a turn; the first that holds counts.
WHOLE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: What stayed last: nothing, a system turn, a user turn, an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
_STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: Turns to insert from what stayed last to what stays next, and up to the end.
GAP = {START: {SYSTEM: 0, USER: 0, ASSISTANT: 1}, SYSTEM: {USER: 0, ASSISTANT: 1}, USER: {ASSISTANT: 0, USER: 1}, ASSISTANT: {USER: 0, ASSISTANT: 1}}
END = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
#: Pairs (from, inserts) that lead to each role.
_INTO = {r: [(q, GAP[q][r]) for q in GAP if r in GAP[q]] for r in (SYSTEM, USER, ASSISTANT)}
_FITTING = {"su", "ua", "au"}
#: What separates words.
SPACES = " \t\n\x0b\x0c\r"


class Repair:
    """The cheapest edits of one conversation, turn by turn."""

    def __init__(self):
        #: By role that stayed last: least cost less the deletions so far, or None; and the place of its audit in their order.
        self.least: list[int | None] = [0, None, None, None]
        self.order = [0, 0, 0, 0]
        self.deleted = 0
        #: A byte for each turn and state: state before, inserts, letter.
        self.steps = bytearray()

    def add(self, initial: str, fault: int) -> None:
        # (cost less deletions, place of the audit it extends, what it adds, state before, inserts)
        best = [None if self.least[q] is None else (self.least[q], self.order[q], "D", q, 0) for q in range(4)]
        if fault not in (BLANK, DUPLICATE):
            own, extra = _STATE.get(initial), (INCOMPLETE if fault == TRUNCATED else 0) - DELETE
            for r in (SYSTEM, USER, ASSISTANT):
                if r != own and r == SYSTEM:
                    continue
                letter, price = ("K", extra) if r == own else ("R", extra + REROLE)
                for q, inserts in _INTO[r]:
                    if self.least[q] is not None:
                        found = (self.least[q] + INSERT * inserts + price, self.order[q], "I" * inserts + letter, q, inserts)
                        if best[r] is None or found < best[r]:
                            best[r] = found
        self.deleted += DELETE
        for place, r in enumerate(sorted((r for r in range(4) if best[r] is not None), key=lambda r: best[r][1:3])):
            self.order[r] = place
        self.least = [None if b is None else b[0] for b in best]
        self.steps += bytes(0 if b is None else b[3] | b[4] << 2 | "DKR".index(b[2][-1]) << 4 for b in best)

    def close(self) -> tuple[int, str]:
        """The least cost and its audit."""
        cost, _, added, q = min((self.least[q] + INSERT * END[q], self.order[q], "I" * END[q], q) for q in range(4) if self.least[q] is not None)
        back = [added]
        for at in range(len(self.steps) - 4, -1, -4):
            step = self.steps[at + q]
            back.append("I" * (step >> 2 & 3) + "DKR"[step >> 4])
            q = step & 3
        return cost + self.deleted, "".join(reversed(back))


class _Conversation:
    """The counts of one conversation beside its repair."""

    def __init__(self, conv_id):
        self.conv_id, self.repair = conv_id, Repair()
        self.faults, self.illegal, self.before = [0, 0, 0, 0], 0, None
        self.low = self.high = None
        self.distinct = 0

    def add(self, turn, initial, fault, copies):
        if copies and turn is not None:
            if self.low is None:
                self.low = turn
            self.distinct += turn != self.high
            self.high = turn
        for i in range(copies):
            # a copy of a turn that isn't blank repeats it
            now = DUPLICATE if i and fault != BLANK else fault
            self.faults[now] += 1
            self.illegal += self.before is not None and self.before + initial not in _FITTING
            self.before = initial
            self.repair.add(initial, now)

    def row(self):
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        cost, audit = self.repair.close()
        return self.conv_id, gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[TRUNCATED], self.illegal, cost, audit


def damage(conversations: DataFrame) -> DataFrame:
    """The rows conv_id, turn, role, text of conversations with known faults: crc32(`conv_id:turn`) % 20 drops a row (0), empties
    its text (1), removes its sentence ends (2), repeats it (3) or makes it the user's (4). Dropped and repeated rows are told by
    copies, 0 and 2, so that every conversation stays in the table."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20).alias("kind")
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    rows = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind)
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def _ordered(turns: DataFrame) -> DataFrame:
    """turns with defaults, and the digest that orders turns of one number."""
    copies = F.col("copies").cast("int") if "copies" in turns.columns else F.lit(1)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), copies.alias("copies"))
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def _fault(again: Column) -> Column:
    end = F.col("end")
    return F.when(end == "", BLANK).when(again, DUPLICATE).when(~end.isin(".", "!", "?"), TRUNCATED).otherwise(WHOLE)


#: Conversations, or turns, that a batch of results holds.
_ROWS = 1024


def plans(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit: a row for each conv_id of turns (conv_id, turn, role, text
    and, if rows may be absent or repeated, copies)."""
    rows = _ordered(turns).select("conv_id", "turn", "role", "digest", "copies", F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1)).alias("end"))
    # one shuffle: by conv_id alone, which the first occurrences need no other for
    first = Window.partitionBy("conv_id", "role", "digest", F.col("copies") > 0).orderBy(F.col("turn").asc_nulls_first())
    rows = rows.repartition("conv_id").withColumn("again", F.row_number().over(first) > 1)
    rows = rows.select("conv_id", "turn", "role", "digest", "copies", "again", F.left("role", F.lit(1)).alias("initial"), _fault(F.col("again")).alias("fault"))
    rows = rows.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "digest", "again").select("conv_id", "turn", "initial", "fault", "copies")
    kind = turns.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def run(batches):
        now, out = None, []
        for b in batches:
            types = [b.schema.field(0).type, *[pa.int64()] * 6, pa.string()]
            for conv_id, *turn in zip(*(c.to_pylist() for c in b.columns)):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        out.append(now.row())
                    now = _Conversation(conv_id)
                now.add(*turn)
                if len(out) >= _ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                    out = []
        if now is not None:
            out.append(now.row())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return bounded(rows).mapInArrow(run, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


class _Walk:
    """One conversation's turns along its audit."""

    def __init__(self, conv_id, audit: str):
        self.conv_id, self.audit, self.at, self.place, self.last = conv_id, audit, 0, 0, ""

    def _put(self, out, role, text):
        out.append((self.conv_id, self.place, role, text))
        self.place += 1
        self.last = role[:1]

    def _due(self) -> str:
        return "assistant" if self.last == "u" else "user"

    def inserts(self, out):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._put(out, self._due(), "")
            self.at += 1

    def turn(self, out, role, text, copies):
        for _ in range(copies):
            # what is inserted stands before the turn that stays, after those deleted
            self.inserts(out)
            letter = self.audit[self.at]
            self.at += 1
            if letter != "D":
                self._put(out, role if letter == "K" else self._due(), text)


def repaired_turns(turns: DataFrame, planned: DataFrame) -> DataFrame:
    """conv_id, place, role, text: the repaired turns in order, each conversation's next to each other within a partition. planned:
    conv_id and audit of plans(turns). A conversation with an empty result has no row."""
    rows = _ordered(turns).filter("copies > 0").withColumn("head", F.lit(1))
    heads = planned.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).alias("copies"), F.lit(b"").alias("digest"), F.lit(0).alias("head"))
    both = rows.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "head", F.col("turn").asc_nulls_first(), "role", "digest")
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches):
        walk = None
        for b in batches:
            out, types = [], [b.schema.field(0).type, pa.int64(), pa.string(), pa.string()]
            for conv_id, head, role, text, copies in zip(*(c.to_pylist() for c in b.columns)):
                if head == 0:
                    if walk is not None:
                        walk.inserts(out)
                    walk = _Walk(conv_id, text)
                else:
                    walk.turn(out, role, text, copies)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["conv_id", "place", "role", "text"])
        if walk is not None:
            out = []
            walk.inserts(out)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["conv_id", "place", "role", "text"])

    return bounded(both.select("conv_id", "head", "role", "text", "copies")).mapInArrow(run, f"conv_id {kind}, place long, role string, text string")


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id and SHA-256 of the lines `role:text` of repaired_turns(), whose order within partitions it relies on."""
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def run(batches):
        now, digest = None, None
        for b in batches:
            ids, found = [], []
            for conv_id, place, role, text in zip(*(c.to_pylist() for c in b.columns)):
                if place == 0:
                    if digest is not None:
                        ids.append(now), found.append(digest.hexdigest())
                    now, digest = conv_id, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(found, pa.string())], names=["conv_id", "repaired_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], b.schema.field(0).type), pa.array([digest.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])

    return repaired.select("conv_id", "place", "role", "text").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repair(turns: DataFrame) -> DataFrame:
    """plans(turns) and repaired_sha256, the digest of each conversation's repaired turns."""
    planned = stage_table(plans(turns), "plans")
    found = digests(repaired_turns(turns, planned)).withColumnRenamed("conv_id", "own")
    both = planned.join(found, planned["conv_id"].eqNullSafe(found["own"]), "left").drop("own")
    return both.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())))

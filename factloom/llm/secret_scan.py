"""Secret scans over a trigram inverted index; DataFrame functions only.

Each rule's regular expression is turned into a Boolean query of trigrams that a match must hold. The index has a posting
(trigram, doc_id) for each trigram that some query names; intersecting postings gives each rule's candidate documents, and
only those are verified by the expression itself. Rules without a mandatory trigram scan every text.

Texts are not moved for the sake of the index: a document without even the rarest trigram of any query is scanned in place by
the full-scan rules; only the others meet the postings by their id.

Defined results: null and empty texts have no spans, and the digest of the empty string. Every input row gives one row, also
where ids repeat or are null (null ids are matched as a value). Offsets are code points, ends exclusive. Overlapping spans
of different kinds are all reported. Extra input columns are ignored (carried through unchanged by redact_documents)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import _constants as c
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage_table


@dataclass(frozen=True)
class Rule:
    """kind; pattern in the dialect shared by Java and Python; the group measured and its least length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("slack", r"xox[abprs]-[0-9A-Za-z-]{10,}"),
)
RULES = BASE + ADDED
#: Strings that a part of an expression may stand for before it counts as any string.
MOST_STRINGS = 64
#: Letters by how common they are in European text, most common first.
_COMMON = " etaoinsrhldcumpgfbvyw-kj.x_qz"

Alternatives = frozenset[frozenset[str]]


def _strings(op, arg) -> set[str] | None:
    """The finite set of strings that a node of a parsed expression matches, in lower case; None if it is large."""
    if op is c.LITERAL:
        return {chr(arg).lower()}
    if op is c.IN:
        if any(k is not c.LITERAL for k, _ in arg):
            return None
        return {chr(v).lower() for _, v in arg}
    if op is c.SUBPATTERN:
        return _sequence(arg[3])
    if op is c.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if op is c.MAX_REPEAT and arg[1] != c.MAXREPEAT and arg[1] <= 6:
        inner = _sequence(arg[2])
        if inner is None:
            return None
        out, level = set(), {""}
        for n in range(arg[1] + 1):
            out |= level if n >= arg[0] else set()
            level = {a + b for a in level for b in inner}
            if len(level) > MOST_STRINGS:
                return None
        return out
    return None


def _sequence(nodes) -> set[str] | None:
    out = {""}
    for op, arg in nodes:
        part = _strings(op, arg)
        if part is None or len(out) * len(part) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in part}
    return out


def trigram_query(pattern: str) -> list[Alternatives]:
    """Clauses that all hold for a text with a match: each is a set of alternatives, each a set of trigrams that are all in
    the lower-cased text. No clause: the expression names no mandatory trigram."""
    clauses, run = [], {""}

    def flush():
        nonlocal run
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
        if all(sets):
            clauses.append(frozenset(s for s in sets if not any(t < s for t in sets)))
        run = {""}

    for op, arg in _parser.parse(pattern):
        part = _strings(op, arg)
        if part is None or len(run) * len(part) > MOST_STRINGS:
            flush()
            if op is c.MAX_REPEAT and arg[0] > 0 and part is None:
                clauses.extend(x for x in trigram_query_of(arg[2]) if x)
            continue
        run = {a + b for a in run for b in part}
    flush()
    return list(dict.fromkeys(clauses))


def trigram_query_of(nodes) -> list[Alternatives]:
    """Clauses of a repeated part, from its own finite strings only."""
    strings = _sequence(nodes)
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings or {""}}
    return [frozenset(sets)] if all(sets) else []


def _rarest(trigrams: frozenset[str]) -> str:
    return max(trigrams, key=lambda t: (sum(_COMMON.find(x) if x in _COMMON else len(_COMMON) for x in t), t))


class Index:
    """The trigram queries of rules, and the numbers of the trigrams that they name."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        self.queries = {r.kind: trigram_query(r.pattern) for r in rules}
        self.trigrams = sorted({t for q in self.queries.values() for clause in q for some in clause for t in some})

    def postings(self, docs: DataFrame) -> DataFrame:
        """(trigram, doc_id), a row for each document that holds the trigram in either case."""
        held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in self.trigrams)))
        low = docs.select("doc_id", F.lower("text").alias("low")).filter("low is not null")
        return low.select(F.explode(held).alias("trigram"), "doc_id").distinct()

    def candidates(self, postings: DataFrame) -> DataFrame:
        """doc_id and kinds: the rules whose query the document's postings satisfy."""
        number = F.create_map(*(x for i, t in enumerate(self.trigrams) for x in (F.lit(t), F.lit(i))))[F.col("trigram")]
        words = range(len(self.trigrams) // 62 + 1)
        bits = [F.bit_or(F.when(F.floor(F.col("no") / 62) == w, F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("no") % 62).cast("int"))).otherwise(F.lit(0).cast("long"))).alias(f"bits{w}") for w in words]
        per_doc = postings.select("doc_id", number.alias("no")).groupBy("doc_id").agg(*bits)

        def all_of(trigrams: frozenset[str]) -> Column:
            at = [self.trigrams.index(t) for t in trigrams]
            masks = {w: sum(1 << (i % 62) for i in at if i // 62 == w) for w in words}
            return reduce(Column.__and__, [F.col(f"bits{w}").bitwiseAND(F.lit(m)) == F.lit(m) for w, m in masks.items() if m])

        def holds(clauses: list[Alternatives]) -> Column:
            return reduce(Column.__and__, [reduce(Column.__or__, map(all_of, clause)) for clause in clauses])

        kinds = F.array_compact(F.array(*(F.when(holds(q), F.lit(k)) for k, q in self.queries.items() if q)))
        return per_doc.select("doc_id", kinds.alias("kinds")).filter(F.size("kinds") > 0)

    def may_hold(self, text: Column) -> Column:
        """Whether a text has, for some rule, the rarest trigram of an alternative in its narrowest clause."""
        needed = set()
        for query in filter(None, self.queries.values()):
            needed |= {_rarest(some) for some in min(query, key=lambda clause: (len(clause), -max(map(len, clause))))}
        return reduce(Column.__or__, [F.contains(F.lower(text), F.lit(t)) for t in sorted(needed)], F.lit(False))


_SPAN = "array<struct<start:int,ord:int,kind:string,end:int>>"


#: Matches folded at once: an array that grows by one is copied each time, so long lists are folded in blocks.
_BLOCK = 512


def _blocks(items: Column) -> Column:
    """An array in slices of _BLOCK."""
    last = F.greatest(F.lit(0), F.floor((F.size(items) - 1) / _BLOCK).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(items, b * _BLOCK + 1, F.lit(_BLOCK)))


def _span(rule: Rule, ordinal: int, start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(ordinal).alias("ord"), F.lit(rule.kind).alias("kind"), end.alias("end"))


def _rule_spans(text: Column, rule: Rule, ordinal: int) -> Column:
    """Leftmost non-overlapping matches: what lies between them, from split(), gives their offsets."""
    between, whole = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    steps = F.zip_with(F.zip_with(F.slice(between, 1, F.size(whole)), whole, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("len"))), measured, lambda a, m: F.struct(a["gap"].alias("gap"), a["len"].alias("len"), (F.length(m) >= rule.least).alias("ok")))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        return F.struct((start + x["len"]).alias("at"), F.when(x["ok"], F.concat(acc["out"], F.array(_span(rule, ordinal, start, start + x["len"])))).otherwise(acc["out"]).alias("out"))

    none = F.array().cast(_SPAN)

    def join(acc, block):
        moved = F.transform(block["out"], lambda s: _span(rule, ordinal, acc["at"] + s["start"], acc["at"] + s["end"]))
        return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    def found(every):
        blocks = F.transform(_blocks(every), lambda b: F.aggregate(b, F.struct(F.lit(0).alias("at"), none.alias("out")), step))
        return F.flatten(F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out")), join, lambda acc: acc["out"]))

    # a lambda's variable holds the steps, which would else be made anew for each block
    return F.when(F.rlike(text, F.lit(rule.pattern)), F.transform(F.array(steps), found)[0]).otherwise(none)


def with_spans(docs: DataFrame, name: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs and a column of all spans, by start and then rule order."""
    index = Index(rules)
    text = F.coalesce(F.col("text"), F.lit(""))
    # a row without an id can't be met by one; all its kinds are asked instead
    named = docs.filter("doc_id is not null")
    cand = index.candidates(stage_table(index.postings(named), "postings"))
    cand = cand.select(F.col("doc_id").alias(f"{name}_id"), F.col("kinds").alias(f"{name}_kinds"))
    may = index.may_hold(text)

    def spans(asked: Column | None) -> Column:
        every = []
        for i, rule in enumerate(rules):
            if not index.queries[rule.kind]:
                every.append(_rule_spans(text, rule, i))
            elif asked is not None:
                every.append(F.when(F.array_contains(asked, rule.kind), _rule_spans(text, rule, i)).otherwise(F.array().cast(_SPAN)))
        return F.array_sort(F.concat(*every)) if every else F.array().cast(_SPAN)

    plain = docs.filter(~may).withColumn(name, spans(None))
    met = named.filter(may).join(cand, F.col("doc_id") == F.col(f"{name}_id"), "left")
    met = met.withColumn(name, spans(F.coalesce(F.col(f"{name}_kinds"), F.array().cast("array<string>")))).drop(f"{name}_id", f"{name}_kinds")
    nameless = docs.filter(may & F.col("doc_id").isNull()).withColumn(name, spans(F.array(*(F.lit(r.kind) for r in rules))))
    return plain.unionByName(met).unionByName(nameless)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(ordinal: int):
    return lambda span: span["ord"] == ordinal


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = with_spans(docs.select("doc_id", "text"), "found")
    base = F.filter("found", lambda s: s["ord"] < len(BASE))
    counts = [F.size(F.filter("found", _is(i))).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with every span of text replaced by [kind], overlapping spans by the first one's; n_chars follows, if there."""
    name = "found"
    while {name, f"{name}_id", f"{name}_kinds"} & set(docs.columns):
        name += "_"

    none, whole = F.array().cast("array<string>"), F.col("text")

    def redacted(base, part):
        """What replaces part of the text, from base on to the last end of a block of spans."""

        def step(acc, s):
            piece = F.concat(acc["out"], F.call_function("substr", part, acc["at"] - base + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], piece).otherwise(acc["out"]).alias("out"))

        return lambda block: F.aggregate(block, F.struct(base.alias("at"), F.lit("").alias("out")), step, lambda acc: acc["out"])

    def join(acc, block):
        end = F.greatest(acc["at"], F.array_max(F.transform(block, lambda s: s["end"])))
        part = F.call_function("substr", whole, acc["at"] + 1, end - acc["at"])
        out = F.transform(F.array(part), lambda p: redacted(acc["at"], p)(block))
        return F.struct(end.alias("at"), F.concat(acc["out"], out).alias("out"))

    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    text = F.aggregate(_blocks(F.col(name)), start, join, lambda acc: F.concat(F.array_join(acc["out"], ""), F.call_function("substr", whole, acc["at"] + 1)))
    out = with_spans(docs, name).withColumn("text", F.when(F.size(name) > 0, text).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(name) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)

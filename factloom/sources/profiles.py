"""Structure profiles of methods: weighted features of what a method does, without its names and values.

A bracket machine pairs the brackets of a file's token stream, and what stands before a brace or an arrow tells types and methods
apart. A second machine walks a method's body: control flow in the order of the syntax tree (an operator counts where its
expression begins), what switches and patterns look at, members used and changed, literals and how the method returns. Types are
taken as written; those declared in the file are known by kind, others by their name. Files are scanned in Arrow batches, each file by itself."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexical import Token, _opens, tokens

# Fixed weights of features.
WEIGHTS = {
    "ret": 3.0, "retkind": 1.5, "param": 0.8, "paramkind": 2.0, "cf": 1.2, "cflowseq": 2.0, "target": 2.5, "member": 1.8, "form": 2.0, "purity": 2.0, "lit": 0.5,
}
#: Control-flow nodes that the sequence holds.
SEQUENCE = 8
# Fixed kinds of built-in types.
_STRUCTS = {"int", "long", "short", "byte", "sbyte", "uint", "ulong", "ushort", "nint", "nuint", "bool", "char", "double", "float", "decimal", "void", "DateTime", "TimeSpan", "Guid", "DateTimeOffset", "CancellationToken"}
# Fixed: types that stand for input and output.
IO_TYPES = {"Console", "File", "Directory", "Path", "FileStream", "StreamReader", "StreamWriter", "FileInfo", "DirectoryInfo", "HttpClient", "WebClient", "Dns", "Socket", "TcpClient", "XmlReader", "XmlWriter", "XmlDocument", "Registry"}
_PREFIXES = ("System.Console", "System.IO", "System.Net", "System.Xml", "Microsoft.Win32")
_MODIFIERS = {"public", "private", "protected", "internal", "static", "virtual", "override", "abstract", "sealed", "async", "readonly", "const", "new", "extern", "unsafe", "partial", "required", "volatile", "this", "ref", "out", "in", "params", "scoped", "event"}
_STATEMENT_ENDS = {";", "{", "}", ")", "else", "do", ":"}
_BEFORE_OPERAND = {"return", "=", "(", ",", "=>", "{", ";", "[", "+=", "-=", "throw", "yield", "&&", "||", "??", "?", ":", "await", "in", "when", "case", "}", "else", "!"}
_ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "??=", "<<=", ">>="}
_PAIRS = {"(": ")", "[": "]", "{": "}"}
_KEYWORDS = {"if", "for", "foreach", "do", "try", "catch", "lock"}


def paired(found: list[Token]) -> dict[int, int]:
    """The place of each bracket's partner, both ways; one that is never closed pairs with the end."""
    out, open_ = {}, []
    for i, t in enumerate(found):
        if t.text in _PAIRS:
            open_.append(i)
        elif t.text in _PAIRS.values():
            # a bracket of another sort closes what was left open within it
            while open_ and _PAIRS[found[open_[-1]].text] != t.text and any(_PAIRS[found[j].text] == t.text for j in open_):
                out[open_.pop()] = i
            if open_ and _PAIRS[found[open_[-1]].text] == t.text:
                out[open_[-1]] = i
                out[i] = open_.pop()
    return out | {i: len(found) - 1 for i in open_}


def merged(found: list[Token]) -> list[Token]:
    """Tokens with signs of several characters in one piece: `+=`, `++` and the like."""
    out: list[Token] = []
    for t in found:
        last = out[-1] if out else None
        if last and last.kind == t.kind == "op" and last.line == t.line and (last.text + t.text in _ASSIGN | {"++", "--", "==", "!=", "<=", ">="}):
            out[-1] = Token(last.text + t.text, "op", t.line)
        else:
            out.append(t)
    return out


@dataclass
class TypeFacts:
    name: str
    kind: str
    outer: str
    #: Type of each instance member, and of each static one.
    fields: dict[str, str] = field(default_factory=dict)
    statics: dict[str, str] = field(default_factory=dict)


@dataclass
class Method:
    owner: TypeFacts
    name: str
    returns: str
    params: list[tuple[str, str]]
    generics: set[str]
    start: int
    end: int
    line: int


def written(words: list[str]) -> str:
    return re.sub(r"\s*,\s*", ", ", "".join(words))


def _declared(words: list[str]) -> tuple[str, str] | None:
    """Type and name of a declaration such as `readonly List<int> items`."""
    kept = [w for w in words if w not in _MODIFIERS]
    if len(kept) < 2 or not (kept[-1].isidentifier() or kept[-1][:1] == "@"):
        return None
    return written(kept[:-1]), kept[-1]


def _split(found: list[Token], lo: int, hi: int) -> list[list[str]]:
    """The words of found[lo:hi] between commas outside of brackets."""
    out, part, depth = [], [], 0
    for t in found[lo:hi]:
        depth += (t.text in "([{<") - (t.text in ")]}>") if len(t.text) == 1 else 0
        if t.text == "," and depth == 0:
            out.append(part)
            part = []
        else:
            part.append(t.text)
    return [*out, part] if part else out


def _signature(found: list[Token], pair: dict[int, int], head: list[int]):
    """(returns, name, params, generics) of a method's head, or None for what isn't one."""
    at = next((k for k, i in enumerate(head) if found[i].text == "("), None)
    if not at:
        return None
    before = [found[i].text for i in head[:at]]
    while before and before[0] == "[":
        before = before[before.index("]") + 1 :] if "]" in before else []
    generics: set[str] = set()
    if before and before[-1] == ">":
        depth, k = 0, len(before)
        while k:
            k -= 1
            depth += (before[k] == ">") - (before[k] == "<")
            if not depth:
                break
        generics, before = set(before[k:]) - {"<", ">", ","}, before[:k]
    kept = [w for w in before if w not in _MODIFIERS]
    if len(kept) < 2 or not kept[-1].isidentifier() or "=" in kept or "delegate" in kept or "operator" in kept:
        return None
    params = []
    for words in _split(found, head[at] + 1, pair.get(head[at], head[at] + 1)):
        words = words[: words.index("=")] if "=" in words else words
        if d := _declared(words):
            params.append(d)
    return written(kept[:-1]), kept[-1], params, generics


def declarations(found: list[Token], pair: dict[int, int]) -> tuple[dict[str, TypeFacts], list[Method]]:
    """Types by name, with the types of their members, and methods with the range of their bodies."""
    types: dict[str, TypeFacts] = {}
    methods: list[Method] = []

    def member(owner, head, stop):
        words = [found[i].text for i in head]
        if "(" in words[: words.index("=")] if "=" in words else "(" in words:
            return
        words = words[: words.index("=")] if "=" in words else words
        while words and words[0] == "[" and "]" in words:
            words = words[words.index("]") + 1 :]
        if d := _declared(words):
            (owner.statics if {"static", "const"} & set(words) else owner.fields)[d[1]] = d[0]

    def inside(lo, hi, outer, owner):
        head, i = [], lo
        while i < hi:
            t = found[i].text
            if t == "{":
                end = pair.get(i, hi)
                kind, name = _opens([found[k] for k in head])
                if kind == "namespace":
                    inside(i + 1, end, f"{outer}.{name}".strip("."), None)
                elif kind == "type":
                    words = [found[k].text for k in head]
                    sort = next(w for w in words if w in ("class", "struct", "interface", "record", "enum"))
                    facts = TypeFacts(name, {"record": "struct" if "struct" in words else "class"}.get(sort, sort), outer)
                    types.setdefault(name, facts)
                    # parameters of a primary constructor are members of a record
                    if "(" in words and sort == "record":
                        at = head[words.index("(")]
                        facts.fields |= {n: ty for ty, n in filter(None, map(_declared, _split(found, at + 1, pair.get(at, at + 1))))}
                    inside(i + 1, end, f"{outer}.{name}".strip("."), facts)
                elif owner is not None and (sign := _signature(found, pair, head)):
                    methods.append(Method(owner, sign[1], sign[0], sign[2], sign[3], i, end, found[head[0]].line))
                elif owner is not None and head:
                    member(owner, head, i)
                head, i = [], end + 1
                continue
            if t == "=>" and owner is not None and head:
                end = i + 1
                while end < hi and found[end].text != ";":
                    end = pair[end] + 1 if found[end].text in _PAIRS and end in pair else end + 1
                if sign := _signature(found, pair, head):
                    methods.append(Method(owner, sign[1], sign[0], sign[2], sign[3], i, end, found[head[0]].line))
                else:
                    member(owner, head, i)
                head, i = [], end + 1
                continue
            if t == ";":
                words = [found[k].text for k in head]
                if owner is not None and head:
                    member(owner, head, i)
                elif words[:1] == ["namespace"]:
                    outer = "".join(words[1:])
                head, i = [], i + 1
                continue
            head.append(i)
            if t in ("(", "[") and i in pair:
                head += range(i + 1, min(pair[i], hi - 1) + 1)
                i = pair[i]
            i += 1

    inside(0, len(found), "", None)
    return types, methods


def type_kind(name: str, types: dict[str, TypeFacts], generics: set[str]) -> str:
    """The kind of a type as written: declared in the file, built in, or told by its name."""
    if name.endswith("]"):
        return "array"
    plain = name.rstrip("?").partition("<")[0].rpartition(".")[2]
    if plain in generics:
        return "typeparameter"
    if plain in types:
        return types[plain].kind
    if plain in _STRUCTS or name.startswith("("):
        return "struct"
    if plain == "dynamic":
        return "dynamic"
    return "interface" if re.match(r"I[A-Z]", plain) else "delegate" if plain in ("Action", "Func", "Predicate") else "class"


class Walk:
    """What a body does, token by token."""

    def __init__(self, found: list[Token], pair: dict[int, int], types: dict[str, TypeFacts], method: Method):
        self.found, self.pair, self.types, self.method = found, pair, types, method
        #: (where the node begins, inner after outer, label)
        self.nodes: list[tuple[int, int, str]] = []
        self.targets, self.members, self.literals = set(), set(), set()
        self.mutates = self.uses = self.io = False
        self.switch = self.branch = self.throws = False
        self.local = {n: t for t, n in method.params}
        for i in range(method.start, method.end + 1):
            self._token(i)

    def _text(self, i: int) -> str:
        return self.found[i].text if 0 <= i < len(self.found) else ""

    def _operand(self, i: int) -> int:
        """Where the primary expression that ends before i begins."""
        k = i - 1
        while k > self.method.start:
            t = self.found[k]
            if t.text in (")", "]", "}") and k in self.pair:
                k = self.pair[k]
            if self._text(k - 1) in (".", "?."):
                k -= 2
            elif self.found[k].text in ("(", "[") and self.found[k - 1].kind == "ident" and self._text(k - 1) not in _KEYWORDS | {"return", "switch", "while", "when", "case"}:
                k -= 1
            else:
                return k
        return k

    def _condition(self, i: int) -> int:
        """Where the expression before i begins, its operators included."""
        k = i
        while k > self.method.start + 1:
            before = self._text(k - 1)
            if before in (")", "]", "}") and k - 1 in self.pair:
                if before == "}":
                    return k
                k = self.pair[k - 1]
            elif before in _BEFORE_OPERAND - {"&&", "||", "??", "!", "await"}:
                return k
            else:
                k -= 1
        return k

    def _type_of(self, lo: int, hi: int) -> list[str]:
        """Types of an expression found[lo:hi] that is a name, or a member of a known type."""
        words = [t.text for t in self.found[lo:hi]]
        own = self.method.owner
        if len(words) == 1:
            return [t] if (t := self.local.get(words[0]) or own.fields.get(words[0]) or own.statics.get(words[0])) else []
        if len(words) == 3 and words[1] in (".", "?."):
            holder = own if words[0] == "this" else self.types.get((self.local.get(words[0]) or own.fields.get(words[0]) or "").rstrip("?"))
            return [t] if holder and (t := holder.fields.get(words[2]) or holder.statics.get(words[2])) else []
        return []

    def _of_instance(self, i: int) -> bool:
        """Whether the name at i is an instance member of the method's type, by itself or after `this.`"""
        if self._text(i) not in self.method.owner.fields:
            return False
        if self._text(i - 1) in (".", "?."):
            return self._text(i - 2) == "this" or self.local.get(self._text(i - 2), "").rstrip("?") == self.method.owner.name
        return self._text(i) not in self.local

    def _token(self, i: int) -> None:
        t, text = self.found[i], self._text(i)
        before, after = self._text(i - 1), self._text(i + 1)
        if t.kind == "literal":
            self.literals.add("string" if text[-1:] in "\"'" else "number")
        elif text in ("true", "false"):
            self.literals.add("bool")
        elif text in ("null",):
            self.literals.add("null")
        if before in (".", "?.") or t.kind == "literal":
            keyword = False
        else:
            keyword = t.kind == "ident"
        if keyword:
            self._keyword(i, text, before, after)
        if text == "?" and self._ternary(i):
            self.nodes.append((self._condition(i), 1, "ternary"))
            if self._text(self._condition(i) - 1) == "return":
                self.branch = True
        if text in _ASSIGN and self._of_instance(i - 1) or text in ("++", "--") and (self._of_instance(i - 1) or self._of_instance(i + 1) or after == "this" and self._of_instance(i + 3)):
            self.mutates = True
        # any prefix sign on a member counts as a change of it, as fixed by the rule
        if text in ("!", "-", "+", "~") and (before in _BEFORE_OPERAND or before in _ASSIGN or before in ("if", "(")) and (self._of_instance(i + 1) or after == "this" and self._of_instance(i + 3)):
            self.mutates = True
        if text in (".", "?.") and self.found[i + 1].kind == "ident" and self._text(i + 2) != "(":
            found = self._type_of(i - 1, i + 2)
            self.members.update(found)
            if found and self._of_instance(i + 1):
                self.uses = True
        if keyword and after in (".", "?.") and text in IO_TYPES and text not in self.local:
            self.io = True
        if text == "System" or text == "Microsoft":
            full = "".join(x.text for x in self.found[i : i + 7])
            self.io = self.io or full.startswith(_PREFIXES)

    def _ternary(self, i: int) -> bool:
        """Whether a question mark is a choice and not part of a type: a colon follows on its level."""
        if self._text(i + 1) in (">", ",", ")", ";", "[", "=", "{", "."):
            return False
        k, open_ = i + 1, 1
        while k <= self.method.end:
            text = self._text(k)
            if text in _PAIRS and k in self.pair:
                k = self.pair[k]
            elif text in (";", ")", "]", "}", ","):
                return False
            elif text == "?":
                open_ += 1
            elif text == ":":
                open_ -= 1
                if not open_:
                    return True
            k += 1
        return False

    def _keyword(self, i: int, text: str, before: str, after: str) -> None:
        if text in _KEYWORDS:
            self.nodes.append((i, 0, text))
            self.branch = self.branch or text == "if"
        elif text == "while":
            closes = self._text(self.pair.get(i + 1, i) + 1) == ";"
            if not (before in ("}", ";") and closes and any(label == "do" for _, _, label in self.nodes)):
                self.nodes.append((i, 0, "while"))
        elif text == "using" and after == "(":
            self.nodes.append((i, 0, "using"))
        elif text == "yield" and after in ("return", "break"):
            self.nodes.append((i, 0, "yield"))
        elif text == "return" and before != "yield":
            self.nodes.append((i, 0, "return"))
        elif text == "throw" and before in _STATEMENT_ENDS:
            self.nodes.append((i, 0, "throw"))
            self.throws = True
        elif text == "switch":
            self.switch = True
            if after == "(" and before in _STATEMENT_ENDS:
                self.nodes.append((i, 0, "switch"))
                self.targets.update(self._type_of(i + 2, self.pair.get(i + 1, i + 2)))
            else:
                lo = self._operand(i)
                self.nodes.append((lo, 2, "switch-expr"))
                self.targets.update(self._type_of(lo, i))
        elif text == "is" and self._pattern(i):
            lo = self._operand(i)
            self.nodes.append((lo, 3, "is-pattern"))
            self.targets.update(self._type_of(lo, i))
        elif after and self.found[i + 1].kind == "ident" and self._text(i + 2) in ("=", ";", "in") and before in _STATEMENT_ENDS | {"(", "const", "var"} and text not in ("return", "var", "await", "throw", "new", "goto", "else"):
            self.local[after] = text

    def _pattern(self, i: int) -> bool:
        """`is` with a pattern; a type alone is a plain test."""
        k = i + 1
        if self.found[k].kind != "ident" or self._text(k) in ("not", "null", "true", "false"):
            return True
        while self._text(k + 1) == "." and self.found[k + 2].kind == "ident":
            k += 2
        if self._text(k + 1) == "<":
            while k < self.method.end and self._text(k) != ">":
                k += 1
        after = self.found[k + 1]
        return after.text in ("{", "(", "and", "or") or after.kind == "ident" and after.text not in ("is", "as")

    @property
    def order(self) -> list[str]:
        return [label for _, _, label in sorted(self.nodes, key=lambda n: n[:2])]

    @property
    def purity(self) -> str:
        return "io" if self.io else "mutates" if self.mutates else "stateful" if self.uses else "pure"

    @property
    def form(self) -> str:
        return "switch" if self.switch else "if" if self.branch else "throw" if self.throws else "direct"


def profile(walk: Walk) -> tuple[str, dict[str, float]]:
    """Summary and weighted features of a method."""
    m, out = walk.method, Counter()
    kind = lambda t: type_kind(t, walk.types, m.generics)

    def add(sort, value, times=1):
        out[f"{sort}:{value}"] += WEIGHTS[sort] * times

    add("ret", m.returns), add("retkind", kind(m.returns))
    for t, _ in m.params:
        add("param", t), add("paramkind", kind(t))
    flow = Counter(walk.order)
    for label, n in flow.items():
        add("cf", label, n)
    if flow:
        add("cflowseq", ">".join(walk.order[:SEQUENCE]))
    for sort, values in (("target", walk.targets), ("member", walk.members), ("lit", walk.literals)):
        for v in values:
            add(sort, v)
    add("purity", walk.purity), add("form", walk.form)
    said = [f"ret={m.returns}", "params=" + ",".join(t for t, _ in m.params)]
    said += [f"{k}=" + ",".join(sorted(v)) for k, v in (("cf", flow), ("targets", walk.targets), ("lits", walk.literals)) if v]
    return "; ".join([*said, walk.purity, f"form={walk.form}"]), {k: round(v, 6) for k, v in out.items()}


def profiles_of(text: str, least_tokens: int = 0):
    """(member id, line, tokens, summary, features) of each method of a file."""
    found = merged(tokens(text))
    pair = paired(found)
    types, methods = declarations(found, pair)
    for m in methods:
        size = m.end - m.start + 1
        if size >= least_tokens:
            outer = f"{m.owner.outer}.{m.owner.name}".strip(".")
            yield f"M:{outer}.{m.name}({','.join(t for t, _ in m.params)})", m.line, size, *profile(Walk(found, pair, types, m))


_FEATURES = pa.list_(pa.struct([("feature", pa.string()), ("weight", pa.float64())]))


def structure_profiles(files: DataFrame, least_tokens: int = 0) -> DataFrame:
    """file_id, unit_id, line, tokens, summary, features (array of feature and weight): a row a method of files (file_id, text). Null
    and empty texts have none; a method declared twice has a row each."""

    def run(batches):
        for b in batches:
            rows = [(i, *p) for i, t in zip(b.column("file_id").to_pylist(), b.column("text").to_pylist()) if t for p in profiles_of(t, least_tokens)]
            cols = list(zip(*rows)) or [()] * 6
            features = [[{"feature": k, "weight": w} for k, w in sorted(f.items())] for f in cols[5]]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.string()), pa.array(features, _FEATURES)], names=["file_id", "unit_id", "line", "tokens", "summary", "features"])

    return files.select(F.col("file_id").cast("long").alias("file_id"), "text").mapInArrow(run, "file_id long, unit_id string, line int, tokens int, summary string, features array<struct<feature:string,weight:double>>")


def _statements(found: list[Token], pair: dict[int, int], lo: int, hi: int) -> list[tuple[int, int]]:
    """Top-level statements of found[lo:hi], an `if` with what it governs."""
    out, start, i = [], lo, lo
    while i < hi:
        if found[i].text == "if" and i == start:
            i = pair.get(i + 1, i + 1) + 1
            i = pair[i] + 1 if i < hi and found[i].text == "{" and i in pair else next((k + 1 for k in range(i, hi) if found[k].text == ";"), hi)
            out.append((start, i))
            start = i
            continue
        if found[i].text in _PAIRS and i in pair:
            i = pair[i]
        elif found[i].text == ";":
            out.append((start, i + 1))
            start = i + 1
        i += 1
    return [*out, (start, hi)] if start < hi else out


def fills_an_object(found: list[Token], pair: dict[int, int], method: Method, most_plain: float) -> bool:
    """Whether a method only gives a new object, or a changed copy, whose values are mostly a `??` or a choice: at most `most_plain` of
    them are neither. What comes before may declare locals, or return early."""
    lo, hi = method.start + 1, method.end
    if found[method.start].text == "{":
        steps = _statements(found, pair, lo, hi)
        if not steps or found[steps[-1][0]].text != "return":
            return False
        for a, b in steps[:-1]:
            words = [t.text for t in found[a:b]]
            guard = words[0] == "if" and words.count("return") == 1 and words.count(";") == 1
            local = words[0] not in _KEYWORDS | {"return", "while", "switch", "throw", "using"} and found[a].kind == "ident" and (d := _declared(words[: words.index("=")] if "=" in words else words[:-1])) and d
            if not (guard or local):
                return False
        lo, hi = steps[-1][0] + 1, steps[-1][1] - 1
    while hi - lo > 1 and found[lo].text == "(" and pair.get(lo) == hi - 1:
        lo, hi = lo + 1, hi - 1
    words = [t.text for t in found[lo:hi]]
    if not words or not (words[0] == "new" or "with" in words):
        return False
    values = [i for i in range(lo, hi) if found[i].text == "=" and found[i - 1].kind == "ident"]
    coalescing = 0
    for i in values:
        k, hit = i + 1, False
        while k < hi and found[k].text not in (",", "}", ";"):
            hit = hit or found[k].text in ("??", "?")
            k = pair[k] + 1 if found[k].text in _PAIRS and k in pair else k + 1
        coalescing += hit
    return bool(values) and 1 - coalescing / len(values) <= most_plain


def object_initialisers(files: DataFrame, most_plain: float = 0.5) -> DataFrame:
    """file_id, member_id of methods that fill an object (`structure.cyclomatic`)."""

    def run(batches):
        for b in batches:
            ids, names = [], []
            for i, t in zip(b.column("file_id").to_pylist(), b.column("text").to_pylist()):
                found = merged(tokens(t or ""))
                pair = paired(found)
                for m in declarations(found, pair)[1]:
                    if fills_an_object(found, pair, m, most_plain):
                        outer = f"{m.owner.outer}.{m.owner.name}".strip(".")
                        ids.append(i), names.append(f"M:{outer}.{m.name}({','.join(p for p, _ in m.params)})")
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string())], names=["file_id", "member_id"])

    return files.select(F.col("file_id").cast("long").alias("file_id"), "text").mapInArrow(run, "file_id long, member_id string")

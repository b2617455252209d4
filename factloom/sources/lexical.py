"""Facts of C-like source text without a compiler: types, members, tokens and branching nodes.

The scanner knows comments, strings and braces. What stands before an opening brace says what it opens: a namespace, a type,
a member, or a statement. Names are not bound, so facts that need a compiler stay inputs."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

_SKIP = r"(?P<skip>//[^\n]*|/\*.*?(?:\*/|\Z)|^[ \t]*#[^\n]*|\s+)"
_TEXT = r'(?P<string>\$?@?"""(?:.*?)"""|\$?@"(?:[^"]|"")*"|@\$"(?:[^"]|"")*"|\$?"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\')'
_REST = r"(?P<number>\d[\w.]*)|(?P<ident>@?[^\W\d]\w*)|(?P<op>=>|&&|\|\||\?\?=?|\?\.|::|[{}()\[\];,<>?:.]|[^\s\w])"
_TOKEN = re.compile(f"{_SKIP}|{_TEXT}|{_REST}", re.S | re.M)

# Fixed words of the language.
_TYPES = {"class", "struct", "interface", "record", "enum"}
_CONTROL = {"if", "while", "do", "for", "foreach", "switch", "catch", "try", "else", "finally", "using", "lock", "fixed", "checked", "unchecked", "unsafe", "get", "set", "init", "add", "remove", "return", "new", "when"}
_ACCESS = ("public", "private", "protected", "internal")
_NESTING = {"if", "while", "do", "for", "foreach", "catch", "switch"}


@dataclass
class Token:
    text: str
    kind: str
    line: int


@dataclass
class Scope:
    kind: str
    name: str
    start: int
    head: list[Token] = field(default_factory=list)
    first: int = 0


def tokens(text: str) -> list[Token]:
    out, line = [], 1
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        if kind != "skip":
            out.append(Token(m[0], "literal" if kind in ("string", "number") else "ident" if kind == "ident" else "op", line))
        line += m[0].count("\n")
    return out


def _opens(head: list[Token]) -> tuple[str, str]:
    """Kind and name of what a brace opens."""
    words = [t.text for t in head]
    if "namespace" in words:
        return "namespace", "".join(words[words.index("namespace") + 1 :])
    depth = 0
    for i, w in enumerate(words):
        depth += (w in "([<") - (w in ")]>") if len(w) == 1 else 0
        if depth == 0 and w in _TYPES and i + 1 < len(words) and head[i + 1].kind == "ident":
            name = words[i + 1] if words[i + 1] not in _TYPES else words[min(i + 2, len(words) - 1)]
            return "type", name
    if "(" in words and words[0] not in _CONTROL and "=" not in words[: words.index("(")] and "=>" not in words:
        at = words.index("(")
        if at and head[at - 1].kind == "ident" and words[at - 1] not in _CONTROL:
            return "member", words[at - 1]
    return "block", words[0] if words else ""


def _parameters(head: list[Token]) -> list[str]:
    """Parameter types, without modifiers, names and defaults."""
    words = [t.text for t in head]
    start, depth, part, out = words.index("(") + 1, 0, [], []
    for w in words[start:]:
        if depth == 0 and w in (",", ")"):
            kept = [x for x in (part[: part.index("=")] if "=" in part else part) if x not in ("this", "ref", "out", "in", "params")]
            if len(kept) > 1:
                out.append("".join(kept[:-1]))
            part = []
            if w == ")":
                break
            continue
        depth += (w in "([<") - (w in ")]>") if len(w) == 1 else 0
        part.append(w)
    return out


def scan(text: str) -> tuple[list[dict], list[dict], list[dict]]:
    """Types, members (with their tokens) and branching nodes."""
    found, stack, head = tokens(text), [], []
    types, members, nodes = [], [], []
    for i, t in enumerate(found):
        member = next((s for s in reversed(stack) if s.kind == "member"), None)
        if member is not None:
            inside = sum(s.kind == "block" and s.name in _NESTING for s in stack[stack.index(member) + 1 :])
            kind = {"&&": "and", "||": "or", "??": "coalesce"}.get(t.text) or (t.text if t.kind == "ident" and t.text in _NESTING | {"case", "else"} else None)
            if t.text == "?" and i + 1 < len(found) and found[i + 1].text not in (">", ",", ")", ";", "[", "=", "{"):
                kind = "conditional"
            if kind == "while" and head and head[-1].text == "}":
                kind = None
            if kind:
                nodes.append({"member": id(member), "ord": i, "kind": kind, "nesting": inside})
        if t.text == "{":
            kind, name = _opens(head)
            if kind == "member" and (member is not None or not any(s.kind == "type" for s in stack)):
                kind = "block"
            stack.append(Scope(kind, name, head[0].line if head else t.line, head, i))
            head = []
        elif t.text == "}":
            if stack:
                s = stack.pop()
                outer = ".".join(x.name for x in stack if x.kind in ("namespace", "type"))
                words = [x.text for x in s.head]
                access = next((w for w in words if w in _ACCESS), "private" if s.kind == "member" else "internal")
                row = {"name": s.name, "outer": outer, "visibility": access, "start_line": s.start, "end_line": t.line, "words": words}
                if s.kind == "type":
                    types.append(row)
                elif s.kind == "member":
                    body = found[s.first : i + 1]
                    members.append(row | {"key": id(s), "params": _parameters(s.head), "tokens": s.head + body, "kind": "constructor" if outer.rpartition(".")[2] == s.name else "method"})
            head = []
        elif t.text == ";" and sum(x.text == "(" for x in head) == sum(x.text == ")" for x in head):
            head = []
        else:
            head.append(t)
    keys = {m["key"]: m for m in members}
    return types, members, [n | {"owner": keys[n["member"]]} for n in nodes if n["member"] in keys]


_MEMBER = "file_id long, member_id string, type_id string, kind string, name string, visibility string, start_line int, end_line int, code_lines int, param_types array<string>, tokens array<struct<text:string,kind:string,line:int>>"
_NODE = "file_id long, member_id string, ord int, kind string, nesting int"
_TYPE = "file_id long, type_id string, name string, namespace string, visibility string, is_sealed boolean, is_static boolean, is_abstract boolean, is_partial boolean, start_line int, end_line int"


def _member_id(m: dict) -> str:
    return f"M:{m['outer']}.{m['name']}({','.join(m['params'])})"


def _over(files: DataFrame, schema: str, rows_of) -> DataFrame:
    names = [x.split(" ")[0] for x in re.split(r", (?=\w+ (?:long|string|int|boolean|array))", schema)]

    def run(batches):
        for pdf in batches:
            rows = [r for i, t in zip(pdf["file_id"], pdf["text"]) if t for r in rows_of(int(i), t)]
            yield pd.DataFrame(rows, columns=names)

    return files.select("file_id", "text").mapInPandas(run, schema)


def members(files: DataFrame) -> DataFrame:
    """member_decl facts with tokens, for the metrics and clone operators."""

    def rows(file_id: int, text: str):
        for m in scan(text)[1]:
            own = [(t.text, t.kind, t.line) for t in m["tokens"]]
            yield file_id, _member_id(m), f"T:{m['outer']}", m["kind"], m["name"], m["visibility"], m["start_line"], m["end_line"], len({t[2] for t in own}), m["params"], own

    return _over(files, _MEMBER, rows)


def branching_nodes(files: DataFrame) -> DataFrame:
    def rows(file_id: int, text: str):
        for n in scan(text)[2]:
            yield file_id, _member_id(n["owner"]), n["ord"], n["kind"], n["nesting"]

    return _over(files, _NODE, rows)


def types(files: DataFrame) -> DataFrame:
    def rows(file_id: int, text: str):
        for t in scan(text)[0]:
            flags = [w in t["words"] for w in ("sealed", "static", "abstract", "partial")]
            yield file_id, f"T:{t['outer']}.{t['name']}".replace("T:.", "T:"), t["name"], t["outer"], t["visibility"], *flags, t["start_line"], t["end_line"]

    return _over(files, _TYPE, rows)

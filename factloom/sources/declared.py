"""What source text declares, a row each: imports, types with their bases, members, parameters, endpoint parameters and calls.

kind       owner              name                 type                  words
using      -                  namespace            -                     -
type       enclosing          name                 class, record, ...    modifiers
base       type               simple name          -                     -
member     type               name                 method, property, constructor, field    modifiers, and accessors of a property
parameter  type.method        name                 as written            modifiers of the method
endpoint   called Map method  name                 as written            attributes of the parameter
call       -                  Receiver.Method      -                     -"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexical import _opens, tokens
from .profiles import _MODIFIERS, _declared, _signature, _split, merged, paired

_SORTS = ("class", "struct", "interface", "record", "enum")
_ACCESSORS = {"get", "set", "init"}
_NAMES = ["file_id", "kind", "line", "owner", "name", "type", "words"]


def _plain(words: list[str]) -> list[str]:
    """A head without its attributes."""
    while words and words[0] == "[" and "]" in words:
        words = words[words.index("]") + 1 :]
    return words


def facts_of(text: str):
    """(kind, line, owner, name, type, words) of a file."""
    found = merged(tokens(text))
    pair = paired(found)
    out = []

    def bases(owner, head):
        words = [found[k].text for k in head]
        if ":" not in words:
            return
        at = head[words.index(":")] + 1
        end = next((k for k in range(at, head[-1] + 1) if found[k].text == "where"), head[-1] + 1)
        for part in _split(found, at, end):
            plain = part[: part.index("<")] if "<" in part else part[: part.index("(")] if "(" in part else part
            if plain:
                out.append(("base", found[at].line, owner, plain[-1], None, []))

    def member(owner, head, opening):
        line, words = found[head[0]].line, _plain([found[k].text for k in head])
        has = [w for w in words if w in _MODIFIERS]
        if sign := _signature(found, pair, head):
            out.append(("member", line, owner, sign[1], "method", has))
            out.extend(("parameter", line, f"{owner}.{sign[1]}", n, t, has) for t, n in sign[2])
            return
        if "(" in words and (words.index("(") and words[words.index("(") - 1] == owner.rpartition(".")[2]):
            out.append(("member", line, owner, words[words.index("(") - 1], "constructor", has))
            return
        inner = {found[k].text for k in range(opening + 1, pair.get(opening, opening))} & _ACCESSORS if found[opening].text == "{" else set()
        words = words[: words.index("=")] if "=" in words else words
        if d := _declared(words):
            out.append(("member", line, owner, d[1], "property" if inner or found[opening].text == "=>" else "field", has + sorted(inner)))

    def inside(lo, hi, outer, in_type):
        head, i = [], lo
        while i < hi:
            t = found[i].text
            if t in ("{", ";", "=>") and head:
                words = _plain([found[k].text for k in head])
                end = pair.get(i, hi) + 1 if t == "{" else i + 1
                kind, name = _opens([found[k] for k in head]) if t == "{" else ("", "")
                if kind == "namespace":
                    inside(i + 1, end - 1, f"{outer}.{name}".strip("."), False)
                elif kind == "type" or t == ";" and not in_type and set(words) & set(_SORTS):
                    sort = next(w for w in words if w in _SORTS)
                    name = name or words[words.index(sort) + 1]
                    own = f"{outer}.{name}".strip(".")
                    out.append(("type", found[head[0]].line, outer, name, sort, [w for w in words[: words.index(sort)] if w != "["] + (["struct"] if "struct" in words else [])))
                    bases(own, head)
                    if t == "{":
                        inside(i + 1, end - 1, own, True)
                elif words[:1] == ["using"] and t == ";" and "=" not in words and not in_type:
                    out.append(("using", found[head[0]].line, None, "".join(w for w in words[1:] if w not in ("static", "global")), None, []))
                elif words[:2] == ["global", "using"] and t == ";":
                    out.append(("using", found[head[0]].line, None, "".join(words[2:]), None, []))
                elif words[:1] == ["namespace"] and t == ";":
                    outer = "".join(words[1:])
                elif in_type:
                    member(outer, head, i)
                    if t == "=>":
                        while end < hi and found[end].text != ";":
                            end = pair[end] + 1 if found[end].text in "([{" and end in pair else end + 1
                        end += 1
                head, i = [], end
                # what a property is given after its braces
                if t == "{" and i < hi and found[i].text == "=":
                    while i < hi and found[i].text != ";":
                        i = pair[i] + 1 if found[i].text in "([{" and i in pair else i + 1
                continue
            if t == "=" and in_type:
                # an initial value is not part of a head
                while i < hi and found[i].text not in (";", ","):
                    i = pair[i] + 1 if found[i].text in "([{" and i in pair else i + 1
                continue
            if t not in (";", "}"):
                head.append(i)
                if t in ("(", "[") and i in pair:
                    head += range(i + 1, min(pair[i], hi - 1) + 1)
                    i = pair[i]
            i += 1

    inside(0, len(found), "", False)
    for i in range(len(found) - 3):
        if found[i].kind == found[i + 2].kind == "ident" and found[i + 1].text == "." and found[i + 3].text == "(":
            out.append(("call", found[i].line, None, f"{found[i].text}.{found[i + 2].text}", None, []))
            called = found[i + 2].text
            if called.startswith("Map") and len(called) > 3:
                k, close = i + 4, pair.get(i + 3, i + 3)
                while k < close:
                    if found[k].text == "(" and k in pair and found[min(pair[k] + 1, close)].text == "=>":
                        for words in _split(found, k + 1, pair[k]):
                            marks = [w for w in words[: words.index("]")] if w.isidentifier()] if words[:1] == ["["] and "]" in words else []
                            if d := _declared(_plain(words)):
                                out.append(("endpoint", found[k].line, called, d[1], d[0], marks))
                    k = pair[k] + 1 if found[k].text in "([{" and k in pair else k + 1
    return out


def declared_facts(files: DataFrame) -> DataFrame:
    """file_id and the columns above, of files (file_id, text); null and empty texts have none."""
    types = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string())]

    def run(batches):
        for b in batches:
            rows = [(i, *f) for i, t in zip(b.column("file_id").to_pylist(), b.column("text").to_pylist()) if t for f in facts_of(t)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 7, types)], names=_NAMES)

    return files.select(F.col("file_id").cast("long").alias("file_id"), "text").mapInArrow(run, "file_id long, kind string, line int, owner string, name string, type string, words array<string>")

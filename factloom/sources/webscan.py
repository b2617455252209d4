"""Facts of component markup (markup with code in it): one scanner whose states fix what a mark or a brace means.

In markup, braces and quotes are text, and tags, code blocks and control flow begin something. In code, strings and comments hide
everything up to their end, and braces pair. The body of control flow is markup again, but its braces pair, too; within a tag only
attributes count. Comments hide everything in every state. What is never closed gives no block."""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed: elements that have no end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}

_COMMENT = r"(?P<comment>@\*.*?(?:\*@|\Z)|<!--.*?(?:-->|\Z))"
_STRING = r'@?"(?:\\.|[^"\\])*(?:"|\Z)|\'(?:\\.|[^\'\\])*(?:\'|\Z)'
_TAG = r"(?P<tag><(?P<name>[A-Za-z][\w.\-]*)(?P<attributes>(?:\"[^\"]*\"|'[^']*'|=>|[^>\"'])*)>)|(?P<end></[A-Za-z][\w.\-]*\s*>)"
_FLOW = r"@(?P<flow>else\s+if|if|foreach|for|while|switch)\b"
_STATES = {
    # outside of all braces
    "markup": re.compile(rf"{_COMMENT}|(?P<code>@(?:code|functions)?\s*\{{)|{_FLOW}|{_TAG}|(?P<choice>@\([^()]*?\?[^():]*:[^()]*\))", re.S),
    # within the braces of control flow: markup whose braces pair, quotes are text
    "flow": re.compile(rf"{_COMMENT}|(?P<code>@(?:code|functions)?\s*\{{)|{_FLOW}|{_TAG}|(?P<choice>@\([^()]*?\?[^():]*:[^()]*\))|(?P<open>\{{)|(?P<close>\}})", re.S),
    # within a code block
    "code": re.compile(rf"(?P<comment>@\*.*?(?:\*@|\Z)|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>{_STRING})|(?P<open>\{{)|(?P<close>\}})", re.S),
    # from a control word to its brace
    "head": re.compile(rf"(?P<comment>@\*.*?(?:\*@|\Z)|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>{_STRING})|(?P<open>\{{)", re.S),
}
_ATTRIBUTE = re.compile(r"\s(?P<name>@?[A-Za-z_][\w.\-]*(?::[A-Za-z_][\w.\-]*)?)\s*=\s*(?P<value>\"[^\"]*\"|'[^']*')?", re.S)
_CHOICE = re.compile(r"@\(\s*[^()]*?\?[^():]*:[^()]*\)", re.S)


def _is_long_lambda(value: str) -> bool:
    """A lambda with a block, or with more than one statement."""
    return "=>" in value and ("{" in value or "}" in value or value.count(";") > 1)


def scan(text: str) -> dict:
    """code_blocks and loops (start and end line), components (name, line, attributes), lambdas (attribute, line), choices (lines),
    flow (control-flow words), depth (open elements), loop_depth."""
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    line = lambda at: bisect_right(starts, at)
    out = {"code_blocks": [], "loops": [], "components": [], "lambdas": [], "choices": [], "flow": 0, "depth": 0, "loop_depth": 0}
    # what is open: state, where it began, and the loops around it
    stack: list[tuple[str, int | None, int]] = [("markup", None, 0)]
    waiting: tuple[str, int] | None = None
    at = opened = 0
    while True:
        state, began, loops = stack[-1]
        m = _STATES["head" if waiting else state].search(text, at)
        if m is None:
            break
        at, kind = m.end(), m.lastgroup if m.lastgroup not in ("name", "attributes") else "tag"
        if kind == "flow":
            out["flow"] += 1
            waiting = m["flow"], m.start()
        elif kind == "open":
            if waiting:
                inner = loops + (waiting[0] == "foreach")
                stack.append(("flow", waiting[1] if waiting[0] == "foreach" else None, inner))
                waiting = None
            else:
                stack.append((state, None, loops))
        elif kind == "close":
            stack.pop()
            if began is not None:
                found = (line(began), line(m.start()))
                out["code_blocks" if state == "code" else "loops"].append(found)
                if state == "flow":
                    out["loop_depth"] = max(out["loop_depth"], loops)
        elif kind == "code":
            named = m["code"].startswith(("@code", "@functions"))
            stack.append(("code", m.start() if named else None, loops))
        elif kind == "choice":
            out["choices"].append(line(m.start()))
        elif kind == "end":
            opened = max(0, opened - 1)
        elif kind == "tag":
            name, attributes = m["name"], m["attributes"]
            if not attributes.rstrip().endswith("/") and name.lower() not in VOID:
                opened += 1
                out["depth"] = max(out["depth"], opened)
            given = list(_ATTRIBUTE.finditer(" " + attributes))
            if name[0].isupper():
                out["components"].append((name, line(m.start()), len(given)))
            base = m.start("attributes") - 1
            for a in given:
                value = (a["value"] or "")[1:-1]
                if a["name"][0] == "@" and a["name"][1:].lower().startswith(("on", "bind")) and _is_long_lambda(value):
                    out["lambdas"].append((a["name"], line(base + a.start("name"))))
            out["choices"] += [line(m.start("attributes") + c.start()) for c in _CHOICE.finditer(attributes)]
    return out


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_USE = pa.list_(pa.struct([("name", pa.string()), ("line", pa.int32()), ("attributes", pa.int32())]))
_MARK = pa.list_(pa.struct([("name", pa.string()), ("line", pa.int32())]))
_NAMES = ["file_id", "code_blocks", "loops", "components", "lambdas", "choices", "flow", "depth", "loop_depth"]


def component_facts(files: DataFrame) -> DataFrame:
    """file_id and scan() of each text; a null text is an empty one."""

    def run(batches):
        for b in batches:
            found = [scan(t or "") for t in b.column("text").to_pylist()]
            named = lambda key, names: [[dict(zip(names, x)) for x in f[key]] for f in found]
            yield pa.RecordBatch.from_arrays([
                b.column("file_id"), pa.array(named("code_blocks", ("start", "end")), _SPAN), pa.array(named("loops", ("start", "end")), _SPAN), pa.array(named("components", ("name", "line", "attributes")), _USE), pa.array(named("lambdas", ("name", "line")), _MARK),
                pa.array([f["choices"] for f in found], pa.list_(pa.int32())), *(pa.array([f[k] for f in found], pa.int32()) for k in _NAMES[6:])], names=_NAMES)

    span, mark = "array<struct<start:int,end:int>>", "array<struct<name:string,line:int>>"
    schema = f"file_id long, code_blocks {span}, loops {span}, components array<struct<name:string,line:int,attributes:int>>, lambdas {mark}, choices array<int>, flow int, depth int, loop_depth int"
    return files.select(F.col("file_id").cast("long").alias("file_id"), "text").mapInArrow(run, schema)

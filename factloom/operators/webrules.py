"""Rules on web files: component markup by its scanned facts, files that need a companion, and marks that turn rules off."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources import webscan

# Rule ids and default limits; 0 turns a rule off.
LIMITS = {
    "RAZOR_MaxRazorLineCount": 300, "RAZOR_MaxRazorCodeBlockLines": 20, "RAZOR_MaxMarkupNestingDepth": 6, "RAZOR_BanInlineEventLambdas": 1,
    "RAZOR_MaxControlFlowBlocks": 8, "RAZOR_MaxForeachNestingDepth": 2, "RAZOR_MaxComponentParameterCount": 10, "RAZOR_BanInlineTernaryInAttributes": 1,
}
#: Rules on companions: extension, what the companion's name has more.
COMPANIONS = {"BlazorRequireCodeBehind": ".cs", "BlazorRequireCssIsolation": ".css"}


def _row(facts: DataFrame, rule: str, line: Column, details: Column, where: Column | None = None) -> DataFrame:
    rows = facts if where is None else facts.filter(where)
    return rows.select("file_id", line.cast("int").alias("line"), F.lit(rule).alias("rule"), details.cast("string").alias("details"))


def component_rules(files: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """file_id, line, rule, details of component markup. files: file_id, rel_path, text; each file is scanned once."""
    most = LIMITS | (limits or {})
    own = files.filter(F.endswith(F.lower("rel_path"), F.lit(".razor")))
    counted = own.select(F.col("file_id").cast("long").alias("file_id"), tx.web_lines(F.col("text")).alias("lines"))
    facts = webscan.component_facts(own).join(counted, "file_id")
    whole = lambda rule, col: F.when((F.col(col) > most[rule]) & F.lit(most[rule] > 0), F.struct(F.lit(1).alias("line"), F.lit(rule).alias("rule"), F.concat(F.col(col).cast("string"), F.lit(f" > {most[rule]}")).alias("details")))

    def each(rule, items, line, value=None, on=None):
        hits = F.col(items) if on is None else F.filter(items, on)
        shown = (lambda x: F.lit("")) if value is None else value
        out = F.transform(hits, lambda x: F.struct(line(x).cast("int").alias("line"), F.lit(rule).alias("rule"), shown(x).cast("string").alias("details")))
        return out if most[rule] > 0 else F.slice(out, 1, 0)

    length = lambda x: x["end"] - x["start"] + 1
    block, use = "RAZOR_MaxRazorCodeBlockLines", "RAZOR_MaxComponentParameterCount"
    found = F.concat(
        F.array_compact(F.array(whole("RAZOR_MaxRazorLineCount", "lines"), whole("RAZOR_MaxMarkupNestingDepth", "depth"), whole("RAZOR_MaxControlFlowBlocks", "flow"), whole("RAZOR_MaxForeachNestingDepth", "loop_depth"))),
        each(block, "code_blocks", lambda x: x["start"], length, lambda x: length(x) > most[block]),
        each(use, "components", lambda x: x["line"], lambda x: F.concat(x["name"], F.lit(" "), x["attributes"].cast("string")), lambda x: x["attributes"] > most[use]),
        each("RAZOR_BanInlineEventLambdas", "lambdas", lambda x: x["line"], lambda x: x["name"]),
        each("RAZOR_BanInlineTernaryInAttributes", "choices", lambda x: x),
    )
    return facts.select("file_id", F.explode(found).alias("x")).select("file_id", "x.line", "x.rule", "x.details")


def needs_styles(text: Column) -> Column:
    """Native elements, or class and style attributes; a file of components alone needs no styles."""
    return text.rlike(r"<[a-z][a-z0-9]*[\s/>]") | text.rlike(r"\s(class|style)\s*=")


def missing_companions(files: DataFrame, only_when_styled: bool = True) -> DataFrame:
    """file_id, line, rule, details of component files whose companion isn't among files: code in markup without a code file, and
    markup with styles without a style file. An anti-join on paths, in either case."""
    own = files.filter(F.endswith(F.lower("rel_path"), F.lit(".razor"))).withColumn("text", F.coalesce("text", F.lit("")))
    there = files.select(F.upper("rel_path").alias("there"))
    out = []
    for rule, ext in COMPANIONS.items():
        need = F.col("text").rlike(r"@code\s*\{") if ext == ".cs" else needs_styles(F.col("text")) | F.lit(not only_when_styled)
        lacking = own.filter(need).withColumn("wanted", F.upper(F.concat("rel_path", F.lit(ext)))).join(there, F.col("wanted") == F.col("there"), "left_anti")
        out.append(_row(lacking, rule, F.lit(1), F.concat(F.element_at(F.split("rel_path", "/"), -1), F.lit(ext))))
    return reduce(DataFrame.unionByName, out)


def language(rule: Column) -> Column:
    """The language that a rule's id begins with."""
    upper = F.upper(rule)
    return F.when(F.startswith(upper, F.lit("CSS_")), "css").when(F.startswith(upper, F.lit("JS_")), "js").when(F.startswith(upper, F.lit("RAZOR_")), "razor").otherwise("cs")


def unsuppressed_web(found: DataFrame, files: DataFrame, marker: str, ignored: list[str] | None = None) -> DataFrame:
    """found without what a file turns off: the marker and the rule's id, or `all`, anywhere in its text, in either case. ignored: languages
    whose marks don't count (`all`: none do)."""
    ignored = ignored or []
    text = F.upper(F.coalesce("text", F.lit("")))
    said = lambda what: F.contains(text, F.concat(F.lit(f"{marker} ".upper()), F.upper(what)))
    # only files that have the marker at all are met
    marked = files.filter(F.contains(text, F.lit(marker.upper()))).select(F.col("file_id").alias("marked_id"), "text")
    both = found.join(marked, found["file_id"] == marked["marked_id"], "left")
    off = F.col("marked_id").isNotNull() & (said(F.lit("all")) | said(F.col("rule")))
    counts = F.lit("all" not in ignored) & ~language(F.col("rule")).isin(ignored or [""])
    return both.filter(~(off & counts)).select(found.columns)

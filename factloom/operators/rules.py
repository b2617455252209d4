"""Rules over facts: violations, suppressions, limits with exceptions, severities and summaries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """predicate and details over a fact row; line, if the fact has one."""

    rule_id: str
    severity: str
    intent: str
    predicate: Callable[[dict], Column]
    details: Callable[[dict], Column]
    limits: tuple[tuple[str, int], ...] = ()


def violations(facts: DataFrame, rules: list[Rule], limits: dict[str, int] | None = None, line: str | None = None) -> DataFrame:
    """file_id, line, rule, details: one scan for all rules. A rule whose limit is 0 or less is off."""
    found = []
    for r in rules:
        own = dict(r.limits) | {k: v for k, v in (limits or {}).items() if k in dict(r.limits)}
        if any(v <= 0 for v in own.values()):
            continue
        row = F.struct((F.col(line) if line else F.lit(1)).cast("int").alias("line"), F.lit(r.rule_id).alias("rule"), r.details(own).alias("details"))
        found.append(F.when(r.predicate(own), row))
    return facts.select("file_id", F.explode(F.array_compact(F.array(*found))).alias("v")).select("file_id", "v.line", "v.rule", "v.details")


def metadata(rules: list[Rule], spark) -> DataFrame:
    return spark.createDataFrame([(r.rule_id, r.severity, r.intent) for r in rules], "rule string, severity string, intent string")


def with_severity(found: DataFrame, meta: DataFrame, fallback: str = "warning") -> DataFrame:
    """found with severity and intent; one fallback for rules without metadata, for display and for the exit code alike."""
    known = F.broadcast(meta)  # a row for each rule of the program
    joined = found.join(known, "rule", "left")
    return joined.withColumn("severity", F.coalesce("severity", F.lit(fallback))).withColumn("intent", F.coalesce("intent", F.lit("unknown")))


def find_rules(meta: DataFrame, term: str | None = None) -> DataFrame:
    """The catalogue, or the rules that hold the term in any column, in either case."""
    if not term:
        return meta.orderBy("rule")
    asked = F.upper(F.lit(term))
    hit = reduce(Column.__or__, [F.contains(F.upper(F.coalesce(c, F.lit(""))), asked) for c in meta.columns])
    return meta.filter(hit).orderBy("rule")


def suppressions(lines: DataFrame, marker: str) -> DataFrame:
    """(file_id, line_no, rule) of marker comments: what follows the marker up to a separator; nothing or `all` is all."""
    at = F.instr("line", F.lit(marker))
    word = F.element_at(F.split(F.trim(F.substring(F.col("line"), at + len(marker), F.length("line"))), r"[ ,;*@/]+"), 1)
    rule = F.when((word == "") | (F.upper(word) == "ALL"), "all").otherwise(word)
    return lines.filter(at > 0).select("file_id", "line_no", rule.alias("rule"))


def unsuppressed(found: DataFrame, marks: DataFrame) -> DataFrame:
    """found without rules that a mark anywhere in their file names by a prefix, in either case, or by `all`."""
    marks = marks.select("file_id", F.upper("rule").alias("mark")).distinct()
    match = (F.col("mark") == "ALL") | F.startswith(F.upper("rule"), F.col("mark"))
    return found.join(marks, (found["file_id"] == marks["file_id"]) & match, "left_anti")


def has_disable_all(text: Column, marker: str) -> Column:
    return text.rlike(rf"(?m)^// {marker} all\r?$")


def relaxed_limit(facts: DataFrame, entries: list[dict], default: int) -> Column:
    """The limit of the first entry whose bounds all hold: {at_most: {metric: n}, at_least: {metric: n}, limit: n}. A limit of
    0 drops the rule, -1 removes the bound."""
    out = F.lit(default)
    for entry in reversed(entries):
        holds = F.lit(True)
        for metric, n in entry.get("at_most", {}).items():
            holds = holds & (facts[metric] <= n)
        for metric, n in entry.get("at_least", {}).items():
            holds = holds & (facts[metric] >= n)
        out = F.when(holds, entry["limit"]).otherwise(out)
    return out


def severity_override(facts: DataFrame, entries: list[dict]) -> Column:
    """The override of the first entry that has one, if its bounds hold; later entries aren't asked."""
    entry = next((e for e in entries if e.get("severity")), None)
    if entry is None:
        return F.lit(None).cast("string")
    return F.when(relaxed_limit(facts, [entry | {"limit": 1}], 0) == 1, entry["severity"])


def by_rule(found: DataFrame) -> DataFrame:
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file_id").alias("files")).orderBy(F.desc("n"), "rule")


def by_file(found: DataFrame) -> DataFrame:
    return found.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules")).orderBy(F.desc("n"), "file_id")


def ordered(found: DataFrame, most: int) -> DataFrame:
    """The first `most` by severity, path, line and rule."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return found.orderBy(rank, F.upper("rel_path"), "line", "rule").limit(most)


def pattern_buckets(found: DataFrame, patterns: DataFrame, most: int) -> DataFrame:
    """Named sets of rules: count, and the first files of each. patterns: pattern, rule; a rule may be in several."""
    hits = found.join(F.broadcast(patterns), "rule")
    w = Window.partitionBy("pattern").orderBy("file_id", "line", "rule")
    totals = hits.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    first = hits.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= most)
    shown = first.groupBy("pattern").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "file_id"))), lambda x: x["file_id"].cast("string")), ",").alias("first_files"), F.count(F.lit(1)).alias("shown"))
    return totals.join(shown, "pattern").select("pattern", "n", "first_files", (F.col("n") - F.col("shown")).alias("more"))


def gate_score(found: DataFrame, classes: DataFrame, least: float = 8.0) -> DataFrame:
    """One row: 10 less penalties for violations, mean complexity and footprint, plus a bonus for sealed classes, kept
    between 0 and 10; passed if it reaches the least score. Both sides have the same scope.

    found: severity; classes: complexity, footprint, is_sealed."""
    weight = F.when(F.col("severity") == "error", 2.0).when(F.col("severity") == "warning", 1.0).otherwise(0.25)
    penalty = found.agg(F.coalesce(F.sum(weight), F.lit(0.0)).alias("penalty"), F.count(F.lit(1)).alias("violations"))
    means = classes.agg(F.count(F.lit(1)).alias("classes"), F.coalesce(F.avg("complexity"), F.lit(0.0)).alias("complexity"), F.coalesce(F.avg("footprint"), F.lit(0.0)).alias("footprint"), F.coalesce(F.avg(F.col("is_sealed").cast("int")), F.lit(0.0)).alias("sealed"))
    one = penalty.crossJoin(means)  # a row each
    per_class = F.col("penalty") * 1.5 / F.greatest(F.col("classes"), F.lit(1))
    raw = 10 - per_class - F.greatest(F.lit(0.0), F.col("complexity") - 5) * 0.5 - F.greatest(F.lit(0.0), F.col("footprint") - 1000) / 1000 + F.col("sealed") * 0.5
    score = F.greatest(F.lit(0.0), F.least(F.lit(10.0), raw))
    return one.select("violations", "classes", score.alias("score"), (score >= least).alias("passed"))


def top_issue(found: DataFrame, most: int) -> DataFrame:
    """Rules among the first `most` violations, most frequent first."""
    return ordered(found, most).groupBy("rule").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rule")

"""Text search over source files, with context and the caps that a reply has to keep."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .ranked import ordered


def source_lines(files: DataFrame, key: str = "file_id", path: str = "rel_path") -> DataFrame:
    """(file, path, line_no from 1, text)."""
    return files.select(key, path, F.posexplode(tx.lines(F.col("text"))).alias("pos", "line")).select(key, path, (F.col("pos") + 1).alias("line_no"), "line")


def plain_hits(files: DataFrame, term: str) -> DataFrame:
    """Lines that hold the term in either case, with the number of matches."""
    hits = source_lines(files.filter(F.contains(F.upper("text"), F.upper(F.lit(term)))))
    return hits.withColumn("matches", tx.occurrences(F.col("line"), term)).filter("matches > 0")


def regex_hits(files: DataFrame, pattern: str) -> DataFrame:
    """Lines that the pattern matches, each taken by itself, with the number of matches. Whole texts aren't asked first: ^, $, \\A
    and \\z don't match there at inner lines."""
    return source_lines(files).withColumn("matches", F.regexp_count("line", F.lit(pattern)).cast("long")).filter("matches > 0")


def _ranges(line: Column, pattern: str) -> Column:
    """Array of struct(col from 1, len) of the pattern's matches, leftmost and non-overlapping. Each match is found once by itself and once
    with all that comes before it, so the difference of lengths is where it begins. After an empty match one character is passed; one
    that had something before it is found there a second time, which is left out.

    What comes before begins where the last match ended, or one character on: without that, the rest of a line after its last match
    would be searched from each of its characters. Both arrays are items of one array, so that they are made once a line, not once a match."""
    sizes = F.transform(F.regexp_extract_all(line, F.lit(pattern), F.lit(0)), lambda x: F.length(x))
    upto = F.transform(F.regexp_extract_all(line, F.lit(rf"(?:\G|(?<=\G(?s:.)))(?:(?s:.*?))(?:{pattern})"), F.lit(0)), lambda x: F.length(x))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.lit(False).alias("again"), F.array().cast("array<struct<col:int,len:int>>").alias("found"))

    def folded(both: Column) -> Column:
        def step(acc: Column, whole: Column) -> Column:
            size = F.coalesce(F.get(both["sizes"], acc["i"]), F.lit(0))
            one = F.struct((acc["at"] + whole - size + 1).cast("int").alias("col"), size.cast("int").alias("len"))
            again = ~acc["again"] & (size == 0) & (whole > 0)
            found = F.when(acc["again"], acc["found"]).otherwise(F.array_append(acc["found"], one))
            return F.struct((acc["at"] + whole + F.when(whole == 0, 1).otherwise(0)).alias("at"), (acc["i"] + F.when(acc["again"], 0).otherwise(1)).alias("i"), again.alias("again"), found.alias("found"))

        return F.aggregate(both["upto"], start, step, lambda acc: acc["found"])

    return F.transform(F.array(F.struct(sizes.alias("sizes"), upto.alias("upto"))), folded)[0]


def match_ranges(hits: DataFrame, pattern: str) -> DataFrame:
    """hits and their match ranges: array of struct(col from 1, len). A null line has none."""
    return hits.withColumn("ranges", _ranges(F.coalesce("line", F.lit("")), pattern))


def term_ranges(hits: DataFrame, term: str) -> DataFrame:
    """hits and the ranges of a plain term, in either case."""
    return match_ranges(hits, f"(?i)\\Q{term}\\E") if "\\E" not in term else match_ranges(hits, "(?i)" + re.sub(r"(\W)", r"\\\1", term))


def with_context(files: DataFrame, hits: DataFrame, before: int, after: int) -> DataFrame:
    """hits and the lines before and after each; one array of lines a file, whatever its number of hits."""
    all_lines = files.select("file_id", tx.lines(F.col("text")).alias("all_lines"))
    near = tx.context(F.col("all_lines"), F.col("line_no"), before, after)
    return hits.join(all_lines, "file_id").withColumn("context", near).select(*hits.columns, "context.before", "context.after")


def capped(hits: DataFrame, max_files: int = 0, max_results: int = 50, max_bytes: int = 0) -> DataFrame:
    """hits within the caps, applied in this order; 0 is no cap. The caps are this operator's purpose: a reply's size. The byte cap is
    on the reply's payload, a JSON array: rows go in as long as brackets, rows and the commas between them fit."""
    hits = hits.withColumn("path_key", F.upper("rel_path"))
    if max_files:
        first = hits.select("path_key").distinct().orderBy("path_key").limit(max_files)
        hits = hits.join(F.broadcast(first), "path_key", "left_semi")
    if max_results:
        hits = hits.orderBy("path_key", "line_no").limit(max_results)
    if max_bytes:
        row = F.octet_length(F.to_json(F.struct("rel_path", "line_no", "line")))
        hits = ordered(hits, "path_key", "line_no", size=row + 1).filter(F.col("used") + 1 <= max_bytes).drop("used", "rank")
    return hits.drop("path_key")


def completeness(total: DataFrame, shown: DataFrame, max_files: int, max_results: int, max_bytes: int) -> DataFrame:
    """One row: total, shown, truncated, and why."""
    row = total.agg(F.count(F.lit(1)).alias("total"), F.countDistinct("rel_path").alias("files")).crossJoin(shown.agg(F.count(F.lit(1)).alias("shown")))
    reasons = F.array_compact(F.array(F.when((F.col("files") > max_files) & (F.lit(max_files) > 0), "maxFiles"), F.when((F.col("total") > max_results) & (F.lit(max_results) > 0), "maxResults"), F.when((F.col("shown") < F.col("total")) & (F.lit(max_bytes) > 0), "maxResponseBytes")))
    return row.select("total", "shown", (F.col("shown") < F.col("total")).alias("truncated"), reasons.alias("reasons"))


def enriched(hits: DataFrame, tokens: DataFrame) -> DataFrame:
    """hits with what they lie on. tokens: file_id, line_no, kind, symbol_id, project. Several projects make it ambiguous."""
    on = tokens.groupBy("file_id", "line_no").agg(F.min_by("kind", "symbol_id").alias("kind"), F.min("symbol_id").alias("symbol_id"), F.countDistinct("project").alias("projects"))
    how = F.when(F.col("projects").isNull(), "unavailable").when(F.col("symbol_id").isNull(), "not_applicable").when(F.col("projects") > 1, "ambiguous").otherwise("resolved")
    return hits.join(on, ["file_id", "line_no"], "left").withColumn("resolution", how).drop("projects")

"""Lines, markup and messages, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def tree_lines(text: Column) -> Column:
    """Lines as a syntax tree counts them: an empty last one counts."""
    return F.size(lines(text))


def read_lines(text: Column) -> Column:
    """Lines as a reader returns them: an empty last one doesn't count."""
    return F.when(F.length(text) == 0, 0).otherwise(F.size(lines(text)) - F.when(F.endswith(text, F.lit("\n")), 1).otherwise(0))


def web_lines(text: Column) -> Column:
    """Line breaks and one, 0 for an empty file."""
    return F.when(F.length(text) == 0, 0).otherwise(F.size(lines(text)))


def occurrences(text: Column, term: str) -> Column:
    """Non-overlapping plain matches in either case."""
    up = F.upper(text)
    return ((F.length(up) - F.length(F.replace(up, F.upper(F.lit(term)), F.lit("")))) / len(term)).cast("long")


def comment_counts(text: Column) -> Column:
    """struct(code, comment, blank): a fold over the lines that carries whether a block comment is open."""
    start = F.struct(*(F.lit(0).alias(k) for k in ("code", "comment", "blank")), F.lit(False).alias("open"))

    def step(acc: Column, raw: Column) -> Column:
        line = F.trim(raw)
        opens = ~acc["open"] & F.startswith(line, F.lit("/*"))
        inside = acc["open"] | opens
        blank = ~inside & (F.length(line) == 0)
        comment = inside | F.startswith(line, F.lit("//"))
        one = lambda c: F.when(c, 1).otherwise(0)
        return F.struct((acc["code"] + one(~comment & ~blank)).alias("code"), (acc["comment"] + one(comment & ~blank)).alias("comment"), (acc["blank"] + one(blank)).alias("blank"), (inside & ~F.contains(line, F.lit("*/"))).alias("open"))

    return F.aggregate(lines(text), start, step)


def context(all_lines: Column, line_no: Column, before: int, after: int) -> Column:
    """The lines around a 1-based line, itself left out, as struct(before, after) of arrays."""
    first = F.greatest(F.lit(1), line_no - before)
    return F.struct(F.slice(all_lines, first, line_no - first).alias("before"), F.slice(all_lines, line_no + 1, F.lit(after)).alias("after"))


def snippet(all_lines: Column, line_no: Column, around: int, most: int = 15) -> Column:
    """Numbered lines around a line, with a gutter."""
    around = min(max(around, 0), 5)
    first = F.greatest(F.lit(1), line_no - around)
    size = F.least(F.lit(most), line_no + around - first + 1)
    return F.array_join(F.transform(F.slice(all_lines, first, size), lambda x, i: F.concat((first + i).cast("string"), F.lit(": "), x)), "\n")


def selector_depth(selectors: Column) -> Column:
    """The most segments in a comma list of style selectors."""
    return F.array_max(F.transform(F.split(selectors, ","), lambda s: F.size(F.filter(F.split(s, "[ >+~]"), lambda x: x != ""))))


def nesting_depth(markup: Column, void: str = "area|base|br|col|embed|hr|img|input|link|meta|source|track|wbr") -> Column:
    """Deepest open tags: a running depth over tag events that never falls below 0."""
    tags = F.regexp_extract_all(markup, F.lit(r"(</?[A-Za-z][^>]*>)"), F.lit(1))

    def step(acc: Column, tag: Column) -> Column:
        flat = tag.rlike(rf"(?i)^<({void})\b") | F.endswith(tag, F.lit("/>"))
        move = F.when(F.startswith(tag, F.lit("</")), -1).when(flat, 0).otherwise(1)
        depth = F.greatest(F.lit(0), acc["depth"] + move)
        return F.struct(depth.alias("depth"), F.greatest(acc["most"], depth).alias("most"))

    return F.aggregate(tags, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("most")), step, lambda acc: acc["most"])


def error_code(response: Column, message: Column, success: Column, is_error: Column) -> Column:
    """The code after the first [ERROR]: mark of the response, else of the message; EXCEPTION for a failed call without
    one, UNCLASSIFIED for an error result without one, null if there is no error."""

    def code(text: Column) -> Column:
        at = F.instr(F.lower(text), F.lit("[error]:"))
        tail = F.when(at > 0, F.substring(text, at + 8, F.length(text)))
        return F.nullif(F.regexp_extract(tail, r"^\s*([\p{Lu}\p{Nd}_]+)\s*:", 1), F.lit(""))

    return F.coalesce(code(response), code(message), F.when(~success, "EXCEPTION"), F.when(is_error, "UNCLASSIFIED"))


def completeness(text: Column, truncated: Column) -> Column:
    """truncated before complete before unknown, by the marks that a response holds."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(truncated | F.contains(low, F.lit("truncated")), "truncated").when(F.contains(low, F.lit("complete")), "complete").otherwise("unknown")


def byte_size(n: Column) -> Column:
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1024 * 1024, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.1f MB", n / (1024 * 1024)))


#: Capitals of one letter whose small letters have two in upper().
_CAPITALS = [c for c in map(chr, range(0xDF, 0x2000)) if len(c.lower()) == 1 and len(c.lower().upper()) > 1 and c != c.lower()]


def letterwise_upper(text: Column) -> Column:
    """Upper case with a letter for a letter, as in SQL: what has no capital of one letter stays."""
    known = F.translate(text, "".join(c.lower() for c in _CAPITALS), "".join(_CAPITALS))
    return F.array_join(F.transform(F.split(known, ""), lambda c: F.when(F.char_length(F.upper(c)) == 1, F.upper(c)).otherwise(c)), "")

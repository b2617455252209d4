"""Tests and what they cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dealing import dealt_join


def _tested() -> Column:
    """The name that a test class is named after."""
    return F.regexp_replace("class_name", r"(Tests?|Specs?)$", "")


def covering_tests(symbols: DataFrame, tests: DataFrame) -> DataFrame:
    """(symbol, file, reason): test files that speak of a symbol, each with its strongest reason: a covers mark, a typeof, the
    expected test class name, or a mention. symbols: name; tests: file, class_name, text_words (array), covers (array),
    typeofs (array). Names meet by equality, never all against all."""
    s = symbols.select(F.col("name").alias("symbol")).distinct()
    covers = tests.select("file", F.explode("covers").alias("symbol"), F.lit(1).alias("rank"))
    types = tests.select("file", F.explode("typeofs").alias("symbol"), F.lit(2).alias("rank"))
    named = tests.select("file", _tested().alias("symbol"), F.lit(3).alias("rank"))
    words = tests.select("file", F.explode(F.array_distinct("text_words")).alias("symbol"), F.lit(4).alias("rank"))
    hits = covers.unionByName(types).unionByName(named).unionByName(words)
    best = dealt_join(hits, s, "symbol", "file").groupBy("symbol", "file").agg(F.min("rank").alias("rank"))
    reasons = F.create_map(*(x for k, v in ((1, "covers"), (2, "typeof"), (3, "name"), (4, "mention")) for x in (F.lit(k), F.lit(v))))
    return best.select("symbol", "file", reasons[F.col("rank")].alias("reason"))


def uncovered(symbols: DataFrame, tests: DataFrame, least_cognitive: int = 3) -> DataFrame:
    """Symbols more complex than allowed that no test names, marks or takes the type of. Only the names are asked for, not the tests
    that have them: a name that many tests have is one row from each task."""
    marked = [tests.select(F.explode(c).alias("name")) for c in ("covers", "typeofs")]
    found = marked[0].unionByName(marked[1]).unionByName(tests.select(_tested().alias("name"))).distinct()
    return symbols.filter(F.col("cognitive") > least_cognitive).join(found, "name", "left_anti")


def commands(tests: DataFrame) -> DataFrame:
    """Test classes of each project as one filter expression."""
    return tests.groupBy("project").agg(F.array_join(F.array_sort(F.collect_set("class_name")), "|").alias("filter"), F.count(F.lit(1)).alias("tests"))

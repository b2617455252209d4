"""Literals worth naming: grouping, summaries and constants defined more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grouped(literals: DataFrame, least: int = 1) -> DataFrame:
    """literals (file_id, line, col, category, value) by category, value and file; line and column are least on their own."""
    return literals.groupBy("category", "value", "file_id").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("line"), F.min("col").alias("col")).filter(F.col("n") >= least)


def summary(groups: DataFrame, shown: int) -> DataFrame:
    """Groups and occurrences of each category; every category is reported."""
    return groups.groupBy("category").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("occurrences"), F.least(F.count(F.lit(1)), F.lit(shown)).alias("shown"))


def duplicate_constants(constants: DataFrame, least_files: int = 2) -> DataFrame:
    """Values of a type that constants of several files have, with those files."""
    return (
        constants.groupBy("kind", "value")
        .agg(F.countDistinct("file_id").alias("files"), F.count(F.lit(1)).alias("n"), F.min("file_id").alias("first_file"))
        .filter(F.col("files") >= least_files)
    )


def with_duplicates(literals: DataFrame, constants: DataFrame) -> DataFrame:
    """literal rows and a row for each constant whose value several files define."""
    twice = duplicate_constants(constants).select("kind", "value")
    rows = constants.join(twice, ["kind", "value"], "left_semi").select("file_id", "line", "col", F.lit("duplicate_constant").alias("category"), "value")
    return literals.select("file_id", "line", "col", "category", "value").unionByName(rows)

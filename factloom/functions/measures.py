"""Thresholds, similarity and fingerprints, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def threshold_status(value: Column, limit: Column, tolerance: Column) -> Column:
    return F.when(limit <= 0, "OK").when(value > limit, "VIOLATION").when(value >= limit - tolerance, "WARN").otherwise("OK")


def similarity_bucket(score: Column, exact: float = 0.95, near: float = 0.80) -> Column:
    return F.when(score >= exact, "Exact").when(score >= near, "Near").otherwise("Fuzzy")


def hotspot_level(utilisation: Column) -> Column:
    """Percent of a limit: critical from 95, warning from 80."""
    return F.when(utilisation >= 95, "critical").when(utilisation >= 80, "warning").otherwise("ok")


def grams(tokens: Column, size: int = 5) -> Column:
    """Distinct hashes of the windows of consecutive tokens; empty with too few tokens."""
    n = F.size(tokens) - size + 1
    # items are taken one by one: a slice would copy the whole array for each window; each is hashed by itself, as a joining character
    # could be part of one
    windows = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.xxhash64(*(F.get(tokens, i + k) for k in range(size))))
    return F.when(n >= 1, F.array_distinct(windows)).otherwise(F.array().cast("array<bigint>"))


def normal_token(text: Column, kind: Column) -> Column:
    return F.when(kind == "ident", "$ID$").when(kind == "literal", "$LIT$").otherwise(text)


def jaccard(shared: Column, left: Column, right: Column) -> Column:
    return shared / (left + right - shared)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def number_kind(value: Column, kind: Column, context: Column) -> Column:
    """Kind of a number literal: status codes win over everything, so 360 is never a time constant."""
    n = value.cast("double")
    whole = n == F.floor(n)
    return (
        F.when((kind == "int") & whole & n.between(100, 599), "http_status")
        .when(F.upper(context).rlike("TIMEOUT|DELAY|INTERVAL|DURATION"), "timeout")
        .when((kind == "float") & context.rlike("(?i)const|static|readonly"), "named_constant")
        .when(n.isin(24.0, 60.0, 1000.0, 1024.0, 3600.0, 86400.0), "well_known")
        .otherwise("magic_number")
    )


def string_kind(value: Column, context: Column) -> Column:
    """Kind of a string literal by a fixed order of tests: secrets first."""
    return (
        F.when(context.rlike("(?i)password|secret|token|api_?key") | value.rlike(r"(?i)^(bearer |AKIA[A-Z0-9]{12})"), "security")
        .when(context.rlike("(?i)localiz|resource|i18n"), "localisation")
        .when(value.rlike(r"(?i)(server|data source|initial catalog|user id)\s*="), "connection_string")
        .when(value.rlike(r"(?i)^(https?|ftp)://"), "url")
        .when(value.rlike(r"^[A-Za-z]:\\"), "windows_path")
        .when(value.rlike(r"\{\d+(:[^}]*)?\}"), "format_string")
        .when(value.rlike(r"^X-[A-Za-z-]+$"), "header_id")
        .when(value.rlike(r"^[A-Z][A-Za-z0-9]+$"), "nameof_candidate")
        .otherwise("magic_string")
    )


def is_trivial_literal(value: Column) -> Column:
    return value.isin("-1", "0", "1", "", " ", "\n")

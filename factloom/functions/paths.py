"""Paths and names: normalising, globs, scopes and classification, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^\./|/+$", "")


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def slice_key(path: Column, depth: int = 2) -> Column:
    """The first segments of a path."""
    return F.substring_index(path, "/", depth)


def prefixes(path: Column, depth: int) -> Column:
    """'' and the directory prefixes of a path down to a depth, as an array."""
    parts = F.split(path, "/")
    levels = F.sequence(F.lit(0), F.least(F.lit(depth), F.size(parts) - 1))
    return F.transform(levels, lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def glob_regex(pattern: str, by_segment: bool) -> str:
    """A case-insensitive expression for a glob: by segment, ** crosses separators and * doesn't; else * matches anything."""
    out, i = [], 0
    while i < len(pattern):
        if by_segment and pattern.startswith("**", i):
            out.append(".*")
            i += 2
        elif pattern[i] == "*":
            out.append("[^/]*" if by_segment else ".*")
            i += 1
        elif pattern[i] == "?":
            out.append(".")
            i += 1
        else:
            out.append(re.sub(r"([\\.\[\]{}()+^$|])", r"\\\1", pattern[i]))
            i += 1
    return f"(?i)^{''.join(out)}$"


def matches_any(column: Column, patterns: list[str], by_segment: bool = False) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | column.rlike(glob_regex(p, by_segment))
    return found


def in_scope(path: Column, project: Column, scope: str | None) -> Column:
    """Path or project holds the scope text, in either case; an empty scope holds everything."""
    if not scope:
        return F.lit(True)
    asked = F.upper(F.lit(scope))
    return F.contains(F.upper(path), asked) | F.contains(F.upper(project), asked)


def namespace_allowed(namespace: Column, include: list[str], exclude: list[str]) -> Column:
    inside = matches_any(namespace, include) if include else F.lit(True)
    return inside & ~matches_any(namespace, exclude)


def is_excluded(path: Column, names: list[str], directories: list[str]) -> Column:
    """File-name globs, and directory names anywhere on the path."""
    found = matches_any(file_name(path), names)
    for d in directories:
        found = found | F.contains(F.upper(F.concat(F.lit("/"), path)), F.upper(F.lit(f"/{d}/")))
    return found


def is_generated_path(path: Column) -> Column:
    return path.rlike(r"(?i)(^|/)(obj|bin|node_modules|worktrees|\.worktrees)/") | path.rlike(r"(?i)\.(g|g\.i|designer|generated)\.cs$")


def is_test_path(path: Column) -> Column:
    return path.rlike(r"(?i)(^|/)[^/]*tests?[^/]*/") | path.rlike(r"(?i)tests?\.[a-z]+$")


def test_category(trait: Column, path: Column) -> Column:
    """An explicit trait, else what the path says, else Unit."""
    up = F.upper(path)
    guess = F.when(F.contains(up, F.lit("INTEGRATION")), "Integration").when(F.contains(up, F.lit("E2E")), "E2E").when(F.contains(up, F.lit("COMPONENT")), "Component").otherwise("Unit")
    return F.coalesce(F.nullif(trait, F.lit("")), guess)


def project_kind(name: Column, output: Column) -> Column:
    return F.when(F.upper(name).rlike("TESTS?$"), "Test").when(F.upper(output) == "EXE", "Exe").otherwise("Lib")

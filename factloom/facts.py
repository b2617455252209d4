"""Fact tables: explicit schemas that every analysis reads, whether facts come from a loader or from a surrogate table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_DDL = {
    "source_file": "file_id long, project string, rel_path string, ext string, text string, bytes long, sha256 string, mtime timestamp, is_test boolean, is_generated boolean",
    "source_line": "file_id long, line_no int, text string",
    "type_decl": "type_id string, file_id long, name string, namespace string, kind string, visibility string, is_sealed boolean, is_static boolean, is_abstract boolean, is_partial boolean, start_line int, end_line int",
    "type_base": "type_id string, base_id string, base_kind string",
    "member_decl": "member_id string, type_id string, kind string, name string, visibility string, start_line int, end_line int, code_lines int, cyclomatic int, cognitive int, param_types array<string>",
    "token": "member_id string, ord int, text string, kind string",
    "reference": "caller_id string, callee_id string, file_id long, line int, col int",
    "type_reference": "from_file long, to_file long, type_name string",
    "literal": "file_id long, line int, col int, kind string, value string, context string",
    "violation": "file_id long, line int, rule string, details string, guidance string, effective_severity string",
    "suppression": "file_id long, line int, rule string",
    "tool_call": "log_file string, line_no long, ts timestamp, tool string, pid long, instance_id string, duration_ms long, is_error boolean, error_code string, truncated boolean, completeness string, is_loading boolean",
    "baseline": "path string, sha256 string",
    "hunk": "path string, start_line int, line_count int",
    "rule_metadata": "rule_id string, severity string, intent string, is_metric boolean, default_limit int, has_autofix boolean",
}


def ddl(table: str) -> str:
    return _DDL[table]


def conform(df: DataFrame, table: str) -> DataFrame:
    """df with the table's columns in order and type; missing columns are null."""
    out = []
    for part in _split(_DDL[table]):
        name, kind = part.split(" ", 1)
        out.append((F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name))
    return df.select(*out)


def _split(text: str) -> list[str]:
    """Fields of a flat DDL string; array types have no comma inside."""
    return [x.strip() for x in text.split(",")]

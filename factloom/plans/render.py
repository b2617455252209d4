"""Thin text renderings of small results."""

from __future__ import annotations

from pyspark.sql import DataFrame


def markdown(rows: DataFrame, most: int = 200) -> str:
    """The first rows as a table, and how many there are beyond."""
    got = rows.limit(most + 1).collect()
    head = f"| {' | '.join(rows.columns)} |\n|{'---|' * len(rows.columns)}\n"
    body = "".join(f"| {' | '.join('' if v is None else str(v).replace('|', chr(92) + '|') for v in r)} |\n" for r in got[:most])
    return head + body + ("…\n" if len(got) > most else "")


def tree(prefixes: DataFrame, value: str, most: int = 1000) -> str:
    """Rollup rows (prefix, value) as an indented tree."""
    rows = sorted((r["prefix"], r[value]) for r in prefixes.select("prefix", value).limit(most).collect())
    return "".join(f"{'  ' * (p.count('/') + bool(p))}{p.rpartition('/')[2] or '.'}  {v}\n" for p, v in rows)


def mermaid(edges: DataFrame, parent: str, child: str, most: int = 250) -> str:
    """Edges as a flow chart."""
    got = edges.select(parent, child).distinct().orderBy(parent, child).limit(most).collect()
    names = {n: f"n{i}" for i, n in enumerate(sorted({str(x) for r in got for x in r}))}
    lines = [f'  {i}["{n}"]' for n, i in names.items()] + [f"  {names[str(r[0])]} --> {names[str(r[1])]}" for r in got]
    return "graph TD\n" + "\n".join(lines) + "\n"

"""Baselines over `documents`: the stored state leaves some out and changes or moves others."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import change
from .registry import query, table

_STATES = """now as (select 'd/' || doc_id as path, sha256(coalesce(text, '')) as sha256 from documents),
was as (select case when doc_id % 17 = 0 then 'old/' || doc_id else 'd/' || doc_id end as path, sha256(coalesce(text, '') || case when doc_id % 13 = 0 then 'x' else '' end) as sha256 from documents)"""


def _states(spark, sf_dir):
    d, i, t = table(spark, sf_dir, "documents"), F.col("doc_id"), F.coalesce("text", F.lit(""))
    name = lambda p: F.concat(F.lit(p), i.cast("string"))
    now = d.select(name("d/").alias("path"), F.sha2(t, 256).alias("sha256"))
    was = d.select(F.when(i % 17 == 0, name("old/")).otherwise(name("d/")).alias("path"), F.sha2(F.concat(t, F.when(i % 13 == 0, "x").otherwise("")), 256).alias("sha256"))
    return was, now


_DIFF = f"""{_STATES}, b as (select coalesce(w.path, n.path) as path, w.sha256 as ws, n.sha256 as ns from was w full join now n on n.path = w.path),
fs as (select sha256, min(path) as p from was group by sha256), src as (select * from fs where p in (select path from b where ns is null)), tgt as (select ns, min(path) as p from b where ws is null group by ns),
rn as (select tgt.p as path, src.p as old_path from src join tgt on tgt.ns = src.sha256),
x as (select path, 'changed' as status, null as old_path from b where ws <> ns union all select path, 'renamed', old_path from rn union all select path, 'removed', null from b where ns is null and path not in (select old_path from rn)
  union all select path, 'new', null from b where ws is null and path not in (select path from rn))"""


@query(f"with {_DIFF} select path, status, old_path from x")
def baseline_diff(spark, sf_dir):
    return change.compare(*_states(spark, sf_dir))


@query(f"with {_DIFF} select path from now where path in (select 'd/' || doc_id from documents where contains(text, 'that')) and path in (select path from x where status <> 'removed')")
def ratcheted_violations(spark, sf_dir):
    was, now = _states(spark, sf_dir)
    found = table(spark, sf_dir, "documents").filter(F.contains("text", F.lit("that"))).select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"))
    return change.ratchet(found, change.compare(was, now))


@query(f"with {_STATES} select n.path from now n left join was w on w.path = n.path and w.sha256 = n.sha256 where w.path is null")
def incremental_work(spark, sf_dir):
    was, now = _states(spark, sf_dir)
    tag = F.lit("c1").alias("config_hash")
    return change.pending(now.select("path", "sha256", tag), was.select("path", "sha256", tag)).select("path")


@query(f"with {_STATES} select n.path, n.sha256 from now n")
def cache_refresh(spark, sf_dir):
    was, now = _states(spark, sf_dir)
    tag = F.lit("c1").alias("config_hash")
    old, files = was.select("path", "sha256", tag), now.select("path", "sha256", tag)
    return change.refreshed(old, change.pending(files, old), files).select("path", "sha256")


@query("select sha2 as sha256, count(*) as copies, min(doc_id) as first_id from (select doc_id, sha256(coalesce(text, '')) as sha2 from documents) group by sha2 having count(*) > 1")
def checksum_copies(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    return rows.groupBy("sha256").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")

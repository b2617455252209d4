"""Log analysis over `events`: a user is a log, an event is a call. The burst window is widened, since events are sparse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..facts import conform
from ..functions import text as tx
from ..operators import logs
from .registry import query, table

WINDOW = 6 * 3600

_CALLS = r"""calls as (select cast(user_id as varchar) as log_file, event_id as line_no, ts, event_type as tool, user_id as pid, cast(floor(value) as bigint) as duration_ms,
    event_type = 'error' as is_error, event_type = 'error' as is_loading, k % 7 = 0 as truncated,
    case when event_type = 'error' then '[ERROR]: E_' || (k % 3) || ': failed' when k % 5 = 0 then 'scan complete' else 'ok' end as response
  from (select *, cast(regexp_extract(props, '(\d+)', 1) as integer) as k from events)),
coded as (select *, case when is_error then regexp_extract(response, '\[ERROR\]: *([A-Z0-9_]+) *:', 1) end as error_code,
    case when truncated then 'truncated' when contains(response, 'complete') then 'complete' else 'unknown' end as completeness from calls)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    error = F.col("event_type") == "error"
    response = F.when(error, F.concat(F.lit("[ERROR]: E_"), (k % 3).cast("string"), F.lit(": failed"))).when(k % 5 == 0, "scan complete").otherwise("ok")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("log_file"), F.col("event_id").alias("line_no"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("tool"), F.col("user_id").alias("pid"),
        F.floor("value").cast("long").alias("duration_ms"), error.alias("is_error"), error.alias("is_loading"), (k % 7 == 0).alias("truncated"), response.alias("response"),
    )
    rows = rows.withColumn("error_code", tx.error_code(F.col("response"), F.lit(None).cast("string"), F.lit(True), F.col("is_error"))).withColumn("completeness", tx.completeness(F.col("response"), F.col("truncated")))
    return conform(rows, "tool_call")


@query(f"with {_CALLS} select tool, count(*) as n from coded group by tool")
def log_calls_per_tool(spark, sf_dir):
    return logs.count_by(calls(spark, sf_dir), "tool")


@query(f"with {_CALLS} select error_code, count(*) as n from coded where error_code is not null group by error_code")
def log_error_codes(spark, sf_dir):
    return logs.count_by(calls(spark, sf_dir), "error_code")


@query(
    f"""with {_CALLS} select count(*) as calls, count(distinct upper(log_file)) as logs, count(*) filter (is_error) as errors, round(coalesce(count(*) filter (is_error) / nullif(count(*), 0), 0), 9) as error_rate,
  count(*) filter (truncated) as truncated, count(*) filter (completeness = 'complete') as n_complete, count(*) filter (completeness = 'truncated') as n_truncated, count(*) filter (completeness = 'unknown') as n_unknown from coded"""
)
def log_report_scalars(spark, sf_dir):
    return logs.report(calls(spark, sf_dir)).withColumn("error_rate", F.round("error_rate", 9))


@query(f"with {_CALLS} select tool, count(*) as calls, count(*) filter (is_error) as errors, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_ts from coded group by tool")
def log_health(spark, sf_dir):
    return logs.health(calls(spark, sf_dir)).withColumn("last_ts", F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss"))


@query(
    f"""with {_CALLS} select min(log_file) as log_file, count(*) as calls, count(*) filter (is_error) as errors, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_ts, cast(sum(duration_ms) as bigint) as duration_ms,
  min(pid) as pid, round(epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6, 3) as seconds, string_agg(tool, '>' order by ts nulls last, line_no) as tools from coded group by log_file"""
)
def log_sessions(spark, sf_dir):
    rows = logs.sessions(calls(spark, sf_dir))
    return rows.select("log_file", "calls", "errors", F.date_format("first_ts", "yyyy-MM-dd HH:mm:ss").alias("first_ts"), "duration_ms", "pid", F.round("seconds", 3).alias("seconds"), F.array_join("tools", ">").alias("tools"))


_BURSTS = f"""{_CALLS}, g as (select *, coalesce(is_loading and lag(is_loading) over w and tool = lag(tool) over w and epoch_us(ts) - epoch_us(lag(ts) over w) between 0 and {WINDOW}000000, false) as goes_on
    from coded window w as (partition by log_file order by ts nulls last, line_no)),
  i as (select *, sum(case when goes_on then 0 else 1 end) over (partition by log_file order by ts nulls last, line_no rows unbounded preceding) as island from g),
  b as (select log_file, min(tool) as tool, count(*) as calls from i group by log_file, island having count(*) >= 2)"""


@query(f"with {_BURSTS} select log_file, tool, calls from b")
def log_retry_bursts(spark, sf_dir):
    return logs.bursts(calls(spark, sf_dir), WINDOW).select("log_file", "tool", "calls")


@query(f"with {_BURSTS} select count(*) as bursts, cast(coalesce(sum(calls), 0) as bigint) as calls from b")
def log_burst_totals(spark, sf_dir):
    return logs.burst_totals(calls(spark, sf_dir), WINDOW)


@query("select conv_id, count(*) as turns, string_agg(role, '>' order by turn) as roles, cast(sum(length(text)) as bigint) as chars from conversations group by conv_id")
def conversation_sequences(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"), F.sum(F.length("text")).alias("chars"))
    return rows.select("conv_id", "turns", F.array_join(F.transform("x", lambda r: r["role"]), ">").alias("roles"), "chars")

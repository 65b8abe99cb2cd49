"""Run telemetry, usage and guards over events and conversations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlens.functions import text
from runlens.operators import cost, guards, registry, telemetry
from runlens.queries import query, table
from runlens.shared import shared_dir
from runlens.sources import adapters, readers
from runlens.streaming import budgets, growing

_CALLS = """
WITH calls AS (
  SELECT event_id, ts, strftime(ts, '%Y-%m-%d') AS run_id, CAST(user_id AS VARCHAR) AS task_id, event_type AS tool, event_type <> 'error' AS ok,
    CASE WHEN event_type = 'signup' AND value < 1 THEN 'too small' END AS deny_reason, CAST(floor(value * 100) AS BIGINT) AS res_chars, props AS args
  FROM events
)"""


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.tool_log(table(spark, sf_dir, "events"))


@query(_CALLS + """
SELECT run_id, task_id AS task, CASE WHEN GROUPING(task_id) = 1 THEN 'run' ELSE 'task' END AS level, count(*) AS calls,
  count(*) FILTER (WHERE tool = 'view') AS n_view, count(*) FILTER (WHERE tool = 'purchase') AS n_purchase,
  count(*) FILTER (WHERE NOT ok) AS failures, count(deny_reason) AS denials, count(DISTINCT task_id) AS tasks, CAST(sum(res_chars) AS BIGINT) AS res_chars,
  round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS duration_s
FROM calls GROUP BY GROUPING SETS ((run_id, task_id), (run_id))
""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = telemetry.run_summary(_calls(spark, sf_dir), ("view", "purchase"))
    return told.select("run_id", "task", "level", "calls", "n_view", "n_purchase", "failures", "denials", "tasks", "res_chars", "duration_s")


@query(_CALLS + "SELECT run_id, task_id, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS duration_s, min(ts) AS first_ts, max(ts) AS last_ts FROM calls GROUP BY run_id, task_id")
def task_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir).groupBy("run_id", "task_id").agg(F.round(telemetry.seconds(F.min("ts"), F.max("ts")), 3).alias("duration_s"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(_CALLS + "SELECT * FROM (SELECT run_id, event_id, task_id, tool, res_chars, row_number() OVER (PARTITION BY run_id ORDER BY res_chars DESC, ts, event_id) AS place FROM calls) WHERE place <= 10")
def heaviest_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.heaviest_calls(_calls(spark, sf_dir)).select("run_id", "event_id", "task_id", "tool", "res_chars", "place")


@query(_CALLS + "SELECT run_id, CASE WHEN CAST(task_id AS BIGINT) % 7 = 0 THEN '(session)' ELSE task_id END AS task, count(*) AS calls FROM calls GROUP BY 1, 2")
def null_bucket_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _calls(spark, sf_dir).withColumn("task_id", F.when(F.col("task_id").cast("long") % 7 != 0, F.col("task_id")))
    return telemetry.run_summary(calls, ()).where("level = 'task'").select("run_id", "task", "calls")


@query(_CALLS + "SELECT run_id, count(*) FILTER (WHERE 'srv__' || tool LIKE '%\\_\\_click' ESCAPE '\\') AS clicks, count(*) FILTER (WHERE 'srv__' || tool LIKE '%\\_\\_view' ESCAPE '\\') AS views FROM calls GROUP BY run_id")
def tool_family_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _calls(spark, sf_dir).withColumn("tool", F.concat(F.lit("srv__"), F.col("tool")))
    return calls.groupBy("run_id").agg(F.count_if(telemetry.family("click")).alias("clicks"), F.count_if(telemetry.family("view")).alias("views"))


@query("""
WITH rows AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '{broken' WHEN event_id % 10 = 1 THEN '' ELSE props END AS line FROM events)
SELECT event_id, CAST(json_extract(line, '$.k') AS BIGINT) AS k FROM rows WHERE event_id % 10 > 1
""")
def jsonl_tolerant_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(F.col("event_id") % 10 == 0, "{broken").when(F.col("event_id") % 10 == 1, "").otherwise(F.col("props"))
    rows = table(spark, sf_dir, "events").select("event_id", line.alias("line"))
    return readers.parse_jsonl(rows, "line", "k bigint").select("event_id", "_row.k")


@query("SELECT event_id, CAST(CASE event_id % 5 WHEN 0 THEN length(event_type) * 2 WHEN 1 THEN length(event_type) WHEN 2 THEN length(event_type) + 1 WHEN 3 THEN 0 ELSE length(props) END AS BIGINT) AS res_chars FROM events")
def result_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, t = table(spark, sf_dir, "events"), F.col("event_type")
    response = (
        F.when(F.col("event_id") % 5 == 0, F.to_json(F.struct(t.alias("stdout"), t.alias("stderr"))))
        .when(F.col("event_id") % 5 == 1, F.concat(F.lit('"'), t, F.lit('"')))
        .when(F.col("event_id") % 5 == 2, F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), t.alias("text")), F.struct(F.lit("text").alias("type"), F.lit("x").alias("text"))).alias("content"))))
        .when(F.col("event_id") % 5 == 3, "{}")
        .otherwise(F.col("props"))
    )
    return e.select("event_id", text.result_size(response).alias("res_chars"))


@query(r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\b(token|secret|password|api_?key)(\s*[:=]\s*)("?)[^\s"]+', '\1\2\3[redacted]', 'g'), '\b[0-9]{16}\b', '[number]', 'g'), '[A-Za-z0-9.]+@[A-Za-z0-9.]+', '[address]', 'g')) AS redacted
FROM documents
""")
def redact_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.redact(F.col("text")).cast("binary")).alias("redacted"))


_TURNS = """
WITH turns AS (
  SELECT CAST(conv_id AS VARCHAR) AS session, turn AS pos, role AS type, conv_id % 5 = 0 AS side,
    CASE conv_id % 3 WHEN 0 THEN 'haiku-' || turn % 2 WHEN 1 THEN 'sonnet-' || turn % 2 ELSE 'other-1' END AS model,
    coalesce(length(lag(text) OVER (PARTITION BY conv_id ORDER BY turn)), 0) AS i, length(text) AS o, 0 AS cr, turn AS cw
  FROM conversations
), used AS (
  SELECT session, count(*) AS turns, arg_max(model, pos) AS model, CAST(sum(i) AS BIGINT) AS input, CAST(sum(o) AS BIGINT) AS output, CAST(sum(cr) AS BIGINT) AS cache_read, CAST(sum(cw) AS BIGINT) AS cache_write
  FROM turns WHERE type = 'assistant' GROUP BY session
)"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.transcript(table(spark, sf_dir, "conversations"))


@query(_TURNS + "SELECT * FROM used")
def transcript_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost.usage(_turns(spark, sf_dir))


@query(_TURNS + "SELECT session, count(*) AS turns, CAST(sum(o) AS BIGINT) AS output FROM turns WHERE type = 'assistant' AND NOT side GROUP BY session")
def main_vs_sidechain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost.usage(cost.main_thread(_turns(spark, sf_dir))).select("session", "turns", "output")


@query(_TURNS + "SELECT session, model FROM used")
def last_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost.usage(_turns(spark, sf_dir)).select("session", "model")


@query(_TURNS + """
SELECT session, model, round((input * r_i + output * r_o + cache_read * r_cr + cache_write * r_cw) / 1e6, 8) AS cost_usd
FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY length(prefix) DESC) AS n FROM used
  JOIN (VALUES ('opus', 15.0, 75.0, 1.5, 18.75), ('sonnet', 3.0, 15.0, 0.3, 3.75), ('haiku', 1.0, 5.0, 0.1, 1.25), ('', 3.0, 15.0, 0.3, 3.75)) AS r(prefix, r_i, r_o, r_cr, r_cw) ON starts_with(model, prefix)) WHERE n = 1
""")
def cost_by_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost.cost(cost.usage(_turns(spark, sf_dir))).select("session", "model", F.round("cost_usd", 8).alias("cost_usd"))


@query(_TURNS + """
SELECT CASE WHEN starts_with(model, 'haiku') THEN 'haiku' WHEN starts_with(model, 'sonnet') THEN 'sonnet' ELSE '' END AS prefix, count(*) AS sessions,
  round(100.0 * sum(cache_read + cache_write) / sum(input + output + cache_read + cache_write), 4) AS cache_percent FROM used GROUP BY 1
""")
def cache_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = cost.prefix_join(cost.usage(_turns(spark, sf_dir)), cost.rates_table(spark))
    cached, every = F.sum(F.col("cache_read") + F.col("cache_write")), F.sum(F.col("input") + F.col("output") + F.col("cache_read") + F.col("cache_write"))
    return joined.groupBy("prefix").agg(F.count("*").alias("sessions"), F.round(F.lit(100.0) * cached / every, 4).alias("cache_percent"))


_BUDGET = """
, run AS (SELECT 'all' AS run_id, task_id, ts, event_id, {total} AS total FROM calls),
reached AS (SELECT *, CASE WHEN total >= {c} THEN {c} WHEN total >= {b} THEN {b} WHEN total >= {a} THEN {a} ELSE 0 END AS threshold FROM run),
told AS (SELECT *, coalesce(max(threshold) OVER (PARTITION BY task_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM reached)
SELECT run_id, task_id, ts, event_id, '{axis}' AS axis, CAST(threshold AS BIGINT) AS threshold, CAST(total AS BIGINT) AS total FROM told WHERE threshold > before
"""
_OVER = "OVER (PARTITION BY task_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query(_CALLS + _BUDGET.format(total=f"count(*) {_OVER}", a=40, b=60, c=80, axis="calls"))
def budget_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guards.budget_events(_calls(spark, sf_dir).withColumn("run_id", F.lit("all")), "calls", (40, 60, 80))


@query(_CALLS + _BUDGET.format(total=f"sum(res_chars) {_OVER}", a=100_000, b=200_000, c=300_000, axis="result_chars"))
def budget_result_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guards.budget_events(_calls(spark, sf_dir).withColumn("run_id", F.lit("all")), "result_chars", (100_000, 200_000, 300_000))


@query(_CALLS + """
, d AS (SELECT *, date_trunc('week', ts) AS dispatched_at, CASE WHEN tool = 'view' THEN row_number() OVER (PARTITION BY task_id, date_trunc('week', ts), tool = 'view' ORDER BY ts, event_id) END AS n FROM calls)
SELECT event_id, n AS call_number, coalesce(n <= 2, true) AS allowed FROM d
""")
def retrieve_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _calls(spark, sf_dir).withColumns({"run_id": F.lit("all"), "dispatched_at": F.date_trunc("week", "ts")})
    return guards.rate_limit(calls, "view").select("event_id", F.col("call_number").cast("long").alias("call_number"), "allowed")


@query(_CALLS + """
, e AS (SELECT event_id, ts, run_id, CAST(floor(extract('hour' FROM ts) / 6) AS BIGINT) AS task, tool AS file FROM calls),
c AS (SELECT *, CASE WHEN lag(task) OVER w IS DISTINCT FROM task THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY run_id ORDER BY ts, event_id)),
i AS (SELECT *, CAST(sum(new) OVER (PARTITION BY run_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS episode FROM c),
a AS (SELECT *, row_number() OVER (PARTITION BY run_id, episode, file ORDER BY ts, event_id) AS attempt FROM i)
SELECT event_id, episode, attempt, attempt = 9 AS denied FROM a
""")
def repeat_edit_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = _calls(spark, sf_dir).withColumns({"task_id": F.floor(F.hour("ts") / 6).cast("long"), "file": F.col("tool"), "tool": F.lit("Edit")})
    return guards.repeat_guard(edits).select("event_id", "episode", F.col("attempt").cast("long").alias("attempt"), "denied")


@query(_CALLS + """
, k AS (SELECT event_id, ts, run_id, CASE WHEN event_id % 3 = 0 THEN task_id END AS task_id FROM calls)
SELECT l.event_id, r.task_id FROM k l ASOF LEFT JOIN (SELECT * FROM k WHERE task_id IS NOT NULL) r ON l.run_id = r.run_id AND l.ts >= r.ts
""")
def last_known_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _calls(spark, sf_dir).withColumn("task_id", F.when(F.col("event_id") % 3 == 0, F.col("task_id")))
    return telemetry.last_known(calls).select("event_id", "task_id")


@query(_TURNS + "SELECT session, count(*) AS turns, CAST(sum(o) AS BIGINT) AS output FROM turns WHERE type = 'assistant' AND (CAST(session AS BIGINT) % 2 = 1 OR pos > CAST(session AS BIGINT) % 4) GROUP BY session")
def incremental_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir)
    cursors = turns.select("session").distinct().where(F.col("session").cast("long") % 2 == 0).withColumn("billed", F.col("session").cast("long") % 4)
    return cost.usage(cost.unbilled(turns, cursors)).select("session", "turns", "output")


@query(_CALLS + "SELECT run_id, max(ts) AS last_ts FROM calls GROUP BY run_id HAVING (epoch_us(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(max(ts))) / 1e6 <= 3600 ORDER BY last_ts DESC, run_id LIMIT 1")
def stale_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    return telemetry.latest_run(_calls(spark, sf_dir), now)


_RESULTS = "WITH r AS (SELECT user_id AS case_id, ts, event_id, CASE WHEN event_type = 'error' THEN 'fail' ELSE 'pass' END AS result FROM events) "


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), "ts", "event_id", F.when(F.col("event_type") == "error", "fail").otherwise("pass").alias("result"))


@query(_RESULTS + """, g AS (SELECT case_id, arg_max(result, ts) AS last_result, count(*) FILTER (WHERE result = 'pass') AS passes, count(*) AS runs FROM r GROUP BY case_id)
SELECT *, CASE WHEN last_result = 'pass' THEN 'ok' WHEN passes > 0 THEN 'regression' ELSE 'gap' END AS verdict FROM g""")
def case_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.regressions(_results(spark, sf_dir))


@query(_RESULTS + """, n AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ts DESC, event_id DESC) AS n FROM r)
SELECT case_id, max(result) FILTER (WHERE n = 1) AS last_run, coalesce(string_agg(result, ',' ORDER BY n) FILTER (WHERE n BETWEEN 2 AND 11), '') AS history FROM n GROUP BY case_id""")
def case_history_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.capped_history(_results(spark, sf_dir)).withColumn("history", F.array_join("history", ","))


@query("SELECT max(CAST(regexp_extract(c_name, '^Customer#(\\d+)$', 1) AS BIGINT)) AS largest, 'Customer-' || lpad(CAST(max(CAST(regexp_extract(c_name, '^Customer#(\\d+)$', 1) AS BIGINT)) + 1 AS VARCHAR), 9, '0') AS next_id FROM customer")
def next_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.next_id(table(spark, sf_dir, "customer"), "c_name", "Customer", 9)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.duplicates(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query(_CALLS + "SELECT event_id, ts, run_id, 'hook-' || tool AS hook, 'broke at ' || event_id AS error FROM calls WHERE tool = 'error'")
def hook_error_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _calls(spark, sf_dir)
    broken = calls.where("tool = 'error'").select("event_id", "run_id", "ts", F.lit("hook_error").alias("event"), F.concat(F.lit("hook-"), "tool").alias("hook"), F.concat(F.lit("broke at "), "event_id").alias("error"))
    found = telemetry.one_report(calls, broken).where("event = 'hook_error'").select("event_id", "run_id", "ts", "event", "hook", "error")
    return telemetry.hook_errors(found).select("event_id", "ts", "run_id", "hook", "error")


@query(_CALLS + "SELECT event_id, coalesce(CASE WHEN event_id % 6 <> 0 THEN run_id END, '_no-run') AS run_id FROM calls")
def ambient_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _calls(spark, sf_dir).withColumn("run_id", F.when(F.col("event_id") % 6 != 0, F.col("run_id")))
    return readers.ambient(calls, log_ambient=True).select("event_id", "run_id")


@query("""
WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS session, turn AS pos, conv_id % 4 = 1 AND turn % 2 = 1 AS subagent, conv_id % 5 = 0 AS side FROM conversations),
h AS (SELECT DISTINCT session FROM t WHERE subagent)
SELECT session, pos FROM t WHERE CASE WHEN session IN (SELECT session FROM h) THEN subagent ELSE side END
""")
def sidechain_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir).withColumn("subagent", (F.col("session").cast("long") % 4 == 1) & (F.col("pos") % 2 == 1))
    return readers.agent_turns(turns).select("session", "pos")


@query("""
WITH f AS (SELECT o_custkey % 100 AS session, o_orderkey AS path, o_orderdate AS mtime, o_orderstatus = 'F' AS subagent FROM orders)
SELECT session, (array_agg(path ORDER BY mtime DESC, path DESC) FILTER (WHERE subagent))[1] AS path FROM f GROUP BY session
""")
def newest_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("session"), F.col("o_orderkey").alias("path"), F.col("o_orderdate").alias("mtime"), (F.col("o_orderstatus") == "F").alias("subagent"))
    return readers.newest_transcript(files)


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern may be a file or a folder
    return adapters.tool_log(rows).withColumn("run_id", F.lit("all"))


@query(_CALLS + ", " + ", ".join(f"{axis} AS (SELECT * FROM ({_BUDGET.format(total=total, a=a, b=b, c=c, axis=axis).strip().replace(', run AS', 'WITH run AS', 1)}))" for axis, total, a, b, c in (("calls_axis", f"count(*) {_OVER}", 40, 60, 80), ("result_axis", f"sum(res_chars) {_OVER}", 100_000, 200_000, 300_000))).replace("'calls_axis'", "'calls'").replace("'result_axis'", "'result_chars'") + " SELECT * FROM calls_axis UNION ALL SELECT * FROM result_axis")
def stream_budget_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = budgets.consume(budgets.budget_stream(_stream(spark, sf_dir), (40, 60, 80), (100_000, 200_000, 300_000)), f"budgets-{uuid.uuid4().hex}")
    return told


@query(_CALLS + ", n AS (SELECT event_id, row_number() OVER (PARTITION BY task_id, date_trunc('week', ts) ORDER BY ts, event_id) AS call_number FROM calls WHERE tool = 'view') SELECT event_id, call_number, call_number <= 2 AS allowed FROM n")
def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _stream(spark, sf_dir).withColumn("dispatched_at", F.date_trunc("week", "ts"))
    return budgets.consume(budgets.rate_limit_stream(calls, "view"), f"limits-{uuid.uuid4().hex}")


@query("""
WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, length(coalesce(text, '')) AS c FROM conversations WHERE conv_id IS NOT NULL),
a AS (SELECT t.conv_id, n, t.turn, c FROM t JOIN conversations d ON d.conv_id = t.conv_id AND d.turn = t.turn WHERE role = 'assistant' AND t.conv_id % 5 > 0)
SELECT 'c' || conv_id || '.jsonl' AS file, CASE WHEN n <= 3 THEN 1 ELSE 2 END AS batch, count(*) AS turns, 'm' || max(turn) AS model, CAST(sum(c) AS BIGINT) AS output FROM a GROUP BY ALL""")
def growing_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a transcript that has three lines and half of the fourth when it is read first, and all of its lines the second time: every turn is billed once."""
    turns = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL")
    line = growing.transcript_line(F.concat(F.lit("m"), "turn"), F.lit(0), F.length(F.coalesce("text", F.lit(""))), F.col("conv_id") % 5 == 0, F.col("role"))
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = turns.select(F.concat(F.lit("c"), "conv_id", F.lit(".jsonl")).alias("name"), F.col("turn").alias("pos"), number.alias("n"), F.concat(line, F.lit("\n")).alias("line"))
    path = f"{shared_dir(spark)}/transcripts-{uuid.uuid4().hex}"
    for lines in (rows.where("n <= 4").withColumn("line", F.when(F.col("n") == 4, F.substring("line", 1, 9)).otherwise(F.col("line"))), rows):
        growing.write_whole(lines, f"{path}/in")
        budgets.isolated(growing.growing_lines(spark, f"{path}/in"), growing.usage_events, f"{path}/out", f"{path}/errors")
    told = spark.read.parquet(f"{path}/out")
    return told.select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), (F.col("batch") + 1).cast("int").alias("batch"), "turns", "model", "output")

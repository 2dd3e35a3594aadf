"""Queries through the rollout reader: events become the rollouts and the typed history of a session per user and are read back.

A session lies in two files that overlap, each begins with the session's record and holds its other rows in no order but that
rows of the same time stand in the order of events. Small files are packed into large ones. Rows are contexts, usage records (some repeated, some invalid), tool calls and messages; the history repeats messages a few seconds
off, and knows sessions without a rollout.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.sources import jsonl as J
from loglens.sources import readers
from loglens.sources.config import config
from loglens.sources.shared import written
from loglens.views import CUT, DAYS, NOW, START

_ISO = "date_format(timestamp_seconds({}), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
_EVENTS = f"SELECT event_id AS e, user_id AS u, {START} + (event_id * 2593) % {DAYS * 86400} AS ts FROM {{events}}"
#: Lines of records (file, u, e), a session's own one with e = -1. A row that many records share: its fields are NULL, hence
#: left out, where its kind has none.
_ROLLOUT = f"""
SELECT concat_ws('\t', file, CASE WHEN e = -1 THEN concat('{{{{"type":"session_meta","timestamp":"2024-01-01T00:00:00Z","payload":{{{{"id":"', u,
  '","originator":"codex-tui","cwd":"/gone/first"', CASE WHEN u % 2 = 0 THEN ',"source":"vscode"' ELSE '' END, '}}}}}}}}') ELSE to_json(named_struct('timestamp', {_ISO.format("ts")},
  'type', CASE e % 6 WHEN 0 THEN 'turn_context' WHEN 1 THEN 'token_usage_record' ELSE 'response_item' END,
  'payload', named_struct(
    'type', CASE WHEN e % 6 = 2 THEN 'function_call' WHEN e % 6 > 2 THEN 'message' END, 'role', CASE WHEN e % 6 > 2 THEN 'user' END,
    'cwd', CASE WHEN e % 6 = 0 AND e % 5 > 0 THEN concat('/gone/p', e % 3) END, 'model', CASE WHEN e % 6 = 0 AND e % 4 > 0 THEN concat('g', e % 5) END,
    'effort', CASE WHEN e % 6 = 0 AND e % 9 > 0 THEN 'high' END,
    'name', CASE WHEN e % 6 = 2 THEN concat('tool', e % 4) END, 'call_id', CASE WHEN e % 6 = 2 THEN concat('c', (e div 6) % 40) END,
    'response_id', CASE WHEN e % 6 = 1 THEN concat('r', (e div 6) % 40) END,
    'usage', CASE WHEN e % 6 = 1 THEN named_struct('input_tokens', 100 + e % 97, 'cached_input_tokens', e % 120, 'output_tokens', CASE WHEN e % 11 = 0 THEN -1 ELSE e % 13 END, 'reasoning_output_tokens', e % 4) END,
    'content', CASE WHEN e % 6 > 2 THEN array(named_struct('type', 'input_text', 'text', concat(CASE WHEN e % 6 = 5 THEN '<injected> ' ELSE 'ask ' END, e))) END))) END) AS value
FROM (SELECT file, u, e, {START} + (e * 2593) % {DAYS * 86400} AS ts FROM {{records}}) AS x
"""
_HISTORY = f"""
SELECT CASE WHEN e % 500 = 3 THEN to_json(named_struct('session_id', concat('x', u), 'ts', ts, 'text', concat('alone ', e)))
  WHEN e % 77 = 3 THEN '{{{{"session_id":5}}}}' ELSE to_json(named_struct('session_id', CAST(u AS STRING), 'ts', ts + e % 9 - 2, 'text', concat('ask ', e, ' '))) END AS value
FROM ({_EVENTS}) AS x WHERE e % 6 = 3 AND (e % 5 > 0 OR e % 500 = 3)
"""


_CODEX = config(None, NOW, (NOW - CUT) // 86400, "codex")


def rollouts(spark: SparkSession, d: str) -> readers.Parts:
    """The reader's parts over events, written as rollouts and history."""
    events = spark.read.parquet(f"{d}/events.parquet")
    # records are dealt and sorted by their keys; the lines are made where they are written
    keys = events.select(F.col("user_id").alias("u"), F.col("event_id").alias("e"), (F.col("event_id") % (DAYS * 86400) % 7).alias("left_out"))
    keys = keys.unionByName(events.select(F.col("user_id").alias("u"), F.lit(-1).cast("long").alias("e"), F.lit(-1).cast("long").alias("left_out")).distinct())
    copies = keys.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).where(F.col("left_out") != F.col("copy"))
    copies = copies.select(F.concat_ws("-", "u", "copy").alias("file"), "u", "e").repartition("file")
    files = spark.sql(_ROLLOUT, records=copies.sortWithinPartitions("file", F.col("e") >= 0, F.xxhash64(F.col("e") % (DAYS * 86400)), "e"))
    history = spark.sql(_HISTORY, events=events)
    parts = readers.Parts(spark)
    readers.codex(parts, _CODEX, J.scan(spark, written(files, "rollouts"), packed=True, parse=False), J.scan(spark, written(history, "history")))
    return parts


def read_rollout_usage(spark: SparkSession, d: str) -> DataFrame:
    counts = [f"CAST({c} AS BIGINT) AS {c}" for c in ("fresh_input", "cache_read", "output", "reasoning")]
    return rollouts(spark, d).take("usage", readers.USAGE).selectExpr("session", "ts", "cwd", "model", "effort", "measurement", *counts)


def read_rollout_prompts(spark: SparkSession, d: str) -> DataFrame:
    return rollouts(spark, d).take("prompts", readers.PROMPT).select("session", "ts", "text", "cwd", "surface", "is_automation")


def read_rollout_tools(spark: SparkSession, d: str) -> DataFrame:
    return rollouts(spark, d).take("tools", readers.TOOL).select("session", "ts", "name")


def read_rollout_issues(spark: SparkSession, d: str) -> DataFrame:
    return rollouts(spark, d).take("issues", readers.ISSUE).groupBy("code").agg(F.count("*").alias("n"))


def read_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """What the rollout reader says about itself, with an agent beside it that has no source."""
    parts, both = rollouts(spark, d), config(None, NOW, (NOW - CUT) // 86400, "codex,chatgpt")
    found = readers.diagnosed(parts, both, readers.distinct_prompts(parts, both), parts.take("usage", readers.USAGE))
    issues = F.aggregate(F.map_values("issues"), F.lit(0).cast("long"), lambda acc, n: acc + n)
    return found.select("agent", "malformed_records", "usable_prompts", "usage_rows", F.size("issues").cast("long").alias("codes"), issues.alias("issues"), "status")


_E = f"""WITH x AS (SELECT event_id AS e, user_id AS u, {START} + (event_id * 2593) % {DAYS * 86400} AS ts FROM events),
t AS (SELECT *, coalesce(last_value(CASE WHEN e % 6 = 0 AND e % 5 > 0 THEN '/gone/p' || e % 3 END IGNORE NULLS) OVER w, '/gone/first') AS cwd,
  last_value(CASE WHEN e % 6 = 0 THEN {{'model': CASE WHEN e % 4 > 0 THEN 'g' || e % 5 END, 'effort': CASE WHEN e % 9 > 0 THEN 'high' END}} END IGNORE NULLS) OVER w AS c
  FROM x WINDOW w AS (PARTITION BY u ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
i AS (SELECT * FROM t WHERE ts BETWEEN {CUT} AND {NOW}),
records AS (SELECT *, e % 11 <> 0 AND 100 + e % 97 >= e % 120 AS ok FROM i WHERE e % 6 = 1 QUALIFY row_number() OVER (PARTITION BY u, (e // 6) % 40 ORDER BY ts) = 1),
h AS (SELECT e, CASE WHEN e % 500 = 3 THEN 'x' || u ELSE CAST(u AS VARCHAR) END AS session, u, CASE WHEN e % 500 = 3 THEN ts ELSE ts + e % 9 - 2 END AS ts, CASE WHEN e % 500 = 3 THEN 'alone ' ELSE 'ask ' END || e AS text
  FROM x WHERE e % 6 = 3 AND (e % 500 = 3 OR (e % 5 > 0 AND e % 77 <> 3))),
hi AS (SELECT * FROM h WHERE ts BETWEEN {CUT} AND {NOW}),
c AS (SELECT * FROM i WHERE e % 6 IN (3, 4)),
m AS (SELECT hi.e, hi.session, hi.ts, hi.text, c.cwd FROM hi JOIN c ON c.e = hi.e AND hi.text NOT LIKE 'alone%' AND abs(c.ts - hi.ts) <= 5),
v AS (SELECT u, ts, cwd FROM t WHERE e % 6 = 0),
rest AS (SELECT hi.e, hi.session, hi.ts, hi.text, CASE WHEN hi.session LIKE 'x%' THEN NULL ELSE coalesce(v.cwd, '/gone/first') END AS cwd
  FROM (SELECT * FROM hi WHERE e NOT IN (SELECT e FROM m)) AS hi ASOF LEFT JOIN v ON hi.u = v.u AND hi.ts >= v.ts)"""
_MALFORMED = "(SELECT count(*) FROM x WHERE e % 6 = 3 AND (e % 5 > 0 OR e % 500 = 3) AND e % 500 <> 3 AND e % 77 = 3)"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "read_rollout_usage": read_rollout_usage, "read_rollout_prompts": read_rollout_prompts, "read_rollout_tools": read_rollout_tools, "read_rollout_issues": read_rollout_issues, "read_diagnostics": read_diagnostics,
}
ORACLES = {
    "read_rollout_usage": f"""{_E} SELECT CAST(u AS VARCHAR) AS session, CAST(ts AS DOUBLE) AS ts, cwd, c.model AS model, c.effort AS effort, 'response' AS measurement,
  100 + e % 97 - e % 120 AS fresh_input, e % 120 AS cache_read, e % 13 AS output, e % 4 AS reasoning FROM records WHERE ok""",
    "read_rollout_prompts": f"""{_E}, y AS (SELECT session, ts, text, cwd FROM m UNION ALL SELECT session, ts, text, cwd FROM rest UNION ALL SELECT CAST(u AS VARCHAR), ts, 'ask ' || e, cwd FROM c WHERE e NOT IN (SELECT e FROM m))
  SELECT session, CAST(ts AS DOUBLE) AS ts, text, cwd, CASE WHEN session NOT LIKE 'x%' THEN CASE WHEN CAST(session AS BIGINT) % 2 = 0 THEN 'vscode' ELSE 'cli' END END AS surface, false AS is_automation FROM y""",
    "read_rollout_tools": f"{_E} SELECT CAST(u AS VARCHAR) AS session, CAST(ts AS DOUBLE) AS ts, 'tool' || e % 4 AS name FROM i WHERE e % 6 = 2 QUALIFY row_number() OVER (PARTITION BY u, (e // 6) % 40 ORDER BY ts) = 1",
    "read_rollout_issues": f"""{_E}, used AS (SELECT DISTINCT CAST(u AS VARCHAR) AS session FROM records WHERE ok), q AS (
  SELECT 'malformed' AS code, {_MALFORMED} AS n UNION ALL SELECT 'invalid_usage', (SELECT count(*) FROM records WHERE NOT ok)
  UNION ALL SELECT 'history_without_rollout', (SELECT count(DISTINCT session) FROM hi WHERE session LIKE 'x%')
  UNION ALL SELECT 'usage_unavailable', (SELECT count(*) FROM (SELECT session FROM hi UNION SELECT CAST(u AS VARCHAR) FROM c) WHERE session NOT IN (SELECT session FROM used)))
  SELECT code, n FROM q WHERE n > 0""",
}
ORACLES["read_diagnostics"] = f"""WITH i AS ({ORACLES['read_rollout_issues']}), p AS ({ORACLES['read_rollout_prompts']}), u AS ({ORACLES['read_rollout_usage']})
SELECT 'codex' AS agent, CAST(coalesce((SELECT sum(n) FROM i WHERE code = 'malformed'), 0) AS BIGINT) AS malformed_records, (SELECT count(*) FROM p) AS usable_prompts, (SELECT count(*) FROM u) AS usage_rows,
  (SELECT count(*) FROM i WHERE code <> 'malformed') AS codes, CAST(coalesce((SELECT sum(n) FROM i WHERE code <> 'malformed'), 0) AS BIGINT) AS issues, 'partial' AS status UNION ALL SELECT 'chatgpt', 0, 0, 0, 0, 0, 'absent'"""

"""Queries that go through the reader of coding-agent transcripts: the driver's tables are written as its raw lines and read
back, so tolerant parsing, the window, tag stripping, usage normal forms and first-wins deduplication are held against SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loglens.sources import jsonl as J
from loglens.sources import readers
from loglens.sources.config import config
from loglens.sources.shared import written
from loglens.views import CUT, DAYS, NOW, START

_ISO = "date_format(timestamp_seconds({}), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"

#: Every message stands twice (event_id and the next one), as transcripts repeat records; every 50th line is cut off.
_REPLIES = f"""
SELECT event_id, event_id div 2 AS m, (event_id div 2) % 40 AS session, {START} + ((event_id div 2) * 2593) % {DAYS * 86400} AS ts FROM {{events}}
"""
_USAGE_LINES = f"""
SELECT CASE WHEN event_id % 50 = 7 THEN '{{{{"type":' ELSE to_json(named_struct('type', 'assistant', 'sessionId', CAST(session AS STRING), 'timestamp', {_ISO.format("ts")},
  'cwd', concat('/gone/p', session % 3), 'message', named_struct('id', concat('m', m), 'model', concat('model-', m % 5),
    'content', array(named_struct('type', 'tool_use', 'id', concat('t', m), 'name', CASE m % 3 WHEN 0 THEN 'Edit' WHEN 1 THEN 'Bash' ELSE 'Skill' END, 'input', named_struct('file_path', concat('/a/f', m % 7), 'skill', concat('s', m % 4)))),
    'usage', named_struct('input_tokens', m % 97, 'output_tokens', CASE WHEN m % 11 = 0 THEN -1 ELSE m % 13 END, 'cache_read_input_tokens', m % 311, 'cache_creation_input_tokens', m % 5)))) END AS value
FROM ({_REPLIES}) AS r
"""

#: What a person typed, some of it behind an injected tag, as parts, from a side chain, or as an automated message.
_PROMPT_LINES = f"""
SELECT concat('{{{{"type":"user","sessionId":"', conv_id, '","timestamp":"', {_ISO.format("ts")}, '","isSidechain":', turn % 6 = 2 AND conv_id % 5 = 0, ',"message":',
  CASE turn % 6 WHEN 0 THEN to_json(named_struct('content', concat('<system-reminder>', text, '</system-reminder> ', text)))
    WHEN 2 THEN to_json(named_struct('content', array(named_struct('type', 'text', 'text', text), named_struct('type', 'image', 'text', 'x'), named_struct('type', 'text', 'text', 'end'))))
    ELSE to_json(named_struct('content', concat('Caveat: ', text))) END, '}}}}') AS value
FROM (SELECT conv_id, turn, text, {START} + (conv_id * 97777) % {DAYS * 86400} + turn * 60 AS ts FROM {{conversations}} WHERE role = 'user') AS c
"""


_CLAUDE = config(None, NOW, (NOW - CUT) // 86400, "claude-code")


def _read(spark: SparkSession, lines: DataFrame) -> readers.Parts:
    parts = readers.Parts(spark)
    readers.claude_code(parts, _CLAUDE, J.scan(spark, written(lines, "transcripts")))
    return parts


def _replies(spark: SparkSession, d: str) -> readers.Parts:
    return _read(spark, spark.sql(_USAGE_LINES, events=spark.read.parquet(f"{d}/events.parquet")))


def read_usage(spark: SparkSession, d: str) -> DataFrame:
    used = _replies(spark, d).take("usage", readers.USAGE)
    counts = [f"CAST({c} AS BIGINT) AS {c}" for c in ("fresh_input", "cache_read", "cache_write", "output")]
    return used.selectExpr("session", "ts", "model", "cwd", *counts)


def read_tools(spark: SparkSession, d: str) -> DataFrame:
    return _replies(spark, d).take("tools", readers.TOOL).select("session", "ts", "name", "file_path", "skill")


def read_issues(spark: SparkSession, d: str) -> DataFrame:
    return _replies(spark, d).take("issues", readers.ISSUE).groupBy("code").count().withColumnRenamed("count", "n")


def read_prompts(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.sql(_PROMPT_LINES, conversations=spark.read.parquet(f"{d}/conversations.parquet"))
    return _read(spark, lines).take("prompts", readers.PROMPT).select("session", "ts", "text", "is_automation")


_M = f"""WITH r AS (SELECT event_id // 2 AS m, (event_id // 2) % 40 AS session, {START} + ((event_id // 2) * 2593) % {DAYS * 86400} AS ts, event_id FROM events),
  w AS (SELECT DISTINCT m, session, ts FROM r WHERE event_id % 50 <> 7 AND ts BETWEEN {CUT} AND {NOW})"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "read_usage": read_usage, "read_tools": read_tools, "read_issues": read_issues, "read_prompts": read_prompts,
}
ORACLES = {
    "read_usage": f"""{_M} SELECT CAST(session AS VARCHAR) AS session, CAST(ts AS DOUBLE) AS ts, 'model-' || m % 5 AS model, '/gone/p' || session % 3 AS cwd,
  m % 97 AS fresh_input, m % 311 AS cache_read, m % 5 AS cache_write, m % 13 AS output FROM w WHERE m % 11 <> 0""",
    "read_tools": f"""{_M} SELECT CAST(session AS VARCHAR) AS session, CAST(ts AS DOUBLE) AS ts, CASE m % 3 WHEN 0 THEN 'Edit' WHEN 1 THEN 'Bash' ELSE 'Skill' END AS name,
  '/a/f' || m % 7 AS file_path, CASE WHEN m % 3 = 2 THEN 's' || m % 4 END AS skill FROM w""",
    "read_issues": f"""{_M} SELECT 'malformed' AS code, count(*) AS n FROM r WHERE event_id % 50 = 7 UNION ALL SELECT 'invalid_usage', count(*) FROM w WHERE m % 11 = 0""",
    "read_prompts": f"""WITH c AS (SELECT conv_id, turn, text, {START} + (conv_id * 97777) % {DAYS * 86400} + turn * 60 AS ts FROM conversations WHERE role = 'user')
  SELECT CAST(conv_id AS VARCHAR) AS session, CAST(ts AS DOUBLE) AS ts, CASE turn % 6 WHEN 0 THEN text WHEN 2 THEN text || chr(10) || 'end' ELSE 'Caveat: ' || text END AS text,
    turn % 6 NOT IN (0, 2) AS is_automation FROM c WHERE ts BETWEEN {CUT} AND {NOW} AND NOT (turn % 6 = 2 AND conv_id % 5 = 0)""",
}

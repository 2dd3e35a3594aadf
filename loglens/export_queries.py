"""Queries through the export readers: conversations become chat exports, JSON arrays of a few hundred chats each, which the
data source splits, and whose trees the reader walks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.sources import exports, readers
from loglens.sources.config import config
from loglens.sources.shared import written
from loglens.views import CUT, DAYS, NOW, START

#: Conversations in an export, so that one fits a row however many there are.
PER_FILE = 500
_TS = f"{START} + (conv_id * 97777) % {DAYS * 86400} + turn * 60"

#: Chats as trees. Turn 2 hangs on turn 0, beside turn 1. A third name their current node; some of the others have a cycle, a
#: parent that is missing, or no links at all; every fifth turn is hidden; a part that is no string is left out.
_TREES = f"""
SELECT conv_id, concat('{{{{"id":"', conv_id, '","current_node":', CASE WHEN conv_id % 3 = 0 THEN concat('"n', lpad(last, 6, '0'), '"') ELSE 'null' END, ',"mapping":{{{{',
  array_join(transform(array_sort(nodes), n -> n.json), ','), '}}}}}}}}') AS json
FROM (SELECT conv_id, last, collect_list(struct(turn, concat('"n', lpad(turn, 6, '0'), '":', to_json(named_struct(
    'parent', CASE WHEN conv_id % 17 = 4 THEN NULL WHEN conv_id % 11 = 5 AND turn = 0 THEN concat('n', lpad(last, 6, '0')) WHEN conv_id % 13 = 7 AND turn = 1 THEN 'gone' WHEN turn = 0 THEN NULL WHEN turn = 2 THEN 'n000000' ELSE concat('n', lpad(turn - 1, 6, '0')) END,
    'children', CASE WHEN conv_id % 17 <> 4 THEN array() END,
    'message', named_struct('author', named_struct('role', role), 'create_time', {_TS}, 'content', named_struct('parts', array(text)),
      'metadata', named_struct('model_slug', concat('m', turn % 3), 'is_visually_hidden_from_conversation', turn % 5 = 4))))) AS json)) AS nodes
  FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM {{conversations}}) AS c GROUP BY conv_id, last) AS x
"""
#: Chats as lists of messages; some have no id, some a message without a time.
_LISTS = f"""
SELECT conv_id, concat('{{{{', CASE WHEN conv_id % 4 > 0 THEN concat('"uuid":"', conv_id, '",') ELSE '' END, '"name":"', conv_id, '","chat_messages":[', array_join(transform(array_sort(said), m -> m.json), ','), ']}}}}') AS json
FROM (SELECT conv_id, collect_list(struct(turn, to_json(named_struct('sender', CASE WHEN role = 'user' THEN 'human' ELSE role END, 'text', text,
    'created_at', CASE WHEN turn % 7 <> 3 THEN date_format(timestamp_seconds({_TS}), "yyyy-MM-dd'T'HH:mm:ss'Z'") END)) AS json)) AS said
  FROM {{conversations}} GROUP BY conv_id) AS x
"""


def _chats(spark: SparkSession, d: str, sql: str, agent: str) -> readers.Parts:
    """The reader's parts over all conversations, written as exports by sql and read back through the data source."""
    rows = spark.read.parquet(f"{d}/conversations.parquet")
    n = rows.select("conv_id").distinct().count()
    files = spark.sql(sql, conversations=rows).groupBy(F.pmod(F.xxhash64("conv_id"), F.lit(-(-max(1, n) // PER_FILE))).alias("file"))
    files = files.agg(F.concat(F.lit("["), F.array_join(F.collect_list("json"), ","), F.lit("]")).alias("value"))
    paths = [r.path for r in exports.candidates(spark, [written(files, agent, "file")], "*.txt").collect()]
    own = exports.inspected(spark, paths).where(F.col("agent") == agent).select("path", "size").collect()
    lines = readers.settled(exports.conversations(spark, [(r.path, r.size) for r in own], 1 << 20))
    parts = readers.Parts(spark)
    reader = readers.chatgpt if agent == "chatgpt" else readers.claude_ai
    reader(parts, config(None, NOW, (NOW - CUT) // 86400, agent), lines.select("k", "line", F.expr("try_parse_json(line)").alias("j")))
    return parts


def _prompts(parts: readers.Parts) -> DataFrame:
    return parts.take("prompts", readers.PROMPT).select("session", "ts", "text")


def _usage(parts: readers.Parts) -> DataFrame:
    counts = [f"CAST({c} AS BIGINT) AS {c}" for c in ("fresh_input", "output")]
    return parts.take("usage", readers.USAGE).selectExpr("session", "ts", "model", "measurement", "estimated", *counts)


def _issues(parts: readers.Parts) -> DataFrame:
    return parts.take("issues", readers.ISSUE).groupBy("code").agg(F.count("*").alias("n"))


def _query(sql: str, agent: str, of: Callable) -> Callable:
    return lambda spark, d: of(_chats(spark, d, sql, agent))


# The same chats walked by SQL, the leaves of each up to the first whose way has a cycle or a gap.
_WALK = f"""WITH RECURSIVE c AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last, {_TS} AS ts FROM conversations),
n AS (SELECT *, CASE WHEN conv_id % 17 = 4 THEN NULL WHEN conv_id % 11 = 5 AND turn = 0 THEN last WHEN conv_id % 13 = 7 AND turn = 1 THEN -1 WHEN turn = 0 THEN NULL WHEN turn = 2 THEN 0 ELSE turn - 1 END AS parent,
  conv_id % 3 = 0 AS known, conv_id % 17 = 4 AND conv_id % 3 <> 0 AS flat FROM c),
leaf AS (SELECT conv_id, turn FROM n WHERE known AND turn = last UNION ALL SELECT conv_id, turn FROM n AS a WHERE NOT known AND NOT flat AND NOT EXISTS (SELECT 1 FROM n AS b WHERE b.conv_id = a.conv_id AND b.parent = a.turn)),
w AS (SELECT conv_id, turn AS leaf, turn, 0 AS depth FROM leaf UNION ALL SELECT w.conv_id, w.leaf, n.parent, depth + 1 FROM w JOIN n ON n.conv_id = w.conv_id AND n.turn = w.turn WHERE n.parent IS NOT NULL AND depth <= n.last + 1),
bad AS (SELECT w.conv_id, min(leaf) AS leaf FROM w JOIN (SELECT DISTINCT conv_id, last FROM n) AS x ON x.conv_id = w.conv_id WHERE turn = -1 OR depth > last GROUP BY w.conv_id),
torn AS (SELECT conv_id FROM bad UNION SELECT conv_id FROM n WHERE NOT known AND NOT flat AND conv_id NOT IN (SELECT conv_id FROM leaf)),
own AS (SELECT w.conv_id, turn, min(w.leaf) AS leaf FROM w LEFT JOIN bad ON bad.conv_id = w.conv_id WHERE bad.leaf IS NULL OR w.leaf < bad.leaf GROUP BY ALL),
leaves AS (SELECT conv_id, count(*) AS leaves FROM leaf GROUP BY conv_id),
s AS (SELECT n.*, CASE WHEN leaves = 1 THEN CAST(n.conv_id AS VARCHAR) ELSE n.conv_id || '/branch/n' || lpad(CAST(leaf AS VARCHAR), 6, '0') END AS session FROM n JOIN own USING (conv_id, turn) JOIN leaves USING (conv_id)
  UNION ALL SELECT n.*, CAST(conv_id AS VARCHAR) FROM n WHERE flat),
m AS (SELECT session, CAST(ts AS DOUBLE) AS ts, trim(text) AS text, role, 'm' || turn % 3 AS model FROM s WHERE turn % 5 <> 4 AND role IN ('user', 'assistant') AND ts BETWEEN {CUT} AND {NOW} AND trim(text) <> '')"""
_LIST = f"""WITH c AS (SELECT conv_id, turn, role, text, {_TS} AS ts FROM conversations WHERE turn % 7 <> 3),
m AS (SELECT conv_id, CAST(ts AS DOUBLE) AS ts, text, CASE role WHEN 'user' THEN role ELSE 'assistant' END AS role, CAST(NULL AS VARCHAR) AS model FROM c WHERE ts BETWEEN {CUT} AND {NOW} AND text <> '')"""
_USED = """SELECT session, ts, model, 'characters_divided_by_four' AS measurement, true AS estimated, CASE role WHEN 'user' THEN length(text) // 4 ELSE 0 END AS fresh_input, CASE role WHEN 'assistant' THEN length(text) // 4 ELSE 0 END AS output FROM m"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "read_chat_tree": _query(_TREES, "chatgpt", _prompts), "read_chat_usage": _query(_TREES, "chatgpt", _usage), "read_chat_issues": _query(_TREES, "chatgpt", _issues),
    # chats without an id are told apart by a digest of theirs, so their sessions are counted
    "read_chat_lists": lambda s, d: _prompts(_chats(s, d, _LISTS, "claude-ai")).select(F.when(~F.startswith("session", F.lit("export_")), F.col("session")).alias("session"), "ts", "text"),
    "read_list_sessions": lambda s, d: _prompts(_chats(s, d, _LISTS, "claude-ai")).agg(F.count_distinct("session").alias("sessions"), F.count_distinct(F.when(F.startswith("session", F.lit("export_")), F.col("session"))).alias("unnamed")),
}
ORACLES = {
    "read_chat_tree": f"{_WALK} SELECT session, ts, text FROM m WHERE role = 'user'",
    "read_chat_usage": f"{_WALK} {_USED}",
    "read_chat_issues": f"""{_WALK}, q AS (SELECT 'malformed' AS code, (SELECT count(*) FROM torn) AS n UNION ALL
  SELECT 'active_branch_unknown', (SELECT count(DISTINCT conv_id) FROM n WHERE NOT known AND conv_id IN (SELECT conv_id FROM leaf))) SELECT code, n FROM q WHERE n > 0""",
    "read_chat_lists": f"{_LIST} SELECT CASE WHEN conv_id % 4 > 0 THEN CAST(conv_id AS VARCHAR) END AS session, ts, trim(text) AS text FROM m WHERE role = 'user'",
    "read_list_sessions": f"{_LIST} SELECT count(DISTINCT conv_id) AS sessions, count(DISTINCT conv_id) FILTER (conv_id % 4 = 0) AS unnamed FROM m WHERE role = 'user'",
}

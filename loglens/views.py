"""Normalized log tables over the driver's tables, as SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

START, DAYS = 1704067200, 30
NOW, CUT = START + 20 * 86400, START + 13 * 86400

# (text, whether the conversation's own words follow); every reaction and feature occurs, the bare ones repeat
PHRASES = [
    ("Perfect, thanks!", True), ("OK, go ahead", True), ("No, still broken", True), ("Please continue", False),
    ("Run the regression suite for the parser please", False), ("That is not what I asked, because the issue is in app.py", True),
    ("make sure it works until tests pass", True), ("only change this, for example like this", True), ("plan it before we build", True),
    ("one at a time, in parallel", True), ("1. build it then 2. test", True), ("STOP THE PRESSES NOW, undo it", True), ("again, no", True),
    ("remember the rules in /src/app/main.py", True), ("is it running?", False), ("Thanks, but this is still failing", True),
    ("let's build that", True), ("Explore the next feature of the dashboard", False), ("are you there", False), ("okay then we go on", True),
    ("please please explain, token=abc123secret and mail me at a.b@mail.example.com", True), ("yes", False), ("what would it take", True), ("so good", True),
]


def _case() -> str:
    def own(k: int, text: str, more: bool) -> str:
        quoted = text.replace("'", "''")
        return f"WHEN {k} THEN '{quoted}'" + (" || ' ' || {clean}" if more else "")

    return f"CASE (conv_id * 7 + turn * 3) % {len(PHRASES)} " + " ".join(own(k, *p) for k, p in enumerate(PHRASES)) + " END"


_AGENT = "CASE {x} % 4 WHEN 0 THEN 'claude-code' WHEN 1 THEN 'codex' WHEN 2 THEN 'chatgpt' ELSE 'claude-ai' END"

PROMPTS = f"""
SELECT concat('p_', substr({{sha}}(concat(agent, {{nul}}, session, {{nul}}, CAST(CAST(ts AS BIGINT) AS STRING), '.0', {{nul}}, text){{sha_end}}), 1, 20)) AS id, * FROM (
  SELECT CAST({START} + (conv_id * 97777) % {DAYS * 86400} + turn * 60 AS DOUBLE) AS ts, {_AGENT.format(x="conv_id")} AS agent, CAST(conv_id AS STRING) AS session,
    concat('proj', CAST(conv_id % 7 AS STRING)) AS project, CASE conv_id % 3 WHEN 0 THEN 'cli' WHEN 1 THEN 'desktop' END AS surface,
    {_case()} AS text, (conv_id * 5 + turn) % 17 = 0 AS is_automation
  FROM conversations WHERE role = 'user') AS x
"""

USAGE = f"""
SELECT event_id AS ord, CAST({START} + (event_id * 2593) % {DAYS * 86400} AS DOUBLE) AS ts, {_AGENT.format(x="user_id")} AS agent, CAST(user_id AS STRING) AS session,
  concat('proj', CAST(user_id % 9 AS STRING)) AS project, CASE event_id % 6 WHEN 0 THEN '<synthetic>' WHEN 1 THEN CAST(NULL AS STRING) ELSE concat('model-', event_type) END AS model,
  event_id % 5 = 0 AS side, CASE event_id % 7 WHEN 0 THEN 'main' WHEN 1 THEN 'HEAD' WHEN 2 THEN '' WHEN 3 THEN CAST(NULL AS STRING) ELSE concat('feat-', CAST(user_id % 11 AS STRING)) END AS branch,
  user_id % 4 >= 2 AS estimated, event_id % 97 AS fresh_input, event_id % 311 AS cache_read, event_id % 13 AS cache_write, CAST(floor(value) AS BIGINT) AS output, event_id % 4 AS reasoning
FROM events
"""

TOOLS = f"""
SELECT event_id AS ord, CAST({START} + (event_id * 2593) % {DAYS * 86400} AS DOUBLE) AS ts, {_AGENT.format(x="user_id")} AS agent, CAST(user_id AS STRING) AS session,
  CASE event_id % 6 WHEN 0 THEN 'Edit' WHEN 1 THEN 'Write' WHEN 2 THEN 'Bash' WHEN 3 THEN concat('mcp__srv', CAST(user_id % 12 AS STRING), '__op') WHEN 4 THEN 'Skill' ELSE concat('tool_', event_type) END AS name,
  CASE WHEN event_id % 6 <= 1 THEN concat('/src/dir', CAST(user_id % 3 AS STRING), '/file', CAST(user_id % 10 AS STRING), '.py') END AS file_path,
  CASE WHEN event_id % 6 = 4 THEN concat('skill-', CAST(user_id % 9 AS STRING)) END AS skill, CAST(event_id % 4000 AS STRING) AS call_id
FROM events
"""

# cumulative counters per session, falling back to a new start every 50th row
COUNTERS = f"""
SELECT session, ts, ord, TRUE AS valid, sum(step) OVER w AS input_tokens, CAST(0 AS BIGINT) AS cached_input_tokens, sum(back) OVER w AS output_tokens, CAST(0 AS BIGINT) AS reasoning_output_tokens,
  ord % 3 <> 0 AS has_last, step AS last_input_tokens, CAST(0 AS BIGINT) AS last_cached_input_tokens, back AS last_output_tokens, CAST(0 AS BIGINT) AS last_reasoning_output_tokens
FROM (SELECT CAST(user_id AS STRING) AS session, CAST({START} + event_id * 259 AS DOUBLE) AS ts, event_id AS ord, CAST(floor(value) AS BIGINT) AS step, event_id % 7 AS back,
    sum(CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS era FROM events) AS x
WINDOW w AS (PARTITION BY session, era ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""

# a chat as a tree: turn 2 hangs on turn 0 as well as turn 1 does, which leaves two branches
NODES = "SELECT conv_id, turn AS node, CASE WHEN turn = 0 THEN CAST(NULL AS BIGINT) WHEN turn = 2 THEN CAST(0 AS BIGINT) ELSE turn - 1 END AS parent, turn AS ord FROM conversations"

VIEWS = {"prompts": PROMPTS, "usage": USAGE, "tools": TOOLS, "counters": COUNTERS, "nodes": NODES}
_SOURCE = {"prompts": "conversations", "usage": "events", "tools": "events", "counters": "events", "nodes": "conversations"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source = _SOURCE[name]
    sql = VIEWS[name]
    if name == "prompts":
        sql = sql.format(sha="sha2", sha_end=", 256", nul="chr(0)", clean="regexp_replace(text, '[^A-Za-z .,]', 'x')")
    return spark.sql(sql.replace(f"FROM {source}", "FROM {source}"), source=spark.read.parquet(f"{sf_dir}/{source}.parquet"))


def duckdb_ctes(*names: str) -> str:
    """The views as common table expressions for DuckDB, p being the prompts that a person typed."""
    out = []
    for name in names:
        sql = VIEWS[name]
        if name == "prompts":
            sql = sql.format(sha="sha256", sha_end="", nul="chr(0)", clean="regexp_replace(text, '[^A-Za-z .,]', 'x', 'g')")
        out.append(f"{name} AS ({sql})")
        if name == "prompts":
            out.append("p AS (SELECT * FROM prompts WHERE NOT is_automation AND text <> '')")
    return "WITH " + ",\n".join(out)

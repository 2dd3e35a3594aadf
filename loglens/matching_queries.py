"""Queries of operators whose rows compete or depend on one another: greedy matching, folders and counters, with SQL that goes
through the rows one by one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.operators import sequence
from loglens.sources import folders
from loglens.views import CUT, NOW, START

#: Typed and sent messages of a user and kind within half a minute of each other, many at the same second.
_COMPETING = f"""
SELECT CAST(user_id AS STRING) AS session, event_type AS key, event_id AS id, CAST({START} + (event_id * 7919) % 31 AS DOUBLE) AS ts, event_id % 2 = 0 AS typed FROM {{events}}
"""


def history_compete(spark: SparkSession, d: str) -> DataFrame:
    """Greedy matching where rows compete: most have several partners within five seconds, and many want the same one."""
    rows = spark.sql(_COMPETING, events=spark.read.parquet(f"{d}/events.parquet"))
    typed, sent = (rows.where(c).select("session", "key", "id", "ts") for c in ("typed", "NOT typed"))
    return sequence.greedy_matches(typed, sent, ["session", "key"], 5.0)


HOME = "/home/me"
#: Working folders of all events, some of them spelled with a scheme, dots or a closing slash.
_FOLDERS = """
SELECT event_id, CASE event_id % 12 WHEN 0 THEN '' WHEN 1 THEN '/home/me/' WHEN 2 THEN concat('/tmp/job', user_id) WHEN 3 THEN concat('/home/me/Documents/Codex/c', user_id)
  WHEN 4 THEN concat('file:///home/me/code/r', user_id % 25, '/src/') WHEN 5 THEN concat('/home/me/code/r', user_id % 25, '//wt', event_id % 5, '/./pkg/deep', event_id % 3)
  WHEN 6 THEN concat('/home/me/code/r', user_id % 25, '/wt', event_id % 5) WHEN 7 THEN concat('/gone/shop', user_id % 4, '/web') WHEN 8 THEN concat('/home/me/notes/n', user_id % 10, '/a')
  WHEN 9 THEN 'rel/part' WHEN 10 THEN '/home/me/notes' ELSE concat('/home/me/code/r', user_id % 25, 'x/wt1') END AS folder
FROM {events}
"""
#: Directories: repositories of most nations, a work tree for each supplier, and plain ones.
_KNOWN = """
SELECT DISTINCT path, repository FROM (
  SELECT concat('/home/me/code/r', n_nationkey) AS path, CASE WHEN n_nationkey % 3 > 0 THEN n_name END AS repository FROM {nation}
  UNION ALL SELECT concat('/home/me/code/r', s_nationkey, '/wt', s_suppkey % 5), concat('main', s_nationkey) FROM {supplier} WHERE s_suppkey % 4 > 0
  UNION ALL SELECT inline(array(struct('/', CAST(NULL AS STRING)), struct('/home', CAST(NULL AS STRING)), struct('/home/me', CAST(NULL AS STRING)), struct('/home/me/code', CAST(NULL AS STRING)), struct('/home/me/notes', CAST(NULL AS STRING))))) AS x
"""


def project_folders(spark: SparkSession, d: str) -> DataFrame:
    """Events per project and workspace, by the longest prefix of their folder that is a directory or a work tree."""
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    rows = spark.sql(_FOLDERS, events=read("events"))
    known = spark.sql(_KNOWN, nation=read("nation"), supplier=read("supplier"))
    counts = rows.groupBy("folder").agg(F.count("*").alias("n"))
    found = folders.places(counts.select("folder"), HOME, known)
    return found.join(counts, "folder").groupBy("project", "workspace").agg(F.sum("n").alias("n"))


# cumulative counters with everything that may happen to them: invalid ones, resets, no baseline, one that is only partly known
_STATES = f"""
SELECT CAST(user_id AS STRING) AS session, CAST({START} + 10 * 86400 + (event_id * 2593) % (10 * 86400) AS DOUBLE) AS ts, event_id AS ord, (event_id // user_step) % 9 <> 4 AS valid,
  CAST(CASE WHEN event_id % 37 = 0 THEN 5 ELSE event_id END AS BIGINT) AS input_tokens, CAST(event_id // 3 AS BIGINT) AS output_tokens, event_id % 3 <> 0 AS has_last,
  CAST(CASE WHEN event_id % 2 = 0 THEN event_id ELSE event_id % 50 END AS BIGINT) AS last_input_tokens, CAST(event_id // 3 AS BIGINT) AS last_output_tokens
FROM (SELECT *, 1 + user_id % 7 AS user_step FROM {{events}}) AS x
"""
_COUNTED = ["input_tokens", "output_tokens"]


def counter_states(spark: SparkSession, d: str) -> DataFrame:
    """Per counter in the window its issue and delta; invalid ones are told, change no baseline and give no delta."""
    rows = spark.sql(_STATES.replace("//", "DIV"), events=spark.read.parquet(f"{d}/events.parquet"))
    deltas = sequence.counter_deltas(rows, CUT, NOW, _COUNTED).select("session", "ord", "issue", *[F.col(f"d_{c}").cast("long").alias(f"d_{c}") for c in _COUNTED])
    none = F.lit(None).cast("long")
    invalid = rows.where(~F.col("valid")).select("session", "ord", F.lit("invalid_token_counter").alias("issue"), *[none.alias(f"d_{c}") for c in _COUNTED])
    return deltas.unionByName(invalid)


_PICK = "list_sort(list_transform(list_filter(c.cands, lambda x: abs(x.ts - l.ts) <= 5 AND NOT list_contains(w.used, x.id)), lambda x: {'far': abs(x.ts - l.ts), 'ts': x.ts, 'id': x.id}))[1].id"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"history_compete": history_compete, "project_folders": project_folders, "counter_states": counter_states}
ORACLES = {
    "history_compete": f"""WITH RECURSIVE x AS ({_COMPETING.replace('{events}', 'events')}),
l AS (SELECT session, key, id, ts, row_number() OVER (PARTITION BY session, key ORDER BY ts, id) AS n FROM x WHERE typed),
c AS (SELECT session, key, list({{'ts': ts, 'id': id}}) AS cands FROM x WHERE NOT typed GROUP BY ALL),
w AS (SELECT DISTINCT session, key, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS left_id, CAST(NULL AS BIGINT) AS right_id FROM l UNION ALL
  SELECT session, key, n, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, id, pick
  FROM (SELECT w.session, w.key, l.n, w.used, l.id, {_PICK} AS pick FROM w JOIN l ON l.session = w.session AND l.key = w.key AND l.n = w.n + 1 JOIN c ON c.session = w.session AND c.key = w.key))
SELECT session, key, left_id, right_id FROM w WHERE right_id IS NOT NULL""",
    "project_folders": f"""WITH f AS ({_FOLDERS.replace('{events}', 'events')}),
k AS ({_KNOWN.replace('{nation}', 'nation').replace('{supplier}', 'supplier').replace("SELECT inline(array(", "SELECT unnest([").replace("struct('/', CAST(NULL AS STRING)), struct('/home', CAST(NULL AS STRING)), struct('/home/me', CAST(NULL AS STRING)), struct('/home/me/code', CAST(NULL AS STRING)), struct('/home/me/notes', CAST(NULL AS STRING))))", "'/', '/home', '/home/me', '/home/me/code', '/home/me/notes']), CAST(NULL AS VARCHAR)")}),
p AS (SELECT folder, count(*) AS n, rtrim(replace(replace(regexp_replace(folder, '^file://', ''), '/./', '/'), '//', '/'), '/') AS path FROM f GROUP BY folder),
t AS (SELECT p.path, max(len(string_split(CASE k.path WHEN '/' THEN '' ELSE k.path END, '/'))) AS there, arg_max(k.path, length(k.path)) FILTER (repository IS NOT NULL) AS top,
    arg_max(repository, length(k.path)) FILTER (repository IS NOT NULL) AS repository
  FROM (SELECT DISTINCT path FROM p) AS p JOIN k ON k.path = '/' AND starts_with(p.path, '/') OR p.path = k.path OR starts_with(p.path, k.path || '/') GROUP BY p.path),
y AS (SELECT n, p.path, string_split(p.path, '/') AS parts, coalesce(there, 0) AS there, top, repository,
    CASE WHEN p.path = '' THEN 'unknown' WHEN p.path = '{HOME}' OR starts_with(p.path, '{HOME}/Documents/Codex') THEN 'No-folder sessions' WHEN starts_with(p.path, '/tmp/') THEN 'Background automations' END AS fixed
  FROM p LEFT JOIN t ON t.path = p.path),
z AS (SELECT *, parts[least(there + 1, len(parts))] AS name FROM y)
SELECT coalesce(fixed, repository, name) AS project, CASE WHEN fixed IS NULL THEN coalesce(string_split(top, '/')[-1], name) END AS workspace, CAST(sum(n) AS BIGINT) AS n FROM z GROUP BY ALL""",
    "counter_states": f"""WITH RECURSIVE x AS ({_STATES.format(events='events')}),
v AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, ord) AS n FROM x WHERE valid),
w AS (SELECT session, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS pi, CAST(NULL AS BIGINT) AS po, CAST(NULL AS BIGINT) AS ord, CAST(NULL AS DOUBLE) AS ts, CAST(NULL AS VARCHAR) AS issue, CAST(NULL AS BIGINT) AS di, CAST(NULL AS BIGINT) AS dd FROM v WHERE n = 1
  UNION ALL SELECT v.session, v.n, v.input_tokens, v.output_tokens, v.ord, v.ts,
    CASE WHEN w.pi IS NULL THEN CASE WHEN NOT has_last THEN 'missing_counter_baseline' WHEN input_tokens <> last_input_tokens OR output_tokens <> last_output_tokens THEN 'partial_counter_baseline' END
      WHEN input_tokens < w.pi OR output_tokens < w.po THEN 'token_counter_reset' END,
    CASE WHEN w.pi IS NULL THEN CASE WHEN has_last THEN last_input_tokens END WHEN input_tokens >= w.pi AND output_tokens >= w.po THEN input_tokens - w.pi END,
    CASE WHEN w.pi IS NULL THEN CASE WHEN has_last THEN last_output_tokens END WHEN input_tokens >= w.pi AND output_tokens >= w.po THEN output_tokens - w.po END
  FROM w JOIN v ON v.session = w.session AND v.n = w.n + 1)
SELECT session, ord, issue, di AS d_input_tokens, dd AS d_output_tokens FROM w WHERE ts BETWEEN {CUT} AND {NOW} UNION ALL SELECT session, ord, 'invalid_token_counter', NULL, NULL FROM x WHERE NOT valid""",
}

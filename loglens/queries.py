"""Queries over the driver's tables, one per operator or report figure, and the SQL that DuckDB must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens import export_queries, matching_queries, reader_queries, redaction_queries, rollout_queries
from loglens.functions import redact, text
from loglens.operators import sequence
from loglens.plans import coaching, stats
from loglens.views import CUT, NOW, duckdb_ctes, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _q(s: str) -> str:
    return s.replace("'", "''")


def _rx(column: str, pattern: str, flags: str = "i") -> str:
    return f"regexp_matches({column}, '(?{flags}){_q(pattern)}')" if flags else f"regexp_matches({column}, '{_q(pattern)}')"


def _wc(column: str) -> str:
    return rf"len(list_filter(string_split_regex({column}, '\s+'), lambda z: z <> ''))"


def add(name: str, run: Query, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def on(*names: str):
    """A query from a function of the named views."""
    return lambda f: lambda spark, d: f(*[view(spark, d, n) for n in names])


_P, _U, _T, _PU = duckdb_ctes("prompts"), duckdb_ctes("usage"), duckdb_ctes("tools"), duckdb_ctes("prompts", "usage")
_TOK = "(fresh_input + cache_read + cache_write + output)"
_TS = "make_timestamp(CAST(ts * 1000000 AS BIGINT))"
_HOUR = f"strftime({_TS}, '%Y-%m-%d') || '|' || hour({_TS})"
_SUM = "CAST(coalesce(sum({}), 0) AS BIGINT)".format

# prompts
add("prompts_normalized", on("prompts")(lambda p: p.select("id", "ts", "agent", "session", "project", "surface", "text", "is_automation")), f"{_P} SELECT id, ts, agent, session, project, surface, text, is_automation FROM prompts")
add("prompt_ids", on("prompts")(lambda p: p.select("session", "ts", text.prompt_id(F.col("agent"), F.col("session"), F.col("ts"), F.col("text")).alias("id"))), f"{_P} SELECT session, ts, id FROM prompts")
add("window_filter", on("prompts")(lambda p: stats.human(p).where(F.col("ts").between(CUT, NOW)).select("id", "ts")), f"{_P} SELECT id, ts FROM p WHERE ts BETWEEN {CUT} AND {NOW}")
add("automation_split", on("prompts")(lambda p: p.groupBy("agent", "is_automation").agg(F.count("*").alias("n"))), f"{_P} SELECT agent, is_automation, count(*) AS n FROM prompts GROUP BY ALL")
add("agent_surfaces", on("prompts")(stats.surfaces), f"{_P} SELECT agent, coalesce(surface, 'null') AS surface, count(*) AS n FROM p GROUP BY ALL")

# tokens
add("tokens_by_type", on("usage")(stats.token_types), f"{_U} SELECT {_SUM(_TOK)} AS total, {', '.join(f'{_SUM(k)} AS {k}' for k in stats.KINDS)} FROM usage")
add("cache_share", on("usage")(stats.cache_share), f"{_U} SELECT {_SUM('cache_read')} AS cache_read, {_SUM('cache_read + fresh_input + cache_write')} AS input, round_even(sum(cache_read) / greatest(1, sum(cache_read + fresh_input + cache_write)), 4) AS share FROM usage")
add("tokens_by_agent", on("prompts", "usage")(stats.agents), f"""{_PU}, u AS (SELECT agent, sum({_TOK}) AS tokens, sum(output) AS output, bool_or(estimated) AS estimated FROM usage GROUP BY agent),
  q AS (SELECT agent, count(*) AS prompts, count(DISTINCT session) AS sessions FROM p GROUP BY agent)
  SELECT agent, CAST(coalesce(tokens, 0) AS BIGINT) AS tokens, CAST(coalesce(output, 0) AS BIGINT) AS output, coalesce(estimated, false) AS estimated, CAST(coalesce(prompts, 0) AS BIGINT) AS prompts, CAST(coalesce(sessions, 0) AS BIGINT) AS sessions FROM u FULL JOIN q USING (agent)""")
add("tokens_by_model", on("usage")(stats.models), f"{_U} SELECT model, {_SUM(_TOK)} AS tokens, {_SUM('output')} AS output FROM usage WHERE model NOT IN ('', '<synthetic>') GROUP BY model")
add("projects_top10", on("prompts", "usage")(stats.projects), f"""{_PU}, u AS (SELECT project, sum({_TOK}) AS tokens, min(ord) AS first FROM usage GROUP BY project),
  q AS (SELECT project, count(*) AS prompts, count(DISTINCT (agent, session)) AS sessions FROM p GROUP BY project)
  SELECT project, CAST(coalesce(tokens, 0) AS BIGINT) AS tokens, CAST(coalesce(prompts, 0) AS BIGINT) AS prompts, CAST(coalesce(sessions, 0) AS BIGINT) AS sessions FROM u FULL JOIN q USING (project) ORDER BY u.tokens DESC NULLS LAST, first NULLS LAST, project LIMIT 10""")
add("prompt_totals", on("prompts")(stats.prompt_totals), f"{_P} SELECT count(*) AS prompts, count(DISTINCT (agent, session)) AS sessions_driven FROM p")
add("projects_by_agent", on("prompts", "usage")(lambda p, u: stats.projects_by_agent(p, u).select("project", F.explode("by_agent").alias("agent", "tokens"))), f"""{_U}, top AS (SELECT project FROM usage GROUP BY project ORDER BY sum({_TOK}) DESC, min(ord) LIMIT 10)
  SELECT project, agent, {_SUM(_TOK)} AS tokens FROM usage WHERE project IN (SELECT project FROM top) GROUP BY ALL""")
add("project_agents", on("usage")(stats.project_agents), f"{_U} SELECT project, agent, {_SUM(_TOK)} AS tokens FROM usage GROUP BY ALL")
add("side_share", on("usage")(stats.side_share), f"{_U} SELECT {_SUM(f'CASE WHEN side THEN {_TOK} END')} AS side, {_SUM(_TOK)} AS total, round_even(coalesce(sum(CASE WHEN side THEN {_TOK} END), 0) / greatest(1, sum({_TOK})), 4) AS share FROM usage")

# sessions and the clock
_ROLLED = "SELECT agent, session, arg_min(project, (ts, id)) AS project, min(ts) AS first, max(ts) AS last, count(*) FILTER (NOT is_automation) AS prompts FROM prompts GROUP BY agent, session"
add("sessions_rollup", on("prompts")(stats.sessions), f"{_P} {_ROLLED}")
add("longest_sessions", on("prompts")(lambda p: stats.longest_sessions(stats.sessions(p))), f"{_P} SELECT (last - first) / 3600 AS hours, project, agent, prompts FROM ({_ROLLED}) ORDER BY hours DESC, project DESC, agent DESC, prompts DESC LIMIT 3")
add("output_grid", on("usage")(lambda u: stats.output_grid(u).drop("first")), f"{_U} SELECT {_HOUR} AS hour, {_SUM('output')} AS output FROM usage GROUP BY 1")
add("prompt_grid", on("prompts")(stats.prompt_grid), f"{_P} SELECT {_HOUR} AS hour, agent, count(*) AS n FROM p GROUP BY ALL")
add("busiest_hour", on("prompts", "usage")(stats.busiest_hour), f"""{_PU}, g AS (SELECT {_HOUR} AS hour, sum(output) AS output, min(ord) AS first FROM usage GROUP BY 1), t AS (SELECT * FROM g ORDER BY output DESC, first LIMIT 1)
  SELECT t.hour, CAST(t.output AS BIGINT) AS output, (SELECT count(*) FROM p WHERE {_HOUR} = t.hour) AS prompts FROM t""")
add("weekend_prompts", on("prompts")(stats.weekend), f"{_P} SELECT count(*) AS weekend_prompts FROM p WHERE isodow({_TS}) >= 6")
add("latest_prompt", on("prompts")(stats.latest_prompt), f"{_P} SELECT id, ts FROM p ORDER BY (hour({_TS}) + 19) % 24 DESC, ts, id LIMIT 1")
add("prompts_per_day", on("prompts")(stats.per_day), f"{_P} SELECT strftime({_TS}, '%a %Y-%m-%d') AS day, count(*) AS n FROM p GROUP BY 1")

# words
add("words_leverage", on("prompts", "usage")(stats.words), f"""{_PU}, w AS (SELECT sum({_wc('text')}) AS n FROM p), u AS (SELECT sum(output) AS o FROM usage)
  SELECT CAST(n AS BIGINT) AS words_typed, CAST(round_even(o * 0.75, 0) AS BIGINT) AS words_back, CAST(round_even(o * 0.75 / greatest(1, n), 0) AS BIGINT) AS leverage FROM w, u""")
add("voice", on("prompts")(stats.voice), f"""{_P} SELECT agent, count(*) AS n, count(*) FILTER (contains(text, '?')) AS questions, median({_wc('text')}) AS median_words, count(*) FILTER ({_rx('text', text.PLEASE)}) AS please,
  count(*) FILTER ({_rx('lower(text)', text.OK_OPEN, '')}) AS ok_open, count(*) FILTER ({_rx('text', text.CAPS_RUN, '')}) AS caps_sentences FROM p GROUP BY agent""")
add("manners", on("prompts")(stats.manners), f"{_P} SELECT count(*) FILTER ({_rx('text', text.THANKS)}) AS thanks, {_SUM(f'len(regexp_extract_all(text, {chr(39)}(?i){text.PLEASE}{chr(39)}))')} AS please_total FROM p")
_KEY = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"
_SCRUBBED = r"replace(replace(text, 'a.b@mail.example.com', '[email]'), 'token=abc123secret', 'token=[redacted]')"
add("repeats", on("prompts")(stats.repeats), f"""{_P} SELECT substr({_SCRUBBED.replace('text', 'original')}, 1, 200) AS text, times, agents FROM (
  SELECT {_KEY} AS k, count(*) AS times, min((ts, id)) AS first, arg_min(text, (ts, id)) AS original, string_agg(DISTINCT agent, ',' ORDER BY agent) AS agents FROM p WHERE length(text) >= 20 GROUP BY 1 ORDER BY times DESC, first LIMIT 5) WHERE times >= 2""")
add("first_words", on("prompts")(stats.first_words), f"""{_P} SELECT word, count(*) AS n FROM (SELECT ts, id, regexp_replace(lower(string_split_regex(trim(text), '\\s+')[1]), '[^a-z'']', '', 'g') AS word FROM p) WHERE word <> '' GROUP BY word ORDER BY n DESC, min((ts, id)) LIMIT 10""")

# order
add("handoffs", on("prompts")(lambda p: sequence.handoffs(stats.human(p))), f"{_P} SELECT count(*) AS handoffs FROM (SELECT agent, lag(agent) OVER (ORDER BY ts, id) AS b FROM p) WHERE agent <> b")
add("longest_streak", on("prompts")(lambda p: sequence.longest_streak(stats.human(p))), f"""{_P}, x AS (SELECT *, row_number() OVER (ORDER BY ts, id) AS i, row_number() OVER (PARTITION BY agent ORDER BY ts, id) AS j FROM p)
  SELECT prompts, agent FROM (SELECT agent, i - j AS g, count(*) AS prompts, min(i) AS s FROM x GROUP BY 1, 2) ORDER BY prompts DESC, s LIMIT 1""")

# rankings
_RANK = lambda key, where, k, src="tools": f"SELECT name, n FROM (SELECT {key} AS name, count(*) AS n, min(ord) AS f FROM {src} WHERE {where} GROUP BY 1 ORDER BY n DESC, f LIMIT {k})"
add("top_tools", on("tools")(stats.top_tools), f"{_T} {_RANK('name', 'true', 12)}")
add("mcp_servers", on("tools")(stats.mcp_servers), f"{_T} {_RANK('split_part(name, ' + chr(39) + '__' + chr(39) + ', 2)', 'name LIKE ' + chr(39) + 'mcp!_!_%!_!_%' + chr(39) + ' ESCAPE ' + chr(39) + '!' + chr(39), 8)}")
add("skills", on("tools")(stats.skills), f"{_T} {_RANK('skill', 'skill IS NOT NULL', 8)}")
add("edited_files", on("tools")(stats.edited_files), f"{_T} {_RANK('split_part(file_path, ' + chr(39) + '/' + chr(39) + ', -1)', 'file_path IS NOT NULL', 5)}")
add("branches", on("usage")(stats.branches), f"{_U} {_RANK('branch', 'branch NOT IN (' + chr(39) * 2 + ', ' + chr(39) + 'HEAD' + chr(39) + ', ' + chr(39) + 'main' + chr(39) + ', ' + chr(39) + 'master' + chr(39) + ')', 8, 'usage')}")

# reactions
_REACTION = f"""CASE WHEN trim(text) = '' THEN 'unknown' WHEN {_rx('text', text.INFRA)} AND {_wc('text')} <= 14 THEN 'infra'
  WHEN {_rx('substr(text, 1, 160)', text.CORRECT)} OR {_rx('text', text.CAPS_RUN, '')} THEN 'correct' WHEN {_rx('substr(text, 1, 120)', text.PRAISE)} THEN 'praise' WHEN {_rx('substr(text, 1, 80)', text.PROCEED)} THEN 'proceed' ELSE 'new-ask' END"""
_ROWS = rf"""{_P}, c AS (SELECT *, trim(regexp_replace(lower(text), '\W+', ' ', 'g')) AS norm, {_REACTION} AS reaction, {_wc('text')} AS words FROM p),
n AS (SELECT *, lead(id) OVER w AS next_id, CASE WHEN lead(id) OVER w IS NULL THEN 'end' WHEN lead(norm) OVER w = norm THEN 'retry' ELSE lead(reaction) OVER w END AS nr, row_number() OVER w AS i FROM c WINDOW w AS (PARTITION BY agent, session ORDER BY ts, id)),
r AS (SELECT a.* EXCLUDE (nr), CASE WHEN nr IN ('end', 'new-ask', 'infra') AND length(text) >= 20 AND EXISTS (SELECT 1 FROM n b WHERE b.norm = a.norm AND length(b.text) >= 20 AND (b.agent, b.session) <> (a.agent, a.session) AND (b.ts, b.id) > (a.ts, a.id) AND b.ts - a.ts < 86400) THEN 'retry' ELSE nr END AS next_reaction FROM n a),
j AS (SELECT *, next_reaction IN ('praise', 'proceed') AS good FROM r WHERE next_reaction IN ('praise', 'proceed', 'correct'))"""
_FEATURES = ", ".join(f"CASE WHEN {('length(text) > 400 AND ' if n == 'pastes_evidence' else '') + _rx('text', p, 'i' + f)} THEN '{n}' END" for n, p, f in text.FEATURE_PATTERNS) + ", CASE WHEN words <= 5 THEN 'terse' END, CASE WHEN words >= 120 THEN 'long_brief' END"
_HAS = ", ".join(f"('{n}')" for n in text.FEATURES)
_TAGGED = f"{_ROWS}, t AS (SELECT *, list_filter([{_FEATURES}], lambda z: z IS NOT NULL) AS features FROM r), f(feature) AS (VALUES {_HAS}), x AS (SELECT feature, list_contains(features, feature) AS has, t.*, next_reaction IN ('praise', 'proceed', 'correct') AS jd, next_reaction IN ('praise', 'proceed') AS g FROM t, f)"
_RATE = "CASE WHEN {1} > 0 THEN round_even({0} / {1}, 3) END".format

add("reaction_classes", on("prompts")(lambda p: coaching.classified(p).select("id", "reaction", "norm", "words")), f"{_ROWS} SELECT id, reaction, norm, CAST(words AS BIGINT) AS words FROM c")
add("next_reaction", on("prompts")(lambda p: sequence.with_next(coaching.classified(p)).select("id", "next_id", "next_reaction")), f"{_ROWS} SELECT id, next_id, nr AS next_reaction FROM n")
add("cross_session_retry", on("prompts")(lambda p: coaching.reactions(p).select("id", "next_reaction")), f"{_ROWS} SELECT id, next_reaction FROM r")
add("reaction_counts", on("prompts")(lambda p: coaching.reaction_counts(coaching.reactions(p))), f"{_ROWS} SELECT next_reaction, count(*) AS n FROM r GROUP BY 1")
add("smooth_rate", on("prompts")(lambda p: coaching.smooth_rate(coaching.reactions(p), "agent")), f"{_ROWS} SELECT agent, count(*) AS n, count(*) FILTER (good) AS good, round_even(count(*) FILTER (good) / count(*), 3) AS smooth_rate FROM j GROUP BY agent")
add("infra_share", on("prompts")(lambda p: coaching.reactions(p).agg(F.count_if(F.col("next_reaction") == "infra").alias("infra"), F.count("*").alias("prompts"))), f"{_ROWS} SELECT count(*) FILTER (next_reaction = 'infra') AS infra, count(*) AS prompts FROM r")
add("coaching_totals", on("prompts")(lambda p: coaching.overall(coaching.reactions(p))), f"{_ROWS} SELECT count(*) AS prompts, count(*) FILTER (next_reaction IN ('praise', 'proceed', 'correct')) AS judged, count(*) FILTER (next_reaction IN ('praise', 'proceed')) AS good, round_even(count(*) FILTER (next_reaction IN ('praise', 'proceed')) / count(*) FILTER (next_reaction IN ('praise', 'proceed', 'correct')), 3) AS smooth_rate, count(*) FILTER (next_reaction = 'infra') AS infra, round_even(count(*) FILTER (next_reaction = 'infra') / greatest(1, count(*)), 3) AS infra_share FROM r")
add("feature_tags", on("prompts")(lambda p: coaching.classified(p).select("id", F.array_join("features", ",").alias("features"))), f"{_TAGGED} SELECT id, array_to_string(features, ',') AS features FROM t")
add("feature_lift_by_agent", on("prompts")(lambda p: coaching.feature_lift_by_agent(coaching.reactions(p))), f"{_TAGGED} SELECT feature, agent, count(*) FILTER (has) AS with_n, count(*) FILTER (has AND g) AS with_successes, count(*) FILTER (NOT has) AS without_n, count(*) FILTER (NOT has AND g) AS without_successes FROM x WHERE jd GROUP BY ALL")
add("feature_lift", on("prompts")(lambda p: coaching.feature_lift(coaching.reactions(p))), f"""{_TAGGED}, a AS (SELECT feature, agent, count(*) FILTER (jd AND has) AS wn, count(*) FILTER (jd AND has AND g) AS wg, count(*) FILTER (jd AND NOT has) AS xn, count(*) FILTER (jd AND NOT has AND g) AS xg FROM x GROUP BY ALL),
  s AS (SELECT feature, round_even({_RATE('wg', 'wn')} - {_RATE('xg', 'xn')}, 3) AS l FROM a WHERE least(wn, xn) >= 8),
  e AS (SELECT feature, count(*) FILTER (jd AND has) AS wn, count(*) FILTER (jd AND has AND g) AS wg, count(*) FILTER (jd AND NOT has) AS xn, count(*) FILTER (jd AND NOT has AND g) AS xg, count(DISTINCT (agent, session)) FILTER (jd AND has) AS ws, count(DISTINCT (agent, session)) FILTER (jd AND NOT has) AS xs, round_even(count(*) FILTER (has) / greatest(1, count(*)), 3) AS us FROM x GROUP BY feature),
  v AS (SELECT *, {_RATE('wg', 'wn')} AS wr, {_RATE('xg', 'xn')} AS xr FROM e), z AS (SELECT *, round_even(wr - xr, 3) AS lift FROM v)
  SELECT feature, wn AS with_n, wg AS with_successes, wr AS with_rate, xn AS without_n, xg AS without_successes, xr AS without_rate, lift,
    CASE WHEN least(wn, xn) = 0 THEN 'insufficient comparison' WHEN least(wn, xn) >= 20 AND abs(lift) >= 0.15 AND NOT EXISTS (SELECT 1 FROM s WHERE s.feature = z.feature AND s.l * lift < 0) THEN 'strong signal' WHEN least(wn, xn) >= 8 THEN 'early signal' ELSE 'small sample · ' || least(wn, xn) END AS confidence,
    ws AS with_sessions, xs AS without_sessions, us AS usage_share FROM z""")
add("correction_chain", on("prompts")(lambda p: sequence.correction_chain(coaching.classified(p)).select("id", "correction_chain")), f"""{_ROWS}, stop AS (SELECT a.id, a.agent, a.session, a.i, a.norm, coalesce(min(b.i), 1000000) AS e FROM n a LEFT JOIN n b ON a.agent = b.agent AND a.session = b.session AND b.i > a.i AND b.reaction NOT IN ('correct', 'infra') AND b.norm <> a.norm GROUP BY ALL)
  SELECT s.id, count(b.id) AS correction_chain FROM stop s LEFT JOIN n b ON s.agent = b.agent AND s.session = b.session AND b.i > s.i AND b.i < s.e AND (b.reaction = 'correct' OR b.norm = s.norm) GROUP BY s.id""")
add("resent", on("prompts")(lambda p: coaching.resent(coaching.reactions(p))), f"{_ROWS} SELECT count(*) AS prompts_resent, count(DISTINCT norm) AS distinct_texts FROM r WHERE next_reaction = 'retry'")
add("reminders", on("prompts")(lambda p: coaching.reminders(coaching.classified(p))), f"{_ROWS} SELECT count(*) AS reminders FROM c WHERE {_rx('text', text.REMINDER[0])} OR {_rx('text', text.REMINDER[1])}")
add("checkins", on("prompts")(lambda p: coaching.checkins(coaching.reactions(p))), f"{_ROWS} SELECT count(*) AS n, count(*) FILTER (good) AS good FROM j WHERE words <= 15 AND {_rx('trim(text)', text.CHECKIN)}")
add("candidates", on("prompts")(lambda p: coaching.candidates(coaching.rows(p))), f"""{_ROWS}, stop AS (SELECT a.id, a.agent, a.session, a.i, a.norm, a.ts, coalesce(min(b.i), 1000000) AS e FROM n a LEFT JOIN n b ON a.agent = b.agent AND a.session = b.session AND b.i > a.i AND b.reaction NOT IN ('correct', 'infra') AND b.norm <> a.norm GROUP BY ALL),
  ch AS (SELECT s.id, s.ts, count(b.id) AS chain FROM stop s LEFT JOIN n b ON s.agent = b.agent AND s.session = b.session AND b.i > s.i AND b.i < s.e AND (b.reaction = 'correct' OR b.norm = s.norm) GROUP BY ALL)
  SELECT 'praised' AS list, id, CAST(NULL AS BIGINT) AS chain FROM (SELECT id FROM r WHERE next_reaction = 'praise' ORDER BY ts, id LIMIT 40)
  UNION ALL SELECT 'smooth_long_briefs', id, NULL FROM (SELECT id FROM r WHERE next_reaction = 'proceed' AND words >= 25 ORDER BY ts, id LIMIT 40)
  UNION ALL SELECT 'correction_loops', id, chain FROM (SELECT id, chain FROM ch WHERE chain >= 2 ORDER BY chain DESC, ts, id LIMIT 25)
  UNION ALL SELECT 'retries', id, NULL FROM (SELECT id FROM r WHERE next_reaction = 'retry' ORDER BY ts, id LIMIT 25)""")

# first-wins deduplication
add("usage_dedupe", on("usage")(lambda u: sequence.first_by(u.withColumn("message", F.col("ord") % 500), ["session", "message"], ["ord"]).select("session", "message", "ord", "output")), f"{_U} SELECT session, ord % 500 AS message, min(ord) AS ord, arg_min(output, ord) AS output FROM usage GROUP BY 1, 2")
add("tool_dedupe", on("tools")(lambda t: sequence.first_by(t, ["agent", "call_id"], ["ord"]).select("agent", "call_id", "ord", "name")), f"{_T} SELECT agent, call_id, min(ord) AS ord, arg_min(name, ord) AS name FROM tools GROUP BY 1, 2")

# as-of and forward fill over one session's turns
_TURNS = "SELECT CAST(user_id AS STRING) AS session, CAST(event_id AS DOUBLE) AS ts, event_id AS ord, CASE WHEN event_id % 7 = 0 THEN concat('/w/', CAST(event_id AS STRING)) ELSE '' END AS cwd, CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS is_context, CASE WHEN event_id % 10 = 0 THEN event_type END AS model FROM events"


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_TURNS.replace("FROM events", "FROM {e}"), e=spark.read.parquet(f"{d}/events.parquet"))


def asof_context(spark: SparkSession, d: str) -> DataFrame:
    t = _turns(spark, d)
    left = t.where("is_context = 0").select("session", "ts", F.col("ord").alias("id"))
    right = t.where("is_context = 1").select("session", "ts", "cwd", "ord")
    return sequence.asof(left, right, ["session"], "ts", "cwd", F.lit("/default"))


def forward_fill(spark: SparkSession, d: str) -> DataFrame:
    t = _turns(spark, d)
    cwd = sequence.carried(F.when(F.col("is_context") == 1, F.nullif(F.col("cwd"), F.lit(""))), ["session"], ["ts", "ord"])
    model = sequence.carried(F.when(F.col("is_context") == 1, F.struct("model")), ["session"], ["ts", "ord"])
    return t.select("session", "ord", cwd.alias("cwd"), model["model"].alias("model"))


add("asof_context", asof_context, f"WITH t AS ({_TURNS}), l AS (SELECT session, ts, ord AS id FROM t WHERE is_context = 0), x AS (SELECT session, ts, cwd FROM t WHERE is_context = 1) SELECT l.session, l.ts, l.id, CASE WHEN x.session IS NULL THEN '/default' ELSE x.cwd END AS cwd FROM l ASOF LEFT JOIN x ON l.session = x.session AND l.ts >= x.ts")
add("forward_fill", forward_fill, f"WITH t AS ({_TURNS}) SELECT session, ord, last_value(CASE WHEN is_context = 1 AND cwd <> '' THEN cwd END IGNORE NULLS) OVER w AS cwd, (last_value(CASE WHEN is_context = 1 THEN [model] END IGNORE NULLS) OVER w)[1] AS model FROM t WINDOW w AS (PARTITION BY session ORDER BY ts, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")

# cumulative counters
_FIELDS = ["input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens"]
_C = duckdb_ctes("counters")
_DELTAS = f"""{_C}, d AS (SELECT *, lag(input_tokens) OVER w AS pi, lag(output_tokens) OVER w AS po FROM counters WINDOW w AS (PARTITION BY session ORDER BY ts, ord)),
v AS (SELECT session, ord, CASE WHEN pi IS NOT NULL AND (input_tokens < pi OR output_tokens < po) THEN 'token_counter_reset' WHEN pi IS NULL AND NOT has_last THEN 'missing_counter_baseline' WHEN pi IS NULL AND (input_tokens <> last_input_tokens OR output_tokens <> last_output_tokens) THEN 'partial_counter_baseline' END AS issue,
  CASE WHEN pi IS NOT NULL AND input_tokens >= pi AND output_tokens >= po THEN input_tokens - pi WHEN pi IS NULL AND has_last THEN last_input_tokens END AS di, CASE WHEN pi IS NOT NULL AND input_tokens >= pi AND output_tokens >= po THEN output_tokens - po WHEN pi IS NULL AND has_last THEN last_output_tokens END AS dd
  FROM d WHERE ts BETWEEN {CUT - 10 * 86400} AND {NOW})"""


def _deltas(c: DataFrame) -> DataFrame:
    return sequence.counter_deltas(c, CUT - 10 * 86400, NOW, _FIELDS)


def native_else_counter(spark: SparkSession, d: str) -> DataFrame:
    """Sessions with native usage rows use those; only the others fall back to counter deltas."""
    native = view(spark, d, "usage").where("CAST(session AS INT) % 2 = 0").groupBy("session").agg(F.sum(F.col("fresh_input") + F.col("output")).cast("long").alias("tokens")).withColumn("measurement", F.lit("response"))
    deltas = _deltas(view(spark, d, "counters")).groupBy("session").agg(F.sum(F.col("d_input_tokens") + F.col("d_output_tokens")).cast("long").alias("tokens")).withColumn("measurement", F.lit("counter_delta"))
    return native.unionByName(deltas.join(native.select("session"), "session", "left_anti"))


def cross_check(spark: SparkSession, d: str) -> DataFrame:
    """Measured against counter totals per session, where both exist and the counters are comparable."""
    measured = view(spark, d, "usage").groupBy("session").agg(F.sum(F.col("fresh_input") + F.col("cache_read") + F.col("output")).cast("long").alias("measured"))
    window = _deltas(view(spark, d, "counters")).groupBy("session").agg(F.sum(F.col("d_input_tokens") + F.col("d_output_tokens")).cast("long").alias("total"), F.count("issue").alias("issues"))
    out = measured.join(window, "session").withColumn("counter_window", F.when(F.col("issues") == 0, F.col("total")))
    return out.select("session", "measured", "counter_window", F.coalesce(F.col("measured") != F.col("counter_window"), F.lit(False)).alias("mismatch"))


add("counter_delta", on("counters")(lambda c: _deltas(c).select("session", "ord", "issue", F.col("d_input_tokens").cast("long").alias("d_input"), F.col("d_output_tokens").cast("long").alias("d_output"))), f"{_DELTAS} SELECT session, ord, issue, CAST(di AS BIGINT) AS d_input, CAST(dd AS BIGINT) AS d_output FROM v")
add("native_else_counter", native_else_counter, f"""{_DELTAS}, {_U[5:]}, nat AS (SELECT session, CAST(sum(fresh_input + output) AS BIGINT) AS tokens FROM usage WHERE CAST(session AS INT) % 2 = 0 GROUP BY session)
  SELECT session, tokens, 'response' AS measurement FROM nat UNION ALL SELECT session, CAST(sum(di + dd) AS BIGINT), 'counter_delta' FROM v WHERE session NOT IN (SELECT session FROM nat) GROUP BY session""")
add("cross_check", cross_check, f"""{_DELTAS}, {_U[5:]}, m AS (SELECT session, CAST(sum(fresh_input + cache_read + output) AS BIGINT) AS measured FROM usage GROUP BY session), k AS (SELECT session, CAST(sum(di + dd) AS BIGINT) AS total, count(issue) AS issues FROM v GROUP BY session)
  SELECT session, measured, CASE WHEN issues = 0 THEN total END AS counter_window, coalesce(measured <> CASE WHEN issues = 0 THEN total END, false) AS mismatch FROM m JOIN k USING (session)""")


def history_match(spark: SparkSession, d: str) -> DataFrame:
    """Typed history against rollout messages whose time is off by 0 to 8 seconds."""
    p = stats.human(view(spark, d, "prompts")).select("session", F.trim("text").alias("key"), "id", "ts", (F.length("text") % 9).alias("jitter"))
    rollout = p.select("session", "key", F.concat(F.lit("r"), "id").alias("id"), (F.col("ts") + F.col("jitter")).alias("ts"))
    return sequence.greedy_matches(p.drop("jitter"), rollout, ["session", "key"], 5.0)


# prompts of a session are a minute or more apart, so the nearest message is the one of the same prompt
add("history_match", history_match, f"{_P} SELECT session, trim(text) AS key, id AS left_id, 'r' || id AS right_id FROM p WHERE length(text) % 9 <= 5")

# conversation trees
_N = duckdb_ctes("nodes")
_PATHS = f"{_N.replace('WITH', 'WITH RECURSIVE', 1)}, leaf AS (SELECT conv_id, node FROM nodes a WHERE NOT EXISTS (SELECT 1 FROM nodes b WHERE b.conv_id = a.conv_id AND b.parent = a.node)), walk AS (SELECT conv_id, node AS leaf, node, 0 AS depth FROM leaf UNION ALL SELECT w.conv_id, w.leaf, n.parent, w.depth + 1 FROM walk w JOIN nodes n ON n.conv_id = w.conv_id AND n.node = w.node WHERE n.parent IS NOT NULL)"


def _whole(n: DataFrame) -> DataFrame:
    return sequence.branch_paths(n)


add("conversation_branches", on("nodes")(_whole), f"{_PATHS} SELECT conv_id, leaf, node, depth FROM walk")
add("leaf_nodes", on("nodes")(lambda n: n.join(n.select("conv_id", F.col("parent").alias("node")), ["conv_id", "node"], "left_anti").select("conv_id", "node")), f"{_PATHS} SELECT conv_id, node FROM leaf")
add("shared_ancestors", on("nodes")(lambda n: sequence.first_by(_whole(n), ["conv_id", "node"], ["leaf"]).select("conv_id", "node", "leaf")), f"{_PATHS} SELECT conv_id, node, min(leaf) AS leaf FROM walk GROUP BY 1, 2")


# redaction
def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")


_RULES = {k: (p, n) for k, p, n in redact.RULES}
_NO_LOOK = [k for k, p, _ in redact.RULES if not any(x in p for x in ("(?<", "(?!", "(?=")) and k not in ("card", "email")]
#: DuckDB's word characters and borders are ASCII only, so Unicode ones are spelled out. An address begins and ends with one.
_WORDS = r"\p{L}\p{M}\p{N}_"
_EMAIL = rf"[{_WORDS}][{_WORDS}.+-]*@[{_WORDS}-]+\.[{_WORDS}.-]*[{_WORDS}]"


def _redact_sql(kinds: list[str]) -> str:
    out = "text"
    for k in kinds:
        pattern, new = _RULES[k]
        out = f"regexp_replace({out}, '{_q(pattern)}', '{new.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2')}', 'g')"
    return f"SELECT doc_id, {out} AS text FROM documents"


add("redact_emails", lambda s, d: _docs(s, d).select("doc_id", redact.scrub(F.col("text"), kinds=["email"]).alias("text")), f"SELECT doc_id, regexp_replace(text, '{_EMAIL}', '[email]', 'g') AS text FROM documents")
add("redact_credentials", lambda s, d: _docs(s, d).select("doc_id", redact.scrub(F.col("text"), kinds=_NO_LOOK).alias("text")), _redact_sql(_NO_LOOK))
add("redact_full", lambda s, d: _docs(s, d).select("doc_id", redact.scrub(F.col("text")).alias("text")))
add("redact_cards", lambda s, d: _docs(s, d).select("doc_id", redact.counts(F.col("text"))["card"].cast("long").alias("cards")).where("cards > 0"))
add("redaction_counts", on("prompts")(stats.redactions))
add("digest", on("prompts")(lambda p: stats.digest(p).select("id", "line")))
_LINE = f"'[' || id || '] ' || strftime({_TS}, '%a %m-%d %H:%M') || ' | ' || agent || ' | ' || project || ' | ' || {_wc('text')} || 'w | ' || replace(substr({_SCRUBBED}, 1, 400), chr(10), ' / ')"
ORACLES["digest"] = f"{_P} SELECT id, {_LINE} AS line FROM p"

# scans
def tag_strip(spark: SparkSession, d: str) -> DataFrame:
    """Whole pages, once inside an injected tag, which goes, and once behind it, which stays."""
    around = [F.lit("<system-reminder>"), F.col("html"), F.lit("</system-reminder>"), F.col("html"), F.lit("<command-name>x</command-name> page "), F.col("page_id").cast("string")]
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", text.without_injected(F.concat(*around)).alias("text"))


add("tag_strip", tag_strip, "SELECT page_id, html || ' page ' || page_id AS text FROM pages")
add("json_props", lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", F.expr("try_variant_get(try_parse_json(props), '$.k', 'bigint')").alias("k")), "SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """How often each agent's prompts get each reaction."""
    return coaching.reactions(view(spark, d, "prompts")).groupBy("agent", "next_reaction").agg(F.count("*").alias("n"))


add("reactions_by_agent", flagship, f"{_ROWS} SELECT agent, next_reaction, count(*) AS n FROM r GROUP BY ALL")

ORACLES["redaction_counts"] = redaction_queries.counts_oracle(_P)
for more in (reader_queries, rollout_queries, export_queries, matching_queries, redaction_queries):
    QUERIES.update(more.QUERIES)
    ORACLES.update(more.ORACLES)

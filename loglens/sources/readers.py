"""Readers that turn agents' logs and chat exports into normalized prompts, usage, tools, sessions and diagnostics.

Prompts: ts, agent, session, text, cwd, surface, is_automation. Usage: ts, agent, session, cwd, model, effort, side, branch,
estimated, measurement and token counts. Every raw row carries `ord`, its reading order, wherever the first of equal ones
counts. Issues are rows (agent, code), malformed records rows with the code `malformed`.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglens.functions import text as T
from loglens.operators import sequence, settled
from loglens.sources import exports as exporting
from loglens.sources import folders
from loglens.sources import jsonl as J
from loglens.sources.config import EXPORT_PROJECTS, Config

USAGE_FIELDS = ["input_tokens", "cached_input_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "cache_write_input_tokens", "output_tokens", "reasoning_output_tokens"]
COUNTER_FIELDS = ["input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens"]
# How automated and injected messages begin.
AUTOMATED = ["<", "Base directory for this skill", "Caveat:", "Another Claude session sent"]
INJECTED = ["<", "# AGENTS.md", "The following is the Codex agent history"]
ORIGINS = ["task-notification", "coordinator", "peer"]
SURFACES = {"codex-tui": "cli", "Codex Desktop": "desktop", "codex_exec": "exec"}

PROMPT = "ts double, agent string, session string, text string, cwd string, surface string, is_automation boolean, ord struct<path:string,block:bigint,line:bigint>"
USAGE = "ts double, agent string, session string, cwd string, model string, effort string, side boolean, branch string, estimated boolean, measurement string, fresh_input double, cache_read double, cache_write double, output double, reasoning double, ord struct<path:string,block:bigint,line:bigint>"
TOOL = "ts double, agent string, session string, name string, file_path string, skill string, ord struct<path:string,block:bigint,line:bigint>"
SEEN = "agent string, session string, ts double, cwd string, surface string, auto boolean, ord struct<path:string,block:bigint,line:bigint>"
ISSUE = "agent string, code string"
CHECK = "session string, measured double, counter_window double"


@dataclass
class Parts:
    """DataFrames that readers add to; take() unions them under a fixed schema."""

    spark: SparkSession
    rows: dict[str, list[DataFrame]] = field(default_factory=dict)
    notes: dict[str, dict] = field(default_factory=lambda: {"files": {}, "sources": {}, "provenance": {}})

    def add(self, name: str, df: DataFrame) -> None:
        self.rows.setdefault(name, []).append(df)

    def issue(self, agent: str, code: str, n: int = 1) -> None:
        self.add("issues", self.spark.createDataFrame([(agent, code)] * n, ISSUE))

    def take(self, name: str, schema: str) -> DataFrame:
        empty = self.spark.createDataFrame([], schema)
        return reduce(lambda a, b: a.unionByName(b.select(*empty.columns)), self.rows.get(name, []), empty)


def _starts(text: Column, heads: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.startswith(text, F.lit(h)) for h in heads))


def _ord() -> Column:
    return F.struct("path", F.col("ord.block").alias("block"), F.col("ord.line").alias("line")).alias("ord")


def usage_columns(codex: bool, base: str, j: str = "j") -> list[Column]:
    """Normalized counts; codex counts cached tokens as part of its input."""
    a = lambda f: J.amount(base, f, j)
    read = a("cached_input_tokens") if codex else a("cache_read_input_tokens")
    return [(a("input_tokens") - (read if codex else F.lit(0.0))).alias("fresh_input"), read.alias("cache_read"), (a("cache_creation_input_tokens") + a("cache_write_input_tokens")).alias("cache_write"), a("output_tokens").alias("output")]


def claude_code(parts: Parts, cfg: Config, raw: DataFrame | None = None) -> None:
    """raw: the lines of the transcripts, as J.scan() gives them; those below home unless given."""
    agent, folder = "claude-code", f"{cfg.home}/.claude/projects"
    if raw is None:
        if not os.path.isdir(folder):
            return
        raw = J.lines(parts.spark, folder)
    parts.notes["sources"][agent] = "local Claude Code transcripts"
    if raw is None:
        return
    parts.notes["files"][agent] = lambda: [raw.select("path").distinct().count()] * 2
    bad = lambda df: parts.add("issues", df.select(F.lit(agent).alias("agent"), F.lit("malformed").alias("code")))
    read = J.once(raw, type=J.string("$.type"), ts=J.seconds("$.timestamp"), session=J.shown("$.sessionId"))
    whole = F.col("session").isNotNull() & J.is_object("$.message")
    read = J.once(read, good=F.when(F.col("j").isNull(), False).when(F.col("type").isin("user", "assistant"), F.when(F.col("ts").isNull(), False).when(F.col("ts").between(cfg.cut, cfg.now), whole)))
    # one pass keeps what counts and the lines that can't be used
    found = settled(read.where("good IS NOT NULL").select("good", "type", "ts", "session", F.when(F.col("good"), F.col("j")).alias("j"), _ord(), J.shown("$.cwd").alias("cwd"), J.shown("$.entrypoint").alias("surface"), F.lit(agent).alias("agent")))
    bad(found.where("NOT good"))
    rows = found.where("good")
    parts.add("seen", rows.select("agent", "session", "ts", "cwd", "surface", F.lit(False).alias("auto"), "ord"))

    replies = rows.where("type = 'assistant'").withColumn("mid", F.coalesce(J.shown("$.message.id"), J.shown("$.uuid"), F.to_json("j")))
    blocks = replies.select("agent", "session", "ts", "ord", F.posexplode(J.array("$.message.content")).alias("k", "b")).where(J.string("$.type", "b") == "tool_use")
    tools = blocks.withColumn("call", F.coalesce(J.shown("$.id", "b"), F.to_json("b")))
    tools = sequence.first_by(tools, ["session", "call"], ["ord", "k"])
    name = F.coalesce(J.string("$.name", "b"), F.lit(""))
    parts.add("tools", tools.select("ts", "agent", "session", name.alias("name"), J.shown("$.input.file_path", "b").alias("file_path"), F.when(name == "Skill", J.shown("$.input.skill", "b")).alias("skill"), "ord"))
    first = sequence.first_by(replies, ["session", "mid"], ["ord"])
    fields = [f for f in USAGE_FIELDS if f != "reasoning_output_tokens"]
    ok = (J.kind("$.message.usage").isNull() | (J.kind("$.message.usage") == "VOID") | J.is_object("$.message.usage")) & J.valid_numbers("$.message.usage", fields) & J.valid_numbers("$.message.usage.output_tokens_details", ["thinking_tokens"])
    first = J.once(first, ok=ok)
    parts.add("issues", first.where("NOT ok").select("agent", F.lit("invalid_usage").alias("code")))
    parts.add("usage", first.where("ok").select("ts", "agent", "session", "cwd", J.shown("$.message.model").alias("model"), J.shown("$.effort").alias("effort"), J.truthy("$.isSidechain").alias("side"), J.shown("$.gitBranch").alias("branch"), F.lit(False).alias("estimated"), F.lit("response").alias("measurement"), *usage_columns(False, "$.message.usage"), J.amount("$.message.usage.output_tokens_details", "thinking_tokens").alias("reasoning"), "ord"))

    said = rows.where("type = 'user'").where(~J.truthy("$.isSidechain"))
    content = F.expr("array_join(transform(filter(blocks, b -> try_variant_get(b, '$.type', 'string') = 'text'), b -> coalesce(try_variant_get(b, '$.text', 'string'), '')), '\\n')")
    result = F.expr("coalesce(exists(blocks, b -> coalesce(try_variant_get(b, '$.type', 'string'), '') = 'tool_result'), false)")
    said = said.withColumn("blocks", J.array("$.message.content")).withColumn("kind", J.kind("$.message.content"))
    odd = F.col("kind").isNotNull() & ~F.col("kind").isin("STRING", "VOID") & ~F.startswith("kind", F.lit("ARRAY"))
    bad(said.where(odd))
    said = said.where(~odd & ~result).withColumn("raw", F.coalesce(J.string("$.message.content"), content, F.lit("")))
    said = said.where(~F.contains("raw", F.lit("[Request interrupted by user"))).withColumn("text", T.without_injected(F.col("raw")))
    auto = _starts(F.col("text"), AUTOMATED) | F.coalesce(J.string("$.origin.kind").isin(ORIGINS), F.lit(False))
    parts.add("prompts", said.select("ts", "agent", "session", "text", "cwd", "surface", auto.alias("is_automation"), "ord"))


def codex(parts: Parts, cfg: Config, raw: DataFrame | None = None, typed: DataFrame | None = None) -> None:
    """raw, typed: the lines of the rollouts and of the typed history, as J.scan() gives them (raw without j); those below home
    unless given."""
    agent, base = "codex", f"{cfg.home}/.codex"
    given = raw is not None or typed is not None
    if not given and not os.path.isdir(base):
        return
    spark, inside = parts.spark, F.col("ts").between(cfg.cut, cfg.now)
    parts.notes["sources"][agent] = "local Codex transcripts and typed history"
    bad = lambda df: parts.add("issues", df.select(F.lit(agent).alias("agent"), F.lit("malformed").alias("code")))
    told = lambda df, code: parts.add("issues", df.select(F.lit(agent).alias("agent"), F.lit(code).alias("code")))
    files = 0
    history = spark.createDataFrame([], "session string, ts double, text string, id bigint")
    typed = typed if given else J.lines(spark, f"{base}/history.jsonl", "history.jsonl")
    if typed is not None:
        files += 1
        h = J.once(typed, ts=J.seconds("$.ts"), session=J.string("$.session_id"), text=J.string("$.text"))
        ok = F.col("ts").isNotNull() & F.col("session").isNotNull() & F.col("text").isNotNull()
        bad(h.where(~ok))
        # the numbers are read by two plans below, so they are fixed here
        history = settled(h.where(ok & inside).select("session", "ts", "text", F.monotonically_increasing_id().alias("id")))
    raw = raw if given else J.lines(spark, f"{base}/sessions", parse=False)
    if raw is None:
        raw = spark.createDataFrame([], "path string, ord struct<block:bigint,line:bigint>, line string")
    parts.notes["files"][agent] = lambda: [files + raw.select("path").distinct().count()] * 2
    # most lines can't be a session's record, which shows without parsing them
    heads = J.once(J.parsed(raw.where(J.may_say("session_meta"))), type=J.string("$.type"))
    metas = sequence.first_by(heads.where("type = 'session_meta'"), ["path"], ["ord"]).select("path", "j", F.coalesce(J.shown("$.payload.id"), J.shown("$.payload.session_id")).alias("session"))
    metas = settled(metas.where("session IS NOT NULL"))
    told(raw.select("path").distinct().join(metas.select("path"), "path", "left_anti"), "missing_session_metadata")
    rows = J.once(J.parsed(raw), type=J.string("$.type"), ts=J.seconds("$.timestamp"), shaped=J.at("$.payload").isNull() | J.is_object("$.payload"))
    rows = rows.withColumn("good", F.col("j").isNotNull() & F.col("ts").isNotNull() & F.col("shaped"))
    # contexts and counters count from before the window on; what does not count is left out ahead of the shuffle
    rows = rows.where(~F.col("good") | inside | F.col("type").isin("turn_context", "event_msg"))
    rows = rows.select("path", "good", "ts", "type", F.when(F.col("good"), F.col("j")).alias("j"), _ord().alias("o"), F.col("j").isNull().alias("unread"))
    of = metas.select("path", "session")
    kept = rows.join(F.broadcast(of) if metas.count() <= 10_000 else of.hint("shuffle_hash"), "path", "left").where("unread OR session IS NOT NULL")
    meta = metas.groupBy("session").agg(F.max_by("j", "path").alias("m"))
    meta = meta.select("session", J.shown("$.payload.cwd", "m").alias("meta_cwd"), J.shown("$.payload.originator", "m").alias("originator"), J.shown("$.payload.thread_source", "m").alias("thread"), J.string("$.payload.source", "m").alias("src"), J.is_object("$.payload.source", "m").alias("nested"))
    typed_in = history.select("session").distinct().withColumn("typed", F.lit(True))
    info = meta.join(typed_in, "session", "full_outer").withColumn("typed", F.coalesce("typed", F.lit(False)))
    mapped = reduce(lambda acc, kv: acc.when(F.col("originator") == kv[0], kv[1]), SURFACES.items(), F.when(F.lit(False), ""))
    surface = mapped.otherwise(F.col("originator"))
    auto = F.coalesce(F.col("nested"), F.lit(False)) | F.coalesce(F.col("thread") == "guardian_review", F.lit(False)) | (F.coalesce(F.col("originator") == "codex_exec", F.lit(False)) & ~F.col("typed"))
    info = info.select("session", "meta_cwd", "typed", F.when((F.col("src") == "vscode") & (surface == "cli"), "vscode").otherwise(surface).alias("surface"), auto.alias("auto"))
    told(history.select("session").distinct().join(metas.select("session"), "session", "left_anti"), "history_without_rollout")

    # one pass keeps what counts and the lines that can't be used; those stay with their file and are never equal
    kept = kept.select("good", F.when(F.col("good"), F.col("session")).otherwise(F.col("path")).alias("place"), "ts", "type", "j", "o", F.when(~F.col("good"), F.col("o")).alias("own"))
    events = J.once(kept.repartition("place"), canon=F.to_json("j"))
    events = sequence.first_by(events, ["place", "good", "canon", "own"], ["o"], hashed=True).drop("canon", "own")
    events, of_one, order = J.once(events, pt=J.string("$.payload.type")), ["place", "good"], ["ts", "o"]
    context = F.when(F.col("type") == "turn_context", F.struct(J.shown("$.payload.model").alias("model"), J.shown("$.payload.effort").alias("effort")))
    turn_cwd = F.when(F.col("type") == "turn_context", J.shown("$.payload.cwd"))
    events = events.withColumn("ctx", sequence.carried(context, of_one, order)).withColumn("turn", sequence.carried(turn_cwd, of_one, order))
    events = events.join(info.withColumnRenamed("session", "place"), "place", "left").withColumn("cwd", F.coalesce("turn", "meta_cwd")).select("good", F.col("place").alias("session"), "ts", F.col("o").alias("ord"), "type", "pt", "j", "cwd", "meta_cwd", F.col("ctx.model").alias("model"), F.col("ctx.effort").alias("effort"), "surface", "auto", F.lit(agent).alias("agent"))
    events = settled(events)
    bad(events.where("NOT good"))
    events, canon = events.where("good"), F.to_json("j")

    calls = events.where(inside & (F.col("type") == "response_item") & F.col("pt").isin("function_call", "custom_tool_call")).withColumn("call", F.coalesce(J.shown("$.payload.call_id"), canon))
    calls = sequence.first_by(calls, ["session", "call"], ["ts", "ord"])
    none = F.lit(None).cast("string")
    parts.add("tools", calls.select("ts", "agent", "session", F.coalesce(J.string("$.payload.name"), F.lit("")).alias("name"), none.alias("file_path"), none.alias("skill"), "ord"))

    msgs = events.where(inside & (F.col("type") == "response_item") & (F.col("pt") == "message") & (J.string("$.payload.role") == "user")).withColumn("kind", J.kind("$.payload.content"))
    odd = F.col("kind").isNotNull() & (F.col("kind") != "VOID") & ~F.startswith("kind", F.lit("ARRAY"))
    bad(msgs.where(odd))
    joined = F.expr("array_join(transform(filter(blocks, b -> coalesce(schema_of_variant(try_variant_get(b, '$.text', 'variant')), 'STRING') = 'STRING'), b -> coalesce(try_variant_get(b, '$.text', 'string'), '')), ' ')")
    cands = msgs.where(~odd).withColumn("blocks", J.array("$.payload.content")).withColumn("text", T.strip(F.coalesce(joined, F.lit(""))))
    cands = cands.where((F.col("text") != "") & ~_starts(F.col("text"), INJECTED)).withColumn("id", F.xxhash64("session", canon))
    left = history.withColumn("key", T.strip(F.col("text"))).withColumn("id", F.concat(F.lit("h"), F.col("id").cast("string")))
    right = cands.select("session", F.col("text").alias("key"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("id"), "ts", "cwd", "ord")
    pairs = sequence.greedy_matches(left.select("session", "key", "id", "ts"), right.select("session", "key", "id", "ts"), ["session", "key"], 5.0)
    pairs = pairs.persist()
    contexts = events.where("type = 'turn_context'").select("session", "ts", F.struct("cwd").alias("at"), F.row_number().over(Window.partitionBy("session").orderBy(*order[:1], "ord")).alias("ord"))
    placed = sequence.asof(left.select("session", "ts", "id", "key"), contexts, ["session"], "ts", "at")
    placed = placed.join(pairs.select("session", F.col("left_id").alias("id"), "right_id"), ["session", "id"], "left").join(right.select("session", F.col("id").alias("right_id"), F.struct("cwd").alias("own")), ["session", "right_id"], "left").join(info, "session")
    cwd = F.when(F.col("own").isNotNull(), F.col("own.cwd")).when(F.col("at").isNotNull(), F.col("at.cwd")).otherwise(F.col("meta_cwd"))
    zero = F.struct(F.lit("").alias("path"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("line")).alias("ord")
    parts.add("prompts", placed.select("ts", F.lit(agent).alias("agent"), "session", F.col("key").alias("text"), cwd.alias("cwd"), "surface", F.col("auto").alias("is_automation"), zero))
    alone = right.join(pairs.select("session", F.col("right_id").alias("id")), ["session", "id"], "left_anti").join(info, "session")
    parts.add("prompts", alone.select("ts", F.lit(agent).alias("agent"), "session", F.col("key").alias("text"), "cwd", "surface", F.col("auto").alias("is_automation"), "ord"))

    records = events.where(inside & (F.col("type") == "token_usage_record")).withColumn("rid", F.coalesce(J.shown("$.payload.response_id"), canon))
    records = sequence.first_by(records, ["session", "rid"], ["ts", "ord"])
    fresh = J.amount("$.payload.usage", "input_tokens") - J.amount("$.payload.usage", "cached_input_tokens")
    records = J.once(records, ok=J.valid_numbers("$.payload.usage", USAGE_FIELDS) & (fresh >= 0)).persist()
    told(records.where("NOT ok"), "invalid_usage")
    native = records.where("ok").select("ts", "agent", "session", "cwd", "model", "effort", (F.col("auto") | F.coalesce(F.col("model") == "codex-auto-review", F.lit(False))).alias("side"), none.alias("branch"), F.lit(False).alias("estimated"), F.lit("response").alias("measurement"), *usage_columns(True, "$.payload.usage"), J.amount("$.payload.usage", "reasoning_output_tokens").alias("reasoning"), "ord")

    c = events.where((F.col("type") == "event_msg") & (F.col("pt") == "token_count") & J.is_object("$.payload.info"))
    total, last = "$.payload.info.total_token_usage", "$.payload.info.last_token_usage"
    c = c.withColumn("valid", J.is_object(total) & J.valid_numbers(total, COUNTER_FIELDS)).withColumn("has_last", J.is_object(last))
    for f in COUNTER_FIELDS:
        c = c.withColumn(f, J.amount(total, f)).withColumn(f"last_{f}", J.amount(last, f))
    told(c.where("NOT valid"), "invalid_token_counter")
    d = sequence.counter_deltas(c, cfg.cut, cfg.now, COUNTER_FIELDS).persist()
    reported = d.where("issue IS NOT NULL").select("session")
    parts.add("issues", d.where("issue IS NOT NULL").select("agent", F.col("issue").alias("code")))
    usable = reduce(lambda a, b: a | b, (F.col(f"d_{f}") != 0 for f in COUNTER_FIELDS))
    d = d.where(usable)
    deltas = d.join(records.select("session").distinct(), "session", "left_anti").where("d_input_tokens >= d_cached_input_tokens").select("ts", "agent", "session", "cwd", "model", "effort", F.col("auto").alias("side"), none.alias("branch"), F.lit(False).alias("estimated"), F.lit("counter_delta").alias("measurement"), (F.col("d_input_tokens") - F.col("d_cached_input_tokens")).alias("fresh_input"), F.col("d_cached_input_tokens").alias("cache_read"), F.lit(0.0).alias("cache_write"), F.col("d_output_tokens").alias("output"), F.col("d_reasoning_output_tokens").alias("reasoning"), "ord")
    used = native.unionByName(deltas)
    parts.add("usage", used)
    for df in (records, d.join(records.select("session").distinct(), "session", "left_anti")):
        parts.add("seen", df.select("agent", "session", "ts", "cwd", "surface", "auto", "ord"))
    measured = used.groupBy("session").agg(F.sum(F.col("fresh_input") + F.col("cache_read") + F.col("output")).alias("m"), F.count("*").alias("n"))
    fell = d.groupBy("session").agg(F.sum(F.col("d_input_tokens") + F.col("d_output_tokens")).alias("t"))
    broken = c.where("NOT valid").select("session").unionByName(reported).distinct().withColumn("broken", F.lit(True))
    counted = c.select("session").distinct().withColumn("counted", F.lit(True))
    had = records.select("session").distinct().withColumn("had", F.lit(True))
    check = info.select("session", "typed")
    for other in (measured, fell, broken, counted, had, cands.select("session").distinct().withColumn("cand", F.lit(True))):
        check = check.join(other, "session", "left")
    zero_m, window = F.coalesce("m", F.lit(0.0)), F.when(F.col("counted") & F.col("broken").isNull(), F.coalesce("t", F.lit(0.0)))
    check = check.select("session", zero_m.alias("measured"), window.alias("counter_window"), "had", "n", "typed", "cand").persist()
    parts.add("checks", check)
    told(check.where("had AND counter_window IS NOT NULL AND measured <> counter_window"), "usage_cross_check_mismatch")
    told(check.where("n IS NULL AND (typed OR cand)"), "usage_unavailable")


def _candidates(spark: SparkSession, cfg: Config) -> DataFrame:
    """(path, modified) of the files that may be exports: those that the settings name, else those lying in Downloads. A named
    file that isn't there is a candidate too, of no age."""
    down = f"{cfg.home}/Downloads"
    named = [os.path.abspath(os.path.expanduser(p)) for p in cfg.exports]
    there = [p for p in named if os.path.isfile(p)] if named else [down] if os.path.isdir(down) else []
    empty = spark.createDataFrame([(p,) for p in named if p not in there], "path string").select("path", F.lit(None).cast("timestamp").alias("modified"))
    if not there:
        return empty
    found = exporting.candidates(spark, there, "*" if named else "*.{zip,json,ZIP,JSON}")
    found = found.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "modified")
    return found.where(F.substring_index("path", "/", -1) != "chatgpt-self-report.json").unionByName(empty)


def exports(parts: Parts, cfg: Config) -> None:
    """The newest readable export of each app. The driver sees the candidates' paths and the rows about the two chosen."""
    wanted = sorted(cfg.sources & set(EXPORT_PROJECTS))
    if not wanted:
        return
    found = settled(_candidates(parts.spark, cfg))
    paths = [r.path for r in found.collect()]
    for agent in wanted:
        parts.notes["files"][agent] = [len(paths), 0]
    if not paths:
        return
    about = settled(exporting.inspected(parts.spark, paths).join(found, "path"))
    for_each = F.explode(F.array(*[F.lit(a) for a in wanted])).alias("agent")
    parts.add("issues", about.where("NOT readable").select(for_each, F.lit("unreadable_export_candidate").alias("code")))
    newest = sequence.first_by(about.where(F.col("agent").isin(wanted)), ["agent"], [F.desc_nulls_last("modified"), "path"])
    chosen = {r.agent: r for r in newest.collect()}
    for agent, r in sorted(chosen.items()):
        parts.notes["files"][agent][1] = 1
        parts.notes["sources"][agent] = os.path.basename(r.path)
        coverage = None if r.coverage is None else json.loads(r.coverage)
        parts.notes["provenance"][agent] = {"coverage": coverage, "label": "export; completeness unverified" if coverage is None else "app history, may be incomplete", "branch_policy": "active path; separate leaf paths when current_node is unavailable"}
        lines = settled(exporting.conversations(parts.spark, [(r.path, r.size)])).select("k", "line")
        (chatgpt if agent == "chatgpt" else claude_ai)(parts, cfg, lines.withColumn("j", F.expr("try_parse_json(line)")))


def _conversation_id() -> Column:
    return F.coalesce(J.shown("$.id"), J.shown("$.conversation_id"), J.shown("$.uuid"), F.concat(F.lit("export_"), F.substring(F.sha2("line", 256), 1, 20)))


def _messages(parts: Parts, cfg: Config, agent: str, m: DataFrame) -> None:
    """m (session, ts, text, role, model, ord) -> prompts and estimated usage."""
    m = m.where(F.col("ts").between(cfg.cut, cfg.now) & (F.col("text") != "") & F.col("role").isin("user", "assistant")).withColumn("agent", F.lit(agent)).withColumn("surface", F.lit("export")).withColumn("cwd", F.lit(None).cast("string"))
    size = F.floor(F.length("text") / 4).cast("double")
    none, zero = F.lit(None).cast("string"), F.lit(0.0)
    parts.add("seen", m.select("agent", "session", "ts", "cwd", "surface", F.lit(False).alias("auto"), "ord"))
    parts.add("prompts", m.where("role = 'user'").select("ts", "agent", "session", T.strip(F.col("text")).alias("text"), "cwd", "surface", F.lit(False).alias("is_automation"), "ord"))
    parts.add("usage", m.select("ts", "agent", "session", "cwd", "model", none.alias("effort"), F.lit(False).alias("side"), none.alias("branch"), F.lit(True).alias("estimated"), F.lit("characters_divided_by_four").alias("measurement"), F.when(F.col("role") == "user", size).otherwise(zero).alias("fresh_input"), zero.alias("cache_read"), zero.alias("cache_write"), F.when(F.col("role") == "assistant", size).otherwise(zero).alias("output"), zero.alias("reasoning"), "ord"))


def _place(k: str, i: str) -> Column:
    return F.struct(F.lit("").alias("path"), F.col(k).cast("long").alias("block"), F.col(i).cast("long").alias("line")).alias("ord")


def claude_ai(parts: Parts, cfg: Config, convs: DataFrame) -> None:
    agent = "claude-ai"
    m = convs.select("k", _conversation_id().alias("session"), F.posexplode(J.array("$.chat_messages")).alias("i", "m")).withColumn("ts", J.seconds("$.created_at", "m"))
    parts.add("issues", m.where("ts IS NULL").select(F.lit(agent).alias("agent"), F.lit("malformed").alias("code")))
    role = F.when(J.string("$.sender", "m") == "human", "user").otherwise("assistant")
    _messages(parts, cfg, agent, m.where("ts IS NOT NULL").select("session", "ts", F.coalesce(J.string("$.text", "m"), F.lit("")).alias("text"), role.alias("role"), F.lit(None).cast("string").alias("model"), _place("k", "i")))


def chatgpt(parts: Parts, cfg: Config, convs: DataFrame) -> None:
    agent = "chatgpt"
    told = lambda df, code: parts.add("issues", df.select(F.lit(agent).alias("agent"), F.lit(code).alias("code")))
    odd = J.kind("$.mapping").isNotNull() & (J.kind("$.mapping") != "VOID") & ~J.is_object("$.mapping")
    told(convs.where(odd), "malformed")
    convs = convs.where(~odd).withColumn("cid", _conversation_id())
    nodes = convs.select("k", "cid", J.shown("$.current_node").alias("current"), J.seconds("$.create_time").alias("conv_ts"), F.posexplode(F.expr("map_entries(try_variant_get(j, '$.mapping', 'map<string,variant>'))")).alias("i", "e")).select("k", "cid", "current", "conv_ts", "i", F.col("e.key").alias("node"), F.col("e.value").alias("v"))
    nodes = nodes.withColumn("parent", J.shown("$.parent", "v")).withColumn("linked", J.kind("$.parent", "v").isNotNull() | J.kind("$.children", "v").isNotNull())
    shape = nodes.groupBy("k").agg(F.bool_or("linked").alias("tree"), F.bool_or(F.coalesce(F.col("node") == F.col("current"), F.lit(False))).alias("known"))
    nodes = settled(nodes.join(shape, "k"))
    linked = nodes.where("tree OR known").select(F.col("k").alias("conv_id"), "node", "parent", "i", "current", "known")
    active = linked.where("known AND node = current").select("conv_id", F.col("node").alias("leaf"))
    starts = settled(active.unionByName(sequence.leaves(linked.where("NOT known"))))
    paths, broken, _ = sequence.walks(linked, starts)
    order = nodes.select(F.col("k").alias("conv_id"), F.col("node").alias("leaf"), F.col("i").alias("leaf_i"))
    # the leaves are walked in their order up to the first that is broken
    bad = settled(broken.join(order, ["conv_id", "leaf"]).groupBy("conv_id").agg(F.min("leaf_i").alias("bad_i")))
    unknown = linked.where("NOT known").select("conv_id").distinct()
    told(bad.select("conv_id").unionByName(unknown.join(starts, "conv_id", "left_anti")), "malformed")
    told(unknown.join(starts, "conv_id", "left_semi"), "active_branch_unknown")
    many = starts.groupBy("conv_id").agg(F.count("*").alias("leaves"))
    good = starts.join(order, ["conv_id", "leaf"]).join(many, "conv_id").join(bad, "conv_id", "left").where("bad_i IS NULL OR leaf_i < bad_i")
    first = sequence.first_by(paths.join(good, ["conv_id", "leaf"]), ["conv_id", "node"], ["leaf_i"]).select(F.col("conv_id").alias("k"), "node", "leaf", "leaves")
    own = nodes.join(first, ["k", "node"]).withColumn("session", F.when(F.col("leaves") == 1, F.col("cid")).otherwise(F.concat_ws("/", "cid", F.lit("branch"), "leaf")))
    flat = nodes.where("NOT tree AND NOT known").withColumn("session", F.col("cid"))
    every = own.select("k", "i", "session", "conv_ts", "v").unionByName(flat.select("k", "i", "session", "conv_ts", "v"))
    every = settled(every).where(J.is_object("$.message", "v") & ~J.truthy("$.message.metadata.is_visually_hidden_from_conversation", "v"))
    text = F.expr("array_join(transform(filter(try_variant_get(v, '$.message.content.parts', 'array<variant>'), b -> schema_of_variant(b) = 'STRING'), b -> try_variant_get(b, '$', 'string')), '\\n')")
    ts = F.coalesce(F.nullif(J.seconds("$.message.create_time", "v"), F.lit(0.0)), "conv_ts", F.lit(0.0))
    _messages(parts, cfg, agent, every.select("session", ts.alias("ts"), T.strip(F.coalesce(text, F.lit(""))).alias("text"), J.string("$.message.author.role", "v").alias("role"), J.shown("$.message.metadata.model_slug", "v").alias("model"), _place("k", "i")))


def self_report(cfg: Config) -> tuple[dict | None, str | None]:
    """The report a chat wrote about itself, if it is recent, and an issue if it can't be used."""
    path = f"{cfg.home}/Downloads/chatgpt-self-report.json"
    try:
        if not os.path.exists(path) or os.stat(path).st_mtime < cfg.cut:
            return None, None
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        return (data, None) if isinstance(data, dict) else (None, "invalid_self_report")
    except (OSError, ValueError):
        return None, "invalid_self_report"


def distinct_prompts(parts: Parts, cfg: Config) -> DataFrame:
    """The prompts inside the window with their ids, the first of equal ones."""
    prompts = parts.take("prompts", PROMPT).withColumn("text", T.strip(F.col("text"))).where((F.col("text") != "") & F.col("ts").between(cfg.cut, cfg.now))
    return sequence.first_by(prompts.withColumn("id", T.prompt_id(F.col("agent"), F.col("session"), F.col("ts"), F.col("text"))), ["id"], ["is_automation", "ord"])


def diagnosed(parts: Parts, cfg: Config, prompts: DataFrame, usage: DataFrame) -> DataFrame:
    """A row per requested agent: files, malformed records, usable prompts, usage rows, issues by code and the status: partial
    with any issue or malformed record, else ok with anything read, empty with a source, absent without."""
    notes, issues = parts.notes, parts.take("issues", ISSUE)
    counted = {a: n() if callable(n) else n for a, n in notes["files"].items()}
    files = [(a, *counted.get(a, [0, 0]), a in notes["sources"]) for a in sorted(cfg.sources)]
    asked = parts.spark.createDataFrame(files, "agent string, files_discovered long, files_read long, seen boolean")
    per_code = issues.groupBy("agent", "code").agg(F.count("*").alias("n"))
    by_code = F.map_from_entries(F.collect_list(F.when(F.col("code") != "malformed", F.struct("code", "n"))))
    coded = per_code.groupBy("agent").agg(by_code.alias("issues"), F.sum(F.when(F.col("code") == "malformed", F.col("n")).otherwise(0)).alias("malformed_records"))
    count = lambda df, name: df.groupBy("agent").agg(F.count("*").alias(name))
    d = asked.join(coded, "agent", "left").join(count(prompts.where("NOT is_automation"), "usable_prompts"), "agent", "left").join(count(usage, "usage_rows"), "agent", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("malformed_records", "usable_prompts", "usage_rows")]
    d = d.select("agent", "files_discovered", "files_read", *counts, F.coalesce("issues", F.create_map().cast("map<string,bigint>")).alias("issues"), "seen")
    read = (F.col("usable_prompts") > 0) | (F.col("usage_rows") > 0)
    status = F.when((F.size("issues") > 0) | (F.col("malformed_records") > 0), "partial").when(read, "ok").when(F.col("seen"), "empty").otherwise("absent")
    return d.withColumn("status", status).drop("seen")


def extract(spark: SparkSession, cfg: Config) -> dict:
    """All requested sources as DataFrames prompts, usage, tools, sessions, diagnostics, checks, with notes on the sources."""
    parts = Parts(spark)
    if "claude-code" in cfg.sources:
        claude_code(parts, cfg)
    if "codex" in cfg.sources:
        codex(parts, cfg)
    exports(parts, cfg)
    report, problem = self_report(cfg) if "chatgpt" in cfg.sources else (None, None)
    if problem:
        parts.issue("chatgpt", problem)
    usage, tools, seen, checks = (parts.take(n, s) for n, s in (("usage", USAGE), ("tools", TOOL), ("seen", SEEN), ("checks", CHECK)))
    prompts = distinct_prompts(parts, cfg).persist()
    usage = usage.persist()
    cwds = prompts.select("cwd").union(usage.select("cwd")).union(seen.select("cwd")).union(spark.createDataFrame([("",)], "cwd string"))
    places = settled(folders.places(cwds.select(F.coalesce("cwd", F.lit("")).alias("folder")).distinct(), cfg.home))
    few = places.count() <= 50_000

    def placed(df: DataFrame) -> DataFrame:
        own = F.create_map(*[F.lit(x) for kv in EXPORT_PROJECTS.items() for x in kv])
        out = df.withColumn("folder", F.coalesce("cwd", F.lit(""))).join(F.broadcast(places) if few else places, "folder")
        app = F.try_element_at(own, F.col("agent"))
        return out.withColumn("workspace", F.when(app.isNull(), F.col("workspace"))).withColumn("project", F.coalesce(app, "project")).drop("folder")

    prompts, usage = placed(prompts).drop("ord").withColumn("branch", F.lit(None).cast("string")), placed(usage)
    stays = seen.unionByName(prompts.select("agent", "session", "ts", "cwd", "surface", F.col("is_automation").alias("auto"), F.lit(None).cast(dict(seen.dtypes)["ord"]).alias("ord")))
    first = lambda c: F.min_by(c, F.struct(F.col("ord").isNull(), "ord", "ts"))
    rolled = stays.groupBy("agent", "session").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), first("cwd").alias("cwd"), first("surface").alias("surface"), first("auto").alias("auto"))
    counts = prompts.where("NOT is_automation").groupBy("agent", "session").agg(F.count("*").alias("prompts"))
    sessions = placed(rolled.join(counts, ["agent", "session"], "left").withColumn("prompts", F.coalesce("prompts", F.lit(0))))
    notes, d = parts.notes, diagnosed(parts, cfg, prompts, usage)
    return {"prompts": prompts, "usage": usage, "tools": tools, "sessions": sessions, "diagnostics": d, "checks": checks, "sources": notes["sources"], "provenance": notes["provenance"], "self_report": report}



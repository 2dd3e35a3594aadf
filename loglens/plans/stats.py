"""The statistics report, one DataFrame per figure, over normalized prompts, usage, tools and sessions.

usage and tools carry `ord`, their read order; ties in rankings go to what was read first. Local time is the session's time
zone. Totals leave reasoning tokens out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.functions import redact, text
from loglens.operators import sequence

KINDS = ["fresh_input", "cache_read", "cache_write", "output", "reasoning"]


def human(prompts: DataFrame) -> DataFrame:
    return prompts.where(~F.col("is_automation") & F.col("text").isNotNull() & (F.col("text") != ""))


def tokens() -> Column:
    return F.col("fresh_input") + F.col("cache_read") + F.col("cache_write") + F.col("output")


def local(ts: Column) -> Column:
    return F.timestamp_seconds(ts)


def day(ts: Column) -> Column:
    return F.date_format(local(ts), "yyyy-MM-dd")


def _sum(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def ranked(df: DataFrame, key: Column | str, k: int | None, name: str = "name") -> DataFrame:
    """(name, n): how often each non-NULL key occurs, most often first, ties by the first occurrence; at most k. Rows that
    stand for several (`rows`) count as many times."""
    weight = F.col("rows") if "rows" in df.columns else F.lit(1).cast("long")
    keyed = df.select("ord", (F.col(key) if isinstance(key, str) else key).alias(name), weight.alias("_rows")).where(F.col(name).isNotNull())
    out = keyed.groupBy(name).agg(F.sum("_rows").alias("n"), F.min("ord").alias("_first")).orderBy(F.desc("n"), "_first")
    return (out.limit(k) if k else out).drop("_first")


def usage_hours(usage: DataFrame) -> DataFrame:
    """usage with the rows of one agent, project, model, branch and local hour put together: counts are sums, ts and ord the
    first, `rows` says how many there were. Every figure here is the same over it, so a report reads usage once."""
    hour = F.date_trunc("hour", local(F.col("ts"))).alias("hour")
    firsts = [F.min(c).alias(c) for c in ("ts", "ord")]
    return usage.groupBy("agent", "project", "model", "side", "branch", "estimated", hour).agg(*firsts, *[F.sum(k).alias(k) for k in KINDS], F.count("*").alias("rows")).drop("hour")


def token_types(usage: DataFrame) -> DataFrame:
    return usage.agg(_sum(tokens()).alias("total"), *[_sum(F.col(k)).alias(k) for k in KINDS])


def cache_share(usage: DataFrame) -> DataFrame:
    read, base = _sum(F.col("cache_read")), _sum(F.col("cache_read") + F.col("fresh_input") + F.col("cache_write"))
    return usage.agg(read.alias("cache_read"), base.alias("input"), text.half_even(read / F.greatest(F.lit(1), base), 4).alias("share"))


def agents(prompts: DataFrame, usage: DataFrame) -> DataFrame:
    u = usage.groupBy("agent").agg(_sum(tokens()).alias("tokens"), _sum(F.col("output")).alias("output"), F.bool_or("estimated").alias("estimated"))
    p = human(prompts).groupBy("agent").agg(F.count("*").alias("prompts"), F.count_distinct("session").alias("sessions"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return u.join(p, "agent", "full_outer").select("agent", zero("tokens"), zero("output"), F.coalesce("estimated", F.lit(False)).alias("estimated"), zero("prompts"), zero("sessions"))


def surfaces(prompts: DataFrame) -> DataFrame:
    return human(prompts).groupBy("agent", F.coalesce("surface", F.lit("null")).alias("surface")).agg(F.count("*").alias("n"))


def models(usage: DataFrame) -> DataFrame:
    return usage.where("model IS NOT NULL AND model NOT IN ('', '<synthetic>')").groupBy("model").agg(_sum(tokens()).alias("tokens"), _sum(F.col("output")).alias("output")).orderBy(F.desc("tokens"), "model")


def projects(prompts: DataFrame, usage: DataFrame, k: int = 10) -> DataFrame:
    u = usage.groupBy("project").agg(_sum(tokens()).alias("tokens"), F.min("ord").alias("first"))
    p = human(prompts).groupBy("project").agg(F.count("*").alias("prompts"), F.count_distinct(F.struct("agent", "session")).alias("sessions"))
    both = u.join(p, "project", "full_outer").orderBy(F.desc_nulls_last("tokens"), F.asc_nulls_last("first"), "project").limit(k)
    return both.select("project", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tokens", "prompts", "sessions")])


def prompt_totals(prompts: DataFrame) -> DataFrame:
    """One row (prompts, sessions_driven): prompts that a person typed, and the sessions with one."""
    return human(prompts).agg(F.count("*").alias("prompts"), F.count_distinct(F.struct("agent", "session")).alias("sessions_driven"))


def projects_by_agent(prompts: DataFrame, usage: DataFrame, k: int = 10) -> DataFrame:
    """projects() with by_agent, the tokens of each agent in a project as a map; empty without usage."""
    top = projects(prompts, usage, k)
    own = project_agents(usage).join(F.broadcast(top.select("project")), "project")  # at most k projects
    own = own.groupBy("project").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("agent", "tokens")))).alias("by_agent"))
    none = F.create_map().cast("map<string,bigint>")
    return top.join(own, "project", "left").withColumn("by_agent", F.coalesce("by_agent", none))


def project_agents(usage: DataFrame) -> DataFrame:
    return usage.groupBy("project", "agent").agg(_sum(tokens()).alias("tokens"))


def sessions(prompts: DataFrame) -> DataFrame:
    """(agent, session, project, first, last, prompts) from all prompt rows; automations extend a session, but don't count."""
    return prompts.groupBy("agent", "session").agg(F.min_by("project", F.struct("ts", "id")).alias("project"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.count_if(~F.col("is_automation")).alias("prompts"))


def longest_sessions(rolled: DataFrame, k: int = 3) -> DataFrame:
    hours = ((F.col("last") - F.col("first")) / 3600).alias("hours")
    return rolled.select(hours, "project", "agent", "prompts").orderBy(*[F.desc(c) for c in ("hours", "project", "agent", "prompts")]).limit(k).orderBy("hours", "project", "agent", "prompts")


def output_grid(usage: DataFrame) -> DataFrame:
    return usage.groupBy(F.concat(day(F.col("ts")), F.lit("|"), F.hour(local(F.col("ts")))).alias("hour")).agg(_sum(F.col("output")).alias("output"), F.min("ord").alias("first"))


def prompt_grid(prompts: DataFrame) -> DataFrame:
    return human(prompts).groupBy(F.concat(day(F.col("ts")), F.lit("|"), F.hour(local(F.col("ts")))).alias("hour"), "agent").agg(F.count("*").alias("n"))


def busiest_hour(prompts: DataFrame, usage: DataFrame) -> DataFrame:
    """One row (hour, output, prompts): the hour with the most output, what was read first on ties; none without usage."""
    top = output_grid(usage).orderBy(F.desc("output"), "first").limit(1).drop("first")
    return F.broadcast(top).join(prompt_grid(prompts), "hour", "left").groupBy("hour", "output").agg(_sum(F.col("n")).alias("prompts"))


def weekend(prompts: DataFrame) -> DataFrame:
    return human(prompts).agg(F.count_if(F.weekday(local(F.col("ts"))) >= 5).alias("weekend_prompts"))


def latest_prompt(prompts: DataFrame) -> DataFrame:
    """The prompt closest before five in the morning, by the hour; the earliest of equal ones."""
    late = F.pmod(F.hour(local(F.col("ts"))) - 5, F.lit(24))
    return human(prompts).agg(F.min_by(F.struct("id", "ts"), F.struct(-late, "ts", "id")).alias("p")).select("p.id", "p.ts")


def per_day(prompts: DataFrame) -> DataFrame:
    return human(prompts).groupBy(F.date_format(local(F.col("ts")), "EEE yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def words(prompts: DataFrame, usage: DataFrame) -> DataFrame:
    p = human(prompts).agg(_sum(text.word_count(F.col("text"))).alias("words_typed"))
    u = usage.agg(_sum(F.col("output")).alias("o"))
    back = F.col("o") * 0.75
    return p.join(F.broadcast(u)).select("words_typed", text.half_even(back, 0).cast("long").alias("words_back"), text.half_even(back / F.greatest(F.lit(1), F.col("words_typed")), 0).cast("long").alias("leverage"))


def voice(prompts: DataFrame) -> DataFrame:
    t = F.col("text")
    count = lambda c: F.count_if(c)
    return human(prompts).groupBy("agent").agg(
        F.count("*").alias("n"), count(F.contains(t, F.lit("?"))).alias("questions"), F.median(text.word_count(t)).alias("median_words"),
        count(text.matches(t, text.PLEASE)).alias("please"), count(text.matches(F.lower(t), text.OK_OPEN, "")).alias("ok_open"), count(text.caps_run(t)).alias("caps_sentences"),
    )


def manners(prompts: DataFrame) -> DataFrame:
    t = F.col("text")
    return human(prompts).agg(F.count_if(text.matches(t, text.THANKS)).alias("thanks"), F.coalesce(F.sum(F.regexp_count(t, F.lit(f"(?dUi){text.PLEASE}"))), F.lit(0)).cast("long").alias("please_total"))


def repeats(prompts: DataFrame, k: int = 5, least: int = 20) -> DataFrame:
    """The texts sent most often, of the first k those sent at least twice: first wording, redacted, then cut."""
    long = human(prompts).where(F.length("text") >= least).withColumn("key", text.norm_spaces(F.col("text")))
    top = long.groupBy("key").agg(F.count("*").alias("times"), F.min(F.struct("ts", "id")).alias("first"), F.min_by("text", F.struct("ts", "id")).alias("text"), F.array_join(F.array_sort(F.collect_set("agent")), ",").alias("agents"))
    return top.orderBy(F.desc("times"), "first").limit(k).where("times >= 2").select(F.substring(redact.scrub(F.col("text")), 1, 200).alias("text"), "times", "agents")


def first_words(prompts: DataFrame, k: int = 10) -> DataFrame:
    word = F.get(text.words(redact.scrub(F.col("text"))), F.lit(0))
    got = human(prompts).select("ts", "id", word.alias("w")).where(" AND ".join(f"NOT contains(w, '{m}')" for m in redact.MARKERS))
    got = got.withColumn("word", F.regexp_replace(F.lower("w"), "[^a-z']", "")).where("word <> ''")
    return got.groupBy("word").agg(F.count("*").alias("n"), F.min(F.struct("ts", "id")).alias("first")).orderBy(F.desc("n"), "first").limit(k).select("word", "n")


def side_share(usage: DataFrame) -> DataFrame:
    side, total = _sum(F.when(F.col("side"), tokens())), _sum(tokens())
    return usage.agg(side.alias("side"), total.alias("total"), text.half_even(side / F.greatest(F.lit(1), total), 4).alias("share"))


def top_tools(tools: DataFrame, k: int = 12) -> DataFrame:
    return ranked(tools, "name", k)


def mcp_servers(tools: DataFrame, k: int = 8) -> DataFrame:
    parts = F.split("name", "__")
    return ranked(tools, F.when(F.startswith("name", F.lit("mcp__")) & (F.size(parts) >= 3), F.get(parts, F.lit(1))), k)


def skills(tools: DataFrame, k: int = 8) -> DataFrame:
    return ranked(tools, F.nullif(F.col("skill"), F.lit("")), k)


def edited_files(tools: DataFrame, k: int = 5) -> DataFrame:
    return ranked(tools, F.when(F.col("name").isin("Edit", "Write", "MultiEdit") & (F.col("file_path") != ""), F.substring_index("file_path", "/", -1)), k)


def branches(usage: DataFrame, k: int = 8) -> DataFrame:
    return ranked(usage, F.when(~F.col("branch").isin("", "HEAD", "main", "master"), F.col("branch")), k)


def redactions(prompts: DataFrame, home: str | None = None) -> DataFrame:
    """(kind, n): stretches that each rule changes, counted once per prompt."""
    counted = redact.counts(F.col("text"), home)
    sums = human(prompts).agg(*[_sum(c).alias(k) for k, c in counted.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in counted])).alias("x")).select("x.kind", "x.n").where("n > 0")


def digest(prompts: DataFrame, home: str | None = None) -> DataFrame:
    """(ts, id, line): a redacted line per prompt, redacted before it is cut."""
    safe = F.replace(F.substring(redact.scrub(F.col("text"), home), 1, 400), F.lit("\n"), F.lit(" / "))
    head = F.concat(F.lit("["), F.col("id"), F.lit("] "), F.date_format(local(F.col("ts")), "EEE MM-dd HH:mm"))
    return human(prompts).select("ts", "id", F.concat_ws(" | ", head, redact.scrub(F.col("agent"), home), redact.scrub(F.col("project"), home), F.concat(text.word_count(F.col("text")), F.lit("w")), safe).alias("line"))


handoffs, longest_streak = sequence.handoffs, sequence.longest_streak

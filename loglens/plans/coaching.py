"""Coaching signals: how the next message reacts to each prompt, and what goes along with good reactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.functions import redact, text
from loglens.operators import sequence
from loglens.plans.stats import human

STRONG_N, STRONG_LIFT, EARLY_N = 20, 0.15, 8


def classified(prompts: DataFrame) -> DataFrame:
    t = F.col("text")
    return human(prompts).select("id", "agent", "session", "ts", "text", text.word_count(t).alias("words"), text.norm_words(t).alias("norm"), text.reaction(t).alias("reaction"), text.features(t).alias("features"))


def rows(prompts: DataFrame) -> DataFrame:
    """One row per prompt with its features, next_id, next_reaction and correction_chain."""
    own = classified(prompts)
    return sequence.cross_session_retry(sequence.correction_chain(sequence.with_next(own)))


def reactions(prompts: DataFrame) -> DataFrame:
    """The rows without correction chains, which need one shuffle less."""
    return sequence.cross_session_retry(sequence.with_next(classified(prompts)))


def judged(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("next_reaction").isin(text.JUDGED)).withColumn("good", F.col("next_reaction").isin(text.GOOD))


def reaction_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("next_reaction").agg(F.count("*").alias("n"))


def smooth_rate(rows: DataFrame, *keys: str) -> DataFrame:
    return judged(rows).groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("good").alias("good"), text.half_even(F.count_if("good") / F.count("*"), 3).alias("smooth_rate"))


def overall(rows: DataFrame) -> DataFrame:
    """One row (prompts, judged, good, smooth_rate, infra, infra_share); the rate is NULL where nothing was judged."""
    good, judged_ = F.count_if(F.col("next_reaction").isin(text.GOOD)), F.count_if(F.col("next_reaction").isin(text.JUDGED))
    infra, n = F.count_if(F.col("next_reaction") == "infra"), F.count("*")
    rate = F.when(judged_ > 0, text.half_even(good / judged_, 3)).alias("smooth_rate")
    share = text.half_even(infra / F.greatest(F.lit(1), n), 3).alias("infra_share")
    return rows.agg(n.alias("prompts"), judged_.alias("judged"), good.alias("good"), rate, infra.alias("infra"), share)


#: Counts of a feature: judged and good prompts with and without it, all with it; and the sessions of the judged ones.
_COUNTS, _SESSIONS = ("wn", "wg", "on", "og", "has"), ("ws", "os")


def lift_counts(rows: DataFrame) -> DataFrame:
    """(feature, agent, wn, wg, on, og, has, n, ws, os), which both lift reports are made from.

    A prompt stays one row: every feature has its own columns, summed per session, then per agent, where a session counts
    once. So nothing is multiplied by the number of features, and only sums are shuffled.
    """
    judged_, good = F.col("next_reaction").isin(text.JUDGED), F.col("next_reaction").isin(text.GOOD)

    def flags(name: str) -> dict:
        has = F.array_contains("features", name)
        return {"wn": judged_ & has, "wg": judged_ & has & good, "on": judged_ & ~has, "og": judged_ & ~has & good, "has": has}

    per_session = rows.groupBy("agent", "session").agg(F.count("*").alias("n"), *[F.count_if(c).alias(f"{k}_{name}") for name in text.FEATURES for k, c in flags(name).items()])
    sums = [F.sum(f"{k}_{name}").alias(f"{k}_{name}") for name in text.FEATURES for k in _COUNTS]
    sums += [F.count_if(F.col(f"{side}_{name}") > 0).alias(f"{k}_{name}") for name in text.FEATURES for k, side in zip(_SESSIONS, ("wn", "on"), strict=True)]
    per_agent = per_session.groupBy("agent").agg(F.sum("n").alias("n"), *sums)
    each = F.array(*[F.struct(F.lit(name).alias("feature"), *[F.col(f"{k}_{name}").alias(k) for k in (*_COUNTS, *_SESSIONS)]) for name in text.FEATURES])
    return per_agent.select("agent", "n", F.inline(each))


def feature_lift(rows: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(feature, with_*, without_*, lift, consistent, confidence, usage_share) from lift_counts(rows)."""
    own = lift_counts(rows) if counts is None else counts
    rate = lambda g, n: F.when(n > 0, text.half_even(g / n, 3))
    own = own.withColumn("lift", text.half_even(rate(F.col("wg"), F.col("wn")) - rate(F.col("og"), F.col("on")), 3))
    every = own.groupBy("feature").agg(*[F.sum(c).cast("long").alias(c) for c in ("wn", "wg", "on", "og", "n", "has", "ws", "os")], F.collect_list(F.when(F.least("wn", "on") >= EARLY_N, F.col("lift"))).alias("strata"))
    every = every.withColumn("with_rate", rate(F.col("wg"), F.col("wn"))).withColumn("without_rate", rate(F.col("og"), F.col("on")))
    every = every.withColumn("lift", text.half_even(F.col("with_rate") - F.col("without_rate"), 3)).withColumn("consistent", F.forall("strata", lambda s: s * F.coalesce("lift", F.lit(0.0)) >= 0))
    least = F.least("wn", "on")
    label = F.when(least == 0, "insufficient comparison").when((least >= STRONG_N) & (F.abs("lift") >= STRONG_LIFT) & F.col("consistent"), "strong signal").when(least >= EARLY_N, "early signal").otherwise(F.concat(F.lit("small sample · "), least))
    return every.select("feature", F.col("wn").alias("with_n"), F.col("wg").alias("with_successes"), "with_rate", F.col("on").alias("without_n"), F.col("og").alias("without_successes"), "without_rate", "lift", label.alias("confidence"), F.col("ws").alias("with_sessions"), F.col("os").alias("without_sessions"), text.half_even(F.col("has") / F.greatest(F.lit(1), F.col("n")), 3).alias("usage_share"))


def feature_lift_by_agent(rows: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(feature, agent, with_*, without_*) from lift_counts(rows), where anything was judged."""
    own = lift_counts(rows) if counts is None else counts
    return own.where(F.col("wn") + F.col("on") > 0).select("feature", "agent", F.col("wn").alias("with_n"), F.col("wg").alias("with_successes"), F.col("on").alias("without_n"), F.col("og").alias("without_successes"))


def resent(rows: DataFrame) -> DataFrame:
    r = rows.where("next_reaction = 'retry'")
    return r.agg(F.count("*").alias("prompts_resent"), F.count_distinct("norm").alias("distinct_texts"))


def reminders(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(text.is_reminder(F.col("text"))).alias("reminders"))


def checkins(rows: DataFrame) -> DataFrame:
    c = judged(rows).where(text.is_checkin(F.col("text")))
    return c.agg(F.count("*").alias("n"), F.count_if("good").alias("good"))


def candidates(rows: DataFrame) -> DataFrame:
    """(list, rank, id, chain): prompts to look at, each list in time order, correction loops by length."""
    parts = [
        ("praised", rows.where("next_reaction = 'praise'").orderBy("ts", "id").limit(40)),
        ("smooth_long_briefs", rows.where("next_reaction = 'proceed' AND words >= 25").orderBy("ts", "id").limit(40)),
        ("correction_loops", rows.where("correction_chain >= 2").orderBy(F.desc("correction_chain"), "ts", "id").limit(25)),
        ("retries", rows.where("next_reaction = 'retry'").orderBy("ts", "id").limit(25)),
    ]
    out = None
    for name, df in parts:
        own = df.select(F.lit(name).alias("list"), "id", F.when(F.lit(name) == "correction_loops", F.col("correction_chain")).alias("chain"))
        out = own if out is None else out.unionByName(own)
    return out


def redacted(rows: DataFrame, home: str | None = None) -> DataFrame:
    """Rows as they leave the engine: texts redacted, the next text cut after that."""
    nxt = rows.select(F.col("id").alias("next_id"), F.substring(redact.scrub(F.col("text"), home), 1, 400).alias("next_text"))
    return rows.withColumn("text", redact.scrub(F.col("text"), home)).join(nxt, "next_id", "left").drop("norm", "reaction")

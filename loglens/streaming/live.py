"""Streaming forms of the order-sensitive operators, for logs that arrive as they are written."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loglens.functions import text


def deduplicated(rows: DataFrame, keys: list[str], time: str = "at", delay: str = "1 hour") -> DataFrame:
    """The first row of each key that arrives within the delay; state older than that is dropped."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def tokens_per_hour(usage: DataFrame, time: str = "at", delay: str = "1 hour") -> DataFrame:
    """(start, agent, tokens) per hour; late rows within the delay still count."""
    total = F.col("fresh_input") + F.col("cache_read") + F.col("cache_write") + F.col("output")
    hours = usage.withWatermark(time, delay).groupBy(F.window(time, "1 hour").alias("w"), "agent").agg(F.sum(total).cast("long").alias("tokens"))
    return hours.select(F.col("w.start").alias("start"), "agent", "tokens")


def next_reactions(prompts: DataFrame, time: str = "at", delay: str = "1 day") -> DataFrame:
    """(agent, session, id, next_reaction) as soon as the next prompt of the session arrives; `end` once the session has been
    silent for the delay. prompts: id, agent, session, text and an event time; a session keeps one row of state."""
    own = prompts.withWatermark(time, delay).select("agent", "session", "id", F.col(time).alias("at"), text.norm_words(F.col("text")).alias("norm"), text.reaction(F.col("text")).alias("reaction"))
    wait_ms = int(pd.Timedelta(delay).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        agent, session = key
        if state.hasTimedOut:
            last_id = state.get[0]
            state.remove()
            yield pd.DataFrame([(agent, session, last_id, "end")], columns=["agent", "session", "id", "next_reaction"])
            return
        rows = pd.concat(list(batches)).sort_values(["at", "id"])
        last = tuple(state.get) if state.exists else None
        out = []
        for r in rows.itertuples():
            if last:
                out.append((agent, session, last[0], "retry" if last[1] == r.norm else r.reaction))
            last = (r.id, r.norm)
        state.update(last)
        state.setTimeoutTimestamp(max(int(rows["at"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + wait_ms)
        yield pd.DataFrame(out, columns=["agent", "session", "id", "next_reaction"])

    return own.groupBy("agent", "session").applyInPandasWithState(step, "agent string, session string, id string, next_reaction string", "id string, norm string", "append", GroupStateTimeout.EventTimeTimeout)


DAY_MS = 86_400_000
#: Stores of transformWithState; to be set before the query starts.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Retries(StatefulProcessor):
    """The rows of one text within a day: each is told once, as soon as another session has sent the same text less than a day
    after it. Rows may come in any order within the watermark's delay. A timer, a day after the oldest row, drops what neither
    waits any longer nor can answer a late row."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "id string, agent string, session string, ms long, told boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        held = [tuple(r) for r in self.rows.get()]
        for frame in rows:
            held += [(r.id, r.agent, r.session, int(r.at.timestamp() * 1000), False) for r in frame.itertuples()]
        held.sort(key=lambda r: (r[3], r[0]))
        other, kept, told = None, [], []  # other: the nearest later row of another session than the one last seen
        following = None
        for row in reversed(held):
            if following is not None and following[1:3] != row[1:3]:
                other = following
            again = not row[4] and other is not None and other[3] - row[3] < DAY_MS
            if again:
                told.append((row[0], other[0]))
            kept.append((*row[:4], row[4] or again))
            following = row
        self.keep(kept[::-1], timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame(told, columns=["id", "again_id"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        self.keep([tuple(r) for r in self.rows.get()], timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame([], columns=["id", "again_id"])

    def keep(self, rows: list[tuple], watermark: int) -> None:
        rows = [r for r in rows if r[3] + DAY_MS > watermark]
        if not rows:
            self.rows.clear()
            return
        self.rows.put(rows)
        self.handle.registerTimer(rows[0][3] + DAY_MS)


def retries(prompts: DataFrame, time: str = "at", delay: str = "1 hour", least: int = 20) -> DataFrame:
    """(id, again_id): prompts whose text, of at least `least` characters, another session sends again within a day, and who
    does so first among those that have arrived. prompts: id, agent, session, text and an event time; rows of one time stand
    in the order of id. State is a row per prompt of the last day. Needs STATE_STORE."""
    own = prompts.withWatermark(time, delay).where(F.length("text") >= least)
    own = own.select("id", "agent", "session", F.col(time).alias("at"), text.norm_words(F.col("text")).alias("norm"))
    return own.groupBy("norm").transformWithStateInPandas(Retries(), "id string, again_id string", "Append", "EventTime")

"""Order-sensitive operators: deduplication, as-of joins, islands, counters, reactions, chains and retries.

All of them are windows with running frames, so a partition is read once in order and spills instead of being collected.
Where one key may hold a large share of the rows, or there is no key at all, rows are first dealt by time, and only the
edges of the buckets are put together afterwards.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglens.operators import settled

DAY = 86400


def first_by(df: DataFrame, keys: list[str], order: list[Column | str], hashed: bool = False) -> DataFrame:
    """The first row of each key in the given order. Spark keeps one row per key and task before the shuffle. hashed: rows are
    sorted by a hash of the keys ahead of the keys, so that long keys are compared only where they are equal."""
    w = Window.partitionBy(*([F.xxhash64(*keys)] if hashed else []), *keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def carried(value: Column, keys: list[str], order: list[Column | str], strict: bool = False) -> Column:
    """The last non-NULL value at or (strict) before each row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if strict else 0))


def following(value: Column, keys: list[str], order: list[Column]) -> Column:
    """The first non-NULL value strictly after each row; order is given descending, so that the frame runs."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))


def asof(left: DataFrame, right: DataFrame, keys: list[str], ts: str, value: str, default: Column | None = None) -> DataFrame:
    """left with value: that of the last right row of the same keys with ts at or before its own (the later of equal ones by
    `ord`, if right has it). No join: both sides are read once in time order."""
    columns = left.columns
    order = F.col("ord") if "ord" in right.columns else F.lit(0)
    sides = left.select(*columns, F.lit(1).alias("_side"), F.lit(0).alias("_ord"), F.lit(None).cast(dict(right.dtypes)[value]).alias("_value"), F.lit(False).alias("_set"))
    other = right.select(*[F.col(c) if c in (*keys, ts) else F.lit(None).cast(dict(left.dtypes)[c]).alias(c) for c in columns], F.lit(0).alias("_side"), order.cast("int").alias("_ord"), F.col(value).alias("_value"), F.lit(True).alias("_set"))
    both = sides.unionByName(other).withColumn("_last", carried(F.when(F.col("_set"), F.struct("_value")), keys, [ts, "_side", "_ord"]))
    got = F.col("_last._value") if default is None else F.when(F.col("_last").isNull(), default).otherwise(F.col("_last._value"))
    return both.where("_side = 1").select(*columns, got.alias(value))


def with_next(rows: DataFrame) -> DataFrame:
    """rows (id, agent, session, ts, norm, reaction, ...) with next_id and next_reaction: end without a next message, retry if
    it says the same, else the class of the next one."""
    w = Window.partitionBy("agent", "session").orderBy("ts", "id")
    out = rows.withColumn("next_id", F.lead("id").over(w)).withColumn("_n", F.lead("norm").over(w)).withColumn("_r", F.lead("reaction").over(w))
    return out.withColumn("next_reaction", F.when(F.col("next_id").isNull(), "end").when(F.col("_n") == F.col("norm"), "retry").otherwise(F.col("_r"))).drop("_n", "_r")


def correction_chain(rows: DataFrame) -> DataFrame:
    """rows (id, agent, session, ts, norm, reaction, ...) with correction_chain.

    From the message after each one, while messages correct, are infra or repeat it, those that correct or repeat it count.
    The end of that run is found with running windows; the repeats inside it with one more over rows and run ends together,
    so neither long runs nor texts sent thousands of times cost more than a sort.
    """
    key = ["agent", "session"]
    r = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*key).orderBy("ts", "id")))
    r = r.withColumn("_cum", F.sum((F.col("reaction") == "correct").cast("long")).over(Window.partitionBy(*key).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)))
    boundary = ~F.col("reaction").isin("correct", "infra")
    down = [F.col("_i").desc()]
    # the next boundary after each row, and after each boundary the first one whose text differs
    r = r.withColumn("_nb", following(F.when(boundary, F.struct("_i", "norm")), key, down))
    starts = F.when(boundary & F.col("_nb").isNotNull() & (F.col("_nb.norm") != F.col("norm")), F.col("_nb._i"))
    r = r.withColumn("_turn", starts)
    at_or_after = F.last("_turn", ignorenulls=True).over(Window.partitionBy(*key).orderBy(*down).rowsBetween(Window.unboundedPreceding, 0))
    r = r.withColumn("_run_end", F.when(boundary, at_or_after))
    r = r.withColumn("_nb2", following(F.when(boundary, F.struct("_i", "norm", "_run_end")), key, down))
    r = r.withColumn("_n", F.count("*").over(Window.partitionBy(*key)))
    past = F.col("_n") + 1
    r = r.withColumn("_end", F.when(F.col("_nb2").isNull(), past).when(F.col("_nb2.norm") == F.col("norm"), F.coalesce("_nb2._run_end", past)).otherwise(F.col("_nb2._i")))
    ends = r.select(*key, F.col("_i").alias("_at"), F.col("_cum").alias("_cum_end"))
    same = Window.partitionBy(*key, "norm").orderBy("_pos", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    marks = r.select(*key, "norm", "id", F.col("_i").alias("_pos"), F.lit(1).alias("_kind"), (F.col("reaction") != "correct").cast("long").alias("_m"))
    asked = r.select(*key, "norm", "id", F.col("_end").alias("_pos"), F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_m"))
    seen = marks.unionByName(asked).withColumn("_c", F.sum("_m").over(same)).groupBy(*key, "id").agg(F.max(F.when(F.col("_kind") == 0, F.col("_c"))).alias("_before_end"), F.max(F.when(F.col("_kind") == 1, F.col("_c"))).alias("_upto"))
    r = r.withColumn("_at", F.col("_end") - 1).join(ends, [*key, "_at"]).join(seen, [*key, "id"])
    chain = F.col("_cum_end") - F.col("_cum") + F.col("_before_end") - F.col("_upto")
    return r.select(*rows.columns, chain.cast("long").alias("correction_chain"))


def cross_session_retry(rows: DataFrame, least: int = 20, within: int = DAY) -> DataFrame:
    """rows (id, agent, session, ts, text, norm, next_reaction, ...): an ask without a judgement becomes a retry if another
    session sends the same text later within the time.

    The first later row of another session is the first row of the next run of equal sessions. Texts are dealt by time
    bucket, each with the next bucket's rows as followers, so a text that everybody sends is no single group.
    """
    long = rows.where(F.length("text") >= least).select("id", "agent", "session", "ts", "norm")
    bucket = F.floor(F.col("ts") / within)
    spread = long.withColumn("_own", bucket).select("*", F.explode(F.array(F.col("_own"), F.col("_own") - 1)).alias("_b"))
    w = Window.partitionBy("norm", "_b")
    spread = spread.withColumn("_prev", F.lag(F.struct("agent", "session")).over(w.orderBy("ts", "id")))
    turn = F.col("_prev").isNull() | (F.col("_prev") != F.struct("agent", "session"))
    spread = spread.withColumn("_start", F.when(turn, F.col("ts")))
    spread = spread.withColumn("_next", F.last("_start", ignorenulls=True).over(w.orderBy(F.col("ts").desc(), F.col("id").desc()).rowsBetween(Window.unboundedPreceding, -1)))
    again = spread.where((F.col("_own") == F.col("_b")) & (F.col("_next") - F.col("ts") < within)).select("id").distinct().withColumn("_again", F.lit(True))
    out = rows.join(again, "id", "left")
    new = F.when(F.col("_again") & F.col("next_reaction").isin("end", "new-ask", "infra"), "retry").otherwise(F.col("next_reaction"))
    return out.withColumn("next_reaction", new).select(*rows.columns)


def counter_deltas(counters: DataFrame, cut: float, now: float, fields: list[str]) -> DataFrame:
    """counters (session, ts, ord, valid, FIELDS, last_FIELDS or NULL, has_last) -> per in-window row its delta and issue.

    Cumulative counters are compared with the previous valid one of the session, which may lie before the window. Without
    one, the last response stands in. A field that falls is a reset and gives no delta.
    """
    w = Window.partitionBy("session").orderBy("ts", "ord")
    c = counters.where("valid").withColumn("_prev", F.lag(F.struct(*fields)).over(w))
    inside = F.col("ts").between(cut, now)
    diff = {f: F.col(f) - F.col(f"_prev.{f}") for f in fields}
    reset = F.col("_prev").isNotNull() & F.lit(False)
    for f in fields:
        reset = reset | (F.col("_prev").isNotNull() & (diff[f] < 0))
    partial = F.lit(False)
    for f in fields:
        partial = partial | (F.col(f) != F.coalesce(f"last_{f}", F.lit(0)))
    first = F.col("_prev").isNull()
    issue = F.when(reset, "token_counter_reset").when(first & ~F.col("has_last"), "missing_counter_baseline").when(first & partial, "partial_counter_baseline")
    c = c.where(inside).withColumn("issue", issue)
    for f in fields:
        c = c.withColumn(f"d_{f}", F.when(F.col("_prev").isNotNull() & (F.col("issue").isNull() | (F.col("issue") != "token_counter_reset")), diff[f]).when(first & F.col("has_last"), F.coalesce(f"last_{f}", F.lit(0))))
    return c.drop("_prev")


def handoffs(rows: DataFrame, bucket: int = 3600) -> DataFrame:
    """rows (ts, id, agent) -> one row (handoffs): how often the agent changes in (ts, id) order over all rows.

    Changes inside a time bucket are counted there; only first and last agent of each bucket are looked at together.
    """
    b = rows.select("ts", "id", "agent", F.floor(F.col("ts") / bucket).alias("b"))
    w = Window.partitionBy("b").orderBy("ts", "id")
    inner = b.withColumn("_p", F.lag("agent").over(w)).groupBy("b").agg(F.sum((F.col("_p") != F.col("agent")).cast("long")).alias("n"), F.min_by("agent", F.struct("ts", "id")).alias("first"), F.max_by("agent", F.struct("ts", "id")).alias("last"))
    edges = inner.withColumn("_l", F.lag("last").over(Window.orderBy("b")))
    return edges.agg(F.coalesce(F.sum(F.coalesce("n", F.lit(0)) + F.coalesce((F.col("_l") != F.col("first")).cast("long"), F.lit(0))), F.lit(0)).cast("long").alias("handoffs"))


def longest_streak(rows: DataFrame, bucket: int = 3600) -> DataFrame:
    """rows (ts, id, agent) -> one row (prompts, agent) with the longest run of one agent, the earliest of equal ones; (0, NULL)
    without rows. Runs are found per time bucket; only each bucket's first and last run are joined across buckets."""
    b = rows.select("ts", "id", "agent", F.floor(F.col("ts") / bucket).alias("b"))
    w = Window.partitionBy("b").orderBy("ts", "id")
    b = b.withColumn("_p", F.lag("agent").over(w)).withColumn("_run", F.sum(F.when(F.col("_p") == F.col("agent"), 0).otherwise(1)).over(w))
    runs = b.groupBy("b", "_run", "agent").agg(F.count("*").alias("n"), F.min(F.struct("ts", "id")).alias("start"))
    ends = Window.partitionBy("b")
    runs = runs.withColumn("_edge", (F.col("_run") == 1) | (F.col("_run") == F.max("_run").over(ends)))
    edge = runs.where("_edge")
    g = Window.orderBy("b", "_run")
    edge = edge.withColumn("_pa", F.lag("agent").over(g)).withColumn("_pb", F.lag("b").over(g)).withColumn("_join", (F.col("_pa") == F.col("agent")) & (F.col("_pb") != F.col("b")))
    edge = edge.withColumn("_isle", F.sum(F.when(F.col("_join"), 0).otherwise(1)).over(g)).groupBy("_isle", "agent").agg(F.sum("n").alias("n"), F.min("start").alias("start"))
    every = runs.where(~F.col("_edge")).select("n", "start", "agent").unionByName(edge.select("n", "start", "agent"))
    best = every.agg(F.max(F.struct("n", (-F.col("start.ts")).alias("t"))).alias("top")).join(every, (F.col("n") == F.col("top.n")) & (-F.col("start.ts") == F.col("top.t")), "left")
    return best.groupBy(F.coalesce("top.n", F.lit(0)).cast("long").alias("prompts")).agg(F.min_by("agent", "start").alias("agent"))


class _Walk:
    """Rows of one key in time order: right rows that are free, and left rows that are not decided yet. A left row is decided
    once a row comes that lies more than `within` after it; right rows that lie more than that before it are forgotten. So
    only rows of about twice that time are held."""

    def __init__(self, within: float) -> None:
        self.within, self.waiting = within, deque()
        self.times, self.ids, self.start = [], [], 0

    def add(self, ts: float, left: bool, row: object) -> Iterator[tuple]:
        yield from self.decide(ts)
        if left:
            self.waiting.append((ts, row))
        else:
            self.times.append(ts)
            self.ids.append(row)

    def decide(self, upto: float) -> Iterator[tuple]:
        """(left, right) of the waiting rows that no row from `upto` on can match."""
        while self.waiting and upto - self.waiting[0][0] > self.within:
            ts, row = self.waiting.popleft()
            found = self.nearest(ts)
            if found is not None:
                yield row, self.take(found)

    def nearest(self, ts: float) -> int | None:
        times = self.times
        while self.start < len(times) and ts - times[self.start] > self.within:
            self.start += 1
        after, best = bisect_left(times, ts, self.start), None
        if after < len(times) and times[after] - ts <= self.within:
            best = after
        if after > self.start:
            before = bisect_left(times, times[after - 1], self.start)  # the first of equal times
            if best is None or ts - times[before] <= times[best] - ts:
                best = before
        return best

    def take(self, k: int) -> object:
        row = self.ids[k]
        if k == self.start:
            self.start += 1
        else:
            del self.times[k], self.ids[k]
        if self.start > 1024 and 2 * self.start > len(self.times):
            del self.times[: self.start], self.ids[: self.start]
            self.start = 0
        return row


def greedy_matches(left: DataFrame, right: DataFrame, keys: list[str], within: float) -> DataFrame:
    """left (keys, id, ts), right (keys, id, ts) -> (keys, left_id, right_id): each left row in the order of (ts, id) takes the
    nearest right row of its keys that is still free, if within the time; the first by (ts, id) of equally near ones.

    Both sides are dealt by their keys, sorted by Spark and merged in one pass, which holds rows of a short time only, however
    many rows a key has. Rows without a time match nothing.
    """
    both = left.select(*keys, "id", "ts", F.lit(True).alias("left")).unionByName(right.select(*keys, "id", "ts", F.lit(False).alias("left"))).where("ts IS NOT NULL")
    kinds = dict(both.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, walk, schema = None, None, None
        for batch in batches:
            schema = schema or pa.schema([*(batch.schema.field(k) for k in keys), *(pa.field(n, batch.schema.field("id").type) for n in ("left_id", "right_id"))])
            found = []
            for *key, row, ts, is_left in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if walk is None or key != now:
                    if walk is not None:
                        found += [(*now, *m) for m in walk.decide(float("inf"))]
                    now, walk = key, _Walk(within)
                found += [(*now, *m) for m in walk.add(ts, is_left, row)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)
        if walk is not None and (found := [(*now, *m) for m in walk.decide(float("inf"))]):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    ordered = both.repartition(*keys).sortWithinPartitions(*keys, "ts", "id").select(*keys, "id", F.col("ts").cast("double").alias("ts"), "left")
    return ordered.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", left_id {kinds['id']}, right_id {kinds['id']}")


def walks(nodes: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes (conv_id, node, parent), starts (conv_id, leaf) -> paths (conv_id, leaf, node, depth): every node on the way from
    each start to its root; the starts (conv_id, leaf) whose way meets a parent that is missing, or runs into a cycle; and all
    nodes (conv_id, node) that lead into a cycle.

    Every node keeps one pointer, to its 2**k-th ancestor; each round lengthens all paths by that distance and doubles the
    pointers. So a path of n nodes takes log2(n) rounds, and nothing is made that is not in the result but a row per node.
    """
    tree = settled(nodes.select("conv_id", "node", "parent"))
    most = tree.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    inner = tree.where(F.col("parent").isNotNull())
    dangling = settled(inner.join(tree.select("conv_id", F.col("node").alias("parent")), ["conv_id", "parent"], "left_anti").select("conv_id", "node"))
    starts = settled(starts.select("conv_id", "leaf").distinct())
    paths = starts.select("conv_id", "leaf", F.col("leaf").alias("node"), F.lit(0).alias("depth"))
    pointer, walked = settled(inner.join(dangling, ["conv_id", "node"], "left_anti").select("conv_id", "node", F.col("parent").alias("above"))), 1
    while walked < most and not pointer.isEmpty():
        further = paths.join(pointer, ["conv_id", "node"]).select("conv_id", "leaf", F.col("above").alias("node"), (F.col("depth") + walked).alias("depth"))
        paths = settled(paths.unionByName(further))
        hop = pointer.select("conv_id", F.col("node").alias("above"), F.col("above").alias("top"))
        pointer, walked = settled(pointer.join(hop, ["conv_id", "above"]).select("conv_id", "node", F.col("top").alias("above"))), 2 * walked
    # a pointer that is left is longer than any path, so it goes round a cycle; one of a single node was never doubled
    looping = pointer if walked >= most else pointer.limit(0)
    looping = settled(looping.select("conv_id", "node"))
    broken = paths.join(dangling, ["conv_id", "node"]).select("conv_id", "leaf").unionByName(starts.join(looping.withColumnRenamed("node", "leaf"), ["conv_id", "leaf"]))
    return paths, settled(broken.distinct()), looping


def leaves(nodes: DataFrame) -> DataFrame:
    """nodes (conv_id, node, parent) -> (conv_id, leaf): those that are nobody's parent."""
    inner = nodes.select("conv_id", F.col("parent").alias("leaf"))
    return nodes.select("conv_id", F.col("node").alias("leaf")).join(inner, ["conv_id", "leaf"], "left_anti")


def branch_paths(nodes: DataFrame) -> DataFrame:
    """nodes (conv_id, node, parent, ...) -> (conv_id, leaf, node, depth): every node on the way from each leaf to its root.
    Conversations with a cycle or a parent that is missing are left out."""
    paths, broken, looping = walks(nodes, leaves(nodes))
    bad = broken.select("conv_id").unionByName(looping.select("conv_id")).distinct()
    return settled(paths.join(bad, "conv_id", "left_anti"))

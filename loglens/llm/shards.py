"""Sharding by a k-d tree: documents are split at weighted medians until each leaf holds a shard's bytes.

A document's place has three metadata dimensions: language, source (strings stand where a hash puts them) and the logarithm
of its size. Copies of a text take the metadata of the copy with the smallest doc_id, so they stand at one place. A node is
split along the dimension in which its documents spread most, relative to the whole table, and rows are ordered by
(value, hash of the text, row number), which is unique; the cut falls where the bytes before it are nearest to the share of
the left child's shards.

The weighted median is found by radix: bytes per 12-bit digit of the key, then per digit inside the bucket that holds the
median, until a bucket's edge is within `tolerance` of a shard's bytes. So a group of copies is cut only where keeping it
whole would put the cut further off. All nodes of a level are looked for in the same job; histograms combine map-side and
each node's bucket is chosen in Spark, so the driver sees a row per node. Cuts are a row per node as well, hence broadcast;
`MAX_SHARDS` bounds them. Rows are never moved: a row's node follows from its keys by one broadcast join a level.

Law: `bytes`. Shards differ by tolerance and by the size of single documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglens.llm.common import lookup, stored, table

N_SHARDS = 16
#: How far off a cut may fall, as a share of a shard's bytes, before the next digit is looked at.
TOLERANCE = 0.0025
#: Bounds the broadcast tables of cuts.
MAX_SHARDS = 100_000
DIMS = ("lang_at", "source_at", "size_at")
DIGIT = 12
#: (field, lowest bit) of each digit of the key (value, text_key, rid), the highest first: 24, 60 and 63 bits.
DIGITS = [("v", 12), ("v", 0), *[("text_key", s) for s in (48, 36, 24, 12, 0)], *[("rid", s) for s in (60, 48, 36, 24, 12, 0)]]
FIELDS = ("v", "text_key", "rid")


@dataclass(frozen=True)
class Node:
    """A node of the tree: its shards are first to first + shards - 1."""

    number: int
    first: int
    shards: int

    def children(self) -> tuple[Node, Node]:
        left = self.shards // 2
        return Node(2 * self.number, self.first, left), Node(2 * self.number + 1, self.first + left, self.shards - left)


def _hashed(value: Column) -> Column:
    """24 bits of a string's hash; NULL is 0."""
    return F.when(value.isNull(), F.lit(0).cast("long")).otherwise(F.shiftrightunsigned(F.xxhash64(value), 40))


def places(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, source, ...) -> a stored row per row: rid (unique), doc_id, size, text_crc32, text_key and
    the three dimensions, and the root as its node. Repeated rows stay apart by rid. A NULL text counts as no bytes."""
    text = F.col("text").cast("string")
    own = docs.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(text).bitwiseAND(F.lit((1 << 60) - 1)).alias("text_key"),
        F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
    )
    own = stored(own, "shard-rows")
    meta = F.struct("lang", "source")
    groups = own.groupBy("text_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "lang", "source")).alias("of"), F.min(meta).alias("lo"), F.max(meta).alias("hi"))
    mixed = stored(groups.where(~F.col("lo").eqNullSafe(F.col("hi"))).select("text_key", F.struct("of.lang", "of.source").alias("of")), "shard-copies")
    joined = lookup(own, mixed, "text_key", "left")
    own_or = lambda c: _hashed(F.when(F.col("of").isNull(), F.col(c)).otherwise(F.col(f"of.{c}")))
    size_at = F.floor(F.log2(F.col("size").cast("double")) * ((1 << 24) / 40.0)).cast("long")
    return stored(joined.select("rid", "doc_id", "size", "text_crc32", "text_key", own_or("lang").alias("lang_at"), own_or("source").alias("source_at"), size_at.alias("size_at"), F.lit(1).cast("long").alias("node")), "shard-places")


def _value(dim: Column) -> Column:
    return F.when(dim == 0, F.col(DIMS[0])).when(dim == 1, F.col(DIMS[1])).otherwise(F.col(DIMS[2]))


def descend(rows: DataFrame, cuts: list[tuple]) -> DataFrame:
    """Rows (node, ...) of a level, each moved to the child of its node; nodes without a cut stay. cuts: (number, dim, v,
    text_key, rid), the first key of the right child."""
    spark = rows.sparkSession
    at = F.broadcast(spark.createDataFrame(cuts, "node long, dim int, cut_v long, cut_text_key long, cut_rid long"))
    v = _value(F.col("dim"))
    right = (v > F.col("cut_v")) | ((v == F.col("cut_v")) & ((F.col("text_key") > F.col("cut_text_key")) | ((F.col("text_key") == F.col("cut_text_key")) & (F.col("rid") >= F.col("cut_rid")))))
    moved = F.when(F.col("dim").isNull(), F.col("node")).otherwise(2 * F.col("node") + right.cast("long"))
    return rows.join(at, "node", "left").withColumn("node", moved).drop("dim", "cut_v", "cut_text_key", "cut_rid")


def _bucket(rows: DataFrame, states: list[tuple], field: str, shift: int) -> list:
    """For each state (node, dim, v, text_key, rid, need): the digit (field, shift) of the bucket that the need-th byte of
    those rows of the node falls in that share the higher digits; bytes before it (of the rows looked at) and its own."""
    spark = rows.sparkSession
    state = F.broadcast(spark.createDataFrame(states, "node long, dim int, at_v long, at_text_key long, at_rid long, need double"))
    keyed = rows.join(state, "node").withColumn("v", _value(F.col("dim")))
    inside = F.shiftright(field, shift + DIGIT) == F.shiftright(f"at_{field}", shift + DIGIT) if shift + DIGIT < 64 else F.lit(True)
    for higher in FIELDS[: FIELDS.index(field)]:
        inside = inside & (F.col(higher) == F.col(f"at_{higher}"))
    digit = F.shiftright(field, shift).bitwiseAND(F.lit((1 << DIGIT) - 1))
    counts = keyed.where(inside).groupBy("node", "need", digit.alias("digit")).agg(F.sum("size").alias("own"))
    upto = F.sum("own").over(Window.partitionBy("node").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))
    found = counts.withColumn("upto", upto).where(F.col("upto") >= F.col("need"))
    return found.groupBy("node").agg(F.min(F.struct("digit", "upto", "own")).alias("x")).select("node", "x.digit", (F.col("x.upto") - F.col("x.own")).alias("before"), "x.own").collect()


def medians(rows: DataFrame, wanted: dict[int, tuple[int, float]], slack: float) -> list[tuple]:
    """wanted: node -> (dimension, bytes for its left child). The cuts (node, dim, v, text_key, rid)."""
    cuts, states = [], {n: (dim, {"v": 0, "text_key": 0, "rid": 0}, need) for n, (dim, need) in wanted.items()}
    for k, (field, shift) in enumerate(DIGITS):
        if not states:
            break
        left = {}
        for r in _bucket(rows, [(n, dim, at["v"], at["text_key"], at["rid"], need) for n, (dim, at, need) in states.items()], field, shift):
            dim, at, need = states[r.node]
            low, high = need - r.before, r.before + r.own - need  # how far off the bucket's edges are
            at[field] += r.digit << shift
            if min(low, high) <= slack or k == len(DIGITS) - 1:
                if high < low:
                    at[field] += 1 << shift
                cuts.append((r.node, dim, at["v"], at["text_key"], at["rid"]))
            else:
                left[r.node] = (dim, at, low)
        states = left
    return cuts


def build(rows: DataFrame, shards: int, tolerance: float = TOLERANCE) -> tuple[list[list[tuple]], list[Node]]:
    """rows as places() gives them -> the cuts of each level and the leaves."""
    if not 1 <= shards <= MAX_SHARDS:
        raise ValueError(f"shards must be 1 to {MAX_SHARDS}")
    levels, nodes, leaves, whole, slack = [], [Node(1, 0, shards)], [], None, 0.0
    while nodes:
        leaves += [n for n in nodes if n.shards == 1]
        nodes = [n for n in nodes if n.shards > 1]
        if not nodes:
            break
        ends = [f(d).alias(f"{f.__name__}_{d}") for d in DIMS for f in (F.min, F.max)]
        found = {r.node: r for r in rows.groupBy("node").agg(F.sum("size").alias("bytes"), *ends).collect()}  # a row per node
        spread = lambda r: [r[f"max_{d}"] - r[f"min_{d}"] for d in DIMS]
        if whole is None and found:
            whole, slack = spread(found[1]), tolerance * found[1].bytes / shards
        wanted = {}
        for n in nodes:
            if n.number in found:  # an empty node has nothing to cut
                r = found[n.number]
                widths = [w / max(1, all_) for w, all_ in zip(spread(r), whole, strict=True)]
                wanted[n.number] = widths.index(max(widths)), r.bytes * (n.shards // 2) / n.shards
        cuts = medians(rows, wanted, slack)
        levels.append(cuts)
        rows = descend(rows, cuts)
        nodes = [c for n in nodes for c in n.children()]
    return levels, leaves


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """docs (doc_id, text, lang, source, ...) -> (doc_id, size, text_crc32, shard, slot), a row per row.

    Either the number of shards or the bytes aimed at in each is given. size is the text's UTF-8 bytes and 1; NULL and empty
    texts have size 1 and checksum 0. NULL languages and sources stand at 0. Slots number a shard's rows from 0. Repeated
    rows and rows of equal doc_id are rows of their own; an empty table gives none.
    """
    spark = docs.sparkSession
    rows = places(docs)
    seen = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    shards = shards or max(1, -(-seen.bytes // (target_bytes or 1)))
    levels, leaves = build(rows, shards, tolerance)
    at = rows
    for cuts in levels:
        at = descend(at, cuts)
    numbers = F.broadcast(spark.createDataFrame([(n.number, n.first) for n in leaves], "node long, shard int"))
    # slots: rows of a shard are numbered bucket by bucket, so no task sorts a whole shard
    buckets = max(64, -(-seen.n // (shards * 100_000)))
    at = at.join(numbers, "node").select("rid", "doc_id", "size", "text_crc32", "text_key", "shard", F.pmod(F.xxhash64("rid"), F.lit(buckets)).alias("bucket"))
    counts = stored(at.groupBy("shard", "bucket").agg(F.count("*").alias("n")), "shard-counts")
    before = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    slot = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_key", "rid")) - 1
    return at.withColumn("own", slot).join(before, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("own")).cast("long").alias("slot"))


def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes, by shard(); nulls, repeats and an empty table as it says; other
    columns are not read."""
    found = shard(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"), N_SHARDS)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

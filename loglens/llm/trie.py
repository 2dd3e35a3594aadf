"""The prefix trie of conversations, as chains of the conversations that own its nodes.

A conversation is a sequence of turns; a node is a distinct prefix, known by its digest and owned by the smallest conversation
that begins with it. Who owns a prefix owns every longer one of its own, so the nodes of a conversation are one chain from
its first owned depth to its end, and the tree is a tree of chains.

1. Digests of all prefixes: one pass over 32-byte turn digests, sorted by Spark; texts don't leave the scan.
2. Minima: the owner of each digest.
3. The first owned depth by binary search, a batch of probes a round. A probe asks whether (digest, conversation) is among the
   minima, so it joins on both, and a prefix that very many conversations share is no hot key.
4. Each chain hangs on the node before its first; a conversation that owns nothing ends on a node of another. Chains are
   summed bottom-up by doubling: after round k a chain holds the sums of all below it within 2^k steps, so the rounds grow with
   the logarithm of the tree's height. Sums combine map-side; where a step leads to a chain that very many hang on, it is
   looked up by broadcast (`lookup`).
5. Along a chain, running sums from its end give every node's figures.

A node's list of ends is digested in runs of conversations whose ids differ below CHUNK_BITS; only whole runs go through the
node's digest in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglens.llm.common import lookup, stored, table

#: A conversation begins like the one whose number is the last multiple of this.
FAMILY = 100
#: Up to so many turns, less one, are taken over.
HEADS = 6
CHUNK_BITS = 12
DIGEST_BYTES = 16
LONG = "long"


def numbered(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, ...) -> (conv_id, pos, sha, chars), pos from 1 by turn, NULL first; equal turns stand in
    the order of the digest of role and text. NULL roles and texts are empty; rows without a conv_id belong to none."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    sha = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    own = rows.where("conv_id IS NOT NULL").select(F.col("conv_id").cast(LONG).alias("conv_id"), "turn", sha.alias("sha"), F.length(text).cast(LONG).alias("chars"))
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "sha")).cast(LONG)
    return own.select("conv_id", pos.alias("pos"), "sha", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """numbered() turns -> conversations (conv_id, len) and their turns (conv_id, depth, sha, chars) after the first h of each
    have been replaced by those of its family's first conversation; h is a checksum of its number."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS))
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("family"))
    first = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < HEADS)).groupBy(F.col("conv_id").alias("family"))
    first = first.agg(F.array_sort(F.collect_list(F.struct("pos", "sha", "chars"))).alias("first"))  # under HEADS turns
    heads = F.coalesce(F.slice("first", F.lit(1), F.col("h").cast("int")), F.array().cast("array<struct<pos:long,sha:binary,chars:long>>"))
    convs = stored(convs.join(first, "family", "left").select("conv_id", "n", "h", heads.alias("heads")), "trie-heads")
    taken = convs.select("conv_id", F.explode("heads").alias("t")).select("conv_id", F.col("t.pos").alias("depth"), "t.sha", "t.chars")
    own = turns.join(convs.select("conv_id", "h", F.size("heads").alias("m")), "conv_id").where("pos > h").select("conv_id", (F.col("m") + F.col("pos") - F.col("h")).alias("depth"), "sha", "chars")
    lengths = convs.select("conv_id", (F.size("heads") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).cast(LONG).alias("len"))
    return stored(lengths, "trie-convs"), taken.unionByName(own)


def _chain_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, digest, chars = None, None, 0
    for batch in batches:
        digests, sums = [], []
        for conv, sha, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "sha", "chars")), strict=True):
            if conv != now:
                now, digest, chars = conv, hashlib.sha256(), 0
            digest.update(sha)
            chars += n
            digests.append(digest.digest()[:DIGEST_BYTES])
            sums.append(chars)
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("depth"), pa.array(digests, pa.binary()), batch.column("chars"), pa.array(sums, pa.int64())], names=["conv_id", "depth", "digest", "chars", "upto"])


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, sha, chars) -> stored (conv_id, depth, digest, chars, upto): the digest of the first depth turns and the
    code points in their texts."""
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "depth")
    return stored(ordered.mapInArrow(_chain_digests, "conv_id long, depth long, digest binary, chars long, upto long"), "trie-prefixes")


def first_owned(convs: DataFrame, paths: DataFrame, minima: DataFrame, root: int) -> DataFrame:
    """(conv_id, len, first): the smallest depth of which the conversation owns the prefix, len + 1 if it owns none; 0 for the
    owner of the root. Each round halves the range of every conversation that is still in question."""
    longest = convs.agg(F.max("len").alias("n")).first().n
    state = convs.select("conv_id", "len", F.when(F.col("conv_id") == root, 0).otherwise(1).cast(LONG).alias("lo"), F.when(F.col("conv_id") == root, 0).otherwise(F.col("len") + 1).alias("hi"))
    for _ in range(int(longest).bit_length()):
        probes = state.where("lo < hi").select("conv_id", F.expr("(lo + hi) DIV 2").alias("depth")).join(paths.select("conv_id", "depth", "digest"), ["conv_id", "depth"])
        owned = probes.join(minima.withColumnRenamed("owner", "conv_id"), ["digest", "conv_id"], "left_semi").select("conv_id", F.lit(True).alias("owned"))
        mid, open_ = F.expr("(lo + hi) DIV 2"), F.col("lo") < F.col("hi")
        state = state.join(owned, "conv_id", "left")
        lo = F.when(open_ & F.col("owned").isNull(), mid + 1).otherwise(F.col("lo"))
        hi = F.when(open_ & F.col("owned"), mid).otherwise(F.col("hi"))
        state = stored(state.select("conv_id", "len", lo.alias("lo"), hi.alias("hi")), "trie-search")
    return state.select("conv_id", "len", F.col("lo").alias("first"))


def links(found: DataFrame, paths: DataFrame, minima: DataFrame, root: int) -> DataFrame:
    """first_owned() -> stored (conv_id, len, first, parent, at, before): each conversation hangs on its parent's node at depth
    at = first - 1, before being the code points up to there. The root's owner hangs on nothing."""
    at = found.withColumn("at", F.col("first") - 1)
    deep = at.where("at > 0").join(paths.select("conv_id", F.col("depth").alias("at"), "digest", F.col("upto").alias("before")), ["conv_id", "at"])
    deep = lookup(stored(deep, "trie-links"), minima, "digest").select("conv_id", "len", "first", F.col("owner").alias("parent"), "at", "before")
    top = at.where("at <= 0").select("conv_id", "len", "first", F.when(F.col("conv_id") == root, F.lit(None)).otherwise(F.lit(root)).cast(LONG).alias("parent"), F.greatest("at", F.lit(0)).alias("at"), F.lit(0).cast(LONG).alias("before"))
    return stored(deep.unionByName(top), "trie-links")


def jumps(chains: DataFrame) -> list[DataFrame]:
    """(conv_id, jump) for 1, 2, 4, ... steps up the tree of chains (conv_id, parent); the last is the first that's empty."""
    out = [stored(chains.where("parent IS NOT NULL").select("conv_id", F.col("parent").alias("jump")), "trie-jumps")]
    while not out[-1].isEmpty():
        on = out[-1].select(F.col("conv_id").alias("jump"), F.col("jump").alias("next"))
        out.append(stored(lookup(out[-1], on, "jump").select("conv_id", F.col("next").alias("jump")), "trie-jumps"))
    return out


def subtree_sums(values: DataFrame, ups: list[DataFrame], *columns: str) -> DataFrame:
    """values (conv_id, columns) -> the same, each with what is below it added, through jumps()."""
    now = values
    for up in ups[:-1]:
        below = now.join(up, "conv_id").groupBy(F.col("jump").alias("conv_id")).agg(*[F.sum(c).alias(f"below_{c}") for c in columns])
        now = stored(now.join(below, "conv_id", "left").select("conv_id", *[(F.col(c) + F.coalesce(f"below_{c}", F.lit(0))).alias(c) for c in columns]), "trie-sums")
    return now


def _ends_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "depth", "ends_sha256"]
    now, digest = None, None
    for batch in batches:
        done = []
        for conv, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "ids")), strict=True):
            if now != (conv, depth):
                if now:
                    done.append((*now, digest.hexdigest()))
                now, digest = (conv, depth), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in done])
    if now:
        yield pa.RecordBatch.from_pylist([dict(zip(names, (*now, digest.hexdigest()), strict=True))])


def ends(hung: DataFrame) -> DataFrame:
    """links() -> (conv_id, depth, ends_sha256) of the nodes (owner, depth) that conversations end at."""
    owns = F.col("first") <= F.col("len")
    at = hung.select(F.when(owns, F.col("conv_id")).otherwise(F.col("parent")).alias("owner"), F.when(owns, F.col("len")).otherwise(F.col("at")).alias("depth"), "conv_id")
    runs = at.groupBy(F.col("owner").alias("conv_id"), "depth", F.shiftright("conv_id", CHUNK_BITS).alias("run")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    runs = stored(runs.select("conv_id", "depth", "run", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids")), "trie-ends")
    counts = runs.groupBy("conv_id", "depth").agg(F.count("*").alias("n"), F.min("ids").alias("ids"))
    one = counts.where("n = 1").select("conv_id", "depth", F.sha2("ids", 256).alias("ends_sha256"))
    many = runs.join(counts.where("n > 1").select("conv_id", "depth"), ["conv_id", "depth"], "left_semi")
    many = many.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "run").select("conv_id", "depth", "ids")
    return one.unionByName(many.mapInArrow(_ends_digest, "conv_id long, depth long, ends_sha256 string"))


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """Conversations (conv_id, len), turnless ones too, and their turns (conv_id, depth, sha, chars) -> a row per node: conv_id,
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. No conversations give no node."""
    spark = convs.sparkSession
    root = convs.agg(F.min("conv_id").alias("c")).first().c
    schema = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if root is None:
        return spark.createDataFrame([], schema)
    paths = prefixes(turns)
    minima = stored(paths.groupBy("digest").agg(F.min("conv_id").alias("owner")), "trie-minima")
    hung = links(first_owned(convs, paths, minima, root), paths, minima, root)
    owns = F.col("first") <= F.col("len")
    chains, others = hung.where(owns), hung.where(~owns)
    ups = jumps(chains)
    # what a chain has of its own: itself, conversations that end on it, a leaf if no chain hangs on its end
    ended = others.groupBy(F.col("parent").alias("conv_id")).agg(F.count("*").alias("ended"))
    at_end = chains.select(F.col("parent").alias("conv_id"), F.col("at").alias("len")).distinct().withColumn("inner", F.lit(True))
    own = chains.join(ended, "conv_id", "left").join(at_end, ["conv_id", "len"], "left")
    own = own.select("conv_id", (F.lit(1) + F.coalesce("ended", F.lit(0))).cast(LONG).alias("n"), F.when(F.col("inner"), 0).otherwise(1).cast(LONG).alias("leaves"))
    sums = subtree_sums(stored(own, "trie-own"), ups, "n", "leaves")
    # points where something hangs, with all that hangs there
    hanging = chains.where("parent IS NOT NULL").join(sums, "conv_id").select("conv_id", "parent", "at", "n", "leaves", F.lit(1).cast(LONG).alias("chains"))
    hanging = hanging.unionByName(others.select("conv_id", "parent", "at", F.lit(1).cast(LONG).alias("n"), F.lit(0).cast(LONG).alias("leaves"), F.lit(0).cast(LONG).alias("chains")))
    points = hanging.groupBy(F.col("parent").alias("conv_id"), F.col("at").alias("depth")).agg(*[F.sum(c).alias(c) for c in ("n", "leaves", "chains")])
    points = stored(points, "trie-points")
    # every member beyond the first saves the texts between the chain's top and where it leaves
    saved = points.join(paths.select("conv_id", "depth", "upto"), ["conv_id", "depth"]).join(chains.select("conv_id", "before"), "conv_id")
    saved = saved.groupBy("conv_id").agg(F.sum(F.col("n") * (F.col("upto") - F.col("before"))).alias("saved"))
    saved = stored(chains.select("conv_id").join(saved, "conv_id", "left").select("conv_id", F.coalesce("saved", F.lit(0)).cast(LONG).alias("saved")), "trie-saved")
    saved = subtree_sums(saved, ups, "saved")
    below = chains.where("parent IS NOT NULL").join(saved, "conv_id").groupBy(F.col("parent").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("saved").alias("below"))
    nodes = paths.select("conv_id", "depth", "chars").unionByName(chains.where("first = 0").select("conv_id", F.lit(0).cast(LONG).alias("depth"), F.lit(0).cast(LONG).alias("chars")))
    nodes = nodes.join(chains.select("conv_id", "len", "first", "parent"), "conv_id").where("depth >= first")
    nodes = nodes.join(points, ["conv_id", "depth"], "left").join(below, ["conv_id", "depth"], "left").join(ends(hung), ["conv_id", "depth"], "left").na.fill(0, ["n", "leaves", "chains", "below"])
    down = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    inner_end = F.max(F.when(F.col("depth") == F.col("len"), F.col("chains"))).over(down) > 0
    nodes = nodes.select("*", F.sum("n").over(down).alias("more"), F.sum("leaves").over(down).alias("leaves_below"), inner_end.alias("inner_end"))
    return nodes.select(
        "conv_id", "depth", F.when(F.col("depth") > F.col("first"), F.col("conv_id")).otherwise(F.col("parent")).alias("parent_conv_id"),
        (F.col("more") + 1).alias("n_convs"), (F.col("chains") + (F.col("depth") < F.col("len")).cast(LONG)).alias("n_children"),
        (F.col("leaves_below") + F.when(F.col("inner_end"), 0).otherwise(1)).cast(LONG).alias("n_leaves"),
        F.sum(F.col("more") * F.col("chars") + F.col("below")).over(down).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations. NULL turns come first, NULL roles and texts are empty, rows without a conv_id
    belong to no conversation; equal turns stand in the order of their digest, repeated rows are turns of their own; other
    columns are not read; an empty table gives no row."""
    turns = stored(numbered(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")), "trie-turns")
    return trie(*rebuilt(turns))


_BIT = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
_BYTES = "list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(s[i]) AS BIGINT))"
_CRC = f"xor(list_reduce(list_prepend(4294967295, {_BYTES}), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, i: {_BIT})), 4294967295)"
OP11_SQL = f"""
WITH t AS (SELECT conv_id, sha, chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha) AS pos
  FROM (SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS sha, length(coalesce(text, '')) AS chars
    FROM conversations WHERE conv_id IS NOT NULL)),
h AS (SELECT conv_id, {_CRC} % {HEADS} AS h, conv_id - conv_id % {FAMILY} AS family FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM t)),
b AS (SELECT h.conv_id, 0 AS part, pos, sha, chars FROM h JOIN t ON t.conv_id = h.family AND pos <= h UNION ALL
  SELECT h.conv_id, 1, pos, sha, chars FROM h JOIN t ON t.conv_id = h.conv_id AND pos > h),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth FROM b),
p AS (SELECT conv_id, depth, chars, string_agg(sha, '') OVER (PARTITION BY conv_id ORDER BY depth) AS k FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM h),
m AS (SELECT k, depth, min(conv_id) AS c, count(*) AS n, min(chars) AS chars FROM p GROUP BY k, depth),
e AS (SELECT m.k, q.k AS up, q.c AS parent FROM m JOIN p ON p.conv_id = m.c AND p.depth = m.depth - 1 JOIN m q ON q.k = p.k),
w AS (SELECT up, count(*) AS n_children FROM e GROUP BY up),
s AS (SELECT p.k, sum((m.n - 1) * m.chars) AS saved, count(*) FILTER (w.up IS NULL) AS leaves FROM m JOIN p ON p.conv_id = m.c AND p.depth <= m.depth LEFT JOIN w ON w.up = m.k GROUP BY p.k),
z AS (SELECT k, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM p JOIN (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id) USING (conv_id, depth) GROUP BY k)
SELECT CAST(m.c AS BIGINT) AS conv_id, CAST(m.depth AS BIGINT) AS depth, CAST(e.parent AS BIGINT) AS parent_conv_id, CAST(m.n AS BIGINT) AS n_convs,
  CAST(coalesce(w.n_children, 0) AS BIGINT) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(z.ids, '')) AS ends_sha256
FROM m JOIN s ON s.k = m.k LEFT JOIN e ON e.k = m.k LEFT JOIN w ON w.up = m.k LEFT JOIN z ON z.k = m.k
"""

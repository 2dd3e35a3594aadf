"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import shuffled, stored

#: Up to so many links Spark may broadcast a side of them; it takes links at the size of their files, where equal roots pack to little.
FEW = 100_000


def _star(pairs: DataFrame, few: bool) -> DataFrame:
    """pairs (node, other) with the smallest of node and its others. The minimum is taken with a map-side combine, so a
    node with very many others is one row per task."""
    low = pairs.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("low"))
    return pairs.join(low if few else shuffled(low), "node")


def _mark(links: DataFrame) -> tuple[int, int]:
    return tuple(links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a, b) of bigint nodes -> (node, root) for every node that has an edge; root is the smallest node reachable.

    Self-loops, repeats and either direction are allowed; no edges give no rows. Each round is written to the shared
    folder, which cuts the lineage; links never reach the driver, only a count and a checksum of them do.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(max_rounds):
        both = now.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(now.select(F.col("b").alias("node"), F.col("a").alias("other")))
        large = _star(both, mark[0] <= FEW).where("other > node").select(F.col("other").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        down = large.select(F.col("a").alias("node"), F.col("b").alias("other"))
        small = _star(down, mark[0] <= FEW)
        nxt = small.select(F.col("other").alias("a"), F.col("low").alias("b")).unionByName(small.select(F.col("node").alias("a"), F.col("low").alias("b")))
        now = stored(nxt.where("a <> b").distinct(), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()

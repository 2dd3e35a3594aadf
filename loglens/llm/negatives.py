"""Hard negatives by distributed radix selection.

A row's score with an anchor is their integer inner product. Rows and anchors stand in blocks; every pair of blocks is one
small matrix product (fragment and replicate: the stated anchors against all rows), made anew in each pass instead of being
stored. A pass over a set of windows (anchor, lowest score, highest score) is one of two:

- Count: how many rows fall into each bucket of the window's scores, a digit of DIGIT bits at a time from the highest. Counts
  combine map-side; the bucket that holds the k-th score is chosen in Spark and its digit narrows the window for the next.
- Gather: only rows that reach the k-th score, which the last digit has fixed. Of rows that tie there a block gives its k
  smallest ids, so copies of one vector stay few.

The first selection finds an anchor's positives (its window is every score, rows of its label), the second the negatives of
each (anchor, positive) window. State is a row per window, stored after each pass; nothing but counts and the widest window's
bits reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglens.llm.common import release, shuffled, stored, table

POSITIVES, NEGATIVES = 5, 3
ANCHOR_EVERY, SHIFTED_EVERY, LABELS = 50, 7, 10
SCALE = 256.0
DIGIT = 10
#: Rows in a block: a 64th of all within these, so that pairs of blocks are many enough to spread and few enough to ship.
LEAST_BLOCK, MOST_BLOCK = 1024, 16_384
#: Anchors that one matrix product takes at a time, for memory.
SLICE = 256
#: From here on double products could round; scores are then made of Python integers.
EXACT = 1 << 52
WINDOW = ["anchor_id", "positive_id"]


def usable(rows: DataFrame) -> DataFrame:
    """rows (vec_id, label, embedding, ...) -> (vec_id, label, x), one a vec_id.

    Rows take no part whose vec_id, label or vector is NULL, or that have a NULL or non-finite component. Of rows that share a
    vec_id the one with the smallest label, then vector, counts. Vectors of fewer components are padded with zeros later.
    """
    label = F.when(F.col("vec_id") % SHIFTED_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")).cast("long")
    x = F.col("embedding").cast("array<double>")
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), x.alias("x")).where("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").where(~bad)
    return own.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("of")).select("vec_id", "of.label", "of.x")


def blocks(rows: DataFrame, n: int, dims: int, number: str) -> DataFrame:
    """(number, ids, labels, flat): rows packed in n blocks by a hash of their id, flat being their padded vectors in a row."""
    padded = F.concat("x", F.array_repeat(F.lit(0.0), F.lit(dims) - F.size("x")))
    packed = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias(number), F.struct("vec_id", "label", padded.alias("x")).alias("r"))
    packed = packed.groupBy(number).agg(F.collect_list("r").alias("rs"))
    return stored(packed.select(number, F.col("rs.vec_id").alias("ids"), F.col("rs.label").alias("labels"), F.flatten("rs.x").alias("flat")), f"negatives-{number}")


def _matrix(flat: np.ndarray, n: int, exact: bool) -> np.ndarray:
    m = np.floor(SCALE * flat).reshape(n, -1)
    return m if exact else np.array([[int(c) for c in r] for r in m], dtype=object).reshape(m.shape)


def _row(batch: pa.RecordBatch, name: str, k: int) -> np.ndarray:
    return batch.column(name)[k].values.to_numpy(zero_copy_only=False)


def _windows(batch: pa.RecordBatch, k: int, exact: bool, same: bool) -> Iterator[tuple]:
    """For each window of a pair of blocks: its fields, and the scores and ids of the rows that may be in it."""
    aids, ids, labels = (_row(batch, c, k) for c in ("aids", "ids", "labels"))
    order = np.argsort(aids)
    left = _matrix(_row(batch, "aflat", k), len(aids), exact)[order]
    aids, alabels = aids[order], _row(batch, "alabels", k)[order]
    right = _matrix(_row(batch, "flat", k), len(ids), exact).T
    fields = {f: _row(batch, f"w_{f}", k) for f in (*WINDOW, "hi", "span", "prefix")}
    at = np.searchsorted(aids, fields["anchor_id"])
    by = np.argsort(at, kind="stable")
    edges = np.searchsorted(at[by], np.arange(len(aids) + 1))
    for start in range(0, len(aids), SLICE):
        scores = (left[start : start + SLICE] @ right).astype(np.int64)
        for i in range(start, min(start + SLICE, len(aids))):
            own = by[edges[i] : edges[i + 1]]
            if not len(own):
                continue
            fit = (labels == alabels[i]) & (ids != aids[i]) if same else labels != alabels[i]
            s, who = scores[i - start][fit], ids[fit]
            for w in own:
                yield aids[i], fields["positive_id"][w], fields["hi"][w], fields["span"][w], fields["prefix"][w], s, who


def _batches(found: list[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*found, strict=True)], names=names)


def _count(shift: int, exact: bool, same: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = []
                for a, p, hi, span, prefix, s, _ in _windows(batch, k, exact, same):
                    u = hi - s  # the best score of the window is 0
                    u = u[(u >= 0) & (u <= span)]
                    u = u[(u >> (shift + DIGIT)) == prefix]
                    if len(u):
                        digit, n = np.unique((u >> shift) & ((1 << DIGIT) - 1), return_counts=True)
                        found.append((np.full(len(n), a), np.full(len(n), p), digit, n))
                yield from _batches(found, [*WINDOW, "digit", "n"])
        release()

    return run


def _gather(most: int, exact: bool, same: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = []
                for a, p, hi, _, last, s, who in _windows(batch, k, exact, same):
                    u = hi - s
                    fit = (u >= 0) & (u <= last)
                    s, who = s[fit], who[fit]
                    best = np.lexsort((who, -s))[:most]
                    found.append((np.full(len(best), a), np.full(len(best), p), who[best], s[best]))
                yield from _batches(found, [*WINDOW, "vec_id", "score"])
        release()

    return run


def select(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, windows: DataFrame, most: int, same: bool, exact: bool) -> DataFrame:
    """The first `most` rows of each window (ablock, anchor_id, positive_id, hi, span), by falling score, then id: (anchor_id,
    positive_id, vec_id, score, rank). rows and anchors are blocks(), n_rows and n_anchors of them; same: rows of the
    anchor's label other than itself, else rows of other labels. Its joins are never broadcast: what is copied to each block
    of rows or packed in arrays is far larger than Spark makes it out to be."""
    widest = windows.agg(F.max("span").alias("span")).first().span
    rounds = -(-max(1, int(widest or 0).bit_length()) // DIGIT)
    a = anchors.select("ablock", F.col("ids").alias("aids"), F.col("labels").alias("alabels"), F.col("flat").alias("aflat"))
    spread = a.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))).alias("rblock"))
    everywhere = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_anchors - 1))).alias("ablock"))
    pairs = everywhere.join(shuffled(spread), ["ablock", "rblock"])

    def over(state: DataFrame, run: Callable, schema: str) -> DataFrame:
        packed = state.groupBy("ablock").agg(F.collect_list(F.struct(*WINDOW, "hi", "span", "prefix")).alias("w"))
        packed = packed.select("ablock", *[F.col(f"w.{f}").alias(f"w_{f}") for f in (*WINDOW, "hi", "span", "prefix")])
        # the windows of a block of anchors go to each block of rows, as the anchors do
        packed = packed.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))).alias("rblock"))
        return pairs.join(shuffled(packed), ["ablock", "rblock"]).mapInArrow(run, schema)

    state = windows.select("ablock", *WINDOW, "hi", "span", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("above"), F.lit(False).alias("whole"))
    for r in reversed(range(rounds)):
        counts = over(state.where("NOT whole"), _count(r * DIGIT, exact, same), "anchor_id long, positive_id long, digit long, n long")
        counts = counts.groupBy(*WINDOW, "digit").agg(F.sum("n").alias("n")).join(shuffled(state.select(*WINDOW, "above")), WINDOW)
        upto = F.col("above") + F.sum("n").over(Window.partitionBy(*WINDOW).orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))
        reached = counts.withColumn("upto", upto).where(F.col("upto") >= most)
        found = reached.groupBy(*WINDOW).agg(F.min(F.struct("digit", (F.col("upto") - F.col("n")).alias("before"))).alias("x"))
        state = state.join(shuffled(found), WINDOW, "left")
        # too few rows: the window is taken whole
        whole = F.col("whole") | F.col("x").isNull()
        prefix = F.when(whole, F.col("prefix")).otherwise(F.shiftleft("prefix", DIGIT) + F.col("x.digit"))
        state = stored(state.select("ablock", *WINDOW, "hi", "span", prefix.alias("prefix"), F.coalesce("x.before", "above").alias("above"), whole.alias("whole")), "negatives-state")
    last = state.withColumn("prefix", F.when(F.col("whole"), F.col("span")).otherwise(F.col("prefix")))
    got = over(last, _gather(most, exact, same), "anchor_id long, positive_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy(*WINDOW).orderBy(F.desc("score"), "vec_id"))
    return got.withColumn("rank", rank).where(F.col("rank") <= most)


def mine(rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """rows (vec_id, label, embedding, ...) -> (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Rows count as usable() says; other columns are not read. Anchors with fewer positives have fewer windows, windows with
    fewer rows (and those of positives that score below zero, which are empty) fewer negatives or none; an empty table gives
    none. ValueError where components are so large that a score might not fit a long.
    """
    spark = rows.sparkSession
    own = stored(usable(rows), "negatives-rows")
    norm = F.aggregate("x", F.lit(0.0), lambda acc, c: acc + (F.abs(c) * SCALE + 1) * (F.abs(c) * SCALE + 1))
    is_anchor = F.col("vec_id") % ANCHOR_EVERY == 0
    seen = own.agg(F.count("*").alias("n"), F.count(F.when(is_anchor, 1)).alias("anchors"), F.max(F.size("x")).alias("dims"), F.max(norm).alias("norm")).first()
    bound = int(seen.norm or 0) + 1 if (seen.norm or 0) < 2.0**62 else None
    if bound is None:
        raise ValueError("components are so large that scores may not fit a long")
    per = lambda n: -(-max(1, n) // min(MOST_BLOCK, max(LEAST_BLOCK, n // 64)))
    n_rows, n_anchors = per(seen.n), per(seen.anchors)
    rs = blocks(own, n_rows, seen.dims or 0, "rblock")
    ks = blocks(own.where(is_anchor), n_anchors, seen.dims or 0, "ablock")
    at = own.where(is_anchor).select(F.pmod(F.xxhash64("vec_id"), F.lit(n_anchors)).cast("int").alias("ablock"), F.col("vec_id").alias("anchor_id"))
    exact = bound < EXACT
    every = at.select("ablock", "anchor_id", F.col("anchor_id").alias("positive_id"), F.lit(bound).cast("long").alias("hi"), F.lit(2 * bound).cast("long").alias("span"))
    near = select(rs, ks, n_rows, n_anchors, stored(every, "negatives-windows"), positives, True, exact)
    near = stored(near.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    # 50 p <= 100 s <= 95 p, without products that overflow; no score does for p below zero
    p = F.col("positive_score")
    lo, hi = F.expr("positive_score DIV 2 + positive_score % 2"), F.expr("positive_score DIV 20 * 19 + positive_score % 20 * 19 DIV 20")
    wanted = near.where(p >= 0).join(shuffled(at), "anchor_id").select("ablock", *WINDOW, hi.alias("hi"), (hi - lo).alias("span")).where("span >= 0")
    found = select(rs, ks, n_rows, n_anchors, stored(wanted, "negatives-windows"), negatives, False, exact)
    return found.join(shuffled(near), WINDOW).select(*WINDOW, F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mine() over all embeddings; nulls, ties, repeats and empty tables as it says."""
    return mine(table(spark, sf_dir, "embeddings", "vec_id", "label", "embedding"))


OP13_SQL = f"""
WITH v AS (SELECT vec_id, CAST(CASE WHEN vec_id % {SHIFTED_EVERY} = 0 THEN (label + 1) % {LABELS} ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % {ANCHOR_EVERY} = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= {NEGATIVES}
"""

"""Quality rules and an isolation forest on their statistics.

The rules count words, symbols, repeated lines and repeated word windows of whole texts. The forest is grown on a bounded
sample of SAMPLE rows' statistics: TREES trees, each from SUBSAMPLE rows by random splits; a row's score is
2 ** (-mean path length / expected path length), so rows that are isolated early score high. The threshold is calibrated
on all labelled rows: of the cuts that reject at most MAX_LOSS of the good ones, the one with the best difference between
rejected bad and rejected good shares.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.llm.common import stored, table

TREES, SUBSAMPLE, SAMPLE, SEED, BINS, MAX_LOSS = 100, 256, 8192, 17, 1000, 0.01
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
_SYMBOLS = re.compile("[#*$%&|<>]")
_SPACE = b" \t\n\x0b\x0c\r"


def statistics(text: str | None) -> tuple[int, ...]:
    """The STATS of one text; NULL has no words. Words are separated by ASCII white space."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    found = data.split()
    n = len(found)
    spaces = len(data) - len(data.translate(None, _SPACE))
    lines = [line for line in data.split(b"\n") if line.strip(_SPACE)]
    repeat = 0
    if n > 3:
        windows = list(zip(found, found[1:], found[2:], strict=False))
        if len(seen := set(windows)) < len(windows):
            many = Counter(windows)
            last = -1
            for i, w in enumerate(windows):
                if many[w] > 1:
                    repeat += i + 3 - max(i, last)
                    last = i + 3
        del seen
    return (n, len(text) - spaces, len(_SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeat, len(lines))


def document_statistics(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, STATS as bigint), a row per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(len(STATS)))], names=["doc_id", *STATS])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in STATS))


def features(columns: list[np.ndarray]) -> np.ndarray:
    """Shares that a document's length doesn't move, from STATS as float arrays."""
    words, chars, symbols, dup, repeat, lines = columns
    w = np.maximum(words, 1)
    return np.stack([chars / w, symbols / w, symbols / np.maximum(chars, 1), np.log1p(100 * symbols / w), dup / np.maximum(lines, 1), repeat / w], axis=1)


def expected_path(n: int) -> float:
    """The mean depth of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n <= 1 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


class Forest:
    """Each tree: arrays of feature (-1: leaf), cut, left, right and the leaf's path length."""

    def __init__(self, x: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.size = min(subsample, len(x))
        self.trees = [self._grow(x[rng.choice(len(x), self.size, replace=False)], rng) for _ in range(trees)] if len(x) else []

    def _grow(self, x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        nodes: list[list] = []
        deepest = math.ceil(math.log2(max(2, len(x))))

        def add(rows: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, 0, 0, depth + expected_path(len(rows))])
            low, high = rows.min(0), rows.max(0)
            able = np.flatnonzero(high > low)
            if depth < deepest and len(rows) > 1 and len(able):
                k = int(rng.choice(able))
                cut = float(rng.uniform(low[k], high[k]))
                side = rows[:, k] < cut
                if side.any() and not side.all():
                    nodes[at][:2] = [k, cut]
                    nodes[at][2] = add(rows[side], depth + 1)
                    nodes[at][3] = add(rows[~side], depth + 1)
            return at

        add(x, 0)
        return tuple(np.array(c) for c in zip(*nodes, strict=True))

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, high for rows that few random splits isolate; 0 without a tree."""
        if not self.trees:
            return np.zeros(len(x))
        total = np.zeros(len(x))
        for feature, cut, left, right, depth in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                i = np.flatnonzero(inner)
                k = at[i]
                at[i] = np.where(x[i, feature[k]] < cut[k], left[k], right[k])
            total += depth[at]
        return 2 ** (-total / len(self.trees) / max(expected_path(self.size), 1e-9))


def fit(stats: DataFrame, sample: int = SAMPLE) -> Forest:
    """A forest on at most sample rows with words, drawn by a hash of doc_id."""
    own = stats.where("n_words > 0")
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(SEED), *STATS), F.lit(1 << 30)) / float(1 << 30) * own.count()
    passed = own.withColumn("drawn", drawn).where(F.col("drawn") < 1.25 * sample + 64)  # so few rows that the driver can take them
    rows = passed.orderBy("drawn", *STATS).select(*STATS).limit(sample).collect()
    return Forest(features([np.array(c, dtype=np.float64) for c in zip(*rows, strict=True)]) if rows else np.zeros((0, 6)))


def scored(stats: DataFrame, forest: Forest) -> DataFrame:
    """stats with score; documents without words score 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.float64) for c in STATS]
            s = np.where(cols[0] > 0, forest.score(features(cols)), 1.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], names=[*batch.schema.names, "score"])

    return stats.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in stats.dtypes) + ", score double")


def threshold(scores: DataFrame, labels: DataFrame, max_loss: float = MAX_LOSS) -> float:
    """scores (doc_id, score), labels (doc_id, quality) -> the largest score that is kept, from all labelled rows; 1
    without rows of both kinds or without a cut that helps. A doc_id with several labels counts as its lowest."""
    own = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    bins = scores.join(own, "doc_id").groupBy(F.ceil(F.col("score") * BINS).cast("int").alias("bin"), (F.col("quality") > 0).alias("good")).count().collect()  # at most 2 * (BINS + 1) rows
    good, bad = np.zeros(BINS + 2), np.zeros(BINS + 2)
    for r in bins:
        (good if r.good else bad)[r.bin] += r["count"]
    if not good.sum() or not bad.sum():
        return 1.0
    lost, caught = good[::-1].cumsum()[::-1] / good.sum(), bad[::-1].cumsum()[::-1] / bad.sum()
    gain = np.where(lost <= max_loss, caught - lost, -1)
    k = int(gain.argmax())
    return (k - 1) / BINS if gain[k] > 0 and k else 1.0


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...), labels (doc_id, quality, ...) -> (doc_id, STATS, base_failed, kept, score).

    A row per row, repeats included; NULL and empty texts have no words and fail. kept is false if base_failed, else
    whether the forest's score is within the calibrated threshold.
    """
    stats = stored(document_statistics(docs), "statistics")
    rated = stored(scored(stats, fit(stats)), "scores")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rated = rated.withColumn("base_failed", failed)
    cut = threshold(rated.where(~F.col("base_failed")), labels)
    return rated.withColumn("kept", ~F.col("base_failed") & (F.col("score") <= cut))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")

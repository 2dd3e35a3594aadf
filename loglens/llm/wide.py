"""Near copies by wide SimHash fingerprints: a similarity instead of op2's fixed distance.

The set of a text's shingles (five words) gives BITS fingerprint bits by majority. Of two texts with a Jaccard similarity J
the shares of shingles have cosine 2J / (1 + J), and each bit differs with the chance acos(cosine) / pi, so a similarity
and a recall set the number of bits, `tau`, by which linked fingerprints may differ.

64 bits can't tell 0.8 from chance that way, and `tau` of 512 bits is too many for an index of equal boxes. Candidates
meet in tables of keys instead: a key is `width` bits of the fingerprint, and a text is also entered under the keys with one
of its two least certain bits (those with the closest majority) turned. The number of tables follows from the recall. What
meets goes through the pigeonring: some chain of consecutive boxes keeps every prefix within floor(length * tau / BOXES),
which loses no pair within `tau`; only then the full distance is taken.

Keys grow by a bit with each doubling of the texts beyond 2 ** 16 of them, so that the share of entries that meet by chance,
under (WEAK + 1) / 256, stays what it is; more bits need more tables.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import release, stored
from loglens.llm.components import components

BITS, BOXES, CHAIN = 512, 32, 4
#: Keys of a text in a table: its own, and one for each of its least certain bits.
WEAK = 2
MIN_WIDTH, SPARE = 24, 8
#: Tables whose buckets are first compared with their smallest node.
SEEDS = 4
COLD, BLOCK, CHUNK = 32, 1024, 4096

_LANES = (np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(1, -1)


def difference(similarity: float) -> float:
    """The expected share of differing bits at a Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def width_for(texts: int) -> int:
    """Bits of a key: 2 ** SPARE keys a text or more."""
    return max(MIN_WIDTH, texts.bit_length() + SPARE)


@cache
def tables_for(similarity: float, recall: float, width: int) -> int:
    """Tables that bring pairs of a similarity together with the given recall; the chance of one is drawn, with a fixed seed."""
    cosine, n = 2 * similarity / (1 + similarity), 100_000
    rng = np.random.default_rng(7)
    one = rng.standard_normal((n, width), np.float32)
    two = np.float32(cosine) * one + np.float32(math.sqrt(1 - cosine * cosine)) * rng.standard_normal((n, width), np.float32)
    place = np.arange(width)[None, None, :]
    sides = []
    for x in (one, two):
        weak = np.argsort(np.abs(x), axis=1)[:, :WEAK]
        bits = np.repeat((x > 0)[:, None, :], WEAK + 1, axis=1)
        bits[:, 1:, :] ^= place == weak[:, :, None]
        sides.append(bits @ (np.int64(1) << np.arange(width, dtype=np.int64)))
    met = (sides[0][:, :, None] == sides[1][:, None, :]).any((1, 2)).mean()
    return math.ceil(math.log(1 - recall) / math.log1p(-met))


@dataclass(frozen=True)
class Spec:
    shingle: int = 5
    similarity: float = 0.8
    recall: float = 0.95
    width: int = MIN_WIDTH

    @property
    def tau(self) -> int:
        """Bits within which a share of about 0.95 of the pairs at the similarity lies."""
        p = difference(self.similarity)
        return math.floor(BITS * p + 1.645 * math.sqrt(BITS * p * (1 - p)))

    def places(self) -> np.ndarray:
        """(tables, width): which bits make a table's key; every bit is used before one is used again."""
        tables = tables_for(self.similarity, self.recall, self.width)
        rng = np.random.default_rng(42)
        rounds = math.ceil(tables * self.width / BITS)
        return np.concatenate([rng.permutation(BITS) for _ in range(rounds)])[: tables * self.width].reshape(tables, self.width)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Distinct 64-bit hashes of a text's shingles: words between ASCII white space, A-Z lower-cased; fewer words than size
    are one shingle. NULL or no word: none."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(map(digest, found), np.uint64, len(found))
    n = max(1, len(hashes) - size + 1)
    out = np.full(n, min(size, len(hashes)), np.uint64)
    for k in range(min(size, len(hashes))):
        out = (out ^ hashes[k : k + n]) * np.uint64(0xC2B2AE3D27D4EB4F)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def votes(hashes: np.ndarray) -> np.ndarray:
    """For each bit, how many of the shingles have it. Long texts are counted in chunks."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        z = hashes[at : at + CHUNK, None] + _LANES
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        counts += np.unpackbits(z.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return counts


def fingerprint(text: str | None, size: int = 5) -> bytes:
    """BITS bits; one is set if it is set in over half of the distinct shingles. No word: all zero."""
    hashes = shingles(text, size)
    return np.packbits(2 * votes(hashes) > len(hashes), bitorder="little").tobytes()


def _fingerprints(spec: Spec) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    places = spec.places()
    tables = np.arange(len(places), dtype=np.int64) << spec.width
    weights = np.int64(1) << np.arange(spec.width, dtype=np.int64)

    def made(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps, keys = [], []
        for text in batch.column(1):
            hashes = shingles(text.as_py(), spec.shingle)
            margin = 2 * votes(hashes) - len(hashes)
            bits = margin > 0
            fps.append(np.packbits(bits, bitorder="little").tobytes())
            own = (bits[places] @ weights) | tables
            weak = np.argsort(np.abs(margin)[places], axis=1, kind="stable")[:, :WEAK]
            keys.append(np.concatenate([own, (own[:, None] ^ weights[weak]).ravel()]))
        n = len(places) * (WEAK + 1)
        flat = pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(fps) + 1, dtype=np.int32) * n), flat)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps, pa.binary()), lists], names=["doc_id", "text_key", "fp", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield made(batch)
            del batch
            release()

    return run


def within(diff: np.ndarray, tau: int) -> np.ndarray:
    """Indices of the rows of diff (n, BITS / 64) with at most tau bits: first the chain of boxes, then the whole."""
    boxes = np.bitwise_count(diff.view(np.uint16)).reshape(len(diff), BOXES, -1).sum(2, dtype=np.uint16)
    held, sums = np.ones(boxes.shape, bool), np.zeros(boxes.shape, np.uint16)
    for length in range(CHAIN):
        sums += np.roll(boxes, -length, axis=1)
        held &= sums <= (length + 1) * tau // BOXES
    at = np.flatnonzero(held.any(1))
    return at[boxes[at].sum(1) <= tau]


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, BITS // 64)


def forest(fps: np.ndarray, tau: int) -> list[tuple[int, int]]:
    """Links (indices) of a spanning forest of the graph of rows within tau bits of each other."""
    unseen, out = np.arange(len(fps)), []
    while len(unseen):
        todo, unseen = [unseen[0]], unseen[1:]
        while todo and len(unseen):
            i = todo.pop()
            hits = within(fps[unseen] ^ fps[i], tau)
            out += [(int(i), int(j)) for j in unseen[hits]]
            todo += list(unseen[hits])
            unseen = np.delete(unseen, hits)
    return out


def links(fps: DataFrame, pairs: DataFrame, spec: Spec) -> DataFrame:
    """fps (node, fp), pairs (a, b) -> the pairs within tau bits."""
    tau = spec.tau

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = pa.array(within(_matrix(batch.column("fp_a")) ^ _matrix(batch.column("fp_b")), tau))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], names=["a", "b"])

    one, two = fps.select(F.col("node").alias("a"), F.col("fp").alias("fp_a")), fps.select(F.col("node").alias("b"), F.col("fp").alias("fp_b"))
    return pairs.distinct().join(one, "a").join(two, "b").mapInArrow(far, "a long, b long")


def mixed_links(fps: DataFrame, met: DataFrame, spec: Spec) -> DataFrame:
    """fps (node, fp), met (key, node, root) -> links (a, b) that connect, with the roots, all that met within tau bits.

    Rows of one root are connected already. In a bucket only pairs of different roots are taken, so one that a single root fills
    costs nothing. In a large bucket the rows of its most frequent root are compared in blocks with the others, and these
    among themselves.
    """
    tau = spec.tau

    def block(group: pa.Table) -> pa.Table:
        nodes = group.column("node").to_numpy()
        pairs = np.array(forest(_matrix(group.column("fp")), tau), np.int64).reshape(-1, 2)
        return pa.table({"a": nodes[pairs[:, 0]], "b": nodes[pairs[:, 1]]})

    shares = met.groupBy("key", "root").agg(F.count("*").alias("n"))
    shares = shares.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("main")).where("main.n < n")
    shares = stored(shares.select("key", "n", F.col("main.root").alias("main"), F.col("main.n").alias("n_main")), "wide-mixed")
    mixed = stored(met.join(shares, "key"), "wide-met")
    cold = mixed.where(F.col("n") <= COLD).select("key", "node", "root")
    other = cold.select("key", F.col("node").alias("b"), F.col("root").alias("root_b"))
    pairs = cold.withColumnRenamed("node", "a").join(other, "key").where("a < b AND root <> root_b").select("a", "b")
    hot = mixed.where(F.col("n") > COLD).join(fps, "node")
    main, place = F.col("root") == F.col("main"), F.xxhash64("node")
    hot = hot.withColumn("few", F.ceil((F.col("n") - F.col("n_main")) / BLOCK).cast("int")).withColumn("many", F.ceil(F.col("n_main") / BLOCK).cast("int"))
    hot = hot.withColumn("own", F.when(main, F.col("few") + F.pmod(place, F.col("many"))).otherwise(F.pmod(place, F.col("few"))).cast("int"))
    with_ = F.when(main, F.sequence(F.lit(0), F.col("few") - 1)).otherwise(F.filter(F.sequence(F.lit(0), F.col("few") + F.col("many") - 1), lambda x: x != F.col("own")))
    spread = hot.select("key", "node", "fp", "own", F.explode(with_).alias("with")).select("key", "node", "fp", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"))
    return links(fps, pairs, spec).unionByName(spread.groupBy("key", "i", "j").applyInArrow(block, "a long, b long"))


def groups(fps: DataFrame, postings: DataFrame, spec: Spec) -> DataFrame:
    """fps (node, fp), postings (node, key) -> (node, root), a row per node: what is linked, directly or through others, has
    one root.

    First the rows of each bucket of SEEDS tables are compared with its smallest node, which brings large groups together
    at the cost of a pair per row; then all buckets with what is still apart in them, between roots.
    """
    sizes = postings.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("first")).where("n > 1")
    met = stored(postings.join(sizes, "key").select("key", "node", "first"), "wide-postings")
    seeds = met.where((F.shiftright("key", spec.width) < SEEDS) & (F.col("node") != F.col("first")))
    found = stored(components(links(fps, seeds.select(F.col("first").alias("a"), F.col("node").alias("b")), spec)), "wide-seeds")
    of = stored(fps.select("node").join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "wide-roots")
    between = mixed_links(fps, met.select("key", "node").join(of, "node"), spec)
    one, two = of.select(F.col("node").alias("a"), F.col("root").alias("root_a")), of.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
    between = between.join(one, "a").join(two, "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    last = stored(components(between), "wide-joined").select(F.col("node").alias("root"), F.col("root").alias("last"))
    return of.join(last, "root", "left").select("node", F.coalesce("last", "root").alias("root"))


def near_copies(docs: DataFrame, similarity: float = 0.8, recall: float = 0.95, shingle: int = 5) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, text_key, root), a row per row, repeats included.

    root names the group of texts that are linked by fingerprints within `tau` bits, directly or through others; text_key
    is a hash of the text. NULL, empty and wordless texts have the same fingerprint, all zero, and are one group. Texts with
    the same words in the same order are one group whatever their length. An empty table gives no rows; other columns are ignored.
    """
    spec = Spec(shingle, similarity, recall, width_for(docs.count()))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("text_key"))
    made = rows.mapInArrow(_fingerprints(spec), "doc_id long, text_key long, fp binary, keys array<long>")
    made = stored(made.withColumn("row", F.monotonically_increasing_id()), "wide-fingerprints")
    fps = stored(made.groupBy("fp").agg(F.min("row").alias("node")), "wide-distinct")
    postings = made.join(fps.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), F.explode(F.array_distinct("keys")).alias("key"))
    of = fps.join(groups(fps, postings, spec), "node").select("fp", "root")
    return made.select("doc_id", "text_key", "fp").join(of, "fp").select("doc_id", "text_key", "root")

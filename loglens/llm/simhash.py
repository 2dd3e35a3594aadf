"""SimHash near-duplicates, linked through a pigeonring index.

Fingerprints are cut into BOXES boxes on a ring. If two fingerprints differ in at most TAU bits, then some chain of
consecutive boxes keeps every prefix within its share of the budget, floor(length * TAU / BOXES) (the pigeonring
principle), and at least BOXES - TAU boxes are equal. The index therefore holds one row for each choice of
BOXES - TAU equal boxes; a pair that meets there must next show such a chain, and only then is its full distance taken.

Exact copies are one row per fingerprint from the start. Buckets of up to COLD fingerprints are joined pair by pair;
larger ones are compared in blocks of BLOCK by BLOCK, one task each, that return the links of a spanning forest only, so
no link between components is lost and no bucket turns into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.llm.common import shuffled, stored, table
from loglens.llm.components import components

SHINGLE, SEED = 4, 42
TAU, BOXES, CHAIN = 4, 8, 4
COLD, BLOCK = 32, 2048

WIDTH = 64 // BOXES
BUDGETS = [length * TAU // BOXES for length in range(1, BOXES + 1)]
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_OFFSETS = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64 bits; a bit is set if it is set in over half the shingles' XXH64. NULL or no word: 0."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return 0
    if len(found) < shingle:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*(found[k:] for k in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
    counts = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _OFFSETS).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    bits = 2 * counts > len(hashes)
    return int(np.packbits(bits.ravel(), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(values)], names=["doc_id", "text_key", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, text_key, fp bigint), a row per row; whole texts. text_key: a hash of the text."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("text_key")).mapInArrow(_fingerprints, "doc_id long, text_key long, fp long")


def _box(x: Column, k: int) -> Column:
    return F.shiftrightunsigned(x, k * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1).cast("long"))


def index_keys(fp: Column) -> Column:
    """An array of bigints: for each choice of BOXES - TAU boxes, its number above the bits of those boxes."""
    out = []
    for n, chosen in enumerate(combinations(range(BOXES), BOXES - TAU)):
        bits = reduce(lambda a, b: a.bitwiseOR(b), (F.shiftleft(_box(fp, k), i * WIDTH) for i, k in enumerate(chosen)))
        out.append(bits.bitwiseOR(F.lit(n << ((BOXES - TAU) * WIDTH)).cast("long")))
    return F.array(*out)


def chain_condition(a: str, b: str) -> Column:
    """Some chain of CHAIN boxes on the ring keeps each of its prefixes within the budget."""
    diff = F.col(a).bitwiseXOR(F.col(b))
    d = [F.bit_count(_box(diff, k)) for k in range(BOXES)]
    starts = []
    for i in range(BOXES):
        sums, held = F.lit(0), []
        for length in range(CHAIN):
            sums = sums + d[(i + length) % BOXES]
            held.append(sums <= BUDGETS[length])
        starts.append(reduce(lambda x, y: x & y, held))
    return reduce(lambda x, y: x | y, starts)


def linked(one: np.uint64, others: np.ndarray) -> np.ndarray:
    """Which of others are within TAU bits of one: first the chain condition, then the full distance of what it leaves."""
    diff = others ^ one
    boxes = np.bitwise_count(diff.view(np.uint8).reshape(-1, 8)) if WIDTH == 8 else np.stack([np.bitwise_count((diff >> np.uint64(k * WIDTH)) & np.uint64((1 << WIDTH) - 1)) for k in range(BOXES)], axis=1)
    viable = np.zeros(len(others), bool)
    for i in range(BOXES):
        sums, held = np.zeros(len(others), np.uint8), np.ones(len(others), bool)
        for length in range(CHAIN):
            sums = sums + boxes[:, (i + length) % BOXES]
            held &= sums <= BUDGETS[length]
        viable |= held
    at = np.flatnonzero(viable)
    return at[np.bitwise_count(diff[at]) <= TAU]


def forest(left: np.ndarray, right: np.ndarray | None) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph within left, or between left and right."""
    if right is None:
        sides = [left]
    else:
        sides = [left, right]
    unseen = [np.arange(len(s)) for s in sides]
    out = []
    while len(unseen[0]):
        todo = [(0, unseen[0][0])]
        unseen[0] = unseen[0][1:]
        while todo:
            side, i = todo.pop()
            other = 0 if right is None else 1 - side
            if not len(unseen[other]):
                continue
            hits = linked(sides[side][i], sides[other][unseen[other]])
            if len(hits):
                got = unseen[other][hits]
                unseen[other] = np.delete(unseen[other], hits)
                out += [(int(sides[side][i]), int(sides[other][j])) for j in got]
                todo += [(other, j) for j in got]
    return out


def _block(group: pa.Table) -> pa.Table:
    fps = group.column("fp").to_numpy().view(np.uint64)
    chunk, i, j = group.column("chunk").to_numpy(), group.column("i")[0].as_py(), group.column("j")[0].as_py()
    links = forest(fps[chunk == i], None if i == j else fps[chunk == j])
    pairs = np.array(links, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def links(fps: DataFrame) -> DataFrame:
    """Distinct fps (fp) -> links (a, b) that connect all fingerprints within TAU bits of each other. No join is broadcast:
    postings are many rows a fingerprint, which Spark doesn't count."""
    postings = fps.select("fp", F.explode(index_keys(F.col("fp"))).alias("key"))
    sizes = postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = stored(postings.join(shuffled(sizes), "key"), "postings")
    cold = met.where(F.col("n") <= COLD).select("key", "fp")
    pairs = cold.select("key", F.col("fp").alias("a")).join(shuffled(cold.select("key", F.col("fp").alias("b"))), "key").where("a < b")
    near = pairs.where(chain_condition("a", "b")).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= TAU).select("a", "b")
    hot = met.where(F.col("n") > COLD).withColumn("chunks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    spread = hot.select("key", "fp", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("with")).select("key", "fp", "chunk", F.least("chunk", "with").alias("i"), F.greatest("chunk", "with").alias("j"))
    blocks = spread.groupBy("key", "i", "j").applyInArrow(_block, "a long, b long")
    return near.unionByName(blocks)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, fingerprint, component_id, text_key, root).

    A row per row of docs, repeats included. fingerprint: 16 hex digits; component_id: the smallest doc_id reachable over
    links of at most TAU differing bits (NULL only if every doc_id of the component is NULL). NULL, empty and wordless
    texts share the fingerprint zero and are linked like others. An empty table gives no rows; other columns are ignored.
    root, a fingerprint, names the component even where doc_ids repeat.
    """
    fps = stored(fingerprints(docs), "fingerprints")
    own = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fps")
    roots = components(links(own.select("fp"))).withColumnRenamed("node", "fp")
    of = own.join(shuffled(roots), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = of.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of = of.join(shuffled(least), "root").select("fp", "component_id", "root")
    return fps.join(shuffled(of), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "text_key", "root")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text")).drop("text_key", "root")

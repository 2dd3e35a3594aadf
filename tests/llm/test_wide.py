import random

import numpy as np
import pyarrow as pa

from loglens.llm import wide


def sets(text, size=5):
    words = text.lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def jaccard(a, b):
    a, b = sets(a), sets(b)
    return len(a & b) / len(a | b)


def edited(words, rnd, low, high):
    """A copy with words replaced at random places, whose similarity to the original lies in the range."""
    while True:
        out = list(words)
        for at in rnd.sample(range(len(out)), max(1, round(len(out) * rnd.uniform(0.004, 0.05)))):
            out[at] = f"new{rnd.random()}"
        if low <= jaccard(" ".join(words), " ".join(out)) < high:
            return " ".join(out)


def test_fingerprint_is_a_majority_over_distinct_shingles():
    for text in ("One", "a b c d e", "a b c d e f g A B", "é ü  \n x y z w", "u " * 9000):
        hashes = wide.shingles(text, 5)
        assert len(hashes) == len(sets(text))
        z = [[int(h) + (k + 1) * 0x9E3779B97F4A7C15 & 2**64 - 1 for k in range(8)] for h in hashes]
        mixed = []
        for row in z:
            out = 0
            for k, x in enumerate(row):
                x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & 2**64 - 1
                x = (x ^ x >> 27) * 0x94D049BB133111EB & 2**64 - 1
                out |= (x ^ x >> 31) << 64 * k
            mixed.append(out)
        want = sum(1 << b for b in range(512) if 2 * sum(m >> b & 1 for m in mixed) > len(mixed))
        assert int.from_bytes(wide.fingerprint(text), "little") == want
    assert wide.fingerprint(None) == wide.fingerprint(" \n") == bytes(64)
    long = " ".join(f"w{k}" for k in range(20_000))
    assert (wide.votes(wide.shingles(long, 5)) > 0).all()


def test_pigeonring_never_loses_a_pair():
    rnd = np.random.default_rng(3)
    tau = wide.Spec().tau
    rows = np.zeros((3000, 512), bool)
    for row in rows:
        row[rnd.permutation(512)[: rnd.integers(tau - 40, tau + 40)]] = True
    got = wide.within(np.packbits(rows, axis=1, bitorder="little").view(np.uint64), tau)
    assert got.tolist() == np.flatnonzero(rows.sum(1) <= tau).tolist()


def test_forest_connects_what_brute_force_does():
    rnd = np.random.default_rng(4)
    centres = rnd.integers(0, 2, (6, 512)).astype(bool)
    rows = np.array([c ^ (rnd.random(512) < 0.11) for c in centres for _ in range(12)])
    fps, tau = np.packbits(rows, axis=1, bitorder="little").view(np.uint64), wide.Spec().tau

    def classes(pairs):
        of = list(range(len(rows)))
        for a, b in pairs:
            x, y = of[a], of[b]
            of = [min(x, y) if v in (x, y) else v for v in of]
        return of

    want = [(i, j) for i in range(len(rows)) for j in range(i) if (rows[i] ^ rows[j]).sum() <= tau]
    assert classes(wide.forest(fps, tau)) == classes(want)


def test_near_copies_are_found_and_others_left(spark):
    rnd = random.Random(11)
    rows, bins = [], [(0.80, 0.85), (0.85, 0.90), (0.90, 0.95), (0.95, 1.0)]
    for k in range(400):
        words = [f"v{rnd.randrange(3000)}" for _ in range(300)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, edited(words, rnd, *bins[k % 4]))]
    shared = [f"p{k}" for k in range(60)]
    rows += [(10_000 + k, " ".join(shared + [f"q{k}x{i}" for i in range(90)])) for k in range(40)]
    got = {r.doc_id: r.root for r in wide.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for n, _ in enumerate(bins):
        assert sum(got[2 * k] == got[2 * k + 1] for k in range(n, 400, 4)) >= 90
    assert len({got[2 * k] for k in range(400)} | {got[10_000 + k] for k in range(40)}) == 440


def test_one_large_group_of_near_copies(spark, monkeypatch):
    rnd = random.Random(12)
    words = [f"v{rnd.randrange(3000)}" for _ in range(200)]
    rows = [(k, edited(words, rnd, 0.9, 1.01)) for k in range(150)] + [(1000 + k, " ".join(f"z{k}y{i}" for i in range(50))) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(wide, "COLD", 4)
    monkeypatch.setattr(wide, "BLOCK", 20)
    got = {r.doc_id: r.root for r in wide.near_copies(docs).collect()}
    assert len({got[k] for k in range(150)}) == 1 and len(set(got.values())) == 51


def test_odd_rows(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(5, base, "x"), (3, base.upper(), None), (9, base, "y"), (9, base, "y"), (1, None, "n"), (8, "", "n"), (2, " \n", "n"), (None, base, "n"), (4, "alone here", "n"), (6, "word " * 300_000, "n"), (7, "word " * 10, "n")]
    got = wide.near_copies(spark.createDataFrame(rows, "doc_id long, text string, root string")).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.root, []).append(r.doc_id)
    assert sorted((sorted(v, key=str) for v in by.values()), key=str) == [[1, 2, 8], [3, 5, 9, 9, None], [4], [6, 7]]
    assert wide.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_workers_give_memory_back_after_each_batch(monkeypatch):
    given = []
    monkeypatch.setattr(wide, "release", lambda: given.append(1))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["a b c"], "text_key": [2]})
    assert sum(b.num_rows for b in wide._fingerprints(wide.Spec())(iter([batch, batch]))) == 2 and len(given) == 2


def test_keys_grow_with_the_texts_so_that_chance_meetings_do_not():
    for texts in (1, 51_282, 256_410, 15_000_000, 3_000_000_000):
        assert (wide.WEAK + 1) * texts / 2 ** wide.width_for(texts) <= (wide.WEAK + 1) / 256
    assert wide.Spec(width=26).places().shape[0] > wide.Spec(width=24).places().shape[0]


def test_a_large_group_needs_few_links(spark, monkeypatch):
    rnd, real, seen = random.Random(13), wide.components, []
    words = [f"v{rnd.randrange(3000)}" for _ in range(200)]
    rows = [(k, edited(words, rnd, 0.9, 1.01)) for k in range(200)] + [(1000 + k, " ".join(f"z{k}y{i}" for i in range(50))) for k in range(50)]

    def counted(edges):
        seen.append(edges.where("a <> b").distinct().count())
        return real(edges)

    monkeypatch.setattr(wide, "components", counted)
    got = {r.doc_id: r.root for r in wide.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len({got[k] for k in range(200)}) == 1 and len(set(got.values())) == 51
    assert sum(seen) < 200 * 4 * 3


def test_what_the_first_tables_leave_apart_is_found_in_the_others(spark):
    rnd = random.Random(14)
    nodes = np.sort(rnd.sample(range(10_000), 90)).astype(np.int64)
    fps = [bytes([0xFF] * (k % 3 * 20) + [0] * (64 - k % 3 * 20)) for k in range(90)]
    spec = wide.Spec()
    keys = [(int(n), (wide.SEEDS + 1 << spec.width) + key) for k, n in enumerate(nodes) for key in (7, 8 + k % 5)]
    keys += [(int(n), key) for k, n in enumerate(nodes) if k % 3 == 0 for key in (1, 2)]
    got = wide.groups(spark.createDataFrame([(int(n), f) for n, f in zip(nodes, fps)], "node long, fp binary"), spark.createDataFrame(keys, "node long, key long"), spec)
    got = {r.node: r.root for r in got.collect()}
    assert len(got) == 90 and {got[int(n)] for n in nodes} == {int(nodes[k]) for k in range(3)}
    assert all(got[int(n)] == nodes[k % 3] for k, n in enumerate(nodes))

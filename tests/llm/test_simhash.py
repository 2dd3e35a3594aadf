import random
import re

import numpy as np
import xxhash

from loglens.llm import components, simhash


def slow_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= simhash.TAU:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprint_matches_definition(spark):
    texts = ["", None, "  \n", "One", "one TWO three", "a b c d", "É À b c d\x0be f", "x y " * 500, "  a\x1cb c d e f"]
    assert [simhash.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]
    native = spark.sql("select xxhash64('one two three') h").first().h
    assert native & (2**64 - 1) == xxhash.xxh64_intdigest("one two three", 42)


def test_links_find_every_component_cold_and_hot(spark, monkeypatch):
    rnd = random.Random(3)
    fps = [rnd.getrandbits(64) for _ in range(60)]
    for centre in list(fps[:12]):
        for _ in range(30):
            x = centre
            for b in rnd.sample(range(64), rnd.randint(1, 6)):
                x ^= 1 << b
            fps.append(x)
    fps = sorted(set(fps))
    want = slow_components(fps)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    for cold, block in ((32, 2048), (4, 7)):
        monkeypatch.setattr(simhash, "COLD", cold)
        monkeypatch.setattr(simhash, "BLOCK", block)
        edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"))
        got = {r.node: r.root for r in simhash.components(edges).collect()}
        classes = {}
        for s, w in zip(signed, want, strict=True):
            classes.setdefault(w, set()).add(got.get(s, s))
        assert all(len(v) == 1 for v in classes.values())
        assert len({next(iter(v)) for v in classes.values()}) == len(classes)


def test_pigeonring_never_loses_a_pair():
    rnd = random.Random(5)
    for _ in range(3000):
        a = rnd.getrandbits(64)
        b = a
        for bit in rnd.sample(range(64), rnd.randint(0, 5)):
            b ^= 1 << bit
        assert len(simhash.linked(np.uint64(a), np.array([b], np.uint64))) == ((a ^ b).bit_count() <= simhash.TAU)


def test_components_on_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (3, 2)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in [100, *range(200, 250)]}


def test_near_duplicates_with_odd_rows(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(5, base, "x"), (3, base, None), (9, base, "y"), (9, base, "y"), (1, None, "n"), (8, "", "n"), (2, " \n", "n"), (None, base, "n"), (4, "alone here now yes", "n")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id string")).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.fingerprint): r.component_id for r in got}
    assert {v for (d, _), v in by.items() if d in (5, 3, 9, None)} == {3}
    assert {v for (d, _), v in by.items() if d in (1, 8, 2)} == {1}
    assert [r.fingerprint for r in got if r.doc_id == 5] == [f"{slow_fingerprint(base):016x}"]
    assert by[(1, "0" * 16)] == 1 and [v for (d, _), v in by.items() if d == 4] == [4]
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_large_side_is_broadcast(spark, monkeypatch):
    """Postings are 70 rows a fingerprint, which Spark takes at the size of the fingerprints' file."""
    plans = []

    def recorded(keep):
        return lambda df, name: plans.append((name, df)) or keep(df, name)

    monkeypatch.setattr(simhash, "stored", recorded(simhash.stored))
    monkeypatch.setattr(components, "stored", recorded(components.stored))
    monkeypatch.setattr(components, "FEW", -1)
    docs = spark.createDataFrame([(k, f"a b c d e {k // 2}") for k in range(40)], "doc_id long, text string")
    plans.append(("result", simhash.near_duplicates(docs)))
    for name, df in plans:
        assert "Broadcast" not in df._jdf.queryExecution().sparkPlan().toString(), name
    assert {"postings", "edges", "result"} <= {name for name, _ in plans}

import hashlib
import random
import zlib

from loglens.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, n_convs string"


def sha(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def slow(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, sha(role or "", text or ""), role or "", text or ""))
    convs = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        family = c - (c % 100 if c >= 0 else -(-c % 100))
        made[c] = convs.get(family, [])[:h] + own[h:]
    members = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), set()).add(c)
    out = []
    for node, inside in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = lambda n: [m for m in members if len(m) == len(n) + 1 and m[: len(n)] == n]  # noqa: E731, B023
        ends = sorted(c for c in inside if len(made[c]) == len(node))
        out.append((
            min(inside), len(node), min(members[node[:-1]]) if node else None, len(inside), len(kids(node)), sum(not kids(n) for n in below),
            sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def run(spark, path, rows):
    spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA).repartition(3).write.parquet(str(path / "conversations.parquet"))
    got = trie.op11_trie(spark, str(path))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_equals_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK_BITS", 2)  # several runs of ends on one node
    rnd = random.Random(3)
    say = lambda: (rnd.choice(["user", "assistant"]), rnd.choice(["a", "b", "é🎉", ""]))
    rows = []
    for c in [*range(100, 125), *range(300, 306), -7, -200, 0, 2**40]:
        rows += [(c, t, *say()) for t in range(rnd.randrange(1, 6))]
    rows += [(c, t, "user", "hot") for c in range(1000, 1030) for t in range(3)]  # one conversation, many times
    rows += [(c, t, "user", "hot" if t < c % 9 else f"own {c}") for c in range(1030, 1050) for t in range(9)]  # each leaves it later
    rows += [(500, None, None, None), (500, 3, None, "x"), (500, 3, "user", "x"), (500, 3, "user", "x"), (None, 1, "user", "lost"), (501, 0, "user", "long " * 3_000)]
    assert run(spark, tmp_path, rows) == slow(rows)


def test_turnless_lone_and_empty(spark, tmp_path):
    lone = [(c, 0, "user", "x") for c in range(7001, 7040)]  # no first conversation: most keep nothing
    assert run(spark, tmp_path / "a", lone) == slow(lone)
    assert run(spark, tmp_path / "b", []) == []
    assert run(spark, tmp_path / "c", [(None, 0, "user", "x")]) == []


def test_tall_tree(spark, tmp_path):
    """Each conversation follows the one before it for one turn more: a tree of chains of height 40."""
    rows = [(700 + k, t, "u", str(min(t, k))) for k in range(40) for t in range(k + 6)]
    got = run(spark, tmp_path, rows)
    assert got == slow(rows)

import math
import random

import pytest

from loglens.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, anchor_id string, score double"


def slow(rows):
    best = {}
    for vec, x, label in rows:
        if vec is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        own = ((label + 1) % 10 if vec % 7 == 0 else label, [float(c) for c in x])
        best[vec] = min(best.get(vec, own), own)
    width = max((len(x) for _, x in best.values()), default=0)
    ints = {v: (label, [math.floor(256 * c) for c in x] + [0] * (width - len(x))) for v, (label, x) in best.items()}
    out = []
    for a, (label, x) in ints.items():
        if a % 50:
            continue
        scored = sorted(((-sum(p * q for p, q in zip(x, y, strict=True)), v, own == label) for v, (own, y) in ints.items() if v != a))
        for ps, p, _ in [s for s in scored if s[2]][:5]:
            fit = [s for s in scored if not s[2] and 50 * -ps <= 100 * -s[0] <= 95 * -ps][:3]
            out += [(a, p, k + 1, v, -ps, -ns) for k, (ns, v, _) in enumerate(fit)]
    return sorted(out)


def run(spark, path, rows):
    spark.createDataFrame([(v, x, label, "clash", 0.0) for v, x, label in rows], SCHEMA).write.parquet(str(path / "embeddings.parquet"))
    got = negatives.op13_negatives(spark, str(path))
    assert got.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    return sorted(tuple(r) for r in got.collect())





def test_equals_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(negatives, "LEAST_BLOCK", 64)  # several blocks of rows
    rnd = random.Random(5)
    centre = [[rnd.gauss(0, 0.2) for _ in range(6)] for _ in range(10)]
    quarter = lambda c: round(c * 64) / 64  # floats hold these exactly; many scores tie
    rows = [(k, [quarter(c + rnd.gauss(0, 0.15)) for c in centre[(k * 7) % 10 if k % 3 else 4]], (k * 7) % 10 if k % 3 else 4) for k in range(-100, 320)]
    rows += [(1000 + k, [0.25, 0.5, 0.0, -0.25, 0.0, 0.0], k % 2) for k in range(150)]  # one common vector of two labels
    rows += [(5000, None, 1), (5050, [0.5] * 6, None), (5100, [None] * 6, 2), (5150, [math.nan] * 6, 2), (5200, [math.inf] * 6, 2), (None, [0.5] * 6, 1)]
    rows += [(5250, [0.5, 0.25], 3), (5300, [], 3), (50, [9.0] * 6, 9), rows[3], rows[3]]
    assert run(spark, tmp_path, rows) == slow(rows)


def test_empty_lonely_and_large(spark, tmp_path):
    assert run(spark, tmp_path, []) == []
    rows = [(0, [1.0], 1), (1, [1.0], 2)]
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert negatives.mine(frame(rows)).collect() == []
    big = [(50, [2.0**20, 3.0], 1), (1, [2.0**20, 1.0], 1), (2, [2.0**19 + 1, 5.0], 2), (3, [2.0**19 + 1, 5.0], 3), (4, [2.0**19, 0.0], 3)]
    assert sorted(tuple(r) for r in negatives.mine(frame(big)).collect()) == slow(big)  # beyond what doubles add exactly
    with pytest.raises(ValueError, match="fit a long"):
        negatives.mine(frame([(0, [1e30], 1)]))


def test_no_join_is_broadcast(spark, tmp_path, monkeypatch):
    """What is copied to each block of rows is many times the size that Spark takes it at."""
    plans, keep = [], negatives.stored
    monkeypatch.setattr(negatives, "stored", lambda df, name: plans.append((name, df)) or keep(df, name))
    rows = spark.createDataFrame([(k, [k % 5 + 1.0, k % 3 + 1.0], k % 2) for k in range(200)], "vec_id long, embedding array<float>, label int")
    plans.append(("result", negatives.mine(rows)))
    for name, df in plans:
        assert "Broadcast" not in df._jdf.queryExecution().sparkPlan().toString(), name
    assert {"negatives-state", "negatives-positives", "result"} <= {name for name, _ in plans}

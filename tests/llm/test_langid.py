import zlib

import numpy as np
import pytest

from loglens.llm import langid


def test_gradients_match_finite_differences():
    net = langid.Network(["a", "b", "c"], hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = np.random.default_rng(0).integers(97, 105, (7, 5)).astype(np.uint8)
    y, mask, weight = np.array([0, 1, 2, 2, 1]), np.ones((7, 5)), np.ones(5)
    _, grad = net.gradients(x, y, mask.copy(), weight)
    for k, v in net.p.items():
        at = np.unravel_index(np.argmax(np.abs(grad[k])), v.shape)
        old, sides = v[at], []
        for e in (0.01, -0.01):
            v[at] = old + e
            sides.append(net.gradients(x, y, mask.copy(), weight)[0])
        v[at] = old
        assert grad[k][at] == pytest.approx((sides[0] - sides[1]) / 0.02, rel=1e-2)


def test_held_out_accuracy_and_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    net = langid.fit(docs)
    rows = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(1, None, "en"), (2, "", None), (3, "123 ###", "fr"), (None, "the and of that", "en"), (5, "the and " * 40_000, "en")], "doc_id long, text string, lang string"))
    got = langid.predict(rows, net, ("doc_id", "lang", "text")).collect()
    assert len(got) == rows.count()
    assert {(r.lang_pred, r.score) for r in got if r.text in (None, "", "123 ###")} == {("und", 0.0)}
    held = [r for r in got if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r.text and any(c.isalpha() for c in r.text)]
    assert len(held) > 40 and sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    assert net.positions("the that") and len(net.positions("é")) == 2 and net.positions("") == []


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in langid.predict(docs, langid.fit(docs)).collect()] == [(1, "und", 0.0)]
    assert langid.predict(docs.limit(0), langid.fit(docs)).count() == 0


def test_held_out_is_the_checksum(spark):
    from pyspark.sql import functions as F

    got = spark.range(200).select("id", langid.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)

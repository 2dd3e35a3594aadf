import hashlib
import random

import corpus_pipeline
import sentencepiece
from test_wide import edited

from loglens.llm import decontaminate, pieces, secrets


def test_stages_keep_clean_documents_and_take_effect(spark, tmp_path):
    item = " ".join(f"bench{i}" for i in range(15))
    clean = {k: f"the and of that {k} " + " ".join(f"word{k}x{i}" for i in range(80)) for k in range(6)}
    rows = [(k, t, "en", "s", len(t)) for k, t in clean.items()]
    rows += [(10, clean[3], "en", "s", 5), (11, clean[3], None, None, None), (11, clean[3], None, None, None), (12, "1234 !!", "en", "s", 7), (13, None, "en", "s", 0), (14, "the and " + item + " of that", "en", "s", 9), (15, 'the and of token = "abcdef0123456789" that', "en", "s", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
        seen.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
    assert seen == [[*range(6), 10, 11, 11, 14, 15], [*range(6), 14, 15], [*range(6), 15], [*range(6), 15], [*range(6), 15]]
    masked = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "s3")).collect()}
    assert masked[15] == "the and of [secret:assign]\" that" and all(masked[k] == t for k, t in clean.items())
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for r in docs.collect():
        assert list(r.ids) == sp.encode(masked[r.doc_id]) and r.n_pieces == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(masked[r.doc_id].encode()).hexdigest()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 7


def test_near_copies_of_every_similarity_go(spark):
    rnd = random.Random(21)
    rows = []
    for k in range(120):
        words = [f"v{rnd.randrange(2000)}" for _ in range(250)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, edited(words, rnd, *[(0.8, 0.85), (0.85, 0.9), (0.9, 0.95)][k % 3]))]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert {2 * k for k in range(120)} <= kept
    assert all(sum(2 * k + 1 in kept for k in range(n, 120, 3)) <= 4 for n in range(3))


def test_stage_with_odd_rows(spark):
    text = " ".join(f"w{k}" for k in range(100))
    rows = [(None, text), (4, text), (4, text), (4, "other words here"), (5, None), (3, ""), (None, "x y"), (6, "long " * 200_000)]
    docs = spark.createDataFrame([(k, t, None, None, None) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(4, text), (4, "other words here"), (3, ""), (None, "x y"), (6, "long " * 200_000)], key=str)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_proximity_and_phrases(spark):
    texts = ["a b c d e f", "f x e", None, "", "c a", "b b a z z b"]
    index = decontaminate.forward_index(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    ids = {r.row_id: r.doc_id for r in index.collect()}
    got = decontaminate.proximity_matches(index, spark.createDataFrame([(1, ["a", "b"]), (2, ["f", "e"]), (3, ["zz"])], "query_id long, terms array<string>"), 3)
    assert sorted((ids[r.row_id], r.query_id, r.start) for r in got.collect()) == [(0, 1, 0), (0, 2, 4), (1, 2, 0), (5, 1, 0), (5, 1, 1)]
    hits = decontaminate.phrase_matches(index, spark.createDataFrame([(7, "B c"), (8, "b b a"), (9, "")], "item_id long, text string"))
    assert sorted((ids[r.row_id], r.item_id, r.start, r.end) for r in hits.collect()) == [(0, 7, 1, 2), (5, 8, 0, 2)]


def test_ledger_scans_only_unseen_pairs(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    make = lambda rows: spark.createDataFrame(rows, "path string, version int, text string")
    one = make([("a", 1, "token=abcdefgh"), ("b", 1, "token=abcdefgh"), ("c", 1, None), (None, None, "x")])
    base = {"base/1": secrets.BASE_RULES}
    assert sorted(len(r.spans) for r in secrets.scan(one, ledger, base).collect()) == [0, 0, 1, 1]
    assert spark.read.parquet(ledger).count() == 3
    two = make([("a", 1, "token=abcdefgh"), ("a", 2, "AKIA" + "B" * 16), ("a", 3, "token=abcdefgh")])
    assert sorted((r.version, len(r.spans)) for r in secrets.scan(two, ledger, base).collect()) == [(1, 1), (2, 1), (3, 1)]
    assert spark.read.parquet(ledger).count() == 4
    secrets.scan(two, ledger).count()
    assert {(r.rule_version, r["count"]) for r in spark.read.parquet(ledger).groupBy("rule_version").count().collect()} == {("base/1", 4), ("more/2", 2)}
    assert secrets.scan(two.limit(0), ledger).count() == 0

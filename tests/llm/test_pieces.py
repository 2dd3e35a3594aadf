import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from loglens.llm import pieces

TEXTS = ["", None, " ", "   ", "Hello world", "  two  spaces ", "line\nbreak\n\n next", "naïve ÉTÉ 🎉 漢字 ▁ x\ty", "a" * 500, "the,then.the!!! token = \"abc\"", "x1x1" * 60, "!!??## ***", "supercalifragilistic " * 30, "\x00\x01é́"]


def random_texts(n):
    rnd = random.Random(4)
    return ["".join(rnd.choice("aenrst  ,.\néouTH'-1") for _ in range(rnd.randint(1, 200))) for _ in range(n)]


def library(kind):
    proto = sentencepiece_model_pb2.ModelProto()
    with open(pieces.MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = kind
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


@pytest.mark.parametrize("block_chars", [24_000_000, 900])
def test_bpe_equals_the_library_and_decodes(spark, monkeypatch, block_chars):
    monkeypatch.setattr(pieces, "BLOCK_CHARS", block_chars)
    texts = TEXTS + random_texts(60) + [" lead", "tail ", "a  b", "▁▁ x▁ y", "w" * 59, "w" * 60, "w" * 61, "z9" * 400, "漢字" * 40] + ["x" + " " * k + "y" for k in range(3, 40)]
    model, sp = pieces.load(), library(pieces.BPE)
    rows = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
    encoded = pieces.encode(rows.withColumn("unit", F.lit("clash")), model)
    got = {r.row_id: list(r.ids) for r in encoded.collect()}
    assert [got[k] for k in range(len(texts))] == [sp.encode(t or "") for t in texts]
    back = {r.row_id: r.text for r in pieces.decode(encoded, model).collect()}
    assert [back[k] for k in range(len(texts))] == [(t or "").replace("▁", " ") for t in texts]


def test_unigram_fold_finds_the_best_path(spark):
    texts = [t for t in TEXTS if t] + random_texts(20)
    model, sp = pieces.load(kind=pieces.UNIGRAM), library(pieces.UNIGRAM)
    got = {r.row_id: list(r.ids) for r in pieces.encode(spark.createDataFrame(list(enumerate(texts)), "row_id long, text string"), model).collect()}
    index = {p: (k, s) for p, k, s in model.pieces}
    score = {k: s for _, k, s in model.pieces}
    total = lambda ids: sum(score.get(i, 0) for i in ids)
    for k, t in enumerate(texts):
        units = re.split(model.cut, pieces.SPACE + t.replace(" ", pieces.SPACE))
        assert total(got[k]) == total(i for u in units if u for i in pieces.segment(u, model, index)), t
        if not any(i in model.byte_ids for i in got[k]):
            assert total(got[k]) >= total(sp.encode(t)), t


def test_repeated_rows_split_a_block(spark, monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK_CHARS", 300)
    model, text = pieces.load(), "the same words again and again, " * 5
    rows = spark.createDataFrame([(1, text)] * 40 + [(None, text), (2, None), (3, "other")], "row_id long, text string").repartition(3)
    got = pieces.encode(rows, model).collect()
    ids = library(pieces.BPE).encode(text)
    assert len(got) == 43 and sum(list(r.ids) == ids for r in got) == 41
    assert {r.row_id: len(r.ids) for r in got if r.row_id in (2, 3)} == {2: 0, 3: len(library(pieces.BPE).encode("other"))}


def test_models_that_come_out_differently_are_refused(tmp_path):
    proto = sentencepiece_model_pb2.ModelProto()
    with open(pieces.MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    for k, change in enumerate([lambda p: setattr(p.pieces[500], "type", 4), lambda p: setattr(p.normalizer_spec, "add_dummy_prefix", False)]):
        changed = sentencepiece_model_pb2.ModelProto()
        changed.CopyFrom(proto)
        change(changed)
        (tmp_path / f"{k}.model").write_bytes(changed.SerializeToString())
        with pytest.raises(ValueError):
            pieces.load(str(tmp_path / f"{k}.model"))


def test_empty_table(spark):
    assert pieces.encode(spark.createDataFrame([], "row_id long, text string"), pieces.load()).count() == 0


def test_query_digests(spark, tmp_path):
    texts = [*TEXTS, "same", "same"]
    spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    sp = library(pieces.BPE)
    for r in pieces.op6_sentencepiece(spark, str(tmp_path)).collect():
        ids = sp.encode(texts[r.doc_id] or "")
        text = (texts[r.doc_id] or "").replace("▁", " ")
        assert (r.n_pieces, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest())
        assert (r.decoded_chars, r.decoded_sha256) == (len(text), hashlib.sha256(text.encode()).hexdigest())


@pytest.mark.parametrize("size", [16_000_000, 50])
def test_texts_are_cut_where_the_expression_cuts(monkeypatch, size):
    monkeypatch.setattr(pieces, "SLICE_BYTES", size)
    rnd, cut = random.Random(5), pieces.load().cut
    texts = [*TEXTS, *random_texts(200), *("".join(rnd.choice("aé.,'\n ▁漢") for _ in range(rnd.randint(0, 30))) for _ in range(2000))]
    for given in (texts, [t for t in texts if "\x01" not in (t or "")], [], [None]):
        column, got = pa.array(given, pa.string()), []
        for first, units, ends in pieces._cutter(cut)(column):
            assert first == len(got)
            got += [units[a:b].to_pylist() for a, b in zip([0, *ends], ends, strict=False)]
        assert got == [[u for u in re.split(cut, pieces.SPACE + t.replace(" ", pieces.SPACE)) if u] if t else [] for t in given]


def test_units_leave_a_task_once_with_all_their_blocks(monkeypatch):
    monkeypatch.setattr(pieces, "GROUP_BLOCKS", 120)
    blocks = [0, 59, 60, 119, 120, 0]
    batch = pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(["one two one"] * 5 + [None])], names=["block", "text"])
    rows = [r for b in pieces._units(pieces.load().cut, 2)(iter([batch])) for r in b.to_pylist()]
    assert sorted((r["unit"], r["first"], r["bits0"], r["bits1"]) for r in rows) == sorted(
        (u, *x) for u in ("▁one", "▁two") for x in ((0, 1 | 1 << 59, 1 | 1 << 59), (120, 1, 0))
    )

import io
import json
import os
import random
import zipfile

import pytest

from loglens.sources import exports

CONVS = [{"id": "a", "mapping": {"x": 'quote " and \\ [,]{}'}}, {"id": "é🎉", "n": [1, [2, {"z": "\\\\"}]]}, "text, with ] inside", 5, None, [], {}, [[]], {"long": "\\\"" * 5_000}]


def whole(data, **kw):
    return [(k, json.loads(t)) for k, t in exports.elements(io.BytesIO(data), **kw)]


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 64, 1 << 20])
def test_splitter_at_every_chunk_size(chunk):
    for data in (json.dumps(CONVS), json.dumps(CONVS, indent=2, ensure_ascii=False), "  [\n]", "[1]", json.dumps([CONVS] * 3)):
        want = list(enumerate(json.loads(data)))
        assert whole(data.encode(), chunk=chunk) == want


def test_ranges_cover_each_element_once():
    rnd = random.Random(4)
    data = json.dumps([rnd.choice(CONVS[:-1]) for _ in range(40)], ensure_ascii=False).encode()
    for step in (7, 50, 500, len(data)):
        got = [x for at in range(0, len(data), step) for x in whole(data, start=at, stop=at + step, chunk=100)]
        assert got == list(enumerate(json.loads(data)))


def test_what_is_no_array():
    for bad in (b"", b"  ", b'{"a": [1]}', b"5"):
        with pytest.raises(exports.NotArray):
            list(exports.elements(io.BytesIO(bad)))
    for bad in (b"[1", b'["a', b"[1] x", b'[{"a": 1}'):
        with pytest.raises(ValueError, match="array"):
            list(exports.elements(io.BytesIO(bad)))
    assert [t for _, t in exports.elements(io.BytesIO(b"[1,,2,]"))] == [b"1", b"", b"2", b""]  # none of them JSON


def test_files_and_conversations(spark, tmp_path, monkeypatch):
    chat = [{"id": str(k), "mapping": {"n": {"message": "x" * (k * 37 % 900)}}} for k in range(300)]
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("in/conversations.json", json.dumps(chat))
        z.writestr("in/coverage.json", '{"all":true}')
    with zipfile.ZipFile(tmp_path / "none.zip", "w") as z:
        z.writestr("other.json", "[]")
    with zipfile.ZipFile(tmp_path / "large.zip", "w") as z:
        z.writestr("conversations.json", "[]")
        z.writestr("coverage.json", '"' + "x" * exports.MAX_COVERAGE + '"')
    (tmp_path / "b.json").write_text(json.dumps([{"uuid": "u", "chat_messages": []}]))
    for name, text in {"trailing.json": '[{"mapping":{}},]', "cut.json": '[{"mapping":{}}', "object.json": '{"mapping":{}}', "scalars.json": "[1]", "empty.json": "[]", "broken.zip": "PK", "text.json": "[{'a'}]"}.items():
        (tmp_path / name).write_text(text)
    found = exports.candidates(spark, [str(tmp_path)])
    assert {os.path.basename(r.path) for r in found.collect()} == set(os.listdir(tmp_path))
    about = {os.path.basename(r.path): (r.readable, r.agent, r.coverage) for r in exports.inspected(spark, [r.path for r in found.collect()] + [str(tmp_path / "gone.json")]).collect()}
    unread = (False, None, None)
    assert about == {"a.zip": (True, "chatgpt", '{"all": true}'), "none.zip": (True, None, None), "large.zip": unread, "b.json": (True, "claude-ai", None), "trailing.json": unread, "cut.json": unread, "object.json": (True, None, None), "scalars.json": (True, None, None), "empty.json": (True, None, None), "broken.zip": unread, "text.json": unread, "gone.json": unread}
    size = len(json.dumps(chat))
    got = exports.conversations(spark, [(str(tmp_path / "a.zip"), size)], 10_000)
    assert got.rdd.getNumPartitions() == -(-size // 10_000) > 5
    assert sorted((r.k, r.line) for r in got.collect()) == [(k, json.dumps(c, sort_keys=True)) for k, c in enumerate(chat)]

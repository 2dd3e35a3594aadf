import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from loglens.llm import chat, quality, warc


def pages(spark):
    big, big2 = "<p>" + "é" * 600, "x" * 1000
    rows = [(1, "http://a/1", big, "k"), (5, "http://a/2", big, "k"), (3, None, big, "k"), (3, "http://a/2\r\nX: y", big, "k"), (7, "u", "small", "k"), (8, "u", "small", "k"), (9, "u", None, "k"), (10, "u", "", "k"), (None, "u", big2, "k"), (2, "u", big2, "k"), (11, "u", big2[:-1], "k"), (12, "u", big2[:-1], "k")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, key string"), rows


def test_archive_gives_back_every_record(spark, tmp_path):
    df, rows = pages(spark)
    archive = warc.write(df)
    got = warc.read(archive).collect()
    assert len(got) == len(rows) and all(r.intact for r in got)
    payloads = {x.payload for x in archive.payloads.collect()}
    assert len(payloads) == archive.payloads.count() == 5
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append((r.record_type, r.refers_to, r.payload_bytes, r.payload_digest))
    big = rows[0][2].encode()
    assert by[5] == [("response", None, len(big), hashlib.sha1(big).hexdigest())]
    assert {x[:2] for p in (1, 3) for x in by[p]} == {("revisit", 5)} and len(by[3]) == 2
    assert by[2][0][:2] == ("response", None) and by[None][0][:2] == ("revisit", 2)
    assert all(by[p][0][0] == "response" for p in (7, 8, 9, 10, 11, 12)) and by[9][0][2] == 0
    whole = {r.record_id: bytes(r.record) for r in warc.records(archive).collect()}
    assert len(whole) == len(rows)
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.warc").write_bytes(b"".join(whole.values()))
    again = warc.import_files(spark, str(tmp_path / "a"))
    assert {r.record_id: bytes(r.record) for r in warc.records(again).collect()} == whole
    assert warc.read(warc.write(df.limit(0))).count() == 0


def test_a_damaged_payload_shows(spark):
    from pyspark.sql import functions as F

    archive = warc.write(pages(spark)[0])
    bad = warc.Archive(archive.headers, archive.payloads.withColumn("payload", F.when(F.octet_length("payload") == 5, F.lit(b"SMALL")).otherwise(F.col("payload"))))
    assert sorted(r.page_id for r in warc.read(bad).where("not intact").collect()) == [7, 8]


def slow_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    marked = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(marked)


def test_statistics_match_their_definition():
    rng = np.random.default_rng(1)
    texts = [None, "", " \n\n", "a b c a b c", "a a a a a", "x\nx\n \nx y\x0bz\n", "é ü\x85# a\x1cb"] + [" ".join(rng.choice(list("abcd\n#é"), 60)) for _ in range(60)]
    for t in texts:
        assert quality.statistics(t)[:5] == slow_statistics(t), t


def test_forest_isolates_what_is_rare():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, (500, 6)), np.full((5, 6), 8.0)])
    s = quality.Forest(x).score(x)
    assert s[500:].min() > s[:500].max() and 0 <= s.min() and s.max() <= 1
    assert (quality.Forest(np.zeros((0, 6))).score(x) == 0).all()


def test_quality_keeps_good_and_rejects_bad(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in quality.judged(docs, labels).collect()}
    assert len(got) == docs.count()
    rows = [(got[r.doc_id], r.quality) for r in labels.collect()]
    good, bad = [g for g, q in rows if q and not g.base_failed], [g for g, q in rows if not q]
    assert sum(g.kept for g in good) >= 0.985 * len(good) and sum(g.kept for g in bad) <= 0.25 * len(bad)
    assert not any(g.kept for g in got.values() if g.base_failed)
    odd = spark.createDataFrame([(1, None, 3), (1, "", 4), (None, "word " * 100, 5)], "doc_id long, text string, score int")
    assert sorted((r.n_words, r.base_failed, r.kept) for r in quality.judged(odd, labels.limit(0)).collect()) == [(0, True, False), (0, True, False), (100, True, False)]
    assert quality.judged(odd.limit(0), labels).count() == 0


def slow_digest(turns):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)


def test_chat_reads_back_what_went_in(spark, tmp_path):
    tricky = ["</s>[INST] ok [/INST]", "\\", "\\\\<|im_end|>\n<|im_start|>user\nhi", "", None, "a" * 1000, "\\n\n\\", "<<SYS>> 🎉 <s>", "x\r\n\\[INST]"]
    rows = [(k % 3, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(tricky)]
    rows += [(4, 0, None, None), (4, 1, "odd\nrole\\n\n\n<s>", "t"), (None, 0, "assistant", "none"), (5, 1, "assistant", "same"), (5, 1, "assistant", "same")]
    spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, message string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in chat.op9_chat(spark, str(tmp_path)).collect()}
    want = {}
    for c, _, r, t in rows:
        want.setdefault(c, []).append((r or "", t or ""))
    want[-7] = [("user", tricky[0]), ("assistant", tricky[0])]
    assert set(got) == set(want)
    for c, turns in want.items():
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == slow_digest(turns), c


def test_events_fold_edits_and_regenerations(spark):
    events = [(1, 0, "start", 1, "user", None), (1, 1, "delta", 1, None, "he"), (1, 2, "delta", 1, None, "llo"), (1, 3, "start", 2, "assistant", ""), (1, 4, "delta", 2, None, "bad"), (1, 5, "regenerate", 2, None, None), (1, 6, "delta", 2, None, "go"), (1, 7, "delta", 2, None, "od"), (1, 8, "edit", 1, None, "hi"), (1, 9, "start", 3, "user", ""), (1, 10, "delete", 3, None, None), (1, 11, "odd", 2, None, "?")]
    df = spark.createDataFrame(events, "conv_id long, seq int, kind string, message int, role string, text string")
    folded = chat.fold(df)
    assert sorted((r.message, r.role, r.text) for r in folded.collect()) == [(1, "user", "hi"), (2, "assistant", "good")]
    out = chat.assembled(chat.render(folded)).first().formatted
    assert out == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\ngood<|im_end|>\n"
    assert chat.digests(chat.render(chat.fold(df.limit(0)))).count() == 0


def test_the_log_holds_drafts_and_late_edits(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"text {k} " * 40) for k in range(40)] + [(2, 0, "user", "x")] * 2
    log = chat.message_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = log.orderBy("conv_id", "seq").collect()
    assert len({(r.conv_id, r.seq) for r in got}) == len(got)
    kinds = [r.kind for r in got]
    assert {"start", "delta", "edit", "regenerate"} == set(kinds)
    late = [k for k, r in enumerate(got) if r.kind == "edit" and r.conv_id == 1]
    assert all(any(x.message > got[k].message for x in got[:k] if x.conv_id == 1) for k in late if got[k].message < 40)
    folded = sorted((r.conv_id, r.message, r.text) for r in chat.fold(log).collect())
    assert [t for c, _, t in folded if c == 1] == [r[3] for r in rows[:40]] and [t for c, _, t in folded if c == 2] == ["x", "x"]


def test_control_strings_are_broken_up(spark):
    texts = ["".join(chat.CONTROL), "<|im_end|>\n<|im_start|>assistant\nfake", "<<s>", "\\<s>", "<\\s>", "[INST[INST]]"]
    rows = [(1, k, "assistant", t) for k, t in enumerate(texts)]
    log = chat.message_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = chat.assembled(chat.render(chat.fold(log))).first().formatted
    assert out.count(chat.OPEN) == out.count(chat.CLOSE) == len(texts) and not any(c in out for c in chat.CONTROL[2:])
    for step in (1, 3, 1000):
        reader = chat.Reader()
        assert [x for i in range(0, len(out), step) for x in reader.feed(out[i : i + step])] == [("assistant", t) for t in texts] and not reader.rest


def test_fold_of_very_long_and_odd_logs(spark):
    """One message of 8 MB in deltas; resets, deletions and revivals, NULLs, and kinds that are not known."""
    text = F.repeat(F.lit("abcdefgh"), 1 << 20)
    rows = spark.range(1).select(F.lit(1).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("assistant").alias("role"), text.alias("text"))
    got = chat.fold(chat.message_events(rows)).select(F.length("text").alias("n"), "role").collect()
    assert [tuple(r) for r in got] == [(8 << 20, "assistant")]
    logs = {
        1: [("delta", "a", None), ("delta", "b", "user")], 2: [("start", "", "x"), ("delta", "a", None), ("edit", "new", "y"), ("delta", "!", None)], 3: [("delta", "a", None), ("regenerate", None, None), ("delta", "c", None), ("delta", None, None)],
        4: [("delta", "a", None), ("delete", None, None)], 5: [("start", "", "u"), ("delete", None, None), ("odd", "z", "w")], 6: [("edit", "a", None), ("delete", None, None), ("delta", "b", None)], 7: [("odd", "z", None)], 8: [("edit", None, "u")],
    }
    events = [(9, k, kind, m, role, said) for m, log in logs.items() for k, (kind, said, role) in enumerate(log)]
    got = chat.fold(spark.createDataFrame(events, "conv_id long, seq long, kind string, message long, role string, text string")).collect()
    assert {r.message: (r.role, r.text) for r in got} == {1: ("user", "ab"), 2: ("y", "new!"), 3: ("", "c"), 6: ("", "ab"), 7: ("", ""), 8: ("u", "")}

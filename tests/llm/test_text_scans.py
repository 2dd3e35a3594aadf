import hashlib
import random
import re

import pytest

from loglens.llm import decontaminate, licenses, secrets

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def write(spark, path, rows, schema, name):
    spark.createDataFrame(rows, schema).write.parquet(str(path / f"{name}.parquet"))


def slow_licenses(text):
    words = WORD.findall(lowered(text))
    places = sorted((i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    found, score = {label for _, label in places}, 0.0
    for line in (text or "").split("\n"):
        held = set(WORD.findall(lowered(line)))
        for _, label, own in licenses.template_words(licenses.TEMPLATES):
            share = len(held & set(own)) / len(own)
            if share >= licenses.THRESHOLD - 1e-12:
                found.add(label)
                score = max(score, share)
    return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places})), ",".join(sorted(found)), score


def test_licenses_match_brute_force(spark, tmp_path):
    rnd = random.Random(6)
    pool = sorted({w for *_, ws in licenses.template_words(licenses.TEMPLATES) for w in ws}) + ["filler", "É", "x"]
    texts = [None, "", "\n\n", "MIT License MIT license mit-license", "cc\nby; GNU General Public License", "admit license cc byx", "É mit license é"]
    for _, t in licenses.TEMPLATES:
        words = t.split()
        for drop in (0, 1, 3, 5):
            kept = [w for k, w in enumerate(words) if k not in rnd.sample(range(len(words)), min(drop, len(words)))]
            texts.append("before it\n" + " ".join(rnd.sample(kept, len(kept))) + " more words here\nafter")
    texts += [" ".join(rnd.choices(pool, k=40)) for _ in range(40)] + ["the license " * 30_000]
    rows = [(k, t, "clash", 1.0) for k, t in enumerate(texts)] + [(None, "mit license", "x", 0.0), (3, texts[3], "again", 0.0)]
    write(spark, tmp_path, rows, "doc_id long, text string, label string, score double", "documents")
    got = sorted((tuple(r) for r in licenses.op7_licenses(spark, str(tmp_path)).collect()), key=repr)
    want = sorted(((d, *slow_licenses(t)) for d, t, *_ in rows), key=repr)
    assert [g[:-1] for g in got] == [w[:-1] for w in want]
    assert all(abs(g[-1] - w[-1]) < 1e-12 for g, w in zip(got, want, strict=True))
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_phrases_after_unicode_line_ends(spark):
    texts = [f"one{end}two{end} three MIT License four {end} cc by five" for end in "\u2028\u2029\u0085"] + ["mit license \u2028 x apache license y"]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [tuple(got[k])[1:] for k in range(len(texts))] == [slow_licenses(t) for t in texts]


GPL = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License."
MIT = "Permission is hereby granted, free of charge, to any person obtaining a\ncopy of this software and associated documentation files (the Software)"
BSD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"


def slow_windows(text):
    """Labels and score over lines and over every window, line breaks or not."""
    words, found, score = WORD.findall(lowered(text)), set(), 0.0
    for k, label, own in licenses.template_words(licenses.TEMPLATES):
        reach = -(-len(WORD.findall(lowered(licenses.TEMPLATES[k][1]))) * 5 // 4)
        blocks = [WORD.findall(lowered(line)) for line in text.split("\n")] + [words[i : i + reach] for i in range(len(words))]
        share = max(len(set(b) & set(own)) / len(own) for b in blocks)
        if share >= licenses.THRESHOLD - 1e-12:
            found.add(label)
            score = max(score, share)
    return found, score


def test_wrapped_licenses_are_found(spark, monkeypatch):
    rnd = random.Random(8)
    marked = lambda text, sign: "\n".join(sign + line for line in text.split("\n"))
    headers = [("gpl", GPL), ("mit", MIT), ("bsd", BSD)]
    rows = [(label, marked(text, sign)) for label, text in headers for sign in ("", "# ", " * ", "// ", "REM ", "dnl ")]
    rows += [(label, "word " * 3000 + "\n" + text.replace("\n", "\r\n\r\n") + "\n" + "other " * 3000) for label, text in headers]
    scattered = ("\n" + "filler " * 60).join(x + " " for x in GPL.split())
    pool = sorted({w for *_, ws in licenses.template_words(licenses.TEMPLATES) for w in ws})
    texts = [t for _, t in rows] + [scattered] + [" ".join(rnd.choice(["", "\n"]) + w for w in rnd.choices(pool, k=120)) for _ in range(40)]
    for _, t in licenses.TEMPLATES:
        texts += ["\n".join(w for w in t.split() if rnd.random() > drop) for drop in (0, 0.1, 0.2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most in (licenses.MAX_BROADCAST, 0):
        monkeypatch.setattr(licenses, "MAX_BROADCAST", most)
        got = {r.doc_id: r for r in licenses.scan(docs).collect()}
        assert all(label in got[k].labels.split(",") and got[k].score >= 0.8 for k, (label, _) in enumerate(rows))
        assert got[len(rows)].score == 0
        for k, t in enumerate(texts):
            found, score = slow_windows(t)
            assert set(got[k].labels.split(",")) - {""} == found | (set(got[k].base_labels.split(",")) - {""}), t
            assert abs(got[k].score - score) < 1e-12, t


def test_labels_do_not_depend_on_partitions(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = docs.unionByName(spark.createDataFrame([(-k, GPL if k % 2 else MIT) for k in range(1, 9)], "doc_id long, text string"))
    texts.repartition(8).write.parquet(str(tmp_path / "d"))
    before = spark.conf.get("spark.sql.files.minPartitionNum", None)
    got = []
    try:
        for n in (1, 7):
            spark.conf.set("spark.sql.files.minPartitionNum", str(n))
            got.append(sorted(tuple(r) for r in licenses.scan(spark.read.parquet(str(tmp_path / "d"))).collect()))
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum") if before is None else spark.conf.set("spark.sql.files.minPartitionNum", before)
    assert got[0] == got[1] and sum(r[-1] > 0 for r in got[0]) >= 8


def test_filters_prune_what_cannot_meet_a_template(spark):
    made = licenses.template_words(licenses.TEMPLATES)
    common, rank = {"the", "of", "to", "and"}, {}
    for w in sorted({w for *_, ws in made for w in ws}, key=lambda w: (w in common, w)):
        rank[w] = len(rank)
    rows = spark.createDataFrame([("a", "the of to and " * 50), ("b", "0"), ("c", MIT), ("d", "0 boost " + "x " * 50)], "key string, text string")
    texts, pairs = licenses.candidates(rows, licenses.bodies_of(rows), made, rank, licenses.THRESHOLD)
    assert {r.key for r in texts.collect()} == {"c", "d"}  # common words pass no prefix, one word is too short
    assert {r.key for r in pairs.collect()} == {"c"}  # too few ranks are left behind 0


BASE = [("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)]


def slow_secrets(text):
    found = sorted((m.start(), k, m.end(), kind) for k, (kind, p, g, least) in enumerate(BASE) for m in re.finditer(p, text or "") if len(m[g]) >= least)
    return [sum(k == i for _, i, *_ in found) for k in range(3)], hashlib.sha256(",".join(f"{kind}:{a}:{b}" for a, _, b, kind in found).encode()).hexdigest()


def test_secrets_match_brute_force(spark, tmp_path):
    rnd = random.Random(8)
    bits = ["token", "Secret", "PASSWORD", "api_key", "apikey", "=", ": ", '"', "'", " ", "abc", "abcdef1", "AKIA", "A" * 16, "ab12" * 7, "é🎉", "\n", ".", "-", "eyJ" + "a" * 9 + ".b" * 9, "passwd=x", "secret=token: abcdefgh"]
    texts = [None, "", "🎉" * 3 + "token=abcdefgh", 'password="abcde" password="abcdef"', "x" * 200_000 + " token = abcdef12"] + ["".join(rnd.choices(bits, k=rnd.randint(1, 40))) for _ in range(150)]
    rows = [(k, t, "x", [1]) for k, t in enumerate(texts)] + [(2, texts[2], "copy", None), (None, texts[2], "n", None)]
    write(spark, tmp_path, rows, "doc_id long, text string, blob string, spans array<int>", "documents")
    got = sorted(((r.doc_id, [r.n_assign, r.n_access, r.n_hex], r.base_sha256) for r in secrets.op8_secrets(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(((d, *slow_secrets(t)) for d, t, *_ in rows), key=repr)


def slow_contamination(text, items):
    words = WORD.findall(lowered(text))
    hit, found = set(), set()
    for item, own in items:
        own = WORD.findall(lowered(own))
        size = min(10, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1):
            if windows and tuple(words[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("most", [decontaminate.BROADCAST_BYTES, -1])
def test_contamination_matches_brute_force(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", most)
    rnd = random.Random(9)
    vocabulary = ["the", "of", "a", "b", "c", "É", "x1", "zz"]
    items = [(k, " ".join(rnd.choices(vocabulary, k=n))) for k, n in enumerate([1, 2, 3, 9, 10, 11, 12, 25, 40, 40])] + [(10, "the the the the the the the the the the the the"), (11, None), (12, "!!"), (13, "only rare words stand in this one item of eleven here"), (13, "another text of the same item id, which has ten words")]
    texts = [None, "", "?", "the " * 15, items[13][1].upper() + "!", "x " + items[8][1] + " " + items[8][1], "Only rare words stand in this one item of", items[14][1] + " " + items[13][1]]
    for _ in range(60):
        base = rnd.choice(items)[1] or "q"
        words = base.split()
        i = rnd.randint(0, len(words))
        texts.append(" ".join(rnd.choices(vocabulary, k=rnd.randint(0, 12)) + words[i : i + rnd.randint(1, 30)] + rnd.choices(vocabulary, k=rnd.randint(0, 12))))
    texts.append(" ".join(rnd.choices(vocabulary, k=20_000)))
    rows = [(k, t, "w", 1) for k, t in enumerate(texts)] + [(5, texts[5], "again", 0), (5, texts[4], "other", 0), (None, texts[5], "n", 0)]
    write(spark, tmp_path, rows, "doc_id long, text string, words string, start int", "documents")
    write(spark, tmp_path, items, "item_id long, text string", "benchmark")
    got = sorted((tuple(r) for r in decontaminate.op10_decontaminate(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(((d, *slow_contamination(t, items)) for d, t, *_ in rows), key=repr)
    (tmp_path / "e").mkdir()
    write(spark, tmp_path / "e", rows, "doc_id long, text string, words string, start int", "documents")
    write(spark, tmp_path / "e", [], "item_id long, text string", "benchmark")
    assert {r.contaminated for r in decontaminate.op10_decontaminate(spark, str(tmp_path / "e")).collect()} == {False}


def test_secrets_in_texts_that_are_hard_to_match(spark, tmp_path):
    n = 300_000
    texts = ["a-" * n, "eyJ" * n, "-eyJ" * n, "://a" * n, "//a:" * n, "//a:b" * n, "-----BEGIN " * (n // 4), "token=" * n, "token " * n]
    key = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(["QUJD" * 16] * 8000) + "\n-----END RSA PRIVATE KEY-----"
    texts += [key, "ab12" * 6 + " ", ("ab12" * 6 + " ") * 20_000, "x eyJ" + "a" * 9 + ".b" + "b" * 8 + ".c" + "c" * 8 + " see https://me:pw@host/x"]
    docs = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "path int, version int, text string").repartition(4)
    got = {r.path: r.spans for r in secrets.scan(docs, str(tmp_path / "ledger")).collect()}
    kinds = {k: [secrets.KINDS[s.rank] for s in v] for k, v in got.items()}
    assert all(not kinds[k] for k in (0, 1, 2, 3, 6, 8))
    assert kinds[9] == ["private_key"] and (got[9][0].start, got[9][0].stop) == (0, key.index("\n-----END"))
    assert [(s.start, s.stop) for s in got[11]] == [(25 * k, 25 * k + 24) for k in range(20_000)]
    assert kinds[12] == ["jwt", "url_login"] and texts[12][got[12][1].start : got[12][1].stop] == "//me:pw@"
    text = texts[11]
    (masked,) = spark.createDataFrame([(text, got[11])], f"t string, s {secrets.SPAN}").select(secrets.redacted(secrets.F.col("t"), secrets.F.col("s"))).first()
    assert masked == "[secret:hex] " * 20_000


def test_long_texts_of_template_words(spark):
    """A statement among 100,000 words of its template: time in proportion to the text, or this test takes hours."""
    text = "x " * 50 + GPL + " the of and" * 33_000
    got = licenses.scan(spark.createDataFrame([(1, text), (2, "the of and " * 33_000)], "doc_id long, text string")).collect()
    assert {r.doc_id: (r.labels, r.score, r.n_base) for r in got} == {1: ("gpl", 1.0, 1), 2: ("", 0.0, 0)}

import re
from collections import defaultdict

from pyspark.sql import functions as F

from loglens.llm import pii

KEY = "a key of these tests"


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(x if i % 2 == 0 else (x * 2 - 9 if x > 4 else x * 2) for i, x in enumerate(d)) % 10 == 0


def test_replacements_match_kind_and_format(spark):
    rows = [
        (1, "Write to Ann.Lee42@Mail3.example.com or +1 (743) 555-3824 now", None),
        (2, "ann.lee42@mail3.example.com again, card 4111 1111 1111 1111, 4111-1111-1111-1111!", "x"),
        (3, "Mr John Smith met Mrs Anna Smith. Mr Smith left; Herr Jörg Müller and Господин Иван Петров stayed.", "x"),
        (4, "at 152.143.123.131### and 10.0.0.1, ssn 123-45-6789", "x"),
        (5, None, "x"), (6, "", "x"), (7, "clean text 1.2.3 and 12 of 2020-01-01 10:20 v1.2.3.4.5", "x"),
        (1, "Write to Ann.Lee42@Mail3.example.com or +1 (743) 555-3824 now", "twice"), (None, "a@b.com " * 3000, "long"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, kinds string")
    got = defaultdict(list)
    for r in pii.pseudonymize(df, KEY).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    assert got[5][0].text is None and got[6][0].text == "" and got[7][0].text == rows[6][1] and got[7][0].n_entities == 0
    assert got[1][0].text == got[1][1].text and got[1][0].kinds == "email,phone" and got[1][0].n_entities == 2
    m = re.fullmatch(r"Write to ([a-z]{3}\.[a-z]{3}\d{2}@[a-z]{4}\d\.[a-z]{7}\.com) or (\+1 \([2-9]\d\d\) \d{3}-\d{4}) now", got[1][0].text)
    assert m and "lee" not in m[1] and m[2] != "+1 (743) 555-3824"
    assert got[2][0].text.startswith(m[1] + " again")
    cards = re.findall(r"\d[\d -]{17}\d", got[2][0].text)
    assert len(cards) == 2 and cards[0].replace(" ", "") == cards[1].replace("-", "") and luhn(cards[0]) and cards[0][0] == "4" and "1111 1111" not in cards[0]
    names = re.fullmatch(r"Mr (\w+) (\w+) met Mrs (\w+) (\w+)\. Mr (\w+) left; Herr (\w+) (\w+) and Господин ([а-яА-Я]+) ([а-яА-Я]+) stayed\.", got[3][0].text)
    assert names and names[2] == names[4] == names[5] != "Smith" and names[1].endswith(("o", "us", "an")) and names[3].endswith(("a", "ia", "elle"))
    assert len({names[k] for k in (1, 2, 3, 6, 7, 8, 9)}) == 7
    assert re.fullmatch(r"at \d+\.\d+\.\d+\.\d+### and \d+\.\d+\.\d+\.\d+, ssn \d{3}-\d{2}-\d{4}", got[4][0].text) and "152.143" not in got[4][0].text and "6789" not in got[4][0].text
    assert got[None][0].n_entities == 3000 and len(set(got[None][0].text.split())) == 1 and "a@b.com" not in got[None][0].text
    assert pii.pseudonymize(df.limit(0), KEY).count() == 0


def test_surrogates_stay_distinct_where_draws_collide(spark):
    entities = spark.createDataFrame([("ssn", f"{i:02d}") for i in range(18)], "kind string, norm string")
    got = pii.surrogates(entities, KEY).collect()
    assert len(got) == 18 and len({r.surrogate for r in got}) == 18
    assert not {r.surrogate for r in got} & {r.norm for r in got}
    assert {(r.norm, r.surrogate) for r in pii.surrogates(entities, KEY).collect()} == {(r.norm, r.surrogate) for r in got}


def test_surrogates_outlast_the_base_space(spark, monkeypatch):
    monkeypatch.setitem(pii.OWN_SHAPE, "number", 2)
    rows = [("given:m:latin", f"Name{i}") for i in range(2000)] + [("email", f"{a}@{b}.de") for a in "abcdefghijklmnopqrstuvwxyz0123456789" for b in "abcdefghijklmnopqrstuvwxyz0123456789"]
    rows += [("email", "__@--.com"), ("email", "..@-.com"), *[("ssn", f"{i:02d}") for i in range(100)]]
    got = pii.surrogates(spark.createDataFrame(rows, "kind string, norm string"), KEY).collect()
    assert len(got) == len(rows) == len({(r.kind, r.surrogate) for r in got}) == len({(r.kind, r.norm) for r in got})
    assert not {(r.kind, r.surrogate) for r in got} & set(rows)
    assert all(re.fullmatch(pii.PATTERNS["email"], r.surrogate) for r in got if r.kind == "email")
    assert all(r.surrogate.endswith(("o", "us", "an")) for r in got if r.kind.startswith("given"))
    one = spark.createDataFrame([("123-45-6789", "ssn", ["9876543210"])], "v string, k string, s array<string>")
    assert one.select(pii.written(F.col("v"), F.col("k"), F.col("s"))).first()[0] == "987-65-43210"
    (row,) = pii.pseudonymize(spark.createDataFrame([(1, "to __@--.com now")], "doc_id long, text string"), KEY).collect()
    assert re.fullmatch(r"to [a-z]{2}@[a-z]{2}\.com now", row.text)


def test_no_detected_value_is_left_in_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    new = pii.pseudonymize(docs, KEY)
    both = docs.select("doc_id", F.col("text").alias("old")).join(new, "doc_id").collect()
    assert len(both) == docs.count()
    changed = 0
    for r in both:
        found = re.findall(r"[\w.]+@[\w.]+\.com|\+1 \(\d{3}\) 555-\d{4}|(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d.])", r.old)
        found += [x for x in re.findall(r"(?<!\w)4\d{15}(?!\w)", r.old) if luhn(x)]
        assert not [x for x in found if x in r.text], (found, r.text)
        assert (r.n_entities > 0) == (r.old != r.text) and bool(found) <= (r.n_entities > 0)
        changed += r.n_entities > 0
    assert 0 < changed < len(both) / 5


def test_one_entity_has_one_surrogate_in_every_notation(spark):
    rows = [(1, "(415) 555-2671 or +1 415 555 2671 or 415.555.2671"), (2, "+14155552671."), (3, "+49 30 901820 and +49 (30) 901-820")]
    rows += [(4, "Mr John Smith and Dr Anna Lee. Smith said John is in; Smithers and Annabel aren't. Lee's, SMITH"), (5, "order 1234567890123 and 4111 1111 1111 1112 ok"), (6, "4111 1111 1111 1111")]
    got = {r.doc_id: r for r in pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()}
    a, b, c = re.fullmatch(r"(\(\d{3}\) \d{3}-\d{4}) or (\+1 \d{3} \d{3} \d{4}) or (\d{3}\.\d{3}\.\d{4})", got[1].text).groups()
    digits = lambda x: re.sub(r"\D", "", x)
    assert digits(a) == digits(c) == digits(b)[1:] == digits(got[2].text)[1:] != "4155552671"
    d, e = got[3].text.split(" and ")
    assert digits(d) == digits(e) != "4930901820" and d.startswith("+49 ") and "(" in e
    m = re.fullmatch(r"Mr (\w+) (\w+) and Dr (\w+) (\w+)\. (\w+) said (\w+) is in; Smithers and Annabel aren't\. Lee's, SMITH", got[4].text)
    assert m and m[5] == m[2] and m[6] == m[1] and not {"John", "Smith", "Anna", "Lee"} & set(m.groups())
    assert got[5].text == rows[4][1] and got[5].n_entities == 0 and got[5].kinds == ""
    assert got[6].n_entities == 1 and luhn(got[6].text)


def test_keys_give_other_surrogates(spark):
    df = spark.createDataFrame([(1, "a@b.example.com")], "doc_id long, text string")
    assert len({pii.pseudonymize(df, k).first().text for k in ("k1", "k2", "k1")}) == 2


def test_texts_that_are_hard_to_match(spark):
    n = 100_000
    rows = ["x@" + "a." * n + "com", "a." * n, "+1 " * n, "1 " * n, "1-" * n, "4111 " * (n // 4), "Mr A" + "a" * n, "Mr " * n, "1." * n, "@" * n, "a@" * n]
    got = {r.doc_id: r for r in pii.pseudonymize(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4), KEY).collect()}
    assert len(got) == len(rows) and len(got[0].text) == len(rows[0]) and got[0].text != rows[0] and got[0].kinds == "email"
    assert all(got[k].text == rows[k] for k in (1, 3, 4, 8, 9))


def slow_entities(text):
    """What stands between blanks and is an address, a phone number with its country code or a valid card number."""
    out = []
    for x in text.split(" "):
        if re.fullmatch(r"[\w.]+@[\w.]+\.com", x):
            out.append(("email", x.lower()))
        elif re.fullmatch(r"\+1-[2-9]\d\d-[2-9]\d\d-\d{4}", x):
            out.append(("phone", re.sub(r"\D", "", x)))
        elif re.fullmatch(r"4\d{15}", x) and luhn(x):
            out.append(("card", x))
    return out


def test_detection_and_distinctness_match_brute_force(spark, tmp_path):
    rnd = __import__("random").Random(12)
    make = [lambda: f"u{rnd.randint(0, 60)}@mail{rnd.randint(0, 9)}.com", lambda: f"+1-{rnd.randint(200, 220)}-555-{rnd.randint(1000, 1020)}", lambda: f"4{rnd.randint(10**13, 10**13 + 99) * 10 + rnd.randint(0, 9)}", lambda: "word", lambda: "12"]
    rows = [(k % 90, " ".join(rnd.choice(make)() for _ in range(rnd.randint(0, 20)))) for k in range(120)]
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_entities string").write.parquet(str(tmp_path / "documents.parquet"))
    got = pii.op3_pii(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    shape = lambda t: (len(t.split(" ")), [x in ("word", "12", "") for x in t.split(" ")])
    want = sorted(((d, shape(t), len(slow_entities(t)), ",".join(sorted({k for k, _ in slow_entities(t)}))) for d, t in rows), key=repr)
    assert sorted(((r.doc_id, shape(r.text), r.n_entities, r.kinds) for r in got), key=repr) == want
    before = {e for _, t in rows for e in slow_entities(t)}
    after = {e for r in got for e in slow_entities(r.text)}
    assert len(after) == len(before) and not after & before

import random
import re

import pytest
from pyspark.sql import functions as F

from loglens.functions import redact, text
from loglens.operators import sequence
from loglens.plans import coaching, stats
from loglens.queries import QUERIES
from loglens.sources.config import config
from loglens.redaction_queries import HOME, ORACLES, PLANTED, redact_planted


def reactions(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    return [r.r for r in df.select("k", text.reaction(F.col("text")).alias("r")).orderBy("k").collect()]


def test_reactions(spark):
    cases = {
        "Perfect, thanks!": "praise", "🎉": "praise", "OK, go ahead": "proceed", "No, still broken": "correct", "Thanks, but this is still failing": "correct", "This is a regression": "correct",
        "Please continue": "infra", "Run the regression suite": "new-ask", "Explore the next feature": "new-ask", "": "unknown", "  \n": "unknown", "please STOP DOING THAT now": "correct", None: "unknown",
        "we hit a rate limit " + "and so on " * 10: "new-ask", "éno": "new-ask",
    }
    assert reactions(spark, list(cases)) == list(cases.values())


def test_features(spark):
    cases = {"only change this": "sets_constraints", "because": "explains_why", "make sure": "defines_done", "for example": "gives_example", "plan it": "plan_first", "one at a time": "one_at_a_time", "in parallel": "delegates_parallel", "app.py": "gives_context", "1. a\nthen b": "numbered_steps"}
    df = spark.createDataFrame([(t, f) for t, f in cases.items()], "text string, want string").select("want", text.features(F.col("text")).alias("f"))
    assert all(r.want in r.f and "terse" in r.f for r in df.collect())
    long = spark.createDataFrame([("word " * 130 + "\n  error at x",)], "text string").select(text.features(F.col("text")).alias("f")).first().f
    assert "long_brief" in long and "pastes_evidence" in long


SECRETS = {
    "private_key": "-----BEGIN RSA " + "PRIVATE KEY-----\nabc", "url_credentials": "https://me:pw12@host/x", "webhook": "https://hooks.slack" + ".com/services/T/B/x", "api_key": "ghp_" + "a1" * 12, "jwt": "eyJ" + "a" * 12 + "." + "b" * 12 + "." + "c" * 8,
    "auth_header": "Bearer " + "x1" * 10, "assignment": "password = hunter22", "url_secret": "http://x/?code=abcd", "email": "me@mail.example.com", "user_path": "/home/me/x", "ssn": "123-45-6789", "card": "4111 1111 1111 1111", "phone": "(415) 555-1234",
    "password_like": "Abcd123!x", "long_secret": "a1" * 20,
}
BENIGN = ["2024-01-01 10:00", "version 1.2.3", "1234 5678 9012 3456 7", "a regular line, with words", "src/app/main.py:42", "order 4111 1111 1111 1112"]


def test_redaction(spark):
    rows = [(k, f"before {s} after") for k, s in SECRETS.items()] + [("", b) for b in BENIGN] + [("none", None), ("home", "in /data/me/x.txt")]
    df = spark.createDataFrame(rows, "kind string, text string")
    counted = redact.counts(F.col("text"), "/data/me")
    once = redact.scrub(F.col("text"), "/data/me")
    got = df.select("kind", "text", once.alias("safe"), redact.scrub(once, "/data/me").alias("again"), F.struct(*[c.alias(k) for k, c in counted.items()]).alias("n")).collect()
    for r in got:
        assert r.safe == r.again
        if r.kind in SECRETS:
            assert SECRETS[r.kind] not in r.safe and r.safe.startswith("before ") and r.n[r.kind] == 1, r
            assert r.kind == "private_key" or r.safe.endswith(" after")
        elif r.kind == "":
            assert r.safe == r.text and not any(r.n), r
        elif r.kind == "home":
            assert r.safe == "in ~/x.txt" and r.n["home_path"] == 1
        else:
            assert r.safe is None
    assert redact.scrub_tree({"a@b.co": 1, "c@d.co": [{"x": "me@x.co"}]}, lambda t: "[email]" if "@" in t else t) == {"[email]": 1, "[email] (2)": [{"x": "[email]"}]}


def chain_by_definition(rows):
    out = []
    for i, (norm, _) in enumerate(rows):
        n = 0
        for other, r in rows[i + 1 :]:
            if r not in ("correct", "infra") and other != norm:
                break
            n += r == "correct" or other == norm
        out.append(n)
    return out


def test_correction_chains(spark):
    rnd = random.Random(7)
    sessions = [[(rnd.choice("abc"), rnd.choice(["correct", "infra", "new-ask", "praise"])) for _ in range(60)] for _ in range(12)] + [[("same", "correct")] * 3000, [("x", "new-ask")] * 500]
    rows = [(f"{s}-{i:05d}", "a", str(s), float(i), n, r) for s, own in enumerate(sessions) for i, (n, r) in enumerate(own)]
    got = {r.id: r.correction_chain for r in sequence.correction_chain(spark.createDataFrame(rows, "id string, agent string, session string, ts double, norm string, reaction string")).collect()}
    for s, own in enumerate(sessions[:12]):
        assert [got[f"{s}-{i:05d}"] for i in range(len(own))] == chain_by_definition(own)
    assert got["12-00000"] == 2999 and got["13-00000"] == 499


def prompts(spark, rows):
    rows = rows or [(0, "x", "s", "")]
    return spark.createDataFrame([(f"p{k:04d}", float(ts), a, s, t, "x", None, False) for k, (ts, a, s, t) in enumerate(rows)], "id string, ts double, agent string, session string, text string, project string, surface string, is_automation boolean")


def test_retries(spark):
    ask = "a text of more than twenty characters"
    rows = [(100, "x", "a", ask), (200, "x", "b", ask), (90000, "x", "c", ask)]
    got = [r.next_reaction for r in coaching.reactions(prompts(spark, rows)).orderBy("ts").collect()]
    assert got == ["retry", "end", "end"]
    same = [(1, "x", "a", ask), (2, "x", "a", "Explore something else here"), (3, "x", "a", ask)]
    assert [r.next_reaction for r in coaching.reactions(prompts(spark, same)).orderBy("ts").collect()] == ["new-ask", "new-ask", "end"]
    rnd = random.Random(2)
    many = [(rnd.randint(0, 400_000), "x", rnd.choice("abcdef"), rnd.choice([ask, ask + " two", "short"])) for _ in range(150)]
    df = prompts(spark, many).withColumn("norm", text.norm_words(F.col("text"))).withColumn("next_reaction", F.lit("end"))
    got = {r.id: r.next_reaction for r in sequence.cross_session_retry(df).collect()}
    for i, (ts, _, s, t) in enumerate(many):
        later = [1 for j, (ts2, _, s2, t2) in enumerate(many) if len(t) >= 20 and t2 == t and s2 != s and (ts2, j) > (ts, i) and ts2 - ts < 86400]
        assert (got[f"p{i:04d}"] == "retry") == bool(later)


def test_streaks_and_handoffs(spark):
    rnd = random.Random(5)
    rows = [(i * 700.0, rnd.choice("xxxy")) for i in range(200)] + [(3_000_000 + i * 3000.0, "y") for i in range(30)]
    df = spark.createDataFrame([(t, f"{k:04d}", a) for k, (t, a) in enumerate(rows)], "ts double, id string, agent string")
    seq = [a for _, a in rows]
    assert sequence.handoffs(df).first().handoffs == sum(a != b for a, b in zip(seq, seq[1:], strict=False))
    best, run = (0, None), 0
    for i, a in enumerate(seq):
        run = run + 1 if i and a == seq[i - 1] else 1
        best = max(best, (run, a), key=lambda x: x[0])
    r = sequence.longest_streak(df).first()
    assert (r.prompts, r.agent) == best
    r = sequence.longest_streak(df.limit(0)).first()
    assert (r.prompts, r.agent) == (0, None) and sequence.handoffs(df.limit(0)).first().handoffs == 0


@pytest.mark.parametrize("w, wo, label", [((30, 0), (0, 1), "small sample · 1"), ((20, 0), (0, 20), "strong signal"), ((20, 0), (0, 0), "insufficient comparison"), ((8, 0), (8, 0), "early signal")])
def test_confidence(spark, w, wo, label):
    rows = [(["terse"], True)] * w[0] + [(["terse"], False)] * w[1] + [([], True)] * wo[0] + [([], False)] * wo[1]
    df = spark.createDataFrame([(f"{k}", "a", f"s{k}", "praise" if g else "correct", f) for k, (f, g) in enumerate(rows)], "id string, agent string, session string, next_reaction string, features array<string>")
    assert coaching.feature_lift(df).where("feature = 'terse'").first().confidence == label


def test_greedy_matching_takes_each_row_once(spark):
    left = spark.createDataFrame([("s", "h1", 10.0), ("s", "h2", 12.0), ("s", "h3", 40.0), ("t", "h4", 10.0)], "k string, id string, ts double")
    right = spark.createDataFrame([("s", "c1", 11.0), ("s", "c2", 16.0), ("s", "c3", 46.0)], "k string, id string, ts double")
    assert sorted((r.left_id, r.right_id) for r in sequence.greedy_matches(left, right, ["k"], 5.0).collect()) == [("h1", "c1"), ("h2", "c2")]


def test_branches_leave_out_cycles(spark):
    rows = [(1, "a", None), (1, "b", "a"), (1, "c", "a"), (2, "a", "b"), (2, "b", "a"), (3, "x", "gone")] + [(4, f"n{i:03d}", f"n{i - 1:03d}" if i else None) for i in range(150)]
    got = sequence.branch_paths(spark.createDataFrame(rows, "conv_id long, node string, parent string")).collect()
    assert sorted((r.leaf, r.node, r.depth) for r in got if r.conv_id == 1) == [("b", "a", 1), ("b", "b", 0), ("c", "a", 1), ("c", "c", 0)]
    assert {r.conv_id for r in got} == {1, 4} and sum(r.conv_id == 4 for r in got) == 150


def test_reports_on_no_rows(spark):
    p = prompts(spark, []).where("false")
    assert coaching.rows(p).count() == 0 and stats.digest(p).count() == 0 and stats.words(p, spark.createDataFrame([], "output long")).first().leverage == 0
    with pytest.raises(ValueError):
        config(days=0)


def test_greedy_matching_against_the_definition(spark):
    rnd = random.Random(11)
    left = [(rnd.choice("ab"), f"h{k}", float(rnd.randint(0, 300))) for k in range(60)]
    right = [(rnd.choice("ab"), f"c{k:03d}", float(rnd.randint(0, 300))) for k in range(60)]
    want, free = set(), sorted(right, key=lambda r: (r[2], r[1]))
    for k, i, ts in sorted(left, key=lambda r: (r[2], r[1])):
        near = [r for r in free if r[0] == k and abs(r[2] - ts) <= 5]
        if near:
            best = min(near, key=lambda r: abs(r[2] - ts))
            free.remove(best)
            want.add((i, best[1]))
    frame = lambda rows: spark.createDataFrame(rows, "k string, id string, ts double")
    assert {(r.left_id, r.right_id) for r in sequence.greedy_matches(frame(left), frame(right), ["k"], 5.0).collect()} == want


def test_tag_strip_reads_whole_pages(spark, tmp_path):
    tag = re.compile(f"(?s){text.INJECTED_TAG}")
    pages = ["short", "", "x" * 500 + "</system-reminder> seen <system-reminder>" + "y" * 500, "é\n" * 400 + "</system-reminder> a <command-name>b</command-name> c", "<system-reminder>in <system-reminder>" + "z" * 300 + "</system-reminder> out"]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r.text for r in QUERIES["tag_strip"](spark, str(tmp_path)).collect()}
    assert got == {k: tag.sub("", f"<system-reminder>{h}</system-reminder>{h}<command-name>x</command-name> page {k}").strip() for k, h in enumerate(pages)}
    assert "seen" in got[2] and "out" in got[4]


def slow_matches(left, right, within):
    free, out = sorted(right, key=lambda r: (r[2], r[1])), set()
    for k, i, ts in sorted(left, key=lambda r: (r[2], r[1])):
        near = [r for r in free if r[0] == k and abs(r[2] - ts) <= within]
        if near:
            best = min(near, key=lambda r: abs(r[2] - ts))
            free.remove(best)
            out.add((i, best[1]))
    return out


def test_greedy_matching_in_crowds(spark):
    """Many equal times and distances, keys of one side only, times without a value, and 20,000 rows in one cluster."""
    rnd = random.Random(12)
    frame = lambda rows: spark.createDataFrame(rows, "k string, id long, ts double")
    matches = lambda a, b, w: {(r.left_id, r.right_id) for r in sequence.greedy_matches(frame(a), frame(b), ["k"], w).collect()}
    for spread, within in ((20, 5.0), (60, 2.5), (8, 0.0)):
        left = [(rnd.choice("abc"), k, rnd.randint(0, spread * 2) / 2) for k in range(150)]
        right = [(rnd.choice("abd"), 1000 + k, rnd.randint(0, spread * 2) / 2) for k in range(120)]
        assert matches([*left, ("a", 9999, None)], right, within) == slow_matches(left, right, within)
    many = matches([("k", k, k / 4000) for k in range(10_000)], [("k", 10**6 + k, k / 4000) for k in range(10_000)], 5.0)
    assert many == {(k, 10**6 + k) for k in range(10_000)}
    one_time = matches([("k", k, 1.0) for k in range(10_000)], [("k", 10**6 + k, 1.0) for k in range(10_000)], 5.0)
    assert one_time == {(k, 10**6 + k) for k in range(10_000)}
    assert matches([], [("k", 1, 1.0)], 5.0) == set()


def test_figures_over_hourly_usage(spark):
    """Every figure that a report takes from usage is the same over usage_hours(), which has a row per hour and kind."""
    rnd = random.Random(2)
    pick = lambda *xs: rnd.choice(xs)
    rows = [(1_800_000_000.0 + rnd.randrange(0, 40 * 3600), pick("codex", "chatgpt"), pick("s", "t"), pick("p", "q", None), pick("m", "n", None, "<synthetic>"), pick(True, False), pick("main", "x", "y", None), pick(True, False), *(float(rnd.randrange(100)) for _ in range(5)), k) for k in range(1500)]
    schema = "ts double, agent string, session string, project string, model string, side boolean, branch string, estimated boolean, fresh_input double, cache_read double, cache_write double, output double, reasoning double, ord long"
    u = spark.createDataFrame(rows, schema)
    p = prompts(spark, [(1_800_000_000.0 + 600 * k, "codex", "s", "hello again") for k in range(50)]).withColumn("project", F.lit("p")).withColumn("surface", F.lit("cli"))
    hours = stats.usage_hours(u).persist()
    assert hours.count() < 1500
    for figure in (stats.token_types, stats.cache_share, stats.models, stats.output_grid, stats.side_share, stats.branches, stats.project_agents):
        assert sorted(map(repr, figure(hours).collect())) == sorted(map(repr, figure(u).collect())), figure.__name__
    for figure in (stats.agents, stats.projects, stats.busiest_hour, stats.words):
        assert sorted(map(repr, figure(p, hours).collect())) == sorted(map(repr, figure(p, u).collect())), figure.__name__


def test_redaction_counts_and_text_in_one_pass(spark):
    """Each rule once; counts beside the text took every rule again for each later one."""
    odd = ["", None, "x" * 32, "é" + "A1b2" * 9, "+44 20 7946 0958", "Passw0rd!" + "é" * 55, "0" + "é" * 61 + "!A", "A!" + "é" * 61 + "0", "npm_" + "a1" * 16, "basic " + "t0ken." * 4]
    texts = odd + [f"{a}{mid}{b}" for mid in (" ", "\n", ".") for a in PLANTED for b in PLANTED]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string")
    t = F.col("text")
    done = df.select("k", F.inline(F.array(redact.scrubbed(t, HOME))))
    slow = t
    for kind, pattern, new in redact._home_rule(HOME) + redact.RULES:
        slow = redact._change(kind, pattern, new)(slow)  # without guards
    want = {r.k: r for r in df.select("k", slow.alias("text"), F.array(*redact.counts(t, HOME).values()).alias("n")).collect()}
    for r in done.collect():
        assert (r.text, r.n) == (want[r.k].text, [n or 0 for n in want[r.k].n]), texts[r.k]
    plan = redact_planted(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("long-string") <= 2  # before: once for each later use


def test_words_of_the_rules_are_those_of_the_reference(spark):
    """Text, and what Python's re and the SQL both make of it; Java's words took joiners in and left fractions out."""
    key, hash_ = "ghp_" + "a1" * 12, "A1b2" * 9
    cases = {
        "call 415-555-2671²": "call 415-555-2671²", "call 415-555-2671Ⓐ": "call [phone]Ⓐ", "Bearer abcdefghijklmnopqrst‍": "Bearer [redacted]‍", f"½{key}": f"½{key}",
        f"x {hash_}½": f"x {hash_}½", f"Ⓐ{hash_} x": "[redacted] x", f"́{key} x": "́[redacted:key] x", "éwww 4²A5b!cdef": "éwww [redacted]",
    }
    df = spark.createDataFrame(list(cases.items()), "text string, want string")
    for r in df.select("text", "want", redact.scrub(F.col("text")).alias("got")).collect():
        assert r.got == r.want, r.text


def test_planted_lines_behind_odd_characters_equal_the_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    texts = ["call 415-555-2671²", "call 415-555-2671Ⓐ x", "basic abcdefghijklmnopqrst‍ x", "x " + "A1b2" * 9 + "½ x", "́ghp_" + "a1" * 12]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts * 3)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in redact_planted(spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(db.execute(ORACLES["redact_planted"]).fetchall())

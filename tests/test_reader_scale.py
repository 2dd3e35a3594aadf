from pyspark.sql import functions as F

from loglens import rollout_queries
from loglens.operators import sequence
from loglens.sources import jsonl as J
from loglens.sources import readers
from loglens.sources.config import config
from loglens.views import CUT, NOW


def test_a_line_is_parsed_once_however_often_it_is_read(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"type":"x","timestamp":"2024-01-01T00:00:00Z"}\n [1]\n\n{"type":\n\t{"type":"y","timestamp":5}\n')
    rows = J.scan(spark, str(tmp_path))
    rows = J.once(rows, type=J.string("$.type"), ts=J.seconds("$.timestamp")).where("ts > 1 AND type <> 'z'")
    assert rows._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") == 1
    assert sorted((r.type, r.ts) for r in rows.collect()) == [("x", 1704067200.0), ("y", 5.0)]
    assert J.scan(spark, str(tmp_path)).where("j IS NULL").count() == 3


def test_packed_files_keep_their_paths_and_order(spark, tmp_path):
    (tmp_path / "pack").write_text('u/1\t{"a":"x\\ty"}\nu/1\t\nu/2\tno json\n')
    rows = J.scan(spark, str(tmp_path), packed=True).orderBy("ord").select("path", "line", F.col("j").isNotNull().alias("read")).collect()
    assert [tuple(r) for r in rows] == [("u/1", '{"a":"x\\ty"}', True), ("u/1", "", False), ("u/2", "no json", False)]


def test_of_usage_records_of_one_time_the_first_event_counts(spark, tmp_path):
    first, again = 499, 499 + 30 * 86400  # the time starts anew after so many events
    events = [(e + 54 * k, u) for u in range(12) for k in range(4) for e in (first, again)]
    spark.createDataFrame(events, "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.session, r.ts, r.output) for r in rollout_queries.read_rollout_usage(spark, str(tmp_path)).collect()}
    want = {(str(u), 1704067200.0 + (e * 2593) % (30 * 86400), e % 13) for u in range(12) for e in (first, first + 54, first + 108, first + 162)}
    assert got == want


def _codex(spark, tmp_path, lines):
    (tmp_path / "r").mkdir()
    for name, text in lines.items():
        (tmp_path / "r" / name).write_text("\n".join(text) + "\n")
    (tmp_path / "history.jsonl").write_text('{"session_id":"s","ts":2,"text":"hi"}\n')
    parts, cfg = readers.Parts(spark), config(None, NOW, (NOW - CUT) // 86400, "codex")
    readers.codex(parts, cfg, J.scan(spark, str(tmp_path / "r"), parse=False), J.scan(spark, str(tmp_path / "history.jsonl")))
    return parts


def test_what_the_rollout_reader_tells_of_bad_lines_takes_no_further_parse_of_all_lines(spark, tmp_path):
    at, ts = '"timestamp":"2024-01-16T00:00:00Z"', 1705363200.0
    call = f'{{"type":"response_item",{at},"payload":{{"type":"function_call","call_id":"c","name":"n"}}}}'
    again = f'{{{at}, "payload":{{"name":"n","call_id":"c","type":"function_call"}},"type":"response_item"}}'
    parts = _codex(spark, tmp_path, {
        "a": ['{"\\u0074ype":"session\\u005fmeta","timestamp":1,"payload":{"id":"s"}}', call, "", "{cut", "{cut", '{"type":"x"}', f'{{{at},"payload":[1]}}', f'{{{at},"payload":null}}'],
        "b": ['{"type":"session_meta","timestamp":1,"payload":{"id":"s"}}', again, "no"],
        "c": [call.replace("n", "other"), "", '{"type":"x"}'],  # no session: only lines that aren't JSON objects are told
    })
    issues = parts.take("issues", readers.ISSUE)
    assert issues._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") == 1  # that of the typed history
    assert {r.code: r.n for r in issues.groupBy("code").agg(F.count("*").alias("n")).collect()} == {"malformed": 8, "missing_session_metadata": 1}
    assert [(r.session, r.ts, r.name) for r in parts.take("tools", readers.TOOL).collect()] == [("s", ts, "n")]


def test_types_of_odd_values(spark):
    rows = spark.createDataFrame([('{"p":{}}',), ('{"p":{"x":{"x":[1]}}}',), ('{"p":null}',), ("{}",), ('{"p":[{}]}',), ('{"p":"{}"}',), ('{"p":true}',), ('{"p":5}',), ('{"p":"5"}',)], "line string")
    rows = J.parsed(rows).select("line", J.is_object("$.p").alias("object"), J.array("$.p").isNotNull().alias("array"), J.seconds("$.p").alias("ts"))
    assert {r.line for r in rows.where("object").collect()} == {'{"p":{}}', '{"p":{"x":{"x":[1]}}}'}
    assert {r.line for r in rows.where("array").collect()} == {'{"p":[{}]}'}
    assert [(r.line, r.ts) for r in rows.where("ts IS NOT NULL").collect()] == [('{"p":5}', 5.0)]


def test_first_by_sorted_by_a_hash_keeps_the_same_rows(spark):
    df = spark.range(2000).selectExpr("concat('k', id % 37) AS k", "IF(id % 5 = 0, NULL, id % 3) AS g", "(id * 7919) % 2003 AS o")
    plain, hashed = (sequence.first_by(df, ["k", "g"], ["o"], hashed=h) for h in (False, True))
    assert sorted(map(str, plain.collect())) == sorted(map(str, hashed.collect()))
    assert "xxhash64" in hashed._jdf.queryExecution().optimizedPlan().toString()

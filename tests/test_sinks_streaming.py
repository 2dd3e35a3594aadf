import json
import os

import pytest
from pyspark.sql import functions as F

from loglens.sources import sinks
from loglens.streaming import live


def test_atomic_private_files(tmp_path):
    target, link = tmp_path / "t", tmp_path / "l.json"
    target.write_text("keep")
    link.symlink_to(target)
    sinks.write_json(str(link), {"a": 1})
    assert target.read_text() == "keep" and not link.is_symlink() and json.loads(link.read_text()) == {"a": 1}
    assert os.stat(link).st_mode & 0o777 == 0o600
    with pytest.raises(ValueError):
        sinks.write_json(str(link), float("nan"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["l.json", "t"]


def test_history_is_entered_once(tmp_path):
    folder = sinks.private_dir(str(tmp_path / "r"))
    sinks.write_json(f"{folder}/run.json", {"run_id": "r", "created": 1.0, "status": "ready", "presentation_profile": "limited"})
    history = str(tmp_path / "h/runs.jsonl")
    assert sinks.finalize(folder, history) and not sinks.finalize(folder, history)
    assert len(open(history).read().splitlines()) == 1 and json.load(open(f"{folder}/run.json"))["status"] == "complete"
    sinks.write_json(f"{folder}/run.json", {"run_id": "r", "status": "failed"})
    with pytest.raises(ValueError):
        sinks.finalize(folder, history)


def test_pointers_and_bundles():
    reports = {"stats": {"a/b": [1, {"~": 2}]}, "coaching": {}}
    assert sinks.resolve("/stats/a~1b/1/~0", reports) == 2
    for bad in ("/other", "/stats/x", "/stats/a~1b/9", "/stats/a~1b/x"):
        with pytest.raises(KeyError):
            sinks.resolve(bad, reports)
    assert sinks.validated({"prompts": [], "usage": []})
    for bad in ({"prompts": []}, {"prompts": [], "usage": [], "schema_version": 2}):
        with pytest.raises(ValueError):
            sinks.validated(bad)


def test_failed_preparation_says_so(spark, tmp_path):
    def broken():
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        sinks.prepare(spark, str(tmp_path / "out"), broken, 1.0)
    (run,) = (tmp_path / "out").glob("*/run.json")
    assert json.loads(run.read_text())["status"] == "failed"


def test_streams(spark, tmp_path):
    rows = [("p1", "a", "s", "do the thing", "2024-01-01 10:00:00"), ("p2", "a", "s", "No, wrong", "2024-01-01 10:05:00"), ("p3", "a", "s", "no wrong!", "2024-01-01 10:06:00"), ("p1", "a", "s", "do the thing", "2024-01-01 10:00:00")]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "id string, agent string, session string, text string, at string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    for name, df in (("once", live.deduplicated(stream, ["id"])), ("next", live.next_reactions(stream.dropDuplicates(["id", "at"])))):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(r.id for r in spark.table("once").collect()) == ["p1", "p2", "p3"]
    assert sorted((r.id, r.next_reaction) for r in spark.table("next").collect()) == [("p1", "correct"), ("p2", "retry")]


def test_bundle_reader(spark, tmp_path):
    from loglens.plans import stats
    from loglens.sources import bundle

    path = tmp_path / "b.json"
    prompt = {"ts": 1_800_000_000.0, "agent": "codex", "session": "s", "project": "p", "text": "hello there"}
    path.write_text(json.dumps({"prompts": [prompt, prompt | {"id": "own", "is_automation": True}], "usage": [{"ts": 1.5, "agent": "codex", "session": "s", "project": "p", "fresh_input": 50, "output": 100}]}))
    got = bundle.read(spark, str(path))
    assert sorted((r.id[:2], r.is_automation) for r in got["prompts"].collect()) == [("ow", True), ("p_", False)]
    assert stats.token_types(got["usage"]).first().total == 150 and got["tools"].count() == 0
    for bad in ({"usage": []}, {"schema_version": 9, "prompts": [], "usage": []}):
        path.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            bundle.read(spark, str(path))

import json
from pathlib import Path

from test_sources import NOW, claude, put, reply

from loglens.__main__ import main


def test_from_logs_to_report_without_secrets(spark, tmp_path, capsys):
    secret = "ghp_" + "a1" * 12
    texts = ["build the thing because we need it", f"No, still broken with {secret}", "Perfect, thanks! mail me@mail.example.com", "x" * 390 + f" {secret}"]
    put(tmp_path / "home/.claude/projects/p/a.jsonl", [*(claude("user", t, 500 - 10 * k) for k, t in enumerate(texts)), reply("m", {"input_tokens": 10, "output_tokens": 20})])
    assert main(["prepare", "--home", str(tmp_path / "home"), "--now", str(NOW), "--out", str(tmp_path / "out")]) == 0
    folder = Path(capsys.readouterr().out.strip().splitlines()[-1])
    run, stats, coaching = (json.loads((folder / f"{n}.json").read_text()) for n in ("run", "stats", "coaching"))
    assert run["status"] == "ready" and run["presentation_profile"] == "limited"
    assert stats["tokens"]["total"] == 30 and {r["kind"]: r["n"] for r in stats["redactions"]} == {"api_key": 2, "email": 1}
    assert coaching["summary"]["reactions"] == {"correct": 1, "praise": 1, "new-ask": 1, "end": 1}
    assert main(["finalize", str(folder), "--history", str(tmp_path / "h/runs.jsonl")]) == 0
    assert main(["finalize", str(folder), "--history", str(tmp_path / "h/runs.jsonl")]) == 0
    assert (folder / "index.html").read_text().count("<section") == 2 and len((tmp_path / "h/runs.jsonl").read_text().splitlines()) == 1
    for f in folder.rglob("*"):
        data = f.read_bytes() if f.is_file() else b""
        assert secret.encode() not in data and secret[:12].encode() not in data and b"me@mail" not in data, f
    lines = "".join(f.read_text() for f in (folder / "prompts").glob("part-*"))
    assert lines.count("\n") == 4 and "[redacted:key]" in lines


def test_reports_of_a_bundle_and_rendering_alone(spark, tmp_path):
    """stats, coaching and render as commands of their own, on a normalized bundle."""
    secret = "ghp_" + "b2" * 12
    texts = ["build the thing because we need it", f"No, still broken with {secret}", "Perfect, thanks!"]
    prompt = {"agent": "codex", "session": "s", "project": "shop", "surface": "cli", "is_automation": False}
    usage = {"ts": NOW - 50, "agent": "codex", "session": "s", "project": "shop", "model": "m", "fresh_input": 50, "cache_read": 200, "cache_write": 10, "output": 100, "reasoning": 3}
    session = {"agent": "codex", "sid": "s", "first": NOW - 7200, "last": NOW, "prompts": 3, "project": "shop"}
    bundle = {"schema_version": 1, "prompts": [prompt | {"ts": NOW - 100 + k, "text": t} for k, t in enumerate(texts)], "usage": [usage], "tools": [{"ts": NOW, "agent": "codex", "name": "Edit", "file_path": "/a/b.py", "session": "s"}], "sessions": {"codex:s": session}, "diagnostics": {"codex": {"status": "ok", "files_read": 1}}}
    (tmp_path / "bundle.json").write_text(json.dumps(bundle))
    out = tmp_path / "reports"
    for command in ("stats", "coaching"):
        assert main([command, str(tmp_path / "bundle.json"), "--out", str(out)]) == 0
    stats, coaching = (json.loads((out / f"{n}.json").read_text()) for n in ("stats", "coaching"))
    assert stats["tokens"]["total"] == 360 and stats["longest_sessions"] == [{"hours": 2.0, "project": "shop", "agent": "codex", "prompts": 3}]
    assert [a["usage_status"] for a in stats["agents"]] == ["ok"] and stats["edited_files"][0]["n"] == 1
    assert coaching["summary"]["reactions"] == {"correct": 1, "praise": 1, "end": 1}
    assert main(["render", str(out)]) == 0 and (out / "index.html").read_text().count("<section") == 2
    (out / "slides.json").write_text(json.dumps({"schema_version": 1, "profile": "limited", "title": "own", "slides": [{"type": "bignum", "value": 360}]}))
    assert main(["render", str(out)]) == 0 and (out / "index.html").read_text().count("<section") == 1
    assert not any(secret in f.read_text(errors="replace") for f in out.rglob("*") if f.is_file())

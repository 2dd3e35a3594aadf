import json
import os
import zipfile
from datetime import datetime, timezone

import pytest

from loglens.sources import folders, readers
from loglens.sources.config import config

NOW = 1_800_000_000.0


def iso(ago):
    return datetime.fromtimestamp(NOW - ago, timezone.utc).isoformat().replace("+00:00", "Z")


def put(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n", encoding="utf-8")


def extract(spark, home, **kw):
    return readers.extract(spark, config(str(home), NOW, **kw))


def diag(got, agent):
    return next(r for r in got["diagnostics"].collect() if r.agent == agent)


def claude(kind, content, ago=100, **more):
    return {"type": kind, "sessionId": "s1", "timestamp": iso(ago), "cwd": "/gone/shop/web", "entrypoint": "cli", "message": {"role": kind, "content": content}} | more


def reply(mid, usage, content=(), ago=90, **more):
    return {"type": "assistant", "sessionId": "s1", "timestamp": iso(ago), "cwd": "/gone/shop/web", "message": {"id": mid, "model": "m", "content": list(content), "usage": usage}} | more


def test_claude_code(spark, tmp_path):
    tool = {"type": "tool_use", "id": "t1", "name": "Edit", "input": {"file_path": "/a/b.py"}}
    put(tmp_path / ".claude/projects/p/a.jsonl", [
        claude("user", "<system-reminder>x</system-reminder>ok, now ship it"),
        claude("user", [{"type": "text", "text": "one"}, {"type": "image"}, {"type": "text", "text": "two"}], 99),
        claude("user", [{"type": "tool_result"}, {"type": "text", "text": "no"}], 98),
        claude("user", "Base directory for this skill: /x", 97),
        claude("user", "from a task", 96, origin={"kind": "peer"}),
        claude("user", "side", 95, isSidechain=True),
        claude("user", "[Request interrupted by user]", 94),
        claude("user", "old", 10 * 86400),
        claude("user", "future", -50),
        reply("m1", {"input_tokens": 10, "output_tokens": 20, "cache_read_input_tokens": 300, "output_tokens_details": {"thinking_tokens": 4}}, [tool]),
        reply("m1", {"input_tokens": 10, "output_tokens": 20, "cache_read_input_tokens": 300}, [tool]),
        reply("m2", {"input_tokens": True}), reply("m3", {"output_tokens": -1}), reply("m4", None, isSidechain=True),
        {"type": "summary", "timestamp": "x"}, claude("user", "no session", sessionId=None), claude("user", "bad time", timestamp="soon"), "{", "[]", "",
    ])
    got = extract(spark, tmp_path)
    said = {r.text: r for r in got["prompts"].collect()}
    assert {t: r.is_automation for t, r in said.items()} == {"ok, now ship it": False, "one\ntwo": False, "Base directory for this skill: /x": True, "from a task": True}
    assert said["one\ntwo"].project == "gone" and said["one\ntwo"].surface == "cli" and said["one\ntwo"].id.startswith("p_")
    used = [(r.fresh_input, r.cache_read, r.output, r.reasoning, r.side) for r in got["usage"].collect()]
    assert sorted(used) == [(0, 0, 0, 0, True), (10, 300, 20, 4, False)]
    assert [(r.name, r.file_path, r.skill) for r in got["tools"].collect()] == [("Edit", "/a/b.py", None)]
    d = diag(got, "claude-code")
    assert (d.malformed_records, d.issues, d.status, d.usable_prompts, d.usage_rows, d.files_read) == (5, {"invalid_usage": 2}, "partial", 2, 2, 1)
    s = got["sessions"].collect()
    assert [(r.session, r.prompts, r.first) for r in s] == [("s1", 2, NOW - 100)]
    assert len(extract(spark, tmp_path, days=30)["prompts"].collect()) == 5


def event(kind, ago, **payload):
    return {"type": kind, "timestamp": iso(ago), "payload": payload}


def said(text, ago):
    return event("response_item", ago, type="message", role="user", content=[{"type": "input_text", "text": text}])


def counter(total, ago, last=None):
    usage = lambda n: {"input_tokens": n, "cached_input_tokens": n // 2, "output_tokens": n // 10}
    return event("event_msg", ago, type="token_count", info={"total_token_usage": usage(total)} | ({"last_token_usage": usage(last)} if last else {}))


def rollout(home, *rows, sid="c1", name="a", **meta):
    put(home / f".codex/sessions/2027/{name}.jsonl", [event("session_meta", 9e5, id=sid, originator="codex-tui", cwd="/gone/first", **meta), *rows])


def test_codex_history_and_rollouts(spark, tmp_path):
    put(tmp_path / ".codex/history.jsonl", [{"session_id": "c1", "ts": NOW - 102, "text": "original"}, {"session_id": "c1", "ts": NOW - 102, "text": "original"}, {"session_id": "zz", "ts": NOW - 50, "text": "alone"}, {"session_id": 5, "ts": NOW, "text": "x"}])
    rows = [said("original", 100), said("follow-up", 80), said("<injected>", 70), event("turn_context", 60, cwd="/gone/second", model="g", effort="high"), said("moved", 50), event("response_item", 40, type="function_call", name="shell", call_id="k"),
            event("token_usage_record", 30, response_id="r", usage={"input_tokens": 1000, "cached_input_tokens": 800, "output_tokens": 5})]
    rollout(tmp_path, *rows)
    rollout(tmp_path, *rows, name="b")
    got = extract(spark, tmp_path, sources="codex")
    prompts = sorted((r.ts, r.text, r.session, r.project, r.surface) for r in got["prompts"].collect())
    assert prompts == [(NOW - 102, "original", "c1", "gone", "cli"), (NOW - 80, "follow-up", "c1", "gone", "cli"), (NOW - 50, "alone", "zz", "unknown", None), (NOW - 50, "moved", "c1", "gone", "cli")]
    assert {r.text: r.cwd for r in got["prompts"].collect()}["moved"] == "/gone/second"
    assert [(r.fresh_input, r.cache_read, r.output, r.model, r.effort, r.measurement) for r in got["usage"].collect()] == [(200, 800, 5, "g", "high", "response")]
    assert [r.name for r in got["tools"].collect()] == ["shell"]
    d = diag(got, "codex")
    assert d.malformed_records == 1 and d.issues == {"history_without_rollout": 1, "usage_unavailable": 1}
    assert {r.session: r.measured for r in got["checks"].collect()} == {"c1": 1005, "zz": 0}


def test_codex_counters(spark, tmp_path):
    record = lambda n: event("token_usage_record", 80, response_id="r", usage={"input_tokens": n, "cached_input_tokens": 100, "output_tokens": 20})
    cases = {
        "delta": ([counter(1000, 8 * 86400), counter(1200, 60), counter(1200, 50)], [(100, 100, 20)]),
        "partial": ([counter(1200, 60, last=200)], [(100, 100, 20)]),
        "missing": ([counter(1200, 60)], []),
        "reset": ([counter(1000, 90, last=1000), counter(100, 60)], [(500, 500, 100)]),
        "equal": ([counter(200, 90, last=200), record(200)], [(100, 100, 20)]),
        "unequal": ([counter(200, 90, last=200), record(300)], [(200, 100, 20)]),
    }
    for sid, (rows, _) in cases.items():
        rollout(tmp_path, *rows, sid=sid, name=sid)
    got = extract(spark, tmp_path, sources="codex")
    used = {}
    for r in got["usage"].collect():
        used.setdefault(r.session, []).append((r.fresh_input, r.cache_read, r.output))
    assert used == {sid: usage for sid, (_, usage) in cases.items() if usage}
    assert diag(got, "codex").issues == {"partial_counter_baseline": 1, "missing_counter_baseline": 1, "token_counter_reset": 1, "usage_cross_check_mismatch": 1}


def test_codex_malformed_and_automation(spark, tmp_path):
    put(tmp_path / ".codex/sessions/a.jsonl", [event("session_meta", 90, id="c1", originator="codex_exec", cwd="/tmp/x"), {"type": "turn_context", "timestamp": iso(80), "payload": []}, "{", "[]", said("go", 70)])
    put(tmp_path / ".codex/sessions/b.jsonl", [said("lost", 70)])
    got = extract(spark, tmp_path, sources="codex")
    assert [(r.text, r.is_automation, r.project, r.surface) for r in got["prompts"].collect()] == [("go", True, "Background automations", "exec")]
    d = diag(got, "codex")
    assert d.malformed_records == 3 and d.issues == {"missing_session_metadata": 1, "usage_unavailable": 1}


def node(parent, text, role="user", ago=60, **meta):
    return {"parent": parent, "message": {"author": {"role": role}, "create_time": NOW - ago, "content": {"parts": [text]}, "metadata": meta}}


def test_exports(spark, tmp_path):
    down = tmp_path / "Downloads"
    down.mkdir()
    tree = {"root": {"parent": None, "message": None}, "a": node("root", "start"), "b": node("a", "old"), "c": node("a", "edited"), "h": node("c", "hidden", is_visually_hidden_from_conversation=True), "d": node("h", "x" * 9, "assistant", model_slug="gm")}
    cyclic = {"a": node("b", "1"), "b": node("a", "2")}
    two = {"r": node(None, "one"), "s": node(None, "two")}
    convs = [{"id": "t", "current_node": "d", "mapping": tree}, {"id": "cy", "mapping": cyclic}, {"id": "two", "mapping": two}, {"id": "bad", "mapping": [1]}, {"id": "flat", "mapping": {"x": {"message": node(None, "flat")["message"]}}}]
    with zipfile.ZipFile(down / "chat.zip", "w") as z:
        z.writestr("in/conversations.json", json.dumps(convs))
        z.writestr("in/coverage.json", json.dumps({"all": True}))
    (down / "claude.json").write_text(json.dumps([{"uuid": "u", "chat_messages": [{"sender": "human", "text": "hello there", "created_at": iso(30)}, {"sender": "assistant", "text": "12345678", "created_at": iso(20)}, {"sender": "human", "text": "?", "created_at": None}]}]))
    (down / "broken.json").write_text("{")
    (down / "chatgpt-self-report.json").write_text("[]")
    os.utime(down / "chatgpt-self-report.json", (NOW, NOW))
    got = extract(spark, tmp_path, sources="chatgpt,claude-ai")
    said_by = sorted((r.session, r.text, r.project) for r in got["prompts"].collect())
    assert said_by == [("flat", "flat", "ChatGPT"), ("t", "edited", "ChatGPT"), ("t", "start", "ChatGPT"), ("two/branch/r", "one", "ChatGPT"), ("two/branch/s", "two", "ChatGPT"), ("u", "hello there", "claude.ai")]
    used = {(r.session, r.model, r.fresh_input, r.output) for r in got["usage"].collect() if r.output}
    assert used == {("t", "gm", 0, 2), ("u", None, 0, 2)} and all(r.estimated for r in got["usage"].collect())
    chat, other = diag(got, "chatgpt"), diag(got, "claude-ai")
    assert chat.malformed_records == 2 and chat.issues == {"active_branch_unknown": 1, "unreadable_export_candidate": 1, "invalid_self_report": 1}
    assert other.malformed_records == 1 and other.issues == {"unreadable_export_candidate": 1}
    assert got["provenance"]["chatgpt"]["coverage"] == {"all": True} and got["sources"] == {"chatgpt": "chat.zip", "claude-ai": "claude.json"}


def test_nothing_there(spark, tmp_path):
    got = extract(spark, tmp_path)
    assert got["prompts"].count() == 0 and {r.status for r in got["diagnostics"].collect()} == {"absent"}


def test_settings(tmp_path):
    for bad in ({"days": 0}, {"days": "x"}, {"sources": "other"}, {"sources": ""}, {"now": float("nan")}):
        with pytest.raises(ValueError):
            config(str(tmp_path), **({"now": NOW} | bad))


def places(spark, home, *paths, directories=None):
    rows = spark.createDataFrame([(p,) for p in paths], "folder string")
    return {r.folder: (r.project, r.workspace) for r in folders.places(rows, home, directories).collect()}


def test_folders(spark, tmp_path):
    """Made by hand: a repository, a linked work tree of it, a submodule, a folder whose .git is broken, and plain folders."""
    home = str(tmp_path / "me")
    repo, tree, sub, odd, plain = (tmp_path / "me" / x for x in ("code/shop", "trees/feature", "code/shop/lib", "odd", "plain/deep"))
    for folder in (repo / ".git/worktrees/feature", repo / ".git/modules/lib", repo / "src/app", tree / "src", sub, odd / ".git", plain):
        folder.mkdir(parents=True)
    (repo / ".git/HEAD").write_text("ref: refs/heads/main")
    (repo / ".git/worktrees/feature/commondir").write_text("../..\n")
    (tree / ".git").write_text(f"gitdir: {repo}/.git/worktrees/feature\n")
    (sub / ".git").write_text("gitdir: ../.git/modules/lib\n")
    background = lambda p: ("Background automations", None) if str(p).startswith(("/tmp/", "/var/folders/")) else None
    want = {
        "": ("unknown", None), home: ("No-folder sessions", None), home + "/": ("No-folder sessions", None), f"{home}/Documents/Codex/x": ("No-folder sessions", None),
        "/x/scratch-workspaces/y": ("No-folder sessions", None), "/tmp/q": ("Background automations", None), "/gone/shop/web": ("gone", "gone"), "file:///gone/a": ("gone", "gone"), "rel/part": ("rel", "rel"),
        str(repo): ("shop", "shop"), f"{repo}/src/app/": ("shop", "shop"), f"{repo}/src/gone/deep": ("shop", "shop"), f"file://{repo}//src/./app": ("shop", "shop"),
        f"{tree}/src": ("shop", "feature"), f"{tree}/not/there": ("shop", "feature"), f"{sub}/x": ("lib", "lib"),
        f"{odd}/new/er": ("new", "new"), str(plain): ("deep", "deep"), f"{plain}/a/b": ("a", "a"), f"{home}/lost/b": ("lost", "lost"),
    }
    got = places(spark, home, *want)
    for p, expected in want.items():
        under = str(p).removeprefix("file://")
        assert got[p] == (background(under) if background(under) and not under.startswith(f"{home}/Documents") and under.rstrip("/") != home and "scratch" not in under else expected), p


def test_folders_by_table(spark):
    known = spark.createDataFrame([("/", None), ("/r", None), ("/r/code", "shop"), ("/r/code/lib", None), ("/r/code/lib/tree", "shop"), ("/r/codex", None)], folders.KNOWN)
    paths = ["/r/code/lib/a", "/r/code/lib/tree/x/y", "/r/codex/new/a", "/r/code", "/r/cod", "/r", "/"]
    assert places(spark, "/home/me", *paths, directories=known) == {
        "/r/code/lib/a": ("shop", "code"), "/r/code/lib/tree/x/y": ("shop", "tree"), "/r/codex/new/a": ("new", "new"), "/r/code": ("shop", "code"), "/r/cod": ("cod", "cod"), "/r": ("r", "r"), "/": ("unknown", None),
    }


def test_broken_branches(spark, tmp_path):
    """A gap beside the active path does no harm; of several leaves those ahead of the first broken one count."""
    convs = [
        {"id": "beside", "current_node": "c", "mapping": {"a": node(None, "a"), "b": node("gone", "b"), "c": node("a", "c")}},
        {"id": "on", "current_node": "c", "mapping": {"a": node("gone", "a"), "c": node("a", "c")}},
        {"id": "late", "mapping": {"a": node(None, "first"), "b": node("gone", "b"), "c": node(None, "third")}},
        {"id": "loop", "mapping": {"a": node("b", "1"), "b": node("a", "2"), "c": node("a", "3"), "o": node(None, "4")}},
        {"id": "apart", "mapping": {"a": node("b", "1"), "b": node("a", "2"), "o": node(None, "own")}},
        {"id": "self", "mapping": {"a": node("a", "1")}},
    ]
    put(tmp_path / "Downloads/chat.json", [json.dumps(convs)])
    got = extract(spark, tmp_path, sources="chatgpt")
    assert sorted((r.session, r.text) for r in got["prompts"].collect()) == [("apart", "own"), ("beside", "a"), ("beside", "c"), ("late/branch/a", "first")]
    d = diag(got, "chatgpt")
    assert d.malformed_records == 4 and d.issues == {"active_branch_unknown": 3}


def test_newest_export_wins(spark, tmp_path):
    chat = lambda text: json.dumps([{"id": "x", "current_node": "a", "mapping": {"a": node(None, text)}}])
    for k, name in enumerate(["old.json", "new.json", "broken.json"]):
        put(tmp_path / "Downloads" / name, [chat(name) if name != "broken.json" else "[{"])
        os.utime(tmp_path / "Downloads" / name, (NOW + k * 100, NOW + k * 100))
    got = extract(spark, tmp_path, sources="chatgpt")
    assert [r.text for r in got["prompts"].collect()] == ["new.json"] and diag(got, "chatgpt").files_discovered == 3 and diag(got, "chatgpt").files_read == 1
    named = extract(spark, tmp_path, sources="chatgpt", exports=(str(tmp_path / "Downloads/old.json"), str(tmp_path / "gone.zip")))
    assert [r.text for r in named["prompts"].collect()] == ["old.json"] and diag(named, "chatgpt").issues == {"unreadable_export_candidate": 1}

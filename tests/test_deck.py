import copy

import pytest

from loglens.plans import deck


def parts():
    fact = {"label": "f", "value": 1}
    return {
        "cold": {"big": "1", "headline": "h"}, "bignum": {"value": 12, "bars": [{"segments": [{"label": "x", "value": 3, "agent": "codex", "color": "#fff"}]}]},
        "lineup": {"headline": "h", "acts": [{"agent": "codex", "tokens_label": "t", "prompts": 1, "sessions": 1}]}, "ranking": {"headline": "h", "rows": [{"name": "<b>", "value_label": "1", "segments": [{"value": 1}]}]},
        "quote": {"headline": "h", "quote": "few words"}, "tally": {"headline": "h", "tally": [{"label": "l", "value": 2, "suffix": "x"}]}, "compare": {"headline": "h", "rows": [{"label": "l", "pct": 50}]},
        "timeline": {"headline": "h", "items": [{"time": "1", "text": "t"}]}, "heatmap": {"headline": "h", "alt": "a", "days": [{"key": "2026-10-05", "label": "Mon"}], "hours": [10], "cells": {"2026-10-05|10": {"codex": 2}}},
        "coach": {"headline": "h", "confidence": "early signal", "why": "w", "try": "t", "kind": "win", "stat": {"type": "number", "value": 1, "label": "l"}, "evidence_refs": ["/coaching/x"]},
        "archetype": {"name": "n", "lede": "l", "evidence": [fact] * 3}, "outro": {"title": "t", "facts": [fact] * 6, "tries": ["t"] * 3},
    }


def full():
    p = parts()
    kinds = ["cold", "bignum", "lineup", "coach", "ranking", "heatmap", "coach", "tally", "coach", "archetype", "coach", "outro"]
    return {"title": "t", "seed": 7, "slides": [copy.deepcopy(p[k]) | {"type": k} for k in kinds]}


EVIDENCE = {"stats": {"tokens": {"total": 12}}, "coaching": {"x": {"confidence": "strong signal"}}}


def test_a_full_deck_passes_and_renders():
    page = deck.render(deck.validated(full(), EVIDENCE))
    assert page.count("<section") == 12 and "<b>" not in page and "&lt;b&gt;" in page and page == deck.render(full())
    every = [v | {"type": k} for k, v in parts().items() if k not in ("coach", "archetype")]
    every[-1] = {"type": "outro", "title": "t", "facts": [{"label": "l", "value": "v"}]}
    assert deck.render(deck.validated({"title": "t", "profile": "limited", "slides": every}))
    assert deck.validated(deck.limited({"tokens": {"total": 5}, "words": {"words_typed": 2}}))


@pytest.mark.parametrize("change", [
    lambda d: d["slides"][1].update(value=True), lambda d: d["slides"][1].update(value=13), lambda d: d["slides"][0].update(bg="red"), lambda d: d["slides"][3].update(confidence="sure"),
    lambda d: d["slides"][3].update(evidence_refs=[]), lambda d: d["slides"][3].update(evidence_refs=["/coaching/none"]), lambda d: d["slides"][5]["cells"].update({"2026-10-05|11": {}}), lambda d: d["slides"][5]["days"].append(d["slides"][5]["days"][0]),
    lambda d: d["slides"][5]["days"][0].update(key="soon"), lambda d: d["slides"].pop(), lambda d: d["slides"][11].update(tries=["other"] * 3), lambda d: d["slides"][11]["facts"].pop(), lambda d: d.update(profile="limited"), lambda d: d.update(seed=True),
    lambda d: d.update(schema_version=2), lambda d: d["slides"][4]["rows"][0]["segments"][0].update(color="red"), lambda d: d["slides"][0].update(type="other"), lambda d: [s.update(kind="tweak") for s in d["slides"] if s["type"] == "coach"], lambda d: d.update(slides=[]),
])
def test_mutations_are_refused(change):
    d = full()
    change(d)
    with pytest.raises(ValueError):
        deck.validated(d, EVIDENCE)


def test_quotes_stay_short_and_clean():
    slide = {"type": "quote", "headline": "h"}
    for bad in ("word " * 13, "see [email] there", "my secret"):
        with pytest.raises(ValueError):
            deck.validated({"title": "t", "profile": "custom", "slides": [slide | {"quote": bad}]}, scrub=lambda t: t.replace("secret", ""))


def test_figures():
    assert deck.shares([1, 3]) == [25, 75] and deck.shares([0]) == [0] and deck.opacity(4, 4) == 100 and deck.opacity(0, 4) == 0
    looks = deck.themes([{"type": "cold", "bg": "blue"}, {"type": "quote", "bg": "blue"}, {"type": "ranking"}], 1)
    assert looks[0] == "blue" != looks[1] and looks[2] in ("ink", "paper")


def test_heat_map_splits_a_cell_between_two_agents():
    slide = parts()["heatmap"] | {"type": "heatmap", "cells": {"2026-10-05|10": {"codex": 1, "chatgpt": 3, "claude-ai": 2}}}
    page = deck.render({"title": "t", "seed": 7, "slides": [slide]})
    assert f"linear-gradient(135deg,{deck.COLOURS['chatgpt']} 50%,{deck.COLOURS['claude-ai']} 50%);opacity:100%" in page and ">6</td>" in page
    assert deck.cell_style({"codex": 1}, 4) == f"background:{deck.COLOURS['codex']};opacity:68%" and deck.cell_style({}, 4) == "background:none;opacity:0%"

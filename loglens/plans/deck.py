"""Slide decks over reports: a schema that says what every component holds, and a plain HTML rendering.

A schema is a table of field rules. A rule takes (value, where) and yields complaints, which name the field and never its
content. Decks are small driver-side values; nothing here touches Spark.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Callable, Iterator
from datetime import date

from loglens.sources.config import AGENTS
from loglens.sources.sinks import SCHEMA_VERSION, resolve

Rule = Callable[[object, str], Iterator[str]]

# Themes, palette names, profiles and the slots of a full deck.
THEMES = ["ink", "blue", "yellow", "paper", "pink", "orange", "green"]
PALETTE = ["fg", "ink", "paper", "pink", "blue", "yellow", "green", "orange", "claude", "codex", "chatgpt", "claudeai"]
PROFILES = ["default-12", "custom", "limited"]
SLOTS = {0: "cold", 1: "bignum", 2: "lineup", 3: "coach", 4: "ranking", 6: "coach", 8: "coach", 9: "archetype", 10: "coach", 11: "outro"}
MAX_SLIDES, MAX_TEXT, MAX_QUOTE_WORDS = 40, 4096, 12
CONFIDENCE = r"strong signal|early signal|one moment|small sample · [1-9][0-9]*"
MARKER = r"(?i)\[(?:redacted[^\]]*|email|phone)\]"


def said(ok: bool, where: str, what: str) -> Iterator[str]:
    if not ok:
        yield f"{where} {what}"


def words(value: object, where: str) -> Iterator[str]:
    yield from said(isinstance(value, str) and 0 < len(value.strip()) and len(value) <= MAX_TEXT, where, "must be text that is neither empty nor too long")


def number(most: float = math.inf, whole: bool = False) -> Rule:
    def rule(value: object, where: str) -> Iterator[str]:
        fine = type(value) in (int, float) and math.isfinite(value) and 0 <= value <= most and (not whole or value == int(value))  # type: ignore[operator,arg-type]
        yield from said(fine, where, "must be a finite number from 0" + (f" to {most:g}" if most < math.inf else "") + (", whole" if whole else ""))

    return rule


def either(value: object, where: str) -> Iterator[str]:
    yield from (words if isinstance(value, str) else number())(value, where)


def one_of(allowed: list[str] | frozenset[str]) -> Rule:
    return lambda value, where: said(isinstance(value, str) and value in allowed, where, "is not among the known ones")


def like(pattern: str) -> Rule:
    return lambda value, where: said(isinstance(value, str) and bool(re.fullmatch(pattern, value)), where, "has not the expected form")


def listed(rule: Rule, least: int = 1, most: int | None = None) -> Rule:
    def every(value: object, where: str) -> Iterator[str]:
        if not isinstance(value, list) or len(value) < least or (most is not None and len(value) > most):
            yield f"{where} must be a list of {least} or more" + (f", at most {most}" if most else "")
            return
        for k, item in enumerate(value):
            yield from rule(item, f"{where}[{k}]")

    return every


def table(**rules: Rule) -> Rule:
    """An object; fields whose name ends in _ may be missing."""

    def fields(value: object, where: str) -> Iterator[str]:
        if not isinstance(value, dict):
            yield f"{where} must be an object"
            return
        for name, rule in rules.items():
            key = name.rstrip("_")
            if key in value or not name.endswith("_"):
                yield from rule(value.get(key), f"{where}.{key}")

    return fields


def suffix(value: object, where: str) -> Iterator[str]:
    yield from said(isinstance(value, str), where, "must be text")


def quotation(scrub: Callable[[str], str]) -> Rule:
    def rule(value: object, where: str) -> Iterator[str]:
        yield from words(value, where)
        if isinstance(value, str):
            yield from said(len(value.split()) <= MAX_QUOTE_WORDS, where, f"must have at most {MAX_QUOTE_WORDS} words")
            yield from said(not re.search(MARKER, value) and scrub(value) == value, where, "must hold nothing private and no redaction mark")

    return rule


def heat(value: dict, where: str) -> Iterator[str]:
    """What a heat map's parts ask of each other."""
    days = [d.get("key") for d in value.get("days") or [] if isinstance(d, dict)]
    for key in days:
        try:
            date.fromisoformat(str(key))
        except ValueError:
            yield f"{where}.days must be calendar dates"
    yield from said(len({*map(str, days)}) == len(days), f"{where}.days", "must be unique")
    shown = {f"{d}|{h}" for d in days for h in value.get("hours", range(8, 23))}
    cells = value.get("cells")
    yield from said(isinstance(cells, dict), f"{where}.cells", "must be an object")
    for at, counts in (cells if isinstance(cells, dict) else {}).items():
        yield from said(at in shown, f"{where}.cells", "must lie in the days and hours shown")
        yield from said(isinstance(counts, dict) and set(counts) <= AGENTS, f"{where}.cells", "must count by agent")
        for n in counts.values() if isinstance(counts, dict) else []:
            yield from number()(n, f"{where}.cells")


def components(profile: str, scrub: Callable[[str], str]) -> dict[str, Rule]:
    full = profile == "default-12"
    # fixed value: how a colour may be written
    color = like(r"#[0-9a-fA-F]{3}(?:[0-9a-fA-F]{3})?|var\(--(?:" + "|".join(PALETTE) + r")\)")
    agent, quote = one_of(AGENTS), quotation(scrub)
    part = dict(value=number(), color_=color, agent_=agent)
    segments, named = listed(table(**part)), listed(table(**part, label=words))
    fact, tallied = table(label=words, value=either), listed(table(label=words, value=either, suffix_=suffix))
    compared = listed(table(label=words, pct=number(100), n_label_=words))
    stats = {"compare": table(rows=compared), "number": table(value=either, label=words), "quote": table(quote=quote, context_=words)}

    def stat(value: object, where: str) -> Iterator[str]:
        kind = value.get("type") if isinstance(value, dict) else None
        yield from stats[kind](value, where) if kind in stats else said(False, where, "must compare, count or quote")

    return {
        "cold": table(big=words, headline=words),
        "bignum": table(value=number(whole=True), bars_=listed(table(label_=words, segments=named), 0)),
        "lineup": table(headline=words, acts=listed(table(agent=agent, tokens_label=words, prompts=number(whole=True), sessions=number(whole=True), role_=words, line_=words, surfaces_=words))),
        "ranking": table(headline=words, rows=listed(table(name=words, value_label=words, segments=segments, meta_=words))),
        "quote": table(headline=words, quote=quote, tally_=tallied),
        "tally": table(headline=words, tally=tallied),
        "compare": table(headline=words, rows=compared, tally_=tallied),
        "timeline": table(headline=words, items=listed(table(time=words, text=words, agent_=agent))),
        "heatmap": table(headline=words, alt=words, days=listed(table(key=words, label=words)), hours_=listed(number(23, True))),
        "coach": table(headline=words, confidence=like(CONFIDENCE), why=words, **{"try": words}, kind=one_of(["win", "tweak"]), stat=stat),
        "archetype": table(name=words, lede=words, evidence=listed(fact, 3, 3)),
        "outro": table(title=words, facts=listed(fact, 6 if full else 1, 6), tries=listed(words, 3, 3), footer_=words) if full else table(title=words, facts=listed(fact, 1, 6), tries_=listed(words, 0, 3), footer_=words),
    }


def complaints(deck: object, evidence: dict | None = None, scrub: Callable[[str], str] = lambda t: t) -> Iterator[str]:
    """Everything that is wrong with a deck. evidence: the reports its slides refer to, as {"stats": .., "coaching": ..}."""
    if not isinstance(deck, dict):
        yield "deck must be an object"
        return
    profile = deck.get("profile", "default-12")
    yield from words(deck.get("title"), "title")
    yield from said(deck.get("schema_version", SCHEMA_VERSION) == SCHEMA_VERSION, "schema_version", "is unknown")
    yield from said(profile in PROFILES, "profile", "is unknown")
    yield from said(type(deck.get("seed", 0)) is int, "seed", "must be a whole number")
    known, slides = components(profile, scrub), deck.get("slides")
    found = list(listed(lambda v, w: said(isinstance(v, dict) and v.get("type") in known, w, "must be a known component"), 1, MAX_SLIDES)(slides, "slides"))
    yield from found
    if found:
        return
    common = table(bg_=one_of(THEMES), eyebrow_=words, headline_=words, lede_=words, small_=words, lens_=words)
    for k, s in enumerate(slides):
        at = f"slides[{k}]"
        yield from common(s, at)
        yield from known[s["type"]](s, at)
        if s["type"] == "heatmap":
            yield from heat(s, at)
        refs, values = s.get("evidence_refs", []), []
        yield from listed(like(r"/(?:stats|coaching)/.*"), int(s["type"] == "coach" and profile == "default-12"))(refs, f"{at}.evidence_refs")
        for ref in refs if evidence is not None and isinstance(refs, list) else []:
            try:
                values.append(resolve(str(ref), evidence))
            except KeyError:
                yield f"{at}.evidence_refs does not lead to a measured value"
        claim = s.get("confidence") if s["type"] == "coach" else None
        if evidence is not None and claim in ("strong signal", "early signal"):
            enough = ["strong signal"] if claim == "strong signal" else ["strong signal", "early signal"]
            yield from said(any(isinstance(v, dict) and v.get("confidence") in enough for v in values), f"{at}.confidence", "is more than its evidence says")
    kinds = [s["type"] for s in slides]
    if profile == "limited":
        yield from said(not {"coach", "archetype"} & {*kinds}, "slides", "must not judge on little data")
    if profile == "default-12":
        yield from said(len(slides) == 12 and all(kinds[k] == v for k, v in SLOTS.items()), "slides", "must fill the twelve slots")
        coaches = [s for s in slides if s["type"] == "coach"]
        yield from said(len(coaches) == 4 and sum(s.get("kind") == "win" for s in coaches) >= 2, "slides", "must hold four coaching slides, two wins among them")
        tries = slides[-1].get("tries")
        yield from said({*map(str, tries if isinstance(tries, list) else [])} <= {str(s.get("try")) for s in coaches}, "tries", "must come from coaching slides")
        if evidence is not None and len(slides) > 1:
            yield from said(slides[1].get("value") == evidence["stats"]["tokens"]["total"], "slides[1].value", "must be the measured total")


def validated(deck: dict, evidence: dict | None = None, scrub: Callable[[str], str] = lambda t: t) -> dict:
    """The deck, or ValueError with the first complaint."""
    for problem in complaints(deck, evidence, scrub):
        raise ValueError(problem)
    return deck


def limited(stats: dict) -> dict:
    """A deck for little data: counts, nothing judged."""
    total = stats["tokens"]["total"]
    facts = [{"label": "Tokens", "value": total}, {"label": "Words typed", "value": stats["words"]["words_typed"]}]
    return {"schema_version": SCHEMA_VERSION, "profile": "limited", "title": "A short look back", "slides": [{"type": "bignum", "value": total, "lede": "tokens"}, {"type": "outro", "title": "What was counted", "facts": facts}]}


def shares(values: list[float]) -> list[float]:
    """Widths in percent; all zero where there is nothing to share."""
    total = sum(values) or 1
    return [100 * v / total for v in values]


def opacity(n: float, most: float) -> int:  # fixed value: the steps from 35 to 100 percent
    return round((0.35 + 0.65 * math.sqrt(n / most)) * 100) if n and most else 0


#: Colours of agents in a heat map; others are grey.
COLOURS = {"claude-code": "#c8643c", "codex": "#2f7f6b", "chatgpt": "#4b6fb5", "claude-ai": "#b58a2f"}


def cell_style(counts: dict, most: float) -> str:
    """A cell's colour by the agent that counts most there, cut across into those of the first two where there are more."""
    top = [COLOURS.get(a, "#888") for a in sorted(counts, key=lambda a: -counts[a])[:2]]
    fill = f"linear-gradient(135deg,{top[0]} 50%,{top[1]} 50%)" if len(top) > 1 else "".join(top)
    return f"background:{fill or 'none'};opacity:{opacity(sum(counts.values()), most)}%"


def themes(slides: list[dict], seed: int) -> list[str]:
    """A theme for each slide: the wanted one unless the slide before has it, else a seeded choice of another."""
    rng, out = random.Random(seed), []
    for s in slides:
        last = out[-1] if out else None
        want = s.get("bg")
        free = ["ink", "paper"] if s["type"] in ("bignum", "ranking", "heatmap", "lineup") else THEMES
        out.append(want if want and want != last else rng.choice([t for t in free if t != last]))
    return out


def _bars(segments: list[dict], most: float | None = None) -> str:
    widths = shares([s["value"] for s in segments]) if most is None else [100 * s["value"] / (most or 1) for s in segments]
    return "<div class=bar>" + "".join(f'<i style="width:{w:.2f}%" title="{html.escape(str(s.get("label", "")))}"></i>' for w, s in zip(widths, segments, strict=True)) + "</div>"


def _body(s: dict) -> str:
    e = lambda v: html.escape(f"{v:,}" if type(v) is int else str(v))
    rows = lambda items, f: "<ul>" + "".join(f"<li>{f(x)}</li>" for x in items) + "</ul>"
    parts = [f"<h1>{e(s[k])}</h1>" for k in ("big", "headline", "name", "title") if k in s]
    if s["type"] == "bignum":
        parts.append(f"<h1>{e(s['value'])}</h1>")
        parts += [_bars(b["segments"]) for b in s.get("bars", [])]
    if "acts" in s:
        parts.append(rows(s["acts"], lambda a: f"{e(a['agent'])}: {e(a['tokens_label'])}, {e(a['prompts'])} / {e(a['sessions'])}"))
    if s["type"] == "ranking":
        most = max(sum(x["value"] for x in r["segments"]) for r in s["rows"])
        parts.append(rows(s["rows"], lambda r: f"{e(r['name'])} {e(r['value_label'])}{_bars(r['segments'], most)}"))
    if s["type"] == "compare":
        parts.append(rows(s["rows"], lambda r: f"{e(r['label'])} {e(r['pct'])}%"))
    if "quote" in s:
        parts.append(f"<blockquote>{e(s['quote'])}</blockquote>")
    if "tally" in s:
        parts.append(rows(s["tally"], lambda r: f"{e(r['label'])} {e(r['value'])}{e(r.get('suffix', ''))}"))
    if "items" in s:
        parts.append(rows(s["items"], lambda r: f"{e(r['time'])} {e(r['text'])}"))
    if s["type"] == "heatmap":
        totals = {k: sum(v.values()) for k, v in s["cells"].items()}
        most = max(totals.values(), default=0)
        hours = s.get("hours", range(8, 23))
        at = lambda d, h: f"{d['key']}|{h}"
        cell = lambda k: f'<td style="{cell_style(s["cells"].get(k, {}), most)}">{totals.get(k, "")}</td>'
        cells = "".join(f"<tr><th>{e(d['label'])}</th>" + "".join(cell(at(d, h)) for h in hours) + "</tr>" for d in s["days"])
        parts.append(f'<table aria-label="{e(s["alt"])}">{cells}</table>')
    if s["type"] == "coach":
        stat = s["stat"]
        shown = rows(stat["rows"], lambda r: f"{e(r['label'])} {e(r['pct'])}%") if stat["type"] == "compare" else e(stat.get("value", stat.get("quote")))
        parts.append(f"<p>{e(s['confidence'])}</p><div>{shown}</div><p>{e(s['why'])}</p><p>{e(s['try'])}</p>")
    for key in ("evidence", "facts"):
        if key in s:
            parts.append(rows(s[key], lambda r: f"{e(r['label'])} {e(r['value'])}"))
    if s.get("tries"):
        parts.append(rows(s["tries"], e))
    parts += [f"<p>{e(s[k])}</p>" for k in ("lede", "small", "footer") if k in s]
    return "".join(parts)


def render(deck: dict) -> str:
    """One self-contained HTML page; every text is escaped."""
    looks = themes(deck["slides"], deck.get("seed", 0))
    slides = "".join(f'<section class="{t} {s["type"]}">{_body(s)}</section>' for s, t in zip(deck["slides"], looks, strict=True))
    style = "section{min-height:100vh;padding:4rem;scroll-snap-align:start}.bar{display:flex;height:2rem}.bar i{background:currentColor;margin-right:1px}.ink{background:#111;color:#fff}.paper{background:#faf6ee}.blue{background:#9cf}.yellow{background:#fd5}.pink{background:#fac}.orange{background:#fb7}.green{background:#ad9}"
    return f'<!doctype html><html lang="en"><meta charset="utf-8"><title>{html.escape(deck["title"])}</title><style>{style}</style>{slides}</html>\n'

"""python -m loglens prepare|finalize|extract|stats|coaching|render|cleanup, with LOGLENS_DAYS, LOGLENS_SOURCES and LOGLENS_HOME as defaults."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession

from loglens.plans import coaching, deck
from loglens.sources import bundle, readers, sinks
from loglens.sources.config import config


def rendered(spark: SparkSession, folder: str) -> None:
    """index.html of a folder from its reports and slides.json; a deck of counts where there are no slides."""
    reports = {}
    for name in ("stats", "coaching"):
        with open(f"{folder}/{name}.json", encoding="utf-8") as f:
            reports[name] = json.load(f)
    slides = deck.limited(reports["stats"])
    if os.path.exists(f"{folder}/slides.json"):
        with open(f"{folder}/slides.json", encoding="utf-8") as f:
            slides = json.load(f)
    sinks.write_text(f"{folder}/index.html", deck.render(deck.validated(slides, reports, sinks.scrubber(spark))))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="loglens")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("prepare", "extract"):
        s = sub.add_parser(name)
        s.add_argument("--home", default=os.environ.get("LOGLENS_HOME"))
        s.add_argument("--days", default=os.environ.get("LOGLENS_DAYS", "7"))
        s.add_argument("--sources", default=os.environ.get("LOGLENS_SOURCES", "all"))
        s.add_argument("--export", action="append", default=[])
        s.add_argument("--now", type=float)
        s.add_argument("--out", required=True)
    s = sub.add_parser("finalize")
    s.add_argument("folder")
    s.add_argument("--history", required=True)
    for name in ("stats", "coaching"):
        s = sub.add_parser(name, help=f"the {name} report of a normalized bundle")
        s.add_argument("bundle")
        s.add_argument("--out", required=True)
    s = sub.add_parser("render")
    s.add_argument("folder")
    s = sub.add_parser("cleanup")
    s.add_argument("folder")
    a = p.parse_args(argv)
    if a.command == "cleanup":
        print("\n".join(sinks.cleanup(a.folder)))
        return 0
    spark = SparkSession.builder.appName("loglens").config("spark.sql.session.timeZone", os.environ.get("TZ", "UTC")).getOrCreate()
    if a.command in ("finalize", "render"):
        rendered(spark, a.folder)
        if a.command == "finalize":
            print("new" if sinks.finalize(a.folder, a.history) else "known")
        return 0
    if a.command in ("stats", "coaching"):
        data = bundle.read(spark, a.bundle)
        sinks.private_dir(a.out)
        if a.command == "stats":
            sinks.write_stats(spark, data | {"sources": {}, "provenance": {}}, a.out)
        else:
            sinks.write_coaching(spark, coaching.rows(data["prompts"]), a.out)
        print(a.out)
        return 0
    cfg = config(a.home, a.now, a.days, a.sources, tuple(a.export))
    if a.command == "extract":
        sinks.raw_dump(readers.extract(spark, cfg), a.out)
        print(a.out)
    else:
        print(sinks.prepare(spark, a.out, lambda: readers.extract(spark, cfg), cfg.now))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

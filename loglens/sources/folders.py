"""Which project and workspace a working folder belongs to: a longest-prefix join with the directories that are known.

Every folder is cut into its prefixes, which are equi-joined with a table of directories: those that exist, and among them the
tops of git work trees with the repository that they come from. The longest prefix of either kind decides. Prefixes that very
many folders share (`/`, `/home`) are joined by broadcast. The table is made by one pass over the distinct prefixes, in tasks
that look at the file system; transcripts are read from the same home, so tasks see it.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.operators import lookup, settled
from loglens.sources.config import BACKGROUND, SCRATCH

KNOWN = "path string, repository string"


def plain(folder: Column) -> Column:
    """A folder without scheme, empty or dot parts, and closing slashes."""
    path = F.regexp_replace(F.coalesce(folder, F.lit("")), "^file://", "")
    path = F.regexp_replace(F.regexp_replace(path, r"/(\./)*(?=/)", ""), r"/\.(?=/|$)", "")
    return F.rtrim(path, F.lit("/"))


def named(path: Column, home: str) -> Column:
    """The fixed project of folders that have one, else NULL; path is plain()."""
    nowhere = (path == home) | F.contains(path, F.lit(SCRATCH)) | F.startswith(path, F.lit(f"{home}/Documents/Codex"))
    background = F.lit(False)
    for head in BACKGROUND:
        background = background | F.startswith(path, F.lit(head))
    return F.when(path == "", "unknown").when(nowhere, "No-folder sessions").when(background, "Background automations")


def prefixes(paths: DataFrame) -> DataFrame:
    """(path) -> (path, depth, prefix): the path cut behind each of its parts; the root of absolute ones is a part."""
    parts = F.split("path", "/")
    cut = paths.select("path", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"))
    prefix = F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/")
    return cut.select("path", "depth", F.when(prefix == "", "/").otherwise(prefix).alias("prefix"))


def _repository(path: str) -> str | None:
    """The name of the repository whose work tree has its top here. A linked work tree names its git folder in a file, and
    that folder names the one it shares with the repository."""
    mark = Path(path, ".git")
    if mark.is_dir():
        return Path(os.path.realpath(path)).name if (mark / "HEAD").exists() else None
    if not mark.is_file():
        return None
    head, _, where = mark.read_text(encoding="utf-8", errors="replace").strip().partition("gitdir: ")
    folder = Path(path, where)
    if head or not where or not folder.is_dir():
        return None
    shared = folder / "commondir"
    common = Path(os.path.realpath(folder / shared.read_text().strip() if shared.is_file() else folder))
    return (common.parent if common.name == ".git" else common).name or Path(path).name


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        there, names = [], []
        for path in batch.column("path").to_pylist():
            try:
                if os.path.isdir(path):
                    name = _repository(path)
                    there.append(path)
                    names.append(name)
            except (OSError, ValueError):
                continue
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.string()), pa.array(names, pa.string())], names=["path", "repository"])


def known(paths: DataFrame) -> DataFrame:
    """(path) -> the rows of KNOWN for those of the paths and their prefixes that are directories."""
    every = prefixes(paths).select(F.col("prefix").alias("path")).distinct()
    return every.mapInArrow(_look, KNOWN)


def places(folders: DataFrame, home: str, directories: DataFrame | None = None) -> DataFrame:
    """(folder), distinct -> (folder, project, workspace).

    Folders with a fixed name have no workspace. Others belong to the work tree that they lie in, which counts to its
    repository; outside any, to the first part below the deepest directory that exists, or to that directory if it is the
    folder itself. directories: rows of KNOWN, one a path; without it the file system is looked at.
    """
    own = settled(folders.select("folder", plain(F.col("folder")).alias("path")))
    fixed = named(F.col("path"), home)
    asked = settled(own.where(fixed.isNull()).select("path").distinct())
    directories = settled(known(asked) if directories is None else directories)
    marked = lookup(settled(prefixes(asked)), directories.select(F.col("path").alias("prefix"), "repository"), "prefix")
    found = marked.groupBy("path").agg(F.max("depth").alias("there"), F.max(F.when(F.col("repository").isNotNull(), F.struct("depth", "repository", "prefix"))).alias("tree"))
    below = F.split("path", "/")
    there = F.coalesce("there", F.startswith("path", F.lit("/")).cast("int"))
    name = F.get(below, F.least(there, F.size(below) - 1))
    out = own.join(found, "path", "left").select(
        "folder", fixed.alias("fixed"), F.coalesce("tree.repository", name).alias("name"), F.coalesce(F.substring_index("tree.prefix", "/", -1), name).alias("workspace")
    )
    return out.select("folder", F.coalesce("fixed", "name").alias("project"), F.when(F.col("fixed").isNull(), F.col("workspace")).alias("workspace"))

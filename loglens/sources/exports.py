"""Chat exports as Python data sources: JSON arrays of conversations, plain or inside a zip, split while they are streamed.

`chat_export_files` reads each candidate file in a task of its own and gives a row about it: whether it can be read, whose
export it is, how large its array is. `chat_export` reads the conversations of chosen files. A partition is a range of the
(unpacked) array: it passes over what lies before it without parsing, stops behind its end, and holds one conversation at a
time. Nothing of an export reaches the driver but the rows about files.

Files are opened where Spark's tasks run, through the scheme of their path, so they must be in a shared place on a cluster.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAX_EXPORT, MAX_COVERAGE = 256 << 20, 1 << 20
MEMBER, BESIDE = "conversations.json", "coverage.json"
CHUNK = 1 << 20
#: k counts the conversations of a file below these bits, and files above them.
FILE_BITS = 32
#: Bytes of the array that one partition takes.
RANGE = 32 << 20
FILES = "path string, readable boolean, agent string, size long, coverage string"
CONVERSATIONS = "path string, k long, line string"

_OUTSIDE, _DEEPER = re.compile(rb'["{}\[\],]'), re.compile(rb'["{}\[\]]')
_STRING, _STOP = re.compile(rb'"[^"\\]*(?:\\.[^"\\]*)*"', re.DOTALL), re.compile(rb'["\\]')


class NotArray(ValueError):
    """The document is no JSON array."""


def elements(stream: BinaryIO, start: int = 0, stop: float = float("inf"), chunk: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """(k, text) of the elements of a JSON array that begin at bytes start to stop - 1; text is not parsed. NotArray if the
    document doesn't begin as an array, ValueError if it ends inside it or goes on behind it (if that is reached)."""
    at, k, depth, quoted, skip, own, begun = 0, 0, 0, False, 0, [], 0
    blank, empty, over = True, True, False
    while data := stream.read(chunk):
        pos, mark = skip, 0  # mark: where this chunk's part of the element begins
        skip = 0
        if blank:
            pos = len(data) - len(data.lstrip())
            if pos == len(data):
                at += len(data)
                continue
            if data[pos : pos + 1] != b"[":
                raise NotArray("no array")
            blank, depth, pos = False, 1, pos + 1
            mark, begun = pos, at + pos
        while pos < len(data):
            if over:
                if data[pos:].strip():
                    raise ValueError("something stands behind the array")
                break
            if quoted:
                found = _STOP.search(data, pos)
                if not found:
                    break
                if found[0] == b"\\":
                    pos = found.end() + 1
                    skip = max(0, pos - len(data))
                    continue
                quoted, pos = False, found.end()
                continue
            found = (_OUTSIDE if depth == 1 else _DEEPER).search(data, pos)
            if not found:
                break
            what, pos = found[0], found.end()
            if what == b'"':
                whole = _STRING.match(data, found.start())
                quoted, pos = not whole, whole.end() if whole else pos
            elif what in b"{[":
                depth += 1
            elif depth > 1 and what in b"}]":
                depth -= 1
            elif what == b"}":
                raise ValueError("a brace too many")
            else:  # the end of an element, or of the array
                inside = start <= begun < stop
                if inside:
                    own.append(data[mark : found.start()])
                text = b"".join(own) if inside else b""
                own = []
                last = what != b","
                if not (last and empty and not text.strip() and inside):
                    if inside:
                        yield k, text
                    k += 1
                empty = False
                mark, begun = pos, at + pos
                if last:
                    over, depth = True, 0
                elif begun >= stop:
                    return
        if not over and start <= begun < stop:
            own.append(data[mark:])
        at += len(data)
    if not over:
        raise NotArray("no array") if blank else ValueError("the array has no end")


def _open(path: str) -> BinaryIO:
    path = re.sub(r"^file:/+", "/", path)
    if re.match(r"[a-z][a-z0-9+.-]+:", path):
        from pyarrow import fs

        where, inner = fs.FileSystem.from_uri(path)
        return where.open_input_file(inner)
    return open(path, "rb")


@dataclass
class Member:
    """An opened export: its array, that array's size and the coverage file beside it."""

    array: BinaryIO | None
    size: int
    coverage: str | None = None


def member(f: BinaryIO, path: str) -> Member:
    """The array of an opened export; none in a zip without one. ValueError if a part is too large."""
    if not path.lower().endswith(".zip"):
        size = f.seek(0, io.SEEK_END)
        f.seek(0)
        if size > MAX_EXPORT:
            raise ValueError("export too large")
        return Member(f, size)
    z = zipfile.ZipFile(f)
    sizes = {i.filename: i.file_size for i in z.infolist()}
    name = next((n for n in sizes if n.split("/")[-1] == MEMBER), None)
    if name is None:
        return Member(None, 0)
    beside = name[: -len(MEMBER)] + BESIDE
    if sizes[name] > MAX_EXPORT or sizes.get(beside, 0) > MAX_COVERAGE:
        raise ValueError("export too large")
    coverage = json.dumps(json.loads(z.read(beside))) if beside in sizes else None
    return Member(z.open(name), sizes[name], coverage)


def agent_of(conversation: object) -> str | None:
    """Whose export it is, by the keys of its first conversation."""
    if not isinstance(conversation, dict):
        return None
    return "chatgpt" if "mapping" in conversation else "claude-ai" if "chat_messages" in conversation else None


def about(path: str) -> tuple:
    """A row of FILES. Every conversation is parsed, one at a time, as a file counts as read only if all of it is JSON."""
    try:
        with closing(_open(path)) as f:
            own = member(f, path)
            if own.array is None:
                return path, True, None, 0, None
            agent = None
            try:
                for k, text in elements(own.array):
                    parsed = json.loads(text)
                    agent = agent_of(parsed) if k == 0 else agent
            except NotArray:
                f.seek(0)
                json.loads(member(f, path).array.read())  # within MAX_EXPORT
            return path, True, agent, own.size, own.coverage
    except (OSError, ValueError, RuntimeError, zipfile.BadZipFile):
        return path, False, None, 0, None


@dataclass
class Range(InputPartition):
    file: int
    path: str
    start: int
    stop: int


class _Files(DataSourceReader):
    def __init__(self, files: list) -> None:
        self.files = files

    def partitions(self) -> list[Range]:
        return [Range(n, path, 0, 0) for n, path in enumerate(self.files)]

    def read(self, partition: Range) -> Iterator[tuple]:
        yield about(partition.path)


class _Conversations(DataSourceReader):
    def __init__(self, files: list, size: int) -> None:
        self.files, self.size = files, size

    def partitions(self) -> list[Range]:
        return [Range(n, path, at, at + self.size) for n, (path, size) in enumerate(self.files) for at in range(0, max(size, 1), self.size)]

    def read(self, partition: Range) -> Iterator[tuple]:
        with closing(_open(partition.path)) as f:
            array = member(f, partition.path).array
            if array is not None:
                for k, text in elements(array, partition.start, partition.stop):
                    yield partition.path, (partition.file << FILE_BITS) + k, json.dumps(json.loads(text), sort_keys=True)


class ExportFiles(DataSource):
    """Option files: a JSON array of paths."""

    @classmethod
    def name(cls) -> str:
        return "chat_export_files"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Files(json.loads(self.options["files"]))


class ExportConversations(DataSource):
    """Options files: a JSON array of [path, size of the array]; rangebytes: bytes per partition."""

    @classmethod
    def name(cls) -> str:
        return "chat_export"

    def schema(self) -> str:
        return CONVERSATIONS

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Conversations(json.loads(self.options["files"]), int(self.options.get("rangebytes", RANGE)))


def candidates(spark: SparkSession, paths: list[str], pattern: str = "*.{zip,json}") -> DataFrame:
    """(path, modified, length) of files, or of those below folders that match the pattern; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(paths)
    return found.select("path", F.col("modificationTime").alias("modified"), "length")


def inspected(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A row of FILES per path."""
    spark.dataSource.register(ExportFiles)
    return spark.read.format("chat_export_files").option("files", json.dumps(paths)).load()


def conversations(spark: SparkSession, files: list[tuple[str, int]], range_bytes: int = RANGE) -> DataFrame:
    """(path, k, line) of the conversations in files (path, size of the array), as JSON with sorted keys; k tells them apart
    and keeps the order of files and of conversations in them."""
    spark.dataSource.register(ExportConversations)
    return spark.read.format("chat_export").option("files", json.dumps([list(f) for f in files])).option("rangebytes", str(range_bytes)).load()

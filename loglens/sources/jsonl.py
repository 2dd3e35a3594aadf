"""Tolerant scans of JSON lines, and the checks that loosely typed records need."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBERS = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|INT|SMALLINT|TINYINT)$"


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row. A generator lies between them and what reads them; without it the optimizer
    puts their expressions into each filter and column above, where a JSON line was parsed again for every use."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def parsed(lines: DataFrame) -> DataFrame:
    """lines (line, ...) with j: the JSON object of the line, NULL if it is none."""
    return once(lines, j=F.when(F.rlike("line", F.lit(r"^[ \t\r\n]*\{")), F.expr("try_parse_json(line)")))


def may_say(word: str) -> Column:
    """Whether a line may hold the string, without parsing it: a word of ASCII letters and underscores stands in JSON as it is
    or with a \\u escape."""
    return F.contains("line", F.lit(word)) | F.contains("line", F.lit("\\u"))


def scan(spark: SparkSession, root: str, pattern: str | None = None, packed: bool = False, parse: bool = True) -> DataFrame:
    """(path, ord, line, j): every line of the files below root, blank ones too, with its place and its JSON object; j is NULL
    if the line is not one. Large files are split; ord is the order of lines within a file. root may be in any store that
    Spark reads. packed: files hold the lines of many small ones, each behind the path of its own and a tab. Without parse
    there is no j, for readers that don't need that of every line."""
    reader = spark.read.option("recursiveFileLookup", "true")
    raw = (reader.option("pathGlobFilter", pattern) if pattern else reader).text(root)
    path, line = F.col("_metadata.file_path"), F.col("value")
    if packed:
        path, line = F.substring_index("value", "\t", 1), F.expr("substr(value, instr(value, '\t') + 1)")
    raw = raw.select(path.alias("path"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("ord"), line.alias("line"))
    return parsed(raw) if parse else raw


def lines(spark: SparkSession, root: str, pattern: str = "*.jsonl", parse: bool = True) -> DataFrame | None:
    """scan() of a file, or of the files below a folder that match the pattern; None if there is no file."""
    if os.path.isdir(root) and not any(f.endswith(pattern.lstrip("*")) for _, _, fs in os.walk(root) for f in fs):
        return None
    if not os.path.isdir(root) and "://" not in root and not os.path.exists(root):
        return None
    return scan(spark, root, pattern if os.path.isdir(root) else None, parse=parse)


def at(path: str, j: str = "j") -> Column:
    return F.expr(f"try_variant_get({j}, '{path}', 'variant')")


def kind(path: str, j: str = "j") -> Column:
    """STRING, BIGINT, BOOLEAN, OBJECT<..>, ARRAY<..>, VOID for null; NULL if there is nothing at path."""
    return F.schema_of_variant(at(path, j))


def string(path: str, j: str = "j") -> Column:
    """A string at path; NULL for anything else."""
    return F.when(kind(path, j) == "STRING", F.expr(f"try_variant_get({j}, '{path}', 'string')"))


def shown(path: str, j: str = "j") -> Column:
    """Any scalar at path as a string, empty ones as NULL."""
    return F.nullif(F.expr(f"try_variant_get({j}, '{path}', 'string')"), F.lit(""))


def number(path: str, j: str = "j") -> Column:
    """A number at path; a boolean is none."""
    return F.when(F.rlike(kind(path, j), F.lit(NUMBERS)), F.expr(f"try_variant_get({j}, '{path}', 'double')"))


def is_object(path: str, j: str = "j") -> Column:
    """By a cast, which looks one field up; kind() would go through all that the object holds."""
    return F.expr(f"try_variant_get({j}, '{path}', 'struct<x: variant>')").isNotNull()


def array(path: str, j: str = "j") -> Column:
    return F.expr(f"try_variant_get({j}, '{path}', 'array<variant>')")


def truthy(path: str, j: str = "j") -> Column:
    return F.coalesce(F.expr(f"try_variant_get({j}, '{path}', 'boolean')"), F.lit(False))


def seconds(path: str, j: str = "j") -> Column:
    """Epoch seconds from a number or an ISO time; NULL if it is neither or not finite."""
    n = number(path, j)
    iso = F.unix_micros(F.try_to_timestamp(F.expr(f"try_variant_get({j}, '{path}', 'string')"))) / 1e6
    return F.when(kind(path, j) == "STRING", iso).when(~F.isnan(n) & (F.abs(n) < 1e15), n)


def valid_numbers(base: str, fields: list[str], j: str = "j") -> Column:
    """Whether each of the fields of the object at base is missing or a finite number of at least 0."""
    ok = F.lit(True)
    for f in fields:
        n = number(f"{base}.{f}", j)
        ok = ok & (kind(f"{base}.{f}", j).isNull() | F.coalesce((n >= 0) & (n < float("inf")), F.lit(False)))
    return ok


def amount(base: str, field: str, j: str = "j") -> Column:
    return F.coalesce(number(f"{base}.{field}", j), F.lit(0.0))

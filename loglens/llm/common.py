"""Helpers shared by the training-text operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII characters that are no digit and no letter, as a Java character class.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); only where it is unset, as in tests, one of our own."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = tempfile.mkdtemp(prefix="loglens-")
        spark.conf.set("spark.checkpoint.dir", where)
        spark.sparkContext.setCheckpointDir(where)
    return where


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """df, written once to the shared folder and read back: later stages don't depend on the executors that made it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loglens-{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(side: DataFrame) -> DataFrame:
    """side for a join that sorts and spills. Spark takes what is read of files, or exploded, at the size of its files, however many
    rows they unpack to or are made of each, and so might send through the driver a side that grows with the input."""
    return side.hint("merge")


def lookup(rows: DataFrame, side: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with side, which has a row per key at most; rows should be stored, as they are read twice.
    Keys of more than a thousandth of all rows, of which there are under a thousand, are broadcast; the others are shuffled."""
    n = rows.count()
    heavy = stored(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > max(1000, n // 1000)).select(key), "heavy-keys")
    few = F.broadcast(heavy.join(side, key, how))
    rest = rows.join(F.broadcast(heavy), key, "left_anti").join(side, key, how)
    return rows.join(few, key).unionByName(rest)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Only the named columns reach the scan, so extra ones can't clash."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def ascii_lower(text: Column) -> Column:
    """A-Z only; other scripts stay as they are. NULL counts as empty. Pure ASCII texts take the faster way."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def spaced(text: Column) -> Column:
    """Lower-cased words of letters, digits and non-ASCII characters, one space between them, none at the ends."""
    return F.trim(F.regexp_replace(ascii_lower(text), SEPARATORS, " "))


def words(spaced_text: Column) -> Column:
    """Words of what spaced() gives; an empty array for an empty text."""
    return F.when(spaced_text == "", F.array().cast("array<string>")).otherwise(F.split(spaced_text, " "))


def n_words(spaced_text: Column) -> Column:
    return F.when(spaced_text == "", F.lit(0)).otherwise(F.length(spaced_text) - F.length(F.replace(spaced_text, F.lit(" "), F.lit(""))) + 1).cast("long")


def release() -> None:
    """Gives freed memory of a Python worker back to the system; workers are reused by later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)

"""The folder that driver and executors share, for tables that queries write and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where that is unset, as in tests, a folder of our own."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = tempfile.mkdtemp(prefix="loglens-")
        spark.conf.set("spark.checkpoint.dir", where)
        spark.sparkContext.setCheckpointDir(where)
    return where


def written(lines: DataFrame, name: str, by: str | None = None) -> str:
    """A new shared folder that holds lines (value, ...) as text, in a file per value of `by` if given; its rows keep their
    order within a task."""
    path = f"{shared_dir(lines.sparkSession)}/loglens-{name}-{uuid.uuid4().hex}"
    out = lines.write.partitionBy(by) if by else lines.write
    out.text(path)
    return path

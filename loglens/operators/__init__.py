"""Relational operators over normalized log tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """df with its lineage cut: a reliable checkpoint in the shared folder if the session names one, else kept in memory and
    on disk. For loops and for results that several plans read."""
    if df.sparkSession.sparkContext.getCheckpointDir():
        return df.checkpoint()
    df = df.persist()
    df.count()
    return df


def lookup(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """rows joined with side, which has a row per key at most; rows should be settled, as they are read twice. Keys of more
    than a thousandth of all rows, of which there are under a thousand, are broadcast; the others are shuffled."""
    n = rows.count()
    heavy = settled(rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > max(1000, n // 1000)).select(key))
    few = F.broadcast(side.join(F.broadcast(heavy), key, "left_semi"))
    rest = rows.join(F.broadcast(heavy), key, "left_anti").join(side, key)
    return rows.join(few, key).unionByName(rest)

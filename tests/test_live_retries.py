import random

import pytest
from pyspark.sql import functions as F

from loglens.streaming import live

HOUR = 3600


@pytest.fixture
def store(spark):
    old = {k: spark.conf.get(k, None) for k in live.STATE_STORE}
    for k, v in live.STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def put(spark, source, rows):
    df = spark.createDataFrame(rows, "id string, agent string, session string, text string, s double")
    df.withColumn("at", F.timestamp_seconds("s")).drop("s").coalesce(1).write.mode("append").parquet(source)


def run(spark, source, schema, at):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = live.retries(stream, delay="2 hours").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/mark").trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    return sorted(r.id for r in spark.read.schema("id string, again_id string").parquet(f"{at}/out").collect())


def slow(rows):
    again = set()
    for i, a, s, t, at in rows:
        if any(len(t) >= 20 and t2.lower() == t.lower() and (a2, s2) != (a, s) and (at2, i2) > (at, i) and at2 - at < 24 * HOUR for i2, a2, s2, t2, at2 in rows):
            again.add(i)
    return sorted(again)


def test_retries_with_late_rows_and_restart(spark, store, tmp_path):
    """Rows out of order within the delay count, a restart goes on where the stream stopped, and each prompt is told once."""
    rnd = random.Random(8)
    texts = ["please run the whole suite again", "Please RUN the whole suite again", "explore the next feature of it", "too short"]
    rows = [(f"p{k:03d}", "a", f"s{rnd.randrange(4)}", rnd.choice(texts), float(rnd.randrange(0, 96 * HOUR))) for k in range(60)]
    late = ("late", "b", "s9", texts[0], 50.0 * HOUR)
    in_time = sorted(rows, key=lambda r: r[4] + rnd.uniform(0, 1.5 * HOUR))  # arrive up to 1.5 hours late
    source = str(tmp_path / "in")
    put(spark, source, in_time[:20])
    schema = spark.read.parquet(source).schema
    first = run(spark, source, schema, tmp_path)
    assert set(first) <= set(slow(rows)) and len(first) == len(set(first))
    put(spark, source, in_time[20:40])
    put(spark, source, in_time[40:])
    run(spark, source, schema, tmp_path)
    put(spark, source, [late])  # behind the watermark: too late to count
    assert run(spark, source, schema, tmp_path) == slow(rows)

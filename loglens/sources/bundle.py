"""A normalized bundle, as one JSON file, read into the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.functions import text
from loglens.sources.sinks import SCHEMA_VERSION

PROMPT = "id string, ts double, agent string, session string, project string, workspace string, surface string, text string, is_automation boolean, branch string"
USAGE = "ts double, agent string, session string, project string, workspace string, model string, effort string, side boolean, branch string, estimated boolean, measurement string, fresh_input double, cache_read double, cache_write double, output double, reasoning double"
TOOL = "ts double, agent string, session string, name string, file_path string, skill string"
SESSION = "agent string, sid string, first double, last double, prompts bigint, project string"


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """prompts, usage, tools, sessions and diagnostics of a bundle; usage and tools carry `ord`, their place in it. Prompts
    without an id get one.

    ValueError if the version is another one, or prompts or usage are no lists. Missing flags are false, missing counts 0.
    """
    listed = lambda fields: f"struct<{fields.replace(' ', ':').replace(',:', ',')}>"
    parts = [f"prompts array<{listed(PROMPT)}>", f"usage array<{listed(USAGE)}>", f"tools array<{listed(TOOL)}>", f"sessions map<string,{listed(SESSION)}>", "diagnostics map<string,struct<status:string>>"]
    raw = spark.read.schema(f"schema_version bigint, {', '.join(parts)}").option("multiLine", "true").json(path)
    head = raw.select(F.coalesce("schema_version", F.lit(SCHEMA_VERSION)).alias("v"), F.col("prompts").isNotNull().alias("p"), F.col("usage").isNotNull().alias("u")).first()
    if head is None or head.v != SCHEMA_VERSION:
        raise ValueError("unknown schema_version")
    if not (head.p and head.u):
        raise ValueError("prompts and usage must be lists")
    out = {name: raw.select(F.posexplode(name).alias("ord", "x")).select("ord", "x.*") for name in ("prompts", "usage", "tools")}
    out["sessions"] = raw.select(F.explode(F.map_values("sessions")).alias("x")).select("x.*")
    out["diagnostics"] = raw.select(F.explode("diagnostics").alias("agent", "x")).select("agent", "x.status")
    own = F.coalesce("id", text.prompt_id(F.col("agent"), F.col("session"), F.col("ts"), F.coalesce("text", F.lit(""))))
    out["prompts"] = out["prompts"].withColumn("id", own).withColumn("is_automation", F.coalesce("is_automation", F.lit(False))).drop("ord")
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("fresh_input", "cache_read", "cache_write", "output", "reasoning")}
    out["usage"] = out["usage"].withColumns(zero | {c: F.coalesce(c, F.lit(False)) for c in ("side", "estimated")})
    return out

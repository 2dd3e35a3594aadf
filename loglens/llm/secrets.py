"""Secret scans over an incremental blob ledger.

Texts are addressed by the SHA-256 of their content, whatever path and version they stand under. The ledger is a table of
(blob, rule_version, spans): a pair that it holds is never scanned again, so a new version of a file costs one scan, a
copy or a return to an old version costs none, and a new rule version scans each blob once more for that rule set alone.
Findings are joined back to all paths. Everything runs as DataFrame expressions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.llm.common import shared_dir, stored, table

# The kinds in their listed order. (kind, pattern, group whose length counts, least length)
BASE_RULES = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # the maximal runs of 24 or more among all runs
]
# Rules of our own, from the public descriptions of the formats: JWTs (RFC 7519), PEM private keys (RFC 7468, the header and
# the base64 lines that follow), tokens of some services by their prefixes, and a login in a URL (RFC 3986 userinfo). None
# of them looks at a character more than a few times, however long a text is.
_SAFE = "A-Za-z0-9._~%!$&'()*+,;="
_JWT = r"eyJ[A-Za-z0-9_-]{8,}%s\.[A-Za-z0-9_-]{8,}%s\.[A-Za-z0-9_-]{8,}"
_PEM = r"-----BEGIN (?:RSA |EC |DSA |ENCRYPTED |OPENSSH )?PRIVATE KEY-----(?:\s+[A-Za-z0-9+/]{16,}={0,2})*"
_PREFIXED = r"\b(?:ghp_[A-Za-z0-9]{36}|glpat-[A-Za-z0-9_-]{20}|xox[abps]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})"
MORE_RULES = [
    ("jwt", r"(?<![A-Za-z0-9_-])" + _JWT % ("+", "+"), 0, 0),
    ("private_key", _PEM + "+", 0, 0),
    ("prefixed", _PREFIXED, 0, 0),
    ("url_login", rf"//[{_SAFE}-]+:[{_SAFE}:-]+@", 0, 0),
]
RULE_SETS = {"base/1": BASE_RULES, "more/2": MORE_RULES}
KINDS = [kind for rules in RULE_SETS.values() for kind, *_ in rules]
SPAN = "array<struct<start:int,rank:int,stop:int>>"
CHUNK = 256
#: The setting that names the folder of a ledger that runs share.
LEDGER = "spark.loglens.ledger"


def spans(text: Column, pattern: str, group: int, least: int, rank: int) -> Column:
    """Leftmost non-overlapping matches as (start, rank, stop) in code points, without those whose group is too short.

    Matches are folded CHUNK at a time and the chunks put one behind the other, so no array grows match by match.
    """
    rx = F.lit(pattern)
    found, between, counted = F.regexp_extract_all(text, rx, F.lit(0)), F.split(text, pattern, -1), F.regexp_extract_all(text, rx, F.lit(group))
    rows = F.arrays_zip(found.alias("m"), F.slice(between, 1, F.size(found)).alias("b"), counted.alias("g"))
    sizes = F.transform(rows, lambda x: F.struct(F.length(x["b"]).alias("gap"), F.length(x["m"]).alias("size"), (F.length(x["g"]) >= least).alias("ok")))
    chunks = lambda xs: F.transform(F.sequence(F.lit(0), F.greatest(F.size(xs) - 1, F.lit(0)), F.lit(CHUNK)), lambda i: F.slice(xs, i + 1, F.lit(CHUNK)))
    none = F.array().cast(SPAN)
    span = lambda start, stop: F.struct(start.alias("start"), F.lit(rank).alias("rank"), stop.alias("stop"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        stop = start + x["size"]
        return F.struct(stop.alias("at"), F.when(x["ok"], F.concat(acc["out"], F.array(span(start, stop)))).otherwise(acc["out"]).alias("out"))

    def behind(acc: Column, part: Column) -> Column:
        moved = F.transform(part["out"], lambda s: span(s["start"] + acc["at"], s["stop"] + acc["at"]))
        return F.struct((acc["at"] + part["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), none.alias("out"))
    parts = F.get(F.transform(F.array(sizes), lambda xs: F.transform(chunks(xs), lambda c: F.aggregate(c, zero, step))), F.lit(0))
    got = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")), behind, lambda acc: F.flatten(acc["out"]))
    return F.when(F.rlike(text, rx), got).otherwise(none)


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def scan(history: DataFrame, ledger: str, rule_sets: dict | None = None) -> DataFrame:
    """history (path, version, text, ...) -> (path, version, blob, spans), a row per row; the ledger folder is extended.

    A NULL text counts as empty. Spans are sorted by start, then kind in listed order. Blobs and rule versions that the
    ledger holds already are not scanned. Copies, repeated rows and NULL paths are allowed.
    """
    spark, rule_sets = history.sparkSession, RULE_SETS if rule_sets is None else rule_sets
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = stored(history.select("path", "version", blob_of(F.col("text")).alias("blob")), "versions")
    rules = spark.createDataFrame([(k,) for k in rule_sets], "rule_version string")
    firsts = keyed.groupBy("blob").agg(F.min(F.struct("path", "version")).alias("first"))
    try:
        known = spark.read.schema(f"blob binary, rule_version string, spans {SPAN}").parquet(ledger)
    except Exception as e:  # the ledger does not exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = spark.createDataFrame([], f"blob binary, rule_version string, spans {SPAN}")
    done = known.select("blob", "rule_version").distinct().groupBy("blob").agg(F.collect_set("rule_version").alias("done"))
    todo = firsts.join(done, "blob", "left").select("blob", "first", F.array_except(F.array(*[F.lit(k) for k in rule_sets]), F.coalesce("done", F.array().cast("array<string>"))).alias("todo")).where(F.size("todo") > 0)
    source = history.select(F.struct("path", "version").alias("first"), text.alias("text"), blob_of(F.col("text")).alias("blob"))
    unseen = source.join(todo.hint("shuffle_hash"), (source["blob"] == todo["blob"]) & source["first"].eqNullSafe(todo["first"])).select(source["blob"], "text", "todo")
    per_set = []
    for name, listed in rule_sets.items():
        own = [spans(F.col("text"), p, g, n, KINDS.index(kind)) for kind, p, g, n in listed]
        per_set.append(F.when(F.array_contains("todo", name), F.struct(F.lit(name).alias("rule_version"), F.concat(*own).alias("spans"))))
    new = unseen.select("blob", F.explode(F.filter(F.array(*per_set), lambda x: x.isNotNull())).alias("x")).select("blob", "x.rule_version", "x.spans").dropDuplicates(["blob", "rule_version"])
    new.write.mode("append").parquet(ledger)
    findings = spark.read.schema(known.schema).parquet(ledger).where(F.col("rule_version").isin(list(rule_sets)) & (F.size("spans") > 0))
    per_blob = findings.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    out = keyed.join(per_blob, "blob", "left")
    return out.select("path", "version", "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def named(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["stop"])), ",")


def redacted(text: Column, found: Column) -> Column:
    """text with every stretch that spans cover replaced by a mark with the kind of its first span. Texts with a span are cut
    into characters once, so each is copied once."""
    kinds = F.array(*[F.lit(k) for k in KINDS])

    def step(acc: Column, s: Column) -> Column:
        piece = F.struct(acc["at"].alias("from"), s["start"].alias("to"), s["rank"].alias("rank"))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(piece))).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.greatest(acc["at"], s["stop"]).alias("at"))

    def put(chars: Column, acc: Column) -> Column:
        part = lambda a, n: F.array_join(F.slice(chars, a + 1, n), "")
        mark = lambda p: F.concat(part(p["from"], p["to"] - p["from"]), F.lit("[secret:"), F.get(kinds, p["rank"]), F.lit("]"))
        return F.concat(F.array_join(F.transform(acc["out"], mark), ""), part(acc["at"], F.size(chars)))

    none = F.array().cast("array<struct<from:int,to:int,rank:int>>")
    zero = F.struct(none.alias("out"), F.lit(0).alias("at"))
    whole = F.get(F.transform(F.array(F.split(text, "")), lambda chars: F.aggregate(found, zero, step, lambda acc: put(chars, acc))), F.lit(0))
    return F.when(F.size(found) > 0, whole).otherwise(text)


def ledger_dir(spark: SparkSession) -> str:
    """The ledger that LEDGER names, which later runs extend; where it is unset, a new one in the shared folder."""
    return spark.conf.get(LEDGER, None) or f"{shared_dir(spark)}/loglens-ledger-{uuid.uuid4().hex}"


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan() of documents as paths of one version. NULL and empty texts hold nothing; repeated rows and rows of equal
    doc_id each get a row by their own text; an empty table gives none; other columns are not read."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = scan(docs.select(F.col("doc_id").alias("path"), F.lit(0).alias("version"), "text"), ledger_dir(spark))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_RULES))
    count = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("long")
    counts = [count(k).alias(f"n_{kind}") for k, (kind, *_) in enumerate(BASE_RULES)]
    return found.select(F.col("path").alias("doc_id"), *counts, F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))


#: DuckDB knows neither lookbehind nor possessive quantifiers: what precedes is matched too, the span being the group.
SQL_FORMS = {"jwt": ("(?:^|[^A-Za-z0-9_-])(" + _JWT % ("", "") + ")", 1), "private_key": (_PEM, 0)}


def _spans_sql(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    pattern, own = SQL_FORMS.get(kind, (pattern, 0))
    p = pattern.replace("'", "''")
    ahead = "len(m) - len(g)" if own else "0"
    before = "coalesce(list_sum(list_transform(ps[1:i], lambda z: len(z))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda z: len(z))), 0)"
    return f"""SELECT rid, {rank} AS rank, '{kind}' AS kind, start + {ahead} AS start, start + len(m) AS stop FROM (
  SELECT rid, ms[i] AS m, gs[i] AS g, CAST({before} AS BIGINT) AS start FROM (
    SELECT rid, ms, gs, ps, unnest(range(1, len(ms) + 1)) AS i FROM (
      SELECT rid, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {own or group}) AS gs, string_split_regex(t, '{p}') AS ps FROM d WHERE regexp_matches(t, '{p}')))) WHERE len(g) >= {least}"""


_ALL_SQL = " UNION ALL ".join(_spans_sql(KINDS.index(r[0]), *r) for rules in RULE_SETS.values() for r in rules)

OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({_ALL_SQL}),
g AS (SELECT rid, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < {len(BASE_RULES)}) AS base,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM s GROUP BY rid)
SELECT d.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.rid = g.rid
"""

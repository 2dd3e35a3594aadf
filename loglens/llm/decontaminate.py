"""Benchmark decontamination over a distributed positional inverted index.

The corpus is kept once as a forward index of normalized texts. Posting lists are written from it, a row (term, row_id, pos)
per occurrence, for the terms that a query starts from. A phrase is answered from its rarest terms:

- Of every window of a phrase the rarest term by corpus frequency is an anchor. Each posting of its list gives an alignment,
  document position - phrase position, which is kept if the list of the window's next rarest term has its place.
- The lists of the other terms are stored as far as they concern rows with an alignment.
- Each alignment says where the terms around its anchor must stand. These places are intersected with the lists by an
  equi-join on row, position and term; runs of hits as long as a window are occurrences.

As every window holds its own anchor, no occurrence is lost. Nothing carries texts or whole phrases along: the tables that
are joined have a term and a few numbers a row. A side is broadcast only if its rows times their width are within
BROADCAST_BYTES; beyond it the join is a shuffle whose keys are salted, so that a hot term or phrase is no single task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglens.llm.common import LOWER, UPPER, n_words, spaced, stored, table, words

WINDOW = 10
#: Sides of a join are broadcast up to this size, counted as rows times ROW_BYTES and the bytes of their terms.
BROADCAST_BYTES, ROW_BYTES = 48 << 20, 64
SALTS = 16


def forward_index(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> stored (row_id, doc_id, text_key, n_words, body); row_id tells rows with equal doc_id apart."""
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id"), F.xxhash64("text").alias("text_key"), spaced(F.col("text")).alias("body"))
    return stored(rows.select("row_id", "doc_id", "text_key", n_words(F.col("body")).alias("n_words"), "body"), "forward")


def spread_join(many: DataFrame, few: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """many joined with a stored few: broadcast if it is small enough, else with each of its rows in SALTS copies that the
    rows of many are dealt to."""
    text = reduce(lambda a, b: a + b, (F.octet_length(c) for c, t in few.dtypes if t == "string"), F.lit(0))
    size = few.agg(F.sum(F.lit(ROW_BYTES) + F.coalesce(text, F.lit(0)))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return many.join(F.broadcast(few), keys, how)
    salted = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(*[c for c in many.columns if c != "body"]), F.lit(SALTS)).cast("int")
    return many.withColumn("_salt", salt).join(salted, [*keys, "_salt"], how).drop("_salt")


def _tokens(index: DataFrame) -> DataFrame:
    return index.where("n_words > 0").select("row_id", F.posexplode(words(F.col("body"))).alias("pos", "term"))


def term_counts(index: DataFrame, terms: DataFrame) -> DataFrame:
    """Occurrences of each of the distinct stored terms (term) in the whole index; 0 for terms that don't occur."""
    found = spread_join(_tokens(index).select("term"), terms, ["term"]).groupBy("term").agg(F.count("*").alias("n"))
    return terms.join(found, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def postings(index: DataFrame, terms: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """The stored posting lists (term, row_id, pos) of the stored terms (term), of all rows or of the stored rows (row_id)."""
    own = index if rows is None else spread_join(index, rows, ["row_id"], "left_semi")
    return stored(spread_join(_tokens(own), terms, ["term"]).select("term", "row_id", "pos"), "postings")


def phrases(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """items (item_id, text, ...) -> stored (phrase_id, item_id, ipos, last, size, term), a row per word of a distinct phrase;
    last is the last ipos, size the window's: all words of an item that has fewer."""
    made = items.select("item_id", words(spaced(F.col("text"))).alias("words")).where(F.size("words") > 0).distinct()
    made = stored(made.withColumn("phrase_id", F.monotonically_increasing_id()), "phrases")
    n = F.size("words")
    own = made.select("phrase_id", "item_id", (n - 1).alias("last"), F.least(n, F.lit(window)).alias("size"), F.posexplode("words").alias("ipos", "term"))
    return stored(own, "phrase-terms")


def anchors(made: DataFrame, counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """phrases() -> (phrase_id, last, size, term, apos, second, bpos): the rarest term of each window and the next rarest, NULL
    in windows of one word; first position on ties. Windows with a term that doesn't occur have none."""
    known = made.join(counts, "term")
    ahead = Window.partitionBy("phrase_id").orderBy("ipos").rowsBetween(0, window - 1)
    ranked = F.array_sort(F.collect_list(F.struct("n", "ipos", "term")).over(ahead))
    rarest = known.withColumn("r", ranked).where(F.col("ipos") + F.col("size") - 1 <= F.col("last"))
    first, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    out = rarest.where(first["n"] > 0).select("phrase_id", "last", "size", first["term"].alias("term"), first["ipos"].alias("apos"), second["term"].alias("second"), second["ipos"].alias("bpos"))
    return out.distinct()


def alignments(listed: DataFrame, anchored: DataFrame) -> DataFrame:
    """The posting lists of the anchors' terms and next rarest terms, and anchors() -> stored (row_id, phrase_id, off, low,
    high): where both stand in their places, the positions low to high of the phrase are to be looked at."""
    met = spread_join(listed, anchored, ["term"]).withColumn("off", F.col("pos") - F.col("apos")).drop("pos", "term")
    near, far = F.least("apos", "bpos"), F.greatest("apos", "bpos")
    low, high = F.greatest(far - F.col("size") + 1, F.lit(0)).alias("low"), F.least(near + F.col("size") - 1, F.col("last")).alias("high")
    places = met.where("second IS NOT NULL").withColumn("pos", F.col("off") + F.col("bpos")).withColumnRenamed("second", "term")
    both = places.join(listed, ["row_id", "pos", "term"]).select("row_id", "phrase_id", "off", low, high)
    alone = met.where("second IS NULL").select("row_id", "phrase_id", "off", low, high)
    return stored(both.unionByName(alone).distinct(), "alignments")


def phrase_matches(index: DataFrame, items: DataFrame) -> DataFrame:
    """(row_id, item_id, start, end): words start to end (inclusive) of the row are a run of words of the item that is at
    least a window long. All covered words of a row are the union of its ranges."""
    made = phrases(items)
    terms = stored(made.select("term").distinct(), "terms")
    counts = stored(term_counts(index, terms), "counts")
    anchored = stored(anchors(made, counts), "anchors")
    wanted = anchored.select("term").union(anchored.where("second IS NOT NULL").select("second")).distinct()
    aligned = alignments(postings(index, stored(wanted, "anchor-terms")), anchored)
    others = postings(index, terms, stored(aligned.select("row_id").distinct(), "aligned-rows"))
    places = aligned.select("row_id", "phrase_id", "off", F.explode(F.sequence("low", "high")).alias("ipos")).distinct()
    expected = spread_join(places, made.select("phrase_id", "ipos", "term", "size"), ["phrase_id", "ipos"])
    expected = expected.withColumn("pos", F.col("off") + F.col("ipos"))
    hits = expected.join(others, ["row_id", "pos", "term"])
    run = F.col("ipos") - F.row_number().over(Window.partitionBy("row_id", "phrase_id", "off").orderBy("ipos"))
    runs = hits.withColumn("run", run).groupBy("row_id", "phrase_id", "off", "size", "run").agg(F.min("pos").alias("start"), F.max("pos").alias("end"))
    found = runs.where(F.col("end") - F.col("start") + 1 >= F.col("size")).select("row_id", "phrase_id", "start", "end")
    names = stored(made.select("phrase_id", "item_id").distinct(), "phrase-items")
    return spread_join(found, names, ["phrase_id"]).select("row_id", "item_id", "start", "end").distinct()


def proximity_matches(index: DataFrame, queries: DataFrame, span: int) -> DataFrame:
    """queries (query_id, terms array<string>) -> (row_id, query_id, start): the first word of each run of at most span
    words that starts with a term of the query and holds all its terms, in any order. Terms count once."""
    asked = stored(queries.select("query_id", F.array_distinct("terms").alias("asked")).where(F.size("asked") > 0), "queries")
    wanted = stored(asked.select("query_id", F.size("asked").alias("n_terms"), F.explode("asked").alias("term")), "query-terms")
    terms = stored(wanted.select("term").distinct(), "terms")
    counts = term_counts(index, terms)
    rarest = wanted.join(counts, "term").groupBy("query_id").agg(F.min(F.struct("n", "term")).alias("r"))
    rarest = stored(rarest.select("query_id", F.col("r.term").alias("term")), "rarest")
    listed = postings(index, stored(rarest.select("term").distinct(), "rarest-terms"))
    met = stored(spread_join(listed, rarest, ["term"]).select("query_id", "row_id", F.col("pos").alias("apos")), "met")
    others = postings(index, terms, stored(met.select("row_id").distinct(), "met-rows"))
    # only postings less than span from an anchor can meet it: those of its own stretch of span words and the two beside it
    stretch = F.floor(F.col("apos") / span)
    asking = spread_join(met.select("*", F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("stretch")), wanted, ["query_id"])
    near = asking.join(others.withColumn("stretch", F.floor(F.col("pos") / span)), ["row_id", "term", "stretch"])
    near = near.where(F.abs(F.col("pos") - F.col("apos")) < span)
    held = near.groupBy("row_id", "query_id", "apos", "n_terms").agg(F.collect_list(F.struct("pos", "term")).alias("held"))

    def whole(p: Column) -> Column:
        inside = F.filter("held", lambda q: (q["pos"] >= p["pos"]) & (q["pos"] < p["pos"] + span))
        return F.size(F.array_distinct(F.transform(inside, lambda q: q["term"]))) == F.col("n_terms")

    starts = F.filter("held", lambda p: (p["pos"] <= F.col("apos")) & whole(p))
    return held.select("row_id", "query_id", F.explode(F.transform(starts, lambda p: p["pos"])).alias("start")).distinct()


def contamination(index: DataFrame, items: DataFrame) -> DataFrame:
    """(row_id, doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated), a row per row of the index.

    NULL and empty texts have no words and no hits. Items without words match nothing; an item_id that is NULL counts its
    hits but is not listed. Repeated rows each get a row; rows of equal doc_id with different texts are judged apart.
    """
    ranges = phrase_matches(index, items)
    hits = ranges.groupBy("row_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence("start", "end"))))).cast("long").alias("n_hit"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )
    out = index.select("row_id", "doc_id", "text_key", "n_words").join(hits, "row_id", "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("row_id", "doc_id", "text_key", "n_words", hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contamination() of documents by benchmark. NULL and empty texts have no words; repeated rows and rows of equal doc_id
    each get a row by their own text; an empty table gives none; other columns are not read."""
    index = forward_index(table(spark, sf_dir, "documents", "doc_id", "text"))
    return contamination(index, table(spark, sf_dir, "benchmark", "item_id", "text")).drop("row_id", "text_key")


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP10_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bs AS (SELECT item_id, w, least({WINDOW}, len(w)) AS l, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS s FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, l, array_to_string(w[s:s + l - 1], ' ') AS k FROM bs),
ds AS (SELECT rid, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l),
dw AS (SELECT rid, l, s, array_to_string(w[s:s + l - 1], ' ') AS k FROM ds),
h AS (SELECT dw.rid, bw.item_id, dw.s, dw.l FROM dw JOIN bw ON dw.l = bw.l AND dw.k = bw.k),
p AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(s, s + l)) AS pos FROM h) GROUP BY rid),
i AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(i.listed, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON d.rid = p.rid LEFT JOIN i ON d.rid = i.rid
"""

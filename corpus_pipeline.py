"""A corpus run over documents: five stages, each written as Parquet and reread as the next one's input.

Every stage but the last returns the columns of documents (doc_id, text, lang, source, n_chars). A row is followed by its
doc_id and text, so rows that share a doc_id are judged apart if their texts differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.llm import decontaminate, langid, pieces, secrets, wide
from loglens.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose best language has a lower mean probability is rejected.
MIN_SCORE = 0.3


def _same(docs: DataFrame, other: DataFrame):
    return docs["doc_id"].eqNullSafe(other["doc_id"]) & (docs["text_key"] == other["text_key"])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, F.xxhash64("text").alias("text_key"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter or without a language of any confidence; lang becomes the predicted one."""
    found = langid.predict(docs, langid.fit(docs), tuple(COLUMNS))
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_SCORE)).select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five words, similarity 0.8 or more): the one with the smallest
    doc_id, by content where doc_ids repeat; NULL doc_ids come last. Of repeated rows one stays. NULL, empty and wordless
    texts are one group."""
    found = wide.near_copies(docs)
    rows = found.groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("n"))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "n")).alias("x")).select("x.doc_id", "x.text_key", "x.n")
    keyed = _keyed(docs)
    kept = stored(first, "kept").hint("shuffle_hash")
    joined = keyed.join(kept, _same(keyed, kept)).select(*[keyed[c] for c in [*COLUMNS, "text_key"]], "n")
    repeated = joined.where("n > 1").dropDuplicates(["doc_id", "text_key"])
    return joined.where("n = 1").unionByName(repeated).select(*COLUMNS)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    found = decontaminate.contamination(decontaminate.forward_index(docs), table(spark, sf_dir, "benchmark", "item_id", "text"))
    keyed, bad = _keyed(docs), found.where("contaminated").select("doc_id", "text_key").hint("shuffle_hash")
    return keyed.join(bad, _same(keyed, bad), "left_anti").select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces found secrets by marks; every document stays."""
    found = secrets.scan(docs.select(F.col("doc_id").alias("path"), F.lit(0).alias("version"), "text"), secrets.ledger_dir(spark))
    hits = found.where(F.size("spans") > 0).select(F.col("path").alias("doc_id"), "blob", "spans").dropDuplicates(["doc_id", "blob"]).hint("shuffle_hash")
    rows = docs.select(*COLUMNS, secrets.blob_of(F.col("text")).alias("blob"))
    out = rows.join(hits, rows["doc_id"].eqNullSafe(hits["doc_id"]) & (rows["blob"] == hits["blob"]), "left")
    masked = F.when(F.size("spans") > 0, secrets.redacted(rows["text"], F.col("spans"))).otherwise(rows["text"])
    out = out.select(rows["doc_id"], masked.alias("text"), "lang", "source", F.when(F.size("spans") > 0, F.length(masked).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))
    return out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids, decoded_sha256): every document as SentencePiece ids, and the digest of the text that they
    decode to. NULL and empty texts have no ids; repeated rows and rows of equal doc_id each get a row."""
    model = pieces.load()
    encoded = pieces.encode(docs.select(F.col("doc_id").alias("row_id"), "text"), model)
    done = pieces.digests(encoded, model, keep_ids=True)
    return done.select(F.col("row_id").alias("doc_id"), "n_pieces", "ids", "decoded_sha256")


STAGES = [("language ID", language), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", benchmarks), ("secret scans", mask_secrets), ("SentencePiece encoding", tokens)]

#: A trained network decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents", *COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k + 1}")
    return docs

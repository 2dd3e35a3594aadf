"""Queries over the text tables, one per operator, for the driver's registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from loglens.llm import chat, decontaminate, langid, licenses, negatives, pieces, pii, quality, secrets, shards, simhash, trie, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_langid": langid.op1_langid,
        "op2_simhash": simhash.op2_simhash,
        "op3_pii": pii.op3_pii,
        "op4_warc": warc.op4_warc,
        "op5_quality": quality.op5_quality,
        "op6_sentencepiece": pieces.op6_sentencepiece,
        "op7_licenses": licenses.op7_licenses,
        "op8_secrets": secrets.op8_secrets,
        "op9_chat": chat.op9_chat,
        "op10_decontaminate": decontaminate.op10_decontaminate,
        "op11_trie": trie.op11_trie,
        "op12_shards": shards.op12_shards,
        "op13_negatives": negatives.op13_negatives,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_warc": warc.OP4_SQL,
        "op7_licenses": licenses.OP7_SQL,
        "op8_secrets": secrets.OP8_SQL,
        "op9_chat": chat.OP9_SQL,
        "op10_decontaminate": decontaminate.OP10_SQL,
        "op11_trie": trie.OP11_SQL,
        "op13_negatives": negatives.OP13_SQL,
    }

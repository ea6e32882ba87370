"""The queries of the text operators and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pennant.llm import bpe, conversations, fingerprints, language, licenses, mixing, ngram_join, pii, pivots, quality, search, secrets, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """Where the tokenizer's file is; the file stays there."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


QUERIES = {
    "op1_quality": lambda spark, d: quality.quality_scores(_table(spark, d, "documents"), _table(spark, d, "labels")),
    "op2_mixing": lambda spark, d: mixing.sizes_and_takes(_table(spark, d, "documents")),
    "op3_ngram_join": lambda spark, d: ngram_join.near_duplicates(_table(spark, d, "documents")),
    "op4_bpe": lambda spark, d: bpe.round_trip(_table(spark, d, "documents"), tokenizer_path()),
    "op5_pii": lambda spark, d: pii.span_digests(_table(spark, d, "documents")),
    "op6_fingerprints": lambda spark, d: fingerprints.fingerprint_edits(_table(spark, d, "documents")),
    "op7_pivots": lambda spark, d: pivots.near_vectors(_table(spark, d, "embeddings")),
    "op8_licenses": lambda spark, d: licenses.license_scan(_table(spark, d, "documents")),
    "op9_secrets": lambda spark, d: secrets.secret_digests(_table(spark, d, "documents")),
    "op10_warc": lambda spark, d: warc.round_trip(_table(spark, d, "pages")),
    "op11_search": lambda spark, d: search.ranked(_table(spark, d, "documents"), _table(spark, d, "benchmark")),
    "op12_conversations": lambda spark, d: conversations.damage_audits(_table(spark, d, "conversations")),
    "op13_language": lambda spark, d: language.languages(_table(spark, d, "documents")),
}

ORACLES = {
    "op2_mixing": mixing.SQL,
    "op8_licenses": licenses.SQL,
    "op10_warc": warc.SQL,
    "op11_search": search.SQL,
}

"""The corpus pipeline: quality, near duplicates, personal data, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. Rows with
null or empty texts get the classifier's score of a text without words; a text that is null stays
null until the last stage, which encodes it as empty. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pennant.llm import bpe, mixing, ngram_join, pii, quality
from pennant.llm.common import written
from pennant.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier rejects."""
    return quality.kept_by_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return ngram_join.deduplicated(docs).select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces identifiers by their kinds; n_chars follows the text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes every document as often as the mixture does."""
    return mixing.mixed_rows(docs).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, as little-endian 32-bit integers."""
    out = bpe.encode(docs, tokenizer_path())
    return out.select("doc_id", "lang", "source", "n_chars", bpe.n_tokens().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mix", mix_sources),
    ("tokens", tokenize),
]

#: SQL can't express the classifier, the join, the transducers or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs

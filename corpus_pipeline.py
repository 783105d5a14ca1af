"""From documents to token ids: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents (doc_id, text, lang, source, n_chars).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegrid.llm import language_id, mixing, pieces, secrets, simhash_dedup
from lodegrid.llm.common import checkpoint_folder, read


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets lang to the predicted language; documents without text or without a letter, which it rejects, go."""
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    judged = language_id.predict(docs, model).where(F.col("lang_pred") != language_id.UNKNOWN)
    return judged.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of exact and near copies, the document of the smallest id stays."""
    return simhash_dedup.deduplicated(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces owner-specific secrets in the texts; copied examples and all documents stay."""
    masked = secrets.mask(docs, F.col("source"), F.col("doc_id"))
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    mixed = mixing.mix(docs)
    return mixed.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian unsigned 32-bit integers), same: whether they decode to the text."""
    import public_tokenizers

    coded = pieces.encode_column(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return coded.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", same.alias("same"))


STAGES = [("language_id", identify), ("near_dedup", deduplicate), ("secret_scan", mask_secrets), ("source_mix", mix), ("piece_codec", encode)]

#: No stage but the mix can be told in SQL; tests/llm holds the pipeline against brute-force versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}-{name}")
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The stages of the corpus pipeline, each a function of ``(spark, docs, sf_dir)``.

All but the last take and return the columns of ``documents``. A stage reads whatever tables it learns from in
``sf_dir`` and decides on ``docs`` alone: what was dropped before it is gone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.llm import bpe, decontaminate, pii, quality, simhash
from foldwright.llm.common import read
from foldwright.runtime import written


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects. Null and empty texts are scored as texts without words, equal
    texts alike, rows with a null id like others; an empty table stays empty; further columns stay as they are."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group, the one with the least id, null last, and among rows that share
    it the one whose text has the least hash. Null and empty texts are one group; an empty table stays empty; further
    columns stay as they are."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a benchmark item. Null and empty texts stay; rows that share an id, or have
    none, are told apart by their texts; repeated rows go or stay together; empty tables on either side drop nothing;
    further columns stay as they are."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts ``<KIND>`` in the place of personal data; ``n_chars`` follows the text. Null texts stay null, with a null
    ``n_chars``; every row stays, repeated ones too; of spans that overlap the one that begins first is replaced; an empty
    table stays empty; further columns stay as they are."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document: ``(doc_id, ids, n_tokens, decoded_sha256)``, the digest that of the decoded bytes.
    Null and empty texts have no ids; null ids and repeated rows are kept; an empty table gives none; further columns
    go."""
    import public_tokenizers

    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("byte-level BPE encoding and decoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each result is written and read again before the next stage."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs

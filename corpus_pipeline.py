"""The corpus pipeline: each stage works on what its predecessor kept and hands on all columns of
``documents``; the last one returns the encoded corpus.

Stages: reject documents in no known language, keep one document of each group of near
duplicates, drop documents contaminated by the benchmark, mask secrets, encode.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteglass.llm import bpe, decontaminate, langid, secrets, shingles, simhash
from siteglass.llm.common import saved, table
from siteglass.llm.queries import RANKS


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised. The model learns from the stage's own labelled rows."""
    judged = langid.identify(docs, langid.train(docs))
    return judged.where("not lang_rejected").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates: texts whose SimHash
    fingerprints of 256 bits over five-word shingles are near, linked where the shingles have a similarity of
    0.8 or more. The three words and two bits of ``op9_simhash`` find practically exact copies only."""
    return simhash.without_near_duplicates(docs, groups=shingles.by_fingerprints)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that aren't contaminated by ``benchmark``."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents, secrets masked, n_chars counted anew."""
    clean = secrets.redacted(docs, secrets.scan(docs))
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents but the text, with its ids; ids that don't decode to the text stop the run."""
    tokens = bpe.load_tokens(spark, RANKS)
    texts = docs.select("doc_id", "text", "lang", "source", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    checked = bpe.encode_and_decode(texts, tokens, public_tokenizers.PATTERN).withColumn(
        "ids",
        F.when(F.sha2("decoded", 256) == F.col("digest"), F.col("ids"))
        .otherwise(F.raise_error(F.lit("a text doesn't survive encoding and decoding")).cast("binary")),
    )
    return checked.select("doc_id", "lang", "source", "n_chars", bpe.n_tokens().alias("n_tokens"), "ids")


STAGES = [
    ("language_id", language_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secret_stage),
    ("byte_bpe", encoding_stage),
]

#: Fingerprints, forests and merges aren't SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs

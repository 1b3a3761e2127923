"""Registered queries of this subpackage and the SQL that checks them, where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteglass.llm import ann, bpe, chat, decontaminate, langid, periods, pieces, quality, secrets, simhash, spans, suffixes, whitening
from siteglass.llm.checks import ORACLE_SQL
from siteglass.llm.common import remainder, table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = spans.without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_sentences", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op3_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffixes.without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations are trees without branches: every turn answers the one before it."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    told = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", told), (-7, 1, "assistant", told)], rows.schema)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    nodes = rows.union(probe).withColumn("node_id", F.row_number().over(order)).select(
        F.col("conv_id").alias("tree_id"), "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"),
        "role", "text", F.lit(0.0).alias("score"),
    )
    turns = F.transform(chat.read_back(), lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))
    return chat.conversations(nodes).select(
        F.col("tree_id").alias("conv_id"), "n_turns", F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length(chat.learnt_text()).cast("bigint").alias("loss_chars"), F.sha2(chat.learnt_text(), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "place", F.sha2("finding", 256).alias("finding_sha256"), "probability", "is_secret"
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    return quality.score(docs, quality.train(docs, labels.where(~held_out))).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = bpe.load_tokens(spark, RANKS)
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode(texts, tokens, public_tokenizers.PATTERN).select("doc_id", "ids")
    return bpe.decode(encoded, tokens).select(
        "doc_id", bpe.n_tokens().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    model = langid.train(docs.where(~held_out))
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", langid.probability().alias("score"), "lang_rejected"
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def made_periodic(docs: DataFrame) -> DataFrame:
    """(doc_id, text): where the checksum of the id ends in 0, the words from one on repeat what follows it.

    Texts under a missing id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n = F.size(words)
    a = (g % n).cast("int")
    p = (F.floor((n - a) / (3 + g % 8)) + 1).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    changed = F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").rlike("[^\\x20\\x09-\\x0D]"), changed).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.periodic_runs(made_periodic(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    return found.select("doc_id", "n_words", "runs", "collapsed", best.alias("best")).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = pieces.load_vocabulary(spark, PIECES)
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = pieces.encode(texts, vocabulary).select("doc_id", "ids")
    return pieces.decode(encoded, vocabulary).select(
        "doc_id", pieces.n_tokens().alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_sentence_spans, op2_one_bit_codes, op3_suffix_repeats, op4_chat_format, op5_decontaminate,
        op6_secret_scan, op7_quality, op8_byte_bpe, op9_simhash, op10_language_id,
        op11_whitening, op12_periodic_runs, op13_sentencepiece,
    )
}

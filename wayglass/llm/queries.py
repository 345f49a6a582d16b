"""One registered query for each operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, licenses, line_dedup, personal, quality, ranked_search, setsketch, simhash, token_align, token_shards, toxicity, word_bpe
from . import oracles
from .shared import saved, scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids as shards, then read every document back through the index."""
    documents = _table(spark, sf_dir, "documents")
    folder = scratch(spark, "tokens")
    token_shards.write(spark, documents, folder, public_tokenizers.path("word_bpe_49k.json"))
    found = token_shards.lookup(spark, folder, documents.select("doc_id").distinct())
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line dedup leaves of every document."""
    found = line_dedup.drop_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences found in every document."""
    found = licenses.by_document(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_matches", "licences", F.round("dice", 6).alias("dice"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of held-out rows are not looked at."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").where(~toxicity.held_out())
    found = toxicity.score(documents, toxicity.train(documents, labels))
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op6_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them."""
    found = word_bpe.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what is read back from every formatted conversation, and of one that is full of control strings."""
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = [F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")) for i, role in enumerate(("user", "assistant"))]
    formatted = saved(chat.format_turns(given.unionByName(spark.range(1).select(F.inline(F.array(*hard))))), "chat")
    found = chat.read_turns(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a test item that it contains."""
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document and the verdict on it."""
    found = quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_failed")


def op10_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of the known formats, and all spans."""
    found = personal.find(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.array_remove(F.transform("base", lambda s: s["kind"]), i)) for i in range(len(personal.KINDS))]
    counts = [(F.size("base") - n).cast("long").alias(f"n_{k}") for n, k in zip(counts, personal.KINDS, strict=True)]
    return found.select("doc_id", *counts, F.sha2(personal.listed(F.col("base")), 256).alias("base_sha256"), personal.listed(F.col("spans")).alias("spans"))


def op11_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of every document's tokens by two tokenizers, with the links' numbers in all documents."""
    found = token_align.align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumnRenamed("groups", "groups_sha256")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents that score highest for every benchmark item."""
    return ranked_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the set of shingles and component of every document."""
    found = setsketch.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


QUERIES = {
    "op1_token_shards": op1_token_shards,
    "op2_simhash": op2_simhash,
    "op3_line_dedup": op3_line_dedup,
    "op4_licenses": op4_licenses,
    "op5_toxicity": op5_toxicity,
    "op6_word_bpe": op6_word_bpe,
    "op7_chat": op7_chat,
    "op8_decontaminate": op8_decontaminate,
    "op9_quality": op9_quality,
    "op10_personal": op10_personal,
    "op11_token_align": op11_token_align,
    "op12_ranked_search": op12_ranked_search,
    "op13_setsketch": op13_setsketch,
}
ORACLES: dict[str, str] = oracles.ORACLES

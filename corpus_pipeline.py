"""A corpus pipeline: toxicity, line dedup, near-dedup, decontamination and tokens, one operator after the other."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayglass.llm import decontaminate, line_dedup, simhash, toxicity, word_bpe
from wayglass.llm.shared import drop_saved, saved


def _shielded(docs: DataFrame) -> DataFrame:
    """docs with its columns but doc_id and text renamed, so that none of an operator's own columns takes their place."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in ("doc_id", "text") else f"own {c}") for c in docs.columns])


def _restored(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, from what an operator made of _shielded(docs)."""
    return found.select(*[F.col(f"`{c}`") if c in ("doc_id", "text") else F.col(f"`own {c}`").alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the toxicity machine, learnt from the labelled ones that are not held out, rejects.

    Null and empty texts stay, as do rows without doc_id that are not rejected; repeated rows are each scored. Without
    labels of both kinds every document stays.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out())
    scored = toxicity.score(_shielded(docs), toxicity.train(docs.select("doc_id", "text"), labels))
    return _restored(scored.where("predicted = 0"), docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with texts cut down to lines that no earlier document holds; n_chars follows the text. A null text becomes empty."""
    cut = _restored(line_dedup.drop_repeated_lines(_shielded(docs)), docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies; see simhash.first_of_each for nulls and repeated rows."""
    return simhash.first_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that contain a test item of the benchmark. Null texts contain none; repeated rows fare alike."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with digests of them and of the text that they decode to. A null text is empty: no ids."""
    found = word_bpe.round_trip(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("word_bpe", to_tokens),
]
#: SQL has no string kernels, no XXH64 and no BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read again, and goes when the next one's is there."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop_saved(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

"""Quality rules for documents, and for their hosts: failures by host, shrunk with an empirical beta prior, joined back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import WordTable, join_facts, kept, run_sums, saved, slices, texts_of

MIN_WORDS = 10
#: Most words in a hundred that may lie in repeated windows.
MAX_REPEATED = 20
WINDOW = 5
#: A host fails when its shrunk rate of failed documents is above this.
HOST_RATE = 0.5
# The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
_NO_SYMBOLS = bytes.maketrans(b"", b"")
_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _Words:
    """Code points and symbols of a worker's distinct words, each counted once."""

    def __init__(self) -> None:
        self.table = WordTable(self._fill, [np.int64, np.int64])

    @staticmethod
    def _fill(words: list[bytes]) -> list[np.ndarray]:
        chars = np.array([len(w.decode()) for w in words], np.int64)
        symbols = np.array([len(w) - len(w.translate(_NO_SYMBOLS, SYMBOLS)) for w in words], np.int64)
        return [chars, symbols]


def _words() -> _Words:
    """One for all tasks of a Python worker."""
    return kept("quality", _Words)


def repeated_words(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each document the words that lie in a window of WINDOW words found twice or more in it."""
    lengths = np.diff(ends, prepend=0)
    document = np.repeat(np.arange(len(ends), dtype=np.int64), lengths)
    n = len(codes) - WINDOW + 1
    if n <= 0:
        return np.zeros(len(ends), np.int64)
    whole = np.flatnonzero(document[:n] == document[WINDOW - 1 :])
    if not len(whole):
        return np.zeros(len(ends), np.int64)
    wide = codes.astype(np.uint64)
    hashes = (document[whole].astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    for i in range(WINDOW):
        hashes = (hashes ^ (wide[whole + i] * _MIX[i])) * np.uint64(0xFF51AFD7ED558CCD)
        hashes ^= hashes >> np.uint64(29)
    order = np.argsort(hashes)
    same = hashes[order][1:] == hashes[order][:-1]
    maybe = np.zeros(len(whole), bool)
    maybe[order[1:][same]] = True
    maybe[order[:-1][same]] = True
    starts = whole[maybe]
    if not len(starts):
        return np.zeros(len(ends), np.int64)
    # Equal hashes only suggest equal windows: the words themselves decide.
    rows = np.stack([document[starts], *(codes[starts + i].astype(np.int64) for i in range(WINDOW))], axis=1)
    _, which, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    starts = starts[count[which.ravel()] > 1]
    inside = np.zeros(len(codes) + 1, np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + WINDOW, -1)
    return run_sums((np.cumsum(inside[:-1]) > 0).astype(np.int64), ends)


def statistics(documents: DataFrame) -> DataFrame:
    """documents without text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed in place of any such columns.

    A null text has no words, and so fails; other columns and repeated rows pass through.
    """
    names = [c for c in documents.columns if c not in (*_STATS, "base_failed", "text")]
    schema = T.StructType([f for f in documents.schema if f.name in names])
    for c in _STATS:
        schema = schema.add(c, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _words().table
        for batch in slices(batches):
            texts = texts_of(batch["text"])
            codes, ends = table.lookup([t.split() for t in texts])  # on bytes: ASCII white space only
            chars, symbols = (run_sums(x[codes], ends) for x in table.arrays)
            duplicates = []
            for t in texts:
                lines = [line for line in t.split(b"\n") if line and not line.isspace()]
                duplicates.append(len(lines) - len(set(lines)))
            found = [np.diff(ends, prepend=0), chars, symbols, np.array(duplicates, np.int64), repeated_words(codes, ends)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), *(pa.array(x, pa.int64()) for x in found)], [*names, *_STATS])

    out = documents.select(*[F.col(f"`{c}`") for c in names], "text").mapInArrow(run, schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def host_rates(judged: DataFrame, host: str = "source") -> DataFrame:
    """host, documents, failures and rate of every host; null hosts are left out.

    The rate is the mean of a beta posterior. Its prior has the overall rate m as mean, and its
    strength comes from how hosts differ beyond chance: between = weighted variance of the
    hosts' rates less what sampling alone explains; strength = m (1 - m) / between - 1.
    """
    hosts = judged.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count("*").alias("documents"), F.sum(F.col("base_failed").cast("long")).alias("failures"))
    n, k = F.col("documents"), F.col("failures")
    total = hosts.agg(F.sum("documents").alias("n"), F.sum("failures").alias("k"), F.count("*").alias("h"), F.sum(k * k / n).alias("squares")).first()
    if not total.n:
        return hosts.withColumn("rate", F.lit(0.0))
    mean = total.k / total.n
    between = total.squares / total.n - mean * mean - total.h * mean * (1 - mean) / total.n
    strength = min(max(mean * (1 - mean) / max(between, 1e-9) - 1, 1.0), 1e6)
    return hosts.withColumn("rate", (k + F.lit(mean * strength)) / (n + F.lit(strength)))


def judge(documents: DataFrame, host: str = "source") -> DataFrame:
    """statistics() with host_failed and kept (boolean): the verdicts of the host rules joined back to documents.

    A document is kept if it passes the rules itself and its host does not fail. Documents of a
    null host are judged alone. Rows that repeat count each time. An empty table stays empty.
    """
    judged = saved(statistics(documents.drop("host_failed", "kept")), "quality")
    failing = host_rates(judged, host).where(F.col("rate") > HOST_RATE).select(F.col("host").alias(host), F.lit(True).alias("host_failed"))
    joined = join_facts(judged, failing, host)
    verdict = F.coalesce("host_failed", F.lit(False))
    return joined.withColumn("host_failed", verdict).withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))

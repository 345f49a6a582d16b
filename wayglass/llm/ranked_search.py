"""Ranked lexical search: MaxScore over shards of documents, term by term, with bounds for each shard."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import saved, slices, texts_of

K = 20
#: Text (characters) of the items that are looked up in one go over all documents; more items take more goes.
BLOCK_CHARS = 4_000_000
#: A shard ends with this many documents or postings.
SHARD_DOCUMENTS, SHARD_POSTINGS = 8192, 2_000_000
#: Where terms lie in UTF-8: ASCII letters and digits and all that is not ASCII; A-Z become a-z, the rest parts terms.
_TERM_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if b > 127 or chr(b).isalnum() else 32 for b in range(256))
_NO_ID = (1 << 63) - 1


def terms(text: bytes) -> list[bytes]:
    """All terms of a UTF-8 text, in order."""
    return text.translate(_TERM_BYTES).split()


def weight(documents: int, holding: int) -> int:
    """Weight of a term that so many of all documents hold."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class Words:
    """The terms of some items: codes by term, and for each item its distinct terms and how often it has them."""

    def __init__(self, texts: list[bytes]) -> None:
        self.code: dict[bytes, int] = {}
        self.items: list[tuple[np.ndarray, np.ndarray]] = []
        for text in texts:
            found = [self.code.setdefault(t, len(self.code)) for t in terms(text)]
            self.items.append(np.unique(np.array(found, np.int64), return_counts=True))

    def count(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms of each text, and one posting for each term of the items in it: text, code, occurrences."""
        split = [terms(t) for t in texts]
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        codes = np.fromiter((c for words in split for c in map(self.code.get, words, repeat(-1))), np.int64, int(lengths.sum()))
        held = codes >= 0
        keys, n = np.unique(np.repeat(np.arange(len(texts)), lengths)[held] * max(1, len(self.code)) + codes[held], return_counts=True)
        return lengths, keys // max(1, len(self.code)), keys % max(1, len(self.code)), n


class Shard:
    """Postings of some documents by term, with each term's highest share of a score."""

    def __init__(self, ids: np.ndarray, document: np.ndarray, code: np.ndarray, share: np.ndarray, codes: int) -> None:
        order = np.lexsort((document, code))
        self.ids, self.document, self.share = ids, document[order], share[order]
        self.start = np.searchsorted(code[order], np.arange(codes + 1))
        self.most = np.zeros(codes, np.int64)
        some = np.flatnonzero(np.diff(self.start))
        if len(some):
            self.most[some] = np.maximum.reduceat(self.share, self.start[some])

    def best(self, codes: np.ndarray, weights: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents with a score of least (1 or more) and up, and their scores, by MaxScore.

        Terms in order of their bounds: as long as the bounds up to a term come to less than least, no document
        qualifies by these terms alone. They are non-essential: documents come from the other terms' postings, and
        the non-essential ones are only probed, highest bound first, for documents that can still qualify.
        """
        bounds = weights * self.most[codes]
        order = np.argsort(bounds, kind="stable")
        codes, weights, reach = codes[order], weights[order], np.cumsum(bounds[order])
        essential = int(np.searchsorted(reach, least, "left"))
        score = np.zeros(len(self.ids), np.int64)
        for c, w in zip(codes[essential:].tolist(), weights[essential:].tolist(), strict=True):
            run = slice(self.start[c], self.start[c + 1])
            score[self.document[run]] += w * self.share[run]
        open_ones = np.flatnonzero(score)
        for i in range(essential - 1, -1, -1):
            open_ones = open_ones[score[open_ones] + reach[i] >= least]
            if not len(open_ones):
                break
            run = slice(self.start[codes[i]], self.start[codes[i] + 1])
            held = self.document[run]
            if len(held):
                at = np.minimum(np.searchsorted(held, open_ones), len(held) - 1)
                hit = held[at] == open_ones
                score[open_ones[hit]] += weights[i] * self.share[run][at[hit]]
        found = open_ones[score[open_ones] >= least]
        return found, score[found]


class Search:
    """Best k documents of each item over the shards of one task."""

    def __init__(self, words: Words, weights: np.ndarray, documents: int, total: int, k: int) -> None:
        self.words, self.weights, self.documents, self.total, self.k = words, weights, documents, total, k
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in words.items]
        self._clear()

    def _clear(self) -> None:
        self.ids: list[np.ndarray] = []
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = self.postings = 0

    def add(self, ids: np.ndarray, texts: list[bytes]) -> None:
        lengths, document, code, n = self.words.count(texts)
        long = 75 + 25 * lengths * self.documents // max(1, self.total)
        share = 1_000_000_000 * n // (1000 * n + 12 * long[document])
        self.ids.append(ids)
        self.parts.append((document + self.held, code, share))
        self.held += len(ids)
        self.postings += len(n)
        if self.held >= SHARD_DOCUMENTS or self.postings >= SHARD_POSTINGS:
            self.flush()

    def flush(self) -> None:
        """Look all items up in the shard held, each with the score of its k-th document so far to beat or to equal."""
        if not self.held:
            return
        shard = Shard(np.concatenate(self.ids), *(np.concatenate(x) for x in zip(*self.parts, strict=True)), len(self.words.code))
        for i, (codes, times) in enumerate(self.words.items):
            ids, scores = self.best[i]
            found, new = shard.best(codes, self.weights[codes] * times, max(1, int(scores[-1])) if len(scores) == self.k else 1)
            if len(found):
                ids, scores = np.concatenate((ids, shard.ids[found])), np.concatenate((scores, new))
                first = np.lexsort((ids, -scores))[: self.k]
                self.best[i] = ids[first], scores[first]
        self._clear()


def _counts(documents: DataFrame, words: Words) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and for each code how many documents hold it: sums of one row for each task and code."""
    n = len(words.code)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(n + 2, np.int64)
        for batch in slices(batches):
            lengths, _, code, _ = words.count(texts_of(batch["text"]))
            sums[:n] += np.bincount(code, minlength=n)
            sums[n:] += np.count_nonzero(lengths), lengths.sum()
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["code", "n"])

    sums = np.zeros(n + 2, np.int64)
    for r in documents.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():  # bounded by BLOCK_CHARS
        sums[r.code] = r.n
    return int(sums[n]), int(sums[n + 1]), sums[:n]


def _search(documents: DataFrame, items: list, k: int) -> DataFrame:
    """Best k of each item over each task's documents, for items (place, text) that fit a task."""
    words, places = Words([r.text.encode() for r in items]), np.array([r.place for r in items], np.int64)
    total, length, holding = _counts(documents, words)
    weights = np.array([weight(total, int(h)) for h in holding], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(words, weights, total, length, k)
        for batch in slices(batches):
            search.add(batch["doc_id"].fill_null(_NO_ID).to_numpy(zero_copy_only=False), texts_of(batch["text"]))
        search.flush()
        place = np.repeat(places, [len(ids) for ids, _ in search.best])
        ids, scores = (np.concatenate([b[i] for b in search.best]) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(ids, mask=ids == _NO_ID), pa.array(scores)], ["place", "doc_id", "score"])

    found = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "place long, doc_id long, score long")
    order = Window.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(documents: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank (int, from 1), doc_id and score (long, over 0) of the k documents that score highest for each item.

    documents: doc_id, text; items: item_id, text; other columns are ignored. Equal scores go by ascending doc_id, rows
    without one last. Repeated documents are ranked each for itself; rows of items with one item_id and text are one
    item, and another text under the same item_id has a ranking of its own. Null or empty texts have no terms: such a document is
    found by no item, such an item finds none. A text of any length is counted as a whole. An empty table gives no rows.

    Each task keeps the postings of the items' terms of a shard of its documents, and sends k rows for each item on.
    """
    spark = documents.sparkSession
    given = items.select("item_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).distinct()
    cut = given.withColumn("chars", F.length("text")).agg(F.sum("chars")).first()[0] or 0
    blocks = -(-cut // BLOCK_CHARS)
    dealt = saved(given.withColumn("place", F.monotonically_increasing_id()).withColumn("block", F.pmod(F.xxhash64("text"), F.lit(max(1, blocks)))), "items")
    out = None
    for b in range(blocks):
        held = dealt.where(F.col("block") == b).select("place", "text").collect()  # about BLOCK_CHARS
        if held:
            found = _search(documents, held, k)
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "place long, doc_id long, score long, rank int")
    return out.join(dealt.select("place", "item_id"), "place").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")

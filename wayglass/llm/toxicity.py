"""Toxicity by a support vector machine on a gapped subsequence kernel, with Nystroem landmarks.

A sentence is toxic if one of its words is, so a document is a bag of words (insults spelled
with blanks between their letters are put together first), and its score follows its worst
words: kernels of whole sentences would drown a short insult. The kernel of two words counts
common subsequences of three letters, each weighed down by its gaps, so that inserted or
missing letters cost something but not everything. Training is multi-instance: every toxic
document has a witness word, chosen by odds at first and by the machine afterwards. Letters of any script count as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import WordTable, forget, kept, saved, slices, texts_of

#: Labelled documents to learn from, at most, of each label (drawn by a hash of doc_id).
MAX_TOXIC, MAX_CLEAN = 3000, 6000
#: Words of clean documents to learn from, at most, and landmarks.
MAX_WORDS, LANDMARKS = 12_000, 200
#: Candidate witnesses of a document.
WITNESSES = 5
#: Log odds of a word (lower bound at 95 %) from which on it is a witness without the machine's word.
CLEAR_ODDS = 1.5
#: A gap of one letter within a subsequence counts this much; a subsequence spans SPAN letters at most.
DECAY, SPAN = 0.5, 6
#: Ridge of the machine.
RIDGE = 1e-3
#: Worst words that a document's score follows. The numbers of its words, and of those that score over BAD, count, too.
WORST = 3
BAD = 0.5
FEATURES = WORST + 2
#: Score of a word of under two letters, or of no word.
FLOOR = -2.0
_SENTENCE = re.compile(rb"[.!?\n]+")
_OFFSETS = [(a, b) for a in range(1, SPAN - 1) for b in range(1, SPAN - a)]
#: Words of more letters than these are scored like any other, but not learnt from.
MAX_LETTERS = 64
#: Words that are scored at once: bounds the memory of a Python worker.
AT_ONCE = 2_000
#: Bits of a letter's code point in a subsequence, and the marks of a word's ends (neither is a letter).
_BITS, _START, _END = 21, "\0", "\U0010ffff"


def letters(word: str) -> str:
    """Its letters, lower-cased: what is put between them does not hide a word."""
    return "".join(filter(str.isalpha, word.lower()))


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word number, subsequence (three code points as one number) and weight of every gapped subsequence, norms applied."""
    text = "".join(f"{_START}{w}{_END}" for w in words)
    chars = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    number = np.repeat(np.arange(len(words)), lengths)
    end = np.repeat(np.cumsum(lengths), lengths)
    at = np.arange(len(chars))
    owner, found, weight = [], [], []
    for a, b in _OFFSETS:
        i = at[at + a + b < end]
        owner.append(number[i])
        found.append((chars[i] << (2 * _BITS)) | (chars[i + a] << _BITS) | chars[i + a + b])
        weight.append(np.full(len(i), DECAY ** (a + b - 2)))
    owner, found, weight = np.concatenate(owner), np.concatenate(found), np.concatenate(weight)
    norm = np.sqrt(np.bincount(owner, weight**2, minlength=len(words)))
    return owner, found, weight / norm[owner]


def _places(keys: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Place of each subsequence in sorted keys, or their number where it is not there."""
    if not len(keys):
        return np.zeros(len(found), np.int64)
    at = np.searchsorted(keys, found)
    at[at == len(keys)] = 0
    return np.where(keys[at] == found, at, len(keys))


def kernel(words: list[str], others: list[str]) -> np.ndarray:
    """Kernel values of every word with every other word."""
    owner, found, weight = subsequences(others)
    keys, at = np.unique(found, return_inverse=True)
    dense = np.zeros((len(others), len(keys) + 1), np.float32)  # the last column is what the others don't have
    np.add.at(dense, (owner, at), weight)
    out = np.zeros((len(words), len(others)))
    owner, found, weight = subsequences(words)
    at, order = _places(keys, found), np.argsort(owner, kind="stable")
    ends = np.searchsorted(owner[order], np.arange(len(words)))
    for w, (a, b) in enumerate(pairwise([*ends.tolist(), len(order)])):
        own = order[a:b]
        out[w] = dense[:, at[own]] @ weight[own]
    return out


class Model:
    """Subsequences (sorted) and their weights (what the landmarks' coefficients come to), their bias, and a document's coefficients."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float, document: np.ndarray | None = None) -> None:
        self.keys, self.weights, self.bias = keys, weights, bias
        self.document = np.array([0.0] * FEATURES + [-10.0]) if document is None else document

    def words(self, words: list[str]) -> np.ndarray:
        """Scores of words (letters only)."""
        out = np.full(len(words), FLOOR)
        some = np.array([i for i, w in enumerate(words) if len(w) >= 2], np.int64)
        weights = np.append(self.weights, 0.0)
        for at in range(0, len(some), AT_ONCE):
            part = some[at : at + AT_ONCE]
            owner, found, weight = subsequences([words[i] for i in part.tolist()])
            out[part] = np.bincount(owner, weight * weights[_places(self.keys, found)], minlength=len(part)) + self.bias
        return out


def _spelled(codes: np.ndarray, single: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of three or more words of one letter each."""
    flags = np.concatenate(([False], single[codes], [False]))
    change = np.flatnonzero(flags[1:] != flags[:-1])
    for a, b in zip(change[::2].tolist(), change[1::2].tolist(), strict=True):
        if b - a >= 3:
            yield codes[a:b]


class _Scorer:
    """Worst words of documents; a task's distinct words are scored once."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.table = WordTable(self._fill, [np.float64, bool], self._clear)

    def _clear(self) -> None:
        self.units: list[str] = []

    def _fill(self, words: list[bytes]) -> list[np.ndarray]:
        units = [letters(w.decode()) for w in words]
        self.units += [u if len(u) == 1 else "" for u in units]
        return [self.model.words(units), np.array([len(u) == 1 for u in units], bool)]

    def worst(self, texts: list[bytes]) -> np.ndarray:
        """For each text the scores of its WORST worst words, in order, and the logs of its bad words and of its words."""
        codes, ends = self.table.lookup([t.split() for t in texts])
        scores, single = self.table.arrays
        out = np.full((len(texts), FEATURES), FLOOR)
        for i, (a, b) in enumerate(zip([0, *ends.tolist()], ends.tolist(), strict=False)):
            own = codes[a:b]
            spelled = list({"".join(self.units[c] for c in run) for run in _spelled(own, single)})
            put_together = self.model.words(spelled)
            found = np.concatenate((scores[np.unique(own)], put_together))
            top = np.sort(np.partition(found, len(found) - WORST)[-WORST:] if len(found) > WORST else found)[::-1]
            out[i, : len(top)] = top
            out[i, -2:] = np.log1p([(scores[own] > BAD).sum() + (put_together > BAD).sum(), b - a])
        return out


def _scorer(model: Model) -> _Scorer:
    """One for all tasks of a Python worker with this model."""
    return kept(("toxicity", model), lambda: _Scorer(model))


def worst_words(documents: DataFrame, model: Model, name: str) -> DataFrame:
    """documents with what _Scorer.worst says of each one as a column of that name (array of double)."""
    names = [c for c in documents.columns if c != name]
    schema = T.StructType([f for f in documents.schema if f.name in names]).add(name, T.ArrayType(T.DoubleType()))
    held = documents.sparkSession.sparkContext.broadcast(model)  # of LANDMARKS words, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(held.value)
        for batch in slices(batches):
            found = scorer.worst(texts_of(batch["text"]))
            lists = pa.ListArray.from_arrays(np.arange(0, found.size + 1, FEATURES, dtype=np.int32), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), lists], [*names, name])

    return documents.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)


# --- training ---


def _machine(rows: np.ndarray, sign: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights (the last is the bias) of a support vector machine with squared hinge loss, by Newton steps."""
    x = np.hstack([rows, np.ones((len(rows), 1))])
    ridge = np.full(x.shape[1], RIDGE * weight.sum())
    ridge[-1] *= 1e-3
    w = np.zeros(x.shape[1])
    inside = np.ones(len(x), bool)
    for _ in range(30):
        a = x[inside] * weight[inside, None]
        w = np.linalg.solve(a.T @ x[inside] + np.diag(ridge), a.T @ sign[inside])
        now = sign * (x @ w) < 1
        if (now == inside).all():
            break
        inside = now
    return w


def _logistic(rows: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Coefficients (the last is the shift) of a logistic regression with a small ridge, by damped Newton steps."""
    x = np.hstack([rows, np.ones((len(rows), 1))])
    w, weight = np.zeros(x.shape[1]), weight / weight.sum()
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(w)), x.T @ (weight * (p - label)) + 1e-4 * w)
        w = w - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(documents: DataFrame, labels: DataFrame) -> Model:
    """Learn from labels (doc_id, toxic 0 or 1) of documents (doc_id, text).

    Word counts by label and the choice of witnesses run on Spark over a bounded sample of the
    labelled rows (MAX_TOXIC, MAX_CLEAN); bounded lists of words (MAX_WORDS, WITNESSES for each
    toxic document; of MAX_LETTERS letters at most) come to the driver. Of rows that repeat a labelled doc_id one is learnt from (that with the
    smallest hash of its text), so that the sample is bounded in rows, too. Without documents of both labels, no document is toxic. Texts are read whole.
    """
    marked = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    drawn = [marked.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for t, n in ((1, MAX_TOXIC), (0, MAX_CLEAN))]
    chosen = drawn[0].unionByName(drawn[1])  # MAX_TOXIC + MAX_CLEAN rows at most: small enough to send to all tasks
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))
    sample = saved(rows.withColumn("place", place).where("place = 1").drop("place"), "toxicity-sample")
    never = Model(np.zeros(0, np.int64), np.zeros(0), FLOOR)

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches):
            rows = []
            for doc, mark, text in zip(batch["doc_id"].to_pylist(), batch["toxic"].to_pylist(), texts_of(batch["text"]), strict=True):
                for sentence in set(_SENTENCE.split(text.lower())):
                    number = xxhash.xxh3_64_intdigest(sentence) >> 1
                    rows += [(doc, mark, number, u) for u in {letters(w.decode()) for w in sentence.split()} if 2 <= len(u) <= MAX_LETTERS]
            columns = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.string()), strict=True)], ["doc_id", "toxic", "sentence", "word"])

    size = dict(sample.groupBy("toxic").count().collect())
    if not size.get(1) or not size.get(0):
        return never
    bags = saved(sample.mapInArrow(units, "doc_id long, toxic int, sentence long, word string"), "toxicity-words")
    # Copies of a document say the same sentences, which count once.
    once = bags.groupBy("word", "sentence").agg(F.min("toxic").alias("toxic"))
    counts = saved(once.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")), "toxicity-counts")
    odds = F.log((F.col("t") + 0.5) / (size[1] + 1.0)) - F.log((F.col("c") + 0.5) / (size[0] + 1.0)) - 1.64 * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    order = F.struct(F.col("odds"), F.col("t"), F.col("word"))
    best = bags.where("toxic = 1").select("doc_id", "word").distinct().join(counts.withColumn("odds", odds), "word").groupBy("doc_id").agg(F.slice(F.sort_array(F.collect_list(order), asc=False), 1, WITNESSES).alias("w"))
    witnesses = [[(x.odds, x.t, x.word) for x in r.w] for r in best.orderBy("doc_id").collect()]
    clean = counts.where("c > 0").orderBy(F.when(50 * F.col("c") > size[0], 0).otherwise(1), F.xxhash64("word"), "word").limit(MAX_WORDS)
    negative = sorted(r.word for r in clean.select("word").collect())
    if not negative or not witnesses:
        return never

    # A document without a clear witness (its label may be wrong) has none, unless the machine finds one later.
    clear = min(CLEAR_ODDS, max(w[0][0] for w in witnesses))
    picked = [x[2] for w in witnesses for x in w if x[0] >= clear]
    model = never
    for turn in range(3):
        found: dict[str, int] = {}
        for w in picked:
            found[w] = found.get(w, 0) + 1
        positive = sorted(found, key=lambda w: (-found[w], w))
        half = LANDMARKS // 2
        marks = [*positive[:half], *negative[:: max(1, len(negative) // half)][:half]]
        words = [*positive, *negative]
        sign = np.where(np.arange(len(words)) < len(positive), 1.0, -1.0)
        weight = np.concatenate([np.sqrt([found[w] for w in positive]), np.ones(len(negative))])
        weight[: len(positive)] *= 0.5 * len(negative) / weight[: len(positive)].sum()
        values, vectors = np.linalg.eigh(kernel(marks, marks))
        live = values > 1e-6 * values.max()
        whiten = vectors[:, live] / np.sqrt(values[live])
        w = _machine(kernel(words, marks) @ whiten, sign, weight)
        owner, subsequence, share = subsequences(marks)
        keys, at = np.unique(subsequence, return_inverse=True)
        model = Model(keys, np.bincount(at, share * (whiten @ w[:-1])[owner]), float(w[-1]))
        if turn < 2:
            candidates = [x[2] for own in witnesses for x in own]
            picked = [w for w, f in zip(candidates, model.words(candidates), strict=True) if f > 0]
            if not picked:
                break
    scored = worst_words(sample, model, "worst").select("worst", "toxic").collect()
    toxic = np.array([r.toxic == 1 for r in scored])
    share = dict(marked.groupBy("toxic").count().collect())  # of all labelled rows: the sample has more toxic ones
    weight = np.where(toxic, share[1] / toxic.sum(), share[0] / (~toxic).sum())
    model.document = _logistic(np.array([r.worst for r in scored]), toxic, weight)
    return model


def score(documents: DataFrame, model: Model) -> DataFrame:
    """documents with score (0 to 1) and predicted (1 where score is 0.5 or more) in place of any such columns.

    Null and empty texts score as documents without words: next to 0. Other columns, repeated rows
    and rows without doc_id pass through; an empty table stays empty.
    """
    kept = documents.drop("score", "predicted")
    raw = worst_words(kept, model, "score")
    *rates, shift = (float(c) for c in model.document)
    logit = sum((F.lit(c) * F.col("score")[i] for i, c in enumerate(rates)), F.lit(shift))
    odds = F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), logit)))
    return raw.withColumn("score", 1 / (1 + odds)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning: crc32 of its id as text is divisible by 5."""
    return F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 5 == 0

"""What the operators of this subpackage share: scratch tables and distinct-word tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayglass.sources.scratch import drop_saved, saved, scratch, shared_root  # noqa: F401

#: Documents handled at once inside a task; bounds the memory of a Python worker.
SLICE = 400


#: Rows of a side that is sent to all tasks, at most; beyond that, both sides are dealt out by key and salt.
BROADCAST_ROWS = 20_000
SALT = 32


def join_facts(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """rows with the columns of facts, which has one row a key at most; rows without any keep nulls.

    A key may hold any share of rows: facts are broadcast while they are few (counted first), else
    each is copied SALT times and rows of a key are dealt out over these copies.
    """
    facts = saved(facts, "facts")
    return join_counted(rows, facts, key, facts.count())


def join_counted(rows: DataFrame, facts: DataFrame, key: str, most: int) -> DataFrame:
    """join_facts() of facts that have most rows at most."""
    if most <= BROADCAST_ROWS:
        return rows.join(F.broadcast(facts), key, "left")
    many = facts.withColumn("salt of facts", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    dealt = rows.withColumn("salt of facts", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(SALT)).cast("int"))
    return dealt.join(many, [key, "salt of facts"], "left").drop("salt of facts")


#: Rows of one key from which on it is matched apart.
HOT = 10_000


def join_split(rows: DataFrame, facts: DataFrame, key: str, n: str, how: str = "left") -> DataFrame:
    """rows with the columns of facts, which has one row a key at most and in n how many rows have it (dropped).

    Facts of keys of over HOT rows, which are few, are met as join_facts() does; all other keys are small.
    """
    marked = join_facts(rows, facts.where(F.col(n) > HOT).drop(n).withColumn("is hot", F.lit(True)), key)
    hot = marked.where(F.col("is hot")).drop("is hot")
    rest = marked.where(F.col("is hot").isNull()).select(*rows.columns).join(facts.where(F.col(n) <= HOT).drop(n), key, how)
    return hot.unionByName(rest)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once: inside lambdas it would else be put in as an expression and worked out for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def running(values: Column, combine: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """For each element of an array of numbers (0 and up) the sum of it and all before it, or what combine (F.greatest) makes of them.

    By doubling: after the step of d each element holds what the last 2 d come to, so n of them take log2(n) passes.
    """
    steps = F.array(*[F.lit(1 << i) for i in range(31)])
    shifted = lambda held, d: F.concat(F.array_repeat(F.lit(0).cast("long"), d), F.slice(held, 1, F.size(held) - d))
    return bound(values, lambda v: F.aggregate(F.filter(steps, lambda d: d < F.size(v)), v, lambda held, d: F.zip_with(held, shifted(held, d), combine)))


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of a bounded number of rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class _Codes(dict):
    """Word to code; a new word takes the next code and is noted in fresh."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list = []

    def __missing__(self, word):
        code = self[word] = len(self)
        self.fresh.append(word)
        return code


class Growing:
    """An array that grows at its end."""

    def __init__(self, dtype) -> None:
        self._held, self.size = np.empty(1 << 12, dtype), 0

    def extend(self, more: np.ndarray) -> None:
        need = self.size + len(more)
        if need > len(self._held):
            wider = np.empty(max(need, 2 * len(self._held)), self._held.dtype)
            wider[: self.size] = self._held[: self.size]
            self._held = wider
        self._held[self.size : need] = more
        self.size = need

    @property
    def all(self) -> np.ndarray:
        return self._held[: self.size]


class WordTable:
    """Distinct words of a Python worker, each worked on once: codes by word, and arrays of results by code.

    fill(words) gives one array of results (of the dtypes) for each, a row for each new word; clear()
    is called when the table starts anew, once it holds cap words: that bounds its memory and
    changes no result.
    """

    def __init__(self, fill, dtypes: list, clear=lambda: None, cap: int = 600_000) -> None:
        self.fill, self.dtypes, self.clear, self.cap = fill, dtypes, clear, cap
        self._restart()

    def _restart(self) -> None:
        self._codes, self._results = _Codes(), [Growing(t) for t in self.dtypes]
        self.clear()

    @property
    def arrays(self) -> list[np.ndarray]:
        return [r.all for r in self._results]

    def lookup(self, documents: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all words of the documents, and each document's end in them; arrays then covers these codes."""
        if len(self._codes) > self.cap:
            self._restart()
        get = self._codes.__getitem__
        ends = np.cumsum([len(words) for words in documents], dtype=np.int64)
        codes = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        at = 0
        for words in documents:
            codes[at : at + len(words)] = np.fromiter(map(get, words), np.int32, len(words))
            at += len(words)
        if self._codes.fresh:
            fresh, self._codes.fresh = self._codes.fresh, []
            for result, new in zip(self._results, self.fill(fresh), strict=True):
                result.extend(new)
        return codes, ends


_kept: list = []


def kept(key, make):
    """make(), once for a Python worker as long as it is asked for by this key: its words stay known from task to task.

    A worker keeps one thing at a time, so that operators that follow each other do not add up in memory.
    """
    if not _kept or _kept[0] != key:
        forget()
        _kept[:] = [key, make()]
    return _kept[1]


def forget() -> None:
    """Let go of what an operator before kept in this Python worker: for tasks that keep nothing themselves and would else carry it along."""
    _kept[:] = []


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every run, one run after the other."""
    ends = np.cumsum(lengths, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - (ends - lengths), lengths)


def run_sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of values in each run that ends at ends."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return np.diff(total[np.concatenate(([0], ends))])

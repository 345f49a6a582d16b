"""Names of a dictionary in texts: each name is looked for by its rarest few characters, where the texts lie."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayglass.functions.text import fold

#: Bytes of a name by which it is looked for (all of a shorter one).
GRAM = 6
#: Names and their bytes that are looked for in one go over the texts (some 70 MB in a task); more take more goes.
NAMES, NAME_BYTES = 1_000_000, 24_000_000
#: Bits of the filter that most places of a text end at.
FILTER_BITS = 1 << 22
#: Text that is read at once in a task, in bytes.
READ = 1 << 20
_FOLDED, _COUNT = "text, folded", "bytes of names"


def _filter_spot(gram: np.ndarray) -> np.ndarray:
    return (gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 22)


def _grams(data: np.ndarray, n: int) -> np.ndarray:
    """Each n bytes that follow each other, as one number."""
    count = max(0, len(data) - n + 1)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out = out << np.uint64(8) | data[k : k + count]
    return out


class Names:
    """Folded names as arrays, by the rarest gram of each as the counts of byte pairs in the texts have it."""

    def __init__(self, keys: list[bytes], pairs: np.ndarray) -> None:
        lengths = np.array([len(k) for k in keys], np.int64)
        self.bytes, self.lengths = np.frombuffer(b"".join(keys), np.uint8), lengths
        self.starts = np.cumsum(lengths) - lengths
        rarity = np.log(pairs.astype(np.float64) + 1)
        #: For each length of a gram: the grams in order, the name of each, and where in the name it is.
        self.by_length: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for n in sorted({min(GRAM, int(x)) for x in np.unique(lengths)}):
            own = np.flatnonzero(lengths == n) if n < GRAM else np.flatnonzero(lengths >= n)
            at = np.zeros(len(own), np.int64)
            if n == GRAM:  # by the sum of its pairs' logarithms; the first of several rarest
                for i, name in enumerate(own.tolist()):
                    said = self.bytes[self.starts[name] : self.starts[name] + lengths[name]].astype(np.int64)
                    steps = np.cumsum(np.concatenate(([0.0], rarity[said[:-1] * 256 + said[1:]])))
                    at[i] = int(np.argmin(steps[n - 1 :] - steps[: len(steps) - n + 1]))
            first = self.starts[own] + at
            gram = np.zeros(len(own), np.uint64)
            for k in range(n):
                gram = gram << np.uint64(8) | self.bytes[first + k]
            order = np.argsort(gram, kind="stable")
            spots = np.zeros(FILTER_BITS, bool)
            spots[_filter_spot(gram)] = True
            self.by_length.append((n, gram[order], own[order], at[order], np.packbits(spots)))

    def find(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in data which names are; every place of every name."""
        found_at, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n, gram, name, offset, spots in self.by_length:
            said = _grams(data, n)
            spot = _filter_spot(said)
            near = np.flatnonzero(spots[spot >> np.uint64(3)] & (np.uint8(128) >> (spot & np.uint64(7)).astype(np.uint8)))
            low, high = np.searchsorted(gram, said[near], "left"), np.searchsorted(gram, said[near], "right")
            many = high - low
            place = np.repeat(near, many)
            row = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            who, begin = name[row], place - offset[row]
            able = (begin >= 0) & (begin + self.lengths[who] <= len(data))
            who, begin = who[able], begin[able]
            left = np.arange(len(who))
            for k in range(int(self.lengths[who].max(initial=0))):  # a byte of all at once, of those that still agree
                left = left[(self.lengths[who[left]] <= k) | (data[np.minimum(begin[left] + k, len(data) - 1)] == self.bytes[np.minimum(self.starts[who[left]] + k, len(self.bytes) - 1)])]
            found_at.append(begin[left])
            found.append(who[left])
        return np.concatenate(found_at), np.concatenate(found)


def pair_counts(texts: DataFrame, folded: str) -> np.ndarray:
    """How often each two bytes follow each other in all texts: 65,536 numbers, summed up in tasks before anything moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for said in batch["said"].cast(pa.binary()).to_pylist():
                data = np.frombuffer(said or b"", np.uint8)
                if len(data) > 1:
                    sums += np.bincount(data[:-1].astype(np.int64) << 8 | data[1:], minlength=1 << 16)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["pair", "n"])

    out = np.zeros(1 << 16, np.int64)
    for r in texts.select(F.col(f"`{folded}`").alias("said")).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # 65,536 rows at most
        out[r.pair] = r.n
    return out


def mentions(texts: DataFrame, names: DataFrame, text: str = "text") -> DataFrame:
    """texts with mentioned (in place of any such column): the distinct names (name) that a text contains, folded, in order.

    Dictionaries of any size: NAMES of them at a time go to all tasks, and each task looks them up in its texts; no text moves. A
    null text mentions nothing; a name of which nothing is left when folded is in every text. A text is read whole.
    """
    given = texts.drop("mentioned")
    known = names.select("name").where("name IS NOT NULL").distinct().withColumn("key", fold(F.col("name")))
    size = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("key")), F.lit(0)).alias(_COUNT)).first()
    goes = max(1, -(-size.n // NAMES), -(-size[_COUNT] // NAME_BYTES))
    out = given.withColumn(_FOLDED, fold(F.col(f"`{text}`"))).withColumn("mentioned", F.array().cast("array<string>"))
    pairs = pair_counts(out, _FOLDED) if size.n else np.zeros(1 << 16, np.int64)
    for go in range(goes):
        share = known.where(F.pmod(F.xxhash64("name"), F.lit(goes)) == go) if goes > 1 else known
        out = _looked_up(out, share.toArrow(), pairs)  # a go's names, by the bounds above
    return out.drop(_FOLDED).withColumn("mentioned", F.array_sort("mentioned"))


def _looked_up(texts: DataFrame, names: pa.Table, pairs: np.ndarray) -> DataFrame:
    columns = texts.columns
    schema = T.StructType(list(texts.schema))
    keys = [k.encode() for k in names["key"].to_pylist()]
    said_names = names["name"].combine_chunks()
    sent = texts.sparkSession.sparkContext.broadcast((Names([k for k in keys if k], pairs), said_names.filter(pa.array([bool(k) for k in keys], pa.bool_())), said_names.filter(pa.array([not k for k in keys], pa.bool_())).to_pylist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, called, anywhere = sent.value
        for batch in batches:
            texts_here = batch[_FOLDED].cast(pa.binary()).to_pylist()
            hits: list[set[int]] = [set() for _ in texts_here]
            at = 0
            while at < len(texts_here):
                end, size = at, 0
                while end < len(texts_here) and (end == at or size + len(texts_here[end] or b"") <= READ):
                    size += len(texts_here[end] or b"") + 1
                    end += 1
                parts = [t or b"" for t in texts_here[at:end]]
                data = np.frombuffer(b"\xff".join(parts), np.uint8)  # a byte that is in no text
                starts = np.cumsum([0, *(len(p) + 1 for p in parts)])
                where, who = held.find(data) if len(data) else (np.zeros(0, np.int64),) * 2
                for row, name in zip((np.searchsorted(starts, where, "right") - 1 + at).tolist(), who.tolist(), strict=True):
                    hits[row].add(name)
                at = end
            before = batch["mentioned"].to_pylist()
            told = [b if t is None else [*b, *anywhere, *(called[i].as_py() for i in h)] for b, t, h in zip(before, texts_here, hits, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns[:-1]), pa.array(told, pa.list_(pa.string()))], columns)

    return texts.mapInArrow(run, schema)

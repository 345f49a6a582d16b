"""Benchmark decontamination: MinHash containment search of short test items in long documents, by classes of size.

An item is in a document if at least THRESHOLD of its word shingles are. Of an item with n
shingles, floor((1 - THRESHOLD) n) may be missing, so of its MinHash sketch (the shingles with the
smallest hashes, one more than that) a document that holds the item has at least one. Items are
partitioned by size: each class has one sketch size, that of the largest item it may have, and documents with
too few shingles for a class are not candidates of its items. A document's own sketch has its shingles
whose hashes are as small as those of the items' sketches; items and documents whose sketches meet are candidates, which are then verified by
exact shingle containment, so nothing is missed and nothing wrong remains.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import SALT, WordTable, expand, join_facts, kept, saved, slices, texts_of

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: UTF-8 bytes of all items up to which they are sent to all tasks, and parsed items that a task keeps.
ITEM_BYTES, PARSED = 16 << 20, 4096
#: Bits of the filter of the sketches of a larger benchmark (32 MB). Where it fills up, more shingles are joined, and the result stays the same.
FILTER_BITS = 1 << 28
#: Shares into which the candidates of one text are dealt.
CHUNKS = 64
_DROPPED = regex.compile(r"[^\p{L}\p{N}\p{M}]+")
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def normal(word: bytes) -> str:
    """Letters, marks and numbers of a word, lower-cased; other characters do not count."""
    return _DROPPED.sub("", word.decode()).lower()


class _Words:
    """Hashes and normal forms of a worker's distinct words; 0 where nothing is left of a word."""

    def __init__(self) -> None:
        self.table = WordTable(self._fill, [np.uint64], self._clear)

    def _clear(self) -> None:
        self.forms: list[str] = []

    def _fill(self, words: list[bytes]) -> list[np.ndarray]:
        forms = [normal(w) for w in words]
        self.forms += forms
        return [np.array([(xxhash.xxh3_64_intdigest(f) | 1) if f else 0 for f in forms], np.uint64)]

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes and hashes of all words that count, and each text's end in them."""
        codes, ends = self.table.lookup([t.split() for t in texts])
        hashes = self.table.arrays[0][codes]
        full = hashes != 0
        return codes[full], hashes[full], np.concatenate(([0], np.cumsum(full)))[ends]


def _words() -> _Words:
    """One for all tasks of a Python worker."""
    return kept("decontaminate", _Words)


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words in a row."""
    count = max(0, len(hashes) - n + 1)
    out = np.full(count, n, np.uint64)
    for i in range(n):
        out = (out ^ hashes[i : i + count]) * _FACTORS[i]
        out ^= out >> np.uint64(31)
    return out


def needed(n: int, threshold: float) -> int:
    """Shingles of n that a document must hold."""
    return max(1, int(np.ceil(threshold * n - 1e-9)))


def sketch_size(shingles: int, threshold: float) -> int:
    """Hashes of an item's sketch: one more than the largest item of its class of size (a power of two) may miss."""
    largest = (1 << shingles.bit_length()) - 1
    return largest - needed(largest, threshold) + 1


def sketched(benchmark: DataFrame, threshold: float) -> DataFrame:
    """item_id, text, width (words of a shingle: all of an item's where it has fewer than SHINGLE_WORDS) and sketch (its smallest shingle hashes) of every item with words; saved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for number, text in zip(batch["item_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                item = _Item(number, text.encode())
                if item.width:
                    rows.append((number, text, item.width, item.hashes[: sketch_size(len(item.shingles), threshold)].view(np.int64)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int64())), strict=True)], ["item_id", "text", "width", "sketch"])

    given = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    return saved(given.mapInArrow(run, "item_id long, text string, width int, sketch array<long>"), "items")


class _Item:
    """Shingles of an item, as they are and as sorted hashes."""

    def __init__(self, number: int, text: bytes) -> None:
        self.number = number
        words = [f for w in text.split() if (f := normal(w))]
        n = self.width = min(SHINGLE_WORDS, len(words))
        self.shingles = {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()
        self.hashes = np.unique(shingle_hashes(np.array([xxhash.xxh3_64_intdigest(x) | 1 for x in words], np.uint64), n)) if n else np.zeros(0, np.uint64)


def _held(item: _Item, words: _Words, codes: np.ndarray, own: np.ndarray, start: int, end: int) -> int:
    """Shingles of an item in the text whose words are codes[start:end]; own are the hashes of the shingles that begin at each word."""
    n = item.width
    place = np.flatnonzero(np.isin(own[start : max(start, end - n + 1)], item.hashes)) + start
    return len({" ".join(words.forms[c] for c in codes[p : p + n].tolist()) for p in place.tolist()} & item.shingles)


class Index:
    """Items and their sketches of a benchmark of bounded size, as every task has them."""

    def __init__(self, rows: pa.Table, threshold: float) -> None:
        self.threshold = threshold
        self.numbers, self.texts = rows["item_id"].to_pylist(), [t.encode() for t in rows["text"].to_pylist()]
        sketch = rows["sketch"].combine_chunks()
        lengths = np.diff(sketch.offsets.to_numpy())
        hashes = sketch.flatten().to_numpy().view(np.uint64)
        item, width = np.repeat(np.arange(len(lengths)), lengths), np.repeat(rows["width"].to_numpy(), lengths)
        #: For each width the sketches' hashes in order, and the items of each.
        self.probes = {}
        for n in np.unique(width).tolist():
            own = width == n
            keys, which, counts = np.unique(hashes[own], return_inverse=True, return_counts=True)
            self.probes[n] = (keys, np.concatenate(([0], np.cumsum(counts))), item[own][np.argsort(which, kind="stable")])
        self.parsed: dict[int, _Item] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"parsed": {}}

    def item(self, at: int) -> _Item:
        """Items are parsed when a text may hold them; a bounded number stays."""
        if at not in self.parsed:
            if len(self.parsed) >= PARSED:
                self.parsed.clear()
            self.parsed[at] = _Item(self.numbers[at], self.texts[at])
        return self.parsed[at]

    def search(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """For each text the items that it contains: item_id, shingles of the item, shingles found."""
        words = _words()
        codes, hashes, ends = words.read(texts)
        starts = np.concatenate(([0], ends[:-1]))
        pairs: set[tuple[int, int]] = set()
        cached = {}
        for n, (keys, bounds, lists) in self.probes.items():
            own = cached[n] = shingle_hashes(hashes, n)
            # A text's sketch for this width: shingles up to the greatest hash of any item's sketch.
            small = np.flatnonzero(own <= keys[-1])
            at = np.searchsorted(keys, own[small])
            hit = small[keys[at] == own[small]]
            at = at[keys[at] == own[small]]
            text = np.searchsorted(ends, hit, side="right")
            inside = hit + n <= ends[np.minimum(text, len(ends) - 1)]
            text, key = text[inside], at[inside]
            each = bounds[key + 1] - bounds[key]
            item = lists[expand(bounds[key], each)]
            pairs.update(zip(np.repeat(text, each).tolist(), item.tolist(), strict=True))
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for text, number in sorted(pairs):
            item = self.item(number)
            least = needed(len(item.shingles), self.threshold)
            a, b = int(starts[text]), int(ends[text])
            if b - a - item.width + 1 < least:  # too small for the item's class
                continue
            found = _held(item, words, codes, cached[item.width], a, b)
            if found >= least:
                out[text].append((item.number, len(item.shingles), found))
        return out


_FOUND = "array<struct<item_id:bigint,n_shingles:bigint,n_found:bigint>>"
_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("n_shingles", pa.int64()), ("n_found", pa.int64())]))


def _listed(found: list[list[tuple[int, int, int]]]) -> pa.Array:
    return pa.array([[{"item_id": i, "n_shingles": n, "n_found": f} for i, n, f in own] for own in found], _ARROW)


def contained(documents: DataFrame, benchmark: DataFrame, name: str = "contained", threshold: float = THRESHOLD, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """documents with the test items that each contains, as a column of that name (see _FOUND; empty where none).

    benchmark: item_id, text. Items with a null text or id, or without words, are in no document;
    rows that repeat an item_id with other texts are items of their own. A null text contains nothing.
    Other columns and repeated rows of documents pass through; an empty table stays empty.
    Items of up to item_bytes (counted first) go to all tasks, and documents are read where they lie. Of a larger
    benchmark only a filter of its sketches does: document shingles that pass it are joined with the sketches.
    """
    items = sketched(benchmark, threshold)
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    given = documents.drop(name)
    if not size:
        return given.withColumn(name, F.array().cast(_FOUND))
    return (_by_index if size <= item_bytes else _by_join)(given, items, name, threshold)


def _by_index(documents: DataFrame, items: DataFrame, name: str, threshold: float) -> DataFrame:
    names = documents.columns
    held = documents.sparkSession.sparkContext.broadcast(Index(items.toArrow(), threshold))  # bounded by the caller
    schema = T.StructType(list(documents.schema)).add(name, T.DataType.fromDDL(_FOUND))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), _listed(held.value.search(texts_of(batch["text"])))], [*names, name])

    return documents.mapInArrow(run, schema)


def _by_join(documents: DataFrame, items: DataFrame, name: str, threshold: float) -> DataFrame:
    """Texts (by digest, so copies are looked at once) meet items over sketch hashes; both sides of a frequent hash are dealt out. Candidates are verified text by text, CHUNKS shares of a text's items apart."""
    spark, key = documents.sparkSession, "digest of a text"
    items = saved(items.withColumn("item", F.monotonically_increasing_id()), "items")
    sketch = saved(items.select("item", F.explode("sketch").alias("hash")), "sketches")
    widths = [r.width for r in items.select("width").distinct().collect()]  # 1 to SHINGLE_WORDS
    places = sketch.selectExpr(f"shiftright(hash & {FILTER_BITS - 1}L, 6) AS word", "shiftleft(1L, CAST(hash & 63L AS INT)) AS bit")
    set_bits = places.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.uint64)  # so no more rows than that came
    bits[set_bits["word"].to_numpy()] = set_bits["bits"].to_numpy().view(np.uint64)
    filtering = spark.sparkContext.broadcast(bits)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bits = _words(), filtering.value
        for batch in slices(batches):
            _, hashes, ends = words.read(texts_of(batch["text"]))
            digests = batch[key]
            for n in widths:
                own = shingle_hashes(hashes, n)
                at = own & np.uint64(FILTER_BITS - 1)
                hit = np.flatnonzero((bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1))
                text = np.searchsorted(ends, hit, side="right")
                inside = hit + n <= ends[np.minimum(text, len(ends) - 1)]
                hit, text = hit[inside], text[inside]
                yield pa.RecordBatch.from_arrays([digests.take(pa.array(text)), pa.array(own[hit].view(np.int64))], [key, "hash"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words()
        for batch in slices(batches, 50):
            found = []
            for text, own in zip(texts_of(batch["text"]), batch["items"].to_pylist(), strict=True):
                codes, hashes, ends = words.read([text])
                cached, rows = {}, []
                for given in own:
                    item = _Item(given["item_id"], given["text"].encode())
                    if item.width not in cached:
                        cached[item.width] = shingle_hashes(hashes, item.width)
                    n = _held(item, words, codes, cached[item.width], 0, int(ends[0]))
                    if n >= needed(len(item.shingles), threshold):
                        rows.append((item.number, len(item.shingles), n))
                found.append(rows)
            yield pa.RecordBatch.from_arrays([batch[key], _listed(found)], [key, "found"])

    keyed = documents.withColumn(key, F.sha2(F.coalesce("text", F.lit("")), 256))
    hits = keyed.select(key, "text").mapInArrow(probes, f"`{key}` string, hash long").distinct()
    dealt = hits.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALT)).cast("int"))
    pairs = dealt.join(sketch.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), ["hash", "salt"]).select(key, "item").distinct()
    asked = join_facts(pairs, items.select("item", "item_id", F.col("text").alias("wanted")), "item")
    lists = asked.groupBy(key, F.pmod(F.xxhash64("item"), F.lit(CHUNKS)).alias("chunk")).agg(F.collect_list(F.struct("item_id", F.col("wanted").alias("text"))).alias("items"))
    texts = keyed.select(key, "text").join(lists.select(key).distinct(), key, "left_semi").dropDuplicates([key])
    verified = lists.join(texts, key).select(key, "text", "items").mapInArrow(verify, f"`{key}` string, found {_FOUND}")
    facts = verified.select(key, F.explode("found").alias("f")).groupBy(key).agg(F.array_sort(F.collect_list("f")).alias(name))
    return join_facts(keyed, facts, key).select(*documents.columns, F.coalesce(name, F.array().cast(_FOUND)).alias(name))


def leaks(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_shingles and n_found of every item in every document that contains it; one row a pair."""
    found = contained(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, "contained", threshold)
    return found.where(F.size("contained") > 0).select("doc_id", F.inline("contained")).groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("n_found") / F.col("n_shingles"), "n_shingles", "n_found")).alias("m")).select("doc_id", "item_id", "m.n_shingles", "m.n_found")


def clean(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """documents without those that contain a test item; its columns stay."""
    mark = "test items contained"
    return contained(documents, benchmark, mark, threshold).where(F.size(mark) == 0).drop(mark)

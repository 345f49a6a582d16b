"""Token ids in raw binary shards, with a minimal perfect hash index for keyed access.

Layout of a written folder:

* ``shard-NNNNN.bin``: ids of consecutive documents, little-endian, 2 bytes each where the
  vocabulary has fewer than 65,536 entries and 4 otherwise, nothing in between;
* ``shard-NNNNN.off``: record starts in that shard, in ids, little-endian u64, one more than records;
* ``index-NNNNN.mph``: one part of the index (see Mph): key to shard, record number and record count;
* ``manifest.json``: width, number of index parts, and records and ids of each shard.

Documents lie in ascending order of key (then of text) over all shards.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Growing, WordTable, expand, kept, partitions, run_sums, saved, slices, texts_of

#: Keys in one part of the index, on average: a part is built and read in one task.
KEYS_PER_PART = 1 << 16
#: UTF-8 bytes of text in a shard, on average at most, and of ids that are read back at once (a longer document goes alone).
SHARD_BYTES, READ_BYTES = 256 << 20, 32 << 20
#: Offsets that are read at once.
BOUNDS = 1 << 16
#: Stands for a null key; a document must not have it as its own.
NULL_KEY = -(1 << 63)


# --- files, by any file system that Arrow knows ---


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class _Draft:
    """A file that is written piece by piece under another name, and takes its own only when it is whole: a repeated or speculative task replaces it with the same bytes."""

    def __init__(self, folder: str, name: str) -> None:
        self.fs, at = _fs(folder)
        self.fs.create_dir(at, recursive=True)
        self.path, self.draft = f"{at}/{name}", f"{at}/.{name}.{os.getpid()}.{np.random.default_rng().integers(1 << 62)}"
        self.out = self.fs.open_output_stream(self.draft)

    def __enter__(self) -> _Draft:
        return self

    def __exit__(self, kind, *_) -> None:
        self.out.close()
        if kind is None:
            self.fs.move(self.draft, self.path)
        else:
            self.fs.delete_file(self.draft)


def _write(folder: str, name: str, parts: list[bytes]) -> None:
    with _Draft(folder, name) as file:
        for part in parts:
            file.out.write(part)


def _read(folder: str, name: str) -> bytes:
    fs, at = _fs(folder)
    with fs.open_input_stream(f"{at}/{name}") as source:
        return source.read()


# --- minimal perfect hashing ---


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A bijective 64-bit mix for each seed."""
    x = keys ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class Mph:
    """Minimal perfect hash of distinct 64-bit keys, with a stored fingerprint and a record for each slot.

    Each level is a bit array in which a bit is set where exactly one remaining key falls;
    the rank of a key's first set bit is its slot. Keys outside are told apart by fingerprint.
    """

    RECORD = np.dtype([("print", "<u4"), ("shard", "<u4"), ("ordinal", "<u8"), ("count", "<u8")])

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, slots: np.ndarray) -> None:
        self.sizes, self.bits, self.slots = sizes, bits, slots
        self.ranks = np.concatenate(([0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)))

    @classmethod
    def build(cls, keys: np.ndarray, shard: np.ndarray, ordinal: np.ndarray, count: np.ndarray) -> Mph:
        left, sizes, bits = keys, [], [np.zeros(0, "<u8")]
        while len(left):
            size = -(-2 * len(left) // 64) * 64
            at = (_mix(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[at]]
        out = cls(np.array(sizes, "<u8"), np.concatenate(bits), np.zeros(len(keys), cls.RECORD))
        where = out.slot(keys)
        for name, values in (("print", _mix(keys, 1 << 20) & np.uint64(0xFFFFFFFF)), ("shard", shard), ("ordinal", ordinal), ("count", count)):
            out.slots[name][where] = values
        return out

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; a key that is not in the index gets some slot or -1."""
        out, pending, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            bit = (_mix(keys[pending], level) % size).astype(np.int64) + base
            word, rest = bit >> 6, (bit & 63).astype(np.uint64)
            held = self.bits[word]
            found = (held >> rest) & np.uint64(1) == 1
            below = np.bitwise_count(held & ((np.uint64(1) << rest) - np.uint64(1)))
            out[pending[found]] = (self.ranks[word] + below)[found]
            pending, base = pending[~found], base + int(size)
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Records of the keys; count is 0 where a key is unknown."""
        slot = self.slot(keys)
        out = np.zeros(len(keys), self.RECORD)
        known = slot >= 0
        out[known] = self.slots[slot[known]]
        out["count"][out["print"] != (_mix(keys, 1 << 20) & np.uint64(0xFFFFFFFF))] = 0
        return out

    def parts(self) -> list[bytes]:
        head = np.array([len(self.sizes), len(self.bits), len(self.slots)], "<u8")
        return [x.tobytes() for x in (head, self.sizes, self.bits, self.slots)]

    @classmethod
    def load(cls, raw: bytes) -> Mph:
        levels, words, slots = map(int, np.frombuffer(raw, "<u8", 3))
        sizes = np.frombuffer(raw, "<u8", levels, 24)
        bits = np.frombuffer(raw, "<u8", words, 24 + 8 * levels)
        return cls(sizes, bits, np.frombuffer(raw, cls.RECORD, slots, 24 + 8 * (levels + words)))


# --- encoding ---


#: Letters whose lower case is one letter in any library; marks at a word's end that never join them.
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_MARKS = b",.;:!?#*$%&|"
#: Words that a worker keeps, at most, and stems.
MAX_WORDS, MAX_STEMS = 600_000, 1_000_000


class WordEncoder:
    """Encodes texts with a tokenizer that drops white space, so that words between ASCII white space stand alone."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.stems: dict[bytes, int] = {}
        self.table = WordTable(self._fill, [np.int64, np.int64], self._clear, MAX_WORDS)

    def _clear(self) -> None:
        """Words go, their stems stay while there is room."""
        if not self.stems or len(self.stems) > MAX_STEMS:
            self.stems = {b"": 0}
            self.units, self.unit_starts, self.unit_lengths = Growing(np.uint32), Growing(np.int64), Growing(np.int64)
            self._learn([], np.zeros(1, np.int64))
        self.flat = Growing(np.uint32)

    def _learn(self, ids, lengths: np.ndarray) -> None:
        """Ids of units, one after the other, and the number of each."""
        self.unit_starts.extend(self.units.size + np.cumsum(lengths) - lengths)
        self.unit_lengths.extend(lengths)
        self.units.extend(np.asarray(ids, np.uint32))

    def _encode_units(self, units: list[str]) -> None:
        """Units that are each encoded by itself."""
        found = [x.ids for x in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
        self._learn([i for x in found for i in x], np.array([len(x) for x in found], np.int64))

    def _encode_stems(self, stems: list[str]) -> None:
        """Words of plain letters, many in one text: each has one piece that ends a word, its last."""
        parts = [stems[at : at + 200] for at in range(0, len(stems), 200)]
        found = self.tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False)
        for part, encoded in zip(parts, found, strict=True):
            ids = np.array(encoded.ids, np.uint32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(part):
                self._learn(ids, np.diff(ends, prepend=0))
            else:
                self._encode_units(part)

    def _fill(self, words: list[bytes]) -> list[np.ndarray]:
        """Each word as a stem of plain letters and the marks behind it, as the tokenizer splits it; other words are units as they are.

        Stems are known in lower case; units have a blank behind them, which tells them apart.
        """
        known, plain, odd, pairs = self.stems, [], [], []
        for w in words:
            core = w.rstrip(_MARKS)
            rest, core = w[len(core) :], core.lower()
            if core and (core in known or core.isalpha() or _LETTERS.fullmatch(core.decode())):
                if core not in known:
                    known[core] = -1
                    plain.append(core)
            else:
                core, rest = w + b" ", b""
                if core not in known:
                    known[core] = -1
                    odd.append(w)
            if rest:
                rest += b" "
                if rest not in known:
                    known[rest] = -1
                    odd.append(rest[:-1])
            pairs += (core, rest)
        for some, keys, encode in ((plain, plain, self._encode_stems), (odd, [w + b" " for w in odd], self._encode_units)):
            first = self.unit_starts.size
            encode([w.decode() for w in some])
            known.update(zip(keys, range(first, first + len(some)), strict=True))
        unit = np.fromiter(map(known.__getitem__, pairs), np.int64, len(pairs))
        lengths = self.unit_lengths.all[unit]
        ids = self.units.all[expand(self.unit_starts.all[unit], lengths)]
        each = lengths.reshape(-1, 2).sum(axis=1)
        starts = self.flat.size + np.cumsum(each) - each
        self.flat.extend(ids)
        return [starts, each]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of each."""
        codes, ends = self.table.lookup([t.split() for t in texts])
        starts, lengths = (x[codes] for x in self.table.arrays)
        return self.flat.all[expand(starts, lengths)], run_sums(lengths, ends)


def _encoder(path: str) -> WordEncoder:
    """One for all tasks of a Python worker."""
    return kept(("token_shards", path), lambda: WordEncoder(path))


def _pack(ids: np.ndarray, counts: np.ndarray, end_id: int, width: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids with end_id after each document, as stored, and the new number of each."""
    ends = np.cumsum(counts)
    return np.insert(ids, ends, end_id).astype(width), counts + 1


def vocabulary_width(tokenizer: str) -> str:
    """How an id is stored."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() < 1 << 16 else "<u4"


# --- writing ---


def write(spark: SparkSession, documents: DataFrame, folder: str, tokenizer: str, end_id: int = 2) -> dict:
    """Encode documents (doc_id, text, other columns ignored) into folder; returns the manifest.

    Nulls: a null text is empty (its record is the end id alone); a null doc_id comes first and has
    the reserved key NULL_KEY. Rows with the same doc_id all stay, next to each other, in order of text.
    An empty table gives a manifest without shards. A hot key may span several shards. There are as many shards as the
    session has shuffle partitions, or more, so that one is of SHARD_BYTES of text; it is written as it is encoded, and only its
    offsets (8 bytes a document) wait in memory.
    """
    size = documents.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    count = max(partitions(spark), -(-size // SHARD_BYTES))
    width = vocabulary_width(tokenizer)
    keyed = documents.select(F.coalesce("doc_id", F.lit(NULL_KEY)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    ordered = keyed.repartitionByRange(count, "key", tie).sortWithinPartitions("key", tie, "text")

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number = _encoder(tokenizer), TaskContext.get().partitionId()
        first = next(batches, None)
        if first is None:
            return
        offsets, ordinal, total = [np.zeros(1, "<u8")], 0, 0
        with _Draft(folder, f"shard-{number:05d}.bin") as file:
            for batch in slices(chain([first], batches)):
                stored, counts = _pack(*encoder.encode(texts_of(batch["text"])), end_id, width)
                file.out.write(stored.tobytes())
                offsets.append((total + np.cumsum(counts)).astype("<u8"))
                rows = len(counts)
                yield pa.RecordBatch.from_arrays([batch["key"], pa.array(np.full(rows, number, np.int32)), pa.array(np.arange(ordinal, ordinal + rows)), pa.array(counts)], ["key", "shard", "ordinal", "n_tokens"])
                ordinal, total = ordinal + rows, total + int(counts.sum())
        _write(folder, f"shard-{number:05d}.off", [x.tobytes() for x in offsets])

    records = saved(ordered.mapInArrow(shard, "key long, shard int, ordinal long, n_tokens long"), "records")
    shards = [[r.shard, r.n, r.ids] for r in records.groupBy("shard").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("ids")).orderBy("shard").collect()]
    parts = max(1, -(-sum(s[1] for s in shards) // KEYS_PER_PART))
    first = (
        records.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
        .repartition(parts, "part")
        .groupBy("part", "key")
        .agg(F.min(F.struct("shard", "ordinal")).alias("at"), F.count("*").alias("count"))
        .select("part", "key", "at.shard", "at.ordinal", "count")
    )

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if rows:
            table = pa.Table.from_batches(rows)
            part, key, number, ordinal, count = (table[c].to_numpy() for c in ("part", "key", "shard", "ordinal", "count"))
            for p in np.unique(part):
                own = part == p
                _write(folder, f"index-{p:05d}.mph", Mph.build(key[own].astype(np.int64).view(np.uint64), number[own], ordinal[own], count[own]).parts())
                yield pa.RecordBatch.from_arrays([pa.array([int(own.sum())])], ["keys"])

    keys = first.mapInArrow(index, "keys long").agg(F.sum("keys")).first()[0] or 0
    manifest = {"width": width, "parts": parts, "keys": keys, "shards": shards, "end_id": end_id}
    _write(folder, "manifest.json", [json.dumps(manifest).encode()])
    return manifest


# --- reading ---


def manifest_of(folder: str) -> dict:
    return json.loads(_read(folder, "manifest.json"))


class _Shards:
    """Places in the shards: where each begins among all ids, and how records run on from one to the next."""

    def __init__(self, manifest: dict) -> None:
        shards = manifest["shards"]
        self.numbers = np.array([s[0] for s in shards], np.int64)
        self.records = np.array([s[1] for s in shards], np.int64)
        ids = np.array([s[2] for s in shards], np.int64)
        self.starts = np.cumsum(ids) - ids

    def runs(self, shard: int, ordinal: int, count: int) -> Iterator[tuple[int, int, int]]:
        """(shard, first record, records) of count records from there on."""
        at = int(np.searchsorted(self.numbers, shard))
        while count > 0:
            own = min(count, int(self.records[at]) - ordinal)
            yield int(self.numbers[at]), ordinal, own
            count, ordinal, at = count - own, 0, at + 1


def lookup(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """Documents of the keys (column doc_id, distinct; null finds documents without one).

    Columns doc_id, start (ids of all documents before it), n_tokens, ids (binary, little-endian u32).
    A key costs one slot of one index part and one range of one shard, whatever the size of the store;
    keys of several documents have one row for each. Keys that are unknown have no row, but for one in some four thousand million, as
    a key is told by its slot and 32 bits of fingerprint: where that matters, compare with the documents' own ids. Texts are written whole, whatever their length.
    """
    manifest = manifest_of(folder)
    places, width, parts = _Shards(manifest), np.dtype(manifest["width"]), manifest["parts"]
    asked = keys.select(F.coalesce("doc_id", F.lit(NULL_KEY)).alias("key")).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, index = -1, None
        for batch in batches:
            own, key, out = batch["part"].to_numpy(), batch["key"].to_numpy().astype(np.int64), []
            for p in np.unique(own):
                if p != part:
                    part, index = p, Mph.load(_read(folder, f"index-{p:05d}.mph"))
                wanted = key[own == p]
                for k, found in zip(wanted.tolist(), index.find(wanted.view(np.uint64)).tolist(), strict=True):
                    out += [(k, *run) for run in places.runs(found[1], found[2], found[3])]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [()] * 4, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["key", "shard", "ordinal", "count"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _fs(folder)
        number, ids, offsets = -1, None, None

        def read(out: list) -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "start", "n_tokens", "ids"])

        for batch in slices(batches):
            out, held = [], 0
            for key, shard, ordinal, count in zip(*(batch[c].to_pylist() for c in ("key", "shard", "ordinal", "count")), strict=True):
                if shard != number:
                    number, ids, offsets = shard, fs.open_input_file(f"{at}/shard-{shard:05d}.bin"), fs.open_input_file(f"{at}/shard-{shard:05d}.off")
                    base = int(places.starts[np.searchsorted(places.numbers, shard)])
                for first in range(ordinal, ordinal + count, BOUNDS):
                    some = min(BOUNDS, ordinal + count - first)
                    offsets.seek(8 * first)
                    bounds = np.frombuffer(offsets.read(8 * (some + 1)), "<u8").astype(np.int64)
                    for i in range(some):
                        a, b = int(bounds[i]), int(bounds[i + 1])
                        ids.seek(a * width.itemsize)
                        out.append((None if key == NULL_KEY else key, base + a, b - a, np.frombuffer(ids.read((b - a) * width.itemsize), width).astype("<u4").tobytes()))
                        held += len(out[-1][3])
                        if held > READ_BYTES:
                            yield read(out)
                            out, held = [], 0
            yield read(out)

    if not manifest["shards"]:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary")
    found = asked.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(locate, "key long, shard int, ordinal long, count long")
    return found.repartition(partitions(spark), "shard").sortWithinPartitions("shard", "ordinal").mapInArrow(fetch, "doc_id long, start long, n_tokens long, ids binary")


def get(folder: str, key: int | None) -> list[np.ndarray]:
    """Id arrays of one key's documents, read directly."""
    manifest = manifest_of(folder)
    fs, at = _fs(folder)
    raw = NULL_KEY if key is None else key
    width, out = np.dtype(manifest["width"]), []
    if not manifest["shards"]:
        return out
    spark = SparkSession.active()
    part = spark.range(1).select(F.pmod(F.xxhash64(F.lit(raw).cast("long")), F.lit(manifest["parts"]))).first()[0]
    _, shard, ordinal, count = Mph.load(_read(folder, f"index-{part:05d}.mph")).find(np.array([raw], np.int64).view(np.uint64))[0].tolist()
    for number, first, records in _Shards(manifest).runs(shard, ordinal, count):
        with fs.open_input_file(f"{at}/shard-{number:05d}.off") as offsets, fs.open_input_file(f"{at}/shard-{number:05d}.bin") as ids:
            offsets.seek(8 * first)
            bounds = np.frombuffer(offsets.read(8 * (records + 1)), "<u8").astype(np.int64)
            for a, b in zip(bounds, bounds[1:], strict=False):
                ids.seek(int(a) * width.itemsize)
                out.append(np.frombuffer(ids.read(int(b - a) * width.itemsize), width).astype(np.uint32))
    return out

"""Drop lines that repeat across documents, found by once-seen and twice-seen Bloom filters."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import forget, join_facts, partitions, saved, slices, texts_of

#: Keys shorter than this (in code points) are never dropped.
MIN_CHARS = 10
BITS_PER_LINE = 16
#: Most bits of a filter (2 ** 28: 32 MB). Beyond 16 million lines it fills up: more lines that do not
#: repeat are then suspected and shuffle (24 bytes each), and the result stays the same.
MAX_FILTER_BITS = 1 << 28
#: Bits of a filter that are merged together, in one row.
SEGMENT = 1 << 20
#: Suspected lines of one key from which on it is matched apart.
HOT_LINE = 1000
#: Keys that a task gathers before it sends on their bits.
FLUSH = 400_000
#: Lost lines, and ids of documents that lose some, that are sent to all tasks (about 50 MB either).
SENT_LINES, SENT_IDS = 500_000, 2_000_000
_SPACE = b" \t\n\r\x0b\x0c"
_NO_ID = 1 << 62


def _doc() -> Column:
    """Number of a row's document: its id, or one from 2^62 on, made of its text, where it has none."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(_NO_ID - 1)) + F.lit(_NO_ID))


def line_key(line: bytes) -> bytes | None:
    """ASCII white space stripped at both ends, A-Z lower-cased; None where it is too short to count."""
    key = line.strip(_SPACE).lower()
    if len(key) < MIN_CHARS or (len(key) < 4 * MIN_CHARS and len(key.decode()) < MIN_CHARS):
        return None
    return key


def _hashes(text: bytes) -> np.ndarray:
    """Hashes of a document's distinct keys."""
    keys = {k for line in text.split(b"\n") if (k := line_key(line))}
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def digest(key: bytes) -> bytes:
    """128 bits of a cryptographic hash: keys with the same one are the same."""
    return hashlib.blake2b(key, digest_size=16).digest()


def _bits(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two filter positions for each hash: (n, 2)."""
    return np.stack([hashes & np.uint64(bits - 1), (hashes >> np.uint64(36)) & np.uint64(bits - 1)], axis=1).astype(np.uint32)


def _bitmap(positions: np.ndarray) -> np.ndarray:
    out = np.zeros(SEGMENT, bool)
    out[positions] = True
    return np.packbits(out, bitorder="little")


def twice_seen(documents: DataFrame, bits: int) -> np.ndarray:
    """The twice-seen filter of all documents' line keys: packed bits, without false negatives.

    A task sends the bits that its keys set once, and those they set twice, by segment of the
    filter; merging keeps once |= new and twice |= (once & new) | new twice.
    """

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            # a key's two positions can be one: it must not count twice for that
            both = _bits(np.concatenate(held), bits)
            both = np.concatenate((both[:, 0], both[both[:, 0] != both[:, 1], 1]))
            once, n = np.unique(both, return_counts=True)
            part, start = np.unique(once // SEGMENT, return_index=True)
            pieces = [((o % SEGMENT).astype("<u4"), c > 1) for o, c in zip(np.split(once, start[1:]), np.split(n, start[1:]), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array([o.tobytes() for o, _ in pieces], pa.binary()), pa.array([o[c].tobytes() for o, c in pieces], pa.binary())], ["segment", "once", "twice"])

        for batch in slices(batches):
            held += [h for t in texts_of(batch["text"]) if len(h := _hashes(t))]
            if sum(map(len, held)) >= FLUSH:
                yield flush()
                held = []
        if held:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        once, twice = {}, {}
        for batch in batches:
            for segment, a, b in zip(*(batch[c].to_pylist() for c in ("segment", "once", "twice")), strict=True):
                new = _bitmap(np.frombuffer(a, "<u4"))
                again = _bitmap(np.frombuffer(b, "<u4"))
                if segment in once:
                    again |= once[segment] & new
                    once[segment] |= new
                    twice[segment] |= again
                else:
                    once[segment], twice[segment] = new, again
        for segment, found in twice.items():
            if found.any():
                yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([found.tobytes()], pa.binary())], ["segment", "twice"])

    parts = documents.select("text").mapInArrow(sparse, "segment int, once binary, twice binary")
    merged = parts.repartition(min(partitions(documents.sparkSession), max(1, bits // SEGMENT)), "segment").mapInArrow(merge, "segment int, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in merged.toLocalIterator():  # bits / 8 bytes in all, MAX_FILTER_BITS / 8 at most
        out[row.segment * (SEGMENT // 8) :][: SEGMENT // 8] = np.frombuffer(row.twice, np.uint8)
    return out


def repeats(documents: DataFrame) -> DataFrame:
    """doc (see _doc) and digest of every line key that a document loses."""
    spark = documents.sparkSession
    lines = documents.agg(F.sum(F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(1)))).first()[0] or 1
    bits = min(MAX_FILTER_BITS, max(SEGMENT, 1 << (BITS_PER_LINE * lines - 1).bit_length()))
    seen = spark.sparkContext.broadcast(twice_seen(documents, bits))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        twice = seen.value
        for batch in slices(batches):
            docs, found = [], []
            for doc, text in zip(batch["doc"].to_pylist(), texts_of(batch["text"]), strict=True):
                keys = list({k for line in text.split(b"\n") if (k := line_key(line))})
                if keys:
                    at = _bits(np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys)), bits)
                    hit = ((twice[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)
                    own = [digest(keys[i]) for i in np.flatnonzero(hit)]
                    docs += [doc] * len(own)
                    found += own
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(found, pa.binary())], ["doc", "digest"])

    keyed = documents.select(_doc().alias("doc"), "text")
    rows = saved(keyed.mapInArrow(suspects, "doc long, digest binary"), "suspects")
    firsts = saved(rows.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("n")).where("first != last").drop("last"), "firsts")
    # A very common line would be one task's work in a join by digest: such lines are matched apart.
    marked = join_facts(rows, firsts.where(F.col("n") > HOT_LINE).select("digest", F.col("first").alias("hot")), "digest")
    hot = marked.where("doc != hot").select("doc", "digest")
    rest = marked.where("hot IS NULL").join(firsts.where(F.col("n") <= HOT_LINE), "digest").where("doc != first").select("doc", "digest")
    return hot.unionByName(rest).distinct()


def _with_lost(row: DataFrame, lost: DataFrame, repeated: DataFrame) -> DataFrame:
    """row (row, doc) with the digests of the lines that a document loses. Only documents that lose some move, if any do.

    Up to SENT_LINES lost lines go to all tasks, and nothing moves. Of more, the ids of the documents do (up to SENT_IDS), and only these
    documents are joined with their lines; of more than that, all documents are.
    """
    if repeated.count() <= SENT_LINES:
        return row.join(F.broadcast(lost), "doc", "left")
    ids = saved(repeated.select("doc").distinct(), "losers")
    if ids.count() > SENT_IDS:
        return row.join(lost, "doc", "left")
    own = row.join(F.broadcast(ids), "doc", "left_semi").join(lost, "doc")
    rest = row.join(F.broadcast(ids), "doc", "left_anti").withColumn("digests", F.lit(None).cast("array<binary>"))
    return own.unionByName(rest)


def drop_repeated_lines(documents: DataFrame) -> DataFrame:
    """documents with text cut down, and n_lines (before) and n_dropped (long) in place of any such columns.

    A key (see line_key) found in two documents or more loses its lines in all but the smallest
    doc_id that holds it, where all of them stay. Rows with the same doc_id are one document here;
    rows without doc_id come after all others (ids are below 2^62), and those of one text are one document. A null text is one empty line and becomes
    the empty text. Other columns pass through; an empty table stays empty. A text of any length is read whole, in the task that has it.
    """
    repeated = saved(repeats(documents), "repeats")
    lost = repeated.groupBy("doc").agg(F.collect_list("digest").alias("digests"))
    names = [c for c in documents.columns if c not in ("n_lines", "n_dropped")]
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == "text" else f.dataType, True) for f in documents.schema if f.name in names])
    schema = schema.add("n_lines", "long").add("n_dropped", "long")
    row = documents.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), _doc().alias("doc"))
    joined = _with_lost(row, lost, repeated).select("row.*", F.col("digests").alias(mark := "digests of lost lines"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches):
            kept, before, dropped = [], [], []
            for text, digests in zip(texts_of(batch["text"]), batch[mark].to_pylist(), strict=True):
                lines = text.split(b"\n")
                before.append(len(lines))
                if digests:
                    gone = set(digests)
                    left = [line for line in lines if (k := line_key(line)) is None or digest(k) not in gone]
                    text, lines = b"\n".join(left), left
                dropped.append(before[-1] - len(lines))
                kept.append(text)
            columns = [pa.array(kept, pa.binary()).cast(pa.string()) if c == "text" else batch[c] for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(before, pa.int64()), pa.array(dropped, pa.int64())], [*names, "n_lines", "n_dropped"])

    return joined.mapInArrow(cut, schema)

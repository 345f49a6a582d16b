"""SimHash fingerprints of word shingles, links by bit-sliced comparison, and their components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, drop_saved, forget, join_facts, join_split, partitions, saved, slices, texts_of

SHINGLE_WORDS = 3
RADIUS = 3
SEED = 42
#: Bits of the five blocks of a fingerprint. Two that differ in 3 bits or fewer agree in two blocks at least.
BLOCKS = (13, 13, 13, 13, 12)
#: Fingerprints that share two blocks are compared as one group up to this many; larger groups are told apart by more bits. So many can differ in FREE bits.
PART, FREE = 4096, 12
#: Stands for a null doc_id where rows are matched.
_NO_ID = -(1 << 63)
#: Rows compared in one go, at least; whole parts are kept together.
ROWS = 60_000


def fingerprint(text: bytes) -> int:
    """64-bit SimHash: a bit is 1 where over half of the shingles' XXH64 have it; 0 without words."""
    words = text.lower().split()  # on bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE_WORDS + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE_WORDS)), strict=False)) if len(words) >= SHINGLE_WORDS else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        part = hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def text_hash() -> Column:
    """Tells the texts of rows with one doc_id apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash and fingerprint (long, the 64 bits) of every row; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches):
            found = np.array([fingerprint(t) for t in texts_of(batch["text"])], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], pa.array(found)], ["doc_id", "text_hash", "fingerprint"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, fingerprint long")


# --- links ---


def bit_planes(prints: np.ndarray, spare: int) -> np.ndarray:
    """(64, words + spare): plane b holds bit b of all fingerprints, packed, and then spare words."""
    words = -(-len(prints) // 64)
    bits = np.zeros((words * 64, 8), np.uint8)
    bits[: len(prints)] = prints.view(np.uint8).reshape(-1, 8)
    planes = np.zeros((64, words + spare), np.uint64)
    wide = np.unpackbits(bits, axis=1, bitorder="little")
    planes[:, :words] = np.ascontiguousarray(np.packbits(wide.T, axis=1, bitorder="little")).view(np.uint64)
    return planes


def near_at(planes: np.ndarray, mask: np.ndarray, shift: int, radius: int = RADIUS) -> np.ndarray:
    """Rows r of mask (packed bits) that differ from row r + shift in radius (3) bits at most.

    Two carry-save counters add one plane after the other for 64 rows a word; a word is
    abandoned as soon as all its rows are over the radius.
    """
    assert radius == 3, "two counter bits hold 0 to 3"
    skip, bits = shift >> 6, np.uint64(shift & 63)
    alive = np.flatnonzero(mask)
    open_rows = mask[alive]
    ones, twos = np.zeros(len(alive), np.uint64), np.zeros(len(alive), np.uint64)
    for first in range(0, 64, 8):
        for plane in planes[first : first + 8]:
            other = plane[alive + skip] >> bits
            if bits:
                other |= plane[alive + skip + 1] << (np.uint64(64) - bits)
            differs = plane[alive] ^ other
            carry = ones & differs
            ones ^= differs
            over = twos & carry
            twos ^= carry
            open_rows = open_rows & ~over
        keep = open_rows != 0
        if not keep.any():
            return np.zeros(0, np.int64)
        if not keep.all():
            alive, open_rows, ones, twos = alive[keep], open_rows[keep], ones[keep], twos[keep]
    word, bit = np.nonzero(np.unpackbits(open_rows.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return alive[word] * 64 + bit


def linked(group: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (rows, rows) of all links within groups; group is sorted.

    Row r is compared with r + 1, r + 2, ... as long as a group is that long; a link between
    rows that are joined already adds nothing, so a group of n gives n - 1 links at most.
    """
    rows = np.arange(len(group))
    root = rows.copy()
    found: list[tuple[np.ndarray, np.ndarray]] = []
    _, start, size = np.unique(group, return_index=True, return_counts=True)
    last = np.repeat(start + size, size)
    spare = (int(size.max(initial=1)) >> 6) + 2
    planes, at, shift = bit_planes(prints, spare), rows, 1
    while True:
        pairs = at + shift < last[at]
        if not pairs.any():
            break
        if pairs.sum() * 2 < len(at) and shift % 64 == 0:  # only groups that are still that long
            at = rows[np.repeat(size > shift, size)]
            planes = bit_planes(prints[at], spare)
            pairs = at + shift < last[at]
        mask = np.zeros(planes.shape[1] - spare, np.uint64)
        packed = np.packbits(pairs, bitorder="little")
        mask.view(np.uint8)[: len(packed)] = packed
        near = near_at(planes, mask, shift)
        a, b = at[near], at[near] + shift
        new = root[a] != root[b]
        if new.any():
            kept = []
            for x, y in zip(a[new].tolist(), b[new].tolist(), strict=True):
                rx, ry = x, y
                while root[rx] != rx:
                    rx = root[rx]
                while root[ry] != ry:
                    ry = root[ry]
                if rx != ry:
                    root[max(rx, ry)] = min(rx, ry)
                    kept.append((x, y))
            found.append(tuple(np.array(kept).T))
            while (root[root] != root).any():
                root = root[root]
        shift += 1
    if not found:
        return rows[:0], rows[:0]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _link_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of sorted rows (mask, key, fingerprint, node), a bounded number of whole groups at a time."""

    def run(table: pa.Table) -> pa.RecordBatch:
        keys = np.stack([table[c].to_numpy().astype(np.int64) for c in ("mask", "key")])
        group = np.concatenate(([0], np.cumsum((keys[:, 1:] != keys[:, :-1]).any(axis=0))))
        node = table["node"].to_numpy()
        a, b = linked(group, table["fingerprint"].to_numpy().astype(np.int64).view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(node[a], node[b])), pa.array(np.minimum(node[a], node[b]))], ["u", "v"])

    forget()
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= ROWS:
            table = pa.Table.from_batches(held).combine_chunks()
            last = np.ones(table.num_rows, bool)
            for c in ("mask", "key"):
                values = table[c].to_numpy()
                last &= values == values[-1]
            cut = int(np.argmax(last))
            if cut:
                yield run(table.slice(0, cut))
                held = table.slice(cut).to_batches()
    if held and sum(b.num_rows for b in held):
        yield run(pa.Table.from_batches(held))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def pair_masks() -> list[int]:
    """The bits of each two blocks."""
    edges = np.cumsum((0, *BLOCKS))
    whole = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [_signed(whole[a] | whole[b]) for a, b in combinations(range(5), 2)]


def finer(mask: int) -> list[int]:
    """mask with one of RADIUS + 1 blocks of its free bits: fingerprints within the radius that agree in mask agree in one of these, too."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [_signed((mask & ((1 << 64) - 1)) | sum(1 << int(b) for b in part)) for part in np.array_split(free, RADIUS + 1)]


def grouped(classes: DataFrame) -> DataFrame:
    """mask, key, fingerprint and node of all that is to be compared: any two fingerprints within the radius share a group (mask and key).

    Each fingerprint goes to ten groups by two of its five blocks. Groups of one end there. In a group of over PART
    each goes on to RADIUS + 1 groups by a block of the bits that are left, as often as it takes; so what a large
    group costs grows with its size and not with its square.
    """
    keyed = lambda masks: F.transform(masks, lambda m: F.struct(m.alias("mask"), F.col("fingerprint").bitwiseAND(m).alias("key")))
    rows = classes.select(F.explode(keyed(F.array(*[F.lit(m) for m in pair_masks()]))).alias("group"), "fingerprint", "node")
    out = None
    while True:
        sizes = saved(rows.groupBy("group").agg(F.count("*").alias("n")).where("n > 1"), "groups")
        large = (F.col("n") > PART) & (F.bit_count("group.mask") < 64 - FREE)
        hot = sizes.where(large)
        masks = [r.mask for r in hot.select("group.mask").distinct().collect()]  # 10 x 4 ** level at most
        marked = join_facts(rows, hot.select("group", F.lit(True).alias("large")), "group") if masks else rows
        few = (marked.where(F.col("large").isNull()).drop("large") if masks else rows).join(sizes.where(~large), "group").select("group.mask", "group.key", "fingerprint", "node")
        out = few if out is None else out.unionByName(few)
        if not masks:
            return out
        children = F.create_map(*[x for m in masks for x in (F.lit(m), F.array(*[F.lit(c) for c in finer(m)]))])
        deeper = marked.where("large").withColumn("masks", F.try_element_at(children, F.col("group.mask")))
        rows = saved(deeper.select(F.explode(keyed(F.col("masks"))).alias("group"), "fingerprint", "node"), "finer")


def links(classes: DataFrame) -> DataFrame:
    """Links u > v between nodes of distinct fingerprints (fingerprint, node): enough of them to join all that lie within the radius, but not every pair."""
    group = ["mask", "key"]
    rows = grouped(classes).repartition(partitions(classes.sparkSession), *group).sortWithinPartitions(*group)
    return rows.mapInArrow(_link_groups, "u long, v long").distinct()


# --- components ---


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node) for every node of edges (u, v).

    Alternates large-star and small-star steps, each a grouped minimum and an equi-join, until
    nothing changes; every round is written to the shared folder, so its lineage ends there.
    """
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    held = saved(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
    before = mark(held)
    while before[0]:
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        count = F.count("*").alias("n")
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), count)
        large = _with_least(both, low, before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), count)
        others = _with_least(large, least, before[0]).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = others.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = saved(small, "edges")
        drop_saved(held)
        held, now = after, mark(after)
        if now == before:
            break
        before = now
    return held.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _with_least(edges: DataFrame, least: DataFrame, count: int) -> DataFrame:
    """edges (u, v) with m of u, from u, m and the number n of its edges; the centre of a large star is matched apart."""
    if 2 * count <= BROADCAST_ROWS:
        return edges.join(F.broadcast(least.drop("n")), "u")
    return join_split(edges, least, "u", "n", "inner")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, fingerprint (long) and component_id (smallest doc_id reachable over links) of every row.

    documents: doc_id, text; other columns are ignored. Documents link where their fingerprints
    differ in RADIUS bits at most; equal fingerprints are one class, so copies cost nothing more.
    Null or empty texts have fingerprint zero and link like any other. Rows without doc_id name no
    component: they get that of their fingerprint, or null where no row with a doc_id has it. Rows
    that repeat a doc_id all stay. An empty table gives an empty one.
    """
    prints = saved(fingerprints(documents), "fingerprints")
    classes = saved(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")).where("node IS NOT NULL"), "classes")
    joined = components(links(classes.drop("n")))
    names = classes.join(joined, "node", "left").select("fingerprint", F.coalesce("component", "node").alias("component_id"), "n")
    return join_split(prints, names, "fingerprint", "n").select("doc_id", "text_hash", "fingerprint", "component_id")


def first_of_each(documents: DataFrame) -> DataFrame:
    """One document of each component of near_duplicates(), with all its columns: that of the smallest doc_id.

    Of rows that repeat this doc_id, one with the smallest hash of its text stays, and of those with one text that with the smallest
    hash of all its columns. Rows without doc_id stay only where no row of their fingerprint has one: then one row for each
    fingerprint does. An empty table stays empty.
    """
    found = near_duplicates(documents)
    lone = F.when(F.col("component_id").isNull(), F.col("fingerprint"))
    able = found.where("component_id IS NULL OR doc_id = component_id").groupBy("component_id", lone.alias("lone"))
    id_mark, text_mark = marks = ("key of a first document", "text of a first document")
    first = able.agg(F.min("text_hash").alias(text_mark)).select(F.coalesce("component_id", F.lit(_NO_ID)).alias(id_mark), text_mark).distinct()
    kept = documents.withColumn(id_mark, F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))).withColumn(text_mark, text_hash()).join(first, list(marks), "left_semi")
    if not found.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():
        order = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in documents.columns])))
        place = F.row_number().over(Window.partitionBy(*marks).orderBy(order))
        kept = kept.withColumn("place of a first document", place).where(F.col("place of a first document") == 1).drop("place of a first document")
    return kept.drop(*marks)

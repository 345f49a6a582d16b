"""Near-duplicates by SetSketch registers of word shingles: bands of registers, a joint likelihood, and exact confirmation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import join_facts, join_split, partitions, saved, slices, texts_of
from .simhash import components, text_hash

SHINGLE_WORDS = 4
#: Documents link where SHARED_OF times the intersection is at least SHARED times the union.
SHARED, SHARED_OF = 80, 100
#: Registers of BANDS times ROWS; a link at 0.8 shares no band with a chance of (1 - 0.8 ** ROWS) ** BANDS, about 5e-9.
BANDS, ROWS = 48, 5
#: Bands that are looked at first; of the others only groups whose members are not joined by then.
FIRST_BANDS = 8
#: SetSketch: base and rate of the exponential minima, and the highest register (two bytes).
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
#: Natural log of how much less likely than the best similarity one of 0.8 and up must be for a pair to be dropped.
MARGIN = 20.0
#: Members, and shingles of members, of a part of a group at most; larger groups are dealt out.
PART, PART_SHINGLES = 4096, 2_000_000
#: Ids or keys that are sent to all tasks (24 MB) to pick out their rows; of more, both sides shuffle.
BROADCAST_IDS = 1_000_000

_N = BANDS * ROWS
_draw = np.random.default_rng(20210104)
_TIMES = _draw.integers(0, 1 << 63, _N, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _draw.integers(0, 1 << 63, _N, np.uint64) * np.uint64(2)
_GRID = np.concatenate((np.arange(0, 1, 0.02), [0.8, 1.0]))


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; one of all words where they are too few, none without words."""
    words = text.lower().split()  # on bytes: A-Z only, and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE_WORDS)), strict=False)) if len(words) >= SHINGLE_WORDS else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(0)), np.uint64, max(1, len(words) - SHINGLE_WORDS + 1)))


def registers(held: np.ndarray) -> np.ndarray:
    """SetSketch of a set of hashes: each register is the truncated logarithm of the least of its exponential values.

    Two sketches merge by their larger registers. An empty set has zeros.
    """
    if not len(held):
        return np.zeros(_N, np.uint16)
    least = np.full(_N, np.iinfo(np.uint64).max)
    for at in range(0, len(held), 512):
        values = _TIMES[:, None] * held[None, at : at + 512]
        values += _PLUS[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(exponential, 1e-300)) / np.log(BASE)), 0, TOP).astype(np.uint16)


def may_link(over: np.ndarray, under: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of n and m elements, of whose registers so many are over and under the other's, may link.

    The similarity's likelihood is that of both counts together. A pair is dropped only if no similarity from 0.8 up to
    what the sizes allow is within MARGIN of the most likely one.
    """
    small, large = np.minimum(n, m), np.maximum(n, m)
    able = SHARED_OF * small >= SHARED * large
    u, v = (n / (n + m))[:, None], (m / (n + m))[:, None]
    top = (small / large)[:, None]
    grid = np.minimum(_GRID[None, :], top)
    chance = lambda x: np.maximum(-np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE), 1e-9)
    more, less = chance(u - v * grid), chance(v - u * grid)
    same = np.maximum(1 - more - less, 1e-9)
    likely = over[:, None] * np.log(more) + under[:, None] * np.log(less) + (_N - over - under)[:, None] * np.log(same)
    best = np.where(grid >= SHARED / SHARED_OF - 1e-9, likely, -np.inf).max(axis=1)
    return able & (best >= likely.max(axis=1) - MARGIN)


def sketches(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_key (equal for equal sets) and registers (binary) of every row; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t) for t in texts_of(batch["text"])]
            key = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            columns = [batch["doc_id"], batch["text_hash"], pa.array([len(s) for s in sets], pa.int64()), pa.array(key), pa.array([registers(s).astype("<u2").tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_shingles", "set_key", "registers"])

    given = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), "text")
    return given.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, set_key long, registers binary")


# --- links within groups ---

#: near(x, others): which of the others link with x.
Near = Callable[[int, np.ndarray], np.ndarray]


def near_registers(payloads: list[bytes], sizes: np.ndarray) -> Near:
    """By the likelihood of two sketches."""
    held = np.frombuffer(b"".join(payloads), "<u2").reshape(len(payloads), _N)

    def near(x: int, others: np.ndarray) -> np.ndarray:
        theirs = held[others]
        over, under = (held[x] > theirs).sum(axis=1), (held[x] < theirs).sum(axis=1)
        out = 2 * (over + under) <= _N  # at 0.8 over half of the registers are equal but for a chance of e ** -53
        out[out] = may_link(over[out], under[out], np.broadcast_to(sizes[x], int(out.sum())), sizes[others[out]])
        return out

    return near


def near_texts(payloads: list[bytes], sizes: np.ndarray) -> Near:
    """By the whole sets of shingles of two texts."""
    sets = [shingles(t) for t in payloads]
    lengths = np.array([len(s) for s in sets])
    starts = np.cumsum(lengths) - lengths
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(values), bool)

    def near(x: int, others: np.ndarray) -> np.ndarray:
        own = codes[starts[x] : starts[x] + lengths[x]]
        mark[own] = True
        sums = np.concatenate(([0], np.cumsum(mark[codes], dtype=np.int64)))
        both = (sums[starts + lengths] - sums[starts])[others]
        mark[own] = False
        return (both > 0) & (SHARED_OF * both >= SHARED * (lengths[x] + lengths[others] - both))

    return near


def forest(label: np.ndarray, seeds: np.ndarray, near: Near) -> list[tuple[int, int]]:
    """Links enough to join all members that a link with a seed reaches; members of one label are joined already.

    Every seed is compared with every member that is not joined with it by then, so no link is lost.
    """
    root, found = label.copy(), []
    for x in seeds.tolist():
        others = np.flatnonzero(root != root[x])
        if not len(others):
            if (root == root[0]).all():
                break
            continue
        hit = others[near(x, others)]
        roots, first = np.unique(root[hit], return_index=True)
        if len(roots):
            found += [(x, int(y)) for y in hit[first]]
            root[np.isin(root, roots)] = root[x]
    return found


def _grouped(kind: Callable[[list[bytes], np.ndarray], Near]):
    """Links of rows sorted by group and part (group, part, seed, node, label, size, payload)."""

    def links(rows: pa.Table) -> list[tuple[int, int]]:
        node, sizes = rows["node"].to_numpy(), rows["size"].to_numpy()
        _, label = np.unique(rows["label"].to_numpy(), return_inverse=True)
        seeds = np.flatnonzero(rows["seed"].to_numpy(zero_copy_only=False))
        if len(node) < 2 or not len(seeds) or (label == label[0]).all():
            return []
        found = forest(label, seeds, kind(rows["payload"].to_pylist(), sizes))
        return [(max(a, b), min(a, b)) for a, b in ((int(node[x]), int(node[y])) for x, y in found) if a != b]

    def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            marks = [batch[c].to_numpy() for c in ("group", "part")]
            cuts = np.flatnonzero((marks[0][1:] != marks[0][:-1]) | (marks[1][1:] != marks[1][:-1])) + 1
            found = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                now = (marks[0][a], marks[1][a])
                if held and now != key:
                    found += links(pa.Table.from_batches(held))
                    held = []
                key = now
                held.append(batch.slice(a, b - a))
            yield out(found)
        if held:
            yield out(links(pa.Table.from_batches(held)))

    return run


def group_links(members: DataFrame, payload: DataFrame, kind: Callable[[list[bytes], np.ndarray], Near], most: int | None = None) -> DataFrame:
    """Links u > v that join all members of a group (group, node, label, size) that are linked, by payloads (node, payload).

    A group of over PART members (or most shingles, the sum of size) is dealt out in parts that each hold its first member, too, so that
    a close group is joined over all parts. Members that are not joined with the first one by then are compared with all
    parts, in blocks. What a group costs so grows with its size, and with its square only in those that are left.
    """
    count = lambda n, w: F.ceil(F.greatest(n / F.lit(PART), w / F.lit(most) if most else F.lit(0.0))).cast("int")
    spans = members.groupBy("group").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    held = _among(members, saved(spans.where("low < high").select("group"), "groups"), "group")
    held = saved(held, "members")
    sums = held.groupBy("group").agg(F.count("*").alias("n"), F.sum("size").alias("w"), F.min("node").alias("head"))
    sizes = saved(sums.select("group", "n", count(F.col("n"), F.col("w")).alias("parts"), "head"), "groups")
    sized = saved(join_split(held, sizes.withColumn("all", F.col("n")), "group", "all", "inner"), "members")
    payload = _among(payload, saved(sized.select("node").distinct(), "nodes"), "node")
    own = F.array(F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    dealt = sized.withColumn("part", F.explode(F.when(F.col("node") == F.col("head"), every).otherwise(own))).withColumn("seed", F.lit(True))
    links = saved(_linked(dealt, payload, kind), "links")
    if sizes.where("parts > 1").isEmpty():
        return links
    hot = sized.where("parts > 1")
    joined = components(links.unionByName(hot.select(F.greatest("node", "label").alias("u"), F.least("node", "label").alias("v")).where("u != v").distinct())).withColumnRenamed("component", "now")
    heads = sizes.where("parts > 1").join(joined.select(F.col("node").alias("head"), F.col("now").alias("of_head")), "head", "left").select("group", F.coalesce("of_head", "head").alias("of_head"))
    named = join_facts(hot.join(joined, "node", "left").withColumn("label", F.coalesce("now", "node")).drop("now"), heads, "group")
    named = saved(named.withColumn("left", F.col("label") != F.col("of_head")).drop("of_head"), "named")
    left = named.where("left").groupBy("group").agg(count(F.count("*"), F.sum("size")).alias("blocks"))
    open_ones = join_facts(named, left, "group").where("blocks IS NOT NULL").withColumn("own", own[0]).withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks").cast("long")).cast("int"))
    number = lambda part, block: (part.cast("long") * F.col("blocks") + block).alias("part")
    keep = ["group", "node", "label", "size"]
    all_blocks, all_parts = F.sequence(F.lit(0), F.col("blocks") - 1), every
    asked = open_ones.select(*keep, "own", "blocks", F.explode(all_blocks).alias("b")).select(*keep, number(F.col("own"), F.col("b")), F.lit(False).alias("seed"))
    asking = open_ones.where("left").select(*keep, "block", "blocks", F.explode(all_parts).alias("p")).select(*keep, number(F.col("p"), F.col("block")), F.lit(True).alias("seed"))
    return links.unionByName(_linked(asked.unionByName(asking), payload, kind))


def _linked(dealt: DataFrame, payload: DataFrame, kind) -> DataFrame:
    rows = dealt.select("group", F.col("part").cast("long").alias("part"), "seed", "node", "label", "size").join(payload, "node")
    rows = rows.select("group", "part", "seed", "node", "label", "size", "payload").repartition(partitions(dealt.sparkSession), "group", "part").sortWithinPartitions("group", "part")
    return rows.mapInArrow(_grouped(kind), "u long, v long").distinct()


def _among(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows whose key is one of keys, which go to all tasks if they are BROADCAST_IDS at most."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys, key, "left_semi")


def _texts(documents: DataFrame, nodes: DataFrame, repeated: bool) -> DataFrame:
    """node and payload (the text) of the documents of nodes."""
    given = documents.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("binary").alias("payload")).where("payload IS NOT NULL")
    held = _among(given, nodes, "node")
    return held.dropDuplicates(["node", "payload"]) if repeated else held


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles (size of the set) and component_id (smallest doc_id reachable over links) of every row.

    documents: doc_id, text; other columns are ignored. Documents link where their sets of shingles are similar by 0.8 or more,
    which is confirmed on the whole sets; equal sets are one class. A null or empty text, or one without words, has
    no shingles and links with nothing. Rows that repeat a doc_id are one document with the links of all its rows. Rows without
    doc_id name no component: they get that of an equal set, or null. An empty table gives an empty one. A text of any
    length is taken whole; the task that holds it holds its shingles, at eight bytes each.
    """
    found = saved(sketches(documents), "sketches")
    able = found.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = saved(able.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.count("*").alias("n"), F.max("n_shingles").alias("size"), F.min("registers").alias("payload")), "classes")
    width = 2 * ROWS
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(i, F.substring("payload", i * width + 1, width)).alias("group")))
    rows = lambda of, some: of.select("node", "label", "size", F.inline(bands)).where(some).select("group", "node", "label", "size")
    sketch = classes.select("node", "payload")
    first = group_links(rows(classes.withColumn("label", F.col("node")), F.col("band") < FIRST_BANDS), sketch, near_registers)
    links = saved(first, "links")
    joined = saved(components(links), "components")
    labelled = classes.join(joined, "node", "left").withColumn("label", F.coalesce("component", "node"))
    more = saved(group_links(rows(labelled, F.col("band") >= FIRST_BANDS), sketch, near_registers), "links")
    if not more.isEmpty():
        joined = saved(components(links.unionByName(more)), "components")
    repeated = not found.groupBy("doc_id").count().where("count > 1").isEmpty()
    joined = saved(joined.unionByName(joined.select(F.col("component").alias("node"), "component").distinct()), "components")
    members = joined.join(classes.select("node", "size"), "node").select(F.col("component").alias("group"), "node", F.col("node").alias("label"), "size")
    texts = _texts(documents, joined.select("node"), repeated)
    sure = components(group_links(members, texts, near_texts, PART_SHINGLES))
    names = classes.join(sure, "node", "left").select("set_key", F.coalesce("component", "node").alias("component_id"), "n")
    out = join_split(found.drop("registers"), names, "set_key", "n")
    return out.select("doc_id", "text_hash", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))

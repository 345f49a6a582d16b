"""Periodic count snapshots: increases since the one before, and thinning to a minimum spacing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayglass.sources.scratch import saved

from .keyed import first_per_key

MAX_GAP = 3_600_000
MIN_SPACING = 240_000
#: Spacings in a leaf of thinned(), which is what one task reads at once, and parts of a node.
LEAF, FAN = 128, 128


def increases(counts: DataFrame, group: str = "world", name: str = "boss", max_gap: int = MAX_GAP) -> DataFrame:
    """counts (group, at, name, day, week) with increase and since.

    Compared is the group's snapshot before, not the name's: a name that is missing from it has no
    increase, nor has one after a gap over max_gap. Only distinct times pass through the window.
    """
    times = counts.select(group, "at").distinct().withColumn("before", F.lag("at").over(Window.partitionBy(group).orderBy("at")))
    near = times.where(F.col("before").isNotNull() & (F.col("at") - F.col("before") <= max_gap))
    old = counts.select(group, name, F.col("at").alias("before"), F.col("day").alias("old_day"), F.col("week").alias("old_week"))
    joined = counts.join(near, [group, "at"], "left").join(old, [group, name, "before"], "left")
    grown = F.coalesce((F.col("day") > F.col("old_day")) | (F.col("week") > F.col("old_week")), F.lit(False))
    return joined.select(*counts.columns, grown.alias("increase"), F.when(grown, F.col("before")).alias("since"))


def thinned(times: DataFrame, group: str = "world", spacing: int = MIN_SPACING) -> DataFrame:
    """Distinct group and at (ms) such that each is spacing or more after the one kept before it, from the first on.

    What is kept depends on what was kept before, so a group is a chain. Time is cut into leaves of LEAF x spacing, and FAN
    leaves into a node, FAN of these into the next. For each piece a table says, for every time that may be the first one kept there,
    which is then the last: only times of its first spacing, and the first one after, may be. Going up, a node's
    table comes from those of its parts; going down, a node's first kept time gives those of its parts; leaves then walk. A task holds
    the times of one leaf, or the tables of FAN parts, however many rows a group has. Null times go.
    """
    held = saved(times.select(F.col(f"`{group}`").alias("g"), F.col("at").cast("long").alias("at")).where("at IS NOT NULL").distinct(), "times")
    low, high = held.agg(F.min("at"), F.max("at")).first()
    if low is None:
        return held.select(F.col("g").alias(group), "at")
    kind = held.schema["g"].dataType.simpleString()
    within = lambda at, width: F.expr(f"({at} - {low}L) DIV {width}L")

    def first_ones(at: np.ndarray, start: int) -> np.ndarray:
        """Of sorted times those that may be the first kept one of what begins at start."""
        return at[: np.searchsorted(at, start + spacing) + 1]

    def leaf_table(table: pa.Table) -> pa.Table:
        at = np.sort(table["at"].to_numpy())
        entry = first_ones(at, low + table["node"][0].as_py() * spacing * LEAF)
        last = entry.copy()
        live = np.arange(len(entry))
        while len(live):
            following = np.searchsorted(at, last[live] + spacing)
            live, following = live[following < len(at)], following[following < len(at)]
            last[live] = at[following]
        return _rows(table, "node", entry, {"entry": entry, "last": last})

    def parts_of(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Number, entries and last ones of a node's parts, in order."""
        node, entry, last = (table[c].to_numpy() for c in ("node", "entry", "last"))
        order = np.lexsort((entry, node))
        node, entry, last = node[order], entry[order], last[order]
        cuts = np.flatnonzero(np.diff(node)) + 1
        for n, e, x in zip(np.split(node, cuts), np.split(entry, cuts), np.split(last, cuts), strict=True):
            yield int(n[0]), e, x

    def node_table(width: int) -> Callable[[pa.Table], pa.Table]:
        def run(table: pa.Table) -> pa.Table:
            parts = list(parts_of(table))
            entry = first_ones(np.unique(table["entry"].to_numpy()), low + table["parent"][0].as_py() * width)
            last = entry - spacing
            for _, e, x in parts:
                following = np.searchsorted(e, last + spacing)
                met = following < len(e)
                last[met] = x[following[met]]
            return _rows(table, "parent", entry, {"entry": entry, "last": last}, "node")

        return run

    def begin_parts(table: pa.Table) -> pa.Table:
        last, begun = table["begin"][0].as_py() - spacing, []
        for n, e, x in parts_of(table):
            at = int(np.searchsorted(e, last + spacing))
            if at < len(e):
                begun.append((n, int(e[at])))
                last = int(x[at])
        nodes, entries = (np.array(c, np.int64) for c in zip(*begun, strict=True))
        return _rows(table, "node", entries, {"begin": entries}, nodes=nodes)

    def walk(table: pa.Table) -> pa.Table:
        at = np.sort(table["at"].to_numpy())
        i, kept = int(np.searchsorted(at, table["begin"][0].as_py())), []
        while i < len(at):
            kept.append(int(at[i]))
            i = int(np.searchsorted(at, kept[-1] + spacing))
        return pa.table({"g": pa.array([table["g"][0].as_py()] * len(kept), table.schema.field("g").type), "at": pa.array(kept, pa.int64())})

    ends = f"g {kind}, node long, entry long, last long"
    leaves = held.withColumn("node", within("at", spacing * LEAF))
    levels, width = [saved(leaves.groupBy("g", "node").applyInArrow(leaf_table, ends), "leaves")], spacing * LEAF
    while (high - low) // width > 0:
        width *= FAN
        levels.append(saved(levels[-1].withColumn("parent", F.expr(f"node DIV {FAN}L")).groupBy("g", "parent").applyInArrow(node_table(width), ends), "nodes"))
    begun = levels.pop().groupBy("g", "node").agg(F.min("entry").alias("begin"))
    same = lambda a, b: a["g"].eqNullSafe(b["of"]) & (a["parent"] == b["above"])
    while levels:
        parts = levels.pop().withColumn("parent", F.expr(f"node DIV {FAN}L"))
        above = begun.select(F.col("g").alias("of"), F.col("node").alias("above"), "begin")
        joined = parts.join(above, same(parts, above)).drop("of", "above")
        begun = joined.groupBy("g", "parent").applyInArrow(begin_parts, f"g {kind}, node long, begin long")
    entered = begun.select(F.col("g").alias("of"), F.col("node").alias("above"), "begin")
    last = leaves.join(entered, leaves["g"].eqNullSafe(entered["of"]) & (leaves["node"] == entered["above"])).drop("of", "above")
    return last.groupBy("g", "node").applyInArrow(walk, f"g {kind}, at long").withColumnRenamed("g", group)


def _rows(table: pa.Table, node: str, like: np.ndarray, columns: dict[str, np.ndarray], name: str | None = None, nodes: np.ndarray | None = None) -> pa.Table:
    """Rows of one group: its g, its node (or nodes) and columns of numbers."""
    n = len(like)
    numbers = np.full(n, table[node][0].as_py(), np.int64) if nodes is None else nodes
    return pa.table({"g": pa.array([table["g"][0].as_py()] * n, table.schema.field("g").type), name or node: numbers, **columns})


def newest(rows: DataFrame, group: list[str], n: int, *order: str) -> DataFrame:
    """The newest n rows of each group by the columns in order, descending."""
    return first_per_key(rows, group, [F.desc(c) for c in order], n)

"""Streaming variants of the operators with state: each micro-batch against tables of what earlier ones stored.

Those that keep last rows, counts or lists have a store (state.py). ingest_stream() writes a table that only grows: its state is a table in shared storage, not driver memory. A micro-batch writes its own folder,
stream=ID/epoch=N, as a whole, and reads all that other streams stored and its own epochs before N; so one that is run
again after a failure writes the same rows again, and nothing is stored twice. ID is that of the stream's checkpoint: a stream
that starts anew with another checkpoint goes on from what is stored. One stream writes to a table at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from wayglass.operators.alerts import unsent
from wayglass.operators.keyed import first_per_key, not_stored
from wayglass.operators.observations import fresh_rows
from wayglass.operators.snapshots import MAX_GAP, MIN_SPACING, increases, newest, thinned

from .state import Store, hashed, run_stream

Epoch = tuple[str, int]
#: Time that a part of snapshots covers.
PERIOD = 7 * 86_400_000
GIVEN = "world string, at long, boss string, day long, week long"
#: Values of a pruning column that are looked up one by one, at most.
MAX_VALUES = 1000


def stored(spark, path: str, schema: str, before: Epoch | None = None) -> DataFrame:
    """Rows of all epochs (but for those of a stream from an epoch on); empty where there are none yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, stream string, epoch long").parquet(path)
    return (rows if before is None else rows.where((F.col("stream") != before[0]) | (F.col("epoch") < before[1]))).select(*T.StructType.fromDDL(schema).names)


def _start(source: DataFrame, checkpoint: str, step: Callable[[DataFrame, Epoch], DataFrame], path: str, every: str | None, within: str | None = None) -> StreamingQuery:
    def run(batch: DataFrame, number: int) -> None:
        about = batch.sparkSession.read.text(f"{checkpoint}/metadata").first()[0]  # one line of JSON, written when a stream begins
        stream = json.loads(about)["id"]
        out = step(batch, (stream, number)).write.mode("overwrite")
        (out.partitionBy(within) if within else out).parquet(f"{path}/stream={stream}/epoch={number}")

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return source.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def ingest_stream(source: DataFrame, path: str, checkpoint: str, schema: str, key: list[str], order: str, every: str | None = None, within: str | None = None) -> StreamingQuery:
    """Store each key once, whatever arrives again; the first by order within a micro-batch. Without every, what is there is processed and the stream ends.

    within: a column of the key, such as its day, by which the table is stored in folders. A micro-batch
    then reads those of its own values only (as long as they are MAX_VALUES at most).
    """
    assert within is None or within in key, "rows of one key must lie in one folder"

    def step(batch: DataFrame, epoch: Epoch) -> DataFrame:
        names = stored(batch.sparkSession, path, schema, epoch)
        if within:
            values = [r[0] for r in batch.select(within).distinct().limit(MAX_VALUES + 1).collect()]
            if len(values) <= MAX_VALUES:
                own = F.col(within).isin([v for v in values if v is not None])
                names = names.where(own | F.col(within).isNull() if None in values else own)
        return fresh_rows(batch, names, key, order).select(*names.columns)

    return _start(source, checkpoint, step, path, every, within)


def thin_stream(source: DataFrame, path: str, checkpoint: str, group: str = "world", spacing: int = MIN_SPACING, every: str | None = None, keep: int | None = None, seen=None) -> StreamingQuery:
    """Keep times (group string, at) that are spacing after the last one kept; times before that one come too late and go.

    The store's log `rows` has all that was kept. Its table `kept` has the last one of each group, or the newest keep ones; a
    micro-batch reads and writes the parts of its own groups.
    """
    schema = f"{group} string, at long"

    def step(batch: DataFrame, store: Store) -> None:
        given = batch.select(group, F.col("at").cast("long").alias("at")).where("at IS NOT NULL")
        parts = store.parts_of(given, hashed(group))
        old = store.table("kept", schema, parts)
        last = old.groupBy(group).agg(F.max("at").alias("at"))
        of = last.select(F.col(group).alias("of"), F.col("at").alias("last"))
        later = given.join(of, given[group].eqNullSafe(of["of"]), "left").where("last IS NULL OR at > last").select(group, "at")
        new = not_stored(thinned(later.unionByName(last), group, spacing), last, [group, "at"]).select(group, "at").persist()
        store.add("rows", new)
        store.put("kept", newest(old.unionByName(new), [group], keep or 1, "at"), hashed(group), parts)
        new.unpersist()

    return run_stream(source, path, checkpoint, step, every, seen)


def increase_stream(source: DataFrame, path: str, checkpoint: str, max_gap: int = MAX_GAP, every: str | None = None, seen=None) -> StreamingQuery:
    """Keep snapshots (world string, at long, boss string, day long, week long) with increase and since, as snapshots.increases() has them of all at once.

    They may arrive in any order: one that comes late is compared with the one before it, and the one after it anew. A row that
    arrives again takes the earlier one's place. The store's table `rows` is in parts of a share of worlds and a PERIOD; a micro-batch writes
    those that its own snapshots, with max_gap after them, lie in, and reads the one before each. Its log `changes` has what is new or says something else now.
    """
    if max_gap > PERIOD:
        raise ValueError("snapshots are compared with neighbouring parts at most")
    schema, key = f"{GIVEN}, increase boolean, since long", ["world", "at", "boss"]
    share = hashed("world", parts=8)
    part = lambda at: F.concat_ws("_", share, F.floor(at / PERIOD).cast("string"))
    at = F.col("at")

    def step(batch: DataFrame, store: Store) -> None:
        names = T.StructType.fromDDL(GIVEN).names
        new = first_per_key(batch.select(names).where("at IS NOT NULL"), key, [F.desc("day"), F.desc("week")])
        own = set(store.parts_of(new, part(at))) | set(store.parts_of(new, part(at + max_gap)))  # as many as a micro-batch has periods and shares
        before = {f"{p.split('_')[0]}_{int(p.split('_')[1]) - 1}" for p in own}  # what a part's first snapshots are compared with
        old = store.table("rows", schema, sorted(own | before)).persist()
        every_one = not_stored(old.select(names), new, key).unionByName(new)
        told = increases(every_one, max_gap=max_gap).select(*names, "increase", "since").where(part(at).isin(*own)).persist()
        store.add("changes", not_stored(told, old, old.columns))
        store.put("rows", told, part(at), store.parts_of(told, part(at)))
        told.unpersist()
        old.unpersist()

    return run_stream(source, path, checkpoint, step, every, seen)


def alert_stream(source: DataFrame, subscriptions: DataFrame, path: str, checkpoint: str, every: str | None = None, keep: int | None = None, seen=None) -> StreamingQuery:
    """Store each due alert (alert_key array) once for each endpoint; the store's log `rows` is what is to be sent.

    What was sent stays known in the table `sent`, in parts by key; with keep only the newest keep keys do (by the
    micro-batch that first had them, then by key), in one part.
    """
    schema = "alert_key array<string>, endpoint string, first long"
    part = hashed("alert_key") if keep is None else F.lit("0")

    def step(batch: DataFrame, store: Store) -> None:
        parts = store.parts_of(batch, part) if keep is None else ["0"]
        old = store.table("sent", schema, parts)
        new = unsent(batch, subscriptions, old).select("alert_key", "endpoint").persist()
        store.add("rows", new)
        known = old.unionByName(new.withColumn("first", F.lit(store.commit.seq + 1).cast("long")))
        if keep is not None:
            of = known.groupBy("alert_key").agg(F.min("first").alias("first"))
            known = known.drop("first").join(of.orderBy(F.desc("first"), F.desc("alert_key")).limit(keep), "alert_key").select(*old.columns)
        store.put("sent", known, part, parts)
        new.unpersist()

    return run_stream(source, path, checkpoint, step, every, seen)


def next_marker(current: DataFrame, batches: DataFrame) -> DataFrame:
    """The reading mark (id, at) after batches (id, at, coverage): the latest one, never back, and not by batches with a gap."""
    offered = batches.where("coverage <> 'gap' AND id IS NOT NULL AND at IS NOT NULL").select("id", "at", F.lit(1).alias("new"))
    both = current.select("id", "at", F.lit(0).alias("new")).unionByName(offered)
    return both.agg(F.max_by(F.struct("id", "at"), F.struct("at", "new")).alias("m")).where("m IS NOT NULL").select("m.*")


def counted_windows(source: DataFrame, time: str, by: list[str], width: str = "3 hours", late: str = "1 day") -> DataFrame:
    """Rows of a stream by tumbling window and group, with a watermark; rows without a time are not part of any window (see undated)."""
    dated = source.where(F.col(time).isNotNull()).withWatermark(time, late)
    return dated.groupBy(F.window(time, width), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")


def window_stream(source: DataFrame, time: str, by: list[str], path: str, checkpoint: str, late: str = "1 day", every: str | None = None) -> StreamingQuery:
    """Add counted_windows() to the store's log `rows` once no row can reach them any more: rows that are later than late behind the latest time go, and so does a window's state."""

    def step(batch: DataFrame, store: Store) -> None:
        store.add("rows", batch)

    return run_stream(counted_windows(source, time, by, late=late), path, checkpoint, step, every)


def undated(source: DataFrame, time: str) -> DataFrame:
    """Rows without a time, which no watermark may drop."""
    return source.where(F.col(time).isNull())


def once_within(source: DataFrame, time: str, key: list[str], late: str = "1 day") -> DataFrame:
    """Rows of a stream, each key once within the watermark: bounded state where a table of all keys is not wanted."""
    return source.withWatermark(time, late).dropDuplicatesWithinWatermark(key)

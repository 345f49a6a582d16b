"""Tables that streams keep up: a micro-batch's changes of all tables become visible together, by one commit.

A store is a folder. A table in it is a folder of parts, part=P/seq=N: what seq N made of part P. A part is the share of keys that
one value of `part` names, such as a day or a number from a hash. Commit N is a file _commits/N of one line, which is put
in place by a rename once all of N's folders are there; rows of a higher seq than the last commit's are not there for readers. So a
micro-batch that is killed leaves nothing that shows, and when it runs again it clears that away and writes N anew; one that was committed, and runs again as the
stream's own mark was lost, is passed over. A micro-batch reads and writes the parts only that its own keys lie in.
One stream at a time writes to a store. Older versions of a part go when the one after the next is written.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

#: Parts by hash where a table names no other number.
PARTS = 32


def hashed(*columns: str | Column, parts: int = PARTS) -> Column:
    """Number of the part of a key, as text."""
    return F.pmod(F.xxhash64(*columns), F.lit(parts)).cast("string")


@dataclass
class Commit:
    """What a store stood at: seq, the last epoch of every stream, and small values such as a mark or counts."""

    seq: int = 0
    done: dict[str, int] = field(default_factory=dict)
    values: dict = field(default_factory=dict)


class Store:
    """The tables of one folder, as of their last commit when this was made."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())
        self.commit, self._begun = self._last(), False
        #: Folders that were read or written since, for tests and logs.
        self.read: list[str] = []
        self.wrote: list[str] = []

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        where = self._at(folder)
        return [x.getPath().getName() for x in self._fs.listStatus(where)] if self._fs.exists(where) else []

    def _last(self) -> Commit:
        numbers = [int(n) for n in self._names("_commits") if n.isdigit()]
        if not numbers:
            return Commit()
        told = json.loads(self.spark.read.text(f"{self.path}/_commits/{max(numbers):012d}").first()[0])
        return Commit(told["seq"], told["done"], told["values"])

    def _version(self, table: str, part: str) -> list[int]:
        """Committed versions of a part, oldest first."""
        found = [int(n.removeprefix("seq=")) for n in self._names(f"{table}/part={part}") if n.startswith("seq=")]
        return sorted(n for n in found if n <= self.commit.seq)

    def table(self, name: str, schema: str, parts: Iterable[str] | None = None) -> DataFrame:
        """Rows of a table, or of some of its parts."""
        if parts is None:
            parts = [n.removeprefix("part=") for n in self._names(name) if n.startswith("part=")]
        folders = [f"{self.path}/{name}/part={p}/seq={v[-1]}" for p in parts if (v := self._version(name, p))]
        self.read += folders
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], T.StructType.fromDDL(schema))

    def log(self, name: str, schema: str) -> DataFrame:
        """Rows of a table to which each commit added its own."""
        folder = f"{self.path}/{name}"
        if not self._fs.exists(self._at(name)):
            return self.spark.createDataFrame([], T.StructType.fromDDL(schema))
        return self.spark.read.schema(f"{schema}, seq long").parquet(folder).where(F.col("seq") <= self.commit.seq).drop("seq")

    def parts_of(self, rows: DataFrame, part: Column) -> list[str]:
        """The parts that rows lie in: as many values as the table has parts, at most."""
        return [r[0] for r in rows.select(part).distinct().collect()]

    def _begin(self) -> int:
        """The seq of the commit to come. What a killed run left of it goes first, so that it never shows."""
        seq = self.commit.seq + 1
        if not self._begun:
            mark = self._at(f"_begun/{seq}")
            if self._fs.exists(mark):
                for where in ("*", "*/part=*"):
                    for x in self._fs.globStatus(self._at(f"{where}/seq={seq}")) or []:
                        self._fs.delete(x.getPath(), True)
            self._fs.create(mark, True).close()
            self._begun = True
        return seq

    def put(self, name: str, rows: DataFrame, part: Column, parts: Iterable[str]) -> None:
        """New contents of some parts; one that gets no rows is empty from now on."""
        seq, parts = self._begin(), set(parts)
        staged = f"{self.path}/_staged/{name}"
        rows.withColumn("part", part).hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(staged)
        filled = {n.removeprefix("part="): n for n in self._names(f"_staged/{name}") if n.startswith("part=")}
        if not parts.issuperset(filled):
            raise ValueError("rows outside of the parts that are put")
        for p in parts:
            place = f"{name}/part={p}/seq={seq}"
            self._fs.delete(self._at(place), True)  # if it is put twice
            self._fs.mkdirs(self._at(f"{name}/part={p}"))
            if p in filled:
                self._fs.rename(self._at(f"_staged/{name}/{filled[p]}"), self._at(place))
            else:
                rows.limit(0).write.parquet(f"{self.path}/{place}")
            self.wrote.append(f"{self.path}/{place}")
            for old in self._version(name, p)[:-1]:
                self._fs.delete(self._at(f"{name}/part={p}/seq={old}"), True)

    def add(self, name: str, rows: DataFrame) -> None:
        """Rows that this commit adds to a log."""
        place = f"{self.path}/{name}/seq={self._begin()}"
        rows.write.mode("overwrite").parquet(place)
        self.wrote.append(place)

    def close(self, stream: str, epoch: int, **values) -> None:
        """Make all that was put and added visible."""
        self._begin()
        done = self.commit.done | {stream: epoch}
        new = Commit(self.commit.seq + 1, done, self.commit.values | values)
        line = json.dumps({"seq": new.seq, "done": new.done, "values": new.values})
        staged, place = self._at("_staged/commit"), self._at(f"_commits/{new.seq:012d}")
        out = self._fs.create(staged, True)
        out.write(bytearray(line, "utf-8"))
        out.close()
        self._fs.mkdirs(self._at("_commits"))
        if not self._fs.rename(staged, place):
            raise OSError(f"commit {new.seq} could not be put in place")
        for n in sorted(self._names("_commits"))[:-2]:
            self._fs.delete(self._at(f"_commits/{n}"), False)
        self._fs.delete(self._at(f"_begun/{new.seq}"), False)
        self.commit, self._begun = new, False


#: What a micro-batch does: it puts and adds tables, and gives the small values of the commit.
Step = Callable[[DataFrame, Store], dict]


def run_stream(source: DataFrame, path: str, checkpoint: str, step: Step, every: str | None = None, seen: Callable[[Store], None] | None = None) -> StreamingQuery:
    """Run step on every micro-batch and commit what it did. Without every, what is there is processed and the stream ends. seen: called with each store after its commit."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stream = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]  # one line, written when a stream begins
        store = Store(spark, path)
        if store.commit.done.get(stream, -1) >= number:
            return
        held = batch.persist()
        try:
            store.close(stream, number, **(step(held, store) or {}))
        finally:
            held.unpersist()
        if seen:
            seen(store)

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return source.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**trigger).start()

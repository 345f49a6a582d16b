"""Ledger of recorded checks: a user's actions are summed up in pieces, and only what depends on earlier pieces is walked in order."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

#: Recorded checks of a user that can be undone, the newest ones.
MAX_RECORDED = 2000
#: Actions that are summed up at once.
PIECE = 100_000
#: Rounds in which ids that meet open ones become open; then all that have several actions do.
ROUNDS = 16

_COUNTERS = ("made", "undone", "conflicts", "repeated")


class _Book:
    """Counts by boss and recorded checks of one user: from the beginning, or from an unknown state that a piece starts with.

    A kill's undo asks whether the count is what the check had made of it, which does not depend on the count at the start as long as none is set.
    known is None where it is as it was at the start.
    """

    def __init__(self, limit: int | None, known: bool | None) -> None:
        self.bosses: dict = {}
        self.recorded: OrderedDict = OrderedDict()
        self.limit, self.known = limit, known
        self.held = self.peak = 0

    def boss(self, name: str | None) -> dict:
        if name not in self.bosses:
            self.bosses[name] = {"kills": 0, "known": self.known} | dict.fromkeys(_COUNTERS, 0)
        return self.bosses[name]

    def forget(self, more: int) -> int:
        """Make room for so many, oldest first; returns how many of these have no room themselves."""
        excess = 0 if self.limit is None else max(0, self.held + more - self.limit)
        while excess and self.recorded:
            oldest, entry = next(iter(self.recorded.items()))
            gone = min(excess, entry) if isinstance(entry, int) else 1
            if gone == entry or not isinstance(entry, int):
                del self.recorded[oldest]
            else:
                self.recorded[oldest] = entry - gone
            self.held -= gone
            excess -= gone
        return excess

    def check(self, number: object, boss: str | None, counts: bool | None) -> None:
        if number in self.recorded:
            self.boss(self.recorded[number][0])["repeated"] += 1
            return
        now = self.bosses.get(boss, {"kills": 0, "known": self.known})
        self.forget(1)
        self.recorded[number] = (boss, bool(counts), now["kills"], now["known"])
        self.held += 1
        self.peak = max(self.peak, self.held)
        if counts:
            now = self.boss(boss)
            now.update(kills=now["kills"] + 1, known=True, made=now["made"] + 1)

    def undo(self, number: object) -> None:
        if number not in self.recorded:
            return
        boss, counted, kills, known = self.recorded[number]
        now = self.boss(boss)
        if counted and now["kills"] != kills + 1:
            now["conflicts"] += 1
            return
        if counted:
            now.update(kills=kills, known=known, undone=now["undone"] + 1)
        del self.recorded[number]
        self.held -= 1

    def add(self, boss: str | None, sums: dict) -> None:
        """What a summed-up run did to a boss."""
        now = self.boss(boss)
        now["known"] = now["known"] or bool(sums["known"])
        for name in ("kills", *_COUNTERS):
            now[name] += sums[name]

    def hold(self, place: int, stay: int, most: int) -> None:
        """Room for the most checks that a run had recorded at a time; those that stay are never asked for again."""
        stay -= self.forget(most)
        if stay > 0:
            self.recorded[(place,)] = stay
            self.held += stay


def _alone(rows: list[tuple], limit: int) -> np.ndarray:
    """Which of rows (key, seq, action, id, boss, counts, kills, times) can be summed up: their ids have all their actions within one run of such rows.

    Sets end runs, as do ids with actions in other pieces, those that so many checks lie between that they may be forgotten, and those that
    would reach over the end of a run.
    """
    codes: dict = {}
    code = np.array([codes.setdefault((r[0], r[3]), len(codes)) for r in rows])
    check = np.cumsum([r[2] == "check" for r in rows])
    is_set = np.array([r[2] == "set" for r in rows])
    at = np.flatnonzero(~is_set)
    first, last = np.full(len(codes), len(rows) - 1), np.zeros(len(codes), int)
    np.minimum.at(first, code[at], at)
    np.maximum.at(last, code[at], at)
    times = np.zeros(len(codes), int)
    times[code[at]] = [rows[i][7] for i in at]
    here = np.bincount(code[at], minlength=len(codes))
    opened = (here != times) | ((here > 0) & (check[last] - check[first] >= limit))
    for _ in range(ROUNDS):
        before = np.cumsum(is_set | opened[code])
        met = ~opened & (here > 0) & (before[last] != before[first])
        if not met.any():
            break
        opened |= met
    else:
        opened |= here > 1
    return ~(is_set | opened[code])


def summed(actions: DataFrame, limit: int = MAX_RECORDED, piece: int = PIECE) -> DataFrame:
    """actions (key, seq, action, id, boss, counts, kills) with runs that depend on nothing before them summed up: what is left to walk, in order of key, seq and place.

    A run becomes a row for each boss (action 'sum': what it adds) and one for the checks it recorded (action 'hold': kills that stay, and the
    most at a time as made). Actions are dealt out by ranges of key and seq, so those of one key lie in many tasks; a task holds one piece.
    """
    rows = actions.where(F.col("action").isin("check", "undo", "set"))
    times = rows.where("action <> 'set'").groupBy("key", "id").agg(F.count("*").alias("times")).where("times > 1")
    l, r = rows.alias("l"), times.alias("r")  # noqa: E741
    same = F.col("l.key").eqNullSafe(F.col("r.key")) & F.col("l.id").eqNullSafe(F.col("r.id")) & (F.col("l.action") != "set")
    told = l.join(r, same, "left").select("l.*", F.coalesce("r.times", F.lit(1)).alias("times"))
    given = [f for f in rows.schema.fields if f.name in ("key", "seq", "id")]
    kinds = {f.name: f.dataType for f in given}
    new = [("place", LongType()), ("action", StringType()), ("boss", StringType()), ("counts", BooleanType()), ("kills", LongType()), ("known", BooleanType())]
    schema = StructType([StructField(n, t) for n, t in (*kinds.items(), *new, *((c, LongType()) for c in _COUNTERS))])
    names = schema.names
    take = ("key", "seq", "action", "id", "boss", "counts", "kills", "times")

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, waiting, types = 0, [], None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            nonlocal place
            made: list[dict] = []
            book, owner, seq = None, None, None

            def put(**values) -> None:
                nonlocal place
                place += 1
                made.append(values | {"place": place})

            def close() -> None:
                nonlocal book
                if book is not None:
                    for boss, sums in book.bosses.items():
                        put(key=owner, seq=seq, action="sum", boss=boss, **sums)
                    if book.peak:
                        put(key=owner, seq=seq, action="hold", kills=book.held, made=book.peak)
                book = None

            for (who, when, action, number, boss, counts, kills, _), alone in zip(rows, _alone(rows, limit), strict=True):
                if book is not None and (who != owner or not alone):
                    close()
                if not alone:
                    put(key=who, seq=when, action=action, id=number, boss=boss, counts=counts, kills=kills)
                    continue
                book = book or _Book(None, None)
                owner, seq = who, when
                if action == "check":
                    book.check(number, boss, counts)
                else:
                    book.undo(number)
            close()
            return pa.RecordBatch.from_arrays([pa.array([m.get(n) for m in made], t) for n, t in zip(names, types, strict=True)], names)

        for batch in batches:
            own = {n: batch.schema.field(n).type for n in kinds}
            types = [own.get(n) or {"long": pa.int64(), "boolean": pa.bool_()}.get(long_names[n], pa.string()) for n in names]
            waiting.extend(zip(*(batch[c].to_pylist() for c in take), strict=True))
            while len(waiting) >= piece:
                yield out(waiting[:piece])
                waiting = waiting[piece:]
        if waiting:
            yield out(waiting)

    long_names = {f.name: "long" if isinstance(f.dataType, LongType) else "boolean" if isinstance(f.dataType, BooleanType) else "string" for f in schema.fields}
    return told.select(*take).repartitionByRange("key", "seq").sortWithinPartitions("key", "seq").mapInArrow(reduce, schema)


def ledger(actions: DataFrame, key: str = "user", limit: int = MAX_RECORDED, piece: int = PIECE) -> DataFrame:
    """kills, known, made, undone, conflicts and repeated by key and boss, from actions: key, seq, action, id, boss, counts, kills.

    A 'check' is recorded by its id, and adds a kill where it counts; an id that is recorded already adds nothing. An
    'undo' takes a recorded check away and puts its boss back to what it had before, but only while the count is
    what the check had made of it: else it is a conflict and the check stays. 'set' gives a boss a count. Other actions do nothing.
    Only the newest `limit` checks of a key can be undone.

    Pieces of a key's actions are summed up wherever they lie (see summed); sums compose, whatever state they meet. Walked in order of seq, one key in one task,
    are the sums, sets, and actions of ids that come again in another piece or across a set: a task holds the recorded checks of one key and no rows.
    A user who mostly sets, or undoes across pieces, is still walked action by action. Null keys and ids are values like others; rows of one key
    and seq come in any order; a null boss has a row of its own; an empty table gives none, and other columns are ignored.
    """
    kind = actions.schema[key].dataType
    given = actions.select(F.col(f"`{key}`").alias("key"), "seq", "action", "id", "boss", F.col("counts").cast("boolean").alias("counts"), F.col("kills").cast("long").alias("kills"))
    out = ("kills", "known", *_COUNTERS)
    schema = StructType([StructField("key", kind), StructField("boss", StringType()), *(StructField(c, BooleanType() if c == "known" else LongType()) for c in out)])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, book = None, None

        def done() -> pa.RecordBatch:
            rows = [(owner, boss, *(b[c] for c in out)) for boss, b in book.bosses.items()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        for batch in batches:
            types = [batch.schema.field("key").type, pa.string(), pa.int64(), pa.bool_(), *[pa.int64()] * 4]
            names = ["key", "boss", *out]
            for row in zip(*(batch[c].to_pylist() for c in ("key", "place", "action", "id", "boss", "counts", *out)), strict=True):
                who, place, action, number, boss, counts = row[:6]
                sums = dict(zip(out, row[6:], strict=True))
                if book is not None and who != owner:
                    yield done()
                    book = None
                owner, book = who, book or _Book(limit, False)
                if action == "set":
                    book.boss(boss).update(kills=sums["kills"], known=True)
                elif action == "sum":
                    book.add(boss, sums)
                elif action == "hold":
                    book.hold(place, sums["kills"], sums["made"])
                elif action == "check":
                    book.check(number, boss, counts)
                else:
                    book.undo(number)
        if book is not None:
            yield done()

    ordered = summed(given, limit, piece).repartition("key").sortWithinPartitions("key", "seq", "place")
    return ordered.mapInArrow(fold, schema).withColumnRenamed("key", key)

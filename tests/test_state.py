import hashlib
import random

import pytest
from pyspark.sql import functions as F

from wayglass.operators import patterns, snapshots
from wayglass.streaming import ingest, reports, state
from wayglass.streaming.state import Store

DAY = 86_400_000


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_a_commit_shows_all_tables_or_none_and_parts_are_read_alone(spark, tmp_path):
    path = str(tmp_path / "s")
    put = lambda store, rows, parts: store.put("t", spark.createDataFrame(rows, "k string, v int"), F.col("k"), parts)
    store = Store(spark, path)
    put(store, [("a", 1), ("b", 1)], ["a", "b", "c"])
    store.add("l", spark.createDataFrame([(1,)], "x int"))
    assert Store(spark, path).table("t", "k string, v int").count() == 0 and Store(spark, path).log("l", "x int").count() == 0
    store.close("s", 0, mark="m")
    again = Store(spark, path)
    assert rows_of(again.table("t", "k string, v int")) == ["('a', 1)", "('b', 1)"] and again.log("l", "x int").count() == 1 and again.commit.values == {"mark": "m"}
    put(again, [("b", 2)], ["b"])  # never committed
    again.add("l", spark.createDataFrame([(9,)], "x int"))
    third = Store(spark, path)
    put(third, [("a", 3)], ["a"])
    third.close("s", 1)
    last = Store(spark, path)
    assert rows_of(last.table("t", "k string, v int", ["a"])) == ["('a', 3)"] and len(last.read) == 1
    assert rows_of(last.log("l", "x int")) in (["(1,)"],)
    with pytest.raises(ValueError):
        put(last, [("z", 1)], ["a"])


GIVEN = ingest.GIVEN


def test_snapshots_in_any_order_are_those_of_all_at_once(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    times = {w: sorted(rng.sample(range(0, DAY // 2, 600_000), 40)) for w in "ABC"}
    rows = [(w, t, b, rng.randrange(3), rng.randrange(5)) for w, ts in times.items() for t in ts for b in "xy" if rng.random() < 0.8]
    monkeypatch.setattr(ingest, "PERIOD", 7_200_000)  # many parts
    want = rows_of(snapshots.increases(spark.createDataFrame(rows, GIVEN)).select("world", "at", "boss", "day", "week", "increase", "since"))
    schema = f"{GIVEN}, increase boolean, since long"
    shots = sorted({r[:2] for r in rows})
    rng.shuffle(shots)
    for k in range(4):
        part = set(shots[k::4])
        write(spark, tmp_path / "in", f"p{k}", [r for r in rows if r[:2] in part], GIVEN)
    ingest.increase_stream(stream(spark, tmp_path / "in", GIVEN), str(tmp_path / "out"), str(tmp_path / "m")).awaitTermination()
    assert rows_of(Store(spark, str(tmp_path / "out")).table("rows", schema)) == want


def test_a_late_snapshot_corrects_the_next_one(spark, tmp_path):
    runs = []
    for k, rows in enumerate(([("W", 0, "A", 1, 1)], [("W", 1_200_000, "A", 2, 2), ("V", 40 * DAY, "A", 1, 1)], [("W", 600_000, "A", 2, 2)])):
        write(spark, tmp_path / "in", f"p{k}", rows, GIVEN)
        ingest.increase_stream(stream(spark, tmp_path / "in", GIVEN), str(tmp_path / "out"), str(tmp_path / "m"), seen=runs.append).awaitTermination()
    store, schema = Store(spark, str(tmp_path / "out")), f"{GIVEN}, increase boolean, since long"
    assert rows_of(store.table("rows", schema).select("world", "at", "increase", "since")) == rows_of(spark.createDataFrame([("W", 0, False, None), ("W", 600_000, True, 0), ("W", 1_200_000, False, None), ("V", 40 * DAY, False, None)], "w string, at long, i boolean, s long"))
    assert store.log("changes", schema).where("at = 1200000").count() == 2  # as it was, and as it is now
    assert len(runs[-1].read) == 1 and len(runs[-1].wrote) == 2  # of two worlds and many days: one part, and the log


def test_a_micro_batch_reads_parts_of_its_own_groups(spark, tmp_path):
    schema, runs = "world string, at long", []
    run = lambda: ingest.thin_stream(stream(spark, tmp_path / "in", schema), str(tmp_path / "out"), str(tmp_path / "m"), spacing=10, keep=2, seen=runs.append).awaitTermination()
    write(spark, tmp_path / "in", "a", [(f"g{i}", t) for i in range(300) for t in (0, 4, 12, 30)] + [(None, 5), (None, 6)], schema)
    run()
    write(spark, tmp_path / "in", "b", [("g7", 35), ("g7", 41), ("g7", 29), (None, 20)], schema)
    run()
    assert len(runs[0].wrote) == state.PARTS + 1 and len(runs[1].read) == 2
    store = Store(spark, str(tmp_path / "out"))
    assert rows_of(store.table("kept", schema).where("world = 'g7' OR world IS NULL OR world = 'g8'")) == sorted(["('g7', 30)", "('g7', 41)", "('g8', 12)", "('g8', 30)", "(None, 5)", "(None, 20)"])
    assert store.log("rows", schema).where("world = 'g7'").count() == 4


def test_only_the_newest_sent_keys_stay_known(spark, tmp_path):
    schema = "alert_key array<string>"
    subscriptions = spark.createDataFrame([("e1",), ("e2",)], "endpoint string")
    for k, keys in enumerate((["a", "b"], ["c"], ["a", "b"])):
        write(spark, tmp_path / "in", f"p{k}", [([x],) for x in keys], schema)
        ingest.alert_stream(stream(spark, tmp_path / "in", schema), subscriptions, str(tmp_path / "out"), str(tmp_path / "m"), keep=2).awaitTermination()
    store = Store(spark, str(tmp_path / "out"))
    sent = store.log("rows", "alert_key array<string>, endpoint string")
    assert {(r.k, r.n) for r in sent.groupBy(F.col("alert_key")[0].alias("k")).agg(F.count("*").alias("n")).collect()} == {("a", 4), ("b", 2), ("c", 2)}
    assert store.table("sent", "alert_key array<string>, endpoint string, first long").select("alert_key").distinct().count() == 2


# --- chat batches ---

NOW = 1_791_241_200_000  # 2026-10-05T20:00-03:00
NAMES = ["Dharalion", "Hirintror"]


def message(i, text, mark=None, coverage="complete", **more):
    row = {"seq": i, "id": hashlib.sha256(str(more.pop("of", i)).encode()).hexdigest(), "text": text, "date": "2026-10-05", "time": "10:00", "media": False, "mark_id": hashlib.sha256(b"m").hexdigest() if mark else None, "mark_at": mark, "coverage": coverage} | more
    return tuple(row.values())


class Sync:
    def __init__(self, spark, folder, **limits):
        self.spark, self.folder, self.limits, self.n = spark, folder, limits, 0
        self.names = spark.createDataFrame([(n, i) for i, n in enumerate(NAMES)], "name string, seq int")

    def send(self, *rows, marks="m"):
        write(self.spark, self.folder / "in", f"p{self.n}", list(rows), reports.MESSAGES)
        self.n += 1
        self.run(marks)

    def run(self, marks="m"):
        reports.sync_stream(stream(self.spark, self.folder / "in", reports.MESSAGES), self.names, "Lunarian", ["Lunarian"], NOW, str(self.folder / "out"), str(self.folder / marks), **self.limits).awaitTermination()

    def state(self):
        s = Store(self.spark, str(self.folder / "out"))
        checks = sorted((r.boss, r.result, r.time, r.origin) for r in s.table("checks", reports.CHECKS).collect())
        return checks, s.table("pending", reports.PENDING).count(), s.table("seen", reports.SEEN).count(), s.commit.values.get("mark", {}).get("at"), [r.reason for r in s.log("rejected", reports.REJECTED).orderBy("epoch").collect()]


def test_a_batch_of_messages_and_its_mark_are_stored_together_or_not_at_all(spark, tmp_path):
    sync = Sync(spark, tmp_path)
    sync.send(message(0, "Dharalion NÃO ESTAVA", mark=NOW - 5), message(1, "Hirintror?"), message(2, "bom dia"), message(3, "Dharalion não estava", of=0))
    first = ([("Dharalion", "vazio", "10:00", "whatsapp")], 2, 3, NOW - 5, [])
    assert sync.state() == first
    sync.send(message(0, "Hirintror ✅", mark=NOW, of=9), message(1, "x", id="short"))
    assert sync.state() == (*first[:4], ["id"])
    sync.send(message(0, "Hirintror ✅", mark=NOW, of=9), message(1, "x" * 6001))
    sync.send(message(0, "Hirintror ✅", mark=NOW + 70_000, of=9))
    sync.send(*(message(i, "x", of=f"n{i}") for i in range(101)))
    assert sync.state() == (*first[:4], ["id", "text", "mark", "size"])
    sync.send(message(0, "Hirintror ✅", mark=NOW, coverage="gap", of=9), message(1, "Dharalion não estava", of=10), message(2, "Dharalion ✅", of=11, date="2027-01-01"))
    second = ([("Dharalion", "vazio", "10:00", "whatsapp"), ("Hirintror", "encontrado", "10:00", "whatsapp")], 3, 6, NOW - 5, ["id", "text", "mark", "size"])
    assert sync.state() == second  # a gap moves no mark; a report of a day to come waits for a person
    sync.run("other marks")  # all batches again, from a stream that knows nothing: nothing is added
    assert sync.state()[:3] == second[:3]


def test_full_lists_reject_and_known_ids_are_the_newest(spark, tmp_path):
    sync = Sync(spark, tmp_path, max_pending=2, max_checks=2, keep=3)
    sync.send(message(0, "Dharalion?"), message(1, "Hirintror?", of=1))
    sync.send(message(0, "Dharalion ✅", of=2), message(1, "Dharalion?", of=3))
    assert sync.state() == ([], 2, 2, None, ["full"])
    sync.send(message(0, "Dharalion ✅", of=4), message(1, "Hirintror ✅", of=5))
    sync.send(message(0, "Dharalion ✅", of=6, time="11:00"))
    assert sync.state()[0] == [("Dharalion", "encontrado", "10:00", "whatsapp"), ("Hirintror", "encontrado", "10:00", "whatsapp")] and sync.state()[2:] == (3, None, ["full", "full"])


def test_a_killed_epoch_leaves_nothing_and_runs_again(spark, tmp_path, monkeypatch):
    sync = Sync(spark, tmp_path)
    whole = Store.close

    def killed(self, *a, **b):
        raise OSError("killed")

    monkeypatch.setattr(Store, "close", killed)
    with pytest.raises(Exception, match="killed"):
        sync.send(message(0, "Dharalion ✅", mark=NOW))
    assert sync.state() == ([], 0, 0, None, [])
    monkeypatch.setattr(Store, "close", whole)
    sync.run()
    done = ([("Dharalion", "encontrado", "10:00", "whatsapp")], 0, 1, NOW, [])
    assert sync.state() == done
    commits = tmp_path / "m" / "commits"
    for f in commits.iterdir():  # the stream's own mark of the epoch is lost: it runs again
        f.unlink()
    sync.run()
    assert sync.state() == done


def test_a_text_that_comes_again_is_read_once_and_no_task_holds_a_batch(spark, tmp_path, monkeypatch):
    given, plans = [], []
    read, saved = reports.observations.read_messages, reports.saved
    monkeypatch.setattr(reports.observations, "read_messages", lambda messages, *a: given.append(messages.count()) or read(messages, *a))
    monkeypatch.setattr(reports, "saved", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or saved(df, name))
    sync = Sync(spark, tmp_path, max_batch=10**6)
    said = ["Dharalion ✅", "[09:10, 05/10/2026] Ana: Dharalion não estava", "Hirintror?", "bom dia"]
    sync.send(*(message(i, said[i % 4], date=f"2026-09-{i // 4 % 25 + 1:02d}", time=f"{i // 100:02d}:00", mark=NOW) for i in range(1000)))
    days = {("Dharalion", "encontrado", f"{h:02d}:00", "whatsapp") for h in range(10)}
    checks, pending, seen, mark, rejected = sync.state()
    assert set(checks) == days | {("Dharalion", "vazio", "09:10", "whatsapp")} and (len(checks), pending, seen, mark, rejected) == (251, 500, 1000, NOW, [])
    assert given == [4] and plans and not [p for p in plans if "SinglePartition" in p]
    found = Store(spark, f"{tmp_path}/out").table("identified", reports.IDENTIFIED)
    assert {(r.bosses[0], r.n) for r in found.groupBy("bosses").agg(F.count("*").alias("n")).collect()} == {("Dharalion", 500), ("Hirintror", 250)}
    assert found.where("bosses[0] = 'Dharalion'").select("at").distinct().count() == 250  # own times, also of those with a stamp in their text


def test_messages_after_a_large_batch_are_the_newer_ones(spark, tmp_path):
    sync = Sync(spark, tmp_path, max_batch=1 << 40, keep=3)
    none = F.lit(None)
    many = spark.range(1_000_050).select(F.col("id").alias("seq"), F.sha2(F.col("id").cast("string"), 256).alias("id"), F.lit("").alias("text"), F.lit("2026-10-05").alias("date"), F.lit("10:00").alias("time"), F.lit(False).alias("media"), none.cast("string").alias("mark_id"), none.cast("long").alias("mark_at"), none.cast("string").alias("coverage"))
    many.coalesce(1).write.parquet(f"{tmp_path}/in/p0")
    sync.n = 1
    sync.run()
    sync.send(message(0, "y", of="new"))
    seen = [r.id for r in Store(spark, f"{tmp_path}/out").table("seen", reports.SEEN).orderBy(F.desc("place")).collect()]
    assert seen == [hashlib.sha256(x.encode()).hexdigest() for x in ("new", "1000049", "1000048")]


# --- patterns through batches that come and go ---


def test_patterns_through_added_and_undone_batches(spark, tmp_path):
    rng = random.Random(8)
    schema = f"action string, step long, {reports.REPORTS}"
    report = lambda batch, n: (batch, rng.choice("VW"), rng.choice("xyz"), f"2026-01-{rng.randrange(1, 25):02d}", rng.choice([None, 1, 3, 3, 3]), rng.random() < 0.4, rng.choice(["yes", "no", "unknown"]), rng.randrange(10**6), n)
    held, number = {}, 0
    for micro in range(4):
        rows = []
        for step, batch in enumerate(rng.sample([f"b{i}" for i in range(12)], 7)):
            if rng.random() < 0.35:
                rows.append(("undo", 2 * step, batch, *[None] * 8))
                held.pop(batch, None)
                if rng.random() < 0.5:
                    continue
            new = [report(batch, (number := number + 1)) for _ in range(30)]
            rows += [("add", 2 * step + 1, *r) for r in new]
            held.setdefault(batch, new)
        write(spark, tmp_path / "in", f"p{micro}", rows, schema)
        reports.pattern_stream(stream(spark, tmp_path / "in", schema), str(tmp_path / "out"), str(tmp_path / "m")).awaitTermination()
        left = spark.createDataFrame([r for rs in held.values() for r in rs], reports.REPORTS)
        found = Store(spark, str(tmp_path / "out")).table("patterns", reports.PATTERNS)
        assert rows_of(found.drop("last")) == rows_of(patterns.find(left).select(*found.drop("last").columns))
        assert rows_of(found.where("last IS NOT NULL").select("world", "boss", "last.at", "last.day", "last.seq")) == rows_of(patterns.last_seen(left).select("world", "boss", "at", "day", "seq"))


def test_a_batch_touches_its_own_parts_only(spark, tmp_path):
    schema, runs = f"action string, step long, {reports.REPORTS}", []
    run = lambda: reports.pattern_stream(stream(spark, tmp_path / "in", schema), str(tmp_path / "out"), str(tmp_path / "m"), seen=runs.append).awaitTermination()
    write(spark, tmp_path / "in", "a", [("add", 1, f"b{i}", "W", f"boss{i}", f"2026-01-{i % 28 + 1:02d}", 1, True, "yes", i, i) for i in range(200)], schema)
    run()
    write(spark, tmp_path / "in", "b", [("undo", 1, "b5", *[None] * 8)], schema)
    run()
    assert len(runs[1].wrote) == 4 and len(runs[1].read) == 3  # a part each of index, reports, days; and of patterns, which is not read
    found = Store(spark, str(tmp_path / "out")).table("patterns", reports.PATTERNS)
    assert found.count() == 199 and found.where("boss = 'boss5'").count() == 0

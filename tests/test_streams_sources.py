import json

from pyspark.sql import functions as F

from wayglass.operators import snapshots
from wayglass.sources import store
from wayglass.streaming import ingest
from wayglass.streaming.state import Store

SCHEMA = "k string, v int"


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).parquet(f"{folder}/*")


def test_ingest_stores_each_key_once_across_restarts(spark, tmp_path):
    source, out, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")
    write(spark, source, "a", [("x", 1), ("y", 2), ("x", 3)], SCHEMA)
    run = lambda: ingest.ingest_stream(stream(spark, source, SCHEMA), out, marks, SCHEMA, ["k"], "v").awaitTermination()
    run()
    write(spark, source, "b", [("x", 0), ("z", 4), (None, 5), (None, 6)], SCHEMA)
    run()
    run()
    rows = sorted(map(tuple, ingest.stored(spark, out, SCHEMA).collect()), key=str)
    assert rows == sorted([("x", 1), ("y", 2), ("z", 4), (None, 5)], key=str)


def test_a_new_checkpoint_goes_on_from_what_is_stored(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    write(spark, source, "a", [("x", 1), ("y", 1), (None, 1)], SCHEMA)
    run = lambda marks: ingest.ingest_stream(stream(spark, source, SCHEMA), out, str(tmp_path / marks), SCHEMA, ["k"], "v", within="k").awaitTermination()
    run("m1")
    write(spark, source, "b", [("x", 2), ("z", 2), (None, 3)], SCHEMA)
    run("m2")  # reads all of the source again, as epoch 0
    assert sorted(map(tuple, ingest.stored(spark, out, SCHEMA).collect()), key=str) == sorted([("x", 1), ("y", 1), ("z", 2), (None, 1)], key=str)


def test_increases_as_a_stream_are_those_of_all_at_once(spark, tmp_path):
    source, out, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")
    schema = "world string, at long, boss string, day long, week long"
    rows = [("W", 1000, "A", 0, 1), ("W", 1000, "B", 5, 5), ("W", 2000, "A", 1, 2), ("V", 9, "A", 1, 1), ("W", 3000, "A", 1, 2), ("W", 3000, "B", 6, 6), ("W", 9_000_000, "A", 7, 9), ("V", 10, "A", 1, 2)]
    for part, some in (("a", rows[:4]), ("b", rows[4:6]), ("c", rows[6:])):
        write(spark, source, part, some, schema)
        ingest.increase_stream(stream(spark, source, schema), out, marks).awaitTermination()
    found = Store(spark, out).table("rows", schema + ", increase boolean, since long")
    want = snapshots.increases(spark.createDataFrame(rows, schema)).select(*found.columns)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and found.where("increase").count() == 2


def test_an_epoch_that_runs_again_writes_the_same(spark, tmp_path):
    out = str(tmp_path / "out")
    for stream, epoch, k in (("s", 0, "x"), ("s", 1, "y"), ("old", 5, "z")):
        spark.createDataFrame([(k, 1)], SCHEMA).write.parquet(f"{out}/stream={stream}/epoch={epoch}")
    assert sorted(r.k for r in ingest.stored(spark, out, SCHEMA, before=("s", 1)).collect()) == ["x", "z"]
    assert ingest.stored(spark, str(tmp_path / "none"), SCHEMA).count() == 0


def test_thinning_goes_on_from_what_was_kept(spark, tmp_path):
    source, out, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")
    schema = "world string, at long"
    run = lambda: ingest.thin_stream(stream(spark, source, schema), out, marks, spacing=10).awaitTermination()
    write(spark, source, "a", [("g", 0), ("g", 4), ("g", 12)], schema)
    run()
    write(spark, source, "b", [("g", 5), ("g", 21), ("g", 22), ("g", 31), ("h", 1)], schema)
    run()
    assert sorted(map(tuple, Store(spark, out).log("rows", schema).collect())) == [("g", 0), ("g", 12), ("g", 22), ("h", 1)]


def test_alerts_are_stored_once(spark, tmp_path):
    source, out, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")
    schema = "alert_key array<string>"
    subscriptions = spark.createDataFrame([("e1",), ("e2",)], "endpoint string")
    run = lambda: ingest.alert_stream(stream(spark, source, schema), subscriptions, out, marks).awaitTermination()
    write(spark, source, "a", [(["a"],), (["a"],)], schema)
    run()
    write(spark, source, "b", [(["a"],), (["b"],)], schema)
    run()
    assert Store(spark, out).log("rows", "alert_key array<string>, endpoint string").count() == 4


def test_marks_never_go_back(spark):
    schema = "id string, at long"
    current = spark.createDataFrame([("m5", 5)], schema)
    offers = lambda *rows: spark.createDataFrame(list(rows), schema + ", coverage string")
    after = lambda *rows: ingest.next_marker(current, offers(*rows)).first().id
    assert after(("m9", 9, "gap")) == "m5" and after(("m3", 3, "complete")) == "m5"
    assert after(("m7", 7, "complete"), ("m9", 9, "gap")) == "m7" and after(("n5", 5, "baseline")) == "n5"
    assert ingest.next_marker(spark.createDataFrame([], schema), offers()).count() == 0


def test_windows_and_rows_without_time(spark, tmp_path):
    schema = "ts timestamp, boss string"
    source = tmp_path / "in"
    spark.createDataFrame([("2026-01-01 01:00:00", "a"), ("2026-01-01 02:59:59", "a"), ("2026-01-05 03:00:00", "a"), (None, "a")], "ts string, boss string").select(F.col("ts").cast("timestamp").alias("ts"), "boss").write.parquet(f"{source}/a")
    q = ingest.counted_windows(stream(spark, source, schema), "ts", ["boss"]).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("windows").collect()) == [1, 2]
    q = ingest.undated(stream(spark, source, schema), "ts").writeStream.format("memory").queryName("undated").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("undated").count() == 1
    q = ingest.once_within(stream(spark, source, schema), "ts", ["boss"]).writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 1


def test_provider_files(spark, tmp_path):
    def put(name, value):
        (tmp_path / name).write_text(json.dumps(value))
        return str(tmp_path / name)

    record = {"boss": "B", "status_key": "quente", "last_kills": [{"date": "d", "approx": True}]}
    path = put("h.json", {"updated": "05/10/2026", "worlds": {"lunarian": {"bosses": [record, {"x": 1}], "demonLords": [{"boss": "D"}]}}})
    assert [(r.seq, r.boss) for r in store.read_history(spark, path, "Lunarian").collect()] == [(0, "B"), (2, "D")]
    assert store.read_history(spark, path, "Auroria").count() == 0
    path = put("c.json", {"entries": [{"race_name": "A", "creatures_killed_24h": 1, "creatures_killed_7d": 2.5}]})
    assert [tuple(r) for r in store.read_counts(spark, path).collect()] == [(0, "A", 1.0, 2.5)]
    path = put("l.json", [{"name": "A"}, {"image_url": "u"}])
    assert [r.name for r in store.read_catalogue(spark, path).collect()] == ["A"]
    paths = [put("r1.json", {"category": "magic", "players": [{"name": "x", "rank": 1, "value": 5}]}), put("r2.json", {"category": "axe", "error": "HTTP 429"}), put("r3.json", {"category": "fist"})]
    lists, players = store.read_rankings(spark, paths)
    assert {r.category: r.error for r in lists.collect()} == {"magic": None, "axe": "HTTP 429", "fist": "unknown format"}
    assert [r.name for r in players.collect()] == ["x"]


def test_state_exports_merges_and_parts(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, None), ("b", 2, 5)], "k string, v int, w int")
    store.save(rows, str(tmp_path / "t"))
    store.save(rows.limit(1), str(tmp_path / "t"), "append")
    assert store.load(spark, str(tmp_path / "t"), "k string, v int, w int").count() == 3
    assert store.load(spark, str(tmp_path / "u"), "k string").count() == 0
    store.export_json(rows, str(tmp_path / "j"))
    assert sorted(map(tuple, store.import_json(spark, str(tmp_path / "j"), "k string, v int, w int").collect())) == [("a", 1, None), ("b", 2, 5)]
    try:
        store.import_json(spark, str(tmp_path / "j"), "k string, v int, w int", version=2).collect()
        raise SystemError
    except SystemError:
        raise
    except Exception as e:
        assert "unknown version" in str(e)
    new = spark.createDataFrame([("b", None, 6), ("c", 3, 7)], rows.schema)
    assert sorted(map(tuple, store.merged(rows, new, "k").collect())) == [("a", 1, None), ("b", 2, 6), ("c", 3, 7)]
    texts = spark.createDataFrame([(1, "abcde" * 5), (2, ""), (3, "ç🙂x" * 4)], "id int, text string")
    parts = store.split_parts(texts, "id", "text", 4)
    assert {r.id: bytes(r.content).decode() for r in store.join_parts(parts, "id").collect()} == {1: "abcde" * 5, 2: "", 3: "ç🙂x" * 4}
    wide = spark.createDataFrame([(1, "ç" * 100_000), (2, "x" * 60_000)], "id int, text string")  # of 200,000 bytes and 60,000
    assert {(r.id, r.parts) for r in store.join_parts(store.split_parts(wide, "id", "text"), "id").collect()} == {(1, 4), (2, 1)}
    raw = spark.createDataFrame([(1, bytearray(range(256)) * 300)], "id int, raw binary")  # what is no text
    assert bytes(store.join_parts(store.split_parts(raw, "id", "raw", 7_001), "id").first().content) == bytes(range(256)) * 300

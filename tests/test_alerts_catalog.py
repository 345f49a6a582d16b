import pytest
from pyspark.sql import functions as F

from wayglass.functions.timing import at_local, hour_bucket, instant, local_date, valid_date
from wayglass.operators import alerts, catalog, progress, rankings, snapshots
from wayglass.operators.ledger import ledger

START, END = 1_791_234_000_000, 1_791_320_400_000  # 2026-10-05T18:00-03:00 and a day later
FIELDS = "world string, boss_name string, start_text string, end_text string, completed boolean, muted boolean, favorite boolean"


def windows(spark, start="2026-10-05T18:00:00-03:00", **flags):
    row = ("Lunarian", "Midnight Panther", start, "2026-10-06T18:00:00-03:00", flags.get("completed"), flags.get("muted"), flags.get("favorite"))
    df = spark.createDataFrame([row], FIELDS)
    return df.withColumn("start", instant(F.col("start_text"))).withColumn("end", instant(F.col("end_text")))


@pytest.mark.parametrize("now,kind", [(START - 1_800_001, None), (START - 1_800_000, "soon"), (START, "open"), (END, "open"), (END + 1, None)])
def test_alert_boundaries(spark, now, kind):
    rows = alerts.due(windows(spark), now, 30).collect()
    assert [r.kind for r in rows] == ([kind] if kind else [])


def test_soon_and_open_share_a_key(spark):
    keys = {tuple(alerts.due(windows(spark), now, 30).first().alert_key) for now in (START - 1, START)}
    assert len(keys) == 1


def test_lead_is_held_for_windows(spark):
    assert alerts.due(windows(spark), START - 5 * 60_000, 1).count() == 1
    assert alerts.due(windows(spark), START - 121 * 60_000, 500).count() == 0


def test_times_without_zone_are_unknown(spark):
    df = windows(spark, "2026-10-05T18:00:00")
    assert df.first().start is None
    assert df.select(alerts.status(df, START)).first()[0] == "unknown"
    assert alerts.due(df, START, 30).count() == 0


def test_status(spark):
    df = windows(spark)
    at = {START: "high", END: "high", END + 1: "late", START - 3 * 86_400_000: "medium", START - 3 * 86_400_000 - 1: "low"}
    assert {n: df.select(alerts.status(df, n)).first()[0] for n in at} == at


@pytest.mark.parametrize("flags,settings", [({"completed": True}, {}), ({"muted": True}, {}), ({}, {"favorites_only": True}), ({}, {"enabled": False})])
def test_suppression(spark, flags, settings):
    assert alerts.due(windows(spark, **flags), START, 30, **settings).count() == 0


DAY = "world string, boss_name string, resolution string, source_status string, last_date string, start long, end long, completed boolean, muted boolean, favorite boolean"


@pytest.mark.parametrize("clock,due", [("17:29:59", False), ("17:30:00", True), ("18:00:00", True), ("18:00:01", False)])
def test_rounds_of_daily_predictions(spark, clock, due):
    h, m, s = map(int, clock.split(":"))
    now = START + ((h - 18) * 3600 + m * 60 + s) * 1000
    df = spark.createDataFrame([("W", "B", "day", "quente", "01/10/2026", None, None, None, None, None), ("W", "C", "day", "inicial", "", None, None, None, None, None)], DAY)
    rows = alerts.due(df, now, 30, check_time="18:00").collect()
    assert [(r.boss_name, r.kind) for r in rows] == ([("B", "round")] if due else [])
    assert [r.kind for r in alerts.due(df, now).collect()] == ["daily"]


def test_unsent_pairs(spark):
    due = alerts.due(windows(spark), START, 30)
    subscriptions = spark.createDataFrame([("e1",), ("e2",), ("e1",)], "endpoint string")
    sent = spark.createDataFrame([], "alert_key array<string>, endpoint string")
    first = alerts.unsent(due, subscriptions, sent)
    assert first.count() == 2 and alerts.unsent(due, subscriptions, first).count() == 0
    with pytest.raises(ValueError):
        alerts.unsent(due, spark.range(21).select(F.col("id").cast("string").alias("endpoint")), sent)


def test_endpoints(spark):
    urls = {"https://fcm.googleapis.com/a": True, "https://127.0.0.1/a": False, "https://fcm.googleapis.com.evil.com/": False, "https://u:p@fcm.googleapis.com/": False, "http://fcm.googleapis.com/": False, "https://x.notify.windows.com/": True, "not a url": False}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.ok for r in df.select("u", alerts.allowed_endpoint(F.col("u")).alias("ok")).collect()} == urls


def test_official_counts(spark):
    bosses = spark.createDataFrame([("Fernfang",), ("Maw",), ("Bad",)], "name string")
    entries = spark.createDataFrame([("FERNFANG", 9.0, 9.0, 0), ("fern-fang", 0.0, 1.0, 1), ("bad", -1.0, 2.0, 2)], "race_name string, day double, week double, seq int")
    none = spark.createDataFrame([], "boss_name string")
    rows = {r.name: (r.day, r.week, r.covered, r.additional) for r in catalog.merge_counts(bosses, entries, none).collect()}
    assert rows == {"Fernfang": (0, 1, True, True), "Maw": (None, None, False, False), "Bad": (None, None, False, False)}
    assert tuple(catalog.coverage(catalog.merge_counts(bosses, entries, none)).first()) == (1, 1)
    counts = spark.createDataFrame([("W", 1000, "Fernfang", 0, 1), ("W", 2000, "Fernfang", 1, 2), ("W", 2000, "Maw", 1, 1), ("W", 3_602_001, "Fernfang", 9, 9)], "world string, at long, boss string, day int, week int")
    grown = {(r.boss, r.at): (r.increase, r.since) for r in snapshots.increases(counts).collect()}
    assert grown == {("Fernfang", 1000): (False, None), ("Fernfang", 2000): (True, 1000), ("Maw", 2000): (False, None), ("Fernfang", 3_602_001): (False, None)}


def test_public_history(spark):
    kills = "array<struct<date:string,approx:boolean>>"
    records = spark.createDataFrame(
        [("Diblis The Fair", "quente", "01/10/2026 (aprox)", None, "", "3", "14", [], 0), ("New", "fora", "", "02", "x", None, None, [("d", True), ("d", False), (None, True)], 1), ("new", "fora", "", None, "x", None, None, [("e", None)], 2)],
        f"boss string, status_key string, txt_date string, last_date string, window_txt string, window_min string, window_max string, last_kills {kills}, seq int",
    )
    catalogue = spark.createDataFrame([("Diblis the Fair", 0)], "name string, seq int")
    named = catalog.name_records(records, catalogue)
    rows = {r.boss_name: r for r in catalog.predictions(named, "W").where("boss_name <> 'new'").collect()}
    assert (rows["Diblis the Fair"].last_date, rows["Diblis the Fair"].window_text) == ("01/10/2026 (aprox)", "3-14")
    assert (rows["New"].last_date, rows["New"].window_text) == ("02", "x")
    past = {r.boss_name: (r.date, r.approximate, r.raw_records) for r in catalog.history(named, "W").collect()}
    assert past == {"New": ("d", False, 3), "new": ("e", False, 1)}
    assert sorted((r.name, r.appended) for r in catalog.catalogue_with_history(catalogue, named).collect()) == [("Diblis the Fair", False), ("New", True), ("new", True)]
    assert [r.f for r in spark.createDataFrame([('05/10/2026 13:05',), ('01/10/2026',), (None,)], 's string').select(catalog.fresh_stamp(F.col('s'), START).alias('f')).collect()] == [True, False, False]


def test_history_rows_are_unique(spark):
    rows = [("A", "2026-01-01", i, "x") for i in range(28)] + [("B", "2026-01-01", 50, "y"), (None, None, 1, "z")]
    found = catalog.unique_history(spark.createDataFrame(rows, "world string, date string, seq int, v string"), "seq").collect()
    assert sorted((r.world, r.seq, r.first_seq) for r in found) == [("A", 27, 0), ("B", 50, 50)]


def test_completion(spark):
    entries = spark.createDataFrame([("Dharalion", 5, "Nemesis", 0), ("Feroxa (Mortal)", 5, "Bestiary", 1), ("Midnight Panther", 5, "Bestiary", 2)], "name string, target int, category string, seq int")
    rows = [("Dharalion", 1, None, None, True, None, None), ("dharálion", 5, None, None, True, None, None), ("Unknown", 9, 1, None, True, None, None), ("Feroxa", 4, None, None, True, None, None), ("Other", None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "name string, kills int, target int, target_confirmed boolean, known boolean, favorite boolean, muted boolean")
    found = {r.name: (r.target, r.completed, r.category, r.known) for r in progress.resolved(df, entries).collect()}
    assert found == {"Dharalion": (5, False, "Nemesis", True), "dharálion": (5, True, "Nemesis", True), "Unknown": (1, False, None, True), "Feroxa": (5, False, "Bestiary", True), "Other": (1, False, None, False)}
    kills, target = progress.stored(F.lit("-3.7"), F.lit(None).cast("int"))
    assert tuple(spark.range(1).select(kills, target).first()) == (0, 100)


def test_ledger(spark):
    steps = [("check", "c1", "A", True), ("check", "c1", "A", True), ("check", "c2", "A", True), ("undo", "c1"), ("undo", "c2"), ("undo", "c1"), ("undo", "c1"), ("undo", "none"), ("check", "c1", "A", True), ("check", "n1", "A", False), ("undo", "n1"), ("set", None, "B", None, 7), ("check", "c3", "B", True), ("set", None, "B", None, 3), ("undo", "c3")]
    rows = [("u", i, *s, *[None] * (5 - len(s))) for i, s in enumerate(steps)] + [(None, 0, "check", "c1", "A", True, None), ("v", 0, "undo", "c1", None, None, None)]
    df = spark.createDataFrame(rows, "user string, seq int, action string, id string, boss string, counts boolean, kills int")
    found = {(r.user, r.boss): tuple(r)[2:] for r in ledger(df).collect()}
    assert found == {("u", "A"): (1, True, 3, 2, 1, 1), ("u", "B"): (3, True, 1, 0, 1, 0), (None, "A"): (1, True, 1, 0, 0, 0)}
    assert ledger(df.limit(0)).count() == 0


def test_lists_after_a_refusal(spark):
    lists = spark.createDataFrame([(f"c{i}", i, "HTTP 429" if i == 1 else None) for i in range(7)], "category string, place int, error string")
    assert {r.category: r.error for r in rankings.after_refusal(lists).collect()} == {"c0": None, "c1": "HTTP 429", "c2": None, **{f"c{i}": "not fetched" for i in range(3, 7)}}
    assert rankings.after_refusal(lists.where("place <> 1")).where("error IS NOT NULL").count() == 0


def test_rankings_and_lists(spark):
    lists = spark.createDataFrame([("magic", None), ("shielding", None), ("fishing", "HTTP 429")], "category string, error string")
    players = spark.createDataFrame([("magic", "Outro Char", 3, 100, 0), ("magic", "outro char", 9, 1, 1)], "category string, name string, rank long, value long, seq int")
    rows = {r.category: (r.status, r.value, r.total_listed) for r in rankings.look_up(lists, players, ["outro char"]).collect()}
    assert rows == {"magic": ("found", 100, 2), "shielding": ("not-listed", None, 0), "fishing": ("unavailable", None, 0)}
    df = spark.createDataFrame([("b", "low", False), ("a", "high", False), ("c", "high", True), ("d", "late", True)], "name string, status string, favorite boolean")
    df = df.selectExpr("*", "false AS muted", "false AS known", "false AS completed", "name = 'd' AS hidden")
    assert [r.name for r in progress.radar(df).collect()] == ["c", "a", "b"]
    assert [r.name for r in progress.radar(df, "A", "soon").collect()] == ["a"]


def walked(times, spacing):
    out = []
    for g in {x for x, _ in times}:
        last = None
        for t in sorted(t for x, t in times if x == g and t is not None):
            if last is None or t - last >= spacing:
                out.append((g, t))
                last = t
    return sorted(out, key=str)


@pytest.mark.parametrize("leaf,fan", [(128, 128), (1, 2), (3, 2)])
def test_thinning_matches_a_plain_walk(spark, monkeypatch, leaf, fan):
    import random

    monkeypatch.setattr(snapshots, "LEAF", leaf)
    monkeypatch.setattr(snapshots, "FAN", fan)
    rng = random.Random(3)
    times = [("g", rng.randrange(-2000, 3000)) for _ in range(900)] + [("h", 10 * i) for i in range(300)] * 2 + [("i", None), (None, 7), (None, 50)]
    found = [(r.world, r.at) for r in snapshots.thinned(spark.createDataFrame(times, "world string, at long"), spacing=37).collect()]
    assert sorted(found, key=str) == walked(times, 37)
    assert snapshots.thinned(spark.createDataFrame([], "world string, at long")).count() == 0


def test_a_group_without_pauses_is_thinned_in_pieces(spark):
    times = spark.range(1_000_000).select(F.lit("w").alias("world"), (F.col("id") * 60_000).alias("at"))
    kept = snapshots.thinned(times)
    assert kept.count() == 250_000 and kept.where(F.col("at") % 240_000 != 0).count() == 0


def test_dates(spark):
    row = spark.range(1).select(valid_date(F.lit("2026-02-30")), valid_date(F.lit("2026-02-28")), valid_date(F.lit(None).cast("string")), local_date(F.lit(1_791_241_200_000 + 4 * 3_600_000)).cast("string"), at_local(F.lit("2026-10-05"), F.lit("")), hour_bucket(F.lit(11))).first()
    assert tuple(row) == (False, True, False, "2026-10-06", 1_791_212_400_000, 3)

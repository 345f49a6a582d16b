import base64

import pytest
from pyspark.sql import functions as F

from wayglass.operators import catalog, settings
from wayglass.operators import observations as O

PROGRESS = "map<string, struct<kills: double, target: double, known: boolean, target_confirmed: boolean, favorite: boolean, muted: boolean>>"


def entry(kills=None, target=None, known=None):
    return (kills, target, known, None, None, None)


def test_settings(spark):
    good = ("Lunarian", 30, "18:00", {"A": entry(1.0)})
    cases = [(good, None), ((None, None, None, None), None), (("Nowhere", *good[1:]), "world"), (("Bellum", 4, *good[2:]), "lead_minutes"), (("Bellum", 30, "24:00", None), "check_time"), (("Bellum", 30, "", {"x" * 121: entry()}), "boss"), (("Bellum", 30, "", {"constructor": entry()}), "boss"), (("Bellum", 30, "", {"A": None}), "boss")]
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], f"i int, world string, lead_minutes int, check_time string, progress {PROGRESS}")
    found = {r.i: r.e for r in df.select("i", settings.settings_error(df).alias("e")).collect()}
    assert found == {i: e for i, (_, e) in enumerate(cases)}


def test_progress_as_rows_and_back(spark):
    df = spark.createDataFrame([("u", {"A": entry(-3.0, None, None), "B": entry(2e9, 0.5, False)})], f"user string, progress {PROGRESS}")
    rows = settings.progress_rows(df)
    assert {r.name: (r.kills, r.target, r.known, r.muted) for r in rows.collect()} == {"A": (0, 100, True, False), "B": (100000, 100, False, False)}
    back = settings.progress_map(rows).first().progress
    assert back["A"].target == 100 and set(back) == {"A", "B"}


def test_rounds_images_and_room(spark):
    stored = spark.createDataFrame([("b", "W", 1, "X", "vazio"), ("b", "W", 0, "Y", "vazio"), ("a", "W", 5, "Z", "vazio")], "batch_id string, world string, seq int, boss string, result string")
    assert [(r.batch_id, r.rows, r.bosses) for r in O.rounds(stored).collect()] == [("b", 2, ["Y", "X"]), ("a", 1, ["Z"])]
    assert O.rounds(stored, 1).count() == 1
    images = spark.createDataFrame([("i1", "m1"), ("i2", "m2"), ("i3", "m3")], "id string, message_id string")
    told = spark.createDataFrame([("m1", ["A"], 5)], "id string, bosses array<string>, at long")
    waits = spark.createDataFrame([("m2", ["B"], "2026-10-05", ""), ("m1", ["C"], "2026-10-05", "")], "id string, bosses array<string>, date string, time string")
    assert {r.id: (r.bosses, r.at) for r in O.image_rows(images, told, waits).collect()} == {"i1": (["A"], 5), "i2": (["B"], 1_791_212_400_000), "i3": ([], 0)}
    with pytest.raises(ValueError):
        O.require_room(stored, stored, 5)
    assert O.require_room(stored, stored, 6).count() == 3


def test_image_types_and_first_predictions(spark):
    url = lambda kind, raw: f"data:image/{kind};base64," + base64.b64encode(raw).decode()
    png = b"\x89PNG\r\n\x1a\n" + b"0" * 20
    cases = {url("png", png): "png", url("jpeg", png): None, url("jpeg", b"\xff\xd8\xff" + b"0" * 20): "jpeg", url("webp", b"RIFF0000WEBP" + b"0" * 9): "webp", "data:image/png;base64,@@": None, "x": None}
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    assert {r.u: r.t for r in df.select("u", O.image_type(F.col("u")).alias("t")).collect()} == cases
    bosses = spark.createDataFrame([("A",), ("B",)], "name string")
    predicted = spark.createDataFrame([("A", 2, "late"), ("A", 1, "high")], "boss_name string, seq int, status string")
    rows = {r.name: r.prediction and r.prediction.status for r in catalog.with_first_prediction(bosses, predicted).collect()}
    assert rows == {"A": "high", "B": None}

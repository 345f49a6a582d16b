from wayglass.functions.numbers import clamp, percent, wilson
from wayglass.operators import patterns
from pyspark.sql import functions as F

SCHEMA = "boss string, world string, day string, bucket int, found boolean, favorable string, at long, seq long"


def check(day, hour, found, seq, world="Lunarian", favorable="yes"):
    return ("Dharalion", world, day, None if hour is None else hour // 3, found, favorable, 1, seq)


def only(spark, rows):
    return patterns.find(spark.createDataFrame(rows, SCHEMA)).collect()


def test_reports_of_one_block_collapse(spark):
    (row,) = only(spark, [check("2026-09-01", 9, False, 0), check("2026-09-01", 9, False, 1), check("2026-09-01", 10, True, 2)])
    assert (row.total, row.found, row.days, row.recommended, row.start) == (1, 1, 1, None, None)
    assert (row.favorable_total, row.favorable_found, row.unfavorable_total) == (1, 1, 0)


def test_comparative_evidence_is_needed(spark):
    days = [f"2026-09-{d:02d}" for d in range(1, 16)]
    morning = [check(d, 9, True, 2 * i) for i, d in enumerate(days)]
    evening = [check(d, 18, False, 2 * i + 1) for i, d in enumerate(days)]
    (row,) = only(spark, morning + evening)
    assert (row.start, row.total, row.days) == (9, 30, 15)
    (alone,) = only(spark, morning)
    assert alone.recommended is None


def test_worlds_are_apart_and_no_time_fills_no_bucket(spark):
    rows = only(spark, [check("2026-09-01", None, True, 0), check("2026-09-01", 9, True, 1, world="Auroria")])
    by = {r.world: r for r in rows}
    assert sum(h.total for h in by["Lunarian"].hours) == 0 and by["Lunarian"].total == 1
    assert sum(h.total for h in by["Auroria"].hours) == 1


def test_day_is_spoken_for_by_last_sighting_else_first_report(spark):
    rows = [check("d", 1, False, 0, favorable="no"), check("d", 4, False, 1), check("e", 1, True, 2, favorable="no"), check("e", 2, True, 3), check("e", 9, False, 4, favorable="no")]
    (row,) = only(spark, rows)
    assert (row.favorable_total, row.favorable_found, row.unfavorable_total, row.unfavorable_found) == (1, 1, 1, 0)


def test_last_seen_takes_first_report_at_a_tie(spark):
    rows = [("B", "W", "d", 1, True, "yes", 5, 3), ("B", "W", "d", 2, True, "no", 5, 1), ("B", "W", "d", 3, False, "no", 9, 2)]
    (row,) = patterns.last_seen(spark.createDataFrame(rows, SCHEMA)).collect()
    assert (row.at, row.seq) == (5, 1)


def test_empty_and_order(spark):
    assert only(spark, []) == []
    rows = [(b, "W", f"d{i}", 1, False, "yes", 1, i) for b, n in (("Zed", 2), ("ábaco", 1), ("Aa", 1)) for i in range(n)]
    found = patterns.ranked(patterns.find(spark.createDataFrame(rows, SCHEMA))).collect()
    assert [r.boss for r in found] == ["Zed", "Aa", "ábaco"]


def test_numbers(spark):
    low, high = wilson(F.lit(15), F.lit(15))
    zero = wilson(F.lit(0), F.lit(0))
    row = spark.range(1).select(low, high, *zero, percent(F.lit(3), F.lit(2)), percent(F.lit(1), F.lit(0)), clamp(F.lit(9), 1, 5), clamp(F.lit(None).cast("int"), 1, 5)).first()
    assert abs(row[0] - 0.7961) < 1e-3 and row[1] == 1.0
    assert tuple(row[2:]) == (0.0, 1.0, 100.0, 0.0, 5, None)

"""Ledgers by pieces against a plain walk over all actions."""

import random

import pytest
from pyspark.sql import functions as F

from wayglass.operators.ledger import ledger, summed

SCHEMA = "user string, seq long, action string, id long, boss string, counts boolean, kills int, extra string"


def plain(rows, limit):
    """Every action of every user one after the other, as the rules have it."""
    users = {}
    for user, _, action, number, boss, counts, kills, _ in sorted(rows, key=lambda r: r[1]):
        bosses, recorded = users.setdefault(user, ({}, {}))
        fresh = [0, False, 0, 0, 0, 0]
        if action == "set":
            b = bosses.setdefault(boss, fresh)
            b[0], b[1] = kills, True
        if action == "check" and number in recorded:
            bosses.setdefault(recorded[number][0], fresh)[5] += 1
        elif action == "check":
            before = bosses.get(boss, fresh)
            recorded[number] = (boss, counts, before[0], before[1])
            if counts:
                b = bosses.setdefault(boss, fresh)
                b[0], b[1], b[2] = b[0] + 1, True, b[2] + 1
            if len(recorded) > limit:
                del recorded[next(iter(recorded))]
        elif action == "undo" and number in recorded:
            boss, counted, kills, known = recorded[number]
            b = bosses.setdefault(boss, fresh)
            if counted and b[0] != kills + 1:
                b[4] += 1
                continue
            if counted:
                b[0], b[1], b[3] = kills, known, b[3] + 1
            del recorded[number]
    return {(user, boss): tuple(b) for user, (bosses, _) in users.items() for boss, b in bosses.items()}


def actions(seed, n, ids, sets):
    """Checks, undos of new and old ids, repeats, sets and unknown actions of two users and of no user."""
    draw = random.Random(seed)
    rows, made = [], []
    for seq in range(n):
        user, boss = draw.choice(["u", "u", "v", None]), draw.choice(["A", "B", None])
        kind = draw.random()
        if kind < sets:
            rows.append((user, seq, "set", None, boss, None, draw.randrange(4), "x"))
        elif kind < 0.5 or not made:
            made.append((user, draw.choice([seq + 1000, draw.randrange(ids)])))
            rows.append((user, seq, "check", made[-1][1], boss, draw.random() < 0.8, None, None))
        else:
            user, number = draw.choice(made[-3:]) if draw.random() < 0.7 else draw.choice(made)
            rows.append((user, seq, draw.choice(["undo", "undo", "check", "look"]), number if draw.random() < 0.95 else None, boss, True, None, None))
    return rows


def found(df, **kw):
    return {(r.user, r.boss): (r.kills, r.known, r.made, r.undone, r.conflicts, r.repeated) for r in ledger(df, **kw).collect()}


@pytest.mark.parametrize(("ids", "sets", "limit", "piece"), [(5, 0.1, 3, 4), (40, 0.0, 2, 50), (400, 0.02, 5, 1000), (400, 0.0, 1, 30), (40, 0.05, 2000, 1)])
def test_pieces_give_what_a_plain_walk_gives(spark, ids, sets, limit, piece):
    for seed in range(2):
        rows = actions(seed, 600, ids, sets)
        assert found(spark.createDataFrame(rows, SCHEMA), limit=limit, piece=piece) == plain(rows, limit)


def test_one_user_of_many_actions_is_no_single_task(spark):
    """Records and undoes of one user: nearly all is summed up by tasks of its parts, and few rows are walked."""
    n = 300_000
    seq = F.col("id")
    late = (seq % 10 == 9).cast("int")  # takes the check before back
    far = seq == n - 1  # takes back one of an earlier piece: forgotten by then
    rows = spark.range(n).select(
        F.lit("u").alias("user"), seq.alias("seq"), F.when((late == 1) | far, "undo").otherwise("check").alias("action"), F.when(far, 7).otherwise(seq - late).alias("id"),
        F.concat(F.lit("B"), (seq - late).cast("string").substr(-1, 1)).alias("boss"), F.lit(True).alias("counts"), F.lit(None).cast("int").alias("kills"), F.lit("").alias("extra"),
    )
    given = rows.select(F.col("user").alias("key"), "seq", "action", "id", "boss", "counts", F.col("kills").cast("long"))
    left = summed(given, piece=20_000).withColumn("task", F.spark_partition_id())
    total, tasks = left.agg(F.count("*"), F.countDistinct("task")).first()
    assert total < 500 and tasks > 1
    walked = [tuple(r) for r in rows.collect()]
    assert found(rows, piece=20_000) == plain(walked, 2000)


def test_ledger_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ledger(none).count() == 0
    rows = [("u", 0, "check", 1, "A", None, None, "x"), ("u", 1, "undo", 1, None, None, None, "x"), ("u", 2, None, 1, "A", True, None, "x"), ("w", 0, "undo", 1, "A", True, None, "x"), (None, None, "check", None, None, True, None, "x")]
    assert found(spark.createDataFrame(rows, SCHEMA)) == {("u", "A"): (0, False, 0, 0, 0, 0), (None, None): (1, True, 1, 0, 0, 0)}
    clash = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({"extra": "key"}).withColumn("place", F.lit(1)).withColumn("times", F.lit(9))
    assert found(clash) == found(spark.createDataFrame(rows, SCHEMA))

"""Time-of-day patterns in sparse found/absent reports.

checks: world, boss, day (date), bucket (int, null without a time), found (boolean), favorable
(yes, no, unknown), at (ms), seq (place in the order of reports). Each day and bucket counts once, and a
sighting wins over absences. Every step is a grouped aggregate that combines before it shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayglass.functions.numbers import wilson

KEYS = ["world", "boss"]
BUCKETS = 8
HOURS = 24 // BUCKETS
#: What a bucket needs to be recommended: samples, days, sightings; others need the first two to be compared with.
MIN_TOTAL, MIN_DAYS, MIN_FOUND = 10, 5, 3


ANSWERS = ("no", "unknown", "yes")


def blocks(checks: DataFrame) -> DataFrame:
    """One row for each boss, day and bucket (null: a bucket of its own): found, and rep, which speaks for the day.

    The report that speaks for a day is its last sighting, else its first report. rep is one number, its place in that
    order with its answer and result behind it, so that the aggregate stays a hash aggregate.
    """
    order = F.when(F.col("found"), F.col("seq")).otherwise(-F.col("seq") - 1)
    answer = F.when(F.col("favorable") == "yes", 2).when(F.col("favorable") == "no", 0).otherwise(1)
    rep = order * 6 + answer * 2 + F.col("found").cast("int")
    return checks.groupBy(*KEYS, "day", "bucket").agg(F.max("found").alias("found"), F.max(rep).alias("rep"))


def days(checks: DataFrame) -> DataFrame:
    """One row for each boss and day: n and hits (blocks and sightings), the same by bucket (t0.., f0..), and favorable and sighted of the report that speaks for it."""
    hit = lambda b, more: F.sum(((F.col("bucket") == b) & more).cast("long"))
    by_bucket = [x for b in range(BUCKETS) for x in (F.coalesce(hit(b, F.lit(True)), F.lit(0)).alias(f"t{b}"), F.coalesce(hit(b, F.col("found")), F.lit(0)).alias(f"f{b}"))]
    grouped = blocks(checks).groupBy(*KEYS, "day").agg(F.count("*").alias("n"), F.sum(F.col("found").cast("long")).alias("hits"), F.max("rep").alias("rep"), *by_bucket)
    said = F.pmod(F.col("rep"), F.lit(6)).cast("int")
    answers = F.array(*map(F.lit, ANSWERS))
    return grouped.withColumn("favorable", F.get(answers, F.floor(said / 2).cast("int"))).withColumn("sighted", said % 2 == 1).drop("rep")


def totals(checks: DataFrame) -> DataFrame:
    """One row for each boss: total, found, days, favourable and other days, and hours (array of all buckets)."""
    return totals_of(days(checks))


def totals_of(day_rows: DataFrame) -> DataFrame:
    """totals() from the rows of days(), of which all are sums."""

    def split(answer: str) -> list[Column]:
        own = F.col("favorable") == answer
        name = {"yes": "favorable", "no": "unfavorable"}[answer]
        return [F.count_if(own).alias(f"{name}_total"), F.count_if(own & F.col("sighted")).alias(f"{name}_found")]

    summed = [x for b in range(BUCKETS) for x in (F.sum(f"t{b}").alias(f"t{b}"), F.sum(f"f{b}").alias(f"f{b}"), F.count_if(F.col(f"t{b}") > 0).alias(f"d{b}"))]
    grouped = day_rows.groupBy(*KEYS).agg(F.sum("n").alias("total"), F.sum("hits").alias("found"), F.count("*").alias("days"), *split("yes"), *split("no"), *summed)

    def hour(b: int) -> Column:
        low, high = wilson(F.col(f"f{b}"), F.col(f"t{b}"))
        return F.struct(F.lit(b).alias("bucket"), F.col(f"t{b}").alias("total"), F.col(f"f{b}").alias("found"), F.col(f"d{b}").alias("days"), low.alias("low"), high.alias("high"))

    return grouped.withColumn("hours", F.array(*[hour(b) for b in range(BUCKETS)])).drop(*[f"{x}{b}" for x in "tfd" for b in range(BUCKETS)])


def recommended(hours: Column) -> Column:
    """The first bucket of the best lower bound, if that is above the upper bound of every other compared one, and there is one."""
    compared = F.filter(hours, lambda h: (h["total"] >= MIN_TOTAL) & (h["days"] >= MIN_DAYS))
    able = F.filter(compared, lambda h: h["found"] >= MIN_FOUND)
    best = F.array_max(F.transform(able, lambda h: F.struct(h["low"].alias("low"), (-h["bucket"]).alias("order"))))
    others = F.filter(compared, lambda h: h["bucket"] != -best["order"])
    clear = (F.size(others) > 0) & F.forall(others, lambda h: best["low"] > h["high"])
    return F.when(best.isNotNull() & clear, F.get(hours, -best["order"]))


def find(checks: DataFrame) -> DataFrame:
    """totals() with recommended (a bucket of hours, or null) and start (its first hour)."""
    return find_of(days(checks))


def find_of(day_rows: DataFrame) -> DataFrame:
    """find() from the rows of days()."""
    return totals_of(day_rows).withColumn("recommended", recommended(F.col("hours"))).withColumn("start", F.col("recommended.bucket") * HOURS)


def ranked(found: DataFrame) -> DataFrame:
    """find() in order: recommended ones, then by total, then by name as people sort names."""
    return found.orderBy(F.col("recommended").isNull(), F.desc("total"), F.collate("boss", "UNICODE"))


def last_seen(checks: DataFrame) -> DataFrame:
    """The latest sighting of each boss; of several at one time, the first reported."""
    row = F.max_by(F.struct("at", "day", "bucket", "favorable", "seq"), F.struct(F.col("at"), -F.col("seq")))
    return checks.where("found").groupBy(*KEYS).agg(row.alias("last")).select(*KEYS, "last.*")

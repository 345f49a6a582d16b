"""The test tables seen as reports, snapshots and predictions, so that the operators have rows to work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayglass.functions.timing import hour_bucket

#: Times at which the queries look, in ms: 2 January 1996, 23:45, and 1 July 1996.
NIGHT, SUMMER = 820_626_300_000, 836_179_200_000
DAY = 86_400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts: Column) -> Column:
    """Milliseconds of a timestamp without a zone, whatever the session's zone."""
    clock = F.hour(ts) * 3_600_000 + F.minute(ts) * 60_000
    return F.unix_date(F.to_date(ts)).cast("long") * DAY + clock + (F.extract(F.lit("SECOND"), ts) * 1000).cast("long")


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as reports."""
    ts, hour, key = F.col("ts"), F.hour("ts"), F.col("event_id")
    found = (F.col("value") >= 50) | ((F.col("event_type") == "purchase") & hour.between(9, 11))
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("W"), (F.col("user_id") % 4).cast("string")).alias("world"),
        F.col("event_type").alias("boss"),
        F.to_date(ts).cast("string").alias("day"),
        F.when(key % 11 != 0, hour_bucket(hour)).alias("bucket"),
        found.alias("found"),
        F.when(key % 3 == 0, "yes").when(key % 3 == 1, "no").otherwise("unknown").alias("favorable"),
        millis(ts).alias("at"),
        key.alias("seq"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-hourly counts of events by world and type over the last day and week, as world, at, boss, day, week."""
    from pyspark.sql import Window

    half = (millis(F.col("ts")) / 1_800_000).cast("long")
    events = table(spark, sf_dir, "events").select(F.concat(F.lit("W"), (F.col("user_id") % 4).cast("string")).alias("world"), F.col("event_type").alias("boss"), half.alias("half"))
    each = events.groupBy("world", "boss", "half").agg(F.count("*").alias("n"))
    back = lambda n: F.sum("n").over(Window.partitionBy("world", "boss").orderBy("half").rangeBetween(1 - n, 0))
    return each.select("world", ((F.col("half") + 1) * 1_800_000).alias("at"), "boss", back(48).alias("day"), back(336).alias("week"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as windows of a day, with progress by customer."""
    customer = F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey"),
        F.col("o_orderpriority"),
        F.concat(F.lit("W"), (customer % 4).cast("string")).alias("world"),
        F.concat(F.lit("C"), customer.cast("string")).alias("boss_name"),
        millis(F.col("o_orderdate")).alias("start"),
        (millis(F.col("o_orderdate")) + DAY).alias("end"),
        (customer % 7 == 0).alias("completed"),
        (customer % 11 == 0).alias("muted"),
        (customer % 5 == 0).alias("favorite"),
        (customer % 3 != 0).alias("known"),
    )

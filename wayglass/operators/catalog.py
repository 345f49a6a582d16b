"""Catalogues merged with what providers say: official counts, public history, and the universe of known names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayglass.functions.text import canonical, plain_key
from wayglass.functions.timing import day_month_year, local_date

from .keyed import first_per_key

#: Calendar days by which a provider's stamp may be ahead or behind.
AHEAD, BEHIND = 1, 2


def merge_counts(catalogue: DataFrame, entries: DataFrame, predicted: DataFrame) -> DataFrame:
    """catalogue (name, ...) with day, week, covered and additional.

    entries: race_name, day, week, seq; names match by plain_key, and of several the last counts. Rows
    whose counts are not whole and at least 0 do not count: absent is null, never 0. additional: covered without a prediction.
    """
    keyed = entries.where(F.col("race_name").isNotNull()).withColumn("k", plain_key(F.col("race_name")))
    last = keyed.groupBy("k").agg(F.max_by(F.struct("day", "week"), F.col("seq")).alias("last"))
    whole = lambda c: (c >= 0) & (c == F.floor(c))
    good = last.where(whole(F.col("last.day")) & whole(F.col("last.week"))).select("k", F.col("last.day").cast("long").alias("day"), F.col("last.week").cast("long").alias("week"))
    known = predicted.select(F.col("boss_name").alias("name")).distinct().withColumn("predicted", F.lit(True))
    joined = catalogue.withColumn("k", plain_key(F.col("name"))).join(good, "k", "left").drop("k").join(known, "name", "left")
    covered = F.col("day").isNotNull()
    return joined.withColumn("covered", covered).withColumn("additional", covered & F.col("predicted").isNull()).drop("predicted")


def coverage(merged: DataFrame) -> DataFrame:
    """One row: coverage and additional_coverage of merge_counts()."""
    return merged.agg(F.count_if("covered").alias("coverage"), F.count_if("additional").alias("additional_coverage"))


def fresh_stamp(updated: Column, now: int) -> Column:
    """Whether a provider's stamp (dd/mm/yyyy ...) is of these days, by the local calendar; one that is no date is not."""
    age = F.datediff(local_date(F.lit(now)), day_month_year(updated))
    return F.coalesce(age.between(-AHEAD, BEHIND), F.lit(False))


def require_fresh(raw: DataFrame, now: int, updated: str = "updated") -> DataFrame:
    """raw, but an error at the first row whose stamp is not of these days."""
    return raw.where(F.when(fresh_stamp(F.col(updated), now), True).otherwise(F.raise_error(F.lit("stale data")).cast("boolean")))


def name_records(records: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Provider's records (boss, ...) with boss_name: the catalogue's name of that key (the last, if several), else their own."""
    names = first_per_key(catalogue.where("name IS NOT NULL").select(plain_key(F.col("name")).alias("k"), F.col("name").alias("known"), "seq"), ["k"], [F.desc("seq")]).select("k", "known")
    keyed = records.where("boss IS NOT NULL").withColumn("k", plain_key(F.col("boss")))
    return keyed.join(names, "k", "left").withColumn("boss_name", F.coalesce("known", "boss")).drop("k", "known")


def predictions(named: DataFrame, world: str) -> DataFrame:
    """Daily predictions of name_records(): status_key, txt_date or last_date, window_txt or window_min-window_max."""
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    return named.select(
        F.lit(world).alias("world"),
        "boss_name",
        F.lit("day").alias("resolution"),
        F.col("status_key").alias("source_status"),
        F.coalesce(filled("txt_date"), filled("last_date"), F.lit("")).alias("last_date"),
        F.coalesce(filled("window_txt"), F.concat_ws("-", F.col("window_min").cast("string"), F.col("window_max").cast("string"))).alias("window_text"),
    )


def history(named: DataFrame, world: str) -> DataFrame:
    """world, boss_name, date, approximate and raw_records, from last_kills (array of date, approx) of name_records() with seq.

    Of several records of a name only the last counts, and of several entries of a day the last.
    """
    last = named.groupBy("boss_name").agg(F.max_by("last_kills", "seq").alias("kills"))
    rows = last.select("boss_name", F.size(F.coalesce("kills", F.array())).alias("raw_records"), F.posexplode("kills").alias("place", "kill")).where("kill.date IS NOT NULL")
    each = rows.groupBy("boss_name", F.col("kill.date").alias("date")).agg(F.max_by(F.coalesce("kill.approx", F.lit(False)), "place").alias("approximate"), F.max("raw_records").alias("raw_records"))
    return each.select(F.lit(world).alias("world"), "boss_name", "date", "approximate", "raw_records")


def catalogue_with_history(catalogue: DataFrame, named: DataFrame) -> DataFrame:
    """name of every boss of the catalogue or of the records (appended), and whether it is new."""
    own = catalogue.select("name").distinct()
    new = named.select(F.col("boss_name").alias("name")).distinct().join(own, "name", "left_anti")
    return own.withColumn("appended", F.lit(False)).unionByName(new.withColumn("appended", F.lit(True)))


def unique_history(rows: DataFrame, order: str, keep: str = "first_seq") -> DataFrame:
    """History (world, date, ...) with one row a world and day: the last by order, and keep: the place of the first. Rows without a day go."""
    rest = [c for c in rows.columns if c not in ("world", "date")]
    kept = rows.where("date IS NOT NULL").groupBy(F.coalesce("world", F.lit("")).alias("world"), "date")
    return kept.agg(F.max_by(F.struct(*rest), F.col(order)).alias("row"), F.min(order).alias(keep)).select("world", "date", "row.*", keep)


def universe(sources: list[DataFrame], rank: str = "source") -> DataFrame:
    """Names of several sources, each once, as the first source that has it gives them (all its columns, which are the same)."""
    tagged = reduce(DataFrame.unionByName, [s.withColumn(rank, F.lit(i)) for i, s in enumerate(sources)])
    rest = [c for c in tagged.columns if c != "name"]
    return tagged.groupBy("name").agg(F.min_by(F.struct(*rest), F.struct(rank, *[c for c in rest if c != rank])).alias("row")).select("name", "row.*")


def entry_key(name):
    """Key of a name in the completion table, where one name stands under another."""
    key = canonical(name)
    return F.when(key == "feroxa", "feroxamortal").otherwise(key)


def with_entries(bosses: DataFrame, entries: DataFrame) -> DataFrame:
    """bosses (name, ...) with entry_target and entry_category of the first entry (name, target, category, seq) of its key."""
    first = first_per_key(entries.select(canonical(F.col("name")).alias("k"), F.col("target").alias("entry_target"), F.col("category").alias("entry_category"), "seq"), ["k"], [F.asc("seq")]).drop("seq")
    return bosses.withColumn("k", entry_key(F.col("name"))).join(first, "k", "left").drop("k")


def with_first_prediction(bosses: DataFrame, predicted: DataFrame) -> DataFrame:
    """bosses (name, ...) with prediction, the first row (by seq) of predicted (boss_name, seq, ...) for the name, as a struct."""
    rest = [c for c in predicted.columns if c not in ("boss_name", "seq")]
    first = predicted.groupBy(F.col("boss_name").alias("name")).agg(F.min_by(F.struct(*rest), F.col("seq")).alias("prediction"))
    return bosses.join(first, "name", "left")

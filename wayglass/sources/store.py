"""Reading providers' JSON and keeping state as tables: append, replace, merge, and texts stored in parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayglass.operators.order import placed

from .scratch import saved

HISTORY = """updated string, worlds map<string, struct<
  bosses: array<struct<boss: string, status_key: string, txt_date: string, last_date: string, window_txt: string, window_min: string, window_max: string, recorrencias: array<string>, last_kills: array<struct<date: string, approx: boolean>>>>,
  demonLords: array<struct<boss: string, status_key: string, txt_date: string, last_date: string, window_txt: string, window_min: string, window_max: string, recorrencias: array<string>, last_kills: array<struct<date: string, approx: boolean>>>>>>"""
COUNTS = "entries array<struct<race_name: string, creatures_killed_24h: double, creatures_killed_7d: double>>"
CATALOGUE = "name string, image_url string, locations array<struct<x: int, y: int, z: int>>"
RANKING = "category string, players array<struct<name: string, rank: bigint, value: bigint>>, cachedAt bigint, error string"


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue rows (JSON arrays) that have a name, with seq: by path of their file, then as they stand in it."""
    rows = spark.read.schema(CATALOGUE).json(path, multiLine=True).select(F.col("_metadata.file_path").alias("of"), "*")
    # A file is not split, so its rows' numbers within a partition are in its order.
    numbered = saved(rows.withColumn("place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "catalogue")
    sizes = numbered.groupBy("of").agg((F.max("place") + 1).alias("n"))
    starts = placed(sizes, [F.col("of")], "file")  # files in order, none of them in one task with all others
    return numbered.join(starts.select("of", "file"), "of").where("name IS NOT NULL").withColumn("seq", F.shiftleft(F.col("file") - 1, 33) + F.col("place")).drop("of", "file", "place")


def read_history(spark: SparkSession, path: str, world: str) -> DataFrame:
    """One row for each record of a world, bosses before demon lords: updated, seq and the record's fields."""
    raw = spark.read.schema(HISTORY).json(path, multiLine=True)
    own = raw.select("updated", F.try_element_at("worlds", F.lit(world.lower())).alias("w")).where("w IS NOT NULL AND w.bosses IS NOT NULL AND w.demonLords IS NOT NULL")
    return own.select("updated", F.posexplode(F.concat("w.bosses", "w.demonLords")).alias("seq", "r")).select("updated", "seq", "r.*").where("boss IS NOT NULL")


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """race_name, day, week and seq of official counts."""
    raw = spark.read.schema(COUNTS).json(path, multiLine=True)
    return raw.select(F.posexplode("entries").alias("seq", "e")).select("seq", "e.race_name", F.col("e.creatures_killed_24h").alias("day"), F.col("e.creatures_killed_7d").alias("week"))


def read_rankings(spark: SparkSession, paths: list[str], lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Lists (category, error) and players (category, name, rank, value, seq), from one list a file, or a line; what is not a list of players is an error of its category."""
    raw = spark.read.schema(RANKING).json(paths, multiLine=not lines)
    lists = raw.select("category", F.coalesce("error", F.when(F.col("players").isNull(), "unknown format")).alias("error"))
    players = raw.select("category", F.posexplode("players").alias("seq", "p")).select("category", "p.name", "p.rank", "p.value", "seq")
    return lists, players


# The fields of a player that may be kept.
PLAYER = (
    "name", "level", "vocation", "world", "sex", "residence", "lastlogin", "created", "comment",
    "account_created", "loyalty_points", "isHidden", "recentlyTraded", "guild", "house", "partner",
    "formerNames", "title", "auction", "looktype", "lookhead", "lookbody", "looklegs", "lookfeet",
    "lookaddons", "vip_time", "achievementPoints",
)
LISTS = ("deaths", "otherCharacters", "accountBadges", "displayedAchievements", "banHistory")


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profiles (one JSON object a file or line), as JSON text where a field is not plain: player (only the fields that may be kept), its lists ([] where absent) and banInfo."""
    player = ", ".join(f"{c}: string" for c in PLAYER)
    raw = spark.read.schema(f"asked string, player struct<{player}>, {', '.join(f'{c} string' for c in LISTS)}, banInfo string").json(path)
    lists = [F.when(F.col(c).startswith("["), F.col(c)).otherwise("[]").alias(c) for c in LISTS]
    return raw.select("asked", "player", *lists, "banInfo")


def save(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Keep an entity; readers of an earlier version of the same path must have ended."""
    rows.write.mode(mode).parquet(path)


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An entity as it is kept; empty where nothing is kept yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def export_json(rows: DataFrame, path: str, version: int = 1) -> None:
    """Rows as JSON lines, each with the version of the format."""
    rows.withColumn("version", F.lit(version)).write.mode("overwrite").json(path)


def import_json(spark: SparkSession, path: str, schema: str, version: int = 1) -> DataFrame:
    """Rows of an export; another version is an error."""
    rows = spark.read.schema(f"{schema}, version int").json(path)
    wrong = F.when(~F.coalesce(F.col("version") == version, F.lit(False)), F.raise_error(F.lit("unknown version")).cast("boolean")).otherwise(True)
    return rows.where(wrong).drop("version")


def merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; where both have one, the new columns that are not null go first."""
    rest = [c for c in old.columns if c != key]
    joined = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    return joined.select(F.coalesce(f"n.{key}", f"o.{key}").alias(key), *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in rest])


def split_parts(rows: DataFrame, key: str, content: str, size: int = 60_000) -> DataFrame:
    """key, part (from 0) and content (binary) in parts of size bytes; text is taken as UTF-8, and an empty content is one empty part."""
    held = rows.select(key, F.coalesce(F.col(content).cast("binary"), F.lit(b"")).alias("content"))
    count = F.greatest(F.lit(1), F.ceil(F.length("content") / size)).cast("int")
    parts = held.select(key, "content", F.explode(F.sequence(F.lit(0), count - 1)).alias("part"))
    return parts.select(key, "part", F.substring(F.col("content"), F.col("part") * size + 1, F.lit(size)).alias("content"))


def join_parts(parts: DataFrame, key: str) -> DataFrame:
    """key, parts (their number) and content (binary) put together again, in order of part. Text is content.cast("string")."""
    sorted_parts = F.array_sort(F.collect_list(F.struct("part", "content")))
    whole = F.unhex(F.array_join(F.transform(sorted_parts, lambda p: F.hex(p["content"])), ""))
    return parts.groupBy(key).agg(F.count("*").alias("parts"), whole.alias("content"))


def put_parts(stored: DataFrame, new: DataFrame, key: str, content: str, size: int = 60_000) -> DataFrame:
    """stored parts with those of new rows (key, content) in place of any of the same key."""
    kept = stored.join(new.select(key).distinct(), key, "left_anti")
    return kept.unionByName(split_parts(new, key, content, size).select(*stored.columns))


def rename_parts(stored: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """stored parts after one key took another's place: what had that name before goes."""
    return stored.where(F.col(key) != new).withColumn(key, F.when(F.col(key) == old, F.lit(new)).otherwise(F.col(key)))

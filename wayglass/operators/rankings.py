"""Rankings, character profiles and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayglass.functions.unicode import trimmed, units

MAX_LOCATIONS = 20
MAX_X = MAX_Y = 65_535
MAX_Z = 15
# Fixed value: how a page marks a place on the map.
MAP_PLACE = r'class="map_frame_coord"[^>]*>\s*(\d+,\d+,\d+):\d+'


def look_up(lists: DataFrame, players: DataFrame, names: list[str]) -> DataFrame:
    """One row for each list and asked name: status, value, rank and total_listed.

    lists: category, error; players: category, name, rank, value, seq. Names match without regard to case, and the
    first player counts. A list that could not be read is unavailable; who is missing from one is not-listed,
    with nulls and not zeros.
    """
    listed = players.groupBy("category").agg(F.count("*").alias("total_listed"))
    keyed = players.withColumn("k", F.lower("name"))
    found = keyed.where(F.col("k").isin(*{n.lower() for n in names})).groupBy("category", "k").agg(F.min_by(F.struct("value", "rank"), "seq").alias("hit"))
    asked = F.array(*map(F.lit, dict.fromkeys(names)))
    grid = lists.select("category", "error").join(listed, "category", "left").withColumn("name", F.explode(asked)).withColumn("k", F.lower("name"))
    joined = grid.join(found, ["category", "k"], "left")
    status = F.when(F.col("error").isNotNull(), "unavailable").when(F.col("hit").isNotNull(), "found").otherwise("not-listed")
    return joined.select("category", "name", status.alias("status"), "hit.value", "hit.rank", F.coalesce("total_listed", F.lit(0)).alias("total_listed"), "error")


def profiles(read: DataFrame) -> DataFrame:
    """store.read_profiles() with error: not-found where a profile is not that of the asked name; such a player and its lists are null."""
    own = F.coalesce(F.lower("player.name") == F.lower("asked"), F.lit(False))
    rest = [F.when(own, F.col(c)).alias(c) for c in read.columns if c != "asked"]
    return read.select("asked", *rest, F.when(~own, "not-found").alias("error"))


#: Lists that are fetched at once, what says that a provider wants no more, and what lists that were then not fetched have as error.
AT_ONCE, REFUSED, NOT_FETCHED = 3, "HTTP 429", "not fetched"


def after_refusal(lists: DataFrame) -> DataFrame:
    """lists (category, place from 0, error) as they stand when a provider refuses: those of later groups of AT_ONCE were not fetched."""
    group = F.floor(F.col("place") / AT_ONCE)
    refused = lists.where(F.col("error") == REFUSED).agg(F.min(group)).first()[0]
    return lists if refused is None else lists.withColumn("error", F.when(group > refused, NOT_FETCHED).otherwise(F.col("error")))


def valid_name(name: Column) -> Column:
    """Whether a character name may be looked up: 2 to 60 characters (UTF-16 units) when trimmed, and no control characters anywhere."""
    return F.coalesce(units(trimmed(name)).between(2, 60) & ~name.rlike(r"[\x00-\x1f]"), F.lit(False))


def first_distinct(pages: DataFrame, key: str, found: Column, cap: int | None = MAX_LOCATIONS) -> DataFrame:
    """key, place (from 1) and value of the first cap different values of an array column (None: of all), in order of first sight."""
    rows = pages.select(key, F.posexplode(F.array_distinct(found)).alias("at", "value"))
    return (rows if cap is None else rows.where(F.col("at") < cap)).select(key, (F.col("at") + 1).alias("place"), "value")


def locations(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Map places of pages: key, name ('Local n') and x, y, z, the first MAX_LOCATIONS different ones within bounds."""
    each = F.regexp_extract_all(F.col(html), F.lit(MAP_PLACE), 1)
    place = F.transform(F.transform(each, lambda c: F.split(c, ",")), lambda p: F.struct(*[p[i].try_cast("int").alias(n) for i, n in enumerate("xyz")]))
    inside = F.filter(place, lambda p: (p["x"] <= MAX_X) & (p["y"] <= MAX_Y) & (p["z"] <= MAX_Z))
    found = first_distinct(pages, key, inside)
    return found.select(key, F.concat(F.lit("Local "), F.col("place").cast("string")).alias("name"), "value.x", "value.y", "value.z")

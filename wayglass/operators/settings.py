"""Settings and saved progress: checks of what is offered, and maps as rows and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .progress import stored

# The worlds there are.
WORLDS = (
    "Auroria", "Belaria", "Bellum", "Drakaria", "Eldrian", "Elysian", "Infernum I", "Infernum II",
    "Infernum III", "Lunarian", "Malveria", "Mystian", "Obsidian", "Solarian", "Tenebrium", "Vesperia",
)
MAX_BOSSES, MAX_NAME = 1000, 120
FORBIDDEN = ("__proto__", "constructor", "prototype")


def settings_error(rows: DataFrame, worlds: tuple[str, ...] = WORLDS) -> Column:
    """What is wrong with offered settings (world, lead_minutes, check_time, progress map); null if nothing is. A null field is not offered."""
    given = lambda c: F.col(c).isNotNull()
    names = F.map_keys("progress")
    bad_name = F.exists(names, lambda n: (F.length(n) > MAX_NAME) | n.isin(*FORBIDDEN))
    return (
        F.when(given("world") & ~F.col("world").isin(*worlds), "world")
        .when(given("lead_minutes") & ~F.col("lead_minutes").between(5, 120), "lead_minutes")
        .when(given("check_time") & (F.col("check_time") != "") & ~F.col("check_time").rlike(r"^([01]\d|2[0-3]):[0-5]\d$"), "check_time")
        .when(given("progress") & (F.size("progress") > MAX_BOSSES), "progress")
        .when(given("progress") & (bad_name | F.exists(F.map_values("progress"), lambda v: v.isNull())), "boss")
    )


def progress_rows(rows: DataFrame, key: str = "user") -> DataFrame:
    """key, name, kills, target and flags of each entry of the progress map, as they are stored; known unless it says no."""
    each = rows.select(key, F.explode("progress").alias("name", "p"))
    kills, target = stored(F.col("p.kills"), F.col("p.target"))
    flag = lambda c: F.coalesce(F.col(f"p.{c}"), F.lit(False)).alias(c)
    return each.select(key, "name", kills.alias("kills"), target.alias("target"), F.coalesce("p.known", F.lit(True)).alias("known"), flag("target_confirmed"), flag("favorite"), flag("muted"))


def progress_map(rows: DataFrame, key: str = "user") -> DataFrame:
    """key and the progress map again, from one row a name."""
    entry = F.struct("name", F.struct(*[c for c in rows.columns if c not in (key, "name")]).alias("p"))
    return rows.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("progress"))

"""Progress toward targets: resolved state, lists and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayglass.functions.numbers import clamp, percent
from wayglass.functions.text import canonical

from .alerts import RANK
from .catalog import with_entries

# Stages of each category.
STAGES = {"Bane": (25, 100, 300), "Archfoe": (5, 20, 60), "Nemesis": (1, 3, 5), "Bestiary": (2, 3, 5)}
MAX_KILLS = 100_000
# Fixed value: a line of totals.
TOTALS_LINE = r"^(.+?)\s*[;=\t]\s*(\d+)\s*$"
DEFAULT_TARGET = 100


def stored(kills: Column, target: Column) -> tuple[Column, Column]:
    """kills and target as they are stored: whole, within 0 and 1 to MAX_KILLS; no target is DEFAULT_TARGET."""
    whole = lambda c: F.coalesce(c.cast("double"), F.lit(0.0)).cast("long")
    wanted = F.when(whole(target) == 0, DEFAULT_TARGET).otherwise(whole(target))
    return clamp(whole(kills), 0, MAX_KILLS), clamp(wanted, 1, MAX_KILLS)


def resolved(bosses: DataFrame, entries: DataFrame) -> DataFrame:
    """bosses (name, kills, target, target_confirmed, known, favorite, muted; nulls where nothing is saved) against the completion table.

    The table's target goes first; completed needs a known count and a target that the table or the user confirms.
    """
    joined = with_entries(bosses, entries)
    no = F.lit(False)
    kills = F.coalesce("kills", F.lit(0))
    target = F.coalesce("entry_target", F.when(F.col("target") > 0, F.col("target")), F.lit(1))
    known = F.coalesce("known", F.col("kills").isNotNull() | F.col("target").isNotNull())
    confirmed = F.col("entry_target").isNotNull() | F.coalesce("target_confirmed", no)
    return joined.select(
        "name",
        kills.alias("kills"),
        target.alias("target"),
        F.col("entry_category").alias("category"),
        known.alias("known"),
        (known & confirmed & (kills >= target)).alias("completed"),
        F.coalesce("favorite", no).alias("favorite"),
        F.coalesce("muted", no).alias("muted"),
        percent(kills, target).alias("percent"),
    )


def parse_totals(texts: DataFrame, names: DataFrame) -> DataFrame:
    """id, line (from 1), name, kills and error (null if the line is good) of texts (id, text) with 'Name; 3' on each line.

    Separators are ; = and tab. Errors: format, unknown, repeated, too-large; a text with any error is to be rejected as a whole.
    """
    lines = texts.select("id", F.posexplode(F.split(F.trim("text"), r"\r?\n")).alias("at", "raw")).withColumn("raw", F.trim("raw"))
    fields = lines.select("id", (F.col("at") + 1).alias("line"), F.regexp_extract("raw", TOTALS_LINE, 1).alias("said"), F.regexp_extract("raw", TOTALS_LINE, 2).alias("digits"))
    known = names.select(canonical(F.col("name")).alias("k"), "name").groupBy("k").agg(F.min("name").alias("name"))
    joined = fields.withColumn("k", canonical(F.col("said"))).join(known, "k", "left").drop("k")
    place = F.row_number().over(Window.partitionBy("id", "name").orderBy("line"))
    kills = F.when(F.col("digits") != "", F.col("digits").try_cast("bigint"))
    error = (
        F.when(F.col("digits") == "", "format")
        .when(F.col("name").isNull(), "unknown")
        .when(place > 1, "repeated")
        .when(kills.isNull() | (kills > MAX_KILLS), "too-large")
    )
    return joined.select("id", "line", "name", kills.alias("kills"), error.alias("error"))


def status_rank(status: Column) -> Column:
    """Order of statuses in lists."""
    out = F.lit(len(RANK))
    for name, rank in RANK.items():
        out = F.when(status == name, rank).otherwise(out)
    return out


def radar(bosses: DataFrame, query: str = "", show: str = "all") -> DataFrame:
    """bosses (name, status, favorite, muted, known, completed, hidden) that a list shows, in its order.

    show: all, high, soon (high or medium), favorites, missing (not completed) or unknown (no count).
    """
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    shown = {
        "all": F.lit(True),
        "high": F.col("status") == "high",
        "soon": F.col("status").isin("high", "medium"),
        "favorites": on("favorite"),
        "missing": ~on("completed"),
        "unknown": ~on("known"),
    }[show]
    named = F.contains(F.lower("name"), F.lit(query.lower()))
    return bosses.where(named & ~on("hidden") & shown).orderBy(status_rank(F.col("status")), F.desc("favorite"), F.collate("name", "UNICODE"), "name")


def progress_list(resolved_rows: DataFrame, show: str = "all") -> DataFrame:
    """resolved() in order of name: all, missing, started, complete, unfilled, or the name of a category."""
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    shown = {
        "all": F.lit(True),
        "missing": ~on("completed"),
        "started": (F.col("kills") > 0) & ~on("completed"),
        "complete": on("completed"),
        "unfilled": ~on("known"),
    }.get(show, F.col("category") == show)
    return resolved_rows.where(shown).orderBy(F.collate("name", "UNICODE"))


def counts(rows: DataFrame, *by: str) -> DataFrame:
    """high, total, completed and known of rows (status, completed, known), all or by group."""
    return rows.groupBy(*by).agg(F.count_if(F.col("status") == "high").alias("high"), F.count("*").alias("total"), F.count_if("completed").alias("completed"), F.count_if("known").alias("known"))


def with_patterns(bosses: DataFrame, found: DataFrame, world: str) -> DataFrame:
    """bosses (name, ...) with pattern, the row of patterns.find() for that name in a world, as a struct."""
    own = found.where(F.col("world") == world)
    return bosses.join(own.select(F.col("boss").alias("name"), F.struct(*[c for c in own.columns if c not in ("world", "boss")]).alias("pattern")), "name", "left")

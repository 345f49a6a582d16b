"""Places of rows in an order, without any task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayglass.sources.scratch import saved

from .progress import status_rank

_SPOT = "spot in order"


def placed(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """rows with their place (long, from 1) in an order, which should tell all rows apart.

    Rows are dealt out by ranges of the order and sorted within each; a range's first place is the number of rows in all
    ranges before it. Only these numbers, one for each range, meet in one task.
    """
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(_SPOT, F.monotonically_increasing_id())
    held = saved(sorted_rows, "ordered")  # the spots stand from here on
    part = F.shiftright(_SPOT, 33)
    sizes = held.groupBy(part.alias("range of order")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range of order").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("range of order", before.alias("rows before"))
    joined = held.withColumn("range of order", part).join(F.broadcast(starts), "range of order")  # as many rows as ranges
    return joined.select(*rows.columns, (F.col("rows before") + F.col(_SPOT).bitwiseAND((1 << 33) - 1) + 1).alias(name))


def first_placed(rows: DataFrame, order: list[Column], n: int, name: str = "place") -> DataFrame:
    """The first n rows of an order with their places; each task sends n rows on at most."""
    first = rows.orderBy(*order).limit(n)
    return first.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))  # n rows


def by_name(name: str) -> list[Column]:
    """As people sort names, and those that are alike in that by their letters."""
    return [F.collate(name, "UNICODE"), F.col(name)]


def pattern_order() -> list[Column]:
    """patterns.find() by world: recommended ones first, then by total, then by name."""
    return [F.col("world"), F.col("recommended").isNull(), F.desc("total"), *by_name("boss")]


def radar_order() -> list[Column]:
    """progress.radar(): by status, favourites first, by name."""
    return [status_rank(F.col("status")), F.desc("favorite"), *by_name("name")]


#: Reports of a world, images and messages to be read that a view of the state shows.
SHOWN_CHECKS, SHOWN_IMAGES, SHOWN_PENDING = 500, 100, 50


def shown(checks: DataFrame, images: DataFrame, pending: DataFrame, world: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a view shows of checks (world, seq), images (seq) and pending messages (seq): the newest of each, with places."""
    newest = [F.desc("seq")]
    return first_placed(checks.where(F.col("world") == world), newest, SHOWN_CHECKS), first_placed(images, newest, SHOWN_IMAGES), first_placed(pending, newest, SHOWN_PENDING)

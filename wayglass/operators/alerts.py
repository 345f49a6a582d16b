"""Prediction windows: their status at a given time, the alerts that are due, and those not sent yet.

The time is a parameter, in milliseconds; sessions run in UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayglass.functions.numbers import clamp
from wayglass.functions.timing import at_local, local_date

DAY = 86_400_000
MINUTE = 60_000
# Statuses of a daily prediction, as its provider calls them, and ours.
DAY_STATUS = {"quente": "high", "media": "medium", "inicial": "low", "fora": "late"}
RANK = {"high": 0, "medium": 1, "low": 2, "unknown": 3, "late": 4}
# Push services that may be called.
PUSH_HOSTS = ("fcm.googleapis.com", "updates.push.services.mozilla.com", "web.push.apple.com")
PUSH_SUFFIXES = (".notify.windows.com",)


def window_status(start: Column, end: Column, now: Column) -> Column:
    """Status of a window of instants (ms, both ends inside): null or reversed ends are unknown, up to three days before it is medium."""
    return (
        F.when(start.isNull() | end.isNull() | (end < start), "unknown")
        .when(now > end, "late")
        .when(now >= start, "high")
        .when(start - now <= 3 * DAY, "medium")
        .otherwise("low")
    )


def day_status(source: Column) -> Column:
    """Status of a daily prediction."""
    out = F.lit(None).cast("string")
    for theirs, ours in DAY_STATUS.items():
        out = F.when(source == theirs, ours).otherwise(out)
    return F.coalesce(out, F.lit("unknown"))


def status(predictions: DataFrame, now: int) -> Column:
    """Status of predictions: resolution 'day' by source_status, others by start and end (ms)."""
    by_window = window_status(F.col("start"), F.col("end"), F.lit(now))
    if "resolution" not in predictions.columns:
        return by_window
    return F.when(F.coalesce(F.col("resolution") == "day", F.lit(False)), day_status(F.col("source_status"))).otherwise(by_window)


def allowed(enabled: bool = True, favorites_only: bool = False) -> Column:
    """Whether a boss may raise alerts, by its completed, muted and favorite (null: false)."""
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    return F.lit(enabled) & ~on("completed") & ~on("muted") & (on("favorite") if favorites_only else F.lit(True))


def due(predictions: DataFrame, now: int, lead_minutes: int | None = 30, check_time: str = "", enabled: bool = True, favorites_only: bool = False) -> DataFrame:
    """predictions that are due, with kind, alert_key (array of strings) and starts (ms).

    predictions: world, boss_name, completed, muted, favorite and, for windows, start and end (ms) with their texts
    start_text and end_text (part of the key), or, with resolution 'day', source_status and
    last_date. A window is 'open' within its ends and 'soon' up to the lead before (held within 5
    to 120 minutes); both have one key. A day is due while its status is high: all day without a check_time, else
    from the lead (as it is; 0 counts as 30) before that time of the local day up to it.
    """
    minutes = lead_minutes or 30
    lead = clamp(F.lit(minutes), 5, 120) * MINUTE
    at = F.lit(now)
    start, end = F.col("start"), F.col("end")
    text = lambda c, other: F.col(c) if c in predictions.columns else F.col(other).cast("string")
    sound = start.isNotNull() & end.isNotNull() & (end >= start) & (at <= end)
    kind = F.when(sound & (at >= start), "open").when(sound & (at >= start - lead), "soon")
    key = F.array(F.col("world"), F.col("boss_name"), text("start_text", "start"), text("end_text", "end"), F.lit("window"))
    starts = start
    if "resolution" in predictions.columns:
        is_day = F.coalesce(F.col("resolution") == "day", F.lit(False))
        today = local_date(at).cast("string")
        hot = day_status(F.col("source_status")) == "high"
        if check_time:
            planned = at_local(today, F.lit(check_time))
            day_kind = F.when(hot & (at >= planned - minutes * MINUTE) & (at <= planned), "round")
            day_key, day_start = F.array(F.col("world"), F.col("boss_name"), F.col("last_date"), today, F.lit("round")), planned
        else:
            day_kind = F.when(hot, "daily")
            day_key, day_start = F.array(F.col("world"), F.col("boss_name"), F.col("last_date"), F.lit("daily")), F.lit(None).cast("long")
        kind, key, starts = F.when(is_day, day_kind).otherwise(kind), F.when(is_day, day_key).otherwise(key), F.when(is_day, day_start).otherwise(starts)
    return predictions.where(allowed(enabled, favorites_only)).withColumn("kind", kind).withColumn("alert_key", key).withColumn("starts", starts).where("kind IS NOT NULL")


#: Subscriptions that a service accepts.
MAX_SUBSCRIPTIONS = 20


def unsent(alerts: DataFrame, subscriptions: DataFrame, sent: DataFrame) -> DataFrame:
    """alert_key and endpoint of every due alert and subscription that are not in sent, once each.

    More than MAX_SUBSCRIPTIONS endpoints are an error, as where they are made.
    """
    endpoints = [r.endpoint for r in subscriptions.select("endpoint").distinct().limit(MAX_SUBSCRIPTIONS + 1).collect()]
    if len(endpoints) > MAX_SUBSCRIPTIONS:
        raise ValueError(f"more than {MAX_SUBSCRIPTIONS} subscriptions")
    all_of = F.array(*map(F.lit, sorted(endpoints))).cast("array<string>")
    pairs = alerts.select("alert_key").distinct().select("alert_key", F.explode(all_of).alias("endpoint"))
    return pairs.join(sent.select("alert_key", "endpoint"), ["alert_key", "endpoint"], "left_anti")


def allowed_endpoint(url: Column) -> Column:
    """Whether a push address is https, without credentials or port, and of a known push service."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    known = host.isin(*PUSH_HOSTS)
    for suffix in PUSH_SUFFIXES:
        known = known | host.endswith(suffix)
    plain = F.try_parse_url(url, F.lit("USERINFO")).isNull() & ~F.try_parse_url(url, F.lit("AUTHORITY")).rlike(":(?!443$)")
    return F.coalesce((F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & plain & known, F.lit(False))

"""Reports as streams: batches of chat messages that are stored as a whole or not at all, and patterns kept up through batches that come and go."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wayglass.functions.text import canonical
from wayglass.functions.timing import at_local
from wayglass.functions.unicode import longer
from wayglass.operators import observations, patterns
from wayglass.operators.keyed import first_per_key, not_stored
from wayglass.sources.scratch import drop_saved, saved

from .state import Store, hashed, run_stream

MESSAGES = "seq long, id string, text string, date string, time string, media boolean, mark_id string, mark_at long, coverage string"
CHECKS = "boss_key string, world string, boss string, date string, time string, result string, favorable string, origin string, at long, precision string, batch_id string"
PENDING = "id string, bosses array<string>, date string, time string, reason string, place long"
IDENTIFIED = "id string, bosses array<string>, at long, place long"
SEEN = "id string, place long"
REJECTED = "epoch long, reason string"
#: A mark may be this far ahead of the clock, and not before this time.
AHEAD, FIRST_MARK = 60_000, 1_577_836_800_000
_ONE = ["0"]


def sync_stream(
    source: DataFrame, names: DataFrame, world: str, worlds: list[str], now: int, path: str, checkpoint: str, every: str | None = None,
    max_batch: int = observations.MAX_BATCH, max_pending: int = observations.MAX_PENDING, max_checks: int = observations.MAX_CHECKS, keep: int = observations.MAX_KNOWN,
) -> StreamingQuery:
    """Store what batches of chat messages (MESSAGES; a micro-batch is one) report: all of a batch and its mark together, or nothing.

    A message that is not sound, too many of them, a mark that is none, or no room for what is new rejects the whole batch, which
    leaves a row in the log `rejected` and no other trace. Tables of the store: checks (each report once), pending (to be read by a person), identified
    and seen (the newest keep), and the commit's values mark (the latest, never back, and not by a batch with a gap) and checks (their number).
    A message that was seen is passed over. Of the tables but checks each is bounded and one part; of checks the parts of a batch's own keys are read.
    """

    def reason(batch: DataFrame) -> str | None:
        wrong = lambda c: F.count_if(~F.coalesce(c, F.lit(False)))
        mark = F.col("mark_id").isNull() | (F.col("mark_id").rlike("^[a-f0-9]{64}$") & F.col("mark_at").between(FIRST_MARK, now + AHEAD))
        told = batch.agg(F.count("id").alias("n"), wrong(F.col("id").isNull() | F.col("id").rlike("^[a-f0-9]{64}$")).alias("id"), wrong(F.col("id").isNull() | ~longer(F.col("text"), observations.MAX_MESSAGE)).alias("text"), wrong(mark).alias("mark")).first()
        return "size" if told.n > max_batch else next((c for c in ("id", "text", "mark") if told[c]), None)

    def step(batch: DataFrame, store: Store) -> dict:
        def reject(why: str) -> dict:
            store.add("rejected", batch.sparkSession.createDataFrame([(store.commit.seq + 1, why)], REJECTED))
            return {}

        if why := reason(batch):
            return reject(why)
        seen, pending, known = (store.table(n, s, _ONE) for n, s in (("seen", SEEN), ("pending", PENDING), ("identified", IDENTIFIED)))
        base = max(store.commit.values.get("place", 0), (store.commit.seq + 1) * 1_000_000)
        held = []  # written down, so that plans of what comes after stay small

        def keep_for_now(df: DataFrame) -> DataFrame:
            held.append(saved(df, "sync"))
            return held[-1]

        fresh = not_stored(first_per_key(batch.where("id IS NOT NULL"), ["id"], [F.asc("seq")]), seen, ["id"])
        in_order = fresh.repartitionByRange("seq", "id").sortWithinPartitions("seq", "id")
        messages = keep_for_now(in_order.withColumn("place", F.lit(base) + 1 + F.monotonically_increasing_id()).withColumn("said", F.sha2("text", 256)))
        none = F.lit(None).cast("string")
        texts = keep_for_now(messages.select(F.col("said").alias("id"), "text").distinct().withColumns({"date": none, "time": none}))  # one that comes again is read once
        read, state = observations.read_messages(texts, names, keep_for_now)
        state = keep_for_now(state)
        of_text = lambda df: df.withColumnRenamed("id", "said")
        stamped = of_text(read.withColumnsRenamed({"date": "said_date", "time": "said_time"}))
        rows = messages.select("place", "said", "date", "time").join(stamped, "said").withColumn("date", F.coalesce("said_date", "date")).withColumn("time", F.when(F.col("said_time") != "", F.col("said_time")).otherwise(F.coalesce("time", F.lit(""))))
        given = rows.select(F.col("place").alias("batch_id"), (F.col("line") * 1000 + F.col("part")).cast("long").alias("seq"), F.lit(world).alias("world"), "boss", "date", "time", "result", F.lit("unknown").alias("favorable"))
        checked = keep_for_now(observations.validated(given, names, worlds, now, "whatsapp").withColumnRenamed("batch_id", "place"))
        refused = checked.where(~F.col("batch_ok")).select("place").distinct().withColumn("refused", F.lit(True))
        key = ["world", "boss_key", "date", "time", "result"]
        part = hashed(*key)
        good = checked.where("batch_ok").withColumn("boss_key", canonical(F.col("boss")))
        firsts = keep_for_now(good.groupBy(*key, "boss", "favorable", "origin", "at", "precision").agg(F.min("place").alias("place")))  # a key is in a message once at most, and decides on the others
        parts = store.parts_of(firsts, part)
        old = store.table("checks", CHECKS, parts)
        new = keep_for_now(not_stored(firsts, old, key).join(messages.select("place", F.col("id").alias("batch_id")), "place").select(*old.columns))
        judged = messages.join(of_text(state), "said").join(refused, "place", "left").where("pending OR refused")
        waiting = keep_for_now(observations.review_rows(judged, "id", "place").select(*pending.columns))
        count = store.commit.values.get("checks", 0) + new.count()
        if count > max_checks or pending.count() + waiting.count() > max_pending:
            return reject("full")
        named = messages.join(of_text(observations.recognised(read, state)), "said").select("id", "bosses", F.coalesce(at_local(F.col("date"), F.col("time")), F.lit(0)).alias("at"), "place")
        places = known.select("id", F.col("place").alias("held"))  # one that is named again keeps its place
        named = named.join(places, "id", "left").withColumn("place", F.coalesce("held", "place")).drop("held")
        newest = lambda df: df.orderBy(F.desc("place")).limit(keep)
        store.put("checks", old.unionByName(new), part, parts)
        store.put("pending", pending.unionByName(waiting), F.lit("0"), _ONE)
        store.put("identified", newest(observations.upserted(known, named)), F.lit("0"), _ONE)
        store.put("seen", newest(seen.unionByName(messages.select("id", "place"))), F.lit("0"), _ONE)
        values = {"checks": count, "place": messages.agg(F.max("place")).first()[0] or base}
        for df in held:
            drop_saved(df)
        offered = batch.where("mark_id IS NOT NULL AND coalesce(coverage, '') <> 'gap'").agg(F.max_by(F.struct("mark_id", "mark_at"), F.struct("mark_at", "seq")).alias("m")).first().m
        mark = store.commit.values.get("mark")
        if offered and (mark is None or offered.mark_at >= mark["at"]):
            values["mark"] = {"id": offered.mark_id, "at": offered.mark_at}
        return values

    return run_stream(source, path, checkpoint, step, every)


REPORTS = "batch_id string, world string, boss string, day string, bucket int, found boolean, favorable string, at long, seq long"
_COUNTS = ", ".join(f"t{b} long, f{b} long" for b in range(patterns.BUCKETS))
DAYS = f"world string, boss string, day string, n long, hits long, {_COUNTS}, favorable string, sighted boolean, last struct<at: long, order: long, day: string, bucket: int, favorable: string, seq: long>"
_HOUR = "struct<bucket: int, total: long, found: long, days: long, low: double, high: double>"
PATTERNS = f"world string, boss string, total long, found long, days long, favorable_total long, favorable_found long, unfavorable_total long, unfavorable_found long, hours array<{_HOUR}>, recommended {_HOUR}, start int, last struct<at: long, order: long, day: string, bucket: int, favorable: string, seq: long>"
INDEX = "batch_id string, world string, boss string, day string"


def pattern_stream(source: DataFrame, path: str, checkpoint: str, every: str | None = None, seen=None) -> StreamingQuery:
    """Keep up patterns.find() and last_seen() through batches of reports that come and go, without counting anew what did not change.

    source: REPORTS with action (add or undo) and step (long, the order of actions). Within a micro-batch a batch's rows after its last undo count;
    a batch that is stored adds nothing, unless it was undone first. Tables of the store, each read and written in the parts of
    the keys at hand only: reports (by day and a share of bosses), index (batch to its days), days (patterns.days() with the day's last
    sighting, by boss) and patterns. A day is worked out anew from its own reports, so that an undone sighting
    gives an absence back; a boss from its days. Reports without world, boss or day count nowhere.
    """
    boss_share = hashed(*patterns.KEYS)
    report_part = F.concat_ws("_", F.coalesce(F.regexp_replace("day", "[^0-9-]", ""), F.lit("")), hashed(*patterns.KEYS, parts=8))
    place = ["world", "boss", "day"]

    def step(batch: DataFrame, store: Store) -> None:
        held = []

        def keep_for_now(df: DataFrame) -> DataFrame:
            held.append(saved(df, "patterns"))
            return held[-1]

        asked = keep_for_now(batch.groupBy("batch_id").agg(F.max(F.when(F.col("action") == "undo", F.col("step"))).alias("undone")))
        index_part = hashed("batch_id")
        index_parts = store.parts_of(asked, index_part)
        index = store.table("index", INDEX, index_parts)
        there = index.select("batch_id").distinct().withColumn("there", F.lit(True))
        state = asked.join(there, "batch_id", "left")
        gone = keep_for_now(state.where("there AND undone IS NOT NULL").select("batch_id"))
        open_ones = state.where("there IS NULL OR undone IS NOT NULL").select("batch_id", "undone")
        names = [f.split()[0] for f in REPORTS.split(", ")]
        new = keep_for_now(batch.where("action = 'add'").join(open_ones, "batch_id").where("undone IS NULL OR step > undone").where("world IS NOT NULL AND boss IS NOT NULL AND day IS NOT NULL").select(*names))
        old_places = index.join(gone, "batch_id", "left_semi").select(*place)
        touched = keep_for_now(old_places.unionByName(new.select(*place)).distinct())
        parts = store.parts_of(touched, report_part)
        reports = keep_for_now(store.table("reports", REPORTS, parts).join(gone, "batch_id", "left_anti").unionByName(new))
        own = reports.join(touched, place, "left_semi")
        sighting = F.struct("at", (-F.col("seq")).alias("order"), "day", "bucket", "favorable", "seq")
        last = own.where("found").groupBy(*place).agg(F.max(sighting).alias("last"))
        days = patterns.days(own).join(last, place, "left")
        shares = store.parts_of(touched, boss_share)
        all_days = keep_for_now(store.table("days", DAYS, shares).join(touched, place, "left_anti").unionByName(days))
        latest = all_days.groupBy(*patterns.KEYS).agg(F.max("last").alias("last"))
        found = patterns.find_of(all_days.drop("last")).join(latest, patterns.KEYS)
        cast = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in batch.sparkSession.createDataFrame([], PATTERNS).schema]
        store.put("reports", reports, report_part, parts)
        store.put("index", index.join(gone, "batch_id", "left_anti").unionByName(new.select("batch_id", *place).distinct()), index_part, index_parts)
        store.put("days", all_days, boss_share, shares)
        store.put("patterns", found.select(*cast), boss_share, shares)
        for df in held:
            drop_saved(df)

    return run_stream(source, path, checkpoint, step, every, seen)

"""Free-text reports into found/absent rows: reading lines, matching names, validating and storing once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayglass.functions.text import EMPTY, FOUND, canonical, fold, line_stamp, needs_review, result_of
from wayglass.functions.timing import at_local, local_date, valid_date
from wayglass.functions.unicode import WHITE, longer, trimmed

from .dictionary import mentions
from .keyed import first_per_key, not_stored

# Limits, short names, headings and the phrases that stand around a name.
MAX_TEXT, MAX_ROWS, MAX_MESSAGE, MAX_BATCH, MAX_CHECKS = 40_000, 200, 6_000, 100, 50_000
MAX_PENDING, MAX_IMAGES, MAX_KNOWN = 2_000, 2_000, 20_000
MAX_DATA_URL, MAX_IMAGE, MAX_BOSSES = 300_000, 220_000, 20
FIRST_DAY = "2020-01-01"
ALIASES = {"pantera": "Midnight Panther", "panther": "Midnight Panther", "murius": "General Murius", "cavebear": "Undead Cavebear", "crustacea": "Crustacea Gigantica"}
_NOT = "n[aãÃ]o (?:estavam?|encontrad[oa]s?|achei|encontrei)"
TAIL = rf"(?i)[{WHITE}]*(?:;|=|:|[{WHITE}])[{WHITE}]*(?:{_NOT}|vazio|ausente|presente|encontrado|estavam?)[{WHITE}]*\z"
HEAD = rf"(?i)\A(?:{_NOT}|ausentes?|vazios?|estavam?|encontrad[oa]s?|presentes?|achei|encontrei)[{WHITE}]*[:\-]?[{WHITE}]*"
HEADING = rf"(?i)\A(?:bosses?[{WHITE}]+)?(?:n[aãÃ]o estavam|n[aãÃ]o encontrados|ausentes|vazios|encontrados|presentes|estavam)[{WHITE}]*:?\z"
BULLET, PART = rf"\A[•*\-][{WHITE}]*", rf"[{WHITE}]*[,;][{WHITE}]*"
BLOCKED_GROUPS = ("dados do perfil", "profile details", "dados do contato", "contact info", "group info", "dados do grupo")


def name_keys(names: DataFrame) -> DataFrame:
    """k and boss: the first name (name, seq) of each canonical key."""
    return first_per_key(names.select(canonical(F.col("name")).alias("k"), F.col("name").alias("boss"), "seq"), ["k"], [F.asc("seq")]).select("k", "boss")


def match_key(text: Column) -> Column:
    """Canonical key of a name as reported, with short names written out."""
    key = canonical(text)
    out = key
    for short, name in ALIASES.items():
        out = F.when(key == short, canonical(F.lit(name))).otherwise(out)
    return out


def carried(lines: DataFrame, heading: str, within: list[str], order: str) -> Column:
    """The last heading at or before a line; null before the first. Windows hold one text's lines."""
    return F.last(heading, ignorenulls=True).over(Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def parse_reports(texts: DataFrame, names: DataFrame) -> DataFrame:
    """id, line, part, boss (empty where no name matches), text, result, date and time of every reported name.

    texts: id, text, date, time and default_result (the result before any heading; null where none is
    assumed). A heading sets the result of the lines below it and reports nothing itself; a line's own wording goes first.
    A text of over MAX_TEXT characters is an error.
    """
    short = F.when(longer(F.col("text"), MAX_TEXT), F.raise_error(F.lit(f"a text of over {MAX_TEXT} characters"))).otherwise(F.col("text"))
    lines = texts.withColumn("text", short).select("id", F.col("date").alias("own_date"), F.col("time").alias("own_time"), "default_result", F.posexplode(F.split("text", r"\r?\n")).alias("line", "raw"))
    stamped = lines.withColumn("raw", trimmed(F.col("raw"))).where("raw <> ''").withColumn("stamp", line_stamp(F.col("raw")))
    body = stamped.withColumn("body", F.regexp_replace("stamp.rest", BULLET, "")).withColumn("own", result_of(F.col("body")))
    bare = trimmed(F.regexp_replace(F.regexp_replace(F.regexp_replace("body", "❌|❎|✅", ""), TAIL, ""), HEAD, ""))
    marked = body.withColumn("cleaned", bare).withColumn("is_heading", ((F.col("cleaned") == "") & F.col("own").isNotNull()) | F.col("body").rlike(HEADING))
    headed = marked.withColumn("heading", F.when(F.col("is_heading"), F.col("own"))).withColumn("heading", carried(marked, "heading", ["id"], "line"))
    result = F.coalesce("own", "heading", "default_result")
    parts = F.filter(F.split("cleaned", PART), lambda p: p != "")
    rows = headed.where(~F.col("is_heading")).select(
        "id",
        "line",
        result.alias("result"),
        F.coalesce("stamp.date", "own_date").alias("date"),
        F.coalesce("stamp.time", "own_time", F.lit("")).alias("time"),
        F.posexplode(parts).alias("part", "text"),
    )
    matched = rows.withColumn("k", match_key(F.col("text"))).join(name_keys(names), "k", "left")
    return matched.select("id", "line", "part", F.coalesce("boss", F.lit("")).alias("boss"), "text", "result", "date", "time")


def read_messages(messages: DataFrame, names: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """Chat messages (id, text, date, time) as report rows, and one row for each message: pending and mentioned.

    Only explicit reports count: questions, plans and other days' reports are pending as a whole, and so are
    messages with a line that has no known name or no result, or that name a boss and report nothing. keep: writes down what both results come from, so
    that it is worked out once.
    """
    cut = messages.withColumn("text", F.substring(F.coalesce("text", F.lit("")), 1, MAX_MESSAGE))
    seen = keep(mentions(cut, names).withColumn("review", needs_review(F.col("text"))))
    explicit = seen.where(~F.col("review")).select("id", "text", "date", "time", F.lit(None).cast("string").alias("default_result"))
    parsed = keep(parse_reports(explicit, names))
    good = (F.col("boss") != "") & F.col("result").isNotNull()
    state = parsed.groupBy("id").agg(F.count_if(good).alias("good"), F.count_if(~good).alias("bad"))
    each = seen.join(state, "id", "left")
    pending = F.col("review") | (F.coalesce("bad", F.lit(0)) > 0) | ((F.coalesce("good", F.lit(0)) == 0) & (F.size("mentioned") > 0))
    return parsed.where(good).drop("text"), each.select("id", pending.alias("pending"), "mentioned")


def recognised(rows: DataFrame, state: DataFrame) -> DataFrame:
    """id and bosses (mentioned ones, then those reported, each once) of messages that name any, from read_messages()."""
    told = rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "part", "boss"))), lambda r: r["boss"]).alias("told"))
    both = F.array_union("mentioned", F.coalesce("told", F.array().cast("array<string>")))
    return state.join(told, "id", "left").select("id", both.alias("bosses")).where(F.size("bosses") > 0)


def reviews(messages: DataFrame, state: DataFrame) -> DataFrame:
    """id, bosses (MAX_BOSSES at most), date, time and reason (photo or unclear) of pending messages (id, date, time, media)."""
    return review_rows(state.where("pending").join(messages.select("id", "date", "time", "media"), "id"), "id")


def review_rows(waiting: DataFrame, *own: str) -> DataFrame:
    """reviews() of messages that have what state says of them (mentioned) beside date, time and media; own: columns that stay."""
    photo = F.coalesce("media", F.lit(False)) & (F.size("mentioned") == 0)
    part = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n).alias(c)
    return waiting.select(*own, F.slice("mentioned", 1, MAX_BOSSES).alias("bosses"), part("date", 10), part("time", 5), F.when(photo, "photo").otherwise("unclear").alias("reason"))


def checked_batches(messages: DataFrame) -> DataFrame:
    """messages (batch_id, id, text, ...) with error (id, text or size) and batch_ok: a batch of over MAX_BATCH messages, or with a bad one, is rejected as a whole."""
    batch = Window.partitionBy("batch_id")
    error = (
        F.when(~F.coalesce(F.col("id").rlike("^[a-f0-9]{64}$"), F.lit(False)), "id")
        .when(F.col("text").isNull() | (F.length("text") > MAX_MESSAGE), "text")
        .when(F.count("*").over(batch) > MAX_BATCH, "size")
    )
    return messages.withColumn("error", error).withColumn("batch_ok", F.every(F.col("error").isNull()).over(batch))


def check_key(boss_key: Column | None = None) -> list[Column]:
    """What makes two reports the same. boss_key: the boss's canonical name where a column has it."""
    return [F.col("world"), canonical(F.col("boss")).alias("boss_key") if boss_key is None else boss_key, F.col("date"), F.coalesce("time", F.lit("")).alias("time_key"), F.col("result")]


def validated(rows: DataFrame, names: DataFrame, worlds: list[str], now: int, origin: str = "group") -> DataFrame:
    """rows (batch_id, seq, world, boss, date, time, result, favorable) with the canonical name, origin (group or whatsapp), at, precision and error.

    A batch is all or nothing: batch_ok tells whether every row of it is good and none repeats. Errors: boss, date,
    future, result, favorable, time, world, repeated, size.
    """
    known = rows.withColumn("k", canonical(F.col("boss"))).join(name_keys(names).withColumnRenamed("boss", "known"), "k", "left")
    clock = F.coalesce("time", F.lit(""))
    batch = Window.partitionBy("batch_id")
    same = Window.partitionBy("batch_id", *check_key(F.col("k"))).orderBy("seq")
    error = (
        F.when(~F.col("world").isin(*worlds), "world")
        .when(F.col("known").isNull(), "boss")
        .when(~valid_date(F.col("date")) | (F.col("date") < FIRST_DAY), "date")
        .when(F.col("date") > local_date(F.lit(now)).cast("string"), "future")
        .when(~F.coalesce(F.col("result").isin(EMPTY, FOUND), F.lit(False)), "result")
        .when(~F.coalesce(F.col("favorable").isin("yes", "no", "unknown"), F.lit(False)), "favorable")
        .when((clock != "") & ~clock.rlike(r"^([01]\d|2[0-3]):[0-5]\d$"), "time")
        .when(F.row_number().over(same) > 1, "repeated")
    )
    out = known.withColumn("error", error).withColumn("error", F.coalesce("error", F.when(F.count("*").over(batch) > MAX_ROWS, "size")))
    return out.select(
        "batch_id",
        "seq",
        "world",
        F.coalesce("known", "boss").alias("boss"),
        "date",
        F.when(clock != "", clock).alias("time"),
        "result",
        "favorable",
        F.lit(origin).alias("origin"),
        at_local(F.col("date"), clock).alias("at"),
        F.when(clock != "", "minute").otherwise("day").alias("precision"),
        "error",
        F.every(F.col("error").isNull()).over(batch).alias("batch_ok"),
    )


def fresh_rows(rows: DataFrame, stored: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows whose key is neither stored nor met before in rows (by order)."""
    return not_stored(first_per_key(rows, key, [F.asc(order)]), stored.select(*key), key)


def ingest(batch: DataFrame, stored: DataFrame, key: list[str], order: str, batch_id: str = "batch_id") -> tuple[DataFrame, DataFrame]:
    """New rows of batches that are not stored yet, and one row for each batch: added and duplicates.

    A batch whose id is stored adds nothing; rows that repeat, within or across batches, are stored once, by order.
    """
    done = stored.select(F.col(batch_id).alias("b")).distinct()
    open_rows = batch.join(done, batch[batch_id] == F.col("b"), "left_anti")
    new = fresh_rows(open_rows, stored, key, order)
    added = new.groupBy(batch_id).agg(F.count("*").alias("added"))
    total = batch.groupBy(batch_id).agg(F.count("*").alias("rows"))
    counted = total.join(added, batch_id, "left").withColumn("added", F.coalesce("added", F.lit(0)))
    return new, counted.select(batch_id, "added", (F.col("rows") - F.col("added")).alias("duplicates"))


def undo_batch(stored: DataFrame, batch_ids: list[str]) -> DataFrame:
    """stored without some batches."""
    return stored.where(~F.coalesce(F.col("batch_id").isin(*batch_ids), F.lit(False)))


def identified(checks: DataFrame, recognised: DataFrame, pending: DataFrame) -> DataFrame:
    """boss, found, empty, pending and last_at: stored checks (boss, result, at) and recognised messages (id, bosses, at) of which some are pending (id)."""
    told = checks.select("boss", (F.col("result") == FOUND).cast("long").alias("found"), (F.col("result") != FOUND).cast("long").alias("empty"), F.lit(0).cast("long").alias("pending"), F.coalesce("at", F.lit(0)).alias("at"))
    waiting = recognised.join(pending.select("id", F.lit(1).cast("long").alias("waits")).distinct(), "id", "left")
    zero = F.lit(0).cast("long")
    named = waiting.select(F.explode("bosses").alias("boss"), zero.alias("found"), zero.alias("empty"), F.coalesce("waits", zero).alias("pending"), F.coalesce("at", zero).alias("at"))
    sums = [F.sum(c).alias(c) for c in ("found", "empty", "pending")]
    return told.unionByName(named).groupBy("boss").agg(*sums, F.greatest(F.lit(0), F.max("at")).alias("last_at"))


def identified_table(rows: DataFrame, query: str = "") -> DataFrame:
    """identified() in order of name, those whose name contains the query without regard to case."""
    return rows.where(F.contains(F.lower("boss"), F.lit(query.strip().lower()))).orderBy(F.collate("boss", "UNICODE"), "boss")


def upserted(stored: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """stored with new rows in place of those with the same key."""
    return stored.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def good_group(name: Column) -> Column:
    """Whether a chat group's name is one: headings of other panes are not."""
    return ~F.lower(trimmed(name)).isin(*BLOCKED_GROUPS)


def favourable(rows: DataFrame, predictions: DataFrame, today: str, data_age_ms: int, error: str | None = None) -> DataFrame:
    """rows (boss, date, ...) with favorable: yes if the boss's first prediction (boss_name, status, seq) is high, the day is today's and the data are fresh."""
    first = first_per_key(predictions.select(F.col("boss_name").alias("boss"), "status", "seq"), ["boss"], [F.asc("seq")]).drop("seq")
    usable = F.lit(error is None and data_age_ms <= 300_000) & (F.col("date") == today) & (F.col("status") == "high")
    return rows.drop("favorable").join(first, "boss", "left").withColumn("favorable", F.when(usable, "yes").otherwise("unknown")).drop("status")


def relevant(messages: DataFrame, names: DataFrame, since: int | None) -> DataFrame:
    """Messages worth sending on: with media, or new enough (or without a time) and naming something."""
    told = mentions(messages, names)
    recent = F.col("at").isNull() | (F.lit(True) if since is None else F.col("at") >= since)
    return told.where(F.coalesce("media", F.lit(False)) | (recent & (F.size("mentioned") > 0))).drop("mentioned")


def cut_diagnostics(rows: DataFrame) -> DataFrame:
    """detected to 150 characters, visible, relevant and without_date to 0..100,000."""
    held = lambda c: F.least(F.lit(100_000), F.greatest(F.lit(0), F.coalesce(F.col(c), F.lit(0)))).alias(c)
    return rows.select(F.substring(F.coalesce("detected", F.lit("")), 1, 150).alias("detected"), *map(held, ("visible", "relevant", "without_date")))



def rounds(stored: DataFrame, n: int = 20) -> DataFrame:
    """The first n batches by the place of their first row: batch_id, world, rows and bosses in order."""
    row = F.struct("seq", "boss", "result")
    each = stored.groupBy("batch_id").agg(F.min("seq").alias("first"), F.min("world").alias("world"), F.count("*").alias("rows"), F.array_sort(F.collect_list(row)).alias("all"))
    return each.orderBy("first", "batch_id").limit(n).select("batch_id", "world", "rows", F.transform("all", lambda r: r["boss"]).alias("bosses"))


def image_rows(images: DataFrame, recognised: DataFrame, pending: DataFrame) -> DataFrame:
    """images (id, message_id) with bosses and at of their message: as recognised (id, bosses, at), else as pending (id, bosses, date, time), else none and 0."""
    told = recognised.select(F.col("id").alias("message_id"), F.col("bosses").alias("told"), F.col("at").alias("told_at"))
    waiting = pending.select(F.col("id").alias("message_id"), F.col("bosses").alias("waits"), at_local(F.col("date"), F.col("time")).alias("waits_at"))
    joined = images.join(told, "message_id", "left").join(waiting, "message_id", "left")
    bosses = F.coalesce("told", "waits", F.array().cast("array<string>"))
    at = F.coalesce(F.when(F.col("told_at") != 0, F.col("told_at")), "waits_at", F.lit(0))
    return joined.select(*images.columns, bosses.alias("bosses"), at.alias("at"))


def added_images(images: DataFrame, stored: DataFrame, seen: DataFrame, limit: int = MAX_IMAGES) -> DataFrame:
    """images (seq, message_id, hash) with id and error: message (not among seen ids), stored (met before, here or in stored ids) or full (limit images are there by then).

    An image's id is the digest of its message's and its own. Those without error are to be stored, in order of seq.
    """
    told = images.withColumn("id", F.sha2(F.concat("message_id", F.lit("|"), "hash"), 256))
    mark = lambda rows, name, key: rows.select(F.col("id").alias(key), F.lit(True).alias(name)).distinct()
    told = told.join(mark(seen, "known", "message_id"), "message_id", "left").join(mark(stored, "there", "id"), "id", "left")
    first = first_per_key(told.where("known AND there IS NULL"), ["id"], [F.asc("seq")])
    room = F.greatest(F.lit(0), F.lit(limit) - F.lit(stored.count())).cast("int")
    taken = first.orderBy("seq").limit(limit).withColumn("place", F.row_number().over(Window.orderBy("seq"))).where(F.col("place") <= room).select("seq", F.lit(True).alias("taken"))  # limit rows
    firsts = first.select("seq", F.lit(True).alias("first"))
    error = F.when(F.col("known").isNull(), "message").when(F.col("there") | F.col("first").isNull(), "stored").when(F.col("taken").isNull(), "full")
    return told.join(firsts, "seq", "left").join(taken, "seq", "left").select("seq", "message_id", "hash", "id", error.alias("error"))


def image_type(data_url: Column) -> Column:
    """Type of an image given as a data URL, if its first bytes are those of that type; else null."""
    form = r"^data:image/(jpeg|png|webp);base64,([A-Za-z0-9+/]+=*)$"
    kind, head = F.regexp_extract(data_url, form, 1), F.hex(F.try_to_binary(F.substring(F.regexp_extract(data_url, form, 2), 1, 16), F.lit("base64")))
    png, jpeg, webp = head.startswith("89504E470D0A1A0A"), head.startswith("FFD8FF"), head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250")
    body = F.regexp_extract(data_url, form, 2)
    size = F.floor(F.length(F.rtrim(F.translate(body, "=", " "))) * 3 / 4)
    sized = (F.length(data_url) <= MAX_DATA_URL) & size.between(12, MAX_IMAGE)
    return F.when(sized & (((kind == "png") & png) | ((kind == "jpeg") & jpeg) | ((kind == "webp") & webp)), kind)


def require_room(stored: DataFrame, new: DataFrame, limit: int = MAX_CHECKS) -> DataFrame:
    """new, or an error where it would not fit with what is stored: nothing is cut off silently."""
    if stored.count() + new.count() > limit:
        raise ValueError(f"more than {limit} rows: export and review first")
    return new

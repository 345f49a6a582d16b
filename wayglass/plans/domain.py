"""More queries of the core library: readers, reports, settings, lists and streams over rows made of the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayglass.functions import text as T
from wayglass.functions import timing
from wayglass.operators import alerts, catalog, keyed, observations, order, patterns, progress, rankings, settings, snapshots
from wayglass.plans import views
from wayglass.plans.views import table
from wayglass.sources import store
from wayglass.sources.scratch import scratch
from wayglass.streaming import ingest, reports
from wayglass.streaming.state import Store

NAMES = ("Dharalion", "Hirintror", "Midnight Panther", "General Murius")
#: What chat messages of the test say, by number of the event modulo their count, in capitals, in small letters or as it stands.
SAID = (
    "Não estavam:\nDharalion\nEstavam:\nHirintror",
    "[09:10, 05/10/2026] Pessoa: Dharalion não estava",
    "pantera ✅",
    "Dharalion estava?",
    "Vou checar Hirintror",
    "Dharalion, hirintror; pantera ✅",
    "bom dia",
    "Hirintror",
    "9:05 Ana: • Hirintror = vazio\n- Dharalion : presente",
    "Bosses encontrados\n* dharalion ;  cave bear\nausentes:\n Murius",
    "❌ Dharalion\n\n✅ Midnight Panther, , General Murius",
    "[7:45, 1/2/26] Zé: achei Midnight Panther\nnão encontrados\nHirintror",
    "Dharalíon não encontrado",
)
#: White space before a line, between words and at a line's end.
SPACES = (("", " ", "\n"), ("\t", " ", "\r\n"), ("\u00a0 ", "\u00a0", "\n"), ("\ufeff\u3000", " ", " \n"))


def _pick(number: Column, values) -> Column:
    """The value at a number modulo their count."""
    return F.get(F.array(*[F.lit(v) for v in values]), (F.pmod(number, F.lit(len(values)))).cast("int"))


def _json_rows(df: DataFrame, name: str) -> str:
    """df written as JSON values, one a file line."""
    path = scratch(df.sparkSession, name)
    df.select(F.to_json(F.struct("*"))).write.text(path)
    return path


def _names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, i) for i, n in enumerate(NAMES)], "name string, seq int")


def _clock(ts: str = "ts") -> Column:
    return F.date_format(ts, "HH:mm")


# --- sources ---


def q_catalogue_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    place = F.struct(F.col("p_size").alias("x"), (key % 100).alias("y"), (key % 16).alias("z"))
    rows = table(spark, sf_dir, "part").select(F.expr("p_partkey DIV 64").alias("file"), F.struct(F.when(key % 10 != 0, F.col("p_name")).alias("name"), F.concat(F.lit("https://img/"), key.cast("string")).alias("image_url"), F.array(place).alias("locations")).alias("r"))
    path = scratch(spark, "catalogue")
    files = rows.groupBy("file").agg(F.to_json(F.collect_list("r")).alias("value")).select("value")  # a document holds some sixty rows
    files.write.option("maxRecordsPerFile", 1).text(path)
    return store.read_catalogue(spark, path).select("name", "image_url", F.col("locations")[0]["x"].alias("x"), F.col("locations")[0]["y"].alias("y"), F.col("locations")[0]["z"].alias("z"))


def q_public_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provider's document of five worlds with five bosses each, of which some are known by other spellings."""
    key = F.col("n_nationkey")
    kill = lambda d, approx: F.struct(d.alias("date"), approx.alias("approx"))
    day = F.concat(F.lit("2024-01-0"), (key % 9 + 1).cast("string"))
    record = F.struct(
        F.when(key % 3 == 0, F.lower("n_name")).otherwise(F.col("n_name")).alias("boss"),
        _pick(key, ("quente", "media", "inicial", "fora")).alias("status_key"),
        F.when(key % 2 == 0, F.concat(day, F.lit(" (aprox)"))).otherwise("").alias("txt_date"),
        F.when(key % 5 != 0, F.lit("x")).alias("last_date"),
        F.when(key % 4 == 0, F.lit("3-14 dias")).otherwise("").alias("window_txt"),
        key.cast("string").alias("window_min"),
        (key + 9).cast("string").alias("window_max"),
        F.array(kill(day, key % 2 == 0), kill(day, key % 2 != 0), kill(F.lit(None).cast("string"), F.lit(True)), kill(F.lit("2024-02-01"), key % 3 == 0)).alias("last_kills"),
    )
    nations = table(spark, sf_dir, "nation").select("n_name", key, F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("world"), record.alias("r"))
    worlds = nations.groupBy("world").agg(F.struct(*[F.collect_list(F.when(key % 2 == i, F.col("r"))).alias(n) for i, n in enumerate(("bosses", "demonLords"))]).alias("w"))
    document = worlds.agg(F.map_from_entries(F.collect_list(F.struct("world", "w"))).alias("worlds")).withColumn("updated", F.lit("01/07/1996 10:00"))
    path = _json_rows(document, "history")
    catalogue = nations.select("n_name").where("n_name < 'M'").select(F.initcap("n_name").alias("name"), F.lit(0).alias("seq"))
    out = None
    for r in range(5):
        raw = catalog.require_fresh(store.read_history(spark, path, f"R{r}"), views.SUMMER)
        named = catalog.name_records(raw, catalogue)
        told = catalog.predictions(named, f"R{r}").join(catalog.history(named, f"R{r}"), ["world", "boss_name"])
        new = catalog.catalogue_with_history(catalogue, named).select(F.col("name").alias("boss_name"), "appended")
        each = told.join(new, "boss_name").select("world", "boss_name", "source_status", "last_date", "window_text", "date", "approximate", "raw_records", "appended")
        out = each if out is None else out.unionByName(each)
    return out


def q_official_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.count("*").cast("double").alias("n"))
    half = F.when(F.right("name", F.lit(1)) == "5", 0.5).otherwise(0.0)
    entry = F.struct(F.upper("name").alias("race_name"), (F.col("n") % 7 + half).alias("creatures_killed_24h"), F.col("n").alias("creatures_killed_7d"))
    path = _json_rows(brands.agg(F.collect_list(entry).alias("entries")), "counts")  # one document of 25 brands
    none = spark.createDataFrame([], "boss_name string")
    return catalog.merge_counts(brands.select("name"), store.read_counts(spark, path), none).select("name", "day", "week", "covered")


def q_rankings_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of the five segments in pages, of which the second list is refused: the first three were fetched together."""
    customer = table(spark, sf_dir, "customer")
    player = F.struct(F.col("c_name").alias("name"), F.col("c_custkey").alias("rank"), F.col("c_nationkey").cast("long").alias("value"))
    pages = customer.groupBy(F.col("c_mktsegment").alias("category"), F.expr("c_custkey DIV 500").alias("page")).agg(F.collect_list(player).alias("players"))  # of 500 customers at most
    refused = F.when(F.col("category") == "BUILDING", rankings.REFUSED)
    path = _json_rows(pages.select("category", F.when(refused.isNull(), F.col("players")).alias("players"), refused.alias("error")), "rankings")
    found, players = store.read_rankings(spark, [path], lines=True)
    found = found.distinct()
    places = F.create_map(*[F.lit(x) for i, c in enumerate(("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) for x in (c, i)])
    after = rankings.after_refusal(found.withColumn("place", F.try_element_at(places, F.col("category"))))
    return rankings.look_up(after, players, ["customer#000000003", "CUSTOMER#000000010", "customer#000000017"]).select("category", "name", "status", "value", "rank", "error")


def q_profile_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    player = F.struct(F.when(key % 7 == 0, "Someone").otherwise(F.col("c_name")).alias("name"), (key % 1000).alias("level"), F.col("c_mktsegment").alias("world"), key.alias("account_id"), F.lit("secret").alias("password"))
    deaths = F.when(key % 2 == 0, F.array(F.struct(F.lit(5).alias("level"))))
    path = _json_rows(table(spark, sf_dir, "customer").select(F.upper("c_name").alias("asked"), player.alias("player"), deaths.alias("deaths")), "profiles")
    return rankings.profiles(store.read_profiles(spark, path)).select("asked", "player.name", "player.level", "player.world", "player.guild", "deaths", "banHistory", "error")


def q_state_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved rows, exported and imported with changes: new values go first, and what only one side has stays."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"), F.col("c_nationkey").alias("w"))
    state, export = scratch(spark, "state"), scratch(spark, "export")
    store.save(rows.where("k % 3 <> 0"), state)
    store.save(rows.where("k % 15 = 0"), state, "append")
    store.export_json(rows.where("k % 2 = 0").select("k", F.when(F.col("k") % 4 == 0, F.upper("v")).alias("v"), (F.col("w") + 1).alias("w")), export)
    schema = "k long, v string, w int"
    return store.merged(store.load(spark, state, schema), store.import_json(spark, export, schema), "k")


def q_blob_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in parts, some written anew, and one renamed over another."""
    texts = table(spark, sf_dir, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    parts = store.split_parts(texts, "path", "text", 500)
    new = texts.where("length(text) % 3 = 0").select("path", F.concat(F.lit("new "), F.left("text", F.lit(700))).alias("text"))
    put = store.put_parts(parts, new, "path", "text", 500)
    moved = store.rename_parts(put, "path", "f1", "f2")
    return store.join_parts(moved, "path").select("path", "parts", F.length(F.col("content").cast("string")).cast("long").alias("chars"), F.sha2("content", 256).alias("sha256"))


# --- reports ---


def _said(key: Column) -> Column:
    """Every sentence in three spellings and four kinds of white space."""
    text, n = _pick(key, SAID), len(SAID)
    cased = F.when(F.floor(key / n) % 3 == 0, F.upper(text)).when(F.floor(key / n) % 3 == 1, F.lower(text)).otherwise(text)
    before, between, end = (_pick(F.floor(key / (3 * n)), [s[i] for s in SPACES]) for i in range(3))
    return F.concat(before, F.replace(F.replace(cased, F.lit(" "), between), F.lit("\n"), F.concat(end, before)))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.sha2(F.col("event_id").cast("string"), 256).alias("id"), "event_id", _said(F.col("event_id")).alias("text"), F.to_date("ts").cast("string").alias("date"), _clock().alias("time"), (F.col("event_id") % 5 == 0).alias("media"), views.millis(F.col("ts")).alias("at"))


def q_chat_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations.read_messages(_messages(spark, sf_dir), _names(spark))[0].select("id", "line", "part", "boss", "result", "date", "time")


def q_chat_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _messages(spark, sf_dir)
    rows, state = observations.read_messages(messages, _names(spark))
    waiting = observations.reviews(messages, state).select("id", F.array_join("bosses", ",").alias("waiting"), "date", "time", "reason")
    told = observations.recognised(rows, state).select("id", F.array_join("bosses", ",").alias("bosses"))
    return waiting.join(told, "id", "full_outer")


def q_relevant_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _messages(spark, sf_dir).withColumn("at", F.when(F.col("event_id") % 4 != 0, F.col("at")))
    return observations.relevant(messages, _names(spark), 1_705_000_000_000).select("id", "media", "at")


def q_batch_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 100 and of 101 messages, some with a bad id, a missing text or too long a text."""
    key = F.col("event_id")
    batch = F.when(key % 201 < 100, F.floor(key / 201) * 2).otherwise(F.floor(key / 201) * 2 + 1)
    text = F.when(key % 911 == 0, None).when(key % 1201 == 0, F.repeat(F.lit("x"), 6001)).otherwise("x")
    rows = table(spark, sf_dir, "events").select(batch.cast("long").alias("batch_id"), F.when(key % 701 == 0, "x").otherwise(F.sha2(key.cast("string"), 256)).alias("id"), text.alias("text"), key)
    return observations.checked_batches(rows).select("event_id", "batch_id", "error", "batch_ok")


def q_validated_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, on = F.col("event_id"), lambda n, bad, good: F.when(F.col("event_id") % n == 0, bad).otherwise(good)
    rows = table(spark, sf_dir, "events").select(
        F.floor(key / 20).alias("batch_id"),
        key.alias("seq"),
        on(103, "Nowhere", "Lunarian").alias("world"),
        on(97, "nobody", _pick(key, ("DHARALION", "hirintrór", "Midnight  Panther"))).alias("boss"),
        F.when(key % 61 == 0, "2024-02-30").when(key % 101 == 0, "2099-01-01").otherwise(F.to_date("ts").cast("string")).alias("date"),
        F.when(key % 71 == 0, "25:00").when(key % 2 == 0, _clock()).alias("time"),
        on(83, "x", F.when(F.col("value") >= 50, "encontrado").otherwise("vazio")).alias("result"),
        on(89, "maybe", _pick(key, ("yes", "no", "unknown"))).alias("favorable"),
    )
    return observations.validated(rows, _names(spark), ["Lunarian"], 1_791_241_200_000).select("seq", "batch_id", "boss", "date", "time", "origin", "at", "precision", "error", "batch_ok")


def q_favourable_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("boss"), F.to_date("ts").cast("string").alias("date"))
    told = spark.createDataFrame([("view", "high", 1), ("view", "low", 0), ("click", "high", 0), ("click", "low", 1), ("error", "late", 0)], "boss_name string, status string, seq int")
    return observations.favourable(rows, told, "2024-01-15", 300_000)


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("boss"), F.when(F.col("value") >= 50, "encontrado").otherwise("vazio").alias("result"), views.millis(F.col("ts")).alias("at"))


def q_identified_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks, key = _checks(spark, sf_dir), F.col("event_id")
    told = checks.where("event_id % 10 = 0").select(key.cast("string").alias("id"), F.array("boss", F.concat(F.lit("Visit "), (key % 30).cast("string"))).alias("bosses"), F.when(key % 20 == 0, F.col("at")).alias("at"))
    old = told.where("CAST(id AS BIGINT) % 40 = 0").withColumn("bosses", F.array(F.lit("old")))
    pending = told.where("CAST(id AS BIGINT) % 30 = 0").select("id")
    return observations.identified_table(observations.identified(checks, observations.upserted(old, told), pending), " VI")


def q_message_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, checks = F.col("event_id"), _checks(spark, sf_dir)
    images = checks.select(key.alias("image"), key.cast("string").alias("message_id"))
    told = checks.where("event_id % 2 = 0").select(key.cast("string").alias("id"), F.array("boss").alias("bosses"), F.when(key % 4 == 0, F.col("at")).otherwise(0).alias("at"))
    pending = checks.where("event_id % 3 = 0").select(key.cast("string").alias("id"), F.array(F.lit("p")).alias("bosses"), F.lit("2024-01-05").alias("date"), F.when(key % 6 == 0, "10:00").alias("time"))
    return observations.image_rows(images, told, pending).select("image", F.array_join("bosses", ",").alias("bosses"), "at")


def q_image_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data URLs of images whose first bytes fit their type, or don't, or that are too short."""
    key = F.col("event_id")
    kind = _pick(key, ("png", "jpeg", "webp", "gif"))
    head = _pick(F.floor(key / 4), ("89504E470D0A1A0A", "FFD8FF00", "524946460102030457454250"))
    body = F.concat(head, F.repeat(F.lit("00"), (key % 20).cast("int")))
    url = F.concat(F.lit("data:image/"), kind, F.lit(";base64,"), F.base64(F.unhex(body)))
    return table(spark, sf_dir, "events").select("event_id", observations.image_type(url).alias("type"))


def q_check_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _checks(spark, sf_dir).select(F.floor(F.col("event_id") / 50).cast("string").alias("batch_id"), F.lit("W").alias("world"), (-F.col("event_id")).alias("seq"), "boss", "result")
    return observations.rounds(rows).select("batch_id", "rows", F.array_join("bosses", ",").alias("bosses"))


def q_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.repeat("event_type", 40).alias("detected"), (key * 50 - 1000).alias("visible"), F.when(key % 3 != 0, key).alias("relevant"), (-key).alias("without_date"))
    return observations.cut_diagnostics(rows)


def q_dismissed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _checks(spark, sf_dir).select("event_id", F.concat(F.lit("b"), (F.col("event_id") % 50).cast("string")).alias("batch_id"), "boss")
    left = observations.undo_batch(rows, ["b3", "b4"])
    return keyed.without(left, left.where("event_id % 7 = 0").select("event_id"), "event_id")


# --- texts ---


def q_folded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of documents, each with some words of another script behind it, folded."""
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), _pick(F.col("doc_id"), OTHERS))
    folded = table(spark, sf_dir, "documents").select("doc_id", T.fold(said).alias("text"))
    return folded.select("doc_id", F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("sha256"))


#: Greek, Cyrillic, Hangul, Kana, Hebrew, Devanagari, letters with several marks, letters that stand for others, marks out of order.
OTHERS = ("\u1f8d\u03b4\u03b7\u03c2 \u0390", "\u0419\u043e\u0436\u0438\u043a \u0401\u043b\u043a\u0430", "\ud55c\uad6d\uc5b4 \uac01", "\u30ac\u30d1\u3094", "\ufb2e\ufb49", "\u0958\u0931", "\u1ec7 \u01d6 \u0230", "\u212a\u212b\u2126", "\u05e9\u05c1\u05b8\u05bc q\u0307\u0323")


def q_screen_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.concat(F.lit("\u200e \u202f"), "c_name", _pick(F.col("c_custkey"), (" \t \u00c9\u202a ", "\u3000\u00e9 \ufeff", " \n\u00a0E\u0301\u2009")), "c_mktsegment", F.lit("\u202c\u2069 "))
    return table(spark, sf_dir, "customer").select("c_custkey", T.screen_fold(shown).alias("name"))


def _stamps(key: Column) -> Column:
    """Stamps of 24 and of 12 hours, with years of two and four digits and one, hours and minutes that are none, days that don't exist, and different marks and spaces."""
    space, mark = _pick(key, ("", " ", "\u202f", "\u00a0")), _pick(F.floor(key / 4), ("/", ".", "-"))
    half = _pick(F.floor(key / 12), ("", "AM", "pm", "PM"))
    hour, minute = (key % 27).cast("string"), F.lpad((key % 67).cast("string"), 2, "0")
    year = _pick(F.floor(key / 5), ("2024", "26", "025", "2023"))
    return F.concat(F.lit("x ["), hour, F.lit(":"), minute, F.when(half == "", "").otherwise(F.concat(space, half)), F.lit(","), space, (key % 32).cast("string"), mark, (key % 13).cast("string"), mark, year, F.lit("] Ana: "))


def q_chat_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", T.chat_stamp(_stamps(F.col("event_id"))).alias("s")).select("event_id", "s.time", "s.date")


def q_totals_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    line = F.when(key % 11 == 0, "Nobody; 5").when(key % 13 == 0, F.concat("c_name", F.lit(" -1"))).when(key % 17 == 0, F.concat("c_name", F.lit("\t100001"))).otherwise(F.concat(F.upper("c_name"), _pick(key, ("; ", " = ", "\t")), (key % 500).cast("string")))
    line = F.when(key % 19 == 0, F.concat(line, F.lit("\r\n"), line)).otherwise(line)
    texts = table(spark, sf_dir, "customer").groupBy(F.floor(key / 5).alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    return progress.parse_totals(texts, table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")))


def q_profile_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    number = F.replace(F.format_number(key * 12_345, 0), F.lit(","), F.lit("."))
    page = F.concat(F.lit("<p>Experiência <script>x = 'Ganho 24h 9'</script>total <b>"), number, F.lit("</b></p>\n<i>Ganho <>24h</i>"), F.when(key % 5 == 0, ": ").otherwise(" "), F.when(key % 2 == 0, "−").otherwise("+"), number, F.when(key % 3 == 0, " Ganho 7 dias 99999999999999999").otherwise(""))
    text = table(spark, sf_dir, "customer").select("c_custkey", T.html_text(page).alias("text"))
    labels = {"total": "Experiência total", "day": "Ganho 24h", "week": "Ganho 7 dias"}
    return text.select("c_custkey", *[T.labelled_number(F.col("text"), label).alias(c) for c, label in labels.items()])


def q_push_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = ("https://fcm.googleapis.com/", "https://FCM.googleapis.com/", "http://fcm.googleapis.com/", "https://x.notify.windows.com/", "https://fcm.googleapis.com.evil.com/", "https://u:p@fcm.googleapis.com/", "https://web.push.apple.com:8443/", "https://127.0.0.1/", "no address ")
    return table(spark, sf_dir, "customer").select("c_custkey", alerts.allowed_endpoint(F.concat(_pick(F.col("c_custkey"), hosts), F.url_encode("c_name"))).alias("allowed"))


def q_map_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    place = F.concat(F.lit('<i class="map_frame_coord" id=x> '), (key % 37).cast("string"), F.lit(","), F.when(key % 9 == 0, 70_000).otherwise(key % 3).cast("string"), F.lit(","), (key % 18).cast("string"), F.lit(":2</i>"))
    pages = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", place.alias("p")))), lambda x: x["p"]), "").alias("html"))
    return rankings.locations(pages, "user_id").select("user_id", "name", "x", "y", "z")


def q_names_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    character = F.when(key % 4 == 0, " a ").when(key % 4 == 1, F.concat("c_name", F.lit("\t"), "c_name")).when(key % 4 == 2, F.repeat("c_name", (key % 5 + 1).cast("int"))).otherwise(F.col("c_name"))
    group = F.concat(F.lit(" "), _pick(key, ("Dados do Perfil", "GROUP INFO", "Caça", "dados do grupo 2")), F.lit(" "))
    return table(spark, sf_dir, "customer").select("c_custkey", rankings.valid_name(character).alias("character_ok"), observations.good_group(group).alias("group_ok"))


# --- times, alerts and progress ---


def q_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    said = F.concat(F.date_format(F.date_add(F.to_date("o_orderdate"), 10_957), "yyyy-MM-dd'T'"), F.lpad((key % 24).cast("string"), 2, "0"), F.lit(":30:00"), _pick(key, ("Z", "-03:00", "", "+05:30")))
    rows = table(spark, sf_dir, "orders").select(key, timing.instant(said).alias("ms"))
    return rows.select("o_orderkey", "ms", timing.local_date(F.col("ms")).cast("string").alias("day"))


def q_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.when(F.col("o_orderkey") % 10 == 0, "soon").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy HH:mm"))
    return table(spark, sf_dir, "orders").select("o_orderkey", catalog.fresh_stamp(stamp, views.SUMMER).alias("fresh"))


def q_day_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily predictions at 20:45 local time: the round of 20:50, and all day where no time is set."""
    key, flag = F.col("c_custkey"), lambda n: F.col("c_custkey") % n == 0
    none = F.lit(None).cast("long")
    rows = table(spark, sf_dir, "customer").select(
        key, F.lit("W").alias("world"), F.col("c_name").alias("boss_name"), F.lit("day").alias("resolution"), _pick(key, ("quente", "media", "inicial", "fora", "other")).alias("source_status"),
        F.lit("01/01/1996").alias("last_date"), none.alias("start"), none.alias("end"), flag(7).alias("completed"), flag(11).alias("muted"), flag(3).alias("favorite"),
    )
    planned, daily, late = (alerts.due(rows, views.NIGHT, 0, c, favorites_only=f) for c, f in (("20:50", False), ("", True), ("20:40", False)))
    all_of = planned.unionByName(daily).unionByName(late)
    return all_of.select("c_custkey", alerts.status(all_of, views.NIGHT).alias("status"), "kind", "starts", F.array_join("alert_key", "|").alias("alert_key"))


def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress maps by customer: an entry for each order."""
    key = F.col("o_orderkey")
    entry = F.struct((F.col("o_totalprice") - 100_000).alias("kills"), F.when(key % 3 != 0, (key % 200_000 - 10).cast("double")).alias("target"), F.when(key % 5 != 0, key % 2 == 0).alias("known"), F.when(key % 7 == 0, True).alias("target_confirmed"), F.lit(None).cast("boolean").alias("favorite"), (key % 2 == 1).alias("muted"))
    name = F.when(key % 301 == 0, F.lit("constructor")).otherwise(F.concat(F.lit("O"), key.cast("string")))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user"), name.alias("name"), entry.alias("p"))
    once = orders.groupBy("user", "name").agg(F.min("p").alias("p"))
    return once.groupBy("user").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "p")))).alias("progress"))


def q_settings_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user")
    rows = _progress(spark, sf_dir).select(user, _pick(user, ("Lunarian", "Bellum", "Nowhere", "Vesperia", None)).alias("world"), F.when(user % 4 != 0, user % 130).cast("int").alias("lead_minutes"), F.concat((user % 30).cast("string"), F.lit(":05")).alias("check_time"), "progress")
    return rows.select("user", settings.settings_error(rows).alias("error"))


def q_progress_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settings.progress_rows(_progress(spark, sf_dir))
    return settings.progress_rows(settings.progress_map(rows))


def q_progress_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as bosses, half of them in the completion table under other spellings: those that are begun, and a category."""
    key, customer = F.col("c_custkey"), table(spark, sf_dir, "customer")
    entries = customer.where("c_custkey % 2 = 0").select(F.upper(F.replace("c_name", F.lit("#"), F.lit(" - "))).alias("name"), (key % 6 + 1).cast("int").alias("target"), F.col("c_mktsegment").alias("category"), key.alias("seq"))
    some = lambda n, c: F.when(key % n != 0, c)
    rows = customer.select(F.col("c_name").alias("name"), some(5, key % 9).alias("kills"), some(3, key % 4).alias("target"), some(2, key % 7 == 0).alias("target_confirmed"), some(4, key % 8 != 1).alias("known"), some(3, F.lit(True)).alias("favorite"), F.lit(None).cast("boolean").alias("muted"))
    found = progress.resolved(rows, entries)
    lists = [progress.progress_list(found, show).withColumn("shown", F.lit(show)) for show in ("started", "unfilled", "BUILDING")]
    return lists[0].unionByName(lists[1]).unionByName(lists[2]).select("shown", "name", "kills", "target", "category", "known", "completed", "favorite", F.round("percent", 6).alias("percent"))


def q_pattern_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    bosses = table(spark, sf_dir, "events").select(F.col("event_type").alias("name")).distinct().unionByName(spark.createDataFrame([("none",)], "name string"))
    found = progress.with_patterns(bosses, patterns.find(views.checks(spark, sf_dir)), "W1")
    return found.select("name", "pattern.total", "pattern.found", "pattern.days", "pattern.start")


# --- orders ---


def q_patterns_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.placed(patterns.find(views.checks(spark, sf_dir)), order.pattern_order()).select("place", "world", "boss", "total", F.col("start").cast("long").alias("start"))


def q_radar_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.predictions(spark, sf_dir)
    bosses = rows.select(F.concat(F.lit("Order "), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("name"), alerts.status(rows, views.SUMMER).alias("status"), "favorite", "muted", "known", "completed", F.lit(False).alias("hidden"))
    return order.placed(progress.radar(bosses), order.radar_order()).select("place", "name", "status", "favorite")


def q_progress_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), (F.col("c_custkey") % 9).alias("kills"), F.lit(5).alias("target"), F.lit(True).alias("target_confirmed"), F.lit(True).alias("known"), F.lit(None).cast("boolean").alias("favorite"), F.lit(None).cast("boolean").alias("muted"))
    none = spark.createDataFrame([], "name string, target int, category string, seq long")
    return order.placed(progress.progress_list(progress.resolved(rows, none), "missing"), order.by_name("name")).select("place", "name", F.col("kills").cast("long").alias("kills"))


def q_identified_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = table(spark, sf_dir, "events").select(F.concat(F.lit("U"), F.lpad(F.col("user_id").cast("string"), 7, "0")).alias("boss"), F.when(F.col("value") >= 50, "encontrado").otherwise("vazio").alias("result"), views.millis(F.col("ts")).alias("at"))
    none = spark.createDataFrame([], "id string, bosses array<string>, at long")
    rows = observations.identified(checks, none, none.select("id"))
    return order.placed(rows, order.by_name("boss")).select("place", "boss", "found", "empty")


def q_state_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 500 newest reports of a world, 100 images and 50 pending messages, in order."""
    checks = views.checks(spark, sf_dir)
    shown = order.shown(checks.select("world", "seq"), checks.where("bucket IS NULL").select("seq"), checks.where("found").select("seq"), "W1")
    each = [df.select(F.lit(kind).alias("list"), "place", "seq") for kind, df in zip(("checks", "images", "pending"), shown, strict=True)]
    return each[0].unionByName(each[1]).unionByName(each[2])


def q_added_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image for each event, of messages by user, some of which were never seen; 1,500 are stored, so that 500 find room."""
    key = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(key.alias("seq"), F.sha2((F.col("user_id") % 50).cast("string"), 256).alias("message_id"), F.sha2((key % 300).cast("string"), 256).alias("hash"))
    seen = spark.range(45).select(F.sha2(F.col("id").cast("string"), 256).alias("id"))
    stored = spark.range(1500).select(F.sha2(F.concat(F.sha2((F.col("id") % 10).cast("string"), 256), F.lit("|"), F.sha2(F.expr("cast(id DIV 10 as string)"), 256)), 256).alias("id"))
    return observations.added_images(rows, stored, seen).select("seq", "id", "error")


# --- streams ---


def _arriving(spark: SparkSession, folder: str, files: list[DataFrame], run) -> None:
    """Write one table after the other to a folder, and run a stream from it after each, which takes all of its files as one micro-batch."""
    for k, df in enumerate(files):
        df.write.parquet(f"{folder}/in/{k}")
        run(spark.readStream.schema(df.schema).parquet(f"{folder}/in/*")).awaitTermination()


def q_stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by three-hour window and type, as windows close; those without a time are kept apart. Early events come again with the second file, too late."""
    folder = scratch(spark, "windows")
    key = F.col("event_id")
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.when(key % 13 != 0, F.col("ts").cast("timestamp")).alias("ts"))
    half, early = "coalesce(ts < '2024-01-20', event_id % 2 = 0)", "ts < '2024-01-10'"
    end = events.where("ts IS NOT NULL").agg(F.lit(-1).cast("long").alias("event_id"), F.lit("end").alias("event_type"), (F.max("ts") + F.expr("INTERVAL 60 DAYS")).alias("ts"))
    files = [events.where(half), events.where(f"NOT ({half})").unionByName(events.where(early)), end]
    _arriving(spark, folder, files, lambda source: ingest.window_stream(source.where("ts IS NOT NULL"), "ts", ["event_type"], f"{folder}/rows", f"{folder}/marks"))
    windows = Store(spark, f"{folder}/rows").log("rows", "start timestamp, end timestamp, event_type string, n long")
    rest = ingest.undated(spark.read.schema(events.schema).parquet(f"{folder}/in/*"), "ts").groupBy("event_type").agg(F.count("*").alias("n"))
    return windows.select(F.unix_millis("start").alias("start"), "event_type", "n").unionByName(rest.withColumn("start", F.lit(None).cast("long")))


def q_stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts in two files of which the second has many of the first's again, and then all of them from a stream that knows nothing."""
    folder = scratch(spark, "alerts")
    key = F.col("event_id")
    alert = table(spark, sf_dir, "events").select(key, F.array(F.col("event_type"), (F.col("user_id") % 10).cast("string")).alias("alert_key"))
    endpoints = spark.createDataFrame([("e0",), ("e1",)], "endpoint string")
    run = lambda marks: lambda source: ingest.alert_stream(source, endpoints, f"{folder}/rows", f"{folder}/{marks}")
    _arriving(spark, folder, [alert.where("event_id % 7 = 0").select("alert_key"), alert.where("event_id % 7 <> 0").select("alert_key")], run("marks"))
    run("others")(spark.readStream.schema("alert_key array<string>").parquet(f"{folder}/in/*")).awaitTermination()
    return Store(spark, f"{folder}/rows").log("rows", "alert_key array<string>, endpoint string").select(F.array_join("alert_key", "|").alias("alert_key"), "endpoint")


def q_stream_sent_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of which the newest 40 keys stay known: sixty keys, ten others, and then all, of which those that are not known any more are sent again."""
    folder = scratch(spark, "sent")
    number = F.col("user_id") % 90
    alert = table(spark, sf_dir, "events").select(number.alias("k"), F.array(F.lpad(number.cast("string"), 2, "0")).alias("alert_key"))
    files = [alert.where(when).select("alert_key") for when in ("k < 60", "k BETWEEN 60 AND 69", "true")]
    one = spark.createDataFrame([("e",)], "endpoint string")
    _arriving(spark, folder, files, lambda source: ingest.alert_stream(source, one, f"{folder}/rows", f"{folder}/marks", keep=40))
    sent = Store(spark, f"{folder}/rows").log("rows", "alert_key array<string>, endpoint string")
    return sent.groupBy(F.col("alert_key")[0].alias("key")).agg(F.count("*").alias("n"))


def q_stream_increase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots that arrive in three files, none of them in order, against what all at once would give."""
    folder = scratch(spark, "increase")
    counts = views.snapshots(spark, sf_dir)
    third = lambda n: counts.where(F.pmod(F.expr("at DIV 1800000"), F.lit(3)) == n)
    _arriving(spark, folder, [third(1), third(2), third(0)], lambda source: ingest.increase_stream(source, f"{folder}/rows", f"{folder}/marks"))
    return Store(spark, f"{folder}/rows").table("rows", "world string, at long, boss string, day long, week long, increase boolean, since long")


def q_stream_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 100 thinned times of each type, which is what a bounded history holds."""
    folder = scratch(spark, "kept")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("world"), views.millis(F.col("ts")).alias("at"))
    middle = 1_705_276_800_000  # 15 January 2024
    _arriving(spark, folder, [rows.where(F.col("at") < middle), rows.where(F.col("at") >= middle)], lambda source: ingest.thin_stream(source, f"{folder}/rows", f"{folder}/marks", keep=100))
    return Store(spark, f"{folder}/rows").table("kept", "world string, at long")


def q_stream_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat messages in three batches without limits, one with a message without a text and one with a gap: what is stored of them, and the mark."""
    folder = scratch(spark, "sync")
    batch, text = F.col("event_id") % 3, F.when(F.col("event_id") != 201, F.col("text"))
    rows = _messages(spark, sf_dir).select(batch.alias("batch"), F.col("event_id").alias("seq"), "id", text.alias("text"), "date", "time", "media", F.col("id").alias("mark_id"), F.col("at").alias("mark_at"), F.when(batch == 2, "gap").otherwise("complete").alias("coverage"))
    files = [rows.where(F.col("batch") == b).drop("batch") for b in range(3)]
    many = 1 << 40
    _arriving(spark, folder, files, lambda source: reports.sync_stream(source, _names(spark), "Lunarian", ["Lunarian"], 1_791_241_200_000, f"{folder}/rows", f"{folder}/marks", max_batch=many, max_pending=many, max_checks=many))
    store = Store(spark, f"{folder}/rows")
    checks = store.table("checks", reports.CHECKS).select("boss", "date", "time", "result", "origin", "at", F.lit(None).cast("string").alias("reason"))
    rejected = store.log("rejected", reports.REJECTED)
    mark = F.lit(store.commit.values["mark"]["at"]).cast("long")
    none = F.lit(None).cast("string")
    return checks.unionByName(rejected.select(none.alias("boss"), none.alias("date"), none.alias("time"), none.alias("result"), none.alias("origin"), mark.alias("at"), "reason"))


def q_stream_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns of reports that come in batches in three files, with batches undone by the second and third, and one that comes again."""
    folder = scratch(spark, "patterns")
    checks = views.checks(spark, sf_dir).withColumn("number", F.expr("seq DIV 100")).withColumn("batch_id", F.concat(F.lit("b"), F.col("number").cast("string")))
    names = [f.split()[0] for f in reports.REPORTS.split(", ")]
    added = lambda when, step: checks.where(when).select(F.lit("add").alias("action"), F.lit(step).cast("long").alias("step"), *names)
    undone = lambda when, step: checks.where(when).select("batch_id").distinct().select(F.lit("undo").alias("action"), F.lit(step).cast("long").alias("step"), "batch_id", *[F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in reports.REPORTS.split(", ")[1:]])
    files = [added("number % 3 <> 2", 1), added("number % 3 = 2", 1).unionByName(undone("number % 5 = 0", 2)), undone("number % 7 = 3", 1).unionByName(added("number % 10 = 0", 2)).unionByName(added("number % 4 = 1 AND number % 5 <> 0 AND number % 7 <> 3", 2))]
    _arriving(spark, folder, files, lambda source: reports.pattern_stream(source, f"{folder}/rows", f"{folder}/marks"))
    found = Store(spark, f"{folder}/rows").table("patterns", reports.PATTERNS)
    return found.select("world", "boss", "total", "found", "days", "favorable_total", "favorable_found", "unfavorable_total", "unfavorable_found", "start", "last.at", "last.seq")


def q_stream_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    batches = table(spark, sf_dir, "events").select(key.cast("string").alias("id"), F.when(key % 9 != 0, views.millis(F.col("ts"))).alias("at"), F.when(key % 4 == 0, "gap").when(key % 4 == 1, "baseline").otherwise("complete").alias("coverage"))
    low = spark.createDataFrame([("m", 5)], "id string, at long")
    high = spark.createDataFrame([("m", 4_000_000_000_000)], "id string, at long")
    return ingest.next_marker(low, batches.where("id <> '0'")).select("at", F.lit("low").alias("before")).unionByName(ingest.next_marker(high, batches).select("at", F.lit("high").alias("before")))


QUERIES = {name.removeprefix("q_"): f for name, f in list(globals().items()) if name.startswith("q_")}

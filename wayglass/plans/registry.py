"""Queries of the core library by name, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayglass.functions import text as T
from wayglass.operators import alerts, catalog, keyed, observations, patterns, progress, rankings, snapshots
from wayglass.operators.ledger import ledger
from wayglass.plans import domain, views
from wayglass.plans.domain_sql import ORACLES as _DOMAIN_SQL
from wayglass.plans.oracles import ORACLES as _SQL
from wayglass.plans.views import table
from wayglass.sources import store
from wayglass.sources.scratch import scratch
from wayglass.streaming import ingest
from wayglass.streaming.state import Store


def q_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = patterns.find(views.checks(spark, sf_dir))
    return found.select("world", "boss", "total", "found", "days", "favorable_total", "favorable_found", "unfavorable_total", "unfavorable_found", "start")


def q_hour_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = patterns.totals(views.checks(spark, sf_dir)).select("world", "boss", F.inline("hours"))
    return hours.select("world", "boss", "bucket", "total", "found", "days", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


def q_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.last_seen(views.checks(spark, sf_dir))


def q_day_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.days(views.checks(spark, sf_dir)).select("world", "boss", "day", "n", "hits", "favorable")


def q_official_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    brands = part.select(F.col("p_brand").alias("name")).distinct()
    shipped = F.to_date("l_shipdate")
    lines = table(spark, sf_dir, "lineitem").where((shipped > F.lit("1995-06-10").cast("date")) & (shipped <= F.lit("1995-06-17").cast("date"))).select("l_partkey", shipped.alias("shipped"))
    sold = lines.join(part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").groupBy("p_brand")
    entries = sold.agg(F.count_if(F.col("shipped") == "1995-06-17").cast("double").alias("day"), F.count("*").cast("double").alias("week"))
    entries = entries.select(F.upper("p_brand").alias("race_name"), "day", "week", F.lit(0).alias("seq"))
    predicted = brands.where(F.right("name", F.lit(1)).cast("int") % 2 == 0).select(F.col("name").alias("boss_name"))
    return catalog.merge_counts(brands, entries, predicted)


def q_snapshot_increase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.increases(views.snapshots(spark, sf_dir))


def q_snapshot_thinning(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = table(spark, sf_dir, "events").select(F.col("event_type").alias("world"), views.millis(F.col("ts")).alias("at"))
    return snapshots.thinned(times)


def q_history_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("world"), F.to_date("ts").cast("string").alias("date"), "event_id", "event_type")
    return catalog.unique_history(rows, "event_id")


def q_universe_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda c: F.concat(F.lit("K"), F.col(c).cast("string")).alias("name")
    return catalog.universe(
        [
            table(spark, sf_dir, "customer").select(name("c_custkey"), F.col("c_name").alias("label")),
            table(spark, sf_dir, "supplier").select(name("s_suppkey"), F.col("s_name").alias("label")),
            table(spark, sf_dir, "orders").select(name("o_custkey"), F.lit("order").alias("label")),
        ]
    )


def q_rankings_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    spent = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)"))).cast("long").alias("value"))
    players = customer.join(spent, "c_custkey").select(F.col("c_mktsegment").alias("category"), F.col("c_name").alias("name"), F.col("c_custkey").alias("rank"), "value", F.col("c_custkey").alias("seq"))
    broken = F.when(F.col("category") == "MACHINERY", "HTTP 429")
    lists = customer.select(F.col("c_mktsegment").alias("category")).distinct().withColumn("error", broken)
    return rankings.look_up(lists, players, ["customer#000000001", "CUSTOMER#000000004", "customer#000000007", "nobody"])


def q_status_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.predictions(spark, sf_dir)
    return rows.withColumn("status", alerts.status(rows, views.SUMMER)).groupBy("o_orderpriority", "status").agg(F.count("*").alias("n"))


def _due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.due(views.predictions(spark, sf_dir), views.NIGHT, 30)


def q_due_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _due(spark, sf_dir).select("o_orderkey", "world", "boss_name", "kind", "starts")


def q_alert_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = _due(spark, sf_dir)
    subscriptions = spark.range(2).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("endpoint"))
    sent = due.where(F.substring("boss_name", 2, 20).cast("long") % 3 == 0).select("alert_key", F.lit("e1").alias("endpoint"))
    return alerts.unsent(due, subscriptions, sent).select(F.array_join("alert_key", "|").alias("alert_key"), "endpoint")


def q_dictionary_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("text", " ")
    pairs = F.transform(F.slice(words, 1, F.greatest(F.lit(1), F.size(words) - 1)), lambda w, i: F.array_join(F.slice(words, i + 1, 2), " "))
    names = table(spark, sf_dir, "benchmark").select(F.explode(pairs).alias("name"))  # each two words of every item
    found = observations.mentions(table(spark, sf_dir, "documents").select("doc_id", "text"), names)
    return found.select("doc_id", F.explode("mentioned").alias("name"))


def q_canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"\s+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))
    folded = words.select(T.canonical(F.col("word")).alias("name_key"), T.plain_key(F.col("word")).alias("plain"), "n")
    return folded.groupBy("name_key").agg(F.sum("n").alias("n"), F.min("plain").alias("plain"))


def q_message_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n")).alias("line", "said"))
    marked = lines.withColumn("place", F.col("turn") * 1_000_000 + F.col("line")).withColumn("heading", F.when(F.col("line") == 0, F.col("role")))
    out = marked.withColumn("heading", observations.carried(marked, "heading", ["conv_id"], "place"))
    return out.select("conv_id", "turn", F.col("line").cast("long").alias("line"), "heading", F.length("said").cast("long").alias("chars"))


def q_idempotent_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ["user_id", "event_type", "day"]
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"))
    rows = rows.withColumn("batch_id", F.concat(F.lit("w"), F.floor(F.day("day") / 7).cast("string")))
    # Both sides together hold all events: one up to the 18th, one from the 12th on. Batch w1 is stored under its own name, so it is skipped.
    stored = keyed.first_per_key(rows.where(F.day("day") <= 18), key, [F.asc("event_id")])
    stored = stored.withColumn("batch_id", F.when(F.col("batch_id") == "w1", "w1").otherwise(F.concat(F.lit("a-"), "batch_id")))
    new, counts = observations.ingest(rows.where(F.day("day") >= 12), stored, key, "event_id")
    return counts.join(new, "batch_id", "left")


def q_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = table(spark, sf_dir, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))
    return text.select("page_id", F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("sha256"))


def q_html_extract_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rankings.first_distinct(table(spark, sf_dir, "pages"), "page_id", F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1), None)
    return found.select("page_id", F.col("place").cast("long").alias("place"), "value")


def q_ledger_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases are recorded checks, clicks record one again, and errors undo one: the last of the user, or the first."""
    kind = F.col("event_type")
    so_far = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    bought = F.when(kind == "purchase", F.col("event_id"))
    first, last = F.first(bought, ignorenulls=True).over(so_far), F.last(bought, ignorenulls=True).over(so_far)
    number = F.when(kind == "purchase", F.col("event_id")).when(kind == "click", last).when(kind == "error", F.when(F.col("event_id") % 3 != 0, last).otherwise(first))
    action = F.when(kind.isin("purchase", "click"), "check").when(kind == "error", "undo")
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), action.alias("action"), number.alias("id"), F.lit(True).alias("counts"), F.lit(None).cast("long").alias("kills"))
    return ledger(rows.where("id IS NOT NULL").withColumn("boss", F.concat(F.lit("B"), (F.col("id") % 2).cast("string"))), "user_id")


def q_radar_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.predictions(spark, sf_dir)
    bosses = rows.select(F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("name"), alerts.status(rows, views.SUMMER).alias("status"), "favorite", "muted", "known", "completed", F.lit(False).alias("hidden"))
    return progress.radar(bosses, "order", "soon").select("name", "status", "favorite", "muted")


def q_topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_type", views.millis(F.col("ts")).alias("at"), "event_id", "user_id")
    return snapshots.newest(events, ["event_type"], 5, "at", "event_id")


def q_dashboard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.predictions(spark, sf_dir)
    return progress.counts(rows.withColumn("status", alerts.status(rows, views.SUMMER)), "o_orderpriority")


def q_blob_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = store.split_parts(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", "text", 1000)
    return store.join_parts(parts, "doc_id").select("doc_id", "parts", F.sha2("content", 256).alias("sha256"))


def _folder(spark: SparkSession) -> str:
    return scratch(spark, "stream")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)


def q_stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    rows = _events(spark, sf_dir).select("event_id", "user_id", "event_type", F.to_date("ts").cast("string").alias("day"))
    schema = "event_id long, user_id long, event_type string, day string"
    ingest.ingest_stream(rows, f"{folder}/rows", f"{folder}/marks", schema, ["user_id", "event_type", "day"], "event_id", within="day").awaitTermination()
    return ingest.stored(spark, f"{folder}/rows", schema)


def q_stream_thinning(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    rows = _events(spark, sf_dir).select(F.col("event_type").alias("world"), views.millis(F.col("ts")).alias("at"))
    ingest.thin_stream(rows, f"{folder}/rows", f"{folder}/marks").awaitTermination()
    return Store(spark, f"{folder}/rows").log("rows", "world string, at long")


QUERIES = {name.removeprefix("q_"): f for name, f in list(globals().items()) if name.startswith("q_")}
QUERIES |= domain.QUERIES
ORACLES = _SQL | _DOMAIN_SQL

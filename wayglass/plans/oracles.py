"""DuckDB SQL for the registered queries, written from what they are to return."""

from __future__ import annotations

import re

_CHECKS = """checks AS (
  SELECT 'W' || (user_id % 4) AS world, event_type AS boss, CAST(CAST(ts AS DATE) AS VARCHAR) AS day,
    CASE WHEN event_id % 11 <> 0 THEN CAST(floor(hour(ts) / 3) AS INTEGER) END AS bucket,
    value >= 50 OR (event_type = 'purchase' AND hour(ts) BETWEEN 9 AND 11) AS found,
    CASE event_id % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'unknown' END AS favorable, epoch_us(ts) // 1000 AS at, event_id AS seq
  FROM events
), blocks AS (
  SELECT world, boss, day, bucket, bool_or(found) AS found FROM checks GROUP BY ALL
), spoken AS (
  SELECT world, boss, day, coalesce(arg_max(favorable, seq) FILTER (WHERE found), arg_min(favorable, seq)) AS favorable, bool_or(found) AS found FROM checks GROUP BY ALL
), hours AS (
  SELECT b.world, b.boss, h.bucket::INTEGER AS bucket, count(k.day) AS total, count(k.day) FILTER (WHERE k.found) AS found, count(DISTINCT k.day) AS days
  FROM (SELECT DISTINCT world, boss FROM checks) b CROSS JOIN range(8) h(bucket) LEFT JOIN blocks k ON k.world = b.world AND k.boss = b.boss AND k.bucket = h.bucket GROUP BY ALL
), shares AS (
  SELECT *, found / nullif(total, 0)::DOUBLE AS p, 1 + CAST(1.96 AS DOUBLE) * CAST(1.96 AS DOUBLE) / nullif(total, 0) AS a, CAST(1.96 AS DOUBLE) AS z FROM hours
), bounds AS (
  SELECT world, boss, bucket, total, found, days,
    CASE WHEN total = 0 THEN 0 ELSE greatest(0, (p + z * z / (2 * total)) / a - z * sqrt((p * (1 - p) + z * z / (4 * total)) / total) / a) END AS low,
    CASE WHEN total = 0 THEN 1 ELSE least(1, (p + z * z / (2 * total)) / a + z * sqrt((p * (1 - p) + z * z / (4 * total)) / total) / a) END AS high
  FROM shares
)"""
_PREDICTIONS = """predictions AS (
  SELECT o_orderkey, o_orderpriority, 'W' || (o_custkey % 4) AS world, 'C' || o_custkey AS boss_name, epoch_ms(o_orderdate) AS s, epoch_ms(o_orderdate) + 86400000 AS e,
    o_custkey % 7 = 0 AS completed, o_custkey % 11 = 0 AS muted, o_custkey % 5 = 0 AS favorite, o_custkey % 3 <> 0 AS known
  FROM orders
), classified AS (
  SELECT *, CASE WHEN 836179200000 > e THEN 'late' WHEN 836179200000 >= s THEN 'high' WHEN s - 836179200000 <= 259200000 THEN 'medium' ELSE 'low' END AS status FROM predictions
), due AS (
  SELECT *, CASE WHEN 820626300000 >= s THEN 'open' ELSE 'soon' END AS kind FROM predictions
  WHERE NOT completed AND NOT muted AND 820626300000 <= e AND 820626300000 >= s - 1800000
)"""

ORACLES = {
    "patterns": f"""WITH {_CHECKS}, able AS (SELECT * FROM bounds WHERE total >= 10 AND days >= 5),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY world, boss ORDER BY low DESC, bucket) AS r FROM able WHERE found >= 3) WHERE r = 1),
picked AS (
  SELECT b.world, b.boss, b.bucket * 3 AS start FROM best b JOIN able o ON o.world = b.world AND o.boss = b.boss AND o.bucket <> b.bucket
  GROUP BY b.world, b.boss, b.bucket, b.low HAVING b.low > max(o.high)
), t AS (SELECT world, boss, count(*) AS total, count(*) FILTER (WHERE found) AS found FROM blocks GROUP BY ALL),
d AS (
  SELECT world, boss, count(*) AS days, count(*) FILTER (WHERE favorable = 'yes') AS favorable_total, count(*) FILTER (WHERE favorable = 'yes' AND found) AS favorable_found,
    count(*) FILTER (WHERE favorable = 'no') AS unfavorable_total, count(*) FILTER (WHERE favorable = 'no' AND found) AS unfavorable_found FROM spoken GROUP BY ALL
)
SELECT world, boss, total, found, days, favorable_total, favorable_found, unfavorable_total, unfavorable_found, start::INTEGER AS start
FROM t JOIN d USING (world, boss) LEFT JOIN picked USING (world, boss)""",
    "hour_histogram": f"WITH {_CHECKS} SELECT world, boss, bucket, total, found, days, round(low, 9)::DOUBLE AS low, round(high, 9)::DOUBLE AS high FROM bounds",
    "last_seen": f"""WITH {_CHECKS}
SELECT world, boss, at, day, bucket, favorable, seq FROM (SELECT *, row_number() OVER (PARTITION BY world, boss ORDER BY at DESC, seq) AS r FROM checks WHERE found) WHERE r = 1""",
    "day_split": f"""WITH {_CHECKS}, n AS (SELECT world, boss, day, count(*) AS n, count(*) FILTER (WHERE found) AS hits FROM blocks GROUP BY ALL)
SELECT world, boss, day, n, hits, favorable FROM n JOIN spoken USING (world, boss, day)""",
    "official_merge": """WITH brands AS (SELECT DISTINCT p_brand AS name FROM part),
sold AS (
  SELECT p_brand AS name, count(*) FILTER (WHERE CAST(l_shipdate AS DATE) = DATE '1995-06-17') AS day, count(*) AS week
  FROM lineitem JOIN part ON p_partkey = l_partkey WHERE CAST(l_shipdate AS DATE) > DATE '1995-06-10' AND CAST(l_shipdate AS DATE) <= DATE '1995-06-17' GROUP BY ALL
)
SELECT name, day, week, week IS NOT NULL AS covered, week IS NOT NULL AND CAST(right(name, 1) AS INTEGER) % 2 <> 0 AS additional FROM brands LEFT JOIN sold USING (name)""",
    "snapshot_increase": """WITH each AS (
  SELECT 'W' || (user_id % 4) AS world, event_type AS boss, epoch_us(ts) // 1800000000 AS half, count(*) AS n FROM events GROUP BY ALL
), counts AS (
  SELECT world, (half + 1) * 1800000 AS at, boss,
    CAST(sum(n) OVER (PARTITION BY world, boss ORDER BY half RANGE BETWEEN 47 PRECEDING AND CURRENT ROW) AS BIGINT) AS day,
    CAST(sum(n) OVER (PARTITION BY world, boss ORDER BY half RANGE BETWEEN 335 PRECEDING AND CURRENT ROW) AS BIGINT) AS week FROM each
), times AS (SELECT world, at, lag(at) OVER (PARTITION BY world ORDER BY at) AS before FROM (SELECT DISTINCT world, at FROM counts)),
compared AS (
  SELECT c.world, c.at, c.boss, c.day, c.week, t.before, coalesce(c.day > o.day OR c.week > o.week, false) AS increase
  FROM counts c LEFT JOIN times t ON t.world = c.world AND t.at = c.at AND c.at - t.before <= 3600000
  LEFT JOIN counts o ON o.world = c.world AND o.boss = c.boss AND o.at = t.before
)
SELECT world, at, boss, day, week, increase, CASE WHEN increase THEN before END AS since FROM compared""",
    "snapshot_thinning": """WITH lists AS (SELECT event_type AS world, list_sort(list(DISTINCT epoch_us(ts) // 1000)) AS l FROM events GROUP BY ALL)
SELECT world, unnest(list_reduce(list_transform(l, lambda x: [x]), lambda acc, x: CASE WHEN x[1] - acc[len(acc)] >= 240000 THEN list_concat(acc, x) ELSE acc END)) AS at FROM lists""",
    "history_dedup": """SELECT CAST(user_id AS VARCHAR) AS world, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, min(event_id) AS first_seq
FROM events GROUP BY ALL""",
    "universe_merge": """WITH tagged AS (
  SELECT 'K' || c_custkey AS name, c_name AS label, 0 AS source FROM customer UNION ALL SELECT 'K' || s_suppkey, s_name, 1 FROM supplier UNION ALL SELECT 'K' || o_custkey, 'order', 2 FROM orders
)
SELECT name, label, source FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY source, label) AS r FROM tagged) WHERE r = 1""",
    "rankings_lookup": """WITH spent AS (SELECT o_custkey, CAST(round(sum(CAST(o_totalprice AS DECIMAL(18,2)))) AS BIGINT) AS value FROM orders GROUP BY ALL),
players AS (SELECT c_mktsegment AS category, lower(c_name) AS k, c_custkey AS rank, value FROM customer JOIN spent ON o_custkey = c_custkey),
lists AS (SELECT c_mktsegment AS category, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'HTTP 429' END AS error FROM customer GROUP BY ALL),
asked(name) AS (VALUES ('customer#000000001'), ('CUSTOMER#000000004'), ('customer#000000007'), ('nobody'))
SELECT l.category, a.name, CASE WHEN l.error IS NOT NULL THEN 'unavailable' WHEN p.k IS NOT NULL THEN 'found' ELSE 'not-listed' END AS status, p.value, p.rank,
  (SELECT count(*) FROM players x WHERE x.category = l.category) AS total_listed, l.error
FROM lists l CROSS JOIN asked a LEFT JOIN players p ON p.category = l.category AND p.k = lower(a.name)""",
    "status_classify": f"WITH {_PREDICTIONS} SELECT o_orderpriority, status, count(*) AS n FROM classified GROUP BY ALL",
    "due_alerts": f"WITH {_PREDICTIONS} SELECT o_orderkey, world, boss_name, kind, s AS starts FROM due",
    "alert_antijoin": f"""WITH {_PREDICTIONS}, keys AS (SELECT DISTINCT world || '|' || boss_name || '|' || s || '|' || e || '|window' AS alert_key, CAST(substr(boss_name, 2) AS BIGINT) % 3 = 0 AS gone FROM due)
SELECT alert_key, endpoint FROM keys CROSS JOIN (VALUES ('e0'), ('e1')) v(endpoint) WHERE NOT (gone AND endpoint = 'e1')""",
    "dictionary_mentions": """WITH names AS (SELECT DISTINCT array_to_string(list_slice(l, pos, pos + 1), ' ') AS name FROM (SELECT l, unnest(range(1, greatest(2, len(l)))) AS pos FROM (SELECT string_split(text, ' ') AS l FROM benchmark))),
folded AS (SELECT doc_id, strip_accents(lower(text)) AS t FROM documents)
SELECT doc_id, name FROM folded JOIN names ON contains(t, lower(strip_accents(name)))""",
    "canonical_names": r"""WITH words AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS word FROM documents) WHERE word <> '' GROUP BY ALL)
SELECT regexp_replace(lower(strip_accents(word)), '[^a-z0-9]', '', 'g') AS name_key, CAST(sum(n) AS BIGINT) AS n, min(regexp_replace(lower(word), '[^a-z0-9]', '', 'g')) AS plain FROM words GROUP BY 1""",
    "message_lines": """WITH lines AS (SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS said, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM conversations)
SELECT conv_id, turn, line::BIGINT AS line, last_value(CASE WHEN line = 0 THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, line) AS heading, length(said) AS chars FROM lines""",
    "idempotent_ingest": """WITH rows AS (SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS day, 'w' || (day(ts) // 7) AS batch_id FROM events),
old AS (SELECT DISTINCT user_id, event_type, day FROM rows WHERE day(day) <= 18),
batch AS (SELECT *, row_number() OVER (PARTITION BY batch_id = 'w1', user_id, event_type, day ORDER BY event_id) AS r FROM rows WHERE day(day) >= 12),
new AS (SELECT b.event_id, b.user_id, b.event_type, b.day, b.batch_id FROM batch b LEFT JOIN old USING (user_id, event_type, day) WHERE r = 1 AND batch_id <> 'w1' AND old.user_id IS NULL),
counts AS (SELECT batch_id, (SELECT count(*) FROM new n WHERE n.batch_id = batch.batch_id) AS added, count(*) AS rows FROM batch GROUP BY batch_id)
SELECT batch_id, added, rows - added AS duplicates, event_id, user_id, event_type, day FROM counts LEFT JOIN new USING (batch_id)""",
    "html_text": r"""WITH t AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>', '', 'g'), '<[^>]*>', ' ', 'g'), '[\s\x{a0}\x{3000}\x{feff}]+', ' ', 'g') AS text FROM pages
) SELECT page_id, length(text) AS chars, sha256(text) AS sha256 FROM t""",
    "html_extract_distinct": """WITH each AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS value, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) AS pos FROM pages),
firsts AS (SELECT page_id, value, min(pos) AS pos FROM each GROUP BY ALL), placed AS (SELECT page_id, value, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS place FROM firsts)
SELECT page_id, place, value FROM placed""",
    "ledger_totals": """WITH acts AS (
  SELECT user_id, event_id, event_type <> 'error' AS push, CASE WHEN event_type = 'purchase' THEN event_id WHEN event_type = 'click' OR event_id % 3 <> 0 THEN last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER o
    ELSE first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER o END AS id, event_type
  FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), lists AS (
  SELECT user_id, 'B' || (id % 2) AS boss, list({'s': [id], 'push': push, 'made': 0, 'undone': 0, 'conflicts': 0, 'repeated': 0} ORDER BY event_id) AS l
  FROM acts WHERE id IS NOT NULL AND event_type IN ('purchase', 'click', 'error') GROUP BY ALL
), done AS (
  SELECT user_id, boss, list_reduce(list_prepend({'s': []::BIGINT[], 'push': true, 'made': 0, 'undone': 0, 'conflicts': 0, 'repeated': 0}, l), lambda a, x: CASE
    WHEN x.push AND list_contains(a.s, x.s[1]) THEN {'s': a.s, 'push': true, 'made': a.made, 'undone': a.undone, 'conflicts': a.conflicts, 'repeated': a.repeated + 1}
    WHEN x.push THEN {'s': list_concat(a.s, x.s), 'push': true, 'made': a.made + 1, 'undone': a.undone, 'conflicts': a.conflicts, 'repeated': a.repeated}
    WHEN len(a.s) > 0 AND a.s[len(a.s)] = x.s[1] THEN {'s': a.s[:-2], 'push': true, 'made': a.made, 'undone': a.undone + 1, 'conflicts': a.conflicts, 'repeated': a.repeated}
    WHEN list_contains(a.s, x.s[1]) THEN {'s': a.s, 'push': true, 'made': a.made, 'undone': a.undone, 'conflicts': a.conflicts + 1, 'repeated': a.repeated}
    ELSE a END) AS r FROM lists
)
SELECT user_id, boss, len(r.s)::BIGINT AS kills, len(r.s) > 0 AS known, r.made::BIGINT AS made, r.undone::BIGINT AS undone, r.conflicts::BIGINT AS conflicts, r.repeated::BIGINT AS repeated FROM done""",
    "radar_list": f"WITH {_PREDICTIONS} SELECT 'Order ' || o_orderkey AS name, status, favorite, muted FROM classified WHERE status IN ('high', 'medium')",
    "topk_per_group": """SELECT event_type, at, event_id, user_id FROM (
  SELECT event_type, epoch_us(ts) // 1000 AS at, event_id, user_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5""",
    "dashboard_counts": f"""WITH {_PREDICTIONS}
SELECT o_orderpriority, count(*) FILTER (WHERE status = 'high') AS high, count(*) AS total, count(*) FILTER (WHERE completed) AS completed, count(*) FILTER (WHERE known) AS known FROM classified GROUP BY ALL""",
    "blob_reassembly": "SELECT doc_id, greatest(1, CAST(ceil(strlen(coalesce(text, '')) / 1000.0) AS BIGINT)) AS parts, sha256(coalesce(text, '')) AS sha256 FROM documents",
    "stream_ingest": "SELECT min(event_id) AS event_id, user_id, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events GROUP BY ALL",
}
ORACLES["stream_thinning"] = ORACLES["snapshot_thinning"]
# "at" is a word of its own in DuckDB.
ORACLES = {name: re.sub(r"(?<!\")\bat\b(?!\")", '"at"', sql) for name, sql in ORACLES.items()}

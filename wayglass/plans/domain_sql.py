"""DuckDB SQL for the queries of domain.py, written from what they are to return."""

from __future__ import annotations

import re

from wayglass.plans import oracles
from wayglass.plans.domain import NAMES, SAID, SPACES

ORACLES = {
    "catalogue_scan": """SELECT p_name AS name, 'https://img/' || p_partkey AS image_url, p_size::INTEGER AS x, (p_partkey % 100)::INTEGER AS y, (p_partkey % 16)::INTEGER AS z FROM part WHERE p_partkey % 10 <> 0""",
    "public_history": """WITH given AS (
  SELECT n_nationkey AS k, 'R' || n_regionkey AS world, CASE WHEN n_name < 'M' THEN upper(n_name[1]) || lower(n_name[2:]) WHEN n_nationkey % 3 = 0 THEN lower(n_name) ELSE n_name END AS boss_name, n_name >= 'M' AS appended,
    CASE n_nationkey % 4 WHEN 0 THEN 'quente' WHEN 1 THEN 'media' WHEN 2 THEN 'inicial' ELSE 'fora' END AS source_status, '2024-01-0' || (n_nationkey % 9 + 1) AS day FROM nation
), named AS (SELECT *, array_to_string(list_transform(string_split(boss_name, ' '), lambda w: CASE WHEN appended THEN w ELSE upper(w[1]) || lower(w[2:]) END), ' ') AS called FROM given)
SELECT world, called AS boss_name, source_status, CASE WHEN k % 2 = 0 THEN day || ' (aprox)' WHEN k % 5 <> 0 THEN 'x' ELSE '' END AS last_date,
  CASE WHEN k % 4 = 0 THEN '3-14 dias' ELSE k || '-' || (k + 9) END AS window_text, date, CASE WHEN date = day THEN k % 2 <> 0 ELSE k % 3 = 0 END AS approximate, 4::INTEGER AS raw_records, appended
FROM named, (VALUES (0), (1)) v(i), LATERAL (SELECT CASE WHEN i = 0 THEN day ELSE '2024-02-01' END AS date)""",
    "official_scan": """WITH n AS (SELECT p_brand AS name, count(*) AS n FROM part GROUP BY ALL)
SELECT name, CASE WHEN right(name, 1) <> '5' THEN n % 7 END AS day, CASE WHEN right(name, 1) <> '5' THEN n END AS week, right(name, 1) <> '5' AS covered FROM n""",
    "rankings_scan": """WITH lists AS (SELECT c_mktsegment AS category, CASE WHEN c_mktsegment = 'BUILDING' THEN 'HTTP 429' WHEN c_mktsegment IN ('HOUSEHOLD', 'MACHINERY') THEN 'not fetched' END AS error FROM customer GROUP BY ALL),
asked(name) AS (VALUES ('customer#000000003'), ('CUSTOMER#000000010'), ('customer#000000017'))
SELECT category, a.name, CASE WHEN error IS NOT NULL THEN 'unavailable' WHEN c_custkey IS NOT NULL THEN 'found' ELSE 'not-listed' END AS status, c_nationkey::BIGINT AS value, c_custkey AS rank, error
FROM lists CROSS JOIN asked a LEFT JOIN customer ON c_mktsegment = category AND lower(c_name) = lower(a.name) AND category <> 'BUILDING'""",
    "profile_scan": """SELECT upper(c_name) AS asked, CASE WHEN ok THEN c_name END AS name, CASE WHEN ok THEN CAST(c_custkey % 1000 AS VARCHAR) END AS level, CASE WHEN ok THEN c_mktsegment END AS world, CAST(NULL AS VARCHAR) AS guild,
  CASE WHEN ok THEN CASE WHEN c_custkey % 2 = 0 THEN '[{"level":5}]' ELSE '[]' END END AS deaths, CASE WHEN ok THEN '[]' END AS "banHistory", CASE WHEN NOT ok THEN 'not-found' END AS error
FROM (SELECT *, c_custkey % 7 <> 0 AS ok FROM customer)""",
    "state_merge": """WITH old AS (SELECT c_custkey AS k, c_name AS v, c_nationkey AS w FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 15 = 0),
new AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN upper(c_name) END AS v, c_nationkey + 1 AS w FROM customer WHERE c_custkey % 2 = 0)
SELECT k, coalesce(new.v, old.v) AS v, coalesce(new.w, old.w)::INTEGER AS w FROM old FULL JOIN new USING (k)""",
    "blob_store": """WITH texts AS (SELECT 'f' || doc_id AS path, coalesce(text, '') AS t, text IS NOT NULL AND length(text) % 3 = 0 OR text IS NULL AS again FROM documents),
put AS (SELECT path, CASE WHEN again THEN 'new ' || left(t, 700) ELSE t END AS t FROM texts),
moved AS (SELECT CASE WHEN path = 'f1' THEN 'f2' ELSE path END AS path, t FROM put WHERE path <> 'f2')
SELECT path, greatest(1, CAST(ceil(strlen(t) / 500.0) AS BIGINT)) AS parts, length(t) AS chars, sha256(t) AS sha256 FROM moved""",
    "batch_limits": """WITH m AS (SELECT event_id, CASE WHEN event_id % 201 < 100 THEN event_id // 201 * 2 ELSE event_id // 201 * 2 + 1 END AS batch_id FROM events),
e AS (SELECT *, CASE WHEN event_id % 701 = 0 THEN 'id' WHEN event_id % 911 = 0 OR event_id % 1201 = 0 THEN 'text' WHEN count(*) OVER (PARTITION BY batch_id) > 100 THEN 'size' END AS error FROM m)
SELECT event_id, batch_id, error, bool_and(error IS NULL) OVER (PARTITION BY batch_id) AS batch_ok FROM e""",
    "validated_checks": """WITH r AS (
  SELECT event_id AS seq, event_id // 20 AS batch_id, event_id % 103 = 0 AS nowhere, event_id % 97 = 0 AS nobody, event_id % 3 AS k, CASE WHEN event_id % 61 = 0 THEN '2024-02-30' WHEN event_id % 101 = 0 THEN '2099-01-01' ELSE CAST(CAST(ts AS DATE) AS VARCHAR) END AS date,
    CASE WHEN event_id % 71 = 0 THEN '25:00' WHEN event_id % 2 = 0 THEN strftime(ts, '%H:%M') END AS time, CASE WHEN event_id % 83 = 0 THEN 'x' WHEN value >= 50 THEN 'encontrado' ELSE 'vazio' END AS result, event_id % 89 = 0 AS maybe FROM events
), n AS (
  SELECT *, CASE WHEN nobody THEN 'nobody' WHEN k = 0 THEN 'Dharalion' WHEN k = 1 THEN 'Hirintror' ELSE 'Midnight Panther' END AS boss,
    row_number() OVER (PARTITION BY batch_id, nowhere, CASE WHEN nobody THEN 9 ELSE k END, date, coalesce(time, ''), result ORDER BY seq) AS place FROM r
), e AS (
  SELECT *, CASE WHEN nowhere THEN 'world' WHEN nobody THEN 'boss' WHEN date = '2024-02-30' THEN 'date' WHEN date = '2099-01-01' THEN 'future' WHEN result = 'x' THEN 'result' WHEN maybe THEN 'favorable' WHEN time = '25:00' THEN 'time' WHEN place > 1 THEN 'repeated' END AS error FROM n
)
SELECT seq, batch_id, boss, date, time, CASE WHEN date <> '2024-02-30' AND coalesce(time, '') <> '25:00' THEN epoch_ms(CAST(date || ' ' || coalesce(time, '12:00') || ':00' AS TIMESTAMP)) + 10800000 END AS at, 'group' AS origin,
  CASE WHEN time IS NULL THEN 'day' ELSE 'minute' END AS precision, error, bool_and(error IS NULL) OVER (PARTITION BY batch_id) AS batch_ok FROM e""",
    "favourable_checks": """SELECT event_id, event_type AS boss, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, CASE WHEN event_type = 'click' AND CAST(ts AS DATE) = DATE '2024-01-15' THEN 'yes' ELSE 'unknown' END AS favorable FROM events""",
    "identified_table": """WITH checks AS (SELECT event_id, event_type AS boss, value >= 50 AS hit, epoch_us(ts) // 1000 AS at FROM events),
told AS (SELECT event_id, unnest([boss, 'Visit ' || (event_id % 30)]) AS boss, CASE WHEN event_id % 20 = 0 THEN at ELSE 0 END AS at FROM checks WHERE event_id % 10 = 0),
every AS (SELECT boss, hit::INTEGER AS f, (NOT hit)::INTEGER AS e, 0 AS p, at FROM checks UNION ALL SELECT boss, 0, 0, (event_id % 30 = 0)::INTEGER, at FROM told)
SELECT boss, sum(f)::BIGINT AS found, sum(e)::BIGINT AS empty, sum(p)::BIGINT AS pending, max(at) AS last_at FROM every GROUP BY boss HAVING contains(lower(boss), 'vi')""",
    "message_images": """SELECT event_id AS image, CASE WHEN event_id % 2 = 0 THEN event_type WHEN event_id % 3 = 0 THEN 'p' ELSE '' END AS bosses,
  CASE WHEN event_id % 4 = 0 THEN epoch_us(ts) // 1000 WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 6 = 0 THEN 1704459600000 ELSE 1704466800000 END ELSE 0 END AS at FROM events""",
    "image_types": """SELECT event_id, CASE WHEN event_id % 4 = event_id // 4 % 3 AND event_id % 20 + CASE event_id // 4 % 3 WHEN 0 THEN 8 WHEN 1 THEN 4 ELSE 12 END >= 12 THEN CASE event_id % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'webp' END END AS type FROM events""",
    "check_rounds": """WITH b AS (SELECT CAST(event_id // 50 AS VARCHAR) AS batch_id, min(-event_id) AS first, count(*) AS rows, string_agg(event_type, ',' ORDER BY -event_id) AS bosses FROM events GROUP BY 1)
SELECT batch_id, rows, bosses FROM b ORDER BY first, batch_id LIMIT 20""",
    "diagnostics": """SELECT left(repeat(event_type, 40), 150) AS detected, least(100000, greatest(0, event_id * 50 - 1000)) AS visible, CASE WHEN event_id % 3 <> 0 THEN least(100000, event_id) ELSE 0 END AS relevant, greatest(0, -event_id) AS without_date FROM events""",
    "dismissed": """SELECT event_id, 'b' || (event_id % 50) AS batch_id, event_type AS boss FROM events WHERE event_id % 50 NOT IN (3, 4) AND event_id % 7 <> 0""",
    "totals_lines": """WITH each AS (SELECT c_custkey AS k, c_name, c_custkey // 5 AS id, unnest(range(0, CASE WHEN c_custkey % 19 = 0 THEN 2 ELSE 1 END)) AS copy FROM customer),
placed AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k, copy) AS line FROM each),
kinds AS (SELECT *, CASE WHEN k % 11 = 0 THEN 'unknown' WHEN k % 13 = 0 THEN 'format' WHEN k % 17 = 0 THEN 'too-large' ELSE 'good' END AS kind FROM placed)
SELECT id, line::INTEGER AS line, CASE WHEN kind IN ('too-large', 'good') THEN c_name END AS name, CASE kind WHEN 'unknown' THEN 5 WHEN 'too-large' THEN 100001 WHEN 'good' THEN k % 500 END AS kills,
  CASE WHEN kind IN ('unknown', 'format') THEN kind WHEN copy = 1 THEN 'repeated' WHEN kind = 'too-large' THEN kind END AS error FROM kinds""",
    "profile_numbers": """SELECT c_custkey, c_custkey * 12345 AS total, CASE WHEN c_custkey % 5 <> 0 THEN CASE WHEN c_custkey % 2 = 0 THEN -1 ELSE 1 END * c_custkey * 12345 END AS day, CAST(NULL AS BIGINT) AS week FROM customer""",
    "push_endpoints": """SELECT c_custkey, c_custkey % 9 IN (0, 1, 3) AS allowed FROM customer""",
    "map_places": """WITH p AS (SELECT user_id, (event_id % 37)::INTEGER AS x, (event_id % 3)::INTEGER AS y, (event_id % 18)::INTEGER AS z, min(event_id) AS pos FROM events WHERE event_id % 9 <> 0 AND event_id % 18 <= 15 GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS place FROM p)
SELECT user_id, 'Local ' || place AS name, x, y, z FROM n WHERE place <= 20""",
    "names_checked": """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN false WHEN 1 THEN false WHEN 2 THEN length(c_name) * (c_custkey % 5 + 1) <= 60 ELSE true END AS character_ok, c_custkey % 4 >= 2 AS group_ok FROM customer""",
    "instants": """WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 2 THEN epoch_ms(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) + 10957 * 86400000::BIGINT + o_orderkey % 24 * 3600000 + 1800000 + CASE o_orderkey % 4 WHEN 1 THEN 10800000 WHEN 3 THEN -19800000 ELSE 0 END END AS ms FROM orders)
SELECT o_orderkey, ms, CAST(CAST(make_timestamp((ms - 10800000) * 1000) AS DATE) AS VARCHAR) AS day FROM t""",
    "freshness": """SELECT o_orderkey, o_orderkey % 10 <> 0 AND CAST(o_orderdate AS DATE) BETWEEN DATE '1996-06-28' AND DATE '1996-07-01' AS fresh FROM orders""",
    "day_alerts": """WITH p AS (SELECT c_custkey, c_name, CASE c_custkey % 5 WHEN 0 THEN 'high' END AS s FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 11 <> 0)
SELECT c_custkey, s AS status, 'round' AS kind, 820626600000 AS starts, 'W|' || c_name || '|01/01/1996|1996-01-02|round' AS alert_key FROM p WHERE s = 'high'
UNION ALL SELECT c_custkey, s, 'daily', NULL, 'W|' || c_name || '|01/01/1996|daily' FROM p WHERE s = 'high' AND c_custkey % 3 = 0""",
    "settings_checked": """WITH o AS (SELECT o_custkey AS u, bool_or(o_orderkey % 301 = 0) AS bad FROM orders GROUP BY ALL)
SELECT u AS user, CASE WHEN u % 5 = 2 THEN 'world' WHEN u % 4 <> 0 AND u % 130 NOT BETWEEN 5 AND 120 THEN 'lead_minutes' WHEN u % 30 NOT BETWEEN 10 AND 23 THEN 'check_time' WHEN bad THEN 'boss' END AS error FROM o""",
    "progress_maps": """WITH o AS (
  SELECT o_custkey AS u, CASE WHEN o_orderkey % 301 = 0 THEN 'constructor' ELSE 'O' || o_orderkey END AS name, o_totalprice - 100000 AS kills, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 200000 - 10 END AS target,
    CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 2 = 0 END AS known, CASE WHEN o_orderkey % 7 = 0 THEN true END AS confirmed, o_orderkey % 2 = 1 AS muted FROM orders
), once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY u, name ORDER BY kills, target NULLS FIRST, known NULLS FIRST, confirmed NULLS FIRST, muted) AS r FROM o) WHERE r = 1)
SELECT u AS user, name, least(100000, greatest(0, CAST(trunc(kills) AS BIGINT))) AS kills, CASE WHEN target IS NULL OR target = 0 THEN 100 ELSE least(100000, greatest(1, target)) END AS target,
  coalesce(known, true) AS known, coalesce(confirmed, false) AS target_confirmed, false AS favorite, muted FROM once""",
    "progress_list": """WITH c AS (
  SELECT c_name AS name, c_custkey AS k, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 9 END AS given, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 4 END AS wanted, c_custkey % 2 <> 0 AND c_custkey % 7 = 0 AS confirmed,
    CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 8 <> 1 END AS said, c_custkey % 3 <> 0 AS favorite, c_custkey % 2 = 0 AS listed, c_mktsegment FROM customer
), r AS (
  SELECT name, coalesce(given, 0) AS kills, CASE WHEN listed THEN k % 6 + 1 WHEN wanted > 0 THEN wanted ELSE 1 END AS target, CASE WHEN listed THEN c_mktsegment END AS category, coalesce(said, given IS NOT NULL OR wanted IS NOT NULL) AS known, listed OR confirmed AS sure, favorite FROM c
), d AS (SELECT *, known AND sure AND kills >= target AS completed FROM r)
SELECT shown, name, kills, target, category, known, completed, favorite, round(least(100.0, 100.0 * kills / target), 6)::DOUBLE AS percent
FROM d, (VALUES ('started'), ('unfilled'), ('BUILDING')) v(shown) WHERE CASE shown WHEN 'started' THEN kills > 0 AND NOT completed WHEN 'unfilled' THEN NOT known ELSE category = 'BUILDING' END""",
    "stream_windows": """SELECT CASE WHEN event_id % 13 <> 0 THEN epoch_us(ts) // 10800000000 * 10800000 END AS start, event_type, count(*) AS n FROM events GROUP BY ALL""",
    "stream_alerts": """SELECT DISTINCT event_type || '|' || (user_id % 10) AS alert_key, endpoint FROM events CROSS JOIN (VALUES ('e0'), ('e1')) v(endpoint)""",
    "stream_marks": """SELECT max(epoch_us(ts) // 1000) AS at, 'low' AS before FROM events WHERE event_id % 4 <> 0 AND event_id % 9 <> 0 UNION ALL SELECT 4000000000000, 'high'""",
}

ORACLES["stream_increase"] = oracles.ORACLES["snapshot_increase"]
ORACLES["patterns_ranked"] = f"""WITH found AS ({oracles.ORACLES["patterns"]}) SELECT row_number() OVER (ORDER BY world, start IS NULL, total DESC, boss) AS place, world, boss, total, start::BIGINT AS start FROM found"""
ORACLES["radar_order"] = """WITH p AS (
  SELECT o_orderkey, o_custkey % 5 = 0 AS favorite, epoch_us(o_orderdate::TIMESTAMP) // 1000 AS s FROM orders
), r AS (
  SELECT 'Order ' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS name, favorite, CASE WHEN s <= 836179200000 AND s + 86400000 >= 836179200000 THEN 'high' WHEN s + 86400000 < 836179200000 THEN 'late' WHEN s - 836179200000 <= 259200000 THEN 'medium' ELSE 'low' END AS status FROM p
) SELECT row_number() OVER (ORDER BY CASE status WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 WHEN 'unknown' THEN 3 ELSE 4 END, favorite DESC, name) AS place, name, status, favorite FROM r"""
ORACLES["progress_order"] = "SELECT row_number() OVER (ORDER BY c_name) AS place, c_name AS name, c_custkey % 9 AS kills FROM customer WHERE c_custkey % 9 < 5"
ORACLES["identified_order"] = """SELECT row_number() OVER (ORDER BY boss) AS place, boss, found, empty FROM (
  SELECT 'U' || lpad(CAST(user_id AS VARCHAR), 7, '0') AS boss, count(*) FILTER (WHERE value >= 50) AS found, count(*) FILTER (WHERE NOT coalesce(value >= 50, false)) AS empty FROM events GROUP BY 1)"""
ORACLES["state_view"] = """WITH c AS (SELECT event_id AS seq, user_id % 4 = 1 AS own, event_id % 11 = 0 AS image, value >= 50 OR (event_type = 'purchase' AND hour(ts) BETWEEN 9 AND 11) AS found FROM events),
l AS (SELECT 'checks' AS list, seq FROM c WHERE own UNION ALL SELECT 'images', seq FROM c WHERE image UNION ALL SELECT 'pending', seq FROM c WHERE found),
p AS (SELECT list, row_number() OVER (PARTITION BY list ORDER BY seq DESC) AS place, seq FROM l)
SELECT list, place, seq FROM p WHERE place <= CASE list WHEN 'checks' THEN 500 WHEN 'images' THEN 100 ELSE 50 END"""
ORACLES["added_images"] = """WITH e AS (
  SELECT event_id AS seq, user_id % 50 AS m, event_id % 300 AS h, user_id % 50 < 10 AND event_id % 300 < 150 AS there FROM events
), f AS (SELECT *, row_number() OVER (PARTITION BY m, h ORDER BY seq) AS nth FROM e
), t AS (SELECT *, m < 45 AND NOT there AND nth = 1 AS new FROM f
), n AS (SELECT *, sum(new::INTEGER) OVER (ORDER BY seq) AS place FROM t)
SELECT seq, sha256(sha256(CAST(m AS VARCHAR)) || '|' || sha256(CAST(h AS VARCHAR))) AS id, CASE WHEN m >= 45 THEN 'message' WHEN NOT new THEN 'stored' WHEN place > 500 THEN 'full' END AS error FROM n"""
ORACLES["stream_kept"] = f"""WITH every AS ({oracles.ORACLES["snapshot_thinning"]})
SELECT world, at FROM (SELECT *, row_number() OVER (PARTITION BY world ORDER BY "at" DESC) AS r FROM every) WHERE r <= 100"""
ORACLES["stream_sent_limit"] = """WITH k AS (SELECT DISTINCT lpad(CAST(user_id % 90 AS VARCHAR), 2, '0') AS key, user_id % 90 AS k FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY k < 60 ORDER BY key DESC) AS place, count(*) FILTER (WHERE k BETWEEN 60 AND 69) OVER () AS others FROM k)
SELECT key, CASE WHEN k < 60 AND place > 40 - others THEN 2 ELSE 1 END::BIGINT AS n FROM r"""
_LEFT = "(SELECT * FROM main.events WHERE (event_id // 100 % 5 <> 0 AND event_id // 100 % 7 <> 3) OR event_id // 100 % 10 = 0)"
ORACLES["stream_patterns"] = f"""WITH found AS ({oracles.ORACLES["patterns"]}), seen AS ({oracles.ORACLES["last_seen"]})
SELECT f.*, s.at, s.seq FROM found f LEFT JOIN seen s ON f.world = s.world AND f.boss = s.boss""".replace("FROM events", f"FROM {_LEFT} AS e")
_PATTERNS = oracles.ORACLES["patterns"]
ORACLES["pattern_cards"] = f"""WITH found AS ({_PATTERNS}), names AS (SELECT DISTINCT event_type AS name FROM events UNION ALL SELECT 'none')
SELECT name, total, found.found, days, start FROM names LEFT JOIN found ON boss = name AND world = 'W1'"""

# --- texts and reports: the same rows as in domain.py, read by patterns of their own ---

_W = r"[\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def _list(values) -> str:
    quoted = ", ".join("'" + v.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\r", "' || chr(13) || '").replace("\t", "' || chr(9) || '") + "'" for v in values)
    return f"[{quoted}]"


def _pick(number: str, values) -> str:
    return f"{_list(values)}[1 + ({number}) % {len(values)}]"


_N = len(SAID)
_BEFORE, _BETWEEN, _END = (_pick(f"event_id // {3 * _N}", [s[i] for s in SPACES]) for i in range(3))
_NO = "n(?:a|ã|Ã)o (?:estavam?|encontrad[oa]s?|achei|encontrei)"
_STAMP = rf"^\[?(\d{{1,2}}):(\d{{2}})(?:,?{_W}+(\d{{1,2}})/(\d{{1,2}})/(\d{{2,4}}))?\]?{_W}*(?:[^:]{{1,60}}:{_W}*)?"
_REPORTS = rf"""cased AS (
  SELECT *, CASE event_id // {_N} % 3 WHEN 0 THEN upper(t) WHEN 1 THEN lower(t) ELSE t END AS c FROM (SELECT *, {_pick("event_id", SAID)} AS t FROM events)
), m AS (
  SELECT event_id, sha256(CAST(event_id AS VARCHAR)) AS id, {_BEFORE} || replace(replace(c, ' ', {_BETWEEN}), chr(10), {_END} || {_BEFORE}) AS text, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, strftime(ts, '%H:%M') AS time, event_id % 5 = 0 AS media, epoch_us(ts) // 1000 AS at FROM cased
), names(boss, place) AS (VALUES {", ".join(f"('{n}', {i})" for i, n in enumerate(NAMES))}
), named AS (
  SELECT event_id, list(boss ORDER BY boss) AS mentioned FROM m JOIN names ON contains(lower(strip_accents(text)), lower(boss)) GROUP BY event_id
), seen AS (
  SELECT m.*, coalesce(mentioned, []) AS mentioned, regexp_matches(lower(strip_accents(text)), '[?]|\b(?:vou|vamos|sera|talvez|se aparecer|amanha|ontem|anteontem)\b') AS review FROM m LEFT JOIN named USING (event_id)
), lines AS (
  SELECT id, date, time, unnest(regexp_split_to_array(text, '\r?\n')) AS raw, generate_subscripts(regexp_split_to_array(text, '\r?\n'), 1) - 1 AS line FROM seen WHERE NOT review
), stamped AS (
  SELECT *, regexp_matches(raw, s) AS has, regexp_extract(raw, s, 1) AS hh, regexp_extract(raw, s, 2) AS mi, regexp_extract(raw, s, 3) AS dd, regexp_extract(raw, s, 4) AS mo, regexp_extract(raw, s, 5) AS yy, regexp_replace(regexp_replace(raw, s, ''), '^[•*\-]{_W}*', '') AS body
  FROM (SELECT * REPLACE (regexp_replace(raw, '^{_W}+|{_W}+$', '', 'g') AS raw), '{_STAMP}' AS s FROM lines) WHERE raw <> ''
), told AS (
  SELECT *, CASE WHEN regexp_matches(f, 'nao (?:achei|acharam|encontrei|encontraram|estava|estavam|encontrado)|ausente|vazio|❌|❎') THEN 'vazio' WHEN regexp_matches(f, 'encontrei|encontrado|encontraram|estava|presente|acharam|achei|✅') THEN 'encontrado' END AS own,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '❌|❎|✅', '', 'g'), '(?i){_W}*(?:;|=|:|{_W}){_W}*(?:{_NO}|vazio|ausente|presente|encontrado|estavam?){_W}*$', ''), '(?i)^(?:{_NO}|ausentes?|vazios?|estavam?|encontrad[oa]s?|presentes?|achei|encontrei){_W}*[:\-]?{_W}*', ''), '^{_W}+|{_W}+$', '', 'g') AS cleaned
  FROM (SELECT *, lower(strip_accents(body)) AS f FROM stamped)
), marked AS (
  SELECT *, (cleaned = '' AND own IS NOT NULL) OR regexp_matches(body, '(?i)^(?:bosses?{_W}+)?(?:n(?:a|ã|Ã)o estavam|n(?:a|ã|Ã)o encontrados|ausentes|vazios|encontrados|presentes|estavam){_W}*:?$') AS heading FROM told
), carried AS (
  SELECT *, last_value(CASE WHEN heading THEN own END IGNORE NULLS) OVER (PARTITION BY id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS context FROM marked
), split AS (
  SELECT id, line, coalesce(own, context) AS result, CASE WHEN dd <> '' THEN CASE WHEN length(yy) = 2 THEN '20' ELSE '' END || yy || '-' || lpad(mo, 2, '0') || '-' || lpad(dd, 2, '0') ELSE date END AS date, CASE WHEN has THEN lpad(hh, 2, '0') || ':' || mi ELSE time END AS time,
    list_filter(regexp_split_to_array(cleaned, '{_W}*[,;]{_W}*'), lambda x: x <> '') AS l FROM carried WHERE NOT heading
), parts AS (
  SELECT id, line, result, date, time, unnest(l) AS said, generate_subscripts(l, 1) - 1 AS part FROM split
), keyed AS (
  SELECT *, CASE k WHEN 'pantera' THEN 'midnightpanther' WHEN 'panther' THEN 'midnightpanther' WHEN 'murius' THEN 'generalmurius' ELSE k END AS key FROM (SELECT *, regexp_replace(lower(strip_accents(said)), '[^a-z0-9]', '', 'g') AS k FROM parts)
), rows AS (
  SELECT id, line, part, boss, result, date, time FROM keyed LEFT JOIN names ON key = regexp_replace(lower(boss), '[^a-z0-9]', '', 'g')
), state AS (
  SELECT id, count(*) FILTER (WHERE boss IS NOT NULL AND result IS NOT NULL) AS good, count(*) FILTER (WHERE boss IS NULL OR result IS NULL) AS bad, list(boss ORDER BY line, part) FILTER (WHERE boss IS NOT NULL AND result IS NOT NULL) AS told FROM rows GROUP BY id
), judged AS (
  SELECT seen.*, told, review OR coalesce(bad, 0) > 0 OR coalesce(good, 0) = 0 AND len(mentioned) > 0 AS pending FROM seen LEFT JOIN state USING (id)
)"""
ORACLES["chat_reports"] = f"WITH {_REPORTS} SELECT id, line::INTEGER AS line, part::INTEGER AS part, boss, result, date, time FROM rows WHERE boss IS NOT NULL AND result IS NOT NULL"
ORACLES["chat_reviews"] = f"""WITH {_REPORTS}, named_ones AS (
  SELECT *, list_concat(mentioned, list_filter(coalesce(told, []), lambda x, i: NOT list_contains(mentioned, x) AND list_position(told, x) = i)) AS every FROM judged
) SELECT id, CASE WHEN pending THEN array_to_string(mentioned[:20], ',') END AS waiting, CASE WHEN pending THEN date END AS date, CASE WHEN pending THEN time END AS time,
  CASE WHEN pending THEN CASE WHEN media AND len(mentioned) = 0 THEN 'photo' ELSE 'unclear' END END AS reason, CASE WHEN len(every) > 0 THEN array_to_string(every, ',') END AS bosses
FROM named_ones WHERE pending OR len(every) > 0"""
ORACLES["relevant_messages"] = f"""WITH {_REPORTS} SELECT id, media, CASE WHEN event_id % 4 <> 0 THEN at END AS at FROM seen WHERE media OR len(mentioned) > 0 AND (event_id % 4 = 0 OR at >= 1705000000000)"""

ORACLES["stream_sync"] = f"""WITH {_REPORTS}, good AS (SELECT DISTINCT r.* EXCLUDE (id, line, part) FROM rows r JOIN m USING (id) WHERE boss IS NOT NULL AND result IS NOT NULL AND event_id % 3 <> 0)
SELECT boss, date, time, result, 'whatsapp' AS origin, epoch_ms(CAST(date || ' ' || time || ':00' AS TIMESTAMP)) + 10800000 AS at, CAST(NULL AS VARCHAR) AS reason FROM good
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, max(at), 'text' FROM m WHERE event_id % 3 = 1"""

_SPACE, _DOT, _HALF, _YEAR = _pick("event_id", ("", " ", " ", " ")), _pick("event_id // 4", ("/", ".", "-")), _pick("event_id // 12", ("", "AM", "pm", "PM")), _pick("event_id // 5", ("2024", "26", "025", "2023"))
_CHAT = rf"(?i)\[(\d{{1,2}}):(\d{{2}})(?:{_W}*([AP]M))?,{_W}*(\d{{1,2}})[/.\-](\d{{1,2}})[/.\-](\d{{2,4}})\]"
ORACLES["chat_stamps"] = f"""WITH given AS (
  SELECT event_id, 'x [' || (event_id % 27) || ':' || lpad(CAST(event_id % 67 AS VARCHAR), 2, '0') || CASE WHEN {_HALF} = '' THEN '' ELSE {_SPACE} || {_HALF} END || ',' || {_SPACE} || (event_id % 32) || {_DOT} || (event_id % 13) || {_DOT} || {_YEAR} || '] Ana: ' AS s FROM events
), parts AS (
  SELECT event_id, CAST(regexp_extract(s, p, 1) AS INTEGER) AS h, regexp_extract(s, p, 2) AS mi, upper(regexp_extract(s, p, 3)) AS half, regexp_extract(s, p, 4) AS d, regexp_extract(s, p, 5) AS mo, regexp_extract(s, p, 6) AS y FROM (SELECT *, '{_CHAT}' AS p FROM given)
), whole AS (
  SELECT event_id, CASE half WHEN 'PM' THEN h % 12 + 12 WHEN 'AM' THEN h % 12 ELSE h END AS h, mi, CASE WHEN length(y) = 2 THEN '20' || y ELSE y END || '-' || lpad(mo, 2, '0') || '-' || lpad(d, 2, '0') AS day FROM parts
), good AS (SELECT *, coalesce(h < 24 AND CAST(mi AS INTEGER) < 60 AND length(day) = 10 AND CAST(try_cast(day AS DATE) AS VARCHAR) = day, false) AS ok FROM whole)
SELECT event_id, CASE WHEN ok THEN lpad(CAST(h AS VARCHAR), 2, '0') || ':' || mi END AS time, CASE WHEN ok THEN day END AS date FROM good"""
ORACLES["screen_names"] = f"""WITH t AS (
  SELECT c_custkey, strip_accents(regexp_replace(chr(8206) || ' ' || chr(8239) || c_name || {_pick("c_custkey", (" X‪ ", "　X ﻿", "  X "))} || c_mktsegment || chr(8236) || chr(8297) || ' ', '[\\x{{200e}}\\x{{200f}}\\x{{202a}}-\\x{{202e}}]', '', 'g')) AS t FROM customer
) SELECT c_custkey, lower(replace(regexp_replace(regexp_replace(t, '{_W}+', ' ', 'g'), '^ | $', '', 'g'), ' X ', ' e ')) AS name FROM t"""
#: OTHERS folded, from the definition of canonical decomposition.
_FOLDED = ("\u03b1\u03b4\u03b7\u03c2 \u03b9", "\u0438\u043e\u0436\u0438\u043a \u0435\u043b\u043a\u0430", "\u1112\u1161\u11ab\u1100\u116e\u11a8\u110b\u1165 \u1100\u1161\u11a8", "\u30ab\u3099\u30cf\u309a\u3046\u3099", "\u05d0\u05b7\u05e9\u05bc", "\u0915\u093c\u0930\u093c", "e u o", "ka\u03c9", "\u05e9\u05b8\u05bc\u05c1 q")
ORACLES["folded_texts"] = f"""WITH t AS (SELECT doc_id, lower(strip_accents(coalesce(text, ''))) || ' ' || {_pick("doc_id", _FOLDED)} AS t FROM documents) SELECT doc_id, length(t) AS chars, sha256(t) AS sha256 FROM t"""

# "at" is a word of its own in DuckDB.
ORACLES = {name: re.sub(r"(?<!\")\bat\b(?!\")", '"at"', sql) for name, sql in ORACLES.items()}

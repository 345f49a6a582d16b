"""DuckDB SQL for the operators that SQL can express; written from their definitions, not from their code."""

from __future__ import annotations

from .licenses import TEMPLATES

_OP3 = r"""
WITH lines AS (
  SELECT doc_id, pos, list_extract(l, pos) AS line
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), keyed AS (
  SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), firsts AS (
  SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k
), marked AS (
  SELECT doc_id, pos, line, coalesce(doc_id <> first, false) AS gone FROM keyed LEFT JOIN firsts USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_OP8 = r"""
WITH raw AS (
  SELECT 'd' AS side, doc_id AS id, string_split(trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g')), ' ') AS l FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 'b', item_id, string_split(trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g')), ' ') FROM benchmark WHERE text IS NOT NULL
), words AS (
  SELECT side, id, list_filter(list_transform(l, lambda x: lower(regexp_replace(x, '[^\pL\pN\pM]+', '', 'g'))), lambda x: x <> '') AS w FROM raw
), items AS (
  SELECT id, w, least(5, len(w)) AS n FROM words WHERE side = 'b' AND len(w) > 0
), item_shingles AS (
  SELECT DISTINCT id AS item_id, n, array_to_string(list_slice(w, pos, pos + n - 1), ' ') AS s FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM items)
), widths AS (SELECT DISTINCT n FROM items
), doc_shingles AS (
  SELECT DISTINCT id AS doc_id, n, array_to_string(list_slice(w, pos, pos + n - 1), ' ') AS s
  FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM words, widths WHERE side = 'd' AND len(w) >= n)
), sizes AS (SELECT item_id, count(*) AS n_shingles FROM item_shingles GROUP BY item_id
), pairs AS (SELECT doc_id, item_id, count(*) AS n_found FROM doc_shingles JOIN item_shingles USING (n, s) GROUP BY ALL)
SELECT doc_id, item_id, n_shingles, n_found FROM pairs JOIN sizes USING (item_id) WHERE 10 * n_found >= 8 * n_shingles
"""

_OP9 = r"""
WITH words AS (
  SELECT doc_id, source, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), windows AS (
  SELECT doc_id, pos, array_to_string(list_slice(w, pos, pos + 4), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS pos FROM words)
), twice AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, s) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(pos, pos + 5)) AS p FROM twice) GROUP BY doc_id
), base AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN covered USING (doc_id)
), judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base
), hosts AS (
  SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (WHERE base_failed)::DOUBLE AS k FROM judged WHERE source IS NOT NULL GROUP BY source
), total AS (
  SELECT sum(k) / sum(n) AS m, sum(k * k / n) / sum(n) AS q, count(*) AS h, sum(n) AS n FROM hosts
), prior AS (
  SELECT m, least(greatest(m * (1 - m) / greatest(q - m * m - h * m * (1 - m) / n, 1e-9) - 1, 1.0), 1e6) AS strength FROM total
), verdicts AS (
  SELECT source, (k + m * strength) / (n + strength) > 0.5 AS bad FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(bad, false) AS kept, coalesce(bad, false) AS host_failed
FROM judged LEFT JOIN verdicts USING (source)
"""

_QUOTED = ", ".join("({}, '{}', '{}')".format(i, licence, text.replace("'", "''")) for i, (licence, text) in enumerate(TEMPLATES))
_OP4 = (
    "WITH given(template, licence, text) AS (VALUES " + _QUOTED + "), "
    + r"""units AS (
  SELECT 'd' AS side, doc_id AS id, unnest(string_split(coalesce(text, ''), chr(10))) AS unit FROM documents
  UNION ALL SELECT 'd', doc_id, text FROM documents WHERE contains(text, chr(10))
  UNION ALL SELECT 'd', doc_id, unit FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\n(?:[ \t]*\n)+')) AS unit FROM documents WHERE regexp_matches(text, '\n[ \t]*\n')) WHERE contains(unit, chr(10))
  UNION ALL SELECT 't', template, text FROM given
), words AS (
  SELECT side, id, row_number() OVER () AS u, list_filter(string_split(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM units
), pairs AS (
  SELECT DISTINCT side, id, u, w[pos] || ' ' || w[pos + 1] AS b FROM (SELECT side, id, u, w, unnest(range(1, len(w))) AS pos FROM words)
), sizes AS (SELECT side, id, u, count(*) AS n FROM pairs GROUP BY ALL
), common AS (
  SELECT d.id AS doc_id, d.u, t.id AS template, count(*) AS c FROM pairs d JOIN pairs t USING (b) WHERE d.side = 'd' AND t.side = 't' GROUP BY ALL
), scored AS (
  SELECT doc_id, common.u, template, 2.0 * c / (sd.n + st.n) AS dice FROM common JOIN sizes sd ON sd.side = 'd' AND sd.u = common.u JOIN sizes st ON st.side = 't' AND st.id = template
), best AS (
  SELECT doc_id, template, dice FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY dice DESC, template) AS r FROM scored WHERE dice >= 0.8 - 1e-9) WHERE r = 1
)
SELECT documents.doc_id, count(template) AS n_matches, coalesce(string_agg(DISTINCT licence, ',' ORDER BY licence), '') AS licences, round(coalesce(max(dice), 0)::DOUBLE, 6) AS dice
FROM documents LEFT JOIN (best JOIN given USING (template)) f USING (doc_id) GROUP BY documents.doc_id
"""
)

_OP7 = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), turns AS (
  SELECT *, role IS DISTINCT FROM lag(role) OVER o AS opens, role IS DISTINCT FROM lead(role) OVER o AS closes, row_number() OVER o AS pos,
    length(text) + len(regexp_extract_all(text, '<(\\*)(/?s>|\+>|<SYS>>|</SYS>>)')) + len(regexp_extract_all(text, '\[(\\*)(/?INST\])')) AS escaped
  FROM given WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(escaped + CASE WHEN NOT opens THEN 5 WHEN role = 'user' THEN 7 WHEN role = 'assistant' THEN 1 ELSE 9 + length(url_encode(role)) END
    + CASE WHEN NOT closes THEN 0 WHEN role = 'user' THEN 8 WHEN role = 'assistant' THEN 5 ELSE 9 END))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

_OP12 = r"""
WITH docs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents
), asked AS (
  SELECT item_id, t, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark
  ) GROUP BY ALL
), held AS (SELECT doc_id, t, count(*) AS tf FROM docs GROUP BY ALL
), sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM held GROUP BY doc_id
), totals AS (SELECT count(*) AS nd, sum(n)::BIGINT AS l FROM sizes
), weights AS (SELECT t, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM held, totals GROUP BY t, nd
), shares AS (
  SELECT doc_id, t, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // l)) AS s FROM held JOIN sizes USING (doc_id), totals WHERE t IN (SELECT t FROM asked)
), scores AS (SELECT item_id, doc_id, sum(times * w * s)::BIGINT AS score FROM asked JOIN shares USING (t) JOIN weights USING (t) GROUP BY ALL
), ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""

_OP13 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, pos, pos + 3), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS pos FROM words WHERE len(w) > 0)
), sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN sizes u ON u.doc_id = a JOIN sizes v ON v.doc_id = b WHERE 100 * c >= 80 * (u.n + v.n - c)
), reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id <= coalesce(m, doc_id) AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""

ORACLES = {
    "op4_licenses": _OP4,
    "op7_chat": _OP7,
    "op3_line_dedup": _OP3,
    "op8_decontaminate": _OP8,
    "op9_quality": _OP9,
    "op12_ranked_search": _OP12,
    "op13_setsketch": _OP13,
}

"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

from .licenses import TEMPLATES, THRESHOLD, anchors, template_bigrams

OP1 = r"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i,
    len(regexp_extract_all(text, '[^ \t\n\r]+')) + 4 AS tok,
    length(replace(replace(replace(role, '\', '\s'), chr(10), '\n'), '<|', '<\p'))
      + length(replace(replace(text, '\', '\s'), '<|', '<\p')) + length('<|im_start|>') + 1 + length('<|im_end|>') + 1 AS chars
  FROM raw
), p AS (
  SELECT *, coalesce(sum(tok) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prefix,
    max(CASE WHEN i = 0 AND role = 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS sys,
    max(CASE WHEN i = 0 AND role = 'system' THEN tok ELSE 0 END) OVER (PARTITION BY conv_id) AS sys_tok,
    max(CASE WHEN i = 0 AND role = 'system' THEN chars ELSE 0 END) OVER (PARTITION BY conv_id) AS sys_chars
  FROM t
), f AS (
  SELECT conv_id, i, i AS first, 0 AS win FROM p WHERE i = 0
  UNION ALL
  SELECT p.conv_id, p.i,
    CASE WHEN p.i <= p.sys THEN p.sys WHEN p.prefix + p.tok - q.prefix > greatest(1, 288 - p.sys_tok) THEN p.i ELSE q.i END,
    f.win + CASE WHEN p.i > p.sys AND p.prefix + p.tok - q.prefix > greatest(1, 288 - p.sys_tok) THEN 1 ELSE 0 END
  FROM f JOIN p ON p.conv_id = f.conv_id AND p.i = f.i + 1
  JOIN p q ON q.conv_id = f.conv_id AND q.i = CASE WHEN p.i <= p.sys THEN p.i ELSE greatest(f.first, p.sys) END
), again AS (
  SELECT w.conv_id, sum(p.sys_chars / 1) FILTER (WHERE p.i = w.first) AS system, sum(p.chars) FILTER (WHERE p.i >= p.sys AND p.i < w.first AND h.prefix - p.prefix <= 96) AS history,
    count(DISTINCT w.win) AS n
  FROM (SELECT DISTINCT conv_id, win, first FROM f WHERE win > 0) w
  JOIN p h ON h.conv_id = w.conv_id AND h.i = w.first
  JOIN p ON p.conv_id = w.conv_id AND p.i <= w.first
  GROUP BY w.conv_id
)
SELECT t.conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY t.i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY t.i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) + coalesce(max(system), 0) + coalesce(max(history), 0) AS BIGINT) AS formatted_chars,
  CAST(1 + coalesce(max(n), 0) AS BIGINT) AS n_windows
FROM t LEFT JOIN again ON again.conv_id = t.conv_id
GROUP BY t.conv_id
"""


def _op2() -> str:
    known = sorted((name, template_bigrams(text)) for name, text in TEMPLATES)
    quoted = lambda grams: "[" + ", ".join(f"'{g}'" for g in grams) + "]"
    found = sorted({x for _, text in TEMPLATES for x in anchors(text, THRESHOLD)})
    marks = ", ".join(f"('{w}', {place}, {n})" for w, place, n in found)
    values = ", ".join(f"({k}, '{name}', {quoted(grams)})" for k, (name, grams) in enumerate(known))
    return f"""
WITH templates(k, name, ref) AS (VALUES {values}),
anchors(word, place, n) AS (VALUES {marks}),
u AS (
  SELECT doc_id, unnest(CASE WHEN contains(text, chr(10)) THEN list_append(string_split(text, chr(10)), text) ELSE [text] END) AS unit
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
), whole AS (
  SELECT row_number() OVER () AS d, doc_id,
    list_filter(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w
  FROM documents
), placed AS (
  SELECT d, unnest(range(len(w))) AS i, unnest(w) AS word FROM whole
), spans AS (
  SELECT DISTINCT d, greatest(i - place, 0) AS start, n FROM placed JOIN anchors ON anchors.word = placed.word
), w AS (
  SELECT doc_id, row_number() OVER () AS id, w FROM (
    SELECT doc_id,
      list_filter(string_split(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w
    FROM u
    UNION ALL SELECT doc_id, w[start + 1 : start + n] FROM spans JOIN whole ON whole.d = spans.d)
), g AS (
  SELECT doc_id, id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS grams FROM w WHERE len(w) > 1
), d AS (
  SELECT doc_id, id, k, name, 2e0 * len(list_intersect(grams, ref)) / (len(grams) + len(ref)) AS dice
  FROM g, templates WHERE len(grams) BETWEEN len(ref) * 0.6 AND len(ref) * 1.6
), best AS (
  SELECT * FROM d WHERE dice >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY id ORDER BY dice DESC, k) = 1
), found AS (
  SELECT doc_id, count(*) AS n_units, array_to_string(list_sort(list_distinct(list(name))), ',') AS licenses,
    first(name ORDER BY dice DESC, k) AS license, max(dice) AS dice
  FROM best GROUP BY doc_id
)
SELECT documents.doc_id, license, round(coalesce(dice, 0e0), 6) AS dice, coalesce(n_units, 0) AS n_units, coalesce(licenses, '') AS licenses
FROM documents LEFT JOIN found ON found.doc_id = documents.doc_id
"""

#: CRC-32 of each different word, byte by byte through a table that is made of the polynomial.
OP13 = r"""
WITH w AS (
  SELECT 0 AS side, doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 1, 0, coalesce(text, '') FROM benchmark
), f AS (
  SELECT side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM w
), steps AS (
  SELECT list(c ORDER BY i) AS steps FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))
), crc AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(word))), lambda k: ('0x' || substr(hex(encode(word)), 2 * k + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, steps[xor(c, b) % 256 + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM f), steps
), b AS (
  SELECT bucket, count(*) FILTER (WHERE side = 0) AS s, count(*) FILTER (WHERE side = 1) AS t FROM f JOIN crc USING (word) GROUP BY bucket
), g AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM b) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM b) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM b
), d AS (
  SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS given FROM f JOIN crc USING (word) JOIN g USING (bucket) WHERE side = 0 GROUP BY doc_id
), x AS (
  SELECT documents.doc_id, coalesce(n_features, 0) AS n_features, coalesce((given - ((given % n_features) + n_features) % n_features) // n_features, 0) AS weight,
    ('0x' || substr(sha256('2024:' || documents.doc_id), 1, 8))::BIGINT AS h
  FROM documents LEFT JOIN d USING (doc_id)
), y AS (
  SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM x
), r AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS k, count(*) OVER () AS n FROM y WHERE n_features >= 20
)
SELECT y.doc_id, n_features, weight, score, CASE WHEN k <= 10 * n // 100 THEN k END AS rank FROM y LEFT JOIN r USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": OP1, "op2_license_scan": _op2(), "op13_importance_resampling": OP13}

"""DuckDB SQL for those registered queries that SQL can express."""

from __future__ import annotations

from palisade.llm import quality_rules

_STOP_LIST = ", ".join(f"'{w}'" for w in quality_rules.STOP_FORMS)

QUALITY = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS txt,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
grams AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g
          FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM t WHERE len(ws) > 5)),
twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, CAST(count(DISTINCT i + k) AS BIGINT) AS n FROM twice, range(5) AS r(k) GROUP BY doc_id),
m AS (
  SELECT t.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(txt) - length(regexp_replace(txt, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words,
         CAST(len(list_filter(ws, lambda x: list_contains([{_STOP_LIST}], x))) AS BIGINT) AS n_stop_words
  FROM t LEFT JOIN rep ON t.doc_id = rep.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed
       AND word_chars / n_words BETWEEN 2.0 AND 20.0
       AND n_symbols / n_words <= 0.5
       AND (n_words < 30 OR n_stop_words / n_words >= 0.02)
       AND (n_lines = 0 OR n_dup_lines / n_lines <= 0.5) AS kept
FROM b
"""

CONTAINMENT = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM benchmark),
widths AS (SELECT DISTINCT least(5, len(ws)) AS w FROM b WHERE len(ws) > 0),
dg AS (SELECT DISTINCT doc_id, w, array_to_string(ws[i:i + w - 1], ' ') AS g FROM (SELECT doc_id, ws, w, unnest(range(1, len(ws) - w + 2)) AS i FROM d, widths WHERE len(ws) >= w)),
bg AS (SELECT DISTINCT item_id, w, array_to_string(ws[i:i + w - 1], ' ') AS g FROM (SELECT item_id, ws, least(5, len(ws)) AS w, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
n AS (SELECT item_id, count(*) AS n_item FROM bg GROUP BY item_id)
SELECT dg.doc_id, bg.item_id, CAST(any_value(n_item) AS BIGINT) AS n_item, CAST(count(*) AS BIGINT) AS n_found, count(*) / any_value(n_item) AS containment
FROM bg JOIN dg ON bg.w = dg.w AND bg.g = dg.g JOIN n ON n.item_id = bg.item_id
GROUP BY dg.doc_id, bg.item_id HAVING count(*) >= 0.8 * any_value(n_item) - 1e-9
"""

MIXING = """
WITH size AS (SELECT source, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS size FROM documents GROUP BY source),
raw AS (SELECT *, CASE WHEN size > 0 THEN pow(CAST(size AS DOUBLE), 0.5) ELSE 0.0 END AS r FROM size),
rate AS (SELECT source, CASE WHEN size > 0 THEN r / (SELECT sum(r) FROM raw) * (SELECT sum(size) FROM raw) / size ELSE 1.0 END AS rate FROM raw),
part AS (SELECT source, greatest(1, CAST(ceil(rate / 8.0) AS INTEGER)) AS m, rate / greatest(1, CAST(ceil(rate / 8.0) AS INTEGER)) AS mean FROM rate WHERE rate > 0),
mass AS (SELECT source, m, list_transform(range(0, 64), lambda i: exp(i * ln(mean) - mean - (CASE WHEN i < 2 THEN 0 ELSE lgamma(i + 1) END))) AS p FROM part),
curve AS (SELECT source, m, list_transform(range(1, 65), lambda i: list_sum(p[1:i])) AS c FROM mass),
draw AS (SELECT d.*, CAST((SELECT sum(len(list_filter(c, lambda x: x <= CAST(('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || j), 1, 13)) AS BIGINT) / 4503599627370496.0)))
                         FROM range(1, m + 1) AS t(j)) AS BIGINT) AS n
         FROM documents d JOIN curve ON d.source IS NOT DISTINCT FROM curve.source)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy,
       CAST(('0x' || substr(md5('order-17:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || copy), 1, 15)) AS BIGINT) AS shuffle_key
FROM (SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n + 1)) AS copy FROM draw)
"""

CHAT = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
           UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(text, '([<\[])(\\*)(s>|/s>|INST\]|/INST\]|SYS\]|/SYS\]|ROLE\]|TEXT\]|/ROLE\])', '\1\\\2\3', 'g')) AS t,
             length(regexp_replace(role, '([<\[])(\\*)(s>|/s>|INST\]|/INST\]|SYS\]|/SYS\]|ROLE\]|TEXT\]|/ROLE\])', '\1\\\2\3', 'g')) AS r
      FROM c),
g AS (SELECT conv_id, count(*) AS n_turns,
             string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
             coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
             3 + sum(CASE role WHEN 'user' THEN t + 15 WHEN 'system' THEN t + 13 WHEN 'assistant' THEN t + 5 ELSE r + t + 23 END) AS chars
      FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM g
"""

#: Unsigned CRC-32 of the digits of an integer, which DuckDB has no function for.
_CRC_MACRO = """
crc_table AS (SELECT list(list_reduce(range(8), lambda acc, bit: CASE WHEN acc % 2 = 1 THEN xor(3988292384, acc // 2) ELSE acc // 2 END, CAST(i AS BIGINT)) ORDER BY i) AS t FROM range(256) AS r(i))"""


def _crc(id_col: str) -> str:
    """`t` of crc_table must be in scope."""
    return f"""xor(4294967295, list_reduce(list_transform(string_split(CAST({id_col} AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)), lambda acc, b: xor(acc // 256, t[1 + xor(acc, b) % 256]), CAST(4294967295 AS BIGINT)))"""


DOMINANCE = f"""
WITH {_CRC_MACRO.strip()},
s AS (SELECT sale_id, CAST(floor(epoch(sold_at) / 3600) AS BIGINT) AS slot, CAST(floor(floor(100 * total + 0.5) / 100) AS BIGINT) AS lev, 1 + {_crc("sale_id")} % 2 AS weight FROM sales, crc_table),
cell AS (SELECT slot, lev, count(*) AS n, sum(weight) AS w FROM s WHERE slot IS NOT NULL AND lev IS NOT NULL GROUP BY slot, lev),
above AS (SELECT b.slot, b.lev, CAST(coalesce(sum(a.n), 0) AS BIGINT) AS n_sales, CAST(coalesce(sum(a.w), 0) AS BIGINT) AS n_rows
          FROM cell b LEFT JOIN cell a ON a.slot <= b.slot AND a.lev > b.lev GROUP BY b.slot, b.lev)
SELECT s.sale_id, s.slot, s.lev AS level, n_sales, n_rows FROM s LEFT JOIN above ON s.slot = above.slot AND s.lev = above.lev
"""



def _field(column: str, size: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE {size} || ':' || {column} END"


def _leaf(text: str) -> str:
    """Numbers have one byte for each digit."""
    parts = [_field(c, f"strlen(CAST({c} AS VARCHAR))") for c in ("doc_id", "source", "lang", "n_chars")]
    return "sha256(" + " || ".join([*parts, _field(text, f"strlen({text})")]) + ")"


MERKLE = f"""
WITH RECURSIVE {_CRC_MACRO.strip()},
d AS (SELECT *, CASE WHEN {_crc("doc_id")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed FROM documents, crc_table),
hashed AS (SELECT doc_id, coalesce('s' || source, 'n') AS g, {_leaf("text")} AS h, {_leaf("changed")} AS now FROM d),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM hashed),
up AS (
  SELECT g, 0 AS level, pos, n, h, '' AS pre FROM leaves
  UNION ALL
  SELECT g, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)), string_agg(h, '' ORDER BY pos)
  FROM up WHERE n > 1 GROUP BY g, level, n, pos // 3),
subs AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT 0 AS level, pos, n, h, '' AS pre FROM subs
  UNION ALL
  SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)), string_agg(h, '' ORDER BY pos)
  FROM top WHERE n > 1 GROUP BY level, n, pos // 3),
steps AS (
  SELECT l.g, l.pos AS leaf_at, p.level, p.pre, (l.pos // CAST(pow(3, p.level - 1) AS BIGINT)) % 3 AS slot
  FROM leaves l JOIN up p ON p.level > 0 AND p.g = l.g AND p.pos = l.pos // CAST(pow(3, p.level) AS BIGINT)
  UNION ALL
  SELECT l.g, l.pos, 1000 + p.level, p.pre, (s.pos // CAST(pow(3, p.level - 1) AS BIGINT)) % 3
  FROM leaves l JOIN subs s ON s.g = l.g JOIN top p ON p.level > 0 AND p.pos = s.pos // CAST(pow(3, p.level) AS BIGINT)),
paths AS (SELECT g, leaf_at, list({{'pre': pre, 'slot': slot}} ORDER BY level) AS path FROM steps GROUP BY g, leaf_at),
proved AS (
  SELECT l.doc_id, l.h AS leaf, s.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root,
         sha256(coalesce(array_to_string(list_transform(path, lambda p: left(p.pre, 64 * p.slot) || substr(p.pre, 64 * p.slot + 65)), ''), '')) AS proof_sha256,
         coalesce(list_reduce(list_transform(path, lambda p: [p.pre, CAST(p.slot AS VARCHAR)]),
                              lambda acc, p: [sha256(left(p[1], 64 * CAST(p[2] AS BIGINT)) || acc[1] || substr(p[1], 64 * CAST(p[2] AS BIGINT) + 65)), ''],
                              [l.now, ''])[1], l.now) AS folded_root
  FROM leaves l JOIN subs s ON s.g = l.g LEFT JOIN paths ON paths.g = l.g AND paths.leaf_at = l.pos)
SELECT *, folded_root = root AS verified FROM proved
"""

ORACLE_SQL: dict[str, str] = {
    "op4_poisson_mixing": MIXING,
    "op8_decontamination": CONTAINMENT,
    "op9_quality_rules": QUALITY,
    "op10_chat_formatting": CHAT,
    "op11_dominance_counting": DOMINANCE,
    "op12_merkle_manifest": MERKLE,
}

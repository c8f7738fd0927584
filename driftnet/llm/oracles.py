"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP4 = r"""
WITH lines AS (
  SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '(?s).+?(?:\n[ \t\n\r\f]*|\z)') AS raw FROM documents
), w AS (
  SELECT doc_id, i AS pos, trim(raw[i], E' \t\n\r\f') || E'\n' || trim(raw[i + 1], E' \t\n\r\f') || E'\n' || trim(raw[i + 2], E' \t\n\r\f') AS k
  FROM (SELECT doc_id, raw, unnest(range(1, greatest(len(raw) - 1, 1)::BIGINT)) AS i FROM lines)
), later AS (
  SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS rn FROM w) WHERE rn > 1
), gone AS (
  SELECT DISTINCT doc_id, pos + d AS pos FROM later, (VALUES (0), (1), (2)) AS v(d)
), kept AS (
  SELECT l.doc_id, string_agg(l.x, '' ORDER BY l.pos) FILTER (WHERE g.pos IS NULL) AS text, count(g.pos) AS n_removed
  FROM (SELECT doc_id, unnest(raw) AS x, unnest(range(1, len(raw) + 1)) AS pos FROM lines) l
  LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN coalesce(k.n_removed, 0) = 0 THEN d.text ELSE coalesce(k.text, '') END AS text,
  len(d.raw)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed
FROM lines d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

OP2 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) + 22 AS n,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM c
), s AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY back DESC) AS stop FROM e
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY back DESC)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY back DESC) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (sum(stop) FILTER (WHERE role = 'assistant' OR back = 1))::BIGINT AS formatted_chars,
  count(*) FILTER (WHERE role = 'assistant' OR back = 1)::BIGINT AS n_examples
FROM s GROUP BY conv_id
"""

OP8 = r"""
WITH item_words AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 9), ' ') AS win, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)
), d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), places AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d
), m AS (
  SELECT a.doc_id, a.i, a.n, wins.item_id FROM (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win FROM places, (SELECT DISTINCT n FROM wins) WHERE i + n - 1 <= len(w)) a
  JOIN wins ON wins.win = a.win AND wins.n = a.n
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM m) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP11 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), grams AS (
  SELECT row, i, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT row, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
), twice AS (
  SELECT row, i FROM (SELECT *, count(*) OVER (PARTITION BY row, g) AS n FROM grams) WHERE n > 1
), rep AS (
  SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY row
), f AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[ \t]*[-*•]'))) AS n_bullets,
    len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[ \t\x0b\f\r]*$'))) AS n_cut,
    length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS n_digits,
    length(text) - length(regexp_replace(text, '[{}\[\]\\]', '', 'g')) AS n_braces
  FROM d LEFT JOIN rep ON rep.row = d.row
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 10 * n_symbols <= n_words AND word_chars BETWEEN 2 * n_words AND 15 * n_words AND 2 * n_dup_lines <= n_lines
  AND 10 * n_bullets <= 9 * n_lines AND 10 * n_cut <= 3 * n_lines AND 2 * n_digits <= word_chars AND 20 * n_braces <= word_chars AS kept
FROM b
"""

OP12 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), f AS (
  SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM (
    SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4), (5)) AS v(k) WHERE len(w) >= k)
  ) GROUP BY ALL HAVING count(*) >= 100
), n AS (
  SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang
), c AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1
), cuts AS (
  SELECT lang, phrase, a, j, array_to_string(list_slice(w, 1, j), ' ') AS head, array_to_string(list_slice(w, j + 1, k), ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS j FROM c)
), s AS (
  SELECT c.lang, c.phrase, c.a, c.j, h.f AS l, t.f AS r, n.n, (1000 * c.a * n.n) // (h.f * t.f) AS score
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f t ON t.lang = c.lang AND t.phrase = c.tail JOIN n ON n.lang = c.lang
), low AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), inner_phrases AS (
  SELECT lang, a, array_to_string(list_slice(w, i, i + size - 1), ' ') AS phrase
  FROM (SELECT lang, a, w, size, unnest(range(1, k - size + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS size FROM c WHERE k > 2))
), held AS (
  SELECT lang, phrase, max(a) AS longer FROM inner_phrases GROUP BY ALL
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM low LEFT JOIN held USING (lang, phrase) WHERE longer IS NULL OR longer < a
QUALIFY rank <= 2000
"""

ORACLE_SQL = {"op2_chat_prefix_targets": OP2, "op4_line_dedup": OP4, "op8_decontamination": OP8, "op11_rule_cascade": OP11, "op12_collocations": OP12}

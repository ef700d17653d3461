r"""SQL twins of the queries that SQL can express, for DuckDB over the tables by name. They share no code with the operators."""

from __future__ import annotations

_WORD = r"'[^\x20\x09-\x0D]+'"

#: A turn's place among equal (turn, role, text) does not matter. Lengths are of code points; an escape adds one for each `<`, backslashes and bar.
_CHAT = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (1, 'user'), (2, 'assistant')) t(i, r)),
written AS (
  SELECT *, replace(replace(role, '\', '\\'), chr(10), '\n') AS named FROM said)
SELECT CAST(conv_id AS BIGINT) AS conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>') + length(named) + len(regexp_extract_all(named, '<\\*\|')) + 1
    + length(text) + len(regexp_extract_all(text, '<\\*\|')) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM written GROUP BY conv_id
"""

#: Leaves, lines and templates are lists of words here, not hashes. d is a document's row; pos is the number of a line in it, from 1.
_LINES = rf"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS d, doc_id, text, string_split(text, chr(10)) AS all_lines FROM documents),
numbered AS (SELECT d, doc_id, unnest(all_lines) AS line, unnest(range(1, len(all_lines) + 1)) AS pos FROM docs WHERE text IS NOT NULL),
masked AS (
  SELECT d, doc_id, pos, list_transform(words, lambda w: CASE WHEN len(words) >= 5 AND regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) AS line
  FROM (SELECT *, regexp_extract_all(line, {_WORD}) AS words FROM numbered)),
found AS MATERIALIZED (SELECT d, doc_id, [CAST(len(line) AS VARCHAR)] || line[1:3] AS leaf, line, list(pos) AS pos FROM masked WHERE len(line) >= 1 GROUP BY ALL),
each AS MATERIALIZED (SELECT leaf, line, count(*) AS n_docs FROM found GROUP BY ALL),
cuts AS (SELECT n, i, n * (i - 1) // least(16, n) AS a, n * i // least(16, n) AS b FROM (SELECT DISTINCT len(line) AS n FROM each), range(1, 17) r(i) WHERE n >= 5 AND i <= least(16, n)),
rich AS (SELECT leaf FROM each GROUP BY leaf HAVING sum(n_docs) >= 3 AND count(*) > 1),
spread AS MATERIALIZED (
  SELECT leaf, line, n_docs, i, line[a + 1 : b] AS field, count(*) OVER (PARTITION BY leaf, line) AS k
  FROM each SEMI JOIN rich USING (leaf) JOIN cuts ON n = len(line) WHERE b > 3),
support AS (SELECT leaf, i, field FROM spread GROUP BY ALL HAVING sum(n_docs) >= 3),
shapes AS (
  SELECT leaf, line, list({{'i': i, 'field': field}} ORDER BY i) AS shape FROM spread SEMI JOIN support USING (leaf, i, field)
  GROUP BY leaf, line, k HAVING count(*) >= 0.6 * k),
named AS (
  SELECT leaf, line, shape, CASE WHEN shape IS NULL THEN line END AS own FROM each LEFT JOIN shapes USING (leaf, line)
  WHERE n_docs >= 3 OR shape IS NOT NULL),
held AS MATERIALIZED (SELECT d, doc_id, pos, {{'leaf': leaf, 'shape': shape, 'own': own}} AS template FROM found JOIN named USING (leaf, line)),
often AS (
  SELECT template, arg_min(d, (doc_id IS NULL, doc_id, text)) AS keeper FROM held JOIN docs USING (d, doc_id)
  GROUP BY template HAVING count(DISTINCT d) >= 3),
lost AS (SELECT d, flatten(list(held.pos)) AS pos FROM held JOIN often USING (template) WHERE d <> keeper GROUP BY d),
kept AS (
  SELECT doc_id, all_lines, pos, CASE WHEN pos IS NULL THEN text
    ELSE array_to_string(list_filter(all_lines, lambda x, i: NOT list_contains(pos, i)), chr(10)) END AS left_text
  FROM docs LEFT JOIN lost USING (d))
SELECT doc_id, coalesce(len(all_lines), 0) AS n_lines, coalesce(len(list_distinct(pos)), 0) AS n_dropped,
  length(left_text) AS kept_chars, sha256(left_text) AS kept_sha256 FROM kept
"""

#: Shares, distances and bounds are those of the operator; distances are rounded as sums in another order differ in their last bits.
_QUALITY = rf"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS d, doc_id, lang, coalesce(text, '') AS text FROM documents),
split AS MATERIALIZED (
  SELECT *, regexp_extract_all(text, {_WORD}) AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {_WORD})) AS rows,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D.,;:?!''"()\[\]{{}}]+') AS plain FROM docs),
windows AS (SELECT d, unnest(range(1, len(words) - 6)) AS i, words FROM split WHERE len(words) > 8),
again AS (SELECT d, unnest(list(i)) AS i FROM (SELECT d, i, words[i : i + 7] AS w FROM windows) GROUP BY d, w HAVING count(*) > 1),
repeats AS (SELECT d, count(DISTINCT j) AS n FROM (SELECT d, unnest(range(i, i + 8)) AS j FROM again) GROUP BY d),
base AS MATERIALIZED (
  SELECT d, doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    len(rows) - len(list_distinct(rows)) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words, len(plain) AS n_plain
  FROM split LEFT JOIN repeats USING (d)),
counted AS (
  SELECT d, lang, text, list_transform(['[a-z]', '[A-Z]', '[0-9]', '[ \t]', '[\n\r\x0B\f]', '[.,;:?]', '!', '[''"()\[\]{{}}_/-]', '[#*$%&|<>]', '[^\x00-\x7F]'], lambda c: len(regexp_extract_all(text, c))) AS known FROM docs),
classes AS MATERIALIZED (
  SELECT d, lang, unnest(range(1, 12)) AS k, unnest(known || [length(text) - CAST(list_sum(known) AS BIGINT)]) AS c, greatest(1, length(text)) AS n FROM counted),
class_refs AS (SELECT lang, k, sum(c) / sum(sum(c)) OVER (PARTITION BY lang) AS q FROM classes GROUP BY lang, k),
class_parts AS (
  SELECT d, r.lang, c / n AS p, q FROM classes JOIN class_refs r USING (k)),
tokens AS MATERIALIZED (SELECT d, lang, unnest(plain) AS word FROM split),
word_counts AS (SELECT lang, word, count(*) AS n, sum(count(*)) OVER (PARTITION BY lang) AS total FROM tokens GROUP BY lang, word),
word_refs AS MATERIALIZED (SELECT lang, word, n / total AS q FROM word_counts QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= 64),
own AS (SELECT d, word, count(*) AS c FROM tokens GROUP BY d, word),
common AS MATERIALIZED (SELECT b.d, r.lang, n_plain, q, coalesce(c, 0) AS c FROM base b JOIN word_refs r ON true LEFT JOIN own o ON o.d = b.d AND o.word = r.word),
word_parts AS (
  SELECT d, lang, c / greatest(1, n_plain) AS p, q FROM common
  UNION ALL SELECT d, lang, (n_plain - sum(c)) / greatest(1, n_plain), greatest(0, 1 - sum(q)) FROM common GROUP BY d, lang, n_plain),
parts AS (SELECT 'class' AS kind, * FROM class_parts UNION ALL SELECT 'word', * FROM word_parts),
diverged AS (
  SELECT kind, d, lang, count(*) FILTER (q > 0) AS n_q, greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2) AS js
  FROM parts GROUP BY kind, d, lang),
distances AS (SELECT kind, d, lang, n_words, sqrt(greatest(0, js - (n_q - 1) / (8 * ln(2) * greatest(1, n_words)))) AS x FROM diverged JOIN base USING (d)),
each AS (SELECT d, lang, max(x) FILTER (kind = 'class') AS dc, CASE WHEN any_value(n_words) >= 60 THEN max(x) FILTER (kind = 'word') ELSE 0 END AS dw FROM distances GROUP BY d, lang),
nearest AS (SELECT d, arg_min({{'dc': dc, 'dw': dw}}, dc / 0.25 + dw / 0.28) AS x FROM each GROUP BY d),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base JOIN nearest USING (d))
SELECT doc_id, n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND x.dc <= 0.25 AND x.dw <= 0.28 AS kept,
  CAST(round(x.dc, 6) AS DOUBLE) AS class_distance, CAST(round(x.dw, 6) AS DOUBLE) AS word_distance FROM judged
"""

_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

#: Every document that has one of an item's terms is scored.
_RANKED = rf"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS d, doc_id, {_TERMS} AS terms
  FROM documents),
items AS MATERIALIZED (
  SELECT row_number() OVER () AS q, item_id, unnest({_TERMS}) AS term
  FROM benchmark),
wanted AS (SELECT q, item_id, term, count(*) AS c FROM items GROUP BY ALL),
totals AS (SELECT count(*) AS docs, CAST(coalesce(sum(len(terms)), 0) AS BIGINT) AS every FROM docs WHERE len(terms) > 0),
postings AS MATERIALIZED (
  SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM docs) SEMI JOIN wanted USING (term) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, totals GROUP BY term, docs),
impacts AS MATERIALIZED (
  SELECT d, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + 25 * len(terms) * docs // every))) AS impact
  FROM postings JOIN weights USING (term) JOIN docs USING (d), totals),
scores AS (SELECT q, item_id, d, doc_id, CAST(sum(c * impact) AS BIGINT) AS score FROM wanted JOIN impacts USING (term) GROUP BY q, item_id, d, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) <= 20
"""

#: Windows are compared as whole texts; no anchors, hashes or shards.
_SUBSTRINGS = rf"""
WITH split AS MATERIALIZED (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS words FROM documents),
windows AS (SELECT d, words, unnest(range(1, len(words) - 33)) AS i FROM split WHERE len(words) >= 35),
again AS (SELECT unnest(list({{'d': d, 'i': i}})) AS x FROM windows GROUP BY array_to_string(words[i : i + 34], ' ') HAVING count(*) > 1),
covered AS (SELECT DISTINCT x.d AS d, unnest(range(x.i, x.i + 35)) AS i FROM again),
each AS (SELECT d, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM split),
kept AS (SELECT d, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM each ANTI JOIN covered USING (d, i) GROUP BY d)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (d)
"""

ORACLE_SQL: dict[str, str] = {
    "op4_quality_rules": _QUALITY,
    "op5_line_dedup": _LINES,
    "op7_chat_format": _CHAT,
    "op11_ranked_search": _RANKED,
    "op12_substring_dedup": _SUBSTRINGS,
}

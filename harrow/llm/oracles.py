"""DuckDB SQL for the queries that SQL can express."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
WITH t AS (SELECT doc_id, {LOWER} AS x FROM documents),
g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size, sha256(x) AS text_sha256 FROM t GROUP BY x)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (x)
"""

STATS = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t WHERE len(w) >= 8)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
rep AS (
  SELECT doc_id, count(DISTINCT j) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
dup AS (
  SELECT doc_id, sum(n - 1)::BIGINT AS n_dup_lines FROM (
    SELECT doc_id, line, count(*) AS n FROM lines
    WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id, line) GROUP BY doc_id),
nl AS (
  SELECT doc_id, count(*) AS n_lines FROM lines
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
s AS (
  SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(list_filter(list_zip(w, w[2:]), lambda x: x[1] = x[2])) AS n_stutter,
    length(text) - length(replace(text, '!', '')) AS n_marks, coalesce(n_lines, 0) AS n_lines,
    length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_upper,
    length(text) - length(translate(text, 'abcdefghijklmnopqrstuvwxyz', '')) AS n_lower
  FROM t LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN nl USING (doc_id)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s),
q AS (
  SELECT *, NOT base_failed AND NOT (10 * n_symbols > 3 * n_words OR 10 * n_marks > 3 * n_words OR n_upper > n_lower
    OR 2 * n_dup_lines > n_lines OR 100 * n_stutter > 30 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept FROM v)
"""

OP6 = STATS + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM q"

ORACLES = {"op1_exact_dedup": OP1, "op6_quality": OP6}

"""DuckDB SQL for the queries that SQL can express."""

from harrow.functions.text import INSTRUCTION
from harrow.operators.datasets import DOMAINS
from harrow.queries import EDGES

WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
NOT_WORD = r"[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def norm(x: str) -> str:
    return f"coalesce({collapse(f"lower(regexp_replace({x}, '{NOT_WORD}', ' ', 'g'))")}, '')"


def capitals(x: str) -> str:
    return f"translate({x}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


def tokens(x: str) -> str:
    bare = rf"regexp_replace(lower({x}), '[!-/:-@\[-`{{-~]', '', 'g')"
    return f"list_filter(string_split_regex({bare}, '{WS}+'), lambda x: x not in ('', 'a', 'an', 'the'))"


def unescape(x: str) -> str:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{char}')"
    return x


PAIRS = f"""
pairs AS (
  SELECT conv_id, turn, {tokens("text")} AS g, {tokens("nxt")} AS p FROM (
    SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE nxt IS NOT NULL),
shared AS (
  SELECT *, coalesce(list_sum(list_transform(list_distinct(g), lambda z:
    least(len(list_filter(g, lambda y: y = z)), len(list_filter(p, lambda y: y = z))))), 0) AS n FROM pairs),
f AS (
  SELECT conv_id, turn,
    CASE WHEN len(g) = 0 AND len(p) = 0 THEN 1.0 WHEN n = 0 THEN 0.0 ELSE 2 * (n / len(p)) * (n / len(g)) / (n / len(p) + n / len(g)) END::DOUBLE AS f1,
    CASE WHEN len(g) = 0 AND len(p) = 0 THEN 1.0 WHEN n = 0 THEN 0.0 ELSE n / len(p) END::DOUBLE AS precision,
    CASE WHEN len(g) = 0 AND len(p) = 0 THEN 1.0 WHEN n = 0 THEN 0.0 ELSE n / len(g) END::DOUBLE AS recall FROM shared)
"""
R = ", ".join(f"round({c}, 9) AS {c}" for c in ("f1", "precision", "recall"))
TOKEN_F1 = f"WITH {PAIRS} SELECT conv_id, turn, {R} FROM f"

CASES = r"""
cases AS (
  SELECT page_id, html, split_part(regexp_extract(url, '^https?://([^/?#:]+)', 1), '.', 1) || '_' || page_id AS id,
    regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS t, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS h,
    regexp_extract(html, '<html lang="([^"]*)"', 1) AS l FROM pages)
"""
FIELDS = f"""
{CASES},
long AS (
  SELECT id, page_id, split_part(id, '_', 1) AS website, 'title' AS field, CASE WHEN page_id % 7 <> 0 THEN t END AS gold,
    CASE page_id % 6 WHEN 0 THEN t WHEN 1 THEN {capitals('t')} || '!' WHEN 2 THEN 'something else' WHEN 5 THEN '<NULL>' END AS pred, page_id % 6 = 4 AS missing FROM cases
  UNION ALL SELECT id, page_id, split_part(id, '_', 1), 'h1', h, h, false FROM cases
  UNION ALL SELECT id, page_id, split_part(id, '_', 1), 'lang', l, CASE WHEN page_id % 5 <> 0 THEN l END, false FROM cases),
there AS (
  SELECT *, gold IS NOT NULL AND {collapse("coalesce(gold, '')")} <> '' AS in_gold,
    pred IS NOT NULL AND pred <> '<NULL>' AND {collapse("coalesce(pred, '')")} <> '' AS said FROM long),
marks AS (
  SELECT id, website, field, CASE WHEN in_gold THEN {norm(unescape("gold"))} = {norm("coalesce(pred, 'None')")} ELSE NOT said END AS hit, missing OR said AS extracted, in_gold FROM there),
counts AS (
  SELECT website, field, count(*) FILTER (hit) AS page_hits, count(*) FILTER (extracted) AS extracted_pages, count(*) FILTER (in_gold) AS ground_truth_pages
  FROM marks GROUP BY website, field),
pr AS (
  SELECT *, CASE WHEN extracted_pages = 0 OR ground_truth_pages = 0 THEN 0 ELSE page_hits / extracted_pages END::DOUBLE AS precision,
    CASE WHEN extracted_pages = 0 OR ground_truth_pages = 0 THEN 0 ELSE page_hits / ground_truth_pages END::DOUBLE AS recall FROM counts),
sf AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END::DOUBLE AS f1 FROM pr)
"""
AVG = ", ".join(f"avg({c}) AS {c}" for c in ("f1", "precision", "recall"))

CHUNKS = f"""
d AS (SELECT doc_id, string_split({norm("text")}, ' ') AS n, string_split(text, chr(10)) AS c FROM documents),
chunks AS (
  SELECT doc_id, n[1:5] AS q, unnest(range(len(c))) AS pos, unnest(c) AS chunkcontent FROM d),
tok AS (
  SELECT *, list_distinct(list_filter(q, lambda x: x <> '')) AS qt, list_distinct(list_filter(string_split({norm("chunkcontent")}, ' '), lambda x: x <> '')) AS ct FROM chunks),
sc AS (SELECT *, CASE WHEN len(qt) = 0 THEN 0 ELSE len(list_intersect(qt, ct)) / len(qt) END::DOUBLE AS score FROM tok),
nm AS (
  SELECT *, CASE WHEN max(score) OVER (PARTITION BY doc_id) = 0 THEN 'nan'::DOUBLE ELSE score / max(score) OVER (PARTITION BY doc_id) END AS score_norm FROM sc),
kept AS (SELECT * FROM nm WHERE score_norm >= 0.5),
docs AS (
  SELECT doc_id, array_to_string(first(q ORDER BY pos), ' ') AS query, count(*)::INT AS n, string_agg(chunkcontent, chr(10) ORDER BY pos) AS full_content FROM kept GROUP BY doc_id)
"""


def _literal(v: str | None) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


TEXTS = f"""
texts AS (
  SELECT * FROM (VALUES {", ".join(f"({i}::BIGINT, {_literal(v)})" for i, v in enumerate(EDGES))}) AS e(i, v)
  UNION ALL SELECT page_id + 1000000, url FROM pages UNION ALL SELECT event_id + 2000000, props FROM events)
"""
DOMAIN = f"[{', '.join(map(_literal, DOMAINS))}][page_id % 8 + 1]"
WEBSRC = f"""
p AS (SELECT page_id, url, {DOMAIN} AS domain FROM pages),
ab AS (SELECT domain[1:2] AS abbreviation, arg_max(domain, page_id) AS domain FROM p GROUP BY 1)
"""
PLACED = "placed AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) - 1 AS idx FROM documents)"
CLEAN = collapse(unescape(r"regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>|<header.*?</header>|<footer.*?</footer>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"))

SAID = f"""
{CASES},
said AS (
  SELECT page_id, t, h, CASE WHEN page_id % 5 <> 0 THEN l END AS lang,
    CASE page_id % 6 WHEN 0 THEN t WHEN 1 THEN {capitals('t')} || '!' WHEN 2 THEN 'something else' WHEN 5 THEN '<NULL>' END AS title FROM cases)
"""


def quoted(x: str) -> str:
    return f"coalesce(to_json({x})::VARCHAR, 'null')"


PREDICTION = {"id": "NULL", "query": "NULL", "ground_truth": "NULL", "prediction": "NULL", "filtered_html": "NULL"}


def predicted(where: str, **values: str) -> str:
    return f"SELECT {', '.join(f'{v}::VARCHAR AS {c}' for c, v in (PREDICTION | values).items())} FROM events WHERE {where}"


ORACLES = {
    "postprocess": f"""WITH {SAID} SELECT page_id, CASE
      WHEN page_id % 2 = 0 THEN CASE WHEN page_id % 6 = 4 THEN '' ELSE coalesce(title, '') END || h || coalesce(lang, '')
      ELSE '{{' || CASE WHEN page_id % 6 = 4 THEN '' ELSE '"title": ' || {quoted("title")} || ', ' END || '"h1": ' || {quoted("h")} || ', "lang": ' || {quoted("lang")} || '}}' END AS prediction FROM said""",
    "predictions_reader": " UNION ALL ".join((
        predicted("event_id % 4 = 0", id="event_id", prediction="'x'"), predicted("event_id % 4 = 1", id="'a'"), predicted("event_id % 4 = 1"),
    )),
    "chat_messages_all": f"""WITH {CHUNKS} SELECT doc_id, pos::INT AS pos, 'system' AS role0, 'user' AS role1,
      '<Instruct>: {INSTRUCTION}' || chr(10) || '<Query>: ' || array_to_string(q, ' ') || chr(10) || '<Document>: ' || chunkcontent AS content1 FROM chunks""",
    "token_f1_samples": TOKEN_F1,
    "token_f1_long": TOKEN_F1,
    "token_f1_summary": f"WITH {PAIRS} SELECT " + ", ".join(f"round(avg({c}), 9) AS {c}" for c in ("f1", "precision", "recall")) + " FROM f",
    "running_metrics": f"""WITH {PAIRS}, b AS (SELECT *, ((row_number() OVER (ORDER BY conv_id, turn) - 1) // 64)::BIGINT AS batch_id FROM f),
      s AS (SELECT batch_id, count(*) AS n, sum(f1) AS f1, sum(precision) AS precision, sum(recall) AS recall FROM b GROUP BY batch_id)
      SELECT batch_id, {", ".join(f"round(sum({c}) OVER (ORDER BY batch_id) / sum(n) OVER (ORDER BY batch_id), 9) AS {c}" for c in ("f1", "precision", "recall"))} FROM s""",
    "page_counts": f"WITH {FIELDS} SELECT * FROM counts",
    "page_site_field": f"WITH {FIELDS} SELECT website, field, {R} FROM sf",
    "page_by_site": f"WITH {FIELDS}, a AS (SELECT website, {AVG} FROM sf GROUP BY website) SELECT website, {R} FROM a",
    "page_by_field": f"WITH {FIELDS}, a AS (SELECT field, {AVG} FROM sf GROUP BY field) SELECT field, {R} FROM a",
    "page_overall": f"WITH {FIELDS}, a AS (SELECT website, {AVG} FROM sf GROUP BY website), b AS (SELECT {AVG} FROM a) SELECT {R} FROM b",
    "page_samples": f"WITH {FIELDS} SELECT id, {', '.join(f"max(CASE WHEN field = '{c}' THEN hit::INT::DOUBLE END) AS {c}" for c in ('title', 'h1', 'lang'))} FROM marks GROUP BY id",
    "match_exact": f"""WITH {CASES}, v AS (SELECT page_id, t, CASE page_id % 3 WHEN 0 THEN '* ' || {capitals('h')} WHEN 1 THEN 'other' END AS p FROM cases)
      SELECT page_id, CASE WHEN {collapse("t")} <> '' THEN {norm("t")} = {norm("coalesce(p, 'none')")} ELSE p IS NULL END AS hit FROM v""",
    "normalize_text": f"SELECT doc_id, {norm('text')} AS t FROM documents",
    "normalize_html_text": f"SELECT doc_id, {collapse('text')} AS t FROM documents",
    "squad_normalize": f"SELECT conv_id, turn, array_to_string({tokens('text')}, ' ') AS t FROM conversations",
    "clean_text": f"SELECT page_id, {CLEAN} AS t FROM pages",
    "clean_text_dom": f"SELECT page_id, {CLEAN} AS t FROM pages",
    "unescape": f"SELECT page_id, {unescape(r"regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1)")} AS t FROM pages",
    "explode_chunks": f"WITH {CHUNKS} SELECT doc_id, pos::INT AS pos, doc_id || '-' || (pos + 1) AS chunkid, chunkcontent FROM chunks",
    "score_norm": f"WITH {CHUNKS} SELECT doc_id, pos::INT AS pos, round(score, 9) AS score, round(score_norm, 9) AS score_norm FROM nm",
    "threshold_filter": f"WITH {CHUNKS} SELECT doc_id, pos::INT AS pos FROM kept",
    "top_k": f"WITH {CHUNKS} SELECT doc_id, pos::INT AS pos FROM nm QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) <= 2",
    "regroup_docs": f"WITH {CHUNKS} SELECT * FROM docs",
    "build_prompt": f"WITH {CHUNKS} SELECT doc_id, 'Schema {{}}: ' || query || chr(10) || 'Page:' || chr(10) || full_content || chr(10) AS prompt FROM docs",
    "chat_messages": f"""WITH {CHUNKS} SELECT doc_id, 'system' AS role0, 'user' AS role1,
      '<Instruct>: {INSTRUCTION}' || chr(10) || '<Query>: ' || array_to_string(q, ' ') || chr(10) || '<Document>: ' || chunkcontent AS content1 FROM chunks WHERE pos = 0""",
    "truncated_ids": "SELECT doc_id, array_to_string(list_concat(list_transform(string_split(text, ' '), lambda w: length(w)::INT)[1:10], [-1, -2]), ' ') AS ids FROM documents",
    "yes_no_prob": """WITH e AS (SELECT event_id, exp(coalesce(CASE WHEN event_id % 5 <> 0 THEN -abs(value) / 50 END, -10)) AS y,
      exp(coalesce(CASE WHEN event_id % 7 <> 0 THEN -abs(value) / 80 END, -10)) AS n FROM events)
      SELECT event_id, round(CASE WHEN y + n = 0 THEN 0 ELSE y / (y + n) END, 9) AS p FROM e""",
    "is_schema": f"""WITH {TEXTS}, s AS (SELECT i, trim(v, chr(32) || chr(9) || chr(10) || chr(13)) AS v FROM texts)
      SELECT i, coalesce(starts_with(v, 'dict_keys(') OR (starts_with(v, '{{') AND ends_with(v, '}}')) OR (starts_with(v, '[') AND ends_with(v, ']'))
        OR length(v) - length(replace(v, ':', '')) >= 2, false) AS r FROM s""",
    "is_url": f"WITH {TEXTS} SELECT i, coalesce(regexp_matches(lower(v), '^https?://'), false) AS r FROM texts",
    "is_not_null": f"WITH {TEXTS} SELECT i, coalesce(v <> '<NULL>' AND {collapse('v')} <> '', false) AS r FROM texts",
    "websrc_join": f"""WITH {WEBSRC}, q AS (
        SELECT domain[1:2] AS a, page_id + CASE WHEN page_id % 9 = 0 THEN 5000000 ELSE 0 END AS n, page_id::VARCHAR AS ground_truth FROM p)
      SELECT q.a || lpad(n::VARCHAR, 7, '0') || '00' AS id, p.url AS content, ground_truth, coalesce(regexp_matches(lower(p.url), '^https?://'), false) AS is_content_url
      FROM q LEFT JOIN ab ON ab.abbreviation = q.a LEFT JOIN p ON p.domain = ab.domain AND p.page_id = q.n""",
    "domain_abbreviations": f"WITH {WEBSRC} SELECT * FROM ab",
    "swde_join": f"""WITH {CASES} SELECT id, CASE WHEN page_id % 4 <> 0 THEN length(html)::INT ELSE -1 END AS n, '{{"title": ""}}' AS query, false AS is_content_url FROM cases""",
    "stride_subset": f"WITH {PLACED} SELECT idx, doc_id FROM placed WHERE idx % greatest(1, (SELECT count(*) FROM documents) // 30) = 0",
    "batch_assign": f"WITH {PLACED} SELECT (idx // 64)::BIGINT AS batch_id, count(*) AS n, min(doc_id) AS lo FROM placed GROUP BY 1",
    "subset_order": f"WITH {PLACED}, w AS (SELECT * FROM (VALUES (0::BIGINT, 5), (1, 3), (2, 3), (3, 199), (4, 0)) AS v(pos, idx)) SELECT pos, placed.idx, doc_id FROM w JOIN placed ON placed.idx = w.idx",
    "json_extract": "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events",
    "fetch_lookup": """WITH store AS (SELECT DISTINCT url FROM pages WHERE page_id % 4 <> 1)
      SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '<p>text</p>' WHEN s.url IS NOT NULL THEN 'page' ELSE '[FETCH_ERROR] no page for ' || p.url END AS content
      FROM pages p LEFT JOIN store s ON s.url = p.url""",
}

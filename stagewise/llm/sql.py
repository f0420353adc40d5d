"""DuckDB SQL of the queries that SQL can express over the whole tables."""

from __future__ import annotations

from .secrets import BASE_RULES, RULES

_REACH = """
reach(node, least) AS (
  SELECT a, a FROM (SELECT a FROM links UNION SELECT b FROM links)
  UNION
  SELECT l.b, r.least FROM reach r JOIN (SELECT a, b FROM links UNION SELECT b, a FROM links) l ON l.a = r.node
),
component AS (SELECT node, min(least) AS least FROM reach GROUP BY node)
"""

OP3 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
),
{_REACH},
degree AS (SELECT x, count(*) AS n FROM (SELECT a AS x FROM links UNION ALL SELECT b FROM links) GROUP BY x)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, coalesce(c.least, e.vec_id) AS component_id,
  coalesce(c.least, e.vec_id) = e.vec_id AS kept, CAST(1.0 AS DOUBLE) AS recall
FROM embeddings e LEFT JOIN degree d ON d.x = e.vec_id LEFT JOIN component c ON c.node = e.vec_id
"""

_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_ASCII_LOWER}, '[^\x20\x09-\x0D]+') AS words FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [hash(array_to_string(words, ' '))]
    ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: hash(words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]))) END AS s
  FROM w
),
sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets),
one AS (SELECT doc_id, unnest(s) AS x FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM one a JOIN one b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)
),
{_REACH}
SELECT s.doc_id, s.n AS n_shingles, coalesce(c.least, s.doc_id) AS component_id
FROM sizes s LEFT JOIN component c ON c.node = s.doc_id
"""

OP6 = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
),
win AS (
  SELECT doc_id, i, md5(array_to_string(words[i : i + 19], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w WHERE len(words) >= 20)
),
dup AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM dup, range(0, 20) t(k)),
lists AS (SELECT doc_id, list(i ORDER BY i) AS cut FROM gone GROUP BY doc_id),
kept AS (
  SELECT w.doc_id, len(words) AS n, coalesce(len(cut), 0) AS r,
    CASE WHEN cut IS NULL THEN words ELSE list_transform(list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(cut, i)), lambda i: words[i]) END AS k
  FROM w LEFT JOIN lists USING (doc_id)
),
factors AS (SELECT doc_id, count(*) AS f FROM (SELECT doc_id, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM gone) WHERE step IS NULL OR step > 1 GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed,
  sha256(array_to_string(k, ' ')) AS kept_sha256, coalesce(f, 0) AS n_factors
FROM kept LEFT JOIN factors USING (doc_id)
"""



def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _matches(number: int, rule) -> str:
    pattern = _quoted(("(?i)" if rule.any_case else "") + rule.pattern)
    return f"SELECT rid, {number} AS rule, {_quoted(rule.kind)} AS kind, {rule.least} AS least, regexp_extract_all(t, {pattern}, 0) AS w, regexp_extract_all(t, {pattern}, {rule.group}) AS b, regexp_split_to_array(t, {pattern}) AS s FROM d"


_LISTED = "coalesce(string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, rule){}, '')"

OP7 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_matches(i, r) for i, r in enumerate(RULES))}),
e AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM m WHERE len(w) > 0),
spans AS (
  SELECT rid, rule, kind, CAST(list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS st, length(w[i]) AS n
  FROM e WHERE length(b[i]) >= least
),
k AS (SELECT *, st + n AS en FROM spans)
SELECT any_value(doc_id) AS doc_id, {", ".join(f"count(rule) FILTER (WHERE rule = {i}) AS n_{r.kind}" for i, r in enumerate(BASE_RULES))},
  sha256({_LISTED.format(f" FILTER (WHERE rule < {len(BASE_RULES)})")}) AS base_sha256, {_LISTED.format("")} AS spans
FROM d LEFT JOIN k USING (rid) GROUP BY rid
"""

ORACLES = {"op3_embedding_dedup": OP3, "op4_ngram_jaccard": OP4, "op6_substring_dedup": OP6, "op7_secret_scan": OP7}

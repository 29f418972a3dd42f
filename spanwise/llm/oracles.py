"""SQL twins of the text queries that SQL can express, written for DuckDB on the same tables."""

from __future__ import annotations

# Fixed by the query: depth 3, a fifth of the tokens variable, four templates of a leaf, two documents, three tokens or twenty characters.
_BLANK = r"[ \t\r\f]+"
_TRIMMED = "trim(line, ' ' || chr(9) || chr(13) || chr(12))"



def _rounds(n: int) -> str:
    """Lines that agree with the most frequent line of their leaf, then with that of the lines left, and so on."""
    differ = "len([1 for i in range(1, len(l.tokens) + 1) if l.tokens[i] <> m.model[i]])"
    parts = []
    for k in range(n):
        parts.append(f"""model{k} AS (SELECT leaf, tokens AS model FROM left{k}
            QUALIFY row_number() OVER (PARTITION BY leaf ORDER BY n DESC, tokens) = 1),
fit{k} AS (SELECT l.leaf, l.tokens, m.model FROM left{k} l JOIN model{k} m ON l.leaf = m.leaf
           WHERE {differ} <= floor(len(l.tokens) * 0.2 + 1e-9)),
left{k + 1} AS (SELECT l.* FROM left{k} l ANTI JOIN fit{k} f ON l.leaf = f.leaf AND l.tokens = f.tokens)""")
    return ",\n".join([*parts, "alike AS (" + " UNION ALL ".join(f"SELECT * FROM fit{k}" for k in range(n)) + ")"])


LINE_DEDUP = rf"""
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
line AS (SELECT doc_id, UNNEST(lines) AS line, UNNEST(range(len(lines))) AS place FROM docs),
plain AS (SELECT doc_id, place, length({_TRIMMED}) AS size, string_split_regex({_TRIMMED}, '{_BLANK}') AS tokens FROM line),
masked AS (SELECT *, [CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END for x in tokens] AS mask FROM plain),
key AS (SELECT doc_id, place, CASE WHEN len([x for x in mask if x = '<*>']) * 2 <= len(tokens) THEN mask ELSE tokens END AS tokens
        FROM masked WHERE len(tokens) >= 3 OR size >= 20),
leafed AS (SELECT *, [CAST(len(tokens) AS VARCHAR)] || tokens[1:3] AS leaf FROM key),
kind AS (SELECT leaf, tokens, COUNT(*) AS n FROM leafed GROUP BY ALL),
mixed AS (SELECT leaf FROM leafed GROUP BY leaf HAVING COUNT(DISTINCT tokens) > 1 AND COUNT(DISTINCT doc_id) > 1),
left0 AS (SELECT leaf, tokens, n FROM kind JOIN mixed USING (leaf)),
{_rounds(4)},
template AS (SELECT l.doc_id, l.place, CASE WHEN a.model IS NULL THEN ['line'] || l.tokens ELSE ['model'] || a.model END AS template
             FROM leafed l LEFT JOIN alike a ON l.leaf = a.leaf AND l.tokens = a.tokens),
recurring AS (SELECT template, MIN(doc_id) AS home FROM template GROUP BY template HAVING COUNT(DISTINCT doc_id) >= 2),
gone AS (SELECT DISTINCT t.doc_id, t.place FROM template t JOIN recurring r ON t.template = r.template WHERE t.doc_id <> r.home),
kept AS (SELECT l.doc_id, string_agg(CASE WHEN g.place IS NULL THEN l.line END, chr(10) ORDER BY l.place) AS text,
           COUNT(g.place) AS n_dropped, COUNT(*) AS n_lines
         FROM line l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.place = g.place GROUP BY l.doc_id)
SELECT d.doc_id, CAST(COALESCE(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(COALESCE(k.n_dropped, 0) AS BIGINT) AS n_dropped,
  CASE WHEN d.text IS NULL THEN NULL WHEN k.n_dropped > 0 THEN COALESCE(k.text, '') ELSE d.text END AS text
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

HARD_NEGATIVES = """
WITH rows AS (
    SELECT vec_id,
           CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pairs AS (
    SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same,
           CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
    FROM rows a JOIN rows r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id
),
positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score
    FROM pairs WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank,
       n.other_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p
JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
 AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) <= 3
"""

"""SQL (DuckDB) for the queries that SQL can express, by plain definitions over whole tables."""

import string

_UPPER = string.ascii_uppercase
_LATIN = "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7)

#: Exact Jaccard of all pairs that share a shingle, then reachability over the links.
NEAR_DEDUP = rf"""
WITH RECURSIVE
cut AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
word AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM cut),
run AS (
  SELECT doc_id, n, i, concat_ws(' ', w, lead(w, 1) OVER d, lead(w, 2) OVER d, lead(w, 3) OVER d) AS s
  FROM word WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
sets AS (SELECT DISTINCT doc_id, s FROM run WHERE i <= greatest(1, n - 3)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT u, v FROM pairs JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v
  WHERE 100 * shared >= 80 * (a.n + b.n - shared)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, l.v FROM reach r JOIN links l ON l.u = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM least LEFT JOIN sizes USING (doc_id)
"""


def _runs(table: str, key: str) -> str:
    return rf"""
{table}_word AS (
  SELECT {key}, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (
    SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}{_LATIN}', '{_UPPER.lower()}{_LATIN.lower()}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS ws FROM {table})),
{table}_run AS (
  SELECT {key}, n, i, concat_ws(' ', w, lead(w, 1) OVER d, lead(w, 2) OVER d, lead(w, 3) OVER d, lead(w, 4) OVER d) AS s
  FROM {table}_word WINDOW d AS (PARTITION BY {key} ORDER BY i)),
{table}_set AS (SELECT DISTINCT {key}, s FROM {table}_run WHERE i <= greatest(1, n - 4))"""


#: Exact containment of every item's shingles in every text.
DECONTAMINATION = f"""
WITH {_runs("documents", "doc_id")},
{_runs("benchmark", "item_id")},
sizes AS (SELECT item_id, count(*) AS size FROM benchmark_set GROUP BY item_id),
found AS (SELECT doc_id, item_id, count(*) AS shared FROM documents_set JOIN benchmark_set USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, shared, size, shared / size AS containment FROM found JOIN sizes USING (item_id) WHERE 5 * shared >= 4 * size
"""

#: Smoothed shares of all kept terms in all groups, zero counts included, compared pair by pair.
DIVERGENCE = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS text FROM documents),
word AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM word GROUP BY 1, 2 HAVING count(DISTINCT id) >= 30),
vocab AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY 1),
groups AS (SELECT DISTINCT lang, source FROM d),
cell AS (SELECT lang, source, term, count(*) AS n FROM word JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
total AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM groups LEFT JOIN cell USING (lang, source) GROUP BY 1, 2),
full_cell AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (t.total + 5 * v.v) AS p,
    1 + (1000000000::HUGEINT * (k.n + 5)) // (v.total + 5 * v.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN total t USING (lang, source) JOIN vocab v USING (lang) LEFT JOIN cell c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM full_cell x JOIN full_cell y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM full_cell WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

#: Lines as a list, sliced by the two cuts; the text rebuilt from the places of the marks.
FILL_IN_MIDDLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
cut AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS u, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
placed AS (SELECT *, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM cut),
part AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:], ''), '') AS s,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM placed),
made AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output FROM part),
back AS (SELECT *, CASE form WHEN 'plain' THEN output
  WHEN 'psm' THEN output[4:instr(output, '<S>') - 1] || output[instr(output, '<M>') + 3:] || output[instr(output, '<S>') + 3:instr(output, '<M>') - 1]
  ELSE output[instr(output, '<P>') + 3:instr(output, '<M>') - 1] || output[instr(output, '<M>') + 3:] || output[4:instr(output, '<P>') - 1] END AS restored FROM made)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars, sha256(output) AS output_sha256, sha256(restored) AS restored_sha256 FROM back
"""

ORACLE = {"op7_near_dedup": NEAR_DEDUP, "op8_decontamination": DECONTAMINATION, "op11_source_divergence": DIVERGENCE, "op13_fill_in_middle": FILL_IN_MIDDLE}

"""DuckDB SQL for the corpus queries that SQL can express on whole tables."""

from __future__ import annotations

#: Words in order: doc_id, i (from 1), word.
_WORDS = r"""
words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all({text}, '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL)
)"""

SUBSTRING_DEDUP = (
    "WITH"
    + _WORDS.format(text="coalesce(text, '')")
    + """,
windows AS (
  SELECT doc_id, i, word, CASE WHEN count(*) OVER ahead = 50 THEN string_agg(word, ' ') OVER ahead END AS passage
  FROM words WINDOW ahead AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)
),
firsts AS (SELECT passage, min(doc_id) AS least FROM windows WHERE passage IS NOT NULL GROUP BY passage),
judged AS (
  SELECT doc_id, i, word, coalesce(least < doc_id, false) AS repeated
  FROM windows LEFT JOIN firsts USING (passage)
),
covered AS (
  SELECT doc_id, i, word, bool_or(repeated) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
  FROM judged
),
kept AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS text
  FROM covered GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id) WHERE d.doc_id IS NOT NULL
"""
)

NEAR_DUPLICATES = (
    "WITH RECURSIVE"
    + _WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    + """,
spans AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id) AS n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS shingle
  FROM words
),
shingles AS (SELECT DISTINCT doc_id, shingle FROM spans WHERE i + 4 <= n OR i = 1),
sizes AS (SELECT doc_id, count(*) AS n_shingles FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common >= 85 * (x.n_shingles + y.n_shingles - common)
),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT a AS doc_id, a AS other FROM both_ways UNION SELECT r.doc_id, w.b FROM reached r JOIN both_ways w ON w.a = r.other),
roots AS (SELECT doc_id, min(other) AS root FROM reached GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_shingles, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id, coalesce(root, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN roots USING (doc_id) WHERE d.doc_id IS NOT NULL
"""
)


HARD_NEGATIVES = """WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
 FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS MATERIALIZED (SELECT a.r AS anchor, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b ON a.r <> b.r AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor, anchor_id, r, vec_id AS positive_id, score AS positive_score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, r) <= 5),
negatives AS (SELECT p.anchor, p.anchor_id, p.r, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor, p.r ORDER BY s.score DESC, s.vec_id)::INT AS rank
 FROM positives p JOIN scores s USING (anchor) WHERE NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 10"""


def _clusters(rounds: int = 3, k: int = 16) -> str:
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (SELECT r, vec_id, v, j, d FROM (SELECT x.r, x.vec_id, x.v, c.j, (list_dot_product(x.v, x.v) - 2 * list_dot_product(x.v, c.c) + list_dot_product(c.c, c.c))::BIGINT AS d FROM v x, c{n} c)
 QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, j) = 1)""")
        if n < rounds:
            steps.append(f"""s{n} AS (SELECT j, i, sum(x::BIGINT)::HUGEINT AS s, count(*) AS n FROM (SELECT j, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{n}) GROUP BY j, i),
c{n + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.c, c.c) AS c FROM c{n} c LEFT JOIN (SELECT j, list((((s - ((s % n) + n) % n) // n))::DOUBLE ORDER BY i) AS c FROM s{n} GROUP BY j) m USING (j))""")
    last = f"a{rounds}"
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS j, v AS c FROM (SELECT v, sha256('1:' || vec_id::VARCHAR) AS h FROM v) QUALIFY row_number() OVER (ORDER BY h NULLS LAST, v) <= {k}),
{", ".join(steps)},
digests AS (SELECT j, sha256(array_to_string(list_transform(c, lambda x: x::BIGINT), ',')) AS h FROM c{rounds})
SELECT vec_id, j::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256 FROM {last} JOIN digests USING (j)"""


CLUSTERS = _clusters()

"""DuckDB forms of the queries, where SQL can express them.

Learned, iterated and hash-drawn results (rules, shards, classes, mixes, models,
automata) have none; tests hold those against brute force.
"""

from .licences import sql as licences_sql

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_FOLDED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

_SUBSTRINGS = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h FROM w, range(1, len(w) - 48) AS r(p)),
least AS (SELECT h, min(doc_id) AS d FROM win GROUP BY h),
late AS (SELECT doc_id, list(p) AS ps FROM win JOIN least USING (h) WHERE doc_id > d GROUP BY doc_id),
covered AS (SELECT doc_id, list_distinct(flatten(list_transform(ps, lambda p: range(p, p + 50)))) AS c FROM late),
kept AS (SELECT w.doc_id, len(w) AS n, coalesce(len(c), 0) AS r, CASE WHEN c IS NULL THEN w ELSE list_transform(list_sort(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(c, i))), lambda i: w[i]) END AS k FROM w LEFT JOIN covered USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept"""


def _shingles(key: str, source: str) -> str:
    return f"SELECT DISTINCT {key}, array_to_string(w[p:p + 4], ' ') AS s FROM (SELECT {key}, {_FOLDED} AS w FROM {source}), range(1, len(w) - 3) AS r(p)"


_LEAKS = f"""
WITH d AS ({_shingles('doc_id', 'documents')}), b AS ({_shingles('item_id', 'benchmark')}),
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN b USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, CAST(n_item AS BIGINT) AS n_item, CAST(n_shared AS BIGINT) AS n_shared FROM m JOIN n USING (item_id) WHERE 100 * n_shared >= 80 * n_item"""

#: Pairs of texts with different sets that link, then what each reaches.
_COMPONENTS = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, md5(array_to_string(w[p:p + 4], ' ')) AS s FROM w, range(1, greatest(len(w) - 3, 2)) AS r(p) WHERE len(w) > 0),
sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, '' ORDER BY s)) AS f FROM sh GROUP BY doc_id),
rep AS (SELECT f, min(doc_id) AS r, any_value(n) AS n FROM sets GROUP BY f),
rs AS (SELECT r, n, s FROM rep JOIN sh ON sh.doc_id = rep.r),
pair AS (SELECT a.r AS a, b.r AS b FROM rs a JOIN rs b ON a.s = b.s AND a.r < b.r AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edge AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
deg AS (SELECT a AS x, count(*) AS n_links FROM edge GROUP BY a),
reach AS (SELECT r AS x, r AS y FROM rep UNION SELECT x, b FROM reach JOIN edge ON edge.a = reach.y),
comp AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT w.doc_id, CAST(coalesce(sets.n, 0) AS BIGINT) AS n_shingles, coalesce(rep.r, w.doc_id) AS class_id, CAST(coalesce(deg.n_links, 0) AS BIGINT) AS n_links, coalesce(comp.c, w.doc_id) AS component_id
FROM w LEFT JOIN sets USING (doc_id) LEFT JOIN rep USING (f) LEFT JOIN comp ON comp.x = rep.r LEFT JOIN deg ON deg.x = rep.r"""

_NEGATIVES = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x, row_number() OVER () AS n
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.n AS an, a.vec_id AS anchor_id, b.vec_id, b.n, a.label = b.label AS alike, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score FROM r AS a JOIN r AS b ON a.vec_id % 100 = 0 AND a.n <> b.n),
p AS (SELECT an, anchor_id, n AS pn, vec_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY an ORDER BY score DESC, vec_id) <= 5),
g AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.an, pn ORDER BY s.score DESC, s.vec_id) AS rank FROM p JOIN s ON p.an = s.an AND NOT s.alike AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM g WHERE rank <= 10"""


ORACLES: dict[str, str] = {"op2_ngram_jaccard_join": _COMPONENTS, "op4_license_scans": licences_sql(), "op6_substring_dedup": _SUBSTRINGS, "op10_decontamination": _LEAKS, "op13_hard_negatives": _NEGATIVES}

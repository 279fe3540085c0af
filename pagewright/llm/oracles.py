"""DuckDB twins of the corpus queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {}

ORACLES["op2_decontamination"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (SELECT DISTINCT item_id, w[k:k + 9] AS g FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT len(g) AS s FROM win),
hit AS (SELECT r, k, s, item_id FROM (SELECT r, s, k, w[k:k + s - 1] AS g FROM d, sizes, unnest(range(1, len(w) - s + 2)) AS u(k)) JOIN win USING (g)),
word AS (SELECT r, count(DISTINCT p) AS n_hit FROM hit, unnest(range(k, k + s)) AS u(p) GROUP BY r),
item AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN word USING (r) LEFT JOIN item USING (r)"""

ORACLES["op6_chat_formatting"] = """
WITH t AS (SELECT conv_id, turn, role, text FROM conversations GROUP BY ALL),
c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS l FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT l[1:k] AS l FROM c, unnest(range(1, len(l))) AS u(k)),
m AS (SELECT min(conv_id) AS conv_id, l FROM c GROUP BY l)
SELECT conv_id, len(l) AS n_turns,
       list_aggregate(list_transform(l, lambda x: '<|im_start|>' || coalesce(x.role, '') || chr(10) || coalesce(x.text, '') || '<|im_end|>' || chr(10)), 'string_agg', '') AS rendered
FROM m WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.l = m.l)"""

ORACLES["op10_substring_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT r, doc_id, k, w[k:k + 12] AS g FROM d, unnest(range(1, len(w) - 11)) AS u(k)),
least AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
gone AS (SELECT DISTINCT r, p FROM win JOIN least USING (g), unnest(range(k, k + 13)) AS u(p) WHERE m < doc_id OR (doc_id IS NULL AND m IS NOT NULL)),
lost AS (SELECT r, list(p) AS ps FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(list_aggregate(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, 'string_agg', ' '), '')) AS kept_sha256
FROM d LEFT JOIN lost USING (r)"""

ORACLES["op5_lm_scoring"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
t AS (SELECT r, k, w[k] AS b, CASE WHEN k > 1 THEN w[k - 1] END AS a FROM d, unnest(range(1, len(w) + 1)) AS u(k)),
one AS (SELECT b, count(*) AS n FROM t GROUP BY b),
two AS (SELECT a, b, count(*) AS n FROM t WHERE a IS NOT NULL GROUP BY a, b HAVING count(*) >= 2),
s AS (SELECT r, CASE WHEN two.n IS NOT NULL THEN ln(two.n / c.n) ELSE ln(one.n / (SELECT count(*) FROM t)) + CASE WHEN t.a IS NULL THEN 0 ELSE ln(0.4) END END AS v
      FROM t JOIN one ON one.b = t.b LEFT JOIN two ON two.a = t.a AND two.b = t.b LEFT JOIN one AS c ON c.b = t.a),
g AS (SELECT r, fsum(v) AS v FROM s GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(v, 0.0), 6) AS score, CASE WHEN len(w) > 0 THEN round(v / len(w), 6) END AS mean_score
FROM d LEFT JOIN g USING (r)"""

ORACLES["op4_embedding_dedup"] = """
WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM e AS a JOIN e AS b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)"""

ORACLES["op3_minhash_dedup"] = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT r, w[k:k + 1] AS g FROM d, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS u(k) WHERE len(w) > 0),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
x AS (SELECT a.r AS a, b.r AS b, count(*) AS i FROM s AS a JOIN s AS b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
l AS MATERIALIZED (SELECT x.a, x.b FROM x JOIN n AS p ON p.r = x.a JOIN n AS q ON q.r = x.b WHERE 100 * i >= 80 * (p.n + q.n - i)),
c AS (SELECT r AS a, r AS b FROM d UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a),
m AS (SELECT c.a AS r, min(d.doc_id) AS component_id FROM c JOIN d ON d.r = c.b GROUP BY c.a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d JOIN m USING (r) LEFT JOIN n USING (r)"""

#: CRC-32 in SQL: a table of 256 remainders, then a fold over the bytes of a text.
_CRC = """
bit AS (SELECT i AS b, list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) AS t(i)),
crc AS (SELECT list(c ORDER BY b) AS t FROM bit)"""

ORACLES["op12_importance_resampling"] = f"""
WITH {_CRC},
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
e AS (SELECT coalesce({_WORDS}, []) AS w FROM benchmark),
f AS MATERIALIZED (SELECT r, list_aggregate(w[k:k + n - 1], 'string_agg', ' ') AS f FROM d, range(1, 4) AS l(n), unnest(range(1, len(w) - n + 2)) AS u(k)),
g AS MATERIALIZED (SELECT list_aggregate(w[k:k + n - 1], 'string_agg', ' ') AS f FROM e, range(1, 4) AS l(n), unnest(range(1, len(w) - n + 2)) AS u(k)),
x AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM f UNION SELECT f FROM g)),
h AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(CAST(len(x) // 2 AS BIGINT)), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT))),
           lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) % 10000 AS b FROM x, crc),
s AS (SELECT b, count(*) AS s FROM f JOIN h USING (f) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM g JOIN h USING (f) GROUP BY b),
gain AS (SELECT b, CAST(floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * ((SELECT count(*) FROM f)::DOUBLE + 10000)
           / ((coalesce(s, 0)::DOUBLE + 1) * ((SELECT count(*) FROM g)::DOUBLE + 10000)))) AS BIGINT) AS gain FROM s FULL JOIN t USING (b)),
w AS (SELECT r, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN h USING (f) JOIN gain USING (b) GROUP BY r),
p AS (SELECT r, doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('42:' || CAST(doc_id AS VARCHAR))[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
      FROM d LEFT JOIN w USING (r)),
q AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS k FROM p WHERE words >= 20 AND doc_id IS NOT NULL)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= 5 * (SELECT count(*) FROM q) // 100 THEN k END AS rank FROM p LEFT JOIN q USING (r)"""

def _assigned(books: str) -> str:
    """Each part's nearest entry of the codebooks: least distance, then least entry."""
    return f"""(SELECT r, p, min({{'d': d, 'e': e}}) AS a FROM (
      SELECT r, v.p, e, list_sum(list_transform(list_zip(v.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v JOIN {books} AS b ON b.p = v.p) GROUP BY r, p)"""


def _refined(books: str) -> str:
    """Floored means of the parts assigned to each entry, unused entries as they were."""
    return f"""(SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM {books} AS b LEFT JOIN (
      SELECT p, e, list(m ORDER BY k) AS v FROM (
        SELECT v.p, a.e, k, CAST(floor(sum(v.v[k])::DOUBLE / count(*)) AS BIGINT) AS m
        FROM v JOIN {_assigned(books)} AS s ON s.r = v.r AND s.p = v.p, unnest(range(1, len(v.v) + 1)) AS u(k) GROUP BY v.p, a.e, k) GROUP BY p, e) AS m ON m.p = b.p AND m.e = b.e)"""


ORACLES["op13_vector_codes"] = f"""
WITH n AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT r, p, w[p * len(w) // 16 + 1:(p + 1) * len(w) // 16] AS v FROM n, range(16) AS t(p)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM v WHERE r <= 64),
b1 AS MATERIALIZED {_refined('b0')}, b2 AS MATERIALIZED {_refined('b1')},
f AS MATERIALIZED {_assigned('b2')},
c AS (SELECT r, string_agg(lower(printf('%02x', a.e)), '' ORDER BY p) AS code, CAST(sum(a.d) AS BIGINT) AS error FROM f GROUP BY r),
z AS (SELECT sha256(string_agg(list_aggregate(v, 'string_agg', ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM n JOIN c USING (r), z"""

"""DuckDB SQL of the operators that SQL can express, by plain joins."""

from __future__ import annotations


def _shingles(table: str, key: str) -> str:
    """(key, s) of the distinct five-word shingles of each text of a table."""
    return f"""SELECT DISTINCT {key}, s FROM (
      SELECT {key}, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 4], ' '))
                                WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s
      FROM (SELECT {key}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS ws FROM {table}))"""


OP3 = f"""
WITH d AS ({_shingles("documents", "doc_id")}), i AS ({_shingles("benchmark", "item_id")}),
     n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id)
SELECT doc_id, item_id, count(*)::DOUBLE / any_value(n) AS containment
FROM d JOIN i USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n)
"""

OP4 = f"""
WITH RECURSIVE w AS (SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), ' ') AS words FROM documents),
t AS (SELECT doc_id, CASE WHEN coalesce(words, '') = '' THEN doc_id ELSE min(doc_id) OVER (PARTITION BY words) END AS text_id FROM w),
x AS (SELECT documents.* FROM documents JOIN (SELECT DISTINCT text_id AS doc_id FROM t) USING (doc_id)),
s AS MATERIALIZED ({_shingles("x", "doc_id")}),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE c * 5 >= (a.n + b.n - c) * 4),
e AS MATERIALIZED (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r(node, m) AS (SELECT DISTINCT text_id, text_id FROM t UNION SELECT r.node, e.v FROM r JOIN e ON r.m = e.u),
c AS (SELECT node, min(m) AS class_id FROM r GROUP BY node),
k AS (SELECT u, count(*) AS n_links FROM e GROUP BY u)
SELECT doc_id, text_id, class_id, coalesce(n_links, 0) AS n_links
FROM t JOIN c ON c.node = text_id LEFT JOIN k ON k.u = text_id
"""

OP10 = r"""
WITH l AS (SELECT doc_id, no, line, list_distinct(list_filter(regexp_split_to_array(lower(line),
                  '[\x{09}\x{0B}-\x{0D} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]'), lambda w: w <> '')) AS ws
           FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents)),
k AS MATERIALIZED (SELECT doc_id, no, len(ws) AS n, list_sort(ws) AS ws FROM l WHERE len(ws) > 0),
f AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY doc_id, no) AS id
                   FROM (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY doc_id, no) AS nth FROM k) WHERE nth = 1),
u AS (SELECT id, n, unnest(ws) AS w FROM f),
df AS (SELECT w, count(*) AS df FROM u GROUP BY w),
r AS (SELECT id, n, w, row_number() OVER (PARTITION BY id ORDER BY df, w) AS rn FROM u JOIN df USING (w)),
x AS MATERIALIZED (SELECT id, n, w FROM r WHERE rn <= n - (4 * n + 4) // 5 + 1),
p AS (SELECT DISTINCT a.id AS later, b.id AS earlier FROM x a JOIN x b ON a.w = b.w AND b.id < a.id AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n),
g AS (SELECT DISTINCT later FROM (SELECT later, len(list_intersect(a.ws, b.ws)) AS c, a.n + b.n AS n FROM p JOIN f a ON a.id = later JOIN f b ON b.id = earlier)
      WHERE c * 5 >= (n - c) * 4),
stays AS (SELECT doc_id, no FROM l WHERE len(ws) = 0 UNION ALL SELECT doc_id, no FROM f WHERE id NOT IN (SELECT later FROM g)),
t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY no) AS text, count(*) AS n FROM l JOIN stays USING (doc_id, no) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text,
       coalesce(len(string_split(d.text, chr(10))), 0) AS n_lines, coalesce(len(string_split(d.text, chr(10))) - coalesce(t.n, 0), 0) AS n_removed
FROM documents d LEFT JOIN t USING (doc_id)
"""

OP11 = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
o AS (SELECT lang, s AS size, unnest(list_transform(generate_series(1, len(ws) - s + 1), lambda i: array_to_string(ws[i:i + s - 1], ' '))) AS phrase
      FROM w, (SELECT unnest([1, 2, 3]) AS s) WHERE len(ws) >= s),
f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS f FROM o GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND f >= 10),
k AS (SELECT lang, size, phrase, a, unnest(generate_series(1, size - 1)) AS k, ws FROM c),
x AS (SELECT k.*, g.f AS l, h.f AS r, (1000000::HUGEINT * a * a) // (g.f::HUGEINT * h.f) AS score FROM k
      JOIN f g ON g.lang = k.lang AND g.phrase = array_to_string(ws[1:k], ' ') JOIN f h ON h.lang = k.lang AND h.phrase = array_to_string(ws[k + 1:], ' ')),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS rn FROM x) WHERE rn = 1),
i AS (SELECT lang, sub AS phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS sub FROM c WHERE size = 3) GROUP BY ALL),
d AS (SELECT b.* FROM b LEFT JOIN i USING (lang, phrase) WHERE i.longer IS NULL OR 100 * i.longer < 50 * b.a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM d) JOIN n USING (lang) WHERE rank <= 2000
"""

OP12 = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, h AS text_sha256
FROM t WINDOW w AS (PARTITION BY h)
"""


def _lloyd(rounds: int) -> str:
    """Every part of every vector against every entry, round by round."""
    square = "list_sum(list_transform(generate_series(1, len(s.x)), lambda i: (s.x[i] - c.x[i]) * (s.x[i] - c.x[i])))::BIGINT"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT s.vec_id, s.p, any_value(s.x) AS x, min({square} * 256 + c.e) AS de FROM s JOIN c{i} c USING (p) GROUP BY s.vec_id, s.p)")
        if i < rounds:
            steps.append(f"""m{i} AS (SELECT p, e, list(m ORDER BY i) AS x FROM (SELECT p, e, i, CAST(floor(sum(v) / count(*)) AS BIGINT) AS m FROM (
                SELECT p, de % 256 AS e, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{i}) GROUP BY ALL) GROUP BY p, e),
c{i + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m USING (p, e))""")
    return ",\n".join(steps)


OP13 = f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS q FROM embeddings
           WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT vec_id, label, p, q[p * (len(q) // 4) + 1:(p + 1) * (len(q) // 4)] AS x FROM v, (SELECT unnest([0, 1, 2, 3]) AS p)),
c0 AS MATERIALIZED (SELECT p, rn - 1 AS e, x FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY vec_id) AS rn FROM s) WHERE rn <= 256),
{_lloyd(4)},
r AS (SELECT vec_id, string_agg(printf('%02x', de % 256), '' ORDER BY p) AS code, sum(de // 256)::BIGINT AS error FROM a4 GROUP BY vec_id),
b AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS h FROM c4)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT h FROM b) AS codebooks_sha256
FROM r JOIN v USING (vec_id)
"""

ORACLE = {"op3_decontamination": OP3, "op4_ngram_jaccard_join": OP4, "op10_line_dedup": OP10,
          "op11_phrases": OP11, "op12_exact_dedup": OP12, "op13_vector_codes": OP13}

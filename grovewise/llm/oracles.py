"""SQL for the operators that SQL can express, by direct comparison instead of sketches."""

_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingles(k: int, w: str = "w") -> str:
    return f"CASE WHEN len({w}) >= {k} THEN list_distinct(list_transform(range(1, len({w}) - {k - 2}), lambda i: array_to_string({w}[i:i + {k - 1}], ' '))) WHEN len({w}) > 0 THEN ['short ' || array_to_string({w}, ' ')] END"


OP3 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("lower(text)")} AS w FROM documents), i AS (SELECT item_id, {_WORDS.format("lower(text)")} AS w FROM benchmark),
ds AS (SELECT doc_id, unnest({_shingles(5)}) AS s FROM d), si AS (SELECT item_id, {_shingles(5)} AS l FROM i), ii AS (SELECT item_id, len(l)::INT AS n_item, unnest(l) AS s FROM si)
SELECT doc_id, item_id, count(*) AS n_common, n_item FROM ds JOIN ii USING (s) GROUP BY doc_id, item_id, n_item HAVING count(*) * 100 >= n_item * 80
"""

OP7 = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_WORDS.format(_LOWER.format("text"))} AS w FROM documents), l AS MATERIALIZED (SELECT doc_id, coalesce({_shingles(2)}, []) AS l FROM d),
s AS MATERIALIZED (SELECT doc_id, len(l) AS n, unnest(l) AS s FROM l),
p AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80 GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS MATERIALIZED (SELECT x, y FROM p UNION SELECT y, x FROM p),
r AS (SELECT doc_id AS v, doc_id AS c FROM l UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.v)
SELECT l.doc_id, len(l.l) AS n_shingles, min(r.c) AS component_id, min(r.c) = l.doc_id AS kept FROM l JOIN r ON r.v = l.doc_id GROUP BY l.doc_id, l.l
"""

OP9 = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT DISTINCT conv_id // 2 AS pair_id FROM t),
m AS (SELECT pair_id, i, c.role AS cr, c.text AS ct, r.role AS rr, r.text AS rt FROM (SELECT conv_id // 2 AS pair_id, i, role, text FROM t WHERE conv_id % 2 = 0) c FULL JOIN (SELECT conv_id // 2 AS pair_id, i, role, text FROM t WHERE conv_id % 2 = 1) r USING (pair_id, i)),
f AS (SELECT pair_id, coalesce(min(i) FILTER (cr IS NULL OR rr IS NULL OR cr <> rr OR ct <> rt), count(*) + 1) - 1 AS n, count(cr) AS nc, count(rr) AS nr FROM m GROUP BY pair_id),
x AS (SELECT t.conv_id, i, role, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS s, length(role) AS lr, n FROM t JOIN f ON pair_id = conv_id // 2),
o AS (SELECT *, coalesce(sum(length(s)) FILTER (i > n) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM x),
c AS (SELECT conv_id, coalesce(string_agg(s, '' ORDER BY i) FILTER (i <= n), '') AS prompt, coalesce(string_agg(s, '' ORDER BY i) FILTER (i > n), '') AS done, coalesce(string_agg((off + 13 + lr) || '-' || (off + length(s)), ',' ORDER BY i) FILTER (i > n AND role = 'assistant'), '') AS mask FROM o GROUP BY conv_id)
SELECT p.pair_id, p.pair_id * 2 AS chosen_id, p.pair_id * 2 + 1 AS rejected_id, f.n::INT AS n_prefix, coalesce(a.prompt, '') AS prompt, a.done AS chosen, b.done AS rejected, a.mask AS chosen_mask, b.mask AS rejected_mask
FROM p JOIN f USING (pair_id) LEFT JOIN c a ON a.conv_id = p.pair_id * 2 LEFT JOIN c b ON b.conv_id = p.pair_id * 2 + 1
"""

OP10 = r"""
WITH g AS (SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)), '') AS host,
  list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '', 'g'),
    '(?i)</?(?:html|head|title|body|nav|header|footer|main|article|section|aside|div|p|h[1-6]|ul|ol|li|table|tr|td|th|br|hr|pre|blockquote)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM pages),
u AS (SELECT host, unnest(list_distinct(l)) AS line FROM g WHERE host IS NOT NULL AND l IS NOT NULL),
h AS (SELECT host, count(*) AS n FROM g WHERE host IS NOT NULL AND l IS NOT NULL GROUP BY host),
bad AS (SELECT host, list(line) AS bad FROM (SELECT u.host, line, count(*) AS k, any_value(n) AS n FROM u JOIN h USING (host) GROUP BY u.host, line) WHERE k >= 2 AND k > 0.1::DOUBLE * n GROUP BY host),
k AS (SELECT page_id, g.host, l, CASE WHEN bad IS NULL THEN l ELSE list_filter(l, lambda x: NOT list_contains(bad, x)) END AS kept FROM g LEFT JOIN bad ON bad.host = g.host)
SELECT page_id, host, CASE WHEN l IS NULL THEN 0 ELSE greatest(len(l), 1) END::BIGINT AS n_lines, CASE WHEN l IS NULL THEN 0 ELSE len(l) - len(kept) END::BIGINT AS n_dropped, md5(array_to_string(kept, chr(10))) AS text_md5 FROM k
"""

OP11 = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM documents),
f AS (SELECT doc_id, w, count(*) AS tf FROM t GROUP BY ALL), n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM f GROUP BY doc_id), c AS (SELECT count(*) AS nd, sum(n)::BIGINT AS l FROM n),
m AS (SELECT doc_id, 50 + (50 * n * nd) // l AS m FROM n, c), v AS (SELECT w, floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM f, c GROUP BY w),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark),
s AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN v USING (w) JOIN f USING (w) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""

OP12 = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e, list_count(embedding) = len(embedding) AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0)) AS ok FROM embeddings),
u AS MATERIALIZED (SELECT vec_id, e FROM v WHERE ok),
l AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS v, vec_id AS c FROM v UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.v),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x), c AS (SELECT v, min(c) AS c FROM r GROUP BY v)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, c = vec_id AS kept FROM v LEFT JOIN n ON x = vec_id JOIN c ON c.v = vec_id
"""


def _clusters(k: int, rounds: int, dim: int) -> str:
    """Rounds written out one after another: x has each vector's components by row, c0, c1, ... the centroids'."""
    nearest = "arg_min(j, (d, j)) AS j, min(d) AS d FROM (SELECT vec_id, j, sum((x.x - c.x) * (x.x - c.x))::BIGINT AS d FROM x JOIN {} c USING (i) GROUP BY vec_id, j) GROUP BY vec_id"
    with_ = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE len(embedding) = {dim} AND list_count(embedding) = {dim} AND list_bool_and(list_transform(embedding, lambda x: isfinite(x))))",
        f"x AS MATERIALIZED (SELECT vec_id, unnest(range({dim})) AS i, unnest(e) AS x FROM v)",
        f"c0 AS MATERIALIZED (SELECT j, unnest(range({dim})) AS i, unnest(e) AS x FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS j, e FROM v QUALIFY row_number() OVER (ORDER BY sha256('2:' || vec_id)) <= {k}))",
    ]
    for r in range(rounds):
        with_ += [
            f"a{r} AS MATERIALIZED (SELECT vec_id, {nearest.format(f'c{r}')})",
            f"s{r} AS (SELECT j, i, sum(x)::BIGINT AS s, count(*) AS n FROM a{r} JOIN x USING (vec_id) GROUP BY j, i)",
            f"c{r + 1} AS MATERIALIZED (SELECT c.j, c.i, coalesce((s - ((s % n) + n) % n) // n, c.x) AS x FROM c{r} c LEFT JOIN s{r} s USING (j, i))",
        ]
    with_ += [
        f"a AS MATERIALIZED (SELECT vec_id, {nearest.format(f'c{rounds}')})",
        f"h AS (SELECT j, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY j)",
    ]
    return "WITH " + ",\n".join(with_) + "\nSELECT vec_id, j::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256 FROM a JOIN h USING (j)"


OP13 = _clusters(40, 5, 64)

ORACLES = {"op3_decontaminate": OP3, "op7_near_duplicates": OP7, "op9_preference_pairs": OP9, "op10_site_lines": OP10, "op11_lexical_search": OP11, "op12_binary_codes": OP12, "op13_hamerly_clusters": OP13}

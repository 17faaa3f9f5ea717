"""SQL for the reference queries, by another route: every sample's genotype is read off its nearest mutated ancestor.

The adapter's trees are three levels deep and their roots never mutate, so no recursion is needed.
"""

_BASE = """
n AS (SELECT count(*) AS n FROM customer), p AS (SELECT count(*) AS p FROM part), ks AS (SELECT unnest(range(4)) AS k),
smp AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS sample_id, c_custkey, c_nationkey FROM customer),
tr AS (SELECT k AS tree_id, (k * p) // 4 AS l, ((k + 1) * p) // 4 AS r FROM ks, p),
leaf AS (SELECT k AS tree_id, sample_id, c_custkey, (c_nationkey + k * (sample_id % 3)) % 25 AS nat FROM smp, ks),
reg AS (SELECT k AS tree_id, n_nationkey AS nat, (n_regionkey + CASE WHEN k >= 2 THEN n_nationkey % 2 ELSE 0 END) % 5 AS reg FROM nation, ks),
anc AS (SELECT leaf.tree_id, sample_id, c_custkey, n + leaf.nat AS nat, n + 25 + reg AS reg, n + 30 AS root FROM leaf JOIN reg ON reg.tree_id = leaf.tree_id AND reg.nat = leaf.nat, n),
te AS (SELECT tree_id, nat AS parent, sample_id AS child FROM anc UNION SELECT tree_id, reg, nat FROM anc UNION SELECT tree_id, root, reg FROM anc),
st AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS site_id, p_partkey, p_size, substr('ACGT', p_size % 4 + 1, 1) AS anc FROM part),
sites AS (SELECT site_id, p_partkey, p_size, anc, tree_id FROM st JOIN tr ON site_id >= l AND site_id < r),
hit AS (SELECT site_id, sites.tree_id, p_size, anc, l_suppkey, l_orderkey, l_quantity::INT % 10 AS q, sample_id, nat, reg
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN sites ON p_partkey = l_partkey JOIN anc ON anc.c_custkey = o_custkey AND anc.tree_id = sites.tree_id),
cand AS (SELECT site_id, tree_id, p_size, anc, l_suppkey, l_orderkey, CASE WHEN q < 7 THEN 2 WHEN q < 9 THEN 1 ELSE 0 END AS kind, CASE WHEN q < 7 THEN sample_id WHEN q < 9 THEN nat ELSE reg END AS node FROM hit),
one AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY site_id, node ORDER BY l_orderkey, l_suppkey) = 1),
mut AS (SELECT row_number() OVER (ORDER BY site_id, kind, node) - 1 AS mutation_id, site_id, tree_id, kind, node, anc,
  CASE WHEN p_size % 3 = 0 THEN substr('ACGT', l_suppkey::INT % 4 + 1, 1) WHEN l_suppkey % 5 = 0 THEN anc ELSE substr('ACGT', (p_size + 1) % 4 + 1, 1) END AS state FROM one),
up AS (SELECT DISTINCT tree_id, nat AS node, reg AS up1, NULL::BIGINT AS up2 FROM anc UNION ALL SELECT tree_id, sample_id, nat, reg FROM anc),
mp AS (SELECT m.*, coalesce(a.state, b.state, m.anc) AS parent_state FROM mut m LEFT JOIN up ON up.tree_id = m.tree_id AND up.node = m.node
  LEFT JOIN mut a ON a.site_id = m.site_id AND a.node = up.up1 LEFT JOIN mut b ON b.site_id = m.site_id AND b.node = up.up2),
geno AS (SELECT s.site_id, a.sample_id, s.anc, coalesce(x.state, y.state, z.state, s.anc) AS state FROM sites s JOIN anc a ON a.tree_id = s.tree_id
  LEFT JOIN mut x ON x.site_id = s.site_id AND x.node = a.sample_id LEFT JOIN mut y ON y.site_id = s.site_id AND y.node = a.nat LEFT JOIN mut z ON z.site_id = s.site_id AND z.node = a.reg),
ac AS (SELECT site_id, state, state = anc AS is_ancestral, count(*) AS c, count(*) FILTER (sample_id % 2 = 0) AS a, count(*) FILTER (sample_id % 2 = 1) AS b,
  count(*) FILTER (sample_id % 3 = 0) AS t0, count(*) FILTER (sample_id % 3 = 1) AS t1, count(*) FILTER (sample_id % 3 = 2) AS t2,
  count(*) FILTER (sample_id % 4 = 0) AS q0, count(*) FILTER (sample_id % 4 = 1) AS q1, count(*) FILTER (sample_id % 4 = 2) AS q2, count(*) FILTER (sample_id % 4 = 3) AS q3 FROM geno GROUP BY ALL),
sz AS (SELECT count(*) AS n, count(*) FILTER (sample_id % 2 = 0) AS na, count(*) FILTER (sample_id % 2 = 1) AS nb, count(*) FILTER (sample_id % 3 = 0) AS n0, count(*) FILTER (sample_id % 3 = 1) AS n1, count(*) FILTER (sample_id % 3 = 2) AS n2,
  count(*) FILTER (sample_id % 4 = 0) AS m0, count(*) FILTER (sample_id % 4 = 1) AS m1, count(*) FILTER (sample_id % 4 = 2) AS m2, count(*) FILTER (sample_id % 4 = 3) AS m3 FROM smp),
desc_ AS (SELECT tree_id, sample_id AS node, sample_id, 0 AS height FROM anc UNION ALL SELECT tree_id, nat, sample_id, 1 FROM anc UNION ALL SELECT tree_id, reg, sample_id, 2 FROM anc UNION ALL SELECT tree_id, root, sample_id, 3 FROM anc),
h1 AS (SELECT tree_id, nat AS node, reg AS up, 1 AS height, md5(string_agg(sample_id::VARCHAR, ',' ORDER BY sample_id)) AS h FROM anc GROUP BY ALL),
h2 AS (SELECT h1.tree_id, up AS node, 2 AS height, md5(string_agg(h, ',' ORDER BY h)) AS h, count(*) AS k FROM h1 GROUP BY 1, 2),
h3 AS (SELECT tree_id, n + 30 AS node, 3 AS height, md5(string_agg(h, ',' ORDER BY h)) AS h, count(*) AS k FROM h2, n GROUP BY 1, 2),
hk AS (SELECT h1.tree_id, node, height, h, (SELECT count(*) FROM te WHERE te.tree_id = h1.tree_id AND te.parent = h1.node) AS k FROM h1 UNION ALL SELECT tree_id, node, height, h, k FROM h2 UNION ALL SELECT tree_id, node, height, h, k FROM h3),
dag AS (SELECT *, height = 3 OR row_number() OVER (PARTITION BY h ORDER BY tree_id, height, node) = 1 AS made FROM hk),
key AS (SELECT tree_id, root AS node, lpad(root::VARCHAR, 12, '0') AS path, 'r' AS lvl FROM anc UNION SELECT tree_id, reg, lpad(root::VARCHAR, 12, '0') || '/' || lpad(reg::VARCHAR, 12, '0'), 'i' FROM anc
  UNION SELECT tree_id, nat, lpad(root::VARCHAR, 12, '0') || '/' || lpad(reg::VARCHAR, 12, '0') || '/' || lpad(nat::VARCHAR, 12, '0'), 'i' FROM anc
  UNION SELECT tree_id, sample_id, lpad(root::VARCHAR, 12, '0') || '/' || lpad(reg::VARCHAR, 12, '0') || '/' || lpad(nat::VARCHAR, 12, '0') || '/' || lpad(sample_id::VARCHAR, 12, '0'), 's' FROM anc),
tour AS (SELECT tree_id, node, path AS k, CASE lvl WHEN 's' THEN 'leaf' ELSE 'first' END AS visit FROM key UNION ALL SELECT tree_id, node, path || '~', 'second' FROM key WHERE lvl <> 's'),
edges AS (SELECT parent, child, min(l)::DOUBLE AS "left", max(r)::DOUBLE AS "right" FROM (SELECT te.*, l, r, te.tree_id - row_number() OVER (PARTITION BY parent, child ORDER BY te.tree_id) AS g FROM te JOIN tr USING (tree_id)) GROUP BY parent, child, g),
inv0 AS (SELECT DISTINCT tree_id, parent AS node FROM edges JOIN tr ON ("left" = l OR "right" = l) AND tree_id > 0),
inv AS (SELECT * FROM inv0 UNION SELECT te.tree_id, te.parent FROM inv0 JOIN te ON te.tree_id = inv0.tree_id AND te.child = inv0.node
  UNION SELECT t2.tree_id, t2.parent FROM inv0 JOIN te ON te.tree_id = inv0.tree_id AND te.child = inv0.node JOIN te t2 ON t2.tree_id = te.tree_id AND t2.child = te.parent
  UNION SELECT t3.tree_id, t3.parent FROM inv0 JOIN te ON te.tree_id = inv0.tree_id AND te.child = inv0.node JOIN te t2 ON t2.tree_id = te.tree_id AND t2.child = te.parent JOIN te t3 ON t3.tree_id = t2.tree_id AND t3.child = t2.parent)
"""
_BP = """,
bpx AS (SELECT key.*, h, row_number() OVER (PARTITION BY coalesce(h, key.node::VARCHAR) ORDER BY key.tree_id, path || '~') = 1 AS new FROM key LEFT JOIN hk ON hk.tree_id = key.tree_id AND hk.node = key.node),
bpn AS (SELECT x.* FROM bpx x LEFT JOIN te ON te.tree_id = x.tree_id AND te.child = x.node LEFT JOIN bpx y ON y.tree_id = x.tree_id AND y.node = te.parent WHERE x.new OR x.lvl = 'r' OR y.new),
bpi AS (SELECT h, row_number() OVER (ORDER BY tree_id, path || '~') - 1 + n AS id FROM bpn, n WHERE new AND lvl <> 's')
"""
_BENCH = """
res AS (SELECT event_type AS section, (user_id % 3)::VARCHAR AS variant, 'c' || (event_id % 2) AS collection, (event_id % 3)::INT AS chromosome, value FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL),
sm AS (SELECT section, variant, collection, chromosome, 'walltime' AS variable, quantile_cont(value, 0.5) AS median, min(value) AS mi, max(value) AS ma, quantile_cont(value, 0.1) AS q10, quantile_cont(value, 0.9) AS q90, stddev_samp(value) AS sd FROM res GROUP BY ALL),
sp AS (SELECT s.section, s.collection, s.chromosome, s.variable, s.variant, r.median / nullif(s.median, 0) AS speedup_median, r.median / nullif(s.mi, 0) AS speedup_min, r.median / nullif(s.ma, 0) AS speedup_max, r.median / nullif(s.q10, 0) AS speedup_q10, r.median / nullif(s.q90, 0) AS speedup_q90 FROM sm s JOIN sm r USING (section, collection, chromosome, variable) WHERE r.variant = '0' AND s.variant <> '0'),
lm AS (SELECT variant, collection, chromosome, quantile_cont(value, 0.5) AS median, min(value) AS mi, max(value) AS ma, quantile_cont(value, 0.1) AS q10, quantile_cont(value, 0.9) AS q90 FROM res GROUP BY ALL),
fs AS (SELECT 'c' || (s_nationkey % 4) AS collection, s_suppkey::INT AS chromosome, s_suppkey * 37 + 1000 AS num_edges, s_suppkey * 11 + 300 AS num_dag_edges, s_suppkey * 5 + 7 AS num_mutations, s_suppkey * 3 + 7 AS num_sites FROM supplier)
"""


def _q(body: str, base: str = _BASE) -> str:
    return f"WITH {base.strip()}\n{body}"



def _stat(name: str, numerator: str, denominator: str) -> str:
    return _q(f"SELECT round((SELECT sum({numerator}) FROM ac, sz)::DOUBLE / nullif((SELECT ({denominator})::DOUBLE FROM sz), 0), 9) AS {name}")


_BELOW = "SELECT tree_id, node, count(*) FILTER (sample_id % 2 = 0) AS n_0, count(*) FILTER (sample_id % 2 = 1) AS n_1 FROM desc_ GROUP BY ALL"
_ROUND = lambda cs: ", ".join(f"round({c}, 6) AS {c}" for c in cs)
_VIOLATIONS = """SELECT 'sample ids are 0..n-1' AS "check", (count(*) > 0 AND (min(sample_id) <> 0 OR max(sample_id) <> count(*) - 1 OR count(DISTINCT sample_id) <> count(*)))::BIGINT AS violations FROM smp
UNION ALL SELECT 'one root per tree', count(*) FROM (SELECT tree_id FROM (SELECT tree_id, parent AS node FROM te EXCEPT SELECT tree_id, child FROM te) GROUP BY tree_id HAVING count(*) > 1)
UNION ALL SELECT 'samples are leaves', count(*) FROM te JOIN smp ON parent = sample_id
UNION ALL SELECT 'one parent per node and tree', coalesce(sum(k), 0)::BIGINT FROM (SELECT 1 AS k FROM te GROUP BY tree_id, child HAVING count(*) > 1)
UNION ALL SELECT 'alleles are one character', count(*) FROM (SELECT anc AS s FROM sites UNION ALL SELECT state FROM mut) WHERE s IS NULL OR length(s) <> 1
UNION ALL SELECT 'edges end after they begin', count(*) FROM edges WHERE NOT ("left" < "right")"""

ORACLES = {
    "trees": _q('SELECT tree_id, l::DOUBLE AS "left", r::DOUBLE AS "right" FROM tr'),
    "edges": _q('SELECT "left", "right", parent, child FROM edges'),
    "tree_edges": _q("SELECT tree_id, parent, child FROM te"),
    "site_to_tree": _q("SELECT site_id, tree_id FROM sites"),
    "tree_roots": _q("SELECT DISTINCT tree_id, root AS node FROM anc"),
    "node_summary": _q("SELECT tree_id, node, max(parent) AS parent, sum(k)::BIGINT AS num_children FROM (SELECT tree_id, child AS node, parent, 0 AS k FROM te UNION ALL SELECT tree_id, parent, NULL, 1 FROM te) GROUP BY ALL"),
    "children": _q("SELECT tree_id, parent, row_number() OVER (PARTITION BY tree_id, parent ORDER BY child) - 1 AS position, child FROM te"),
    "mutation_parent_state": _q("SELECT mutation_id, site_id, tree_id, node, parent_state, state AS derived_state FROM mp"),
    "mutation_ranges": _q("SELECT site_id, min(mutation_id) AS first_mutation, count(*) AS num_mutations FROM mut GROUP BY site_id"),
    "ancestral_states": _q("SELECT site_id, anc AS ancestral_state, CASE anc WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'T' THEN 2 ELSE 3 END AS state_index FROM sites"),
    "samples_below": _q(_BELOW),
    "samples_below_dag": _q(_BELOW),
    "samples_below_multi": _q("SELECT tree_id, node, " + ", ".join(f"count(*) FILTER (sample_id % 4 = {i}) AS n_{i}" for i in range(4)) + ", max(height) AS height FROM desc_ GROUP BY ALL"),
    "samples_below_bp": _q("SELECT n_0, count(*) AS num_nodes FROM (SELECT h, count(*) AS n_0 FROM (SELECT hk.tree_id, h, d.sample_id FROM (SELECT tree_id, node, h FROM hk QUALIFY row_number() OVER (PARTITION BY h ORDER BY tree_id) = 1) hk JOIN desc_ d ON d.tree_id = hk.tree_id AND d.node = hk.node) GROUP BY h UNION ALL SELECT sample_id::VARCHAR, 1 FROM smp) GROUP BY n_0"),
    "allele_counts": _q("SELECT site_id, state, is_ancestral, a AS n_0, b AS n_1 FROM ac"),
    "invalid_sites": _q("SELECT site_id FROM ac, sz GROUP BY site_id, n HAVING sum(c) <> n"),
    "site_kind": _q("SELECT sites.site_id, coalesce(bool_or(third), false) AS is_multiallelic FROM sites LEFT JOIN (SELECT site_id, state <> first(state) OVER (PARTITION BY site_id ORDER BY mutation_id) AS third FROM mp WHERE state <> anc) USING (site_id) GROUP BY 1"),
    "allele_frequencies": _q("SELECT k.site_id, CASE WHEN m THEN 'multiallelic' ELSE 'biallelic' END AS kind, coalesce((SELECT c FROM ac WHERE ac.site_id = k.site_id AND is_ancestral), 0) AS num_ancestral, CASE WHEN m THEN (SELECT string_agg(state || ':' || c, ',' ORDER BY state) FROM ac WHERE ac.site_id = k.site_id) END AS counts FROM (SELECT sites.site_id, coalesce(bool_or(third), false) AS m FROM sites LEFT JOIN (SELECT site_id, state <> first(state) OVER (PARTITION BY site_id ORDER BY mutation_id) AS third FROM mp WHERE state <> anc) USING (site_id) GROUP BY 1) k"),
    "diversity": _stat("diversity", "c * (n - c)", "n * (n - 1)"),
    "diversity_by_set": _q("SELECT 'S2_0' AS set_id, round((SELECT sum(a * (na - a)) FROM ac, sz)::DOUBLE / (na * (na - 1)), 9) AS diversity FROM sz UNION ALL SELECT 'S2_1', round((SELECT sum(b * (nb - b)) FROM ac, sz)::DOUBLE / (nb * (nb - 1)), 9) FROM sz"),
    "divergence": _stat("divergence", "a * (nb - b)", "na * nb"),
    "segregating_sites": _q("SELECT (count(*) - count(DISTINCT site_id))::BIGINT AS segregating_sites FROM ac"),
    "afs": _q("SELECT i AS num_derived, count(c) AS num_sites FROM (SELECT unnest(range(n + 1)) AS i FROM sz) LEFT JOIN ac ON c = i AND NOT is_ancestral GROUP BY i"),
    "tajimas_d": _q("""SELECT round((pi - seg / a1) / sqrt((b1 - 1 / a1) / a1 * seg + (b2 - (n + 2) / (a1 * n) + a2 / (a1 * a1)) / (a1 * a1 + a2) * seg * (seg - 1)), 9) AS tajimas_d FROM
  (SELECT n::DOUBLE AS n, (n + 1)::DOUBLE / (3 * (n - 1)) AS b1, 2::DOUBLE * (n * n + n + 3) / (9 * n * (n - 1)) AS b2, list_sum(list_transform(range(1, n), lambda i: 1::DOUBLE / i)) AS a1, list_sum(list_transform(range(1, n), lambda i: 1::DOUBLE / (i * i))) AS a2 FROM sz),
  (SELECT sum(pairs) / (any_value(n) * (any_value(n) - 1) / 2) AS pi, sum(states - 1)::DOUBLE AS seg FROM (SELECT site_id, count(*) AS states, (any_value(n) * any_value(n) - sum(c * c))::DOUBLE / 2 AS pairs, any_value(n) AS n FROM ac, sz GROUP BY site_id))"""),
    "fst": _q("SELECT round(1 - 2 * (x + y) / (x + 2 * z + y), 9) AS fst FROM (SELECT (SELECT sum(a * (na - a)) FROM ac, sz)::DOUBLE / (na * (na - 1)) AS x, (SELECT sum(b * (nb - b)) FROM ac, sz)::DOUBLE / (nb * (nb - 1)) AS y, (SELECT sum(a * (nb - b)) FROM ac, sz)::DOUBLE / (na * nb) AS z FROM sz)"),
    "f2": _stat("f2", "(a * (a - 1))::HUGEINT * ((nb - b) * (nb - b - 1)) - (a * (na - a))::HUGEINT * (b * (nb - b))", "na::DOUBLE * (na - 1) * nb * (nb - 1)"),
    "f3": _stat("f3", "(t0 * (t0 - 1))::HUGEINT * ((n1 - t1) * (n2 - t2)) - (t0 * (n0 - t0))::HUGEINT * ((n1 - t1) * t2)", "n0::DOUBLE * (n0 - 1) * n1 * n2"),
    "f4": _stat("f4", "(q0 * (m1 - q1))::HUGEINT * (q2 * (m3 - q3)) - (q0 * (m1 - q1))::HUGEINT * ((m2 - q2) * q3)", "m0::DOUBLE * m1 * m2 * m3"),
    "lca_pairwise": _q("SELECT x.tree_id, CASE WHEN x.nat = y.nat THEN x.nat WHEN x.reg = y.reg THEN x.reg ELSE x.root END AS node FROM anc x JOIN anc y USING (tree_id) WHERE x.sample_id = 0 AND y.sample_id = 1"),
    "lca_every_nth": _q("SELECT tree_id, CASE WHEN count(DISTINCT nat) = 1 THEN min(nat) WHEN count(DISTINCT reg) = 1 THEN min(reg) ELSE min(root) END AS node FROM anc WHERE sample_id % 10 = 0 GROUP BY tree_id"),
    "subtrees_with_mutations": _q("SELECT (SELECT count(DISTINCT node) FROM mut WHERE kind = 2) + (SELECT count(DISTINCT h) FROM mut JOIN hk USING (tree_id, node)) AS num_subtrees"),
    "unique_subtrees": _q("SELECT n + (SELECT count(DISTINCT h) FROM hk) AS unique_subtrees, n + (SELECT count(*) FROM dag WHERE made) AS dag_nodes FROM n"),
    "dag_counts": _q("SELECT (SELECT sum(k) FROM dag WHERE made)::BIGINT AS num_edges, n + (SELECT count(*) FROM dag WHERE made) AS num_nodes, 4::BIGINT AS num_roots, n AS num_leaves FROM n"),
    "node_map": _q("SELECT x.tree_id, x.node AS ts_node, max(d.id) AS forest_node, x.height = 3 AS is_root, x.height, bool_or(d.tree_id = x.tree_id) AS created FROM hk x JOIN (SELECT *, n + row_number() OVER (ORDER BY tree_id, height, node) - 1 AS id FROM dag, n WHERE made) d ON d.h = x.h AND d.tree_id <= x.tree_id GROUP BY ALL UNION ALL SELECT tree_id, sample_id, sample_id, false, 0, false FROM anc"),
    "dag_edges": _q("SELECT row_number() OVER (ORDER BY parent, child) - 1 AS rank, parent, child FROM (SELECT p.id AS parent, coalesce((SELECT max(c.id) FROM ids c JOIN hk x ON x.h = c.h WHERE x.tree_id = te.tree_id AND x.node = te.child AND c.tree_id <= te.tree_id), te.child) AS child FROM ids p JOIN te ON te.tree_id = p.tree_id AND te.parent = p.node)", _BASE.strip() + ",\nids AS (SELECT *, n + row_number() OVER (ORDER BY tree_id, height, node) - 1 AS id FROM dag, n WHERE made)"),
    "dag_neighbours": _q("SELECT parent AS node, count(*) AS num_children, count(*) - count(DISTINCT child) AS repeated FROM (SELECT p.id AS parent, te.child AS child FROM ids p JOIN te ON te.tree_id = p.tree_id AND te.parent = p.node) GROUP BY parent", _BASE.strip() + ",\nids AS (SELECT *, n + row_number() OVER (ORDER BY tree_id, height, node) - 1 AS id FROM dag, n WHERE made)"),
    "allele_frequencies_of_sets": _q("SELECT s.site_id, coalesce(sum(a) FILTER (is_ancestral), 0)::BIGINT AS num_ancestral_0, coalesce(sum(b) FILTER (is_ancestral), 0)::BIGINT AS num_ancestral_1 FROM sites s LEFT JOIN ac USING (site_id) GROUP BY s.site_id"),
    "streamed_allele_counts": _q("SELECT site_id, state, is_ancestral, a AS n_0, b AS n_1 FROM ac"),
    "diversity_on_bp": _stat("diversity", "c * (n - c)", "n * (n - 1)"),
    "lca_on_bp": _q("SELECT tree_id, CASE WHEN count(DISTINCT nat) = 1 THEN min(nat) WHEN count(DISTINCT reg) = 1 THEN min(reg) ELSE min(root) END AS node FROM anc WHERE sample_id % 10 = 0 GROUP BY tree_id"),
    "adjacency": _q("SELECT tree_id, parent AS node, string_agg(child::VARCHAR, ',' ORDER BY child) AS neighbours FROM te GROUP BY tree_id, parent"),
    "duplicate_edges": _q("SELECT parent, child, count(*) AS times FROM te GROUP BY ALL HAVING count(*) > 1"),
    "sample_set_inverse": _q("SELECT s.set_id, sample_id FROM smp, (SELECT unnest(['0', '1', '2']) AS set_id) s WHERE (sample_id % 3)::VARCHAR <> s.set_id"),
    "sample_set_sizes": _q("SELECT (sample_id % 4)::VARCHAR AS set_id, count(*) AS num_samples FROM smp GROUP BY ALL"),
    "invalidated_nodes": _q("SELECT DISTINCT tree_id, node FROM inv"),
    "eulertour": _q("SELECT tree_id, row_number() OVER (PARTITION BY tree_id ORDER BY k) - 1 AS position, node, visit FROM tour"),
    "postorder": _q("SELECT tree_id, row_number() OVER (PARTITION BY tree_id ORDER BY path || '~') - 1 AS position, node FROM key"),
    "bp_tokens": _q("SELECT row_number() OVER (ORDER BY tree_id, k) - 1 AS pos, tree_id, bp, NOT new AS is_ref, new AND lvl = 's' AS is_leaf, CASE WHEN lvl = 's' THEN node WHEN NOT new OR NOT bp THEN id END AS node_id FROM (SELECT tree_id, node, lvl, new, id, unnest([{'k': path, 'bp': true}, {'k': path || '~', 'bp': false}], recursive := true) FROM bpn LEFT JOIN bpi USING (h))", _BASE.strip() + _BP),
    "bp_references": _q("SELECT row_number() OVER (ORDER BY tree_id, path) - 1 AS rank, CASE WHEN lvl = 's' THEN node ELSE id END AS node FROM bpn LEFT JOIN bpi USING (h) WHERE NOT new", _BASE.strip() + _BP),
    "dataset_stats": _q("SELECT 'num_sites' AS metric, count(*)::DOUBLE AS value FROM sites UNION ALL SELECT 'num_mutations', count(*) FROM mut UNION ALL SELECT 'num_trees', 4 UNION ALL SELECT 'num_samples', n FROM n UNION ALL SELECT 'num_edges', count(*) FROM edges UNION ALL SELECT 'num_nodes', n + 31 FROM n UNION ALL SELECT 'sequence_length', p FROM p UNION ALL SELECT 'num_subtrees', count(*) FROM key UNION ALL SELECT 'num_dag_nodes', n + (SELECT count(*) FROM dag WHERE made) FROM n UNION ALL SELECT 'num_dag_edges', (SELECT sum(k) FROM dag WHERE made) UNION ALL SELECT 'num_unique_subtrees', n + (SELECT count(DISTINCT h) FROM hk) FROM n UNION ALL SELECT 'num_subtrees_with_mutations', (SELECT count(DISTINCT node) FROM mut WHERE kind = 2) + (SELECT count(DISTINCT h) FROM mut JOIN hk USING (tree_id, node)) UNION ALL SELECT 'num_bp_references', count(*) FROM bpn WHERE NOT new", _BASE.strip() + _BP),
    "violations": _q(_VIOLATIONS),
    "archive_round_trip": _q('SELECT "left", "right", parent, child FROM edges'),
    "bench_summary": _q(f"SELECT section, variant, collection, chromosome, variable, {_ROUND(['median', 'q10', 'q90', 'sd'])}, round(mi, 6) AS min, round(ma, 6) AS max, round(ma - mi, 6) AS range FROM sm", _BENCH),
    "speedup": _q(f"SELECT section, collection, chromosome, variable, variant, {_ROUND(['speedup_median', 'speedup_min', 'speedup_max', 'speedup_q10', 'speedup_q90'])} FROM sp", _BENCH),
    "speedup_summary": _q("SELECT section, collection, variant, round(a, 6) AS min_speedup, round(b, 6) AS max_speedup, round(m, 6) AS median_speedup, round(max(m) OVER (PARTITION BY section), 6) AS best_median FROM (SELECT section, collection, variant, min(speedup_median) AS a, max(speedup_median) AS b, quantile_cont(speedup_median, 0.5) AS m FROM sp GROUP BY ALL)", _BENCH),
    "lca_fractions": _q(f"SELECT section, collection, chromosome, variable, variant, {_ROUND(['speedup_median', 'speedup_min', 'speedup_max', 'speedup_q10', 'speedup_q90'])}, round(fraction, 6) AS fraction FROM (SELECT 'lca_' || [2, 5, 10][s.chromosome + 1] || 'th' AS section, s.collection, s.chromosome, 'walltime' AS variable, s.variant, r.median / nullif(s.median, 0) AS speedup_median, r.median / nullif(s.mi, 0) AS speedup_min, r.median / nullif(s.ma, 0) AS speedup_max, r.median / nullif(s.q10, 0) AS speedup_q10, r.median / nullif(s.q90, 0) AS speedup_q90, 1 / [2, 5, 10][s.chromosome + 1]::DOUBLE AS fraction FROM lm s JOIN lm r USING (collection, chromosome) WHERE r.variant = '0' AND s.variant <> '0')", _BENCH),
    "storage_model": _q("SELECT collection, round(sum(num_edges) * 16.0 / 1048576, 9) AS edges_mib, round(sum(num_dag_edges) * 8.0 / 1048576, 9) AS dag_edges_mib, round((sum(num_mutations) * 8.5 + sum(num_sites) * 0.25) / 1048576, 9) AS sequence_mib FROM fs GROUP BY ALL", _BENCH),
    "dataset_summary": _q("SELECT collection, min(num_edges)::DOUBLE AS min, quantile_cont(num_edges, 0.5)::DOUBLE AS median, max(num_edges)::DOUBLE AS max, round(avg(num_edges), 6) AS mean, round(stddev_samp(num_edges), 6) AS sd, round(exp(avg(ln(num_edges))), 6) AS geometric_mean FROM fs GROUP BY ALL", _BENCH),
    "dataset_wide": _q("SELECT collection, chromosome, num_edges::DOUBLE AS num_edges, num_sites::DOUBLE AS num_trees, num_dag_edges::DOUBLE AS num_unique_subtrees, (num_edges + num_dag_edges)::DOUBLE AS num_subtrees, round(num_dag_edges::DOUBLE / (num_edges + num_dag_edges), 9) AS unique_share FROM fs", _BENCH),
    "distribution": _q("SELECT collection, min(num_edges)::DOUBLE AS lowest, quantile_cont(num_edges, 0.25)::DOUBLE AS q25, quantile_cont(num_edges, 0.5)::DOUBLE AS q50, quantile_cont(num_edges, 0.75)::DOUBLE AS q75, max(num_edges)::DOUBLE AS highest FROM fs GROUP BY ALL", _BENCH),
    "filenames_unique": "SELECT count(f) = count(DISTINCT f) AS ok FROM (SELECT 'c' || (s_nationkey % 4) || '_chr' || s_suppkey || '.trees' AS f FROM supplier)",
}
#: The same statistic by another way.
ORACLES["tajimas_d_as_fold"] = ORACLES["tajimas_d"]
#: Edges of the DAG in their order: a node whose own edges end after it is first used, an inner node without edges, a parent out of order.
ORACLES["postorder_violations"] = f"""WITH e AS ({ORACLES["dag_edges"]}), d AS (SELECT parent, max(rank) AS done FROM e GROUP BY parent), u AS (SELECT child, min(rank) AS used FROM e GROUP BY child)
SELECT (SELECT count(*) FROM d JOIN u ON d.parent = u.child WHERE used < done) + (SELECT count(*) FROM u WHERE child >= (SELECT count(*) FROM customer) AND child NOT IN (SELECT parent FROM d)) AS violations,
  (SELECT coalesce(bool_and(parent >= before), true) FROM (SELECT parent, lag(parent) OVER (ORDER BY rank) AS before FROM e)) AS sorted"""

"""Queries over the authorization graph projected from the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatelens.operators import capability, graph, masking, reach, triage, uncertain
from gatelens.plans.registry import query
from gatelens.plans.steps import step
from gatelens.sources import star
from gatelens.sources.star import GRAPH_SQL

G = f"WITH RECURSIVE {GRAPH_SQL}"
TARGETS = "targets AS (SELECT id FROM nodes WHERE (is_high_value OR is_admin) AND node_type <> 'Policy')"
SOURCES = "sources AS (SELECT id FROM nodes WHERE node_type IN ('User', 'Role'))"
DEPTH = 8
SAMPLES = 100


def _walk(name: str, edges: str, depth: int = DEPTH) -> str:
    """Shortest hops of every pair of a source and a target."""
    return f"""{name}_w AS (
  SELECT id AS s, id AS t, 0 AS hops FROM sources UNION SELECT w.s, e.dst, w.hops + 1 FROM {name}_w w JOIN {edges} e ON e.src = w.t WHERE w.hops < {depth}
), {name} AS (SELECT s AS source, t AS target, min(hops) AS hops FROM {name}_w WHERE s <> t AND t IN (SELECT id FROM targets) GROUP BY s, t)"""


WITNESS = f"""path_w AS (
  SELECT id AS s, id AS t, 0 AS hops, id AS path FROM sources UNION ALL
  SELECT w.s, e.dst, w.hops + 1, w.path || '>' || e.dst FROM path_w w JOIN (SELECT DISTINCT src, dst FROM edges) e ON e.src = w.t WHERE w.hops < {DEPTH} AND NOT list_contains(string_split(w.path, '>'), e.dst)
), paths AS (SELECT s AS source, t AS target, hops, path FROM path_w WHERE s <> t AND t IN (SELECT id FROM targets)),
witnesses AS (SELECT source, target, min(hops) AS hops, arg_min(path, struct_pack(h := hops, p := path)) AS path FROM paths GROUP BY source, target)"""


def _graph(spark, d):
    return step(star.nodes(spark, d)), step(star.edges(spark, d))


def _ends(nodes):
    return graph.default_sources(nodes), graph.default_targets(nodes)


@query(f"{G} SELECT node_type, coalesce(department, 'Unknown') AS department, count(*) AS n, count(*) FILTER (is_admin) AS admins, count(*) FILTER (is_high_value) AS high_value FROM nodes GROUP BY 1, 2")
def node_counts(spark, d):
    return star.nodes(spark, d).groupBy("node_type", F.coalesce("department", F.lit("Unknown")).alias("department")).agg(F.count("*").alias("n"), F.count_if("is_admin").alias("admins"), F.count_if("is_high_value").alias("high_value"))


@query(f"{G} SELECT relation, count(*) AS n, count(*) FILTER (is_bridge) AS bridges FROM edges GROUP BY relation")
def edge_counts(spark, d):
    return star.edges(spark, d).groupBy("relation").agg(F.count("*").alias("n"), F.count_if("is_bridge").alias("bridges"))


@query(f"""{G}, deg AS (SELECT n.id, (SELECT count(*) FROM edges e WHERE e.src = n.id) AS o, (SELECT count(*) FROM edges e WHERE e.dst = n.id) AS i FROM nodes n),
l AS (SELECT 'out' AS kind, o AS v FROM deg UNION ALL SELECT 'in', i FROM deg UNION ALL SELECT 'all', o + i FROM deg)
SELECT kind, CAST(min(v) AS DOUBLE) AS min, CAST(max(v) AS DOUBLE) AS max, round(avg(v), 3) AS mean, round(quantile_cont(v, 0.5), 3) AS median, round(stddev_samp(v), 3) AS std FROM l GROUP BY kind""")
def degree_stats(spark, d):
    return graph.degree_stats(*_graph(spark, d))


_DEGREES = ", ".join(f"round(ln(1 + (SELECT count(*) FROM edges e WHERE e.{end} = n.id AND e.relation = '{r}')), 9) AS \"{way}_{r}\"" for way, end in (("out", "src"), ("in", "dst")) for r in graph.RELATIONS)


@query(f"{G} SELECT id, {_DEGREES} FROM nodes n")
def relation_degrees(spark, d):
    r = graph.relation_degrees(*_graph(spark, d))
    return r.select("id", *[F.round(c, 9).alias(c) for c in r.columns if c != "id"])


@query(f"""{G}, idx AS (SELECT id, node_type, row_number() OVER (PARTITION BY node_type ORDER BY id) - 1 AS idx FROM nodes),
f AS (SELECT a.node_type AS src_type, relation, b.node_type AS dst_type, a.idx AS src_idx, b.idx AS dst_idx, is_bridge FROM edges JOIN idx a ON src = a.id JOIN idx b ON dst = b.id)
SELECT * FROM f UNION ALL SELECT dst_type, 'Rev' || relation, src_type, dst_idx, src_idx, is_bridge FROM f""")
def index_encoding(spark, d):
    return graph.index_encoding(*_graph(spark, d))


@query(f"""{G}, simple AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst), p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM simple),
tri AS (SELECT p.a AS x, p.b AS y, q.b AS z FROM p JOIN p q ON p.b = q.a JOIN p r ON r.a = p.a AND r.b = q.b), cnr AS (SELECT id, count(*) AS t FROM (SELECT unnest([x, y, z]) AS id FROM tri) GROUP BY id),
dg AS (SELECT id, count(*) AS k FROM (SELECT unnest([a, b]) AS id FROM p) GROUP BY id), l AS (SELECT coalesce(k, 0) AS k, coalesce(t, 0) AS t FROM nodes LEFT JOIN dg USING (id) LEFT JOIN cnr USING (id))
SELECT round((SELECT count(*) FROM simple) / (count(*) * (count(*) - 1)), 9) AS density, round((SELECT count(*) FROM simple s JOIN simple r ON s.src = r.dst AND s.dst = r.src) / (SELECT count(*) FROM simple), 6) AS reciprocity,
  round(sum(t) / sum(k * (k - 1) / 2), 6) AS transitivity, round(avg(CASE WHEN k > 1 THEN t / (k * (k - 1) / 2) ELSE 0.0 END), 6) AS clustering FROM l""")
def graph_shape(spark, d):
    return graph.shape(*_graph(spark, d))


_WCC = """both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
comp(id, c) USING KEY (id) AS (SELECT id, id FROM nodes UNION SELECT x.id, x.c FROM (SELECT b.src AS id, min(t.c) AS c FROM comp t JOIN both_ways b ON b.dst = t.id GROUP BY b.src) x JOIN recurring.comp o ON o.id = x.id WHERE x.c < o.c)"""


@query(f"{G}, {_WCC} SELECT id, c AS component FROM comp")
def weak_components(spark, d):
    return graph.weak_components(*_graph(spark, d))


@query(f"""{G}, {_WCC}, parts AS (SELECT count(*) AS components, max(n) AS giant FROM (SELECT count(*) AS n FROM comp GROUP BY c)),
row1 AS (SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM nodes WHERE is_admin) AS admins, (SELECT count(*) FROM nodes WHERE is_high_value) AS high_value, (SELECT count(*) FROM nodes WHERE node_type IN ('User', 'Role')) AS principals,
  (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM edges WHERE is_bridge) AS bridges, (SELECT count(*) FROM nodes WHERE id NOT IN (SELECT src FROM edges) AND id NOT IN (SELECT dst FROM edges)) AS isolated, components, giant FROM parts)
SELECT *, array_to_string(list_filter([CASE WHEN isolated > 0.1 * nodes THEN 'isolated' END, CASE WHEN nodes >= 100 AND giant < 0.7 * nodes THEN 'giant_component' END, CASE WHEN admins > 0.25 * principals THEN 'admins' END, CASE WHEN high_value = 0 THEN 'no_high_value' END], lambda x: x IS NOT NULL), ',') AS warnings FROM row1""")
def graph_health(spark, d):
    return graph.health(*_graph(spark, d))


@query(f"""{G}, links AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst), far AS (SELECT src AS a, dst AS b FROM links UNION SELECT far.a, links.dst FROM far JOIN links ON links.src = far.b)
SELECT id, greatest(id, coalesce((SELECT max(f.b) FROM far f JOIN far r ON r.a = f.b AND r.b = f.a WHERE f.a = id), id)) AS component FROM nodes""")
def strong_components(spark, d):
    return graph.strong_components(*_graph(spark, d))


_RANK_ROUNDS = 30


@query(f"""{G}, nn AS (SELECT count(*) AS n FROM nodes), wt AS (SELECT src, count(*) AS w FROM edges GROUP BY src), links AS (SELECT e.src, e.dst, count(*) / any_value(w) AS share FROM edges e JOIN wt USING (src) GROUP BY e.src, e.dst),
pr(i, id, rank) AS (SELECT 0, id, 1.0::DOUBLE / n FROM nodes, nn UNION ALL
  SELECT i + 1, id, 0.15 / n + 0.85 * lost / n + 0.85 * coalesce(came, 0) FROM (SELECT DISTINCT i FROM pr) CROSS JOIN nodes CROSS JOIN nn CROSS JOIN (SELECT coalesce(sum(rank), 0) AS lost FROM pr WHERE id NOT IN (SELECT src FROM links))
  LEFT JOIN (SELECT dst AS id, sum(share * rank) AS came FROM links JOIN pr ON pr.id = links.src GROUP BY dst) c USING (id) WHERE i < {_RANK_ROUNDS})
SELECT id, round(rank, 7) AS rank FROM pr WHERE i = {_RANK_ROUNDS}""")
def pagerank(spark, d):
    # a fixed number of rounds, which both sides can run; the operator's default stops by tolerance
    return graph.pagerank(*_graph(spark, d), rounds=_RANK_ROUNDS, tolerance=0.0).withColumn("rank", F.round("rank", 7))


@query(f"{G}, {TARGETS}, {SOURCES}, {_walk('r', 'edges')} SELECT * FROM r")
def reach_pairs(spark, d):
    n, e = _graph(spark, d)
    return reach.reach(e, *_ends(n), DEPTH)


@query(f"{G}, {TARGETS}, {SOURCES}, {_walk('r', 'edges', 6)} SELECT source, hops, count(*) AS n FROM r GROUP BY source, hops")
def reach_six_hops(spark, d):
    n, e = _graph(spark, d)
    return reach.reach(e, *_ends(n), 6).groupBy("source", "hops").agg(F.count("*").alias("n"))


LABELLED = f"""{WITNESS}, best AS (SELECT src, dst, arg_min(relation, struct_pack(b := NOT is_bridge, r := relation)) AS relation, bool_or(is_bridge) AS is_bridge FROM edges GROUP BY src, dst),
legs AS (SELECT source, target, u.i AS i, u.a AS a, u.b AS b FROM (SELECT source, target, unnest(list_transform(string_split(path, '>')[1:-2], lambda x, i: struct_pack(i := i, a := x, b := string_split(path, '>')[i + 1]))) AS u FROM witnesses)),
info AS (SELECT source, target, array_to_string(list(relation ORDER BY i), ',') AS relations, bool_or(is_bridge) AS is_bridge FROM legs JOIN best ON a = src AND b = dst GROUP BY source, target),
labelled AS (SELECT w.source, w.target, w.hops, w.path, i.relations, i.is_bridge,
  i.is_bridge OR (NOT a.is_admin AND b.is_admin) OR (NOT a.is_admin AND b.is_high_value AND (a.department IS DISTINCT FROM b.department OR coalesce(b.department = 'SecOps', false)) AND (contains(i.relations, 'AssumesRole') OR contains(i.relations, 'PassesTo') OR i.is_bridge)) AS is_escalation
  FROM witnesses w JOIN info i USING (source, target) JOIN nodes a ON a.id = w.source JOIN nodes b ON b.id = w.target)"""


@query(f"{G}, {TARGETS}, {SOURCES}, {LABELLED} SELECT * FROM labelled")
def reach_escalation(spark, d):
    n, e = _graph(spark, d)
    w = reach.reach(e, *_ends(n), DEPTH, True)
    return reach.label_escalations(w, e, n).select("source", "target", "hops", "path", F.array_join("relations", ",").alias("relations"), "is_bridge", "is_escalation")


@query(f"""{G}, {TARGETS}, {SOURCES}, {WITNESS} SELECT source, target, path, hops AS n_hops FROM (
  SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY hops, path) AS r FROM paths) WHERE r <= 10""")
def simple_paths_topk(spark, d):
    n, e = _graph(spark, d)
    s, t = _ends(n)
    pairs = reach.reach(e, s, t, DEPTH).select("source", "target")
    return reach.simple_paths(e, pairs, DEPTH, 10)


@query(f"""{G}, b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), c AS (SELECT id AS center FROM nodes WHERE is_high_value OR is_admin),
w AS (SELECT center, center AS id, 0 AS hops FROM c UNION SELECT w.center, b.dst, w.hops + 1 FROM w JOIN b ON b.src = w.id WHERE w.hops < 2) SELECT center, id, min(hops) AS hops FROM w GROUP BY center, id""")
def ego_2hop(spark, d):
    n, e = _graph(spark, d)
    return reach.ego(e, n.where("is_high_value or is_admin").select("id"))


@query(f"""{G}, w AS (SELECT id AS center, id, 0 AS hops FROM nodes WHERE node_type = 'Group' UNION SELECT w.center, e.dst, w.hops + 1 FROM w JOIN edges e ON e.src = w.id WHERE w.hops < 2),
m AS (SELECT center, id, min(hops) AS hops FROM w GROUP BY center, id) SELECT center, id, hops FROM (SELECT *, row_number() OVER (PARTITION BY center ORDER BY hops, id) AS r FROM m) WHERE r <= 30""")
def ego_forward_capped(spark, d):
    n, e = _graph(spark, d)
    return reach.capped_ego(e, n.where("node_type = 'Group'").select("id"))


@query(f"""{G}, {TARGETS}, {SOURCES}, {_walk('r', 'edges')}, plain AS (SELECT src, dst FROM edges WHERE NOT is_bridge), {_walk('q', 'plain', 30)}
SELECT r.source, r.target, r.hops, q.source IS NULL AS severed FROM r LEFT JOIN q USING (source, target)""")
def bridge_severance(spark, d):
    n, e = _graph(spark, d)
    return reach.severed(reach.reach(e, *_ends(n), DEPTH), e)


@query(f"""{G}, {TARGETS}, {SOURCES}, {_walk('r', 'edges')}, plain AS (SELECT src, dst FROM edges WHERE NOT is_bridge), {_walk('q', 'plain', 6)}
SELECT count(*) AS n_true, round(avg(CASE WHEN q.source IS NULL THEN 0.0 ELSE 1.0 END), 9) AS recall FROM r LEFT JOIN q USING (source, target)""")
def recall_masked(spark, d):
    n, e = _graph(spark, d)
    seen, _ = masking.mask(e, n, "E")
    return reach.recall(reach.reach(seen, *_ends(n), 6), reach.reach(e, *_ends(n), DEPTH)).withColumn("recall", F.round("recall", 9))


@query(f"""{G}, {TARGETS}, {SOURCES}, {_walk('r', 'edges', 6)}, pairs AS (SELECT src AS source, dst AS target FROM edges WHERE relation = 'PassesTo')
SELECT p.source, p.target, w.hops, CASE WHEN w.hops IS NULL THEN 0.0 ELSE greatest(0.5, 1 - 0.08 * (w.hops - 1)) END AS score FROM pairs p LEFT JOIN (SELECT s, t, min(hops) AS hops FROM r_w WHERE s <> t GROUP BY s, t) w ON w.s = p.source AND w.t = p.target""")
def step_scores(spark, d):
    _, e = _graph(spark, d)
    return reach.step_scores(e.where("relation = 'PassesTo'").select(F.col("src").alias("source"), F.col("dst").alias("target")), e)


# --- possible worlds ---

CANDIDATES = "cand AS (SELECT src, dst, relation, 0.3 + 0.6 * u AS probability FROM edges WHERE relation = 'PassesTo'), observed AS (SELECT src, dst, relation FROM edges WHERE relation <> 'PassesTo')"
WORLDS = f"""worlds AS (SELECT s.i AS sample_id, src, dst, relation FROM cand, (SELECT CAST(unnest(range({SAMPLES})) AS INTEGER) AS i) s
  WHERE CAST(('0x' || substr(md5('0|' || s.i || '|' || src || '|' || relation || '|' || dst), 1, 12)) AS UBIGINT) / 281474976710656.0 < probability),
wedges AS (SELECT s.i AS sample_id, src, dst FROM observed, (SELECT CAST(unnest(range({SAMPLES})) AS INTEGER) AS i) s UNION SELECT sample_id, src, dst FROM worlds)"""
MC = f"""mc_w AS (SELECT s.i AS sample_id, id AS s, id AS t, 0 AS hops FROM sources, (SELECT CAST(unnest(range({SAMPLES})) AS INTEGER) AS i) s UNION SELECT w.sample_id, w.s, e.dst, w.hops + 1 FROM mc_w w JOIN wedges e ON e.sample_id = w.sample_id AND e.src = w.t WHERE w.hops < {DEPTH}),
mc AS (SELECT s AS source, t AS target, count(DISTINCT sample_id) AS hits FROM mc_w WHERE s <> t AND t IN (SELECT id FROM targets) GROUP BY s, t)"""


def _worlds(spark, d):
    n, e = _graph(spark, d)
    cand = e.where("relation = 'PassesTo'").withColumn("probability", 0.3 + 0.6 * F.col("u"))
    return n, e.where("relation <> 'PassesTo'"), cand, step(uncertain.sample_worlds(cand, SAMPLES))


@query(f"{G}, {CANDIDATES}, {WORLDS} SELECT sample_id, count(*) AS n FROM worlds GROUP BY sample_id")
def sampled_worlds(spark, d):
    return _worlds(spark, d)[3].groupBy("sample_id").agg(F.count("*").alias("n"))


@query(f"{G}, {TARGETS}, {SOURCES}, {CANDIDATES}, {WORLDS}, {MC} SELECT source, target, hits, hits / {SAMPLES} AS frequency, round(sqrt(greatest(hits / {SAMPLES} * (1 - hits / {SAMPLES}), 1e-9) / {SAMPLES}), 9) AS se FROM mc")
def mc_reachability(spark, d):
    n, o, _, w = _worlds(spark, d)
    return uncertain.world_reach(o, w, *_ends(n), SAMPLES, DEPTH).withColumn("se", F.round("se", 9))


@query(f"""{G}, {TARGETS}, {SOURCES}, {CANDIDATES}, {WORLDS}, {MC}, p AS (SELECT product(probability) AS product FROM cand), f AS (SELECT source, target, hits / {SAMPLES} AS frequency, product, 1.96 * sqrt(greatest(hits / {SAMPLES} * (1 - hits / {SAMPLES}), 1e-9) / {SAMPLES}) AS half FROM mc, p)
SELECT source, target, frequency, round(abs(frequency - product), 9) AS abs_error, round(greatest(0.0, frequency - half), 9) AS low, round(least(1.0, frequency + half), 9) AS high, product BETWEEN frequency - half AND frequency + half AS consistent FROM f""")
def mc_vs_product(spark, d):
    n, o, c, w = _worlds(spark, d)
    p = uncertain.product_comparison(uncertain.world_reach(o, w, *_ends(n), SAMPLES, DEPTH), c, SAMPLES)
    return p.select("source", "target", "frequency", F.round("abs_error", 9).alias("abs_error"), F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), "consistent")


#: The actions that an edge of a relation stands for, as the capability table names them.
_ACTIONS = {"AssumesRole": ["sts:AssumeRole"], "ActsOn": ["sts:GetCallerIdentity"], "AttachedWith": ["sts:GetCallerIdentity", "s3:GetObject"]}

USED = f"""walk(sample_id, s, t, hops, path) AS (
  SELECT i, id, id, 0, id FROM sources, (SELECT CAST(unnest(range({SAMPLES})) AS INTEGER) AS i) UNION ALL
  SELECT w.sample_id, w.s, e.dst, w.hops + 1, w.path || '>' || e.dst FROM walk w JOIN (SELECT DISTINCT sample_id, src, dst FROM wedges) e ON e.src = w.t AND e.sample_id = w.sample_id WHERE w.hops < {DEPTH} AND NOT list_contains(string_split(w.path, '>'), e.dst)
), world_paths AS (SELECT sample_id, arg_min(path, struct_pack(h := hops, p := path)) AS path FROM walk WHERE s <> t AND t IN (SELECT id FROM targets) GROUP BY sample_id, s, t),
world_legs AS (SELECT sample_id, unnest(list_transform(string_split(path, '>')[1:-2], lambda x, i: struct_pack(a := x, b := string_split(path, '>')[i + 1]))) AS l FROM world_paths),
one_edge AS (SELECT src, dst, arg_min(relation, struct_pack(b := NOT is_bridge, r := relation)) AS relation, bool_or(is_bridge) AS is_bridge FROM edges GROUP BY src, dst),
used AS (SELECT src, dst, relation, is_bridge, count(DISTINCT sample_id) / {SAMPLES} AS sample_share, count(*) AS path_count FROM world_legs JOIN one_edge ON l.a = src AND l.b = dst GROUP BY ALL)"""


def _used(spark, d):
    n, o, _, w = _worlds(spark, d)
    return uncertain.participation(reach.world_paths(o, w, *_ends(n), SAMPLES), star.edges(spark, d), SAMPLES)


# edges passed on may be there or not: latent 0.5; memberships name no action 0.8; GetCallerIdentity alone takes only * 0.4
@query(f"""{G}, {TARGETS}, {SOURCES}, {CANDIDATES}, {WORLDS}, {USED}, able AS (SELECT *, CASE relation WHEN 'PassesTo' THEN 0.5 WHEN 'MemberOf' THEN 0.8 WHEN 'ActsOn' THEN 0.4 ELSE 1.0 END AS capability_score FROM used), top AS (SELECT max(path_count) AS top FROM used)
SELECT src, dst, relation, sample_share, path_count, capability_score, round(0.6 * sample_share + 0.2 * path_count / top + 0.2 * capability_score, 9) AS score FROM able, top ORDER BY score DESC, sample_share DESC, path_count DESC, src, relation, dst LIMIT 15""")
def candidate_prune_topk(spark, d):
    acts = F.expr("cast(array() as array<string>)")
    for relation, names in _ACTIONS.items():
        acts = F.when(F.col("relation") == relation, F.array(*map(F.lit, names))).otherwise(acts)
    used = step(_used(spark, d).withColumn("actions", acts).withColumn("is_latent", F.col("relation") == "PassesTo"))
    scored = uncertain.capability_score(used, capability.snapshot(spark))
    return uncertain.prune(scored, 15).select("src", "dst", "relation", "sample_share", "path_count", "capability_score", "score")


# --- masks and negatives ---

_U = "CAST(('0x' || substr(md5('{0}|0|' || src || '|' || relation || '|' || dst), 1, 12)) AS UBIGINT) / 281474976710656.0"
_TYPED = "typed AS (SELECT e.src, e.dst, e.relation, e.is_bridge, a.node_type AS st, b.node_type AS dt, a.account_id AS sa, b.account_id AS da FROM edges e JOIN nodes a ON e.src = a.id JOIN nodes b ON e.dst = b.id)"
_MASKS = {
    "A": f"relation <> 'MemberOf' AND {_U.format('A')} < 0.2",
    "B": "coalesce(sa <> da, false) AND relation IN ('AssumesRole', 'PassesTo')",
    "C": f"st = 'User' AND ((relation = 'AssumesRole' AND dt = 'Role') OR (relation = 'MemberOf' AND dt = 'Group')) AND {_U.format('C')} < 0.5",
    "D": "relation IN ('AssumesRole', 'PassesTo') AND st = 'Role' AND dt = 'Role'",
    "E": "is_bridge",
}


def _mask(letter: str):
    def run(spark, d):
        n, e = _graph(spark, d)
        seen, hidden = masking.mask(e, n, letter)
        tag = lambda df, x: df.select("src", "dst", "relation", F.lit(x).alias("hidden"))
        return tag(seen, False).unionByName(tag(hidden, True))

    run.__name__ = f"mask_{letter.lower()}"
    return query(f"{G}, {_TYPED} SELECT src, dst, relation, {_MASKS[letter]} AS hidden FROM typed")(run)


for _letter in _MASKS:
    _mask(_letter)


@query(f"""{G}, {_TYPED}, r AS (SELECT *, row_number() OVER (PARTITION BY st, relation, dt, is_bridge ORDER BY {_U.format('E')}, src, relation, dst) AS r, count(*) OVER (PARTITION BY st, relation, dt, is_bridge) AS n FROM typed)
SELECT src, dst, relation FROM r WHERE is_bridge AND r <= round_even(n * 0.5, 0)""")
def mask_bridge_share(spark, d):
    n, e = _graph(spark, d)
    return masking.mask_bridge_share(e, n, 0.5)[1].select("src", "dst", "relation")


_NU = "CAST(('0x' || substr(md5('neg|0|' || {0}), 1, 12)) AS UBIGINT) / 281474976710656.0"


@query(f"""{G}, pos AS (SELECT DISTINCT src, dst FROM edges WHERE relation = 'AssumesRole'), idx AS (SELECT *, row_number() OVER (PARTITION BY node_type ORDER BY id) - 1 AS idx FROM nodes),
m AS (SELECT count(*) AS m FROM nodes WHERE node_type = 'Role'), picked AS (SELECT a.id AS src, a.department AS d1, a.is_admin AS adm, CAST(floor({_NU.format("a.id || '|' || t.t")} * m) AS BIGINT) AS idx FROM nodes a, (SELECT unnest(range(1, 65)) AS t) t, m WHERE a.node_type = 'User'),
p AS (SELECT DISTINCT d.src, b.id AS dst, CASE WHEN NOT adm AND (b.is_high_value OR b.is_admin) THEN 'up' WHEN d1 = b.department THEN 'same' ELSE 'cross' END AS stratum FROM picked d JOIN idx b ON b.node_type = 'Role' AND b.idx = d.idx WHERE d.src <> b.id AND (d.src, b.id) NOT IN (SELECT (src, dst) FROM pos)),
r AS (SELECT *, {_NU.format("src || '|' || dst")} AS u FROM p), k AS (SELECT count(*) AS k FROM pos), q AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY u, src, dst) AS r FROM r, k),
o AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN r <= round_even(k * CASE stratum WHEN 'same' THEN 0.5 WHEN 'up' THEN 0.2 ELSE 0.3 END, 0) THEN 0 ELSE 1 END, u, src, dst) AS place FROM q) SELECT src, dst, stratum FROM o WHERE place <= k""")
def negatives_stratified(spark, d):
    n, e = _graph(spark, d)
    return masking.negatives(e, n, "AssumesRole", "User", "Role")


# --- triage ---

_TRIAGE = f"""{TARGETS}, {SOURCES}, {CANDIDATES}, {WORLDS}, {MC}, best AS (SELECT source AS id, max(hits) / {SAMPLES} AS p, count(DISTINCT target) AS blast FROM mc GROUP BY source),
t AS (SELECT n.id, node_type, department, is_admin, coalesce(p, 0.0) AS probability, coalesce(blast, 0) AS blast_radius FROM nodes n LEFT JOIN best USING (id) WHERE node_type IN ('User', 'Role')),
triage AS (SELECT *, CASE WHEN probability >= 0.7 THEN 'CRITICAL' WHEN probability >= 0.4 THEN 'HIGH' WHEN probability >= 0.15 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM t)"""


def _triage(spark, d):
    n, o, _, w = _worlds(spark, d)
    return triage.records(n, uncertain.world_reach(o, w, *_ends(n), SAMPLES, DEPTH))


@query(f"{G}, {_TRIAGE} SELECT id, node_type, department, is_admin, probability, severity, blast_radius FROM triage")
def triage_records(spark, d):
    return _triage(spark, d)


@query(f"{G}, {_TRIAGE} SELECT id, severity FROM triage WHERE lower(department) = 'building' AND contains(lower(concat_ws(chr(10), id, node_type, department, severity)), 'low')")
def triage_search(spark, d):
    return triage.search(_triage(spark, d), department="Building", text="low").select("id", "severity")


@query(f"""{G}, {_TRIAGE} SELECT count(*) AS principals, count(*) FILTER (node_type = 'User') AS users, count(*) FILTER (node_type = 'Role') AS roles, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high,
count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low, count(*) FILTER (probability > 0.15) AS flagged, round(avg(blast_radius), 6) AS mean_blast_radius FROM triage""")
def posture_kpis(spark, d):
    return triage.posture(_triage(spark, d))


@query(f"""{G}, {_TRIAGE} SELECT id, probability, severity FROM triage ORDER BY probability DESC, CASE severity WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 ELSE 4 END, id LIMIT 10""")
def triage_top(spark, d):
    return triage.ordered(_triage(spark, d), 10).select("id", "probability", "severity")

"""Queries of metrics, repair, verification, models, sources and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gatelens.functions import metrics
from gatelens.functions.scalars import uniform
from gatelens.operators import hitting, masking, models, pairs, policy, reach, repair, synthesis, training, uncertain, verify, workload
from gatelens.plans.graph_queries import CANDIDATES, G, SAMPLES, SOURCES, TARGETS, USED, WORLDS, _graph, _used, _worlds
from gatelens.plans.registry import query
from gatelens.plans.steps import shared_folder, step
from gatelens.sources import graphs, star, terraform
from gatelens.sources.star import REQUESTS_SQL, table
from gatelens.streaming import breakage

# --- metrics over scored rows: labels by language, scores by hash, rounded so that ties occur ---

SCORED = """WITH scored AS (SELECT lang AS model, CAST(quality AS BIGINT) AS y, round(0.35 * quality + 0.65 * CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 12)) AS UBIGINT) / 281474976710656.0, 2) AS score,
  lpad(CAST(doc_id AS VARCHAR), 12, '0') AS tie, toxic = 1 AS is_bridge FROM labels JOIN documents USING (doc_id))"""
STEPS = """, st AS (SELECT model, score, sum(y) AS tp, count(*) AS n FROM scored GROUP BY model, score), cu AS (SELECT *, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn, sum(tp) OVER (PARTITION BY model) AS p, sum(n) OVER (PARTITION BY model) AS al FROM st WINDOW w AS (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""
RANKED = ", rk AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score DESC, tie) AS rank, count(*) OVER (PARTITION BY model) AS nn FROM scored)"


def _scored(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    score = F.round(0.35 * F.col("quality") + 0.65 * uniform(F.col("doc_id").cast("string")), 2)
    return j.select(F.col("lang").alias("model"), F.col("quality").cast("long").alias("y"), score.alias("score"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("tie"), (F.col("toxic") == 1).alias("is_bridge"))


def _rounded(df, *keep):
    return df.select(*[F.round(c, 6).alias(c) if c not in keep else F.col(c) for c in df.columns])


@query(f"{SCORED}{STEPS} SELECT model, round(CASE WHEN max(p) = 0 THEN 0.0 WHEN max(p) = max(al) THEN 1.0 ELSE sum(tp / p * ctp / cn) END, 6) AS pr_auc FROM cu GROUP BY model")
def pr_auc(spark, d):
    return _rounded(metrics.pr_auc(_scored(spark, d), ["model"]), "model")


@query(f"{SCORED} SELECT a.model, round(avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END), 6) AS roc_auc FROM scored a JOIN scored b ON a.model = b.model AND a.y = 1 AND b.y = 0 GROUP BY a.model")
def roc_auc(spark, d):
    return _rounded(metrics.roc_auc(_scored(spark, d), ["model"]), "model")


@query(f"{SCORED}{RANKED} SELECT model, round(count(*) FILTER (y = 1 AND rank <= 10 AND score > 0) / sum(y), 6) AS recall_at_10, round(count(*) FILTER (y = 1 AND rank <= 50 AND score > 0) / sum(y), 6) AS recall_at_50 FROM rk GROUP BY model")
def recall_at_k(spark, d):
    return _rounded(metrics.recall_at_k(_scored(spark, d), ["model"], [10, 50]), "model")


@query(f"{SCORED}{RANKED} SELECT model, round(coalesce(1.0 / min(rank) FILTER (y = 0 AND score > 0), 0.0), 6) AS mrr FROM rk GROUP BY model")
def mrr(spark, d):
    return _rounded(metrics.reciprocal_rank(_scored(spark, d).withColumn("y", 1 - F.col("y")), ["model"]), "model")


@query(f"{SCORED} SELECT model, round(count(*) FILTER (y = 1 AND score < 0.5) / sum(y), 6) AS fnr FROM scored GROUP BY model")
def fnr(spark, d):
    return _rounded(metrics.false_negative_rate(_scored(spark, d), ["model"]), "model")


@query(f"""{SCORED}{RANKED} SELECT model, round(CASE WHEN count(*) FILTER (is_bridge) > 0 THEN count(*) FILTER (is_bridge AND CASE WHEN score > 0 THEN rank ELSE nn + 999 END <= 20) / count(*) FILTER (is_bridge) ELSE count(*) FILTER (y = 1 AND rank <= 20 AND score > 0) / sum(y) END, 6) AS recovery_at_20 FROM rk GROUP BY model""")
def path_recovery(spark, d):
    return _rounded(metrics.path_recovery_at_k(_scored(spark, d), ["model"], [20]), "model")


@query(f"{SCORED} SELECT model, round(-avg(y * ln(least(greatest(score, 1e-7), 1 - 1e-7)) + (1 - y) * ln(1 - least(greatest(score, 1e-7), 1 - 1e-7))), 6) AS nll FROM scored GROUP BY model")
def nll(spark, d):
    return _rounded(metrics.nll(_scored(spark, d), ["model"]), "model")


_BINS = """, b AS (SELECT *, least(len(list_filter(range(1, 11), lambda i: score >= i * 0.1::DOUBLE)), 9) AS bin FROM scored), g AS (SELECT model, bin, count(*) AS n, avg(score) AS conf, avg(y) AS acc FROM b GROUP BY model, bin),
bins AS (SELECT m.model, i.bin, coalesce(n, 0) AS n, coalesce(conf, (i.bin + 0.5) / 10) AS conf, coalesce(acc, 0.0) AS acc, coalesce(abs(conf - acc), 0.0) AS gap FROM (SELECT DISTINCT model FROM scored) m CROSS JOIN (SELECT unnest(range(10)) AS bin) i LEFT JOIN g ON g.model = m.model AND g.bin = i.bin)"""


@query(f"{SCORED}{_BINS} SELECT model, bin, n, round(conf, 6) AS conf, round(acc, 6) AS acc, round(gap, 6) AS gap FROM bins")
def ece_bins(spark, d):
    return _rounded(metrics.calibration_bins(_scored(spark, d), ["model"]), "model", "bin", "n")


@query(f"{SCORED}{_BINS} SELECT model, round(sum(n * gap) / sum(n), 6) AS ece, round(max(gap), 6) AS mce FROM bins GROUP BY model")
def ece(spark, d):
    return _rounded(metrics.expected_calibration_error(_scored(spark, d), ["model"]), "model")


@query(f"{SCORED}, q AS (SELECT y, least(greatest(score, 1e-7), 1 - 1e-7) AS p FROM scored), t AS (SELECT CASE WHEN y = 1 THEN p ELSE 1 - p END AS pt, CASE WHEN y = 1 THEN 0.25 ELSE 0.75 END AS a FROM q) SELECT round(avg(-a * (1 - pt) ** 2 * ln(pt)), 6) AS focal FROM t")
def focal_loss(spark, d):
    return _rounded(models.focal_loss(_scored(spark, d)))


@query("""WITH s AS (SELECT o_orderpriority AS grp, CAST(o_orderkey % 5 AS INTEGER) AS seed, avg(CASE WHEN o_totalprice > 100000 THEN 1.0 ELSE 0.0 END) AS v FROM orders GROUP BY ALL), a AS (SELECT grp, avg(v) AS m, stddev_samp(v) AS sd, count(v) AS n FROM s GROUP BY grp)
SELECT grp, round(m, 6) AS mean, round(sd, 6) AS std, round(greatest(0.0, m - CASE n WHEN 5 THEN 2.776 WHEN 4 THEN 3.182 WHEN 3 THEN 4.303 WHEN 2 THEN 12.706 ELSE 0 END * sd / sqrt(n)), 6) AS low, round(least(1.0, m + CASE n WHEN 5 THEN 2.776 WHEN 4 THEN 3.182 WHEN 3 THEN 4.303 WHEN 2 THEN 12.706 ELSE 0 END * sd / sqrt(n)), 6) AS high, n FROM a""")
def seed_ci(spark, d):
    s = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("grp"), (F.col("o_orderkey") % 5).alias("seed")).agg(F.avg((F.col("o_totalprice") > 100000).cast("double")).alias("v"))
    return _rounded(metrics.confidence_interval(s, ["grp"], "v"), "grp", "n")


def _finer(name: str, near: str, step: str) -> str:
    """Around the best log temperature of ``near``, the one of least loss among 201 places ``step`` apart."""
    return f"""{name} AS (SELECT arg_min(g, struct_pack(v := loss, g := g)) AS g FROM (SELECT g, avg(-ln(least(greatest(1 / (1 + exp(-(2 * y - 1) * z / exp(g))), 1e-7), 1 - 1e-7))) AS loss FROM logits, (SELECT {near} + i * {step} AS g FROM range(-100, 101) t(i)) GROUP BY g))"""


# nested grids find what the operator's search does
@query(f"""{SCORED}, logits AS (SELECT y, 3 * ln(greatest(score, 0.01) / (1.01 - score)) AS z FROM scored), {_finer("g1", "0.0", "ln(100) / 100")}, {_finer("g2", "(SELECT g FROM g1)", "ln(100) / 9000")}, {_finer("g3", "(SELECT g FROM g2)", "ln(100) / 800000")}
SELECT round(exp(g), 3) AS temperature FROM g3""")
def temperature(spark, d):
    t = metrics.fit_temperature(_scored(spark, d).select("y", (3 * F.log(F.greatest("score", F.lit(0.01)) / (1.01 - F.col("score")))).alias("logit")))
    return spark.createDataFrame([(round(t, 3),)], "temperature double")


# --- pair features and heuristic scores ---

_PAIRS = "pairs AS (SELECT src AS u, dst AS v FROM edges WHERE relation = 'PassesTo'), seen AS (SELECT DISTINCT src, dst FROM edges WHERE NOT is_bridge)"
_ACTS = "acts AS (SELECT id, ['role:' || coalesce(department, ''), CASE WHEN is_admin THEN 'iam:PassRole' ELSE 'sts:AssumeRole' END] AS a FROM nodes WHERE node_type = 'Role')"
_NEAR = """bw AS (SELECT src AS a, dst AS z FROM seen UNION SELECT dst, src FROM seen), k AS (SELECT a AS id, count(*) AS k FROM bw GROUP BY a),
cn AS (SELECT p.u, p.v, count(*) AS cn, sum(CASE WHEN k.k > 1 THEN 1 / ln(k.k) ELSE 0.0 END) AS aa, sum(1 / (k.k + 1e-9)) AS ra FROM pairs p JOIN bw x ON x.a = p.u JOIN bw y ON y.a = p.v AND y.z = x.z JOIN k ON k.id = x.z GROUP BY p.u, p.v)"""


def _walk_sql(name: str, start: str) -> str:
    return f"{name} AS (SELECT DISTINCT {start} AS s, {start} AS t, 0 AS hops FROM pairs UNION SELECT w.s, e.dst, w.hops + 1 FROM {name} w JOIN seen e ON e.src = w.t WHERE w.hops < 6)"


@query(f"""{G}, {_PAIRS}, {_ACTS}, {_NEAR}, {_walk_sql('fw', 'u')}, {_walk_sql('rw', 'v')}, fd AS (SELECT s, t, min(hops) AS h FROM fw WHERE s <> t GROUP BY s, t), rd AS (SELECT s, t, min(hops) AS h FROM rw WHERE s <> t GROUP BY s, t),
deg AS (SELECT id, (SELECT count(*) FROM seen WHERE src = id) AS o, (SELECT count(*) FROM seen WHERE dst = id) AS i FROM nodes)
SELECT p.u, p.v, CAST(coalesce(cn, 0) AS DOUBLE) AS common_neighbours, round(coalesce(cn, 0) / (coalesce(a.k, 0) + coalesce(b.k, 0) - coalesce(cn, 0) + 1e-9), 6) AS jaccard, round(coalesce(aa, 0.0), 6) AS adamic_adar,
  CAST(coalesce(a.k, 0) * coalesce(b.k, 0) AS DOUBLE) AS preferential_attachment, round(coalesce(ra, 0.0), 6) AS resource_allocation, CAST(coalesce(fd.h, 7) AS DOUBLE) AS forward_path, CAST(fd.h IS NOT NULL AS DOUBLE) AS forward_reach,
  CAST(coalesce(rd.h, 7) AS DOUBLE) AS reverse_path, CAST(rd.h IS NOT NULL AS DOUBLE) AS reverse_reach, CAST(du.o AS DOUBLE) AS out_degree_u, CAST(du.i AS DOUBLE) AS in_degree_u, CAST(dv.o AS DOUBLE) AS out_degree_v, CAST(dv.i AS DOUBLE) AS in_degree_v,
  CAST(coalesce(nu.department = nv.department, false) AS DOUBLE) AS same_department, CAST(coalesce(nu.department <> nv.department, false) AS DOUBLE) AS other_department, CAST(nu.is_admin AS DOUBLE) AS u_admin, CAST(nv.is_high_value OR nv.is_admin AS DOUBLE) AS v_high,
  CAST(coalesce(nu.account_id <> nv.account_id, false) AS DOUBLE) AS cross_account, CAST(nu.node_type IN ('User', 'Role') AS DOUBLE) AS u_identity, CAST(nv.node_type IN ('Role', 'Resource') AS DOUBLE) AS v_role_or_resource,
  CAST(nu.is_admin AS DOUBLE) AS passrole, CAST(NOT nu.is_admin AS DOUBLE) AS assumerole, CAST(nu.is_admin AS DOUBLE) AS admin_actions, CAST(len(list_intersect(xu.a, xv.a)) AS DOUBLE) AS shared_actions
FROM pairs p LEFT JOIN cn USING (u, v) LEFT JOIN k a ON a.id = p.u LEFT JOIN k b ON b.id = p.v LEFT JOIN fd ON fd.s = p.u AND fd.t = p.v LEFT JOIN rd ON rd.s = p.v AND rd.t = p.u JOIN deg du ON du.id = p.u JOIN deg dv ON dv.id = p.v
JOIN nodes nu ON nu.id = p.u JOIN nodes nv ON nv.id = p.v JOIN acts xu ON xu.id = p.u JOIN acts xv ON xv.id = p.v""")
def pair_features(spark, d):
    n, e, p, a = _pairs(spark, d)
    f = pairs.features(p, e, n, a)
    return f.select(*[F.round(c, 6).alias(c) if c in ("jaccard", "adamic_adar", "resource_allocation") else F.col(c) for c in f.columns])


def _pairs(spark, d):
    n, e = _graph(spark, d)
    acts = n.where("node_type = 'Role'").select("id", F.array(F.concat(F.lit("role:"), F.coalesce("department", F.lit(""))), F.when(F.col("is_admin"), "iam:PassRole").otherwise("sts:AssumeRole")).alias("acts"))
    return n, e.where("not is_bridge"), e.where("relation = 'PassesTo'").select(F.col("src").alias("u"), F.col("dst").alias("v")), acts


@query(f"""{G}, {_PAIRS}, {_NEAR}, r AS (SELECT p.u, p.v, nu.is_admin AS pass, nv.is_admin OR nv.is_high_value AS high, coalesce(nu.department = nv.department, false) AS same, coalesce(cn, 0) AS cn, a.k AS ka, b.k AS kb
  FROM pairs p JOIN nodes nu ON nu.id = p.u JOIN nodes nv ON nv.id = p.v LEFT JOIN cn USING (u, v) LEFT JOIN k a ON a.id = p.u LEFT JOIN k b ON b.id = p.v),
s AS (SELECT *, CASE WHEN pass THEN CASE WHEN high THEN 0.85 ELSE 0.65 END + CASE WHEN same THEN 0.1 ELSE 0 END END AS s1, CASE WHEN NOT pass THEN CASE WHEN high THEN 0.7 ELSE 0.5 END + CASE WHEN same THEN 0.15 ELSE 0 END END AS s2, CASE WHEN cn > 0 THEN 0.3 + least(0.4, cn / (ka + kb - cn + 1e-9)) END AS s3 FROM r)
SELECT u, v, round(least(1.0, greatest(0.05, coalesce(s1, 0), coalesce(s2, 0), coalesce(s3, 0))), 6) AS score, array_to_string(list_filter([CASE WHEN s1 IS NOT NULL THEN 'PassRole' END, CASE WHEN s2 IS NOT NULL THEN 'Assumption' END, CASE WHEN s3 IS NOT NULL THEN 'Overlap' END], lambda x: x IS NOT NULL), ',') AS rules FROM s""")
def motif_score(spark, d):
    n, e, p, a = _pairs(spark, d)
    return pairs.motif_scores(p, e, n, a).withColumn("score", F.round("score", 6))


@query(f"""{G}, own AS (SELECT 'policy:' || p_partkey AS id, 'do:' || p_size AS a FROM part), att AS (SELECT * FROM own UNION SELECT e.src, a FROM edges e JOIN own ON e.dst = own.id WHERE relation = 'AttachedWith'),
every AS (SELECT * FROM att UNION SELECT e.src, a FROM edges e JOIN att ON e.dst = att.id WHERE relation = 'MemberOf') SELECT id, array_to_string(list_sort(list(a)), ',') AS acts FROM every GROUP BY id""")
def node_actions(spark, d):
    own = table(spark, d, "part").select(F.concat(F.lit("policy:"), F.col("p_partkey").cast("string")).alias("id"), F.array(F.concat(F.lit("do:"), F.col("p_size").cast("string"))).alias("acts"))
    return pairs.node_actions(star.edges(spark, d), own).select("id", F.array_join("acts", ",").alias("acts"))


# --- repair and verification ---

_STMT = """s AS (SELECT 'brand-' || replace(p_brand, '#', '') AS sid, list_sort(list(DISTINCT 'act:' || p_size)) AS action, ['*'] AS resource FROM part GROUP BY p_brand)"""


def _statements(spark, d):
    p = table(spark, d, "part").groupBy(F.concat(F.lit("brand-"), F.replace("p_brand", F.lit("#"), F.lit(""))).alias("sid")).agg(F.array_sort(F.collect_set(F.concat(F.lit("act:"), F.col("p_size").cast("string")))).alias("action"))
    return p.withColumn("resource", F.array(F.lit("*"))).withColumn("effect", F.lit("Allow"))


def _flat(s):
    return s.select("sid", F.array_join("action", ",").alias("action"), F.array_join("resource", ",").alias("resource"))


@query(f"""WITH {_STMT}, h AS (SELECT *, sid = (SELECT min(sid) FROM s) AND list_contains(action, 'act:7') AS here FROM s)
SELECT sid, array_to_string(CASE WHEN here AND len(action) > 1 THEN list_filter(action, lambda a: a <> 'act:7') ELSE action END, ',') AS action, array_to_string(CASE WHEN here AND len(action) = 1 THEN ['r:1', 'r:2'] ELSE resource END, ',') AS resource FROM h
UNION ALL SELECT sid || '_Scoped', 'act:7', 'r:1,r:2' FROM h WHERE here AND len(action) > 1""")
def scope_edit(spark, d):
    s = _statements(spark, d)
    return _flat(repair.ScopeResource(s.agg(F.min("sid")).collect()[0][0], "act:7", ["r:2", "r:1"]).apply(s))


@query(f"""WITH {_STMT} SELECT sid, array_to_string(CASE WHEN sid = (SELECT min(sid) FROM s) THEN list_filter(action, lambda a: a <> 'act:7') ELSE action END, ',') AS action, array_to_string(resource, ',') AS resource FROM s""")
def remove_edit(spark, d):
    s = _statements(spark, d)
    return _flat(repair.RemoveAction(s.agg(F.min("sid")).collect()[0][0], "ACT:7").apply(s))


@query("""WITH e AS (SELECT DISTINCT 'user/' || user_id AS r, 'app:' || event_type AS a FROM events) SELECT 'view' AS sid, array_to_string(list_sort(list(r)), ',') AS resources FROM e WHERE a = 'app:view' AND r <> 'user/7' UNION ALL
SELECT 'p-teens', array_to_string(list_sort(list(DISTINCT r)), ',') FROM e WHERE a GLOB 'app:p*' AND r GLOB 'user/1?'""")
def evidenced_resources(spark, d):
    s = spark.createDataFrame([("view", "Allow", ["app:view"], ["*"]), ("p-teens", "Allow", ["app:p*"], ["user/1?"]), ("none", "Deny", ["*"], ["*"])], "sid string, effect string, action array<string>, resource array<string>")
    return repair.evidenced_resources(star.requests(spark, d).select("action", "resource_arn").distinct(), s, "user/7").select("sid", F.array_join("resources", ",").alias("resources"))


@query(f"""{G}, {TARGETS}, sources AS (SELECT id FROM nodes WHERE node_type IN ('User', 'Role') AND NOT is_admin), goal AS (SELECT id FROM nodes WHERE is_high_value OR (is_admin AND node_type = 'Role')), base AS (SELECT src, dst FROM edges WHERE relation <> 'PassesTo'),
o AS (SELECT id AS s, id AS t, 0 AS h FROM sources UNION SELECT o.s, e.dst, o.h + 1 FROM o JOIN base e ON e.src = o.t WHERE o.h < 8), n AS (SELECT id AS s, id AS t, 0 AS h FROM sources UNION SELECT n.s, e.dst, n.h + 1 FROM n JOIN edges e ON e.src = n.t WHERE n.h < 8)
SELECT DISTINCT s AS source, t AS target FROM n WHERE s <> t AND t IN (SELECT id FROM goal) AND (s, t) NOT IN (SELECT (s, t) FROM o)""")
def side_effects(spark, d):
    n, e = _graph(spark, d)
    return verify.side_effects(e.where("relation <> 'PassesTo'"), e, n)


_LEVELS = f"""{TARGETS}, {CANDIDATES}, {WORLDS}, asked AS (SELECT DISTINCT src AS source, b.id AS target FROM cand, (SELECT min(id) AS id FROM targets WHERE id LIKE 'role:%') b WHERE src <> b.id),
rep AS (SELECT src, dst FROM observed WHERE relation <> 'AssumesRole'), cuts AS (SELECT DISTINCT src, dst FROM observed EXCEPT SELECT src, dst FROM rep), tru AS (SELECT src, dst FROM edges EXCEPT SELECT src, dst FROM cuts),
a1 AS (SELECT source AS s, source AS t FROM asked UNION SELECT a1.s, e.dst FROM a1 JOIN rep e ON e.src = a1.t), a3 AS (SELECT source AS s, source AS t FROM asked UNION SELECT a3.s, e.dst FROM a3 JOIN tru e ON e.src = a3.t),
we AS (SELECT i AS sample_id, src, dst FROM rep, (SELECT unnest(range({SAMPLES})) AS i) UNION SELECT sample_id, src, dst FROM worlds WHERE (src, dst) NOT IN (SELECT (src, dst) FROM cuts)),
a2 AS (SELECT i AS sample_id, source AS s, source AS t FROM asked, (SELECT unnest(range({SAMPLES})) AS i) UNION SELECT a2.sample_id, a2.s, e.dst FROM a2 JOIN we e ON e.src = a2.t AND e.sample_id = a2.sample_id),
lv AS (SELECT source, target, CASE WHEN (source, target) IN (SELECT (s, t) FROM a1) THEN 1.0 ELSE 0.0 END AS l1, (SELECT count(DISTINCT sample_id) FROM a2 WHERE s = source AND t = target) / {SAMPLES} AS l2, CASE WHEN (source, target) IN (SELECT (s, t) FROM a3) THEN 1.0 ELSE 0.0 END AS l3 FROM asked)"""


@query(f"{G}, {_LEVELS} SELECT *, CASE WHEN l1 > 0 THEN 'UNSAFE' WHEN l2 > 0 OR l3 > 0 THEN 'MISLEADING_SAFE' ELSE 'SAFE' END AS status FROM lv")
def three_level_verify(spark, d):
    n, o, c, w = _worlds(spark, d)
    goal = n.where("is_admin and id like 'role:%'").agg(F.min("id").alias("target"))
    asked = c.select(F.col("src").alias("source")).distinct().crossJoin(F.broadcast(goal)).where("source <> target")
    return verify.three_levels(o, o.where("relation <> 'AssumesRole'"), star.edges(spark, d), w, asked, SAMPLES)


_POINTS = """pt AS (SELECT n_name AS method, round(avg(s_acctbal) / 10000, 4) AS level3_risk, round(count(*) / 100.0, 4) AS t2_breakage, CAST(n_nationkey % 7 AS DOUBLE) AS transformation_cost FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name, n_nationkey),
dm AS (SELECT a.method AS a, b.method AS b, a.level3_risk < b.level3_risk - 1e-6 OR a.t2_breakage < b.t2_breakage - 1e-6 OR a.transformation_cost < b.transformation_cost - 1e-6 AS better, a.level3_risk > b.level3_risk + 1e-6 OR a.t2_breakage > b.t2_breakage + 1e-6 OR a.transformation_cost > b.transformation_cost + 1e-6 AS worse FROM pt a JOIN pt b ON a.method <> b.method),
rel AS (SELECT a, b, CASE WHEN better AND NOT worse THEN 'dominates' WHEN worse AND NOT better THEN 'dominated_by' WHEN NOT better AND NOT worse THEN 'equivalent' ELSE 'incomparable' END AS relation FROM dm)"""


def _points(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return step(s.groupBy(F.col("n_name").alias("method"), "n_nationkey").agg(F.round(F.avg("s_acctbal") / 10000, 4).alias("level3_risk"), F.round(F.count("*") / 100, 4).alias("t2_breakage")).withColumn("transformation_cost", (F.col("n_nationkey") % 7).cast("double")))


@query(f"WITH {_POINTS} SELECT a, b, relation FROM rel")
def pareto_dominance(spark, d):
    return verify.dominance(_points(spark, d))


@query(f"WITH {_POINTS} SELECT method, count(*) FILTER (relation = 'dominated_by') = 0 AS on_frontier, coalesce(string_agg(b, ',' ORDER BY b) FILTER (relation = 'dominates'), '') AS dominates, coalesce(string_agg(b, ',' ORDER BY b) FILTER (relation = 'dominated_by'), '') AS dominated_by FROM pt JOIN rel ON a = method GROUP BY method")
def pareto_frontier(spark, d):
    return verify.frontier(_points(spark, d))


@query("SELECT o_orderstatus AS method, count(*) AS runs, round(avg(o_totalprice), 6) AS o_totalprice_mean, round(stddev_samp(o_totalprice), 6) AS o_totalprice_std FROM orders GROUP BY 1")
def tradeoff_summary(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_orderstatus", "method")
    s = verify.summarize(o, ["o_totalprice"])
    return s.select("method", "runs", "o_totalprice_mean", "o_totalprice_std")


@query()
def greedy_repair(spark, d):
    n, o, c, w = _worlds(spark, d)
    asked = c.select(F.col("src").alias("id")), n.where("is_admin and id like 'role:%'").select("id")
    cuts = step(c.select(F.concat_ws("|", "src", "dst").alias("option"), "src", "dst", F.lit(1.0).alias("cost")))
    used = star.edges(spark, d).where("relation in ('AssumesRole', 'PassesTo')").where(uniform("dst", "src") < 0.75)
    return repair.greedy_cuts(o, w, asked, cuts, SAMPLES, used=used)


@query(f"""{G}, st AS (SELECT 'policy:' || p_partkey AS policy_id, CASE WHEN p_partkey % 3 = 0 THEN 'act:1*' ELSE 'act:' || p_size END AS pattern, CASE WHEN p_partkey % 2 = 0 THEN ['role:*'] ELSE ['resource:Brand#1?', 'role:1*'] END AS res FROM part),
cut AS (SELECT src, dst, relation, 'act:' || p_size AS act FROM edges JOIN part ON src = 'policy:' || p_partkey WHERE relation = 'ActsOn' UNION ALL SELECT src, dst, relation, 'act:12' FROM edges WHERE relation = 'PassesTo'),
ways AS (SELECT c.src, c.dst, c.relation, c.act, a.dst AS policy_id, c.src AS own FROM cut c JOIN edges a ON a.src = c.src AND a.relation = 'AttachedWith' UNION ALL SELECT src, dst, relation, act, src, NULL FROM cut)
SELECT DISTINCT w.src, w.dst, w.relation, w.policy_id, s.pattern, w.own, w.dst AS goal FROM ways w JOIN st s ON s.policy_id = w.policy_id WHERE w.act GLOB s.pattern AND len(list_filter(s.res, lambda r: w.dst GLOB r OR coalesce(w.own GLOB r, false))) > 0""")
def edge_supports(spark, d):
    p, e = table(spark, d, "part"), star.edges(spark, d)
    act, policy_id = F.concat(F.lit("act:"), F.col("p_size").cast("string")), F.concat(F.lit("policy:"), F.col("p_partkey").cast("string"))
    pattern = F.when(F.col("p_partkey") % 3 == 0, "act:1*").otherwise(act)
    names = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("role:*"))).otherwise(F.array(F.lit("resource:Brand#1?"), F.lit("role:1*")))
    parts = repair.policy_parts(p.select(policy_id.alias("policy_id"), F.lit("s").alias("sid"), F.lit("Allow").alias("effect"), F.array(pattern).alias("action"), names.alias("resource")))
    own = e.where("relation = 'ActsOn'").join(p.select(policy_id.alias("src"), F.array(act).alias("actions")), "src").select("src", "dst", "relation", "actions")
    cuts = own.unionByName(e.where("relation = 'PassesTo'").select("src", "dst", "relation", F.array(F.lit("act:12")).alias("actions")))
    found = repair.edge_supports(cuts, parts, star.nodes(spark, d).withColumn("arn", F.col("id")), e)
    return found.join(parts.select("part", "policy_id", "pattern"), "part").select("src", "dst", "relation", "policy_id", "pattern", "own", "goal")


#: Line numbers and return flags of large lines are what could be given up by a nation; each of its orders needs one to go.
_GIVE_UP = """lines AS (SELECT c_nationkey AS nation, l_orderkey AS path, l_linenumber, l_returnflag FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_quantity >= 25),
need AS (SELECT DISTINCT nation, path, 'line ' || l_linenumber AS what FROM lines UNION SELECT nation, path, 'flag ' || l_returnflag FROM lines WHERE l_returnflag <> 'N'),
price AS (SELECT nation, what, 1 + CAST(('0x' || substr(md5(nation || '|' || what), 1, 2)) AS BIGINT) % 7 AS cost, row_number() OVER (PARTITION BY nation ORDER BY what) - 1 AS bit FROM (SELECT DISTINCT nation, what FROM need)),
masks AS (SELECT DISTINCT nation, m FROM (SELECT n.nation, path, CAST(sum(1 << bit) AS BIGINT) AS m FROM need n JOIN price p ON p.nation = n.nation AND p.what = n.what GROUP BY n.nation, path)),
tried AS (SELECT nation, s, CAST(sum(CASE WHEN (s >> bit) & 1 = 1 THEN cost ELSE 0 END) AS DOUBLE) AS cost FROM price, (SELECT unnest(range(512)) AS s) GROUP BY nation, s)"""


@query(f"WITH {_GIVE_UP} SELECT t.nation, min(cost) AS cost FROM tried t WHERE NOT EXISTS (SELECT 1 FROM masks k WHERE k.nation = t.nation AND k.m & t.s = 0) GROUP BY t.nation")
def exact_repair(spark, d):
    lines = table(spark, d, "lineitem").where("l_quantity >= 25").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    what = F.explode(F.array_compact(F.array(F.concat(F.lit("line "), F.col("l_linenumber").cast("string")), F.when(F.col("l_returnflag") != "N", F.concat(F.lit("flag "), "l_returnflag")))))
    need = lines.select(F.col("c_nationkey").alias("nation"), F.col("l_orderkey").alias("path_id"), what.alias("what")).withColumn("option", F.concat_ws("|", F.col("nation").cast("string"), "what"))
    byte = F.conv(F.substring(F.md5("option"), 1, 2), 16, 10).cast("long")
    chosen = hitting.cheapest(need.select("path_id", "option"), need.select("option", (1 + byte % 7).cast("double").alias("cost")).distinct())
    return chosen.groupBy(F.split("option", r"\|")[0].cast("long").alias("nation")).agg(F.sum("cost").alias("cost"))


@query()
def repair_gap(spark, d):
    n, o, c, w = _worlds(spark, d)
    asked = c.select(F.col("src").alias("id")), n.where("is_admin and id like 'role:%'").select("id")
    cuts = step(c.select(F.concat_ws("|", "src", "dst").alias("option"), "src", "dst", F.lit(1.0).alias("cost")))
    return hitting.compare_with_greedy(hitting.cheapest_cuts(o, w, asked, cuts, SAMPLES), repair.greedy_cuts(o, w, asked, cuts, SAMPLES), 0.0)


@query()
def method_tradeoff(spark, d):
    n, o, c, w = _worlds(spark, d)
    goal = n.where("is_admin and id like 'role:%'").agg(F.min("id").alias("target"))
    asked = step(c.select(F.col("src").alias("source")).distinct().crossJoin(F.broadcast(goal)).where("source <> target"))
    truth = star.edges(spark, d)
    used = truth.where("relation in ('AssumesRole', 'PassesTo')").select("src", "dst", F.when(uniform("dst", "src") < 0.75, "T1").otherwise("T2").alias("win"))
    none = o.select("src", "dst").limit(0)
    likely = c.where("probability >= 0.5").select("src", "dst")
    cuts = {"no_action": none, "oracle": c.select("src", "dst"), "coarse": o.where("relation = 'AssumesRole'").select("src", "dst"), "log_only": used.where("win = 'T2'").select("src", "dst"), "point": likely, "uncertain": c.where("probability >= 0.35").select("src", "dst")}
    return verify.remediation_methods(o, truth, w, cuts, asked, used, SAMPLES, {"coarse": 10.0, "oracle": 1.0, "point": 1.0, "uncertain": 1.0, "log_only": 4.0})


@query()
def policy_diff(spark, d):
    e = table(spark, d, "events").select("event_type").distinct()
    doc = lambda r: F.format_string('{\n "Action": "app:%s",\n "Resource": "%s"\n}', "event_type", F.lit(r))
    return repair.policy_diff(e.select(F.col("event_type").alias("policy_id"), doc("*").alias("doc")), e.select(F.col("event_type").alias("policy_id"), doc("user/1").alias("doc")))


# --- models ---

COLUMNS = ["common_neighbours", "jaccard", "adamic_adar", "preferential_attachment", "resource_allocation", "out_degree_u", "in_degree_u", "out_degree_v", "in_degree_v", "same_department", "other_department", "v_high", "cross_account"]


def _labelled(spark, d):
    n, e = _graph(spark, d)
    neg = masking.negatives(e, n, "AssumesRole", "User", "Role")
    p = step(models.labelled_pairs(e.where("relation = 'AssumesRole'").select("src", "dst").distinct(), neg))
    seen = step(e.join(p.where("test and y = 1").select(F.col("u").alias("src"), F.col("v").alias("dst")), ["src", "dst"], "left_anti"))
    return n, seen, p


def _tree_scores(spark, d, fit):
    n, e, p = _labelled(spark, d)
    f = step(pairs.features(p.select("u", "v"), e, n).join(p, ["u", "v"]))
    return models.predict(fit(f.where("not test"), COLUMNS), f.where("test"), COLUMNS).select("u", "v", "y", "score")


@query()
def rf_scores(spark, d):
    return _tree_scores(spark, d, lambda t, c: models.random_forest(t, c))


@query()
def gbt_scores(spark, d):
    return _tree_scores(spark, d, lambda t, c: models.boosted_trees(t, c))


#: A short run: typed full matrices come out ahead of the untyped and the untrained encoder (figures in the README).
RGCN = training.Config(form="bilinear", rate=0.01, epochs=12)


@query()
def rgcn_scores(spark, d):
    n, e = _graph(spark, d)
    p, seen = training.link_task(e, n)
    graph = training.Graph.of(seen, models.node_features(n, seen, star.SEGMENTS, star.ACCOUNTS), RGCN)
    model = training.fit(graph, p.where("part <> 'test'"), RGCN)
    return training.score(graph, p.where("part = 'test'"), model)


@query()
def baseline_suite(spark, d):
    n, e, p = _labelled(spark, d)
    acts = n.select("id", F.array(F.lit("sts:AssumeRole")).alias("acts"))
    predictors = {
        "motif": lambda edges, nodes, asked: pairs.motif_scores(asked.select("u", "v"), edges, nodes, acts),
        "steps": lambda edges, nodes, asked: reach.step_scores(asked.select(F.col("u").alias("source"), F.col("v").alias("target")), edges).select(F.col("source").alias("u"), F.col("target").alias("v"), "score"),
    }
    return models.evaluate_suite(predictors, e, n, p.where("test"))


# --- synthesis, workloads, files, streams ---

@query()
def topology(spark, d):
    n, e = synthesis.topology(spark, 1000)
    return n.groupBy("node_type", "department").agg(F.count("*").alias("n")).unionByName(e.groupBy("relation").agg(F.count("*").alias("n")).select(F.col("relation").alias("node_type"), F.lit(None).cast("string").alias("department"), "n"))


@query("WITH m(motif) AS (VALUES " + ", ".join(f"('{m}')" for m in synthesis.MOTIFS) + ") SELECT motif || '-' || i AS motif_id, true AS connected, true AS severed FROM m, (SELECT unnest(range(5)) AS i)")
def motif_truth(spark, d):
    n = e = None
    for name in synthesis.MOTIFS:
        a, b = synthesis.inject(spark, name, 5)
        n, e = (a, b) if n is None else (n.unionByName(a), e.unionByName(b))
    return synthesis.motif_truth(step(n), step(e))


@query("SELECT 'diamond-' || i AS motif_id, 1 AS one_left, 1 AS all_gone FROM (SELECT unnest(range(5)) AS i)")
def branching_truth(spark, d):
    n, e = synthesis.diamond(spark, 5)
    return synthesis.branching_truth(step(n), step(e))


@query()
def corpus_sizes(spark, d):
    n, _ = synthesis.corpus(spark)
    return n.groupBy("split", "org_id").agg(F.count("*").alias("n"))


@query()
def synthetic_workload(spark, d):
    n, e = _graph(spark, d)
    events = workload.synthesize(workload.routine_operations(e, n), 30, 10, 50)
    return workload.split_days(events, 30, 10).groupBy("win", "is_drift", "drift_type").agg(F.count("*").alias("n"))


@query(f"""{G}, idx AS (SELECT id, node_type, row_number() OVER (PARTITION BY node_type ORDER BY id) - 1 AS idx FROM nodes),
f AS (SELECT a.node_type AS src_type, relation, b.node_type AS dst_type, a.idx AS s, b.idx AS d, is_bridge, row_number() OVER (PARTITION BY a.node_type, relation, b.node_type ORDER BY a.idx, b.idx, is_bridge) - 1 AS place FROM edges JOIN idx a ON src = a.id JOIN idx b ON dst = b.id)
SELECT src_type, relation, dst_type, string_agg(s, ',' ORDER BY place) AS src_index, string_agg(d, ',' ORDER BY place) AS dst_index, coalesce(string_agg(place, ',' ORDER BY place) FILTER (is_bridge), '') AS bridges FROM f GROUP BY ALL""")
def index_files(spark, d):
    lists = [F.array_join(c, ",").alias(c) for c in ("src_index", "dst_index", "bridges")]
    return graphs.index_encoded(*_graph(spark, d)).select("src_type", "relation", "dst_type", *lists)


@query()
def graph_files(spark, d):
    n, e = synthesis.topology(spark, 200)
    path = f"{_root(spark)}/graph-{uuid.uuid4().hex}"
    out = None
    for name, doc in (("structured", graphs.structured(n, e)), ("link", graphs.node_link(n, e))):
        graphs.write_json(doc, f"{path}-{name}", True)
        a, b = graphs.read_json(spark, f"{path}-{name}")
        one = a.agg(F.count("*").alias("nodes")).crossJoin(b.agg(F.count("*").alias("edges"))).select(F.lit(name).alias("form"), "nodes", "edges")
        out = one if out is None else out.unionByName(one)
    return out


def _root(spark) -> str:
    return shared_folder(spark)


@query("""SELECT * FROM (VALUES ('user:ana', 'group:ops', 'MemberOf'), ('role:worker', 'policy:read', 'AttachedWith'), ('group:ops', 'policy:ReadOnlyAccess', 'AttachedWith'), ('policy:read', 'resource:arn:aws:s3:::lake/x', 'ActsOn'), ('user:ana', 'role:worker', 'AssumesRole')) t(src, dst, relation)""")
def hcl_ingest(spark, d):
    found = terraform.blocks(spark.createDataFrame([("main.tf", terraform.FIXTURE)], "path string, text string"))
    return terraform.to_graph(step(found))[1]


# the batch twin: days that end an hour or more before the last event, which is where the watermark stands
@query(f"""WITH {REQUESTS_SQL}, days AS (SELECT date_trunc('day', ts) AS day, decision FROM decided)
SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS requests, count(*) FILTER (decision = 'Allow') AS allowed, count(*) FILTER (decision = 'ExplicitDeny') AS explicit_denies, count(*) FILTER (decision = 'ImplicitDeny') AS implicit_denies, round(1 - count(*) FILTER (decision = 'Allow') / count(*), 9) AS breakage
FROM days WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY day""")
def stream_breakage(spark, d):
    folder = f"{_root(spark)}/stream-{uuid.uuid4().hex}"
    table(spark, d, "events").repartition(4).write.parquet(folder)
    codes = breakage.decided(breakage.as_requests(breakage.read_events(spark, folder)), star.statements(spark))
    found = breakage.run_once(breakage.breakage(codes), f"breakage_{uuid.uuid4().hex}", f"{folder}-state")
    return found.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "requests", "allowed", "explicit_denies", "implicit_denies", F.round("breakage", 9).alias("breakage"))


@query(f"{G}, {TARGETS}, {SOURCES}, {CANDIDATES}, {WORLDS}, {USED} SELECT src, dst, relation, is_bridge, sample_share, path_count FROM used")
def participation(spark, d):
    return _used(spark, d)


@query(f"{G}, p AS (SELECT src AS principal, dst AS policy FROM edges WHERE relation = 'AttachedWith' UNION ALL SELECT m.src, a.dst FROM edges m JOIN edges a ON m.dst = a.src WHERE m.relation = 'MemberOf' AND a.relation = 'AttachedWith') SELECT principal, count(*) AS n, min(policy) AS first FROM p GROUP BY principal")
def governing_policies(spark, d):
    return policy.governing_counts(star.edges(spark, d))



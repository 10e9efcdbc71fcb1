"""Queries of graph upkeep and lookups, the action vocabulary, principals' actions and decisions on the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatelens.functions.conditions import block_holds
from gatelens.operators import graph, masking, policy, reach, resync, uncertain, vocabulary
from gatelens.plans.graph_queries import CANDIDATES, G, WORLDS, _graph, _worlds
from gatelens.plans.registry import query
from gatelens.plans.steps import shared_folder, step
from gatelens.sources import star
from gatelens.sources.star import table

TRIPLE = ["src", "dst", "relation"]


@query(f"{G} SELECT src, dst, relation, is_bridge FROM edges WHERE relation = 'AssumesRole' AND is_bridge")
def bridge_edges(spark, d):
    return graph.find_edges(star.edges(spark, d), relation="AssumesRole", bridge=True).select(*TRIPLE, "is_bridge")


@query(f"{G} SELECT id, node_type, department FROM nodes WHERE node_type = 'Role' AND is_admin")
def admin_roles(spark, d):
    return graph.find_nodes(star.nodes(spark, d), node_type="Role", admin=True).select("id", "node_type", "department")


@query(f"{G} SELECT src, dst, relation FROM edges WHERE NOT (relation = 'PassesTo' AND is_bridge)")
def edges_removed(spark, d):
    e = step(star.edges(spark, d))
    return graph.remove_edges(e, e.where("relation = 'PassesTo' and is_bridge")).select(*TRIPLE)


@query(f"""{G} SELECT src, dst, relation, CASE WHEN relation = 'MemberOf' THEN true ELSE is_bridge END AS is_bridge FROM edges
UNION ALL SELECT dst, src, 'ManagedBy', false FROM edges WHERE relation = 'MemberOf'""")
def edges_upserted(spark, d):
    n, e = _graph(spark, d)
    member = e.where("relation = 'MemberOf'")
    new = member.withColumn("is_bridge", F.lit(True)).unionByName(member.selectExpr("dst as src", "src as dst", "'ManagedBy' as relation", "false as is_bridge", "u"))
    return graph.add_edges(n, e.select(*TRIPLE, "is_bridge"), new.select(*TRIPLE, "is_bridge")).select(*TRIPLE, "is_bridge")


@query(f"{G} SELECT src, dst, relation FROM edges WHERE src NOT IN (SELECT id FROM nodes WHERE node_type <> 'Group') OR dst NOT IN (SELECT id FROM nodes WHERE node_type <> 'Group')")
def edges_dangling(spark, d):
    n, e = _graph(spark, d)
    return graph.dangling_edges(n.where("node_type <> 'Group'"), e).select(*TRIPLE)


@query(f"""{G}, c AS (SELECT id AS center FROM nodes WHERE node_type = 'Role' AND is_admin), m AS (SELECT center, center AS id FROM c UNION SELECT center, dst FROM c JOIN edges ON src = center UNION SELECT center, src FROM c JOIN edges ON dst = center)
SELECT a.center, e.src, e.dst, e.relation FROM edges e JOIN m a ON a.id = e.src JOIN m b ON b.id = e.dst AND b.center = a.center""")
def induced_edges(spark, d):
    n, e = _graph(spark, d)
    near = reach.ego(e, n.where("node_type = 'Role' and is_admin").select("id"), 1)
    return reach.ego_edges(e, step(near.select("center", "id").distinct())).select("center", *TRIPLE)


_VOCABULARY = "vocab AS (SELECT CAST(row_number() OVER (ORDER BY lower(a)) AS INTEGER) AS idx, a AS action FROM (SELECT DISTINCT 'app:' || event_type AS a FROM events))"


def _vocabulary(spark, d):
    return vocabulary.build(table(spark, d, "events").select(F.concat(F.lit("app:"), "event_type").alias("action")))


@query(f"WITH {_VOCABULARY} SELECT idx, action FROM vocab")
def vocabulary_file(spark, d):
    path = f"{shared_folder(spark)}/vocabulary-{spark.sparkContext.applicationId}.json"
    vocabulary.write(_vocabulary(spark, d), path)
    return vocabulary.read(spark, path)


_ASKED = """asked AS (SELECT user_id AS id, list_distinct(list('app:' || upper(event_type))) || CASE WHEN user_id % 3 = 0 THEN ['app:p*'] ELSE [] END || CASE WHEN user_id % 5 = 0 THEN ['app:none'] ELSE [] END AS actions FROM events GROUP BY user_id)"""


@query(f"""WITH {_VOCABULARY}, {_ASKED}, said AS (SELECT id, unnest(actions) AS a FROM asked),
idx AS (SELECT DISTINCT id, coalesce(idx, 0) AS i FROM said LEFT JOIN vocab ON lower(action) = lower(a) OR (a = 'app:p*' AND starts_with(action, 'app:p')))
SELECT id, array_to_string(list(i ORDER BY i), ',') AS indices, (SELECT coalesce(string_agg(action, ',' ORDER BY v.idx), '') FROM vocab v JOIN idx k ON k.i = v.idx WHERE k.id = x.id) AS actions FROM idx x GROUP BY id""")
def vocabulary_encoding(spark, d):
    v = step(_vocabulary(spark, d))
    size = v.count() + 1
    asked = table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.collect_set(F.concat(F.lit("app:"), F.upper("event_type"))).alias("actions"))
    more = lambda k, name: F.when(F.col("id") % k == 0, F.array(F.lit(name))).otherwise(F.expr("cast(array() as array<string>)"))
    coded = step(vocabulary.encode(asked.withColumn("actions", F.concat("actions", more(3, "app:p*"), more(5, "app:none"))), v))
    back = vocabulary.decode(coded.select("id", vocabulary.multi_hot(F.col("indices"), size).alias("vector")), v)
    return coded.join(back, "id").select("id", F.array_join(F.transform("indices", lambda i: i.cast("string")), ",").alias("indices"), F.array_join("actions", ",").alias("actions"))


def _part_statements(spark, d):
    """A statement for each part: all may be done everywhere, or the part's type on its brand."""
    p = table(spark, d, "part")
    empty = F.expr("cast(array() as array<string>)")
    act = F.when(F.col("p_size") % 7 == 0, F.array(F.lit("app:view"), F.lit(" * "))).otherwise(F.array(F.concat(F.lit("app:"), F.lower(F.split_part("p_type", F.lit(" "), F.lit(1))))))
    where = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("*"))).otherwise(F.array(F.concat(F.lit("resource:"), "p_brand")))
    effect = F.when(F.col("p_size") % 5 == 0, "Deny").otherwise("Allow")
    none = F.lit(None)
    maps = "map<string, array<string>>"
    return p.select(
        F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("sid"), effect.alias("effect"), none.cast(maps).alias("principal"), none.cast(maps).alias("not_principal"), act.alias("action"), empty.alias("not_action"),
        where.alias("resource"), empty.alias("not_resource"), none.cast(f"map<string, {maps}>").alias("condition"), F.concat(F.lit("policy:"), F.col("p_partkey").cast("string")).alias("policy_id"),
    )


_PART = """st AS (SELECT 'policy:' || p_partkey AS policy_id, CASE WHEN p_size % 5 = 0 THEN 'Deny' ELSE 'Allow' END AS effect, p_size % 7 = 0 AS every, 'app:' || lower(split_part(p_type, ' ', 1)) AS act, p_size % 3 = 0 AS everywhere, 'resource:' || p_brand AS place FROM part)"""
_GOVERN = """gov AS (SELECT src AS principal, dst AS policy FROM edges WHERE relation = 'AttachedWith' UNION SELECT m.src, a.dst FROM edges m JOIN edges a ON m.dst = a.src WHERE m.relation = 'MemberOf' AND a.relation = 'AttachedWith')"""


@query(f"WITH {_PART} SELECT policy_id FROM st WHERE effect = 'Allow' AND every AND everywhere")
def admin_policies(spark, d):
    return policy.grants_all(_part_statements(spark, d))


@query(f"""{G}, {_PART}, {_GOVERN}, said AS (SELECT DISTINCT principal, unnest(CASE WHEN every THEN ['app:view', ' * '] ELSE [act] END) AS a FROM gov JOIN st ON policy = policy_id WHERE effect = 'Allow')
SELECT id AS principal, coalesce((SELECT string_agg(a, ',' ORDER BY a) FROM said WHERE principal = id), '') AS actions FROM nodes WHERE node_type IN ('User', 'Role')""")
def effective_actions(spark, d):
    n, e = _graph(spark, d)
    return vocabulary.effective_actions(n, e, _part_statements(spark, d)).select("principal", F.array_join("actions", ",").alias("actions"))


@query(f"""{G}, {_PART}, {_GOVERN}, asked AS (SELECT CAST(c_custkey AS VARCHAR) AS req_id, 'user:' || c_custkey AS who, 'app:' || lower(split_part(p_type, ' ', 1)) AS act, 'resource:' || p_brand AS place FROM customer JOIN part ON p_partkey = c_custkey),
hit AS (SELECT req_id, effect FROM asked a JOIN gov ON principal = who JOIN st ON policy_id = policy WHERE (every OR st.act = a.act) AND (everywhere OR st.place = a.place))
SELECT req_id, CASE WHEN req_id IN (SELECT req_id FROM hit WHERE effect = 'Deny') THEN 'ExplicitDeny' WHEN req_id IN (SELECT req_id FROM hit) THEN 'Allow' ELSE 'ImplicitDeny' END AS decision FROM asked""")
def graph_decision(spark, d):
    n, e = _graph(spark, d)
    asked = table(spark, d, "customer").join(table(spark, d, "part"), F.col("p_partkey") == F.col("c_custkey"))
    r = asked.select(
        F.col("c_custkey").cast("string").alias("req_id"), F.concat(F.lit("USER:"), F.col("c_custkey").cast("string")).alias("principal_arn"), F.concat(F.lit("app:"), F.lower(F.split_part("p_type", F.lit(" "), F.lit(1)))).alias("action"),
        F.concat(F.lit("resource:"), "p_brand").alias("resource_arn"), F.expr("cast(map() as map<string, array<string>>)").alias("context"),
    )
    s = step(_part_statements(spark, d))
    return policy.evaluate_on_graph(r, n.withColumn("arn", F.col("id")), e, s, s.limit(0))


@query(f"""{G}, pos AS (SELECT DISTINCT src, dst FROM edges WHERE relation = 'AssumesRole'), t AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM nodes WHERE node_type = 'Role'), m AS (SELECT count(*) AS m FROM t)
SELECT src, t.id AS dst, draw FROM (SELECT src, draw, CAST(floor(CAST(('0x' || substr(md5('uniform|0|' || src || '|' || dst || '|' || draw), 1, 12)) AS UBIGINT) / 281474976710656.0 * m) AS BIGINT) AS idx FROM pos, m, (SELECT CAST(unnest(range(1, 3)) AS INTEGER) AS draw)) JOIN t USING (idx)""")
def uniform_negatives(spark, d):
    n, e = _graph(spark, d)
    return masking.uniform_negatives(e, n, "AssumesRole", "Role", 2)


@query("SELECT CAST(event_id AS VARCHAR) AS req_id, user_id IN (7, 11) AS same, user_id <> 7 AS other FROM events")
def arn_conditions(spark, d):
    r = star.requests(spark, d)
    ctx = F.create_map(F.lit("aws:PrincipalArn"), F.array(F.concat(F.lit(" "), "principal_arn")))
    block = lambda op, *names: F.create_map(F.lit(op), F.create_map(F.lit("aws:PrincipalArn"), F.array(*[F.lit(x) for x in names])))
    return r.select("req_id", block_holds(block("ArnEquals", "arn:user/7", "arn:user/11 "), ctx).alias("same"), block_holds(block("ArnNotEquals", "arn:user/7 "), ctx).alias("other"))


@query(f"""{G}, {CANDIDATES}, {WORLDS}, use AS (SELECT src, dst, relation, count(*) AS n FROM worlds GROUP BY ALL), top AS (SELECT * FROM use ORDER BY n DESC, src, dst, relation LIMIT 10), best AS (SELECT DISTINCT src, dst, relation FROM cand WHERE probability >= 0.5)
SELECT CASE WHEN (SELECT count(*) FROM best) = 0 THEN 1.0 ELSE (SELECT count(*) FROM best JOIN top USING (src, dst, relation)) / (SELECT count(*) FROM best) END AS recall""")
def candidate_recall(spark, d):
    _, _, c, w = _worlds(spark, d)
    top = w.groupBy(*TRIPLE).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src", "dst", "relation").limit(10)
    return uncertain.candidate_recall(top, c.where("probability >= 0.5"))


# --- trust and edits: parts grant roles beside what _part_statements says, suppliers' roles have trust ---

_ROLES_PART = """grants AS (SELECT 'policy:' || p_partkey AS policy_id, p_partkey, p_size, 'app:' || lower(split_part(p_type, ' ', 1)) AS act, CASE WHEN p_size % 3 = 0 THEN '*' ELSE 'resource:' || p_brand END AS place FROM part),
before AS (SELECT policy_id, p_partkey, 's' AS sid, CASE WHEN p_size % 5 = 0 THEN 'Deny' ELSE 'Allow' END AS effect, unnest(CASE WHEN p_size % 7 = 0 THEN ['app:view', '*'] ELSE [act] END) AS pattern, place FROM grants
  UNION ALL SELECT policy_id, p_partkey, 't', 'Allow', unnest(['sts:assumerole', 'iam:passrole']), CASE WHEN p_partkey % 4 = 0 THEN 'role:*' ELSE 'role:1*' END FROM grants WHERE p_partkey % 2 = 0),
roles AS (SELECT 'role:' || s_suppkey AS role, s_suppkey FROM supplier)"""
_WAYS = """gov AS (SELECT src AS principal, dst AS policy FROM edges WHERE relation = 'AttachedWith' UNION SELECT m.src, a.dst FROM edges m JOIN edges a ON m.dst = a.src WHERE m.relation = 'MemberOf' AND a.relation = 'AttachedWith')"""


def _role_statements(spark, d):
    s = _part_statements(spark, d)
    k = F.substring_index("policy_id", ":", -1).cast("long")
    more = s.where(k % 2 == 0).withColumn("sid", F.concat(F.lit("t"), k.cast("string"))).withColumn("effect", F.lit("Allow")).withColumn("action", F.array(F.lit("sts:AssumeRole"), F.lit("iam:PassRole")))
    return s.unionByName(more.withColumn("resource", F.array(F.when(k % 4 == 0, "role:*").otherwise("role:1*"))))


def _trust(spark, d, name):
    """A trust statement of each supplier's role for one name, the column given."""
    none, maps = F.lit(None), "map<string, array<string>>"
    names = lambda c: none.cast(c)
    return table(spark, d, "supplier").select(
        F.lit("trust").alias("sid"), F.lit("Allow").alias("effect"), F.create_map(F.lit("AWS"), F.array(name)).alias("principal"), names(maps).alias("not_principal"), F.array(F.lit("sts:AssumeRole")).alias("action"), names("array<string>").alias("not_action"),
        names("array<string>").alias("resource"), names("array<string>").alias("not_resource"), names(f"map<string, {maps}>").alias("condition"), F.concat(F.lit("role:"), F.col("s_suppkey").cast("string")).alias("policy_id"),
    )


@query(f"""{G}, {_ROLES_PART}, {_WAYS}, asked AS (SELECT src, dst, src || '>' || dst AS req_id FROM edges WHERE relation = 'AssumesRole'),
own AS (SELECT req_id, bool_or(effect = 'Deny') AS no, bool_or(effect = 'Allow') AS yes FROM asked JOIN gov ON principal = src JOIN before b ON b.policy_id = policy WHERE 'sts:assumerole' GLOB pattern AND dst GLOB place GROUP BY req_id)
SELECT req_id, CASE WHEN s_suppkey % 2 = 1 AND s_suppkey % 10 <> 5 AND src <> 'user:' || 3 * s_suppkey THEN 'ImplicitDeny' WHEN no THEN 'ExplicitDeny' WHEN yes THEN 'Allow' ELSE 'ImplicitDeny' END AS decision FROM asked JOIN roles ON role = dst LEFT JOIN own USING (req_id)""")
def trust_decision(spark, d):
    """Users' requests to take on roles, of which some trust everybody, some one user, and some say nothing."""
    n, e = _graph(spark, d)
    k = F.col("s_suppkey")
    trust = _trust(spark, d, F.when(k % 2 == 0, "*").otherwise(F.concat(F.lit("user:"), (3 * k).cast("string")))).where("policy_id not like '%5'")
    r = e.where("relation = 'AssumesRole'").select(F.concat_ws(">", "src", "dst").alias("req_id"), F.col("src").alias("principal_arn"), F.lit("sts:AssumeRole").alias("action"), F.col("dst").alias("resource_arn"), F.expr("cast(map() as map<string, array<string>>)").alias("context"))
    return policy.evaluate_on_graph(r, n.withColumn("arn", F.col("id")), e, _role_statements(spark, d), trust)


@query(f"""{G}, {_ROLES_PART}, {_WAYS}, after AS (SELECT policy_id, effect, pattern, CASE WHEN sid = 't' AND p_partkey % 3 = 0 THEN 'role:*1' ELSE place END AS place, p_partkey FROM before WHERE NOT (sid = 's' AND p_partkey % 5 = 0 AND pattern <> '*')),
changed AS (SELECT policy_id FROM grants WHERE p_partkey % 6 = 0 OR p_partkey % 5 = 0),
acts AS (SELECT policy_id AS src, 'resource:' || p_brand AS dst, act FROM grants JOIN part USING (p_partkey)), ed AS (SELECT src, dst, relation, CAST([] AS VARCHAR[]) AS actions FROM edges WHERE relation <> 'ActsOn'
  UNION ALL SELECT src, dst, 'ActsOn', [act, 'app:view'] FROM acts UNION ALL SELECT e.src, a.dst, 'ActsOn', list_sort(list(DISTINCT a.act)) FROM edges e JOIN acts a ON a.src = e.dst WHERE e.relation = 'AttachedWith' AND e.src LIKE 'role:%' GROUP BY e.src, a.dst),
touched AS (SELECT src, dst, relation FROM ed JOIN gov ON principal = src JOIN changed ON policy_id = policy WHERE relation IN ('PassesTo', 'ActsOn', 'AssumesRole') UNION SELECT src, dst, relation FROM ed JOIN changed ON policy_id = src WHERE relation = 'ActsOn' UNION SELECT src, dst, relation FROM ed JOIN roles ON role = dst WHERE relation = 'AssumesRole' AND s_suppkey % 2 = 1),
asked AS (SELECT *, unnest(CASE relation WHEN 'PassesTo' THEN ['iam:passrole'] WHEN 'AssumesRole' THEN ['sts:assumerole'] ELSE actions END) AS act FROM ed JOIN touched USING (src, dst, relation)),
ways AS (SELECT a.src, a.dst, a.relation, a.act, policy FROM asked a JOIN gov ON principal = a.src UNION SELECT src, dst, relation, act, src FROM asked WHERE src LIKE 'policy:%'),
ok AS (SELECT w.src, w.dst, w.relation, w.act FROM ways w JOIN after ON policy_id = policy LEFT JOIN roles ON role = w.dst WHERE w.act GLOB pattern AND w.dst GLOB place AND NOT (w.relation = 'AssumesRole' AND s_suppkey % 2 = 1 AND (s_suppkey % 5 = 0 OR w.src <> 'user:' || 3 * s_suppkey)) GROUP BY ALL HAVING bool_and(effect = 'Allow')),
kept AS (SELECT src, dst, relation, list(act) AS acts FROM ok GROUP BY ALL)
SELECT ed.src, ed.dst, ed.relation, array_to_string(CASE WHEN ed.relation = 'ActsOn' AND t.src IS NOT NULL THEN list_filter(actions, lambda x: list_contains(acts, x)) ELSE actions END, ',') AS actions
FROM ed LEFT JOIN touched t ON t.src = ed.src AND t.dst = ed.dst AND t.relation = ed.relation LEFT JOIN kept k ON k.src = ed.src AND k.dst = ed.dst AND k.relation = ed.relation WHERE t.src IS NULL OR k.src IS NOT NULL""")
def edges_resynced(spark, d):
    """Edges after a batch of edits: a third of the role grants narrowed, a fifth of the parts' actions taken out, odd roles
    trusting one user in place of all, and every fifth of those nobody."""
    n, e = _graph(spark, d)
    k = F.substring_index("policy_id", ":", -1).try_cast("long")
    before = step(_role_statements(spark, d))
    less = F.filter("action", lambda a: F.trim(a) == "*")
    cut = (k % 5 == 0) & F.startswith("sid", F.lit("s"))
    after = before.withColumn("resource", F.when((k % 3 == 0) & F.startswith("sid", F.lit("t")), F.array(F.lit("role:*1"))).otherwise(F.col("resource")))
    after = after.where(~cut | (F.size(less) > 0)).withColumn("action", F.when(cut, less).otherwise(F.col("action")))
    own = F.concat(F.lit("user:"), (3 * F.col("s_suppkey")).cast("string"))
    trust = _trust(spark, d, F.lit("*")), _trust(spark, d, F.when(F.col("s_suppkey") % 2 == 0, "*").otherwise(own)).where((k % 2 == 0) | (k % 5 != 0))
    part = table(spark, d, "part").select(F.concat(F.lit("policy:"), F.col("p_partkey").cast("string")).alias("part"), F.concat(F.lit("resource:"), "p_brand").alias("dst"), F.concat(F.lit("app:"), F.lower(F.split_part("p_type", F.lit(" "), F.lit(1)))).alias("act"))
    held = e.where("relation = 'AttachedWith' and src like 'role:%'").select("src", F.col("dst").alias("part")).join(part, "part").groupBy("src", "dst").agg(F.array_sort(F.collect_set("act")).alias("actions"))
    acts = part.select(F.col("part").alias("src"), "dst", F.array("act", F.lit("app:view")).alias("actions")).unionByName(held).withColumn("relation", F.lit("ActsOn"))
    whole = step(e.where("relation <> 'ActsOn'").select(*TRIPLE, F.expr("cast(array() as array<string>)").alias("actions")).unionByName(acts))
    after = resync.synchronize(whole, n.withColumn("arn", F.col("id")), before, after, *trust)
    return after.select(*TRIPLE, F.array_join("actions", ",").alias("actions"))

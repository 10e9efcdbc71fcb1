"""A typed authorization graph projected from the star schema: customers are users, nations groups, suppliers roles,
parts policies and brands resources. The same projection in SQL stands beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens.functions.scalars import uniform

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
#: Accounts are nation keys.
ACCOUNTS = tuple(str(i) for i in range(25))
BRIDGE_SHARE = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(kind: str, column: str):
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    segment = F.element_at(F.array(*[F.lit(s) for s in SEGMENTS]), (F.col("s_nationkey") % 5 + 1).cast("int"))
    no = F.lit(False)
    null = F.lit(None).cast("string")
    shape = lambda df, i, kind, account, department, high, admin: df.select(i.alias("id"), F.lit(kind).alias("node_type"), account.alias("account_id"), department.alias("department"), high.alias("is_high_value"), admin.alias("is_admin"))
    part = table(spark, d, "part")
    brands = part.select("p_brand").distinct()
    least = part.agg(F.min("p_brand").alias("least"))
    out = shape(table(spark, d, "customer"), _key("user", "c_custkey"), "User", F.col("c_nationkey").cast("string"), F.col("c_mktsegment"), no, no)
    out = out.unionByName(shape(table(spark, d, "nation"), _key("group", "n_nationkey"), "Group", F.col("n_nationkey").cast("string"), null, no, no))
    out = out.unionByName(shape(table(spark, d, "supplier"), _key("role", "s_suppkey"), "Role", F.col("s_nationkey").cast("string"), segment, no, F.col("s_acctbal") > 9000))
    out = out.unionByName(shape(part, _key("policy", "p_partkey"), "Policy", null, null, no, no))
    return out.unionByName(shape(brands.crossJoin(F.broadcast(least)), _key("resource", "p_brand"), "Resource", null, F.lit("SecOps"), F.col("p_brand") == F.col("least"), no))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, relation, is_bridge, u): distinct triples, with the draw that the flag comes from."""
    line, part = table(spark, d, "lineitem"), table(spark, d, "part")
    pair = lambda df, a, b, relation: df.select(a.alias("src"), b.alias("dst"), F.lit(relation).alias("relation"))
    member = pair(table(spark, d, "customer"), _key("user", "c_custkey"), _key("group", "c_nationkey"), "MemberOf")
    group = F.concat(F.lit("group:"), (F.col("p_partkey") % 25).cast("string"))
    attached = pair(part.where("p_size >= 48"), group, _key("policy", "p_partkey"), "AttachedWith")
    attached = attached.unionByName(pair(line.where("l_quantity >= 50 and l_discount >= 0.1"), _key("role", "l_suppkey"), _key("policy", "l_partkey"), "AttachedWith"))
    assume = pair(table(spark, d, "orders").join(line.where("l_returnflag = 'R' and l_quantity >= 50"), F.col("o_orderkey") == F.col("l_orderkey")), _key("user", "o_custkey"), _key("role", "l_suppkey"), "AssumesRole")
    one = line.where("l_quantity >= 50 and l_discount >= 0.09").select("l_orderkey", F.col("l_suppkey").alias("a"), (F.col("l_linenumber") + 1).alias("l_linenumber"))
    passes = pair(one.join(line.select("l_orderkey", F.col("l_suppkey").alias("b"), "l_linenumber"), ["l_orderkey", "l_linenumber"]).where("a <> b"), _key("role", "a"), _key("role", "b"), "PassesTo")
    acts = pair(part, _key("policy", "p_partkey"), _key("resource", "p_brand"), "ActsOn")
    every = member.unionByName(attached).unionByName(assume).unionByName(passes).unionByName(acts).distinct()
    u = uniform("src", "relation", "dst")
    return every.withColumn("u", u).withColumn("is_bridge", F.col("relation").isin("AssumesRole", "PassesTo") & (F.col("u") < BRIDGE_SHARE))


GRAPH_SQL = f"""
nodes AS (
  SELECT 'user:' || c_custkey AS id, 'User' AS node_type, CAST(c_nationkey AS VARCHAR) AS account_id, c_mktsegment AS department, false AS is_high_value, false AS is_admin FROM customer
  UNION ALL SELECT 'group:' || n_nationkey, 'Group', CAST(n_nationkey AS VARCHAR), NULL, false, false FROM nation
  UNION ALL SELECT 'role:' || s_suppkey, 'Role', CAST(s_nationkey AS VARCHAR), ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'][s_nationkey % 5 + 1], false, s_acctbal > 9000 FROM supplier
  UNION ALL SELECT 'policy:' || p_partkey, 'Policy', NULL, NULL, false, false FROM part
  UNION ALL SELECT 'resource:' || p_brand, 'Resource', NULL, 'SecOps', p_brand = (SELECT min(p_brand) FROM part), false FROM (SELECT DISTINCT p_brand FROM part)
), triples AS (
  SELECT 'user:' || c_custkey AS src, 'group:' || c_nationkey AS dst, 'MemberOf' AS relation FROM customer
  UNION SELECT 'group:' || (p_partkey % 25), 'policy:' || p_partkey, 'AttachedWith' FROM part WHERE p_size >= 48
  UNION SELECT 'role:' || l_suppkey, 'policy:' || l_partkey, 'AttachedWith' FROM lineitem WHERE l_quantity >= 50 AND l_discount >= 0.1
  UNION SELECT 'user:' || o_custkey, 'role:' || l_suppkey, 'AssumesRole' FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' AND l_quantity >= 50
  UNION SELECT 'role:' || a.l_suppkey, 'role:' || b.l_suppkey, 'PassesTo' FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
        WHERE a.l_quantity >= 50 AND a.l_discount >= 0.09 AND a.l_suppkey <> b.l_suppkey
  UNION SELECT 'policy:' || p_partkey, 'resource:' || p_brand, 'ActsOn' FROM part
), drawn AS (
  SELECT *, CAST(('0x' || substr(md5(src || '|' || relation || '|' || dst), 1, 12)) AS UBIGINT) / 281474976710656.0 AS u FROM triples
), edges AS (
  SELECT *, relation IN ('AssumesRole', 'PassesTo') AND u < {BRIDGE_SHARE} AS is_bridge FROM drawn
)"""

#: Fixed values of the demonstration policy: sid, effect, action globs, not-action globs, resource globs, condition.
STATEMENTS = [
    ("allow-views", "Allow", ["app:view", "app:CL*"], [], ["user/*"], {}),
    ("allow-small", "Allow", ["app:p?rchase"], [], ["*"], {"NumericLessThan": {"k": ["60"]}}),
    ("deny-teens", "Deny", ["*"], [], ["user/1?"], {}),
    ("deny-high", "Deny", [], ["app:view", "app:error"], ["user/[5-9]*"], {"NumericGreaterThanEquals": {"k": ["80"]}}),
    ("allow-errors", "Allow", ["app:error"], [], ["user/[!1]*"], {"StringLikeIfExists": {"team": ["sec*"]}}),
    ("allow-own", "Allow", ["app:signup"], [], ["*"], {"ArnLike": {"aws:PrincipalArn": ["arn:user/*0", "arn:user/*5"]}}),
]


def statements(spark: SparkSession) -> DataFrame:
    from gatelens.operators.policy import STATEMENT

    rows = [(sid, effect, None, None, act, nact, res, [], cond) for sid, effect, act, nact, res, cond in STATEMENTS]
    return spark.createDataFrame(rows, STATEMENT)


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Events as authorization requests; the props give the context."""
    k = F.get_json_object("props", "$.k")
    context = F.when(k.isNotNull(), F.create_map(F.lit("k"), F.array(k))).otherwise(F.expr("cast(map() as map<string, array<string>>)"))
    return table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("req_id"), F.concat(F.lit("arn:user/"), F.col("user_id").cast("string")).alias("principal_arn"), F.concat(F.lit("app:"), "event_type").alias("action"),
        F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("resource_arn"), context.alias("context"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id", "value",
    )


REQUESTS_SQL = """
requests AS (
  SELECT CAST(event_id AS VARCHAR) AS req_id, 'arn:user/' || user_id AS principal_arn, 'app:' || event_type AS action, 'user/' || user_id AS resource, json_extract_string(props, '$.k') AS k, ts, event_type, user_id, value FROM events
), hits AS (
  SELECT *, action = 'app:view' OR action GLOB 'app:cl*' AND true AS v, TRY_CAST(k AS DOUBLE) AS kn FROM requests
), matched AS (
  SELECT *, list_filter([
      CASE WHEN (action = 'app:view' OR action GLOB 'app:cl*') AND resource GLOB 'user/*' THEN 'allow-views' END,
      CASE WHEN action GLOB 'app:p?rchase' AND kn < 60 THEN 'allow-small' END,
      CASE WHEN action = 'app:error' AND resource GLOB 'user/[!1]*' THEN 'allow-errors' END,
      CASE WHEN action = 'app:signup' AND (principal_arn GLOB 'arn:user/*0' OR principal_arn GLOB 'arn:user/*5') THEN 'allow-own' END
    ], lambda x: x IS NOT NULL) AS allows, list_filter([
      CASE WHEN resource GLOB 'user/1?' THEN 'deny-teens' END,
      CASE WHEN action <> 'app:view' AND action <> 'app:error' AND resource GLOB 'user/[5-9]*' AND kn >= 80 THEN 'deny-high' END
    ], lambda x: x IS NOT NULL) AS denies FROM hits
), decided AS (
  SELECT *, CASE WHEN len(denies) > 0 THEN 'ExplicitDeny' WHEN len(allows) > 0 THEN 'Allow' ELSE 'ImplicitDeny' END AS decision FROM matched
)"""

"""Queries of the policy engine and the activity log."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from gatelens.functions.conditions import single
from gatelens.functions.scalars import arn_account, arn_service_type, logit, one_hot, severity, sigmoid, uniform
from gatelens.operators import capability, policy, workload
from gatelens.plans.registry import query
from gatelens.sources import policies, star
from gatelens.sources.star import REQUESTS_SQL, table

R = f"WITH {REQUESTS_SQL}"
CUT = datetime.datetime(2024, 1, 22)


def _decided(spark, d):
    r = star.requests(spark, d)
    return r.join(policy.decide(r, star.statements(spark)), "req_id")


@query(f"{R} SELECT decision, count(*) AS n FROM decided GROUP BY decision")
def policy_decision(spark, d):
    return _decided(spark, d).groupBy("decision").agg(F.count("*").alias("n"))


@query(f"{R} SELECT event_type, decision, count(*) AS n, round(sum(value), 4) AS total FROM decided GROUP BY event_type, decision")
def policy_decision_by_type(spark, d):
    return _decided(spark, d).groupBy("event_type", "decision").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"{R} SELECT req_id, decision, array_to_string(list_sort(allows), ',') AS allows, array_to_string(list_sort(denies), ',') AS denies FROM decided")
def policy_provenance(spark, d):
    return policy.decide(star.requests(spark, d), star.statements(spark)).select("req_id", "decision", F.array_join("allows", ",").alias("allows"), F.array_join("denies", ",").alias("denies"))


@query(f"""{R} SELECT count(*) AS n, count(*) FILTER (decision <> 'Allow') AS denied, count(*) FILTER (decision <> 'Allow') = 0 AS conforming,
  md5(string_agg(req_id, ',' ORDER BY req_id) FILTER (decision <> 'Allow')) AS denied_ids FROM decided""")
def conformance(spark, d):
    return policy.conformance(_decided(spark, d)).select("n", "denied", "conforming", F.md5(F.array_join("denied_ids", ",").cast("binary")).alias("denied_ids"))


@query(f"""{R}, acts AS (SELECT DISTINCT action FROM requests)
SELECT action FROM acts WHERE (action = 'app:view' OR action GLOB 'app:cl*' OR action = 'app:error')
  OR (action = 'app:signup' AND 'arn:user/40' GLOB 'arn:user/*0')""")
def authorized_actions(spark, d):
    return policy.authorized_actions("arn:user/40", "user/40", star.requests(spark, d), star.statements(spark))


#: Operator, key, target of the demonstration of condition operators.
CONDITIONS = [
    ("StringEquals", "k", "42"), ("StringNotEquals", "k", "42"), ("StringEqualsIgnoreCase", "k", "42"), ("StringNotEqualsIgnoreCase", "k", "42"), ("StringLike", "k", "4?"), ("StringNotLike", "k", "[!4]*"),
    ("ArnLike", "k", "*7"), ("ArnEquals", "k", " 7 "), ("ArnNotEquals", "k", "7"), ("Bool", "k", "true"), ("NumericEquals", "k", "10.0"), ("NumericNotEquals", "k", "10"), ("NumericLessThan", "k", "10"),
    ("NumericLessThanEquals", "k", "10"), ("NumericGreaterThan", "k", "90"), ("NumericGreaterThanEquals", "k", "90"), ("NumericLessThan", "k", "ten"), ("Null", "k", "true"), ("Null", "x", "true"),
    ("StringEqualsIfExists", "x", "1"), ("StringNotEquals", "x", "1"), ("DateLessThan", "k", "2024-01-01"),
]
_TESTS = [
    "k = '42'", "k <> '42'", "lower(k) = '42'", "lower(k) <> '42'", "k GLOB '4?'", "NOT k GLOB '[!4]*'", "k GLOB '*7'", "trim(k) = '7'", "trim(k) <> '7'", "(lower(k) IN ('true', '1'))", "TRY_CAST(k AS DOUBLE) = 10", "TRY_CAST(k AS DOUBLE) <> 10",
    "TRY_CAST(k AS DOUBLE) < 10", "TRY_CAST(k AS DOUBLE) <= 10", "TRY_CAST(k AS DOUBLE) > 90", "TRY_CAST(k AS DOUBLE) >= 90", "false", "k IS NULL", "true", "true", "false", "false",
]


@query(f"{R} " + " UNION ALL ".join(f"SELECT {i} AS cond, count(*) FILTER ({t}) AS n_true, count(*) AS n FROM requests" for i, t in enumerate(_TESTS)))
def condition_eval(spark, d):
    r = star.requests(spark, d).select(F.try_element_at("context", F.lit("k"))[0].alias("k"))
    tests = F.array(*[F.struct(F.lit(i).alias("cond"), single(F.lit(op), F.col("k") if key == "k" else F.lit(None).cast("string"), F.array(F.lit(t))).alias("ok")) for i, (op, key, t) in enumerate(CONDITIONS)])
    return r.select(F.explode(tests).alias("t")).groupBy("t.cond").agg(F.count_if("t.ok").alias("n_true"), F.count("*").alias("n"))


PATTERNS = ["*green*", "B?ush*", "no such name", "[A-M]*1"]


@query("""WITH u AS (SELECT DISTINCT p_name AS action FROM part),
p(pattern) AS (VALUES ('*green*'), ('B?ush*'), ('no such name'), ('[A-M]*1')),
hit AS (SELECT p.pattern, u.action FROM p LEFT JOIN u ON CASE WHEN contains(p.pattern, '*') OR contains(p.pattern, '?') THEN lower(trim(u.action)) GLOB lower(trim(p.pattern)) ELSE lower(trim(u.action)) = lower(trim(p.pattern)) END)
SELECT DISTINCT coalesce(action, pattern) AS action FROM hit""")
def action_expand(spark, d):
    return policy.expand_actions(spark.createDataFrame([(p,) for p in PATTERNS], "pattern string"), table(spark, d, "part").select(F.col("p_name").alias("action")))


@query("""WITH u AS (SELECT DISTINCT p_type AS action FROM part)
SELECT action FROM u WHERE NOT (lower(trim(action)) GLOB '*steel' OR lower(trim(action)) GLOB 's?????? *' OR lower(trim(action)) GLOB '*[0-4]')""")
def not_action_expand(spark, d):
    return policy.expand_not_actions(spark.createDataFrame([("*STEEL",), ("S?????? *",), ("*[0-4]",)], "pattern string"), table(spark, d, "part").select(F.col("p_type").alias("action")))


_CASES = [
    ("iam:PassRole", "arn:aws:iam::1:role/x", []), ("iam:PassRole", "arn:aws:iam::1:user/x", []), ("iam:ListRoles", "arn:aws:iam::1:role/x", []), ("iam:ListRoles", "*", ["aws:SourceIp"]), ("s3:GetObject", "arn:aws:s3:::b/k", ["s3:ExistingObjectTag/team"]),
    ("s3:ListBucket", "arn:aws:s3:::b/k", []), ("s3:ListBucket", "arn:aws:s3:::b", ["s3:prefix"]), ("LAMBDA:invokefunction", "arn:aws:lambda:us:1:function:f", []), ("nope:Nope", "*", []), ("kms:Decrypt", "arn:aws:kms:us:1:key/k", ["kms:Other"]),
]
_WANT = ["ok", "resource_type", "wildcard_only", "ok", "ok", "resource_type", "ok", "ok", "unknown_action", "condition_key"]


@query("WITH c(i, reason) AS (VALUES " + ", ".join(f"({i}, '{r}')" for i, r in enumerate(_WANT)) + """)
SELECT reason, count(*) AS n FROM events JOIN c ON event_id % 10 = c.i GROUP BY reason""")
def capability_check(spark, d):
    cases = F.array(*[F.struct(F.lit(a).alias("action"), F.lit(r).alias("resource"), F.array(*[F.lit(k) for k in keys]).cast("array<string>").alias("condition_keys")) for a, r, keys in _CASES])
    edits = table(spark, d, "events").select(F.element_at(cases, (F.col("event_id") % 10 + 1).cast("int")).alias("e")).select("e.*")
    return capability.validate(edits, capability.snapshot(spark)).groupBy("reason").agg(F.count("*").alias("n"))


@query("""SELECT 'stmt-' || (event_id % 3) AS sid, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'resource_type,wildcard_only' ELSE 'unknown_action' END AS reasons, count(*) AS n FROM events GROUP BY 1, 2""")
def statement_check(spark, d):
    s = spark.createDataFrame([
        ("stmt-0", "Allow", None, None, ["iam:PassRole"], None, ["arn:aws:iam::1:role/a", "*"], None, None),
        ("stmt-1", "Allow", None, None, ["iam:ListRoles", "kms:Decrypt"], None, ["arn:aws:iam::1:role/a"], None, None),
        ("stmt-2", "Allow", None, None, ["x:Y"], None, ["*"], None, None),
    ], policy.STATEMENT)
    checked = capability.validate_statements(s, capability.snapshot(spark)).select("sid", F.array_join("reasons", ",").alias("reasons"))
    e = table(spark, d, "events").select(F.concat(F.lit("stmt-"), (F.col("event_id") % 3).cast("string")).alias("sid"))
    return e.join(F.broadcast(checked), "sid").groupBy("sid", "reasons").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT c_custkey, 'arn:aws:' || CASE c_custkey % 4 WHEN 0 THEN 's3:::bucket-' WHEN 1 THEN 'iam::' || lpad(CAST(c_nationkey AS VARCHAR), 12, '0') || ':role/' WHEN 2 THEN 'kms:us-east-1:' || lpad(CAST(c_nationkey AS VARCHAR), 12, '0') || ':key/' ELSE 'sns:us-east-1:12:topic/' END || c_custkey AS arn, c_acctbal, c_mktsegment FROM customer)
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 3 THEN '' ELSE split_part(arn, ':', 5) END AS account, CASE c_custkey % 4 WHEN 0 THEN 's3' WHEN 1 THEN 'iam' WHEN 2 THEN 'kms' ELSE 'other' END AS service,
  CASE c_custkey % 4 WHEN 0 THEN 'bucket' WHEN 1 THEN 'role' WHEN 2 THEN 'key' ELSE 'other' END AS kind, CASE c_mktsegment WHEN 'BUILDING' THEN '100' WHEN 'MACHINERY' THEN '010' ELSE '001' END AS code,
  round(1 / (1 + exp(-(c_acctbal / 1000) / 2)), 9) AS p, CASE WHEN c_acctbal >= 7000 THEN 'CRITICAL' WHEN c_acctbal >= 4000 THEN 'HIGH' WHEN c_acctbal >= 1500 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  round(ln(greatest(1e-7, least(1 - 1e-7, c_acctbal / 10000)) / (1 - greatest(1e-7, least(1 - 1e-7, c_acctbal / 10000)))), 6) AS logit, round(CAST(('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 12)) AS UBIGINT) / 281474976710656.0, 9) AS u
FROM c""")
def scalar_functions(spark, d):
    account = F.lpad(F.col("c_nationkey").cast("string"), 12, "0")
    k = F.col("c_custkey") % 4
    arn = F.concat(F.lit("arn:aws:"), F.when(k == 0, "s3:::bucket-").when(k == 1, F.concat(F.lit("iam::"), account, F.lit(":role/"))).when(k == 2, F.concat(F.lit("kms:us-east-1:"), account, F.lit(":key/"))).otherwise("sns:us-east-1:12:topic/"), F.col("c_custkey").cast("string"))
    c = table(spark, d, "customer").withColumn("arn", arn).withColumn("st", arn_service_type(F.col("arn")))
    share = F.col("c_acctbal") / 10000
    return c.select("c_custkey", arn_account(F.col("arn")).alias("account"), "st.service", F.col("st.type").alias("kind"), F.array_join(F.transform(one_hot(F.col("c_mktsegment"), ("Building", "Machinery", "other")), lambda x: x.cast("int").cast("string")), "").alias("code"),
                    F.round(sigmoid(F.col("c_acctbal") / 1000, 2.0), 9).alias("p"), severity(share).alias("severity"), F.round(logit(share), 6).alias("logit"), F.round(uniform(F.col("c_custkey").cast("string")), 9).alias("u"))


@query(f"""{R}, w AS (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-22' THEN 'T1' ELSE 'T2' END AS win FROM decided)
SELECT win, count(*) AS n, count(*) FILTER (decision = 'Allow') AS allowed, count(*) FILTER (decision <> 'Allow') AS denied, round(avg(CASE WHEN decision <> 'Allow' THEN 1.0 ELSE 0.0 END), 9) AS breakage, count(*) FILTER (decision <> 'Allow') = 0 AS conforming FROM w GROUP BY win""")
def replay_breakage(spark, d):
    r = workload.split_windows(star.requests(spark, d), CUT)
    return workload.replay(r, policy.decide(r, star.statements(spark))).withColumn("breakage", F.round("breakage", 9))


@query(f"""{R}, w AS (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-22' THEN 'T1' ELSE 'T2' END AS win FROM requests)
SELECT win, count(*) AS n, count(DISTINCT principal_arn) AS principals, count(DISTINCT resource) AS resources, count(DISTINCT action) AS actions FROM w GROUP BY win""")
def window_stats(spark, d):
    return workload.window_stats(workload.split_windows(star.requests(spark, d), CUT))


@query(f"""{R}, w AS (SELECT *, ts < TIMESTAMP '2024-01-02' AS t1 FROM requests), l AS (
  SELECT 'principal' AS kind, principal_arn AS value, t1 FROM w UNION ALL SELECT 'resource', resource, t1 FROM w UNION ALL SELECT 'action', action, t1 FROM w)
SELECT kind, value FROM l GROUP BY kind, value HAVING NOT bool_or(t1)""")
def drift_values(spark, d):
    return workload.drift(workload.split_windows(star.requests(spark, d), datetime.datetime(2024, 1, 2)))


@query(f"""{R}, g AS (SELECT principal_arn, action, resource, count(*) FILTER (ts < TIMESTAMP '2024-01-22') AS a, count(*) FILTER (ts >= TIMESTAMP '2024-01-22') AS b FROM requests GROUP BY ALL)
SELECT CAST(sum(b) AS BIGINT) AS n_t2, CAST(sum(CASE WHEN a = 0 THEN b ELSE 0 END) AS BIGINT) AS n_new, round(sum(CASE WHEN a = 0 THEN b ELSE 0 END) / sum(b), 9) AS rate FROM g""")
def drift_rate(spark, d):
    return workload.drift_rate(workload.split_windows(star.requests(spark, d), CUT)).withColumn("rate", F.round("rate", 9))


@query("""SELECT event_type AS policy_id, 'allow-' || event_type AS sid, 'Allow' AS effect, 'app:' || event_type AS action, 'user/' || min(user_id) || ',user/' || max(user_id) AS resource, '' AS error FROM events GROUP BY event_type
UNION ALL SELECT 'bad', 'bad#0', NULL, NULL, NULL, 'effect' UNION ALL SELECT 'junk', 'junk#-', NULL, NULL, NULL, 'not JSON'""")
def policy_documents(spark, d):
    e = table(spark, d, "events").groupBy("event_type").agg(F.min("user_id").alias("a"), F.max("user_id").alias("b"))
    doc = F.format_string('{"Version":"2012-10-17","Statement":{"Sid":"allow-%s","Effect":"Allow","Action":"app:%s","Resource":["user/%d","user/%d"]}}', "event_type", "event_type", "a", "b")
    docs = e.select(F.col("event_type").alias("policy_id"), doc.alias("doc")).unionByName(spark.createDataFrame([("bad", '{"Statement":[{"Effect":"Maybe","Action":"*"}]}'), ("junk", "{not json")], "policy_id string, doc string"))
    s = policies.parse(docs)
    keep = lambda c: F.when(F.col("error").isNull(), c)
    return s.select("policy_id", F.coalesce("sid", F.concat("policy_id", F.lit("#-"))).alias("sid"), keep(F.col("effect")).alias("effect"), keep(F.array_join("action", ",")).alias("action"), keep(F.array_join("resource", ",")).alias("resource"), F.coalesce("error", F.lit("")).alias("error"))


@query("""SELECT event_type AS policy_id, '{"Version":"2012-10-17","Statement":[{"Sid":"s-' || event_type || '","Effect":"Allow","Action":["app:' || event_type || '"],"Resource":["user/' || min(user_id) || '"]}]}' AS doc FROM events GROUP BY event_type""")
def policy_json(spark, d):
    e = table(spark, d, "events").groupBy("event_type").agg(F.min("user_id").alias("a"))
    doc = F.format_string('{"Statement":[{"Sid":"s-%s","Effect":"Allow","Action":"app:%s","Resource":"user/%d"}]}', "event_type", "event_type", "a")
    return policies.to_json(policies.parse(e.select(F.col("event_type").alias("policy_id"), doc.alias("doc"))))

"""Edges that policies grant, kept true while policies change.

An edit changes some statements; these name the policies and roles concerned, they the edges, and only those are judged
again: PassesTo, ActsOn and AssumesRole edges of every principal that a changed policy governs, directly or over a group,
ActsOn edges of the policy itself, and AssumesRole edges into roles whose trust changed. Everything is joined by policy,
so the work follows the edges of what changed, not the graph.

edges: (src, dst, relation, actions, ...), other columns are kept; nodes: (id, node_type, arn); statements and trust as
``policy`` has them, trust with the role's id as policy_id. Null or empty actions of an ActsOn edge stand for ``*``. Edges
with an end that is no node aren't judged and stay; repeated edges are judged alike. Empty tables change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.operators.policy import evaluate_known, governed_matches
from gatelens.plans.steps import step

KEY = ["src", "dst", "relation"]
#: What holding an edge of these relations takes; ActsOn edges name their actions.
IMPLIED = {"PassesTo": "iam:PassRole", "AssumesRole": "sts:AssumeRole"}
#: Attaching a policy is allowed on the policy or on the principal itself.
ATTACH = "iam:AttachUserPolicy"
_FIELDS = ("sid", "effect", "principal", "not_principal", "action", "not_action", "resource", "not_resource", "condition")


def changed_policies(before: DataFrame, after: DataFrame) -> DataFrame:
    """(policy_id): policies whose statements, repeated ones counted, aren't the same in both tables; one shuffle."""
    text = F.to_json(F.struct(*_FIELDS))
    signed = lambda s, n: s.select("policy_id", text.alias("text"), F.lit(n).alias("n"))
    both = signed(before, 1).unionByName(signed(after, -1))
    return both.groupBy("policy_id", "text").agg(F.sum("n").alias("n")).where("n <> 0").select("policy_id").distinct()


def edge_requests(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, relation, act, action, principal_arn, resource_arn, context, id, role, own): what each edge must be allowed.

    act: the edge's action as it stands there; own: the edge leaves a policy, whose statements alone count. An attachment
    gives two rows of one act, of which one must be allowed.
    """
    listed = F.when(F.size("actions") > 0, F.col("actions")).otherwise(F.array(F.lit("*")))
    act = F.when(F.col("relation") == "ActsOn", listed)
    for relation, action in IMPLIED.items():
        act = act.when(F.col("relation") == relation, F.array(F.lit(action)))
    end = lambda name: nodes.select(F.col("id").alias(name), F.col("arn").alias(f"{name}_arn"), F.col("node_type").alias(f"{name}_type"))
    wanted = edges.select(*KEY, "actions").where(F.col("relation").isin("ActsOn", *IMPLIED)).distinct()
    each = wanted.select(*KEY, F.explode(F.array_distinct(act)).alias("act")).join(end("src"), "src").join(end("dst"), "dst")
    own = F.coalesce(F.col("src_type") == "Policy", F.lit(False))
    places = F.when(~own & (F.col("act") == ATTACH) & (F.col("dst_type") == "Policy"), F.array("dst_arn", "src_arn")).otherwise(F.array("dst_arn"))
    return each.select(
        *KEY, "act", F.col("act").alias("action"), F.when(own, "*").otherwise(F.col("src_arn")).alias("principal_arn"), F.explode(F.array_distinct(places)).alias("resource_arn"),
        F.expr("cast(map() as map<string, array<string>>)").alias("context"), F.col("src").alias("id"), F.col("dst").alias("role"), own.alias("own"),
    )


def allowed_acts(asked: DataFrame, edges: DataFrame, statements: DataFrame, trust: DataFrame, guarded: DataFrame) -> DataFrame:
    """(src, dst, relation, act): those of ``edge_requests`` that the graph, or the policy that the edge leaves, allows."""
    named = asked.withColumn("req_id", F.to_json(F.struct(*KEY, "act", "resource_arn")))
    on_graph = evaluate_known(named.where("not own").drop(*KEY, "act", "own"), edges, statements, trust, guarded).where("decision = 'Allow'").select("req_id")
    alone = named.where("own").withColumn("policy_id", F.col("src"))
    verdict = governed_matches(alone, statements).groupBy("r.req_id").agg(F.bool_and(F.col("s.effect") == "Allow").alias("ok")).where("ok").select("req_id")
    return named.join(on_graph.unionByName(verdict), "req_id", "left_semi").select(*KEY, "act").distinct()


def touched(edges: DataFrame, policies: DataFrame, roles: DataFrame) -> DataFrame:
    """(src, dst, relation): the edges that a change of a policy, or of a role's trust, may take."""
    kind = lambda *names: edges.where(F.col("relation").isin(*names)).select(*KEY).distinct()
    # who holds a changed policy, then whose groups do: no pairs of a principal and a policy
    owner = edges.where("relation = 'AttachedWith'").select(F.col("src"), F.col("dst").alias("policy_id")).join(policies.select("policy_id"), "policy_id", "left_semi").select("src").distinct()
    member = edges.where("relation = 'MemberOf'").select("src", "dst").join(owner.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src")
    held = kind("ActsOn", *IMPLIED).join(owner.unionByName(member), "src", "left_semi")
    own = kind("ActsOn").withColumn("policy_id", F.col("src")).join(policies.select("policy_id"), "policy_id", "left_semi")
    into = kind("AssumesRole").withColumn("policy_id", F.col("dst")).join(roles.select("policy_id"), "policy_id", "left_semi")
    return held.select(*KEY).unionByName(own.select(*KEY)).unionByName(into.select(*KEY)).distinct()


def synchronize(edges: DataFrame, nodes: DataFrame, before: DataFrame, after: DataFrame, trust_before: DataFrame, trust_after: DataFrame, guarded: DataFrame | None = None) -> DataFrame:
    """The edges after an edit: of those that it touches the ones still allowed, ActsOn edges with the actions still allowed.

    guarded: (id) of the roles that have a trust policy. None: those with trust statements before or after, so that a
    role whose last trust statement goes admits nobody instead of anybody.
    """
    roles = trust_before.select(F.col("policy_id").alias("id")).unionByName(trust_after.select(F.col("policy_id").alias("id"))).distinct() if guarded is None else guarded
    at_stake = touched(edges, step(changed_policies(before, after)), step(changed_policies(trust_before, trust_after)))
    asked = step(edge_requests(edges.join(at_stake, KEY, "left_semi"), nodes))
    kept = allowed_acts(asked, edges, after, trust_after, roles).groupBy(*KEY).agg(F.collect_set("act").alias("_kept"))
    judged = asked.select(*KEY).distinct().join(kept, KEY, "left").withColumn("_judged", F.lit(True))
    left = edges.join(judged, KEY, "left").where("_judged is null or _kept is not null")
    less = F.filter("actions", lambda a: F.array_contains("_kept", a))
    return left.withColumn("actions", F.when((F.col("relation") == "ActsOn") & F.col("_judged") & (F.size("actions") > 0), less).otherwise(F.col("actions"))).select(*edges.columns)

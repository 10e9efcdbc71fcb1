"""Synthetic environments: topologies by hash draws, and escalation motifs from templates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens.functions.scalars import uniform
from gatelens.operators.reach import has_path

DEPARTMENTS = ("Engineering", "DevOps", "DataBI", "Finance", "SecOps")
#: Shares of users, roles, policies, groups and resources.
QUOTAS = (("User", 0.35), ("Role", 0.2), ("Policy", 0.2), ("Group", 0.05), ("Resource", 0.2))


def topology(spark: SparkSession, size: int, seed: str = "0", account: str = "123456789012") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of an enterprise of ``size`` nodes: everyone is in their department's group, groups and roles have
    policies, policies act on resources, users take on roles mostly of their department. Nothing depends on row order."""
    draw = lambda *k: uniform(F.lit(seed), *k)
    edges_at, kind, first = 0.0, F.lit(QUOTAS[-1][0]), F.lit(0)
    bounds = []
    for name, share in QUOTAS:
        bounds.append((name, round(edges_at * size), round((edges_at + share) * size)))
        edges_at += share
    for name, lo, hi in reversed(bounds):
        kind, first = F.when(F.col("i") < hi, name).otherwise(kind), F.when(F.col("i") < hi, lo).otherwise(first)
    n = spark.range(size).withColumnRenamed("id", "i").withColumn("node_type", kind).withColumn("k", F.col("i") - first)
    # node ids are their type and number, so edges can be drawn without a join
    place = lambda u: F.element_at(F.array(*[F.lit(x) for x in DEPARTMENTS]), (F.floor(u * len(DEPARTMENTS)) + 1).cast("int"))
    department = place(draw(F.lit("dept"), F.col("node_type"), F.col("k").cast("string")))
    ident = F.concat(F.lower("node_type"), F.lit(":"), F.col("k").cast("string"))
    special = draw(F.lit("flag"), ident)
    nodes = n.select(ident.alias("id"), "node_type", F.concat(F.lit(f"arn:aws:iam::{account}:"), F.lower("node_type"), F.lit("/"), F.col("k").cast("string")).alias("arn"), ident.alias("name"), F.lit(account).alias("account_id"), department.alias("department"),
                     ((F.col("node_type") == "Resource") & (special < 0.1)).alias("is_high_value"), ((F.col("node_type") == "Role") & (special < 0.05)).alias("is_admin"))
    count = {name: max(1, hi - lo) for name, lo, hi in bounds}
    some = lambda kind, *k: F.concat(F.lit(f"{kind.lower()}:"), F.floor(draw(*k) * count[kind]).cast("string"))

    def drawn(source: str, target: str, relation: str, each: int):
        s = nodes.where(F.col("node_type") == source).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(each))).alias("t"))
        return s.select("src", some(target, F.lit(relation), F.col("src"), F.col("t").cast("string")).alias("dst"), F.lit(relation).alias("relation"))

    e = drawn("User", "Group", "MemberOf", 1)
    for spec in (("User", "Role", "AssumesRole", 1), ("Role", "Policy", "AttachedWith", 2), ("Group", "Policy", "AttachedWith", 2), ("Policy", "Resource", "ActsOn", 2)):
        e = e.unionByName(drawn(*spec))
    admin = nodes.where("is_admin").select(F.col("id").alias("dst"))
    # what leads to an admin comes from motifs alone
    return nodes, e.distinct().join(admin, "dst", "left_anti").select("src", "dst", "relation", F.lit(False).alias("is_bridge"))


#: Motif, tier, chain of (type, relation to the next), place of the bridge in the chain, its actions.
#: The last node of a chain is the target.
MOTIFS: dict[str, tuple[str, list[str], list[str], int, list[str]]] = {
    "passrole_lambda": ("P0", ["User", "Role", "Resource"], ["PassesTo", "ActsOn"], 0, ["iam:PassRole", "lambda:CreateFunction", "lambda:InvokeFunction"]),
    "create_access_key": ("P0", ["User", "User", "Resource"], ["ActsOn", "ActsOn"], 0, ["iam:CreateAccessKey"]),
    "attach_policy": ("P0", ["User", "Policy", "Resource"], ["ActsOn", "ActsOn"], 0, ["iam:AttachUserPolicy"]),
    "assume_role_chain": ("P0", ["User", "Role", "Role", "Resource"], ["AssumesRole", "AssumesRole", "ActsOn"], 1, ["sts:AssumeRole"]),
    "passrole_ec2": ("P1", ["User", "Role", "Resource"], ["PassesTo", "ActsOn"], 0, ["iam:PassRole", "ec2:RunInstances"]),
    "set_default_policy_version": ("P1", ["User", "Policy", "Resource"], ["ActsOn", "ActsOn"], 0, ["iam:SetDefaultPolicyVersion"]),
    "passrole_glue": ("P1", ["User", "Role", "Resource"], ["PassesTo", "ActsOn"], 0, ["iam:PassRole", "glue:CreateDevEndpoint"]),
    "passrole_codebuild": ("P1", ["User", "Role", "Resource"], ["PassesTo", "ActsOn"], 0, ["iam:PassRole", "codebuild:CreateProject", "codebuild:StartBuild"]),
    "passrole_sagemaker": ("P1", ["User", "Role", "Resource"], ["PassesTo", "ActsOn"], 0, ["iam:PassRole", "sagemaker:CreateNotebookInstance"]),
    "update_assume_role_policy": ("P1", ["User", "Role", "Resource"], ["AssumesRole", "ActsOn"], 0, ["iam:UpdateAssumeRolePolicy"]),
    "create_policy_version": ("P1", ["User", "Policy", "Resource"], ["AttachedWith", "ActsOn"], 1, ["iam:CreatePolicyVersion"]),
}
CUSTOM: dict[str, Callable] = {}


def register_motif(name: str, inject: Callable) -> None:
    """Add a motif: (spark, instances) -> (nodes, edges)."""
    CUSTOM[name] = inject


def inject(spark: SparkSession, name: str, instances: int, account: str = "123456789012") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of so many instances of a motif, ids ending in the instance's number."""
    if name in CUSTOM:
        return CUSTOM[name](spark, instances)
    tier, kinds, relations, bridge, actions = MOTIFS[name]
    n = spark.range(instances).withColumn("motif_id", F.concat(F.lit(f"{name}-"), F.col("id").cast("string"))).drop("id")
    ident = lambda j: F.concat(F.lit(f"{kinds[j].lower()}:"), "motif_id", F.lit(f"-{j}"))
    rows = F.array(*[F.struct(ident(j).alias("id"), F.lit(k).alias("node_type"), F.lit("SecOps" if j else "DevOps").alias("department"), F.lit(j == len(kinds) - 1).alias("is_high_value"), F.lit(k == "Role" and j == len(kinds) - 2).alias("is_admin")) for j, k in enumerate(kinds)])
    links = F.array(*[F.struct(ident(j).alias("src"), ident(j + 1).alias("dst"), F.lit(r).alias("relation"), F.lit(j == bridge).alias("is_bridge"), (F.array(*[F.lit(a) for a in actions]) if j == bridge else F.expr("cast(array() as array<string>)")).alias("actions")) for j, r in enumerate(relations)])
    nodes = n.select("motif_id", F.explode(rows).alias("n")).select("n.*", F.lit(account).alias("account_id"), "motif_id", F.lit(tier).alias("tier"))
    return nodes, n.select("motif_id", F.explode(links).alias("e")).select("e.*", "motif_id")


def motif_truth(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(motif_id, connected, severed): the chain leads from its source to its target, and doesn't without the bridge."""
    ends = nodes.groupBy("motif_id").agg(F.max(F.when(F.col("id").endswith("-0"), F.col("id"))).alias("source"), F.max(F.when(F.col("is_high_value"), F.col("id"))).alias("target"))
    got = lambda e, name: has_path(e.select("src", "dst"), ends.select("source", "target")).withColumn(name, F.lit(True))
    j = ends.join(got(edges, "c"), ["source", "target"], "left").join(got(edges.where("not is_bridge"), "s"), ["source", "target"], "left")
    return j.select("motif_id", F.coalesce("c", F.lit(False)).alias("connected"), F.col("s").isNull().alias("severed"))


def diamond(spark: SparkSession, instances: int) -> tuple[DataFrame, DataFrame]:
    """Two parallel bridges to one target: each alone keeps a path, both gone break it."""
    n = spark.range(instances).select(F.concat(F.lit("diamond-"), F.col("id").cast("string")).alias("motif_id"))
    ident = lambda j: F.concat("motif_id", F.lit(f"-{j}"))
    legs = [("0", "1", True), ("0", "2", True), ("1", "3", False), ("2", "3", False)]
    e = n.select("motif_id", F.explode(F.array(*[F.struct(ident(a).alias("src"), ident(b).alias("dst"), F.lit("AssumesRole").alias("relation"), F.lit(br).alias("is_bridge")) for a, b, br in legs])).alias("e")).select("e.*", "motif_id")
    nodes = n.select("motif_id", F.explode(F.array(*[F.struct(ident(str(j)).alias("id"), F.lit(j == 3).alias("is_high_value")) for j in range(4)])).alias("n")).select("n.*", "motif_id")
    return nodes, e


def branching_truth(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(motif_id, one_left, all_gone): with any one bridge gone there is a path; with all gone there is none.

    Graphs with different bridges taken out are worlds of one search.
    """
    ends = nodes.groupBy("motif_id").agg(F.max(F.when(F.col("id").endswith("-0"), F.col("id"))).alias("source"), F.max(F.when(F.col("is_high_value"), F.col("id"))).alias("target"))
    bridges = edges.where("is_bridge").select("motif_id", F.concat_ws("|", "src", "dst").alias("cut"))
    sets = bridges.unionByName(edges.select("motif_id", F.lit("all").alias("cut")).distinct())
    kept = edges.join(sets, "motif_id").where("not is_bridge or (cut <> 'all' and cut <> concat_ws('|', src, dst))").select("cut", "src", "dst")
    got = has_path(kept, ends.select("source", "target"), ["cut"]).withColumn("hit", F.lit(1))
    each = sets.join(ends, "motif_id").join(got, ["cut", "source", "target"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    return each.groupBy("motif_id").agg(F.min(F.when(F.col("cut") != "all", F.col("hit"))).alias("one_left"), (1 - F.max(F.when(F.col("cut") == "all", F.col("hit")))).alias("all_gone"))


#: Organisations of the corpus and their split, by size.
ORGANISATIONS = [(f"org-{i:02d}", "train" if i <= 8 else "val" if i <= 10 else "test", 350 + 225 * (i - 1)) for i in range(1, 15)]


def corpus(spark: SparkSession, organisations: list[tuple[str, str, int]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all organisations, with split and org_id."""
    out_n = out_e = None
    for org, split, size in organisations or ORGANISATIONS:
        n, e = (x.withColumn("org_id", F.lit(org)).withColumn("split", F.lit(split)) for x in topology(spark, size, org))
        out_n, out_e = (n, e) if out_n is None else (out_n.unionByName(n), out_e.unionByName(e))
    return out_n, out_e

"""Features and heuristic scores of candidate pairs (u, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.operators.graph import degrees
from gatelens.operators.reach import reach


def neighbourhoods(edges: DataFrame) -> DataFrame:
    """(id, near): neighbours whichever way edges point."""
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("n")).unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("n")))
    return both.groupBy("id").agg(F.collect_set("n").alias("near"))


def common_neighbours(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(u, v, cn, adamic_adar, resource_allocation) of pairs with common neighbours: two joins on edges, no sets moved."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("z")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("z"))).distinct()
    degree = both.groupBy(F.col("a").alias("z")).agg(F.count("*").alias("k"))
    one = pairs.select("u", "v").distinct().join(both.withColumnRenamed("a", "u"), "u").join(both.withColumnRenamed("a", "v"), ["v", "z"]).join(degree, "z")
    return one.groupBy("u", "v").agg(F.count("*").alias("cn"), F.sum(F.when(F.col("k") > 1, 1 / F.log("k")).otherwise(0.0)).alias("adamic_adar"), F.sum(1 / (F.col("k") + 1e-9)).alias("resource_allocation"))


def features(pairs: DataFrame, edges: DataFrame, nodes: DataFrame, actions: DataFrame | None = None, cutoff: int = 6) -> DataFrame:
    """24 features of each (u, v). actions: (id, acts) sets of actions, if known."""
    simple = edges.select("src", "dst").distinct()
    both = simple.select(F.col("src").alias("id"), F.col("dst").alias("n")).unionByName(simple.select(F.col("dst").alias("id"), F.col("src").alias("n"))).distinct()
    k = both.groupBy("id").agg(F.count("*").alias("k"))
    d = degrees(nodes, simple).select("id", "out_degree", "in_degree")
    a = actions if actions is not None else nodes.select("id", F.expr("cast(array() as array<string>)").alias("acts"))
    info = nodes.select("id", "node_type", "department", "account_id", "is_admin", "is_high_value").join(d, "id").join(k, "id", "left").join(a, "id", "left")
    side = lambda x: info.select(F.col("id").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in info.columns if c != "id"])
    fwd = reach(edges, pairs.select(F.col("u").alias("id")), pairs.select(F.col("v").alias("id")), cutoff).select(F.col("source").alias("u"), F.col("target").alias("v"), F.col("hops").alias("fwd"))
    rev = reach(edges, pairs.select(F.col("v").alias("id")), pairs.select(F.col("u").alias("id")), cutoff).select(F.col("source").alias("v"), F.col("target").alias("u"), F.col("hops").alias("rev"))
    f = pairs.join(side("u"), "u").join(side("v"), "v").join(common_neighbours(pairs, simple), ["u", "v"], "left").join(fwd, ["u", "v"], "left").join(rev, ["u", "v"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    far = lambda c: F.coalesce(F.col(c), F.lit(cutoff + 1)).cast("double")
    acts = lambda x: F.coalesce(F.col(f"{x}_acts"), F.expr("cast(array() as array<string>)"))
    has = lambda word: F.exists(acts("u"), lambda y: F.contains(F.lower(y), F.lit(word)))
    named = lambda word: F.contains(F.lower("u"), F.lit(word))
    return f.select(
        "u", "v", zero("cn").alias("common_neighbours"), (zero("cn") / (zero("u_k") + zero("v_k") - zero("cn") + 1e-9)).alias("jaccard"), zero("adamic_adar").alias("adamic_adar"),
        (zero("u_k") * zero("v_k")).alias("preferential_attachment"), zero("resource_allocation").alias("resource_allocation"), far("fwd").alias("forward_path"), flag(F.col("fwd").isNotNull()).alias("forward_reach"),
        far("rev").alias("reverse_path"), flag(F.col("rev").isNotNull()).alias("reverse_reach"), zero("u_out_degree").alias("out_degree_u"), zero("u_in_degree").alias("in_degree_u"), zero("v_out_degree").alias("out_degree_v"),
        zero("v_in_degree").alias("in_degree_v"), flag(F.col("u_department") == F.col("v_department")).alias("same_department"), flag(F.col("u_department") != F.col("v_department")).alias("other_department"),
        flag(F.col("u_is_admin")).alias("u_admin"), flag(F.col("v_is_high_value") | F.col("v_is_admin")).alias("v_high"), flag(F.col("u_account_id") != F.col("v_account_id")).alias("cross_account"),
        flag(F.col("u_node_type").isin("User", "Role")).alias("u_identity"), flag(F.col("v_node_type").isin("Role", "Resource")).alias("v_role_or_resource"), flag(has("passrole") | named("passrole")).alias("passrole"),
        flag(has("assumerole") | named("assume")).alias("assumerole"), flag(has("*") | has("admin") | F.col("u_is_admin")).alias("admin_actions"), F.size(F.array_intersect(acts("u"), acts("v"))).cast("double").alias("shared_actions"),
    )


def node_actions(edges: DataFrame, policy_actions: DataFrame) -> DataFrame:
    """(id, acts): a policy's own actions, passed on to what it is attached to and then to members of groups."""
    own = policy_actions.select("id", F.explode("acts").alias("a"))
    up = lambda rel, got: edges.where(F.col("relation") == rel).join(got.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), "a")
    attached = own.unionByName(up("AttachedWith", own)).distinct()
    return attached.unionByName(up("MemberOf", attached)).groupBy("id").agg(F.array_sort(F.collect_set("a")).alias("acts"))


PRIOR = 0.05
MINTING = ("iam:createaccesskey", "iam:createloginprofile", "iam:updateaccesskey")


def motif_scores(pairs: DataFrame, edges: DataFrame, nodes: DataFrame, actions: DataFrame) -> DataFrame:
    """(u, v, score, rules): the best of the completion rules that fit, and their names in order."""
    info = nodes.select("id", "node_type", "department", "is_admin", "is_high_value").join(actions, "id", "left")
    side = lambda x: info.select(F.col("id").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in info.columns if c != "id"])
    simple = edges.select("src", "dst").distinct()
    near = neighbourhoods(simple).select("id", F.size("near").alias("k"))
    f = pairs.join(side("u"), "u").join(side("v"), "v").join(common_neighbours(pairs, simple), ["u", "v"], "left").join(near.select(F.col("id").alias("u"), F.col("k").alias("ku")), "u", "left").join(near.select(F.col("id").alias("v"), F.col("k").alias("kv")), "v", "left")
    acts = F.coalesce("u_acts", F.expr("cast(array() as array<string>)"))
    has = lambda *ws: F.exists(acts, lambda y: _any([F.contains(F.lower(y), F.lit(w)) for w in ws]))
    named = lambda x, w: F.contains(F.lower(x), F.lit(w))
    same = F.coalesce(F.col("u_department") == F.col("v_department"), F.lit(False))
    high, kind = F.col("v_is_admin") | F.col("v_is_high_value"), F.col("v_node_type")
    admin = F.col("v_is_admin") | named("v", "admin")
    rule = lambda when, yes, a, b, bonus: F.when(when, F.when(yes, a).otherwise(b) + F.when(same, bonus).otherwise(0.0))
    cn = F.coalesce("cn", F.lit(0))
    found = {
        "PassRole": rule((has("passrole") | named("u", "passrole")) & (kind == "Role"), high, 0.85, 0.65, 0.10),
        "Minting": rule((F.exists(acts, lambda y: F.lower(y).isin(*MINTING)) | named("u", "key")) & (kind == "User"), admin, 0.85, 0.60, 0.10),
        "Attachment": rule((has("attach", "put") | named("u", "policy")) & kind.isin("Policy", "Role"), admin, 0.75, 0.55, 0.0),
        "Assumption": rule((has("assumerole") | named("u", "assume")) & (kind == "Role"), high, 0.70, 0.50, 0.15),
        "Overlap": F.when(cn > 0, 0.30 + F.least(F.lit(0.40), cn / (F.col("ku") + F.col("kv") - cn + 1e-9))),
    }
    best = F.least(F.lit(1.0), F.greatest(F.lit(PRIOR), *[F.coalesce(c, F.lit(0.0)) for c in found.values()]))
    return f.select("u", "v", best.alias("score"), F.array_join(F.array_compact(F.array(*[F.when(c.isNotNull(), n) for n, c in found.items()])), ",").alias("rules"))


def _any(columns: list):
    out = columns[0]
    for c in columns[1:]:
        out = out | c
    return out

"""Hiding edges by structured conditions, and sampling negatives. Draws depend on edge keys, not on row order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatelens.functions.scalars import uniform
from gatelens.operators.graph import with_ends
from gatelens.plans.steps import step

TRIPLE = ["src", "relation", "dst"]


def _draw(name: str, seed: str):
    return uniform(F.lit(name), F.lit(seed), *TRIPLE)


def mask_random(edges: DataFrame, nodes: DataFrame, ratio: float = 0.2, seed: str = "0", protect_members: bool = True):
    """A: a share of edges; memberships stay."""
    free = F.col("relation") != "MemberOf" if protect_members else F.lit(True)
    return free & (_draw("A", seed) < ratio)


def mask_accounts(edges: DataFrame, nodes: DataFrame, seed: str = "0", target_account: str | None = None, primary: str | None = None):
    """B: edges between accounts, or that touch one account, or outside the primary one."""
    a, b = F.col("src_account_id"), F.col("dst_account_id")
    apart = F.coalesce(a != b, F.lit(False))
    if target_account is not None:
        return F.coalesce(a == target_account, F.lit(False)) | F.coalesce(b == target_account, F.lit(False))
    return apart | (F.coalesce(a != primary, F.lit(False)) & (F.col("relation") == "AssumesRole")) if primary else apart & F.col("relation").isin("AssumesRole", "PassesTo")


def mask_federation(edges: DataFrame, nodes: DataFrame, seed: str = "0", ratio: float = 0.5):
    """C: half of users' roles and memberships."""
    user = F.col("src_node_type") == "User"
    return user & (((F.col("relation") == "AssumesRole") & (F.col("dst_node_type") == "Role")) | ((F.col("relation") == "MemberOf") & (F.col("dst_node_type") == "Group"))) & (_draw("C", seed) < ratio)


def mask_sessions(edges: DataFrame, nodes: DataFrame, seed: str = "0"):
    """D: all roles taken on or passed between roles."""
    return F.col("relation").isin("AssumesRole", "PassesTo") & (F.col("src_node_type") == "Role") & (F.col("dst_node_type") == "Role")


def mask_bridges(edges: DataFrame, nodes: DataFrame, seed: str = "0"):
    """E: all bridges."""
    return F.col("is_bridge")


OPERATORS: dict[str, Callable] = {"A": mask_random, "B": mask_accounts, "C": mask_federation, "D": mask_sessions, "E": mask_bridges}


def register(letter: str, operator: Callable) -> None:
    """Add a condition: (edges, nodes, **options) -> boolean column of what is hidden, over edges with their ends."""
    OPERATORS[letter] = operator


def mask(edges: DataFrame, nodes: DataFrame, condition: str, **options) -> tuple[DataFrame, DataFrame]:
    """(observed, hidden) edges."""
    full = with_ends(edges, nodes, "node_type", "account_id").withColumn("_hidden", OPERATORS[condition](edges, nodes, **options))
    return full.where("not _hidden").select(*edges.columns), full.where("_hidden").select(*edges.columns)


def mask_bridge_share(edges: DataFrame, nodes: DataFrame, ratio: float, seed: str = "0") -> tuple[DataFrame, DataFrame]:
    """(observed, hidden): round(n * ratio) of the bridges of each typed triple, those with the smallest draws."""
    full = with_ends(edges, nodes, "node_type")
    by = ["src_node_type", "relation", "dst_node_type", "is_bridge"]
    r = F.row_number().over(Window.partitionBy(*by).orderBy(_draw("E", seed), *TRIPLE))
    gone = F.col("is_bridge") & (F.col("_r") <= F.rint(F.col("_n") * ratio))
    full = full.withColumn("_r", r).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    return full.where(~gone).select(*edges.columns), full.where(gone).select(*edges.columns)


#: Shares of negatives: same department, from the unprivileged to high-value or admin nodes, other departments.
STRATA = (("same", 0.5), ("up", 0.2), ("cross", 0.3))
#: Targets up to this many rows are broadcast to the draws, which is checked; more are joined by their number.
BROADCAST_TARGETS = 500_000
#: Draws that a task makes, about.
DRAWS = 2_000_000


def negatives(edges: DataFrame, nodes: DataFrame, relation: str, src_type: str, dst_type: str, ratio: float = 1.0, seed: str = "0", tries: int = 64) -> DataFrame:
    """(src, dst, stratum) that are no positives, about ``ratio`` for each positive, by strata.

    Each source draws ``tries`` targets of the type by hash, so no grid of all pairs is built; what a stratum lacks
    goes to the others, nearest draws first. Only the nearest draws of a stratum can be taken, as many as are wanted in all:
    draws beyond a bound that should leave that many are dropped where they are made, and if it leaves too few, it grows.
    """
    from gatelens.operators.graph import dense_ids
    from gatelens.operators.vocabulary import numbered

    pos = step(edges.where(F.col("relation") == relation).select("src", "dst").distinct())
    typed = dense_ids(nodes.where(F.col("node_type").isin(src_type, dst_type)))
    to = step(typed.where(F.col("node_type") == dst_type).select(F.col("id").alias("dst"), "idx", F.col("department").alias("d2"), (F.col("is_high_value") | F.col("is_admin")).alias("high")))
    m, n_pos = to.count(), pos.count()
    k = round(n_pos * ratio)
    start = typed.where(F.col("node_type") == src_type).select(F.col("id").alias("src"), F.col("department").alias("d1"), F.col("is_admin").alias("adm"))
    # dealt out, so that draws are made by all tasks
    start = step(start.repartition(max(edges.sparkSession.sparkContext.defaultParallelism, start.count() * tries // DRAWS)))
    u = lambda *k: uniform(F.lit("neg"), F.lit(seed), *k)
    stratum = F.when(~F.col("adm") & F.col("high"), "up").when(F.col("d1") == F.col("d2"), "same").otherwise("cross")
    # pairs to expect of each stratum: a source's different targets, by the shares of the kinds of sources and of targets
    kinds = start.groupBy("d1", "adm").agg(F.count("*").alias("n")).crossJoin(to.groupBy("d2", "high").agg(F.count("*").alias("share")))
    each = m * (1 - (1 - 1 / m) ** tries) if m else 0.0
    expected = {r["stratum"]: r["n"] for r in kinds.groupBy(stratum.alias("stratum")).agg((F.sum(F.col("n") * F.col("share")) / max(m, 1) * each).alias("n")).collect()}
    near = F.broadcast(to) if m <= BROADCAST_TARGETS else to
    slack = 1.5
    while True:
        # positives may be among the nearest draws
        bound = {s: min(1.0, slack * (k + n_pos + 100) / n) for s, n in expected.items() if n > 0}
        within = F.lit(0.0)
        for s, b in bound.items():
            within = F.when(F.col("stratum") == s, b).otherwise(within)
        drawn = start.select("*", F.explode(F.sequence(F.lit(1), F.lit(tries))).alias("t")).withColumn("idx", F.floor(u("src", F.col("t").cast("string")) * m).cast("int"))
        made = drawn.join(near, "idx").where("src <> dst").select("src", "dst", stratum.alias("stratum"), u("src", "dst").alias("u")).where(F.col("u") < within)
        pairs = step(made.dropDuplicates(["src", "dst"]).join(pos, ["src", "dst"], "left_anti"))
        held = {r["stratum"]: r["count"] for r in pairs.groupBy("stratum").count().collect()}
        if all(b >= 1.0 or held.get(s, 0) >= k for s, b in bound.items()):
            break
        slack *= 4
    # numbered in ranges: of three strata, or of all rows, a window would be a task
    order = ["u", "src", "dst"]
    ranged = step(numbered(pairs, "stratum", *order))
    least = ranged.groupBy("stratum").agg(F.min("idx").alias("least"))
    ranked = ranged.join(F.broadcast(least), "stratum").withColumn("r", F.col("idx") - F.col("least") + 1).drop("idx", "least")
    quota = F.lit(k) * F.when(F.col("stratum") == "same", STRATA[0][1]).when(F.col("stratum") == "up", STRATA[1][1]).otherwise(STRATA[2][1])
    later = ranked.withColumn("later", F.when(F.col("r") <= F.rint(quota), 0).otherwise(1))
    return numbered(later, "later", *order).where(F.col("idx") < k).select("src", "dst", "stratum")


def uniform_negatives(edges: DataFrame, nodes: DataFrame, relation: str, dst_type: str, each: int = 1, seed: str = "0") -> DataFrame:
    """(src, dst, draw): for each edge of a relation ``each`` targets of a type, drawn with equal chances; a draw may be a positive."""
    from gatelens.operators.graph import dense_ids

    to = dense_ids(nodes.where(F.col("node_type") == dst_type)).select(F.col("id").alias("drawn"), "idx")
    m = to.agg(F.count("*").alias("m"))
    pos = edges.where(F.col("relation") == relation).select("src", "dst").distinct().crossJoin(F.broadcast(m))
    u = uniform(F.lit("uniform"), F.lit(seed), "src", "dst", F.col("draw").cast("string"))
    drawn = pos.select("*", F.explode(F.sequence(F.lit(1), F.lit(each))).alias("draw")).withColumn("idx", F.floor(u * F.col("m")).cast("int"))
    return drawn.join(to, "idx").select("src", F.col("drawn").alias("dst"), "draw")

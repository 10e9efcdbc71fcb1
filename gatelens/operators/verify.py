"""Checking repairs: three levels of risk, side effects, replay, and the trade-off between methods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.operators.reach import has_path, reach
from gatelens.operators.uncertain import attack_risk

KEY = ["src", "dst"]


def three_levels(observed: DataFrame, repaired: DataFrame, truth: DataFrame, worlds: DataFrame, pairs: DataFrame, samples: int, delta: float = 0.0) -> DataFrame:
    """(source, target, l1, l2, l3, status): a path in the repaired graph, the share of worlds with one on top of it, and
    one in the true graph after the same cuts. Safe at level 1 but not at 2 or 3 is MISLEADING_SAFE."""
    cuts = observed.select(*KEY).distinct().join(repaired.select(*KEY), KEY, "left_anti")
    patched = truth.select(*KEY).join(cuts, KEY, "left_anti")
    flag = lambda e, name: has_path(e.select(*KEY), pairs.select("source", "target")).withColumn(name, F.lit(1.0))
    l2 = attack_risk(repaired, worlds.join(cuts, KEY, "left_anti"), pairs.select("source", "target"), samples).withColumnRenamed("risk", "l2")
    j = pairs.select("source", "target").join(flag(repaired, "l1"), ["source", "target"], "left").join(l2, ["source", "target"]).join(flag(patched, "l3"), ["source", "target"], "left").na.fill(0.0, ["l1", "l3"])
    deep = (F.col("l2") > delta) | (F.col("l3") > 0)
    return j.select("source", "target", "l1", "l2", "l3", F.when(F.col("l1") > 0, "UNSAFE").when(deep, "MISLEADING_SAFE").otherwise("SAFE").alias("status"))


def side_effects(before: DataFrame, after: DataFrame, nodes: DataFrame, depth: int = 8) -> DataFrame:
    """(source, target) pairs that are in reach only after a change, from identities that aren't admin to high-value nodes and admin roles."""
    s = nodes.where("node_type in ('User', 'Role') and not is_admin").select("id")
    t = nodes.where("is_high_value or (is_admin and node_type = 'Role')").select("id")
    old, new = (reach(e, s, t, depth).select("source", "target") for e in (before, after))
    return new.join(old, ["source", "target"], "left_anti")


#: Objectives and their directions, all to be small.
OBJECTIVES = ("level3_risk", "t2_breakage", "transformation_cost")
TOLERANCE = 1e-6


def dominance(points: DataFrame, objectives: tuple[str, ...] = OBJECTIVES, maximize: tuple[str, ...] = (), tolerance: float = TOLERANCE) -> DataFrame:
    """(a, b, relation) of every two methods: dominates, dominated_by, equivalent or incomparable.

    points: a row for each method, a stated set of a few; the pairing is over methods, never over data rows.
    """
    sign = lambda o: -1.0 if o in maximize else 1.0
    side = lambda x: points.select(F.col("method").alias(x), *[(F.col(o) * sign(o)).alias(f"{x}_{o}") for o in objectives])
    j = side("a").join(F.broadcast(side("b")), F.col("a") != F.col("b"))
    better, worse = F.lit(False), F.lit(False)
    for o in objectives:
        better = better | (F.col(f"a_{o}") < F.col(f"b_{o}") - tolerance)
        worse = worse | (F.col(f"a_{o}") > F.col(f"b_{o}") + tolerance)
    return j.select("a", "b", F.when(better & ~worse, "dominates").when(worse & ~better, "dominated_by").when(~better & ~worse, "equivalent").otherwise("incomparable").alias("relation"))


def frontier(points: DataFrame, **options) -> DataFrame:
    """(method, on_frontier, dominates, dominated_by), the lists sorted and joined by commas."""
    d = dominance(points, **options)
    names = lambda r: F.array_join(F.array_sort(F.collect_list(F.when(F.col("relation") == r, F.col("b")))), ",")
    got = d.groupBy(F.col("a").alias("method")).agg(names("dominates").alias("dominates"), names("dominated_by").alias("dominated_by"))
    return points.select("method").join(got, "method", "left").na.fill("").select("method", (F.col("dominated_by") == "").alias("on_frontier"), "dominates", "dominated_by")


def summarize(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """Per method over runs: mean and sample deviation of each metric."""
    return runs.groupBy("method").agg(F.count("*").alias("runs"), *[f for m in metrics for f in (F.round(F.avg(m), 6).alias(f"{m}_mean"), F.round(F.coalesce(F.stddev_samp(m), F.lit(0.0)), 6).alias(f"{m}_std"))])


def certify(points: DataFrame, method: str) -> DataFrame:
    """One row: is the method safe at level 3, on the frontier, and cheaper or less breaking than each other safe method?"""
    p = points.where(F.col("method") == method).select(*[F.col(o).alias(f"m_{o}") for o in OBJECTIVES])
    front = frontier(points).where(F.col("method") == method).select("on_frontier")
    rest = points.where((F.col("method") != method) & (F.col("level3_risk") <= TOLERANCE)).crossJoin(F.broadcast(p))
    ahead = rest.agg(F.coalesce(F.bool_and((F.col("m_t2_breakage") <= F.col("t2_breakage") + TOLERANCE) | (F.col("m_transformation_cost") <= F.col("transformation_cost") + TOLERANCE)), F.lit(True)).alias("ahead"))
    return p.crossJoin(front).crossJoin(ahead).select((F.col("m_level3_risk") <= TOLERANCE).alias("safe"), "on_frontier", "ahead")


def remediation_methods(observed: DataFrame, truth: DataFrame, worlds: DataFrame, cuts: dict[str, DataFrame], pairs: DataFrame, events: DataFrame, samples: int, costs: dict[str, float]) -> DataFrame:
    """A row for each method: its cuts' risks at three levels, the share of T2 events that it breaks, its cost.

    cuts: the edges that each method removes; events: (win, src, dst) over the edges that they use.
    """
    out = None
    for name, gone in cuts.items():
        repaired = observed.select(*KEY).join(gone.select(*KEY), KEY, "left_anti")
        level = three_levels(observed, repaired, truth, worlds, pairs, samples).agg(F.avg("l1").alias("level1_risk"), F.avg("l2").alias("level2_risk"), F.avg("l3").alias("level3_risk"))
        lost = events.where("win = 'T2'").join(gone.select(*KEY, F.lit(1).alias("g")).distinct(), KEY, "left").agg(F.coalesce(F.avg(F.coalesce("g", F.lit(0))), F.lit(0.0)).alias("t2_breakage"))
        one = level.crossJoin(lost).select(F.lit(name).alias("method"), "level1_risk", "level2_risk", "level3_risk", "t2_breakage", F.lit(float(costs.get(name, 0.0))).alias("transformation_cost"))
        one = one.withColumn("safety_gap", F.greatest(F.lit(0.0), F.col("level3_risk") - F.col("level1_risk"))).withColumn("utility", 1 - F.col("t2_breakage"))
        out = one if out is None else out.unionByName(one)
    return out

"""Activity logs in two windows: splits, drift, replay, synthesis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.functions.scalars import uniform

EVENT = ["principal_arn", "action", "resource_arn"]


def split_windows(events: DataFrame, cut, column: str = "ts") -> DataFrame:
    """events with ``win``: T1 before the cut, T2 from it on."""
    return events.withColumn("win", F.when(F.col(column) < F.lit(cut), "T1").otherwise("T2"))


def split_days(events: DataFrame, t1_days: float = 90, t2_days: float = 30) -> DataFrame:
    """[0, t1) and [t1, t1 + t2], by ``day_offset``; other events go."""
    d = F.col("day_offset")
    return events.withColumn("win", F.when((d >= 0) & (d < t1_days), "T1").when((d >= t1_days) & (d <= t1_days + t2_days), "T2")).where("win is not null")


def window_stats(events: DataFrame) -> DataFrame:
    """Per window: events and distinct principals, resources and actions."""
    return events.groupBy("win").agg(F.count("*").alias("n"), F.count_distinct("principal_arn").alias("principals"), F.count_distinct("resource_arn").alias("resources"), F.count_distinct("action").alias("actions"))


def drift(events: DataFrame) -> DataFrame:
    """(kind, value): principals, resources and actions of T2 that T1 doesn't have. One pass: a value's windows meet."""
    long = events.select("win", F.explode(F.map_from_arrays(F.array(F.lit("principal"), F.lit("resource"), F.lit("action")), F.array("principal_arn", "resource_arn", "action"))).alias("kind", "value"))
    return long.groupBy("kind", "value").agg(F.max(F.col("win") == "T1").alias("old")).where("not old").select("kind", "value")


def drift_rate(events: DataFrame) -> DataFrame:
    """One row: T2 events, those on (principal, action, resource) that T1 doesn't have, and their share."""
    seen = events.groupBy(*EVENT).agg(F.count_if(F.col("win") == "T1").alias("t1"), F.count_if(F.col("win") == "T2").alias("t2"))
    return seen.agg(F.sum("t2").alias("n_t2"), F.sum(F.when(F.col("t1") == 0, F.col("t2")).otherwise(0)).alias("n_new")).withColumn("rate", F.coalesce(F.try_divide("n_new", "n_t2"), F.lit(0.0)))


def replay(events: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per window: allowed, denied, share that breaks, and whether all conform. events: (req_id, win)."""
    j = events.select("req_id", "win").join(decisions.select("req_id", "decision"), "req_id")
    bad = F.col("decision") != "Allow"
    return j.groupBy("win").agg(F.count("*").alias("n"), F.count_if(~bad).alias("allowed"), F.count_if(bad).alias("denied"), F.avg(bad.cast("double")).alias("breakage"), (F.count_if(bad) == 0).alias("conforming"))


def routine_operations(edges: DataFrame, nodes: DataFrame, least: int = 2) -> DataFrame:
    """(principal, action, resource, routine): what users and roles do over their edges.

    Edges of those who aren't admin to admins and high-value nodes, and bridges, are no routine work and stay out; an
    operation is routine if the resource has at least ``least`` such principals.
    """
    info = nodes.select(F.col("id").alias("dst"), (F.col("is_admin") | F.col("is_high_value")).alias("high"))
    who = nodes.where("node_type in ('User', 'Role')").select(F.col("id").alias("src"), "is_admin")
    ops = edges.join(who, "src").join(info, "dst").where("is_admin or (not high and not is_bridge)").select(F.col("src").alias("principal"), F.col("relation").alias("action"), F.col("dst").alias("resource")).distinct()
    often = ops.groupBy("resource").agg(F.count_distinct("principal").alias("k"))
    return ops.join(often, "resource").select("principal", "action", "resource", (F.col("k") >= least).alias("routine"))


def synthesize(operations: DataFrame, t1_days: int = 90, t2_days: int = 30, per_day: int = 20, drift_share: float = 0.25, resource_share: float = 0.75, seed: str = "0") -> DataFrame:
    """Events from (principal, action, resource, routine): routine ones in T1 and, but for drift, in T2.

    Drift takes infrequent operations, or the same action on a new resource. Draws depend on the event's number.
    """
    spark = operations.sparkSession
    indexed = operations.withColumn("i", F.row_number().over(_by_pool()) - 1)
    sizes = operations.groupBy("routine").agg(F.count("*").alias("m"))
    n1, n2 = max(10, t1_days * per_day), max(5, t2_days * per_day)
    u = lambda name: uniform(F.lit(seed), F.lit(name), F.col("id").cast("string"))
    e = spark.range(n1 + n2).withColumn("t2", F.col("id") >= n1)
    e = e.withColumn("day_offset", F.when(F.col("t2"), t1_days + u("day") * t2_days).otherwise(u("day") * t1_days)).withColumn("is_drift", F.col("t2") & (u("drift") < drift_share))
    e = e.withColumn("new_resource", F.col("is_drift") & (u("kind") < resource_share)).withColumn("routine", ~(F.col("is_drift") & ~F.col("new_resource")))
    have = sizes.agg(F.max(F.when(F.col("routine"), F.col("m"))).alias("a"), F.max(F.when(~F.col("routine"), F.col("m"))).alias("b"))
    e = e.crossJoin(F.broadcast(have)).withColumn("routine", F.when(F.col("a").isNull(), False).when(F.col("b").isNull(), True).otherwise(F.col("routine")))
    e = e.withColumn("i", F.floor(u("pick") * F.when(F.col("routine"), F.col("a")).otherwise(F.col("b"))).cast("int"))
    out = e.join(indexed, ["routine", "i"])
    return out.select(F.concat(F.lit("evt-"), F.col("id").cast("string")).alias("event_id"), F.col("principal").alias("principal_arn"), "action",
                      F.when(F.col("new_resource"), F.concat("resource", F.lit("-new-"), (F.col("id") % 3).cast("string"))).otherwise(F.col("resource")).alias("resource_arn"),
                      "day_offset", "is_drift", F.when(F.col("new_resource"), "resource").when(F.col("is_drift"), "action").alias("drift_type"))


def _by_pool():
    from pyspark.sql import Window

    return Window.partitionBy("routine").orderBy("principal", "action", "resource")

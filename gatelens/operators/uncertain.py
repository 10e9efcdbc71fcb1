"""Possible worlds of uncertain edges: sampling, Monte-Carlo reachability, comparison with products, pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.functions.scalars import uniform
from gatelens.operators.reach import path_edges, reach, world_hits, world_paths


def sample_worlds(candidates: DataFrame, samples: int = 100, seed: str = "0") -> DataFrame:
    """(sample_id, src, dst, relation): each candidate edge is in a world with its probability, independently."""
    worlds = candidates.sparkSession.range(samples).select(F.col("id").cast("int").alias("sample_id"))
    drawn = candidates.crossJoin(F.broadcast(worlds))  # a bounded number of worlds
    u = uniform(F.lit(seed), F.col("sample_id").cast("string"), "src", "relation", "dst")
    return drawn.where(u < F.col("probability")).select("sample_id", "src", "dst", "relation")


def world_reach(observed: DataFrame, worlds: DataFrame, sources: DataFrame, targets: DataFrame, samples: int, depth: int = 8) -> DataFrame:
    """(source, target, hits, frequency, se): in how many worlds a target is in reach."""
    f = F.col("hits") / samples
    return world_hits(observed, worlds, sources, targets, samples, depth).select("source", "target", "hits", f.alias("frequency"), F.sqrt(F.greatest(f * (1 - f), F.lit(1e-9)) / samples).alias("se"))


def world_witnesses(observed: DataFrame, worlds: DataFrame, sources: DataFrame, targets: DataFrame, samples: int, depth: int = 8) -> DataFrame:
    """(sample_id, source, target, hops, path): the witness of each pair in each world."""
    every = observed.sparkSession.range(samples).select(F.col("id").cast("int").alias("sample_id"))
    return reach(worlds, sources, targets, depth, True, ["sample_id"], observed, every)


def with_zeros(frequencies: DataFrame, pairs: DataFrame) -> DataFrame:
    """The asked pairs, those never in reach with 0."""
    return pairs.select("source", "target").join(frequencies, ["source", "target"], "left").select("source", "target", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("frequency", F.lit(0.0)).alias("frequency"))


def product_comparison(frequencies: DataFrame, candidates: DataFrame, samples: int) -> DataFrame:
    """Each pair's frequency beside the product of all candidates' probabilities: errors, a 95 % interval, consistency."""
    p = candidates.agg(F.coalesce(F.product("probability"), F.lit(1.0)).alias("product"))
    f = F.col("frequency")
    half = 1.96 * F.sqrt(F.greatest(f * (1 - f), F.lit(1e-9)) / samples)
    gap = F.abs(f - F.col("product"))
    return frequencies.crossJoin(F.broadcast(p)).select(
        "source", "target", "frequency", "product", gap.alias("abs_error"), F.when(F.col("product") > 0, gap / F.col("product")).alias("rel_error"),
        F.greatest(F.lit(0.0), f - half).alias("low"), F.least(F.lit(1.0), f + half).alias("high"), F.col("product").between(f - half, f + half).alias("consistent"),
    )


def attack_risk(observed: DataFrame, worlds: DataFrame, pair: DataFrame, samples: int) -> DataFrame:
    """One row per (source, target): share of worlds with a path of any length."""
    ends = [pair.select(F.col(c).alias("id")) for c in ("source", "target")]
    hit = world_hits(observed, worlds, *ends, samples, None)
    return pair.join(hit, ["source", "target"], "left").select("source", "target", (F.coalesce("hits", F.lit(0)) / samples).alias("risk"))


def participation(witnesses: DataFrame, edges: DataFrame, samples: int) -> DataFrame:
    """(src, dst, relation, sample_share, path_count) over (chunk, source, target, mask, path) witnesses, as ``reach.world_paths``
    gives them: in what share of the worlds an edge is on a witness, and on how many witnesses."""
    legs = path_edges(witnesses.select("source", "target", "path").distinct().withColumn("source", F.col("path")), edges).select(F.col("source").alias("path"), "src", "dst", "relation", "is_bridge").distinct()
    masks = witnesses.groupBy("chunk", "path").agg(F.bit_or("mask").alias("worlds"))  # a path has one source and one target, and so a world once
    each = legs.join(masks, "path").groupBy("src", "dst", "relation", "is_bridge", "chunk").agg(F.bit_or("worlds").alias("any"), F.sum(F.bit_count("worlds")).alias("paths"))
    return each.groupBy("src", "dst", "relation", "is_bridge").agg((F.sum(F.bit_count("any")) / samples).alias("sample_share"), F.sum("paths").alias("path_count"))


def capability_score(edges: DataFrame, capability: DataFrame) -> DataFrame:
    """edges with a score of how well they can be narrowed: latent 0.5, no actions 0.8, some scopable 1, only
    wildcard-only or unknown actions 0.4, else 0.7."""
    known = capability.select(F.lower("action").alias("a"), "wildcard_only", (~F.col("wildcard_only") & (F.size("resource_types") > 0)).alias("scopable"))
    each = edges.select("src", "dst", "relation", F.explode("actions").alias("act")).join(F.broadcast(known), F.lower("act") == F.col("a"), "left")
    agg = each.groupBy("src", "dst", "relation").agg(F.max(F.coalesce("scopable", F.lit(False))).alias("some"), F.min(F.coalesce("wildcard_only", F.lit(True))).alias("only"))
    s = F.when(F.col("is_latent"), 0.5).when(F.size("actions") == 0, 0.8).when(F.col("some"), 1.0).when(F.col("only"), 0.4).otherwise(0.7)
    return edges.join(agg, ["src", "dst", "relation"], "left").withColumn("capability_score", s).drop("some", "only")


def prune(scored: DataFrame, most: int = 50) -> DataFrame:
    """The best ``most`` edges by 0.6 share of worlds, 0.2 relative path count and 0.2 capability score."""
    top = scored.agg(F.greatest(F.max("path_count"), F.lit(1)).alias("top"))
    score = 0.6 * F.col("sample_share") + 0.2 * F.col("path_count") / F.col("top") + 0.2 * F.col("capability_score")
    return scored.crossJoin(F.broadcast(top)).withColumn("score", F.round(score, 9)).drop("top").orderBy(F.desc("score"), F.desc("sample_share"), F.desc("path_count"), "src", "relation", "dst").limit(most)


def optimality_gap(found: float, best: float) -> tuple[float, float]:
    """Absolute gap of a cost to the best one, not below 0, and relative to it; 0 of 0 is 0, anything of 0 is infinite."""
    gap = max(0.0, found - best)
    return gap, gap / best if best > 0 else 0.0 if gap == 0 else float("inf")


def candidate_recall(pruned: DataFrame, optimal: DataFrame) -> DataFrame:
    key = ["src", "dst", "relation"]
    hit = optimal.select(*key).distinct().join(pruned.select(*key, F.lit(1).alias("h")).distinct(), key, "left")
    return hit.agg(F.coalesce(F.avg(F.coalesce("h", F.lit(0))), F.lit(1.0)).alias("recall"))

"""Exact repair: the cheapest set of options that breaks every attack path, as an implicit hitting set.

Paths are too many to list, so they are found as they are needed: a search over the graph, with all pairs and all worlds
in one pass, gives a path for every pair that is still connected; each is a constraint row for every option that would
cut it; the cheapest options that hit all constraints so far are a lower bound, and are cut; and the search goes on in
what is left, until nothing is connected. Then the bound is the answer. A path that no option cuts proves that there is
none. The search is a job over tables; the constraints fall into connected parts, which are solved apart from each other
in groups, by branch and bound with unit propagation, dominance and a dual bound.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.operators.graph import weak_components
from gatelens.operators.reach import ends_of, useful, world_paths
from gatelens.plans.steps import step

#: What floating-point sums of costs may differ by.
SLACK = 1e-9


# --- one connected part ----------------------------------------------------------


def reduced(sets: list[int], cost: list[float]) -> list[int]:
    """The sets without supersets of others, and without options that another does better; sets are bits of options."""
    while True:
        kept: list[int] = []
        for s in sorted(set(sets), key=lambda s: (s.bit_count(), s)):
            if not any(k & s == k for k in kept):
                kept.append(s)
        cover = covers(kept, len(cost))
        worse = 0
        for o, mine in enumerate(cover):
            if mine and any(mine & other == mine and not worse >> p & 1 and (cost[p], -other.bit_count(), p) < (cost[o], -mine.bit_count(), o) and cost[p] <= cost[o] for p, other in enumerate(cover) if p != o):
                worse |= 1 << o
        if not worse:
            return kept
        sets = [s & ~worse for s in kept]


def covers(sets: list[int], options: int) -> list[int]:
    """For each option the sets that it hits, as bits."""
    found = [0] * options
    for i, s in enumerate(sets):
        for o in bits(s):
            found[o] |= 1 << i
    return found


def bits(x: int) -> list[int]:
    out = []
    while x:
        out.append((x & -x).bit_length() - 1)
        x &= x - 1
    return out


def dual_bound(unhit: int, sets: list[int], allowed: int, cost: list[float]) -> float:
    """No hitting set costs less: each set takes what is left of the cheapest of its options, and no option gives more than its cost."""
    left: dict[int, float] = {}
    total = 0.0
    for i in bits(unhit):
        options = bits(sets[i] & allowed)
        if not options:
            return float("inf")
        take = min(left.get(o, cost[o]) for o in options)
        total += take
        for o in options:
            left[o] = left.get(o, cost[o]) - take
    return total


def apart(sets: list[int]) -> list[list[int]]:
    """The sets by connected parts: no option is in sets of two."""
    parts: list[tuple[int, list[int]]] = []
    for s in sets:
        near = [p for p in parts if p[0] & s]
        parts = [p for p in parts if not p[0] & s]
        mask, mine = s, [s]
        for other, theirs in near:
            mask, mine = mask | other, theirs + mine
        parts.append((mask, mine))
    return [p[1] for p in parts]


def cheapest_hit(sets: list[int], cost: list[float]) -> tuple[float, list[int]] | None:
    """The least cost of options that hit all sets, and the options; None where a set is empty."""
    if any(not s for s in sets):
        return None
    found = [searched(part, cost) for part in apart(reduced(sets, cost))]
    return sum(f[0] for f in found), sorted(o for f in found for o in f[1])


def searched(sets: list[int], cost: list[float]) -> tuple[float, list[int]]:
    cover = covers(sets, len(cost))
    best: tuple[float, list[int]] = (float("inf"), [])

    def search(unhit: int, allowed: int, chosen: list[int], spent: float) -> None:
        nonlocal best
        while unhit:  # unit propagation: a set with one option left takes it
            tight = min(bits(unhit), key=lambda i: ((sets[i] & allowed).bit_count(), i))
            options = bits(sets[tight] & allowed)
            if len(options) != 1:
                break
            chosen, spent, unhit = [*chosen, options[0]], spent + cost[options[0]], unhit & ~cover[options[0]]
        if not unhit:
            if spent < best[0] - SLACK:
                best = (spent, chosen)
            return
        if spent + dual_bound(unhit, sets, allowed, cost) >= best[0] - SLACK:
            return
        for o in sorted(options, key=lambda o: (cost[o] / max(1, (cover[o] & unhit).bit_count()), o)):
            search(unhit & ~cover[o], allowed, [*chosen, o], spent + cost[o])
            allowed &= ~(1 << o)  # what follows does without it

    search((1 << len(sets)) - 1, (1 << len(cost)) - 1, [], 0.0)
    return best


# --- all parts -------------------------------------------------------------------

CHOSEN = "component string, option string, cost double, solved boolean"


def _solve(rows: pd.DataFrame) -> pd.DataFrame:
    component = rows["component"].iloc[0]
    priced = dict(zip(rows["option"], rows["cost"], strict=True))
    names = sorted(priced)
    place = {o: i for i, o in enumerate(names)}
    sets = rows.groupby("set")["option"].agg(lambda xs: sum(1 << place[o] for o in set(xs)))
    found = cheapest_hit(list(sets), [float(priced[o]) for o in names])
    return pd.DataFrame([(component, names[o], float(priced[names[o]]), True) for o in found[1]], columns=["component", "option", "cost", "solved"])


def cheapest(constraints: DataFrame, costs: DataFrame) -> DataFrame:
    """(component, option, cost, solved): the cheapest options that hit every constraint, by connected part.

    constraints: (path_id, option), a row for each option that breaks a path, option null for a path that none does; such
    a path, or one whose options have no cost, gives a row that isn't solved. costs: (option, cost), costs not negative.
    """
    known = constraints.select(F.col("path_id").cast("string").alias("path_id"), "option").join(costs.select("option", F.col("cost").cast("double").alias("cost")), "option", "left")
    usable = F.array_sort(F.collect_set(F.when(F.col("cost").isNotNull(), F.col("option"))))
    sets = step(known.groupBy("path_id").agg(usable.alias("options")).select("options").distinct().withColumn("set", F.md5(F.to_json("options"))))
    stuck = sets.where("size(options) = 0").select(F.lit(None).cast("string").alias("component"), F.lit(None).cast("string").alias("option"), F.lit(None).cast("double").alias("cost"), F.lit(False).alias("solved"))
    member = sets.select(F.concat(F.lit("set:"), "set").alias("src"), F.explode("options").alias("option")).withColumn("dst", F.concat(F.lit("option:"), "option"))
    ids = member.select(F.col("src").alias("id")).unionByName(member.select(F.col("dst").alias("id"))).distinct()
    parts = weak_components(ids, member.select("src", "dst"))
    rows = member.join(parts.select(F.col("id").alias("src"), "component"), "src").join(costs.select("option", F.col("cost").cast("double").alias("cost")), "option").select("component", F.col("src").alias("set"), "option", "cost")
    return rows.groupBy("component").applyInPandas(_solve, CHOSEN).unionByName(stuck)


def exact_cuts(paths: DataFrame, actions: DataFrame, scope_cost: float, remove_cost: float) -> DataFrame:
    """(action, choice, cost, total): what becomes of each action so that every path is broken at the least cost.

    paths: (path_id, action) that a path needs; actions: (action, scopable, breaks_if_scoped, needed): a scoped action
    breaks its paths only if the target falls outside, and a needed one can't be removed. No rows where a path stays.
    """
    scope, remove = F.col("scopable") & F.col("breaks_if_scoped"), ~F.col("needed")
    named = lambda what: F.to_json(F.struct("action", F.lit(what).alias("choice")))
    each = actions.select("action", F.explode(F.array_compact(F.array(F.when(scope, F.struct(named("scope").alias("option"), F.lit(scope_cost).alias("cost"))), F.when(remove, F.struct(named("remove").alias("option"), F.lit(remove_cost).alias("cost")))))).alias("o")).select("action", "o.*")
    chosen = step(cheapest(paths.select("path_id", "action").join(each.select("action", "option"), "action", "left").select("path_id", "option"), each.select("option", "cost")))
    total = chosen.agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total"), F.coalesce(F.bool_and("solved"), F.lit(True)).alias("ok")).where("ok").drop("ok")
    made = chosen.where("solved").select(F.get_json_object("option", "$.action").alias("action"), F.get_json_object("option", "$.choice").alias("choice"), "cost")
    return actions.select("action").join(made, "action", "left").select("action", F.coalesce("choice", F.lit("keep")).alias("choice"), F.coalesce("cost", F.lit(0.0)).alias("cost")).crossJoin(F.broadcast(total))


# --- over a graph ----------------------------------------------------------------


def cheapest_cuts(observed: DataFrame, worlds: DataFrame, pair: DataFrame | tuple[DataFrame, DataFrame], options: DataFrame, samples: int, used: DataFrame | None = None) -> DataFrame | None:
    """(option, cost): the cheapest options after which no pair is connected in any world; None where there is no such set.

    The arguments are those of ``repair.greedy_cuts``: observed (src, dst) edges are in every world, worlds (sample_id,
    src, dst) in single ones; options: (option, cost, src, dst, the edges that it cuts); options that cut an edge of used
    aren't admitted. Costs are of options, not of edges.
    """
    key = ["src", "dst"]
    if used is not None:
        options = options.join(options.join(used.select(*key).distinct(), key, "left_semi").select("option").distinct(), "option", "left_anti")
    ends = ends_of(pair)
    flat = step(observed.select(*key).unionByName(worlds.select(*key)).distinct())
    ahead = useful(flat, ends[1], None).withColumnRenamed("node", "dst")
    behind = useful(flat.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ends[0], None).withColumnRenamed("node", "src")
    live = step(flat.join(ahead, "dst", "left_semi").join(behind, "src", "left_semi").select(*key))
    o, w = step(observed.select(*key).distinct().join(live, key, "left_semi")), step(worlds.select("sample_id", *key).distinct().join(live, key, "left_semi"))
    opts = step(options.select("option", F.col("cost").cast("double").alias("cost"), *key).join(live, key, "left_semi"))
    costs = opts.groupBy("option").agg(F.max("cost").alias("cost"))
    rows, depth = None, 1
    chosen = o.sparkSession.createDataFrame([], CHOSEN)
    while True:
        gone = step(opts.join(chosen.select("option"), "option", "left_semi").select(*key).distinct())
        left = world_paths(o.join(gone, key, "left_anti"), w.join(gone, key, "left_anti"), *ends, samples, depth)
        open_ = (left if isinstance(pair, tuple) else left.join(pair.select("source", "target").distinct(), ["source", "target"], "left_semi")).select("path").distinct()
        n = F.split("path", ">")
        legs = open_.select("path", F.explode(F.arrays_zip(F.slice(n, F.lit(1), F.size(n) - 1).alias("src"), F.slice(n, F.lit(2), F.size(n) - 1).alias("dst"))).alias("e")).select("path", "e.*")
        anew = legs.join(opts.select("option", *key), key, "left").groupBy("path").agg(F.collect_set("option").alias("options"))
        anew = step(anew.select(F.col("path").alias("path_id"), F.explode_outer("options").alias("option")))
        if anew.isEmpty():
            if depth is None:
                return chosen.select("option", "cost")
            # short paths first: what cuts them leaves few of the long ones
            depth = 4 if depth == 1 else None
            continue
        rows = anew if rows is None else step(rows.unionByName(anew).distinct())
        chosen = step(cheapest(rows, costs))
        if not chosen.where("not solved").isEmpty():
            return None


def compare_with_greedy(exact: DataFrame | None, greedy: DataFrame, risk: float) -> DataFrame:
    """One row: costs of both repairs, the gap and the gap relative to the exact one; risk: what the greedy search left at its start
    if it took nothing. exact_cost is null where no repair exists, greedy_solved tells whether the greedy one ends without risk."""
    spark = greedy.sparkSession
    total = spark.createDataFrame([(None,)], "exact_cost double") if exact is None else exact.agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("exact_cost"))
    spent = greedy.agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("greedy_cost"), F.coalesce(F.min("risk"), F.lit(risk)).alias("greedy_risk"))
    gap = F.greatest(F.col("greedy_cost") - F.col("exact_cost"), F.lit(0.0))
    relative = F.when(F.col("exact_cost") > 0, gap / F.col("exact_cost")).when(gap == 0, 0.0).otherwise(F.lit(float("inf")))
    return total.crossJoin(F.broadcast(spent)).select("exact_cost", "greedy_cost", "greedy_risk", (F.col("greedy_risk") == 0).alias("greedy_solved"), F.when(F.col("greedy_risk") == 0, gap).alias("gap"), F.when(F.col("greedy_risk") == 0, relative).alias("relative_gap"))

"""Edits of policy statements, and searches for the cheapest set of edits that breaks every attack path."""

from __future__ import annotations

import difflib
import heapq
from abc import ABC, abstractmethod
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelens.functions.globs import action_matches, any_action, any_resource, normal_action
from gatelens.operators.capability import validate
from gatelens.operators.graph import weak_components
from gatelens.operators.policy import governed_matches, governing_policies, matches, principal_matches
from gatelens.operators.reach import WORLD_BITS, ends_of, has_path, useful, world_bits
from gatelens.operators.resync import IMPLIED, synchronize
from gatelens.operators.uncertain import attack_risk
from gatelens.plans.steps import step

SCOPE_COST, REMOVE_COST = 1.0, 5.0
#: Options evaluated in one reachability pass, about.
OPTION_BLOCK = 1000
#: Rows of a connected part (an edge that a source reaches is one) up to which one task searches it.
PART_ROWS = 200_000


class Edit(ABC):
    """An edit of one policy's statements; subclasses give its cost and the new statements."""

    cost: float

    @abstractmethod
    def apply(self, statements: DataFrame) -> DataFrame: ...


class ScopeResource(Edit):
    """Narrow an action of a statement to some resources: in place if it is the only action, else split off.

    policy_id: the policy whose statement is meant, where equal sids of others are to stay; None edits all of the sid.
    """

    cost = SCOPE_COST

    def __init__(self, sid: str, action: str, resources: list[str], policy_id: str | None = None):
        self.sid, self.action, self.resources, self.policy_id = sid, action, sorted(resources), policy_id

    def apply(self, statements: DataFrame) -> DataFrame:
        here = _meant(self.sid, self.policy_id) & F.exists("action", lambda a: normal_action(a) == self.action.strip().lower())
        alone, to = F.size("action") == 1, F.array(*[F.lit(r) for r in self.resources])
        kept = statements.withColumn("resource", F.when(here & alone, to).otherwise(F.col("resource"))).withColumn(
            "action", F.when(here & ~alone, F.filter("action", lambda a: normal_action(a) != self.action.strip().lower())).otherwise(F.col("action"))
        )
        split = statements.where(here & ~alone).withColumn("sid", F.concat("sid", F.lit("_Scoped"))).withColumn("action", F.array(F.lit(self.action))).withColumn("resource", to)
        return kept.unionByName(split)


class RemoveAction(Edit):
    """Take an action out of a statement; a statement that loses its last action goes. Others, and those that never named
    an action, such as statements of what is not meant, stay as they are."""

    cost = REMOVE_COST

    def __init__(self, sid: str, action: str, policy_id: str | None = None):
        self.sid, self.action, self.policy_id = sid, action, policy_id

    def apply(self, statements: DataFrame) -> DataFrame:
        named = F.exists("action", lambda a: normal_action(a) == self.action.strip().lower())
        here = F.coalesce(_meant(self.sid, self.policy_id) & named, F.lit(False))
        less = F.filter("action", lambda a: normal_action(a) != self.action.strip().lower())
        return statements.where(~here | (F.size(less) > 0)).withColumn("action", F.when(here, less).otherwise(F.col("action")))


def _meant(sid: str, policy_id: str | None) -> Column:
    here = F.col("sid") == sid
    return here if policy_id is None else here & (F.col("policy_id") == policy_id)


def authorizing_statements(cuts: DataFrame, edges: DataFrame, statements: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, relation, action, sid): allow statements of policies attached to the source, or of the source itself if
    it is a policy, or of the target's trust, whose globs fit an action of the edge and the target's or source's name."""
    attached = edges.where("relation = 'AttachedWith'").select("src", F.col("dst").alias("policy_id"))
    owner = cuts.select("src", "dst", "relation", "actions")
    ways = owner.join(attached, "src").unionByName(owner.withColumn("policy_id", F.col("src"))).unionByName(owner.withColumn("policy_id", F.col("dst")))
    arn = nodes.select("id", "arn")
    full = ways.join(statements.where("effect = 'Allow'"), "policy_id").join(arn.select(F.col("id").alias("src"), F.col("arn").alias("a1")), "src").join(arn.select(F.col("id").alias("dst"), F.col("arn").alias("a2")), "dst")
    each = full.withColumn("act", F.explode("actions")).where(any_action(F.col("act"), F.col("action")) & (any_resource(F.col("a1"), F.col("resource")) | any_resource(F.col("a2"), F.col("resource"))))
    return each.select("src", "dst", "relation", F.col("act").alias("action"), "sid").distinct()


def evidenced_resources(events: DataFrame, statements: DataFrame, target: str) -> DataFrame:
    """(sid, resources): what the log shows a statement is used for, without the target and ``*``."""
    used = events.join(F.broadcast(statements.select("sid", "effect", F.col("action").alias("acts"), F.col("resource").alias("res"))), any_action(F.col("action"), F.col("acts")) & any_resource(F.col("resource_arn"), F.col("res")) & (F.col("effect") == "Allow"))
    return used.where((F.col("resource_arn") != target) & (F.col("resource_arn") != "*")).groupBy("sid").agg(F.array_sort(F.collect_set("resource_arn")).alias("resources"))


def greedy_cuts(observed: DataFrame, worlds: DataFrame, pair: DataFrame | tuple[DataFrame, DataFrame], options: DataFrame, samples: int, delta: float = 0.0, most: int | None = None, used: DataFrame | None = None) -> DataFrame:
    """(step, option, cost, risk): the options taken in turn until the mean risk of the pairs is at most delta, or no option lessens it,
    or ``most`` are taken, if that is given.

    options: (option, cost, src, dst, edges that it cuts), and maybe ``scoping``, which raises an option's score by a
    tenth. used: (src, dst) edges that the workload's log needs; options that cut one of them are not admitted. pair: rows
    (source, target), or two tables (id) of sources and targets, of which each is asked with each. Each turn takes the
    largest fall in risk per cost over all options, however small; ties go to the option that sorts first. What each option would cut off
    is found once for each source, from the edges that the source reaches (``_cut_off``), and again for sources of which an edge went.

    Sources that share no option, directly or over others, don't touch each other: each connected part takes its options in turns of its
    own, in one task up to ``PART_ROWS`` rows and in rounds over tables beyond, and of the parts' next options the best is taken.
    """
    spark, taken = observed.sparkSession, []
    key = ["src", "dst"]
    if used is not None:
        broken = options.join(used.select(*key).distinct(), key, "left_semi").select("option").distinct()
        options = options.join(broken, "option", "left_anti")
    weight = F.when(F.col("scoping"), 1.1).otherwise(1.0) if "scoping" in options.columns else F.lit(1.0)
    # only edges on some way from a pair's source to a pair's target can change a risk; the others would be looked at in vain
    ends = ends_of(pair)
    flat = step(observed.select(*key).unionByName(worlds.select(*key)).distinct())
    ahead = useful(flat, ends[1], None).withColumnRenamed("node", "dst")
    behind = useful(flat.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ends[0], None).withColumnRenamed("node", "src")
    live = step(flat.join(ahead, "dst", "left_semi").join(behind, "src", "left_semi").select(*key))
    opts = step(options.join(live, key, "left_semi").select("option", F.col("cost").cast("double").alias("cost"), weight.alias("weight"), *key))
    names = step(opts.groupBy("option").agg(F.max("cost").alias("cost"), F.max("weight").alias("weight")))
    o, w = step(observed.select(*key).distinct().join(live, key, "left_semi")), step(worlds.select("sample_id", *key).distinct().join(live, key, "left_semi"))
    asked = ends[0].count() * ends[1].count() - ends[0].join(ends[1], "id", "left_semi").count() if isinstance(pair, tuple) else pair.count()
    goals = ends[1].select(F.col("id").alias("dst")) if isinstance(pair, tuple) else pair.select("source", F.col("target").alias("dst")).distinct()
    met = step(_met(o, w, goals, ends[0], opts, samples))
    of, to = F.concat(F.lit("source:"), "source"), F.concat(F.lit("option:"), "option")
    shared = step(met.select(of.alias("src"), F.explode("options").alias("option")).distinct().withColumn("dst", to))
    ids = met.select(of.alias("id")).unionByName(shared.select(F.col("dst").alias("id"))).distinct()
    parts = step(weak_components(ids, shared.select("src", "dst")).select("id", F.col("component").cast("string").alias("part")))
    whole = met.withColumn("id", of).join(parts, "id").drop("id")
    large = F.broadcast(step(whole.groupBy("part").count().where(F.col("count") > PART_ROWS).select("part")))
    prices = step(names.withColumn("id", to).join(parts, "id").drop("id").join(large, "part", "left_anti"))
    small = whole.join(large, "part", "left_anti").groupBy("part").cogroup(prices.groupBy("part"))
    found = small.applyInPandas(lambda rows, priced: _in_part(rows, priced, most), IN_PART)
    turns: dict[str, list[tuple]] = {}
    hits = 0
    for r in sorted(found.collect(), key=lambda r: (r["part"], r["turn"])):
        if r["option"] is None:
            hits += r["n"]
        else:
            turns.setdefault(r["part"], []).append((r["option"], r["cost"], r["score"], r["n"]))
    if not large.isEmpty():
        first, turns[""] = _in_rounds(step(whole.join(large, "part", "left_semi").drop("part")), names, opts, most)
        hits += first
    risk = hits / samples / asked if asked else 0.0
    heads = [(-t[0][2], t[0][0], part, 0) for part, t in turns.items() if t]
    heapq.heapify(heads)
    while heads and risk > delta and (most is None or len(taken) < most):
        _, option, part, at = heapq.heappop(heads)
        hits -= turns[part][at][3]
        risk = hits / samples / asked
        taken.append((len(taken) + 1, option, float(turns[part][at][1]), float(risk)))
        if at + 1 < len(turns[part]):
            after = turns[part][at + 1]
            heapq.heappush(heads, (-after[2], after[0], part, at + 1))
    return spark.createDataFrame(taken, "step int, option string, cost double, risk double")


def _in_rounds(met: DataFrame, names: DataFrame, opts: DataFrame, most: int | None) -> tuple[int, list[tuple]]:
    """The worlds in which targets are reached, and (option, cost, score, n) of the options in their turns, found in jobs over tables."""
    key, turns = ["src", "dst"], []
    cut = step(met.groupBy("source").applyInPandas(_cut_off, CUT_OFF))
    hits = cut.where("option is null").agg(F.sum("n")).collect()[0][0] or 0
    while most is None or len(turns) < most:
        found = cut.where("option is not null").groupBy("option").agg(F.sum("n").alias("n")).join(names, "option").withColumn("score", F.col("n") / F.col("cost") * F.col("weight"))
        best = found.orderBy(F.desc("score"), "option").limit(1).collect()
        if not best:
            break
        turns.append((best[0]["option"], best[0]["cost"], best[0]["score"], best[0]["n"]))
        gone = F.broadcast(opts.where(F.col("option") == best[0]["option"]).select(*key))
        touched = step(met.join(gone, key, "left_semi").select("source").distinct())
        again = met.join(touched, "source", "left_semi").join(gone, key, "left_anti")
        cut = step(cut.join(touched, "source", "left_anti").unionByName(again.groupBy("source").applyInPandas(_cut_off, CUT_OFF)))
        met = step(met.join(gone, key, "left_anti"))
    return hits, turns


IN_PART = "part string, turn int, option string, cost double, score double, n long"


def _in_part(rows: pd.DataFrame, priced: pd.DataFrame, most: int | None) -> pd.DataFrame:
    """The same for one part: a row without option for the worlds in which targets are reached, then a row a turn."""
    if rows.empty:
        return pd.DataFrame([], columns=["part", "turn", "option", "cost", "score", "n"])
    part, price = rows["part"].iloc[0], {r.option: (float(r.cost), float(r.weight)) for r in priced.itertuples()}
    legs = {source: list(zip(g["src"], g["dst"], g["masks"], map(tuple, g["options"]), g["goal"], strict=True)) for source, g in rows.groupby("source")}
    holders: dict[str, set[str]] = {}
    for source, mine in legs.items():
        for leg in mine:
            for x in leg[3]:
                holders.setdefault(x, set()).add(source)
    lost, total, out = {}, dict.fromkeys(holders, 0), [(part, 0, None, None, None, 0)]
    for source, mine in legs.items():
        reached, lost[source] = _lost(source, mine)
        out[0] = (*out[0][:5], out[0][5] + reached)
        for x, n in lost[source].items():
            total[x] += n
    entry = lambda x: (-(total[x] / price[x][0] * price[x][1]), x, total[x])
    heap = [entry(x) for x, n in total.items() if n]
    heapq.heapify(heap)
    while heap and (most is None or len(out) <= most):
        score, option, n = heapq.heappop(heap)
        if n != total[option]:  # an entry of before; that of now is there too
            continue
        out.append((part, len(out), option, price[option][0], -score, n))
        changed = set()
        for source in holders[option]:
            for x, was in lost[source].items():
                total[x] -= was
                changed.add(x)
            legs[source] = [leg for leg in legs[source] if option not in leg[3]]
            lost[source] = _lost(source, legs[source])[1]
            for x, now in lost[source].items():
                total[x] += now
                changed.add(x)
        holders[option] = set()
        for x in changed:
            if total[x]:
                heapq.heappush(heap, entry(x))
    return pd.DataFrame(out, columns=["part", "turn", "option", "cost", "score", "n"])


CUT_OFF = "source string, option string, n long"


def _met(observed: DataFrame, worlds: DataFrame, goals: DataFrame, sources: DataFrame, opts: DataFrame, samples: int) -> DataFrame:
    """(source, src, dst, masks, options, goal): the edges that a source reaches, the worlds where it does as bits of each chunk's
    mask, the options that cut the edge, and whether its end is a target of the source."""
    bit = F.expr(f"shiftleft(1L, cast(sample_id % {WORLD_BITS} as int))")
    single = worlds.groupBy(F.floor(F.col("sample_id") / WORLD_BITS).cast("int").alias("chunk"), F.col("src").alias("node"), "dst").agg(F.bit_or(bit).alias("own"))
    chunks = observed.sparkSession.range(-(-samples // WORLD_BITS)).select(F.col("id").cast("int").alias("chunk"))
    every = observed.crossJoin(F.broadcast(chunks)).select("chunk", F.col("src").alias("node"), "dst", F.lit(-1).cast("long").alias("own"))
    links = step(every.unionByName(single.select("chunk", "node", "dst", "own")).groupBy("chunk", "node", "dst").agg(F.bit_or("own").alias("own")))
    at = world_bits(observed, worlds, sources, None, samples, None).groupBy("chunk", "source", "node").agg(F.bit_or("mask").alias("mask"))
    legs = at.join(links, ["chunk", "node"]).withColumn("mask", F.col("mask").bitwiseAND(F.col("own"))).where("mask <> 0")
    masks = F.map_from_entries(F.collect_list(F.struct("chunk", "mask")))
    legs = legs.groupBy("source", F.col("node").alias("src"), "dst").agg(masks.alias("masks"))
    legs = legs.withColumn("masks", F.transform(F.sequence(F.lit(0), F.lit(-(-samples // WORLD_BITS) - 1)), lambda k: F.coalesce(F.element_at("masks", k), F.lit(0).cast("long"))))
    legs = legs.join(opts.groupBy("src", "dst").agg(F.collect_set("option").alias("options")), ["src", "dst"], "left")
    marked = legs.join(goals.withColumn("goal", F.lit(True)), goals.columns, "left")
    goal = F.coalesce("goal", F.lit(False)) & (F.col("source") != F.col("dst"))
    return marked.select("source", "src", "dst", "masks", F.coalesce("options", F.array().cast("array<string>")).alias("options"), goal.alias("goal"))


def _cut_off(rows: pd.DataFrame) -> pd.DataFrame:
    """(source, option, n): in how many worlds, over all its targets, an option cuts a source off; without option, in how many it reaches them."""
    source = rows["source"].iloc[0]
    reached, lost = _lost(source, list(zip(rows["src"], rows["dst"], rows["masks"], rows["options"], rows["goal"], strict=True)))
    return pd.DataFrame([(source, None, reached), *((source, x, n) for x, n in lost.items())], columns=["source", "option", "n"])


def _lost(source: str, legs: list[tuple]) -> tuple[int, dict[str, int]]:
    """In how many worlds a source reaches its targets, and for each option in how many it is cut off; legs: (src, dst, masks, options, goal).

    An option cuts off a node where it cuts off, or cuts the edge from, each node before it: sets of options are bits,
    and start from all until nothing changes.
    """
    names = sorted({x for leg in legs for x in leg[3]})
    place = {x: i for i, x in enumerate(names)}
    ids = {x: i for i, x in enumerate(dict.fromkeys([source, *(x for leg in legs for x in leg[:2])]))}
    goals = {ids[leg[1]] for leg in legs if leg[4]}
    by_world: dict[int, dict[int, list[tuple[int, int]]]] = {}
    for a, b, masks, options, _ in legs:
        leg = ids[b], sum(1 << place[x] for x in options)
        for chunk, mask in enumerate(masks):
            mask = int(mask) & (1 << WORLD_BITS) - 1
            while mask:
                low = mask & -mask
                mask ^= low
                by_world.setdefault(chunk * WORLD_BITS + low.bit_length() - 1, {}).setdefault(ids[a], []).append(leg)
    reached, lost = 0, [0] * len(names)
    for out in by_world.values():
        cut, queue, waiting = {0: 0}, deque([0]), {0}
        while queue:
            u = queue.popleft()
            waiting.discard(u)
            for v, own in out.get(u, ()):
                was = cut.get(v)
                now = cut[u] | own if was is None else was & (cut[u] | own)
                if now != was:
                    cut[v] = now
                    if v not in waiting:
                        waiting.add(v)
                        queue.append(v)
        for v in goals & cut.keys():
            reached += 1
            bits = cut[v]
            while bits:
                low = bits & -bits
                lost[low.bit_length() - 1] += 1
                bits ^= low
    return reached, {names[i]: n for i, n in enumerate(lost) if n}


def _first(spec: DataFrame, pair: DataFrame, some: DataFrame, risk: float, samples: int, asked: int) -> list:
    """The best of some options (option, cost, weight), or none that helps; spec: (option, sample_id, src, dst) with it taken."""
    hits = has_path(spec.select("option", "sample_id", "src", "dst"), pair, ["option", "sample_id"]).groupBy("option").agg(F.count("*").alias("h"))
    left_risk = F.coalesce(F.col("h"), F.lit(0)) / samples / asked
    found = some.join(hits, "option", "left").withColumn("risk", left_risk).where(F.lit(risk) - F.col("risk") > 1e-6)
    scored = found.select("option", "cost", "risk", ((F.lit(risk) - F.col("risk")) / F.col("cost") * F.col("weight")).alias("score"))
    return scored.orderBy(F.desc("score"), "option").limit(1).collect()


def policy_parts(statements: DataFrame) -> DataFrame:
    """(part, policy_id, sid, pattern, resource): an allow statement's actions one by one, which is what edits change."""
    each = statements.where("effect = 'Allow'").select("policy_id", "sid", F.explode(F.array_distinct(F.transform("action", normal_action))).alias("pattern"), F.coalesce("resource", F.array(F.lit("*"))).alias("resource"))
    return each.select(F.to_json(F.struct("policy_id", "sid", "pattern")).alias("part"), "*")


def edge_supports(cuts: DataFrame, parts: DataFrame, nodes: DataFrame, observed: DataFrame) -> DataFrame:
    """(src, dst, relation, part, own, goal): the parts that allow an action of an edge, by a policy that governs its source,
    directly or over a group (the source's or the target's name fits), or by the source itself, a policy (the target's
    name fits). Edges that take on or pass roles need no listed action."""
    edge = _needed(cuts)
    # only the edges' sources are asked for: not everybody's policies
    mine = observed.join(edge.select("src").distinct(), "src", "left_semi").where("relation = 'MemberOf'").unionByName(observed.where("relation = 'AttachedWith'"))
    governs = governing_policies(mine).distinct().select(F.col("principal").alias("src"), F.col("policy").alias("policy_id"))
    governs = governs.join(edge.select("src").distinct(), "src", "left_semi")
    arn = lambda end, name: nodes.select(F.col("id").alias(end), F.col("arn").alias(name))
    ways = edge.join(governs, "src").join(arn("src", "own"), "src").unionByName(edge.withColumn("policy_id", F.col("src")).withColumn("own", F.lit(None).cast("string")))
    full = ways.join(arn("dst", "goal"), "dst").join(parts, "policy_id").where(action_matches(F.col("act"), F.col("pattern")) & _names(F.col("resource")))
    return full.select("src", "dst", "relation", "part", "own", "goal").distinct()


def _needed(cuts: DataFrame) -> DataFrame:
    actions = F.when(F.size("actions") > 0, F.col("actions"))
    for relation, action in IMPLIED.items():
        actions = actions.when(F.col("relation") == relation, F.array(F.lit(action)))
    return cuts.select("src", "dst", "relation", F.explode(actions).alias("act"))


def trust_parts(trust: DataFrame) -> DataFrame:
    """``policy_parts`` of trust statements, whose parts never equal those of a policy, with ``principal``."""
    each = trust.where("effect = 'Allow'").select("policy_id", "sid", "principal", F.explode(F.array_distinct(F.transform("action", normal_action))).alias("pattern"), F.array(F.lit("*")).alias("resource"))
    return each.select(_trust_part(F.col("pattern")).alias("part"), "*")


def _trust_part(pattern: Column) -> Column:
    return F.to_json(F.struct("policy_id", "sid", pattern.alias("pattern"), F.lit(True).alias("trust")))


def trust_supports(cuts: DataFrame, parts: DataFrame, nodes: DataFrame) -> DataFrame:
    """As ``edge_supports``, for edges that take on a role: the parts of its trust that name the source or anyone."""
    arn = lambda end, name: nodes.select(F.col("id").alias(end), F.col("arn").alias(name))
    takes = _needed(cuts.where("relation = 'AssumesRole'").withColumn("actions", F.lit(None).cast("array<string>"))).join(arn("src", "own"), "src").join(arn("dst", "goal"), "dst")
    full = takes.join(parts, F.col("dst") == F.col("policy_id")).where(action_matches(F.col("act"), F.col("pattern")) & principal_matches(F.col("principal"), F.col("own")))
    return full.select("src", "dst", "relation", "part", "own", "goal").distinct()


def _names(resource: Column) -> Column:
    return any_resource(F.col("goal"), resource) | F.coalesce(any_resource(F.col("own"), resource), F.lit(False))


def greedy_patches(observed: DataFrame, worlds: DataFrame, pair: DataFrame, statements: DataFrame, cuts: DataFrame, log: DataFrame, nodes: DataFrame, capability: DataFrame, samples: int, delta: float = 0.0, most: int = 20, trust: DataFrame | None = None) -> DataFrame:
    """(step, policy_id, sid, action, edit, resources, cost, risk, is_trust): the edits of policies taken in turn until the mean
    risk of the pairs is at most delta, each the largest fall in risk per cost, scoping ahead by a tenth.

    cuts: the edges (src, dst, relation, actions) that edits may aim at, such as the pruned candidates; log: requests as
    ``policy.decide`` takes them, with ``policy_ids``, the policies that govern the principal. A part of a statement, one
    of its actions, is narrowed to the resources that the log or the statement itself names for it, the edge's target
    apart, or taken out. Narrowing must be valid in the capability model. An edit that leaves any request of the log
    without an allow isn't admitted; a log that isn't allowed to begin with raises. Edges without a supporting part, and
    worlds' edges, stay. Requests that repeat a req_id are one. trust: statements of roles, the role's id as policy_id; an
    edge that takes on such a role needs a part of its trust beside one of its source's policies, and so does a request
    of the log. Actions of trust statements can only be taken out. The loop's state is tables: requests count once per
    set of parts that allow them.
    """
    spark, taken, key = observed.sparkSession, [], ["src", "dst"]
    hits = step(matches(log, statements, F.array_contains("r.policy_ids", F.col("s.policy_id"))).select("r.req_id", "r.action", "r.resource_arn", "s.effect", "s.policy_id", "s.sid", F.col("s.action").alias("patterns")))
    state = log.select("req_id").distinct().join(hits.groupBy("req_id").agg(F.bool_or(F.col("effect") == "Deny").alias("no"), F.bool_or(F.col("effect") == "Allow").alias("yes")), "req_id", "left")
    if trust is not None:
        names = nodes.select(F.col("arn").alias("resource_arn"), F.col("id").alias("policy_id")).join(trust.select("policy_id").distinct(), "policy_id", "left_semi")
        takes = log.where(normal_action(F.col("action")) == "sts:assumerole").join(names, "resource_arn").drop("policy_ids")
        gate = step(governed_matches(takes, trust).select("r.req_id", "r.action", "r.resource_arn", "s.effect", "s.policy_id", "s.sid", F.col("s.action").alias("patterns")))
        opens = takes.select("req_id").distinct().join(gate.groupBy("req_id").agg((~F.bool_or(F.col("effect") == "Deny") & F.bool_or(F.col("effect") == "Allow")).alias("open")), "req_id", "left")
        state = state.join(opens.select("req_id", F.coalesce("open", F.lit(False)).alias("open")), "req_id", "left").withColumn("no", F.coalesce("no", F.lit(False)) | ~F.coalesce("open", F.lit(True)))
    denied = state.where("coalesce(no, false) or not coalesce(yes, false)").count()
    if denied:
        raise ValueError(f"{denied} requests of the log are denied before any edit")
    parts = step(policy_parts(statements).withColumn("is_trust", F.lit(False)))
    fits = F.filter(F.transform("patterns", normal_action), lambda p: action_matches(F.col("action"), p))
    named = F.transform(F.array_distinct(fits), lambda p: F.to_json(F.struct("policy_id", "sid", p.alias("pattern"))))
    # a statement without actions allows by what it leaves out, and no edit takes that away
    by = F.when(F.size("patterns") > 0, named).otherwise(F.array(F.lit("")))
    allowed = hits.where("effect = 'Allow'").groupBy("req_id", "resource_arn").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(by)))).alias("ways"))
    allowed = allowed.select("resource_arn", "ways")
    aimed = step(cuts.join(observed.select(*key, "relation"), [*key, "relation"], "left_semi"))
    supports = edge_supports(aimed, parts, nodes, observed).withColumn("is_trust", F.lit(False))
    if trust is not None:
        gates = step(trust_parts(trust).withColumn("is_trust", F.lit(True)))
        supports = supports.unionByName(trust_supports(aimed, gates, nodes).withColumn("is_trust", F.lit(True)))
        parts = step(parts.unionByName(gates.drop("principal")))
        named = F.transform(F.array_distinct(fits), _trust_part)
        by = F.when(F.size("patterns") > 0, named).otherwise(F.array(F.lit("")))
        barred = gate.where("effect = 'Allow'").groupBy("req_id", "resource_arn").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(by)))).alias("ways"))
        allowed = allowed.unionByName(barred.select("resource_arn", "ways"))
    allowed, supports = step(allowed.distinct()), step(supports)
    o = step(observed.select(*key, "relation").distinct())
    w = worlds.select("sample_id", *key)
    every = spark.range(samples).select(F.col("id").cast("int").alias("sample_id"))
    risk, asked = _mean_risk(o.select(*key), w, pair, samples), pair.count()
    while risk > delta and len(taken) < most:
        seen = allowed.select("resource_arn", F.size("ways").alias("others"), F.explode("ways").alias("part")).withColumn("others", F.col("others") - 1)
        aims = supports.where("not is_trust").select("part", "goal").distinct().join(parts, "part")
        known = aims.select("part", "goal", F.explode("resource").alias("r")).unionByName(aims.select("part", "goal").join(seen.select("part", F.col("resource_arn").alias("r")), "part"))
        real = known.where((F.col("r") != "*") & (F.lower("r") != F.lower("goal"))).groupBy("part", "goal").agg(F.array_sort(F.collect_set("r")).alias("to"))
        scope = step(real.select("part", "to").distinct().join(parts.select("part", "pattern"), "part").select(F.to_json(F.struct("part", "to")).alias("option"), "part", "pattern", "to"))
        bad = validate(scope.select("option", F.col("pattern").alias("action"), F.explode("to").alias("resource"), F.lit(None).cast("array<string>").alias("condition_keys")), capability).where("not is_valid").select("option").distinct()
        none = F.lit(None).cast("array<string>")
        options = scope.join(bad, "option", "left_anti").select("option", "part", "to", F.lit(SCOPE_COST).alias("cost"), F.lit(1.1).alias("weight")).unionByName(supports.select("part").distinct().select(F.to_json(F.struct("part")).alias("option"), "part", none.alias("to"), F.lit(REMOVE_COST).alias("cost"), F.lit(1.0).alias("weight")))
        lost = F.col("to").isNull() | ~any_resource(F.col("resource_arn"), F.col("to"))
        # no way is left beside the option's part, and the request is broken
        broken = options.join(seen.where("others = 0"), "part").where(lost).select("option").distinct()
        options = step(options.join(broken, "option", "left_anti"))
        # an edge goes where its source's policies, or its target's trust, have no part left for it
        side = [*key, "relation", "is_trust"]
        total = supports.groupBy(*side).agg(F.countDistinct("part").alias("all"))
        fewer = options.join(supports, "part").where(F.col("to").isNull() | ~_names(F.col("to"))).groupBy("option", *side).agg(F.countDistinct("part").alias("less"))
        gone = step(fewer.join(total, side).where(F.col("less") == F.col("all")).select("option", *key, "relation").distinct())
        names = gone.select("option").distinct().join(options.select("option", "cost", "weight"), "option")
        blocks = -(-names.count() // OPTION_BLOCK)
        best = None
        for b in range(blocks):
            some = step(names.where(F.pmod(F.xxhash64("option"), F.lit(blocks)) == b))
            kept = o.crossJoin(some.select("option")).join(gone, ["option", *key, "relation"], "left_anti").select("option", *key).distinct()
            spec = kept.crossJoin(F.broadcast(every)).select("option", "sample_id", *key).unionByName(w.crossJoin(some.select("option")).select("option", "sample_id", *key))
            first = _first(spec, pair, some, risk, samples, asked)
            if first and (best is None or (-first[0]["score"], first[0]["option"]) < (-best["score"], best["option"])):
                best = first[0]
        if best is None:
            break
        risk = best["risk"]
        chosen = options.where(F.col("option") == best["option"]).join(parts.drop("resource"), "part").collect()[0]
        part, to = chosen["part"], chosen["to"]
        taken.append((len(taken) + 1, chosen["policy_id"], chosen["sid"], chosen["pattern"], "remove" if to is None else "scope", to, float(best["cost"]), float(risk), chosen["is_trust"]))
        o = step(o.join(gone.where(F.col("option") == best["option"]).drop("option"), [*key, "relation"], "left_anti"))
        here, new = F.col("part") == part, F.array(*[F.lit(x) for x in to or []])
        parts = step(parts.where(~here) if to is None else parts.withColumn("resource", F.when(here, new).otherwise(F.col("resource"))))
        supports = step(supports.where(~here | (F.lit(to is not None) & _names(new))) if to is not None else supports.where(~here))
        stays = any_resource(F.col("resource_arn"), new) if to is not None else F.lit(False)
        allowed = step(allowed.select("resource_arn", F.when(stays, F.col("ways")).otherwise(F.array_remove("ways", part)).alias("ways")).distinct())
    return spark.createDataFrame(taken, "step int, policy_id string, sid string, action string, edit string, resources array<string>, cost double, risk double, is_trust boolean")


def apply_patches(statements: DataFrame, patches: DataFrame) -> DataFrame:
    """statements(policy_id, sid, effect, action, resource, ...) after edits as ``greedy_patches`` gives them, in order:
    policies' statements after those of policies, trust statements after those of trust.

    The patches are the few that a search took; statements that a narrowing splits off are edited by later ones too."""
    for p in patches.orderBy("step").collect():
        here = (F.col("policy_id") == p["policy_id"]) & (F.col("effect") == "Allow")
        mine = statements.where(here)
        for sid in (p["sid"] + "_Scoped", p["sid"]):
            edit = RemoveAction(sid, p["action"]) if p["edit"] == "remove" else ScopeResource(sid, p["action"], p["resources"])
            mine = edit.apply(mine)
        statements = step(mine.unionByName(statements.where(~here)))
    return statements


def repaired(edges: DataFrame, nodes: DataFrame, statements: DataFrame, trust: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(statements, trust, edges) after the patches of ``greedy_patches``: the edits carried out, and the edges they touch
    judged again. nodes need node_type."""
    after = apply_patches(statements, patches.where("not is_trust"))
    gates = apply_patches(trust, patches.where("is_trust"))
    return after, gates, synchronize(edges, nodes, statements, after, trust, gates)


def _mean_risk(observed: DataFrame, worlds: DataFrame, pair: DataFrame, samples: int) -> float:
    return attack_risk(observed, worlds, pair, samples).agg(F.avg("risk")).collect()[0][0] or 0.0


def policy_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(policy_id, diff): unified diffs of the JSON texts of (policy_id, doc) tables, for policies that changed."""
    @F.pandas_udf("string")
    def diff(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(difflib.unified_diff((x or "").splitlines(), (y or "").splitlines(), "before", "after", lineterm="")) for x, y in zip(a, b, strict=True)])

    j = before.select("policy_id", F.col("doc").alias("a")).join(after.select("policy_id", F.col("doc").alias("b")), "policy_id", "full").where("not a <=> b")
    return j.select("policy_id", diff("a", "b").alias("diff"))


def side_by_side(before: DataFrame, after: DataFrame) -> DataFrame:
    """(policy_id, html): HTML tables of both texts, for policies that changed."""

    @F.pandas_udf("string")
    def table(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.HtmlDiff().make_table((x or "").splitlines(), (y or "").splitlines(), "before", "after") for x, y in zip(a, b, strict=True)])

    j = before.select("policy_id", F.col("doc").alias("a")).join(after.select("policy_id", F.col("doc").alias("b")), "policy_id", "full").where("not a <=> b")
    return j.select("policy_id", table("a", "b").alias("html"))

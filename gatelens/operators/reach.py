"""Bounded reachability over edge tables: hops, witness paths, escalations, severance.

Every loop advances all sources, and all worlds of a sample, at once; a round is one join and one aggregate on the
frontier alone, and what it finds is written once. Where only the worlds in which a node is reached matter, they are
bits of a number (``world_hits``); where paths do, they are extra key columns. Of the two ends the one with fewer nodes is
where a search begins, against the edges if these are the targets: a pair of an end and a node between is then held for
few ends, and not, say, for every user with every policy of the user's group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatelens.plans.steps import counted_step, step

#: Rounds after which what was found so far is put into one table, so that plans stay small however long the paths.
COMPACT = 16
WORLD_BITS = 64


def _grown(seen: DataFrame, front: DataFrame, hop: int) -> DataFrame:
    seen = seen.unionByName(front)
    return step(seen) if hop % COMPACT == 0 else seen


def _hops(depth: int | None):
    """1, 2 and so on up to depth, or without end."""
    hop = 0
    while depth is None or hop < depth:
        hop += 1
        yield hop


def useful(edges: DataFrame, targets: DataFrame, depth: int | None) -> DataFrame:
    """Nodes from which a target can be reached within depth, targets included: what a search need look at."""
    edges = step(edges.select("src", "dst").distinct())
    seen = front = step(targets.select(F.col("id").alias("node")).distinct())
    for hop in _hops(depth):
        back = edges.join(front.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node")).distinct()
        front, n = counted_step(back.join(seen, "node", "left_anti"))
        if not n:
            break
        seen = _grown(seen, front, hop)
    return seen


def ends_of(pair: DataFrame | tuple[DataFrame, DataFrame]) -> list[DataFrame]:
    """The sources and the targets (id) of pairs (source, target), or of two tables of which each is asked with each."""
    return [step(x.select("id").distinct()) for x in pair] if isinstance(pair, tuple) else [step(pair.select(F.col(c).alias("id")).distinct()) for c in ("source", "target")]


def _backwards(sources: DataFrame, targets: DataFrame) -> bool:
    return targets.select("id").distinct().count() < sources.select("id").distinct().count()


def _turned(edges: DataFrame, back: bool) -> DataFrame:
    """The edges, or the same the other way round."""
    other = {"src": "dst", "dst": "src"}
    return edges.select(*[F.col(other.get(c, c)).alias(c) for c in edges.columns]) if back else edges


def _ends(back: bool) -> list:
    """Source and target of rows that hold where a search began as ``source`` and what it found as ``node``."""
    return [F.col("node").alias("source"), F.col("source").alias("target")] if back else [F.col("source"), F.col("node").alias("target")]


def _longer(back: bool):
    """The path with the node that a round comes to."""
    return F.concat("dst", F.lit(">"), "path") if back else F.concat("path", F.lit(">"), "dst")


def reach(edges: DataFrame, sources: DataFrame, targets: DataFrame, depth: int | None = 8, paths: bool = False, world: list[str] = (), shared: DataFrame | None = None, worlds: DataFrame | None = None) -> DataFrame:
    """(world..., source, target, hops[, path]) with the fewest hops from each source, itself left out, to each target.

    edges: (world..., src, dst); sources: (world..., id) or (id); targets: (id); depth None: however long. Of the
    shortest paths the one whose nodes, joined by ``>``, sort first is the witness. Branches that can't reach a target
    in any world are never walked. shared: (src, dst) edges that every world has, held once; worlds: all worlds' keys,
    where edges don't name each.
    """
    back = not (world and world[0] in sources.columns) and _backwards(sources, targets)
    if back:
        sources, targets = targets, sources
    edges, shared = _turned(edges, back), None if shared is None else _turned(shared, back)
    own = edges.select(*world, "src", "dst").distinct()
    flat = own.select("src", "dst") if shared is None else own.select("src", "dst").unionByName(shared.select("src", "dst"))
    alive = useful(flat, targets, depth).withColumnRenamed("node", "dst")
    own = step(own.join(alive, "dst", "left_semi").select(*world, F.col("src").alias("node"), "dst"))
    common = None if shared is None else step(shared.select(F.col("src").alias("node"), "dst").distinct().join(alive, "dst", "left_semi").select("node", "dst"))
    begin = own.select("node") if common is None else own.select("node").unionByName(common.select("node"))
    start = sources.select(*[c for c in world if c in sources.columns], F.col("id").alias("source")).distinct()
    if world and world[0] not in sources.columns:
        start = start.crossJoin(F.broadcast((edges if worlds is None else worlds).select(*world).distinct()))  # a bounded number of worlds
    key = [*world, "source", "node"]
    seen = front = step(start.select(*world, "source", F.col("source").alias("node"), F.lit(0).alias("hops"), *([F.col("source").alias("path")] if paths else [])).join(begin.distinct(), "node", "left_semi"))
    for hop in _hops(depth):
        out = front.join(own, [*world, "node"])
        if common is not None:
            out = out.unionByName(front.join(common, "node").select(*out.columns))
        least = [F.min(_longer(back)).alias("path")] if paths else []
        grouped = out.groupBy(*world, "source", F.col("dst").alias("node"))
        new = (grouped.agg(*least) if paths else out.select(*world, "source", F.col("dst").alias("node")).distinct()).withColumn("hops", F.lit(hop))
        front, n = counted_step(new.join(seen.select(*key), key, "left_anti"))
        if not n:
            break
        seen = _grown(seen, front, hop)
    hit = seen.where("node <> source").join(targets.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
    return hit.select(*world, *_ends(back), "hops", *(["path"] if paths else []))


def world_bits(shared: DataFrame, worlds: DataFrame, sources: DataFrame, targets: DataFrame | None, samples: int, depth: int | None = 8) -> DataFrame:
    """(chunk, source, node, mask): the worlds of a chunk in which a node is reached, a bit in one row only; what leads to no target is left out, if any are given."""
    common = shared.select(F.col("src").alias("node"), "dst").distinct()
    bit = F.expr(f"shiftleft(1L, cast(sample_id % {WORLD_BITS} as int))")
    masks = worlds.groupBy((F.floor(F.col("sample_id") / WORLD_BITS)).cast("int").alias("chunk"), F.col("src").alias("node"), "dst").agg(F.bit_or(bit).alias("own"))
    if targets is not None:
        alive = useful(shared.select("src", "dst").unionByName(worlds.select("src", "dst")), targets, depth).withColumnRenamed("node", "dst")
        common, masks = common.join(alive, "dst", "left_semi"), masks.join(alive, "dst", "left_semi")
    common, own = step(common.select("node", "dst")), step(masks.select("chunk", "node", "dst", "own"))
    full = [(k, -1 if samples - k * WORLD_BITS >= WORLD_BITS else (1 << (samples - k * WORLD_BITS)) - 1) for k in range(-(-samples // WORLD_BITS))]
    chunks = shared.sparkSession.createDataFrame(full, "chunk int, mask long")
    begin = own.select("node").unionByName(common.select("node")).distinct()
    start = sources.select(F.col("id").alias("source")).distinct().crossJoin(F.broadcast(chunks))
    key = ["chunk", "source", "node"]
    seen = front = step(start.select("chunk", "source", F.col("source").alias("node"), "mask").join(begin, "node", "left_semi").select(*key, "mask"))
    for hop in _hops(depth):
        anew = front.join(common, "node").select("chunk", "source", F.col("dst").alias("node"), "mask")
        some = front.join(own, ["chunk", "node"]).select("chunk", "source", F.col("dst").alias("node"), F.col("mask").bitwiseAND(F.col("own")).alias("mask"))
        came = anew.unionByName(some.where("mask <> 0")).select(*key, "mask", F.lit(0).cast("long").alias("was"))
        was = seen.select(*key, F.lit(0).cast("long").alias("mask"), F.col("mask").alias("was"))
        merged = came.unionByName(was).groupBy(*key).agg(F.bit_or("mask").alias("mask"), F.bit_or("was").alias("was"))
        front, n = counted_step(merged.select(*key, F.expr("mask & ~was").alias("mask")).where("mask <> 0"))
        if not n:
            break
        seen = _grown(seen, front, hop)
    return seen


def world_hits(shared: DataFrame, worlds: DataFrame, sources: DataFrame, targets: DataFrame, samples: int, depth: int | None = 8) -> DataFrame:
    """(source, target, hits): in how many of the worlds 0 to samples - 1 a target is in reach, where it is in any.

    shared: (src, dst) edges of every world; worlds: (sample_id, src, dst) edges of single ones. A row of the frontier
    stands for all worlds of a chunk of ``WORLD_BITS``, one bit each, so neither edges nor rows multiply by the samples.
    """
    back = _backwards(sources, targets)
    if back:
        sources, targets = targets, sources
    shared, worlds = _turned(shared, back), _turned(worlds, back)
    seen = world_bits(shared, worlds, sources, targets, samples, depth)
    hit = seen.where("node <> source").join(targets.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
    # a world's bit is new only once for a node, so bits add up over the rounds
    return hit.groupBy(*_ends(back)).agg(F.sum(F.bit_count("mask")).alias("hits"))


def world_paths(shared: DataFrame, worlds: DataFrame, sources: DataFrame, targets: DataFrame, samples: int, depth: int | None = 8) -> DataFrame:
    """(chunk, source, target, hops, mask, path): every pair's witness in every world where it is in reach; worlds of a chunk
    that have the same witness are bits of one row's mask.

    As in ``reach``, the witness has the fewest hops and of those sorts first: of the rows that come to a node in a round,
    each keeps the worlds that neither an earlier round nor a path before it in the order has taken.
    """
    back = _backwards(sources, targets)
    if back:
        sources, targets = targets, sources
    shared, worlds = _turned(shared, back), _turned(worlds, back)
    flat = shared.select("src", "dst").unionByName(worlds.select("src", "dst"))
    alive = useful(flat, targets, depth).withColumnRenamed("node", "dst")
    common = shared.select(F.col("src").alias("node"), "dst").distinct().join(alive, "dst", "left_semi").select("node", "dst", F.lit(-1).cast("long").alias("own"))
    every = shared.sparkSession.createDataFrame([(k, -1 if samples - k * WORLD_BITS >= WORLD_BITS else (1 << (samples - k * WORLD_BITS)) - 1) for k in range(-(-samples // WORLD_BITS))], "chunk int, mask long")
    bit = F.expr(f"shiftleft(1L, cast(sample_id % {WORLD_BITS} as int))")
    single = worlds.groupBy((F.floor(F.col("sample_id") / WORLD_BITS)).cast("int").alias("chunk"), F.col("src").alias("node"), "dst").agg(F.bit_or(bit).alias("own")).join(alive, "dst", "left_semi")
    both = common.crossJoin(F.broadcast(every.select("chunk"))).select("chunk", "node", "dst", "own").unionByName(single.select("chunk", "node", "dst", "own"))
    links = step(both.groupBy("chunk", "node", "dst").agg(F.bit_or("own").alias("own")))
    key = ["chunk", "source", "node"]
    start = sources.select(F.col("id").alias("source")).distinct().join(links.select(F.col("node").alias("source")).distinct(), "source", "left_semi").crossJoin(F.broadcast(every))
    front = step(start.select("chunk", "source", F.col("source").alias("node"), "mask", F.col("source").alias("path"), F.lit(0).alias("hops")))
    seen = front
    before = Window.partitionBy(*key).orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    for hop in _hops(depth):
        came = front.join(links, ["chunk", "node"]).select("chunk", "source", F.col("dst").alias("node"), F.col("mask").bitwiseAND(F.col("own")).alias("mask"), _longer(back).alias("path")).where("mask <> 0")
        held = seen.join(came.select(*key).distinct(), key, "left_semi").groupBy(*key).agg(F.bit_or("mask").alias("was"))
        rest = came.join(held, key, "left").withColumn("mask", F.expr("mask & ~coalesce(was, 0L)")).where("mask <> 0")
        first = rest.withColumn("taken", F.coalesce(F.bit_or("mask").over(before), F.lit(0))).withColumn("mask", F.expr("mask & ~taken")).where("mask <> 0")
        front, n = counted_step(first.select(*key, "mask", "path", F.lit(hop).alias("hops")))
        if not n:
            break
        seen = _grown(seen, front, hop)
    hit = seen.where("node <> source").join(targets.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
    return hit.select("chunk", *_ends(back), "hops", "mask", "path")


def path_edges(witnesses: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, target, pos, src, dst, relation, is_bridge): of parallel edges a bridge first, then the relation that sorts first."""
    n = F.split("path", ">")
    legs = witnesses.select("source", "target", F.posexplode(F.arrays_zip(F.slice(n, F.lit(1), F.size(n) - 1).alias("src"), F.slice(n, F.lit(2), F.size(n) - 1).alias("dst"))).alias("pos", "e")).select("source", "target", "pos", "e.src", "e.dst")
    best = edges.groupBy("src", "dst").agg(F.min(F.struct((~F.col("is_bridge")).alias("plain"), "relation")).alias("b")).select("src", "dst", F.col("b.relation").alias("relation"), (~F.col("b.plain")).alias("is_bridge"))
    return legs.join(best, ["src", "dst"])


def label_escalations(witnesses: DataFrame, edges: DataFrame, nodes: DataFrame, bridges_count: bool = True) -> DataFrame:
    """Witnesses with relations, is_bridge and is_escalation.

    A path escalates over a bridge, from a principal that isn't admin to an admin, or to a high-value node of another
    department (or SecOps) over a role taken on, a role passed or a bridge.
    """
    legs = path_edges(witnesses, edges).groupBy("source", "target").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "relation"))), lambda x: x["relation"]).alias("relations"), F.max("is_bridge").alias("is_bridge"))
    info = lambda end: nodes.select(F.col("id").alias(end), F.col("department").alias(f"{end}_department"), F.col("is_admin").alias(f"{end}_admin"), F.col("is_high_value").alias(f"{end}_high"))
    all_ = witnesses.join(legs, ["source", "target"]).join(info("source"), "source").join(info("target"), "target")
    taken = F.arrays_overlap("relations", F.array(F.lit("AssumesRole"), F.lit("PassesTo")))
    cross = ~F.col("source_department").eqNullSafe(F.col("target_department")) | F.coalesce(F.col("target_department") == "SecOps", F.lit(False))
    low = ~F.col("source_admin")
    up = (low & F.col("target_admin")) | (low & F.col("target_high") & cross & (taken | F.col("is_bridge") if bridges_count else taken))
    return all_.withColumn("is_escalation", (F.col("is_bridge") | up) if bridges_count else up)


def has_path(edges: DataFrame, pairs: DataFrame, world: list[str] = ()) -> DataFrame:
    """pairs (world..., source, target) that are connected, however long the path."""
    found = reach(edges, pairs.select(F.col("source").alias("id")), pairs.select(F.col("target").alias("id")), None, False, world)
    return found.join(pairs.select("source", "target").distinct(), ["source", "target"], "left_semi").select(*world, "source", "target")


def severed(witnesses: DataFrame, edges: DataFrame) -> DataFrame:
    """Witness pairs with whether they stay connected once all bridges are gone."""
    left = has_path(edges.where(~F.col("is_bridge")), witnesses.select("source", "target")).withColumn("still", F.lit(True))
    return witnesses.join(left, ["source", "target"], "left").withColumn("severed", F.col("still").isNull()).drop("still")


def _maybe_cyclic(edges: DataFrame, rounds: int) -> DataFrame:
    """(node): all nodes of cycles, and maybe others; ends of edges that nothing comes to or goes on from are taken off in rounds."""
    left, n = counted_step(edges)
    for _ in range(rounds):
        into, on = left.select(F.col("dst").alias("src")).distinct(), left.select(F.col("src").alias("dst")).distinct()
        was = n
        left, n = counted_step(left.join(into, "src", "left_semi").join(on, "dst", "left_semi").select("src", "dst"))
        if n in (0, was):
            break
    return step(left.select(F.explode(F.array("src", "dst")).alias("node")).distinct())


def simple_paths(edges: DataFrame, pairs: DataFrame, cutoff: int = 8, limit: int = 10) -> DataFrame:
    """(source, target, path, n_hops): simple paths within cutoff, the first ``limit`` by length and then by text.

    Ways are walked back from the targets. A node on no cycle can't be met again before it, so whatever comes before it goes
    with any way on from it, and the first ``limit`` of its ways to a target are all that are needed; other nodes keep all.
    """
    ends = [step(pairs.select(F.col(c).alias("id")).distinct()) for c in ("source", "target")]
    flat = step(edges.select("src", "dst").where("src <> dst").distinct())
    alive = useful(_turned(flat, True), ends[0], cutoff).withColumnRenamed("node", "src")
    pruned = step(flat.join(alive, "src", "left_semi").select("src", "dst"))
    cyclic = _maybe_cyclic(pruned, cutoff).withColumn("cyclic", F.lit(True))
    seen = front = step(ends[1].select(F.col("id").alias("target"), F.col("id").alias("node"), F.col("id").alias("path"), F.array("id").alias("p"), F.lit(0).alias("n_hops"), F.lit(True).alias("cyclic")))
    first = Window.partitionBy("target", "node").orderBy("path")
    for hop in _hops(cutoff):
        out = front.drop("cyclic").join(pruned.withColumnRenamed("dst", "node"), "node").where(~F.array_contains("p", F.col("src")))
        out = out.select("target", F.col("src").alias("node"), F.concat("src", F.lit(">"), "path").alias("path"), F.concat(F.array("src"), "p").alias("p"), F.lit(hop).alias("n_hops"))
        out = out.join(cyclic, "node", "left").withColumn("cyclic", F.coalesce("cyclic", F.lit(False))).select(*seen.columns)
        some = out.where("not cyclic").withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= limit)
        held = seen.where("not cyclic").groupBy("target", "node").agg(F.count("*").alias("_held"))
        some = some.join(held, ["target", "node"], "left").where(F.col("_r") + F.coalesce("_held", F.lit(0)) <= limit)
        front, n = counted_step(out.where("cyclic").unionByName(some.select(*seen.columns)))
        if not n:
            break
        seen = _grown(seen, front, hop)
    found = seen.where("n_hops > 0").withColumnRenamed("node", "source").join(pairs.select("source", "target").distinct(), ["source", "target"], "left_semi")
    best = Window.partitionBy("source", "target").orderBy("n_hops", "path")
    return found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= limit).select("source", "target", "path", "n_hops")


def ego(edges: DataFrame, centers: DataFrame, radius: int = 2, directed: bool = False) -> DataFrame:
    """(center, id, hops) within radius, whichever way edges point unless directed."""
    both = edges.select("src", "dst")
    if not directed:
        both = both.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = step(both.distinct())
    seen = front = step(centers.select(F.col("id").alias("center"), "id", F.lit(0).alias("hops")))
    for hop in range(1, radius + 1):
        new = front.join(both, F.col("id") == F.col("src")).select("center", F.col("dst").alias("id")).distinct().join(seen, ["center", "id"], "left_anti")
        front = step(new.withColumn("hops", F.lit(hop)))
        seen = seen.unionByName(front)
    return seen


def ego_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges of which both ends are members of a center's neighbourhood."""
    m = members.select("center", "id")
    return edges.join(m.select("center", F.col("id").alias("src")), "src").join(m.select("center", F.col("id").alias("dst")), ["center", "dst"], "left_semi")


def capped_ego(edges: DataFrame, centers: DataFrame, radius: int = 2, most: int = 30) -> DataFrame:
    """The forward neighbourhood for display: the nearest ``most`` nodes."""
    near = ego(edges, centers, radius, True)
    return near.withColumn("_r", F.row_number().over(Window.partitionBy("center").orderBy("hops", "id"))).where(F.col("_r") <= most).drop("_r")


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: share of the true (source, target) pairs that were found, 1 if there are none."""
    hit = truth.select("source", "target").join(found.select("source", "target", F.lit(1).alias("hit")).distinct(), ["source", "target"], "left")
    return hit.agg(F.count("*").alias("n_true"), F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0)).alias("recall"))


def step_scores(pairs: DataFrame, edges: DataFrame, steps: int = 6) -> DataFrame:
    """Score of each (source, target): 1 at one hop, 0.08 less for each more, 0.5 at least; 0 if out of reach."""
    got = reach(edges, pairs.select(F.col("source").alias("id")), pairs.select(F.col("target").alias("id")), steps)
    return pairs.join(got, ["source", "target"], "left").select("source", "target", "hops", F.when(F.col("hops").isNull(), 0.0).otherwise(F.greatest(F.lit(0.5), 1 - 0.08 * (F.col("hops") - 1))).alias("score"))

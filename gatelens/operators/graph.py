"""The graph as two tables, nodes and edges: upkeep, encodings, statistics and centrality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelens.functions.scalars import reversed_relation
from gatelens.plans.steps import counted_step, step

NODE_TYPES = ("User", "Role", "Policy", "Group", "Resource")
RELATIONS = ("MemberOf", "AssumesRole", "AttachedWith", "ActsOn", "PassesTo")
TRIPLE = ["src", "dst", "relation"]


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new replace those of old with the same key; of equal keys in new the largest ``seq`` stays, if there is one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    order = [F.desc("_new"), *([F.desc("seq")] if "seq" in both.columns else [])]
    return both.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r", "_new")


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends aren't both nodes."""
    ids = nodes.select("id")
    a = edges.join(ids, F.col("src") == F.col("id"), "left_anti")
    return a.unionByName(edges.join(ids, F.col("src") == F.col("id"), "left_semi").join(ids, F.col("dst") == F.col("id"), "left_anti"))


def add_edges(nodes: DataFrame, edges: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by triple; an end that is no node fails the job that uses the result."""
    n = nodes.select("id").distinct()
    ok = new.join(n.select(F.col("id").alias("_s")), F.col("src") == F.col("_s"), "left").join(n.select(F.col("id").alias("_d")), F.col("dst") == F.col("_d"), "left")
    checked = ok.withColumn("src", F.when(F.col("_s").isNotNull() & F.col("_d").isNotNull(), F.col("src")).otherwise(F.raise_error(F.concat(F.lit("no such node: "), "src", F.lit(" or "), "dst"))))
    return upsert(edges, checked.drop("_s", "_d"), TRIPLE)


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select(*TRIPLE).distinct(), TRIPLE, "left_anti")


def find_edges(edges: DataFrame, src: str | None = None, dst: str | None = None, relation: str | None = None, bridge: bool | None = None) -> DataFrame:
    for name, value in (("src", src), ("dst", dst), ("relation", relation), ("is_bridge", bridge)):
        if value is not None:
            edges = edges.where(F.col(name) == value)
    return edges


def find_nodes(nodes: DataFrame, id: str | None = None, arn: str | None = None, node_type: str | None = None, high_value: bool | None = None, admin: bool | None = None) -> DataFrame:
    for name, value in (("id", id), ("arn", arn), ("node_type", node_type), ("is_high_value", high_value), ("is_admin", admin)):
        if value is not None:
            nodes = nodes.where(F.col(name) == value)
    return nodes


def with_ends(edges: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """Edges with the ends' columns, named src_* and dst_*."""
    for end in ("src", "dst"):
        edges = edges.join(nodes.select(F.col("id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns]), end)
    return edges


def default_targets(nodes: DataFrame) -> DataFrame:
    return nodes.where("(is_high_value or is_admin) and node_type <> 'Policy'").select("id")


def default_sources(nodes: DataFrame) -> DataFrame:
    return nodes.where("node_type in ('User', 'Role')").select("id")


def dense_ids(nodes: DataFrame, order: str = "id") -> DataFrame:
    """Numbers from 0 within each node type: places among all nodes less the place of the type's first."""
    from gatelens.operators.vocabulary import numbered

    placed = step(numbered(nodes, "node_type", order))
    first = placed.groupBy("node_type").agg(F.min("idx").alias("_least"))
    return placed.join(F.broadcast(first), "node_type").withColumn("idx", (F.col("idx") - F.col("_least")).cast("int")).select(*nodes.columns, "idx")


def index_encoding(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src_type, relation, dst_type, src_idx, dst_idx, is_bridge) of every edge and of its reverse."""
    e = with_ends(edges, dense_ids(nodes), "node_type", "idx").select(F.col("src_node_type").alias("src_type"), "relation", F.col("dst_node_type").alias("dst_type"), F.col("src_idx"), F.col("dst_idx"), "is_bridge")
    back = e.select(F.col("dst_type").alias("src_type"), reversed_relation(F.col("relation")).alias("relation"), F.col("src_type").alias("dst_type"), F.col("dst_idx").alias("src_idx"), F.col("src_idx").alias("dst_idx"), "is_bridge")
    return e.unionByName(back)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree, degree); nodes without edges have 0."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    got = ends.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    o, i = F.coalesce("o", F.lit(0)), F.coalesce("i", F.lit(0))
    return nodes.select("id").join(got, "id", "left").select("id", o.alias("out_degree"), i.alias("in_degree"), (o + i).alias("degree"))


def relation_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """log1p of out and in degrees for each relation, in and out columns side by side."""
    out = edges.groupBy(F.col("src").alias("id")).pivot("relation", list(RELATIONS)).count()
    into = edges.groupBy(F.col("dst").alias("id")).pivot("relation", list(RELATIONS)).count()
    named = lambda df, way: df.select("id", *[F.col(r).alias(f"{way}_{r}") for r in RELATIONS])
    wide = nodes.select("id").join(named(out, "out"), "id", "left").join(named(into, "in"), "id", "left")
    return wide.select("id", *[F.log1p(F.coalesce(c, F.lit(0))).alias(c) for c in wide.columns if c != "id"])


def spread(df: DataFrame, value: str, by: list[Column | str]) -> DataFrame:
    """min, max, mean, median and sample deviation (0 for one value), rounded to 3 places."""
    v = F.col(value)
    return df.groupBy(*by).agg(
        F.min(v).cast("double").alias("min"), F.max(v).cast("double").alias("max"), F.round(F.avg(v), 3).alias("mean"), F.round(F.percentile(v, 0.5), 3).alias("median"), F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0)), 3).alias("std")
    )


def degree_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    d = degrees(nodes, edges)
    long = d.select(F.explode(F.map_from_arrays(F.array(F.lit("in"), F.lit("out"), F.lit("all")), F.array("in_degree", "out_degree", "degree"))).alias("kind", "v"))
    return spread(long, "v", ["kind"])


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id that a node reaches whichever way edges point, however many rounds that takes."""
    both = step(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = step(nodes.select("id", F.col("id").alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("m"))
        hooked = labels.join(near, "id", "left").select("id", F.col("component").alias("was"), F.least("component", F.coalesce("m", "component")).alias("component"))
        far = labels.select(F.col("id").alias("component"), F.col("component").alias("far"))
        new = step(hooked.join(far, "component").select("id", "was", F.least("component", "far").alias("component")))
        labels = new.select("id", "component")
        if new.where("was <> component").isEmpty():
            return labels


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the largest id of those that reach each other, by colouring.

    Nodes without an edge in, or without one out, among those left are components of their own and are trimmed first.
    Then the largest id that reaches a node colours it; what the colour's root reaches back inside the colour is its
    component. Settled nodes leave, and the rest is trimmed and coloured anew, until none is left.
    """
    left, links, done, turn = step(nodes.select("id").distinct()), step(edges.select("src", "dst").where("src <> dst").distinct()), [], 0
    while True:
        while True:
            inner = links.select(F.col("src").alias("id")).intersect(links.select(F.col("dst").alias("id")))
            alone, n = counted_step(left.join(inner, "id", "left_anti"))
            if not n:
                break
            done.append(alone.select("id", F.col("id").alias("component")))
            left, links = _without(left, links, alone)
            turn += 1
            done = [step(_union(done))] if turn % 16 == 0 else done
        if left.isEmpty():
            return _union(done) if done else left.select("id", F.col("id").alias("component"))
        colour = left.select("id", F.col("id").alias("colour"))
        while True:  # colours only grow, so this ends; a colour may need as many rounds as there are nodes
            came = links.join(colour.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("colour").alias("m"))
            new = step(colour.join(came, "id", "left").select("id", F.greatest("colour", F.coalesce("m", "colour")).alias("colour"), F.col("colour").alias("was")))
            colour = new.select("id", "colour")
            if new.where("colour <> was").isEmpty():
                break
        inner = step(links.join(colour.select(F.col("id").alias("src"), F.col("colour").alias("a")), "src").join(colour.select(F.col("id").alias("dst"), F.col("colour").alias("b")), "dst").where("a = b").select("src", "dst"))
        found = front = step(colour.where("id = colour"))
        n = 1
        while n:
            back = inner.join(front.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), "colour").distinct()
            front, n = counted_step(back.join(found.select("id"), "id", "left_anti"))
            turn += 1
            found = found.unionByName(front)
            found = step(found) if turn % 16 == 0 else found
        settled = step(found.select("id", F.col("colour").alias("component")))
        done.append(settled)
        left, links = _without(left, links, settled)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _without(nodes: DataFrame, links: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left of nodes and links once some nodes are gone."""
    away = gone.select("id")
    stay = links.join(away, F.col("src") == F.col("id"), "left_anti").join(away, F.col("dst") == F.col("id"), "left_anti")
    return step(nodes.join(away, "id", "left_anti")), step(stay)


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 100, alpha: float = 0.85, tolerance: float = 1e-5) -> DataFrame:
    """(id, rank) once the ranks change by less than ``tolerance`` a node in sum, or after ``rounds``.

    Parallel edges weigh more, and rank at dead ends is spread over all.
    """
    n = nodes.count()
    out = edges.groupBy("src").agg(F.count("*").alias("w"))
    links = step(edges.groupBy("src", "dst").agg(F.count("*").alias("c")).join(out, "src").select("src", "dst", (F.col("c") / F.col("w")).alias("share")))
    ranks = step(nodes.select("id", F.lit(1.0 / max(n, 1)).alias("rank")).join(links.select(F.col("src").alias("id"), F.lit(True).alias("leads")).distinct(), "id", "left"))
    dead = F.sum(F.when(F.col("leads").isNull(), F.col("rank")))
    lost = ranks.agg(F.coalesce(dead, F.lit(0.0)).alias("lost")).collect()[0]["lost"]
    for _ in range(rounds):
        came = links.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("share") * F.col("rank")).alias("came"))
        base = F.lit((1 - alpha) / n + alpha * lost / n)
        new = step(ranks.withColumnRenamed("rank", "was").join(came, "id", "left").select("id", "leads", "was", (base + alpha * F.coalesce("came", F.lit(0.0))).alias("rank")))
        end = new.agg(F.sum(F.abs(F.col("rank") - F.col("was"))).alias("moved"), F.coalesce(dead, F.lit(0.0)).alias("lost")).collect()[0]
        ranks, lost = new.select("id", "leads", "rank"), end["lost"]
        if end["moved"] is None or end["moved"] < n * tolerance:
            break
    return ranks.select("id", "rank")


def shape(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: density, reciprocity, transitivity and average clustering of the simple graph without directions."""
    simple = edges.select("src", "dst").where("src <> dst").distinct()
    pairs = step(simple.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    # edges point to the end of more neighbours, so a hub opens few wedges
    size = step(pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("k")))
    sized = pairs.join(size.select(F.col("id").alias("a"), F.col("k").alias("ka")), "a").join(size.select(F.col("id").alias("b"), F.col("k").alias("kb")), "b")
    up = F.struct("ka", "a") < F.struct("kb", "b")
    pairs = step(sized.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("b")))
    ab, bc, ac = (pairs.select(F.col("a").alias(x), F.col("b").alias(y)) for x, y in (("x", "y"), ("y", "z"), ("x", "z")))
    triangles = ab.join(bc, "y").join(ac, ["x", "z"])
    at = triangles.select(F.explode(F.array("x", "y", "z")).alias("id")).groupBy("id").agg(F.count("*").alias("t"))
    deg = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("k"))
    local = nodes.select("id").join(deg, "id", "left").join(at, "id", "left").select(F.coalesce("k", F.lit(0)).alias("k"), F.coalesce("t", F.lit(0)).alias("t"))
    wedges = F.col("k") * (F.col("k") - 1) / 2
    total = local.agg(F.sum(wedges).alias("w"), F.sum("t").alias("t"), F.avg(F.when(F.col("k") > 1, F.col("t") / wedges).otherwise(0.0)).alias("clustering"), F.count("*").alias("n"))
    back = simple.join(simple.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi").agg(F.count("*").alias("m2"))
    m = simple.agg(F.count("*").alias("m"))
    return total.crossJoin(m).crossJoin(back).select(
        F.round(F.when(F.col("n") > 1, F.col("m") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0), 9).alias("density"), F.round(F.when(F.col("m") > 0, F.col("m2") / F.col("m")).otherwise(0.0), 6).alias("reciprocity"),
        F.round(F.when(F.col("w") > 0, F.col("t") / F.col("w")).otherwise(0.0), 6).alias("transitivity"), F.round("clustering", 6).alias("clustering"),
    )


def health(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts, shares and warnings."""
    d = degrees(nodes, edges)
    parts = weak_components(nodes, edges).groupBy("component").agg(F.count("*").alias("n")).agg(F.count("*").alias("components"), F.max("n").alias("giant"))
    n = nodes.agg(F.count("*").alias("nodes"), F.count_if("is_admin").alias("admins"), F.count_if("is_high_value").alias("high_value"), F.count_if(F.col("node_type").isin("User", "Role")).alias("principals"))
    e = edges.agg(F.count("*").alias("edges"), F.count_if("is_bridge").alias("bridges"))
    row = n.crossJoin(e).crossJoin(d.agg(F.count_if(F.col("degree") == 0).alias("isolated"))).crossJoin(parts)
    warn = lambda bad, name: F.when(bad, F.lit(name))
    warnings = F.array_compact(F.array(
        warn(F.col("nodes") == 0, "no_nodes"), warn(F.col("edges") == 0, "no_edges"), warn(F.col("isolated") > 0.1 * F.col("nodes"), "isolated"),
        warn((F.col("nodes") >= 100) & (F.col("giant") < 0.7 * F.col("nodes")), "giant_component"), warn(F.col("admins") > 0.25 * F.col("principals"), "admins"), warn(F.col("high_value") == 0, "no_high_value"),
    ))
    return row.select(*row.columns, F.array_join(warnings, ",").alias("warnings"))

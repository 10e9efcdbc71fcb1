"""The trainer's gradients against numerical differences of a plain forward pass, and what a run does."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatelens.operators import training as t

EDGES = [("u0", "g0", "MemberOf"), ("u1", "g0", "MemberOf"), ("u2", "g1", "MemberOf"), ("u0", "r0", "AssumesRole"), ("u2", "r1", "AssumesRole"), ("r0", "r1", "PassesTo"), ("r0", "r1", "AssumesRole"), ("g1", "g1", "MemberOf")]
NODES = ["u0", "u1", "u2", "g0", "g1", "r0", "r1", "alone"]
PAIRS = [("u0", "r1", "AssumesRole", 1, "train"), ("u1", "r0", "AssumesRole", 0, "train"), ("u1", "g1", "MemberOf", 0, "train"), ("u2", "g0", "MemberOf", 1, "train"), ("alone", "g0", "MemberOf", 0, "train"), ("u0", "g1", "MemberOf", 1, "val"), ("u1", "r1", "AssumesRole", 0, "val")]


def plain_loss(w, x, edges, pairs, config, decoded):
    """Mean focal loss of the train pairs by loops over nodes and edges."""
    names = t.ways(config.typed)
    both = {(a, b, r) for a, b, r in edges} | {(b, a, f"Rev{r}") for a, b, r in edges}
    h = {k: np.array(v, float) for k, v in x.items()}
    for layer in (1, 2):
        new = {}
        for node in h:
            a = h[node] @ w[f"own{layer}"] + w[f"bias{layer}"]
            for i, name in enumerate(names):
                sources = sorted(s for s, d, r in both if d == node and r in (name, *(() if config.typed else (r,))))
                if sources:
                    a = a + np.mean([h[s] for s in sources], axis=0) @ np.tensordot(w[f"mix{layer}"][i], w[f"base{layer}"], 1)
            a = a + h[node] if layer == 2 else a
            a = (a - a.mean()) / np.sqrt(a.var() + t.EPSILON) * w[f"gain{layer}"] + w[f"shift{layer}"]
            new[node] = np.where(a > 0, a, t.SLOPE * a)
        h = new
    losses = []
    for u, v, relation, y, part in pairs:
        if part == "train":
            k = decoded.index(relation)
            m = np.diag(w["diagonal"][k]) if "diagonal" in w else w["matrix"][k] if "matrix" in w else sum(c * f for c, f in zip(w["form_mix"][k], w["forms"], strict=True))
            p = 1 / (1 + np.exp(-(h[u] @ m @ h[v] + w["offset"][k])))
            p, at = (p, config.alpha) if y else (1 - p, 1 - config.alpha)
            losses.append(-at * (1 - p) ** config.gamma * np.log(p))
    return np.mean(losses)


@pytest.fixture(scope="module")
def small(spark):
    draw = np.random.default_rng(1)
    x = {n: draw.standard_normal(3) for n in NODES}
    edges = spark.createDataFrame(EDGES, "src string, dst string, relation string")
    features = spark.createDataFrame([(k, [float(a) for a in v]) for k, v in x.items()], "id string, x array<double>")
    return x, edges, features, spark.createDataFrame(PAIRS, "u string, v string, relation string, y int, part string")


@pytest.mark.parametrize(("form", "typed"), [("distmult", True), ("bilinear", False), ("basis", True)])
def test_gradients_are_numerical_differences(small, form, typed):
    x, edges, features, pairs = small
    config = t.Config(dim=4, bases=2, form=form, typed=typed)
    if not typed:  # of parallel edges, each is a message
        edges = edges.where("not (src = 'r0' and relation = 'AssumesRole')")
    plain_edges = [e for e in EDGES if typed or e[::2] != ("r0", "AssumesRole")]
    graph = t.Graph.of(edges, features, config)
    model = t.fresh(config, graph.width, ["AssumesRole", "MemberOf"])
    loss, g, scored = t.gradients(graph, pairs, model)
    at = lambda w: plain_loss(w, x, plain_edges, PAIRS, config, model.decoded)
    assert loss == pytest.approx(at(model.weights), rel=1e-9)
    assert scored.count() == len(PAIRS)
    assert set(g) == set(model.weights)
    for name, value in model.weights.items():
        for place in np.ndindex(value.shape):
            ends = []
            for way in (1e-5, -1e-5):
                moved = value.copy()
                moved[place] += way
                ends.append(at(model.weights | {name: moved}))
            assert g[name][place] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=1e-4, abs=1e-8), (name, place)


def test_a_run_learns_keeps_the_best_and_stops(small):
    _, edges, features, pairs = small
    config = t.Config(dim=4, bases=2, rate=0.05, epochs=6, patience=2)
    graph = t.Graph.of(edges, features, config)
    model = t.fit(graph, pairs, config)
    losses, held = [h["loss"] for h in model.history], [h["val_pr_auc"] for h in model.history]
    assert losses[min(2, len(losses) - 1)] < losses[0]
    best = held.index(max(held))
    assert len(held) <= 6 and len(held) - 1 - best <= config.patience
    assert [h["rate"] for h in model.history] == sorted((h["rate"] for h in model.history), reverse=True)
    out = t.score(graph, pairs.select("u", "v", "relation", "y"), model).collect()
    assert len(out) == len(PAIRS) and all(np.isfinite(r["logit"]) for r in out)


def test_adamw_decays_apart_from_the_gradient():
    o = t.AdamW(0.1)
    w = o.step({"a": np.array([2.0, -1.0])}, {"a": np.array([0.5, 0.0])}, 0.01)
    assert w["a"] == pytest.approx([2.0 - 0.01 * (0.2 + 1.0), -1.0 + 0.01 * 0.1], rel=1e-6)
    assert np.sqrt(sum((x**2).sum() for x in t.clipped({"a": np.array([3.0]), "b": np.array([4.0])}, 1.0).values())) == pytest.approx(1.0, rel=1e-5)
    with pytest.raises(ValueError, match="form"):
        t.Config(form="other")


def test_a_link_task_hides_what_it_asks(spark):
    edges = spark.range(400).select(F.concat(F.lit("u"), (F.col("id") % 80).cast("string")).alias("src"), F.concat(F.lit("g"), (F.col("id") % 9).cast("string")).alias("dst"), F.lit("MemberOf").alias("relation")).distinct()
    ids = edges.select(F.col("src").alias("id"), F.lit("User").alias("node_type")).unionByName(edges.select(F.col("dst").alias("id"), F.lit("Group").alias("node_type"))).distinct()
    pairs, seen = t.link_task(edges, ids)
    asked = pairs.where("y = 1").select(F.col("u").alias("src"), F.col("v").alias("dst"), "relation")
    assert asked.join(seen, ["src", "dst", "relation"]).isEmpty()
    assert asked.unionByName(seen.select(asked.columns)).exceptAll(edges).isEmpty()
    wrong = pairs.where("y = 0").select(F.col("u").alias("src"), F.col("v").alias("dst"), "relation")
    assert wrong.join(edges, ["src", "dst", "relation"]).isEmpty()
    assert wrong.where("dst not like 'g%'").isEmpty() and not wrong.isEmpty()
    assert {r["part"] for r in pairs.select("part").distinct().collect()} == {"train", "val", "test"}

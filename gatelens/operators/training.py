"""Training of the relational graph encoder and its decoder, full batch, over tables.

Nodes, edges and pairs stay tables through the whole of an epoch; nodes go by numbers. The first layer's messages are means
of features, which no weight changes, and are made once: a node's own features and means are one sparse row, as most
relations don't come to a node and most features are 0. For the second layer a node sends one message for each relation
that it is a source in, already multiplied by the relation's matrix, so that a target's messages, its own code's among
them, are one sum, combined before the shuffle; so a hub is no burden to one task. The backward pass is the same join the
other way: a pair's gradient goes through its ends' activations, is summed by node and by (source, relation) along the edges,
weighted by what the source had in the mean, and both layers' gradients are made in one pass over the nodes, in Arrow
batches. Gradients of the weights are summed by position, with partial sums in each task, so the driver sees one number for
each weight and epoch, however many nodes there are. It holds the weights and takes the AdamW step: decoupled decay, clipped
norm, a cosine schedule, and an early stop by the average precision of held-out pairs.

Layer: ``leaky(norm(own W + sum over relations of mean W_r + residual))``, W_r made of shared bases. Decoder forms:
``distmult`` (a diagonal for each relation), ``bilinear`` (a full matrix) and ``basis`` (a mixture of shared matrices).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelens.functions import metrics
from gatelens.functions.scalars import uniform
from gatelens.operators.graph import RELATIONS, dense_ids
from gatelens.plans.steps import discard, step

SLOPE, EPSILON = 0.2, 1e-5
FORMS = ("distmult", "bilinear", "basis")


@dataclass
class Config:
    """What is trained and how; the defaults are those of a full run."""

    dim: int = 16
    bases: int = 4
    form: str = "distmult"
    typed: bool = True
    rate: float = 1e-3
    least_rate: float = 1e-5
    decay: float = 0.01
    epochs: int = 50
    patience: int = 10
    gamma: float = 2.0
    alpha: float = 0.25
    clip: float = 1.0
    seed: int = 7

    def __post_init__(self):
        if self.form not in FORMS:
            raise ValueError(f"form must be one of {', '.join(FORMS)}")
        if min(self.rate, self.epochs, self.patience, self.dim, self.bases) <= 0:
            raise ValueError("rate, epochs, patience, dim and bases must be positive")


@dataclass
class Model:
    """Weights by name, and what they are for."""

    config: Config
    relations: list[str]
    decoded: list[str]
    width: int
    weights: dict[str, np.ndarray]
    history: list[dict] = field(default_factory=list)


# --- weights ---------------------------------------------------------------------


def ways(typed: bool) -> list[str]:
    """Kinds of messages: each relation, forth and back, or one kind for all."""
    return [r for name in RELATIONS for r in (name, f"Rev{name}")] if typed else ["any"]


def fresh(config: Config, width: int, decoded: list[str]) -> Model:
    draw, relations, d = np.random.default_rng(config.seed), ways(config.typed), config.dim
    w = {}
    for layer, fan in ((1, width), (2, d)):
        w[f"own{layer}"] = draw.standard_normal((fan, d)) / np.sqrt(fan)
        w[f"base{layer}"] = draw.standard_normal((config.bases, fan, d)) / np.sqrt(fan)
        w[f"mix{layer}"] = draw.standard_normal((len(relations), config.bases)) / np.sqrt(config.bases)
        w[f"bias{layer}"], w[f"gain{layer}"], w[f"shift{layer}"] = np.zeros(d), np.ones(d), np.zeros(d)
    if config.form == "distmult":
        w["diagonal"] = 1 / np.sqrt(d) + 0.1 * draw.standard_normal((len(decoded), d))
    elif config.form == "bilinear":
        w["matrix"] = np.eye(d) / np.sqrt(d) + 0.1 * draw.standard_normal((len(decoded), d, d))
    else:
        w["forms"] = np.eye(d) / np.sqrt(d) + 0.1 * draw.standard_normal((config.bases, d, d))
        w["form_mix"] = np.full((len(decoded), config.bases), 1 / config.bases) + 0.1 * draw.standard_normal((len(decoded), config.bases))
    w["offset"] = np.zeros(len(decoded))
    return Model(config, relations, decoded, width, w)


def stacked(w: dict[str, np.ndarray], layer: int) -> np.ndarray:
    """One matrix for a row that has a node's own code and then a mean for each relation."""
    return np.concatenate([w[f"own{layer}"], *np.tensordot(w[f"mix{layer}"], w[f"base{layer}"], 1)])


def unstacked(w: dict[str, np.ndarray], layer: int, g: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of a layer's weights from that of the stacked matrix."""
    fan = len(w[f"own{layer}"])
    each = g[fan:].reshape(len(w[f"mix{layer}"]), fan, -1)
    return {f"own{layer}": g[:fan], f"mix{layer}": np.einsum("rfd,bfd->rb", each, w[f"base{layer}"]), f"base{layer}": np.einsum("rfd,rb->bfd", each, w[f"mix{layer}"])}


def forms(w: dict[str, np.ndarray]) -> np.ndarray:
    """The decoder's matrix for each relation."""
    if "diagonal" in w:
        return w["diagonal"][:, :, None] * np.eye(w["diagonal"].shape[1])
    return w["matrix"] if "matrix" in w else np.tensordot(w["form_mix"], w["forms"], 1)


def form_gradients(w: dict[str, np.ndarray], g: np.ndarray) -> dict[str, np.ndarray]:
    if "diagonal" in w:
        return {"diagonal": np.einsum("rii->ri", g)}
    return {"matrix": g} if "matrix" in w else {"form_mix": np.einsum("rij,bij->rb", g, w["forms"]), "forms": np.einsum("rij,rb->bij", g, w["form_mix"])}


# --- one layer on a batch --------------------------------------------------------


def activated(a: np.ndarray, gain: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Codes of rows of sums, and what the way back needs."""
    centred = a - a.mean(axis=1, keepdims=True)
    scale = 1 / np.sqrt((centred**2).mean(axis=1, keepdims=True) + EPSILON)
    normal = centred * scale
    n = normal * gain + shift
    return np.where(n > 0, n, SLOPE * n), (normal, scale, n)


def activated_back(g: np.ndarray, gain: np.ndarray, kept: tuple) -> tuple[np.ndarray, list[np.ndarray]]:
    """Gradients of the sums, and of bias, gain and shift."""
    normal, scale, n = kept
    g = np.where(n > 0, g, SLOPE * g)
    scaled = g * gain
    a = scale * (scaled - scaled.mean(axis=1, keepdims=True) - normal * (scaled * normal).mean(axis=1, keepdims=True))
    return a, [a.sum(axis=0), (g * normal).sum(axis=0), g.sum(axis=0)]


@dataclass
class Sparse:
    """Rows of a matrix that is mostly 0: places and values, one row's after another's, and how many each has."""

    place: np.ndarray
    value: np.ndarray
    length: np.ndarray

    def times(self, matrix: np.ndarray) -> np.ndarray:
        out, full = np.zeros((len(self.length), matrix.shape[1])), self.length > 0
        if len(self.place):
            out[full] = np.add.reduceat(matrix[self.place] * self.value[:, None], (np.cumsum(self.length) - self.length)[full])
        return out

    def turned_times(self, a: np.ndarray, height: int) -> np.ndarray:
        """The transposed matrix, of so many rows, times ``a``."""
        each = a[np.repeat(np.arange(len(a)), self.length)] * self.value[:, None]
        return np.stack([np.bincount(self.place, each[:, c], height) for c in range(a.shape[1])], axis=1)


def focal(logit: np.ndarray, y: np.ndarray, gamma: float, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Losses, and their derivatives by the logits."""
    sign = 2 * y - 1
    log_p = -np.logaddexp(0, -sign * logit)
    p = np.exp(log_p)
    at = np.where(y == 1, alpha, 1 - alpha)
    return -at * (1 - p) ** gamma * log_p, at * sign * (1 - p) ** gamma * (gamma * p * log_p - (1 - p))


# --- tables ----------------------------------------------------------------------


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def arrays(m: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), m.shape[1]).cast(pa.list_(pa.float64()))


def lengths(column: pa.Array) -> np.ndarray:
    return np.diff(column.offsets.to_numpy())


def sparse_of(batch: pa.RecordBatch) -> Sparse:
    return Sparse(batch.column("k").flatten().to_numpy(), batch.column("v").flatten().to_numpy(), lengths(batch.column("k")))


def added(column: Column, width: int) -> list[Column]:
    """Sums of a column of arrays, place by place."""
    return [F.sum(column[i]).alias(f"_{i}") for i in range(width)]


def side_by_side(width: int) -> Column:
    return F.array(*[F.col(f"_{i}") for i in range(width)])


def both_ways(edges: DataFrame, ids: DataFrame, typed: bool) -> DataFrame:
    """(src, dst, way, share) by the numbers of ids(id, n): messages of distinct edges, forth and back, with the source's share
    in the target's mean, and in way 0 those of each node to itself."""
    end = lambda c: ids.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"))
    forth = edges.select("src", "dst", "relation").distinct().join(end("src"), "src").join(end("dst"), "dst").select(F.col("n_src").alias("src"), F.col("n_dst").alias("dst"), "relation")
    every = forth.unionByName(forth.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.concat(F.lit("Rev"), "relation").alias("relation")))
    way = F.array_position(F.array(*map(F.lit, ways(typed))), F.col("relation") if typed else F.lit("any"))
    known = step(every.select("src", "dst", way.cast("int").alias("way")).where("way > 0"))
    met = known.join(known.groupBy("dst", "way").agg((1 / F.count("*")).alias("share")), ["dst", "way"])
    return step(met.select("src", "dst", "way", "share").unionByName(ids.select(F.col("n").alias("src"), F.col("n").alias("dst"), F.lit(0).alias("way"), F.lit(1.0).alias("share"))))


def first_rows(features: DataFrame, edges: DataFrame, width: int) -> DataFrame:
    """(n, k, v, out): of features(n, x), a node's own and then each way's mean, places and values of what isn't 0, and the ways it sends in."""
    some = features.select(F.col("n").alias("src"), F.filter(F.transform("x", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda e: e["x"] != 0).alias("e"))
    each = edges.join(some, "src").select(F.col("dst").alias("n"), "way", "share", F.explode("e").alias("e"))
    means = each.groupBy("n", (F.col("way") * width + F.col("e.i")).alias("k")).agg((F.sum("e.x") * F.max("share")).alias("v"))
    rows = means.groupBy("n").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("e"))
    out = edges.groupBy(F.col("src").alias("n")).agg(F.sort_array(F.collect_set("way")).alias("out"))
    nothing = lambda c, kind: F.coalesce(F.col(f"e.{c}"), F.expr(f"cast(array() as array<{kind}>)")).alias(c)
    return out.join(rows, "n", "left").select("n", nothing("k", "int"), nothing("v", "double"), "out")


def way_matrices(w: dict[str, np.ndarray]) -> np.ndarray:
    """The second layer's matrix for each way, own and residual first."""
    d = len(w["own2"])
    return stacked(w, 2).reshape(-1, d, d) + np.concatenate([np.eye(d)[None], np.zeros((len(w["mix2"]), d, d))])


def sending(w: dict[str, np.ndarray]) -> Callable:
    """(src, way, m) of first_rows: what each node sends in each of its ways."""
    first, rest, every = stacked(w, 1), [w[f"{x}1"] for x in ("gain", "shift")], way_matrices(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, _ = activated(sparse_of(b).times(first) + w["bias1"], *rest)
            way, row = b.column("out").flatten().to_numpy(), np.repeat(np.arange(len(h)), lengths(b.column("out")))
            m = np.empty((len(way), h.shape[1]))
            for k in np.unique(way):
                m[way == k] = h[row[way == k]] @ every[k]
            yield pa.RecordBatch.from_arrays([b.column("n").take(pa.array(row)), pa.array(way), arrays(m)], names=["src", "way", "m"])

    return run


def receiving(w: dict[str, np.ndarray]) -> Callable:
    """(g): for each task the gradients of the first layer's weights and of the second's matrices, of first_rows with
    back(way, q), the gradients of what the node sent."""
    first, rest, every = stacked(w, 1), [w[f"{x}1"] for x in ("gain", "shift")], way_matrices(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            rows = sparse_of(b)
            h, kept = activated(rows.times(first) + w["bias1"], *rest)
            back = b.column("back")
            way, row = back.flatten().field("way").to_numpy(), np.repeat(np.arange(len(h)), lengths(back))
            q, g, second = matrix_of(back.flatten().field("q"), h.shape[1]), np.zeros_like(h), np.zeros_like(every)
            for k in np.unique(way):
                r = row[way == k]  # a node has at most one row in each way
                g[r] += q[way == k] @ every[k].T
                second[k] = h[r].T @ q[way == k]
            a, own = activated_back(g, rest[0], kept)
            found = np.concatenate([x.ravel() for x in (rows.turned_times(a, len(first)), *own, second)])
            total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([arrays(total[None])], names=["g"])

    return run


def pair_map(w: dict[str, np.ndarray], gamma: float, alpha: float) -> Callable:
    """(n, g, y, score, part, u, v) of (au, av, which, y, part, u, v): for pairs in part "train" the gradients of the ends'
    sums and, without n, those of the decoder and of the second layer's bias, gain and shift, with loss and count; for
    all pairs their logits."""
    matrices, offset, bias, rest = forms(w), w["offset"], w["bias2"], [w[f"{x}2"] for x in ("gain", "shift")]
    d = matrices.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(matrices.size + len(offset) + 3 * d + 2)
        none = pa.nulls
        for b in batches:
            (zu, ku), (zv, kv) = (activated(matrix_of(b.column(c), d) + bias, *rest) for c in ("au", "av"))
            which, y, part = b.column("which").to_numpy(), b.column("y").to_numpy(), b.column("part")
            right, left = np.empty_like(zv), np.empty_like(zu)
            for k in np.unique(which):
                right[which == k], left[which == k] = zv[which == k] @ matrices[k].T, zu[which == k] @ matrices[k]
            logit = np.einsum("ni,ni->n", zu, right) + offset[which]
            n = len(y)
            yield pa.RecordBatch.from_arrays([none(n, pa.int64()), none(n, pa.list_(pa.float64())), pa.array(y, pa.int32()), pa.array(logit), part, b.column("u"), b.column("v")], names=NAMES)
            t = np.flatnonzero(pa.compute.equal(part, "train").to_numpy(zero_copy_only=False))
            if not len(t):
                continue
            loss, slope = focal(logit[t], y[t], gamma, alpha)
            (gu, own_u), (gv, own_v) = (activated_back(slope[:, None] * z[t], rest[0], tuple(x[t] for x in kept)) for z, kept in ((right, ku), (left, kv)))
            gm = np.zeros_like(matrices)
            for k in np.unique(which[t]):
                at = which[t] == k
                gm[k] = (slope[at, None] * zu[t][at]).T @ zv[t][at]
            total += np.concatenate([gm.ravel(), np.bincount(which[t], slope, len(offset)), *(x + z for x, z in zip(own_u, own_v, strict=True)), [loss.sum(), len(t)]])
            ids = pa.concat_arrays([b.column("u").take(pa.array(t)), b.column("v").take(pa.array(t))])
            k = len(ids)
            yield pa.RecordBatch.from_arrays([ids, arrays(np.concatenate([gu, gv])), none(k, pa.int32()), none(k, pa.float64()), none(k, pa.string()), none(k, pa.int64()), none(k, pa.int64())], names=NAMES)
        yield pa.RecordBatch.from_arrays([none(1, pa.int64()), arrays(total[None]), none(1, pa.int32()), none(1, pa.float64()), none(1, pa.string()), none(1, pa.int64()), none(1, pa.int64())], names=NAMES)

    return run


NAMES = ["n", "g", "y", "score", "part", "u", "v"]
SCORED = "n long, g array<double>, y int, score double, part string, u long, v long"


def with_ends(pairs: DataFrame, sums: DataFrame) -> DataFrame:
    end = lambda c: sums.select(F.col("n").alias(c), F.col("a").alias(f"a{c}"))
    return pairs.join(end("u"), "u").join(end("v"), "v").select("u", "v", "au", "av", "which", "y", "part")


@dataclass
class Graph:
    """What no weight changes: nodes' numbers, edges both ways, and each node's features with the means of its sources' features."""

    ids: DataFrame
    edges: DataFrame
    first: DataFrame
    width: int

    @classmethod
    def of(cls, edges: DataFrame, features: DataFrame, config: Config) -> Graph:
        """edges(src, dst, relation) and features(id, x), all x of one length."""
        known = step(features.select("id", "x", F.monotonically_increasing_id().alias("n")))
        ids, width = known.select("id", "n"), len(known.select("x").first()["x"])
        sent = both_ways(edges, ids, config.typed)
        return cls(ids, sent, step(first_rows(known, sent, width)), width)

    def numbered(self, pairs: DataFrame, decoded: list[str]) -> DataFrame:
        """(u, v, which, y, part) of pairs(u, v, relation, y, part), ends by number and relations by place."""
        end = lambda c: self.ids.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"))
        which = (F.array_position(F.array(*map(F.lit, decoded)), F.col("relation")) - 1).cast("int")
        return pairs.withColumn("which", which).where("which >= 0").join(end("u"), "u").join(end("v"), "v").select(F.col("n_u").alias("u"), F.col("n_v").alias("v"), "which", "y", "part")

    def named(self, scored: DataFrame) -> DataFrame:
        """Scored pairs with their ends' ids instead of numbers."""
        end = lambda c: self.ids.select(F.col("id").alias(f"id_{c}"), F.col("n").alias(c))
        return scored.join(end("u"), "u").join(end("v"), "v").select(F.col("id_u").alias("u"), F.col("id_v").alias("v"), "y", "part", "score")


def second_sums(graph: Graph, model: Model) -> DataFrame:
    """(n, a): what comes to each node in the second layer, before bias and activation."""
    d = model.config.dim
    sent = graph.first.mapInArrow(sending(model.weights), "src long, way int, m array<double>")
    came = graph.edges.join(sent, ["src", "way"]).select(F.col("dst").alias("n"), F.transform("m", lambda x: x * F.col("share")).alias("m"))
    return step(came.groupBy("n").agg(*added(F.col("m"), d)).select("n", side_by_side(d).alias("a")))


def codes(graph: Graph, model: Model) -> DataFrame:
    """(id, x): the encoder's codes."""
    w, d = model.weights, model.config.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, _ = activated(matrix_of(b.column("a"), d) + w["bias2"], w["gain2"], w["shift2"])
            yield pa.RecordBatch.from_arrays([b.column("id"), arrays(out)], names=["id", "x"])

    return second_sums(graph, model).join(graph.ids, "n").select("id", "a").mapInArrow(run, "id string, x array<double>")


def gradients(graph: Graph, pairs: DataFrame, model: Model) -> tuple[float, dict[str, np.ndarray], DataFrame]:
    """Mean loss of the pairs in part "train", its gradient by each weight, and all pairs' (u, v, y, part, score).

    pairs: (u, v, relation, y, part).
    """
    loss, g, scored = numbered_gradients(graph, graph.numbered(pairs, model.decoded), model)
    return loss, g, graph.named(scored)


def numbered_gradients(graph: Graph, pairs: DataFrame, model: Model) -> tuple[float, dict[str, np.ndarray], DataFrame]:
    """The same of pairs as ``Graph.numbered`` gives them; scored pairs keep their numbers."""
    c, w, d = model.config, model.weights, model.config.dim
    scored = step(with_ends(pairs, second_sums(graph, model)).mapInArrow(pair_map(w, c.gamma, c.alpha), SCORED))
    ends = scored.where("n is not null").groupBy(F.col("n").alias("dst")).agg(*added(F.col("g"), d)).select("dst", side_by_side(d).alias("g"))
    along = graph.edges.join(ends, "dst").select("src", "way", F.transform("g", lambda x: x * F.col("share")).alias("g"))
    back = along.groupBy("src", "way").agg(*added(F.col("g"), d)).select(F.col("src").alias("n"), F.struct("way", side_by_side(d).alias("q")).alias("back"))
    first = graph.first.drop("out").join(back.groupBy("n").agg(F.collect_list("back").alias("back")), "n").mapInArrow(receiving(w), "g array<double>")
    own = lambda df, k: df.select(F.lit(k).alias("k"), F.posexplode("g").alias("i", "g"))
    sums = own(scored.where("n is null and g is not null"), 0).unionByName(own(first, 1)).groupBy("k", "i").agg(F.sum("g").alias("g")).toArrow()
    k, i, g = (sums.column(x).to_numpy() for x in ("k", "i", "g"))
    flat = {x: g[k == x][np.argsort(i[k == x])] for x in (0, 1)}
    n = max(flat[0][-1], 1.0)
    matrices, end = forms(w), -2 - 3 * d
    small = lambda layer, x: dict(zip((f"{name}{layer}" for name in ("bias", "gain", "shift")), x.reshape(3, -1), strict=True))
    found = form_gradients(w, flat[0][: matrices.size].reshape(matrices.shape)) | {"offset": flat[0][matrices.size : end]} | small(2, flat[0][end:-2])
    if len(flat[1]):
        size = stacked(w, 1).size
        found |= unstacked(w, 1, flat[1][:size].reshape(-1, d)) | small(1, flat[1][size : size + 3 * d]) | unstacked(w, 2, flat[1][size + 3 * d :].reshape(-1, d))
    found = {name: found.get(name, np.zeros_like(x)) / n for name, x in w.items()}
    return float(flat[0][-2] / n), found, scored.where("part is not null").select("u", "v", "y", "part", "score")


# --- training --------------------------------------------------------------------


class AdamW:
    def __init__(self, decay: float, betas: tuple[float, float] = (0.9, 0.999), epsilon: float = 1e-8):
        self.decay, self.betas, self.epsilon, self.t, self.m, self.v = decay, betas, epsilon, 0, {}, {}

    def step(self, w: dict[str, np.ndarray], g: dict[str, np.ndarray], rate: float) -> dict[str, np.ndarray]:
        self.t += 1
        (b1, b2), out = self.betas, {}
        for name, x in w.items():
            self.m[name] = b1 * self.m.get(name, 0.0) + (1 - b1) * g[name]
            self.v[name] = b2 * self.v.get(name, 0.0) + (1 - b2) * g[name] ** 2
            out[name] = x - rate * (self.decay * x + self.m[name] / (1 - b1**self.t) / (np.sqrt(self.v[name] / (1 - b2**self.t)) + self.epsilon))
        return out


def clipped(g: dict[str, np.ndarray], most: float) -> dict[str, np.ndarray]:
    norm = np.sqrt(sum(float((x**2).sum()) for x in g.values()))
    return {k: x * min(1.0, most / (norm + 1e-6)) for k, x in g.items()} if most > 0 else g


def cosine(config: Config, epoch: int) -> float:
    return config.least_rate + (config.rate - config.least_rate) * (1 + np.cos(np.pi * epoch / config.epochs)) / 2


def fit(graph: Graph, pairs: DataFrame, config: Config) -> Model:
    """The weights of the epoch with the best average precision on the pairs in part "val"; history has every epoch.

    Only edges of the graph send messages: the caller leaves supervised positives out of it.
    """
    decoded = sorted(r["relation"] for r in pairs.select("relation").distinct().collect())
    pairs = step(graph.numbered(pairs, decoded))
    model, optimiser = fresh(config, graph.width, decoded), AdamW(config.decay)
    best, best_weights, waited = -1.0, model.weights, 0
    for epoch in range(config.epochs):
        with discard(pairs.sparkSession):
            loss, g, scored = numbered_gradients(graph, pairs, model)
            held = metrics.pr_auc_in_ranges(scored.where("part = 'val'"))
        model.history.append({"epoch": epoch, "loss": loss, "val_pr_auc": held, "rate": cosine(config, epoch)})
        if held > best + 1e-4:
            best, best_weights, waited = held, model.weights, 0
        else:
            waited += 1
            if waited >= config.patience:
                break
        model.weights = optimiser.step(model.weights, clipped(g, config.clip), cosine(config, epoch))
    model.weights = best_weights
    return model


def score(graph: Graph, pairs: DataFrame, model: Model) -> DataFrame:
    """(u, v, y, logit) of pairs(u, v, relation, y)."""
    asked = with_ends(graph.numbered(pairs.withColumn("part", F.lit("asked")), model.decoded), second_sums(graph, model))
    scored = asked.mapInArrow(pair_map(model.weights, model.config.gamma, model.config.alpha), SCORED).where("part is not null")
    return graph.named(scored).select("u", "v", "y", F.col("score").alias("logit"))


def parts(pairs: DataFrame, stay: float = 0.5, val: float = 0.3, seed: str = "0") -> DataFrame:
    """pairs(u, v, relation, y, test) with part: "test", "val", "train", or "graph" for positives that stay edges and aren't asked."""
    draw = lambda what: uniform(F.lit(what), F.lit(seed), "u", "v", "relation")
    part: Column = F.when(F.col("test"), "test").when((F.col("y") == 1) & (draw("stay") < stay), "graph").when(draw("val") < val, "val").otherwise("train")
    return pairs.withColumn("part", part)


def corrupted(edges: DataFrame, nodes: DataFrame, seed: str = "0") -> DataFrame:
    """(u, v, relation): for each distinct edge another target of its target's type, drawn uniformly; draws that are edges are left out."""
    known = edges.select("src", "dst", "relation").distinct()
    typed = nodes.select(F.col("id").alias("dst"), "node_type")
    numbered = dense_ids(nodes).select("node_type", "idx", F.col("id").alias("drawn"))
    sizes = numbered.groupBy("node_type").agg(F.count("*").alias("size"))
    asked = known.join(typed, "dst").join(F.broadcast(sizes), "node_type").withColumn("idx", F.floor(uniform(F.lit("corrupt"), F.lit(seed), "src", "relation", "dst") * F.col("size")))
    drawn = asked.join(numbered, ["node_type", "idx"]).select("src", F.col("drawn").alias("dst"), "relation").distinct()
    return drawn.join(known, ["src", "dst", "relation"], "left_anti").select(F.col("src").alias("u"), F.col("dst").alias("v"), "relation")


def link_task(edges: DataFrame, nodes: DataFrame, test_share: float = 0.2, stay: float = 0.5, val: float = 0.3, seed: str = "0") -> tuple[DataFrame, DataFrame]:
    """(pairs, observed): all relations' edges and as many corrupted ones, in parts, and the edges that send messages.

    Supervised positives, held-out ones among them, aren't observed; a negative is in part "test", "val" or "train".
    """
    label = lambda df, y: df.select("u", "v", "relation", F.lit(y).alias("y"))
    every = label(edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), "relation").distinct(), 1).unionByName(label(corrupted(edges, nodes, seed), 0))
    split = step(parts(every.withColumn("test", uniform(F.lit("test"), F.lit(seed), "u", "v", "relation") < test_share), stay, val, seed))
    hidden = split.where("y = 1 and part <> 'graph'").select(F.col("u").alias("src"), F.col("v").alias("dst"), "relation")
    return split.where("part <> 'graph'"), step(edges.select("src", "dst", "relation").join(hidden, ["src", "dst", "relation"], "left_anti"))

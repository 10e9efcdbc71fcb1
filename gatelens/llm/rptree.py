"""Embedding near-duplicates by a forest of random-projection trees.

Each tree splits a bounded sample of the vectors by random directions, one for each level, at the median, down to a depth
that follows the number of all vectors. Where few sampled vectors are left a split goes through the middle of those, so
leaves go on shrinking when the table outgrows the sample; nodes are four numbers each, so a forest of the greatest
depth is ``TREES * 2 ** DEPTH_MOST`` times 32 bytes. Every vector is dealt to leaves; near a split it goes both ways
(spill), in proportion to the distance that two linked vectors can have. Within a leaf all cosines are computed in double precision. A pair that
meets in several leaves is counted in the one with the smallest number, so no pair need be shuffled: a leaf returns
counts, and a spanning forest of its links for the union. Leaves with many members are compared in pairs of blocks.
Equal vectors are one class with a multiplicity, so copies meet nobody.

Rows: vectors that are null, empty, zero or hold null or non-finite components link with nothing and stay. Vectors of
different lengths don't link; each length has its own forest. Rows that repeat a vec_id are separate vectors that
share it. A component's id is its smallest vec_id, nulls last. An empty table gives no rows. Other columns are ignored.
Classes are known by a 64-bit hash of the vector: n different ones give n * n / 2 ** 65 false classes in expectation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens.llm.common import components, keep, table, tidy

COSINE = 0.95
TREES = 4
LEAF = 512
#: The stated bound on the vectors that the trees are fitted to, and on a tree's depth.
SAMPLE, DEPTH_MOST = 20_000, 18
SPILL = 1.0
LEAF_MOST = 2048


@dataclass(frozen=True)
class Tree:
    """Nodes in rows: bounds of the spill, children; a child c < 0 is leaf -1 - c. directions: a row for each level."""

    directions: np.ndarray
    low: np.ndarray
    high: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaves: int

    def deal(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of each place that a row goes to."""
        if not len(self.low):
            return np.arange(len(x)), np.zeros(len(x), np.int64)
        rows, node, done_rows, done = np.arange(len(x)), np.zeros(len(x), np.int64), [], []
        for way in (x @ self.directions.T).T:
            p = way[rows]
            left, right = p <= self.high[node], p >= self.low[node]
            rows, node = np.concatenate([rows[left], rows[right]]), np.concatenate([self.left[node[left]], self.right[node[right]]])
            end = node < 0
            done_rows.append(rows[end])
            done.append(-1 - node[end])
            rows, node = rows[~end], node[~end]
        return np.concatenate(done_rows), np.concatenate(done)


def unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def grow(sample: np.ndarray, depth: int, cosine: float, seed: int) -> Tree:
    d = sample.shape[1]
    ways = np.random.default_rng(seed).standard_normal((depth if len(sample) else 0, d))
    ways /= np.linalg.norm(ways, axis=1, keepdims=True)
    # half the distance of linked vectors along a random direction, in standard deviations
    reach = SPILL * np.sqrt(2 - 2 * cosine) / np.sqrt(d) / 2
    places, nodes, now = sample @ ways.T, [], [np.arange(len(sample))]
    # level by level: a level's nodes follow each other, and so do their children
    for level in range(len(ways)):
        below, first = [], sum(map(len, nodes)) + len(now)
        found = np.empty((len(now), 4))
        for k, own in enumerate(now):
            p = places[own, level]
            middle = float(np.median(p))
            found[k] = middle - reach, middle + reach, first + 2 * k, first + 2 * k + 1
            below += [own[p <= middle + reach], own[p >= middle - reach]]
        if level == len(ways) - 1:
            found[:, 2:] = -1 - np.arange(2 * len(now)).reshape(-1, 2)
        nodes.append(found)
        now = below
    if not nodes:
        return Tree(ways, *(np.zeros(0) for _ in range(4)), 1)
    table = np.concatenate(nodes)
    return Tree(ways, table[:, 0], table[:, 1], table[:, 2].astype(np.int64), table[:, 3].astype(np.int64), len(now))


def deal_all(forest: list[Tree], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) sorted by row and code; leaves of all trees are numbered through."""
    rows, codes, first = [], [], 0
    for tree in forest:
        r, leaf = tree.deal(x)
        rows.append(r)
        codes.append(leaf + first)
        first += tree.leaves
    rows, codes = np.concatenate(rows), np.concatenate(codes)
    order = np.lexsort((codes, rows))
    return rows[order], codes[order]


def compare(code: int, x: np.ndarray, codes: list[np.ndarray], cosine: float, sides: np.ndarray | None) -> np.ndarray:
    """Symmetric matrix of the links that belong to this leaf. sides: where given, only pairs of different sides count."""
    near = (x @ x.T) >= cosine
    np.fill_diagonal(near, False)
    near &= near.T
    if sides is not None:
        near &= sides[:, None] != sides[None, :]
    if near.any():
        lower = [c[c < code] for c in codes]
        every, where = np.unique(np.concatenate(lower), return_inverse=True)
        if len(every):
            held = np.zeros((len(x), len(every)), np.float32)
            held[np.repeat(np.arange(len(x)), [len(c) for c in lower]), where] = 1
            near &= (held @ held.T) < 0.5
    return near


def class_links(classes: DataFrame, cosine: float, trees: int) -> tuple[DataFrame, DataFrame]:
    """classes: (cid, mult, v) of one length. (cid, n) counts of linked vectors in other classes; (a, b) links."""
    n = classes.count()
    share = min(1.0, SAMPLE / max(1, n))
    part = F.pmod(F.xxhash64(F.lit("forest"), "cid"), F.lit(1 << 30)) < int(share * (1 << 30))
    taken = classes.where(part).select("cid", "v").toArrow().sort_by("cid").column("v").to_pylist()
    sample = unit(np.array([np.frombuffer(b, np.float64) for b in taken])) if taken else np.zeros((0, 1))
    depth = min(DEPTH_MOST, max(0, int(np.ceil(np.log2(max(1, n / LEAF))))))
    forest = [grow(sample, depth, cosine, seed) for seed in range(trees)]

    def dealt(split: dict[int, int]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for a in range(0, whole.num_rows, 1024):
                    batch = whole.slice(a, 1024)
                    cid, mult, raw = batch.column("cid").to_numpy(), batch.column("mult").to_numpy(), batch.column("v").to_pylist()
                    x = unit(np.array([np.frombuffer(b, np.float64) for b in raw]))
                    row, code = deal_all(forest, x)
                    own = np.split(code, np.searchsorted(row, np.arange(1, len(raw))))
                    packed = [o.astype(np.int32).tobytes() for o in own]
                    out = []
                    for r, c in zip(row.tolist(), code.tolist(), strict=True):
                        m = split.get(c, 1)
                        b = int(cid[r] % m)
                        out += [(c, min(b, o), max(b, o), r, b) for o in range(m)]
                    c, i, j, r, b = (np.array(k) for k in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c), pa.array(i), pa.array(j), pa.array(b), pa.array(cid[r]), pa.array(mult[r]), pa.array([raw[k] for k in r], pa.binary()), pa.array([packed[k] for k in r], pa.binary())],
                        names=["code", "i", "j", "b", "cid", "mult", "v", "codes"],
                    )

        return run

    schema = "code long, i long, j long, b long, cid long, mult long, v binary, codes binary"
    sizes = classes.mapInArrow(tidy(dealt({})), schema).groupBy("code").agg(F.count("*").alias("n")).where(F.col("n") > LEAF_MOST).collect()  # no more rows than leaves
    split = {r["code"]: -(-r["n"] * 2 // LEAF_MOST) for r in sizes}

    def leaf(group: pa.Table) -> pa.Table:
        group = group.sort_by("cid")
        code, i, j = (group.column(k)[0].as_py() for k in ("code", "i", "j"))
        cid, mult = group.column("cid").to_numpy(), group.column("mult").to_numpy()
        x = unit(np.array([np.frombuffer(b, np.float64) for b in group.column("v").to_pylist()]))
        codes = [np.frombuffer(b, np.int32) for b in group.column("codes").to_pylist()]
        near = compare(code, x, codes, cosine, group.column("b").to_numpy() if i != j else None)
        some = np.flatnonzero(near.any(axis=1))
        count = near @ mult.astype(np.float64)
        label = np.arange(len(cid))
        while True:
            low = np.minimum(label, np.where(near, label[None, :], len(cid)).min(axis=1, initial=len(cid)))
            low = low[low]
            if (low == label).all():
                break
            label = low
        joined = np.flatnonzero(label != np.arange(len(cid)))
        return pa.table({
            "a": pa.array(np.concatenate([cid[some], cid[joined]]), pa.int64()),
            "b": pa.array([*[None] * len(some), *cid[label[joined]].tolist()], pa.int64()),
            "n": pa.array(np.concatenate([count[some], np.zeros(len(joined))]).astype(np.int64)),
        })

    found = keep(classes.mapInArrow(tidy(dealt(split)), schema).groupBy("code", "i", "j").applyInArrow(leaf, "a long, b long, n long"))
    return found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n")), found.where("b is not null").select("a", "b")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, trees: int = TREES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding)."""
    e = F.col("embedding")
    sound = e.isNotNull() & (F.size(e) > 0) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select("vec_id", e.cast("array<double>").alias("embedding")).withColumn("cid", F.when(F.coalesce(sound, F.lit(False)), F.xxhash64("embedding")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("embedding")
            off, flat = v.offsets.to_numpy(), v.values.to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array([flat[a:z].tobytes() for a, z in zip(off[:-1], off[1:], strict=True)], pa.binary())], names=["cid", "v"])

    light = rows.select("vec_id", "cid")
    counted = light.where("cid is not null").groupBy("cid").agg(F.count("*").alias("mult"), F.min("vec_id").alias("lead"))
    single = rows.where("cid is not null").select("cid", "embedding").mapInArrow(tidy(pack), "cid long, v binary").dropDuplicates(["cid"])
    classes = keep(counted.join(single, "cid").withColumn("dim", F.octet_length("v")), "vectors")
    counts, links = None, None
    for r in classes.groupBy("dim").agg(F.count("*").alias("n")).where("n > 1").collect():
        c, k = class_links(classes.where(F.col("dim") == r["dim"]).select("cid", "mult", "v"), cosine, trees)
        counts, links = (c, k) if counts is None else (counts.unionByName(c), links.unionByName(k))
    named = classes.select("cid", "mult", "lead")
    if links is not None and not links.isEmpty():
        rooted = named.join(components(links).withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        least = rooted.groupBy("root").agg(F.min("lead").alias("component"))
        named = rooted.join(least, "root").join(counts, "cid", "left").select("cid", "mult", F.col("component").alias("lead"), "n")
    else:
        named = named.withColumn("n", F.lit(0).cast("long"))
    # vectors that link with nothing have keys of their own, so that they don't meet in one task
    keyed = light.withColumn("sound", F.col("cid").isNotNull()).withColumn("cid", F.coalesce("cid", F.xxhash64("vec_id")))
    out = keyed.join(keep(named.withColumn("sound", F.lit(True))), ["cid", "sound"], "left").select("vec_id", F.coalesce(F.col("mult") - 1 + F.coalesce("n", F.lit(0)), F.lit(0)).cast("long").alias("n_links"), F.coalesce("lead", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), sound AS (
  SELECT r, e, len(e) AS n FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.r AS a, b.r AS b FROM sound a JOIN sound b ON a.n = b.n AND a.r <> b.r WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT r, r AS x FROM v UNION SELECT reach.r, links.b FROM reach JOIN links ON reach.x = links.a
), least AS (SELECT reach.r, min(o.vec_id) AS component_id FROM reach JOIN v o ON o.r = reach.x GROUP BY reach.r)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.a = v.r) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN least USING (r)
"""

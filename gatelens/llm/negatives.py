"""Hard-negative mining by blocked dense products: anchor blocks are broadcast against all candidates, twice.

Vectors become whole numbers, floor(256 x), and scores are their inner products, taken as float64 matrix products, which
are exact while they stay below 2^53; rows that could go beyond are multiplied as Python integers, and a score outside
a long is held at its end. Anchors are dealt to blocks of about ``BLOCK_VALUES`` numbers by a hash, so a block, and
with it what is broadcast at a time and what the driver holds, has the same size however many anchors there are; more
anchors are more blocks. For each block a first pass keeps, in each task, the five best same-label rows of every anchor;
these lists merge by (score, id), whatever the tasks were. A second pass takes the merged positives and keeps, for each
anchor and positive, the three best rows of other labels within the window of scores that the positive sets. A task holds
one batch of candidates, a tile of scores and the lists of the block; anchors and candidates are never paired as rows.

Rows: a null vec_id, a null label, a null vector, or a null or non-finite component takes no part. Vectors are compared
with those of their own length only; empty vectors score 0. Ties go by smaller vec_id. Rows that repeat (vec_id, label,
vector) count once. If rows of one vec_id differ, each takes part; they aren't "other rows" of each other, and of those
that score the same for an anchor one is kept. An anchor without a row of its label has no positives and gives no rows;
neither does a positive with an empty window. An empty table gives no rows. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatelens.llm.common import keep, scratch_dir, table, tidy

SCALE = 256
ANCHORS_EVERY, RELABEL_EVERY, LABELS = 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
#: The window of a positive: its score times LOW <= 100 times the negative's <= its score times HIGH.
LOW, HIGH = 50, 95
#: Numbers in a block of anchors (8 bytes each), and scores in a tile.
BLOCK_VALUES, TILE = 1 << 22, 1 << 18
EXACT = 1 << 53
NONE = np.iinfo(np.int64).min


# --- vectors ---------------------------------------------------------------------


def quantised(vec_id: pa.Array, label: pa.Array, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, matrix) of the sound rows of a batch, one for each length of vector."""
    off, values = vectors.offsets.to_numpy(), vectors.values
    flat = values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components become NaN
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    sound = (bad[off[1:]] == bad[off[:-1]]) & vectors.is_valid().to_numpy(zero_copy_only=False) & vec_id.is_valid().to_numpy(zero_copy_only=False) & label.is_valid().to_numpy(zero_copy_only=False)
    ids, labels = (x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (vec_id, label))
    sizes = np.diff(off)
    for size in np.unique(sizes[sound]):
        rows = np.flatnonzero(sound & (sizes == size))
        with np.errstate(over="ignore"):
            yield ids[rows], labels[rows], np.nan_to_num(np.floor(SCALE * flat[off[rows][:, None] + np.arange(size)]))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all of b, as longs."""
    most = (np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    if most[0] * most[1] * max(a.shape[1], 1) < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (a, b)]
    ends = np.iinfo(np.int64)
    return np.array([[min(max(int((x * y).sum()), ends.min + 1), ends.max) for y in whole[1]] for x in whole[0]], np.int64).reshape(len(a), len(b))


# --- lists of the best -----------------------------------------------------------


class Best:
    """The k best (score, id) pairs of each of n lists; an id counts once for a score."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, np.full((n, k), NONE), np.full((n, k), NONE)

    @property
    def least(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, lists: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(lists)
        at = np.concatenate([np.repeat(touched, self.k), lists])
        s, i = np.concatenate([self.score[touched].ravel(), score]), np.concatenate([self.id[touched].ravel(), ids])
        order = np.lexsort((i, ~s, at))  # ~s falls as s grows, without overflow
        at, s, i = at[order], s[order], i[order]
        again = np.concatenate([[False], (at[1:] == at[:-1]) & (s[1:] == s[:-1]) & (i[1:] == i[:-1])]) & (s != NONE)
        at, s, i = at[~again], s[~again], i[~again]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        best = place < self.k
        self.score[at[best], place[best]], self.id[at[best], place[best]] = s[best], i[best]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, place = np.nonzero(self.score != NONE)
        return at, self.score[at, place], self.id[at, place]


def tiles(anchors: int, candidates: int) -> Iterator[tuple[slice, slice]]:
    across = min(max(candidates, 1), 1024)
    down = max(1, TILE // across)
    for a in range(0, anchors, down):
        for b in range(0, candidates, across):
            yield slice(a, a + down), slice(b, b + across)


def best_positives(group: dict, best: Best, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray) -> None:
    """Puts a batch's rows into the lists of the anchors of their labels."""
    for label in np.intersect1d(labels, group["label"]):
        mine, theirs = np.flatnonzero(group["label"] == label), np.flatnonzero(labels == label)
        for a, b in tiles(len(mine), len(theirs)):
            rows, cols = mine[a], theirs[b]
            score = products(group["matrix"][rows], matrix[cols])
            score[group["id"][rows][:, None] == ids[cols]] = NONE
            floor = np.maximum(best.least[rows], NONE + 1)
            if score.shape[1] > best.k:  # what is below the tile's own k-th best can't be among the best, if ids are unique in it
                distinct = len(np.unique(ids[cols])) == len(cols)
                floor = np.maximum(floor, np.partition(score, -best.k, axis=1)[:, -best.k]) if distinct else floor
            x, y = np.nonzero(score >= floor[:, None])
            best.add(rows[x], score[x, y], ids[cols[y]])


def best_negatives(group: dict, best: Best, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray) -> None:
    """Puts a batch's rows into the lists of the (anchor, positive) pairs whose windows they are in."""
    for a, b in tiles(len(group["id"]), len(ids)):
        score = products(group["matrix"][a], matrix[b])
        first, last = group["pairs"][a.start], group["pairs"][min(a.stop, len(group["id"]))]
        if first == last:
            continue
        floors = np.maximum(group["low"][first:last], best.least[first:last])
        owner = group["owner"][first:last] - a.start
        anchor_floor, anchor_top = np.full(len(score), np.iinfo(np.int64).max), np.full(len(score), NONE)
        np.minimum.at(anchor_floor, owner, floors)
        np.maximum.at(anchor_top, owner, group["high"][first:last])
        x, y = np.nonzero((score >= anchor_floor[:, None]) & (score <= anchor_top[:, None]) & (group["label"][a][:, None] != labels[b]) & (group["id"][a][:, None] != ids[b]))
        for k in range(POSITIVES):  # each anchor's k-th positive
            pair = group["pairs"][a.start + x] + k
            real = pair < group["pairs"][a.start + x + 1]
            pair, u, v = pair[real], x[real], y[real]
            s = score[u, v]
            fits = (s >= group["low"][pair]) & (s <= group["high"][pair]) & (s >= best.least[pair])
            best.add(pair[fits], s[fits], ids[b][v[fits]])


# --- passes ----------------------------------------------------------------------


def blocks_of(rows: DataFrame) -> tuple[DataFrame, int]:
    """(block, vec_id, label, embedding) of the anchors, each once, and the number of blocks."""
    anchors = rows.where(F.col("vec_id") % ANCHORS_EVERY == 0).where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).dropDuplicates(["vec_id", "label", "embedding"])
    size = anchors.agg(F.sum(F.size("embedding"))).collect()[0][0] or 0
    n = max(1, -(-size // BLOCK_VALUES))
    return keep(anchors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")), "anchors"), n


def read_block(anchors: DataFrame, block: int) -> list[dict]:
    """One group for each length of vector, with the anchors in the order of id, label and vector."""
    t = anchors.where(F.col("block") == block).select("vec_id", "label", "embedding").toArrow().combine_chunks()
    found = []
    for batch in t.to_batches():
        for ids, labels, matrix in quantised(*batch.columns):
            order = np.lexsort((*matrix.T[::-1], labels, ids))
            found.append({"id": ids[order], "label": labels[order], "matrix": matrix[order], "size": matrix.shape[1]})
    sizes = sorted({g["size"] for g in found})
    merged = []
    for size in sizes:
        own = [g for g in found if g["size"] == size]
        ids, labels, matrix = (np.concatenate([g[x] for g in own]) for x in ("id", "label", "matrix"))
        merged.append({"id": ids, "label": labels, "matrix": matrix, "size": size})
    return merged


def pass_over(rows: DataFrame, groups: list[dict], k: int, put, count) -> DataFrame:
    """(part, list, score, id): in each task, the k best of each list of each group; put adds a batch to a group's lists."""
    shared = rows.sparkSession.sparkContext.broadcast(groups)

    def scan(batches):
        held = shared.value
        best = [Best(count(g), k) for g in held]
        for batch in batches:
            for ids, labels, matrix in quantised(*batch.columns):
                for g, b in zip(held, best, strict=True):
                    if g["size"] == matrix.shape[1]:
                        put(g, b, ids, labels, matrix)
        for part, b in enumerate(best):
            at, score, ids = b.rows()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), part, np.int32)), pa.array(at), pa.array(score), pa.array(ids)], names=["part", "list", "score", "id"])

    found = rows.mapInArrow(tidy(scan), "part int, list long, score long, id long")
    order = Window.partitionBy("part", "list").orderBy(F.desc("score"), "id")
    return found.dropDuplicates().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def with_positives(groups: list[dict], merged: pa.Table) -> list[dict]:
    """The groups with their (anchor, positive) pairs and the pairs' windows."""
    part, at, rank, score, ids = (merged.column(x).to_numpy() for x in ("part", "list", "rank", "score", "id"))
    out = []
    for k, g in enumerate(groups):
        mine = np.flatnonzero(part == k)
        mine = mine[np.lexsort((rank[mine], at[mine]))]
        owner, s = at[mine], score[mine]
        low = -((-s) // 100 * LOW + (-s) % 100 * LOW // 100)  # both are exact, and don't overflow
        high = s // 100 * HIGH + s % 100 * HIGH // 100
        out.append(g | {"owner": owner, "positive": ids[mine], "positive_score": s, "low": low, "high": high, "pairs": np.searchsorted(owner, np.arange(len(g["id"]) + 1))})
    return out


def mine(rows: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows(vec_id, label, embedding)."""
    spark = rows.sparkSession
    rows = rows.select("vec_id", "label", "embedding")
    anchors, n = blocks_of(rows)
    path, written = scratch_dir(spark, "negatives"), False
    for block in range(n):
        groups = read_block(anchors, block)
        if not groups:
            continue
        merged = pass_over(rows, groups, POSITIVES, best_positives, lambda g: len(g["id"])).toArrow()
        groups = with_positives(groups, merged)
        negatives = pass_over(rows, groups, NEGATIVES, best_negatives, lambda g: len(g["owner"]))
        pairs = [pa.table({"part": pa.array(np.full(len(g["owner"]), k, np.int32)), "list": np.arange(len(g["owner"])), "anchor_id": g["id"][g["owner"]], "positive_id": g["positive"], "positive_score": g["positive_score"]}) for k, g in enumerate(groups)]
        named = F.broadcast(spark.createDataFrame(pa.concat_tables(pairs).combine_chunks()))  # in one chunk: an empty one would end the table
        done = negatives.join(named, ["part", "list"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        done.write.parquet(f"{path}/block={block}")
        written = True
    found = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.read.schema(f"{found}, block int").parquet(path).drop("block") if written else spark.createDataFrame([], found)


def relabelled(rows: DataFrame) -> DataFrame:
    """rows with the label of every seventh id moved on by one."""
    return rows.withColumn("label", F.when(F.col("vec_id") % RELABEL_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")).cast("long"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(relabelled(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")))


OP12_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 3
"""

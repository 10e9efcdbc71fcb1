"""What the operators share: tables, checkpoints, byte-level text arithmetic, components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text is worked on in slices of about this many bytes, so that a worker's memory is bounded by this and the longest text.
SLICE_BYTES = 1 << 19


#: Rows in a batch that goes to a Python worker: texts are long.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(f):
    """f, a map over batches or a function of a group, giving unused memory back to the system at its end.

    Workers live on for other tasks, and two of them share an executor's memory with its JVM.
    """

    def release() -> None:
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    @functools.wraps(f)
    def run(x):
        if isinstance(x, pa.Table):
            out = f(x)
            release()
            return out
        return mapped(x)

    def mapped(x):
        yield from f(x)
        release()

    return run


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only where none is set and there is one machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = os.path.join(tempfile.gettempdir(), "checkpoints/gatelens")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def keep(df: DataFrame, what: str = "step") -> DataFrame:
    """Write as a Parquet table in the shared folder and read it back.

    This cuts the lineage, survives the loss of any executor, and gives the planner true sizes; sizes guessed over a
    loop's joins would grow without bound.
    """
    path = scratch_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --- bytes of many texts at once -------------------------------------------------


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts on end, and where each begins; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "").cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(size), 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: ASCII digits, ASCII letters, everything outside ASCII.
ALNUM = np.array([48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128 for b in range(256)])
#: Bytes of words that only white space ends.
BLACK = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        up, down = np.full(size, _P), np.full(size, _P_INV)
        up[0] = down[0] = 1
        if size > 1 << 23:
            return np.multiply.accumulate(up), np.multiply.accumulate(down)
        _powers.clear()
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, off: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of member bytes within each text, and the number of runs before each text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = member[data]
    edge = np.empty(len(data), bool)
    edge[0], edge[1:] = False, inside[:-1]
    edge[off[:-1][off[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~edge)
    edge[-1], edge[:-1] = False, inside[1:]
    edge[off[1:][off[1:] > 0] - 1] = False
    return starts, np.flatnonzero(inside & ~edge) + 1, np.searchsorted(starts, off)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges: equal bytes, equal hash."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hash_windows(hashed: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive words, texts' borders ignored."""
    count = len(hashed) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total, factor = np.full(count, n, np.uint64), 1
    for k in range(n):
        factor = factor * 0xA0761D6478BD642F % (1 << 64)
        total += hashed[k : k + count] * np.uint64(factor)
    return mix(total)


# --- components ------------------------------------------------------------------


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 100) -> DataFrame:
    """(node, root): for each node of an edge the smallest node it reaches. Labels are joined, never collected.

    A round takes the least label of the neighbours and then the label of that label, so long chains shorten
    geometrically; the labels are written to the shared folder after each round.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    for _ in range(2):  # a node keeps its least neighbour, and ties the others to that one: as connected, and mostly far fewer
        pairs = keep(pairs)
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        pairs = pairs.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
    both = keep(pairs)
    both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
    labels = keep(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("root")))
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("m"))
        hooked = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "m").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = keep(hooked.join(jump, "root", "left").select("node", "was", F.least("root", F.coalesce("far", "root")).alias("root")))
        changed = not new.where("was <> root").isEmpty()
        labels = new.select("node", "root")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")

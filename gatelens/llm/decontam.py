"""Benchmark decontamination: broadcast hash sets of benchmark n-grams, scanned over document word windows.

Words are maximal runs of ASCII letters, ASCII digits and non-ASCII characters, A-Z lower-cased. An item's windows
are its runs of ``window`` words, or the whole item where it is shorter. The benchmark is a query set: the driver reads
it row by row and broadcasts blocks of at most ``BLOCK_WINDOWS`` windows, an item that is longer in several; it holds
one block at a time. A task takes a group of texts, hashes its words once, and looks its windows up in one block after
another, so it holds one block and one group, and texts are never shuffled, whatever the benchmark's size. Hash hits are
verified on the words themselves.

Null texts have no words, and items without words match nothing. Texts and items of any length are taken whole. Rows
that repeat a doc_id are scanned one by one. Item ids that repeat count once; a null item_id counts as the empty string.
With an empty benchmark nothing is hit; an empty table gives no rows. Other columns, whatever their names, are passed on
by ``remove_spans`` and ignored by ``scan``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens.llm.common import ALNUM, LOWER, SLICE_BYTES, hash_windows, hash_words, slices, table, tidy, utf8, words

#: Windows in one broadcast block: about 150 bytes each, 30 MB.
BLOCK_WINDOWS = 200_000
#: Bytes of text that a task holds while it goes through several blocks.
GROUP_BYTES = 8 << 20
BITS = 22


def said(text: str) -> list[bytes]:
    data, off = utf8(pa.array([text]))
    data = LOWER[data]
    starts, ends, _ = words(data, off, ALNUM)
    return [data[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]


class Grams:
    """Benchmark windows of one block, by length, with their items."""

    def __init__(self):
        self.items: dict[bytes, list[str]] = {}
        self.size_of: dict[bytes, int] = {}
        self.count = 0

    def add(self, item: str, window: list[bytes]) -> None:
        key = b" ".join(window)
        self.size_of[key] = len(window)
        owners = self.items.setdefault(key, [])
        if item not in owners:
            owners.append(item)
        self.count += 1

    def seal(self) -> Grams:
        self.known: dict[int, np.ndarray] = {}
        self.bits: dict[int, np.ndarray] = {}
        for n in sorted(set(self.size_of.values())):
            joined = b" ".join(k for k, m in self.size_of.items() if m == n)
            data = np.frombuffer(joined, np.uint8)
            starts, ends, _ = words(data, np.array([0, len(data)]), ALNUM)
            hashed = hash_words(data, starts, ends).reshape(-1, n)
            self.known[n] = np.unique(np.concatenate([hash_windows(row, n) for row in hashed]))
            self.bits[n] = np.zeros(1 << BITS, bool)
            self.bits[n][(self.known[n] >> np.uint64(64 - BITS)).astype(np.int64)] = True
        self.size_of = {}
        return self


class Texts:
    """The words of a batch's texts, their hashes, and what is found in them."""

    def __init__(self, column: pa.Array):
        data, off = utf8(column)
        self.data, self.off = LOWER[data], off
        self.starts, self.ends, self.before = words(self.data, off, ALNUM)
        self.hashed = hash_words(self.data, self.starts, self.ends)
        self.flags = np.zeros(len(self.starts), bool)
        self.owners: dict[int, set[str]] = {}

    def look_up(self, grams: Grams) -> None:
        for n, near in grams.known.items():
            h = hash_windows(self.hashed, n)
            at = np.flatnonzero(grams.bits[n][(h >> np.uint64(64 - BITS)).astype(np.int64)])
            if not len(at):
                continue
            at = at[near[np.minimum(np.searchsorted(near, h[at]), len(near) - 1)] == h[at]]
            row = np.searchsorted(self.before, at, side="right") - 1
            inside = at + n <= self.before[row + 1]
            for i, r in zip(at[inside].tolist(), row[inside].tolist(), strict=True):
                key = b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[i : i + n], self.ends[i : i + n], strict=True))
                owners = grams.items.get(key)
                if owners:
                    self.flags[i : i + n] = True
                    self.owners.setdefault(r, set()).update(owners)

    def flags_of(self, r: int) -> np.ndarray:
        return self.flags[self.before[r] : self.before[r + 1]]


def blocks(benchmark: DataFrame, window: int) -> Iterator[Grams]:
    """The benchmark in blocks of bounded size, read row by row; none without words."""
    now = Grams()
    for r in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").where("text is not null").toLocalIterator():
        w = said(r["text"])
        for k in range(max(1, len(w) - window + 1) if w else 0):
            if now.count >= BLOCK_WINDOWS:
                yield now.seal()
                now = Grams()
            now.add(r["item"], w[k : k + window])
    if now.count:
        yield now.seal()


def broadcast_blocks(benchmark: DataFrame, window: int) -> list[Broadcast]:
    """The blocks as broadcast variables, which live in files; the driver's own objects are let go one by one."""
    context, out = benchmark.sparkSession.sparkContext, []
    for grams in blocks(benchmark, window):
        sent = context.broadcast(grams)
        if hasattr(sent, "_value"):
            del sent._value
        out.append(sent)
    return out


class Scanner:
    """Goes through the blocks for groups of texts; holds one block at a time."""

    def __init__(self, sent: list[Broadcast]):
        self.sent, self.held = sent, None

    def block(self, i: int) -> Grams:
        if self.held is not None and self.held != i:
            vars(self.sent[self.held]).pop("_value", None)
        self.held = i
        return self.sent[i].value

    def mark(self, texts: list[Texts]) -> None:
        order = range(len(self.sent))
        # the block that is held comes first
        for i in sorted(order, key=lambda i: i != self.held):
            grams = self.block(i)
            for t in texts:
                t.look_up(grams)

    def groups(self, batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[pa.RecordBatch, Texts]]]:
        """Marked batches, in groups of about GROUP_BYTES where there are several blocks to go through."""
        limit, group, size = GROUP_BYTES if len(self.sent) > 1 else SLICE_BYTES, [], 0
        for batch in slices(batches):
            group.append((batch, Texts(batch.column("text"))))
            size += len(group[-1][1].data)
            if size >= limit:
                self.mark([t for _, t in group])
                yield group
                group, size = [], 0
        if group:
            self.mark([t for _, t in group])
            yield group


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """(doc_id, n_words, hit_ranges, items) of every row: hit words as [first, end) ranges, items sorted as strings."""
    sent = broadcast_blocks(benchmark, window)
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in Scanner(sent).groups(batches):
            for batch, t in group:
                ranges = [[] for _ in range(batch.num_rows)]
                for r in t.owners:
                    f = np.diff(np.concatenate(([0], t.flags_of(r).astype(np.int8), [0])))
                    ranges[r] = [{"first": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(f == 1), np.flatnonzero(f == -1), strict=True)]
                cols = [batch.column("doc_id"), np.diff(t.before), ranges, [sorted(t.owners.get(r, ())) for r in range(batch.num_rows)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_words", "hit_ranges", "items"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_words long, hit_ranges array<struct<first: long, end: long>>, items array<string>")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, drop_share: float = 0.8) -> DataFrame:
    """docs with hit spans cut out; a document of which ``drop_share`` of the words are hit goes.

    A span runs from the first byte of its first word to the last byte of its last word; a line break takes its
    place. A text is cut once by the union of all blocks' hits, and the texts that were cut are scanned again by all
    blocks until nothing is found, as the parts on both sides may meet. n_chars follows.
    """
    sent = broadcast_blocks(benchmark, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(sent)
        for group in scanner.groups(batches):
            new = [{} for _ in group]  # row: text, words as it came, words gone
            work = [(g, r, t, r) for g, (_, t) in enumerate(group) for r in t.owners]
            raw = [utf8(batch.column("text")) for batch, _ in group]
            while work:
                texts = []
                for g, r, t, k in work:
                    text, total, gone = new[g].get(r, (None, int(t.before[k + 1] - t.before[k]), 0))
                    text = raw[g][0][raw[g][1][r] : raw[g][1][r + 1]].tobytes() if text is None else text
                    own = slice(t.before[k], t.before[k + 1])
                    flags = t.flags[own]
                    new[g][r] = (_cut(text, t.starts[own] - t.off[k], t.ends[own] - t.off[k], flags), total, gone + int(flags.sum()))
                    texts.append(new[g][r][0].decode())
                again = Texts(pa.array(texts, pa.string()))
                scanner.mark([again])
                work = [(g, r, again, k) for k, (g, r, *_) in enumerate(work) if k in again.owners]
            for (batch, _), changed in zip(group, new, strict=True):
                yield _with(batch, changed, drop_share) if changed else batch

    return docs.mapInArrow(tidy(run), docs.schema)


def _with(batch: pa.RecordBatch, changed: dict[int, tuple[bytes, int, int]], drop_share: float) -> pa.RecordBatch:
    """batch with the changed texts; rows of which enough is gone go."""
    cols, stay = dict(zip(batch.schema.names, batch.columns, strict=True)), np.ones(batch.num_rows, bool)
    texts = cols["text"].to_pylist()
    sizes = cols["n_chars"].to_pylist() if "n_chars" in cols else None
    for r, (text, total, gone) in changed.items():
        texts[r], stay[r] = text.decode(), gone < drop_share * total
        if sizes:
            sizes[r] = len(texts[r])
    cols["text"] = pa.array(texts, pa.string()).cast(cols["text"].type)
    if sizes:
        cols["n_chars"] = pa.array(sizes, cols["n_chars"].type)
    return pa.RecordBatch.from_arrays(list(cols.values()), schema=batch.schema).filter(pa.array(stay))


def _cut(raw: bytes, starts: np.ndarray, ends: np.ndarray, flags: np.ndarray) -> bytes:
    """raw with a line break for each run of flagged words."""
    out, at = [], 0
    f = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    for a, b in zip(np.flatnonzero(f == 1), np.flatnonzero(f == -1), strict=True):
        out.append(raw[at : starts[a]])
        at = ends[b - 1]
    return b"\n".join([*out, raw[at:]])


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_ranges", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["first"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), grams AS (
  SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS g
  FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM b WHERE len(w) > 0)
), hits AS (
  SELECT x.r, x.k, x.n, g.item
  FROM (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM grams) WHERE len(w) >= n)) x
  JOIN grams g ON g.n = x.n AND g.g = x.g
), found AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM hits) GROUP BY r), owners AS (
  SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN found USING (r) LEFT JOIN owners USING (r)
"""

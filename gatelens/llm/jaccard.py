"""N-gram Jaccard join by tries: near-duplicate documents and their components.

A document's set holds hashes of its distinct word shingles; documents with equal sets are one class. Two sets that
reach the similarity share at least that percentage of the shingles of each, so a class can link only if as many of
its shingles are repeated anywhere. Repeats are found exactly: blocks of documents send their sorted shingles, packed
into a few bytes each, to ranges of the hash space, and each range returns counts per document. What passes, copies
and near copies, is counted once more class by class.

The classes left have their shingles in one global order, rare ones first, and sets that reach the similarity share
one of the first ``n - ceil(0.8 n) + 1`` of each. Classes joined by such shingles form candidate groups, and each
class's set is sent to its group once. In a task a group's sets are stored as a trie in a common order, sets with a
common beginning next to each other. A probe walks it and carries the overlap of every common beginning over to all
sets below; where overlap plus what can still follow is too little, the walk jumps over the whole subtree. Pairs that
are connected already are passed over, so many copies of one text cost one link each. Groups over ``BLOCK`` classes are
first joined in random blocks, twice. What that leaves is compared by the shingles themselves: each shingle of a prefix
names the smallest class that holds it, and the classes that name the same one are a list. Lists whose classes aren't
all connected compare those outside the list's largest component with all of its classes, in pairs of blocks. No
candidate pair is left out, no group or list comes into one task, and nothing is collected.

What comes out is connectivity: pairs whose ends are connected already are not compared, so the links found are a
spanning forest of all links, and its components are those of all links.

Rows: texts without words, null ones included, have an empty set and link with nothing. Rows that repeat a doc_id
are separate rows that share it. Ids of components are the smallest doc_id, nulls last. Texts of any length are taken
whole; an empty table gives no rows. Other columns, whatever their names, are passed on by ``keep_one``. Sets are
compared by 64-bit hashes of shingles; classes are known by a 64-bit hash of the set, so that n different sets give
n * n / 2 ** 65 false classes in expectation (2.7 at 10 ** 10). Repeats are counted by at least 48 bits of the shingles,
where a false match only lets a class pass to the exact steps.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens.llm.common import BLACK, LOWER, components, hash_windows, hash_words, keep, mix, slices, table, tidy, utf8, words

WORDS = 5
PERCENT = 80
#: Shingles and documents in a block that is packed at once; shingles aimed at for a range of the hash space.
PACK_SHINGLES, PACK_DOCS, RANGE_SHINGLES = 1_000_000, 60_000, 1_000_000
BLOCK = 192
#: Tasks that ranges are dealt to at most; beyond it a task takes several ranges, one after another.
RANGE_TASKS = 20_000


def shingle_sets(batch: pa.RecordBatch, size: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row's text."""
    data, off = utf8(batch.column("text"))
    data = LOWER[data]
    starts, ends, before = words(data, off, BLACK)
    hashed = hash_words(data, starts, ends)
    wide, out = hash_windows(hashed, size), []
    for a, z in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if z - a >= size:
            out.append(np.unique(wide[a : z - size + 1]))
        else:
            out.append(hash_windows(hashed[a:z], z - a) if z > a else np.zeros(0, np.uint64))
    return out


def set_id(s: np.ndarray) -> int:
    if not len(s):
        return 0
    total = mix(np.array([s.sum(dtype=np.uint64), np.bitwise_xor.reduce(s) + np.uint64(len(s))]))
    return int((total[0] ^ (total[1] << np.uint64(1) | total[1] >> np.uint64(63))).view(np.int64))


def packed(sets: list[np.ndarray], bits: int) -> Iterator[tuple[int, bytes]]:
    """(range, bytes) of a block: 6 bytes of each shingle beyond the range's bits, in order, then 2 of its set's number."""
    h = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    own = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
    order = np.argsort(h)
    h, own = h[order], own[order]
    part = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
    cuts = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(h)])) if len(h) else np.zeros(1, np.int64)
    low = np.ascontiguousarray(((h << np.uint64(bits)) >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6])
    for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield int(part[a]), low[a:z].tobytes() + own[a:z].tobytes()


def repeats(source: DataFrame, sets_of, total: int, column: str) -> DataFrame:
    """(id, th, cid, n, rep) of every row: how many of a set's n shingles are in another set too.

    sets_of: batch -> ids, hashes of texts, sets.
    """
    ranges = max(1, int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // RANGE_SHINGLES)
    bits = min(40, (ranges - 1).bit_length())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        sets, number, meta, n = [], {}, [], 0

        def flush() -> pa.RecordBatch:
            parts, blobs = map(list, zip(*packed(sets, bits), strict=True)) if sets else ([], [])
            parts.append((1 << bits) + block % (1 << bits))
            blobs.append(pickle.dumps(meta))
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array([block] * len(parts), pa.int64()), pa.array(blobs, pa.binary())], names=["part", "block", "blob"])

        for batch in slices(batches, column):
            ids, texts, found = sets_of(batch)
            for i, t, s in zip(ids.to_pylist(), texts.to_pylist(), found, strict=True):
                cid = set_id(s)
                if len(s) and cid not in number:
                    number[cid] = len(sets)
                    sets.append(s)
                    n += len(s)
                meta.append((i, t, cid, len(s), number.get(cid, -1)))
            if n > PACK_SHINGLES or len(sets) > PACK_DOCS - 10_000 or len(meta) > 4 * PACK_DOCS:
                yield flush()
                block += 1
                sets, number, meta, n = [], {}, [], 0
        if meta:
            yield flush()

    def count(group: pa.Table) -> pa.Table:
        if group.column("part")[0].as_py() >= 1 << bits:
            return pa.table({"block": group.column("block"), "meta": pa.array([True] * len(group)), "blob": group.column("blob")})
        blobs = group.column("blob").to_pylist()
        sizes = [len(b) // 8 for b in blobs]
        low = np.zeros((sum(sizes), 8), np.uint8)
        np.concatenate([np.frombuffer(b, np.uint8, 6 * n).reshape(-1, 6) for b, n in zip(blobs, sizes, strict=True)], out=low[:, :6])
        low = low.view(np.uint64).ravel()
        order = np.argsort(low)
        same = low[order][1:] == low[order][:-1]
        again = np.zeros(len(low), bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        out, at = [], 0
        for b, n in zip(blobs, sizes, strict=True):
            own = np.frombuffer(b, np.uint16, n, 6 * n)
            out.append(np.bincount(own[again[at : at + n]]).astype(np.uint32).tobytes())
            at += n
        return pa.table({"block": group.column("block"), "meta": pa.array([False] * len(out)), "blob": pa.array(out, pa.binary())})

    def total_up(group: pa.Table) -> pa.Table:
        rep, meta = np.zeros(PACK_DOCS, np.int64), []
        for is_meta, blob in zip(group.column("meta").to_pylist(), group.column("blob").to_pylist(), strict=True):
            if is_meta:
                meta = pickle.loads(blob)
            else:
                c = np.frombuffer(blob, np.uint32)
                rep[: len(c)] += c
        i, t, cid, n, number = zip(*meta, strict=True)
        return pa.table({"id": pa.array(i, pa.int64()), "th": pa.array(t, pa.int64()), "cid": pa.array(cid, pa.int64()), "n": pa.array(n, pa.int64()), "rep": pa.array([int(rep[k]) if k >= 0 else 0 for k in number], pa.int64())})

    counted = source.mapInArrow(tidy(pack), "part long, block long, blob binary").repartition(min(ranges, RANGE_TASKS), "part").groupBy("part").applyInArrow(tidy(count), "block long, meta boolean, blob binary")
    return keep(counted.groupBy("block").applyInArrow(total_up, "id long, th long, cid long, n long, rep long"), "repeats")


def trie_join(sets: list[np.ndarray], probes: np.ndarray, labels: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between sets that bring two components together; each pair has a probe. Equal labels are connected already."""
    size = np.array([len(s) for s in sets])
    every, where, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.empty(len(every), np.int64)
    order[np.argsort(count, kind="stable")] = np.arange(len(every))
    ranked, at = order[where], 0
    single = int((count == 1).sum())  # these rank first and are in no overlap
    paths = []
    for n in size.tolist():
        p = np.sort(ranked[at : at + n])
        paths.append(p[np.searchsorted(p, single) :])
        at += n
    by_path = sorted(range(len(sets)), key=lambda i: paths[i].tolist())
    lcp = [0] * len(by_path)
    for k in range(1, len(by_path)):
        a, b = paths[by_path[k - 1]], paths[by_path[k]]
        m = min(len(a), len(b))
        diff = np.flatnonzero(a[:m] != b[:m])
        lcp[k] = int(diff[0]) if len(diff) else m
    # the next place with a shorter common beginning: from there to there is a subtree
    after, open_at = [len(lcp)] * len(lcp), []
    for k in range(len(lcp)):
        while open_at and lcp[open_at[-1]] > lcp[k]:
            after[open_at.pop()] = k
        open_at.append(k)
    parent = list(range(len(sets)))
    first: dict[int, int] = {}
    for i, x in enumerate(labels.tolist()):
        parent[i] = first.setdefault(x, i)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    links, mark = [], np.zeros(len(every) + 1, np.int64)
    most = max(map(len, paths))
    least = int(size.min())
    for k, i in enumerate(by_path):
        own = paths[i]
        mark[own] = 1
        ahead = np.zeros(most + 1, np.int64)  # ahead[d]: overlap of the first d shingles of the path walked last
        shared = len(own)  # the path shares its first `shared` shingles with ahead
        ahead[: len(own) + 1] = np.arange(len(own) + 1)
        n_i = int(size[i])
        floor = -(-percent * (n_i + max(least, -(-percent * n_i // 100))) // (100 + percent))
        home = root(i)
        m, dead = k, most + 2  # nothing can link among paths that begin like the last one down to depth `dead`
        while True:
            m += 1
            while m < len(by_path) and lcp[m] >= dead:
                m = after[m]
            if m >= len(by_path):
                break
            dead = most + 2
            if lcp[m] < shared:
                shared = lcp[m]
            j = by_path[m]
            n_j = int(size[j])
            if (not (probes[i] or probes[j])) or 100 * min(n_i, n_j) < percent * max(n_i, n_j) or root(j) == home:
                continue
            path = paths[j]
            tail = path[shared:]
            np.cumsum(mark[tail], out=ahead[shared + 1 : len(path) + 1])
            ahead[shared + 1 : len(path) + 1] += ahead[shared]
            overlap = int(ahead[len(path)])
            if 100 * overlap >= percent * (n_i + n_j - overlap):
                links.append((i, j))
                parent[root(j)] = home
            elif overlap < floor and len(path):
                # overlap so far and what the probe has left beyond the path's last shingle at each depth
                left = len(own) - np.searchsorted(own, path[shared:], side="right")
                short = np.flatnonzero(ahead[shared + 1 : len(path) + 1] + left < floor)
                if len(short):
                    dead = shared + 1 + int(short[0])
            shared = len(path)
        mark[own] = 0
    return links


def join_units(units: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """units: (u1, u2, u3, cid, probe, label), sets: (cid, s). Links (a, b) of each unit."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("cid")
        cid, raw = group.column("cid").to_numpy(), group.column("s").to_pylist()
        probe, label = np.array(group.column("probe").to_pylist()), group.column("label").to_numpy()
        single = np.flatnonzero(np.concatenate(([True], cid[1:] != cid[:-1])))
        probe = np.logical_or.reduceat(probe, single) if len(single) < len(cid) else probe
        links = trie_join([np.frombuffer(raw[i], np.uint64) for i in single], probe, label[single], percent) if len(single) > 1 else []
        return pa.table({"a": pa.array([int(cid[single[i]]) for i, _ in links], pa.int64()), "b": pa.array([int(cid[single[j]]) for _, j in links], pa.int64())})

    return keep(units.join(sets, "cid").groupBy("u1", "u2", "u3").applyInArrow(run, "a long, b long"))


def class_sets(docs: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """(cid, s) of the classes of rows(id, cid): the set of a text of each, made again."""
    lead = rows.groupBy("cid").agg(F.min(F.struct("id")).alias("d")).select(F.col("d.id").alias("lead")).distinct()

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = shingle_sets(batch, size)
            yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["cid", "s"])

    texts = docs.select("doc_id", "text").join(lead, F.col("doc_id").eqNullSafe(F.col("lead")), "left_semi")
    return keep(texts.select("text").mapInArrow(tidy(again), "cid long, s binary").dropDuplicates(["cid"]), "sets")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for a in range(0, whole.num_rows, 256):
            batch = whole.slice(a, 256)
            sets = [np.frombuffer(b, np.int64) for b in batch.column("s").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("cid").to_numpy(), [len(s) for s in sets])), pa.array(np.concatenate(sets))], names=["cid", "tok"])


def candidate_groups(sets: DataFrame, passed: DataFrame, percent: int) -> tuple[DataFrame, DataFrame] | None:
    """Groups (u1, c, cid): classes that share a shingle of their prefixes, directly or over others, and how many they are.
    Lists (pivot, cid): classes with a shingle of their prefixes whose smallest holder is the pivot, which is in it too.
    """
    tokens = sets.join(passed.select("cid"), "cid", "left_semi").mapInArrow(tidy(_tokens), "cid long, tok long")
    held = keep(tokens, "tokens")
    often = held.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1")
    inner = held.join(often, "tok").groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("t"))
    # shingles of one class come first; what is left of the prefix are the rarest others
    room = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1 - (F.col("n") - F.size("t"))
    prefix = inner.join(passed.select("cid", "n"), "cid").where(room > 0).select("cid", F.explode(F.slice("t", F.lit(1), room.cast("int"))).alias("p")).select("cid", "p.tok")
    prefix = keep(prefix, "prefixes")
    pivot = prefix.groupBy("tok").agg(F.min("cid").alias("pivot"))
    edges = keep(prefix.join(pivot, "tok").where("cid <> pivot").select(F.col("pivot").alias("a"), F.col("cid").alias("b")).distinct(), "edges")
    if edges.isEmpty():
        return None
    groups = keep(components(edges).select(F.col("node").alias("cid"), F.col("root").alias("u1")))
    lists = edges.select(F.col("a").alias("pivot"), F.col("b").alias("cid")).unionByName(edges.select(F.col("a").alias("pivot"), F.col("a").alias("cid")).distinct())
    return keep(groups.join(groups.groupBy("u1").agg(F.count("*").alias("c")), "u1")), lists


def class_components(docs: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame | None:
    """(cid, root) of linked classes; None where none link."""
    enough = lambda x: x.where(f"n > 0 and 100 * rep >= {percent} * n")
    first = enough(rows)
    if first.isEmpty():
        return None
    sets = class_sets(docs, first.select("id", "cid"), size)
    loaded = lambda batch: (batch.column("cid"), pa.nulls(batch.num_rows, pa.int64()), [np.frombuffer(b, np.uint64) for b in batch.column("s").to_pylist()])
    n = first.dropDuplicates(["cid"]).agg(F.sum("n")).collect()[0][0]
    passed = enough(repeats(sets, loaded, n, "s"))
    found = candidate_groups(sets, passed, percent)
    if found is None:
        return None
    groups, lists = found
    blocks = lambda n: F.ceil(n / (BLOCK / 2)).cast("int")
    part = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "cid"), n).cast("int")
    whole = groups.select("u1", F.lit(-1).alias("u2"), F.lit(-1).alias("u3"), "cid", "c").where(f"c <= {BLOCK}")
    dealt = [groups.where(f"c > {BLOCK}").select("u1", F.lit(salt).alias("u2"), part(salt, blocks(F.col("c"))).alias("u3"), "cid", "c") for salt in (0, 1)]
    units = whole.unionByName(dealt[0]).unionByName(dealt[1]).select("u1", "u2", "u3", "cid", F.lit(True).alias("probe"), F.col("cid").alias("label"))
    links = join_units(units, sets, percent)
    large = groups.where(f"c > {BLOCK}").select("cid")
    if not large.isEmpty():
        labels = components(links) if not links.isEmpty() else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        held = lists.join(large, "cid", "left_semi").join(labels.withColumnRenamed("node", "cid"), "cid", "left")
        now = keep(held.select(F.col("pivot").alias("u1"), "cid", F.coalesce("root", "cid").alias("label")))
        counts = now.groupBy("u1", "label").agg(F.count("*").alias("m"))
        major = counts.groupBy("u1").agg(F.max(F.struct("m", "label")).alias("top"), F.sum("m").alias("c")).select("u1", "c", F.col("top.label").alias("major"), (F.col("c") - F.col("top.m")).alias("others")).where("others > 0")
        left = keep(now.join(major, "u1"))
        rest = left.where("label <> major")
        fan = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
        ours = rest.select("u1", part(2, blocks(F.col("others"))).alias("u2"), fan(F.col("c")).alias("u3"), "cid", F.lit(True).alias("probe"), "label")
        theirs = left.select("u1", fan(F.col("others")).alias("u2"), part(3, blocks(F.col("c"))).alias("u3"), "cid", F.lit(False).alias("probe"), "label")
        links = links.unionByName(join_units(ours.unionByName(theirs), sets, percent))
    if links.isEmpty():
        return None
    return components(links).withColumnRenamed("node", "cid")


def _named(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, th, n_shingles, lead) of every row: lead is the (doc_id, th) of its component's first row, nulls last."""
    about = docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    source = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    counted = repeats(source, lambda batch: (batch.column("doc_id"), batch.column("th"), shingle_sets(batch, size)), about // 6, "text")
    rows = counted.select(F.col("id").alias("doc_id"), "th", "cid", F.col("n").alias("n_shingles"))
    roots = class_components(docs, counted, size, percent)
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    firsts = rows.where("n_shingles > 0").groupBy("cid").agg(F.min(own).alias("lead"))
    if roots is not None:
        rooted = firsts.join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        least = rooted.groupBy("root").agg(F.min("lead").alias("component"))
        firsts = rooted.join(least, "root").select("cid", F.col("component").alias("lead"))
    # classes with one row keep their own id, so only the others' rows meet, and a large class is split by the join
    named = rows.join(keep(firsts), "cid", "left")
    return named.select("doc_id", "th", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("lead", own)).otherwise(own).alias("lead"))


def near_duplicates(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    return _named(docs, size, percent).select("doc_id", "n_shingles", F.col("lead.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each component, the one with the smallest id, nulls last.

    A row goes by its id and its text, so another text under the same id stays. Rows that repeat the kept id and its text
    are one document and all stay.
    """
    named = _named(docs, size, percent)
    same = F.col("lead.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("lead.th") == F.col("th"))
    away = named.where(~same).select(F.col("doc_id").alias("away_id"), F.col("th").alias("away_th")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("th"))
    return rows.join(away, F.col("row.doc_id").eqNullSafe(F.col("away_id")) & (F.col("th") == F.col("away_th")), "left_anti").select("row.*")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE split AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) END AS s
  FROM split
), items AS (SELECT r, unnest(s) AS x FROM sets), sizes AS (SELECT r, doc_id, len(s) AS n FROM sets), shared AS (
  SELECT a.r AS a, b.r AS b, count(*) AS m FROM items a JOIN items b ON a.x = b.x AND a.r < b.r GROUP BY 1, 2
), links AS (
  SELECT s.a, s.b FROM shared s JOIN sizes p ON p.r = s.a JOIN sizes q ON q.r = s.b WHERE 100 * m >= 80 * (p.n + q.n - m)
), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links), reach AS (
  SELECT r, r AS x FROM sizes UNION SELECT reach.r, edges.b FROM reach JOIN edges ON reach.x = edges.a
)
SELECT s.doc_id, s.n AS n_shingles, (SELECT min(o.doc_id) FROM reach JOIN sizes o ON o.r = reach.x WHERE reach.r = s.r) AS component_id FROM sizes s
"""

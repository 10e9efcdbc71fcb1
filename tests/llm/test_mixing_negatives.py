"""Mixing against a plain computation, hard negatives against brute force over all pairs."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatelens.llm import mixing, negatives

# --- mixing ----------------------------------------------------------------------


def plain_targets(sizes, weights=(5, 2, 1), ratio=1.5, most=2):
    """Shares the excess of what is capped, round by round."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = dict.fromkeys(names, 0.0), set(names), ratio * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= most * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


def plain_draw(doc_id, text, seed):
    key = hashlib.md5(f"{'' if doc_id is None else doc_id}:{'' if text is None else hashlib.md5(text.encode()).hexdigest()}".encode()).hexdigest()
    return int(hashlib.md5(f"{key}:{seed // 4}".encode()).hexdigest()[seed % 4 * 8 :][:8], 16) / 2**32


def plain_mix(rows, seeds=mixing.SEEDS, with_rows=False):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, emitted = {}, []
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + size(text)
    target, out = plain_targets(sizes), []
    for source, total in sizes.items():
        rate = target[source] / total if total else 0.0
        mine = [r for r in rows if r[2] == source]
        copies = lambda seed: [int(rate) + (plain_draw(i, t, seed) < rate - int(rate)) for i, t, _ in mine]  # noqa: E731,B023
        best = min(range(seeds), key=lambda s: (abs(sum(c * size(t) for c, (_, t, _) in zip(copies(s), mine, strict=True)) - target[source]), s))  # noqa: B023
        emitted += list(zip(mine, copies(best), strict=True))
        out += [(i, size(t), total, pytest.approx(target[source]), c * size(t)) for c, (i, t, _) in zip(copies(best), mine, strict=True)]
    return emitted if with_rows else sorted(out, key=lambda r: (-1 if r[0] is None else r[0], r[1], r[4]))


def corpus(seed, n=400):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(int(rng.paretovariate(0.7)) % 3000)), rng.choices(["hot", "é", "Z", "a", "b", "", None], [9, 2, 2, 1, 1, 1, 1])[0]) for i in range(n)]
    rows += [(n, None, "hot"), (n + 1, "", "none"), (n + 2, "\t \n", "none"), (n + 3, "a b c\x0bd", "nbsp"), (7, "once again", "hot"), (7, "once again", "hot"), (None, "no id", "a"), (None, "none", None)]
    return rows


def mixed(spark, documents, saved, rows):
    d = saved(documents=documents([(i, t, "en", s) for i, t, s in rows]).withColumn("size", F.lit("x")).withColumn("rate", F.lit("x")).withColumn("skey", F.lit("x")))
    return sorted((tuple(r)[:5] for r in mixing.op11_mixing(spark, d).collect()), key=lambda r: (-1 if r[0] is None else r[0], r[1], r[4]))


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_is_the_plain_one(spark, documents, saved, seed):
    rows = corpus(seed)
    got = mixed(spark, documents, saved, rows)
    assert got == plain_mix(rows)
    assert all(r[4] <= 2 * r[1] for r in got)
    assert got == mixed(spark, documents, saved, rows[::-1])


def test_sources_beyond_the_broadcast_bound_give_the_same(spark, documents, saved, monkeypatch):
    rows = [*corpus(3, 200), *((1000 + i, "one two three four", f"s{i}") for i in range(120))]
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 3)
    assert mixed(spark, documents, saved, rows) == plain_mix(rows)


def test_mix_emits_copies_with_all_columns(spark, documents, saved):
    rows = corpus(4, 100)
    docs = documents([(i, t, "en", s) for i, t, s in rows]).withColumn("times", F.lit(1)).withColumn("row", F.lit(2))
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    emitted = {(r["doc_id"], r["text"], r["source"]): r["count"] for r in out.groupBy("doc_id", "text", "source").count().collect()}
    expected = {}
    for (i, t, s), r in zip(sorted(rows, key=str), sorted(plain_mix(rows, with_rows=True), key=lambda r: str(r[0])), strict=True):
        assert (i, t, s) == r[0]
        expected[i, t, s] = expected.get((i, t, s), 0) + r[1]
    assert emitted == {k: n for k, n in expected.items() if n}


def test_mix_of_nothing(spark, documents, saved):
    assert mixed(spark, documents, saved, []) == []
    assert mixed(spark, documents, saved, [(1, None, None), (2, "", "x")]) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


# --- hard negatives --------------------------------------------------------------


def plain_negatives(rows):
    sound, seen = [], set()
    for vec_id, v, label in rows:
        if None in (vec_id, label) or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        q = tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)
        row = (vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, q)
        if row not in seen:
            seen.add(row)
            sound.append(row)
    out = []
    for a, al, av in sound:
        if a % 50:
            continue
        scored = [(sum(x * y for x, y in zip(av, bv, strict=True)), b, bl) for b, bl, bv in sound if b != a and len(bv) == len(av)]
        best = lambda xs: sorted({(s, b) for s, b, _ in xs}, key=lambda x: (-x[0], x[1]))
        for ps, p in best(x for x in scored if x[2] == al)[:5]:  # noqa: B023
            for rank, (ns, n) in enumerate(best(x for x in scored if x[2] != al and 50 * ps <= 100 * x[0] <= 95 * ps)[:3], 1):  # noqa: B023
                out.append((a, p, rank, n, ps, ns))
    return sorted(out)


def mined(spark, rows, saved, parts=3):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(parts)
    return sorted(tuple(r) for r in negatives.op12_hard_negatives(spark, saved(embeddings=df.withColumn("score", F.lit("x")).withColumn("rank", F.lit(0)))).collect())


def vectors(seed, n=400, dim=6, spread=0.5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    return [(i, [float(x) for x in centres[rng.integers(6)] + spread * rng.normal(size=dim)], int(rng.integers(10))) for i in range(n)]


def test_negatives_are_brute_force(spark, saved):
    rows = vectors(1)
    assert mined(spark, rows, saved) == plain_negatives(rows)
    assert len(plain_negatives(rows)) > 60


def test_blocks_and_partitions_do_not_matter(spark, saved, monkeypatch):
    rows = vectors(2, 600, 4)
    monkeypatch.setattr(negatives, "BLOCK_VALUES", 8)
    assert mined(spark, rows, saved, 5) == plain_negatives(rows)


def test_tiles_are_cut_anywhere(spark, saved, monkeypatch):
    rows = vectors(3, 300, 3)
    small = lambda f: lambda anchors, candidates: ((slice(a, a + 2), slice(b, b + 7)) for a in range(0, anchors, 2) for b in range(0, candidates, 7))
    monkeypatch.setattr(negatives, "tiles", small(None))
    group = {"id": np.array([r[0] for r in rows]), "label": np.array([r[2] for r in rows]), "matrix": np.floor(256 * np.array([r[1] for r in rows]))}
    best = negatives.Best(len(rows), 5)
    negatives.best_positives(group, best, group["id"], group["label"], group["matrix"])
    score = (group["matrix"] @ group["matrix"].T).astype(int)
    for a, (i, _, label) in enumerate(rows):
        others = sorted((-score[a, b], j) for b, (j, _, other) in enumerate(rows) if other == label and j != i)
        assert [(-s, j) for s, j in zip(best.score[a], best.id[a], strict=True) if s != negatives.NONE] == others[:5]


def test_ties_copies_and_odd_rows(spark, saved):
    rows = [(i, [1.0, 0.5], i % 3) for i in range(60)] + [(100 + i, [0.8, 0.4], i % 4) for i in range(30)]
    rows += [(150, None, 1), (200, [1.0, None], 1), (250, [1.0, float("nan")], 1), (300, [1.0, float("inf")], 1), (350, [1.0, 0.5], None), (None, [1.0, 0.5], 1), (400, [], 1), (401, [], 1), (402, [], 2)]
    rows += [(450, [0.0, 0.0], 2), (500, [-1.0, -0.5], 2), (501, [-1.0, -0.5], 2), (550, [1.0, 0.5, 0.25], 5), (551, [1.0, 0.5, 0.25], 5), (552, [0.7, 0.5, 0.25], 6), (600, [9.0], 9)]
    rows += rows[:20] + [(50, [0.5, 0.5], 2), (50, [0.9, 0.5], 1)]
    assert mined(spark, rows, saved) == plain_negatives(rows)


def test_large_numbers_stay_exact(spark, saved):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=3) * 3e5], int(rng.integers(2))) for i in range(101)]
    assert mined(spark, rows, saved) == plain_negatives(rows)
    assert mined(spark, [], saved) == []

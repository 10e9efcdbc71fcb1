"""Exact repair against enumeration, witnesses of worlds against the search world by world, and edits."""

import itertools
import random

import pytest

from gatelens.operators import hitting, reach, repair


def brute(sets, cost):
    best = None
    for k in range(1 << len(cost)):
        if all(s & k for s in sets):
            spent = sum(c for o, c in enumerate(cost) if k >> o & 1)
            best = spent if best is None else min(best, spent)
    return best


@pytest.mark.parametrize("seed", range(60))
def test_cheapest_hit_is_that_of_enumeration(seed):
    draw = random.Random(seed)
    n = draw.randint(1, 11)
    cost = [draw.choice([0.0, 1.0, 1.0, 2.5, 5.0]) for _ in range(n)]
    sets = [sum(1 << o for o in draw.sample(range(n), draw.randint(1, min(n, 4)))) for _ in range(draw.randint(0, 25))]
    spent, chosen = hitting.cheapest_hit(sets, cost)
    assert spent == pytest.approx(brute(sets, cost)) == pytest.approx(sum(cost[o] for o in chosen))
    assert all(any(s >> o & 1 for o in chosen) for s in sets)
    assert hitting.dual_bound((1 << len(sets)) - 1, sets, (1 << n) - 1, cost) <= spent + 1e-9
    assert hitting.cheapest_hit([*sets, 0], cost) is None


def test_hundreds_of_options_are_solved():
    draw = random.Random(1)
    groups = [[g * 8 + i for i in range(8)] for g in range(40)]
    sets = [sum(1 << o for o in draw.sample(draw.choice(groups), 3)) for _ in range(900)]
    cost = [1.0 + draw.randrange(5) for _ in range(320)]
    spent, _ = hitting.cheapest_hit(sets, cost)
    apart = 0.0
    for g in groups:
        mine = {s >> g[0] for s in sets if s >> g[0] & 255 and not s >> (g[0] + 8) and not s & ((1 << g[0]) - 1)}
        apart += brute(list(mine), cost[g[0] : g[0] + 8])
    assert spent == pytest.approx(apart)


def test_parts_are_solved_apart_and_stuck_paths_show(spark):
    rows = [("p1", "a"), ("p1", "b"), ("p2", "b"), ("p2", "c"), ("q1", "x"), ("q1", "y"), ("p1", "b"), ("q2", "y"), ("q2", "x")]
    costs = spark.createDataFrame([("a", 1.0), ("b", 1.5), ("c", 1.0), ("x", 3.0), ("y", 2.0), ("idle", 0.5)], "option string, cost double")
    got = hitting.cheapest(spark.createDataFrame(rows, "path_id string, option string"), costs).collect()
    assert sorted((r["option"], r["cost"], r["solved"]) for r in got) == [("b", 1.5, True), ("y", 2.0, True)]
    assert len({r["component"] for r in got}) == 2
    stuck = hitting.cheapest(spark.createDataFrame([*rows, ("bad", None), ("worse", "unpriced")], "path_id string, option string"), costs)
    assert [r["solved"] for r in stuck.where("not solved").collect()] == [False]
    assert hitting.cheapest(spark.createDataFrame([], "path_id string, option string"), costs).collect() == []


def test_exact_cuts_of_actions(spark):
    paths = spark.createDataFrame([(1, "a:1"), (1, "a:2"), (2, "a:3"), (3, "a:3"), (3, "a:1")], "path_id int, action string")
    acts = [("a:1", True, True, True), ("a:2", False, False, False), ("a:3", False, False, False), ("a:4", True, True, False)]
    shape = "action string, scopable boolean, breaks_if_scoped boolean, needed boolean"
    got = hitting.exact_cuts(paths, spark.createDataFrame(acts, shape), 1.0, 5.0).collect()
    assert sorted(tuple(r) for r in got) == [("a:1", "scope", 1.0, 6.0), ("a:2", "keep", 0.0, 6.0), ("a:3", "remove", 5.0, 6.0), ("a:4", "keep", 0.0, 6.0)]
    held = [(a, False, b, True) for a, _, b, _ in acts]
    assert hitting.exact_cuts(paths, spark.createDataFrame(held, shape), 1.0, 5.0).collect() == []
    none = hitting.exact_cuts(paths.limit(0), spark.createDataFrame(held, shape), 1.0, 5.0).collect()
    assert {(r["choice"], r["total"]) for r in none} == {("keep", 0.0)}


def connected(edges, a, b):
    seen, front = set(), [a]
    while front:
        x = front.pop()
        new = {t for s, t in edges if s == x} - seen
        seen |= new
        front += new
    return b in seen


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cheapest_cuts_are_those_of_enumeration(spark, seed):
    draw, samples = random.Random(seed), 3
    some = lambda n: {(f"n{draw.randrange(8)}", f"n{draw.randrange(8)}") for _ in range(n)}
    fixed, per = some(7), [some(5) for _ in range(samples)]
    pairs = [(a, b) for a in ("n0", "n1") for b in ("n6", "n7")]
    edges = sorted(fixed.union(*per))
    cut = {f"o{i}": (float(draw.randint(1, 4)), draw.sample(edges, draw.randint(1, 2))) for i in range(9)}
    if seed != 3:
        cut |= {f"e{i}": (3.0, [e]) for i, e in enumerate(edges)}
    best = None
    used = [draw.choice(edges)]
    allowed = {k: v for k, v in cut.items() if not set(v[1]) & set(used)}
    ends = {e for e in edges if any(e in v[1] for v in allowed.values())}
    for k in range(len(allowed) + 1):
        for chosen in itertools.combinations(sorted(allowed), k) if k <= 4 else ():
            gone = {e for o in chosen for e in allowed[o][1]}
            if not any(connected((fixed | w) - gone, a, b) for w in per for a, b in pairs):
                spent = sum(allowed[o][0] for o in chosen)
                best = spent if best is None else min(best, spent)
    hopeless = any(connected((fixed | w) - ends, a, b) for w in per for a, b in pairs)
    frame = lambda rows, shape: spark.createDataFrame(rows, shape)
    got = hitting.cheapest_cuts(
        frame(sorted(fixed), "src string, dst string"), frame([(i, *e) for i, w in enumerate(per) for e in sorted(w)], "sample_id int, src string, dst string"), frame(pairs, "source string, target string"),
        frame([(o, c, *e) for o, (c, es) in cut.items() for e in es], "option string, cost double, src string, dst string"), samples, frame(used, "src string, dst string"),
    )
    if hopeless:
        assert got is None
        return
    taken = got.collect()
    gone = {e for r in taken for e in allowed[r["option"]][1]}
    assert not any(connected((fixed | w) - gone, a, b) for w in per for a, b in pairs)
    if best is not None:
        assert sum(r["cost"] for r in taken) <= best + 1e-9 and (len(taken) > 4 or sum(r["cost"] for r in taken) == pytest.approx(best))


def test_world_paths_are_the_witnesses_of_each_world(spark):
    draw, samples = random.Random(6), 70
    some = lambda n: {(f"n{draw.randrange(9)}", f"n{draw.randrange(9)}") for _ in range(n)}
    shared = spark.createDataFrame(sorted(some(6)), "src string, dst string")
    worlds = spark.createDataFrame([(i, *e) for i in range(samples) for e in sorted(some(7))], "sample_id int, src string, dst string")
    ends = [spark.createDataFrame([(x,) for x in xs], "id string") for xs in (("n0", "n1", "n2"), ("n2", "n7", "n8"))]
    every = spark.range(samples).selectExpr("cast(id as int) as sample_id")
    expected = {tuple(r) for r in reach.reach(worlds, *ends, 5, True, ["sample_id"], shared, every).select("sample_id", "source", "target", "hops", "path").collect()}
    got = [(r["chunk"] * 64 + b, r["source"], r["target"], r["hops"], r["path"]) for r in reach.world_paths(shared, worlds, *ends, samples, 5).collect() for b in range(64) if r["mask"] >> b & 1]
    assert len(got) == len(set(got)) and set(got) == expected


def test_edits_leave_what_they_do_not_mean(spark):
    shape = "policy_id string, sid string, effect string, action array<string>, not_action array<string>, resource array<string>"
    rows = [("p", "a", "Allow", ["x:z", "x:y"], [], ["*"]), ("p", "a", "Deny", [], ["x:q"], ["*"]), ("p", "a", "Deny", None, ["x:q"], ["*"]), ("q", "a", "Allow", ["x:z"], [], ["*"]), ("p", None, "Allow", ["x:z"], [], ["*"]), ("p", "b", "Allow", ["x:z"], [], ["*"])]
    s = spark.createDataFrame(rows, shape)
    plain = lambda df: sorted(([*map(str, tuple(r)[:3]), str(r["action"])] for r in df.collect()))
    whole = lambda drop, change=(): sorted([str(p), str(i), e, str(change[1] if change and k == change[0] else a)] for k, (p, i, e, a, _, _) in enumerate(rows) if k not in drop)
    assert plain(repair.RemoveAction("a", "x:none").apply(s)) == whole(())
    assert plain(repair.RemoveAction("a", "X:z ").apply(s)) == whole((3,), (0, ["x:y"]))
    assert plain(repair.RemoveAction("a", "x:z", "p").apply(s)) == whole((), (0, ["x:y"]))
    assert plain(repair.RemoveAction("a", "x:z", "q").apply(s)) == whole((3,))
    scoped = repair.ScopeResource("a", "x:z", ["r"], "q").apply(s).where("resource[0] = 'r'").collect()
    assert [(r["policy_id"], r["sid"]) for r in scoped] == [("q", "a")]

"""Graph, reachability, worlds, repair, verification on literal graphs with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from gatelens.functions import metrics
from gatelens.operators import capability, graph, masking, pairs, policy, reach, repair, synthesis, triage, uncertain, verify, vocabulary, workload

NODE = "id string, node_type string, department string, account_id string, is_admin boolean, is_high_value boolean"
EDGE = "src string, dst string, relation string, is_bridge boolean"


@pytest.fixture
def chain(spark):
    """An intern takes on a role, which over a bridge takes on an admin role, which acts on a vault."""
    nodes = spark.createDataFrame([("intern", "User", "Interns", "1", False, False), ("dev", "Role", "DevOps", "1", False, False), ("admin", "Role", "SecOps", "1", True, True), ("vault", "Resource", "SecOps", "1", False, True), ("root", "User", "SecOps", "1", True, False)], NODE)
    edges = spark.createDataFrame([("intern", "dev", "AssumesRole", False), ("dev", "admin", "AssumesRole", True), ("admin", "vault", "ActsOn", False), ("root", "admin", "AssumesRole", False)], EDGE)
    return nodes, edges


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_reach_and_escalation(chain):
    n, e = chain
    w = reach.reach(e, graph.default_sources(n), graph.default_targets(n), 8, True)
    assert ("intern", "admin", 2, "intern>dev>admin") in rows(w) and ("intern", "vault", 3, "intern>dev>admin>vault") in rows(w)
    got = {(r["source"], r["target"]): (r["is_bridge"], r["is_escalation"]) for r in reach.label_escalations(w, e, n).collect()}
    assert got[("intern", "vault")] == (True, True) and got[("root", "admin")] == (False, False)
    assert rows(reach.reach(e, n.select("id"), n.where("id = 'vault'").select("id"), 2)) == [("admin", "vault", 1), ("dev", "vault", 2), ("root", "vault", 2)]


def test_severance_and_recall(chain):
    n, e = chain
    w = reach.reach(e, graph.default_sources(n), graph.default_targets(n))
    cut = {(r["source"], r["target"]): r["severed"] for r in reach.severed(w, e).collect()}
    assert cut[("intern", "vault")] and not cut[("root", "vault")]
    seen, hidden = masking.mask(e, n, "E")
    assert hidden.count() == 1 and seen.count() == 3
    assert reach.recall(w.limit(0), w.limit(0)).collect()[0]["recall"] == 1.0


def test_parallel_edges_and_simple_paths(spark):
    e = spark.createDataFrame([("a", "b", "X", False), ("a", "b", "Y", True), ("b", "d", "X", False), ("a", "c", "X", False), ("c", "d", "X", False), ("d", "a", "X", False)], EDGE)
    pair = spark.createDataFrame([("a", "d")], "source string, target string")
    assert rows(reach.simple_paths(e, pair)) == [("a", "d", "a>b>d", 2), ("a", "d", "a>c>d", 2)]
    legs = reach.path_edges(spark.createDataFrame([("a", "d", "a>b>d")], "source string, target string, path string"), e)
    assert {(r["pos"], r["relation"]) for r in legs.collect()} == {(0, "Y"), (1, "X")}


def test_store_operations(spark, chain):
    n, e = chain
    new = spark.createDataFrame([("intern", "dev", "AssumesRole", True)], EDGE)
    assert graph.add_edges(n, e, new).where("is_bridge").count() == 2 and graph.remove_edges(e, new).count() == 3
    with pytest.raises(Exception, match="no such node"):
        graph.add_edges(n, e, spark.createDataFrame([("intern", "nowhere", "X", False)], EDGE)).collect()
    assert graph.find_edges(e, src="dev").count() == 1 and graph.find_nodes(n, admin=True).count() == 2 and graph.dangling_edges(n, e).count() == 0


def test_components_and_pagerank(spark):
    n = spark.createDataFrame([(x,) for x in "abcdef"], "id string")
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "f")], "src string, dst string")
    weak = {r["id"]: r["component"] for r in graph.weak_components(n, e).collect()}
    strong = {r["id"]: r["component"] for r in graph.strong_components(n, e).collect()}
    assert len(set(weak.values())) == 2 and strong["a"] == strong["b"] == strong["c"] and len(set(strong.values())) == 4
    ids, rank = "abcdef", dict.fromkeys("abcdef", 1 / 6)
    out = {"a": ["b"], "b": ["c"], "c": ["a", "d"], "e": ["f"]}
    for _ in range(20):
        lost = sum(rank[x] for x in ids if x not in out)
        rank = {x: 0.15 / 6 + 0.85 * lost / 6 + 0.85 * sum(rank[y] / len(t) for y, t in out.items() if x in t) for x in ids}
    got = {r["id"]: r["rank"] for r in graph.pagerank(n, e).collect()}
    assert all(abs(got[x] - rank[x]) < 1e-12 for x in ids)


def test_strong_components_of_a_long_cycle(spark):
    n = spark.range(1, 13).select(F.col("id").cast("int").alias("id"))
    e = n.select(F.col("id").alias("src"), (F.col("id") % 12 + 1).alias("dst"))
    assert {r["component"] for r in graph.strong_components(n, e).collect()} == {12}


def test_worlds_converge(spark):
    e = lambda rows: spark.createDataFrame(rows, "src string, dst string, relation string, probability double")
    s, t = spark.createDataFrame([("s",)], "id string"), spark.createDataFrame([("t",)], "id string")
    none = e([]).select("src", "dst", "relation")
    m = 2000
    diamond = e([("s", "a", "X", 0.6), ("a", "t", "X", 0.6), ("s", "b", "X", 0.6), ("b", "t", "X", 0.6)])
    f = uncertain.world_reach(none, uncertain.sample_worlds(diamond, m), s, t, m)
    assert abs(f.collect()[0]["frequency"] - 0.5904) < 0.035
    p = uncertain.product_comparison(f, diamond, m).collect()[0]
    assert abs(p["product"] - 0.1296) < 1e-9 and not p["consistent"]
    line = e([("s", "a", "X", 0.8), ("a", "t", "X", 0.7)])
    f = uncertain.world_reach(none, uncertain.sample_worlds(line, m), s, t, m)
    assert abs(f.collect()[0]["frequency"] - 0.56) < 0.035
    asked = spark.createDataFrame([("s", "t"), ("t", "s")], "source string, target string")
    assert {r["target"]: r["frequency"] for r in uncertain.with_zeros(f, asked).collect()}["s"] == 0.0


def test_metrics_golden(spark):
    make = lambda y, s, b=None: spark.createDataFrame([("m", a, v, str(i), bool(b and b[i])) for i, (a, v) in enumerate(zip(y, s, strict=True))], "model string, y int, score double, tie string, is_bridge boolean")
    one = lambda df: df.collect()[0]
    perfect = make([1, 1, 0, 0], [0.9, 0.8, 0.2, 0.1])
    assert one(metrics.pr_auc(perfect, ["model"]))["pr_auc"] == 1.0 and one(metrics.roc_auc(perfect, ["model"]))["roc_auc"] == 1.0
    assert one(metrics.roc_auc(make([1, 1], [0.5, 0.2]), ["model"]))["roc_auc"] == 0.5 and one(metrics.pr_auc(make([0, 0], [0.5, 0.2]), ["model"]))["pr_auc"] == 0.0
    r = one(metrics.recall_at_k(make([1, 0, 1, 0], [0.9, 0.8, 0.7, 0.1]), ["model"], [1, 3]))
    assert (r["recall_at_1"], r["recall_at_3"]) == (0.5, 1.0)
    f = make([1, 1, 0, 0], [0.8, 0.3, 0.1, 0.2])
    assert one(metrics.false_negative_rate(f, ["model"]))["fnr"] == 0.5 and one(metrics.false_negative_rate(f, ["model"], 0.2))["fnr"] == 0
    assert one(metrics.reciprocal_rank(make([0, 1, 1, 0], [0.9, 0.8, 0.7, 0.1]), ["model"]))["mrr"] == 0.5
    wide = make([int(i in (4, 24, 119)) for i in range(150)], [1 - i / 200 for i in range(150)], [i in (4, 24, 119) for i in range(150)])
    r = one(metrics.path_recovery_at_k(wide, ["model"], [10, 50, 150]))
    assert [round(r[f"recovery_at_{k}"], 4) for k in (10, 50, 150)] == [0.3333, 0.6667, 1.0]
    bins = metrics.calibration_bins(make([1, 0], [0.3, 1.0]), ["model"]).where("n > 0").collect()
    assert {b["bin"] for b in bins} == {2, 9} or {b["bin"] for b in bins} == {3, 9}
    ci = one(metrics.confidence_interval(spark.createDataFrame([("g", 0.9), ("g", 1.0)], "g string, v double"), ["g"], "v"))
    assert ci["high"] == 1.0 and abs(ci["mean"] - 0.95) < 1e-12


def test_temperature(spark):
    import math
    import random

    r = random.Random(1)
    data = [(int(r.random() < 1 / (1 + math.exp(-z))), 3.0 * z) for z in (r.gauss(0, 2) for _ in range(4000))]
    assert abs(metrics.fit_temperature(spark.createDataFrame(data, "y int, logit double")) - 3.0) < 0.4


def test_repair_and_verify(spark, chain):
    s = spark.createDataFrame([("s1", ["a:X", "a:Y"], ["*"]), ("s2", ["a:X"], ["*"])], "sid string, action array<string>, resource array<string>")
    scoped = {r["sid"]: (r["action"], r["resource"]) for r in repair.ScopeResource("s1", "A:x", ["r"]).apply(s).collect()}
    assert scoped["s1"] == (["a:Y"], ["*"]) and scoped["s1_Scoped"] == (["A:x"], ["r"])
    assert {r["sid"] for r in repair.RemoveAction("s2", "a:x").apply(s).collect()} == {"s1"}
    n, e = chain
    worlds = spark.createDataFrame([(i, "dev", "vault", "X") for i in range(10)], "sample_id int, src string, dst string, relation string")
    pair = spark.createDataFrame([("intern", "vault")], "source string, target string")
    fixed = e.where("not is_bridge")
    got = verify.three_levels(e, fixed, e.select("src", "dst").unionByName(spark.createDataFrame([("dev", "vault")], "src string, dst string")), worlds, pair, 10).collect()[0]
    assert (got["l1"], got["l2"], got["l3"], got["status"]) == (0.0, 1.0, 1.0, "MISLEADING_SAFE")
    assert rows(verify.side_effects(fixed, e, n)) == [(a, b) for a in ("dev", "intern") for b in ("admin", "vault")]
    options = spark.createDataFrame([("cut-bridge", 1.0, "dev", "admin"), ("cut-latent", 1.0, "dev", "vault"), ("cut-both", 10.0, "dev", "admin"), ("cut-both", 10.0, "dev", "vault"), ("cut-first", 4.0, "intern", "dev")], "option string, cost double, src string, dst string")
    steps = repair.greedy_cuts(e, worlds, pair, options, 10).orderBy("step").collect()
    assert steps[-1]["risk"] == 0.0 and [x["option"] for x in steps] == ["cut-first"]


def test_greedy_cuts_are_those_of_brute_force(spark):
    draw, samples = random.Random(5), 3
    some = lambda n: {(f"n{draw.randrange(9)}", f"n{draw.randrange(9)}") for _ in range(n)}
    fixed, per = some(9), [some(6) for _ in range(samples)]
    pairs_ = [(a, b) for a in ("n0", "n1", "n2") for b in ("n7", "n8")]
    options = sorted(fixed.union(*per))

    def risk(cut):
        hits = 0
        for world in per:
            edges, total = (fixed | world) - cut, 0
            for a, b in pairs_:
                seen, front = set(), [a]
                while front:
                    x = front.pop()
                    front += [t for s, t in edges if s == x and t not in seen]
                    seen |= {t for s, t in edges if s == x}
                total += b in seen
            hits += total
        return hits / samples / len(pairs_)

    want, cut, now = [], set(), risk(set())
    while now > 0 and len(want) < 4:
        best = min(((risk(cut | {e}), "|".join(e), e) for e in options if e not in cut))
        if now - best[0] <= 1e-6:
            break
        want.append((len(want) + 1, best[1], round(best[0], 9)))
        cut, now = cut | {best[2]}, best[0]
    frame = lambda rows, schema: spark.createDataFrame(sorted(rows), schema)
    got = repair.greedy_cuts(frame(fixed, "src string, dst string"), frame({(i, *e) for i, w in enumerate(per) for e in w}, "sample_id int, src string, dst string"), frame(pairs_, "source string, target string"),
                             frame({("|".join(e), 1.0, *e) for e in options}, "option string, cost double, src string, dst string"), samples, most=4)
    assert want and [(r["step"], r["option"], round(r["risk"], 9)) for r in got.orderBy("step").collect()] == want


def test_greedy_cuts_evaluates_every_option(spark):
    e = spark.createDataFrame([("s", "a"), ("a", "t"), ("a", "b"), ("b", "t"), ("x", "y")], "src string, dst string")
    worlds = spark.createDataFrame([], "sample_id int, src string, dst string")
    pair = spark.createDataFrame([("s", "t")], "source string, target string")
    idle = [(f"n{i:04}|x", 1.0, "x", "y") for i in range(1000)]
    options = spark.createDataFrame([*idle, ("n0|half", 1.0, "a", "t"), ("z|best", 1.0, "s", "a")], "option string, cost double, src string, dst string")
    # the best of 1002 options sorts last, and names may hold any sign
    assert [tuple(r) for r in repair.greedy_cuts(e, worlds, pair, options, 2).collect()] == [(1, "z|best", 1.0, 0.0)]
    used = spark.createDataFrame([("s", "a")], "src string, dst string")
    assert repair.greedy_cuts(e, worlds, pair, options, 2, used=used).collect() == []


ROLE = "arn:aws:iam::1:role/"


def _patches(spark, used, statements, most=20):
    """An intern whose policies let it take on two roles, and reach the vault over the admin one; used: roles in the log."""
    nodes = spark.createDataFrame([("intern", "arn:aws:iam::1:user/intern"), ("admin", ROLE + "admin"), ("dev", ROLE + "dev"), ("vault", "arn:aws:s3:::vault"), ("p", "arn:aws:iam::1:policy/p"), ("q", "arn:aws:iam::1:policy/q")], "id string, arn string")
    e = spark.createDataFrame([("intern", "admin", "AssumesRole", ["sts:AssumeRole"]), ("intern", "dev", "AssumesRole", ["sts:AssumeRole"]), ("admin", "vault", "ActsOn", ["s3:GetObject"]), ("intern", "p", "AttachedWith", []), ("intern", "q", "AttachedWith", [])], "src string, dst string, relation string, actions array<string>")
    s = spark.createDataFrame([(pol, sid, effect, None, None, acts, None, res, None, None) for pol, sid, effect, acts, res in statements], f"policy_id string, {policy.STATEMENT}")
    log = spark.createDataFrame([(f"r{i}", "arn:aws:iam::1:user/intern", a, r, {}, ["p", "q"]) for i, (a, r) in enumerate(used)], "req_id string, principal_arn string, action string, resource_arn string, context map<string, array<string>>, policy_ids array<string>")
    worlds = spark.createDataFrame([(0, "dev", "vault")], "sample_id int, src string, dst string")
    pair = spark.createDataFrame([("intern", "vault")], "source string, target string")
    got = repair.greedy_patches(e, worlds, pair, s, e.where("relation = 'AssumesRole'"), log, nodes, capability.snapshot(spark), 4, most=most)
    return s, got, [(r["sid"], r["action"], r["edit"], r["resources"], r["cost"], r["risk"]) for r in got.orderBy("step").collect()]


def test_patches_scope_what_the_log_needs(spark):
    s, got, taken = _patches(spark, [("sts:AssumeRole", ROLE + "dev"), ("s3:GetObject", "arn:aws:s3:::a/b")], [("p", "s1", "Allow", ["sts:AssumeRole", "s3:GetObject"], ["*"])])
    # one world goes on over dev, which the log needs
    assert taken == [("s1", "sts:assumerole", "scope", [ROLE + "dev"], 1.0, 0.25)]
    after = {r["sid"]: (r["action"], r["resource"]) for r in repair.apply_patches(s, got).collect()}
    assert after == {"s1": (["s3:GetObject"], ["*"]), "s1_Scoped": (["sts:assumerole"], [ROLE + "dev"])}


def test_patches_remove_what_no_log_names_and_keep_what_it_uses(spark):
    s, got, taken = _patches(spark, [], [("p", "s1", "Allow", ["sts:AssumeRole"], ["*"])])
    assert taken == [("s1", "sts:assumerole", "remove", None, 5.0, 0.0)]
    assert repair.apply_patches(s, got).count() == 0
    assert _patches(spark, [("sts:AssumeRole", ROLE + "admin")], [("p", "s1", "Allow", ["sts:AssumeRole"], ["*"])])[2] == []
    # wildcard actions are unknown to the capability model, so they can only be taken out, and here the log needs them
    assert _patches(spark, [("sts:AssumeRole", ROLE + "dev")], [("p", "s1", "Allow", ["sts:*"], ["*"])])[2] == []


def test_patches_see_every_way_a_request_is_allowed(spark):
    twice = [("p", "s1", "Allow", ["sts:AssumeRole"], ["*"]), ("q", "s2", "Allow", ["sts:AssumeRole"], [ROLE + "dev"])]
    _, _, taken = _patches(spark, [("sts:AssumeRole", ROLE + "dev")], twice)
    # without s1 the request would still be allowed, but narrowing costs less; then either is enough for the edge to dev
    assert taken == [("s1", "sts:assumerole", "scope", [ROLE + "dev"], 1.0, 0.25)]
    with pytest.raises(ValueError, match="1 requests"):
        _patches(spark, [("sts:AssumeRole", ROLE + "dev")], [*twice, ("q", "s3", "Deny", ["sts:*"], ["*"])])


def test_pareto(spark):
    p = spark.createDataFrame([("none", 1.0, 0.0, 0.0), ("coarse", 0.0, 0.17, 10.0), ("log", 0.0, 0.0082, 4.0), ("ours", 0.0, 0.0, 1.0), ("twin", 0.0, 0.0, 1.0)], "method string, level3_risk double, t2_breakage double, transformation_cost double")
    f = {r["method"]: r for r in verify.frontier(p).collect()}
    assert {m for m, r in f.items() if r["on_frontier"]} == {"none", "ours", "twin"} and f["ours"]["dominates"] == "coarse,log"
    assert tuple(verify.certify(p, "ours").collect()[0]) == (True, True, True)


def test_triage(spark):
    n = spark.createDataFrame([("u", "User", "Fin", "1", False, False), ("r", "Role", None, "1", True, False)], NODE)
    t = triage.records(n, spark.createDataFrame([("u", "x", 0.4), ("u", "y", 0.7)], "source string, target string, frequency double"))
    assert {(r["id"], r["severity"], r["blast_radius"]) for r in t.collect()} == {("u", "CRITICAL", 2), ("r", "LOW", 0)}
    assert triage.search(t, text="CRIT").count() == 1 and triage.posture(t).collect()[0]["flagged"] == 1 and triage.display(t).where("department = 'Unknown'").count() == 1


def test_motifs_and_topology(spark):
    for name in ("passrole_lambda", "assume_role_chain", "create_policy_version"):
        n, e = synthesis.inject(spark, name, 2)
        assert {(r["connected"], r["severed"]) for r in synthesis.motif_truth(n, e).collect()} == {(True, True)}
    n, e = synthesis.topology(spark, 500, "1")
    assert n.count() == n.select("id").distinct().count() == 500 and graph.dangling_edges(n, e).count() == 0
    assert rows(e) == rows(synthesis.topology(spark, 500, "1")[1]) != rows(synthesis.topology(spark, 500, "2")[1])


def test_masks_split_edges(spark):
    n, e = synthesis.topology(spark, 400)
    for letter in "ABCDE":
        seen, hidden = masking.mask(e, n, letter)
        assert seen.count() + hidden.count() == e.count() and seen.join(hidden, graph.TRIPLE, "left_semi").count() == 0
    neg = masking.negatives(e, n, "AssumesRole", "User", "Role", 0.5)
    assert neg.count() == round(e.where("relation = 'AssumesRole'").count() * 0.5) and neg.join(e.where("relation = 'AssumesRole'"), ["src", "dst"], "left_semi").count() == 0


def test_pair_features(spark, chain):
    n, e = chain
    p = spark.createDataFrame([("intern", "admin"), ("root", "dev")], "u string, v string")
    f = {r["u"]: r for r in pairs.features(p, e, n).collect()}
    assert f["intern"]["common_neighbours"] == 1 and f["intern"]["forward_path"] == 2 and f["root"]["forward_path"] == 7 and len(f["root"]) == 26


def test_workload(spark):
    ev = spark.createDataFrame([("1", "p", "a", "r", 1.0), ("2", "p", "a", "r2", 95.0), ("3", "p", "a", "r", 120.0), ("4", "p", "a", "r", 121.0)], "req_id string, principal_arn string, action string, resource_arn string, day_offset double")
    w = workload.split_days(ev)
    assert {r["req_id"]: r["win"] for r in w.collect()} == {"1": "T1", "2": "T2", "3": "T2"}
    assert workload.drift_rate(w).collect()[0]["rate"] == 0.5 and rows(workload.drift(w)) == [("resource", "r2")]
    ops = spark.createDataFrame([("p", "a", f"r{i}", i % 2 == 0) for i in range(6)], "principal string, action string, resource string, routine boolean")
    s = workload.synthesize(ops, 30, 10, 20)
    assert s.count() == 800 and s.where("is_drift and day_offset < 30").count() == 0 and 0 < s.where("is_drift").count() < 100
    assert s.where(F.col("drift_type") == "resource").where("not resource_arn like '%-new-%'").count() == 0


def test_strong_components_of_a_long_chain_with_a_cycle(spark):
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(14)] + [("z1", "z2"), ("z2", "z3"), ("z3", "z1"), ("c014", "z1")]
    nodes = spark.createDataFrame([(x,) for x in sorted({y for e in chain for y in e}) + ["alone"]], "id string")
    got = dict(map(tuple, graph.strong_components(nodes, spark.createDataFrame(chain, "src string, dst string")).collect()))
    assert {got[x] for x in ("z1", "z2", "z3")} == {"z3"} and all(got[x] == x for x in got if not x.startswith("z")) and len(got) == 19


def test_world_hits_count_worlds_beyond_one_number(spark):
    samples = 130
    shared = spark.createDataFrame([("a", "b"), ("c", "d")], "src string, dst string")
    worlds = spark.createDataFrame([(i, "b", "c") for i in range(samples) if i % 3 == 0] + [(i, "b", "d") for i in range(samples) if i % 2 == 0], "sample_id int, src string, dst string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    hits = lambda depth: [tuple(r) for r in reach.world_hits(shared, worlds, ids("a"), ids("d"), samples, depth).collect()]
    assert hits(2) == [("a", "d", sum(i % 2 == 0 for i in range(samples)))] and hits(None) == [("a", "d", sum(i % 2 == 0 or i % 3 == 0 for i in range(samples)))]


def test_paths_longer_than_any_bound(spark):
    edges = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(18)], "src string, dst string")
    pair = spark.createDataFrame([("n000", "n018"), ("n018", "n000")], "source string, target string")
    assert [tuple(r) for r in reach.has_path(edges, pair).collect()] == [("n000", "n018")]


def test_vocabulary_round_trip(spark, tmp_path):
    v = vocabulary.build(spark.createDataFrame([("s3:Get",), (" S3:GET",), ("iam:Pass",), ("",), (None,)], "action string"))
    assert [tuple(r) for r in v.orderBy("idx").collect()] == [(1, "iam:Pass"), (2, "S3:GET")]
    vocabulary.write(v, str(tmp_path / "v.json"))
    again = vocabulary.read(spark, str(tmp_path / "v.json"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, v.collect()))
    sets = spark.createDataFrame([(1, ["s3:*", "x:y"]), (2, []), (3, None), (4, ["IAM:PASS ", None])], "id int, actions array<string>")
    coded = vocabulary.encode(sets, v)
    assert {r["id"]: r["indices"] for r in coded.collect()} == {1: [0, 2], 2: [], 3: [], 4: [1]}
    back = vocabulary.decode(coded.select("id", vocabulary.multi_hot(coded.indices, 3).alias("vector")), v, with_oov=True)
    assert {r["id"]: r["actions"] for r in back.collect()} == {1: ["<OOV>", "S3:GET"], 2: [], 3: [], 4: ["iam:Pass"]}
    assert vocabulary.feature_sizes(38)["User"] == 58 and uncertain.optimality_gap(3.0, 2.0) == (1.0, 0.5)


"""Work that must follow the input: rows that searches and policy joins hold, on graphs where pairs would multiply."""

from pyspark.sql import functions as F

from gatelens.functions import metrics
from gatelens.operators import hitting, masking, policy, reach, repair, resync, training, vocabulary

CONTEXT = "map<string, array<string>>"


def _held(monkeypatch):
    """Rows that each round of a search writes."""
    seen, real = [], reach.counted_step

    def noted(df):
        out, n = real(df)
        seen.append(n)
        return out, n

    monkeypatch.setattr(reach, "counted_step", noted)
    return seen


def _group(spark, users, policies):
    """Users of one group that many policies are attached to, all on one resource."""
    u = spark.range(users).select(F.concat(F.lit("u"), "id").alias("src"), F.lit("g").alias("dst"), F.lit("MemberOf").alias("relation"))
    p = F.concat(F.lit("p"), "id")
    return u.unionByName(spark.range(policies).select(F.lit("g").alias("src"), p.alias("dst"), F.lit("AttachedWith").alias("relation"))).unionByName(spark.range(policies).select(p.alias("src"), F.lit("r").alias("dst"), F.lit("ActsOn").alias("relation")))


def test_searches_hold_no_pair_of_a_user_and_a_policy(spark, monkeypatch):
    e = _group(spark, 50, 40)
    sources, target = e.where("relation = 'MemberOf'").select(F.col("src").alias("id")), spark.createDataFrame([("r",)], "id string")
    worlds = spark.createDataFrame([(0, "g", "r")], "sample_id int, src string, dst string")
    seen = _held(monkeypatch)
    assert {tuple(r) for r in reach.reach(e, sources, target, 8, True).collect()} == {(f"u{i}", "r", 3, f"u{i}>g>p0>r") for i in range(50)}
    assert {tuple(r) for r in reach.world_hits(e, worlds, sources, target, 3).collect()} == {(f"u{i}", "r", 3) for i in range(50)}
    paths = {(r["source"], r["target"], r["mask"], r["path"]) for r in reach.world_paths(e, worlds, sources, target, 3).collect()}
    assert paths == {x for i in range(50) for x in ((f"u{i}", "r", 1, f"u{i}>g>r"), (f"u{i}", "r", 6, f"u{i}>g>p0>r"))}
    assert max(seen) <= 2 * 50


def _statements(spark, n):
    """Of each policy a statement; only three are different."""
    k = F.col("id") % 3
    none, empty, maps = F.lit(None), F.expr("cast(array() as array<string>)"), CONTEXT
    return spark.range(n).select(
        F.concat(F.lit("s"), "id").alias("sid"), F.when(k == 0, "Deny").otherwise("Allow").alias("effect"), none.cast(maps).alias("principal"), none.cast(maps).alias("not_principal"),
        F.when(k == 0, F.array(F.lit("A:del"))).when(k == 1, F.array(F.lit("a:*"))).otherwise(F.array(F.lit(" a:get "))).alias("action"), empty.alias("not_action"), F.when(k == 2, F.array(F.lit("x"))).otherwise(F.array(F.lit("*"))).alias("resource"),
        empty.alias("not_resource"), none.cast(f"map<string, {maps}>").alias("condition"), F.concat(F.lit("p"), "id").alias("policy_id"),
    )


def test_requests_meet_a_groups_different_statements_once(spark):
    e, s = _group(spark, 4, 60), _statements(spark, 60)
    rows = [(f"{u}{a}{x}", f"u{u}", f"u{u}", a, x, {}, None) for u in range(4) for a in ("a:get", "A:DEL", "b:get") for x in ("x", "y")]
    known = spark.createDataFrame(rows, f"req_id string, id string, principal_arn string, action string, resource_arn string, context {CONTEXT}, role string")
    assert policy.owned_statements(e, s).count() == 3
    met = policy.owned_effects(known, e, s)
    assert met.count() == 4 * (2 + 1 + 2 + 2)  # a:get on x by two statements, on y by one, A:DEL by a deny and an allow
    got = {r["req_id"]: r["decision"] for r in policy.evaluate_known(known, e, s, s.limit(0)).collect()}
    assert got == {r[0]: {"a:get": "Allow", "A:DEL": "ExplicitDeny", "b:get": "ImplicitDeny"}[r[3]] for r in rows}
    nodes = spark.createDataFrame([(f"u{i}", "User") for i in range(5)], "id string, node_type string")
    assert {tuple(r)[0]: r[1] for r in vocabulary.effective_actions(nodes, e, s).collect()} == {**{f"u{i}": [" a:get ", "a:*"] for i in range(4)}, "u4": []}


def test_touched_edges_are_no_pairs_with_policies(spark):
    e = _group(spark, 3, 30).unionByName(spark.createDataFrame([("u0", "q", "AssumesRole"), ("u9", "q", "AssumesRole")], "src string, dst string, relation string"))
    changed = spark.range(30).select(F.concat(F.lit("p"), "id").alias("policy_id"))
    got = resync.touched(e, changed, changed.limit(0)).collect()
    assert len(got) == 31 and ("u0", "q", "AssumesRole") in {tuple(r) for r in got}


def test_supports_ask_only_for_the_edges_sources(spark):
    e = _group(spark, 300, 200)
    cuts = spark.createDataFrame([("u7", "r", "ActsOn", ["a:get"])], "src string, dst string, relation string, actions array<string>")
    nodes = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("arn", F.col("id"))
    parts = repair.policy_parts(_statements(spark, 200).withColumn("resource", F.array(F.lit("r"))))
    found = repair.edge_supports(cuts, parts, nodes, e)
    assert found.count() == sum(i % 3 > 0 for i in range(200))


def test_negatives_are_numbered_in_ranges(spark, monkeypatch):
    n, e = _roles(spark)
    windows, real = [], masking.Window.partitionBy
    monkeypatch.setattr(masking.Window, "partitionBy", staticmethod(lambda *c: windows.append(c) or real(*c)))
    monkeypatch.setattr(masking.Window, "orderBy", staticmethod(lambda *c: windows.append(c) or real().orderBy(*c)))
    got = masking.negatives(e, n, "AssumesRole", "User", "Role").collect()
    # the ranges' counts, one row each, are the only rows that a window without a range gets
    assert len(got) == 8 and windows and all("_range" in w for w in windows)
    assert not {(r["src"], r["dst"]) for r in got} & {(f"u{i}", f"r{i}") for i in range(8)}


def test_negatives_hold_only_the_nearest_draws_and_are_those_of_all(spark, monkeypatch):
    import hashlib

    users, roles, n_pos = 300, 50, 12
    rows = [(f"u{i}", "User", "de"[i % 2], False, i % 7 == 0) for i in range(users)] + [(f"r{i}", "Role", "de"[i % 2], i % 5 == 0, False) for i in range(roles)]
    n = spark.createDataFrame(rows, "id string, node_type string, department string, is_high_value boolean, is_admin boolean")
    e = spark.createDataFrame([(f"u{i}", f"r{i}", "AssumesRole") for i in range(n_pos)], "src string, dst string, relation string")
    u = lambda *k: int(hashlib.md5("|".join(("neg", "0", *k)).encode()).hexdigest()[:12], 16) / (1 << 48)
    at = {r[0]: r for r in rows}
    ids = sorted(r[0] for r in rows if r[1] == "Role")
    every = {(a, ids[int(u(a, str(t)) * roles)]) for a in at if at[a][1] == "User" for t in range(1, 65)} - {(f"u{i}", f"r{i}") for i in range(n_pos)}
    kind = lambda a, b: "up" if not at[a][4] and (at[b][3] or at[b][4]) else "same" if at[a][2] == at[b][2] else "cross"
    held, real = [], masking.step

    def noted(df):
        out = real(df)
        held.append(out.count())
        return out

    monkeypatch.setattr(masking, "step", noted)
    for ratio in (1.0, 400.0):
        k = round(n_pos * ratio)
        seen, ranked = {}, []
        for x, a, b in sorted((u(a, b), a, b) for a, b in every):
            seen[kind(a, b)] = seen.get(kind(a, b), 0) + 1
            ranked.append((seen[kind(a, b)] > round(k * dict(masking.STRATA)[kind(a, b)]), x, a, b))
        got = {tuple(r) for r in masking.negatives(e, n, "AssumesRole", "User", "Role", ratio).collect()}
        assert got == {(a, b, kind(a, b)) for _, _, a, b in sorted(ranked)[:k]} and len(got) == k
        assert ratio > 1 or max(held) < len(every) / 10


def _roles(spark):
    n = spark.createDataFrame([(f"u{i}", "User", "d", False, False) for i in range(8)] + [(f"r{i}", "Role", "de"[i % 2], False, i > 5) for i in range(8)], "id string, node_type string, department string, is_high_value boolean, is_admin boolean")
    return n, spark.createDataFrame([(f"u{i}", f"r{i}", "AssumesRole") for i in range(8)], "src string, dst string, relation string")


def test_governing_policies_are_counted_by_owner(spark):
    e = _group(spark, 20, 30).unionByName(spark.createDataFrame([("u0", "a", "AttachedWith"), ("u0", "h", "MemberOf"), ("h", "p0", "AttachedWith"), ("lone", "h", "MemberOf")], "src string, dst string, relation string"))
    want = policy.governing_policies(e).groupBy("principal").agg(F.count("*").alias("n"), F.min("policy").alias("first"))
    got = {tuple(r) for r in policy.governing_counts(e).collect()}
    assert got == {tuple(r) for r in want.collect()} and ("u0", 32, "a") in got and ("lone", 1, "p0") in got


def test_governing_policies_of_owners_are_counted_with_inline_ones(spark):
    e = _group(spark, 5, 3)
    inline = spark.createDataFrame([("u0", "a"), ("u0", "a"), ("g", "b"), ("alone", "c")], "owner string, policy string")
    want = policy.governing_policies(e, inline).groupBy("principal").agg(F.count("*").alias("n"), F.min("policy").alias("first"))
    got = {tuple(r) for r in policy.governing_counts(e, inline).collect()}
    assert got == {tuple(r) for r in want.collect()} and {("u0", 6, "a"), ("u1", 4, "b"), ("alone", 1, "c")} <= got


def _ladder(spark, n):
    """Sources in a chain to t, which only the last has an edge to; all edges are in each of two worlds, but one."""
    rows = [(k, f"a{i}", f"a{i + 1}" if i < n - 1 else "t") for i in range(n) for k in range(2) if (k, i) != (1, 0)]
    worlds = spark.createDataFrame(rows, "sample_id int, src string, dst string")
    pair = worlds.select(F.col("src").alias("source"), F.lit("t").alias("target")).distinct()
    return worlds, pair, worlds.select(F.concat_ws("|", "src", "dst").alias("option"), F.lit(1.0).alias("cost"), "src", "dst").distinct()


def test_greedy_cuts_copy_no_edges_by_option_or_world(spark, monkeypatch):
    worlds, pair, options = _ladder(spark, 4)
    shared = spark.createDataFrame([(f"x{i}", f"a{i % 4}") for i in range(20)], "src string, dst string")
    pair = pair.unionByName(shared.select(F.col("src").alias("source"), F.lit("t").alias("target")))
    held, real = [], repair.step

    def noted(df):
        out = real(df)
        held.append(out.count())
        return out

    monkeypatch.setattr(repair, "step", noted)
    got = [tuple(r) for r in repair.greedy_cuts(shared, worlds, pair, options, 40).collect()]
    assert got == [(1, "a3|t", 1.0, 0.0)]
    assert max(held) <= 5 * 24  # the edges that each source reaches, not edges by worlds


def test_greedy_cuts_go_on_until_no_risk_is_left_however_small_its_falls(spark):
    n = 23
    worlds = spark.createDataFrame([(k, f"a{i}", f"t{i}") for i in range(n) for k in range(2) if (k, i) != (1, 5)], "sample_id int, src string, dst string")
    options = worlds.select(F.concat_ws("|", "src", "dst").alias("option"), F.lit(1.0).alias("cost"), "src", "dst").distinct()
    # a fall is less than a millionth, as most pairs of a source and a target have no path
    ends = [spark.range(2000).select(F.concat(F.lit(x), "id").alias("id")) for x in "at"]
    none = worlds.select("src", "dst").limit(0)
    got = [tuple(r) for r in repair.greedy_cuts(none, worlds, tuple(ends), options, 2).orderBy("step").collect()]
    assert [r[1] for r in got] == [*sorted(f"a{i}|t{i}" for i in range(n) if i != 5), "a5|t5"] and got[-1][3] == 0.0 and got[-2][3] > 0.0
    assert repair.greedy_cuts(none, worlds, tuple(ends), options, 2, most=4).count() == 4


def test_greedy_cuts_by_parts_are_those_in_rounds(spark, monkeypatch):
    import random

    draw = random.Random(11)
    rows = [(k, f"{g}{a}", f"{g}{b}") for g in "pqrs" for a, b in {tuple(sorted(draw.sample(range(6), 2))) for _ in range(9)} for k in range(8) if draw.random() < 0.7]
    worlds = spark.createDataFrame(rows, "sample_id int, src string, dst string")
    options = worlds.select(F.concat_ws("|", "src", "dst").alias("option"), (1.0 + F.length("src") + F.ascii("dst") % 3).alias("cost"), "src", "dst").distinct()
    ends = [spark.createDataFrame([(f"{g}{i}",) for g in "pqrs" for i in some], "id string") for some in ((0, 1), (4, 5))]
    taken = []
    for bound in (200_000, 12, 0):
        monkeypatch.setattr(repair, "PART_ROWS", bound)
        taken.append([tuple(r) for r in repair.greedy_cuts(worlds.select("src", "dst").limit(0), worlds, tuple(ends), options, 8).orderBy("step").collect()])
    assert taken[0] == taken[1] == taken[2] and taken[0][-1][3] == 0.0


def test_greedy_cuts_by_ends_and_by_pairs_equal_trying_each(spark):
    import random

    draw = random.Random(5)
    nodes = [f"n{i}" for i in range(9)]
    each = sorted({(draw.choice(nodes), draw.choice(nodes)) for _ in range(26)})
    each = [(a, b) for a, b in each if a != b]
    shared, samples = each[:4], 70
    worlds = [(k, *e) for k in range(samples) for e in each[4:] if draw.random() < 0.6]
    options = {f"o{i}": set(draw.sample(each, 1 + i % 2)) for i in range(10)}
    sources, targets = nodes[:5], nodes[4:]

    def hits(gone):
        n = 0
        for k in range(samples):
            out = {}
            for a, b in set(shared) | {(a, b) for i, a, b in worlds if i == k}:
                if (a, b) not in gone:
                    out.setdefault(a, []).append(b)
            for s in sources:
                seen, todo = {s}, [s]
                while todo:
                    for v in out.get(todo.pop(), []):
                        if v not in seen:
                            seen.add(v)
                            todo.append(v)
                n += len((seen - {s}) & set(targets))
        return n

    asked, gone, want = 24, set(), []
    risk = hits(gone) / samples / asked
    while True:
        falls = [(-(risk - hits(gone | cut) / samples / asked) / (1 + int(o[1:]) % 3), o) for o, cut in options.items()]
        fall, best = min(falls)
        if -fall <= 1e-6:
            break
        gone |= options[best]
        risk = hits(gone) / samples / asked
        want.append((best, round(risk, 9)))
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "id string")
    pair = spark.createDataFrame([(s, t) for s in sources for t in targets if s != t], "source string, target string")
    o, w = spark.createDataFrame(shared, "src string, dst string"), spark.createDataFrame(worlds, "sample_id int, src string, dst string")
    opts = spark.createDataFrame([(n, float(1 + int(n[1:]) % 3), a, b) for n, cut in options.items() for a, b in cut], "option string, cost double, src string, dst string")
    for asks in (pair, (ids(sources), ids(targets))):
        got = repair.greedy_cuts(o, w, asks, opts, samples).orderBy("step").collect()
        assert len(want) > 2 and [(r["option"], round(r["risk"], 9)) for r in got] == want


def test_exact_cuts_look_at_short_paths_first(spark, monkeypatch):
    worlds, pair, options = _ladder(spark, 6)
    found, real = [], hitting.world_paths

    def noted(*a):
        out = real(*a)
        found.append(out.count())
        return out

    monkeypatch.setattr(hitting, "world_paths", noted)
    got = [tuple(r) for r in hitting.cheapest_cuts(worlds.select("src", "dst").limit(0), worlds, pair, options, 2).collect()]
    assert got == [("a5|t", 1.0)] and sum(found) == 1


def test_simple_paths_hold_no_pair_of_a_user_and_a_policy(spark, monkeypatch):
    e = _group(spark, 50, 40).unionByName(spark.createDataFrame([("c1", "c2", "P"), ("c2", "c1", "P"), ("c1", "g", "P"), ("c2", "p0", "P"), ("u0", "c1", "P")], "src string, dst string, relation string"))
    pairs = e.where("src rlike '^[uc]'").select(F.col("src").alias("source"), F.lit("r").alias("target")).distinct()
    known = {}
    for r in e.collect():
        known.setdefault(r["src"], set()).add(r["dst"])

    def walk(p):
        if p[-1] == "r":
            yield p
        elif len(p) <= 8:
            for v in known.get(p[-1], ()):
                if v not in p:
                    yield from walk([*p, v])

    want = set()
    for s in [*(f"u{i}" for i in range(50)), "c1", "c2"]:
        every = sorted((len(p) - 1, ">".join(p)) for p in walk([s]))
        want |= {(s, "r", p, n) for n, p in every[:3]}
    seen = _held(monkeypatch)
    got = {tuple(r) for r in reach.simple_paths(e, pairs, 8, 3).collect()}
    assert got == want and max(seen) <= 3 * 52 + 40 + 50


def test_training_holds_no_places_of_relations_that_do_not_come_to_a_node(spark, monkeypatch):
    e = _group(spark, 40, 30)
    nodes = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    features = nodes.select("id", F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.when(i == F.hash("id") % 20, 1.0).otherwise(i.cast("double") * 0)).alias("x"))
    pairs = e.where("relation = 'MemberOf'").select(F.col("src").alias("u"), F.col("dst").alias("v"), "relation", F.lit(1).alias("y"), F.lit("train").alias("part"))
    held, real = [], training.step

    def noted(df):
        out = real(df)
        wide = [F.size(f.name) for f in df.schema if f.dataType.typeName() == "array"]
        if wide and "x" not in df.columns:
            held.append(out.agg(F.sum(sum(wide, F.lit(0)))).first()[0])
        return out

    monkeypatch.setattr(training, "step", noted)
    config = training.Config(dim=4, bases=2)
    graph = training.Graph.of(e, features, config)
    training.gradients(graph, pairs, training.fresh(config, graph.width, ["MemberOf"]))
    sparse = [f.name for f in graph.first.schema if f.dataType.typeName() == "array"]
    assert "x" not in sparse  # the rows that each epoch reads are no full matrix rows
    # own features and means, 72 nodes by at most 20 places of few ways; full rows would hold 72 * 11 * 20
    assert graph.first.agg(F.sum(F.size(sparse[0]))).first()[0] < 72 * 20 and max(held) < 72 * 20


def test_average_precision_in_ranges_is_that_of_one_group(spark):
    rows = spark.range(3000).select((F.hash("id") % 3 == 0).cast("int").alias("y"), (F.abs(F.hash("id", F.lit(1))) % 700 / 7).alias("score"), F.lit(1).alias("g"))
    for some in (rows, rows.where("y = 1"), rows.where("y = 0")):
        assert abs(metrics.pr_auc_in_ranges(some) - metrics.pr_auc(some, ["g"]).first()["pr_auc"]) < 1e-12
    assert metrics.pr_auc_in_ranges(rows.limit(0)) == 0.0

"""Edges after edits, held against judging every edge one by one in Python."""

import fnmatch
import random

import pytest

from gatelens.operators import capability, policy, repair, resync
from gatelens.plans.steps import step

SHAPE = f"policy_id string, {policy.STATEMENT}"
NODES = [(f"u{i}", "User", f"arn:u{i}") for i in range(3)] + [("g", "Group", "arn:g")] + [(f"r{i}", "Role", f"arn:r{i}") for i in range(3)] + [(f"p{i}", "Policy", f"arn:p{i}") for i in range(4)] + [("x", "Resource", "arn:x")]
ARN = {i: a for i, _, a in NODES}
KIND = {i: k for i, k, _ in NODES}


def row(owner, effect, actions, resources, names=None):
    return (owner, "s", effect, names and {"AWS": names}, None, actions, None, resources, None, None)


def decide(rows, who, act, place):
    fits = lambda s: (not s[3] or any(n in ("*", who) for n in s[3]["AWS"])) and any(fnmatch.fnmatchcase(act.lower(), a.lower()) for a in s[5]) and any(fnmatch.fnmatchcase(place, r) for r in s[7] or ["*"])
    found = {s[2] for s in rows if fits(s)}
    return found == {"Allow"}


def expected(edges, before, after, t_before, t_after, guarded):
    owned = lambda rows, k: sorted((s for s in rows if s[0] == k), key=str)
    changed = {k for k in ARN if owned(before, k) != owned(after, k)}
    turned = {k for k in ARN if owned(t_before, k) != owned(t_after, k)}
    has = lambda s, rel: [d for a, d, r, _ in edges if a == s and r == rel]
    governs = {k: set(has(k, "AttachedWith")) | {p for g in has(k, "MemberOf") for p in has(g, "AttachedWith")} for k in ARN}

    def on_graph(src, act, dst, place):
        if act == "sts:AssumeRole" and dst in guarded and not decide(owned(t_after, dst), ARN[src], act, place):
            return False
        return decide([s for s in after if s[0] in governs[src]], ARN[src], act, place)

    out = []
    for s, d, r, acts in edges:
        hit = r in ("PassesTo", "AssumesRole", "ActsOn") and governs[s] & changed or r == "ActsOn" and s in changed or r == "AssumesRole" and d in turned
        if not hit:
            out.append((s, d, r, acts))
            continue
        asked = {"PassesTo": ["iam:PassRole"], "AssumesRole": ["sts:AssumeRole"]}.get(r) or acts or ["*"]
        if KIND[s] == "Policy":
            good = [a for a in asked if decide(owned(after, s), "*", a, ARN[d])]
        else:
            good = [a for a in asked if on_graph(s, a, d, ARN[d]) or (a == resync.ATTACH and KIND[d] == "Policy" and on_graph(s, a, d, ARN[s]))]
        if good:
            out.append((s, d, r, [a for a in acts if a in good] if r == "ActsOn" and acts else acts))
    return sorted(out, key=str)


def frames(spark, edges, *tables):
    shape = "src string, dst string, relation string, actions array<string>"
    return spark.createDataFrame(edges, shape), spark.createDataFrame(NODES, "id string, node_type string, arn string"), *[spark.createDataFrame(t, SHAPE) for t in tables]


@pytest.mark.parametrize("seed", range(4))
def test_edges_are_those_of_judging_each(spark, seed):
    d = random.Random(seed)
    acts = ["s3:Get", "s3:Put", "sts:AssumeRole", "iam:PassRole", resync.ATTACH]
    some = lambda xs, k=2: d.sample(xs, d.randint(1, k))
    edges = {("u0", "g", "MemberOf"): [], ("g", "p0", "AttachedWith"): []}
    for _ in range(40):
        a = d.choice(["u0", "u1", "u2", "r0", "r1", "r2"])
        edges[a, d.choice(["p0", "p1", "p2", "p3"]), d.choice(["AttachedWith", "ActsOn"])] = d.choice([[], some(acts, 3), [resync.ATTACH]])
        edges[a, d.choice(["r0", "r1", "r2"]), d.choice(["AssumesRole", "PassesTo"])] = d.choice([[], ["sts:AssumeRole"]])
        edges[d.choice(["p0", "p1", "p2", "p3", a]), "x", "ActsOn"] = d.choice([[], some(acts, 3)])
    edges = [(*k, v if k[2] != "AttachedWith" else []) for k, v in edges.items()]
    line = lambda: row(d.choice(["p0", "p1", "p2", "p3"]), d.choice(["Allow"] * 4 + ["Deny"]), some(["*", "s3:*", *acts]), some(["*", "arn:r*", "arn:x", "arn:p1", "arn:u*", "arn:r1"]))
    before = [line() for _ in range(9)]
    after = [s for s in before if d.random() < 0.8] + [line()]
    trust = [row(f"r{i}", "Allow", ["sts:*"], None, ["*"]) for i in (0, 1)]
    trust_after = [row("r0", "Allow", ["sts:AssumeRole"], None, ["arn:u0", "arn:r1"])] + (trust[1:] if seed % 2 else [])
    e, n, *tables = frames(spark, edges, before, after, trust, trust_after)
    got = sorted((tuple(r) for r in resync.synchronize(e, n, *tables).collect()), key=str)
    assert got == expected(edges, before, after, trust, trust_after, {"r0", "r1"})
    assert len(got) < len(edges)


def test_nothing_changed_touches_nothing(spark):
    edges = [("u0", "p0", "AttachedWith", None), ("u0", "r0", "AssumesRole", None), ("u0", None, "PassesTo", None), (None, "x", "ActsOn", ["a:b"]), ("u0", "gone", "ActsOn", ["a:b"])]
    s = [row("p0", "Deny", ["*"], ["*"]), row("p0", "Deny", ["*"], ["*"])]
    e, n, before, less, none = frames(spark, edges, s, s[:1], [])
    kept = lambda *t: sorted((tuple(r) for r in resync.synchronize(e.withColumn("policy_id", e.src), n, *t).drop("policy_id").collect()), key=str)
    assert kept(before, before, none, none) == sorted(edges, key=str) == kept(none, none, none, none)
    # one of two equal statements goes: the edge that was denied all along is judged, those with unknown ends are not
    assert kept(before, less, none, none) == sorted([x for x in edges if x[1] != "r0"], key=str)
    assert [r["policy_id"] for r in resync.changed_policies(before, less).collect()] == ["p0"]
    assert resync.changed_policies(before, before).count() == 0


def test_a_role_without_trust_statements_left_admits_nobody(spark):
    edges = [("u0", "p0", "AttachedWith", []), ("u0", "r0", "AssumesRole", []), ("u1", "r1", "AssumesRole", [])]
    e, n, s, trust, none = frames(spark, edges, [row("p0", "Allow", ["*"], ["*"])], [row("r0", "Allow", ["sts:AssumeRole"], None, ["arn:u0"])], [])
    assert {r["dst"] for r in resync.synchronize(e, n, s, s, trust, none).collect()} == {"p0", "r1"}
    assert {r["dst"] for r in resync.synchronize(e, n, s, s, none, trust).collect()} == {"p0", "r0", "r1"}


SHARED = "arn:aws:iam::1:role/"


def _searched(spark, used, gates, most=20):
    """An intern in a group whose policy takes on any role; the admin role reaches the vault, worlds add a way over dev."""
    nodes = [("intern", "User", "arn:aws:iam::1:user/intern"), ("g", "Group", "arn:aws:iam::1:group/g"), ("admin", "Role", SHARED + "admin"), ("dev", "Role", SHARED + "dev"), ("vault", "Resource", "arn:aws:s3:::vault"), ("p", "Policy", "arn:aws:iam::1:policy/p")]
    edges = [("intern", "g", "MemberOf", []), ("g", "p", "AttachedWith", []), ("intern", "admin", "AssumesRole", []), ("intern", "dev", "AssumesRole", []), ("admin", "vault", "ActsOn", ["s3:GetObject"])]
    n = spark.createDataFrame(nodes, "id string, node_type string, arn string")
    e = spark.createDataFrame(edges, "src string, dst string, relation string, actions array<string>")
    s = spark.createDataFrame([row("p", "Allow", ["sts:*", "s3:GetObject"], ["*"])], SHAPE)
    trust = spark.createDataFrame([row(r, effect, ["sts:AssumeRole"], None, names) for r, effect, names in gates], SHAPE)
    log = spark.createDataFrame([(f"r{i}", "arn:aws:iam::1:user/intern", a, r, {}, ["p"]) for i, (a, r) in enumerate(used)], "req_id string, principal_arn string, action string, resource_arn string, context map<string, array<string>>, policy_ids array<string>")
    worlds = spark.createDataFrame([(0, "dev", "vault")], "sample_id int, src string, dst string")
    pair = spark.createDataFrame([("intern", "vault")], "source string, target string")
    got = step(repair.greedy_patches(e, worlds, pair, s, e.where("relation = 'AssumesRole'"), log, n, capability.snapshot(spark), 4, most=most, trust=trust))
    return (e, n, s, trust), got, [(r["policy_id"], r["action"], r["edit"], r["cost"], r["risk"], r["is_trust"]) for r in got.orderBy("step").collect()]


def test_trust_is_edited_where_the_log_needs_the_policy(spark):
    everyone = [("admin", "Allow", ["arn:aws:iam::1:user/intern"]), ("dev", "Allow", ["*"])]
    tables, got, taken = _searched(spark, [("sts:AssumeRole", SHARED + "dev"), ("s3:GetObject", "arn:aws:s3:::a/b")], everyone)
    # the log takes on dev by the policy and by dev's trust, so one world in four keeps its way
    assert taken == [("admin", "sts:assumerole", "remove", 5.0, 0.25, True)]
    statements, trust, edges = repair.repaired(*tables, got)
    assert {r["policy_id"] for r in trust.collect()} == {"dev"} and statements.count() == 1
    assert {(r["src"], r["dst"]) for r in edges.collect()} == {("intern", "g"), ("g", "p"), ("intern", "dev"), ("admin", "vault")}
    # without a log the policy's one action closes both ways at once
    tables, got, taken = _searched(spark, [], everyone)
    assert taken == [("p", "sts:*", "remove", 5.0, 0.0, False)]
    assert {r["relation"] for r in repair.repaired(*tables, got)[2].collect()} == {"MemberOf", "AttachedWith", "ActsOn"}


def test_a_log_that_trust_bars_raises(spark):
    with pytest.raises(ValueError, match="1 requests"):
        _searched(spark, [("sts:AssumeRole", SHARED + "dev")], [("dev", "Allow", ["arn:other"])])
    with pytest.raises(ValueError, match="1 requests"):
        _searched(spark, [("sts:AssumeRole", SHARED + "dev")], [("dev", "Allow", ["*"]), ("dev", "Deny", ["*"])])

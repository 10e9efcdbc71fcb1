"""Policy engine, conditions, globs, capability: golden values and hypothesis against fnmatch."""

import fnmatch

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gatelens.functions import globs
from gatelens.functions.conditions import block_holds
from gatelens.operators import capability, policy
from gatelens.sources import policies

CTX = "map<string, array<string>>"


def statement(sid, effect, action=(), resource=("*",), principal=None, condition=None, not_action=(), not_resource=(), not_principal=None, policy_id="p"):
    return (sid, effect, principal, not_principal, list(action), list(not_action), list(resource), list(not_resource), condition, policy_id)


SCHEMA = policy.STATEMENT + ", policy_id string"


def decide(spark, statements, *requests):
    r = spark.createDataFrame([(str(i), *q) if len(q) == 4 else (str(i), *q, {}) for i, q in enumerate(requests)], f"req_id string, principal_arn string, action string, resource_arn string, context {CTX}")
    got = {x["req_id"]: x["decision"] for x in policy.decide(r, spark.createDataFrame(statements, SCHEMA)).collect()}
    return [got[str(i)] for i in range(len(requests))]


def test_explicit_deny_wins(spark):
    s = [statement("a", "Allow", ["s3:*"]), statement("d", "Deny", ["s3:Delete*"], ["arn:x/secret*"])]
    assert decide(spark, s, ("u", "s3:GetObject", "arn:x/1"), ("u", "S3:deleteobject", "arn:x/secret/1"), ("u", "iam:PassRole", "y")) == ["Allow", "ExplicitDeny", "ImplicitDeny"]


def test_not_action_and_not_resource(spark):
    s = [statement("a", "Allow", not_action=["iam:*"], resource=[], not_resource=["confidential/*"])]
    assert decide(spark, s, ("u", "s3:Get", "public/1"), ("u", "s3:Get", "confidential/1"), ("u", "iam:Get", "public/1")) == ["Allow", "ImplicitDeny", "ImplicitDeny"]


def test_principals(spark):
    s = [statement("t", "Allow", ["*"], principal={"Service": ["lambda"], "AWS": ["arn:a"]}), statement("d", "Deny", ["*"], not_principal={"*": ["*"]})]
    assert decide(spark, s, ("lambda", "x", "y"), ("arn:a", "x", "y"), ("ec2", "x", "y")) == ["Allow", "Allow", "ImplicitDeny"]


@pytest.mark.parametrize(
    "block, context, holds",
    [
        ({"NumericLessThan": {"k": ["100"]}}, {"k": ["50"]}, True),
        ({"NumericLessThan": {"k": ["100"]}}, {"k": ["150"]}, False),
        ({"NumericLessThan": {"k": ["100"]}}, {"k": ["x"]}, False),
        ({"Null": {"k": ["true"]}}, {}, True),
        ({"Null": {"k": ["true"]}}, {"k": ["1"]}, False),
        ({"StringEqualsIfExists": {"d": ["Security"]}}, {}, True),
        ({"StringEqualsIfExists": {"d": ["Security"]}}, {"d": ["Security"]}, True),
        ({"StringEqualsIfExists": {"d": ["Security"]}}, {"d": ["Marketing"]}, False),
        ({"ForAnyValue:StringEquals": {"t": ["CostCenter", "Environment"]}}, {"t": ["CostCenter", "Project"]}, True),
        ({"ForAnyValue:StringEquals": {"t": ["CostCenter", "Environment"]}}, {"t": ["Department"]}, False),
        ({"ForAnyValue:StringEquals": {"t": ["CostCenter"]}}, {}, False),
        ({"ForAllValues:StringEquals": {"t": ["CostCenter", "Environment"]}}, {"t": ["CostCenter"]}, True),
        ({"ForAllValues:StringEquals": {"t": ["CostCenter"]}}, {"t": ["CostCenter", "InvalidTag"]}, False),
        ({"ForAllValues:StringEquals": {"t": ["CostCenter"]}}, {}, True),
        ({"StringNotEquals": {"k": ["a", "b"]}}, {"k": ["a"]}, True),
        ({"StringNotEquals": {"k": ["a"]}}, {}, False),
        ({"Bool": {"k": ["true"]}}, {"k": ["1"]}, True),
        ({"ArnLike": {"k": ["arn:*:x"]}}, {"k": ["arn:1:x"]}, True),
        ({"IpAddress": {"k": ["1.2.3.4"]}}, {"k": ["1.2.3.4"]}, False),
        ({}, {}, True),
        (None, {}, True),
    ],
)
def test_conditions(spark, block, context, holds):
    df = spark.createDataFrame([(block, context)], "b map<string, map<string, array<string>>>, c map<string, array<string>>")
    assert df.select(block_holds(F.col("b"), F.col("c"))).collect()[0][0] is holds


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.text("ab*?[]!.-^$(){}|\\\n", max_size=6), st.text("ab*?[]!.^\n", max_size=6)), min_size=20, max_size=60))
def test_globs_match_fnmatch(spark, pairs):
    pairs = [(p, v) for p, v in pairs if not any(c in p for c in "-\\") and "[]" not in p and "[!]" not in p and "[[" not in p and "[^" not in p and "[![" not in p and "^" not in p and not ("[" in p and "[" in p[p.index("[") + 1 :])]
    df = spark.createDataFrame(pairs + [("*", "x")], "p string, v string")
    for r in df.select("p", "v", globs.matches_glob(F.col("v"), F.col("p")).alias("m")).collect():
        assert r["m"] == fnmatch.fnmatchcase(r["v"], r["p"]), r


def test_expansion(spark):
    u = spark.createDataFrame([(a,) for a in "iam:PassRole iam:CreateAccessKey iam:DeleteAccessKey s3:GetObject s3:PutObject lambda:InvokeFunction".split()], "action string")
    got = lambda p, f=policy.expand_actions, **k: {r[0] for r in f(spark.createDataFrame([(x,) for x in p], "pattern string"), u, **k).collect()}
    assert got(["iam:*AccessKey*"]) == {"iam:CreateAccessKey", "iam:DeleteAccessKey"} and got(["s3:*"]) == {"s3:GetObject", "s3:PutObject"}
    assert got(["S3:getobject", "x:Nope", " "]) == {"s3:GetObject", "x:Nope"} and got(["x:*"], fallback=False) == set()
    assert got(["iam:*", "s3:*"], policy.expand_not_actions) == {"lambda:InvokeFunction"}


def test_graph_level_authorization(spark):
    nodes = spark.createDataFrame([("u", "User", "arn:u"), ("g", "Group", "arn:g"), ("r", "Role", "arn:r"), ("q", "Role", "arn:q"), ("n", "User", "arn:n")], "id string, node_type string, arn string")
    edges = spark.createDataFrame([("u", "g", "MemberOf"), ("g", "p", "AttachedWith")], "src string, dst string, relation string")
    s = spark.createDataFrame([statement("a", "Allow", ["sts:AssumeRole", "s3:*"])], SCHEMA)
    trust = spark.createDataFrame([statement("t", "Allow", ["*"], principal={"AWS": ["arn:other"]}, policy_id="r")], SCHEMA)
    rows = [("1", "ARN:U", "s3:Get", "x", {}), ("2", "arn:u", "sts:AssumeRole", "arn:r", {}), ("3", "arn:u", "sts:AssumeRole", "arn:q", {}), ("4", "arn:n", "s3:Get", "x", {}), ("5", "nobody", "s3:Get", "x", {})]
    r = spark.createDataFrame(rows, f"req_id string, principal_arn string, action string, resource_arn string, context {CTX}")
    got = {x["req_id"]: x["decision"] for x in policy.evaluate_on_graph(r, nodes, edges, s, trust).collect()}
    assert got == {"1": "Allow", "2": "ImplicitDeny", "3": "Allow", "4": "ImplicitDeny", "5": "ImplicitDeny"}


def test_capability_size_and_file(spark, tmp_path):
    assert capability.snapshot(spark).count() == 37 and len(capability.GLOBAL_KEYS) == 17
    (tmp_path / "c.json").write_text('{"actions": {"a:b": {"action": "a:B", "service": "a", "wildcard_only": false, "resource_types": ["role"], "condition_keys": []}}}')
    assert capability.read_snapshot(spark, str(tmp_path / "c.json")).collect()[0]["action"] == "a:B"


def test_policy_text_round_trip(spark):
    doc = '{"Statement":[{"Sid":"x","Effect":"Allow","Principal":{"AWS":["a","b"],"Service":"s"},"Action":["p:q"],"Resource":"*","Condition":{"Bool":{"k":"true"}}},{"Effect":"Deny","Principal":"*","NotAction":"z:*","NotResource":["r"]}]}'
    one = policies.parse(spark.createDataFrame([("p", doc)], "policy_id string, doc string"))
    rows = one.orderBy("pos").collect()
    assert rows[0]["principal"] == {"AWS": ["a", "b"], "Service": ["s"]} and rows[0]["condition"] == {"Bool": {"k": ["true"]}} and rows[1]["principal"] == {"*": ["*"]}
    again = policies.parse(policies.to_json(one)).orderBy("pos").collect()
    assert [r["action"] for r in again] == [["p:q"], None] and again[1]["not_action"] == ["z:*"] and all(r["error"] is None for r in again)


@pytest.mark.parametrize("doc, error", [("{", "not JSON"), ("{}", "no statement"), ('{"Statement":{"Effect":"Allow","Action":"a","NotAction":"b"}}', "Action and NotAction"), ('{"Statement":{"Effect":"Allow"}}', "Action and NotAction"), ('{"Statement":{"Effect":"Allow","Action":"a","What":1}}', "unknown key"), ('{"Statement":{"Effect":"Allow","Action":"a","Resource":"b","NotResource":"c"}}', "Resource and NotResource")])
def test_bad_policies(spark, doc, error):
    assert policies.parse(spark.createDataFrame([("p", doc)], "policy_id string, doc string")).collect()[0]["error"] == error


def test_many_statements_join_by_service(spark, monkeypatch):
    s = [statement(f"s{i}", "Deny" if i % 7 == 0 else "Allow", [[f" S{i % 5}:Get*", "s9:x"], ["*"], [], [f"s{i % 5}:put"]][i % 4], [f"arn:{i % 3}/*"], not_action=[f"s{i % 2}:*"] if i % 4 == 2 else []) for i in range(60)]
    r = spark.createDataFrame([(str(i), "u", f"s{i % 7}:{['GetX', 'put', 'x'][i % 3]}", f"arn:{i % 4}/z", {}) for i in range(100)], f"req_id string, principal_arn string, action string, resource_arn string, context {CTX}")
    st_ = spark.createDataFrame(s, SCHEMA)
    key = lambda df: sorted(tuple(map(str, x)) for x in df.collect())
    want = key(policy.decide(r, st_))
    monkeypatch.setattr(policy, "BROADCAST_STATEMENTS", 10)
    got = policy.decide(r, st_)
    assert key(got) == want and len({x[1] for x in want}) == 3
    by_service = policy.matches(r, st_.where("size(action) > 0 and not exists(action, x -> x = '*')"))
    assert "NestedLoop" not in by_service._jdf.queryExecution().executedPlan().toString()


def test_policies_that_grant_all(spark):
    s = [statement("a", "Allow", ["s3:*", " * "], ["*"], policy_id="p1"), statement("b", "Allow", ["*"], ["arn:*"], policy_id="p2"), statement("c", "Deny", ["*"], policy_id="p3"), statement("d", "Allow", [], ["*"], policy_id="p4")]
    assert [x[0] for x in policy.grants_all(spark.createDataFrame(s, SCHEMA)).collect()] == ["p1"]


"""Terraform sources: a small HCL reader and the resources, documents and graph that follow from it."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

TOKEN = re.compile(
    r"""(?P<space>(?:\s|\#[^\n]*|//[^\n]*|/\*.*?\*/)+)|(?P<heredoc><<-?\s*(?P<tag>\w+)[^\n]*\n(?P<body>.*?)\n\s*(?P=tag)(?=\s|$))|(?P<string>"(?:[^"\\]|\\.)*")|(?P<number>-?\d+(?:\.\d+)?)|(?P<name>[A-Za-z_][\w.\-]*(?:\[[^\]\n]*\][\w.\-]*)*)|(?P<mark>[{}\[\](),:=]|=>|.)""",
    re.S | re.X,
)


class Reader:
    """Recursive descent over tokens: blocks, attributes, lists, maps, strings, heredocs, calls and references."""

    def __init__(self, text: str):
        self.tokens = [(m.lastgroup if m.lastgroup not in ("tag", "body") else "heredoc", m) for m in TOKEN.finditer(text) if m.lastgroup != "space"]
        self.at = 0

    def peek(self, ahead: int = 0) -> str:
        i = self.at + ahead
        return self.tokens[i][1].group(0) if i < len(self.tokens) else ""

    def kind(self) -> str:
        if self.at >= len(self.tokens):
            return "end"
        m = self.tokens[self.at][1]
        return next(k for k in ("heredoc", "string", "number", "name", "mark") if m.group(k) is not None)

    def take(self, want: str | None = None) -> str:
        got = self.peek()
        if not got or (want and got != want):
            raise ValueError(f"expected {want or 'more'}, found {got or 'the end'}")
        self.at += 1
        return got

    def body(self, end: str) -> dict:
        """Attributes by name; blocks as {type: [{"labels": [...], "body": {...}}]} under ``blocks``."""
        out: dict = {"blocks": {}}
        while self.peek() != end:
            name = self.take().strip('"')
            if self.peek() in ("=", ":"):
                self.take()
                if self.peek() == ">":
                    self.take()
                out[name] = self.value()
            else:
                labels = []
                while self.peek() != "{":
                    labels.append(self.take().strip('"'))
                self.take("{")
                out["blocks"].setdefault(name, []).append({"labels": labels, "body": self.body("}")})
                self.take("}")
            if self.peek() == ",":
                self.take()
        return out

    def value(self):
        kind = self.kind()
        if kind == "heredoc":
            m = self.tokens[self.at][1]
            self.at += 1
            return m.group("body").strip()
        if kind == "string":
            raw = self.take()
            try:
                return json.loads(raw)
            except ValueError:
                return raw[1:-1]
        if kind == "number":
            n = self.take()
            return float(n) if "." in n else int(n)
        if self.peek() == "[":
            self.take()
            out = []
            while self.peek() != "]":
                out.append(self.value())
                if self.peek() == ",":
                    self.take()
            self.take("]")
            return out
        if self.peek() == "{":
            self.take()
            got = self.body("}")
            self.take("}")
            blocks = got.pop("blocks")
            return got | {k: [b["body"] for b in v] for k, v in blocks.items()}
        name = self.take()
        if name in ("true", "false"):
            return name == "true"
        if name == "null":
            return None
        if self.peek() == "(":
            self.take()
            args = []
            while self.peek() != ")":
                args.append(self.value())
                if self.peek() == ",":
                    self.take()
            self.take(")")
            return json.dumps(args[0]) if name == "jsonencode" and args else {"call": name, "args": args}
        return "${" + name + "}"


def parse_hcl(text: str) -> dict:
    return Reader(text).body("")


def statement_json(body: dict) -> str:
    """The JSON policy of an ``aws_iam_policy_document`` block."""
    out = []
    for block in body["blocks"].get("statement", []):
        b, s = block["body"], {}
        s["Effect"] = b.get("effect", "Allow")
        for key, name in (("sid", "Sid"), ("actions", "Action"), ("not_actions", "NotAction"), ("resources", "Resource"), ("not_resources", "NotResource")):
            if key in b:
                s[name] = b[key]
        for key, name in (("principals", "Principal"), ("not_principals", "NotPrincipal")):
            kinds = {}
            for p in b["blocks"].get(key, []):
                kinds.setdefault(p["body"]["type"], []).extend(p["body"].get("identifiers", []))
            if kinds:
                s[name] = kinds
        for c in b["blocks"].get("condition", []):
            s.setdefault("Condition", {}).setdefault(c["body"]["test"], {})[c["body"]["variable"]] = c["body"].get("values", [])
        out.append(s)
    return json.dumps({"Version": "2012-10-17", "Statement": out})


def resources_of(text: str, is_json: bool) -> Iterator[tuple[str, str, str, str]]:
    """(block, type, label, body as JSON) of resource and data blocks; policy documents become their JSON policy."""
    if is_json:
        tree = json.loads(text)
        for block in ("resource", "data"):
            for kind, labels in (tree.get(block) or {}).items():
                for label, body in labels.items():
                    yield block, kind, label, json.dumps(body)
        return
    tree = parse_hcl(text)
    for block in ("resource", "data"):
        for b in tree["blocks"].get(block, []):
            kind, label = (b["labels"] + ["", ""])[:2]
            if block == "data" and kind == "aws_iam_policy_document":
                yield block, kind, label, json.dumps({"json": statement_json(b["body"])})
            else:
                flat = {k: v for k, v in b["body"].items() if k != "blocks"} | {k: [x["body"] for x in v] for k, v in b["body"]["blocks"].items()}
                yield block, kind, label, json.dumps(flat)


@udtf(returnType="block string, type string, label string, body string, error string")
class ParseTerraform:
    """A row for each block; a file that can't be read gives one row with the error."""

    def eval(self, path: str, text: str):
        try:
            rows = list(resources_of(text, path.endswith(".json")))
        except Exception as e:  # noqa: BLE001  a bad file is data, not a fault of the job
            yield None, None, None, None, str(e)[:200]
            return
        for r in rows:
            yield *r, None


def read_texts(spark: SparkSession, directory: str, recursive: bool = True) -> DataFrame:
    """(path, text) of the .tf and .tf.json files of a directory."""
    files = spark.read.text(directory, wholetext=True, recursiveFileLookup=recursive)
    return files.select(F.input_file_name().alias("path"), F.col("value").alias("text")).where(F.col("path").rlike(r"\.tf(\.json)?$"))


def blocks(texts: DataFrame) -> DataFrame:
    """(path, block, type, label, body, error) of (path, text); of blocks that repeat, the last path's stays."""
    spark = texts.sparkSession
    spark.udtf.register("parse_terraform", ParseTerraform)
    texts.createOrReplaceTempView("_terraform_texts")
    rows = spark.sql("SELECT t.path, p.* FROM _terraform_texts t, LATERAL parse_terraform(t.path, t.text) p")
    best = rows.where("error is null").groupBy("block", "type", "label").agg(F.max(F.struct("path", "body")).alias("b")).select("b.path", "block", "type", "label", "b.body", F.lit(None).cast("string").alias("error"))
    return best.unionByName(rows.where("error is not null"))


def _field(name: str):
    return F.get_json_object("body", f"$.{name}")


def policy_texts(found: DataFrame) -> DataFrame:
    """(label, type, doc): the JSON of each policy, inline policy and trust, data documents looked up by label."""
    data = found.where("block = 'data' and type = 'aws_iam_policy_document'").select(F.col("label").alias("ref"), _field("json").alias("looked_up"))
    own = found.where("type in ('aws_iam_policy', 'aws_iam_role_policy', 'aws_iam_user_policy', 'aws_iam_group_policy', 'aws_iam_role')")
    raw = F.coalesce(F.when(F.col("type") == "aws_iam_role", _field("assume_role_policy")).otherwise(_field("policy")), F.lit(""))
    j = own.withColumn("raw", raw).withColumn("ref", F.regexp_extract("raw", r"data\.aws_iam_policy_document\.([\w\-]+)", 1)).join(data, "ref", "left")
    return j.select("type", "label", F.coalesce("looked_up", F.when(F.startswith(F.trim("raw"), F.lit("{")), F.trim("raw"))).alias("doc"))


def _name(column) -> object:
    """The label that a reference such as ``${aws_iam_role.app.arn}`` names, else the text itself."""
    return F.when(F.startswith(column, F.lit("${")), F.regexp_extract(column, r"^\$\{[\w]+\.([\w\-]+)", 1)).otherwise(column)


def to_graph(found: DataFrame, account: str = "123456789012") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): principals and policies; ActsOn from allowed resources but ``*``, MemberOf, AttachedWith and, from
    trusts, AssumesRole. Attachments fall back from the label to the policy's name, and then to a placeholder."""
    from gatelens.sources.policies import parse

    kinds = {"aws_iam_user": ("User", "user"), "aws_iam_role": ("Role", "role"), "aws_iam_group": ("Group", "group"), "aws_iam_policy": ("Policy", "policy")}
    ent = found.where(F.col("type").isin(*kinds) & (F.col("block") == "resource"))
    kind, path = F.lit(None).cast("string"), F.coalesce(_field("path"), F.lit("/"))
    word = F.lit(None).cast("string")
    for t, (k, w) in kinds.items():
        kind, word = F.when(F.col("type") == t, k).otherwise(kind), F.when(F.col("type") == t, w).otherwise(word)
    name = F.coalesce(_field("name"), F.col("label"))
    nodes = ent.select(F.concat(word, F.lit(":"), "label").alias("id"), kind.alias("node_type"), F.concat(F.lit(f"arn:aws:iam::{account}:"), word, path, name).alias("arn"), name.alias("name"), "label")
    docs = policy_texts(found)
    s = parse(docs.select(F.concat_ws("|", "type", "label").alias("policy_id"), "doc")).where("error is null").withColumn("type", F.split("policy_id", r"\|")[0]).withColumn("label", F.split("policy_id", r"\|")[1])
    acts = s.where("type = 'aws_iam_policy' and effect = 'Allow'").select(F.concat(F.lit("policy:"), "label").alias("src"), F.explode("resource").alias("dst")).where("dst <> '*'").distinct()
    resources = acts.select(F.concat(F.lit("resource:"), "dst").alias("id"), F.lit("Resource").alias("node_type"), F.col("dst").alias("arn"), F.col("dst").alias("name"), F.col("dst").alias("label")).distinct()
    edges = acts.select("src", F.concat(F.lit("resource:"), "dst").alias("dst"), F.lit("ActsOn").alias("relation"))
    member = found.where("type = 'aws_iam_user_group_membership'").select(_name(_field("user")).alias("u"), F.explode(F.from_json(_field("groups"), "array<string>")).alias("g"))
    edges = edges.unionByName(member.select(F.concat(F.lit("user:"), "u").alias("src"), F.concat(F.lit("group:"), _name(F.col("g"))).alias("dst"), F.lit("MemberOf").alias("relation")))
    att = None
    for w in ("user", "role", "group"):
        one = found.where(F.col("type") == f"aws_iam_{w}_policy_attachment").select(F.concat(F.lit(f"{w}:"), _name(_field(w))).alias("src"), _name(_field("policy_arn")).alias("p"))
        att = one if att is None else att.unionByName(one)
    pol = nodes.where("node_type = 'Policy'")
    by = lambda c, x: pol.select(F.col(c).alias("p"), F.col("id").alias(x)).dropDuplicates(["p"])
    bound = att.join(by("label", "i1"), "p", "left").join(by("arn", "i2"), "p", "left").join(by("name", "i3"), "p", "left")
    target = F.coalesce("i1", "i2", "i3", F.concat(F.lit("policy:"), F.element_at(F.split("p", "/"), -1)))
    attached = bound.select("src", target.alias("dst"), F.lit("AttachedWith").alias("relation"), "p")
    outside = attached.join(pol.select(F.col("id").alias("dst")), "dst", "left_anti").select(F.col("dst").alias("id"), F.lit("Policy").alias("node_type"), F.col("p").alias("arn"), F.element_at(F.split("p", "/"), -1).alias("name"), F.element_at(F.split("p", "/"), -1).alias("label")).distinct()
    trust = s.where("type = 'aws_iam_role' and effect = 'Allow'").select(F.concat(F.lit("role:"), "label").alias("dst"), F.explode(F.try_element_at("principal", F.lit("AWS"))).alias("who"))
    near = trust.withColumn("key", _name(F.col("who"))).join(nodes.where("node_type in ('User', 'Role')").select(F.col("id").alias("src"), "arn", "label", F.col("name").alias("nm")), (F.col("key") == F.col("arn")) | (F.col("key") == F.col("label")) | (F.col("key") == F.col("nm")))
    edges = edges.unionByName(attached.drop("p")).unionByName(near.select("src", "dst", F.lit("AssumesRole").alias("relation"))).distinct()
    return nodes.unionByName(resources).unionByName(outside), edges


#: The catalogue's categories.
CATEGORIES = ("enterprise", "escalation", "benchmark", "modules", "serverless")


def read_catalogue(spark: SparkSession, path: str, category: str | None = None) -> DataFrame:
    """Rows of a repository catalogue file {"repositories": [...]}, of one category if asked."""
    rows = spark.read.option("multiLine", True).json(path).select(F.explode("repositories").alias("r")).select("r.*")
    return rows.where(F.col("category") == category) if category else rows


def clone(url: str, directory: str, shallow: bool = True, timeout: int = 300) -> None:
    """Fetch or update a repository on the driver; needs git and a network."""
    import os
    import subprocess

    there = os.path.isdir(f"{directory}/.git")
    command = ["git", "-C", directory, "pull", "--ff-only"] if there else ["git", "clone", *(["--depth", "1"] if shallow else []), url, directory]
    subprocess.run(command, check=True, timeout=timeout)


#: A small environment that uses each kind of block, for tests and demonstrations.
FIXTURE = """
# users, groups and roles
resource "aws_iam_user" "ana" { name = "data-analyst" path = "/analytics/" }
resource "aws_iam_group" "ops" { name = "ops" }
resource "aws_iam_user_group_membership" "m" { user = aws_iam_user.ana.name  groups = [aws_iam_group.ops.name] }
data "aws_iam_policy_document" "trust" {
  statement {
    actions = ["sts:AssumeRole"]
    principals { type = "AWS" identifiers = [aws_iam_user.ana.arn] }
  }
}
resource "aws_iam_role" "worker" { name = "worker" assume_role_policy = data.aws_iam_policy_document.trust.json }
resource "aws_iam_policy" "read" {
  name   = "read"
  policy = jsonencode({ Version = "2012-10-17", Statement = [{ Effect = "Allow", Action = "s3:GetObject", Resource = ["arn:aws:s3:::lake/x"] }] })
}
resource "aws_iam_policy" "write" {
  name   = "write"
  policy = <<EOF
{"Version": "2012-10-17", "Statement": {"Effect": "Allow", "Action": ["s3:PutObject"], "Resource": "*"}}
EOF
}
resource "aws_iam_role_policy_attachment" "a" { role = aws_iam_role.worker.name policy_arn = aws_iam_policy.read.arn }
resource "aws_iam_group_policy_attachment" "b" { group = "ops" policy_arn = "arn:aws:iam::aws:policy/ReadOnlyAccess" }
"""

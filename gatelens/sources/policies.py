"""Policy documents as JSON text: reading, checking and writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("Sid", "Effect", "Principal", "NotPrincipal", "Action", "NotAction", "Resource", "NotResource", "Condition")


def _list(v: Column, path: str) -> Column:
    """A string or an array of strings, as an array."""
    one = F.try_variant_get(v, path, "string")
    return F.coalesce(F.try_variant_get(v, path, "array<string>"), F.when(one.isNotNull(), F.array(one)))


def _principal(v: Column, path: str) -> Column:
    """``*`` or kinds of names as map<kind, names>."""
    text = F.try_variant_get(v, path, "string")
    kinds = F.try_variant_get(v, path, "map<string, variant>")
    each = F.transform_values(kinds, lambda _, x: F.coalesce(F.try_variant_get(x, "$", "array<string>"), F.array(F.try_variant_get(x, "$", "string"))))
    return F.when(kinds.isNotNull(), each).when(text.isNotNull(), F.create_map(F.lit("*"), F.array(text)))


def _condition(v: Column) -> Column:
    blocks = F.try_variant_get(v, "$.Condition", "map<string, map<string, variant>>")
    return F.transform_values(blocks, lambda _, keys: F.transform_values(keys, lambda _, x: F.coalesce(F.try_variant_get(x, "$", "array<string>"), F.array(F.try_variant_get(x, "$", "string")))))


def parse(documents: DataFrame) -> DataFrame:
    """documents(policy_id, doc) -> statements with policy_id, pos and an ``error``, null if the statement is sound.

    A single statement counts as a list of one. A text that isn't JSON, and one without statements, gives one row with
    an error. Exactly one of Action and NotAction, and at most one of Resource and NotResource, may be there.
    """
    v = documents.select("policy_id", F.try_parse_json("doc").alias("v"))
    many = F.try_variant_get("v", "$.Statement", "array<variant>")
    one = F.try_variant_get("v", "$.Statement", "variant")
    listed = v.select("policy_id", F.col("v").isNull().alias("bad"), F.posexplode_outer(F.coalesce(many, F.when(one.isNotNull(), F.array(one)))).alias("pos", "s"))
    s = F.col("s")
    text = lambda name: F.try_variant_get(s, f"$.{name}", "string")
    there = lambda name: F.try_variant_get(s, f"$.{name}", "variant").isNotNull()
    keys = F.map_keys(F.try_variant_get(s, "$", "map<string, variant>"))
    error = (
        F.when(F.col("bad"), "not JSON")
        .when(s.isNull(), "no statement")
        .when(F.size(F.array_except(keys, F.array(*[F.lit(f) for f in FIELDS]))) > 0, "unknown key")
        .when(~F.coalesce(text("Effect").isin("Allow", "Deny"), F.lit(False)), "effect")
        .when(there("Action") == there("NotAction"), "Action and NotAction")
        .when(there("Resource") & there("NotResource"), "Resource and NotResource")
    )
    return listed.select(
        "policy_id", "pos", F.coalesce(text("Sid"), F.concat("policy_id", F.lit("#"), F.col("pos").cast("string"))).alias("sid"), text("Effect").alias("effect"),
        _principal(s, "$.Principal").alias("principal"), _principal(s, "$.NotPrincipal").alias("not_principal"), _list(s, "$.Action").alias("action"), _list(s, "$.NotAction").alias("not_action"),
        _list(s, "$.Resource").alias("resource"), _list(s, "$.NotResource").alias("not_resource"), _condition(s).alias("condition"), error.alias("error"),
    )


def read(spark, path: str) -> DataFrame:
    """Statements of JSON policy files, a document each; the file's name is the policy_id."""
    return parse(spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]*)$", 1).alias("policy_id"), F.col("value").alias("doc")))


def to_json(statements: DataFrame) -> DataFrame:
    """(policy_id, doc): documents again, absent fields left out."""
    full = lambda c: F.when(F.size(c) > 0, F.col(c))
    s = F.struct("pos", F.struct(F.col("sid").alias("Sid"), F.col("effect").alias("Effect"), F.col("principal").alias("Principal"), F.col("not_principal").alias("NotPrincipal"), full("action").alias("Action"), full("not_action").alias("NotAction"),
                                 full("resource").alias("Resource"), full("not_resource").alias("NotResource"), F.col("condition").alias("Condition")).alias("s"))
    g = statements.groupBy("policy_id").agg(F.transform(F.array_sort(F.transform(F.collect_list(s), lambda x: F.struct(x["pos"], F.to_json(x["s"]).alias("j")))), lambda x: x["j"]).alias("list"))
    return g.select("policy_id", F.concat(F.lit('{"Version":"2012-10-17","Statement":['), F.array_join("list", ","), F.lit("]}")).alias("doc"))

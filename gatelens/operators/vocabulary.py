"""Action vocabulary: numbers for actions, multi-hot vectors of action sets, and the file that keeps it."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatelens.functions.globs import action_matches, normal_action
from gatelens.plans.steps import step

#: What stands for unknown actions, and its number.
OOV, OOV_INDEX = "<OOV>", 0


def numbered(df: DataFrame, *order: str, name: str = "idx") -> DataFrame:
    """df with numbers from 0 in the order of some columns.

    Rows are sorted in ranges, numbered within each, and the ranges' counts, one row each, are added up; no task gets all.
    """
    ranged = step(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    first = ranged.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn(name, within).join(F.broadcast(first), "_range").withColumn(name, F.col(name) + F.col("_first")).drop("_range", "_first")


def build(actions: DataFrame) -> DataFrame:
    """(idx, action) of actions(action): distinct names without regard to case, trimmed, sorted, from 1; 0 is left for OOV."""
    names = actions.select(F.trim("action").alias("action")).where("action <> ''")
    one = names.groupBy(F.lower("action").alias("key")).agg(F.min("action").alias("action"))
    return numbered(one, "key").select((F.col("idx") + 1).cast("int").alias("idx"), "action")


def encode(sets: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, indices) of sets(id, actions): sorted numbers; patterns stand for all that they match, what is unknown for OOV."""
    asked = sets.select("id", F.explode_outer("actions").alias("said")).where("said is not null")
    wild = F.rlike("said", F.lit(r"[*?\[]"))
    exact = asked.where(~wild).join(vocabulary, normal_action(F.col("said")) == normal_action(F.col("action")), "left").select("id", "idx")
    patterns = asked.where(wild).select("said").distinct()
    hits = patterns.join(F.broadcast(vocabulary), action_matches(F.col("action"), F.col("said")), "left").select("said", "idx")  # one row for each known action
    loose = asked.where(wild).join(hits, "said").select("id", "idx")
    found = exact.unionByName(loose).groupBy("id").agg(F.array_sort(F.collect_set(F.coalesce("idx", F.lit(OOV_INDEX)))).alias("indices"))
    return sets.select("id").join(found, "id", "left").select("id", F.coalesce("indices", F.expr("cast(array() as array<int>)")).alias("indices"))


def multi_hot(indices: Column, size: int) -> Column:
    """Vector of ``size`` numbers, OOV's first, that is 1 at the indices."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(F.array_contains(indices, i), 1.0).otherwise(0.0))


def decode(vectors: DataFrame, vocabulary: DataFrame, threshold: float = 0.5, with_oov: bool = False) -> DataFrame:
    """(id, actions) of vectors(id, vector): names, in the order of their numbers, where the vector reaches the threshold."""
    names = vocabulary.unionByName(vocabulary.sparkSession.createDataFrame([(OOV_INDEX, OOV)], "idx int, action string")) if with_oov else vocabulary
    at = vectors.select("id", F.posexplode("vector").alias("idx", "v")).where(F.col("v") >= threshold)
    found = at.join(names, "idx").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("idx", "action"))).alias("x")).select("id", F.transform("x", lambda x: x["action"]).alias("actions"))
    return vectors.select("id").join(found, "id", "left").select("id", F.coalesce("actions", F.expr("cast(array() as array<string>)")).alias("actions"))


def to_json(vocabulary: DataFrame) -> str:
    """The file's text; a vocabulary is as long as the catalogue of actions."""
    actions = [r["action"] for r in vocabulary.orderBy("idx").collect()]
    return json.dumps({"oov_token": OOV, "vocab_size": len(actions) + 1, "actions": actions}, indent=2)


def write(vocabulary: DataFrame, path: str) -> None:
    vocabulary.sparkSession.createDataFrame([(to_json(vocabulary),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Numbers are given anew from the names that are read, as they are when a vocabulary is built."""
    said = spark.read.text(path, wholetext=True).select(F.from_json("value", "actions array<string>").alias("v"))
    return build(said.select(F.explode("v.actions").alias("action")))


def feature_sizes(vocabulary_size: int) -> dict[str, int]:
    """The length of each node type's feature vector over a vocabulary of this size, OOV included."""
    return {"User": 20 + vocabulary_size, "Role": 21 + vocabulary_size, "Policy": 8 + vocabulary_size, "Group": 11 + vocabulary_size, "Resource": 20}


def effective_actions(nodes: DataFrame, edges: DataFrame, statements: DataFrame) -> DataFrame:
    """(principal, actions): of the policies attached to a principal or to its groups, the actions that statements of
    policy_id allow and the actions of the policies' ActsOn edges; sorted."""
    from gatelens.operators.policy import owners

    attached = edges.where("relation = 'AttachedWith'").select(F.col("src").alias("owner"), F.col("dst").alias("policy")).distinct()
    said = statements.where("effect = 'Allow'").select(F.col("policy_id").alias("policy"), F.explode("action").alias("action"))
    if "actions" in edges.columns:
        said = said.unionByName(edges.where("relation = 'ActsOn'").select(F.col("src").alias("policy"), F.explode("actions").alias("action")))
    # an owner's different actions first: members are then never paired with the policies of their group
    held = attached.join(said, "policy").groupBy("owner").agg(F.collect_set("action").alias("held"))
    who = nodes.where("node_type in ('User', 'Role')").select(F.col("id").alias("principal"))
    of = owners(edges, who.select(F.col("principal").alias("id"))).withColumnRenamed("id", "principal")
    got = of.join(held, "owner").groupBy("principal").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("held")))).alias("actions"))
    return who.join(got, "principal", "left").select("principal", F.coalesce("actions", F.expr("cast(array() as array<string>)")).alias("actions"))

"""Link predictors: tree ensembles over pair features, and a relational graph encoder with a bilinear decoder."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelens.functions.scalars import one_hot, uniform
from gatelens.operators.graph import NODE_TYPES, RELATIONS, relation_degrees
from gatelens.plans.steps import shared_folder, step


def assembled(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """The feature columns as one vector, with weights that balance the labels."""
    v = VectorAssembler(inputCols=columns, outputCol="features").transform(pairs)
    share = pairs.agg(F.avg("y").alias("share"))
    w = F.when(F.col("y") == 1, 0.5 / F.greatest("share", F.lit(1e-9))).otherwise(0.5 / F.greatest(1 - F.col("share"), F.lit(1e-9)))
    return v.crossJoin(F.broadcast(share)).withColumn("weight", w).drop("share")


def random_forest(train: DataFrame, columns: list[str], trees: int = 100, depth: int = 15, seed: int = 7):
    """The fitted forest, written to the shared folder and read back: a fresh one holds its training summary and with it
    the session, which can't travel to executors once the session has observed a metric."""
    fitted = RandomForestClassifier(featuresCol="features", labelCol="y", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed).fit(assembled(train, columns))
    path = f"{shared_folder(train.sparkSession)}/forest-{uuid.uuid4().hex}"
    fitted.write().save(path)
    return RandomForestClassificationModel.load(path)


def boosted_trees(train: DataFrame, columns: list[str], rounds: int = 150, depth: int = 5, rate: float = 0.05, seed: int = 7):
    return GBTClassifier(featuresCol="features", labelCol="y", weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed).fit(assembled(train, columns))


def predict(model, pairs: DataFrame, columns: list[str]) -> DataFrame:
    """pairs with ``score``, the probability of label 1."""
    v = VectorAssembler(inputCols=columns, outputCol="features").transform(pairs)
    return model.transform(v).withColumn("score", vector_to_array("probability")[1]).select(*pairs.columns, "score")


def node_features(nodes: DataFrame, edges: DataFrame, departments: tuple[str, ...], accounts: tuple[str, ...] = ()) -> DataFrame:
    """(id, x): type, department and, of the named ones, account codes, flags, and log degrees by relation."""
    d = relation_degrees(nodes, edges)
    deg = F.array(*[F.col(c) for c in d.columns if c != "id"])
    flag = lambda c: F.array(F.col(c).cast("double"))
    account = [one_hot(F.col("account_id"), (*accounts, "other"))] if accounts else []
    return nodes.join(d, "id").select("id", F.concat(one_hot(F.col("node_type"), (*NODE_TYPES, "other")), one_hot(F.col("department"), (*departments, "other")), *account, flag("is_admin"), flag("is_high_value"), deg).alias("x"))


def without_centrality(x: Column, first: int) -> Column:
    """Features with the places from ``first`` on set to zero, for ablations."""
    return F.transform(x, lambda v, i: F.when(i >= first, 0.0).otherwise(v))


def encode(nodes: DataFrame, edges: DataFrame, features: DataFrame, dim: int = 16, bases: int = 4, layers: int = 2, seed: int = 7, typed: bool = True) -> DataFrame:
    """(id, z): layers of mean messages per relation and direction, each with its own matrix made of shared bases, a
    residual, normalisation and a leaky ramp. Messages are a join and an average in the JVM; only the small matrices
    go to Python, in Arrow batches. ``typed=False`` shares one matrix: the ablation without relation types."""
    draw = np.random.default_rng(seed)
    width = len(features.select("x").first()["x"])
    relations = [r for name in RELATIONS for r in (name, f"Rev{name}")] if typed else ["any"]
    both = edges.select("src", "dst", "relation").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.concat(F.lit("Rev"), "relation").alias("relation")))
    both = step(both if typed else both.withColumn("relation", F.lit("any")))
    h = step(features)
    for layer in range(layers):
        fan = width if layer == 0 else dim
        base = draw.standard_normal((bases, fan, dim)) / np.sqrt(fan)
        mixing = draw.standard_normal((len(relations), bases)) / np.sqrt(bases)
        own = draw.standard_normal((fan, dim)) / np.sqrt(fan)
        weights = {r: np.tensordot(mixing[i], base, 1) for i, r in enumerate(relations)}

        def combine(batches, weights=weights, own=own):
            for b in batches:
                z = np.stack(b["x"].to_numpy()) @ own
                for r, w in weights.items():
                    have = b[r].notna().to_numpy()
                    if have.any():
                        z[have] += np.stack(b.loc[have, r].to_numpy()) @ w
                z = (z - z.mean(axis=1, keepdims=True)) / (z.std(axis=1, keepdims=True) + 1e-5)
                yield pd.DataFrame({"id": b["id"], "x": list(np.where(z > 0, z, 0.2 * z))})

        sent = both.join(h.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id"), "relation").agg(Summarizer.mean(array_to_vector("x")).alias("m"))
        wide = sent.groupBy("id").pivot("relation", relations).agg(F.first(vector_to_array("m")))
        h = step(h.join(wide, "id", "left").select("id", "x", *relations).mapInPandas(combine, "id string, x array<double>"))
    return h.withColumnRenamed("x", "z")


def bilinear(a: Column, b: Column, weight: Column) -> Column:
    """DistMult: the sum of products along the places, as a logit."""
    return F.aggregate(F.zip_with(F.zip_with(a, b, lambda x, y: x * y), weight, lambda x, w: x * w), F.lit(0.0), lambda acc, v: acc + v)


def train_decoder(pairs: DataFrame, z: DataFrame, rounds: int = 50, penalty: float = 0.01):
    """A relation's weights, as a logistic regression over products of the ends' codes; pairs: (u, v, y)."""
    data = with_codes(pairs, z).withColumn("features", array_to_vector(F.zip_with("zu", "zv", lambda x, y: x * y)))
    return LogisticRegression(featuresCol="features", labelCol="y", maxIter=rounds, regParam=penalty).fit(data)


def with_codes(pairs: DataFrame, z: DataFrame) -> DataFrame:
    return pairs.join(z.select(F.col("id").alias("u"), F.col("z").alias("zu")), "u").join(z.select(F.col("id").alias("v"), F.col("z").alias("zv")), "v")


def score_links(pairs: DataFrame, z: DataFrame, model) -> DataFrame:
    """(u, v, logit) of pairs, from a trained decoder."""
    w = F.array(*[F.lit(float(x)) for x in model.coefficients])
    return with_codes(pairs, z).select("u", "v", (bilinear(F.col("zu"), F.col("zv"), w) + float(model.intercept)).alias("logit"))


def focal_loss(df: DataFrame, gamma: float = 2.0, alpha: float = 0.25) -> DataFrame:
    """One row: mean focal loss of (y, score)."""
    p = F.least(F.greatest(F.col("score"), F.lit(1e-7)), F.lit(1 - 1e-7))
    pt = F.when(F.col("y") == 1, p).otherwise(1 - p)
    at = F.when(F.col("y") == 1, alpha).otherwise(1 - alpha)
    return df.agg(F.avg(-at * F.pow(1 - pt, F.lit(gamma)) * F.log(pt)).alias("focal"))


def labelled_pairs(positives: DataFrame, negatives: DataFrame, test_share: float = 0.3, seed: str = "0") -> DataFrame:
    """(u, v, y, test): a split by hash."""
    p = positives.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.lit(1).alias("y")).unionByName(negatives.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.lit(0).alias("y")))
    return p.withColumn("test", uniform(F.lit("split"), F.lit(seed), "u", "v") < test_share)


def evaluate_suite(predictors: dict, edges: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Metrics of each predictor, a callable (edges, nodes, pairs) -> (u, v, score): one row for each."""
    from gatelens.functions import metrics

    scored = None
    for name, predictor in predictors.items():
        one = pairs.join(predictor(edges, nodes, pairs).select("u", "v", "score"), ["u", "v"]).select(F.lit(name).alias("model"), "u", "v", "y", "score", F.concat_ws("|", "u", "v").alias("tie"))
        scored = one if scored is None else scored.unionByName(one)
    scored, by = step(scored), ["model"]
    out = metrics.pr_auc(scored, by)
    for m in (metrics.roc_auc(scored, by), metrics.recall_at_k(scored, by, [10, 50]), metrics.reciprocal_rank(scored, by), metrics.false_negative_rate(scored, by), metrics.nll(scored, by), metrics.expected_calibration_error(scored, by)):
        out = out.join(m, by)
    return out

"""Ranking, classification and calibration metrics of scored pairs, per group.

Input: group columns, ``y`` (0 or 1), ``score``, a ``tie`` key for ranks, and where needed ``is_bridge``. Cumulative
sums run over distinct scores per group, not over rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatelens.plans.steps import step


def _steps(df: DataFrame, by: list[str]) -> DataFrame:
    """Per distinct score: positives and rows at it, cumulated from the highest score, and the totals."""
    each = df.groupBy(*by, "score").agg(F.sum("y").alias("tp"), F.count("*").alias("n"))
    falling = Window.partitionBy(*by).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    return each.select(*by, "score", "tp", "n", F.sum("tp").over(falling).alias("ctp"), F.sum("n").over(falling).alias("cn"), F.sum("tp").over(whole).alias("p"), F.sum("n").over(whole).alias("all"))


def pr_auc(df: DataFrame, by: list[str]) -> DataFrame:
    """Average precision by steps; 0 without positives, 1 without negatives."""
    s = _steps(df, by)
    ap = F.sum(F.when(F.col("p") > 0, F.col("tp") / F.col("p") * F.col("ctp") / F.col("cn")).otherwise(0.0))
    return s.groupBy(*by).agg(F.when(F.max("p") == 0, 0.0).when(F.max("p") == F.max("all"), 1.0).otherwise(ap).alias("pr_auc"))


def pr_auc_in_ranges(df: DataFrame) -> float:
    """The same of all rows as one group, however many: scores are cumulated in sorted ranges, and the ranges' sums, one row each."""
    each = df.groupBy("score").agg(F.sum("y").alias("tp"), F.count("*").alias("n"))
    ranged = step(each.repartitionByRange(F.desc("score")).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_range").agg(F.sum("tp").alias("_tp"), F.sum("n").alias("_n"))
    sums = sums.select("_range", F.coalesce(F.sum("_tp").over(before), F.lit(0)).alias("_tp"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"))
    falling = Window.partitionBy("_range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    s = ranged.withColumn("ctp", F.sum("tp").over(falling)).withColumn("cn", F.sum("n").over(falling)).join(F.broadcast(sums), "_range")
    won = F.try_divide(F.col("tp") * (F.col("ctp") + F.col("_tp")), F.col("cn") + F.col("_n"))
    p, rows, ap = s.agg(F.sum("tp"), F.sum("n"), F.sum(won)).first()
    return 0.0 if not p else 1.0 if p == rows else ap / p


def roc_auc(df: DataFrame, by: list[str]) -> DataFrame:
    """Share of positive-negative pairs in order, ties one half; 0.5 with one class only."""
    s = _steps(df, by)
    # negatives below a score, and half of those at it
    below = (F.col("all") - F.col("p")) - (F.col("cn") - F.col("ctp")) + (F.col("n") - F.col("tp")) / 2
    won = F.sum(F.col("tp") * below) / (F.max("p") * (F.max("all") - F.max("p")))
    return s.groupBy(*by).agg(F.when((F.max("p") == 0) | (F.max("p") == F.max("all")), 0.5).otherwise(won).alias("roc_auc"))


def false_negative_rate(df: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    p = F.sum("y")
    return df.groupBy(*by).agg(F.when(p == 0, 0.0).otherwise(F.sum(F.when((F.col("y") == 1) & (F.col("score") < threshold), 1).otherwise(0)) / p).alias("fnr"))


def ranked(df: DataFrame, by: list[str]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "tie")))


def recall_at_k(df: DataFrame, by: list[str], ks: list[int]) -> DataFrame:
    """Only positive scores count; 1 without positives."""
    r, p = ranked(df, by), F.sum("y")
    got = lambda k: F.sum(F.when((F.col("y") == 1) & (F.col("rank") <= k) & (F.col("score") > 0), 1).otherwise(0))
    return r.groupBy(*by).agg(*[F.when(p == 0, 1.0).otherwise(got(k) / p).alias(f"recall_at_{k}") for k in ks])


def reciprocal_rank(df: DataFrame, by: list[str]) -> DataFrame:
    return ranked(df, by).groupBy(*by).agg(F.coalesce(1.0 / F.min(F.when((F.col("y") == 1) & (F.col("score") > 0), F.col("rank"))), F.lit(0.0)).alias("mrr"))


def path_recovery_at_k(df: DataFrame, by: list[str], ks: list[int]) -> DataFrame:
    """Share of bridges ranked within k, those without a positive score far behind; recall at k where there is no bridge."""
    r = ranked(df, by)
    whole = F.count("*").over(Window.partitionBy(*by))
    r = r.withColumn("place", F.when(F.col("score") > 0, F.col("rank")).otherwise(whole + 999))
    n, p = F.sum(F.col("is_bridge").cast("int")), F.sum("y")
    bridge = lambda k: F.sum(F.when(F.col("is_bridge") & (F.col("place") <= k), 1).otherwise(0)) / n
    recall = lambda k: F.when(p == 0, 1.0).otherwise(F.sum(F.when((F.col("y") == 1) & (F.col("rank") <= k) & (F.col("score") > 0), 1).otherwise(0)) / p)
    return r.groupBy(*by).agg(*[F.when(n > 0, bridge(k)).otherwise(recall(k)).alias(f"recovery_at_{k}") for k in ks])


def nll(df: DataFrame, by: list[str]) -> DataFrame:
    q = F.least(F.greatest(F.col("score"), F.lit(1e-7)), F.lit(1 - 1e-7))
    return df.groupBy(*by).agg((-F.avg(F.col("y") * F.log(q) + (1 - F.col("y")) * F.log(1 - q))).alias("nll"))


def calibration_bins(df: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Per bin: count, mean score (the middle if empty), share of positives, gap. The last bin is closed above."""
    place = F.least(F.size(F.filter(F.sequence(F.lit(1), F.lit(bins)), lambda i: F.col("score") >= i * (1.0 / bins))), F.lit(bins - 1))
    got = df.withColumn("bin", place).groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("score").alias("conf"), F.avg("y").alias("acc"))
    grid = df.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(got, [*by, "bin"], "left").select(
        *by, "bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("conf", (F.col("bin") + 0.5) / bins).alias("conf"), F.coalesce("acc", F.lit(0.0)).alias("acc"),
        F.coalesce(F.abs(F.col("conf") - F.col("acc")), F.lit(0.0)).alias("gap"),
    )


def expected_calibration_error(df: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    b = calibration_bins(df, by, bins)
    return b.groupBy(*by).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"), F.max("gap").alias("mce"))


#: Two-sided 95 % quantiles of Student's t for 1 to 10 degrees of freedom; 1.96 beyond.
T_95 = (12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228)


def confidence_interval(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(mean, std, low, high, n), the interval clipped to [0, 1]; a single value is its own interval."""
    t = F.lit(1.96)
    for dof, q in enumerate(T_95, 1):
        t = F.when(F.col("n") == dof + 1, q).otherwise(t)
    a = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.count(value).alias("n"))
    half = F.when(F.col("n") <= 1, 0.0).otherwise(t * F.col("std") / F.sqrt("n"))
    return a.select(*by, "mean", "std", F.greatest(F.lit(0.0), F.col("mean") - half).alias("low"), F.least(F.lit(1.0), F.col("mean") + half).alias("high"), "n")


def fit_temperature(df: DataFrame, logit: str = "logit", rounds: int = 40) -> float:
    """The temperature in [0.01, 100] with the least NLL: a golden-section search in log T, one aggregate a step."""
    import math

    def loss(log_t: float) -> float:
        p = 1 / (1 + F.exp(-F.col(logit) / math.exp(log_t)))
        return nll(df.select(F.lit(1).alias("g"), "y", p.alias("score")), ["g"]).collect()[0]["nll"]

    low, high, cut = math.log(0.01), math.log(100), (math.sqrt(5) - 1) / 2
    a, b = high - cut * (high - low), low + cut * (high - low)
    fa, fb = loss(a), loss(b)
    for _ in range(rounds):
        if high - low < 1e-4:
            break
        if fa < fb:
            high, b, fb = b, a, fa
            a = high - cut * (high - low)
            fa = loss(a)
        else:
            low, a, fa = a, b, fb
            b = low + cut * (high - low)
            fb = loss(b)
    return math.exp((low + high) / 2)

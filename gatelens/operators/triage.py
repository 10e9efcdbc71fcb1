"""Triage rows and posture figures for review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.functions.scalars import severity


def records(nodes: DataFrame, reached: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """A row for each user and role: probability of a latent path, severity, blast radius.

    reached: (source, target, frequency); a report (id, probability) goes before the largest frequency.
    """
    best = reached.groupBy(F.col("source").alias("id")).agg(F.max("frequency").alias("p"), F.count_distinct("target").alias("blast_radius"))
    t = nodes.where("node_type in ('User', 'Role')").join(best, "id", "left")
    if reports is not None:
        t = t.join(reports.select("id", F.col("probability").alias("reported")), "id", "left").withColumn("p", F.coalesce("reported", "p")).drop("reported")
    p = F.coalesce("p", F.lit(0.0))
    return t.select("id", "node_type", "department", "is_admin", p.alias("probability"), severity(p).alias("severity"), F.coalesce("blast_radius", F.lit(0)).alias("blast_radius"))


def ordered(triage: DataFrame, most: int | None = None) -> DataFrame:
    """By probability, then by severity from critical down, then by id; the first ``most`` if asked."""
    place = F.array_position(F.array(*[F.lit(s) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")]), F.col("severity"))
    out = triage.orderBy(F.desc("probability"), place, "id")
    return out if most is None else out.limit(most)


def search(triage: DataFrame, department: str | None = None, severity: str | None = None, text: str | None = None) -> DataFrame:
    """Department in either case, severity, and text anywhere in id, type, department or severity."""
    if department:
        triage = triage.where(F.lower("department") == department.lower())
    if severity:
        triage = triage.where(F.col("severity") == severity)
    if text:
        triage = triage.where(F.contains(F.lower(F.concat_ws("\n", "id", "node_type", "department", "severity")), F.lit(text.lower())))
    return triage


def display(triage: DataFrame) -> DataFrame:
    return triage.select("id", F.coalesce("department", F.lit("Unknown")).alias("department"), F.concat(F.format_number(F.col("probability") * 100, 1), F.lit(" %")).alias("probability"), "severity", "blast_radius")


def posture(triage: DataFrame) -> DataFrame:
    """One row of counts by type and severity, flagged principals and mean blast radius."""
    s = lambda name: F.count_if(F.col("severity") == name).alias(name.lower())
    return triage.agg(F.count("*").alias("principals"), F.count_if(F.col("node_type") == "User").alias("users"), F.count_if(F.col("node_type") == "Role").alias("roles"), s("CRITICAL"), s("HIGH"), s("MEDIUM"), s("LOW"),
                      F.count_if(F.col("probability") > 0.15).alias("flagged"), F.round(F.coalesce(F.avg("blast_radius"), F.lit(0.0)), 6).alias("mean_blast_radius"))

"""Small column functions: reproducible draws, resource names, encodings, calibration."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, in the order in which a name's type is looked for.
SERVICES = ("iam", "s3", "kms", "lambda", "ec2", "sts", "sagemaker", "codebuild", "glue", "other")
TYPES = ("bucket", "key", "function", "instance", "role", "user", "policy", "notebook-instance", "project", "devendpoint", "other")


def uniform(*key: Column) -> Column:
    """A draw from [0, 1) that depends on the key alone, the same in any engine with md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *key).cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


def arn_account(arn: Column) -> Column:
    part = F.try_element_at(F.split(arn, ":"), F.lit(5))
    return F.when(F.coalesce(part.rlike("^[0-9]{12}$"), F.lit(False)), part).otherwise(F.lit(""))


def arn_service_type(arn: Column) -> Column:
    """struct<service, type>; a type is the first that equals the prefix or is anywhere in the remainder."""
    name = F.lower(F.trim(arn))
    parts = F.split(name, ":")
    service = F.try_element_at(parts, F.lit(3))
    rest = F.when(F.size(parts) >= 6, F.array_join(F.slice(parts, F.lit(6), F.size(parts)), ":")).otherwise(F.lit(""))
    rest = F.when((rest == "") & (F.size(parts) >= 5), F.try_element_at(parts, F.lit(5))).otherwise(rest)
    kind = F.lit("other")
    for t in reversed(TYPES[:-1]):
        kind = F.when(F.contains(rest, F.lit(t)), t).otherwise(kind)
    known = F.when(service.isin(*SERVICES), service).otherwise(F.lit("other"))
    return F.when(~F.startswith(name, F.lit("arn:aws:")), F.struct(F.lit("other").alias("service"), F.lit("other").alias("type"))).when(
        service == "s3", F.struct(F.lit("s3").alias("service"), F.lit("bucket").alias("type"))
    ).otherwise(F.struct(known.alias("service"), kind.alias("type")))


def one_hot(value: Column, categories: tuple[str, ...]) -> Column:
    """array<double>, case ignored; null or unknown sets the last place."""
    at = F.array_position(F.array(*[F.lit(c.lower()) for c in categories]), F.lower(F.trim(value)))
    place = F.when(F.coalesce(at, F.lit(0)) == 0, len(categories)).otherwise(at)
    return F.transform(F.sequence(F.lit(1), F.lit(len(categories))), lambda i: F.when(i == place, 1.0).otherwise(0.0))


def reversed_relation(relation: Column) -> Column:
    return F.when(F.startswith(relation, F.lit("Rev")), F.regexp_replace(relation, "^Rev", "")).otherwise(F.concat(F.lit("Rev"), relation))


def sigmoid(logit: Column, temperature: float | Column = 1.0) -> Column:
    return 1 / (1 + F.exp(-logit / temperature))


def logit(p: Column, edge: float = 1e-7) -> Column:
    q = F.least(F.greatest(p, F.lit(edge)), F.lit(1 - edge))
    return F.log(q / (1 - q))


def severity(p: Column) -> Column:
    return F.when(p >= 0.70, "CRITICAL").when(p >= 0.40, "HIGH").when(p >= 0.15, "MEDIUM").otherwise("LOW")

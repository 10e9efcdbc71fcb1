"""What actions can be narrowed to: the capability snapshot, and checks of edits against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens.functions.globs import glob_regex

#: Action, resource types (none: only on ``*``), condition keys.
ACTIONS = [
    ("iam:PassRole", ["role"], ["iam:PassedToService", "iam:AssociatedResourceArn"]),
    ("iam:CreateAccessKey", ["user"], []),
    ("iam:DeleteAccessKey", ["user"], []),
    ("iam:AttachRolePolicy", ["role"], ["iam:PolicyARN"]),
    ("iam:AttachUserPolicy", ["user"], ["iam:PolicyARN"]),
    ("iam:DetachRolePolicy", ["role"], ["iam:PolicyARN"]),
    ("iam:PutRolePolicy", ["role"], []),
    ("iam:PutUserPolicy", ["user"], []),
    ("iam:SetDefaultPolicyVersion", ["policy"], []),
    ("iam:CreatePolicyVersion", ["policy"], []),
    ("iam:ListRoles", [], []),
    ("iam:GetAccountAuthorizationDetails", [], []),
    ("iam:GetUser", ["user"], []),
    ("iam:GetRole", ["role"], []),
    ("sts:AssumeRole", ["role"], ["sts:RoleSessionName", "sts:ExternalId", "sts:TransitiveTagKeys"]),
    ("sts:AssumeRoleWithWebIdentity", ["role"], ["sts:RoleSessionName"]),
    ("sts:GetCallerIdentity", [], []),
    ("sts:GetSessionToken", [], []),
    ("lambda:CreateFunction", ["function"], ["lambda:Principal", "lambda:Layer"]),
    ("lambda:InvokeFunction", ["function"], ["lambda:Payload"]),
    ("lambda:UpdateFunctionCode", ["function"], []),
    ("ec2:RunInstances", ["instance", "image", "subnet", "security-group", "key-pair", "volume"], ["ec2:InstanceType", "ec2:Region", "ec2:Tenancy"]),
    ("ec2:DescribeInstances", [], []),
    ("s3:GetObject", ["object"], ["s3:ExistingObjectTag/*", "s3:VersionId"]),
    ("s3:PutObject", ["object"], ["s3:RequestObjectTag/*", "s3:x-amz-server-side-encryption"]),
    ("s3:ListBucket", ["bucket"], ["s3:prefix", "s3:delimiter"]),
    ("s3:DeleteObject", ["object"], ["s3:VersionId"]),
    ("kms:Decrypt", ["key"], ["kms:EncryptionContext:*", "kms:ViaService"]),
    ("kms:GenerateDataKey", ["key"], ["kms:KeySpec", "kms:EncryptionContext:*"]),
    ("kms:DescribeKey", ["key"], []),
    ("iam:UpdateAssumeRolePolicy", ["role"], []),
    ("glue:CreateDevEndpoint", ["devendpoint"], []),
    ("glue:GetDevEndpoint", ["devendpoint"], []),
    ("codebuild:StartBuild", ["project"], []),
    ("codebuild:CreateProject", ["project"], []),
    ("sagemaker:CreateNotebookInstance", ["notebook-instance"], []),
    ("sagemaker:CreatePresignedNotebookInstanceUrl", ["notebook-instance"], []),
]
#: Condition keys that every action takes.
GLOBAL_KEYS = [
    "aws:CurrentTime", "aws:EpochTime", "aws:MultiFactorAuthPresent", "aws:PrincipalArn", "aws:PrincipalAccount", "aws:PrincipalOrgID", "aws:PrincipalTag/*", "aws:PrincipalType", "aws:RequestedRegion",
    "aws:SecureTransport", "aws:SourceArn", "aws:SourceIp", "aws:TagKeys", "aws:TokenIssueTime", "aws:UserAgent", "aws:userId", "aws:username",
]
#: Types whose names stand between ``:`` and ``/``.
SLASHED = ("role", "user", "policy", "function", "key", "instance", "image", "subnet", "security-group", "volume", "devendpoint", "project", "notebook-instance")
SCHEMA = "action string, service string, wildcard_only boolean, resource_types array<string>, condition_keys array<string>"


def snapshot(spark: SparkSession) -> DataFrame:
    """The capability table, a row for each action."""
    return spark.createDataFrame([(a, a.split(":")[0], not types, types, keys) for a, types, keys in ACTIONS], SCHEMA)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The same from a JSON file: {"actions": {key: {...}}}."""
    one = f"map<string, struct<{', '.join(x.replace(' ', ': ', 1) for x in SCHEMA.split(', '))}>>"
    return spark.read.schema(f"actions {one}").option("multiLine", True).json(path).select(F.explode(F.map_values("actions")).alias("a")).select("a.*")


def supports_scoping(wildcard_only: Column, types: Column) -> Column:
    return ~wildcard_only & (F.size(types) > 0)


def type_matches(types: Column, resource: Column) -> Column:
    """Whether a resource name fits one of the types; ``*`` always does."""
    arn = F.lower(resource)
    bucket = F.element_at(F.split(F.concat(arn, F.lit(":::")), ":::"), 2)
    fits = lambda t: (
        (t.isin(*SLASHED) & F.contains(arn, F.concat(F.lit(":"), t, F.lit("/"))))
        | ((t == "function") & F.contains(arn, F.lit(":function:")))
        | ((t == "bucket") & F.contains(arn, F.lit("arn:aws:s3:::")) & ~F.contains(bucket, F.lit("/")))
        | ((t == "object") & F.contains(arn, F.lit("arn:aws:s3:::")))
    )
    return (resource == "*") | F.exists(types, lambda t: fits(F.lower(t)))


def key_supported(keys: Column, key: Column) -> Column:
    k = F.lower(F.trim(key))
    return F.exists(F.concat(keys, F.array(*[F.lit(x) for x in GLOBAL_KEYS])), lambda p: F.rlike(k, glob_regex(F.lower(F.trim(p)))))


def validate(edits: DataFrame, capability: DataFrame) -> DataFrame:
    """edits(action, resource, condition_keys) with is_valid and reason: unknown_action, wildcard_only, resource_type, condition_key or ok."""
    c = capability.select(F.lower(F.trim("action")).alias("_k"), "wildcard_only", "resource_types", F.col("condition_keys").alias("_keys"), F.lit(True).alias("known"))
    joined = edits.join(F.broadcast(c), F.lower(F.trim("action")) == F.col("_k"), "left")
    reason = (
        F.when(F.col("known").isNull(), "unknown_action")
        .when((F.col("resource") != "*") & F.col("wildcard_only"), "wildcard_only")
        .when((F.col("resource") != "*") & ~type_matches(F.col("resource_types"), F.col("resource")), "resource_type")
        .when(~F.forall(F.coalesce("condition_keys", F.expr("cast(array() as array<string>)")), lambda k: key_supported(F.col("_keys"), k)), "condition_key")
        .otherwise("ok")
    )
    return joined.select(*edits.columns, (reason == "ok").alias("is_valid"), reason.alias("reason"))


def validate_statements(statements: DataFrame, capability: DataFrame) -> DataFrame:
    """(sid, reasons): what is wrong with each action on each resource of a statement."""
    keys = F.flatten(F.transform(F.map_values("condition"), lambda m: F.map_keys(m)))
    pairs = statements.select("sid", F.explode("action").alias("action"), "resource", keys.alias("condition_keys")).select("sid", "action", F.explode("resource").alias("resource"), "condition_keys")
    checked = validate(pairs, capability).groupBy("sid").agg(F.array_sort(F.collect_list(F.when(~F.col("is_valid"), F.col("reason")))).alias("reasons"))
    return statements.select("sid").join(checked, "sid", "left").select("sid", F.coalesce("reasons", F.expr("cast(array() as array<string>)")).alias("reasons"))

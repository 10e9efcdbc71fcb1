"""The activity log as a stream: requests meet static statements, and windows count what a policy would break."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens.operators.policy import statement_applies


def read_events(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """A stream of the event files of a folder; times become timestamps, which watermarks need."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def as_requests(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    context = F.when(k.isNotNull(), F.create_map(F.lit("k"), F.array(k))).otherwise(F.expr("cast(map() as map<string, array<string>>)"))
    user = F.col("user_id").cast("string")
    return events.select(F.col("event_id").cast("string").alias("req_id"), F.concat(F.lit("arn:user/"), user).alias("principal_arn"), F.concat(F.lit("app:"), "event_type").alias("action"),
                         F.concat(F.lit("user/"), user).alias("resource_arn"), context.alias("context"), F.col("ts").cast("timestamp").alias("ts"))


def decided(requests: DataFrame, statements: DataFrame) -> DataFrame:
    """(req_id, ts, decision) of each request, without state: the statements, a stated few, are one array beside every
    request. A matching deny wins, else an allow, else implicit deny, as in the batch operator."""
    s = statements.agg(F.collect_list(F.struct("*")).alias("all"))
    r = requests.select(F.struct("*").alias("r")).crossJoin(F.broadcast(s))
    effects = r.select("r", F.transform(F.filter("all", lambda s: statement_applies(s, "r")), lambda s: s["effect"]).alias("effects"))
    decision = F.when(F.array_contains("effects", "Deny"), "ExplicitDeny").when(F.array_contains("effects", "Allow"), "Allow").otherwise("ImplicitDeny")
    return effects.select("r.req_id", "r.ts", decision.alias("decision"))


def breakage(decisions: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Windowed counts of requests by decision, and the share denied; windows close when the watermark passes them."""
    w = decisions.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"))
    counts = [F.count_if(F.col("decision") == x).alias(name) for x, name in (("Allow", "allowed"), ("ExplicitDeny", "explicit_denies"), ("ImplicitDeny", "implicit_denies"))]
    return w.agg(F.count("*").alias("requests"), *counts).select(F.col("w.start").alias("start"), "requests", "allowed", "explicit_denies", "implicit_denies", (1 - F.col("allowed") / F.col("requests")).alias("breakage"))


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process all that is there into an in-memory table, then stop: for tests and demonstrations."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)

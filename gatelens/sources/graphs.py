"""Graph files: the structured, node-link, index-encoded and plain JSON forms, and partitioned corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens.operators.graph import dense_ids, with_ends

VERSION = "1.0.0"
NODE = "id string, node_type string, arn string, name string, account_id string, department string, is_high_value boolean, is_admin boolean"
EDGE = "src string, dst string, relation string, is_bridge boolean"


def _all(df: DataFrame, name: str, order: list[str], columns: list | None = None) -> DataFrame:
    """One row with all rows as an array. A document of one graph is one value by its form; larger graphs go to tables."""
    return df.agg(F.array_sort(F.collect_list(F.struct(*(columns or df.columns)))).alias(name))


def structured(nodes: DataFrame, edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One row ``value``: {"schema_version", "graph": {"nodes", "edges"}, "labels"}."""
    row = _all(nodes, "nodes", ["id"]).crossJoin(_all(edges, "edges", ["src"]))
    fields = [F.lit(VERSION).alias("schema_version"), F.struct("nodes", "edges").alias("graph")]
    if labels is not None:
        row = row.crossJoin(_all(labels, "labels", ["source"]))
        fields.append(F.col("labels"))
    return row.select(F.to_json(F.struct(*fields)).alias("value"))


def node_link(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row ``value``: {"directed", "multigraph", "nodes", "links"}."""
    links = edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("relation").alias("key"), "relation", *[c for c in edges.columns if c not in ("src", "dst", "relation")])
    return _all(nodes, "nodes", ["id"]).crossJoin(_all(links, "links", ["source"])).select(F.to_json(F.struct(F.lit(True).alias("directed"), F.lit(True).alias("multigraph"), "nodes", "links")).alias("value"))


def index_encoded(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A row for each typed triple: its index pairs in order and the positions of bridges among them."""
    e = with_ends(edges, dense_ids(nodes), "node_type", "idx")
    g = e.groupBy(F.col("src_node_type").alias("src_type"), "relation", F.col("dst_node_type").alias("dst_type")).agg(F.array_sort(F.collect_list(F.struct(F.col("src_idx").alias("s"), F.col("dst_idx").alias("d"), "is_bridge"))).alias("e"))
    at = F.filter(F.transform("e", lambda x, i: F.when(x["is_bridge"], i)), lambda i: i.isNotNull())
    return g.select("src_type", "relation", "dst_type", F.transform("e", lambda x: x["s"]).alias("src_index"), F.transform("e", lambda x: x["d"]).alias("dst_index"), at.alias("bridges"))


def write_json(document: DataFrame, path: str, compress: bool = False) -> None:
    (document.write.option("compression", "gzip") if compress or path.endswith(".gz") else document.write).text(path)


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a file in the structured, node-link or plain form, told by its keys; others raise."""
    v = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    get = lambda p, t: F.try_variant_get("v", p, t)
    st = lambda s: f"array<struct<{', '.join(x.replace(' ', ': ', 1) for x in s.split(', '))}>>"
    link = st(EDGE.replace("src ", "source ").replace("dst ", "target "))
    n = F.coalesce(get("$.graph.nodes", st(NODE)), get("$.nodes", st(NODE)))
    kind = F.when(get("$.graph.nodes", "variant").isNotNull(), "structured").when(get("$.links", "variant").isNotNull(), "link").when(get("$.edges", "variant").isNotNull(), "plain").otherwise(F.raise_error(F.lit("no known graph form")))
    nodes = v.where(kind.isNotNull()).select(F.explode(n).alias("x")).select("x.*")
    plain = v.where(kind != "link").select(F.explode(F.coalesce(get("$.graph.edges", st(EDGE)), get("$.edges", st(EDGE)))).alias("x")).select("x.*")
    linked = v.where(kind == "link").select(F.explode(get("$.links", link)).alias("x")).select(F.col("x.source").alias("src"), F.col("x.target").alias("dst"), "x.relation", "x.is_bridge")
    return nodes, plain.unionByName(linked)


def write_corpus(nodes: DataFrame, edges: DataFrame, path: str, force: bool = False) -> None:
    """Tables with ``split`` and ``org_id``, a folder for each; what is there stays unless forced."""
    mode = "overwrite" if force else "ignore"
    nodes.write.mode(mode).partitionBy("split", "org_id").parquet(f"{path}/nodes")
    edges.write.mode(mode).partitionBy("split", "org_id").parquet(f"{path}/edges")


def read_corpus(spark: SparkSession, path: str, split: str | None = None, org_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges); the filters prune folders."""
    out = []
    for name in ("nodes", "edges"):
        df = spark.read.parquet(f"{path}/{name}")
        df = df.where(F.col("split") == split) if split else df
        out.append(df.where(F.col("org_id") == org_id) if org_id else df)
    return out[0], out[1]


def markdown(report: DataFrame) -> DataFrame:
    """A markdown table of a small report, a row for each line."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in report.columns]), F.lit(" |"))
    head = report.sparkSession.createDataFrame([("| " + " | ".join(report.columns) + " |",), ("|" + "---|" * len(report.columns),)], "line string")
    return head.unionByName(report.select(cells.alias("line")))

"""Mixing sources to target weights: tokens a source, repetition rates, whole copies and one seeded Bernoulli copy.

Words are counted once a document and summed a source. Targets are filled up by weight: a source's target is its weight
times a level, or its cap if that is less, and the level that spends the whole budget is found by sharing the excess of
capped sources among the others until none is above its cap; a round is one aggregate over the table of sources, of which
the driver sees two sums. A source's rate is its target over its size. Each of its documents is emitted floor(rate)
times, and once more if its draw is below the fraction. Draws are md5 of the document and a seed, so reruns agree, on
whatever machines. Of ``SEEDS`` seeds, a source takes the one whose copies come nearest to its target (ties: the least);
so a few very long documents don't carry a source away from it.

Rates reach documents by the source's md5: all sources are broadcast if they are at most ``BROADCAST_SOURCES``, beyond
that only those that hold a hundredth of all documents or more, of which there are at most a hundred, and the others
are joined by key. Sums are combined before the shuffle, so a source of a third of all documents is no burden to a task.

Rows: a null or empty text has no words; it is emitted by its source's rate and adds nothing. A null source is a source
of its own, the last; the empty string is one too. A source without words has target and rate 0. Rows that repeat a
doc_id have draws of their own if their texts differ, and the same draw if not. A null doc_id counts as an empty id.
An empty table gives no rows. Texts of any length are counted whole. Other columns, whatever their names, are passed on
by ``mix``. Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens.llm.common import keep, table
from gatelens.operators.vocabulary import numbered

WEIGHTS = (5, 2, 1)
#: Words of the mix for each word of the input, and most times that a source is taken.
RATIO, MOST = 1.5, 2.0
#: Seeds tried for each source. One md5 gives four draws of 32 bits.
SEEDS = 32
BROADCAST_SOURCES, HEAVY_SHARE = 20_000, 100


def source_key(source: Column) -> Column:
    return F.coalesce(F.md5(source), F.lit(""))


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def document_key(doc_id: Column, text: Column) -> Column:
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5(text), F.lit(""))))


def draw(key: Column, seed: Column) -> Column:
    """A number from 0 to below 1 of a document and a seed."""
    hashed = F.md5(F.concat(key, F.lit(":"), F.floor(seed / 4).cast("string")))
    return F.conv(F.substr(hashed, (seed % 4 * 8 + 1).cast("int"), F.lit(8)), 16, 10).cast("long") / F.lit(2.0**32)


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, skey, size, dkey) of documents, texts left behind."""
    return docs.select("doc_id", "source", source_key(F.col("source")).alias("skey"), words(F.col("text")).alias("size"), document_key(F.col("doc_id"), F.col("text")).alias("dkey"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, ratio: float = RATIO, most: float = MOST) -> DataFrame:
    """(skey, n, source_size, target) of sized documents."""
    found = sizes.groupBy("skey").agg(F.first("source").alias("source"), F.count("*").alias("n"), F.sum("size").alias("source_size")).withColumn("last", F.col("source").isNull())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("idx") % len(weights) + 1).cast("int"))
    rows = keep(numbered(found, "last", "source").select("skey", "n", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(most)).alias("cap")), "sources")
    budget = ratio * (rows.agg(F.sum("source_size")).collect()[0][0] or 0)
    level, capped = 0.0, -1
    while True:
        full = F.col("cap") <= F.col("weight") * F.lit(level)
        n, spent, rest = rows.agg(F.count_if(full), F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).collect()[0]
        if n == capped or not rest:
            break
        level, capped = (budget - spent) / rest, n
    return rows.select("skey", "n", "source_size", F.when(full, F.col("cap")).otherwise(F.col("weight") * F.lit(level)).alias("target"))


def with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows(skey, ...) with the columns of their source."""
    if sources.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(sources), "skey")
    heavy = sources.crossJoin(F.broadcast(sources.agg(F.sum("n").alias("all_n")))).withColumn("heavy", F.col("n") * HEAVY_SHARE >= F.col("all_n")).drop("all_n")
    few, many = F.broadcast(heavy.where("heavy").drop("heavy")), heavy.where("not heavy").drop("heavy")
    return rows.join(few, "skey").unionByName(rows.join(few.select("skey"), "skey", "left_anti").join(many, "skey"))


def _rate() -> Column:
    return F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)


def rates(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, ratio: float = RATIO, most: float = MOST, seeds: int = SEEDS) -> DataFrame:
    """(skey, n, source_size, target, rate, seed): the seed is the one whose copies come nearest to the target."""
    known = keep(targets(sizes, weights, ratio, most).withColumn("rate", _rate()), "rates")
    tried = with_source(sizes.select("skey", "size", "dkey"), known.select("skey", "n", "rate")).where("size > 0").select("skey", "size", "dkey", "rate", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed"))
    extra = F.sum(F.when(draw(F.col("dkey"), F.col("seed")) < F.col("rate") - F.floor("rate"), F.col("size")).otherwise(0))
    sums = tried.groupBy("skey", "seed").agg(extra.alias("extra")).join(known, "skey")
    off = F.abs(F.floor("rate") * F.col("source_size") + F.col("extra") - F.col("target"))
    best = sums.groupBy("skey").agg(F.min(F.struct(off.alias("off"), "seed")).alias("best"))
    return keep(known.join(best, "skey", "left").select(*known.columns, F.coalesce("best.seed", F.lit(0)).alias("seed")), "rates")


def copies() -> Column:
    """How often a row with its source's rate and seed is emitted."""
    return F.floor("rate") + F.when(draw(F.col("dkey"), F.col("seed")) < F.col("rate") - F.floor("rate"), 1).otherwise(0)


def repetitions(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, size, source_size, target, copies) of every document, of those that are left out too."""
    sizes = keep(sized(docs), "sizes")
    return with_source(sizes, rates(sizes, **how)).select("doc_id", "size", "source_size", "target", copies().alias("copies"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: the documents as often as they are emitted, with the columns they came with."""
    known = rates(keep(sized(docs), "sizes"), **how)
    rows = docs.select(F.struct("*").alias("row"), source_key(F.col("source")).alias("skey"), document_key(F.col("doc_id"), F.col("text")).alias("dkey"))
    emitted = with_source(rows, known).withColumn("times", copies()).where("times > 0")
    return emitted.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetitions(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), F.col("copies").cast("long").alias("copies"))


OP11_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')) AS dkey
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0::DOUBLE * sum(size) AS cap,
         CAST([5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, encode(source))) - 1) % 3 + 1] AS DOUBLE) AS weight
  FROM docs GROUP BY source
), total AS (SELECT 1.5::DOUBLE * sum(size) AS budget FROM docs), levels AS (
  SELECT 0.0::DOUBLE AS level, -1::BIGINT AS was, (SELECT count(*) FROM sources WHERE cap <= 0) AS capped
  UNION ALL
  SELECT new_level, capped, (SELECT count(*) FROM sources WHERE cap <= weight * new_level) FROM (
    SELECT capped, ((SELECT budget FROM total) - (SELECT coalesce(sum(cap), 0) FROM sources WHERE cap <= weight * level)) / (SELECT sum(weight) FROM sources WHERE cap > weight * level) AS new_level
    FROM levels WHERE was <> capped
  ) WHERE new_level IS NOT NULL
), final AS (SELECT max(level) AS level FROM levels), rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM (SELECT source, source_size, CASE WHEN cap <= weight * level THEN cap ELSE weight * level END AS target FROM sources, final)
), drawn AS (
  SELECT d.source, s.j, sum(CASE WHEN CAST('0x' || substr(md5(d.dkey || ':' || CAST(s.j // 4 AS VARCHAR)), CAST(s.j % 4 * 8 + 1 AS INT), 8) AS BIGINT) / 4294967296.0::DOUBLE < rate - floor(rate) THEN size ELSE 0 END) AS extra
  FROM docs d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source, (SELECT unnest(range(32)) AS j) s GROUP BY d.source, s.j
), seeds AS (
  SELECT r.source, arg_min(d.j, abs(floor(rate) * source_size + extra - target) * 1.0::DOUBLE ORDER BY d.j) AS seed
  FROM rated r JOIN drawn d ON d.source IS NOT DISTINCT FROM r.source GROUP BY r.source
), copied AS (
  SELECT d.doc_id, d.size, r.source_size, r.target,
         CAST(floor(rate) + CASE WHEN CAST('0x' || substr(md5(d.dkey || ':' || CAST(s.seed // 4 AS VARCHAR)), CAST(s.seed % 4 * 8 + 1 AS INT), 8) AS BIGINT) / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies
  FROM docs d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source JOIN seeds s ON d.source IS NOT DISTINCT FROM s.source
)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM copied
"""

"""Line deduplication over range-partitioned line hashes, giving a compressed keep bitmap for each document.

Every line that is long enough is sent as (hash, document, position), never as text. The rows are dealt out by ranges
of (hash, document), so that a key which a third of the documents hold is spread over many tasks, and sorted by hash,
document and position; a pass over this order marks the first occurrence in each document. The first occurrences give
each key's number of documents and its keeper. Keys in enough documents then meet their occurrences again: the few that
hold most rows (at most ``HOT_KEYS``) are broadcast, so that no task gets all rows of one, and the rest are joined. What
comes back for a document is its lost positions, from which its bitmap is made: run lengths of kept and dropped lines.
Texts meet bitmaps once, by document, and are cut without hashing. Each step is linear in a document's lines, and
everything is DataFrame operations.

Rows: a null or empty text is one empty line, which is kept. A key's count is of distinct doc_ids; rows that repeat a
doc_id are one document for counts, and each loses the same keys. A null doc_id sorts below all others. Lines that a
document repeats are one occurrence; in the keeping document they all stay. Texts of any length are split whole. An
empty table gives no rows. Other columns, whatever their names, are passed on by ``dedup_lines``. Hashes have 128 bits;
a document is known by its id and a 64-bit hash of its text, which parts rows that repeat an id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatelens.llm.common import keep, table

LEAST_CHARS = 40
LEAST_DOCS = 5
UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_ID = -(1 << 63)
#: Most keys that are broadcast. Each of them has at least one part in so many of all repeated lines, so there can't be more.
HOT_KEYS = 1000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), UPPER, LOW)


def key_hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.reverse(key)).alias("h2"))


def let(value: Column, body) -> Column:
    """body of a value that is computed once; a lambda would compute it again at each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def row_key() -> list[Column]:
    return [F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("did"), F.xxhash64("text").alias("th")]


def occurrences(docs: DataFrame, least_chars: int) -> DataFrame:
    """(did, th, pos, h1, h2) of every line whose key is long enough to count."""
    keys = F.transform(lines_of(F.col("text")), line_key)
    hashed = F.transform(keys, lambda k, i: F.when(F.length(k) >= least_chars, F.struct(i.alias("pos"), key_hash(k).alias("h"))))
    return docs.select(*row_key(), F.explode(F.array_compact(hashed)).alias("x")).select("did", "th", "x.pos", "x.h.h1", "x.h.h2")


def first_occurrences(held: DataFrame) -> DataFrame:
    """One row for each key and document: the first in the order of hash, document and position.

    The window's key is what the rows are range-partitioned by, so it needs a sort within the ranges and no more shuffle.
    """
    ranged = held.select("h1", "h2", "did", "pos").repartitionByRange("h1", "h2", "did")
    place = F.row_number().over(Window.partitionBy("h1", "h2", "did").orderBy("pos"))
    return ranged.withColumn("place", place).where("place = 1").select("h1", "h2", "did")


def lost_positions(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(did, th, lost): for each document that loses lines, their positions in order."""
    held = keep(occurrences(docs, least_chars), "lines")
    counted = first_occurrences(held).groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("did").alias("keeper"))
    common = keep(counted.where(F.col("n") >= least_docs), "common-lines")
    hot = F.col("n") * HOT_KEYS > (common.agg(F.sum("n")).collect()[0][0] or 0)
    keys, gone = ["h1", "h2"], lambda x: x.where("did <> keeper").select("did", "th", "pos")
    few = F.broadcast(common.where(hot).select(*keys, "keeper"))
    lost = gone(held.join(few, keys)).unionByName(gone(held.join(few, keys, "left_anti").join(common.where(~hot).select(*keys, "keeper"), keys)))
    return lost.groupBy("did", "th").agg(F.array_sort(F.collect_set("pos")).alias("lost"))


def _gaps(lost: Column, n: Column) -> Column:
    """array<struct<a, b>>: what is kept before, between and after the lost positions, [a, b), empty ones too."""
    return F.zip_with(F.concat(F.array(F.lit(0)), F.transform(lost, lambda p: p + 1)), F.concat(lost, F.array(n)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def run_lengths(lost: Column, n: Column) -> Column:
    """The bitmap: run lengths as text, beginning with the kept ones; 3,1,2 keeps three, drops one, keeps two."""
    bits = F.array_join(F.transform(_gaps(lost, n), lambda g: F.repeat(F.lit("1"), g["b"] - g["a"])), "0")
    runs = lambda b: F.concat(
        F.when(F.startswith(b, F.lit("0")), F.lit("0,")).otherwise(F.lit("")),
        F.array_join(F.transform(F.regexp_extract_all(b, F.lit("0+|1+"), F.lit(0)), lambda r: F.length(r).cast("string")), ","),
    )
    return F.when(lost.isNull(), n.cast("string")).otherwise(let(bits, runs))


def kept_text(text: Column, lost: Column) -> Column:
    """text without the lost lines, put together from the runs that stay."""
    runs = lambda lines: F.transform(F.filter(_gaps(lost, F.size(lines)), lambda g: g["b"] > g["a"]), lambda g: F.array_join(F.slice(lines, g["a"] + 1, g["b"] - g["a"]), "\n"))
    return F.when(lost.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(let(lines_of(text), runs), "\n"))


def _marked(docs: DataFrame, least_chars: int, least_docs: int) -> DataFrame:
    """(row, lost): every row of docs as a struct, so that its columns' names can't clash, and its lost positions or null."""
    lost = lost_positions(docs, least_chars, least_docs)
    return docs.select(F.struct("*").alias("row"), *row_key()).join(lost, ["did", "th"], "left").select("row", "lost")


def _n_lines() -> Column:
    return F.size(lines_of(F.col("row.text")))


def keep_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, keep, kept): keep is the bitmap, kept the text that it leaves, made where it is asked for."""
    return _marked(docs.select("doc_id", "text"), least_chars, least_docs).select(
        "row.doc_id",
        _n_lines().cast("long").alias("n_lines"),
        F.when(F.col("lost").isNull(), 0).otherwise(F.size("lost")).cast("long").alias("n_dropped"),
        run_lengths(F.col("lost"), _n_lines()).alias("keep"),
        kept_text(F.col("row.text"), F.col("lost")).alias("kept"),
    )


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """docs without the lost lines; n_chars follows where there is such a column. A null text stays null."""
    text = F.when(F.col("lost").isNull(), F.col("row.text")).otherwise(kept_text(F.col("row.text"), F.col("lost")))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("lost").isNull(), F.col("row.n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return _marked(docs, least_chars, least_docs).select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = keep_bitmaps(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"), "keep")


OP3_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT r, doc_id, u.i AS i, u.line AS line, translate(trim(u.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: struct_pack(i := i, line := x))) AS u FROM docs)
), common AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.r, l.doc_id, l.i, l.line, c.k IS NOT NULL AND l.doc_id <> c.keeper AS gone FROM lines l LEFT JOIN common c ON l.k = c.k
), done AS (
  SELECT r, any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
         sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256,
         list(gone ORDER BY i) AS g
  FROM marked GROUP BY r
)
SELECT doc_id, n_lines, n_dropped, kept_sha256,
  CASE WHEN g[1] THEN '0,' ELSE '' END || array_to_string(list_transform(
    regexp_extract_all(array_to_string(list_transform(g, lambda x: CASE WHEN x THEN '0' ELSE '1' END), ''), '0+|1+'), lambda x: CAST(length(x) AS VARCHAR)), ',') AS keep
FROM done
"""

"""Language identification by bit-sliced Bloom filters of character n-grams.

Every slot of the filter holds a mask with one bit for each language, in as many 64-bit words as they need. The masks in an n-gram's slots, ANDed, are
the languages whose profile (probably) holds the n-gram. A text's hits per language are popcounts over its
n-grams, corrected for the language's false-positive rate; the language with most corrected hits is predicted.

Rows: null, empty and letterless texts give ``und`` with score 0. Rows that repeat a doc_id are judged one by one;
a tie goes to the language that sorts first. With nothing to learn from every text is ``und``. Other columns are
ignored by the query and passed on by ``keep_languages``. Texts of any length are judged whole. An empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.llm.common import mix, slices, tidy

#: Rows that the profiles are learned from, for each language: the stated bound on the labelled sample.
ROWS_PER_LANGUAGE = 2000
#: An n-gram enters a language's profile if it is in at least this share of the language's sampled texts.
LEAST_SHARE = 0.02
SIZES = (3, 4)
#: Least slots, and slots for each entry of the largest profile, so that a language's bits fill a third of them at most.
SLOTS, SLOTS_EACH = 1 << 19, 8
PROBES = 3


@dataclass(frozen=True)
class Filters:
    """languages in sorted order; masks: uint64 words of each slot, bit i % 64 of word i // 64 for languages[i]; rates: false positives."""

    languages: tuple[str, ...]
    masks: np.ndarray
    rates: np.ndarray


#: Letters of the planes that have any.
LETTER = np.fromiter((chr(i).isalpha() for i in range(0x32000)), bool, 0x32000)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of all n-grams of lower-cased letter runs with their borders, and whether a row has a letter."""
    lowered = [t.lower() for t in texts]
    joined = "\0" + "\0".join(lowered) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    rows = np.repeat(np.arange(-1, len(texts)), [1, *(len(t) + 1 for t in lowered)])
    some = LETTER[np.minimum(points, len(LETTER) - 1)]
    wide = np.where(some, points, 0).astype(np.uint64)
    row_out, hash_out = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for n in SIZES:
        count = len(points) - n + 1
        if count <= 0:
            continue
        h = np.full(count, n, np.uint64)
        inner = np.ones(count, bool)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + wide[k : k + count]
            if 0 < k < n - 1:
                inner &= some[k : k + count]
        at = np.flatnonzero(inner)
        row_out.append(rows[at + 1])
        hash_out.append(mix(h[at]))
    has = np.zeros(len(texts), bool)
    has[rows[some]] = True
    return np.concatenate(row_out), np.concatenate(hash_out), has


def clean(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def positions(h: np.ndarray, slots: int) -> list[np.ndarray]:
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return [((a + np.uint64(k) * b) & np.uint64(slots - 1)).astype(np.int64) for k in range(PROBES)]


def _bit(masks: np.ndarray, i: int) -> np.ndarray:
    return (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)


def learn(rows: DataFrame, seed: str = "langid") -> Filters:
    """Filters from (doc_id, text, lang) rows with a language, over a sample bounded by ROWS_PER_LANGUAGE.

    The sample takes the rows whose seeded hash is below the share that the bound is of the language's rows.
    """
    rows = rows.where(F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = tuple(sorted(counts))
    if not languages:
        return Filters((), np.zeros((SLOTS, 1), np.uint64), np.zeros(0))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, ROWS_PER_LANGUAGE / n))])[F.col("lang")]
    unit = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(unit < share).select("text", "lang")

    number = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lang = batch.column("lang").to_pylist()
            row, h, _ = grams(clean(batch.column("text")))
            code = np.array([number[x] for x in lang])
            # keys of one number: (text, n-gram) once each, then texts for each (language, n-gram)
            _, once = np.unique(mix(h ^ mix(row.astype(np.uint64) + np.uint64(1))), return_index=True)
            h, lang = h[once], code[row[once]]
            _, at, n = np.unique(mix(h ^ mix(lang.astype(np.uint64) + np.uint64(1))), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(lang[at].astype(np.int32)), pa.array(h[at].view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "h", "n"])

    taken = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    least = F.element_at(F.array(*[F.lit(max(2, int(LEAST_SHARE * taken.get(lang, 0)))) for lang in languages]), F.col("lang") + 1)
    found = sample.mapInArrow(tidy(count), "lang int, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    # every sampled text brings its distinct n-grams, a profile entry takes LEAST_SHARE of them: at most 1 / LEAST_SHARE texts' worth
    profile = found.select("lang", "h").toArrow()
    lang, h = profile.column("lang").to_numpy(), profile.column("h").to_numpy().view(np.uint64)
    slots = max(SLOTS, 1 << (SLOTS_EACH * int(np.bincount(lang, minlength=1).max())).bit_length())
    masks = np.zeros((slots, -(-len(languages) // 64)), np.uint64)
    for p in positions(h, slots):
        np.bitwise_or.at(masks, (p, lang // 64), np.uint64(1) << (lang % 64).astype(np.uint64))
    fill = np.array([np.mean(_bit(masks, i)) for i in range(len(languages))])
    return Filters(languages, masks, fill**PROBES)


def judge(filters: Filters, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language or und, score, share of the n-grams that the language's profile holds) of each text.

    The score is the best language's share of all corrected hits beyond the second best's, half at a draw.
    """
    n, langs = len(texts), len(filters.languages)
    row, h, has = grams(texts)
    total = np.bincount(row, minlength=n).astype(float)
    if not langs:
        return ["und"] * n, np.zeros(n), np.zeros(n)
    mask = np.full((len(h), filters.masks.shape[1]), ~np.uint64(0))
    for p in positions(h, len(filters.masks)):
        mask &= filters.masks[p]
    hits = np.stack([np.bincount(row, weights=_bit(mask, i), minlength=n) for i in range(langs)], axis=1)
    true = np.clip((hits - total[:, None] * filters.rates) / (1 - filters.rates), 0, None)
    best = np.argmax(true, axis=1)
    top = true[np.arange(n), best]
    rest = true.copy()
    rest[np.arange(n), best] = 0
    second = rest.max(axis=1) if langs > 1 else np.zeros(n)
    with np.errstate(all="ignore"):
        score = np.where(top + second > 0, top / (top + second), 0.0)
        cover = np.where(total > 0, top / np.maximum(total, 1), 0.0)
    score = np.where(has, np.clip(score, 0, 1), 0.0)
    return [filters.languages[b] if ok else "und" for b, ok in zip(best, has, strict=True)], score, cover


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """(doc_id, lang_pred, score, coverage) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lang, score, cover = judge(filters, clean(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(cover)], names=["doc_id", "lang_pred", "score", "coverage"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, lang_pred string, score double, coverage double")


def keep_languages(docs: DataFrame, filters: Filters, least_coverage: float = 0.2) -> DataFrame:
    """docs without the rows of no language: ``und``, or less than ``least_coverage`` of the n-grams in the best profile."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lang, _, cover = judge(filters, clean(batch.column("text")))
            stay = np.array([x != "und" for x in lang]) & (cover >= least_coverage)
            yield batch.filter(pa.array(stay))

    return docs.mapInArrow(tidy(run), docs.schema)


def held_out(doc_id: str, parts: int, part: int) -> F.Column:
    """Whether the checksum of the id as text leaves this remainder; a null id's text is empty."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == part


def op2_languages(spark, sf_dir: str) -> DataFrame:
    from gatelens.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    filters = learn(docs.where(~held_out("doc_id", 5, 0)))
    return predict(docs, filters).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score", F.round("coverage", 6).alias("coverage"))

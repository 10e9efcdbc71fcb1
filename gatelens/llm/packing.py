"""Lexical retrieval packing: windows filled with BM25 neighbours of a seed document.

Texts are tokenized once and their ids kept as a table. Document counts of all terms and the mean length are taken over
all documents; they are as many as the vocabulary has ids. A document's most telling terms, those with its largest
BM25 weights among terms that another document has too, are its content key, and documents are dealt out by ranges of
these keys and sorted by them. So documents that share their most telling terms stand together, wherever they were
read, and the shards of bounded size that a task cuts its range into hold like documents.

Each shard has an inverted index with BM25 weights by the corpus' statistics. A seed document opens a window, its best
unused neighbours follow over all terms of the seed, and where a document does not fit the rest of it opens the next
window. Documents without a common term are no neighbours: when none is left the next unused document is a seed in the
same window. So every window but a shard's last is full. The last one is cut into sequences whose lengths are powers of
two, which need no padding, until less than ``LEAST_TAIL`` ids are left.

Ids come from whole texts of any length; a null text is empty and gives only the end id. Rows that repeat a doc_id are
packed one by one, each starting at 0; ties in scores go by place. An empty table gives no rows. Other columns are not
read. A sequence's id is made of the task's partition and a counter, the same whenever the task is run again.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens.llm.common import keep, slices, table, tidy

WINDOW = 4096
END_ID = 2
SHARD_DOCS = 2048
SHARD_IDS = 4_000_000
LEAST_TAIL = 64
#: Chunks kept with their ids, about 200 bytes each.
CACHE_WORDS = 700_000
#: Terms in a content key. BM25's parameters.
KEY_TERMS = 3
K1, B = 1.2, 0.75
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids of texts. White space parts what the tokenizer sees, so chunks between it are encoded once and kept.

    A-Z is lower-cased beforehand, as the tokenizer does, save where that could change what it sees: before combining
    marks (lead bytes CC and CD), which compose with some capitals only, and in the names of special tokens. Chunks of
    lower-case Latin letters alone are one piece each for the tokenizer whatever its rules for others; they skip those.
    """

    LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")

    def __init__(self, path: str):
        # a task has one core; the library's own threads would only spin
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.pieces = Tokenizer.from_file(path), Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.pieces.normalizer = None
        self.pieces.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.known: dict[bytes, bytes] = {}

    def learn(self, new: set[bytes]) -> dict[bytes, bytes]:
        known, other, ended, plain = {}, [], [], set()
        letters = self.LETTERS.fullmatch
        for w in new:
            if letters(w):
                plain.add(w)
            elif w[-1] in b".," and letters(w[:-1]):
                # a mark after a letter is a piece of its own
                ended.append(w)
                if w[:-1] in self.known:
                    known[w[:-1]] = self.known[w[:-1]]
                else:
                    plain.add(w[:-1])
            else:
                other.append(w)
        plain = list(plain)
        for i in range(0, len(plain), 512):
            some = plain[i : i + 512]
            ids = np.array(self.pieces.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, np.uint32)
            cuts = ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()
            raw = ids.tobytes()
            known.update(zip(some, [raw[a:z] for a, z in zip([0, *cuts], cuts)], strict=True))
        for w, e in zip(other, self.tokenizer.encode_batch_fast([w.decode() for w in other], add_special_tokens=False), strict=True):
            known[w] = np.array(e.ids, np.uint32).tobytes()
        marks = {m: np.array(self.tokenizer.encode(m, add_special_tokens=False).ids, np.uint32).tobytes() for m in ".,"}
        for w in ended:
            known[w] = known[w[:-1]] + marks[chr(w[-1])]
        return known

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        chunks, ends = [], [0]
        for raw in texts:
            chunks += (raw if b"\xcc" in raw or b"\xcd" in raw or b"<|" in raw else raw.lower()).split()
            ends.append(len(chunks))
        got = list(map(self.known.get, chunks))
        if lacking := [i for i, x in enumerate(got) if x is None]:
            new = self.learn({chunks[i] for i in lacking})
            for i in lacking:
                got[i] = new[chunks[i]]
            if len(self.known) > CACHE_WORDS and len(lacking) > len(chunks) // 4:
                self.known.clear()  # the texts have changed
            if len(self.known) <= CACHE_WORDS:
                self.known |= new
        end = np.array([END_ID], np.uint32).tobytes()
        return [np.frombuffer(b"".join(got[a:z]) + end, np.uint32) for a, z in zip(ends, ends[1:])]


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each worker process, so that what it has learned serves later tasks too."""
    return Encoder(path)


class Statistics:
    """Of all documents: their number, mean length, and the number that holds each term."""

    def __init__(self, docs: int, mean: float, df: np.ndarray):
        self.mean, self.df = max(mean, 1.0), df
        self.idf = np.log1p((docs - df + 0.5) / (df + 0.5)).astype(np.float32)

    @staticmethod
    def of(docs: list[np.ndarray]) -> Statistics:
        terms = np.concatenate([np.unique(d[:-1]) for d in docs])
        return Statistics(len(docs), float(np.mean([len(d) for d in docs])), np.bincount(terms.astype(np.int64), minlength=1))

    def weights(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, term, weight) of every term of every document, in this order; the end id is no term."""
        size = np.array([len(d) for d in docs])
        every = np.concatenate([d[:-1] for d in docs])
        bits = int(every.max(initial=1)).bit_length()
        kind = np.uint32 if bits + len(docs).bit_length() <= 32 else np.uint64
        pairs = np.repeat(np.arange(len(docs), dtype=kind) << kind(bits), size - 1) | every.astype(kind, copy=False)
        pairs.sort()
        at = np.concatenate(([0], np.flatnonzero(pairs[1:] != pairs[:-1]) + 1)) if len(pairs) else np.zeros(0, np.int64)
        tf, pairs = np.diff(at, append=len(every)).astype(np.float32), pairs[at]
        doc, term = (pairs >> kind(bits)).astype(np.int32), (pairs & kind((1 << bits) - 1)).astype(np.uint16 if bits <= 16 else np.int64)
        norm = (K1 * (1 - B + B * size / self.mean)).astype(np.float32)
        return doc, term, tf * np.float32(K1 + 1) / (tf + norm[doc]) * self.idf[term]

    def keys(self, docs: list[np.ndarray]) -> np.ndarray:
        """A row of KEY_TERMS terms for each document, the heaviest first; -1 where it has no more that others share."""
        doc, term, weight = self.weights(docs)
        weight = np.where(self.df[term] > 1, weight, np.float32(0))
        first, out = np.searchsorted(doc, np.arange(len(docs))), np.full((len(docs), KEY_TERMS), -1, np.int32)
        some = np.flatnonzero(np.diff(first, append=len(doc)))
        for k in range(KEY_TERMS if len(some) else 0):
            top = np.zeros(len(docs), np.float32)
            top[some] = np.maximum.reduceat(weight, first[some])
            at = np.flatnonzero((weight == top[doc]) & (weight > 0))
            which, one = np.unique(doc[at], return_index=True)
            out[which, k] = term[at[one]]
            weight[at[one]] = 0
        return out


class Index:
    """Inverted BM25 index of a shard; used documents are passed over."""

    def __init__(self, docs: list[np.ndarray], statistics: Statistics | None = None):
        doc, term, weight = (statistics or Statistics.of(docs)).weights(docs)
        self.terms = np.split(term, np.searchsorted(doc, np.arange(1, len(docs))))
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.df = np.bincount(term, minlength=1)
        self.first = np.concatenate(([0], np.cumsum(self.df)))
        self.free = np.ones(len(docs), bool)
        # terms of many documents are rows of a matrix, which add up faster than lists
        many = np.flatnonzero(self.df * 24 > len(docs))
        self.row = np.full(len(self.df), -1)
        self.row[many] = np.arange(len(many))
        self.rows = np.zeros((len(many), len(docs)), np.float32)
        for k, t in enumerate(many.tolist()):
            own = slice(self.first[t], self.first[t + 1])
            self.rows[k, self.doc[own]] = self.weight[own]

    def take(self, i: int) -> int:
        self.free[i] = False
        return i

    def neighbours(self, seed: int) -> Iterator[int]:
        """Unused documents with a common term by falling score over all terms of the seed, then by place."""
        t = self.terms[seed]
        t = t[self.df[t] > 1]  # the others are in the seed alone
        row = self.row[t]
        t, row = t[row < 0], row[row >= 0]
        first, n = self.first[t], self.df[t]
        at = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        score = np.bincount(self.doc[at], self.weight[at], len(self.free)) + self.rows[row].sum(axis=0)
        score[~self.free] = 0
        while score.max(initial=0) > 0:
            best = int(np.argmax(score))
            score[best] = 0
            yield best


def pack_shard(ids: list[np.ndarray], window: int = WINDOW, statistics: Statistics | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length)."""
    index, out, now, room = Index(ids, statistics), [], [], window
    place = 0

    def fill(i: int, at: int) -> int:
        """Put what fits of document i, from ``at``; returns where it stopped."""
        nonlocal room
        n = min(room, len(ids[i]) - at)
        now.append((i, at, n))
        room -= n
        return at + n

    open_doc: tuple[int, int] | None = None
    while True:
        if open_doc is None:
            while place < len(ids) and not index.free[place]:
                place += 1
            if place == len(ids):
                break
            open_doc = (index.take(place), 0)
        seed = open_doc[0]
        at = fill(*open_doc)
        open_doc = (seed, at) if at < len(ids[seed]) else None
        if room:
            for other in index.neighbours(seed):
                at = fill(index.take(other), 0)
                if at < len(ids[other]):
                    open_doc = (other, at)
                if not room:
                    break
        if not room:
            out.append(now)
            now, room = [], window
    # what is left is less than a window
    while now:
        left = sum(n for _, _, n in now)
        size = left if left < LEAST_TAIL else 1 << (left.bit_length() - 1)
        part, rest = [], []
        for i, at, n in now:
            n_here = min(n, size)
            size -= n_here
            if n_here:
                part.append((i, at, n_here))
            if n > n_here:
                rest.append((i, at + n_here, n - n_here))
        out.append(part)
        now = rest
    return out


def tokenized(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, n, ids) of every row, and for each task a row whose doc_id is null, n -1 and ids its counts of documents by term.

    Ids are bytes, two of an id where all fit. The tokenizer's file must be on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer_path
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        encode = encoder(path)
        kind, df = np.uint16 if len(encode.last) <= 1 << 16 else np.uint32, np.zeros(len(encode.last), np.int64)
        rows = lambda names, ids, n: pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n", "ids"])
        for batch in slices(batches):
            ids = encode([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()])
            for a in range(0, len(ids), 64):
                held = np.zeros((min(64, len(ids) - a), len(df)), bool)
                for seen, one in zip(held, ids[a:], strict=False):
                    seen[one[:-1]] = True
                df += held.sum(axis=0)
            yield rows(batch.column("doc_id"), [one.astype(kind).tobytes() for one in ids], [len(one) for one in ids])
        yield rows([None], [df.tobytes()], [-1])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n long, ids binary")


def _ids(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32) for raw, n in zip(batch.column("ids").to_pylist(), batch.column("n").to_pylist(), strict=True)]


def statistics(tokens: DataFrame) -> Statistics:
    """Over all rows of tokenized(); what comes to the driver is bounded by the vocabulary."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("ids").to_pylist():
                df = np.frombuffer(raw, np.int64)
                some = np.flatnonzero(df)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["term", "df"])

    counted = tokens.where("n < 0").select("ids").mapInArrow(unpack, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    term, some = counted.column("term").to_numpy(), counted.column("df").to_numpy()
    df = np.zeros(int(term.max(initial=0)) + 1, np.int64)
    df[term] = some
    total = tokens.where("n >= 0").agg(F.count("*").alias("docs"), F.avg("n").alias("mean")).collect()[0]
    return Statistics(total["docs"], total["mean"] or 1.0, df)


def by_content(tokens: DataFrame, stats: Statistics) -> DataFrame:
    """The rows of tokens dealt out by ranges of their content keys and sorted by them."""
    names = [f"k{i}" for i in range(KEY_TERMS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids"):
            keys = stats.keys(_ids(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(keys[:, i]) for i in range(KEY_TERMS))], names=[*batch.schema.names, *names])

    keyed = tokens.mapInArrow(tidy(run), "doc_id long, n long, ids binary, " + ", ".join(f"{k} int" for k in names))
    # the hash parts copies, of which a range may hold very many
    order = [*names, F.xxhash64("ids", "doc_id")]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "n", "ids")


def pack(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW) -> DataFrame:
    """A row for each piece of a document; see SCHEMA."""
    tokens = keep(tokenized(docs, tokenizer_path), "ids")
    stats = statistics(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 36
        names, ids, size = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            rows = []
            for pieces in pack_shard(ids, window, stats):
                offset = 0
                for i, at, n in pieces:
                    rows.append((names[i], at, n, zlib.crc32(ids[i][at : at + n].astype("<u4").tobytes()), len(ids[i]), sequence, offset))
                    offset += n
                sequence += 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in slices(batches, "ids"):
            for name, one in zip(batch.column("doc_id").to_pylist(), _ids(batch), strict=True):
                names.append(name)
                ids.append(one)
                size += len(one)
                if len(ids) >= SHARD_DOCS or size >= SHARD_IDS:
                    yield flush()
                    names, ids, size = [], [], 0
        if ids:
            yield flush()

    return by_content(tokens.where("n >= 0"), stats).mapInArrow(tidy(run), SCHEMA)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))

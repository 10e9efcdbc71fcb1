"""URL filter, Jaccard join, vector dedup, packing, WARC and the pipeline: against brute force on small tables."""

import base64
import hashlib
import io
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gatelens.llm import jaccard, packing, queries, rptree, urlfilter, warc
from gatelens.llm.common import components

rng = random.Random(9)
WORDS = [a + b for a in "ba co du fe gi ho".split() for b in "la me ni po ru sy".split()]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


ODD = [(None, "no id at all of words"), (1, None), (2, ""), (3, " \n\t"), (4, "x" * 200_000), (5, "same words here"), (5, "same words here"), (6, "\0\x1c\x85 é́ 漢字 😀")]


class Sets:
    """Union-find."""

    def __init__(self):
        self.p = {}

    def root(self, x):
        self.p.setdefault(x, x)
        while self.p[x] != x:
            x = self.p[x]
        return x

    def join(self, a, b):
        self.p[self.root(a)] = self.root(b)


# --- 4 ---


def test_urls_match_sql(saved, spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "SAMPLED_EACH", 3)
    hosts = ["a.example.net", "example.net", "net", "xnet", "example.network", "b.a.example.net.", "Example.COM", "w.example.com", "org", "x.org:80", "", "example-net.net", ".net", "é.net"]
    paths = ["", "/", "/en/", "/en", "/en/x", "/de/1", "/fr/", "/EN/", "//en/"]
    rows = [(i, f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?a=/b', '#x', '?q#z'])}", "h") for i in range(400)]
    rows += [(500, None, None), (501, "no scheme", ""), (502, "", ""), (503, "x://", ""), (504, "a://b.net/://c", ""), (505, "http://net/" + "y" * 5000, ""), (505, "http://net/", ""), (None, "http://org/fr/", "")]
    d = saved(pages=spark.createDataFrame(rows, "page_id long, url string, host string"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet/*.parquet'")
    key = lambda r: (r[0] is None, r[0] or 0, str(r))
    want = sorted(con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({queries.oracle_sql()['op4_url_filter']})").fetchall(), key=key)
    got = sorted((tuple(r) for r in queries.queries()["op4_url_filter"](spark, d).collect()), key=key)
    assert got == want and len({r[3] for r in got}) == 5


def test_url_rules_nest(spark):
    rules = spark.createDataFrame([("a.b.c", "/", "allow"), ("b.c", "/x/y/", "block"), ("c", "/", "block"), ("b.c", "/x/", "allow"), ("c", "/", "allow"), (None, "/", "block")], "host string, path string, action string")
    pages = spark.createDataFrame([(1, "q://a.b.c/x/y/z"), (2, "q://z.b.c/x/y/z"), (3, "q://b.c/x/1"), (4, "q://c/x"), (5, "q://d/x")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.filter_urls(pages, rules).collect()}
    # equally long: b.c/x/y/ has 8 characters, a.b.c/ has 6
    assert got == {1: ("b.c/x/y/", "block"), 2: ("b.c/x/y/", "block"), 3: ("b.c/x/", "allow"), 4: ("c/", "block"), 5: (None, "allow")}
    assert urlfilter.filter_urls(pages.limit(0), rules).collect() == [] and urlfilter.filter_urls(pages, rules.limit(0)).count() == 5


# --- 6 ---


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    s = Sets()
    sets = [shingles(t) for _, t in rows]
    for a in range(len(rows)):
        s.root(a)
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                s.join(a, b)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = s.root(k)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(least[r], i)
    return sorted(((i, len(sets[k]), least[s.root(k)] if sets[k] else i) for k, (i, _) in enumerate(rows)), key=str)


def families(n, copies):
    rows = []
    for f in range(n):
        base = prose(rng.randint(3, 90)).split()
        for c in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 20))):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append((1000 + f * copies + c, " ".join(w[: rng.randint(max(1, len(w) - 6), len(w))])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [192, 6])
def test_jaccard_components(documents, saved, spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = [*ODD, *families(10, 12), *families(1, 60), (7, "one two three"), (8, "ONE two\nthree"), (9, "one two three four five"), (None, "one two three")]
    d = saved(documents=documents(rows))
    got = sorted((tuple(r) for r in queries.queries()["op6_jaccard_join"](spark, d).collect()), key=str)
    assert got == brute_components(rows)


def test_jaccard_keep_one_and_empty(documents):
    text = prose(60)
    rows = [(3, text), (1, text), (2, text + " more"), (9, prose(50)), (10, None), (11, None)]
    out = jaccard.keep_one(documents(rows))
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 9, 10, 11] and "host" in out.columns
    assert jaccard.near_duplicates(documents([])).collect() == []
    # by row: another text under the same id stays; without an id one of two stays
    other = prose(70)
    rows = [(0, text), (1, text), (1, other), (None, other + " x"), (None, prose(30)), (None, text + " y")]
    docs = documents(rows).selectExpr("*", "1 AS th", "2 AS away_id", "3 AS cid", "4 AS row", "5 AS lead")
    out = jaccard.keep_one(docs).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in out), key=str) == sorted([(0, text), (1, other), (None, rows[4][1])], key=str)
    assert {(r["th"], r["away_id"], r["row"]) for r in out} == {(1, 2, 4)}


def test_trie_join_is_exact():
    for seed in range(20):
        r = np.random.default_rng(seed)
        base = r.integers(0, 400, 40).astype(np.uint64)
        sets = [np.unique(np.concatenate([base[r.random(40) < 0.93], r.integers(1000, 2000, r.integers(0, 6)).astype(np.uint64)])) for _ in range(25)]
        s, t = Sets(), Sets()
        for i in range(25):
            for j in range(i):
                n = len(np.intersect1d(sets[i], sets[j]))
                if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                    s.join(i, j)
        for i, j in jaccard.trie_join(sets, np.ones(25, bool), np.arange(25), 80):
            t.join(i, j)
        assert len({(s.root(i), t.root(i)) for i in range(25)}) == len({s.root(i) for i in range(25)}) == len({t.root(i) for i in range(25)})


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(100, 180)] + [(5, 6), (6, 5), (7, 7), (200, 201)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 181)} == {100} and got[6] == 5 and 7 not in got


# --- 7 ---


def test_vectors(saved, spark):
    r = np.random.default_rng(3)
    base = r.standard_normal((1500, 32))
    near = np.concatenate([base[:60][:, None] + 0.1 * r.standard_normal((60, 4, 32))]).reshape(-1, 32)
    x = np.concatenate([base, near, 3 * base[:5], np.repeat(base[10:11], 30, 0)]).astype(np.float32)
    rows = [(i, [float(v) for v in row], i % 3) for i, row in enumerate(x)]
    n = len(rows)
    bad = [None, [], [0.0] * 32, [float("nan")] * 32, [None] * 32, [float("inf")] + [1.0] * 31, [1.0, 2.0]]
    rows += [(n + k, v, 0) for k, v in enumerate(bad)]
    d = saved(embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    got = {q["vec_id"]: q for q in queries.queries()["op7_vector_dedup"](spark, d).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    count = link.sum(axis=1)
    found = np.array([got[i]["n_links"] for i in range(n)])
    assert (found <= count).all() and found.sum() >= 0.97 * count.sum()
    assert found[10] >= 30 and got[0]["component_id"] == 0
    for i in range(n, n + len(bad)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert all(q["kept"] == (q["vec_id"] == q["component_id"]) for q in got.values())


def test_vectors_hot_leaf(spark, monkeypatch):
    monkeypatch.setattr(rptree, "LEAF_MOST", 40)
    monkeypatch.setattr(rptree, "LEAF", 64)
    r = np.random.default_rng(4)
    x = (np.ones(16) + 0.05 * r.standard_normal((300, 16))).astype(np.float32)
    got = rptree.near_vectors(spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = (u @ u.T >= 0.95).sum() - 300
    assert 0.97 * want <= sum(q["n_links"] for q in got) <= want and {q["component_id"] for q in got} == {0}
    assert rptree.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


# --- 8 ---


def test_packing(documents, saved, spark, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = [*ODD[4:5], *[(i, t) for i, t in ODD if i not in (5, None)], *[(i, prose(rng.randint(0, 900))) for i in range(20, 80)], (90, "J̌ İ ΣΣ don't IT'S <|endoftext|> <|ENDOFTEXT|> a,b. 12.5, ÷x café, café.")]
    rows = list({i: t for i, t in rows}.items())
    d = saved(documents=documents([*rows, (None, "x"), (5, "same"), (5, "same")]))
    got = queries.queries()["op8_packing"](spark, d).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, t in rows:
        ids, at = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], np.uint32), 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    # rows that repeat an id are packed whole, each by itself
    assert sum(r["length"] for r in pieces[5]) == 2 * pieces[5][0]["doc_tokens"] and sum(r["start"] == 0 for r in pieces[5]) == 2 and len(pieces[None]) == 1
    sizes = []
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        sizes.append(at)
    assert max(sizes) <= 4096
    waste = sum(4096 - n for n in sizes if n & (n - 1))
    assert waste <= 4096 * len({r["sequence_id"] >> 36 for r in got})
    assert packing.pack(documents([])).collect() == []


def test_packing_takes_like_documents_first():
    a, b = np.arange(100, 140, dtype=np.uint32), np.arange(500, 540, dtype=np.uint32)
    ids = [np.append(x, 2).astype(np.uint32) for x in (a, b, a[::-1], b[::-1])]
    assert [i for i, _, _ in packing.pack_shard(ids, 82)[0]] == [0, 2]


def test_packing_scores_all_terms_of_the_seed():
    # 30 terms that only the seed and document 2 hold (24 are no longer picked), 40 commoner ones that document 4 holds in full
    rare, common = np.arange(100, 130), np.arange(500, 540)
    docs = [np.concatenate([rare, common]), np.arange(900, 940), rare[:24], np.concatenate([common[:1], np.arange(600, 639)]), np.concatenate([rare[24:], common])]
    order = list(packing.Index([np.append(d, 2).astype(np.uint32) for d in docs]).neighbours(0))
    assert order.index(4) < order.index(2)


def test_packing_brings_like_documents_together(documents):
    # families of documents that share rare words, far apart in the input
    rows = [(k * 40 + f, " ".join([f"zyx{f}qj"] * 3 + [prose(60)])) for k in range(5) for f in range(40)]
    tokens = packing.tokenized(documents(rows).repartition(7))
    order = [r["doc_id"] % 40 for r in packing.by_content(tokens.where("n >= 0"), packing.statistics(tokens)).collect()]
    assert sum(a == b for a, b in zip(order, order[1:])) >= 120
    stats = packing.statistics(tokens)
    assert stats.df.sum() > 0 and stats.df.max() <= 200


def test_packing_seeds_anew_where_nothing_matches():
    a, b, c = np.arange(100, 140), np.arange(500, 520), np.arange(600, 640)
    ids = [np.append(x, 2).astype(np.uint32) for x in (a, b, c)]
    assert list(packing.Index(ids).neighbours(0)) == []
    assert [[i for i, _, _ in s] for s in packing.pack_shard(ids, 64)][:2] == [[0, 1, 2], [2]]


# --- 9 ---


def test_warc_round_trip(saved, spark):
    rows = [(i, f"http://h/{i}\r\nX: y", rng.choice(["<p>é</p>", "", "x" * rng.randint(0, 300_000), "WARC/1.1\r\n\r\n", None])) for i in range(80)]
    rows += [(900, None, "<p>é</p>"), (900, None, "<p>é</p>"), (None, "u", "<p>é</p>"), (901, "u", "\x1f\x8b\x08")]
    d = saved(pages=spark.createDataFrame(rows, "page_id long, url string, html string"))
    largest = {}
    for i, _, h in rows:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        b, top = (h or "").encode(), largest[h or ""]
        first = i == top
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first else "revisit", None if first else top))
    got = [tuple(r) for r in queries.queries()["op9_warc"](spark, d).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_warc_ranges_own_each_record_once():
    members = [warc.record(i, f"u{i}", bytes([i % 251]) * (i * 37 % 5000) + b"\x1f\x8b\x08", None, False) for i in range(60)]
    data = b"".join(members)
    for step in (1, 97, 1000, 5000, len(data)):
        seen = [warc.parse(raw)[0] for a in range(0, len(data), step) for raw in warc.records_in(warc.Bytes(io.BytesIO(data), len(data)), a, min(len(data), a + step))]
        assert seen == list(range(60)), step
    assert list(warc.records_in(warc.Bytes(io.BytesIO(b""), 0), 0, 0)) == []


def test_warc_reads_in_many_tasks_and_checks_payloads(spark, tmp_path):
    r = random.Random(2)
    pages = spark.createDataFrame([(i, "u", "".join(chr(33 + r.randrange(90)) for _ in range(3000))) for i in range(200)], "page_id long, url string, html string").repartition(3)
    made = warc.write_archives(pages, str(tmp_path / "w")).collect()
    got = warc.read_archives(spark.createDataFrame(made, "path string, size long"), str(tmp_path / "w"), 64 << 10)
    owners = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(owners) >= 5 and sum(x["count"] for x in owners) == 200
    raw = zlib.decompress(warc.record(1, "u", b"abc", None, False), 31)
    assert warc.parse(raw)[6] == b"abc"
    with pytest.raises(ValueError, match="payload"):
        warc.parse(raw.replace(b"abc", b"abd"))


def test_warc_empty_table(saved, spark):
    assert queries.queries()["op9_warc"](spark, saved(pages=spark.createDataFrame([], "page_id long, url string, html string"))).collect() == []


def test_warc_payloads(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a", "one"), (2, "b", "one"), (3, "c", "two")], "page_id long, url string, html string")
    made = warc.write_archives(pages, str(tmp_path / "w"), least_bytes=4).collect()
    got = {r["page_id"]: (r["record_type"], r["payload"], r["url"]) for r in warc.read_archives(spark.createDataFrame(made, "path string, size long"), str(tmp_path / "w"), 64).collect()}
    assert got == {1: ("response", b"one", "a"), 2: ("response", b"one", "b"), 3: ("response", b"two", "c")}


# --- pipeline ---


def test_pipeline(documents, saved, spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline

    item = prose(20)
    line = "this line is found in many documents of the corpus"
    rows = [(i, f"{line}\n{prose(60)}", "aa", "s") for i in range(30)]
    rows += [(40, rows[3][1] + " extra", "aa", "s"), (41, f"{prose(40)} {item} {prose(40)}", "aa", "s"), (42, "123 456", "aa", "s"), (43, None, "aa", "s")]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    d = saved(documents=documents(rows).drop("host"), benchmark=bench)
    got = corpus_pipeline.run(spark, d).collect()
    total = {r["doc_id"]: r["doc_tokens"] for r in got}
    assert set(total) == {*range(30), 41}
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    n = lambda t: len(tok.encode(t, add_special_tokens=False).ids) + 1
    # the line stays in document 40 alone, which goes as a near copy of document 3
    assert all(total[i] == n(rows[i][1].split("\n")[1]) for i in range(30))
    assert total[41] == n(rows[31][1].replace(item, ""))
    assert [s for s, _ in corpus_pipeline.STAGES][2] == "near_copies"

"""Secret scan, language ID, line dedup, decontamination, quality: against brute force on small tables and odd rows."""

import hashlib
import random
import re
import time

import duckdb
import pytest

from gatelens.llm import decontam, langid, linededup, nbsvm, queries, secrets

rng = random.Random(5)
EN = "the and that with from this have which their about other would there these people because".split()
FR = "les des est dans pour que qui sur avec une été mais nous comme plus être cette leurs".split()


def prose(words, n):
    return " ".join(rng.choice(words) + rng.choice(words) if rng.random() < 0.5 else rng.choice(words) for _ in range(n))


ODD = [(None, "no id at all"), (1, None), (2, ""), (3, " \n\t"), (4, "x" * 200_000), (5, "same"), (5, "same"), (6, "\0\x1c\x85 é́ 漢字 😀")]


def collected(df, key="doc_id"):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, str(r)))


# --- 1 ---

KINDS = [("assign", re.compile(secrets.KINDS[0][1].replace("(?i)", ""), re.I | re.A), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]


def base_spans(text):
    found = sorted((m.start(g), k, m.end(g)) for k, (_, rx, g, least) in enumerate(KINDS) for m in rx.finditer(text or "") if m.end(g) - m.start(g) >= least)
    return ",".join(f"{KINDS[k][0]}:{a}:{b}" for a, k, b in found)


def test_secret_base_spans(documents):
    rows = [*ODD, (10, "é token=token:abcdefg PASSWORD : 'hunter22' api-key: no apikey=" + "deadbeef" * 4), (11, "AKIA" + "Z9" * 10 + " AKIAshort " + "0f" * 12 + "g"), (12, "secret=ab secret='abcdef' token\t=abcdef token==abcdef")]
    got = {(r["doc_id"], r["base_sha256"]) for r in _op1(documents(rows)).collect()}
    assert got == {(i, hashlib.sha256(base_spans(t).encode()).hexdigest()) for i, t in rows}


def _op1(df):
    from pyspark.sql import functions as F

    found = secrets.find_secrets(df)
    return found.select("doc_id", F.sha2(secrets.written(F.col("base")).cast("binary"), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"))


def test_secret_battery_finds_random_tokens_only(documents):
    import base64

    token = base64.b64encode(random.Random(1).randbytes(33)).decode()
    rows = [(i, f"see {base64.b64encode(random.Random(i).randbytes(33)).decode()} here") for i in range(2, 30)] + [(1, f"key {token} end"), (50, "internationalization-of-communication counterrevolutionaries_and_others " * 3), (51, "AbAbAbAbAbAbAbAbAbAbAbAbAbAbAbAb")]
    got = {r["doc_id"]: r["spans"] for r in _op1(documents(rows)).collect()}
    assert got[1] == f"random:4:{4 + len(token)}"
    assert sum("random" in got[i] for i in range(1, 30)) >= 25
    assert got[50] == got[51] == ""


def test_secret_battery_knows_one_class_alphabets(documents):
    r = random.Random(3)
    draw = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    rows = [(i, f"see {draw(secrets.LETTERS, 40)} and {draw(secrets.DIGITS, 22)} here") for i in range(300)]
    text = [(1000 + i, "".join(r.choice("inter nation al ization counter revolution of the get User From Data base".split()) for _ in range(9))) for i in range(300)]
    text += [(2000, "AbAbAbAbAbAbAbAbAbAbAbAbAb abcdefghijklmnopqrstuvwxyzabcdefgh 12345678901234567890 " + "0" * 23)]
    got = {x["doc_id"]: x["spans"] for x in _op1(documents(rows)).collect()}
    assert not any(x["spans"] for x in _op1(documents(text)).collect())
    assert sum("random:4:44" in got[i] for i in range(300)) >= 100 and sum("random:49:71" in got[i] for i in range(300)) >= 200


def test_secret_scan_of_a_text_with_many_matches(documents):
    r = random.Random(4)
    text = " ".join(f"token=abcdef{k} " + "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(30)) for k in range(16000))
    began = time.time()
    got = _op1(documents([(1, text), (2, "b" * 1_000_000)])).collect()
    assert time.time() - began < 60
    by = {x["doc_id"]: x for x in got}
    assert by[1]["base_sha256"] == hashlib.sha256(base_spans(text).encode()).hexdigest() and by[1]["spans"].count("random") > 15000


def test_secret_empty_table(documents):
    assert _op1(documents([])).collect() == []


# --- 2 ---


def test_languages(documents, saved, spark):
    rows = [(i, prose(EN if i % 2 else FR, 40), "en" if i % 2 else "fr") for i in range(200)]
    d = saved(documents=documents([*[(i, t, lang, "s") for i, t, lang in rows], (900, None, "en", "s"), (901, "", None, "s"), (902, "12 34 !?", "fr", "s"), (903, prose(FR, 30), None, "s"), (903, prose(FR, 30), None, "s")]))
    got = queries.queries()["op2_languages"](spark, d).collect()
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 20 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and by[903]["lang_pred"] == "fr"


def test_more_languages_than_a_word_has_bits(documents):
    letters = [chr(0x4E00 + k) for k in range(700)]
    own = lambda i: " ".join("".join(rng.choice(letters[i * 10 : i * 10 + 10]) for _ in range(6)) for _ in range(30))
    filters = langid.learn(documents([(i * 10 + k, own(i), f"l{i:02}", "s") for i in range(70) for k in range(10)]))
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(documents([(i, own(i)) for i in range(70)]), filters).collect()}
    assert filters.masks.shape[1] == 2 and sum(got[i] == f"l{i:02}" for i in range(70)) >= 68


def test_languages_of_empty_table(documents, saved, spark):
    assert queries.queries()["op2_languages"](spark, saved(documents=documents([]))).collect() == []


def test_languages_without_teaching(documents):
    filters = langid.learn(documents([(1, "text", None, "s")]))
    assert [r["lang_pred"] for r in langid.predict(documents(ODD), filters).collect()] == ["und"] * len(ODD)


def test_bloom_never_misses(documents):
    filters = langid.learn(documents([(i, prose(EN, 30), "en", "s") for i in range(50)]))
    _, _, cover = langid.judge(filters, [prose(EN, 200)])
    assert cover[0] > 0.9


# --- 3 ---


def test_line_dedup_matches_sql(documents, saved, spark):
    long = [prose(EN, 12) for _ in range(6)]
    rows = [(i, "\n".join(rng.choice([*long, long[0].upper() + " ", "short", prose(EN, 12), ""]) for _ in range(rng.randint(0, 8)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, long[0]), (103, "\n\n"), (104, "é" * 40 + "\n" + "É" * 40)]
    d = saved(documents=documents(rows))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, n_lines, n_dropped, kept_sha256, keep FROM ({queries.oracle_sql()['op3_line_dedup']})").fetchall())
    assert collected(queries.queries()["op3_line_dedup"](spark, d)) == want
    assert sum(r[2] for r in want) > 10


def test_line_dedup_odd_rows(documents):
    line = "a line of forty characters and some more of it"
    rows = [*ODD, (None, line), *[(i, line + "\n" + line) for i in range(20, 24)], (24, line), (24, line)]
    out = {(r["doc_id"], r["text"]) for r in linededup.dedup_lines(documents(rows)).collect()}
    assert (None, "") in out and (24, line) in out and (20, "") in out and (1, None) in out
    maps = {(r["doc_id"], r["keep"]) for r in linededup.keep_bitmaps(documents(rows)).collect()}
    assert (20, "0,2") in maps and (24, "1") in maps and (1, "1") in maps and (3, "2") in maps
    assert linededup.dedup_lines(documents([])).collect() == []


def test_line_dedup_sorts_ranges_and_is_linear(documents, spark):
    held = linededup.occurrences(documents([(i, "\n".join("line %d that is long enough to be counted at all" % k for k in range(5))) for i in range(9)]), 40)
    plan = linededup.first_occurrences(held)._jdf.queryExecution().optimizedPlan().toString() + linededup.first_occurrences(held)._jdf.queryExecution().executedPlan().toString()
    assert "Sort [h1" in plan and "rangepartitioning(h1" in plan and "hashpartitioning" not in plan
    took = {}
    for n in (500, 4000, 8000):
        rows = [(i, "\n".join("line %d that is long enough to be counted at all" % k for k in range(n))) for i in range(6)]
        began = time.time()
        assert sum(len(r["text"]) for r in linededup.dedup_lines(documents(rows)).collect()) == len(rows[0][1])
        took[n] = time.time() - began
    assert took[8000] < 2 * took[4000] + 2


def test_line_dedup_keeps_clashing_columns(documents):
    line = "a line of forty characters and some more of it"
    docs = documents([(i, line) for i in range(6)]).selectExpr("*", "1 AS did", "2 AS th", "3 AS lost", "4 AS row", "5 AS pos", "'k' AS keeper", "6 AS h1")
    got = linededup.dedup_lines(docs).collect()
    assert sorted(r["text"] for r in got) == [""] * 5 + [line] and {(r["did"], r["lost"], r["row"], r["h1"]) for r in got} == {(1, 3, 4, 6)}


# --- 5 ---

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def said(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_decontamination(rows, items):
    windows = {}
    for i, t in items:
        w = said(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add("" if i is None else str(i))
    out = []
    for i, t in rows:
        w, hit, owners = said(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if x := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    owners |= x
        out.append((i, len(w), len(hit), len(owners), hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, str(r)))


@pytest.mark.parametrize("block", [200_000, 20, 3])
def test_decontamination(documents, saved, spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_WINDOWS", block)
    monkeypatch.setattr(decontam, "GROUP_BYTES", 500)
    items = [(1, prose(EN, 14)), (2, "Été, déjà vu!"), (3, prose(EN, 25)), (3, prose(FR, 11)), (None, prose(FR, 10)), (4, None), (5, " .,")]
    rows = [*ODD, *[(i, " ".join([prose(EN, 5), rng.choice(items)[1] or "", prose(FR, 5), "ÉTÉ; déjà" if i % 3 else "x"])) for i in range(20, 60)], (70, items[0][1].upper()), (71, items[2][1][:-3]), (72, "vu"), (72, "vu")]
    d = saved(documents=documents(rows), benchmark=spark.createDataFrame(items, "item_id long, text string"))
    assert collected(queries.queries()["op5_decontamination"](spark, d)) == brute_decontamination(rows, items)


def test_decontamination_removes_spans(documents, spark):
    item = prose(EN, 20)
    bench = spark.createDataFrame([(1, item), (2, "alpha beta")], "item_id long, text string")
    rows = [(1, f"{prose(FR, 30)} {item.upper()}, {prose(FR, 30)}"), (2, item), (3, "alpha alpha beta beta " + prose(FR, 20)), (4, prose(FR, 20)), (5, None)]
    out = {r["doc_id"]: r for r in decontam.remove_spans(documents(rows), bench).collect()}
    assert set(out) == {1, 3, 4, 5} and out[4]["text"] == rows[3][1]
    assert not any(x[5] for x in brute_decontamination([(i, r["text"]) for i, r in out.items()], [(1, item), (2, "alpha beta")]))
    assert out[1]["n_chars"] == len(out[1]["text"]) and out[1]["host"] == "h"


def test_decontamination_removes_spans_of_all_blocks_at_once(documents, spark, monkeypatch):
    w = [f"w{i}" for i in range(200)]
    # blocks of one item each: 1 and 2 overlap in the text; cutting 3 joins the sides of a window of 1
    items = [(1, " ".join(w[:10])), (2, " ".join(w[5:15])), (3, " ".join(w[20:30])), (4, " ".join(w[40:52])), (5, " ".join(w[60:66]))]
    bench = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    rows = [(1, " ".join([*w[100:120], *w[:15], *w[120:140]])), (2, " ".join([*w[100:120], *w[:4], *w[20:30], *w[4:10], *w[120:140]]))]
    rows += [(3, " ".join([*w[40:52], *w[60:66], *w[150:152]])), (4, " ".join([*w[100:110], "É,", *w[60:66]])), (5, " ".join(w[:15])), (6, None), (None, "É x")]
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    one = key(decontam.remove_spans(documents(rows), bench))
    monkeypatch.setattr(decontam, "BLOCK_WINDOWS", 1)
    assert len(list(decontam.blocks(bench, 10))) == 7
    got = decontam.remove_spans(documents(rows), bench)
    assert key(got) == one and got.schema == documents(rows).schema
    kept = {r["doc_id"]: r for r in got.collect()}
    assert set(kept) == {1, 2, 4, 6, None} and not any(set(kept[i]["text"].split()) & set(w[:30]) for i in (1, 2))
    assert kept[1]["n_chars"] == len(kept[1]["text"])


def test_decontamination_empty(documents, spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert [r["n_hit"] if "n_hit" in r else len(r["hit_ranges"]) for r in decontam.scan(documents(ODD), empty).collect()] == [0] * len(ODD)
    assert decontam.scan(documents([]), empty).collect() == []


# --- 10 ---


def test_quality_held_out(documents, saved, spark):
    junk = lambda: " ".join(prose(EN, 1).upper() + "!!" for _ in range(20))
    rows = [(i, junk() if i % 3 == 0 else prose(EN, 20) + ".") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, quality int")
    d = saved(documents=documents([*rows, (1000, None), (1001, ""), (None, "x")]), labels=labels)
    got = queries.queries()["op10_quality"](spark, d).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 300]
    assert len(held) > 40 and sum(r["predicted"] == int(r["doc_id"] % 3 != 0) for r in held) >= 0.95 * len(held)
    assert len(got) == 303 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)


def test_quality_one_class(documents, spark):
    model = nbsvm.learn(documents([(1, "a"), (2, "b")]), spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, label int"))
    assert all(r["score"] > 0.9 for r in nbsvm.predict(documents(ODD), model).collect())

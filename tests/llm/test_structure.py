"""Conversation repair against a search over all edit sequences, in one range and in segments."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from gatelens.llm import structure as st

SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        n = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if n == 1 else re.sub("[.!?]", "", text) if n == 2 else text
        out += [] if n == 0 else [(conv, turn, "user" if n == 4 else role, text)] * (2 if n == 3 else 1)
    return out


def every_repair(rows):
    """All (cost, audit, lines) with at most two inserts in a row, by plain recursion over (row, grammar state)."""
    names = {"u": "user", "a": "assistant"}
    moves = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def go(i, state, inserts):
        if i == len(rows) and state in ("", "a"):
            yield 0, "", []
        if inserts < 2:
            for r in "ua":
                if (state, r) in moves:
                    for c, a, t in go(i, r, inserts + 1):
                        yield c + 2, "I" + a, [names[r] + ":", *t]
        if i < len(rows):
            role, text, fault = rows[i]
            for c, a, t in go(i + 1, state, 0):
                yield c + 3, "D" + a, t
            if fault not in ("blank", "duplicate"):
                more = 1 if fault == "truncated" else 0
                if (state, role[:1]) in moves:
                    for c, a, t in go(i + 1, role[:1], 0):
                        yield c + more, "K" + a, [f"{role}:{text}", *t]
                for r in "ua":
                    if (state, r) in moves:
                        for c, a, t in go(i + 1, r, 0):
                            yield c + more + 2, "R" + a, [f"{names[r]}:{text}", *t]

    return go(0, "", 0)


def brute(original):
    found = {}
    for conv in {r[0] for r in original}:
        rows = [r[1:] for r in damage([r for r in original if r[0] == conv])]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), st_hash(r[1], r[2])))
        seen, faults = set(), []
        for _, role, text in rows:
            body = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in rows if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit, lines = min(every_repair([(role, text, f) for (_, role, text), f in zip(rows, faults, strict=True)]), key=lambda x: x[:2])
        found[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return found


def st_hash(role, text):
    return hashlib.md5(f"{hashlib.md5(role.encode()).hexdigest()}:{text}".encode()).digest()


def made(seed, conversations=60, longest=4):
    rng = random.Random(seed)
    out = []
    for conv in range(conversations):
        turns = sorted(rng.sample(range(-1, 9), rng.randint(1, longest)))
        for t in turns:
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None])
            out.append((None if conv == 7 else conv, None if rng.random() < 0.1 else t, role, rng.choice(["So it is.", "So it is.", "Yes! ", "cut off", "é?", " \t", "", None, "a.b\n"])))
    return out


def result(spark, rows, saved):
    d = saved(conversations=spark.createDataFrame(rows, SCHEMA).withColumn("code", F.lit("x")).withColumn("pos", F.lit(1)).withColumn("report", F.lit("r")))
    got = st.op13_structure_repair(spark, d).collect()
    assert len(got) == len({r["conv_id"] for r in got})
    return {r["conv_id"]: tuple(r)[1:] for r in got}


@pytest.mark.parametrize("seed", [1, 2])
def test_every_conversation_has_the_cheapest_repair(spark, saved, seed):
    rows = made(seed)
    assert result(spark, rows, saved) == brute(rows)


@pytest.mark.parametrize(("buffered", "segment"), [(0, 1), (0, 2), (2, 3)])
def test_segments_give_the_same(spark, saved, monkeypatch, buffered, segment):
    rows = made(3, 40, 5)
    monkeypatch.setattr(st, "BUFFER_ROWS", buffered)
    monkeypatch.setattr(st, "SEGMENT_ROWS", segment)
    monkeypatch.setattr(st, "inner", bound(st.inner, buffered, segment))
    monkeypatch.setattr(st, "segments", bound(st.segments, buffered, segment))
    assert result(spark, rows, saved) == brute(rows)


def bound(f, buffered, segment):
    """f with small bounds in the workers too."""

    def run(batches):
        st.BUFFER_ROWS, st.SEGMENT_ROWS = buffered, segment
        yield from f(batches)

    return run


def test_a_hot_conversation_is_repaired_as_one(spark, saved):
    rows = [(5, t % 500, ("user", "assistant")[t % 2], f"Line {t}." if t % 7 else "again and again.") for t in range(3000)] + made(4, 20)[:20]
    rows = [(c if c != 5 or i < 3000 else 99, *rest) for i, (c, *rest) in enumerate(rows)]
    whole = result(spark, rows, saved)
    assert set(whole) == {r[0] for r in rows}
    got = whole[5]
    mine = sorted(damage([r for r in rows if r[0] == 5]), key=lambda r: (r[1], r[2], st_hash(r[2], r[3])))
    fault = lambda text: 4 if not text.strip() else 0 if text.strip()[-1] in ".!?" else 8
    plain, _ = st.report([{"alive": True, "code": "sua".find(role[:1]) % 4 + fault(text), "h": st_hash(role, text), "turn": t, "role": role, "text": text} for _, t, role, text in mine])
    assert got[:7] == tuple(plain[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"))


def test_empty_tables_and_dropped_conversations(spark, saved):
    assert result(spark, [], saved) == {}
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert result(spark, [(dropped, 0, "user", "Hello.")], saved) == {dropped: (0, 0, 0, 0, 0, 0, "", empty)}


def test_a_very_long_text_is_whole(spark, saved):
    conv = next(i for i in range(1000) if all(zlib.crc32(f"{i}:{t}".encode()) % 20 > 4 for t in (0, 1)))
    rows = [(conv, 0, "user", "word " * 400_000 + "end."), (conv, 1, "assistant", "é" * 100_000 + "!")]
    got = result(spark, rows, saved)[conv]
    assert got[6] == "KK"
    assert got[7] == hashlib.sha256("\n".join(f"{r}:{t}" for _, _, r, t in rows).encode()).hexdigest()

"""Conversation structure repair by weighted finite-state composition.

A conversation is an input acceptor: one arc a row, with the row's role initial and faults. The edit transducer keeps,
reroles or deletes a row, or inserts an empty one, each at its cost. The role grammar ``(s?(ua)+)?`` is an acceptor of
four states. Their composition is walked lazily, state sets seen before are looked up (``step``): a topological pass
from the end gives each state's cost to the end, and a pass from the start takes, among the arcs on cheapest paths, the
one with the ASCII-least label. Since a label leads from a state to one state only, this is the least (cost, label
string) path; inserts are walked at most once around the grammar, so the lattice has no cycle.

Rows are sorted by ranges of (conversation, turn), so that a conversation of a third of all rows is spread over many
tasks. A conversation that lies inside a range, and within ``BUFFER_ROWS`` and ``BUFFER_BYTES``, is repaired there. Those
that touch a range's ends, or are longer, are repaired in segments of at most ``SEGMENT_ROWS`` rows by the same walk: a
segment's costs from each state to each state are a matrix over the (min, +) semiring, a pass over the conversation's
matrices, last first, gives the costs to the end at each border, then segments are walked in parallel from each entry
state, and a pass over their exits picks what is entered. Copies in such conversations are found by grouping hashes.

Rows: null role or text is one space, which as a text is blank; a null conv_id is a conversation of its own, and null
turns come first. Rows of the same turn go by role, then by the text's md5. Rows that repeat all columns are repeated
rows, of which all but the first are duplicates. A role's initial is its first character as it is; an empty or other
role fits nothing and is never kept. A conversation of no rows, or whose rows were all dropped, has an empty repair. Very
long texts and conversations are whole; only the audit of a conversation is one value, and so are SHA-256 digests, whose
bytes must pass through one task, in a stream. An empty table gives no rows. Other columns don't matter.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens.llm.common import keep, table, tidy

#: The role grammar: where a role initial leads from a state, and the accepting states.
INITIALS = "sua"
ARCS = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
ACCEPTS = (0, 3)
STATES = 4
LEGAL = {(0, 1), (1, 2), (2, 1)}
#: The edit transducer: costs, and the roles that may be given or inserted.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
GIVEN = {1: "user", 2: "assistant"}
#: Bits of a row's code beside its initial (0 to 2, or 3 for all others).
FORCED, CUT = 4, 8
BUFFER_ROWS, BUFFER_BYTES, SEGMENT_ROWS = 1 << 15, 1 << 23, 1 << 15
INF = float("inf")
SPACE = " \t\n\x0b\x0c\r"

REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
MESSAGES = "array<struct<role string, text string>>"


# --- composition -----------------------------------------------------------------


def row_arcs(state: int, code: int) -> Iterator[tuple[str, int, int, int | None]]:
    """(label, cost, next state, given role or None) of the ways to read a row, by label."""
    yield "D", DELETE, state, None
    if code & FORCED:
        return
    extra = TRUNCATED if code & CUT else 0
    if (state, code & 3) in ARCS:
        yield "K", KEEP + extra, ARCS[state, code & 3], None
    for role in GIVEN:
        if (state, role) in ARCS:
            yield "R", REROLE + extra, ARCS[state, role], role


def insert_arcs(state: int) -> Iterator[tuple[int, int, int]]:
    """(cost, next state, role) of the rows that may be inserted."""
    for role in GIVEN:
        if (state, role) in ARCS:
            yield INSERT, ARCS[state, role], role


def relaxed(costs: list[float]) -> list[float]:
    """Costs to the end with inserts first; a walk around the grammar is never cheapest, so STATES rounds are enough."""
    for _ in range(STATES):
        costs = [min([c, *(w + costs[to] for w, to, _ in insert_arcs(q))]) for q, c in enumerate(costs)]
    return costs


#: Costs to the end after the last row.
END = tuple(relaxed([0 if q in ACCEPTS else INF for q in range(STATES)]))


@functools.cache
def closing(state: int) -> tuple[int, ...]:
    """Roles inserted after the last row."""
    if not END[state]:
        return ()
    cost, to, role = next(x for x in insert_arcs(state) if x[0] + END[x[1]] == END[state])
    return (role, *closing(to))


@functools.cache
def step(code: int, after: tuple[float, ...]) -> tuple[tuple[float, ...], float, tuple]:
    """Costs to the end before a row of this code, given those after it, both less their least; the difference; the choices.

    A state's choice: labels, roles inserted before the row, what becomes of it ("" deleted, "K" kept, or a role), next state.
    """
    before = relaxed([min(c + after[to] for _, c, to, _ in row_arcs(q, code)) for q in range(STATES)])

    def choice(q: int):
        labels, roles = "", []
        while before[q] < INF:
            ways = [(label, c + after[to], to, role) for label, c, to, role in row_arcs(q, code)] + [("I", c + before[to], to, role) for c, to, role in insert_arcs(q)]
            label, _, to, role = min((w for w in ways if w[1] == before[q]), key=lambda w: w[0])
            labels += label
            if label != "I":
                return labels, tuple(roles), GIVEN.get(role, "K" if label == "K" else ""), to
            roles.append(role)
            q = to
        return None

    least = min(before)
    return tuple(b - least for b in before), least, tuple(choice(q) for q in range(STATES))


def backward(codes: bytes, end: tuple[float, ...]) -> tuple[list[tuple], tuple[float, ...]]:
    """Every row's choices, and the costs to the end before the first."""
    base = min(end)
    after, found = tuple(e - base for e in end), []
    for code in reversed(codes):
        after, least, choices = step(code, after)
        base += least
        found.append(choices)
    return found[::-1], tuple(a + base for a in after)


def forward(choices: list[tuple], state: int) -> tuple[str, list[tuple], int]:
    """Labels, what becomes of each row, and the state at the end."""
    labels, fates = [], []
    for options in choices:
        label, before, own, state = options[state]
        labels.append(label)
        fates.append((before, own))
    return "".join(labels), fates, state


def message(role: int) -> dict:
    return {"role": GIVEN[role], "text": ""}


def repaired(rows: list[tuple[str, str]], fates: list[tuple], after: tuple[int, ...]) -> list[dict]:
    out = []
    for (role, text), (before, own) in zip(rows, fates, strict=True):
        out.extend(map(message, before))
        if own:
            out.append({"role": role if own == "K" else own, "text": text})
    return [*out, *map(message, after)]


# --- conversations inside a range ------------------------------------------------


def coded(rows: DataFrame) -> DataFrame:
    """Rows(conv_id, turn, role, text, alive) with code, h (md5 of role and text) and pos, their place in the order of all.

    The sort is by ranges. Equal rows, which no range could part otherwise, are told apart by the number that they came with.
    """
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.position(F.substring("role", 1, 1), F.lit(INITIALS)) - 1
    code = F.when((F.col("role") == "") | (initial < 0), 3).otherwise(initial) + F.when(end == "", FORCED).when(F.right(end, F.lit(1)).isin(".", "!", "?"), 0).otherwise(CUT)
    known = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), "alive", F.monotonically_increasing_id().alias("came"))
    known = known.withColumn("h", F.unhex(F.md5(F.concat(F.md5("role"), F.lit(":"), "text")))).withColumn("code", code.cast("int"))
    order = ["conv_id", "turn", "role", "h", "came"]
    return known.repartitionByRange(*order).sortWithinPartitions(*order).drop("came").withColumn("pos", F.monotonically_increasing_id())


FIELDS = "conv_id long, pos long, turn long, role string, text string, code int, alive boolean, h binary"


def report(rows: list[dict]) -> tuple[dict, list[dict]]:
    """Counts and repair of a whole conversation."""
    rows = [r for r in rows if r["alive"]]
    seen, codes, counts = set(), bytearray(), [0, 0, 0]
    for r in rows:
        code = r["code"]
        copy = not code & FORCED and r["h"] in seen
        seen.add(r["h"])
        counts[0] += bool(code & FORCED)
        counts[1] += copy
        counts[2] += bool(code & CUT) and not copy
        codes.append(code & 3 | FORCED if copy else code)
    turns = {r["turn"] for r in rows} - {None}
    choices, costs = backward(bytes(codes), END)
    labels, fates, state = forward(choices, 0)
    after = closing(state)
    illegal = sum((a & 3, b & 3) not in LEGAL for a, b in itertools.pairwise(codes))
    found = {"gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, "blank": counts[0], "duplicate": counts[1], "truncated": counts[2], "illegal": illegal, "cost": int(costs[0]), "audit": labels + "I" * len(after)}
    return found, repaired([(r["role"], r["text"]) for r in rows], fates, after)


def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reports of the conversations inside a range; the rows of the others go on as they are."""
    schema = pa.schema([*((n, t) for n, t in OPEN), ("report", pa.struct(COUNTED)), ("messages", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])
    held, size, loose, current, out, weight = [], 0, True, None, [], 0

    def settle():
        nonlocal held, size
        if loose:
            out.extend(held)
        elif held:
            found, messages = report(held)
            out.append({"conv_id": current, "report": found, "messages": messages})
        held, size = [], 0

    any_row = False
    for batch in batches:
        for r in batch.to_pylist():
            if not any_row:
                any_row, current = True, r["conv_id"]
            elif r["conv_id"] != current:
                settle()
                loose, current = False, r["conv_id"]
            held.append(r)
            size += len(r["text"])
            weight += len(r["text"])
            if loose or len(held) > BUFFER_ROWS or size > BUFFER_BYTES:
                loose = True
                out.extend(held)
                held, size = [], 0
            if len(out) >= 1000 or weight > BUFFER_BYTES:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, weight = [], 0
    loose = True  # the last one may go on in the next range
    settle()
    yield pa.RecordBatch.from_pylist(out, schema)


OPEN = [("conv_id", pa.int64()), ("pos", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("code", pa.int32()), ("alive", pa.bool_()), ("h", pa.binary())]
COUNTED = [*((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())]


# --- conversations over several ranges -------------------------------------------


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of a conversation: codes, places, illegal pairs within, costs from each state to each state."""

    def made(conv, codes, places):
        matrix = [[row[q] for row in ends] for q in range(STATES)] if (ends := [backward(codes, tuple(0 if k == q else INF for k in range(STATES)))[1] for q in range(STATES)]) else []
        return {"conv_id": conv, "at": places[0], "codes": bytes(codes), "places": np.array(places, np.int64).tobytes(), "illegal": sum((a & 3, b & 3) not in LEGAL for a, b in itertools.pairwise(codes)), "matrix": [-1 if c == INF else int(c) for row in matrix for c in row]}

    schema = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("codes", pa.binary()), ("places", pa.binary()), ("illegal", pa.int64()), ("matrix", pa.list_(pa.int64()))])
    current, codes, places = None, bytearray(), []
    for batch in batches:
        out = []
        for conv, pos, code in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "pos", "code")), strict=True):
            if places and (conv != current or len(places) >= SEGMENT_ROWS):
                out.append(made(current, codes, places))
                codes, places = bytearray(), []
            current = conv
            codes.append(code)
            places.append(pos)
        yield pa.RecordBatch.from_pylist(out, schema)
    if places:
        yield pa.RecordBatch.from_pylist([made(current, codes, places)], schema)


def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, ends, last) of segments, a conversation's last first: the costs to the end after each."""
    schema = pa.schema([("at", pa.int64()), ("ends", pa.list_(pa.int64())), ("last", pa.bool_())])
    current, costs, any_row = None, END, False
    for batch in batches:
        out = []
        for conv, at, matrix in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "at", "matrix")), strict=True):
            last = not any_row or conv != current
            if last:
                any_row, current, costs = True, conv, END
            out.append({"at": at, "ends": [int(c) for c in costs], "last": last})
            costs = tuple(min(matrix[q * STATES + k] + costs[k] for k in range(STATES) if matrix[q * STATES + k] >= 0) for q in range(STATES))
        yield pa.RecordBatch.from_pylist(out, schema)


def walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, at, illegal, first, final, costs, labels, exits): each segment walked from each state."""
    schema = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("illegal", pa.int64()), ("first", pa.int32()), ("final", pa.int32()), ("start", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("exits", pa.list_(pa.int32()))])
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            choices, costs = backward(r["codes"], tuple(r["ends"]))
            ways = [forward(choices, q) for q in range(STATES)]
            labels = [w[0] + "I" * len(closing(w[2])) if r["last"] else w[0] for w in ways]
            out.append({"conv_id": r["conv_id"], "at": r["at"], "illegal": r["illegal"], "first": r["codes"][0] & 3, "final": r["codes"][-1] & 3, "start": [int(c) for c in costs], "labels": labels, "exits": [w[2] for w in ways]})
        yield pa.RecordBatch.from_pylist(out, schema)


def picks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, at, entry, labels, illegal, cost) of segments in order: each is entered where the one before it ended.

    The first one's cost is the conversation's; illegal has the pair at the border to the segment before.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("entry", pa.int32()), ("labels", pa.string()), ("illegal", pa.int64()), ("cost", pa.int64())])
    current, state, final, any_row = None, 0, None, False
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            first = not any_row or r["conv_id"] != current
            if first:
                any_row, current, state = True, r["conv_id"], 0
            broken = not first and (final, r["first"]) not in LEGAL
            out.append({"conv_id": current, "at": r["at"], "entry": state, "labels": r["labels"][state], "illegal": r["illegal"] + broken, "cost": r["start"][0] if first else 0})
            state, final = r["exits"][state], r["final"]
        yield pa.RecordBatch.from_pylist(out, schema)


def fates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pos, before, own, after) of the rows of segments whose entries are known: what is inserted around, what becomes of it."""
    schema = pa.schema([("pos", pa.int64()), ("before", pa.list_(pa.string())), ("own", pa.string()), ("after", pa.list_(pa.string()))])
    for batch in batches:
        for r in batch.to_pylist():
            choices, _ = backward(r["codes"], tuple(r["ends"]))
            _, found, state = forward(choices, r["entry"])
            out = [{"pos": int(p), "before": [GIVEN[x] for x in before], "own": own, "after": []} for p, (before, own) in zip(np.frombuffer(r["places"], np.int64), found, strict=True)]
            if r["last"]:
                out[-1]["after"] = [GIVEN[x] for x in closing(state)]
            yield pa.RecordBatch.from_pylist(out, schema)


def across(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reports, messages) of the conversations whose rows these are; a message row has its place as piece."""
    first = rows.where(F.col("alive") & (F.col("code").bitwiseAND(FORCED) == 0)).groupBy("conv_id", "h").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("new"))
    copy = (F.col("code").bitwiseAND(FORCED) == 0) & F.col("new").isNull() & F.col("alive")
    marked = keep(rows.select("conv_id", "pos", "turn", "code", "alive").join(first, "pos", "left").select("conv_id", "pos", "turn", "alive", "code", copy.alias("copy")), "rows")
    has = lambda bit: F.col("code").bitwiseAND(bit) > 0
    alive = F.col("alive")
    counts = marked.groupBy("conv_id").agg(
        F.coalesce(F.max(F.when(alive, F.col("turn"))) - F.min(F.when(alive, F.col("turn"))) + 1 - F.count_distinct(F.when(alive, F.col("turn"))), F.lit(0)).alias("gaps"),
        F.count_if(alive & has(FORCED)).alias("blank"), F.count_if(F.col("copy")).alias("duplicate"), F.count_if(alive & has(CUT) & ~F.col("copy")).alias("truncated"),
    )
    code = F.when(F.col("copy"), F.col("code").bitwiseAND(3) + FORCED).otherwise(F.col("code"))
    ordered = marked.where("alive").select("conv_id", "pos", code.cast("int").alias("code")).repartitionByRange("pos").sortWithinPartitions("pos")
    parts = keep(ordered.mapInArrow(tidy(segments), "conv_id long, at long, codes binary, places binary, illegal long, matrix array<long>"), "segments")
    by = lambda df, at: df.repartition("conv_id").sortWithinPartitions("conv_id", at)
    ends = by(parts.select("conv_id", "at", "matrix"), F.desc("at")).mapInArrow(borders, "at long, ends array<long>, last boolean")
    known = keep(parts.drop("matrix").join(ends, "at"), "borders")
    ways = known.drop("places").mapInArrow(tidy(walks), "conv_id long, at long, illegal long, first int, final int, start array<long>, labels array<string>, exits array<int>")
    picked = keep(by(ways, "at").mapInArrow(picks, "conv_id long, at long, entry int, labels string, illegal long, cost long"), "walks")
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "labels"))), lambda x: x["labels"]), "")
    paths = picked.groupBy(F.col("conv_id").alias("c")).agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), audit.alias("audit"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    reports = counts.join(paths, F.col("conv_id").eqNullSafe(F.col("c")), "left").select("conv_id", *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"))
    edits = known.join(picked.select("at", "entry"), "at").select("codes", "places", "ends", "last", "entry").mapInArrow(tidy(fates), "pos long, before array<string>, own string, after array<string>")
    given = lambda c: F.transform(c, lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))
    own = F.when(F.col("own") != "", F.array(F.struct(F.when(F.col("own") == "K", F.col("role")).otherwise(F.col("own")).alias("role"), "text"))).otherwise(F.expr(f"cast(array() as {MESSAGES})"))
    messages = rows.select("conv_id", "pos", "role", "text").join(edits, "pos").select("conv_id", F.col("pos").alias("piece"), F.concat(given("before"), own, given("after")).cast(MESSAGES).alias("messages"))
    return reports, messages.where(F.size("messages") > 0)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Repairs of rows(conv_id, turn, role, text, alive): (whole, reports, pieces). Rows that aren't alive only name a conversation.

    whole has (conv_id, report, messages), a conversation a row. Those that are spread over ranges are in reports(conv_id, ...)
    and in pieces(conv_id, piece, messages), to be read in the order of piece.
    """
    schema = f"{FIELDS}, report struct<{', '.join(f'{n}: {t}' for n, t in (x.split() for x in REPORT.split(', ')))}>, messages {MESSAGES}"
    columns = [x.split()[0] for x in FIELDS.split(", ")]
    seen = keep(coded(rows).select(*columns).mapInArrow(tidy(inner), schema), "conversations")
    reports, pieces = across(seen.where("report is null").select(*columns))
    return seen.where("report is not null").select("conv_id", "report", "messages"), reports, pieces


# --- the query -------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with the faults that crc32 of conversation and turn gives them; a row that is dropped is left without life."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(F.col("fault") <= 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    known = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), fault.alias("fault"))
    times = F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))
    out = known.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("fault") != 0).alias("alive"), F.explode(times))
    return out.select("conv_id", "turn", "role", "text", "alive")


def lines(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, sha256) of pieces(conv_id, line) sorted by conversation and place; a stream, however long it is."""
    current, hashed = None, None
    for batch in batches:
        done = []
        for conv, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist(), strict=True):
            if hashed is None or conv != current:
                if hashed is not None:
                    done.append((current, hashed.hexdigest()))
                current, hashed = conv, hashlib.sha256()
            else:
                hashed.update(b"\n")
            hashed.update(line.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.string())], names=["c", "sha"])
    if hashed is not None:
        yield pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), pa.array([hashed.hexdigest()])], names=["c", "sha"])


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole, reports, pieces = repair(damaged(table(spark, sf_dir, "conversations")))
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    done = whole.select("conv_id", "report.*", sha(lines(F.col("messages"))).alias("repaired_sha256"))
    hashed = pieces.select("conv_id", "piece", lines(F.col("messages")).alias("line")).repartition("conv_id").sortWithinPartitions("conv_id", "piece").select("conv_id", "line").mapInArrow(digests, "c long, sha string")
    rest = reports.join(hashed, F.col("conv_id").eqNullSafe(F.col("c")), "left").select(*reports.columns, F.coalesce("sha", sha(F.lit(""))).alias("repaired_sha256"))
    return done.unionByName(rest)

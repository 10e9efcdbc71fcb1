"""Secret scans: known patterns, and a battery of randomness tests with false-discovery control.

Base spans come from three patterns: ``assign`` (the value of an assignment), ``access`` (key ids) and ``hex``. The
battery judges every other token of ``LEAST_TOKEN`` or more characters. A token's encoding is inferred from the
characters that it has. Three statistics follow: a chi-squared statistic of alphabet uniformity, runs about the
alphabet's middle, and the serial correlation of neighbours, each in standard deviations of its exact moments. They are
held against two hypotheses.

* Random: the three together, the root of the sum of their squares, must stay below the ``1 - ALPHA`` quantile of a null
  table, which is simulated with the same expressions for each encoding and length.
* Written: under the character frequencies of written text (``WRITTEN``, restricted to the encoding), the chi-squared
  statistic has other exact moments, as it is linear in the number of agreeing pairs. Its lower tail is the token's
  p-value; the normal tail is on the safe side, as the statistic is skewed to the right.

The p-values are controlled for false discoveries (Benjamini and Hochberg) among the tokens of one encoding and like
length in all documents, by counts in fixed bins. Tokens that reject "written" under this control and don't reject "random" are spans
of kind ``random``. Everything is DataFrame operations; only the bins' counts and the null table, bounded by their
numbers of cells, reach the driver.

Rows: null and empty texts have no spans. Rows that repeat a doc_id are scanned one by one and all count for the
control. Texts of any length are scanned whole; n matches in a text cost about n ** 1.5 short steps. An empty table
gives no rows. Other columns are not read. Positions are code points, ends exclusive; an ``assign`` span is its value.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens.llm.common import keep, table

#: Kind, pattern, group that is the span, least code points of it.
KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]
#: The same matches of the last two kinds, without those that are too short: their runs only get shorter further right.
LONG_ACCESS, LONG_HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
LEAST_TOKEN = 20
#: A run of token characters that ends where an assignment begins.
TOKEN = r"""(?<![A-Za-z0-9+/_=-])((?:(?!(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=])[A-Za-z0-9+/_=-]){%d,}+)""" % LEAST_TOKEN

LETTERS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings by the pattern that a whole token must match, tried in order.
ENCODINGS = [
    ("^[0-9]+$", DIGITS),
    ("^[0-9a-f]+$", DIGITS + "abcdef"),
    ("^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("^[a-z]+$", LETTERS),
    ("^[A-Z]+$", LETTERS.upper()),
    ("^[a-z2-7]+$", LETTERS + "234567"),
    ("^[A-Z2-7]+$", LETTERS.upper() + "234567"),
    ("^[A-Za-z0-9]+$", LETTERS.upper() + LETTERS + DIGITS),
    ("^[A-Za-z0-9_-]+$", LETTERS.upper() + LETTERS + DIGITS + "-_"),
    ("", LETTERS.upper() + LETTERS + DIGITS + "+/"),
]
#: Percentages of the letters a to z in English.
LETTER_SHARE = [8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074]
#: Percentages of the first digits 1 to 9 by Benford's law. Long written numbers are padded: half is 0.
DIGIT_SHARE = [30.1, 17.6, 12.5, 9.7, 7.9, 6.7, 5.8, 5.1, 4.6]
#: Shares of capitals among letters, of digits and of each mark in written tokens.
CAPITALS, NUMERIC, MARK = 0.05, 0.03, 0.01
#: The battery's level; the share of false discoveries allowed.
ALPHA, FALSE_SHARE = 0.01, 0.05
#: Lengths at which the bands of the control, and of the null table, begin; simulated tokens for each cell of the table.
BANDS, SIMULATED = [20, 24, 32, 48, 96], 400
#: p-values are counted by -BIN_STEPS log10 up to the last bin.
BIN_STEPS, LAST_BIN = 40, 1200


def written_moments() -> list[tuple[float, float]]:
    """For each encoding the chances that two, and that three, characters of written text agree."""
    share = {c: p * (1 - NUMERIC) * (1 - CAPITALS) for c, p in zip(LETTERS, LETTER_SHARE, strict=True)}
    share |= {c.upper(): p * (1 - NUMERIC) * CAPITALS for c, p in zip(LETTERS, LETTER_SHARE, strict=True)}
    share |= {"0": 50 * NUMERIC} | {d: p / 2 * NUMERIC for d, p in zip(DIGITS[1:], DIGIT_SHARE, strict=True)} | dict.fromkeys("+/-_", 100 * MARK)
    out = []
    for _, alphabet in ENCODINGS:
        total = sum(share[c] for c in alphabet)
        out.append(tuple(sum((share[c] / total) ** k for c in alphabet) for k in (2, 3)))
    return out


def let(value: Column, body) -> Column:
    """body of a value that is computed once; a lambda would compute it again at each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def placed(text: Column, pattern: str, value: int, word: int) -> Column:
    """array<struct<end, size, word>> of the matches: where each ends, the length of group ``value`` and group ``word``.

    Text between matches and matches alternate, so their lengths add up to the positions. Sums are taken in blocks of
    about the square root of the number of matches, as appending to an array copies it.
    """
    items = "array<struct<end: bigint, size: bigint, word: string>>"
    long = lambda a: F.transform(a, lambda x: F.length(x).cast("long"))
    groups = lambda i: F.regexp_extract_all(text, F.lit(pattern), F.lit(i))
    zipped = F.arrays_zip(long(F.split(text, pattern, -1)).alias("between"), long(groups(0)).alias("whole"), long(groups(value)).alias("value"), groups(word).alias("word"))
    none = lambda kind: F.struct(F.lit(0).cast("long").alias("at"), F.expr(f"cast(array() as {kind})").alias("found"))

    def within(acc: Column, x: Column) -> Column:
        end = acc["at"] + x["between"] + x["whole"]
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(F.struct(end.alias("end"), x["value"].alias("size"), x["word"].alias("word")))).alias("found"))

    def across(acc: Column, block: Column) -> Column:
        moved = F.transform(block["found"], lambda x: F.struct((x["end"] + acc["at"]).alias("end"), x["size"].alias("size"), x["word"].alias("word")))
        return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["found"], F.array(moved)).alias("found"))

    def summed(parts: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(parts))).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), F.size(parts), step), lambda i: F.aggregate(F.slice(parts, i, step), none(items), within))
        return F.flatten(F.aggregate(blocks, none(f"array<{items}>"), across, lambda acc: acc["found"]))

    return F.when(text.rlike(pattern), let(F.filter(zipped, lambda x: x["whole"].isNotNull()), summed)).otherwise(F.expr(f"cast(array() as {items})"))


def tail(z: Column) -> Column:
    """Upper tail of the normal distribution (Abramowitz and Stegun, 26.2.17); far out a bound from above."""
    x = F.least(F.abs(z), F.lit(30.0))
    t, density = 1 / (1 + 0.2316419 * x), F.exp(-x * x / 2) * 0.3989422804014327
    p = F.when(x > 3, density / x).otherwise(density * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))))
    return F.when(z >= 0, p).otherwise(1 - p)


def _adjacent(a: Column, f) -> Column:
    """Sum of f over neighbours."""
    return F.aggregate(F.zip_with(F.slice(a, F.lit(1), F.size(a) - 1), F.slice(a, F.lit(2), F.size(a) - 1), f), F.lit(0.0), lambda acc, v: acc + v)


def encoding(core: Column) -> Column:
    found = F.lit(len(ENCODINGS) - 1)
    for i in range(len(ENCODINGS) - 2, -1, -1):
        found = F.when(core.rlike(ENCODINGS[i][0]), i).otherwise(found)
    return found


def _of_encoding(values: list, code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), code + 1)


def battery(token: Column, code: Column | None = None) -> Column:
    """struct<n, code, score, written>: length, encoding, the three statistics together, the p-value of "written".

    Null where less than LEAST_TOKEN characters are left without padding. Every step is linear in the token's length.
    """
    core = F.regexp_replace(token, "=+$", "")
    two, three = ([m[i] for m in written_moments()] for i in (0, 1))

    def begun(core: Column) -> Column:
        return F.struct(core.alias("core"), (encoding(core) if code is None else code).alias("code"), F.length(core).cast("double").alias("n"), F.split(core, "", -1).alias("chars"))

    def coded(x: Column) -> Column:
        alphabet = _of_encoding([a for _, a in ENCODINGS], x["code"])
        pairs = F.aggregate(F.array_distinct(x["chars"]), -x["n"], lambda acc, c: acc + F.pow(x["n"] - F.length(F.replace(x["core"], c, F.lit(""))), F.lit(2.0)))
        places = let(alphabet, lambda a: F.transform(x["chars"], lambda c: F.instr(a, c) - 1))
        return F.struct(x["n"].alias("n"), x["code"].alias("code"), _of_encoding([float(len(a)) for _, a in ENCODINGS], x["code"]).alias("k"), places.alias("codes"), pairs.alias("pairs"))

    def averaged(x: Column) -> Column:
        high = lambda c: c >= x["k"] / 2
        mean = F.aggregate(x["codes"], F.lit(0.0), lambda acc, c: acc + c) / x["n"]
        above = F.aggregate(x["codes"], F.lit(0.0), lambda acc, c: acc + F.when(high(c), 1.0).otherwise(0.0))
        runs = 1 + _adjacent(x["codes"], lambda a, b: F.when(high(a) != high(b), 1.0).otherwise(0.0))
        return F.struct(*[x[c].alias(c) for c in ("n", "code", "k", "codes", "pairs")], mean.alias("mean"), above.alias("above"), runs.alias("runs"))

    def moments(x: Column) -> Column:
        squares = F.aggregate(x["codes"], F.lit(0.0), lambda acc, c: acc + (c - x["mean"]) * (c - x["mean"]))
        lagged = _adjacent(x["codes"], lambda a, b: (a - x["mean"]) * (b - x["mean"]))
        return F.struct(*[x[c].alias(c) for c in ("n", "code", "k", "pairs", "above", "runs")], squares.alias("squares"), lagged.alias("lagged"))

    def judged(x: Column) -> Column:
        n, pairs = x["n"], x["pairs"]
        among, even = n * (n - 1), 1 / x["k"]
        uniform = (pairs - among * even) / F.sqrt(2 * among * even * (1 - even))
        both = 2 * x["above"] * (n - x["above"])
        spread = both * (both - n) / (n * n * (n - 1))
        never = F.lit(1e9)
        runs = F.when(spread <= 0, never).otherwise(F.abs(x["runs"] - 1 - both / n) / F.sqrt(spread))
        serial = F.when(x["squares"] <= 0, never).otherwise(F.abs(x["lagged"] / x["squares"] + 1 / n) * F.sqrt(n))
        s2, s3 = _of_encoding(two, x["code"]), _of_encoding(three, x["code"])
        written = (pairs - among * s2) / F.sqrt(2 * among * (s2 - s2 * s2) + 4 * among * (n - 2) * (s3 - s2 * s2))
        return F.struct(n.cast("long").alias("n"), x["code"].alias("code"), F.round(F.sqrt(uniform * uniform + runs * runs + serial * serial), 9).alias("score"), tail(-written).alias("written"))

    return F.when(F.length(core) >= LEAST_TOKEN, let(core, lambda c: let(begun(c), lambda w: let(coded(w), lambda x: let(averaged(x), lambda y: let(moments(y), judged))))))


def band(n: Column) -> Column:
    """Index of the band that a length is in."""
    found = F.lit(0)
    for i, b in enumerate(BANDS):
        found = F.when(n >= b, i).otherwise(found)
    return found


def p_bin(p: Column) -> Column:
    return F.least(F.floor(-BIN_STEPS * F.log10(F.greatest(p, F.lit(1e-300)))), F.lit(LAST_BIN)).cast("int")


@functools.cache
def _null_table(alpha: float, simulated: int, lengths: tuple[int, ...]) -> list[list[float]]:
    spark, cells = SparkSession.getActiveSession(), len(ENCODINGS) * len(lengths)
    one = spark.range(cells * simulated).select("id", (F.col("id") % len(ENCODINGS)).cast("int").alias("code"), (F.floor(F.col("id") / len(ENCODINGS)) % len(lengths)).cast("int").alias("band"))
    n = F.element_at(F.array(*[F.lit(x) for x in lengths]), F.col("band") + 1)
    alphabet = F.split(_of_encoding([a for _, a in ENCODINGS], F.col("code")), "", -1)
    drawn = let(alphabet, lambda a: F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(a, (F.pmod(F.xxhash64("id", i), F.size(a)) + 1).cast("int"))))
    scored = one.select("code", "band", F.array_join(drawn, "").alias("token")).select("code", "band", battery(F.col("token"), F.col("code"))["score"].alias("score"))
    rows = scored.groupBy("code", "band").agg(F.percentile("score", F.lit(1 - alpha)).alias("limit")).collect()  # a row for each cell
    out = [[0.0] * len(lengths) for _ in ENCODINGS]
    for r in rows:
        out[r["code"]][r["band"]] = float(r["limit"])
    return out


def null_table() -> list[list[float]]:
    """For each encoding and band the score that a share ALPHA of random tokens of the band's least length exceed."""
    return _null_table(ALPHA, SIMULATED, tuple(BANDS))


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, base, tokens): base spans by kind, and the tokens that touch none with what the battery says of them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    span = lambda x, kind: F.struct((x["end"] - x["size"]).alias("s"), F.lit(kind).alias("kind"), x["end"].alias("e"))
    # assignments and tokens in one pass: a token ends before an assignment, so the assignments are those of a pass of their own
    both = placed(text, f"(?:{KINDS[0][1]})|{TOKEN}", 2, 3)
    alone = lambda w: (F.length(w) > 0) & ~w.rlike(LONG_ACCESS) & ~w.rlike(LONG_HEX)
    said = lambda x: F.struct((x["end"] - F.length(x["word"])).alias("s"), x["end"].alias("e"), battery(x["word"]).alias("p"))
    found = let(both, lambda items: F.struct(
        F.transform(F.filter(items, lambda x: x["size"] >= KINDS[0][3]), lambda x: span(x, 0)).alias("assign"),
        F.filter(F.transform(F.filter(items, lambda x: alone(x["word"])), said), lambda t: t["p"].isNotNull()).alias("tokens"),
    ))
    access, long_hex = F.transform(placed(text, LONG_ACCESS, 0, 0), lambda x: span(x, 1)), F.transform(placed(text, LONG_HEX, 0, 0), lambda x: span(x, 2))
    rows = docs.select("doc_id", found.alias("found"), F.concat(access, long_hex).alias("others"))
    return rows.select("doc_id", F.array_sort(F.concat("found.assign", "others")).alias("base"), F.col("found.tokens").alias("tokens"))


def bounds(found: DataFrame) -> list[list[int]]:
    """For each encoding and length band the least p-value bin that the control lets through; LAST_BIN + 1 where none is."""
    cell = [F.col("t.p.code").alias("code"), band(F.col("t.p.n")).alias("band"), p_bin(F.col("t.p.written")).alias("bin")]
    rows = found.select(F.explode("tokens").alias("t")).groupBy(*cell).agg(F.count("*").alias("n")).collect()  # at most encodings times bands times bins
    out = [[LAST_BIN + 1] * len(BANDS) for _ in ENCODINGS]
    for code in range(len(ENCODINGS)):
        for b in range(len(BANDS)):
            bins = sorted(((r["bin"], r["n"]) for r in rows if (r["code"], r["band"]) == (code, b)), reverse=True)
            total, rank = sum(n for _, n in bins), 0
            for k, n in bins:
                rank += n
                # every p-value of bin k is at most 10 ** (-k / BIN_STEPS)
                if k > 0 and 10 ** (-k / BIN_STEPS) <= FALSE_SHARE * rank / total:
                    out[code][b] = k
    return out


def _discoveries(tokens: Column, limits: list[list[int]], table: list[list[float]]) -> Column:
    def good(t: Column) -> Column:
        cell = lambda rows: F.element_at(_of_encoding([F.array(*[F.lit(x) for x in row]) for row in rows], t["p"]["code"]), band(t["p"]["n"]) + 1)
        return (p_bin(t["p"]["written"]) >= cell(limits)) & (t["p"]["score"] <= cell(table))

    return F.transform(F.filter(tokens, good), lambda t: F.struct(t["s"].alias("s"), F.lit(len(KINDS)).alias("kind"), t["e"].alias("e")))


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): arrays of struct<s, kind, e> in order; kinds number KINDS, and 3 is ``random``."""
    found = keep(candidates(docs), "secrets")
    return found.select("doc_id", "base", F.array_sort(F.concat("base", _discoveries(F.col("tokens"), bounds(found), null_table()))).alias("spans"))


def written(found: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS], F.lit("random"))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))

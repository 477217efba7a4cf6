"""Secret scans: fixed patterns, and a battery of randomness tests on encoded-looking tokens. DataFrame functions only.

A token is a run of at least MIN_LENGTH characters of A-Za-z0-9+/_- (and = at its end) whose encoding can be told: hex (digits and letters
a-f of one case), base32 (A-Z and 2-7, letters and digits) or base64 (upper case, lower case and digits). Prose has none.
Two questions are put to a token. Could a regular one (a name, words and counters joined) look like it? That hypothesis is tested by how rare
its letters are in text, and by how often the class of characters changes; in each class of encoding and length (powers of two) the
Benjamini-Hochberg procedure at FALSE_DISCOVERY rejects it, so that a class's number of tokens sets the limit, and what bounds the share of
regular tokens is what is reported: tokens whose length has no power are not. And are its symbols drawn evenly and independently? Chi-squared over
the alphabet, runs above and below its middle, and the correlation of neighbours, joined by Fisher's method, refute that for patterns
that repeat. Tokens that are not regular by the first and not refuted by the second are spans of kind random, unless a pattern's span holds
them already.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.llm.common import materialize, read

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # AKIA[A-Z0-9]+ of 18 characters or more: a failing match holds no longer one
HEX = r"[0-9a-f]{16,}"  # likewise [0-9a-f]+ of 16 or more
TOKEN = r"[A-Za-z0-9+/_-]{20,}=*"
MIN_LENGTH = 20
KINDS = ("assign", "access", "hex", "random")
FALSE_DISCOVERY = 0.05
LEAST_EVEN = 0.001
#: Letters of English text, a to z, in per cent.
LETTERS = (8.167, 1.492, 2.782, 4.253, 12.702, 2.228, 2.015, 6.094, 6.966, 0.153, 0.772, 4.025, 2.406, 6.749, 7.507, 1.929, 0.095, 5.987, 6.327, 9.056, 2.758, 0.978, 2.360, 0.150, 1.974, 0.074)
SPREAD = 1.3  # names spread more than letters drawn one by one
CHANGES = {"hex": 0.3, "base32": 0.15, "base64": 0.4}  # how often the class of characters changes in a regular token, at most
BIN, BINS = 0.02, 3000
BLOCK = 256
ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}


def _bound(value: Column, use) -> Column:
    """use(value) with the value computed once, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _folded(parts: Column, item: str, step) -> Column:
    """What step(number, part) -> (number, items) gives over the parts in turn, the number from 0: array of items. Folded over blocks of BLOCK
    parts, so that many parts take work in proportion to them (an array that grows by one is copied each time)."""

    def add(a: Column, x: Column) -> Column:
        at, items = step(a["at"], x)
        return F.struct(at.alias("at"), F.concat(a["found"], items).alias("found"))

    def block(a: Column, x: Column) -> Column:
        empty = F.struct(a["at"].alias("at"), F.expr(f"CAST(array() AS array<{item}>)").alias("found"))
        return _bound(F.aggregate(x, empty, add), lambda own: F.struct(own["at"].alias("at"), F.concat(a["blocks"], F.array(own["found"])).alias("blocks")))

    blocks = lambda x: F.transform(F.sequence(F.lit(0), F.floor(F.size(x) / BLOCK)), lambda i: F.slice(x, (i * BLOCK + 1).cast("int"), BLOCK))
    none = F.expr(f"struct(0 AS at, CAST(array() AS array<array<{item}>>) AS blocks)")
    return F.flatten(F.aggregate(_bound(parts, lambda x: F.filter(blocks(x), lambda own: F.size(own) > 0)), none, block, lambda a: a["blocks"]))


_MATCH = "struct<start: int, end: int, text: string, value: string>"
_FOUND = "struct<start: int, kind: int, end: int>"


def matches(text: Column, pattern: str, value_group: int = 0) -> Column:
    """array<struct<start, end, text, value>> of the leftmost non-overlapping matches, in code points; no match: empty."""
    whole, value = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), value.alias("value"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["gap"])
        end = start + F.length(x["whole"])
        return end, F.array(F.struct(start.alias("start"), end.alias("end"), x["whole"].alias("text"), x["value"].alias("value")))

    found = _folded(F.slice(parts, 1, F.size(whole)), _MATCH, step)  # the text after the last match is no part
    return F.when(text.rlike(pattern), found).otherwise(F.expr(f"CAST(array() AS array<{_MATCH}>)"))


def _outside(spans: Column) -> Column:
    """Of spans sorted by start and kind, those of kind random that lie in a pattern's span go."""

    def step(end: Column, x: Column) -> tuple[Column, Column]:
        own = F.array(F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
        return F.when(x["kind"] < 3, F.greatest(end, x["end"])).otherwise(end), F.when((x["kind"] == 3) & (x["end"] <= end), F.slice(own, 1, 0)).otherwise(own)

    return _folded(spans, _FOUND, step)


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the normal distribution, kept over 1e-300: a polynomial below 2.5, a continued fraction beyond (relative error under 1e-5)."""
    density = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    t = 1 / (1 + 0.2316419 * F.abs(z))
    near = density * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))  # Zelen and Severo
    far = z
    for k in range(12, 0, -1):
        far = z + k / far
    return F.greatest(F.when(z < 0, 1 - near).when(z < 2.5, near).otherwise(density / far), F.lit(1e-300))


def encoding(token: Column) -> Column:
    body = F.regexp_replace(token, "=+$", "")
    has = lambda p: body.rlike(p)
    return F.when(has("^([0-9a-f]+|[0-9A-F]+)$") & has("[0-9]") & has("[A-Fa-f]"), "hex").when(has("^[A-Z2-7]+$") & has("[A-Z]") & has("[2-7]"), "base32").when(has("[A-Z]") & has("[a-z]") & has("[0-9]"), "base64")


def randomness(token: Column) -> Column:
    """struct<encoding, size, n, codes>: the encoding, its alphabet's size, the number of symbols, and each symbol's place in the alphabet."""
    kind = encoding(token)
    body = F.regexp_replace(token, "=+$", "")
    plain = F.when(kind == "hex", F.lower(body)).otherwise(F.translate(body, "-_", "+/"))
    alphabet = F.when(kind == "hex", ALPHABETS["hex"]).when(kind == "base32", ALPHABETS["base32"]).otherwise(ALPHABETS["base64"])

    def coded(x: Column) -> Column:
        codes = F.transform(F.split(x["plain"], ""), lambda c: F.call_function("locate", c, x["alphabet"]).cast("double") - 1)
        return F.struct(x["encoding"].alias("encoding"), F.length(x["alphabet"]).cast("double").alias("size"), F.length(x["plain"]).cast("double").alias("n"), codes.alias("codes"))

    return _bound(F.struct(kind.alias("encoding"), plain.alias("plain"), alphabet.alias("alphabet")), coded)


def _p_value(x: Column) -> Column:
    """Fisher's joined p-value of the three tests, of a struct that randomness() makes. One fold over the symbols takes all sums."""
    n, size, codes = x["n"], x["size"], x["codes"]
    zero = F.lit(0.0)
    squares = F.aggregate(F.transform(F.sequence(F.lit(0), size.cast("int") - 1), lambda k: F.size(F.filter(codes, lambda c: c == k)).cast("double")), zero, lambda a, c: a + c * c)

    def add(a: Column, c: Column) -> Column:
        high = F.when(c * 2 >= size, 1.0).otherwise(0.0)
        crossed = F.when((a["last"] >= 0) & (a["high"] != high), 1.0).otherwise(0.0)
        return F.struct(
            c.alias("last"), high.alias("high"), (a["n1"] + high).alias("n1"), (a["runs"] + crossed).alias("runs"), (a["sum"] + c).alias("sum"),
            (a["squares"] + c * c).alias("squares"), (a["products"] + F.when(a["last"] >= 0, a["last"] * c).otherwise(0.0)).alias("products"),
        )

    start = F.struct(F.lit(-1.0).alias("last"), *[zero.alias(k) for k in ("high", "n1", "runs", "sum", "squares", "products")])

    def joined(y: Column) -> Column:
        s = y["s"]
        df = size - 1
        chi = y["chi"] * size / n - n
        spread = 2 / (9 * df)
        p_chi = _upper_tail((F.pow(F.greatest(chi, zero) / df, F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread))
        n1 = s["n1"]
        expected = 2 * n1 * (n - n1) / n + 1
        variance = (expected - 1) * (expected - 2) / (n - 1)
        p_runs = F.when(variance > 0, F.least(2 * _upper_tail(F.abs(1 + s["runs"] - expected) / F.sqrt(variance)), F.lit(1.0))).otherwise(F.lit(1e-12))
        mean = s["sum"] / n
        total = s["squares"] - n * mean * mean
        cross = s["products"] - mean * (2 * s["sum"] - F.element_at(codes, 1) - s["last"]) + (n - 1) * mean * mean
        p_serial = F.when(total > 1e-9, F.least(2 * _upper_tail(F.abs(cross / total + 1 / n) * F.sqrt(n)), F.lit(1.0))).otherwise(F.lit(1e-12))
        return _bound(-(F.log(p_chi) + F.log(p_runs) + F.log(p_serial)), lambda half: F.exp(-half) * (1 + half + half * half / 2))

    return _bound(F.struct(squares.alias("chi"), F.aggregate(codes, start, add).alias("s")), joined)


def regularity(token: Column) -> Column:
    """The p-value of the hypothesis that the token is a regular one: Fisher's join of two upper tails, of the rareness of its letters (where the
    encoding has all letters) and of the number of changes between upper case, lower case, digits and signs."""
    rare = [-math.log2(f / 100) for f in LETTERS]
    mean = sum(f / 100 * w for f, w in zip(LETTERS, rare, strict=True))
    deviation = SPREAD * math.sqrt(sum(f / 100 * (w - mean) ** 2 for f, w in zip(LETTERS, rare, strict=True)))
    table = F.array(*map(F.lit, rare))

    def joined(x: Column) -> Column:
        n = F.length(x["body"]).cast("double")
        letters = F.lower(F.regexp_replace(x["body"], "[^A-Za-z]", ""))
        m = F.length(letters).cast("double")
        total = F.aggregate(F.split(letters, ""), F.lit(0.0), lambda a, c: a + F.coalesce(F.try_element_at(table, F.ascii(c) - 96), F.lit(0.0)))
        rate = F.when(x["encoding"] == "hex", CHANGES["hex"]).when(x["encoding"] == "base32", CHANGES["base32"]).otherwise(CHANGES["base64"])
        changes = F.length(F.regexp_replace(x["body"], "[A-Z]+|[a-z]+|[0-9]+|[+/_-]+", "x")) - 1
        by_letters = F.when((x["encoding"] == "hex") | (m == 0), 1.0).otherwise(_upper_tail((total - mean * m) / (deviation * F.sqrt(F.greatest(m, F.lit(1.0))))))
        by_changes = _upper_tail((changes - rate * (n - 1)) / F.sqrt(rate * (1 - rate) * (n - 1)))
        both = _bound(-(F.log(by_letters) + F.log(by_changes)), lambda half: F.exp(-half) * (1 + half))
        return F.when(x["encoding"] == "hex", by_changes).otherwise(both)

    return _bound(F.struct(encoding(token).alias("encoding"), F.regexp_replace(token, "=+$", "").alias("body")), joined)


def scan(docs: DataFrame, text: str = "text", false_discovery: float = FALSE_DISCOVERY) -> DataFrame:
    """Add spans: array<struct<start, kind, end>> sorted by start, then kind (a number, see KINDS); code points, end exclusive.

    A null text counts as empty and has none. The text column is not returned (spans are what the scan is for); extra columns pass, but
    for spans. Repeated rows each get their spans, and their tokens count each; an empty table stays empty.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    pick = lambda found, kind, keep: F.transform(F.filter(found, keep), lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))
    base = F.concat(pick(matches(t, ASSIGN, 2), 0, lambda m: F.length(m["value"]) >= 12), pick(matches(t, ACCESS), 1, lambda m: m["start"] >= 0), pick(matches(t, HEX), 2, lambda m: m["start"] >= 0))
    others = [c for c in docs.columns if c not in (text, "spans")]
    told = F.filter(matches(t, TOKEN), lambda m: encoding(m["text"]).isNotNull())
    found = docs.select(*others, base.alias("__base"), told.alias("__tokens"))
    tested = F.transform("__tokens", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), randomness(m["text"]).alias("x"), regularity(m["text"]).alias("p")))
    found = found.withColumn("__tested", tested)
    level = lambda p: F.least(F.floor(-F.log(F.greatest(p, F.lit(1e-300))) / BIN), F.lit(BINS)).cast("int")
    klass = lambda x: F.concat(x["encoding"], F.lit(":"), F.floor(F.log2(x["n"])).cast("string"))
    judged = F.transform("__tested", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), klass(m["x"]).alias("class"), level(m["p"]).alias("level"), (_p_value(m["x"]) >= LEAST_EVEN).alias("even")))
    found = materialize(found.withColumn("__judged", judged).drop("__tested", "__tokens"))
    cut = rejected_levels(found.select(F.explode("__judged").alias("j")).select("j.class", "j.level"), false_discovery)
    limits = F.create_map(*[F.lit(v) for kv in [("", BINS + 1), *cut.items()] for v in kv])
    random = F.transform(F.filter("__judged", lambda m: m["even"] & (m["level"] >= F.coalesce(F.try_element_at(limits, m["class"]), F.lit(BINS + 1)))), lambda m: F.struct(m["start"].alias("start"), F.lit(3).alias("kind"), m["end"].alias("end")))
    return found.select(*others, _outside(F.sort_array(F.concat("__base", random))).alias("spans"))


def rejected_levels(tests: DataFrame, false_discovery: float) -> dict[str, int]:
    """For each class, the least level (-ln p in steps of BIN) that the step-up procedure rejects; classes where it rejects none are left out.

    It works on counts by class and level, of which there are at most BINS + 1 a class; what reaches the driver is a number for each class.
    """
    counts = tests.groupBy("class", "level").agg(F.count("*").alias("c"))
    upto = W.partitionBy("class").orderBy(F.desc("level"))
    ranked = counts.select("class", "level", F.sum("c").over(upto).alias("at_least"), F.sum("c").over(W.partitionBy("class")).alias("all"))
    passed = ranked.filter(F.exp(-F.col("level") * BIN) * F.col("all") <= F.col("at_least") * false_discovery)
    return {r["class"]: r["level"] for r in passed.groupBy("class").agg(F.min("level").alias("level")).collect()}


def span_text(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    got = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    return got.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(span_text(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))

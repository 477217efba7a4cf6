"""Line dedup: exact set-similarity join of lines with prefix, positional and length filters.

A line's tokens are its distinct words (split at ASCII white space, A-Z in lower case). Lines are ordered by document key, then line
number, then token set. A line goes if an earlier line's token set has a Jaccard similarity of at least `similarity`; lines without tokens stay.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import materialize, read, release, slices, small, with_columns
from logloom.llm.words import Lines, by_group, mix

FREQUENCY_BITS = 23
PAGE_BITS = 13
HOT_TOKEN = 1_000  # lines; the pairs of a word on more lines are dealt out by salts
SMALL_BUCKET, TILE = 24, 128
HELD_ROWS, HELD_PAIRS = 100_000, 500_000
RANGE_ROWS, DEALT_ROWS = 200_000, 100_000  # entries of a range of buckets, and entries that a task deals out at a time
CLOSEST, CLOSEST_IF_SURE = 32, 4  # earlier lines that a line is compared with in a bucket at first; what these leave open is searched in full
WIDE = 48  # sets of so many words have sketches of two halves
BROADCAST_ROWS = 2_000_000
UNRESOLVED_BLOCK = 50_000
NULL_KEY = -(2**63)
_U = np.uint64


def _shares(similarity: float) -> tuple[int, int]:
    f = Fraction(similarity).limit_denominator(1000)
    return f.numerator, f.denominator


def overlap_needed(n1, n2, p: int, q: int):
    """Least number of common tokens of sets of n1 and n2 tokens with a Jaccard similarity of at least p/q."""
    return -(-p * (n1 + n2) // (p + q))


def prefix_length(n, p: int, q: int):
    """So many of a set's rarest tokens hold one of the rarest tokens of each similar set."""
    return n + p * -n // q + 1


def _batch(schema: pa.Schema, *arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)


# how common words are


def level_of(lines: np.ndarray) -> np.ndarray:
    """Numbers of lines on a logarithmic scale of 256 steps: 0, 1, then eight steps to each doubling. The same for every block of rows, so that all
    lines order their words alike."""
    n = np.maximum(lines.astype(np.float64), 1)
    return np.where(lines < 2, lines, np.minimum(2 + np.floor(8 * np.log2(n / 2 + (lines < 2))), 255)).astype(np.uint8)


def lines_at(level: np.ndarray) -> np.ndarray:
    """Least number of lines of a level."""
    return np.where(level < 2, level, 2.0 ** ((level.astype(np.float64) - 2) / 8 + 1))


_LINE = "h bigint, g bigint, key bigint, number int, th bigint, page int, places binary, counts binary"


def line_table(docs: DataFrame) -> DataFrame:
    """One pass over the texts (key, text, th): where each line with words stands (key, number, th) and its token set's 128-bit hash (h, g); and, in
    rows with a page, how many lines of a task hold a word of each of 2^FREQUENCY_BITS hash buckets (places within the page, counts)."""
    schema = pa.schema([("h", pa.int64()), ("g", pa.int64()), ("key", pa.int64()), ("number", pa.int32()), ("th", pa.int64()), ("page", pa.int32()), ("places", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        total = np.zeros(1 << FREQUENCY_BITS, np.uint32)
        for whole in batches:
            for rows in slices(whole):
                x = Lines(rows.column(1))
                np.add.at(total, (x.token >> _U(64 - FREQUENCY_BITS)).astype(np.int64), np.uint32(1))
                keys, th = (rows.column(i).take(pa.array(x.owner)) for i in (0, 2))
                h, g = x.identity()
                none = [pa.nulls(len(h), f.type) for f in list(schema)[5:]]
                yield _batch(schema, h.view(np.int64), g.view(np.int64), keys, x.number, th, *none)
        pages, places, counts = [], [], []
        for page, of in enumerate(total.reshape(-1, 1 << PAGE_BITS)):
            found = np.flatnonzero(of)
            if len(found):
                pages.append(page)
                places.append(found.astype(np.uint16).tobytes())
                counts.append(of[found].tobytes())
        none = [pa.nulls(len(pages), f.type) for f in list(schema)[:5]]
        yield _batch(schema, *none, pa.array(pages, pa.int32()), pa.array(places, pa.binary()), pa.array(counts, pa.binary()))

    return docs.select("key", "text", "th").mapInArrow(run, _LINE)


def word_levels(lines: DataFrame) -> np.ndarray:
    """The level of each hash bucket of words over all lines: one byte a bucket, whatever the input's size. A page's sums go past one row at a time."""

    def add(batches):
        page, total = None, np.zeros(1 << PAGE_BITS, np.uint64)
        full = lambda: pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), pa.array([level_of(total).tobytes()], pa.binary())], ["page", "levels"])
        for batch in batches:
            for p, places, counts in zip(*(batch.column(i) for i in range(3)), strict=True):
                if p.as_py() != page:
                    if page is not None:
                        yield full()
                    page, total = p.as_py(), np.zeros(1 << PAGE_BITS, np.uint64)
                total[np.frombuffer(places.as_buffer(), np.uint16)] += np.frombuffer(counts.as_buffer(), np.uint32)
        if page is not None:
            yield full()

    got = lines.filter("page is not null").select("page", "places", "counts").repartition("page").sortWithinPartitions("page").mapInArrow(add, "page int, levels binary").toArrow()
    table = np.zeros((1 << (FREQUENCY_BITS - PAGE_BITS), 1 << PAGE_BITS), np.uint8)
    for page, levels in zip(got["page"].to_pylist(), got["levels"].to_pylist(), strict=True):
        table[page] = np.frombuffer(levels, np.uint8)
    return table.ravel()


# the words by which similar lines meet


def in_order(x: Lines, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lines' words from the rarest to the commonest (ties by hash): word, level, place in the line."""
    level = levels[(x.token >> _U(64 - FREQUENCY_BITS)).astype(np.int64)]
    order = by_group(x.line, level, x.token)
    return x.token[order], level[order], np.arange(len(x.token)) - x.start[x.line]


_ENTRY = "range int, bucket array<bigint>, h array<bigint>, sketch array<bigint>, sketch2 array<bigint>, key array<bigint>, number array<int>, n array<int>, place array<int>"
_ENTRIES = pa.schema([("range", pa.int32())] + [(n, pa.list_(pa.int64())) for n in ("bucket", "h", "sketch", "sketch2", "key")] + [(n, pa.list_(pa.int32())) for n in ("number", "n", "place")])
_WORD = _U(2**64 - 2**16)


def ranges_for(levels: np.ndarray, parts: int, p: int, q: int) -> int:
    """Into how many ranges of buckets the prefixes are dealt, a multiple of parts: a range has about RANGE_ROWS entries, however many lines there are."""
    words = lines_at(np.arange(256)) @ sum(np.bincount(x, minlength=256) for x in np.array_split(levels, 64))
    return min(parts * max(1, math.ceil(words * (q - p) / q / RANGE_ROWS / parts)), 2**31 - 1)


def _dealt(held: list[tuple[np.ndarray, ...]], ranges: int) -> pa.RecordBatch:
    """Entries as one row for each range of buckets: ranges are in the order of buckets."""
    columns = [np.concatenate(c) for c in zip(*held, strict=True)]
    order = np.argsort(columns[0])
    columns = [c[order] for c in columns]
    of = ((columns[0] >> 32) + (1 << 31)) * ranges >> 32
    at = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    ends = pa.array(np.append(at, len(of)).astype(np.int32))
    return _batch(_ENTRIES, of[at].astype(np.int32), *(pa.ListArray.from_arrays(ends, pa.array(c, f.type.value_type)) for c, f in zip(columns, list(_ENTRIES)[1:], strict=True)))


def prefixes(docs: DataFrame, levels, ranges: int, p: int, q: int) -> DataFrame:
    """An entry for each word of a line's prefix, many to a row: those of one range of buckets. Words that no other line holds are left out. Of equal
    token sets in a block of rows the first one stands for all. A bucket is the word's first 48 bits; lines of a word on more than HOT_TOKEN lines are
    dealt to parts of it by h."""

    def run(batches):
        table = levels.value
        held, size = [], 0
        for whole in batches:
            for rows in slices(whole):
                x = Lines(rows.column(1))
                if not len(x.n):
                    continue
                keys = rows.column(0).fill_null(NULL_KEY).to_numpy(zero_copy_only=False)[x.owner]
                h, (sketch, sketch2) = x.identity()[0], x.sketch(WIDE)
                first = np.lexsort((x.number, keys, h))
                first = first[np.append(True, h[first][1:] != h[first][:-1])]
                chosen = np.zeros(len(h), bool)
                chosen[first] = True
                word, level, place = in_order(x, table)
                keep = (place < prefix_length(x.n, p, q)[x.line]) & (level > 1) & chosen[x.line]
                word, level, place, line = word[keep], level[keep], place[keep], x.line[keep]
                parts = np.minimum(np.ceil(lines_at(level) / HOT_TOKEN), 60_000).astype(np.uint64)
                part = np.where(parts > 1, h[line] % parts + _U(1), _U(0))
                held.append((((word & _WORD) | part).view(np.int64), h[line].view(np.int64), sketch[line].view(np.int64), sketch2[line].view(np.int64), keys[line], x.number[line].astype(np.int32), x.n[line].astype(np.int32), place.astype(np.int32)))
                size += len(line)
                if size >= DEALT_ROWS:
                    yield _dealt(held, ranges)
                    held, size = [], 0
        if size:
            yield _dealt(held, ranges)

    return docs.select("key", "text").mapInArrow(run, _ENTRY)


def _by_range(batches):
    """The entries of one range of buckets after the other, ordered by bucket, at most about HELD_ROWS at a time. The rows are ordered by range."""
    held: list[dict[str, np.ndarray]] = []
    last, most = None, 4 * RANGE_ROWS

    def done():
        c = {k: np.concatenate([x[k] for x in held]) for k in held[0]}
        o = np.argsort(c["bucket"])
        for i in range(0, len(o), HELD_ROWS):
            piece = _pick(c, o[i : i + HELD_ROWS])
            yield piece | {"n": piece["n"].astype(np.int64), "place": piece["place"].astype(np.int64), "number": piece["number"].astype(np.int64)}

    for batch in batches:
        of = batch.column(0).to_numpy()
        ends = batch.column(1).offsets.to_numpy()
        names = batch.schema.names[1:]
        values = [batch.column(i + 1).flatten().to_numpy(zero_copy_only=False) for i in range(len(names))]
        ends = ends - ends[0] if len(ends) else ends
        at = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.empty(0, np.int64)
        for i, j in zip(at.tolist(), np.append(at[1:], len(of)).tolist(), strict=True):
            if held and of[i] != last:
                yield from done()
                held = []
            last = of[i]
            held.append({k: v[ends[i] : ends[j]] for k, v in zip(names, values, strict=True)})
            if sum(len(x["h"]) for x in held) >= most:  # a range of many copies
                held = [_first_of_each({k: np.concatenate([x[k] for x in held]) for k in held[0]})]
                most = max(most, 2 * len(held[0]["h"]))
    if held:
        yield from done()


def _by_row(batches):
    for batch in batches:
        c = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
        sizes = c.pop("sizes")
        yield c | {"n": sizes >> 32, "place": sizes & 0xFFFFFFFF}


# what meets in a bucket


def _pick(c: dict[str, np.ndarray], o: np.ndarray) -> dict[str, np.ndarray]:
    return {k: v[o] for k, v in c.items()}


def _first_of_each(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Of the rows of a bucket with one token set, the earliest; the order of the rest stays."""
    same = mix(c["bucket"].view(np.uint64)) + c["h"].view(np.uint64)
    o = np.argsort(same)
    twice = np.flatnonzero(same[o][1:] == same[o][:-1])
    if not len(twice):
        return c
    rows = o[np.unique(np.concatenate([twice, twice + 1]))]
    rows = rows[np.lexsort((c["number"][rows], c["key"][rows], c["h"][rows], c["bucket"][rows]))]
    h, b = c["h"][rows], c["bucket"][rows]
    keep = np.ones(len(same), bool)
    keep[rows[1:][(h[1:] == h[:-1]) & (b[1:] == b[:-1])]] = False
    return _pick(c, keep)


def _in_turn(c: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(later, earlier) of each two rows: by key, number and h."""
    before, tied = np.zeros(len(x), bool), np.ones(len(x), bool)
    for k in ("key", "number", "h"):
        before |= tied & (c[k][x] < c[k][y])
        tied &= c[k][x] == c[k][y]
    return np.where(before, y, x), np.where(before, x, y)


def _distance(c, x, y, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """(how many bits the sketches differ in, how many words similar sets of these sizes may differ in); the first is over the second where a filter rules a pair out."""
    n1, n2 = c["n"][x], c["n"][y]
    need = overlap_needed(n1, n2, p, q)
    differ = n1 + n2 - 2 * need
    halves = np.bitwise_count(c["sketch"][x] ^ c["sketch"][y]) + np.bitwise_count(c["sketch2"][x] ^ c["sketch2"][y])
    folded = np.bitwise_count(c["sketch"][x] ^ c["sketch2"][x] ^ c["sketch"][y] ^ c["sketch2"][y])  # as a set of fewer words has it
    bits = np.where((n1 >= WIDE) & (n2 >= WIDE), halves, folded).astype(np.int64)
    fits = (p * np.maximum(n1, n2) <= q * np.minimum(n1, n2)) & (np.minimum(n1 - c["place"][x], n2 - c["place"][y]) >= need) & (differ > 0)
    return np.where(fits, bits, differ + 1), differ


def _closest(c, later, earlier, bits, differ, complete, most=None):
    """For each later line the closest earlier ones: as many as most, else CLOSEST, or CLOSEST_IF_SURE where one is so close that it hardly fails; complete turns false
    where there were more."""
    o = np.lexsort((earlier, bits, later))
    later, earlier, bits, differ, complete = later[o], earlier[o], bits[o], differ[o], complete[o]
    at = np.flatnonzero(np.append(True, later[1:] != later[:-1])) if len(later) else np.empty(0, np.int64)
    size = np.diff(np.append(at, len(later)))
    most = np.full(len(at), most) if most else np.where(2 * bits[at] <= differ[at], CLOSEST_IF_SURE, CLOSEST)
    complete = np.repeat(np.logical_and.reduceat(complete, at) & (size <= most), size) if len(at) else complete
    keep = np.arange(len(later)) - np.repeat(at, size) < np.repeat(most, size)
    return later[keep], earlier[keep], bits[keep], differ[keep], complete[keep]


def _joined(pieces: list[tuple]) -> tuple:
    return tuple(np.concatenate(z) for z in zip(*pieces, strict=True))


def _within(c: dict[str, np.ndarray], start: int, n: int, p: int, q: int):
    """Pieces of row pairs of one bucket whose sketches are close: rows are ordered by size, and tiles of them compared with those of fitting sizes."""
    rows = start + np.argsort(c["n"][start : start + n], kind="stable")
    size, sketch, sketch2 = c["n"][rows], c["sketch"][rows], c["sketch2"][rows]
    folded = sketch ^ sketch2
    ends = np.searchsorted(size, size * q // p, "right")
    for i in range(0, n, TILE):
        end = int(ends[min(i + TILE, n) - 1])
        a, b = slice(i, min(i + TILE, n)), slice(i, end)
        if size[i] >= WIDE:
            bits = np.bitwise_count(sketch[a, None] ^ sketch[None, b])  # at most 128 of 255
            bits += np.bitwise_count(sketch2[a, None] ^ sketch2[None, b])
        else:
            bits = np.bitwise_count(folded[a, None] ^ folded[None, b])
        most = int(size[a][-1] + size[end - 1])
        x, y = np.nonzero(bits <= most * (q - p) // (p + q))  # no two sets of the tile may differ in more words
        x, y = x[x < y], y[x < y]
        x, y = rows[i + x], rows[i + y]
        yield x, y


def _pairs(c: dict[str, np.ndarray], p: int, q: int, most: int | None = None):
    """Pieces of (later, earlier, bits, differ, complete) of row numbers of what passes the length, positional and sketch filters in each bucket; of
    later lines that are asked for, where a column asked says so. c is ordered by bucket."""
    b = c["bucket"]
    at = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else np.empty(0, np.int64)
    size = np.diff(np.append(at, len(b)))
    here, d, found, held = np.flatnonzero(np.repeat(size <= SMALL_BUCKET, size)), 1, [], 0
    folded = c["sketch"] ^ c["sketch2"]

    def passed(x, y):
        near = np.bitwise_count(folded[x] ^ folded[y]) <= (c["n"][x] + c["n"][y]) * (q - p) // (p + q)  # as _distance has it at most; few are left
        x, y = x[near], y[near]
        bits, differ = _distance(c, x, y, p, q)
        ok = bits <= differ
        later, earlier, bits, differ = *_in_turn(c, x[ok], y[ok]), bits[ok], differ[ok]
        if "asked" in c:
            ok = c["asked"][later]
            later, earlier, bits, differ = later[ok], earlier[ok], bits[ok], differ[ok]
        return later, earlier, bits, differ, np.ones(len(later), bool)

    while len(here):
        here = here[here + d < len(b)]
        here = here[b[here] == b[here + d]]
        found.append(passed(here + d, here))
        d += 1
    if found:
        yield _closest(c, *_joined(found), most)
    found = []
    for start, n in zip(at[size > SMALL_BUCKET].tolist(), size[size > SMALL_BUCKET].tolist(), strict=True):
        own, more = [], 0
        for x, y in _within(c, start, n, p, q):
            own.append(passed(x, y))
            more += len(own[-1][0])
            if more > HELD_PAIRS:
                own = [_closest(c, *_joined(own), most)]
                more = 0
        found += own
        held += more
        if held > HELD_PAIRS:
            yield _closest(c, *_joined(found), most)
            found, held = [], 0
    if found:
        yield _closest(c, *_joined(found), most)


_MET = "h bigint, key bigint, number bigint, h2 bigint, key2 bigint, number2 bigint, bits int, complete boolean, bucket bigint, sizes bigint"
_PAIRS = pa.schema([(n, pa.int64()) for n in ("h", "key", "number", "h2", "key2", "number2")] + [("bits", pa.int32()), ("complete", pa.bool_()), ("bucket", pa.int64()), ("sizes", pa.int64())])


def _parts(df: DataFrame) -> int:
    return 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the rows take several times their size while they meet


def meet(entries: DataFrame, p: int, q: int, parts_meet: bool = False, most: int | None = None) -> DataFrame:
    """Entries (of prefixes(), or with parts_meet of hot_entries()) of a bucket meet: (h, key, number) of a later line and (h2, key2, number2) of a close earlier one, how many bits of their sketches differ,
    and whether these are all of the bucket's that may be similar. Parts of a hot word only lose repeated token sets (unless parts_meet): they
    come out as they are (bits null, the sketches as h2 and key2), for hot_entries."""

    def run(batches):
        held: list[dict[str, np.ndarray]] = []

        def done(pieces):
            c = _first_of_each({k: np.concatenate([x[k] for x in pieces]) for k in pieces[0]})
            part = np.zeros(len(c["h"]), bool) if parts_meet else (c["bucket"] & 0xFFFF) > 0
            if part.any():
                a = _pick(c, np.flatnonzero(part))
                n = len(a["h"])
                yield _batch(_PAIRS, a["h"], a["key"], a["number"], a["sketch"].view(np.int64), a["sketch2"].view(np.int64), np.zeros(n, np.int64), pa.nulls(n, pa.int32()), pa.nulls(n, pa.bool_()), a["bucket"], a["n"] << 32 | a["place"])
                c = _pick(c, np.flatnonzero(~part))
            for x, y, bits, _, complete in _pairs(c, p, q, most):
                none = pa.nulls(len(x), pa.int64())
                yield _batch(_PAIRS, c["h"][x], c["key"][x], c["number"][x], c["h"][y], c["key"][y], c["number"][y], bits.astype(np.int32), complete, none, none)

        for c in (_by_row if parts_meet else _by_range)(batches):
            if not len(c["bucket"]):
                continue
            held.append(c | {"sketch": c["sketch"].view(np.uint64), "sketch2": c["sketch2"].view(np.uint64)})
            n = sum(len(x["h"]) for x in held)
            if n < HELD_ROWS:
                continue
            c = {k: np.concatenate([x[k] for x in held]) for k in c}
            cut = int(np.searchsorted(c["bucket"], c["bucket"][-1]))
            if cut:
                yield from done([_pick(c, slice(0, cut))])
            held = [_pick(c, slice(cut, None))]
            if len(held[0]["h"]) >= HELD_ROWS // 2:
                held = [_first_of_each(held[0])]
        if held:
            yield from done(held)
        release()

    if parts_meet:
        dealt = entries.repartition(_parts(entries), "bucket").sortWithinPartitions("bucket")
    else:
        dealt = entries.repartitionById(_parts(entries), "range").sortWithinPartitions("range")
    return dealt.mapInArrow(run, _MET)


def hot_entries(met: DataFrame) -> DataFrame | None:
    """The lines of hot words dealt out by how many token sets a word really has: one bucket for each two salts, so that every two lines meet in one. None without any."""
    hot = met.filter("bits is null").withColumn("word", F.col("bucket").bitwiseAND(F.lit(-(1 << 16))))
    if hot.isEmpty():
        return None
    count = hot.groupBy("word").agg(F.ceil(F.count("*") / HOT_TOKEN).cast("bigint").alias("salts"))
    if count.count() <= BROADCAST_ROWS:
        count = F.broadcast(count)
    own = F.pmod(F.xxhash64("h"), F.col("salts"))
    dealt = hot.join(count, "word").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    bucket = F.xxhash64("word", F.least("own", "other"), F.greatest("own", "other"))
    return dealt.select(bucket.alias("bucket"), "h", F.col("h2").alias("sketch"), F.col("key2").alias("sketch2"), "key", "number", "sizes")


def asked_entries(hot: DataFrame, lines: DataFrame) -> DataFrame:
    """The entries of hot_entries() in the buckets of the lines (h), which are marked as asked for."""
    of = small(lines.select("h").distinct())
    buckets = small(hot.join(of, "h", "left_semi").select("bucket").distinct())
    return hot.join(buckets, "bucket", "left_semi").join(of.withColumn("asked", F.lit(True)), "h", "left").withColumn("asked", F.col("asked").isNotNull())


# verification


def _lines_of(docs: DataFrame, wanted: DataFrame, columns: str, run) -> DataFrame:
    """run over batches of (text, key, wanted lines) of the documents that hold the lines (h, key, number, of, later)."""
    by_doc = wanted.groupBy("key").agg(F.collect_list(F.struct("number", "h", "of", "later")).alias("wanted"))
    if wanted.count() <= BROADCAST_ROWS:
        by_doc = F.broadcast(by_doc)
    return docs.select(F.coalesce("key", F.lit(NULL_KEY)).alias("key"), "text").join(by_doc, "key").select("text", "key", "wanted").mapInArrow(run, columns)


_TOKENS = "h bigint, key bigint, number bigint, of bigint, later bigint, tokens array<bigint>"


def tokens_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The lines (h, key, number, of, later) with tokens, their word hashes. A document of another text under the same key gives nothing."""
    schema = pa.schema([(n, pa.int64()) for n in ("h", "key", "number", "of", "later")] + [("tokens", pa.list_(pa.int64()))])

    def run(batches):
        for whole in batches:
            for rows in slices(whole):
                asked, lines = [], []
                for text, key, wanted in zip(rows.column(0), rows.column(1).to_pylist(), rows.column(2), strict=True):
                    own = (text.as_py() or "").split("\n")
                    for w in wanted.as_py():
                        if w["number"] < len(own):
                            asked.append((w["h"], key, w["number"], w["of"], w["later"]))
                            lines.append(own[w["number"]])
                x = Lines(pa.array(lines, pa.string()))
                asked = np.array(asked, np.int64).reshape(-1, 5)[x.owner]
                same = (asked[:, 0] == x.identity()[0].view(np.int64)) & (x.number == 0)
                lists = pa.ListArray.from_arrays(pa.array(np.append(x.start, len(x.token)).astype(np.int32)), pa.array(x.token.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(asked[:, i])) for i in range(5)), lists], schema=schema).filter(pa.array(same))

    return _lines_of(docs, wanted, _TOKENS, run)


def _alone(lines: DataFrame) -> DataFrame:
    return lines.withColumn("of", F.col("h")).withColumn("later", F.lit(0).cast("bigint"))


def verified(docs: DataFrame, pairs: DataFrame, p: int, q: int) -> DataFrame:
    """(h, key, number) of the later lines of the pairs that an earlier line is similar to, by their words. Each line's words are moved once: to its
    pair's earlier line, of which there may be many pairs."""
    later = pairs.select("h", "key", "number", F.col("h2").alias("of"), F.lit(1).cast("bigint").alias("later"))
    tokens = materialize(tokens_of(docs, materialize(later.unionByName(_alone(pairs.select(F.col("h2").alias("h"), F.col("key2").alias("key"), F.col("number2").alias("number")).distinct())))))
    other = tokens.filter("later = 0").select("of", F.col("tokens").alias("tokens2"))
    common = F.size(F.array_intersect("tokens", "tokens2"))
    both = tokens.filter("later = 1").join(other, "of")
    return materialize(both.filter(common * q >= (F.size("tokens") + F.size("tokens2") - common) * p).select("h", "key", "number").distinct())


def searched(docs: DataFrame, few: pa.Table, tokens: pa.Table, levels, p: int, q: int) -> DataFrame:
    """(h, key, number) of the few lines that any earlier line of all documents is similar to: every line meets the few by their prefixes and is
    compared at once."""
    words = {h: np.sort(t.values.to_numpy().view(np.uint64)) for h, t in zip(tokens["h"].to_pylist(), tokens["tokens"].combine_chunks(), strict=True)}
    own = [(k, n, h) for k, n, h in zip(few["key"].to_pylist(), few["number"].to_pylist(), few["h"].to_pylist(), strict=True) if h in words]
    shared = docs.sparkSession.sparkContext.broadcast((own, [words[o[2]] for o in own]))
    schema = pa.schema([("h", pa.int64()), ("key", pa.int64()), ("number", pa.int64())])

    def run(batches):
        own, sets = shared.value
        of: dict[int, list[int]] = {}
        for i, s in enumerate(sets):
            level = levels.value[(s >> _U(64 - FREQUENCY_BITS)).astype(np.int64)]
            for t in s[np.lexsort((s, level))][: prefix_length(len(s), p, q)].tolist():
                of.setdefault(t, []).append(i)
        known = np.array(sorted(of), np.uint64)
        marked = np.zeros(1 << FREQUENCY_BITS, bool)
        marked[(known >> _U(64 - FREQUENCY_BITS)).astype(np.int64)] = True
        hit: set[int] = set()
        for whole in batches:
            for rows in slices(whole):
                x = Lines(rows.column(1), lambda word: marked[(word >> _U(64 - FREQUENCY_BITS)).astype(np.int64)])
                keys = rows.column(0).fill_null(NULL_KEY).to_numpy(zero_copy_only=False)
                word, _, place = in_order(x, levels.value)
                at = np.flatnonzero((place < prefix_length(x.n, p, q)[x.line]) & np.isin(word, known))
                for line, t in {(int(x.line[k]), int(word[k])) for k in at}:
                    position = int(keys[x.owner[line]]), int(x.number[line])
                    mine = x.token[x.start[line] : x.start[line] + x.n[line]]
                    for i in of[t]:
                        s = sets[i]
                        if i not in hit and position < own[i][:2] and p * max(len(s), len(mine)) <= q * min(len(s), len(mine)):
                            common = len(np.intersect1d(s, mine, assume_unique=True))
                            if common < len(s) + len(mine) - common and common * q >= (len(s) + len(mine) - common) * p:
                                hit.add(i)
        rows = [own[i] for i in sorted(hit)]
        yield _batch(schema, [r[2] for r in rows], [r[0] for r in rows], [r[1] for r in rows])

    return docs.select("key", "text").mapInArrow(run, "h bigint, key bigint, number bigint").distinct()


def similar_later_lines(docs: DataFrame, lines: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(h, key, number): first lines of token sets that have an earlier, different but similar line. docs: key, text; lines: line_table(docs)."""
    spark = docs.sparkSession
    p, q = _shares(similarity)
    levels = spark.sparkContext.broadcast(word_levels(lines))
    ranges = ranges_for(levels.value, _parts(docs), p, q)
    met = materialize(meet(prefixes(docs, levels, ranges, p, q), p, q))
    pairs, hot = met.filter("bits is not null").withColumn("cold", F.lit(True)), hot_entries(met)
    if hot is not None:  # a line meets others of a hot word in as many buckets as there are salts: of each only the closest, at first
        pairs = pairs.unionByName(materialize(meet(hot, p, q, parts_meet=True, most=1)).withColumn("cold", F.lit(False)))
    best = F.min(F.struct("bits", "key2", "number2", "h2"))
    all_of = F.min("complete").alias("complete"), F.coalesce(F.min(F.when(F.col("cold"), F.col("complete"))), F.lit(True)).alias("cold_complete")
    first = pairs.groupBy("h", "key", "number").agg(best.alias("b"), *all_of)
    first = materialize(first.select("h", "key", "number", "b.h2", "b.key2", "b.number2", "complete", "cold_complete"))
    found = verified(docs, first, p, q)

    def tried_on(pairs: DataFrame, tried: DataFrame) -> None:
        nonlocal found
        rest = pairs.join(found.select("h"), "h", "left_anti").select("h", "key", "number", "h2", "key2", "number2").distinct()
        rest = materialize(rest.join(tried.select("h", "h2"), ["h", "h2"], "left_anti"))
        if not rest.isEmpty():
            found = found.unionByName(verified(docs, rest, p, q))

    tried_on(pairs, first)
    open_ = materialize(first.filter("not complete").select("h", "key", "number", "cold_complete").join(found.select("h"), "h", "left_anti"))
    if hot is not None and not open_.isEmpty():
        again = materialize(meet(asked_entries(hot, open_), p, q, parts_meet=True))
        tried_on(again, pairs)
        incomplete = again.filter("not complete").select("h").union(open_.filter("not cold_complete").select("h")).distinct()
        open_ = materialize(open_.join(incomplete, "h", "left_semi").join(found.select("h"), "h", "left_anti"))
    open_ = open_.select("h", "key", "number")
    for block in range(blocks := -(-open_.count() // UNRESOLVED_BLOCK)):  # lines of which the closest ones failed, but there are more
        few = materialize(open_.filter(F.pmod(F.xxhash64("h"), F.lit(blocks)) == block))
        words = tokens_of(docs, _alone(few)).select("h", "tokens")
        found = found.unionByName(materialize(searched(docs, few.toArrow(), words.toArrow(), levels, p, q)))
    return found


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = 0.8) -> DataFrame:
    """Each document with its text without the lines that match an earlier one, and n_lines and n_removed (bigint).

    key is an integer. Lines are parts between line feeds; what stays is joined by line feeds, byte for byte. A null text stays null and has
    no lines; an empty text has one line, which stays. Null keys come first. Rows that repeat key and text are one document and get
    one result. Extra columns pass, but for n_lines and n_removed; an empty table stays empty.
    """
    source = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("th"))
    table = materialize(line_table(source))
    lines = table.filter("page is null").select("h", "g", "key", "number", "th")
    similar = similar_later_lines(source.select("key", "text"), table, similarity).select("h", F.col("key").alias("k"), F.col("number").cast("int").alias("number"))
    place = F.coalesce("key", F.lit(NULL_KEY)).alias("k"), "number", "th"
    many = small(lines.groupBy("h", "g").agg(F.count("*").alias("rows")).filter("rows > 1").select("h", "g"))
    again = materialize(lines.join(many, ["h", "g"], "left_semi").select("h", "g", *place))
    first = again.groupBy("h", "g").agg(F.min(F.struct("k", "number", "th")).alias("first")).select("first.*")
    copies = again.select("k", "number", "th").join(small(first), ["k", "number", "th"], "left_anti")
    near = lines.select("h", *place).join(small(similar), ["h", "k", "number"], "left_semi").select("k", "number", "th")
    gone = materialize(copies.unionByName(near))
    by_doc = gone.groupBy(F.col("k").alias("__key"), F.col("th").alias("__th")).agg(F.collect_set("number").alias("__gone"))
    if gone.count() <= BROADCAST_ROWS:
        by_doc = F.broadcast(by_doc)
    joined = docs.join(by_doc, (F.coalesce(F.col(key).cast("bigint"), F.lit(NULL_KEY)) == F.col("__key")) & (F.xxhash64(text) == F.col("__th")), "left").drop("__key", "__th")

    def left(batch: pa.RecordBatch) -> list:
        own, without = (batch.column(batch.schema.get_field_index(c)) for c in (text, "__gone"))
        raw, some = own.cast(pa.binary()), without.is_valid()
        n_lines = pc.fill_null(pc.add(pc.count_substring(raw, b"\n"), 1), 0).cast(pa.int64())
        stay = []
        for t, numbers in zip(raw.filter(some), without.filter(some).to_pylist(), strict=True):
            numbers = set(numbers)
            stay.append(b"\n".join([x for i, x in enumerate(t.as_py().split(b"\n")) if i not in numbers]))
        made = pc.replace_with_mask(raw, some, pa.array(stay, pa.binary()))
        return [made.view(pa.string()), n_lines, pc.fill_null(pc.list_value_length(without), 0).cast(pa.int64())]

    name = "`" + text.replace("`", "``") + "`"
    got = with_columns(joined, f"{name} string, n_lines bigint, n_removed bigint", left, keep=[c for c in docs.columns if c != text])
    return got.select(*[f"`{c}`" for c in docs.columns if c not in ("n_lines", "n_removed")], "n_lines", "n_removed")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, how many went, and what stays."""
    got = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_lines", "n_removed", F.length("text").cast("bigint").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))

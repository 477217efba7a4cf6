"""Suffix-array dedup: remove every byte covered by a string of `length` bytes that also starts elsewhere.

1. Each window of `length` bytes is given to the least of its k-gram hashes (the rightmost of equal ones): an anchor. Windows that are equal
   have equal anchors at equal places, so only the contexts of equal anchors (their windows' bytes) need be compared.
2. Anchors are counted by hash. One that stands alone has no repeat. Equal contexts are repeats as a whole, and one stands for all.
3. Contexts that differ although their anchors are equal meet by hash. Suffix arrays are built over blocks of them by two-stage sorting, and
   adjacent common prefixes of at least `length` bytes mark windows that repeat.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import materialize, read, with_columns

GRAM = 32
SLICE = 1 << 21
_PLACE = (1 << 24) - 1
BLOCK_BYTES = 1 << 20
LARGE_GROUP = 4_000
BROADCAST_ROWS = 100_000
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, mod 2^64."""
    if not _POWERS:
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(SLICE + 65536, b, np.uint64)
            x[0] = 1
            _POWERS.append(np.multiply.accumulate(x))
    return _POWERS[0], _POWERS[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours."""
    have = 1
    while have < w:
        step = min(have, w - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def anchors(data: bytes, length: int) -> tuple[np.ndarray, ...]:
    """(hash, context hash, first window, last window) of each anchor of a text. Texts shorter than length have none."""
    up, down = _powers()
    out: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(data) - length + 1, SLICE):
        part = np.frombuffer(data[at : at + SLICE + length - 1], np.uint8)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=total[1:])
        gram = _mix((total[GRAM:] - total[:-GRAM]) * down[: len(part) - GRAM + 1])
        placed = (gram & ~np.uint64(_PLACE)) | (np.uint64(_PLACE) - np.arange(len(gram), dtype=np.uint64))
        place = _PLACE - (_least(placed, length - GRAM + 1) & np.uint64(_PLACE)).astype(np.int64)
        lo = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        hi = np.append(lo[1:] - 1, len(place) - 1)
        a = place[lo]
        context = _mix((total[hi + length] - total[lo]) * down[lo]) + _mix((a - lo).astype(np.uint64) << np.uint64(32) | (hi - lo).astype(np.uint64))
        out.append((gram[a], context, lo + at, hi + at))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))


def _heads(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros after the end."""
    padded = np.append(text, np.zeros(8, np.uint8))
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(text)]
    return out


def _sorted_suffixes(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their first depth bytes: by their first eight bytes at once, then those alike by the rest."""
    raw, head = text.tobytes(), _heads(text)[at]
    order = np.argsort(head, kind="stable")
    head, out = head[order], at[order].tolist()
    new = np.flatnonzero(np.append(True, head[1:] != head[:-1]))
    end = np.append(new[1:], len(head))
    for s, e in zip(new[end - new > 1].tolist(), end[end - new > 1].tolist(), strict=True):
        out[s:e] = sorted(out[s:e], key=lambda i: raw[i : i + depth])
    return np.array(out, np.int64)


def two_stage_suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first `depth` symbols at least.

    Only suffixes smaller than their successors are sorted directly. The others are induced: buckets of the first symbol are scanned in
    order, and each suffix found puts its predecessor, if that one is larger, next into its own bucket.
    """
    n = len(text)
    if not n:
        return np.empty(0, np.int64)
    step = np.append(np.sign(text[1:].astype(np.int16) - text[:-1].astype(np.int16)), -1)  # the last suffix is larger than the empty one
    at = np.where(step != 0, np.arange(n), n)
    small = step[np.minimum.accumulate(at[::-1])[::-1]] > 0  # equal symbols decide as the next different one does
    first = _sorted_suffixes(text, np.flatnonzero(small), depth)
    borders = np.searchsorted(text[first], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[n - 1]].append(np.array([n - 1]))
    out: list[np.ndarray] = []

    def induce(found: np.ndarray, symbol: int) -> np.ndarray:
        """Deal the predecessors that are larger to their buckets; those of the same bucket are returned."""
        before = found[found > 0] - 1
        before = before[~small[before]]
        of = text[before]
        for b in np.unique(of):
            if b != symbol:
                waiting[b].append(before[of == b])
        return before[of == symbol]

    for symbol in range(256):
        found = np.concatenate(waiting[symbol]) if waiting[symbol] else np.empty(0, np.int64)
        while len(found):
            out.append(found)
            found = induce(found, symbol)
        own = first[borders[symbol] : borders[symbol + 1]]
        out.append(own)
        induce(own, symbol)
    return np.concatenate(out)


def adjacent_common_prefix(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it in order, counted up to most; 0 for the first."""
    head = _heads(np.append(text, np.zeros(most, np.uint8)))
    common = np.zeros(len(order), np.int64)
    here = np.arange(1, len(order))
    for at in range(0, most, 8):
        differ = head[order[here] + at] ^ head[order[here - 1] + at]
        same = np.full(len(here), 8)
        for k in range(8):
            same -= differ >= np.uint64(1 << (8 * k))
        common[here] += same
        here = here[differ == 0]
    limit = len(text) - np.maximum(order, np.append(order[:1], order[:-1]))
    return np.minimum(np.minimum(common, most), limit)


def repeated_windows(contexts: list[bytes], windows: list[int], length: int) -> list[np.ndarray]:
    """For each context, which of its first windows[i] starts begin a string of length bytes that begins at another start too."""
    size = np.array([len(c) for c in contexts])
    start = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    text = np.frombuffer(b"".join(contexts), np.uint8)
    owner = np.repeat(np.arange(len(contexts)), size)
    offset = np.arange(len(text)) - start[owner]
    valid = offset < np.array(windows)[owner]  # such a window ends within its context
    order = two_stage_suffix_array(text, length)
    order_common = adjacent_common_prefix(text, order, length)
    group = np.cumsum(order_common < length)
    ok = valid[order]
    counts = np.bincount(group[ok], minlength=int(group[-1]) + 1 if len(group) else 1)
    hit = np.zeros(len(text), bool)
    hit[order[ok & (counts[group] >= 2)]] = True
    return [np.flatnonzero(hit[s : s + w]) for s, w in zip(start, windows, strict=True)]


def _spans(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by windows at these sorted starts."""
    if not len(starts):
        return starts, starts
    new = np.flatnonzero(np.append(True, starts[1:] > starts[:-1] + length))
    return starts[new], starts[np.append(new[1:] - 1, len(starts) - 1)] + length


_SPAN = "key bigint, th bigint, start bigint, end bigint"


def _occurrences(docs: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                data = (batch.column(1)[i].as_py() or "").encode("utf-8", "surrogatepass")
                if len(data) < length:
                    continue
                h, c, lo, hi = anchors(data, length)
                same = pa.array(np.full(len(h), i))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), batch.column(0).take(same), batch.column(2).take(same), pa.array(lo), pa.array((hi - lo + 1).astype(np.int32))], ["h", "context", "key", "th", "lo", "windows"])

    def gathered(batches):
        held: list[pa.RecordBatch] = []
        for b in run(batches):
            held.append(b)
            if len(held) == 2000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held = []
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return docs.select("key", "text", "th").mapInArrow(gathered, "h bigint, context bigint, key bigint, th bigint, lo bigint, windows int")


def _context_texts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted contexts."""
    by_doc = wanted.groupBy("key", "th").agg(F.collect_list(F.struct("h", "n", "lo", "windows")).alias("wanted"))
    if wanted.count() <= BROADCAST_ROWS:
        by_doc = F.broadcast(by_doc)
    by_doc = by_doc.withColumnsRenamed({"key": "k", "th": "t"})
    rows = docs.join(by_doc, F.col("key").eqNullSafe(F.col("k")) & (F.col("th") == F.col("t"))).select("text", "wanted", "key", "th")

    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(5)]
            of: list[int] = []
            for i, (text, wanted) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                data = text.encode("utf-8", "surrogatepass")
                for w in wanted:
                    of.append(i)
                    for c, v in zip(cols, (w["h"], w["n"], w["lo"], w["windows"], data[w["lo"] : w["lo"] + w["windows"] + length - 1]), strict=True):
                        c.append(v)
            at = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), batch.column(2).take(at), batch.column(3).take(at), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.binary())], ["h", "n", "key", "th", "lo", "windows", "bytes"])

    return rows.mapInArrow(run, "h bigint, n bigint, key bigint, th bigint, lo bigint, windows int, bytes binary")


def _by_suffix_arrays(texts: DataFrame, length: int) -> DataFrame:
    """Spans of the repeated windows of contexts that meet by anchor; groups up to LARGE_GROUP contexts."""

    def run(batches):
        held: list[tuple] = []
        size = 0

        def done(rows):
            out: list[list] = [[], [], [], []]
            found = repeated_windows([r[5] for r in rows], [r[4] for r in rows], length)
            for r, starts in zip(rows, found, strict=True):
                for s, e in zip(*(x.tolist() for x in _spans(starts, length)), strict=True):
                    for c, v in zip(out, (r[1], r[2], r[3] + s, r[3] + e), strict=True):
                        c.append(v)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["key", "th", "start", "end"])

        last = None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if size > BLOCK_BYTES and row[0] != last:
                    yield done(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
                last = row[0]
        if held:
            yield done(held)

    return texts.select("h", "key", "th", "lo", "windows", "bytes").repartition("h").sortWithinPartitions("h").mapInArrow(run, _SPAN)


def _by_windows(texts: DataFrame, length: int) -> DataFrame:
    """The same for large groups: their windows are counted one by one, so that no group meets in one task."""

    def run(batches):
        up, down = _powers()
        for batch in batches:
            for h, key, th, lo, windows, data in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                part = np.frombuffer(data, np.uint8)
                total = np.zeros(len(part) + 1, np.uint64)
                np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=total[1:])
                x = _mix((total[length:] - total[:-length]) * down[: len(part) - length + 1])[:windows]
                n = len(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, h)), pa.array(x.view(np.int64)), pa.array([key] * n, pa.int64()), pa.array(np.full(n, th)), pa.array(lo + np.arange(n))], ["h", "x", "key", "th", "start"])

    rows = texts.select("h", "key", "th", "lo", "windows", "bytes").mapInArrow(run, "h bigint, x bigint, key bigint, th bigint, start bigint")
    repeated = rows.groupBy("h", "x").agg(F.count("*").alias("c")).filter("c > 1")
    return rows.join(repeated, ["h", "x"]).select("key", "th", "start", (F.col("start") + length).alias("end"))


def repeated_spans(docs: DataFrame, length: int) -> DataFrame:
    """(key, th, start, end): byte spans, which may overlap, that together are the repeated bytes. docs: key, text, th (hash of the text)."""
    found = materialize(_occurrences(docs, length))
    shared = found.groupBy("h").agg(F.count("*").alias("n"), F.min("context").alias("least"), F.max("context").alias("most")).filter("n > 1")
    shared = materialize(found.join(shared, "h").select("h", "context", "key", "th", "lo", "windows", (F.col("least") == F.col("most")).alias("alike")))
    mixed = shared.filter("NOT alike")
    one = F.struct("key", "th", "lo", "windows")
    kinds = materialize(mixed.groupBy("h", "context").agg(F.count("*").alias("c"), F.min(one).alias("one")))
    whole = shared.filter("alike").select("key", "th", "lo", "windows").unionByName(mixed.join(kinds.filter("c > 1").select("h", "context"), ["h", "context"]).select("key", "th", "lo", "windows"))
    whole = whole.select("key", "th", F.col("lo").alias("start"), (F.col("lo") + F.col("windows") + (length - 1)).alias("end"))
    groups = kinds.groupBy("h").agg(F.count("*").alias("n"), F.min("c").alias("least")).filter("least = 1")
    wanted = kinds.join(groups.select("h", "n"), "h").select("h", "n", "one.*")
    texts = materialize(_context_texts(docs, wanted, length))
    part = _by_suffix_arrays(texts.filter(F.col("n") <= LARGE_GROUP), length).unionByName(_by_windows(texts.filter(F.col("n") > LARGE_GROUP), length))
    return whole.unionByName(part)


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = 200) -> DataFrame:
    """Add n_bytes (bigint), spans (array of byte spans removed, end exclusive, maximal) and kept (binary) to every document.

    key is an integer. Texts are taken as UTF-8, whole; null counts as empty; texts shorter than length keep all. Repeats are judged on the
    input. Rows that repeat key and text repeat each other. Extra columns pass, but for the three names; an empty table stays empty.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    source = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text).cast("string")).alias("th"))
    spans = repeated_spans(source, length).groupBy("key", "th").agg(F.collect_list(F.struct("start", "end")).alias("__spans"))
    spans = spans.withColumnsRenamed({"key": "__key", "th": "__th"})
    joined = docs.join(spans, F.col(key).cast("bigint").eqNullSafe(F.col("__key")) & (F.xxhash64(F.col(text).cast("string")) == F.col("__th")), "left")

    def run(batch: pa.RecordBatch) -> list:
        column = lambda n: batch.column(batch.schema.get_field_index(n))
        size, spans, kept = [], [], []
        for t, s in zip(column(text), column("__spans"), strict=True):
            data = (t.as_py() or "").encode("utf-8", "surrogatepass")
            size.append(len(data))
            if not s.is_valid:
                spans.append([])
                kept.append(data)
                continue
            edge = np.zeros(len(data) + 1, np.int32)
            own = s.values
            np.add.at(edge, own.field(0).to_numpy(), 1)
            np.add.at(edge, own.field(1).to_numpy(), -1)
            gone = np.cumsum(edge[:-1]) > 0
            turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
            spans.append([{"start": a, "end": b} for a, b in turn.reshape(-1, 2).tolist()])
            kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes())
        return [size, spans, kept]

    return with_columns(joined, "n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary", run).drop("__key", "__th", "__spans")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeats of 200 bytes leave of every document."""
    got = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return got.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

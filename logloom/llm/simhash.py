"""SimHash near-duplicates: deletion-variant signatures of fingerprint segments."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import materialize, read, small, with_columns
from logloom.llm.graph import connected_components, star_forest

_FIND = re.compile(rb"[^\x20\x09-\x0D]+").findall
BITS = 64
PAIRWISE = 64
_BLOCK = 2048


def simhash(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64; no words: 0."""
    words = _FIND(text.encode("utf-8", "surrogatepass").lower()) if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    digest, at, total = xxhash.xxh64_intdigest, 0, np.zeros(BITS, np.int64)
    while at < n:
        s, e = starts[at : min(n, at + 65536)].tolist(), last[at : min(n, at + 65536)].tolist()
        h = np.fromiter((digest(joined[i:j], seed) for i, j in zip(s, e)), ">u8", len(s))  # noqa: B905
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        at += len(s)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """Add fp, the fingerprint as a signed long. Null, empty and blank texts have fingerprint zero; fewer words than a shingle make one."""

    def run(batch: pa.RecordBatch) -> list:
        return [np.array([simhash(t.as_py(), shingle, seed) for t in batch.column(batch.schema.get_field_index(text))], np.uint64).view(np.int64)]

    return with_columns(docs, "fp bigint", run)


def segments(most: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the fewest segments of which one differs by at most one bit when most bits differ."""
    n = most // 2 + 1
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(cuts[i], cuts[i + 1] - cuts[i]) for i in range(n)]


def _variants(fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each fingerprint and bit: a key of the bit's number and its segment with that bit left out."""
    keys = []
    for low, width in segments(most):
        part = (fp >> np.uint64(low)) & np.uint64((1 << width) - 1)
        for bit in range(width):
            keys.append((np.uint64(low + bit) << np.uint64(56)) | (part & np.uint64(~(1 << bit) & ((1 << width) - 1))))
    return np.concatenate(keys), np.tile(fp, BITS)


def _links(fp: np.ndarray, group: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (as a forest that joins what they join) between fingerprints of one group; groups are runs of equal numbers."""
    at = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(at, len(group)))
    a, b = [], []
    small = np.repeat(size <= PAIRWISE, size)
    here, d = np.flatnonzero(small), 1
    while len(here):
        here = here[here + d < len(fp)]
        here = here[group[here] == group[here + d]]
        x, y = fp[here], fp[here + d]
        near = np.bitwise_count(x ^ y) <= most
        a.append(x[near])
        b.append(y[near])
        d += 1
    for s, n in zip(at[size > PAIRWISE], size[size > PAIRWISE], strict=True):
        for x, y in _large(fp[s : s + n], most):
            a.append(x)
            b.append(y)
    if not a:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return star_forest(np.concatenate(a), np.concatenate(b))


def _large(fp: np.ndarray, most: int):
    """Links that join all that a large group's links join: balls around pivots, then only pairs of balls that may still be joined."""
    rest, pivots, balls = fp, [], []
    while len(rest):
        near = np.bitwise_count(rest ^ rest[0]) <= most
        pivots.append(rest[0])
        balls.append(rest[near])
        if near.sum() > 1:
            yield rest[near][1:], np.full(near.sum() - 1, rest[0])
        rest = rest[~near]
    pivots = np.array(pivots, np.uint64)
    root = np.arange(len(pivots))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(pivots)):
        for j in i + 1 + np.flatnonzero(np.bitwise_count(pivots[i + 1 :] ^ pivots[i]) <= 3 * most):
            if find(i) == find(j):
                continue
            link = _first_link(balls[i], balls[j], most)
            if link:
                root[find(j)] = find(i)
                yield np.array([link[0]], np.uint64), np.array([link[1]], np.uint64)


def _first_link(x: np.ndarray, y: np.ndarray, most: int):
    for i in range(0, len(x), _BLOCK):
        for j in range(0, len(y), _BLOCK):
            near = np.argwhere(np.bitwise_count(x[i : i + _BLOCK, None] ^ y[None, j : j + _BLOCK]) <= most)
            if len(near):
                return x[i + near[0][0]], y[j + near[0][1]]
    return None


def fingerprint_components(fps: DataFrame, most: int = 4) -> DataFrame:
    """(node, root): fingerprints (column fp) that links of at most `most` differing bits join, over the distinct fingerprints.

    Each distinct fingerprint is indexed under 64 keys, one for each segment and left-out bit; equal keys meet by one shuffle and a sort,
    and are verified by their distance. Each run of rows emits a forest of its links, not all pairs; large groups are joined by pivots.
    What a task holds of a group is 8 bytes for each distinct fingerprint.
    """

    def spread(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for i in range(0, len(fp), 4096):
                keys, of = _variants(fp[i : i + 4096], most)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(of.view(np.int64))], ["key", "fp"])

    def meet(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def done(pieces):
            key, fp = (np.concatenate(x) for x in zip(*pieces, strict=True))
            a, b = _links(fp, key, most)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)

        for batch in batches:
            key, fp = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if cut:
                yield done([*held, (key[:cut], fp[:cut])])
                held = []
            elif held and len(key) and held[-1][0][-1] != key[0]:
                yield done(held)
                held = []
            held.append((key[cut:], fp[cut:]))
        if held:
            yield done(held)

    distinct = fps.select("fp").distinct()
    links = distinct.mapInArrow(spread, "key bigint, fp bigint").repartition("key").sortWithinPartitions("key").mapInArrow(meet, "a bigint, b bigint")
    return connected_components(links)


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 4, most: int = 4) -> DataFrame:
    """(key, fp, component_id) for every row: component_id is the smallest key that links of at most `most` bits reach.

    Copies share a fingerprint and are collapsed to it before any link is sought. Texts without words share fingerprint zero.
    Repeated rows stay; rows with a null key get the component's smallest key, null if it has none; an empty table gives no rows.
    """
    fps = materialize(with_fingerprint(docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")), "text", shingle).select("key", "fp"))
    return fps.join(small(_component_of(fps, most)), "fp").select(F.col("key").alias(key), "fp", "component_id")


def _component_of(fps: DataFrame, most: int) -> DataFrame:
    """(fp, component_id) of the distinct fingerprints of (key, fp)."""
    least = fps.groupBy("fp").agg(F.min("key").alias("low"))
    roots = materialize(least.join(fingerprint_components(fps, most).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    lows = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    return roots.select("fp", "root").join(small(lows), "root").select("fp", "component_id")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    got = near_duplicates(read(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

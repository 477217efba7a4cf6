"""Mixing sources to target weights by cube-method balanced sampling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import materialize, read, small
from logloom.operators.windows import number_rows

LANDING = 12  # documents of a group that are decided together at last
BLOCK = 1024  # documents whose flight is one task's step
LARGE = 1000
COPIES = 4096
_TINY = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: int = 3) -> DataFrame:
    """(source, source_size, n, target) from (source, source_size, n).

    Sources in order of code points, null last, take the weights in turn and share `share` of all sizes by them; a target stops at `most` times
    its source's size and the rest is shared again by weight. Each round of sharing is one sum over the sources; sources that stop stay stopped.
    """
    numbered = number_rows(sizes, F.col("source").isNull(), F.col("source"), name="position")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("position") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = materialize(numbered.select("source", "source_size", "n", weight.alias("weight")))
    whole = F.col("source_size").cast("decimal(38,0)")
    budget = share * int(rows.agg(F.sum(whole)).first()[0] or 0)
    level, stopped = None, F.lit(False)
    while True:
        taken, left = rows.agg(F.sum(F.when(stopped, whole)), F.sum(F.when(~stopped, F.col("weight")))).first()
        rest = budget - most * int(taken or 0)
        if not left or level == (rest, left):
            break
        level = (rest, left)
        stopped = F.col("weight") * F.lit(float(rest)) / F.lit(float(left)) > most * F.col("source_size")
    shared = F.col("weight") * F.lit(float(level[0])) / F.lit(float(level[1])) if level else F.lit(0.0)
    return rows.select("source", "source_size", "n", F.least(shared, F.lit(float(most)) * F.col("source_size")).alias("target"))


def flight(size: np.ndarray, p: np.ndarray, draws: np.ndarray, left: int = 2) -> np.ndarray:
    """Move inclusion probabilities until at most `left` (two or more) are neither 0 nor 1; sums of p and of p * size stay.

    Each step projects the largest undecided document's direction onto the null space of both constraints and goes along it, forth or back at
    random so that expectations stay, until a probability meets 0 or 1. So large documents are decided first, against many small ones, and
    what stays open is small. size must be descending.
    """
    p = np.where(p < _TINY, 0.0, np.where(p > 1 - _TINY, 1.0, p))
    open_ = np.flatnonzero((p > 0) & (p < 1))
    x = size.astype(np.float64) / max(1.0, float(size.max(initial=0)))
    for draw in draws:
        if len(open_) <= left:
            break
        s, q = x[open_], p[open_]
        centred = s - s.mean()
        spread = float(centred @ centred)
        u = -(centred * (centred[0] / spread) + 1 / len(s)) if spread > 1e-18 else np.full(len(s), -1 / len(s))
        u[0] += 1
        if abs(u[0]) < 1e-12:  # only this document can balance the others: take two others of one size, else leave it
            u = _three(s)
        u = u / np.abs(u).max()
        up, down = u > _TINY**2, u < -(_TINY**2)
        forth = min(((1 - q[up]) / u[up]).min(), (q[down] / -u[down]).min())
        back = min((q[up] / u[up]).min(), ((1 - q[down]) / -u[down]).min())
        q = q + (forth if draw * (forth + back) < back else -back) * u
        q = np.where(q < _TINY, 0.0, np.where(q > 1 - _TINY, 1.0, q))
        p[open_] = q
        open_ = open_[(q > 0) & (q < 1)]
    return p


def _three(s: np.ndarray) -> np.ndarray:
    """A direction that moves the last three documents only."""
    u = np.zeros(len(s))
    a, b, c = s[-3:]
    u[-3:] = (b - c, c - a, a - b) if max(abs(b - c), abs(c - a)) > 1e-12 else (1, -1, 0)
    return u


def land(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Decide the few open documents: of the ways whose number is within one of its expectation, that whose words come nearest to theirs."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if len(open_):
        ways = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
        words, documents = np.abs(ways @ size[open_] - p[open_] @ size[open_]), np.abs(ways.sum(axis=1) - p[open_].sum())
        p[open_] = ways[np.lexsort((documents, np.round(words, 6), documents > 1))[0]]
    return p


def _flight_of_block(seed: int, level: int):
    def fly(part: pa.Table) -> pa.Table:
        part = part.sort_by([("size", "descending"), ("order", "ascending"), ("key", "ascending"), ("copy", "ascending")])
        size, p, order = (part[c].to_numpy() for c in ("size", "p", "order"))
        rng = np.random.default_rng([seed, level, *np.array([order.min(), order.max(), part["block"][0].as_py()], np.int64).view(np.uint64).tolist()])
        last = part["blocks"][0].as_py() <= 1
        p = flight(size, p, rng.random(2 * len(size)), LANDING if last else 2)
        return part.set_column(part.schema.get_field_index("p"), "p", pa.array(land(size, p) if last else p))

    return fly


def balanced_sample(rows: DataFrame, seed: int = 13, block: int = BLOCK) -> DataFrame:
    """(group, n, key, size, copy, p): p is 1 for the rows drawn and 0 for the others.

    Rows (group, n: the group's rows, key, size, copy, p: inclusion probability) are dealt to blocks of about `block` rows by a hash, so that no
    group is one task's work. Each block flies by itself and leaves at most two rows open, which fly together with those of up to block / 4
    other blocks of their group in the next level; where a group has one block left, its last ones land. Sums over each group are kept all along
    but for the landing's. The draws are hashes of seed, group, level and block: they do not depend on partitions.
    """
    schema = rows.select("group", "n", "key", "size", "copy", "p").withColumns({"blocks": F.lit(0).cast("bigint"), "block": F.lit(0).cast("bigint"), "order": F.lit(0).cast("bigint")}).schema
    level, done = 0, None
    n_blocks = F.ceil(F.col("n") / block).cast("bigint")
    now = rows.withColumn("blocks", n_blocks).withColumn("order", F.xxhash64(F.lit(seed), "group", "key", "size", "copy")).withColumn("block", F.pmod("order", "blocks"))
    while True:
        flown = materialize(now.select(schema.fieldNames()).groupBy("group", "block").applyInArrow(_flight_of_block(seed, level), schema))
        is_open = (F.col("p") > 0) & (F.col("p") < 1)
        decided = flown.filter(~is_open)
        done = decided if done is None else done.unionByName(decided)
        now = flown.filter(is_open)
        if now.isEmpty():
            return done.drop("blocks", "block", "order")
        level += 1
        now = now.withColumn("block", F.floor(F.col("block") / (block // 4))).withColumn("blocks", F.ceil(F.col("blocks") / (block // 4)))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: int = 3, seed: int = 13, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """(key, source, size, source_size, target, times): how often the mix takes each document, so that each source's words come near its target.

    A document is taken target / source_size times, whole times at once and the rest by balanced_sample, over words and documents of the source.
    Documents of over 1 / LARGE of their source's words (fewer than LARGE) are decided first; by the words that they miss or pass, the
    probabilities of all others are shifted, so that a huge document does not part its source from the target.
    Null texts have size 0, null sources make a source of their own; rows that share key, source and size are told apart by a number only and
    each may be taken; sources of size 0 take nothing; an empty table gives no rows.
    """
    sized = materialize(docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), word_count(F.col(text).cast("string")).alias("size")))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = source_targets(sizes, weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    equal = sized.groupBy("source", "key", "size").count()
    told = equal.withColumn("from", F.explode(F.expr(f"sequence(0L, count - 1, {COPIES}L)"))).withColumn("copy", F.explode(F.expr(f"sequence(`from`, least(count - 1, `from` + {COPIES - 1}))")))
    group = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    named = small(targets.withColumn("group", group).withColumn("rate", rate).withColumn("times", F.floor("rate")))
    rows = told.withColumn("group", group).drop("source").join(named, "group")
    rows = materialize(rows.select("group", "n", "source_size", "key", "size", "copy", (F.col("rate") - F.col("times")).alias("p")))
    large = F.col("size") * LARGE > F.col("source_size")
    few = materialize(balanced_sample(rows.filter(large).withColumn("n", F.lit(1).cast("bigint")), seed))
    before = rows.filter(large).groupBy("group").agg(F.sum("size").alias("words"), F.sum(F.col("size") * F.col("p")).alias("expected"))
    missed = before.join(few.groupBy("group").agg(F.sum(F.col("size") * F.col("p")).alias("taken")), "group").select("group", "words", (F.col("expected") - F.col("taken")).alias("missed"))
    rest = rows.filter(~large).join(small(missed), "group", "left")
    shift = F.coalesce(F.try_divide("missed", F.col("source_size") - F.col("words")), F.lit(0.0))
    drawn = few.unionByName(balanced_sample(rest.withColumn("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p") + shift))), seed))
    took = drawn.join(named, "group")
    return took.select(F.col("key").alias(key), "source", "size", "source_size", "target", (F.col("times") + F.col("p")).cast("bigint").alias("times"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source."""
    return mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))

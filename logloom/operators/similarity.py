"""Similarity joins: token containment by rare prefixes, vectors over a cosine by cells, and first-come selection of unlike texts."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.sources.tables import stored

#: Words of masks, which are no tokens of a template.
PLACEHOLDERS = ("num", "ip", "ipport", "path", "regpath", "guid", "uuid", "hex", "sid", "hash", "trunc")
POSTINGS = 4096
RARE = 256
BLOCK_BYTES = 8 << 20
PIVOTS = 64


def template_tokens(text: Column) -> Column:
    """The sorted distinct tokens of a template: runs of letters and digits in lower case, without words of masks; null has none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(found, lambda t: ~t.isin(*PLACEHOLDERS))))


def _by_rarity(sets: DataFrame, frequency: DataFrame, key: str) -> DataFrame:
    """(key, tokens): the numbers of each set's tokens that have a frequency (t, df, number), rarest first."""
    rows = sets.select(key, F.explode("set").alias("t")).join(frequency, "t").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("df", "number"))).alias("r"))
    return rows.select(key, F.col("r.number").alias("tokens"))


def containment_candidates(queries: DataFrame, known: DataFrame, least_matched: int, least_score: float, postings: int = POSTINGS, most: int | None = None) -> DataFrame:
    """(qi, ki, n_known, token, qt, kt): pairs of a query set and a known set that share a token of both their prefixes; tokens are numbers.

    queries: (qi, set), known: (ki, set), or (ki, set, n_known) where a set is a part of n_known tokens. Tokens are ordered by rarity among known sets.
    A known set of n_known tokens of which m must match meets on all but its m - 1 commonest, a query on all but its least_matched - 1 commonest; a
    token that all texts hold is in no prefix. With `most`, sets meet on tokens of up to so many known sets only: pairs whose rarest shared token is
    commoner are left out. The postings of a token that many prefixes hold are dealt to salts on both sides, so that no task joins more than
    `postings` squared pairs.
    """
    frequency = known.select(F.explode("set").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    frequency = stored(frequency.withColumn("number", F.monotonically_increasing_id()))
    n = F.size("set")
    known = known if "n_known" in known.columns else known.withColumn("n_known", n)
    needed = F.greatest(F.lit(least_matched), F.ceil(F.col("n_known") * least_score - 1e-6))
    met = lambda kept: F.explode(F.slice("tokens", F.lit(1), kept.cast("int"))).alias("token")
    k = known.filter(n >= needed).join(_by_rarity(known, frequency, "ki"), "ki").select("ki", "n_known", F.col("tokens").alias("kt"), met(n - needed + 1))
    q = _by_rarity(queries, frequency, "qi").filter(F.size("tokens") >= least_matched)
    q = q.select("qi", F.col("tokens").alias("qt"), met(F.size("tokens") - least_matched + 1))
    if most is not None:
        rare = stored(frequency.filter(F.col("df") <= most).select(F.col("number").alias("token")))
        q, k = q.join(rare, "token"), k.join(rare, "token")
    salts = lambda side, name: side.groupBy("token").agg(F.ceil(F.count("*") / postings).cast("int").alias(name))
    dealt = stored(salts(q, "qs").join(salts(k, "ks"), "token"))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    q = q.join(dealt, "token").withColumn("a", F.pmod(F.xxhash64("qi"), F.col("qs")).cast("int")).withColumn("b", every(F.col("ks"))).drop("qs", "ks")
    k = k.join(dealt, "token").withColumn("b", F.pmod(F.xxhash64("ki"), F.col("ks")).cast("int")).withColumn("a", every(F.col("qs"))).drop("qs", "ks")
    return q.join(k, ["token", "a", "b"]).drop("a", "b")


def _best_match(queries: DataFrame, known: DataFrame, least_matched: int, least_score: float, postings: int, most: int | None = None) -> DataFrame:
    """(qi, b): the best known set of each query by matched, score, n_known, then least match. known: (ki, set, n_known, match)."""
    pairs = containment_candidates(queries, known.select("ki", "set", "n_known"), least_matched, least_score, postings, most).withColumn("both", F.array_intersect("qt", "kt"))
    matched, score = F.size("both").cast("bigint"), F.size("both") / F.col("n_known")
    pairs = pairs.filter(F.element_at("both", 1) == F.col("token")).select("qi", "ki", "n_known", matched.alias("matched"), score.alias("score"))
    got = pairs.filter((F.col("matched") >= least_matched) & (F.col("score") >= least_score)).join(known.select("ki", "match"), "ki")
    return got.groupBy("qi").agg(F.max(F.struct("matched", "score", "n_known", (-F.col("match")).alias("m"))).alias("b"))


def token_containment(queries: DataFrame, known: DataFrame, key: str, text: str, least_matched: int = 4, least_known: int = 5, least_query: int = 4, least_score: float = 0.65, postings: int = POSTINGS, rare: int = RARE) -> DataFrame:
    """For each query text the known text of which it holds most: (key, match, matched, score), score = matched / known tokens; best by matched,
    score, known size, then the least known key (a number). Texts of equal token sets are looked up once; pairs are counted where they first meet.

    A token of up to `rare` known sets is rare. Pairs that share one meet on it, at most `rare` for each token of a query. Other pairs share common
    tokens only: for these all known sets of one size and the same common tokens are one, that of the least key, and all queries of the same common
    tokens are one. Where such a pair shares a rare token after all it counts too few here, and the same pair counts in full above.
    """
    asked = queries.select(F.col(key).alias("__k"), template_tokens(F.col(text)).alias("set")).filter(F.size("set") >= least_query)
    q = stored(asked.select("set").distinct().withColumn("qi", F.monotonically_increasing_id()))
    k = known.select(F.col(key).alias("match"), template_tokens(F.col(text)).alias("set")).filter(F.size("set") >= least_known)
    k = stored(k.groupBy("set").agg(F.min("match").alias("match")).withColumn("ki", F.monotonically_increasing_id()).withColumn("n_known", F.size("set")))
    best = _best_match(q, k, least_matched, least_score, postings, rare)

    common = stored(k.select(F.explode("set").alias("t")).groupBy("t").count().filter(F.col("count") > rare).select("t"))
    part = lambda df, *also: df.select(*also, F.explode("set").alias("t")).join(common, "t").groupBy(*also).agg(F.sort_array(F.collect_list("t")).alias("set")).filter(F.size("set") >= least_matched)
    qp = stored(part(q, "qi"))
    qc = stored(qp.select("set").distinct().withColumn("ci", F.monotonically_increasing_id()))
    kc = stored(part(k, "ki", "n_known", "match").groupBy("set", "n_known").agg(F.min("match").alias("match")).withColumn("ki", F.monotonically_increasing_id()))
    of_part = _best_match(qc.select(F.col("ci").alias("qi"), "set"), kc, least_matched, least_score, postings)
    of_part = qp.join(qc, "set").join(of_part.withColumnRenamed("qi", "ci"), "ci").select("qi", "b")

    best = best.unionByName(of_part).groupBy("qi").agg(F.max("b").alias("b"))
    found = q.join(best, "qi").select("set", (-F.col("b.m")).alias("match"), F.col("b.matched").alias("matched"), F.round("b.score", 6).alias("score"))
    return asked.join(found, "set").select(F.col("__k").alias(key), "match", "matched", "score")


# vectors


def _unit(rows: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as unit rows."""
    flat = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
    x = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector, dim) of vectors that have a direction."""
    v = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    fits = "size(vector) > 0 AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(vector, x -> x <> 0)"
    return v.filter(fits).withColumn("dim", F.size("vector"))


def nearest_known(unseen: DataFrame, known: DataFrame, key: str, vector: str, least: float = 0.9, block_bytes: int = BLOCK_BYTES, pivots: int = PIVOTS) -> DataFrame:
    """For each unseen vector the first known one (by key) with a cosine above least: (key, match, cosine).

    Known vectors are dealt to cells, by the nearest of up to `pivots` of them, and each cell has a radius. By the triangle inequality of angles an
    unseen vector goes only to cells whose pivot is within the radius and the angle of `least`: nothing is lost, and cells that are too far away
    are left out. A cell's vectors and those that come to it are dealt to blocks of up to block_bytes, which meet in matrix products. Vectors
    that are null, empty, zero or hold nulls or non-finite numbers have no match; vectors of different length never match.
    """
    k, u = _usable(known, key, vector), _usable(unseen, key, vector)
    by_dim: dict[int, list] = {}
    for r in k.orderBy(F.xxhash64("key"), "key").limit(pivots).collect():
        by_dim.setdefault(r["dim"], []).append(r["vector"])
    centres = {d: _unit(pa.array(v, pa.list_(pa.float64()))) for d, v in by_dim.items()}
    kind = known.schema[key].dataType.simpleString()

    def angles(table: pa.RecordBatch | pa.Table):
        """For each length: the rows of it and their angles to its pivots (one at angle 0 where it has none)."""
        dims = table["dim"].to_numpy()
        for d in np.unique(dims).tolist():
            at = np.flatnonzero(dims == d)
            x = _unit(table["vector"].take(pa.array(at)))
            yield d, at, np.arccos(np.clip(x @ centres[d].T, -1, 1)) if d in centres else np.zeros((len(at), 1))

    def to_cell(batches):
        for batch in batches:
            if batch.num_rows:
                cell, angle = np.empty(batch.num_rows, np.int32), np.empty(batch.num_rows)
                for _, at, a in angles(batch):
                    cell[at], angle[at] = a.argmin(axis=1), a.min(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], [*batch.schema.names, "cell", "angle"])

    celled = stored(k.mapInArrow(to_cell, f"key {kind}, vector array<double>, dim int, cell int, angle double"))
    cells = {(r["dim"], r["cell"]): (r["radius"], -(-r["n"] * r["dim"] * 8 // block_bytes)) for r in celled.groupBy("dim", "cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect()}
    reach = math.acos(min(1.0, max(-1.0, least))) + 1e-7

    def visits(batches):
        for batch in batches:
            for d, at, a in angles(batch) if batch.num_rows else ():
                for c in range(a.shape[1]):
                    radius, n = cells.get((d, c), (None, 0))
                    if n:
                        rows = batch.take(pa.array(at[a[:, c] <= radius + reach]))
                        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(len(rows), c, np.int32))], [*batch.schema.names, "cell"])

    visiting = stored(u.mapInArrow(visits, f"key {unseen.schema[key].dataType.simpleString()}, vector array<double>, dim int, cell int"))
    come = visiting.groupBy("dim", "cell").agg(F.count("*").alias("n")).collect()
    blocks = known.sparkSession.createDataFrame([(r["dim"], r["cell"], cells[r["dim"], r["cell"]][1], -(-r["n"] * r["dim"] * 8 // block_bytes)) for r in come], "dim int, cell int, ks bigint, us bigint")
    blocks = F.broadcast(blocks)  # a row for each cell: up to `pivots`, and one for each other length
    own = lambda n: F.pmod(F.xxhash64("key"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    kb = celled.join(blocks, ["dim", "cell"]).select("key", "vector", "dim", "cell", own("ks").alias("kb"), every("us").alias("ub"))
    ub = visiting.join(blocks, ["dim", "cell"]).select("key", "vector", "dim", "cell", own("us").alias("ub"), every("ks").alias("kb"))

    def meet(known_rows: pa.Table, unseen_rows: pa.Table) -> pa.Table:
        known_rows = known_rows.sort_by("key") if known_rows.num_rows else known_rows
        rows, match, cosine = [], [], []
        if known_rows.num_rows and unseen_rows.num_rows:
            x, y = _unit(known_rows["vector"]), _unit(unseen_rows["vector"])
            step = max(1, block_bytes // (8 * len(x)))
            for i in range(0, len(y), step):
                c = y[i : i + step] @ x.T
                over = c > least
                first = over.argmax(axis=1)
                at = np.flatnonzero(over[np.arange(len(c)), first])
                rows.append(i + at)
                match.append(first[at])
                cosine.append(c[at, first[at]])
        pick = lambda a, t: pa.array(np.concatenate(a) if a else np.empty(0, t), pa.from_numpy_dtype(t))
        return pa.table({"key": unseen_rows["key"].take(pick(rows, np.int64)), "match": known_rows["key"].take(pick(match, np.int64)), "cosine": pick(cosine, np.float64)})

    group = ["dim", "cell", "kb", "ub"]
    near = kb.groupBy(*group).cogroup(ub.groupBy(*group)).applyInArrow(meet, f"key {unseen.schema[key].dataType.simpleString()}, match {kind}, cosine double")
    return near.groupBy("key").agg(F.min(F.struct("match", "cosine")).alias("m")).select(F.col("key").alias(key), "m.match", "m.cosine")


# first-come selection

_HEAD = 8192


def _prefix(n: int, similarity: float) -> int:
    """How many of the rarest of n words a set shares at least one of with each set of that similarity, under one order."""
    return n - math.ceil(similarity * n - 1e-9) + 1


def first_unlike(df: DataFrame, case: str, order: str, words: Column, kind: Column, similarity: float, text: str, head: int = _HEAD) -> DataFrame:
    """(case, order, text) of the rows that a walk through each case in order keeps: a row is left out if one kept before has its kind (null is none)
    or a word set of at least that Jaccard similarity (empty sets: only if both texts are equal but for case).

    Rows of equal words and kind are one from the start: only the first of them can be kept. The first `head` of each case are then decided in one
    group, what these keep removes later rows by joins on kinds and on rare words, and the next `head` follow, so that a group never holds more of a
    case however large it is. There are as many rounds as the case that keeps most needs.
    """
    rows = df.select(F.col(case).alias("case"), F.col(order).alias("o"), F.col(text).alias("t"), F.array_sort(words).alias("w"), kind.alias("k"))
    same = F.when(F.size("w") == 0, F.lower("t"))
    nodes = stored(rows.groupBy("case", "w", "k", same.alias("same")).agg(F.min(F.struct("o", "t")).alias("f")).select("case", "f.o", "f.t", "w", "k", "same"))
    frequency = nodes.select(F.explode("w").alias("x")).groupBy("x").agg(F.count("*").alias("df"))
    ranked = nodes.select("case", "o", "t", F.explode("w").alias("x")).join(frequency, "x").groupBy("case", "o", "t").agg(F.sort_array(F.collect_list(F.struct("df", "x"))).alias("r"))
    ranked = ranked.select("case", "o", "t", F.col("r.x").alias("ranked"))
    at = ["case", "o", "t"]
    equal = lambda a, b: F.expr(" AND ".join(f"{a}.{c} <=> {b}.{c}" for c in at))
    rest = nodes.alias("n").join(ranked.alias("r"), equal("n", "r"), "left").select("n.*", F.coalesce("ranked", F.array().cast("array<string>")).alias("ranked"))
    rest = stored(rest.select(*at, "k", "ranked"))

    def decide(group: pa.Table) -> pa.Table:
        group = group.sort_by([("o", "ascending"), ("t", "ascending")])
        kinds, found, kept, sets = set(), {}, [], []
        for i, (k, tokens) in enumerate(zip(group["k"].to_pylist(), group["ranked"].to_pylist(), strict=True)):
            if k is not None and k in kinds:
                continue
            own, first = set(tokens), tokens[: _prefix(len(tokens), similarity)] if tokens else []
            near = {j for t in first for j in found.get(t, ())}
            if any(len(own & sets[j]) >= similarity * len(own | sets[j]) for j in near):
                continue
            for t in first:
                found.setdefault(t, []).append(len(sets))
            sets.append(own)
            kept.append(i)
            if k is not None:
                kinds.add(k)
        return group.take(pa.array(kept, pa.int64()))

    done = None
    while True:
        first = rest.withColumn("n", F.row_number().over(W.partitionBy("case").orderBy("o", "t"))).filter(F.col("n") <= head).drop("n")
        kept = stored(first.groupBy("case").applyInArrow(decide, rest.schema))
        done = kept if done is None else done.unionByName(kept)
        more = rest.groupBy("case").count().filter(F.col("count") > head)
        if more.isEmpty():
            return done.select(F.col("case").alias(case), F.col("o").alias(order), F.col("t").alias(text))
        last = first.groupBy("case").agg(F.max(F.struct("o", "t")).alias("last")).alias("n").join(more.alias("r"), F.expr("n.case <=> r.case"), "left_semi")
        tail = rest.join(last.withColumnRenamed("case", "__c"), F.col("case").eqNullSafe(F.col("__c"))).filter(F.struct("o", "t") > F.col("last")).drop("__c", "last")
        tail = tail.alias("n").join(kept.select("case", "k").distinct().alias("r"), F.expr("n.case <=> r.case AND n.k = r.k"), "left_anti")
        n = F.size("ranked")
        of = lambda d: d.filter(n > 0).select(*at, "ranked", F.explode(F.slice("ranked", F.lit(1), (n - F.ceil(similarity * n - 1e-9) + 1).cast("int"))).alias("x"))
        close = F.expr(f"size(array_intersect(n.ranked, r.ranked)) >= {similarity!r}D * size(array_union(n.ranked, r.ranked))")
        hit = of(tail).alias("n").join(of(kept).alias("r"), F.expr("n.case <=> r.case AND n.x = r.x") & close, "left_semi").select(*at).distinct()
        rest = stored(tail.alias("n").join(hit.alias("r"), equal("n", "r"), "left_anti"))

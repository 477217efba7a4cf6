"""Approximate nearest neighbours: balanced posting lists around centroids that an in-memory graph finds.

Lists that follow each other are put together to shards, and a query goes to a shard once, with the lists that it visits there: so that what is moved
for a query grows with the shards, not with the lists. In a shard, lists meet their queries in matrix products.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from logloom.llm.common import bounded_sample, materialize, read

SAMPLE_BYTES = 64 << 20
SHARD_ROWS, QUERY_BLOCK = 16_384, 16_384
DEGREE = 16  # links of a centroid
TILE = 1024  # queries of a matrix product


def usable(vector: str) -> Column:
    """The vector has components, none null, NaN or infinite, and is not zero."""
    v = F.col(vector)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(F.size(v) > 0, F.lit(False)) & F.coalesce(sound, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def balanced_centroids(x: np.ndarray, lists: int, seed: int = 5) -> np.ndarray:
    """Centroids of about `lists` parts of equal size: two means at a time, cut at the median of the difference of distances."""
    draw, parts = np.random.default_rng(seed), [np.arange(len(x))]
    while len(parts) < lists:
        nxt = []
        for part in parts:
            if len(part) < 2:
                nxt.append(part)
                continue
            p = x[part]
            a, b = p[draw.choice(len(p), 2, replace=False)]
            for _ in range(6):
                gap = ((p - a) ** 2).sum(1) - ((p - b) ** 2).sum(1)
                order = np.argsort(gap, kind="stable")
                a, b = p[order[: len(p) // 2]].mean(0), p[order[len(p) // 2 :]].mean(0)
            nxt += [part[order[: len(p) // 2]], part[order[len(p) // 2 :]]]
        if len(nxt) == len(parts):
            break
        parts = nxt
    return np.array([x[p].mean(0) for p in parts])


@dataclass
class CentroidGraph:
    """Centroids, each linked to its nearest ones (and they to it, as far as nearer ones leave room) and to the next in order, so that all can be reached."""

    centroids: np.ndarray
    neighbours: np.ndarray
    entries: np.ndarray

    @classmethod
    def build(cls, centroids: np.ndarray, degree: int = DEGREE, entries: int = 8) -> CentroidGraph:
        n = len(centroids)
        most = min(degree, n - 1)
        links: list[list[tuple[float, int]]] = [[] for _ in range(n)]
        for at in range(0, n if most else 0, 512):
            d = _distances(centroids[at : at + 512], centroids)
            d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
            near = np.argpartition(d, most - 1, axis=1)[:, :most]
            for i, (to, far) in enumerate(zip(near.tolist(), np.take_along_axis(d, near, 1).tolist(), strict=True), at):
                for j, gap in zip(to, far, strict=True):
                    links[i].append((gap, j))
                    links[j].append((gap, i))
        table = np.full((n, min(n, 2 * degree + 2)), -1, np.int32)
        for i, of in enumerate(links):  # a centroid that is near to many keeps the nearest links
            own = list(dict.fromkeys(x for x in [(i + 1) % n, (i - 1) % n, *(j for _, j in sorted(of))] if x != i))[: table.shape[1]]
            table[i, : len(own)] = own
        return cls(centroids, table, np.unique(np.linspace(0, n - 1, entries).astype(int)))

    def all_at_once(self, beam: int) -> bool:
        """A walk with this beam would meet about as many centroids as there are."""
        return beam * self.neighbours.shape[1] >= len(self.centroids)

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, distances) of the nearest centroids of each vector, nearest first: best-first search with a beam, all vectors in step. Where the
        walk would meet all centroids, these are taken in one product."""
        n, rows = len(self.centroids), np.arange(len(x))
        beam = min(beam, n)
        if self.all_at_once(beam):
            d = _distances(x, self.centroids)
            i = np.argpartition(d, beam - 1, axis=1)[:, :beam]
            order = np.lexsort((i, d := np.take_along_axis(d, i, 1)), axis=1)
            return np.take_along_axis(i, order, 1), np.take_along_axis(d, order, 1)
        square, own = (self.centroids**2).sum(1), (x**2).sum(1)
        seen = np.zeros((len(x), n + 1), bool)
        seen[:, n] = True
        best_i = np.full((len(x), beam), n)
        best_d = np.full((len(x), beam), np.inf)
        expanded = np.zeros((len(x), beam), bool)
        fresh = np.broadcast_to(self.entries, (len(x), len(self.entries))).copy()
        active = rows
        while len(active):
            fresh = np.where(fresh < 0, n, fresh)
            fresh = np.where(np.take_along_axis(seen[active], fresh, 1), n, fresh)
            np.put_along_axis(block := seen[active], fresh, True, 1)
            seen[active] = block
            at = np.minimum(fresh, n - 1)
            d = square[at] + own[active][:, None] - 2 * np.matmul(self.centroids[at], x[active][:, :, None])[:, :, 0]
            d = np.where(fresh == n, np.inf, np.sqrt(np.maximum(d, 0)))
            all_i, all_d = np.concatenate([best_i[active], fresh], 1), np.concatenate([best_d[active], d], 1)
            all_e = np.concatenate([expanded[active], np.zeros(fresh.shape, bool)], 1)
            order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            best_i[active], best_d[active], all_e = np.take_along_axis(all_i, order, 1), np.take_along_axis(all_d, order, 1), np.take_along_axis(all_e, order, 1)
            todo = ~all_e & np.isfinite(best_d[active])
            at = todo.argmax(1)
            more = todo.any(1)
            all_e[np.flatnonzero(more), at[more]] = True
            expanded[active] = all_e
            nxt = best_i[active][np.flatnonzero(more), at[more]]
            active = active[more]
            fresh = self.neighbours[nxt].astype(np.int64)
        return best_i, best_d


@dataclass
class Index:
    """How vectors are dealt to lists and which lists a query visits: the graph, the dimension, and limits that fit() measures.

    spread: a vector also goes to lists at most so much farther than its nearest (`copies` lists at most); ratio: a query visits lists at most
    so much farther than its nearest, of the `beam` nearest that the graph finds.
    """

    graph: CentroidGraph
    dimension: int
    spread: float
    copies: int
    ratio: float = 0.0
    beam: int = 64

    def lists_of(self, x: np.ndarray) -> list[list[int]]:
        """Lists of each vector: the nearest, and others of nearly its distance."""
        return self._within(x, 2 * self.copies + 8, self.spread, self.copies)

    def visited(self, x: np.ndarray) -> np.ndarray:
        """Lists that a query visits: a row for each query, a column for each list."""
        n = len(self.graph.centroids)
        if not self.graph.all_at_once(self.beam):
            out = np.zeros((len(x), n), bool)
            for row, own in zip(out, self._within(x, self.beam, self.ratio, self.beam), strict=True):
                row[own] = True
            return out
        d = _distances(x, self.graph.centroids)
        out = d <= (1 + self.ratio) * d.min(1, keepdims=True)
        many = np.flatnonzero(out.sum(1) > self.beam)
        if len(many):
            out[many] = False
            out[many[:, None], np.argpartition(d[many], self.beam - 1, axis=1)[:, : self.beam]] = True
        return out

    def _within(self, x: np.ndarray, beam: int, share: float, most: int) -> list[list[int]]:
        out = []
        for at in range(0, len(x), 512):
            number, distance = self.graph.search(x[at : at + 512], beam)
            out += [i[: max(1, min(most, int((d <= (1 + share) * d[0]).sum())))].tolist() for i, d in zip(number, distance, strict=True)]
        return out


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * (x @ y.T), 0))


def calibrate(index: Index, x: np.ndarray, boundary: float, recall: float, queries: int, near: int = 10) -> None:
    """Set the limits by sample vectors: so that a share `boundary` of them lies in more lists than one, and a share `recall` of the nearest others of
    `queries` of them lies in a list that is visited (exact distances; in the sample neighbours are farther than in the table, so that this errs
    on the side of visiting)."""
    c = index.graph.centroids
    if len(c) < 2 or len(x) <= near:
        return
    few = x[np.linspace(0, len(x) - 1, min(len(x), 2_000)).astype(int)]
    two = np.partition(_distances(few, c), 1, axis=1)[:, :2]
    index.spread = float(np.quantile(two[:, 1] / np.maximum(two[:, 0], 1e-300) - 1, boundary))
    asked = np.unique(np.linspace(0, len(x) - 1, min(len(x), queries)).astype(int))
    d = _distances(x[asked], x)
    d[np.arange(len(asked)), asked] = np.inf
    nearest = np.argpartition(d, near, axis=1)[:, :near]
    to_list = _distances(x[asked], c)
    first = to_list.min(1)
    lists = index.lists_of(x[np.unique(nearest)])
    of = dict(zip(np.unique(nearest).tolist(), lists, strict=True))
    need = [min(to_list[i][of[n]]) / max(first[i], 1e-300) - 1 for i, row in enumerate(nearest.tolist()) for n in row]
    index.ratio = float(np.quantile(need, recall))
    within = (to_list <= (1 + index.ratio) * first[:, None]).sum(1)
    index.beam = int(min(len(c), max(64, 1.25 * np.quantile(within, 0.99))))


def fit(vectors: DataFrame, rows: int, list_size: int = 256, max_sample: int = 20_000, boundary: float = 0.25, recall: float = 0.97, copies: int = 4, queries: int = 256) -> Index | None:
    """Fit centroids and limits to a bounded sample, chosen by a hash: about max_sample vectors, or 16 for each list where that is more, fewer
    where they would take over SAMPLE_BYTES.

    rows is the table's count: one list for each list_size rows, one for each eight sample vectors at most (8,192 lists of 64 doubles). Vectors
    of another dimension than most take no part.
    """
    dims = vectors.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if dims is None:
        return None
    wanted = max(1, rows // list_size)
    few = bounded_sample(vectors.filter(F.size("v") == dims["n"]), F.col("id"), max(64, min(max(max_sample, 16 * wanted), SAMPLE_BYTES // (8 * dims["n"]))), 5)
    x = np.array(few.select("v").toArrow().to_pandas()["v"].tolist(), np.float64).reshape(-1, dims["n"])
    x = np.unique(x, axis=0)
    index = Index(CentroidGraph.build(balanced_centroids(x, min(wanted, max(1, len(x) // 8)))), dims["n"], 0.0, copies)
    calibrate(index, x[np.random.default_rng(5).permutation(len(x))], boundary, recall, queries)
    return index


def _matrix(column, dimension: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def _deal(vectors: DataFrame, index: Index) -> DataFrame:
    """One row (list, id, v) for each list of a vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(index)
    kind = vectors.schema["v"].dataType

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                lists = shared.value.lists_of(_matrix(part.column(1), shared.value.dimension))
                of = pa.array(np.repeat(np.arange(part.num_rows), [len(x) for x in lists]))
                yield pa.RecordBatch.from_arrays([pa.array(np.fromiter((y for x in lists for y in x), np.int32)), part.column(0).take(of), part.column(1).take(of)], ["list", "id", "v"])

    schema = T.StructType([T.StructField("list", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("v", kind)])
    return vectors.filter(F.size("v") == index.dimension).select("id", "v").mapInArrow(run, schema)


@dataclass
class Shards:
    """The lists from first[i] to before first[i + 1] are shard i's; a list of more than a shard's rows has pieces[list] shards, its vectors dealt to them by hash."""

    first: np.ndarray
    of: np.ndarray
    pieces: np.ndarray

    @classmethod
    def of_sizes(cls, sizes: np.ndarray, rows: int) -> Shards:
        """Shards of about so many rows; sizes are those of the lists."""
        pieces = np.maximum(1, -(-sizes // rows))
        first, of, held = [], np.zeros(len(sizes), np.int64), 0
        for i, (n, p) in enumerate(zip(sizes.tolist(), pieces.tolist(), strict=True)):
            if not first or p > 1 or held + n > rows:
                of[i], held = len(first), n
                first += [i] * p
            else:
                of[i], held = of[i - 1], held + n
            if p > 1:
                held = rows  # nothing joins it
        return cls(np.array(first), of, pieces)

    def visits(self, visited: np.ndarray):
        """For each shard that has a list of these (a row for each query, a column for each list): its number, the rows that visit it and, packed to bits,
        which of its lists they visit."""
        n = len(self.first)
        for i in np.unique(self.of).tolist():
            at = int(self.first[i])
            end = at + 1 if self.pieces[at] > 1 else int(self.first[i + 1]) if i + 1 < n else len(self.of)
            rows = np.flatnonzero(visited[:, at:end].any(1))
            if len(rows):
                bits = np.packbits(visited[rows, at:end], axis=1)
                for piece in range(int(self.pieces[at])):
                    yield i + piece, rows, bits


def _visits(queries: DataFrame, index: Index, shards: Shards, everywhere: bool) -> DataFrame:
    """One row (shard, first, visits, id, v) for each shard that a query visits: of the lists from the shard's first on, visits holds a bit for each."""
    shared = queries.sparkSession.sparkContext.broadcast((index, shards))
    kind = queries.schema["v"].dataType

    def run(batches):
        index, shards = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                visited = np.ones((part.num_rows, len(shards.of)), bool) if everywhere else index.visited(_matrix(part.column(1), index.dimension))
                for shard, rows, bits in shards.visits(visited):
                    of = pa.array(rows)
                    columns = [pa.array(np.full(len(rows), x, np.int32)) for x in (shard, shards.first[shard])]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([b.tobytes() for b in bits], pa.binary()), part.column(0).take(of), part.column(1).take(of)], ["shard", "first", "visits", "id", "v"])

    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("first", T.IntegerType()), T.StructField("visits", T.BinaryType()), T.StructField("id", T.LongType()), T.StructField("v", kind)])
    return queries.filter(F.size("v") == index.dimension).select("id", "v").mapInArrow(run, schema)


def _without_copies(lists: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> np.ndarray:
    """Rows of a shard by list, but of the same vector in a list those of the k + 1 smallest keys only: no query's k nearest hold others."""
    odd = np.random.default_rng(5).integers(0, 2**63, v.shape[1], np.uint64) * np.uint64(2) + np.uint64(1)
    h = ((v + 0.0).view(np.uint64) * odd).sum(1, dtype=np.uint64)  # + 0.0: no negative zero
    o = np.lexsort((ids, h ^ (h >> np.uint64(32)), lists))
    same = np.zeros(len(o), bool)
    same[1:] = (lists[o][1:] == lists[o][:-1]) & (h[o][1:] == h[o][:-1])
    same[same] = (v[o[same]] == v[o[np.flatnonzero(same) - 1]]).all(1)
    again = same.copy()
    again[1:] &= ids[o][1:] == ids[o][:-1]
    o, same = o[~again], same[~again]
    starts = np.flatnonzero(~same)
    rank = np.arange(len(o)) - np.repeat(starts, np.diff(np.append(starts, len(o))))
    return o[rank <= k]


def nearest_in_lists(qi: np.ndarray, qv: np.ndarray, visits: np.ndarray, lists: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a query, id, distance) of the k nearest ids, other than its own, in the lists that each query visits: visits has a row for each query and a column for each
    list. Lists meet tiles of their queries in matrix products; what passes a query's bound, its k-th nearest so far, is measured exactly at the end."""
    o = _without_copies(lists, ids, v, k)
    lists, ids, v = lists[o], ids[o], v[o]
    known, code = np.unique(ids, return_inverse=True)
    right = np.concatenate([-2 * v.T, (v**2).sum(1)[None, :]])
    left = np.concatenate([qv, np.ones((len(qv), 1))], 1)
    norm, bound = (qv**2).sum(1), np.full(len(qi), np.inf)
    held, size = [], 0

    def cut():
        """Of what is held: the nearest row of each id, as far as the k-th nearest id; bounds follow."""
        row, col, rough = (np.concatenate(x) for x in zip(*held, strict=True))
        key = row * len(known) + code[col]
        o = np.lexsort((rough, key))
        o = o[np.append(True, key[o][1:] != key[o][:-1])[: len(o)]]
        o = o[np.lexsort((rough[o], row[o]))]
        row, col, rough = row[o], col[o], rough[o]
        at = np.flatnonzero(np.append(True, row[1:] != row[:-1])[: len(row)])
        many = at[np.diff(np.append(at, len(row))) >= k]
        edge = rough[many + k - 1]
        of = row[many]
        bound[of] = np.minimum(bound[of], edge + 1e-9 * (np.abs(edge) + norm[of] + 1e-300))
        keep = rough <= bound[row]
        return [(row[keep], col[keep], rough[keep])]

    starts = np.flatnonzero(np.append(True, lists[1:] != lists[:-1])) if len(lists) else np.empty(0, np.int64)
    for at, end in zip(starts.tolist(), np.append(starts[1:], len(lists)).tolist(), strict=True):
        asked = np.flatnonzero(visits[:, lists[at]])
        once = end - at > k and len(np.unique(code[at:end])) == end - at
        for i in range(0, len(asked), TILE):
            rows = asked[i : i + TILE]
            rough = left[rows] @ right[:, at:end]
            new = np.flatnonzero(np.isinf(bound[rows])) if once else np.empty(0, np.int64)
            if len(new):  # one of the k + 1 nearest may be the query itself
                edge = np.partition(rough[new], k, axis=1)[:, k]
                bound[rows[new]] = edge + 1e-9 * (np.abs(edge) + norm[rows[new]] + 1e-300)
            row, col = np.nonzero(rough <= bound[rows][:, None])
            other = ids[at + col] != qi[rows[row]]
            row, col = row[other], col[other]
            held.append((rows[row], at + col, rough[row, col]))
            size += len(row)
            if size > 4 * k * len(qi) + 100_000:
                held, size = cut(), 0
    if not held:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    row, col, _ = cut()[0]
    d = np.concatenate([np.sqrt(((v[col[i : i + 65_536]] - qv[row[i : i + 65_536]]) ** 2).sum(1)) for i in range(0, max(1, len(row)), 65_536)])
    o = np.lexsort((ids[col], d, row))
    row, col, d = row[o], col[o], d[o]
    at = np.flatnonzero(np.append(True, row[1:] != row[:-1])[: len(row)])
    best = np.arange(len(row)) - np.repeat(at, np.diff(np.append(at, len(row)))) < k
    return row[best], ids[col[best]], d[best]


def _nearest(visits: DataFrame, postings: DataFrame, shards: Shards, dimension: int, k: int) -> DataFrame:
    """(query_id, id, score, rank): the k nearest of each query in the lists that it visits. A shard's queries are dealt to blocks by hash, so that no
    group passes about SHARD_ROWS rows (a list of one key's rows stays whole) and QUERY_BLOCK queries."""
    spark = visits.sparkSession
    asked = visits.groupBy("shard").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))  # a row for each shard
    of = spark.createDataFrame([(i, int(s), int(p)) for i, (s, p) in enumerate(zip(shards.of, shards.pieces, strict=True))], "list int, at int, pieces int")
    left = visits.join(F.broadcast(asked), "shard").select("shard", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "first", "visits", "id", "v")
    dealt = postings.join(F.broadcast(of), "list").withColumn("shard", F.col("at") + F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
    right = dealt.join(F.broadcast(asked), "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "list", "id", "v")

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        row, ids, d = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        qi = q["id"].to_numpy()
        if q.num_rows and c.num_rows:
            bits = np.frombuffer(b"".join(q["visits"].to_pylist()), np.uint8).reshape(q.num_rows, -1)
            lists = c["list"].to_numpy().astype(np.int64) - q["first"][0].as_py()
            row, ids, d = nearest_in_lists(qi, _matrix(q["v"], dimension), np.unpackbits(bits, axis=1), lists, c["id"].to_numpy(), _matrix(c["v"], dimension), k)
        return pa.table({"query_id": pa.array(qi[row], pa.int64()), "id": pa.array(ids, pa.int64()), "score": pa.array(d, pa.float64())})

    keys = ("shard", "block")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id bigint, id bigint, score double")
    found = found.groupBy("query_id", "id").agg(F.min("score").alias("score"))
    best = W.partitionBy("query_id").orderBy("score", "id")  # a query has at most k rows from each shard that it is dealt to
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def search(table: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10, **index_options) -> DataFrame:
    """(query_id, rank, id, score): the k nearest of each row that the condition queries picks, by Euclidean distance in double precision.

    Every usable row is indexed. A query visits the lists whose centroids are at most (1 + ratio) times as far as the nearest; fit() measures the
    ratio, and index_options are its own. Queries that find fewer than k search all lists. Null keys and unusable vectors take no part; a repeated key is
    one vector (the nearest of its rows counts); ties go to the smaller key; extra columns are left out; an empty table gives no rows.
    """
    vectors = table.filter(F.col(key).isNotNull() & usable(vector)).select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v"), queries.alias("is_query"))
    rows = vectors.count()
    index = fit(vectors, rows, **index_options)
    if index is None:
        return table.sparkSession.createDataFrame([], "query_id bigint, rank int, id bigint, score double")
    postings = materialize(_deal(vectors, index))
    sizes = np.zeros(len(index.graph.centroids), np.int64)
    for r in postings.groupBy("list").count().collect():  # a row for each list, of which the sample bounds the number
        sizes[r["list"]] = r["count"]
    even = int(sizes.sum()) // (4 * table.sparkSession.sparkContext.defaultParallelism)
    shards = Shards.of_sizes(sizes, min(SHARD_ROWS, max(1024, even)))
    asked = vectors.filter("is_query")

    found = materialize(_nearest(materialize(_visits(asked, index, shards, False)), postings, shards, index.dimension, k))
    enough = found.groupBy("query_id").count().filter(F.col("count") >= k).select(F.col("query_id").alias("id"))
    short = materialize(asked.join(enough, "id", "left_anti"))
    if not short.isEmpty():
        everywhere = _nearest(materialize(_visits(short, index, shards, True)), postings, shards, index.dimension, k)
        found = found.join(enough.withColumnRenamed("id", "query_id"), "query_id", "left_semi").unionByName(everywhere)
    return found.select("query_id", "rank", "id", "score")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector."""
    got = search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
    return got.select("query_id", "rank", F.col("id").alias("vec_id"), "score")

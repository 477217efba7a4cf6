"""Centroid clustering of integer vectors by scalar lookup tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import materialize, read

LARGEST = 1 << 27  # components up to here have squared distances that a long holds, over up to 64 dimensions
DENSE = 1 << 16
_ROWS = 8192


def integer_vectors(df: DataFrame, dimensions: int = 64, scale: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, v): floor(scale * x) of every component, as integers. Only vectors of `dimensions` components, none null or not finite, stay."""
    whole = f"CAST(floor({scale}D * CAST(x AS double)) AS bigint)"
    fits = f"x IS NOT NULL AND NOT isnan(x) AND abs({scale}D * CAST(x AS double)) < {LARGEST}"
    rows = df.select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    return rows.filter(f"size(vector) = {dimensions} AND forall(vector, x -> {fits})").select("key", F.expr(f"transform(vector, x -> {whole})").alias("v"))


def first_centroids(vectors: DataFrame, clusters: int, seed: int = 1) -> np.ndarray:
    """The vectors of least SHA-256 of `seed:key`, in its order; rows that share a key come in the order of their components."""
    rows = vectors.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))).cast("binary"), 256).alias("h"), "v")
    return np.array([r["v"] for r in rows.orderBy("h", "v").limit(clusters).collect()], np.int64)


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Distances (rows, clusters): for each dimension the squared difference of every integer that occurs to every centroid is tabulated, and
    the rows gather from the table."""
    total = np.zeros((len(x), len(centroids)), np.int64)
    for d in range(x.shape[1]):
        low, high = int(x[:, d].min()), int(x[:, d].max())
        if high - low < DENSE:
            at = x[:, d] - low
            occurring = np.flatnonzero(np.bincount(at, minlength=high - low + 1))
            table = np.zeros((high - low + 1, len(centroids)), np.int64)
            table[occurring] = (occurring[:, None] + low - centroids[None, :, d]) ** 2
        else:
            occurring, at = np.unique(x[:, d], return_inverse=True)
            table = (occurring[:, None] - centroids[None, :, d]) ** 2
        total += table[at]
    return total


def _rows(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        for i in range(0, whole.num_rows, _ROWS):
            batch = whole.slice(i, _ROWS)
            yield batch, pc.list_flatten(batch.column(batch.schema.get_field_index("v"))).to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(key, cluster, distance): the nearest centroid by squared distance, the smaller number of equally near ones."""

    def run(batches):
        for batch, x in _rows(batches, centroids.shape[1]):
            distance = squared_distances(x, centroids)
            cluster = distance.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance[np.arange(len(x)), cluster])], ["key", "cluster", "distance"])

    return vectors.select("key", "v").mapInArrow(run, f"key {vectors.schema['key'].dataType.simpleString()}, cluster int, distance bigint")


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid as the floor of its vectors' mean; those without vectors stay. A task sums its rows, Spark its sums by cluster and
    dimension; what reaches the driver is one sum for each of these."""
    clusters, dimensions = centroids.shape

    def run(batches):
        sums, n = np.zeros((clusters, dimensions), np.int64), np.zeros(clusters, np.int64)
        rows = 0
        for _, x in _rows(batches, dimensions):
            cluster = squared_distances(x, centroids).argmin(axis=1)
            order = np.argsort(cluster, kind="stable")
            present, at = np.unique(cluster[order], return_index=True)
            sums[present] += np.add.reduceat(x[order], at, axis=0)
            n += np.bincount(cluster, minlength=clusters)
            rows += len(x)
            if rows > 1 << 34:  # sums of more rows could pass a long
                yield partial(sums, n)
                sums[:], n[:], rows = 0, 0, 0
        yield partial(sums, n)

    def partial(sums, n):
        c, d = np.divmod(np.arange(clusters * dimensions), dimensions)
        return pa.RecordBatch.from_arrays([pa.array(c), pa.array(d), pa.array(sums.ravel()), pa.array(n[c])], ["cluster", "dimension", "total", "n"])

    found = vectors.select("v").mapInArrow(run, "cluster bigint, dimension bigint, total bigint, n bigint").groupBy("cluster", "dimension")
    new = centroids.copy()
    for r in found.agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():
        if r["n"]:
            new[r["cluster"], r["dimension"]] = int(r["total"]) // r["n"]
    return new


def cluster(df: DataFrame, clusters: int = 16, rounds: int = 3, dimensions: int = 64, scale: int = 64, seed: int = 1, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(key, cluster, distance) of every vector that takes part, and the final centroids.

    Vectors of another length, null ones and ones with a null or non-finite component take no part, nor do ones with a component of 2^27 / scale
    or more, whose squared distance a long need not hold. Rows that share a key or are equal each count; null keys count as the text ''. Fewer
    vectors than clusters make fewer centroids; an empty table gives no rows.
    """
    vectors = materialize(integer_vectors(df, dimensions, scale, key, vector))
    centroids = first_centroids(vectors, clusters, seed).reshape(-1, dimensions)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(vectors, centroids)
    found = assign(vectors, centroids) if len(centroids) else vectors.select("key", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"))
    return found.withColumnRenamed("key", key), centroids


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 clusters of the embeddings after three rounds, with their inertia and centroids."""
    found, centroids = cluster(read(spark, sf_dir, "embeddings"))
    found = materialize(found)
    inertia = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digests = [",".join(map(str, c)) for c in centroids.tolist()]
    of = spark.createDataFrame([(c, inertia.get(c, 0), d) for c, d in enumerate(digests)], "cluster int, cluster_inertia bigint, components string")
    of = of.select("cluster", "cluster_inertia", F.lit(sum(inertia.values())).cast("bigint").alias("inertia"), F.sha2("components", 256).alias("centroid_sha256"))
    return found.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

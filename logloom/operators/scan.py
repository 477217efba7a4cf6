"""Scans over total orders and over long keys, dealt to many tasks: running sums, and windows with copied borders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from logloom.sources.tables import stored

LEAST_SPAN, MOST_SPAN, PIECES = 4096, 1 << 20, 16


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, str]) -> tuple[DataFrame, dict[str, int]]:
    """Add running sums (new name: column summed) over a total order, and tell each sum over all rows.

    Rows are dealt by range, each part is summed, and the sums of the parts before are added: one row for each part reaches the driver, and no
    task sees more than its part. The order must have no ties; nulls sum as 0.
    """
    dealt = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()))
    parts = sorted(dealt.groupBy("__p").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in sums.items()]).collect())
    before, total = [], dict.fromkeys(sums, 0)
    for r in parts:
        before.append((r["__p"], *total.values()))
        total = {name: at + r[name] for name, at in total.items()}
    kinds = {name: dealt.select(F.sum(c)).dtypes[0][1] for name, c in sums.items()}
    offsets = df.sparkSession.createDataFrame(before, "__p int, " + ", ".join(f"`__{name}` {kind}" for name, kind in kinds.items()))
    up_to = W.partitionBy("__p").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = dealt.join(F.broadcast(offsets), "__p").repartitionByRange("__p")  # parts stay apart where a hash would put several into one task
    rows = rows.withColumns({name: F.col(f"__{name}") + F.coalesce(F.sum(c).over(up_to), F.lit(0)) for name, c in sums.items()})
    return rows.drop("__p", *[f"__{name}" for name in sums]), total


def key_blocks(df: DataFrame, keys: list[str], order: str, halo: int = 0, sums: dict[str, Column] | None = None, span: int | None = None) -> tuple[DataFrame, WindowSpec]:
    """Rows dealt to blocks of about `span` rows of one key in its order, and the window over a block.

    Added columns: __i (position in the key, from 0), __n (the key's rows), __own, and for each of sums its running sum over the key. Each block
    begins with copies of at least the `halo` rows before it, of which __own is false: whoever looks back `halo` rows sees what he would see
    in the whole key, and drops the copies then. A key of a third of all rows is many blocks; where no key has over `span` rows (default: what
    fills a shuffle partition), each is one block and nothing is counted or joined.

    Rows of a key are counted by ranges of `order`, an integer of which not many rows of a key share a value, and ranges of few rows are put
    together. Carries are sums over these counts. Null keys are a key; nulls of the order come first.
    """
    sums = sums or {}
    rows, most = df.groupBy(*keys).count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    if span is None:
        span = min(MOST_SPAN, max(LEAST_SPAN, PIECES * halo, rows // int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    block = W.partitionBy(*keys, "__b").orderBy(order)
    up_to = block.rowsBetween(W.unboundedPreceding, 0)
    if most <= span:
        made = df.withColumn("__b", F.lit(0)).withColumns({"__i": (F.row_number().over(block) - 1).cast("bigint"), "__n": F.count("*").over(W.partitionBy(*keys, "__b")), "__own": F.lit(True)})
        return made.withColumns({name: F.coalesce(F.sum(c).over(up_to), F.lit(0)) for name, c in sums.items()}), block

    width = max(1, halo, span // PIECES)
    piece = F.coalesce(F.floor(F.col(order) / width).cast("bigint"), F.lit(-(2**62)))
    valued = df.withColumn("__s", piece).withColumns({f"__v_{name}": c for name, c in sums.items()})
    counts = valued.groupBy(*keys, "__s").agg(F.count("*").alias("__c"), *[F.coalesce(F.sum(f"__v_{name}"), F.lit(0)).alias(f"__a_{name}") for name in sums])
    of_key = W.partitionBy(*keys)
    earlier = of_key.orderBy("__s").rowsBetween(W.unboundedPreceding, -1)
    before = {"__start": F.coalesce(F.sum("__c").over(earlier), F.lit(0))} | {f"__a_{name}": F.coalesce(F.sum(f"__a_{name}").over(earlier), F.lit(0)) for name in sums}
    counts = counts.withColumns(before | {"__n": F.sum("__c").over(of_key)}).withColumn("__b", F.floor(F.col("__start") / (max(span, halo) + width)))
    left = F.max(F.col("__start") + F.col("__c")).over(W.partitionBy(*keys, "__b")) - F.col("__start") - F.col("__c")
    counts = counts.withColumn("__copy", (left < halo) & (F.col("__b") < F.max("__b").over(of_key)))
    counts = counts.withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(keys)}).withColumnRenamed("__s", "__t")
    same = F.col("__s") == F.col("__t")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    joined = valued.join(counts, same).drop("__s", "__t", *[f"__k{i}" for i in range(len(keys))])
    own = F.array(F.struct(F.col("__b"), F.lit(True).alias("__own")))
    both = F.concat(own, F.array(F.struct((F.col("__b") + 1).alias("__b"), F.lit(False).alias("__own"))))
    joined = joined.withColumn("__to", F.explode(F.when(F.col("__copy"), both).otherwise(own))) if halo else joined.withColumn("__to", own[0])
    made = joined.drop("__b", "__c", "__copy").select("*", "__to.*").drop("__to")
    made = made.withColumn("__i", F.first("__start").over(block) + F.row_number().over(block) - 1)
    made = made.withColumns({name: F.first(f"__a_{name}").over(block) + F.coalesce(F.sum(f"__v_{name}").over(up_to), F.lit(0)) for name in sums})
    return made.drop("__start", *[f"__a_{name}" for name in sums], *[f"__v_{name}" for name in sums]), block


def own_rows(df: DataFrame, drop: tuple[str, ...] = ("__b", "__i", "__n", "__own")) -> DataFrame:
    """The rows themselves, without copies and the columns of key_blocks."""
    return df.filter("__own").drop(*drop)

"""Filter interaction audit: what each filter removes in every order of the filters."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import materialize, read
from logloom.llm.transducer import with_counts

#: Failure conditions over the columns of with_counts.
FILTERS = {
    "A": "n_words < 50",
    "B": "100 * n_distinct < 65 * n_words",
    "C": "100 * n_capitals > 5 * n_points",
    "D": "n_symbols > 0",
}
COPIES = "E"


def failures(docs: DataFrame, filters: dict[str, str] = FILTERS, text: str = "text", key: str = "doc_id", part: str = "source") -> DataFrame:
    """(key, part, same, mask) of every row: bit i of mask is set where it fails filter i; same is the text's SHA-256. Texts go no further."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    counted = with_counts(rows.withColumn("same", F.unhex(F.sha2("text", 256))), keep=["key", "part", "same"])
    bits = [F.when(F.expr(fails), 1 << i).otherwise(0) for i, fails in enumerate(filters.values())]
    return counted.select("key", "part", "same", sum(bits[1:], bits[0]).alias("mask"))


def failure_counts(docs: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS, text: str = "text", key: str = "doc_id", part: str = "source") -> DataFrame:
    """(part, mask, n, n_good, n_toxic): documents of each part by the filters that they fail. The bit after those of filters says that a smaller
    key has the same text.

    Every row but those of its text's smallest key is a copy, so that all rows are counted as copies and the rows of smallest keys are moved:
    the smallest key of a text is a minimum, which is combined before the shuffle, and no group of copies ever meets in one task.
    """
    of = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key"))
    marks = of.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")).filter("good OR toxic")
    rows = materialize(failures(docs, filters, text, key, part).join(marks, "key", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")}))
    copy = 1 << len(filters)
    first = rows.filter("key IS NOT NULL").groupBy("same").agg(F.min("key").alias("key"))
    cell = ["part", "mask", "good", "toxic"]
    firsts = rows.join(first, ["same", "key"]).groupBy(cell).agg(F.count("*").alias("n"))
    every = rows.withColumn("mask", F.when(F.col("key").isNull(), F.col("mask")).otherwise(F.col("mask") + copy)).groupBy(cell).agg(F.count("*").alias("n"))
    moved = firsts.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("mask"), F.col("n")), F.struct((F.col("mask") + copy).alias("mask"), (-F.col("n")).alias("n")))).alias("m")).select("part", "m.mask", "good", "toxic", "m.n")
    sums = [F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("n_good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("n_toxic")]
    return every.unionByName(moved).groupBy("part", "mask").agg(*sums).filter("n > 0")


def audit_orders(counts: DataFrame, letters: str) -> DataFrame:
    """One row for each part, order of the filters and step, from (part, mask, n, n_good, n_toxic): at most 2^k rows of a part are unfolded
    into k! orders of k steps. A document that fails j filters is removed by each of them in k!/j orders, which gives shapley."""
    orders = [F.lit("".join(p)) for p in permutations(letters)]
    rows = counts.withColumn("filter_order", F.explode(F.array(*orders))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    of = lambda text: sum((F.when(F.instr(text, c) > 0, 1 << i).otherwise(0) for i, c in enumerate(letters)), F.lit(0))
    rows = rows.withColumn("own", of(F.expr("substring(filter_order, step, 1)"))).withColumn("earlier", of(F.expr("substring(filter_order, 1, step - 1)")))
    fails, gone = F.col("mask").bitwiseAND(F.col("own")) > 0, F.col("mask").bitwiseAND(F.col("earlier")) > 0
    total = lambda which, n="n": F.sum(F.when(which, F.col(n)).otherwise(0)).cast("bigint")
    share = F.expr(f"n * ({factorial(len(letters))} div greatest(1, bit_count(mask)))")
    return rows.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"), total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(fails & ~gone, "n_good").alias("good_lost"), total(fails & ~gone, "n_toxic").alias("toxic_lost"), F.sum(F.when(fails, share).otherwise(0)).cast("bigint").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS, copies: str = COPIES, text: str = "text", key: str = "doc_id", part: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of the filters and of `copies`.

    Null texts are empty ones, null parts the part ''. Rows with a null key are never copies, make none and have no label; rows that share
    key and text are no copies of each other and each counts; of a key's several labels any 1 counts. Empty documents give no rows.
    """
    return audit_orders(failure_counts(docs, labels, filters, text, key, part), "".join(filters) + copies)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of five filters over documents, by source."""
    return audit(read(spark, sf_dir, "documents").select("doc_id", "source", "text"), read(spark, sf_dir, "labels"))

"""Windows, sequences, numbering, sampling and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.operators.scan import key_blocks, own_rows
from logloom.sources.tables import stored


def number_rows(df: DataFrame, *order: Column | str, name: str = "line_id") -> DataFrame:
    """Dense numbers from 1 in a total order: rows are dealt by range and sorted, each partition counted, and the counts before a
    partition added. What reaches the driver is one number for each partition; no single task sorts all."""
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    dealt = stored(df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33)))
    counts = {r["__p"]: r["count"] for r in dealt.groupBy("__p").count().collect()}
    before, total = [], 0
    for p in sorted(counts):
        before += [F.lit(p), F.lit(total).cast("bigint")]
        total += counts[p]
    offset = F.create_map(*before)[F.col("__p")] if before else F.lit(0)
    return dealt.withColumn(name, F.col("__i") + offset + 1).drop("__p", "__i")


def window_rows(df: DataFrame, position: Column, size: int, step: int) -> DataFrame:
    """One row for each window of `size` positions, a new one every `step`, that a row (zero-based position) lies in: column window_id."""
    low = F.greatest(F.ceil((position - (size - 1)) / step), F.lit(0))
    return df.withColumn("window_id", F.explode(F.sequence(low.cast("bigint"), F.floor(position / step).cast("bigint"))))


def fixed_windows(df: DataFrame, size: int, step: int, order: str = "line_id", values: tuple[str, ...] = ("event_template",)) -> DataFrame:
    """Windows over a dense order from 1; short ones at the end stay. (window_id, n_rows, <value>_list in order)"""
    rows = window_rows(df, F.col(order) - 1, size, step)
    items = F.sort_array(F.collect_list(F.struct(F.col(order).alias("__o"), *values)))
    made = rows.groupBy("window_id").agg(items.alias("items"))
    return made.select("window_id", F.size("items").cast("bigint").alias("n_rows"), *[F.col("items")[v].alias(f"{v}_list") for v in values])


def time_windows(df: DataFrame, size: int, step: int, time: str = "t", order: str = "line_id", values: tuple[str, ...] = ("event_template",)) -> DataFrame:
    """Windows of `size` seconds from the first event on, every `step` seconds, half open; the first that reaches the last row is the last,
    empty ones are left out, and ones of the same rows are one. (first_row, last_row, n_rows, <value>_list)"""
    first, last = df.agg(F.min(time), F.max(time)).first()
    if first is None:
        first = last = 0
    since = F.col(time) - F.lit(first)
    most = max(0, (last - first - size) // step + 1)
    low = F.greatest(F.floor((since - size) / step) + 1, F.lit(0)).cast("bigint")
    high = F.least(F.floor(since / step), F.lit(most)).cast("bigint")
    rows = df.filter(low <= high).withColumn("__w", F.explode(F.sequence(low, high)))
    made = rows.groupBy("__w").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("__o"), *values))).alias("items"))
    made = made.select(F.element_at("items", 1)["__o"].alias("first_row"), F.element_at("items", -1)["__o"].alias("last_row"), F.size("items").cast("bigint").alias("n_rows"), *[F.col("items")[v].alias(f"{v}_list") for v in values])
    return made.dropDuplicates(["first_row", "last_row"])


def sessions_by_pattern(df: DataFrame, pattern: str, text: str, order: str, values: tuple[str, ...]) -> DataFrame:
    """A row belongs to the session of every distinct key that its text holds. (session_id, <value>_list in order)"""
    keyed = df.withColumn("session_id", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))))
    return session_rollup(keyed, "session_id", order, values)


def session_rollup(df: DataFrame, key: str, order: str, values: tuple[str, ...]) -> DataFrame:
    """Ordered lists of the values of each key."""
    made = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("__o"), *values))).alias("items"))
    return made.select(key, F.size("items").cast("bigint").alias("n_rows"), *[F.col("items")[v].alias(f"{v}_list") for v in values])


def chunks_by_key(df: DataFrame, key: str, order: str, length: int, label: str) -> DataFrame:
    """Chunks of `length` rows of each key in order; a chunk's label is 1 if any row's is. (key, chunk, n_rows, first_row, label)"""
    rows, _ = key_blocks(df, [key], order)
    return rows.withColumn("chunk", F.floor(F.col("__i") / length)).groupBy(key, "chunk").agg(F.count("*").alias("n_rows"), F.min(order).alias("first_row"), F.max(label).alias("label"))


def next_event_samples(sessions: DataFrame, sequence: str, size: int, padding: str = "padding") -> DataFrame:
    """One row for each offset of a session's sequence, padded at its end to size + 1: history (size events) and target. Other columns stay."""
    padded = F.when(F.size(sequence) < size + 1, F.concat(sequence, F.array_repeat(F.lit(padding), F.lit(size + 1) - F.size(sequence)))).otherwise(F.col(sequence))
    rows = sessions.withColumn("__s", padded).withColumn("sample_pos", F.explode(F.sequence(F.lit(0), F.size("__s") - size - 1)))
    return rows.withColumn("history", F.slice("__s", F.col("sample_pos") + 1, size)).withColumn("target", F.element_at("__s", F.col("sample_pos") + size + 1)).drop("__s")


def detector_windows(df: DataFrame, key: str, order: str, event: str, size: int, step: int) -> DataFrame:
    """Windows of the rows before a row, in the order of each key: history of min(size, max(1, n - 1)) events and the event that follows,
    every `step` rows. Keys of one row have none. (key, window_id, target_row, history, target)"""
    rows, w = key_blocks(df, [key], order, halo=size)
    rows = rows.withColumn("__h", F.least(F.lit(size), F.greatest(F.lit(1), F.col("__n") - 1))).withColumn("__before", F.collect_list(event).over(w.rowsBetween(-size, -1)))
    rows = rows.filter(F.col("__own") & (F.col("__i") >= F.col("__h")) & ((F.col("__i") - F.col("__h")) % step == 0))
    return rows.select(key, ((F.col("__i") - F.col("__h")) / step).cast("bigint").alias("window_id"), F.col(order).alias("target_row"), F.slice("__before", -F.col("__h").cast("int"), F.col("__h").cast("int")).alias("history"), F.col(event).alias("target"))


def with_start_rows(df: DataFrame, key: str, order: str, event: str, count: int, token: str = "<BOS>") -> DataFrame:
    """`count` virtual rows before each key's first: they carry the token, a negative order and is_virtual, and are no lines."""
    starts = df.select(key).distinct().select(key, F.explode(F.sequence(F.lit(-count).cast("bigint"), F.lit(-1).cast("bigint"))).alias(order), F.lit(token).alias(event), F.lit(True).alias("is_virtual"))
    return df.select(key, F.col(order).cast("bigint").alias(order), event, F.lit(False).alias("is_virtual")).unionByName(starts)


def start_sessions(df: DataFrame, key: str, order: str, time: str, event: str, length: int, count: int, token: str = "<BOS>") -> DataFrame:
    """Pseudo-sessions key#session000000 of `length` rows of each key, each after `count` start rows one second apart before it."""
    rows, _ = key_blocks(df, [key], order)
    rows = rows.select(F.format_string("%s#session%06d", F.col(key), F.floor(F.col("__i") / length)).alias("session_id"), F.col(order).alias("row_order"), F.col(time).alias("time"), F.col(event).alias("event"))
    first = rows.groupBy("session_id").agg(F.min("time").alias("t0"), F.min("row_order").alias("o0"))
    starts = first.select("session_id", F.explode(F.sequence(F.lit(1), F.lit(count))).alias("i"), "t0", "o0").select("session_id", (F.col("o0") - 1).alias("row_order"), (F.col("t0") - (count - F.col("i") + 1)).alias("time"), F.lit(token).alias("event"))
    return rows.unionByName(starts)


def unknown_bursts(df: DataFrame, key: str, order: str, event: str, probability: float, seed: int = 42, shortest: int = 2, longest: int = 8, token: str = "<UNK>") -> DataFrame:
    """Runs of `shortest` to `longest` rows of each key become the token: a row starts a run with the given probability, drawn from a hash of
    key, position and seed, and so is the run's length."""
    rows, w = key_blocks(df, [key], order, halo=longest - 1)
    rows = rows.withColumn("__i", F.col("__i") + 1)
    draw = lambda salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col(key), F.col("__i")), F.lit(1_000_000))
    until = F.when(draw(1) < int(probability * 1_000_000), F.col("__i") + shortest - 1 + F.pmod(draw(2), F.lit(longest - shortest + 1)))
    covered = F.max(until).over(w.rowsBetween(-longest + 1, 0)) >= F.col("__i")
    return own_rows(rows.withColumn("is_burst", F.coalesce(covered, F.lit(False))).withColumn(event, F.when(F.col("is_burst"), token).otherwise(F.col(event))))


def target_last_windows(df: DataFrame, key: str, order: str, event: str, size: int, step: int) -> DataFrame:
    """Full windows of `size` rows whose last row is the target: (key, first_row, target_row, history, target)."""
    rows, w = key_blocks(df, [key], order, halo=size - 1)
    rows = rows.withColumn("__before", F.collect_list(event).over(w.rowsBetween(-(size - 1), -1))).withColumn("__first", F.min(order).over(w.rowsBetween(-(size - 1), 0)))
    rows = rows.filter(F.col("__own") & (F.col("__i") >= size - 1) & ((F.col("__i") - (size - 1)) % step == 0))
    return rows.select(key, F.col("__first").alias("first_row"), F.col(order).alias("target_row"), F.col("__before").alias("history"), F.col(event).alias("target"))


def first_seen_ids(df: DataFrame, value: str, order: str, name: str = "value_id") -> DataFrame:
    """Dense ids from 1 of distinct values in the order in which they are first seen."""
    first = df.groupBy(value).agg(F.min(order).alias("first_row"))
    return number_rows(first, "first_row", name=name)


def every_nth(df: DataFrame, order: str, target: int, minimum: int = 1) -> DataFrame:
    """Every N-th row of a dense order, N = rows // target; all rows where that would leave fewer than minimum."""
    total = df.count()
    n = max(1, total // max(1, target))
    return df.filter(F.col(order) % n == 0) if total // n >= minimum else df


def continuation_groups(df: DataFrame, is_start: Column, key: str, order: str, text: str) -> DataFrame:
    """Rows that start no entry are added to the entry before them, within a key; rows before the first entry are left out."""
    rows, _ = key_blocks(df, [key], order, sums={"__e": is_start.cast("int")})
    rows = rows.filter(F.col("__e") > 0)
    made = rows.groupBy(key, "__e").agg(F.min(order).alias("first_row"), F.sort_array(F.collect_list(F.struct(order, text))).alias("items"))
    return made.select(key, "first_row", F.size("items").cast("bigint").alias("n_lines"), F.array_join(F.col("items")[text], " ").alias("entry"))


def first_n(df: DataFrame, keys: list[str], order: list[Column | str], n: int) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("__r") <= n).drop("__r")


def split_by_order(df: DataFrame, keys: list[str], order: str, share: float) -> DataFrame:
    """is_train for the first `share` of each key's rows in order."""
    rows, _ = key_blocks(df, keys, order)
    return own_rows(rows.withColumn("is_train", F.col("__i") + 1 <= F.floor(F.col("__n") * share)))


def split_histories(df: DataFrame, keys: list[str], order: str, event: str, size: int, share: float) -> DataFrame:
    """split_by_order and, for each row, history: the up to `size` events of its key before it. One pass makes both."""
    rows, w = key_blocks(df, keys, order, halo=size)
    return own_rows(rows.withColumn("is_train", F.col("__i") + 1 <= F.floor(F.col("__n") * share)).withColumn("history", F.collect_list(event).over(w.rowsBetween(-size, -1))))


def hash_order(seed: int, key: str) -> Column:
    """A fixed shuffle: order by md5 of the seed and the key."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def lowest_hashes(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows drawn without replacement: those of least hash. A histogram of 65,536 hash prefixes tells the one in which the n-th row falls;
    rows of lower prefixes are kept where they are, and only that prefix's rows are ranked."""
    prefix = F.coalesce(F.substring(hash_order(seed, key), 1, 4), F.lit(""))
    below, at = 0, None
    for r in sorted(df.groupBy(prefix.alias("p")).count().collect()):
        at = r["p"]
        if below + r["count"] >= n:
            break
        below += r["count"]
    if at is None or n <= 0:
        return df.limit(0)
    return df.filter(prefix < at).unionByName(df.filter(prefix == at).orderBy(hash_order(seed, key), key).limit(n - below))


def balanced(normal: DataFrame, attacks: DataFrame, key: str, times: int = 2, seed: int = 42) -> DataFrame:
    """All attacks and `times` as many normal rows, drawn by hash."""
    return lowest_hashes(normal, times * attacks.count(), seed, key).unionByName(attacks)


def round_robin(df: DataFrame, case: str, kind: str, order: list[Column], n: int) -> DataFrame:
    """Rows of each case dealt in turn from its kinds, the kind of the best row first, up to n.

    No kind gives more than n rows, and no more than n kinds give any: both are cut before rows meet (Spark cuts in each task before the shuffle),
    so that a case's rows are never sorted as one.
    """
    best = df.withColumn("__r", F.row_number().over(W.partitionBy(case, kind).orderBy(*order))).filter(F.col("__r") <= n)
    kinds = best.filter(F.col("__r") == 1).withColumn("__k", F.row_number().over(W.partitionBy(case).orderBy(*order))).filter(F.col("__k") <= n)
    kinds = kinds.select(F.col(case).alias("__c"), F.col(kind).alias("__d"), "__k")
    rows = best.join(kinds, F.col(case).eqNullSafe(F.col("__c")) & F.col(kind).eqNullSafe(F.col("__d")))
    return rows.withColumn("pick", F.row_number().over(W.partitionBy(case).orderBy("__r", "__k"))).filter(F.col("pick") <= n).drop("__r", "__k", "__c", "__d")

"""Joins: labels, position ranges, evidence, tool plans, similarity and containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.operators.windows import first_n
from logloom.sources.tables import stored


def join_labels(sessions: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Sessions with their label; a session without one is an error when its row is read."""
    joined = sessions.join(labels.select(key, label), key, "left")
    return joined.withColumn(label, F.when(F.col(label).isNull(), F.raise_error(F.concat(F.lit("no label: "), F.col(key).cast("string")))).otherwise(F.col(label)))


def sidecar_labels(lines: DataFrame, sidecar: DataFrame, keys: list[str]) -> DataFrame:
    """Lines with the sorted distinct labels of a sidecar (keys, label); none: normal."""
    lists = sidecar.groupBy(*keys).agg(F.sort_array(F.collect_set("label")).alias("labels"))
    return lines.join(lists, keys, "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>"))).withColumn("label", F.when(F.size("labels") > 0, "attack").otherwise("-"))


def rows_in_windows(windows: DataFrame, rows: DataFrame, position: str, start: Column, end: Column) -> DataFrame:
    """Rows whose position lies in a window, bounds included: windows are unfolded to positions, and positions joined (both
    sides shuffled: Spark takes unfolded windows for as few rows as there are windows, and would broadcast them)."""
    return windows.withColumn(position, F.explode(F.sequence(start.cast("bigint"), end.cast("bigint")))).join(rows.hint("merge"), position)


def best_answer(iocs: DataFrame, answers: DataFrame, value: str, priority: str, order: str, columns: list[str]) -> DataFrame:
    """Each indicator with its answer of highest priority (the first on ties); values match whatever their case."""
    best = answers.groupBy(F.lower(value).alias("__k")).agg(F.max_by(F.struct(*columns), F.struct(priority, (-F.col(order)).alias("o"))).alias("best"))
    return iocs.withColumn("__k", F.lower(value)).join(best, "__k", "left").select(*iocs.columns, *[F.col("best")[c].alias(c) for c in columns])


def line_records(lines: DataFrame, windows: DataFrame, line: str) -> DataFrame:
    """Lines with the windows that hold them: n_windows, flagged windows, the list of ids. windows: (window_id, line ids, is_anomaly)"""
    held = windows.select("window_id", "is_anomaly", F.explode("line_ids").alias(line))
    per = held.groupBy(line).agg(F.count("*").alias("n_windows"), F.count_if("is_anomaly").alias("n_flagged"), F.array_join(F.transform(F.sort_array(F.collect_set("window_id")), lambda x: x.cast("string")), "|").alias("window_ids"))
    return lines.join(per, line, "left").fillna(0, ["n_windows", "n_flagged"]).fillna("", ["window_ids"])


def planned_calls(iocs: DataFrame, tools: DataFrame) -> DataFrame:
    """One call for each indicator and tool of its type, in the tools' order. tools: (tool, ioc_type, tool_rank), a short list."""
    return iocs.join(tools, "ioc_type")


def remaining_calls(planned: DataFrame, attempted: DataFrame, keys: list[str]) -> DataFrame:
    return planned.join(attempted.select(*keys).distinct(), keys, "left_anti")


def follow_up_calls(planned: DataFrame, answers: DataFrame, attempted: DataFrame, keys: list[str], ioc: str = "ioc") -> DataFrame:
    """Calls for indicators that an answer finds malicious or suspicious, without those made already."""
    bad = answers.filter(F.col("verdict").isin("malicious", "suspicious")).select(ioc).distinct()
    return remaining_calls(planned.join(bad, ioc, "left_semi"), attempted, keys)


def mark_retained(windows: DataFrame, retained: DataFrame, key: str) -> DataFrame:
    return windows.join(retained.select(key, F.lit(True).alias("is_retained")).dropDuplicates([key]), key, "left").fillna(False, ["is_retained"])


def compare_counts(a: DataFrame, b: DataFrame, key: str, count: str) -> DataFrame:
    """How counts of the same keys changed: zero_to_nonzero, nonzero_to_zero, more, fewer, same."""
    x, y = F.col("x"), F.col("y")
    kind = F.when((x == 0) & (y > 0), "zero_to_nonzero").when((x > 0) & (y == 0), "nonzero_to_zero").when(y > x, "more").when(y < x, "fewer").otherwise("same")
    return a.select(key, F.col(count).alias("x")).join(b.select(key, F.col(count).alias("y")), key).groupBy(kind.alias("change")).agg(F.count("*").alias("n"))


def feed_matches(iocs: DataFrame, feed: DataFrame, related: int = 5) -> DataFrame:
    """Feed rows of each indicator: all of exact value, and up to `related` that share only its host. Both have ioc; feed has feed_id too.

    Of a host's feed rows only the first 2 * related go on, no more than `related` of each value: of these at most `related` are an indicator's own.
    """
    norm = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), "^[a-z]+://", ""), "/+$", "")
    host = lambda c: F.regexp_extract(norm(c), "^([^/:?#]+)", 1)
    a = iocs.select("ioc", norm(F.col("ioc")).alias("n"), host(F.col("ioc")).alias("h"))
    b = feed.select("feed_id", norm(F.col("ioc")).alias("fn"), host(F.col("ioc")).alias("h"))
    exact = a.join(b.withColumnRenamed("fn", "n").drop("h"), "n").select("ioc", "feed_id", F.lit("exact").alias("match"))
    few = first_n(first_n(b, ["h", "fn"], ["feed_id"], related), ["h"], ["feed_id"], 2 * related)
    near = a.join(few, "h").filter(F.col("n") != F.col("fn")).select("ioc", "feed_id", F.lit("related").alias("match"))
    near = near.withColumn("r", F.row_number().over(W.partitionBy("ioc").orderBy("feed_id"))).filter(F.col("r") <= related).drop("r")
    return exact.unionByName(near)


def call_differences(expected: DataFrame, called: DataFrame, keys: list[str], case: str, tool: str) -> DataFrame:
    """missing and extra calls, and for each missing one whether the case called its tool with another argument."""
    expected, called = expected.select(*keys).distinct(), called.select(*keys).distinct()
    missing, extra = stored(expected.join(called, keys, "left_anti")), stored(called.join(expected, keys, "left_anti"))
    other = extra.select(case, tool).distinct().withColumn("argument_mismatch", F.lit(True))
    m = missing.join(other, [case, tool], "left").select(*keys, F.lit("missing").alias("kind"), F.coalesce("argument_mismatch", F.lit(False)).alias("argument_mismatch"))
    return m.unionByName(extra.select(*keys, F.lit("extra").alias("kind"), F.lit(False).alias("argument_mismatch")))

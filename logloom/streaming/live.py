"""Streaming forms of parsing, windows and scoring, for Structured Streaming sources."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logloom.functions import text as T
from logloom.operators.detect import SEPARATOR


def stream_lines(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Lines of new files in a folder: file, raw_line, source, template, t (timestamp)."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw_line"))
    return with_templates(raw)


def with_templates(lines: DataFrame) -> DataFrame:
    """The same column expressions as for tables."""
    line = F.col("raw_line")
    return lines.withColumn("source", T.linux_source(line)).withColumn("template", T.linux_template(line, T.linux_source(line))).withColumn("t", F.timestamp_seconds(T.linux_epoch(line)))


def template_counts(lines: DataFrame, size: str = "1 hour", slide: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows of each template in sliding windows; rows later than the watermark are dropped."""
    return lines.withWatermark("t", late).groupBy(F.window("t", size, slide), "template").agg(F.count("*").alias("n")).select("window.start", "window.end", "template", "n")


def host_sessions(lines: DataFrame, gap: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each host that end after a gap."""
    return lines.withWatermark("t", late).groupBy(F.session_window("t", gap), "host").agg(F.count("*").alias("n")).select("session_window.start", "session_window.end", "host", "n")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class HostHistory(StatefulProcessor):
    """Adds the `order` events of a host before each of its events; the last ones are its state, a list of rows in the state store."""

    def __init__(self, order: int, keep_ms: int | None) -> None:
        self.order, self.keep_ms = order, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", "event string", self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, out = [r[0] for r in self.last.get()], []
        for event in pd.concat([r[["line_id", "event"]] for r in rows]).sort_values("line_id", kind="stable")["event"]:
            if len(last) == self.order:
                out.append((key[0], event, last))
            last = [*last, event][-self.order :]
        self.last.put([(e,) for e in last])
        yield pd.DataFrame(out, columns=["host", "event", "history"])

    def close(self) -> None:
        pass


def histories(lines: DataFrame, order: int, keep: timedelta | None = None) -> DataFrame:
    """(host, event, history) of each row of (host, line_id, event) that has `order` events of its host before it, in the order of arrival: batches
    as they come, line_id within one.

    The state is in RocksDB (the session is set to it), so that a stream that is stopped or lost goes on from its checkpoint with the same rows. A
    host that is silent for `keep` (processing time; default: for ever) is forgotten and begins anew. A task holds the numbers and events that one
    batch brings of a host.
    """
    lines.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    state = HostHistory(order, int(keep.total_seconds() * 1000) if keep else None)
    return lines.select("host", "line_id", "event").groupBy("host").transformWithStateInPandas(state, "host string, event string, history array<string>", "append", "ProcessingTime" if keep else "None")


def score_stream(lines: DataFrame, model: DataFrame, order: int = 3, topk: int = 3, keep: timedelta | None = None) -> DataFrame:
    """(host, event, history, is_miss) of the rows of histories: is_miss where the event is not among the first topk of the longest suffix that
    the batch model (a table of order, suffix, rank, topk) knows. The stream is joined with the model once for each length of suffix."""
    known, rows = model.filter("rank = 1"), histories(lines, order, keep)
    for n in range(order, -1, -1):
        of_n = known.filter(F.col("order") == n).select(F.col("suffix").alias("__s"), F.col("topk").alias(f"__{n}"))
        suffix = F.array_join(F.slice("history", F.lit(order - n + 1), F.lit(n)), SEPARATOR)
        rows = rows.join(of_n, suffix == F.col("__s"), "left").drop("__s")
    first = F.slice(F.coalesce(*[f"__{n}" for n in range(order, -1, -1)], F.array().cast("array<string>")), 1, topk)
    return rows.select("host", "event", F.array_join("history", "|").alias("history"), (~F.array_contains(first, F.col("event"))).alias("is_miss"))


def append_observations(stream: DataFrame, folder: str, checkpoint: str):
    """Write a stream's rows as they come, each batch once (its number is part of the path)."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

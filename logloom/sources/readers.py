"""Readers of log files and label files, and writers of result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.sources.tables import stored


def number_lines(df: DataFrame, file: str = "file", block: str = "block") -> DataFrame:
    """line_number from 1 within each file, over all lines, in file order: rows are numbered in each block of a file as read, and the counts of
    the file's earlier blocks added. No task sorts a whole file."""
    rows = stored(df.withColumn("__i", F.monotonically_increasing_id()))
    counts = rows.groupBy(file, block).agg(F.count("*").alias("n"), F.min("__i").alias("lo"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy(file).orderBy(block).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select(file, block, "before", "lo")
    return rows.join(before, [file, block]).withColumn("line_number", F.col("__i") - F.col("lo") + F.col("before") + 1).drop("__i", "before", "lo", block)


def read_text_log(spark: SparkSession, *paths: str, recursive: bool = False) -> DataFrame:
    """(file, line_number, raw_line) of text files, gz included: stripped, without byte order mark; blank lines count but are left out.

    A block of a file is read by one task in order, so that ids given there follow the lines.
    """
    lines = spark.read.option("recursiveFileLookup", recursive).text(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    text = F.trim(F.regexp_replace("value", "^﻿|[\r\t]+$", ""))
    return number_lines(lines).select("file", "line_number", text.alias("raw_line")).filter("raw_line <> ''")


def first_present(df: DataFrame, *names: str, default: Column | None = None) -> Column:
    """The first column of the given names that the table has, whatever their case; else the default (null)."""
    have = {c.lower(): c for c in df.columns}
    for n in names:
        if n.lower() in have:
            return F.col(f"`{have[n.lower()]}`")
    return F.lit(None).cast("string") if default is None else default


#: Names that columns of structured logs and label tables go by, most usual first.
TEMPLATE_NAMES = ("EventTemplate", "event_template", "template")
RAW_NAMES = ("Content", "raw_line", "Message", "message")
TIME_NAMES = ("TimeGenerated", "Timestamp", "timestamp", "time", "ts")
ID_NAMES = ("EventId", "EventID", "event_id")
LINE_NAMES = ("LineId", "line_id", "line_number")
LABEL_NAMES = ("y_true", "label", "Label", "is_anomaly", "anomaly", "target", "class", "ground_truth", "attack")


def structured_columns(df: DataFrame, passthrough: tuple[str, ...] = ()) -> DataFrame:
    """event_template, raw_line, timestamp, event_id, line_id found by name; a missing line id is the row's position, in the table's order."""
    line = first_present(df, *LINE_NAMES, default=F.monotonically_increasing_id())
    picked = df.select(line.cast("bigint").alias("line_id"), first_present(df, *TEMPLATE_NAMES).cast("string").alias("event_template"), first_present(df, *RAW_NAMES).cast("string").alias("raw_line"), first_present(df, *TIME_NAMES).cast("string").alias("timestamp"), first_present(df, *ID_NAMES).cast("string").alias("event_id"), *passthrough)
    return picked


def csv_log(df: DataFrame) -> DataFrame:
    """raw_line and timestamp of a table read from CSV: Message else Content, line breaks to blanks, empty messages left out, time nan to null."""
    message = F.trim(F.regexp_replace(first_present(df, "Message", "Content").cast("string"), "[\r\n]+", " "))
    time = first_present(df, "TimeGenerated", "Timestamp").cast("string")
    others = [f"`{c}`" for c in df.columns if c.lower() not in ("raw_line", "timestamp")]
    return df.select(*others, message.alias("raw_line"), F.when(F.lower(time) != "nan", time).alias("timestamp")).filter("raw_line <> ''")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Reader by extension: .csv, .xml (exported events), else text."""
    if path.endswith(".csv"):
        df = spark.read.option("header", True).option("multiLine", True).csv(path)
        if {"message", "content"} & {c.lower() for c in df.columns}:
            return csv_log(df).select("raw_line", "timestamp")
    if path.endswith(".xml"):
        return event_xml(spark.read.text(path, lineSep="</Event>"), "value").select("raw_line", F.col("time").alias("timestamp"))
    return read_text_log(spark, path).select("raw_line", F.lit(None).cast("string").alias("timestamp"))


def event_xml(df: DataFrame, xml: str) -> DataFrame:
    """event_id, provider, channel, task, level, computer, time and raw_line (data as name=value) of event records; broken records are left out."""
    text = F.regexp_replace(F.concat(F.col(xml), F.when(F.col(xml).contains("</Event>"), "").otherwise("</Event>")), r"(?s)^.*?<Event\b[^>]*>", "<Event>")
    head = lambda pattern: F.nullif(F.trim(F.regexp_extract(text, pattern, 1)), F.lit(""))
    one = lambda tag: head(rf"<{tag}\b[^>]*>([^<]*)</{tag}>")
    names, values = F.regexp_extract_all(text, F.lit(r"<Data Name=[\"']([^\"']*)[\"']>([^<]*)</Data>"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"<Data Name=[\"']([^\"']*)[\"']>([^<]*)</Data>"), F.lit(2))
    data = F.array_join(F.zip_with(names, values, lambda n, v: F.concat(n, F.lit("="), v)), " ")
    rows = df.select(one("EventID").alias("event_id"), head(r"<Provider\b[^>]*\bName=[\"']([^\"']*)[\"']").alias("provider"), one("Channel").alias("channel"), one("Task").alias("task"), one("Level").alias("level"), one("Computer").alias("computer"), head(r"<TimeCreated\b[^>]*\bSystemTime=[\"']([^\"']*)[\"']").alias("time"), data.alias("data"))
    return rows.filter("event_id IS NOT NULL AND provider IS NOT NULL").withColumn("raw_line", F.concat_ws(" ", F.concat("provider", F.lit(" EventID="), "event_id"), F.nullif("data", F.lit(""))))


def first_lines(df: DataFrame, line: str, n: int) -> DataFrame:
    """The first n lines by number."""
    return df.filter(F.col(line) <= n)


def normal_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows that are normal and have a message, in order."""
    return df.filter(F.lower(F.trim("label")).isin("-", "normal", "0") & (F.trim("message") != "")).orderBy(order).limit(n)


def label_sidecar(df: DataFrame, value: str) -> DataFrame:
    """(line, labels) of JSON lines with a line number and one label or a list; broken JSON and lines without a number are left out."""
    parsed = df.select(F.get_json_object(value, "$.line").try_cast("bigint").alias("line"), F.get_json_object(value, "$.labels").alias("l"))
    labels = F.coalesce(F.from_json("l", "array<string>"), F.array("l"))
    labels = F.when(F.col("l").startswith("["), labels).otherwise(F.array("l"))
    return parsed.filter("line IS NOT NULL AND l IS NOT NULL").select("line", F.explode(labels).alias("label")).filter("label <> ''").groupBy("line").agg(F.sort_array(F.collect_set("label")).alias("labels"))


def integer_sequences(df: DataFrame, value: str) -> DataFrame:
    return df.withColumn("sequence", F.transform(F.filter(F.split(F.trim(value), r"\s+"), lambda x: x != ""), lambda x: x.cast("int")))


def block_labels(df: DataFrame) -> DataFrame:
    return df.select(F.col("BlockId").alias("block_id"), (F.col("Label") == "Anomaly").cast("int").alias("y"))


def cached_sessions(df: DataFrame, sequence: str, label: str) -> DataFrame:
    """Sessions whose label is the largest of their list."""
    return df.withColumn(label, F.array_max(label)).filter(F.size(sequence) > 0)


def bulk_records(df: DataFrame, index: str, key: str, leave_out: tuple[str, ...] = ("elastic",)) -> DataFrame:
    """Two numbered lines for each record: an action and its document, without the fields left out."""
    meta = F.to_json(F.struct(F.struct(F.lit(index).alias("_index"), F.col(key).cast("string").alias("_id")).alias("index")))
    doc = F.to_json(F.struct(*[c for c in df.columns if c not in leave_out]))
    return df.select(key, F.posexplode(F.array(meta, doc)).alias("part", "line"))


def sequence_text(df: DataFrame, ids: str, features: list[str]) -> Column:
    """Feature tuples of each event, joined by commas, events by blanks."""
    return F.array_join(F.transform(F.arrays_zip(*features), lambda x: F.concat_ws(",", *[x[f].cast("string") for f in features])), " ")


def write_structured(df: DataFrame, folder: str) -> None:
    """The structured table, its raw lines, template counts and one summary row, each in its own folder."""
    df = stored(df)
    df.write.parquet(f"{folder}/structured")
    df.select(F.col("raw_line").alias("value")).write.text(f"{folder}/raw")
    df.groupBy("event_template").count().write.parquet(f"{folder}/templates")
    df.agg(F.count("*").alias("rows"), F.countDistinct("event_template").alias("templates")).write.json(f"{folder}/summary")


def write_observations(df: DataFrame, folder: str) -> None:
    df.write.mode("append").parquet(folder)

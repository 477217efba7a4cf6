"""Training and evaluation tables built from several operators, and formal evaluation of a next-event model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.functions import text as T
from logloom.operators import aggregates, detect, evaluate, windows
from logloom.operators.joins import sidecar_labels
from logloom.operators.parse import host_log_templates
from logloom.operators.scan import key_blocks, own_rows
from logloom.sources.tables import stored


def structured_table(df: DataFrame, order: list[str], template: str = "event_template", line: str = "line_no", event: str = "event_no") -> DataFrame:
    """Rows numbered in a total order (line), and their templates in the order in which they first come (event). The rows are stored before they are
    dealt by range: that reads them twice, to find the ranges and to deal, and would make their times and templates twice."""
    numbered = windows.number_rows(stored(df), *order, name=line)
    ids = windows.first_seen_ids(numbered, template, line, event).select(template, event)
    return numbered.join(ids, template)


def table_summary(df: DataFrame, template: str, time: str, label: str, sources: list[str], listed: list[str] = (), n: int = 30) -> DataFrame:
    """(kind, name, n_rows): all rows, distinct templates, first and last time, rows of each label and of each source, the n most frequent
    templates (ties by name), and how many rows each template of a given list has (zeros stay)."""
    at = lambda kind, name, value: F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), value.cast("bigint").alias("n_rows"))
    whole = df.agg(F.count("*").alias("a"), F.countDistinct(template).alias("b"), F.min(time).alias("c"), F.max(time).alias("d"))
    out = whole.select(F.explode(F.array(at("table", "rows", F.col("a")), at("table", "templates", F.col("b")), at("table", "first_time", F.col("c")), at("table", "last_time", F.col("d")))).alias("x")).select("x.*")
    for column in (label, *sources):
        out = out.unionByName(df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("name")).agg(F.count("*").alias("n_rows")).withColumn("kind", F.lit(column)))
    counts = df.groupBy(F.col(template).alias("name")).agg(F.count("*").alias("n_rows"))
    out = out.unionByName(counts.orderBy(F.desc("n_rows"), "name").limit(n).withColumn("kind", F.lit("top template")))
    if listed:
        names = df.sparkSession.createDataFrame([(x,) for x in listed], "name string")
        out = out.unionByName(names.join(counts, "name", "left").fillna(0, ["n_rows"]).withColumn("kind", F.lit("listed template")))
    return out


def host_log_table(df: DataFrame, agent: str = "agent", time: str = "timestamp", log: str = "full_log", label: str = "label", description: str = "description", row: str = "row", default_agent: str = "linux_host") -> DataFrame:
    """Structured table of host logs: rows without a log are left out, times that can't be read are the row's place, and the template is made
    from the log alone.

    Leakage guard: templates are built from a table that has the log and its row number only, so that no label, rule or technique can get in.
    """
    kept = df.filter(F.coalesce(F.col(log), F.lit("")) != "")
    placed = windows.number_rows(kept.select(F.col(row).alias("original_row"), F.col(agent).alias("a"), F.col(time).alias("t"), F.col(log).alias("content"), F.col(label).alias("l"), F.col(description).alias("rule_description")), "original_row", name="place")
    templates = host_log_templates(placed.select("place", "content"), "content").select("place", F.col("template").alias("event_template"))
    positive = T.free_text_label(F.coalesce(F.col("l"), F.lit(""))) == 1
    epoch = T.any_epoch(F.coalesce(F.col("t"), F.lit("")))
    rows = placed.join(templates, "place").select(
        "original_row", F.coalesce(F.nullif(F.col("a"), F.lit("")), F.lit(default_agent)).alias("agent"), F.when(epoch > 0, epoch).otherwise(F.col("place")).alias("timestamp"), "content", "event_template",
        F.when(positive, "attack").otherwise("-").alias("label"), F.when(positive, "malicious").otherwise("").alias("attack_labels"), F.coalesce("rule_description", F.lit("")).alias("rule_description"),
    )
    return structured_table(rows, ["agent", "timestamp", "original_row"])


def sidecar_table(lines: DataFrame, sidecar: DataFrame, file: str = "file", line: str = "line", text: str = "raw_line") -> DataFrame:
    """Structured table of log lines (file, line, text) whose labels are in a sidecar (file, line, label)."""
    labelled = sidecar_labels(lines.select(file, line, text), sidecar.select(file, line, "label"), [file, line])
    source = T.linux_source(F.col(text))
    rows = labelled.select(file, F.col(line).alias("original_line"), T.linux_epoch(F.col(text)).alias("timestamp"), F.col(text).alias("content"), T.linux_template(F.col(text), source).alias("event_template"), source.alias("log_source"), "label", F.array_join("labels", "|").alias("attack_labels"))
    return structured_table(rows, [file, "timestamp", "original_line"])


def rule_table(linux: DataFrame, web: DataFrame, rules: DataFrame, key: str = "line_id", text: str = "raw_line", host: str = "host") -> DataFrame:
    """Structured table of system and web-server lines, labelled by rules over their text."""
    line = F.col(text)
    a = linux.select(key, host, line.alias("content"), F.lit("linux").alias("log_source"), T.linux_epoch(line).alias("timestamp"), T.linux_template(line, T.linux_source(line)).alias("event_template"))
    b = web.select(key, host, line.alias("content"), F.lit("web").alias("log_source"), T.apache_epoch(line).alias("timestamp"), T.apache_template(line).alias("event_template"))
    labelled = T.rule_labels(a.unionByName(b), rules, key, "content").withColumn("attack_labels", F.array_join("labels", "|")).drop("labels")
    return structured_table(labelled, [host, "timestamp", "log_source", key])


def training_events(*parts: tuple[str, DataFrame]) -> DataFrame:
    """Union of (name, rows of host, line_id, t, provider, event_id, channel) with canonical templates, numbered from 1 over (t, name, line_id)."""
    out = None
    for name, df in parts:
        made = T.event_template("windows_evtx_canonical", F.col("provider"), F.col("event_id"), F.col("channel"))
        rows = df.select(F.lit(name).alias("origin"), "host", F.col("line_id").alias("origin_line"), "t", made.alias("event_template"), F.lit("-").alias("label"))
        out = rows if out is None else out.unionByName(rows)
    return windows.number_rows(out, "t", "origin", "origin_line", name="line_id")


def training_sessions(events: DataFrame, probability: float = 0.03, length: int = 100, starts: int = 10) -> DataFrame:
    """Canonical training table of events: runs of unknown ones are put in, sessions of `length` rows of a host begin with start rows, and events
    are numbered as they first come."""
    burst = windows.unknown_bursts(events, "host", "line_id", "event_template", probability)
    made = windows.start_sessions(burst, "host", "line_id", "t", "event_template", length, starts)
    ids = windows.first_seen_ids(made, "event", "row_order", "event_id").select("event", "event_id")
    return made.join(ids, "event").select("session_id", "row_order", "time", "event", "event_id")


def sampled_lines(df: DataFrame, file: str, order: str, step: int, least: int) -> DataFrame:
    """Every step-th line of each file from its first on, numbered anew from 1 (line_no); all lines of files that would keep no more than `least`."""
    rows, _ = key_blocks(df, [file], order)
    sampled = F.ceil(F.col("__n") / step) > least
    kept = rows.withColumn("__step", F.when(sampled, step).otherwise(1)).filter(F.col("__i") % F.col("__step") == 0)
    return own_rows(kept.withColumn("line_no", (F.floor(F.col("__i") / F.col("__step")) + 1).cast("bigint")).withColumn("sampling_applied", sampled).drop("__step"))


def analysis_summary(decided: DataFrame, file: str, order: str, statuses: list[str], first: int = 20) -> DataFrame:
    """One row for each file of decided windows: counts, the mean share of unknown events, counts by status (zeros stay) and the first anomalies in
    order (order and target), with is_truncated where more are there."""
    rows = decided.groupBy(file).agg(
        F.count("*").alias("window_count"), F.count_if("is_anomaly").alias("anomaly_count"), F.count_if("strict_is_anomaly").alias("strict_anomaly_count"), F.count_if(F.col("evaluation_status").startswith("skipped")).alias("skipped_windows"),
        F.round(F.avg("unknown_ratio"), 4).alias("avg_unknown_ratio"), *[F.count_if(F.col("evaluation_status") == s).alias(f"n_{s}") for s in statuses],
    )
    top = windows.first_n(decided.filter("is_anomaly"), [file], [order], first)
    listed = top.groupBy(file).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "target"))), lambda x: F.concat(x[order].cast("string"), F.lit(":"), x["target"])), "|").alias("anomalies"))
    return rows.join(listed, file, "left").fillna("", ["anomalies"]).withColumn("is_truncated", F.col("anomaly_count") > first)


def cached_scores(sessions: DataFrame, model: DataFrame, order: int, sequence: str = "q", label: str = "y", place: str = "line_id") -> DataFrame:
    """Equal sequences scored once: (sequence, label, n, p and ranked ids of every next-event sample). The last label of equal sequences counts."""
    few = aggregates.dedupe_sessions(sessions, sequence, place, label)
    samples = windows.next_event_samples(few, sequence, order)
    return detect.score_next_event(samples, model, order)


def cached_evaluation(scored: DataFrame, ks: list[int], sequence: str = "q", label: str = "y", target_recall: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """For each k the counts and measures of sessions, and the ranking of their scores; and the calibration of each k.

    Sessions are known once for each sequence, with a count: all measures weigh by it, and nothing is expanded. A session is flagged if any
    sample's target is outside the first k, its score is the largest 1 - p.
    """
    flags = detect.topk_flags(scored.drop("k"), ks).withColumn("is_miss", F.coalesce("is_miss", F.lit(True)))
    per = stored(flags.groupBy("k", sequence, label, "n").agg(F.bool_or("is_miss").cast("int").alias("y_pred"), F.round(F.max(1 - F.col("p")), 9).alias("score")))
    measures = evaluate.metrics(evaluate.confusion(per, label, "y_pred", keys=("k",), weight=F.col("n")))
    rank = evaluate.ranking_measures(per.filter(F.col("k") == ks[0]), "score", label, weight="n").first()  # scores are the same for each k
    calibrations = None
    for k in ks:
        own = evaluate.calibrate(per.filter(F.col("k") == k), "score", label, "y_pred", target_recall, weight="n").withColumn("k", F.lit(k))
        calibrations = own if calibrations is None else calibrations.unionByName(own)
    return measures.withColumns({name: F.lit(rank[name]).cast("double") for name in ("roc_auc", "average_precision")}), calibrations


def error_samples(df: DataFrame, key: str, score: str, n: int = 50) -> DataFrame:
    """(quadrant, key, score): the first n rows of each of TP and TN by key, and all counts of rows that have no truth (quadrant skipped)."""
    named = df.withColumn("quadrant", F.when(F.col("y_true").isNull() | F.col("y_pred").isNull(), "skipped").otherwise(evaluate.quadrant()))
    rows = windows.first_n(named.filter(F.col("quadrant").isin("TP", "TN")), ["quadrant"], [key], n).select("quadrant", F.col(key).alias("key"), score, F.lit(1).cast("bigint").alias("n_rows"))
    skipped = named.filter("quadrant = 'skipped'").agg(F.count("*").alias("n_rows")).select(F.lit("skipped").alias("quadrant"), F.lit(None).cast(df.schema[key].dataType).alias("key"), F.lit(None).cast("double").alias(score), "n_rows")
    return rows.unionByName(skipped)


def missed_files(per_file: DataFrame, k: str = "topk", section: str = "section", file: str = "file", most: int = 50) -> DataFrame:
    """For each k and section the files of which none of their windows was found: how many, whether the section is missed as a whole, and the first
    `most` by name."""
    by = [k, section]
    rows = per_file.groupBy(*by).agg(F.count("*").alias("files"), F.count_if(~F.col("detected")).alias("missed"))
    first = windows.first_n(per_file.filter(~F.col("detected")), by, [file], most).groupBy(*by).agg(F.array_join(F.sort_array(F.collect_list(file)), "|").alias("missed_files"))
    return rows.join(first, by, "left").fillna("", ["missed_files"]).withColumn("is_section_missed", F.col("missed") == F.col("files"))


def selection_summary(runs: DataFrame, case: str, run: str, tools: str) -> DataFrame:
    """For each case: runs, those that chose the tools of the first, distinct choices, the mean number of tools, tools of every run and of any."""
    first = runs.groupBy(case).agg(F.min_by(tools, run).alias("first_tools"))
    rows = runs.join(first, case)
    of = rows.groupBy(case).agg(F.count("*").alias("runs"), F.count_if(F.col(tools) == F.col("first_tools")).alias("same_as_first"), F.countDistinct(F.array_join(tools, "\x1f")).alias("choices"), F.round(F.avg(F.size(tools)), 6).alias("mean_tools"))
    held = runs.select(case, run, F.explode(tools).alias("tool")).groupBy(case, "tool").agg(F.countDistinct(run).alias("n")).join(of.select(case, "runs"), case)
    held = held.groupBy(case).agg(F.count_if(F.col("n") == F.col("runs")).alias("tools_of_all"), F.count("*").alias("tools_of_any"))
    return of.join(held, case, "left").fillna(0, ["tools_of_all", "tools_of_any"])


def ranked_list(df: DataFrame, keys: list[str], order: list[Column], value: str, n: int, name: str) -> DataFrame:
    """(keys, name): the first n values of each key in order, as one text."""
    top = df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("__r") <= n)
    return top.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(F.struct("__r", value)))[value], "|").alias(name))

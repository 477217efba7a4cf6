"""Streaming forms against their batch results, with a file source and availableNow."""

import json
import os
import tempfile
import time
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.operators import detect, windows
from logloom.streaming import live

LINES = ["Jan 24 04:18:10 web systemd[1]: Started Session 42 of user a.", "Jan 24 04:20:10 web sshd[7]: Failed password for root from 10.0.0.1 port 22 ssh2", "Jan 24 05:30:00 web sshd[7]: Failed password for root from 10.0.0.2 port 22 ssh2"]


def files():
    folder = tempfile.mkdtemp(prefix="spark-")
    with open(os.path.join(folder, "a.log"), "w") as f:
        f.write("\n".join(LINES))
    return folder


def run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(60)
    return stream.sparkSession.table(name)


def test_parse_and_windows(spark):
    folder = files()
    lines = live.stream_lines(spark, folder)
    assert sorted(r["template"] for r in run(lines.select("template"), "parsed").collect()) == ["LinuxAuth process=sshd action=ssh_failed_password"] * 2 + ["LinuxSyslog process=systemd action=started_session"]
    counts = run(live.template_counts(live.stream_lines(spark, folder)), "counted", "complete")
    assert counts.agg(F.sum("n")).first()[0] == 6  # each line lies in two windows


def test_append_observations(spark):
    out, mark = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    live.append_observations(live.stream_lines(spark, files()).select("raw_line"), f"{out}/o", mark).awaitTermination(60)
    assert spark.read.parquet(f"{out}/o").count() == 3


def first_events(spark, known):
    """A model of these suffixes of up to one event."""
    return spark.createDataFrame([(len(s), s, 1, e) for s, e in known.items()], "order int, suffix string, rank int, topk array<string>")


def test_score_stream_keeps_history(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame([(i, "h", e) for i, e in enumerate("aabac")], "line_id long, host string, event string").write.json(f"{folder}/in")
    stream = spark.readStream.schema("line_id long, host string, event string").json(f"{folder}/in")
    got = run(live.score_stream(stream, first_events(spark, {"a": ["b"], "": ["a"]}), order=1, topk=1), "scored").collect()
    assert sorted((r["history"], r["event"], r["is_miss"]) for r in got) == [("a", "a", True), ("a", "b", False), ("a", "c", True), ("b", "a", False)]


EVENTS = "line_id long, host string, event string"


def add_file(spark, folder, number, rows):
    """One file more, written elsewhere and moved, so that the stream sees it whole."""
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "f")
    with open(path, "w") as f:
        f.write("\n".join(json.dumps(dict(zip(("line_id", "host", "event"), r, strict=True))) for r in rows))
    os.utime(path, (1_700_000_000 + number, 1_700_000_000 + number))
    os.rename(path, os.path.join(folder, f"{number:03}.json"))


def test_a_lost_stream_goes_on_as_the_batch_model(spark):
    """The stream fails in the midst, is started again, is stopped, and goes on with new files: its rows are those of the batch model."""
    rng = np.random.default_rng(8)
    rows = [(i, f"h{int(rng.integers(0, 4))}", "abcde"[min(4, int(rng.exponential(1.2)))]) for i in range(400)]
    log = spark.createDataFrame(rows, EVENTS)
    past = windows.split_histories(log, ["host"], "line_id", "event", 2, 0.5).withColumnRenamed("event", "target")
    model = detect.fit_next_event(past.filter("is_train"), 2)
    scored = detect.score_next_event(past.filter(F.size("history") == 2), model, 2)
    want = sorted((r["host"], r["target"], "|".join(r["history"]), r["rank"] is None or r["rank"] > 2) for r in scored.collect())

    folder, out, mark = (tempfile.mkdtemp(prefix="spark-") for _ in range(3))
    broken = {"once": True}

    def start():
        source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(folder)
        stream = live.score_stream(source, model, order=2, topk=2)

        def write(batch, number):
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
            if number == 1 and broken.pop("once", False):
                raise RuntimeError("the executor is gone")

        return stream.writeStream.foreachBatch(write).option("checkpointLocation", mark).trigger(availableNow=True).start()

    for i in range(2):
        add_file(spark, folder, i, rows[100 * i : 100 * i + 100])
    with pytest.raises(Exception, match="the executor is gone"):
        start().awaitTermination(120)
    assert not broken
    start().awaitTermination(120)
    for i in range(2, 4):
        add_file(spark, folder, i, rows[100 * i : 100 * i + 100])
    start().awaitTermination(120)
    got = spark.read.parquet(out)
    assert sorted((r["host"], r["event"], r["history"], r["is_miss"]) for r in got.collect()) == want
    assert got.select("batch").distinct().count() == 4


def test_a_silent_host_is_forgotten(spark):
    folder, mark, out = (tempfile.mkdtemp(prefix="spark-") for _ in range(3))

    def run_once(number, events):
        """The rows of one more file; a stream that forgets goes on without new rows, so it is stopped when they are there."""
        add_file(spark, folder, number, [(10 * number + i, "h", e) for i, e in enumerate(events)])
        source = spark.readStream.schema(EVENTS).json(folder)
        query = live.append_observations(live.score_stream(source, first_events(spark, {"": ["a"]}), order=1, topk=1, keep=timedelta(seconds=3)), f"{out}/{number}", mark)
        found, until = [], time.time() + 60
        while not found and time.time() < until and query.isActive:
            time.sleep(0.5)
            if os.path.isdir(f"{out}/{number}") and any(os.path.exists(f"{out}/{number}/{b}/_SUCCESS") for b in os.listdir(f"{out}/{number}")):
                found = spark.read.schema("history string, event string").option("recursiveFileLookup", "true").parquet(f"{out}/{number}").collect()
        query.stop()
        return sorted(map(tuple, found))

    assert run_once(0, "ab") == [("a", "b")]
    time.sleep(5)
    assert run_once(1, "cd") == [("c", "d")]


def arriving(spark, *batches):
    """Lines of files that arrive one after the other, a file in each batch."""
    folder = tempfile.mkdtemp(prefix="spark-")
    for i, lines in enumerate(batches):
        path = os.path.join(folder, f"{i}.log")
        with open(path, "w") as f:
            f.write("\n".join(lines))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return live.stream_lines(spark, folder, files_per_trigger=1)


LATE = [["Jan 24 04:00:10 web x: a"], ["Jan 24 09:00:10 web x: a"], ["Jan 24 09:10:10 web x: a"], ["Jan 24 04:00:20 web x: a", "Jan 24 14:00:10 web x: a"], ["Jan 24 20:00:10 web x: a"]]


def test_late_rows_are_dropped(spark):
    got = run(live.template_counts(arriving(spark, *LATE), size="1 hour", slide="1 hour"), "late").collect()
    assert {r["start"].hour: r["n"] for r in got if r["start"].hour in (4, 9, 14)} == {4: 1, 9: 2, 14: 1}


def test_sessions_of_a_host_end_after_a_gap(spark):
    lines = [["Jan 24 04:00:00 web x: a", "Jan 24 04:10:00 web x: b", "Jan 24 04:40:00 web x: c"], ["Jan 24 09:00:00 web x: d"], ["Jan 24 20:00:00 web x: e"]]
    stream = arriving(spark, *lines).withColumn("host", F.lit("web"))
    got = sorted((r["start"].hour * 60 + r["start"].minute, r["n"]) for r in run(live.host_sessions(stream), "sessions").collect())
    assert got[:3] == [(240, 2), (280, 1), (540, 1)]

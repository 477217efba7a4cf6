"""Composite tables and evaluation against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.operators import datasets, detect, evaluate, windows

RAW = "Jan 24 04:20:10 web sshd[7]: Failed password for root from 10.0.0.1 port 22 ssh2"
HOST_LOG = "row bigint, agent string, timestamp string, full_log string, label string, description string"


def test_host_log_table_and_its_leakage_guard(spark):
    rows = [(7, "b", "1700000000", RAW, "Malicious", "T1110 brute force"), (3, None, "soon", RAW, None, None), (5, "", None, "cron[1]: (root) CMD (x)", "general", ""), (4, "a", "1", "", "1", "x"), (9, "a", "1", None, "1", "x")]
    got = datasets.host_log_table(spark.createDataFrame(rows, HOST_LOG)).orderBy("line_no").collect()
    assert [(r["original_row"], r["agent"], r["timestamp"], r["label"], r["attack_labels"], r["rule_description"]) for r in got] == [(7, "b", 1700000000, "attack", "malicious", "T1110 brute force"), (3, "linux_host", 1, "-", "", ""), (5, "linux_host", 2, "-", "", "")]
    assert [r["event_no"] for r in got] == [1, 1, 2]
    other = [(r[0], "z", "1600000000", r[3], "true", "MITRE T1003 credential dumping") for r in rows]
    again = datasets.host_log_table(spark.createDataFrame(other, HOST_LOG)).collect()
    template = lambda rows: {r["original_row"]: r["event_template"] for r in rows}
    assert template(again) == template(got) and not any("T1" in t for t in template(again).values())
    assert datasets.host_log_table(spark.createDataFrame([], HOST_LOG)).count() == 0


def test_summary_keeps_listed_templates(spark):
    df = spark.createDataFrame([("t1", 5, "-", "h"), ("t1", 9, "attack", None), ("t2", 7, "-", "h")], "event_template string, t bigint, label string, host string")
    got = {(r["kind"], r["name"]): r["n_rows"] for r in datasets.table_summary(df, "event_template", "t", "label", ["host"], ["t2", "gone"], n=1).collect()}
    assert got == {("table", "rows"): 3, ("table", "templates"): 2, ("table", "first_time"): 5, ("table", "last_time"): 9, ("label", "-"): 2, ("label", "attack"): 1, ("host", "h"): 2, ("host", ""): 1, ("top template", "t1"): 2, ("listed template", "t2"): 1, ("listed template", "gone"): 0}


def test_training_sessions(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], 1000 + i, "P", str(i % 3), "C") for i in range(1, 81)], "line_id bigint, host string, t bigint, provider string, event_id string, channel string")
    events = datasets.training_events(("x", rows.filter("line_id <= 40")), ("y", rows.filter("line_id > 40")))
    assert [r["line_id"] for r in events.orderBy("t").collect()] == list(range(1, 81))
    made = datasets.training_sessions(events, probability=0.1, length=15, starts=4).collect()
    per = {}
    for r in made:
        per.setdefault(r["session_id"], []).append(r["event"])
    assert sorted(len(v) for v in per.values()) == [14, 14] + [19] * 4 and all(v.count("<BOS>") == 4 for v in per.values())
    assert "<UNK>" in {r["event"] for r in made} and sorted({r["event_id"] for r in made}) == list(range(1, len({r["event"] for r in made}) + 1))


def test_sampled_lines(spark):
    df = spark.createDataFrame([("long", i) for i in range(0, 200, 2)] + [("short", i) for i in range(9)], "f string, o bigint")
    got = datasets.sampled_lines(df, "f", "o", 10, 5).collect()
    of = lambda f: sorted((r["line_no"], r["o"], r["sampling_applied"]) for r in got if r["f"] == f)
    assert of("long") == [(i + 1, 20 * i, True) for i in range(10)] and of("short") == [(i + 1, i, False) for i in range(9)]


def test_cached_evaluation_is_the_expanded_one(spark):
    """Sequences with counts give what every session by itself gives, direct and cached."""
    rng = np.random.default_rng(10)
    log = spark.createDataFrame([(i, f"h{i % 3}", "abc"[min(2, int(rng.exponential(0.9)))], int(rng.integers(0, 2))) for i in range(900)], "line_id bigint, host string, e string, y int")
    rows = windows.split_histories(log, ["host"], "line_id", "e", 2, 0.5).withColumnRenamed("e", "target")
    model = detect.fit_next_event(rows.filter("is_train"), 2)
    sessions = rows.filter(~F.col("is_train") & (F.size("history") == 2)).select(F.concat("history", F.array("target")).alias("q"), "y", "line_id")
    measures, calibration = datasets.cached_evaluation(datasets.cached_scores(sessions, model, 2), [1, 2])
    last = {tuple(r["q"]): r["y"] for r in sessions.orderBy("line_id").collect()}
    every = sessions.select(F.slice("q", 1, 2).alias("history"), F.element_at("q", 3).alias("target"), "q", "line_id")
    scored = detect.score_next_event(every, model, 2).collect()
    flat = [(i, k, last[tuple(r["q"])], int(r["rank"] is None or r["rank"] > k), round(1 - r["p"], 9)) for i, r in enumerate(scored) for k in (1, 2)]
    df = spark.createDataFrame(flat, "i int, k int, y int, y_pred int, score double")
    assert len(last) < 30 < len(scored)
    for k in (1, 2):
        own = df.filter(F.col("k") == k)
        want = {**evaluate.metrics(evaluate.confusion(own, "y", "y_pred")).first().asDict(), **evaluate.ranking_measures(own, "score", "y").first().asDict()}
        got = measures.filter(F.col("k") == k).first().asDict()
        assert {n: got[n] for n in want} == want
        thresholds = evaluate.calibrate(own, "score", "y", "y_pred")
        assert sorted(map(str, calibration.filter(F.col("k") == k).select(thresholds.columns).collect())) == sorted(map(str, thresholds.collect()))


def test_count_model_reaches_the_optimum(spark):
    """The objective (mean loss and penalty on weights in units of their spread) is that of a plain Newton descent, and no event is left out."""
    rng = np.random.default_rng(12)
    events = [f"e{i}" for i in range(40)]
    rows = [([events[min(39, int(rng.exponential(6)))] for _ in range(6)], float(rng.random()) if rng.random() < 0.9 else None) for _ in range(400)]
    weight = dict(zip(events, rng.normal(size=40), strict=True))
    data = [(i, h, p, int(rng.random() < 1 / (1 + math.exp(-sum(weight[e] for e in h) - (p or 0))))) for i, (h, p) in enumerate(rows)]
    df = spark.createDataFrame(data, "i int, h array<string>, p double, y int").withColumn("score", F.lit("clash"))
    got = {r["i"]: r["score"] for r in detect.count_model(df, "h", ["p"], "y", bits=16)(df).collect()}
    x = np.array([[p or 0.0] + [h.count(e) for e in events] for _, h, p, _ in data])
    x = x[:, x.std(axis=0) > 0]
    z, y = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1), np.array([r[3] for r in data])
    a, w = np.c_[np.ones(len(z)), z], np.zeros(z.shape[1] + 1)
    penalty = np.r_[0, np.full(z.shape[1], 0.01)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a / len(a) + np.diag(penalty), a.T @ (p - y) / len(a) + penalty * w)
    assert np.abs(1 / (1 + np.exp(-a @ w)) - np.array([got[i] for i in range(len(data))])).max() < 1e-3


def test_window_payload(spark):
    lines = spark.createDataFrame([(i, "P EventID=3", [("Image", f"i{i}"), ("User", "u")]) for i in range(1, 8)], "n bigint, t string, p array<struct<key string, value string>>")
    found = spark.createDataFrame([(0, 1, 3, True), (1, 5, 9, False)], "window_id bigint, start_row bigint, target_row bigint, is_anomaly boolean")
    got = {r["window_id"]: r["lines"] for r in detect.window_payload(found, lines, "n", "t", "p").collect()}
    assert [(x["line_number"], x["is_anomalous_line"]) for x in got[0]] == [(1, False), (2, False), (3, True)] and [x["line_number"] for x in got[1]] == [5, 6, 7]
    assert got[0][0]["important_fields"]["image"] == "i1" and got[0][0]["event_id"] == "3" and got[0][0]["line_summary"] == "P EventID=3 | image=i1 | user=u"


@pytest.mark.parametrize("n", [1, 50])
def test_error_samples(spark, n):
    df = spark.createDataFrame([(i, i / 10, [1, 0, None][i % 3], i % 2) for i in range(12)], "key int, s double, y_true int, y_pred int")
    got = datasets.error_samples(df, "key", "s", n).collect()
    assert [r["n_rows"] for r in got if r["quadrant"] == "skipped"] == [4] and len(got) == 1 + 2 * min(n, 2)

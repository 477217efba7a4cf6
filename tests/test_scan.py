"""Scans that are dealt to many tasks, and template mining by blocks, against plain Python."""

import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from logloom.operators import evaluate, scan, templates, windows

SF = "/root/testdata/sf0.001"


def log(spark, n=900, seed=1):
    """One key of most rows, others of few, a null one; orders with gaps, and runs in which a key is rare."""
    rng = np.random.default_rng(seed)
    keys = ["hot" if rng.random() < 0.7 and not 300 < i < 420 else [None, "a", "b", "rare"][min(3, int(rng.exponential(0.8)))] for i in range(n)]
    return [(k, 3 * i + i // 100, f"e{int(rng.integers(0, 9))}", int(rng.integers(0, 2))) for i, k in enumerate(keys)]


def by_key(rows):
    of = {}
    for r in sorted(rows, key=lambda r: r[1]):
        of.setdefault(r[0], []).append(r)
    return of


@pytest.mark.parametrize("span", [5, 40, None])
@pytest.mark.parametrize("halo", [0, 7])
def test_key_blocks(spark, span, halo):
    rows = log(spark)
    df = spark.createDataFrame(rows, "k string, o bigint, e string, v int")
    made, w = scan.key_blocks(df, ["k"], "o", halo=halo, sums={"up_to": F.col("v")}, span=span)
    made = made.withColumn("before", F.collect_list("e").over(w.rowsBetween(-halo, -1)) if halo else F.array().cast("array<string>"))
    blocks = Counter(r["k"] for r in made.groupBy("k", "__b").count().collect())
    got = {(r["k"], r["o"]): (r["__i"], r["__n"], r["up_to"], r["before"]) for r in made.filter("__own").collect()}
    assert len(got) == len(rows)
    for k, own in by_key(rows).items():
        for i, r in enumerate(own):
            assert got[k, r[1]] == (i, len(own), sum(x[3] for x in own[: i + 1]), [x[2] for x in own[max(0, i - halo) : i]]), (k, i)
    assert (blocks["hot"] > 5) == (span in (5, 40))
    most = made.groupBy("k", "__b").count().agg(F.max("count")).first()[0]
    assert span is None or most <= 2 * (span + 2 * max(halo, 1)) + halo


def test_operators_by_blocks(spark, monkeypatch):
    """Windows, chunks, sessions, bursts, splits and continuation lines of a long key are those of the key as one block."""
    df = spark.createDataFrame(log(spark), "k string, o bigint, e string, v int").filter("k IS NOT NULL").withColumn("t", F.col("o"))
    made = {
        "chunks": lambda: windows.chunks_by_key(df, "k", "o", 20, "v"), "detector": lambda: windows.detector_windows(df, "k", "o", "e", 6, 4), "sessions": lambda: windows.start_sessions(df, "k", "o", "t", "e", 30, 3),
        "bursts": lambda: windows.unknown_bursts(df, "k", "o", "e", 0.1), "last": lambda: windows.target_last_windows(df, "k", "o", "e", 9, 5), "split": lambda: windows.split_by_order(df, ["k"], "o", 0.7),
        "continued": lambda: windows.continuation_groups(df, F.col("v") == 1, "k", "o", "e"), "histories": lambda: windows.split_histories(df, ["k"], "o", "e", 4, 0.5),
    }
    whole = {n: sorted(map(str, f().collect())) for n, f in made.items()}
    monkeypatch.setattr(scan, "LEAST_SPAN", 8)
    monkeypatch.setattr(scan, "MOST_SPAN", 8)
    for n, f in made.items():
        assert "__copy" in f()._jdf.queryExecution().analyzed().toString(), n
        assert sorted(map(str, f().collect())) == whole[n], n


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k string, o bigint, e string, v int")
    assert scan.key_blocks(none, ["k"], "o", halo=3)[0].count() == 0
    rows, total = scan.running_sums(none, [F.col("o")], {"s": "v"})
    assert rows.count() == 0 and total == {"s": 0}
    assert templates.mine_templates(none, "e", "o").count() == 0


def test_running_sums_are_dealt(spark):
    rng = np.random.default_rng(4)
    values = [(float(x), int(v) if v else None) for x, v in zip(rng.permutation(5000), rng.integers(0, 9, 5000), strict=True)]
    got, total = scan.running_sums(spark.createDataFrame(values, "x double, v int"), [F.desc("x")], {"s": "v"})
    assert total["s"] == sum(v or 0 for _, v in values) and got.columns == ["x", "v", "s"]
    at, want = 0, {}
    for x, v in sorted(values, reverse=True):
        at += v or 0
        want[x] = at
    assert {r["x"]: r["s"] for r in got.collect()} == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # parts as small as these would be put together
    try:
        got, _ = scan.running_sums(spark.createDataFrame(values, "x double, v int"), [F.desc("x")], {"s": "v"})
        sizes = [r[1] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) <= 3 * np.median(sizes)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["a15_ranking_measures", "a18_calibration", "w06_detector_windows", "w19_round_robin"])
def test_no_window_over_all_rows(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.replace("HashAggregate", "") or name == "a15_ranking_measures"  # the one row of a15 is a plain sum
    for line in plan.splitlines():
        assert not ("Window " in line and line.rstrip().endswith("], []")), line


def test_weights_count_as_copies(spark):
    rng = np.random.default_rng(5)
    few = [(round(float(s), 2), int(y), int(n), int(b)) for s, y, n, b in zip(rng.random(60), rng.integers(0, 2, 60), rng.integers(1, 6, 60), rng.random(60) < 0.2, strict=True)]
    df = spark.createDataFrame(few, "s double, y int, n int, b int")
    many = df.withColumn("c", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("c")
    for f in (lambda d, w: evaluate.ranking_measures(d, "s", "y", weight=w), lambda d, w: evaluate.sweep(d, "s", "y", weight=w), lambda d, w: evaluate.calibrate(d, "s", "y", "b", weight=w)):
        assert sorted(map(str, f(df, "n").collect())) == sorted(map(str, f(many, None).collect()))


# template mining


def plain_grow(texts, similarity):
    clusters, of = [], []
    for t in texts:
        shares = [sum(a == b for a, b in zip(c, t, strict=True)) for c in clusters]
        if shares and max(shares) >= similarity * len(t):
            k = shares.index(max(shares))
            clusters[k] = [a if a == b else "<*>" for a, b in zip(clusters[k], t, strict=True)]
        else:
            k = len(clusters)
            clusters.append(list(t))
        of.append(k)
    return of, clusters


def plain_mine(blocks, similarity, fan):
    """blocks: (node, block) -> [(first line, tokens)]. first line -> (cluster, template)"""
    of, level = {}, {}
    for (node, b), texts in blocks.items():
        texts = sorted(texts)
        k, clusters = plain_grow([t for _, t in texts], similarity)
        heads = [texts[k.index(i)][0] for i in range(len(clusters))]
        of |= {f: heads[i] for (f, _), i in zip(texts, k, strict=True)}
        level.setdefault(node, {})[b] = list(zip(heads, clusters, strict=True))
    found = {}
    for node, parts in level.items():
        while max(parts) > 0:
            joined = {}
            for b, own in parts.items():
                joined.setdefault(b // fan, []).extend(own)
            parts = {}
            for b, own in joined.items():
                own.sort()
                k, clusters = plain_grow([t for _, t in own], similarity)
                heads = [own[k.index(i)][0] for i in range(len(clusters))]
                to = {f: heads[i] for (f, _), i in zip(own, k, strict=True)}
                of = {f: to.get(c, c) for f, c in of.items()}
                parts[b] = list(zip(heads, clusters, strict=True))
        found |= {f: t for own in parts.values() for f, t in own}
    return {f: (c, " ".join(found[c])) for f, c in of.items()}


def messages(n=700):
    """Most of one length and head, rare heads, repeats, nulls, blank and long ones."""
    rng = np.random.default_rng(2)
    word = lambda m: "abcdefghijklmnop"[int(rng.integers(0, m))] * 3
    rows = [f"conn open {word(3)} {word(4)} {word(12)} {word(16)} end" if rng.random() < 0.8 else f"{word(16)} {word(16)} {word(3)} user{i}" for i in range(n)]
    return [(i, m) for i, m in enumerate([*rows, None, "", " \t ", "x " * 3000, rows[0], "10.0.0.1 0x1f <*> <*>"])]


@pytest.mark.parametrize(("span", "fan"), [(10_000, 8), (10, 3)])
def test_templates_against_plain_python(spark, span, fan):
    rows = messages()
    df = spark.createDataFrame(rows, "i bigint, m string").withColumn("template", F.lit("clash"))
    got = {r["i"]: (r["cluster_id"], r["template"]) for r in templates.mine_templates(df, "m", "i", span=span, fan=fan).collect()}
    masked = {r["i"]: r["t"] for r in df.select("i", templates.masked_message(F.col("m")).alias("t")).collect()}
    first = {}
    for i in sorted(masked):
        first.setdefault(masked[i], i)
    seen = spark.createDataFrame([(f, len(t.split(" ")), " ".join(t.split(" ")[:2])) for t, f in first.items()], "f bigint, n int, h string")
    node = {r["f"]: ((r["n"], r["h"]), r["__b"]) for r in scan.key_blocks(seen, ["n", "h"], "f", span=span)[0].collect()}
    blocks = {}
    for t, f in first.items():
        blocks.setdefault(node[f], []).append((f, t.split(" ")))
    assert (len({b for n, b in blocks if n == (7, "conn open")}) > 1) == (span < 100)
    want = plain_mine(blocks, 0.5, fan)
    assert got == {i: want[first[masked[i]]] for i, _ in rows}


def test_large_nodes_go_on_at_their_children(spark):
    df = spark.createDataFrame(messages(), "i bigint, m string")
    got = templates.mine_templates(df, "m", "i", similarity=1.0, span=10, fan=2, most=20)
    masked = {r["i"]: r["t"] for r in df.select("i", templates.masked_message(F.col("m")).alias("t")).collect()}
    assert {r["i"]: r["template"] for r in got.collect()} == masked


def test_template_strategies(spark):
    df = spark.createDataFrame([(1, "P", 7, "Ch", "job a1 done"), (2, "P", 7, None, "job b2 done")], "o bigint, provider string, event_id int, channel string, raw_line string")
    name = lambda s: [r["template"] for r in templates.with_templates(df, s, "o", channel="channel").orderBy("o").collect()]
    assert name("provider_eventid") == ["P EventID=7"] * 2
    assert name("windows_evtx_canonical") == ["EventID 7 Provider P Channel Ch", "EventID 7 Provider P"]
    assert name("drain") == ["job <*> done"] * 2
    assert [tuple(r) for r in templates.template_table(templates.with_templates(df, "drain", "o")).collect()] == [("1", "job <*> done", 2)]
    with pytest.raises(ValueError):
        name("other")

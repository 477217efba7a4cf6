"""Shards of nearest-neighbour lists against brute force, lines of hot words, documents without an id."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from logloom.llm import ann, line_dedup


def brute(x, ids, q, k):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    return [(int(ids[i]), float(d[i])) for i in np.lexsort((ids, d)) if ids[i] != ids[q]][:k]


def test_shards_hold_all_lists():
    rng = np.random.default_rng(1)
    for sizes in (rng.integers(0, 50, 40), np.array([500]), np.array([0, 0, 5]), np.array([1, 250, 1, 99, 2, 300])):
        shards = ann.Shards.of_sizes(sizes, 100)
        visited = rng.random((20, len(sizes))) < 0.3
        seen = np.zeros_like(visited)
        for shard, rows, bits in shards.visits(visited):
            own = np.unpackbits(bits, axis=1)
            for l in range(len(sizes)):
                if shards.of[l] <= shard < shards.of[l] + shards.pieces[l]:
                    seen[rows, l] |= own[:, l - shards.first[shard]].astype(bool)
        assert (seen == visited).all()
        assert all(sizes[shards.of == s].sum() <= 100 for s in range(len(shards.first)) if shards.pieces[shards.of == s].max(initial=0) == 1)
        assert (shards.pieces == np.maximum(1, -(-sizes // 100))).all()


@pytest.mark.parametrize("tile", [3, 1024])
def test_lists_of_a_shard_against_brute_force(monkeypatch, tile):
    """Repeated keys, copies of a vector in number, vectors in several lists, ties, short lists, large and tiny components."""
    monkeypatch.setattr(ann, "TILE", tile)
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(0, 2, (400, 3)))
    x[:150] = x[0]
    x[200:220] *= 1e30
    x[230:240] *= 1e-30
    ids = np.arange(400) * 7
    ids[300:340] = ids[300]
    lists = rng.integers(0, 6, 400)
    lists[390:] = 6
    rows = np.concatenate([np.arange(400), np.arange(0, 400, 3)])  # every third is in a second list
    where = np.concatenate([lists, (lists[::3] + 1) % 7])
    asked = np.arange(0, 400, 5)
    visits = rng.random((len(asked), 7)) < 0.6
    row, got, d = ann.nearest_in_lists(ids[asked], x[asked], visits, where, ids[rows], x[rows], 10)
    for i, q in enumerate(asked):
        there = np.unique(rows[visits[i][where]])
        nearest = {}
        for j in there:
            if ids[j] != ids[q]:
                gap = float(np.sqrt(((x[j] - x[q]) ** 2).sum()))
                nearest[int(ids[j])] = min(gap, nearest.get(int(ids[j]), np.inf))
        want = sorted((gap, j) for j, gap in nearest.items())[:10]
        assert [(float(b), int(a)) for a, b in zip(got[row == i], d[row == i], strict=True)] == want
    assert len(ann.nearest_in_lists(ids[:2], x[:2], np.zeros((2, 7), bool), where, ids[rows], x[rows], 10)[0]) == 0


def test_a_centroid_near_to_many_has_few_links():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3_000, 64))
    x[0] = 0  # among the nearest of all
    graph = ann.CentroidGraph.build(x)
    assert graph.neighbours.shape[1] <= 2 * ann.DEGREE + 2
    assert not graph.all_at_once(16) and graph.all_at_once(3_000)
    seen, more = {0}, [0]
    while more:
        more = [j for i in more for j in graph.neighbours[i].tolist() if j >= 0 and j not in seen and not seen.add(j)]
    assert len(seen) == len(x)
    asked = x[100:300] + rng.normal(0, 0.3, (200, 64))
    walked, far = graph.search(asked, 16)
    first = ann._distances(asked, x).argmin(1)
    assert (walked[:, 0] == first).mean() > 0.95 and np.allclose(far[:, 0], np.sqrt(((asked - x[walked[:, 0]]) ** 2).sum(1)))
    whole = graph.search(asked, 3_000)[0]
    assert (whole[:, 0] == first).all() and (np.sort(whole, 1) == np.arange(3_000)).all()


def test_a_query_moves_once_for_a_shard(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3_000, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, embedding array<float>")
    stored, store = [], ann.materialize
    monkeypatch.setattr(ann, "materialize", lambda df: stored.append(store(df)) or stored[-1])
    got = ann.search(table, F.col("vec_id") % 100 == 0, list_size=30).collect()
    lists = stored[0].select("list").distinct().count()
    moved = [df for df in stored if {"id", "v"} <= set(df.columns) and "list" not in df.columns]
    assert lists > 60 and moved[0].count() <= 30 * 5  # at least 1,024 rows a shard: five at most
    hits = sum(len({r["id"] for r in got if r["query_id"] == q} & {i for i, _ in brute(x.astype(float), np.arange(3_000), q, 10)}) for q in range(0, 3_000, 100))
    assert hits >= 0.9 * 300


def test_a_repeated_key_takes_one_place(spark):
    rows = [(0, [0.0, 1.0])] + [(1, [0.0, 1.0 + i / 1000]) for i in range(30)] + [(i, [0.0, float(i)]) for i in range(2, 12)]
    got = ann.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["rank"], r["id"], r["score"]) for r in got] == [(i, i, float(i - 1)) for i in range(1, 11)]


def test_lines_of_a_hot_word_meet_in_few_rows(spark, monkeypatch):
    """Near copies of one line, all of whose words are common: a line makes a row for each two salts at most, and only lines that are left open make more."""
    monkeypatch.setattr(line_dedup, "HOT_TOKEN", 40)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join([*words, f"a{i % 20}", f"b{i // 20}"])) for i in range(400)]
    rows, store = [], line_dedup.materialize

    def counted(df):
        got = store(df)
        if "complete" in df.columns and "bucket" in df.columns:
            rows.append(got.filter("bits is not null").groupBy("h").count())
        return got

    monkeypatch.setattr(line_dedup, "materialize", counted)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)).collect()}
    assert got == {k: t if k == 0 else "" for k, t in docs}
    made = rows[1].agg(F.sum("count")).first()[0]
    assert made <= 400 * 10 * 5  # ten salts, and five of the seven words of a prefix are hot
    assert rows[1].agg(F.max("count")).first()[0] <= 10 * 5


def test_lines_left_open_meet_all(spark, monkeypatch):
    """Lines of hot words whose closest one by sketch is not similar, but another one is."""
    monkeypatch.setattr(line_dedup, "HOT_TOKEN", 15)
    rng, docs = np.random.default_rng(6), []
    for i in range(150):
        docs.append((i, " ".join(f"w{j}" for j in rng.choice(14, 9, replace=False))))
    seen, want = [], {}
    for k, t in docs:
        s = frozenset(t.split())
        want[k] = "" if any(5 * len(s & o) >= 4 * len(s | o) for o in seen) else t
        seen.append(s)
    for few in ({}, {"CLOSEST": 1, "CLOSEST_IF_SURE": 1}):
        for name, value in few.items():
            monkeypatch.setattr(line_dedup, name, value)
        got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3))
        assert {r["doc_id"]: r["text"] for r in got.collect()} == want


def test_documents_without_an_id_are_judged(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(3, a), (None, a), (None, a + " z"), (None, b), (None, b), (None, b + " z"), (2**63 - 1, c), (None, c), (None, None), (-5, "one"), (None, "two")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    left = [(r["doc_id"], r["text"]) for r in cp.drop_near_duplicates(spark, docs, "").collect()]
    assert {(3, a), (-5, "one"), (None, "two"), (None, None)} <= set(left) and len(left) == 6
    assert sum((t or "").startswith("b0 ") for _, t in left) == 1 and sum(t == c for _, t in left) == 1

"""Near-dedup against all pairs' Jaccard similarity."""

import random
from itertools import combinations

import pytest
from conftest import frame

import corpus_pipeline as cp
from logloom.llm import near_dedup, simhash


def shingles(text, k=5):
    w = text.encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def plain_kept(rows):
    sets, low = {k: shingles(t) for k, t in rows}, {k: k for k, _ in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if similar(sets[a], sets[b])]
    for _ in rows:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return {k for k in low if low[k] == k}


def changed(words, spots):
    out = list(words)
    for i in spots:
        out[i] += "x"
    return " ".join(out)


def edited(seed=7):
    """Texts of 400 words; copies with 1 to 11 changed words, on both sides of 0.8, and texts that share a passage only."""
    r, rows, key = random.Random(seed), [], 0
    passage = " ".join(f"p{i}" for i in range(60))
    for _ in range(12):
        words = [f"w{r.randrange(10**6)}" for _ in range(400)]
        rows.append((key, " ".join(words)))
        for n in range(1, 12):
            key += 1
            rows.append((key, changed(words, r.sample(range(400), n))))
        key += 1
        rows.append((key, passage + " " + " ".join(f"w{r.randrange(10**6)}" for _ in range(100))))
        key += 1
    return rows + [(key, "one two"), (key + 1, "ONE\ttwo"), (key + 2, "one two three")]


@pytest.mark.parametrize("per_bucket", [1, 32])
def test_all_pairs_of_the_similarity_are_found(spark, monkeypatch, per_bucket):
    monkeypatch.setattr(near_dedup, "PER_BUCKET", per_bucket)
    rows = edited()
    got = near_dedup.keep_one_of_each(frame(spark, [(k, t, "en") for k, t in rows]).repartition(5))
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(plain_kept(rows))


def test_proposed_groups_change_nothing(spark):
    rows = edited(8)
    docs = frame(spark, [(k, t, "en") for k, t in rows])
    wrong = frame(spark, [(k, k // 5) for k, _ in rows] + [(None, 0)], "doc_id bigint, component_id bigint")
    for near in (wrong, simhash.near_duplicates(docs, shingle=5)):
        assert sorted(r["doc_id"] for r in near_dedup.keep_one_of_each(docs, near).collect()) == sorted(plain_kept(rows))


def test_stage_drops_copies_beyond_the_old_bits(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(words)), (2, changed(words, range(10, 400, 50)))]
    assert similar(*(shingles(t) for _, t in rows)) and (simhash.simhash(rows[0][1], 5) ^ simhash.simhash(rows[1][1], 5)).bit_count() > cp.NEAR_BITS
    assert [r["doc_id"] for r in cp.drop_near_duplicates(spark, frame(spark, [(k, t, "en") for k, t in rows]), "").collect()] == [1]


def test_rows_of_one_key_are_judged_by_their_texts(spark, odd, empty):
    a, b = (" ".join(f"{c}{i}" for i in range(50)) for c in "ab")
    got = near_dedup.keep_one_of_each(frame(spark, [(1, a, "en"), (2, a, "en"), (2, b, "en"), (2, b, "en"), (None, a, "en")]))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got.collect()) == sorted([(0, a), (1, a), (2, b)])
    assert sorted(r["doc_id"] or 0 for r in near_dedup.keep_one_of_each(odd).collect()) == [0, 1, 4, 5, 6]
    assert near_dedup.keep_one_of_each(empty).count() == 0


def test_sets_are_moved_for_close_pairs_only(spark, monkeypatch):
    rows = edited(9)
    source = spark.createDataFrame([(k, t, k) for k, t in rows], "key bigint, text string, th bigint").repartition(3)
    table = near_dedup.materialize(near_dedup.set_table(source, 5))
    h = {k: near_dedup.identity(near_dedup.shingle_set(t, 5)) for k, t in rows}
    sets = {h[k]: shingles(t) for k, t in rows}
    pairs = [tuple(sorted(x)) for x in combinations(sets, 2)]
    made, store = [], near_dedup.materialize
    monkeypatch.setattr(near_dedup, "materialize", lambda df: made.append(store(df)) or made[-1])
    got = near_dedup.verified(source, table, spark.createDataFrame(pairs, "a bigint, b bigint"), 5, 4, 5)
    want = {(a, b) for a, b in pairs if similar(sets[a], sets[b])}
    assert {tuple(r) for r in got.collect()} == want
    near = {x for pair in pairs if len(sets[pair[0]] ^ sets[pair[1]]) < 150 for x in pair}
    assert len(near) < len(sets)  # texts that share a passage only
    assert [df.filter(df.h.isin(list(set(sets) - near))).count() for df in made if "tokens" in df.columns] == [0]

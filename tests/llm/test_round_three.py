"""The filter audit, the centroid clustering and the mixing against plain Python."""

import hashlib
import math
import re
import time
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm import centroids, chat, filter_audit, mixing, transducer
from logloom.llm.words import bytes_of

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", " \n\t", "a", " a a b", "Ünï ÜNÏ A&B #1", "x" * 70 + " " + "x" * 70 + " " + "x" * 69 + "y", "\U0001f600 \U0001f600\x0b\x1c\x85 é", "eightbyt eightbyT eightbyte ninebytes", "last", "Last "]


def plain_counts(text):
    text = text or ""
    words = WORDS.findall(text)
    return len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), len(re.findall("[#$%&*|]", text))


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_transducer_against_regular_expressions(monkeypatch, block):
    monkeypatch.setattr(transducer, "BLOCK", block)
    rng = np.random.default_rng(1)
    texts = TEXTS + ["".join(rng.choice(list("aB é\n#"), int(n))) for n in rng.integers(0, 300, 60)] + ["w" * 500, "w " * 400]
    for column in (pa.array(texts), pa.array([*texts, "cut"], pa.large_string()).slice(2), pa.array([], pa.string())):
        got = transducer.count_bytes(*bytes_of(column), transducer.byte_classes())
        assert list(zip(*(v.tolist() for v in got.values()), strict=True)) == [plain_counts(t) for t in column.to_pylist()]


def test_hash_table_verifies(monkeypatch):
    """Equal hashes of different words, or of equal words of different rows, are no copies."""
    monkeypatch.setattr(transducer.SpanTable, "hashes", lambda self, start, end, row: np.full(len(start), 3, np.uint64))
    texts = ["a b a c b " + "z" * 80 + " " + "z" * 80 + " " + "z" * 79 + "a", "a b a"]
    assert transducer.count_bytes(*bytes_of(pa.array(texts)), transducer.byte_classes())["n_distinct"].tolist() == [5, 2]


def plain_audit(docs, labels):
    good, toxic, least, cells = set(), set(), {}, Counter()
    for k, q, t in labels:
        good |= {k} if q == 1 else set()
        toxic |= {k} if t == 1 else set()
    for k, text, _ in docs:
        if k is not None:
            least[text or ""] = min(least.get(text or "", k), k)
    for k, text, source in docs:
        n, distinct, capitals, points, marks = plain_counts(text)
        fails = {"A": n < 50, "B": 100 * distinct < 65 * n, "C": 100 * capitals > 5 * points, "D": marks > 0, "E": k is not None and least[text or ""] < k}
        cells[source or "", frozenset(f for f in fails if fails[f]), k is not None and k in good, k is not None and k in toxic] += 1
    rows = {}
    for part in {c[0] for c in cells}:
        own = [(f, n, g, t) for (p, f, g, t), n in cells.items() if p == part]
        for order in permutations("ABCDE"):
            for i, x in enumerate(order):
                before = set(order[:i])
                here = [(n, g, t) for f, n, g, t in own if x in f and not f & before]
                rows[part, "".join(order), i + 1] = [
                    sum(n for f, n, _, _ in own if not f & (before | {x})), sum(n for n, _, _ in here), sum(n for f, n, _, _ in own if x in f and f & before),
                    sum(n for f, n, _, _ in own if f == {x}), sum(n for n, g, _ in here if g), sum(n for n, _, t in here if t),
                ]
        for x in "ABCDE":
            all_of = [k for k in rows if k[0] == part and k[1][k[2] - 1] == x]
            shapley = sum(rows[k][1] for k in all_of)
            for k in all_of:
                rows[k].append(shapley)
    return rows


def test_audit_against_plain_python(spark):
    rng = np.random.default_rng(11)
    made = [" ".join(rng.choice(["alpha", "Beta", "GAMMA", "d#"], int(n))) for n in rng.integers(0, 90, 12)] + [" ".join(map(str, range(60))), " ".join(map(str, range(60))) + " #"] + TEXTS
    docs = [(int(i), made[int(t)], ["s", "S2", "", None][int(s)]) for i, t, s in zip(range(80), rng.integers(0, len(made), 80), rng.integers(0, 4, 80), strict=True)]
    docs += [docs[5], docs[5], (None, made[12], "s"), (None, made[12], "s"), (7, "another text of a known key", "s")]
    labels = [(i, int(rng.integers(0, 2)), int(rng.integers(0, 2))) for i in range(0, 60, 2)] + [(4, 1, None), (4, 0, 1), (None, 1, 1), (1000, 1, 1), (9, None, None)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("mask", F.lit("clash")).withColumn("n_words", F.lit(1)).withColumn("good", F.lit(0))
    got = filter_audit.audit(d, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {tuple(r[:3]): list(r[3:]) for r in got.collect()} == plain_audit(docs, labels)
    assert filter_audit.audit(d.limit(0), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).count() == 0


def vectors(spark, rows):
    kind = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("v", T.StringType()), T.StructField("cluster", T.IntegerType())])
    return spark.createDataFrame([(k, v, "clash", 1) for k, v in rows], kind)


def plain_clusters(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    middle = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(middle))
    for _ in range(rounds):
        of = {}
        for _, v in kept:
            of.setdefault(near(v)[1], []).append(v)
        middle = [[sum(x) // len(of[i]) for x in zip(*of[i], strict=True)] if i in of else c for i, c in enumerate(middle)]
    return sorted(((i, *near(v)[::-1]) for i, v in kept), key=str), middle


@pytest.mark.parametrize("dense", [4, 1 << 16])
def test_clusters_against_plain_python(spark, monkeypatch, dense):
    monkeypatch.setattr(centroids, "DENSE", dense)
    rng = np.random.default_rng(12)
    f32 = lambda a: [float(x) for x in np.asarray(a, np.float32)]
    rows = [(i, f32(rng.normal(rng.integers(-2, 3), 0.3, 64))) for i in range(300)]
    rows += [rows[3], rows[3], (900, rows[4][1]), (901, f32([0] * 64)), (None, rows[5][1]), (None, rows[6][1]), (902, f32([1e6] + [0] * 63))]
    odd = [(903, None), (904, []), (905, f32([1] * 63)), (906, [float("nan")] + [0.0] * 63), (907, [None] + [0.0] * 63), (908, [float("-inf")] + [0.0] * 63)]
    got, middle = centroids.cluster(vectors(spark, rows + odd))
    want, want_middle = plain_clusters(rows)
    assert middle.tolist() == want_middle
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_few_or_no_vectors(spark):
    one = [0.5] * 64
    got, middle = centroids.cluster(vectors(spark, [(1, one), (2, one), (3, [0.0] * 64)]))
    assert len(middle) == 3 and sorted(r["distance"] for r in got.collect()) == [0, 0, 0]
    got, middle = centroids.cluster(vectors(spark, [(1, None)]))
    assert got.columns == ["vec_id", "cluster", "distance"] and got.count() == 0 and len(middle) == 0


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, budget, free = {}, sum(sizes.values()), set(order)
    while free:
        share = {s: budget * weight[s] / sum(weight[f] for f in free) for s in free}
        above = {s for s in free if share[s] > most * sizes[s]}
        if not above:
            return target | share
        target |= {s: most * sizes[s] for s in above}
        budget -= sum(most * sizes[s] for s in above)
        free -= above
    return target


def mixed(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("size", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("target", F.lit(1))
    return mixing.mix(df, **options)


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(13)
    source = ["a", "B", "é", "\U0001f600", "￿", None, "", "tiny"]
    rows = [(i, "w " * int(rng.lognormal(3, 1.2)), source[min(7, int(rng.exponential(1.2)))]) for i in range(6000)] + [(9001, "w " * 20_000, "a"), (9002, None, "a"), (9003, "", None), (9004, "\x1cone\tTwo\x85", "tiny")]
    rows += [(9005, "same row", "B")] * 50 + [(None, "no key", "a")] * 2 + [(9006, None, "empty source")]
    got = mixed(spark, rows).collect()
    sizes = Counter()
    for _, text, s in rows:
        sizes[s] += len(WORDS.findall(text or ""))
    want = plain_targets(sizes)
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((k, s, len(WORDS.findall(t or ""))) for k, t, s in rows)
    words, documents, expected = Counter(), Counter(), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]], rel=1e-12)
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        assert math.floor(rate) <= r["times"] <= math.ceil(rate) <= 3
        words[r["source"]] += r["size"] * r["times"]
        documents[r["source"]] += r["times"]
        expected[r["source"]] += rate
    for s in sizes:
        large = [n for r in got if r["source"] == s and 1000 * (n := r["size"]) > sizes[s]]
        least = min(large, default=0) if sum(large) == sizes[s] else 0  # no smaller ones are left to make up
        assert abs(words[s] - want[s]) <= 1 + sizes[s] / 2000 + least / 2, s
        assert abs(documents[s] - expected[s]) <= 2 + (0.25 if s == "a" else 0.05) * expected[s], s  # the huge document of a is made up by many others
    again = mixed(spark, rows[::-1]).collect()
    show = lambda rows: sorted(map(str, rows))
    assert show(again) == show(got)
    assert mixed(spark, []).count() == 0


def test_flight_keeps_both_totals_and_expectations():
    rng = np.random.default_rng(3)
    size = np.sort(rng.lognormal(4, 2, 400).astype(np.int64))[::-1]
    drawn = np.zeros(400)
    for _ in range(300):
        p = np.full(400, 0.3)
        q = mixing.flight(size, p, rng.random(800))
        assert ((q > 0) & (q < 1)).sum() <= 2 and abs(q.sum() - 120) < 1e-6 and abs(q @ size - 0.3 * size.sum()) < 1e-6 * size.sum()
        drawn += q
    assert abs(drawn / 300 - 0.3).max() < 0.13
    for size in ([5, 5, 5, 5], [9, 1, 1, 1], [0, 0, 0], [7], [], [3, 2, 1, 0]):
        size = np.array(size, np.int64)
        q = mixing.land(size, mixing.flight(size, np.full(len(size), 0.4), rng.random(20)))
        assert set(q) <= {0.0, 1.0}


# chat formatting, in proportion to the number of turns


def test_long_conversations_take_linear_work(spark):
    """8,000 turns of 500 characters: formatted, read back and masked in seconds; an empty table gives no rows."""
    n = 8000
    rows = spark.range(n).select(F.lit(1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("<turn:\\ <é"), F.repeat(F.md5(F.col("id").cast("string")), F.lit(16))).alias("text"))
    texts = {r["turn"]: (r["role"], r["text"]) for r in rows.collect()}
    began = time.time()
    got = chat.render(rows).withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"), F.col("loss_turns"))).first()
    assert time.time() - began < 20
    assert [(t["role"], t["text"]) for t in got["turns"]] == [texts[i] for i in range(n)]
    assert got["loss"] == "".join(texts[i][1] for i in range(1, n, 2))
    assert all(got["formatted"][s["start"] : s["end"]].replace("\\l", "<").replace("\\b", "\\") == texts[t["turn"] - 1][1] for s, t in list(zip(got["loss_spans"], got["loss_turns"], strict=True))[:50])
    assert chat.render(rows.limit(0)).count() == 0


def test_each_different_chunk_of_a_batch_is_looked_up_once(monkeypatch):
    import pyarrow as pa
    import sentencepiece

    from logloom.llm import sentencepiece_bpe

    data = sentencepiece_bpe.model_bytes()
    lib, codec = sentencepiece.SentencePieceProcessor(model_proto=data), sentencepiece_bpe.load.__wrapped__(data)
    codec.cache.most, asked = 2, []  # a cache that holds less than a text's words
    monkeypatch.setattr(codec, "chunk_ids", lambda chunk, own=codec.chunk_ids: asked.append(chunk) or own(chunk))
    odd = ["", None, " a", "a ", "a  b", "\u2581x", "x\u2581\u2581y", "   ", "\U0001f600 ok\x00 \u00e9", "\ufffd", "\U0001f469\u200d\U0001f4bb b"]
    texts = ["one two three four five six", *odd] * 20
    array = pa.array(["cut off", *texts], pa.string()).slice(1)
    got = {k: v.to_pylist() for k, v in codec.encode_all(array, ("n_tokens", "ids", "ids_text", "decoded")).items()}
    assert len(asked) == len(set(asked))
    for i, x in enumerate(texts):
        ids = lib.encode(x or "")
        assert (got["n_tokens"][i], got["ids"][i], got["ids_text"][i], got["decoded"][i]) == (len(ids), ids, ",".join(map(str, ids)), lib.decode(ids)), x


def test_workers_drop_the_codec_before_other_work(spark):
    from logloom.llm import sentencepiece_bpe

    docs = spark.range(0, 4000, 1, 4).select(F.concat_ws(" ", *[F.md5(F.concat("id", F.lit(f"-{i}"))) for i in range(20)]).alias("text"))
    assert sentencepiece_bpe.encode(docs, sentencepiece_bpe.model_bytes(), outputs=("n_tokens",)).filter("n_tokens > 0").count() == 4000

    def alive(batches):
        import gc

        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([sum(type(o).__name__ == "Codec" for o in gc.get_objects())])], ["n"])

    assert {r["n"] for r in spark.range(0, 8, 1, 8).mapInArrow(alive, "n bigint").collect()} == {0}


# line dedup: entries are dealt out many to a row


def test_line_entries_go_by_ranges_of_buckets(spark, monkeypatch):
    from logloom.llm import line_dedup
    from logloom.llm.common import materialize
    from test_operators import brute_lines

    rng = np.random.default_rng(9)
    base = [[f"w{x}" for x in rng.integers(0, 400, rng.integers(3, 30))] for _ in range(90)]

    def line():
        own = list(base[rng.integers(90)])
        own[rng.integers(len(own))] = f"y{rng.integers(40)}"
        return " ".join(own)

    docs = [(i, "\n".join(line() for _ in range(6))) for i in range(120)]
    frame = spark.createDataFrame(docs, "key bigint, text string").repartition(3)
    table = materialize(line_dedup.line_table(frame.withColumn("th", F.xxhash64("text"))))
    levels = line_dedup.word_levels(table)
    ranges = line_dedup.ranges_for(levels, 8, 4, 5)
    rows = line_dedup.prefixes(frame, spark.sparkContext.broadcast(levels), ranges, 4, 5).collect()
    assert ranges == 8 and len(rows) <= 3 * 8 and sum(len(r["bucket"]) for r in rows) > 1000
    for r in rows:
        assert {((b >> 32) + 2**31) * ranges >> 32 for b in r["bucket"]} == {r["range"]} and len({len(r[c]) for c in ("bucket", "h", "sketch", "sketch2", "key", "number", "n", "place")}) == 1
    want = brute_lines(docs)
    for most in (line_dedup.RANGE_ROWS, 20):  # few ranges, then many, dealt out in small pieces
        monkeypatch.setattr(line_dedup, "RANGE_ROWS", most)
        monkeypatch.setattr(line_dedup, "DEALT_ROWS", most)
        got = line_dedup.dedup_lines(frame, key="key")
        assert {r["key"]: r["text"] for r in got.collect()} == want


def test_ranges_are_put_together_again_and_copies_go(monkeypatch):
    from logloom.llm import line_dedup

    monkeypatch.setattr(line_dedup, "RANGE_ROWS", 25)
    monkeypatch.setattr(line_dedup, "HELD_ROWS", 30)
    rng = np.random.default_rng(2)
    held, rows = [], []
    for key in range(60):
        bucket, h = rng.integers(-(2**63), 2**63 - 1, 4), np.array([7, 8, 9, key], np.int64)
        bucket[:3] = [5, 5, -(2**62)]
        held.append((bucket, h, h, h, np.full(4, key), *(np.full(4, x, np.int32) for x in (key, 3, 0))))
        rows += list(zip(bucket.tolist(), h.tolist(), strict=True))
    dealt = [line_dedup._dealt(held[i : i + 7], 16) for i in range(0, 60, 7)]
    table = pa.Table.from_batches(dealt).sort_by("range").combine_chunks()
    pieces = list(line_dedup._by_range(table.to_batches(max_chunksize=5)))
    bucket, h, key = (np.concatenate([x[k] for x in pieces]) for k in ("bucket", "h", "key"))
    assert (np.diff(bucket) >= 0).all() and max(len(x["h"]) for x in pieces) <= 30
    found = list(zip(bucket.tolist(), h.tolist(), strict=True))
    assert set(found) == set(rows) and len(found) < len(rows)
    assert all(key[[i for i, f in enumerate(found) if f == x]].min() == 0 for x in ((5, 7), (5, 8), (-(2**62), 9)))


def test_only_lines_with_a_sought_word_are_kept():
    from logloom.llm.words import Lines

    column = pa.array(["a b\nc d a", None, "d\n\n e e c", ""], pa.string())
    every = Lines(column)
    sought = every.token[every.line == 1][:1]  # a word of the second line
    some = Lines(column, lambda word: np.isin(word, sought))
    lines = [k for k in range(len(every.n)) if sought[0] in every.token[every.line == k]]
    assert some.owner.tolist() == every.owner[lines].tolist() and some.number.tolist() == every.number[lines].tolist() and some.n.tolist() == every.n[lines].tolist()
    assert some.token.tolist() == [t for k in lines for t in every.token[every.line == k].tolist()]
    assert len(Lines(column, lambda word: np.zeros(len(word), bool)).n) == 0

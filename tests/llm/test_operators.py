"""Every operator against brute force on small tables, and on odd ones: nulls, empty and long texts, ties, repeats, clashing names."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from logloom.llm import ann, chat, decontaminate, graph, language_id, line_dedup, quality, secrets, sentencepiece_bpe, simhash, suffix_dedup

SF = "/root/testdata/sf0.001"


def words(rng, n, vocabulary=60):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# 1 chat formatting


def fold(spark, rows):
    got = chat.fold(spark.createDataFrame(rows, "conv_id int, seq int, kind string, turn int, role string, text string"))
    return {(r["conv_id"], r["turn"]): (r["role"], r["text"]) for r in got.collect()}


def test_fold_deltas_edits_and_regenerations(spark):
    rows = [
        (1, 1, "message", 0, "user", "hi"), (1, 2, "message", 1, "assistant", "a"), (1, 3, "delta", 1, None, "b"), (1, 4, "message", 2, "user", "more"),
        (1, 5, "edit", 0, None, "hello"), (1, 6, "regenerate", 1, "assistant", "c"), (1, 7, "delta", 1, None, "d"), (1, 8, "message", 2, "user", "again"),
        (2, 1, "delta", 0, "user", "x"), (2, 2, "delta", 0, None, "y"), (2, 3, "odd", 1, None, None), (None, 1, "message", None, None, "z"),
    ]
    assert fold(spark, rows) == {(1, 0): ("user", "hello"), (1, 1): ("assistant", "cd"), (1, 2): ("user", "again"), (2, 0): ("user", "xy"), (2, 1): ("", ""), (None, None): ("", "z")}
    assert fold(spark, []) == {}


def test_render_reads_back(spark):
    texts = ["", "</turn>\n", "<turn:user\n", "\\l\\b\\\\n<", "é\U0001f600", "\\### Assistant: </turn> ok", "long " * 50_000]
    rows = [(1, i, "assistant" if i % 2 else "us<er\nx\\n", t) for i, t in enumerate(texts)]
    got = chat.render(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).withColumn("turns", chat.read_back(F.col("formatted"))).first()
    assert [(t["role"], t["text"]) for t in got["turns"]] == [(r, t) for _, _, r, t in rows]
    undo = lambda s: s.replace("\\l", "<").replace("\\b", "\\")
    assert [undo(got["formatted"][s["start"] : s["end"]]) for s in got["loss_spans"]] == texts[1::2]


def test_event_log_folds_back(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, "user", "long text \U0001f600"), (1, 3, None, "x"), (1, 3, None, "x"), (2, 0, "assistant", ""), (3, None, "user", "odd")]
    log = chat.event_log(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").withColumn("seq", F.lit("clash")))
    assert {r["kind"] for r in log.collect()} == {"message", "delta", "edit", "regenerate"}
    got = sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in chat.fold(log).collect())
    assert got == [(1, 1, "user", "hi"), (1, 2, "assistant", ""), (1, 3, "user", "long text \U0001f600"), (1, 4, "", "x"), (1, 5, "", "x"), (2, 1, "assistant", ""), (3, 1, "user", "odd")]
    assert chat.event_log(log.select("conv_id", "turn", "role", "text").filter("conv_id > 9")).count() == 0


# 2 quality classifier


def test_quality_learns_and_scores(spark, odd, empty):
    rng = random.Random(1)
    docs = [(i, words(rng, 60) if i % 2 else "spam spam | spam | " * 10 + words(rng, 5), None) for i in range(200)]
    table, labels = spark.createDataFrame(docs, "doc_id bigint, text string, lang string"), spark.createDataFrame([(i, i % 2) for i in range(100)] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    model = quality.fit(table, labels)
    got = {r["doc_id"]: r for r in quality.score(table, model).collect()}
    assert all(got[i]["predicted"] == i % 2 for i in range(100, 200))
    out = quality.score(odd.withColumn("score", F.lit("clash")), model)
    assert out.columns == ["doc_id", "text", "lang", "score", "predicted"] and out.count() == odd.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out.collect())
    assert quality.score(empty, model).count() == 0
    alone = quality.fit(empty, labels)
    assert quality.score(odd, alone).agg(F.min("score"), F.max("score")).first() == (0.5, 0.5)


def test_dual_coordinate_descent_separates():
    rows = [np.array([0, 1]), np.array([0, 2]), np.array([3]), np.array([3, 4])]
    w, b = quality.dual_coordinate_descent(rows, np.array([1.0, 1.0, -1.0, -1.0]), np.ones(5), np.ones(4) * 10, epochs=50)
    assert all(np.sign(w[r].sum() / np.sqrt(len(r)) + b) == y for r, y in zip(rows, (1, 1, -1, -1), strict=True))


# 3 benchmark decontamination


def brute_contamination(docs, bench, window=10):
    find = lambda t: re.findall(decontaminate.WORDS, "".join(c.lower() if c.isascii() else c for c in t or ""))
    pats = defaultdict(set)
    for i, t in bench:
        w = find(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            pats[tuple(w[k : k + window])].add(str(i) if i is not None else "")
    out = []
    for t in docs:
        w, hit, items = find(t), set(), set()
        for p, ids in pats.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    items |= ids
        out.append((len(w), len(hit), sorted(items)))
    return out


@pytest.mark.parametrize("most", [200_000, 7])
def test_decontamination_by_brute_force(spark, most):
    rng = random.Random(3)
    bench = [(i, words(rng, n, 4)) for i, n in enumerate([12, 25, 3, 1, 10])] + [(8, None), (9, ""), (None, words(rng, 2, 4)), (1, "W1, w2! w3")]
    docs = [words(rng, rng.randrange(80), 4) for _ in range(40)] + [None, "", "W1-W2 É", "w0 " * 3000]
    got = decontaminate.scan(spark.createDataFrame([(i, t, 0) for i, t in enumerate(docs)], "doc_id bigint, text string, n_words int"), spark.createDataFrame(bench, "item_id bigint, text string"), max_windows=most).collect()
    got = {r["doc_id"]: (r["n_words"], sum(s["end"] - s["start"] for s in r["hit_spans"]), r["items"]) for r in got}
    assert [got[i] for i in range(len(docs))] == brute_contamination(docs, bench)


def test_decontamination_of_empty_tables(spark, odd, empty):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.scan(odd, none).filter(F.size("items") > 0).count() == 0
    assert decontaminate.scan(empty, none).count() == 0


# 4 line dedup


def brute_lines(docs, p=4, q=5):
    seen, out = [], {}
    order = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0))
    for key, text in order:
        if text is None:
            out[key] = None
            continue
        left = []
        for line in text.split("\n"):
            s = frozenset(line.encode().lower().split())
            if not s or not any(q * len(s & o) >= p * len(s | o) for o in seen):
                left.append(line)
            if s:
                seen.append(s)
        out[key] = "\n".join(left)
    return out


def test_line_dedup_by_brute_force(spark):
    rng = random.Random(4)
    base = [words(rng, rng.randrange(1, 25), 300) for _ in range(60)]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(6)):
            w = rng.choice(base).split()
            if rng.random() < 0.6:
                w[rng.randrange(len(w))] = f"x{rng.randrange(30)}"
            lines.append(" ".join(w))
        docs.append((i, "\n".join([*lines, "  ", "Common Line here"])))
    docs += [(-1, None), (100, "")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)).collect()}
    assert got == brute_lines(docs)


def test_line_dedup_when_hot_or_unresolved(spark, monkeypatch):
    rng = random.Random(5)
    docs = [(i, "\n".join(" ".join(["the", "of", *(f"z{rng.randrange(6)}" for _ in range(5))]) for _ in range(3))) for i in range(80)]
    monkeypatch.setattr(line_dedup, "HOT_TOKEN", 20)
    monkeypatch.setattr(line_dedup, "CLOSEST", 1)
    monkeypatch.setattr(line_dedup, "CLOSEST_IF_SURE", 1)
    monkeypatch.setattr(line_dedup, "SMALL_BUCKET", 3)
    monkeypatch.setattr(line_dedup, "TILE", 5)
    monkeypatch.setattr(line_dedup, "HELD_ROWS", 50)
    monkeypatch.setattr(line_dedup, "HELD_PAIRS", 10)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == brute_lines(docs)


def test_line_dedup_of_odd_rows(spark, odd, empty):
    got = line_dedup.dedup_lines(odd.withColumn("n_lines", F.lit("clash")))
    assert got.columns == ["doc_id", "text", "lang", "n_lines", "n_removed"] and got.count() == odd.count()
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[1]["text"] is None and by[2]["text"] == "" and by[3]["text"] == " \n\t " and by[None]["text"] == "no key here"
    assert by[6]["text"].endswith("with lines\n") and by[7]["text"] == ""
    assert line_dedup.dedup_lines(empty).count() == 0


# 5 nearest neighbours


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 1, (300, 16)) for c in rng.normal(0, 3, (8, 16))]).astype(np.float32)
    x[500:1200] = x[500]  # one vector holds a third of the rows
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [None] * 16), (None, [1.0] * 16)]
    got = defaultdict(list)
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    for r in ann.search(table, F.col("vec_id") % 50 == 0, list_size=64).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["id"], r["score"]))
    hits = total = 0
    for q in range(0, len(x), 50):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        best = [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:10]
        assert len(got[q]) == 10 and all(abs(s - d[i]) < 1e-12 for i, s in got[q])
        hits += len(set(best) & {i for i, _ in got[q]})
        total += 10
    assert hits / total >= 0.9 and set(got) == set(range(0, len(x), 50))


def test_few_vectors_give_all(spark):
    table = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id bigint, embedding array<float>")
    got = ann.search(table, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["rank"], r["id"], r["score"]) for r in got] == [(i, i, float(i)) for i in range(1, 5)]
    assert ann.search(table.filter("vec_id > 10"), F.col("vec_id") == 0).count() == 0


# 6 secret scans


BASE = (("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 12), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16))


def test_base_spans_by_brute_force(spark):
    rng = random.Random(6)
    parts = ["password", "Token", "api_key", "APIKEY", "=", ":", " ", "'", '"', "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "secret=short:abcdefghijklmnop", "é\U0001f600", "x.y-z_w/+=", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(150)] + [None, ""]
    got = {r["i"]: r["s"] for r in secrets.scan(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).select("i", F.col("spans").alias("s")).collect()}
    for i, t in enumerate(texts):
        want = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE) for m in p.finditer(t or "") if ok(m))
        assert sorted(tuple(s) for s in got[i] if s["kind"] < 3) == want, t


def test_battery_tells_random_from_regular(spark):
    rng = random.Random(7)
    rand = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40)) for _ in range(30)]
    rows = [(i, f"see {t} here") for i, t in enumerate(rand)] + [(100 + i, "see " + "aB1" * 20 + f"cD{i} here") for i in range(10)] + [(200, "just some ordinary prose, nothing-to-see_here at all")]
    got = {r["i"]: [s for s in r["spans"] if s["kind"] == 3] for r in secrets.scan(spark.createDataFrame(rows, "i int, text string")).collect()}
    assert sum(bool(got[i]) for i in range(30)) >= 27
    assert not any(got[100 + i] for i in range(10)) and not got[200]


def test_secret_scan_of_odd_rows(spark, odd, empty):
    assert secrets.scan(odd.withColumn("spans", F.lit(1))).filter(F.size("spans") == 0).count() == odd.count()
    assert secrets.scan(empty).count() == 0


# 7 suffix-array dedup


def brute_repeats(texts, length):
    seen = defaultdict(int)
    data = [(t or "").encode() for t in texts]
    for b in data:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] += 1
    out = []
    for b in data:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append(bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("large", [4000, 2])
def test_suffix_dedup_by_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(suffix_dedup, "LARGE_GROUP", large)
    rng = random.Random(8)
    passages = [words(rng, 40, 10_000) for _ in range(6)]
    texts = [words(rng, rng.randrange(60), 10_000) + rng.choice(passages)[rng.randrange(20) :] + words(rng, rng.randrange(40), 10_000) for _ in range(50)]
    texts += [texts[0], "é" * 150, "é" * 99, "ab " * 100, "xab " + "ab " * 30, None, "", "short"]
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), length=100).collect()}
    assert [bytes(got[i]["kept"]) for i in range(len(texts))] == brute_repeats(texts, 100)
    assert all(got[i]["n_bytes"] - sum(s["end"] - s["start"] for s in got[i]["spans"]) == len(got[i]["kept"]) for i in range(len(texts)))


def test_two_stage_suffix_array():
    rng = random.Random(9)
    for _ in range(200):
        t = bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randrange(50)))
        a = np.frombuffer(t, np.uint8)
        order = suffix_dedup.two_stage_suffix_array(a, 100)
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        common = suffix_dedup.adjacent_common_prefix(a, order, 20).tolist()
        lcp = lambda x, y: next((k for k in range(min(len(x), len(y), 20)) if x[k] != y[k]), min(len(x), len(y), 20))
        assert common[1:] == [lcp(t[i:], t[j:]) for i, j in zip(order[1:], order[:-1], strict=True)] if len(t) else common == []


def test_suffix_dedup_of_odd_rows(spark, odd, empty):
    got = suffix_dedup.remove_repeats(odd.withColumn("spans", F.lit(1)))
    assert got.count() == odd.count() and got.filter("doc_id = 5").select(F.length("kept")).first()[0] == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0


# 8 SimHash


def test_fingerprint_is_as_the_contract_says():
    text = "A b\tcé D e f A b"
    w = [x.lower() if x.isascii() else x for x in text.replace("\t", " ").split(" ")]
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(len(w) - 3)]
    assert simhash.simhash(text) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.simhash("One two") == xxhash.xxh64_intdigest(b"one two", 42)
    assert simhash.simhash(None) == simhash.simhash(" \n") == 0


@pytest.mark.parametrize("most", [4, 7])
def test_components_by_brute_force(spark, most):
    rng = random.Random(10)
    fps = []
    for _ in range(40):
        f = rng.getrandbits(64)
        for _ in range(rng.randrange(12)):
            fps.append(f)
            for _ in range(rng.randrange(4)):
                f ^= 1 << rng.randrange(64)
    centre = rng.getrandbits(64)
    fps += [centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)]
    uniq = sorted(set(fps))
    root = {f: f for f in uniq}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(uniq):
        for b in uniq[:i]:
            if (a ^ b).bit_count() <= most:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    got = {r["node"]: r["root"] for r in simhash.fingerprint_components(spark.createDataFrame([(signed(f),) for f in fps], "fp bigint").repartition(3), most).collect()}
    ours, theirs = defaultdict(set), defaultdict(set)
    for f in uniq:
        ours[got.get(signed(f), signed(f))].add(f)
        theirs[find(f)].add(f)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_connected_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in graph.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(51)} | {100 + i: 100 for i in range(40)}
    assert graph.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_duplicates_of_odd_rows(spark, odd, empty):
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in simhash.near_duplicates(odd).collect())
    assert got == [(0, None), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 5), (6, 6), (7, 6)]
    assert simhash.near_duplicates(empty).count() == 0


# 9 SentencePiece


def test_pieces_as_the_library_gives_them(spark, odd, empty):
    data = sentencepiece_bpe.model_bytes()
    sp = sentencepiece.SentencePieceProcessor(model_proto=data)
    rng = random.Random(11)
    texts = ["".join(rng.choice("ab \n\t▁01-éß中\U0001f600\x00th e  ing<s>|") for _ in range(rng.randrange(40))) for _ in range(400)] + [" " * 50, "", " a", "x" * 3000, "<s></s><0x41>"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in sentencepiece_bpe.encode(table, data, outputs=("n_tokens", "ids", "ids_text", "decoded")).collect():
        want = sp.encode(texts[r["doc_id"]])
        assert r["ids"] == want and r["n_tokens"] == len(want) and r["ids_text"] == ",".join(map(str, want)) and r["decoded"] == sp.decode(want)
    for r in sentencepiece_bpe.encode(odd.withColumn("ids", F.lit(0)), data).collect():
        assert r["ids"] == sp.encode(r["text"] or "") and r["decoded"] == sp.decode(r["ids"])
    assert sentencepiece_bpe.encode(empty, data).count() == 0


# 10 language ID


def test_language_by_held_out_accuracy(spark, odd, empty):
    rng = random.Random(12)
    stems = {"aa": "ka ri mo tu", "bb": "shel frin gorst wup", "cc": "ouë né çal ière"}
    rows = [(i, " ".join("".join(rng.choices(stems[x].split(), k=3)) for _ in range(20)), x) for i, x in enumerate(rng.choices(sorted(stems), k=300))]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.fit(table.filter("doc_id < 200"))
    got = language_id.predict(table.filter("doc_id >= 200"), model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 98 and all(0 <= r["score"] <= 1 for r in got)
    out = {r["doc_id"]: r for r in language_id.predict(odd.withColumn("score", F.lit("clash")), model).collect()}
    assert [out[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and out[1]["score"] == 0.0 and out[5]["lang_pred"] in stems
    assert language_id.predict(empty, model).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(odd, language_id.fit(empty)).collect()} == {"und"}


def test_long_texts_are_counted_whole(monkeypatch):
    text = "abcdefghij" * 50
    whole = np.sort(language_id.ngram_buckets(text, (2, 3), 16))
    monkeypatch.setattr(language_id, "_SLICE", 37)
    assert np.array_equal(np.sort(language_id.ngram_buckets(text, (2, 3), 16)), whole) and len(whole) == 501 + 500



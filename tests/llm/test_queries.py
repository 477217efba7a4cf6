"""The registered queries and the models behind them against plain Python."""

import math
import os
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from logloom.llm import language_id, quality, queries, secrets, sentencepiece_bpe, simhash

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def result(spark, name):
    df = queries.queries()[name](spark, SF)
    return dict(df.dtypes), df.collect()


def remainder(key, n):
    return zlib.crc32(str(key).encode()) % n


# the battery


def tail(z):
    return max(math.erfc(z / math.sqrt(2)) / 2, 1e-300)


def plain_p(token):
    """The three tests and Fisher's method on one token, written out; None where no encoding can be told."""
    body = token.rstrip("=")
    chars = set(body)
    digits, low, up = set("0123456789"), set("abcdefghijklmnopqrstuvwxyz"), set("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    if (chars <= digits | set("abcdef") or chars <= digits | set("ABCDEF")) and chars & digits and chars - digits:
        alphabet, plain = "0123456789abcdef", body.lower()
    elif chars <= up | set("234567") and chars & up and chars & set("234567"):
        alphabet, plain = secrets.ALPHABETS["base32"], body
    elif chars & up and chars & low and chars & digits:
        alphabet, plain = secrets.ALPHABETS["base64"], body.replace("-", "+").replace("_", "/")
    else:
        return None
    codes, size, n = [alphabet.find(c) for c in plain], len(alphabet), len(plain)
    chi = sum(c * c for c in Counter(codes).values()) * size / n - n
    spread = 2 / (9 * (size - 1))
    ps = [tail(((max(chi, 0) / (size - 1)) ** (1 / 3) - (1 - spread)) / math.sqrt(spread))]
    high = [2 * c >= size for c in codes]
    n1 = sum(high)
    runs = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    expected = 2 * n1 * (n - n1) / n + 1
    variance = (expected - 1) * (expected - 2) / (n - 1)
    ps.append(min(1, 2 * tail(abs(runs - expected) / math.sqrt(variance))) if variance > 0 else 1e-12)
    mean = sum(codes) / n
    total = sum((c - mean) ** 2 for c in codes)
    cross = sum((a - mean) * (b - mean) for a, b in zip(codes, codes[1:], strict=False))
    ps.append(min(1, 2 * tail(abs(cross / total + 1 / n) * math.sqrt(n))) if total > 1e-9 else 1e-12)
    half = -sum(map(math.log, ps))
    return math.exp(-half) * (1 + half + half * half / 2)


def test_battery_against_plain_python(spark):
    rng = np.random.default_rng(6)
    draw = lambda alphabet, n: "".join(rng.choice(list(alphabet), n))
    tokens = [draw(a, n) for a in secrets.ALPHABETS.values() for n in (20, 33, 64, 300) for _ in range(4)]
    tokens += ["a1" * 20, "Ab1" * 30, "A2" * 15, "aB3_-" * 8 + "==", "0" * 30 + "a", "DEADBEEF01" * 3, "x" * 40, "ABCDEFGH" * 4, draw(secrets.ALPHABETS["base64"], 5000)]
    rows = spark.createDataFrame(list(enumerate(tokens)), "i int, t string").withColumn("x", secrets.randomness(F.col("t")))
    got = {r["i"]: (r["x"]["encoding"], r["p"]) for r in rows.withColumn("p", secrets._p_value(F.col("x"))).collect()}
    for i, t in enumerate(tokens):
        want = plain_p(t)
        assert (got[i][0] is None) == (want is None), t
        if want is not None:
            assert math.isclose(got[i][1], want, rel_tol=1e-4, abs_tol=1e-12), (t, got[i], want)


def plain_regularity(token):
    body = token.rstrip("=")
    kind = plain_encoding(body)
    rare = {c: -math.log2(f / 100) for c, f in zip("abcdefghijklmnopqrstuvwxyz", secrets.LETTERS, strict=True)}
    mean = sum(2**-w * w for w in rare.values())
    deviation = secrets.SPREAD * math.sqrt(sum(2**-w * (w - mean) ** 2 for w in rare.values()))
    letters = [rare[c] for c in body.lower() if c in rare]
    kinds = ["U" if c.isupper() else "l" if c.islower() else "d" if c.isdigit() else "s" for c in body]
    changes, rate, n = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)), secrets.CHANGES[kind], len(body)
    by_changes = tail((changes - rate * (n - 1)) / math.sqrt(rate * (1 - rate) * (n - 1)))
    if kind == "hex":
        return by_changes
    half = -math.log(tail((sum(letters) - mean * len(letters)) / (deviation * math.sqrt(len(letters))))) - math.log(by_changes)
    return math.exp(-half) * (1 + half)


def plain_encoding(body):
    chars, digits, low, up = set(body), set("0123456789"), set("abcdefghijklmnopqrstuvwxyz"), set("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    if (chars <= digits | set("abcdef") or chars <= digits | set("ABCDEF")) and chars & digits and chars - digits:
        return "hex"
    if chars <= up | set("234567") and chars & up and chars & set("234567"):
        return "base32"
    return "base64" if chars & up and chars & low and chars & digits else None


PARTS = "get set user name account session query result manager handler request response buffer index table column value key cache node tree list filter parse render update delete create insert select service factory builder provider context config option event worker queue vector matrix token password database connection transaction template document property method object package import internal private static window dialog button status version release branch commit merge http json proxy".split()


def test_reports_are_rejections(spark):
    """Of 1,000 names in camel case with two digits at most 5 % are reported, of 200 random tokens of 24 characters at least 90 %; tails are those of erfc."""
    rng = np.random.default_rng(21)
    draw = lambda alphabet, n: "".join(rng.choice(list(alphabet), n))
    plain = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    names, tokens = [], []
    while len(names) < 1000:
        t = "".join(w.capitalize() for w in rng.choice(PARTS, int(rng.integers(3, 6))))
        at = int(rng.integers(1, len(t) + 1))
        t = f"{t[:at]}{rng.integers(0, 100):02d}{t[at:]}"
        names += [t] if len(t) >= 20 else []
    while len(tokens) < 200:
        t = draw(plain, 24)
        tokens += [t] if plain_encoding(t) == "base64" else []
    every = names + tokens
    got = {r["i"]: [s for s in r["spans"] if s["kind"] == 3] for r in secrets.scan(spark.createDataFrame([(i, f"x {t} y") for i, t in enumerate(every)], "i int, text string")).collect()}
    assert sum(bool(got[i]) for i in range(1000)) <= 50 and sum(bool(got[i]) for i in range(1000, 1200)) >= 180
    more = every[::40] + ["AAAA2222BBBB3333CCCC", draw(secrets.ALPHABETS["base32"], 40), "0123456789abcdef0123", draw("0123456789abcdef", 64), "aB3_-" * 8 + "==", draw(plain, 3000)]
    for r in spark.createDataFrame([(t,) for t in more], "t string").select("t", secrets.regularity(F.col("t")).alias("p")).collect():
        assert math.isclose(r["p"], plain_regularity(r["t"]), rel_tol=1e-4, abs_tol=1e-250), r
    z = [x / 7 for x in range(-40, 210)]
    for r in spark.createDataFrame([(x,) for x in z], "z double").select("z", secrets._upper_tail(F.col("z")).alias("p")).collect():
        assert math.isclose(r["p"], tail(r["z"]), rel_tol=2e-5), r


def test_long_tokens_and_many_matches(spark):
    long = "".join(np.random.default_rng(7).choice(list(secrets.ALPHABETS["base64"]), 200_000))
    many = " ".join(f"{i:032x}" for i in range(1, 1500))
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(spark.createDataFrame([(1, long), (2, many)], "doc_id bigint, text string")).collect()}
    assert [(s["start"], s["end"]) for s in got[1] if s["kind"] == 3]
    assert [(s["start"], s["kind"], s["end"]) for s in got[2] if s["kind"] == 2] == [(33 * i, 2, 33 * i + 32) for i in range(1499)]
    assert not any(s["kind"] == 3 for s in got[2])


# the models


def test_dual_and_primal_objectives_meet():
    """At the optimum of the hinge-loss problem both objectives are equal: no better weights exist."""
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 60, rng.integers(3, 20))) for _ in range(80)]
    y = np.where([(r % 7 == 0).sum() > 1 for r in rows], 1.0, -1.0)
    scale, cost = rng.normal(0, 1, 60), np.full(80, 0.7)
    weight, bias = quality.dual_coordinate_descent(rows, y, scale, cost, epochs=400)
    w = np.divide(weight, scale)
    x = np.zeros((80, 60))
    for i, r in enumerate(rows):
        x[i, r] = scale[r] / math.sqrt(len(r))
    primal = (w @ w + bias * bias) / 2 + (cost * np.maximum(0, 1 - y * (x @ w + bias))).sum()
    best = primal
    for _ in range(3000):  # no random change of the weights is better
        step = rng.normal(0, 0.02, 61)
        v, b = w + step[:60], bias + step[60]
        best = min(best, (v @ v + b * b) / 2 + (cost * np.maximum(0, 1 - y * (x @ v + b))).sum())
    assert primal <= best + 1e-6


def test_language_scores_against_plain_naive_bayes(spark):
    docs = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, "the house", "en"), (4, "la maison", "fr"), (5, None, "en"), (6, "x", None)]
    model = language_id.fit(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"), bits=12)
    grams = lambda t: [int(b) for b in language_id.ngram_buckets(t, (2, 3), 12)]
    counts = {lang: Counter(g for _, t, l in docs if l == lang and t for g in grams(t)) for lang in ("en", "fr")}
    texts = ["the maison", "chat", "", "12 ½²", None, "dog " * 400_000]
    got = model.score_all(texts)
    for i, t in enumerate(texts[:2] + texts[5:]):
        total = {}
        for lang, c in counts.items():
            size = sum(c.values()) + 0.5 * 4096
            total[lang] = math.log(0.5) + sum(n * math.log((c[g] + 0.5) / size) for g, n in Counter(grams(t)).items())
        best = max(total, key=total.get)
        at = [0, 1, 5][i]
        assert got[0][at] == best and math.isclose(got[1][at], 1 / sum(math.exp(v - total[best]) for v in total.values()), rel_tol=1e-3)
    assert [got[0][i] for i in (2, 3, 4)] == ["und"] * 3 and not got[1][2:5].any()


# the queries' contracts


def test_op2_contract(spark):
    types, rows = result(spark, "op2_quality_classifier")
    assert types == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    assert {r["doc_id"] for r in rows} == set(documents(spark))
    assert all(r["held_out"] == (remainder(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_op10_contract(spark):
    types, rows = result(spark, "op10_language_id")
    docs = documents(spark)
    assert types == {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"} and len(rows) == len(docs)
    assert all(r["held_out"] == (remainder(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in rows)
    for r in rows:
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, docs[r["doc_id"]]["text"] or "")))
    known = [r for r in rows if r["held_out"] and docs[r["doc_id"]]["lang"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in known) >= 0.9 * len(known)


def test_op4_contract(spark):
    types, rows = result(spark, "op4_line_dedup")
    seen, want = [], {}
    for k, d in sorted(documents(spark).items()):
        lines, kept = (d["text"] or "").split("\n") if d["text"] is not None else [], []
        for line in lines:
            s = frozenset(line.encode().lower().split())
            if not s or not any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                kept.append(line)
            if s:
                seen.append(s)
        text = "\n".join(kept)
        want[k] = (len(lines), len(lines) - len(kept), len(text), sha256(text.encode()).hexdigest())
    assert types["n_lines"] == "bigint"
    assert {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_chars"], r["kept_sha256"]) for r in rows if r["kept_sha256"]} == {k: v for k, v in want.items() if v[0]}


def test_op5_contract(spark):
    types, rows = result(spark, "op5_nearest_neighbours")
    assert list(types.items()) == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r["embedding"]}
    by = {}
    for r in rows:
        by.setdefault(r["query_id"], []).append(r)
        assert r["score"] == np.sqrt(((x[r["vec_id"]] - x[r["query_id"]]) ** 2).sum()) or math.isclose(r["score"], float(np.linalg.norm(x[r["vec_id"]] - x[r["query_id"]])), rel_tol=1e-14)
    assert set(by) == {k for k in x if k % 100 == 0}
    for q, own in by.items():
        best = sorted((float(np.linalg.norm(v - x[q])), k) for k, v in x.items() if k != q)[:10]
        assert [r["rank"] for r in sorted(own, key=lambda r: r["rank"])] == list(range(1, 11))
        assert len({k for _, k in best} & {r["vec_id"] for r in own}) >= 9


def test_op7_contract(spark):
    _, rows = result(spark, "op7_suffix_dedup")
    data = {k: (d["text"] or "").encode() for k, d in documents(spark).items()}
    seen = Counter(t[i : i + 200] for t in data.values() for i in range(len(t) - 199))
    for r in rows:
        t = data[r["doc_id"]]
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(t), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum() + gone[0]), sha256(kept).hexdigest())


def test_op8_contract(spark):
    types, rows = result(spark, "op8_simhash_near_dedup")
    fp = {k: simhash.simhash(d["text"]) for k, d in documents(spark).items()}
    low, changed = {k: k for k in fp}, True
    while changed:
        changed = False
        for a in fp:
            for b in fp:
                if low[b] < low[a] and (fp[a] ^ fp[b]).bit_count() <= 4:
                    low[a], changed = low[b], True
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {k: (f"{fp[k]:016x}", low[k]) for k in fp}


def test_op9_contract(spark):
    _, rows = result(spark, "op9_sentencepiece")
    lib = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_bpe.model_bytes())
    docs = documents(spark)
    for r in rows:
        ids = lib.encode(docs[r["doc_id"]]["text"] or "")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(lib.decode(ids).encode()).hexdigest())


def test_runs_of_spaces_as_the_library_has_them():
    lib = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_bpe.model_bytes())
    codec = sentencepiece_bpe.load(sentencepiece_bpe.model_bytes())
    for k in range(70):
        for word in ("", "the", "-x", "\n", "中a"):
            text = " " * k + word
            assert [i for g in codec.encode(text)[0] for i in g[0]] == lib.encode(text), (k, word)

"""The pipeline against its stages written plainly, and its queries against SQL."""

import os
import re

import duckdb
import pytest
from conftest import ODD, frame
from test_near_dedup import plain_kept
from pyspark.sql import functions as F

import corpus_pipeline as cp
from logloom.llm import language_id, queries
from logloom.llm.common import materialize

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    one = materialize(cp.keep_known_languages(spark, docs, SF))
    model = language_id.fit(docs)
    want = {r["doc_id"] for r in docs.collect() if r["text"] and model.score(r["text"])[0] != "und" and model.score(r["text"])[1] >= 0.5}
    assert one.columns == columns and {r["doc_id"] for r in one.collect()} == want

    two = materialize(cp.drop_repeated_lines(spark, one, SF))
    seen, left = [], {}
    for r in one.orderBy("doc_id").collect():
        kept, lost = [], 0
        for line in r["text"].split("\n"):
            s = frozenset(line.encode().lower().split())
            if s and any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                lost += 1
            else:
                kept.append(line)
            if s:
                seen.append(s)
        if not lost or "".join(kept).strip():
            left[r["doc_id"]] = "\n".join(kept)
    assert two.columns == columns and {r["doc_id"]: r["text"] for r in two.collect()} == left
    assert two.filter(F.length("text") != F.col("n_chars")).count() == 0

    three = materialize(cp.drop_near_duplicates(spark, two, SF))
    assert three.columns == columns and {r["doc_id"] for r in three.collect()} == plain_kept(left.items())

    four = materialize(cp.drop_contaminated(spark, three, SF))
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = find(r["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    clean = {r["doc_id"] for r in three.collect() if not any(tuple(w[i : i + n]) in windows for w in [find(r["text"])] for n in sizes for i in range(len(w) - n + 1))}
    assert four.columns == columns and {r["doc_id"] for r in four.collect()} == clean

    five = cp.encode_pieces(spark, four, SF)
    assert five.count() == four.count() and sorted(map(tuple, cp.run(spark, SF).select("doc_id", "n_tokens").collect())) == sorted(map(tuple, five.select("doc_id", "n_tokens").collect()))
    assert [n for n, _ in cp.STAGES][0] == "language ID" and len(cp.STAGES) == 5


CLASHING = ("score", "lang_pred", "held_out", "n_lines", "n_removed", "n_words", "hit_spans", "items", "component_id", "fp", "key", "h", "th")


def test_stages_keep_clashing_columns(spark):
    """All but the last stage give back every column of their input with its own values; odd rows crash none."""
    docs = frame(spark, ODD).select("*", F.lit("s").alias("source"), F.length("text").cast("bigint").alias("n_chars"))
    docs = docs.select("*", *[F.lit(f"mine {c}").alias(c) for c in CLASHING])
    for name, stage in cp.STAGES[:-1]:
        got = materialize(stage(spark, docs, SF))
        assert got.columns == docs.columns, name
        rows = got.collect()
        assert rows and all(r[c] == f"mine {c}" for r in rows for c in CLASHING), name
    assert cp.STAGES[-1][1](spark, docs, SF).count() == len(ODD)


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 0")
    for _, stage in cp.STAGES:
        assert stage(spark, docs, SF).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    cur = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    got = sorted(tuple(map(str, (r[c] for c in columns))) for r in df.collect())
    assert got == sorted(tuple(map(str, r)) for r in cur.fetchall())

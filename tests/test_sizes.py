"""Plans and steps that decide how queries grow with their tables, and results that only larger keys show."""

import duckdb
from pyspark.sql import functions as F

from logloom.operators import datasets, evaluate, joins, similarity
from logloom.plans import catalogue


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_unfolded_windows_are_not_broadcast(spark):
    ids = spark.range(20_000).select(F.col("id").alias("window_id"), (F.col("id") * 10 + 1).alias("start_idx"), (F.col("id") * 10 + 20).alias("end_idx"), (F.col("id") * 10 + 20).alias("target_row"))
    labels = spark.range(200_000).select(F.col("id").alias("row"), (F.col("id") % 7 == 0).cast("int").alias("y"))
    for policy in ("any", "majority", "ratio"):
        made = plan(evaluate.align_windows(ids, labels, policy))
        assert "SortMergeJoin [row#" in made, made
    assert "BroadcastHashJoin" not in plan(joins.rows_in_windows(ids, labels, "row", F.col("start_idx"), F.col("end_idx")))


def test_evidence_ids_of_pages_beyond_999(spark, tmp_path):
    rows = [(i, f"http://{'ab'[i % 2]}.example.com/{i}", "") for i in (7, 10, 998, 999, 1000, 1001, 12_345, 12_346, -4)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute("SELECT domain, evidence_ids, first_id FROM (" + catalogue.oracle_sql()["j19_evidence_lookup"] + ") ORDER BY domain").fetchall()
    got = catalogue.queries()["j19_evidence_lookup"](spark, str(tmp_path)).orderBy("domain").select("domain", "evidence_ids", "first_id").collect()
    assert list(map(tuple, got)) == want


def test_containment_of_common_tokens(spark):
    """Addresses of few forms and a number each: candidates stay far below the pairs of a form, and the best matches are those of all pairs."""
    rows = [(i, f"{('https', 'http')[i % 2]} {('www', 'blog')[i // 2 % 2]} site{i // 4 % 3} example {('com', 'org')[i // 12 % 2]} en n{i // 3}") for i in range(900)]
    df = spark.createDataFrame(rows, "k bigint, t string").withColumn("set", similarity.template_tokens(F.col("t")))
    queries, known = df.filter("k % 2 = 1"), df.filter("k % 2 = 0")
    sets = lambda side: {r["k"]: set(r["set"]) for r in side.collect()}
    asked, held = sets(queries), sets(known)
    want = {}
    for q, own in asked.items():
        ranks = [(len(own & o), len(own & o) / len(o), len(o), -k) for k, o in held.items() if len(own & o) >= 4 and len(own & o) / len(o) >= 0.65]
        if ranks:
            m, score, _, k = max(ranks)
            want[q] = (-k, m, round(score, 6))
    for rare in (1, 8, 10_000):
        got = similarity.token_containment(queries, known, "k", "t", rare=rare)
        assert {r["k"]: tuple(r)[1:] for r in got.collect()} == want
    pairs = similarity.containment_candidates(queries.withColumnRenamed("k", "qi"), known.withColumnRenamed("k", "ki"), 4, 0.65, most=8).count()
    assert pairs <= 8 * 900


def test_key_values_are_parsed_once_for_a_row(spark):
    sf = "/root/testdata/sf0.001"
    for name in ("p34_artifacts", "p25_enriched_template", "p26_important_fields"):
        made = catalogue.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert made.count("regexp_extract_all(") == 1, name


def test_idf_shuffles_counts_and_takes_repeated_ids(spark, tmp_path):
    rows = [(1, "a b a"), (1, "b c"), (2, "a"), (3, ""), (4, None), (None, "a z"), (None, "z"), (5, "The c and"), (6, "the")]
    con = duckdb.connect()
    for name, of in (("repeated", rows), ("single", [r for r in rows if r[0] is None or r[0] > 1])):
        spark.createDataFrame(of, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/{name}/documents.parquet/*.parquet'")
        for q in ("a38_word_idf", "a38_idf_weighted_vectors"):
            want = con.execute(catalogue.oracle_sql()[q])
            columns = [c[0] for c in want.description]
            got = catalogue.queries()[q](spark, f"{tmp_path}/{name}").select(*columns).collect()
            assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall())), (name, q)
    made = plan(catalogue.queries()["a38_word_idf"](spark, f"{tmp_path}/single"))
    assert "hashpartitioning(word" in made and "hashpartitioning(word#" in made and "__d" not in made.split("Exchange hashpartitioning(")[1].split(")")[0]


def test_rows_are_made_once_for_a_numbered_table(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def template(i):
        made.add(1)
        return f"t{i % 3}"

    rows = spark.range(500, numPartitions=4).select("id", template("id").alias("event_template"), (-F.col("id")).alias("t"))
    got = datasets.structured_table(rows, ["t", "id"]).orderBy("line_no").collect()
    assert made.value == 500
    assert [r["id"] for r in got] == list(range(499, -1, -1)) and [r["line_no"] for r in got] == list(range(1, 501))
    assert {(r["event_template"], r["event_no"]) for r in got} == {("t1", 1), ("t0", 2), ("t2", 3)}

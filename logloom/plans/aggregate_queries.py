"""Queries over aggregations (A rows of the survey)."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.operators import aggregates as ops
from logloom.operators import windows
from logloom.plans.registry import query
from logloom.plans.sequence_queries import _SESSIONS, sessions
from logloom.sources import adapters as A
from logloom.sources.adapters import LOG_SQL


@query(f"WITH {LOG_SQL} SELECT host, event_template, count(*) AS size FROM log GROUP BY ALL")
def a01_template_catalogue(spark, d):
    return ops.template_catalogue(A.structured_log(spark, d), "host", "event_template")


@query(f"WITH {LOG_SQL} SELECT count(*) AS n_rows, count(DISTINCT event_template) AS n_templates, count(DISTINCT user_id) AS n_ids, min(t) AS first_t, max(t) AS last_t, count(*) FILTER (label <> '-') AS n_attacks, round(100.0 * count(*) FILTER (label <> '-') / count(*), 6) AS attack_percent FROM log")
def a02_dataset_profile(spark, d):
    return ops.profile(A.structured_log(spark, d), "event_template", "user_id", "t", "label")


@query(f"WITH {LOG_SQL}, c AS (SELECT host, event_template, count(*) AS n_rows FROM log GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY n_rows DESC, event_template) AS rank FROM c) SELECT * FROM r WHERE rank <= 10")
def a02_top_templates(spark, d):
    return ops.top_values(A.structured_log(spark, d), ["host"], "event_template", 10).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"WITH {LOG_SQL} SELECT host, count(*) FILTER (event_type = 'error') AS n_error, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'absent') AS n_absent FROM log GROUP BY host")
def a03_status_counts(spark, d):
    return ops.fixed_status_counts(A.structured_log(spark, d), ["host"], "event_type", ["error", "click", "absent"])


@query(f"WITH {LOG_SQL} SELECT count(*) FILTER (event_type = 'view') AS skipped_windows, count(*) FILTER (y = 1 AND k > 50) AS strict_anomalies, round(avg(k / 100.0), 6) AS mean_unknown_ratio FROM log")
def a04_run_summary(spark, d):
    return A.structured_log(spark, d).agg(F.count_if(F.col("event_type") == "view").alias("skipped_windows"), F.count_if((F.col("y") == 1) & (F.col("k") > 50)).alias("strict_anomalies"), F.round(F.avg(F.col("k") / F.lit(100.0)), 6).alias("mean_unknown_ratio"))


@query(f"WITH {LOG_SQL} SELECT user_id, count(*) AS n_rows, string_agg(event_template, '|' ORDER BY line_id) AS events FROM log GROUP BY user_id")
def a05_session_rollup(spark, d):
    got = windows.session_rollup(A.structured_log(spark, d), "user_id", "line_id", ("event_template",))
    return got.select("user_id", "n_rows", F.array_join("event_template_list", "|").alias("events"))


@query(f"WITH {_SESSIONS} SELECT count(*) AS n_kept, count(*) FILTER (label = 0) AS n_normal, min(len(q)) AS shortest, max(len(q)) AS longest, round(avg(len(q)), 6) AS mean_length FROM seq WHERE len(q) >= 15")
def a06_sequence_stats(spark, d):
    return ops.sequence_stats(sessions(spark, d), "q", "label", 15)


@query(f"""WITH {_SESSIONS}, e AS (SELECT first_row, unnest(q) AS event, generate_subscripts(q, 1) AS pos FROM seq), f AS (SELECT event, min((first_row, pos)) AS m FROM e GROUP BY event), n AS (SELECT event, row_number() OVER (ORDER BY m) AS event_idx FROM f)
SELECT * FROM n UNION ALL SELECT 'padding', 0 UNION ALL SELECT '<UNK>', (SELECT count(*) FROM n) + 1""")
def a07_vocabulary(spark, d):
    return ops.vocabulary(sessions(spark, d), "q", "first_row")


@query(f"WITH {LOG_SQL}, r AS (SELECT unnest(range(greatest(0, CAST(ceil((line_id - 1 - 19) / 10.0) AS BIGINT)), (line_id - 1) // 10 + 1)) AS window_id, event_template AS event FROM log) SELECT window_id, event, count(*) AS n FROM r GROUP BY ALL")
def a08_count_vectors(spark, d):
    got = windows.fixed_windows(A.structured_log(spark, d), 20, 10)
    return ops.count_vectors(got, ["window_id"], "event_template_list")


_SHORT = f"{LOG_SQL}, p AS (SELECT line_id, y, event_type || '>' || lead(event_type) OVER (PARTITION BY host ORDER BY line_id) AS q FROM log)"


def _short(spark, d):
    log = A.structured_log(spark, d)
    nxt = F.lead("event_type").over(windows.W.partitionBy("host").orderBy("line_id"))
    return log.select("line_id", "y", F.concat("event_type", F.lit(">"), nxt).alias("q"))


@query(f"WITH {_SHORT} SELECT q, min(line_id) AS first_row, round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM p), 9) AS weight, min(y) AS y FROM p GROUP BY q")
def a09_collapse_sequences(spark, d):
    return ops.collapse_sequences(_short(spark, d), "q", "line_id", "y", False).withColumn("weight", F.round("weight", 9))


@query(f"WITH {_SHORT} SELECT line_id, min(y) OVER (PARTITION BY q) AS y FROM p")
def a10_normal_once_normal_always(spark, d):
    return ops.normal_once_normal_always(_short(spark, d), "q", "y").select("line_id", "y")


@query(f"WITH {_SHORT} SELECT q, arg_max(y, line_id) AS y, count(*) AS n, min(line_id) AS first_row FROM p GROUP BY q")
def a11_dedupe_sessions(spark, d):
    return ops.dedupe_sessions(_short(spark, d), "q", "line_id", "y")


@query(f"WITH {_SHORT}, g AS (SELECT q, arg_max(y, line_id) AS y, count(*) AS n FROM p WHERE q IS NOT NULL GROUP BY q) SELECT q, y, unnest(range(1, n + 1)) AS copy FROM g")
def a12_expand_by_count(spark, d):
    got = ops.dedupe_sessions(_short(spark, d).filter("q IS NOT NULL"), "q", "line_id", "y")
    return ops.expand_by_count(got, "n").select("q", "y", F.col("copy").cast("bigint").alias("copy"))


@query(f"""WITH {LOG_SQL}, r AS (SELECT user_id AS file, count(*) AS events, count(DISTINCT event_template) AS templates, count(*) FILTER (y = 1) AS anomalies, count(*) FILTER (event_type = 'view') AS unknown_windows, round(count(*) FILTER (event_type = 'view') / CAST(count(*) AS DOUBLE), 6) AS unknown_ratio FROM log GROUP BY user_id),
c AS (SELECT user_id AS file, event_template, count(*) AS n FROM log WHERE y = 1 GROUP BY ALL), t AS (SELECT file, event_template, n, row_number() OVER (PARTITION BY file ORDER BY n DESC, event_template) AS i FROM c),
j AS (SELECT file, string_agg(event_template || '=' || n, '|' ORDER BY i) AS reasons FROM t WHERE i <= 12 GROUP BY file) SELECT r.*, coalesce(reasons, '') AS reasons FROM r LEFT JOIN j USING (file)""")
def a25_file_audit(spark, d):
    log = A.structured_log(spark, d).withColumnRenamed("user_id", "file")
    rows = log.groupBy("file").agg(F.count("*").alias("events"), F.countDistinct("event_template").alias("templates"), F.sum("y").alias("anomalies"), F.count_if(F.col("event_type") == "view").alias("unknown_windows"), F.round(F.count_if(F.col("event_type") == "view") / F.count("*"), 6).alias("unknown_ratio"))
    top = ops.top_values(log.filter("y = 1"), ["file"], "event_template", 12)
    text = top.groupBy("file").agg(F.array_join(F.sort_array(F.collect_list(F.struct("rank", F.concat("event_template", F.lit("="), F.col("n_rows").cast("string")).alias("x"))))["x"], "|").alias("reasons"))
    return rows.join(text, "file", "left").fillna("", ["reasons"])


@query(f"""WITH {LOG_SQL}, x AS (SELECT user_id AS file, host AS section, unnest([3, 5, 10, 14]) AS topk, k, y FROM log), f AS (SELECT file, section, topk, count(*) AS windows, count(*) FILTER (y = 1 AND k > topk * 6) AS anomalies FROM x GROUP BY ALL)
SELECT file, section, topk, windows, anomalies, anomalies > 0 AS detected, round(anomalies / CAST(windows AS DOUBLE), 6) AS ratio FROM f""")
def a26_file_by_k(spark, d):
    return _by_k(spark, d).withColumn("ratio", F.round(F.col("anomalies") / F.col("windows"), 6))


def _by_k(spark, d):
    log = A.structured_log(spark, d).select(F.col("user_id").alias("file"), F.col("host").alias("section"), F.explode(F.array(*map(F.lit, (3, 5, 10, 14)))).alias("topk"), "k", "y")
    got = log.groupBy("file", "section", "topk").agg(F.count("*").alias("windows"), F.count_if((F.col("y") == 1) & (F.col("k") > F.col("topk") * 6)).alias("anomalies"))
    return got.withColumn("detected", F.col("anomalies") > 0)


_BY_K = f"{LOG_SQL}, x AS (SELECT user_id AS file, host AS section, unnest([3, 5, 10, 14]) AS topk, k, y FROM log), f AS (SELECT file, section, topk, count(*) AS windows, count(*) FILTER (y = 1 AND k > topk * 6) AS anomalies FROM x GROUP BY ALL)"


@query(f"WITH {_BY_K} SELECT topk, section, count(*) AS files, count(*) FILTER (anomalies > 0) AS detected, round(avg(CASE WHEN anomalies > 0 THEN 1.0 ELSE 0.0 END), 6) AS recall FROM f GROUP BY GROUPING SETS ((topk), (topk, section))")
def a27_recall_summary(spark, d):
    rows = _by_k(spark, d)
    return rows.groupingSets([("topk",), ("topk", "section")], "topk", "section").agg(F.count("*").alias("files"), F.count_if("detected").alias("detected"), F.round(F.avg(F.col("detected").cast("double")), 6).alias("recall"))


@query(f"""WITH {_BY_K}, s AS (SELECT topk, section, sum(windows) AS windows, sum(anomalies) AS anomalies FROM f GROUP BY GROUPING SETS ((topk), (topk, section)))
SELECT topk, section, CAST(windows AS BIGINT) AS windows, CAST(anomalies AS BIGINT) AS anomalies, round(anomalies / CAST(windows AS DOUBLE), 6) AS noise FROM s""")
def a28_noise_summary(spark, d):
    rows = _by_k(spark, d)
    got = rows.groupingSets([("topk",), ("topk", "section")], "topk", "section").agg(F.sum("windows").alias("windows"), F.sum("anomalies").alias("anomalies"))
    return got.withColumn("noise", F.round(F.col("anomalies") / F.col("windows"), 6))


@query(f"""WITH {_BY_K}, w AS (SELECT section, file, sum(anomalies) AS a, sum(windows) AS w FROM f GROUP BY ALL) SELECT section, file, CAST(a AS BIGINT) AS anomalies, CAST(w AS BIGINT) AS windows FROM w ORDER BY a / CAST(w AS DOUBLE) DESC, file LIMIT 8""")
def a28_worst_sources(spark, d):
    got = _by_k(spark, d).groupBy("section", "file").agg(F.sum("anomalies").alias("anomalies"), F.sum("windows").alias("windows"))
    return got.orderBy(F.desc(F.col("anomalies") / F.col("windows")), "file").limit(8)


@query(f"WITH {_BY_K} SELECT section, CAST(sum(windows) AS BIGINT) AS windows, CAST(sum(anomalies) AS BIGINT) AS anomalies, count(*) FILTER (anomalies = 0) AS zero_rows FROM f GROUP BY section")
def a29_audit_totals(spark, d):
    return _by_k(spark, d).groupBy("section").agg(F.sum("windows").alias("windows"), F.sum("anomalies").alias("anomalies"), F.count_if(F.col("anomalies") == 0).alias("zero_rows"))


@query(f"""WITH RECURSIVE {LOG_SQL}, r AS (SELECT host, event_type, y, value, row_number() OVER (PARTITION BY host, event_type ORDER BY line_id) AS i FROM log),
f AS (SELECT DISTINCT host, event_type, CAST(0 AS BIGINT) AS i, CAST(0.5 AS DOUBLE) AS s, CAST(1 AS DOUBLE) AS l FROM log
  UNION ALL SELECT f.host, f.event_type, r.i, CAST(printf('%.3f', s * CAST(0.95 AS DOUBLE) + y * CAST(0.05 AS DOUBLE)) AS DOUBLE), CAST(printf('%.2f', l * CAST(0.9 AS DOUBLE) + value * CAST(0.1 AS DOUBLE)) AS DOUBLE) FROM f JOIN r ON r.host = f.host AND r.event_type = f.event_type AND r.i = f.i + 1)
SELECT host, event_type, n_calls, n_success, CAST(printf('%.3f', n_success / CAST(n_calls AS DOUBLE)) AS DOUBLE) AS success_rate, success_ema, latency_ema
FROM (SELECT host, event_type, max(i) AS n_calls, arg_max(s, i) AS success_ema, arg_max(l, i) AS latency_ema FROM f GROUP BY ALL) JOIN (SELECT host, event_type, CAST(sum(y) AS BIGINT) AS n_success FROM log GROUP BY ALL) USING (host, event_type)""")
def a35_tool_performance(spark, d):
    log = A.structured_log(spark, d)
    return ops.ema_fold(log, ["host", "event_type"], "line_id", "y", "value")


@query(f"WITH {LOG_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY line_id DESC) AS i FROM log) SELECT host, line_id, value FROM r WHERE i <= 100")
def a35_last_latencies(spark, d):
    return windows.first_n(A.structured_log(spark, d), ["host"], [F.desc("line_id")], 100).select("host", "line_id", "value")


@query(f"""WITH {LOG_SQL}, c AS (SELECT event_type, host, count(*) AS n, sum(value) AS total FROM log GROUP BY ALL) SELECT event_type, arg_max(host, (n, host)) AS host, max(n) AS n, round(sum(total) / sum(n), 6) AS mean_measure FROM c GROUP BY event_type""")
def a36_sequence_counts(spark, d):
    return ops.most_frequent(A.structured_log(spark, d), ["event_type"], "host", "value")


@query(f"""WITH {LOG_SQL}, f AS (SELECT (line_id - 1) // 50 AS window_id, event_template AS value, min(line_id) AS o FROM log GROUP BY ALL), r AS (SELECT window_id, value, row_number() OVER (PARTITION BY window_id ORDER BY o, value) AS rank FROM f) SELECT * FROM r WHERE rank <= 5""")
def a37_window_indicators(spark, d):
    rows = A.structured_log(spark, d).select(F.floor((F.col("line_id") - 1) / 50).alias("window_id"), F.col("event_template").alias("value"), "line_id")
    return ops.first_distinct(rows, ["window_id"], "value", "line_id", 5).withColumn("rank", F.col("rank").cast("bigint"))


LINES_A_ROW = 1_000
_WORDS = "w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents), v AS (SELECT 'the' AS word, [1.0, 0.5] AS vec UNION ALL SELECT 'and', [0.25, 2.0] UNION ALL SELECT 'of', [3.0, -1.0])"


def _word_lists(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("words"))


def _words(spark, d):
    words = _word_lists(spark, d).select("doc_id", F.explode("words").alias("word"))
    vectors = spark.createDataFrame([("the", [1.0, 0.5]), ("and", [0.25, 2.0]), ("of", [3.0, -1.0])], "word string, vec array<double>")
    return words, vectors


@query(f"WITH {_WORDS}, x AS (SELECT doc_id, unnest(range(0, 2)) AS dim, vec FROM w JOIN v USING (word)) SELECT doc_id, dim, round(avg(vec[dim + 1]), 6) AS value FROM x GROUP BY ALL")
def a38_template_vectors(spark, d):
    words, vectors = _words(spark, d)
    return ops.weighted_vectors(words, vectors, ["doc_id"], "word", "vec").withColumn("dim", F.col("dim").cast("bigint"))


@query(f"WITH {_WORDS} SELECT word, round(ln((SELECT CAST(count(DISTINCT doc_id) AS DOUBLE) FROM w) / count(DISTINCT doc_id)), 9) AS idf FROM w GROUP BY word")
def a38_word_idf(spark, d):
    return ops.word_idf(_word_lists(spark, d), "doc_id", "words")


@query(f"WITH {_WORDS}, i AS (SELECT word, ln((SELECT CAST(count(DISTINCT doc_id) AS DOUBLE) FROM w) / count(DISTINCT doc_id)) AS idf FROM w GROUP BY word), x AS (SELECT doc_id, unnest(range(0, 2)) AS dim, vec, round(idf, 9) AS idf FROM w JOIN v USING (word) JOIN i USING (word)) SELECT doc_id, dim, round(sum(vec[dim + 1] * idf), 6) AS value FROM x GROUP BY ALL")
def a38_idf_weighted_vectors(spark, d):
    words, vectors = _words(spark, d)
    named = vectors.select("word")
    weighed = words.join(F.broadcast(ops.word_idf(_word_lists(spark, d), "doc_id", "words", only=F.broadcast(named))), "word")
    return ops.weighted_vectors(weighed, vectors, ["doc_id"], "word", "vec", F.col("idf")).withColumn("dim", F.col("dim").cast("bigint"))


@query(f"WITH {_SESSIONS}, e AS (SELECT session_id, unnest(q) AS token FROM seq), x AS (SELECT session_id, unnest([0, 1]) AS dim, unnest([length(token), instr(token, '=')]) AS part FROM e) SELECT session_id, CAST(dim AS BIGINT) AS dim, round(CAST(sum(part) AS DOUBLE), 6) AS value FROM x GROUP BY ALL")
def a39_session_vectors(spark, d):
    """Sum of a session's template vectors, each as often as the template stands in it; here a template's vector is its length and where its = stands."""
    tf = sessions(spark, d).select("session_id", F.explode("q").alias("token")).groupBy("session_id", "token").agg(F.count("*").alias("tf"))
    vectors = tf.select("token").distinct().select("token", F.array(F.length("token").cast("double"), F.instr("token", "=").cast("double")).alias("vec"))
    return ops.weighted_vectors(tf, vectors, ["session_id"], "token", "vec", F.col("tf")).withColumn("dim", F.col("dim").cast("bigint"))


@query(f"WITH {_SESSIONS}, e AS (SELECT session_id, unnest(q) AS token FROM seq) SELECT session_id, token, count(*) AS tf FROM e GROUP BY ALL")
def a39_term_frequency(spark, d):
    return sessions(spark, d).select("session_id", F.explode("q").alias("token")).groupBy("session_id", "token").agg(F.count("*").alias("tf"))


@query(f"""WITH {LOG_SQL} SELECT host, event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation, round(avg(CASE WHEN y = 0 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate, min(value) AS least, max(value) AS most FROM log GROUP BY GROUPING SETS ((), (host), (event_type))""")
def a40_score_summary(spark, d):
    log = A.structured_log(spark, d).withColumn("passed", F.col("y") == 0)
    return ops.score_summary(log, [[], ["host"], ["event_type"]], "value", "passed")


@query(f"""WITH {LOG_SQL}, r AS (SELECT user_id AS case_id, k % 3 AS run, list_sort(list(DISTINCT event_template)) AS tools FROM log GROUP BY ALL), f AS (SELECT *, first_value(tools) OVER (PARTITION BY case_id ORDER BY run) AS first_tools FROM r)
SELECT case_id, count(*) AS runs, count(*) FILTER (tools = first_tools) AS same_as_first FROM f GROUP BY case_id""")
def a41_selection_stability(spark, d):
    runs = A.structured_log(spark, d).groupBy(F.col("user_id").alias("case_id"), (F.col("k") % 3).alias("run")).agg(F.sort_array(F.collect_set("event_template")).alias("tools"))
    first = F.first("tools").over(windows.W.partitionBy("case_id").orderBy("run"))
    return runs.withColumn("first_tools", first).groupBy("case_id").agg(F.count("*").alias("runs"), F.count_if(F.col("tools") == F.col("first_tools")).alias("same_as_first"))


@query(f"""WITH {LOG_SQL}, f AS (SELECT host, event_template, count(*) AS n, min(line_id) AS o FROM log WHERE y = 1 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY n DESC, o) AS i FROM f)
SELECT host, string_agg(event_template || ' (' || n || 'x)', ', ' ORDER BY i) AS events FROM r WHERE i <= 3 GROUP BY host""")
def a42_top_anomalous_events(spark, d):
    rows = A.structured_log(spark, d).filter("y = 1").groupBy("host", "event_template").agg(F.count("*").alias("n"), F.min("line_id").alias("o"))
    top = windows.first_n(rows, ["host"], [F.desc("n"), "o"], 3)
    text = F.concat("event_template", F.lit(" ("), F.col("n").cast("string"), F.lit("x)"))
    return top.groupBy("host").agg(F.array_join(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "o", text.alias("x"))))["x"], ", ").alias("events"))


@query(f"""WITH {A.PAGES_SQL} SELECT case_id, count(*) AS n_iocs, count(DISTINCT domain) AS n_domains, count(*) FILTER (domain LIKE '%.example.net') AS n_internal, count(*) FILTER (page_id % 3 = 0) AS n_results FROM url_iocs GROUP BY case_id""")
def a43_case_enrichment_summary(spark, d):
    return A.page_iocs(spark, d).groupBy("case_id").agg(F.count("*").alias("n_iocs"), F.countDistinct("domain").alias("n_domains"), F.count_if(F.col("domain").endswith(".example.net")).alias("n_internal"), F.count_if(F.col("page_id") % 3 == 0).alias("n_results"))


@query(f"WITH {LOG_SQL}, g AS (SELECT event_template, list(line_id) AS ids FROM log GROUP BY 1), x AS (SELECT event_template, unnest(ids) AS line_id FROM g) SELECT line_id, x.event_template, host FROM x JOIN log USING (line_id)")
def a44_line_to_template(spark, d):
    """Each template's line ids come in rows of at most LINES_A_ROW."""
    log = A.structured_log(spark, d)
    chunk = F.floor(F.col("line_id") / LINES_A_ROW)
    mapping = log.groupBy("event_template", chunk.alias("chunk")).agg(F.collect_list("line_id").alias("line_ids")).drop("chunk")
    return ops.lines_to_templates(mapping).join(log.select("line_id", "host"), "line_id")


@query("SELECT dim, round(sum(x) / (count(*) + 4), 6) AS value FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) GROUP BY dim")
def a45_unknown_vector(spark, d):
    rows = A.table(spark, d, "embeddings").select(F.posexplode("embedding").alias("dim", "x"))
    return rows.groupBy("dim").agg(F.round(F.sum("x") / (F.count("*") + 4), 6).alias("value")).withColumn("dim", F.col("dim").cast("bigint"))

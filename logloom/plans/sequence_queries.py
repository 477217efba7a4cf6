"""Queries over windows, sequences, sampling and splits (W rows of the survey)."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.operators import windows as ops
from logloom.operators.scan import key_blocks
from logloom.plans.registry import query
from logloom.sources import adapters as A
from logloom.sources.adapters import LOG_SQL

_join = lambda c: F.array_join(c, "|")


@query(f"""WITH {LOG_SQL}, r AS (SELECT unnest(range(greatest(0, CAST(ceil((line_id - 1 - 9) / 5.0) AS BIGINT)), (line_id - 1) // 5 + 1)) AS window_id, line_id, event_template, y FROM log)
SELECT window_id, count(*) AS n_rows, string_agg(event_template, '|' ORDER BY line_id) AS events, max(y) AS label FROM r GROUP BY window_id""")
def w01_fixed_window(spark, d):
    got = ops.fixed_windows(A.structured_log(spark, d), 10, 5, values=("event_template", "y"))
    return got.select("window_id", "n_rows", _join("event_template_list").alias("events"), F.array_max("y_list").alias("label"))


@query(f"""WITH {LOG_SQL}, b AS (SELECT min(t) AS t0, max(t) AS t1 FROM log),
r AS (SELECT unnest(range(greatest(0, CAST(floor((t - t0 - 3600) / 1800.0) AS BIGINT) + 1), least(CAST(floor((t - t0) / 1800.0) AS BIGINT), greatest(0, (t1 - t0 - 3600) // 1800 + 1)) + 1)) AS w, line_id, event_template FROM log, b),
g AS (SELECT w, min(line_id) AS first_row, max(line_id) AS last_row, count(*) AS n_rows, string_agg(event_template, '|' ORDER BY line_id) AS events FROM r GROUP BY w)
SELECT DISTINCT first_row, last_row, n_rows, events FROM g""")
def w02_time_window(spark, d):
    got = ops.time_windows(A.structured_log(spark, d), 3600, 1800)
    return got.select("first_row", "last_row", "n_rows", _join("event_template_list").alias("events"))


@query(f"""WITH {LOG_SQL}, {A.LINUX_SQL}, r AS (SELECT DISTINCT line_id, unnest(regexp_extract_all(raw_line, 'user[0-9]+')) AS session_id FROM linux)
SELECT session_id, count(*) AS n_rows, string_agg(CAST(line_id AS VARCHAR), '|' ORDER BY line_id) AS line_ids FROM r GROUP BY session_id""")
def w03_sessions_by_text_key(spark, d):
    lines = ops.sessions_by_pattern(A.linux_lines(spark, d).withColumn("id", F.col("line_id").cast("string")), "user[0-9]+", "raw_line", "line_id", ("id",))
    return lines.select("session_id", "n_rows", _join("id_list").alias("line_ids"))


@query(f"""WITH {LOG_SQL}, r AS (SELECT host, (row_number() OVER (PARTITION BY host ORDER BY line_id) - 1) // 20 AS chunk, line_id, y FROM log)
SELECT host, chunk, count(*) AS n_rows, min(line_id) AS first_row, max(y) AS label FROM r GROUP BY host, chunk""")
def w04_chunks_per_node(spark, d):
    return ops.chunks_by_key(A.structured_log(spark, d), "host", "line_id", 20, "y")


_SESSIONS = f"""{LOG_SQL}, s AS (SELECT host || '#' || CAST((n - 1) // 30 AS VARCHAR) AS session_id, line_id, event_template, y FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY line_id) AS n FROM log)),
seq AS (SELECT session_id, list(event_template ORDER BY line_id) AS q, max(y) AS label, min(line_id) AS first_row FROM s GROUP BY session_id)"""


def sessions(spark, d):
    """Chunks of 30 rows of each host as sessions: session_id, q (events), label, first_row."""
    rows, _ = key_blocks(A.structured_log(spark, d), ["host"], "line_id")
    log = rows.withColumn("session_id", F.concat("host", F.lit("#"), F.floor(F.col("__i") / 30).cast("string")))
    got = ops.session_rollup(log, "session_id", "line_id", ("event_template", "y", "line_id"))
    return got.select("session_id", F.col("event_template_list").alias("q"), F.array_max("y_list").alias("label"), F.array_min("line_id_list").alias("first_row"))


@query(f"""WITH {_SESSIONS}, p AS (SELECT session_id, CASE WHEN len(q) < 11 THEN list_concat(q, list_resize(CAST([] AS VARCHAR[]), 11 - len(q), 'padding')) ELSE q END AS q FROM seq),
r AS (SELECT session_id, q, unnest(range(0, len(q) - 10)) AS i FROM p)
SELECT session_id, i AS sample_pos, array_to_string(q[i + 1 : i + 10], '|') AS history, q[i + 11] AS target FROM r""")
def w05_next_event_samples(spark, d):
    got = ops.next_event_samples(sessions(spark, d), "q", 10)
    return got.select("session_id", F.col("sample_pos").cast("bigint").alias("sample_pos"), _join("history").alias("history"), "target")


@query(f"""WITH {LOG_SQL}, r AS (SELECT host, line_id, event_template, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY host) AS n, list(event_template) OVER (PARTITION BY host ORDER BY line_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS b FROM log WINDOW w AS (PARTITION BY host ORDER BY line_id)),
h AS (SELECT *, least(10, greatest(1, n - 1)) AS h FROM r)
SELECT host, (i - h) // 5 AS window_id, line_id AS target_row, array_to_string(b[len(b) - h + 1 : len(b)], '|') AS history, event_template AS target FROM h WHERE i >= h AND (i - h) % 5 = 0""")
def w06_detector_windows(spark, d):
    return ops.detector_windows(A.structured_log(spark, d), "host", "line_id", "event_template", 10, 5).withColumn("history", _join("history"))


@query(f"""WITH {LOG_SQL}, u AS (SELECT host, line_id, event_template, false AS v FROM log UNION ALL SELECT host, o, '<BOS>', true FROM (SELECT DISTINCT host FROM log), (SELECT unnest(range(-5, 0)) AS o)),
r AS (SELECT host, line_id, event_template, v, row_number() OVER w - 1 AS i, list(event_template) OVER (PARTITION BY host ORDER BY line_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS b FROM u WINDOW w AS (PARTITION BY host ORDER BY line_id))
SELECT host, i - 5 AS window_id, line_id AS target_row, array_to_string(b, '|') AS history, event_template AS target FROM r WHERE i >= 5 AND NOT v""")
def w07_start_context(spark, d):
    rows = ops.with_start_rows(A.structured_log(spark, d), "host", "line_id", "event_template", 5)
    got = ops.detector_windows(rows, "host", "line_id", "event_template", 5, 1)
    return got.filter("target_row > 0").withColumn("history", _join("history"))


@query(f"""WITH {LOG_SQL}, n AS (SELECT host || '#session' || lpad(CAST((row_number() OVER (PARTITION BY host ORDER BY line_id) - 1) // 50 AS VARCHAR), 6, '0') AS session_id, line_id AS o, t, event_template AS e FROM log),
f AS (SELECT session_id, min(o) AS o0, min(t) AS t0 FROM n GROUP BY session_id)
SELECT session_id, o AS row_order, t AS time, e AS event FROM n UNION ALL SELECT session_id, o0 - 1, t0 - (3 - i + 1), '<BOS>' FROM f, (SELECT unnest(range(1, 4)) AS i)""")
def w08_start_sessions(spark, d):
    return ops.start_sessions(A.structured_log(spark, d), "host", "line_id", "t", "event_template", 50, 3)


@query()
def w09_unknown_bursts(spark, d):
    return ops.unknown_bursts(A.structured_log(spark, d), "host", "line_id", "event_template", 0.05).select("host", "line_id", "event_template", "is_burst")


@query(f"""WITH {LOG_SQL}, r AS (SELECT host, line_id, event_template, row_number() OVER w - 1 AS i, list(event_template) OVER f AS b, min(line_id) OVER (PARTITION BY host ORDER BY line_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS first_row FROM log WINDOW w AS (PARTITION BY host ORDER BY line_id), f AS (PARTITION BY host ORDER BY line_id ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING))
SELECT host, first_row, line_id AS target_row, array_to_string(b, '|') AS history, event_template AS target FROM r WHERE i >= 19 AND (i - 19) % 20 = 0""")
def w10_target_last_windows(spark, d):
    return ops.target_last_windows(A.structured_log(spark, d), "host", "line_id", "event_template", 20, 20).withColumn("history", _join("history"))


@query(f"""WITH {LOG_SQL}, f AS (SELECT event_template, min(line_id) AS first_row FROM log GROUP BY 1) SELECT event_template, first_row, row_number() OVER (ORDER BY first_row) AS value_id FROM f""")
def w11_first_seen_ids(spark, d):
    return ops.first_seen_ids(A.structured_log(spark, d), "event_template", "line_id")


@query(f"""WITH {LOG_SQL} SELECT host, t, event_id, row_number() OVER (ORDER BY host, t, event_id) AS line_no FROM log""")
def w12_total_order_line_ids(spark, d):
    return ops.number_rows(A.structured_log(spark, d).select("host", "t", "event_id"), "host", "t", "event_id", name="line_no")


@query(f"""WITH {LOG_SQL}, n AS (SELECT greatest(1, count(*) // 700) AS n FROM log) SELECT line_id, event_template FROM log, n WHERE line_id % n = 0""")
def w13_every_nth(spark, d):
    return ops.every_nth(A.structured_log(spark, d), "line_id", 700).select("line_id", "event_template")


@query(f"""WITH {A.LINES_SQL}, r AS (SELECT doc_id, n, line, sum(CASE WHEN regexp_matches(line, '^[A-Z]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS e FROM lines)
SELECT doc_id, min(n) AS first_row, count(*) AS n_lines, md5(string_agg(line, ' ' ORDER BY n)) AS entry_md5 FROM r WHERE e > 0 GROUP BY doc_id, e""")
def w14_continuation_lines(spark, d):
    got = ops.continuation_groups(A.text_lines(spark, d), F.col("line").rlike("^[A-Z]"), "doc_id", "n", "line")
    return got.select("doc_id", "first_row", "n_lines", F.md5("entry").alias("entry_md5"))


@query(f"""WITH {LOG_SQL}, r AS (SELECT host, event_template, line_id, row_number() OVER (PARTITION BY host, event_template ORDER BY line_id) AS n FROM log) SELECT host, event_template, line_id FROM r WHERE n <= 10""")
def w15_caps_per_key(spark, d):
    return ops.first_n(A.structured_log(spark, d), ["host", "event_template"], ["line_id"], 10).select("host", "event_template", "line_id")


@query("""SELECT source, doc_id, n_chars FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n = 1""")
def w16_largest_per_folder(spark, d):
    docs = A.table(spark, d, "documents")
    return docs.groupBy("source").agg(F.min(F.struct((-F.col("n_chars")).alias("size"), "doc_id")).alias("m")).select("source", "m.doc_id", (-F.col("m.size")).alias("n_chars"))


@query(f"""WITH {LOG_SQL}, r AS (SELECT host, line_id, count(*) OVER (PARTITION BY host) AS n, row_number() OVER (PARTITION BY host ORDER BY line_id) AS i FROM log) SELECT host, line_id, i <= floor(n * 0.8) AS is_train FROM r""")
def w17_split_per_host(spark, d):
    return ops.split_by_order(A.structured_log(spark, d), ["host"], "line_id", 0.8).select("host", "line_id", "is_train")


@query(f"""WITH {LOG_SQL}, a AS (SELECT count(*) AS n FROM log WHERE y = 1), r AS (SELECT line_id, y, row_number() OVER (ORDER BY md5('42|' || line_id), line_id) AS i FROM log WHERE y = 0)
SELECT line_id, y FROM r, a WHERE i <= 2 * n UNION ALL SELECT line_id, y FROM log WHERE y = 1""")
def w18_class_balance(spark, d):
    log = A.structured_log(spark, d)
    return ops.balanced(log.filter("y = 0"), log.filter("y = 1"), "line_id").select("line_id", "y")


@query(f"""WITH {LOG_SQL}, r AS (SELECT host, event_type, line_id, value, row_number() OVER (PARTITION BY host, event_type ORDER BY value DESC, line_id) AS r, row_number() OVER (PARTITION BY host ORDER BY value DESC, line_id) AS k0 FROM log),
s AS (SELECT *, min(k0) OVER (PARTITION BY host, event_type) AS k FROM r), p AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY r, k) AS pick FROM s) SELECT host, event_type, line_id, pick FROM p WHERE pick <= 25""")
def w19_round_robin(spark, d):
    got = ops.round_robin(A.structured_log(spark, d), "host", "event_type", [F.desc("value"), F.col("line_id")], 25)
    return got.select("host", "event_type", "line_id", F.col("pick").cast("bigint").alias("pick"))


@query(f"""WITH {LOG_SQL}, h AS (SELECT host, line_id, value, y, row_number() OVER (PARTITION BY host ORDER BY line_id) AS i, row_number() OVER (PARTITION BY host ORDER BY value DESC, line_id) AS s FROM log),
t AS (SELECT host, line_id, value, row_number() OVER (PARTITION BY host ORDER BY value DESC, line_id) AS j FROM h WHERE i > 30 AND (value >= 20 OR y = 1)),
u AS (SELECT host, line_id FROM h WHERE i <= 30 UNION ALL SELECT host, line_id FROM t WHERE j <= 15)
SELECT host, line_id, 'EV-LOG-' || lpad(CAST(row_number() OVER (PARTITION BY host ORDER BY line_id) AS VARCHAR), 3, '0') AS evidence_id FROM u""")
def w21_evidence_numbering(spark, d):
    w = ops.W.partitionBy("host")
    rows = A.structured_log(spark, d).withColumn("i", F.row_number().over(w.orderBy("line_id")))
    tail = ops.first_n(rows.filter("i > 30 AND (value >= 20 OR y = 1)"), ["host"], [F.desc("value"), "line_id"], 15)
    both = rows.filter("i <= 30").select("host", "line_id").unionByName(tail.select("host", "line_id"))
    return both.withColumn("evidence_id", F.format_string("EV-LOG-%03d", F.row_number().over(w.orderBy("line_id"))))

"""Queries over the next-event model and window decisions (D rows of the survey), and the entry query."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.functions import text as T
from logloom.operators import aggregates, detect as ops, windows
from logloom.plans.registry import query
from logloom.sources import adapters as A
from logloom.sources.adapters import LOG_SQL, SYSMON_SQL

ORDER = 3
_SEP = "chr(31)"

MODEL_SQL = f"""{LOG_SQL},
o AS (SELECT host, line_id, y, k, value, event_template AS e, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY host) AS n, list(event_template) OVER (PARTITION BY host ORDER BY line_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b FROM log WINDOW w AS (PARTITION BY host ORDER BY line_id)),
x AS (SELECT *, i + 1 <= floor(n * 0.8) AS is_train, coalesce(b, []) AS h FROM o),
g AS (SELECT x.*, s.ord, array_to_string(h[len(h) - s.ord + 1 : len(h)], {_SEP}) AS suffix FROM x, (SELECT unnest(range(0, 4)) AS ord) s WHERE s.ord <= len(h)),
c AS (SELECT ord, suffix, e, count(*) AS n FROM g WHERE is_train GROUP BY ALL),
m AS (SELECT *, sum(n) OVER (PARTITION BY ord, suffix) AS total, row_number() OVER (PARTITION BY ord, suffix ORDER BY n DESC, e) AS rank FROM c),
t AS (SELECT ord, suffix, string_agg(e, '|' ORDER BY rank) AS topk FROM m WHERE rank <= 9 GROUP BY ALL),
b AS (SELECT host, line_id, e, y, k, value, h, arg_max((ord, suffix), ord) AS best FROM g SEMI JOIN t USING (ord, suffix) WHERE NOT is_train AND len(h) = 3 GROUP BY ALL),
scored AS (SELECT host, line_id AS target_row, b.e AS target, array_to_string(h, '|') AS history, y, k, value, best[1] AS order_used, round(coalesce(m.n / CAST(m.total AS DOUBLE), 0), 9) AS p, m.rank, t.topk
  FROM b JOIN t ON t.ord = best[1] AND t.suffix = best[2] LEFT JOIN m ON m.ord = best[1] AND m.suffix = best[2] AND m.e = b.e)"""


def scored_windows(spark, d, order: int = ORDER, log=None):
    """Windows of the last fifth of each host, scored by a model of the first four fifths: host, target_row, target, history, y, k, value, order_used, p, rank, topk."""
    rows = windows.split_histories(A.structured_log(spark, d) if log is None else log, ["host"], "line_id", "event_template", order, 0.8).withColumnRenamed("event_template", "target")
    model = ops.fit_next_event(rows.filter("is_train"), order)
    test = rows.filter(~F.col("is_train") & (F.size("history") == order)).select("host", F.col("line_id").alias("target_row"), "target", "history", "y", "k", "value")
    return ops.score_next_event(test, model, order).withColumn("p", F.round("p", 9))


@query(f"WITH {MODEL_SQL} SELECT host, count(*) AS windows, count(*) FILTER (rank IS NULL OR rank > 3) AS anomalies, round(count(*) FILTER (rank IS NULL OR rank > 3) / CAST(count(*) AS DOUBLE), 6) AS ratio FROM scored GROUP BY host")
def entry_host_anomalies(spark, d):
    miss = F.col("rank").isNull() | (F.col("rank") > 3)
    got = scored_windows(spark, d).groupBy("host").agg(F.count("*").alias("windows"), F.count_if(miss).alias("anomalies"))
    return got.withColumn("ratio", F.round(F.col("anomalies") / F.col("windows"), 6))


@query(f"WITH {MODEL_SQL} SELECT host, target_row, target, history, order_used, p, rank, topk FROM scored")
def d01_next_event_scores(spark, d):
    got = scored_windows(spark, d)
    return got.select("host", "target_row", "target", F.array_join("history", "|").alias("history"), F.col("order_used").cast("bigint").alias("order_used"), "p", F.col("rank").cast("bigint").alias("rank"), F.array_join("topk", "|").alias("topk"))


@query()
def d02_order_and_count_model(spark, d):
    """Probability of an attack for every window, from a model of the other half of the windows."""
    rows = scored_windows(spark, d).withColumn("fold", (F.col("target_row") % 2).cast("int"))
    return ops.cross_scored(rows, "history", ["p", "rank"], "y", "fold", bits=12, rounds=30).select("host", "target_row", "y", F.round("score", 6).alias("score"))


@query(f"WITH {LOG_SQL}, f AS (SELECT event_template AS event, min(line_id) AS o FROM log WHERE y = 0 AND k % 4 <> 3 GROUP BY 1), v AS (SELECT event, row_number() OVER (ORDER BY o) AS event_idx FROM f) SELECT line_id, event_template, coalesce(event_idx, (SELECT count(*) + 1 FROM v)) AS event_idx FROM log LEFT JOIN v ON event = event_template")
def d03_event_ids(spark, d):
    log = A.structured_log(spark, d)
    known = log.filter("y = 0 AND k % 4 <> 3").select(F.col("line_id").alias("o"), F.array("event_template").alias("q"))
    return ops.event_ids(log, aggregates.vocabulary(known, "q", "o"), "event_template").select("line_id", "event_template", "event_idx")


_LONG = "'user ' || event_type || ' level ' || k % 4 || ' on site ' || user_id % 3"


@query(f"""WITH {LOG_SQL}, e AS (SELECT line_id, {_LONG} AS event, y FROM log), f AS (SELECT event, min(line_id) AS o FROM e WHERE y = 0 AND event NOT LIKE '%level 2%' GROUP BY 1), v AS (SELECT event, row_number() OVER (ORDER BY o) AS event_idx FROM f),
q AS (SELECT DISTINCT event, list_distinct(regexp_extract_all(event, '[a-z0-9_]+')) AS qt FROM e WHERE event NOT IN (SELECT event FROM v)), n AS (SELECT event_idx, list_distinct(regexp_extract_all(event, '[a-z0-9_]+')) AS kt FROM v),
m AS (SELECT event, event_idx, len(list_intersect(qt, kt)) AS matched, len(list_intersect(qt, kt)) / CAST(len(kt) AS DOUBLE) AS score, len(kt) AS nk FROM q, n), b AS (SELECT event, arg_max(event_idx, (matched, score, nk, -event_idx)) AS event_idx FROM m WHERE matched >= 4 AND score >= 0.65 GROUP BY event)
SELECT line_id, coalesce(v.event_idx, b.event_idx, (SELECT count(*) + 1 FROM v)) AS event_idx FROM e LEFT JOIN v USING (event) LEFT JOIN b USING (event)""")
def d03_similar_event_ids(spark, d):
    """Events of attacks and of level 2 are not in the vocabulary; they get the id of the known event that they hold most of."""
    log = A.structured_log(spark, d).withColumn("event", F.expr(_LONG))
    known = log.filter("y = 0 AND event NOT LIKE '%level 2%'").select(F.col("line_id").alias("o"), F.array("event").alias("q"))
    return ops.event_ids(log, aggregates.vocabulary(known, "q", "o"), "event", similar=True).select("line_id", "event_idx")


_UNKNOWN = f"""{MODEL_SQL}, u AS (SELECT *, list_count(list_filter(string_split(history, '|'), lambda e: starts_with(e, 'signup'))) + CASE WHEN starts_with(target, 'signup') THEN 1 ELSE 0 END AS unknown_count, starts_with(target, 'signup') AS unknown_target FROM scored),
v AS (SELECT *, unknown_count / 4.0 AS unknown_ratio, k / 100.0 AS heuristic_score FROM u)"""


def _unknown(spark, d, log=None):
    rows = scored_windows(spark, d, log=log)
    known = lambda e: ~e.startswith("signup")
    n, share = ops.unknown_share(F.col("history"), F.col("target"), known)
    return rows.withColumn("unknown_count", n).withColumn("unknown_ratio", share).withColumn("unknown_target", ~known(F.col("target"))).withColumn("heuristic_score", F.col("k") / F.lit(100.0))


@query(f"WITH {_UNKNOWN} SELECT target_row, CAST(unknown_count AS INTEGER) AS unknown_count, CAST(unknown_ratio AS DOUBLE) AS unknown_ratio FROM v")
def d04_unknown_ratio(spark, d):
    return _unknown(spark, d).select("target_row", "unknown_count", "unknown_ratio")


def _decision_sql(mode: str) -> str:
    what = {"ignore": "'skipped_unknown'"}.get(mode, "reason")
    flag = "TRUE" if mode == "anomaly" else "FALSE"
    return f"""{_UNKNOWN}, w AS (SELECT *, CASE WHEN unknown_target THEN 'unknown_template' WHEN unknown_ratio >= 0.5 THEN 'unknown_template_ratio_exceeded' END AS reason FROM v),
z AS (SELECT *, (reason IS NOT NULL AND {'FALSE' if mode == 'evaluate' else 'TRUE'}) AS unk, (rank IS NULL OR rank > 3) AS miss FROM w),
dec AS (SELECT *, CASE WHEN unk AND heuristic_score >= 0.75 THEN 'evtx_heuristic_boost' WHEN unk THEN {what} WHEN miss THEN 'deeplog_topk_miss' ELSE 'evaluated' END AS evaluation_status, CASE WHEN unk AND heuristic_score >= 0.75 THEN TRUE WHEN unk THEN {flag} ELSE miss END AS is_anomaly, (NOT unk AND miss) AS strict_is_anomaly,
  CAST(CASE WHEN unk AND heuristic_score >= 0.75 THEN heuristic_score WHEN unk THEN {1.0 if mode == 'anomaly' else 0.0} ELSE greatest(0.0, 1 - p) END AS DOUBLE) AS anomaly_score FROM z)"""


def _decided(spark, d, mode, log=None):
    return ops.decide(_unknown(spark, d, log), 3, mode)


def _register_modes():
    for mode in ops.MODES:

        def f(spark, d, mode=mode):
            return _decided(spark, d, mode).select("target_row", "evaluation_status", "is_anomaly", "strict_is_anomaly", F.round("anomaly_score", 6).alias("anomaly_score"))

        f.__name__ = f"d05_decision_{mode}"
        query(f"WITH {_decision_sql(mode)} SELECT target_row, evaluation_status, is_anomaly, strict_is_anomaly, round(anomaly_score, 6) AS anomaly_score FROM dec")(f)


_register_modes()


@query(f"WITH {_decision_sql('warn')} SELECT target_row, CASE WHEN more THEN 'score_threshold_exceeded' ELSE evaluation_status END AS evaluation_status, is_anomaly OR more AS is_anomaly FROM (SELECT *, (NOT is_anomaly AND NOT strict_is_anomaly AND evaluation_status = 'evaluated' AND anomaly_score >= 0.9) AS more FROM dec)")
def d06_decision_policy(spark, d):
    return ops.apply_policy(_decided(spark, d, "warn"), "f1_constrained_recall", 0.9).select("target_row", "evaluation_status", "is_anomaly")


@query(f"""WITH {_decision_sql('anomaly')} SELECT target_row, CASE WHEN NOT is_anomaly THEN 'none' WHEN strict_is_anomaly OR evaluation_status IN ('deeplog_topk_miss', 'unknown_template', 'unknown_template_ratio_exceeded', 'evtx_heuristic_boost', 'evtx_sparse_fallback') THEN 'high' WHEN anomaly_score >= 0.7 THEN 'medium' ELSE 'low' END AS candidate_tier,
CASE WHEN NOT is_anomaly THEN '' ELSE concat_ws('|', CASE WHEN strict_is_anomaly THEN 'topk_miss' END, CASE WHEN starts_with(evaluation_status, 'unknown_template') THEN evaluation_status END, CASE WHEN evaluation_status = 'evtx_heuristic_boost' THEN evaluation_status END) END AS reasons FROM dec""")
def d07_candidate_tier(spark, d):
    return ops.candidate_tier(_decided(spark, d, "anomaly")).select("target_row", "candidate_tier", F.array_join("candidate_reasons", "|").alias("reasons"))


@query(f"WITH {LOG_SQL}, r AS (SELECT user_id AS file, line_id, k, count(*) OVER (PARTITION BY user_id) AS n FROM log) SELECT file, line_id, k / 100.0 AS fallback_score FROM r WHERE n <= 60 AND k / 100.0 >= 0.75")
def d08_short_file_fallback(spark, d):
    log = A.structured_log(spark, d).withColumnRenamed("user_id", "file")
    return ops.short_file_fallback(log, "file", 60, F.col("k") / F.lit(100.0)).select("file", "line_id", "fallback_score")


_SUMMARY = "event_template || ' | image=' || image || ' | command_line=' || command_line || ' | target_object=' || target_object || ' | destination_ip=' || destination_ip"


@query(f"""WITH {LOG_SQL}, {SYSMON_SQL}, w AS (SELECT DISTINCT (line_id - 1) // 10 AS window_id, (line_id - 1) // 10 * 10 + 10 AS target_row FROM log), a AS (SELECT window_id, target_row, coalesce(y, 0) = 1 AS is_anomaly FROM w LEFT JOIN log ON line_id = target_row),
r AS (SELECT window_id, line_id, image, username, command_line, destination_ip, is_anomaly AND line_id = target_row AS is_anomalous_line, {_SUMMARY} AS line_summary FROM sysmon JOIN a ON window_id = (line_id - 1) // 10)
SELECT window_id, count(*) AS n_lines, count(*) FILTER (is_anomalous_line) AS n_flagged, md5(string_agg(line_id || '~' || image || '~' || username || '~' || command_line || '~' || destination_ip || '~' || line_summary || '~' || CASE WHEN is_anomalous_line THEN '1' ELSE '0' END, chr(10) ORDER BY line_id)) AS payload_md5 FROM r GROUP BY window_id""")
def d09_window_payload(spark, d):
    """Payloads of all windows of ten lines, whose last line is the target; the digest is over their lines with fields, summary and flag."""
    lines = A.sysmon_rows(spark, d).withColumn("parameters", T.key_values(F.col("content")))
    flagged = A.structured_log(spark, d).select((F.floor((F.col("line_id") - 1) / 10)).alias("window_id"), (F.floor((F.col("line_id") - 1) / 10) * 10 + 10).alias("target_row")).distinct()
    truth = A.structured_log(spark, d).select(F.col("line_id").alias("target_row"), (F.col("y") == 1).alias("is_anomaly"))
    found = flagged.join(truth, "target_row", "left").select("window_id", (F.col("target_row") - 9).alias("start_row"), "target_row", F.coalesce("is_anomaly", F.lit(False)).alias("is_anomaly"))
    payload = ops.window_payload(found, lines, "line_id", "event_template", "parameters")
    f = lambda x, n: F.coalesce(x["important_fields"][n], F.lit(""))
    text = F.array_join(F.transform("lines", lambda x: F.concat_ws("~", x["line_number"].cast("string"), f(x, "image"), f(x, "user"), f(x, "command_line"), f(x, "destination_ip"), x["line_summary"], x["is_anomalous_line"].cast("int").cast("string"))), "\n")
    return payload.select("window_id", F.size("lines").cast("bigint").alias("n_lines"), F.size(F.filter("lines", lambda x: x["is_anomalous_line"])).cast("bigint").alias("n_flagged"), F.md5(text).alias("payload_md5"))


@query(f"WITH {MODEL_SQL} SELECT target_row, k2 AS k, NOT coalesce(list_position(string_split(topk, '|'), target) BETWEEN 1 AND k2, FALSE) AS is_miss FROM scored, (SELECT unnest([1, 3, 5, 9]) AS k2)")
def d10_topk_projection(spark, d):
    return ops.topk_flags(scored_windows(spark, d).drop("k"), [1, 3, 5, 9]).select("target_row", "k", "is_miss")


@query(f"WITH {LOG_SQL} SELECT line_id, host, CASE k % 3 WHEN 0 THEN 'noise' WHEN 1 THEN 'suspicious' ELSE 'unreviewed' END AS verdict, (k % 2 = 0) AS retained, CASE WHEN k % 2 = 0 THEN 'kept' ELSE 'dropped' END AS decision FROM log WHERE y = 1")
def d11_gate_observations(spark, d):
    log = A.structured_log(spark, d).filter("y = 1")
    verdicts = log.filter("k % 3 < 2").select("line_id", F.when(F.col("k") % 3 == 0, "noise").otherwise("suspicious").alias("verdict"))
    retained = log.filter("k % 2 = 0").select("line_id", F.lit(True).alias("retained"))
    got = log.join(verdicts, "line_id", "left").join(retained, "line_id", "left")
    return got.select("line_id", "host", F.coalesce("verdict", F.lit("unreviewed")).alias("verdict"), F.coalesce("retained", F.lit(False)).alias("retained"), F.when(F.col("retained"), "kept").otherwise("dropped").alias("decision"))


@query(f"""WITH {LOG_SQL}, r AS (SELECT host, line_id, value, k, row_number() OVER (PARTITION BY host ORDER BY value DESC, host, line_id) AS review_rank FROM log WHERE y = 1),
v AS (SELECT *, CASE WHEN review_rank <= 20 THEN CASE k % 3 WHEN 0 THEN 'noise' WHEN 1 THEN 'suspicious' ELSE 'uncertain' END ELSE 'not_reviewed' END AS verdict FROM r) SELECT host, line_id, review_rank, verdict FROM v WHERE verdict <> 'noise'""")
def d12_triage(spark, d):
    log = A.structured_log(spark, d).filter("y = 1")
    verdicts = log.filter("k % 3 < 2").select("host", "line_id", F.when(F.col("k") % 3 == 0, "noise").otherwise("suspicious").alias("verdict"))
    got = ops.triage(log, verdicts, "host", ["host", "line_id"], "value")
    return got.select("host", "line_id", F.col("review_rank").cast("bigint").alias("review_rank"), "verdict")


@query(f"WITH {LOG_SQL} SELECT line_id, CASE WHEN y = 0 THEN 'normal' WHEN k % 2 = 0 THEN 'investigate' ELSE 'review' END AS lane, CASE WHEN y = 0 THEN 'none' WHEN k / 100.0 >= 0.9 THEN 'high' WHEN k / 100.0 >= 0.7 THEN 'medium' ELSE 'low' END AS priority FROM log")
def d13_board_lanes(spark, d):
    lane, priority = ops.board_lane(F.col("y") == 1, F.col("k") % 2 == 0, F.col("k") / F.lit(100.0))
    return A.structured_log(spark, d).select("line_id", lane.alias("lane"), priority.alias("priority"))


@query(f"""WITH {LOG_SQL}, {A.LINUX_SQL}, r AS (SELECT host AS file, raw_line, row_number() OVER (PARTITION BY host ORDER BY line_id) AS i FROM linux),
g AS (SELECT file, count(*) AS n_lines, round(avg(CASE WHEN contains(lower(raw_line), 'sysmon') THEN 1.0 ELSE 0.0 END), 6) AS sysmon_share, count(*) FILTER (i <= 200 AND regexp_matches(raw_line, '^[A-Z][a-z]{{2}}\\s+\\d{{1,2}}\\s\\d{{2}}:\\d{{2}}:\\d{{2}}\\s|^type=')) AS n_linux, count(*) FILTER (i <= 200) AS f FROM r GROUP BY file)
SELECT file, n_lines, sysmon_share, n_linux, CASE WHEN sysmon_share >= 0.5 THEN 'sysmon' WHEN n_linux >= least(5, n_lines) AND n_linux >= f * 0.3 THEN 'linux' ELSE 'default' END AS profile FROM g""")
def d14_file_profile(spark, d):
    rows = A.linux_lines(spark, d).withColumnRenamed("host", "file")
    return ops.file_profile(rows, "file", "raw_line", F.col("raw_line"), "line_id")

"""Queries over composite tables and formal evaluation (C02 to C08 and C10 of the survey), and over summaries that belong to them."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.functions import sysmon, text as T
from logloom.operators import datasets as ops, detect, evaluate, parse, windows
from logloom.plans.detect_queries import _UNKNOWN, MODEL_SQL, ORDER, _decided, scored_windows
from logloom.plans import text_queries  # noqa: F401  (p25 states its SQL there)
from logloom.plans.registry import SQL, query
from logloom.sources import adapters as A, readers as R
from logloom.sources.adapters import LINUX_SQL, LOG_SQL, SCORED_SQL, SYSMON_SQL
from logloom.sources.tables import stored

_TEMPLATES = "CASE event_type WHEN 'error' THEN 'LinuxAuth process=sshd action=ssh_failed_password' WHEN 'view' THEN 'LinuxSyslog process=systemd action=started_session' WHEN 'signup' THEN 'LinuxAuth process=sshd action=ssh_accepted_publickey' WHEN 'purchase' THEN 'LinuxAuth process=sudo action=sudo_command' ELSE 'LinuxAuth process=cron action=cron_session_open' END"
_EPOCH = "CASE WHEN strftime(ts, '%m-%d') = '02-29' THEN 0 ELSE CAST(epoch(try_strptime('2022' || strftime(ts, '-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S')) AS BIGINT) END"


def _numbered(table: str, order: str) -> str:
    """SQL: the CTE `table` with line_no over an order and event_no by first appearance of event_template."""
    return f"n0 AS (SELECT *, row_number() OVER (ORDER BY {order}) AS line_no FROM {table}), f0 AS (SELECT event_template, row_number() OVER (ORDER BY min(line_no)) AS event_no FROM n0 GROUP BY 1), n1 AS (SELECT * FROM n0 JOIN f0 USING (event_template))"


_WEB = "'10.0.0.1 - - [' || strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000] \"get ' || CASE k % 3 WHEN 0 THEN '/login' WHEN 1 THEN '/a?q=..%2fetc%2Fpasswd&x=100%' ELSE '/index' END || ' HTTP/1.1\" 200 5'"


@query(f"""WITH {LOG_SQL}, {LINUX_SQL}, b AS (
  SELECT line_id, host, raw_line AS content, 'linux' AS log_source, {_EPOCH} AS timestamp, {_TEMPLATES} AS event_template FROM linux JOIN (SELECT line_id, ts FROM log) USING (line_id)
  UNION ALL SELECT line_id, host, {_WEB}, 'web', t, 'ApacheAccess method=GET status=200 action=' || CASE k % 3 WHEN 0 THEN 'login' WHEN 1 THEN 'file_probe' ELSE 'request' END FROM log WHERE event_type = 'view'),
r AS (SELECT *, concat_ws('|', CASE WHEN contains(lower(content), 'failed password') AND contains(content, 'root') THEN 'brute' END, CASE WHEN contains(lower(content), 'passwd') THEN 'probe' END) AS attack_labels FROM b), {_numbered('r', 'host, timestamp, log_source, line_id')}
SELECT line_no, event_no, event_template, host, log_source, timestamp, md5(content) AS content_md5, attack_labels, CASE WHEN attack_labels = '' THEN '-' ELSE 'attack' END AS label FROM n1""")
def c02_rule_labelled_table(spark, d):
    """System lines and web-server lines in one table, labelled by rules."""
    rules = spark.createDataFrame([("r1", "brute", ["failed password", "%root%"]), ("r2", "probe", ["PASSWD"])], "rule_id string, rule_label string, filters array<string>")
    k = F.col("k") % 3
    path = F.when(k == 0, "/login").when(k == 1, "/a?q=..%2fetc%2Fpasswd&x=100%").otherwise("/index")
    web = A.structured_log(spark, d).filter("event_type = 'view'")
    web = web.withColumn("raw_line", F.concat(F.lit("10.0.0.1 - - ["), F.date_format(F.col("ts").cast("timestamp"), "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "get '), path, F.lit(' HTTP/1.1" 200 5')))
    lines = A.linux_lines(spark, d).withColumn("raw_line", F.col("raw_line"))
    got = ops.rule_table(lines, web, rules)
    return got.select("line_no", "event_no", "event_template", "host", "log_source", "timestamp", F.md5("content").alias("content_md5"), "attack_labels", "label")


@query(f"""WITH {LOG_SQL}, {LINUX_SQL}, r AS (SELECT l.line_id, l.host, {_EPOCH} AS timestamp, {_TEMPLATES} AS event_template, md5(raw_line) AS content_md5, CASE WHEN y = 1 AND l.k % 3 = 0 THEN 'a|b' WHEN y = 1 AND l.k % 3 = 1 THEN 'solo' ELSE '' END AS attack_labels FROM linux l JOIN (SELECT line_id, ts, y FROM log) USING (line_id)), {_numbered('r', 'host, timestamp, line_id')}
SELECT line_no, event_no, event_template, host AS file, line_id AS original_line, timestamp, content_md5, attack_labels, CASE WHEN attack_labels = '' THEN '-' ELSE 'attack' END AS label FROM n1""")
def c03_sidecar_labelled_table(spark, d):
    """Lines whose labels are in JSON sidecars; broken sidecar lines label nothing."""
    log = A.structured_log(spark, d).filter("y = 1")
    k, n = F.col("k") % 3, F.col("line_id").cast("string")
    value = F.when(k == 2, "{broken").when(k == 0, F.concat(F.lit('{"line": '), n, F.lit(', "labels": ["b", "a"]}'))).otherwise(F.concat(F.lit('{"line": '), n, F.lit(', "labels": "solo"}')))
    side = R.label_sidecar(log.select(value.alias("value")), "value").select("line", F.explode("labels").alias("label")).join(log.select(F.col("line_id").alias("line"), F.col("host").alias("file")), "line")
    got = ops.sidecar_table(A.linux_lines(spark, d).select(F.col("host").alias("file"), F.col("line_id").alias("line"), "raw_line"), side)
    return got.select("line_no", "event_no", "event_template", "file", "original_line", "timestamp", F.md5("content").alias("content_md5"), "attack_labels", "label")


_C04 = f"""{LOG_SQL}, {LINUX_SQL}, x AS (SELECT l.line_id, l.t, l.k, l.event_type, CASE WHEN l.k % 9 = 0 THEN '' ELSE raw_line END AS content, CASE WHEN l.k % 7 = 0 THEN NULL ELSE host END AS a FROM linux l),
p AS (SELECT *, row_number() OVER (ORDER BY line_id) AS place FROM x WHERE content <> ''),
r AS (SELECT line_id AS original_row, coalesce(a, 'linux_host') AS agent, CASE WHEN k % 5 = 4 THEN place ELSE t END AS timestamp, content, {_TEMPLATES} AS event_template, CASE WHEN k % 4 < 2 THEN 'attack' ELSE '-' END AS label, CASE WHEN k % 4 < 2 THEN 'malicious' ELSE '' END AS attack_labels, 'rule ' || k AS rule_description FROM p), {_numbered('r', 'agent, timestamp, original_row')}"""


def _host_logs(spark, d):
    k = F.col("k")
    t = F.when(k % 5 == 4, "soon").when(k % 5 == 0, F.col("t").cast("string")).when(k % 5 == 1, (F.col("t") * 1000 + 7).cast("string")).otherwise(F.from_unixtime("t", "yyyy-MM-dd HH:mm:ss"))
    label = F.when(k % 4 == 0, " Malicious").when(k % 4 == 1, "TRUE").when(k % 4 == 2, "general").otherwise(F.lit(None))
    rows = A.linux_lines(spark, d).select(F.col("line_id").alias("row"), F.when(k % 7 != 0, F.col("host")).alias("agent"), t.alias("timestamp"), F.when(k % 9 != 0, F.col("raw_line")).otherwise("").alias("full_log"), label.alias("label"), F.concat(F.lit("rule "), k.cast("string")).alias("description"))
    return ops.host_log_table(rows)


@query(f"WITH {_C04} SELECT line_no, event_no, event_template, original_row, agent, timestamp, md5(content) AS content_md5, label, attack_labels, rule_description FROM n1")
def c04_host_log_table(spark, d):
    return _host_logs(spark, d).select("line_no", "event_no", "event_template", "original_row", "agent", "timestamp", F.md5("content").alias("content_md5"), "label", "attack_labels", "rule_description")


def _summary_sql(table: str, time: str, sources: list[str], listed: list[str] = (), n: int = 30) -> str:
    parts = [f"SELECT 'table' AS kind, 'rows' AS name, count(*) AS n_rows FROM {table}", f"SELECT 'table', 'templates', count(DISTINCT event_template) FROM {table}", f"SELECT 'table', 'first_time', CAST(min({time}) AS BIGINT) FROM {table}", f"SELECT 'table', 'last_time', CAST(max({time}) AS BIGINT) FROM {table}"]
    parts += [f"SELECT '{c}', coalesce({c}, ''), count(*) FROM {table} GROUP BY {c}" for c in ("label", *sources)]
    parts.append(f"SELECT * FROM (SELECT 'top template', event_template, count(*) AS c FROM {table} GROUP BY event_template ORDER BY c DESC, event_template LIMIT {n})")
    parts += [f"SELECT 'listed template', '{x}', count(*) FROM {table} WHERE event_template = '{x}'" for x in listed]
    return " UNION ALL ".join(parts)


@query(f"WITH {_C04} {_summary_sql('n1', 'timestamp', ['agent'])}")
def c04_host_log_summary(spark, d):
    return ops.table_summary(_host_logs(spark, d), "event_template", "timestamp", "label", ["agent"])


_LISTED = ["click k=0", "view k=3", "never seen"]


@query(f"WITH {LOG_SQL} {_summary_sql('log', 't', ['host', 'event_type'], _LISTED, 25)}")
def a02_table_summary(spark, d):
    return ops.table_summary(A.structured_log(spark, d), "event_template", "t", "label", ["host", "event_type"], _LISTED, 25)


_C05 = f"""{LOG_SQL}, {SYSMON_SQL},
u AS (SELECT 'benign' AS origin, host, line_id AS origin_line, t, 'EventID ' || k || ' Provider ' || host || ' Channel Security' AS event_template FROM log WHERE k % 5 <> 0 AND k % 7 <> 0 AND y = 0
  UNION ALL SELECT * FROM (SELECT 'normal', host, line_id, t, 'EventID 4624 Provider ' || event_type || ' Channel System' FROM log WHERE y = 0 AND k % 6 <> 0 ORDER BY line_id LIMIT 2000)
  UNION ALL SELECT 'events', host, line_id, t, 'EventID ' || s.event_id || ' Provider Microsoft-Windows-Sysmon Channel Sysmon' FROM sysmon s JOIN (SELECT line_id, t FROM log) USING (line_id) WHERE y = 0),
n AS (SELECT *, '-' AS label, row_number() OVER (ORDER BY t, origin, origin_line) AS line_id FROM u)"""


def _canonical(spark, d):
    log = A.structured_log(spark, d)
    own = log.select("line_id", "host", "t", F.when(F.col("k") % 5 != 0, F.col("k").cast("string")).alias("event_id"), F.when(F.col("k") % 7 == 0, " ").otherwise(F.col("host")).alias("provider"), F.lit("Security").alias("channel"), F.when(F.col("y") == 1, "T1110").alias("mitre_id"), F.lit("").alias("mitre_tactic"))
    normal = log.select("line_id", "host", "t", "label", F.when(F.col("k") % 6 == 0, " ").otherwise(F.col("event_type")).alias("message"))
    normal = R.normal_rows(normal, "line_id", 2000).select("line_id", "host", "t", F.col("message").alias("provider"), F.lit("4624").alias("event_id"), F.lit("System").alias("channel"))
    events = A.sysmon_rows(spark, d).filter("y = 0").join(log.select("line_id", "t"), "line_id").select("line_id", "host", "t", F.lit("Microsoft-Windows-Sysmon").alias("provider"), F.col("event_id").cast("string").alias("event_id"), F.lit("Sysmon").alias("channel"))
    return ops.training_events(("benign", parse.benign(own)), ("normal", normal), ("events", events))


@query(f"WITH {_C05} SELECT line_id, origin, host, origin_line, t, event_template FROM n")
def c05_training_events(spark, d):
    """The three inputs of the training table, before unknown events are put in."""
    return _canonical(spark, d).select("line_id", "origin", "host", "origin_line", "t", "event_template")


@query(f"WITH {_C05} {_summary_sql('n', 't', ['origin', 'host'])}")
def c05_training_summary(spark, d):
    return ops.table_summary(_canonical(spark, d), "event_template", "t", "label", ["origin", "host"])


@query()
def c05_canonical_training_table(spark, d):
    return ops.training_sessions(_canonical(spark, d))


_C06 = f"{LOG_SQL}, e AS ({SQL['p25_enriched_template']}), r AS (SELECT e.line_id, e.template AS event_template, host, t, CASE WHEN y = 1 THEN 'attack' ELSE '-' END AS label FROM e JOIN log USING (line_id)), {_numbered('r', 'host, t, line_id')}"


def _enriched(spark, d):
    log = A.structured_log(spark, d).select("line_id", "t", "label")
    rows = A.sysmon_rows(spark, d).select("line_id", "host", sysmon.enriched_template(F.col("event_template"), F.col("content")).alias("event_template")).join(log, "line_id")
    return ops.structured_table(rows, ["host", "t", "line_id"])


@query(f"WITH {_C06} SELECT line_no, event_no, event_template, line_id, host, t, label FROM n1")
def c06_enriched_table(spark, d):
    return _enriched(spark, d).select("line_no", "event_no", "event_template", "line_id", "host", "t", "label")


@query(f"WITH {_C06} {_summary_sql('n1', 't', ['host'])}")
def c06_enriched_summary(spark, d):
    return ops.table_summary(_enriched(spark, d), "event_template", "t", "label", ["host"])


@query(f"""WITH {LOG_SQL}, a AS (SELECT line_id, event_type AS category, host || ' EventID=' || k AS event_template, left(repeat(host, 100), 500) AS content, 1 AS label FROM log WHERE y = 1), c AS (SELECT count(*) AS n FROM a),
r AS (SELECT line_id, event_type, host, k, row_number() OVER (ORDER BY md5('42|' || line_id), line_id) AS i FROM log WHERE y = 0)
SELECT line_id, category, event_template, md5(content) AS content_md5, label FROM (SELECT * FROM a UNION ALL SELECT line_id, 'normal', host || ' EventID=' || k, event_type, 0 FROM r, c WHERE i <= 2 * n)""")
def c07_balanced_table(spark, d):
    """All rows of attack files and twice as many normal ones."""
    log = A.structured_log(spark, d)
    attacks = parse.attack_rows(log.filter("y = 1").select("line_id", F.concat(F.lit("/data/"), "event_type", F.lit("/f.evtx")).alias("path"), F.col("host").alias("provider"), F.col("k").alias("event_id"), F.repeat("host", F.lit(100)).alias("raw")))
    normal = log.filter("y = 0").select("line_id", F.lit("normal").alias("category"), T.event_template("provider_eventid", F.col("host"), F.col("k")).alias("event_template"), F.col("event_type").alias("content"), F.lit(0).alias("label"))
    got = windows.balanced(normal, attacks, "line_id")
    return got.select("line_id", "category", "event_template", F.md5("content").alias("content_md5"), "label")


_STATUSES = ["evaluated", "deeplog_topk_miss", "unknown_template", "unknown_template_ratio_exceeded", "evtx_heuristic_boost"]
_SAMPLED = f"{LOG_SQL}, sampled AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY line_id) - 1 AS pos, count(*) OVER (PARTITION BY host) AS cnt FROM log) WHERE pos % 2 = 0)"


@query(f"""WITH {_UNKNOWN.replace(LOG_SQL, _SAMPLED).replace('FROM log WINDOW', 'FROM sampled WINDOW')}, w AS (SELECT *, CASE WHEN unknown_target THEN 'unknown_template' WHEN unknown_ratio >= 0.5 THEN 'unknown_template_ratio_exceeded' END AS reason FROM v),
z AS (SELECT *, reason IS NOT NULL AS unk, (rank IS NULL OR rank > 3) AS miss FROM w), dec AS (SELECT *, CASE WHEN unk AND heuristic_score >= 0.75 THEN 'evtx_heuristic_boost' WHEN unk THEN reason WHEN miss THEN 'deeplog_topk_miss' ELSE 'evaluated' END AS s, CASE WHEN unk AND heuristic_score >= 0.75 THEN TRUE WHEN unk THEN FALSE ELSE miss END AS a, NOT unk AND miss AS st FROM z),
q AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY target_row) AS i FROM dec WHERE a), l AS (SELECT host, string_agg(target_row || ':' || target, '|' ORDER BY target_row) AS anomalies FROM q WHERE i <= 20 GROUP BY host), n AS (SELECT host, count(*) AS sampled_lines, max(cnt) AS parsed_lines FROM sampled GROUP BY host)
SELECT host, any_value(parsed_lines) AS parsed_lines, any_value(sampled_lines) AS sampled_lines, 'linux' AS profile, count(*) AS window_count, count(*) FILTER (a) AS anomaly_count, count(*) FILTER (st) AS strict_anomaly_count, CAST(0 AS BIGINT) AS skipped_windows, round(avg(unknown_ratio), 4) AS avg_unknown_ratio,
  {', '.join(f"count(*) FILTER (s = '{s}') AS n_{s}" for s in _STATUSES)}, coalesce(any_value(anomalies), '') AS anomalies, count(*) FILTER (a) > 20 AS is_truncated FROM dec JOIN n USING (host) LEFT JOIN l USING (host) GROUP BY host""")
def c08_quick_analysis(spark, d):
    """Each host's file: profile, every second line, decisions, summary and the first 20 anomalies."""
    sampled = ops.sampled_lines(A.structured_log(spark, d), "host", "line_id", 2, 10)
    profile = detect.file_profile(A.linux_lines(spark, d), "host", "raw_line", F.col("raw_line"), "line_id").select("host", F.col("n_lines").alias("parsed_lines"), "profile")
    sizes = sampled.groupBy("host").agg(F.count("*").alias("sampled_lines"))
    decided = _decided(spark, d, "warn", sampled.drop("line_no", "sampling_applied"))
    return profile.join(sizes, "host").join(ops.analysis_summary(decided, "host", "target_row", _STATUSES), "host")


_RANKS = "rk_h AS (SELECT score, sum(n * y) AS pos, sum(n * (1 - y)) AS neg FROM u GROUP BY score), rk_g AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM rk_h WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)), rk AS (SELECT round(CAST(sum(pos * (N - fp) + pos * neg / 2.0) AS DOUBLE) / (max(P) * max(N)), 9) AS roc_auc, round(sum(pos * tp / CAST(tp + fp AS DOUBLE)) / max(P), 9) AS average_precision FROM rk_g)"
_Z = "CASE WHEN {1} = 0 THEN 0.0 ELSE {0} / CAST({1} AS DOUBLE) END"
_METRICS = f"round({_Z.format('(tp + tn)', '(tp + tn + fp + fn)')}, 9) AS accuracy, round({_Z.format('tp', '(tp + fp)')}, 9) AS precision, round({_Z.format('tp', '(tp + fn)')}, 9) AS recall, round({_Z.format('2 * tp', '(2 * tp + fp + fn)')}, 9) AS f1, round({_Z.format('fp', '(fp + tn)')}, 9) AS fpr"
_CELLS = "count(*) FILTER (y = 0 AND NOT m) AS tn, count(*) FILTER (y = 0 AND m) AS fp, count(*) FILTER (y = 1 AND NOT m) AS fn, count(*) FILTER (y = 1 AND m) AS tp"


@query(f"""WITH {MODEL_SQL}, u AS (SELECT y, round(1 - p, 9) AS score, 1 AS n FROM scored), {_RANKS}, cells AS (SELECT kk AS k, {_CELLS} FROM (SELECT kk, y, rank IS NULL OR rank > kk AS m FROM scored, (SELECT unnest([1, 3, 5, 9]) AS kk)) GROUP BY kk)
SELECT k, tn, fp, fn, tp, {_METRICS}, roc_auc, average_precision FROM cells, rk""")
def c10_formal_evaluation(spark, d):
    """Direct form: windows of the held-out part of each host, for each k."""
    rows = stored(scored_windows(spark, d).withColumn("score", F.round(1 - F.col("p"), 9)))
    flags = detect.topk_flags(rows.drop("k"), [1, 3, 5, 9]).withColumn("y_pred", F.coalesce("is_miss", F.lit(True)).cast("int"))
    counts = evaluate.metrics(evaluate.confusion(flags, "y", "y_pred", keys=("k",)))
    rank = evaluate.ranking_measures(rows, "score", "y").first()
    counts = counts.withColumns({n: F.lit(rank[n]).cast("double") for n in ("roc_auc", "average_precision")})
    return counts.select("k", "tn", "fp", "fn", "tp", "accuracy", "precision", "recall", "f1", "fpr", "roc_auc", "average_precision")


_C10 = f"""{MODEL_SQL}, s AS (SELECT history || '|' || target AS q, arg_max(y, target_row) AS y, count(*) AS n FROM scored GROUP BY 1), e AS (SELECT q, s.y, p, rank FROM scored JOIN s ON q = history || '|' || target),
u AS (SELECT y, round(1 - p, 9) AS score, 1 AS n FROM e)"""


def _cached(spark, d):
    rows = windows.split_histories(A.structured_log(spark, d), ["host"], "line_id", "event_template", ORDER, 0.8).withColumnRenamed("event_template", "target")
    model = detect.fit_next_event(rows.filter("is_train"), ORDER)
    sessions = rows.filter(~F.col("is_train") & (F.size("history") == ORDER)).select(F.concat("history", F.array("target")).alias("q"), "y", "line_id")
    scored = ops.cached_scores(sessions, model, ORDER).withColumn("p", F.round("p", 9))
    return ops.cached_evaluation(scored, [1, 3, 5, 9])


@query(f"""WITH {_C10}, {_RANKS}, cells AS (SELECT kk AS k, {_CELLS} FROM (SELECT kk, y, rank IS NULL OR rank > kk AS m FROM e, (SELECT unnest([1, 3, 5, 9]) AS kk)) GROUP BY kk)
SELECT k, tn, fp, fn, tp, {_METRICS}, roc_auc, average_precision FROM cells, rk""")
def c10_cached_evaluation(spark, d):
    """Cached form: equal sessions once with their count; the SQL counts every session by itself."""
    return _cached(spark, d)[0].select("k", "tn", "fp", "fn", "tp", "accuracy", "precision", "recall", "f1", "fpr", "roc_auc", "average_precision")


@query(f"""WITH {_C10}, mm AS (SELECT kk AS k, y, round(1 - p, 9) AS score, rank IS NULL OR rank > kk AS m FROM e, (SELECT unnest([1, 3, 5, 9]) AS kk)), tt AS (SELECT DISTINCT k, score AS threshold FROM mm),
cells AS (SELECT tt.k, threshold, count(*) FILTER (y = 0 AND NOT (m OR score >= threshold)) AS tn, count(*) FILTER (y = 0 AND (m OR score >= threshold)) AS fp, count(*) FILTER (y = 1 AND NOT (m OR score >= threshold)) AS fn, count(*) FILTER (y = 1 AND (m OR score >= threshold)) AS tp FROM tt JOIN mm ON tt.k = mm.k GROUP BY tt.k, threshold)
SELECT k, threshold, tn, fp, fn, tp, {_METRICS}, round({_Z.format('tp', '(tp + fn)')}, 9) >= 0.8 AS is_eligible FROM cells""")
def c10_cached_calibration(spark, d):
    """Every score as a threshold of the cached form, for each k."""
    return _cached(spark, d)[1].select("k", "threshold", "tn", "fp", "fn", "tp", "accuracy", "precision", "recall", "f1", "fpr", "is_eligible")


_TRUTH = "CASE WHEN doc_id % 7 <> 0 THEN y_true END"


@query(f"""WITH {SCORED_SQL}, x AS (SELECT doc_id, score, y_pred, {_TRUTH} AS y_true FROM scored), q AS (SELECT *, CASE WHEN y_true IS NULL THEN 'skipped' WHEN y_true = 1 AND y_pred = 1 THEN 'TP' WHEN y_true = 0 AND y_pred = 1 THEN 'FP' WHEN y_true = 1 THEN 'FN' ELSE 'TN' END AS quadrant FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY quadrant ORDER BY doc_id) AS i FROM q) SELECT quadrant, doc_id AS key, score, 1 AS n_rows FROM r WHERE quadrant IN ('TP', 'TN') AND i <= 50 UNION ALL SELECT 'skipped', NULL, NULL, count(*) FROM q WHERE quadrant = 'skipped'""")
def a20_samples(spark, d):
    """The first 50 hits and correct rejections, and how many rows without a truth were skipped."""
    return ops.error_samples(A.scored_rows(spark, d).withColumn("y_true", F.expr(_TRUTH)), "doc_id", "score")


_PER_FILE = f"{LOG_SQL}, x AS (SELECT user_id AS file, host AS section, unnest([3, 5, 10, 14]) AS topk, k, y FROM log), f AS (SELECT file, section, topk, count(*) FILTER (y = 1 AND k > topk * 6) > 0 AS detected FROM x GROUP BY ALL)"


@query(f"WITH {_PER_FILE}, m AS (SELECT topk, section, count(*) AS files, count(*) FILTER (NOT detected) AS missed FROM f GROUP BY ALL), r AS (SELECT topk, section, file, row_number() OVER (PARTITION BY topk, section ORDER BY file) AS i FROM f WHERE NOT detected), l AS (SELECT topk, section, string_agg(file, '|' ORDER BY file) AS missed_files FROM r WHERE i <= 50 GROUP BY ALL) SELECT m.*, coalesce(missed_files, '') AS missed_files, missed = files AS is_section_missed FROM m LEFT JOIN l USING (topk, section)")
def a27_missed_files(spark, d):
    log = A.structured_log(spark, d).select(F.col("user_id").alias("file"), F.col("host").alias("section"), F.explode(F.array(*map(F.lit, (3, 5, 10, 14)))).alias("topk"), "k", "y")
    per = log.groupBy("file", "section", "topk").agg((F.count_if((F.col("y") == 1) & (F.col("k") > F.col("topk") * 6)) > 0).alias("detected"))
    return ops.missed_files(per)


@query(f"""WITH {LOG_SQL}, r AS (SELECT user_id AS case_id, k % 3 AS run, list_sort(list(DISTINCT event_template)) AS tools FROM log GROUP BY ALL), f AS (SELECT *, first_value(tools) OVER (PARTITION BY case_id ORDER BY run) AS first_tools FROM r),
g AS (SELECT case_id, count(*) AS runs, count(*) FILTER (tools = first_tools) AS same_as_first, count(DISTINCT tools) AS choices, round(avg(len(tools)), 6) AS mean_tools FROM f GROUP BY case_id), h AS (SELECT case_id, tool, count(*) AS n FROM (SELECT case_id, unnest(tools) AS tool FROM r) GROUP BY ALL)
SELECT g.*, tools_of_all, tools_of_any FROM g JOIN (SELECT case_id, count(*) FILTER (n = runs) AS tools_of_all, count(*) AS tools_of_any FROM h JOIN g USING (case_id) GROUP BY case_id) USING (case_id)""")
def a41_selection_summary(spark, d):
    runs = A.structured_log(spark, d).groupBy(F.col("user_id").alias("case_id"), (F.col("k") % 3).alias("run")).agg(F.sort_array(F.collect_set("event_template")).alias("tools"))
    return ops.selection_summary(runs, "case_id", "run", "tools")


@query(f"""WITH {LOG_SQL}, c AS (SELECT user_id AS file, event_type, count(*) AS n, count(*) FILTER (y = 1 AND k >= 50) AS strict, count(*) FILTER (y = 1 AND k < 50) AS other FROM log GROUP BY ALL)
SELECT file, string_agg(event_type || '=' || n, '|' ORDER BY event_type) AS status_counts, CAST(sum(strict) AS BIGINT) AS strict_anomalies, CAST(sum(other) AS BIGINT) AS other_anomalies FROM c GROUP BY file""")
def a25_status_counts(spark, d):
    """Status counts of each file as one text, and its anomalies by kind."""
    c = A.structured_log(spark, d).groupBy(F.col("user_id").alias("file"), "event_type").agg(F.count("*").alias("n"), F.count_if((F.col("y") == 1) & (F.col("k") >= 50)).alias("strict"), F.count_if((F.col("y") == 1) & (F.col("k") < 50)).alias("other"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_type", "n"))), lambda x: F.concat(x["event_type"], F.lit("="), x["n"].cast("string"))), "|")
    return c.groupBy("file").agg(text.alias("status_counts"), F.sum("strict").alias("strict_anomalies"), F.sum("other").alias("other_anomalies"))


@query(f"""WITH {A.PAGES_SQL}, r AS (SELECT *, CASE page_id % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'error' ELSE 'skipped' END AS status, row_number() OVER (PARTITION BY case_id ORDER BY page_id) AS i, row_number() OVER (PARTITION BY case_id, page_id % 4 = 0 ORDER BY page_id) AS j FROM url_iocs)
SELECT case_id, count(*) AS n_calls, count(*) FILTER (status = 'success') AS n_success, count(*) FILTER (status = 'error') AS n_error, count(*) FILTER (status = 'skipped') AS n_skipped, count(*) FILTER (status = 'cached') AS n_cached,
  string_agg(url, '|' ORDER BY page_id) FILTER (i <= 10) AS sample_iocs, coalesce(string_agg(url, '|' ORDER BY page_id) FILTER (status = 'success' AND j <= 20), '') AS sample_results FROM r GROUP BY case_id""")
def a43_call_summary(spark, d):
    """Calls of each case by status (zeros stay), its first 10 indicators and first 20 results."""
    from logloom.operators.aggregates import fixed_status_counts

    k = F.col("page_id") % 4
    rows = A.page_iocs(spark, d).withColumn("status", F.when(k == 0, "success").when(k == 1, "error").otherwise("skipped"))
    counts = fixed_status_counts(rows, ["case_id"], "status", ["success", "error", "skipped", "cached"]).join(rows.groupBy("case_id").agg(F.count("*").alias("n_calls")), "case_id")
    iocs, results = ops.ranked_list(rows, ["case_id"], [F.col("page_id")], "url", 10, "sample_iocs"), ops.ranked_list(rows.filter("status = 'success'"), ["case_id"], [F.col("page_id")], "url", 20, "sample_results")
    return counts.join(iocs, "case_id").join(results, "case_id", "left").fillna("", ["sample_results"])


@query(f"""WITH {LOG_SQL}, x AS (SELECT user_id AS file, unnest([3, 5, 10, 14]) AS topk, k, y, event_template FROM log), c AS (SELECT file, topk, event_template, count(*) AS n FROM x WHERE y = 1 AND k > topk * 6 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY file, topk ORDER BY n DESC, event_template) AS i FROM c) SELECT file, topk, string_agg(event_template || '=' || n, '|' ORDER BY i) AS top_events FROM r WHERE i <= 8 GROUP BY file, topk""")
def a26_top_events(spark, d):
    """The eight most frequent events of each file's anomalies, for each k."""
    from logloom.operators.aggregates import top_values

    rows = A.structured_log(spark, d).select(F.col("user_id").alias("file"), F.explode(F.array(*map(F.lit, (3, 5, 10, 14)))).alias("topk"), "k", "y", "event_template").filter(F.col("k") > F.col("topk") * 6).filter("y = 1")
    top = top_values(rows, ["file", "topk"], "event_template", 8).withColumn("text", F.concat("event_template", F.lit("="), F.col("n_rows").cast("string")))
    return ops.ranked_list(top, ["file", "topk"], [F.col("rank")], "text", 8, "top_events")

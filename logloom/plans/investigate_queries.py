"""Queries over investigation tables and composite jobs (I and C rows, A30 to A34 and W20 of the survey)."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.functions import sysmon, text as T
from logloom.operators import aggregates, detect, investigate as ops, parse, templates, windows
from logloom.plans.detect_queries import MODEL_SQL, scored_windows
from logloom.plans.join_queries import FEED_SQL, feed
from logloom.plans.registry import query
from logloom.sources import adapters as A
from logloom.sources.adapters import LINUX_SQL, LOG_SQL, SYSMON_SQL

#: Provider answers over the pages' domains: eight providers, each with fields of its own made from a number h of 0 to 9.
PROVIDERS = ("virustotal_lookup", "threatfox_lookup", "malwarebazaar_lookup", "urlhaus_lookup", "alienvault_otx_lookup", "greynoise_lookup", "shodan_internetdb_lookup", "abuseipdb_lookup")
_ANS = f"""{FEED_SQL}, a0 AS (SELECT seq, 'case_' || (seq // 3) % 5 AS case_id, ioc, list_extract({list(PROVIDERS)}, CAST(seq % 8 AS INTEGER) + 1) AS source, h, CASE h WHEN 9 THEN 'error' WHEN 8 THEN 'skipped' WHEN 7 THEN 'not_found' ELSE 'ok' END AS status, CASE h WHEN 9 THEN 'request timeout' END AS error FROM feed),
a1 AS (SELECT *, CASE source
  WHEN 'virustotal_lookup' THEN CASE WHEN h < 3 THEN 'malicious' WHEN h = 3 THEN 'suspicious' WHEN h = 4 THEN 'benign' WHEN h > 7 THEN 'error' ELSE 'unknown' END
  WHEN 'urlhaus_lookup' THEN CASE WHEN h < 2 THEN 'malicious' WHEN h < 5 THEN 'suspicious' WHEN h > 7 THEN 'error' ELSE 'unknown' END
  WHEN 'alienvault_otx_lookup' THEN CASE WHEN h % 7 > 0 THEN 'suspicious' ELSE 'unknown' END
  WHEN 'greynoise_lookup' THEN CASE WHEN h < 2 THEN 'malicious' WHEN h < 4 THEN 'suspicious' WHEN h < 6 THEN 'benign' WHEN h > 7 THEN 'error' ELSE 'unknown' END
  WHEN 'shodan_internetdb_lookup' THEN CASE WHEN h < 3 THEN 'suspicious' WHEN h > 7 THEN 'error' ELSE 'unknown' END
  WHEN 'abuseipdb_lookup' THEN CASE WHEN h * 13 >= 75 THEN 'malicious' WHEN h * 13 >= 25 THEN 'suspicious' WHEN h = 0 THEN 'benign' ELSE 'unknown' END
  ELSE CASE WHEN h < 4 THEN 'malicious' WHEN h > 7 THEN 'error' ELSE 'unknown' END END AS verdict,
round(CAST(CASE source
  WHEN 'virustotal_lookup' THEN CASE WHEN h < 3 THEN 0.75 + 0.03 * (3 - h) WHEN h = 3 THEN 0.65 WHEN h = 4 THEN 0.55 WHEN h > 7 THEN 0 ELSE 0.2 END
  WHEN 'threatfox_lookup' THEN CASE WHEN h < 3 THEN 0.85 WHEN h = 3 THEN 0.8 WHEN h > 7 THEN 0 ELSE 0.2 END
  WHEN 'malwarebazaar_lookup' THEN CASE WHEN h < 4 THEN 0.8 WHEN h > 7 THEN 0 ELSE 0.2 END
  WHEN 'urlhaus_lookup' THEN CASE WHEN h < 2 THEN 0.75 WHEN h < 5 THEN 0.6 WHEN h > 7 THEN 0 ELSE 0.2 END
  WHEN 'alienvault_otx_lookup' THEN CASE WHEN h % 7 > 0 THEN least(0.85, 0.55 + 0.04 * (h % 7)) ELSE 0.2 END
  WHEN 'greynoise_lookup' THEN CASE WHEN h < 2 THEN 0.85 WHEN h < 4 THEN 0.65 WHEN h < 6 THEN 0.6 WHEN h > 7 THEN 0 ELSE 0.2 END
  WHEN 'shodan_internetdb_lookup' THEN CASE h WHEN 0 THEN 0.7 WHEN 1 THEN 0.85 WHEN 2 THEN 0.85 WHEN 8 THEN 0 WHEN 9 THEN 0 ELSE 0.2 END
  ELSE CASE WHEN h * 13 >= 75 THEN least(1, 0.75 + 0.005 * (h * 13 - 75)) WHEN h * 13 >= 25 THEN least(0.85, 0.55 + 0.006 * (h * 13 - 25)) WHEN h = 0 THEN 0.6 ELSE 0.2 END END AS DOUBLE), 6) AS confidence,
coalesce(nullif(concat_ws('; ', CASE h WHEN 8 THEN 'tool call skipped' WHEN 9 THEN 'request timeout' END, CASE source
  WHEN 'virustotal_lookup' THEN CASE WHEN h < 3 THEN 'malicious detections=' || (3 - h) WHEN h = 3 THEN 'suspicious detections=2' WHEN h = 4 THEN 'harmless detections=5' END
  WHEN 'threatfox_lookup' THEN CASE WHEN h < 3 THEN 'family_' || h WHEN h = 3 THEN 'botnet' END
  WHEN 'malwarebazaar_lookup' THEN CASE WHEN h < 4 THEN 'sig_' || h || '; exe' ELSE 'exe' END
  WHEN 'urlhaus_lookup' THEN CASE WHEN h < 2 THEN 'online' WHEN h < 4 THEN 'offline' WHEN h = 4 THEN 'malware_download' END
  WHEN 'alienvault_otx_lookup' THEN CASE WHEN h % 7 > 0 THEN 'pulse_count=' || h % 7 END
  WHEN 'greynoise_lookup' THEN CASE WHEN h < 2 THEN 'malicious; seen' WHEN h < 4 THEN 'suspicious; seen' WHEN h < 6 THEN 'benign; seen' ELSE 'seen' END
  WHEN 'shodan_internetdb_lookup' THEN CASE WHEN h < 3 THEN 'shodan_vulns=' || 3 * (h + 1) WHEN h = 3 THEN 'shodan_ports=3 tags=0' WHEN h = 4 THEN 'shodan_ports=4 tags=1' WHEN h = 7 THEN 'not in shodan dataset' END
  ELSE CASE WHEN h = 5 THEN 'abuseipdb_score=65 reports=5; tor_exit_node' WHEN h > 0 THEN 'abuseipdb_score=' || h * 13 || ' reports=' || h END END), ''), 'no explicit threat signal') AS summary FROM a0),
ok AS (SELECT * FROM a1 WHERE verdict <> 'error' AND status NOT IN ('skipped', 'error') AND ioc <> '')"""
_PRIO = "CASE verdict WHEN 'malicious' THEN 4 WHEN 'suspicious' THEN 3 WHEN 'benign' THEN 2 WHEN 'unknown' THEN 1 ELSE 0 END"
_ROLL = f"{_ANS}, r0 AS (SELECT case_id, ioc, arg_max({{'v': verdict, 'c': confidence}}, ({_PRIO}, confidence, -seq)) AS b, array_to_string(list_sort(list(DISTINCT source)), '|') AS sources, count(*) AS n_answers, min(seq) AS s FROM ok GROUP BY case_id, ioc), r AS (SELECT case_id, ioc, b.v AS verdict, b.c AS confidence, sources, n_answers, s FROM r0)"


def _answers(spark, d):
    h = F.col("h")
    names = F.array(*map(F.lit, PROVIDERS))
    f = feed(spark, d).select("seq", F.concat(F.lit("case_"), (F.floor(F.col("seq") / 3) % 5).cast("string")).alias("case_id"), "ioc", "h", F.get(names, (F.col("seq") % 8).cast("int")).alias("source"))
    of = lambda i, value: F.when(F.col("source") == PROVIDERS[i], value)
    text = lambda t: F.concat(F.lit(f"{t}_"), h.cast("string"))
    fields = {
        "status": F.when(h == 9, "error").when(h == 8, "skipped").when(h == 7, "not_found").otherwise("ok"), "error": F.when(h == 9, "request timeout"),
        "malicious": of(0, 3 - h), "suspicious": of(0, F.when(h == 3, 2)), "harmless": of(0, F.when(h == 4, 5)),
        "malware_family": of(1, F.when(h < 3, text("family"))), "threat_type": of(1, F.when(h == 3, "botnet")), "confidence_level": of(1, F.when(h < 2, h * 50.0 + 25)),
        "signature": of(2, F.when(h < 4, text("sig"))), "file_type": of(2, F.lit("exe")),
        "url_status": of(3, F.when(h < 2, "online").when(h < 4, "offline").otherwise("")), "threat": of(3, F.when(h == 4, "malware_download")), "pulse_count": of(4, h % 7),
        "classification": of(5, F.when(h < 2, "malicious").when(h < 4, "suspicious").when(h < 6, "benign").otherwise("")), "message": of(5, F.lit("seen")),
        "n_vulns": of(6, F.when(h < 3, 3 * (h + 1))), "n_ports": of(6, F.when(h.isin(3, 4), h)), "n_tags": of(6, F.when(h == 4, 1)),
        "abuse_confidence_score": of(7, h * 13), "total_reports": of(7, h), "is_whitelisted": of(7, h == 0), "is_tor": of(7, h == 5),
    }
    return ops.normal_answers(f.withColumns(fields)).withColumn("confidence", F.round("confidence", 6))


@query(f"WITH {_ANS} SELECT seq, case_id, ioc, source, verdict, confidence, summary FROM a1")
def i01_normal_answers(spark, d):
    return _answers(spark, d).select("seq", "case_id", "ioc", "source", "verdict", "confidence", "summary")


@query(f"WITH {_ROLL} SELECT case_id, ioc, verdict, confidence, sources, n_answers FROM r")
def a30_evidence_rollup(spark, d):
    return ops.evidence_rollup(_answers(spark, d), ["case_id", "ioc"])


_CONFIDENCE = "CASE WHEN n = 0 THEN 0.0 ELSE round(greatest(0.0, least(1.0, best + 0.03 * least(n_sources, 3)) - 0.02 * least(n_errors, 5)), 3) END"


@query(f"""WITH {_ANS}, e AS (SELECT case_id, count(*) FILTER (verdict = 'error') AS n_errors FROM a1 GROUP BY case_id), g AS (SELECT e.case_id, any_value(n_errors) AS n_errors, count(ok.seq) AS n, max(confidence) AS best, count(DISTINCT source) AS n_sources, count(DISTINCT ioc) AS n_iocs FROM e LEFT JOIN ok USING (case_id) GROUP BY e.case_id)
SELECT case_id, n_sources, n_errors, {_CONFIDENCE} AS confidence, CASE WHEN n = 0 THEN 'No successful non-skipped enrichment evidence was available' ELSE n || ' successful evidence records; ' || n_sources || ' enrichment sources; ' || n_iocs || ' IOC(s) with evidence' || CASE WHEN n_errors > 0 THEN '; ' || n_errors || ' error/skipped records excluded from supporting evidence' ELSE '' END END AS factors FROM g""")
def a31_case_confidence(spark, d):
    return ops.case_confidence(_answers(spark, d), "case_id")


@query(f"""WITH {_ANS}, c AS (SELECT DISTINCT case_id FROM a1), n AS (SELECT c.case_id, count(ok.seq) AS n_supporting, count(*) FILTER (verdict = 'malicious') AS n_malicious, count(*) FILTER (verdict = 'suspicious') AS n_suspicious FROM c LEFT JOIN ok USING (case_id) GROUP BY c.case_id),
f0 AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ioc, seq) AS i FROM ok), f AS (SELECT case_id, string_agg(ioc || ' ' || source || ' ' || verdict, '; ' ORDER BY i) AS findings FROM f0 WHERE i <= 5 GROUP BY case_id),
u0 AS (SELECT case_id, ioc, row_number() OVER (PARTITION BY case_id ORDER BY min(seq), ioc) AS i FROM a1 GROUP BY case_id, ioc), u AS (SELECT case_id, string_agg(ioc, '|' ORDER BY i) AS asked FROM u0 WHERE i <= 5 GROUP BY case_id),
x AS (SELECT *, CASE WHEN n_supporting = 0 THEN 'No successful supporting evidence was available.' WHEN n_malicious + n_suspicious = 0 THEN 'Evidence did not contain malicious or suspicious verdicts.' ELSE '' END AS gap FROM n)
SELECT case_id, n_supporting, n_malicious, n_suspicious, CASE WHEN n_malicious > 0 THEN 'confirmed_threat' WHEN n_suspicious > 0 THEN 'suspicious' WHEN n_supporting > 0 THEN 'likely_false_positive' ELSE 'inconclusive' END AS verdict,
CASE WHEN n_malicious > 1 THEN 'high' WHEN n_malicious = 1 OR n_suspicious > 0 THEN 'medium' ELSE 'low' END AS confidence, gap, coalesce(findings, '') AS findings, CASE WHEN gap <> '' THEN asked ELSE '' END AS follow_ups FROM x LEFT JOIN f USING (case_id) LEFT JOIN u USING (case_id)""")
def a32_case_verdict(spark, d):
    return ops.case_verdict(_answers(spark, d), "case_id")


_HIT = "(source = 'virustotal_lookup' AND h < 3 OR source = 'greynoise_lookup' AND h < 2)"
_CASE_LOG = "cl AS (SELECT 'case_' || user_id % 5 AS case_id, * FROM log WHERE y = 1)"
_SEVERITY = f"sv AS (SELECT case_id, count(DISTINCT lower(ioc)) FILTER {_HIT} AS hits, count(*) AS n_answers, count(DISTINCT ioc) AS n_asked FROM a1 GROUP BY case_id), an AS (SELECT case_id, count(*) AS n_anomalies FROM cl GROUP BY case_id), se AS (SELECT *, coalesce(n_anomalies, 0) AS anomalies, CASE WHEN hits >= 3 THEN 'HIGH' WHEN hits >= 1 OR coalesce(n_anomalies, 0) >= 10 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM sv LEFT JOIN an USING (case_id))"


def _case_log(spark, d):
    return A.structured_log(spark, d).filter("y = 1").withColumn("case_id", F.concat(F.lit("case_"), (F.col("user_id") % 5).cast("string")))


def _severity(spark, d):
    """(case_id, hits, n_answers, anomalies, severity): indicators that an answer itself calls malicious, and the case's anomalies."""
    hit = (F.col("classification") == "malicious") | (F.col("malicious") > 0)
    hits = _answers(spark, d).groupBy("case_id").agg(F.countDistinct(F.when(hit, F.lower("ioc"))).alias("hits"), F.count("*").alias("n_answers"))
    got = hits.join(_case_log(spark, d).groupBy("case_id").agg(F.count("*").alias("anomalies")), "case_id", "left").fillna(0, ["anomalies"])
    return got.withColumn("severity", ops.severity(F.col("hits"), F.col("anomalies")))


@query(f"WITH {LOG_SQL}, {_ANS}, {_CASE_LOG}, {_SEVERITY} SELECT case_id, hits, anomalies, severity FROM se")
def a33_severity(spark, d):
    return _severity(spark, d).select("case_id", "hits", "anomalies", "severity")


@query(f"WITH {LOG_SQL}, c AS (SELECT user_id AS case_id, count(*) FILTER (y = 1 AND k > 95) AS n_hits, count(*) FILTER (y = 1 AND k > 80) AS n_findings FROM log GROUP BY 1) SELECT *, CASE WHEN n_hits >= 2 THEN 'high' WHEN n_hits >= 1 OR n_findings >= 3 THEN 'medium' ELSE 'low' END AS utility FROM c")
def a34_downstream_utility(spark, d):
    c = A.structured_log(spark, d).groupBy(F.col("user_id").alias("case_id")).agg(F.count_if((F.col("y") == 1) & (F.col("k") > 95)).alias("n_hits"), F.count_if((F.col("y") == 1) & (F.col("k") > 80)).alias("n_findings"))
    return ops.downstream_hint(c)


@query(f"""WITH {FEED_SQL}, feed_case AS (SELECT *, 'case_' || (seq // 3) % 5 AS case_id FROM feed), c AS (SELECT seq, case_id, CASE WHEN seq % 11 = 0 THEN 'omega' ELSE tool END AS tool, CASE WHEN seq % 13 = 0 THEN '' ELSE ioc END AS ioc, CASE WHEN seq % 7 = 0 THEN 'md5' ELSE 'domain' END AS ioc_type FROM feed_case),
n AS (SELECT *, row_number() OVER (PARTITION BY tool, lower(ioc) ORDER BY seq) AS n FROM c),
s AS (SELECT *, CASE WHEN tool = 'omega' THEN 'unknown_tool' WHEN ioc = '' THEN 'missing_ioc' WHEN ioc_type = 'md5' THEN 'unsupported_type' WHEN ends_with(ioc, '.test') THEN 'internal_ioc' WHEN length(ioc) < 4 THEN 'low_signal' WHEN n > 1 THEN 'already_called' END AS skip_reason FROM n)
SELECT seq, skip_reason, CASE WHEN skip_reason IS NULL THEN 'T' || lpad(CAST(sum(CASE WHEN skip_reason IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY case_id ORDER BY seq) AS VARCHAR), 4, '0') END AS trace_id FROM s""")
def i02_call_validation(spark, d):
    a = feed(spark, d).withColumn("case_id", F.concat(F.lit("case_"), (F.floor(F.col("seq") / 3) % 5).cast("string")))
    calls = a.select("seq", "case_id", F.when(F.col("seq") % 11 == 0, "omega").otherwise(F.col("tool")).alias("tool"), F.when(F.col("seq") % 13 == 0, "").otherwise(F.col("ioc")).alias("ioc"), F.when(F.col("seq") % 7 == 0, "md5").otherwise("domain").alias("ioc_type"))
    tools = spark.createDataFrame([("alpha", "domain"), ("beta", "domain"), ("gamma", "domain")], "tool string, ioc_type string")
    return ops.validate_calls(calls, tools, T.internal_ioc(F.col("ioc")), T.low_signal_ioc(F.col("ioc")), "seq").select("seq", "skip_reason", "trace_id")


@query(f"""WITH {_ANS}, g AS (SELECT a1.case_id, count(DISTINCT a1.ioc) AS n_iocs, count(*) % 3 AS rounds, count(*) FILTER (a1.status = 'skipped') AS n_open FROM a1 GROUP BY a1.case_id), u AS (SELECT case_id, count(*) AS n_usable FROM ok GROUP BY case_id), z AS (SELECT case_id, n_iocs, rounds, coalesce(n_usable, 0) AS n_usable, n_open FROM g LEFT JOIN u USING (case_id))
SELECT *, CASE WHEN n_iocs = 0 THEN 'no_iocs' WHEN rounds >= 2 THEN 'sufficient_evidence' WHEN rounds > 0 AND n_usable = 0 THEN 'no_usable_evidence' WHEN n_open > 0 THEN 'needs_more_evidence' ELSE 'sufficient_evidence' END AS route FROM z""")
def i03_enrichment_route(spark, d):
    usable = ops.succeeded(F.col("verdict"), F.col("status"), F.col("ioc"))
    cases = _answers(spark, d).groupBy("case_id").agg(F.countDistinct("ioc").alias("n_iocs"), (F.count("*") % 3).alias("rounds"), F.count_if(usable).alias("n_usable"), F.count_if(F.col("status") == "skipped").alias("n_open"))
    return ops.enrichment_route(cases)


@query(f"""WITH {_ROLL}, x AS (SELECT *, row_number() OVER (PARTITION BY case_id, verdict ORDER BY {_PRIO} DESC, confidence DESC, ioc) AS r1, row_number() OVER (PARTITION BY case_id ORDER BY {_PRIO} DESC, confidence DESC, ioc) AS k0 FROM r),
z AS (SELECT *, min(k0) OVER (PARTITION BY case_id, verdict) AS k1 FROM x), p AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY r1, k1) AS pick FROM z) SELECT case_id, ioc, verdict, confidence, pick FROM p WHERE pick <= 25""")
def i04_ioc_analysis(spark, d):
    r = ops.evidence_rollup(_answers(spark, d), ["case_id", "ioc"]).withColumn("p", ops.priority(F.col("verdict")))
    got = windows.round_robin(r, "case_id", "verdict", [F.desc("p"), F.desc("confidence"), F.col("ioc")], 25)
    return got.select("case_id", "ioc", "verdict", "confidence", F.col("pick").cast("bigint").alias("pick"))


@query(f"""WITH {_ROLL}, u AS (SELECT case_id, 'ioc' AS kind, ioc AS name, {_PRIO} + confidence AS weight, 'EV-' || s AS evidence_id FROM r WHERE s % 4 <> 0 UNION ALL SELECT 'case_' || user_id % 5, 'anomaly', event_template, 1 + k / 100.0, 'EV-LOG-' || event_id FROM (SELECT event_id, user_id, event_type || ' k=' || CAST(regexp_extract(props, '[0-9]+') AS INTEGER) % 4 AS event_template, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events WHERE event_type = 'error')),
z AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY weight DESC, kind, name, evidence_id) AS i FROM u) SELECT case_id, kind, name, round(CAST(weight AS DOUBLE), 6) AS weight, evidence_id FROM z WHERE i <= 5""")
def i05_strongest_indicators(spark, d):
    a = _answers(spark, d)
    first = a.filter(ops.succeeded(F.col("verdict"), F.col("status"), F.col("ioc"))).groupBy("case_id", "ioc").agg(F.min("seq").alias("s"))
    r = ops.evidence_rollup(a, ["case_id", "ioc"]).join(first, ["case_id", "ioc"])
    iocs = r.select("case_id", F.col("ioc").alias("name"), "verdict", "confidence", F.when(F.col("s") % 4 != 0, F.concat(F.lit("EV-"), F.col("s").cast("string"))).alias("evidence_id"))
    log = A.structured_log(spark, d).filter("y = 1")
    anomalies = log.select(F.concat(F.lit("case_"), (F.col("user_id") % 5).cast("string")).alias("case_id"), F.col("event_template").alias("name"), (F.col("k") / F.lit(100.0)).alias("score"), F.concat(F.lit("EV-LOG-"), F.col("event_id").cast("string")).alias("evidence_id"))
    return ops.strongest_indicators(iocs, anomalies).select("case_id", "kind", "name", F.round("weight", 6).alias("weight"), "evidence_id")


_CONTEXT = " || ".join(f"CASE WHEN {c} <> '' THEN ' {n} ' || {c} ELSE '' END" for n, c in (("image", "image"), ("command_line", "command_line"), ("target_object", "target_object"), ("user", "username"), ("destination_ip", "destination_ip"), ("destination_port", "destination_port"), ("query_name", "query_name"), ("granted_access", "granted_access")))


@query(rf"""WITH {LOG_SQL}, {SYSMON_SQL}, x AS (SELECT host, line_id, lower('Microsoft-Windows-Sysmon EventID=' || event_id || {_CONTEXT}) AS c FROM sysmon WHERE y = 1 OR line_id % 2 = 0),
t AS (SELECT host, line_id, 'T1059.001' AS technique, 'Execution' AS tactic, 'high' AS confidence FROM x WHERE contains(c, 'powershell')
UNION ALL SELECT host, line_id, 'T1059', 'Execution', 'medium' FROM x WHERE NOT contains(c, 'powershell') AND (contains(c, 'cmd.exe') OR contains(c, 'eventid=1'))
UNION ALL SELECT host, line_id, 'T1071', 'Command and Control', 'medium' FROM x WHERE (contains(c, 'eventid=3') OR contains(c, 'network') OR contains(c, 'destination_ip')) AND regexp_matches(c, 'destination_port[=:]?\s*(80|443|8080|8443)\b')
UNION ALL SELECT host, line_id, 'T1112', 'Defense Evasion', 'medium' FROM x WHERE contains(c, 'eventid=13') AND (contains(c, 'registry') OR contains(c, 'hkcu') OR contains(c, 'hklm') OR contains(c, 'target_object'))),
r AS (SELECT *, row_number() OVER (PARTITION BY host, technique ORDER BY line_id) AS i FROM t)
SELECT host, technique, tactic, min(confidence) AS confidence, count(*) AS n, string_agg(CAST(line_id AS VARCHAR), '|' ORDER BY line_id) FILTER (i <= 30) AS evidence_ids FROM r GROUP BY host, technique, tactic""".replace("\\\\", "\\"))
def i06_technique_map(spark, d):
    """Rows of attacks and of even lines have an evidence id: the line."""
    rows = A.sysmon_rows(spark, d).withColumn("f", parse.important_fields(T.key_values(F.col("content"))))
    rows = rows.withColumn("evidence", F.when((F.col("y") == 1) | (F.col("line_id") % 2 == 0), F.col("line_id")))
    return ops.technique_map(rows, "host", parse.attack_context(F.concat(F.lit("Microsoft-Windows-Sysmon EventID="), F.col("event_id").cast("string")), F.col("f")), "evidence")


@query(f"WITH {LOG_SQL} SELECT host, arg_max(line_id, (value, k, -line_id)) AS line_id, max(value) AS value FROM log WHERE y = 1 GROUP BY host")
def i07_priority_anomaly(spark, d):
    return A.structured_log(spark, d).filter("y = 1").groupBy("host").agg(F.max_by("line_id", F.struct("value", "k", (-F.col("line_id")).alias("n"))).alias("line_id"), F.max("value").alias("value"))


@query()
def i08_near_duplicate_texts(spark, d):
    rows = A.linux_lines(spark, d).withColumn("case_id", F.floor(F.col("line_id") / 50))
    return ops.near_duplicate_texts(rows, "case_id", "line_id", "raw_line")


@query(f"WITH {LOG_SQL}, f AS (SELECT host, 'event=' || event_template AS artifact, min(line_id) AS o FROM log WHERE y = 1 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY o, artifact) AS rank FROM f) SELECT host, artifact, rank FROM r WHERE rank <= 4")
def i09_affected_artifacts(spark, d):
    rows = A.structured_log(spark, d).filter("y = 1").select("host", "line_id", F.concat(F.lit("event="), "event_template").alias("artifact"))
    return aggregates.first_distinct(rows, ["host"], "artifact", "line_id", 4).withColumn("rank", F.col("rank").cast("bigint"))


_NAMED = "nm AS (SELECT *, row_number() OVER (PARTITION BY case_id, verdict ORDER BY confidence DESC, ioc) AS i FROM r WHERE verdict IN ('malicious', 'suspicious')), ba AS (SELECT case_id, string_agg(ioc, ', ' ORDER BY i) FILTER (verdict = 'malicious' AND i <= 3) AS bad3, string_agg(ioc, ', ' ORDER BY i) FILTER (verdict = 'malicious' AND i <= 5) AS bad5, string_agg(ioc, ', ' ORDER BY i) FILTER (verdict = 'suspicious' AND i <= 5) AS doubtful5 FROM nm GROUP BY case_id)"
_TOP = "tp AS (SELECT case_id, arg_max(event_template, (value, k, -line_id)) AS top FROM cl GROUP BY case_id), f0 AS (SELECT case_id, 'event=' || event_template AS artifact, min(line_id) AS o FROM cl GROUP BY ALL), f1 AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY o, artifact) AS i FROM f0), ar AS (SELECT case_id, string_agg(artifact, ', ' ORDER BY i) AS artifacts, arg_min(artifact, i) AS artifact FROM f1 WHERE i <= 4 GROUP BY case_id)"


def _report_cases(spark, d):
    """What the report tables need of each case."""
    r = ops.evidence_rollup(_answers(spark, d), ["case_id", "ioc"])
    ranked = windows.first_n(r.filter(F.col("verdict").isin("malicious", "suspicious")), ["case_id", "verdict"], [F.desc("confidence"), "ioc"], 5)
    named = lambda v: F.transform(F.array_sort(F.collect_list(F.when(F.col("verdict") == v, F.struct((-F.col("confidence")).alias("c"), "ioc")))), lambda x: x["ioc"]).alias(v)
    log = _case_log(spark, d)
    top = log.groupBy("case_id").agg(F.max_by("event_template", F.struct("value", "k", (-F.col("line_id")).alias("n"))).alias("top_anomaly"))
    artifacts = aggregates.first_distinct(log.select("case_id", "line_id", F.concat(F.lit("event="), "event_template").alias("artifact")), ["case_id"], "artifact", "line_id", 4)
    artifacts = artifacts.groupBy("case_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "artifact"))), lambda x: x["artifact"]), ", ").alias("artifacts"))
    cases = _severity(spark, d).withColumnRenamed("anomalies", "n_anomalies").join(ranked.groupBy("case_id").agg(named("malicious"), named("suspicious")), "case_id", "left")
    cases = cases.join(top, "case_id", "left").join(artifacts, "case_id", "left").withColumn("n_timeline", F.col("n_anomalies"))
    empty = F.array().cast("array<string>")
    return cases.withColumns({"malicious": F.coalesce("malicious", empty), "suspicious": F.coalesce("suspicious", empty), "top_anomaly": F.coalesce("top_anomaly", F.lit("")), "artifacts": F.coalesce("artifacts", F.lit(""))})


@query(f"""WITH {LOG_SQL}, {_ROLL}, {_CASE_LOG}, {_SEVERITY}, {_NAMED}, {_TOP}, c AS (SELECT * FROM se LEFT JOIN ba USING (case_id) LEFT JOIN tp USING (case_id) LEFT JOIN ar USING (case_id)),
x AS (SELECT case_id, 1 AS priority, 'contain_assets' AS rule, coalesce(bad3, top, '') AS detail FROM c WHERE severity = 'HIGH' AND (bad3 IS NOT NULL OR anomalies > 0)
UNION ALL SELECT case_id, 2, 'block_and_hunt_iocs', bad5 FROM c WHERE bad5 IS NOT NULL UNION ALL SELECT case_id, 3, 'validate_iocs', doubtful5 FROM c WHERE doubtful5 IS NOT NULL
UNION ALL SELECT case_id, 4, 'monitor_iocs', doubtful5 FROM c WHERE doubtful5 IS NOT NULL UNION ALL SELECT case_id, 5, 'recover_hosts', '' FROM c WHERE bad5 IS NOT NULL
UNION ALL SELECT case_id, 6, 'triage_window', top FROM c WHERE top IS NOT NULL UNION ALL SELECT case_id, 7, 'collect_artifacts', artifacts FROM c WHERE artifacts IS NOT NULL
UNION ALL SELECT case_id, 8, 'query_first_artifact', artifact FROM c WHERE artifacts IS NOT NULL UNION ALL SELECT case_id, 9, 'rebuild_timeline', CAST(anomalies AS VARCHAR) FROM c WHERE anomalies > 0
UNION ALL SELECT case_id, 10, 'compare_with_baseline', CAST(anomalies AS VARCHAR) FROM c WHERE anomalies > 0 AND bad5 IS NULL AND doubtful5 IS NULL UNION ALL SELECT case_id, 11, 'widen_enrichment', '' FROM c WHERE n_answers > 0 AND bad5 IS NULL AND doubtful5 IS NULL)
SELECT *, CASE WHEN rule IN ('contain_assets', 'block_and_hunt_iocs', 'monitor_iocs') THEN 'Containment' WHEN rule = 'recover_hosts' THEN 'Recovery' ELSE 'Detection & Analysis' END AS phase FROM x""")
def i10_recommendations(spark, d):
    return ops.recommendations(_report_cases(spark, d))


@query(f"""WITH {LOG_SQL}, {_ROLL}, {_CASE_LOG}, {_SEVERITY}, rc AS (SELECT case_id, count(*) AS n_iocs FROM r GROUP BY case_id), un AS (SELECT case_id, count(*) FILTER (k = 13) AS n_untimed FROM cl GROUP BY case_id), c AS (SELECT *, coalesce(n_iocs, 0) AS iocs FROM se LEFT JOIN rc USING (case_id) LEFT JOIN un USING (case_id)),
x AS (SELECT case_id, 0 AS part, 1 AS n, 'no indicator after curation' AS limitation FROM c WHERE iocs = 0 UNION ALL SELECT case_id, 0, 2, 'no anomaly window' FROM c WHERE anomalies = 0 UNION ALL SELECT case_id, 0, 3, 'low evidence' FROM c WHERE iocs = 0 OR anomalies = 0 OR n_answers = 0
UNION ALL SELECT DISTINCT case_id, 1, 0, upper(source) || ': timed out' FROM a1 WHERE error IS NOT NULL UNION ALL SELECT case_id, 2, 4, 'timeline timestamps are missing' FROM c WHERE n_untimed > 0)
SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY part, n, limitation) AS position, limitation FROM x""")
def i11_limitations(spark, d):
    """A timeline entry has no time where k is 13."""
    answers = _answers(spark, d)
    iocs = ops.evidence_rollup(answers, ["case_id", "ioc"]).groupBy("case_id").agg(F.count("*").alias("n_iocs"))
    untimed = _case_log(spark, d).groupBy("case_id").agg(F.count_if(F.col("k") == 13).alias("n_untimed"))
    cases = _severity(spark, d).withColumnRenamed("anomalies", "n_anomalies").join(iocs, "case_id", "left").join(untimed, "case_id", "left").fillna(0)
    errors = answers.filter("error is not null and status <> 'skipped'").select("case_id", "source", "error")
    return ops.limitations(cases, errors).withColumn("position", F.col("position").cast("bigint"))


@query(f"""WITH {LOG_SQL}, {_ROLL}, {_CASE_LOG}, {_SEVERITY}, rc AS (SELECT case_id, count(*) AS n_iocs FROM r GROUP BY case_id), h AS (SELECT case_id, count(DISTINCT lower(ioc)) FILTER (source = 'virustotal_lookup' AND h = 3 OR source = 'greynoise_lookup' AND h IN (2, 3)) AS n_suspicious, count(*) FILTER (error IS NOT NULL) AS n_unavailable FROM a1 GROUP BY case_id),
e0 AS (SELECT case_id, event_template, count(*) AS n, row_number() OVER (PARTITION BY case_id ORDER BY count(*) DESC, event_template) AS i FROM cl GROUP BY case_id, event_template), ev AS (SELECT case_id, string_agg(event_template || ' (' || n || 'x)', ', ' ORDER BY i) AS top_events FROM e0 WHERE i <= 3 GROUP BY case_id),
c AS (SELECT *, coalesce(n_iocs, 0) AS iocs FROM se LEFT JOIN rc USING (case_id) LEFT JOIN h USING (case_id) LEFT JOIN ev USING (case_id))
SELECT case_id, 1 AS position, 'main anomalies' AS finding, anomalies || ': ' || top_events AS detail FROM c WHERE anomalies > 0 UNION ALL SELECT case_id, 2, 'curated indicators', iocs || ': ' || iocs || ' domain' FROM c WHERE iocs > 0
UNION ALL SELECT case_id, 3, 'threat intelligence', hits || ' malicious, ' || n_suspicious || ' suspicious' FROM c WHERE hits > 0 OR n_suspicious > 0 UNION ALL SELECT case_id, 4, 'limited enrichment', CAST(n_unavailable AS VARCHAR) FROM c WHERE hits = 0 AND n_suspicious = 0 AND n_unavailable > 0
UNION ALL SELECT case_id, 5, 'no strong pattern', '' FROM c WHERE anomalies = 0 AND iocs = 0 AND hits = 0 AND n_suspicious = 0 AND n_unavailable = 0""")
def i11_technical_findings(spark, d):
    answers = _answers(spark, d)
    bad = F.coalesce((F.col("classification") == "malicious") | (F.col("malicious") > 0), F.lit(False))
    doubtful = ~bad & ((F.col("classification") == "suspicious") | (F.col("suspicious") > 0))
    hits = answers.groupBy("case_id").agg(F.countDistinct(F.when(bad, F.lower("ioc"))).alias("n_malicious"), F.countDistinct(F.when(doubtful, F.lower("ioc"))).alias("n_suspicious"), F.count("error").alias("n_unavailable"))
    iocs = ops.evidence_rollup(answers, ["case_id", "ioc"]).groupBy("case_id").agg(F.count("*").alias("n_iocs")).withColumn("ioc_types", F.format_string("%d domain", "n_iocs"))
    log = _case_log(spark, d)
    top = windows.first_n(log.groupBy("case_id", "event_template").agg(F.count("*").alias("n")), ["case_id"], [F.desc("n"), "event_template"], 3)
    top = top.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "event_template", "n"))), lambda x: F.format_string("%s (%dx)", x["event_template"], x["n"])), ", ").alias("top_events"))
    cases = hits.join(iocs, "case_id", "left").join(log.groupBy("case_id").agg(F.count("*").alias("n_anomalies")), "case_id", "left").join(top, "case_id", "left").fillna(0)
    return ops.technical_findings(cases)


@query(f"WITH {LOG_SQL}, r AS (SELECT host, line_id, event_template, row_number() OVER (PARTITION BY host ORDER BY line_id) AS p FROM log WHERE y = 1) SELECT host, p AS position, event_template AS entry FROM r WHERE p <= 30 UNION ALL SELECT host, 31, (count(*) - 30) || ' more events' FROM r GROUP BY host HAVING count(*) > 30")
def i12_capped_timeline(spark, d):
    got = ops.capped_timeline(A.structured_log(spark, d).filter("y = 1"), "host", "line_id", "event_template")
    return got.withColumn("position", F.col("position").cast("bigint"))


@query(f"WITH {_ROLL}, s AS (SELECT case_id, 'Summary names ' || min(ioc) AS t FROM r GROUP BY case_id) SELECT s.case_id, count(*) FILTER (contains(t, ioc)) AS terms_named, count(*) AS terms FROM s JOIN r USING (case_id) GROUP BY s.case_id")
def i13_summary_agreement(spark, d):
    r = ops.evidence_rollup(_answers(spark, d), ["case_id", "ioc"]).select("case_id", "ioc")
    s = r.groupBy("case_id").agg(F.concat(F.lit("Summary names "), F.min("ioc")).alias("t"))
    return s.join(r, "case_id").groupBy("case_id").agg(F.count_if(F.contains("t", "ioc")).alias("terms_named"), F.count("*").alias("terms"))


@query(f"WITH {LOG_SQL}, f AS (SELECT host, event_template, min(line_id) AS line_id FROM log WHERE y = 1 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY line_id) AS i FROM f) SELECT host, event_template, line_id FROM r WHERE i <= 8")
def i14_evidence_sample(spark, d):
    f = A.structured_log(spark, d).filter("y = 1").groupBy("host", "event_template").agg(F.min("line_id").alias("line_id"))
    return windows.first_n(f, ["host"], ["line_id"], 8)


@query()
def w20_template_mining(spark, d):
    return templates.mine_templates(A.linux_lines(spark, d).select("line_id", "raw_line"), "raw_line", "line_id").select("line_id", "cluster_id", "template")


@query(f"WITH {LOG_SQL}, {LINUX_SQL}, x AS (SELECT line_id, CASE event_type WHEN 'view' THEN 'LinuxSyslog process=systemd action=started_session' WHEN 'signup' THEN 'LinuxAuth process=sshd action=ssh_accepted_publickey' WHEN 'purchase' THEN 'LinuxAuth process=sudo action=sudo_command' ELSE 'LinuxAuth process=cron action=cron_session_open' END AS event_template FROM linux WHERE event_type <> 'error'), f AS (SELECT event_template, row_number() OVER (ORDER BY min(line_id)) AS event_id FROM x GROUP BY 1) SELECT line_id, event_id, event_template FROM x JOIN f USING (event_template)")
def c01_normal_linux_table(spark, d):
    line = F.col("raw_line")
    rows = A.linux_lines(spark, d).filter("event_type <> 'error'").select("line_id", T.linux_template(line, T.linux_source(line)).alias("event_template"))
    ids = windows.first_seen_ids(rows, "event_template", "line_id", "event_id").select("event_template", "event_id")
    return rows.join(F.broadcast(ids), "event_template").select("line_id", "event_id", "event_template")  # a row for each template


@query(f"WITH {MODEL_SQL}, k AS (SELECT host, kk AS topk, count(*) AS windows, count(*) FILTER (rank IS NULL OR rank > kk) AS anomalies FROM scored, (SELECT unnest([1, 3, 5, 9]) AS kk) GROUP BY ALL) SELECT topk, count(*) AS files, count(*) FILTER (anomalies > 0) AS detected, round(sum(anomalies) / CAST(sum(windows) AS DOUBLE), 6) AS noise FROM k GROUP BY topk")
def c09_corpus_validation(spark, d):
    flags = detect.topk_flags(scored_windows(spark, d).drop("k"), [1, 3, 5, 9]).drop("topk").withColumnRenamed("k", "topk").withColumn("is_miss", F.coalesce("is_miss", F.lit(True)))
    per = flags.groupBy("host", "topk").agg(F.count("*").alias("windows"), F.count_if("is_miss").alias("anomalies"))
    return per.groupBy("topk").agg(F.count("*").alias("files"), F.count_if(F.col("anomalies") > 0).alias("detected"), F.round(F.sum("anomalies") / F.sum("windows"), 6).alias("noise"))


@query(f"""WITH {_ANS}, z AS (SELECT 1 AS round, * FROM a1 WHERE seq % 2 = 0 UNION ALL SELECT 2, * FROM a1), e AS (SELECT round, case_id, count(*) FILTER (verdict = 'error') AS n_errors FROM z GROUP BY ALL), s AS (SELECT * FROM z WHERE verdict <> 'error' AND status NOT IN ('skipped', 'error') AND ioc <> ''),
g AS (SELECT e.round, e.case_id, any_value(n_errors) AS n_errors, count(s.seq) AS n, max(confidence) AS best, count(DISTINCT source) AS n_sources FROM e LEFT JOIN s ON e.round = s.round AND e.case_id = s.case_id GROUP BY ALL)
SELECT round, case_id, n_sources, n_errors, {_CONFIDENCE} AS confidence, CASE WHEN n > 0 THEN 'evidence_collected' ELSE 'inconclusive' END AS status FROM g""")
def c11_case_evidence_rounds(spark, d):
    """Confidence and status of each case after each round's answers, which add to those before."""
    a = _answers(spark, d)
    both = a.filter("seq % 2 = 0").withColumn("round", F.lit(1)).unionByName(a.withColumn("round", F.lit(2))).withColumn("stage", F.struct("round", "case_id"))
    got = ops.case_confidence(both, "stage")
    status = F.when(F.col("factors").startswith("No successful"), "inconclusive").otherwise("evidence_collected")
    return got.select("stage.round", "stage.case_id", "n_sources", "n_errors", "confidence", status.alias("status"))

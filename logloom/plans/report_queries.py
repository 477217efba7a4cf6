"""Queries over rows for reports: P08, P36, P41, P42, I07 and I12 of the survey, and those that share their inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.operators import reports as ops
from logloom.plans.investigate_queries import _ANS, _answers
from logloom.plans.registry import query
from logloom.sources import adapters as A
from logloom.sources.adapters import LINUX_SQL, LOG_SQL

_CLEAN = "CASE WHEN {0} IS NULL OR trim({0}) IN ('', 'nan', 'NaN', 'None') THEN 'Unknown' ELSE trim({0}) END"


@query(f"""WITH {LOG_SQL}, {LINUX_SQL}, r AS (SELECT line_id, 'App ' || host AS source, CASE WHEN event_type = 'error' THEN 'Error' ELSE 'Information' END AS kind, repeat(raw_line || ' ', l.k) AS message,
  CASE l.k % 4 WHEN 0 THEN strftime(to_timestamp(t) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(to_timestamp(t) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') WHEN 2 THEN 'some day' ELSE 'Unknown' END AS timestamp FROM linux l),
m AS (SELECT *, replace(source || '_' || kind, ' ', '') AS event_template, trim(regexp_replace(message, '\\s+', ' ', 'g')) AS c FROM r)
SELECT line_id, timestamp, CASE WHEN kind = 'Error' THEN '1' ELSE '-' END AS label, event_template, md5(CASE WHEN c = '' THEN 'Unknown' WHEN length(c) > 5000 THEN left(c, 5000) || '...' ELSE c END) AS content_md5 FROM m""")
def p08_normal_event_rows(spark, d):
    """Whole rows of an event export, with times of two forms, texts that are no time, and none."""
    t = F.timestamp_seconds("t")
    k = F.col("k") % 4
    time = F.when(k == 0, F.date_format(t, "M/d/yyyy h:mm:ss a")).when(k == 1, F.date_format(t, "yyyy-MM-dd HH:mm:ss")).when(k == 2, "some day").otherwise("")
    rows = A.linux_lines(spark, d).select("line_id", F.concat(F.lit("App "), "host").alias("source"), F.when(F.col("event_type") == "error", "Error").otherwise("Information").alias("kind"), F.repeat(F.concat("raw_line", F.lit(" ")), F.col("k")).alias("message"), time.alias("time"))
    got = ops.normal_event_rows(rows, "line_id", "source", "kind", "message", "time")
    return got.select("line_id", "timestamp", "label", "event_template", F.md5("content").alias("content_md5"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, '<|reserved_special_token_103|>', ''), 'persist ence', 'persistence'), '\r\n?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS report_md5,
  md5(CASE WHEN length(c) <= 180 THEN c ELSE rtrim(left(c, 177)) || '...' END) AS compact_md5 FROM (SELECT doc_id, text, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g') AS c FROM documents)""")
def p36_report_texts(spark, d):
    docs = A.table(spark, d, "documents")
    return docs.select("doc_id", F.md5(ops.report_text(F.col("text"))).alias("report_md5"), F.md5(ops.compact_text(F.col("text"))).alias("compact_md5"))


_TOOLS = [("virustotal", "url", 1), ("urlhaus", "url", 2), ("virustotal", "domain", 1)]


@query(f"""WITH {A.PAGES_SQL}, i AS (SELECT DISTINCT 'g' || page_id % 40 AS case_id, 'url' AS ioc_type, url AS value FROM url_iocs UNION SELECT 'g' || page_id % 40, 'domain', domain FROM url_iocs),
t AS (SELECT * FROM (VALUES ('virustotal', 'url', 1), ('urlhaus', 'url', 2), ('virustotal', 'domain', 1)) AS t(tool, ioc_type, tool_rank)), l AS (SELECT 'g' || page_id % 40 AS case_id, page_id, row_number() OVER (PARTITION BY page_id % 40 ORDER BY page_id) AS i, url, domain FROM url_iocs),
c AS (SELECT case_id, i * 3 - 3 AS position, 'url' AS ioc_type, url AS value, 'urlhaus' AS tool, 'answer' AS origin FROM l WHERE page_id % 40 < 30 UNION ALL SELECT case_id, i * 3 - 2, 'domain', domain, 'virustotal', 'answer' FROM l WHERE page_id % 40 < 30)
SELECT case_id, CAST(position AS BIGINT) AS position, ioc_type, value, tool, origin FROM c
UNION ALL SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY ioc_type, value, tool_rank) - 1, ioc_type, value, tool, 'fallback' FROM i JOIN t USING (ioc_type) WHERE CAST(substr(case_id, 2) AS INTEGER) >= 30""")
def p41_tool_selections(spark, d):
    """Answers of a selector, three lines for each page: two that are right and one that names no tool; the last groups' answers hold no line at all."""
    pages = A.page_iocs(spark, d).withColumn("case_id", F.concat(F.lit("g"), (F.col("page_id") % 40).cast("string")))
    text = F.concat(F.lit(" URL: "), "url", F.lit(" -> UrlHaus \n"), F.lit("domain:"), "domain", F.lit("->virustotal\ndomain:"), "domain", F.lit(" -> shodan"))
    lines = pages.select("case_id", "page_id", F.when(F.col("page_id") % 40 < 30, text).otherwise("none fits").alias("x"))
    answers = lines.groupBy("case_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_id", "x"))), lambda r: r["x"]), "\n").alias("answer"))
    iocs = pages.select("case_id", F.explode(F.array(F.struct(F.lit("url").alias("ioc_type"), F.col("url").alias("value")), F.struct(F.lit("domain").alias("ioc_type"), F.col("domain").alias("value")))).alias("i")).select("case_id", "i.*")
    return ops.tool_selections(answers, iocs, spark.createDataFrame(_TOOLS, "tool string, ioc_type string, tool_rank int"))


@query(f"""WITH {_ANS} SELECT seq, source AS tool, nullif(ioc, '') AS ioc, CASE WHEN seq % 2 = 0 THEN 'url' ELSE 'domain' END AS ioc_type, status, CASE WHEN source = 'greynoise_lookup' THEN CASE WHEN h < 2 THEN 'malicious' WHEN h < 4 THEN 'suspicious' WHEN h < 6 THEN 'benign' ELSE '' END END AS classification,
  CAST(CASE WHEN source = 'virustotal_lookup' THEN 3 - h END AS BIGINT) AS malicious, CAST(CASE WHEN source = 'virustotal_lookup' AND h = 3 THEN 2 END AS BIGINT) AS suspicious, CASE WHEN h = 9 THEN 'request timeout' END AS error, h < 7 AS data_present FROM a1""")
def p42_compact_answers(spark, d):
    """All fields of compact answers; the target stands in another column for each provider."""
    a = _answers(spark, d)
    n = F.col("seq") % 3
    a = a.withColumn("url", F.when(n == 0, F.col("ioc"))).withColumn("domain", F.when(n == 1, F.col("ioc"))).withColumn("ioc", F.when(n == 2, F.col("ioc")).otherwise(""))
    rows = a.select("seq", F.col("source").alias("tool"), "ioc", "url", "domain", F.when(F.col("seq") % 2 == 0, "url").otherwise("domain").alias("ioc_type"), "status", "classification", "malicious", "suspicious", "error", F.when(F.col("h") < 7, "{}").alias("data"))
    return ops.compact_answers(rows)


_TEXT = "'EventID' || CASE WHEN k % 2 = 0 THEN '=' ELSE ' ' END || CASE k % 9 WHEN 0 THEN '1102' WHEN 1 THEN '4663' WHEN 2 THEN '5145' WHEN 3 THEN '4672' WHEN 4 THEN '12' WHEN 5 THEN '1' ELSE '99' END || CASE WHEN k % 4 = 1 THEN ' by Administrator' ELSE '' END"


@query(f"""WITH {LOG_SQL}, x AS (SELECT user_id AS case_id, line_id, k, value, CASE WHEN k % 4 = 1 THEN 1 ELSE 0 END AS b, CASE k % 9 WHEN 0 THEN '1102' WHEN 1 THEN '4663' WHEN 2 THEN '5145' WHEN 3 THEN '4672' WHEN 4 THEN '12' WHEN 5 THEN '1' ELSE '99' END AS e FROM log WHERE y = 1),
p AS (SELECT * FROM (VALUES ('defense evasion', 0, '1102'), ('defense evasion', 1, '4663'), ('discovery', 1, '5145'), ('discovery', 3, '4672'), ('privilege escalation', 1, '12'), ('privilege escalation', 3, '1')) AS p(tactic, place, e)),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id, tactic ORDER BY place, b DESC, value DESC, line_id) AS i FROM x JOIN p USING (e)) SELECT case_id, tactic, line_id, e AS event_id FROM r WHERE i = 1""")
def i07_tactic_anomalies(spark, d):
    rows = A.structured_log(spark, d).filter("y = 1").select(F.col("user_id").alias("case_id"), "line_id", "value", F.expr(_TEXT).alias("text"))
    return ops.tactic_anomalies(rows, "case_id", "line_id", "text", "value")


@query(f"""WITH {_ANS}, {LOG_SQL}, w AS (SELECT 'case_' || user_id % 5 AS case_id, line_id, event_template, row_number() OVER (PARTITION BY user_id % 5 ORDER BY line_id) AS position FROM log WHERE y = 1),
t AS (SELECT case_id, source, ioc, summary, row_number() OVER (PARTITION BY case_id ORDER BY seq) AS position FROM a1 WHERE status <> 'skipped')
SELECT case_id, 'log_window' AS type, position, 'window:' || line_id AS reference, 'Anomalous window with event ''' || event_template || '''' AS description FROM w WHERE position <= 30
UNION ALL SELECT case_id, 'tool_result', position, source || ':' || coalesce(nullif(ioc, ''), 'unknown'), summary FROM t WHERE position <= 30""")
def i12_evidence_references(spark, d):
    anomalies = A.structured_log(spark, d).filter("y = 1").select(F.concat(F.lit("case_"), (F.col("user_id") % 5).cast("string")).alias("case_id"), F.col("line_id").alias("order"), F.col("line_id").alias("window_id"), F.col("event_template").alias("event"))
    answers = _answers(spark, d).select("case_id", F.col("seq").alias("order"), "source", F.col("ioc").alias("target"), "status", "summary")
    return ops.evidence_references(anomalies, answers, "case_id").withColumn("position", F.col("position").cast("bigint"))

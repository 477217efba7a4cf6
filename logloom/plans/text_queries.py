"""Queries over row-wise text operators (P rows of the survey)."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.functions import sysmon, text as T
from logloom.operators import detect, parse, templates
from logloom.plans.registry import query
from logloom.sources import adapters as A
from logloom.sources.adapters import LINUX_SQL, LOG_SQL, PAGES_SQL, SYSMON_SQL


@query(rf"""WITH {LOG_SQL}, {LINUX_SQL}, m AS (SELECT line_id, regexp_replace(raw_line, '\b(?:\d{{1,3}}\.){{3}}\d{{1,3}}\b', '<IP>', 'g') AS a FROM linux), n AS (SELECT line_id, regexp_replace(regexp_replace(a, '\b\d+\b', '<NUM>', 'g'), '\b0x[0-9a-fA-F]+\b', '<HEX>', 'g') AS b FROM m)
SELECT line_id, regexp_replace(b, '[A-Za-z]:\\[\w\\.\-]+', '<PATH>', 'g') AS masked FROM n""")
def p01_mask_tokens(spark, d):
    return A.linux_lines(spark, d).select("line_id", T.mask_tokens(F.col("raw_line")).alias("masked"))


SERVICING_SQL = f"{LOG_SQL}, serv AS (SELECT line_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ', ' || CASE WHEN y = 1 THEN 'Error' ELSE 'Info' END || '                  CBS    ' || CASE WHEN k % 2 = 0 THEN 'Starting TrustedInstaller initialization of ' || event_type || ' number ' || k ELSE event_type || ' ' || k END AS line FROM log WHERE k % 10 <> 3 UNION ALL SELECT line_id, 'continued ' || event_type FROM log WHERE k % 10 = 3)"


def _servicing(spark, d):
    log = A.structured_log(spark, d)
    k = F.col("k").cast("string")
    head = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"), F.lit(", "), F.when(F.col("y") == 1, "Error").otherwise("Info"), F.lit("                  CBS    "))
    body = F.when(F.col("k") % 2 == 0, F.concat(F.lit("Starting TrustedInstaller initialization of "), "event_type", F.lit(" number "), k)).otherwise(F.concat("event_type", F.lit(" "), k))
    return log.select("line_id", F.when(F.col("k") % 10 != 3, F.concat(head, body)).otherwise(F.concat(F.lit("continued "), "event_type")).alias("line"))


_SERV = rf"{SERVICING_SQL}, sp AS (SELECT line_id, regexp_extract(line, '^(\d{{4}}-\d{{2}}-\d{{2}} \d{{2}}:\d{{2}}:\d{{2}}),\s+(\w+)\s+(\w+)\s+(.*)$', ['ts', 'level', 'component', 'content']) AS s FROM serv WHERE regexp_matches(line, '^\d{{4}}-\d{{2}}-\d{{2}} \d{{2}}:\d{{2}}:\d{{2}},\s+\w+\s+\w+\s+')), sw AS (SELECT *, regexp_split_to_array(s.content, '\s+') AS w FROM sp)"


@query(f"WITH {_SERV} SELECT line_id, s.ts AS ts, s.level AS level, s.component AS component, s.component || ' ' || array_to_string(w[1:5], ' ') AS template FROM sw")
def p02_servicing_lines(spark, d):
    rows = _servicing(spark, d).withColumn("s", T.servicing_line(F.col("line"))).filter("s IS NOT NULL")
    return rows.select("line_id", "s.ts", "s.level", "s.component", T.servicing_template(F.col("s.component"), F.col("s.content")).alias("template"))


@query(f"WITH {_SERV} SELECT line_id, s.component || ' ' || CASE WHEN len(w) > 5 THEN array_to_string(w[1:5], ' ') ELSE left(s.content, 50) END AS template_cut, s.component || ' ' || CASE WHEN len(w) > 5 THEN array_to_string(w[1:5], ' ') ELSE s.content END AS template_whole FROM sw")
def p03_servicing_variants(spark, d):
    rows = _servicing(spark, d).withColumn("s", T.servicing_line(F.col("line"))).filter("s IS NOT NULL")
    return rows.select("line_id", T.servicing_template(F.col("s.component"), F.col("s.content"), "cut").alias("template_cut"), T.servicing_template(F.col("s.component"), F.col("s.content"), "whole").alias("template_whole"))


@query(f"WITH {LOG_SQL}, r AS (SELECT line_id, CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN '0' WHEN 2 THEN '  ' ELSE ' ' || host || ' ' END AS v FROM log) SELECT line_id, CASE WHEN v IS NULL OR trim(v) IN ('', '0') THEN 'Unknown' ELSE trim(v) END AS v FROM r")
def p04_clean_value(spark, d):
    k = F.col("k") % 4
    v = F.when(k == 1, "0").when(k == 2, "  ").when(k == 3, F.concat(F.lit(" "), "host", F.lit(" ")))
    return A.structured_log(spark, d).select("line_id", T.clean_value(v).alias("v"))


@query(f"WITH {LOG_SQL} SELECT line_id, replace('App ' || host || '_' || CASE WHEN k % 3 = 0 THEN 'Information' ELSE event_type END, ' ', '') AS template FROM log")
def p05_source_template(spark, d):
    kind = F.when(F.col("k") % 3 == 0, "Unknown").otherwise(F.col("event_type"))
    return A.structured_log(spark, d).select("line_id", T.source_template(F.concat(F.lit("App "), "host"), kind).alias("template"))


@query(f"WITH {LOG_SQL} SELECT line_id, CAST(('0x' || left(md5(event_template), 8))::BIGINT % 100000 AS BIGINT) AS id FROM log")
def p06_stable_id(spark, d):
    return A.structured_log(spark, d).select("line_id", T.stable_id(F.col("event_template")).alias("id"))


@query(f"WITH {LOG_SQL} SELECT line_id, CASE WHEN event_type = 'error' THEN '1' ELSE '-' END AS label FROM log")
def p07_entry_label(spark, d):
    return A.structured_log(spark, d).select("line_id", T.entry_label(F.initcap("event_type")).alias("label"))


@query("SELECT doc_id, CASE WHEN length(text) > 5000 THEN left(text, 5000) || '...' ELSE text END AS content FROM documents")
def p08_row_normaliser(spark, d):
    return A.table(spark, d, "documents").select("doc_id", parse.cut_content(F.col("text"), 5000).alias("content"))


@query(f"WITH {LOG_SQL}, r AS (SELECT line_id, CASE k % 3 WHEN 0 THEN ' None ' WHEN 1 THEN '' ELSE ' ' || host END AS v FROM log) SELECT line_id, CASE WHEN v IS NULL OR trim(v) = '' OR lower(trim(v)) = 'none' THEN 'x' ELSE trim(v) END AS v FROM r")
def p09_clean_event_value(spark, d):
    k = F.col("k") % 3
    v = F.when(k == 0, " None ").when(k == 1, "").otherwise(F.concat(F.lit(" "), "host"))
    return A.structured_log(spark, d).select("line_id", T.clean_event_value(v, "x").alias("v"))


@query(f"WITH {LOG_SQL}, r AS (SELECT line_id, host, CASE WHEN k % 4 = 0 THEN '' ELSE 'Security' END AS channel, k FROM log) SELECT line_id, host || ' EventID=' || k AS provider_eventid, 'EventID ' || k || ' Provider ' || host || CASE WHEN channel <> '' THEN ' Channel ' || channel ELSE '' END AS canonical, 'EventID ' || k || ' Provider ' || host || CASE WHEN channel <> '' THEN ' Channel ' || channel ELSE '' END || ' Task 7 Level 4' AS metadata FROM r")
def p10_template_strategies(spark, d):
    channel = F.when(F.col("k") % 4 == 0, "").otherwise("Security")
    made = [T.event_template(s, F.col("host"), F.col("k"), channel, F.lit("7"), F.lit("4")).alias(n) for s, n in (("provider_eventid", "provider_eventid"), ("windows_evtx_canonical", "canonical"), ("windows_evtx_metadata", "metadata"))]
    return A.structured_log(spark, d).select("line_id", *made)


@query()
def p10_drain_strategy(spark, d):
    """Clusters of event contents by the drain strategy."""
    rows = A.sysmon_rows(spark, d).select("line_id", "host", "content")
    return templates.template_table(templates.with_templates(rows, "drain", "line_id", message="content"))


_KV = r"""\b([A-Za-z_][\w.-]{0,63})=("[^"]*"|''[^'']*''|[^\s,;]+)"""


@query(rf"""WITH {LOG_SQL}, {SYSMON_SQL}, r AS (SELECT line_id, 'src=' || destination_ip || ' dst=' || destination_ip || ' src="b c" port=' || destination_port || ', x' AS t FROM sysmon),
x AS (SELECT line_id, t, regexp_extract_all(t, '{_KV}', 1) AS ks, regexp_extract_all(t, '{_KV}', 2) AS vs, regexp_extract_all(t, '\b(?:\d{{1,3}}\.){{3}}\d{{1,3}}\b') AS ips, regexp_extract_all(t, '\b(?:[a-zA-Z0-9-]+\.)+[a-zA-Z]{{2,}}\b') AS doms FROM r),
p AS (SELECT line_id, unnest(list_concat(ks, list_transform(range(1, len(ips) + 1), lambda i: 'ip_' || i), list_transform(range(1, len(doms) + 1), lambda i: 'domain_' || i))) AS k, unnest(list_concat(list_transform(vs, lambda v: trim(trim(v, '"'), '''')), ips, doms)) AS v, unnest(range(0, len(ks) + len(ips) + len(doms))) AS i FROM x),
n AS (SELECT *, row_number() OVER (PARTITION BY line_id, k ORDER BY i) AS c FROM p WHERE v <> '') SELECT line_id, string_agg(k || CASE WHEN c > 1 THEN '_' || c ELSE '' END || '=' || v, '|' ORDER BY i) AS parameters FROM n GROUP BY line_id""")
def p11_parameters(spark, d):
    rows = A.sysmon_rows(spark, d)
    t = F.concat(F.lit("src="), "destination_ip", F.lit(" dst="), "destination_ip", F.lit(' src="b c" port='), "destination_port", F.lit(", x"))
    return rows.select("line_id", F.array_join(F.transform(T.parameters(t), lambda p: F.concat(p["key"], F.lit("="), p["value"])), "|").alias("parameters"))


@query(rf"""WITH {LOG_SQL}, {LINUX_SQL}, r AS (SELECT line_id, CASE k % 3 WHEN 0 THEN raw_line WHEN 1 THEN 'at 12/03/2024 10:11:12 and 2024-03-12T10:11:12Z ' || raw_line ELSE 'none' END AS t FROM linux)
SELECT line_id, coalesce(nullif(regexp_extract(t, '\b\d{{4}}-\d{{2}}-\d{{2}}[ T]\d{{2}}:\d{{2}}:\d{{2}}(?:\.\d+)?(?:Z|[+-]\d{{2}}:?\d{{2}})?\b'), ''), nullif(regexp_extract(t, '\b\d{{2}}/\d{{2}}/\d{{4}}[ T]\d{{2}}:\d{{2}}:\d{{2}}\b'), ''), nullif(regexp_extract(t, '\b[A-Z][a-z]{{2}}\s+\d{{1,2}}\s+\d{{2}}:\d{{2}}:\d{{2}}\b'), '')) AS stamp FROM r""")
def p12_timestamp_text(spark, d):
    k = F.col("k") % 3
    t = F.when(k == 0, F.col("raw_line")).when(k == 1, F.concat(F.lit("at 12/03/2024 10:11:12 and 2024-03-12T10:11:12Z "), "raw_line")).otherwise("none")
    return A.linux_lines(spark, d).select("line_id", T.timestamp_text(t).alias("stamp"))


@query(f"WITH {LOG_SQL}, {LINUX_SQL} SELECT line_id, CASE WHEN event_type = 'view' THEN 'syslog' ELSE 'auth' END AS source FROM linux")
def p13_linux_source(spark, d):
    return A.linux_lines(spark, d).select("line_id", T.linux_source(F.col("raw_line")).alias("source"))


@query(f"WITH {LOG_SQL}, {LINUX_SQL} SELECT line_id, CASE event_type WHEN 'view' THEN 'LinuxSyslog process=systemd action=started_session' WHEN 'error' THEN 'LinuxAuth process=sshd action=ssh_failed_password' WHEN 'signup' THEN 'LinuxAuth process=sshd action=ssh_accepted_publickey' WHEN 'purchase' THEN 'LinuxAuth process=sudo action=sudo_command' ELSE 'LinuxAuth process=cron action=cron_session_open' END AS template FROM linux")
def p14_linux_template(spark, d):
    line = F.col("raw_line")
    return A.linux_lines(spark, d).select("line_id", T.linux_template(line, T.linux_source(line)).alias("template"))


@query(f"WITH {LOG_SQL} SELECT line_id, CASE WHEN strftime(ts, '%m-%d') = '02-29' THEN 0 ELSE CAST(epoch(try_strptime('2022' || strftime(ts, '-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S')) AS BIGINT) END AS t FROM log")
def p15_linux_epoch(spark, d):
    """A 29 February is no day of 2022 and gives 0."""
    return A.linux_lines(spark, d).select("line_id", T.linux_epoch(F.col("raw_line")).alias("t"))


@query(f"WITH {LOG_SQL} SELECT line_id, CASE WHEN k % 5 = 4 THEN 0 ELSE t END AS t FROM log")
def p16_any_epoch(spark, d):
    log = A.structured_log(spark, d)
    stamp = F.col("ts").cast("timestamp")
    k = F.col("k") % 5
    value = F.when(k == 0, F.col("t").cast("string")).when(k == 1, (F.col("t") * 1000 + 7).cast("string")).when(k == 2, F.concat(F.date_format(stamp, "MMM d, yyyy"), F.lit(" @ "), F.date_format(stamp, "HH:mm:ss"), F.lit(".123"))).when(k == 3, F.date_format(stamp, "yyyy-MM-dd HH:mm:ss")).otherwise("soon")
    return log.select("line_id", T.any_epoch(value).alias("t"))


@query(f"""WITH {LOG_SQL}, x AS (SELECT line_id, k, CASE k % 8 WHEN 0 THEN 'sql_probe' WHEN 1 THEN 'file_probe' WHEN 2 THEN 'xss_probe' WHEN 3 THEN 'remote_code_probe' WHEN 4 THEN 'login' WHEN 5 THEN 'cgi' ELSE 'request' END AS action FROM log)
SELECT line_id, CASE k % 3 WHEN 0 THEN 'ApacheAccess method=GET status=' || (200 + k % 4 * 100) || ' action=' || action WHEN 1 THEN 'ApacheError level=' || CASE WHEN k % 2 = 0 THEN 'error' ELSE 'warn' END || ' action=' || action ELSE 'ApacheLog action=' || action END AS template FROM x""")
def p17_apache_template(spark, d):
    """Access lines, error lines and lines of no form, with requests of each action, some of them URL-encoded."""
    log = A.structured_log(spark, d)
    k = F.col("k") % 8
    path = F.when(k == 0, "/a?q=1+UNION+SELECT+2").when(k == 1, "/a?f=%2E%2E/%2e%2e/etc/passwd").when(k == 2, "/a?x=%3Cscript%3E").when(k == 3, "/a?cmd=ls").when(k == 4, "/Login.php").when(k == 5, "/cgi-bin/t").when(k == 6, "/index.html").otherwise("/img/a.png")
    status = (200 + F.col("k") % 4 * 100).cast("string")
    access = F.concat(F.lit('10.0.0.1 - - [01/Jan/2024:00:00:07 +0000] "get '), path, F.lit(' HTTP/1.1" '), status, F.lit(" 512"))
    error = F.concat(F.lit("[Mon Jan 01 00:00:07.123456 2024] ["), F.when(F.col("k") % 2 == 0, "Error").otherwise("warn:http"), F.lit("] [pid 7] client asked for "), path)
    line = F.when(F.col("k") % 3 == 0, access).when(F.col("k") % 3 == 1, error).otherwise(F.concat(F.lit("asked for "), path))
    return log.select("line_id", T.apache_template(line).alias("template"))


@query()
def p18_host_log_template(spark, d):
    """The template reads the raw line only: a label column is at hand and never used."""
    return parse.host_log_templates(A.linux_lines(spark, d).withColumn("label", F.lit("attack")), "raw_line").select("line_id", "template")


@query(f"WITH {LOG_SQL} SELECT line_id, CASE WHEN k % 4 < 2 THEN 1 ELSE 0 END AS label FROM log")
def p19_free_text_label(spark, d):
    k = F.col("k") % 4
    return A.structured_log(spark, d).select("line_id", T.free_text_label(F.when(k == 0, " Malicious").when(k == 1, "TRUE").when(k == 2, "general").otherwise("0")).alias("label"))


@query(f"WITH {LOG_SQL} SELECT line_id, y FROM log")
def p20_binary_label(spark, d):
    k = F.col("k") % 3
    word = F.when(F.col("y") == 1, F.when(k == 0, "EoRS").when(k == 1, "attack").otherwise("1")).otherwise(F.when(k == 0, "-").when(k == 1, "Normal").otherwise("0"))
    return A.structured_log(spark, d).select("line_id", T.binary_label(word).alias("y"))


@query(f"""WITH {LOG_SQL}, {LINUX_SQL}, h AS (SELECT line_id, unnest(list_filter([CASE WHEN contains(lower(raw_line), 'failed password') AND contains(lower(raw_line), 'root') THEN 'brute' END, CASE WHEN contains(lower(raw_line), 'sudo') THEN 'escalate' END, CASE WHEN contains(lower(raw_line), '10.0.1') THEN 'host' END], lambda x: x IS NOT NULL)) AS l FROM linux),
g AS (SELECT line_id, string_agg(l, '|' ORDER BY l) AS labels FROM h GROUP BY line_id) SELECT line_id, coalesce(labels, '') AS labels, CASE WHEN labels IS NULL THEN '-' ELSE 'attack' END AS label FROM linux LEFT JOIN g USING (line_id)""")
def p21_rule_labels(spark, d):
    rules = spark.createDataFrame([("r1", "brute", ["%Failed password%", "root"]), ("r2", "escalate", ["SUDO"]), ("r3", "host", ["10.0.1"])], "rule_id string, rule_label string, filters array<string>")
    got = T.rule_labels(A.linux_lines(spark, d).select("line_id", "raw_line"), rules, "line_id", "raw_line")
    return got.select("line_id", F.array_join("labels", "|").alias("labels"), "label")


@query(f"WITH {LOG_SQL} SELECT line_id FROM log WHERE k % 5 <> 0 AND k % 7 <> 0 AND y = 0")
def p22_benign_rows(spark, d):
    rows = A.structured_log(spark, d).select("line_id", F.when(F.col("k") % 5 != 0, F.col("k").cast("string")).alias("event_id"), F.when(F.col("k") % 7 == 0, " ").otherwise(F.col("host")).alias("provider"), F.lit("Security").alias("channel"), F.when(F.col("y") == 1, "T1110").alias("mitre_id"), F.lit("").alias("mitre_tactic"))
    return parse.benign(rows).select("line_id")


@query(f"WITH {LOG_SQL}, {SYSMON_SQL} SELECT line_id, image, username, command_line, query_name FROM sysmon")
def p23_key_values(spark, d):
    pairs = T.key_values(F.col("content"))
    return A.sysmon_rows(spark, d).withColumn("p", pairs).select("line_id", *[T.first_value(F.col("p"), k).alias(n) for k, n in (("Image", "image"), ("User", "username"), ("CommandLine", "command_line"), ("QueryName", "query_name"))])


_PORTS = "CASE destination_port WHEN '443' THEN 'web' WHEN '3389' THEN 'rdp' WHEN '53' THEN 'dns' WHEN '700' THEN 'privileged' WHEN '8080' THEN 'high' WHEN '60000' THEN 'ephemeral' ELSE 'unknown' END"
_IMAGES = "CASE WHEN contains(image, 'powershell') THEN 'powershell' WHEN contains(image, 'Temp') THEN 'user_temp' WHEN contains(image, 'Program Files') THEN 'program_files' WHEN contains(image, 'svchost') THEN 'windows_service' WHEN image = 'System' THEN 'system' ELSE 'rundll32' END"
_COMMANDS = "CASE WHEN contains(command_line, '-enc') THEN 'encoded' WHEN contains(command_line, 'curl') THEN 'download' WHEN contains(command_line, 'whoami') THEN 'discovery' WHEN contains(command_line, 'hidden') THEN 'suspicious' ELSE 'other' END"
_ACCESS = "CASE granted_access WHEN '0x1010' THEN 'high' WHEN '1024' THEN 'high' WHEN '0x1' THEN 'low' ELSE 'unknown' END"
_QUERIES = "CASE WHEN query_name = '' THEN 'unknown' WHEN ends_with(query_name, '.local') THEN 'internal' WHEN starts_with(query_name, '10.') THEN 'private' ELSE 'domain' END"
_USERS = "CASE WHEN contains(username, 'SYSTEM') THEN 'system' WHEN contains(username, 'NETWORK') THEN 'network_service' WHEN ends_with(username, '$') THEN 'machine' ELSE 'user' END"
_IPS = "CASE WHEN starts_with(destination_ip, '10.') THEN 'private' WHEN starts_with(destination_ip, '8.') THEN 'public' WHEN starts_with(destination_ip, '127') THEN 'loopback' WHEN starts_with(destination_ip, '169') THEN 'link_local' ELSE 'hostname' END"


@query(rf"""WITH {LOG_SQL}, {SYSMON_SQL} SELECT line_id, {_IMAGES} AS image, {_USERS} AS user_class, {_IPS} AS ip, {_PORTS} AS port,
{_COMMANDS} AS command, {_ACCESS} AS access,
CASE WHEN contains(target_object, 'Run') THEN 'autorun' WHEN contains(target_object, 'Services') THEN 'services' ELSE 'hkcu' END AS registry, {_QUERIES} AS query, CASE WHEN contains(image, 'Windows') THEN 'windows' WHEN contains(image, 'Temp') THEN 'user_temp' WHEN contains(image, 'Program Files') THEN 'program_files' ELSE 'other' END AS path FROM sysmon""")
def p24_field_classes(spark, d):
    made = {"image": sysmon.process_class("image"), "user_class": sysmon.user_class("username"), "ip": sysmon.ip_class("destination_ip"), "port": sysmon.port_class("destination_port"), "command": sysmon.command_class("command_line"), "access": sysmon.access_class("granted_access"), "registry": sysmon.registry_class("target_object"), "query": sysmon.query_class("query_name"), "path": sysmon.path_class("image")}
    rows = A.sysmon_rows(spark, d).select("line_id", *[c.alias(f"{n}_class") for n, c in made.items()])  # no name of an input: a lambda would take the new column
    return rows.toDF("line_id", *made)


@query(f"""WITH {LOG_SQL}, {SYSMON_SQL} SELECT line_id, 'Microsoft-Windows-Sysmon EventID=' || event_id || CASE event_id WHEN 3 THEN ' ImageClass=' || {_IMAGES} || ' UserClass=' || {_USERS} || ' DestinationClass=' || {_IPS} || ' DestinationPortClass=' || {_PORTS}
WHEN 13 THEN ' ImageClass=' || {_IMAGES} || ' RegistryClass=' || CASE WHEN contains(target_object, 'Run') THEN 'autorun' WHEN contains(target_object, 'Services') THEN 'services' ELSE 'hkcu' END || ' UserClass=' || {_USERS}
WHEN 1 THEN ' ImageClass=' || {_IMAGES} || ' CmdClass=' || {_COMMANDS} || ' ParentClass=unknown UserClass=' || {_USERS}
WHEN 10 THEN ' SourceClass=unknown TargetClass=unknown AccessClass=' || {_ACCESS} || ' UserClass=' || {_USERS}
WHEN 22 THEN ' ImageClass=' || {_IMAGES} || ' QueryClass=' || {_QUERIES} || ' UserClass=' || {_USERS} END AS template FROM sysmon""")
def p25_enriched_template(spark, d):
    return A.sysmon_rows(spark, d).select("line_id", sysmon.enriched_template(F.col("event_template"), F.col("content")).alias("template"))


_FIELDS = {"image": "image", "command_line": "command_line", "target_object": "target_object", "user": "username", "destination_ip": "nullif(destination_ip, '')", "destination_port": "nullif(destination_port, '')", "query_name": "nullif(query_name, '')", "granted_access": "granted_access"}


@query(f"WITH {LOG_SQL}, {SYSMON_SQL} SELECT line_id, " + ", ".join(f'{_FIELDS.get(n, "CAST(NULL AS VARCHAR)")} AS "{n}"' for n in parse.IMPORTANT) + " FROM sysmon")
def p26_important_fields(spark, d):
    got = A.sysmon_rows(spark, d).withColumn("f", parse.important_fields(T.key_values(F.col("content"))))
    return got.select("line_id", "f.*")


@query(f"WITH {LOG_SQL}, {SYSMON_SQL} SELECT line_id, 'Microsoft-Windows-Sysmon' AS provider, CAST(event_id AS VARCHAR) AS event_id, concat_ws(' | ', 'Microsoft-Windows-Sysmon EventID=' || event_id, 'image=' || image, 'command_line=' || command_line, 'target_object=' || target_object, coalesce('destination_ip=' || nullif(destination_ip, ''), 'destination_port=' || nullif(destination_port, ''), 'query_name=' || nullif(query_name, ''), 'user=' || username)) AS summary FROM sysmon")
def p27_event_identity(spark, d):
    rows = A.sysmon_rows(spark, d).withColumn("template", F.concat(F.lit("Microsoft-Windows-Sysmon EventID="), F.col("event_id").cast("string")))
    provider, number = parse.event_identity(F.col("template"))
    return rows.withColumn("f", parse.important_fields(T.key_values(F.col("content")))).select("line_id", provider.alias("provider"), number.alias("event_id"), parse.line_summary(F.col("template"), F.col("f")).alias("summary"))


@query(f"WITH {LOG_SQL}, {SYSMON_SQL} SELECT line_id, 'value_1=' || username || '|value_2=' || destination_ip || '|value_3=' || destination_port || CASE WHEN starts_with(destination_ip, 'srv') THEN '|domain=' || destination_ip ELSE '|ip=' || destination_ip END AS typed FROM sysmon")
def p28_typed_values(spark, d):
    typed = parse.typed_values(F.array("username", "destination_ip", "destination_port"))
    return A.sysmon_rows(spark, d).select("line_id", F.array_join(F.transform(typed, lambda p: F.concat(p["key"], F.lit("="), p["value"])), "|").alias("typed"))


@query(f"WITH {LOG_SQL} SELECT line_id, k % 4 <> 0 OR k % 3 = 0 AS is_event_row FROM log")
def p29_event_like_row(spark, d):
    k = F.col("k")
    return A.structured_log(spark, d).select("line_id", parse.event_like(F.when(k % 4 != 0, k.cast("string")), F.when(k % 3 == 0, "p"), F.lit("t"), F.lit("")).alias("is_event_row"))


@query(f"""WITH {LOG_SQL}, {SYSMON_SQL}, r AS (SELECT line_id, lower(image || ' ' || command_line) AS t, event_id, command_line, target_object FROM sysmon)
SELECT line_id, round(CAST(least(1.0, CASE WHEN contains(t, ' -enc ') THEN 0.45 ELSE 0 END + CASE WHEN contains(t, 'rundll32') THEN 0.3 ELSE 0 END + CASE WHEN contains(t, 'powershell') THEN 0.3 ELSE 0 END + CASE WHEN contains(t, '\\temp\\') THEN 0.2 ELSE 0 END + CASE WHEN event_id IN (1, 3, 10, 13, 22) THEN 0.2 ELSE 0 END + CASE WHEN event_id = 10 THEN 0.1 ELSE 0 END + CASE WHEN contains(lower(command_line), '-enc') THEN 0.25 ELSE 0 END) AS DOUBLE), 6) AS score FROM r""".replace("\\\\temp\\\\", "\\temp\\"))
def p30_suspicion_score(spark, d):
    level = F.when(F.col("event_id") == 10, "Error").otherwise("Information")
    score, _ = detect.suspicion(F.concat_ws(" ", "image", "command_line"), F.col("event_id").cast("string"), level, F.col("command_line"), F.col("target_object"))
    return A.sysmon_rows(spark, d).select("line_id", F.round(score, 6).alias("score"))


@query(f"WITH {LOG_SQL}, {SYSMON_SQL} SELECT line_id, CASE k % 6 WHEN 0 THEN 'ip' WHEN 1 THEN 'url' WHEN 2 THEN 'sha256' WHEN 3 THEN 'md5' WHEN 4 THEN 'domain' END AS kind FROM log")
def p31_ioc_type(spark, d):
    k = F.col("k") % 6
    v = F.when(k == 0, "10.1.2.3").when(k == 1, "http://a.example.com/x").when(k == 2, F.sha2("host", 256)).when(k == 3, F.md5("host")).when(k == 4, "bad.example.org").otherwise("setup.exe")
    return A.structured_log(spark, d).select("line_id", T.ioc_type(v).alias("kind"))


@query(f"WITH {LOG_SQL}, {SYSMON_SQL} SELECT line_id, NOT starts_with(destination_ip, '8.') AND NOT starts_with(destination_ip, 'srv') OR ends_with(destination_ip, '.local') AS is_internal FROM sysmon")
def p32_internal_ioc(spark, d):
    return A.sysmon_rows(spark, d).select("line_id", T.internal_ioc(F.col("destination_ip")).alias("is_internal"))


@query(rf"WITH {PAGES_SQL} SELECT page_id, regexp_replace(regexp_replace(lower(trim(url)), '^[a-z]+://', ''), '/+$', '') AS match_key, length(domain) < 4 AS is_low_signal FROM url_iocs")
def p33_ioc_normaliser(spark, d):
    return A.page_iocs(spark, d).select("page_id", T.ioc_match_key(F.col("url")).alias("match_key"), T.low_signal_ioc(F.col("domain")).alias("is_low_signal"))


@query(f"WITH {LOG_SQL}, {SYSMON_SQL} SELECT line_id, CAST(event_id AS VARCHAR) AS event_id, username AS \"user\", image AS process, command_line AS command, nullif(destination_ip, '') AS ip, target_object AS registry FROM sysmon")
def p34_artifacts(spark, d):
    got = A.sysmon_rows(spark, d).withColumn("a", parse.artifacts(T.key_values(F.col("content"))))
    return got.select("line_id", *[F.col(f"a.{c}").alias(c) for c in ("event_id", "user", "process", "command", "ip", "registry")])


@query(f"WITH {LOG_SQL} SELECT line_id, 'failed|login|event|' || event_type AS words FROM log")
def p35_vector_words(spark, d):
    t = F.concat(F.lit("FAILED the LoginEvent 42 of "), "event_type")
    return A.structured_log(spark, d).select("line_id", F.array_join(T.vector_words(t, ("the", "of", "a")), "|").alias("words"))


@query("SELECT doc_id, md5(left(trim(regexp_replace(regexp_replace(text, '[^\\x20-\\x7E]', ' ', 'g'), '\\s+', ' ', 'g')), 200)) AS folded FROM documents")
def p36_text_normalisers(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.md5(T.ascii_fold(F.col("text"), 200)).alias("folded"))


@query(f"""WITH {LOG_SQL} SELECT line_id, CASE k % 7 WHEN 0 THEN 'Containment' WHEN 1 THEN 'Eradication' WHEN 2 THEN 'Recovery' WHEN 3 THEN 'Containment' ELSE 'Detection & Analysis' END AS phase,
CASE k % 7 WHEN 0 THEN 'ioc_block' WHEN 3 THEN 'ioc_block' WHEN 4 THEN 'window_triage' WHEN 5 THEN 'timeline_reconstruction' END AS category FROM log""")
def p37_phase_tag(spark, d):
    k = F.col("k") % 7
    t = F.when(k == 0, "Blokir semua IOC di firewall").when(k == 1, "Hapus berkas itu").when(k == 2, "Restore the backup").when(k == 3, "Block each IOC, then recover").when(k == 4, "Triase window nomor 3").when(k == 5, "Build a timeline").otherwise("Tell people")
    return A.structured_log(spark, d).select("line_id", T.phase_tag(t).alias("phase"), T.action_category(t).alias("category"))


@query(f"WITH {LOG_SQL} SELECT line_id, CASE k % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' END AS severity FROM log")
def p38_severity_word(spark, d):
    k = F.col("k") % 3
    t = F.when(k == 0, "a low thing\nSeverity: High").when(k == 1, "this is not critical; it may turn out to be medium").otherwise("nothing said")
    return A.structured_log(spark, d).select("line_id", T.severity_word(t).alias("severity"))


_REPORT = r"""r AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN 'EventID 10: triage the host of user bob. ' || text WHEN 2 THEN 'Confirmed C2 traffic. [TODO: fill in] No result for a private address. ' || text ELSE 'short' END AS t,
  CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 10 END AS event_id, 'lateral movement' AS tactic, doc_id % 2 = 0 AS has_limits, doc_id % 3 = 0 AS has_internal, CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 0 END AS positives FROM documents)"""
_SOME = lambda words: "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"


@query(rf"""WITH {_REPORT}, x AS (SELECT *, lower(coalesce(t, '')) AS low FROM r), c AS (SELECT doc_id, [
  length(regexp_replace(coalesce(t, ''), '^\s+|\s+$', '', 'g')) >= 80, NOT regexp_matches(low, '\[(?:action item|mitigation measure|specific steps|recommended action|placeholder|todo)[^\]]*\]'),
  event_id IS NULL OR regexp_matches(low, 'eventid\s*=?\s*10\b'), contains(low, 'lateral movement') OR (event_id IS NOT NULL AND contains(low, 'eventid 10')),
  NOT has_limits OR {_SOME(parse.LIMITS)}, NOT has_internal OR {_SOME(parse.LOCAL)},
  positives > 0 OR NOT regexp_matches(low, '(confirmed|terkonfirmasi|terbukti).{{0,40}}(malware|c2|command and control|exfiltration|compromise|kompromi)'), {_SOME(parse.ADVICE)} AND {_SOME(parse.CONCRETE)}] AS ok FROM x),
n AS (SELECT ['non_empty_output', 'no_template_placeholders', 'mentions_primary_event', 'mentions_tactic_or_artifact', 'states_enrichment_limitations', 'calibrates_internal_iocs', 'avoids_unsupported_confirmed_claims', 'has_actionable_recommendation_evidence'] AS names)
SELECT doc_id, len(list_filter(ok, lambda o: o)) / 8.0 AS score, array_to_string(list_filter(list_transform(range(1, 9), lambda i: CASE WHEN ok[i] THEN '' ELSE names[i] END), lambda f: f <> ''), '|') AS failed FROM c, n""")
def p39_report_checks(spark, d):
    """Documents as reports: as they are, with a finding before them, with claims and placeholders, and too short."""
    n, text = F.col("doc_id"), F.col("text")
    t = F.when(n % 4 == 0, text).when(n % 4 == 1, F.concat(F.lit("EventID 10: triage the host of user bob. "), text)).when(n % 4 == 2, F.concat(F.lit("Confirmed C2 traffic. [TODO: fill in] No result for a private address. "), text)).otherwise("short")
    docs = A.table(spark, d, "documents").select("doc_id", t.alias("text"), F.when(n % 5 != 0, 10).alias("event_id"), F.lit("lateral movement").alias("tactic"), (n % 2 == 0).alias("has_limits"), (n % 3 == 0).alias("has_internal"), F.when(n % 6 == 0, 1).otherwise(0).alias("positives"))
    return parse.report_checks(docs).select("doc_id", "score", F.array_join("failed", "|").alias("failed"))


_BLOCK_LINE = "CASE k % 3 WHEN 0 THEN 'INFO dfs.DataNode$PacketResponder: Received block blk_-' || k || '608 of size ' || line_id || ' from /10.250.' || k || '.7:50010' WHEN 1 THEN 'WARN dfs.FSNamesystem: BLOCK* ' || host || ' ask /mnt/data/part to delete blk_' || k || '1' ELSE 'INFO x: a.b ' || event_type || ' (done)' END"


@query(rf"""WITH {LOG_SQL}, r AS (SELECT line_id, {_BLOCK_LINE} AS t FROM log), s AS (SELECT line_id, regexp_replace(array_to_string((string_split_regex(t, '\s+'))[3:], ' '), '[\-~!@#$\\.=%^&*()_+`{{}};'':",\[\]<>]+', ' ', 'g') AS t FROM r),
x AS (SELECT line_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, 'blk_(|-)[0-9]+', '', 'g'), '(/|)([0-9]+\.){{3}}[0-9]+(:[0-9]+|)(:|)', '', 'g'), '[0-9]+', '', 'g'), '/.+', '', 'g'), '\S+\.\S+', '', 'g') AS t FROM s)
SELECT line_id, replace(trim(regexp_replace(t, '\s+', ' ', 'g')), ' ', '$$') AS content FROM x""")
def p40_header_stripped(spark, d):
    """Block-log lines with a header of five words: date, time, thread, level and component."""
    line = F.concat(F.lit("081109 203518 143 "), F.expr(_BLOCK_LINE.replace("||", "||")))
    return A.structured_log(spark, d).select("line_id", T.header_stripped(line).alias("content"))


@query(f"WITH {LOG_SQL} SELECT line_id, CASE k % 3 WHEN 0 THEN 'suspicious' WHEN 1 THEN 'noise' ELSE 'uncertain' END AS verdict FROM log")
def p41_reviewer_verdicts(spark, d):
    k = F.col("k") % 3
    word = F.when(k == 0, "suspicious").when(k == 1, "noise").otherwise("perhaps")
    answer = F.concat(F.lit("Here it is:\n```json\n[{\"window_id\": "), F.col("line_id").cast("string"), F.lit(", \"verdict\": \""), word, F.lit("\"}]\n```"))
    got = parse.reviewer_verdicts(A.structured_log(spark, d).select(answer.alias("answer")), "answer")
    return got.select(F.col("window_id").alias("line_id"), "verdict")


@query(f"WITH {LOG_SQL} SELECT line_id, coalesce(CASE WHEN k % 2 = 0 THEN host END, event_type) AS target, event_template AS summary FROM log")
def p42_compact_answer(spark, d):
    log = A.structured_log(spark, d).select("line_id", F.when(F.col("k") % 2 == 0, F.col("host")).otherwise("").alias("ioc"), F.col("event_type").alias("value"), F.col("event_template").alias("summary"))
    return parse.compact_answers(log).select("line_id", "target", "summary")


@query(f"WITH {LOG_SQL} SELECT line_id, event_type AS category, host || ' EventID=' || k AS event_template, left(repeat(host, 100), 500) AS content, 1 AS label FROM log WHERE y = 1")
def p43_attack_rows(spark, d):
    log = A.structured_log(spark, d).filter("y = 1").select("line_id", F.concat(F.lit("/data/"), "event_type", F.lit("/f.evtx")).alias("path"), F.col("host").alias("provider"), F.col("k").alias("event_id"), F.repeat("host", F.lit(100)).alias("raw"))
    return parse.attack_rows(log)


@query(f"WITH {LOG_SQL} SELECT line_id, 'Sysmon EventID=' || k AS event_template FROM log WHERE y = 0")
def p44_code_rows(spark, d):
    log = A.structured_log(spark, d).select("line_id", F.col("k").alias("code"), F.col("y").alias("class"))
    return parse.code_rows(log, normal_only=True).select("line_id", "event_template")



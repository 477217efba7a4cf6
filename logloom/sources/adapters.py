"""The given tables in the shapes of log data, each with the same statement in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.sources.tables import table

LOG_SQL = """log AS (
  SELECT event_id + 1 AS line_id, event_id, ts, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS t, user_id, value, event_type, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k,
    'host_' || user_id % 20 AS host, event_type || ' k=' || CAST(regexp_extract(props, '[0-9]+') AS INTEGER) % 4 AS event_template,
    CASE WHEN event_type = 'error' THEN 'attack' ELSE '-' END AS label, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y
  FROM events
)"""


def structured_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A structured log: line_id (dense, from 1, in order of time), event_id, ts, t (epoch seconds), host, event_template, label, y."""
    e = table(spark, sf_dir, "events").withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("int"))
    return e.select(
        (F.col("event_id") + 1).alias("line_id"), "event_id", "ts", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), "user_id", "value", "event_type", "k",
        F.concat(F.lit("host_"), (F.col("user_id") % 20).cast("string")).alias("host"),
        F.concat("event_type", F.lit(" k="), (F.col("k") % 4).cast("string")).alias("event_template"),
        F.when(F.col("event_type") == "error", "attack").otherwise("-").alias("label"),
        (F.col("event_type") == "error").cast("int").alias("y"),
    )


LINUX_SQL = """linux AS (
  SELECT line_id, host, t, k, event_type, CASE WHEN event_type = 'purchase' THEN 'sudo' WHEN event_type IN ('error', 'signup') THEN 'sshd[' || user_id || ']' WHEN event_type = 'click' THEN 'CRON[' || user_id || ']' ELSE 'systemd[1]' END AS proc,
    strftime(ts, '%b %d %H:%M:%S') || ' ' || host || ' ' || CASE
      WHEN event_type = 'error' THEN 'sshd[' || user_id || ']: Failed password for root from 10.0.' || user_id % 250 || '.' || k || ' port 22 ssh2'
      WHEN event_type = 'signup' THEN 'sshd[' || user_id || ']: Accepted publickey for user' || user_id || ' from 192.168.1.' || k || ' port 22 ssh2'
      WHEN event_type = 'purchase' THEN 'sudo: user' || user_id || ' : TTY=pts/0 ; PWD=/root ; USER=root ; COMMAND=/bin/ls'
      WHEN event_type = 'click' THEN 'CRON[' || user_id || ']: pam_unix(cron:session): session opened for user root'
      ELSE 'systemd[1]: Started Session ' || k || ' of user root.' END AS raw_line
  FROM log
)"""


def linux_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linux lines in the traditional syslog form: line_id, host, t, k, event_type, raw_line."""
    s = lambda *p: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in p])
    user, k = F.col("user_id").cast("string"), F.col("k").cast("string")
    kind = F.col("event_type")
    text = (
        F.when(kind == "error", s("sshd[", user, "]: Failed password for root from 10.0.", (F.col("user_id") % 250).cast("string"), ".", k, " port 22 ssh2"))
        .when(kind == "signup", s("sshd[", user, "]: Accepted publickey for user", user, " from 192.168.1.", k, " port 22 ssh2"))
        .when(kind == "purchase", s("sudo: user", user, " : TTY=pts/0 ; PWD=/root ; USER=root ; COMMAND=/bin/ls"))
        .when(kind == "click", s("CRON[", user, "]: pam_unix(cron:session): session opened for user root"))
        .otherwise(s("systemd[1]: Started Session ", k, " of user root."))
    )
    return structured_log(spark, sf_dir).select("line_id", "host", "t", "k", "event_type", s(F.date_format(F.col("ts").cast("timestamp"), "MMM dd HH:mm:ss"), " ", F.col("host"), " ", text).alias("raw_line"))


SYSMON_SQL = r"""sysmon AS (
  SELECT line_id, host, event_template, y, CASE event_type WHEN 'error' THEN 10 WHEN 'click' THEN 1 WHEN 'view' THEN 3 WHEN 'signup' THEN 13 ELSE 22 END AS event_id,
    CASE k % 6 WHEN 0 THEN 'C:\Windows\System32\powershell.exe' WHEN 1 THEN 'C:\Users\u' || user_id || '\AppData\Local\Temp\x.exe' WHEN 2 THEN 'C:\Program Files\App\app.exe' WHEN 3 THEN 'C:\Windows\System32\svchost.exe' WHEN 4 THEN 'System' ELSE 'C:\Tools\rundll32.exe' END AS image,
    CASE user_id % 4 WHEN 0 THEN 'NT AUTHORITY\SYSTEM' WHEN 1 THEN 'CORP\user' || user_id WHEN 2 THEN 'NT AUTHORITY\NETWORK SERVICE' ELSE 'CORP\HOST$' END AS username,
    CASE k % 5 WHEN 0 THEN '10.0.0.' || k WHEN 1 THEN '8.8.8.' || k WHEN 2 THEN '127.0.0.1' WHEN 3 THEN '169.254.1.' || k ELSE 'srv' || k || '.corp.local' END AS destination_ip,
    CASE k % 7 WHEN 0 THEN '443' WHEN 1 THEN '3389' WHEN 2 THEN '53' WHEN 3 THEN '700' WHEN 4 THEN '8080' WHEN 5 THEN '60000' ELSE '' END AS destination_port,
    CASE k % 5 WHEN 0 THEN 'powershell -enc AAAA' WHEN 1 THEN 'curl http://x.example.com/a' WHEN 2 THEN 'cmd /c whoami' WHEN 3 THEN 'app.exe -w hidden' ELSE 'notepad.exe' END AS command_line,
    CASE k % 3 WHEN 0 THEN 'HKLM\Software\Microsoft\Windows\CurrentVersion\Run\a' WHEN 1 THEN 'HKLM\System\CurrentControlSet\Services\b' ELSE 'HKCU\Software\c' END AS target_object,
    CASE k % 4 WHEN 0 THEN '0x1010' WHEN 1 THEN '0x1' WHEN 2 THEN '1024' ELSE 'zz' END AS granted_access,
    CASE k % 4 WHEN 0 THEN 'dc01.corp.local' WHEN 1 THEN 'www.example.com.' WHEN 2 THEN '10.1.2.' || k ELSE '' END AS query_name
  FROM log
)"""


def sysmon_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sysmon-like rows with their fields as columns, and content as key=value text."""
    log = structured_log(spark, sf_dir)
    cases = SYSMON_SQL.split("FROM log")[0].split("SELECT ", 1)[1].rstrip().replace("\\", "\\\\")
    rows = log.selectExpr(*[c.strip() for c in _split_columns(cases)])
    parts = [("EventID", F.col("event_id").cast("string")), ("Image", "image"), ("User", "username"), ("DestinationIp", "destination_ip"), ("DestinationPort", "destination_port"), ("CommandLine", "command_line"), ("TargetObject", "target_object"), ("GrantedAccess", "granted_access"), ("QueryName", "query_name")]
    pairs = [F.when(F.col(v) != "", F.concat(F.lit(f"{k}="), F.col(v))) if isinstance(v, str) else F.concat(F.lit(f"{k}="), v) for k, v in parts]
    return rows.withColumn("content", F.concat_ws(" ", *pairs))


def _split_columns(text: str) -> list[str]:
    """Parts between commas that stand at the end of a column, told by AS or by a plain name."""
    out, held = [], ""
    for part in text.split(","):
        held = f"{held},{part}" if held else part
        words = held.split()
        if words[-2:-1] == ["AS"] or len(words) == 1:
            out.append(held)
            held = ""
    return out


LINES_SQL = """lines AS (
  SELECT doc_id, CAST(n - 1 AS BIGINT) AS n, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
)"""


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lines of the documents: doc_id, n (from 0), line."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("n", F.col("n").cast("bigint"))


PAGES_SQL = r"""url_iocs AS (
  SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS domain, 1 + page_id % 7 AS window_id, 'case_' || page_id % 5 AS case_id FROM pages
)"""


def page_iocs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL and domain indicators: page_id, url, domain, window_id, case_id."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", "url", F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1).alias("domain"), (1 + F.col("page_id") % 7).alias("window_id"), F.concat(F.lit("case_"), (F.col("page_id") % 5).cast("string")).alias("case_id"))


SCORED_SQL = """scored AS (
  SELECT doc_id, toxic AS y_true, ((doc_id * 7919) % 1000 + 400 * toxic) / 1400.0 AS score, CASE WHEN ((doc_id * 7919) % 1000 + 400 * toxic) / 1400.0 >= 0.6 THEN 1 ELSE 0 END AS y_pred FROM labels
)"""


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation rows: doc_id, y_true, score (a fixed function of the key and the label), y_pred."""
    score = ((F.col("doc_id") * 7919) % 1000 + 400 * F.col("toxic")) / F.lit(1400.0)
    return table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("y_true"), score.alias("score"), (score >= 0.6).cast("int").alias("y_pred"))

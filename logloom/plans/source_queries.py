"""Queries over readers and writers (S rows of the survey). Files are written from the given tables to the work folder and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from logloom.operators import windows
from logloom.plans.registry import query
from logloom.plans.sequence_queries import _SESSIONS, sessions
from logloom.sources import adapters as A
from logloom.sources import readers as R
from logloom.sources.adapters import LINUX_SQL, LOG_SQL
from logloom.sources.tables import work_dir


def _folder(spark) -> str:
    return f"{work_dir(spark)}/files-{uuid.uuid4().hex}"


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), m AS (SELECT md5(trim(regexp_replace(line, '[\\r\\t]+$', ''))) AS line_md5, trim(regexp_replace(line, '[\\r\\t]+$', '')) AS t FROM l) SELECT line_md5, count(*) AS n FROM m WHERE t <> '' GROUP BY line_md5""")
def s01_text_log(spark, d):
    folder = _folder(spark)
    A.table(spark, d, "documents").select("text").write.text(folder)
    got = R.read_text_log(spark, folder)
    return got.groupBy(F.md5("raw_line").alias("line_md5")).agg(F.count("*").alias("n"))


@query(f"WITH {LOG_SQL} SELECT line_id, CASE WHEN k % 3 = 0 THEN NULL ELSE CAST(t AS VARCHAR) END AS timestamp, host || ' ' || event_type AS raw_line FROM log WHERE k % 4 <> 0")
def s02_csv_log(spark, d):
    log = A.structured_log(spark, d)
    rows = log.select("line_id", F.when(F.col("k") % 4 == 0, "").otherwise(F.concat("host", F.lit("\n"), "event_type")).alias("Message"), F.when(F.col("k") % 3 == 0, "nan").otherwise(F.col("t").cast("string")).alias("TimeGenerated"))
    folder = _folder(spark)
    rows.write.option("header", True).option("quoteAll", True).csv(folder)
    back = spark.read.option("header", True).option("multiLine", True).csv(folder)
    return R.csv_log(back).select(F.col("line_id").cast("bigint").alias("line_id"), "timestamp", "raw_line")


@query(f"WITH {LOG_SQL} SELECT CAST(line_id AS VARCHAR) AS task, CAST(k AS VARCHAR) AS event_id, 'Sysmon' AS provider, host AS computer, 'Sysmon EventID=' || k || ' Type=' || event_type || ' Host=' || host AS raw_line FROM log WHERE k % 9 <> 0")
def s03_event_xml(spark, d):
    c = lambda *p: F.concat(*[F.lit(x) if x[:1] == "<" or x[:1] == "'" or x[:2] == "=\"" else F.col(x).cast("string") for x in p])
    whole = c("<Event xmlns='e'><System><Provider Name='Sysmon'/><EventID>", "k", "</EventID><Task>", "line_id", "</Task><Computer>", "host", "</Computer></System><EventData><Data Name='Type'>", "event_type", "</Data><Data Name='Host'>", "host", "</Data></EventData></Event>")
    rows = A.structured_log(spark, d).select(F.when(F.col("k") % 9 == 0, "<Event><System>broken").otherwise(whole).alias("value"))
    return R.event_xml(rows, "value").select("task", "event_id", "provider", "computer", "raw_line")


@query()
def s04_read_by_extension(spark, d):
    folder = _folder(spark)
    A.linux_lines(spark, d).select("raw_line").write.text(f"{folder}/a.log")
    A.structured_log(spark, d).select(F.col("event_template").alias("Content"), F.col("t").alias("Timestamp")).write.option("header", True).csv(f"{folder}/b.csv")
    return R.read_log(spark, f"{folder}/a.log").unionByName(R.read_log(spark, f"{folder}/b.csv"), allowMissingColumns=True)


@query(f"WITH {LOG_SQL} SELECT line_id, event_template, event_type AS raw_line, CAST(t AS VARCHAR) AS timestamp, CAST(k AS VARCHAR) AS event_id, host FROM log")
def s05_structured_columns(spark, d):
    rows = A.structured_log(spark, d).select(F.col("line_id").alias("LineId"), F.col("event_template").alias("EventTemplate"), F.col("event_type").alias("Content"), F.col("t").alias("Timestamp"), F.col("k").alias("EventId"), "host")
    return R.structured_columns(rows, ("host",))


@query(f"WITH {LOG_SQL} SELECT line_id, y FROM log")
def s06_label_table(spark, d):
    from logloom.functions.text import binary_label

    rows = A.structured_log(spark, d).select("line_id", F.when(F.col("y") == 1, "Attack").otherwise("Normal").alias("Label"))
    folder = _folder(spark)
    rows.write.json(folder)
    back = spark.read.json(folder)
    return back.select("line_id", binary_label(R.first_present(back, *R.LABEL_NAMES)).alias("y"))


@query(f"WITH {LOG_SQL}, {LINUX_SQL} SELECT host, CASE WHEN event_type = 'view' THEN 'syslog' ELSE 'auth' END AS source, count(*) AS n FROM linux GROUP BY ALL")
def s07_recursive_scan(spark, d):
    folder = _folder(spark)
    rows = A.linux_lines(spark, d).select("host", F.when(F.col("event_type") == "view", "syslog").otherwise("auth.log").alias("stream"), F.col("raw_line").alias("value"))
    rows.write.partitionBy("host", "stream").option("compression", "gzip").text(folder)
    got = R.read_text_log(spark, folder, recursive=True)
    got = got.select(F.regexp_extract("file", "host=([^/]+)/", 1).alias("host"), F.regexp_extract("file", "stream=([a-z]+)", 1).alias("source"))
    return got.groupBy("host", "source").agg(F.count("*").alias("n"))


@query(f"WITH {LOG_SQL} SELECT line_id, event_type AS message FROM log WHERE y = 0 AND k % 6 <> 0 ORDER BY line_id LIMIT 500")
def s08_normal_rows(spark, d):
    rows = A.structured_log(spark, d).select("line_id", "label", F.when(F.col("k") % 6 == 0, " ").otherwise(F.col("event_type")).alias("message"))
    return R.normal_rows(rows, "line_id", 500).select("line_id", "message")


@query(f"WITH {LOG_SQL} SELECT line_id AS line, CASE WHEN k % 2 = 0 THEN 'a|b' ELSE 'solo' END AS labels FROM log WHERE y = 1 AND k % 5 <> 0")
def s09_label_sidecar(spark, d):
    k = F.col("k")
    n = F.col("line_id").cast("string")
    value = F.when(k % 5 == 0, "{broken").when(k % 2 == 0, F.concat(F.lit('{"line": '), n, F.lit(', "labels": ["b", "a", "b"]}'))).otherwise(F.concat(F.lit('{"line": '), n, F.lit(', "labels": "solo"}')))
    return R.label_sidecar(A.structured_log(spark, d).filter("y = 1").select(value.alias("value")), "value").withColumn("labels", F.array_join("labels", "|"))


@query(f"WITH {_SESSIONS} SELECT session_id, array_to_string(q, '|') AS events, label FROM seq")
def s10_cached_sessions(spark, d):
    s = sessions(spark, d).select("session_id", "q", F.array(F.lit(0), F.col("label")).alias("label"))
    return R.cached_sessions(s, "q", "label").select("session_id", F.array_join("q", "|").alias("events"), "label")


@query(f"WITH {LOG_SQL}, s AS (SELECT host, string_agg(CAST(k AS VARCHAR), ' ' ORDER BY line_id) AS v, sum(k) AS total FROM log GROUP BY host) SELECT host, len(string_split(v, ' ')) AS n, CAST(total AS BIGINT) AS total FROM s")
def s11_integer_sequences(spark, d):
    got = windows.session_rollup(A.structured_log(spark, d).withColumn("s", F.col("k").cast("string")), "host", "line_id", ("s",))
    rows = R.integer_sequences(got.select("host", F.array_join("s_list", " ").alias("v")), "v")
    return rows.select("host", F.size("sequence").cast("bigint").alias("n"), F.aggregate("sequence", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query(f"WITH {LOG_SQL} SELECT 'blk_' || line_id AS block_id, y FROM log")
def s12_block_labels(spark, d):
    rows = A.structured_log(spark, d).select(F.concat(F.lit("blk_"), F.col("line_id").cast("string")).alias("BlockId"), F.when(F.col("y") == 1, "Anomaly").otherwise("Normal").alias("Label"))
    return R.block_labels(rows)


@query(f"WITH {LOG_SQL} SELECT line_id, event_template FROM log WHERE line_id <= 1000")
def s13_first_lines(spark, d):
    return R.first_lines(A.structured_log(spark, d), "line_id", 1000).select("line_id", "event_template")


@query(f"WITH {LOG_SQL} SELECT event_template, count(*) AS count FROM log GROUP BY 1")
def s14_structured_sink(spark, d):
    folder = _folder(spark)
    R.write_structured(A.structured_log(spark, d).withColumn("raw_line", F.col("event_type")), folder)
    return spark.read.parquet(f"{folder}/templates")


@query(f"WITH {LOG_SQL} SELECT line_id, host, event_type FROM log")
def s15_json_lines_sink(spark, d):
    folder = _folder(spark)
    A.structured_log(spark, d).select("line_id", F.struct("host", "event_type").alias("event")).write.json(folder)
    return spark.read.json(folder).select("line_id", "event.host", "event.event_type")


@query(f"""WITH {LOG_SQL}, r AS (SELECT line_id, unnest([0, 1]) AS part, host FROM log) SELECT line_id, part, CASE part WHEN 0 THEN '{{"index":{{"_index":"logs","_id":"' || line_id || '"}}}}' ELSE '{{"line_id":' || line_id || ',"host":"' || host || '"}}' END AS line FROM r""")
def s16_bulk_records(spark, d):
    rows = A.structured_log(spark, d).select("line_id", "host", F.lit("x").alias("elastic"))
    return R.bulk_records(rows, "logs", "line_id")


@query(f"WITH {LOG_SQL}, r AS (SELECT line_id, unnest(range(greatest(0, CAST(ceil((line_id - 1 - 9) / 5.0) AS BIGINT)), (line_id - 1) // 5 + 1)) AS w FROM log) SELECT line_id, string_agg(CAST(w AS VARCHAR), '|' ORDER BY w) AS window_ids FROM r GROUP BY line_id")
def s17_flat_projection(spark, d):
    rows = windows.window_rows(A.structured_log(spark, d), F.col("line_id") - 1, 10, 5).groupBy("line_id").agg(F.sort_array(F.collect_set("window_id")).alias("ids"))
    return rows.select("line_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), "|").alias("window_ids"))


@query(f"WITH {LOG_SQL} SELECT count(*) AS n_rows, count(DISTINCT (line_id - 1) // 20) AS n_windows, count(*) FILTER (y = 1) AS n_anomalies, count(*) FILTER (y = 1 AND k % 2 = 0) AS n_retained FROM log")
def s18_manifest(spark, d):
    log = A.structured_log(spark, d)
    return log.agg(F.count("*").alias("n_rows"), F.countDistinct(F.floor((F.col("line_id") - 1) / 20)).alias("n_windows"), F.count_if(F.col("y") == 1).alias("n_anomalies"), F.count_if((F.col("y") == 1) & (F.col("k") % 2 == 0)).alias("n_retained"))


@query(f"WITH {LOG_SQL} SELECT line_id, host FROM log WHERE y = 1 UNION ALL SELECT line_id, host FROM log WHERE k < 5")
def s19_observation_sink(spark, d):
    folder, log = _folder(spark), A.structured_log(spark, d)
    R.write_observations(log.filter("y = 1").select("line_id", "host"), folder)
    R.write_observations(log.filter("k < 5").select("line_id", "host"), folder)
    return spark.read.parquet(folder)


@query(f"WITH {LOG_SQL} SELECT host, string_agg(k || ',' || event_type, ' ' ORDER BY line_id) AS line FROM log GROUP BY host")
def s20_sequence_text(spark, d):
    got = windows.session_rollup(A.structured_log(spark, d), "host", "line_id", ("k", "event_type"))
    return got.select("host", R.sequence_text(got, "k_list", ["k_list", "event_type_list"]).alias("line"))

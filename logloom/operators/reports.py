"""Rows for reports: normalised event rows, parsed answers, compact answers, priority anomalies and evidence references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.functions import text as T
from logloom.operators.windows import first_n

#: Forms of times in event exports, tried in this order.
TIME_FORMS = ("M/d/yyyy h:mm:ss a", "M/d/yyyy H:mm:ss", "M/d/yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd")


def usual_time(value: Column) -> Column:
    """The time as yyyy-MM-dd HH:mm:ss; a text that is no time stays as it is."""
    text = F.trim(value)
    found = F.coalesce(*[F.try_to_timestamp(text, F.lit(form)) for form in TIME_FORMS])
    return F.coalesce(F.date_format(found, "yyyy-MM-dd HH:mm:ss"), value)


def normal_event_rows(df: DataFrame, line: str, source: str, entry_type: str, message: str, time: str, most: int = 5000) -> DataFrame:
    """(line_id, timestamp, label, event_id, event_template, content) of exported event rows: cleaned values, times in one form, the template of
    source and type with its stable id, content cut at `most` characters."""
    name, kind = F.coalesce(F.col(source), F.lit("Unknown")), F.coalesce(F.col(entry_type), F.lit("Information"))
    when = T.clean_value(F.col(time))
    content = T.clean_value(F.col(message))
    rows = df.select(F.col(line).alias("line_id"), F.when(when == "Unknown", when).otherwise(usual_time(when)).alias("timestamp"), T.entry_label(kind).alias("label"), T.source_template(name, kind).alias("event_template"), content.alias("c"))
    cut = F.when(F.length("c") > most, F.concat(F.substring("c", 1, most), F.lit("..."))).otherwise(F.col("c"))
    return rows.select("line_id", "timestamp", "label", T.stable_id(F.col("event_template")).alias("event_id"), "event_template", cut.alias("content"))


def report_text(value: Column) -> Column:
    """Text for a report: a model's special token and one known split word mended, line ends as \\n, no more than one empty line in a row."""
    text = F.replace(F.replace(F.coalesce(value, F.lit("")), F.lit("<|reserved_special_token_103|>"), F.lit("")), F.lit("persist ence"), F.lit("persistence"))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "\\r\\n?", "\n"), "\\n{3,}", "\n\n"), "^\\s+|\\s+$", "")


def compact_text(value: Column, most: int = 180) -> Column:
    """Runs of white space as one space; texts of over `most` characters cut and ended by three dots."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), "\\s+", " "), "^ | $", "")
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, most - 3)), F.lit("...")))


def tool_selections(answers: DataFrame, iocs: DataFrame, tools: DataFrame, case: str = "case_id", answer: str = "answer") -> DataFrame:
    """(case, position, ioc_type, value, tool, origin) of lines `type:value -> tool` of an answer that name a tool, a type that it takes and an indicator
    of the case. Cases without any get each indicator with each tool of its type instead (origin fallback, in the tools' order).

    iocs: (case, ioc_type, value); tools: (tool, ioc_type, tool_rank).
    """
    lines = answers.select(case, F.posexplode(F.split(F.coalesce(F.col(answer), F.lit("")), "\n")).alias("position", "line"))
    parts, left = F.split("line", "->"), F.trim(F.split("line", "->")[0])
    named = lines.filter(F.size(parts) == 2).filter(F.contains(left, F.lit(":"))).select(
        case, "position", F.lower(F.trim(F.substring_index(left, ":", 1))).alias("ioc_type"), F.trim(F.regexp_replace(left, "^[^:]*:", "")).alias("value"), F.lower(F.trim(parts[1])).alias("tool"),
    )
    own = iocs.select(case, F.lower("ioc_type").alias("ioc_type"), "value").distinct()
    valid = named.join(tools.select("tool", "ioc_type").distinct(), ["tool", "ioc_type"], "left_semi").join(own, [case, "ioc_type", "value"], "left_semi")
    chosen = valid.select(case, F.col("position").cast("bigint").alias("position"), "ioc_type", "value", "tool", F.lit("answer").alias("origin"))
    bare = answers.select(case).distinct().join(valid.select(case).distinct(), case, "left_anti")
    order = F.row_number().over(W.partitionBy(case).orderBy("ioc_type", "value", "tool_rank")) - 1
    planned = own.join(bare, case, "left_semi").join(tools, "ioc_type").select(case, order.cast("bigint").alias("position"), "ioc_type", "value", "tool", F.lit("fallback").alias("origin"))
    return chosen.unionByName(planned)


#: Headings of recommendations, and what may stand before one (a bullet whose encoding was lost among it).
RECOMMENDATION_HEADING = r"(?i)\b(REKOMENDASI|RECOMMENDATIONS?|TINDAKAN\s+PERBAIKAN|LANGKAH\s+PERBAIKAN|LANGKAH\s+MITIGASI)\b"
RECOMMENDATION_BULLETS = "0123456789.\\-\u00e2\u20ac\u00a2* "


def recommendation_lines(text: Column, most: int = 10) -> Column:
    """The first `most` listed lines of over ten characters between a heading of recommendations and the next line that begins with #."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.struct(F.regexp_replace(x, "^\\s+|\\s+$", "").alias("t"), x.rlike(RECOMMENDATION_HEADING).alias("h")))

    def listed(of: Column) -> Column:
        begin = F.array_position(F.transform(of, lambda x: x["h"]), F.lit(True))
        rest = F.when(begin > 0, F.slice(of, begin.cast("int"), F.size(of))).otherwise(F.slice(of, 1, 0))
        end = F.array_position(F.transform(rest, lambda x: x["t"].startswith("#") & ~x["h"]), F.lit(True))
        within = F.when(end > 0, F.slice(rest, F.lit(1), end.cast("int"))).otherwise(rest)
        found = F.filter(within, lambda x: ~x["h"] & x["t"].rlike("^[0-9*\\-]|^\u00e2\u20ac\u00a2"))
        clean = F.filter(F.transform(found, lambda x: F.regexp_replace(x["t"], f"^[{RECOMMENDATION_BULLETS}]+", "")), lambda x: F.length(x) > 10)
        return F.slice(clean, 1, most)

    return T.bound(lines, listed)


def compact_answers(df: DataFrame) -> DataFrame:
    """Nine fields of provider answers: tool, ioc (the first of ioc, ip, url, hash, domain that is there), ioc_type, status, classification, malicious,
    suspicious, error, data_present. Columns that the table lacks count as null."""
    have = set(df.columns)
    one = lambda name, kind="string": F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
    target = F.coalesce(*[F.nullif(one(n), F.lit("")) for n in ("ioc", "ip", "url", "hash", "domain")])
    data = F.coalesce(F.nullif(F.trim(one("data")), F.lit("")).isNotNull(), F.lit(False))
    kept = [df[c] for c in df.columns if c not in ("tool", "ioc", "ioc_type", "status", "classification", "malicious", "suspicious", "error", "data_present", "data", "ip", "url", "hash", "domain")]
    return df.select(*kept, one("tool").alias("tool"), target.alias("ioc"), one("ioc_type").alias("ioc_type"), one("status").alias("status"), one("classification").alias("classification"), one("malicious", "bigint").alias("malicious"), one("suspicious", "bigint").alias("suspicious"), one("error").alias("error"), data.alias("data_present"))


#: Event ids of a tactic in the order in which they are looked for, and texts of artifacts that raise an anomaly.
TACTIC_EVENTS = {"defense evasion": ("1102", "4663", "5156"), "discovery": ("4661", "5145", "5140", "4672", "5158"), "privilege escalation": ("11", "12", "13", "1")}
PRIORITY_ARTIFACTS = ("administrator", "domain admins", "sam_domain", "samr", "fipsalgorithmpolicy", "security log", "c:\\program.exe", "unquoted")


def tactic_anomalies(anomalies: DataFrame, case: str, order: str, text: str, score: str, tactics: tuple[str, ...] = tuple(TACTIC_EVENTS)) -> DataFrame:
    """(case, tactic, order, event_id): for each tactic the anomaly of the first of its event ids that the case has, an artifact's before others,
    then by score, then the first in order. Cases without any of the ids have no row."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    bonus = F.exists(F.array(*map(F.lit, PRIORITY_ARTIFACTS)), lambda a: F.contains(low, a)).cast("int")
    wanted = [F.when(low.rlike(rf"\beventid\s*=?\s*{e}\b"), F.struct(F.lit(t).alias("tactic"), F.lit(i).alias("place"), F.lit(e).alias("event_id"))) for t in tactics for i, e in enumerate(TACTIC_EVENTS[t])]
    rows = anomalies.select(case, F.col(order).alias("o"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("s"), bonus.alias("b"), F.explode(F.filter(F.array(*wanted), lambda x: x.isNotNull())).alias("w"))
    best = rows.groupBy(case, "w.tactic").agg(F.min(F.struct("w.place", (-F.col("b")).alias("b"), (-F.col("s")).alias("s"), "o", "w.event_id")).alias("m"))
    return best.select(case, "tactic", F.col("m.o").alias(order), "m.event_id")


def evidence_references(anomalies: DataFrame, answers: DataFrame, case: str, n: int = 30) -> DataFrame:
    """(case, type, position, reference, description): the first n anomalies (case, order, window_id, event) and the first n answers that are not
    skipped (case, order, source, target, status, summary)."""
    a = first_n(anomalies, [case], ["order"], n).select(case, F.lit("log_window").alias("type"), "order", F.concat(F.lit("window:"), F.col("window_id").cast("string")).alias("reference"), F.format_string("Anomalous window with event '%s'", F.coalesce("event", F.lit("unknown"))).alias("description"))
    kept = answers.filter(F.coalesce(F.col("status"), F.lit("")) != "skipped")
    b = first_n(kept, [case], ["order"], n).select(case, F.lit("tool_result").alias("type"), "order", F.concat(F.coalesce("source", F.lit("tool")), F.lit(":"), F.coalesce(F.nullif("target", F.lit("")), F.lit("unknown"))).alias("reference"), F.col("summary").alias("description"))
    position = F.row_number().over(W.partitionBy(case, "type").orderBy("order"))
    return a.unionByName(b).withColumn("position", position).drop("order")

"""Row-wise builders: cleaned rows, important fields, summaries, artifacts, checks and reviewer answers."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import text as T


def cut_content(content: Column, most: int) -> Column:
    return F.when(F.length(content) > most, F.concat(F.substring(content, 1, most), F.lit("..."))).otherwise(content)


def host_log_templates(df: DataFrame, line: str) -> DataFrame:
    """Templates of host logs. Only the raw line is read, so that no label or tactic can get into a template."""
    text = F.col(line)
    return df.withColumn("template", T.linux_template(text, F.coalesce(T.linux_source(text), F.lit("linux"))))


def benign(df: DataFrame) -> DataFrame:
    """Rows with event id, provider and channel, and without a technique or tactic."""
    there = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != ""
    return df.filter(there("event_id") & there("provider") & there("channel") & ~there("mitre_id") & ~there("mitre_tactic"))


#: Important fields and the names, in lower case without separators, that stand for them (as beginnings too).
IMPORTANT = {
    "image": ("image", "targetimage", "sourceimage", "newprocessname"), "command_line": ("commandline", "details", "parentcommandline"), "parent_image": ("parentimage",), "image_loaded": ("imageloaded", "loadedimage"),
    "signature": ("signed", "signature"), "signature_status": ("signaturestatus",), "target_object": ("targetobject", "targetfilename", "imagepath"), "object_name": ("objectname",), "object_type": ("objecttype",),
    "relative_target_name": ("relativetargetname",), "share_name": ("sharename",), "access_mask": ("accessmask",), "user": ("user", "targetuser", "parentuser", "subjectusername"), "subject_user": ("subjectusername",),
    "target_user": ("targetusername", "accountname"), "process_name": ("processname",), "hashes": ("hashes", "hash", "sha256", "md5"), "destination_ip": ("destinationip", "destip", "ip"),
    "destination_port": ("destinationport", "destport", "port"), "source_ip": ("sourceip",), "source_port": ("sourceport",), "process_guid": ("processguid", "targetprocessguid", "sourceprocessguid"),
    "process_id": ("processid", "targetprocessid", "sourceprocessid"), "parent_process_id": ("parentprocessid",), "query_name": ("queryname",), "query_results": ("queryresults",), "granted_access": ("grantedaccess",),
    "call_trace": ("calltrace",), "protocol": ("protocol",), "domain": ("domain", "domain1"), "url": ("url", "url1"),
}
SUMMARY_FIELDS = ("image", "command_line", "parent_image", "target_object", "destination_ip", "destination_port", "query_name", "user")


def important_fields(pairs: Column) -> Column:
    """struct of the important fields: the value of the first pair that has one and whose key is or starts with a name of the field; null if none."""
    keyed = F.transform(pairs, lambda p: F.struct(F.regexp_replace(F.lower(p["key"]), "[^a-z0-9]", "").alias("key"), p["value"].alias("value")))
    keyed = F.filter(keyed, lambda p: p["value"] != "")

    def pick(x: Column, names: tuple[str, ...]) -> Column:
        """Pairs are looked through only where the text of all keys, each after a line feed, holds a name of the field."""
        held = F.filter(x["of"], lambda p: reduce(or_, [p["key"].startswith(n) for n in names]))
        return F.when(reduce(or_, [F.contains(x["keys"], F.lit("\n" + n)) for n in names]), F.try_element_at(held, F.lit(1))["value"])

    told = lambda of: F.struct(of.alias("of"), F.concat(F.lit("\n"), F.array_join(of["key"], "\n")).alias("keys"))
    return T.bound(T.bound(keyed, told), lambda x: F.struct(*[pick(x, names).alias(n) for n, names in IMPORTANT.items()]))


def attack_context(template: Column, fields: Column) -> Column:
    """The template and all important fields that are there, names and values, as one text in lower case."""
    parts = [F.when(fields[n].isNotNull(), F.concat(F.lit(f"{n} "), fields[n])) for n in IMPORTANT]
    return F.lower(F.concat_ws(" ", template, *parts))


def event_identity(template: Column) -> tuple[Column, Column]:
    """Provider and event id of a template; null where it names none."""
    number = F.nullif(F.regexp_extract(template, r"\bEventID[= ](\d+)", 1), F.lit(""))
    return F.nullif(F.trim(F.regexp_extract(template, r"^(.*?)\s*\bEventID[= ]\d+", 1)), F.lit("")), number


def line_summary(template: Column, fields: Column) -> Column:
    """The template and the first four of eight fields that are there."""
    parts = F.filter(F.array(*[F.when(fields[n].isNotNull() & (fields[n] != ""), F.concat(F.lit(f"{n}="), fields[n])) for n in SUMMARY_FIELDS]), lambda x: x.isNotNull())
    return F.array_join(F.concat(F.array(template), F.slice(parts, 1, 4)), " | ")


def typed_values(values: Column) -> Column:
    """array<struct<key, value>>: value_n for each value, then the first ip, url, hash and domain among them."""
    numbered = F.transform(values, lambda v, i: F.struct(F.concat(F.lit("value_"), (i + 1).cast("string")).alias("key"), v.alias("value")))
    kinds = (("ip", ("ip",)), ("url", ("url",)), ("hash", ("md5", "sha256")), ("domain", ("domain",)))

    def first_of(kind: tuple[str, ...]) -> Column:
        return F.try_element_at(F.filter(values, lambda v: F.coalesce(T.ioc_type(v).isin(*kind), F.lit(False))), F.lit(1))

    first = [F.struct(F.lit(n).alias("key"), first_of(k).alias("value")) for n, k in kinds]
    return F.concat(numbered, F.filter(F.array(*first), lambda p: p["value"].isNotNull()))


def event_like(event_id: Column, provider: Column, template: Column, raw: Column) -> Column:
    """The row has an event id, or provider and template, or names an EventID."""
    there = lambda c: F.coalesce(c != "", F.lit(False))
    return there(event_id) | (there(provider) & there(template)) | F.coalesce(F.coalesce(F.nullif(template, F.lit("")), raw).rlike(r"\bEventID=\d+\b"), F.lit(False))


#: Artifacts and the keys that may hold them.
ARTIFACTS = {"event_id": ("EventID", "EventId"), "provider": ("Provider",), "channel": ("Channel",), "host": ("Computer", "Hostname"), "user": ("User", "SubjectUserName", "TargetUserName"), "process": ("Image", "NewProcessName"), "command": ("CommandLine",), "share": ("ShareName",), "path": ("TargetFilename", "ObjectName"), "ip": ("DestinationIp", "SourceIp", "IpAddress"), "registry": ("TargetObject",)}


def artifacts(pairs: Column) -> Column:
    """struct of the artifacts: the value of the first key that is there, null if none; pairs are made once for all."""
    return T.columns(pairs, lambda ps: F.struct(*[F.nullif(T.first_value(ps, *keys), F.lit("")).alias(n) for n, keys in ARTIFACTS.items()]))


#: Words that a report's checks look for.
PLACEHOLDER = r"\[(?:action item|mitigation measure|specific steps|recommended action|placeholder|todo)[^\]]*\]"
LIMITS = ("limitation", "limitations", "keterbatasan", "enrichment", "tidak tersedia", "no_result", "no result", "error")
LOCAL = ("private", "internal", "lokal", "local")
CLAIMS = r"(confirmed|terkonfirmasi|terbukti).{0,40}(malware|c2|command and control|exfiltration|compromise|kompromi)"
ADVICE = ("recommend", "recommendation", "rekomendasi", "tindak lanjut", "triage", "triase")
CONCRETE = ("eventid", "user", "process", "registry", "share", "host", "ip")


def report_checks(df: DataFrame, text: str = "text", event_id: str = "event_id", tactic: str = "tactic", has_limits: str = "has_limits", has_internal: str = "has_internal", positives: str = "positives") -> DataFrame:
    """score (share of the eight checks of a report that it passes) and failed (their names, in order).

    has_limits: a lookup failed or found nothing; has_internal: there are internal indicators; positives: malicious and suspicious answers.
    A null event id needs no mention. A null text is empty.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(whole)
    number = F.col(event_id).cast("string")
    some = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    checks = {
        "non_empty_output": F.length(F.regexp_replace(whole, r"^\s+|\s+$", "")) >= 80,
        "no_template_placeholders": ~low.rlike(PLACEHOLDER),
        "mentions_primary_event": number.isNull() | F.regexp_like(low, F.concat(F.lit(r"eventid\s*=?\s*"), number, F.lit(r"\b"))),
        "mentions_tactic_or_artifact": F.contains(low, F.lower(F.coalesce(F.col(tactic), F.lit("")))) | F.coalesce(F.contains(low, F.concat(F.lit("eventid "), number)), F.lit(False)),
        "states_enrichment_limitations": ~F.col(has_limits) | some(LIMITS),
        "calibrates_internal_iocs": ~F.col(has_internal) | some(LOCAL),
        "avoids_unsupported_confirmed_claims": (F.col(positives) > 0) | ~low.rlike(CLAIMS),
        "has_actionable_recommendation_evidence": some(ADVICE) & some(CONCRETE),
    }
    tested = F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(c, F.lit(False)).alias("ok")) for n, c in checks.items()])
    return df.withColumn("failed", F.transform(F.filter(tested, lambda c: ~c["ok"]), lambda c: c["name"])).withColumn("score", 1 - F.size("failed") / float(len(checks)))


def reviewer_verdicts(df: DataFrame, answer: str) -> DataFrame:
    """(window_id, verdict) of JSON arrays in answers, bare or fenced; other verdicts than suspicious, uncertain and noise count as uncertain."""
    rows = df.select(F.explode(F.from_json(F.regexp_extract(answer, r"(?s)(\[.*\])", 1), "array<struct<window_id: bigint, verdict: string>>")).alias("v")).select("v.*")
    low = F.lower(F.trim("verdict"))
    return rows.filter("window_id IS NOT NULL").select("window_id", F.when(low.isin("suspicious", "uncertain", "noise"), low).otherwise("uncertain").alias("verdict"))


def compact_answers(df: DataFrame) -> DataFrame:
    """Answers with the target that they are about: ioc, else value."""
    return df.withColumn("target", F.coalesce(F.nullif("ioc", F.lit("")), F.nullif("value", F.lit(""))))


def attack_rows(df: DataFrame) -> DataFrame:
    """Rows of attack files: category from the folder, provider template, content cut at 500, label 1."""
    return df.select("line_id", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("category"), T.event_template("provider_eventid", F.col("provider"), F.col("event_id")).alias("event_template"), F.substring("raw", 1, 500).alias("content"), F.lit(1).alias("label"))


def code_rows(df: DataFrame, normal_only: bool) -> DataFrame:
    """Rows of event codes with their template; with normal_only those of class 0."""
    rows = df.filter(F.col("class") == 0) if normal_only else df
    return rows.withColumn("event_template", F.concat(F.lit("Sysmon EventID="), F.col("code").cast("string")))

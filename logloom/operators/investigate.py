"""Investigation tables, keyed by case: evidence, verdicts, timelines, mappings and recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.functions.text import action_category, bound
from logloom.operators.similarity import first_unlike
from logloom.operators.windows import first_n


#: The columns of provider answers; those that a table lacks count as null.
ANSWER = {
    "source": "string", "ioc": "string", "status": "string", "error": "string", "reason": "string", "classification": "string", "malicious": "int", "suspicious": "int", "harmless": "int", "malware_family": "string", "threat_type": "string",
    "confidence_level": "double", "signature": "string", "file_type": "string", "url_status": "string", "threat": "string", "pulse_count": "int", "message": "string", "n_vulns": "int", "n_ports": "int", "n_tags": "int",
    "abuse_confidence_score": "int", "total_reports": "int", "is_whitelisted": "boolean", "is_tor": "boolean", "has_data": "boolean",
}


def normal_answers(answers: DataFrame) -> DataFrame:
    """Add verdict (malicious, suspicious, benign, unknown, error), confidence (0 to 1) and summary (the first four signals) to provider answers.

    A verdict starts from the answer's state and its own classification; counts of engines override it, then the provider's own rule. Fixed values:
    the confidences, bounds and provider names.
    """
    there = lambda c: F.coalesce(c != "", F.lit(False))
    count = lambda n: F.greatest(F.coalesce(a[n], F.lit(0)), F.lit(0))
    low = lambda n: F.lower(F.coalesce(a[n], F.lit("")))
    least, most, d = F.least, F.greatest, lambda x: F.lit(float(x))
    a = {n: (F.col(n) if n in answers.columns else F.lit(None)).cast(t) for n, t in ANSWER.items()}

    # (condition, verdict, confidence): the first that holds
    skipped, failed = low("status") == "skipped", there(a["error"]) | (low("status") == "error")
    bad, doubtful = there(a["malware_family"]) | (low("classification") == "malicious") | (count("malicious") > 0), (low("classification") == "suspicious") | (count("suspicious") > 0)
    start = [(skipped | failed, "error", d(0)), (bad, "malicious", d(0.85)), (doubtful, "suspicious", d(0.65)), (low("classification").isin("benign", "clean", "riot"), "benign", d(0.6))]
    by = lambda n: a["source"] == n
    share = F.when(a["confidence_level"] > 1, a["confidence_level"] / 100).otherwise(a["confidence_level"])
    listed = F.when(share.isNull(), 0.8).otherwise(most(d(0), least(share, d(1))))
    score, online = count("abuse_confidence_score"), low("url_status") == "online"

    def counted(s: Column) -> Column:
        harmless = (count("harmless") > 0) & (s["verdict"] == "unknown")
        engines = [(count("malicious") > 0, "malicious", least(d(1), 0.75 + count("malicious") * 0.03)), (count("suspicious") > 0, "suspicious", least(d(0.85), 0.55 + count("suspicious") * 0.05)), (harmless, "benign", d(0.55))]
        return F.struct(_first(engines, s["verdict"], s["confidence"]).alias("e"), harmless.alias("harmless"))

    def told(x: Column) -> Column:
        c = x["e"]["confidence"]
        rules = [
            (by("threatfox_lookup") & (there(a["malware_family"]) | there(a["threat_type"])), "malicious", most(c, listed)),
            (by("malwarebazaar_lookup") & (there(a["signature"]) | F.coalesce(a["has_data"], F.lit(False))), "malicious", most(c, d(0.8))),
            (by("urlhaus_lookup") & online, "malicious", most(c, d(0.75))),
            (by("urlhaus_lookup") & (there(a["threat"]) | (low("url_status") == "offline")), "suspicious", most(c, d(0.6))),
            (by("alienvault_otx_lookup") & (count("pulse_count") > 0), "suspicious", least(d(0.85), 0.55 + count("pulse_count") * 0.04)),
            (by("greynoise_lookup") & low("classification").isin("malicious", "suspicious"), low("classification"), most(c, d(0.65))),
            (by("greynoise_lookup") & (low("classification") == "benign"), "benign", most(c, d(0.6))),
            (by("shodan_internetdb_lookup") & (count("n_vulns") > 0), "suspicious", most(c, least(d(0.85), 0.55 + least(count("n_vulns"), F.lit(6)) * 0.05))),
            (by("abuseipdb_lookup") & (score >= 75), "malicious", most(c, least(d(1), 0.75 + (score - 75) * 0.005))),
            (by("abuseipdb_lookup") & (score >= 25), "suspicious", most(c, least(d(0.85), 0.55 + (score - 25) * 0.006))),
            (by("abuseipdb_lookup") & F.coalesce(a["is_whitelisted"], F.lit(False)), "benign", most(c, d(0.6))),
        ]
        said = lambda n, text: F.concat(F.lit(f"{n}="), count(text).cast("string"))
        tell = lambda n, *fields: [F.when(by(n) & there(a[f]), a[f]) for f in fields]
        shodan = by("shodan_internetdb_lookup")
        signals = [
            F.when(skipped, F.coalesce(F.nullif(a["reason"], F.lit("")), F.lit("tool call skipped"))).when(failed, F.coalesce(F.nullif(a["error"], F.lit("")), F.lit("tool returned error"))),
            F.when(count("malicious") > 0, said("malicious detections", "malicious")).when(count("suspicious") > 0, said("suspicious detections", "suspicious")).when(x["harmless"], said("harmless detections", "harmless")),
            *tell("threatfox_lookup", "malware_family", "threat_type"), *tell("malwarebazaar_lookup", "signature", "file_type"), *tell("urlhaus_lookup", "url_status", "threat"),
            F.when(by("alienvault_otx_lookup") & (count("pulse_count") > 0), said("pulse_count", "pulse_count")), *tell("greynoise_lookup", "classification", "message"),
            F.when(shodan & (count("n_vulns") > 0), said("shodan_vulns", "n_vulns")).when(shodan & (count("n_ports") + count("n_tags") > 0), F.concat(said("shodan_ports", "n_ports"), F.lit(" "), said("tags", "n_tags"))).when(shodan & (low("status") == "not_found"), "not in shodan dataset"),
            F.when(by("abuseipdb_lookup") & ((score > 0) | (count("total_reports") > 0)), F.concat(said("abuseipdb_score", "abuse_confidence_score"), F.lit(" "), said("reports", "total_reports"))),
            F.when(by("abuseipdb_lookup") & F.coalesce(a["is_tor"], F.lit(False)), "tor_exit_node"),
        ]
        none = F.when(F.coalesce(a["has_data"], F.lit(False)), "provider response available").otherwise("no explicit threat signal")
        summary = bound(F.filter(F.array(*signals), lambda t: t.isNotNull()), lambda t: F.when(F.size(t) > 0, F.array_join(F.slice(t, 1, 4), "; ")).otherwise(none))
        return F.struct(_first(rules, x["e"]["verdict"], c).alias("v"), summary.alias("summary"))

    own = [c for c in answers.columns if c not in ("verdict", "confidence", "summary")]
    judged = bound(bound(_first(start, "unknown", d(0.2)), counted), told)
    got = answers.select(*own, F.explode(F.array(judged)).alias("__x"))  # one row: so that the rules are worked out once and not in each use of a verdict
    return got.select(*own, F.col("__x.v.verdict").alias("verdict"), most(d(0), least(F.col("__x.v.confidence"), d(1))).alias("confidence"), F.col("__x.summary").alias("summary"))


def _first(rules: list[tuple], verdict, confidence: Column) -> Column:
    """struct<verdict, confidence> of the first rule that holds, else the given ones."""
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    made = [(test, F.struct(text(v).alias("verdict"), c.cast("double").alias("confidence"))) for test, v, c in rules]
    out = F.when(F.lit(False), F.lit(None))
    for test, value in made:
        out = out.when(F.coalesce(test, F.lit(False)), value)
    return out.otherwise(F.struct(text(verdict).alias("verdict"), confidence.cast("double").alias("confidence")))


def succeeded(verdict: Column, status: Column, ioc: Column) -> Column:
    """The answer can support a finding: no error, not skipped, and about an indicator."""
    return (verdict != "error") & ~F.lower(F.coalesce(status, F.lit(""))).isin("skipped", "error") & (F.coalesce(ioc, F.lit("")) != "")


#: Fixed values.
PRIORITY = {"malicious": 4, "suspicious": 3, "benign": 2, "unknown": 1, "error": 0}


def priority(verdict: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), verdict), F.lit(0))


def evidence_rollup(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each indicator, over the answers that succeeded: verdict and confidence of the answer of highest priority, then confidence, then
    the first; sorted sources; number of answers."""
    best = F.max_by(F.struct("verdict", "confidence"), F.struct(priority(F.col("verdict")), "confidence", (-F.col("seq")).alias("s")))
    got = df.filter(succeeded(F.col("verdict"), F.col("status"), F.col("ioc"))).groupBy(*keys).agg(best.alias("b"), F.array_join(F.sort_array(F.collect_set("source")), "|").alias("sources"), F.count("*").alias("n_answers"))
    return got.select(*keys, "b.verdict", "b.confidence", "sources", "n_answers")


def case_confidence(df: DataFrame, case: str) -> DataFrame:
    """Largest confidence of the answers that succeeded, raised by up to three sources, lowered by up to five errors, within 0 and 1, to three
    places, and what it rests on; 0 where none succeeded. One number for each distinct source and indicator of a case is kept in an aggregate."""
    ok = succeeded(F.col("verdict"), F.col("status"), F.col("ioc"))
    got = df.groupBy(case).agg(F.max(F.when(ok, F.col("confidence"))).alias("best"), F.count_if(ok).alias("n"), F.countDistinct(F.when(ok, F.col("source"))).alias("n_sources"), F.countDistinct(F.when(ok, F.col("ioc"))).alias("n_iocs"), F.count_if(F.col("verdict") == "error").alias("n_errors"))
    value = F.least(F.lit(1.0), F.col("best") + 0.03 * F.least("n_sources", F.lit(3)))
    value = F.when(F.col("n_errors") > 0, F.greatest(F.lit(0.0), value - 0.02 * F.least("n_errors", F.lit(5)))).otherwise(value)
    #: The factors' wording.
    factors = F.concat_ws("; ", F.format_string("%d successful evidence records", "n"), F.format_string("%d enrichment sources", "n_sources"), F.format_string("%d IOC(s) with evidence", "n_iocs"), F.when(F.col("n_errors") > 0, F.format_string("%d error/skipped records excluded from supporting evidence", "n_errors")))
    none = F.lit("No successful non-skipped enrichment evidence was available")
    return got.select(case, "n_sources", "n_errors", F.when(F.col("n") == 0, 0.0).otherwise(F.round(value, 3)).alias("confidence"), F.when(F.col("n") == 0, none).otherwise(factors).alias("factors"))


def case_verdict(df: DataFrame, case: str, order: str = "seq", most: int = 5) -> DataFrame:
    """Verdict and confidence of a case by its answers that succeeded, its gaps, its first findings and the indicators to follow up (the first
    `most` of each, in order of indicator; follow-ups only where there is a gap)."""
    ok = succeeded(F.col("verdict"), F.col("status"), F.col("ioc"))
    n = lambda v: F.count_if(ok & (F.col("verdict") == v))
    got = df.groupBy(case).agg(F.count_if(ok).alias("n_supporting"), n("malicious").alias("n_malicious"), n("suspicious").alias("n_suspicious"))
    rank = F.row_number().over(W.partitionBy(case).orderBy("ioc", order))
    findings = df.filter(ok).select(case, F.concat_ws(" ", "ioc", "source", "verdict").alias("f"), rank.alias("i")).filter(F.col("i") <= most)
    findings = findings.groupBy(case).agg(F.array_join(F.sort_array(F.collect_list(F.struct("i", "f")))["f"], "; ").alias("findings"))
    asked = df.groupBy(case, "ioc").agg(F.min(order).alias("o")).withColumn("i", F.row_number().over(W.partitionBy(case).orderBy("o", "ioc"))).filter(F.col("i") <= most)
    asked = asked.groupBy(case).agg(F.array_join(F.sort_array(F.collect_list(F.struct("i", "ioc")))["ioc"], "|").alias("follow_ups"))
    bad, doubtful = F.col("n_malicious"), F.col("n_suspicious")
    #: Verdicts, confidences and the gaps' wording.
    verdict = F.when(bad > 0, "confirmed_threat").when(doubtful > 0, "suspicious").when(F.col("n_supporting") > 0, "likely_false_positive").otherwise("inconclusive")
    confidence = F.when(bad > 1, "high").when((bad == 1) | (doubtful > 0), "medium").otherwise("low")
    gap = F.when(F.col("n_supporting") == 0, "No successful supporting evidence was available.").when(bad + doubtful == 0, "Evidence did not contain malicious or suspicious verdicts.").otherwise("")
    got = got.withColumns({"verdict": verdict, "confidence": confidence, "gap": gap}).join(findings, case, "left").join(asked, case, "left")
    return got.select(case, "n_supporting", "n_malicious", "n_suspicious", "verdict", "confidence", "gap", F.coalesce("findings", F.lit("")).alias("findings"), F.when(F.col("gap") != "", F.coalesce("follow_ups", F.lit(""))).otherwise("").alias("follow_ups"))


def severity(hits: Column, anomalies: Column) -> Column:
    """HIGH from three malicious indicators, MEDIUM from one or from ten anomalies, else LOW."""
    return F.when(hits >= 3, "HIGH").when((hits >= 1) | (anomalies >= 10), "MEDIUM").otherwise("LOW")


def downstream_hint(df: DataFrame) -> DataFrame:
    """high, medium or low use of a case further on, from its hits and findings."""
    return df.withColumn("utility", F.when(F.col("n_hits") >= 2, "high").when((F.col("n_hits") >= 1) | (F.col("n_findings") >= 3), "medium").otherwise("low"))


SKIP_REASONS = ("unknown_tool", "missing_ioc", "unsupported_type", "internal_ioc", "low_signal", "already_called")


def validate_calls(calls: DataFrame, tools: DataFrame, internal: Column, low_signal: Column, order: str) -> DataFrame:
    """Calls with skip_reason (null: go), each (tool, ioc) once in order, and trace numbers of those that go. tools: (tool, ioc_type)."""
    types = tools.groupBy("tool").agg(F.collect_set("ioc_type").alias("types"))
    rows = calls.join(F.broadcast(types), "tool", "left").withColumn("__n", F.row_number().over(W.partitionBy("tool", F.lower("ioc")).orderBy(order)))
    reason = F.when(F.col("types").isNull(), SKIP_REASONS[0]).when(F.coalesce("ioc", F.lit("")) == "", SKIP_REASONS[1]).when(~F.array_contains("types", F.col("ioc_type")), SKIP_REASONS[2]).when(internal, SKIP_REASONS[3]).when(low_signal, SKIP_REASONS[4]).when(F.col("__n") > 1, SKIP_REASONS[5])
    rows = rows.withColumn("skip_reason", reason)
    trace = F.when(F.col("skip_reason").isNull(), F.format_string("T%04d", F.sum(F.col("skip_reason").isNull().cast("int")).over(W.partitionBy("case_id").orderBy(order))))
    return rows.withColumn("trace_id", trace).drop("types", "__n")


def enrichment_route(df: DataFrame, n_iocs: str = "n_iocs", rounds: str = "rounds", n_usable: str = "n_usable", n_open: str = "n_open", max_rounds: int = 2) -> DataFrame:
    """Where a case goes next, by its indicators, the rounds done, its usable answers and the calls not made yet."""
    c = F.col
    #: The routes, first match first.
    route = F.when(c(n_iocs) == 0, "no_iocs").when(c(rounds) >= max_rounds, "sufficient_evidence").when((c(rounds) > 0) & (c(n_usable) == 0), "no_usable_evidence").when(c(n_open) > 0, "needs_more_evidence").otherwise("sufficient_evidence")
    return df.withColumn("route", route)


def strongest_indicators(iocs: DataFrame, anomalies: DataFrame, n: int = 5) -> DataFrame:
    """The n best of each case's indicators (by priority and confidence) and anomalies (by score), those with evidence ids only.
    iocs: (case_id, name, verdict, confidence, evidence_id), anomalies: (case_id, name, score, evidence_id)."""
    a = iocs.filter("evidence_id IS NOT NULL").select("case_id", F.lit("ioc").alias("kind"), "name", (priority(F.col("verdict")) + F.col("confidence")).alias("weight"), "evidence_id")
    b = anomalies.filter("evidence_id IS NOT NULL").select("case_id", F.lit("anomaly").alias("kind"), "name", (1 + F.col("score")).alias("weight"), "evidence_id")
    return first_n(a.unionByName(b), ["case_id"], [F.desc("weight"), "kind", "name", "evidence_id"], n)


#: Ports of web traffic in a context.
WEB_PORT = r"destination_port[=:]?\s*(80|443|8080|8443)\b"


def techniques(context: Column) -> Column:
    """array<struct<technique, tactic, confidence>> that a context in lower case supports. Techniques and what points to them."""
    has = lambda *words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(context, w))
    row = lambda technique, tactic, confidence: F.struct(F.lit(technique).alias("technique"), F.lit(tactic).alias("tactic"), F.lit(confidence).alias("confidence"))
    shell = F.when(has("powershell"), row("T1059.001", "Execution", "high")).when(has("cmd.exe", "eventid=1"), row("T1059", "Execution", "medium"))
    web = F.when(has("eventid=3", "network", "destination_ip") & context.rlike(WEB_PORT), row("T1071", "Command and Control", "medium"))
    registry = F.when(has("eventid=13") & has("registry", "hkcu", "hklm", "target_object"), row("T1112", "Defense Evasion", "medium"))
    return F.filter(F.array(shell, web, registry), lambda t: t.isNotNull())


def technique_map(df: DataFrame, case: str, context: Column, evidence: str, most: int = 30) -> DataFrame:
    """(case, technique, tactic, confidence, n, evidence_ids): techniques that rows with an evidence id support; high where any row is; the first
    evidence ids, `most` at most, are listed and all are counted."""
    rows = df.filter(F.col(evidence).isNotNull()).select(case, evidence, F.explode(techniques(context)).alias("t")).select(case, evidence, "t.*").distinct()
    ranked = rows.withColumn("r", F.row_number().over(W.partitionBy(case, "technique").orderBy(evidence)))
    got = ranked.groupBy(case, "technique", "tactic").agg(F.min("confidence").alias("confidence"), F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("r") <= most, F.col(evidence)))).alias("ids"))
    return got.select(case, "technique", "tactic", "confidence", "n", F.array_join(F.transform("ids", lambda x: x.cast("string")), "|").alias("evidence_ids"))


#: What is left out of a recommendation before its words are compared.
VALUE_TOKENS = r"`[^`]*`|\b\d+(?:\.\d+)*\b|\b[0-9a-f]{8,}\b"
STOP_WORDS = ("dan", "atau", "yang", "pada", "dengan", "untuk", "dari", "ke", "di", "sebelum", "agar", "bisa", "serta", "berikut", "ini", "itu", "the", "and")


def near_duplicate_texts(df: DataFrame, case: str, order: str, text: str, similarity: float = 0.65, head: int = 8192) -> DataFrame:
    """Texts of each case in order without those that repeat one kept before: equal but for case, of the same action category, or with a word
    set (values, short and stop words left out) of at least that Jaccard similarity. Null and blank texts are left out."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.regexp_replace(F.lower(F.col(text)), VALUE_TOKENS, " "), F.lit("[a-z]+"), F.lit(0)), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS)))
    rows = df.filter(F.coalesce(F.trim(text), F.lit("")) != "")
    return first_unlike(rows, case, order, words, action_category(F.col(text)), similarity, text, head)


def _held(rules: list[tuple], name: str) -> Column:
    """The entries of the rules that hold, numbered by their place in the table."""
    made = [F.when(test, F.struct(F.lit(i + 1).alias("priority"), F.lit(rule).alias(name), detail.cast("string").alias("detail"))) for i, (test, rule, detail) in enumerate(rules)]
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def recommendations(cases: DataFrame) -> DataFrame:
    """(case_id, priority, rule, phase, detail): what a case calls for. cases: case_id, severity, n_anomalies, n_timeline, n_answers, malicious and
    suspicious (arrays of indicators, strongest first), top_anomaly and artifacts (text, empty if none)."""
    bad, doubtful = F.size("malicious"), F.size("suspicious")
    anomalies, top, artifacts = F.col("n_anomalies"), F.col("top_anomaly"), F.col("artifacts")
    first = lambda c, n: F.array_join(F.slice(c, 1, n), ", ")
    rules = [
        (F.upper("severity").isin("CRITICAL", "HIGH") & ((bad > 0) | (anomalies > 0)), "contain_assets", F.when(bad > 0, first("malicious", 3)).otherwise(top)),
        (bad > 0, "block_and_hunt_iocs", first("malicious", 5)),
        (doubtful > 0, "validate_iocs", first("suspicious", 5)),
        (doubtful > 0, "monitor_iocs", first("suspicious", 5)),
        (bad > 0, "recover_hosts", F.lit("")),
        (top != "", "triage_window", top),
        (artifacts != "", "collect_artifacts", artifacts),
        (artifacts != "", "query_first_artifact", F.trim(F.substring_index(artifacts, ",", 1))),
        (F.col("n_timeline") > 0, "rebuild_timeline", F.col("n_timeline")),
        ((anomalies > 0) & (bad == 0) & (doubtful == 0), "compare_with_baseline", anomalies),
        ((F.col("n_answers") > 0) & (bad == 0) & (doubtful == 0), "widen_enrichment", F.lit("")),
    ]
    held = _held(rules, "rule")
    none = F.array(F.struct(F.lit(len(rules) + 1).alias("priority"), F.lit("keep_baseline").alias("rule"), F.lit("").alias("detail")))
    phases = {"contain_assets": "Containment", "block_and_hunt_iocs": "Containment", "monitor_iocs": "Containment", "recover_hosts": "Recovery"}
    phase = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in phases.items() for x in kv]), F.col("rule")), F.lit("Detection & Analysis"))
    rows = cases.select("case_id", F.explode(bound(held, lambda x: F.when(F.size(x) > 0, x).otherwise(none))).alias("r")).select("case_id", "r.*")
    return rows.select("case_id", "priority", "rule", phase.alias("phase"), "detail")


def error_kind(error: Column) -> Column:
    """What kept a provider from answering."""
    low = F.lower(F.coalesce(error, F.lit("")))
    has = lambda *words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    return F.when(has("api key required", "not configured"), "not configured").when(has("404", "not found"), "no public reputation").when(has("timeout"), "timed out").otherwise("unavailable for now")


def limitations(cases: DataFrame, errors: DataFrame) -> DataFrame:
    """(case_id, position, limitation): limits of a case's result. cases: case_id, n_iocs, n_anomalies, n_answers, n_untimed; errors: case_id, source, error
    of the answers that failed (not of skipped ones), each kind of a source once."""
    few = (F.col("n_anomalies") == 0) | (F.col("n_iocs") == 0) | (F.col("n_answers") == 0)
    rules = [(F.col("n_iocs") == 0, "no indicator after curation", F.lit("")), (F.col("n_anomalies") == 0, "no anomaly window", F.lit("")), (few, "low evidence", F.lit("")), (F.col("n_untimed") > 0, "timeline timestamps are missing", F.lit(""))]
    own = cases.select("case_id", F.explode(_held(rules, "rule")).alias("r")).select("case_id", F.when(F.col("r.priority") == 4, 2).otherwise(0).alias("part"), F.col("r.priority").alias("n"), F.col("r.rule").alias("limitation"))
    said = errors.select("case_id", F.concat(F.upper("source"), F.lit(": "), error_kind(F.col("error"))).alias("limitation")).distinct().select("case_id", F.lit(1).alias("part"), F.lit(0).alias("n"), "limitation")
    position = F.row_number().over(W.partitionBy("case_id").orderBy("part", "n", "limitation"))
    return own.unionByName(said).select("case_id", position.alias("position"), "limitation")


def technical_findings(cases: DataFrame) -> DataFrame:
    """(case_id, position, finding, detail): cases: case_id, n_anomalies, top_events, n_iocs, ioc_types, n_malicious, n_suspicious, n_unavailable."""
    c = F.col
    hits = (c("n_malicious") > 0) | (c("n_suspicious") > 0)
    rules = [
        (c("n_anomalies") > 0, "main anomalies", F.concat_ws(": ", c("n_anomalies").cast("string"), "top_events")), (c("n_iocs") > 0, "curated indicators", F.concat_ws(": ", c("n_iocs").cast("string"), "ioc_types")),
        (hits, "threat intelligence", F.format_string("%d malicious, %d suspicious", "n_malicious", "n_suspicious")), (~hits & (c("n_unavailable") > 0), "limited enrichment", c("n_unavailable")),
        ((c("n_anomalies") == 0) & (c("n_iocs") == 0) & ~hits & (c("n_unavailable") == 0), "no strong pattern", F.lit("")),
    ]
    return cases.select("case_id", F.explode(_held(rules, "finding")).alias("r")).select("case_id", F.col("r.priority").alias("position"), "r.finding", "r.detail")


def capped_timeline(df: DataFrame, case: str, order: str, text: str, n: int = 30) -> DataFrame:
    """The first n rows of each case and, where more are there, a row that says how many."""
    ranked = df.withColumn("position", F.row_number().over(W.partitionBy(case).orderBy(order)))
    head = ranked.filter(F.col("position") <= n).select(case, "position", F.col(text).alias("entry"))
    rest = df.groupBy(case).agg(F.count("*").alias("c")).filter(F.col("c") > n).select(case, F.lit(n + 1).alias("position"), F.format_string("%d more events", F.col("c") - n).alias("entry"))
    return head.unionByName(rest)

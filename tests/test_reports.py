"""Rows for reports against rows written out by hand."""

from pyspark.sql import functions as F

from logloom.operators import reports


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


def test_times_of_event_exports(spark):
    for given, want in (("11/14/2020 3:16:29 AM", "2020-11-14 03:16:29"), ("11/4/2020 13:16:29", "2020-11-04 13:16:29"), (" 2020-11-14T03:16:29 ", "2020-11-14 03:16:29"), ("2020-11-14", "2020-11-14 00:00:00"), ("14 o'clock", "14 o'clock"), ("13/45/2020", "13/45/2020")):
        assert one(spark, reports.usual_time, given) == want, given
    rows = spark.createDataFrame([(1, None, None, None, None), (2, "A b", "Error", "x" * 5001, "11/14/2020 3:16:29 PM")], "i int, s string, k string, m string, t string")
    a, b = reports.normal_event_rows(rows, "i", "s", "k", "m", "t").orderBy("line_id").collect()
    assert (a["timestamp"], a["label"], a["event_template"], a["content"]) == ("Unknown", "-", "Unknown_Information", "Unknown")
    assert (b["timestamp"], b["label"], b["event_template"]) == ("2020-11-14 15:16:29", "1", "Ab_Error") and b["content"] == "x" * 5000 + "..."


def test_report_texts(spark):
    assert one(spark, reports.report_text, " \n a persist ence<|reserved_special_token_103|>\r\nb\r\n\r\n\r\n\rc \t") == "a persistence\nb\n\nc"
    assert one(spark, reports.report_text, None) == "" == one(spark, reports.compact_text, None)
    assert one(spark, reports.compact_text, "  a \n b ") == "a b"
    assert one(spark, reports.compact_text, "x" * 180) == "x" * 180 and one(spark, reports.compact_text, "x" * 176 + "  yyyy") == "x" * 176 + "..."


ANSWER = """Summary - not this one, it stands before
## REKOMENDASI
1. Isolate the host at once
- short
* **Reset** the account of the user
plain text is no item
Recommendations (continued):
â€¢ Block the address on the firewall
# Appendix
- this stands behind the end"""


def test_recommendation_lines(spark):
    assert one(spark, reports.recommendation_lines, ANSWER) == ["Isolate the host at once", "Reset** the account of the user", "Block the address on the firewall"]
    assert one(spark, reports.recommendation_lines, "- no heading is here at all") == [] == one(spark, reports.recommendation_lines, None)
    assert len(one(spark, reports.recommendation_lines, "Recommendations\n" + "- eleven letters\n" * 14)) == 10


def test_tool_selections(spark):
    answers = spark.createDataFrame([("a", "ip:1.2.3.4 -> Tool1\nip:1.2.3.4->tool2\nip:9.9.9.9 -> tool1\nno arrow\nip:1.2.3.4 -> tool1 -> tool1\nnocolon -> tool1\nurl: http://x:80/a -> tool2"), ("b", "nothing"), ("c", None)], "case_id string, answer string")
    iocs = spark.createDataFrame([("a", "IP", "1.2.3.4"), ("a", "url", "http://x:80/a"), ("b", "ip", "5.5.5.5"), ("c", "domain", "d.e")], "case_id string, ioc_type string, value string")
    tools = spark.createDataFrame([("tool1", "ip", 1), ("tool2", "url", 1), ("tool3", "ip", 2)], "tool string, ioc_type string, tool_rank int")
    got = sorted(tuple(r) for r in reports.tool_selections(answers, iocs, tools).collect())
    assert got == [("a", 0, "ip", "1.2.3.4", "tool1", "answer"), ("a", 6, "url", "http://x:80/a", "tool2", "answer"), ("b", 0, "ip", "5.5.5.5", "tool1", "fallback"), ("b", 1, "ip", "5.5.5.5", "tool3", "fallback")]


def test_compact_answers(spark):
    rows = spark.createDataFrame([(1, "", "u", "h", 3, "{}"), (2, None, None, "h", None, " ")], "n int, ip string, url string, hash string, malicious int, data string")
    a, b = reports.compact_answers(rows).orderBy("n").collect()
    assert (a["ioc"], a["malicious"], a["data_present"], a["tool"]) == ("u", 3, True, None) and (b["ioc"], b["data_present"]) == ("h", False)


def test_tactic_anomalies(spark):
    rows = [("c", 1, "Security EventID=4663 x", 0.9), ("c", 2, "EventID 1102", 0.1), ("c", 3, "eventid = 1102 Security Log cleared", 0.05), ("c", 4, "EventID=11020", 0.9), ("c", 5, "EventID=5145", None), ("d", 6, "EventID=1", 0.3), ("d", 7, "EventID=1", 0.3), ("e", 8, None, 1.0)]
    df = spark.createDataFrame(rows, "case_id string, n int, t string, s double")
    got = sorted(tuple(r) for r in reports.tactic_anomalies(df, "case_id", "n", "t", "s").collect())
    assert got == [("c", "defense evasion", 3, "1102"), ("c", "discovery", 5, "5145"), ("d", "privilege escalation", 6, "1")]


def test_evidence_references(spark):
    anomalies = spark.createDataFrame([("c", i, i, None if i == 0 else "e") for i in range(40)], "case_id string, `order` int, window_id int, event string")
    answers = spark.createDataFrame([("c", i, "vt", "" if i == 1 else "t", "skipped" if i == 0 else None, f"s{i}") for i in range(5)], "case_id string, `order` int, source string, target string, status string, summary string")
    got = sorted(tuple(r) for r in reports.evidence_references(anomalies, answers, "case_id").select("type", "position", "reference", "description").collect())
    assert len(got) == 34 and got[0] == ("log_window", 1, "window:0", "Anomalous window with event 'unknown'") and got[30] == ("tool_result", 1, "vt:unknown", "s1")

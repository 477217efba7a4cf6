"""Literal cases: the rules as the survey states them."""

import pytest
from pyspark.sql import functions as F

from logloom.functions import sysmon, text as T
from logloom.operators import detect, evaluate, investigate, parse, templates, windows


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("_")]).select(column.alias("x")).first()["x"]


LINES = [
    ("Mar  3 09:15:02 gate7 sudo:   mira : TTY=pts/4 ; PWD=/srv ; USER=root ; COMMAND=/usr/bin/tail /var/log/app", "auth", "LinuxAuth process=sudo action=sudo_command"),
    ("type=USER_LOGIN msg=audit(1700000000.250:77): pid=9 uid=0 msg='op=login acct=\"mira\" exe=\"/usr/sbin/sshd\" res=failed'", "audit", "LinuxAudit type=USER_LOGIN op=login exe=<sys> res=failed"),
    ("Mar  3 09:15:04 gate7 systemd[1]: Started Session 8 of user mira.", "syslog", "LinuxSyslog process=systemd action=started_session"),
    ("Mar 13 23:59:59 gate7 sshd(pam_unix)[501]: authentication failure; logname= uid=0 tty=ssh rhost=192.0.2.9", "auth", "LinuxAuth process=sshd action=pam_auth_failure"),
]


def test_linux_templates(spark):
    rows = spark.createDataFrame([(i, x[0]) for i, x in enumerate(LINES)], "i int, l string")
    got = rows.select("i", T.linux_source(F.col("l")).alias("s"), T.linux_template(F.col("l"), T.linux_source(F.col("l"))).alias("t")).orderBy("i").collect()
    assert [(r["s"], r["t"]) for r in got] == [x[1:] for x in LINES]


def test_linux_epoch(spark):
    assert one(spark, T.linux_epoch(F.col("l")), l=LINES[1][0]) == 1700000000
    assert one(spark, T.linux_epoch(F.col("l"), 2022), l=LINES[0][0]) == 1646298902
    assert one(spark, T.linux_epoch(F.col("l")), l="x 2024-01-02T03:04:05+0100 y") == 1704161045
    assert one(spark, T.linux_epoch(F.col("l")), l="nothing") == 0


CASES = [
    (3, "Image=D:\\tools\\pwsh.exe User=LAB\\mira DestinationIp=192.168.7.7 DestinationPort=5000", ["EventID=3", "ImageClass=powershell", "UserClass=user", "DestinationClass=private", "DestinationPortClass=high"]),
    (1, "Image=D:\\tools\\pwsh.exe CommandLine=\"pwsh -EncodedCommand QQBB\" ParentImage=C:\\x\\cmd.exe User=LAB\\mira", ["EventID=1", "ImageClass=powershell", "CmdClass=encoded", "ParentClass=cmd", "UserClass=user"]),
    (10, "SourceImage=C:\\x\\regsvr32.exe TargetImage=C:\\y\\lsass.exe GrantedAccess=0x1010 User=NT AUTHORITY\\SYSTEM", ["EventID=10", "SourceClass=regsvr32", "TargetClass=lsass", "AccessClass=high", "UserClass=system"]),
    (7, "Image=C:\\x\\cmd.exe ImageLoaded=C:\\Windows\\System32\\a.dll User=LAB\\mira", ["EventID=7", "ImageClass=cmd", "UserClass=user"]),
    (23, "Image=C:\\x\\cmd.exe TargetFilename=C:\\Users\\m\\a.txt User=LAB\\mira", ["EventID=23", "ImageClass=cmd", "UserClass=user"]),
    (5, "Image=C:\\x\\cmd.exe User=LAB\\HOST$", ["EventID=5", "ImageClass=cmd", "UserClass=machine"]),
    (99, "User=LAB\\mira", ["EventID=99", "UserClass=user"]),
]


@pytest.mark.parametrize(("number", "fields", "want"), CASES)
def test_enriched_templates(spark, number, fields, want):
    head = f"Microsoft-Windows-Sysmon EventID={number}"
    got = one(spark, sysmon.enriched_template(F.col("t"), F.col("c")), t=head, c=f"{head} {fields}")
    assert all(w in got.split() for w in want), got


def test_labels(spark):
    words = ["-", "Normal", "0", "EoRS", "EoHT", "1"]
    rows = spark.createDataFrame(list(enumerate(words)), "i int, w string").orderBy("i")
    assert [r["y"] for r in rows.select(T.binary_label(F.col("w")).alias("y")).collect()] == [0, 0, 0, 1, 1, 1]
    with pytest.raises(Exception, match="unknown label"):
        one(spark, T.binary_label(F.col("w")), w="perhaps")


def test_parameters_suffix_and_quotes(spark):
    got = one(spark, T.parameters(F.col("t")), t="a=1 a=\"b c\" ip 10.0.0.1 http://x.example.com/y")
    assert [(p["key"], p["value"]) for p in got] == [("a", "1"), ("a_2", "b c"), ("ip_1", "10.0.0.1"), ("domain_1", "x.example.com"), ("url_1", "http://x.example.com/y")]


@pytest.mark.parametrize(("value", "kind"), [("8.8.8.8", "ip"), ("::1", "ip"), ("http://a.b/c", "url"), ("a" * 64, "sha256"), ("a" * 32, "md5"), ("evil.example.org", "domain"), ("setup.exe", None), ("C:\\x\\y.dll", None), ("not a domain", None)])
def test_ioc_types(spark, value, kind):
    assert one(spark, T.ioc_type(F.col("v")), v=value) == kind


def test_metrics_and_calibration(spark):
    rows = spark.createDataFrame([(0, 0, 0.1), (0, 1, 0.7), (1, 0, 0.2), (1, 1, 0.9)], "y_true int, y_pred int, score double")
    m = evaluate.metrics(evaluate.confusion(rows)).first()
    assert (m["tn"], m["fp"], m["fn"], m["tp"], m["precision"], m["recall"]) == (1, 1, 1, 1, 0.5, 0.5)
    rows = spark.createDataFrame([(1, 0.9, 0), (1, 0.6, 0), (0, 0.8, 0), (0, 0.1, 0)], "y_true int, score double, base int")
    best = evaluate.recommended(evaluate.calibrate(rows, "score", "y_true", "base", 0.75)).first()
    assert (best["threshold"], round(best["f1"], 6)) == (0.6, 0.8)
    with pytest.raises(ValueError, match="no threshold"):
        evaluate.recommended(evaluate.calibrate(rows, "score", "y_true", "base", 1.1))
    with pytest.raises(ValueError, match="healthy"):
        evaluate.recommended(evaluate.calibrate(rows, "score", "y_true", "base", 0.75, min_precision=0.99), True)


def test_promotion_gate(spark):
    rows = spark.createDataFrame([(1, 0.72, 0.84, 0.77, 0.22), (2, 0.40, 0.95, 0.56, 0.80)], "i int, precision double, recall double, f1 double, fpr double")
    got = {r["i"]: (r["passed"], sorted(r["failed_criteria"])) for r in evaluate.promotion_gate(rows).collect()}
    assert got == {1: (True, []), 2: (False, ["false_positive_rate", "precision", "precision_recall_gap"])}


def test_suspicion_score_is_capped(spark):
    score, reasons = detect.suspicion(F.lit("powershell encodedcommand mimikatz lsass"), F.lit("10"), F.lit("Error"), F.lit("x -enc y"), F.lit("c:\\temp\\a"))
    got = spark.range(1).select(score.alias("s"), reasons.alias("r")).first()
    assert got["s"] == 1.0 and "term:mimikatz" in got["r"] and "field:target_object" in got["r"]


def test_policy_never_removes(spark):
    rows = spark.createDataFrame([(True, True, "deeplog_topk_miss", 0.1), (False, False, "evaluated", 0.95), (False, False, "skipped_unknown", 0.99)], "is_anomaly boolean, strict_is_anomaly boolean, evaluation_status string, anomaly_score double")
    assert [r["is_anomaly"] for r in detect.apply_policy(rows, "f1_constrained_recall", 0.9).collect()] == [True, True, False]
    with pytest.raises(ValueError):
        detect.apply_policy(rows, "other")


def test_unknown_bursts_are_repeatable_and_short(spark):
    rows = spark.range(500).select(F.lit("h").alias("host"), F.col("id").alias("line_id"), F.lit("e").alias("event"))
    a, b = (windows.unknown_bursts(rows, "host", "line_id", "event", 0.05).orderBy("line_id").collect() for _ in range(2))
    assert a == b and 10 < sum(r["is_burst"] for r in a) < 250
    assert all((r["event"] == "<UNK>") == r["is_burst"] for r in a)


def test_number_rows_is_dense_and_ordered(spark):
    got = windows.number_rows(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(5), "v").orderBy("v").collect()
    assert [r["line_id"] for r in got] == list(range(1, 1001))
    assert windows.number_rows(spark.range(0).select(F.col("id").alias("v")), "v").count() == 0


def test_template_mining(spark):
    rows = spark.createDataFrame([(i, f"user u{i} logged in from host{i}") for i in range(20)] + [(99, "disk full")], "i int, m string")
    got = {r["i"]: r["template"] for r in templates.mine_templates(rows, "m", "i").collect()}
    assert len({got[i] for i in range(20)}) == 1 and got[0].count("<*>") == 2 and got[99] == "disk full"


def test_near_duplicate_texts(spark):
    texts = ["Review host alpha 10.0.0.1 today", "review HOST alpha 10.0.0.9 today", "Reset all accounts", "Validasi IOC pada proxy", "Segera validasi semua IOC lain di sini", "", None, "reset ALL accounts"]
    rows = spark.createDataFrame([("c", i, t) for i, t in enumerate(texts)], "c string, o int, t string")
    assert [r["o"] for r in investigate.near_duplicate_texts(rows, "c", "o", "t").orderBy("o").collect()] == [0, 2, 3]


ANSWERS = [  # source, fields, verdict, confidence, summary
    ("threatfox_lookup", {"malware_family": "fam", "confidence_level": 95.0}, "malicious", 0.95, "fam"),
    ("threatfox_lookup", {}, "unknown", 0.2, "no explicit threat signal"),
    ("malwarebazaar_lookup", {"has_data": True}, "malicious", 0.8, "provider response available"),
    ("urlhaus_lookup", {"url_status": "Online", "threat": "x"}, "malicious", 0.75, "Online; x"),
    ("urlhaus_lookup", {"threat": "x"}, "suspicious", 0.6, "x"),
    ("alienvault_otx_lookup", {"pulse_count": 20}, "suspicious", 0.85, "pulse_count=20"),
    ("greynoise_lookup", {"classification": "benign", "message": "ok"}, "benign", 0.6, "benign; ok"),
    ("greynoise_lookup", {"classification": "riot"}, "benign", 0.6, "riot"),
    ("shodan_internetdb_lookup", {"n_vulns": 9}, "suspicious", 0.85, "shodan_vulns=9"),
    ("shodan_internetdb_lookup", {"status": "not_found"}, "unknown", 0.2, "not in shodan dataset"),
    ("abuseipdb_lookup", {"abuse_confidence_score": 100, "total_reports": 3, "is_tor": True}, "malicious", 0.875, "abuseipdb_score=100 reports=3; tor_exit_node"),
    ("abuseipdb_lookup", {"abuse_confidence_score": 35}, "suspicious", 0.61, "abuseipdb_score=35 reports=0"),
    ("other", {"malicious": 12}, "malicious", 1.0, "malicious detections=12"),
    ("other", {"suspicious": 1, "malicious": -4}, "suspicious", 0.6, "suspicious detections=1"),
    ("other", {"status": "skipped", "reason": "seen"}, "error", 0.0, "seen"),
    ("other", {"error": "boom"}, "error", 0.0, "boom"),
]


def test_provider_answers(spark):
    names = sorted({k for _, f, *_ in ANSWERS for k in f})
    schema = "i int, source string, " + ", ".join(f"{n} {investigate.ANSWER[n]}" for n in names)
    rows = spark.createDataFrame([(i, s, *[f.get(n) for n in names]) for i, (s, f, *_) in enumerate(ANSWERS)], schema)
    got = investigate.normal_answers(rows).orderBy("i").collect()
    assert [(r["verdict"], round(r["confidence"], 6), r["summary"]) for r in got] == [a[2:] for a in ANSWERS]


def test_case_confidence_leaves_failed_answers_out(spark):
    rows = [("a", "s1", "x", "ok", "malicious", 0.9), ("a", "s2", "x", "ok", "benign", 0.6), ("a", "s3", "y", "error", "suspicious", 0.99), ("a", "s4", "y", "ok", "error", 0.0), ("b", "s1", "x", "skipped", "error", 0.0)]
    got = {r["c"]: (r["confidence"], r["factors"]) for r in investigate.case_confidence(spark.createDataFrame(rows, "c string, source string, ioc string, status string, verdict string, confidence double"), "c").collect()}
    assert got["a"] == (0.94, "2 successful evidence records; 2 enrichment sources; 1 IOC(s) with evidence; 1 error/skipped records excluded from supporting evidence")
    assert got["b"][0] == 0.0


@pytest.mark.parametrize(("context", "want"), [
    ("x eventid=4104 powershell -enc", ["T1059.001"]), ("x eventid=1 image c:/cmd.exe", ["T1059"]), ("x eventid=3 destination_ip 9.9.9.9 destination_port 443", ["T1071"]),
    ("x eventid=3 http://schemas.example.org", []), ("x eventid=3 destination_port 4430", []), ("x eventid=13 target_object hklm/run", ["T1059", "T1112"]),
])
def test_techniques(spark, context, want):
    assert [t["technique"] for t in one(spark, investigate.techniques(F.col("c")), c=context)] == want


@pytest.mark.parametrize(("fields", "route"), [((0, 0, 0, 0), "no_iocs"), ((3, 2, 0, 4), "sufficient_evidence"), ((3, 1, 0, 4), "no_usable_evidence"), ((3, 1, 1, 4), "needs_more_evidence"), ((3, 0, 0, 0), "sufficient_evidence")])
def test_enrichment_route(spark, fields, route):
    rows = spark.createDataFrame([fields], "n_iocs int, rounds int, n_usable int, n_open int")
    assert investigate.enrichment_route(rows).first()["route"] == route


def test_report_checks(spark):
    good = "EventID=10 on host a shows lateral movement. Limitations: enrichment of local addresses failed. Recommendation: review the process tree of the user."
    rows = spark.createDataFrame([(1, good, 10, "Lateral Movement", True, True, 0), (2, "Confirmed malware [placeholder]", 10, "x", True, True, 0), (3, None, None, None, False, False, 0)], "i int, text string, event_id int, tactic string, has_limits boolean, has_internal boolean, positives int")
    got = {r["i"]: (r["score"], r["failed"]) for r in parse.report_checks(rows).collect()}
    assert got[1] == (1.0, [])
    assert got[2] == (0.0, ["non_empty_output", "no_template_placeholders", "mentions_primary_event", "mentions_tactic_or_artifact", "states_enrichment_limitations", "calibrates_internal_iocs", "avoids_unsupported_confirmed_claims", "has_actionable_recommendation_evidence"])
    assert got[3][1] == ["non_empty_output", "has_actionable_recommendation_evidence"]


def test_web_server_lines(spark):
    line = '203.0.113.5 - bob [10/Oct/2023:13:55:36 +0200] "post /shop?cmd%3Did HTTP/1.1" 404 -'
    assert one(spark, T.apache_template(F.col("l")), l=line) == "ApacheAccess method=POST status=404 action=remote_code_probe"
    assert one(spark, T.apache_epoch(F.col("l")), l=line) == 1696938936
    assert one(spark, T.apache_template(F.col("l")), l="[Sun Oct 01 00:00:09 2023] [core:warn] [pid 1] no such file ../x") == "ApacheError level=core action=file_probe"
    assert one(spark, T.apache_epoch(F.col("l")), l="[Sun Oct 01 00:00:09 2023] [warn] x") == 1696118409
    assert one(spark, T.apache_template(F.col("l")), l="100% odd") == "ApacheLog action=request"
    for request, action in (("/a?x=%3Cscript%3E&y=100%", "xss_probe"), ("/%2e%2e/%", "file_probe"), ("/a%zz?q=un%69on", "sql_probe"), ("/l%6Fgin%ff+%", "login"), ("/x%2", "request")):
        assert one(spark, T.request_action(F.col("l")), l=request) == action, request


def test_block_log_content(spark):
    line = "090101 010203 77 WARN dfs.Data$Node: Lost block blk_-99 from /192.0.2.8:5010 for a.b of size 12"
    assert one(spark, T.header_stripped(F.col("l")), l=line) == "Lost$$block$$blk$$from"


def test_reviewer_verdicts(spark):
    rows = spark.createDataFrame([('x [{"window_id": 1, "verdict": "Noise"}, {"window_id": 2, "verdict": "odd"}] y',), ("broken [",), (None,)], "a string")
    assert sorted(map(tuple, parse.reviewer_verdicts(rows, "a").collect())) == [(1, "noise"), (2, "uncertain")]

"""Column functions for log text: masking, templates, parameters, timestamps, classes and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def extract(text: Column, pattern: str, group: int = 0) -> Column:
    """The group of the first match, null where nothing matches."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def mask_tokens(text: Column) -> Column:
    """Addresses, numbers, hex values, Windows paths and UUIDs become tokens, in this order."""
    #: Patterns and their tokens.
    steps = ((r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<IP>"), (r"\b\d+\b", "<NUM>"), (r"\b0x[0-9a-fA-F]+\b", "<HEX>"), (r"[A-Za-z]:\\[\w\\.\-]+", "<PATH>"), (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<UUID>"))
    for pattern, token in steps:
        text = F.regexp_replace(text, pattern, token)
    return text


def fold_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s{2,}|[^\S ]", " "))


def servicing_line(line: Column) -> Column:
    """struct<ts, level, component, content> of a servicing-log line; null if it has another form."""
    pattern = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}),\s+(\w+)\s+(\w+)\s+(.*)$"
    part = lambda i: F.regexp_extract(line, pattern, i)
    return F.when(line.rlike(pattern), F.struct(part(1).alias("ts"), part(2).alias("level"), part(3).alias("component"), F.trim(part(4)).alias("content")))


def servicing_template(component: Column, content: Column, short: str = "words") -> Column:
    """Component and the first five words; contents of at most five words whole (words), cut to 50 characters (cut) or whole as they are (whole)."""
    words = F.split(F.trim(content), r"\s+")
    head = F.array_join(F.slice(words, 1, 5), " ")
    if short != "words":
        head = F.when(F.size(words) > 5, head).otherwise(F.substring(content, 1, 50) if short == "cut" else content)
    return F.concat_ws(" ", component, head)


def clean_value(value: Column, default: str = "Unknown") -> Column:
    """Null, empty and 0 become the default."""
    return F.when(value.isNull() | F.trim(value).isin("", "0"), default).otherwise(F.trim(value))


def clean_event_value(value: Column, default: str = "") -> Column:
    """Null, blank and none become the default."""
    return F.when(value.isNull() | (F.trim(value) == "") | (F.lower(F.trim(value)) == "none"), default).otherwise(F.trim(value))


def source_template(source: Column, entry_type: Column) -> Column:
    kind = F.when(entry_type == "Unknown", "Information").otherwise(entry_type)
    return F.regexp_replace(F.concat_ws("_", source, kind), " ", "")


def stable_id(text: Column) -> Column:
    """The first eight hex digits of md5, mod 100000."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % 100000


def entry_label(entry_type: Column) -> Column:
    return F.when(F.lower(entry_type) == "error", "1").otherwise("-")


def event_template(strategy: str, provider: Column, event_id: Column, channel: Column | None = None, task: Column | None = None, level: Column | None = None) -> Column:
    """Event template by strategy: provider_eventid, windows_evtx_canonical or windows_evtx_metadata."""
    if strategy == "provider_eventid":
        return F.concat(provider, F.lit(" EventID="), event_id.cast("string"))
    names = {"windows_evtx_canonical": ("Provider", "Channel"), "windows_evtx_metadata": ("Provider", "Channel", "Task", "Level")}.get(strategy)
    if names is None:
        raise ValueError(f"unknown template strategy {strategy}")
    given = {"Provider": provider, "Channel": channel, "Task": task, "Level": level}
    parts = [F.concat(F.lit("EventID "), clean_event_value(event_id.cast("string"), "Unknown"))]
    for n in names:
        if given[n] is not None:
            v = clean_event_value(given[n])
            parts.append(F.when(v != "", F.concat(F.lit(f"{n} "), v)))
    return F.concat_ws(" ", *parts)


PARAMETER_PATTERNS = {
    "ip": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "hash": r"\b[a-fA-F0-9]{32}\b|\b[a-fA-F0-9]{64}\b",
    "domain": r"\b(?:[a-zA-Z0-9-]+\.)+[a-zA-Z]{2,}\b",
    "url": r"https?://[^\s]+",
}
#: Fixed value: key=value pairs.
_PAIR = r"\b([A-Za-z_][\w.-]{0,63})=(\"[^\"]*\"|'[^']*'|[^\s,;]+)"


def _numbered(values: Column, name: str) -> Column:
    return F.transform(values, lambda v, i: F.struct(F.concat(F.lit(f"{name}_"), (i + 1).cast("string")).alias("key"), v.alias("value")))


def parameters(text: Column) -> Column:
    """array<struct<key, value>> in the order found: key=value pairs, then ip_n, hash_n, domain_n, url_n; a repeated key gets _2, _3 ..."""
    keys, values = F.regexp_extract_all(text, F.lit(_PAIR), F.lit(1)), F.regexp_extract_all(text, F.lit(_PAIR), F.lit(2))
    pairs = F.filter(F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), F.regexp_replace(F.trim(v), "^[\"']+|[\"']+$", "").alias("value"))), lambda p: p["value"] != "")
    for name, pattern in PARAMETER_PATTERNS.items():
        pairs = F.concat(pairs, _numbered(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), name))

    def named(x: Column) -> Column:
        before = lambda i, p: F.size(F.filter(F.slice(x["keys"], 1, i), lambda k: k == p["key"]))
        again = lambda n, p: F.when(n > 0, F.concat(p["key"], F.lit("_"), (n + 1).cast("string"))).otherwise(p["key"])
        return F.transform(x["pairs"], lambda p, i: F.struct(bound(before(i, p), lambda n: again(n, p)).alias("key"), p["value"].alias("value")))

    return bound(pairs, lambda ps: bound(F.struct(ps.alias("pairs"), F.transform(ps, lambda p: p["key"]).alias("keys")), named))


def timestamp_text(line: Column) -> Column:
    """First ISO, else day/month/year, else month-name timestamp of a line."""
    #: The three forms, in this order.
    forms = (r"\b\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b", r"\b\d{2}/\d{2}/\d{4}[ T]\d{2}:\d{2}:\d{2}\b", r"\b[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\b")
    return F.coalesce(*[extract(line, p) for p in forms])


#: Forms of Linux lines and of key=value text.
RFC3164 = r"^([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+([A-Za-z0-9_.@/+:\-()]+)(?:\[\d+\])?:\s*(.*)$"
AUTH_PROCESSES = ("sshd", "sudo", "su", "cron", "pam_unix", "systemd-logind")


def linux_process(line: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.regexp_extract(line, RFC3164, 3))), r"\([^)]*\)$", "")


def linux_source(line: Column, file_name: Column | None = None) -> Column:
    """auth, audit or syslog: by file name, else by line; null if neither tells."""
    text = F.trim(line)
    by_line = F.when(text.startswith("type=") | F.contains(text, F.lit(" msg=audit(")), "audit").when(text.rlike(RFC3164), F.when(linux_process(text).isin(*AUTH_PROCESSES), "auth").otherwise("syslog"))
    if file_name is None:
        return by_line
    name = F.lower(file_name)
    return F.coalesce(F.when(name.startswith("auth.log"), "auth").when(name.startswith("syslog"), "syslog").when(name.startswith("audit.log"), "audit"), by_line)


def generic_action(message: Column) -> Column:
    """Up to six word tokens of the message, values masked, joined by _; message if there are none."""
    text = F.lower(message)
    for pattern, word in ((r"\b(?:\d{1,3}\.){3}\d{1,3}\b", " ip "), (r"https?://\S+", " url "), (r"(?:/[\w.\-]+)+", " path "), (r"\b0x[0-9a-f]+\b", " hex "), (r"\b\d+\b", " num ")):
        text = F.regexp_replace(text, pattern, word)
    tokens = F.regexp_extract_all(text, F.lit("[a-z_]+"), F.lit(0))
    return F.when(F.size(tokens) > 0, F.array_join(F.slice(tokens, 1, 6), "_")).otherwise("message")


#: What a message must hold, and the action it stands for, first match first.
AUTH_ACTIONS = (
    ("successful su for", "su_success"), ("failed password", "ssh_failed_password"), ("accepted password", "ssh_accepted_password"),
    ("accepted publickey", "ssh_accepted_publickey"), ("invalid user", "ssh_invalid_user"), ("authentication failure", "pam_auth_failure"),
    ("session opened", "session_open"), ("session closed", "session_close"), ("new session", "systemd_new_session"), ("removed session", "systemd_removed_session"),
)
SYSLOG_STARTS = (("started session", "started_session"), ("removed session", "removed_session"), ("started ", "started_unit"), ("stopped ", "stopped_unit"))


def auth_action(process: Column, message: Column) -> Column:
    def of(x: Column) -> Column:
        out = F.when((x["process"] == "sudo") & F.contains(x["low"], F.lit("command=")), F.lit("sudo_command"))
        for words, action in AUTH_ACTIONS:
            name = F.concat(F.when(x["process"] == "cron", "cron_").otherwise("pam_"), F.lit(action)) if action.startswith("session") else F.lit(action)
            out = out.when(F.contains(x["low"], F.lit(words)), name)
        return out.otherwise(generic_action(x["message"]))

    return bound(F.struct(process.alias("process"), F.lower(message).alias("low"), message.alias("message")), of)


def syslog_action(message: Column) -> Column:
    def of(x: Column) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for words, action in SYSLOG_STARTS:
            out = out.when(x["low"].startswith(words), F.lit(action))
        return out.when(F.contains(x["low"], F.lit("failed")), F.lit("failed")).otherwise(generic_action(x["message"]))

    return bound(F.struct(F.lower(message).alias("low"), message.alias("message")), of)


#: Fixed value: pairs of audit lines.
_AUDIT_PAIR = r"\b([A-Za-z_][\w.-]*)=(\"[^\"]*\"|'[^']*'|[^\s;]+)"
#: Folders of the system's own programs.
SYSTEM_FOLDERS = ("/usr/bin/", "/usr/sbin/", "/usr/lib/", "/usr/libexec/", "/bin/", "/sbin/", "/lib/", "/lib64/", "/snap/", "/var/ossec/bin/")


def _audit_pairs(text: Column) -> Column:
    strip = lambda v: F.regexp_replace(F.trim(v), "^[\"']+|[\"']+$", "")
    ks, vs = F.regexp_extract_all(text, F.lit(_AUDIT_PAIR), F.lit(1)), F.regexp_extract_all(text, F.lit(_AUDIT_PAIR), F.lit(2))
    return F.zip_with(ks, vs, lambda k, v: F.struct(k.alias("k"), strip(v).alias("v")))


def audit_template(line: Column) -> Column:
    """Of a key the last value in the line counts, where pairs inside msg='...' come last."""
    text = fold_space(line)
    inner = F.array_join(F.regexp_extract_all(text, F.lit(r"\bmsg=(['\"])(.*?)\1"), F.lit(2)), " ")
    return bound(F.concat(_audit_pairs(text), _audit_pairs(inner)), _audit_of)


def _audit_of(pairs: Column) -> Column:
    get = lambda k: F.nullif(F.try_element_at(F.filter(pairs, lambda p: p["k"] == k), F.lit(-1))["v"], F.lit(""))
    exe = get("exe")
    trusted = F.lit(False)
    for folder in SYSTEM_FOLDERS:
        trusted = trusted | exe.startswith(folder)
    shown = F.when(trusted, "<sys>").otherwise(F.regexp_extract(exe, "([^/]+)/*$", 1))
    field = lambda n, v: F.when(v.isNotNull(), F.concat(F.lit(f"{n}="), v))
    return F.concat_ws(" ", F.lit("LinuxAudit"), F.concat(F.lit("type="), F.coalesce(get("type"), F.lit("unknown"))), field("op", get("op")), field("syscall", get("syscall")), field("exe", F.when(exe.isNotNull(), shown)), F.coalesce(field("res", get("res")), field("success", get("success"))))


def linux_template(line: Column, source: Column) -> Column:
    """Low-cardinality template of a Linux line; source as linux_source() gives it, null: linux."""

    def plain(x: Column) -> Column:
        action = F.when(x["source"] == "auth", auth_action(x["process"], x["message"])).otherwise(syslog_action(x["message"]))
        return F.when(x["is_old"], F.concat(x["prefix"], F.lit(" process="), x["process"], F.lit(" action="), action)).otherwise(F.concat(x["prefix"], F.lit(" process=unknown action="), generic_action(x["text"])))

    def of(source: Column) -> Column:
        prefix = F.when(source == "auth", "LinuxAuth").when(source == "syslog", "LinuxSyslog").otherwise("LinuxLog")

        def parts(text: Column) -> Column:
            return F.struct(text.alias("text"), linux_process(text).alias("process"), fold_space(F.regexp_extract(text, RFC3164, 4)).alias("message"), text.rlike(RFC3164).alias("is_old"), prefix.alias("prefix"), source.alias("source"))

        audit = (source == "audit") | F.trim(line).startswith("type=")
        return F.when(audit, audit_template(line)).otherwise(bound(bound(fold_space(line), parts), plain))

    return bound(source, of)


def linux_epoch(line: Column, year: int = 2022) -> Column:
    """Epoch seconds of an audit stamp, else a traditional syslog stamp in that year, else an ISO stamp; 0 if there is none."""
    text = F.trim(line)
    audit = extract(text, r"\baudit\((\d+(?:\.\d+)?):\d+\)", 1).cast("double").cast("bigint")
    stamp = F.regexp_replace(extract(text, RFC3164, 1), r"\s+", " ")
    old = F.unix_timestamp(F.try_to_timestamp(F.concat(F.lit(f"{year} "), stamp), F.lit("yyyy MMM d HH:mm:ss")))
    iso = extract(text, r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b")
    iso = F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(iso, r"([+-]\d{2})(\d{2})$", "$1:$2")))
    return F.coalesce(audit, old, iso, F.lit(0))


def any_epoch(value: Column) -> Column:
    """Epoch seconds of digits (milliseconds above 1e10), 'Mon d, Y @ h:m:s.f', or a usual timestamp; 0 if none."""
    digits = F.when(value.rlike(r"^\d+(\.\d+)?$"), value.try_cast("double"))
    number = F.when(digits > 1e10, digits / 1000).otherwise(digits).cast("bigint")
    named = F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(value, r"\.\d+$", ""), F.lit("MMM d, yyyy @ HH:mm:ss")))
    return F.coalesce(number, named, F.unix_timestamp(F.try_to_timestamp(value)), F.lit(0))


#: The two forms of web server lines, and what a request or message must hold for its action, first match first.
APACHE_ACCESS = r"^(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+\"(\S+)\s+(.*?)\s+(HTTP/[^\"]+)\"\s+(\d{3})\s+(\S+)"
APACHE_ERROR = r"^\[([^\]]+)\]\s+\[([^\]:]+)(?::[^\]]+)?\]\s+(.*)$"
REQUEST_ACTIONS = (
    ("sql_probe", ("union", "select", "sleep", "concat")), ("file_probe", ("etc/passwd", "../", "..%2f")), ("xss_probe", ("<script", "alert(", "document.")),
    ("remote_code_probe", ("cmd=", "command=", "<?php", "base64")), ("login", ("login",)), ("cgi", ("cgi-bin",)),
)


def request_action(request: Column) -> Column:
    """Class of a request or message in lower case after URL decoding; a % that begins no escape stands for itself."""
    low = F.lower(request)

    def of(text: Column) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for action, words in REQUEST_ACTIONS:
            out = out.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)), F.lit(action))
        return out.otherwise("request")

    return bound(F.coalesce(F.try_url_decode(F.regexp_replace(low, "%(?![0-9a-f]{2})", "%25")), low), of)


def apache_template(line: Column) -> Column:
    """Template of a web server's access or error line, else of the whole line."""
    get = lambda pattern, i: F.regexp_extract(line, pattern, i)
    field = lambda name, value: F.concat(F.lit(f"{name}="), value)
    level = F.coalesce(F.nullif(F.lower(F.trim(get(APACHE_ERROR, 2))), F.lit("")), F.lit("unknown"))
    access = F.concat_ws(" ", F.lit("ApacheAccess"), field("method", F.upper(get(APACHE_ACCESS, 3))), field("status", get(APACHE_ACCESS, 6)), field("action", request_action(get(APACHE_ACCESS, 4))))
    error = F.concat_ws(" ", F.lit("ApacheError"), field("level", level), field("action", request_action(get(APACHE_ERROR, 3))))
    return F.when(line.rlike(APACHE_ACCESS), access).when(line.rlike(APACHE_ERROR), error).otherwise(F.concat_ws(" ", F.lit("ApacheLog"), field("action", request_action(line))))


def apache_epoch(line: Column) -> Column:
    """Epoch seconds of an access line's stamp (with its zone) or an error line's (UTC); 0 if none."""
    access = F.try_to_timestamp(F.regexp_extract(line, APACHE_ACCESS, 2), F.lit("dd/MMM/yyyy:HH:mm:ss Z"))
    stamp = F.regexp_replace(F.regexp_replace(F.regexp_extract(line, APACHE_ERROR, 1), r"^\w{3} ", ""), r"\.\d+ ", " ")
    error = F.try_to_timestamp(F.concat(stamp, F.lit(" +0000")), F.lit("MMM d HH:mm:ss yyyy Z"))
    return F.coalesce(F.unix_timestamp(F.when(line.rlike(APACHE_ACCESS), access)), F.unix_timestamp(F.when(line.rlike(APACHE_ERROR), error)), F.lit(0))


#: Words of labels.
POSITIVE = ("1", "true", "yes", "attack", "anomaly", "abnormal", "malicious", "malware", "positive", "suspicious", "eors", "eoht")
NEGATIVE = ("0", "false", "no", "normal", "benign", "-", "negative", "clean", "none")


def binary_label(label: Column, positive: tuple[str, ...] = (), strict: bool = True) -> Column:
    """1 or 0; other words are an error, or null if not strict."""
    low = F.lower(F.trim(label))
    out = F.when(low.isin(*POSITIVE, *map(str.lower, positive)), 1).when(low.isin(*NEGATIVE), 0)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown label: "), label)).cast("int")) if strict else out


def free_text_label(label: Column) -> Column:
    return F.lower(F.trim(label)).isin("1", "malicious", "attack", "true", "yes").cast("int")


def rule_labels(lines: DataFrame, rules: DataFrame, key: str, line: str, most: int = 10_000) -> DataFrame:
    """Lines with the sorted distinct labels of all rules (rule_id, rule_label, filters) whose filters they hold, case and % aside.

    rules is a list that its makers write by hand; it becomes one expression of each row. More than `most` are an error.
    """
    known = rules.select("rule_label", "filters").limit(most + 1).collect()
    if len(known) > most:
        raise ValueError(f"more than {most} rules")
    made = [(r["rule_label"], [f.replace("%", "").lower() for f in r["filters"] or ()]) for r in known]
    none = F.array().cast("array<string>")

    def held(low: Column) -> Column:
        tests = [F.when(F.forall(F.array(*map(F.lit, fs)), lambda f: F.contains(low, f)) if fs else F.lit(True), F.lit(label)) for label, fs in made]
        return F.sort_array(F.array_distinct(F.filter(F.array(*tests), lambda x: x.isNotNull()))) if tests else none

    found = lines.withColumn("labels", F.coalesce(bound(F.lower(line), held), none))
    return found.withColumn("label", F.when(F.size("labels") > 0, "attack").otherwise("-"))


#: Fixed value: key=value pairs whose values may hold spaces.
KEY_VALUE = r"\b([A-Za-z_][\w.-]{0,63})=(\"[^\"]*\"|'[^']*'|.*?)(?=\s+[A-Za-z_][\w.-]{0,63}=|$)"


def key_values(text: Column) -> Column:
    """array<struct<key, value>> of key=value text whose values may hold spaces; empty values are left out."""
    return folded_pairs(fold_space(text))


def folded_pairs(text: Column) -> Column:
    """key_values() of text whose space is folded already."""
    value = lambda m: F.btrim(F.trim(F.substr(m, F.instr(m, "=") + 1)), F.lit("\"'"))
    pairs = F.transform(F.regexp_extract_all(text, F.lit(KEY_VALUE), F.lit(0)), lambda m: F.struct(F.substring_index(m, "=", 1).alias("key"), value(m).alias("value")))
    return F.filter(pairs, lambda p: p["value"] != "")


def _value_of(pairs: Column, key: str) -> Column:
    return F.get(pairs["value"], F.array_position(pairs["key"], F.lit(key)).cast("int") - 1)


def first_value(pairs: Column, *keys: str) -> Column:
    """Value of the first of the keys that is there (a repeated key's first value); empty if none. pairs: key_values(), or columns() of it."""
    return F.coalesce(*[_value_of(pairs, k) for k in keys], F.lit(""))


def columns(pairs: Column, use) -> Column:
    """use(x) where x holds the keys and the values of the pairs as two arrays, made once."""
    return bound(bound(pairs, lambda ps: F.struct(ps["key"].alias("key"), ps["value"].alias("value"))), use)


def low_signal_ioc(value: Column) -> Column:
    return F.lower(value).isin("localhost", "127.0.0.1", "0.0.0.0", "::1") | (F.length(value) < 4)


def ioc_match_key(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), "^[a-z]+://", ""), "/+$", "")


def octet(value: Column, i: int) -> Column:
    return F.try_element_at(F.split(value, r"\."), F.lit(i)).try_cast("int")


#: Fixed value: an address of four octets.
IPV4 = r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"


def internal_ioc(value: Column) -> Column:
    """Private, loopback or link-local address, or a local name."""
    a, b = octet(value, 1), octet(value, 2)
    local = value.rlike(IPV4) & ((a == 10) | (a == 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)))
    low = F.lower(value)
    named = F.lit(False)
    for end in (".local", ".corp", ".example", ".test"):
        named = named | low.endswith(end)
    return F.coalesce(local, F.lit(False)) | named


FILE_ENDINGS = r"(?i)\.(exe|dll|sys|ps1|bat|cmd|vbs|js|log|txt|tmp|dat|ini|xml|json|evtx|lnk|msi|zip|doc|docx|pdf)$"


def ioc_type(value: Column) -> Column:
    """ip, url, sha256, md5, domain, or null for what is none (paths, file names, script tokens)."""
    v = F.trim(value)
    v6 = v.rlike(r"^[0-9a-fA-F]{0,4}(:[0-9a-fA-F]{0,4}){2,7}$") & F.contains(v, F.lit(":"))
    token = v.rlike(r"^(?i)(system|microsoft|net|io)\.[a-z.]+$") | v.rlike(r"\(|\)|\$|=")
    return F.when(v.rlike(IPV4) | v6, "ip").when(v.rlike(r"^(?i)https?://[^\s]+$"), "url").when(v.rlike("^[a-fA-F0-9]{64}$"), "sha256").when(v.rlike("^[a-fA-F0-9]{32}$"), "md5").when(v.rlike(r"[\\/]") | v.rlike(FILE_ENDINGS) | token, None).when(v.rlike(r"^(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}$"), "domain")


def vector_words(text: Column, stop_words: tuple[str, ...]) -> Column:
    """Words of a template: all-capital words lowered, camel case split, digits and stop words dropped."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\b([A-Z])([A-Z]+)\b", "$1$2"), "[^A-Za-z]+", " ")
    split = F.lower(F.regexp_replace(plain, "([a-z])([A-Z])", "$1 $2"))
    return F.filter(F.split(F.trim(split), " +"), lambda w: (w != "") & ~w.isin(*stop_words))


def ascii_fold(text: Column, most: int) -> Column:
    return F.substring(fold_space(F.regexp_replace(text, r"[^\x20-\x7E]", " ")), 1, most)


#: What is taken out of a block log's content, in this order, after runs of punctuation have become spaces.
CONTENT_PUNCTUATION = r"[\-~!@#$\\.=%^&*()_+`{};':\",\[\]<>]+"
CONTENT_PATTERNS = (r"blk_(|-)[0-9]+", r"(/|)([0-9]+\.){3}[0-9]+(:[0-9]+|)(:|)", r"[0-9]+", r"/.+", r"\S+\.{1}\S+")


def header_stripped(content: Column, header: int = 5, joined: str = "$$") -> Column:
    """The words of a line without its first ones, punctuation, block ids, addresses, numbers, paths and dotted words."""
    text = bound(F.split(F.trim(content), r"\s+"), lambda w: F.array_join(F.slice(w, header + 1, F.greatest(F.size(w) - header, F.lit(0))), " "))
    text = F.regexp_replace(text, CONTENT_PUNCTUATION, " ")
    for pattern in CONTENT_PATTERNS:
        text = F.regexp_replace(text, pattern, "")
    return F.replace(fold_space(text), F.lit(" "), F.lit(joined))


#: Phases of recommendations and the words that tell them, first match first; categories of actions and the words that must all be there.
PHASES = (
    ("Containment", ("containment", "isolasi", "isolir", "blokir", "block", "hunt", "sinkhole", "quarantine")), ("Eradication", ("eradication", "hapus", "karantina", "remove", "bersihkan", "cabut akses")),
    ("Recovery", ("recovery", "pulihkan", "restore", "reimage", "recover")), ("Detection & Analysis", ("validasi", "triase", "kumpulkan", "rekonstruksi", "korelasikan", "monitor", "review", "analisis")),
)
ACTIONS = (
    ("ioc_block", ("ioc", "blokir")), ("ioc_block", ("ioc", "block")), ("ioc_validate", ("ioc", "validasi")), ("ioc_enrich", ("ioc", "enrich")),
    ("artifact_collection", ("kumpulkan", "artefak")), ("window_triage", ("triase", "window")), ("timeline_reconstruction", ("timeline",)),
)


def _ladder(text: Column, rules, test) -> Column:
    words = lambda ws: F.array(*map(F.lit, ws))
    out = F.when(F.lit(False), F.lit(""))
    for name, ws in rules:
        out = out.when(test(words(ws), lambda w: F.contains(text, w)), F.lit(name))
    return out


def phase_tag(text: Column) -> Column:
    """Response phase of a recommendation; Detection & Analysis if no word tells another."""
    return _ladder(F.lower(text), PHASES, F.exists).otherwise("Detection & Analysis")


def action_category(text: Column) -> Column:
    """What a recommendation asks for, coarsely; null if no rule holds."""
    return _ladder(F.lower(text), ACTIONS, F.forall)


def severity_word(text: Column) -> Column:
    """First severity word of the text that no negation within 24 characters before it denies; lines that name severity come first."""
    lines = F.split(text, "\n")
    named = F.filter(lines, lambda x: F.contains(F.lower(x), F.lit("severity")))
    ordered = F.concat(named, F.filter(lines, lambda x: ~F.contains(F.lower(x), F.lit("severity"))))
    word = r"(?i)(?<!\b(?:not|no|never|without)\b[^\n]{0,24})\b(critical|high|medium|low)\b"
    return F.lower(F.try_element_at(F.transform(F.filter(ordered, lambda x: x.rlike(word)), lambda x: F.regexp_extract(x, word, 1)), F.lit(1)))

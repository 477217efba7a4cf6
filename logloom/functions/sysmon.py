"""Classes of Sysmon field values, and templates enriched with them."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.text import IPV4, bound, columns, first_value, fold_space, folded_pairs, octet

#: Program names and their classes.
PROGRAMS = {
    "powershell": "powershell", "pwsh": "powershell", "cmd": "cmd", "rundll32": "rundll32", "regsvr32": "regsvr32", "wscript": "script_host", "cscript": "script_host",
    "mshta": "mshta", "certutil": "certutil", "bitsadmin": "bitsadmin", "schtasks": "schtasks", "wmic": "wmic", "psexec": "remote_admin", "paexec": "remote_admin",
    "procdump": "dump_tool", "lsass": "lsass", "svchost": "windows_service", "services": "windows_service", "winlogon": "windows_service", "explorer": "explorer",
    "chrome": "browser", "msedge": "browser", "firefox": "browser",
}
#: Ports and their classes.
PORTS = {53: "dns", 80: "web", 443: "web", 445: "smb", 139: "smb", 135: "rpc", 3389: "rdp", 5985: "winrm", 5986: "winrm", 389: "ldap", 636: "ldap", 88: "kerberos", 22: "ssh", 25: "smtp"}


def _clean(v: Column | str) -> Column:
    folded = fold_space(F.coalesce(F.col(v) if isinstance(v, str) else v, F.lit("")))
    return bound(folded, lambda t: F.when(F.lower(t) == "nan", "").otherwise(t))


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def _has(text: Column, *words: str) -> Column:
    return reduce(or_, [F.contains(text, F.lit(w)) for w in words])


def _low(v: Column | str, use) -> Column:
    """use(t) of the cleaned text in lower case, made once: inside lambdas nothing is shared."""
    return bound(F.lower(_clean(v)), use)


def path_class(v: Column | str) -> Column:
    return _low(v, _path)


def _path(t: Column) -> Column:
    return F.when(t == "", "unknown").when(_has(t, "\\users\\") & _has(t, "\\temp\\"), "user_temp").when(_has(t, "\\users\\"), "user_path").when(_has(t, "\\windows\\"), "windows").when(_has(t, "\\program files"), "program_files").otherwise("other")


def process_class(v: Column | str) -> Column:
    return _low(v, _process)


def _process(t: Column) -> Column:
    stem = F.regexp_replace(F.regexp_extract(F.regexp_replace(t, "^[\"']+|[\"']+$", ""), r"([^\\/]*)$", 1), r"\.exe$", "")
    place = F.when(_has(t, "\\users\\") & _has(t, "\\temp\\"), "user_temp").when(_has(t, "\\users\\"), "user_path").when(_has(t, "\\program files"), "program_files").when(_has(t, "\\windows\\"), "windows").otherwise("other")
    return F.when(t == "", "unknown").when(t == "system", "system").otherwise(F.coalesce(_lookup(PROGRAMS, stem), place))


def user_class(v: Column | str) -> Column:
    return _low(v, _user)


def _user(t: Column) -> Column:
    return F.when(t == "", "unknown").when(_has(t, "nt authority\\system") | t.endswith("\\system") | (t == "system"), "system").when(_has(t, "network service"), "network_service").when(_has(t, "local service"), "local_service").when(t.endswith("$"), "machine").otherwise("user")


def ip_class(v: Column | str) -> Column:
    return bound(_clean(v), _ip)


def _ip(t: Column) -> Column:
    a, b = octet(t, 1), octet(t, 2)
    private = (a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | (a == 0) | (a >= 240)
    four = F.when(a == 127, "loopback").when((a == 169) & (b == 254), "link_local").when(a.between(224, 239), "multicast").when(private, "private").otherwise("public")
    low = F.lower(t)
    six = F.when(low == "::1", "loopback").when(low.rlike("^fe[89ab]"), "link_local").when(low.startswith("ff"), "multicast").when(low.rlike("^f[cd]") | (low == "::"), "private").otherwise("public")
    return F.when(t == "", "unknown").when(t.rlike(IPV4), four).when(low.rlike("^[0-9a-f]{0,4}(:[0-9a-f]{0,4}){2,7}$"), six).otherwise("hostname")


def port_class(v: Column | str) -> Column:
    return bound(_clean(v).try_cast("double").cast("int"), _port)


def _port(port: Column) -> Column:
    return F.when(port.isNull(), "unknown").otherwise(F.coalesce(_lookup(PORTS, port), F.when(port < 1024, "privileged").when(port < 49152, "high").otherwise("ephemeral")))


def command_class(v: Column | str) -> Column:
    return _low(v, _command)


def _command(t: Column) -> Column:
    return F.when(t == "", "empty").when(_has(t, "encodedcommand") | t.rlike(r"\s-enc(?:odedcommand)?\b"), "encoded").when(_has(t, "downloadstring", "invoke-webrequest", "curl ", "wget "), "download").when(_has(t, "bypass", "hidden", " -nop", " -w hidden"), "suspicious").when(_has(t, "whoami", " nltest", " net view", " net user", " ipconfig"), "discovery").otherwise("other")


def access_class(v: Column | str) -> Column:
    return _low(v, _access)


def _access(t: Column) -> Column:
    value = F.when(t.rlike("^0x[0-9a-f]{1,15}$"), F.conv(F.substring(t, 3, 100), 16, 10).cast("bigint")).when(t.rlike(r"^[+-]?\d{1,18}$"), t.try_cast("bigint"))
    return F.when(value.isNull(), "unknown").when(value.bitwiseAND(F.lit(0x0010 | 0x0400 | 0x1000 | 0x1F0000)) != 0, "high").otherwise("low")


def registry_class(v: Column | str) -> Column:
    return _low(v, _registry)


def _registry(t: Column) -> Column:
    return F.when(t == "", "unknown").when(_has(t, "currentversion\\run", "\\runonce"), "autorun").when(_has(t, "\\services\\"), "services").when(_has(t, "\\sam\\", "\\security\\"), "sensitive").when(t.startswith("hklm") | _has(t, "\\hkey_local_machine\\"), "hklm").when(t.startswith("hkcu") | _has(t, "\\hkey_current_user\\"), "hkcu").otherwise("other")


def query_class(v: Column | str) -> Column:
    return bound(F.regexp_replace(F.lower(_clean(v)), r"\.+$", ""), _query)


def _query(t: Column) -> Column:
    return F.when(t == "", "unknown").when(t.endswith(".local") | _has(t, ".local.") | t.endswith(".lan"), "internal").when(t.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$"), ip_class(t)).otherwise("domain")


#: Fields of each event id, as (name in the template, class function, field names tried in order).
ENRICHED = {
    "1": (("ImageClass", process_class, ("Image",)), ("CmdClass", command_class, ("CommandLine",)), ("ParentClass", process_class, ("ParentImage",))),
    "3": (("ImageClass", process_class, ("Image",)), ("UserClass", user_class, ("User",)), ("DestinationClass", ip_class, ("DestinationIp", "DestinationHostname")), ("DestinationPortClass", port_class, ("DestinationPort",))),
    "5": (("ImageClass", process_class, ("Image",)),),
    "7": (("ImageClass", process_class, ("Image",)), ("LoadedImageClass", path_class, ("ImageLoaded",))),
    "10": (("SourceClass", process_class, ("SourceImage",)), ("TargetClass", process_class, ("TargetImage",)), ("AccessClass", access_class, ("GrantedAccess",))),
    "11": (("ImageClass", process_class, ("Image",)), ("TargetPathClass", path_class, ("TargetFilename",))),
    "12": (("ImageClass", process_class, ("Image",)), ("RegistryClass", registry_class, ("TargetObject",))),
    "22": (("ImageClass", process_class, ("Image",)), ("QueryClass", query_class, ("QueryName",))),
}


def enriched_template(template: Column, content: Column, event_id: Column | None = None, mode: str = "lmd_sysmon_v1") -> Column:
    """The template with the classes of its event's fields; mode none leaves it. The event id is given, else in the content, else in the template."""
    if mode == "none":
        return _clean(template)
    given = F.lit("") if event_id is None else _clean(event_id.cast("string"))
    source = F.struct(_clean(template).alias("plain"), _clean(content).alias("content"), given.alias("given"))
    pairs = lambda x: columns(folded_pairs(F.when(x["content"] == "", x["plain"]).otherwise(x["content"])), lambda ps: ps)
    return bound(bound(source, lambda x: F.struct(x["plain"].alias("plain"), pairs(x).alias("pairs"), x["given"].alias("given"))), _enriched)


def _enriched(x: Column) -> Column:
    in_template = F.regexp_extract(x["plain"], r"(?i)\bEventID(?:=|\s+)(\d+)", 1)
    number = F.coalesce(F.nullif(x["given"], F.lit("")), F.nullif(first_value(x["pairs"], "EventID"), F.lit("")), F.nullif(in_template, F.lit("")), F.lit("UNKNOWN"))
    provider = F.coalesce(F.nullif(F.trim(F.regexp_extract(x["plain"], r"(?i)^(.*?)\bEventID(?:=|\s+)\d+", 1)), F.lit("")), F.lit("Microsoft-Windows-Sysmon"))
    return bound(F.struct(number.alias("number"), provider.alias("provider"), x["pairs"].alias("pairs")), _classed)


def _classed(x: Column) -> Column:
    number, pairs = x["number"], x["pairs"]
    base = F.concat(x["provider"], F.lit(" EventID="), number)
    field = lambda name, of, keys: F.concat(F.lit(f"{name}="), bound(first_value(pairs, *keys), of))
    user = field("UserClass", user_class, ("User",))

    def row(fields) -> Column:
        return F.concat_ws(" ", base, *[field(*f) for f in fields], *([] if any(f[0] == "UserClass" for f in fields) else [user]))

    same = {"12": ("12", "13", "14"), "11": ("11", "23")}
    out = F.when(F.lit(False), F.lit(""))
    for k, fields in ENRICHED.items():
        out = out.when(number.isin(*same.get(k, (k,))), row(fields))
    image = F.when(first_value(pairs, "Image") != "", field("ImageClass", process_class, ("Image",)))
    return out.otherwise(F.concat_ws(" ", base, image, F.when(first_value(pairs, "User") != "", user)))

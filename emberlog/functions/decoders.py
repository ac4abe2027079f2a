"""Decoders as column functions: raw text -> nullable struct<ts, source, fields, tags, severity>.

A decoder is null where the text is not in its format; the first match of a chain is a ``coalesce``. All run inside
whole-stage code generation. Times without a zone are UTC; ``ts`` is null where the text has no readable time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The layouts of the web server's, syslog and Windows text lines.
APACHE = r'^(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+"(\S+)\s+(\S+)\s+\S+"\s+(\d+)\s+(\d+|-)'
SYSLOG = r"^<(\d+)>?(\w{3}\s+\d+\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+)\s+(.*)$"
WINDOWS = r"^(\d{4}/\d{2}/\d{2})\s+(\d{2}:\d{2}:\d{2}(?:\.\d+)?)\s+\(([^)]+)\)\s+(.*)$"

#: Level names, Sysmon event ids, Windows event ids, sensor severities, audit levels.
LEVEL_SEVERITY = {"critical": 5, "fatal": 5, "emergency": 5, "error": 4, "warn": 3, "warning": 3, "info": 1, "debug": 0, "trace": 0}
SYSMON = {
    "1": ("process_creation", 2), "3": ("network_connection", 2), "7": ("module_load", 2), "8": ("remote_thread", 4),
    "10": ("process_access", 3), "11": ("file_create", 2), "12": ("registry_change", 3), "13": ("registry_value", 3),
    "15": ("file_stream", 2), "17": ("pipe_event", 3), "18": ("pipe_connected", 3), "19": ("wmi_event", 3),
    "20": ("wmi_consumer", 3), "22": ("dns_query", 1),
}
EVTX_IDS = {
    "4625": (["auth_failure"], 3), "4624": (["auth_success"], 0), "4688": (["process_creation"], 0), "4698": (["persistence"], 3),
    "7045": (["service_install"], 3), "1116": (["malware_detection"], 5), "1117": (["malware_detection"], 5), "4103": (["powershell"], 0),
    "4104": (["powershell"], 0), "4657": (["registry_change"], 0), "4740": (["account_lockout"], 3),
    "4798": (["user_enumeration", "reconnaissance"], 2), "4799": (["user_enumeration", "reconnaissance"], 2),
}
#: (words, tag, severity): the first whose words occur in the lower-cased message.
WINDOWS_WORDS = [
    (("4625", "failed logon", "logon failure"), "auth_failure", 3), (("4624", "logon success"), "auth_success", 0),
    (("4688", "process creation"), "process_creation", 0), (("4698", "scheduled task"), "persistence", 3),
    (("7045", "service install"), "service_install", 3), (("1116", "defender"), "malware_detection", 5),
    (("4104", "powershell"), "powershell", 2), (("4657", "registry"), "registry_change", 2), (("4740", "locked out"), "account_lockout", 3),
]
SENSOR_SEVERITY = {1: 7, 2: 5, 3: 3}
AUDIT_SEVERITY = {"RequestResponse": 2, "Request": 1, "Metadata": 0}


def _event(ok: Column, source: str, fields: list, tags: Column, severity: Column | int, ts: Column | None = None) -> Column:
    """``fields``: (name, column) pairs; those that are null are left out, as a key that is absent."""
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in fields]), lambda e: e["value"].isNotNull())
    severity = severity if isinstance(severity, Column) else F.lit(severity)
    ts = F.lit(None).cast("timestamp") if ts is None else ts
    return F.when(
        ok,
        F.struct(ts.alias("ts"), F.lit(source).alias("source"), F.map_from_entries(pairs).alias("fields"), tags.cast("array<string>").alias("tags"), severity.cast("int").alias("severity")),
    )


def _tags(*names: str) -> Column:
    return F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")


def _any(text: Column, words) -> Column:
    cond = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        cond = cond | F.contains(text, F.lit(w))
    return cond


def parse_int(text: Column) -> Column:
    """Whole number of a text; absent, ``-`` and anything else is 0."""
    return F.coalesce(F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int")), F.lit(0))


def utc_time(text: Column, *formats: str) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def iso_time(text: Column) -> Column:
    """RFC 3339 with any fraction and Z, +hh:mm or +hhmm."""
    zoned = F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(zoned.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"), zoned.try_cast("timestamp"))


def sensor_time(text: Column) -> Column:
    """RFC 3339, the same without a zone (UTC) or with a blank, with slashes, or as ``MM/dd/yyyy-HH:mm:ss``, each with any fraction."""
    slashed = F.regexp_replace(F.regexp_replace(text, r"^(\d{2})/(\d{2})/(\d{4})-", "$3-$1-${2}T"), r"^(\d{4})/(\d{2})/(\d{2})", "$1-$2-$3")
    return F.coalesce(iso_time(slashed), iso_time(F.concat(slashed, F.lit("Z"))))


def level_severity(level: Column) -> Column:
    out = F.lit(2)
    for name, sev in LEVEL_SEVERITY.items():
        out = F.when(F.lower(level) == name, sev).otherwise(out)
    return out


def _let(value: Column, body) -> Column:
    """``body`` of ``value`` evaluated once: without the binding, every use of a parsed text would parse it again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Set between groups; a text that has it is matched group by group.
_CUT = "\x1f"


def _groups(raw: Column, pattern: str, n: int) -> Column:
    """The ``n`` groups of a pattern anchored at the begin; an array of another size if it does not match.

    One pass of the regex puts the groups one after the other with a separator between; a text in which the separator
    occurs is taken apart by a pass a group instead. A dot is anything but a line feed and the end is the text's end.
    """
    whole = "(?d)" + (pattern[:-1] + r"\z" if pattern.endswith("$") else pattern + r"[\s\S]*")
    at_once = F.split(F.regexp_replace(raw, whole, _CUT.join(f"${i}" for i in range(1, n + 1))), _CUT, n + 1)
    each = F.when(raw.rlike(whole), F.array(*[F.regexp_extract(raw, whole, i) for i in range(1, n + 1)])).otherwise(F.array(raw))
    return F.when(F.contains(raw, F.lit(_CUT)), each).otherwise(at_once)


def one_json_object(raw: Column) -> Column:
    """The text is one whole JSON object; several, one a line, are not (the parser alone would take the first)."""
    return F.ltrim(raw).startswith("{") & F.try_parse_json(raw).isNotNull() & ~raw.rlike(r"\}\s*[\r\n]\s*\{")


def decode_apache(raw: Column) -> Column:
    return _let(_groups(raw, APACHE, 6), lambda p: _let(parse_int(F.get(p, F.lit(4))), lambda status: _apache_event(p, status)))


def _apache_event(p: Column, status: Column) -> Column:
    g = lambda i: F.get(p, F.lit(i - 1))
    tag = F.when(status >= 500, "http_error").when(status >= 400, "http_client_error").when(status >= 300, "http_redirect").otherwise("http_success")
    fields = [("client_ip", g(1)), ("method", g(3)), ("path", g(4)), ("status", status), ("bytes", parse_int(g(6))), ("event_type", F.lit("http_request"))]
    return _event(F.size(p) == 6, "decoder:apache", fields, F.array(tag), F.when(status >= 500, 3).when(status >= 400, 2).otherwise(0), utc_time(g(2), "dd/MMM/yyyy:HH:mm:ss Z"))


def decode_syslog(raw: Column, year: int | None = None, strict: bool = False) -> Column:
    """Any text that is not in the layout is its own message, unless ``strict``. ``year`` is put into the yearless time."""
    return _let(_groups(raw, SYSLOG, 5), lambda p: _let(F.lower(F.get(p, F.lit(4))), lambda low: _syslog_event(raw, p, low, year, strict)))


def _syslog_event(raw: Column, p: Column, low: Column, year: int | None, strict: bool) -> Column:
    g = lambda i: F.get(p, F.lit(i - 1))
    hit = F.size(p) == 5
    auth, ok = _any(low, ["failed password", "authentication failure"]), _any(low, ["accepted password"])
    err, warn = _any(low, ["error", "panic"]), _any(low, ["warn"])
    tags = F.when(auth, _tags("auth_failure", "security")).when(ok, _tags("auth_success", "security")).when(err, _tags("error")).when(warn, _tags("warning")).otherwise(_tags())
    sev = F.when(auth, 3).when(ok, 0).when(err, 2).when(warn, 1).otherwise(0)
    ts = F.try_to_timestamp(F.concat(F.lit(f"{year} "), F.regexp_replace(g(2), r"\s+", " "), F.lit(" Z")), F.lit("yyyy MMM d HH:mm:ss X")) if year else None
    own = lambda i: F.when(hit, g(i))
    fields = [("facility", F.when(hit, parse_int(g(1)))), ("timestamp", own(2)), ("hostname", own(3)), ("app", own(4)), ("message", F.when(hit, g(5)).otherwise(raw))]
    return _event(hit if strict else raw.isNotNull(), "decoder:syslog", fields, F.when(hit, tags).otherwise(_tags()), F.when(hit, sev).otherwise(0), ts)


def decode_windows(raw: Column) -> Column:
    return _let(_groups(raw, WINDOWS, 4), lambda p: _let(F.lower(F.get(p, F.lit(3))), lambda low: _windows_event(p, low)))


def _windows_event(p: Column, low: Column) -> Column:
    g = lambda i: F.get(p, F.lit(i - 1))
    message = g(4)
    tags, sev = F.when(_any(low, ["error"]), _tags("error")).otherwise(_tags()), F.when(_any(low, ["error"]), 2).otherwise(0)
    for words, tag, s in reversed(WINDOWS_WORDS):
        tags, sev = F.when(_any(low, words), _tags("security", tag)).otherwise(tags), F.when(_any(low, words), s).otherwise(sev)
    first = lambda tag: F.element_at(tags, 2) == tag
    has_two = F.size(tags) == 2
    logon = F.when(has_two & first("auth_failure"), F.regexp_extract(low, r"logon ?type: (10|2|3)", 1))
    after = lambda word, tag: F.when(has_two & first(tag), F.regexp_extract(message, rf"(?i){word}: *([^, \n]+)", 1))
    fields = [("date", g(1)), ("time", g(2)), ("source", g(3)), ("message", message), ("logontype", logon), ("process_path", after("process", "process_creation")), ("file_path", after("file", "malware_detection"))]
    stamp = F.concat(F.regexp_replace(g(1), "/", "-"), F.lit("T"), g(2), F.lit("Z"))
    return _event(F.size(p) == 4, "decoder:windows_event", fields, tags, sev, iso_time(stamp))


def decode_json(raw: Column) -> Column:
    """A JSON object: every key a field (nested values as JSON text), whatever its case."""
    return _let(F.from_json(F.when(one_json_object(raw), raw), "map<string,string>"), lambda whole: _json_event(raw, whole))


def _json_event(raw: Column, whole: Column) -> Column:
    ok = whole.isNotNull()
    get = lambda k: F.get(F.transform(F.filter(F.map_entries(whole), lambda e: e["key"] == k), lambda e: e["value"]), 0)
    # a number, not a text of figures
    number = F.when(raw.rlike(r'"severity"\s*:\s*-?[0-9]'), get("severity").try_cast("double").cast("int"))
    text_level = get("level")
    sev = F.coalesce(number, F.when(text_level.isNotNull(), level_severity(text_level)), F.lit(0))
    ts = F.coalesce(iso_time(get("timestamp")), iso_time(get("time")), iso_time(F.concat(get("time"), F.lit("Z"))))
    tags = F.when(get("source").isNotNull(), F.array(F.concat(F.lit("source:"), get("source")))).otherwise(_tags())
    return F.when(ok, F.struct(ts.alias("ts"), F.lit("decoder:json").alias("source"), F.map_filter(whole, lambda k, v: v.isNotNull()).alias("fields"), tags.alias("tags"), sev.cast("int").alias("severity")))


AUDIT_JSON = (
    "kind string, auditID string, verb string, level string, stage string, requestURI string, sourceIPs string, requestReceivedTimestamp string, user struct<username:string>, impersonatedUser struct<username:string>, "
    "objectRef struct<resource:string,subresource:string,namespace:string,name:string,apiGroup:string,apiVersion:string>, responseStatus struct<code:string,reason:string>"
)
SENSOR_JSON = (
    "event_type string, timestamp string, src_ip string, src_port string, dest_ip string, dest_port string, proto string, alert struct<action:string,rule:string,category:string,sid:string,severity:string>, "
    "dns struct<type:string,query:string,rcode:string>, http struct<hostname:string,url:string,http_method:string,status:string>, tls struct<sni:string,subject:string>"
)


def _is_audit(raw: Column) -> Column:
    return F.contains(raw, F.lit('"kind":"Event"')) | F.contains(raw, F.lit('"kind": "Event"'))


def decode_audit(raw: Column) -> Column:
    """Kubernetes audit events: JSON with kind Event and an audit id."""
    return _let(F.from_json(F.when(_is_audit(raw) & one_json_object(raw), raw), AUDIT_JSON), _audit_event)


def _audit_event(x: Column) -> Column:
    def g(path: str) -> Column:
        out = x
        for name in path.split("."):
            out = out[name]
        return out

    ok = (g("kind") == "Event") & (F.coalesce(g("auditID"), F.lit("")) != "")
    sub = F.coalesce(g("objectRef.subresource"), F.lit(""))
    resource = F.coalesce(F.concat(g("objectRef.resource"), F.when(sub != "", F.concat(F.lit("/"), sub)).otherwise("")), F.lit(""))
    verb, code = F.coalesce(g("verb"), F.lit("")), g("responseStatus.code").try_cast("int")
    base = F.lit(1)
    for name, s in AUDIT_SEVERITY.items():
        base = F.when(g("level") == name, s).otherwise(base)
    cases = [
        ((resource == "pods/exec") & (verb == "create"), "k8s:exec", 3),
        ((resource == "secrets") & (verb == "get"), "k8s:secret-access", 4),
        ((resource == "secrets") & (verb == "list"), "k8s:secret-access", 3),
        (F.contains(resource, F.lit("clusterrole")) | F.contains(resource, F.lit("rolebinding")), "k8s:rbac-change", 4),
        (verb == "impersonate", "k8s:impersonation", 4),
        (F.coalesce(code, F.lit(0)) >= 403, "k8s:unauthorized", 2),
        ((resource == "pods") & (verb == "create"), "k8s:pod-create", 0),
        (verb == "delete", "k8s:delete", 0),
    ]
    extra, least = _tags(), F.lit(0)
    for cond, tag, s in reversed(cases):
        extra, least = F.when(cond, _tags(tag)).otherwise(extra), F.when(cond, s).otherwise(least)
    fields = [
        ("audit_id", g("auditID")), ("user", g("user.username")), ("verb", g("verb")), ("request_uri", g("requestURI")), ("stage", g("stage")),
        ("level", g("level")), ("source_ips", g("sourceIPs")), ("impersonated_user", g("impersonatedUser.username")), ("resource", g("objectRef.resource")),
        ("namespace", g("objectRef.namespace")), ("name", g("objectRef.name")), ("api_group", g("objectRef.apiGroup")), ("api_version", g("objectRef.apiVersion")),
        ("subresource", F.when(sub != "", sub)), ("response_code", g("responseStatus.code")), ("response_reason", g("responseStatus.reason")), ("k8s_resource", resource),
    ]
    return _event(ok, "decoder:k8s_audit", fields, F.concat(_tags("k8s", "kubernetes"), extra), F.greatest(base, least), iso_time(g("requestReceivedTimestamp")))


def decode_sensor(raw: Column) -> Column:
    """Suricata EVE: JSON with an event_type."""
    return _let(F.from_json(F.when(one_json_object(raw), raw), SENSOR_JSON), _sensor_event)


def _sensor_event(x: Column) -> Column:
    def g(path: str) -> Column:
        out = x
        for name in path.split("."):
            out = out[name]
        return out

    kind = F.coalesce(g("event_type"), F.lit(""))
    ok = kind != ""
    alert = F.coalesce(g("alert").isNotNull(), F.lit(False))
    level = F.lit(1)
    for s, out in SENSOR_SEVERITY.items():
        level = F.when(g("alert.severity").try_cast("int") == s, out).otherwise(level)
    sent = lambda cond, path: F.when(F.coalesce(g(cond), F.lit("")) != "", g(path))
    fields = [
        ("event_type", kind), ("src_ip", sent("src_ip", "src_ip")), ("src_port", sent("src_ip", "src_port")), ("dest_ip", sent("dest_ip", "dest_ip")),
        ("dest_port", sent("dest_ip", "dest_port")), ("protocol", sent("proto", "proto")), ("rule", g("alert.rule")), ("category", g("alert.category")),
        ("action", g("alert.action")), ("sig_id", g("alert.sid")), ("dns_type", g("dns.type")), ("dns_query", g("dns.query")), ("dns_rcode", g("dns.rcode")),
        ("http_hostname", g("http.hostname")), ("http_url", g("http.url")), ("http_method", g("http.http_method")), ("http_status", g("http.status")),
        ("tls_sni", g("tls.sni")), ("tls_subject", g("tls.subject")),
    ]
    tags = F.when(alert, F.array(F.lit("nids"), kind, F.lit("alert"))).otherwise(F.array(F.lit("nids"), kind))
    return _event(ok, "suricata", fields, tags, F.when(alert, level).otherwise(1), sensor_time(g("timestamp")))


_DATA = "struct<Data:array<struct<_Name:string,_VALUE:string>>>"
EVENT_XML = f"System struct<Provider:struct<_Name:string>,EventID:string,Level:string,TimeCreated:struct<_SystemTime:string>,Execution:struct<_ProcessID:string>,Channel:string,Computer:string>, EventData {_DATA}, UserData {_DATA}"


def decode_evtx(raw: Column) -> Column:
    """Windows event XML: System, EventData and UserData, parsed once."""
    ok = F.ltrim(raw).rlike(r"^<Event[\s>]") & F.trim(raw).endswith("</Event>")
    return _let(F.from_xml(F.when(ok, F.regexp_replace(raw, r"<EventID [^>]*>", "<EventID>")), F.lit(EVENT_XML), {"mode": "PERMISSIVE"}), lambda x: _evtx_event(ok, x))


def _evtx_event(ok: Column, x: Column) -> Column:
    sys = x["System"]
    eid, provider, channel = F.coalesce(sys["EventID"], F.lit("")), F.coalesce(sys["Provider"]["_Name"], F.lit("")), F.coalesce(sys["Channel"], F.lit(""))
    extra, sev = _tags(), F.lit(0)
    for i, (tag, s) in SYSMON.items():
        hit = (provider == "Microsoft-Windows-Sysmon") & (eid == i)
        extra, sev = F.when(hit, _tags(tag)).otherwise(extra), F.when(hit, s).otherwise(sev)
    by_id, least = _tags(), F.lit(0)
    for i, (names, s) in EVTX_IDS.items():
        by_id, least = F.when(eid == i, _tags(*names)).otherwise(by_id), F.when(eid == i, s).otherwise(least)
    fields = [("event_id", eid), ("provider", provider), ("computer", sys["Computer"]), ("channel", channel), ("level_name", sys["Level"]), ("pid", sys["Execution"]["_ProcessID"])]
    none = F.array().cast("array<struct<_Name:string,_VALUE:string>>")
    data = F.concat(F.coalesce(x["EventData"]["Data"], none), F.coalesce(x["UserData"]["Data"], none))
    data = F.filter(data, lambda e: e["_Name"].isNotNull())
    # of equal names the last value stays, and data wins over the header
    pairs = F.concat(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in fields]), lambda e: e["value"].isNotNull()), F.transform(data, lambda e: F.struct(e["_Name"].alias("key"), e["_VALUE"].alias("value"))))
    keys = F.transform(pairs, lambda e: e["key"])
    last = F.filter(pairs, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys) + 1), e["key"]))
    return F.when(
        ok & (eid != ""),
        F.struct(
            iso_time(sys["TimeCreated"]["_SystemTime"]).alias("ts"), F.lit("decoder:evtx").alias("source"), F.map_from_entries(last).alias("fields"),
            F.concat(F.array(F.lit("windows"), channel), extra, by_id).alias("tags"), F.greatest(sev, least).cast("int").alias("severity"),
        ),
    )


def decode_csv(raw: Column, names: list[str]) -> Column:
    """Comma-separated values under the given names; further ones are field_N."""
    parts = F.split(F.regexp_replace(raw, r"[\r\n]+$", ""), ",")
    label = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    pairs = F.transform(parts, lambda v, i: F.struct(F.coalesce(F.get(label, i), F.concat(F.lit("field_"), i.cast("string"))).alias("key"), F.trim(v).alias("value")))
    return F.when(raw.isNotNull(), F.struct(F.lit(None).cast("timestamp").alias("ts"), F.lit("decoder:csv").alias("source"), F.map_from_entries(pairs).alias("fields"), _tags().alias("tags"), F.lit(0).alias("severity")))


def _decode_any_json(raw: Column) -> Column:
    """Audit, sensor and other JSON: whether the text is an object is tested once, and its named members are read once."""

    def of(text: Column) -> Column:
        named = lambda x: F.coalesce(F.when(_is_audit(text), _audit_event(x)), _sensor_event(x))
        return F.coalesce(_let(F.from_json(text, f"{AUDIT_JSON}, {SENSOR_JSON}"), named), _let(F.from_json(text, "map<string,string>"), lambda whole: _json_event(text, whole)))

    return _let(F.when(one_json_object(raw), raw), lambda text: F.when(text.isNotNull(), of(text)))


def decode_first(raw: Column, year: int | None = None, tree: Column | None = None) -> Column:
    """The chain: audit, sensor, JSON, web server, syslog in its layout, XML, Windows text, a decoder tree; anything else is a message."""
    others = [decode_apache(raw), decode_syslog(raw, year, strict=True), decode_evtx(raw), decode_windows(raw), *([tree] if tree is not None else []), decode_syslog(raw, year)]
    return F.coalesce(_decode_any_json(raw), *others)


def decode_auto(raw: Column, year: int | None = None) -> Column:
    """Audit, JSON, web server, syslog in its layout, Windows text; anything else is a message."""
    return F.coalesce(decode_audit(raw), decode_json(raw), decode_apache(raw), decode_syslog(raw, year, strict=True), decode_windows(raw), decode_syslog(raw, year))


def chained(source: Column, event: Column) -> Column:
    """The event with its source as ``source->decoder``."""
    return F.when(event.isNotNull(), event.withField("source", F.concat(source, F.lit("->"), event["source"])))


def decode_tree(raw: Column, program: Column, decoders: list[dict], tag_map: dict[str, list[str]] | None = None, error_words: list[str] | None = None) -> Column:
    """A parent-child decoder tree as one first-match expression.

    ``tag_map`` adds tags to those of a decoder; a text that has one of ``error_words`` in any letter case gets the tag
    error and severity 2.

    A decoder is a dict with name, and optionally parent, program (regex on the program name), prematch, regex and
    order (names of the regex's groups). Roots match by program name, else by prematch; below a root the first child
    whose prematch and regex match gives the fields. Decoders without ``order`` give tags only.
    """
    by_parent: dict[str | None, list[dict]] = {}
    for d in decoders:
        by_parent.setdefault(d.get("parent"), []).append(d)

    def emit(chain: list[dict]) -> Column:
        leaf = chain[-1]
        fields = [(n, F.regexp_extract(raw, leaf["regex"], i + 1)) for i, n in enumerate(leaf.get("order", []))] if leaf.get("regex") else []
        names = [d["name"] for d in chain]
        tags = _tags(*dict.fromkeys([*names, *(t for n in names for t in (tag_map or {}).get(n, []))]))
        bad = _any(F.lower(raw), error_words) if error_words else F.lit(False)
        return _event(F.lit(True), f"decoder:tree:{chain[0]['name']}", fields or [("message", raw)], F.when(bad, F.concat(tags, _tags("error"))).otherwise(tags), F.when(bad, 2).otherwise(0))

    out = F.lit(None)
    for root in by_parent.get(None, []):
        hit = program.rlike(root["program"]) if root.get("program") else raw.rlike(root["prematch"]) if root.get("prematch") else F.lit(False)
        inner = emit([root])
        for child in reversed(by_parent.get(root["name"], [])):
            cond = F.lit(True)
            for k in ("prematch", "regex"):
                if child.get(k):
                    cond = cond & raw.rlike(child[k])
            inner = F.when(cond, emit([root, child])).otherwise(inner)
        out = F.coalesce(out, F.when(hit, inner))
    return out


def decode_rows(df: DataFrame, decoder: Column, name: str = "e") -> DataFrame:
    """``df`` with the decoded event, rows that do not match left out.

    The generator evaluates the decoder once a row; as a plain column it would be repeated in the filter and in every
    use of one of its fields.
    """
    return df.withColumn(name, F.explode(F.filter(F.array(decoder), lambda e: e.isNotNull())))

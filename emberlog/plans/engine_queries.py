"""Queries for the engine's own operators, each over whole tables, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions import decoders as D
from emberlog.functions import indicators as I
from emberlog.functions.keys import folded, text_instant
from emberlog.functions.versions import version_order
from emberlog.operators import compliance, content_scan, correlate, intel, playbook, process_tree, rules, snapshots, store
from emberlog.operators.gate import gate_events
from emberlog.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

HOUR = 3600
#: The "now" of queries about age.
NOW = "2024-06-01 00:00:00"


def query(sql: str | None = None):
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return wrap


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def tag_text(c: Column) -> Column:
    return F.array_join(c, ",")


# ---------------------------------------------------------------- decoders


def by_outcome(df: DataFrame) -> DataFrame:
    return df.groupBy(tag_text(F.col("e.tags")).alias("tags"), F.col("e.severity").alias("severity")).agg(F.count("*").alias("n"))


@query(r"""
WITH m AS (SELECT regexp_extract(raw, '^<(\d+)>?(\w{3}\s+\d+\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+)\s+(.*)$', ['pri', 'at', 'host', 'app', 'msg']) AS g FROM raw_lines
  WHERE regexp_matches(raw, '^<(\d+)>?(\w{3}\s+\d+\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+)\s+(.*)$')),
l AS (SELECT g.app AS app, lower(g.msg) AS m FROM m)
SELECT regexp_replace(app, '\[.*$', '') AS app, CASE WHEN m LIKE '%failed password%' OR m LIKE '%authentication failure%' THEN 'auth_failure,security' WHEN m LIKE '%accepted password%' THEN 'auth_success,security'
  WHEN m LIKE '%error%' OR m LIKE '%panic%' THEN 'error' WHEN m LIKE '%warn%' THEN 'warning' ELSE '' END AS tags,
  CAST(CASE WHEN m LIKE '%failed password%' OR m LIKE '%authentication failure%' THEN 3 WHEN m LIKE '%accepted password%' THEN 0 WHEN m LIKE '%error%' OR m LIKE '%panic%' THEN 2 WHEN m LIKE '%warn%' THEN 1 ELSE 0 END AS INTEGER) AS severity, count(*) AS n
FROM l GROUP BY 1, 2, 3""")
def decode_syslog_auth(spark, d):
    e = D.decode_rows(table(spark, d, "raw_lines").select("raw"), D.decode_syslog(F.col("raw"), strict=True))
    app = F.regexp_replace(F.element_at("e.fields", "app"), r"\[.*$", "")
    return e.groupBy(app.alias("app"), tag_text(F.col("e.tags")).alias("tags"), F.col("e.severity").alias("severity")).agg(F.count("*").alias("n"))


@query("""
SELECT CASE WHEN s >= 500 THEN 'http_error' WHEN s >= 400 THEN 'http_client_error' WHEN s >= 300 THEN 'http_redirect' ELSE 'http_success' END AS tags,
  CAST(CASE WHEN s >= 500 THEN 3 WHEN s >= 400 THEN 2 ELSE 0 END AS INTEGER) AS severity, date_trunc('month', o_orderdate) AS month, count(*) AS n, sum(CASE WHEN o_custkey % 7 = 0 THEN 0 ELSE o_custkey END) AS bytes
FROM (SELECT *, 200 + 100 * (o_orderkey % 4) + o_orderkey % 5 AS s FROM orders) GROUP BY 1, 2, 3""")
def decode_apache_status(spark, d):
    line = F.concat(
        F.lit("10.0."), (F.col("o_custkey") % 256).cast("string"), F.lit(".1 - - ["), F.date_format("o_orderdate", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET /o/'), F.col("o_orderkey").cast("string"),
        F.lit(' HTTP/1.1" '), (200 + 100 * (F.col("o_orderkey") % 4) + F.col("o_orderkey") % 5).cast("string"), F.lit(" "), F.when(F.col("o_custkey") % 7 == 0, F.lit("-")).otherwise(F.col("o_custkey").cast("string")),
    )
    e = D.decode_rows(table(spark, d, "orders").select(line.alias("raw")), D.decode_apache(F.col("raw")))
    month = F.date_trunc("month", F.col("e.ts")).cast("timestamp_ntz")
    return e.groupBy(tag_text(F.col("e.tags")).alias("tags"), F.col("e.severity").alias("severity"), month.alias("month")).agg(F.count("*").alias("n"), F.sum(F.element_at("e.fields", "bytes").cast("long")).alias("bytes"))


@query("SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1, 2")
def decode_json_props(spark, d):
    e = D.decode_rows(table(spark, d, "events").select("event_type", "props"), D.decode_json(F.col("props")))
    return e.groupBy("event_type", F.element_at("e.fields", "k").alias("k")).agg(F.count("*").alias("n"))


_AUDIT_SQL = """
WITH j AS (SELECT payload AS p FROM nested_records WHERE json_valid(payload) AND starts_with(ltrim(payload), '{') AND (contains(payload, '"kind":"Event"') OR contains(payload, '"kind": "Event"'))),
f AS (SELECT json_extract_string(p, '$.kind') AS kind, coalesce(json_extract_string(p, '$.auditID'), '') AS aid, coalesce(json_extract_string(p, '$.verb'), '') AS verb, json_extract_string(p, '$.level') AS level,
  json_extract_string(p, '$.objectRef.resource') AS res, coalesce(json_extract_string(p, '$.objectRef.subresource'), '') AS sub, coalesce(try_cast(json_extract_string(p, '$.responseStatus.code') AS INTEGER), 0) AS code FROM j),
r AS (SELECT *, coalesce(res || CASE WHEN sub <> '' THEN '/' || sub ELSE '' END, '') AS resource FROM f WHERE kind = 'Event' AND aid <> ''),
c AS (SELECT *, CASE WHEN resource = 'pods/exec' AND verb = 'create' THEN 1 WHEN resource = 'secrets' AND verb = 'get' THEN 2 WHEN resource = 'secrets' AND verb = 'list' THEN 3
  WHEN contains(resource, 'clusterrole') OR contains(resource, 'rolebinding') THEN 4 WHEN verb = 'impersonate' THEN 5 WHEN code >= 403 THEN 6 WHEN resource = 'pods' AND verb = 'create' THEN 7 WHEN verb = 'delete' THEN 8 ELSE 9 END AS k,
  CASE level WHEN 'RequestResponse' THEN 2 WHEN 'Request' THEN 1 WHEN 'Metadata' THEN 0 ELSE 1 END AS base FROM r)
SELECT 'k8s,kubernetes' || ['', ',k8s:exec', ',k8s:secret-access', ',k8s:secret-access', ',k8s:rbac-change', ',k8s:impersonation', ',k8s:unauthorized', ',k8s:pod-create', ',k8s:delete', ''][k + 1] AS tags,
  CAST(greatest(base, [0, 3, 4, 3, 4, 4, 2, 0, 0, 0][k + 1]) AS INTEGER) AS severity, count(*) AS n FROM c GROUP BY 1, 2"""


@query(_AUDIT_SQL)
def decode_k8s_audit(spark, d):
    return by_outcome(D.decode_rows(table(spark, d, "nested_records").select("payload"), D.decode_audit(F.col("payload"))))


@query("""
WITH j AS (SELECT payload AS p FROM nested_records WHERE json_valid(payload) AND starts_with(ltrim(payload), '{')),
f AS (SELECT coalesce(json_extract_string(p, '$.event_type'), '') AS kind, starts_with(coalesce(CAST(json_extract(p, '$.alert') AS VARCHAR), ''), '{') AS alert, try_cast(json_extract_string(p, '$.alert.severity') AS INTEGER) AS s FROM j)
SELECT 'nids,' || kind || CASE WHEN alert THEN ',alert' ELSE '' END AS tags, CAST(CASE WHEN NOT alert THEN 1 WHEN s = 1 THEN 7 WHEN s = 2 THEN 5 WHEN s = 3 THEN 3 ELSE 1 END AS INTEGER) AS severity, count(*) AS n
FROM f WHERE kind <> '' GROUP BY 1, 2""")
def decode_suricata(spark, d):
    return by_outcome(D.decode_rows(table(spark, d, "nested_records").select("payload"), D.decode_sensor(F.col("payload"))))


_KINDS = {"error": "An account failed logon, Logon Type: 10", "click": "process creation Process: C:\\\\x.exe, done", "view": "registry value set", "purchase": "Defender found File: /tmp/a b", "signup": "nothing of note"}


@query("""
SELECT CASE event_type WHEN 'error' THEN 'security,auth_failure' WHEN 'click' THEN 'security,process_creation' WHEN 'view' THEN 'security,registry_change' WHEN 'purchase' THEN 'security,malware_detection' ELSE '' END AS tags,
  CAST(CASE event_type WHEN 'error' THEN 3 WHEN 'view' THEN 2 WHEN 'purchase' THEN 5 ELSE 0 END AS INTEGER) AS severity,
  CASE event_type WHEN 'error' THEN '10' WHEN 'click' THEN 'C:' || chr(92) || chr(92) || 'x.exe' WHEN 'purchase' THEN '/tmp/a' END AS detail, count(*) AS n, max(date_trunc('second', ts)) AS last_ts
FROM events GROUP BY 1, 2, 3""")
def decode_windows_text(spark, d):
    words = F.lit(None)
    for k, v in _KINDS.items():
        words = F.when(F.col("event_type") == k, F.lit(v)).otherwise(words)
    line = F.concat(F.date_format("ts", "yyyy/MM/dd HH:mm:ss"), F.lit(" (Security) "), words)
    e = D.decode_rows(table(spark, d, "events").select(line.alias("raw")), D.decode_windows(F.col("raw")))
    detail = F.coalesce(*[F.get(F.map_values(F.map_filter("e.fields", lambda k, v: k.isin("logontype", "process_path", "file_path"))), 0)])
    return e.groupBy(tag_text(F.col("e.tags")).alias("tags"), F.col("e.severity").alias("severity"), detail.alias("detail")).agg(F.count("*").alias("n"), F.max(F.col("e.ts").cast("timestamp_ntz")).alias("last_ts"))


@query("""
SELECT 'windows,Security' || CASE event_id % 4 WHEN 0 THEN ',auth_failure' WHEN 1 THEN ',process_creation' WHEN 2 THEN ',user_enumeration,reconnaissance' ELSE '' END AS tags,
  CAST(CASE event_id % 4 WHEN 0 THEN 3 WHEN 2 THEN 2 ELSE 0 END AS INTEGER) AS severity, CAST(user_id AS VARCHAR) AS target, count(*) AS n FROM events GROUP BY 1, 2, 3""")
def decode_evtx_xml(spark, d):
    eid = F.element_at(F.array(F.lit("4625"), F.lit("4688"), F.lit("4798"), F.lit("1")), (F.col("event_id") % 4 + 1).cast("int"))
    xml = F.concat(
        F.lit('<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><Provider Name="Audit"/><EventID>'), eid,
        F.lit("</EventID><Level>0</Level><Channel>Security</Channel><Computer>h</Computer></System><EventData><Data Name=\"TargetUser\">"), F.col("user_id").cast("string"), F.lit("</Data></EventData></Event>"),
    )
    e = D.decode_rows(table(spark, d, "events").select(xml.alias("raw")), D.decode_evtx(F.col("raw")))
    return e.groupBy(tag_text(F.col("e.tags")).alias("tags"), F.col("e.severity").alias("severity"), F.element_at("e.fields", "TargetUser").alias("target")).agg(F.count("*").alias("n"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name, CAST(n_regionkey AS VARCHAR) AS field_2 FROM nation")
def decode_csv_fields(spark, d):
    line = F.concat_ws(", ", F.col("n_nationkey").cast("string"), "n_name", F.concat(F.col("n_regionkey").cast("string"), F.lit("\n")))
    e = D.decode_rows(table(spark, d, "nation").select(line.alias("raw")), D.decode_csv(F.col("raw"), ["key", "name"]))
    return e.select(*[F.element_at("e.fields", k).alias(k) for k in ("key", "name", "field_2")])


TREE = [
    {"name": "sshd", "program": "^sshd"},
    {"name": "sshd-refused", "parent": "sshd", "prematch": "refused password", "regex": r"for (\S+) from (\S+)", "order": ["user", "client_ip"]},
    {"name": "sshd-session", "parent": "sshd", "prematch": "session for", "regex": r"session for (\S+)", "order": ["user"]},
    {"name": "disk", "prematch": "^disk at", "regex": ""},
]


@query(r"""
WITH l AS (SELECT raw, regexp_extract(raw, '^([A-Za-z_-]+)', 1) AS program FROM siem_events WHERE raw IS NOT NULL)
SELECT CASE WHEN program LIKE 'sshd%' THEN CASE WHEN raw LIKE '%refused password%' AND regexp_matches(raw, 'for (\S+) from (\S+)') THEN 'sshd,sshd-refused' WHEN regexp_matches(raw, 'session for (\S+)') THEN 'sshd,sshd-session' ELSE 'sshd' END ELSE 'disk' END AS tags,
  CASE WHEN program LIKE 'sshd%' THEN CASE WHEN raw LIKE '%refused password%' AND regexp_matches(raw, 'for (\S+) from (\S+)') THEN regexp_extract(raw, 'for (\S+) from (\S+)', 1) WHEN regexp_matches(raw, 'session for (\S+)') THEN regexp_extract(raw, 'session for (\S+)', 1) END END AS username, count(*) AS n
FROM l WHERE program LIKE 'sshd%' OR raw LIKE 'disk at%' GROUP BY 1, 2""")
def decode_program_tree(spark, d):
    raw = F.col("raw")
    e = D.decode_rows(table(spark, d, "siem_events").where(raw.isNotNull()).select("raw"), D.decode_tree(raw, F.regexp_extract(raw, "^([A-Za-z_-]+)", 1), TREE))
    return e.groupBy(tag_text(F.col("e.tags")).alias("tags"), F.element_at("e.fields", "user").alias("username")).agg(F.count("*").alias("n"))


@query(r"""
WITH l AS (SELECT raw FROM siem_events UNION ALL SELECT raw FROM raw_lines UNION ALL SELECT props FROM events UNION ALL SELECT payload FROM nested_records),
j AS (SELECT raw, CASE WHEN json_valid(raw) AND starts_with(ltrim(raw), '{') THEN raw END AS o FROM l WHERE raw IS NOT NULL)
SELECT CASE WHEN o IS NOT NULL AND (contains(raw, '"kind":"Event"') OR contains(raw, '"kind": "Event"')) AND json_extract_string(o, '$.kind') = 'Event' AND coalesce(json_extract_string(o, '$.auditID'), '') <> '' THEN 'decoder:k8s_audit'
  WHEN o IS NOT NULL AND coalesce(json_extract_string(o, '$.event_type'), '') <> '' THEN 'suricata' WHEN o IS NOT NULL THEN 'decoder:json'
  WHEN regexp_matches(raw, '^(\d{4}/\d{2}/\d{2})\s+(\d{2}:\d{2}:\d{2}(?:\.\d+)?)\s+\(([^)]+)\)\s+(.*)$') THEN 'decoder:windows_event' ELSE 'decoder:syslog' END AS source, count(*) AS n FROM j GROUP BY 1""")
def decode_chain_first_match(spark, d):
    lines = table(spark, d, "siem_events").select("raw").union(table(spark, d, "raw_lines").select("raw")).union(table(spark, d, "events").select("props")).union(table(spark, d, "nested_records").select("payload"))
    return D.decode_rows(lines, D.decode_first(F.col("raw"))).groupBy(F.col("e.source").alias("source")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- rules

_E = "SELECT event_id, tags, fields, severity FROM siem_events"


def matched(spark, d, condition: str) -> DataFrame:
    e = table(spark, d, "siem_events").select("event_id", "tags", "fields", "severity")
    return e.where(rules.compile_condition(condition, F.col("tags"), F.col("fields"), F.col("severity"))).select("event_id")


@query("SELECT event_id FROM siem_events WHERE len(list_filter(tags, lambda t: contains(t, 'auth'))) > 0")
def rule_tag_filter(spark, d):
    return matched(spark, d, "tag:auth")


@query("SELECT event_id FROM siem_events WHERE coalesce(fields['user'], '<nil>') = 'kiosk'")
def rule_field_eq(spark, d):
    return matched(spark, d, "field:user == kiosk")


@query("SELECT event_id FROM siem_events WHERE coalesce(fields['user'], '<nil>') <> 'kiosk'")
def rule_field_ne(spark, d):
    return matched(spark, d, "field:user != kiosk")


@query(r"SELECT event_id FROM siem_events WHERE regexp_matches(coalesce(fields['path'], '<nil>'), '(?i)(temp|cron|\.ssh)')")
def rule_field_regex(spark, d):
    return matched(spark, d, r"field:path ~= (temp|cron|\.ssh)")


@query("SELECT event_id FROM siem_events WHERE coalesce(try_cast(fields['pid'] AS DOUBLE), 0) > 30000")
def rule_field_gt(spark, d):
    return matched(spark, d, "field:pid > 30000")


@query("SELECT event_id FROM siem_events WHERE coalesce(try_cast(fields['pid'] AS DOUBLE), 0) < 2000")
def rule_field_lt(spark, d):
    return matched(spark, d, "field:pid < 2000")


@query("SELECT event_id FROM siem_events WHERE starts_with(coalesce(fields['client_ip'], '<nil>'), '10.1')")
def rule_cidr_prefix(spark, d):
    return matched(spark, d, "field:client_ip in 10.1/8")


@query(r"""SELECT event_id FROM (SELECT event_id, string_split(fields['client_ip'], '.') AS p FROM siem_events WHERE regexp_matches(fields['client_ip'], '^\d{1,3}(\.\d{1,3}){3}$'))
WHERE CAST(p[1] AS BIGINT) * 16777216 + CAST(p[2] AS BIGINT) * 65536 + CAST(p[3] AS BIGINT) * 256 + CAST(p[4] AS BIGINT) BETWEEN 10 * 16777216 + 16 * 65536 AND 10 * 16777216 + 31 * 65536 + 65535""")
def rule_cidr_exact(spark, d):
    e = table(spark, d, "siem_events").select("event_id", "fields")
    return e.where(rules.in_network(F.element_at("fields", F.lit("client_ip")), "10.16.0.0/12")).select("event_id")


@query("SELECT event_id FROM siem_events WHERE severity >= 4")
def rule_severity_floor(spark, d):
    return matched(spark, d, "severity>=4")


_TAG_RULES = [r for r in rules.BUILTIN if r.condition.startswith("tag:")]


@query(" UNION ALL ".join(f"SELECT '{r.rule_id}' AS rule_id, CAST({r.severity} AS INTEGER) AS rule_severity, count(*) AS n FROM siem_events WHERE len(list_filter(tags, lambda t: contains(t, '{r.condition[4:]}'))) > 0 HAVING count(*) > 0" for r in _TAG_RULES))
def rule_multi_match_explode(spark, d):
    m = rules.match_rules(table(spark, d, "siem_events").select("event_id", "tags", "fields", "severity"), rules.BUILTIN)
    return m.groupBy("rule_id", "rule_severity").agg(F.count("*").alias("n"))


@query("""SELECT user_id, event_type, event_id, in_window FROM (SELECT *, count(*) OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS in_window FROM events) WHERE in_window >= 3""")
def sliding_threshold_counts(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "ts")
    return rules.threshold_alerts(e, "ts", ["user_id", "event_type"], 3, 24 * HOUR).drop("ts")


LINE_RULES = [
    rules.Rule("MULTIPLE_FAILED_LOGINS", "Several failed logins of one host", 4, "T1110.003", "tag:auth_failure", 24 * HOUR, 3, actions=(("ip-reputation", (("ip", "${hostname}"),)),)),
    rules.Rule("ERRORS", "Errors", 2, "", "tag:error"),
]


def line_alerts(spark, d) -> DataFrame:
    """Syslog lines -> decoder -> rules -> trailing counts -> alerts."""
    e = table(spark, d, "events")
    text = F.when(F.col("event_type") == "error", "Failed password for root").when(F.col("event_type") == "signup", "error in unit").otherwise("session opened")
    line = F.concat(F.lit("<34>"), F.date_format("ts", "MMM dd HH:mm:ss"), F.lit(" host-"), (F.col("user_id") % 40).cast("string"), F.lit(" sshd "), text)
    events = D.decode_rows(e.select("event_id", "ts", line.alias("raw")), D.decode_syslog(F.col("raw"), 2024)).select("event_id", "ts", F.col("e.tags").alias("tags"), F.col("e.fields").alias("fields"), F.col("e.severity").alias("severity"))
    return rules.threshold_alerts(rules.match_rules(events, LINE_RULES), "ts", ["rule_id", "corr_key"], F.col("threshold"), F.col("window_s"), lengths=[r.window_s for r in LINE_RULES])


@query("""
WITH m AS (SELECT event_id, ts, 'host-' || (user_id % 40) AS host, event_type FROM events WHERE event_type IN ('error', 'signup'))
SELECT 'MULTIPLE_FAILED_LOGINS' AS rule_id, host AS corr_key, event_id, in_window, 'MULTIPLE_FAILED_LOGINS-' || epoch_us(ts) AS alert_id FROM (SELECT *, count(*) OVER (PARTITION BY host ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS in_window FROM m WHERE event_type = 'error') WHERE in_window >= 3
UNION ALL SELECT 'ERRORS', '', event_id, 1, 'ERRORS-' || epoch_us(ts) FROM m WHERE event_type = 'signup'""")
def sliding_threshold_alerts(spark, d):
    a = line_alerts(spark, d).withColumn("in_window", F.when(F.col("threshold") > 1, F.col("in_window")).otherwise(F.lit(1).cast("long")))
    return a.select("rule_id", "corr_key", "event_id", "in_window", rules.alert_id(F.col("rule_id"), F.col("ts")).alias("alert_id"))


@query("""
SELECT 'ip-reputation' AS playbook, 'host-' || (user_id % 40) AS ip, count(*) AS n FROM (SELECT *, count(*) OVER (PARTITION BY user_id % 40 ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS k FROM events WHERE event_type = 'error') WHERE k >= 3 GROUP BY 1, 2""")
def alert_actions(spark, d):
    a = rules.actions_of(line_alerts(spark, d), LINE_RULES)
    return a.groupBy("playbook", F.element_at("params", F.lit("ip")).alias("ip")).agg(F.count("*").alias("n"))


@query("""SELECT 'SIEM: MULTIPLE_FAILED_LOGINS' AS title, 'medium' AS severity, count(*) AS n FROM (SELECT count(*) OVER (PARTITION BY user_id % 40 ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS k FROM events WHERE event_type = 'error') WHERE k >= 3""")
def alert_cases(spark, d):
    a = line_alerts(spark, d).withColumn("alert_id", rules.alert_id(F.col("rule_id"), F.col("ts")))
    return store.alerts_to_cases(a).groupBy("title", "severity").agg(F.count("*").alias("n"))


@query("""
WITH RECURSIVE e AS (SELECT event_type, event_id, ts FROM events), k AS (
  SELECT event_type, min(ts) AS ts FROM e GROUP BY 1
  UNION ALL SELECT k.event_type, (SELECT min(e.ts) FROM e WHERE e.event_type = k.event_type AND e.ts >= k.ts + INTERVAL 6 HOUR) FROM k WHERE k.ts IS NOT NULL)
SELECT e.event_type, e.event_id FROM k JOIN e ON e.event_type = k.event_type AND e.ts = k.ts""")
def suppressed_alerts(spark, d):
    return correlate.suppressed(table(spark, d, "events").select("event_type", "event_id", "ts"), "event_type", "ts", "event_id", 6 * HOUR).select("event_type", "event_id")


CONTROLS = [("T1110", "pci_dss_v4.0", "8.2.1"), ("T1110", "gdpr", "Art.32"), ("T1110.003", "pci_dss_v4.0", "8.2.1"), ("T1059", "nist_sp_800-53", "SI-3")]


@query("""
WITH c(technique, framework, control_id) AS (VALUES ('T1110','pci_dss_v4.0','8.2.1'), ('T1110','gdpr','Art.32'), ('T1110.003','pci_dss_v4.0','8.2.1'), ('T1059','nist_sp_800-53','SI-3')),
r(rule_id, severity, mitre) AS (VALUES """ + ", ".join(f"('{r.rule_id}', {r.severity}, '{r.mitre}')" for r in rules.BUILTIN) + """), m AS (SELECT rule_id, framework, control_id FROM r JOIN c ON r.mitre = c.technique)
SELECT * FROM m UNION ALL SELECT rule_id, framework, control_id FROM r, (VALUES ('pci_dss_v3.2.1', '6.2'), ('nist_sp_800-53', 'AU-12')) AS f(framework, control_id) WHERE severity BETWEEN 4 AND 6 AND rule_id NOT IN (SELECT rule_id FROM m)""")
def mitre_compliance_map(spark, d):
    r = spark.createDataFrame([(x.rule_id, x.severity, x.mitre) for x in rules.BUILTIN], "rule_id string, severity int, mitre string")
    return rules.map_controls(r, spark.createDataFrame(CONTROLS, "technique string, framework string, control_id string"))


@query("SELECT count(*) AS rules, 3 AS builtin_kept FROM (VALUES " + ", ".join(f"('{r.rule_id}')" for r in rules.BUILTIN) + ", ('EXTRA'))")
def rule_union(spark, d):
    extra = rules.load_rules('{"rules": [{"rule_id": "EXTRA", "condition": "tag:x", "window": "1m30s"}, {"rule_id": "HTTP_5XX_ERROR", "condition": "tag:other", "severity": 9}, {"condition": "tag:y"}]}')
    out = rules.union_rules(rules.BUILTIN, extra)
    kept = next(r.severity for r in out if r.rule_id == "HTTP_5XX_ERROR")
    return spark.createDataFrame([(len(out), kept)], "rules long, builtin_kept int")


# ---------------------------------------------------------------- correlation


@query("""
SELECT user_id, event_id FROM (SELECT *, lag(event_type) OVER w AS p, lag(ts) OVER w AS pt FROM events WHERE event_type IN ('click', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE event_type = 'purchase' AND p = 'click' AND ts < pt + INTERVAL 6 HOUR""")
def create_then_delete(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    return correlate.create_then_delete(e, "user_id", "ts", "event_id", F.col("event_type") == "click", F.col("event_type") == "purchase", 6 * HOUR).select("user_id", "event_id")


@query("SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id, CAST(ts AS DATE) AS day FROM events GROUP BY user_id, event_type, day")
def dedup_first_seen(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "ts", F.to_date("ts").alias("day"))
    return correlate.first_seen(e, ["user_id", "event_type", "day"], "ts", "event_id").select("user_id", "event_type", "event_id", "day")


_DAY1 = "ts < TIMESTAMP '2024-01-02'"


@query(f"SELECT event_type, CAST(least(greatest(floor(count(*) / 24) * 3, 20), 5000) AS BIGINT) AS flood_threshold FROM events WHERE {_DAY1} GROUP BY 1")
def flood_baseline(spark, d):
    return correlate.flood_thresholds(table(spark, d, "events").where("ts < TIMESTAMP_NTZ '2024-01-02'"), "event_type", 24)


@query(f"""
WITH t AS (SELECT event_type, CAST(least(greatest(floor(count(*) / 24) * 3, 20), 5000) AS BIGINT) AS flood_threshold FROM events WHERE {_DAY1} GROUP BY 1)
SELECT e.event_type, window_start, n AS events, coalesce(flood_threshold, 100) AS flood_threshold FROM (SELECT event_type, time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS n FROM events GROUP BY 1, 2) e LEFT JOIN t USING (event_type) WHERE n > coalesce(flood_threshold, 100)""")
def flood_windows(spark, d):
    e = table(spark, d, "events")
    t = correlate.flood_thresholds(e.where("ts < TIMESTAMP_NTZ '2024-01-02'"), "event_type", 24)
    out = correlate.floods(e, t, "event_type", "ts", 12 * HOUR)
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, ts, event_type, json_extract_string(props, '$.k') AS k FROM events), a AS (
  SELECT user_id, min(ts) AS anchor FROM e GROUP BY 1
  UNION ALL SELECT a.user_id, (SELECT min(e.ts) FROM e WHERE e.user_id = a.user_id AND e.ts > a.anchor + INTERVAL 12 HOUR) FROM a WHERE a.anchor IS NOT NULL),
b AS (SELECT user_id, anchor FROM a WHERE anchor IS NOT NULL),
s AS (SELECT e.*, b.anchor FROM e ASOF JOIN b ON e.user_id = b.user_id AND e.ts >= b.anchor),
c AS (SELECT user_id, anchor, count(*) AS steps, bool_or(event_type = 'view') AS f, bool_or(event_type = 'click') AS p, bool_or(event_type = 'purchase') AS n FROM s GROUP BY 1, 2),
d AS (SELECT *, CASE WHEN f AND p AND n THEN 0.75 WHEN f AND p THEN 0.5 WHEN p AND n THEN 0.4 END AS base FROM c WHERE steps >= 3),
g AS (SELECT * FROM d WHERE base IS NOT NULL),
o AS (SELECT DISTINCT user_id, anchor, k FROM s WHERE k IS NOT NULL),
u AS (SELECT k, count(DISTINCT user_id) AS users FROM o SEMI JOIN g USING (user_id, anchor) GROUP BY 1),
l AS (SELECT user_id, anchor, sum(users - 1) AS linked FROM o JOIN u USING (k) GROUP BY 1, 2)
SELECT g.user_id, epoch_us(g.anchor) AS started_us, steps, least(1.0, round(base + 0.1 + 0.15 * greatest(coalesce(linked, 0), 0), 6))::DOUBLE AS confidence, CAST(coalesce(linked, 0) AS BIGINT) AS linked FROM g LEFT JOIN l USING (user_id, anchor)""")
def kill_chain_confidence(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type", F.get_json_object("props", "$.k").alias("k"))
    t = F.col("event_type")
    return correlate.kill_chains(e, "user_id", "ts", "event_id", t == "view", t == "click", t == "purchase", "k", 12 * HOUR)


@query("SELECT event_type, user_id, count(*) AS dismissals, max(ts) AS last_seen FROM events GROUP BY 1, 2 HAVING count(*) >= 10")
def fp_throttle(spark, d):
    return correlate.throttled(table(spark, d, "events"), "event_type", "user_id", "ts")


@query("SELECT user_id, event_id, (n - 1) % 11 + 1 > 3 AS suppressed FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)")
def fim_flapping(spark, d):
    return correlate.flapping(table(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", "ts", "event_id").select("user_id", "event_id", "suppressed")


@query("""
WITH RECURSIVE h AS (SELECT event_id, ts, user_id % 3 AS about, count(*) OVER (ORDER BY epoch_us(ts) RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW) AS in_window FROM events WHERE event_type IN ('error', 'click')),
f AS (SELECT *, in_window * 3 // 30 AS score FROM h WHERE in_window >= 30 AND in_window * 3 // 30 >= 3), k AS (
  SELECT about, min(ts) AS ts FROM f GROUP BY 1 UNION ALL SELECT k.about, (SELECT min(f.ts) FROM f WHERE f.about = k.about AND f.ts >= k.ts + INTERVAL 1 HOUR) FROM k WHERE k.ts IS NOT NULL)
SELECT f.about, f.event_id, f.in_window, CAST(f.score AS BIGINT) AS score, 'burst' AS rule FROM k JOIN f ON f.about = k.about AND f.ts = k.ts""")
def correlator_bursts(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", "event_type", (F.col("user_id") % 3).alias("about"))
    out = correlate.burst_alerts(e, "ts", "event_id", "event_type", "burst", ["error", "click"], 6 * HOUR, 30, 3, HOUR * 1000, "about")
    return out.select("about", "event_id", "in_window", "score", "rule")


@query("""
WITH s AS (SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, l_extendedprice / 10000 AS v FROM lineitem),
w AS (SELECT *, count(v) OVER o AS n, avg(v) OVER o AS m, stddev_pop(v) OVER o AS sd FROM s WINDOW o AS (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, v ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING))
SELECT l_partkey, l_orderkey, l_linenumber, round(CASE WHEN n >= 3 AND sd >= 0.1 THEN abs(v - m) / sd ELSE 0 END, 4) AS z, CASE WHEN n >= 3 AND sd >= 0.1 THEN round(abs(v - m) / sd, 4) > 3 ELSE v > 7 END AS anomalous FROM w""")
def entropy_zscore(spark, d):
    s = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", (F.col("l_extendedprice") / 10000).alias("v"))
    out = correlate.zscore_anomalies(s, "l_partkey", "v", ["l_orderkey", "l_linenumber", "l_suppkey", "v"])
    z = F.round("z", 4)
    return out.select("l_partkey", "l_orderkey", "l_linenumber", z.alias("z"), F.when(F.col("z") > 0, z > 3).otherwise(F.col("anomalous")).alias("anomalous"))


# ---------------------------------------------------------------- snapshots, trees


@query("""
WITH b AS (SELECT user_id, max(value) AS size, count(*) AS mode FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-10' GROUP BY 1), a AS (SELECT user_id, max(value) AS size, count(*) AS mode FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-11' GROUP BY 1)
SELECT user_id, CASE WHEN b.size IS NULL THEN 'added' WHEN a.size IS NULL THEN 'deleted' WHEN a.size <> b.size THEN 'modified' WHEN a.mode <> b.mode THEN 'attribute_change' END AS change FROM a FULL JOIN b USING (user_id) WHERE change IS NOT NULL""")
def snapshot_diff_full_outer(spark, d):
    day = lambda x: table(spark, d, "events").where(F.to_date("ts") == F.lit(x)).groupBy("user_id").agg(F.max("value").alias("size"), F.count("*").alias("mode"))
    return snapshots.diff_snapshots(day("2024-01-10"), day("2024-01-11"), ["user_id"], ["size"], ["mode"])


@query("""
WITH b AS (SELECT DISTINCT user_id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-10'), a AS (SELECT DISTINCT user_id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-11')
SELECT user_id, 'started' AS change FROM a ANTI JOIN b USING (user_id) UNION ALL SELECT user_id, 'stopped' FROM b ANTI JOIN a USING (user_id)""")
def snapshot_new_gone_anti(spark, d):
    day = lambda x: table(spark, d, "events").where(F.to_date("ts") == F.lit(x))
    return snapshots.appeared_and_gone(day("2024-01-10"), day("2024-01-11"), ["user_id"])


_NAMES = ["WINWORD.EXE", "powershell.exe", "cmd.exe", "explorer.exe", "svchost.exe"]
_PROC_SQL = "SELECT p_partkey AS pid, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS ppid, ['WINWORD.EXE','powershell.exe','cmd.exe','explorer.exe','svchost.exe'][(p_partkey * 7 % 5) + 1] AS name FROM part"


def processes(spark, d) -> DataFrame:
    names = F.array(*[F.lit(n) for n in _NAMES])
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("pid"), F.when(k > 1, F.floor(k / 2)).alias("ppid"), F.element_at(names, (k * 7 % 5 + 1).cast("int")).alias("name"))


@query(f"""WITH p AS ({_PROC_SQL}) SELECT c.ppid AS parent_pid, a.name AS parent_name, c.pid AS pid, c.name AS name FROM p c JOIN p a ON c.ppid = a.pid
WHERE (lower(a.name) = 'winword.exe' AND c.name IN ('powershell.exe', 'cmd.exe')) OR (a.name = 'explorer.exe' AND c.name IN ('powershell.exe', 'cmd.exe'))""")
def suspicious_ancestry(spark, d):
    return process_tree.suspicious_ancestry(processes(spark, d), "pid", "ppid", "name")


@query(f"WITH RECURSIVE p AS ({_PROC_SQL}), t AS (SELECT pid AS node, 0 AS depth, pid AS root FROM p WHERE ppid IS NULL OR ppid NOT IN (SELECT pid FROM p) UNION ALL SELECT p.pid, t.depth + 1, t.root FROM p JOIN t ON p.ppid = t.node) SELECT node, CAST(depth AS BIGINT) AS depth, root FROM t")
def ancestor_depth(spark, d):
    return process_tree.ancestors(processes(spark, d), "pid", "ppid")


@query(f"WITH RECURSIVE p AS ({_PROC_SQL}), t AS (SELECT pid AS start, ppid AS ancestor, 1 AS step FROM p WHERE name = 'cmd.exe' AND ppid IS NOT NULL UNION ALL SELECT t.start, p.ppid, t.step + 1 FROM t JOIN p ON t.ancestor = p.pid WHERE p.ppid IS NOT NULL) SELECT start, ancestor, CAST(step AS INTEGER) AS step FROM t")
def ancestor_chains(spark, d):
    p = processes(spark, d)
    return process_tree.ancestor_chain(p, "pid", "ppid", p.where("name = 'cmd.exe'"))


@query("SELECT event_type, count(*) AS n FROM events WHERE (event_type LIKE '%c%') AND value > 5 GROUP BY 1")
def path_and_port_filters(spark, d):
    e = table(spark, d, "events").where(~snapshots.excluded_path(F.col("event_type"), ["ew", "sign", "err"]) & (F.col("value") > 5))
    return e.groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT action_type, count(*) AS n FROM edr_actions WHERE len(list_filter(['temp', 'tmp', 'downloads', 'desktop' || chr(92), 'startup' || chr(92), chr(92) || 'appdata' || chr(92) || 'roaming' || chr(92), chr(92) || 'users' || chr(92) || 'public' || chr(92), 'recycle.bin', 'system32' || chr(92) || 'tasks' || chr(92), 'programdata' || chr(92), 'autostart'], lambda x: contains(lower(target), x))) > 0 GROUP BY 1""")
def suspicious_paths(spark, d):
    return table(spark, d, "edr_actions").where(I.suspicious_path(F.col("target"))).groupBy("action_type").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- intelligence

CVES = [("CVE-1", "ring", "<", "1.20", 9.8), ("CVE-2", "red*", "<=", "1.5.0-rc1", 7.5), ("CVE-3", "*", ">", "1.48", 5.0), ("CVE-4", "small ring", "=", "v1.11.0", 3.1), ("CVE-5", "blue", "<", "x", 9.0)]


@query("""
WITH c(cve_id, pat, cvss) AS (VALUES ('CVE-1', 'ring', 9.8::DOUBLE), ('CVE-2', 'red', 7.5), ('CVE-3', '', 5.0), ('CVE-4', 'small ring', 3.1)),
p AS (SELECT p_partkey, p_name AS name, p_size AS s FROM part)
SELECT p_partkey, cve_id, CASE WHEN cvss >= 9 THEN 'critical' WHEN cvss >= 7 THEN 'high' WHEN cvss >= 4 THEN 'medium' ELSE 'low' END AS severity FROM p, c WHERE (cve_id = 'CVE-1' AND contains(name, 'ring') AND s < 20) OR (cve_id = 'CVE-2' AND starts_with(name, 'red') AND s < 5)
  OR (cve_id = 'CVE-3' AND (s > 48 OR s = 48)) OR (cve_id = 'CVE-4' AND contains(name, 'small ring') AND s = 11)""")
def vuln_match_theta(spark, d):
    pk = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.concat(F.lit("1."), F.col("p_size").cast("string"), F.lit(".0")).alias("version"))
    c = spark.createDataFrame(CVES, "cve_id string, pattern string, op string, fixed string, cvss double")
    return intel.match_vulnerabilities(pk, c).select("p_partkey", "cve_id", I.cvss_severity(F.col("cvss")).alias("severity"))


@query("SELECT a, b, CAST(r AS INTEGER) AS r FROM (VALUES ('1.2.3','1.2.3',0), ('v1.2','1.2.0',-1), ('2.0-beta','2.0',-1), ('1.10','1.9',1), ('1.0+b','1.0-a',0), ('x','1',NULL), ('1:9.6p1','1',1), ('9.6p1','9.6',0)) AS t(a, b, r)")
def version_compare(spark, d):
    rows = [("1.2.3", "1.2.3"), ("v1.2", "1.2.0"), ("2.0-beta", "2.0"), ("1.10", "1.9"), ("1.0+b", "1.0-a"), ("x", "1"), ("1:9.6p1", "1"), ("9.6p1", "9.6")]
    return spark.createDataFrame(rows, "a string, b string").withColumn("r", version_order(F.col("a"), F.col("b")))


IOCS = [("10.1", "malicious"), ("kiosk", "suspicious"), ("web-26.branch.example", "malicious"), ("198.51.100.", "suspicious")]


@query("""
WITH i(ioc, reputation) AS (VALUES ('10.1','malicious'), ('kiosk','suspicious'), ('web-26.branch.example','malicious'), ('198.51.100.','suspicious')),
v AS (SELECT event_id, value, lower(trim(value)) AS x FROM (SELECT event_id, coalesce(fields['hostname'], fields['user'], fields['client_ip']) AS value FROM siem_events)),
m AS (SELECT x, coalesce(max(CASE WHEN ioc = x THEN ioc END), min(CASE WHEN length(x) >= 4 AND (contains(x, ioc) OR contains(ioc, x)) THEN ioc END)) AS ioc FROM (SELECT DISTINCT x FROM v WHERE x <> ''), i GROUP BY 1)
SELECT reputation, count(*) AS n FROM v LEFT JOIN m USING (x) LEFT JOIN i USING (ioc) GROUP BY 1""")
def ioc_enrich_exact_then_substring(spark, d):
    v = table(spark, d, "siem_events").select("event_id", F.coalesce(*[F.element_at("fields", F.lit(k)) for k in ("hostname", "user", "client_ip")]).alias("value"))
    out = intel.lookup_indicators(v, "value", spark.createDataFrame(IOCS, "ioc string, reputation string"))
    return out.groupBy("reputation").agg(F.count("*").alias("n"))


_CORR = "SELECT l_partkey, count(DISTINCT l_suppkey) AS node_count, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen, (CASE WHEN count(DISTINCT l_suppkey) >= 3 THEN 0.9 WHEN count(DISTINCT l_suppkey) >= 2 THEN 0.75 ELSE 0.5 END)::DOUBLE AS confidence FROM lineitem GROUP BY 1"


@query(f"SELECT * FROM ({_CORR}) WHERE node_count >= 2")
def ioc_cross_node_correlation(spark, d):
    return intel.correlate_across_nodes(table(spark, d, "lineitem"), "l_partkey", "l_suppkey", "l_shipdate", 2)


@query(f"SELECT * FROM ({_CORR}) ORDER BY node_count DESC, confidence DESC, l_partkey LIMIT 100")
def top_correlations(spark, d):
    return intel.top_correlations(intel.correlate_across_nodes(table(spark, d, "lineitem"), "l_partkey", "l_suppkey", "l_shipdate"), "l_partkey")


@query("SELECT CASE WHEN length(key_hash) = 64 AND regexp_matches(key_hash, '^[0-9a-f]+$') THEN true ELSE false END AS valid, CASE WHEN regexp_matches(key_hash, '^[0-9a-fA-F]+$') AND length(key_hash) = 64 THEN 'sha256' ELSE 'unknown' END AS kind, count(*) AS n FROM dedup_keys GROUP BY 1, 2")
def indicator_kinds(spark, d):
    k = F.col("key_hash")
    return table(spark, d, "dedup_keys").groupBy(I.is_hash(k).alias("valid"), I.indicator_kind(k).alias("kind")).agg(F.count("*").alias("n"))


@query("WITH l AS (SELECT 'd' || doc_id AS place, text FROM documents UNION ALL SELECT 'k' || row_no, 'seen ' || key_hash || ' twice' FROM dedup_keys), t AS (SELECT place, unnest(regexp_split_to_array(lower(text), '\\s+')) AS w FROM l) SELECT DISTINCT place, w AS indicator FROM t WHERE regexp_matches(w, '^[0-9a-f]+$') AND length(w) IN (32, 40, 64)")
def extract_indicators(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("place"), "text")
    keys = table(spark, d, "dedup_keys").select(F.concat(F.lit("k"), F.col("row_no").cast("string")).alias("place"), F.concat(F.lit("seen "), F.col("key_hash"), F.lit(" twice")).alias("text"))
    return docs.union(keys).select("place", F.explode(I.hash_tokens(F.col("text"))).alias("indicator"))


@query("SELECT (sum(x) FILTER (x > 0)) AS score, CAST(count(*) AS BIGINT) AS n, CASE WHEN event_type = 'error' THEN 'malicious' WHEN event_type = 'click' THEN 'suspicious' ELSE 'clean' END AS verdict FROM (SELECT event_type, CAST(event_id % 10 AS BIGINT) AS x FROM events) GROUP BY event_type = 'error', event_type = 'click', verdict")
def provider_verdicts(spark, d):
    e = table(spark, d, "events").withColumn("x", (F.col("event_id") % 10).cast("long"))
    score = F.when(F.col("event_type") == "error", 80).when(F.col("event_type") == "click", 30).otherwise(5)
    return e.groupBy(I.abuse_verdict(score).alias("verdict")).agg(F.sum("x").alias("score"), F.count("*").alias("n"))


@query(f"SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events) WHERE r = 1 AND epoch_us(ts) + 3600000000 * (user_id % 48) > epoch_us(TIMESTAMP '2024-01-30')")
def cache_fresh(spark, d):
    c = table(spark, d, "events").select("user_id", "event_id", "ts", (F.col("user_id") % 48 * 3600).alias("ttl_s"))
    return intel.fresh_entries(c, "user_id", "ts", "ttl_s", F.lit("2024-01-30").cast("timestamp_ntz")).select("user_id", "event_id")


@query("SELECT p_partkey, CASE WHEN contains(p_name, 'red') THEN 'red' WHEN contains(p_name, 'ring') THEN 'ring' WHEN contains(p_name, 'bolt') THEN 'bolt' END AS pattern FROM part")
def first_pattern_match(spark, d):
    pats = spark.createDataFrame([("red", 1), ("ring", 2), ("bolt", 3)], "pattern string, rank int")
    return intel.first_pattern(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", pats, "pattern", "rank").select("p_partkey", "pattern")


TECHNIQUES = [("T1110", "Brute Force", "guessing", ["Credential Access"]), ("T1059", "Command and Scripting Interpreter", "scripts", ["Execution"]), ("T1003", "OS Credential Dumping", "memory", ["Credential Access"])]


@query("SELECT id, how FROM (VALUES ('T1110', 'tactic'), ('T1003', 'tactic'), ('T1059', 'search')) AS t(id, how)")
def technique_lookup(spark, d):
    t = spark.createDataFrame(TECHNIQUES, "id string, name string, description string, tactics array<string>")
    return intel.techniques_by_tactic(t, "credential access").select("id", F.lit("tactic").alias("how")).union(intel.search_techniques(t, "script").select("id", F.lit("search").alias("how")))


# ---------------------------------------------------------------- compliance

CHECKS = [
    {"id": "c1", "condition": "all", "rules": ["f:/etc/kernel -> r:^[56]\\.", "not c:lsmod -> r:dccp"]},
    {"id": "c2", "condition": "any", "rules": ["c:lsmod -> r:process", "f:/etc/none"]},
    {"id": "c3", "condition": "none", "rules": ["f:/etc/kernel -> r:^4\\."]},
]


def check_results(spark, d) -> DataFrame:
    a = table(spark, d, "edr_agents").where(F.col("id").isNotNull())
    fact = lambda kind, target, content: a.select(F.col("id").alias("host"), F.lit(kind).alias("kind"), F.lit(target).alias("target"), F.lit("").alias("name"), F.col(content).alias("content"))
    return compliance.evaluate_checks(CHECKS, fact("f", "/etc/kernel", "kernel_version").union(fact("c", "lsmod", "monitors")))


_CHECK_SQL = r"""
h AS (SELECT id AS host, bool_or(regexp_matches(kernel_version, '^[56]\.')) AS a, coalesce(bool_or(contains(monitors, 'process')), false) AS b, coalesce(bool_or(regexp_matches(kernel_version, '^4\.')), false) AS c FROM edr_agents WHERE id IS NOT NULL GROUP BY 1),
r AS (SELECT host, 'c1' AS check_id, coalesce(a, false) AS passed FROM h UNION ALL SELECT host, 'c2', b FROM h UNION ALL SELECT host, 'c3', NOT c FROM h)"""


@query(f"WITH {_CHECK_SQL} SELECT check_id, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, count(*) AS total, printf('%.1f%%', count(*) FILTER (passed) * 100.0 / count(*)) AS score FROM r GROUP BY 1")
def policy_checks(spark, d):
    return compliance.policy_score(check_results(spark, d), ["check_id"])


_CONTROLS = [("cis", "1.1", "kernel"), ("cis", "1.2", "modules"), ("cis", "1.3", "kernel"), ("gdpr", "Art.32", "security"), ("gdpr", "Art.33", "security")]
_MAP = [("c1", "cis", "1.1"), ("c2", "cis", "1.2"), ("c3", "cis", "1.3"), ("c3", "gdpr", "Art.32")]


def framework_report(spark, d) -> DataFrame:
    per_check = check_results(spark, d).groupBy("check_id").agg((F.count_if("passed") * 10 >= F.count("*") * 3).alias("passed"))
    mapped = per_check.join(spark.createDataFrame(_MAP, "check_id string, framework string, control_id string"), "check_id")
    manual = spark.createDataFrame([("gdpr", "Art.33", "manual_pass")], "framework string, control_id string, manual_status string")
    return compliance.control_report(spark.createDataFrame(_CONTROLS, "framework string, control_id string, category string"), mapped, manual)


_REPORT_SQL = f"""WITH {_CHECK_SQL}, p AS (SELECT check_id, count(*) FILTER (passed) * 10 >= count(*) * 3 AS passed FROM r GROUP BY 1),
m(check_id, framework, control_id) AS (VALUES ('c1','cis','1.1'), ('c2','cis','1.2'), ('c3','cis','1.3'), ('c3','gdpr','Art.32')), c(framework, control_id, category) AS (VALUES ('cis','1.1','kernel'), ('cis','1.2','modules'), ('cis','1.3','kernel'), ('gdpr','Art.32','security'), ('gdpr','Art.33','security')),
o AS (SELECT framework, control_id, bool_and(passed) AS ok FROM p JOIN m USING (check_id) GROUP BY 1, 2),
report AS (SELECT framework, control_id, category, CASE WHEN ok THEN 'pass' WHEN NOT ok THEN 'fail' WHEN control_id = 'Art.33' THEN 'manual_pass' ELSE 'not_covered' END AS status FROM c LEFT JOIN o USING (framework, control_id))"""


@query(f"{_REPORT_SQL} SELECT * FROM report")
def compliance_report(spark, d):
    return framework_report(spark, d)


@query(f"{_REPORT_SQL} SELECT framework, category, count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (status = 'fail') AS failed, count(*) FILTER (status = 'not_covered') AS not_covered, count(*) AS total, round(count(*) FILTER (status = 'pass') * 100.0 / count(*), 6) AS score FROM report GROUP BY 1, 2")
def category_breakdown(spark, d):
    return compliance.coverage(framework_report(spark, d), ["framework", "category"])


@query("""WITH s AS (SELECT event_type, CAST(ts AS DATE) AS day, max(value) AS score FROM events GROUP BY 1, 2) SELECT event_type, day, score, round(score - lag(score) OVER (PARTITION BY event_type ORDER BY day), 4) AS delta FROM s WHERE day >= DATE '2024-01-15'""")
def compliance_trend(spark, d):
    s = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.max("value").alias("score"))
    return compliance.score_trend(s, ["event_type"], "day", "score", F.lit("2024-01-15").cast("date")).withColumn("delta", F.round("delta", 4))


# ---------------------------------------------------------------- store

_T = "try_cast(replace(replace({}, 'T', ' '), 'Z', '') AS TIMESTAMP)"


@query("SELECT count(*) AS total, count(*) FILTER (lower(trim(status)) = 'completed') AS completed, round(count(*) FILTER (lower(trim(status)) = 'completed') * 100.0 / count(*), 6) AS completed_pct FROM investigations")
def status_dashboard(spark, d):
    return store.status_summary(table(spark, d, "investigations"), "status", "completed")


@query("SELECT CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' WHEN confidence IS NOT NULL THEN 'low' ELSE 'none' END AS bucket, count(*) AS n FROM investigations GROUP BY 1")
def confidence_buckets(spark, d):
    return store.confidence_buckets(table(spark, d, "investigations"), "confidence")


@query(f"SELECT DISTINCT id, max({_T.format('updated_at')}) OVER (PARTITION BY id) AS updated FROM investigations WHERE id IS NOT NULL")
def latest_per_entity(spark, d):
    return store.newest_version(table(spark, d, "investigations"), "id", "updated_at").select("id", text_instant("updated_at").alias("updated"))


@query("SELECT event_id, ts, value FROM events ORDER BY ts DESC, event_id LIMIT 50")
def top_events(spark, d):
    return store.recent(table(spark, d, "events").select("event_id", "ts", "value"), "ts", "event_id", 50)


@query("SELECT id, title FROM cases WHERE contains(lower(coalesce(title, '')), 'plant') OR contains(lower(coalesce(description, '')), 'plant')")
def search_ilike(spark, d):
    return store.search(table(spark, d, "cases"), "PLANT", ["title", "description"]).select("id", "title")


@query("SELECT id, status, severity FROM cases WHERE severity = 'high'")
def filtered_cases(spark, d):
    return store.filtered(table(spark, d, "cases"), severity="high", status=None).select("id", "status", "severity")


@query(f"SELECT id, agent, action FROM tasks WHERE status = 'pending' ORDER BY {_T.format('created_at')} NULLS LAST, id LIMIT 10")
def claim_tasks(spark, d):
    return store.claim_oldest(table(spark, d, "tasks"), "status", "pending", "created_at", "id", 10).select("id", "agent", "action")


@query(f"SELECT id, CASE WHEN coalesce(TIMESTAMP '{NOW}' - {_T.format('last_heartbeat')} <= INTERVAL 90 DAY, false) THEN 'online' ELSE 'offline' END AS node_status FROM edr_agents")
def stale_nodes(spark, d):
    return store.node_status(table(spark, d, "edr_agents"), "last_heartbeat", now(), 90 * 24 * HOUR).select("id", "node_status")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND (o_custkey % 10 = 0 OR o_orderdate <= TIMESTAMP '1996-01-01')")
def due_hunts(spark, d):
    h = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "active").alias("status"), F.when(F.col("o_custkey") % 10 != 0, F.col("o_orderdate")).alias("next_run"))
    return store.due(h, "next_run", "status", F.lit("1996-01-01").cast("timestamp_ntz")).select("o_orderkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS balance, c_nationkey AS created FROM customer UNION ALL SELECT -c_custkey, c_acctbal + 1, c_nationkey + 100 FROM customer WHERE c_custkey % 10 = 0 AND c_custkey > 0")
def upsert_keep_created(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("created"))
    new = c.where("c_custkey % 2 = 0").select("c_custkey", (F.col("balance") + 1).alias("balance"), (F.col("created") + 100).alias("created"))
    more = c.where("c_custkey % 10 = 0 AND c_custkey > 0").select((-F.col("c_custkey")).alias("c_custkey"), (F.col("balance") + 1).alias("balance"), (F.col("created") + 100).alias("created"))
    return store.upsert(c, new.union(more), "c_custkey", ["created"])


@query("SELECT DISTINCT task_id, agent FROM results WHERE task_id IS NOT NULL AND agent IS NOT NULL")
def link_once(spark, d):
    return store.link_once(table(spark, d, "results").select("task_id", "agent"), "task_id", "agent")


@query("SELECT event_id, severity, json_extract_string(CASE WHEN json_valid(raw) THEN raw END, '$.msg') AS msg FROM siem_events WHERE severity >= 3 AND starts_with(source, 's')")
def edr_event_filters(spark, d):
    e = table(spark, d, "siem_events").where((F.col("severity") >= 3) & F.col("source").startswith("s"))
    return e.select("event_id", "severity", F.get_json_object("raw", "$.msg").alias("msg"))


@query("SELECT row_no FROM dedup_keys ORDER BY seen_at DESC, row_no DESC LIMIT 1000")
def queue_evict_oldest(spark, d):
    return store.evict_oldest(table(spark, d, "dedup_keys"), "seen_at", "row_no", 1000).select("row_no")


@query(f"SELECT case_id, id, row_number() OVER (PARTITION BY case_id ORDER BY {_T.format('created_at')} NULLS FIRST, id) AS step FROM (SELECT DISTINCT case_id, id, created_at FROM case_events)")
def incident_timeline(spark, d):
    e = table(spark, d, "case_events").select("case_id", "id", "created_at").distinct()
    return store.timeline(e, "case_id", text_instant("created_at"), "id").select("case_id", "id", F.col("step").cast("long").alias("step"))


@query("SELECT count(*) AS messages, sum(length(event_data)) AS characters, count(*) FILTER (event_data IS NULL) AS empty FROM event_queue")
def queue_guards(spark, d):
    return table(spark, d, "event_queue").agg(F.count("*").alias("messages"), F.sum(F.length("event_data")).alias("characters"), F.count_if(F.col("event_data").isNull()).alias("empty"))


# ---------------------------------------------------------------- playbooks and scores


@query("""
WITH r AS (SELECT task_id, CASE WHEN json_valid(output) AND starts_with(ltrim(output), '{') THEN output END AS o FROM results)
SELECT task_id, round(avg(CASE WHEN coalesce(json_extract_string(o, '$.error'), '') LIKE '%not configured%' THEN 0 WHEN coalesce(json_extract_string(o, '$.error'), '') <> '' THEN 0.1 ELSE 0.5 END), 6) AS confidence, count(*) AS results FROM r WHERE o IS NOT NULL GROUP BY 1""")
def confidence_score(spark, d):
    return playbook.confidence(table(spark, d, "results"), "task_id", "output")


@query("""
SELECT step_no, event, step, count(*) AS n FROM (SELECT unnest([{'step_no': 0, 'event': 'playbook_started', 'step': ''}, {'step_no': 1, 'event': 'step_completed', 'step': 'intel.lookup'}, CASE WHEN c_nationkey = 3 THEN {'step_no': 2, 'event': 'step_completed', 'step': 'case.open'} ELSE {'step_no': 2, 'event': 'step_skipped', 'step': 'case.open'} END,
  {'step_no': 3, 'event': 'step_failed_optional', 'step': 'mail.send'}, {'step_no': 4, 'event': 'playbook_completed', 'step': ''}], recursive := true) FROM customer) GROUP BY 1, 2, 3""")
def playbook_timeline(spark, d):
    reg = {
        "intel.lookup": lambda s, p: s.select("c_custkey", F.when(F.col("c_nationkey") == 3, "malicious").otherwise("clean").alias("reputation")),
        "case.open": lambda s, p: s.select("c_custkey", p["title"].alias("title")),
    }
    steps = [
        playbook.Step("intel", "lookup", {"ip": "${input.c_name}"}),
        playbook.Step("case", "open", {"title": "Seen ${input.c_name}: ${outputs.intel.lookup.reputation}"}, "${outputs.intel.lookup.reputation} == 'malicious'"),
        playbook.Step("mail", "send", optional=True),
    ]
    _, events = playbook.run_playbook(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), "c_custkey", steps, reg)
    return events.groupBy("step_no", "event", "step").agg(F.count("*").alias("n"))


@query("""SELECT id, CASE WHEN contains(lower(intent), 'phish') THEN 'phishing' WHEN contains(lower(intent), 'hash') OR contains(lower(intent), 'sha256') OR contains(lower(intent), 'md5') THEN 'hash-lookup'
  WHEN contains(lower(intent), 'file') OR contains(lower(intent), 'malware') OR contains(lower(intent), 'exe') THEN 'file-analysis' WHEN contains(lower(intent), 'ip') OR contains(lower(intent), 'address') THEN 'ip-reputation' WHEN contains(lower(intent), 'url') OR contains(lower(intent), 'link') THEN 'url-scan' ELSE 'hash-lookup' END AS playbook FROM investigations""")
def intent_playbook(spark, d):
    return table(spark, d, "investigations").select("id", playbook.classify_intent(F.col("intent"), [("phish", "phishing")]).alias("playbook"))


# ---------------------------------------------------------------- content


@query("""
SELECT doc_id, rule, CAST(pos - 1 AS INTEGER) AS match_offset FROM (
 SELECT doc_id, 'words' AS rule, least(nullif(instr(lower(text), 'archive'), 0), nullif(instr(lower(text), 'quarantine'), 0)) AS pos FROM documents
 UNION ALL SELECT doc_id, 'both', CASE WHEN instr(lower(text), 'archive') > 0 AND instr(lower(text), 'hash') > 0 THEN least(instr(lower(text), 'archive'), instr(lower(text), 'hash')) END FROM documents) WHERE pos IS NOT NULL""")
def yara_string_scan(spark, d):
    r = [content_scan.ScanRule("words", 3, ("archive", "Quarantine")), content_scan.ScanRule("both", 3, ("archive", "hash"), condition="all")]
    return content_scan.scan_text(table(spark, d, "documents").select("doc_id", "text"), "text", r).select("doc_id", "rule", "match_offset")


def _textual_sql(rule) -> str:
    some = [f"contains(lower(text), lower('{x}'))" if not rule.exact else f"contains(text, '{x}')" for x in (y.replace("'", "''") for y in rule.strings)]
    some += [f"regexp_matches(text, '{x}')" for x in rule.regexes]
    return f"SELECT '{rule.name}' AS rule, doc_id FROM documents WHERE {' OR '.join(some)}"


@query("SELECT rule, count(*) AS n FROM (" + " UNION ALL ".join(_textual_sql(r) for r in content_scan.MATCHER_RULES if r.textual) + ") GROUP BY 1")
def pii_regex_scan(spark, d):
    return content_scan.scan_text(table(spark, d, "documents").select("doc_id", "text"), "text").groupBy("rule").agg(F.count("*").alias("n"))


@query("SELECT rule, count(*) AS n, sum(least_offset) AS offsets FROM (" + " UNION ALL ".join(
    f"SELECT '{r.name}' AS rule, least({', '.join(f"nullif(instr(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), lower('{x}')), 0)" if not r.exact else f"nullif(instr(text, '{x}'), 0)" for x in r.strings)}, NULL) - 1 AS least_offset FROM documents"
    for r in content_scan.SCANNER_RULES if r.textual) + ") WHERE least_offset IS NOT NULL GROUP BY 1")
def scanner_string_rules(spark, d):
    hits = content_scan.scan_text(table(spark, d, "documents").select("doc_id", "text"), "text", content_scan.SCANNER_RULES)
    return hits.groupBy("rule").agg(F.count("*").alias("n"), F.sum("match_offset").alias("offsets"))


@query("SELECT rule, count(*) AS n FROM (" + " UNION ALL ".join(_textual_sql(r) for r in content_scan.MATCHER_RULES if r.textual) + ") GROUP BY 1")
def matcher_content_rules(spark, d):
    """All rules over the contents as bytes; those that need bytes (entropy, executables, ciphers) are compared in tests."""
    hits = content_scan.scan_content(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", [r for r in content_scan.MATCHER_RULES if r.textual])
    return hits.groupBy("rule").agg(F.count("*").alias("n"))


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")
def content_hashes(spark, d):
    t = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", content_scan.file_hashes(F.col("text").cast("binary")).alias("h"))
    return t.select("doc_id", "h.md5", "h.sha1", "h.sha256")


@query("WITH c AS (SELECT doc_id, unnest(list_transform(range(1, length(text) + 1), lambda i: text[i])) AS ch FROM documents WHERE length(text) > 0), k AS (SELECT doc_id, ch, count(*) AS n FROM c GROUP BY 1, 2), t AS (SELECT doc_id, sum(n) AS total FROM k GROUP BY 1) SELECT d.doc_id, round(coalesce(e, 0), 4) AS entropy FROM documents d LEFT JOIN (SELECT doc_id, -sum(n / total * log2(n / total)) AS e FROM k JOIN t USING (doc_id) GROUP BY 1) USING (doc_id)")
def text_entropy(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(I.text_entropy(F.col("text")), 4).alias("entropy"))


@query()
def content_bytes(spark, d):
    """Entropy, XOR and executable analysis of document contents as bytes; no SQL counterpart."""
    return content_scan.scan_bytes(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", {"mz": "4D 5A", "zip": "50 4B ?? 04"})


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

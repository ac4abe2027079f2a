"""Queries over endpoint events, feeds, host facts and rule sets, each over whole tables, with SQL where SQL can express it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions import decoders as D
from emberlog.functions import indicators as I
from emberlog.functions.keys import text_instant
from emberlog.operators import compliance, correlate, host_checks, intel, playbook, rule_sets, rules, snapshots, store
from emberlog.plans import engine_queries as E
from emberlog.session import scratch, table
from emberlog.sources import feeds

QUERIES: dict = {}
SQL: dict[str, str] = {}
HOUR = 3600


def query(sql: str | None = None):
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return wrap


def queue_events(spark, d) -> DataFrame:
    return feeds.edr_events(table(spark, d, "event_queue"), "event_data").where("e IS NOT NULL")


#: The same in SQL: readable objects only.
_J = "j AS (SELECT *, CASE WHEN json_valid(event_data) AND starts_with(ltrim(event_data), '{') THEN event_data END AS o FROM event_queue)"
_S = lambda path: f"json_extract_string(o, '$.{path}')"


# ---------------------------------------------------------------- ingest and feeds


@query(f"WITH {_J} SELECT {_S('id')} AS id, arg_min(agent_id, row_no) AS agent_id, arg_min(coalesce({_S('type')}, ''), row_no) AS event_type, arg_min(coalesce(try_cast({_S('severity')} AS INTEGER), 0), row_no) AS severity FROM j WHERE {_S('id')} <> '' GROUP BY 1")
def edr_event_ingest(spark, d):
    # an absent agent is kept as such: the first row of an id counts whole
    return feeds.ingest_events(table(spark, d, "event_queue").withColumn("agent_id", F.col("agent_id")), "agent_id", "event_data", "row_no").drop("data")


@query(f"""WITH p AS (SELECT CASE WHEN playbook IS NULL THEN '' ELSE 'node-' || (length(playbook) % 3) END AS node_id, id, status, intent, confidence, updated_at FROM investigations WHERE id IS NOT NULL)
SELECT DISTINCT ON (id) node_id, id, status FROM p WHERE node_id <> '' ORDER BY id, updated_at DESC NULLS LAST, node_id DESC, status DESC NULLS LAST""")
def edge_push(spark, d):
    i = table(spark, d, "investigations").where("id IS NOT NULL")
    body = F.to_json(F.struct(F.when(F.col("playbook").isNull(), "").otherwise(F.concat(F.lit("node-"), (F.length("playbook") % 3).cast("string"))).alias("node_id"), F.struct("id", "status", "intent", "confidence").alias("investigation")))
    return feeds.accept_pushes(i.select(body.alias("body"), "updated_at"), "body", "updated_at").select("node_id", "id", "status")


@query("""SELECT 'CVE-' || p_partkey AS cve_id, CASE WHEN p_partkey % 4 = 3 THEN 0.0 ELSE p_size / 5.0 END::DOUBLE AS cvss, CASE WHEN p_partkey % 4 = 3 OR p_partkey % 4 = 2 THEN CASE WHEN p_partkey % 4 = 3 THEN 'LOW' WHEN p_size / 5.0 >= 9 THEN 'CRITICAL' WHEN p_size / 5.0 >= 7 THEN 'HIGH' WHEN p_size / 5.0 >= 4 THEN 'MEDIUM' ELSE 'LOW' END ELSE 'V' || CASE p_partkey % 4 WHEN 0 THEN '31' ELSE '30' END END AS severity,
  least(p_size, 10) AS affected, p_name AS description FROM part WHERE p_partkey > 0""")
def nvd_cves(spark, d):
    p = table(spark, d, "part").where("p_partkey > 0")
    k, score = F.col("p_partkey") % 4, (F.col("p_size") / 5.0).cast("string")
    metric = lambda sev: F.concat(F.lit('[{"cvssData":{"baseScore":'), score, F.lit(f',"baseSeverity":{sev}}}}},{{"cvssData":{{"baseScore":1}}}}]'))
    metrics = F.when(k == 0, F.concat(F.lit('{"cvssMetricV31":'), metric('"V31"'), F.lit(',"cvssMetricV2":'), metric("null"), F.lit("}"))).when(k == 1, F.concat(F.lit('{"cvssMetricV30":'), metric('"V30"'), F.lit("}"))).when(k == 2, F.concat(F.lit('{"cvssMetricV2":'), metric("null"), F.lit("}"))).otherwise("{}")
    nodes = F.array_join(F.transform(F.sequence(F.lit(1), F.col("p_size")), lambda i: F.concat(F.lit('{"criteria":"cpe:'), i.cast("string"), F.lit('"}'))), ",")
    body = F.concat(
        F.lit('{"vulnerabilities":[{"cve":{"id":"CVE-'), F.col("p_partkey").cast("string"), F.lit('","descriptions":[{"lang":"de","value":"x"},{"lang":"en","value":"'), F.col("p_name"),
        F.lit('"},{"lang":"fr","value":"y"}],"metrics":'), metrics, F.lit(',"configurations":[{"nodes":[{"cpeMatch":['), nodes, F.lit("]}]}]}}]}"),
    )
    out = feeds.cve_table(feeds.parse_cves(p.select(body.alias("body")), "body"))
    return out.select("cve_id", "cvss", "severity", F.size("affected").cast("long").alias("affected"), "description")


@query("""SELECT p_partkey::VARCHAR AS indicator, p_size % 3 AS malicious, p_size % 5 AS suspicious, p_size % 3 + p_size % 5 + p_size + 7 AS total, CASE WHEN p_size % 3 > 0 THEN 'malicious' WHEN p_size % 5 > 0 THEN 'suspicious' ELSE 'clean' END AS reputation FROM part WHERE p_partkey % 10 <> 0
UNION ALL SELECT p_partkey::VARCHAR, 0, 0, 0, 'unknown' FROM part WHERE p_partkey % 10 = 0""")
def engine_reports(spark, d):
    p = table(spark, d, "part")
    body = F.concat(F.lit('{"data":{"attributes":{"last_analysis_stats":{"malicious":'), (F.col("p_size") % 3).cast("string"), F.lit(',"suspicious":'), (F.col("p_size") % 5).cast("string"), F.lit(',"undetected":'), F.col("p_size").cast("string"), F.lit(',"harmless":7}}}}'))
    rows = p.select(F.col("p_partkey").cast("string").alias("indicator"), F.when(F.col("p_partkey") % 10 != 0, body).otherwise("not found").alias("body"))
    return feeds.parse_engine_report(rows, "indicator", "body").select("indicator", "malicious", "suspicious", "total", "reputation")


_V = "coalesce(fields['hostname'], fields['user'], fields['client_ip'], fields['path'])"


@query(f"""WITH v AS (SELECT trim({_V}) AS v, severity AS s FROM siem_events WHERE {_V} IS NOT NULL)
SELECT CASE WHEN length(v) IN (32, 40, 64) THEN CASE WHEN regexp_matches(v, '^[0-9A-Fa-f]+$') THEN 'file' ELSE 'domain' END WHEN contains(v, '/') THEN 'url' WHEN contains(v, '.') AND NOT contains(v, ' ') THEN 'domain' ELSE 'ip' END AS kind,
  CASE WHEN s >= 5 THEN 'malicious' WHEN s >= 2 THEN 'suspicious' ELSE 'unknown' END AS reputation, count(*) AS n, sum(CASE WHEN s >= 5 THEN 0.9 WHEN s >= 2 THEN 0.6 ELSE 0 END)::DOUBLE AS confidence FROM v GROUP BY 1, 2""")
def pulse_reputation(spark, d):
    v = F.coalesce(*[F.element_at("fields", F.lit(k)) for k in ("hostname", "user", "client_ip", "path")])
    e = table(spark, d, "siem_events").where(v.isNotNull()).select(feeds.indicator_route(v).alias("kind"), feeds.pulse_verdict(F.coalesce("severity", F.lit(0))).alias("p"))
    return e.groupBy("kind", F.col("p.reputation").alias("reputation")).agg(F.count("*").alias("n"), F.round(F.sum("p.confidence"), 6).alias("confidence"))


@query(f"WITH {_J}, e AS (SELECT agent_id, try_cast({_S('process.pid')} AS BIGINT) AS pid, {_S('process.name')} AS name, {_S('type')} AS kind, row_no FROM j WHERE {_S('type')} IN ('process_start', 'process_stop')) SELECT agent_id, pid, arg_max(name, row_no) AS name FROM e WHERE pid IS NOT NULL AND agent_id IS NOT NULL GROUP BY 1, 2 HAVING arg_max(kind, row_no) = 'process_start'")
def process_replay(spark, d):
    e = queue_events(spark, d).where("e.type IN ('process_start', 'process_stop') AND e.process.pid IS NOT NULL AND agent_id IS NOT NULL")
    log = e.select("agent_id", F.col("e.process.pid").alias("pid"), F.col("e.process.name").alias("name"), F.col("e.type").alias("kind"), "row_no")
    return feeds.replay_processes(log, ["agent_id", "pid"], "row_no", F.col("kind") == "process_start", ["name"])


@query("SELECT user_id, event_id FROM events WHERE user_id <> 7 AND epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts) BETWEEN 0 AND 86400000000")
def shared_verdicts(spark, d):
    return intel.shared_verdicts(table(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", 7, "ts", F.lit("2024-01-20").cast("timestamp_ntz"), 24 * HOUR).drop("ts")


# ---------------------------------------------------------------- endpoint events

_PORT = "try_cast(json_extract_string(o, '$.network.{0}') AS INTEGER)"
_CONN = f"agent_id, {_S('network.local_ip')} AS local_ip, {_PORT.format('local_port')} AS local_port, {_S('network.remote_ip')} AS remote_ip, {_PORT.format('remote_port')} AS remote_port, {_S('network.protocol')} AS protocol"
_HALF = "row_no <= (SELECT max(row_no) // 2 FROM event_queue)"


@query(f"""WITH {_J}, c AS (SELECT {_CONN}, {_S('type')} = 'net_listen' AS listens, {_HALF} AS early FROM j WHERE {_S('type')} IN ('net_connect', 'net_listen')),
b AS (SELECT DISTINCT * EXCLUDE (listens, early) FROM c WHERE early), a AS (SELECT * EXCLUDE (early, listens), bool_or(listens) AS listens FROM c WHERE NOT early GROUP BY ALL),
new AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE (a.agent_id, a.local_ip, a.local_port, a.remote_ip, a.remote_port, a.protocol) IS NOT DISTINCT FROM (b.agent_id, b.local_ip, b.local_port, b.remote_ip, b.remote_port, b.protocol))),
gone AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE (a.agent_id, a.local_ip, a.local_port, a.remote_ip, a.remote_port, a.protocol) IS NOT DISTINCT FROM (b.agent_id, b.local_ip, b.local_port, b.remote_ip, b.remote_port, b.protocol)))
SELECT * EXCLUDE (listens), 'connect' AS change FROM new WHERE remote_ip NOT IN ('', '*') UNION ALL SELECT * EXCLUDE (listens), 'listen' FROM new WHERE listens UNION ALL SELECT *, 'disconnect' FROM gone WHERE remote_ip NOT IN ('', '*')""")
def connection_diff(spark, d):
    half = table(spark, d, "event_queue").agg(F.floor(F.max("row_no") / 2)).first()[0] or 0
    n = F.col("e.network")
    c = queue_events(spark, d).where("e.type IN ('net_connect', 'net_listen')").select("row_no", "agent_id", *[n[k].alias(k) for k in snapshots.CONNECTION], F.when(F.col("e.type") == "net_listen", "LISTEN").otherwise("ESTABLISHED").alias("state"))
    return snapshots.diff_connections(c.where(F.col("row_no") <= half).drop("row_no"), c.where(F.col("row_no") > half).drop("row_no"), ["agent_id"])


@query(f"WITH {_J}, e AS (SELECT agent_id, {_S('process.pid')} AS pid, {_S('process.name')} AS name, {_S('type')} AS kind FROM j) SELECT DISTINCT agent_id, try_cast(pid AS BIGINT) AS pid FROM e WHERE kind = 'process_start' AND name <> '' AND NOT EXISTS (SELECT 1 FROM e s WHERE s.kind = 'process_stop' AND s.agent_id = e.agent_id AND s.pid = e.pid)")
def hidden_processes(spark, d):
    e = queue_events(spark, d).select("agent_id", F.col("e.process.pid").alias("pid"), F.col("e.process.name").alias("name"), F.col("e.type").alias("kind"))
    return host_checks.hidden_processes(e.where("kind = 'process_start'"), e.where("kind = 'process_stop'"), ["agent_id", "pid"], "name").select("agent_id", "pid")


_WORDS = "[" + ", ".join(f"'{w.lower()}'" for w in I.PROCESS_WORDS) + "]"


@query(f"""WITH {_J}, n AS (SELECT coalesce({_S('process.name')}, {_S('process.cmdline')}) AS name FROM j UNION ALL SELECT target FROM edr_actions UNION ALL SELECT raw FROM siem_events UNION ALL SELECT name FROM ({E._PROC_SQL}))
SELECT name, count(*) AS n FROM n WHERE len(list_filter({_WORDS}, lambda w: contains(lower(name), w))) > 0 GROUP BY 1""")
def suspicious_processes(spark, d):
    names = queue_events(spark, d).select(F.coalesce("e.process.name", "e.process.cmdline").alias("name")).union(table(spark, d, "edr_actions").select("target")).union(table(spark, d, "siem_events").select("raw")).union(E.processes(spark, d).select("name"))
    return names.where(I.suspicious_process(F.col("name"))).groupBy("name").agg(F.count("*").alias("n"))


@query(f"WITH {_J} SELECT {_PORT.format('remote_port')} AS port, count(*) AS n FROM j WHERE {_PORT.format('remote_port')} IN (445, 139, 135, 3389, 22, 23) GROUP BY 1")
def suspicious_connections(spark, d):
    port = F.col("e.network.remote_port")
    return queue_events(spark, d).where(I.suspicious_port(port)).groupBy(port.alias("port")).agg(F.count("*").alias("n"))


@query("SELECT CASE " + " ".join(f"WHEN contains(line, ':{p}') THEN '{p}'" for p in I.MALWARE_PORTS) + " END AS port, count(*) AS n FROM (SELECT 'tcp LISTEN 0 5 0.0.0.0:' || (o_orderkey % 9000) AS line FROM orders WHERE o_orderkey % 2 = 0) WHERE port IS NOT NULL GROUP BY 1")
def malware_ports(spark, d):
    o = table(spark, d, "orders")
    line = F.concat(F.lit("tcp "), F.when(F.col("o_orderkey") % 2 == 0, "LISTEN").otherwise("ESTAB"), F.lit(" 0 5 0.0.0.0:"), (F.col("o_orderkey") % 9000).cast("string"))
    port = host_checks.malware_port(line)
    return o.where(port.isNotNull()).groupBy(port.alias("port")).agg(F.count("*").alias("n"))


@query(f"""WITH {_J}, e AS (SELECT coalesce({_S('annotations.yara_rule')}, {_S('annotations.correlation')}, {_S('type')}) AS rule_name, coalesce({_S('process.name')}, {_S('file.path')}, 'unknown') AS process_name FROM j)
SELECT rule_name, process_name, count(*) AS dismissals, count(*) >= 10 AS throttled FROM e WHERE rule_name IS NOT NULL GROUP BY 1, 2""")
def dismissal_counters(spark, d):
    ok = F.try_parse_json("event_data").isNotNull() & F.ltrim("event_data").startswith("{")
    return store.dismissals(table(spark, d, "event_queue").where(ok), "event_data")


@query(f"WITH {_J} SELECT {_S('file.path')} AS path, arg_max({_S('file.hash')}, row_no) AS hash FROM j WHERE {_S('file.path')} IS NOT NULL AND {_S('file.hash')} IS NOT NULL GROUP BY 1")
def fim_baseline(spark, d):
    f = queue_events(spark, d).where("e.file.path IS NOT NULL AND e.file.hash IS NOT NULL")
    last = f.groupBy(F.col("e.file.path").alias("path")).agg(F.max_by("e.file.hash", "row_no").alias("hash"))
    return store.replace_all(last, scratch(spark, "baseline"))


@query("""WITH v AS (SELECT DISTINCT ON (id) * FROM edr_actions WHERE id IS NOT NULL ORDER BY id, try_cast(replace(replace(completed_at, 'T', ' '), 'Z', '') AS TIMESTAMP) DESC NULLS LAST)
SELECT CASE action_type WHEN 'isolate_host' THEN 'release_host' WHEN 'quarantine_file' THEN 'restore_file' END AS action, count(*) > 0 AS some FROM v WHERE action_type IN ('isolate_host', 'quarantine_file') AND lower(trim(status)) = 'completed' GROUP BY 1""")
def action_rollbacks(spark, d):
    r = store.rollbacks(table(spark, d, "edr_actions"), "id", "action_type", "target", "status", "completed_at")
    return r.groupBy("action").agg((F.count("*") > 0).alias("some"))


@query(f"""WITH {_J}, e AS (SELECT row_no, CASE WHEN {_S('type')} IN ('process_create', 'process_terminate') THEN 2 WHEN try_cast({_S('severity')} AS INTEGER) >= 7 THEN 3 ELSE 1 END AS priority FROM j WHERE o IS NOT NULL)
SELECT row_no, CAST(priority AS INTEGER) AS priority, (row_number() OVER (PARTITION BY priority ORDER BY row_no) - 1) // CASE priority WHEN 3 THEN 3 WHEN 2 THEN 2 ELSE 1 END AS turn FROM e""")
def priority_drain(spark, d):
    e = queue_events(spark, d).select("row_no", F.when(F.col("e.severity") >= 7, "alert").otherwise(F.col("e.type")).alias("kind"), F.col("e.severity").alias("severity"))
    out = correlate.drain_order(e, correlate.event_priority(F.col("kind"), F.col("severity")), "row_no", "row_no")
    return out.select("row_no", "priority", "turn")


@query(f"""WITH {_J}, k AS (SELECT CASE WHEN try_cast({_S('process.pid')} AS BIGINT) <> 0 THEN 'proc' WHEN {_S('file.path')} IS NOT NULL THEN 'file' WHEN {_S('network.remote_ip')} IS NOT NULL THEN 'net' ELSE 'ts' END AS kind,
  CASE WHEN try_cast({_S('process.pid')} AS BIGINT) <> 0 THEN 'proc:' || {_S('process.pid')} || ':' || {_S('type')} WHEN {_S('file.path')} IS NOT NULL THEN 'file:' || {_S('file.path')} || ':' || {_S('type')}
    WHEN {_S('network.remote_ip')} IS NOT NULL THEN 'net:' || {_S('network.remote_ip')} || ':' || coalesce({_S('network.remote_port')}, '0') || ':' || coalesce({_S('network.protocol')}, '') || ':' || {_S('type')} ELSE 'ts' END AS key FROM j WHERE {_S('type')} IS NOT NULL)
SELECT kind, count(*) - count(DISTINCT key) AS hits, count(DISTINCT key) AS misses, round((count(*) - count(DISTINCT key)) / count(*), 6) AS hit_ratio FROM k WHERE kind <> 'ts' GROUP BY 1""")
def dedup_hit_ratio(spark, d):
    e = queue_events(spark, d).where("e.type IS NOT NULL")
    g = lambda p: F.col(f"e.{p}")
    key = correlate.dedup_key(g("type"), g("process.pid"), g("file.path"), g("network.remote_ip"), g("network.remote_port"), g("network.protocol"), text_instant(g("timestamp")))
    per = e.groupBy(key.alias("key")).agg(F.count("*").alias("n")).withColumn("kind", F.split("key", ":")[0]).where("kind <> 'ts'")
    n = per.groupBy("kind").agg(F.sum(F.col("n") - 1).alias("hits"), F.count("*").alias("misses"))
    return n.withColumn("hit_ratio", F.round(F.col("hits") / (F.col("hits") + F.col("misses")), 6))


# ---------------------------------------------------------------- host checks


def host_facts(spark, d) -> DataFrame:
    """Facts of hosts out of the tables at hand: units and modules of actions' targets, cron lines of raw events, mounts and maps."""
    a, s = table(spark, d, "edr_actions"), table(spark, d, "siem_events")
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("unit", "module", "task")]), (F.length("target") % 3 + 1).cast("int"))
    lines = F.element_at(F.array(*[F.lit(k) for k in ("cron", "maps", "environ", "socket", "hidden")]), (F.col("event_id") % 5 + 1).cast("int"))
    text = F.when(F.col("event_id") % 5 == 1, F.concat(F.lit("7f-8f rwxp 0 /memfd:"), F.col("source"), F.lit(" [vdso]"))).when(F.col("event_id") % 5 == 3, F.concat(F.lit("LISTEN *:"), (F.col("event_id") % 7000).cast("string"))).otherwise(F.col("raw"))
    return a.select(F.col("agent_id").alias("host"), kinds.alias("kind"), F.col("target").alias("content")).unionByName(s.select(F.col("source").alias("host"), lines.alias("kind"), text.alias("content"))).where("host IS NOT NULL")


_FACTS = """f AS (SELECT agent_id AS host, ['unit', 'module', 'task'][length(target) % 3 + 1] AS kind, target AS content FROM edr_actions WHERE agent_id IS NOT NULL
UNION ALL SELECT source, ['cron', 'maps', 'environ', 'socket', 'hidden'][event_id % 5 + 1], CASE WHEN event_id % 5 = 1 THEN '7f-8f rwxp 0 /memfd:' || source || ' [vdso]' WHEN event_id % 5 = 3 THEN 'LISTEN *:' || (event_id % 7000) ELSE raw END FROM siem_events WHERE source IS NOT NULL),
l AS (SELECT *, lower(content) AS low FROM f WHERE content IS NOT NULL),
h AS (SELECT host, 'hidden-process' AS "check" FROM l WHERE kind = 'hidden'
UNION ALL SELECT host, 'suspicious-kernel-module' FROM l WHERE kind = 'module' AND (contains(low, 'rootkit') OR contains(low, 'sneaky') OR contains(low, 'hideproc') OR contains(low, 'kdmapper'))
UNION ALL SELECT host, 'process-hijacking' FROM l WHERE kind = 'environ' AND contains(content, 'LD_PRELOAD=')
UNION ALL SELECT host, 'suspicious-memory' FROM l WHERE kind = 'maps' AND contains(content, '[vdso]') AND contains(content, 'rwx')
UNION ALL SELECT host, 'fileless-malware' FROM l WHERE kind = 'maps' AND contains(content, 'memfd:')
UNION ALL SELECT host, 'persistence-mechanisms' FROM l WHERE (kind = 'cron' AND (contains(low, 'curl') OR contains(low, 'wget') OR contains(low, 'bash -c') OR contains(low, 'base64') OR contains(low, 'chmod +x'))) OR (kind = 'unit' AND contains(low, 'update') AND NOT contains(low, 'unattended'))
  OR (kind = 'task' AND (contains(low, 'updater') OR contains(low, 'systemupdate') OR contains(low, 'securityscan') OR contains(low, 'windowsupdate')))
UNION ALL SELECT host, 'common-malware-ports' FROM l WHERE kind = 'socket' AND regexp_matches(content, ':(4444|5555|666[6-9]|1337|2332|31337|44344)'))"""


@query(f"""WITH {_FACTS} SELECT a.host, c."check", CAST(c.severity AS INTEGER) AS severity, CASE WHEN n > 0 THEN 'suspicious' ELSE 'clean' END AS status, coalesce(n, 0) AS findings FROM (SELECT DISTINCT host FROM f) a,
(VALUES {', '.join(f"('{k}', {v})" for k, v in host_checks.SEVERITY.items())}) AS c("check", severity) LEFT JOIN (SELECT host, "check", count(*) AS n FROM h GROUP BY 1, 2) n ON n.host = a.host AND n."check" = c."check" """)
def behaviour_checks(spark, d):
    return host_checks.behaviour_report(host_facts(spark, d))


@query(f"""WITH {_FACTS} SELECT c."check", count(DISTINCT h.host) AS suspicious, (SELECT count(DISTINCT host) FROM f) AS total FROM (VALUES {', '.join(f"('{k}')" for k in host_checks.SEVERITY)}) AS c("check") LEFT JOIN h ON h."check" = c."check" GROUP BY 1""")
def behaviour_summary(spark, d):
    return host_checks.behaviour_summary(host_checks.behaviour_report(host_facts(spark, d)), ["check"])


SIGNATURES = [("plan.xls", "pid"), ("updater", "[0-9]{4}"), ("known", "reason")]


@query(r"""WITH b AS (SELECT id, target, params, regexp_replace(target, '^.*[/\\]', '') AS base FROM edr_actions WHERE target IS NOT NULL)
SELECT CASE WHEN (base = 'plan.xls' AND contains(params, 'pid')) OR (base <> 'plan.xls' AND base <> 'known' AND base <> '' AND (CASE WHEN contains(base, 'known') OR contains('known', base) THEN contains(params, 'reason') WHEN contains(base, 'plan.xls') OR contains('plan.xls', base) THEN contains(params, 'pid') WHEN contains(base, 'updater') OR contains('updater', base) THEN regexp_matches(params, '[0-9]{4}') END)) OR (base = 'known' AND contains(params, 'reason')) THEN 'trojaned' ELSE 'clean' END AS verdict, base, count(*) AS n FROM b GROUP BY 1, 2""")
def trojan_signatures(spark, d):
    a = table(spark, d, "edr_actions").where("target IS NOT NULL").select("id", "target", "params")
    out = host_checks.trojaned(a, "target", "params", spark.createDataFrame(SIGNATURES, "binary string, pattern string"))
    return out.groupBy("verdict", F.element_at(F.split("target", r"[/\\]"), -1).alias("base")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- look-ups, playbooks, compliance


@query("SELECT c_custkey, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey <> 2")
def list_lookup(spark, d):
    lists = table(spark, d, "nation").select(F.when(F.col("n_regionkey") != 2, "nations").otherwise("others").alias("list"), F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("k"))
    return intel.list_lookup(c, "k", lists, "nations", "nation").select("c_custkey", "nation")


@query("SELECT i.id, CASE WHEN i.playbook IN (SELECT playbook FROM investigations GROUP BY 1 HAVING count(*) >= 20) THEN 'run' WHEN i.playbook <> '' THEN 'paused' ELSE 'none' END AS route FROM investigations i")
def alert_playbooks(spark, d):
    i = table(spark, d, "investigations").select("id", "playbook")
    return playbook.route(i, "playbook", i.groupBy("playbook").count().where("count >= 20")).select("id", "route")


@query("""SELECT status, event, count(*) AS n FROM (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'completed' WHEN c_custkey % 3 = 0 THEN 'completed' WHEN c_custkey % 3 = 1 THEN 'denied' ELSE 'waiting_approval' END AS status,
  unnest(list_filter(['playbook_started', CASE WHEN c_acctbal < 0 THEN 'step_skipped' ELSE 'step_waiting_approval' END, CASE WHEN c_acctbal < 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'step_approved' WHEN c_custkey % 3 = 1 THEN 'step_denied' END,
    CASE WHEN c_acctbal >= 0 AND c_custkey % 3 = 0 THEN 'step_completed' END, CASE WHEN c_acctbal < 0 OR c_custkey % 3 = 0 THEN 'step_completed' END, CASE WHEN c_acctbal < 0 OR c_custkey % 3 = 0 THEN 'playbook_completed' END], lambda x: x IS NOT NULL)) AS event FROM customer) GROUP BY 1, 2""")
def playbook_approvals(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, "1").otherwise("0").alias("rich"))
    said = c.where("c_custkey % 3 < 2").select("c_custkey", F.lit("case.open").alias("step"), F.when(F.col("c_custkey") % 3 == 0, "approved").otherwise("denied").alias("decision"))
    reg = {"case.open": lambda s, p: s.select("c_custkey", F.lit("yes").alias("done")), "mail.send": lambda s, p: s.select("c_custkey", F.lit("sent").alias("mail"))}
    state, events = playbook.run_playbook(c, "c_custkey", [playbook.Step("case", "open", {}, "${input.rich}", wait=True), playbook.Step("mail", "send")], reg, said)
    return events.join(state.select("c_custkey", "status"), "c_custkey").groupBy("status", "event").agg(F.count("*").alias("n"))


@query(E._REPORT_SQL + ", v AS (SELECT CASE WHEN severity >= 4 THEN 'cis' ELSE 'gdpr' END AS framework, CASE WHEN severity >= 4 THEN '1.' || (event_id % 4) ELSE 'Art.32' END AS control_id, event_time FROM siem_events WHERE severity IS NOT NULL) SELECT framework, control_id, status, count(event_time) + count(*) FILTER (v.framework IS NOT NULL AND event_time IS NULL) AS evidence_items, max(event_time) AS last_evidence FROM report LEFT JOIN v USING (framework, control_id) GROUP BY 1, 2, 3".replace("v.framework IS NOT NULL AND event_time IS NULL", "v.control_id IS NOT NULL AND event_time IS NULL"))
def control_evidence(spark, d):
    s, high = table(spark, d, "siem_events").where("severity IS NOT NULL"), F.col("severity") >= 4
    e = s.select(F.when(high, "cis").otherwise("gdpr").alias("framework"), F.when(high, F.concat(F.lit("1."), (F.col("event_id") % 4).cast("string"))).otherwise("Art.32").alias("control_id"), F.col("event_time").alias("collected_at"))
    return compliance.with_evidence(E.framework_report(spark, d), e).select("framework", "control_id", "status", "evidence_items", "last_evidence")


@query("SELECT check_id, framework, control_id FROM (VALUES ('c1','cis','1.1'), ('c1','cis','1.2'), ('c1','gdpr','Art.32'), ('c2','cis','1.2')) AS t(check_id, framework, control_id) JOIN (SELECT count(*) AS n FROM region) r ON n > 0")
def check_mappings(spark, d):
    some = table(spark, d, "region").agg(F.count("*").alias("n")).where("n > 0").select(F.explode(F.array(F.struct(F.lit("c1").alias("check_id"), F.expr("map('cis', array('1.1', '1.2'), 'gdpr', array('Art.32'))").alias("m")), F.struct(F.lit("c2").alias("check_id"), F.expr("map('cis', array('1.2'))").alias("m")))).alias("x")).select("x.*")
    return compliance.explode_mappings(some, "m").select("check_id", "framework", "control_id")


# ---------------------------------------------------------------- rules, floods, order


def _service_sql() -> str:
    values = ", ".join(f"('{s}')" for s in rule_sets.SERVICES)
    arms = " UNION ALL ".join(f"SELECT upper(svc || '_{n}') AS rule_id FROM l JOIN s ON starts_with(m, svc) WHERE regexp_matches(substr(m, length(svc) + 1), '^.*{w}')" for n, w, *_ in rule_sets.OUTCOMES)
    return f"WITH l AS (SELECT lower(raw) AS m FROM siem_events WHERE raw IS NOT NULL UNION ALL SELECT lower(regexp_replace(raw, '^.*? ', '')) FROM raw_lines WHERE raw IS NOT NULL), s(svc) AS (VALUES {values}) SELECT rule_id, count(*) AS n FROM ({arms}) GROUP BY 1"


@query(_service_sql())
def service_rule_set(spark, d):
    """Hundreds of message rules in one pass."""
    lines = table(spark, d, "siem_events").select("raw").union(table(spark, d, "raw_lines").select(F.regexp_replace("raw", r"(?d)^.*? ", "")))
    e = lines.where("raw IS NOT NULL").select(F.array().cast("array<string>").alias("tags"), F.create_map(F.lit("message"), F.lower("raw")).alias("fields"), F.lit(0).alias("severity"))
    return rules.match_rules(e, rule_sets.service_rules()).groupBy("rule_id").agg(F.count("*").alias("n"))


_AUDIT = "WITH j AS (SELECT payload AS p FROM nested_records WHERE json_valid(payload) AND starts_with(ltrim(payload), '{') AND (contains(payload, '\"kind\":\"Event\"') OR contains(payload, '\"kind\": \"Event\"'))), r AS (SELECT coalesce(json_extract_string(p, '$.objectRef.resource') || CASE WHEN coalesce(json_extract_string(p, '$.objectRef.subresource'), '') <> '' THEN '/' || json_extract_string(p, '$.objectRef.subresource') ELSE '' END, '') AS resource, json_extract_string(p, '$.verb') AS verb, json_extract_string(p, '$.responseStatus.code') AS code FROM j WHERE json_extract_string(p, '$.kind') = 'Event' AND coalesce(json_extract_string(p, '$.auditID'), '') <> '')"


@query(_AUDIT + " SELECT rule_id, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{r.rule_id}' AS rule_id FROM r WHERE resource = '{r.condition.split(' == ')[1]}'" for r in rule_sets.cluster_rules() if r.condition.startswith("field:k8s_resource")) + " UNION ALL " + " UNION ALL ".join(f"SELECT '{r.rule_id}' FROM r WHERE verb = '{r.condition.split(' == ')[1]}'" for r in rule_sets.cluster_rules() if r.condition.startswith("field:verb")) + ") GROUP BY 1")
def cluster_rule_set(spark, d):
    e = D.decode_rows(table(spark, d, "nested_records").select("payload"), D.decode_audit(F.col("payload"))).select("e.tags", "e.fields", "e.severity")
    some = [r for r in rule_sets.cluster_rules() if r.condition.startswith(("field:k8s_resource", "field:verb"))]
    return rules.match_rules(e, some).groupBy("rule_id").agg(F.count("*").alias("n"))


_GATED = "WITH RECURSIVE e AS (SELECT event_id, ts, event_type FROM events WHERE event_type = 'error'), k AS (SELECT min(ts) AS ts FROM e UNION ALL SELECT (SELECT min(e.ts) FROM e WHERE e.ts >= k.ts + INTERVAL 2 HOUR) FROM k WHERE k.ts IS NOT NULL), p AS (SELECT e.* FROM e JOIN k ON e.ts = k.ts)"


@query(_GATED + " SELECT event_id, n AS in_window FROM (SELECT *, count(*) OVER (ORDER BY epoch_us(ts) RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW) AS n FROM p) WHERE n >= 2")
def suppressed_rules(spark, d):
    """Suppression, then the threshold: of the errors that pass a two-hour suppression, those with another within six hours."""
    r = rules.Rule("ERRORS", condition="tag:error", window_s=6 * HOUR, threshold=2, suppress_s=2 * HOUR)
    e = table(spark, d, "events").select("event_id", "ts", F.array("event_type").alias("tags"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("fields"), F.lit(1).alias("severity"))
    return rules.evaluate(e, [r], "ts", "event_id").select("event_id", "in_window")


@query("SELECT event_id, 1::BIGINT AS in_window FROM events WHERE event_type = 'click'")
def rule_no_window(spark, d):
    """A threshold without a window passes every event."""
    r = rules.Rule("CLICKS", condition="tag:click", window_s=0, threshold=5)
    e = table(spark, d, "events").select("event_id", "ts", F.array("event_type").alias("tags"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("fields"), F.lit(1).alias("severity"))
    return rules.evaluate(e, [r], "ts", "event_id").select("event_id", "in_window")


@query("""WITH RECURSIVE t AS (SELECT event_type, CAST(least(greatest(floor(count(*) / 24) * 3, 20), 5000) AS BIGINT) AS th FROM events WHERE ts < TIMESTAMP '2024-01-02' GROUP BY 1),
n AS (SELECT event_id, event_type, ts, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 43199999999 PRECEDING AND CURRENT ROW) AS n FROM events),
o AS (SELECT n.*, coalesce(th, 100) AS th FROM n LEFT JOIN t USING (event_type) WHERE n > coalesce(th, 100)),
k AS (SELECT min(ts) AS ts FROM o UNION ALL SELECT (SELECT min(o.ts) FROM o WHERE o.ts >= k.ts + INTERVAL 36 HOUR) FROM k WHERE k.ts IS NOT NULL)
SELECT event_type, event_id, n AS in_window, th AS flood_threshold FROM o JOIN k USING (ts)""")
def flood_alerts(spark, d):
    """Sliding counts and the latch, with twelve hours for a second."""
    e = table(spark, d, "events")
    t = correlate.flood_thresholds(e.where("ts < TIMESTAMP_NTZ '2024-01-02'"), "event_type", 24)
    return correlate.flood_alerts(e, t, "event_type", "ts", "event_id", 12 * HOUR, 36 * HOUR).select("event_type", "event_id", "in_window", "flood_threshold")


@query()
def throttle_with_idle_reset(spark, d):
    """Errors of a user count as dismissals, clicks are checked; compared with a loop in tests."""
    e = table(spark, d, "events").select(F.lit("r").alias("rule"), F.col("user_id").cast("string").alias("process"), "ts", "event_id", "event_type")
    return correlate.throttled_at(e.where("event_type = 'error'"), e.where("event_type = 'click'"), "rule", "process", "ts", "event_id", 5, 72 * HOUR)


@query("SELECT agent_id, count(*) AS steps, coalesce(bool_and(o), true) AS ordered FROM (SELECT agent_id, born >= lag(born) OVER (PARTITION BY agent_id ORDER BY row_no) AS o FROM (SELECT *, try_cast(replace(replace(created_at, 'T', ' '), 'Z', '') AS TIMESTAMP) AS born FROM event_queue)) GROUP BY 1")
def ordered_steps(spark, d):
    return correlate.in_order(table(spark, d, "event_queue").select("agent_id", "row_no", text_instant("created_at").alias("at")), ["agent_id"], "row_no", "at")


@query("SELECT event_type, event_id, round(list_sum(list_transform(l, lambda x, i: x * pow(0.99, len(l) - i) * (1 + 0.01 * (i - 1)))) / len(l), 6) AS decayed FROM (SELECT event_type, event_id, list(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS l FROM events)")
def entropy_decay(spark, d):
    e = table(spark, d, "events").select("event_type", "event_id", "ts", "value")
    return correlate.decayed_mean(e, "event_type", "value", ["ts", "event_id"], 0.01, 20).select("event_type", "event_id", F.round("decayed", 6).alias("decayed"))


@query(r"""WITH l AS (SELECT raw FROM siem_events UNION ALL SELECT raw FROM raw_lines UNION ALL SELECT payload FROM nested_records),
j AS (SELECT raw, CASE WHEN json_valid(raw) AND starts_with(ltrim(raw), '{') THEN raw END AS o FROM l WHERE raw IS NOT NULL)
SELECT 'auto->' || CASE WHEN o IS NOT NULL AND (contains(raw, '"kind":"Event"') OR contains(raw, '"kind": "Event"')) AND json_extract_string(o, '$.kind') = 'Event' AND coalesce(json_extract_string(o, '$.auditID'), '') <> '' THEN 'decoder:k8s_audit'
  WHEN o IS NOT NULL THEN 'decoder:json' WHEN regexp_matches(raw, '^(\d{4}/\d{2}/\d{2})\s+(\d{2}:\d{2}:\d{2}(?:\.\d+)?)\s+\(([^)]+)\)\s+(.*)$') THEN 'decoder:windows_event' ELSE 'decoder:syslog' END AS source, count(*) AS n FROM j GROUP BY 1""")
def decode_auto_sources(spark, d):
    lines = table(spark, d, "siem_events").select("raw").union(table(spark, d, "raw_lines").select("raw")).union(table(spark, d, "nested_records").select("payload"))
    return D.decode_rows(lines, D.chained(F.lit("auto"), D.decode_auto(F.col("raw")))).groupBy(F.col("e.source").alias("source")).agg(F.count("*").alias("n"))


@query("SELECT seen AS status, count(*) AS n FROM (SELECT coalesce(CASE WHEN results.n > 0 THEN 'completed' END, t.status) AS seen FROM tasks t LEFT JOIN (SELECT task_id, count(*) AS n FROM results WHERE task_id IS NOT NULL GROUP BY 1) results ON results.task_id = t.id) GROUP BY 1")
def finished_tasks(spark, d):
    outcomes = table(spark, d, "results").where("task_id IS NOT NULL").groupBy(F.col("task_id").alias("id")).agg(F.max("output").alias("result")).withColumn("error", F.lit(None).cast("string"))
    return store.finish_tasks(table(spark, d, "tasks"), "id", outcomes).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_orderdate + to_days(CAST(o_custkey % 5 AS INTEGER)) AS next_run FROM orders")
def hunts_advanced(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("next_run"), (F.col("o_custkey") % 5 * 24 * HOUR).alias("every_s"))
    return store.advance(o, "next_run", "every_s", F.col("next_run")).drop("every_s")


@query(f"""WITH {_J}, e AS (SELECT try_cast({_S('process.pid')} AS BIGINT) AS pid, {_S('file.path')} AS path, {_S('network.remote_ip')} AS ip, {_S('network.remote_port')} AS port FROM j WHERE {_S('type')} IS NOT NULL)
SELECT CASE WHEN pid IS NOT NULL THEN 'pid:' || pid WHEN path IS NOT NULL THEN 'file:' || substr(sha256(path), 1, 8) WHEN ip IS NOT NULL THEN concat_ws(':', 'net', ip, port) END AS key, count(*) AS n FROM e WHERE coalesce(CAST(pid AS VARCHAR), path, ip) IS NOT NULL GROUP BY 1""")
def event_keys(spark, d):
    g = lambda p: F.col(f"e.{p}")
    e = queue_events(spark, d).where("e.type IS NOT NULL AND (e.process.pid IS NOT NULL OR e.file.path IS NOT NULL OR e.network.remote_ip IS NOT NULL)")
    key = correlate.event_key(g("process.pid"), g("file.path"), g("network.remote_ip"), g("network.remote_port"), text_instant(g("timestamp")))
    return e.groupBy(key.alias("key")).agg(F.count("*").alias("n"))


CORRELATION_RULES = '[{"name": "burst", "window": 21600000000000, "threshold": 30, "severity": 3, "event_types": ["error", "click"], "suppress_ms": 3600000}]'


@query(E.SQL["correlator_bursts"])
def correlation_rule_file(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", "event_type", (F.col("user_id") % 3).alias("about"))
    out = correlate.correlation_alerts(e, feeds.load_correlation_rules(CORRELATION_RULES), "ts", "event_id", "event_type", "about")
    return out.select("about", "event_id", "in_window", "score", "rule")


_FIRED = "SELECT *, count(*) OVER (PARTITION BY user_id % 40 ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS k FROM events WHERE event_type = 'error'"


@query(f"SELECT 'MULTIPLE_FAILED_LOGINS-' || epoch_us(ts) || '-ip-reputation' AS id, 'MULTIPLE_FAILED_LOGINS-' || epoch_us(ts) AS alert_id, 'ip-reputation' AS playbook, 'pending' AS status FROM ({_FIRED}) WHERE k >= 3")
def alert_investigations(spark, d):
    a = E.line_alerts(spark, d).withColumn("alert_id", rules.alert_id(F.col("rule_id"), F.col("ts")))
    books = spark.createDataFrame([("ip-reputation",), ("file-analysis",)], "playbook string")
    return store.investigations_of(rules.actions_of(a, E.LINE_RULES), books)[0].drop("params")


@query(f"SELECT 'SIEM: MULTIPLE_FAILED_LOGINS' AS case_title, 'alert' AS event_type, 'MULTIPLE_FAILED_LOGINS-' || epoch_us(ts) AS alert_id, 'siem' AS source FROM ({_FIRED}) WHERE k >= 3")
def alert_case_events(spark, d):
    return store.case_rows(E.line_alerts(spark, d).withColumn("alert_id", rules.alert_id(F.col("rule_id"), F.col("ts"))))[0]


@query("""WITH u AS (SELECT id, max(try_cast(replace(replace(updated_at, 'T', ' '), 'Z', '') AS TIMESTAMP)) AS last FROM investigations WHERE id IS NOT NULL GROUP BY 1)
SELECT DISTINCT i.id FROM investigations i JOIN u ON i.id = u.id AND try_cast(replace(replace(i.updated_at, 'T', ' '), 'Z', '') AS TIMESTAMP) IS NOT DISTINCT FROM u.last WHERE lower(trim(i.status)) = 'waiting_approval'""")
def pending_approvals(spark, d):
    return store.pending_approvals(table(spark, d, "investigations"), "id", "status", "updated_at").select("id")


@query("""WITH r AS (SELECT task_id, agent, lower(coalesce(json_extract_string(output, '$.verdict'), json_extract_string(output, '$.reputation'), '')) AS v FROM results WHERE json_valid(output)),
n AS (SELECT task_id, count(*) AS n, coalesce(list_sort(list(DISTINCT concat_ws(': ', agent, v)) FILTER (v NOT IN ('', 'clean', 'unknown'))), []) AS f FROM r GROUP BY 1)
SELECT task_id, n || ' results; ' || array_to_string(f, ', ') AS summary, CAST(len(f) AS INTEGER) AS findings FROM n""")
def investigation_findings(spark, d):
    f = store.findings(table(spark, d, "results"), "task_id", "agent", "output")
    return f.select("task_id", "summary", F.size("findings").alias("findings"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

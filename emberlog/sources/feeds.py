"""Bodies of services as tables: vulnerability and reputation feeds, endpoint and edge pushes, correlation rules, process logs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.indicators import abuse_verdict, cvss_severity, engine_verdict

_METRIC = "array<struct<cvssData:struct<baseScore:double,baseSeverity:string,vectorString:string>>>"
_NVD = (
    "vulnerabilities array<struct<cve:struct<id:string,published:string,descriptions:array<struct<lang:string,value:string>>,"
    f"metrics:struct<cvssMetricV31:{_METRIC},cvssMetricV30:{_METRIC},cvssMetricV2:{_METRIC}>,"
    "configurations:array<struct<nodes:array<struct<cpeMatch:array<struct<criteria:string>>>>>>>>>"
)


def parse_cves(bodies: DataFrame, body: str, affected: int = 10) -> DataFrame:
    """(cve_id, published, description, cvss, severity, vector, affected) of the first vulnerability of each response.

    Scores by version 3.1, else 3.0, else 2; the last English description, else the first; at most ``affected`` criteria.
    A body without a vulnerability gives no row.
    """
    v = F.get(F.from_json(body, _NVD)["vulnerabilities"], F.lit(0))["cve"]
    x = bodies.select(v.alias("v")).where("v IS NOT NULL")
    metric = F.coalesce(*[F.get(F.col(f"v.metrics.{m}"), F.lit(0)) for m in ("cvssMetricV31", "cvssMetricV30", "cvssMetricV2")])["cvssData"]
    texts = F.col("v.descriptions")
    english = F.filter(texts, lambda d: d["lang"] == "en")
    text = F.coalesce(F.get(english, F.size(english) - 1), F.get(texts, F.lit(0)))["value"]
    nodes = F.flatten(F.transform(F.coalesce("v.configurations", F.array().cast("array<struct<nodes:array<struct<cpeMatch:array<struct<criteria:string>>>>>>")), lambda c: c["nodes"]))
    found = F.transform(F.flatten(F.transform(nodes, lambda n: n["cpeMatch"])), lambda m: m["criteria"])
    return x.select(
        F.col("v.id").alias("cve_id"), F.col("v.published").alias("published"), F.coalesce(text, F.lit("")).alias("description"), F.coalesce(metric["baseScore"], F.lit(0.0)).alias("cvss"),
        F.coalesce(metric["baseSeverity"], F.lit("")).alias("severity"), F.coalesce(metric["vectorString"], F.lit("")).alias("vector"), F.slice(F.coalesce(found, F.array().cast("array<string>")), 1, affected).alias("affected"),
    )


def cve_table(cves: DataFrame) -> DataFrame:
    """Rows for the vulnerability table: severity derived from the score where the feed gives none."""
    return cves.withColumn("severity", F.when(F.col("severity") == "", F.upper(cvss_severity(F.col("cvss")))).otherwise(F.col("severity")))


_ENGINES = "data struct<attributes:struct<last_analysis_stats:map<string,int>,last_analysis_date:long,times_submitted:int>>"


def parse_engine_report(bodies: DataFrame, indicator: str, body: str) -> DataFrame:
    """(indicator, malicious, suspicious, undetected, total, reputation, last_analysis) of scan engines' reports; what cannot be read is unknown."""
    a = F.from_json(body, _ENGINES)["data"]["attributes"]
    n = lambda k: F.coalesce(F.element_at(F.col("a.last_analysis_stats"), F.lit(k)), F.lit(0))
    out = bodies.select(F.col(indicator).alias("indicator"), a.alias("a"))
    verdict = engine_verdict(n("malicious"), n("suspicious"), n("harmless"), n("undetected"))
    reputation = F.when(F.col("a.last_analysis_stats").isNull(), "unknown").when(verdict["verdict"] == "unknown", "clean").otherwise(verdict["verdict"])
    last = F.when(F.col("a.last_analysis_date") > 0, F.timestamp_seconds("a.last_analysis_date"))
    return out.select("indicator", n("malicious").alias("malicious"), n("suspicious").alias("suspicious"), n("undetected").alias("undetected"), verdict["total"].alias("total"), reputation.alias("reputation"), last.alias("last_analysis"))


def indicator_route(c: Column) -> Column:
    """How a pulse service is asked about an indicator: file, url, domain or ip."""
    s = F.trim(c)
    return F.when(F.length(s).isin(32, 40, 64), F.when(s.rlike("^[0-9A-Fa-f]+$"), "file").otherwise("domain")).when(F.contains(s, F.lit("/")), "url").when(F.contains(s, F.lit(".")) & ~F.contains(s, F.lit(" ")), "domain").otherwise("ip")


def pulse_verdict(pulses: Column) -> Column:
    """struct<reputation, confidence> from the number of pulses."""
    return F.struct(F.when(pulses >= 5, "malicious").when(pulses >= 2, "suspicious").otherwise("unknown").alias("reputation"), F.when(pulses >= 5, 0.9).when(pulses >= 2, 0.6).otherwise(0.0).alias("confidence"))


def parse_abuse(bodies: DataFrame, body: str) -> DataFrame:
    """(ip, score, reports, country, reputation) of abuse reports; bodies without data give no row."""
    d = F.from_json(body, "data struct<ipAddress:string,abuseConfidenceScore:int,totalReports:int,countryCode:string>")["data"]
    x = bodies.select(d.alias("d")).where("d IS NOT NULL")
    return x.select(F.col("d.ipAddress").alias("ip"), F.col("d.abuseConfidenceScore").alias("score"), F.col("d.totalReports").alias("reports"), F.col("d.countryCode").alias("country"), abuse_verdict(F.coalesce("d.abuseConfidenceScore", F.lit(0))).alias("reputation"))


EDR_EVENT = (
    "id string, agent_id string, timestamp string, type string, severity int, process struct<pid:long,ppid:long,name:string,cmdline:string,path:string,user:string>, "
    "file struct<path:string,hash:string,size:long,mode:string>, network struct<local_ip:string,local_port:int,remote_ip:string,remote_port:int,protocol:string,state:string>, annotations map<string,string>"
)


def edr_events(queue: DataFrame, raw: str) -> DataFrame:
    """``queue`` with ``e``, the endpoint event in ``raw``; texts that are no JSON object give null."""
    return queue.withColumn("e", F.from_json(F.when(F.try_parse_json(raw).isNotNull() & F.ltrim(F.col(raw)).startswith("{"), F.col(raw)), EDR_EVENT))


def ingest_events(raw_events: DataFrame, agent: str, raw: str, tie: str) -> DataFrame:
    """(id, agent_id, event_type, severity, data): events received from agents, the first of an id; without an id or readable JSON: none."""
    e = edr_events(raw_events, raw).where("e.id <> ''")
    first = e.groupBy(F.col("e.id").alias("id")).agg(F.min_by(F.struct(F.col(agent).alias("agent_id"), F.coalesce("e.type", F.lit("")).alias("event_type"), F.coalesce("e.severity", F.lit(0)).alias("severity"), F.col(raw).alias("data")), tie).alias("v"))
    return first.select("id", "v.*")


def explode_batches(bodies: DataFrame, body: str) -> DataFrame:
    """(agent_id, raw): the events of posted batches, each as its own text; unreadable bodies give none."""
    x = bodies.select(F.from_json(body, "agent_id string, events array<string>").alias("b"))
    return x.select("b.agent_id", F.explode("b.events").alias("raw"))


_PUSH = "node_id string, investigation struct<id:string,status:string,intent:string,playbook:string,confidence:double,summary:string,indicators:array<string>,report:string>"


def accept_pushes(bodies: DataFrame, body: str, at: str) -> DataFrame:
    """(node_id, id, status, intent, playbook, confidence, summary, indicators, received): the last push of each investigation.

    A push needs a node and an investigation with an id; others are left out.
    """
    x = bodies.select(F.from_json(body, _PUSH).alias("b"), F.col(at).alias("received")).where("b.node_id <> '' AND b.investigation.id IS NOT NULL")
    row = F.struct("received", F.col("b.node_id").alias("node_id"), *[F.col(f"b.investigation.{c}").alias(c) for c in ("status", "intent", "playbook", "confidence", "summary", "indicators")])
    return x.groupBy(F.col("b.investigation.id").alias("id")).agg(F.max(row).alias("v")).select("v.node_id", "id", "v.status", "v.intent", "v.playbook", "v.confidence", "v.summary", "v.indicators", "v.received")


def load_correlation_rules(text: str) -> list[dict]:
    """Correlation rules from JSON: each needs a name, a window over 0 (seconds, or as nanoseconds from 10^6 on) and a threshold over 0."""
    rules = json.loads(text)
    if not isinstance(rules, list):
        raise ValueError("a list of rules is wanted")
    out = []
    for i, r in enumerate(rules):
        name, window, threshold = r.get("name"), r.get("window", 0), r.get("threshold", 0)
        if not name:
            raise ValueError(f"rule {i} has no name")
        if not isinstance(window, (int, float)) or window <= 0:
            raise ValueError(f"rule {name!r} has no valid window: {window!r}")
        if not isinstance(threshold, int) or threshold <= 0:
            raise ValueError(f"rule {name!r} has no valid threshold: {threshold!r}")
        out.append({"name": name, "window_s": int(window / 1e9) if window >= 10**6 else int(window), "threshold": threshold, "severity": int(r.get("severity", 0)), "kinds": list(r.get("event_types") or []), "suppress_ms": int(r.get("suppress_ms", 0))})
    return out


def replay_processes(log: DataFrame, key: list[str], at: str, started: Column, columns: list[str]) -> DataFrame:
    """The processes alive after a log of starts and ends (``started`` false), with what their last start said: the last entry of a key counts."""
    last = log.groupBy(*key).agg(F.max_by(F.struct(started.alias("__alive"), *columns), F.col(at)).alias("v"))
    return last.where("v.__alive").select(*key, *[F.col(f"v.{c}").alias(c) for c in columns])

"""Checks of what was captured of hosts: modules, environments, memory maps, start-up entries, mounts, ports, binaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.indicators import MALWARE_PORTS
from emberlog.operators.intel import contained_pairs

#: Words of the checks.
MODULE_WORDS = ["rootkit", "sneaky", "hideproc", "kdmapper"]
CRON_WORDS = ["curl", "wget", "bash -c", "base64", "chmod +x"]
TASK_WORDS = ["updater", "systemupdate", "securityscan", "windowsupdate"]
SENSITIVE_MOUNTS = ["/var/run/docker.sock", "/proc/1/ns", "/host"]
SEVERITY = {
    "hidden-process": 5, "suspicious-kernel-module": 5, "process-hijacking": 4, "suspicious-memory": 4,
    "fileless-malware": 5, "persistence-mechanisms": 3, "container-escape": 5, "common-malware-ports": 3,
}


def _any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def malware_port(line: Column) -> Column:
    """The first listed port that a line of listening sockets names, else null."""
    listens = F.contains(line, F.lit("LISTEN"))
    return F.coalesce(*[F.when(listens & F.contains(line, F.lit(f":{p}")), F.lit(p)) for p in MALWARE_PORTS])


def behaviour_facts(facts: DataFrame) -> DataFrame:
    """(host, check, detail): a row for each captured fact that a check finds suspicious.

    facts(host, kind, content), a row a line or file: kinds ``module``, ``environ``, ``maps`` (a process's whole map),
    ``cron``, ``unit`` (a unit's name), ``task``, ``mount``, ``socket``, and ``hidden`` (a process, see ``hidden_processes``).
    Null content is no fact.
    """
    kind, text = F.col("kind"), F.col("content")
    low = F.lower(text)
    checks = [
        ("hidden-process", kind == "hidden", text),
        ("suspicious-kernel-module", (kind == "module") & _any(low, MODULE_WORDS), F.regexp_extract(text, r"^\s*(\S+)", 1)),
        ("process-hijacking", (kind == "environ") & F.contains(text, F.lit("LD_PRELOAD=")), F.regexp_extract(text, r"LD_PRELOAD=([^\x00]*)", 1)),
        ("suspicious-memory", (kind == "maps") & (F.contains(text, F.lit("[vdso]")) & F.contains(text, F.lit("rwx")) | (F.size(F.split(text, r"\[heap\]")) > 3)), F.lit("W+X or unusual heap mappings")),
        ("fileless-malware", (kind == "maps") & F.contains(text, F.lit("memfd:")), F.regexp_extract(text, r"(memfd:\S+)", 1)),
        ("persistence-mechanisms", ((kind == "cron") & _any(low, CRON_WORDS)) | ((kind == "unit") & F.contains(low, F.lit("update")) & ~F.contains(low, F.lit("unattended"))) | ((kind == "task") & _any(low, TASK_WORDS)), text),
        ("container-escape", (kind == "mount") & text.isin(SENSITIVE_MOUNTS), text),
        ("common-malware-ports", (kind == "socket") & malware_port(text).isNotNull(), malware_port(text)),
    ]
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(n).alias("check"), d.alias("detail"))) for n, c, d in checks]), lambda x: x.isNotNull())
    return facts.where(text.isNotNull()).select("host", F.explode(found).alias("f")).select("host", "f.*")


def behaviour_report(facts: DataFrame) -> DataFrame:
    """(host, check, severity, status, findings): every check for every host with any fact; status suspicious or clean."""
    n = behaviour_facts(facts).groupBy("host", "check").agg(F.count("*").alias("findings"))
    every = F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.lit(v).alias("severity")) for k, v in SEVERITY.items()]))
    all_ = facts.select("host").distinct().select("host", every.alias("c")).select("host", "c.*")
    out = all_.join(n, ["host", "check"], "left").withColumn("findings", F.coalesce("findings", F.lit(0).cast("long")))
    return out.select("host", "check", "severity", F.when(F.col("findings") > 0, "suspicious").otherwise("clean").alias("status"), "findings")


def behaviour_summary(report: DataFrame, by: list[str]) -> DataFrame:
    """(suspicious, total) checks."""
    return report.groupBy(*by).agg(F.count_if(F.col("status") == "suspicious").alias("suspicious"), F.count("*").alias("total"))


def hidden_processes(proc: DataFrame, ps: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Processes with a name that the kernel's table has and the listing lacks, each once."""
    return proc.where(F.col(name) != "").dropDuplicates(keys).join(ps.select(*keys).distinct(), keys, "left_anti")


def trojaned(binaries: DataFrame, path: str, content: str, signatures: DataFrame) -> DataFrame:
    """``binaries`` with ``verdict``: trojaned if the content matches the pattern for the binary of its name, else clean.

    signatures(binary, pattern): that of the whole base name, else the first (by binary) that contains it or lies in it.
    """
    b = binaries.withColumn("__base", F.element_at(F.split(path, r"[/\\]"), -1))
    names = b.select(F.col("__base").alias("text")).where("text <> ''").distinct()
    s = signatures.select("binary").distinct()
    whole = names.join(s, names["text"] == s["binary"]).select("text", "binary", F.lit(0).alias("rank"))
    part = contained_pairs(names, s.select(F.col("binary").alias("pattern"))).select("text", F.col("pattern").alias("binary"))
    around = contained_pairs(s.select(F.col("binary").alias("text")), names.select(F.col("text").alias("pattern"))).select(F.col("pattern").alias("text"), F.col("text").alias("binary"))
    best = whole.unionByName(part.unionByName(around).withColumn("rank", F.lit(1))).groupBy("text").agg(F.min_by("binary", F.struct("rank", "binary")).alias("binary"))
    patterns = best.join(signatures, "binary").select(F.col("text").alias("__base"), F.col("pattern").alias("__pattern"))
    out = b.join(patterns, "__base", "left")
    hit = F.coalesce(F.regexp_like(F.col(content), F.col("__pattern")), F.lit(False))
    return out.withColumn("verdict", F.when(hit, "trojaned").otherwise("clean")).drop("__base", "__pattern")

"""Policy checks over captured facts, and compliance reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rule_facts(rule: str) -> dict:
    """A check's rule parsed: kind (c, f, d), target, name and content patterns, negated. Unreadable: kind empty."""
    text = rule.strip()
    negated = text.startswith("not ")
    text = text[4:].strip() if negated else text
    if text[:2] not in ("c:", "f:", "d:"):
        return {"kind": "", "target": "", "first": "", "second": "", "negated": negated}
    parts = [p.strip() for p in text[2:].split("->")]
    pats = [p[2:] if p.startswith("r:") else p for p in parts[1:]] + ["", ""]
    return {"kind": text[0], "target": parts[0], "first": pats[0], "second": pats[1], "negated": negated}


def evaluate_checks(checks: list[dict], facts: DataFrame) -> DataFrame:
    """(host, check_id, passed) for checks (id, condition all/any/none, rules) over facts(host, kind, target, name, content).

    A fact is what was captured of a host: the output of a command (kind c), a file (f) or a file in a directory (d).
    Every host with any fact is judged by every check. A rule holds if one of its facts matches; ``not`` turns it
    round. A missing fact fails, or holds if negated.
    """
    hosts = facts.select("host").distinct()
    results = []
    for check in checks:
        conds = {}
        for i, rule in enumerate(check.get("rules", [])):
            r = rule_facts(rule)
            hit = (F.col("kind") == r["kind"]) & (F.col("target") == r["target"])
            if r["kind"] == "d":
                hit = hit & (F.col("name").rlike(r["first"]) if r["first"] else F.lit(True)) & (F.col("content").rlike(r["second"]) if r["second"] else F.lit(True))
            elif r["kind"] == "f":
                hit = hit & (F.col("content").rlike(r["first"]) if r["first"] else F.lit(True))
            else:
                hit = hit & (F.col("content").rlike(r["first"]) if r["first"] else F.length("content") > 0)
            conds[f"r{i}"] = (hit, r["negated"])
        if not conds:
            results.append(hosts.select("host", F.lit(check["id"]).alias("check_id"), F.lit(True).alias("passed")))
            continue
        agg = facts.groupBy("host").agg(*[F.coalesce(F.bool_or(h), F.lit(False)).alias(k) for k, (h, _) in conds.items()])
        held = [~F.col(k) if neg else F.col(k) for k, (_, neg) in conds.items()]
        anyone = check.get("condition", "all") == "any"
        passed = reduce((lambda a, b: a | b) if anyone else (lambda a, b: a & b), held)
        if check.get("condition") == "none":
            passed = ~reduce(lambda a, b: a | b, held)
        results.append(agg.select("host", F.lit(check["id"]).alias("check_id"), passed.alias("passed")))
    return reduce(DataFrame.unionByName, results)


def policy_score(results: DataFrame, by: list[str]) -> DataFrame:
    """passed, failed, total and the score as text with one decimal."""
    n = results.groupBy(*by).agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.count("*").alias("total"))
    return n.withColumn("score", F.format_string("%.1f%%", F.col("passed") * 100.0 / F.col("total")))


def control_report(controls: DataFrame, results: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """(framework, control_id, category, status): pass if all its checks pass, fail if any fails, else what was
    assessed by hand, else not_covered. controls(framework, control_id, category), results(framework, control_id,
    passed), manual(framework, control_id, manual_status). Results of unknown controls are left out."""
    on = ["framework", "control_id"]
    r = results.groupBy(*on).agg(F.bool_and("passed").alias("ok"))
    out = controls.join(r, on, "left")
    out = out.join(manual.groupBy(*on).agg(F.max("manual_status").alias("manual_status")), on, "left") if manual is not None else out.withColumn("manual_status", F.lit(None).cast("string"))
    status = F.when(F.col("ok"), "pass").when(~F.col("ok"), "fail").otherwise(F.coalesce("manual_status", F.lit("not_covered")))
    return out.select("framework", "control_id", "category", status.alias("status"))


def with_evidence(report: DataFrame, evidence: DataFrame) -> DataFrame:
    """``report`` with ``evidence_items`` and ``last_evidence`` of evidence(framework, control_id, collected_at); none is 0 and null."""
    on = ["framework", "control_id"]
    e = evidence.groupBy(*on).agg(F.count("*").alias("evidence_items"), F.max("collected_at").alias("last_evidence"))
    return report.join(e, on, "left").withColumn("evidence_items", F.coalesce("evidence_items", F.lit(0).cast("long")))


def coverage(report: DataFrame, by: list[str]) -> DataFrame:
    """Counts of controls by status and score = passed / total * 100, per framework or category."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    return report.groupBy(*by).agg(is_("pass").alias("passed"), is_("fail").alias("failed"), is_("not_covered").alias("not_covered"), F.count("*").alias("total"), F.round(is_("pass") * 100.0 / F.count("*"), 6).alias("score"))


def score_trend(snapshots: DataFrame, keys: list[str], at: str, score: str, since: Column) -> DataFrame:
    """Snapshots from ``since`` on with the change since the one before."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(at)
    return snapshots.where(F.col(at) >= since).withColumn("delta", F.col(score) - F.lag(score).over(w))


def explode_mappings(checks: DataFrame, mapping: str) -> DataFrame:
    """checks with map<framework, array<control>> -> a row a framework and control."""
    return checks.select(*[c for c in checks.columns if c != mapping], F.explode(mapping).alias("framework", "ids")).withColumn("control_id", F.explode("ids")).drop("ids")


def render_report(report: DataFrame, form: str = "text", max_rows: int = 10_000) -> str:
    """A report of at most ``max_rows`` controls as text, md, html or json (a catalogue's size, checked)."""
    rows = report.orderBy("framework", "control_id").limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"report has more than {max_rows} rows")
    cells = [[r["framework"], r["control_id"], r["status"]] for r in rows]
    if form == "json":
        import json

        return json.dumps([dict(zip(("framework", "control_id", "status"), c)) for c in cells], indent=1)
    if form == "html":
        from html import escape

        return "<table>" + "".join("<tr>" + "".join(f"<td>{escape(str(x))}</td>" for x in c) + "</tr>" for c in cells) + "</table>"
    if form == "md":
        return "\n".join(["| framework | control | status |", "|-|-|-|", *["| " + " | ".join(map(str, c)) + " |" for c in cells]])
    return "\n".join("  ".join(map(str, c)) for c in cells)

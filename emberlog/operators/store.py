"""The operational store's statements over tables: listings, searches, upserts, claims, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.keys import text_instant
from emberlog.operators.ordered import numbered


def recent(df: DataFrame, at: str, tie: str, limit: int) -> DataFrame:
    """The newest rows: a bounded top-k, no full sort. ``at`` holds UTC texts or times; rows without a time come last."""
    when = text_instant(at) if dict(df.dtypes)[at] == "string" else F.col(at)
    return df.withColumn("__at", when).orderBy(F.desc_nulls_last("__at"), F.col(tie)).limit(limit).drop("__at")


def newest_version(df: DataFrame, key: str, updated: str) -> DataFrame:
    """One row a key: the one updated last (ties: the greatest row as JSON text); null keys are left out."""
    rest = [c for c in df.columns if c != key]
    order = F.struct(text_instant(updated), F.to_json(F.struct(*rest)))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*").select(*df.columns)


def by_prefix(df: DataFrame, key: str, prefix: str, at: str) -> DataFrame:
    """The newest row whose key begins with ``prefix``."""
    return recent(df.where(F.col(key).startswith(prefix)), at, key, 1)


def filtered(df: DataFrame, **equals) -> DataFrame:
    """Optional equality filters; None and empty are no filter."""
    for c, v in equals.items():
        if v not in (None, ""):
            df = df.where(F.col(c) == v)
    return df


def search(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows in which any column contains the text in any letter case."""
    q, cond = F.lit(text.lower()), F.lit(False)
    for c in columns:
        cond = cond | F.contains(F.lower(F.coalesce(c, F.lit(""))), q)
    return df.where(cond)


def upsert(old: DataFrame, new: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """Rows of ``new`` win, but columns in ``keep`` stay as they were where the key was there already."""
    n = new.select(F.col(key), *[F.col(c).alias(f"n_{c}") for c in old.columns if c != key], F.lit(True).alias("__new"))
    j = old.withColumn("__old", F.lit(True)).join(n, key, "full_outer")
    pick = lambda c: F.when(F.col("__new").isNull() | (F.col("__old").isNotNull() & F.lit(c in keep)), F.col(c)).otherwise(F.col(f"n_{c}")).alias(c)
    return j.select(key, *[pick(c) for c in old.columns if c != key]).select(*old.columns)


def claim_oldest(tasks: DataFrame, status: str, pending: str, at: str, tie: str, n: int) -> DataFrame:
    """The ``n`` oldest pending tasks."""
    return tasks.where(F.col(status) == pending).withColumn("__at", text_instant(at)).orderBy(F.asc_nulls_last("__at"), tie).limit(n).drop("__at")


def due(hunts: DataFrame, next_run: str, status: str, now: Column) -> DataFrame:
    return hunts.where((F.col(status) == "active") & (F.col(next_run).isNull() | (F.col(next_run) <= now)))


def node_status(nodes: DataFrame, heartbeat: str, now: Column, stale_s: int = 90) -> DataFrame:
    """``node_status``: offline if the last heartbeat is missing or more than ``stale_s`` old."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(text_instant(heartbeat).cast("timestamp"))
    return nodes.withColumn("node_status", F.when(F.coalesce(age <= stale_s * 1_000_000, F.lit(False)), "online").otherwise("offline"))


def status_summary(df: DataFrame, status: str, done: str) -> DataFrame:
    """(total, completed, completed_pct)."""
    is_done = F.count_if(F.lower(F.trim(status)) == done)
    return df.agg(F.count("*").alias("total"), is_done.alias("completed"), F.round(is_done * 100.0 / F.count("*"), 6).alias("completed_pct"))


def confidence_buckets(df: DataFrame, confidence: str) -> DataFrame:
    c = F.col(confidence)
    return df.groupBy(F.when(c >= 0.8, "high").when(c >= 0.5, "medium").when(c.isNotNull(), "low").otherwise("none").alias("bucket")).agg(F.count("*").alias("n"))


def evict_oldest(queue: DataFrame, at: str, tie: str, keep: int) -> DataFrame:
    """The ``keep`` newest rows of a bounded queue."""
    return queue.orderBy(F.desc(at), F.desc(tie)).limit(keep)


def alerts_to_cases(alerts: DataFrame, least: int = 4) -> DataFrame:
    """Alerts of at least that severity as cases: title, severity name, source address."""
    from emberlog.functions.indicators import alert_case_severity

    return alerts.where(F.col("rule_severity") >= least).select(
        F.concat(F.lit("SIEM: "), F.col("rule_id")).alias("title"), alert_case_severity(F.col("rule_severity")).alias("severity"), "alert_id", F.element_at("fields", F.lit("client_ip")).alias("ioc_value")
    )


def link_once(links: DataFrame, left: str, right: str) -> DataFrame:
    """A bridge table without repeated pairs; pairs with a null are left out."""
    return links.where(F.col(left).isNotNull() & F.col(right).isNotNull()).dropDuplicates([left, right])


def timeline(df: DataFrame, entity: str, at: Column, tie: str) -> DataFrame:
    """Events of each entity numbered in order."""
    return numbered(df.withColumn("__at", at), entity, ["__at", tie], "step").drop("__at")


def finish_tasks(tasks: DataFrame, key: str, outcomes: DataFrame) -> DataFrame:
    """``tasks`` after completions and failures: outcomes(key, result, error) set status, result and error; others stay."""
    o = outcomes.select(key, F.col("result").alias("__r"), F.col("error").alias("__e"), F.lit(True).alias("__done"))
    done = F.coalesce("__done", F.lit(False))
    j = tasks.join(o, key, "left")
    pick = {"status": F.when(done, F.when(F.col("__e").isNotNull(), "failed").otherwise("completed")).otherwise(F.col("status")), "result": F.when(done, F.col("__r")).otherwise(F.col("result")), "error": F.when(done, F.col("__e")).otherwise(F.col("error"))}
    return j.select(*[pick.get(c, F.col(c)).alias(c) for c in tasks.columns])


def advance(hunts: DataFrame, next_run: str, every_s: str, now: Column) -> DataFrame:
    """Hunts that ran at ``now``: their next run is one interval later."""
    return hunts.withColumn(next_run, F.timestamp_micros(F.unix_micros(now.cast("timestamp")) + F.col(every_s) * 1_000_000).cast(hunts.schema[next_run].dataType))


def dismissals(events: DataFrame, data: str, threshold: int = 10) -> DataFrame:
    """(rule_name, process_name, dismissals, throttled) of dismissed alerts given as JSON: the rule is that of the annotations,
    else the event's type; the process its name, else the file's path, else unknown."""
    g = lambda p: F.get_json_object(data, f"$.{p}")
    rule = F.coalesce(g("annotations.yara_rule"), g("annotations.correlation"), g("type"))
    n = events.where(rule.isNotNull()).groupBy(rule.alias("rule_name"), F.coalesce(g("process.name"), g("file.path"), F.lit("unknown")).alias("process_name")).agg(F.count("*").alias("dismissals"))
    return n.withColumn("throttled", F.col("dismissals") >= threshold)


def replace_all(df: DataFrame, path: str) -> DataFrame:
    """A baseline replaced as a whole: the new table is written beside the old ones and read back; readers of an old one keep it."""
    import uuid

    to = f"{path.rstrip('/')}/version-{uuid.uuid4().hex}"
    df.write.parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)


#: What undoes an action on a host.
UNDO = {"isolate_host": "release_host", "quarantine_file": "restore_file", "block_ip": "unblock_ip", "disable_user": "enable_user"}


def rollbacks(actions: DataFrame, key: str, kind: str, target: str, status: str, updated: str) -> DataFrame:
    """(key, action, target) that undo the completed actions which can be undone, by their last version."""
    undo = F.lit(None).cast("string")
    for k, v in UNDO.items():
        undo = F.when(F.col(kind) == k, v).otherwise(undo)
    last = newest_version(actions, key, updated)
    return last.where((F.lower(F.trim(status)) == "completed") & undo.isNotNull()).select(key, undo.alias("action"), target)


def render_case(case: dict, events: DataFrame, indicators: DataFrame, form: str = "text", max_rows: int = 10_000) -> str:
    """A case with its events and indicators (at most ``max_rows`` of each, checked) as text, md or html."""
    from html import escape

    rows = []
    for df, order in ((events, "created_at"), (indicators, "value")):
        some = df.orderBy(order).limit(max_rows + 1).collect()
        if len(some) > max_rows:
            raise ValueError(f"case has more than {max_rows} rows")
        rows.append(some)
    head = [(k, case.get(k)) for k in ("id", "title", "status", "severity", "assignee")]
    lines = [f"{e['created_at']} {e['event_type']}: {e['content']}" for e in rows[0]]
    found = [f"{i['type']}: {i['value']}" for i in rows[1]]
    if form == "html":
        items = lambda xs: "<ul>" + "".join(f"<li>{escape(str(x))}</li>" for x in xs) + "</ul>"
        return f"<h1>{escape(str(case.get('title')))}</h1>" + items(f"{k}: {v}" for k, v in head) + "<h2>Events</h2>" + items(lines) + "<h2>Indicators</h2>" + items(found)
    mark = ("# ", "## ", "- ") if form == "md" else ("", "", "  ")
    return "\n".join([mark[0] + str(case.get("title")), *[f"{mark[2]}{k}: {v}" for k, v in head], mark[1] + "Events", *[mark[2] + x for x in lines], mark[1] + "Indicators", *[mark[2] + x for x in found]])


def case_rows(alerts: DataFrame, least: int = 4) -> tuple[DataFrame, DataFrame]:
    """(case_events, case_iocs) of the alerts that become cases: what happened, and the source address where there is one."""
    some = alerts.where(F.col("rule_severity") >= least)
    events = some.select(F.concat(F.lit("SIEM: "), F.col("rule_id")).alias("case_title"), F.lit("alert").alias("event_type"), "alert_id", F.lit("siem").alias("source"))
    ip = F.element_at("fields", F.lit("client_ip"))
    iocs = some.where(ip.isNotNull()).select(F.concat(F.lit("SIEM: "), F.col("rule_id")).alias("case_title"), F.lit("ip").alias("type"), ip.alias("value")).distinct()
    return events, iocs


def investigations_of(actions: DataFrame, books: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(investigations, missing): a pending investigation for each alert and action whose playbook books(playbook) has, with the
    alert it links to; actions of other playbooks are missing ones."""
    known = books.select("playbook").where("playbook IS NOT NULL").distinct()
    found = actions.join(known, "playbook", "left_semi")
    rows = found.select(F.concat_ws("-", "alert_id", "playbook").alias("id"), "alert_id", "playbook", F.lit("pending").alias("status"), "params")
    return rows, actions.join(known, "playbook", "left_anti")


def pending_approvals(investigations: DataFrame, key: str, status: str, updated: str) -> DataFrame:
    """Investigations whose last version waits for an analyst, the longest waiting first."""
    waiting = newest_version(investigations, key, updated).where(F.lower(F.trim(status)) == "waiting_approval")
    return waiting.orderBy(text_instant(updated).asc_nulls_first(), key)


def findings(results: DataFrame, by: str, agent: str, output: str) -> DataFrame:
    """(by, findings, indicators, summary) of an investigation's results given as JSON: agents with a verdict that is not clean
    or unknown, the distinct indicators named, and both as one line."""
    g = lambda p: F.get_json_object(output, f"$.{p}")
    verdict = F.lower(F.coalesce(g("verdict"), g("reputation"), F.lit("")))
    bad = F.when(~verdict.isin("", "clean", "unknown"), F.concat_ws(": ", agent, verdict))
    named = F.array_compact(F.array(g("indicator"), g("ip"), g("hash"), g("domain")))
    n = results.where(F.try_parse_json(output).isNotNull()).groupBy(by).agg(F.array_sort(F.collect_set(bad)).alias("findings"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(named)))).alias("indicators"), F.count("*").alias("__n"))
    summary = F.concat_ws("; ", F.format_string("%d results", "__n"), F.array_join("findings", ", "))
    return n.withColumn("summary", summary).drop("__n")

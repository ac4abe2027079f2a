"""The pN_ queries of the core's problems over the operational tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.keys import folded, text_instant
from emberlog.operators import exactly_once, instants, loglines, orphans, shred
from emberlog.session import table

#: child table, reference column, parent table
REFERENCES = (
    ("tasks", "investigation_id", "investigations"),
    ("results", "task_id", "tasks"),
    ("case_events", "case_id", "cases"),
    ("edr_actions", "agent_id", "edr_agents"),
)


def _dangling(spark: SparkSession, d: str) -> DataFrame:
    """The dangling rows of all child tables: (parent table, key) is one composite key, so one pass serves them all."""
    children = [table(spark, d, child).select(F.lit(child).alias("child_table"), F.lit(parent).alias("parent_table"), "id", F.col(ref).alias("ref"), "created_at") for child, ref, parent in REFERENCES]
    parents = [table(spark, d, parent).select(F.lit(parent).alias("parent_table"), "id", "created_at") for _, _, parent in REFERENCES]
    return orphans.find_orphans(
        reduce(DataFrame.unionByName, children), reduce(DataFrame.unionByName, parents),
        [(F.col("parent_table"), F.col("parent_table")), (folded("ref"), folded("id"))],
        deleted=table(spark, d, "tombstones").select("table_name", "record_key"), deleted_on=[folded("table_name"), folded("record_key")],
        child_time=text_instant("created_at"), parent_time=text_instant("created_at"),
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _dangling(spark, d).where(F.col("id").isNotNull()).select("child_table", F.col("id").alias("child_id")).distinct()


def p1_orphans_by_month(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans_per_period(_dangling(spark, d), F.col("child_table"), "id", text_instant("created_at"))


def p1_composite_keys(spark: SparkSession, d: str) -> DataFrame:
    """Results whose (task_id, agent) names no task of that agent, under each match rule, partly null keys included."""
    child, parent = table(spark, d, "results").select("id", "task_id", "agent"), table(spark, d, "tasks").select("id", "agent")
    on = [(folded("task_id"), folded("id")), (folded("agent"), folded("agent"))]
    found = [orphans.find_orphans(child, parent, on, match=m).select(F.lit(m).alias("match_rule"), F.col("id").alias("child_id"), orphans.MASK, orphans.REASON) for m in orphans.MATCHES]
    return reduce(DataFrame.unionByName, found).distinct()


def event_identifiers():
    """Identifiers of a queue message: (agent_id, id), and the id inside event_data if that parses and has one."""
    inner = F.lower(F.try_variant_get(F.try_parse_json("event_data"), "$.id", "string"))
    return [exactly_once.identifier(F.col("agent_id"), F.col("id")), exactly_once.identifier(F.when(inner != "", inner))]


#: Deliveries that p2_found ingests one after the other (ranges of batch_id, or of row_no), and the number of index runs that are merged into one.
BATCHES, MERGE_EVERY = 3, 2


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    queue = exactly_once.first_copies(table(spark, d, "event_queue"), "row_no", event_identifiers(), BATCHES, MERGE_EVERY, batch="batch_id")
    keys = exactly_once.first_copies(table(spark, d, "dedup_keys"), "row_no", [exactly_once.identifier(folded("key_hash"))], BATCHES, MERGE_EVERY)
    return queue.select(F.lit("event_queue").alias("source_table"), F.col("row").alias("row_no")).unionByName(
        keys.select(F.lit("dedup_keys").alias("source_table"), F.col("row").alias("row_no"))
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return loglines.parse_entries(table(spark, d, "raw_lines"), "file_no", "line_no", "read_at", "raw", "fields", message=False).drop("message")


def p4_entries(spark: SparkSession, d: str) -> DataFrame:
    return loglines.parse_entries(table(spark, d, "raw_lines"), "file_no", "line_no", "read_at", "raw", "fields")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return shred.shred_records(table(spark, d, "nested_records"), "record_id", "payload")


def p5_alerts(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of alerts, a column a field."""
    rows = shred.shred_records(table(spark, d, "nested_records"), "record_id", "payload", [e for e in shred.ENTITIES if e.name == "alert"], leaves=True)
    field = lambda n: F.element_at("fields", n).alias(n)
    return rows.select("record_id", "event_no", "item_no", field("action"), field("gid"), field("sid"), field("rule"), field("category"), field("severity"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The time stands in time_text; for audit stages it may follow the stage's name instead."""
    r = table(spark, d, "stamped_records")
    has_figures = F.col("time_text").rlike("[0-9]")
    stage_text = F.regexp_extract("stage", r"(?s)^\s*[A-Za-z]+(?:\s+at\s+|\s*[@;,|]\s*|\s+)(.+)$", 1)
    text = F.when(has_figures | (F.col("field_name") != "k8sAuditEvent.stage"), F.col("time_text")).otherwise(stage_text)
    rows = r.select("record_id", "sensor_id", "received_at", text.alias("text"))
    return instants.normalise_instants(rows, "record_id", "sensor_id", "text", "received_at", table(spark, d, "sensors"))


_KEY = "nullif(lower(trim({}, ' \t\r\n')), '')"
_AT = "try_cast(replace(replace({}, 'T', ' '), 'Z', '') AS TIMESTAMP)"


def _p1_sql(select: str) -> str:
    arms = []
    for child, ref, parent in REFERENCES:
        arms.append(
            f"SELECT '{child}' AS child_table, c.id AS child_id, {_AT.format('c.created_at')} AS born FROM {child} c "
            f"WHERE {_KEY.format('c.' + ref)} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE {_KEY.format('p.id')} = {_KEY.format('c.' + ref)} "
            f"AND NOT coalesce({_AT.format('p.created_at')} > {_AT.format('c.created_at')}, false) "
            f"AND NOT EXISTS (SELECT 1 FROM tombstones t WHERE {_KEY.format('t.table_name')} = '{parent}' AND {_KEY.format('t.record_key')} = {_KEY.format('p.id')}))"
        )
    return f"WITH o AS ({' UNION ALL '.join(arms)}) {select}"


_COMPOSITE_SQL = f"""
WITH t AS (SELECT {_KEY.format('id')} AS a, {_KEY.format('agent')} AS b FROM tasks),
r AS (SELECT DISTINCT id AS child_id, {_KEY.format('task_id')} AS a, {_KEY.format('agent')} AS b FROM results),
m AS (SELECT *, CAST(a IS NULL AS INTEGER) + 2 * CAST(b IS NULL AS INTEGER) AS null_mask,
  EXISTS (SELECT 1 FROM t WHERE t.a = r.a AND t.b = r.b) AS whole, EXISTS (SELECT 1 FROM t WHERE t.a = r.a) AS by_task, EXISTS (SELECT 1 FROM t WHERE t.b = r.b) AS by_agent FROM r)
SELECT DISTINCT 'simple' AS match_rule, child_id, null_mask, 'no_valid_parent' AS orphan_reason FROM m WHERE null_mask = 0 AND NOT whole
UNION ALL SELECT DISTINCT 'full', child_id, null_mask, CASE WHEN null_mask = 0 THEN 'no_valid_parent' ELSE 'partial_key' END FROM m WHERE (null_mask = 0 AND NOT whole) OR null_mask IN (1, 2)
UNION ALL SELECT DISTINCT 'partial', child_id, null_mask, 'no_valid_parent' FROM m WHERE (null_mask = 0 AND NOT whole) OR (null_mask = 1 AND NOT by_agent) OR (null_mask = 2 AND NOT by_task)
"""


_P2_SQL = """
WITH RECURSIVE q AS (
  SELECT row_no, agent_id, id, lower(nullif(CASE WHEN json_valid(event_data) THEN json_extract_string(event_data, '$.id') END, '')) AS inner_id FROM event_queue
), e AS (
  SELECT row_no AS u, min(row_no) OVER (PARTITION BY agent_id, id) AS v FROM q WHERE agent_id IS NOT NULL AND id IS NOT NULL
  UNION SELECT row_no, min(row_no) OVER (PARTITION BY inner_id) FROM q WHERE inner_id IS NOT NULL
), both_ways AS (SELECT u, v FROM e WHERE u <> v UNION SELECT v, u FROM e WHERE u <> v),
reach AS (
  SELECT u AS a, v AS b FROM both_ways
  UNION SELECT r.a, w.v FROM reach r JOIN both_ways w ON r.b = w.u
)
SELECT DISTINCT 'event_queue' AS source_table, a AS row_no FROM reach WHERE b < a
UNION ALL
SELECT 'dedup_keys', row_no FROM (SELECT row_no, row_number() OVER (PARTITION BY lower(trim(key_hash, ' \t\r\n')) ORDER BY row_no) AS n FROM dedup_keys WHERE trim(key_hash, ' \t\r\n') <> '') WHERE n > 1
"""


def queries() -> dict:
    return {"p1_found": p1_found, "p1_orphans_by_month": p1_orphans_by_month, "p1_composite_keys": p1_composite_keys, "p2_found": p2_found, "p4_found": p4_found, "p4_entries": p4_entries, "p5_found": p5_found, "p5_alerts": p5_alerts, "p6_found": p6_found}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _p1_sql("SELECT DISTINCT child_table, child_id FROM o WHERE child_id IS NOT NULL"),
        "p1_orphans_by_month": _p1_sql("SELECT child_table, CAST(date_trunc('month', born) AS DATE) AS period, count(DISTINCT child_id) + count(*) FILTER (child_id IS NULL) AS orphans FROM o GROUP BY 1, 2"),
        "p1_composite_keys": _COMPOSITE_SQL,
        "p2_found": _P2_SQL,
    }

"""The pN_ queries of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberlog.llm import language, packing, runs, tokens
from emberlog.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "siem_events").select("event_id", "event_time", "source", "tags")
    found = runs.collapse_runs(events, "source", "event_id", "event_time", "tags")
    return found.where("n >= 2").selectExpr("first_id AS first_event_id", "n AS n_events", "duration_us")


#: Cost of a run, and of a tag in which an event differs from the tags of its run, in p3_near_runs.
NEAR_PENALTY, NEAR_WEIGHT = 2.0, 1.0


def p3_near_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of events with nearly the same tags: the segmentation of least cost."""
    events = table(spark, d, "siem_events").select("event_id", "event_time", "source", "tags")
    found = runs.collapse_runs(events, "source", "event_id", "event_time", "tags", NEAR_PENALTY, NEAR_WEIGHT)
    return found.selectExpr("entity AS source", "first_id AS first_event_id", "n AS n_events", "duration_us", "replace(sig, '\x1f', ',') AS tags")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = tokens.count_tokens(table(spark, d, "documents"))
    kinds = [(r[0], r[1]) for r in table(spark, d, "containers").select("container_id", "capacity_tokens").orderBy("container_id").collect()]
    return packing.pack_documents(sizes, "doc_id", "n_tokens", kinds)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    labelled = language.label_documents(table(spark, d, "documents"), table(spark, d, "lang_codes"))
    return language.segments_of(labelled).drop("confidence")


def p9_labels(spark: SparkSession, d: str) -> DataFrame:
    """Language, confidence and status of every document."""
    return language.label_documents(table(spark, d, "documents"), table(spark, d, "lang_codes")).drop("segments")


_P3_SQL = r"""
WITH e AS (
  SELECT event_id, min(struct_pack(t := event_time, s := nullif(lower(trim(source, ' \t\r\n')), ''),
    g := coalesce(list_sort(list_distinct(list_filter(list_transform(tags, lambda x: regexp_replace(lower(trim(x, E' \t\r\n')), '[0-9]+', '#', 'g')), lambda x: x <> ''))), []))) AS v
  FROM siem_events WHERE event_time IS NOT NULL GROUP BY event_id
), o AS (
  SELECT event_id, v.t AS t, v.s AS s, CASE WHEN lag(v.g) OVER w = v.g THEN 0 ELSE 1 END AS starts
  FROM e WINDOW w AS (PARTITION BY v.s ORDER BY v.t, event_id)
), r AS (SELECT *, sum(starts) OVER (PARTITION BY s ORDER BY t, event_id) AS run_no FROM o)
SELECT arg_min(event_id, (t, event_id)) AS first_event_id, count(*) AS n_events, epoch_us(max(t)) - epoch_us(min(t)) AS duration_us
FROM r GROUP BY s, run_no HAVING count(*) >= 2
""".replace("' \\t\\r\\n'", "E' \\t\\r\\n'").replace("EE'", "E'")


def queries() -> dict:
    return {"p3_found": p3_found, "p3_near_runs": p3_near_runs, "p7_ids": p7_ids, "p8_containers": p8_containers, "p9_found": p9_found, "p9_labels": p9_labels}


def oracle_sql() -> dict[str, str]:
    return {"p3_found": _P3_SQL}

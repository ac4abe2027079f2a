"""Playbooks: pipelines of registered functions over a table of indicators, with guards, interpolation and a timeline.

A step applies to all indicators at once. Its output joins the state as a struct column, so later steps and
conditions refer to it by ``${outputs.agent.action.key}``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.operators.skew import join_lookup

_VAR = re.compile(r"\$\{([^}]+)\}")
REGISTRY: dict[str, Callable[[DataFrame, dict], DataFrame]] = {}


def agent(name: str):
    """Register ``agent.action``: a function of (state, parameters) that returns (id, output columns ...)."""

    def wrap(fn):
        REGISTRY[name] = fn
        return fn

    return wrap


@dataclass
class Step:
    agent: str
    action: str
    params: dict = field(default_factory=dict)
    condition: str = ""
    optional: bool = False
    wait: bool = False

    @property
    def name(self) -> str:
        return f"{self.agent}.{self.action}"


def resolve(path: str, columns: list[str]) -> Column | None:
    """``input.x`` a column of the state, ``outputs.agent.action.key`` a field of a step's output; else null."""
    parts = path.split(".")
    if parts[0] == "input" and len(parts) > 1 and parts[1] in columns:
        return F.col(parts[1])
    if parts[0] == "outputs" and len(parts) >= 4 and f"{parts[1]}_{parts[2]}" in columns:
        return F.col(f"{parts[1]}_{parts[2]}").getField(parts[3])
    return None


def interpolate(template: str, columns: list[str]) -> Column:
    """The template with each ``${path}`` replaced; a path that leads nowhere is empty."""
    cols = []
    for i, part in enumerate(_VAR.split(template)):
        c = resolve(part, columns) if i % 2 else F.lit(part)
        cols.append(F.coalesce(c.cast("string"), F.lit("")) if c is not None else F.lit(""))
    return F.concat(*cols)


def condition(expr: str, columns: list[str]) -> Column:
    """``a == b``, ``a != b`` or truthy; quotes are dropped; empty, false, 0 and missing are false; no condition is true."""
    expr = expr.strip()
    if not expr:
        return F.lit(True)
    for op in ("==", "!="):
        if op in expr:
            a, b = (interpolate(x.strip().strip("\"'"), columns) for x in expr.split(op, 1))
            return (a == b) if op == "==" else (a != b)
    value = F.lower(interpolate(expr.strip("\"'"), columns))
    return ~value.isin("", "false", "0", "<nil>")


def run_playbook(indicators: DataFrame, key: str, steps: list[Step], registry: dict | None = None, approvals: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(state, timeline): every step applied in order to the rows that still run. ``status`` of a row ends as completed,
    failed, denied or waiting_approval.

    Rows whose guard is false skip the step. A step that waits goes on for rows that approvals(key, step, decision) lists as
    approved, ends for those denied (of several decisions denied counts), and holds the others. A step that has no function
    or raises ends the playbook unless it is optional; rows without output get null.
    """
    registry = REGISTRY if registry is None else registry
    state, events = indicators.withColumns({"__live": F.lit(True), "status": F.lit("running")}), [(0, "playbook_started", "", F.lit(True))]
    for i, s in enumerate(steps, 1):
        col, on, fn = f"{s.agent}_{s.action}", f"ran_{i}", registry.get(s.name)
        state = state.withColumn(on, F.col("__live") & condition(s.condition, state.columns))
        events.append((i, "step_skipped", s.name, F.col(f"live_{i}") & ~F.coalesce(F.col(f"guard_{i}"), F.lit(False))))
        state = state.withColumns({f"live_{i}": F.col("__live"), f"guard_{i}": F.col(on)})
        if s.wait:
            said = f"said_{i}"
            if approvals is None:
                state = state.withColumn(said, F.lit(None).cast("string"))
            else:
                state = state.join(approvals.where(F.col("step") == s.name).groupBy(key).agg(F.max("decision").alias(said)), key, "left")
            asked, agreed, denied = F.col(f"guard_{i}"), F.coalesce(F.col(said) == "approved", F.lit(False)), F.coalesce(F.col(said) == "denied", F.lit(False))
            events += [(i, "step_waiting_approval", s.name, asked), (i, "step_approved", s.name, asked & agreed), (i, "step_denied", s.name, asked & denied)]
            ends = asked & ~agreed
            state = state.withColumns({"status": F.when(asked & denied, "denied").when(ends, "waiting_approval").otherwise(F.col("status")), on: asked & agreed, "__live": F.col("__live") & ~ends})
        out = None
        if fn is not None:
            params = {k: interpolate(v, state.columns) if isinstance(v, str) else v for k, v in s.params.items()}
            try:
                out = fn(state.where(F.col(on)), params)
            except Exception:  # noqa: BLE001 - whatever a step's function raises ends the step
                out = None
        if out is None:
            events.append((i, "step_failed_optional" if s.optional else "step_failed", s.name, F.col(on)))
            if s.optional:
                continue
            state = state.withColumns({"status": F.when(F.col(on), "failed").otherwise(F.col("status")), "__live": F.col("__live") & ~F.col(on)})
            continue
        packed = out.select(key, F.struct(*[c for c in out.columns if c != key]).alias(col))
        state = state.join(packed, key, "left")
        events.append((i, "step_completed", s.name, F.col(on)))
    events.append((len(steps) + 1, "playbook_completed", "", F.col("__live")))
    state = state.withColumn("status", F.when(F.col("__live"), "completed").otherwise(F.col("status")))
    rows = F.filter(F.array(*[F.struct(F.lit(n).alias("step_no"), F.lit(e).alias("event"), F.lit(name).alias("step"), c.alias("on")) for n, e, name, c in events]), lambda x: x["on"])
    timeline = state.select(key, F.explode(rows).alias("e")).select(key, "e.step_no", "e.event", "e.step")
    return state.drop("__live", *[c for i in range(1, len(steps) + 1) for c in (f"live_{i}", f"guard_{i}", f"said_{i}")]), timeline


def route(alerts: DataFrame, playbook: str, books: DataFrame) -> DataFrame:
    """``alerts`` with ``route``: run where books(playbook) has the playbook, none where the alert names no one, else paused."""
    known = books.select(F.col("playbook").alias("__book")).where("__book IS NOT NULL").distinct().withColumn("__known", F.lit(True))
    out = join_lookup(alerts.withColumn("__book", F.col(playbook)), known, "__book", "left")
    named = F.coalesce(F.col(playbook) != "", F.lit(False))
    return out.withColumn("route", F.when(F.col("__known"), "run").when(named, "paused").otherwise("none")).drop("__book", "__known")


def score_result(r: Column) -> Column:
    """Confidence of a result given as JSON text, first case that holds: malicious 0.95, suspicious 0.7, a share of
    engines above 0.3 0.9, any count 0.85, found 0.75, a suspicious list 0.8, a known indicator its confidence (else
    0.8), not configured 0, another error 0.1, else 0.5."""
    g = lambda p: F.get_json_object(r, f"$.{p}")
    num = lambda p: F.coalesce(g(p).try_cast("double"), F.lit(0.0))
    text = lambda p: F.coalesce(g(p), F.lit(""))
    return (
        F.when(text("reputation") == "malicious", 0.95).when(text("reputation") == "suspicious", 0.7)
        .when((num("malicious") > 0) & (num("total") > 0) & (F.try_divide(num("malicious"), num("total")) > 0.3), 0.9)
        .when(num("count") > 0, 0.85).when(text("found") == "true", 0.75)
        .when(text("suspicious").startswith("[") & (text("suspicious") != "[]"), 0.8)
        .when(text("intel.builtin_match") == "true", F.when(num("intel.confidence") > 0, num("intel.confidence")).otherwise(0.8))
        .when(F.contains(text("error"), F.lit("not configured")), 0.0).when(text("error") != "", 0.1).otherwise(0.5)
    )


def confidence(results: DataFrame, by: str, output: str) -> DataFrame:
    """Mean score of the results of each investigation; results that are no JSON object do not count."""
    ok = results.where(F.try_parse_json(output).isNotNull() & F.ltrim(F.col(output)).startswith("{"))
    return ok.groupBy(by).agg(F.round(F.avg(score_result(F.col(output))), 6).alias("confidence"), F.count("*").alias("results"))


def classify_intent(text: Column, triggers: list[tuple[str, str]]) -> Column:
    """The playbook of the first trigger (in the given order) contained in the text, else by key words, else hash-lookup."""
    low = F.lower(text)
    out = F.lit("hash-lookup")
    fallback = [(("url", "link"), "url-scan"), (("ip", "address"), "ip-reputation"), (("file", "malware", "exe"), "file-analysis"), (("hash", "sha256", "md5"), "hash-lookup")]
    for words, name in fallback:
        for w in words:
            out = F.when(F.contains(low, F.lit(w)), name).otherwise(out)
    for word, name in reversed(triggers):
        out = F.when(F.contains(low, F.lit(word.lower())), name).otherwise(out)
    return out

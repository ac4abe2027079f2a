"""Streaming forms: rules with windows and suppression, first-seen, windowed counts, kill-chain and flood inputs, sinks.

What the batch operators compute from a bounded look-back is computed on a stream by micro-batches: a batch meets the
matches that the look-back still needs, kept as a table with a version for each batch, and only alerts of its own events
come out. State, counts and gates so are those of the batch operators - hot keys are split by time cells, nothing runs
in Python per key, and time is event time throughout. A batch that is repeated after a failure reads the version before it and
overwrites its own output, so each alert is written once.
"""

from __future__ import annotations

import time as clock
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators.rules import Rule, match_rules, suppress_matches, threshold_alerts


def stream_first_seen(events: DataFrame, keys: list[str], time: str, within: str) -> DataFrame:
    """The first event of each key; later copies within the watermark are dropped."""
    return events.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


def stream_counts(events: DataFrame, time: str, by: list[str], window: str, slide: str, late: str, threshold: int) -> DataFrame:
    """Windows whose count reaches the threshold, final once the watermark has passed them."""
    n = events.withWatermark(time, late).groupBy(F.window(time, window, slide), *by).agg(F.count("*").alias("events"))
    return n.where(F.col("events") >= threshold).select(*by, F.col("window.start").alias("window_start"), "events")


def stream_sessions(events: DataFrame, time: str, by: list[str], gap: str, late: str) -> DataFrame:
    """(by, session_start, session_end, events): events of a key (at least one column) without a pause longer than ``gap``."""
    n = events.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("events"))
    return n.select(*by, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "events")


class RuleStream:
    """The rule engine over a stream: ``start`` writes alerts below ``path``, a folder a batch, read by ``alerts``.

    An alert is an event whose rule fires given the events before it in time that have arrived with it or earlier. Events
    later than ``late_s`` behind the newest still fire where the kept matches let them; alerts written stay as they are.
    """

    def __init__(self, spark: SparkSession, path: str, rules: list[Rule], time: str, tie: str, late_s: int = 0):
        self.spark, self.path, self.rules, self.time, self.tie, self.late_s = spark, path.rstrip("/"), rules, time, tie, late_s
        self.look_back = max([r.window_s for r in rules] + [r.suppress_s for r in rules] + [0]) + late_s

    def _state(self, number: int) -> DataFrame | None:
        """The kept matches after the last batch before ``number``."""
        try:
            return self.spark.read.option("basePath", f"{self.path}/state").parquet(f"{self.path}/state/batch={number - 1}").drop("batch")
        except AnalysisException:
            return None

    def step(self, batch: DataFrame, number: int) -> None:
        """One micro-batch; safe to repeat."""
        new = match_rules(batch, self.rules).withColumn("__new", F.lit(True))
        old = self._state(number) if number else None
        both = new if old is None else new.unionByName(old.withColumn("__new", F.lit(False)))
        # what passed before passes again: it lies as far apart as suppression asks
        passed = suppress_matches(both, self.rules, self.time, self.tie)
        window = F.when(F.col("threshold") > 1, F.col("window_s")).otherwise(0)
        fired = threshold_alerts(passed, self.time, ["rule_id", "corr_key"], F.col("threshold"), window, lengths=[r.window_s for r in self.rules if r.threshold > 1])
        fired.where("__new").drop("__new").write.mode("overwrite").parquet(f"{self.path}/alerts/batch={number}")
        us = F.unix_micros(F.col(self.time).cast("timestamp"))
        newest = passed.agg(F.max(us)).first()[0]
        kept = passed.where(us > newest - self.look_back * 1_000_000) if newest is not None else passed
        kept.drop("__new").write.mode("overwrite").parquet(f"{self.path}/state/batch={number}")

    def start(self, events: DataFrame, checkpoint: str, **trigger):
        return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.step).trigger(**(trigger or {"availableNow": True})).start()

    def alerts(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/alerts").parquet(f"{self.path}/alerts/batch=*").drop("batch")


def to_tables(stream: DataFrame, path: str, checkpoint: str, name: str):
    """Batches appended to a table once each: a batch's folder is overwritten if it is repeated."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(write)


def send_batches(rows: DataFrame, send: Callable[[list[dict]], None], size: int = 100, attempts: int = 6, first_wait_s: float = 0.5, most_wait_s: float = 30.0, per_second: int = 500) -> None:
    """Hand ``rows`` to ``send`` in lists of ``size``, from every task by itself, at most ``per_second`` rows a task.

    A list that fails is sent again after a wait that doubles up to ``most_wait_s``; after ``attempts`` the task fails and
    Spark repeats it, so a receiver may see a list twice and should know it by its ids. Nothing is dropped.
    """

    def task(part: Iterable) -> None:
        held: list[dict] = []

        def flush() -> None:
            wait = first_wait_s
            for n in range(attempts):
                try:
                    send(list(held))
                    break
                except Exception:
                    if n + 1 == attempts:
                        raise
                    clock.sleep(wait)
                    wait = min(wait * 2, most_wait_s)
            clock.sleep(len(held) / per_second)
            held.clear()

        for row in part:
            held.append(row.asDict(recursive=True))
            if len(held) >= size:
                flush()
        if held:
            flush()

    rows.foreachPartition(task)

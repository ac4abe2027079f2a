"""Correlation of endpoint events: bursts, create-then-delete, first-seen, floods, kill chains, throttling, baselines."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.operators.gate import gate_events
from emberlog.operators.ordered import numbered, scan_in_order, time_cells, with_halo
from emberlog.operators.skew import hot_keys, join_lookup

#: Clamp of flood thresholds and the default where a type was not seen during warm-up.
FLOOD_MIN, FLOOD_MAX, FLOOD_DEFAULT = 20, 5000, 100


def _us(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def event_key(pid: Column, path: Column, ip: Column, port: Column, time: Column) -> Column:
    """What an endpoint event is about: process, file, connection, else its time."""
    return (
        F.when(pid.isNotNull(), F.concat(F.lit("pid:"), pid.cast("string")))
        .when(path.isNotNull(), F.concat(F.lit("file:"), F.substring(F.sha2(path, 256), 1, 8)))
        .when(ip.isNotNull(), F.concat_ws(":", F.lit("net"), ip, port.cast("string")))
        .otherwise(F.concat(F.lit("evt:"), F.unix_micros(time.cast("timestamp")).cast("string")))
    )


def burst_alerts(events: DataFrame, time: str, tie: str, kind: str, name: str, kinds: list[str], window_s: int, threshold: int, severity: int, suppress_ms: int, about: str) -> DataFrame:
    """Events of ``kinds`` whose trailing count reaches ``threshold`` and whose score (count * severity div threshold) is 3 or more, then gated per ``about``; events without time pass no gate."""
    # the count is over all entities, so it is split by time cells
    span = window_s * 1_000_000
    hit = time_cells(events.where(F.col(kind).isin(kinds)).withColumn("__us", _us(time)), "__us", span)
    n = hit.withColumn("in_window", F.count("*").over(Window.partitionBy("cell").orderBy("__us").rangeBetween(-(span - 1), 0))).where("own")
    fired = n.where(F.col("in_window") >= threshold).withColumn("score", F.expr(f"in_window * {severity} div {threshold}")).where("score >= 3").drop("__us", "cell", "own")
    return gate_events(fired, about, time, tie, suppress_ms * 1000).where("passes").withColumn("rule", F.lit(name)).drop("passes", "anchor_us")


def correlation_alerts(events: DataFrame, rules: list[dict], time: str, tie: str, kind: str, about: str) -> DataFrame:
    """``burst_alerts`` of each loaded correlation rule (``sources.feeds.load_correlation_rules``); a rule without event types takes all events."""
    out = None
    for r in rules:
        some = events if r["kinds"] else events.withColumn("__kind", F.lit("any"))
        one = burst_alerts(some, time, tie, kind if r["kinds"] else "__kind", r["name"], r["kinds"] or ["any"], r["window_s"], r["threshold"], r["severity"], r["suppress_ms"], about).drop("__kind")
        out = one if out is None else out.unionByName(one)
    return events.where(F.lit(False)).withColumns({"in_window": F.lit(0).cast("long"), "score": F.lit(0).cast("long"), "rule": F.lit("")}) if out is None else out


def suppressed(alerts: DataFrame, rule: str, time: str, tie: str, suppress_s: int) -> DataFrame:
    """Alerts that pass the rule's suppression."""
    return gate_events(alerts, rule, time, tie, suppress_s * 1_000_000).where("passes").drop("passes", "anchor_us")


def create_then_delete(events: DataFrame, path: str, time: str, tie: str, created: Column, deleted: Column, within_s: int) -> DataFrame:
    """Deletions less than ``within_s`` after the latest creation of the same path since its last deletion."""
    # nothing older than the span matters, so a busy path is split by time cells
    seen = time_cells(events.where(created | deleted).withColumns({"__c": created, "__us": _us(time)}), "__us", within_s * 1_000_000)
    w = Window.partitionBy(path, "cell").orderBy("__us", tie)
    prev = seen.withColumns({"was_created": F.lag("__c").over(w), "created_us": F.lag("__us").over(w)})
    return prev.where(F.col("own") & deleted & F.col("was_created") & (F.col("__us") - F.col("created_us") < within_s * 1_000_000)).drop("__c", "__us", "was_created", "cell", "own")


def first_seen(events: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """The first event of each key: one partial aggregate, no sort of a hot key."""
    cols = [c for c in events.columns if c not in keys]
    first = events.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(time, tie)).alias("__e"))
    return first.select(*keys, "__e.*").select(*events.columns)


def flood_thresholds(warmup: DataFrame, kind: str, warmup_s: int) -> DataFrame:
    """(kind, flood_threshold): three times the whole events a second of the warm-up, clamped."""
    per_s = F.floor(F.count("*") / warmup_s)
    return warmup.groupBy(kind).agg(F.least(F.greatest(per_s * 3, F.lit(FLOOD_MIN)), F.lit(FLOOD_MAX)).cast("long").alias("flood_threshold"))


def floods(events: DataFrame, thresholds: DataFrame, kind: str, time: str, window_s: int = 1, default: int = FLOOD_DEFAULT) -> DataFrame:
    """(kind, window_start, events, flood_threshold) of the windows with more events than the kind's threshold."""
    n = events.groupBy(kind, F.window(F.col(time).cast("timestamp"), f"{window_s} seconds")["start"].alias("window_start")).agg(F.count("*").alias("events"))
    n = n.join(thresholds, kind, "left").withColumn("flood_threshold", F.coalesce("flood_threshold", F.lit(default).cast("long")))
    return n.where(F.col("events") > F.col("flood_threshold"))


def flood_alerts(events: DataFrame, thresholds: DataFrame, kind: str, time: str, tie: str, window_s: int = 1, latch_s: int = 3, default: int = FLOOD_DEFAULT) -> DataFrame:
    """(kind, time, tie, in_window, flood_threshold): events at which the sliding count of their kind passes its threshold
    and no flood of any kind was reported within the latch before.

    The count is over the trailing window and, unlike the reference's, is not emptied with the latch: an event's count
    does not depend on earlier alerts. Thresholds are a row a kind.
    """
    span = window_s * 1_000_000
    cells = time_cells(events.where(F.col(time).isNotNull()).select(kind, time, tie, _us(time).alias("__us")), "__us", span)
    n = cells.withColumn("in_window", F.count("*").over(Window.partitionBy(kind, "cell").orderBy("__us").rangeBetween(-(span - 1), 0))).where("own").drop("cell", "own", "__us")
    n = join_lookup(n, thresholds, kind, "left")
    over = n.withColumn("flood_threshold", F.coalesce("flood_threshold", F.lit(default).cast("long"))).where(F.col("in_window") > F.col("flood_threshold"))
    one = over.withColumn("__all", F.lit("all"))
    return gate_events(one, "__all", time, tie, latch_s * 1_000_000).where("passes").drop("__all", "passes", "anchor_us")


def event_priority(kind: Column, severity: Column, alert: str = "alert", alert_from: int = 4) -> Column:
    """3 for alerts of at least that severity, 2 for other alerts and processes that start or end, else 1."""
    return F.when((kind == alert) & (severity >= alert_from), 3).when((kind == alert) | kind.isin("process_create", "process_terminate"), 2).otherwise(1)


def drain_order(events: DataFrame, priority: Column, time: str, tie: str, weights: dict[int, int] | None = None) -> DataFrame:
    """``events`` with ``priority`` and ``turn``: the weighted round in which each is sent.

    Of every round a class gets as many places as its weight (3, 2 and 1), in order of time; nothing is dropped and
    nothing spills into another class, as rows wait without a bound. Sort by turn, priority (falling) and time.
    """
    weights = weights or {3: 3, 2: 2, 1: 1}
    n = numbered(events.withColumn("priority", priority), "priority", [time, tie], "__row")
    places = F.lit(1)
    for k, w in weights.items():
        places = F.when(F.col("priority") == k, w).otherwise(places)
    return n.withColumn("turn", F.floor((F.col("__row") - 1) / places).cast("long")).drop("__row")


def dedup_key(kind: Column, pid: Column, path: Column, ip: Column, port: Column, proto: Column, time: Column) -> Column:
    """What makes an endpoint event a copy of another: its kind with process, file or connection, else its time."""
    return (
        F.when(pid.isNotNull() & (pid != 0), F.concat_ws(":", F.lit("proc"), pid.cast("string"), kind))
        .when(path.isNotNull(), F.concat_ws(":", F.lit("file"), path, kind))
        .when(ip.isNotNull(), F.concat_ws(":", F.lit("net"), ip, F.coalesce(port.cast("string"), F.lit("0")), F.coalesce(proto, F.lit("")), kind))
        .otherwise(F.concat(F.lit("ts:"), F.unix_micros(time.cast("timestamp")).cast("string")))
    )


def dedup_within(events: DataFrame, key: str, time: str, tie: str, ttl_s: int = 30) -> DataFrame:
    """Events whose key did not pass within the ``ttl_s`` before; with a copy held back the time to live does not begin anew."""
    return gate_events(events, key, time, tie, ttl_s * 1_000_000).where("passes").drop("passes", "anchor_us")


def hit_ratio(checked: DataFrame, hit: Column, by: list[str] | None = None) -> DataFrame:
    """(hits, misses, hit_ratio) of look-ups, by group if wanted."""
    n = checked.groupBy(*(by or [])).agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"))
    return n.withColumn("hit_ratio", F.round(F.col("hits") / (F.col("hits") + F.col("misses")), 6))


def in_order(steps: DataFrame, key: list[str], place: str, time: str, parts: int | None = None) -> DataFrame:
    """(key, steps, ordered): whether no step of a key is earlier than the one right before it in order of ``place``; a
    step without time is neither earlier nor later. Nulls are a key of their own."""
    rows = steps.select(*key, F.col(place).alias("__place"), _us(time).alias("__us")).withColumn("__k", F.to_json(F.struct(*key)))

    def step(state, t: pa.Table):
        before, now = t["__us"].to_pylist()[:-1], t["__us"].to_pylist()
        pairs = zip([state, *before], now)
        good = all(a is None or b is None or b >= a for a, b in pairs)
        return now[-1], t.slice(0, 1).select(key).append_column("n", pa.array([len(now)], pa.int64())).append_column("good", pa.array([good]))

    schema = T.StructType([*[steps.schema[k] for k in key], T.StructField("n", T.LongType()), T.StructField("good", T.BooleanType())])
    pieces = scan_in_order(rows, "__k", ["__place"], step, schema, parts)
    return pieces.groupBy(*key).agg(F.sum("n").alias("steps"), F.bool_and("good").alias("ordered"))


def kill_chains(events: DataFrame, pid: str, time: str, tie: str, is_file: Column, is_process: Column, is_network: Column, detail: str, window_s: int) -> DataFrame:
    """(pid, started_us, steps, confidence, linked): anchored chains of three or more steps that combine stages.

    A chain takes the events of a process until one comes more than ``window_s`` after its start. Confidence: 0.75 for
    all three stages, 0.5 for file and process, 0.4 for process and network, 0.1 for being in order (always so here),
    0.15 for each other process with a chain that shares a detail, 1 at most.
    """
    steps = events.where(F.col(pid).isNotNull()).withColumns({"f": is_file, "p": is_process, "n": is_network})
    anchored = gate_events(steps, pid, time, tie, window_s * 1_000_000, strict=True)
    chains = anchored.groupBy(pid, F.col("anchor_us").alias("started_us")).agg(F.count("*").alias("steps"), F.max("f").alias("f"), F.max("p").alias("p"), F.max("n").alias("n"))
    base = F.when(F.col("f") & F.col("p") & F.col("n"), 0.75).when(F.col("f") & F.col("p"), 0.5).when(F.col("p") & F.col("n"), 0.4)
    chains = chains.withColumn("base", base).where("steps >= 3 AND base IS NOT NULL")
    # how many processes share each detail: counted, not paired
    own = anchored.where(F.col(detail).isNotNull()).groupBy(pid, F.col("anchor_us").alias("started_us"), detail).agg(F.lit(1).alias("one"))
    users = own.join(chains.select(pid, "started_us"), [pid, "started_us"], "left_semi").groupBy(detail).agg(F.count_distinct(pid).alias("users"))
    linked = own.join(users, detail).groupBy(pid, "started_us").agg(F.sum(F.col("users") - 1).alias("linked"))
    out = chains.join(linked, [pid, "started_us"], "left").withColumn("linked", F.coalesce("linked", F.lit(0)).cast("long"))
    return out.select(pid, "started_us", "steps", F.least(F.lit(1.0), F.round(F.col("base") + 0.1 + 0.15 * F.greatest("linked", F.lit(0)), 6)).alias("confidence"), "linked")


def throttled(dismissals: DataFrame, rule: str, process: str, time: str, threshold: int = 10) -> DataFrame:
    """(rule, process, dismissals, last_seen) dismissed ``threshold`` times or more."""
    return dismissals.groupBy(rule, process).agg(F.count("*").alias("dismissals"), F.max(time).alias("last_seen")).where(F.col("dismissals") >= threshold)


def throttled_at(dismissals: DataFrame, checks: DataFrame, rule: str, process: str, time: str, tie: str, threshold: int = 10, idle_s: int = 300) -> DataFrame:
    """``checks`` (rule, process, time, tie) with ``throttled``: whether an alert at that time is held back.

    It is if ``threshold`` dismissals were counted and the last is at most ``idle_s`` old; a check that finds it older
    sets the count back to none. Dismissals at the time of a check come first. Rows without time are left out.
    """
    idle = idle_s * 1_000_000
    row = lambda df, d: df.where(F.col(time).isNotNull()).select(rule, process, time, tie, F.lit(d).alias("__d"))
    both = row(dismissals, 0).unionByName(row(checks, 1)).withColumns({"__us": _us(time), "__k": F.to_json(F.struct(rule, process))})

    def step(state, rows: pa.Table):
        count, last = state or (0, 0)
        held = []
        for t, check in zip(rows["__us"].to_pylist(), rows["__d"].to_pylist()):
            if not check:
                count, last = min(count + 1, threshold), t
            elif count >= threshold and t - last > idle:
                count = 0
            held.append(count >= threshold)
        kept = rows.append_column("throttled", pa.array(held)).filter(pc.equal(rows["__d"], 1))
        return (count, last), kept.select([rule, process, time, tie, "throttled"])

    schema = T.StructType([*[both.schema[c] for c in (rule, process, time, tie)], T.StructField("throttled", T.BooleanType())])
    return scan_in_order(both, "__k", ["__us", "__d", tie], step, schema)


def flapping(changes: DataFrame, path: str, time: str, tie: str, quiet_from: int = 3, reset_after: int = 10) -> DataFrame:
    """Changes with ``suppressed``: the fourth to eleventh change of a path are, then counting starts anew."""
    n = numbered(changes, path, [time, tie], "__row")
    return n.withColumn("suppressed", F.pmod(F.col("__row") - 1, F.lit(reset_after + 1)) + 1 > quiet_from).drop("__row")


def zscore_anomalies(samples: DataFrame, group: str, value: str, order: list[str], last: int = 100, z_limit: float = 3.0, ceiling: float = 7.0) -> DataFrame:
    """Each sample against the mean and population deviation of the ``last`` samples before it: ``z``, ``anomalous``.

    With fewer than three samples before it or a deviation under 0.1 the sample is anomalous above ``ceiling``.
    """
    g = samples.withColumn("__g", F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")))
    hot = hot_keys(g, "__g")
    stats = lambda df, w: df.withColumns({"n": F.count(value).over(w), "mean": F.avg(value).over(w), "sd": F.stddev_pop(value).over(w)})
    s = stats(g.where(~F.col("__g").isin(hot)) if hot else g, Window.partitionBy("__g").orderBy(*order).rowsBetween(-last, -1))
    if hot:  # a hot group is numbered and split into cells that repeat the ``last`` rows of the cell before
        cells = with_halo(numbered(g.where(F.col("__g").isin(hot)), "__g", order, "__row"), "__row", last)
        s = s.unionByName(stats(cells, Window.partitionBy("__g", "cell").orderBy("__row").rowsBetween(-last, -1)).where("own").drop("__row", "cell", "own"))
    s = s.drop("__g")
    usable = (F.col("n") >= 3) & (F.col("sd") >= 0.1)
    z = F.when(usable, F.abs(F.col(value) - F.col("mean")) / F.col("sd")).otherwise(0.0)
    return s.withColumn("z", z).withColumn("anomalous", F.when(usable, F.col("z") > z_limit).otherwise(F.col(value) > ceiling)).drop("n", "mean", "sd")



def decayed_mean(samples: DataFrame, group: str, value: str, order: list[str], share: float = 0.01, last: int = 100, hot_rows: int = 100_000) -> DataFrame:
    """Samples with ``decayed``: the mean of the ``last`` samples of the group so far, each pulled by ``share`` of the way
    to every sample after it.

    A sample k places back keeps (1 - share)^k of its distance, so the mean is a weighted sum over the frame and needs no
    state: with c = 1 - share, the value at place i is v[i] c^(n-i) + share * sum over j > i of v[j] c^(n-j).
    """
    c = 1.0 - share
    g = samples.withColumn("__g", F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")))
    hot = hot_keys(g, "__g", hot_rows)
    frame = lambda df, w: df.withColumn("__v", F.collect_list(F.col(value).cast("double")).over(w.rowsBetween(-(last - 1), 0)))
    held = frame(g.where(~F.col("__g").isin(hot)) if hot else g, Window.partitionBy("__g").orderBy(*order))
    if hot:  # cut into cells that repeat the ``last`` rows of the cell before
        cells = with_halo(numbered(g.where(F.col("__g").isin(hot)), "__g", order, "__row"), "__row", last)
        held = held.unionByName(frame(cells, Window.partitionBy("__g", "cell").orderBy("__row")).where("own").drop("__row", "cell", "own"))
    weight = lambda i: F.pow(F.lit(c), F.size("__v") - 1 - i)
    # v[j] counts for itself c^(n-j), and in each of the j samples before it share * c^(n-j)
    total = F.aggregate(F.transform("__v", lambda x, i: x * weight(i) * (1 + share * i)), F.lit(0.0), lambda a, x: a + x)
    return held.withColumn("decayed", total / F.size("__v")).drop("__v", "__g")

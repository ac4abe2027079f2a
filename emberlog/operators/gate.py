"""Greedy gating: of a sequence of events, the first passes, then the first at least ``gap`` later, and so on.

Suppression, latches and anchored windows are all of this kind. A window frame cannot express it, and a key with a
third of all events must not go through one task. So sequences are cut into range partitions, which one pass gates. At
the beginning of a partition the event that passed last is not known; all it may have been are followed side by side,
and from the first event at which they have all met everything is decided. Only the events before it are put aside.
Where they never meet (evenly spaced events), the partition tells its outgoing state as a step function of the incoming
one: at most as many steps as events within one gap, and where those are many the partition is asked for the one value
that matters. A fold over the partitions (not the rows) on the driver gives the incoming states, with which a second
pass gates what was put aside.
"""

from __future__ import annotations

import pickle
from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.operators.ordered import chunked
from emberlog.session import materialise

#: Steps that a partition may send to the driver.
MAX_STEPS = 10_000


def _next(t: np.ndarray, gap: int, strict: bool) -> np.ndarray:
    """For each event the index of the next that passes if it does."""
    return np.maximum(np.searchsorted(t, t + gap, "right" if strict else "left"), np.arange(len(t)) + 1)


def _walk(t: np.ndarray, gap: int, strict: bool, last: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(passes, time of the event that passed last) given the last time that passed before, if any."""
    nxt, kept = _next(t, gap, strict), np.zeros(len(t), bool)
    i = 0 if last is None else int(np.searchsorted(t, last + gap, "right" if strict else "left"))
    while i < len(t):
        kept[i] = True
        i = int(nxt[i])
    anchor = np.maximum.accumulate(np.where(kept, np.arange(len(t)), -1))
    return kept, np.where(anchor >= 0, t[np.maximum(anchor, 0)], -1 if last is None else last)


def _steps(t: np.ndarray, gap: int, strict: bool) -> tuple[list[int], list[int]]:
    """Incoming time (at most ``t[0]``) -> outgoing time: ``out[k]`` holds for incoming times up to ``upto[k]``; beyond all it stays as it is."""
    nxt = _next(t, gap, strict)
    out = np.zeros(len(t), np.int64)
    for i in range(len(t) - 1, -1, -1):
        out[i] = t[i] if nxt[i] >= len(t) else out[nxt[i]]
    # an incoming time x starts at the first event with t >= x + gap (strict: >), so event i serves x up to t[i] - gap
    upto = t - gap - (1 if strict else 0)
    some = int(np.searchsorted(upto, t[0], "left")) + 1  # the incoming time is not beyond the first event
    upto, out = upto[:some], out[:some]
    change = np.flatnonzero(np.append(out[1:] != out[:-1], True))
    return upto[change].tolist(), out[change].tolist()


class Meeting:
    """The times that may have passed last, over the events of a partition's first key, until all are the same."""

    def __init__(self, gap: int, strict: bool):
        self.gap, self.strict, self.first, self.unknown, self.times = gap, strict, None, True, deque()

    def at(self, t: list[int]) -> int:
        """The index of the event at which all meet, -1 if not among these."""
        times, gap = self.times, self.gap + (1 if self.strict else 0)
        for i, x in enumerate(t):
            if self.first is None:
                self.first = x
            passes = self.unknown
            while times and x >= times[0] + gap:
                times.popleft()
                passes = True
            if passes and (not times or times[-1] != x):
                times.append(x)
            if x >= self.first + gap:
                self.unknown = False
            if len(times) == 1 and not self.unknown and passes:
                return i
        return -1


def _key_bounds(keys: pa.Array) -> list[int]:
    new = pc.fill_null(pc.not_equal(keys[1:], keys[:-1]), True).to_numpy(zero_copy_only=False) if len(keys) > 1 else np.zeros(0, bool)
    return [0, *(np.flatnonzero(new) + 1).tolist(), len(keys)]


def _scan(gap: int, strict: bool, schema: pa.Schema):
    """Batches in order -> the same with passes (null: put aside) and anchor_us, and at the end a row that tells of the partition."""

    def run(batches):
        part, meeting, first, key, last, aside = TaskContext.get().partitionId(), Meeting(gap, strict), None, None, None, []
        for b in batches:
            if not b.num_rows:
                continue
            keys, t = b.column("__k"), b.column("__t").to_numpy()
            bounds, passes, anchors, known = _key_bounds(keys), np.zeros(len(t), bool), np.zeros(len(t), np.int64), np.ones(len(t), bool)
            for a, z in zip(bounds, bounds[1:]):
                k = keys[a].as_py()
                if k != key:
                    if first is None:
                        first = k
                    else:
                        meeting = None
                    key, last = k, None
                if meeting is not None:
                    met = meeting.at(t[a:z].tolist())
                    end = z if met < 0 else a + met
                    known[a:end] = False
                    aside.append(t[a:end])
                    a = end
                    if met >= 0:
                        meeting, last = None, None  # the event at which all meet passes
                if a < z:
                    passes[a:z], anchors[a:z] = _walk(t[a:z], gap, strict, last)
                    last = int(anchors[z - 1])
            cols = [*b.columns, pa.array(passes, mask=~known), pa.array(anchors, mask=~known), pa.array(np.full(len(t), part, np.int32)), pa.nulls(len(t), pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)
        if first is None:
            return
        steps = None
        if meeting is not None:
            steps = _steps(np.concatenate(aside), gap, strict)
            if len(steps[0]) > MAX_STEPS:
                steps = "ask"
        fresh = last
        if meeting is not None:
            fresh = int(_walk(np.concatenate(aside), gap, strict, None)[1][-1])
        row = [None] * (len(schema) - 2) + [part, pickle.dumps((first, key, fresh, steps))]
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

    return run


def gate_events(events: DataFrame, key: str, time: str, tie: str, gap_us: int, strict: bool = False, parts: int | None = None) -> DataFrame:
    """``events`` with ``passes`` and ``anchor_us`` (time of the event that passed last, this one included).

    ``key`` is text; null is a key of its own. Events go by time, then ``tie``. Without ``strict`` the next passes at
    ``gap_us`` or more after the last, with it only later than that. Events without time neither pass nor hold others
    up. No events: no rows.
    """
    us = F.unix_micros(F.col(time).cast("timestamp"))
    timed = events.withColumns({"__k": F.coalesce(F.col(key).cast("string"), F.lit("\x00")), "__t": us, "__tie": F.col(tie)})
    placed = chunked(timed.where(F.col("__t").isNotNull()), ["__k"], ["__t", "__tie"], parts)
    fields = [T.StructField(f.name, f.dataType) for f in placed.schema.fields]
    schema = T.StructType([*fields, T.StructField("passes", T.BooleanType()), T.StructField("anchor_us", T.LongType()), T.StructField("__part", T.IntegerType()), T.StructField("__told", T.BinaryType())])
    held = materialise(placed.mapInArrow(_arrow(_scan, gap_us, strict), schema), "gated")
    aside = held.where("__told IS NULL AND passes IS NULL")

    def ordered(table: pa.Table) -> pa.Table:
        return table.sort_by([("__t", "ascending"), ("__tie", "ascending")])

    def ask(part: int, state: int) -> int:
        def end(table: pa.Table) -> pa.Table:
            return pa.table({"state": pa.array([int(_walk(np.sort(table["__t"].to_numpy()), gap_us, strict, state)[1][-1])])})

        return aside.where(F.col("__part") == part).select("__part", "__t").groupBy("__part").applyInArrow(end, "state long").first()[0]

    incoming: dict[int, int] = {}
    before = None
    for r in sorted(held.where("__told IS NOT NULL").select("__part", "__told").collect(), key=lambda r: r["__part"]):  # one row a partition
        first, last, after, steps = pickle.loads(r["__told"])
        if before and before[0] == first:
            state = incoming[r["__part"]] = before[1]
            if steps == "ask":
                after = ask(r["__part"], state)
            elif steps is not None:
                k = int(np.searchsorted(np.array(steps[0], np.int64), state))
                after = steps[1][k] if k < len(steps[1]) else state
        before = (last, after)

    def apply(table: pa.Table) -> pa.Table:
        t = ordered(table)
        passes, anchors = _walk(t["__t"].to_numpy(), gap_us, strict, incoming.get(t["__part"][0].as_py()))
        return t.drop_columns(["passes", "anchor_us", "__k", "__t", "__tie", "__part", "__told"]).append_column("passes", pa.array(passes)).append_column("anchor_us", pa.array(anchors))

    out = T.StructType([*events.schema.fields, T.StructField("passes", T.BooleanType()), T.StructField("anchor_us", T.LongType())])
    decided = held.where("passes IS NOT NULL").select(*out.names)
    rest = timed.where(F.col("__t").isNull()).drop("__k", "__t", "__tie").withColumns({"passes": F.lit(False), "anchor_us": F.lit(None).cast("long")})
    return decided.unionByName(aside.groupBy("__part").applyInArrow(apply, out)).unionByName(rest)


def _arrow(make, gap: int, strict: bool):
    """The scan with its schema taken from the first batch, as Spark hands it over."""

    def run(batches):
        batches = iter(batches)
        for b in batches:
            schema = pa.schema([*b.schema, pa.field("passes", pa.bool_()), pa.field("anchor_us", pa.int64()), pa.field("__part", pa.int32()), pa.field("__told", pa.binary())])
            schema = pa.schema([f.with_nullable(True) for f in schema])

            def again(b=b):
                yield b
                yield from batches

            yield from make(gap, strict, schema)(again())

    return run

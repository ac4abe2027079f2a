"""Mixed timestamp formats and time zones normalised to one UTC instant.

Each value yields the array of all its valid interpretations (order of day and month, century, missing year, both
readings of a local time that occurs twice). The records of one source, in order of receipt, then form a chain,
and Viterbi picks the interpretations of least cost: being outside the window before receipt weighs most, then
switching the format and stepping back in time.

A record with a single interpretation left (readings that no neighbour could make up for are struck out at once) cuts
the chain exactly, so sources are cut into range partitions and a source with a third of all records spreads over many
tasks. What is open at the ends of a partition - from the last cut on, up to the first cut - is put aside; a table of
least costs from each reading of a piece's first record to each of its last one (min-plus) joins the pieces of any
number of partitions, so the instants are those of the whole chain wherever partitions end.
"""

from __future__ import annotations

import datetime as dt
import re
from functools import lru_cache
from zoneinfo import ZoneInfo

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.operators.ordered import chunked
from emberlog.session import materialise

#: Fixed values.
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
DAYS = "mon|tue|wed|thu|fri|sat|sun"
UNIVERSAL = {"z", "utc", "gmt", "ut"}
#: Costs: outside the window before receipt; another format than before; a step back in time.
OUTSIDE, SWITCH, BACKWARD = 100, 1, 2
EPOCH = dt.datetime(1970, 1, 1)

_TIME = r"(?P<H>\d{1,2}):(?P<M>\d{2})(?::(?P<S>\d{2})(?:[.,](?P<f>\d{1,9}))?)?(?:\s*(?P<ap>[ap])\.?m\.?)?"
_ZONE = r"\s*(?P<z>[+-]\d{2}(?::?\d{2})?|[A-Za-z]{1,5})?"
_MON = r"(?P<mon>jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
FORMATS = [
    (name, re.compile(pattern + r"\Z", re.IGNORECASE | re.ASCII))
    for name, pattern in (
        ("epoch", r"(?P<sec>\d{10})(?:[.,](?P<f>\d{1,9})|(?P<sub>\d{3}|\d{6}|\d{9}))?"),
        ("packed", r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})[T ]?(?P<H>\d{2})(?P<M>\d{2})(?P<S>\d{2})(?:[.,](?P<f>\d{1,9}))?" + _ZONE),
        ("year_first", r"(?P<y>\d{4})(?P<sep>[-/.])(?P<m>\d{1,2})(?P=sep)(?P<d>\d{1,2})[T ]\s*" + _TIME + _ZONE),
        ("figures", r"(?P<a>\d{1,2})(?P<sep>[-/.])(?P<b>\d{1,2})(?P=sep)(?P<c>\d{4}|\d{2}),?[T ]\s*" + _TIME + _ZONE),
        ("access_log", r"(?P<d>\d{1,2})/" + _MON + r"/(?P<y>\d{4}):" + _TIME + _ZONE),
        ("day_month", r"(?:(?:" + DAYS + r")[a-z]*,?\s+)?(?P<d>\d{1,2})[\s-]+" + _MON + r"[\s-]+(?P<y>\d{4}),?\s+" + _TIME + _ZONE),
        ("month_day", r"(?:(?:" + DAYS + r")[a-z]*,?\s+)?" + _MON + r"\s+(?P<d>\d{1,2})(?:,?\s+(?P<y>\d{4}))?,?\s+" + _TIME + _ZONE),
        ("ctime", r"(?:" + DAYS + r")[a-z]*\s+" + _MON + r"\s+(?P<d>\d{1,2})\s+" + _TIME + r"(?:\s+(?P<z>[+-]\d{2}:?\d{2}|[A-Za-z]{1,5}))?\s+(?P<y>\d{4})"),
    )
]
NAIVE_WRAP = " \t\r\n\"'[](){}<>"


@lru_cache(1024)
def _zone(name: str | None):
    try:
        return ZoneInfo(name) if name else None
    except (KeyError, ValueError, OSError):
        return None


def _us(t: dt.datetime) -> int:
    d = t - EPOCH
    return (d.days * 86400 + d.seconds) * 1_000_000 + d.microseconds


def _utc(t: dt.datetime, zone_text: str | None, zone) -> list[int]:
    """The instants a local time can mean: an offset or zone letters in the text win, else the source's zone."""
    if zone_text:
        if zone_text[0] in "+-":
            digits = zone_text[1:].replace(":", "").ljust(4, "0")
            if int(digits[2:]) > 59 or int(digits[:2]) > 18:
                return []
            shift = (int(digits[:2]) * 60 + int(digits[2:])) * 60_000_000
            return [_us(t) - (shift if zone_text[0] == "+" else -shift)]
        if zone_text.lower() in UNIVERSAL:
            return [_us(t)]
    if zone is None:
        return []
    found: dict[int, None] = {}
    named: dict[int, None] = {}
    for fold in (0, 1):
        local = t.replace(tzinfo=zone, fold=fold)
        off = local.utcoffset()
        if fold and off > first:  # a skipped time: only the offset in force before the skip
            break
        first = off
        at = _us(t) - (off.days * 86400 + off.seconds) * 1_000_000
        found[at] = None
        if zone_text and (local.tzname() or "").lower() == zone_text.lower():
            named[at] = None
    return list(named or found)


def interpretations(text: str | None, zone_name: str | None, date_order: str | None, received: int | None) -> list[tuple[int, str]]:
    """All valid (utc_us, format) of a text; none if it denotes no time.

    All-figure dates that do not begin with a four-digit year follow ``date_order``; without one, all orders are
    given. Two-digit years are 20xx. A missing year is the latest that does not put the time after ``received``.
    """
    if text is None:
        return []
    text = text.strip(NAIVE_WRAP)
    for name, pattern in FORMATS:
        m = pattern.match(text)
        if not m:
            continue
        g = m.groupdict()
        us = int((g.get("f") or "0").ljust(6, "0")[:6])
        if name == "epoch":
            sub = g["sub"]
            return [(int(g["sec"]) * 1_000_000 + (int(sub.ljust(6, "0")[:6]) if sub else us), name if not sub else f"{name}{len(sub)}")]
        hour = int(g["H"])
        if g.get("ap"):
            if not 1 <= hour <= 12:
                return []
            hour = hour % 12 + (12 if g["ap"].lower() == "p" else 0)
        clock = (hour, int(g["M"]), int(g["S"] or 0), us)
        if name == "figures":
            a, b, c = g["a"], g["b"], g["c"]
            dates = []
            for order in [date_order] if date_order in ("dmy", "mdy", "ymd") else ["dmy", "mdy", "ymd"]:
                if order == "ymd" and len(c) == 2:
                    y, mo, d = a, b, c
                else:  # a four-digit year at the end leaves day first unless the source writes the month first
                    y, (d, mo) = c, (a, b) if order == "dmy" or order == "ymd" and int(b) <= 12 else (b, a)
                dates.append((int(y) + (2000 if len(y) == 2 else 0), int(mo), int(d), order))
        else:
            mo = MONTHS[g["mon"].lower()] if g.get("mon") else int(g["m"])
            dates = [(int(g["y"]) if g["y"] else None, mo, int(g["d"]), "")]
        zone, out = _zone(zone_name), []
        for y, mo, d, order in dates:
            years = [y]
            if y is None:
                if received is None:
                    continue
                last = (EPOCH + dt.timedelta(microseconds=received)).year + 1
                years = range(last, max(0, last - 12), -1)
            for year in years:
                try:
                    at = _utc(dt.datetime(year, mo, d, *clock), g.get("z"), zone)
                except (ValueError, OverflowError):
                    continue
                if y is None:
                    at = [x for x in at if x <= received]
                if at:
                    out.extend((x, f"{name}{order}") for x in at)
                    break
        return out
    return []


Option = tuple[int, str, int]  # instant, format, cost of being outside the window


def weighed(options: list[tuple[int, str]], received: int | None, window_us: int) -> list[Option]:
    """Options with their costs, without those that no neighbours could make up for."""
    costs = [OUTSIDE if received is not None and not 0 <= received - at <= window_us else 0 for at, _ in options]
    least = min(costs)
    return [(at, form, c - least) for (at, form), c in zip(options, costs) if c <= least + 2 * (SWITCH + BACKWARD)]


def _step(a: Option, b: Option, window_us: int) -> int:
    return (SWITCH if a[1] != b[1] else 0) + (BACKWARD if b[0] < a[0] - window_us else 0)


def forward(nodes: list[list[Option]], window_us: int, before: tuple[list[Option], list[int]] | None = None) -> tuple[list[int], list[list[int]]]:
    """Least costs of paths that end in each option of the last node, and for each node the option before (ties: the first)."""
    options, costs = before or ([], [])
    backs = []
    for node in nodes:
        new, back = [], []
        for o in node:
            steps = [c + _step(p, o, window_us) for p, c in zip(options, costs)]
            i = min(range(len(steps)), key=steps.__getitem__) if steps else -1
            back.append(i)
            new.append(o[2] + (steps[i] if steps else 0))
        options, costs = node, new
        backs.append(back)
    return costs, backs


def backward(backs: list[list[int]], last: int) -> tuple[list[int], int]:
    """The option of each node on the path that ends in ``last``, and the option of the node before the first."""
    path = []
    for back in reversed(backs):
        path.append(last)
        last = back[last]
    return path[::-1], last


def best_end(node: list[Option], costs: list[int]) -> int:
    return min(range(len(costs)), key=lambda k: (costs[k], node[k][0]))


class Chain:
    """The records of one source as one chain: ``settle`` gives (record, utc_us) on the path of least cost."""

    def __init__(self, window_us: int):
        self.window, self.records, self.nodes = window_us, [], []

    def add(self, record: int, options: list[tuple[int, str]], received: int | None) -> None:
        if options:
            self.records.append(record)
            self.nodes.append(weighed(options, received, self.window))

    def settle(self) -> list[tuple[int, int]]:
        if not self.nodes:
            return []
        costs, backs = forward(self.nodes, self.window)
        path, _ = backward(backs, best_end(self.nodes[-1], costs))
        return [(r, o[i][0]) for r, o, i in zip(self.records, self.nodes, path)]


class Source:
    """The records of one source in a partition: settled between cuts, put aside at its ends."""

    def __init__(self, name, first: bool, window_us: int):
        self.name, self.first, self.window = name, first, window_us  # first: the partition before may hold the source too
        self.nodes: list[tuple[int, list[Option]]] = []
        self.cut = False  # whether a record with one reading was met

    def add(self, record: int, options: list[Option], done: list, aside: list) -> None:
        self.nodes.append((record, options))
        if len(options) > 1:
            return
        if self.cut or not self.first:
            self._settle(done, 1 if self.cut else 0, 0)
        else:
            aside.append(("head", self.name, self.nodes, 0, 1))
            done.append((record, options[0][0]))
        self.nodes, self.cut = self.nodes[-1:], True

    def _settle(self, done: list, skip: int, last: int) -> None:
        _, backs = forward([o for _, o in self.nodes], self.window)
        path, _ = backward(backs, last)
        done.extend((r, o[i][0]) for (r, o), i in list(zip(self.nodes, path))[skip:])

    def finish(self, done: list, aside: list, last: bool) -> None:
        """``last``: the partition after may hold the source too."""
        known = 1 if self.cut else 0
        if not last and (self.cut or not self.first):
            nodes = [o for _, o in self.nodes]
            if nodes:
                costs, _ = forward(nodes, self.window)
                self._settle(done, known, best_end(nodes[-1], costs))
        elif self.nodes:
            role = "tail" if self.cut or not self.first else "whole" if last else "head"
            aside.append((role, self.name, self.nodes, known, 0))


OPEN = "part int, role string, source long, place int, record long, utc_us long, ats array<long>, forms array<string>, costs array<int>"
_OPEN_TYPES = [pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32())]


def _run(window_us: int):
    """Rows with a null role are settled; of those put aside, ``utc_us`` is given where the record has one reading (and came out already)."""

    def run(batches):
        part, now, done, aside, first = TaskContext.get().partitionId(), None, [], [], True

        def rows():
            out = [(part, None, None, None, r, at, None, None, None) for r, at in done]
            for role, name, nodes, known_first, known_last in aside:
                for i, (r, options) in enumerate(nodes):
                    known = known_first and i == 0 or known_last and i == len(nodes) - 1
                    out.append((part, role, name, i, r, options[0][0] if known else None, *[list(c) for c in zip(*options)]))
            done.clear(), aside.clear()
            cols = list(zip(*out)) or [()] * len(_OPEN_TYPES)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _OPEN_TYPES)], names=[x.split()[0] for x in OPEN.split(", ")])

        for b in batches:
            cols = [b.column(c) for c in ("source", "record", "text", "zone_name", "date_order")]
            received = b.column("received").cast(pa.int64()).to_pylist()
            for s, record, text, zone, order, at in zip(*[c.to_pylist() for c in cols], received):
                if now is None or s != now.name:
                    if now is not None:
                        now.finish(done, aside, False)
                        first = False
                    now = Source(s, first, window_us)
                options = interpretations(text, zone, order, at)
                if options:
                    now.add(record, weighed(options, at, window_us), done, aside)
            yield rows()
        if now is not None:
            now.finish(done, aside, True)
        yield rows()

    return run


def _nodes(table: pa.Table) -> tuple[list[int], list[int | None], list[list[Option]]]:
    t = table.sort_by("place")
    return t["record"].to_pylist(), t["utc_us"].to_pylist(), [list(zip(*x)) for x in zip(t["ats"].to_pylist(), t["forms"].to_pylist(), t["costs"].to_pylist())]


def _join_aside(aside: DataFrame, window_us: int) -> DataFrame:
    """(record, utc_us) of the records put aside: pieces are joined by their tables of least costs, one or two a partition."""

    def describe(table: pa.Table) -> pa.Table:
        _, _, nodes = _nodes(table)
        costs = []
        for k in range(len(nodes[0])):
            far = [o if i == k else (o[0], o[1], 10**15) for i, o in enumerate(nodes[0])]
            costs += forward([far, *nodes[1:]], window_us)[0]
        ends = [[list(c) for c in zip(*node)] for node in (nodes[0], nodes[-1])]
        row = [table["part"][0].as_py(), table["role"][0].as_py(), table["source"][0].as_py(), ends[0][0], ends[0][1], ends[1][0], ends[1][1], costs]
        kinds = [pa.int32(), pa.string(), pa.int64(), *[pa.list_(pa.int64()), pa.list_(pa.string())] * 2, pa.list_(pa.int64())]
        return pa.table([pa.array([v], t) for v, t in zip(row, kinds)], names=["part", "role", "source", "first_at", "first_form", "last_at", "last_form", "costs"])

    pieces = aside.groupBy("part", "role", "source").applyInArrow(describe, "part int, role string, source long, first_at array<long>, first_form array<string>, last_at array<long>, last_form array<string>, costs array<long>").collect()
    before: dict[tuple, tuple | None] = {}  # what leads into a piece: the options and least costs at the end of the piece before
    chains: list[list] = []
    for p in sorted(pieces, key=lambda p: (p["part"], p["role"] == "tail")):
        last = chains[-1][-1] if chains else None
        joined = last is not None and last["role"] != "head" and p["role"] != "tail" and last["source"] == p["source"]
        if not joined:
            chains.append([])
        first, end = [(a, f, 0) for a, f in zip(p["first_at"], p["first_form"])], [(a, f, 0) for a, f in zip(p["last_at"], p["last_form"])]
        lead = before[p["part"], p["role"]] = (state[0], state[1]) if joined else None
        into = [min(c + _step(o, k, window_us) for o, c in zip(*lead)) if lead else 0 for k in first]
        table = np.array(p["costs"], np.int64).reshape(len(first), len(end))
        costs = (np.array(into, np.int64)[:, None] + table).min(0)
        state = (end, (costs - costs.min()).tolist())  # only differences matter further on
        chains[-1].append({**p.asDict(), "ends": state})
    joined_parts = {(p["part"], p["role"]) for c in chains for p in c[1:]}

    def entries(table: pa.Table) -> pa.Table:
        """For each option at the end of a piece the option that its path takes at the end of the piece before."""
        part, role = table["part"][0].as_py(), table["role"][0].as_py()
        _, _, nodes = _nodes(table)
        _, backs = forward(nodes, window_us, before[part, role])
        came = [backward(backs, j)[1] for j in range(len(nodes[-1]))]
        return pa.table([pa.array([part], pa.int32()), pa.array([role], pa.string()), pa.array([came], pa.list_(pa.int32()))], names=["part", "role", "came"])

    came = {}
    if joined_parts:
        some = aside.where(F.concat_ws(":", "part", "role").isin([f"{a}:{b}" for a, b in joined_parts]))
        came = {(r["part"], r["role"]): r["came"] for r in some.groupBy("part", "role", "source").applyInArrow(entries, "part int, role string, came array<int>").collect()}
    exits: dict[tuple, int] = {}
    for chain in chains:
        j = best_end(*chain[-1]["ends"])
        for p in reversed(chain):
            exits[p["part"], p["role"]] = j
            j = came[p["part"], p["role"]][j] if (p["part"], p["role"]) in came else -1

    def settle(table: pa.Table) -> pa.Table:
        part, role = table["part"][0].as_py(), table["role"][0].as_py()
        records, known, nodes = _nodes(table)
        _, backs = forward(nodes, window_us, before[part, role])
        path, _ = backward(backs, exits[part, role])
        out = [(r, o[i][0]) for r, k, o, i in zip(records, known, nodes, path) if k is None]
        return pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["record", "utc_us"])

    return aside.groupBy("part", "role", "source").applyInArrow(settle, "record long, utc_us long")


def normalise_instants(
    records: DataFrame, record: str, source: str, text: str, received: str, zones: DataFrame, zone_name: str = "zone_name", date_order: str = "date_order", window_minutes: int = 20, parts: int | None = None
) -> DataFrame:
    """(record, utc_us): one row for each record whose text denotes a time; ``zones`` has one row a ``source``.

    Precision beyond microseconds is cut. Null, blank and unusable texts yield no row; repeated rows of a record
    count once (the least row); a source without a row in ``zones`` gives only times with a zone of their own; null
    ``received`` gives no window and leaves texts without year unread. Only the named columns are read.
    """
    once = records.groupBy(F.col(record).cast("long").alias("record")).agg(F.min(F.struct(F.col(source).cast("long").alias("source"), F.col(text).alias("text"), F.col(received).alias("received"))).alias("v")).select("record", "v.*")
    z = zones.select(F.col(source).cast("long").alias("source"), F.col(zone_name).alias("zone_name"), F.col(date_order).alias("date_order"))
    rows = once.where(F.col("text").isNotNull()).join(z, "source", "left")
    window_us = window_minutes * 60_000_000
    held = materialise(chunked(rows, ["source"], ["received", "record"], parts).mapInArrow(_run(window_us), OPEN), "instants")
    aside = _join_aside(held.where("role IS NOT NULL"), window_us)
    return held.where("role IS NULL").select("record", "utc_us").unionByName(aside).withColumnRenamed("record", record)

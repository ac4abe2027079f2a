"""Deeply nested records turned into flat tables with parent-child links.

Columnar shredding: a batch of records is walked once, and each leaf path gets a column of (repetition level,
definition level, value). The repeated ancestors are nested as record, event, entity, child entity; the repetition
level of an entry says at which of these it repeats (0: a new record), the definition level how much of the path is
there. The tables are rebuilt per repeated ancestor from the levels alone: the record, the event's number, the
parent's position and the own position are running counts that restart where the repetition level drops.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Definition levels of an entity's own column, above those of what it lies in: the place exists / holds an object /
#: the object has at least one key. A leaf that is there has one more.
PLACE, OBJECT, FILLED, LEAF = 1, 2, 3, 4


@dataclass(frozen=True)
class Entity:
    """A repeated ancestor: ``path`` of names below the event or the parent entity; the last may be one object or a list."""

    name: str
    path: tuple[str, ...]
    parent: str = ""


#: The child objects of audit and sensor events.
ENTITIES = (
    Entity("object_ref", ("objectref",)),
    Entity("response_status", ("responsestatus",)),
    Entity("cause", ("details", "causes"), "response_status"),
    Entity("alert", ("alert",)),
    Entity("dns", ("dns",)),
    Entity("answer", ("answers",), "dns"),
)
MARKS = frozenset({"event_type", "auditid"} | {e.path[0] for e in ENTITIES if not e.parent})


def _get(obj, name: str):
    """The member called ``name`` in any letter case; of several the first that is not null."""
    found = None
    for k, v in obj.items():
        if k.lower() == name and (found is None):
            found = v
    return found


def _parsed(payload: str) -> list:
    """The JSON values of a text: one, or one a line; none if unreadable."""
    text = payload.lstrip("\ufeff \t\r\n")
    try:
        return [json.loads(text)]
    except (ValueError, RecursionError):
        lines = [x for x in text.split("\n") if x.strip()]
        try:
            return [json.loads(x) for x in lines] if len(lines) > 1 else []
        except (ValueError, RecursionError):
            return []


def events_of(payload: str | None) -> list[dict]:
    """The events of a payload: one object, a list, one a line, or wrapped (``items``, ``_source``, text in ``log``) to any depth. Unreadable: none."""
    out: list[dict] = []
    todo = _parsed(payload)[::-1] if payload is not None else []
    while todo:
        v = todo.pop()
        if isinstance(v, list):
            todo.extend(reversed(v))
        elif isinstance(v, dict) and v:
            if MARKS.isdisjoint(k.lower() for k in v):
                inner = _get(v, "items")
                if not isinstance(inner, list):
                    inner = _get(v, "_source")
                if isinstance(inner, (list, dict)):
                    todo.append(inner)
                    continue
                if isinstance(log := _get(v, "log"), str):
                    todo.extend(reversed(_parsed(log)))  # a text in a text is shorter, so this ends
                    continue
            out.append(v)
    return out


def _places(v) -> list:
    """The list places a value stands for: a list's own, one for a lone object, those of either written as JSON text."""
    if isinstance(v, str) and v.lstrip()[:1] in ("[", "{"):
        try:
            v = json.loads(v)
        except (ValueError, RecursionError):
            return []
    if isinstance(v, list):
        return v
    return [v] if isinstance(v, dict) else []


class Column:
    """One path's entries: repetition levels, definition levels, values."""

    __slots__ = ("rep", "definition", "values")

    def __init__(self):
        self.rep: list[int] = []
        self.definition: list[int] = []
        self.values: list[str | None] = []

    def put(self, rep: int, definition: int, value: str | None = None) -> None:
        self.rep.append(rep)
        self.definition.append(definition)
        self.values.append(value)


class Shredder:
    """Columns of a batch: one of each entity, and with ``leaves`` one of each key of its objects."""

    def __init__(self, entities: Sequence[Entity], leaves: bool):
        self.entities, self.leaves = entities, leaves
        self.below = {e.name: [c for c in entities if c.parent == e.name] for e in entities}
        self.tops = [e for e in entities if not e.parent]
        self.level = {e.name: 2 for e in self.tops}  # record 0, event 1
        for e in entities:
            if e.parent:
                self.level[e.name] = self.level[e.parent] + 1
        # definition level of a missing place: what it lies in is there as an object
        self.base = {name: 1 + FILLED * (level - 2) for name, level in self.level.items()}
        self.own = {e.name: Column() for e in entities}
        self.leaf: dict[str, dict[str, Column]] = {e.name: {} for e in entities}

    def _put(self, e: Entity, rep: int, definition: int, obj: dict | None) -> None:
        own, leaf = self.own[e.name], self.leaf[e.name]
        if self.leaves:
            for k in obj or ():
                if k not in leaf:  # first met: so far its column is that of the entity, without values
                    c = leaf[k] = Column()
                    c.rep, c.definition, c.values = own.rep.copy(), own.definition.copy(), [None] * len(own.rep)
            for k, c in leaf.items():
                v = obj.get(k) if obj else None
                if v is None:
                    c.put(rep, definition)
                else:
                    c.put(rep, self.base[e.name] + LEAF, v if isinstance(v, str) else json.dumps(v))
        own.put(rep, definition)

    def _walk(self, e: Entity, obj, rep: int, outer: int) -> None:
        """The places of ``e`` within ``obj``; lists on the way to the last name are gone through in order."""
        found = [obj] if isinstance(obj, dict) else []
        for name in e.path[:-1]:
            found = [x for v in found for x in _places(_get(v, name)) if isinstance(x, dict)]
        places = [p for v in found for p in _places(_get(v, e.path[-1]))]
        if not places:
            self._put(e, rep, outer, None)
            for c in self.below[e.name]:
                self._walk(c, None, rep, outer)
        base = self.base[e.name]
        for k, p in enumerate(places):
            at, is_object = self.level[e.name] if k else rep, isinstance(p, dict)
            definition = base + (PLACE if not is_object else FILLED if p else OBJECT)
            self._put(e, at, definition, p if is_object else None)
            for c in self.below[e.name]:
                self._walk(c, p if is_object else None, at, min(definition, self.base[c.name]))

    def add(self, events: Sequence[dict]) -> None:
        """One record."""
        for e in self.tops:
            for i, event in enumerate(events):
                self._walk(e, event, 1 if i else 0, 1)
            if not events:
                self._walk(e, None, 0, 0)

    def table(self, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(record, event number, parent's position, own position, entry) of the objects with at least one key."""
        rep = np.array(self.own[name].rep, np.int64)
        definition = np.array(self.own[name].definition, np.int64)
        at, own = np.arange(len(rep)), self.level[name]

        def position(level: int) -> np.ndarray:
            """Running count of entries that repeat at ``level`` or above since the last that repeats further out."""
            if not len(rep):
                return at
            count = np.cumsum(rep <= level)
            start = np.maximum.accumulate(np.where(rep < level, at, 0))
            return count - count[start] + 1

        mine = np.flatnonzero(definition >= self.base[name] + FILLED)
        parent = position(own - 1)[mine] if own > 2 else np.zeros(len(mine), np.int64)
        return (np.cumsum(rep == 0) - 1)[mine], position(1)[mine], parent, position(own)[mine], mine

    def fields(self, name: str, entries: np.ndarray) -> list[list[tuple[str, str]]]:
        """(key, value) pairs of the objects at ``entries``, from the leaf columns."""
        there = self.base[name] + LEAF
        cols = [(k, c.definition, c.values) for k, c in self.leaf[name].items()]
        return [[(k, values[i]) for k, definition, values in cols if definition[i] == there] for i in entries.tolist()]


def _run(entities: Sequence[Entity], leaves: bool):
    def run(batches):
        for b in batches:
            keys = b.column("key").to_numpy()
            sh = Shredder(entities, leaves)
            for payload in b.column("payload").to_pylist():
                sh.add(events_of(payload))
            for e in entities:
                record, event, parent, item, entry = sh.table(e.name)
                cols = [pa.array(keys[record]), pa.array(event), pa.array([e.name] * len(record), pa.string()), pa.array(parent), pa.array(item)]
                names = ["key", "event_no", "entity", "parent_no", "item_no"]
                if leaves:
                    cols.append(pa.array(sh.fields(e.name, entry), pa.map_(pa.string(), pa.string())))
                    names.append("fields")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def shred_records(records: DataFrame, key: str, payload: str, entities: Sequence[Entity] = ENTITIES, leaves: bool = False) -> DataFrame:
    """(key, event_no, entity, parent_no, item_no[, fields]): one row a child object with at least one key.

    ``event_no`` counts the events of a record from 1; ``item_no`` is the place in the list (1 for a lone object);
    ``parent_no`` the ``item_no`` of the parent, 0 where the event is the parent. Empty and odd places keep their
    position and yield nothing, as do null, empty and unreadable payloads. Repeated rows of a record yield its
    objects once. ``fields`` has the object's members, scalars as text and nested ones as JSON text; nulls are left out. No shuffle but that of the (narrow) distinct rows.
    """
    schema = "key long, event_no long, entity string, parent_no long, item_no long" + ", fields map<string,string>" * leaves
    rows = records.select(F.col(key).cast("long").alias("key"), F.col(payload).alias("payload")).where(F.col("payload").isNotNull()).mapInArrow(_run(entities, leaves), schema)
    links = ["key", "event_no", "entity", "parent_no", "item_no"]
    once = rows.groupBy(*links).agg(F.expr("any_value(fields)").alias("fields")) if leaves else rows.distinct()
    return once.withColumnRenamed("key", key)

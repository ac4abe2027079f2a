"""The core's problem operators against brute force, on nulls, ties, repeats, empty tables and clashing names."""

import datetime as dt
import json
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.functions.keys import folded
from emberlog.operators import exactly_once, instants, loglines, orphans, shred
from emberlog.plans import problem_queries
from emberlog.operators.gate import gate_events

# ------------------------------------------------------------------ dangling references


def two_key_tables(spark):
    child = spark.createDataFrame([(1, "a", "x"), (2, "a", None), (3, None, "y"), (4, None, None), (5, "b", "x"), (6, "q", None), (6, "q", None), (7, "", "x")], "id int, k1 string, k2 string")
    parent = spark.createDataFrame([("a", "x", 9), ("c", "y", 9), ("c", "y", 9), (None, "z", 9)], "k1 string, k2 string, id int")
    return child, parent, [(F.col("k1"), F.col("k1")), (F.col("k2"), F.col("k2"))]


@pytest.mark.parametrize("match, want", [("simple", [5, 7]), ("full", [2, 3, 5, 6, 6, 7]), ("partial", [5, 6, 6, 7])])
def test_orphans_by_match(spark, match, want):
    child, parent, on = two_key_tables(spark)
    out = orphans.find_orphans(child, parent, on, match)
    assert sorted(r.id for r in out.collect()) == want
    assert set(out.columns) == {"id", "k1", "k2", "null_mask", "orphan_reason"}


def test_orphans_empty_and_hot(spark):
    child, parent, on = two_key_tables(spark)
    assert orphans.find_orphans(child.where("false"), parent, on).count() == 0
    assert orphans.find_orphans(child, parent.where("false"), on).count() == 3
    # every key is hot: the broadcast way gives the same
    for match in orphans.MATCHES:
        a = orphans.find_orphans(child, parent, on, match).collect()
        b = orphans.find_orphans(child, parent, on, match, hot_rows=1).collect()
        assert sorted(map(str, a)) == sorted(map(str, b))


def test_orphans_later_and_deleted(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    child = spark.createDataFrame([("1", "P1 ", t(2)), ("2", "p2", t(2)), ("3", "p2", None), ("4", "p3", t(2)), ("5", "p4", t(2)), ("6", " ", t(2)), ("7", "p5", t(2))], "id string, ref string, at timestamp_ntz")
    parent = spark.createDataFrame([("p1", t(2)), ("p2", t(3)), ("P2", t(4)), ("p3", None), ("p4", t(1)), ("p5", t(5)), ("p5", t(1))], "id string, at timestamp_ntz")
    gone = spark.createDataFrame([(" P4",)], "key string")
    out = orphans.find_orphans(child, parent, [(folded("ref"), folded("id"))], deleted=gone, deleted_on=[folded("key")], child_time=F.col("at"), parent_time=F.col("at"))
    assert sorted(r.id for r in out.collect()) == ["2", "5"]


# ------------------------------------------------------------------ exactly once


def brute_copies(rows):
    """Row numbers that are not the least of their component."""
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for col in range(1, len(rows[0])):
        seen = defaultdict(list)
        for r in rows:
            if r[col] is not None:
                seen[r[col]].append(r[0])
        for group in seen.values():
            for x in group[1:]:
                a, b = sorted((find(group[0]), find(x)))
                root[b] = a
    return sorted(x for x in root if find(x) != x)


@pytest.mark.parametrize("seed", [1, 2])
def test_copies_two_identifiers(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.choice([None, "hot", *[f"a{k}" for k in range(150)]]), r.choice([None, *[f"b{k}" for k in range(150)]])) for i in range(1, 180)]
    rows += [(i, f"c{i}", f"c{i + 1}") for i in range(200, 240)] + [(300 + i, f"c{i}", f"d{i}") for i in range(241, 200, -1)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "row_no long, a string, b string").withColumn("first", F.lit("clash")).withColumn("hi", F.lit(1))
    ids = [exactly_once.identifier(F.col("a")), exactly_once.identifier(F.col("b"))]
    for batches in (1, 3):
        got = exactly_once.first_copies(df, "row_no", ids, n_batches=batches, prefix_rows=40)
        assert sorted(x.row for x in got.collect()) == brute_copies(rows)


def test_copies_one_identifier_across_batches_and_merges(spark):
    r = random.Random(3)
    rows = [(i, r.choice([None, "hot", "hot", *[f"k{k}" for k in range(60)]])) for i in range(150)]
    df = spark.createDataFrame(rows, "row_no long, k string")
    got = exactly_once.first_copies(df, "row_no", [exactly_once.identifier(F.col("k"))], n_batches=5, merge_every=2, prefix_rows=20)
    assert sorted(x.row for x in got.collect()) == brute_copies(rows)
    assert exactly_once.first_copies(df.where("false"), "row_no", [exactly_once.identifier(F.col("k"))]).count() == 0


def test_binary_search_steps_over_equal_halves():
    hi, lo = np.array([1, 1, 1, 2, 5]), np.array([3, 4, 9, 1, 0])
    found = exactly_once.find_sorted(hi, lo, np.array([1, 1, 1, 2, 3, 9]), np.array([9, 5, 3, 1, 1, 1]))
    assert found.tolist() == [2, -1, 0, 3, -1, -1]


def test_p2_found_merges_runs(spark, monkeypatch):
    merged, merge = [], exactly_once.IdentifierIndex._merge_tiers

    def counted(self):
        merge(self)
        merged.append(self.merges)

    monkeypatch.setattr(exactly_once.IdentifierIndex, "_merge_tiers", counted)
    problem_queries.p2_found(spark, "/root/testdata/sf0.001").count()
    assert merged == [0, 1, 1] * 2  # one index a table, runs merged after the second delivery


@pytest.mark.parametrize("direct", [True, False])
def test_index_persists(spark, tmp_path, direct):
    """Ten deliveries over three openings of one index, keys in any order, some ingested again."""
    r, path = random.Random(4), f"file://{tmp_path}/index"
    rows = [(i, r.choice(["hot", *[f"k{k}" for k in range(90)]])) for i in range(300)]
    order = list(range(10))
    r.shuffle(order)
    merges = 0
    for opening in (order[:4], order[4:8], order[8:]):
        index = exactly_once.IdentifierIndex(spark, path, 300, prefix_rows=30, merge_every=2)
        index.direct = direct
        assert index.prefixes == 10
        for b in opening:
            df = spark.createDataFrame([x for x in rows if x[0] // 30 == b], "row long, k string")
            hi, lo = exactly_once.identifier(F.col("k"))
            index.ingest(df.select(hi.alias("hi"), lo.alias("lo"), "row"))
        merges += index.merges
        index.remove_merged()
    assert merges == 8 and [t for _, t in index.runs] == [1, 3] or [t for _, t in index.runs] == [3, 1]
    least = {}
    for i, k in rows:
        least.setdefault(k, i)
    assert sorted(x.row for x in index.firsts().collect()) == sorted(least.values())
    hi, lo = exactly_once.identifier(F.col("k"))
    df = spark.createDataFrame([*rows, (900, "new")], "row long, k string")
    found = {x.row: x["first"] for x in index.lookup(df.select(hi.alias("hi"), lo.alias("lo"), "row")).collect()}
    assert found == {i: least[k] for i, k in rows} | {900: None}


# ------------------------------------------------------------------ log lines

LINES = [
    (1, 1, "[Sun Aug 06 12:57:24.363358 2023] [dedup:info] [pid 5189] rule 65 matched", None),
    (1, 2, "  2023-08-06T12:00:00Z INFO indented", None),
    (1, 3, "", None),
    (1, 4, None, None),
    (1, 5, "I0806 12:57:29.699563       8 intel.cache:338] snapshot written", None),
    (1, 6, "{", {"program": "prog"}),
    (1, 7, '  "severity": "FATAL",', None),
    (1, 8, '  "timestamp": "2023-08-06T12:57:30.214Z",', None),
    (1, 9, '  "msg": "queue, full"', None),
    (1, 10, "}", None),
    (1, 11, "\tat io.x", None),
    (2, 1, "no entry yet", None),
    (2, 2, '{"time": "2023-08-06T12:00:00.5Z", "level": "Notice", "logger": "fim", "message": "m"}', None),
    (2, 3, "[06/Aug/2023:12:57:30 +0200] warning - text - here", {"program": "sync"}),
    (2, 4, "<113>Aug  6 12:57:31 vpn-12.corp dedup[42054]: user x", None),
    (2, 5, "<0>1 2023-08-06T12:57:32.846Z host - - - - boom", None),
    (2, 6, "ts=2023-08-06T12:57:33Z component=fim level=dbg msg=\"x y\"", None),
    (2, 7, "2023/08/06 12:57:34.335 (dedup) Information: config has level=debug", None),
    (2, 8, "2023-08-06 12:57:35,903 CRIT  [sync_handler] x", None),
    (2, 9, "2023-13-06 12:57:35,903 INFO [no_such_month] x", None),
]


def log_table(spark, extra=()):
    at = dt.datetime(2023, 8, 6, 12, 58)
    rows = [(f, n, at, raw, fields) for f, n, raw, fields in [*LINES, *extra]]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows + rows[:6], "file_no long, line_no long, read_at timestamp_ntz, raw string, fields map<string,string>")


def us(text):
    return int((dt.datetime.fromisoformat(text) - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))


@pytest.mark.parametrize("parts", [1, 30])
def test_log_entries(spark, parts):
    out = loglines.parse_entries(log_table(spark), "file_no", "line_no", "read_at", "raw", "fields", parts=parts)
    got = {(r.file_no, r.first_line): (r.last_line, r.ts_us, r.level, r.component, r.message) for r in out.collect()}
    assert got == {
        (1, 1): (4, us("2023-08-06T12:57:24.363358"), "info", "dedup", "rule 65 matched\n  2023-08-06T12:00:00Z INFO indented\n\n"),
        (1, 5): (5, us("2023-08-06T12:57:29.699563"), "info", "intel.cache", "snapshot written"),
        (1, 6): (11, us("2023-08-06T12:57:30.214"), "fatal", "prog", "queue, full\n\tat io.x"),
        (2, 2): (2, us("2023-08-06T12:00:00.5"), "info", "fim", "m"),
        (2, 3): (3, us("2023-08-06T10:57:30"), "warn", "sync", "text - here"),
        (2, 4): (4, us("2023-08-06T12:57:31"), "fatal", "dedup", "user x"),
        (2, 5): (5, us("2023-08-06T12:57:32.846"), "fatal", None, "boom"),
        (2, 6): (6, us("2023-08-06T12:57:33"), "debug", "fim", 'msg="x y"'),
        (2, 7): (7, us("2023-08-06T12:57:34.335"), "info", "dedup", "config has level=debug"),
        (2, 8): (9, us("2023-08-06T12:57:35.903"), "fatal", "sync_handler", "x\n2023-13-06 12:57:35,903 INFO [no_such_month] x"),
    }


def test_log_entries_empty_and_missing_year(spark):
    assert loglines.parse_entries(log_table(spark).where("false"), "file_no", "line_no", "read_at", "raw", "fields").count() == 0
    df = spark.createDataFrame([(1, 1, dt.datetime(2024, 1, 1, 0, 0, 5), "<13>Dec 31 23:59:59 h app: x"), (1, 2, dt.datetime(2025, 1, 1), "<13>Feb 29 00:00:00 h app: x")], "f long, l long, r timestamp_ntz, raw string")
    out = loglines.parse_entries(df, "f", "l", "r", "raw")
    assert sorted(r.ts_us for r in out.collect()) == [us("2023-12-31T23:59:59"), us("2024-02-29T00:00:00")]


def test_log_headers_of_any_layout():
    at = us("2024-08-06T12:58:00")
    want = {
        "2024-05-01T10:00:00Z INFO app: text": ("2024-05-01T10:00:00", "info", "app", "text"),
        "2024-05-01T10:00:00.5+02:00 host-1 sshd[12]: failed": ("2024-05-01T08:00:00.5", None, "sshd", "failed"),
        "[2024-05-01 10:00:00] [error] boom x": ("2024-05-01T10:00:00", "error", None, "boom x"),
        "2024-05-01 10:00:00,123 - my.app - WARNING - the text": ("2024-05-01T10:00:00.123", "warn", "my.app", "the text"),
        "2024-05-01 10:00:00.123 +0200 [main] WARN com.foo.Bar - a - b": ("2024-05-01T08:00:00.123", "warn", "com.foo.Bar", "a - b"),
        "2024-05-01 10:00:00+02:00 | ERROR | app:run:12 | x y": ("2024-05-01T08:00:00", "error", "app:run", "x y"),
        "INFO 2024/05/01 10:00:00 app: text": ("2024-05-01T10:00:00", "info", "app", "text"),
        "Aug  6 12:57:31 vpn dedup[42]: error in x": ("2024-08-06T12:57:31", None, "dedup", "error in x"),
    }
    tree = loglines.TemplateTree()
    for line, (ts, level, name, text) in want.items():
        assert loglines.parse_head(tree, line, at) == (us(ts), level, name, text, False), line
    for line in ("2024-05-01 10:00:00 was the last time it ran", "ValueError: 2024-05-01 10:00:00 INFO app: x", "Error: 2024-05-01T10:00:00Z INFO a: b"):
        assert loglines.parse_head(tree, line, at) is None, line
    # equal leading masks, another count of tokens: another template; the merged masks keep the fields
    tree = loglines.TemplateTree()
    heads = [loglines.parse_head(tree, f"2024-05-01 10:00:00 INFO [app] {text}", at) for text in ("took one lock of many", "took two lock of many", "took one lock of many more things now")]
    assert [h[:3] for h in heads] == [(us("2024-05-01T10:00:00"), "info", "app")] * 3
    assert sorted((t.count, loglines.ANY in t.masks, t.slots == loglines.slots(t.masks)) for t in tree.templates()) == [(1, False, True), (2, True, True)]


# ------------------------------------------------------------------ nested records


def test_shredding(spark):
    event = {
        "kind": "Event", "auditID": "x", "OBJECTREF": {"resource": "pods"}, "responseStatus": {"code": 403, "details": {"causes": [None, {"reason": "a"}, {}, {"reason": "b"}]}},
        "requestObject": {"objectRef": {"resource": "no"}},
    }
    sensor = {"event_type": "dns", "dns": [{"query": "a", "answers": json.dumps([{"rname": "x"}, ""])}, "?", {"query": "b", "answers": {"rname": "y"}}, {}], "alert": None}
    payloads = [
        (1, json.dumps(event)), (1, json.dumps(event)), (2, "﻿" + json.dumps([sensor, event])), (3, json.dumps(event) + "\n" + json.dumps(sensor)), (4, json.dumps({"batch": 1, "items": [sensor]})),
        (5, json.dumps({"log": json.dumps(event) + "\n"})), (6, json.dumps(event)[:-3]), (7, None), (8, ""), (9, "[]"), (10, json.dumps({"event_type": "x", "alert": {}})), (11, "[" * 100_000),
    ]
    df = spark.createDataFrame(payloads, "record_id long, payload string").withColumn("entity", F.lit("clash"))
    got = sorted(tuple(r) for r in shred.shred_records(df, "record_id", "payload").collect())
    one = [("cause", 1, 2), ("cause", 1, 4), ("object_ref", 0, 1), ("response_status", 0, 1)]
    two = [("answer", 1, 1), ("answer", 3, 1), ("dns", 0, 1), ("dns", 0, 3)]
    want = [(1, 1, *x) for x in one] + [(2, 1, *x) for x in two] + [(2, 2, *x) for x in one] + [(3, 1, *x) for x in one] + [(3, 2, *x) for x in two] + [(4, 1, *x) for x in two] + [(5, 1, *x) for x in one]
    assert got == sorted(want)
    leaves = shred.shred_records(df, "record_id", "payload", leaves=True).where("entity = 'answer' AND record_id = 2").collect()
    assert sorted(r.fields["rname"] for r in leaves) == ["x", "y"]
    assert shred.shred_records(df.where("false"), "record_id", "payload").count() == 0


def test_shredding_wraps_lists_and_leaves():
    text = json.dumps({"event_type": "x", "alert": {"sid": 1}})
    for _ in range(12):
        text = json.dumps({"log": text})
    assert len(shred.events_of(text)) == 1
    assert len(shred.events_of('{"items":' * 400 + '[{"alert": {"a": 1}}]' + "}" * 400)) == 1
    sh = shred.Shredder(shred.ENTITIES, True)
    for details in ([{"causes": [{"a": 1}]}, {"causes": {"a": 2, "n": {"x": [1]}}}], json.dumps([{"causes": [{"a": 1}]}, {"causes": {"a": 2}}])):
        sh.add([{"responseStatus": {"details": details}}])
    record, event, parent, item, entry = sh.table("cause")
    assert list(zip(record.tolist(), event.tolist(), parent.tolist(), item.tolist())) == [(0, 1, 1, 1), (0, 1, 1, 2), (1, 1, 1, 1), (1, 1, 1, 2)]
    assert [dict(f) for f in sh.fields("cause", entry)] == [{"a": "1"}, {"a": "2", "n": '{"x": [1]}'}, {"a": "1"}, {"a": "2"}]


def test_shredding_against_a_walk():
    """Random records: tables and leaves from the columns alone equal those of a plain walk."""
    r = random.Random(6)

    def thing(depth):
        k = r.randrange(7)
        if k == 0:
            return r.choice([None, "", 5, "text", True])
        if k == 1:
            return [thing(depth + 1) for _ in range(r.randrange(4))]
        return {n: thing(depth + 1) if depth < 4 else r.randrange(9) for n in r.sample(["alert", "dns", "answers", "responseStatus", "details", "causes", "a", "b", "objectRef"], r.randrange(5))}

    records = [[{"event_type": "e", **(x if isinstance(x := thing(0), dict) else {})} for _ in range(r.randrange(4))] for _ in range(400)]
    want = {e.name: [] for e in shred.ENTITIES}

    def places(v):
        return v if isinstance(v, list) else [v] if isinstance(v, dict) else []

    def walk(e, obj, rec, ev, parent):
        found = [obj]
        for n in e.path[:-1]:
            found = [x for v in found for x in places({k.lower(): y for k, y in v.items()}.get(n)) if isinstance(x, dict)]
        for i, p in enumerate([p for v in found for p in places({k.lower(): y for k, y in v.items()}.get(e.path[-1]))], 1):
            if isinstance(p, dict):
                if p:
                    want[e.name].append((rec, ev, parent, i, {k: v if isinstance(v, str) else json.dumps(v) for k, v in p.items() if v is not None}))
                for c in shred.ENTITIES:
                    if c.parent == e.name:
                        walk(c, p, rec, ev, i)

    sh = shred.Shredder(shred.ENTITIES, True)
    for rec, events in enumerate(records):
        sh.add(events)
        for ev, event in enumerate(events, 1):
            for e in shred.ENTITIES:
                if not e.parent:
                    walk(e, event, rec, ev, 0)
    for e in shred.ENTITIES:
        record, event, parent, item, entry = sh.table(e.name)
        got = [(*x, dict(f)) for x, f in zip(zip(record.tolist(), event.tolist(), parent.tolist(), item.tolist()), sh.fields(e.name, entry))]
        assert got == want[e.name] and got


# ------------------------------------------------------------------ instants

AT = us("2024-10-27T01:30:00")


@pytest.mark.parametrize(
    "text, zone, order, received, want",
    [
        ("2024-10-27T02:30:00", "Europe/Berlin", "dmy", "2024-10-27T00:35:00", "2024-10-27T00:30:00"),
        ("2024-10-27T02:30:00", "Europe/Berlin", "dmy", "2024-10-27T01:35:00", "2024-10-27T01:30:00"),
        ("2024-03-31 02:30:00", "Europe/Berlin", "dmy", "2024-03-31T01:35:00", "2024-03-31T01:30:00"),
        ("03/04/24 01:02:03", "Etc/UTC", "dmy", "2024-04-03T01:03:00", "2024-04-03T01:02:03"),
        ("03/04/2024 1:02:03 PM", "Etc/UTC", "mdy", "2024-03-04T13:03:00", "2024-03-04T13:02:03"),
        ("1716479775.4758615", "Asia/Tokyo", "ymd", "2024-05-23T16:00:00", "2024-05-23T15:56:15.475861"),
        ("1730612003000000868", "Asia/Tokyo", "ymd", "2024-11-03T05:34:00", "2024-11-03T05:33:23"),
        ("Feb 29 10:00:00", "Etc/UTC", "ymd", "2025-03-01T00:00:00", "2024-02-29T10:00:00"),
        ("Dec 31 23:59:00", "Etc/UTC", "ymd", "2025-01-01T00:01:00", "2024-12-31T23:59:00"),
        ("Sun Nov  5 01:43:42 EST 2023", "America/New_York", "mdy", "2023-11-05T06:45:00", "2023-11-05T06:43:42"),
        ("[Sun, 03 Nov 2024 08:16:25 +0530]", "Etc/UTC", "dmy", "2024-11-03T02:50:00", "2024-11-03T02:46:25"),
        ("20240223T174447+0200", "Etc/UTC", "dmy", "2024-02-23T15:45:00", "2024-02-23T15:44:47"),
        ("2024-02-30T10:00:00Z", "Etc/UTC", "dmy", "2024-03-01T10:00:00", None),
        ("99/99/2024 10:00:00", "Etc/UTC", "dmy", "2024-03-01T10:00:00", None),
        ("pending", "Etc/UTC", "dmy", "2024-03-01T10:00:00", None),
        ("", "Etc/UTC", "dmy", "2024-03-01T10:00:00", None),
        ("2024-01-01 00:00:00", "No/Where", "dmy", "2024-01-01T00:01:00", None),
    ],
)
def test_instants(text, zone, order, received, want):
    chain = instants.Chain(20 * 60_000_000)
    options = instants.interpretations(text, zone, order, us(received))
    if options:
        chain.add(1, options, us(received))
    assert [x[1] for x in chain.settle()] == ([] if want is None else [us(want)])


def test_instants_table(spark):
    rows = [(1, 1, "2024-10-27T02:30:00", dt.datetime(2024, 10, 27, 1, 31)), (1, 1, "2024-10-27T02:30:00", dt.datetime(2024, 10, 27, 1, 31)), (2, 1, None, dt.datetime(2024, 1, 1)), (3, None, "2024-01-01T00:00:00Z", None), (4, 9, "2024-01-01 00:00:00", dt.datetime(2024, 1, 1))]
    df = spark.createDataFrame(rows, "rid long, sensor_id int, text string, received_at timestamp_ntz").withColumn("zone_name", F.lit("clash"))
    zones = spark.createDataFrame([(1, "Europe/Berlin", "dmy")], "sensor_id int, zone_name string, date_order string")
    out = instants.normalise_instants(df, "rid", "sensor_id", "text", "received_at", zones, parts=5)
    assert sorted(map(tuple, out.collect())) == [(1, AT), (3, us("2024-01-01T00:00:00"))]
    assert instants.normalise_instants(df.where("false"), "rid", "sensor_id", "text", "received_at", zones).count() == 0


# ------------------------------------------------------------------ gating


@pytest.mark.parametrize("strict", [False, True])
def test_gate_against_loop(spark, strict):
    r = random.Random(5)
    rows = [(i, "hot" if r.random() < 0.6 else r.choice(["a", "b", None]), r.randint(0, 3000)) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, k string, sec long").withColumn("ts", F.timestamp_seconds("sec"))
    for gap in (3, 90):
        got = {x.id: (x.passes, x.anchor_us) for x in gate_events(df, "k", "ts", "id", gap * 1_000_000, strict, parts=9).collect()}
        last, want = {}, {}
        for i, k, t in sorted(rows, key=lambda x: (str(x[1]), x[2], x[0])):
            ok = k not in last or (t > last[k] + gap if strict else t >= last[k] + gap)
            last[k] = t if ok else last[k]
            want[i] = (ok, last[k] * 1_000_000)
        assert got == want
    assert gate_events(df.where("false"), "k", "ts", "id", 1).count() == 0

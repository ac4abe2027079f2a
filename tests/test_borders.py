"""Results that must not depend on where range partitions end."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from emberlog.operators import instants, loglines

PARTS = (1, 2, 7, 60)
BASE = dt.datetime(2024, 3, 1)


def _log_rows():
    r, rows = random.Random(5), []
    for file in range(6):
        n = 0

        def put(*texts):
            nonlocal n
            for t in texts:
                n += 1
                rows.append((file, n, BASE + dt.timedelta(days=1), t, {"program": f"p{file}"} if n % 3 else None))

        for i in range(40 if file else 160):
            at = (BASE + dt.timedelta(seconds=60 * i)).strftime("%Y-%m-%dT%H:%M:%SZ")
            kind = r.randrange(7)
            if kind == 0:  # members that look like those of an open object, below a plain entry
                put(f"{at} INFO app: report", *[f'  "k{j}": {j},' for j in range(r.randrange(12))], "}", "tail")
            elif kind == 1:
                put("{", '  "host": "h",', f'  "ts": "{at}",', '  "level": "warn",', '  "msg": "object",', *[f'  "x{j}": 1,' for j in range(r.randrange(6))], "}", *["after"] * r.randrange(3))
            elif kind == 2:  # an object without a time belongs to the entry before
                put("{", '  "level": "error",', '  "msg": "no time"', "}", "rest")
            elif kind == 3:
                put("{", '  "level": "error",')
            elif kind == 4:
                put(f"{at} ERROR db: failed", *["  at line"] * r.randrange(9), "", "{")
            else:
                put(f'level=info msg="a b c d e f g h" component=c{i % 3} ts={at}')
    return rows


def test_log_entries_whatever_the_partitions(spark):
    rows = _log_rows()
    lines = spark.createDataFrame(rows, "file long, line long, read_at timestamp_ntz, raw string, fields map<string,string>")
    found = [
        sorted(map(tuple, loglines.parse_entries(lines, "file", "line", "read_at", "raw", "fields", message=m, parts=p).collect()), key=str)
        for m in (True, False)
        for p in PARTS
    ]
    assert found[0] == found[1] == found[2] == found[3] and len(found[0]) > 100
    assert [(*e[:-1], None) for e in found[0]] == found[4] == found[5] == found[6] == found[7]
    # every line is of one entry: files are covered without a gap from their first entry on
    for f in range(6):
        spans = sorted((e[1], e[2]) for e in found[0] if e[0] == f)
        assert all(b + 1 == c for (_, b), (c, _) in zip(spans, spans[1:])) and spans[-1][1] == max(x[1] for x in rows if x[0] == f)


LAYOUTS = [
    ("2024-01-01T00:00:00Z INFO sync: x", (1704067200000000, "info", "sync", "x")),
    ("2024-01-01 00:00:00 INFO x", (1704067200000000, "info", None, "x")),
    ("Jan  1 00:00:00 host sshd[12]: Failed", (1704067200000000, None, "sshd", "Failed")),
    ('10.0.0.1 - - [01/Jan/2024:01:00:00 +0100] "GET / HTTP/1.1" 200 1', (1704067200000000, None, None, '"GET / HTTP/1.1" 200 1')),
    ('time="2024-01-01T00:00:00Z" level=info msg="say \\"b\\""', (1704067200000000, "info", None, 'msg="say \\"b\\""')),
    ('level=info msg="one two three four five six seven" component=fim ts=2024-01-01T00:00:00Z', (1704067200000000, "info", "fim", 'msg="one two three four five six seven"')),
    ('host=web01 ts="2024-01-01 00:00:00" severity=warn text=x', (1704067200000000, "warn", None, "host=web01 text=x")),
]


@pytest.mark.parametrize("line,want", LAYOUTS)
def test_layouts(line, want):
    tree = loglines.TemplateTree()
    assert loglines.parse_head(tree, line, 1704067200000000)[:4] == want


def test_template_tree_is_bounded():
    tree = loglines.TemplateTree()
    for i in range(3000):
        loglines.parse_head(tree, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} " + "w " * (i % 900) + "x", None)
    assert len(tree.root) <= loglines.BRANCHES + 1
    assert all(len(b) <= loglines.BRANCHES + 1 for b in tree.root.values())
    assert loglines.parse_head(tree, "2024-01-01 00:00:00 INFO x", None)[:2] == (1704067200000000, "info")


def _stamps():
    r, rows = random.Random(8), []
    for i in range(900):
        at = BASE + dt.timedelta(hours=7 * i % 4000, minutes=r.randrange(60))
        form = r.choice(["%d/%m/%Y %H:%M:%S", "%m/%d/%Y %H:%M:%S", "%y-%m-%d %H:%M", "%d.%m.%Y %H:%M:%S"] + ["%Y-%m-%dT%H:%M:%SZ"] * (i % 9 == 0) + ["nonsense"] * (i % 11 == 0))
        source = None if i % 50 == 0 else 1 if i % 4 else i % 7
        rows.append((i, source, at.strftime(form), at + dt.timedelta(minutes=5) if r.random() < 0.3 else None))
    return rows


def test_instants_whatever_the_partitions(spark):
    rows = _stamps()
    records = spark.createDataFrame(rows, "id long, source long, text string, at timestamp_ntz")
    zones = spark.createDataFrame([(s, "Europe/Berlin", "dmy" if s == 3 else None) for s in range(7)], "source long, zone_name string, date_order string")
    found = [dict(map(tuple, instants.normalise_instants(records, "id", "source", "text", "at", zones, parts=p).collect())) for p in PARTS]
    assert all(f == found[0] for f in found[1:]) and len(found[0]) > 700


def test_viterbi_is_optimal():
    """Against all paths: the least cost is reached, also with the struck-out readings."""
    r, window = random.Random(3), 20
    for _ in range(300):
        raw = [([(r.randrange(0, 200), r.choice("ab")) for _ in range(r.randint(1, 3))], r.choice([None, r.randrange(0, 220)])) for _ in range(r.randint(1, 6))]

        def cost(path):
            c = 0
            for k, ((options, received), i) in enumerate(zip(raw, path)):
                at, form = options[i]
                c += instants.OUTSIDE if received is not None and not 0 <= received - at <= window else 0
                if k:
                    at0, form0 = raw[k - 1][0][path[k - 1]]
                    c += (instants.SWITCH if form != form0 else 0) + (instants.BACKWARD if at < at0 - window else 0)
            return c

        least = min(cost(p) for p in itertools.product(*(range(len(o)) for o, _ in raw)))
        nodes = [instants.weighed(o, t, window) for o, t in raw]
        costs, backs = instants.forward(nodes, window)
        path, _ = instants.backward(backs, instants.best_end(nodes[-1], costs))
        chosen = [next(k for k, x in enumerate(o) if x == n[i][:2]) for (o, _), n, i in zip(raw, nodes, path)]
        assert cost(chosen) == least

"""Sources, streaming forms and operators that the SQL comparison does not reach."""

import datetime as dt
import json
import os
import random
import socket
import struct
import sys
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.functions import decoders as D
from emberlog.functions.versions import package_matches
from emberlog.operators import compliance, content_scan, correlate, gate, intel, playbook, process_tree, rule_sets, rules, sidecar, snapshots, store
from emberlog.operators.ordered import numbered, with_halo
from emberlog.operators.skew import join_lookup
from emberlog.plans import engine_queries
from emberlog.sources import feeds, logs
from emberlog.streaming import stateful


def one(spark, decoder, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "raw string")
    return [r.e for r in df.select(decoder(F.col("raw")).alias("e")).collect()]


# ------------------------------------------------------------------ ordered, skew


def test_numbered_and_halo(spark):
    r = random.Random(1)
    rows = [(i, "hot" if r.random() < 0.7 else r.choice(["a", None]), r.randint(0, 40)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, k string, v int")
    got = {x.id: x.row_no for x in numbered(df, "k", ["v", "id"], parts=9).collect()}
    want, n = {}, {}
    for i, k, _ in sorted(rows, key=lambda x: (str(x[1]), x[2], x[0])):
        n[k] = want[i] = n.get(k, 0) + 1
    assert got == want
    assert numbered(df.where("false"), "k", ["v"]).count() == 0
    cells = with_halo(numbered(df, "k", ["v", "id"], parts=4), "row_no", 3, 50).collect()
    assert sum(c.own for c in cells) == 400 and all(c.row_no - 1 >= c.cell * 50 - 3 for c in cells)


@pytest.mark.parametrize("how", ["left", "left_anti", "left_semi", "inner"])
def test_join_lookup_hot_and_cold_agree(spark, how):
    left = spark.createDataFrame([("a", 1)] * 50 + [("b", 2), (None, 3), ("c", 4)], "k string, v int")
    right = spark.createDataFrame([("a", 7), ("c", 8), ("d", 9)], "k string, w int")
    a, b = join_lookup(left, right, "k", how), join_lookup(left, right, "k", how, min_rows=10)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


# ------------------------------------------------------------------ decoders and rules


def test_decoders_on_odd_texts(spark):
    odd = [None, "", " ", "{", "[]", "null", "<Event", "x" * 20_000, "\n", "😀"]
    for d in (D.decode_audit, D.decode_sensor, D.decode_json, D.decode_apache, D.decode_evtx, D.decode_windows):
        assert one(spark, d, *odd) == [None] * len(odd)
    last = one(spark, D.decode_first, *odd)
    assert last[0] is None and [e.source for e in last[1:]] == ["decoder:syslog"] * 9 and last[7].fields == {"message": "x" * 20_000}


def test_decoders_fields(spark):
    (a,) = one(spark, D.decode_apache, '10.0.0.1 - - [10/Oct/2023:13:55:36 -0700] "GET /x HTTP/1.1" 503 -')
    assert (a.severity, a.tags, a.fields["bytes"], a.ts) == (3, ["http_error"], "0", dt.datetime(2023, 10, 10, 20, 55, 36))
    (j,) = one(spark, D.decode_json, '{"time": "2024-01-05T10:00:00", "level": "Error", "source": "app", "n": {"a": 1}, "z": null}')
    assert (j.severity, j.tags, j.fields["n"], "z" in j.fields, j.ts) == (4, ["source:app"], '{"a":1}', False, dt.datetime(2024, 1, 5, 10))
    (s,) = one(spark, lambda c: D.decode_syslog(c, 2024), "<34>Jan  5 10:00:00 h sshd Failed password for root")
    assert (s.severity, s.tags, s.fields["facility"], s.ts) == (3, ["auth_failure", "security"], "34", dt.datetime(2024, 1, 5, 10))
    xml = '<Event><System><Provider Name="Microsoft-Windows-Sysmon"/><EventID Qualifiers="0">8</EventID><TimeCreated SystemTime="2024-01-05T10:00:00.123Z"/><Channel>Op</Channel></System><EventData><Data Name="a">1</Data><Data Name="a">2</Data><Data>x</Data></EventData></Event>'
    (e,) = one(spark, D.decode_evtx, xml)
    assert (e.severity, e.tags, e.fields["a"], e.fields["event_id"]) == (4, ["windows", "Op", "remote_thread"], "2", "8")


def test_rule_conditions_on_missing(spark):
    df = spark.createDataFrame([(1, None, None, None), (2, ["x"], {"n": "12", "o": '{"p": {"q": "z"}}'}, 5)], "id int, tags array<string>, fields map<string,string>, severity int")
    hit = lambda c: [r.id for r in df.where(rules.compile_condition(c, F.col("tags"), F.col("fields"), F.col("severity"))).orderBy("id").collect()]
    assert hit("") == hit("nonsense") == hit("field:a ~= (") == hit("field:n ?? 1") == hit("field:n") == []
    assert hit("field:n != 12") == [1] and hit("field:n ~= nil") == [1] and hit("field:n > 11.5") == [2] and hit("field:n < 1") == [1]
    assert hit("severity>=5") == hit("tag:x") == hit("field:o.p.q == z") == [2]
    assert rules.match_rules(df, []).count() == 0
    assert [rules.seconds(x) for x in ("60s", "1h30m", "", "5x", None, 7)] == [60, 5400, 0, 0, 0, 7]


def test_package_patterns(spark):
    rows = [("openssl", "*", True), ("openssl", "", True), ("openssl", "openssl", True), ("openssl-libs", "openssl*", True), ("libopenssl", "openssl*", False), ("linux-kernel", "kernel", True), ("a", "b", False), (None, "b", False)]
    df = spark.createDataFrame(rows, "n string, p string, want boolean")
    assert df.where(package_matches(F.col("n"), F.col("p")) != F.col("want")).count() == 0


def test_bounded_dimension(spark):
    assert intel.bounded(spark.range(5), 4) is None and intel.bounded(spark.range(4), 4).count() == 4


def test_patterns_by_broadcast_and_by_index_agree(spark):
    r = random.Random(2)
    word = lambda n: "".join(r.choice("abc") for _ in range(n))
    texts = spark.createDataFrame([(word(r.randrange(9)),) for _ in range(200)] + [(None,)], "text string").coalesce(1)
    patterns = spark.createDataFrame([(word(r.randrange(6)),) for _ in range(80)] + [(None,)], "pattern string").coalesce(1)
    few, many = (sorted(map(tuple, intel.contained_pairs(texts, patterns, max_rows=m).collect())) for m in (10_000, 5))
    all_patterns = [p.pattern for p in patterns.collect()]
    want = {(t.text, p) for t in texts.collect() for p in all_patterns if t.text and p and p in t.text}
    assert few == many == sorted(want)
    packages = texts.select(F.col("text").alias("name"), F.lit("1.2").alias("version"))
    cves = patterns.withColumns({"pattern": F.concat("pattern", F.when(F.length("pattern") % 2 == 0, "*").otherwise("")), "cve_id": F.concat(F.lit("C"), F.coalesce("pattern", F.lit("-"))), "op": F.lit("<"), "fixed": F.lit("2.0"), "cvss": F.lit(1.0)}).distinct()
    some, all_ = (sorted(map(tuple, intel.match_vulnerabilities(packages, cves, m).collect())) for m in (10_000, 5))
    brute = packages.crossJoin(cves).where(package_matches(F.col("name"), F.col("pattern")) & F.col("name").isNotNull() & F.col("pattern").isNotNull()).drop("pattern", "op").select("name", "version", "cve_id", "fixed", "cvss")
    assert some == all_ == sorted(map(tuple, brute.collect())) and some


def test_many_indicators(spark):
    """200,000 indicators: exact, contained and containing matches, hot and null values."""
    iocs = spark.range(200_000).select(F.concat(F.lit("host-"), F.lpad(F.col("id").cast("string"), 7, "0"), F.lit(".example")).alias("ioc"), F.lit("malicious").alias("reputation"))
    rows = [(1, "HOST-0000017.example "), (2, "see host-0000023.example now"), (3, "-0000042.ex"), (4, "nothing"), (5, None), (6, "hos"), *[(10 + i, "hot") for i in range(50)], *[(100 + i, None) for i in range(50)]]
    out = {r.id: r.ioc for r in intel.lookup_indicators(spark.createDataFrame(rows, "id int, value string"), "value", iocs, hot_rows=10).collect()}
    assert len(out) == len(rows) and {k: v for k, v in out.items() if v} == {1: "host-0000017.example", 2: "host-0000023.example", 3: "host-0000042.example"}


# ------------------------------------------------------------------ snapshots, trees, store


def test_snapshot_listings(spark):
    maps = spark.createDataFrame([("7f00-8f00 r-xp 00000000 08:01 12 /bin/x",), ("7f00-8f00 rw-s 0 08:01 1 /y",), ("junk",)], "line string")
    assert [r.path for r in snapshots.parse_memory_maps(maps, "line").collect()] == ["/bin/x"]
    net = spark.createDataFrame([("tcp        0      0 127.0.0.1:22       10.0.0.9:50000     ESTABLISHED",), ("Proto Recv-Q",)], "line string")
    (c,) = snapshots.parse_connections(net, "line").collect()
    assert (c.local_port, c.remote_ip, c.state) == (22, "10.0.0.9", "ESTABLISHED")
    pk = spark.createDataFrame([("ii  bash:amd64  5.1-6  amd64  shell",), ("zlib 1.3",), ("",)], "line string")
    assert [tuple(r) for r in snapshots.parse_packages(pk, "line").collect()] == [("bash", "5.1-6"), ("zlib", "1.3")]


def test_ancestors_with_cycle(spark):
    edges = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 5), (5, 4), (6, 99), (7, 4)], "pid int, ppid int")
    got = {r.node: (r.depth, r.root) for r in process_tree.ancestors(edges, "pid", "ppid").collect()}
    assert got == {1: (0, 1), 2: (1, 1), 3: (2, 1), 4: (None, None), 5: (None, None), 6: (0, 6), 7: (None, None)}
    chain = process_tree.ancestor_chain(edges, "pid", "ppid", edges.where("pid IN (3, 7)")).collect()
    assert sorted((r.start, r.step, r.ancestor) for r in chain) == [(3, 1, 2), (3, 2, 1), (7, 1, 4), (7, 2, 5)]


def test_ancestor_chain_of_any_depth(spark):
    line = [(i, i - 1 if i > 1 else None) for i in range(1, 151)]
    tail = [(1000 + i, 999 + i) for i in range(1, 81)] + [(1000, 2000), (2000, 2001), (2001, 1000), (5000, 5000)]
    edges = spark.createDataFrame(line + tail, "pid int, ppid int")
    chain = process_tree.ancestor_chain(edges, "pid", "ppid", edges.where("pid IN (150, 1080, 5000)")).collect()
    want = [(150, k, 150 - k) for k in range(1, 150)] + [(1080, k, 1080 - k) for k in range(1, 81)] + [(1080, 81, 2000), (1080, 82, 2001)]
    assert sorted((r.start, r.step, r.ancestor) for r in chain) == want
    cut = process_tree.ancestor_chain(edges, "pid", "ppid", edges.where("pid = 150"), max_depth=5).collect()
    assert sorted((r.step, r.ancestor) for r in cut) == [(k, 150 - k) for k in range(1, 6)]


def test_store_versions_and_upsert(spark):
    t = spark.createDataFrame([("a", "2024-01-05T10:00:00Z", 1), ("a", "2024-01-05 11:00:00", 2), ("b", None, 3), (None, "2024-01-01 00:00:00", 4)], "id string, updated_at string, v int")
    assert sorted((r.id, r.v) for r in store.newest_version(t, "id", "updated_at").collect()) == [("a", 2), ("b", 3)]
    assert [r.v for r in store.by_prefix(t, "id", "a", "updated_at").collect()] == [2]
    assert store.recent(t.where("false"), "updated_at", "id", 5).count() == 0


# ------------------------------------------------------------------ playbooks, compliance


def test_playbook_stops_at_unknown_step(spark):
    df = spark.createDataFrame([("i1", "x"), ("i2", None)], "id string, value string")
    steps = [playbook.Step("a", "b", {"v": "<${input.value}>"}), playbook.Step("no", "such"), playbook.Step("a", "b")]
    state, events = playbook.run_playbook(df, "id", steps, {"a.b": lambda s, p: s.select("id", p["v"].alias("out"))})
    assert sorted((r.id, r.a_b.out) for r in state.collect()) == [("i1", "<x>"), ("i2", "<>")]
    assert [r.event for r in events.where("id = 'i1'").orderBy("step_no").collect()] == ["playbook_started", "step_completed", "step_failed"]


def test_result_scores(spark):
    cases = [('{"reputation": "malicious"}', 0.95), ('{"malicious": 4, "total": 10}', 0.9), ('{"malicious": 1, "total": 10, "count": 2}', 0.85), ('{"found": true}', 0.75), ('{"suspicious": ["a"]}', 0.8), ('{"intel": {"builtin_match": true, "confidence": 0.6}}', 0.6), ('{"error": "not configured"}', 0.0), ('{"error": "x"}', 0.1), ("{}", 0.5)]
    df = spark.createDataFrame(cases, "r string, want double")
    assert df.where(playbook.score_result(F.col("r")) != F.col("want")).count() == 0


def test_checks_and_reports(spark):
    facts = spark.createDataFrame([("h1", "d", "/etc/ssh", "sshd_config", "PermitRootLogin no"), ("h2", "d", "/etc/ssh", "other", "")], "host string, kind string, target string, name string, content string")
    checks = [{"id": "a", "condition": "all", "rules": ["d:/etc/ssh -> r:^sshd -> r:RootLogin no"]}, {"id": "b", "rules": []}, {"id": "c", "rules": ["not f:/etc/none"]}, {"id": "d", "rules": ["what"]}]
    got = {(r.host, r.check_id): r.passed for r in compliance.evaluate_checks(checks, facts).collect()}
    assert got == {("h1", "a"): True, ("h2", "a"): False, ("h1", "b"): True, ("h2", "b"): True, ("h1", "c"): True, ("h2", "c"): True, ("h1", "d"): False, ("h2", "d"): False}
    rep = compliance.control_report(spark.createDataFrame([("f", "1", "c")], "framework string, control_id string, category string"), spark.createDataFrame([], "framework string, control_id string, passed boolean"))
    assert json.loads(compliance.render_report(rep, "json"))[0]["status"] == "not_covered"
    assert "| f | 1 |" in compliance.render_report(rep, "md") and "<td>f</td>" in compliance.render_report(rep, "html")


# ------------------------------------------------------------------ content


def small_pe(section=b".text", body=b"\x90" * 512):
    head = bytearray(1024)
    head[:2], head[0x3C:0x40] = b"MZ", struct.pack("<I", 0x80)
    head[0x80:0x84] = b"PE\0\0"
    struct.pack_into("<HHIIIHH", head, 0x84, 0x14C, 1, 0, 0, 0, 224, 0)
    struct.pack_into("<H", head, 0x98, 0x10B)
    struct.pack_into("<I", head, 0x98 + 16, 0x1000)
    off = 0x98 + 224
    head[off : off + 8] = section.ljust(8, b"\0")
    struct.pack_into("<IIII", head, off + 8, len(body), 0x1000, len(body), 1024)
    return bytes(head) + body


def test_executables_and_bytes(spark):
    pe = content_scan.parse_executable(small_pe())
    assert pe["sections"][0]["name"] == ".text" and pe["entry_section"] == 0 and pe["libraries"] == 0
    assert content_scan.packer_score(content_scan.parse_executable(small_pe(b"UPX0"))) >= 0.6
    for bad in (b"", b"MZ", b"MZ" + b"\xff" * 80, small_pe()[:200]):
        assert content_scan.parse_executable(bad) is None
    text = b"the tests are at the east gate and eat a tea at a seat " * 4
    assert content_scan.looks_xored(bytes(b ^ 0x5A for b in text)) and not content_scan.looks_xored(bytes(200)) and not content_scan.looks_xored(b"short")
    assert content_scan.find_hex(b"aaPK\x03\x04", *content_scan.compile_hex("50 4B ?? 04")) == 2 and content_scan.find_hex(b"P", *content_scan.compile_hex("50 4B")) == -1
    df = spark.createDataFrame([(1, small_pe()), (2, None), (3, b"")], "id int, content binary")
    rows = {r.id: r for r in content_scan.scan_bytes(df, "id", "content", {"mz": "4D 5A"}).collect()}
    assert rows[1].executable and rows[1].hex_hits == ["mz"] and rows[2].size == 0 and rows[3].entropy == 0.0


def test_ciphers_beyond_single_byte_xor(spark):
    noise = lambda n: np.random.default_rng(5).integers(0, 256, n, np.uint8).tobytes()
    text = b"Quarterly numbers: 1482 units shipped, 337 returned; 96 pending." * 80
    turned = bytes((b >> 3 | b << 5) & 255 for b in text)
    several = bytes(x for pair in zip(b"ABCDEFGHIJ" * 50, noise(500)) for x in pair)  # a readable and an unreadable place
    steady = b"q\xf1" * 300  # the same, of equal blocks: no bits differ
    assert not content_scan.looks_xored(noise(20_000)) and not content_scan.keyed_by_several(np.frombuffer(noise(4096), np.uint8))
    assert content_scan.looks_xored(turned) and content_scan.looks_xored(bytes((b + 0x73) & 255 for b in text)) and content_scan.looks_xored(bytes((b - 0x73) & 255 for b in text))
    encoded = bytes(b ^ 0x5A for b in text)
    assert content_scan.looks_xored(noise(9000) + encoded) and content_scan.looks_xored(noise(5000) + encoded + noise(9000))
    for padding in (bytes(5000), b"\xff" * 5000, bytes(1500), b"\x90" * 1500):
        assert not content_scan.looks_xored(noise(9000) + padding + noise(1000)), "padding is no text under any key"
    place = np.frombuffer(several, np.uint8), np.frombuffer(steady, np.uint8)
    assert not content_scan.keyed_by_several(place[0]) and not content_scan.keyed_by_several(place[1])
    nearly = bytearray(steady)  # every second block differs in one bit of two bytes
    nearly[1::4] = b"\xf0" * len(nearly[1::4])
    assert content_scan.keyed_by_several(np.frombuffer(bytes(nearly), np.uint8))
    (r,) = content_scan.scan_bytes(spark.createDataFrame([(1, bytearray(noise(9000) + encoded))], "id int, content binary"), "id", "content").collect()
    assert r.xored


def test_rules_without_window_or_time(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, at, "one", 1, 0), (2, at, "one", 1, 0), (3, None, "one", 1, None), (4, None, "many", 2, 60), (5, None, "many", 2, 60), (6, at, "many", 2, 60), (7, at, "many", 2, 60), (8, None, "each", 1, 60), (9, at, "free", 5, 0)]
    df = spark.createDataFrame(rows, "id int, ts timestamp, k string, threshold int, window_s int")
    got = {(r.id, r.in_window) for r in rules.threshold_alerts(df, "ts", ["k"], F.col("threshold"), F.col("window_s")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (6, 2), (7, 2), (8, 1), (9, 1)}
    assert {(r.id, r.in_window) for r in rules.threshold_alerts(df, "ts", ["k"], 1, 60).where("id IN (3, 6)").collect()} == {(3, 1), (6, 2)}


def test_all_builtin_rules_are_matched(spark, tmp_path):
    rows = [(1, ["auth_failure"], {"message": "Login FAILED"}, 1), (2, [], {"logontype": "10"}, 1), (3, None, {"message": "it failed"}, 1)]
    spark.createDataFrame(rows, "event_id long, tags array<string>, fields map<string,string>, severity int").write.parquet(str(tmp_path / "siem_events.parquet"))
    got = {r.rule_id: r.n for r in engine_queries.rule_multi_match_explode(spark, str(tmp_path)).collect()}
    assert got == {"MULTIPLE_FAILED_LOGINS": 1, "FAILED_LOGIN_BRUTE": 1, "WINDOWS_EVENT_4625_BURST": 1, "BRUTE_FORCE_FALLBACK": 2, "WIN_RDP_LOGIN_4625": 1}


def test_suppression_comes_before_the_threshold(spark):
    t0 = dt.datetime(2024, 1, 1)
    some = [rules.Rule("A", condition="tag:x", window_s=100, threshold=2, suppress_s=10), rules.Rule("B", condition="tag:x", window_s=60, threshold=3), rules.Rule("C", condition="tag:x", threshold=9)]
    r = random.Random(1)
    rows = [(i, t0 + dt.timedelta(seconds=s) if s is not None else None, ["x"], {}, 1) for i, s in enumerate([*sorted(r.randrange(400) for _ in range(60)), None])]
    df = spark.createDataFrame(rows, "id long, ts timestamp, tags array<string>, fields map<string,string>, severity int")
    got = sorted((a.rule_id, a.id) for a in rules.evaluate(df, some, "ts", "id").collect())
    want, last, seen = [], None, {"A": [], "B": []}
    for i, t, *_ in rows:
        want.append(("C", i))
        if t is None:
            continue
        if last is None or (t - last).total_seconds() >= 10:
            last = t
            seen["A"].append(t)
            if sum((t - x).total_seconds() < 100 for x in seen["A"]) >= 2:
                want.append(("A", i))
    times = [x[1] for x in rows if x[1]]
    want += [("B", i) for i, t, *_ in rows if t and sum(0 <= (t - x).total_seconds() < 60 for x in times) >= 3]
    assert got == sorted(want)


def test_throttling_with_idle_reset(spark):
    r, t0 = random.Random(7), dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    d = [(i, "r", r.choice("ppppq"), at(r.choice([r.randrange(2000), r.randrange(100)]))) for i in range(160)]
    c = [(1000 + i, "r", r.choice("ppq"), at(r.randrange(3000))) for i in range(90)]
    schema = "id long, rule string, process string, ts timestamp"
    got = {x.id: x.throttled for x in correlate.throttled_at(spark.createDataFrame(d, schema), spark.createDataFrame(c, schema), "rule", "process", "ts", "id", 5, 120).collect()}
    state, want = {}, {}
    for t, check, i, p in sorted([(x[3], 0, x[0], x[2]) for x in d] + [(x[3], 1, x[0], x[2]) for x in c]):
        n, last = state.get(p, (0, None))
        if not check:
            state[p] = (n + 1, t)
        else:
            if n >= 5 and (t - last).total_seconds() > 120:
                n = 0
                state[p] = (0, last)
            want[i] = n >= 5
    assert got == want and len(set(want.values())) == 2


@pytest.mark.parametrize("strict", [False, True])
def test_gate_on_evenly_spaced_events(spark, strict, monkeypatch):
    """Starts never meet: partitions tell step functions, or are asked where these are long."""
    df = spark.range(3000).select("id", F.lit("k").alias("k"), F.timestamp_seconds(F.col("id") * 10).alias("ts"))
    want = [i for i in range(3000) if i % (8 if strict else 7) == 0]
    for most in (10_000, 3):
        monkeypatch.setattr(gate, "MAX_STEPS", most)
        out = gate.gate_events(df, "k", "ts", "id", 70 * 1_000_000, strict, parts=9)
        assert sorted(r.id for r in out.where("passes").collect()) == want
    t = np.arange(1_000_000, dtype=np.int64) * 10
    upto, out = gate._steps(t, 70, strict)
    assert len(upto) <= 9


def test_decayed_mean(spark):
    r = random.Random(2)
    rows = [(i, "g", r.random() * 8) for i in range(40)]
    got = {x.i: x.decayed for x in correlate.decayed_mean(spark.createDataFrame(rows, "i int, g string, v double"), "g", "v", ["i"], 0.01, 10).collect()}
    held, want = [], {}
    for i, _, v in rows:
        held = [h + 0.01 * (v - h) for h in held] + [v]
        held = held[-10:]
        want[i] = sum(held) / len(held)
    assert all(abs(got[i] - want[i]) < 1e-9 for i in want)
    hot = correlate.decayed_mean(spark.createDataFrame(rows, "i int, g string, v double"), "g", "v", ["i"], 0.01, 10, hot_rows=20)
    assert all(abs(x.decayed - want[x.i]) < 1e-9 for x in hot.collect()) and hot.count() == 40


def test_order_of_steps(spark):
    r, t0 = random.Random(4), dt.datetime(2024, 1, 1)
    rows = [(i, r.choice(["hot", "hot", "a", None]), t0 + dt.timedelta(seconds=i if r.random() < 0.99 else 0) if r.random() < 0.95 else None) for i in range(300)]
    got = {x.k: (x.steps, x.ordered) for x in correlate.in_order(spark.createDataFrame(rows, "i int, k string, ts timestamp"), ["k"], "i", "ts", parts=9).collect()}
    want = {}
    for k in ("hot", "a", None):
        times = [x[2] for x in rows if x[1] == k]
        want[k] = (len(times), all(a is None or b is None or b >= a for a, b in zip(times, times[1:])))
    assert got == want


def test_decoders_with_separators_and_line_ends(spark):
    made = "a\x1fb\x1fc\x1fd\x1fe\x1ff"
    line = '10.0.0.1 - - [10/Oct/2023:13:55:36 +0000] "GET /x\x1fy HTTP/1.1" 200 5 "r\x1f"'
    out = one(spark, D.decode_apache, made, line)
    assert out[0] is None and out[1].fields["path"] == "/x\x1fy"
    out = one(spark, lambda c: D.decode_syslog(c, strict=True), made, "<34>Jan  5 10:00:00 h app a\x1fb", "<34>Jan  5 10:00:00 h app a\rb", "<34>Jan  5 10:00:00 h app a\n", "<34>Jan  5 10:00:00 h app a\nb")
    assert [o and o.fields["message"] for o in out] == [None, "a\x1fb", "a\rb", None, None]
    out = one(spark, D.decode_windows, "2024/01/05 10:00:00 (S\x1f) m\x1f", "a\x1fb\x1fc\x1fd")
    assert out[0].fields["source"] == "S\x1f" and out[1] is None


def test_flapping_and_floods_empty(spark):
    df = spark.createDataFrame([], "k string, ts timestamp, id long, v double")
    assert correlate.flapping(df, "k", "ts", "id").count() == 0
    assert correlate.zscore_anomalies(df, "k", "v", ["ts", "id"]).count() == 0
    assert correlate.floods(df, correlate.flood_thresholds(df, "k", 60), "k", "ts").count() == 0


# ------------------------------------------------------------------ rule sets and files, host captures


def test_rule_sets_and_many_patterns(spark):
    service, cluster = rule_sets.service_rules(), rule_sets.cluster_rules()
    assert len(service) >= 400 and len(cluster) >= 34 and len({r.rule_id for r in service + cluster}) == len(service + cluster)
    assert rules.literal_of("^sshd.*(denied|refused)") == "sshd" and rules.literal_of("(a|b)") == "" and rules.literal_of("(") == ""
    rows = [(1, ["k8s:exec"], {"message": "SSHD: access Denied", "k8s_resource": "secrets"}, 1), (2, None, None, None), (3, [], {"message": "cron job failed\nsu failed"}, 0), (4, [], {"message": ""}, 9)]
    df = spark.createDataFrame(rows, "id int, tags array<string>, fields map<string,string>, severity int")
    some = [*service, *cluster, rules.Rule("ANY", condition="field:message ~= (denied|failed)"), rules.Rule("NIL", condition="field:message ~= nil"), rules.Rule("BAD", condition="field:message ~= ("), rules.Rule("SEV", condition="severity>=9")]
    many = sorted((r.id, r.rule_id) for r in rules.match_rules(df, some).collect())
    each = sorted((r.id, r.rule_id) for a in range(0, len(some), 60) for r in rules.match_rules(df, some[a : a + 60]).collect())
    assert many == each == sorted([(1, "SSHD_DENIED"), (1, "CLUSTER_SECRETS"), (1, "CLUSTER_BURST_K8S_EXEC"), (1, "ANY"), (2, "NIL"), (3, "CRON_FAILED"), (3, "ANY"), (4, "SEV")])


def test_rules_converted_and_loaded():
    items = [
        {"id": 1, "level": "5", "match": "Failed password", "mitre": ["T1110.001"], "frequency": "1", "timeframe": "120", "description": " x "},
        {"id": 2, "level": 2, "match": "a"}, {"id": 3, "level": 9}, {"id": 4, "level": 9, "regex": "^a\\d+", "noalert": "1"},
        {"id": 5, "level": 9, "regex": "^a\\d+", "frequency": 8}, {"id": 6, "level": 3, "match": "a.b", "decoded_as": "sshd"},
    ]
    out = {r.rule_id: r for r in rule_sets.convert_rules(items)}
    assert list(out) == ["CONV_1", "CONV_5", "CONV_6"]
    one, five, six = out.values()
    assert (one.condition, one.threshold, one.window_s, one.actions, one.description) == ("field:message ~= Failed password", 2, 120, (("ip-reputation", ()),), "x")
    assert (five.condition, five.threshold, five.window_s, five.actions[0][0], six.condition) == ("field:message ~= ^a\\d+", 8, 3600, "full-enrich", "tag:sshd")
    text = "rules:\n  - rule_id: A\n    condition: 'tag:x'\n    window: 5m\n    threshold: 3\n    suppress: 1h\n    actions:\n      - playbook: p\n        params: {ip: '${client_ip}'}\n"
    (r,) = rules.load_rules(text)
    assert (r.window_s, r.threshold, r.suppress_s, r.actions) == (300, 3, 3600, (("p", (("ip", "${client_ip}"),)),))
    good = feeds.load_correlation_rules('[{"name": "a", "window": 60000000000, "threshold": 3, "severity": 5, "event_types": ["x"]}]')
    assert (good[0]["window_s"], good[0]["kinds"]) == (60, ["x"])
    for bad in ("{}", '[{"window": 5, "threshold": 1}]', '[{"name": "a", "window": 0, "threshold": 1}]', '[{"name": "a", "window": 5, "threshold": 0}]'):
        with pytest.raises(ValueError):
            feeds.load_correlation_rules(bad)


def test_yar_files():
    text = """import "pe"
rule One : tag { meta: description = "d" severity = "high" strings: $a = "ab{c" nocase
  $h = { 4D 5A ?? 00 } condition: all of them }
rule Two { strings: $x = "q\\"t" $y = "z" condition: 1 of them } rule None_ { condition: true }"""
    one, two = content_scan.load_yar(text)
    assert (one.name, one.severity, one.strings, one.hexes, one.condition, one.exact) == ("One", 3, ("ab{c",), ("4D 5A ?? 00",), "all", False)
    assert (two.strings, two.condition, two.exact) == (('q"t', "z"), "1", True)
    hit = lambda d: [(m[0], m[3]) for m in content_scan.match_content(d, [one, two])]
    assert hit(b"MZ\x01\x00 AB{C") == [("One", 2)] and hit(b"AB{C") == [] and hit(b'q"t') == [("Two", 1)] and hit(b"") == []


def test_content_rules_of_every_kind(spark):
    names = lambda d, rs: {m[0] for m in content_scan.match_content(d, rs)}
    noise = np.random.default_rng(1).integers(0, 256, 4096, np.uint8).tobytes()
    assert names(noise, content_scan.MATCHER_RULES) == {"Suspicious_Entropy"} and names(b"MZ" + noise[:100], content_scan.MATCHER_RULES) == {"Packed_Binary"}
    assert "Packed_PE_Binary" in names(small_pe(b"UPX0"), content_scan.MATCHER_RULES) and names(small_pe(b"UPX0"), content_scan.SCANNER_RULES) == {"Packed_Binary"}
    assert names(b"run MIMIKATZ now", content_scan.MATCHER_RULES) == names(b"run MIMIKATZ now", content_scan.SCANNER_RULES) == {"Mimikatz_Strings"}
    body = bytearray(512)
    struct.pack_into("<5I", body, 0, 0x1040, 0, 0, 0x1060, 0)  # one library, its names at 0x1040
    struct.pack_into("<III", body, 0x40, 0x1080, 1 << 31 | 5, 0)
    body[0x82 : 0x82 + 16] = b"VirtualAllocEx\0\0"
    pe = bytearray(small_pe(body=bytes(body)))
    struct.pack_into("<I", pe, 0x98 + 96 + 8, 0x1000)
    assert content_scan.parse_executable(bytes(pe))["imports"] == ["VirtualAllocEx"]
    assert names(bytes(pe), content_scan.SCANNER_RULES) == {"Suspicious_Imports", "Process_Injection_API", "CobaltStrike_Beacon"}
    df = spark.createDataFrame([(1, bytearray(small_pe(b"UPX0"))), (2, None), (3, bytearray())], "id int, content binary")
    assert {(r.id, r.rule) for r in content_scan.scan_content(df, "id", "content").collect()} >= {(1, "Packed_PE_Binary")} and content_scan.scan_content(df.where("id > 1"), "id", "content").count() == 0
    t = dt.datetime(2024, 1, 1)
    files = spark.createDataFrame([("a", "h1"), ("a", "h1"), ("b", "h2"), ("c", "h3")], "path string, hash string")
    cache = spark.createDataFrame([("a", "h1", t), ("b", "h2", t - dt.timedelta(hours=2))], "path string, hash string, at timestamp")
    assert sorted(r.path for r in content_scan.unscanned(files, cache, ["path", "hash"], "at", F.lit(t).cast("timestamp")).collect()) == ["b", "c"]
    assert sorted(r.path for r in content_scan.unscanned(files, cache, ["path", "hash"]).collect()) == ["c"]


def test_captured_listings(spark):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "line string")
    ps = lines("USER PID %CPU %MEM VSZ RSS TTY STAT START TIME COMMAND", "root  17  0.0 0.1 1 2 ? S 10:00 0:00 /usr/sbin/sshd -D", "short 1")
    assert [tuple(r) for r in snapshots.parse_processes(ps, "line").collect()] == [(17, "root", "sshd", "/usr/sbin/sshd -D")]
    assert [tuple(r) for r in snapshots.parse_proc_status(lines("Name:\tsh\nPid:\t5\nPPid:\t1\n", "x"), "line").collect()] == [(5, 1, "sh")]
    pk = lines("bash-5.1.8-6.el9.x86_64", '{"DisplayName": "7-Zip 22", "DisplayVersion": "22.01"}', "zlib 1:1.3-2", "alone")
    assert [tuple(r) for r in snapshots.parse_packages(pk, "line").collect()] == [("bash", "5.1.8-6.el9"), ("7-Zip 22", "22.01"), ("zlib", "1:1.3-2")]
    conn = "local_ip string, local_port int, remote_ip string, remote_port int, protocol string, state string"
    before = spark.createDataFrame([("a", 1, "b", 2, "tcp", "ESTABLISHED"), ("a", 9, None, None, "tcp", "LISTEN")], conn)
    after = spark.createDataFrame([("a", 9, None, None, "tcp", "LISTEN"), ("a", 3, "*", 0, "tcp", "LISTEN"), ("a", 4, "c", 5, "udp", None)], conn)
    assert sorted((r.local_port, r.change) for r in snapshots.diff_connections(before, after).collect()) == [(1, "disconnect"), (3, "listen"), (4, "connect")]
    assert snapshots.diff_connections(before.where("false"), after.where("false")).count() == 0


def test_feeds_on_odd_bodies(spark):
    odd = spark.createDataFrame([(None,), ("",), ("{",), ("{}",), ("[]",), ('{"vulnerabilities": []}',)], "body string")
    assert feeds.parse_cves(odd, "body").count() == feeds.parse_abuse(odd, "body").count() == feeds.explode_batches(odd, "body").count() == 0
    assert {r.reputation for r in feeds.parse_engine_report(odd.withColumn("i", F.lit("x")), "i", "body").collect()} == {"unknown"}
    (a,) = feeds.parse_abuse(spark.createDataFrame([('{"data": {"ipAddress": "1.2.3.4", "abuseConfidenceScore": 60}}',)], "body string"), "body").collect()
    assert (a.ip, a.reputation, a.reports) == ("1.2.3.4", "malicious", None)
    batch = spark.createDataFrame([('{"agent_id": "a", "events": [{"id": "1", "type": "x"}, {"id": ""}, 7, {"id": "1", "type": "y"}]}',)], "body string")
    got = feeds.ingest_events(feeds.explode_batches(batch, "body").withColumn("n", F.monotonically_increasing_id()), "agent_id", "raw", "n").collect()
    assert [(r.id, r.event_type, r.agent_id) for r in got] == [("1", "x", "a")]
    (v,) = feeds.cve_table(feeds.parse_cves(spark.createDataFrame([('{"vulnerabilities": [{"cve": {"id": "C"}}]}',)], "body string"), "body")).collect()
    assert (v.cve_id, v.cvss, v.severity, v.affected) == ("C", 0.0, "LOW", [])


SIDECAR = """
import json, sys, time
for line in sys.stdin:
    c = json.loads(line)
    x = c["params"].get("input", {}).get("v")
    if c["method"] == "info":
        a = {"id": c["id"], "result": {"name": "double"}}
    elif x is None:
        a = {"id": c["id"], "error": "no input"}
    elif x == 7:
        time.sleep(30)
    elif x == 8:
        sys.exit(1)
    else:
        a = {"id": c["id"], "result": {"double": 2 * x}}
    print(json.dumps(a), flush=True)
"""


def test_sidecar(spark, tmp_path):
    (tmp_path / "s.py").write_text(SIDECAR)
    df = spark.createDataFrame([(i, i if i != 3 else None) for i in range(12)], "id int, v int").coalesce(1)
    got = {r.id: (r.result, r.error) for r in sidecar.run_sidecar(df, "id", ["v"], [sys.executable, str(tmp_path / "s.py")], "double", 2.0).collect()}
    assert got[5] == ('{"double": 10}', None) and got[3] == (None, "no input") and got[7][1] == "no answer in time" and got[8][1] and got[11][0] == '{"double": 22}' and len(got) == 12
    assert sidecar.run_sidecar(df.where("false"), "id", ["v"], ["no-such-program"], "x").count() == 0


def test_case_report_and_approvals(spark):
    events = spark.createDataFrame([("2024-01-01", "note", "<b>")], "created_at string, event_type string, content string")
    found = spark.createDataFrame([("ip", "1.2.3.4")], "type string, value string")
    assert "&lt;b&gt;" in store.render_case({"id": 1, "title": "T"}, events, found, "html") and "- ip: 1.2.3.4" in store.render_case({"title": "T"}, events, found, "md")
    df = spark.createDataFrame([(i,) for i in range(4)], "id int")
    said = spark.createDataFrame([(0, "a.b", "approved"), (1, "a.b", "approved"), (1, "a.b", "denied"), (3, "other", "approved")], "id int, step string, decision string")
    reg = {"a.b": lambda s, p: s.select("id", F.lit(1).alias("x")), "a.bad": lambda s, p: 1 / 0}
    state, events = playbook.run_playbook(df, "id", [playbook.Step("a", "bad", optional=True), playbook.Step("a", "b", wait=True), playbook.Step("a", "bad")], reg, said)
    assert {r.id: r.status for r in state.collect()} == {0: "failed", 1: "denied", 2: "waiting_approval", 3: "waiting_approval"}
    assert [r.event for r in events.where("id = 0").orderBy("step_no").collect()] == ["playbook_started", "step_failed_optional", "step_waiting_approval", "step_approved", "step_completed", "step_failed"]


# ------------------------------------------------------------------ sources and streams


def test_tail_reader_and_collector(spark, tmp_path):
    """The reader's own protocol: offsets, partitions and lines, over appended, shrunk and received data."""
    (tmp_path / "a.log").write_bytes(b"one\n\ntwo\nhal")
    reader = logs.TailSource({"path": str(tmp_path)}).streamReader(None)
    at = reader.initialOffset()

    def drain():
        nonlocal at
        end = reader.latestOffset()
        out = [x for p in reader.partitions(at, end) for x in reader.read(p)]
        at = end
        return out

    assert drain() == [("file:a.log", "one"), ("file:a.log", "two")] and drain() == []
    with open(tmp_path / "a.log", "ab") as f:
        f.write(b"f\n")
    assert drain() == [("file:a.log", "half")]
    (tmp_path / "a.log").write_bytes(b"new\n")
    assert drain() == [("file:a.log", "new")]
    for tcp in (False, True):
        collector = logs.SyslogCollector(str(tmp_path), tcp=tcp)
        got = threading.Thread(target=collector.receive, args=(1, 5.0), daemon=True)
        got.start()
        with socket.socket(socket.AF_INET, socket.SOCK_STREAM if tcp else socket.SOCK_DGRAM) as s:
            s.settimeout(5)
            s.connect(("127.0.0.1", collector.port))
            s.send(b"<34>tcp\n" if tcp else b"<34>udp")
        got.join(10)
        collector.close()
        assert drain() == [("file:syslog-127.0.0.1", "<34>tcp" if tcp else "<34>udp")]
    assert logs.read_lines(spark, str(tmp_path)).count() == 3


def test_tail_as_a_stream(spark, tmp_path):
    """Lines appended while the query runs, one file after another, come once each."""
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "a.log").write_text("one\ntwo\nhal")
    spark.dataSource.register(logs.TailSource)
    q = stateful.to_tables(spark.readStream.format("emberlog-tail").load(str(folder)), out, str(tmp_path / "checkpoint"), "tail").trigger(processingTime="300 milliseconds").start()

    def lines(n):
        until = time.time() + 60
        while time.time() < until:
            try:
                got = sorted(r.raw for r in spark.read.parquet(out).collect())
            except Exception:  # noqa: BLE001 - nothing is written yet, or a batch is being written
                got = []
            if len(got) >= n:
                return got
            time.sleep(0.3)
        return got

    try:
        assert lines(2) == ["one", "two"]
        with open(folder / "a.log", "a") as f:
            f.write("f\n")
        (folder / "b.log").write_text("x\n")
        assert lines(4) == ["half", "one", "two", "x"]
    finally:
        q.stop()


def test_collector_takes_many_connections(tmp_path):
    collector = logs.SyslogCollector(str(tmp_path), tcp=True)
    open_ = [socket.create_connection(("127.0.0.1", collector.port), 5) for _ in range(5)]
    for i, s in enumerate(open_):
        s.sendall(f"<34>line {i}\n\n".encode())
    open_[0].sendall(b"x" * 70_000 + b"\n")
    for s in open_:
        s.close()
    assert collector.receive(5, 10) == 7
    collector.close()
    got = (tmp_path / "syslog-127.0.0.1").read_bytes().splitlines()
    assert sorted(map(len, got)) == [10] * 5 + [4464, 65536]


def test_sources_of_captures(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name, size in (("a.txt", 3), ("B.TMP", 3), ("c.db", 3), ("d/e.bin", 3), ("big", 50)):
        (tmp_path / name).write_bytes(b"x" * size)
    got = {os.path.basename(r.path) for r in logs.scan_files(spark, str(tmp_path), 10, [".tmp"]).collect()}
    assert got == {"a.txt", "e.bin"}
    assert json.loads(logs.search_body("a AND b"))["query"] == {"query_string": {"query": "a AND b"}} and json.loads(logs.search_body('{"match_all": {}}'))["query"] == {"match_all": {}}
    body = spark.createDataFrame([('[{"index": "logs", "health": "green", "docs.count": "5"}, {"index": ".hidden"}]',), ("x",)], "body string")
    assert [tuple(r) for r in logs.flatten_indices(body, "body").collect()] == [("logs", "green", 5)]
    fired = spark.createDataFrame([('{"entry": [{"name": "a", "content": {"severity": 3, "trigger_time": 0, "triggered_alert_count": 2}}, {"name": "b", "content": {}}]}',)], "body string")
    assert [(r.name, r.severity, r.events) for r in logs.fired_alerts(fired, "body").collect()] == [("a", 3, 2)]
    assert [r.raw for r in logs.ingest_lines(spark, ["a", " ", None], "s").collect()] == ["a"]


def file_stream(spark, tmp_path, rows, schema, files):
    src = str(tmp_path / "in")
    for n in range(files):
        spark.createDataFrame(rows[n * len(rows) // files : (n + 1) * len(rows) // files], schema).coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)


def test_rule_stream_like_batch(spark, tmp_path):
    """Thresholds and suppression over four micro-batches equal the batch engine; a repeated batch changes nothing."""
    t0, r = dt.datetime(2024, 1, 1), random.Random(3)
    rows = [(i, t0 + dt.timedelta(seconds=i * 4), ["x"] if r.random() < 0.7 else ["y"], {"client_ip": "a" if i % 3 else "b"}, 1) for i in range(80)]
    schema = "id long, ts timestamp, tags array<string>, fields map<string,string>, severity int"
    some = [rules.Rule("MULTIPLE_FAILED_LOGINS", condition="tag:x", window_s=20, threshold=3), rules.Rule("B", condition="tag:x", window_s=60, threshold=2, suppress_s=15), rules.Rule("C", condition="tag:y")]
    engine = stateful.RuleStream(spark, str(tmp_path / "out"), some, "ts", "id")
    stream = file_stream(spark, tmp_path, rows, schema, 4)
    q = engine.start(stream, str(tmp_path / "checkpoint"))
    assert q.awaitTermination(120)
    key = lambda df: sorted((a.rule_id, a.id, a.in_window) for a in df.collect())
    want = key(rules.evaluate(spark.createDataFrame(rows, schema), some, "ts", "id"))
    assert key(engine.alerts()) == want and len({w[0] for w in want}) == 3
    engine.step(spark.createDataFrame(rows[60:], schema), 3)
    assert key(engine.alerts()) == want


def test_first_seen_counts_and_sink_on_a_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, f"k{i % 7}", t0 + dt.timedelta(seconds=i)) for i in range(90)]
    schema = "id long, k string, ts timestamp"
    stream = file_stream(spark, tmp_path, rows, schema, 3)
    q = stateful.to_tables(stateful.stream_first_seen(stream, ["k"], "ts", "1 hour"), str(tmp_path / "first"), str(tmp_path / "c1"), "first").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "first")).collect()) == [f"k{i}" for i in range(7)]
    q = stateful.to_tables(stateful.stream_counts(stream, "ts", [], "30 seconds", "30 seconds", "1 second", 5), str(tmp_path / "n"), str(tmp_path / "c2"), "n").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(r.events for r in spark.read.parquet(str(tmp_path / "n")).collect())[:2] == [30, 30]
    q = stateful.to_tables(stateful.stream_sessions(stream.where("id < 20 OR id > 60").withColumn("g", F.lit("g")), "ts", ["g"], "5 seconds", "1 second"), str(tmp_path / "s"), str(tmp_path / "c3"), "s").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert 20 in [r.events for r in spark.read.parquet(str(tmp_path / "s")).collect()]


def test_send_batches_retries(spark, tmp_path):
    out = str(tmp_path)

    def send(rows):
        flag = os.path.join(out, f"failed-{rows[0]['id']}")
        if not os.path.exists(flag):
            open(flag, "w").close()
            raise OSError("not now")
        with open(os.path.join(out, f"sent-{rows[0]['id']}"), "w") as f:
            json.dump(rows, f)

    stateful.send_batches(spark.range(250).repartition(2), send, 100, first_wait_s=0.01, per_second=100_000)
    sent = [json.load(open(os.path.join(out, f))) for f in os.listdir(out) if f.startswith("sent-")]
    assert sorted(x["id"] for s in sent for x in s) == list(range(250)) and all(len(s) <= 100 for s in sent)


def test_json_lines_and_hits(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"ts": "2024-01-02", "v": 1}\nbroken\n\n{"ts": "2024-01-01", "v": 2}\n')
    assert [r.v for r in logs.read_json_lines(spark, str(tmp_path), "ts string, v int", "ts", "2024-01-02").collect()] == [1]
    body = json.dumps({"hits": {"hits": [{"_id": "1", "_index": "i", "_score": 1.5, "_source": {"a": "b"}}]}})
    (h,) = logs.flatten_hits(spark.createDataFrame([(body,), ("{}",), (None,)], "body string"), "body").collect()
    assert (h["_id"], h.source) == ("1", {"a": "b"})
    lines = spark.createDataFrame([('{"result": {"_raw": "x", "n": "1"}}',), ('{"result": {}}',), ("junk",)], "line string")
    assert [r.raw for r in logs.search_results(lines, "line").collect()] == ["x"]

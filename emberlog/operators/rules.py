"""The rule language compiled to columns, and its evaluation over batches of events.

Conditions: ``tag:T`` (a tag equals or contains T), ``field:F OP V`` with OP one of == != ~= > < in, and
``severity>=N``. A missing field compares as the text ``<nil>``; a comparison of numbers reads anything else as 0;
``in`` compares the network part as a text prefix, or exactly with ``exact_networks``. An empty, unknown or invalid
condition never matches.
"""

from __future__ import annotations

import ipaddress
import json
import re
import re._parser as re_parser
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from emberlog.operators.gate import gate_events
from emberlog.operators.ordered import time_cells

#: Rules whose count is kept by address, else host name; all others count as a whole.
KEYED_RULES = ("MULTIPLE_FAILED_LOGINS", "HTTP_4XX_BURST")


@dataclass(frozen=True)
class Rule:
    rule_id: str
    description: str = ""
    severity: int = 0
    mitre: str = ""
    condition: str = ""
    window_s: int = 0
    threshold: int = 1
    suppress_s: int = 0
    actions: tuple = field(default=())


#: The rules built in.
BUILTIN = [
    Rule("MULTIPLE_FAILED_LOGINS", "Multiple failed login attempts from same source", 4, "T1110.003", "tag:auth_failure", 60, 5, actions=(("ip-reputation", (("ip", "${source_ip}"),)),)),
    Rule("FAILED_LOGIN_BRUTE", "Single source brute-forcing login", 5, "T1110", "tag:auth_failure", 60, 20),
    Rule("HTTP_5XX_ERROR", "Server error response", 3, "", "tag:http_error"),
    Rule("HTTP_4XX_BURST", "Multiple client errors from same source", 2, "", "tag:http_client_error", 60, 10, actions=(("ip-reputation", (("ip", "${client_ip}"),)),)),
    Rule("SUSPICIOUS_PROCESS", "Suspicious process execution detected", 4, "T1059", "tag:process", actions=(("file-analysis", (("path", "${process_path}"),)),)),
    Rule("HIGH_SEVERITY_ERROR", "High severity error in system logs", 3, "", "tag:error"),
    Rule("WINDOWS_EVENT_4625_BURST", "Multiple Windows failed logon events", 4, "T1110.003", "tag:auth_failure", 60, 5),
    Rule("BRUTE_FORCE_FALLBACK", "Multiple auth failures from same source (any service)", 3, "T1110", "field:message ~= (?i)failed", 120, 10),
    Rule("WIN_POWERSHELL_4104", "PowerShell script block logging (Event 4104)", 3, "T1059.001", "tag:powershell", actions=(("log-analysis", (("event_id", "4104"),)),)),
    Rule("WIN_SCHEDULED_TASK_4698", "Scheduled task created (Event 4698) — potential persistence", 4, "T1053.005", "tag:persistence", actions=(("file-analysis", (("path", "${process_path}"),)),)),
    Rule("WIN_SERVICE_INSTALL_7045", "New service installed (Event 7045)", 4, "T1543.003", "tag:service_install"),
    Rule("WIN_DEFENDER_1116", "Windows Defender detected malware (Event 1116)", 5, "T1204", "tag:malware_detection", actions=(("file-analysis", (("path", "${file_path}"),)),)),
    Rule("WIN_PROCESS_4688_CREATION", "Process creation with command line (Event 4688)", 2, "T1059", "tag:process_creation"),
    Rule("WIN_REGISTRY_PERSISTENCE", "Registry persistence modification (Event 4657)", 3, "T1547.001", "tag:registry_change"),
    Rule("WIN_RDP_LOGIN_4625", "RDP failed login (Event 4625, LogonType 10)", 3, "T1021.001", "field:logontype == 10"),
    Rule("WIN_ACCOUNT_LOCKOUT_4740", "User account locked out (Event 4740)", 3, "T1110", "tag:account_lockout"),
]

_UNITS = {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86400}


def seconds(duration: str | int | None) -> int:
    """``90``, ``60s``, ``1h30m`` as seconds; anything unreadable is 0."""
    if duration is None or isinstance(duration, bool):
        return 0
    if isinstance(duration, (int, float)):
        return int(duration)
    parts = re.findall(r"(\d+(?:\.\d+)?)(ms|s|m|h|d)", duration)
    return int(sum(float(n) * _UNITS[u] for n, u in parts)) if parts and "".join(n + u for n, u in parts) == duration.strip() else 0


def rules_from(items: list[dict]) -> list[Rule]:
    """Rules from parsed YAML or JSON (``rule_id`` or ``name``, ``condition``, ``window``, ...); those without an id or condition are left out."""
    out = []
    for r in items:
        rid = r.get("rule_id") or r.get("name")
        if rid and r.get("condition"):
            acts = tuple((a.get("playbook", ""), tuple((a.get("params") or {}).items())) for a in r.get("actions") or [])
            out.append(Rule(rid, r.get("description", ""), int(r.get("severity", 0)), r.get("mitre", "") or "", r["condition"], seconds(r.get("window")), int(r.get("threshold", 1) or 1), seconds(r.get("suppress")), acts))
    return out


def load_rules(text: str) -> list[Rule]:
    """A rules file: JSON, or YAML where its parser is installed."""
    try:
        data = json.loads(text)
    except ValueError:
        import yaml

        data = yaml.safe_load(text)
    return rules_from(data.get("rules", []) if isinstance(data, dict) else data or [])


def union_rules(*sets: list[Rule]) -> list[Rule]:
    """Rules in load order; of an id given twice the first stays."""
    return list({r.rule_id: r for s in reversed(sets) for r in reversed(s)}.values())[::-1]


def _java_pattern(pattern: str) -> str | None:
    pattern = pattern.strip('"').replace(r"\z", r"\Z")
    try:
        re.compile(re.sub(r"^\(\?i\)", "", pattern))
    except re.error:
        return None
    return "(?i)" + pattern


def field_text(fields: Column, name: str) -> Column:
    """The field as text; a dotted path walks JSON text held by its first part; missing is ``<nil>``."""
    value = F.element_at(fields, F.lit(name))
    if "." in name:
        head, _, path = name.partition(".")
        value = F.coalesce(value, F.get_json_object(F.element_at(fields, F.lit(head)), f"$.{path}"))
    return F.coalesce(value, F.lit("<nil>"))


def in_network(ip: Column, network: str) -> Column:
    """Exact membership of a dotted IPv4 address."""
    try:
        net = ipaddress.ip_network(network, strict=False)
    except ValueError:
        return F.lit(False)
    parts = F.split(ip, r"\.")
    number = reduce(lambda a, i: a * 256 + F.get(parts, i).try_cast("long"), range(1, 4), F.get(parts, 0).try_cast("long"))
    valid = ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    low = int(net.network_address)
    return F.coalesce(valid & number.between(low, low + net.num_addresses - 1), F.lit(False))


def compile_condition(condition: str, tags: Column, fields: Column, severity: Column, exact_networks: bool = False) -> Column:
    never = F.lit(False)
    if condition.startswith("tag:"):
        want = F.lit(condition[4:])
        return F.coalesce(F.exists(tags, lambda t: F.contains(t, want)), never)
    if condition.startswith("severity>="):
        n = condition[10:].strip()
        return F.coalesce(severity >= (int(n) if re.fullmatch(r"-?\d+", n) else 0), never)
    if not condition.startswith("field:"):
        return never
    parts = condition[6:].split(" ", 2)
    if len(parts) < 3:
        return never
    name, op, value = parts
    text = field_text(fields, name)
    if op == "==":
        return text == value
    if op == "!=":
        return text != value
    if op == "~=":
        pattern = _java_pattern(value)
        return never if pattern is None else text.rlike(pattern)
    if op in (">", "<"):
        have = F.coalesce(text.try_cast("double"), F.lit(0.0))
        try:
            limit = float(value)
        except ValueError:
            limit = 0.0
        return have > limit if op == ">" else have < limit
    if op == "in":
        return in_network(text, value) if exact_networks else text.startswith(value.split("/")[0])
    return never


#: From so many rules over the message on, one pass of an automaton over the message finds those that can match.
MANY = 64
MESSAGE = "field:message ~= "


def literal_of(pattern: str) -> str:
    """The longest text (in lower case) that every match of a pattern contains; empty if there is none."""
    try:
        parsed = re_parser.parse(pattern, re.IGNORECASE)
    except re.error:
        return ""
    best = run = ""
    for op, arg in parsed:
        if str(op) == "LITERAL":
            run += chr(arg).lower()
            best = max(best, run, key=len)
        elif str(op) != "AT":
            run = ""
    return best if best.isascii() else ""


def _message_matcher(patterns: list[tuple[int, str]]):
    """Messages -> the numbers of the patterns that match: their literals by one automaton, then the patterns themselves."""
    by_literal: dict[str, list[int]] = {}
    for i, p in patterns:
        by_literal.setdefault(literal_of(p), []).append(i)
    sources = dict(patterns)

    def prepare():
        compiled = {i: re.compile(p, re.IGNORECASE) for i, p in sources.items()}
        words = [w for w in by_literal if w]
        try:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for w in words:
                automaton.add_word(w, w)
            if words:
                automaton.make_automaton()
            seen = (lambda text: {w for _, w in automaton.iter(text)}) if words else (lambda text: set())
        except ImportError:
            seen = lambda text: {w for w in words if w in text}
        return compiled, seen

    state = []

    @pandas_udf("array<int>")
    def matches(texts: pd.Series) -> pd.Series:
        if not state:
            state.append(prepare())
        compiled, seen = state[0]
        always = by_literal.get("", [])
        return pd.Series([sorted(i for i in [*always, *(i for w in seen(t.lower()) for i in by_literal[w])] if compiled[i].search(t)) for t in texts])

    return matches


def match_rules(events: DataFrame, rules: list[Rule], tags: str = "tags", fields: str = "fields", severity: str = "severity") -> DataFrame:
    """A row for each event and matching rule: the event's columns with rule_id, rule_severity, threshold, window_s, suppress_s, corr_key.

    All rules are one projection: an array of the ids that match, exploded. No join, no pass a rule. Where there are
    hundreds of patterns over the message, these are matched in Arrow batches by an automaton of their literals.
    """
    if not rules:
        return events.withColumns({"rule_id": F.lit(""), "rule_severity": F.lit(0), "threshold": F.lit(0), "window_s": F.lit(0), "suppress_s": F.lit(0), "corr_key": F.lit("")}).where(F.lit(False))
    t, f, s = F.col(tags), F.col(fields), F.col(severity)
    told = lambda r: F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("rule_severity"), F.lit(r.threshold).alias("threshold"), F.lit(r.window_s).alias("window_s"), F.lit(r.suppress_s).alias("suppress_s"))
    over = [(i, r.condition[len(MESSAGE) :].strip('"')) for i, r in enumerate(rules) if r.condition.startswith(MESSAGE) and _java_pattern(r.condition[len(MESSAGE) :]) is not None]
    if len(over) < MANY:
        hits = F.filter(F.array(*[F.when(compile_condition(r.condition, t, f, s), told(r)) for r in rules]), lambda h: h.isNotNull())
    else:
        others = [i for i in range(len(rules)) if i not in dict(over)]
        some = F.filter(F.array(*[F.when(compile_condition(rules[i].condition, t, f, s), F.lit(i)) for i in others]), lambda h: h.isNotNull()) if others else F.array().cast("array<int>")
        all_rules = F.array(*[told(r) for r in rules])
        hits = F.transform(F.concat(some, _message_matcher(over)(field_text(f, "message"))), lambda i: F.get(all_rules, i))
    out = events.withColumn("__hit", F.explode(hits))
    keyed = F.coalesce(F.element_at(f, F.lit("client_ip")), F.element_at(f, F.lit("hostname")), F.lit("<nil>"))
    return out.select(*[c for c in out.columns if c != "__hit"], "__hit.*", F.when(F.col("__hit.rule_id").isin(*KEYED_RULES), keyed).otherwise("").alias("corr_key"))


def threshold_alerts(matches: DataFrame, time: str, by: list[str], threshold: Column | int, window_s: Column | int, tie: str | None = None, lengths: list[int] | None = None) -> DataFrame:
    """Rows whose trailing count within the window reaches the threshold, with ``in_window``; every further event fires again.

    The window is (t - w, t] on event time; events of equal time count for each other. ``window_s`` may differ by
    row: ``lengths`` names those that occur (found by a pass where it is not given), and all are counted over one sort.
    Without a window (null or 0) every row fires, with 1, whatever the threshold. A row without time is in no window and
    counts 1: it fires where the threshold is 1 or less.
    """
    own = F.lit(window_s) if isinstance(window_s, int) else F.greatest(F.coalesce(window_s.cast("int"), F.lit(0)), F.lit(0))
    if isinstance(window_s, int):
        lengths = [window_s]
    elif lengths is None:
        lengths = [r[0] for r in matches.select(own.alias("w")).distinct().collect()]  # at most one a rule
    spans = sorted({n for n in lengths if n > 0})
    one = F.lit(1).cast("long")
    if not spans:
        return matches.withColumn("in_window", one)
    # by time cells too: most rules count all events under one key
    counted = matches.withColumns({"__us": F.unix_micros(F.col(time).cast("timestamp")), "__w": own})
    lone = counted.where((F.col("__w") <= 0) | F.col("__us").isNull()).withColumn("in_window", one)
    cells = time_cells(counted.where((F.col("__w") > 0) & F.col("__us").isNotNull()), "__us", spans[-1] * 1_000_000)
    count = lambda n: F.count("*").over(Window.partitionBy(*by, "__w", "cell").orderBy("__us").rangeBetween(-(n * 1_000_000 - 1), 0))
    n = count(spans[0])
    for x in spans[1:]:
        n = F.when(F.col("__w") == x, count(x)).otherwise(n)
    counted = cells.withColumn("in_window", n).where("own").drop("cell", "own").unionByName(lone)
    return counted.where((F.col("__w") <= 0) | (F.col("in_window") >= threshold)).drop("__us", "__w")


def suppress_matches(matches: DataFrame, rules: list[Rule], time: str, tie: str) -> DataFrame:
    """Matches that pass the suppression of their rule: none within ``suppress_s`` after one that passed, whatever its key.

    Suppression comes before the threshold, so what it holds back does not count. Matches without time pass.
    """
    gaps = sorted({r.suppress_s for r in rules if r.suppress_s > 0})
    parts = [matches.where((F.col("suppress_s") <= 0) | F.col(time).isNull())]
    for g in gaps:
        some = matches.where((F.col("suppress_s") == g) & F.col(time).isNotNull())
        parts.append(gate_events(some, "rule_id", time, tie, g * 1_000_000).where("passes").drop("passes", "anchor_us"))
    return reduce(DataFrame.unionByName, parts)


def evaluate(events: DataFrame, rules: list[Rule], time: str, tie: str) -> DataFrame:
    """The whole engine over a batch of events: match, suppress, count within the window; a row an alert."""
    passed = suppress_matches(match_rules(events, rules), rules, time, tie)
    # a threshold of one needs no window
    window = F.when(F.col("threshold") > 1, F.col("window_s")).otherwise(0)
    return threshold_alerts(passed, time, ["rule_id", "corr_key"], F.col("threshold"), window, lengths=[r.window_s for r in rules if r.threshold > 1])


def interpolate(template: str, fields: Column) -> Column:
    """``${name}`` replaced by the event's field; names without a field stay."""
    parts = re.split(r"(\$\{[^}]*\})", template)
    cols = [F.coalesce(F.element_at(fields, F.lit(p[2:-1])), F.lit(p)) if p.startswith("${") else F.lit(p) for p in parts if p]
    return F.concat(*cols) if cols else F.lit("")


def actions_of(alerts: DataFrame, rules: list[Rule], fields: str = "fields") -> DataFrame:
    """A row for each alert and action of its rule: playbook and interpolated parameters."""
    arms = F.array().cast("array<struct<playbook:string,params:map<string,string>>>")
    for r in rules:
        if r.actions:
            acts = F.array(*[F.struct(F.lit(p).alias("playbook"), (F.create_map(*[x for k, v in params for x in (F.lit(k), interpolate(str(v), F.col(fields)))]) if params else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("params")) for p, params in r.actions])
            arms = F.when(F.col("rule_id") == r.rule_id, acts).otherwise(arms)
    return alerts.withColumn("__a", F.explode(arms)).select(*alerts.columns, "__a.*")


def alert_id(rule_id: Column, time: Column) -> Column:
    """Deterministic: rule and event time in microseconds."""
    return F.concat_ws("-", rule_id, F.unix_micros(time.cast("timestamp")).cast("string"))


def map_controls(rules: DataFrame, controls: DataFrame) -> DataFrame:
    """(rule_id, framework, control_id): controls of each technique in the rule's comma list; without any, by severity."""
    ids = rules.select("rule_id", "severity", F.explode(F.transform(F.split(F.coalesce("mitre", F.lit("")), ","), lambda t: F.trim(t))).alias("technique"))
    mapped = ids.join(controls, "technique").select("rule_id", "framework", "control_id")
    fallback = F.when(F.col("severity") >= 10, F.array(F.struct(F.lit("pci_dss_v4.0"), F.lit("6.2")), F.struct(F.lit("hipaa"), F.lit("164.312(a)(1)")), F.struct(F.lit("gdpr"), F.lit("Art.32"))))
    fallback = fallback.when(F.col("severity") >= 7, F.array(F.struct(F.lit("pci_dss_v4.0"), F.lit("6.2")), F.struct(F.lit("hipaa"), F.lit("164.308(a)(1)(i)"))))
    fallback = fallback.when(F.col("severity") >= 4, F.array(F.struct(F.lit("pci_dss_v3.2.1"), F.lit("6.2")), F.struct(F.lit("nist_sp_800-53"), F.lit("AU-12"))))
    rest = rules.join(mapped.select("rule_id").distinct(), "rule_id", "left_anti").select("rule_id", F.explode(fallback).alias("c")).select("rule_id", F.col("c.col1").alias("framework"), F.col("c.col2").alias("control_id"))
    return mapped.unionByName(rest)

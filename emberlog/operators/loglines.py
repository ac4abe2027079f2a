"""Semi-structured log lines into timestamp, level, component and message.

A fixed-depth template tree: the leading tokens of a line are masked (dates, clocks, levels, numbers, ...), the
line is routed by the count of all its tokens and its first two masks to a leaf, and merged there into the most
similar template. The positions of the fields are derived once from a template's masks, by their kinds and not from a
list of layouts; lines then give their fields by position. Lines whose template has no header belong to the entry
before, lines of one file are read in order, and files are cut into range partitions. Lines before a partition's first
entry are read twice, once as the rest of an object that the partition before left open and once as plain lines; which
reading holds is decided when the border pieces are put together, so entries do not depend on where partitions end.
"""

from __future__ import annotations

import datetime as dt
import json
import pickle
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.operators.ordered import chunked
from emberlog.session import materialise

#: Tokens masked at first (all of them where a header goes on beyond), and the share of equal masks that lets a line join a template.
HEAD, SIMILAR = 8, 0.7
#: Entries of the caches of masks and templates a worker keeps before it starts anew.
CACHED = 100_000
#: Branches of a node of the tree and templates of a leaf; further masks share one branch, further lines are read by their own masks.
BRANCHES, LEAF = 200, 200

#: Level words and letters, syslog severities, months, names of keys.
LEVELS = {
    "trace": "debug", "debug": "debug", "dbg": "debug", "d": "debug",
    "info": "info", "information": "info", "informational": "info", "notice": "info", "i": "info", "n": "info",
    "warn": "warn", "warning": "warn", "w": "warn",
    "err": "error", "error": "error", "e": "error",
    "fatal": "fatal", "crit": "fatal", "critical": "fatal", "alert": "fatal", "emerg": "fatal", "panic": "fatal", "f": "fatal", "c": "fatal",
}
SYSLOG = ["fatal", "fatal", "fatal", "error", "warn", "info", "info", "debug"]
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
TIME_KEYS = ("ts", "time", "timestamp", "@timestamp", "t")
LEVEL_KEYS = ("level", "severity", "lvl", "loglevel")
NAME_KEYS = ("component", "logger", "module", "program", "service")
TEXT_KEYS = ("msg", "message", "text")

_WORD = "|".join(k for k in LEVELS if len(k) > 1)
_MON = "|".join(MONTHS)
_ISO = r"\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d(?:[.,]\d+)?(?:[Zz]|[+-]\d\d:?\d\d)?"
_DATE = r"\d{4}[-/.]\d\d[-/.]\d\d"
_TIME = r"\d\d:\d\d:\d\d(?:[.,]\d+)?"
_SHIFT = r"(?:[Zz]|[+-]\d\d:?\d\d)"
MASKS = [
    ("PRI5", r"<\d{1,3}>\d{1,2}"),
    ("PRI3", rf"<\d{{1,3}}>(?:{_MON})"),
    ("ISO", _ISO),
    ("ISOBOX", rf"\[{_ISO}\]"),
    ("DATE", _DATE),
    ("DATEOPEN", rf"\[{_DATE}"),
    ("TIME", _TIME),
    ("ZTIME", _TIME + _SHIFT),
    ("TIMESHUT", rf"{_TIME}(?:{_SHIFT})?\]"),
    ("SHIFT", rf"{_SHIFT}|utc|gmt"),
    ("GLOG", r"[A-Z](?:0[1-9]|1[0-2])[0-3]\d"),
    ("DAYOPEN", r"\[(?:mon|tue|wed|thu|fri|sat|sun)"),
    ("MON", _MON),
    ("YEARSHUT", r"\d{4}\]"),
    ("ACCESS", rf"\[\d\d?/(?:{_MON})/\d{{4}}:\d\d:\d\d:\d\d"),
    ("SHIFTSHUT", r"[+-]\d{4}\]"),
    ("KEYTIME", rf"(?:{'|'.join(TIME_KEYS)})=(?:{_ISO}|\"{_ISO.replace('[Tt]', '[Tt ]')}\")"),
    ("KEYLEVEL", rf"(?:{'|'.join(LEVEL_KEYS)})=(?:{_WORD}|\"(?:{_WORD})\")"),
    ("KEYNAME", rf"(?:{'|'.join(NAME_KEYS)})=(?:\"[^\"]+\"|\S+)"),
    ("KEYTEXT", rf"(?:{'|'.join(TEXT_KEYS)})=[\s\S]*"),
    ("NAMELEVEL", rf"\[[^\s\]]+:(?:{_WORD})\]"),
    ("LEVELCOLON", rf"(?:{_WORD}):"),
    ("LEVEL", _WORD),
    ("LEVELBOX", rf"\[(?:{_WORD})\]"),
    ("PAREN", r"\([^\s()]+\)"),
    ("BRACKET", r"\[[^\s\[\]]+\]"),
    ("NAMELINE", r"[^\s:\]]+:\d+\]"),
    ("TAG", r"[^\s:\[\]]+(?:\[\d+\])?:"),
    ("PAIR", r"[A-Za-z_@][\w.-]*=[\s\S]*"),
    ("NUM", r"\d+"),
    ("JSON", r"\{.*"),
    ("VAR", r"\S*\d\S*"),
]
_MASK = re.compile("|".join(f"(?P<{n}>{p})" for n, p in MASKS), re.IGNORECASE | re.ASCII)
ANY = "<*>"


_PAIR = re.compile(r"[^\s=\"]+=\"(?:[^\"\\]|\\.)*\"(?!\S)|\S+", re.DOTALL)


def tokens_of(raw: str) -> list[str]:
    """Blank-separated tokens; in a line of key=value pairs a quoted value is one token with its key."""
    tokens = raw.split()
    return _PAIR.findall(raw) if "=" in tokens[0] and '"' in raw else tokens


def masked(token: str) -> str:
    m = _MASK.fullmatch(token)
    return f"<{m.lastgroup}>" if m else token


def _utc(t: dt.datetime) -> int:
    off = t.utcoffset()
    d = t.replace(tzinfo=None) - dt.datetime(1970, 1, 1)
    us = (d.days * 86400 + d.seconds) * 1_000_000 + d.microseconds
    return us - ((off.days * 86400 + off.seconds) * 1_000_000 if off else 0)


def iso_us(text: str) -> int:
    return _utc(dt.datetime.fromisoformat(text.replace(",", ".")))


def _clock(text: str) -> tuple[int, int, int, int]:
    whole, _, part = text.replace(",", ".").partition(".")
    h, m, s = whole.split(":")
    return int(h), int(m), int(s), int(part.ljust(6, "0")[:6]) if part else 0


def _latest(month: int, day: int, clock, read_us: int | None) -> int:
    """The latest year that does not put the entry after ``read_us``."""
    if read_us is None:
        raise ValueError("no reading time")
    year = (dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=read_us)).year + 1
    for y in range(year, year - 12, -1):
        try:
            at = _utc(dt.datetime(y, month, day, *clock))
        except ValueError:
            continue
        if at <= read_us:
            return at
    raise ValueError("no year fits")


def _date_time(date: str, clock: str, shift: str = "") -> int:
    return iso_us(f"{date[:4]}-{date[5:7]}-{date[8:10]}T{clock}{'' if shift.upper() in ('Z', 'UTC', 'GMT') else shift}")


def _day_first(t, i, at):
    return _utc(dt.datetime(int(t[i + 4][:-1]), MONTHS[t[i + 1][:3].lower()], int(t[i + 2]), *_clock(t[i + 3])))


def _access(t, i, at):
    day, mon, rest = t[i][1:].split("/")
    year, _, clock = rest.partition(":")
    off = t[i + 1][:-1]
    shift = dt.timedelta(hours=int(off[1:3]), minutes=int(off[3:5])) * (1 if off[0] == "+" else -1)
    return _utc(dt.datetime(int(year), MONTHS[mon.lower()], int(day), *_clock(clock), tzinfo=dt.timezone(shift)))


#: Masks that make a time, and what reads it from the tokens at a position; the first that fits counts.
TIMES = [
    (("<DAYOPEN>", "<MON>", "<NUM>", "<TIME>", "<YEARSHUT>"), _day_first),
    (("<GLOG>", "<TIME>"), lambda t, i, at: _latest(int(t[i][1:3]), int(t[i][3:5]), _clock(t[i + 1]), at)),
    (("<PRI5>", "<ISO>"), lambda t, i, at: iso_us(t[i + 1])),
    (("<PRI3>", "<NUM>", "<TIME>"), lambda t, i, at: _latest(MONTHS[t[i].partition(">")[2][:3].lower()], int(t[i + 1]), _clock(t[i + 2]), at)),
    (("<ACCESS>", "<SHIFTSHUT>"), _access),
    (("<ISO>",), lambda t, i, at: iso_us(t[i])),
    (("<ISOBOX>",), lambda t, i, at: iso_us(t[i][1:-1])),
    (("<DATE>", "<TIME>", "<SHIFT>"), lambda t, i, at: _date_time(t[i], t[i + 1], t[i + 2])),
    (("<DATE>", "<TIME>"), lambda t, i, at: _date_time(t[i], t[i + 1])),
    (("<DATE>", "<ZTIME>"), lambda t, i, at: _date_time(t[i], t[i + 1])),
    (("<DATEOPEN>", "<TIMESHUT>"), lambda t, i, at: _date_time(t[i][1:], t[i + 1][:-1])),
    (("<MON>", "<NUM>", "<TIME>"), lambda t, i, at: _latest(MONTHS[t[i].lower()], int(t[i + 1]), _clock(t[i + 2]), at)),
]



def _value(token: str) -> str:
    """The value of a key=value token, without its quotes."""
    v = token.partition("=")[2]
    return v[1:-1] if len(v) > 1 and v[0] == v[-1] == '"' else v


_bare = lambda name: re.sub(r":\d+$", "", name)  # noqa: E731 - without source line
_severity = lambda token: SYSLOG[int(token[1 : token.index(">")]) & 7]
_of_word = lambda token: LEVELS[token.strip("[]:").lower()]

#: What reads a level or a name from its token, by kind of slot.
LEVEL_OF = {
    "<LEVEL>": _of_word, "<LEVELCOLON>": _of_word, "<LEVELBOX>": _of_word,
    "<KEYLEVEL>": lambda x: LEVELS[_value(x).lower()],
    "<NAMELEVEL>": lambda x: LEVELS[x[1:-1].rpartition(":")[2].lower()],
    "<GLOG>": lambda x: LEVELS.get(x[0].lower()), "<PRI5>": _severity, "<PRI3>": _severity,
}
NAME_OF = {
    "<BRACKET>": lambda x: _bare(x[1:-1]), "<LEVELBOX>": lambda x: x[1:-1], "<PAREN>": lambda x: _bare(x[1:-1]),
    "<TAG>": lambda x: x.rstrip(":").partition("[")[0], "<KEYNAME>": _value,
    "<NAMELEVEL>": lambda x: x[1:-1].rpartition(":")[0], "<NAMELINE>": lambda x: x.rpartition(":")[0],
    "<PRI5>": lambda x: None if x == "-" else x, ANY: _bare,
}
_LEVEL_MASKS = ("<LEVEL>", "<LEVELCOLON>", "<LEVELBOX>")
_KEYS = ("<KEYTIME>", "<KEYLEVEL>", "<KEYNAME>", "<KEYTEXT>", "<PAIR>")


def _time_at(masks: list[str], i: int) -> int:
    return next((k for k, (head, _) in enumerate(TIMES) if tuple(masks[i : i + len(head)]) == head), -1)


def slots(masks: list[str]) -> tuple | None:
    """(time's kind, its position, level's kind and position, name's kind and position, tokens before the message, or -1 where it is whatever else there is).

    Whatever the layout: a header begins with a time, or with a level or a bracketed name right before one, and has a
    level or a name (a word, tag, bracket, parenthesis or key=value) in the tokens that follow; a web server's line
    (host, two names, bracketed time) needs neither. Null if it has none.
    """
    n = len(masks)
    mask = lambda i: masks[i] if i < n else ""
    word = lambda i: i < n and (masks[i] in (ANY, "<VAR>") or masks[i][0] != "<" and any(c.isalnum() for c in masks[i]))
    if "<KEYTIME>" in masks and masks[0] in _KEYS:
        at, level, name = (masks.index(m) if m in masks else -1 for m in ("<KEYTIME>", "<KEYLEVEL>", "<KEYNAME>"))
        return "<KEYTIME>", at, "<KEYLEVEL>" if level >= 0 else None, level, "<KEYNAME>" if name >= 0 else None, name, -1
    if masks[3:5] == ["<ACCESS>", "<SHIFTSHUT>"]:
        return _time_at(masks, 3), 3, None, -1, None, -1, 5
    level = name = None
    level_at = name_at = -1
    i = 0
    while (kind := _time_at(masks, i)) < 0:
        if level is None and mask(i) in ("<LEVEL>", "<LEVELBOX>"):
            level, level_at = mask(i), i
        elif name is None and mask(i) == "<BRACKET>":
            name, name_at = mask(i), i
        else:
            return None
        i += 1
    first, i = i, i + len(TIMES[kind][0])
    opening = mask(first)
    if opening == "<PRI5>":  # version, host, program, process, message's kind, structured data
        return (kind, first, opening, first, opening, first + 3, first + 7) if n >= first + 6 else None
    if opening in ("<PRI3>", "<GLOG>"):
        level, level_at = opening, first
    if opening == "<GLOG>":
        return (kind, first, level, level_at, "<NAMELINE>", i + 1, i + 2) if mask(i) == "<NUM>" and mask(i + 1) == "<NAMELINE>" else None
    if opening in ("<PRI3>", "<MON>"):  # host and tag
        if mask(i + 1) == "<TAG>":
            i += 1
        elif opening == "<PRI3>":
            return None
    lead = name_at  # a bracket before the level may be a thread
    while i < n:
        m = mask(i)
        if m == "<NAMELEVEL>" and level is None and name is None:
            level, level_at, name, name_at, i = m, i, m, i, i + 1
            i += 2 if mask(i) == "[pid" else 0
            break
        if m == "<KEYLEVEL>" and level is None:
            level, level_at = m, i
        elif m == "<KEYNAME>" and name is None:
            name, name_at = m, i
        elif m in _LEVEL_MASKS and level is None:
            level, level_at = m, i
            if m == "<LEVELCOLON>":
                i += 1
                break
        elif level is None and m in ("<NUM>", "-", "|"):
            pass  # process, thread or separator
        elif m in ("-", "|"):
            if m == "|" and name is None and word(i + 1) and mask(i + 2) in ("-", "|"):
                name, name_at, i = ANY, i + 1, i + 2
            i += 1
            break
        elif m in ("<BRACKET>", "<LEVELBOX>", "<PAREN>") and name is None:
            name, name_at = m, i
            lead = i if level is None else -1
        elif m == "<TAG>" and name is None:
            name, name_at, i = m, i, i + 1
            if level is None and mask(i) in (_LEVEL_MASKS if opening != "<MON>" else _LEVEL_MASKS[1:]):
                level, level_at, i = mask(i), i, i + 1
            break
        elif word(i) and level is not None and (name is None or name_at == lead) and mask(i + 1) == "-":
            name, name_at, i = ANY, i, i + 2
            break
        elif word(i) and level is None and name is None and (mask(i + 1) in _LEVEL_MASKS or mask(i + 1) in ("-", "|") and mask(i + 2) in _LEVEL_MASKS):
            name, name_at = ANY, i
        elif not (word(i) and level is None and name is None and mask(i + 1) == "<TAG>"):  # else a host
            break
        i += 1
        if level is not None and name is not None and not (name_at == lead and word(i) and mask(i + 1) == "-"):
            i += name_at != lead and mask(i) == "|" or level_at > name_at and mask(i) in ("-", "|")
            break
    return None if level is None and name is None else (kind, first, level, level_at, name, name_at, i)


def reader(found: tuple | None):
    """What takes the tokens of a line and its reading time and gives (ts_us, level, component, tokens before the message, positions read)."""
    if found is None:
        return None
    kind, first, level, level_at, name, name_at, used = found
    own = (first, level_at, name_at)
    time = (lambda t, i, at: iso_us(_value(t[i]))) if kind == "<KEYTIME>" else TIMES[kind][1]

    def fields(t, at):
        return time(t, first, at), LEVEL_OF[level](t[level_at]) if level else None, NAME_OF[name](t[name_at]) if name else None, used, own

    return fields


class Template:
    """Masks of the leading tokens; ``slots`` are always those of its masks as merged."""

    def __init__(self, masks: list[str], found: tuple | None):
        self.masks, self.count, self.slots, self.fields = masks, 0, found, reader(found)

    def likeness(self, masks: list[str]) -> float:
        return sum(a == b or a == ANY for a, b in zip(self.masks, masks)) / len(masks)

    def absorb(self, masks: list[str]) -> bool:
        """Merge if the merged masks have their fields where they are in both."""
        merged = [a if a == b else ANY for a, b in zip(self.masks, masks)]
        if slots(merged) != self.slots:
            return False
        self.masks = merged
        return True


#: Stands for a template where the leading tokens do not decide.
BEYOND = Template([], None)


class TemplateTree:
    """Token count -> first mask -> second mask -> templates; nodes and leaves are bounded."""

    def __init__(self):
        self.root: dict = {}
        self.masks: dict[str, str] = {}
        self.routed: dict[tuple, Template] = {}

    def _mask(self, token: str) -> str:
        known = self.masks
        m = known.get(token)
        if m is None:
            if len(known) > CACHED:
                known.clear()
            m = known[token] = masked(token)
        return m

    @staticmethod
    def _branch(node: dict, key, empty):
        """The child of a node; where it has too many, what is new goes to the branch for anything."""
        return node[key] if key in node else node.setdefault(key if len(node) < BRANCHES else ANY, empty())

    def route(self, tokens: list[str], count: int) -> Template:
        """The template of a line of ``count`` tokens."""
        masks = [self._mask(t) for t in tokens[:HEAD]]
        key = (count, *masks)
        found = self.routed.get(key)
        if found is None and count > HEAD and (masks[0] in _KEYS or (s := slots(masks)) and s[6] >= HEAD - 1):
            found = self.routed[key] = BEYOND
        if found is BEYOND:
            masks = [self._mask(t) for t in tokens]  # the header may go on
            key = (count, *masks)
            found = self.routed.get(key)
        if found is None:
            if len(self.routed) > CACHED:
                self.routed.clear()
            leaf = self._branch(self._branch(self._branch(self.root, count, dict), masks[0], dict), masks[1] if len(masks) > 1 else "", list)
            # merging moves no field, so entries do not depend on the order in which a task meets its lines
            own = slots(masks)
            found = max((x for x in leaf if x.slots == own and len(x.masks) == len(masks)), key=lambda x: x.likeness(masks), default=None)
            if found is None or found.likeness(masks) < SIMILAR or not found.absorb(masks):
                found = Template(masks, own)
                if len(leaf) < LEAF:
                    leaf.append(found)
            self.routed[key] = found
        found.count += 1
        return found

    def templates(self):
        for by_first in self.root.values():
            for by_second in by_first.values():
                for leaf in by_second.values():
                    yield from leaf


def _member(obj: dict, keys) -> str | None:
    for k, v in obj.items():
        if k.lower() in keys and isinstance(v, (str, int, float)):
            return str(v)
    return None


def json_fields(obj: dict) -> tuple:
    """(ts_us, level, component, message), each null where the object does not have it."""
    at, level = _member(obj, TIME_KEYS), _member(obj, LEVEL_KEYS)
    try:
        ts = iso_us(at) if at else None
    except ValueError:
        ts = None
    return ts, LEVELS.get(level.lower()) if level else None, _member(obj, NAME_KEYS), _member(obj, TEXT_KEYS)


_MEMBER_LINE = re.compile(r'\s+("(?:[^"\\]|\\.)*"\s*:\s*.*?),?\s*\Z', re.DOTALL)

ENTRY = "file long, first_line long, last_line long, ts_us long, level string, component string, program string, message string"
#: An entry that lies within its partition, or in ``aside`` a piece at one of the partition's ends.
PIECE = ENTRY + ", part int, place int, aside binary"
TYPES = [*[pa.int64()] * 4, *[pa.string()] * 4, pa.int32(), pa.int32(), pa.binary()]
NAMES = [x.split()[0] for x in PIECE.split(", ")]


class Entry:
    """An entry. While an object written over several lines is open (``pending``), its lines are members; such an entry is
    one only once it has a time, and until then its lines are kept (``lines``), as they may belong to the entry before."""

    __slots__ = ("file", "first", "last", "ts", "level", "name", "program", "texts", "pending", "lines")

    def __init__(self, file, line, program=None, ts=None, level=None, name=None, texts=(), pending=False, lines=()):
        self.file, self.first, self.last, self.program = file, line, line, program
        self.ts, self.level, self.name, self.texts, self.pending, self.lines = ts, level, name, list(texts), pending, list(lines)

    def take(self, ts, level, name, texts) -> None:
        """Members of the open object; the first of each kind counts."""
        self.ts, self.level, self.name = (a if a is not None else b for a, b in zip((self.ts, self.level, self.name), (ts, level, name)))
        self.texts += texts

    def follow(self, line: int, raw: str, keep: bool) -> None:
        self.last = line
        if self.pending:
            m = _MEMBER_LINE.match(raw)
            if m:
                try:
                    ts, level, name, text = json_fields(json.loads("{" + m[1] + "}"))
                except (ValueError, RecursionError):
                    ts = level = name = text = None
                self.take(ts, level, name, [text] if keep and text is not None else [])
                return
            self.pending = False
            if raw.strip() == "}":
                return
        if keep:
            self.texts.append(raw)

    def row(self, keep: bool) -> tuple:
        return self.file, self.first, self.last, self.ts, self.level, self.name, self.program, "\n".join(self.texts) if keep and self.texts else None


class Reader:
    """Lines in order to entries. An entry is given out when the next one begins.

    ``opening`` has the lines before the first entry in both readings: the rest of an open object, and plain lines.
    """

    def __init__(self, keep: bool):
        self.keep, self.held, self.trial, self.opening, self.done = keep, None, None, None, []

    def _give(self) -> None:
        if self.held is not None:
            self.done.append(self.held)
            self.held = None

    def _plain(self, file: int, line: int, raw: str) -> None:
        """A line of the entry held, else of the opening."""
        if self.held is not None:
            self.held.follow(line, raw, self.keep)
            return
        if self.opening is None:
            self.opening = Entry(file, line, pending=True), Entry(file, line)
        for reading in self.opening:
            reading.follow(line, raw, self.keep)

    def settle(self) -> None:
        """The object on trial has no time: its lines belong to the entry before."""
        t, self.trial = self.trial, None
        if t is not None:
            for i, raw in enumerate(t.lines):
                self._plain(t.file, t.first + i if t.first + i <= t.last else t.last, raw)
            if self.held is not None:
                self.held.last = max(self.held.last, t.last)
            elif self.opening is not None:
                for reading in self.opening:
                    reading.last = max(reading.last, t.last)

    def add(self, file: int, line: int, raw: str, head: tuple | None, program: str | None) -> None:
        t = self.trial
        if head is None and t is not None:
            t.lines.append(raw)
            t.follow(line, raw, self.keep)
            if t.ts is not None:
                self._give()
                self.held, self.trial, t.lines = t, None, []
            elif not t.pending:
                self.settle()
            return
        if head is None:
            self._plain(file, line, raw)
            return
        self.settle()
        ts, level, name, text, pending = head
        entry = Entry(file, line, program, ts, level, name, [] if text is None or not self.keep else [text], pending, [raw] if ts is None else [])
        if ts is None:
            self.trial = entry
        else:
            self._give()
            self.held = entry

    def finish(self) -> list[Entry]:
        self._give()
        return self.done


def parse_head(tree: TemplateTree, raw: str, read_us: int | None):
    """(ts_us, level, component, message, pending) if the line begins an entry, else null."""
    if not raw or raw[0].isspace():
        return None
    if raw[0] == "{":
        if raw.rstrip() == "{":
            return None, None, None, None, True
        try:
            obj = json.loads(raw)
        except (ValueError, RecursionError):
            return None
        if not isinstance(obj, dict):
            return None
        ts, level, name, text = json_fields(obj)
        return None if ts is None else (ts, level, name, text, False)
    tokens = tokens_of(raw)
    fields = tree.route(tokens, len(tokens)).fields
    if fields is None:
        return None
    try:
        ts, level, name, used, own = fields(tokens, read_us)
    except (ValueError, IndexError, KeyError, OverflowError):
        return None
    if used < 0:  # key=value pairs: all others are the message
        return ts, level, name, " ".join(x for i, x in enumerate(tokens) if i not in own), False
    rest = raw.split(None, used)
    return ts, level, name, rest[used] if len(rest) > used else "", False


def _run(keep: bool):
    def run(batches):
        part, tree, reader, now, rows, place = TaskContext.get().partitionId(), TemplateTree(), Reader(keep), None, [], 0

        def put(e, kind, closes, opened=None):
            nonlocal place
            rows.append((e.file, *[None] * 7, part, place, pickle.dumps((kind, closes, e, opened))))
            place += 1

        def give(last: bool):
            """All entries that are complete; at the end of the partition the last ones stay open."""
            if reader.opening is not None and (reader.done or reader.held is not None or last):
                opened, plain = reader.opening
                reader.opening = None
                put(plain, "opening", last and reader.held is None and not reader.done and reader.trial is None, opened)
            for e in reader.done:
                rows.append((*e.row(keep), part, None, None))
            reader.done.clear()
            if last:
                if reader.held is not None:
                    put(reader.held, "entry", True)
                if reader.trial is not None:
                    put(reader.trial, "trial", True)

        def end_file():
            """The file ends within the partition."""
            reader.settle()
            reader.finish()
            give(False)
            if reader.opening is not None:
                opened, plain = reader.opening
                reader.opening = None
                put(plain, "opening", False, opened)

        def flush():
            cols = list(zip(*rows)) or [()] * len(NAMES)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, TYPES)], names=NAMES)

        for b in batches:
            read = b.column("read_at").cast(pa.int64()).to_pylist()
            for file, line, raw, program, at in zip(*[b.column(c).to_pylist() for c in ("file", "line", "raw", "program")], read):
                if now is not None and now != file:
                    end_file()
                    reader = Reader(keep)
                now = file
                reader.add(file, line, raw or "", parse_head(tree, raw, at) if raw is not None else None, program)
            give(False)
            if len(rows) >= 5000:
                yield flush()
        if now is not None:
            give(True)
        yield flush()

    return run


_ENTRY_TYPES = TYPES[:8]


def join_pieces(pieces: list[tuple], keep: bool) -> list[tuple]:
    """The entries of a file from the pieces (kind, whether it ends its partition, entry, entry's other reading) at the
    ends of its partitions, in order: at most four a partition."""
    out, held, trial = [], None, None

    def give():
        nonlocal held
        if held is not None:
            out.append(held.row(keep))
        held = None

    def settle():
        """The object on trial has no time: its lines belong to the entry before."""
        nonlocal trial
        if trial is not None and held is not None:
            for raw in trial.lines:
                held.follow(held.last, raw, keep)
            held.last = trial.last
        trial = None

    for kind, closes, e, opened in pieces:
        if kind == "opening":
            if trial is not None:  # the first reading holds as long as the object is open
                trial.take(opened.ts, opened.level, opened.name, opened.texts)
                trial.pending, trial.last = opened.pending, e.last
                trial.lines += e.texts
                if trial.ts is not None:
                    give()
                    held, trial = trial, None
                elif not trial.pending:
                    settle()
            elif held is not None:
                if held.pending:
                    held.take(opened.ts, opened.level, opened.name, opened.texts)
                    held.pending = opened.pending
                else:
                    held.texts += e.texts
                held.last = e.last
            if not closes:
                settle()
        else:
            settle()
            if kind == "trial":
                trial = e
            else:
                give()
                held = e
    settle()
    give()
    return out


def _once(lines: DataFrame, file: str, line: str, read_at: str, raw: str, fields: str | None) -> DataFrame:
    program = F.element_at(F.col(fields), F.lit("program")) if fields else F.lit(None).cast("string")
    v = F.struct(F.col(read_at).alias("read_at"), F.col(raw).alias("raw"), program.alias("program"))
    return lines.groupBy(F.col(file).cast("long").alias("file"), F.col(line).cast("long").alias("line")).agg(F.min(v).alias("v")).select("file", "line", "v.*")


def parse_entries(lines: DataFrame, file: str, line: str, read_at: str, raw: str, fields: str | None = None, message: bool = True, parts: int | None = None) -> DataFrame:
    """(file, first_line, last_line, ts_us, level, component, message): one row an entry.

    Lines that begin no entry belong to the entry before; lines before a file's first entry belong to none and are
    left out. Rows sent twice count once (the least row), order of rows does not matter, null lines continue an
    entry. Where the header names no component, ``fields['program']`` of the first line does. Times without an
    offset are UTC; a missing year is the latest that does not put the entry after ``read_at`` of its first line.
    ``message`` false leaves the messages null and does not gather them.
    """
    once = _once(lines, file, line, read_at, raw, fields)
    pieces = materialise(chunked(once, ["file"], ["line"], parts).mapInArrow(_run(message), PIECE), "log-pieces")
    whole = pieces.where("aside IS NULL").select("file", "first_line", "last_line", "ts_us", "level", "component", "program", "message")

    def join(table: pa.Table) -> pa.Table:
        rows = join_pieces([pickle.loads(x) for x in table.sort_by([("part", "ascending"), ("place", "ascending")])["aside"].to_pylist()], message)
        cols = list(zip(*rows)) or [()] * len(_ENTRY_TYPES)
        return pa.table([pa.array(c, t) for c, t in zip(cols, _ENTRY_TYPES)], names=[x.split()[0] for x in ENTRY.split(", ")])

    # a file that a border cuts: its pieces there are at most four a partition
    entries = whole.unionByName(pieces.where("aside IS NOT NULL").groupBy("file").applyInArrow(join, ENTRY))
    return entries.select(F.col("file").alias(file), "first_line", "last_line", "ts_us", "level", F.coalesce("component", "program").alias("component"), "message")


def line_templates(lines: DataFrame, raw: str) -> DataFrame:
    """(template, lines): the templates of all lines; each task builds its tree, equal templates are summed."""

    def run(batches):
        tree = TemplateTree()
        for b in batches:
            for text in b.column("raw").to_pylist():
                if text is not None and (tokens := text.split(None, HEAD)):
                    tree.route(tokens, len(text.split()))
        found = [(" ".join(t.masks), t.count) for t in tree.templates()]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int64())], names=["template", "lines"])

    return lines.select(F.col(raw).alias("raw")).mapInArrow(run, "template string, lines long").groupBy("template").agg(F.sum("lines").alias("lines"))

"""Differences between snapshots of processes, files, packages and connections; parsers of captured listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def diff_snapshots(before: DataFrame, after: DataFrame, keys: list[str], content: list[str], soft: list[str] = ()) -> DataFrame:
    """(keys, change): added, deleted, modified (``content`` differs, null-safe) or attribute_change (only ``soft`` differs).

    One full outer join on the keys; null keys never pair. Unchanged keys are left out. Repeated keys pair as in any join.
    """
    a = before.select(*keys, *[F.col(c).alias(f"b_{c}") for c in [*content, *soft]], F.lit(True).alias("in_b"))
    b = after.select(*keys, *[F.col(c).alias(f"a_{c}") for c in [*content, *soft]], F.lit(True).alias("in_a"))
    both = a.join(b, keys, "full_outer")
    differs = lambda cols: F.greatest(*[(~F.col(f"b_{c}").eqNullSafe(F.col(f"a_{c}"))).cast("int") for c in cols], F.lit(0), F.lit(0)) == 1
    change = F.when(F.col("in_b").isNull(), "added").when(F.col("in_a").isNull(), "deleted").when(differs(content), "modified")
    if soft:
        change = change.when(differs(soft), "attribute_change")
    return both.select(*keys, change.alias("change")).where(F.col("change").isNotNull())


def appeared_and_gone(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change): started or stopped, by an anti-join each way; nulls are equal to nothing."""
    new = after.select(*keys).distinct().join(before.select(*keys).distinct(), keys, "left_anti").withColumn("change", F.lit("started"))
    gone = before.select(*keys).distinct().join(after.select(*keys).distinct(), keys, "left_anti").withColumn("change", F.lit("stopped"))
    return new.unionByName(gone)


CONNECTION = ["local_ip", "local_port", "remote_ip", "remote_port", "protocol"]


def diff_connections(before: DataFrame, after: DataFrame, extra: list[str] = ()) -> DataFrame:
    """(connection, change): connect and listen for new ones, disconnect for those gone; a connection without a remote end
    neither connects nor disconnects. Nulls are equal here; ``extra`` columns (a host) belong to the key. ``after`` has ``state``."""
    keys = [*extra, *CONNECTION]
    remote = F.coalesce((F.col("remote_ip") != "") & (F.col("remote_ip") != "*"), F.lit(False))
    held = lambda df: df.groupBy(*keys).agg(F.bool_or(F.coalesce(F.col("state").isin("LISTEN", "LISTENING"), F.lit(False))).alias("listens")) if "state" in df.columns else df.select(*keys).distinct().withColumn("listens", F.lit(False))
    was, now = held(before), held(after)
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    new, gone = now.join(was, same(now, was), "left_anti"), was.join(now, same(was, now), "left_anti")
    kinds = F.array_compact(F.array(F.when(remote, F.lit("connect")), F.when(F.col("listens"), F.lit("listen"))))
    return new.select(*keys, F.explode(kinds).alias("change")).unionByName(gone.where(remote).select(*keys, F.lit("disconnect").alias("change")))


def parse_processes(lines: DataFrame, line: str) -> DataFrame:
    """(pid, user, name, cmdline) of ``ps aux`` listings; the head line and shorter lines are left out."""
    m = r"^(\S+)\s+(\d+)\s+(?:\S+\s+){8}(.+)$"
    g = lambda i: F.regexp_extract(line, m, i)
    first = F.regexp_extract(g(3), r"^(\S+)", 1)
    return lines.where(F.col(line).rlike(m)).select(g(2).cast("long").alias("pid"), g(1).alias("user"), F.element_at(F.split(first, "/"), -1).alias("name"), g(3).alias("cmdline"))


def parse_proc_status(files: DataFrame, content: str) -> DataFrame:
    """(pid, ppid, name) of the text of status files."""
    g = lambda k: F.regexp_extract(content, rf"(?m)^{k}:\s*(.*)$", 1)
    return files.where(F.col(content).rlike(r"(?m)^Pid:")).select(g("Pid").try_cast("long").alias("pid"), g("PPid").try_cast("long").alias("ppid"), g("Name").alias("name"))


def change_severity(change: Column) -> Column:
    return F.when(change.isin("modified", "deleted"), 5).otherwise(3)


def excluded_path(path: Column, parts: list[str]) -> Column:
    """Paths that contain any of ``parts`` in any letter case, and database files."""
    low, cond = F.lower(path), F.lower(path).rlike(r"\.db(-wal|-shm)?$")
    for p in parts:
        cond = cond | F.contains(low, F.lit(p.lower()))
    return F.coalesce(cond, F.lit(False))


def parse_memory_maps(lines: DataFrame, line: str, max_bytes: int = 10 << 20) -> DataFrame:
    """Readable, non-shared regions of at most ``max_bytes`` from lines of a process's memory map."""
    m = r"^([0-9a-f]+)-([0-9a-f]+) (\S{4}) (\S+) (\S+) (\d+)\s*(.*)$"
    g = lambda i: F.regexp_extract(line, m, i)
    out = lines.where(F.col(line).rlike(m)).withColumns({"start": F.conv(g(1), 16, 10).cast("decimal(20,0)"), "end": F.conv(g(2), 16, 10).cast("decimal(20,0)"), "perms": g(3), "path": g(7)})
    return out.where(F.col("perms").startswith("r") & ~F.col("perms").endswith("s") & ((F.col("end") - F.col("start")) <= max_bytes))


def parse_connections(lines: DataFrame, line: str) -> DataFrame:
    """(protocol, local_ip, local_port, remote_ip, remote_port, state) from socket listings; other lines are left out."""
    m = r"^(tcp6?|udp6?)\s+(?:\S+\s+){0,3}?(\S+):(\d+|\*)\s+(\S+):(\d+|\*)(?:\s+([A-Z_0-9]+))?"
    g = lambda i: F.regexp_extract(line, m, i)
    port = lambda i: F.coalesce(g(i).try_cast("int"), F.lit(0))
    return lines.where(F.col(line).rlike(m)).select(g(1).alias("protocol"), g(2).alias("local_ip"), port(3).alias("local_port"), g(4).alias("remote_ip"), port(5).alias("remote_port"), g(6).alias("state"))


def parse_packages(lines: DataFrame, line: str) -> DataFrame:
    """(name, version) from package listings: ``ii name[:arch] version ...``, ``name version``, ``name-version-release.arch``
    or an object with DisplayName and DisplayVersion a line."""
    text = F.trim(line)
    parts = F.split(text, r"\s+")
    listed, is_json = F.get(parts, F.lit(0)).isin("ii", "hi"), F.substring(text, 1, 1) == "{"
    one = F.size(parts) == 1
    whole = r"^(.+)-([^-]+-[^-]+?)(?:\.(?:x86_64|noarch|i[3-6]86|aarch64))?$"
    name = F.when(is_json, F.get_json_object(text, "$.DisplayName")).when(listed, F.get(parts, F.lit(1))).when(one, F.regexp_extract(text, whole, 1)).otherwise(F.get(parts, F.lit(0)))
    version = F.when(is_json, F.get_json_object(text, "$.DisplayVersion")).when(listed, F.get(parts, F.lit(2))).when(one, F.nullif(F.regexp_extract(text, whole, 2), F.lit(""))).otherwise(F.get(parts, F.lit(1)))
    return lines.select(F.when(is_json, name).otherwise(F.split(name, ":")[0]).alias("name"), version.alias("version")).where("name <> '' AND version IS NOT NULL")

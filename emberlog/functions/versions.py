"""Version comparison and package patterns as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def version_parts(v: Column) -> Column:
    """Numbers of a version up to the first part that does not begin with a digit; null if there is none.

    A leading v is dropped and what follows the first ``-``, ``~`` or ``+`` (not at the start) is cut.
    """
    core = F.regexp_replace(F.regexp_replace(v, "^[vV]+", ""), r"(?s)^(.[^-~+]*)[-~+].*$", "$1")
    numbers = F.transform(F.split(core, r"\."), lambda p: F.when(p.rlike(r"^\d"), F.regexp_extract(p, r"^(\d+)", 1)).try_cast("long"))
    bad = F.array_position(F.transform(numbers, lambda n: n.isNull().cast("int")), 1)
    parts = F.when(bad == 0, numbers).otherwise(F.slice(numbers, 1, F.greatest(bad - 1, F.lit(0)).cast("int")))
    return F.when(F.size(parts) > 0, parts)


def version_order(a: Column, b: Column) -> Column:
    """-1, 0 or 1; null where either cannot be read. Shorter is smaller, then a pre-release is smaller than a release."""
    x, y = version_parts(a), version_parts(b)
    pre = lambda v: v.rlike("[-~+]").cast("int")
    by_parts = F.when(x < y, -1).when(x > y, 1).otherwise(F.signum(pre(b) - pre(a)).cast("int"))
    return F.when(x.isNotNull() & y.isNotNull(), by_parts)


def version_matches(installed: Column, op: Column, fixed: Column) -> Column:
    c = version_order(installed, fixed)
    hit = F.when(op == "<", c < 0).when(op == "<=", c <= 0).when(op == "=", c == 0).when(op == ">=", c >= 0).when(op == ">", c > 0)
    return F.coalesce(hit, F.lit(False))


def package_matches(name: Column, pattern: Column) -> Column:
    """``*`` or empty: any; exact; ``prefix*``; else contained."""
    star = pattern.endswith("*")
    return F.coalesce((pattern == "*") | (pattern == "") | (name == pattern) | F.when(star, name.startswith(F.regexp_replace(pattern, r"\*$", ""))).otherwise(F.contains(name, pattern)), F.lit(False))

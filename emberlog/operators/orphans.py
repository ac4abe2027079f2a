"""References to records that do not exist.

Composite keys with partial nulls: child rows are grouped by the null mask of their key columns (the masks are
2^columns, not data), and each mask is anti-joined on its non-null columns as the declared match semantics say:

* ``simple``  - a key with any null refers to nothing and is never dangling;
* ``full``    - a key must be wholly null or wholly given; a partly null key dangles;
* ``partial`` - a partly null key must agree with some parent in its non-null columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.keys import folded
from emberlog.operators.skew import join_lookup

MATCHES = ("simple", "full", "partial")
MASK, REASON = "null_mask", "orphan_reason"


def find_orphans(
    child: DataFrame,
    parent: DataFrame,
    on: Sequence[tuple[Column, Column]],
    match: str = "simple",
    deleted: DataFrame | None = None,
    deleted_on: Sequence[Column] = (),
    child_time: Column | None = None,
    parent_time: Column | None = None,
    hot_rows: int = 100_000,
) -> DataFrame:
    """Rows of ``child`` whose reference dangles, with ``null_mask`` (bit i: column i of the key is null) and ``orphan_reason``.

    ``on`` pairs child and parent key expressions; ``deleted`` lists keys that count as gone even if their row is
    still there; with both times, a parent created strictly after the child does not satisfy it (if either time is
    null, "later" does not hold). Parents may repeat: any copy that satisfies the child is enough.

    Nulls: decided by ``match``. Empty child: empty result. Empty parent: every non-null reference dangles. Repeated
    child rows all come out. Columns of child and parent may have equal names; the result has only the child's.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    timed = child_time is not None and parent_time is not None
    ks = [f"__k{i}" for i in range(len(on))]
    gone = [f"__d{i}" for i in range(len(on))]
    c = child.withColumns({k: e for k, (e, _) in zip(ks, on)} | {"__at": child_time if timed else F.lit(None).cast("timestamp_ntz")})
    c = c.withColumn(MASK, reduce(lambda a, b: a + b, (F.col(k).isNull().cast("int") * (1 << i) for i, k in enumerate(ks))))
    since = F.coalesce(parent_time, F.lit("0001-01-01").cast("timestamp_ntz")) if timed else F.lit("0001-01-01").cast("timestamp_ntz")
    p = parent.select(*[e.alias(k) for k, (_, e) in zip(ks, on)], since.alias("__since"))
    if deleted is not None:
        d = deleted.select(*[e.alias(g) for g, e in zip(gone, deleted_on)]).distinct()
        p = p.join(d, reduce(lambda a, b: a & b, (p[k] == d[g] for k, g in zip(ks, gone))), "left_anti")

    parts, whole = [], (1 << len(on)) - 1
    for mask in range(whole + 1):
        rows = c.where(F.col(MASK) == mask)
        given = [k for i, k in enumerate(ks) if not mask >> i & 1]
        if mask == whole or (mask and match == "simple"):
            continue
        if mask and match == "full":
            parts.append(rows.withColumn(REASON, F.lit("partial_key")))
            continue
        key = one_key(given)
        lookup = p.where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in given))).groupBy(key.alias("__key1")).agg(F.min("__since").alias("__since"))
        parts.append(
            join_lookup(
                rows.withColumn("__key1", key), lookup, "__key1", "left_anti",
                lambda a, b: a["__at"].isNull() | (b["__since"] <= a["__at"]), hot_rows,
            ).drop("__key1").withColumn(REASON, F.lit("no_valid_parent"))
        )
    if not parts:
        return c.where(F.lit(False)).withColumn(REASON, F.lit("")).drop(*ks, "__at")
    return reduce(DataFrame.unionByName, parts).drop(*ks, "__at")


def one_key(columns: Sequence[str]) -> Column:
    """The columns as one text, each but the last with its length before it, so that no two keys are alike."""
    texts = [F.col(c).cast("string") for c in columns]
    return F.concat(*[x for t in texts[:-1] for x in (F.length(t).cast("string"), F.lit(":"), t)], texts[-1])


def orphans_per_period(found: DataFrame, table_name: Column | str, record: str, at: Column, unit: str = "month") -> DataFrame:
    """Dangling records counted per table and period, repeated rows of a record once (rows without a key each by itself);
    those without a time are counted under a null period."""
    name = F.lit(table_name) if isinstance(table_name, str) else table_name
    orphans = F.count_distinct(record) + F.count_if(F.col(record).isNull())
    return found.groupBy(name.alias("child_table"), F.date_trunc(unit, at.cast("timestamp_ntz")).cast("date").alias("period")).agg(orphans.alias("orphans"))


def by_key(child_col: str, parent_col: str) -> list[tuple[Column, Column]]:
    """A single-column reference compared without regard to letter case and outer blanks; blank is null."""
    return [(folded(child_col), folded(parent_col))]

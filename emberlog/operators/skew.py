"""Joins that survive keys holding a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

#: A key is hot if it has more rows than so large a part of a shuffle partition's fair share.
SHARE = 4


def hot_keys(df: DataFrame, key: str, min_rows: int = 100_000) -> list:
    """The values of ``key``, null among them, with at least ``min_rows`` rows and a quarter of a partition's share of all rows, most frequent first.

    Their number needs no cap: there are at most four a shuffle partition. Counts are combined before the shuffle, so
    a hot key costs one row a task.
    """
    most = SHARE * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen = Observation()
    counts = df.groupBy(key).count().observe(seen, F.coalesce(F.sum("count"), F.lit(0)).alias("rows"))
    top = counts.where(F.col("count") >= min_rows).orderBy(F.desc("count"), key).limit(most).collect()
    if not top:
        return []
    total = seen.get["rows"]
    return [r[0] for r in top if r["count"] * most >= total]


def join_lookup(left: DataFrame, lookup: DataFrame, key: str, how: str, cond=None, min_rows: int = 100_000) -> DataFrame:
    """Join ``left`` with ``lookup`` (at most one row a key) on ``key``; ``how`` is left, left_anti, left_semi or inner.

    Rows of hot keys meet a broadcast of those keys' lookup rows (at most four a shuffle partition), the others are
    shuffled. ``cond(left, lookup)`` may add a condition.
    """

    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.withColumnRenamed(key, "__key")
        on = a[key] == b["__key"]
        return a.join(b, on if cond is None else on & cond(a, b), how).drop("__key")

    hot = hot_keys(left, key, min_rows)
    if not hot:
        return joined(left, lookup)
    is_hot = F.coalesce(F.col(key).isin([k for k in hot if k is not None]), F.lit(False))
    if None not in hot:
        return joined(left.where(~is_hot), lookup).unionByName(joined(left.where(is_hot), F.broadcast(lookup.where(is_hot))))
    # null meets nothing and needs no shuffle: it goes with the hot ones
    with_null = is_hot | F.col(key).isNull()
    return joined(left.where(~with_null), lookup).unionByName(joined(left.where(with_null), F.broadcast(lookup.where(is_hot))))

"""Filling fixed-capacity containers with items of varying length.

Minimum bin slack on the histogram of lengths: the longest remaining length opens a container, and a bitset
subset-sum over the remaining lengths (longest first, each as often as it is left, in binary multiples) finds the
multiset that comes closest to the space left, stopping at an exact fill; backtracking gives how often each length
is used. The same multiset is then used as often as the counts allow, so the plan's size depends on the capacity
(at most that many lengths), not on the number of items, and is all that reaches the driver. Items get their place
by their rank among the items of equal length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.session import materialise


def plan_containers(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(how many containers, [(length, items of it in each)])] using every item once; lengths lie in 1..capacity."""
    left = {n: c for n, c in counts.items() if c}
    order = sorted(left, reverse=True)
    plan = []
    while order:
        top = order[0]
        space = capacity - top
        bits, stages, mask = 1, [], (1 << space + 1) - 1
        for n in order:
            if bits >> space & 1:
                break
            if n > space:
                continue
            have, many = min(left[n] - (n == top), space // n), 1
            while have > 0:
                use = min(many, have)
                stages.append((bits, n, use))
                bits |= bits << n * use & mask  # sums beyond the space never come back
                have, many = have - use, many * 2
        t, used = bits.bit_length() - 1, {top: 1}
        for was, n, use in reversed(stages):
            if not was >> t & 1:
                t -= n * use
                used[n] = used.get(n, 0) + use
        times = min(left[n] // k for n, k in used.items())
        plan.append((times, sorted(used.items(), reverse=True)))
        for n, k in used.items():
            left[n] -= k * times
        order = [n for n in order if left[n]]
    return plan


def _place(base_of: np.ndarray, starts: np.ndarray, bins: np.ndarray, each: np.ndarray):
    def run(batches):
        for b in batches:
            at = base_of[b.column("n_tokens").to_numpy()] + b.column("rank").to_numpy()
            seg = np.searchsorted(starts, at, "right") - 1
            out = bins[seg] + (at - starts[seg]) // each[seg]
            keep = [c for c in b.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([pa.array(out), *[b.column(c) for c in keep]], names=["bin_no", *keep])

    return run


def pack_items(items: DataFrame, key: str, size: str, capacity: int, rows_a_rank_group: int = 50_000) -> DataFrame:
    """(bin_no, key, piece_no, item_from, n_tokens): every unit of every item in exactly one container of ``capacity``.

    Items longer than ``capacity`` are split into full containers and one rest, others never. ``bin_no`` counts from
    0. Items of size null or 0 have nothing to place and come out once with bin_no null and n_tokens 0. Items may
    repeat: each row is an item. No items: no rows. ``items`` is read twice and should be materialised.
    """
    spark = items.sparkSession
    sized = items.select(F.col(key).alias("item"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("n"))
    full, rest = F.floor(F.col("n") / capacity).cast("int"), F.col("n") % capacity
    last = full + F.when(rest > 0, 1).otherwise(0)
    pieces = sized.where("n > 0").select("item", "n", F.explode(F.sequence(F.lit(0), last - 1)).alias("piece_no"))
    pieces = pieces.select("item", "piece_no", (F.col("piece_no").cast("long") * capacity).alias("item_from"), F.least(F.lit(capacity), F.col("n") - F.col("piece_no").cast("long") * capacity).alias("n_tokens"))

    hist = {r["n_tokens"]: r["c"] for r in pieces.groupBy("n_tokens").agg(F.count("*").alias("c")).collect()}  # at most ``capacity`` rows
    base_of, total = np.zeros(capacity + 1, np.int64), 0
    for n in sorted(hist):
        base_of[n], total = total, total + hist[n]
    taken, segs, bin_no = dict.fromkeys(hist, 0), [], 0
    for times, used in plan_containers(hist, capacity):
        for n, k in used:
            segs.append((base_of[n] + taken[n], bin_no, k))
            taken[n] += k * times
        bin_no += times
    segs.sort()
    starts, bins, each = (np.array([s[i] for s in segs], np.int64) for i in range(3))

    # rank among equal lengths: salted groups of bounded size, each with the number of items in the groups before it
    groups = max(16, -(-total // rows_a_rank_group))
    salted = pieces.withColumn("g", F.pmod(F.xxhash64("item", "piece_no"), F.lit(groups)).cast("int"))
    before = salted.groupBy("n_tokens", "g").agg(F.count("*").alias("c"))
    before = before.select("n_tokens", "g", (F.sum("c").over(Window.partitionBy("n_tokens").orderBy("g")) - F.col("c")).alias("before"))
    own = F.row_number().over(Window.partitionBy("n_tokens", "g").orderBy("item", "piece_no")) - 1
    ranked = salted.withColumn("own", own).join(before, ["n_tokens", "g"]).select("item", "piece_no", "item_from", "n_tokens", (F.col("before") + F.col("own")).cast("long").alias("rank"))
    schema = f"bin_no long, item {dict(sized.dtypes)['item']}, piece_no int, item_from long, n_tokens long"
    placed = ranked.mapInArrow(_place(base_of, starts, bins, each), schema)
    none = sized.where("n <= 0").select(F.lit(None).cast("long").alias("bin_no"), "item", F.lit(0).alias("piece_no"), F.lit(0).cast("long").alias("item_from"), F.lit(0).cast("long").alias("n_tokens"))
    return placed.unionByName(none).withColumnRenamed("item", key)


def pack_documents(sizes: DataFrame, key: str, size: str, capacities: list[tuple[int, int]]) -> DataFrame:
    """``pack_items`` for each (container_id, capacity) by itself, with both columns in front."""
    sizes = materialise(sizes.select(key, size), "sizes")
    out = None
    for container, capacity in capacities:
        one = pack_items(sizes, key, size, capacity).select(F.lit(container).alias("container_id"), F.lit(capacity).alias("capacity_tokens"), "*")
        out = one if out is None else out.unionByName(one)
    return out

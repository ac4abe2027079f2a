"""Ordered sequences cut into contiguous chunks, so that one long sequence spreads over many tasks."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.session import materialise


def chunked(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int | None = None) -> DataFrame:
    """``df`` range-partitioned and sorted by ``keys`` then ``order``: partition ids follow that order.

    Rows equal in all of these stay together. A key with a third of all rows fills about a third of the partitions.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)


def stitch_borders(pieces: DataFrame, keys: Sequence[str], joins: Column, part: str, is_first: str, is_last: str, at: str, aggs: Sequence[Column]) -> DataFrame:
    """Merge pieces of one sequence that were cut at partition borders.

    ``pieces`` has only those that open (``is_first``) or close (``is_last``) a partition: two a partition at most.
    A piece continues the one before it if that closes an earlier partition, this opens its own, and ``joins``
    holds (it may use columns of the piece before with the prefix ``prev_``).
    """
    w = Window.partitionBy(*keys).orderBy(part, at)
    before = [c for c in pieces.columns if c not in keys]
    lagged = pieces.withColumns({f"prev_{c}": F.lag(c).over(w) for c in before})
    goes_on = F.coalesce((F.col(f"prev_{part}") < F.col(part)) & F.col(f"prev_{is_last}") & F.col(is_first) & joins, F.lit(False))
    numbered = lagged.withColumn("goes_on", goes_on).withColumn("group_no", F.sum((~F.col("goes_on")).cast("long")).over(w))
    return numbered.groupBy(*keys, "group_no").agg(*aggs).drop("group_no")


def numbered(df: DataFrame, key: str, order: Sequence[str], name: str = "row_no", parts: int | None = None) -> DataFrame:
    """``df`` with the row's number, from 1, within its ``key`` in ``order`` (which should be total).

    A window would put a key into one task. Here partitions are numbered by themselves, and one row a partition, what
    its first key has in the partitions before it, is broadcast. Null is a key of its own.
    """
    keyed = df.withColumn("__k", F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")))
    placed = chunked(keyed, ["__k"], order, parts)

    def count(batches):
        part, last, n = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            k = b.column("__k")
            new = np.concatenate([[k[0].as_py() != last], pc.not_equal(k[1:], k[:-1]).to_numpy(zero_copy_only=False)])
            at = np.arange(b.num_rows)
            begin = np.maximum.accumulate(np.where(new, at, -1))
            local = np.where(begin >= 0, at - begin + 1, at + n + 1)
            last, n = k[b.num_rows - 1].as_py(), int(local[-1])
            yield b.append_column("__part", pa.array(np.full(b.num_rows, part, np.int32))).append_column("__n", pa.array(local.astype(np.int64)))

    schema = T.StructType([*placed.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("__n", T.LongType())])
    held = materialise(placed.mapInArrow(count, schema), "numbered")
    ends = held.groupBy("__part").agg(F.min("__k").alias("a"), F.max("__k").alias("z"), F.max_by("__n", F.struct("__k", "__n")).alias("n"))
    offsets, key_now, total = [], None, 0
    for r in sorted(ends.collect(), key=lambda r: r["__part"]):  # one row a partition
        offsets.append((r["__part"], r["a"], total if r["a"] == key_now else 0))
        total = (total if r["a"] == key_now and r["a"] == r["z"] else 0) + r["n"]
        key_now = r["z"]
    before = df.sparkSession.createDataFrame(offsets, "__part int, __k string, __before long")
    out = held.join(F.broadcast(before), ["__part", "__k"], "left").withColumn(name, F.col("__n") + F.coalesce("__before", F.lit(0)))
    return out.drop("__part", "__k", "__n", "__before")


def with_halo(df: DataFrame, number: str, rows: int, cell_rows: int = 100_000) -> DataFrame:
    """Cells of ``cell_rows`` consecutive rows a key; the last ``rows`` of a cell are repeated in the next, with ``own`` false."""
    cell = F.floor((F.col(number) - 1) / cell_rows)
    tail = F.pmod(F.col(number) - 1, F.lit(cell_rows)) >= cell_rows - rows
    return df.withColumn("cell", F.explode(F.when(tail, F.array(cell, cell + 1)).otherwise(F.array(cell)))).withColumn("own", F.col("cell") == cell)


def time_cells(df: DataFrame, us: str, span_us: int, spans: int = 64) -> DataFrame:
    """Cells of ``spans`` windows of time; the last window of a cell is repeated in the next, with ``own`` false.

    Whatever looks back at most ``span_us`` gets all it needs within its cell, so a key is not bound to one task.
    """
    size = span_us * spans
    cell = F.floor(F.col(us) / size)
    tail = F.pmod(F.col(us), F.lit(size)) >= size - span_us
    return df.withColumn("cell", F.explode(F.when(tail, F.array(cell, cell + 1)).otherwise(F.array(cell)))).withColumn("own", F.col("cell") == cell)


def scan_in_order(df: DataFrame, key: str, order: Sequence[str], step: Callable, schema: T.StructType, parts: int | None = None) -> DataFrame:
    """``df`` gone through in ``order`` within each ``key`` (text, not null) by a machine with a small state.

    ``step(state, rows)`` takes an Arrow table of consecutive rows of one key and the state before them (None at the
    key's beginning), and gives (state after them, Arrow table of results). A key is not bound to one task: range
    partitions are run from nothing, and those whose incoming state turns out to be another are run again until no state
    changes - at once where the state forgets its beginning within a partition.
    """
    placed = chunked(df.withColumn("__at", F.struct(*order)), [key], ["__at"], parts).drop("__at")

    def number(batches):
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            yield b.append_column("__part", pa.array(np.full(b.num_rows, part, np.int32))).append_column("__no", pa.array(np.arange(n, n + b.num_rows)))
            n += b.num_rows

    held = materialise(placed.mapInArrow(number, T.StructType([*placed.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("__no", T.LongType())])), "scanned")
    incoming: dict[int, object] = {}

    def walk(table: pa.Table):
        """(part, first key, last key, state at the end, results)"""
        t, part = table.sort_by("__no"), table["__part"][0].as_py()
        keys = t[key].combine_chunks()
        cuts = [0, *((pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False).nonzero()[0] + 1).tolist()), len(keys)]
        state, out = incoming.get(part), []
        for a, b in zip(cuts, cuts[1:]):
            state, rows = step(state if a == 0 else None, t.slice(a, b - a))
            out.append(rows)
        return part, keys[0].as_py(), keys[len(keys) - 1].as_py(), state, pa.concat_tables(out)

    def tell(table: pa.Table) -> pa.Table:
        part, first, last, state, _ = walk(table)
        return pa.table([pa.array([part], pa.int32()), pa.array([pickle.dumps((first, last, state))], pa.binary())], names=["part", "told"])

    def states(some: DataFrame) -> dict:
        return {r["part"]: pickle.loads(r["told"]) for r in some.groupBy("__part").applyInArrow(tell, "part int, told binary").collect()}  # one row a partition

    ends = states(held)
    order_of = sorted(ends)
    before = {b: a for a, b in zip(order_of, order_of[1:]) if ends[a][1] == ends[b][0]}
    while True:
        new = {b: ends[a][2] for b, a in before.items()}
        again = [b for b in new if new[b] != incoming.get(b) and ends[b][0] == ends[b][1]]
        incoming = new
        if not again:
            break
        ends |= states(held.where(F.col("__part").isin(again)))
    return held.groupBy("__part").applyInArrow(lambda table: walk(table)[4], schema)

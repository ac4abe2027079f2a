"""Messages delivered more than once: keep exactly one copy of each.

Identifiers live in an index of sorted arrays, partitioned by a prefix of their hash. A batch's identifiers are
combined before the shuffle by prefix, then deduplicated and binary-searched in the arrays of their prefix in one
stage; novel ones are written as a new immutable run. Runs are merged in tiers: as soon as ``merge_every`` runs of one
tier exist, each prefix's arrays are merged into one run of the next tier, without a shuffle. A manifest, written anew
with each change, names the runs, so that another session can open the index and go on. A prefix holds about
``prefix_rows`` identifiers, so no task grows with the index.

Where a row has several identifiers, copies are connected through any of them; the links among first copies that
the index yields are closed by min-label propagation with pointer jumping.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.session import materialise, scratch

RUN_SCHEMA = "hi long, lo long, first long, prefix int"
#: Told apart by it, identifiers of different kinds never meet in one index.
MIX = 0x5851F42D4C957F2D


def identifier(*parts: Column) -> tuple[Column, Column]:
    """128 bits of SHA-256 over the parts, as two longs; null if any part is null."""
    given = reduce(lambda a, b: a & b, (p.isNotNull() for p in parts))
    text = F.concat_ws("\x1f", *[F.concat(F.length(p.cast("string")), F.lit(":"), p.cast("string")) for p in parts])
    digest = F.when(given, F.sha2(text, 256))

    def half(at: int) -> Column:  # 32 hex digits do not fit a signed long at once
        top = F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
        return F.shiftleft(top, 32).bitwiseOR(F.conv(F.substring(digest, at + 8, 8), 16, 10).cast("long"))

    return half(1), half(17)


def find_sorted(run_hi: np.ndarray, run_lo: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Positions of (hi, lo) in a run sorted by both, -1 where absent. Equal halves are stepped over."""
    at = np.searchsorted(run_hi, hi)
    out = np.full(len(hi), -1, np.int64)
    todo = np.arange(len(hi))
    while len(todo):
        p = at[todo]
        todo, p = todo[p < len(run_hi)], p[p < len(run_hi)]
        same = run_hi[p] == hi[todo]
        todo, p = todo[same], p[same]
        hit = run_lo[p] == lo[todo]
        out[todo[hit]] = p[hit]
        todo = todo[~hit]
        at[todo] += 1
    return out


def _open_folder(path: str):
    """(file system, path) to read a run's arrays in a task; null where only Spark can read the path."""
    scheme, _, rest = path.partition("://")
    if not rest:
        return pa.fs.LocalFileSystem(), path
    try:
        return pa.fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + "://" + rest)
    except (pa.ArrowInvalid, OSError):
        return None


def _runs_of(paths: list[str], prefix: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    runs = []
    for path in paths:
        fs, base = _open_folder(path)
        for f in fs.get_file_info(pa.fs.FileSelector(f"{base}/prefix={prefix}", allow_not_found=True)):
            if f.path.endswith(".parquet"):
                t = pq.ParquetFile(fs.open_input_file(f.path)).read(["hi", "lo", "first"])
                runs.append(tuple(t[c].to_numpy() for c in ("hi", "lo", "first")))
    return runs


def _least(hi: np.ndarray, lo: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (hi, lo) with the least row of each."""
    order = np.lexsort((row, lo, hi))
    hi, lo, row = hi[order], lo[order], row[order]
    new = np.ones(len(hi), bool)
    new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
    return hi[new], lo[new], row[new]


def _combine(batches):
    """The least row of each identifier of an Arrow batch: a hot identifier is shuffled once a batch."""
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _least(*(b.column(c).to_numpy() for c in ("hi", "lo", "row")))], ["hi", "lo", "row"])


def _searcher(paths: list[str]):
    """Arrow batches (hi, lo, row, prefix) with ``first``: null for identifiers that no run has."""

    def search(batches):
        held: dict[int, list] = {}
        for b in batches:
            hi, lo, row = (b.column(c).to_numpy() for c in ("hi", "lo", "row"))
            prefix = b.column("prefix").to_numpy()
            first = np.full(len(hi), np.iinfo(np.int64).max, np.int64)
            for p in np.unique(prefix).tolist():
                if p not in held:
                    if len(held) >= 2:
                        held.pop(next(iter(held)))
                    held[p] = _runs_of(paths, p)
                mine = np.flatnonzero(prefix == p)
                for run_hi, run_lo, run_first in held[p]:
                    at = find_sorted(run_hi, run_lo, hi[mine], lo[mine])
                    hit = at >= 0
                    first[mine[hit]] = np.minimum(first[mine[hit]], run_first[at[hit]])
            none = first == np.iinfo(np.int64).max
            yield pa.RecordBatch.from_arrays([b.column("hi"), b.column("lo"), pa.array(row), pa.array(first, mask=none), b.column("prefix")], ["hi", "lo", "row", "first", "prefix"])

    return search


def _merger(paths: list[str]):
    """Prefixes to their identifiers, the arrays of all runs merged."""

    def merge(batches):
        for b in batches:
            for p in b.column("id").to_pylist():
                runs = _runs_of(paths, p)
                if runs:
                    hi, lo, first = _least(*(np.concatenate(x) for x in zip(*runs)))
                    for i in range(0, len(hi), 100_000):
                        part = slice(i, i + 100_000)
                        yield pa.RecordBatch.from_arrays([pa.array(hi[part]), pa.array(lo[part]), pa.array(first[part]), pa.array(np.full(len(hi[part]), p, np.int32))], ["hi", "lo", "first", "prefix"])

    return merge


class IdentifierIndex:
    """Identifier -> the smallest row number that carried it, as immutable sorted runs below ``path``.

    A new index takes ``rows_expected`` to size its prefixes, whose number is fixed for its life. With ``path`` of an
    index that is there already, that one goes on: its manifest says what it has. Batches may come in any order, and an
    identifier may be ingested again. Runs are appended and never changed; a merged run's parts stay until
    ``remove_merged``, so that results computed from them stay valid.
    """

    def __init__(self, spark: SparkSession, path: str, rows_expected: int = 0, prefix_rows: int = 4_000_000, merge_every: int = 4):
        self.spark, self.path, self.merge_every = spark, path, merge_every
        self.direct = _open_folder(path) is not None
        self.runs: list[tuple[str, int]] = []  # name, tier
        self.version, self.written, self.merges = 0, 0, 0
        self.prefixes = max(8, -(-rows_expected // prefix_rows))
        self._reopen()

    def _reopen(self) -> None:
        try:
            told = self.spark.read.parquet(f"{self.path}/manifest").orderBy(F.desc("version")).collect()  # one row a run and version
        except AnalysisException:
            return
        self.version = told[0]["version"]
        now = [r for r in told if r["version"] == self.version]
        self.prefixes, self.written = now[0]["prefixes"], now[0]["written"]
        self.runs = sorted((r["run"], r["tier"]) for r in now if r["run"])

    def _tell(self) -> None:
        """A new manifest; its one file appears whole or not at all."""
        self.version += 1
        rows = F.array(*[F.struct(F.lit(n).cast("string").alias("run"), F.lit(t).cast("int").alias("tier")) for n, t in self.runs or [(None, None)]])
        told = self.spark.range(1).select(F.lit(self.prefixes).alias("prefixes"), F.lit(self.written).alias("written"), F.inline(rows))
        told.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={self.version}")

    def _paths(self, runs: Sequence[tuple[str, int]] | None = None) -> list[str]:
        return [f"{self.path}/{n}" for n, _ in (self.runs if runs is None else runs)]

    def _prefixed(self, ids: DataFrame) -> DataFrame:
        # the top 24 bits of the hash scaled, so that a prefix is a contiguous range of identifiers
        return ids.withColumn("prefix", F.shiftright(F.shiftrightunsigned("hi", 40) * self.prefixes, 24).cast("int"))

    def _searched(self, placed: DataFrame) -> DataFrame:
        """(hi, lo, row, prefix), placed by prefix -> the same with ``first``."""
        if self.direct:
            return placed.mapInArrow(_searcher(self._paths()), "hi long, lo long, row long, first long, prefix int")
        known = self._read().groupBy("hi", "lo").agg(F.min("first").alias("first"))
        return placed.join(known, ["hi", "lo"], "left").select("hi", "lo", "row", "first", "prefix")

    def _read(self) -> DataFrame:
        return reduce(DataFrame.unionByName, (self.spark.read.schema(RUN_SCHEMA).parquet(p) for p in self._paths()))

    def lookup(self, ids: DataFrame) -> DataFrame:
        """(hi, lo, row) with any number of rows an identifier -> the same with ``first``, null where unknown.

        Rows are spread by prefix and a part of the row number: many rows of one identifier spread over tasks, each
        of which loads the arrays of a few prefixes.
        """
        if not self.runs:
            return ids.withColumn("first", F.lit(None).cast("long"))
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        spread = F.pmod(F.xxhash64("row"), F.lit(max(1, parts // self.prefixes)))
        placed = self._prefixed(ids).repartition("prefix", spread).sortWithinPartitions("prefix")
        return self._searched(placed).drop("prefix")

    def _write(self, rows: DataFrame, tier: int) -> None:
        """Sorted by identifier within the prefix; the commit protocol makes the run appear whole or not at all."""
        name = f"run-{self.written:06d}"
        rows.select("hi", "lo", "first", "prefix").sortWithinPartitions("prefix", "hi", "lo").write.mode("overwrite").partitionBy("prefix").parquet(f"{self.path}/{name}")
        self.runs.append((name, tier))
        self.written += 1

    def ingest(self, batch: DataFrame) -> None:
        """Add a batch (hi, lo, row): its identifiers are deduplicated locally, novel ones become a run."""
        ids = batch.where(F.col("hi").isNotNull()).select("hi", "lo", "row").mapInArrow(_combine, "hi long, lo long, row long")
        # one shuffle: the aggregate, the search and the write all keep the placing by prefix
        local = self._prefixed(ids).repartition("prefix").groupBy("prefix", "hi", "lo").agg(F.min("row").alias("row")).select("hi", "lo", "row", "prefix")
        if self.runs:
            local = self._searched(local.sortWithinPartitions("prefix")).where("first IS NULL OR row < first").select("hi", "lo", "row", "prefix")
        self._write(local.withColumnRenamed("row", "first"), 0)
        self._merge_tiers()
        self._tell()

    def _all_prefixes(self) -> DataFrame:
        tasks = min(self.prefixes, 8 * int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        return self.spark.range(0, self.prefixes, 1, tasks)

    def _merged(self, runs: Sequence[tuple[str, int]] | None = None) -> DataFrame:
        if self.direct:
            return self._all_prefixes().mapInArrow(_merger(self._paths(runs)), RUN_SCHEMA)
        both = reduce(DataFrame.unionByName, (self.spark.read.schema(RUN_SCHEMA).parquet(p) for p in self._paths(runs)))
        return both.repartition("prefix").groupBy("prefix", "hi", "lo").agg(F.min("first").alias("first"))

    def _merge_tiers(self) -> None:
        """While a tier has ``merge_every`` runs, these become one of the next tier."""
        tier = 0
        while any(t >= tier for _, t in self.runs):
            same = [r for r in self.runs if r[1] == tier]
            if len(same) >= self.merge_every:
                self._write(self._merged(same), tier + 1)
                self.runs = [r for r in self.runs if r not in same]
                self.merges += 1
            tier += 1

    def remove_merged(self) -> None:
        """Delete the folders of runs that were merged into others."""
        jvm = self.spark.sparkContext._jvm
        base = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = base.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        kept = {n for n, _ in self.runs}
        for f in fs.listStatus(base):
            if f.getPath().getName().startswith("run-") and f.getPath().getName() not in kept:
                fs.delete(f.getPath(), True)

    def firsts(self) -> DataFrame:
        """(row) of the first row of every identifier."""
        if not self.runs:
            return self.spark.createDataFrame([], "row long")
        return self._merged().select(F.col("first").alias("row"))


def close_links(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Connected components of (u, v) links as (node, root), root the smallest node; nodes without links are absent.

    Each round takes the least label among neighbours and jumps to the label's label, so chains halve; hot nodes
    cost one partial aggregate a task. Rounds are cut by written tables.
    """
    both = links.where("u <> v").select("u", "v").union(links.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
    # each node with its least neighbour or itself
    edges = materialise(both.distinct(), "links")
    labels = materialise(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("root")), "labels")
    for _ in range(max_rounds):
        jumped = labels.join(labels.select(F.col("node").alias("root"), F.col("root").alias("far")), "root", "left").select("node", F.coalesce("far", "root").alias("root"), F.col("root").alias("was"))
        near = edges.join(labels.select(F.col("node").alias("v"), "root"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        new = materialise(jumped.join(near, "node").select("node", F.least("root", "near").alias("root"), "was"), "labels")
        changed = new.where("root <> was").limit(1).count()
        labels = new.drop("was")
        if not changed:
            return labels
    raise RuntimeError(f"links not closed after {max_rounds} rounds")


def first_copies(
    rows: DataFrame,
    row: str,
    identifiers: Sequence[tuple[Column, Column]],
    n_batches: int = 3,
    merge_every: int = 2,
    prefix_rows: int = 4_000_000,
    batch: str | None = None,
) -> DataFrame:
    """(row) of every row of ``rows`` that is a further copy: not the smallest ``row`` among its copies.

    Two rows are copies if any of ``identifiers`` is equal, directly or through other copies; null identifiers equal
    nothing, rows without any are never copies. ``row`` is unique and gives the order of receipt. Deliveries are
    ingested one after the other: ``n_batches`` consecutive ranges of the batch numbers in ``batch``, or of ``row``
    without it (or where it is null). Empty input: empty result. Other columns are not read, so their names cannot clash.
    """
    spark, n = rows.sparkSession, len(identifiers)
    names = [(f"hi{i}", f"lo{i}") for i in range(n)]
    cols = [e.alias(c) for ids, cs in zip(identifiers, names) for e, c in zip(ids, cs)]
    keyed = rows.select(F.col(row).cast("long").alias("row"), F.col(batch or row).cast("long").alias("delivery"), *cols)
    low, high, total = keyed.agg(F.min("delivery"), F.max("delivery"), F.count("*")).first()
    if not total:
        return keyed.select("row")
    step = max(1, -(-((high or 0) - (low or 0) + 1) // n_batches))
    keyed = keyed.withColumn("delivery", F.coalesce(F.floor((F.col("delivery") - (low or 0)) / step), F.lit(0)).cast("int"))
    # rows alike in all identifiers collapse before any shuffle; from here on one row stands for each such set. With a
    # single identifier they collapse within their batch only: across batches the index finds them.
    flat = [c for cs in names for c in cs]
    if n == 1:
        distinct = keyed.groupBy(*flat, "delivery").agg(F.min("row").alias("row"))
    else:
        distinct = keyed.groupBy(*flat).agg(F.min(F.struct("row", "delivery")).alias("v")).select(*flat, "v.*")
    distinct = materialise(distinct, "identifiers")
    # all kinds of identifiers share one index: the kind is mixed into the hash
    each = F.array(*[F.struct(F.col(hi).alias("hi"), (F.col(lo).bitwiseXOR(F.lit((i * MIX + (1 << 63)) % (1 << 64) - (1 << 63)))).alias("lo")) for i, (hi, lo) in enumerate(names)])
    ids = distinct.select("row", "delivery", F.explode(each).alias("x")).select("x.hi", "x.lo", "row", "delivery").where("hi IS NOT NULL")
    index = IdentifierIndex(spark, scratch(spark, "index"), total * n, prefix_rows, merge_every)
    for b in range(n_batches):
        index.ingest(ids.where(F.col("delivery") == b))
    if n == 1:
        kept = index.firsts()
    else:
        links = index.lookup(ids.select("hi", "lo", "row")).where("first <> row").select(F.col("row").alias("u"), F.col("first").alias("v"))
        roots = close_links(materialise(links, "first-links"))
        kept = distinct.select("row").join(roots.where("node <> root").select(F.col("node").alias("row")), "row", "left_anti")
    some = reduce(lambda a, b: a | b, (F.col(hi).isNotNull() for hi, _ in names))
    return keyed.where(some).select("row").join(kept, "row", "left_anti")

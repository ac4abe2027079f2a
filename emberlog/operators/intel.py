"""Enrichment with indicators, hashes, techniques and vulnerabilities; caches with a time to live."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.versions import package_matches, version_matches
from emberlog.operators.skew import join_lookup

#: Up to so many patterns meet every text by a broadcast; more are found through an index of their n-grams.
MAX_DIMENSION = 2_000


def bounded(dim: DataFrame, max_rows: int = MAX_DIMENSION) -> DataFrame | None:
    """``dim`` for a broadcast, after its size was checked; null if it has more rows."""
    return F.broadcast(dim) if dim.limit(max_rows + 1).count() <= max_rows else None


def grams(text: Column, n: int) -> Column:
    """The distinct n-grams of a text; null and shorter texts have none."""
    last = F.length(text) - n + 1
    at = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substr(text, i, F.lit(n))))


def contained_pairs(texts: DataFrame, patterns: DataFrame, n: int = 3, max_rows: int = MAX_DIMENSION) -> DataFrame:
    """(text, pattern) of all distinct texts and non-empty patterns such that the text contains the pattern.

    ``texts`` and ``patterns`` have those one column. Few patterns meet every text by a broadcast. Any number goes
    through an index: of the n-grams of a pattern the one that the fewest texts have must be in the text, so texts and
    patterns are joined on that and then compared; shorter patterns are n-grams themselves and joined as such.
    """
    t = texts.where(F.length("text") > 0).select("text").distinct()
    p = patterns.where(F.length("pattern") > 0).select("pattern").distinct()
    few = bounded(p, max_rows)
    if few is not None:
        return t.join(few, F.contains("text", "pattern"))
    own = t.select("text", F.explode(grams(F.col("text"), n)).alias("gram"))
    share = own.groupBy("gram").agg(F.count("*").alias("texts"))
    each = p.where(F.length("pattern") >= n).select("pattern", F.explode(grams(F.col("pattern"), n)).alias("gram"))
    # a gram that no text has rules its pattern out
    rare = each.join(share, "gram", "left").groupBy("pattern").agg(F.min_by("gram", F.struct(F.coalesce("texts", F.lit(0)), "gram")).alias("gram"), F.min(F.coalesce("texts", F.lit(0))).alias("least")).where("least > 0").drop("least")
    pairs = own.join(rare, "gram").where(F.contains("text", "pattern")).select("text", "pattern")
    for k in range(1, n):
        short = p.where(F.length("pattern") == k)
        pairs = pairs.unionByName(t.select("text", F.explode(grams(F.col("text"), k)).alias("pattern")).join(short, "pattern").select("text", "pattern"))
    return pairs


def match_vulnerabilities(packages: DataFrame, cves: DataFrame, max_rows: int = MAX_DIMENSION) -> DataFrame:
    """packages(name, version) x cves(cve_id, pattern, op, fixed, cvss) -> matches, whatever the number of patterns.

    Few patterns meet the distinct names by a broadcast. Any number is split by kind: exact patterns are an equi-join; ``prefix*`` ones an equi-join with the prefixes of the distinct names, of the
    lengths that occur; contained ones go through ``contained_pairs``; those for any package (``*`` or empty) meet all
    names, as all are matches until the version is compared. Versions join afterwards.
    """
    names = packages.select("name").where(F.col("name").isNotNull()).distinct()
    pattern = F.col("pattern")
    patterns = cves.select("pattern").where(pattern.isNotNull()).distinct()
    few = bounded(patterns, max_rows)
    if few is not None:
        return _of_version(packages, names.join(few, package_matches(F.col("name"), pattern)), cves)
    anything, prefix = pattern.isin("*", ""), pattern.endswith("*")
    every = names.join(F.broadcast(patterns.where(anything)))  # two rows at most
    stems = patterns.where(prefix & ~anything).withColumn("stem", F.expr("left(pattern, length(pattern) - 1)"))
    lengths = F.broadcast(stems.select(F.length("stem").alias("n")).distinct())  # a row a length of prefix
    begun = names.join(lengths, F.length("name") >= F.col("n")).select("name", F.expr("left(name, n)").alias("stem")).join(stems, "stem").select("name", "pattern")
    # a pattern with a star may also be a whole name
    exact = names.join(patterns.where(prefix & ~anything), (names["name"] == pattern) & ~F.col("name").startswith(F.expr("left(pattern, length(pattern) - 1)"))).select("name", "pattern")
    inside = contained_pairs(names.select(F.col("name").alias("text")), patterns.where(~prefix & ~anything), max_rows=max_rows).select(F.col("text").alias("name"), "pattern")
    return _of_version(packages, every.unionByName(begun).unionByName(exact).unionByName(inside), cves)


def _of_version(packages: DataFrame, pairs: DataFrame, cves: DataFrame) -> DataFrame:
    out = packages.join(pairs, "name").join(cves, "pattern")
    return out.where(version_matches(F.col("version"), F.col("op"), F.col("fixed"))).drop("pattern", "op")


def lookup_indicators(values: DataFrame, value: str, iocs: DataFrame, max_rows: int = MAX_DIMENSION, hot_rows: int = 100_000) -> DataFrame:
    """Each value with the indicator it equals, else the first (by ioc) that it contains or is contained in; else null.

    iocs(ioc, reputation, ...) in lower case, a row an indicator, any number of them. Exact matches are an equi-join; only
    distinct misses are searched for containment, either way round, and only those of four characters or more. Values
    that hold a large share of the rows, null among them, are not bound to one task.
    """
    v = values.withColumn("__v", F.lower(F.trim(F.col(value))))
    seen = v.select("__v").where("__v <> ''").distinct()
    known = iocs.where(F.length("ioc") > 0)
    exact = seen.join(known.select(F.col("ioc").alias("__v"), F.col("ioc")), "__v")
    misses = seen.join(exact.select("__v"), "__v", "left_anti").where(F.length("__v") >= 4)
    few = bounded(known.select("ioc"), max_rows)
    if few is not None:
        near = misses.join(few, F.contains("__v", "ioc") | F.contains("ioc", "__v"))
    else:
        near = _either_way(misses, known, max_rows)
    found = exact.unionByName(near.groupBy("__v").agg(F.min("ioc").alias("ioc"))).join(known, "ioc")
    return join_lookup(v, found, "__v", "left", min_rows=hot_rows).drop("__v")


def _either_way(misses: DataFrame, known: DataFrame, max_rows: int) -> DataFrame:
    """(__v, ioc): values that contain an indicator or are contained in one."""
    holds = contained_pairs(misses.select(F.col("__v").alias("text")), known.select(F.col("ioc").alias("pattern")), max_rows=max_rows).select(F.col("text").alias("__v"), F.col("pattern").alias("ioc"))
    held = contained_pairs(known.select(F.col("ioc").alias("text")), misses.select(F.col("__v").alias("pattern")), max_rows=max_rows).select(F.col("pattern").alias("__v"), F.col("text").alias("ioc"))
    return holds.unionByName(held)


def lookup_equal(values: DataFrame, value: str, dim: DataFrame, key: str, default: dict[str, str]) -> DataFrame:
    """Left equi-join on a lower-cased key, with defaults where nothing is found."""
    d = dim.withColumn("__k", F.lower(F.col(key))).drop(key)
    out = values.withColumn("__k", F.lower(F.trim(F.col(value)))).join(d, "__k", "left").drop("__k")
    return out.fillna(default)


def list_lookup(values: DataFrame, key: str, lists: DataFrame, name: str, out: str) -> DataFrame:
    """``values`` with ``out``: the value that the list ``name`` of lists(list, key, value) has for the key, null where it has none.

    Of a key listed twice the greatest value counts. Hot keys are not bound to one task.
    """
    some = lists.where(F.col("list") == name).groupBy(F.col("key").alias(key)).agg(F.max("value").alias(out))
    return join_lookup(values, some, key, "left")


def first_pattern(values: DataFrame, value: str, patterns: DataFrame, pattern: str, rank: str, max_rows: int = MAX_DIMENSION) -> DataFrame:
    """The first pattern by ``rank`` contained in each value; one aggregate a distinct value."""
    p = patterns.select(F.col(pattern).alias("pattern"), F.col(rank).alias("__r"), F.struct(*patterns.columns).alias("__row")).withColumn("pattern", F.coalesce("pattern", F.lit("")))
    pairs = contained_pairs(values.select(F.col(value).alias("text")), p.select("pattern"), max_rows=max_rows)
    hit = pairs.join(p, "pattern").groupBy(F.col("text").alias(value)).agg(F.min_by("__row", "__r").alias("__row"))
    return join_lookup(values, hit, value, "left").select(*values.columns, *[F.col(f"__row.{c}").alias(c) for c in patterns.columns])


def techniques_by_tactic(techniques: DataFrame, tactic: str) -> DataFrame:
    return techniques.where(F.exists("tactics", lambda t: F.lower(t) == tactic.lower()))


def search_techniques(techniques: DataFrame, query: str) -> DataFrame:
    q = F.lit(query.lower())
    return techniques.where(reduce(lambda a, b: a | b, (F.contains(F.lower(F.coalesce(c, F.lit(""))), q) for c in ("id", "name", "description"))))


def fresh_entries(cache: DataFrame, key: str, written: str, ttl_s: str, now: Column) -> DataFrame:
    """The last written entry of each key, if it has not expired at ``now``."""
    cols = [c for c in cache.columns if c != key]
    last = cache.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(written)).alias("e")).select(key, "e.*")
    return last.where(F.unix_micros(F.col(written).cast("timestamp")) + F.col(ttl_s) * 1_000_000 > F.unix_micros(now.cast("timestamp")))


def shared_verdicts(verdicts: DataFrame, agent: str, own: str, at: str, now: Column, ttl_s: int = 300) -> DataFrame:
    """Verdicts of other agents that are at most ``ttl_s`` old."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))
    return verdicts.where((F.col(agent) != own) & age.between(0, ttl_s * 1_000_000))


def correlate_across_nodes(sightings: DataFrame, ioc: str, node: str, at: str, min_nodes: int = 1) -> DataFrame:
    """(ioc, node_count, confidence, first_seen, last_seen): indicators by the number of nodes that saw them."""
    n = sightings.where(F.col(ioc).isNotNull()).groupBy(ioc).agg(F.count_distinct(node).alias("node_count"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))
    return n.where(F.col("node_count") >= min_nodes).withColumn("confidence", F.when(F.col("node_count") >= 3, 0.9).when(F.col("node_count") >= 2, 0.75).otherwise(0.5))


def top_correlations(correlations: DataFrame, ioc: str, limit: int = 100) -> DataFrame:
    return correlations.orderBy(F.desc("node_count"), F.desc("confidence"), ioc).limit(limit)


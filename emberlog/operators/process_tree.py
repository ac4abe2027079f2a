"""Process trees: suspicious parents, ancestors, depths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.session import materialise

#: Children that are suspicious below a parent.
BAD_CHILDREN = {
    "winword.exe": ["powershell.exe", "cmd.exe", "wscript.exe", "cscript.exe", "rundll32.exe"],
    "excel.exe": ["powershell.exe", "cmd.exe"],
    "outlook.exe": ["powershell.exe", "wscript.exe"],
    "chrome.exe": ["cmd.exe", "powershell.exe"],
    "firefox.exe": ["cmd.exe", "powershell.exe"],
    "explorer.exe": ["powershell.exe", "cmd.exe", "wscript.exe"],
}


def suspicious_ancestry(processes: DataFrame, pid: str, ppid: str, name: str, bad: dict[str, list[str]] | None = None) -> DataFrame:
    """(parent_pid, parent_name, pid, name) of children listed as bad below their parent, names in any letter case.

    Both sides are cut to listed names before the join, so only candidates are shuffled.
    """
    bad = BAD_CHILDREN if bad is None else bad
    low = F.lower(name)
    children = processes.where(low.isin(sorted({c for v in bad.values() for c in v}))).select(F.col(pid).alias("pid"), F.col(name).alias("name"), F.col(ppid).alias("parent_pid"))
    parents = processes.where(low.isin(sorted(bad))).select(F.col(pid).alias("parent_pid"), F.col(name).alias("parent_name"))
    pair = F.lit(False)
    for p, cs in bad.items():
        pair = pair | ((F.lower("parent_name") == p) & F.lower("name").isin(cs))
    return children.join(parents, "parent_pid").where(pair).select("parent_pid", "parent_name", "pid", "name")


def ancestors(edges: DataFrame, node: str, parent: str, max_rounds: int = 64) -> DataFrame:
    """(node, depth, root): distance to the topmost known ancestor, by pointer doubling: log2(depth) joins.

    Nodes whose parent has no row of its own have depth 0; a node on or below a cycle has depth null and root null.
    Repeated nodes count once (the least parent).
    """
    e = edges.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.min(parent).alias("up"))
    known = e.select(F.col("node").alias("up"), F.lit(True).alias("known"))
    state = materialise(e.join(known, "up", "left").select("node", F.when(F.col("known"), F.col("up")).alias("up"), F.when(F.col("known"), F.lit(1).cast("long")).otherwise(0).alias("dist"), F.when(F.col("known"), F.col("up")).otherwise(F.col("node")).alias("top")), "ancestors")
    nodes = state.count()
    for _ in range(max_rounds):
        far = state.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("dist").alias("dist2"), F.col("top").alias("top2"))
        state = materialise(state.join(far, "up", "left").select("node", F.col("up2").alias("up"), (F.col("dist") + F.coalesce("dist2", F.lit(0))).alias("dist"), F.coalesce("top2", "top").alias("top")), "ancestors")
        open_ = state.where(F.col("up").isNotNull()).agg(F.count("*"), F.max("dist")).first()
        if not open_[0] or open_[1] > nodes:
            break  # all at their top, or longer than any chain of rows: cycles
    cyclic = F.col("up").isNotNull()
    return state.select("node", F.when(~cyclic, F.col("dist")).alias("depth"), F.when(~cyclic, F.col("top")).alias("root"))


def ancestor_chain(edges: DataFrame, node: str, parent: str, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(start, ancestor, step): all ancestors of each start in order; a cycle ends the chain where it closes.

    Chains of any depth by pointer doubling, log2(depth) rounds: with the ancestors below step 2^k known, a jump of 2^k
    from each gives those below 2^(k+1). An ancestor met again (a cycle) keeps its least step, and a round that finds
    none anew is the last. Repeated starts count once; ``max_depth`` cuts the chains only if given.
    """
    kind = dict(starts.dtypes)[node]
    key = F.col(node)
    jump = materialise(edges.where(key.isNotNull()).groupBy(key.alias("at")).agg(F.min(parent).alias("up")).where("up IS NOT NULL"), "jumps")
    chain = materialise(starts.where(key.isNotNull()).select(key.alias("start"), key.alias("ancestor"), F.lit(0).alias("step")).distinct(), "chain")
    known, far = chain.count(), 1
    while max_depth is None or far <= max_depth:
        beyond = chain.join(jump.withColumnRenamed("at", "ancestor"), "ancestor").select("start", F.col("up").cast(kind).alias("ancestor"), (F.col("step") + far).alias("step"))
        chain = materialise(chain.unionByName(beyond).groupBy("start", "ancestor").agg(F.min("step").alias("step")), "chain")
        before, known = known, chain.count()
        if known == before:
            break
        jump = materialise(jump.join(jump.select(F.col("at").alias("up"), F.col("up").alias("up2")), "up").select("at", F.col("up2").alias("up")), "jumps")
        far *= 2
    out = chain.where("step > 0")
    return out if max_depth is None else out.where(F.col("step") <= max_depth)

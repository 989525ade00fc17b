"""Crawlers as DataFrame steps: all runs of a batch advance one query per step (the rules of ``RULES`` and walks), and tables crawls use.

State tables, keyed by run: closed(run, step, id) and open(run, id, obs, first): how many closed neighbours an open node
has, and the step that found it. A step joins one node per run with the adjacency, so its cost follows the answers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.cluster import cut
from netquarry.functions.choice import u
from netquarry.operators.prep import adjacency, degrees


def _u(step: int) -> Column:
    digest = F.md5(F.concat_ws(":", F.col("seed").cast("string"), F.lit(step).cast("string"), F.col("id")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _first_seen_u() -> Column:
    digest = F.md5(F.concat_ws(":", F.col("seed").cast("string"), F.col("first").cast("string"), F.col("id")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


#: rule -> order in which open nodes are preferred; ties by hash, then id.
RULES: dict[str, Callable[[int], list[Column]]] = {
    "random": lambda t: [],
    "mod": lambda t: [F.desc("obs")],
    "med": lambda t: [F.desc(F.col("deg") - F.col("obs"))],
    "cheat": lambda t: [F.desc("deg")],
    "ratio": lambda t: [F.desc(F.col("obs") / F.col("deg"))],
    "cash": lambda t: [F.desc(F.round("cash", 9))],
    "bfs": lambda t: [F.asc("first"), _first_seen_u()],
    "sb": lambda t: [F.asc("first"), _first_seen_u()],
    "opic": lambda t: [F.desc(F.round("opic", 9))],
    "k_rank": lambda t: [],
    "degree_gap": lambda t: [F.asc(F.col("obs") < F.col("mean")), F.desc(F.col("obs") - F.col("mean"))],
    "max_score": lambda t: [F.desc("near")],
    "unobserved": lambda t: [F.desc("fresh")],
}


def _weighed(rule: str, own: DataFrame, closed: DataFrame, open_: DataFrame, adj: DataFrame, deg: DataFrame, t: int) -> DataFrame:
    """The open nodes ``own`` with what a rule asks of them besides their own columns."""
    if rule == "k_rank":  # G26: any of the top tenth by excess degree, if that is over two nodes
        w = Window.partitionBy("run")
        own = own.withColumn("rank", F.row_number().over(w.orderBy(F.desc(F.col("deg") - F.col("obs")), _u(t), "id"))).withColumn("cut", F.floor(F.count("*").over(w) * F.lit(0.1)))
        return own.where("rank = 1 OR (cut > 2 AND rank <= cut)")
    if rule == "degree_gap":  # G29: against the mean degree of the closed nodes
        return own.join(F.broadcast(closed.join(deg, "id").groupBy("run").agg(F.avg("deg").alias("mean"))), "run")
    if rule == "max_score":  # G28: neighbours of the ten closed nodes of highest degree, once there are more
        w = Window.partitionBy("run").orderBy(F.desc("deg"), "id")
        top = closed.join(deg, "id").withColumn("k", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("run"))).where("k <= 10 AND n > 10")
        near = top.select("run", "id").join(adj.select("id", "nbr"), "id").select("run", F.col("nbr").alias("id"), F.lit(1).alias("near")).distinct()
        return own.join(near, ["run", "id"], "left").withColumn("near", F.coalesce("near", F.lit(0)))
    if rule == "unobserved":  # G31: neighbours that nobody has seen
        seen = closed.select("run", F.col("id").alias("nbr")).union(open_.select("run", F.col("id").alias("nbr")))
        fresh = own.select("run", "id").join(adj.select("id", "nbr"), "id").join(seen, ["run", "nbr"], "left_anti").groupBy("run", "id").agg(F.count("*").alias("fresh"))
        return own.join(fresh, ["run", "id"], "left").withColumn("fresh", F.coalesce("fresh", F.lit(0)))
    return own


def crawl(edges: DataFrame, runs: DataFrame, rule: str, steps: int, start: DataFrame | None = None) -> DataFrame:
    """(run, step, id, obs, nodes, edges): the trace of runs(run, seed); nodes and edges are counts after the step.

    A run ends when no open node is left. ``sb`` queues the first half (rounded up) of each answer's new nodes.
    """
    adj = cut(adjacency(edges).join(degrees(edges), "id"))
    deg = adj.select("id", "deg").distinct()
    if start is None:
        first = runs.crossJoin(deg.select("id"))  # runs are few; the table is a node list per run
        start = first.groupBy("run").agg(F.min(F.struct(_u(0), "id")).alias("m")).select("run", F.col("m.id").alias("id"))
    current = cut(start.select("run", "id", F.lit(0).cast("long").alias("obs"), F.lit(1.0).alias("opic")))
    open_ = cut(runs.limit(0).select("run", F.lit("").alias("id"), F.lit(0).cast("long").alias("obs"), F.lit(0).alias("first"), F.lit(True).alias("queued"), F.lit(0.0).alias("cash"), F.lit(0.0).alias("opic")))
    closed = current.limit(0).select("run", "id")
    trace = None
    for t in range(1, steps + 1):
        rows = current.select("run", F.lit(t).alias("step"), "id", "obs")
        trace = rows if trace is None else trace.union(rows)
        closed = cut(closed.union(current.select("run", "id")))
        answer = current.join(adj, "id").select("run", F.col("nbr").alias("id"), (1.0 / F.col("deg")).alias("share"), (F.col("opic") / F.col("deg")).alias("paid")).join(closed, ["run", "id"], "left_anti")
        known = open_.join(current.select("run", "id"), ["run", "id"], "left_anti")
        both = known.select("run", "id", "obs", "first", "queued", "cash", "opic").join(answer, ["run", "id"], "full_outer")
        fresh = F.col("first").isNull()
        both = both.join(F.broadcast(runs.select("run", "seed")), "run").withColumn("rank", F.row_number().over(Window.partitionBy("run", fresh).orderBy(_u(t), "id"))) if rule == "sb" else both
        if rule == "sb":
            both = both.withColumn("half", F.ceil(F.count("*").over(Window.partitionBy("run", fresh)) / 2))
        queued = F.when(fresh, F.col("rank") <= F.col("half")).otherwise(F.col("queued")) if rule == "sb" else F.lit(True)
        open_ = cut(both.select("run", "id", (F.coalesce("obs", F.lit(0)) + F.when(F.col("share").isNull(), 0).otherwise(1)).cast("long").alias("obs"), F.coalesce("first", F.lit(t)).alias("first"), queued.alias("queued"), (F.coalesce("cash", F.lit(1.0)) + F.coalesce("share", F.lit(0.0))).alias("cash"), (F.coalesce("opic", F.lit(1.0)) + F.coalesce("paid", F.lit(0.0))).alias("opic")))
        if t < steps:
            own = open_.where("queued").join(deg, "id").join(F.broadcast(runs.select("run", "seed")), "run")
            w = Window.partitionBy("run").orderBy(*RULES[rule](t), _u(t), "id")
            own = _weighed(rule, own, closed, open_, adj, deg, t)
            current = cut(own.withColumn("k", F.row_number().over(w)).where("k = 1").select("run", "id", "obs", "opic"))
            if current.isEmpty():
                break
    trace = cut(trace)
    return trace.join(curve(adj, trace), ["run", "step"])


def curve(adj: DataFrame, trace: DataFrame) -> DataFrame:
    """(run, step, nodes, edges) observed after each step, from the step that first showed each node and edge."""
    asked = trace.groupBy("run", "id").agg(F.min("step").alias("step"))
    shown = asked.join(adj.select("id", "nbr"), "id")
    nodes = asked.select("run", "id", "step").union(shown.select("run", "nbr", "step")).groupBy("run", "id").agg(F.min("step").alias("step"))
    links = shown.groupBy("run", F.least("id", "nbr").alias("a"), F.greatest("id", "nbr").alias("b")).agg(F.min("step").alias("step"))
    per = nodes.groupBy("run", "step").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("m")).union(links.groupBy("run", "step").agg(F.lit(0).cast("long"), F.count("*")))
    new = trace.select("run", "step").distinct().join(per.groupBy("run", "step").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), ["run", "step"], "left")
    w = Window.partitionBy("run").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return new.select("run", "step", F.sum(F.coalesce("n", F.lit(0))).over(w).alias("nodes"), F.sum(F.coalesce("m", F.lit(0))).over(w).alias("edges"))


def walk(edges: DataFrame, runs: DataFrame, hops: int, start: DataFrame | None = None) -> DataFrame:
    """(run, step, id, charged): a uniform walk; a node is charged at its first visit only."""
    adj = cut(adjacency(edges))
    seeds = F.broadcast(runs.select("run", "seed"))
    if start is None:
        first = runs.crossJoin(adj.select("id").distinct())
        start = first.groupBy("run").agg(F.min(F.struct(_u(0), "id")).alias("m")).select("run", F.col("m.id").alias("id"))
    current = cut(start.select("run", "id"))
    trace = current.select("run", F.lit(1).alias("step"), "id")
    for t in range(1, hops):
        near = current.join(adj, "id").select("run", F.col("nbr").alias("id")).join(seeds, "run")
        current = cut(near.groupBy("run").agg(F.min(F.struct(_u(t), "id")).alias("m")).select("run", F.col("m.id").alias("id")))
        trace = trace.union(current.select("run", F.lit(t + 1).alias("step"), "id"))
    trace = cut(trace)
    first = trace.groupBy("run", "id").agg(F.min("step").alias("first"))
    return trace.join(first, ["run", "id"]).select("run", "step", "id", (F.col("step") == F.col("first")).alias("charged"))


def densification_candidates(open_: DataFrame, share: float = 0.2) -> DataFrame:
    """The top int(share * n) open nodes by observed degree; all of them when that is 0."""
    n = open_.count()
    k = int(share * n)
    return open_.orderBy(F.desc("obs"), "id").limit(k) if k else open_


def expansion_candidates(cc: DataFrame, k: int = 15) -> DataFrame:
    """The k open nodes of lowest clustering."""
    return cc.orderBy("cc", "id").limit(k)


def densification_choice(scores: DataFrame, seed: int, step: int) -> DataFrame:
    """scores(id, deg, cc): arg-max of min-max degree times (1 - cc); the first by degree with ten or fewer."""
    lim = scores.agg(F.min("deg").alias("lo"), F.max("deg").alias("hi"), F.count("*").alias("n"))
    own = scores.crossJoin(F.broadcast(lim))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("deg") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.col("deg"))
    value = F.when(F.col("n") > 10, scaled * (1 - F.col("cc"))).otherwise(F.col("deg"))
    return own.withColumn("score", value.cast("double")).orderBy(F.desc(F.round("score", 9)), u(seed, step, "id"), "id").limit(1).select("id", "score")


def densification_score(trace: DataFrame, weight: float = 1.0, decay: float = 0.5) -> DataFrame:
    """s = decay * previous + weight * new/(deg - obs), without previous at first: the closed form of the recurrence."""
    x = F.coalesce(F.expr("try_divide(new, deg - obs)"), F.lit(0.0)) * weight
    own = trace.withColumn("x", x)
    w = Window.partitionBy("run").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    terms = F.collect_list("x").over(w)
    return own.withColumn("score", F.aggregate(terms, F.lit(0.0), lambda s, v: s * decay + v)).drop("x")


def expansion_score(trace: DataFrame, weight: float = 1.0, decay: float = 0.5) -> DataFrame:
    """s = decay * previous + weight * (deg - new - obs)/(deg - obs), from 0."""
    x = F.coalesce(F.expr("try_divide(deg - new - obs, deg - obs)"), F.lit(0.0)) * weight
    w = Window.partitionBy("run").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return trace.withColumn("x", x).withColumn("score", F.aggregate(F.collect_list("x").over(w), F.lit(0.0), lambda s, v: s * decay + v)).drop("x")


def window_yield(curve_: DataFrame, size: int = 10) -> DataFrame:
    """New nodes in the last ``size`` steps and in the ``size`` before them, by frames."""
    w = Window.partitionBy("run").orderBy("step")
    new = curve_.withColumn("new", F.col("nodes") - F.coalesce(F.lag("nodes").over(w), F.lit(0)))
    return new.select("run", "step", "new", F.sum("new").over(w.rowsBetween(-(size - 1), 0)).alias("now"), F.coalesce(F.sum("new").over(w.rowsBetween(-(2 * size - 1), -size)), F.lit(0)).alias("before"))


def top_hubs(edges: DataFrame, com: DataFrame, share: float = 0.1) -> DataFrame:
    """Per community the top share by degree, at least one."""
    own = degrees(edges).join(com, "id")
    w = Window.partitionBy("com")
    return own.withColumn("k", F.row_number().over(w.orderBy(F.desc("deg"), "id"))).withColumn("n", F.count("*").over(w)).where(F.col("k") <= F.greatest(F.lit(1), F.floor(share * F.col("n")))).select("com", "id", "deg")


def cheap_estimate(cheap: DataFrame, candidates: DataFrame, seen: DataFrame) -> DataFrame:
    """Unobserved neighbours of the candidates in the cheap layer."""
    new = adjacency(cheap).join(candidates.select("id"), "id", "left_semi").join(seen.select(F.col("id").alias("nbr")), "nbr", "left_anti").groupBy("id").agg(F.count("*").alias("n"))
    return candidates.select("id").join(new, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def cheap_choice(scores: DataFrame, cheap_degrees: DataFrame, most: int = 50) -> DataFrame:
    """(id, score): min-max degree * (1 - cc) + cheap degree / its maximum; the best ``most``."""
    own = scores.join(cheap_degrees.select("id", F.col("deg").alias("cheap")), "id", "left")
    lim = own.agg(F.min("deg").alias("lo"), F.max("deg").alias("hi"), F.max("cheap").alias("top"))
    own = own.crossJoin(F.broadcast(lim))
    scaled = F.expr("coalesce(try_divide(deg - lo, hi - lo), double(deg))")
    return own.select("id", (scaled * (1 - F.col("cc")) + F.coalesce(F.expr("try_divide(cheap, top)"), F.lit(0.0))).alias("score")).orderBy(F.desc(F.round("score", 9)), "id").limit(most)


def core_and_periphery(edges: DataFrame, trace: DataFrame) -> DataFrame:
    """(run, id, kind): nodes a bounded crawl has queried, and those it has only seen."""
    core = trace.select("run", "id").distinct()
    seen = core.join(adjacency(edges), "id").select("run", F.col("nbr").alias("id")).distinct().join(core, ["run", "id"], "left_anti")
    return core.withColumn("kind", F.lit("core")).union(seen.withColumn("kind", F.lit("periphery")))


def cheap_overlap(expensive: DataFrame, cheap: DataFrame, seen: DataFrame) -> DataFrame:
    """(id, overlap): of each seen node, how many seen nodes are its neighbours in the cheap layer."""
    own = seen.select("id").distinct()
    near = adjacency(cheap).join(own, "id", "left_semi").join(own.select(F.col("id").alias("nbr")), "nbr", "left_semi").groupBy("id").agg(F.count("*").alias("overlap"))
    return own.join(near, "id", "left").select("id", F.coalesce("overlap", F.lit(0)).cast("long").alias("overlap"))

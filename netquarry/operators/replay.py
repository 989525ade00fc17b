"""Replay of logged crawls and result processing (I1-I11): orders(run, step, id) against edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netquarry.cluster import cut
from netquarry.functions.choice import u
from netquarry.operators.metrics import local_clustering
from netquarry.operators.prep import adjacency, degrees, induced
from netquarry.operators.stats import _ks_p, ks_two_sample


def _first_shown(edges: DataFrame, orders: DataFrame) -> DataFrame:
    """(run, id, step): the step whose answer (or query) first shows each node."""
    asked = orders.groupBy("run", "id").agg(F.min("step").alias("step"))
    shown = asked.join(adjacency(edges), "id").select("run", F.col("nbr").alias("id"), "step")
    return asked.union(shown.select("run", "id", "step")).groupBy("run", "id").agg(F.min("step").alias("step"))


def new_nodes(edges: DataFrame, orders: DataFrame, every: int = 10) -> DataFrame:
    """New nodes of every tenth step."""
    per = _first_shown(edges, orders).groupBy("run", "step").agg(F.count("*").alias("n"))
    steps = orders.select("run", "step").distinct()
    return steps.join(per, ["run", "step"], "left").where(F.col("step") % every == 0).select("run", "step", F.coalesce("n", F.lit(0)).cast("long").alias("new"))


def community_coverage(edges: DataFrame, orders: DataFrame, com: DataFrame) -> DataFrame:
    """(run, step, com, coverage): the queried node's community and how much of it is seen by then."""
    shown = _first_shown(edges, orders).join(com, "id").groupBy("run", "com", "step").agg(F.count("*").alias("n"))
    asked = orders.join(com, "id").select("run", "com", "step", F.lit(0).cast("long").alias("n"))
    both = shown.union(asked).groupBy("run", "com", "step").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("run", "com").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    size = com.groupBy("com").agg(F.count("*").alias("members"))
    run = both.withColumn("seen", F.sum("n").over(w)).join(size, "com")
    return run.join(orders.join(com, "id").select("run", "step", "com"), ["run", "step", "com"], "left_semi").select("run", "step", "com", (F.col("seen") / F.col("members")).alias("coverage"))


def properties(edges: DataFrame, orders: DataFrame, every: int = 10) -> DataFrame:
    """The sample graph after every ``every`` steps: nodes, mean_deg, mean_cc and the two-sample test (d, p) of its degrees
    against the graph's, for all its nodes and (with _c) for the queried ones alone.

    I4: where both tables have a column ``graph``, every run is held against its own graph. Triangles are listed once a run,
    with the step that completes them. Of every mark only its histogram of degrees (nodes, queried ones and their triangles) is kept.
    """
    g = ["graph"] if "graph" in edges.columns else []
    run = [*g, "run"]
    both = edges.select(*g, F.col("src").alias("id"), F.col("dst").alias("nbr")).union(edges.select(*g, F.col("dst").alias("id"), F.col("src").alias("nbr")))
    asked = orders.groupBy(*run, "id").agg(F.min("step").alias("step"))
    links = cut(asked.join(both, [*g, "id"]).groupBy(*run, F.least("id", "nbr").alias("a"), F.greatest("id", "nbr").alias("b")).agg(F.min("step").alias("step")))
    marks = orders.where(F.col("step") % every == 0).select(*run, F.col("step").alias("mark")).distinct()
    third = links.select(*run, "a", F.col("b").alias("c"), F.col("step").alias("s3"))
    corner = links.join(links.select(*run, F.col("a").alias("b"), F.col("b").alias("c"), F.col("step").alias("s2")), [*run, "b"]).join(third, [*run, "a", "c"])
    corner = corner.select(*run, F.explode(F.array("a", "b", "c")).alias("id"), F.greatest("step", "s2", "s3").alias("step"))
    # A node's degree, triangles and state change at few marks: each change leaves one cell (degree) and enters another.
    due = (F.ceil(F.col("step") / every) * every).alias("mark")
    change = lambda rows, *v: rows.select(*run, "id", due, *[F.lit(x).cast("long").alias(n) for n, x in zip(("deg", "tri", "asks"), v, strict=True)])
    changes = change(links.select(*run, F.explode(F.array("a", "b")).alias("id"), "step"), 1, 0, 0).union(change(corner, 0, 1, 0)).union(change(asked, 0, 0, 1))
    w = Window.partitionBy(*run, "id").orderBy("mark").rowsBetween(Window.unboundedPreceding, 0)
    state = changes.groupBy(*run, "id", "mark").agg(*[F.sum(c).alias(c) for c in ("deg", "tri", "asks")])
    state = state.select(*run, "mark", *[F.sum(c).over(w).alias(c) for c in ("deg", "tri", "asks")], *[(F.sum(c).over(w) - F.col(c)).alias(f"{c}0") for c in ("deg", "tri", "asks")])
    cell = lambda sign, end: F.struct(F.col(f"deg{end}").alias("deg"), F.lit(sign).cast("long").alias("n"), (sign * F.col(f"tri{end}")).alias("tri"), (sign * F.col(f"asks{end}")).alias("n_c"), (sign * F.col(f"tri{end}") * F.col(f"asks{end}")).alias("tri_c"))
    sums = [F.sum(c).alias(c) for c in ("n", "tri", "n_c", "tri_c")]
    moves = state.select(*run, "mark", F.explode(F.array(cell(1, ""), cell(-1, "0"))).alias("x")).select(*run, "mark", "x.*").where("deg > 0").groupBy(*run, "mark", "deg").agg(*sums)
    moves = cut(moves)
    whole = cut(both.groupBy(*g, "id").count().groupBy(*g, F.col("count").alias("deg")).agg(F.count("*").alias("whole")))
    # Every mark's histogram: the sums of the moves up to it, for all degrees of the run and of its graph.
    runs = marks.select(*run).distinct()
    held = moves.select(*run, "deg").union((runs.join(whole, g) if g else runs.crossJoin(F.broadcast(whole))).select(*run, "deg")).distinct()
    grid = marks.join(held, run).select(*run, "mark", "deg", *[F.lit(0).cast("long").alias(c) for c in ("n", "tri", "n_c", "tri_c")], F.lit(1).alias("is_mark"))
    rows = grid.union(moves.withColumn("is_mark", F.lit(0))).groupBy(*run, "mark", "deg").agg(*sums, F.max("is_mark").alias("is_mark"))
    upto = Window.partitionBy(*run, "deg").orderBy("mark").rowsBetween(Window.unboundedPreceding, 0)
    hist = rows.select(*run, "mark", "deg", "is_mark", *[F.sum(c).over(upto).alias(c) for c in ("n", "tri", "n_c", "tri_c")]).where("is_mark = 1").join(whole, [*g, "deg"], "left")
    below = Window.partitionBy(*run, "mark").orderBy("deg").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.select("*", *[F.sum(F.coalesce(c, F.lit(0))).over(below).alias(f"below_{c}") for c in ("n", "n_c", "whole")], *[F.sum(F.coalesce(c, F.lit(0))).over(Window.partitionBy(*run, "mark")).alias(f"all_{c}") for c in ("n", "n_c", "whole")])
    cc = lambda c: F.sum(F.when(F.col("deg") > 1, 2 * F.col(c) / (F.col("deg") * (F.col("deg") - 1))).otherwise(0.0))
    apart = lambda c: F.max(F.abs(F.expr(f"try_divide(below_{c}, all_{c})") - F.col("below_whole") / F.col("all_whole")))
    mean = lambda total, c: F.when(F.first(f"all_{c}") > 0, total / F.first(f"all_{c}"))
    out = hist.groupBy(*run, F.col("mark").alias("step")).agg(
        F.first("all_n").alias("nodes"), F.first("all_n_c").alias("closed"), F.first("all_whole").alias("m"), apart("n").alias("d"), apart("n_c").alias("d_c"),
        *[x for c, t, end in (("n", "tri", ""), ("n_c", "tri_c", "_c")) for x in (mean(F.sum(F.col(c) * F.col("deg")), c).alias(f"mean_deg{end}"), mean(cc(t), c).alias(f"mean_cc{end}"))],
    ).where("nodes > 0")
    p = lambda d, n: F.when(F.col(n) > 0, _ks_p(F.col(d), F.col(n), F.col("m")))
    return out.select(*run, "step", "nodes", "mean_deg", "mean_cc", "d", p("d", "nodes").alias("p"), "closed", "mean_deg_c", "mean_cc_c", "d_c", p("d_c", "closed").alias("p_c"))


def accumulated(traces: dict[str, DataFrame], interval: int = 10) -> DataFrame:
    """Curves of several algorithms, one row for each algorithm, trial and multiple of the interval; traces(trial, cost, nodes,
    edges). The last state at or before a mark counts."""
    out = None
    for algo, trace in traces.items():
        mark = F.floor(F.col("cost") / interval) * interval
        rows = trace.groupBy("trial", mark.cast("int").alias("budget")).agg(F.max("nodes").alias("nodes"), F.max("edges").alias("edges")).select(F.lit(algo).alias("algo"), "trial", "budget", "nodes", "edges")
        out = rows if out is None else out.union(rows)
    return out


def relabelled(orders: DataFrame, com: DataFrame) -> DataFrame:
    """Community labels from 1 by first appearance in the order."""
    first = orders.join(com, "id").groupBy("run", "com").agg(F.min("step").alias("first"))
    return first.select("run", "com", F.dense_rank().over(Window.partitionBy("run").orderBy("first")).alias("label"))


def normalised(curve: DataFrame, n: int, m: int) -> DataFrame:
    """I6."""
    return curve.withColumn("nodes", F.col("nodes") / n).withColumn("edges", F.col("edges") / m)


def small_sample(edges: DataFrame, orders: DataFrame) -> DataFrame:
    """The induced graph of the queried nodes."""
    return induced(edges, orders.select("id"))


def merged_logs(left: DataFrame, right: DataFrame) -> DataFrame:
    """I8: logs (row_no, budget, ...) side by side up to the first row whose budgets differ."""
    own = left.join(right.withColumnRenamed("budget", "budget2"), "row_no")
    bad = own.where("budget <> budget2").agg(F.min("row_no").alias("bad"))
    return own.crossJoin(F.broadcast(bad)).where("bad IS NULL OR row_no < bad").drop("budget2", "bad")


def core_periphery(edges: DataFrame, core: int, seed: int, repeat: int) -> DataFrame:
    """(id, observed, actual) degrees of a random core and its periphery, equal ones dropped."""
    deg = degrees(edges)
    inner = deg.orderBy(u(seed, repeat, "id"), "id").limit(core).select("id")
    around = adjacency(edges).join(inner, "id", "left_semi")
    links = around.select(F.least("id", "nbr").alias("src"), F.greatest("id", "nbr").alias("dst")).distinct()
    return degrees(links).withColumnRenamed("deg", "observed").join(deg.withColumnRenamed("deg", "actual"), "id").where("observed <> actual")


def sample_report(sample: DataFrame, graph: DataFrame | None = None) -> DataFrame:
    """Mean and median degree and mean clustering of a sample and, against its graph, the two-sample test of degrees (d, p)."""
    own = local_clustering(sample)
    out = own.agg(F.avg("deg").alias("mean_deg"), F.expr("percentile(deg, 0.5)").alias("median_deg"), F.avg("cc").alias("mean_cc"))
    if graph is None:
        return out
    value = lambda d: d.select(F.col("deg").alias("value"))
    return out.crossJoin(F.broadcast(ks_two_sample(value(own), value(degrees(graph)))))

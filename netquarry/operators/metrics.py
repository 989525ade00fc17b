"""Structural metrics (D1-D29) over canonical edges(src, dst)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netquarry.cluster import cut, discard
from netquarry.operators.prep import adjacency, degrees, vertices

#: Most edges inside communities that are broadcast.
MAX_EDGES = 5_000_000


def degree_stats(edges: DataFrame) -> DataFrame:
    """Mean, median and population deviation of the degrees."""
    return degrees(edges).agg(F.avg("deg").alias("mean"), F.expr("percentile(deg, 0.5)").alias("median"), F.stddev_pop("deg").alias("std"))


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c): each triangle once. Edges point from lower to higher (degree, id), so no node has many out-edges."""
    deg = degrees(edges)
    e = edges.join(deg.toDF("src", "ds"), "src").join(deg.toDF("dst", "dd"), "dst")
    up = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
    out = e.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b"))
    wedge = out.join(out.select("a", F.col("b").alias("c")), "a").where("b < c")
    closing = edges.select(F.col("src").alias("b"), F.col("dst").alias("c"))
    return wedge.join(closing, ["b", "c"]).select("a", "b", "c")


def local_clustering(edges: DataFrame) -> DataFrame:
    """(id, deg, tri, cc); cc is 2T / (d (d - 1)), 0 below degree 2."""
    tri = triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("tri"))
    d = F.col("deg")
    return degrees(edges).join(tri, "id", "left").select("id", "deg", F.coalesce("tri", F.lit(0)).alias("tri")).withColumn("cc", F.when(d > 1, 2.0 * F.col("tri") / (d * (d - 1))).otherwise(0.0))


def average_clustering(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Over all nodes or a subset."""
    cc = local_clustering(edges)
    return (cc if nodes is None else cc.join(nodes.select("id"), "id", "left_semi")).agg(F.avg("cc").alias("cc"))


def density(edges: DataFrame) -> DataFrame:
    """Nodes, edges, density and tree-adjusted density (0 where undefined)."""
    n = vertices(edges).agg(F.count("*").alias("n"))
    m = edges.agg(F.count("*").alias("m"))
    full = F.col("n") * (F.col("n") - 1) / 2
    both = n.crossJoin(F.broadcast(m))  # two one-row tables
    tree = F.expr("try_divide(m - (n - 1), n * (n - 1) / 2 - (n - 1))")
    return both.select("n", "m", F.when(F.col("n") > 1, F.col("m") / full).otherwise(0.0).alias("density"), F.when(F.col("n") > 1, F.coalesce(tree, F.lit(0.0))).otherwise(0.0).alias("tree_density"))


def degree_centrality(edges: DataFrame) -> DataFrame:
    """D8."""
    n = vertices(edges).agg(F.count("*").alias("n"))
    return degrees(edges).crossJoin(F.broadcast(n)).select("id", (F.col("deg") / (F.col("n") - 1)).alias("centrality"))


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85, every: int = 5) -> DataFrame:
    """(id, rank) after fixed rounds of the power iteration; lineage is cut every few rounds."""
    deg = cut(degrees(edges))
    n = deg.count()
    adj = cut(adjacency(edges).join(deg, "id").select("id", "nbr", "deg"))
    rank = deg.select("id", F.lit(1.0 / max(n, 1)).alias("rank"))
    for i in range(rounds):
        flow = adj.join(rank, "id").groupBy(F.col("nbr").alias("id")).agg(F.sum(F.col("rank") / F.col("deg")).alias("flow"))
        rank = flow.select("id", (F.lit((1 - damping) / max(n, 1)) + damping * F.col("flow")).alias("rank"))
        if (i + 1) % every == 0:
            rank = cut(rank)
    return rank


def neighbour_mean(edges: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """The mean of values(id, value) over each node's neighbours."""
    return adjacency(edges).join(values.select(F.col("id").alias("nbr"), "value"), "nbr").groupBy("id").agg(F.avg("value").alias(name))


def ego_edges(edges: DataFrame) -> DataFrame:
    """(id, ego_edges, ego_out): edges of the ego graph, and those that leave it (sum of degrees - 2 inside)."""
    own = local_clustering(edges).select("id", "deg", (F.col("deg") + F.col("tri")).alias("ego_edges"))
    around = adjacency(edges).join(degrees(edges).toDF("nbr", "nd"), "nbr").groupBy("id").agg(F.sum("nd").alias("around"))
    return own.join(around, "id").select("id", "ego_edges", (F.col("deg") + F.col("around") - 2 * F.col("ego_edges")).alias("ego_out"))


def ego_coverage(edges: DataFrame) -> DataFrame:
    """The share of nodes and edges in each ego graph."""
    size = density(edges).select("n", "m")
    own = local_clustering(edges).crossJoin(F.broadcast(size))
    return own.select("id", ((F.col("deg") + 1) / F.col("n")).alias("nodes"), ((F.col("deg") + F.col("tri")) / F.col("m")).alias("edges"))


def bfs_levels(edges: DataFrame, start: DataFrame, most: int | None = None) -> DataFrame:
    """(id, level): hops from start(id), level by level; each level is cut."""
    adj = cut(adjacency(edges))
    seen = cut(start.select("id", F.lit(0).alias("level")))
    level, edge = 0, seen
    while most is None or level < most:
        level += 1
        fresh = adj.join(edge.select("id"), "id", "left_semi").select(F.col("nbr").alias("id")).distinct().join(seen, "id", "left_anti")
        edge = cut(fresh.select("id", F.lit(level).alias("level")))
        if edge.isEmpty():
            break
        seen = cut(seen.union(edge))
    return seen


def _farthest_hops(shared):
    """(com, id, ecc, reached) of rows (com, low, high): hops from these nodes of a community to all that they reach.

    A node holds one bit for each root that has reached it; a level takes over the bits of the neighbours.
    """

    def run(batches):
        for batch in batches:
            for com, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, begin, near = shared.value[com]
                roots = np.arange(low, high)
                bits = np.zeros((len(ids), -(-len(roots) // 64)), dtype=np.uint64)
                bits[roots, (roots - low) // 64] = np.uint64(1) << ((roots - low) % 64).astype(np.uint64)
                ecc, reached, level = np.zeros(bits.shape[1] * 64, dtype=np.int64), np.zeros(bits.shape[1] * 64, dtype=np.int64), 0
                while True:
                    level += 1
                    fresh = np.bitwise_or.reduceat(bits[near], begin, axis=0)
                    fresh &= ~bits
                    told = np.unpackbits(np.bitwise_or.reduce(fresh, axis=0).view(np.uint8), bitorder="little").astype(bool)
                    if not told.any():
                        break
                    ecc[told] = level
                    bits |= fresh
                for i in range(0, len(ids), 4096):
                    reached += np.unpackbits(bits[i : i + 4096].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                yield pa.record_batch([pa.array([com] * len(roots), batch.column(0).type), pa.array(ids[low:high].tolist(), pa.string()), pa.array(ecc[: len(roots)]), pa.array(reached[: len(roots)])], names=["com", "id", "ecc", "reached"])

    return run


def _eccentricities_in_tables(adj: DataFrame, pairs: int) -> DataFrame:
    """The same for communities too large for a process: roots in turns, so that about ``pairs`` pairs of nodes are held at once."""
    nodes = cut(adj.select("com", "id").distinct())
    every = nodes.groupBy("com").agg(F.count("*").alias("n")).agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0
    turns, out = max(1, math.ceil(every / pairs)), None
    for i in range(turns):
        seen = cut(nodes.where(F.pmod(F.xxhash64("id"), F.lit(turns)) == i).select("com", F.col("id").alias("root"), "id", F.lit(0).alias("level")))
        edge, level = seen, 0
        while True:
            level += 1
            fresh = edge.select("com", "root", "id").join(adj, ["com", "id"]).select("com", "root", F.col("nbr").alias("id")).distinct()
            now = cut(fresh.join(seen, ["com", "root", "id"], "left_anti").withColumn("level", F.lit(level)))
            if edge is not seen:
                discard(edge)
            edge = now
            if edge.isEmpty():
                break
            before, seen = seen, cut(seen.union(edge))
            discard(before)
        own = cut(seen.groupBy("com", F.col("root").alias("id")).agg(F.max("level").cast("long").alias("ecc"), F.count("*").alias("reached")))
        discard(seen, edge)
        out = own if out is None else out.union(own)
    return out


def eccentricities(edges: DataFrame, within: DataFrame | None = None, max_edges: int = MAX_EDGES, pairs: int = 50_000_000) -> DataFrame:
    """(com, id, ecc, reached): greatest hop distance inside each community's graph, and the nodes it reaches.

    All nodes of all communities. Up to ``max_edges`` edges inside communities are broadcast as numbers and searched from blocks
    of roots; more are searched in tables.
    """
    com = vertices(edges).withColumn("com", F.lit(0)) if within is None else within
    own = cut(edges.join(com.toDF("src", "com"), "src").join(com.toDF("dst", "c2"), "dst").where("com = c2").select("com", "src", "dst"))
    if own.limit(max_edges + 1).count() > max_edges:
        return _eccentricities_in_tables(cut(own.select("com", F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("nbr")), F.struct(F.col("dst").alias("id"), F.col("src").alias("nbr")))).alias("e")).select("com", "e.*")), pairs)
    spark, kind = edges.sparkSession, dict(own.dtypes)["com"]
    got, graphs, blocks = own.toArrow().to_pandas(), {}, []
    for key, part in got.groupby("com", sort=False):
        n = len(part)
        at, ids = pd.factorize(np.concatenate([part["src"].to_numpy(), part["dst"].to_numpy()]))
        order = np.argsort(at, kind="stable")
        begin = np.searchsorted(at[order], np.arange(len(ids)))
        key = int(key) if isinstance(key, np.integer) else key
        graphs[key] = (ids, begin, np.concatenate([at[n:], at[:n]])[order].astype(np.int32))
        step = 64 * max(1, min(64, (1 << 22) // n))
        blocks += [(key, low, min(low + step, len(ids))) for low in range(0, len(ids), step)]
    shared = spark.sparkContext.broadcast(graphs)
    rows = spark.createDataFrame(blocks, f"com {kind}, low long, high long").repartition(max(1, min(len(blocks), 2000)), "com", "low")
    return cut(rows.mapInArrow(_farthest_hops(shared), f"com {kind}, id string, ecc long, reached long"))


def diameters(edges: DataFrame, within: DataFrame) -> DataFrame:
    """(com, diameter, centre) on each community's largest component; the least centre is used."""
    ecc = cut(eccentricities(edges, within))
    top = ecc.groupBy("com").agg(F.max("reached").alias("reached"))
    own = ecc.join(top, ["com", "reached"])
    return own.groupBy("com").agg(F.max("ecc").alias("diameter"), F.min(F.struct("ecc", "id")).alias("c")).select("com", "diameter", F.col("c.id").alias("centre"))


def dispersion(edges: DataFrame, hubs: DataFrame) -> DataFrame:
    """(id, nbr, dispersion): pairs of common neighbours of hub and neighbour that are neither linked nor share
    another neighbour inside the hub's ego, over the number of common neighbours."""
    adj = adjacency(edges)
    mine = adj.join(hubs.select("id"), "id", "left_semi")
    common = mine.join(adj.select(F.col("id").alias("nbr"), F.col("nbr").alias("w")), "nbr").join(mine.select("id", F.col("nbr").alias("w")), ["id", "w"]).select("id", "nbr", "w")
    pair = common.join(common.select("id", "nbr", F.col("w").alias("x")), ["id", "nbr"]).where("w < x")
    linked = adj.select(F.col("id").alias("w"), F.col("nbr").alias("x"))
    apart = pair.join(linked, ["w", "x"], "left_anti")
    inside = mine.select("id", F.col("nbr").alias("y"))
    via = apart.join(adj.select(F.col("id").alias("w"), F.col("nbr").alias("y")), "w").join(adj.select(F.col("id").alias("x"), F.col("nbr").alias("y")), ["x", "y"]).join(inside, ["id", "y"]).where("y <> nbr").select("id", "nbr", "w", "x").distinct()
    far = apart.join(via, ["id", "nbr", "w", "x"], "left_anti").groupBy("id", "nbr").agg(F.count("*").alias("far"))
    size = common.groupBy("id", "nbr").agg(F.count("*").alias("k"))
    return mine.join(size, ["id", "nbr"], "left").join(far, ["id", "nbr"], "left").select("id", "nbr", F.coalesce(F.col("far") / F.col("k"), F.lit(0.0)).alias("dispersion"))


def community_shares(edges: DataFrame, com: DataFrame) -> DataFrame:
    """(id, deg, outside, inside, border, diversity) against a partition(id, com)."""
    adj = adjacency(edges).join(com.toDF("id", "com"), "id").join(com.toDF("nbr", "nc"), "nbr")
    out = F.sum((F.col("com") != F.col("nc")).cast("int"))
    return adj.groupBy("id").agg(F.count("*").alias("deg"), (out / F.count("*")).alias("outside"), (1 - out / F.count("*")).alias("inside"), F.when(out > 0, 1).otherwise(0).alias("border"), (F.countDistinct("nc") / F.count("*")).alias("diversity"))


def boundary_score(edges: DataFrame, closed: DataFrame) -> DataFrame:
    """Of the edges at closed nodes with open neighbours, the number of distinct closed ends over the number of edges; 1
    without a boundary."""
    own = closed.select("id")
    marked = adjacency(edges).join(own, "id", "left_semi").join(own.select(F.col("id").alias("nbr"), F.lit(1).alias("in")), "nbr", "left")
    boundary = marked.where("in IS NULL").select("id").distinct()
    at = marked.join(boundary, "id", "left_semi")
    ends = at.where("in = 1").agg(F.countDistinct("nbr").alias("ends"))
    links = at.select(F.least("id", "nbr").alias("a"), F.greatest("id", "nbr").alias("b")).distinct().agg(F.count("*").alias("links"))
    return ends.crossJoin(links).select(F.expr("coalesce(try_divide(ends, links), 1.0)").alias("score"))


def boundary_sharpness(edges: DataFrame, closed: DataFrame, node: str = "") -> DataFrame:
    """Inner and outer edges of a closed set, and their ratio; of one of its nodes alone where ``node`` is given."""
    own = closed.select("id")
    adj = adjacency(edges)
    adj = (adj.where(F.col("id") == node) if node else adj).join(own, "id", "left_semi").join(own.select(F.col("id").alias("nbr"), F.lit(1).alias("in")), "nbr", "left")
    total = adj.agg((F.sum(F.coalesce("in", F.lit(0))) / (1 if node else 2)).alias("inner"), F.sum((F.col("in").isNull()).cast("int")).alias("outer"))
    return total.select(F.col("inner").cast("long").alias("inner"), F.col("outer"), F.expr("coalesce(try_divide(inner, outer), 1.0)").alias("local_r"))


def local_modularity(edges: DataFrame, com: DataFrame) -> DataFrame:
    """Per community, the share of its border nodes' edges that stay inside."""
    adj = adjacency(edges).join(com.toDF("id", "com"), "id").join(com.toDF("nbr", "nc"), "nbr").withColumn("inner", (F.col("com") == F.col("nc")).cast("int"))
    border = adj.where("inner = 0").select("id").distinct()
    return adj.join(border, "id", "left_semi").groupBy("com").agg(F.avg("inner").alias("local_modularity"))


def neighbour_score(edges: DataFrame, closed: DataFrame) -> DataFrame:
    """The mean over a node's neighbours of the closed share of the neighbour's neighbours."""
    adj = adjacency(edges).join(closed.select(F.col("id").alias("nbr"), F.lit(1).alias("c")), "nbr", "left")
    share = adj.groupBy("id").agg(F.avg(F.coalesce("c", F.lit(0))).alias("value"))
    return neighbour_mean(edges, share, "score")


def clustering_by_degree(edges: DataFrame) -> DataFrame:
    """D25."""
    return local_clustering(edges).groupBy("deg").agg(F.count("*").alias("n"), F.avg("cc").alias("mean"), F.stddev_pop("cc").alias("std"), F.var_pop("cc").alias("var"))


def degree_histogram(edges: DataFrame) -> DataFrame:
    """D26."""
    return degrees(edges).groupBy("deg").agg(F.count("*").alias("n"))


def clustering_histogram(edges: DataFrame, bins: int = 10) -> DataFrame:
    """D27."""
    return local_clustering(edges).groupBy(F.least(F.floor(F.col("cc") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def node_features(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """Degree, neighbour degree, cc, neighbour cc, ego edges, ego out-edges, centrality, PageRank."""
    cc = cut(local_clustering(edges))
    out = cc.select("id", "deg", "cc")
    for part in (neighbour_mean(edges, cc.select("id", F.col("deg").alias("value")), "nbr_deg"), neighbour_mean(edges, cc.select("id", F.col("cc").alias("value")), "nbr_cc"), ego_edges(edges), degree_centrality(edges), pagerank(edges, rounds)):
        out = out.join(part, "id")
    return out


def top_gap(edges: DataFrame, share: float = 0.01) -> DataFrame:
    """|int(degree) - int(mean neighbour degree)| of the top share by degree: mean and median, rounded to 2."""
    deg = degrees(edges)
    n = deg.count()
    top = deg.orderBy(F.desc("deg"), "id").limit(max(1, int(share * n)))
    near = neighbour_mean(edges, deg.select("id", F.col("deg").alias("value")), "nd")
    return top.join(near, "id").select(F.abs(F.col("deg").cast("int") - F.col("nd").cast("int")).alias("gap")).agg(F.round(F.avg("gap"), 2).alias("mean"), F.round(F.expr("percentile(gap, 0.5)"), 2).alias("median"))


def degree_ranks(edges: DataFrame) -> DataFrame:
    """Degrees with the number of nodes of greater degree (the plot's rank), from the histogram alone."""
    hist = degree_histogram(edges)
    return hist.select("deg", "n", (F.sum("n").over(Window.orderBy(F.desc("deg")).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("above"))

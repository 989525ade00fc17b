"""Graph preparation: adjacency, components, subgraphs, unions, boundaries, map and choice helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.cluster import cut
from netquarry.functions.choice import best, u


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, nbr): both directions of each edge."""
    return edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("nbr")), F.struct(F.col("dst").alias("id"), F.col("src").alias("nbr")))).alias("e")).select("e.id", "e.nbr")


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """D1."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("deg"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): least reachable id, by alternating large-star and small-star rounds."""
    links = cut(edges.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct())
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = state(links)
    while before[0]:
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("x"), F.col("m").alias("y")).distinct()
        down = large.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = cut(moved.union(lowest.select("a", F.col("m").alias("b"))).distinct())
        now = state(links)
        if now == before:
            break
        before = now
    roots = links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)


def giant_nodes(edges: DataFrame) -> DataFrame:
    """(id): the largest component; of equal ones that with the least id."""
    parts = cut(components(edges))
    top = best(parts.groupBy("component").agg(F.count("*").alias("n")), [F.desc("n"), F.asc("component")]).select("component")
    return parts.join(F.broadcast(top), "component", "left_semi").select("id")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in nodes(id)."""
    own = nodes.select("id").distinct()
    return edges.join(own.withColumnRenamed("id", "src"), "src", "left_semi").join(own.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


def giant_component(edges: DataFrame) -> DataFrame:
    """B1: the edges of the largest component."""
    return induced(edges, giant_nodes(edges))


def degree_filtered(edges: DataFrame, k: int = 1) -> DataFrame:
    """The subgraph of nodes with degree above k, in one pass (not a core)."""
    return induced(edges, degrees(edges).where(F.col("deg") > k))


def ego(edges: DataFrame, node: DataFrame) -> DataFrame:
    """The induced graph of node(id) and its neighbours."""
    around = adjacency(edges).join(node.select("id"), "id", "left_semi").select(F.col("nbr").alias("id"))
    return induced(edges, around.union(node.select("id")))


def compose(a: DataFrame, b: DataFrame) -> DataFrame:
    """B7."""
    return a.select("src", "dst").union(b.select("src", "dst")).distinct()


def common_nodes(layers: DataFrame) -> DataFrame:
    """Nodes that every layer has."""
    nodes = layers.select("layer", F.explode(F.array("src", "dst")).alias("id")).distinct()
    n = layers.agg(F.countDistinct("layer").alias("k"))
    return nodes.groupBy("id").agg(F.count("*").alias("k")).join(F.broadcast(n), "k", "left_semi").select("id")


def without_keys(scores: DataFrame, drop: DataFrame) -> DataFrame:
    """B9."""
    return scores.join(drop.select("id"), "id", "left_anti")


def merged(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, value) maps; the right side wins."""
    return left.withColumnRenamed("value", "l").join(right.withColumnRenamed("value", "r"), "id", "full_outer").select("id", F.coalesce("r", "l").alias("value"))


def split_zero(scores: DataFrame, below: float = 0.9) -> DataFrame:
    """(id, value, kind): zero, or not zero, and whether under the cut-off."""
    return scores.select("id", "value", F.when(F.col("value") == 0, "zero").otherwise("nonzero").alias("kind"), (F.col("value") < below).alias("low"))


def keys_of(scores: DataFrame, value: Column) -> DataFrame:
    """B12."""
    return scores.where(F.col("value") == value).select("id")


def pick_max(scores: DataFrame, seed: int = 1, step: int = 0) -> DataFrame:
    """The key of the greatest value; ties by hash, then id."""
    return best(scores.withColumn("u", u(seed, step, "id")), [F.desc("value"), F.asc("u"), F.asc("id")]).select("id", "value")


def pick_min(scores: DataFrame, seed: int = 1, step: int = 0) -> DataFrame:
    return best(scores.withColumn("u", u(seed, step, "id")), [F.asc("value"), F.asc("u"), F.asc("id")]).select("id", "value")


def boundary_nodes(edges: DataFrame, closed: DataFrame) -> DataFrame:
    """Closed nodes with a neighbour that is not closed."""
    adj = adjacency(edges).join(closed.select("id"), "id", "left_semi")
    return adj.join(closed.select(F.col("id").alias("nbr")), "nbr", "left_anti").select("id").distinct()


def boundaries(edges: DataFrame, closed: DataFrame) -> DataFrame:
    """The crossing edges (id inside, nbr outside)."""
    adj = adjacency(edges).join(closed.select("id"), "id", "left_semi")
    return adj.join(closed.select(F.col("id").alias("nbr")), "nbr", "left_anti").select("id", "nbr")


def connected_outside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Listed nodes with a neighbour off the list."""
    return boundary_nodes(edges, nodes)


def id_dictionary(rows: DataFrame) -> DataFrame:
    """(user, id): integers by first appearance of rows(row_no, src, dst); src of a row comes before its dst.

    Numbering is by range: each range of the sorted places counts its own, and a small table shifts the ranges.
    """
    each = rows.select("row_no", F.posexplode(F.array("src", "dst")).alias("side", "user"))
    first = each.groupBy("user").agg(F.min(F.struct("row_no", "side")).alias("at"))
    from pyspark.sql import Window

    block = first.withColumn("block", F.floor(F.col("at.row_no") / 100_000))
    size = block.groupBy("block").agg(F.count("*").alias("n"))
    shift = size.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("shift"))
    own = block.withColumn("k", F.row_number().over(Window.partitionBy("block").orderBy("at", "user")))
    return own.join(shift, "block").select("user", (F.col("k") + F.col("shift") - 1).alias("id"))

"""Simulated API access (C1-C9) and incomplete answers (H1-H6, H8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.functions.choice import share_of, u
from netquarry.operators.prep import adjacency, degrees

DEGREE_COST, CHEAP_COST = 0.1, 0.2


def neighbours(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, nbr, cost): all neighbours at cost 1 a query."""
    return adjacency(edges).join(asked.select("id"), "id", "left_semi").select("id", "nbr", F.lit(1.0).alias("cost"))


def neighbours_partial(edges: DataFrame, asked: DataFrame, limit: int, seed: int, query_no: int) -> DataFrame:
    """At most ``limit`` random neighbours a node (0: all), drawn anew for each query."""
    rows = neighbours(edges, asked)
    if not limit:
        return rows
    w = Window.partitionBy("id").orderBy(u(seed, query_no, F.concat_ws("-", "id", "nbr")), "nbr")
    return rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= limit).drop("k")


def neighbours_page(edges: DataFrame, asked: DataFrame, page: int, size: int, whole_first: bool = False) -> DataFrame:
    """Page ``page`` of the neighbours in id order, and whether it is the last; past the end: nothing.

    ``whole_first``: page 0 answers with the whole list.
    """
    w = Window.partitionBy("id")
    rows = neighbours(edges, asked).withColumn("k", F.row_number().over(w.orderBy("nbr")) - 1).withColumn("deg", F.count("*").over(w))
    pages = F.ceil(F.col("deg") / size)
    own = F.lit(True) if whole_first and page == 0 else F.floor(F.col("k") / size) == page
    return rows.where(own).select("id", "nbr", "cost", (pages - 1 <= page).alias("last"))


def degree_probe(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """C4: true degrees and the cost of asking for them."""
    return degrees(edges).join(asked.select("id"), "id", "left_semi").select("id", "deg", F.lit(DEGREE_COST).alias("cost"))


def random_node(edges: DataFrame, seed: int) -> DataFrame:
    """C5."""
    return degrees(edges).orderBy(u(seed, 0, "id"), "id").limit(1).select("id")


def random_high_degree(edges: DataFrame, seed: int, share: float = 0.3) -> DataFrame:
    """A random node among the top share by degree."""
    deg = degrees(edges)
    n = deg.count()
    return deg.orderBy(F.desc("deg"), "id").limit(max(1, share_of(share, n))).orderBy(u(seed, 0, "id"), "id").limit(1).select("id")


def random_in_largest(edges: DataFrame, com: DataFrame, seed: int, share: float = 0.5) -> DataFrame:
    """A random node among the top share by degree of the largest community of com(id, com); the least label wins ties."""
    largest = com.groupBy("com").count().orderBy(F.desc("count"), "com").limit(1).select("com")
    own = degrees(edges).join(com.join(F.broadcast(largest), "com", "left_semi"), "id").select("id", "deg")
    n = own.count()
    return own.orderBy(F.desc("deg"), "id").limit(max(1, share_of(share, n))).orderBy(u(seed, 0, "id"), "id").limit(1).select("id")


def layered_neighbours(layers: DataFrame, asked: DataFrame) -> DataFrame:
    """(layer, id, nbr, cost): layer 0 costs 1, others 0.2."""
    pairs = layers.select("layer", F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("nbr")), F.struct(F.col("dst").alias("id"), F.col("src").alias("nbr")))).alias("e")).select("layer", "e.*")
    return pairs.join(asked.select("id"), "id", "left_semi").select("layer", "id", "nbr", F.when(F.col("layer") == 0, 1.0).otherwise(CHEAP_COST).alias("cost"))


def recaptured_degree(marked: Column, returned: Column) -> Column:
    """H1: int(|marked| |returned| / |both|), 0 when nothing was recaptured."""
    both = F.size(F.array_intersect(marked, returned))
    return F.when(both > 0, F.floor(F.size(marked) * F.size(returned) / both)).otherwise(0).cast("int")


def selection_probability(true: Column, observed: Column, limit: int) -> Column:
    """H2."""
    return F.when(true == 0, 1.0).otherwise(F.least(F.lit(1.0), F.abs(true - observed) / limit))


def revisit_probability(p: Column, cost: Column, last_query: Column) -> Column:
    """H3."""
    return p * (cost - last_query) / cost


def closes(observed: Column, estimate: Column, last_page: Column) -> Column:
    """H4."""
    return (observed == estimate) | last_page


def next_page(page: Column, last_page: Column) -> Column:
    """H6."""
    return page + F.when(last_page, 0).otherwise(1)


def likely(scores: DataFrame, share: float = 0.7) -> DataFrame:
    """H8: the first share of scores(id, p) by probability."""
    n = scores.count()
    return scores.orderBy(F.desc("p"), "id").limit(share_of(share, n))

"""Ground-truth helpers (F8-F14) over edges, a partition(id, com) and the nodes seen so far (id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.functions.choice import best, u
from netquarry.operators.metrics import bfs_levels
from netquarry.operators.prep import adjacency

EXPAND_COST, DENSIFY_COST, GOOD_SHARE = 0.05, 0.01, 0.05


def remaining_gain(com: DataFrame, seen: DataFrame) -> DataFrame:
    """F8: unobserved members of each community over all nodes."""
    n = com.agg(F.count("*").alias("n"))
    left = com.join(seen.select("id"), "id", "left_anti").groupBy("com").agg(F.count("*").alias("left"))
    return com.select("com").distinct().join(left, "com", "left").crossJoin(F.broadcast(n)).select("com", (F.coalesce("left", F.lit(0)) / F.col("n")).alias("gain"))


def community_scores(gain: DataFrame, diameter: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """gain/diameter; with paths(com, path): 0.8 of that + 0.2/path, 0 without gain, 0.8 gain + 0.2 where undefined."""
    own = gain.join(diameter.select("com", "diameter"), "com")
    if paths is None:
        return own.select("com", F.expr("coalesce(try_divide(gain, diameter), 0.0)").alias("score"))
    own = own.join(paths, "com", "left")
    mixed = F.expr("0.8 * try_divide(gain, diameter) + 0.2 * try_divide(1, path)")
    return own.select("com", F.when(F.col("gain") == 0, 0.0).otherwise(F.coalesce(mixed, 0.8 * F.col("gain") + 0.2)).alias("score"))


def expansion(edges: DataFrame, candidates: DataFrame, target: DataFrame) -> DataFrame:
    """of candidates(id) that with least max(path - diameter/2, 0) to target(centre, diameter); the first of id order
    inside the radius ends the search; the cost counts the candidates looked at."""
    one = target.limit(1)
    levels = bfs_levels(edges, one.select(F.col("centre").alias("id")))
    near = candidates.select("id").join(levels, "id").crossJoin(F.broadcast(one)).select("id", F.greatest(F.col("level") - F.col("diameter") / 2, F.lit(0.0)).alias("far"))
    first = best(near, [F.asc("far"), F.asc("id")])
    looked = candidates.crossJoin(F.broadcast(first.select(F.col("id").alias("pick"), "far"))).where("far > 0 OR id <= pick").agg(F.count("*").alias("n"))
    return first.crossJoin(looked).select("id", "far", (F.col("n") * EXPAND_COST).alias("cost"))


def expansion_by_share(edges: DataFrame, com: DataFrame, seen: DataFrame, candidates: DataFrame, visits: DataFrame) -> DataFrame:
    """unobserved neighbours outside the own community, times the community's share, over its visits + 1."""
    adj = adjacency(edges).join(candidates.select("id"), "id", "left_semi").join(com.toDF("id", "com"), "id").join(com.toDF("nbr", "nc"), "nbr")
    out = adj.where("com <> nc").join(seen.select(F.col("id").alias("nbr")), "nbr", "left_anti").groupBy("id").agg(F.count("*").alias("out"))
    share = com.groupBy("com").agg(F.count("*").alias("members")).crossJoin(F.broadcast(com.agg(F.count("*").alias("n"))))
    own = candidates.select("id").join(com, "id").join(share, "com").join(out, "id", "left").join(visits, "com", "left")
    return own.select("id", (F.coalesce("out", F.lit(0)) * F.col("members") / F.col("n") / (F.coalesce("visits", F.lit(0)) + 1)).alias("score"))


def densification(edges: DataFrame, seen: DataFrame, candidates: DataFrame, seed: int = 1, step: int = 0) -> DataFrame:
    """the candidate with most unobserved neighbours, ties by hash; cost by the number of candidates."""
    new = adjacency(edges).join(candidates.select("id"), "id", "left_semi").join(seen.select(F.col("id").alias("nbr")), "nbr", "left_anti").groupBy("id").agg(F.count("*").alias("n_new"))
    own = candidates.select("id").join(new, "id", "left").select("id", F.coalesce("n_new", F.lit(0)).cast("long").alias("n_new"))
    size = candidates.agg((F.count("*") * DENSIFY_COST).alias("cost"))
    return best(own, [F.desc("n_new"), u(seed, step, "id"), F.asc("id")]).crossJoin(size)


def cluster_tests(com: DataFrame, seen: DataFrame, share: float = GOOD_SHARE) -> DataFrame:
    """(com, good, size_over_unobserved)."""
    n = com.agg(F.count("*").alias("n"))
    left = com.join(seen.select("id"), "id", "left_anti").groupBy("com").agg(F.count("*").alias("left"))
    own = com.groupBy("com").agg(F.count("*").alias("members")).join(left, "com", "left").crossJoin(F.broadcast(n))
    return own.select("com", (F.coalesce("left", F.lit(0)) / F.col("n") >= share).alias("good"), F.expr("try_divide(members, left)").alias("size_over_unobserved"))

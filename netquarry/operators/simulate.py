"""Simulation and generators."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.cluster import cut
from netquarry.functions.choice import u, u_py
from netquarry.operators.metrics import average_clustering
from netquarry.operators.prep import adjacency, vertices

BETA, GAMMA = 0.3, 0.1


def sir(edges: DataFrame, infected: DataFrame, rounds: int, seed: int = 1, beta: float = BETA, gamma: float = GAMMA) -> DataFrame:
    """(t, s, i, r, seen): synchronous infection per (infected, susceptible neighbour) pair, recovery per infected."""
    adj = cut(adjacency(edges))
    state = cut(vertices(edges).join(infected.select("id", F.lit("I").alias("state")), "id", "left").select("id", F.coalesce("state", F.lit("S")).alias("state")))
    log = None
    for t in range(rounds + 1):
        n = lambda s: F.count(F.when(F.col("state") == s, 1))  # noqa: B023, E731
        row = state.agg(F.lit(t).alias("t"), n("S").alias("s"), n("I").alias("i"), n("R").alias("r"), (n("I") + n("R")).alias("seen"))
        log = row if log is None else log.union(row)
        if t == rounds:
            break
        ill = state.where("state = 'I'").select("id")
        hit = adj.join(ill, "id").where(u(seed, 2 * t, F.concat_ws("-", "id", "nbr")) < beta).select(F.col("nbr").alias("id"), F.lit(True).alias("hit")).distinct()
        well = u(seed, 2 * t + 1, "id") < gamma
        state = cut(state.join(hit, "id", "left").select("id", F.when((F.col("state") == "S") & F.col("hit").isNotNull(), "I").when((F.col("state") == "I") & well, "R").otherwise(F.col("state")).alias("state")))
    return log


def random_graph(spark: SparkSession, n: int, p: float, seed: int = 1, blocks: int = 64) -> DataFrame:
    """G(n, p) by geometric skips: from each node, draw k skips to its k-th greater neighbour, so the work follows the links."""

    def run(batches):
        for batch in batches:
            src, dst = [], []
            for a in batch.column(0).to_pylist():
                b, k = a, 0
                while p > 0:
                    b += 1 + (0 if p >= 1 else math.floor(math.log(1 - u_py(seed, k, str(a))) / math.log(1 - p)))
                    if b >= n:
                        break
                    src.append(str(a))
                    dst.append(str(b))
                    k += 1
            yield pa.record_batch([pa.array(src, pa.string()), pa.array(dst, pa.string())], names=["src", "dst"])

    return spark.range(n, numPartitions=min(blocks, max(1, n))).mapInArrow(run, "src string, dst string")


def reduce_clustering(edges: DataFrame, com: DataFrame, target: float, share: float = 0.1, rounds: int = 5, seed: int = 1) -> DataFrame:
    """While the mean clustering is above target, each round pairs a hash-chosen tenth of every community's edges and
    swaps their ends: (a, b), (c, d) become (a, c), (b, d). Swaps that repeat an edge or make a loop are left out."""
    for r in range(rounds):
        if average_clustering(edges).first()[0] <= target:
            break
        own = edges.join(com.toDF("src", "com"), "src").join(com.toDF("dst", "c2"), "dst").where("com = c2").select("com", "src", "dst")
        chosen = own.where(u(seed, r, F.concat_ws("-", "src", "dst")) < share)
        # Partners meet by an order inside hash blocks of a community, so no task holds a whole one.
        from pyspark.sql import Window

        block = chosen.withColumn("block", F.expr("int(pmod(xxhash64(src, dst), 64))"))
        k = block.withColumn("k", F.row_number().over(Window.partitionBy("com", "block").orderBy(u(seed, r + 1000, F.concat_ws("-", "src", "dst")))) - 1)
        pair = k.where("k % 2 = 0").join(k.where("k % 2 = 1").select("com", "block", (F.col("k") - 1).alias("k"), F.col("src").alias("c"), F.col("dst").alias("d")), ["com", "block", "k"])
        pair = cut(pair.where("src <> c AND dst <> d"))
        fresh = pair.select(F.explode(F.array(F.struct(F.least("src", "c").alias("src"), F.greatest("src", "c").alias("dst")), F.struct(F.least("dst", "d").alias("src"), F.greatest("dst", "d").alias("dst")))).alias("e")).select("e.*").distinct()
        gone = pair.select("src", "dst").union(pair.select(F.col("c").alias("src"), F.col("d").alias("dst")))
        edges = cut(edges.join(gone, ["src", "dst"], "left_anti").union(fresh).distinct())
    return edges


def lfr_histograms(edges: DataFrame, com: DataFrame, bins: int = 20, top: float = 1.1) -> DataFrame:
    """(kind, bin, n): community sizes, and mixing (outside share) in equal bins on [0, top]."""
    adj = adjacency(edges).join(com.toDF("id", "com"), "id").join(com.toDF("nbr", "nc"), "nbr")
    mixing = adj.groupBy("id").agg(F.avg((F.col("com") != F.col("nc")).cast("int")).alias("mu"))
    a = mixing.groupBy(F.floor(F.round(F.col("mu") * bins / top, 9)).cast("long").alias("bin")).agg(F.count("*").alias("n")).select(F.lit("mixing").alias("kind"), "bin", "n")
    b = com.groupBy("com").agg(F.count("*").alias("bin")).groupBy("bin").agg(F.count("*").alias("n")).select(F.lit("size").alias("kind"), "bin", "n")
    return a.union(b)

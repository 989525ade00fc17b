"""Community detection (F1-F7) over weighted edges(src, dst, weight); a self-loop counts twice in a degree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netquarry.cluster import cut
from netquarry.functions.choice import u


def weighted(edges: DataFrame) -> DataFrame:
    return edges if "weight" in edges.columns else edges.withColumn("weight", F.lit(1.0))


def _ends(edges: DataFrame) -> DataFrame:
    """(id, nbr, weight): both directions; a self-loop appears twice."""
    e = weighted(edges)
    return e.select("src", "dst", "weight").union(e.select("dst", "src", "weight")).toDF("id", "nbr", "weight")


def modularity(edges: DataFrame, com: DataFrame) -> DataFrame:
    """sum over communities of inside/m - (degree/2m)^2; no edges is an error of the caller and gives null."""
    own = _ends(edges).join(com.toDF("id", "com"), "id").join(com.toDF("nbr", "nc"), "nbr")
    per = own.groupBy("com").agg(F.sum("weight").alias("degree"), F.sum(F.when(F.col("com") == F.col("nc"), F.col("weight")).otherwise(0.0)).alias("twice"))
    m2 = per.agg(F.sum("degree").alias("m2"))
    return per.crossJoin(F.broadcast(m2)).agg(F.sum(F.col("twice") / F.col("m2") - F.pow(F.col("degree") / F.col("m2"), 2)).alias("modularity"))


def induced_graph(edges: DataFrame, com: DataFrame) -> DataFrame:
    """communities as nodes, summed weights, inner edges as self-loops."""
    own = weighted(edges).join(com.toDF("src", "a"), "src").join(com.toDF("dst", "b"), "dst")
    return own.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("weight").alias("weight"))


def renumber(com: DataFrame) -> DataFrame:
    """dense numbers by order of label, over the table of labels."""
    names = com.select("com").distinct()
    return com.join(names.withColumn("k", F.row_number().over(Window.orderBy("com")) - 1), "com").select("id", F.col("k").alias("com"))


def sizes(com: DataFrame) -> DataFrame:
    """F7."""
    return com.groupBy("com").agg(F.count("*").alias("members"))


def one_level(edges: DataFrame, rounds: int = 12, least: float = 1e-7, seed: int = 0) -> tuple[DataFrame, float]:
    """(partition, modularity). In a round the nodes of one hash colour move at once to the community of greatest
    gain, if it is positive; a round that lowers the modularity is undone and ends the level."""
    ends = cut(_ends(edges).groupBy("id", "nbr").agg(F.sum("weight").alias("weight")))
    k = cut(ends.groupBy("id").agg(F.sum("weight").alias("k")))
    m2 = k.agg(F.sum("k")).first()[0] or 0.0
    com = cut(k.select("id", F.col("id").alias("com")))
    best, idle = modularity(edges, com).first()[0] if m2 else 0.0, 0
    for r in range(rounds if m2 else 0):
        degree = com.join(k, "id").groupBy("com").agg(F.sum("k").alias("total"))
        towards = ends.where("id <> nbr").join(com.toDF("nbr", "com"), "nbr").groupBy("id", "com").agg(F.sum("weight").alias("w"))
        own = com.join(k, "id").select("id", F.col("com").alias("old"), "k")
        options = towards.join(own, "id").union(own.select("id", F.col("old").alias("com"), F.lit(0.0).alias("w"), "old", "k"))
        options = options.groupBy("id", "com", "old", "k").agg(F.sum("w").alias("w")).join(degree, "com")
        rest = F.col("total") - F.when(F.col("com") == F.col("old"), F.col("k")).otherwise(0.0)
        gain = options.withColumn("gain", F.col("w") - rest * F.col("k") / m2)
        pick = gain.groupBy("id", "old").agg(F.max(F.struct("gain", (F.col("com") == F.col("old")).alias("stay"), "com")).alias("b"))
        colour = u(seed, r, "id") < 0.5
        fresh = cut(pick.select("id", F.when(colour, F.col("b.com")).otherwise(F.col("old")).alias("com")))
        now = modularity(edges, fresh).first()[0]
        if now - best < least:
            idle += 1
            if idle > 1:
                break
            continue
        com, best, idle = fresh, now, 0
    return com, best or 0.0


def louvain(edges: DataFrame, levels: int = 8, least: float = 1e-7) -> DataFrame:
    """(level, id, com) of every node of the first graph, finest level first."""
    graph, out, member, before = cut(weighted(edges)), None, None, -1.0
    for level in range(levels):
        com, now = one_level(graph, seed=level)
        member = com if member is None else cut(member.withColumnRenamed("com", "c").join(com.withColumnRenamed("id", "c"), "c").select("id", "com"))
        if level and now - before < least:
            break
        rows = member.select(F.lit(level).alias("level"), "id", "com")
        out, before = rows if out is None else out.union(rows), now
        graph = cut(induced_graph(graph, com))
    return out


def best_partition(dendrogram: DataFrame, level: int | None = None) -> DataFrame:
    """the partition of a level, the coarsest by default."""
    top = dendrogram.agg(F.max("level").alias("level")) if level is None else dendrogram.sparkSession.createDataFrame([(level,)], "level int")
    return dendrogram.join(F.broadcast(top), "level", "left_semi").select("id", "com")

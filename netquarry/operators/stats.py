"""Statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.cluster import cut

def correlation(df: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """Pearson correlation of every pair of columns, by group: (x, y, r)."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    own = df.groupBy(*by).agg(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.corr(a, b).alias("r")) for a, b in pairs]).alias("all"))
    return own.select(*by, F.explode("all").alias("p")).select(*by, "p.x", "p.y", "p.r")


def kendall_top(scores: DataFrame, share: float = 0.1) -> DataFrame:
    """Tau-b of scores(id, x, y) over the first int(share * n) + 1 rows by x; rows with nulls are no part of a pair.

    Two ranks of y differ first at one bit. Rows that agree above it meet in one window, where those with the bit count those
    without it on either side of their x: a row for each bit, not for each pair.
    """
    n = scores.count()
    top = cut(scores.orderBy(F.desc("x"), "id").limit(int(share * n) + 1).where("x IS NOT NULL AND y IS NOT NULL").select("x", "y"))
    rank = top.groupBy("y").agg(F.count("*").alias("same")).select("y", "same", (F.row_number().over(Window.orderBy("y")) - 1).alias("r"))
    levels = F.transform(F.sequence(F.lit(0), F.lit(max(1, n.bit_length()))), lambda b: F.struct(b.alias("level"), F.floor(F.col("r") / F.pow(F.lit(2.0), b + 1)).cast("long").alias("above"), (F.floor(F.col("r") / F.pow(F.lit(2.0), b)) % 2).cast("int").alias("bit")))
    rows = top.join(rank, "y").select("x", F.explode(levels).alias("l")).groupBy("l.level", "l.above", "x").agg(F.sum(1 - F.col("l.bit")).alias("zeros"), F.sum("l.bit").alias("ones"))
    group = Window.partitionBy("level", "above")
    upto = F.sum("zeros").over(group.orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    sides = rows.select("ones", (upto - F.col("zeros")).alias("less"), (F.sum("zeros").over(group) - upto).alias("more"))
    pairs = lambda c: F.coalesce(F.sum(F.col(c) * (F.col(c) - 1)), F.lit(0)) / 2
    ties = top.groupBy("x").agg(F.count("*").alias("same")).agg(pairs("same").alias("tx")).crossJoin(F.broadcast(rank.agg(pairs("same").alias("ty"), F.coalesce(F.sum("same"), F.lit(0)).alias("k"))))
    s = sides.agg(F.coalesce(F.sum(F.col("ones") * (F.col("less") - F.col("more"))), F.lit(0)).alias("c")).crossJoin(F.broadcast(ties)).withColumn("every", F.expr("k * (k - 1) / 2"))
    return s.select(F.expr("coalesce(try_divide(c, sqrt(every - tx) * sqrt(every - ty)), 0.0)").alias("tau"))


def _ks_p(d: Column, na: Column, nb: Column) -> Column:
    """The asymptotic series of the two-sample test."""
    size = F.sqrt(na * nb / (na + nb))
    lam = (size + 0.12 + 0.11 / size) * d
    series = sum(((-1) ** (k - 1)) * F.exp(-2.0 * k * k * lam * lam) for k in range(1, 101))
    return F.when(lam < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * series)))


def ks_two_sample(a: DataFrame, b: DataFrame) -> DataFrame:
    """(d, p) of value columns; cumulative counts run over the distinct values, p is the asymptotic series."""
    both = a.select("value", F.lit(1).alias("na"), F.lit(0).alias("nb")).union(b.select("value", F.lit(0), F.lit(1)))
    steps = both.groupBy("value").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    total = steps.agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
    run = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    cdf = steps.select(F.sum("na").over(run).alias("ca"), F.sum("nb").over(run).alias("cb")).crossJoin(F.broadcast(total))
    d = cdf.agg(F.max(F.abs(F.col("ca") / F.col("ta") - F.col("cb") / F.col("tb"))).alias("d"), F.first("ta").alias("ta"), F.first("tb").alias("tb"))
    return d.select("d", _ks_p(F.col("d"), F.col("ta"), F.col("tb")).alias("p"))


def ks_by_group(samples: DataFrame, whole: DataFrame, keys: list[str], shared: list[str]) -> DataFrame:
    """E3 for many samples(*keys, value) against whole(*shared, value), where ``shared`` are some of the keys."""
    own = samples.groupBy(*keys, "value").agg(F.count("*").alias("na"))
    rest = whole.groupBy(*shared, "value").agg(F.count("*").alias("nb"))
    groups = samples.select(*keys).distinct()
    rest = groups.join(rest, shared) if shared else groups.crossJoin(F.broadcast(rest))  # distinct values, not rows
    steps = own.select(*keys, "value", "na", F.lit(0).cast("long").alias("nb")).union(rest.select(*keys, "value", F.lit(0).cast("long"), "nb")).groupBy(*keys, "value").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    every = Window.partitionBy(*keys)
    run = every.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    cdf = steps.select(*keys, F.sum("na").over(run).alias("ca"), F.sum("nb").over(run).alias("cb"), F.sum("na").over(every).alias("ta"), F.sum("nb").over(every).alias("tb"))
    d = cdf.groupBy(*keys).agg(F.max(F.abs(F.col("ca") / F.col("ta") - F.col("cb") / F.col("tb"))).alias("d"), F.first("ta").alias("ta"), F.first("tb").alias("tb"))
    return d.select(*keys, "d", _ks_p(F.col("d"), F.col("ta"), F.col("tb")).alias("p"))


def percentile_of(scores: DataFrame, values: DataFrame) -> DataFrame:
    """Percentile rank (mean of strict and weak counts) of scores(id, x) among values(value)."""
    hist = values.groupBy("value").agg(F.count("*").alias("n"))
    points = scores.groupBy(F.col("x").alias("value")).agg(F.lit(0).cast("long").alias("n"))
    steps = hist.union(points).groupBy("value").agg(F.sum("n").alias("n"))
    run = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranks = steps.withColumn("r", F.sum("n").over(run)).withColumn("l", F.col("r") - F.col("n")).select("value", "l", "r")
    n = hist.agg(F.sum("n").alias("total"))
    own = scores.join(ranks, F.col("x") == F.col("value")).crossJoin(F.broadcast(n))
    return own.select("id", ((F.col("l") + F.col("r") + (F.col("r") > F.col("l")).cast("int")) * 50.0 / F.col("total")).alias("percentile"))


def precision_recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """E5: of node sets (id)."""
    both = found.select("id", F.lit(1).alias("f")).distinct().join(truth.select("id", F.lit(1).alias("t")).distinct(), "id", "full_outer")
    s = both.agg(F.count("f").alias("nf"), F.count("t").alias("nt"), F.count(F.when(F.col("f").isNotNull() & F.col("t").isNotNull(), 1)).alias("hit"))
    s = s.select(F.expr("coalesce(try_divide(hit, nf), 0.0)").alias("precision"), F.expr("coalesce(try_divide(hit, nt), 0.0)").alias("recall"))
    return s.withColumn("f1", F.expr("coalesce(try_divide(2 * precision * recall, precision + recall), 0.0)"))


def overlap_scores(a: DataFrame, b: DataFrame, closed: DataFrame) -> DataFrame:
    """|a and b|/|b|, |a and b|/|a|, closed share of b, share of the closed nodes that b holds."""
    flag = lambda d, n: d.select("id", F.lit(1).alias(n)).distinct()
    all_ = flag(a, "a").join(flag(b, "b"), "id", "full_outer").join(flag(closed, "c"), "id", "full_outer")
    n = lambda *c: F.count(F.when(_all(c), 1))
    s = all_.agg(n("a").alias("na"), n("b").alias("nb"), n("c").alias("nc"), n("a", "b").alias("ab"), n("b", "c").alias("bc"))
    d = lambda x, y: F.expr(f"coalesce(try_divide({x}, {y}), 0.0)")
    return s.select(d("ab", "nb").alias("s1"), d("ab", "na").alias("s2"), d("bc", "nb").alias("s3"), d("bc", "nc").alias("s4"))


def _all(columns: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out


def summary(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Mean and population deviation by group."""
    return df.groupBy(*by).agg(*[f(F.col(v)).alias(f"{n}_{v}") for v in values for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def histogram(df: DataFrame, column: str, width: float = 1.0, log: bool = False) -> DataFrame:
    """Counts in bins of a fixed width, or of a fixed width in log10."""
    x = F.log10(F.col(column)) if log else F.col(column)
    return df.groupBy(F.floor(x / width).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.avg(column).alias("mean"))


def harmonic_mean_degree(degrees: DataFrame, c: float = 0.0) -> DataFrame:
    """Sum d/(d+c) over sum 1/(d+c)."""
    d = F.col("deg")
    return degrees.agg((F.sum(d / (d + c)) / F.sum(1.0 / (d + c))).alias("estimate"))


def excess_rank(scores: DataFrame) -> DataFrame:
    """(id, rank): mean 0-based descending rank among equal values, over the number of candidates."""
    hist = scores.groupBy("value").agg(F.count("*").alias("n"))
    run = Window.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0)
    ranks = hist.withColumn("last", F.sum("n").over(run)).select("value", (F.col("last") - F.col("n") + (F.col("n") - 1) / 2).alias("mean_rank"))
    total = hist.agg(F.sum("n").alias("total"))
    return scores.join(ranks, "value").crossJoin(F.broadcast(total)).select("id", (F.col("mean_rank") / F.col("total")).alias("rank"))


def kolmogorov_p(d: float, na: int, nb: int) -> float:
    """The series of ``ks_two_sample`` in plain Python, for grouped executors."""
    size = math.sqrt(na * nb / (na + nb))
    lam = (size + 0.12 + 0.11 / size) * d
    return 1.0 if lam < 0.2 else max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101))))

"""Learning (K1-K3): border classifier, logistic table classifier, sub-community search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netquarry.cluster import cut
from netquarry.functions.choice import u
from netquarry.operators import community, metrics

FEATURES = ("deg", "nbr_deg", "cc", "nbr_cc", "ego_edges", "ego_out", "centrality", "rank")
#: Rows of a block of training rows and of one of test rows, as they meet in a task.
TRAIN_ROWS, TEST_ROWS = 20_000, 4_000


def min_max(df: DataFrame, columns: tuple[str, ...] = FEATURES, fit: DataFrame | None = None) -> DataFrame:
    """Columns scaled to [0, 1] by the bounds of ``fit``; constant ones are 0."""
    lim = (df if fit is None else fit).agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    own = df.crossJoin(F.broadcast(lim))
    scaled = [F.coalesce(F.expr(f"try_divide({c} - lo_{c}, hi_{c} - lo_{c})"), F.lit(0.0)).alias(c) for c in columns]
    return own.select(*[c for c in df.columns if c not in columns], *scaled)


def split(df: DataFrame, label: str, seed: int, shuffle: int, test: float = 0.7) -> DataFrame:
    """A stratified split: column ``test`` by hash rank inside each label."""
    w = Window.partitionBy(label)
    share = (F.row_number().over(w.orderBy(u(seed, shuffle, "id"), "id"))) / F.count("*").over(w)
    return df.withColumn("test", share <= test)


def _nearest(k: int, columns: int):
    """Of rows (y, points of test rows, points of training rows), the k training rows nearest to each test row, by distance and id."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                test, train = (batch.column(c)[row].values for c in ("test", "train"))
                value = lambda t, i: t.field(i).to_numpy(zero_copy_only=False)
                x = [[value(t, i) for i in range(columns)] for t in (test, train)]
                order = np.argsort(train.field(columns).to_numpy(zero_copy_only=False).astype(str), kind="stable")
                ids, y = train.field(columns).take(pa.array(order)), value(train, columns + 1)[order]
                x[1] = [c[order] for c in x[1]]
                at, n = [], min(k, len(order))
                step = max(1, (1 << 21) // max(1, len(order)))
                far = []
                for low in range(0, len(test), step):
                    d = np.zeros((min(step, len(test) - low), len(order)))
                    for a, b in zip(*x, strict=True):  # column by column: the sum's order is fixed
                        c = a[low : low + step, None] - b[None, :]
                        c *= c
                        d += c
                    bound = np.partition(d, n - 1, axis=1)[:, n - 1]
                    for r, own in enumerate(d):
                        near = np.flatnonzero(own <= bound[r])  # in order of ids
                        near = near[np.argsort(own[near], kind="stable")[:n]]
                        at.append(near)
                        far.append(own[near])
                at, far = np.concatenate(at), np.concatenate(far)
                owner = pa.array(np.repeat(np.arange(len(test)), n))
                yield pa.record_batch([test.field(columns).take(owner), test.field(columns + 1).take(owner), pa.array(far), ids.take(pa.array(at)), pa.array(y[at])], names=["id", "label", "d", "other", "y"])

    return run


def nearest_vote(train: DataFrame, test: DataFrame, label: str, k: int = 5, columns: tuple[str, ...] = FEATURES, rows: int = TRAIN_ROWS) -> DataFrame:
    """K1: (id, label, score): the mean label of the k nearest training rows; equal distances go by id.

    All training rows are compared, in blocks of about ``rows``: every block of test rows meets every block of training rows,
    whose nearest are merged. No side is broadcast or held whole in a process.
    """
    whole = lambda name: [*[F.col(c).cast("double").alias(c) for c in columns], F.col("id").cast("string").alias("id"), F.col(label).cast("double").alias(name)]

    def blocks(df: DataFrame, size: int, name: str) -> DataFrame:
        n = -(-df.count() // size)
        own = df.select(F.struct(*whole(name)).alias("t"), F.pmod(F.xxhash64("id"), F.lit(max(n, 1))).alias("block"))
        return own.groupBy("block").agg(F.collect_list("t").alias(name))

    tests, trained = cut(blocks(test, TEST_ROWS, "test")), cut(blocks(train, rows, "train"))
    pairs = tests.select("block", "test").crossJoin(trained.select(F.col("block").alias("other"), "train"))
    pairs = pairs.repartition(max(1, tests.count() * trained.count()), "block", "other").select("test", "train")
    found = pairs.mapInArrow(_nearest(k, len(columns)), "id string, label double, d double, other string, y double")
    near = found.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("d", "other"))).where(F.col("k") <= k)
    return near.groupBy("id").agg(F.first("label").cast(dict(test.dtypes)[label]).alias("label"), (F.sum("y") / F.count("*")).alias("score"))


def quality(scored: DataFrame, *by: str, threshold: float = 0.5) -> DataFrame:
    """Accuracy, AUC (by rank sums) and F1 of (label, score)."""
    hist = scored.groupBy(*by, "score").agg(F.sum((F.col("label") == 1).cast("long")).alias("p"), F.sum((F.col("label") == 0).cast("long")).alias("n"))
    w = Window.partitionBy(*by).orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    cum = hist.withColumn("below", F.sum("n").over(w) - F.col("n"))
    hit = F.col("score") >= threshold
    s = cum.groupBy(*by).agg(F.sum("p").alias("np"), F.sum("n").alias("nn"), F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("area"), F.sum(F.when(hit, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("fp"))
    d = lambda a, b: F.expr(f"coalesce(try_divide({a}, {b}), 0.0)")
    return s.select(*by, d("tp + nn - fp", "np + nn").alias("accuracy"), d("area", "np * nn").alias("auc"), d("2.0 * tp", "np + tp + fp").alias("f1"))


def border_knn(features: DataFrame, labels: DataFrame, shuffles: int = 10, seed: int = 1) -> DataFrame:
    """K1: (shuffle, accuracy, auc, f1): scaling and neighbours from the training part only."""
    own, out = features.join(labels, "id"), None
    for i in range(shuffles):
        parts = split(own, "border", seed, i)
        train = parts.where("NOT test").drop("test")
        scaled = nearest_vote(min_max(train), min_max(parts.where("test").drop("test"), fit=train), "border").withColumn("shuffle", F.lit(i))
        out = scaled if out is None else out.union(scaled)
    return quality(out, "shuffle")


def logistic(train: DataFrame, test: DataFrame, label: str, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """K2: (id, label, score) by logistic regression."""
    put = VectorAssembler(inputCols=list(columns), outputCol="x", handleInvalid="keep")
    model = LogisticRegression(featuresCol="x", labelCol=label, maxIter=50, regParam=0.01).fit(put.transform(train))
    return model.transform(put.transform(test)).select("id", F.col(label).alias("label"), vector_to_array("probability")[1].alias("score"))


def sub_communities(sample: DataFrame, truth: DataFrame, closed: DataFrame) -> DataFrame:
    """K3: (com, s1..s4, density, rank_score): communities of a sample graph against a true one, ranked by density times size."""
    com = community.best_partition(community.louvain(sample))
    n = com.count()
    size = com.groupBy("com").agg(F.count("*").alias("members"))
    t, c = truth.select("id", F.lit(1).alias("t")), closed.select("id", F.lit(1).alias("c"))
    hit = com.join(t, "id", "left").join(c, "id", "left").groupBy("com").agg(F.count("t").alias("hit"), F.count("c").alias("shut"))
    inner = sample.join(com.toDF("src", "com"), "src").join(com.toDF("dst", "c2"), "dst").where("com = c2").groupBy("com").agg(F.count("*").alias("m"))
    totals = truth.agg(F.count("*").alias("nt")).crossJoin(closed.agg(F.count("*").alias("nc")))
    own = size.join(hit, "com").join(inner, "com", "left").crossJoin(F.broadcast(totals))
    d = lambda a, b: F.expr(f"coalesce(try_divide({a}, {b}), 0.0)")
    out = own.select("com", "members", d("hit", "members").alias("s1"), d("hit", "nt").alias("s2"), d("shut", "members").alias("s3"), d("shut", "nc").alias("s4"), d("2.0 * m", "members * (members - 1)").alias("density"))
    return out.withColumn("rank_score", F.col("density") * F.col("members") / n)


def scaled_features(edges: DataFrame) -> DataFrame:
    return min_max(metrics.node_features(edges))

"""Graphs derived from the relational tables: canonical undirected edges (src < dst as strings)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LAYERS = ("purchase", "click", "error", "signup", "view")  # layer 0 is the expensive one


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def canonical(df: DataFrame, a: Column | str = "src", b: Column | str = "dst", *keep: str) -> DataFrame:
    """Distinct edges with src < dst; self-loops go."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    a, b = a.cast("string"), b.cast("string")
    return df.where(a != b).select(*keep, F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).distinct()


def consecutive(events: DataFrame) -> DataFrame:
    """(event_type, a, b, event_id): users of consecutive events of a type, by (ts, event_id).

    The order is global, but no task sorts a whole type: rows are ordered inside (type, day), and each day's last row
    meets the first row of the type's next day in a table of one row per type and day.
    """
    rows = events.select("event_type", F.date_trunc("day", "ts").alias("day"), "ts", "event_id", F.col("user_id").alias("a"))
    inside = rows.withColumn("b", F.lead("a").over(Window.partitionBy("event_type", "day").orderBy("ts", "event_id")))
    days = rows.groupBy("event_type", "day").agg(F.min(F.struct("ts", "event_id", "a")).alias("first"))
    following = days.select("event_type", "day", F.lead("first").over(Window.partitionBy("event_type").orderBy("day"))["a"].alias("following"))
    return inside.join(following, ["event_type", "day"], "left").select("event_type", "a", F.coalesce("b", "following").alias("b"), "event_id").where("b IS NOT NULL")


def event_graph(spark: SparkSession, sf_dir: str, kind: str = "purchase") -> DataFrame:
    """The default graph: users of consecutive purchases."""
    events = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return canonical(consecutive(events), "a", "b")


def sparse_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of the default graph whose first event's id is divisible by 17: several components."""
    events = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return canonical(consecutive(events).where("event_id % 17 = 0"), "a", "b")


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(layer, src, dst): one layer for each event type."""
    number = F.create_map(*[F.lit(x) for i, k in enumerate(LAYERS) for x in (k, i)])
    pairs = consecutive(table(spark, sf_dir, "events")).withColumn("layer", number[F.col("event_type")])
    return canonical(pairs.where("layer IS NOT NULL"), "a", "b", "layer")


def part_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("P"), "l_partkey").alias("p"), F.concat(F.lit("S"), "l_suppkey").alias("s"))
    return canonical(items, "p", "s")


def tripartite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer-part, customer-supplier and part-supplier edges of each line item."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    items = items.select(F.concat(F.lit("C"), "o_custkey").alias("c"), F.concat(F.lit("P"), "l_partkey").alias("p"), F.concat(F.lit("S"), "l_suppkey").alias("s")).distinct()
    sides = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("c", "p"), ("c", "s"), ("p", "s"))])
    return canonical(items.select(F.explode(sides).alias("e")), F.col("e.x"), F.col("e.y"))


def stand_in_partition(nodes: DataFrame) -> DataFrame:
    """(id, com): a fixed partition of the default graph's users."""
    return nodes.select("id", (F.col("id").cast("long") % 5).cast("int").alias("com"))

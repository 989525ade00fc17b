"""Result sinks: column-wise CSV, curves, edge lists, reports, cached partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def append_csv(df: DataFrame, path: str) -> None:
    """Rows with a header; files are added to the folder."""
    df.write.mode("append").option("header", True).csv(path)


def curve_lines(curve: DataFrame, digits: int = 4) -> DataFrame:
    """Two lines per type, costs and values, rounded: `type_Cost, ...` and `type, ...`."""
    own = curve.groupBy("type").agg(F.array_sort(F.collect_list(F.struct("cost", "value"))).alias("c"))
    text = lambda f: F.concat_ws(", ", F.transform("c", lambda x: F.round(x[f].cast("double"), digits).cast("string")))
    cost = own.select(F.concat("type", F.lit("_Cost, "), text("cost")).alias("value"), "type", F.lit(0).alias("o"))
    return cost.union(own.select(F.concat("type", F.lit(", "), text("value")), "type", F.lit(1))).orderBy("type", "o").select("value")


def edge_list(edges: DataFrame, path: str) -> None:
    """One `src dst` line per edge."""
    edges.select(F.concat_ws(" ", "src", "dst").alias("value")).write.mode("overwrite").text(path)


def report(df: DataFrame, path: str) -> None:
    """Space separated with a header."""
    df.write.mode("overwrite").option("header", True).option("sep", " ").csv(path)


def cached(spark: SparkSession, path: str, compute) -> DataFrame:
    """The stored table if it exists, else computed and stored."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        compute().write.mode("ignore").parquet(path)
        return spark.read.parquet(path)

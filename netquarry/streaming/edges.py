"""Edges from an event stream: windowed degree counts and edge weights with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_degrees(stream: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, id, n): how many edge events each node has in a tumbling window of stream(ts, src, dst).

    An event counts once at either end; events later than ``late`` are dropped with their window's state.
    """
    ends = stream.where("src <> dst").withWatermark("ts", late).select("ts", F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy(F.window("ts", size).alias("w"), "id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "id", "n")


def edge_weights(stream: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, src, dst, weight): repeats of each canonical edge in a tumbling window."""
    own = stream.where("src <> dst").withWatermark("ts", late).select("ts", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return own.groupBy(F.window("ts", size).alias("w"), "src", "dst").agg(F.count("*").alias("weight")).select(F.col("w.start").alias("start"), "src", "dst", "weight")

"""Session helpers shared by the corpus operators: tables, checkpoints, row identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.cluster import cut, discard, replaced, ship  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``: the fold of a row."""
    return F.crc32(column.cast("string")) % F.lit(modulus)

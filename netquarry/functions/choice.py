"""Deterministic choice: every random draw is a hash of (seed, step, key), equal in Spark, Python and SQL."""

from __future__ import annotations

import hashlib
import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def u(seed: int, step: Column | int, key: Column | str) -> Column:
    """Uniform in [0, 1): the first 8 hex digits of md5(seed:step:key) over 2^32."""
    step = F.lit(step) if isinstance(step, int) else step
    key = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), step.cast("string"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def u_py(seed: int, step: int, key: str) -> float:
    return int(hashlib.md5(f"{seed}:{step}:{key}".encode()).hexdigest()[:8], 16) / 4294967296.0


def u_sql(seed: int, step: int | str, key: str) -> str:
    """The same in DuckDB SQL; ``step`` and ``key`` are SQL expressions."""
    return f"(CAST(('0x' || substr(md5('{seed}:' || {step} || ':' || {key}), 1, 8)) AS BIGINT) / 4294967296.0)"


def share_of(share: float, n: int) -> int:
    """floor(share * n) with the share as it is written: 0.7 of 90,000 is 63,000, where doubles give 62,999."""
    return math.floor(Decimal(str(share)) * n)


def best(df: DataFrame, by: list[Column], *parts: str) -> DataFrame:
    """The first row of each group by ``by``; of the whole table without groups (a partial top-1, no full sort)."""
    if not parts:
        return df.orderBy(*by).limit(1)
    w = Window.partitionBy(*parts).orderBy(*by)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")

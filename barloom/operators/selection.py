"""Top-k helpers (I-04, I-05)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows per key; the rank filter becomes a group limit below the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def top_bottom(df: DataFrame, keys: Sequence[str], value: str, tie: str, k: int) -> DataFrame:
    """I-05: the k largest and k smallest rows per key."""
    top = top_per_group(df, keys, [F.desc(value), F.asc(tie)], k).withColumn("side", F.lit("top"))
    bottom = top_per_group(df, keys, [F.asc(value), F.asc(tie)], k).withColumn("side", F.lit("bottom"))
    return top.unionByName(bottom)

"""Sliding sums and candidate masks over (example, position, value) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sliding_sum(df: DataFrame, width: int, example: str = "example", pos: str = "pos", value: str = "value", out: str = "total") -> DataFrame:
    """example, pos (first of the window) and the sum of each full window of ``width`` positions.

    Each window is added up by itself, from its first position on: a difference of running sums is off by their rounding, so
    that windows which sum to 0 or to a threshold would fall on either side of it. Windows of nulls alone are null. One shuffle
    by example.
    """
    order = Window.partitionBy(example).orderBy(pos)
    frame = order.rowsBetween(0, width - 1)
    sums = df.select(example, pos, F.sum(value).over(frame).alias(out), F.count("*").over(frame).alias("_n"))
    return sums.where(F.col("_n") == width).drop("_n")


def candidates(df: DataFrame, high: float, low: float, flank: int, example: str = "example", pos: str = "pos", value: str = "total") -> DataFrame:
    """Windows at or beyond a threshold with their magnitude, without those within ``flank`` of the example's ends.

    ``flank`` must be positive: zero would blank every window.
    """
    if flank < 1:
        raise ValueError("flank must be at least 1")
    last = F.max(pos).over(Window.partitionBy(example))
    marked = df.withColumn("_last", last).where(((F.col(value) >= high) | (F.col(value) <= low)) & F.col(pos).between(flank, F.col("_last") - flank))
    return marked.select(example, pos, F.abs(value).alias("score"))

"""Coordinates of seqlets: sign, order, strand-aware trims, text forms and slices of tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmotif.functions import vec


def split_by_sign(df: DataFrame, core: str, threshold: float) -> DataFrame:
    """``df`` with sign "pos" or "neg"; rows whose core contribution is within the threshold go."""
    sign = F.when(F.col(core) > threshold, "pos").when(F.col(core) < -threshold, "neg")
    return df.withColumn("sign", sign).where(F.col("sign").isNotNull())


def first_of_each_sign(df: DataFrame, limit: int, *order: str) -> DataFrame:
    """At most ``limit`` rows of a sign, in order of extraction, numbered from 1 as ord."""
    rank = F.row_number().over(Window.partitionBy("sign").orderBy(*order))
    return df.withColumn("ord", rank.cast("long")).where(F.col("ord") <= limit)


def large_enough(df: DataFrame, more_than: int = 100) -> DataFrame:
    """Rows of the signs that have more than so many rows; exactly as many is too few."""
    counts = df.groupBy("sign").agg(F.count("*").alias("_n")).where(F.col("_n") > more_than).select("sign")
    return df.join(F.broadcast(counts), "sign", "left_semi")


def distinct(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key. Strand is no part of a seqlet's identity."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_k = 1").drop("_k")


def trimmed(start: str, end: str, rc: str, first: int, last: int) -> tuple[Column, Column]:
    """Coordinates of positions [first, last) of a seqlet, which count from its end where it is reversed."""
    return F.when(F.col(rc), F.col(end) - last).otherwise(F.col(start) + first), F.when(F.col(rc), F.col(end) - first).otherwise(F.col(start) + last)


def expanded(start: str, end: str, rc: str, left: Column | int, right: Column | int) -> tuple[Column, Column]:
    """Coordinates with flanks added on the pattern's left and right."""
    l, r = (x if isinstance(x, Column) else F.lit(x) for x in (left, right))
    return F.col(start) - F.when(F.col(rc), r).otherwise(l), F.col(end) + F.when(F.col(rc), l).otherwise(r)


def inside(start: str, end: str, length: Column | int, strict: bool = False) -> Column:
    """Within the track. Expansion lets a seqlet touch the end; merging (``strict``) doesn't."""
    return (F.col(start) >= 0) & (F.col(end) < length if strict else F.col(end) <= length)


def slices(df: DataFrame, tracks: DataFrame, tensors: tuple[str, ...] = ("one_hot", "contrib", "hyp"), key: str = "example_idx") -> DataFrame:
    """``df`` with the slice of each tensor at its coordinates, reversed and complemented where is_revcomp."""
    joined = df.join(tracks.select(key, *(F.col(t).alias(f"_{t}") for t in tensors)), key)
    cut = lambda t: F.slice(f"_{t}", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    return joined.select(*df.columns, *(F.when(F.col("is_revcomp"), vec.reverse_complement(cut(t))).otherwise(cut(t)).alias(t) for t in tensors))


def to_string(example: str, start: str, end: str, rc: str) -> Column:
    flag = F.when(F.col(rc), "True").otherwise("False")
    return F.concat(F.lit("example:"), F.col(example), F.lit(",start:"), F.col(start), F.lit(",end:"), F.col(end), F.lit(",rc:"), flag)


def from_string(text: str) -> list[Column]:
    """example_idx, start, end and is_revcomp of a seqlet's text."""
    part = lambda name: F.regexp_extract(text, rf"(?:^|,){name}:([^,]*)", 1)
    return [part("example").cast("long").alias("example_idx"), part("start").cast("long").alias("start"), part("end").cast("long").alias("end"), (part("rc") == "True").alias("is_revcomp")]


def key(example: str = "example_idx", start: str = "start", end: str = "end") -> Column:
    return F.concat_ws("_", example, start, end)

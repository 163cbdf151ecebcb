"""Gapped words of a track: choices of positions whose letters, and gaps, are one number in base 5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _extend(words: Column, sites: Column, max_len: int, max_gap: int) -> Column:
    """Each word with each later site within reach. A word is its first and last position, key, sum and size."""

    def longer(w: Column) -> Column:
        near = F.filter(sites, lambda s: (s["pos"] > w["last"]) & (s["pos"] - w["first"] < max_len) & (s["pos"] - w["last"] <= max_gap))
        power = lambda s: F.pow(F.lit(5.0), s["pos"] - w["first"]).cast("long")
        return F.transform(near, lambda s: F.struct(w["first"].alias("first"), s["pos"].alias("last"), (w["key"] + (s["base"] + 1) * power(s)).alias("key"), (w["total"] + s["value"]).alias("total")))

    return F.flatten(F.transform(words, longer))


def gapped_words(sites: Column, min_k: int = 4, max_k: int = 6, max_len: int = 15, max_gap: int = 15) -> Column:
    """key and value (mean of the sites' values) of every choice of ``min_k`` to ``max_k`` of the sites, an array of
    struct<pos,base,value> by position, that spans less than ``max_len``."""
    words = F.transform(sites, lambda s: F.struct(s["pos"].alias("first"), s["pos"].alias("last"), (s["base"] + 1).cast("long").alias("key"), s["value"].alias("total")))
    parts = []
    for k in range(1, max_k + 1):
        if k > 1:
            words = _extend(words, sites, max_len, max_gap)
        if k >= min_k:
            parts.append(_valued(words, k))
    return F.concat(*parts)


def _valued(words: Column, k: int) -> Column:
    return F.transform(words, lambda w: F.struct(w["key"].alias("key"), (w["total"] / float(k)).alias("value")))


def word_scores(df: DataFrame, sites: str, key: str, max_entries: int = 500, **choice: int) -> DataFrame:
    """key columns, word and value: equal words of a row added up, the ``max_entries`` largest by magnitude kept."""
    words = df.select(key, F.explode(gapped_words(F.col(sites), **choice)).alias("w"))
    summed = words.groupBy(key, F.col("w.key").alias("word")).agg(F.sum("w.value").alias("value"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.abs(F.round("value", 9))), "word"))
    return summed.withColumn("_k", rank).where(F.col("_k") <= max_entries).drop("_k")


def top_sites(scores: Column, bases: Column, count: int = 20) -> Column:
    """The ``count`` positions of the largest scores (ties: first), by position, as struct<pos,base,value>."""
    rows = F.transform(scores, lambda x, k: F.struct((-x).alias("order"), k.alias("pos"), F.get(bases, k).alias("base"), x.alias("value")))
    best = F.slice(F.array_sort(rows), 1, count)
    return F.array_sort(F.transform(best, lambda s: F.struct(s["pos"].alias("pos"), s["base"].alias("base"), s["value"].alias("value"))))

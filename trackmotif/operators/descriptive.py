"""Numbers of the descriptive report: statistics of patterns, distributions and examples by quantile."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmotif.functions import vec
from trackmotif.operators.ranking import quantiles
from trackmotif.session import materialise, ship_package

BINS, EXAMPLES = 30, 10


def importance(contrib: Column) -> Column:
    """Sum of magnitudes of a seqlet's contributions."""
    return F.aggregate(vec.flatten(contrib), F.lit(0.0), lambda s, x: s + F.abs(x))


def region(members: DataFrame) -> DataFrame:
    """One row, lo and hi: where all seqlets lie; 0 and 400 if there are none."""
    return members.agg(F.coalesce(F.min("start"), F.lit(0)).alias("lo"), F.coalesce(F.max("end"), F.lit(400)).alias("hi"))


def placed(members: DataFrame) -> DataFrame:
    """``members`` and offset: from the middle of the region to the middle of the seqlet."""
    middle = region(members).select(((F.col("lo") + F.col("hi")) / 2).alias("_m"))
    return members.crossJoin(F.broadcast(middle)).withColumn("offset", (F.col("start") + F.col("end")) / 2 - F.col("_m")).drop("_m")


def statistics(members: DataFrame, tag: str = "tag") -> DataFrame:
    """Of members with importance and offset: tag, n, std_importance, median and standard deviation of the distance."""
    away = F.abs("offset")
    return members.groupBy(tag).agg(F.count("*").alias("n"), F.stddev_pop("importance").alias("std_importance"), F.median(away).alias("median_distance"), F.stddev_pop(away).alias("std_distance"))


def densities(members: DataFrame, value: str, tag: str = "tag", bins: int = BINS) -> DataFrame:
    """tag, bin, low, high, density: a histogram of each tag's values between its least and largest; one value alone gets
    a bin range of 1 around it."""
    limits = members.groupBy(tag).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n")).where("n > 0")
    limits = limits.select(tag, "n", F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    at = F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    counted = members.join(F.broadcast(limits), tag).where(F.col(value).isNotNull()).groupBy(tag, at.alias("bin")).agg(F.count("*").alias("k"))
    every = limits.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).join(counted, [tag, "bin"], "left")
    width = (F.col("hi") - F.col("lo")) / bins
    return every.select(tag, "bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), (F.coalesce("k", F.lit(0)) / (F.col("n") * width)).alias("density"))


def quantile_examples(members: DataFrame, n: int = EXAMPLES, tag: str = "tag", key: str = "ord") -> DataFrame:
    """tag, rank, quantile, ord, importance: for quantiles from 10 to 100 in even steps the seqlet of the nearest importance
    that no lower quantile has taken (ties: smallest ord); ranks count from the highest quantile.

    What a pick leaves decides the next one, but fewer than ``n`` are taken before it, so that each is among the ``n``
    nearest of its quantile: only these meet, at most n * n rows a tag. The driver has n numbers a tag, their quantiles.
    """
    spark = members.sparkSession
    ship_package(spark)
    rows = members.where("importance is not null").select(F.col(tag).cast("string").alias("tag"), F.col(key).cast("long").alias("k"), F.col("importance").cast("double").alias("v"))
    rows = materialise(rows, "importance")
    sizes = {r.tag: r.n for r in rows.groupBy("tag").agg(F.count("*").alias("n")).collect()}
    steps = np.linspace(10, 100, n)
    large = [t for t, size in sizes.items() if size >= n]
    named = rows.where(F.col("tag").isin(large)) if large else rows.limit(0)
    found = quantiles(named, "v", [float(q) / 100 for q in steps], "tag") if large else {}
    at = spark.createDataFrame([(t, k, float(q)) for t, (_, values) in found.items() for k, q in enumerate(values)], "tag string, step int, q double")
    place = F.row_number().over(Window.partitionBy("tag", "step").orderBy("away", "k"))
    near = named.join(F.broadcast(at), "tag").withColumn("away", F.abs(F.col("v") - F.col("q"))).withColumn("place", place).where(F.col("place") <= n)
    few = near.select("tag", "k", "v").distinct().unionByName(rows.where(~F.col("tag").isin(large)) if large else rows)
    packed = few.groupBy("tag").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("rows"))
    schema = pa.schema([(tag, pa.string()), ("rank", pa.int32()), ("quantile", pa.int32()), (key, pa.int64()), ("importance", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, held in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys, values = (held.values.field(c).to_numpy(zero_copy_only=False) for c in ("k", "v"))
                own = steps if name in found else np.linspace(10, 100, len(values))
                goals = found[name][1] if name in found else [np.percentile(values, q) for q in own]
                free = np.ones(len(values), bool)
                for rank, (q, goal) in enumerate(zip(own, goals, strict=True)):
                    k = int(np.where(free, np.abs(values - goal), np.inf).argmin())
                    free[k] = False
                    out.append((name, len(own) - rank, int(q), int(keys[k]), float(values[k])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return packed.mapInArrow(run, f"{tag} string, rank int, quantile int, {key} long, importance double")

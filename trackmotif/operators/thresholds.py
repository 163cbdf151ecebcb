"""Statistics that set the score threshold: histogram modes, a Laplace null, isotonic precision, empirical ranks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackmotif.operators import ranking
from trackmotif.session import materialise, ship_package

LEVELS = [k / 20 for k in range(1, 20)]


def bin_of(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Number of the value's bin, of ``bins`` equal ones from low to high; high is in the last."""
    return F.least(F.floor((value - low) / (high - low) * bins), F.lit(bins - 1)).cast("long")


def histogram(df: DataFrame, value: str, bins: int = 1000) -> DataFrame:
    """bin, n, and the bin's edges low and high; empty bins are left out. Values that are all equal are in the middle of a
    range of 1; without values there is no bin. The limits are one row that is broadcast."""
    one = F.min(value) == F.max(value)
    limits = df.agg((F.min(value) - F.when(one, 0.5).otherwise(0.0)).alias("lo"), (F.max(value) + F.when(one, 0.5).otherwise(0.0)).alias("hi"))
    rows = df.where(F.col(value).isNotNull()).select(value).crossJoin(F.broadcast(limits))
    counted = rows.select(bin_of(F.col(value), F.col("lo"), F.col("hi"), bins).alias("bin"), "lo", "hi").groupBy("bin", "lo", "hi").agg(F.count("*").alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    return counted.select("bin", "n", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"))


def mode_bin(df: DataFrame, value: str, bins: int = 1000) -> DataFrame:
    """The fullest bin (the first of equals), as one row; none without values."""
    return histogram(df, value, bins).orderBy(F.desc("n"), "bin").limit(1)


def two_level_mode(df: DataFrame, value: str, bins: int = 1000) -> DataFrame:
    """mu, one row: the middle of the fullest bin of the values strictly within the fullest bin of all. Where no value is
    strictly within, as of values that are all equal, the first bin of the range from 0 to 1 counts; no values give no row."""
    outer = mode_bin(df, value, bins).first()
    found = []
    if outer is not None:
        inner = mode_bin(df.select(value).where((F.col(value) > outer.low) & (F.col(value) < outer.high)), value, bins).first()
        found = [((inner.low + inner.high) / 2 if inner is not None else 0.5 / bins,)]
    return df.sparkSession.createDataFrame(found, "mu double")


def percentiles(df: DataFrame, value: str, levels: list[float] = LEVELS) -> DataFrame:
    """level, q: linear interpolation between the two nearest values, exact; found by counting (see ranking)."""
    found = ranking.quantiles(df, value, levels)
    return df.sparkSession.createDataFrame(list(zip(levels, found[None][1], strict=True)) if found else [], "level double, q double")


def laplace_rates(df: DataFrame, value: str, mu: DataFrame, levels: list[float] = LEVELS) -> DataFrame:
    """mu, and on each side of it the largest of -ln(1 - level) / |q - mu| over the side's percentiles, as one row for the one
    of ``mu`` (none for none). Values at mu count on both sides, which are counted together; a side whose percentiles are
    all mu, or that has no value, has a null rate."""
    found = []
    if (row := mu.first()) is not None:
        v = F.col(value)
        sides = F.filter(F.array(F.when(v >= row.mu, 1), F.when(v <= row.mu, -1)), lambda x: x.isNotNull())
        own = df.where(v.isNotNull()).select(F.explode(sides).alias("side"), value).withColumn(value, F.col("side") * v)
        held = ranking.quantiles(own, value, levels, "side")
        rate = lambda side: max((-math.log(1 - p) / abs(side * q - row.mu) for p, q in zip(levels, held[side][1], strict=True) if side * q != row.mu), default=None) if side in held else None
        found = [(row.mu, rate(1), rate(-1))]
    return df.sparkSession.createDataFrame(found, "mu double, rate_up double, rate_down double")


def laplace_draws(mu: float, up: float, down: float, share_up: float, count: int = 10_000, seed: int = 1234) -> np.ndarray:
    """Inverse-CDF draws from the null, two uniforms each: above mu with probability ``share_up``, and how far."""
    side, u = np.random.RandomState(seed).uniform(size=(count, 2)).T
    size = -np.log(1 - u)
    return np.where(side < share_up, mu + size / up, mu - size / down)


def isotonic(df: DataFrame, value: str, label: str, weight: str, increasing: bool = True) -> DataFrame:
    """``df`` with fit, the isotonic regression of ``label`` on ``value``; rows of one value are pooled."""
    model = IsotonicRegression(featuresCol=value, labelCol=label, weightCol=weight, predictionCol="fit", isotonic=increasing).fit(df)
    return model.transform(df)


def precision_threshold(positives: np.ndarray, null: np.ndarray, increasing: bool, fdr: float, least_negative: float = 0.95) -> float:
    """The first value (by rank from the weakest) whose estimated precision reaches 1 - fdr, from sampled values and a null.

    Both are bounded samples. Labels are 1 for values and 0 for the null, whose rows together weigh as much as the values.
    """
    values = np.concatenate([positives, null])
    labels = np.concatenate([np.ones(len(positives)), np.zeros(len(null))])
    weights = np.concatenate([np.ones(len(positives)), np.full(len(null), len(positives) / max(1, len(null)))])
    order = np.argsort(values, kind="stable")
    fit = pool_adjacent(values[order], labels[order], weights[order], increasing)
    own = np.interp(positives, values[order], fit)
    worst = max(float(fit[0] if increasing else fit[-1]), 1e-7)
    share = min(max(worst / (1 - worst) if worst < 1 else 1.0, least_negative), 1.0)  # of the values that are noise
    precision = np.minimum(np.maximum(1 + share * (1 - np.divide(1.0, own, out=np.full_like(own, math.inf), where=own > 0)), 0.0), 1.0)
    precision[-1:] = 1.0
    return float(positives[np.flatnonzero(precision >= 1 - fdr)[0]])


_BLOCKS = pa.schema([("low", pa.float64()), ("high", pa.float64()), ("w", pa.float64()), ("y", pa.float64()), ("first", pa.float64())])


def _pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks, in order, whose means y / w rise, from blocks in order."""
    held: list[list] = []
    for batch in batches:
        for block in zip(*(batch.column(f.name).to_pylist() for f in _BLOCKS), strict=True):
            held.append(list(block))
            while len(held) > 1 and held[-2][3] * held[-1][2] >= held[-1][3] * held[-2][2]:
                _, high, w, y, first = held.pop()
                last = held[-1]
                held[-1] = [last[0], high, last[2] + w, last[3] + y, first if last[4] is None else last[4]]
    yield pa.RecordBatch.from_arrays([pa.array([b[k] for b in held], f.type) for k, f in enumerate(_BLOCKS)], schema=_BLOCKS)


def isotonic_blocks(points: DataFrame, parts: int | None = None) -> DataFrame:
    """low, high, w, y, first: the blocks of the weighted isotonic fit, y / w, that rises with value, of rows (value, w,
    label), where ``first`` is the block's smallest value with a label above 0.

    Equal values are one point. Ranges of values are pooled each by itself, which leaves few blocks (of n labels of 0 and 1
    about the cube root of n); pooling goes on over fewer and larger ranges of blocks, as it may in any order.
    """
    y = F.col("w") * F.col("label")
    each = points.groupBy("value").agg(F.sum("w").alias("w"), F.sum(y).alias("y"), F.min(F.when(F.col("label") > 0, F.col("value"))).alias("first"))
    blocks = each.select(F.col("value").alias("low"), F.col("value").alias("high"), "w", "y", "first")
    ddl = "low double, high double, w double, y double, first double"
    parts = parts or int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        blocks = blocks.repartitionByRange(parts, "low").sortWithinPartitions("low").mapInArrow(_pooled, ddl)
        if parts == 1:
            return blocks
        blocks, parts = materialise(blocks, "blocks"), max(1, parts // 16)


def isotonic_threshold(values: DataFrame, value: str, null: np.ndarray, increasing: bool, fdr: float, least_negative: float = 0.95) -> float:
    """``precision_threshold`` of all rows of ``values``, none of which pass the driver, and a bounded sample of the null."""
    spark = values.sparkSession
    ship_package(spark)
    turn = 1.0 if increasing else -1.0
    own = values.where(F.col(value).isNotNull()).select((F.col(value) * turn).alias("value"))
    size = own.agg(F.count("*").alias("n"), F.max("value").alias("top")).first()
    if not size.n:
        return turn * math.inf
    noise = spark.createDataFrame(pa.table({"value": null * turn})).select("value", F.lit(size.n / max(1, len(null))).alias("w"), F.lit(0.0).alias("label"))
    points = own.select("value", F.lit(1.0).alias("w"), F.lit(1.0).alias("label")).unionByName(noise)
    blocks = materialise(isotonic_blocks(points).withColumn("fit", F.col("y") / F.col("w")), "isotonic")
    worst = max(blocks.agg(F.min("fit")).first()[0], 1e-7)
    share = min(max(worst / (1 - worst) if worst < 1 else 1.0, least_negative), 1.0)
    precision = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 + share * (1 - F.try_divide(F.lit(1.0), "fit"))))
    found = blocks.where((precision >= 1 - fdr) & F.col("first").isNotNull()).agg(F.min("first")).first()[0]
    return turn * (size.top if found is None else found)


def pool_adjacent(values: np.ndarray, labels: np.ndarray, weights: np.ndarray, increasing: bool = True) -> np.ndarray:
    """Weighted isotonic fit of labels ordered by values; equal values are one point."""
    if not increasing:
        return -pool_adjacent(values, -labels, weights)
    unique, at = np.unique(values, return_inverse=True)
    w = np.bincount(at, weights, len(unique))
    y = np.bincount(at, weights * labels, len(unique)) / w
    blocks: list[list[float]] = []
    for mean, weight in zip(y, w, strict=True):
        blocks.append([mean, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, v, n = blocks.pop()
            a = blocks[-1]
            blocks[-1] = [(a[0] * a[1] + m * v) / (a[1] + v), a[1] + v, a[2] + n]
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])[at]


def refined(df: DataFrame, value: str, high: float, low: float, least: float = 0.03, most: float = 0.2) -> DataFrame:
    """The thresholds, made symmetric at a percentile of magnitudes where too few or too many windows pass."""
    share = df.agg(F.avg(((F.col(value) >= high) | (F.col(value) <= low)).cast("double"))).first()[0]
    bound = None
    if share is not None and not least <= share <= most:
        bound = ranking.quantiles(df.select(F.abs(value).alias("m")), "m", [1 - least if share < least else 1 - most])[None][1][0]
    row = (share, high, low) if bound is None else (share, bound, -bound)
    return df.sparkSession.createDataFrame([row], "share double, high double, low double")


def signed_ecdf(df: DataFrame, value: str, thresholds: list[float]) -> DataFrame:
    """threshold, ecdf: the share of magnitudes below the threshold's, with the threshold's sign."""
    found = df.agg(*(F.avg((F.abs(value) < abs(t)).cast("double")).alias(f"e{k}") for k, t in enumerate(thresholds)))
    rows = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), (F.lit(float(np.sign(t))) * F.col(f"e{k}")).alias("ecdf")) for k, t in enumerate(thresholds)))
    return found.select(F.explode(rows).alias("x")).select("x.*")


def order_statistic(df: DataFrame, value: str, q: float) -> DataFrame:
    """The magnitude with rank int(q * n) from 0, as one row; nothing if there are no values."""
    found = ranking.at_ranks(df.where(F.col(value).isNotNull()).select(F.abs(value).alias("magnitude")), "magnitude", lambda _, n: [min(n - 1, int(q * n))], levels=[q])
    return df.sparkSession.createDataFrame(list(found.get(None, {}).items()), "rank long, magnitude double")


def sampled(df: DataFrame, value: str, cap: int, seed: int) -> DataFrame:
    """``cap`` values, drawn by a hash of the other columns (example and position), so that equal values are drawn each alone."""
    keys = [c for c in df.columns if c != value] or [value]
    return df.orderBy(F.xxhash64(*keys, F.lit(seed))).limit(cap).select(value)


def thresholds(df: DataFrame, value: str = "total", fdr: float = 0.2, cap: int | None = None, weak: float = 0.8, seed: int = 1234, least: float = 0.03, most: float = 0.2) -> dict[str, float]:
    """high, low and sign (weak) thresholds of smoothed values, over all of them, or with a ``cap`` over a sample; only scalars
    reach the driver. Values that are all equal, or none, have thresholds that nothing passes."""
    spark: SparkSession = df.sparkSession
    nothing = {"high": math.inf, "low": -math.inf, "sign": math.inf}
    limits = df.agg(F.min(value).alias("low"), F.max(value).alias("high")).first()
    if limits.low is None or limits.low == limits.high:
        return nothing
    mu = two_level_mode(df, value).first()["mu"]
    rates = laplace_rates(df, value, spark.createDataFrame([(mu,)], "mu double")).first()
    v = F.col(value)
    n = df.agg(*(F.count_if(c).alias(k) for k, c in (("up", v >= mu), ("down", v <= mu), ("all", v.isNotNull())))).first()
    up, down = (math.inf if x is None else x for x in (rates.rate_up, rates.rate_down))  # a side without spread draws mu
    null = laplace_draws(mu, up, down, n.up / (n.up + n.down), seed=seed)
    rows = df.select(value) if cap is None or n.all <= cap else sampled(df, value, cap, seed)
    high = isotonic_threshold(rows.where(v >= 0), value, null[null >= 0], True, fdr)
    low = isotonic_threshold(rows.where(v < 0), value, null[null < 0], False, fdr)
    r = refined(df, value, high, low, least, most).first()
    ecdf = {x.threshold: x.ecdf for x in signed_ecdf(df, value, [r.high, r.low]).collect()}
    q = max(0.0, min(min(abs(e) for e in ecdf.values()) - 0.0001, weak))
    return {"high": r.high, "low": r.low, "sign": order_statistic(df, value, q).first()["magnitude"]}


def ranks(value: str, *by: str) -> Column:
    """Average ranks from 1, within ``by``."""
    w = Window.partitionBy(*by).orderBy(value)
    same = Window.partitionBy(*by, value)
    return F.rank().over(w) + (F.count("*").over(same) - 1) / 2

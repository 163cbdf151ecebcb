"""Patterns: aligned sets of seqlets, their means, information, trims, filters and pairwise comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmotif.functions import vec
from trackmotif.operators.thresholds import ranks


def means(members: DataFrame, pattern: str, *tensors: str) -> DataFrame:
    """pattern, pos, base and the mean of each tensor over the members that have the position, and n."""
    zipped = F.transform(F.arrays_zip(*tensors), lambda x: F.arrays_zip(*(x[t].alias(t) for t in tensors)))
    rows = members.select(pattern, F.posexplode(zipped).alias("pos", "row")).select(pattern, "pos", F.posexplode("row").alias("base", "x"))
    return rows.groupBy(pattern, "pos", "base").agg(*(F.avg(F.col(f"x.{t}")).alias(t) for t in tensors), F.count("*").alias("n"))


def matrices(long: DataFrame, pattern: str, *tensors: str) -> DataFrame:
    """A row a pattern with each tensor as array<array<double>>; a pattern is tens of positions long."""
    row = F.array_sort(F.collect_list(F.struct("base", *tensors)))
    rows = long.groupBy(pattern, "pos").agg(row.alias("r")).groupBy(pattern).agg(F.array_sort(F.collect_list(F.struct("pos", "r"))).alias("m"))
    return rows.select(pattern, *(_tensor(t) for t in tensors))


def _tensor(name: str) -> Column:
    return F.transform("m", lambda p: F.transform(p["r"], lambda b: b[name])).alias(name)


def support_bounds(counts: DataFrame, pattern: str, pos: str, n: str, share: float = 0.2, least: int = 30) -> DataFrame:
    """pattern, first, last: positions with a support of at least min(least, share * largest)."""
    need = F.least(F.lit(float(least)), share * F.max(n).over(Window.partitionBy(pattern)))
    used = counts.withColumn("_need", need).where(F.col(n) >= F.col("_need"))
    return used.groupBy(pattern).agg(F.min(pos).alias("first"), F.max(pos).alias("last"))


def background(one_hot_long: DataFrame, base: str = "base", value: str = "one") -> DataFrame:
    return one_hot_long.groupBy(base).agg(F.avg(value).alias("freq"))


def information(ppm: DataFrame, background: DataFrame, pattern: str, pos: str = "pos", base: str = "base", p: str = "p", pseudocount: float = 0.001) -> DataFrame:
    """pattern, pos, ic in bits against the background (four rows, broadcast)."""
    joined = ppm.join(F.broadcast(background), base)
    part = F.log2((F.col(p) + pseudocount) / (1 + 4 * pseudocount)) * F.col(p) - F.log2("freq") * F.col("freq")
    return joined.groupBy(pattern, pos).agg(F.sum(part).alias("ic"))


def best_window(scores: DataFrame, width: int, pattern: str, pos: str = "pos", score: str = "ic") -> DataFrame:
    """pattern, start, total of the window with the largest sum, the first of equals; all of it if it is shorter."""
    order = Window.partitionBy(pattern).orderBy(pos)
    size = F.count("*").over(Window.partitionBy(pattern))
    framed = scores.select(pattern, F.col(pos).alias("start"), F.sum(score).over(order.rowsBetween(0, width - 1)).alias("total"), F.count("*").over(order.rowsBetween(0, width - 1)).alias("_n"), size.alias("_size"))
    full = framed.where(F.col("_n") == F.least(F.lit(width), "_size"))
    best = F.row_number().over(Window.partitionBy(pattern).orderBy(F.desc(F.round("total", 9)), "start"))
    return full.withColumn("_k", best).where("_k = 1").select(pattern, "start", "total")


def auroc(scores: DataFrame, score: str, positive: str, *by: str) -> DataFrame:
    """by, auroc: how often a positive row is above a negative one, ties half; null without either."""
    ranked = scores.select(*by, F.col(positive).alias("_y"), ranks(score, *by).alias("_r"))
    n1 = F.sum(F.col("_y").cast("double"))
    n0 = F.sum((~F.col("_y")).cast("double"))
    u = F.sum(F.when(F.col("_y"), F.col("_r")).otherwise(0.0)) - n1 * (n1 + 1) / 2
    return ranked.groupBy(*by).agg(F.try_divide(u, n1 * n0).alias("auroc"))


def contamination(value: Column) -> Column:
    return 2 * (1 - F.greatest(value, F.lit(0.5)))


def of_sign(totals: DataFrame, total: str, sign: str) -> DataFrame:
    """The patterns whose total contribution has the sign, "pos" or "neg", of the track they were found on; zero has neither."""
    return totals.where(F.signum(total) == F.when(F.col(sign) == "pos", 1.0).when(F.col(sign) == "neg", -1.0))


def first_of(members: DataFrame, pattern: str, order: str, cap: int) -> DataFrame:
    """At most ``cap`` members of a pattern, for pairwise comparison."""
    return members.withColumn("_k", F.row_number().over(Window.partitionBy(pattern).orderBy(order))).where(F.col("_k") <= cap).drop("_k")


def merges(pairs: list[tuple[int, int, float, float, float]], thresholds: list[tuple[float, float]], vetoes: list[tuple[float, float]]) -> list[tuple[int, int]]:
    """Pairs (i, j) of patterns to merge, from rows (i, j, similarity, least and mean contamination) of i < j, the most
    similar first.

    A pair is merged if its similarity and least contamination both reach some threshold (contamination, similarity),
    unless a pair across the sets of patterns already merged with either has a mean contamination and a similarity that
    are both at or below a veto.
    """
    score = {(i, j): (s, mean) for i, j, s, _, mean in pairs}
    partners: dict[int, set[int]] = {}
    out = []
    for i, j, s, least, _ in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if not any(least >= t and s >= u for t, u in thresholds):
            continue
        union = partners.get(i, {i}) | partners.get(j, {j})
        across = [score[a, b] for a in union for b in union if a < b and (a, b) in score]
        if any(y <= t and x <= u for x, y in across for t, u in vetoes):
            continue
        for k in union:
            partners[k] = union
        out.append((i, j))
    return out

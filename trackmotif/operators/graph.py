"""Neighbour graphs: distances, symmetric means, density adaptation, modularity and Leiden communities."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmotif.operators.ranking import numbered
from trackmotif.session import materialise, ship_package

EPS = 1e-7


def distance(sim: Column | str) -> Column:
    """ln(2 / sim - 1), from 0; similarities count at least 1e-7."""
    s = F.col(sim) if isinstance(sim, str) else sim
    return F.greatest(F.log(F.lit(2.0) / F.greatest(s, F.lit(EPS)) - 1), F.lit(0.0))


def symmetric(edges: DataFrame) -> DataFrame:
    """i, j, d both ways: the mean of the directions there are; distances of zero are no edges."""
    real = edges.where(F.col("d") > 0).select("i", "j", "d")
    return real.unionByName(real.select(F.col("j").alias("i"), F.col("i").alias("j"), "d")).groupBy("i", "j").agg(F.avg("d").alias("d"))


def precision(distances: np.ndarray, perplexity: float, own: float = 1.0, steps: int = 100) -> float:
    """beta for which the entropy of exp(-d * beta) is ln(perplexity), where the point itself counts ``own``."""
    low, high, beta, goal = -math.inf, math.inf, 1.0, math.log(perplexity)
    for _ in range(steps):
        e = np.exp(-distances * beta)
        total = max(own + e.sum(), 1e-8)
        gap = math.log(total) + beta * float(distances @ e) / total - goal
        if abs(gap) <= 1e-5:
            break
        low, high = (beta, high) if gap > 0 else (low, beta)
        beta = (low + high) / 2 if math.isfinite(low + high) else beta * 2 if gap > 0 else beta / 2
    return beta


def _precisions(ds: Column, perplexity: float, own: float) -> Column:
    """beta, and the sum of exp(-d / beta), of an array of distances."""

    @F.arrow_udf("struct<beta:double,inverse:double>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            each = [row.values.to_numpy(zero_copy_only=False) for row in rows]
            betas = [precision(d, perplexity, own) for d in each]
            sums = [float(np.exp(-d / b).sum()) for d, b in zip(each, betas, strict=True)]
            yield pa.StructArray.from_arrays([pa.array(betas, pa.float64()), pa.array(sums, pa.float64())], ["beta", "inverse"])

    return found(ds)


def precisions(edges: DataFrame, perplexity: float) -> DataFrame:
    """i, beta, norm of each row of symmetric distances. The kernel that follows divides by beta."""
    ship_package(edges.sparkSession)
    rows = edges.groupBy("i").agg(F.array_sort(F.collect_list("d")).alias("ds"))
    rows = rows.select("i", _precisions(F.col("ds"), perplexity, 1.0).alias("x"))
    return rows.select("i", "x.beta", (F.col("x.inverse") + 1).alias("norm"))


def density_adapted(edges: DataFrame, perplexity: float = 10.0) -> DataFrame:
    """i, j, w of a graph whose kernels fit each row's density, with 1 / norm on the diagonal."""
    found = materialise(precisions(edges, perplexity), "precisions")
    a, b = found.select("i", F.col("beta").alias("bi"), F.col("norm").alias("ni")), found.select(F.col("i").alias("j"), F.col("beta").alias("bj"), F.col("norm").alias("nj"))
    both = edges.join(a, "i").join(b, "j")
    w = F.sqrt(F.exp(-F.col("d") / F.col("bi")) / F.col("ni") * F.exp(-F.col("d") / F.col("bj")) / F.col("nj"))
    diagonal = found.select("i", F.col("i").alias("j"), (1 / F.col("norm")).alias("w"))
    return both.select("i", "j", w.alias("w")).unionByName(diagonal)


def conditional(edges: DataFrame, perplexity: float) -> DataFrame:
    """i, j, p: each row's shares of exp(-d * beta), the point itself not counted. A perplexity above a row's number of
    neighbours can't be reached; the search then ends with the flattest shares it has met."""
    ship_package(edges.sparkSession)
    rows = edges.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("d", "j"))).alias("e"))
    rows = rows.select("i", "e", _precisions(F.transform("e", lambda x: x["d"]), perplexity, 0.0).alias("x"))
    rows = rows.select("i", F.explode("e").alias("e"), "x.beta", F.aggregate("e", F.lit(0.0), lambda s, x: s + F.exp(-x["d"] * F.col("x.beta"))).alias("sum"))
    return rows.select("i", "e.j", (F.exp(-F.col("e.d") * F.col("beta")) / F.greatest("sum", F.lit(1e-8))).alias("p"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row, q: of a partition (id, label), where each row (i, j, w) is an undirected edge, loops too."""
    a, b = labels.select(F.col("id").alias("i"), F.col("label").alias("li")), labels.select(F.col("id").alias("j"), F.col("label").alias("lj"))
    joined = edges.join(a, "i").join(b, "j")
    ends = joined.select(F.col("li").alias("label"), "w").unionByName(joined.select(F.col("lj").alias("label"), "w")).groupBy("label").agg(F.sum("w").alias("k"))
    within = joined.agg(F.sum("w").alias("m"), F.sum(F.when(F.col("li") == F.col("lj"), F.col("w")).otherwise(0.0)).alias("inside"))
    return ends.agg(F.sum(F.col("k") * F.col("k")).alias("k2")).crossJoin(F.broadcast(within)).select((F.try_divide("inside", "m") - F.try_divide(F.col("k2"), 4 * F.col("m") * F.col("m"))).alias("q"))


class _Graph:
    """Undirected weighted graph as adjacency; loops are kept apart."""

    def __init__(self, n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray):
        self.n, self.loops = n, np.bincount(i[i == j], w[i == j], n)
        real = i != j
        a, b, v = np.concatenate([i[real], j[real]]), np.concatenate([j[real], i[real]]), np.concatenate([w[real], w[real]])
        order = np.argsort(a, kind="stable")
        self.to, self.w = b[order], v[order]
        self.start = np.searchsorted(a[order], np.arange(n + 1))
        self.degree = np.bincount(a, v, n) + 2 * self.loops
        self.total = self.degree.sum() / 2

    def near(self, v: int) -> tuple[np.ndarray, np.ndarray]:
        s = slice(self.start[v], self.start[v + 1])
        return self.to[s], self.w[s]

    def quality(self, label: np.ndarray) -> float:
        if self.total == 0:
            return 0.0
        source = np.repeat(np.arange(self.n), np.diff(self.start))
        inside = self.w[label[source] == label[self.to]].sum() / 2 + self.loops.sum()
        k = np.bincount(label, self.degree)
        return float(inside / self.total - (k * k).sum() / (4 * self.total**2))

    def grouped(self, label: np.ndarray) -> _Graph:
        source = np.repeat(np.arange(self.n), np.diff(self.start))
        once = source < self.to
        n = int(label.max()) + 1
        i, j, w = label[source[once]], label[self.to[once]], self.w[once]
        return _Graph(n, np.concatenate([i, label]), np.concatenate([j, label]), np.concatenate([w, self.loops]))


def _moved(g: _Graph, label: np.ndarray, rng: np.random.RandomState, within: np.ndarray | None = None) -> np.ndarray:
    """Move nodes while modularity grows: a queue of nodes in random order; within a coarser partition if one is given,
    where only nodes that are still alone move."""
    label = label.copy()
    weight = np.bincount(label, g.degree, g.n)
    members = np.bincount(label, minlength=g.n)
    queue = deque(rng.permutation(g.n))
    waiting = np.ones(g.n, bool)
    while queue:
        v = queue.pop()
        waiting[v] = False
        if within is not None and members[label[v]] > 1:
            continue
        to, w = g.near(v)
        if within is not None:
            same = within[to] == within[v]
            to, w = to[same], w[same]
        own = label[v]
        links: dict[int, float] = {int(own): 0.0}
        for c, x in zip(label[to].tolist(), w.tolist(), strict=True):
            links[c] = links.get(c, 0.0) + x
        weight[own] -= g.degree[v]
        gain = {c: x - g.degree[v] * weight[c] / (2 * g.total) for c, x in links.items()}
        best = max(gain, key=lambda c: (gain[c], c == own, -c))
        if gain[best] <= gain[int(own)] + 1e-12:
            best = int(own)
        weight[best] += g.degree[v]
        if best != own:
            members[own] -= 1
            members[best] += 1
            label[v] = best
            if within is None:
                for u in to[label[to] != best].tolist():
                    if not waiting[u]:
                        waiting[u] = True
                        queue.appendleft(u)
    return np.unique(label, return_inverse=True)[1]


def leiden(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, seed: int) -> tuple[np.ndarray, float]:
    """Labels (0 for the largest) and modularity: local moves, refinement and aggregation until nothing moves."""
    rng, base = np.random.RandomState(seed), _Graph(n, i, j, w)
    if base.total == 0:
        return np.arange(n), 0.0
    best = np.arange(n)
    for _ in range(20):
        g, at, label = base, np.arange(n), best.copy()
        while True:
            label = _moved(g, label, rng)
            if label.max() + 1 == g.n:
                break
            fine = _moved(g, np.arange(g.n), rng, within=label)
            if fine.max() + 1 == g.n:
                fine = label
            coarse = np.zeros(fine.max() + 1, np.int64)
            coarse[fine] = label
            g, at, label = g.grouped(fine), fine[at], np.unique(coarse, return_inverse=True)[1]
        found = np.unique(label[at], return_inverse=True)[1]
        if base.quality(found) <= base.quality(best) + 1e-10:
            break
        best = found
    sizes = np.bincount(best)
    order = np.lexsort((np.arange(len(sizes)), -sizes))
    rank = np.empty(len(sizes), np.int64)
    rank[order] = np.arange(len(sizes))
    return rank[best], base.quality(best)


def _packed_runs(rows: DataFrame, name: str, seeds: int) -> DataFrame:
    """(name), id, label, q: the best of ``seeds`` runs for each group of edges, each a task with a group's edges."""
    kind = rows.schema[name].dataType.simpleString()
    order = F.array_sort(F.collect_list(F.struct(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("w").cast("double").alias("w"))))
    packed = rows.groupBy(name).agg(order.alias("e"))
    tasks = materialise(packed, "edges").withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(seeds)))).repartition(seeds * 4, name, "seed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                e = batch.column("e")[k].values
                i, j, w = (e.field(c).to_numpy(zero_copy_only=False) for c in ("i", "j", "w"))
                ids = np.unique(np.concatenate([i, j]))
                seed = batch.column("seed")[k].as_py()
                label, q = leiden(len(ids), np.searchsorted(ids, i), np.searchsorted(ids, j), w, seed * 100)
                one = batch.column(name).slice(k, 1)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([one] * len(ids)), pa.array(np.full(len(ids), seed), pa.int32()), pa.array(np.full(len(ids), q)), pa.array(ids), pa.array(label)], names=[name, "seed", "q", "id", "label"])

    found = materialise(tasks.mapInArrow(run, f"{name} {kind}, seed int, q double, id long, label long"), "communities")
    best = found.groupBy(name).agg(F.max(F.struct(F.col("q"), (-F.col("seed")).alias("s"))).alias("b")).select(name, F.col("b.q").alias("bq"), (-F.col("b.s")).alias("bs"))
    return found.join(F.broadcast(best), name).where((F.col("q") == F.col("bq")) & (F.col("seed") == F.col("bs"))).select(name, "id", "label", "q")


#: Edges of a group that one task takes; larger groups are made smaller first, as tables.
SMALL = 400_000
#: Rounds of moving, and the share of nodes that still move below which it ends.
ROUNDS, CALM = 16, 0.002


def communities(edges: DataFrame, group: str | None = None, seeds: int = 2, small: int = SMALL) -> DataFrame:
    """(group,) id, label, q: the best of ``seeds`` runs for each group of edges (i, j, w).

    A group of at most ``small`` edges is packed into one row of arrays, which goes to each seed's task; of a larger one, both
    ways of an edge are first made one, and loops don't count. If it is still too large, it is coarsened by moves and merges that are joins of its
    tables (see ``coarsened``) until it is small enough, and its labels are settled by moves on all its edges; no task gets
    more than ``small`` edges.
    """
    spark = edges.sparkSession
    ship_package(spark)
    name = group or "_g"
    rows = edges.withColumn("_g", F.lit(0)) if group is None else edges
    rows = materialise(rows.select(name, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("w").cast("double").alias("w")), "graph-edges")
    large = [r[0] for r in rows.groupBy(name).agg(F.count("*").alias("n")).where(F.col("n") > small).collect()]
    out = _packed_runs(rows.where(~F.col(name).isin(large)) if large else rows, name, seeds)
    for key in large:
        own = rows.where(F.col(name) == F.lit(key)).drop(name)
        found = _settled(own, seeds, small).select(F.lit(key).alias(name), "id", "label", "q")
        out = out.unionByName(found)
    return out if group else out.drop("_g")


def _adjacency(edges: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """(i, j, w) both ways without loops, (id, loop, k) of every node, and the weight of all edges."""
    real = edges.where("i <> j")
    adjacent = materialise(real.select("i", "j", "w").union(real.select("j", "i", "w")).groupBy("i", "j").agg(F.sum("w").alias("w")), "adjacent")
    ends = adjacent.select(F.col("i").alias("id"), F.lit(0.0).alias("loop"), "w").union(edges.where("i = j").select("i", "w", F.lit(0.0)))
    nodes = materialise(ends.groupBy("id").agg(F.sum("loop").alias("loop"), (F.sum("w") + 2 * F.sum("loop")).alias("k")), "nodes")
    return adjacent, nodes, float(nodes.agg(F.sum("k")).first()[0] or 0.0) / 2


def moved(nodes: DataFrame, adjacent: DataFrame, total: float, seed: int, rounds: int = ROUNDS, alone: bool = False) -> DataFrame:
    """``nodes`` (id, k, c and more) with better communities c: rounds of moves to where modularity gains most.

    Of two neighbours that want to move, only one does in a round, the one with the larger hash, so that neither counts on
    the other's place. With ``alone``, only nodes that are their community's only one move. Each round is three joins
    of the edges with what they need of their ends; a node's links are summed up by community before anything meets.
    """
    size = nodes.count()
    for number in range(rounds):
        sums = nodes.groupBy("c").agg(F.sum("k").alias("t"), F.count("*").alias("n"))
        mine = nodes.join(sums, "c").select(F.col("id").alias("i"), "k", F.col("c").alias("own"), F.col("t").alias("t_own"), "n")
        near = adjacent.join(nodes.select(F.col("id").alias("j"), "c"), "j").groupBy("i", "c").agg(F.sum("w").alias("w"))
        rows = near.join(sums.select("c", "t"), "c").join(mine.where("n = 1") if alone else mine, "i")
        stay = F.col("c") == F.col("own")
        gain = F.col("w") - F.col("k") * (F.col("t") - F.when(stay, F.col("k")).otherwise(0.0)) / (2 * total)
        best = rows.groupBy("i", "k", "own", "t_own").agg(F.max(F.when(stay, gain)).alias("here"), F.max(F.when(~stay, F.struct(gain.alias("gain"), (-F.col("c")).alias("c")))).alias("there"))
        here = F.coalesce("here", -F.col("k") * (F.col("t_own") - F.col("k")) / (2 * total))
        wish = best.where(F.col("there.gain") > here + 1e-12).select("i", (-F.col("there.c")).alias("to"), F.xxhash64("i", F.lit(number), F.lit(seed)).alias("turn"))
        wish = materialise(wish, "wishes")
        other = wish.select(F.col("i").alias("j"), F.col("turn").alias("before"))
        waits = adjacent.select("i", "j").join(wish.select("i", "turn"), "i").join(other, "j").where("before > turn").select("i").distinct()
        goes = wish.join(waits, "i", "left_anti").select(F.col("i").alias("id"), "to")
        nodes = materialise(nodes.join(goes, "id", "left").withColumn("c", F.coalesce("to", "c")).drop("to"), "nodes")
        if wish.count() <= CALM * size:
            break
    return nodes


def coarsened(edges: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """(id, c) of every node, and the edges between the c: local moves, then a refinement within each community, where nodes
    join one another from scratch, so that what becomes one node is connected."""
    adjacent, nodes, total = _adjacency(edges)
    coarse = moved(nodes.withColumn("c", F.col("id")), adjacent, total, seed)
    inside = adjacent.join(coarse.select(F.col("id").alias("i"), F.col("c").alias("ci")), "i").join(coarse.select(F.col("id").alias("j"), F.col("c").alias("cj")), "j")
    inside = materialise(inside.where("ci = cj").select("i", "j", "w"), "inside")
    fine = moved(nodes.withColumn("c", F.col("id")), inside, total, seed + 1, alone=True).select("id", "c")
    place = lambda x: fine.select(F.col("id").alias(x), F.col("c").alias(f"{x}c"))
    between = adjacent.where("i < j").join(place("i"), "i").join(place("j"), "j").select(F.least("ic", "jc").alias("i"), F.greatest("ic", "jc").alias("j"), "w")
    loops = nodes.where("loop > 0").join(fine, "id").select(F.col("c").alias("i"), F.col("c").alias("j"), F.col("loop").alias("w"))
    return fine, materialise(between.union(loops).groupBy("i", "j").agg(F.sum("w").alias("w")), "coarse")


def _settled(edges: DataFrame, seeds: int, small: int) -> DataFrame:
    """id, label (0 for the largest), q of a graph of any size."""
    once = edges.groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.sum("w").alias("w"))
    of, level, seed = None, materialise(once, "once"), 1
    n = level.where("i <> j").count()
    if n <= small:
        return _packed_runs(level.withColumn("_g", F.lit(0)), "_g", seeds).select("id", F.col("label").cast("long").alias("label"), "q")
    while n > small:
        fine, level = coarsened(level, 100 * seed)
        of = materialise(fine if of is None else of.join(fine.select(F.col("id").alias("c"), F.col("c").alias("to")), "c").select("id", F.col("to").alias("c")), "levels")
        before, n, seed = n, level.count(), seed + 1
        if n > 0.95 * before:
            break
    if n <= small:
        best = _packed_runs(level.withColumn("_g", F.lit(0)), "_g", seeds).select(F.col("id").alias("c"), F.col("label").cast("long").alias("label"))
        of = of.join(best, "c").select("id", "label")
    else:
        of = of.withColumnRenamed("c", "label")
    adjacent, nodes, total = _adjacency(edges)
    last = moved(nodes.join(of.withColumnRenamed("label", "c"), "id"), adjacent, total, 7, rounds=6)
    sizes = materialise(last.groupBy("c").agg(F.count("*").alias("n")), "sizes")
    rank = numbered(sizes, F.desc("n"), F.col("c")).select("c", F.col("row_idx").alias("label"))
    labels = materialise(last.select("id", "c").join(rank, "c").select("id", "label"), "labels")
    return labels.withColumn("q", F.lit(modularity(edges, labels).first().q))

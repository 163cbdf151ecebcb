"""Patterns of several runs merged: runs' examples get numbers of their own, and similar patterns collapse."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackmotif.operators import seqlets
from trackmotif.operators.kernels import Settings
from trackmotif.operators.ranking import numbered
from trackmotif.plans.collapse import COORDINATES, Collapse
from trackmotif.plans.discover import with_contributions
from trackmotif.session import materialise, ship_package


def union_of(runs: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Members (with run and pattern) and tracks of all runs, from (members, tracks) of each. Only examples that a member
    lies on are kept; they are numbered anew by run and number, without gaps."""
    members = tracks = None
    for k, (m, t) in enumerate(runs):
        m, t = m.withColumn("run", F.lit(k)), t.select("example_idx", "one_hot", "hyp").withColumn("run", F.lit(k))
        members = m if members is None else members.unionByName(m)
        tracks = t if tracks is None else tracks.unionByName(t)
    used = members.select("run", "example_idx").distinct()
    numbers = materialise(numbered(used, "run", "example_idx"), "examples").withColumnRenamed("row_idx", "to")
    renumber = lambda df: df.join(numbers, ["run", "example_idx"]).drop("example_idx").withColumnRenamed("to", "example_idx")
    return renumber(members), renumber(tracks)


def background_of(tracks: DataFrame) -> np.ndarray:
    """Frequencies of the bases over whole examples."""
    mean = tracks.select(F.posexplode(F.flatten("one_hot")).alias("k", "x")).groupBy((F.col("k") % 4).alias("b")).agg(F.avg("x").alias("f")).orderBy("b").collect()
    return np.array([r.f for r in mean])


def merge(runs: list[tuple[DataFrame, DataFrame]], settings: Settings | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members of the merged patterns, the tracks they lie on, and the merge tree (sign, level, node, children, n_seqlets).

    Nodes are numbered within a sign: leaves by run and pattern from 0, then merges in order. See ``collapse`` for how
    patterns merge.
    """
    s = settings or Settings(trim=20, initial_flank=5)
    spark = runs[0][0].sparkSession
    ship_package(spark)
    members, tracks = union_of(runs)
    members, tracks = materialise(members, "runs"), materialise(with_contributions(tracks), "run-tracks")
    leaves = members.select("sign", "run", "pattern_idx").distinct().orderBy("sign", "run", "pattern_idx").collect()
    scopes: dict[str, list[int]] = {}
    for k, r in enumerate(leaves):
        scopes.setdefault(r.sign, []).append(k)
    numbers = spark.createDataFrame([(*r, k) for k, r in enumerate(leaves)], "sign string, run int, pattern_idx int, number long")
    one = seqlets.distinct(members.join(F.broadcast(numbers), ["sign", "run", "pattern_idx"]), ["number", "example_idx", "start", "end"], "ord")
    state = Collapse(materialise(one.select("number", "ord", *COORDINATES), "leaves"), tracks, background_of(tracks), s)
    left = state.run(scopes)
    order = [(sign, k, number) for sign, found in left.items() for k, number in enumerate(found)]
    names = F.broadcast(spark.createDataFrame(order, "sign string, pattern_idx int, number long"))
    place = F.row_number().over(Window.partitionBy("number").orderBy("ord")) - 1
    out = state.members.withColumn("place", place.cast("long")).join(names, "number").select("sign", "pattern_idx", F.col("place").alias("ord"), *COORDINATES, F.lit(0).alias("subcluster"))
    node = {x: k for found in scopes.values() for k, x in enumerate(found)}
    tree = []
    for sign, level, number, children, n in state.history:
        node[number] = len(scopes[sign]) + sum(r[0] == sign for r in tree)
        tree.append((sign, level, node[number], [node[c] for c in children], n))
    return materialise(out, "merged"), tracks, spark.createDataFrame(tree, "sign string, level int, node long, children array<long>, n_seqlets long")

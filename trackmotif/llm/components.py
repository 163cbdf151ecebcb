"""Connected components of links between identifiers, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmotif.session import materialise


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(id, component_id) of every identifier that a link (a, b) names; component_id is the smallest one reachable.

    Links with a null side or to itself are ignored; no links give no rows. Every round joins each link to the smallest
    neighbour of its ends, which is aggregated before it is shuffled; a round's links replace the last one's as a table.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialise(pairs, "links")
    state = _state(edges)
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(small.union(low).distinct(), "links")
        new = _state(edges)
        if new == state:
            break
        state = new
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(edges.select("v", "v").distinct())

"""Greedy non-maximum suppression within each example, of any length.

An example's positions are cut into cells, and a cell is folded with a margin on both sides. What lies within the radius of
a margin's outer end may depend on candidates beyond it, and so may what lies near such a candidate and is weaker: these
are left open. Chains of dependence seldom reach from a margin's end to the cell; where one does, the example's open
cells are folded again with a margin eight times as wide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmotif.session import materialise

#: Positions of a cell at least, and margins as a multiple of the radius.
CELL, MARGIN = 8192, 64


def _folded(rows: DataFrame, radius: int, cell: int, margin: int) -> DataFrame:
    """example, cell, s, p, open of the picks of each cell, and of candidates that are open; rows are (example, pos, score)."""
    at = F.floor(F.col("pos") / cell)
    near = F.sequence(F.greatest(F.floor((F.col("pos") - margin) / cell), F.lit(0)), F.floor((F.col("pos") + margin) / cell))
    dealt = rows.withColumn("cell", F.explode(near))
    # A margin alone, beyond an example's last cell, decides nothing.
    entry = F.struct((-F.col("score")).alias("s"), F.col("pos").alias("p"))
    grouped = dealt.groupBy("example", "cell").agg(F.array_sort(F.collect_list(entry)).alias("c"), F.max(at == F.col("cell")).alias("own")).where("own")
    low, high = F.col("cell") * cell - margin, (F.col("cell") + 1) * cell + margin
    empty = F.array().cast("array<struct<s:double,p:bigint>>")

    def close(held: Column, x: Column) -> Column:
        return F.exists(held, lambda y: F.abs(y["p"] - x["p"]) <= radius)

    def step(state: Column, x: Column) -> Column:
        beyond = ((low > 0) & (x["p"] - radius < low)) | (x["p"] + radius >= high)
        more = F.struct(state["kept"].alias("kept"), F.concat(state["open"], F.array(x)).alias("open"))
        taken = F.struct(F.concat(state["kept"], F.array(x)).alias("kept"), state["open"].alias("open"))
        return F.when(close(state["kept"], x), state).when(beyond | close(state["open"], x), more).otherwise(taken)

    done = grouped.select("example", "cell", F.aggregate("c", F.struct(empty.alias("kept"), empty.alias("open")), step).alias("x"))
    named = lambda flag: lambda y: F.struct(y["s"].alias("s"), y["p"].alias("p"), F.lit(flag).alias("open"))
    each = F.concat(F.transform("x.kept", named(False)), F.transform("x.open", named(True)))
    return done.select("example", "cell", F.explode(each).alias("y")).select("example", "cell", "y.*").where(F.floor(F.col("p") / cell) == F.col("cell"))


def pick(df: DataFrame, radius: int, example: str = "example", pos: str = "pos", score: str = "score", cell: int | None = None, margin: int | None = None) -> DataFrame:
    """example, pick_ord, pos, score: largest first, each more than ``radius`` from all before; ties: lowest position.

    Positions count from 0. A cell's candidates are folded in one row, without Python; an example is as many rows as it
    has cells.
    """
    margin = margin or max(MARGIN * radius, 1)
    cell = cell or max(CELL, 4 * margin)
    rows = df.select(F.col(example).alias("example"), F.col(pos).cast("long").alias("pos"), F.col(score).cast("double").alias("score"))
    found = materialise(_folded(rows, radius, cell, margin), "picks")
    picks = found.where("not open")
    while (left := found.where("open").select("example").distinct()).limit(1).count():
        margin, cell = 8 * margin, max(cell, 32 * margin)
        picks = picks.join(left, "example", "left_anti")
        found = materialise(_folded(rows.join(left, "example", "left_semi"), radius, cell, margin), "picks")
        picks = picks.unionByName(found.where("not open"))
    place = F.row_number().over(Window.partitionBy("example").orderBy("s", "p")) - 1
    return picks.select(F.col("example").alias(example), place.cast("long").alias("pick_ord"), F.col("p").alias(pos), (-F.col("s")).alias(score))

"""Tracks and results of older layouts, landed as Parquet (their own container format has no reader here).

Layout A has a row an example with ``hyp_scores`` and ``input_seqs``, positions first; layout B ``shap_seq`` and
``raw_seq``, channels first. Older results name metaclusters by number and hold seqlets as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackmotif.functions import vec
from trackmotif.operators import seqlets

#: Columns of each layout: sequences and attributions.
LAYOUTS = {"A": ("input_seqs", "hyp_scores"), "B": ("raw_seq", "shap_seq")}
#: Metaclusters of older results.
SIGNS = {"metacluster_0": "pos", "metacluster_1": "neg"}


def turned(tensor: Column) -> Column:
    """Channels of positions as positions of channels."""
    return F.transform(F.sequence(F.lit(0), F.size(F.get(tensor, F.lit(0))) - 1), lambda p: F.transform(tensor, lambda row: F.get(row, p)))


def read_tracks(spark: SparkSession, path: str, window: int | None = None, layout: str | None = None) -> DataFrame:
    """example_idx, one_hot and hyp; the layout is A where its columns are there, else B."""
    rows = spark.read.parquet(path)
    layout = layout or ("A" if set(LAYOUTS["A"]) <= set(rows.columns) else "B")
    cast = lambda c: F.col(c).cast("array<array<double>>")
    shape = (lambda c: turned(cast(c))) if layout == "B" else cast
    crop = (lambda t: vec.centred_crop(t, window)) if window else (lambda t: t)
    hot, hyp = LAYOUTS[layout]
    return rows.select("example_idx", crop(shape(hot)).alias("one_hot"), crop(shape(hyp)).alias("hyp"))


def to_old(members: DataFrame) -> DataFrame:
    """metacluster, pattern, ord, subpattern, seqlet (as text) and alnmt (always 0), as older results have them."""
    name = F.element_at(F.create_map(*(F.lit(x) for k, v in SIGNS.items() for x in (v, k))), F.col("sign"))
    return members.select(name.alias("metacluster"), F.concat(F.lit("pattern_"), "pattern_idx").alias("pattern"), "ord", "subcluster", seqlets.to_string("example_idx", "start", "end", "is_revcomp").alias("seqlet"), F.lit(0).alias("alnmt"))


def from_old(rows: DataFrame) -> DataFrame:
    """Members from such rows; patterns are numbered as their names are."""
    sign = F.element_at(F.create_map(*(F.lit(x) for kv in SIGNS.items() for x in kv)), F.col("metacluster"))
    return rows.select(sign.alias("sign"), F.regexp_extract("pattern", r"(\d+)$", 1).cast("int").alias("pattern_idx"), F.col("ord").cast("long").alias("ord"), *seqlets.from_string("seqlet"), F.col("subcluster").cast("int").alias("subcluster"))


def convert(spark: SparkSession, old: str, new: str, tracks: DataFrame, window: int) -> None:
    """Older results (Parquet of ``to_old``'s columns) as new ones."""
    from trackmotif.sources import results

    results.save(from_old(spark.read.parquet(old)), tracks, new, window)


def convert_backward(spark: SparkSession, new: str, old: str) -> None:
    """New results as older ones: the seqlets as text, and the matrices of each pattern forward and reversed."""
    from trackmotif.sources import results

    to_old(results.members(spark, new)).write.parquet(f"{old}/seqlets")
    means = {"sequence": "ppm", "task0_contrib_scores": "cwm", "task0_hypothetical_contribs": "hcwm"}
    both = [x for n, c in means.items() for x in (F.col(c).alias(f"{n}_fwd"), vec.reverse_complement(F.col(c)).alias(f"{n}_rev"))]
    name = F.element_at(F.create_map(*(F.lit(x) for k, v in SIGNS.items() for x in (v, k))), F.col("sign"))
    results.patterns(spark, new).select(name.alias("metacluster"), F.col("name").alias("pattern"), F.lit("task0").alias("task_name"), *both).write.parquet(f"{old}/patterns")

"""Motif discovery end to end: tracks to windows, seqlets, neighbour graphs, clusters, patterns and results.

Everything up to the clusters is relational and keyed by sign, so that both signs run as one job. A cluster is folded
into its pattern in one task, which is bounded by ``max_seqlets`` seqlets a sign, and each example's tracks come to it once;
patterns merge by tasks of two (see ``collapse``). Each stage is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmotif.functions import vec
from trackmotif.operators import graph, knn, nms, seqlets, thresholds, windows
from trackmotif.operators.kernels import Settings, Tracks, cluster_pattern, fine_similarities, words
from trackmotif.session import materialise, ship_package

SIGNS = {"pos": 1, "neg": -1}
TENSORS = ("one_hot", "contrib", "hyp")
COORDINATES = pa.schema([("sign", pa.string()), ("cluster", pa.int64()), ("ord", pa.int64()), ("example_idx", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("is_revcomp", pa.bool_())])


def with_contributions(tracks: DataFrame) -> DataFrame:
    """example_idx and the three tensors, from one_hot and hyp."""
    cast = lambda c: F.col(c).cast("array<array<double>>").alias(c)
    rows = tracks.select(F.col("example_idx").cast("long").alias("example_idx"), cast("one_hot"), cast("hyp"))
    return rows.withColumn("contrib", vec.product(F.col("one_hot"), F.col("hyp")))


def extract(tracks: DataFrame, s: Settings) -> DataFrame:
    """sign, ord, example_idx, start, end, is_revcomp: at most ``max_seqlets`` of a sign that has more than
    ``min_metacluster``, in order of example and pick."""
    if s.flank < 1:
        raise ValueError("flank must be at least 1")
    scores = tracks.select("example_idx", F.posexplode(vec.row_sums(F.col("contrib"))).alias("pos", "value"))
    smoothed = materialise(windows.sliding_sum(scores, s.window, "example_idx"), "smoothed")
    t = thresholds.thresholds(smoothed, fdr=s.fdr, weak=s.weak, least=s.min_passing, most=s.max_passing)
    radius = int(0.5 * s.window) + s.flank
    picks = nms.pick(windows.candidates(smoothed, t["high"], t["low"], s.flank, "example_idx"), radius, "example_idx")
    core = picks.join(smoothed.select("example_idx", "pos", "total"), ["example_idx", "pos"])
    signed = seqlets.split_by_sign(core, "total", t["sign"])
    kept = seqlets.first_of_each_sign(seqlets.large_enough(signed, s.min_metacluster), s.max_seqlets, "example_idx", "pick_ord")
    return kept.select("sign", "ord", "example_idx", (F.col("pos") - s.flank).alias("start"), (F.col("pos") + s.window + s.flank).alias("end"), F.lit(False).alias("is_revcomp"))


def tensors(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    """Each row of an array<array<double>> column as (positions, 4)."""
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = rows.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
    ends = np.cumsum(rows.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(flat, ends[:-1]) if len(rows) else []


def coarse(found: DataFrame, s: Settings) -> DataFrame:
    """sign, i, j, rank, sim: neighbours by words in common, on either strand; ids are ``ord``. Rows with too few such
    neighbours get the smallest other ids at similarity 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sign, ord_, hot, hyp in zip(batch.column("sign").to_pylist(), batch.column("ord").to_pylist(), tensors(batch.column("one_hot")), tensors(batch.column("hyp")), strict=True):
                own = hyp * hot * SIGNS[sign]
                for strand, (a, b) in enumerate(((own, hot), (own[::-1, ::-1], hot[::-1, ::-1]))):
                    key, value = words(a, b)
                    norm = np.linalg.norm(value)
                    if norm > 0:
                        n = len(key)
                        yield pa.RecordBatch.from_arrays([pa.array([sign] * n), pa.array([ord_] * n, pa.int64()), pa.array([strand] * n, pa.int32()), pa.array(key), pa.array(value / norm)], names=["sign", "id", "strand", "word", "value"])

    rows = materialise(found.select("sign", "ord", "one_hot", "hyp").mapInArrow(run, "sign string, id long, strand int, word long, value double"), "words")
    key, word = F.col("id") * 2 + (F.col("sign") == "neg").cast("long"), F.xxhash64("sign", "word").alias("word")
    own = rows.where("strand = 0").select(key.alias("i"), word, "value")
    near = knn.by_words(own, rows.select(key.alias("j"), F.col("strand").alias("part"), word, "value"), s.neighbours + 1, 12)
    near = near.select(F.when(F.col("i") % 2 == 1, "neg").otherwise("pos").alias("sign"), F.shiftright("i", 1).alias("i"), F.shiftright("j", 1).alias("j"), "sim")
    near = near.withColumn("sim", F.greatest("sim", F.lit(0.0)))
    return knn.filled(materialise(near, "near"), found.select("sign", F.col("ord").alias("id")), s.neighbours + 1, "sign")


def fine(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` and their similarity at the best place and strand, as fine."""
    own = found.select("sign", "ord", "contrib", "hyp")
    a = own.select("sign", F.col("ord").alias("i"), F.col("contrib").alias("ci"), F.col("hyp").alias("hi"))
    b = own.select("sign", F.col("ord").alias("j"), F.col("contrib").alias("cj"), F.col("hyp").alias("hj"))
    joined = pairs.join(a, ["sign", "i"]).join(b, ["sign", "j"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = fine_similarities(*(tensors(batch.column(c)) for c in ("ci", "hi", "cj", "hj")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("sign", "i", "j", "rank", "sim")), pa.array(value, pa.float64())], names=["sign", "i", "j", "rank", "sim", "fine"])

    return joined.select("sign", "i", "j", "rank", "sim", "ci", "hi", "cj", "hj").mapInArrow(run, "sign string, i long, j long, rank long, sim double, fine double")


def clustered(found: DataFrame, s: Settings, filtered: bool) -> DataFrame:
    """sign, ord, cluster of the seqlets that stay in the graph."""
    pairs = materialise(fine(found, coarse(found, s)), "pairs")
    key = lambda c: F.struct("sign", F.col(c).alias("id")).alias(c)
    rows = pairs.select(key("i"), key("j"), "sim", F.round("fine", 9).alias("fine"))
    if filtered:
        rows = knn.correlated(rows.withColumn("sim", F.round("sim", 9)), "fine", "sim", s.correlation)
    edges = graph.symmetric(rows.select("i", "j", graph.distance("fine").alias("d")))
    adapted = materialise(graph.density_adapted(edges, s.perplexity), "graph")
    plain = adapted.select(F.col("i.sign").alias("sign"), F.col("i.id").alias("i"), F.col("j.id").alias("j"), "w")
    return graph.communities(plain, "sign", s.seeds).select("sign", F.col("id").alias("ord"), F.col("label").alias("cluster"))


def held(part: pa.Table) -> Tracks:
    """The tracks of a table of example_idx, one_hot and hyp."""
    ids = part["example_idx"].to_pylist()
    hot, hyp = (dict(zip(ids, tensors(part[c]), strict=True)) for c in ("one_hot", "hyp"))
    return Tracks(hot, {k: hot[k] * hyp[k] for k in ids}, hyp, len(next(iter(hot.values()))) if ids else 0)


def seqlets_of(part: pa.Table) -> list:
    return list(zip(*(part[c].to_pylist() for c in ("example_idx", "start", "end", "is_revcomp")), strict=True))


def folded(rows: DataFrame, tracks: DataFrame, keys: list[str], fold: Callable[[pa.Table, Tracks], pa.Table], schema: str) -> DataFrame:
    """``fold`` of each group of seqlets and the tracks of its examples, each of which comes along once."""
    needed = rows.select(*keys, "example_idx").distinct().join(tracks.select("example_idx", "one_hot", "hyp"), "example_idx")
    needed = needed.select(*(F.col(c).alias(c) for c in needed.columns))  # attributes of its own beside those of rows
    return rows.groupBy(*keys).cogroup(needed.groupBy(*keys)).applyInArrow(lambda own, examples: fold(own, held(examples)), schema)


def patterns_of(rows: DataFrame, tracks: DataFrame, background: np.ndarray, s: Settings) -> DataFrame:
    """The coordinates of each cluster's pattern, in its order."""

    def run(part: pa.Table, tracks: Tracks) -> pa.Table:
        sign, cluster = part["sign"][0].as_py(), part["cluster"][0].as_py()
        p = cluster_pattern(tracks, seqlets_of(part), SIGNS[sign], background, s)
        found = [(sign, cluster, n, *x) for n, x in enumerate(p.seqlets)] if p is not None else []
        return pa.Table.from_arrays([pa.array([r[k] for r in found], f.type) for k, f in enumerate(COORDINATES)], schema=COORDINATES)

    return folded(rows, tracks, ["sign", "cluster"], run, "sign string, cluster long, ord long, example_idx long, start long, end long, is_revcomp boolean")


def background_of(found: DataFrame) -> np.ndarray:
    mean = found.select(F.posexplode(F.flatten("one_hot")).alias("k", "x")).groupBy((F.col("k") % 4).alias("b")).agg(F.avg("x").alias("f")).orderBy("b").collect()
    return np.array([r.f for r in mean])


RESULT = pa.schema([("sign", pa.string()), ("pattern_idx", pa.int32()), ("ord", pa.int64()), ("example_idx", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("is_revcomp", pa.bool_()), ("subcluster", pa.int32())])


def discover(tracks: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The members of every final pattern: sign, pattern_idx (by size), ord, coordinates, strand and subcluster."""
    from trackmotif.plans import collapse

    s = settings or Settings()
    ship_package(tracks.sparkSession)
    tracks = materialise(with_contributions(tracks), "tracks")
    rows = materialise(extract(tracks, s), "seqlets")
    for round_ in (1, 2):
        found = materialise(seqlets.slices(rows, tracks), "slices")
        background = background_of(found)
        labels = clustered(found, s, filtered=round_ == 1)
        members = rows.join(labels, ["sign", "ord"])
        patterns = materialise(patterns_of(members, tracks, background, s), "patterns")
        if round_ == 1:
            one = seqlets.distinct(patterns.withColumn("_o", F.struct("cluster", "ord")), ["sign", "example_idx", "start", "end"], "_o")
            numbered = seqlets.first_of_each_sign(one.withColumnRenamed("ord", "place"), 1 << 30, "cluster", "place")
            rows = materialise(numbered.select("sign", "ord", "example_idx", "start", "end", "is_revcomp"), "seqlets")
    return materialise(collapse.finished(patterns, tracks, background, s), "members")


def summarised(members: DataFrame, tracks: DataFrame, *by: str) -> DataFrame:
    """sign, pattern_idx (and more columns ``by``), length, n_seqlets and the mean matrices ppm, cwm and hcwm."""
    from trackmotif.operators import patterns as ops

    keys = ("sign", "pattern_idx", *by)
    found = seqlets.slices(members, with_contributions(tracks)).withColumn("pattern", F.struct(*keys))
    means = ops.matrices(ops.means(found.select("pattern", *TENSORS), "pattern", *TENSORS), "pattern", *TENSORS)
    sizes = found.groupBy("pattern").agg(F.count("*").alias("n_seqlets"))
    return means.join(sizes, "pattern").select(*(f"pattern.{k}" for k in keys), F.size("one_hot").alias("length"), "n_seqlets", F.col("one_hot").alias("ppm"), F.col("contrib").alias("cwm"), F.col("hyp").alias("hcwm"))

"""Motifs matched with a database: every offset of both strands, by distance or correlation of columns, with p-values.

A pair of columns scores 0 to 100: from the largest Euclidean distance that two columns of probabilities can have down to
0, or from a Pearson correlation of -1 up to 1. A
query's null distribution is that of the sum of as many scores as columns overlap, each drawn from all database columns on
both strands. The least p-value over offsets and strands counts, corrected for how many were tried.

The database is dealt to blocks of bounded size. Each query meets each block in two passes: one counts scores for the null
distributions, one places the query on the block's motifs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmotif.functions import vec
from trackmotif.session import materialise, ship_package

SCORES, MIN_OVERLAP, BLOCK_MOTIFS = 101, 5, 2000


def _euclidean(query: np.ndarray, target: np.ndarray) -> np.ndarray:
    return 1 - np.sqrt(np.maximum(((query[:, None, :] - target[None, :, :]) ** 2).sum(axis=2), 0.0)) / np.sqrt(2)


def _pearson(query: np.ndarray, target: np.ndarray) -> np.ndarray:
    a, b = (x - x.mean(axis=1, keepdims=True) for x in (query, target))
    sizes = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)
    return (1 + np.divide(a @ b.T, sizes, out=np.zeros_like(sizes), where=sizes > 1e-12)) / 2


#: What two columns have in common, from 0 to 1, by name.
COLUMNS = {"euclidean": _euclidean, "pearson": _pearson}


def column_scores(query: np.ndarray, target: np.ndarray, columns: str = "euclidean") -> np.ndarray:
    """Integer score of each pair of columns, (query positions, target positions)."""
    return np.clip(np.floor(COLUMNS[columns](query, target) * (SCORES - 1) + 1e-9), 0, SCORES - 1).astype(np.int64)


def null_tails(counts: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """For each span [first, last) of query positions: p-value by score, from how often each position has each score."""
    share = counts / counts.sum(axis=1, keepdims=True)
    out = {}
    for a in range(len(share)):
        row = np.ones(1)
        for b in range(a, len(share)):
            row = np.convolve(row, share[b])
            out[a, b + 1] = np.minimum(np.cumsum(row[::-1])[::-1], 1.0)
    return out


def places(n: int, m: int, least: int) -> list[int]:
    """Offsets (of the query on the target) at which at least ``least`` columns overlap, or all of the shorter one."""
    need = min(least, n, m)
    return [o for o in range(-n + 1, m) if min(n, m - o) - max(0, -o) >= need]


def best_place(query: np.ndarray, target: np.ndarray, tails: dict, least: int = MIN_OVERLAP, columns: str = "euclidean") -> tuple[float, int, int, int, str]:
    """p-value, score, offset, overlap and strand; of equals the + strand, then the first offset."""
    offsets = places(len(query), len(target), least)
    found = []
    for strand, own in (("+", target), ("-", target[::-1, ::-1])):
        scores = column_scores(query, own, columns)
        for o in offsets:
            a, b = max(0, -o), min(len(query), len(target) - o)
            total = int(scores[np.arange(a, b), np.arange(a, b) + o].sum())
            found.append((float(tails[a, b][total]), -total, strand == "-", o, b - a))
    p, score, reverse, o, overlap = min(found)
    return -np.expm1(2 * len(offsets) * np.log1p(-min(p, 1 - 1e-16))), -score, o, overlap, "-" if reverse else "+"


def _matrix(value: pa.Scalar) -> np.ndarray:
    return np.array(value.as_py(), float).reshape(-1, 4)


def matches(queries: DataFrame, database: DataFrame, n: int = 3, least: int = MIN_OVERLAP, block_motifs: int = BLOCK_MOTIFS, columns: str = "euclidean", most_e: float | None = None) -> DataFrame:
    """query, rank, target, p, e, score, offset, overlap, strand: the ``n`` best motifs of ``database`` for each query.

    Columns compare by Euclidean distance or by Pearson correlation (one that is all equal correlates with none); e is the
    p-value times the motifs of the database, of which those above ``most_e``, where it is set, are no match.

    Both have name and pwm (array<array<double>>). Ties go to the larger score, then the smaller name. Motifs without
    positions and null names are left out; an empty database gives no rows.
    """
    if columns not in COLUMNS:
        raise ValueError(f"columns compare by {' or '.join(COLUMNS)}")
    ship_package(queries.sparkSession)
    clean = lambda df: df.where("name is not null and size(pwm) > 0").select("name", F.col("pwm").cast("array<array<double>>").alias("pwm"))
    db = clean(database).dropDuplicates(["name"])
    size = db.count()
    blocks = max(1, -(-size // block_motifs))
    dealt = db.groupBy(F.pmod(F.xxhash64("name"), F.lit(blocks)).alias("block")).agg(F.array_sort(F.collect_list(F.struct("name", "pwm"))).alias("motifs"))
    asked = clean(queries).select(F.col("name").alias("query"), F.col("pwm").alias("q"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    pairs = materialise(asked.join(dealt, "block"), "motif-blocks")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                q, motifs = _matrix(batch.column("q")[k]), batch.column("motifs")[k].as_py()
                every = np.concatenate([np.array(m["pwm"], float).reshape(-1, 4) for m in motifs])
                scores = np.concatenate([column_scores(q, x, columns) for x in (every, every[:, ::-1])], axis=1)
                at, score = np.repeat(np.arange(len(q)), scores.shape[1]), scores.ravel()
                cell, times = np.unique(at * SCORES + score, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("query")[k].as_py()] * len(cell)), pa.array(cell), pa.array(times)], names=["query", "cell", "times"])

    counts = pairs.select("query", "q", "motifs").mapInArrow(count, "query string, cell long, times long").groupBy("query", "cell").agg(F.sum("times").alias("times"))
    nulls = counts.groupBy("query").agg(F.collect_list(F.struct("cell", "times")).alias("cells"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                q = _matrix(batch.column("q")[k])
                cells = np.zeros((len(q), SCORES))
                for c in batch.column("cells")[k].as_py():
                    cells[divmod(c["cell"], SCORES)] = c["times"]
                tails = null_tails(cells)
                rows = [(m["name"], *best_place(q, np.array(m["pwm"], float).reshape(-1, 4), tails, least, columns)) for m in batch.column("motifs")[k].as_py()]
                name, p, score, offset, overlap, strand = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("query")[k].as_py()] * len(rows)), pa.array(name), pa.array(p), pa.array(score, pa.int64()), pa.array(offset, pa.int32()), pa.array(overlap, pa.int32()), pa.array(strand)],
                    names=["query", "target", "p", "score", "offset", "overlap", "strand"],
                )

    found = pairs.join(nulls, "query").select("query", "q", "motifs", "cells").mapInArrow(place, "query string, target string, p double, score long, offset int, overlap int, strand string")
    found = found.withColumn("e", F.col("p") * size)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("p", F.desc("score"), "target"))
    kept = found if most_e is None else found.where(F.col("e") <= most_e)
    return kept.withColumn("rank", rank).where(F.col("rank") <= n).select("query", "rank", "target", "p", "e", "score", "offset", "overlap", "strand")


def trimmed(pwm: Column, cwm: Column, share: float = 0.3, before: int = 0, after: int = 0) -> Column:
    """The motif's positions from the first to the last whose total contribution is at least ``share`` of the largest,
    with ``before`` and ``after`` more, as far as there are."""
    first, last = vec.trim_bounds(F.transform(cwm, lambda r: F.aggregate(r, F.lit(0.0), lambda s, x: s + F.abs(x))), share)
    start = F.greatest(first - before, F.lit(0))
    return F.slice(pwm, start + 1, F.least(last + after + 1, F.size(pwm)) - start)


def descriptive_names(found: DataFrame, tags: DataFrame, characters: int = 10, most: int = 3) -> DataFrame:
    """tag, name: the first characters of a pattern's best matches, joined; the tag itself where there is no match.

    ``found`` has query, rank and target; ``tags`` has tag."""
    listed = found.where(F.col("rank") <= most).groupBy(F.col("query").alias("tag")).agg(F.array_sort(F.collect_list(F.struct("rank", "target"))).alias("m"))
    name = F.array_join(F.transform("m", lambda x: F.substring(F.trim(x["target"]), 1, characters)), ";")
    return tags.select("tag").join(listed, "tag", "left").select("tag", F.coalesce(name, F.col("tag")).alias("name"))

"""Queries of gapped words, neighbour searches, alignments and graphs over the E-track."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from trackmotif.functions import align, kmers, vec
from trackmotif.operators import graph, kernels, knn
from trackmotif.plans.bindings import E_SQL, e_track
from trackmotif.session import materialise, ship_package

SITES, SPAN, ENTRIES, K, PERPLEXITY, OVERLAP = 6, 8, 10, 5, 3.0, 0.7
#: Rows of a label that meet those of another block at once.
BLOCK = 500
#: Pairs that are aligned at once.
ALIGNED = 1_000
CHOICE = {"min_k": 2, "max_k": 3, "max_len": SPAN, "max_gap": SPAN}
r6 = lambda c: F.round(c, 6)


def _sites(spark, sf_dir, tensor="contrib", hot="one_hot"):
    rows = e_track(spark, sf_dir)
    base = F.transform(hot, lambda row: F.array_position(row, F.array_max(row)).cast("int") - 1)
    return rows.select("vec_id", "label", kmers.top_sites(vec.row_sums(F.col(tensor)), base, SITES).alias("sites"))


def _words(spark, sf_dir, entries=ENTRIES):
    return kmers.word_scores(_sites(spark, sf_dir), "sites", "vec_id", entries, **CHOICE)


def gkmer_scores(spark, sf_dir):
    return _words(spark, sf_dir, 10_000).select("vec_id", "word", r6("value").alias("value"))


def gkmer_topk(spark, sf_dir):
    return _words(spark, sf_dir).select("vec_id", "word", r6("value").alias("value"))


def l2_normalise(spark, sf_dir):
    return knn.normalised(_words(spark, sf_dir), "vec_id").select("vec_id", "word", r6("value").alias("value"))


def _neighbours(spark, sf_dir):
    rows = knn.normalised(_words(spark, sf_dir), "vec_id")
    pairs = knn.sparse_dot(rows, rows, "vec_id").select("i", "j", F.col("dot").alias("sim"))
    return knn.top_k(pairs, K, F.round("sim", 9))


def _near(spark, sf_dir):
    """``_neighbours`` without a shuffle of all pairs."""
    rows = knn.normalised(_words(spark, sf_dir), "vec_id").withColumnRenamed("vec_id", "i")
    return materialise(knn.of_all(rows, None, K), "near")


def sparse_cosine_knn(spark, sf_dir):
    return _near(spark, sf_dir).select("i", "j", "rank", r6("sim").alias("sim"))


def _features(spark, sf_dir):
    flat = lambda t: vec.l1(vec.flatten(F.col(t)))
    rows = e_track(spark, sf_dir).withColumn("rev", vec.reverse_complement(F.col("contrib")))
    return rows.select("vec_id", "label", flat("contrib").alias("fwd"), flat("rev").alias("rev"))


def _blocks(spark, sf_dir):
    """The vectors of each label in blocks of at most about ``BLOCK`` rows, so that no label is one task's."""
    rows = _features(spark, sf_dir)
    count = rows.groupBy("label").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.lit(1)).alias("of"))
    dealt = rows.join(F.broadcast(count), "label").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("of")))
    return dealt.groupBy("label", "block").agg(F.collect_list("vec_id").alias("ids"), F.collect_list("fwd").alias("x"))


def jaccard_knn(spark, sf_dir):
    """Of all vectors of a label, as subclustering compares them: a task has a pair of blocks and keeps each row's best."""
    ship_package(spark)
    blocks = materialise(_blocks(spark, sf_dir), "blocks")
    other = blocks.select("label", F.col("ids").alias("ids2"), F.col("x").alias("y"), F.col("block").alias("block2"))
    pairs = blocks.join(other, "label").repartition("label", "block", "block2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                i, j = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("ids", "ids2"))
                x, y = (batch.column(c)[k].values.flatten().to_numpy(zero_copy_only=False).reshape(-1, 64) for c in ("x", "y"))
                sims = kernels.similarities(x, y)
                order = np.argsort(j, kind="stable")
                best = order[np.argsort(-np.round(sims[:, order], 9), axis=1, kind="stable")[:, :K]]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(i, best.shape[1])), pa.array(j[best].ravel()), pa.array(np.take_along_axis(sims, best, axis=1).ravel())], names=["i", "j", "sim"])

    found = pairs.select("ids", "x", "ids2", "y").mapInArrow(run, "i long, j long, sim double")
    return knn.top_k(found, K, F.round("sim", 9)).select("i", "j", "rank", r6("sim").alias("sim"))


def _aligned(spark, sf_dir, metric):
    ship_package(spark)
    rows = _features(spark, sf_dir)
    pairs = _near(spark, sf_dir).select("i", "j")
    a = rows.select(F.col("vec_id").alias("i"), F.col("fwd").alias("x"))
    b = rows.select(F.col("vec_id").alias("j"), F.col("fwd").alias("f"), F.col("rev").alias("r"))
    pad = align.padding(16, OVERLAP, "floor" if metric == "jaccard" else "ceil")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ALIGNED):
                batch = whole.slice(start, ALIGNED)
                x, f, r = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, 16, 4) for c in ("x", "f", "r"))
                found = np.stack([np.round(kernels.slides(q, x, pad, metric), 9) for q in (f, r)])
                best, row = found.max(axis=2), np.arange(len(x))
                turned = (best[1] > best[0]).astype(int)
                at = found[turned, row].argmax(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("j"), pa.array(best[turned, row]), pa.array((at - pad).astype("int32")), pa.array(turned == 1)], names=["i", "j", "score", "offset", "is_revcomp"])

    found = pairs.join(a, "i").join(b, "j").select("i", "j", "x", "f", "r").mapInArrow(run, "i long, j long, score double, offset int, is_revcomp boolean")
    return found.select("i", "j", r6("score").alias("score"), "offset", "is_revcomp")


def sliding_jaccard_best(spark, sf_dir):
    return _aligned(spark, sf_dir, "jaccard")


def sliding_cosine_best(spark, sf_dir):
    return _aligned(spark, sf_dir, "cosine")


def _both(spark, sf_dir):
    fine = _features(spark, sf_dir)
    a, b = fine.select(F.col("vec_id").alias("i"), F.col("fwd").alias("x")), fine.select(F.col("vec_id").alias("j"), F.col("fwd").alias("y"))
    pairs = _near(spark, sf_dir).select("i", "j", F.round("sim", 9).alias("coarse"))
    return materialise(pairs.join(a, "i").join(b, "j").select("i", "j", "coarse", F.round(vec.jaccard(F.col("x"), F.col("y")), 9).alias("fine")), "fine")


def spearman_rows(spark, sf_dir):
    return knn.spearman(_both(spark, sf_dir), "fine", "coarse").where("rho is not null").select("i", (r6("rho") + F.lit(0.0)).alias("rho"))


def spearman_filter(spark, sf_dir):
    return knn.correlated(_both(spark, sf_dir), "fine", "coarse", 0.151).select("i", "j", r6("fine").alias("fine"))


def _distances(spark, sf_dir):
    """Of the neighbours by words, by their fine similarity, as discovery's graph has them."""
    return _both(spark, sf_dir).select("i", "j", F.round(graph.distance("fine"), 9).alias("d"))


def sim_to_distance(spark, sf_dir):
    return _distances(spark, sf_dir).select("i", "j", r6("d").alias("d"))


def symmetrise_edges(spark, sf_dir):
    return graph.symmetric(_distances(spark, sf_dir)).select("i", "j", r6("d").alias("d"))


def perplexity_beta(spark, sf_dir):
    found = graph.precisions(graph.symmetric(_distances(spark, sf_dir)), PERPLEXITY)
    return found.select("i", r6("beta").alias("beta"), r6("norm").alias("norm"))


def density_weights(spark, sf_dir):
    found = graph.density_adapted(graph.symmetric(_distances(spark, sf_dir)), PERPLEXITY)
    return found.select("i", "j", r6("w").alias("w"))


def modularity_of_labels(spark, sf_dir):
    edges = _near(spark, sf_dir).select("i", "j", F.col("sim").alias("w"))
    labels = e_track(spark, sf_dir).select(F.col("vec_id").alias("id"), "label")
    return graph.modularity(edges, labels).select(r6("q").alias("q"))


def leiden_labels(spark, sf_dir):
    edges = _near(spark, sf_dir).select("i", "j", F.round("sim", 9).alias("w"))
    return graph.communities(edges).select("id", "label", r6("q").alias("q"))


_WORDS = (
    E_SQL
    + f""", p AS (SELECT vec_id, pos, sum(contrib) AS score, max(base) FILTER (one = 1) AS base FROM c GROUP BY vec_id, pos),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, pos) AS k FROM p) WHERE k <= {SITES}),
w2 AS (SELECT a.vec_id, (a.base + 1 + (b.base + 1) * (5 ** (b.pos - a.pos)))::BIGINT AS word, (a.score + b.score) / 2 AS value FROM s a JOIN s b ON a.vec_id = b.vec_id AND b.pos > a.pos AND b.pos - a.pos < {SPAN}),
w3 AS (SELECT a.vec_id, (a.base + 1 + (b.base + 1) * (5 ** (b.pos - a.pos)) + (d.base + 1) * (5 ** (d.pos - a.pos)))::BIGINT AS word, (a.score + b.score + d.score) / 3 AS value
  FROM s a JOIN s b ON a.vec_id = b.vec_id AND b.pos > a.pos JOIN s d ON a.vec_id = d.vec_id AND d.pos > b.pos AND d.pos - a.pos < {SPAN}),
allw AS (SELECT vec_id, word, sum(value) AS value FROM (FROM w2 UNION ALL FROM w3) GROUP BY vec_id, word),
topw AS (SELECT vec_id, word, value FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(round(value, 9)) DESC, word) AS k FROM allw) WHERE k <= {ENTRIES}),
nw AS (SELECT vec_id, word, value / sqrt(sum(value * value) OVER (PARTITION BY vec_id)) AS value FROM topw),
dots AS (SELECT a.vec_id AS i, b.vec_id AS j, sum(a.value * b.value) AS sim FROM nw a JOIN nw b USING (word) GROUP BY 1, 2),
knn AS (SELECT i, j, rank, sim FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(sim, 9) DESC, j)::BIGINT AS rank FROM dots) WHERE rank <= {K})"""
)
_FLAT = """, flat AS (SELECT vec_id, label, pos * 4 + base AS k, (15 - pos) * 4 + 3 - base AS rk, contrib / sum(abs(contrib)) OVER (PARTITION BY vec_id) AS x FROM c)"""
_JAC = """, jac AS (SELECT a.vec_id AS i, b.vec_id AS j, coalesce(sum(least(abs(a.x), abs(b.x)) * sign(a.x) * sign(b.x)) / nullif(sum(greatest(abs(a.x), abs(b.x))), 0), 0) AS sim
  FROM flat a JOIN flat b ON a.label = b.label AND a.k = b.k GROUP BY 1, 2)"""
_JKNN = f", jk AS (SELECT i, j, rank, sim FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(sim, 9) DESC, j)::BIGINT AS rank FROM jac) WHERE rank <= {K})"
_DIST = ", dist AS (SELECT i, j, round(greatest(ln(2.0::DOUBLE / greatest(fine, 1e-7) - 1), 0), 9) AS d FROM fine)"
_SYM = ", sym AS (SELECT i, j, avg(d) AS d FROM (SELECT i, j, d FROM dist WHERE d > 0 UNION ALL SELECT j, i, d FROM dist WHERE d > 0) GROUP BY i, j)"


def _align_sql(metric: str) -> str:
    pad = align.padding(16, OVERLAP, "floor" if metric == "jaccard" else "ceil")
    score = (
        "coalesce(sum(least(abs(q), abs(t)) * sign(q) * sign(t)) / nullif(sum(greatest(abs(q), abs(t))), 0), 0)"
        if metric == "jaccard"
        else "coalesce(sum(q * t) / nullif(sqrt(sum(q * q)) * sqrt(sum(t * t)), 0), 0)"
    )
    return (
        _WORDS
        + _FLAT
        + f""", strands AS (SELECT vec_id, k, x, false AS rc FROM flat UNION ALL SELECT vec_id, rk, x, true FROM flat),
    al AS (SELECT knn.i, knn.j, rc, o.o, b.x AS q, coalesce(t.x, 0) AS t FROM knn JOIN strands b ON b.vec_id = knn.j CROSS JOIN range(-{pad}, {pad} + 1) o(o)
      LEFT JOIN flat t ON t.vec_id = knn.i AND t.k = b.k + o.o * 4),
    sc AS (SELECT i, j, rc, o, round({score}, 9) AS score FROM al GROUP BY i, j, rc, o)
    SELECT i, j, round(score, 6) AS score, o::INT AS "offset", rc AS is_revcomp FROM (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY score DESC, rc, o) AS k FROM sc) WHERE k = 1"""
    )


_BOTH = _FLAT + """, fine AS (SELECT knn.i, knn.j, round(knn.sim, 9) AS coarse, round(coalesce(sum(least(abs(a.x), abs(b.x)) * sign(a.x) * sign(b.x)) / nullif(sum(greatest(abs(a.x), abs(b.x))), 0), 0), 9) AS fine
  FROM knn JOIN flat a ON a.vec_id = i JOIN flat b ON b.vec_id = j AND a.k = b.k GROUP BY knn.i, knn.j, knn.sim)"""


def _rho(source: str) -> str:
    rank = lambda c: f"rank() OVER (PARTITION BY i ORDER BY {c}) + (count(*) OVER (PARTITION BY i, {c}) - 1) / 2.0::DOUBLE"
    return f", ranked AS (SELECT i, {rank('fine')} AS rx, {rank('coarse')} AS ry FROM {source}), rho AS (SELECT i, covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) AS rho FROM ranked GROUP BY i)"


_BETA = f""", rowsd AS (SELECT i, list(d ORDER BY d) AS ds FROM sym GROUP BY i),
bis AS (SELECT i, ds, 0 AS step, 1.0::DOUBLE AS beta, '-infinity'::DOUBLE AS low, 'infinity'::DOUBLE AS high, false AS done FROM rowsd UNION ALL
  SELECT i, ds, step + 1, CASE WHEN ok THEN beta WHEN gap > 0 THEN CASE WHEN isinf(high) THEN beta * 2 ELSE (beta + high) / 2 END ELSE CASE WHEN isinf(low) THEN beta / 2 ELSE (beta + low) / 2 END END,
    CASE WHEN NOT ok AND gap > 0 THEN beta ELSE low END, CASE WHEN NOT ok AND gap <= 0 THEN beta ELSE high END, ok
  FROM (SELECT *, abs(gap) <= 1e-5 AS ok FROM (SELECT *, ln(p) + beta * dp / p - ln({PERPLEXITY}) AS gap FROM (SELECT *, 1 + list_sum(list_transform(ds, lambda d: exp(-d * beta))) AS p, list_sum(list_transform(ds, lambda d: d * exp(-d * beta))) AS dp FROM bis WHERE step < 100 AND NOT done))) x),
betas AS (SELECT i, ds, arg_max(beta, step) AS beta FROM bis GROUP BY i, ds),
norms AS (SELECT i, beta, 1 + list_sum(list_transform(ds, lambda d: exp(-d / beta))) AS norm FROM betas)"""
_GRAPH = (_WORDS + _BOTH + _DIST + _SYM).replace("WITH t", "WITH RECURSIVE t", 1)

QUERIES = {
    "gkmer_scores": (gkmer_scores, _WORDS + " SELECT vec_id, word, round(value, 6) AS value FROM allw"),
    "gkmer_topk": (gkmer_topk, _WORDS + " SELECT vec_id, word, round(value, 6) AS value FROM topw"),
    "l2_normalise": (l2_normalise, _WORDS + " SELECT vec_id, word, round(value, 6) AS value FROM nw"),
    "sparse_cosine_knn": (sparse_cosine_knn, _WORDS + " SELECT i, j, rank, round(sim, 6) AS sim FROM knn"),
    "jaccard_knn": (jaccard_knn, E_SQL + _FLAT + _JAC + _JKNN + " SELECT i, j, rank, round(sim, 6) AS sim FROM jk"),
    "sliding_jaccard_best": (sliding_jaccard_best, _align_sql("jaccard")),
    "sliding_cosine_best": (sliding_cosine_best, _align_sql("cosine")),
    "spearman_rows": (spearman_rows, _WORDS + _BOTH + _rho("fine") + " SELECT i, round(rho, 6) + 0.0::DOUBLE AS rho FROM rho WHERE rho IS NOT NULL AND NOT isnan(rho)"),
    "spearman_filter": (
        spearman_filter,
        _WORDS + _BOTH + _rho("(SELECT * FROM fine WHERE abs(fine) > 0)") + " SELECT i, j, round(fine, 6) AS fine FROM fine WHERE i IN (SELECT i FROM rho WHERE rho > 0.151 AND NOT isnan(rho)) AND j IN (SELECT i FROM rho WHERE rho > 0.151 AND NOT isnan(rho))",
    ),
    "sim_to_distance": (sim_to_distance, _WORDS + _BOTH + _DIST + " SELECT i, j, round(d, 6) AS d FROM dist"),
    "symmetrise_edges": (symmetrise_edges, _WORDS + _BOTH + _DIST + _SYM + " SELECT i, j, round(d, 6) AS d FROM sym"),
    "perplexity_beta": (perplexity_beta, _GRAPH + _BETA + " SELECT i, round(beta, 6) AS beta, round(norm, 6) AS norm FROM norms"),
    "density_weights": (
        density_weights,
        _GRAPH + _BETA + " SELECT sym.i, sym.j, round(sqrt(exp(-d / a.beta) / a.norm * exp(-d / b.beta) / b.norm), 6) AS w FROM sym JOIN norms a ON a.i = sym.i JOIN norms b ON b.i = sym.j UNION ALL SELECT i, i, round(1 / norm, 6) FROM norms",
    ),
    "modularity_of_labels": (
        modularity_of_labels,
        _WORDS + """, ed AS (SELECT sim AS w, a.label AS li, b.label AS lj FROM knn JOIN embeddings a ON a.vec_id = i JOIN embeddings b ON b.vec_id = j),
        ends AS (SELECT label, sum(w) AS k FROM (SELECT li AS label, w FROM ed UNION ALL SELECT lj, w FROM ed) GROUP BY label)
        SELECT round((SELECT sum(w) FILTER (li = lj) / sum(w) FROM ed) - (SELECT sum(k * k) FROM ends) / (4 * (SELECT sum(w) FROM ed) ** 2), 6) AS q""",
    ),
    "leiden_labels": (leiden_labels, None),
}

"""Pruned neighbours against ranking all products."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackmotif import catalog
from trackmotif.operators import kernels, knn
from trackmotif.plans import discovery_queries, similarity_queries


def _rows(seed, n, words, signed, common=0.02):
    """Unit vectors over words of falling frequency, with one light word in all of them."""
    rng = random.Random(seed)
    out = {}
    for k in range(n):
        own = {min(int(rng.expovariate(6 / words)), words - 1): rng.random() * (rng.choice((-1, 1)) if signed else 1) for _ in range(rng.randrange(1, 9))}
        own[words] = common
        size = sum(v * v for v in own.values()) ** 0.5
        out[k] = {w: v / size for w, v in own.items()}
    return out


def _frame(spark, rows, key, part=None):
    lines = [(k, w, v) if part is None else (k, part, w, v) for k, r in rows.items() for w, v in r.items()]
    return spark.createDataFrame(lines, f"{key} long, {'part int, ' if part is not None else ''}word long, value double")


def _brute(left, rights, k, digits=9):
    out = {}
    for i, a in left.items():
        sims = defaultdict(lambda: float("-inf"))
        for right in rights:
            for j, b in right.items():
                if shared := a.keys() & b.keys():
                    sims[j] = max(sims[j], sum(a[w] * b[w] for w in shared))
        ranked = sorted((-round(s, digits), j) for j, s in sims.items())[:k]
        out |= {(i, j): (n + 1, -s) for n, (s, j) in enumerate(ranked)}
    return out


def _same(got, expected):
    found = {(r.i, r.j): (r.rank, r.sim) for r in got}
    return {k: v[0] for k, v in found.items()} == {k: v[0] for k, v in expected.items()} and all(abs(v[1] - expected[k][1]) < 1e-8 for k, v in found.items())


@pytest.mark.parametrize(("signed", "parts", "k"), [(False, 1, 5), (True, 1, 5), (True, 2, 3), (False, 1, 400)])
def test_nearest_are_those_of_all_products(spark, signed, parts, k):
    left = _rows(1, 150, 60, signed)
    rights = [left, *(_rows(9, 150, 60, signed) for _ in range(parts - 1))]
    right = _frame(spark, rights[0], "j", 0)
    for p, more in enumerate(rights[1:]):
        right = right.unionByName(_frame(spark, more, "j", p + 1))
    got = knn.nearest(_frame(spark, left, "i"), right, k, F.round("sim", 9)).collect()
    assert _same(got, _brute(left, rights, k))


def test_a_word_in_all_rows_makes_few_products(spark):
    rows = _rows(4, 400, 2000, False, common=0.01)  # rows meet by rare words and, lightly, by the one all have
    for k, r in rows.items():
        for n in range(6):
            r[5000 + k // 8 * 10 + n] = 0.5
    left, right = _frame(spark, rows, "i"), _frame(spark, rows, "j", 0)
    needed, _ = knn.bounded_words(left, right, 5)
    products = needed.agg(F.sum("n")).first()[0]
    assert products < 0.2 * sum(1 for a in rows.values() for b in rows.values() for w in a if w in b)
    got = knn.nearest(left, right, 5, F.round("sim", 9)).collect()
    assert _same(got, _brute(rows, [rows], 5))


def test_rows_without_a_common_word(spark):
    left, right = {1: {1: 1.0}, 2: {7: 1.0}}, {5: {1: 0.5}, 6: {2: 1.0}}
    assert [(r.i, r.j, r.rank, r.sim) for r in knn.nearest(_frame(spark, left, "i"), _frame(spark, right, "j", 0), 3).collect()] == [(1, 5, 1, 0.5)]
    assert knn.nearest(_frame(spark, {}, "i"), _frame(spark, right, "j", 0), 3).count() == 0


def test_query_is_the_plain_join(spark, data):
    rows = lambda df: sorted(map(tuple, df.select("i", "j", "rank").collect()))
    assert rows(similarity_queries.sparse_cosine_knn(spark, data)) == rows(similarity_queries._neighbours(spark, data))


@pytest.mark.parametrize(("signed", "parts", "k", "blocks"), [(False, 1, 5, 1), (True, 1, 5, 3), (True, 2, 3, 3), (False, 1, 400, 2)])
def test_nearest_of_all_are_those_of_all_products(spark, monkeypatch, signed, parts, k, blocks):
    monkeypatch.setattr(knn, "_blocks", lambda n: blocks)
    left = _rows(1, 150, 60, signed)
    rights = [left, *(_rows(9, 150, 60, signed) for _ in range(parts - 1))]
    right = _frame(spark, rights[0], "j", 0)
    for p, more in enumerate(rights[1:]):
        right = right.unionByName(_frame(spark, more, "j", p + 1))
    assert _same(knn.of_all(_frame(spark, left, "i"), right, k).collect(), _brute(left, rights, k))


def test_nearest_of_all_with_ties_and_rows_alone(spark, monkeypatch):
    monkeypatch.setattr(knn, "_blocks", lambda n: 2)
    rows = {k: {k % 3: 0.6, 10 + k % 2: 0.8} for k in range(120)} | {500: {77: -1.0}, 501: {77: 1.0}}
    assert _same(knn.of_all(_frame(spark, rows, "i"), _frame(spark, rows, "j", 0), 4).collect(), _brute(rows, [rows], 4))
    assert knn.of_all(_frame(spark, {}, "i"), _frame(spark, rows, "j", 0), 3).count() == 0
    assert [(r.i, r.j) for r in knn.of_all(_frame(spark, {1: {5: 1.0}}, "i"), _frame(spark, rows, "j", 0), 3).collect()] == []


def test_queries_shuffle_no_pairs_but_the_best(spark, data, monkeypatch):
    monkeypatch.setattr(knn, "sparse_dot", None)
    plans = (similarity_queries.sparse_cosine_knn, similarity_queries.leiden_labels, similarity_queries.modularity_of_labels, similarity_queries.spearman_rows)
    assert all(make(spark, data).count() for make in plans)
    assert discovery_queries.strand_knn(spark, data).count() and discovery_queries.zero_filled_knn(spark, data).count()


@pytest.mark.parametrize("metric", ["jaccard", "cosine"])
def test_slides_of_rows_are_those_of_each(metric):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(2, 40, 16, 4)) * (rng.random((2, 40, 16, 4)) < 0.3)
    x[0] = y[1] = 0
    each = np.array([kernels.slide(q, t, 4, metric) for q, t in zip(x, y, strict=True)])
    assert np.allclose(kernels.slides(x, y, 4, metric), each, rtol=0, atol=1e-14)


#: Queries that took their neighbours from a shuffle of all pairs.
WITHOUT_PAIRS = [
    "density_weights",
    "spearman_rows",
    "subcluster_probs",
    "symmetrise_edges",
    "perplexity_beta",
    "spearman_filter",
    "sim_to_distance",
    "sliding_cosine_best",
]


@pytest.mark.parametrize("name", WITHOUT_PAIRS)
def test_query_makes_no_pairs_but_the_best(name, spark, data, monkeypatch):
    monkeypatch.setattr(knn, "sparse_dot", None)
    assert catalog.queries()[name](spark, data).count()

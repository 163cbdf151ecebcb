"""Resampling against plain counts of n-grams, and suffix arrays against sorting."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from trackmotif.llm import resample

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _grams(text, low, high):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    return len(w), [" ".join(w[k : k + n]) for n in range(low, high + 1) for k in range(len(w) - n + 1)]


def _brute(docs, target, percent=10, low=1, high=1, buckets=10_000, seed=2024, least=20):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    own = [(_grams(t, low, high)) for _, t in docs]
    s, t = (Counter(bucket(g) for _, f in x for g in f) for x in (own, [_grams(x, low, high) for x in target]))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for (doc_id, _), (n_words, f) in zip(docs, own, strict=True):
        weight = sum(gain(bucket(g)) for g in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n_words])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def _rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.mark.parametrize("depth", [1, 2, 3, 5, 8])
def test_suffix_array_is_that_of_sorting(depth):
    rng = np.random.default_rng(depth)
    for n, kinds in ((0, 1), (1, 1), (40, 1), (200, 2), (300, 5)):
        ids = rng.integers(0, kinds, n)
        order, common = resample.suffix_array(ids, depth)
        cut = [tuple(ids[k : k + depth]) for k in range(n)]
        assert [cut[k] for k in order] == sorted(cut) and sorted(order) == list(range(n))
        for k in range(1, n):
            a, b = cut[order[k - 1]], cut[order[k]]
            assert common[k] == next((x for x in range(min(len(a), len(b))) if a[x] != b[x]), min(len(a), len(b)))


@pytest.mark.parametrize(("low", "high", "block"), [(1, 1, resample.BLOCK), (1, 1, 50), (1, 3, 400), (2, 2, resample.BLOCK), (2, 5, 100)])
def test_equals_plain_counts(spark, monkeypatch, low, high, block):
    monkeypatch.setattr(resample, "BLOCK", block)
    rng = random.Random(high)
    words = ["Alpha", "beta", "g4mma", "délta", "e", "ÉTA", "zeta-eta"]
    docs = [(k, " ".join(rng.choices(words, k=rng.randrange(0, 60)))) for k in range(150)]
    docs += [(1, docs[2][1]), (2, docs[2][1]), (None, docs[3][1]), (None, None), (500, None), (501, ""), (502, "?!.")]
    target = [" ".join(rng.choices(words[:3], k=9)) for _ in range(8)] + [None, "", "new words here"]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, buckets string, rank int").repartition(3)
    to = spark.createDataFrame([(t, 3) for t in target], "text string, weight int")
    found = resample.resample(df, to, percent=17, low=low, high=high, buckets=50, seed=9, least_words=5)
    assert _rows(found) == _brute(docs, target, 17, low, high, 50, 9, 5)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]


@pytest.mark.parametrize(("docs", "target"), [([], ["a b"]), ([(1, "a " * 30)], []), ([], [])])
def test_empty_tables(spark, docs, target):
    found = resample.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string"), percent=100)
    assert _rows(found) == _brute(docs, target, 100)


def test_drawn_rows_keep_their_columns(spark):
    docs = [(k, f"word{k % 7} " * 25, k * k) for k in range(40)]
    df, target = spark.createDataFrame(docs, "doc_id long, text string, rank long"), spark.createDataFrame([("word3 word3",)], "text string")
    kept = resample.draw(df, target, percent=25).collect()
    ranks = {r[0] for r in _brute([d[:2] for d in docs], ["word3 word3"], 25) if r[4]}
    assert {r.doc_id for r in kept} == ranks and all(r.rank == r.doc_id**2 for r in kept) and len(kept) == 10


def test_long_text_of_many_equal_words(spark):
    docs = [(1, "same " * 200_000), (2, "other " * 20)]
    df, target = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("same",)], "text string")
    assert _rows(resample.resample(df, target, percent=50, high=2)) == _brute(docs, ["same"], 50, 1, 2)

"""SimHash links against all pairs, and trees against plain distances."""

import random
import re

import numpy as np
import pytest
import xxhash

from trackmotif.llm import queries, simhash

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _fingerprint(text, size=3):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + size]).encode(), 42) for k in range(max(1, len(w) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _least(links, of):
    """The smallest value of ``of`` in each component of ``links`` between places."""
    parent = list(range(len(of)))

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for a, b in links:
        parent[root(a)] = root(b)
    low = {}
    for k, x in enumerate(of):
        if x is not None:
            low[root(k)] = min(low.get(root(k), x), x)
    return [low.get(root(k)) for k in range(len(of))]


def _pairs(codes, radius):
    v = np.array(codes, np.uint64)
    return [(a, int(b)) for a in range(len(v)) for b in np.flatnonzero(np.bitwise_count(v[:a] ^ v[a]) <= radius)]


def _brute(docs, radius=3, size=3):
    codes = [_fingerprint(t, size) for _, t in docs]
    same = [(a, b) for a in range(len(docs)) for b in range(a) if docs[a][0] is not None and docs[a][0] == docs[b][0]]
    return sorted(((i, f"{c:016x}", low) for (i, _), c, low in zip(docs, codes, _least(_pairs(codes, radius) + same, [i for i, _ in docs]), strict=True)), key=repr)


def _rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=repr)


def _codes(seed, families, each, flips):
    """Distinct codes in families around random centres."""
    rng = random.Random(seed)
    found = set()
    for _ in range(families):
        centre = rng.getrandbits(64)
        for _ in range(each):
            found.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(flips + 1))))
    return sorted(found)


@pytest.mark.parametrize("radius", [1, 3, 6])
def test_trees_find_all_within_the_radius(monkeypatch, radius):
    monkeypatch.setattr(simhash, "FRONTIER", 500)
    codes = np.array(_codes(radius, 40, 25, 5), np.uint64)
    tree = np.sort(np.random.default_rng(1).integers(0, 3, len(codes)) * 7)
    forest = simhash.Forest(tree, codes)
    found = {(int(q), int(n)) for a, b in forest.search(tree, codes, radius) for q, n in zip(a, b, strict=True)}
    near = (np.bitwise_count(codes[:, None] ^ codes) <= radius) & (tree[:, None] == tree)
    assert found == {(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True)}
    for edge, node in zip(forest.edges, forest.nodes, strict=True):  # a child's edge is its distance
        assert edge % 65 == int(codes[node] ^ codes[edge // 65]).bit_count()


@pytest.mark.parametrize(("shard", "crowd", "radius"), [(1 << 16, 256, 3), (64, 256, 3), (8, 256, 3), (1 << 16, 0, 3), (64, 256, 1), (1 << 16, 0, 5)])
def test_links_have_the_components_of_all_pairs(spark, monkeypatch, shard, crowd, radius):
    """Shards of any size, buckets that are split, and longer keys."""
    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash, "CROWD", crowd)
    codes = _codes(9, 30, 12, radius + 1) + list(range(40))  # the last all share their high blocks
    codes = sorted(set(codes))
    signed = [(c - (1 << 64) if c >> 63 else c,) for c in codes]
    links = simhash.links(spark.createDataFrame(signed, "fp long"), radius).collect()
    place = {c[0]: k for k, c in enumerate(signed)}
    found = _least([(place[r.a], place[r.b]) for r in links], list(range(len(codes))))
    assert found == _least(_pairs(codes, radius), list(range(len(codes))))


def test_spanned_labels():
    rng = np.random.default_rng(2)
    for n in (1, 5, 200):
        a, b = rng.integers(0, n, (2, n // 2))
        label = np.arange(n)
        for k in range(0, len(a), 7):
            simhash.spanned(label, a[k : k + 7], b[k : k + 7])
        assert label.tolist() == _least(list(zip(a.tolist(), b.tolist(), strict=True)), list(range(n)))


def test_query_equals_all_pairs(spark, data):
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    assert _rows(queries.op13_simhash_bktree(spark, data)) == _brute(docs)


def test_nulls_repeats_and_names(spark):
    rng = random.Random(1)
    words = [rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(400)]
    docs = [(9, " ".join(words)), (4, " ".join(words[:-1])), (None, " ".join(words)), (7, "One two"), (7, "three four five six"), (3, "three  four\tFIVE six"), (8, "one\ntwo"), (20, None), (11, ""), (12, " \n "), (None, "alone here and there"), (13, "B " * 50_000)]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, fp int, component_id string")
    assert _rows(simhash.near_duplicates(df)) == _brute(docs)
    assert _rows(simhash.near_duplicates(df.limit(0))) == []


def test_every_row_alike(spark):
    docs = [(k, "the same words again and again") for k in range(500)]
    assert _rows(simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))) == [(k, f"{_fingerprint(docs[0][1]):016x}", 0) for k in sorted(range(500), key=lambda k: repr((k,)))]

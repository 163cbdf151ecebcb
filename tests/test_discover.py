import numpy as np

from trackmotif.operators import kernels, knn
from trackmotif.plans import discover

MOTIF = "TGACTCAGCATT"


def planted(n=160, length=120, seed=3):
    rng = np.random.RandomState(seed)
    rows = []
    for k in range(n):
        s = rng.randint(0, 4, length)
        hyp = rng.normal(0, 0.02, (length, 4))
        at = rng.randint(40, length - 60)
        word = np.array(["ACGT".index(c) for c in MOTIF])
        if k % 2:
            word = 3 - word[::-1]
        s[at : at + len(word)] = word
        hyp[np.arange(at, at + len(word)), word] += 1.0
        rows.append((k, np.eye(4)[s].tolist(), hyp.tolist()))
    return rows


def test_words_equal_enumeration():
    from itertools import combinations

    rng = np.random.RandomState(0)
    hot = np.eye(4)[rng.randint(0, 4, 30)]
    contrib = hot * rng.normal(size=(30, 4))
    keys, values = kernels.words(contrib, hot, sites=9, min_k=2, max_k=4, max_len=12, entries=10**6)
    score, expected = contrib.sum(axis=1), {}
    pos = sorted(np.argsort(-score, kind="stable")[:9])
    for k in (2, 3, 4):
        for c in combinations(pos, k):
            if c[-1] - c[0] < 12:
                key = sum((int(hot[p].argmax()) + 1) * 5 ** int(p - c[0]) for p in c)
                expected[key] = expected.get(key, 0) + sum(score[p] for p in c) / k
    got = dict(zip(keys.tolist(), values.tolist(), strict=True))
    assert got.keys() == expected.keys() and all(abs(got[k] - v) < 1e-12 for k, v in expected.items())


def test_seqlets_of_few_words_meet_by_postings(spark, monkeypatch):
    """Both signs and strands, as the pruned search has them."""
    rng = np.random.RandomState(4)
    rows = [(("pos", "neg")[k % 2], k // 2 + 1, np.eye(4)[rng.randint(0, 4, 5)].tolist(), rng.normal(size=(5, 4)).round(3).tolist()) for k in range(160)]
    found = spark.createDataFrame(rows, "sign string, ord long, one_hot array<array<double>>, hyp array<array<double>>")
    s = kernels.Settings(neighbours=6)
    got = lambda: sorted((r.sign, r.i, r.j, r.rank, round(r.sim, 9)) for r in discover.coarse(found, s).collect())
    monkeypatch.setattr(knn, "SHORT", 0)
    pruned = got()
    monkeypatch.setattr(knn, "SHORT", 32)
    monkeypatch.setattr(knn, "nearest", None)
    assert got() == pruned and len(pruned) == 160 * 7


def test_fine_similarities_are_those_of_each_pair():
    rng = np.random.default_rng(6)
    cut = lambda lengths: [rng.normal(size=(n, 4)) * (rng.random((n, 4)) < 0.3) for n in lengths]
    left, right = [5] * 1200 + [7] * 9 + [11], [5] * 1200 + [7] * 4 + [5] * 5 + [11]
    ci, hi, cj, hj = cut(left), cut(left), cut(right), cut(right)
    ci[0][:], hj[1][:] = 0, 0
    each = [kernels.fine_similarity(kernels.features(c, d), kernels.features(a, b)) for a, b, c, d in zip(ci, hi, cj, hj, strict=True)]
    assert np.allclose(kernels.fine_similarities(ci, hi, cj, hj), each, rtol=0, atol=1e-14)
    assert len(kernels.fine_similarities([], [], [], [])) == 0


def test_planted_motif_is_found_on_both_strands(spark):
    tracks = spark.createDataFrame(planted(), "example_idx long, one_hot array<array<double>>, hyp array<array<double>>")
    settings = kernels.Settings(window=15, flank=5, max_seqlets=300, seeds=2, trim=20, initial_flank=5, neighbours=60, min_metacluster=50)
    members = discover.discover(tracks, settings)
    rows = members.collect()
    assert {r.sign for r in rows} == {"pos"} and len({r.is_revcomp for r in rows}) == 2
    largest = discover.summarised(members, tracks).orderBy("pattern_idx").first()
    assert largest.n_seqlets > 40  # the rank filter of the first round drops most copies of one word
    read = "".join("ACGT"[int(np.argmax(r))] for r in largest.ppm)
    other = read[::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert MOTIF in read or MOTIF in other
    sure = [max(r) for r in largest.ppm]
    assert sorted(sure)[-len(MOTIF)] > 0.9


def test_pair_draws_from_all_seqlets():
    rng = np.random.default_rng(5)
    own, odd = rng.normal(size=(2, 12, 4))
    contrib = {k: (own if k < 300 else odd) + rng.normal(size=(12, 4)) * 0.1 for k in range(600)}  # weak members differ
    contrib |= {1000 + k: own + rng.normal(size=(12, 4)) * 0.1 for k in range(300)}
    tracks = kernels.Tracks({k: (x == x.max(axis=1, keepdims=True)).astype(float) for k, x in contrib.items()}, contrib, contrib, 13)
    q, p = (kernels.Pattern(tracks, [(k, 0, 12, False) for k in keys]) for keys in (range(600), range(1000, 1300)))
    few, every = (kernels._pair(p, q, kernels.Settings(sub_sample=n))[1] for n in (200, 600))
    assert every > 0.7 and abs(few - every) < 0.08

"""Merging and splitting by small tasks against the same done in one."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trackmotif.operators import graph, kernels, patterns
from trackmotif.plans import collapse, discover, discovery_queries
from trackmotif.plans.pattern_queries import auroc_pairs
from trackmotif.session import materialise, ship_package

WORDS = ("TGACTCAGCATT", "CCGGAAGTAACC", "GATAAGGCTTAT")
LENGTH = 90


def _planted(n, seed=1, words=WORDS, noise=0.02):
    """Tracks with one word each, and where it lies."""
    rng = np.random.RandomState(seed)
    rows, places = [], []
    for k in range(n):
        s = rng.randint(0, 4, LENGTH)
        hyp = rng.normal(0, noise, (LENGTH, 4))
        word = np.array(["ACGT".index(c) for c in words[k % len(words)]])
        turned, at = bool(rng.randint(2)), rng.randint(25, LENGTH - 40)
        word = 3 - word[::-1] if turned else word
        s[at : at + len(word)] = word
        hyp[np.arange(at, at + len(word)), word] += 1.0 + rng.normal(0, 0.1, len(word))
        rows.append((k, np.eye(4)[s].tolist(), hyp.tolist()))
        places.append((at, turned))
    return rows, places


@pytest.fixture(scope="module")
def planted(spark):
    ship_package(spark)
    rows, places = _planted(150)
    df = spark.createDataFrame(rows, "example_idx long, one_hot array<array<double>>, hyp array<array<double>>")
    tracks = materialise(discover.with_contributions(df), "tracks")
    hot, hyp = ({k: np.array(x) for k, *xs in rows for x in [xs[c]]} for c in (0, 1))
    return tracks, kernels.Tracks(hot, {k: hot[k] * hyp[k] for k in hot}, hyp, LENGTH), places


def _patterns(places, shift=True):
    """Each word's seqlets in two patterns of unlike size, the second moved by a few positions and turned."""
    found = []
    for w in range(len(WORDS)):
        mine = [k for k in range(len(places)) if k % len(WORDS) == w]
        for part, keys in enumerate((mine[:30], mine[30:])):
            move = 3 * part * shift
            lines = []
            for k in keys:
                at, turned = places[k]
                start = at - 4 + (-move if turned else move)
                lines.append((k, start, start + 20, turned != bool(part)))
            found.append(lines)
    return found


def _members(spark, found):
    return spark.createDataFrame([(p, n, *x) for p, lines in enumerate(found) for n, x in enumerate(lines)], collapse.MEMBERS_DDL)


SETTINGS = kernels.Settings(trim=20, initial_flank=3, least=5, merge=((0.3, 0.7), (0.1, 0.9)), veto=((0.0, 0.2),), sub_perplexity=8.0)


def test_collapse_has_the_members_of_one_task(spark, planted):
    tracks, held, places = planted
    found = _patterns(places)
    background = np.full(4, 0.25)
    history = []
    one = kernels.collapsed([kernels.Pattern(held, x) for x in found], background, SETTINGS, history)
    state = collapse.Collapse(_members(spark, found), tracks, background, SETTINGS)
    left = state.run({"pos": list(range(len(found)))})
    rows = {}
    for r in state.members.orderBy("number", "ord").collect():
        rows.setdefault(r.number, []).append((r.example_idx, r.start, r.end, r.is_revcomp))
    assert len(one) == 3 and [rows[k] for k in left["pos"]] == [p.seqlets for p in one] and set(rows) == set(left["pos"])
    assert [(level, n) for _, level, _, _, n in state.history] == [(level, n) for level, _, _, n in history]
    assert all(len(x) == 2 for _, _, _, x, _ in state.history)


def test_scopes_collapse_side_by_side(spark, planted):
    tracks, held, places = planted
    found = _patterns(places)
    background = np.full(4, 0.25)
    state = collapse.Collapse(_members(spark, found), tracks, background, SETTINGS)
    left = state.run({"a": [0, 1, 2], "b": [3], "c": [4, 5], "d": []})
    assert left["b"] == [3] and left["d"] == [] and len(left["a"]) == 2 and 2 in left["a"] and len(left["c"]) == 1
    assert {scope for scope, *_ in state.history} == {"a", "c"}
    known = dict(state.known)
    again = state.run({"pos": [x for v in left.values() for x in v]})
    assert len(again["pos"]) == 3 and all(state.known[k] == v for k, v in known.items())


def test_pair_scores_are_those_of_one_task(spark, planted):
    tracks, held, places = planted
    found = _patterns(places)
    for cap in (1000, 12):
        s = kernels.Settings(sub_sample=cap)
        wanted = [(a, b) for a in range(len(found)) for b in range(len(found)) if a != b]
        members = _members(spark, found)
        got = {(r.a, r.b): (r.sim, r.auroc) for r in collapse.pair_scores(spark.createDataFrame(wanted, "a long, b long"), members, tracks, collapse.sizes_of(members), s).collect()}
        one = [kernels.Pattern(held, x) for x in found]
        for a, b in wanted:
            assert np.allclose(got[a, b], kernels._pair(one[a], one[b], s), atol=1e-9)


def test_pairs_that_leave_the_track(spark, planted):
    tracks, held, _ = planted
    found = [[(0, 0, 20, False), (1, 0, 20, False)], [(2, 68, 88, False), (3, 0, 20, True)]]
    members = _members(spark, found)
    got = {(r.a, r.b): (r.sim, r.auroc) for r in collapse.pair_scores(spark.createDataFrame([(0, 1), (1, 0)], "a long, b long"), members, tracks, collapse.sizes_of(members), SETTINGS).collect()}
    one = [kernels.Pattern(held, x) for x in found]
    for a, b in ((0, 1), (1, 0)):
        assert np.allclose(got[a, b], kernels._pair(one[a], one[b], SETTINGS), atol=1e-9)


def test_pair_scores_by_blocks(spark, planted, monkeypatch):
    """Patterns that meet block by block have the scores of one task, also where one has no seqlet of its full length."""
    tracks, held, places = planted
    found = [*_patterns(places), [(0, 2, 22, False), (1, 40, 58, True)]]
    assert collapse.blocks_of({4: 30, 2: 900, 7: 5000, 9: 20}, 1000, 1000) == {2: 0, 4: 0, 7: 1, 9: 2}
    monkeypatch.setattr(collapse, "blocks_of", lambda sizes, cap: {k: n // 2 for n, k in enumerate(sorted(sizes))})
    wanted = [(a, b) for a in range(len(found)) for b in range(len(found)) if a != b and (a, b) != (0, 5)]
    members = _members(spark, found)
    rows = collapse.pair_scores(spark.createDataFrame(wanted, "a long, b long"), members, tracks, collapse.sizes_of(members), SETTINGS).collect()
    got = {(r.a, r.b): (r.sim, r.auroc) for r in rows}
    one = [kernels.Pattern(held, x) for x in found]
    assert len(rows) == len(got) and got.keys() == set(wanted)
    assert all(np.allclose(got[a, b], kernels._pair(one[a], one[b], SETTINGS), atol=1e-9) for a, b in wanted)


def test_a_pattern_is_moved_once_for_all_it_lies_on():
    rng = np.random.default_rng(2)
    own = {a: rng.normal(size=(3 + a, 8)) for a in range(4)}
    moved = {10: rng.normal(size=(5, 8)), 11: own[2][:4]}
    lines = [(0, 0, a, None, x) for a, x in own.items()] + [(0, 1, b, [0, 1, 2, 3, 77], x) for b, x in moved.items()] + [(1, 0, 0, None, own[1]), (1, 1, 10, [0], moved[10])]
    table = pa.table({c: pa.array([r[k].tolist() if k == 4 else r[k] for r in lines], t) for k, (c, t) in enumerate((("job", pa.int32()), ("side", pa.int32()), ("number", pa.int64()), ("on", pa.list_(pa.int64())), ("flats", pa.list_(pa.list_(pa.float64())))))})
    got = [tuple(r.values()) for b in collapse.told_apart(iter(table.to_batches(max_chunksize=3))) for r in b.to_pylist()]
    told = lambda x, y: kernels._auroc(kernels.similarities(x, x).ravel(), kernels.similarities(x, y).ravel())
    assert sorted(got[:-1]) == sorted([(a, b, told(x, y)) for b, y in moved.items() for a, x in own.items()] + [(77, b, 0.5) for b in moved])
    assert got[-1] == (0, 10, told(own[1], moved[10]))


def test_chains_of_pairs():
    assert collapse._chains([]) == []
    pairs = [(0, 1), (2, 3), (1, 2), (5, 6), (4, 6)]
    assert sorted(collapse._chains(pairs)) == [[(0, 1), (2, 3), (1, 2)], [(5, 6), (4, 6)]]


@pytest.mark.parametrize("size", [512, 7])
def test_subclusters_part_planted_halves(spark, planted, size):
    """Blocks of any size give the same labels, which part the two words of a pattern as one task does."""
    tracks, held, places = planted
    found = [[(k, places[k][0] - 2, places[k][0] + 16, places[k][1]) for k in range(60) if k % 3 < 2], [(0, 0, 18, False), (1, 0, 18, False)]]
    rows = collapse.subclusters(_members(spark, found), tracks, 8.0, 2, size).collect()
    label = {(r.number, r.ord): r.label for r in rows}
    assert len(label) == sum(map(len, found)) and [label[1, k] for k in range(2)] == [0, 0]
    words = {}
    for n, (k, *_) in enumerate(found[0]):
        words.setdefault(label[0, n], set()).add(k % 3)
    assert all(len(w) == 1 for w in words.values()) and len(words) >= 2
    one = kernels.subclusters(kernels.Pattern(held, found[0]), 8.0, 2)
    assert all(len({int(one[n]) % 1000 for n in range(len(one)) if found[0][n][0] % 3 == w}) >= 1 for w in (0, 1))


def test_finished_splits_merges_and_drops(spark, planted):
    tracks, held, places = planted
    mixed = [(k, places[k][0] - 4, places[k][0] + 16, places[k][1]) for k in range(120) if k % 3 < 2]
    rest = [(k, places[k][0] - 4, places[k][0] + 16, places[k][1]) for k in range(120, 150) if k % 3 == 0]
    few = [(k, 2, 22, False) for k in (2, 5, 8)]
    rows = [("pos", c, n, *x) for c, lines in enumerate((mixed, rest, few)) for n, x in enumerate(lines)]
    clusters = spark.createDataFrame(rows, "sign string, cluster long, ord long, example_idx long, start long, end long, is_revcomp boolean")
    s = kernels.Settings(trim=20, initial_flank=3, least=5, merge=((0.3, 0.7),), veto=(), sub_perplexity=20.0, min_cluster=5)
    found = collapse.finished(clusters, tracks, np.full(4, 0.25), s).collect()
    words = {}
    for r in found:
        words.setdefault(r.pattern_idx, []).append(r.example_idx % 3)
    assert sorted(map(set, words.values()), key=min) == [{0}, {1}] and len(words[0]) >= len(words[1])
    assert sum(map(len, words.values())) == len(mixed) + len(rest)
    assert {r.sign for r in found} == {"pos"} and all(sorted(r.ord for r in found if r.pattern_idx == k) == list(range(len(v))) for k, v in words.items())


def test_merge_order_by_plain_recomputation(spark, data):
    got = [(r.a, r.b) for r in discovery_queries.merge_order(spark, data).orderBy("k").collect()]
    aurocs = {(r.a, r.b): r.contamination for r in auroc_pairs(spark, data).collect()}
    means = {}
    for r in discovery_queries.e_track(spark, data).select("label", "contrib").collect():
        means.setdefault(r.label, []).append(np.array(r.contrib).ravel())
    unit = {k: (lambda m: (m - m.mean()) / np.linalg.norm(m - m.mean()))(np.mean(v, axis=0)) for k, v in means.items()}
    labels = sorted(unit)
    rows = [(a, b, round(float(unit[a] @ unit[b]), 9), min(aurocs[a, b], aurocs[b, a]), (aurocs[a, b] + aurocs[b, a]) / 2) for a in labels for b in labels if a < b]
    assert got == patterns.merges(rows, [(0.8, -0.5)], [(0.2, -0.3)]) and got

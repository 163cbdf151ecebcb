import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trackmotif import session
from trackmotif.functions import vec
from trackmotif.operators import graph, nms, patterns, ranking, seqlets, thresholds, windows
from trackmotif.plans import bindings, pattern_queries
from trackmotif.sources import text


def test_revcomp_twice_is_identity(spark):
    df = spark.createDataFrame([([[1.0, 2.0, 3.0, 4.0], [5.0, 6.0, 7.0, 8.0]],)], "t array<array<double>>")
    r = df.select("t", vec.reverse_complement(F.col("t")).alias("once"), vec.reverse_complement(vec.reverse_complement(F.col("t"))).alias("twice")).first()
    assert r.twice == r.t and r.once == [[8.0, 7.0, 6.0, 5.0], [4.0, 3.0, 2.0, 1.0]]


def test_odd_crop_and_zero_flank_are_refused(spark):
    with pytest.raises(ValueError):
        vec.centred_crop(F.col("x"), 7)
    with pytest.raises(ValueError):
        windows.candidates(spark.createDataFrame([(0, 0, 1.0)], "example long, pos long, total double"), 1, -1, 0)


def test_nms_with_ties_equals_greedy(spark):
    rng = random.Random(2)
    rows = [(e, p, float(rng.randrange(5))) for e in range(20) for p in range(40) if rng.random() < 0.7]
    got = {}
    for r in nms.pick(spark.createDataFrame(rows, "example long, pos long, score double"), 3).orderBy("example", "pick_ord").collect():
        got.setdefault(r.example, []).append(r.pos)
    for e in range(20):
        left, kept = sorted(((-s, p) for x, p, s in rows if x == e)), []
        for _, p in left:
            if all(abs(p - q) > 3 for q in kept):
                kept.append(p)
        assert got.get(e, []) == kept


@pytest.mark.parametrize(("cell", "margin"), [(None, None), (64, 16), (40, 6), (16, 4)])
def test_nms_of_long_examples_in_cells(spark, cell, margin):
    """Ties, ramps and gaps over cells with narrow margins, where some dependence reaches through."""
    rng = random.Random(cell or 1)
    shapes = {0: lambda p: float(rng.randrange(4)), 1: lambda p: float(p), 2: lambda p: float(-p), 3: lambda p: rng.random(), 4: lambda p: abs(100.0 - p % 200), 5: lambda p: 1.0}
    rows = [(e, p, f(p)) for e, f in shapes.items() for p in range(700) if rng.random() < (0.9 if e % 2 else 0.5)]
    got = {}
    for r in nms.pick(spark.createDataFrame(rows, "example long, pos long, score double"), 3, cell=cell, margin=margin).orderBy("example", "pick_ord").collect():
        got.setdefault(r.example, []).append((r.pick_ord, r.pos, r.score))
    for e in shapes:
        kept = []
        for s, p in sorted((-s, p) for x, p, s in rows if x == e):
            if all(abs(p - q) > 3 for _, q, _ in kept):
                kept.append((len(kept), p, -s))
        assert got[e] == kept


def test_nms_of_a_very_long_example(spark):
    n = 1_000_000
    df = spark.range(0, n, numPartitions=8).select(F.lit(1).alias("example"), F.col("id").alias("pos"), (F.pmod(F.xxhash64("id"), F.lit(50_000)) / 7).alias("score"))
    found = nms.pick(df, 15).orderBy("pick_ord").collect()
    score = np.array([r.score for r in df.orderBy("pos").collect()])
    free, expected = np.ones(n, bool), []
    for p in np.lexsort((np.arange(n), -score)):
        if free[p]:
            expected.append(int(p))
            free[max(0, p - 15) : p + 16] = False
    assert [r.pos for r in found] == expected


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 8), st.floats(0, 1), st.floats(0.1, 3)), min_size=1, max_size=12))
def test_isotonic_is_the_max_min_formula(rows):
    rows.sort(key=lambda r: r[0])
    x, y, w = (np.array(c, float) for c in zip(*rows, strict=True))
    fit = thresholds.pool_adjacent(x, y, w)
    u = np.unique(x)
    ws, ys = np.array([w[x == k].sum() for k in u]), np.array([(w * y)[x == k].sum() / w[x == k].sum() for k in u])
    mean = lambda a, b: (ws[a : b + 1] * ys[a : b + 1]).sum() / ws[a : b + 1].sum()
    for k, v in enumerate(u):
        expected = max(min(mean(a, b) for b in range(k, len(u))) for a in range(k + 1))
        assert abs(fit[x == v][0] - expected) < 1e-9


def test_leiden_finds_planted_groups(spark):
    rng = np.random.RandomState(0)
    i, j, w = [], [], []
    for a in range(60):
        for b in range(a + 1, 60):
            p = 0.6 if a // 20 == b // 20 else 0.03
            if rng.rand() < p:
                i.append(a), j.append(b), w.append(1.0)
    label, q = graph.leiden(60, np.array(i), np.array(j), np.array(w), 100)
    assert all(len(set(label[k * 20 : k * 20 + 20])) == 1 for k in range(3)) and len(set(label)) == 3
    edges = spark.createDataFrame(list(zip(i, j, w, strict=True)), "i long, j long, w double")
    labels = spark.createDataFrame([(k, int(v)) for k, v in enumerate(label)], "id long, label long")
    assert abs(graph.modularity(edges, labels).first().q - q) < 1e-9
    assert q >= graph.modularity(edges, labels.select("id", F.col("id").alias("label"))).first().q


def test_vetoed_merges():
    pairs = [(0, 1, 0.95, 0.9, 0.9), (0, 2, 0.1, 0.0, 0.0), (1, 2, 0.92, 0.9, 0.9)]
    assert patterns.merges(pairs, [(0.8, 0.8)], [(0.4, 0.75)]) == [(0, 1)]
    assert patterns.merges(pairs, [(0.8, 0.8)], []) == [(0, 1), (1, 2)]
    # The veto looks at the mean of both contaminations, the threshold at the lesser.
    pairs = [(0, 1, 0.95, 0.9, 0.9), (0, 2, 0.7, 0.3, 0.5), (1, 2, 0.92, 0.9, 0.9)]
    assert patterns.merges(pairs, [(0.8, 0.8)], [(0.4, 0.75)]) == [(0, 1), (1, 2)]
    assert patterns.merges([(0, 1, 0.95, 0.5, 0.9)], [(0.8, 0.8)], []) == []


def test_rows_are_numbered_without_gaps(spark):
    rows = spark.range(2_000_000).where("id % 7 <> 0").select("id", F.concat(F.lit("name "), "id").alias("name"), (F.col("id") % 3).alias("k"))
    out = ranking.numbered(rows, "id")
    r = out.agg(F.count("*").alias("n"), F.countDistinct("row_idx").alias("d"), F.max("row_idx").alias("m")).first()
    assert r.n == r.d == r.m + 1 == 1_714_285
    assert out.where("row_idx <> id - 1 - id div 7").count() == 0 and out.columns == [*rows.columns, "row_idx"]


def test_ranks_and_quantiles(spark):
    rng = np.random.RandomState(4)
    rows = [(f"g{k % 3}" if k % 5 else None, float(v)) for k, v in enumerate(np.round(rng.normal(size=3000), 1))] + [("g0", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    found = ranking.quantiles(df, "v", [0.0, 0.1, 0.5, 0.97, 1.0], "g")
    for g in ("g0", "g1", "g2", None):
        own = [v for k, v in rows if k == g and v is not None]
        assert found[g][0] == len(own) and np.allclose(found[g][1], np.percentile(own, [0, 10, 50, 97, 100]))
    every = sorted(v for _, v in rows if v is not None)
    assert ranking.at_ranks(df.where("v is not null").select("v"), "v", {None: [0, 7, 2999, 3000]}) == {None: {0: every[0], 7: every[7], 2999: every[2999]}}
    assert ranking.quantiles(df.limit(0), "v", [0.5]) == {}


def test_thresholds_of_a_planted_signal(spark):
    rng = np.random.RandomState(1)
    x = np.concatenate([rng.laplace(0, 0.1, 20_000), rng.normal(3, 0.2, 600), rng.normal(-3, 0.2, 600)])
    found = thresholds.thresholds(spark.createDataFrame([(float(v),) for v in x], "total double"))
    assert 0.2 < found["high"] < 3 and -3 < found["low"] < -0.2 and 0 < found["sign"] <= found["high"]


@pytest.mark.parametrize("x", [[], [0.0] * 50, [2.5] * 7, [1.0], [0.0] * 40 + [3.0] * 5])
def test_values_without_spread(spark, x):
    df = spark.createDataFrame([(v,) for v in x], "v double")
    low, high = (min(x), max(x)) if x else (0.0, 1.0)
    n, edges = np.histogram(x, 1000)
    got = {r.bin: (r.n, r.low, r.high) for r in thresholds.histogram(df, "v").collect()}
    assert {k: v[0] for k, v in got.items()} == {k: c for k, c in enumerate(n.tolist()) if c}
    assert all(abs(a - edges[k]) < 1e-9 and abs(b - edges[k + 1]) < 1e-9 for k, (_, a, b) in got.items())
    mu = [r.mu for r in thresholds.two_level_mode(df, "v").collect()]
    assert len(mu) == bool(x) and (high > low or not x or mu == [0.0005])
    found = thresholds.thresholds(df, "v")
    assert (low < high and x != []) or found == {"high": np.inf, "low": -np.inf, "sign": np.inf}
    rates = thresholds.laplace_rates(df, "v", spark.createDataFrame([(m,) for m in mu], "mu double")).collect()
    assert len(rates) == len(mu) and thresholds.percentiles(df, "v").count() == (19 if x else 0)


@pytest.mark.parametrize("increasing", [True, False])
def test_isotonic_threshold_is_that_of_one_task(spark, increasing):
    rng = np.random.RandomState(3)
    turn = 1 if increasing else -1
    for own, null in ((np.concatenate([rng.laplace(0, 0.1, 3000), rng.normal(2, 0.3, 300)]), rng.laplace(0, 0.1, 2000)), (np.round(rng.normal(0, 1, 500), 1), np.round(rng.normal(0, 1, 300), 1)), (np.array([1.0, 2.0]), np.array([0.5])), (np.array([1.0, 1.0]), np.array([1.0, 3.0]))):
        own, null = turn * np.abs(own), turn * np.abs(null)
        ordered = np.sort(own)[::turn]
        df = spark.createDataFrame([(float(v),) for v in own], "v double").repartition(3)
        for fdr in (0.05, 0.2, 0.5):
            assert thresholds.isotonic_threshold(df, "v", null, increasing, fdr) == thresholds.precision_threshold(ordered, null, increasing, fdr)


def test_isotonic_blocks_of_any_number_of_ranges(spark):
    rng = np.random.RandomState(6)
    x = np.round(rng.normal(size=2000), 2)
    label = (rng.uniform(size=2000) < 1 / (1 + np.exp(-x))).astype(float)
    points = spark.createDataFrame([(float(a), 1.0 + k % 3, float(b)) for k, (a, b) in enumerate(zip(x, label, strict=True))], "value double, w double, label double")
    order = np.argsort(x, kind="stable")
    fit = thresholds.pool_adjacent(x[order], label[order], (1.0 + np.arange(2000) % 3)[order])
    for parts in (1, 5, 40):
        blocks = thresholds.isotonic_blocks(points, parts).orderBy("low").collect()
        assert sum(b.w for b in blocks) == sum(1 + k % 3 for k in range(2000)) and len(blocks) < 200
        for b in blocks:
            mine = (x[order] >= b.low) & (x[order] <= b.high)
            assert np.allclose(fit[mine], b.y / b.w) and b.first == min(x[(x >= b.low) & (x <= b.high) & (label > 0)], default=None)


@pytest.mark.parametrize("held", [200_000, 40, 2])
def test_selection_by_counting(spark, monkeypatch, held):
    monkeypatch.setattr(ranking, "HELD", held)
    rng = np.random.RandomState(held % 7)
    levels = [0.0, 0.05, 0.5, 0.9999, 1.0]
    for x in (rng.normal(size=5000), np.exp(60 * rng.normal(size=3000)), np.concatenate([np.zeros(4000), rng.normal(size=300)]), np.array([2.0, 1.0]), np.ones(9)):
        df = spark.createDataFrame([(float(v), "a" if k % 3 else None) for k, v in enumerate(x)], "v double, g string").repartition(3)
        assert np.allclose(ranking.quantiles(df, "v", levels)[None][1], np.percentile(x, [100 * q for q in levels]), rtol=1e-6, atol=0)
        found = ranking.quantiles(df, "v", levels, "g")
        for g in {"a", None}:
            own = [v for k, v in enumerate(x) if (k % 3 > 0) == (g == "a")]
            assert np.allclose(found[g][1], np.percentile(own, [100 * q for q in levels]), rtol=1e-6, atol=0)
        ordered = np.sort(x)
        assert ranking.at_ranks(df, "v", {None: [0, len(x) // 2, len(x) - 1, len(x)]}) == {None: {k: ordered[k] for k in (0, len(x) // 2, len(x) - 1)}}


def test_short_lines_of_a_peak_file(spark, tmp_path):
    path = tmp_path / "p.bed"
    path.write_text("chr1\t1\t9\ta\t5\n\nchr2\t2\t8\tb\t6\n")
    rows = [tuple(r) for r in text.read_bed(spark, str(path)).orderBy("row_idx").select("row_idx", "chrom", "start").collect()]
    assert rows == [(0, "chr1", 1), (1, None, None), (2, "chr2", 2)]
    assert [r.row_idx for r in text.read_bed(spark, str(path), ["chr2"]).collect()] == [0]
    path.write_text("chr1\t1\t9\ta\t5\nchr1\t2\t8\nchr2\t2\t8\tb\t6\n")
    with pytest.raises(Exception, match="fewer than 5 columns"):
        text.read_bed(spark, str(path)).collect()


def test_meme_round_trip(spark, tmp_path):
    rows = [("m1", [[0.1, 0.2, 0.3, 0.4], [1.0, 0.0, 0.0, 0.0]]), ("m2", [[0.25] * 4])]
    path = str(tmp_path / "x.meme")
    text.write_meme(spark.createDataFrame(rows, "name string, pwm array<array<double>>"), path)
    with open(path) as f:
        assert list(text.meme_motifs(f)) == rows


def test_bed_is_numbered_after_the_filter(spark, tmp_path):
    path = tmp_path / "p.bed"
    path.write_text("".join(f"chr{k % 3}\t{k}\t{k + 10}\tp{k}\t{k}\n" for k in range(50)))
    rows = text.read_bed(spark, str(path), ["chr1"]).orderBy("row_idx").collect()
    assert [r.start for r in rows] == [k for k in range(50) if k % 3 == 1] and [r.row_idx for r in rows] == list(range(len(rows)))


def test_auroc_pairs_score_all_rows(spark, data):
    big = data.replace("sf0.001", "sf0.1")
    tracks = bindings.e_track(spark, big).select("label", "contrib").collect()
    rows = {}
    for r in tracks:
        x = np.array(r.contrib).ravel()
        rows.setdefault(r.label, []).append(x / np.abs(x).sum())
    got = {(r.a, r.b): r.auroc for r in pattern_queries.auroc_pairs(spark, big).collect()}
    drawn = {(r.a, r.b): r.auroc for r in pattern_queries.auroc_pairs_drawn(spark, big).collect()}
    assert set(got) == {(a, b) for a in rows for b in rows if a != b} == set(drawn)
    assert max(map(len, rows.values())) <= pattern_queries.SUB_SAMPLE and all(abs(got[k] - drawn[k]) < 2e-6 for k in got)

    def sims(xs, ys):
        return [round(float((np.minimum(abs(x), abs(y)) * np.sign(x) * np.sign(y)).sum() / np.maximum(abs(x), abs(y)).sum()), 9) for x in xs for y in ys]

    labels = sorted(rows)
    for a, b in ((labels[0], labels[1]), (labels[-1], labels[0])):
        own, other = np.array(sims(rows[a], rows[a])), np.array(sims(rows[a], rows[b]))
        share = np.mean([(x > other).mean() + (x == other).mean() / 2 for x in own])
        assert abs(got[a, b] - share) < 2e-6


def test_pair_scores_in_blocks(spark, data):
    rows = pattern_queries._scaled(spark, data)
    whole, parts = (sorted(map(tuple, pattern_queries._pair_scores(rows, n).collect())) for n in (500, 7))
    assert whole == parts and sum(r[3] for r in whole) == rows.count() ** 2


def test_threshold_sample_draws_equal_values_each_alone(spark):
    df = spark.range(4000).selectExpr("id div 40 as example_idx", "id % 40 as pos", "cast(if(id % 2 = 0, 0, id) as double) as total")
    for seed in (1, 1234):
        rows = thresholds.sampled(df, "total", 1000, seed).collect()
        assert len(rows) == 1000 and 400 < sum(r.total == 0 for r in rows) < 600


def _random_graph(kind, n, seed):
    """Edges of planted groups, or of nodes that link to others at random, heavier to near ones."""
    rng = np.random.RandomState(seed)
    rows = {}
    for a in range(n):
        for _ in range(8):
            if kind == "planted":
                b = a // 25 * 25 + rng.randint(25) if rng.rand() < 0.8 else rng.randint(n)
            else:
                b = (a + 1 + int(rng.exponential(n / 12))) % n
            if a != b:
                rows[min(a, b), max(a, b)] = 0.5 + rng.rand()
    return [(a, b, w) for (a, b), w in rows.items()] + [(k, k, 0.3) for k in range(0, n, 9)]


@pytest.mark.parametrize("kind", ["planted", "ring"])
def test_communities_without_a_packed_graph(spark, kind):
    """Coarsening by joins ends within a hundredth of the modularity that one task finds."""
    rows = _random_graph(kind, 500, 2)
    i, j, w = (np.array(c) for c in zip(*rows, strict=True))
    one = max(graph.leiden(500, i, j, w, 100 * seed)[1] for seed in (1, 2))
    edges = spark.createDataFrame([("a", *map(float, r)) for r in rows], "g string, i double, j double, w double").withColumn("i", F.col("i").cast("long")).withColumn("j", F.col("j").cast("long"))
    found = graph.communities(edges, "g", 2, small=900)
    got = found.collect()
    assert len(got) == 500 == len({r.id for r in got}) and len({r.q for r in got}) == 1
    assert got[0].q > one * 0.99
    sizes = np.bincount([r.label for r in got])
    assert all(sizes > 0) and all(sizes[:-1] >= sizes[1:])
    assert abs(graph.modularity(edges.drop("g"), found.select("id", "label")).first().q - got[0].q) < 1e-9


def test_both_ways_of_an_edge_are_one(spark, monkeypatch):
    """A graph whose edges fit a task once each isn't coarsened for being given both ways, with loops."""
    rows = _random_graph("planted", 200, 3)
    real = [r for r in rows if r[0] != r[1]]
    both = [(a, b, w / 2) for a, b, w in real] + [(b, a, w / 2) for a, b, w in real] + [(k, k, 0.1) for k in range(200)]
    edges = spark.createDataFrame([(int(a), int(b), float(w)) for a, b, w in both], "i long, j long, w double")
    monkeypatch.setattr(graph, "coarsened", None)
    found = graph.communities(edges, None, 2, small=len(real))
    got = found.collect()
    assert len(got) == 200 and abs(graph.modularity(edges, found.select("id", "label")).first().q - got[0].q) < 1e-9
    i, j, w = (np.array(c) for c in zip(*both, strict=True))
    assert got[0].q > 0.99 * max(graph.leiden(200, i, j, w, 100 * seed)[1] for seed in (1, 2))


def test_tables_are_dropped_but_those_still_read(spark):
    first = session.tables_written(spark)
    a = session.materialise(spark.range(10).toDF("x"), "a")
    since = session.tables_written(spark)
    b, c = (session.materialise(a.where(f"x > {k}"), "b") for k in (3, 50))
    session.drop_tables(spark, since, -1)
    assert session.tables_written(spark) == first + 2 and (a.count(), c.count()) == (10, 0)
    with pytest.raises(Exception, match="FILE_NOT_EXIST|not exist"):
        b.collect()
    session.drop_tables(spark, first)
    assert session.tables_written(spark) == first


def _sums(spark, values, width=3):
    rows = [(0, k, v) for k, v in enumerate(values)]
    return windows.sliding_sum(spark.createDataFrame(rows, "example long, pos long, value double"), width)


def test_windows_are_added_up_by_themselves(spark):
    values = [1e9 + 0.1, 0.1, -0.3, 0.3, 0.0, -0.3, 0.1, 0.2, 7.7]
    got = {r.pos: r.total for r in _sums(spark, values).collect()}
    assert got == {k: values[k] + values[k + 1] + values[k + 2] for k in range(7)}
    rows = _sums(spark, values).select("example", "pos", (F.col("pos") + 3).alias("end"), (F.col("total") < 0).alias("rc"))
    texts = [r.text for r in rows.orderBy("pos").select(seqlets.to_string("example", "pos", "end", "rc").alias("text")).collect()]
    assert texts[2:4] == ["example:0,start:2,end:5,rc:False", "example:0,start:3,end:6,rc:False"]  # these sum to 0


def test_windows_that_sum_to_the_threshold_pass(spark):
    values = [1.52, 50.12, 3.77, 20.0, 20.0, 20.0, 1.0, 2.0, 3.0, 4.0]
    got = windows.candidates(_sums(spark, values), 60.0, -600.0, 2, "example").collect()
    assert [(r.pos, r.score) for r in got] == [(3, 60.0)]

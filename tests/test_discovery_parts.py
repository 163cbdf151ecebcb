"""Parts of discovery, matching, reports and conversions, each against a plain recomputation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackmotif import cli
from trackmotif.operators import descriptive, kernels, matching, thresholds
from trackmotif.plans import merge_runs
from trackmotif.sources import legacy, results, text


def test_laplace_draws_take_two_uniforms_each():
    rng = np.random.RandomState(1234)
    expected = []
    for _ in range(500):
        side, u = rng.uniform(), rng.uniform()
        expected.append(0.3 - np.log(1 - u) / 2.0 if side < 0.6 else 0.3 + np.log(1 - u) / 5.0)
    assert np.allclose(thresholds.laplace_draws(0.3, 2.0, 5.0, 0.6, 500), expected)


@pytest.mark.parametrize("columns_by", ["euclidean", "pearson"])
def test_match_p_values_by_counting(spark, columns_by):
    rng = np.random.RandomState(2)
    motif = lambda n: rng.dirichlet([0.4] * 4, n)
    queries = [("q0", motif(3)), ("q1", motif(2)), ("q2", motif(4))]
    db = [(f"m{k}", motif(rng.randint(2, 5))) for k in range(7)] + [("copy", queries[2][1][::-1, ::-1])]
    frame = lambda rows: spark.createDataFrame([(n, m.tolist()) for n, m in rows], "name string, pwm array<array<double>>")
    columns = [c for _, m in db for c in m] + [c[::-1] for _, m in db for c in m]
    db.append(("even", np.full((3, 4), 0.25)))
    columns += [np.full(4, 0.25)] * 6

    def score(a, b):
        if columns_by == "euclidean":
            return int(np.floor((1 - np.sqrt(((a - b) ** 2).sum()) / np.sqrt(2)) * 100 + 1e-9))
        return int(np.floor((1 + (np.corrcoef(a, b)[0, 1] if np.ptp(a) and np.ptp(b) else 0.0)) * 50 + 1e-9))

    expected = {}
    for name, q in queries:
        null = [[score(c, d) for d in columns] for c in q]
        for target, m in db:
            tried = []
            for strand, own in (("+", m), ("-", m[::-1, ::-1])):
                for o in range(-len(q) + 1, len(m)):
                    used = [k for k in range(len(q)) if 0 <= k + o < len(m)]
                    if len(used) < min(2, len(q), len(m)):
                        continue
                    total = sum(score(q[k], own[k + o]) for k in used)
                    sums = np.zeros(1, int)
                    for k in used:
                        sums = (sums[:, None] + np.array(null[k])).ravel()
                    tried.append(((sums >= total).mean(), -total, strand == "-", o, len(used)))
            p, total, reverse, o, overlap = min(tried)
            expected[name, target] = (1 - (1 - p) ** len(tried), -total, o, overlap, "-" if reverse else "+")
    for block in (100, 2):
        rows = matching.matches(frame(queries), frame(db), 20, 2, block, columns_by).collect()
        few = matching.matches(frame(queries), frame(db), 20, 2, block, columns_by, 2.5).collect()
        assert [tuple(r) for r in few] == [tuple(r) for r in rows if r.p * len(db) <= 2.5] and 0 < len(few) < len(rows)
        assert all(abs(r.e - r.p * len(db)) < 1e-12 for r in rows)
        assert len(rows) == len(expected)
        for r in rows:
            p, *rest = expected[r["query"], r.target]
            assert abs(r.p - p) < 1e-9 and [r.score, r.offset, r.overlap, r.strand] == rest
        best = [r for r in rows if r["query"] == "q2" and r["rank"] == 1]
        assert best[0].target == "copy" and best[0].strand == "-" and best[0].offset == 0
    names = {r.tag: r.name for r in matching.descriptive_names(matching.matches(frame(queries[:1]), frame(db), 2, 2), spark.createDataFrame([("q0",), ("zz",)], "tag string")).collect()}
    assert names["zz"] == "zz" and names["q0"].count(";") == 1
    assert matching.matches(frame(queries), frame(db[:0])).collect() == []


def test_quantile_examples_take_the_nearest_left(spark):
    rng = np.random.RandomState(3)
    rows = [(f"t{k % 3}", k, float(np.round(rng.gamma(2), 1))) for k in range(90)] + [("few", 100 + k, float(k)) for k in range(4)]
    rows += [("same", 200 + k, 2.5) for k in range(30)] + [("ten", 300 - k, float(k % 3)) for k in range(10)] + [("long", 1000 + k, float(rng.randint(20))) for k in range(3000)]
    got = descriptive.quantile_examples(spark.createDataFrame(rows, "tag string, ord long, importance double"), 10).collect()
    assert len(got) == 64
    for tag in ("t0", "t1", "t2", "few", "same", "ten", "long"):
        own = [(o, v) for t, o, v in rows if t == tag]
        steps, used, expected = np.linspace(10, 100, min(10, len(own))), set(), []
        for q in steps:
            value = np.percentile([v for _, v in own], q)
            o, v = min(((o, v) for o, v in own if o not in used), key=lambda x: (abs(x[1] - value), x[0]))
            used.add(o)
            expected.append((int(q), o, v))
        assert [(r.quantile, r.ord, r.importance) for r in sorted(got, key=lambda r: -r["rank"]) if r.tag == tag] == expected


def _run(seed, word, n=40, length=60):
    rng = np.random.RandomState(seed)
    tracks, members = [], []
    for k in range(n):
        s, hyp = rng.randint(0, 4, length), rng.normal(0, 0.01, (length, 4))
        at = rng.randint(15, 30)
        s[at : at + len(word)] = word
        hyp[np.arange(at, at + len(word)), word] += 1.0
        tracks.append((k, np.eye(4)[s].tolist(), hyp.tolist()))
        members.append(("pos", 0, k, k, at - 4, at + len(word) + 4, False, 0))
    return tracks, members


def test_runs_with_one_motif_merge(spark):
    word, other = np.array([0, 1, 2, 3, 0, 2, 1, 3, 2, 0, 1, 1]), np.array([3, 3, 1, 0, 2, 2, 0, 1, 3, 0, 2, 3])
    runs = []
    for seed, w in ((1, word), (2, word), (3, other)):
        t, m = _run(seed, w)
        t.append((999, t[0][1], t[0][2]))  # an example that no member lies on
        runs.append((spark.createDataFrame(m, "sign string, pattern_idx int, ord long, example_idx long, start long, end long, is_revcomp boolean, subcluster int"), spark.createDataFrame(t, "example_idx long, one_hot array<array<double>>, hyp array<array<double>>")))
    members, tracks, tree = merge_runs.merge(runs, kernels.Settings(trim=12, initial_flank=3, least=10))
    assert tracks.count() == 120 and sorted(r.example_idx for r in tracks.select("example_idx").collect()) == list(range(120))
    sizes = [r["count"] for r in members.groupBy("pattern_idx").count().orderBy("pattern_idx").collect()]
    assert sizes == [80, 40] and [(r.level, r.node, r.children, r.n_seqlets) for r in tree.collect()] == [(1, 3, [0, 1], 80)]


def test_reports_conversions_and_layouts(spark, tmp_path):
    tracks, members = _run(5, np.array([0, 1, 2, 3, 0, 2, 1, 3, 2, 0, 1, 1]))
    t = spark.createDataFrame(tracks, "example_idx long, one_hot array<array<double>>, hyp array<array<double>>")
    m = spark.createDataFrame([(*r[:7], k % 2 if k % 5 else 0) for k, r in enumerate(members)], "sign string, pattern_idx int, ord long, example_idx long, start long, end long, is_revcomp boolean, subcluster int")
    path = str(tmp_path / "r")
    results.save(m, t, path, 60)
    subs = results.subpatterns(spark, path).orderBy("subpattern_idx").collect()
    assert [s.n_seqlets for s in subs] == [24, 16] and subs[0].name == "pattern_0.subpattern_0"
    ppm = results.patterns(spark, path).first().ppm
    db = tmp_path / "db.meme"
    text.write_meme(spark.createDataFrame([("right one", ppm[2:18]), ("other", [[0.25] * 4] * 8)], "name string, pwm array<array<double>>"), str(db))
    motifs = text.read_meme(spark, str(db))
    assert sorted(r.name for r in motifs.collect()) == ["other", "right"]
    turn = lambda x: np.array(x).T.tolist()
    landed = str(tmp_path / "b.parquet")
    spark.createDataFrame([(k, turn(a), turn(b)) for k, a, b in tracks], "example_idx long, raw_seq array<array<double>>, shap_seq array<array<double>>").write.parquet(landed)
    a_layout = str(tmp_path / "a.parquet")
    t.withColumnsRenamed({"one_hot": "input_seqs", "hyp": "hyp_scores"}).write.parquet(a_layout)
    for p in (landed, a_layout):
        back = {r.example_idx: r for r in legacy.read_tracks(spark, p).collect()}
        assert all(np.allclose(back[k].one_hot, a) and np.allclose(back[k].hyp, b) for k, a, b in tracks)
    assert len(legacy.read_tracks(spark, landed, 20).first().hyp) == 20
    cli.main(["report", "--results", path, "--output", str(tmp_path / "d.html"), "--meme-db", str(db), "--sequences", landed, "--attributions", landed, "--write-tomtom", str(tmp_path / "t")], spark)
    page = (tmp_path / "d.html").read_text()
    assert "right;other" in page and page.count("<figcaption>") == 5 and page.count("<svg") >= 5 + 2 + 10 + 2
    assert (tmp_path / "t/tomtom/pos_patterns.pattern_0.tomtom.tsv").read_text().split("\n")[1].startswith("pos_patterns.pattern_0\tright\t")
    cli.main(["report-simple", "--results", path, "--output", str(tmp_path / "s.html"), "--meme-db", str(db)], spark)
    assert "<td>right<td>" in (tmp_path / "s.html").read_text()
    cli.main(["convert-backward", "--results", path, "--output", str(tmp_path / "old")], spark)
    cli.main(["convert", "--results", str(tmp_path / "old/seqlets"), "--output", str(tmp_path / "new"), "--sequences", a_layout, "--attributions", a_layout, "--window", "60"], spark)
    assert sorted(map(tuple, results.members(spark, str(tmp_path / "new")).select(*m.columns).collect())) == sorted(map(tuple, m.collect()))
    results.save_seqlets(spark, path, "pos", 0, t, str(tmp_path / "one.fa"))
    lines = (tmp_path / "one.fa").read_text().split("\n")
    assert lines[0] == f">example0:{members[0][4]}-{members[0][5]}" and len(lines) == 81 and set(lines[1]) <= set("ACGT")


def test_bed_and_tomtom_forms(spark, tmp_path):
    row = spark.range(1).select(text.track_line(F.lit("a b"), visibility="2", description="two words").alias("t"), text.bed_line(*(F.lit(x) for x in ("chr1", "1", "2", None, "x"))).alias("l")).first()
    assert row.t == 'track name="a b" visibility="2" description="two words"' and row.l == "chr1\t1\t2\tx"
    path = tmp_path / "t.tsv"
    path.write_text("Query\tTarget\tOffset\tp\tE\tq\n1\tM1\t0\t0.1\t1\t0.5\n# end\n")
    assert [tuple(r) for r in text.read_tomtom(spark, str(path)).collect()] == [("M1", 0.5)]
    with pytest.raises(ValueError):
        results.motif("other")

"""Queries of what discovery, matching, reports and conversions are made of, over the E-track."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from trackmotif.functions import align, kmers, vec
from trackmotif.operators import descriptive, graph, kernels, knn, matching, patterns, seqlets, thresholds, windows
from trackmotif.plans.bindings import E_SQL, WINDOW, e_track, long, v_track
from trackmotif.plans.merge_runs import union_of
from trackmotif.plans.pattern_queries import _M, _means, auroc_pairs
from trackmotif.plans.similarity_queries import _BOTH, _WORDS, CHOICE, ENTRIES, K, SITES, SPAN, _both, _sites
from trackmotif.session import materialise, ship_package
from trackmotif.sources import legacy, results

PERPLEXITY, FILL, LEAST, OVERLAP = 2.0, 40, 5, 0.7
r6 = lambda c: F.round(c, 6)


def _members(spark, sf_dir):
    """Seqlets of 8 positions on the E-track, in patterns by label."""
    rows = e_track(spark, sf_dir).withColumn("start", (F.col("vec_id") % 9).cast("long"))
    sign = F.when(F.col("label") % 2 == 0, "pos").otherwise("neg")
    order = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return rows.select(sign.alias("sign"), F.col("label").cast("int").alias("pattern_idx"), order.cast("long").alias("ord"), F.col("vec_id").alias("example_idx"), "start", (F.col("start") + 8).alias("end"), (F.col("vec_id") % 2 == 1).alias("is_revcomp"), (F.col("vec_id") % 3).cast("int").alias("subcluster"))


def seqlet_slices(spark, sf_dir):
    cut = seqlets.slices(_members(spark, sf_dir), e_track(spark, sf_dir).withColumnRenamed("vec_id", "example_idx"), ("contrib",))
    return long(cut, "contrib", "x", "example_idx").select("example_idx", "pos", "base", (r6("x") + F.lit(0.0)).alias("x"))


def seqlet_fasta(spark, sf_dir):
    cut = seqlets.slices(_members(spark, sf_dir), e_track(spark, sf_dir).withColumnRenamed("vec_id", "example_idx"), ("one_hot",))
    return cut.select(F.format_string("example%d:%d-%d", "example_idx", "start", "end").alias("header"), seqlets.key().alias("key"), vec.sequence_of(F.col("one_hot")).alias("bases"))


def subpattern_means(spark, sf_dir):
    from trackmotif.plans.discover import summarised

    tracks = e_track(spark, sf_dir).select(F.col("vec_id").alias("example_idx"), "one_hot", "hyp")
    found = summarised(_members(spark, sf_dir), tracks, "subcluster")
    return long(found, "cwm", "x", "sign", "pattern_idx", "subcluster", "n_seqlets").select("sign", "pattern_idx", "subcluster", "n_seqlets", "pos", "base", (r6("x") + F.lit(0.0)).alias("cwm"))


def old_results(spark, sf_dir):
    return legacy.to_old(_members(spark, sf_dir))


def old_results_read(spark, sf_dir):
    return legacy.from_old(legacy.to_old(_members(spark, sf_dir)))


def channels_first(spark, sf_dir):
    rows = e_track(spark, sf_dir).select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda b: F.transform("hyp", lambda r: F.get(r, b))).alias("raw"))
    return long(rows.select("vec_id", legacy.turned(F.col("raw")).alias("t")), "t", "x", "vec_id").select("vec_id", "pos", "base", r6("x").alias("x"))


def pattern_orders(spark, sf_dir):
    names = _members(spark, sf_dir).select("sign", "pattern_idx").distinct().withColumn("name", results.tag())
    by = lambda c: F.row_number().over(Window.partitionBy("sign").orderBy(c)).cast("long")
    return names.select("name", by("pattern_idx").alias("by_number"), by("name").alias("by_name"))


def pattern_sizes(spark, sf_dir):
    sizes = _members(spark, sf_dir).groupBy("sign", "pattern_idx").agg(F.count("*").alias("n"))
    return sizes.withColumn("rank", F.row_number().over(Window.partitionBy("sign").orderBy(F.desc("n"), "pattern_idx")).cast("long"))


def metacluster_gate(spark, sf_dir):
    rows = _members(spark, sf_dir).withColumn("sign", F.when(F.col("example_idx") % 10 == 0, "neg").otherwise("pos"))
    return seqlets.large_enough(rows, 100).groupBy("sign").agg(F.count("*").alias("n"))


def pattern_sign_filter(spark, sf_dir):
    """Labels whose contributions, beside the mean of all, have the sign of the track they count as."""
    rows = e_track(spark, sf_dir).select("label", vec.total(vec.flatten(F.col("contrib"))).alias("x"))
    mean = rows.agg(F.avg("x").alias("mean"))
    totals = rows.crossJoin(F.broadcast(mean)).groupBy("label").agg(F.sum(F.col("x") - F.col("mean")).alias("total"))
    signed = totals.withColumn("sign", F.when(F.col("label") % 2 == 0, "pos").otherwise("neg"))
    return patterns.of_sign(signed, "total", "sign").select("label", "sign", r6("total").alias("total"))


def runs_union(spark, sf_dir):
    """Two runs, of even and of odd examples; each has as many more examples on which no member lies, and which go."""
    tracks = e_track(spark, sf_dir).select(F.col("vec_id").alias("example_idx"), "one_hot", "hyp")
    runs = []
    for k in (0, 1):
        own = tracks.where(f"example_idx % 2 = {k}")
        idle = own.withColumn("example_idx", -1 - F.col("example_idx"))
        runs.append((_members(spark, sf_dir).where(f"example_idx % 2 = {k}"), own.unionByName(idle)))
    members, kept = union_of(runs)
    there = kept.select(F.col("run"), F.col("example_idx").alias("to"))
    return members.join(there, (F.col("example_idx") == F.col("to")) & (members.run == there.run), "left_semi").select("run", "sign", "pattern_idx", "ord", "example_idx")


def centred_features(spark, sf_dir):
    rows = e_track(spark, sf_dir).select("vec_id", vec.reshape(vec.centred_l2(vec.flatten(F.col("contrib")))).alias("t"))
    return long(rows, "t", "x", "vec_id").select("vec_id", "pos", "base", r6("x").alias("x"))


def both_track_features(spark, sf_dir):
    flat = lambda t: vec.reshape(vec.l1(vec.flatten(F.col(t))))
    rows = e_track(spark, sf_dir).select("vec_id", F.zip_with(flat("hyp"), flat("contrib"), lambda a, b: F.concat(a, b)).alias("t"))
    return long(rows, "t", "x", "vec_id").select("vec_id", "pos", F.col("base").alias("channel"), (r6("x") + F.lit(0.0)).alias("x"))


def information_as_given(spark, sf_dir):
    m = patterns.matrices(_means(spark, sf_dir), "label", "one_hot")
    return m.select("label", F.posexplode(vec.information(F.col("one_hot"), [0.25] * 4, renormalise=False)).alias("pos", "ic")).select("label", "pos", r6("ic").alias("ic"))


def zero_filled_knn(spark, sf_dir):
    """Neighbours by few words, more than rows have, so that they fall short and are filled."""
    rows = knn.normalised(kmers.word_scores(_sites(spark, sf_dir), "sites", "vec_id", 3, **CHOICE), "vec_id")
    near = knn.of_all(rows.withColumnRenamed("vec_id", "i"), None, FILL)
    pairs = materialise(near, "near").select(F.lit("pos").alias("sign"), "i", "j", F.round("sim", 9).alias("sim"))
    ids = e_track(spark, sf_dir).select(F.lit("pos").alias("sign"), F.col("vec_id").alias("id"))
    return knn.filled(pairs, ids, FILL, "sign").select("i", "j", "rank", r6("sim").alias("sim"))


def strand_knn(spark, sf_dir):
    """Words in common on either strand, and the larger of both similarities."""
    rows = e_track(spark, sf_dir).withColumn("contrib", vec.reverse_complement(F.col("contrib"))).withColumn("one_hot", vec.reverse_complement(F.col("one_hot")))
    base = F.transform("one_hot", lambda row: F.array_position(row, F.array_max(row)).cast("int") - 1)
    turned = rows.select("vec_id", kmers.top_sites(vec.row_sums(F.col("contrib")), base, SITES).alias("sites"))
    words = lambda sites: knn.normalised(kmers.word_scores(sites, "sites", "vec_id", ENTRIES, **CHOICE), "vec_id")
    own = materialise(words(_sites(spark, sf_dir)), "words")
    strand = lambda rows, part: rows.select(F.col("vec_id").alias("j"), F.lit(part).alias("part"), "word", "value")
    near = knn.of_all(own.withColumnRenamed("vec_id", "i"), strand(own, 0).unionByName(strand(words(turned), 1)), K)
    return near.where("sim > 0").select("i", "j", "rank", r6("sim").alias("sim"))


def subcluster_probs(spark, sf_dir):
    edges = _both(spark, sf_dir).where("i <> j").select("i", "j", F.round(graph.distance("fine"), 9).alias("d"))
    return graph.conditional(edges, PERPLEXITY).select("i", "j", r6("p").alias("p"))


def fold_align(spark, sf_dir):
    """Each seqlet on its label's mean: the best place and strand, as folding has it for the first seqlet to come."""
    ship_package(spark)
    means = patterns.matrices(_means(spark, sf_dir), "label", "contrib").withColumnRenamed("contrib", "mean")
    pairs = e_track(spark, sf_dir).select("vec_id", "label", "contrib").join(F.broadcast(means), "label").select("vec_id", "contrib", "mean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from trackmotif.plans.discover import tensors

        for batch in batches:
            out = []
            for child, parent in zip(tensors(batch.column(1)), tensors(batch.column(2)), strict=True):
                a, b, c = (kernels.l1(x) for x in (parent, child, child[::-1, ::-1]))
                out.append(kernels.align(a, b, c, "jaccard", OVERLAP, 9))
            place, turned, score = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(place, pa.int32()), pa.array(turned, pa.bool_()), pa.array(score, pa.float64())], names=["vec_id", "offset", "is_revcomp", "score"])

    found = pairs.mapInArrow(run, "vec_id long, offset int, is_revcomp boolean, score double")
    return found.select("vec_id", "offset", "is_revcomp", r6("score").alias("score"))


def _motifs(spark, sf_dir, by, name):
    m = patterns.matrices(_means(spark, sf_dir, by), by, "one_hot")
    return m.select(F.concat(F.lit(name), F.col(by)).alias("name"), F.slice("one_hot", (F.col(by) % 3 + 1).cast("int"), 9).alias("pwm"))


def motif_match_places(spark, sf_dir):
    """The best total of column scores of each pattern on each motif, over offsets and strands."""
    ship_package(spark)
    q = _motifs(spark, sf_dir, "label", "pattern ").withColumnsRenamed({"name": "query", "pwm": "q"})
    pairs = q.crossJoin(F.broadcast(_motifs(spark, sf_dir, "motif", "motif ").withColumnRenamed("name", "target")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b in zip(batch.column("q").to_pylist(), batch.column("pwm").to_pylist(), strict=True):
                a, b = np.round(a, 9), np.round(b, 9)
                flat = {(x, y): np.ones(len(a) * matching.SCORES) for x in range(len(a)) for y in range(x + 1, len(a) + 1)}
                out.append(matching.best_place(a, b, flat, LEAST)[1:])
            score, offset, overlap, strand = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("target"), pa.array(score, pa.int64()), pa.array(offset, pa.int32()), pa.array(overlap, pa.int32()), pa.array(strand, pa.string())], names=["query", "target", "score", "offset", "overlap", "strand"])

    return pairs.select("query", "q", "target", "pwm").mapInArrow(run, "query string, target string, score long, offset int, overlap int, strand string")


def motif_match_pvalues(spark, sf_dir):
    return matching.matches(_motifs(spark, sf_dir, "label", "pattern "), _motifs(spark, sf_dir, "motif", "motif "), 3, block_motifs=3)


def _described(spark, sf_dir):
    rows = e_track(spark, sf_dir).select(F.concat(F.lit("pattern "), "label").alias("tag"), F.col("vec_id").alias("ord"), F.round(descriptive.importance(F.col("contrib")), 9).alias("importance"), (F.col("vec_id") % 300).alias("start"), (F.col("vec_id") % 300 + 16).alias("end"))
    return descriptive.placed(rows)


def importance_density(spark, sf_dir):
    return descriptive.densities(_described(spark, sf_dir), "importance").select("tag", "bin", *(r6(c).alias(c) for c in ("low", "high", "density")))


def place_statistics(spark, sf_dir):
    return descriptive.statistics(_described(spark, sf_dir)).select("tag", "n", *(r6(c).alias(c) for c in ("std_importance", "median_distance", "std_distance")))


def quantile_examples(spark, sf_dir):
    return descriptive.quantile_examples(_described(spark, sf_dir))


def laplace_null(spark, sf_dir):
    """Draws from the null of the V-track: its mode, rates and the share of values above the mode."""
    track = v_track(spark, sf_dir)
    r = thresholds.laplace_rates(track, "value", thresholds.two_level_mode(track, "value", 50)).first()
    n = track.agg(F.count_if(F.col("value") >= r.mu).alias("up"), F.count_if(F.col("value") <= r.mu).alias("down")).first()
    draws = thresholds.laplace_draws(r.mu, r.rate_up, r.rate_down, n.up / (n.up + n.down))
    return spark.createDataFrame([(k, float(x)) for k, x in enumerate(draws)], "k long, x double")


def fdr_threshold(spark, sf_dir):
    """Of the V-track's windows: the thresholds that discovery would take."""
    smoothed = materialise(windows.sliding_sum(v_track(spark, sf_dir), WINDOW, "user_id"), "smoothed")
    return spark.createDataFrame([thresholds.thresholds(smoothed)], "high double, low double, sign double")


def discover_patterns(spark, sf_dir):
    """Members of the patterns of the E-track, from windows to merged patterns and subpatterns."""
    from trackmotif.plans import discover

    tracks = e_track(spark, sf_dir).select(F.col("vec_id").alias("example_idx"), "one_hot", "hyp")
    return discover.discover(tracks, kernels.Settings(window=3, flank=1, min_metacluster=20, neighbours=30, perplexity=5.0, seeds=2, trim=4, initial_flank=0, least=5, sub_perplexity=10.0, min_cluster=5, min_ic=-1.0, ic_window=4))


def merge_order(spark, sf_dir):
    """Which labels collapsing would merge, in order, by similarities of all rows; the labels' pairs are what the driver holds."""
    mean = patterns.matrices(_means(spark, sf_dir), "label", "contrib").select("label", vec.centred_l2(vec.flatten(F.col("contrib"))).alias("m"))
    sim = mean.select(F.col("label").alias("a"), F.col("m").alias("x")).join(mean.select(F.col("label").alias("b"), F.col("m").alias("y")), F.col("a") < F.col("b")).select("a", "b", F.round(vec.cosine(F.col("x"), F.col("y")), 9).alias("sim"))
    both = materialise(auroc_pairs(spark, sf_dir).select("a", "b", F.col("contamination").alias("c")), "contamination")
    back = both.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("c").alias("back"))
    rows = sim.join(both, ["a", "b"]).join(back, ["a", "b"]).select("a", "b", "sim", F.least("c", "back").alias("least"), ((F.col("c") + F.col("back")) / 2).alias("mean")).collect()
    found = patterns.merges([tuple(r) for r in rows], [(0.8, -0.5)], [(0.2, -0.3)])
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(found)], "k long, a int, b int")


_MEMBERS = E_SQL + """, mem AS (SELECT CASE WHEN label % 2 = 0 THEN 'pos' ELSE 'neg' END AS sign, label::INT AS pattern_idx, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::BIGINT AS ord, vec_id AS example_idx,
  vec_id % 9 AS start, vec_id % 9 + 8 AS "end", vec_id % 2 = 1 AS is_revcomp, (vec_id % 3)::INT AS subcluster FROM embeddings),
cut AS (SELECT m.*, CASE WHEN is_revcomp THEN "end" - 1 - pos ELSE pos - start END::INT AS p, CASE WHEN is_revcomp THEN 3 - base ELSE base END::INT AS b, one, contrib FROM mem m JOIN c ON c.vec_id = m.example_idx AND c.pos >= m.start AND c.pos < m."end")"""
_OLD = "SELECT CASE sign WHEN 'pos' THEN 'metacluster_0' ELSE 'metacluster_1' END AS metacluster, 'pattern_' || pattern_idx AS pattern, ord, subcluster, 'example:' || example_idx || ',start:' || start || ',end:' || \"end\" || ',rc:' || CASE WHEN is_revcomp THEN 'True' ELSE 'False' END AS seqlet, 0 AS alnmt FROM mem"
_DESC = E_SQL + """, s AS (SELECT vec_id, label, round(sum(abs(contrib)), 9) AS i FROM c GROUP BY vec_id, label), d AS (SELECT 'pattern ' || label AS tag, i, vec_id % 300 + 8 AS middle FROM s)"""
_TURNED = f""", tp AS (SELECT vec_id, (15 - pos)::INT AS pos, sum(contrib) AS score, 3 - max(base) FILTER (one = 1) AS base FROM c GROUP BY vec_id, pos),
ts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, pos) AS k FROM tp) WHERE k <= {SITES}),
tw AS (SELECT vec_id, word, sum(value) AS value FROM (
  SELECT a.vec_id, (a.base + 1 + (b.base + 1) * (5 ** (b.pos - a.pos)))::BIGINT AS word, (a.score + b.score) / 2 AS value FROM ts a JOIN ts b ON a.vec_id = b.vec_id AND b.pos > a.pos AND b.pos - a.pos < {SPAN} UNION ALL
  SELECT a.vec_id, (a.base + 1 + (b.base + 1) * (5 ** (b.pos - a.pos)) + (d.base + 1) * (5 ** (d.pos - a.pos)))::BIGINT, (a.score + b.score + d.score) / 3
  FROM ts a JOIN ts b ON a.vec_id = b.vec_id AND b.pos > a.pos JOIN ts d ON a.vec_id = d.vec_id AND d.pos > b.pos AND d.pos - a.pos < {SPAN}) GROUP BY vec_id, word),
tn AS (SELECT vec_id, word, value / sqrt(sum(value * value) OVER (PARTITION BY vec_id)) AS value FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(round(value, 9)) DESC, word) AS k FROM tw) WHERE k <= {ENTRIES}),
td AS (SELECT a.vec_id AS i, b.vec_id AS j, sum(a.value * b.value) AS sim FROM nw a JOIN tn b USING (word) GROUP BY 1, 2),
best AS (SELECT coalesce(d.i, td.i) AS i, coalesce(d.j, td.j) AS j, greatest(coalesce(d.sim, 0), coalesce(td.sim, 0), 0) AS sim FROM dots d FULL JOIN td ON d.i = td.i AND d.j = td.j)"""
_PAD = align.padding(16, OVERLAP)
_PLACE = _M + f""", db AS (SELECT (vec_id % 7)::BIGINT AS motif, pos, base, avg(one) AS t FROM c GROUP BY 1, 2, 3),
q AS (SELECT label, pos - label % 3 AS pos, base, round(ppm, 9) AS q FROM m WHERE pos >= label % 3 AND pos < label % 3 + 9),
tt AS (SELECT motif, pos - motif % 3 AS pos, base, round(t, 9) AS t FROM db WHERE pos >= motif % 3 AND pos < motif % 3 + 9),
st AS (SELECT motif, '+' AS strand, pos, base, t FROM tt UNION ALL SELECT motif, '-', 8 - pos, 3 - base, t FROM tt),
col AS (SELECT label, motif, strand, q.pos AS qp, st.pos AS tp, greatest(least(floor((1 - sqrt(sum((q - t) ** 2)) / sqrt(2)) * 100 + 1e-9), 100), 0)::BIGINT AS s FROM q JOIN st USING (base) GROUP BY ALL),
tot AS (SELECT label, motif, strand, (tp - qp)::INT AS o, sum(s)::BIGINT AS score, count(*)::INT AS overlap FROM col GROUP BY ALL HAVING count(*) >= {LEAST})"""

QUERIES = {
    "seqlet_slices": (seqlet_slices, _MEMBERS + " SELECT example_idx, p AS pos, b AS base, round(contrib, 6) + 0.0::DOUBLE AS x FROM cut"),
    "seqlet_fasta": (seqlet_fasta, _MEMBERS + " SELECT 'example' || example_idx || ':' || start || '-' || \"end\" AS header, example_idx || '_' || start || '_' || \"end\" AS key, string_agg(substr('ACGT', b + 1, 1), '' ORDER BY p) AS bases FROM cut WHERE one = 1 GROUP BY example_idx, start, \"end\""),
    "subpattern_means": (
        subpattern_means,
        _MEMBERS + ", n AS (SELECT pattern_idx, subcluster, count(*) AS n_seqlets FROM mem GROUP BY ALL) SELECT sign, pattern_idx, subcluster, n_seqlets, p AS pos, b AS base, round(avg(contrib), 6) + 0.0::DOUBLE AS cwm FROM cut JOIN n USING (pattern_idx, subcluster) GROUP BY ALL",
    ),
    "old_results": (old_results, _MEMBERS + " " + _OLD),
    "old_results_read": (old_results_read, _MEMBERS + ' SELECT sign, pattern_idx, ord, example_idx, start, "end", is_revcomp, subcluster FROM mem'),
    "channels_first": (channels_first, E_SQL + " SELECT vec_id, pos, base, round(hyp, 6) AS x FROM c"),
    "pattern_orders": (pattern_orders, _MEMBERS + " SELECT name, row_number() OVER (PARTITION BY sign ORDER BY pattern_idx)::BIGINT AS by_number, row_number() OVER (PARTITION BY sign ORDER BY name)::BIGINT AS by_name FROM (SELECT DISTINCT sign, pattern_idx, sign || '_patterns.pattern_' || pattern_idx AS name FROM mem)"),
    "pattern_sizes": (pattern_sizes, _MEMBERS + " SELECT *, row_number() OVER (PARTITION BY sign ORDER BY n DESC, pattern_idx)::BIGINT AS rank FROM (SELECT sign, pattern_idx, count(*) AS n FROM mem GROUP BY ALL)"),
    "metacluster_gate": (metacluster_gate, "SELECT CASE WHEN vec_id % 10 = 0 THEN 'neg' ELSE 'pos' END AS sign, count(*) AS n FROM embeddings GROUP BY 1 HAVING count(*) > 100"),
    "pattern_sign_filter": (
        pattern_sign_filter,
        E_SQL + """, x AS (SELECT vec_id, label, sum(contrib) AS x FROM c GROUP BY ALL), s AS (SELECT label, CASE WHEN label % 2 = 0 THEN 'pos' ELSE 'neg' END AS sign, sum(x - (SELECT avg(x) FROM x)) AS total FROM x GROUP BY label)
        SELECT label, sign, round(total, 6) AS total FROM s WHERE sign(total) = CASE sign WHEN 'pos' THEN 1 ELSE -1 END""",
    ),
    "runs_union": (
        runs_union,
        _MEMBERS + " SELECT (example_idx % 2)::INT AS run, sign, pattern_idx, ord, (row_number() OVER (ORDER BY example_idx % 2, example_idx) - 1)::BIGINT AS example_idx FROM mem",
    ),
    "centred_features": (
        centred_features,
        E_SQL + ", z AS (SELECT *, contrib - avg(contrib) OVER (PARTITION BY vec_id) AS y FROM c) SELECT vec_id, pos, base, round(y / (sqrt(sum(y * y) OVER (PARTITION BY vec_id)) + 1e-7), 6) AS x FROM z",
    ),
    "both_track_features": (
        both_track_features,
        E_SQL + " SELECT vec_id, pos, base AS channel, round(hyp / sum(abs(hyp)) OVER (PARTITION BY vec_id), 6) + 0.0::DOUBLE AS x FROM c UNION ALL SELECT vec_id, pos, base + 4, round(contrib / sum(abs(contrib)) OVER (PARTITION BY vec_id), 6) + 0.0::DOUBLE FROM c",
    ),
    "information_as_given": (information_as_given, _M + " SELECT label, pos, round(sum(log2((ppm + 0.001) / 1.004) * ppm + 0.5), 6) AS ic FROM m GROUP BY label, pos"),
    "zero_filled_knn": (
        zero_filled_knn,
        _WORDS.replace(f"WHERE k <= {ENTRIES})", "WHERE k <= 3)")
        + f""", few AS (SELECT a.vec_id AS i, b.vec_id AS j, round(sum(a.value * b.value), 9) AS sim FROM nw a JOIN nw b USING (word) GROUP BY 1, 2),
        ids AS (SELECT vec_id AS i FROM embeddings),
        every AS (SELECT a.i, b.i AS j, coalesce(greatest(sim, 0), 0) AS sim FROM ids a CROSS JOIN ids b LEFT JOIN few ON few.i = a.i AND few.j = b.i)
        SELECT i, j, rank, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j)::BIGINT AS rank FROM every) WHERE rank <= {FILL}""",
    ),
    "strand_knn": (strand_knn, _WORDS + _TURNED + f" SELECT i, j, rank, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(sim, 9) DESC, j)::BIGINT AS rank FROM best WHERE sim > 0) WHERE rank <= {K}"),
    "subcluster_probs": (
        subcluster_probs,
        (_WORDS + _BOTH).replace("WITH t", "WITH RECURSIVE t", 1)
        + f""", ed AS (SELECT i, j, round(greatest(ln(2.0::DOUBLE / greatest(fine, 1e-7) - 1), 0), 9) AS d FROM fine WHERE i <> j),
        rowsd AS (SELECT i, list(d ORDER BY d) AS ds FROM ed GROUP BY i),
        bis AS (SELECT i, ds, 0 AS step, 1.0::DOUBLE AS beta, '-infinity'::DOUBLE AS low, 'infinity'::DOUBLE AS high, false AS done FROM rowsd UNION ALL
          SELECT i, ds, step + 1, CASE WHEN ok THEN beta WHEN gap > 0 THEN CASE WHEN isinf(high) THEN beta * 2 ELSE (beta + high) / 2 END ELSE CASE WHEN isinf(low) THEN beta / 2 ELSE (beta + low) / 2 END END,
            CASE WHEN NOT ok AND gap > 0 THEN beta ELSE low END, CASE WHEN NOT ok AND gap <= 0 THEN beta ELSE high END, ok
          FROM (SELECT *, abs(gap) <= 1e-5 AS ok FROM (SELECT *, ln(p) + beta * dp / p - ln({PERPLEXITY}) AS gap FROM (SELECT *, greatest(list_sum(list_transform(ds, lambda d: exp(-d * beta))), 1e-8) AS p, list_sum(list_transform(ds, lambda d: d * exp(-d * beta))) AS dp FROM bis WHERE step < 100 AND NOT done))) x),
        betas AS (SELECT i, arg_max(beta, step) AS beta FROM bis GROUP BY i)
        SELECT ed.i, ed.j, round(exp(-d * beta) / greatest(sum(exp(-d * beta)) OVER (PARTITION BY ed.i), 1e-8), 6) AS p FROM ed JOIN betas ON betas.i = ed.i""",
    ),
    "fold_align": (
        fold_align,
        _M + f""", parent AS (SELECT label, pos, base, cwm / sum(abs(cwm)) OVER (PARTITION BY label) AS t FROM m),
        child AS (SELECT vec_id, label, pos, base, contrib / sum(abs(contrib)) OVER (PARTITION BY vec_id) AS q FROM c),
        strands AS (SELECT vec_id, label, pos, base, q, false AS rc FROM child UNION ALL SELECT vec_id, label, 15 - pos, 3 - base, q, true FROM child),
        al AS (SELECT s.vec_id, rc, o.o, q, coalesce(t, 0) AS t FROM strands s CROSS JOIN range(-{_PAD}, {_PAD} + 1) o(o) LEFT JOIN parent p ON p.label = s.label AND p.base = s.base AND p.pos = s.pos + o.o),
        sc AS (SELECT vec_id, rc, o, round(sum(least(abs(q), abs(t)) * sign(q) * sign(t)) / sum(greatest(abs(q), abs(t))), 9) AS score FROM al GROUP BY ALL)
        SELECT vec_id, o::INT AS "offset", rc AS is_revcomp, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, rc, o) AS k FROM sc) WHERE k = 1""",
    ),
    "motif_match_places": (
        motif_match_places,
        _PLACE + " SELECT 'pattern ' || label AS query, 'motif ' || motif AS target, score, o AS \"offset\", overlap, strand FROM (SELECT *, row_number() OVER (PARTITION BY label, motif ORDER BY score DESC, strand = '-', o) AS k FROM tot) WHERE k = 1",
    ),
    "motif_match_pvalues": (motif_match_pvalues, None),
    "importance_density": (
        importance_density,
        _DESC + """, l AS (SELECT tag, min(i) AS lo, max(i) AS hi, count(*) AS n FROM d GROUP BY tag),
        k AS (SELECT tag, least(floor((i - lo) / (hi - lo) * 30), 29)::INT AS bin, count(*) AS k FROM d JOIN l USING (tag) GROUP BY ALL)
        SELECT l.tag, b::INT AS bin, round(lo + b * ((hi - lo) / 30), 6) AS low, round(lo + (b + 1) * ((hi - lo) / 30), 6) AS high, round(coalesce(k, 0) / (n * ((hi - lo) / 30)), 6) AS density FROM l CROSS JOIN range(0, 30) r(b) LEFT JOIN k ON k.tag = l.tag AND k.bin = b""",
    ),
    "place_statistics": (
        place_statistics,
        _DESC + ", mid AS (SELECT (min(middle) - 8 + max(middle) + 8) / 2 AS m FROM d) SELECT tag, count(*) AS n, round(stddev_pop(i), 6) AS std_importance, round(median(abs(middle - m)), 6) AS median_distance, round(stddev_pop(abs(middle - m)), 6) AS std_distance FROM d, mid GROUP BY tag",
    ),
    "quantile_examples": (quantile_examples, None),
    "laplace_null": (laplace_null, None),
    "fdr_threshold": (fdr_threshold, None),
    "merge_order": (merge_order, None),
    "discover_patterns": (discover_patterns, None),
}

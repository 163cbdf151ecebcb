"""Queries of patterns (the E-track by label), of peaks and coordinates, and of text exports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackmotif.functions import vec
from trackmotif.operators import aurocs, kernels, matching, patterns, ranking, seqlets
from trackmotif.plans.bindings import E_SQL, e_track, long
from trackmotif.session import materialise, ship_package, table
from trackmotif.sources import text

WIDTH, CHROMS, CROP = 6, ("chr1", "chr3", "chr7"), 400
#: Rows a label that are compared at most, drawn by hash, as many as the reference draws from a pattern.
SUB_SAMPLE = 1000
r6 = lambda c: F.round(c, 6)


def _means(spark, sf_dir, by="label"):
    rows = e_track(spark, sf_dir)
    rows = rows if by in rows.columns else rows.withColumn(by, F.col("vec_id") % 7)
    return patterns.means(rows.select(by, "one_hot", "contrib", "hyp"), by, "one_hot", "contrib", "hyp")


def pattern_means(spark, sf_dir):
    return _means(spark, sf_dir).select("label", "pos", "base", r6("one_hot").alias("ppm"), r6("contrib").alias("cwm"), r6("hyp").alias("hcwm"), "n")


def background_freq(spark, sf_dir):
    return patterns.background(long(e_track(spark, sf_dir), "one_hot", "one")).select("base", r6("freq").alias("freq"))


def _ic(spark, sf_dir):
    bg = patterns.background(long(e_track(spark, sf_dir), "one_hot", "one"))
    return patterns.information(_means(spark, sf_dir).select("label", "pos", "base", F.col("one_hot").alias("p")), bg, "label")


def per_position_ic(spark, sf_dir):
    return _ic(spark, sf_dir).select("label", "pos", r6("ic").alias("ic"))


def best_ic_window(spark, sf_dir):
    return patterns.best_window(_ic(spark, sf_dir), WIDTH, "label").select("label", "start", r6("total").alias("total"))


def pattern_filter(spark, sf_dir):
    n = e_track(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))
    found = patterns.best_window(_ic(spark, sf_dir), WIDTH, "label").join(n, "label")
    return found.where("n >= 20 and total >= 0.15").select("label", "n", r6("total").alias("total"))


def pattern_support_trim(spark, sf_dir):
    scores = e_track(spark, sf_dir).select("label", F.posexplode(vec.row_sums(F.col("contrib"))).alias("pos", "score"))
    counts = scores.groupBy("label", "pos").agg(F.sum((F.col("score") > 1.5).cast("long")).alias("n"))
    return patterns.support_bounds(counts, "label", "pos", "n", 0.8, 1000)


def _scaled(spark, sf_dir):
    return e_track(spark, sf_dir).select("vec_id", "label", vec.l1(vec.flatten(F.col("contrib"))).alias("x"))


def _pair_scores(rows: DataFrame, size: int = aurocs.BLOCK) -> DataFrame:
    """a, b, sim, n: how often a row of label a and one of label b have each similarity, over all rows."""
    width = aurocs.width_of(rows.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                values, counts = aurocs.unpacked(batch.column("data")[k].as_buffer(), batch.column("n")[k].as_py())
                sims = (values + batch.column("range")[k].as_py() * width - aurocs.ONE) / aurocs.ONE
                labels = [pa.concat_arrays([batch.column(c).slice(k, 1)] * len(sims)) for c in ("a", "b")]
                yield pa.RecordBatch.from_arrays([*labels, pa.array(sims), pa.array(counts)], names=["a", "b", "sim", "n"])

    found = aurocs.pair_scores(rows, size, width).mapInArrow(run, "a int, b int, sim double, n long").groupBy("a", "b", "sim").agg(F.sum("n").alias("n"))
    return found.unionByName(found.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "sim", "n"))


def auroc_pairs(spark, sf_dir):
    """Over all rows of all labels."""
    found = aurocs.of_labels(_scaled(spark, sf_dir))
    return found.select("a", "b", r6("auroc").alias("auroc"), r6(patterns.contamination(F.col("auroc"))).alias("contamination"))


def _label_aurocs(rows: DataFrame) -> DataFrame:
    """a, b, auroc of label, x: how well similarities within a are told from those of a with b. A task has a pair of labels."""
    ship_package(rows.sparkSession)
    blocks = rows.groupBy("label").agg(F.collect_list("x").alias("x"))
    pairs = blocks.select(F.col("label").alias("a"), F.col("x").alias("xa")).join(blocks.select(F.col("label").alias("b"), F.col("x").alias("xb")), F.col("a") < F.col("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                x, y = np.array(r["xa"]), np.array(r["xb"])
                sims = lambda p, q: np.round(kernels.similarities(p, q).ravel(), 9)
                cross = sims(x, y)
                found = [kernels._auroc(sims(x, x), cross), kernels._auroc(sims(y, y), cross)]
                yield pa.RecordBatch.from_pydict({"a": pa.array([r["a"], r["b"]], pa.int32()), "b": pa.array([r["b"], r["a"]], pa.int32()), "auroc": found})

    return pairs.repartition("a", "b").mapInArrow(run, "a int, b int, auroc double")


def auroc_pairs_drawn(spark, sf_dir):
    """Over at most ``SUB_SAMPLE`` rows a label, drawn by hash, as discovery draws from a pattern."""
    rows = _scaled(spark, sf_dir).withColumn("drawn", F.xxhash64("vec_id"))
    found = _label_aurocs(patterns.first_of(rows, "label", "drawn", SUB_SAMPLE))
    return found.select("a", "b", r6("auroc").alias("auroc"), r6(patterns.contamination(F.col("auroc"))).alias("contamination"))


def auroc_label_scores(spark, sf_dir):
    scores = long(e_track(spark, sf_dir), "contrib", "x", "label").select("label", F.round("x", 4).alias("x"), (F.col("base") < 2).alias("y"))
    return patterns.auroc(scores, "x", "y", "label").select("label", r6("auroc").alias("auroc"))


def softmax_pfm(spark, sf_dir):
    rows = patterns.matrices(_means(spark, sf_dir), "label", "hyp").select("label", F.transform("hyp", vec.softmax).alias("m"))
    return long(rows, "m", "p", "label").select("label", "pos", "base", r6("p").alias("p"))


def trim_bounds(spark, sf_dir):
    m = patterns.matrices(_means(spark, sf_dir), "label", "contrib")
    first, last = vec.trim_bounds(F.transform(F.transform("contrib", lambda r: F.aggregate(r, F.lit(0.0), lambda s, x: s + F.abs(x))), lambda x: F.round(x, 9)), 0.8)
    return m.select("label", first.alias("first"), last.alias("last"))


def _peaks(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("chr"), F.col("c_nationkey")).alias("chrom"), (F.col("c_custkey") * 1000).alias("start"), (F.col("c_custkey") * 1000 + 401).alias("end"), F.col("c_acctbal").alias("score"))
    return ranking.numbered(text.with_chroms(rows, list(CHROMS)), "c_custkey")


def chrom_filter_rows(spark, sf_dir):
    return _peaks(spark, sf_dir).select("row_idx", "chrom", "start", "end")


def _bed(spark, sf_dir):
    found = e_track(spark, sf_dir).select(F.col("vec_id").alias("example_idx"), "label", (F.col("vec_id") % 300).alias("s"), (F.col("vec_id") % 2 == 1).alias("is_revcomp")).withColumn("e", F.col("s") + 16)
    peaks = _peaks(spark, sf_dir).withColumnsRenamed({"start": "peak_start", "end": "peak_end"})
    start, end = text.genome_coordinates("s", "e", "peak_start", "peak_end", CROP)
    return found.join(peaks, found.example_idx == peaks.row_idx).select("example_idx", "label", "chrom", start.alias("start"), end.alias("end"), F.when(F.col("is_revcomp"), "-").otherwise("+").alias("strand"))


def bed_coordinates(spark, sf_dir):
    return _bed(spark, sf_dir)


def bed_lines(spark, sf_dir):
    rows = _bed(spark, sf_dir)
    name = F.concat(F.lit("pos_patterns.pattern_"), F.col("label"))
    c = lambda n: F.col(n).cast("string")
    return rows.select("example_idx", text.bed_line(c("chrom"), c("start"), c("end"), name, F.lit(None).cast("string"), c("strand")).alias("line"))


def fasta_lines(spark, sf_dir):
    rows = e_track(spark, sf_dir)
    return rows.select("vec_id", text.fasta_entry(F.concat(F.lit("example"), F.col("vec_id"), F.lit(":0-16")), vec.sequence_of(F.col("one_hot"))).alias("entry"))


def meme_lines(spark, sf_dir):
    rows = patterns.matrices(_means(spark, sf_dir), "label", "one_hot")
    return rows.select("label", text.meme_block(F.concat(F.lit("pos_patterns.pattern_"), F.col("label")), F.col("one_hot"), 4).alias("block"))


def _matches(spark, sf_dir):
    query = _means(spark, sf_dir).select("label", "pos", "base", F.col("one_hot").alias("q"))
    db = _means(spark, sf_dir, "motif").select("motif", "pos", "base", F.col("one_hot").alias("t"))
    columns = query.join(db, ["pos", "base"]).groupBy("label", "motif", "pos").agg(F.sqrt(F.sum((F.col("q") - F.col("t")) ** 2)).alias("d"))
    scored = columns.groupBy("label", "motif").agg(F.sum("d").alias("distance"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.round("distance", 9), "motif"))
    return scored.withColumn("rank", rank.cast("long")).where("rank <= 3")


def motif_match_topn(spark, sf_dir):
    return _matches(spark, sf_dir).select("label", "motif", "rank", r6("distance").alias("distance"))


def descriptive_names(spark, sf_dir):
    tag = F.concat(F.lit("pos_patterns.pattern_"), "label")
    found = _matches(spark, sf_dir).select("label", tag.alias("query"), "rank", F.concat(F.lit("motif_number_"), "motif").alias("target"))
    tags = found.select("label", F.col("query").alias("tag")).distinct()
    return matching.descriptive_names(found, tags).join(tags, "tag").select("label", "tag", "name")


def report_stats(spark, sf_dir):
    rows = e_track(spark, sf_dir)
    importance = F.aggregate(vec.flatten(F.col("contrib")), F.lit(0.0), lambda s, x: s + F.abs(x))
    gc = F.aggregate("one_hot", F.lit(0.0), lambda s, r: s + F.get(r, F.lit(1)) + F.get(r, F.lit(2)))
    found = rows.select("label", importance.alias("i"), gc.alias("gc")).groupBy("label").agg(F.count("*").alias("n"), F.avg("i").alias("a"), F.stddev_pop("i").alias("s"), F.avg(F.col("gc") / 16).alias("g"))
    return found.select("label", "n", r6("a").alias("avg_importance"), r6("s").alias("std_importance"), r6(F.col("g") / 2).alias("gc_content"), r6("g").alias("gc_fraction"))


def center_distance(spark, sf_dir):
    rows = e_track(spark, sf_dir).select("label", (F.col("vec_id") % 300).alias("start")).withColumn("end", F.col("start") + 16)
    middle = rows.agg(F.min("start").alias("lo"), F.max("end").alias("hi"))
    away = rows.crossJoin(F.broadcast(middle)).withColumn("d", F.abs((F.col("start") + F.col("end")) / 2 - (F.col("lo") + F.col("hi")) / 2))
    return away.groupBy("label").agg(r6(F.median("d")).alias("median_distance"), r6(F.stddev_pop("d")).alias("std_distance"))


def importance_order(spark, sf_dir):
    importance = F.aggregate(vec.flatten(F.col("contrib")), F.lit(0.0), lambda s, x: s + F.abs(x))
    rows = e_track(spark, sf_dir).select("label", "vec_id", F.round(importance, 9).alias("i"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("i"), "vec_id"))
    return rows.select("label", "vec_id", rank.cast("long").alias("ord"), r6("i").alias("importance"))


def expand_coordinates(spark, sf_dir):
    rows = e_track(spark, sf_dir).select("vec_id", (F.col("vec_id") % 300).alias("start"), (F.col("vec_id") % 300 + 16).alias("end"), (F.col("vec_id") % 2 == 1).alias("rc"))
    start, end = seqlets.expanded("start", "end", "rc", 5, 3)
    moved = rows.select("vec_id", start.alias("start"), end.alias("end"))
    return moved.where(seqlets.inside("start", "end", 310)).withColumn("strict", seqlets.inside("start", "end", 310, True))


_M = E_SQL + ", m AS (SELECT label, pos, base, avg(one) AS ppm, avg(contrib) AS cwm, avg(hyp) AS hcwm, count(*) AS n FROM c GROUP BY label, pos, base), bg AS (SELECT base, avg(one) AS freq FROM c GROUP BY base)"
_IC = _M + ", ic AS (SELECT label, pos, sum(log2((ppm + 0.001) / (1 + 4 * 0.001)) * ppm - log2(freq) * freq) AS ic FROM m JOIN bg USING (base) GROUP BY label, pos)"
_BW = _IC + f""", bw AS (SELECT label, start, total FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(total, 9) DESC, start) AS k FROM
  (SELECT label, pos AS start, sum(ic) OVER (PARTITION BY label ORDER BY pos ROWS BETWEEN CURRENT ROW AND {WIDTH - 1} FOLLOWING) AS total, count(*) OVER (PARTITION BY label ORDER BY pos ROWS BETWEEN CURRENT ROW AND {WIDTH - 1} FOLLOWING) AS n FROM ic) WHERE n = {WIDTH}) WHERE k = 1)"""
_PEAK = f"WITH peak AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_idx, 'chr' || c_nationkey AS chrom, c_custkey * 1000 AS start, c_custkey * 1000 + 401 AS \"end\" FROM customer WHERE 'chr' || c_nationkey IN {CHROMS})"
_BED = (
    _PEAK
    + f", bed AS (SELECT vec_id AS example_idx, label, chrom, (start + \"end\") // 2 - {CROP // 2} + vec_id % 300 + 1 AS start, (start + \"end\") // 2 - {CROP // 2} + vec_id % 300 + 16 AS \"end\", CASE WHEN vec_id % 2 = 1 THEN '-' ELSE '+' END AS strand FROM embeddings JOIN peak ON vec_id = row_idx)"
)
_MATCH = _M + """, db AS (SELECT vec_id % 7 AS motif, pos, base, avg(one) AS t FROM c GROUP BY 1, 2, 3),
dist AS (SELECT label, motif, sum(d) AS distance FROM (SELECT label, motif, pos, sqrt(sum((ppm - t) ** 2)) AS d FROM m JOIN db USING (pos, base) GROUP BY 1, 2, 3) GROUP BY 1, 2),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(distance, 9), motif)::BIGINT AS rank FROM dist) WHERE rank <= 3)"""

QUERIES = {
    "pattern_means": (pattern_means, _M + " SELECT label, pos, base, round(ppm, 6) AS ppm, round(cwm, 6) AS cwm, round(hcwm, 6) AS hcwm, n FROM m"),
    "background_freq": (background_freq, _M + " SELECT base, round(freq, 6) AS freq FROM bg"),
    "per_position_ic": (per_position_ic, _IC + " SELECT label, pos, round(ic, 6) AS ic FROM ic"),
    "best_ic_window": (best_ic_window, _BW + " SELECT label, start, round(total, 6) AS total FROM bw"),
    "pattern_filter": (pattern_filter, _BW + " SELECT label, n, round(total, 6) AS total FROM bw JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) USING (label) WHERE n >= 20 AND total >= 0.15"),
    "pattern_support_trim": (
        pattern_support_trim,
        E_SQL + ", s AS (SELECT label, pos, count(*) FILTER (score > 1.5) AS n FROM (SELECT vec_id, label, pos, sum(contrib) AS score FROM c GROUP BY ALL) GROUP BY label, pos) SELECT label, min(pos) AS first, max(pos) AS last FROM (SELECT *, max(n) OVER (PARTITION BY label) AS m FROM s) WHERE n >= least(1000, 0.8 * m) GROUP BY label",
    ),
    "auroc_pairs": (
        auroc_pairs,
        E_SQL + f""", f AS (SELECT vec_id, label, pos * 4 + base AS k, contrib / sum(abs(contrib)) OVER (PARTITION BY vec_id) AS x FROM c),
        p AS (SELECT a.label AS a, b.label AS b, round(coalesce(sum(least(abs(a.x), abs(b.x)) * sign(a.x) * sign(b.x)) / nullif(sum(greatest(abs(a.x), abs(b.x))), 0), 0), 9) AS sim FROM f a JOIN f b ON a.k = b.k GROUP BY a.label, b.label, a.vec_id, b.vec_id),
        x AS (SELECT o.a, o.b, w.sim, true AS y FROM (SELECT DISTINCT a, b FROM p WHERE a <> b) o JOIN p w ON w.a = o.a AND w.b = o.a UNION ALL SELECT a, b, sim, false FROM p WHERE a <> b),
        r AS (SELECT a, b, y, rank() OVER (PARTITION BY a, b ORDER BY sim) + (count(*) OVER (PARTITION BY a, b, sim) - 1) / 2 AS r FROM x),
        u AS (SELECT a, b, (sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2) / (count(*) FILTER (y) * count(*) FILTER (NOT y)) AS auroc FROM r GROUP BY a, b)
        SELECT a, b, round(auroc, 6) AS auroc, round(2 * (1 - greatest(auroc, 0.5)), 6) AS contamination FROM u""",
    ),
    "auroc_pairs_drawn": (auroc_pairs_drawn, None),
    "auroc_label_scores": (
        auroc_label_scores,
        E_SQL + """, x AS (SELECT label, round(contrib, 4) + 0.0 AS x, base < 2 AS y FROM c), r AS (SELECT label, y, rank() OVER (PARTITION BY label ORDER BY x) + (count(*) OVER (PARTITION BY label, x) - 1) / 2 AS r FROM x)
        SELECT label, round((sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 6) AS auroc FROM r GROUP BY label""",
    ),
    "softmax_pfm": (softmax_pfm, _M + " SELECT label, pos, base, round(exp(hcwm) / sum(exp(hcwm)) OVER (PARTITION BY label, pos), 6) AS p FROM m"),
    "trim_bounds": (trim_bounds, _M + ", s AS (SELECT label, pos, round(sum(abs(cwm)), 9) AS s FROM m GROUP BY label, pos) SELECT label, min(pos) AS first, max(pos) AS last FROM (SELECT *, max(s) OVER (PARTITION BY label) AS h FROM s) WHERE s >= h * 0.8 GROUP BY label"),
    "chrom_filter_rows": (chrom_filter_rows, _PEAK + ' SELECT row_idx, chrom, start, "end" FROM peak'),
    "bed_coordinates": (bed_coordinates, _BED + ' SELECT example_idx, label, chrom, start, "end", strand FROM bed'),
    "bed_lines": (bed_lines, _BED + " SELECT example_idx, concat_ws(chr(9), chrom, start, \"end\", 'pos_patterns.pattern_' || label, strand) AS line FROM bed"),
    "fasta_lines": (fasta_lines, E_SQL + " SELECT vec_id, '>example' || vec_id || ':0-16' || chr(10) || string_agg(substr('ACGT', base + 1, 1), '' ORDER BY pos) AS entry FROM c WHERE one = 1 GROUP BY vec_id"),
    "meme_lines": (
        meme_lines,
        _M + ", r AS (SELECT label, pos, string_agg(printf('%.4f', ppm), ' ' ORDER BY base) AS line FROM m GROUP BY label, pos) SELECT label, 'MOTIF pos_patterns.pattern_' || label || chr(10) || 'letter-probability matrix: alength= 4 w= 16 nsites= 1' || chr(10) || string_agg(line, chr(10) ORDER BY pos) || chr(10) AS block FROM r GROUP BY label",
    ),
    "motif_match_topn": (motif_match_topn, _MATCH + " SELECT label, motif, rank, round(distance, 6) AS distance FROM best"),
    "descriptive_names": (descriptive_names, _MATCH + " SELECT label, 'pos_patterns.pattern_' || label AS tag, string_agg(substr('motif_number_' || motif, 1, 10), ';' ORDER BY rank) AS name FROM best GROUP BY label"),
    "report_stats": (
        report_stats,
        E_SQL + ", s AS (SELECT vec_id, label, sum(abs(contrib)) AS i, sum(one) FILTER (base IN (1, 2)) / 16 AS g FROM c GROUP BY vec_id, label) SELECT label, count(*) AS n, round(avg(i), 6) AS avg_importance, round(stddev_pop(i), 6) AS std_importance, round(avg(coalesce(g, 0)) / 2, 6) AS gc_content, round(avg(coalesce(g, 0)), 6) AS gc_fraction FROM s GROUP BY label",
    ),
    "center_distance": (
        center_distance,
        "WITH r AS (SELECT label, vec_id % 300 AS s, vec_id % 300 + 16 AS e FROM embeddings), d AS (SELECT label, abs((s + e) / 2 - (SELECT (min(s) + max(e)) / 2 FROM r)) AS d FROM r) SELECT label, round(median(d), 6) AS median_distance, round(stddev_pop(d), 6) AS std_distance FROM d GROUP BY label",
    ),
    "importance_order": (importance_order, E_SQL + ", s AS (SELECT label, vec_id, round(sum(abs(contrib)), 9) AS i FROM c GROUP BY label, vec_id) SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY i DESC, vec_id)::BIGINT AS ord, round(i, 6) AS importance FROM s"),
    "expand_coordinates": (
        expand_coordinates,
        "WITH r AS (SELECT vec_id, vec_id % 300 AS s, vec_id % 2 = 1 AS rc FROM embeddings), x AS (SELECT vec_id, s - CASE WHEN rc THEN 3 ELSE 5 END AS start, s + 16 + CASE WHEN rc THEN 5 ELSE 3 END AS \"end\" FROM r) SELECT vec_id, start, \"end\", \"end\" < 310 AS strict FROM x WHERE start >= 0 AND \"end\" <= 310",
    ),
}

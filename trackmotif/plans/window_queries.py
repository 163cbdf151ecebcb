"""Queries of crops, sliding windows, thresholds, suppression and sign split."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackmotif.functions import vec
from trackmotif.operators import nms, seqlets, thresholds, windows
from trackmotif.plans.bindings import E_SQL, V_SQL, WINDOW, e_track, long, v_track

HIGH, LOW, FLANK, RADIUS, LIMIT = 60.0, -60.0, 2, 4, 40
ISO_BINS = 40
r6 = lambda c: F.round(c, 6)


def _smoothed(spark, sf_dir):
    return windows.sliding_sum(v_track(spark, sf_dir), WINDOW, "user_id")


def window_crop(spark, sf_dir):
    cropped = e_track(spark, sf_dir).select("vec_id", vec.centred_crop(F.col("hyp"), 8).alias("t"))
    return long(cropped, "t", "hyp", "vec_id").select("vec_id", "pos", "base", r6("hyp").alias("hyp"))


def contrib_collapse(spark, sf_dir):
    rows = e_track(spark, sf_dir).select("vec_id", F.posexplode(vec.row_sums(F.col("contrib"))).alias("pos", "score"))
    return rows.select("vec_id", "pos", r6("score").alias("score"))


def revcomp(spark, sf_dir):
    rows = e_track(spark, sf_dir).select("vec_id", vec.reverse_complement(F.col("contrib")).alias("t"))
    return long(rows, "t", "contrib", "vec_id").select("vec_id", "pos", "base", (r6("contrib") + F.lit(0.0)).alias("contrib"))


def sliding_sum(spark, sf_dir):
    return _smoothed(spark, sf_dir).select("user_id", "pos", r6("total").alias("total"))


def threshold_mask(spark, sf_dir):
    found = windows.candidates(_smoothed(spark, sf_dir), HIGH, LOW, FLANK, "user_id")
    return found.select("user_id", "pos", r6("score").alias("score"))


def nms_pick(spark, sf_dir):
    found = windows.candidates(_smoothed(spark, sf_dir).select("user_id", "pos", r6("total").alias("total")), HIGH, LOW, FLANK, "user_id")
    return nms.pick(found, RADIUS, "user_id").select("user_id", "pick_ord", "pos", r6("score").alias("score"))


def histogram_bins(spark, sf_dir):
    found = thresholds.histogram(v_track(spark, sf_dir), "value", 1000)
    return found.select("bin", "n", r6("low").alias("low"), r6("high").alias("high"))


def two_level_mode(spark, sf_dir):
    return thresholds.two_level_mode(v_track(spark, sf_dir), "value", 50).select(r6("mu").alias("mu"))


def percentile_levels(spark, sf_dir):
    return thresholds.percentiles(v_track(spark, sf_dir), "value").select(r6("level").alias("level"), r6("q").alias("q"))


def laplace_rates(spark, sf_dir):
    track = v_track(spark, sf_dir)
    found = thresholds.laplace_rates(track, "value", thresholds.two_level_mode(track, "value", 50))
    return found.select(*(r6(c).alias(c) for c in ("mu", "rate_up", "rate_down")))


def refine_threshold(spark, sf_dir):
    found = thresholds.refined(_smoothed(spark, sf_dir), "total", 1000.0, -1000.0)
    return found.select(*(r6(c).alias(c) for c in ("share", "high", "low")))


def ecdf_rank(spark, sf_dir):
    return thresholds.signed_ecdf(_smoothed(spark, sf_dir), "total", [HIGH, LOW]).select("threshold", r6("ecdf").alias("ecdf"))


def order_statistic(spark, sf_dir):
    return thresholds.order_statistic(_smoothed(spark, sf_dir), "total", 0.8).select("rank", r6("magnitude").alias("magnitude"))


def isotonic_fit(spark, sf_dir):
    rows = v_track(spark, sf_dir).select(F.floor(F.col("value") / 25).cast("double").alias("x"), (F.col("pos") % 3).cast("double").alias("y"))
    binned = rows.groupBy("x").agg(F.avg("y").alias("y"), F.count("*").cast("double").alias("w"))
    return thresholds.isotonic(binned, "x", "y", "w").select("x", r6("fit").alias("fit"))


def sign_split_limit(spark, sf_dir):
    found = windows.candidates(_smoothed(spark, sf_dir), HIGH, LOW, FLANK, "user_id").join(_smoothed(spark, sf_dir), ["user_id", "pos"])
    signed = seqlets.split_by_sign(found, "total", 70.0)
    return seqlets.first_of_each_sign(signed, LIMIT, "user_id", "pos").select("sign", "user_id", "pos", "ord")


def topn_positions(spark, sf_dir):
    scores = e_track(spark, sf_dir).select("vec_id", F.posexplode(vec.row_sums(F.col("contrib"))).alias("pos", "score"))
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("score"), "pos"))
    return scores.withColumn("rank", rank.cast("long")).where("rank <= 5").select("vec_id", "pos", "rank", r6("score").alias("score"))


def dedup_seqlets(spark, sf_dir):
    found = _smoothed(spark, sf_dir).select("user_id", (F.floor(F.col("pos") / 4) * 4).alias("start"), "pos", "total")
    rows = found.withColumn("end", F.col("start") + 8)
    return seqlets.distinct(rows, ["user_id", "start", "end"], "pos").select("user_id", "start", "end", r6("total").alias("total"))


def seqlet_strings(spark, sf_dir):
    rows = _smoothed(spark, sf_dir).select("user_id", "pos", (F.col("pos") + WINDOW).alias("end"), (F.col("total") < 0).alias("rc"))
    text = rows.select("user_id", "pos", seqlets.to_string("user_id", "pos", "end", "rc").alias("text"))
    return text.select("user_id", "pos", "text", *seqlets.from_string("text"))


def trim_shift(spark, sf_dir):
    rows = _smoothed(spark, sf_dir).select("user_id", F.col("pos").alias("start"), (F.col("pos") + WINDOW).alias("end"), (F.col("total") < 0).alias("rc"))
    start, end = seqlets.trimmed("start", "end", "rc", 1, 4)
    return rows.select("user_id", F.col("start").alias("pos"), (start + 10).alias("start"), (end + 10).alias("end"))


_MU = """
, lim AS (SELECT min(value) AS lo, max(value) AS hi FROM v),
b AS (SELECT least(floor((value - lo) / (hi - lo) * 50), 49) AS bin, lo, hi FROM v, lim),
m AS (SELECT lo + bin * (hi - lo) / 50 AS l, lo + (bin + 1) * (hi - lo) / 50 AS h FROM (SELECT bin, lo, hi, count(*) AS n FROM b GROUP BY ALL ORDER BY n DESC, bin LIMIT 1)),
i AS (SELECT value FROM v, m WHERE value > l AND value < h),
lim2 AS (SELECT min(value) AS lo, max(value) AS hi FROM i),
b2 AS (SELECT least(floor((value - lo) / (hi - lo) * 50), 49) AS bin, lo, hi FROM i, lim2),
mu AS (SELECT (lo + bin * (hi - lo) / 50 + lo + (bin + 1) * (hi - lo) / 50) / 2 AS mu FROM (SELECT bin, lo, hi, count(*) AS n FROM b2 GROUP BY ALL ORDER BY n DESC, bin LIMIT 1))"""
_CAND = f", cand AS (SELECT user_id, pos, abs(total) AS score, total FROM (SELECT *, max(pos) OVER (PARTITION BY user_id) AS last FROM w) WHERE (total >= {HIGH} OR total <= {LOW}) AND pos BETWEEN {FLANK} AND last - {FLANK})"

QUERIES = {
    "window_crop": (window_crop, E_SQL + " SELECT vec_id, (pos - 4)::INT AS pos, base, round(hyp, 6) AS hyp FROM c WHERE pos BETWEEN 4 AND 11"),
    "contrib_collapse": (contrib_collapse, E_SQL + " SELECT vec_id, pos, round(sum(contrib), 6) AS score FROM c GROUP BY vec_id, pos"),
    "revcomp": (revcomp, E_SQL + " SELECT vec_id, (15 - pos)::INT AS pos, (3 - base)::INT AS base, round(contrib, 6) + 0.0::DOUBLE AS contrib FROM c"),
    "sliding_sum": (sliding_sum, V_SQL + " SELECT user_id, pos, round(total, 6) AS total FROM w"),
    "threshold_mask": (threshold_mask, V_SQL + _CAND + " SELECT user_id, pos, round(score, 6) AS score FROM cand"),
    "nms_pick": (
        nms_pick,
        V_SQL.replace("WITH v", "WITH RECURSIVE v", 1)
        + _CAND.replace("FROM w", "FROM (SELECT user_id, pos, round(total, 6) AS total FROM w)")
        + f""", l AS (SELECT user_id, list(pos ORDER BY score DESC, pos) AS ps, list(score ORDER BY score DESC, pos) AS ss FROM cand GROUP BY user_id),
        s AS (SELECT user_id, 1 AS k, ps, ss, []::BIGINT[] AS kept, []::DOUBLE[] AS vals FROM l UNION ALL
          SELECT user_id, k + 1, ps, ss, CASE WHEN len(list_filter(kept, lambda y: abs(y - ps[k]) <= {RADIUS})) = 0 THEN list_append(kept, ps[k]) ELSE kept END,
          CASE WHEN len(list_filter(kept, lambda y: abs(y - ps[k]) <= {RADIUS})) = 0 THEN list_append(vals, ss[k]) ELSE vals END FROM s WHERE k <= len(ps)),
        d AS (SELECT user_id, kept, vals FROM s WHERE k = len(ps) + 1)
        SELECT user_id, (g - 1)::BIGINT AS pick_ord, kept[g] AS pos, round(vals[g], 6) AS score FROM (SELECT *, unnest(range(1, len(kept) + 1)) AS g FROM d)""",
    ),
    "histogram_bins": (
        histogram_bins,
        V_SQL + """, lim AS (SELECT min(value) AS lo, max(value) AS hi FROM v)
        SELECT bin, n, round(lo + bin * ((hi - lo) / 1000), 6) AS low, round(lo + (bin + 1) * ((hi - lo) / 1000), 6) AS high FROM
        (SELECT least(floor((value - lo) / (hi - lo) * 1000), 999)::BIGINT AS bin, lo, hi, count(*) AS n FROM v, lim GROUP BY ALL)""",
    ),
    "two_level_mode": (two_level_mode, V_SQL + _MU + " SELECT round(mu, 6) AS mu FROM mu"),
    "percentile_levels": (percentile_levels, V_SQL + " SELECT round(unnest(range(1, 20))::DOUBLE / 20, 6) AS level, round(unnest((SELECT quantile_cont(value, [0.05,0.1,0.15,0.2,0.25,0.3,0.35,0.4,0.45,0.5,0.55,0.6,0.65,0.7,0.75,0.8,0.85,0.9,0.95]) FROM v)), 6) AS q"),
    "laplace_rates": (
        laplace_rates,
        V_SQL + _MU + """, q AS (SELECT unnest(range(1, 20))::DOUBLE / 20 AS level, unnest((SELECT quantile_cont(value, [0.05,0.1,0.15,0.2,0.25,0.3,0.35,0.4,0.45,0.5,0.55,0.6,0.65,0.7,0.75,0.8,0.85,0.9,0.95]) FROM v, mu WHERE value >= mu)) AS up,
        unnest((SELECT quantile_cont(-value, [0.05,0.1,0.15,0.2,0.25,0.3,0.35,0.4,0.45,0.5,0.55,0.6,0.65,0.7,0.75,0.8,0.85,0.9,0.95]) FROM v, mu WHERE value <= mu)) AS down)
        SELECT round(mu, 6) AS mu, round(max(-ln(1 - level) / nullif(abs(up - mu), 0)), 6) AS rate_up, round(max(-ln(1 - level) / nullif(abs(-down - mu), 0)), 6) AS rate_down FROM q, mu GROUP BY mu""",
    ),
    "refine_threshold": (
        refine_threshold,
        V_SQL + """, s AS (SELECT avg((total >= 1000 OR total <= -1000)::INT) AS share, quantile_cont(abs(total), 0.97) AS a, quantile_cont(abs(total), 0.8) AS b FROM w)
        SELECT round(share, 6) AS share, round(CASE WHEN share < 0.03 THEN a WHEN share > 0.2 THEN b ELSE 1000 END, 6) AS high, round(CASE WHEN share < 0.03 THEN -a WHEN share > 0.2 THEN -b ELSE -1000 END, 6) AS low FROM s""",
    ),
    "ecdf_rank": (ecdf_rank, V_SQL + f" SELECT t::DOUBLE AS threshold, round(sign(t) * (SELECT avg((abs(total) < abs(t))::INT) FROM w), 6) AS ecdf FROM (VALUES ({HIGH}::DOUBLE), ({LOW}::DOUBLE)) x(t)"),
    "order_statistic": (order_statistic, V_SQL + " SELECT k::BIGINT AS rank, round(m, 6) AS magnitude FROM (SELECT abs(total) AS m, row_number() OVER (ORDER BY abs(total)) - 1 AS k, count(*) OVER () AS n FROM w) WHERE k = floor(0.8 * n)"),
    "isotonic_fit": (
        isotonic_fit,
        V_SQL + """, x AS (SELECT floor(value / 25)::DOUBLE AS x, avg(pos % 3) AS y, count(*)::DOUBLE AS w FROM v GROUP BY 1),
        o AS (SELECT *, row_number() OVER (ORDER BY x) AS k FROM x),
        means AS (SELECT a.k AS a, b.k AS b, (SELECT sum(y * w) / sum(w) FROM o WHERE k BETWEEN a.k AND b.k) AS m FROM o a JOIN o b ON a.k <= b.k),
        low AS (SELECT i.k, a, min(m) AS m FROM o i JOIN means ON a <= i.k AND b >= i.k GROUP BY i.k, a)
        SELECT x, round((SELECT max(m) FROM low WHERE low.k = o.k), 6) AS fit FROM o""",
    ),
    "sign_split_limit": (
        sign_split_limit,
        V_SQL + _CAND + f" SELECT sign, user_id, pos, ord FROM (SELECT *, row_number() OVER (PARTITION BY sign ORDER BY user_id, pos)::BIGINT AS ord FROM (SELECT *, CASE WHEN total > 70 THEN 'pos' WHEN total < -70 THEN 'neg' END AS sign FROM cand) WHERE sign IS NOT NULL) WHERE ord <= {LIMIT}",
    ),
    "topn_positions": (
        topn_positions,
        E_SQL + ", s AS (SELECT vec_id, pos, sum(contrib) AS score FROM c GROUP BY vec_id, pos) SELECT vec_id, pos, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, pos)::BIGINT AS rank FROM s) WHERE rank <= 5",
    ),
    "dedup_seqlets": (
        dedup_seqlets,
        V_SQL + " SELECT user_id, start, start + 8 AS \"end\", round(total, 6) AS total FROM (SELECT user_id, (pos // 4) * 4 AS start, total, row_number() OVER (PARTITION BY user_id, pos // 4 ORDER BY pos) AS k FROM w) WHERE k = 1",
    ),
    "seqlet_strings": (
        seqlet_strings,
        V_SQL + f" SELECT user_id, pos, 'example:' || user_id || ',start:' || pos || ',end:' || (pos + {WINDOW}) || ',rc:' || CASE WHEN total < 0 THEN 'True' ELSE 'False' END AS text, user_id AS example_idx, pos AS start, pos + {WINDOW} AS \"end\", total < 0 AS is_revcomp FROM w",
    ),
    "trim_shift": (
        trim_shift,
        V_SQL + f" SELECT user_id, pos, CASE WHEN total < 0 THEN pos + {WINDOW} - 4 ELSE pos + 1 END + 10 AS start, CASE WHEN total < 0 THEN pos + {WINDOW} - 1 ELSE pos + 4 END + 10 AS \"end\" FROM w",
    ),
}

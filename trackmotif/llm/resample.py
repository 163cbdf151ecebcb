"""Importance resampling towards a target text distribution, over hashed n-grams of words.

Texts of a partition, some megabytes at a time, become one sequence of word ids with a mark after each text. Its suffix
array, sorted as deep as the longest n-gram, puts equal n-grams next to each other: runs of neighbours whose longest common
prefix has n words are the occurrences of one n-gram. Each run is hashed once, and its bucket is scattered to them. The
buckets of every row are written once, in the shared folder; counts of buckets, gains and scores come from that table.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmotif.llm.memory import release
from trackmotif.llm.words import joined
from trackmotif.operators.ranking import numbered
from trackmotif.session import materialise, ship_package

BUCKETS, SEED, PERCENT, LEAST_WORDS = 10_000, 2024, 10, 20
#: Bytes of text that have one suffix array.
BLOCK = 8 << 20


def suffix_array(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``ids`` (from 0) in the order of the suffixes' first ``depth`` ids, ties by position, and what each has
    in common with the one before it, up to ``depth``; past the end stands something smaller than all."""
    levels, h = [ids + 1], 1
    while h < depth:
        last = levels[-1]
        after = np.zeros_like(last)
        after[: max(0, len(last) - h)] = last[h:]
        pair = last * (last.max(initial=0) + 1) + after
        levels.append(np.unique(pair, return_inverse=True)[1].astype(np.int64) + 1)
        h *= 2
    order = np.argsort(levels[-1], kind="stable")
    common = np.zeros(len(ids), np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for level in range(len(levels) - 1, -1, -1):
        x, y = np.minimum(a, len(ids)), np.minimum(b, len(ids))
        rank = np.append(levels[level], 0)
        step = np.where((rank[x] == rank[y]) & (x < len(ids)) & (y < len(ids)), 1 << level, 0)
        common[1:] += step
        a += step
        b += step
    return order, np.minimum(common, depth)


def buckets_of(texts: list[bytes], low: int, high: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of words of each text, number of features, and the features' buckets, text by text."""
    words, owner = joined(texts)
    n_words = np.bincount(owner, minlength=len(texts))
    # A mark, id 0, ends each text: word k of text d is at k + d.
    at = np.arange(len(owner)) + owner
    ids = np.zeros(len(owner) + len(texts), np.int64)
    ids[at] = np.unique(words.hashes, return_inverse=True)[1] + 1
    word_at = np.zeros(len(ids), np.int64)
    word_at[at] = np.arange(len(owner))
    ends = np.repeat(np.cumsum(n_words + 1) - 1, n_words + 1)  # the place of the mark after each place
    order, common = suffix_array(ids, high)
    found, texts_of = [], []
    for n in range(low, high + 1):
        heads = np.flatnonzero(common < n)
        first = order[heads]
        whole = ends[first] - first >= n
        hashed = np.zeros(len(heads), np.int64)
        hashed[whole] = [zlib.crc32(words.word(k) if n == 1 else b" ".join(map(words.word, range(k, k + n)))) % buckets for k in word_at[first[whole]].tolist()]
        scattered = np.empty(len(ids), np.int64)
        scattered[order] = np.repeat(hashed, np.diff(np.append(heads, len(ids))))
        inside = at[ends[at] - at >= n]
        found.append(scattered[inside])
        texts_of.append(owner[word_at[inside]])
    doc = np.concatenate(texts_of)
    by_text = np.argsort(doc, kind="stable") if len(found) > 1 else slice(None)
    return n_words, np.bincount(doc, minlength=len(texts)), np.concatenate(found)[by_text]


def features(df: DataFrame, low: int = 1, high: int = 1, buckets: int = BUCKETS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, buckets (one a feature, repeats included) of every row."""
    if not 1 <= low <= high:
        raise ValueError("n-grams have one word at least")
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK):
                    size += len(texts[end])
                    end += 1
                n_words, n, found = buckets_of(texts[at:end], low, high, buckets)
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(n_words), pa.array(n), lists], names=["doc_id", "n_words", "n_features", "buckets"])
                at = end
        release()

    texts = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_words long, n_features long, buckets array<int>")


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features each bucket has; a task gives one row a bucket at most, so ``buckets`` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    counts = np.zeros(buckets, np.int64)
    for r in rows.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r.bucket] = r.n
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of how much likelier a bucket is in the target, with one added to each count."""
    total_s, total_t, n = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1) * (total_s + n) / ((s + 1) * (total_t + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weights(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight: the floored mean of the features' gains, 0 without features."""
    sent = rows.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            sums = np.concatenate([[0], np.cumsum(sent.value[lists.flatten().to_numpy()])])
            n = batch.column(2).to_numpy()
            ends = np.cumsum(n)
            weight = (sums[ends] - sums[ends - n]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return rows.select("doc_id", "n_words", "n_features", "buckets").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(df: DataFrame, target: DataFrame, percent: int = PERCENT, low: int = 1, high: int = 1, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of ``df``.

    The score is the weight plus Gumbel noise, which a hash of seed and identifier gives, so that the highest scores are
    a draw without replacement in proportion to exp(weight / 1000). Of the rows of ``least_words`` words or more,
    ``percent`` in a hundred are drawn (rounded down) and ranked from 1; ties go to the smaller doc_id. All others have a
    null rank. Null and empty texts have no features and weight 0. Rows with one identifier are rows of their own with
    the same noise, a null identifier is hashed as an empty one and comes last among ties, other columns are left out,
    and an empty target makes common buckets cheap. An empty table gives no rows.
    """
    rows = materialise(features(df, low, high, buckets, id_column, text_column), "features")
    wanted = features(target.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_column).alias("text")), low, high, buckets)
    weighed = _weights(rows, gains(bucket_counts(rows, buckets), bucket_counts(wanted, buckets)))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log(uniform)))
    able = F.col("n_words") >= least_words
    places = numbered(weighed.withColumn("score", score).withColumn("able", able), F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id"))
    drawn = rows.where(able).count() * percent // 100
    rank = F.when(F.col("able") & (F.col("row_idx") < drawn), F.col("row_idx") + 1)
    return places.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


def draw(df: DataFrame, target: DataFrame, id_column: str = "doc_id", **settings) -> DataFrame:
    """The drawn rows of ``df`` with all their columns; rows without an identifier can't be told apart and stay out."""
    found = resample(df, target, id_column=id_column, **settings).where("rank is not null and doc_id is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return df.join(found, F.col(id_column).cast("long") == F.col("_drawn"), "left_semi")


_LOWER_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce({_LOWER_SQL}, []) AS words FROM documents),
b AS (SELECT unnest({_LOWER_SQL}) AS word FROM benchmark),
r AS (SELECT list(list_reduce(list_prepend(byte, range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY byte) AS crcs FROM (SELECT unnest(range(256)) AS byte)),
v AS (SELECT word, hex(encode(word)) AS hex FROM (SELECT unnest(words) AS word FROM d UNION SELECT word FROM b)),
h AS (SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(hex) // 2), lambda i: ('0x' || substr(hex, 2 * i + 1, 2))::BIGINT)),
  lambda c, x: xor(c >> 8, crcs[(xor(c, x) & 255) + 1]))) % {BUCKETS} AS bucket FROM v, r),
f AS (SELECT k, bucket FROM (SELECT k, unnest(words) AS word FROM d) JOIN h USING (word)),
s AS (SELECT bucket, count(*) AS s FROM f GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN h USING (word) GROUP BY bucket),
n AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::BIGINT AS sum_s, coalesce((SELECT sum(t) FROM t), 0)::BIGINT AS sum_t),
g AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * (sum_s + {BUCKETS}))::DOUBLE / ((s + 1) * (sum_t + {BUCKETS}))::DOUBLE))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), n),
w AS (SELECT k, count(*) AS n_features, sum(gain)::BIGINT AS total FROM f JOIN g USING (bucket) GROUP BY k),
x AS (SELECT k, doc_id, len(words) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0)::BIGINT AS weight,
  ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN w USING (k)),
y AS (SELECT *, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score FROM x),
z AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS able FROM y WHERE n_words >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {PERCENT} * able // 100 THEN place END AS rank FROM y LEFT JOIN z USING (k)"""

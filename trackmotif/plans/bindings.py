"""The driver's tables as importance tracks, in Spark and in SQL.

E-track: each embedding is 16 positions of 4 channels; the largest channel is the observed base. V-track: each user's
events in order, scored by value less the median of all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackmotif.functions import vec
from trackmotif.operators.ranking import quantiles
from trackmotif.session import table

WINDOW = 5

E_SQL = """
WITH t AS (SELECT vec_id, label, p::INT AS pos, b::INT AS base, embedding[p * 4 + b + 1]::DOUBLE AS hyp FROM embeddings, range(0, 16) r(p), range(0, 4) s(b)),
e AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY vec_id, pos ORDER BY hyp DESC, base) = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS one FROM t),
c AS (SELECT *, one * hyp AS contrib FROM e)"""

V_SQL = f"""
WITH v AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::BIGINT AS pos, value - (SELECT median(value) FROM events) AS value FROM events),
w AS (SELECT user_id, pos, total FROM (SELECT user_id, pos, sum(value) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS total,
  count(*) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS k FROM v) WHERE k = {WINDOW})"""


def e_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, and tensors hyp, one_hot and contrib."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", vec.reshape(F.col("embedding").cast("array<double>")).alias("hyp"))
    rows = rows.withColumn("one_hot", vec.argmax_one_hot(F.col("hyp")))
    return rows.withColumn("contrib", vec.product(F.col("one_hot"), F.col("hyp")))


def long(df: DataFrame, tensor: str, name: str, *keep: str) -> DataFrame:
    """A row for each position and channel of a tensor."""
    return df.select(*keep, F.posexplode(tensor).alias("pos", "row")).select(*keep, "pos", F.posexplode("row").alias("base", name))


def v_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, pos, value."""
    events = table(spark, sf_dir, "events")
    middle = quantiles(events, "value", [0.5])[None][1][0]
    order = Window.partitionBy("user_id").orderBy("event_id")
    rows = events.select("user_id", (F.row_number().over(order) - 1).cast("long").alias("pos"), "value")
    return rows.select("user_id", "pos", (F.col("value") - F.lit(middle)).alias("value"))

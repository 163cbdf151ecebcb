"""Site-relative line de-duplication: lines that a large part of a host's pages have are dropped. DataFrame functions only.

Lines are counted by 64-bit hashes, once a page, and summed up before they are shuffled. A line goes if more than
``ratio`` of its host's pages have it, and ``min_pages`` at least, so that each host has at most (lines a page) / ratio
such lines, however many pages it has. They are gathered by host and joined to the pages: broadcast while their measured
size is below ``BROADCAST_BYTES``, else by a shuffle whose large hosts are split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmotif.session import materialise

RATIO, MIN_PAGES, BROADCAST_BYTES = 0.01, 5, 8 << 20


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user, port and a leading www; null where there is none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"^www\.", "")
    return F.when(host != "", host)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(df: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, and the hashes (array<bigint>) of its boilerplate lines; hosts without any are left out. Null is a host."""
    pages = df.select(F.col(host).alias("host"), F.col(text).alias("text"))
    hashes = F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""), lambda x: F.xxhash64(x))
    lines = pages.select("host", F.explode(F.array_distinct(hashes)).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = pages.groupBy("host").agg(F.count("*").alias("pages")).withColumnRenamed("host", "h")
    common = lines.join(totals, F.col("host").eqNullSafe(F.col("h"))).where(F.col("n") > ratio * F.col("pages"))
    return common.groupBy("host").agg(F.collect_set("line").alias("lines"))


def drop_boilerplate(df: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, counts: tuple[str, str] | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with its text rid of boilerplate lines; with ``counts``, also columns of these names: lines, and lines dropped.

    Blank lines are neither counted nor dropped. Null texts stay null and have 0 lines; rows whose lines all go keep an
    empty text; repeated rows are pages each; all other columns stay as they are.
    """
    prefix = "_b"
    while any(c.startswith(prefix) for c in df.columns):
        prefix = "_" + prefix
    found = materialise(boilerplate(df, host, text, ratio, min_pages), "boilerplate").select(F.col("host").alias(f"{prefix}h"), F.col("lines").alias(f"{prefix}l"))
    size = found.agg(F.sum(64 + F.coalesce(F.octet_length(f"{prefix}h"), F.lit(0)) + 8 * F.size(f"{prefix}l"))).first()[0] or 0
    joined = df.join(F.broadcast(found) if size <= broadcast_bytes else found.hint("merge"), F.col(host).eqNullSafe(F.col(f"{prefix}h")), "left")
    bad = lambda x: (F.trim(x) != "") & F.array_contains(f"{prefix}l", F.xxhash64(x))
    lines = _lines(F.col(text))
    some = F.exists(lines, bad)
    out = joined.withColumn(f"{prefix}t", F.when(F.col(f"{prefix}l").isNull() | ~F.coalesce(some, F.lit(False)), F.col(text)).otherwise(F.array_join(F.filter(lines, lambda x: ~bad(x)), "\n")))
    columns = [F.col(f"{prefix}t").alias(text) if c == text else F.col(c) for c in df.columns]
    if counts:
        total = F.coalesce(F.size(lines), F.lit(0))
        dropped = F.coalesce(F.size(F.filter(lines, bad)), F.lit(0))
        columns += [F.when(F.col(text).isNull(), 0).otherwise(total).cast("long").alias(counts[0]), F.when(F.col(text).isNull() | F.col(f"{prefix}l").isNull(), 0).otherwise(dropped).cast("long").alias(counts[1])]
    return out.select(*columns)


ORACLE_SQL = f"""
WITH page AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
line AS (SELECT r, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM page),
total AS (SELECT source, count(*) AS pages FROM page GROUP BY source),
common AS (
  SELECT l.source, l.line FROM (SELECT source, line, count(DISTINCT r) AS n FROM line WHERE trim(line) <> '' GROUP BY source, line) l
  JOIN total t ON l.source IS NOT DISTINCT FROM t.source WHERE n >= {MIN_PAGES} AND n > {RATIO} * pages),
marked AS (SELECT l.r, l.k, l.line, c.line IS NOT NULL AS bad FROM line l LEFT JOIN common c ON l.source IS NOT DISTINCT FROM c.source AND l.line = c.line),
joined AS (SELECT r, count(*) AS n_lines, count(*) FILTER (bad) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT bad), '') AS text FROM marked GROUP BY r)
SELECT p.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, j.text
FROM page p LEFT JOIN joined j ON p.r = j.r
"""

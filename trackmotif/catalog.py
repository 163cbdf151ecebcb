"""Named queries over the driver's tables, and the SQL each is checked against."""

from __future__ import annotations

from trackmotif.plans import discovery_queries, pattern_queries, similarity_queries, window_queries

GROUPS = (window_queries.QUERIES, similarity_queries.QUERIES, pattern_queries.QUERIES, discovery_queries.QUERIES)


def flagship(spark, sf_dir):
    return window_queries.nms_pick(spark, sf_dir)


def queries() -> dict:
    return {name: fn for group in GROUPS for name, (fn, _) in group.items()}


def oracle_sql() -> dict:
    return {name: sql for group in GROUPS for name, (_, sql) in group.items() if sql}

"""Queries of the general data problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumaframe.operators.references import broken_reference_report, broken_references
from lumaframe.sources.tables import tables


def _broken(spark: SparkSession, d: str) -> DataFrame:
    return broken_references(*tables(spark, d, "fingerprints", "images", "hook_events", "group_members", "dup_groups"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": _broken,
    "p2_report": lambda spark, d: broken_reference_report(_broken(spark, d)),
}

_BROKEN = """
WITH ev AS (
  SELECT try_cast(trim(id) AS BIGINT) AS image_id, hook_type, ts FROM hook_events
  WHERE hook_type IN ('Image.Create.Post', 'Image.Destroy.Post')),
life AS (
  SELECT image_id, min(ts) FILTER (WHERE hook_type = 'Image.Create.Post') AS first_up,
         max(ts) FILTER (WHERE hook_type = 'Image.Create.Post') AS last_up,
         max(ts) FILTER (WHERE hook_type = 'Image.Destroy.Post') AS last_down
  FROM ev GROUP BY image_id),
gone AS (SELECT image_id FROM life WHERE last_down IS NOT NULL AND (last_up IS NULL OR last_down >= last_up)),
listed AS (SELECT DISTINCT try_cast(trim(id) AS BIGINT) AS image_id FROM images),
cur AS (SELECT image_id, max(created_at) AS created_at FROM fingerprints WHERE image_id IS NOT NULL GROUP BY image_id),
fp AS (
  SELECT 'fingerprints' AS child, c.image_id, CAST(0 AS BIGINT) AS group_id, strftime(c.created_at, '%Y-%m') AS period,
         CASE WHEN c.image_id IN (SELECT image_id FROM gone) THEN 'deleted'
              WHEN l.image_id IS NULL THEN 'missing'
              WHEN f.first_up > c.created_at THEN 'late' END AS state
  FROM cur c LEFT JOIN listed l ON l.image_id = c.image_id LEFT JOIN life f ON f.image_id = c.image_id),
gm AS (
  SELECT 'group_members' AS child, m.image_id, m.group_id, strftime(g.created_at, '%Y-%m') AS period,
         CASE WHEN m.image_id IN (SELECT image_id FROM gone) THEN 'deleted' ELSE 'missing' END AS state
  FROM (SELECT DISTINCT group_id, image_id FROM group_members WHERE image_id IS NOT NULL) m
  LEFT JOIN dup_groups g ON g.group_id = m.group_id
  WHERE NOT EXISTS (SELECT 1 FROM cur c WHERE c.image_id = m.image_id)),
broken AS (SELECT * FROM fp WHERE state IS NOT NULL UNION ALL SELECT * FROM gm)
"""

SQL: dict[str, str] = {
    "p2_found": _BROKEN + "SELECT child, image_id, group_id, period, state FROM broken",
    "p2_report": _BROKEN + "SELECT child, period, state, count(*) AS n_references, count(DISTINCT image_id) AS n_images FROM broken GROUP BY child, period, state",
}

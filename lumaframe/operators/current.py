"""The current row of each key in an append-only log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaframe.functions.bits import digest


def current_fingerprints(log: DataFrame, *fields: str) -> DataFrame:
    """One row per image: that with the latest created_at.

    Columns: image_id, created_at and `fields`; "digest" among them is the file digest behind file_hash. Rows without
    image_id are left out; a null created_at is older than any other. Of different rows with the same created_at the
    one with the greatest fields counts, nulls last; repeated rows are one row. One aggregation with map-side combine,
    so an image with a third of all rows is reduced before the shuffle.
    """
    rows = log.filter(F.col("image_id").isNotNull()).select(
        "image_id", "created_at", *(digest(F.col("file_hash")).alias("digest") if f == "digest" else F.col(f) for f in fields)
    )
    if not fields:
        return rows.groupBy("image_id").agg(F.max("created_at").alias("created_at"))
    newest = rows.groupBy("image_id").agg(F.max(F.struct("created_at", *fields)).alias("r"))
    return newest.select("image_id", "r.*")

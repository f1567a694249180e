"""Numbers in the order of a column, over any number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumaframe.session import shared_folder, stage


def numbered(rows: DataFrame, by: str, name: str, first: int = 1) -> DataFrame:
    """The rows with their place in the order of `by`, whose values differ, counted from `first` on.

    Rows are sorted by range and numbered within it; of the ranges only their number of rows is put in order. The ranges are
    written first, so that the counts are of the same ranges as the numbers.
    """
    ranged = rows.repartitionByRange(by).sortWithinPartitions(by).withColumn("_part", F.spark_partition_id())
    ranged = stage(ranged, shared_folder(rows.sparkSession), "ranges")
    within = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(by)))
    totals = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = totals.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return within.join(before, "_part").withColumn(name, (F.col("_before") + F.col("_at") + (first - 1)).cast("bigint")).drop("_part", "_at", "_before")

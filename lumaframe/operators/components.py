"""Connected components by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lumaframe.session import drop_stage, free_shuffles, shared_folder, stage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) for each end of the edges; root is the least id of the component.

    Each round a vertex takes the least label around it, then the label of its label, which halves what is left of a chain.
    Labels are written to the shared folder in every round, so lost executors don't restart the loop.
    """
    spark, folder = edges.sparkSession, shared_folder(edges.sparkSession)
    ways = F.explode(F.array(F.struct(F.col(a).alias("src"), F.col(b).alias("dst")), F.struct(F.col(b).alias("src"), F.col(a).alias("dst"))))
    both = stage(edges.filter(F.col(a) != F.col(b)).select(ways.alias("e")).select("e.src", "e.dst").distinct(), folder, "edges")
    labels = stage(both.groupBy(F.col("src").alias("id")).agg(F.min(F.least("src", "dst")).alias("root")), folder, "labels-0")
    step, changed = 0, 1
    while changed:
        step += 1
        around = both.join(labels.select(F.col("id").alias("dst"), F.col("root").alias("near")), "dst").groupBy(F.col("src").alias("id")).agg(F.min("near").alias("near"))
        taken = labels.join(around, "id").select("id", "root", F.least("root", "near").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("root").alias("beyond"))
        new = taken.join(jump, "next", "left").select("id", F.least("next", F.coalesce("beyond", "next")).alias("root"), F.col("root").alias("before"))
        seen = Observation()
        fresh = stage(new.observe(seen, F.count_if(F.col("root") < F.col("before")).alias("n")).select("id", "root"), folder, f"labels-{step}")
        changed = seen.get["n"]
        drop_stage(spark, folder, f"labels-{step - 1}")
        labels = fresh
        free_shuffles(spark)
    return labels

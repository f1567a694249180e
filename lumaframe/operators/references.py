"""References to records that do not exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaframe.functions.bits import id_number, month
from lumaframe.operators.current import current_fingerprints

CREATED, DESTROYED = "Image.Create.Post", "Image.Destroy.Post"


def parent_validity(images: DataFrame, hook_events: DataFrame) -> DataFrame:
    """One row per known image: image_id, listed, valid_from, destroyed.

    `listed`: the library has a row of it. `valid_from`: its first creation event, null if none. `destroyed`: the latest
    of its creation and destruction events is a destruction (at the same instant the destruction counts as later). Ids
    that spell no number name no image. Rows and events may be repeated and late: only extremes of time are kept, in one
    aggregation that combines before its shuffle, so the events of a hot image never meet in one task.
    """
    kind, number = F.col("hook_type"), id_number(F.col("id")).alias("image_id")
    events = hook_events.filter(kind.isin(CREATED, DESTROYED)).select(
        number, F.lit(False).alias("listed"), F.when(kind == CREATED, F.col("ts")).alias("up"), F.when(kind == DESTROYED, F.col("ts")).alias("down")
    )
    none = F.lit(None).cast("timestamp")
    rows = images.select(number, F.lit(True).alias("listed"), none.alias("up"), none.alias("down"))
    return (
        rows.unionByName(events)
        .filter(F.col("image_id").isNotNull())
        .groupBy("image_id")
        .agg(F.max("listed").alias("listed"), F.min("up").alias("valid_from"), F.max("up").alias("last_up"), F.max("down").alias("last_down"))
        .select("image_id", "listed", "valid_from", (F.col("last_down").isNotNull() & (F.col("last_up").isNull() | (F.col("last_down") >= F.col("last_up")))).alias("destroyed"))
    )


def merge_with_parents(references: DataFrame, parents: DataFrame, at: Column | None) -> DataFrame:
    """The references with their state: deleted, missing, late or null (sound).

    Both sides are partitioned by the key, sorted and merged (Spark's sort-merge join, asked for by a hint; sides that are
    already partitioned by it aren't moved again, and adaptive execution splits the partition of a hot key). `at`: when
    the reference was made; null compares with no interval.
    """
    late = (F.col("valid_from") > at) if at is not None else F.lit(False)
    return (
        references.hint("merge")
        .join(parents, "image_id", "left")
        .withColumn("state", F.when(F.col("destroyed"), "deleted").when(~F.coalesce(F.col("listed"), F.lit(False)), "missing").when(late, "late"))
        .drop("listed", "valid_from", "destroyed")
    )


def broken_references(fingerprints: DataFrame, images: DataFrame, hook_events: DataFrame, group_members: DataFrame, dup_groups: DataFrame) -> DataFrame:
    """One row for each broken reference: child, image_id, group_id, period, state.

    - fingerprints: one reference per current fingerprint to its image; group_id 0, period the month of created_at.
    - group_members: one per distinct (group_id, image_id) to a fingerprint of the image; period the month in which the
      group was made, null if dup_groups lacks it; deleted if the image is destroyed, else missing.

    A null image_id refers to nothing and is no reference; a null group_id is kept as such. A null created_at has no
    period and is never late. Empty tables of parents make every reference missing. Extra columns are ignored. Of several
    rows of a group in dup_groups the earliest counts.
    """
    parents = parent_validity(images, hook_events)
    current = current_fingerprints(fingerprints)
    from_fingerprints = (
        merge_with_parents(current, parents, F.col("created_at"))
        .filter(F.col("state").isNotNull())
        .select(F.lit("fingerprints").alias("child"), "image_id", F.lit(0).cast("bigint").alias("group_id"), month(F.col("created_at")).alias("period"), "state")
    )
    members = group_members.filter(F.col("image_id").isNotNull()).select("group_id", "image_id").distinct()
    orphans = members.hint("merge").join(current.select("image_id"), "image_id", "left_anti")
    groups = dup_groups.groupBy("group_id").agg(month(F.min("created_at")).alias("period"))
    from_members = (
        merge_with_parents(orphans, parents.select("image_id", "listed", "valid_from", "destroyed"), None)
        .join(groups, "group_id", "left")
        .select(F.lit("group_members").alias("child"), "image_id", "group_id", "period", F.when(F.col("state") == "deleted", "deleted").otherwise("missing").alias("state"))
    )
    return from_fingerprints.unionByName(from_members)


def broken_reference_report(broken: DataFrame) -> DataFrame:
    """Number of broken references per table, period and state."""
    return broken.groupBy("child", "period", "state").agg(F.count("*").alias("n_references"), F.countDistinct("image_id").alias("n_images"))

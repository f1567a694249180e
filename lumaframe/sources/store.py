"""Tables that are changed by writing a new snapshot: upsert, insert-ignore, deletes with what depends on them, patches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaframe import schemas
from lumaframe.operators.order import numbered

TABLES = {"fingerprints": schemas.FINGERPRINT, "dup_groups": schemas.DUP_GROUP, "group_members": schemas.GROUP_MEMBER}


def empty_store(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}


def upsert(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """New rows replace old ones of the same key; what hangs on the key stays."""
    return new.unionByName(old.join(new.select(*key), list(key), "left_anti").select(*old.columns))


def insert_ignore(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """New rows whose key exists are ignored; repeated new rows count once."""
    return old.unionByName(new.dropDuplicates(list(key)).join(old.select(*key), list(key), "left_anti").select(*old.columns))


def delete_cascading(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the keys in `gone`."""
    return parents.join(gone.select(key), key, "left_anti"), children.join(gone.select(key), key, "left_anti")


def next_group_id(groups: DataFrame) -> DataFrame:
    """One row: next_id."""
    return groups.agg((F.coalesce(F.max("group_id"), F.lit(0)) + 1).alias("next_id"))


def mark_resolved(groups: DataFrame, done: DataFrame) -> DataFrame:
    """resolved = 1 for the groups in `done` (group_id)."""
    flag = done.select("group_id").distinct().withColumn("done", F.lit(True))
    return groups.join(flag, "group_id", "left").withColumn("resolved", F.when(F.col("done"), 1).otherwise(F.col("resolved"))).drop("done")


def completed_groups(plan: DataFrame, deletions: DataFrame) -> DataFrame:
    """group_id of the groups of a plan (group_id, image_id, action) all of whose deletions (image_id, deleted) succeeded.

    An image to be deleted that `deletions` lacks hasn't been deleted.
    """
    done = deletions.groupBy("image_id").agg(F.bool_and(F.coalesce("deleted", F.lit(False))).alias("deleted"))
    rows = plan.select("group_id", "image_id", "action").join(done, "image_id", "left")
    good = rows.groupBy("group_id").agg(F.bool_and((F.col("action") != "delete") | F.coalesce("deleted", F.lit(False))).alias("good"))
    return good.filter("good").select("group_id")


def point_reads(keys: DataFrame, fingerprints: DataFrame, members: DataFrame) -> DataFrame:
    """image_id, known, file_size, created_at, group_id for each key (image_id): its current fingerprint, if it has one, and the
    least group that it is a member of, if any."""
    wanted = keys.select("image_id").distinct()
    held = fingerprints.select("image_id", "file_size", "created_at").withColumn("known", F.lit(True))
    group = members.dropna(subset=["group_id", "image_id"]).groupBy("image_id").agg(F.min("group_id").alias("group_id"))
    rows = wanted.join(held, "image_id", "left").join(group, "image_id", "left")
    return rows.select("image_id", F.coalesce("known", F.lit(False)).alias("known"), "file_size", "created_at", "group_id")


def without_tags(items: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """key, tag_ids of the items that carry a tag in `gone` (id): what is left after these tags are deleted."""
    pairs = items.select(key, F.explode("tags").alias("t")).select(key, F.col("t.id").alias("id")).filter("id IS NOT NULL").distinct()
    hit = pairs.join(gone.select("id").distinct().withColumn("gone", F.lit(True)), "id", "left")
    left = hit.groupBy(key).agg(F.max(F.coalesce("gone", F.lit(False))).alias("hit"), F.array_sort(F.collect_list(F.when(F.col("gone").isNull(), F.col("id")))).alias("tag_ids"))
    return left.filter("hit").select(key, "tag_ids")


def patch(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Columns of `changes` replace those of the table where they aren't null."""
    fields = [c for c in changes.columns if c != key]
    new = changes.select(key, *(F.col(c).alias(f"new_{c}") for c in fields))
    joined = table.join(new, key, "left")
    return joined.select(*(F.coalesce(f"new_{c}", c).alias(c) if c in fields else F.col(c) for c in table.columns))


def get_or_create(names: DataFrame, known: DataFrame, next_id: int) -> DataFrame:
    """name, id, made: the id of each name among the known (id, name) whatever its case, or a new one.

    New ids follow next_id in order of the lower-case names; spellings of one name share it.
    """
    low = names.select("name").dropna().distinct().withColumn("low", F.lower("name"))
    have = known.select(F.lower("name").alias("low"), "id").groupBy("low").agg(F.min("id").alias("id"))
    joined = low.join(have, "low", "left")
    fresh = numbered(joined.filter("id IS NULL").select("low").distinct(), "low", "new_id", next_id).withColumn("new_id", F.col("new_id").cast("string"))
    return joined.join(fresh, "low", "left").select("name", F.coalesce("id", "new_id").alias("id"), F.col("id").isNull().alias("made"))


def write_snapshot(df: DataFrame, folder: str, version: int) -> None:
    """A new version beside the old ones; readers take the latest complete one."""
    df.write.mode("errorifexists").parquet(f"{folder}/v={version:08d}")


def read_snapshot(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/v={version:08d}")

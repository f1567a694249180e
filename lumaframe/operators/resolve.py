"""Resolving duplicate groups: the keeper of each, the metadata merged onto it, and the plan of changes.

Nothing is applied here: a plan is a DataFrame to be looked at. That is also the dry run.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaframe.functions import media as M
from lumaframe.functions.bits import id_number
from lumaframe.operators import sieve
from lumaframe.session import free_shuffles, shared_folder, stage


def library_images(images: DataFrame) -> DataFrame:
    """One row per image, image_id being the number its id spells; of differing rows of an image the greatest counts."""
    fields = [c for c in images.columns if c != "id"]
    rows = images.select(id_number(F.col("id")).alias("image_id"), F.struct(*fields).alias("r")).filter(F.col("image_id").isNotNull())
    return rows.groupBy("image_id").agg(F.max("r").alias("r")).select("image_id", "r.*")


def library_images_apart(images: DataFrame) -> DataFrame:
    """As library_images, for whole rows: only those whose number may occur more than once are shuffled, the others stay in place.

    The numbers are counted at once; those that occur again make a sieve, and what it lets through wrongly is a group of one.
    """
    spark = images.sparkSession
    ids = images.select(id_number(F.col("id")).alias("image_id")).dropna()
    again = stage(ids.groupBy("image_id").count().filter("count > 1").select(F.col("image_id").cast("string").cast("binary").alias("image_id")), shared_folder(spark), "again")
    free_shuffles(spark)
    held = sieve.of(again)

    @F.arrow_udf("boolean")
    def may_come_again(number: pa.Array) -> pa.Array:
        return pa.array(held.value.holds(number))

    fields = [c for c in images.columns if c != "id"]
    rows = images.select(id_number(F.col("id")).alias("image_id"), F.struct(*fields).alias("r")).filter(F.col("image_id").isNotNull())
    rows = rows.withColumn("again", may_come_again(F.col("image_id").cast("string").cast("binary")))
    one = rows.filter("again").groupBy("image_id").agg(F.max("r").alias("r"))
    return rows.filter("NOT again").select("image_id", "r").unionByName(one).select("image_id", "r.*")


def open_members(groups: DataFrame, members: DataFrame, images: DataFrame, honour_tag_removal: bool = True) -> DataFrame:
    """group_id and the image's columns for the members of unresolved groups that the library has.

    An image from which the tag of its group was taken is left out, as its owner wants it kept; honour_tag_removal=False is for
    a library whose images never carried those tags.
    """
    unresolved = groups.filter(F.coalesce("resolved", F.lit(0)) == 0).select("group_id", "tag_name")
    rows = members.dropna().distinct().join(unresolved, "group_id").join(images, "image_id")
    if honour_tag_removal:
        rows = rows.filter(F.coalesce(F.array_contains(F.transform("tags", lambda t: t["name"]), F.col("tag_name")), F.lit(False)))
    return rows.drop("tag_name")


def keepers(rows: DataFrame) -> DataFrame:
    """group_id, keeper_id, n_images for groups of two or more: the largest area, then the largest file, then the least id."""
    size = M.first_dimensions(F.col("visual_files"))
    area = size["width"].cast("decimal(19,0)") * size["height"].cast("decimal(19,0)")
    rank = F.struct(area.alias("area"), size["size"].alias("size"), (-F.col("image_id")).alias("first"))
    best = rows.groupBy("group_id").agg(F.max(F.struct(rank.alias("rank"), "image_id")).alias("r"), F.count("*").alias("n_images"))
    return best.filter("n_images >= 2").select("group_id", F.col("r.image_id").alias("keeper_id"), "n_images")


def merged_metadata(rows: DataFrame, done_tag: str = "1") -> DataFrame:
    """group_id, performer_ids, tag_ids, gallery_ids, rating100: the union over the group, each list sorted as text.

    Tags of the deduplication itself are left out, and the marker tag's id is added. The rating is the highest; 0 and null
    are unrated and give null. Ids are made distinct before they are shuffled, so a heavy tag costs one row per task.
    """
    entry = F.explode(
        F.concat(
            F.transform(M.ids_or_none(F.col("performers")), lambda i: F.struct(F.lit("p").alias("kind"), i.alias("id"))),
            F.transform(M.ids_or_none(F.col("galleries")), lambda i: F.struct(F.lit("g").alias("kind"), i.alias("id"))),
            F.transform(
                F.filter(F.coalesce("tags", F.array().cast("array<struct<id:string,name:string>>")), lambda t: ~F.coalesce(M.is_group_tag(t["name"]), F.lit(False)) & t["id"].isNotNull()),
                lambda t: F.struct(F.lit("t").alias("kind"), t["id"].alias("id")),
            ),
            F.array(F.struct(F.lit("t").alias("kind"), F.lit(done_tag).alias("id"))),
        )
    ).alias("e")
    distinct = rows.select("group_id", entry).select("group_id", "e.kind", "e.id").distinct()
    lists = distinct.groupBy("group_id").agg(*(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("id")))).alias(n) for k, n in (("p", "performer_ids"), ("t", "tag_ids"), ("g", "gallery_ids"))))
    ratings = rows.groupBy("group_id").agg(F.nullif(F.max(F.coalesce("rating100", F.lit(0))), F.lit(0)).alias("rating100"))
    return lists.join(ratings, "group_id")


def missing_galleries(rows: DataFrame, kept: DataFrame, merged: DataFrame) -> DataFrame:
    """group_id, keeper_id, gallery_id: galleries of the group that its keeper isn't in."""
    of_keeper = rows.select("group_id", F.col("image_id").alias("keeper_id"), M.ids_or_none(F.col("galleries")).alias("own"))
    own = kept.select("group_id", "keeper_id").join(of_keeper, ["group_id", "keeper_id"])
    return own.join(merged.select("group_id", "gallery_ids"), "group_id").select("group_id", "keeper_id", F.explode(F.array_except("gallery_ids", "own")).alias("gallery_id"))


def resolve_plan(rows: DataFrame) -> DataFrame:
    """group_id, image_id, action (keep, delete), for keepers the merged performer_ids, tag_ids, gallery_ids and rating100."""
    kept, merged = keepers(rows), merged_metadata(rows)
    acts = rows.select("group_id", "image_id").join(kept, "group_id").withColumn("keep", F.col("image_id") == F.col("keeper_id"))
    full = acts.join(merged, "group_id")
    only = lambda c: F.when(F.col("keep"), F.col(c)).alias(c)
    return full.select("group_id", "image_id", F.when(F.col("keep"), "keep").otherwise("delete").alias("action"), *(only(c) for c in ("performer_ids", "tag_ids", "gallery_ids", "rating100")))


def resolve_preview(rows: DataFrame) -> DataFrame:
    """group_id, keeper_id, n_images, performers, tags: names that the keeper would carry, sorted, for the report."""
    kept = keepers(rows)
    performers = rows.select("group_id", F.explode("performers").alias("e")).select("group_id", F.col("e.name").alias("name")).dropna().distinct()
    tags = rows.select("group_id", F.explode("tags").alias("e")).select("group_id", F.col("e.name").alias("name")).filter(~M.is_group_tag(F.col("name"))).distinct()
    joined = lambda d, n: d.groupBy("group_id").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias(n))
    rows = kept.join(joined(performers, "performers"), "group_id", "left").join(joined(tags, "tags"), "group_id", "left")
    return rows.select("group_id", "keeper_id", "n_images", F.coalesce("performers", F.lit("")).alias("performers"), F.coalesce("tags", F.lit("")).alias("tags"))


def updated_images(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """image_id, tag_ids, performer_ids, rating100 of the images that are left once the plan is applied: keepers get the merged
    lists and rating, others keep their own, the deleted are gone."""
    own = rows.select("image_id", M.ids_or_none(F.col("tags")).alias("tag_ids"), M.ids_or_none(F.col("performers")).alias("performer_ids"), "rating100")
    gone = plan.filter("action = 'delete'").select("image_id").distinct()
    kept = plan.filter("action = 'keep'").groupBy("image_id").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("group_id"))).alias(f"new_{c}") for c in ("tag_ids", "performer_ids", "rating100")))  # of several groups the last that says something
    left = own.join(gone, "image_id", "left_anti").join(kept, "image_id", "left")
    return left.select("image_id", *(F.coalesce(f"new_{c}", c).alias(c) for c in ("tag_ids", "performer_ids", "rating100")))


def gallery_members(images: DataFrame, added: DataFrame) -> DataFrame:
    """gallery_id, image_id: who is in which gallery once the missing ones (keeper_id, gallery_id) are added."""
    old = images.select(F.explode(M.ids_or_none(F.col("galleries"))).alias("gallery_id"), "image_id")
    return old.unionByName(added.select("gallery_id", F.col("keeper_id").alias("image_id"))).distinct()


def resolve_counts(plan: DataFrame) -> DataFrame:
    """One row: groups, kept, deleted."""
    return plan.agg(F.countDistinct("group_id").alias("groups"), F.count_if(F.col("action") == "keep").alias("kept"), F.count_if(F.col("action") == "delete").alias("deleted"))

"""Scenes and images as items whose on-screen text is read: which of them are to be read, and what follows for each.

An item is named "scene:" or "image:" and its number, so both go through one run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaframe.functions import media as M
from lumaframe.functions.bits import id_number
from lumaframe.operators.link import matches_by_url
from lumaframe.operators.resolve import library_images, library_images_apart
from lumaframe.operators.votes import decisions, username_votes, winners
from lumaframe.session import free_shuffles, shared_folder, stage, unbounded

FIELDS = ("item_type", "item_id", "title", "n_files", "path", "duration", "details", "studio", "tags", "performers")
PATCHES = ("new_studio", "new_details", "new_performers", "new_tags")


def item_name(kind: str, number: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), number.cast("string"))


def library_scenes(scenes: DataFrame) -> DataFrame:
    """One row per scene, scene_id being the number its id spells; of differing rows of a scene the greatest counts."""
    fields = [c for c in scenes.columns if c != "id"]
    rows = scenes.select(id_number(F.col("id")).alias("scene_id"), F.struct(*fields).alias("r")).filter("scene_id IS NOT NULL")
    return rows.groupBy("scene_id").agg(F.max("r").alias("r")).select("scene_id", "r.*")


def scene_items(scenes: DataFrame) -> DataFrame:
    """Items of scenes: path and duration are those of the first file, whatever it lacks. A missing duration is 0."""
    first = F.get("files", F.lit(0))
    return library_scenes(scenes).select(
        F.lit("scene").alias("item_type"), item_name("scene", F.col("scene_id")).alias("item_id"), "title", F.greatest(F.coalesce(F.size("files"), F.lit(0)), F.lit(0)).alias("n_files"),
        F.coalesce(first["path"], F.lit("")).alias("path"), F.coalesce(first["duration"], F.lit(0.0)).alias("duration"), "details", "studio", "tags", "performers",
    )


def image_items(images: DataFrame, apart: bool = False) -> DataFrame:
    """Items of images. apart: the rows are whole and many, and only those of ids that come again are to be shuffled."""
    first = F.get("visual_files", F.lit(0))
    return (library_images_apart if apart else library_images)(images).select(
        F.lit("image").alias("item_type"), item_name("image", F.col("image_id")).alias("item_id"), "title", F.greatest(F.coalesce(F.size("visual_files"), F.lit(0)), F.lit(0)).alias("n_files"),
        F.coalesce(first["path"], F.lit("")).alias("path"), F.lit(0.0).alias("duration"), "details", "studio", "tags", "performers",
    )


def to_read(items: DataFrame, mode: str, wanted: DataFrame | None = None) -> DataFrame:
    """The items of a run: extract and scan take those without the marker tag, tagged those with the queue tag, single and hook
    those in `wanted` (item_id), whatever their tags."""
    if mode in ("extract", "scan"):
        return items.filter(~M.has_tag(F.col("tags"), M.OCR_PROCESSED_TAG))
    if mode == "tagged":
        return items.filter(M.has_tag(F.col("tags"), M.OCR_QUEUE_TAG))
    if mode in ("single", "hook") and wanted is not None:
        return items.join(unbounded(wanted.select("item_id").distinct()), "item_id", "left_semi")
    raise ValueError(f"no such mode, or nothing wanted: {mode}")


def with_file(items: DataFrame, listing: DataFrame) -> DataFrame:
    """The items with `there`: the listing (path) has their file."""
    known = listing.select("path").filter("path <> ''").distinct().withColumn("there", F.lit(True))
    return items.join(unbounded(known), "path", "left").withColumn("there", F.coalesce("there", F.lit(False)))


def outcomes(items: DataFrame, listing: DataFrame, texts: DataFrame, performers: DataFrame, done_tag: str, queue_tag: str | None = None, dry_run: bool = False) -> DataFrame:
    """One row per item: status and the new value of each field (see decisions).

    texts: item_id, frame_no, variant_no, text of any items; only those of items with a file are scored. A dry run says the
    status and changes nothing. An item without file keeps its tags: it stays unprocessed, or queued.
    """
    spark = items.sparkSession
    folder = shared_folder(spark)
    bare = lambda c: F.transform(c, lambda e: F.struct(e["id"].alias("id"), F.lit(None).cast("string").alias("name"))).alias(c)  # noqa: E731 of tags and performers only ids decide
    rows = stage(with_file(items.select("item_id", "n_files", "path", "details", "studio", bare("tags"), bare("performers")), listing).drop("path"), folder, "items")
    free_shuffles(spark)
    won = stage(winners(texts.join(unbounded(rows.filter("there").select("item_id")), "item_id", "left_semi")), folder, "winners")
    free_shuffles(spark)
    # matches go to the winners, not to the whole items
    matches = matches_by_url(won.select("username").filter("username IS NOT NULL"), performers)
    detected = stage(won.join(unbounded(matches), "username", "left"), folder, "detected")
    free_shuffles(spark)
    out = decisions(rows, detected, None, done_tag, queue_tag)
    if dry_run:
        out = out.select("item_id", "status", *(F.lit(None).cast(out.schema[c].dataType).alias(c) for c in PATCHES))
    return out


def top_votes(texts: DataFrame, most: int = 5) -> DataFrame:
    """item_id, place, username, score: the usernames with the most votes of each item, the first seen first among equals."""
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "first")
    return username_votes(texts).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select("item_id", "place", "username", "score")

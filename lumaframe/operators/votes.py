"""Votes for platform and username from recognised text, and what follows from the winners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaframe.functions import media as M
from lumaframe.functions import text as T
from lumaframe.session import unbounded


def _read(ocr: DataFrame) -> DataFrame:
    return ocr.filter(T.strip(F.col("text")) != "")


def username_votes(ocr: DataFrame) -> DataFrame:
    """item_id, username, score and first (frame, variant, place of the first vote) over all texts of an item.

    A text votes with the scores of its usernames, and once more with HOST_BOOST for each name near a live badge. Blank
    and null texts don't vote. Votes are summed before the shuffle.
    """
    both = F.concat(T.usernames(F.col("text")), F.transform(T.host_names(F.col("text")), lambda n: F.struct(n.alias("username"), F.lit(T.HOST_BOOST).cast("bigint").alias("score"))))
    votes = _read(ocr).select("item_id", "frame_no", "variant_no", F.posexplode(both).alias("place", "v"))
    return votes.groupBy("item_id", F.col("v.username").alias("username")).agg(F.sum("v.score").alias("score"), F.min(F.struct("frame_no", "variant_no", "place")).alias("first"))


def platform_votes(ocr: DataFrame) -> DataFrame:
    """As username_votes, with platform in place of username."""
    scores = F.array(
        F.struct(F.lit(T.PLATFORM_A).alias("platform"), T.platform_a_score(F.col("text")).alias("score")),
        F.struct(F.lit(T.PLATFORM_B).alias("platform"), T.platform_b_score(F.col("text")).alias("score")),
    )
    votes = _read(ocr).select("item_id", "frame_no", "variant_no", F.posexplode(scores).alias("place", "v")).filter("v.score > 0")
    return votes.groupBy("item_id", F.col("v.platform").alias("platform")).agg(F.sum("v.score").alias("score"), F.min(F.struct("frame_no", "variant_no", "place")).alias("first"))


def winner(votes: DataFrame, name: str, threshold: int = 0) -> DataFrame:
    """item_id and the name with the highest score, the first seen of equals, if it reaches the threshold. One aggregation."""
    rank = F.struct("score", -F.col("first.frame_no"), -F.col("first.variant_no"), -F.col("first.place"), F.col(name).alias("name"))
    best = votes.groupBy("item_id").agg(F.max(rank).alias("r"))
    return best.filter(F.col("r.score") >= threshold).select("item_id", F.col("r.name").alias(name))


def winners(ocr: DataFrame) -> DataFrame:
    """item_id, platform, username: what was detected for each item with text."""
    platform = winner(platform_votes(ocr), "platform", T.PLATFORM_THRESHOLD)
    username = winner(username_votes(ocr), "username")
    return platform.join(unbounded(username), "item_id", "full")


def decisions(items: DataFrame, detected: DataFrame, links: DataFrame | None, done_tag: str, queue_tag: str | None = None) -> DataFrame:
    """One row per item: status, and the new value of each field, null where it stays as it is.

    items: item_id, n_files, there, details, studio, tags, performers; an item without files is `no_files`, one whose file isn't
    there `file_missing`. detected: winners(). links: username, performer_id, name of matching performers; none where `detected` has
    them as its column matches. The studio is never
    overridden; details get the marker once; performers only grow; the marker tag is added and the queue tag removed only for
    items whose file is there.
    """
    rows = items.join(unbounded(detected), "item_id", "left")
    if links is not None:
        linked = links.groupBy("username").agg(F.collect_list(F.struct("performer_id", "name")).alias("matches"))  # ten at most
        rows = rows.join(unbounded(linked), "username", "left")
    have = M.ids_or_none(F.col("performers"))
    fresh = F.array_sort(F.filter(F.coalesce("matches", F.array().cast("array<struct<performer_id:string,name:string>>")), lambda m: ~F.array_contains(have, m["performer_id"])))
    there = F.col("there") & (F.col("n_files") > 0)
    tags = F.array_union(M.ids_or_none(F.col("tags")), F.array(F.lit(done_tag)))
    if queue_tag is not None:
        tags = F.array_except(tags, F.array(F.lit(queue_tag)))
    rows = rows.withColumn("fresh", fresh)
    names = F.array_join(F.transform("fresh", lambda m: m["name"]), ",")
    parts = F.concat_ws(
        ", ",
        F.concat(F.lit("platform="), F.col("platform")),
        F.concat(F.lit("username=@"), F.col("username")),
        F.when(F.size("fresh") > 0, F.concat(F.lit("performers="), names)),
    )
    details = F.coalesce("details", F.lit(""))
    return rows.select(
        "item_id",
        F.when(F.col("n_files") == 0, "no_files").when(~there, "file_missing").otherwise(F.coalesce(F.nullif(parts, F.lit("")), F.lit("nothing_detected"))).alias("status"),
        F.when(there & (F.coalesce("studio.name", F.lit("")) == ""), F.col("platform")).alias("new_studio"),
        F.when(there & F.col("username").isNotNull() & ~details.contains(T.MARKER), T.details_with(F.col("details"), F.col("username"))).alias("new_details"),
        F.when(there & (F.size("fresh") > 0), F.array_sort(F.concat(have, F.transform("fresh", lambda m: m["performer_id"])))).alias("new_performers"),
        F.when(there, F.array_sort(tags)).alias("new_tags"),
    )


def status_class(status: Column) -> Column:
    return F.when(status.contains("nothing_detected") | status.contains("no_files"), "not_detected").when(status.contains("file_missing"), "error").otherwise("detected")


def status_counts(status: DataFrame) -> DataFrame:
    """One row: detected, not_detected, errors, total."""
    kind = status_class(F.col("status"))
    return status.agg(
        F.count_if(kind == "detected").alias("detected"), F.count_if(kind == "not_detected").alias("not_detected"), F.count_if(kind == "error").alias("errors"), F.count("*").alias("total")
    )

"""Duplicate groups: made from pairs, extended and merged as new pairs come in, cleaned up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaframe.functions.media import group_tag
from lumaframe.operators.components import components
from lumaframe.operators.current import current_fingerprints
from lumaframe.operators.order import numbered
from lumaframe.operators.similarity import LEAVES, carriers_of
from lumaframe.operators.tries import near_values
from lumaframe.session import free_shuffles, shared_folder, stage, unbounded


def duplicate_groups(fingerprints: DataFrame, threshold: int = 10) -> DataFrame:
    """image_id, root: images that are duplicates of another one, directly or over others; root is the least of them.

    Duplicates have the same digest or a distance within the threshold. Images hang on the least of those with the same file,
    and on the least of those with a hash in common; near hashes link these. So pairs of copies are never written out.
    """
    spark = fingerprints.sparkSession
    folder = shared_folder(spark)
    current = current_fingerprints(fingerprints, "digest", "dhash_full", "dhash_crop").select("image_id", "digest", F.col("dhash_full").alias("full"), F.col("dhash_crop").alias("crop"))
    rows = stage(current, folder, "current")
    carriers = carriers_of(rows, "image_id")
    values = stage(carriers.groupBy("v").agg(F.min("image_id").alias("a"), F.count("*").alias("n")), folder, "values")
    free_shuffles(spark)
    near = stage(near_values(values, threshold, LEAVES), folder, "near")
    free_shuffles(spark)
    known = rows.filter("digest IS NOT NULL").select("digest", "image_id")
    files = known.groupBy("digest").agg(F.min("image_id").alias("a"), F.count("*").alias("n")).filter("n > 1")
    of_file = known.join(unbounded(files), "digest").select("a", F.col("image_id").alias("b"))
    of_hash = carriers.join(unbounded(values.filter("n > 1")), "v").select("a", F.col("image_id").alias("b"))
    x, y = (values.select(F.col("v").alias(v), F.col("a").alias(c)) for v, c in (("x", "a"), ("y", "b")))
    of_near = near.join(unbounded(x), "x").join(unbounded(y), "y").select("a", "b")
    return components(of_file.unionByName(of_hash).unionByName(of_near)).select(F.col("id").alias("image_id"), "root")


def named_groups(groups: DataFrame, first_number: int = 1) -> DataFrame:
    """root, n_images, group_id, tag_name: the groups in order of their root, numbered from first_number on."""
    sizes = groups.groupBy("root").agg(F.count("*").alias("n_images")).filter("n_images >= 2")
    return numbered(sizes, "root", "group_id", first_number).select("root", "n_images", "group_id", group_tag(F.col("group_id")).alias("tag_name"))


def group_actions(components_: DataFrame, members: DataFrame) -> DataFrame:
    """root, action (create, extend, merge), group_id, n_new, merged: what each component means for the existing groups.

    components_: image_id, root. members: group_id, image_id of existing groups. No group is touched: create (group_id
    null). One: extend it, if an image isn't a member yet. Several: merge into the one with the least id; `merged` are the
    others, sorted. Components that change nothing have no row.
    """
    held = members.dropna().select("group_id", "image_id").distinct()
    rows = components_.join(held, "image_id", "left")
    summed = rows.groupBy("root").agg(
        F.min("group_id").alias("group_id"),
        F.count_if(F.col("group_id").isNull()).alias("n_new"),
        F.array_sort(F.collect_set("group_id")).alias("touched"),
    )
    n = F.size("touched")
    return summed.select(
        "root",
        F.when(n == 0, "create").when(n == 1, "extend").otherwise("merge").alias("action"),
        "group_id",
        "n_new",
        F.filter("touched", lambda g: g > F.col("group_id")).alias("merged"),
    ).filter((F.col("action") != "extend") | (F.col("n_new") > 0))


def updated_members(components_: DataFrame, members: DataFrame, next_id: int) -> DataFrame:
    """group_id, image_id after the actions: members of merged groups move to the survivor, new images join, new groups are
    numbered from next_id on in order of their root."""
    actions = group_actions(components_, members)
    created = named_groups(components_.join(actions.filter("action = 'create'").select("root"), "root", "left_semi"), next_id).select("root", F.col("group_id").alias("made"))
    goal = components_.join(actions.select("root", "group_id"), "root").join(created, "root", "left").select(F.coalesce("made", "group_id").alias("group_id"), "image_id")
    moves = actions.filter("action = 'merge'").select(F.col("group_id").alias("to"), F.explode("merged").alias("from"))
    kept = members.dropna().select("group_id", "image_id").join(moves, F.col("group_id") == F.col("from"), "left").select(F.coalesce("to", "group_id").alias("group_id"), "image_id")
    return kept.unionByName(goal).distinct()


def reopened_groups(groups: DataFrame, actions: DataFrame) -> DataFrame:
    """The groups with resolved = 0 where an action extends them or merges others into them: their new members are to be resolved."""
    grown = actions.filter("action <> 'create'").select("group_id").distinct().withColumn("grown", F.lit(True))
    joined = groups.join(grown, "group_id", "left")
    return joined.select(*(F.when(F.col("grown"), 0).otherwise(F.col(c)).alias(c) if c == "resolved" else F.col(c) for c in groups.columns))


def reconciled_groups(groups: DataFrame, components_: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The groups after the actions, and what each of them is: (group_id, tag_name, resolved, state), and the members.

    state: kept, extended, merged (others went into it), created, or deleted (it went into another one; its tag is to be
    destroyed). Groups that grow are open again. Of several rows of a group the least tag counts.
    """
    known = groups.groupBy("group_id").agg(F.min("tag_name").alias("tag_name"), F.max(F.coalesce("resolved", F.lit(0))).alias("resolved"))
    next_id = (groups.agg(F.max("group_id")).first()[0] or 0) + 1
    actions = group_actions(components_, members)
    after = updated_members(components_, members, next_id)
    gone = actions.select(F.explode("merged").alias("group_id")).distinct().withColumn("gone", F.lit(True))
    grown = actions.filter("action <> 'create'").groupBy("group_id").agg(F.max("action").alias("action"))  # merge counts before extend
    rows = known.join(gone, "group_id", "left").join(grown, "group_id", "left")
    state = F.when(F.col("gone"), "deleted").when(F.col("action") == "merge", "merged").when(F.col("action") == "extend", "extended").otherwise("kept")
    old = rows.select("group_id", "tag_name", F.when(F.col("action").isNotNull(), 0).otherwise(F.col("resolved")).alias("resolved"), state.alias("state"))
    made = after.filter(F.col("group_id") >= next_id).select("group_id").distinct()
    new = made.select("group_id", group_tag(F.col("group_id")).alias("tag_name"), F.lit(0).alias("resolved"), F.lit("created").alias("state"))
    return old.unionByName(new), after


def probe_actions(matches: DataFrame, members: DataFrame) -> DataFrame:
    """query_id, action (existing, merge, new), groups, n_matches: what the matches of a new image mean.

    No row for an image without matches. matches: query_id, image_id; see grouped_actions for those that carry a group.
    """
    return grouped_actions(matches.select("query_id", "image_id").join(first_groups(members), "image_id", "left"))


def first_groups(members: DataFrame) -> DataFrame:
    """image_id, group_id: the least group of each member."""
    return members.dropna().groupBy("image_id").agg(F.min("group_id").alias("group_id"))


def grouped_actions(matches: DataFrame) -> DataFrame:
    """probe_actions of matches (query_id, group_id, null if the image is in none). They are counted by group before any shuffle."""
    counted = matches.groupBy("query_id", "group_id").agg(F.count("*").alias("n"))
    summed = counted.groupBy("query_id").agg(F.sum("n").alias("n_matches"), F.array_sort(F.collect_set("group_id")).alias("groups"))
    n = F.size("groups")
    return summed.select("query_id", F.when(n == 0, "new").when(n == 1, "existing").otherwise("merge").alias("action"), "groups", "n_matches")


def cleanup_counts(groups: DataFrame, members: DataFrame, gone: DataFrame) -> DataFrame:
    """One row: orphaned, empty, single: what a cleanup removes, given the images (image_id) whose fingerprints go.

    A fingerprint takes its memberships along, so groups are counted after it.
    """
    left = members.join(gone.select("image_id"), "image_id", "left_anti")
    sizes = size_classes(groups, left)
    of = lambda c: F.coalesce(F.sum(F.when(F.col("size_class") == c, F.col("n_groups"))), F.lit(0)).cast("bigint").alias(c)
    return gone.select("image_id").distinct().agg(F.count("*").alias("orphaned")).crossJoin(sizes.agg(of("empty"), of("single")))  # one row each


def size_classes(groups: DataFrame, members: DataFrame) -> DataFrame:
    """size_class (empty, single, several), n_groups: groups by their number of distinct members."""
    sizes = groups.select("group_id").join(members.dropna().distinct(), "group_id", "left").groupBy("group_id").agg(F.count("image_id").alias("n"))
    kind = F.when(F.col("n") == 0, "empty").when(F.col("n") == 1, "single").otherwise("several")
    return sizes.groupBy(kind.alias("size_class")).agg(F.count("*").alias("n_groups"))

"""Images with the same file or with hashes that differ in few bits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaframe.functions.bits import least_distance
from lumaframe.operators.current import current_fingerprints
from lumaframe.operators.tries import near_across, near_values
from lumaframe.session import free_shuffles, shared_folder, stage, unbounded

LEAVES = 8  #: of the upper tries for thresholds up to 10


def hash_classes(fingerprints: DataFrame) -> DataFrame:
    """One row per distinct (digest, full, crop) of the current fingerprints: class_id (its least image), digest, full, crop, n_images.

    Copies of one file are one row, however many: joins work on classes, and class_members says who is in one. An unknown
    digest is shared by nobody.
    """
    own = F.concat(F.lit(b"?"), F.encode(F.col("image_id").cast("string"), "UTF-8"))
    rows = current_fingerprints(fingerprints, "digest", "dhash_full", "dhash_crop").select("image_id", F.coalesce("digest", own).alias("digest"), F.col("dhash_full").alias("full"), F.col("dhash_crop").alias("crop"))
    return rows.groupBy("digest", "full", "crop").agg(F.min("image_id").alias("class_id"), F.count("*").alias("n_images"))


def exact_classes(fingerprints: DataFrame) -> DataFrame:
    """image_id, class_id (least image with the same digest), n_images with it; one row per image with a known digest."""
    rows = current_fingerprints(fingerprints, "digest").filter(F.col("digest").isNotNull()).select("image_id", "digest")
    sizes = rows.groupBy("digest").agg(F.min("image_id").alias("class_id"), F.count("*").alias("n_images"))
    return rows.join(sizes, "digest").select("image_id", "class_id", "n_images")


def carriers_of(rows: DataFrame, who: str) -> DataFrame:
    """v, and the column `who`: each known hash of each row, once where both are equal."""
    return rows.select(F.explode(F.array_distinct(F.array("full", "crop"))).alias("v"), who).filter("v IS NOT NULL")


def near_classes(classes: DataFrame, threshold: int = 10) -> DataFrame:
    """class_a < class_b, distance: pairs of classes whose least of the four distances is `threshold` or less.

    Distinct hashes are joined by their tries, whatever the threshold, and the pairs of hashes then lead to those of classes.
    No class is compared with every other, and no side is broadcast.
    """
    folder = shared_folder(classes.sparkSession)
    carriers = stage(carriers_of(classes, "class_id"), folder, "carriers")
    values = stage(carriers.groupBy("v").agg(F.count("*").alias("n")), folder, "values")
    free_shuffles(classes.sparkSession)
    near = near_values(values, threshold, LEAVES).select("x", "y", F.bit_count(F.col("x").bitwiseXOR(F.col("y"))).cast("int").alias("distance"))
    links = near.unionByName(values.filter("n > 1").select(F.col("v").alias("x"), F.col("v").alias("y"), F.lit(0).alias("distance")))
    left, right = (carriers.select(F.col("v").alias(v), F.col("class_id").alias(c)) for v, c in (("x", "a"), ("y", "b")))
    pairs = links.join(unbounded(left), "x").join(unbounded(right), "y").filter("a <> b")
    return pairs.groupBy(F.least("a", "b").alias("class_a"), F.greatest("a", "b").alias("class_b")).agg(F.min("distance").alias("distance"))


def matches_of(queries: DataFrame, fingerprints: DataFrame, threshold: int = 10, carry: tuple[str, ...] = ()) -> DataFrame:
    """query_id, image_id, distance: for each query all other images with the same digest or a distance within the threshold.

    queries and fingerprints: image_id, digest, full, crop, a row per image. Images of one digest and hashes are a class on either
    side. The distinct hashes of the queries meet those of all rows by their tries, pairs of hashes lead to those of classes,
    and only the result has a row for each copy: a picture with a third of all rows isn't shuffled as pairs. carry: further columns
    of the fingerprints that a match has, so that it needn't be joined with them.
    """
    folder = shared_folder(queries.sparkSession)
    asked, ask = _classed(queries, folder, "queries")
    rows, held = _classed(fingerprints, folder, "rows", carry)
    of_query, of_row = (carriers_of(c, "id").select(F.col("v").alias(v), F.col("id").alias(i)) for c, v, i in ((ask, "x", "qc"), (held, "y", "rc")))
    values = [stage(c.select(F.col(v).alias("v")).distinct(), folder, f"values-{v}") for c, v in ((of_query, "x"), (of_row, "y"))]
    pairs = near_across(*values, threshold).select("x", "y", F.bit_count(F.col("x").bitwiseXOR(F.col("y"))).cast("int").alias("distance"))
    near = pairs.join(unbounded(of_query), "x").join(unbounded(of_row), "y").select("qc", "rc", "distance")
    known = ask.select(F.col("id").alias("qc"), "digest", F.col("full").alias("qf"), F.col("crop").alias("qk")).filter("digest IS NOT NULL")
    distance = least_distance(F.col("full"), F.col("crop"), F.col("qf"), F.col("qk")).cast("int").alias("distance")
    same = held.join(unbounded(known), "digest").select("qc", F.col("id").alias("rc"), distance)
    found = stage(near.unionByName(same).groupBy("qc", "rc").agg(F.min("distance").alias("distance")), folder, "found")
    free_shuffles(queries.sparkSession)
    met = held.join(unbounded(found.select(F.col("rc").alias("id")).distinct()), "id", "left_semi")
    mine, others = _members(asked, ask, "qc", "query_id"), _members(rows, met, "rc", "image_id", carry)
    return found.join(unbounded(mine), "qc").join(unbounded(others), "rc").filter("image_id <> query_id").select("query_id", "image_id", "distance", *carry)


def _classed(rows: DataFrame, folder: str, name: str, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The rows, and their classes: id (the least image), digest, full, crop; both written."""
    rows = stage(rows.select("image_id", "digest", "full", "crop", *carry), folder, name)
    classes = rows.groupBy("digest", "full", "crop").agg(F.min("image_id").alias("id"))
    return rows, stage(classes.select("id", "digest", "full", "crop"), folder, f"{name}-classes")


def _members(rows: DataFrame, classes: DataFrame, class_name: str, name: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """The images of classes; an unknown digest or hash is as good as any other value here."""
    keys = classes.select(F.col("id").alias(class_name), F.col("digest").alias("d"), F.col("full").alias("f"), F.col("crop").alias("c"))
    on = F.col("digest").eqNullSafe(F.col("d")) & F.col("full").eqNullSafe(F.col("f")) & F.col("crop").eqNullSafe(F.col("c"))
    return rows.join(unbounded(keys), on).select(class_name, F.col("image_id").alias(name), *carry)

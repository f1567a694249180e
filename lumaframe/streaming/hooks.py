"""Per-event processing as Structured Streaming."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaframe.functions.bits import id_number
from lumaframe.operators.components import components
from lumaframe.operators.current import current_fingerprints
from lumaframe.operators.similarity import matches_of
from lumaframe.schemas import FINGERPRINT, HOOK_EVENT


CREATED = ("Scene.Create.Post", "Image.Create.Post")  #: the events on which an item is read
TIMEOUT = 3600  #: seconds that a run over what is there may take


def item_events(events: DataFrame) -> DataFrame:
    """item_id ("scene:" or "image:" and the number), ts of creation events; one whose id spells no number is left out."""
    number = id_number(F.col("id"))
    kind = F.when(F.col("hook_type").contains("Scene"), "scene:").otherwise("image:")
    return events.filter(F.col("hook_type").isin(*CREATED) & number.isNotNull()).select(F.concat(kind, number.cast("string")).alias("item_id"), "ts")


def is_image_event(kind: Column) -> Column:
    return kind.contains("Image")


def image_events(events: DataFrame) -> DataFrame:
    """hook_type, image_id, ts of events about images whose id spells a number; works on streams and tables alike."""
    return events.filter(is_image_event(F.col("hook_type"))).select("hook_type", id_number(F.col("id")).alias("image_id"), "ts").filter("image_id IS NOT NULL")


def latest_events(events: DataFrame) -> DataFrame:
    """image_id, ts, hook_type: the latest event of each image; of events at the same instant the greatest type."""
    latest = events.groupBy("image_id").agg(F.max(F.struct("ts", "hook_type")).alias("r"))
    return latest.select("image_id", "r.ts", "r.hook_type")


def finish(query, timeout: float = TIMEOUT) -> None:
    """Wait till a run over what is there has ended; one that takes longer is stopped and reported."""
    if not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"the run has not ended within {timeout} seconds")


def follow(spark: SparkSession, source: str, handle: Callable[[DataFrame, int], None], checkpoint: str, pick: Callable[[DataFrame], DataFrame] = image_events, timeout: float = TIMEOUT) -> None:
    """Hand the events of the files of a table that `pick` takes to `handle`, a batch at a time and each batch once, till none is left.

    `handle` gets the batch and its number, and writes by key or by number, so that a batch repeated after a failure
    changes nothing. `source` is a folder of files or a single one.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    single = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    folder, glob = (path.getParent().toString(), path.getName()) if single else (source, "*.parquet")
    stream = spark.readStream.schema(HOOK_EVENT).option("pathGlobFilter", glob).option("maxFilesPerTrigger", 4).parquet(folder)
    finish(pick(stream).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(), timeout)


def streamed_items(spark: SparkSession, source: str, decide: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """What `decide` says of the items (item_id) of creation events of scenes and images, batch by batch; of an item that is
    read again in a later batch the last word counts.

    Batch n writes results n, so a batch repeated after a failure writes the same again. Nothing of earlier batches is read.
    """

    def handle(batch: DataFrame, number: int) -> None:
        decide(batch.select("item_id").distinct()).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/read/{number}")

    follow(spark, source, handle, f"{folder}/progress-items", item_events)
    rows = spark.read.parquet(f"{folder}/read/*")
    fields = [c for c in rows.columns if c not in ("item_id", "batch")]
    return rows.groupBy("item_id").agg(F.max_by(F.struct(*fields), "batch").alias("r")).select("item_id", "r.*")


def streamed_latest(spark: SparkSession, source: str, folder: str) -> DataFrame:
    """latest_events of all files of a table, kept up to date batch by batch.

    Batch n reads snapshot n - 1 and writes snapshot n, so a batch repeated after a failure writes the same again, and a
    restarted query goes on where it stopped.
    """

    def handle(batch: DataFrame, number: int) -> None:
        new = latest_events(batch)
        if number:
            new = latest_events(batch.sparkSession.read.parquet(f"{folder}/state/{number - 1}").unionByName(new))
        new.write.mode("overwrite").parquet(f"{folder}/state/{number}")

    follow(spark, source, handle, f"{folder}/progress")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/state")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return spark.createDataFrame([], "image_id bigint, ts timestamp, hook_type string")
    last = max(int(s.getPath().getName()) for s in fs.listStatus(path))
    return spark.read.parquet(f"{folder}/state/{last}")


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Number of events per type and window of event time; on a stream, events later than `late` are left out."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", window).alias("w"), "hook_type")
        .agg(F.count("*").alias("n_events"))
        .select(F.col("w.start").alias("starts"), "hook_type", "n_events")
    )


def streamed_groups(spark: SparkSession, source: str, folder: str, threshold: int = 10, timeout: float = TIMEOUT) -> DataFrame:
    """image_id, root: duplicate groups kept up to date as fingerprints arrive in files, batch by batch.

    After each batch they are those of duplicate_groups over all rows so far, whatever arrives late, twice or in place of an
    earlier fingerprint. Only hashes that weren't known are compared with all that are (a stated set of queries against all rows),
    and their links are kept by the values of the hashes, so a replaced fingerprint takes none along that isn't its own. Of the
    groups only those are formed again that hold a changed image or one that is now like it. State is written as what batch n
    adds (fingerprints, links) and the groups after it, so a batch repeated after a failure writes the same again.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    single = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    base, glob = (path.getParent().toString(), path.getName()) if single else (source, "*.parquet")
    stream = spark.readStream.schema(FINGERPRINT).option("pathGlobFilter", glob).option("maxFilesPerTrigger", 1).parquet(base)
    take = lambda batch, number: _take_prints(batch, number, folder, threshold)
    finish(stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start(), timeout)
    return _last_groups(spark, folder)


def event_groups(spark: SparkSession, source: str, fingerprints: DataFrame, folder: str, threshold: int = 10) -> DataFrame:
    """As streamed_groups, for the images of creation events: each batch looks up the fingerprints of its images. Other events,
    ids that spell no number and images without fingerprint change nothing."""

    def take(batch: DataFrame, number: int) -> None:
        ids = batch.filter("hook_type = 'Image.Create.Post'").select("image_id").distinct()
        _take_prints(fingerprints.join(ids, "image_id", "left_semi"), number, folder, threshold)

    follow(spark, source, take, f"{folder}/progress")
    return _last_groups(spark, folder)


def _last_groups(spark: SparkSession, folder: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/groups")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return spark.createDataFrame([], "image_id bigint, root bigint")
    return spark.read.parquet(f"{folder}/groups/{max(int(s.getPath().getName()) for s in fs.listStatus(path))}")


_PRINTS = "image_id bigint, created_at timestamp, digest binary, full bigint, crop bigint"


def _take_prints(batch: DataFrame, number: int, folder: str, threshold: int) -> None:
    session = batch.sparkSession

    def so_far(name: str, schema: str, upto: int) -> DataFrame:
        return session.read.schema(schema).parquet(*(f"{folder}/{name}/{i}" for i in range(upto))) if upto else session.createDataFrame([], schema)

    def written(rows: DataFrame, name: str) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{folder}/{name}/{number}")
        return session.read.schema(rows.schema).parquet(f"{folder}/{name}/{number}")

    def current(rows: DataFrame) -> DataFrame:
        return rows.groupBy("image_id").agg(F.max(F.struct("created_at", "digest", "full", "crop")).alias("r")).select("image_id", "r.*")

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    value = F.when(F.coalesce("full", "crop").isNotNull(), F.concat(text("full"), F.lit(" "), text("crop"))).alias("value")
    new = current_fingerprints(batch, "digest", "dhash_full", "dhash_crop").select("image_id", "created_at", "digest", F.col("dhash_full").alias("full"), F.col("dhash_crop").alias("crop"))
    held = current(so_far("prints", _PRINTS, number))
    old = held.select("image_id", F.struct("created_at", "digest", "full", "crop").alias("o"))
    fresh = new.join(old, "image_id", "left").filter(F.col("o").isNull() | (F.struct("created_at", "digest", "full", "crop") > F.col("o"))).drop("o")
    changed = written(fresh, "prints")
    known = current(so_far("prints", _PRINTS, number + 1)).select("image_id", "digest", "full", "crop", value)
    values = lambda rows: rows.select(value, "full", "crop").filter("value IS NOT NULL").distinct()
    before = values(so_far("prints", _PRINTS, number))
    unseen = values(changed).join(before.select("value"), "value", "left_anti")
    as_rows = lambda rows: rows.select(F.col("value").alias("image_id"), F.lit(None).cast("binary").alias("digest"), "full", "crop")
    everything = as_rows(before).unionByName(as_rows(unseen))
    written(matches_of(as_rows(unseen), everything, threshold).select(F.col("query_id").alias("a"), F.col("image_id").alias("b")), "links")
    links = so_far("links", "a string, b string", number + 1)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    groups = session.read.parquet(f"{folder}/groups/{number - 1}") if number else session.createDataFrame([], "image_id bigint, root bigint")
    # the images that are now like a changed one, and what its groups and theirs held so far
    mine = known.join(changed.select("image_id"), "image_id", "left_semi")
    near = both.join(mine.select(F.col("value").alias("a")), "a", "left_semi").select(F.col("b").alias("value")).unionByName(mine.select("value")).filter("value IS NOT NULL").distinct()
    like = known.join(near, "value", "left_semi").select("image_id").unionByName(known.join(mine.select("digest"), "digest", "left_semi").select("image_id"))
    touched = like.unionByName(changed.select("image_id")).distinct()
    roots = groups.join(touched, "image_id", "left_semi").select("root").distinct()
    again = written(touched.unionByName(groups.join(roots, "root", "left_semi").select("image_id")).distinct(), "touched")
    there = known.join(again, "image_id", "left_semi")
    star = lambda by: there.filter(F.col(by).isNotNull()).groupBy(by).agg(F.min("image_id").alias("a"))
    of_file, of_value = (there.join(star(by), by).select("a", F.col("image_id").alias("b")) for by in ("digest", "value"))
    across = links.join(star("value").select(F.col("value").alias("a"), F.col("a").alias("x")), "a").join(star("value").select(F.col("value").alias("b"), F.col("a").alias("y")), "b")
    formed = components(of_file.unionByName(of_value).unionByName(across.select(F.col("x").alias("a"), F.col("y").alias("b"))))
    rest = groups.join(again, "image_id", "left_anti")
    written(rest.unionByName(formed.select(F.col("id").alias("image_id"), "root")), "groups")


def wait_until(ready: Callable[[], bool], every: float = 2.0, timeout: float = 120.0) -> bool:
    """Ask `ready` now and then until it says yes; False once the time is over."""
    end = time.monotonic() + timeout
    while not ready():
        if time.monotonic() + every > end:
            return False
        time.sleep(every)
    return True

"""The Spark session, and tables in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_FOLDER: dict[str, str] = {}


def build_session(cpus: int = 8, **settings: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lumaframe")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; it goes when the driver's JVM ends.

    The setting is read from the session. Only where it is unset, as in tests on one machine, a temporary folder of
    this machine stands in for it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN_FOLDER:
            _OWN_FOLDER[app] = tempfile.mkdtemp(prefix="lumaframe-")
        base = _OWN_FOLDER[app]
    folder = f"{base.rstrip('/')}/lumaframe-{uuid.uuid4().hex}"
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def stage(df: DataFrame, folder: str, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write `df` as a table of the shared folder and read it again: the lineage ends here and survives lost executors."""
    spark, path = df.sparkSession, f"{folder}/{name}"
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unbounded(df: DataFrame) -> DataFrame:
    """`df` as a side of a join that is never broadcast. Spark judges a written table by the bytes of its files, and rows much
    alike take a hundred times that in the driver, which collects a broadcast side before it sends it."""
    return df.hint("merge")


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that nothing refers to any more.

    It only does so after a garbage collection of the driver, which a driver that merely plans may not need for hours.
    """
    gc.collect()
    spark._jvm.System.gc()


def drop_stage(spark: SparkSession, folder: str, name: str) -> None:
    """Delete a table of the shared folder that no later step reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

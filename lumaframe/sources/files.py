"""Files of a library: listing, planning conversions, and the index of packages."""

from __future__ import annotations

import hashlib
import io
import warnings
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumaframe.functions.media import extension, with_extension

HEIC = (".heic", ".heif")


def library_paths(config: DataFrame) -> DataFrame:
    """path: the roots in rows of `roots ARRAY<STRUCT<path>>`."""
    return config.select(F.explode("roots.path").alias("path")).filter("path <> ''").distinct()


def list_files(spark: SparkSession, roots: list[str], pattern: str = "*.[hH][eE][iI][cCfF]") -> DataFrame:
    """path, modified, size of the files below the roots that exist; no content is read. Overlapping roots count once."""
    conf, paths = spark._jsc.hadoopConfiguration(), []
    for root in roots:
        p = spark._jvm.org.apache.hadoop.fs.Path(root)
        if p.getFileSystem(conf).exists(p):
            paths.append(root)
        else:
            warnings.warn(f"no such folder: {root}", stacklevel=2)
    if not paths:
        return spark.createDataFrame([], "path string, modified timestamp, size bigint")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(paths)
    return read.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size")).distinct()


def with_extension_in(files: DataFrame, kinds: tuple[str, ...] = HEIC) -> DataFrame:
    return files.filter(extension(F.col("path")).isin(*kinds))


def conversion_plan(files: DataFrame, kinds: tuple[str, ...] = HEIC, new: str = ".jpg") -> DataFrame:
    """path, target, action (convert, skip), reason (null, exists, taken): every file of these kinds, once.

    A file is skipped if its target exists already, or an earlier path has the same target.
    """
    listed = files.select("path").filter("path <> ''").distinct()
    sources = with_extension_in(listed, kinds).withColumn("target", with_extension(F.col("path"), new))
    there = listed.select(F.col("path").alias("target"), F.lit(True).alias("there"))
    first = F.row_number().over(Window.partitionBy("target").orderBy("path"))
    rows = sources.join(there, "target", "left").withColumn("place", first)
    reason = F.when(F.col("there"), "exists").when(F.col("place") > 1, "taken")
    return rows.select("path", "target", F.when(reason.isNull(), "convert").otherwise("skip").alias("action"), reason.alias("reason"))


def conversion_counts(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count_if(F.col("action") == "convert").alias("converted"), F.count_if(F.col("action") == "skip").alias("skipped"), F.count("*").alias("total"))


def converted(plan: DataFrame, convert: Callable[[str, str], None], remove: Callable[[str], None]) -> DataFrame:
    """Carry a plan out on the executors: path, error (of the conversion), left (why the source could not be deleted).

    convert(path, target) writes the target or raises; what it left half written is for it to remove. remove(path) is called
    only after it returned. A plan that is run again skips what exists by then.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, target in zip(batch["path"], batch["target"]):
                error = left = None
                try:
                    convert(path, target)
                    try:
                        remove(path)
                    except Exception as e:  # noqa: BLE001 any tool, any file
                        left = f"{type(e).__name__}: {e}"[:200]
                except Exception as e:  # noqa: BLE001
                    error = f"{type(e).__name__}: {e}"[:200]
                rows.append((path, error, left))
            yield pd.DataFrame(rows, columns=["path", "error", "left"])

    return plan.filter("action = 'convert'").select("path", "target").mapInPandas(run, "path string, error string, left string")


def conversion_results(plan: DataFrame, done: DataFrame) -> DataFrame:
    """path, target, outcome, reason of each file of a plan, given what was done (path, error, left).

    converted: and its source deleted. failed: converted, but the source is still there. skipped: by the plan (exists, taken), or
    because the conversion failed (its error) or was never tried (not_run).
    """
    rows = plan.join(done.select("path", "error", "left", F.lit(True).alias("ran")), "path", "left")
    tried = (F.col("action") == "convert") & F.col("ran")
    outcome = F.when(tried & F.col("error").isNull() & F.col("left").isNull(), "converted").when(tried & F.col("error").isNull(), "failed").otherwise("skipped")
    reason = F.when(F.col("action") == "skip", F.col("reason")).when(F.col("ran").isNull(), "not_run").otherwise(F.coalesce("error", "left"))
    return rows.select("path", "target", outcome.alias("outcome"), reason.alias("reason"))


def conversion_actions(plan: DataFrame) -> DataFrame:
    """action, path in the order of what a run does: convert each file, delete its source, and scan once if any was converted."""
    convert = plan.filter("action = 'convert'")
    rows = convert.select(F.explode(F.array(F.struct(F.lit("convert").alias("action"), F.col("target").alias("path")), F.struct(F.lit("delete").alias("action"), F.col("path").alias("path")))).alias("a")).select("a.*")
    scan = convert.agg(F.count("*").alias("n")).filter("n > 0").select(F.lit("scan").alias("action"), F.lit(None).cast("string").alias("path"))
    return rows.unionByName(scan)


def outcome_counts(results: DataFrame) -> DataFrame:
    """One row: converted, skipped, failed, total."""
    of = lambda c: F.count_if(F.col("outcome") == c).alias(c)
    return results.agg(of("converted"), of("skipped"), of("failed"), F.count("*").alias("total"))


def chunked_digests(paths: DataFrame, chunk: int = 1 << 16, open_: Callable = open) -> DataFrame:
    """path, file_hash, file_size, error of files (path) that executors can open, read a chunk at a time: no file is held whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["path"]:
                seen, size = hashlib.sha256(), 0
                try:
                    with open_(path.removeprefix("file:"), "rb") as f:
                        while block := f.read(chunk):
                            seen.update(block)
                            size += len(block)
                    rows.append((path, seen.hexdigest(), size, None))
                except OSError as e:
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["path", "file_hash", "file_size", "error"]).astype({"file_size": "Int64"})

    return paths.select("path").mapInPandas(run, "path string, file_hash string, file_size bigint, error string")


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """path, id, folder, text of the manifests (*.yml) below the root."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.yml").load(root)
    return read.select("path", F.regexp_extract("path", r"([^/]+)\.yml$", 1).alias("id"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.decode("content", "UTF-8").alias("text"))


def packed(spark: SparkSession, root: str) -> DataFrame:
    """id, text, content, sha256 of the package of each manifest below the root: its folder as a zip archive.

    The archive is the same each time: names in order, no times. The files of one package meet in one task; it is a plugin's folder.
    """
    found = manifests(spark, root).select("id", "folder", "text")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
    of = files.join(found.select("id", "folder"), F.expr("startswith(path, folder || '/')"))

    def archive(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for path, folder, content in sorted(zip(rows["path"], rows["folder"], rows["content"]), key=lambda r: r[0]):
                z.writestr(zipfile.ZipInfo(path[len(folder) + 1 :]), content)
        return pd.DataFrame({"id": [key[0]], "content": [out.getvalue()]})

    zips = of.groupBy("id").applyInPandas(archive, "id string, content binary")
    return found.join(zips, "id").select("id", "text", "content", F.sha2("content", 256).alias("sha256"))


def setting(lines: DataFrame, name: str) -> DataFrame:
    """One row with the value of the first line (value) that begins with the name and a colon, without blanks and quotes; null if none does.

    `lines` comes from spark.read.text of a configuration; the file's own order decides.
    """
    rows = lines.filter(F.trim("value").startswith(f"{name}:")).select(F.monotonically_increasing_id().alias("at"), F.regexp_replace(F.trim(F.regexp_extract("value", ":(.*)$", 1)), "^[\"']|[\"']$", "").alias("value"))
    return rows.agg(F.min_by("value", "at").alias("value"))


def yaml_field(text: Column, name: str) -> Column:
    """The value of the first line that begins with the name and a colon, without carriage return and quotes around it."""
    raw = F.regexp_extract(text, rf"(?m)^{name}:[ \t]*(.*?)[ \t\r]*$", 1)
    return F.nullif(F.regexp_replace(raw, r"^[\"']|[\"']$", ""), F.lit(""))


def package_index(manifests: DataFrame) -> DataFrame:
    """id, name, description, version, sha256, requires: one row per manifest (id, text, revision, content).

    The version is that of the manifest, a dash and the revision; sha256 is that of the packed content; requires is the
    list behind the comment line that names it, empty if there is none.
    """
    text = F.col("text")
    requires = F.filter(F.transform(F.split(F.regexp_extract(text, r"(?m)^# requires:[ \t]*(.*?)[ \t\r]*$", 1), ","), lambda r: F.trim(r)), lambda r: r != "")
    return manifests.select(
        "id", yaml_field(text, "name").alias("name"), yaml_field(text, "description").alias("description"),
        F.concat_ws("-", yaml_field(text, "version"), "revision").alias("version"), F.sha2("content", 256).alias("sha256"), requires.alias("requires"),
    )

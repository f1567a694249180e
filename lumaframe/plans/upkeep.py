"""Queries over files, packages and events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaframe.functions import media as M
from lumaframe.functions.bits import month
from lumaframe.plans.library import _CUR, _DUP, DUPLICATES_SQL
from lumaframe.session import shared_folder
from lumaframe.operators.order import numbered
from lumaframe.sources.files import conversion_actions, conversion_counts, conversion_plan, conversion_results, library_paths, outcome_counts, package_index, with_extension_in
from lumaframe.sources.tables import table
from lumaframe.sources.tasks import log_line, parsed_tasks, progress_line, results
from lumaframe.streaming.hooks import event_groups, image_events, latest_events, streamed_groups, streamed_latest, windowed_counts


def _files(spark: SparkSession, d: str) -> DataFrame:
    """All files of the library, and beside every png of an even size a copy that was converted before."""
    rows = table(spark, d, "images").select(F.explode("visual_files").alias("f")).select("f.path", "f.size").filter("path IS NOT NULL")
    done = rows.filter((F.col("size") % 2 == 0) & (M.extension(F.col("path")) == ".png")).select(M.with_extension(F.col("path"), ".jpg").alias("path"))
    return rows.select("path").unionAll(done)


def _manifests(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    text = F.concat(
        F.lit('name: "'), F.col("p_name"), F.lit('"\r\ndescription: '), F.col("p_type"), F.lit(" of "), F.col("p_brand"), F.lit("\nversion: 1."), F.col("p_size"),
        F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("\n# requires: a"), F.col("p_size"), F.lit(", b"), F.col("p_size"))).otherwise(""), F.lit("\nexec:\n  - python\n"),
    )
    return p.select(F.col("p_partkey").alias("id"), text.alias("text"), F.substring(F.sha2("p_name", 256), 1, 7).alias("revision"), F.encode("p_name", "UTF-8").alias("content"))


def packages(spark: SparkSession, d: str) -> DataFrame:
    return package_index(_manifests(spark, d)).withColumn("requires", F.array_join("requires", ","))


def _documents_of_tasks(spark: SparkSession, d: str) -> DataFrame:
    """The JSON that a host would send for each event; every fifth is broken off."""
    rows = table(spark, d, "hook_events").select(F.trim("id").alias("id"), "hook_type").distinct()
    text = F.concat(F.lit('{"server_connection": {"Port": 9999}, "args": {"mode": "hook", "hookContext": {"type": "'), "hook_type", F.lit('", "id": '), F.col("id").cast("bigint"), F.lit("}}}"))
    broken = F.col("id").cast("bigint") % 5 == 0
    return rows.select(F.concat("hook_type", F.lit(" "), "id").alias("name"), F.when(broken, F.substr(text, F.lit(1), F.length(text) - 9)).otherwise(text).alias("text"))


def _done(plan: DataFrame) -> DataFrame:
    """What a run of the plan might report: some files break the tool, some can't be deleted, some were never tried."""
    n = F.length("path")
    broken = F.when(n % 7 == 0, "broken")
    return plan.filter(F.col("action") == "convert").filter(n % 17 != 0).select("path", broken.alias("error"), F.when(broken.isNull() & (n % 11 == 0), "denied").alias("left"))


def _results(spark: SparkSession, d: str) -> DataFrame:
    plan = conversion_plan(_files(spark, d), (".png",))
    return conversion_results(plan, _done(plan))


def _split_groups(spark: SparkSession, d: str) -> DataFrame:
    """The log of fingerprints in three files, so that versions of an image come in several batches, later ones first at times."""
    folder = shared_folder(spark)
    rows = table(spark, d, "fingerprints").withColumn("part", F.pmod(F.xxhash64("image_id", "created_at"), F.lit(3)).cast("int"))
    for i in range(3):
        rows.filter(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(f"{folder}/log")
    return streamed_groups(spark, f"{folder}/log", folder)


def _lines(spark: SparkSession, d: str) -> DataFrame:
    tasks = parsed_tasks(_documents_of_tasks(spark, d))
    level = F.when(F.col("error").isNull(), "i").otherwise("e")
    return tasks.select("name", log_line(level, F.coalesce("error", F.concat(F.lit("image "), "image_id"))).alias("line"), progress_line((F.length("name") - 19) / 8.0).alias("progress"))


def _roots(spark: SparkSession, d: str) -> DataFrame:
    """The library's folders out of a configuration of one row for each studio."""
    rows = table(spark, d, "images").select("studio.id", F.explode("visual_files.path").alias("path")).filter("path <> ''")
    config = rows.groupBy("id").agg(F.collect_set(F.struct(F.regexp_extract("path", "^(/[^/]+/[^/]+)/", 1).alias("path"))).alias("roots"))
    return library_paths(config)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "files_by_extension": lambda s, d: with_extension_in(_files(s, d).distinct(), (".png",)).select("path", M.base_name(F.col("path")).alias("base")),
    "conversion_plan": lambda s, d: conversion_plan(_files(s, d), (".png",)),
    "conversion_counts": lambda s, d: conversion_counts(conversion_plan(_files(s, d), (".png",))),
    "conversion_results": _results,
    "conversion_outcomes": lambda s, d: outcome_counts(_results(s, d)),
    "conversion_actions": lambda s, d: conversion_actions(conversion_plan(_files(s, d), (".png",))),
    "files_in_order": lambda s, d: numbered(_files(s, d).filter("path <> ''").distinct(), "path", "place"),
    "library_roots": _roots,
    "log_lines": _lines,
    "event_groups": lambda s, d: event_groups(s, f"{d}/hook_events.parquet", table(s, d, "fingerprints"), shared_folder(s)),
    "package_index": packages,
    "latest_image_events": lambda s, d: latest_events(image_events(table(s, d, "hook_events"))),
    "streamed_image_events": lambda s, d: streamed_latest(s, f"{d}/hook_events.parquet", shared_folder(s)),
    "streamed_groups": _split_groups,
    "task_requests": lambda s, d: parsed_tasks(_documents_of_tasks(s, d)).select("name", "mode", "hook_type", "image_id", "error"),
    "task_results": lambda s, d: results(parsed_tasks(_documents_of_tasks(s, d)).withColumn("output", F.concat_ws(" ", "mode", "image_id"))).select("name", "result"),
    "events_by_day": lambda s, d: windowed_counts(table(s, d, "hook_events")),
    "events_by_month": lambda s, d: image_events(table(s, d, "hook_events")).groupBy(month(F.col("ts")).alias("period"), "hook_type").agg(F.count("*").alias("n_events"), F.countDistinct("image_id").alias("n_images")),
}

EVENT_IMAGES = "WHERE image_id IN (SELECT try_cast(trim(id) AS BIGINT) FROM hook_events WHERE hook_type = 'Image.Create.Post')"

_FILES = """
v AS (SELECT f.path AS path, f.size AS size FROM (SELECT unnest(visual_files) AS f FROM images) WHERE f.path IS NOT NULL),
fl AS (SELECT DISTINCT path FROM (SELECT path FROM v UNION ALL SELECT regexp_replace(path, '\\.[^./]*$', '.jpg') FROM v WHERE size % 2 = 0 AND lower(path) LIKE '%.png') WHERE path <> ''),
pl AS (
  SELECT s.path, s.target, CASE WHEN t.path IS NOT NULL THEN 'exists' WHEN row_number() OVER (PARTITION BY s.target ORDER BY s.path) > 1 THEN 'taken' END AS reason
  FROM (SELECT path, regexp_replace(path, '\\.[^./]*$', '.jpg') AS target FROM fl WHERE lower(path) LIKE '%.png') s LEFT JOIN fl t ON t.path = s.target)"""

_LATEST = """
ev AS (SELECT hook_type, try_cast(trim(id) AS BIGINT) AS image_id, ts FROM hook_events WHERE contains(hook_type, 'Image')),
le AS (SELECT image_id, ts, hook_type FROM ev WHERE image_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY ts DESC, hook_type DESC) = 1)"""

_TASKS = """
ht AS (SELECT DISTINCT trim(id) AS id, hook_type FROM hook_events),
tk AS (
  SELECT hook_type || ' ' || id AS name, CASE WHEN CAST(id AS BIGINT) % 5 <> 0 THEN 'hook' END AS mode, CASE WHEN CAST(id AS BIGINT) % 5 <> 0 THEN hook_type END AS kind,
         CASE WHEN CAST(id AS BIGINT) % 5 <> 0 THEN CAST(id AS BIGINT) END AS image_id, CASE WHEN CAST(id AS BIGINT) % 5 = 0 THEN 'input is no JSON document' END AS error FROM ht)"""

_RESULTS = _FILES + """,
ac AS (SELECT path, target, reason, reason IS NULL AS go, length(path) AS k FROM pl),
rs AS (
  SELECT path, target, CASE WHEN go AND k % 17 <> 0 AND k % 7 <> 0 AND k % 11 <> 0 THEN 'converted' WHEN go AND k % 17 <> 0 AND k % 7 <> 0 THEN 'failed' ELSE 'skipped' END AS outcome,
         CASE WHEN NOT go THEN reason WHEN k % 17 = 0 THEN 'not_run' WHEN k % 7 = 0 THEN 'broken' WHEN k % 11 = 0 THEN 'denied' END AS reason FROM ac)"""

SQL: dict[str, str] = {
    "conversion_results": f"WITH {_RESULTS} SELECT * FROM rs",
    "conversion_outcomes": f"WITH {_RESULTS} SELECT count(*) FILTER (WHERE outcome = 'converted') AS converted, count(*) FILTER (WHERE outcome = 'skipped') AS skipped, count(*) FILTER (WHERE outcome = 'failed') AS failed, count(*) AS total FROM rs",
    "conversion_actions": f"WITH {_FILES} SELECT 'convert' AS action, target AS path FROM pl WHERE reason IS NULL UNION ALL SELECT 'delete', path FROM pl WHERE reason IS NULL UNION ALL SELECT 'scan', NULL WHERE EXISTS (SELECT 1 FROM pl WHERE reason IS NULL)",
    "files_in_order": f"WITH {_FILES} SELECT path, row_number() OVER (ORDER BY path) AS place FROM fl",
    "library_roots": "SELECT DISTINCT regexp_extract(path, '^(/[^/]+/[^/]+)/', 1) AS path FROM (SELECT f.path AS path FROM (SELECT unnest(visual_files) AS f FROM images)) WHERE path <> '' AND regexp_extract(path, '^(/[^/]+/[^/]+)/', 1) <> ''",
    "log_lines": f"WITH {_TASKS} SELECT name, chr(1) || CASE WHEN error IS NULL THEN 'i' ELSE 'e' END || chr(2) || coalesce(error, 'image ' || image_id) AS line, chr(1) || 'p' || chr(2) || CAST(greatest(0.0, least(1.0, (length(name) - 19) / 8.0)) AS VARCHAR) AS progress FROM tk",
    "event_groups": f"WITH RECURSIVE {_CUR.replace('WHERE image_id IS NOT NULL', EVENT_IMAGES)}, {_DUP} SELECT image_id, root FROM dup",
    "files_by_extension": f"WITH {_FILES} SELECT path, string_split(path, '/')[-1] AS base FROM fl WHERE lower(path) LIKE '%.png'",
    "conversion_plan": f"WITH {_FILES} SELECT path, target, CASE WHEN reason IS NULL THEN 'convert' ELSE 'skip' END AS action, reason FROM pl",
    "conversion_counts": f"WITH {_FILES} SELECT count(*) FILTER (WHERE reason IS NULL) AS converted, count(*) FILTER (WHERE reason IS NOT NULL) AS skipped, count(*) AS total FROM pl",
    "package_index": """SELECT p_partkey AS id, p_name AS name, p_type || ' of ' || p_brand AS description, '1.' || p_size || '-' || substr(sha256(p_name), 1, 7) AS version, sha256(p_name) AS sha256,
       CASE WHEN p_size % 3 = 0 THEN 'a' || p_size || ',b' || p_size ELSE '' END AS requires FROM part""",
    "latest_image_events": f"WITH {_LATEST} SELECT * FROM le",
    "streamed_image_events": f"WITH {_LATEST} SELECT * FROM le",
    "streamed_groups": DUPLICATES_SQL,
    "task_requests": f"WITH {_TASKS} SELECT name, mode, kind AS hook_type, image_id, error FROM tk",
    "task_results": f"""WITH {_TASKS} SELECT name, CASE WHEN error IS NULL THEN '{{"output":"hook ' || image_id || '"}}' ELSE '{{"error":"' || error || '"}}' END AS result FROM tk""",
    "events_by_day": "SELECT date_trunc('day', ts) AS starts, hook_type, count(*) AS n_events FROM hook_events GROUP BY 1, 2",
    "events_by_month": f"WITH {_LATEST} SELECT strftime(ts, '%Y-%m') AS period, hook_type, count(*) AS n_events, count(DISTINCT image_id) AS n_images FROM ev WHERE image_id IS NOT NULL GROUP BY 1, 2",
}

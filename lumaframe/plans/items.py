"""Queries over scenes and images as items: scans, the modes of a run over on-screen text, and events.

The tables hold neither scenes nor text nor a listing of files. A scene is written for each creation event of one, a text for
each frame and variant, and a listing in which some files are missing, alike in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaframe.functions import media as M
from lumaframe.functions.bits import id_number
from lumaframe.operators import items as I
from lumaframe.operators.votes import status_counts
from lumaframe.plans import texts as X
from lumaframe.session import shared_folder, stage
from lumaframe.sources.tables import table
from lumaframe.streaming.hooks import streamed_items

DONE, QUEUE = "2", "3"  # ids of the marker and the queue tag in the tables


def scenes(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "hook_events").filter("hook_type = 'Scene.Create.Post'")
    n = F.col("n")
    text = n.cast("string")
    file = F.struct(F.concat(F.lit("/library/scenes/"), text, F.lit(".mp4")).alias("path"), (n % 90).cast("double").alias("duration"))
    none = F.struct(F.lit(None).cast("string").alias("path"), F.lit(None).cast("double").alias("duration"))
    pair = lambda i, name: F.struct(F.lit(i).alias("id"), F.lit(name).alias("name"))
    tags = F.array(F.when(n % 4 == 0, pair(DONE, "Auto:OCR")), F.when(n % 5 == 0, pair(QUEUE, "ocr:queue")), F.when(n % 3 == 0, pair("7", "other")))
    return events.select(id_number(F.col("id")).alias("n")).dropna().distinct().select(
        text.alias("id"),
        F.when(n % 11 != 0, F.concat(F.lit("Scene "), text)).alias("title"),
        F.when(n % 7 == 0, "Extracted Username: @someone").when(n % 3 != 0, F.concat(F.lit("Old text "), text)).alias("details"),
        F.when(n % 10 == 0, F.array().cast("array<struct<path:string,duration:double>>")).when(n % 10 == 1, F.array(none, file)).otherwise(F.array(file)).alias("files"),
        F.when(n % 6 == 0, pair("9", "Studio 9")).alias("studio"),
        F.filter(tags, lambda t: t.isNotNull()).alias("tags"),
        F.when(n % 8 == 0, F.array(pair("12", "performer 12"))).alias("performers"),
    )


def items(spark: SparkSession, d: str) -> DataFrame:
    return I.scene_items(scenes(spark, d)).unionByName(_image_items(spark, d))


def _image_items(spark: SparkSession, d: str) -> DataFrame:
    images = table(spark, d, "images")
    return I.image_items(images.select(*images.columns[: images.columns.index("performers") + 1]), apart=True)  # the greatest row begins with the greatest of these


def _number(item: str = "item_id"):
    return F.regexp_extract(item, r"(\d+)$", 1).cast("bigint")


def listing(known: DataFrame) -> DataFrame:
    return known.filter((F.col("path") != "") & (_number() % 13 != 0)).select("path")


def texts(spark: SparkSession, d: str) -> DataFrame:
    """Four variants of each frame of a scene, and the texts of images."""
    frames = I.scene_items(scenes(spark, d)).select("item_id", _number().alias("n"), F.posexplode(M.sample_times(F.col("duration"))).alias("frame_no", "at"))
    variants = frames.select("item_id", "n", "frame_no", F.explode(F.array(*map(F.lit, range(4)))).alias("variant_no"))
    n, k = F.col("n").cast("string"), (F.col("n") + F.col("frame_no") + F.col("variant_no")) % 4
    text = (
        F.when(k == 0, F.concat(F.lit("ob TikTok\n@user_"), n))
        .when(k == 1, F.concat(F.lit("user_"), n, F.lit("  AO VIVO 5")))
        .when(k == 2, F.lit(" "))
        .otherwise(F.concat(F.lit("In diretta 4\nCamelName"), n))
    )
    of_images = X.ocr(spark, d).select(F.concat(F.lit("image:"), "item_id").alias("item_id"), "frame_no", "variant_no", "text")
    return variants.select("item_id", "frame_no", "variant_no", text.alias("text")).unionByName(of_images)


def _flat(rows: DataFrame) -> DataFrame:
    return rows.select("item_id", "status", "new_studio", "new_details", F.array_join("new_performers", ",").alias("new_performers"), F.array_join("new_tags", ",").alias("new_tags"))


def _run(spark: SparkSession, d: str, mode: str, wanted: DataFrame | None = None) -> DataFrame:
    known = items(spark, d)
    return I.outcomes(I.to_read(known, mode, wanted), listing(known), texts(spark, d), X.performers(spark, d), DONE, QUEUE if mode == "tagged" else None, mode == "scan")


def _images(spark: SparkSession, d: str) -> DataFrame:
    """Every image, whatever its tags."""
    known = items(spark, d)
    return I.outcomes(known.filter("item_type = 'image'"), listing(known), texts(spark, d), X.performers(spark, d), DONE, QUEUE)


def _first(spark: SparkSession, d: str) -> DataFrame:
    rows = items(spark, d).groupBy("item_type").agg(F.min(_number()).alias("n"))
    return rows.select(F.concat("item_type", F.lit(":"), "n").alias("item_id"))


def _hooked(spark: SparkSession, d: str) -> DataFrame:
    """Each creation event of a scene or an image has its item read, batch by batch."""
    folder = shared_folder(spark)
    known, texts_ = stage(items(spark, d), folder, "known"), stage(texts(spark, d), folder, "texts")
    listed, people = stage(listing(known), folder, "listed"), stage(X.performers(spark, d), folder, "performers")
    decide = lambda ids: I.outcomes(I.to_read(known, "hook", ids), listed, texts_, people, DONE)
    return _flat(streamed_items(spark, f"{d}/hook_events.parquet", decide, folder))


def lookup(spark: SparkSession, d: str) -> DataFrame:
    """Scenes named by destroy events, as the library has them, if it does."""
    wanted = table(spark, d, "hook_events").filter("hook_type = 'Scene.Destroy.Post'").select(id_number(F.col("id")).alias("scene_id")).dropna().distinct()
    found = I.library_scenes(scenes(spark, d)).select("scene_id", "title", F.lit(True).alias("found"))
    return wanted.join(found, "scene_id", "left").select("scene_id", "title", F.coalesce("found", F.lit(False)).alias("found"))


def united(spark: SparkSession, d: str) -> DataFrame:
    known = items(spark, d)
    rows = I.with_file(known, listing(known))
    state = F.when(F.col("n_files") == 0, "no_files").when(~F.col("there"), "file_missing").otherwise("there")
    return rows.groupBy("item_type", state.alias("state")).agg(F.count("*").alias("n_items"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scenes_by_tag": lambda s, d: I.library_scenes(scenes(s, d)).filter(M.has_tag(F.col("tags"), M.OCR_QUEUE_TAG)).select("scene_id", "title"),
    "unprocessed_scenes": lambda s, d: I.library_scenes(scenes(s, d)).filter(~M.has_tag(F.col("tags"), M.OCR_PROCESSED_TAG)).select("scene_id"),
    "unprocessed_ocr_images": lambda s, d: I.to_read(I.image_items(table(s, d, "images")), "extract").select("item_id"),
    "scene_lookup": lookup,
    "items_united": united,
    "ocr_extract": lambda s, d: _flat(_run(s, d, "extract")),
    "ocr_scan": lambda s, d: _flat(_run(s, d, "scan")),
    "ocr_tagged": lambda s, d: _flat(_run(s, d, "tagged")),
    "ocr_single": lambda s, d: _flat(_run(s, d, "single", _first(s, d))),
    "ocr_hook": _hooked,
    "item_decisions": lambda s, d: _flat(_images(s, d)),
    "status_counts": lambda s, d: status_counts(_images(s, d)),
    "ocr_counts": lambda s, d: status_counts(_run(s, d, "extract")),
    "ocr_queue_counts": lambda s, d: status_counts(_run(s, d, "tagged")),
    "top_votes": lambda s, d: I.top_votes(texts(s, d)),
}

_ITEMS = X.IMG + """,
sn AS (SELECT DISTINCT try_cast(trim(id) AS BIGINT) AS n FROM hook_events WHERE hook_type = 'Scene.Create.Post' AND try_cast(trim(id) AS BIGINT) IS NOT NULL),
im AS (
  SELECT 'scene' AS item_type, n, CASE WHEN n % 11 <> 0 THEN 'Scene ' || n END AS title, CASE n % 10 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS n_files,
         CASE WHEN n % 10 IN (0, 1) THEN '' ELSE '/library/scenes/' || n || '.mp4' END AS path,
         CASE WHEN n % 7 = 0 THEN 'Extracted Username: @someone' WHEN n % 3 <> 0 THEN 'Old text ' || n END AS details, CASE WHEN n % 6 = 0 THEN 'Studio 9' END AS studio_name,
         list_filter([CASE WHEN n % 4 = 0 THEN '2' END, CASE WHEN n % 5 = 0 THEN '3' END, CASE WHEN n % 3 = 0 THEN '7' END], lambda x: x IS NOT NULL) AS tag_ids,
         CASE WHEN n % 8 = 0 THEN ['12'] ELSE [] END AS have, n % 4 = 0 AS done, n % 5 = 0 AS queued FROM sn
  UNION ALL
  SELECT 'image', image_id, title, coalesce(len(visual_files), 0), coalesce(visual_files[1].path, ''), details, studio.name,
         list_distinct(list_filter(list_transform(coalesce(tags, []), lambda e: e.id), lambda i: i IS NOT NULL)),
         list_distinct(list_filter(list_transform(coalesce(performers, []), lambda e: e.id), lambda i: i IS NOT NULL)),
         len(list_filter(coalesce(tags, []), lambda t: lower(t.name) = 'auto:ocr')) > 0, len(list_filter(coalesce(tags, []), lambda t: lower(t.name) = 'ocr:queue')) > 0 FROM img),
ls AS (SELECT DISTINCT path FROM im WHERE path <> '' AND n % 13 <> 0),
itm AS (SELECT im.*, item_type || ':' || n AS item_id, ls.path IS NOT NULL AS there FROM im LEFT JOIN ls ON ls.path = im.path)"""

_TEXTS = X.IMAGE_TEXTS + """,
fr0 AS (SELECT n, CAST(n % 90 AS DOUBLE) AS duration, n % 10 IN (0, 1) AS bare FROM sn),
fr1 AS (SELECT n, unnest(range(CASE WHEN bare OR duration < 3 THEN 1 ELSE least(5, greatest(3, CAST(floor(duration / 2) AS INT))) END)) AS f FROM fr0),
fr2 AS (SELECT n, f, unnest(range(4)) AS v FROM fr1),
ocr AS (
  SELECT 'scene:' || n AS item_id, f * 4 + v AS variant_no, CASE (n + f + v) % 4 WHEN 0 THEN 'ob TikTok' || chr(10) || '@user_' || n WHEN 1 THEN 'user_' || n || '  AO VIVO 5' WHEN 2 THEN ' '
         ELSE 'In diretta 4' || chr(10) || 'CamelName' || n END AS text FROM fr2
  UNION ALL SELECT 'image:' || item_id, 0, text FROM o0 UNION ALL SELECT 'image:' || item_id, 1, h || chr(10) || text FROM o0)"""

_ALL = f"WITH {_ITEMS}, {_TEXTS}, src AS (SELECT * FROM ocr), {X.SCORES}, {X.CANDIDATES}, {X.VOTES}, {X.LINKS}"


def _outcome(where: str, queue: bool = False) -> str:
    tags = "list_distinct(list_append(i.tag_ids, '2'))"
    tags = f"list_filter({tags}, lambda x: x <> '3')" if queue else tags
    return f"""{_ALL},
sel AS (SELECT * FROM itm WHERE {where}),
fnd AS (
  SELECT i.item_id, list(lk.performer_id ORDER BY lk.performer_id) AS ids, string_agg(lk.name, ',' ORDER BY lk.performer_id) AS names
  FROM sel i JOIN wn ON wn.item_id = i.item_id JOIN lk ON lk.username = wn.username WHERE i.there AND NOT list_contains(i.have, lk.performer_id) GROUP BY i.item_id),
oc AS (
  SELECT i.item_id,
         CASE WHEN n_files = 0 THEN 'no_files' WHEN NOT there THEN 'file_missing'
              ELSE coalesce(nullif(concat_ws(', ', 'platform=' || platform, 'username=@' || username, 'performers=' || fnd.names), ''), 'nothing_detected') END AS status,
         CASE WHEN there AND coalesce(studio_name, '') = '' THEN platform END AS new_studio,
         CASE WHEN there AND username IS NOT NULL AND NOT contains(coalesce(details, ''), 'Extracted Username:')
              THEN 'Extracted Username: @' || username || CASE WHEN coalesce(details, '') = '' THEN '' ELSE chr(10) || chr(10) || details END END AS new_details,
         CASE WHEN there AND fnd.ids IS NOT NULL THEN array_to_string(list_sort(list_concat(i.have, fnd.ids)), ',') END AS new_performers,
         CASE WHEN there THEN array_to_string(list_sort({tags}), ',') END AS new_tags
  FROM sel i LEFT JOIN wn ON wn.item_id = i.item_id LEFT JOIN fnd ON fnd.item_id = i.item_id)"""


_COUNTS = """
SELECT count(*) FILTER (WHERE status NOT IN ('nothing_detected', 'no_files', 'file_missing')) AS detected, count(*) FILTER (WHERE status IN ('nothing_detected', 'no_files')) AS not_detected,
       count(*) FILTER (WHERE status = 'file_missing') AS errors, count(*) AS total FROM oc"""

SQL: dict[str, str] = {
    "scenes_by_tag": f"WITH {_ITEMS} SELECT n AS scene_id, title FROM itm WHERE item_type = 'scene' AND queued",
    "unprocessed_scenes": f"WITH {_ITEMS} SELECT n AS scene_id FROM itm WHERE item_type = 'scene' AND NOT done",
    "unprocessed_ocr_images": f"WITH {_ITEMS} SELECT item_id FROM itm WHERE item_type = 'image' AND NOT done",
    "scene_lookup": f"WITH {_ITEMS} SELECT w.n AS scene_id, s.title, s.n IS NOT NULL AS found FROM (SELECT DISTINCT try_cast(trim(id) AS BIGINT) AS n FROM hook_events WHERE hook_type = 'Scene.Destroy.Post') w LEFT JOIN (SELECT * FROM itm WHERE item_type = 'scene') s ON s.n = w.n WHERE w.n IS NOT NULL",
    "items_united": f"WITH {_ITEMS} SELECT item_type, CASE WHEN n_files = 0 THEN 'no_files' WHEN NOT there THEN 'file_missing' ELSE 'there' END AS state, count(*) AS n_items FROM itm GROUP BY 1, 2",
    "ocr_extract": _outcome("NOT done") + " SELECT * FROM oc",
    "ocr_scan": _outcome("NOT done") + " SELECT item_id, status, CAST(NULL AS VARCHAR) AS new_studio, CAST(NULL AS VARCHAR) AS new_details, CAST(NULL AS VARCHAR) AS new_performers, CAST(NULL AS VARCHAR) AS new_tags FROM oc",
    "ocr_tagged": _outcome("queued", True) + " SELECT * FROM oc",
    "ocr_single": _outcome("n IN (SELECT min(o.n) FROM itm o WHERE o.item_type = itm.item_type)") + " SELECT * FROM oc",
    "ocr_hook": _outcome("item_id IN (SELECT 'scene:' || n FROM sn UNION ALL SELECT 'image:' || try_cast(trim(id) AS BIGINT) FROM hook_events WHERE hook_type = 'Image.Create.Post')") + " SELECT * FROM oc",
    "item_decisions": _outcome("item_type = 'image'", True) + " SELECT * FROM oc",
    "status_counts": _outcome("item_type = 'image'", True) + _COUNTS,
    "ocr_counts": _outcome("NOT done") + _COUNTS,
    "ocr_queue_counts": _outcome("queued", True) + _COUNTS,
    "top_votes": f"{_ALL} SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, first) AS INT) AS place, username, score FROM vt QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, first) <= 5",
}

"""Queries over the image library: scans, projections, similarity, groups, resolving, upkeep of the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaframe.functions import media as M
from lumaframe.functions.bits import difference_hash, difference_hash_of, digest, hamming, id_number, unsigned_text
from lumaframe.operators import groups as G
from lumaframe.operators import resolve as R
from lumaframe.operators.current import current_fingerprints
from lumaframe.operators.similarity import exact_classes, hash_classes, matches_of, near_classes
from lumaframe.session import shared_folder, stage
from lumaframe.sources import store
from lumaframe.sources.tables import table, tables


def _images(spark: SparkSession, d: str) -> DataFrame:
    return R.library_images(table(spark, d, "images"))


def _joined(c: str):
    return F.array_join(c, ",").alias(c)


def projection(spark: SparkSession, d: str) -> DataFrame:
    size = M.first_dimensions(F.col("visual_files"))
    return _images(spark, d).select(
        "image_id", M.first_path(F.col("visual_files")).alias("path"), size["width"].alias("width"), size["height"].alias("height"), size["size"].alias("size"),
        F.array_join(M.ids_or_none(F.col("tags")), ",").alias("tag_ids"), F.array_join(M.ids_or_none(F.col("performers")), ",").alias("performer_ids"),
    )


def tag_patches(spark: SparkSession, d: str) -> DataFrame:
    own = M.ids_or_none(F.col("tags"))
    named = F.transform(F.filter(F.coalesce("tags", F.array().cast("array<struct<id:string,name:string>>")), lambda t: t["name"] != M.OCR_QUEUE_TAG), lambda t: t["id"])
    return _images(spark, d).select(
        "image_id", F.array_join(F.array_sort(F.array_union(own, F.array(F.lit("1")))), ",").alias("marked"), F.array_join(F.array_sort(F.array_distinct(named)), ",").alias("without_queue"),
        F.array_join(F.array_sort(F.array_except(F.array_union(own, F.array(F.lit("2"))), F.array(F.lit("3")))), ",").alias("swapped"),
    )


def requested(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "hook_events").filter(F.col("hook_type") == "Image.Create.Post").select(id_number(F.col("id")).alias("image_id")).dropna().distinct()
    found = _images(spark, d).select("image_id", "title", F.lit(True).alias("found"))
    return wanted.join(found, "image_id", "left").select("image_id", "title", F.coalesce("found", F.lit(False)).alias("found"))


def _split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The log before and from June on, each as one row per image: what is stored, and what comes in."""
    log = table(spark, d, "fingerprints")
    fields = ["file_hash", "dhash_full", "dhash_crop", "width", "height", "file_size"]
    at = F.lit("2024-06-01").cast("timestamp")
    cut = lambda rows: current_fingerprints(rows, *fields).select("image_id", *fields, "created_at")
    return cut(log.filter(F.col("created_at") < at)), cut(log.filter(F.col("created_at") >= at))


def upserted(spark: SparkSession, d: str) -> DataFrame:
    old, new = _split(spark, d)
    return store.upsert(old, new, "image_id").select("image_id", "dhash_full", "width", "created_at")


def ignored(spark: SparkSession, d: str) -> DataFrame:
    old, new = _split(spark, d)
    return store.insert_ignore(old, new, "image_id").select("image_id", "dhash_full", "width", "created_at")


def _classes(spark: SparkSession, d: str) -> DataFrame:
    return hash_classes(table(spark, d, "fingerprints"))


def _prints(spark: SparkSession, d: str) -> DataFrame:
    return current_fingerprints(table(spark, d, "fingerprints"), "digest", "dhash_full", "dhash_crop").select("image_id", "digest", F.col("dhash_full").alias("full"), F.col("dhash_crop").alias("crop"))


def probe_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = _prints(spark, d)
    return matches_of(rows.filter(F.col("image_id") % 50 == 0), rows).groupBy("query_id").agg(F.count("*").alias("n_matches"), F.min("distance").alias("nearest"))


def _duplicates(spark: SparkSession, d: str) -> DataFrame:
    return G.duplicate_groups(table(spark, d, "fingerprints"))


def report(spark: SparkSession, d: str) -> DataFrame:
    """What a dry run shows: the members of each group with their sizes."""
    sizes = current_fingerprints(table(spark, d, "fingerprints"), "width", "height", "file_size").select("image_id", "width", "height", "file_size")
    return _duplicates(spark, d).join(sizes, "image_id").select("root", "image_id", "width", "height", "file_size")


def actions(spark: SparkSession, d: str) -> DataFrame:
    rows = G.group_actions(_duplicates(spark, d), table(spark, d, "group_members"))
    return rows.select("root", "action", "group_id", "n_new", _joined("merged"))


def probe_actions(spark: SparkSession, d: str) -> DataFrame:
    rows = _prints(spark, d)
    grouped = rows.join(G.first_groups(table(spark, d, "group_members")), "image_id", "left")
    acts = G.grouped_actions(matches_of(rows.filter(F.col("image_id") % 50 == 0), grouped, carry=("group_id",)))
    return acts.select("query_id", "action", _joined("groups"), "n_matches")


def _open(spark: SparkSession, d: str) -> DataFrame:
    """The tables' images don't carry the tags of their groups, so none was taken from them; see tag_removals for those that do."""
    groups, members = tables(spark, d, "dup_groups", "group_members")
    return R.open_members(groups, members, _images(spark, d), honour_tag_removal=False)


def tag_removals(spark: SparkSession, d: str) -> DataFrame:
    """Keepers where every third image lost the tag of its group: it is neither kept nor deleted."""
    groups, members = tables(spark, d, "dup_groups", "group_members")
    named = members.dropna().distinct().join(groups.select("group_id", "tag_name"), "group_id").filter(F.col("image_id") % 3 != 0)
    own = named.groupBy("image_id").agg(F.collect_set(F.struct(F.lit("g").alias("id"), F.col("tag_name").alias("name"))).alias("more"))
    none = F.array().cast("array<struct<id:string,name:string>>")
    images = _images(spark, d).join(own, "image_id", "left").withColumn("tags", F.concat(F.coalesce("tags", none), F.coalesce("more", none))).drop("more")
    return R.keepers(R.open_members(groups, members, images))


def completed(spark: SparkSession, d: str) -> DataFrame:
    """Groups resolved by a run in which some images could not be deleted."""
    rows = R.resolve_plan(_open(spark, d))
    return store.completed_groups(rows, rows.filter("action = 'delete'").select("image_id", (F.col("image_id") % 17 != 0).alias("deleted")))


def applied(spark: SparkSession, d: str) -> DataFrame:
    groups, members = tables(spark, d, "dup_groups", "group_members")
    plan_ = R.resolve_plan(R.open_members(groups, members, _images(spark, d), honour_tag_removal=False))
    return R.updated_images(_images(spark, d), plan_).select("image_id", _joined("tag_ids"), _joined("performer_ids"), "rating100")


def lookups(spark: SparkSession, d: str) -> DataFrame:
    prints, members = tables(spark, d, "fingerprints", "group_members")
    keys = members.filter(F.col("image_id") % 50 == 0).select("image_id")
    return store.point_reads(keys, current_fingerprints(prints, "file_size"), members)


def tag_ids(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "images").select(F.explode("tags").alias("t")).select("t.id", "t.name")
    names = own.select(F.upper("name").alias("name")).unionAll(table(spark, d, "dup_groups").select(F.col("tag_name").alias("name")))
    return store.get_or_create(names, own.dropna().distinct(), 500)


def tag_deletes(spark: SparkSession, d: str) -> DataFrame:
    gone = _images(spark, d).select(F.explode("tags").alias("t")).filter("t.name IN ('vekhask', 'ocr:queue')").select("t.id").dropna()
    return store.without_tags(_images(spark, d), gone, "image_id").select("image_id", _joined("tag_ids"))


def _reconciled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    groups, members = tables(spark, d, "dup_groups", "group_members")
    return G.reconciled_groups(groups, stage(_duplicates(spark, d), shared_folder(spark), "components"), members)


def totals(spark: SparkSession, d: str) -> DataFrame:
    n = F.count("*")
    return current_fingerprints(table(spark, d, "fingerprints")).agg(n.alias("n_images"), (n.cast("decimal(19,0)") * (n - 1) / 2).cast("bigint").alias("n_pairs"))


def merged(spark: SparkSession, d: str) -> DataFrame:
    return R.merged_metadata(_open(spark, d)).select("group_id", _joined("performer_ids"), _joined("tag_ids"), _joined("gallery_ids"), "rating100")


def plan(spark: SparkSession, d: str) -> DataFrame:
    return R.resolve_plan(_open(spark, d)).select("group_id", "image_id", "action", *(F.array_join(c, ",").alias(c) for c in ("performer_ids", "tag_ids", "gallery_ids")), "rating100")


def galleries(spark: SparkSession, d: str) -> DataFrame:
    rows = _open(spark, d)
    return R.missing_galleries(rows, R.keepers(rows), R.merged_metadata(rows))


def _gone(spark: SparkSession, d: str) -> DataFrame:
    """Images with a fingerprint that the library lacks."""
    prints = table(spark, d, "fingerprints").select("image_id").dropna().distinct()
    return prints.join(_images(spark, d).select("image_id"), "image_id", "left_anti")


def cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Members left after the fingerprints without image are deleted, with the groups that then have less than two."""
    members = table(spark, d, "group_members").dropna().distinct()
    _, left = store.delete_cascading(table(spark, d, "fingerprints"), members, _gone(spark, d), "image_id")
    kept = left.groupBy("group_id").agg(F.count("*").alias("n")).filter("n >= 2").select("group_id")
    return left.join(kept, "group_id", "left_semi").select("group_id", "image_id")


def resolved(spark: SparkSession, d: str) -> DataFrame:
    groups = table(spark, d, "dup_groups")
    done = R.keepers(_open(spark, d)).select("group_id")
    return store.mark_resolved(groups, done).groupBy("resolved").agg(F.count("*").alias("n_groups"))


def hashes(spark: SparkSession, d: str) -> DataFrame:
    rows = current_fingerprints(table(spark, d, "fingerprints"), "digest", "dhash_full", "dhash_crop")
    return rows.select("image_id", F.lower(F.hex("digest")).alias("digest"), unsigned_text(F.col("dhash_full")).alias("unsigned_full"), hamming(F.col("dhash_full"), F.col("dhash_crop")).cast("int").alias("full_crop"))


def raster_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Difference hashes of rasters made of the digests of a text; any 72 bytes are a raster."""
    text = F.col("text")
    px = F.unhex(F.concat(*(F.sha2(F.concat(text, F.lit(str(i))), 256) for i in range(3))))
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.sha2(text, 256).alias("file_hash"), difference_hash(px).alias("dhash"))


def vector_hashes(spark: SparkSession, d: str) -> DataFrame:
    grid = F.concat(F.col("embedding"), F.slice("embedding", 1, 8))
    return table(spark, d, "embeddings").select("vec_id", difference_hash_of(grid).alias("dhash"))


def studios(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "images").select(F.upper("studio.name").alias("name")).unionAll(table(spark, d, "part").select(F.col("p_brand").alias("name")))
    known = table(spark, d, "images").select("studio.id", "studio.name").dropna().distinct()
    return store.get_or_create(names, known, 100_000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "unprocessed_images": lambda s, d: _images(s, d).filter(~M.has_tag(F.col("tags"), M.PROCESSED_TAG)).select("image_id"),
    "images_by_tag": lambda s, d: _images(s, d).filter(M.has_tag(F.col("tags"), M.OCR_QUEUE_TAG)).select("image_id", "title"),
    "image_lookup": requested,
    "image_page": lambda s, d: _images(s, d).select("image_id", "title").orderBy("image_id").offset(100).limit(100),
    "image_projection": projection,
    "tag_patches": tag_patches,
    "current_fingerprints": lambda s, d: current_fingerprints(table(s, d, "fingerprints"), "digest", "dhash_full", "width").select("image_id", F.lower(F.hex("digest")).alias("digest"), "dhash_full", "width", "created_at"),
    "fingerprint_upsert": upserted,
    "fingerprint_insert_ignore": ignored,
    "hash_views": hashes,
    "raster_hashes": raster_hashes,
    "vector_hashes": vector_hashes,
    "exact_classes": lambda s, d: exact_classes(table(s, d, "fingerprints")),
    "hash_classes": lambda s, d: _classes(s, d).select("class_id", "full", "crop", "n_images"),
    "near_classes": lambda s, d: near_classes(_classes(s, d), 10),
    "near_classes_banded": lambda s, d: near_classes(_classes(s, d), 4),
    "pair_counts": lambda s, d: near_classes(_classes(s, d), 10).groupBy("distance").agg(F.count("*").alias("n_pairs")),
    "probe_matches": probe_counts,
    "probe_actions": probe_actions,
    "duplicate_groups": _duplicates,
    "duplicate_group_names": lambda s, d: G.named_groups(_duplicates(s, d)),
    "duplicate_report": report,
    "group_actions": actions,
    "next_group_id": lambda s, d: store.next_group_id(table(s, d, "dup_groups")),
    "group_size_classes": lambda s, d: G.size_classes(*tables(s, d, "dup_groups", "group_members")),
    "keepers": lambda s, d: R.keepers(_open(s, d)),
    "merged_metadata": merged,
    "missing_galleries": galleries,
    "resolve_plan": plan,
    "resolve_preview": lambda s, d: R.resolve_preview(_open(s, d)),
    "resolve_counts": lambda s, d: R.resolve_counts(R.resolve_plan(_open(s, d))),
    "resolved_flags": resolved,
    "tag_removals": tag_removals,
    "completed_groups": completed,
    "images_after_resolve": applied,
    "gallery_members": lambda s, d: R.gallery_members(_images(s, d), galleries(s, d)),
    "fingerprint_lookup": lookups,
    "tag_ids": tag_ids,
    "tag_deletes": tag_deletes,
    "reconciled_groups": lambda s, d: _reconciled(s, d)[0],
    "reconciled_members": lambda s, d: _reconciled(s, d)[1],
    "cleanup_counts": lambda s, d: G.cleanup_counts(table(s, d, "dup_groups"), table(s, d, "group_members").dropna().distinct(), _gone(s, d)),
    "pair_totals": totals,
    "orphan_fingerprints": _gone,
    "cleanup": cleaned,
    "studio_ids": studios,
}

_IMG = """
img AS (
  SELECT try_cast(trim(id) AS BIGINT) AS image_id, title, details, rating100, visual_files, studio, tags, performers, galleries FROM images
  QUALIFY row_number() OVER (PARTITION BY try_cast(trim(id) AS BIGINT) ORDER BY title DESC NULLS LAST, details DESC NULLS LAST, rating100 DESC NULLS LAST) = 1)"""

_IDS = "array_to_string(list_sort(list_distinct(list_filter(list_transform(coalesce({c}, []), lambda e: e.id), lambda i: i IS NOT NULL))), ',')"

_CUR = """
cur AS (
  SELECT image_id, right(lower(trim(file_hash)), 64) AS digest, dhash_full AS f, dhash_crop AS c, width, height, file_size, created_at
  FROM (SELECT DISTINCT * FROM fingerprints WHERE image_id IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY created_at DESC) = 1),
cls AS (SELECT min(image_id) AS class_id, digest, f, c, count(*) AS n_images FROM cur GROUP BY digest, f, c)"""

_NEAR = """
near AS (
  SELECT a.class_id AS class_a, b.class_id AS class_b,
         CAST(least(bit_count(xor(a.f, b.f)), bit_count(xor(a.c, b.c)), bit_count(xor(a.f, b.c)), bit_count(xor(a.c, b.f))) AS INT) AS distance
  FROM cls a JOIN cls b ON a.class_id < b.class_id
  WHERE least(bit_count(xor(a.f, b.f)), bit_count(xor(a.c, b.c)), bit_count(xor(a.f, b.c)), bit_count(xor(a.c, b.f))) <= {t})"""

_DUP = _NEAR.format(t=10) + """,
exact AS (SELECT image_id, min(image_id) OVER (PARTITION BY digest) AS class_id FROM cur),
e0 AS (SELECT class_a AS a, class_b AS b FROM near UNION SELECT class_id, image_id FROM exact WHERE class_id <> image_id),
e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0),
reach AS (SELECT a AS v, a AS root FROM e UNION SELECT e.b, r.root FROM reach r JOIN e ON e.a = r.v WHERE r.root < e.b),
dup AS (SELECT v AS image_id, min(root) AS root FROM reach GROUP BY v)"""

_PROBE = """
hit AS (
  SELECT q.image_id AS query_id, x.image_id,
         CAST(least(bit_count(xor(q.f, x.f)), bit_count(xor(q.c, x.c)), bit_count(xor(q.f, x.c)), bit_count(xor(q.c, x.f))) AS INT) AS distance, q.digest = x.digest AS same
  FROM cur q JOIN cur x ON q.image_id <> x.image_id WHERE q.image_id % 50 = 0),
m AS (SELECT * FROM hit WHERE same OR distance <= 10)"""

DUPLICATES_SQL = f"WITH RECURSIVE {_CUR}, {_DUP} SELECT image_id, root FROM dup"

_OPEN = _IMG + """,
o AS (
  SELECT g.group_id, i.* FROM (SELECT DISTINCT group_id, image_id FROM group_members WHERE group_id IS NOT NULL AND image_id IS NOT NULL) m
  JOIN dup_groups g ON g.group_id = m.group_id AND coalesce(g.resolved, 0) = 0 JOIN img i ON i.image_id = m.image_id),
sz AS (SELECT *, list_filter(coalesce(visual_files, []), lambda x: coalesce(x.width, 0) <> 0 AND coalesce(x.height, 0) <> 0)[1] AS s FROM o),
kp AS (
  SELECT group_id, image_id AS keeper_id, n_images FROM (
    SELECT group_id, image_id, count(*) OVER (PARTITION BY group_id) AS n_images,
           row_number() OVER (PARTITION BY group_id ORDER BY coalesce(CAST(s.width AS HUGEINT) * s.height, 0) DESC, coalesce(s.size, 0) DESC, image_id) AS rn FROM sz)
  WHERE rn = 1 AND n_images >= 2),
per AS (SELECT DISTINCT group_id, e.id AS id FROM (SELECT group_id, unnest(performers) AS e FROM o) WHERE e.id IS NOT NULL),
tg AS (
  SELECT DISTINCT group_id, e.id AS id FROM (SELECT group_id, unnest(tags) AS e FROM o)
  WHERE e.id IS NOT NULL AND NOT coalesce(starts_with(e.name, 'dedup:group:') OR e.name = 'auto:dedup', false)
  UNION SELECT DISTINCT group_id, '1' FROM o),
gl AS (SELECT DISTINCT group_id, e.id AS id FROM (SELECT group_id, unnest(galleries) AS e FROM o) WHERE e.id IS NOT NULL),
mg AS (
  SELECT r.group_id, coalesce(p.x, '') AS performer_ids, coalesce(t.x, '') AS tag_ids, coalesce(g.x, '') AS gallery_ids, nullif(r.x, 0) AS rating100
  FROM (SELECT group_id, max(coalesce(rating100, 0)) AS x FROM o GROUP BY group_id) r
  LEFT JOIN (SELECT group_id, string_agg(id, ',' ORDER BY id) AS x FROM per GROUP BY group_id) p ON p.group_id = r.group_id
  LEFT JOIN (SELECT group_id, string_agg(id, ',' ORDER BY id) AS x FROM tg GROUP BY group_id) t ON t.group_id = r.group_id
  LEFT JOIN (SELECT group_id, string_agg(id, ',' ORDER BY id) AS x FROM gl GROUP BY group_id) g ON g.group_id = r.group_id),
pl AS (
  SELECT o.group_id, o.image_id, CASE WHEN o.image_id = k.keeper_id THEN 'keep' ELSE 'delete' END AS action,
         CASE WHEN o.image_id = k.keeper_id THEN m.performer_ids END AS performer_ids, CASE WHEN o.image_id = k.keeper_id THEN m.tag_ids END AS tag_ids,
         CASE WHEN o.image_id = k.keeper_id THEN m.gallery_ids END AS gallery_ids, CASE WHEN o.image_id = k.keeper_id THEN m.rating100 END AS rating100
  FROM o JOIN kp k ON k.group_id = o.group_id JOIN mg m ON m.group_id = o.group_id)"""

_HALVES = """
a AS (SELECT image_id, dhash_full, width, created_at FROM (SELECT DISTINCT * FROM fingerprints WHERE created_at < TIMESTAMP '2024-06-01') QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY created_at DESC) = 1),
b AS (SELECT image_id, dhash_full, width, created_at FROM (SELECT DISTINCT * FROM fingerprints WHERE created_at >= TIMESTAMP '2024-06-01') QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY created_at DESC) = 1)"""


def _tagged(name: str) -> str:
    return f"len(list_filter(coalesce(tags, []), lambda t: lower(t.name) = '{name}')) > 0"


_BITS = "CAST(sum(CASE WHEN {left} > {right} THEN CASE WHEN k = 63 THEN -9223372036854775808 ELSE CAST(1 AS BIGINT) << k END ELSE 0 END) AS BIGINT)"
_AT = "((k // 8) * 9 + k % 8)"

_RECONCILED = f"""WITH RECURSIVE {_CUR}, {_DUP},
held AS (SELECT DISTINCT group_id, image_id FROM group_members WHERE image_id IS NOT NULL AND group_id IS NOT NULL),
s AS (SELECT root, min(group_id) AS group_id, count(*) FILTER (WHERE group_id IS NULL) AS n_new, list_sort(list(DISTINCT group_id) FILTER (WHERE group_id IS NOT NULL)) AS touched FROM dup LEFT JOIN held USING (image_id) GROUP BY root),
a AS (SELECT *, coalesce(len(touched), 0) AS k FROM s WHERE coalesce(len(touched), 0) <> 1 OR n_new > 0),
mv AS (SELECT group_id AS dst, unnest(touched[2:]) AS src FROM a WHERE k > 1),
cr AS (SELECT root, (SELECT coalesce(max(group_id), 0) FROM dup_groups) + row_number() OVER (ORDER BY root) AS made FROM a WHERE k = 0)"""

SQL: dict[str, str] = {
    "reconciled_groups": _RECONCILED + """,
g AS (SELECT group_id, min(tag_name) AS tag_name, max(coalesce(resolved, 0)) AS resolved FROM dup_groups GROUP BY group_id)
SELECT group_id, tag_name, CASE WHEN group_id IN (SELECT group_id FROM a WHERE k > 0) THEN 0 ELSE resolved END AS resolved,
       CASE WHEN group_id IN (SELECT src FROM mv) THEN 'deleted' WHEN group_id IN (SELECT group_id FROM a WHERE k > 1) THEN 'merged' WHEN group_id IN (SELECT group_id FROM a WHERE k = 1) THEN 'extended' ELSE 'kept' END AS state FROM g
UNION ALL SELECT made, 'dedup:group:' || CASE WHEN made < 10000 THEN lpad(CAST(made AS VARCHAR), 4, '0') ELSE CAST(made AS VARCHAR) END, 0, 'created' FROM cr""",
    "reconciled_members": _RECONCILED + """
SELECT coalesce(mv.dst, held.group_id) AS group_id, image_id FROM held LEFT JOIN mv ON mv.src = held.group_id
UNION SELECT coalesce(cr.made, a.group_id), image_id FROM dup JOIN a USING (root) LEFT JOIN cr USING (root)""",
    "tag_removals": f"WITH {_OPEN.replace('ON i.image_id = m.image_id)', 'ON i.image_id = m.image_id WHERE i.image_id % 3 <> 0)')} SELECT * FROM kp",
    "completed_groups": f"WITH {_OPEN} SELECT group_id FROM pl GROUP BY group_id HAVING count(*) FILTER (WHERE action = 'delete' AND image_id % 17 = 0) = 0",
    "images_after_resolve": f"""WITH {_OPEN},
k AS (SELECT image_id, max_by(tag_ids, group_id) AS tag_ids, max_by(performer_ids, group_id) AS performer_ids, max_by(rating100, group_id) AS rating100 FROM pl WHERE action = 'keep' GROUP BY image_id)
SELECT img.image_id, coalesce(k.tag_ids, {_IDS.format(c='tags')}) AS tag_ids, coalesce(k.performer_ids, {_IDS.format(c='performers')}) AS performer_ids, coalesce(k.rating100, img.rating100) AS rating100
FROM img LEFT JOIN k ON k.image_id = img.image_id WHERE img.image_id NOT IN (SELECT image_id FROM pl WHERE action = 'delete')""",
    "gallery_members": f"""WITH {_OPEN}, miss AS (SELECT k.keeper_id, gl.id AS gallery_id FROM kp k JOIN gl ON gl.group_id = k.group_id)
SELECT e.id AS gallery_id, image_id FROM (SELECT image_id, unnest(galleries) AS e FROM img) WHERE e.id IS NOT NULL UNION SELECT gallery_id, keeper_id FROM miss""",
    "fingerprint_lookup": f"""WITH {_CUR}, w AS (SELECT image_id, min(group_id) AS group_id FROM group_members WHERE image_id % 50 = 0 GROUP BY image_id)
SELECT w.image_id, c.image_id IS NOT NULL AS known, c.file_size, c.created_at, w.group_id FROM w LEFT JOIN cur c ON c.image_id = w.image_id""",
    "tag_ids": """WITH t AS (SELECT e.id AS id, e.name AS name FROM (SELECT unnest(tags) AS e FROM images)),
n AS (SELECT DISTINCT name, lower(name) AS low FROM (SELECT upper(name) AS name FROM t UNION ALL SELECT tag_name FROM dup_groups) WHERE name IS NOT NULL),
k AS (SELECT lower(name) AS low, min(id) AS id FROM t WHERE name IS NOT NULL AND id IS NOT NULL GROUP BY 1),
f AS (SELECT low, CAST(row_number() OVER (ORDER BY low) + 499 AS VARCHAR) AS new_id FROM (SELECT DISTINCT low FROM n WHERE low NOT IN (SELECT low FROM k)))
SELECT n.name, coalesce(k.id, f.new_id) AS id, k.id IS NULL AS made FROM n LEFT JOIN k ON k.low = n.low LEFT JOIN f ON f.low = n.low""",
    "tag_deletes": f"""WITH {_IMG}, p AS (SELECT DISTINCT image_id, e.id AS id, e.name AS name FROM (SELECT image_id, unnest(tags) AS e FROM img) WHERE e.id IS NOT NULL),
g AS (SELECT DISTINCT id FROM p WHERE name IN ('vekhask', 'ocr:queue'))
SELECT image_id, coalesce(string_agg(DISTINCT id, ',' ORDER BY id) FILTER (WHERE id NOT IN (SELECT id FROM g)), '') AS tag_ids FROM p GROUP BY image_id HAVING count(*) FILTER (WHERE id IN (SELECT id FROM g)) > 0""",
    "cleanup_counts": f"""WITH {_IMG}, gone AS (SELECT DISTINCT image_id FROM fingerprints WHERE image_id IS NOT NULL AND image_id NOT IN (SELECT image_id FROM img)),
z AS (SELECT g.group_id, count(DISTINCT m.image_id) AS n FROM dup_groups g LEFT JOIN (SELECT * FROM group_members WHERE image_id NOT IN (SELECT image_id FROM gone)) m ON m.group_id = g.group_id GROUP BY g.group_id)
SELECT (SELECT count(*) FROM gone) AS orphaned, count(*) FILTER (WHERE n = 0) AS empty, count(*) FILTER (WHERE n = 1) AS single FROM z""",
    "pair_totals": "SELECT count(*) AS n_images, CAST(count(*) * (count(*) - 1) // 2 AS BIGINT) AS n_pairs FROM (SELECT DISTINCT image_id FROM fingerprints WHERE image_id IS NOT NULL)",
    "unprocessed_images": f"WITH {_IMG} SELECT image_id FROM img WHERE NOT {_tagged('auto:dedup')}",
    "images_by_tag": f"WITH {_IMG} SELECT image_id, title FROM img WHERE {_tagged('ocr:queue')}",
    "image_lookup": f"WITH {_IMG} SELECT e.image_id, i.title, i.image_id IS NOT NULL AS found FROM (SELECT DISTINCT try_cast(trim(id) AS BIGINT) AS image_id FROM hook_events WHERE hook_type = 'Image.Create.Post') e LEFT JOIN img i ON i.image_id = e.image_id WHERE e.image_id IS NOT NULL",
    "image_page": f"WITH {_IMG} SELECT image_id, title FROM img ORDER BY image_id LIMIT 100 OFFSET 100",
    "image_projection": f"""WITH {_IMG}, x AS (SELECT *, list_filter(coalesce(visual_files, []), lambda f: coalesce(f.width, 0) <> 0 AND coalesce(f.height, 0) <> 0)[1] AS s FROM img)
SELECT image_id, list_filter(coalesce(visual_files, []), lambda f: coalesce(f.path, '') <> '')[1].path AS path, coalesce(s.width, 0) AS width, coalesce(s.height, 0) AS height, coalesce(s.size, 0) AS size,
       {_IDS.format(c='tags')} AS tag_ids, {_IDS.format(c='performers')} AS performer_ids FROM x""",
    "tag_patches": f"""WITH {_IMG}, x AS (SELECT image_id, tags, list_filter(list_transform(coalesce(tags, []), lambda e: e.id), lambda i: i IS NOT NULL) AS own FROM img)
SELECT image_id, array_to_string(list_sort(list_distinct(list_append(own, '1'))), ',') AS marked,
       array_to_string(list_sort(list_distinct(list_transform(list_filter(coalesce(tags, []), lambda t: t.name <> 'ocr:queue'), lambda t: t.id))), ',') AS without_queue,
       array_to_string(list_sort(list_filter(list_distinct(list_append(own, '2')), lambda i: i <> '3')), ',') AS swapped FROM x""",
    "current_fingerprints": f"WITH {_CUR} SELECT image_id, digest, f AS dhash_full, width, created_at FROM cur",
    "fingerprint_upsert": f"WITH {_HALVES} SELECT * FROM b UNION ALL SELECT * FROM a WHERE image_id NOT IN (SELECT image_id FROM b)",
    "fingerprint_insert_ignore": f"WITH {_HALVES} SELECT * FROM a UNION ALL SELECT * FROM b WHERE image_id NOT IN (SELECT image_id FROM a)",
    "hash_views": f"WITH {_CUR} SELECT image_id, digest, CAST(CASE WHEN f < 0 THEN CAST(f AS HUGEINT) + 18446744073709551616 ELSE CAST(f AS HUGEINT) END AS VARCHAR) AS unsigned_full, CAST(bit_count(xor(f, c)) AS INT) AS full_crop FROM cur",
    "raster_hashes": f"""WITH x AS (SELECT doc_id, text, concat(sha256(text || '0'), sha256(text || '1'), sha256(text || '2')) AS h FROM documents WHERE text IS NOT NULL)
SELECT doc_id, sha256(any_value(text)) AS file_hash, {_BITS.format(left=f'substr(h, {_AT} * 2 + 1, 2)', right=f'substr(h, {_AT} * 2 + 3, 2)')} AS dhash
FROM x CROSS JOIN (SELECT CAST(unnest(range(64)) AS INT) AS k) GROUP BY doc_id, h""",
    "vector_hashes": f"""WITH x AS (SELECT vec_id, list_concat(embedding, embedding[1:8]) AS g FROM embeddings)
SELECT vec_id, {_BITS.format(left=f'g[{_AT} + 1]', right=f'g[{_AT} + 2]')} AS dhash FROM x CROSS JOIN (SELECT CAST(unnest(range(64)) AS INT) AS k) GROUP BY vec_id""",
    "exact_classes": f"WITH {_CUR} SELECT image_id, min(image_id) OVER (PARTITION BY digest) AS class_id, count(*) OVER (PARTITION BY digest) AS n_images FROM cur",
    "hash_classes": f'WITH {_CUR} SELECT class_id, f AS "full", c AS "crop", n_images FROM cls',
    "near_classes": f"WITH {_CUR}, {_NEAR.format(t=10)} SELECT class_a, class_b, distance FROM near",
    "near_classes_banded": f"WITH {_CUR}, {_NEAR.format(t=4)} SELECT class_a, class_b, distance FROM near",
    "pair_counts": f"WITH {_CUR}, {_NEAR.format(t=10)} SELECT distance, count(*) AS n_pairs FROM near GROUP BY distance",
    "probe_matches": f"WITH {_CUR}, {_PROBE} SELECT query_id, count(*) AS n_matches, min(distance) AS nearest FROM m GROUP BY query_id",
    "probe_actions": f"""WITH {_CUR}, {_PROBE},
held AS (SELECT image_id, min(group_id) AS group_id FROM group_members WHERE image_id IS NOT NULL AND group_id IS NOT NULL GROUP BY image_id)
SELECT query_id, CASE count(DISTINCT group_id) WHEN 0 THEN 'new' WHEN 1 THEN 'existing' ELSE 'merge' END AS action,
       coalesce(array_to_string(list_sort(list(DISTINCT group_id) FILTER (WHERE group_id IS NOT NULL)), ','), '') AS groups, count(*) AS n_matches
FROM m LEFT JOIN held USING (image_id) GROUP BY query_id""",
    "duplicate_groups": DUPLICATES_SQL,
    "duplicate_group_names": f"""WITH RECURSIVE {_CUR}, {_DUP}, n AS (SELECT root, count(*) AS n_images, row_number() OVER (ORDER BY root) AS group_id FROM dup GROUP BY root HAVING count(*) >= 2)
SELECT root, n_images, group_id, 'dedup:group:' || CASE WHEN group_id < 10000 THEN lpad(CAST(group_id AS VARCHAR), 4, '0') ELSE CAST(group_id AS VARCHAR) END AS tag_name FROM n""",
    "duplicate_report": f"WITH RECURSIVE {_CUR}, {_DUP} SELECT root, image_id, width, height, file_size FROM dup JOIN cur USING (image_id)",
    "group_actions": f"""WITH RECURSIVE {_CUR}, {_DUP},
held AS (SELECT DISTINCT group_id, image_id FROM group_members WHERE image_id IS NOT NULL AND group_id IS NOT NULL),
s AS (SELECT root, min(group_id) AS group_id, count(*) FILTER (WHERE group_id IS NULL) AS n_new, list_sort(list(DISTINCT group_id) FILTER (WHERE group_id IS NOT NULL)) AS touched FROM dup LEFT JOIN held USING (image_id) GROUP BY root)
SELECT root, CASE coalesce(len(touched), 0) WHEN 0 THEN 'create' WHEN 1 THEN 'extend' ELSE 'merge' END AS action, group_id, n_new, coalesce(array_to_string(touched[2:], ','), '') AS merged
FROM s WHERE coalesce(len(touched), 0) <> 1 OR n_new > 0""",
    "next_group_id": "SELECT coalesce(max(group_id), 0) + 1 AS next_id FROM dup_groups",
    "group_size_classes": """SELECT CASE n WHEN 0 THEN 'empty' WHEN 1 THEN 'single' ELSE 'several' END AS size_class, count(*) AS n_groups
FROM (SELECT g.group_id, count(DISTINCT m.image_id) AS n FROM dup_groups g LEFT JOIN group_members m ON m.group_id = g.group_id GROUP BY g.group_id) GROUP BY 1""",
    "keepers": f"WITH {_OPEN} SELECT * FROM kp",
    "merged_metadata": f"WITH {_OPEN} SELECT * FROM mg",
    "missing_galleries": f"WITH {_OPEN} SELECT k.group_id, k.keeper_id, gl.id AS gallery_id FROM kp k JOIN gl ON gl.group_id = k.group_id JOIN o ON o.group_id = k.group_id AND o.image_id = k.keeper_id WHERE len(list_filter(coalesce(o.galleries, []), lambda e: e.id = gl.id)) = 0",
    "resolve_plan": f"WITH {_OPEN} SELECT * FROM pl",
    "resolve_counts": f"WITH {_OPEN} SELECT count(DISTINCT group_id) AS groups, count(*) FILTER (WHERE action = 'keep') AS kept, count(*) FILTER (WHERE action = 'delete') AS deleted FROM pl",
    "resolve_preview": f"""WITH {_OPEN}
SELECT k.group_id, k.keeper_id, k.n_images, coalesce(p.x, '') AS performers, coalesce(t.x, '') AS tags FROM kp k
LEFT JOIN (SELECT group_id, string_agg(DISTINCT e.name, ', ' ORDER BY e.name) AS x FROM (SELECT group_id, unnest(performers) AS e FROM o) GROUP BY group_id) p ON p.group_id = k.group_id
LEFT JOIN (SELECT group_id, string_agg(DISTINCT e.name, ', ' ORDER BY e.name) AS x FROM (SELECT group_id, unnest(tags) AS e FROM o) WHERE NOT (starts_with(e.name, 'dedup:group:') OR e.name = 'auto:dedup') GROUP BY group_id) t ON t.group_id = k.group_id""",
    "resolved_flags": f"WITH {_OPEN} SELECT CASE WHEN group_id IN (SELECT group_id FROM kp) THEN 1 ELSE resolved END AS resolved, count(*) AS n_groups FROM dup_groups GROUP BY 1",
    "orphan_fingerprints": f"WITH {_IMG} SELECT DISTINCT image_id FROM fingerprints WHERE image_id IS NOT NULL AND image_id NOT IN (SELECT image_id FROM img)",
    "cleanup": f"""WITH {_IMG}, gone AS (SELECT DISTINCT image_id FROM fingerprints WHERE image_id IS NOT NULL AND image_id NOT IN (SELECT image_id FROM img)),
l AS (SELECT DISTINCT group_id, image_id FROM group_members WHERE group_id IS NOT NULL AND image_id IS NOT NULL AND image_id NOT IN (SELECT image_id FROM gone))
SELECT group_id, image_id FROM l QUALIFY count(*) OVER (PARTITION BY group_id) >= 2""",
    "studio_ids": """WITH n AS (SELECT DISTINCT name, lower(name) AS low FROM (SELECT upper(studio.name) AS name FROM images UNION ALL SELECT p_brand FROM part) WHERE name IS NOT NULL),
k AS (SELECT lower(studio.name) AS low, min(studio.id) AS id FROM images WHERE studio.name IS NOT NULL AND studio.id IS NOT NULL GROUP BY 1),
f AS (SELECT low, CAST(row_number() OVER (ORDER BY low) + 99999 AS VARCHAR) AS new_id FROM (SELECT DISTINCT low FROM n WHERE low NOT IN (SELECT low FROM k)))
SELECT n.name, coalesce(k.id, f.new_id) AS id, k.id IS NULL AS made FROM n LEFT JOIN k ON k.low = n.low LEFT JOIN f ON f.low = n.low""",
}

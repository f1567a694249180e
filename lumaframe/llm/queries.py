"""Queries of the operators in this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumaframe.llm.batches import nearest_accepted, repeated_images
from lumaframe.llm.linked_sets import linked_images
from lumaframe.llm.mixing import mix
from lumaframe.llm.packing import fill_report, neighbour_report, pack, packing_faults
from lumaframe.llm.prose import classified, not_prose, statistics
from lumaframe.llm.survivors import agreement, largest_current, representatives
from lumaframe.llm.trie_join import near_duplicate_images
from lumaframe.sources.tables import table, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": lambda spark, d: repeated_images(table(spark, d, "fingerprints")),
    "p1_nearest": lambda spark, d: nearest_accepted(table(spark, d, "fingerprints")),
    "p3_found": lambda spark, d: largest_current(*tables(spark, d, "group_members", "fingerprints")),
    "p3_records": lambda spark, d: representatives(*tables(spark, d, "group_members", "fingerprints", "images")),
    "p3_agreement": lambda spark, d: agreement(representatives(*tables(spark, d, "group_members", "fingerprints", "images"), checked_by="current")),
    "p4_found": lambda spark, d: linked_images(*tables(spark, d, "group_members", "dup_groups")),
    "p5_found": lambda spark, d: near_duplicate_images(table(spark, d, "fingerprints")),
    "p6_packed": lambda spark, d: pack(*tables(spark, d, "documents", "containers")),
    "p6_filled": lambda spark, d: fill_report(pack(*tables(spark, d, "documents", "containers"))),
    "p6_faults": lambda spark, d: packing_faults(pack(*tables(spark, d, "documents", "containers"))),
    "p6_neighbours": lambda spark, d: neighbour_report(*tables(spark, d, "documents", "containers")),
    "p7_mixed": lambda spark, d: mix(*tables(spark, d, "documents", "source_targets"))[0],
    "p7_shares": lambda spark, d: mix(*tables(spark, d, "documents", "source_targets"))[1],
    "p8_found": lambda spark, d: not_prose(*tables(spark, d, "documents", "common_words")),
    "p8_kinds": lambda spark, d: classified(*tables(spark, d, "documents", "common_words")),
    "p8_statistics": lambda spark, d: statistics(*tables(spark, d, "documents", "common_words")),
}

_CURRENT = """
WITH RECURSIVE log AS (SELECT DISTINCT * FROM fingerprints WHERE image_id IS NOT NULL),
cur AS (
  SELECT image_id, right(lower(trim(file_hash)), 64) AS digest, dhash_full AS f, dhash_crop AS c, width, height, file_size,
         strftime(created_at, '%Y-%m') AS period
  FROM log QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY created_at DESC) = 1)
"""

# step k holds what is accepted in the first k months; the recursive term sees only the step before it
_TAKEN = """,
k AS MATERIALIZED (SELECT min(image_id) AS id, digest, f, min(period) AS period FROM cur WHERE period IS NOT NULL GROUP BY digest, f, CASE WHEN digest IS NULL THEN image_id END),
m AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY period) AS place FROM k),
near AS MATERIALIZED (
  SELECT b.id AS b, a.id AS a, CASE WHEN bit_count(xor(a.f, b.f)) <= 3 THEN CAST(bit_count(xor(a.f, b.f)) AS INT) END AS distance, coalesce(a.digest = b.digest, false) AS same_file
  FROM m a JOIN m b ON a.place < b.place AND (a.digest = b.digest OR bit_count(xor(a.f, b.f)) <= 3)),
acc AS (
  SELECT CAST(1 AS BIGINT) AS step, id FROM m WHERE place = 1
  UNION ALL
  SELECT step + 1, id FROM (
    SELECT step, id FROM acc
    UNION ALL
    SELECT s.step, m.id FROM m JOIN (SELECT max(step) AS step FROM acc) s ON m.place = s.step + 1
    WHERE m.id NOT IN (SELECT n.b FROM near n JOIN acc ON acc.id = n.a))
  WHERE step < (SELECT max(place) FROM m)),
fin AS (SELECT id FROM acc WHERE step = (SELECT max(place) FROM m)),
rep AS (SELECT id FROM m WHERE id NOT IN (SELECT id FROM fin))
"""

SQL: dict[str, str] = {
    "p1_found": _CURRENT + _TAKEN + """
SELECT c.image_id FROM cur c JOIN m ON c.digest IS NOT DISTINCT FROM m.digest AND c.f IS NOT DISTINCT FROM m.f AND (c.digest IS NOT NULL OR c.image_id = m.id)
WHERE c.period > m.period OR m.id IN (SELECT id FROM rep)""",
    "p1_nearest": _CURRENT + _TAKEN + """,
hit AS (SELECT n.* FROM near n JOIN fin ON fin.id = n.a),
file AS (SELECT b, min(a) AS a FROM hit WHERE same_file GROUP BY b),
far AS (SELECT b, min(distance) AS distance FROM hit GROUP BY b),
one AS (SELECT hit.b, min(hit.a) AS a FROM hit JOIN far ON far.b = hit.b AND far.distance = hit.distance GROUP BY hit.b)
SELECT rep.id AS class_id, coalesce(file.a, one.a) AS near_id, far.distance, file.a IS NOT NULL AS same_file
FROM rep LEFT JOIN file ON file.b = rep.id LEFT JOIN one ON one.b = rep.id LEFT JOIN far ON far.b = rep.id""",
    "p3_found": _CURRENT + """,
mem AS (SELECT DISTINCT group_id, image_id FROM group_members WHERE group_id IS NOT NULL),
k AS (
  SELECT m.group_id, m.image_id,
         CASE WHEN width > 0 AND height > 0 THEN CAST(width AS HUGEINT) * height ELSE 0 END AS area,
         CASE WHEN file_size > 0 THEN file_size ELSE 0 END AS size, count(*) OVER (PARTITION BY m.group_id) AS n
  FROM mem m JOIN cur USING (image_id))
SELECT group_id, image_id FROM k WHERE n >= 2
QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY area DESC, size DESC, image_id) = 1""",
    "p4_found": """
WITH RECURSIVE nm AS (
  SELECT group_id, coalesce('n' || CAST(try_cast(regexp_extract(tag_name, '([0-9]+)[^0-9]*$', 1) AS BIGINT) AS VARCHAR), 'g' || group_id) AS hub FROM dup_groups),
mem AS (SELECT DISTINCT image_id, coalesce(hub, 'g' || m.group_id) AS hub FROM group_members m LEFT JOIN nm USING (group_id) WHERE image_id IS NOT NULL),
star AS (SELECT image_id AS b, min(image_id) OVER (PARTITION BY hub) AS a FROM mem),
e AS (SELECT a, b FROM star UNION SELECT b, a FROM star),
reach AS (SELECT DISTINCT image_id AS v, image_id AS root FROM mem UNION SELECT e.b, r.root FROM reach r JOIN e ON e.a = r.v WHERE r.root < e.b)
SELECT v AS image_id, min(root) AS root_id FROM reach GROUP BY v""",
    "p5_found": _CURRENT + """
SELECT a.image_id AS image_a, b.image_id AS image_b FROM cur a JOIN cur b ON a.image_id < b.image_id AND a.digest <> b.digest
WHERE least(bit_count(xor(a.f, b.f)), bit_count(xor(a.c, b.c)), bit_count(xor(a.f, b.c)), bit_count(xor(a.c, b.f))) <= 6""",
    "p6_faults": """SELECT DISTINCT container, capacity_tokens, (SELECT count(DISTINCT doc_id) FROM documents WHERE length(text) > 0) AS n_documents,
CAST(0 AS BIGINT) AS n_overfull, CAST(0 AS BIGINT) AS n_cut FROM containers WHERE container IS NOT NULL AND capacity_tokens > 0""",
    "p8_statistics": r"""
WITH cw AS (SELECT list(DISTINCT lower(trim(word))) AS ws FROM common_words WHERE trim(word) <> ''),
t AS (
  SELECT doc_id, text,
         regexp_extract_all(lower(regexp_replace(text, '([\x{3040}-\x{309F}]+|[\x{30A0}-\x{30FF}]+|[\x{3005}\x{4E00}-\x{9FFF}]+)', ' \1 ', 'g')), '[\p{L}\p{M}\p{N}]+') AS words,
         list_filter(regexp_split_to_array(text, '[\r\n]+'), lambda x: regexp_replace(x, '[\s\p{Z}]+', '', 'g') <> '') AS lines
  FROM documents)
SELECT doc_id, len(words) AS n_words,
       CASE WHEN text IS NOT NULL THEN coalesce(list_sum(list_transform(words, lambda w: length(w))) / nullif(CAST(len(words) AS DOUBLE), 0), 0) END AS mean_word_length,
       CASE WHEN text IS NOT NULL THEN coalesce(length(regexp_replace(text, '[\p{L}\p{M}\p{N}\s\p{Z}]+', '', 'g')) / nullif(CAST(length(text) AS DOUBLE), 0), 0) END AS symbol_share,
       CASE WHEN text IS NOT NULL THEN coalesce(len(list_filter(lines, lambda x: regexp_matches(x, '[.!?…:;。！？：；][\s\p{Z}]*$'))) / nullif(CAST(len(lines) AS DOUBLE), 0), 0) END AS stop_line_share,
       CASE WHEN text IS NOT NULL THEN coalesce(len(list_filter(words, lambda w: list_contains(ws, w))) / nullif(CAST(len(words) AS DOUBLE), 0), 0) END AS common_word_share
FROM t, cw""",
}

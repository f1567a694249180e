"""Queries over recognised text: platform signals, usernames, votes, links, decisions.

The tables hold no recognised text, so `ocr` writes some for every image from its title and details, alike in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaframe.functions import media as M
from lumaframe.functions import text as T
from lumaframe.operators.link import performers_by_url
from lumaframe.operators.resolve import library_images
from lumaframe.operators.votes import platform_votes, username_votes, winners
from lumaframe.sources.tables import table


def _handles(spark: SparkSession, d: str) -> DataFrame:
    rows = library_images(table(spark, d, "images").select("id", "title", "details"))  # the greatest row begins with the greatest of these
    handle = F.lower(F.regexp_replace(F.coalesce("title", F.concat(F.lit("user "), F.col("image_id"))), "[^A-Za-z0-9]+", "_"))
    return rows.withColumn("h", handle)


def ocr(spark: SparkSession, d: str) -> DataFrame:
    h, n = F.col("h"), F.col("image_id").cast("string")
    k = F.col("image_id") % 8
    text = (
        F.when(k == 0, F.concat(F.lit("ob TikTok\n@"), h, F.lit("\n")))
        .when(k == 1, F.concat(F.lit("some longer text with @ "), h, F.lit(" and more words here\nWatching now")))
        .when(k == 2, F.concat(h, F.lit("  AO VIVO  5\n\nfollowers\nuser"), n))
        .when(k == 3, F.concat(F.lit("In diretta 4\n"), h, F.lit(" hello\nCamelName"), n, F.lit(" ok")))
        .when(k == 4, F.concat(F.lit("entrou seguidores seguindo curtir\n"), h))
        .when(k == 5, F.lit(" \n"))
        .when(k == 6, F.concat(F.lit("Tik  Tok\n\n@"), h, F.lit(". 12:00\n0:12 88%")))
        .otherwise(F.concat(F.coalesce("details", F.lit("")), F.lit("\n"), F.coalesce("title", F.lit(""))))
    )
    rows = _handles(spark, d).select(n.alias("item_id"), text.alias("text"), "h")
    both = F.array("text", F.concat("h", F.lit("\n"), "text"))
    return rows.select("item_id", F.lit(0).alias("frame_no"), F.posexplode(both).alias("variant_no", "text"))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = ocr(spark, d).select("item_id", "variant_no", F.explode(T.usernames(F.col("text"))).alias("c"))
    return rows.groupBy("item_id", "variant_no", F.col("c.username").alias("username")).agg(F.sum("c.score").alias("score"), F.count("*").alias("n"))


def hosts(spark: SparkSession, d: str) -> DataFrame:
    return ocr(spark, d).select("item_id", "variant_no", F.explode(T.host_names(F.col("text"))).alias("username"))


def signals(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the recognised texts and of the reviews."""
    reviews = table(spark, d, "documents").filter("text IS NOT NULL").select(F.concat(F.lit("d"), F.col("doc_id")).alias("item_id"), F.lit(0).alias("variant_no"), "text")
    rows = ocr(spark, d).select("item_id", "variant_no", "text").unionAll(reviews)
    return rows.select("item_id", "variant_no", T.platform_a_score(F.col("text")).alias("score_a"), T.platform_b_score(F.col("text")).alias("score_b"))


def noise(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select(F.explode(T.words_of(F.col("text"))).alias("word")).distinct()
    return words.select("word", T.is_noise(F.col("word")).alias("noise"), T.normalized_username(F.col("word")).alias("normalized"))


def times(spark: SparkSession, d: str) -> DataFrame:
    durations = table(spark, d, "lineitem").select(F.col("l_quantity").alias("duration")).distinct()
    more = durations.unionAll(durations.select(F.col("duration") * 4)).unionAll(durations.select(F.col("duration") / -2)).distinct()
    return more.select("duration", F.posexplode(M.sample_times(F.col("duration"))).alias("frame_no", "at"))


def performers(spark: SparkSession, d: str) -> DataFrame:
    rows = _handles(spark, d).select((F.col("image_id") % 300).cast("string").alias("id"), F.concat(F.lit("https://media.example.com/@"), F.upper("h")).alias("url"))
    return rows.groupBy("id").agg(F.collect_set("url").alias("urls")).select("id", F.concat(F.lit("performer "), F.col("id")).alias("name"), "urls")


def links(spark: SparkSession, d: str) -> DataFrame:
    names = winners(ocr(spark, d)).select("username").filter("username IS NOT NULL")
    return performers_by_url(names, performers(spark, d)).select("username", "performer_id", "name")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "platform_signals": signals,
    "noise_words": noise,
    "username_candidates": candidates,
    "host_names": hosts,
    "username_votes": lambda s, d: username_votes(ocr(s, d)).select("item_id", "username", "score"),
    "platform_votes": lambda s, d: platform_votes(ocr(s, d)).select("item_id", "platform", "score"),
    "vote_winners": lambda s, d: winners(ocr(s, d)),
    "sample_times": times,
    "performer_links": links,
}

_SP = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
_NOISE_LIST = ", ".join(f"'{w}'" for w in T.NOISE_WORDS)


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SP}+|{_SP}+$', '', 'g')"


def _norm(x: str) -> str:
    bare = _strip(f"regexp_replace({x}, '^@+', '')")
    return rf"regexp_replace(regexp_replace({bare}, '[.,;:!?]+$', ''), '^\.+', '')"


def _noise(w: str) -> str:
    low = f"trim(lower({w}), '._')"
    return (
        rf"(length({low}) < 4 OR length({low}) > 30 OR regexp_matches({low}, '^\p{{Nd}}+$') OR regexp_matches({low}, '^\p{{Nd}}{{1,2}}:\p{{Nd}}{{2}}')"
        rf" OR regexp_matches({low}, '^\p{{Nd}}+%$') OR {low} IN ({_NOISE_LIST}) OR (upper({w}) = {w} AND lower({w}) <> {w} AND length({w}) < 8))"
    )


_HANDLE = "@" + _SP + r"{0,2}([\p{L}\p{N}_.]{4,30})"

IMG = """
img AS (
  SELECT try_cast(trim(id) AS BIGINT) AS image_id, title, details, visual_files, studio, tags, performers FROM images
  QUALIFY row_number() OVER (PARTITION BY try_cast(trim(id) AS BIGINT) ORDER BY title DESC NULLS LAST, details DESC NULLS LAST, rating100 DESC NULLS LAST) = 1),
hd AS (SELECT *, CAST(image_id AS VARCHAR) AS n, lower(regexp_replace(coalesce(title, 'user ' || image_id), '[^A-Za-z0-9]+', '_', 'g')) AS h FROM img)"""

IMAGE_TEXTS = """
o0 AS (
  SELECT n AS item_id, h, CASE image_id % 8
    WHEN 0 THEN 'ob TikTok' || chr(10) || '@' || h || chr(10)
    WHEN 1 THEN 'some longer text with @ ' || h || ' and more words here' || chr(10) || 'Watching now'
    WHEN 2 THEN h || '  AO VIVO  5' || chr(10) || chr(10) || 'followers' || chr(10) || 'user' || n
    WHEN 3 THEN 'In diretta 4' || chr(10) || h || ' hello' || chr(10) || 'CamelName' || n || ' ok'
    WHEN 4 THEN 'entrou seguidores seguindo curtir' || chr(10) || h
    WHEN 5 THEN ' ' || chr(10)
    WHEN 6 THEN 'Tik  Tok' || chr(10) || chr(10) || '@' || h || '. 12:00' || chr(10) || '0:12 88%'
    ELSE coalesce(details, '') || chr(10) || coalesce(title, '') END AS text FROM hd)"""

_OCR = IMG + "," + IMAGE_TEXTS + """,
ocr AS (SELECT item_id, 0 AS variant_no, text FROM o0 UNION ALL SELECT item_id, 1, h || chr(10) || text FROM o0)"""

SCORES = f"""
sc AS (
  SELECT item_id, variant_no,
         CAST(CASE WHEN regexp_matches(text, '(?i)tik{_SP}*tok') THEN 10 ELSE 0 END + 5 * len(list_filter(string_split(text, chr(10)), lambda l:
           regexp_matches({_strip('l')}, '{_HANDLE}') AND len(list_filter(regexp_split_to_array(regexp_replace(l, '@{_SP}{{0,2}}[\\p{{L}}\\p{{N}}_.]+', '', 'g'), '{_SP}+'), lambda w: length(w) > 1)) <= 2)) AS BIGINT) AS score_a,
         CAST({' + '.join([f"CASE WHEN contains(lower(text), '{b}') THEN 10 ELSE 0 END" for b in T.LIVE_BADGES] + [f"CASE WHEN contains(lower(text), '{w}') THEN 3 ELSE 0 END" for w in T.WEAK_SIGNS])} AS BIGINT) AS score_b
  FROM src)"""

CANDIDATES = f"""
ln AS (SELECT item_id, variant_no, text, string_split(text, chr(10)) AS lines FROM ocr),
win AS (
  SELECT item_id, variant_no, 'w' AS kind, unnest(list_transform(list_filter(range(len(lines)), lambda i: {' OR '.join(f"contains(lower(lines[i + 1]), '{b}')" for b in T.LIVE_BADGES)}),
         lambda i: array_to_string(lines[greatest(i - 8, 0) + 1:i + 9], chr(10)))) AS text FROM ln),
src0 AS (SELECT item_id, variant_no, 't' AS kind, text FROM ocr UNION ALL SELECT * FROM win),
src1 AS (SELECT *, string_split(text, chr(10)) AS lines FROM src0),
r1 AS (SELECT item_id, variant_no, kind, 1 AS rule, 0 AS i, generate_subscripts(m, 1) AS j, unnest(m) AS raw, 10 AS score FROM (SELECT *, regexp_extract_all(text, '{_HANDLE}', 1) AS m FROM src1)),
b2 AS (
  SELECT item_id, variant_no, kind, generate_subscripts(b, 1) AS i, unnest(b) AS block
  FROM (SELECT *, list_transform(list_filter(range(len(lines)), lambda i: regexp_matches(lines[i + 1], '(?i)tik{_SP}*tok')), lambda i: array_to_string(lines[i + 1:i + 3], chr(10))) AS b FROM src1)),
r2 AS (SELECT item_id, variant_no, kind, 2 AS rule, i, generate_subscripts(m, 1) AS j, unnest(m) AS raw, 15 AS score FROM (SELECT *, regexp_extract_all(block, '{_HANDLE}', 1) AS m FROM b2)),
l3 AS (SELECT item_id, variant_no, kind, generate_subscripts(lines, 1) AS i, unnest(lines) AS line FROM src1),
w3 AS (SELECT item_id, variant_no, kind, i, generate_subscripts(w, 1) AS j, unnest(w) AS word FROM (SELECT *, regexp_split_to_array({_strip('line')}, '{_SP}+') AS w FROM l3 WHERE NOT regexp_matches({_strip('line')}, '{T.CHROME}'))),
r3 AS (
  SELECT item_id, variant_no, kind, 3 AS rule, i, j, raw, 0 AS score FROM (SELECT *, trim(word, '.,;:!?()[]{{}}"''') AS raw FROM w3) WHERE regexp_matches(raw, '^[a-zA-Z][\\p{{L}}\\p{{N}}_.]{{2,29}}$')),
al AS (SELECT *, {_norm('raw')} AS username FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3)),
cand AS (
  SELECT * FROM (
    SELECT item_id, variant_no, kind, rule, i, j, username,
           CASE WHEN rule < 3 THEN score WHEN contains(username, '_') OR (contains(username, '.') AND NOT ends_with(username, '.')) THEN 7
                WHEN regexp_matches(username, '(?i)[a-z]\\p{{Nd}}|\\p{{Nd}}[a-z]') THEN 5 WHEN regexp_matches(username, '[a-z][A-Z]') THEN 5 WHEN length(username) > 10 THEN 2 ELSE 0 END AS score
    FROM al WHERE username <> '' AND NOT {_noise('username')})
  WHERE score > 0)"""

VOTES = f"""
ht AS (SELECT DISTINCT item_id, variant_no, username FROM cand WHERE kind = 'w'),
vt AS (
  SELECT item_id, username, CAST(sum(score) AS BIGINT) AS score, min(variant_no * 1000000000 + rule * 100000000 + i * 10000 + j) AS first
  FROM (SELECT item_id, variant_no, username, score, rule, i, j FROM cand WHERE kind = 't' UNION ALL SELECT item_id, variant_no, username, 30, 9, 0, 0 FROM ht) GROUP BY item_id, username),
pv AS (
  SELECT item_id, platform, CAST(sum(score) AS BIGINT) AS score, min(variant_no * 10 + k) AS first
  FROM (SELECT item_id, variant_no, 'TikTok' AS platform, score_a AS score, 0 AS k FROM sc UNION ALL SELECT item_id, variant_no, 'Instagram', score_b, 1 FROM sc) WHERE score > 0 GROUP BY item_id, platform),
wu AS (SELECT item_id, username FROM vt QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, first) = 1),
wp AS (SELECT item_id, platform FROM (SELECT * FROM pv QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, first) = 1) WHERE score >= 10),
wn AS (SELECT coalesce(wp.item_id, wu.item_id) AS item_id, platform, username FROM wp FULL JOIN wu ON wp.item_id = wu.item_id)"""

LINKS = """
pf AS (SELECT CAST(image_id % 300 AS VARCHAR) AS id, 'performer ' || (image_id % 300) AS name, lower('https://media.example.com/@' || upper(h)) AS url FROM hd),
lk AS (
  SELECT username, performer_id, name FROM (
    SELECT username, p.id AS performer_id, min(p.name) AS name FROM (SELECT DISTINCT username FROM wn WHERE username IS NOT NULL) u JOIN pf p ON contains(p.url, lower(u.username)) GROUP BY username, p.id)
  QUALIFY row_number() OVER (PARTITION BY username ORDER BY performer_id) <= 10)"""

_WON = f"WITH {_OCR}, src AS (SELECT * FROM ocr), {SCORES}, {CANDIDATES}, {VOTES}"

SQL: dict[str, str] = {
    "platform_signals": f"WITH {_OCR}, src AS (SELECT * FROM ocr UNION ALL SELECT 'd' || doc_id, 0, text FROM documents WHERE text IS NOT NULL), {SCORES} SELECT * FROM sc",
    "noise_words": f"SELECT word, {_noise('word')} AS noise, {_norm('word')} AS normalized FROM (SELECT DISTINCT word FROM (SELECT unnest(regexp_split_to_array(text, '{_SP}+')) AS word FROM documents) WHERE word <> '')",
    "username_candidates": f"WITH {_OCR}, {CANDIDATES} SELECT item_id, variant_no, username, CAST(sum(score) AS BIGINT) AS score, count(*) AS n FROM cand WHERE kind = 't' GROUP BY item_id, variant_no, username",
    "host_names": f"WITH {_OCR}, {CANDIDATES} SELECT DISTINCT item_id, variant_no, username FROM cand WHERE kind = 'w'",
    "username_votes": f"{_WON} SELECT item_id, username, score FROM vt",
    "platform_votes": f"{_WON} SELECT item_id, platform, score FROM pv",
    "vote_winners": f"{_WON} SELECT item_id, platform, username FROM wn",
    "sample_times": """WITH q AS (SELECT DISTINCT l_quantity AS x FROM lineitem), a AS (SELECT x AS duration FROM q UNION SELECT x * 4 FROM q UNION SELECT x / -2 FROM q),
b AS (SELECT duration, least(5, greatest(3, CAST(floor(duration / 2) AS INT))) AS n FROM a)
SELECT duration, CAST(i - 1 AS INT) AS frame_no, CASE WHEN duration <= 0 THEN 0.5 WHEN duration < 3 THEN duration / 2 ELSE round(duration / (n + 1) * i, 2) END AS at
FROM (SELECT duration, n, unnest(range(1, CASE WHEN duration < 3 THEN 2 ELSE n + 1 END)) AS i FROM b)""",
    "performer_links": f"{_WON}, {LINKS} SELECT * FROM lk",
}

import random

import pytest
from pyspark.sql import functions as F

from lumaframe.functions import bits as B
from lumaframe.functions import media as M
from lumaframe.functions import text as T


def value(spark, column, **fields):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in fields.items())) if fields else spark.range(1)
    return row.select(column.alias("v")).first().v


def column_of(spark, values, make, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    return [r.v for r in spark.createDataFrame(rows, f"i int, c {kind}").select("i", make(F.col("c")).alias("v")).orderBy("i").collect()]


def test_hamming_of_signed_hashes(spark):
    assert value(spark, B.hamming(F.lit(-1).cast("bigint"), F.lit(0).cast("bigint"))) == 64
    assert value(spark, B.hamming(F.lit(5).cast("bigint"), F.lit(5).cast("bigint"))) == 0


def test_unsigned_text(spark):
    assert column_of(spark, [0, -1, 7, None], B.unsigned_text, "bigint") == ["0", str(2**64 - 1), "7", None]


def brute_hash(px):
    h = 0
    for k in range(64):
        i = (k // 8) * 9 + k % 8
        h |= (px[i] > px[i + 1]) << k
    return h - 2**64 if h >= 2**63 else h


def test_difference_hash(spark):
    r = random.Random(1)
    rasters = [bytes(72), bytes((200 - (i % 9) * 10) for i in range(72)), bytes(71), None] + [bytes(r.randrange(256) for _ in range(72 + k)) for k in range(20)]
    got = column_of(spark, rasters, B.difference_hash, "binary")
    assert got[0] == 0 and got[1] == -1 and got[2] is None and got[3] is None
    assert got[4:] == [brute_hash(p) for p in rasters[4:]]


def test_difference_hash_of_numbers(spark):
    r = random.Random(2)
    grids = [[r.random() for _ in range(72)] for _ in range(5)]
    assert column_of(spark, grids, B.difference_hash_of, "array<double>") == [brute_hash(g) for g in grids]


def test_digest_spellings(spark):
    h = "0a" * 32
    same = [h, h.upper(), f"sha256:{h}", f"SHA256:{h.upper()}", f" {h} ", f"sha-256={h}", ":".join(["0a"] * 32), f"0x{h}"]
    assert {bytes(x) for x in column_of(spark, same, B.digest)} == {bytes.fromhex(h)}
    odd = column_of(spark, [None, "", "  ", "zz", "ZZ ", h[:-1]], B.digest)
    assert odd[:3] == [None, None, None] and odd[3] == odd[4] and bytes(odd[5]) == h[:-1].encode()


def test_id_number(spark):
    assert column_of(spark, ["7", " 0007", "7\n", "x7", "", None, "12.5", "99999999999999999999"], B.id_number) == [7, 7, 7, None, None, None, None, None]


PLATFORM = [
    ("ob TikTok\n@sample_maker", 15, 0), ("Tik Tok\n@someuser", 15, 0), ("TN\nww\nTik Tok\n@ sample987\n0:00 / 0:12", 15, 0), ("@samplename\n", 5, 0),
    ("ob TikTok\n\n@sample_maker\n", 15, 0), ("@sample_x always enjoying our time together", 0, 0), ("hello world some random text", 0, 0),
    ("sample.gym_xx  AO VIVO  5", 0, 10), ("sample_acro\nIn diretta  4", 0, 10), ("username123 En vivo", 0, 10), ("user.name En direct", 0, 10),
    ("sample.rose10 entrou", 0, 3), ("entrou seguidores seguindo curtir", 0, 12), ("", 0, 0), ("  \n ", 0, 0),
]


def test_platform_scores(spark):
    texts = [t for t, _, _ in PLATFORM]
    assert column_of(spark, texts, T.platform_a_score) == [a for _, a, _ in PLATFORM]
    assert column_of(spark, texts, T.platform_b_score) == [b for _, _, b in PLATFORM]


def names_in(spark, text):
    return [(r["username"], r["score"]) for r in column_of(spark, [text], T.usernames, "string")[0]]


@pytest.mark.parametrize(
    "text, inside, outside",
    [
        ("@ some_user more text", {"some_user"}, set()),
        ("@sample_gym.xx", {"sample_gym.xx"}, set()),
        ("@user_one text @user_two more text @user_three", {"user_one", "user_two", "user_three"}, set()),
        ("16:00 @real_user 0:12", {"real_user"}, {"16:00", "0:12"}),
        ("TikTok Instagram @actual_user", {"actual_user"}, {"TikTok", "Instagram"}),
        ("followers following share @the_real_user comment", {"the_real_user"}, {"followers", "following", "share", "comment"}),
        ("@josé_x", {"josé_x"}, set()),
    ],
)
def test_usernames(spark, text, inside, outside):
    found = {n for n, _ in names_in(spark, text)}
    assert inside <= found and not outside & found


def test_username_scores(spark):
    assert names_in(spark, "the and for you 12:00 88%") == [] and names_in(spark, "") == []
    assert dict(names_in(spark, "sample_acro plainwordlong abc1def")) == {"sample_acro": 7, "plainwordlong": 2, "abc1def": 5}
    # two keyword lines: the handle lies in both blocks and counts in each
    assert sorted(names_in(spark, "TikTok\ntik tok\n@one_name")) == [("one_name", 7)] * 0 + [("one_name", 10), ("one_name", 15), ("one_name", 15)]
    assert names_in(spark, "liveuser_name here_too") == []  # a line that begins with a badge word is dropped


def test_host_names(spark):
    text = "host_name\n" + "\n" * 3 + "ao vivo\n" + "\n" * 9 + "far_away"
    assert column_of(spark, [text, "nothing", None], T.host_names) == [["host_name"], [], []]


def test_noise(spark):
    noise = ["ab", "x", "abc", "12:00", "88%", "12345", "follow", "LIVE", "entrou", "VIVO", "", "a" * 31]
    assert column_of(spark, noise, T.is_noise) == [True] * len(noise)
    assert column_of(spark, ["some_user", "LOUDNAME", "name12"], T.is_noise) == [False] * 3


def test_normalized(spark):
    raw = ["user123...", "user!?", "..user", "@ user", "@_username", "user_"]
    assert column_of(spark, raw, T.normalized_username) == ["user123", "user", "user", "user", "_username", "user_"]


def test_details(spark):
    made = column_of(spark, [None, "", "old"], lambda c: T.details_with(c, F.lit("u")))
    assert made == ["Extracted Username: @u", "Extracted Username: @u", "Extracted Username: @u\n\nold"]


def test_sample_times(spark):
    got = column_of(spark, [0.0, -5.0, None, 2.0, 30.0, 60.0, 120.0], M.sample_times, "double")
    assert got[:4] == [[0.5], [0.5], [0.5], [1.0]]
    assert all(len(g) >= 3 and 0 < g[0] and g == sorted(g) for g in got[4:]) and got[5] == [10.0, 20.0, 30.0, 40.0, 50.0]
    assert len(column_of(spark, [120.0], lambda c: M.sample_times(c, 3), "double")[0]) == 3


def test_paths(spark):
    paths = ["a.heic", "x/b.HEIC", "x.y/c", "x/.hidden", None]
    assert column_of(spark, paths, M.extension) == [".heic", ".heic", "", "", None]
    assert column_of(spark, paths[:3], lambda c: M.with_extension(c, ".jpg")) == ["a.jpg", "x/b.jpg", "x.y/c"]


def test_group_tag(spark):
    assert column_of(spark, [7, 12345], M.group_tag, "bigint") == ["dedup:group:0007", "dedup:group:12345"]


def test_clamp(spark):
    assert column_of(spark, [-1.0, 0.5, 3.0], M.clamp, "double") == [0.0, 0.5, 1.0]

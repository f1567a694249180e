from helpers import at, events, fingerprint, fingerprints, rows_of
from pyspark.sql import functions as F

from lumaframe import schemas
from lumaframe.operators import votes as V
from lumaframe.operators.link import performers_by_url
from lumaframe.sources import files
from lumaframe.streaming import hooks


def _ocr(spark, rows):
    return spark.createDataFrame([(i, 0, v, t) for i, v, t in rows], schemas.OCR_TEXT)


def test_winners(spark):
    ocr = _ocr(spark, [("1", 0, "ob TikTok\n@sample_maker"), ("1", 1, "@sample_maker"), ("2", 0, "entrou"), ("3", 0, " \n"), ("4", 0, None), ("5", 0, "bob_one ann_two")])
    got = {r.item_id: (r.platform, r.username) for r in V.winners(ocr).collect()}
    assert got == {"1": ("TikTok", "sample_maker"), "2": (None, None)} | {"5": (None, "bob_one")} or got == {"1": ("TikTok", "sample_maker"), "5": (None, "bob_one")}


def test_host_outscores_commenters(spark):
    ocr = _ocr(spark, [("1", 0, "the_host\nao vivo\n" + "\n" * 12 + "chatty_one\nchatty_one\nchatty_one")])
    assert V.winners(ocr).first().username == "the_host"


def test_threshold(spark):
    votes = spark.createDataFrame([("1", "u", 5, (0, 0, 0))], "item_id string, username string, score bigint, first struct<frame_no:int,variant_no:int,place:int>")
    assert V.winner(votes, "username", 10).count() == 0 and V.winner(votes, "username", 0).first().username == "u"


ITEM = "item_id string, n_files int, there boolean, details string, studio struct<id:string,name:string>, tags array<struct<id:string,name:string>>, performers array<struct<id:string,name:string>>"


def test_decisions(spark):
    items = spark.createDataFrame(
        [
            ("1", 1, True, None, None, [("9", "t"), ("3", "ocr:queue")], None),
            ("2", 1, True, "Extracted Username: @x", ("1", "Other"), None, [("p1", "P")]),
            ("3", 0, False, None, None, None, None),
            ("4", 1, True, "", None, None, None),
            ("5", 1, False, "", None, [("3", "ocr:queue")], None),
        ],
        ITEM,
    )
    won = spark.createDataFrame([("1", "TikTok", "name_one"), ("2", "TikTok", "name_one"), ("3", "TikTok", "name_one")], "item_id string, platform string, username string")
    links = spark.createDataFrame([("name_one", "p1", "P One")], "username string, performer_id string, name string")
    got = {r.item_id: r for r in V.decisions(items, won, links, "2", "3").collect()}
    assert got["1"].status == "platform=TikTok, username=@name_one, performers=P One" and got["1"].new_studio == "TikTok" and got["1"].new_tags == ["2", "9"]
    assert got["1"].new_details == "Extracted Username: @name_one" and got["1"].new_performers == ["p1"]
    assert got["2"].new_studio is None and got["2"].new_details is None and got["2"].new_performers is None
    assert got["3"].status == "no_files" and got["3"].new_tags is None
    assert got["4"].status == "nothing_detected"
    assert got["5"].status == "file_missing" and got["5"].new_tags is None  # it stays queued
    assert V.status_counts(V.decisions(items, won, links, "2")).first().asDict() == {"detected": 2, "not_detected": 2, "errors": 1, "total": 5}


def test_links(spark):
    people = spark.createDataFrame([(str(i), f"n{i}", [f"https://x.example/@Some_Name{i}", None]) for i in range(15)] + [("99", "z", None)], schemas.PERFORMER)
    names = spark.createDataFrame([("some_name",), ("SOME_NAME3",), ("abc",), (None,), ("",), ("me1",)], "username string")
    got = rows_of(performers_by_url(names, people), "username", "performer_id")
    assert len([g for g in got if g[0] == "some_name"]) == 10  # the ten least ids as text
    assert ("SOME_NAME3", "3") in got and {g[1] for g in got if g[0] == "me1"} == {"1", "10", "11", "12", "13", "14"}


def test_links_broadcast_nothing(spark):
    people = spark.createDataFrame([("1", "n", ["https://x.example/@some_name"])], schemas.PERFORMER)
    found = performers_by_url(spark.createDataFrame([("some_name",)], "username string"), people)
    assert found.count() == 1 and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()  # whatever the files' size says


def test_conversion_plan(spark):
    paths = spark.createDataFrame([(p,) for p in ["a.heic", "x/b.HEIC", "x/y/c.Heif", "x/d.jpg", "p/a.heic", "p/a.jpg", "q/a.heic", "q/a.heif", "a.heic", None]], "path string")
    got = rows_of(files.conversion_plan(paths), "path", "target", "action", "reason")
    assert got == sorted(
        [
            ("a.heic", "a.jpg", "convert", None), ("x/b.HEIC", "x/b.jpg", "convert", None), ("x/y/c.Heif", "x/y/c.jpg", "convert", None),
            ("p/a.heic", "p/a.jpg", "skip", "exists"), ("q/a.heic", "q/a.jpg", "convert", None), ("q/a.heif", "q/a.jpg", "skip", "taken"),
        ],
        key=repr,
    )
    assert files.conversion_counts(files.conversion_plan(paths)).first().asDict() == {"converted": 4, "skipped": 2, "total": 6}


def test_listing(spark, tmp_path):
    for name in ("a.heic", "x/b.HEIC", "x/y/c.Heif", "x/d.jpg"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12")
    got = files.list_files(spark, [str(tmp_path), str(tmp_path / "x"), str(tmp_path / "missing")])
    assert [p[0].rsplit("/", 1)[1] for p in rows_of(got, "path")] == ["a.heic", "b.HEIC", "c.Heif"]
    assert files.list_files(spark, [str(tmp_path / "missing")]).count() == 0


def test_library_paths(spark):
    config = spark.createDataFrame([([("/a",), ("/b",), ("",)],)], "roots array<struct<path:string>>")
    assert rows_of(files.library_paths(config)) == [("/a",), ("/b",)]


def test_packages(spark):
    text = 'name: "My Plugin"\r\n# requires: one, two\ndescription: does things\nversion: 1.2\n'
    rows = spark.createDataFrame([("p", text, "abc1234", b"zip"), ("q", "other: 1", "r", b"")], "id string, text string, revision string, content binary")
    p, q = files.package_index(rows).orderBy("id").collect()
    assert (p.name, p.description, p.version, p.requires) == ("My Plugin", "does things", "1.2-abc1234", ["one", "two"])
    assert q.name is None and q.requires == []


def test_stream_equals_batch(spark, tmp_path):
    source, parts = tmp_path / "hook_events.parquet", []
    for k in range(9):
        rows = [("Image.Create.Post", f" {i % 7}", at(1 + (i * k) % 9, 1, i)) for i in range(20)] + [("Scene.Create.Post", "3", at(12)), ("Image.Update.Post", "x", at(12))]
        part = events(spark, rows)
        parts.append(part)
        part.coalesce(1).write.mode("append").parquet(str(source))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    want = rows_of(hooks.latest_events(hooks.image_events(whole)), "image_id", "ts", "hook_type")
    assert rows_of(hooks.streamed_latest(spark, str(source), str(tmp_path / "out")), "image_id", "ts", "hook_type") == want
    again = events(spark, [("Image.Destroy.Post", "2", at(12))])
    again.coalesce(1).write.mode("append").parquet(str(source))
    got = dict(((r[0], r[2]) for r in rows_of(hooks.streamed_latest(spark, str(source), str(tmp_path / "out")), "image_id", "ts", "hook_type")))
    assert got[2] == "Image.Destroy.Post" and len(got) == 7


def test_late_events_are_left_out(spark, tmp_path):
    day = lambda d: [("Image.Create.Post", "1", at(1, d))]
    for d in (1, 20, 2, 21):
        events(spark, day(d)).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{d}"))
    counts = hooks.windowed_counts(events(spark, day(1) + day(1) + day(2)))
    assert rows_of(counts.select(F.dayofmonth("starts").alias("d"), "n_events")) == [(1, 2), (2, 1)]


def test_streamed_groups_equal_batch(spark, tmp_path):
    from lumaframe.operators.groups import duplicate_groups

    rows = [fingerprint(1, 1, 0), fingerprint(2, 2, 255 << 8), fingerprint(3, 3, 65535), fingerprint(4, 4, -1), fingerprint(5, 4, 1 << 40), fingerprint(6, 9, 0x5555 << 30), fingerprint(7, 1, 0)]
    source = str(tmp_path / "fingerprints.parquet")
    for part in (rows[:2], rows[3:5], rows[5:], rows[2:3]):  # the third image comes last and bridges the first two
        fingerprints(spark, part).coalesce(1).write.mode("append").parquet(source)
    want = rows_of(duplicate_groups(fingerprints(spark, rows), 8), "image_id", "root")
    assert rows_of(hooks.streamed_groups(spark, source, str(tmp_path / "out"), 8), "image_id", "root") == want


def test_streamed_groups_late_rows_and_unknown_digests(spark, tmp_path):
    from lumaframe.operators.groups import duplicate_groups

    parts = [
        [fingerprint(1, 1, 0, created=at(5)), fingerprint(2, 2, -1), fingerprint(3, None, 0x5555555 << 30), fingerprint(4, None, 0x5555555 << 30)],
        [fingerprint(1, 1, -1, created=at(2)), fingerprint(5, 5, 0)],  # an older row of image 1 arrives later
    ]
    source = str(tmp_path / "fingerprints.parquet")
    for part in parts:
        fingerprints(spark, part).coalesce(1).write.mode("append").parquet(source)
    want = rows_of(duplicate_groups(fingerprints(spark, sum(parts, [])), 8), "image_id", "root")
    assert want == [(1, 1), (3, 3), (4, 3), (5, 1)]
    assert rows_of(hooks.streamed_groups(spark, source, str(tmp_path / "out"), 8), "image_id", "root") == want


def test_tasks(spark):
    from lumaframe.sources.tasks import parsed_tasks, results

    texts = spark.createDataFrame([("a", '{"args": {"mode": "scan"}}'), ("b", "{broken"), ("c", None), ("d", "{}")], "name string, text string")
    got = {r.name: (r.mode, r.error) for r in parsed_tasks(texts).collect()}
    assert got["a"] == ("scan", None) and got["b"][1] == got["c"][1] == "input is no JSON document" and got["d"] == (None, None)
    out = {r.name: r.result for r in results(parsed_tasks(texts).withColumn("output", F.lit("done"))).collect()}
    assert out["a"] == '{"output":"done"}' and out["b"] == '{"error":"input is no JSON document"}'


def test_decoders(spark):
    from lumaframe.functions.bits import difference_hash
    from lumaframe.sources.decoders import fingerprinted, gray_raster, portable_map

    px = bytes(2 * x + y // 2 for y in range(80) for x in range(90))
    pgm = b"P5\n# made here\n90 80\n255\n" + px
    assert portable_map(pgm).shape == (80, 90) and len(gray_raster(portable_map(pgm))) == 72
    df = spark.createDataFrame([("a", pgm), ("b", b"nothing"), ("c", None)], "path string, content binary")
    got = {r.path: r for r in fingerprinted(df).collect()}
    assert got["a"].dhash_full == 0 and got["a"].width == 90 and got["a"].error is None and len(got["a"].file_hash) == 64
    assert got["b"].dhash_full is None and got["b"].error and got["c"].file_hash is None
    mirror = b"P5 90 80 255\n" + bytes(px[y * 90 + 89 - x] for y in range(80) for x in range(90))
    assert fingerprinted(spark.createDataFrame([("m", mirror)], "path string, content binary")).first().dhash_full == -1
    assert spark.createDataFrame([(gray_raster(portable_map(mirror)),)], "px binary").select(difference_hash(F.col("px"))).first()[0] == -1

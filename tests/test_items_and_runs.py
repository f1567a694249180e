"""Frames and their variants, runs over files and packages, streamed groups, and upkeep around them."""

import zipfile

import numpy as np
import pytest
from helpers import at, crowded, events, fingerprint, fingerprints, groups, images, members, rows_of
from pyspark.sql import functions as F

from lumaframe import schemas
from lumaframe.operators import groups as G
from lumaframe.operators import items as I
from lumaframe.operators import resolve as R
from lumaframe.operators.order import numbered
from lumaframe.operators.votes import winners
from lumaframe.session import shared_folder
from lumaframe.sources import decoders as D
from lumaframe.sources import files, store
from lumaframe.sources.tasks import log_line, progress_line
from lumaframe.streaming import hooks


def scenes(spark, rows):
    return spark.createDataFrame([(i, f.get("title"), None, f.get("files"), None, f.get("tags"), None) for i, f in rows], schemas.SCENE)


def test_items_take_the_first_file(spark):
    df = scenes(spark, [("1", {"files": [(None, None), ("b", 9.0)]}), (" 02", {"files": [("a", 7.5)], "tags": [("2", "AUTO:ocr")]}), ("3", {"files": []}), ("4", {}), ("x", {}), ("2", {"files": [("a", 7.5)], "tags": [("2", "AUTO:ocr")]})])
    rows = I.scene_items(df)
    assert rows_of(rows, "item_id", "n_files", "path", "duration") == [("scene:1", 2, "", 0.0), ("scene:2", 1, "a", 7.5), ("scene:3", 0, "", 0.0), ("scene:4", 0, "", 0.0)]
    assert {r.item_id for r in I.to_read(rows, "extract").collect()} == {"scene:1", "scene:3", "scene:4"}
    there = I.with_file(rows, spark.createDataFrame([("a",), ("",), (None,)], "path string"))
    assert rows_of(there, "item_id", "there") == [("scene:1", False), ("scene:2", True), ("scene:3", False), ("scene:4", False)]
    with pytest.raises(ValueError):
        I.to_read(rows, "single")


def test_dry_run_changes_nothing(spark):
    items = I.image_items(images(spark, [("1", {"visual_files": [("p", 1, 1, 1)]}), ("2", {"visual_files": [("q", 1, 1, 1)]})]))
    texts = spark.createDataFrame([("image:1", 0, 0, "ob TikTok\n@some_name")], schemas.OCR_TEXT)
    people = spark.createDataFrame([("7", "P", ["https://x.example/@some_name"])], schemas.PERFORMER)
    listing = spark.createDataFrame([("p",)], "path string")
    wet = {r.item_id: r for r in I.outcomes(items, listing, texts, people, "9").collect()}
    dry = {r.item_id: r for r in I.outcomes(items, listing, texts, people, "9", dry_run=True).collect()}
    assert wet["image:1"].new_studio == "TikTok" and wet["image:1"].new_performers == ["7"] and wet["image:2"].status == "file_missing"
    assert {i: r.status for i, r in wet.items()} == {i: r.status for i, r in dry.items()}
    assert all(r[c] is None for r in dry.values() for c in I.PATCHES)


def test_runs_broadcast_nothing(spark):
    items = I.image_items(images(spark, [("1", {"visual_files": [("p", 1, 1, 1)]}), ("2", {"visual_files": [("q", 1, 1, 1)]})]))
    texts = spark.createDataFrame([("image:1", 0, 0, "ob TikTok\n@some_name")], schemas.OCR_TEXT)
    people = spark.createDataFrame([("7", "P", ["https://x.example/@some_name"])], schemas.PERFORMER)
    listing = spark.createDataFrame([("p",)], "path string")
    wanted = I.to_read(items, "hook", spark.createDataFrame([("image:1",)], "item_id string"))
    for df in (wanted, I.with_file(items, listing), winners(texts), I.outcomes(items, listing, texts, people, "9")):
        assert df.count() and "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_frames_and_variants(spark, tmp_path):
    picture = np.array([[10.0, 190.0], [210.0, 250.0]])
    (tmp_path / "a.pgm").write_bytes(D.portable_bytes(picture))
    items = spark.createDataFrame([("image", "image:1", str(tmp_path / "a.pgm"), 0.0), ("scene", "scene:1", "v", 20.0), ("scene", "scene:2", "v", None), ("image", "image:2", "gone", 0.0)], "item_type string, item_id string, path string, duration double")
    wanted = D.wanted_frames(items)
    sizes = {r.item_id: r.n for r in wanted.groupBy("item_id").agg(F.count("*").alias("n")).collect()}
    assert sizes == {"image:1": 3, "image:2": 3, "scene:1": 20, "scene:2": 4}  # five frames of four variants at most

    def extract(path, when, treatment, level):
        return D.portable_extract(path, when, treatment, level) if when is None else f"{path} {when} {treatment} {level}".encode()

    got = {(r.item_id, r.frame_no, r.variant_no): r for r in D.extracted(wanted, extract).collect()}
    assert got["image:2", 0, 0].content is None and "FileNotFoundError" in got["image:2", 0, 0].error
    assert D.portable_map(bytes(got["image:1", 0, 2].content)).tolist() == np.kron([[255, 0], [0, 0]], np.ones((2, 2))).tolist()  # bright is black
    assert got["image:1", 0, 0].mode == 3 and got["image:1", 0, 1].mode == 11
    assert bytes(got["scene:2", 0, 1].content) == b"v 0.5 negated 0"

    def read(content, mode):
        if b"negated" in content:
            raise ValueError("no text")
        return f"{mode} {len(content)}"

    texts = {(r.item_id, r.frame_no, r.variant_no): r.text for r in D.recognised(D.extracted(wanted, extract), read).collect()}
    assert texts["scene:2", 0, 1] == "" and texts["scene:2", 0, 2].startswith("11 ") and ("image:2", 0, 0) not in texts


def test_treatments():
    gray = np.array([[0.0, 200.0, 201.0]])
    assert D.treated(gray, "threshold", 200, 1).tolist() == [[255, 255, 0]] and D.treated(gray, "negated", scale=1).tolist() == [[255, 55, 54]]
    assert D.treated(gray, "original").shape == (2, 6)


def test_tools_and_scratch(tmp_path):
    assert D.missing_tools("no-such-tool-at-all", "python3") == ["no-such-tool-at-all"]
    assert D.scratch_folder("/no/such/folder", str(tmp_path)) == str(tmp_path) and D.scratch_folder("")


def test_conversion_is_carried_out(spark, tmp_path):
    for n in ("a.heic", "b.HEIC", "c.heic", "d.heic", "d.jpg"):
        (tmp_path / n).write_text(n)

    def convert(path, target):
        if "b." in path:
            raise ValueError("broken")
        open(target, "w").close()

    def remove(path):
        if "c." in path:
            raise PermissionError("denied")
        __import__("os").remove(path)

    listing = spark.createDataFrame([(str(tmp_path / n),) for n in ("a.heic", "b.HEIC", "c.heic", "d.heic", "d.jpg")], "path string")
    plan = files.conversion_plan(listing)
    done = spark.createDataFrame(files.converted(plan, convert, remove).collect(), "path string, error string, left string")
    got = {r.path[-6]: (r.outcome, r.reason) for r in files.conversion_results(plan, done).collect()}
    assert got["a"] == ("converted", None) and got["b"] == ("skipped", "ValueError: broken") and got["c"] == ("failed", "PermissionError: denied") and got["d"] == ("skipped", "exists")
    assert not (tmp_path / "a.heic").exists() and (tmp_path / "a.jpg").exists() and (tmp_path / "b.HEIC").exists()
    assert files.outcome_counts(files.conversion_results(plan, done)).first().asDict() == {"converted": 1, "skipped": 2, "failed": 1, "total": 4}
    acts = files.conversion_actions(plan).collect()
    assert [a.action for a in acts].count("delete") == 3 and [a.action for a in acts].count("scan") == 1
    assert files.conversion_actions(plan.limit(0)).count() == 0
    assert files.conversion_results(plan, done.limit(0)).filter("reason = 'not_run'").count() == 3


def test_digests_in_chunks(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"ab" * 100_000)
    got = {r.path: r for r in files.chunked_digests(spark.createDataFrame([(str(tmp_path / "x"),), (str(tmp_path / "y"),)], "path string"), 1000).collect()}
    assert got[str(tmp_path / "x")].file_hash == __import__("hashlib").sha256(b"ab" * 100_000).hexdigest() and got[str(tmp_path / "x")].file_size == 200_000
    assert got[str(tmp_path / "y")].file_hash is None and got[str(tmp_path / "y")].error


def test_packages(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name / "sub").mkdir(parents=True)
        (tmp_path / name / f"{name}.yml").write_text(f'name: "{name.title()}"\nversion: 1.0\n')
        (tmp_path / name / "sub" / "code.py").write_text("x = 1")
    first, again = ({r.id: r for r in files.packed(spark, str(tmp_path)).collect()} for _ in range(2))
    assert {i: r.sha256 for i, r in first.items()} == {i: r.sha256 for i, r in again.items()} and len(first) == 2
    with zipfile.ZipFile(__import__("io").BytesIO(bytes(first["two"].content))) as z:
        assert z.namelist() == ["sub/code.py", "two.yml"]
    index = files.package_index(files.packed(spark, str(tmp_path)).withColumn("revision", F.lit("abc")))
    assert rows_of(index, "id", "name", "version") == [("one", "One", "1.0-abc"), ("two", "Two", "1.0-abc")]
    assert rows_of(files.manifests(spark, str(tmp_path)), "id") == [("one",), ("two",)]


def test_setting(spark, tmp_path):
    (tmp_path / "c.yml").write_text("a: 1\n  key_of: 'x:y'\nkey_of: z\n")
    lines = spark.read.text(str(tmp_path / "c.yml"))
    assert files.setting(lines, "key_of").first().value == "x:y" and files.setting(lines, "none").first().value is None


def test_missing_root_warns(spark, tmp_path):
    with pytest.warns(UserWarning, match="no such folder"):
        assert files.list_files(spark, [str(tmp_path / "gone")]).count() == 0


def test_log_lines(spark):
    row = spark.range(1).select(log_line(F.lit("i"), F.lit("hello")).alias("a"), progress_line(F.lit(1.5)).alias("b"), progress_line(F.lit(-1.0)).alias("c")).first()
    assert tuple(row) == ("\x01i\x02hello", "\x01p\x021.0", "\x01p\x020.0")


def test_numbered(spark):
    rows = numbered(spark.createDataFrame([(c,) for c in "qwertyuiop"], "v string").repartition(4), "v", "n", 5)
    assert rows_of(rows, "n", "v") == sorted([(i + 5, c) for i, c in enumerate(sorted("qwertyuiop"))], key=repr)
    assert numbered(spark.createDataFrame([], "v string"), "v", "n").count() == 0


def test_reconciled_groups(spark):
    grp = groups(spark, [(1, "dedup:group:0001", at(1)), (2, "dedup:group:0002", at(1)), (3, "dedup:group:0003", at(1)), (4, "dedup:group:0004", at(1))]).withColumn("resolved", F.lit(1))
    mem = members(spark, [(1, 10), (2, 20), (3, 30), (3, 31), (4, 40), (None, 1), (2, None)])
    comps = spark.createDataFrame([(10, 10), (20, 10), (30, 30), (31, 30), (40, 40), (41, 40), (50, 50), (51, 50)], "image_id bigint, root bigint")
    after, left = G.reconciled_groups(grp, comps, mem)
    assert rows_of(after, "group_id", "resolved", "state") == [(1, 0, "merged"), (2, 1, "deleted"), (3, 1, "kept"), (4, 0, "extended"), (5, 0, "created")]
    assert rows_of(left, "group_id", "image_id") == [(1, 10), (1, 20), (3, 30), (3, 31), (4, 40), (4, 41), (5, 50), (5, 51)]


def test_removed_tags_and_failed_deletes(spark):
    lib = R.library_images(images(spark, [(str(i), {"visual_files": [("p", i, i, i)], "tags": [("5", "g one")] if i < 4 else None}) for i in range(1, 6)]))
    grp, mem = groups(spark, [(1, "g one", at(1))]), members(spark, [(1, i) for i in range(1, 6)])
    plan = R.resolve_plan(R.open_members(grp, mem, lib))
    assert rows_of(plan, "image_id", "action") == [(1, "delete"), (2, "delete"), (3, "keep")]  # the larger ones lost the tag
    assert R.open_members(grp, mem, lib, honour_tag_removal=False).count() == 5
    told = lambda *r: spark.createDataFrame(list(r), "image_id bigint, deleted boolean")
    assert store.completed_groups(plan, told((1, True), (2, True))).count() == 1
    assert store.completed_groups(plan, told((1, True), (2, False))).count() == store.completed_groups(plan, told((1, True))).count() == 0


def test_streamed_groups_over_replaced_and_late_rows(spark):
    """After each file the groups are those of the whole log so far, also where a later file brings an older row or replaces one."""
    folder = shared_folder(spark)
    far = [0, -1, 0x0F0F0F0F0F0F0F0F, 0x00FF00FF00FF00FF]
    log = [
        [fingerprint(1, 1, far[0], far[0], at(3)), fingerprint(2, 2, 1, 1, at(3)), fingerprint(3, 3, far[1], far[1], at(3)), fingerprint(9, None, far[2], far[2], at(1))],
        [fingerprint(2, 4, far[2], far[2], at(4)), fingerprint(1, 9, far[1], far[1], at(1)), fingerprint(4, 3, far[3], far[3], at(1)), fingerprint(4, 3, far[3], far[3], at(1))],
        [fingerprint(5, 5, 3, 3, at(1)), fingerprint(4, 7, 2, 2, at(5)), fingerprint(None, 1, 0, 0, at(1)), fingerprint(6, 6, None, None, at(1))],
    ]
    for i, rows in enumerate(log):
        crowded(fingerprints(spark, rows)).select(*fingerprints(spark, rows).columns).coalesce(1).write.mode("append").parquet(f"{folder}/log")
        got = rows_of(hooks.streamed_groups(spark, f"{folder}/log", f"{folder}/state"), "image_id", "root")
        assert got == rows_of(G.duplicate_groups(fingerprints(spark, [r for part in log[: i + 1] for r in part])), "image_id", "root"), i


def test_item_events_and_waiting(spark):
    ev = events(spark, [("Scene.Create.Post", " 07", at(1)), ("Image.Create.Post", "8", at(1)), ("Image.Update.Post", "9", at(1)), ("Scene.Create.Post", "x", at(1)), (None, "1", at(1))])
    assert rows_of(hooks.item_events(ev), "item_id") == [("image:8",), ("scene:7",)]
    asked = []
    assert hooks.wait_until(lambda: asked.append(1) or len(asked) > 2, every=0.01, timeout=5) and len(asked) == 3
    assert not hooks.wait_until(lambda: False, every=0.01, timeout=0.05)

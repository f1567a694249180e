import random

import numpy as np
import pandas as pd
from helpers import at, fingerprint, fingerprints, groups, images, members, rows_of
from pyspark.sql import functions as F

from lumaframe.operators import groups as G
from lumaframe.operators import resolve as R
from lumaframe.operators.components import components
from lumaframe.operators.current import current_fingerprints
from lumaframe.operators.similarity import exact_classes, hash_classes, matches_of, near_classes
from lumaframe.sources import store


def test_current_row(spark):
    log = fingerprints(spark, [fingerprint(1, 1, created=at(1)), fingerprint(1, 2, created=at(3)), fingerprint(1, 2, created=at(3)), fingerprint(2, 3, created=None)])
    log = log.union(fingerprints(spark, [(3, None, None, None, None, None, None, None)]))
    got = {r.image_id: r.created_at for r in current_fingerprints(log, "digest", "dhash_full").collect()}
    assert got[1] == at(3) and got[3] is None and len(got) == 3


def _hashes(n=120, seed=3):
    r = random.Random(seed)
    base = [r.getrandbits(64) for _ in range(n // 4)]
    out = []
    for i in range(n):
        h = base[i % len(base)]
        for _ in range(r.randrange(0, 14)):
            h ^= 1 << r.randrange(64)
        out.append(h - 2**64 if h >= 2**63 else h)
    return out


def _distance(a, b):
    return bin((a ^ b) & (2**64 - 1)).count("1")


def _log(spark):
    h = _hashes()
    rows = [fingerprint(i, i // 2, h[i], h[(i * 7) % len(h)]) for i in range(len(h))]
    return rows, fingerprints(spark, rows + rows[:5] + [(900, None, None, None, None, None, None, at(1))])


def test_near_classes_against_all_pairs(spark):
    rows, log = _log(spark)
    for t in (2, 4, 8, 10):
        want = set()
        for i, a in enumerate(rows):
            for b in rows[i + 1 :]:
                d = min(_distance(a[2], b[2]), _distance(a[3], b[3]), _distance(a[2], b[3]), _distance(a[3], b[2]))
                if d <= t:
                    want.add((a[0], b[0], d))
        got = rows_of(near_classes(hash_classes(log), t), "class_a", "class_b", "distance")
        assert len(got) == len(set(got)) and set(got) == want


def test_near_classes_meet_few_others(spark):
    """Hashes that differ in some 32 bits aren't compared: all that is sent grows with the classes, not with their pairs."""
    rng = np.random.default_rng(7)
    h = rng.integers(-(2**63), 2**63, 20_000)
    classes = spark.createDataFrame(pd.DataFrame({"class_id": np.arange(20_000), "full": h, "crop": h}))
    for t in (4, 10):
        near = near_classes(classes, t)
        x, y = (h[i] for i in np.triu_indices(2_000, 1))
        among = near.filter("class_a < 2000 AND class_b < 2000").count()
        assert among == int((np.bitwise_count(x ^ y) <= t).sum())
        plan = near._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" not in plan and "Broadcast" not in plan  # neither tiles of all pairs nor buckets of bands


def test_groups_without_pairs_of_copies(spark, monkeypatch):
    """Images with a hash in common hang on the least of them, however many, whatever their files."""
    edges = []
    monkeypatch.setattr(G, "components", lambda e: edges.append(e.count()) or components(e))
    rows = [fingerprint(i, i, 0) for i in range(1, 200)] + [fingerprint(900, 900, -1, -1), fingerprint(901, 901, -1 << 8, None), fingerprint(902, 5, 0x0F0F0F0F << 32, None)]
    got = {r.image_id: r.root for r in G.duplicate_groups(fingerprints(spark, rows)).collect()}
    assert got == {i: 1 for i in range(1, 200)} | {900: 900, 901: 900, 902: 1}
    assert edges[0] < 5 * len(rows)  # not their 19,701 pairs


def test_exact_classes(spark):
    _, log = _log(spark)
    got = {r.image_id: (r.class_id, r.n_images) for r in exact_classes(log).collect()}
    assert got[0] == got[1] == (0, 2) and 900 not in got


def test_boundary_of_threshold(spark):
    log = fingerprints(spark, [fingerprint(1, 1, 0), fingerprint(2, 2, (1 << 10) - 1), fingerprint(3, 3, ((1 << 11) - 1) << 20)])
    assert rows_of(near_classes(hash_classes(log), 10), "class_a", "class_b") == [(1, 2)]


def test_matches(spark):
    rows, log = _log(spark)
    cur = current_fingerprints(log, "digest", "dhash_full", "dhash_crop").select("image_id", "digest", F.col("dhash_full").alias("full"), F.col("dhash_crop").alias("crop"))
    got = {(r.query_id, r.image_id) for r in matches_of(cur.filter("image_id % 50 = 0"), cur, 10).collect()}
    want = set()
    for a in rows:
        for b in rows:
            d = min(_distance(a[2], b[2]), _distance(a[3], b[3]), _distance(a[2], b[3]), _distance(a[3], b[2]))
            if a[0] % 50 == 0 and a[0] != b[0] and (a[1] == b[1] or d <= 10):
                want.add((a[0], b[0]))
    assert got == want


def test_matches_meet_few_others(spark):
    rng = np.random.default_rng(8)
    h = rng.integers(-(2**63), 2**63, 5_000)
    h[1::2] = h[::2] ^ np.int64(0x3FF)  # ten bits away
    rows = spark.createDataFrame(pd.DataFrame({"image_id": np.arange(5_000), "full": h, "crop": h ^ 1})).withColumn("digest", F.when(F.col("image_id") % 50 == 7, F.lit(b"one")))
    got = matches_of(rows.filter("image_id % 50 = 0 OR image_id = 7"), rows.unionByName(rows.limit(0)), 10)
    near = {(r.query_id, r.image_id): r.distance for r in got.collect()}
    assert {q: near.pop((q, q + 1)) for q in range(0, 5_000, 50)} == dict.fromkeys(range(0, 5_000, 50), 9)  # full and crop
    assert near.pop((7, 6)) == 9 and set(near) == {(7, i) for i in range(57, 5_000, 50)}  # the same file, however far
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" not in plan and "Broadcast" not in plan  # no grid of all queries and all rows


def test_matches_carry_their_groups(spark):
    """A picture with many copies: counted by group as the pairs are made, which are never shuffled to be looked up."""
    rows = current_fingerprints(fingerprints(spark, [fingerprint(i, 1, 5) for i in range(1, 301)] + [fingerprint(950, 9, -1)]), "digest", "dhash_full", "dhash_crop")
    rows = rows.select("image_id", "digest", F.col("dhash_full").alias("full"), F.col("dhash_crop").alias("crop"))
    held = members(spark, [(7, 1), (8, 1), (8, 2), (9, 9), (None, 3)])
    queries = rows.filter("image_id % 50 = 0")
    grouped = rows.join(G.first_groups(held), "image_id", "left")
    got = G.grouped_actions(matches_of(queries, grouped, carry=("group_id",)))
    assert rows_of(got) == rows_of(G.probe_actions(matches_of(queries, rows), held)) == [(q, "merge", [7, 8, 9], 299) for q in (100, 150, 200, 250, 300, 50)]


def test_components_of_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(7, i) for i in range(200, 230)]
    got = dict(rows_of(components(spark.createDataFrame(chain + star + [(5, 5)], "a bigint, b bigint")), "id", "root"))
    assert {got[i] for i in range(100, 141)} == {100} and {got[i] for i in range(200, 230)} == {7} and 5 not in got
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_transitive_groups(spark):
    log = fingerprints(spark, [fingerprint(1, 1, 0), fingerprint(2, 2, 255), fingerprint(3, 3, 65535), fingerprint(4, 4, -1), fingerprint(5, 4, 1 << 40)])
    got = dict(rows_of(G.duplicate_groups(log, 8), "image_id", "root"))
    assert got[1] == got[2] == got[3] == 1 and got[4] == got[5]
    named = rows_of(G.named_groups(G.duplicate_groups(log, 8)), "group_id", "tag_name")
    assert named[0] == (1, "dedup:group:0001")


def test_group_actions(spark):
    comp = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 5), (8, 8), (9, 8)], "image_id bigint, root bigint")
    held = members(spark, [(10, 3), (11, 5), (12, 6), (12, 7), (13, 8), (13, 9)])
    acts = {r.root: (r.action, r.group_id, r.n_new, r.merged) for r in G.group_actions(comp, held).collect()}
    assert acts == {1: ("create", None, 2, []), 3: ("extend", 10, 1, []), 5: ("merge", 11, 0, [12])}
    after = set(rows_of(G.updated_members(comp, held, 20), "group_id", "image_id"))
    assert after == {(20, 1), (20, 2), (10, 3), (10, 4), (11, 5), (11, 6), (11, 7), (13, 8), (13, 9)}


def test_probe_actions(spark):
    hits = spark.createDataFrame([(1, 2), (1, 3), (4, 5), (6, 7), (6, 8)], "query_id bigint, image_id bigint")
    held = members(spark, [(10, 2), (11, 7), (12, 8)])
    assert rows_of(G.probe_actions(hits, held), "query_id", "action") == [(1, "existing"), (4, "new"), (6, "merge")]


def _library(spark):
    tag = lambda *n: [(x.split("/")[0], x.split("/")[-1]) for x in n]
    file = lambda w, h, s: [(None, None, None, None), ("p", w, h, s)]
    return images(
        spark,
        [
            ("1", {"visual_files": file(10, 10, 5), "tags": tag("7/T1", "9/dedup:group:0001", "1/auto:dedup"), "performers": tag("31/A", "4/B"), "rating100": 60, "galleries": tag("1/X")}),
            ("2", {"visual_files": file(20, 10, 5), "tags": tag("7/T1", "8/T2"), "performers": tag("5/C"), "rating100": 0, "galleries": tag("2/Y")}),
            ("3", {"visual_files": file(10, 20, 9), "rating100": 100}),
            ("4", {"visual_files": None}),
            ("5", {"visual_files": file(1, 1, 1)}),
            ("5", {"visual_files": file(1, 1, 1)}),
        ],
    )


def test_resolve(spark):
    grp = groups(spark, [(1, "dedup:group:0001", at(1)), (2, "dedup:group:0002", at(1)), (3, "dedup:group:0003", at(1))])
    mem = members(spark, [(1, 1), (1, 2), (1, 3), (1, 3), (2, 4), (2, 5), (3, 5), (3, 404)])
    lib = R.library_images(_library(spark))
    rows = R.open_members(grp, mem, lib, honour_tag_removal=False)
    assert rows_of(R.keepers(rows), "group_id", "keeper_id") == [(1, 3), (2, 5)]  # group 3 has one image left
    m = {r.group_id: r for r in R.merged_metadata(rows).collect()}
    assert m[1].performer_ids == ["31", "4", "5"] and m[1].tag_ids == ["1", "7", "8"] and m[1].gallery_ids == ["1", "2"] and m[1].rating100 == 100
    assert m[2].rating100 is None
    assert rows_of(R.missing_galleries(rows, R.keepers(rows), R.merged_metadata(rows)), "keeper_id", "gallery_id") == [(3, "1"), (3, "2")]
    plan = R.resolve_plan(rows)
    assert rows_of(plan.filter("action = 'delete'"), "image_id") == [(1,), (2,), (4,)]
    assert R.resolve_counts(plan).first().asDict() == {"groups": 2, "kept": 2, "deleted": 3}
    preview = {r.group_id: (r.performers, r.tags) for r in R.resolve_preview(rows).collect()}
    assert preview == {1: ("A, B, C", "T1, T2"), 2: ("", "")}
    assert rows_of(R.open_members(grp, mem, lib, honour_tag_removal=True), "group_id", "image_id") == [(1, 1)]


def test_ties_of_keepers(spark):
    file = lambda s: [("p", 10, 10, s)]
    lib = R.library_images(images(spark, [("1", {"visual_files": file(5)}), ("2", {"visual_files": file(6)}), ("3", {"visual_files": file(6)})]))
    rows = R.open_members(groups(spark, [(1, "t", at(1))]), members(spark, [(1, 1), (1, 2), (1, 3)]), lib, honour_tag_removal=False)
    assert rows_of(R.keepers(rows), "keeper_id") == [(2,)]


def test_store(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "d")], "k bigint, v string")
    assert rows_of(store.upsert(old, new.distinct(), "k")) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows_of(store.insert_ignore(old, new, "k")) == [(1, "a"), (2, "b"), (3, "d")]
    kept, left = store.delete_cascading(old, new, spark.createDataFrame([(2,)], "k bigint"), "k")
    assert rows_of(kept, "k") == [(1,)] and rows_of(left, "k") == [(3,), (3,)]
    assert rows_of(store.patch(old, spark.createDataFrame([(1, "z"), (2, None)], "k bigint, v string"), "k")) == [(1, "z"), (2, "b")]
    known = spark.createDataFrame([("5", "Abc")], "id string, name string")
    got = store.get_or_create(spark.createDataFrame([("ABC",), ("new",), ("NEW",), (None,)], "name string"), known, 9)
    assert rows_of(got, "name", "id", "made") == [("ABC", "5", False), ("NEW", "9", True), ("new", "9", True)]
    assert store.next_group_id(groups(spark, [])).first().next_id == 1
    store.write_snapshot(old, str(tmp_path / "s"), 1)
    assert store.read_snapshot(spark, str(tmp_path / "s"), 1).count() == 2
    assert {n: t.count() for n, t in store.empty_store(spark).items()} == {"fingerprints": 0, "dup_groups": 0, "group_members": 0}
    assert rows_of(store.mark_resolved(groups(spark, [(1, "a", at(1)), (2, "b", at(1))]), members(spark, [(2, 1)])), "group_id", "resolved") == [(1, 0), (2, 1)]


def test_size_classes(spark):
    got = G.size_classes(groups(spark, [(1, "a", at(1)), (2, "b", at(1)), (3, "c", at(1))]), members(spark, [(1, 1), (1, 1), (2, 1), (2, 2)]))
    assert rows_of(got, "size_class", "n_groups") == [("empty", 1), ("several", 1), ("single", 1)]


def test_growing_reopens_a_resolved_group(spark):
    from helpers import at, images, members, rows_of

    from lumaframe import schemas
    from lumaframe.operators import groups as G
    from lumaframe.operators.resolve import open_members

    held = members(spark, [(1, 10), (1, 11), (2, 20), (2, 21), (3, 30), (3, 31), (4, 40), (4, 41)])
    known = spark.createDataFrame([(g, f"t{g}", done, at(1)) for g, done in ((1, 1), (2, 1), (3, 0), (4, 1))], schemas.DUP_GROUP)
    found = [(10, 10), (11, 10), (12, 10), (20, 20), (21, 20), (30, 20), (31, 20), (40, 40), (41, 40), (50, 50), (51, 50)]
    comps = spark.createDataFrame(found, "image_id bigint, root bigint")
    now = G.reopened_groups(known, G.group_actions(comps, held))
    assert now.columns == known.columns and rows_of(now, "group_id", "resolved") == [(1, 0), (2, 0), (3, 0), (4, 1)]
    library = images(spark, [(str(i), {}) for i, _ in found]).withColumnRenamed("id", "image").selectExpr("cast(image as bigint) AS image_id", "tags")
    waiting = rows_of(open_members(now, G.updated_members(comps, held, 5), library, honour_tag_removal=False), "group_id", "image_id")
    assert waiting == [(1, 10), (1, 11), (1, 12), (2, 20), (2, 21), (2, 30), (2, 31)]

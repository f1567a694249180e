from helpers import at, crowded, events, fingerprint, fingerprints, groups, images, members, rows_of

from lumaframe.operators.references import broken_reference_report, broken_references


def _tables(spark):
    prints = fingerprints(
        spark,
        [
            fingerprint(1, created=at(2)),  # sound
            fingerprint(2, created=at(2)),  # deleted
            fingerprint(3, created=at(3)),  # missing
            fingerprint(4, created=at(1)),  # late: created after
            fingerprint(4, created=at(1)),  # repeated row
            fingerprint(5, created=at(1)),  # destroyed and created again
            fingerprint(6, created=at(1)),
            fingerprint(6, created=at(4)),  # the current one is late no more
            fingerprint(None, created=at(1)),
            (7, None, None, None, None, None, None, None),
        ],
    )
    lib = images(spark, [("1", {}), (" 0002", {}), ("4", {}), ("4", {}), ("5", {}), ("6", {}), ("x7", {}), (None, {})])
    hooks = events(
        spark,
        [
            ("Image.Create.Post", "1", at(1)),
            ("Image.Create.Post", "2", at(1)),
            ("Image.Destroy.Post", "02", at(5)),
            ("Image.Destroy.Post", "2 ", at(5)),
            ("Image.Update.Post", "2", at(6)),
            ("Image.Create.Post", "4", at(2)),
            ("Image.Create.Post", "4", at(6)),
            ("Image.Destroy.Post", "5", at(2)),
            ("Image.Create.Post", "5", at(3)),
            ("Image.Create.Post", "6", at(3)),
            ("Scene.Destroy.Post", "1", at(9)),
            ("Image.Destroy.Post", None, at(9)),
            (None, "1", None),
        ],
    )
    mem = members(spark, [(1, 1), (1, 99), (1, 99), (2, 98), (3, 97), (None, 96), (1, None)])
    grp = groups(spark, [(1, "a", at(7)), (2, None, at(8))])
    hooks = hooks.union(events(spark, [("Image.Create.Post", "98", at(1)), ("Image.Destroy.Post", "98", at(2))]))
    return prints, lib, hooks, mem, grp


EXPECTED = [
    ("fingerprints", 2, 0, "2024-02", "deleted"),
    ("fingerprints", 3, 0, "2024-03", "missing"),
    ("fingerprints", 4, 0, "2024-01", "late"),
    ("fingerprints", 5, 0, "2024-01", "late"),
    ("fingerprints", 7, 0, None, "missing"),
    ("group_members", 99, 1, "2024-07", "missing"),
    ("group_members", 98, 2, "2024-08", "deleted"),
    ("group_members", 97, 3, None, "missing"),
    ("group_members", 96, None, None, "missing"),
]


def test_states(spark):
    assert rows_of(broken_references(*_tables(spark)), "child", "image_id", "group_id", "period", "state") == sorted(EXPECTED, key=repr)


def test_clashing_columns(spark):
    found = broken_references(*map(crowded, _tables(spark)))
    assert rows_of(found, "child", "image_id", "group_id", "period", "state") == sorted(EXPECTED, key=repr)


def test_empty_tables(spark):
    tables = _tables(spark)
    empty = [t.limit(0) for t in tables]
    assert broken_references(*empty).count() == 0
    no_parents = broken_references(tables[0], empty[1], empty[2], tables[3], empty[4])
    assert {r.state for r in no_parents.collect()} == {"missing"}


def test_report(spark):
    report = rows_of(broken_reference_report(broken_references(*_tables(spark))), "child", "period", "state", "n_references")
    assert ("fingerprints", "2024-01", "late", 2) in report


def test_hot_parent(spark):
    mem = members(spark, [(g, 5) for g in range(300)] + [(g, 1000 + g) for g in range(100)])
    prints = fingerprints(spark, [fingerprint(5)])
    found = broken_references(prints, images(spark, [("5", {})]), events(spark, []), mem, groups(spark, []))
    assert found.filter("child = 'group_members'").count() == 100


def test_merge_is_planned(spark):
    from lumaframe.operators.references import broken_references as f

    plan = f(*_tables(spark))._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan

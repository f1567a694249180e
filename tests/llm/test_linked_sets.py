import random

import pytest
from helpers import at, crowded, groups, members, rows_of

from lumaframe.llm import linked_sets
from lumaframe.llm.linked_sets import connected, linked_images


def union_find(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("few", [0, 60, linked_sets.FEW_EDGES])
def test_chain_star_and_random(spark, monkeypatch, few):
    """On the cluster to the end, from some level on in one task, and in one task from the start."""
    monkeypatch.setattr(linked_sets, "FEW_EDGES", few)
    r = random.Random(2)
    pairs = [(i, i + 1) for i in range(1000, 1060)] + [(7, i) for i in range(2000, 2060)] + [(r.randrange(3000, 3060), r.randrange(3000, 3060)) for _ in range(40)]
    want = {x: c for x, c in union_find([p for p in pairs if p[0] != p[1]]).items()}
    assert dict(rows_of(connected(spark.createDataFrame(pairs + [(5, 5)], "a bigint, b bigint")), "v", "root")) == want


def test_groups_and_tags(spark):
    mem = members(spark, [(1, 10), (1, 11), (1, 11), (2, 11), (2, 5), (3, 20), (4, 21), (5, 30), (6, 31), (7, 40), (None, 50), (8, None), (9, 60), (9, 61)])
    grp = groups(
        spark,
        [(3, "dedup:group:0012", at(1)), (4, " DEDUP: group: 12", at(1)), (5, "none", at(1)), (6, None, at(1)), (7, "", at(1)), (9, "dedup:group:0", at(1)), (9, "dedup:group:00", at(2)), (2, "dedup:group:002", at(1)), (77, "x5", at(1))],
    )
    want = [(5, 5), (10, 5), (11, 5), (20, 20), (21, 20), (30, 30), (31, 31), (40, 40), (50, 50), (60, 60), (61, 60)]
    assert rows_of(linked_images(mem, grp), "image_id", "root_id") == sorted(want, key=repr)
    assert rows_of(linked_images(crowded(mem), crowded(grp)), "image_id", "root_id") == sorted(want, key=repr)


def test_group_with_several_tags_joins_them(spark):
    mem = members(spark, [(1, 1), (2, 2), (3, 3)])
    grp = groups(spark, [(1, "a1", at(1)), (2, "a2", at(1)), (3, "a1", at(1)), (3, "a2", at(2))])
    assert rows_of(linked_images(mem, grp), "image_id", "root_id") == [(1, 1), (2, 1), (3, 1)]


def test_hot_group_and_empty(spark):
    mem = members(spark, [(1, i) for i in range(300)] + [(i, 1000 + i) for i in range(2, 40)])
    got = dict(rows_of(linked_images(mem, groups(spark, [])), "image_id", "root_id"))
    assert {got[i] for i in range(300)} == {0} and got[1002] == 1002
    assert linked_images(members(spark, []), groups(spark, [])).count() == 0

import random

import numpy as np
import pytest
from helpers import at, crowded, fingerprint, fingerprints, rows_of

from lumaframe.llm import batches as B
from lumaframe.session import shared_folder


def distance(a, b):
    return bin((a ^ b) & (2**64 - 1)).count("1")


def brute(rows, radius=3):
    """rows: image_id, digest, full, month."""
    accepted, cases = [], set()
    for m in sorted({r[3] for r in rows if r[3] is not None}):
        fresh = []
        for i, d, f, _ in (r for r in rows if r[3] == m):
            hit = any((d is not None and d == x) or (f is not None and y is not None and distance(f, y) <= radius) for x, y in accepted)
            if hit:
                cases.add((i,))
            else:
                fresh.append((d, f))
        accepted += fresh
    return cases


def library(seed):
    r = random.Random(seed)
    base = [r.getrandbits(64) for _ in range(25)]
    rows = []
    for i in range(140):
        h = r.choice(base)
        for _ in range(r.randrange(0, 7)):
            h ^= 1 << r.randrange(64)
        rows.append(fingerprint(i, r.randrange(100), h - 2**64 if h >= 2**63 else h, 0, at(r.randrange(1, 5), r.randrange(1, 28))))
    rows += [fingerprint(1000 + i, 777, 0, 0, at(1 + i % 4)) for i in range(70)]
    rows += [(2000, None, 0, 0, 1, 1, 1, at(2)), (2001, None, None, 0, 1, 1, 1, at(3)), (2002, f"{777:064X} ", None, 0, 1, 1, 1, at(3)), (2003, f"{777:064x}", 5, 0, 1, 1, 1, None)]
    return rows


def plain(rows):
    return [(r[0], None if r[1] is None else r[1].strip().lower(), r[2], None if r[7] is None else r[7].month) for r in rows]


@pytest.mark.parametrize("hot", [False, True])
def test_against_brute_force(spark, monkeypatch, hot):
    if hot:  # cells are merged after every second batch and dealt as soon as they hold a few records; batches are probed in two parts
        for name, value in (("MERGE_AFTER", 2), ("DEAL", 3), ("PART", 20), ("SPLIT", 40), ("SMALL", 60)):
            monkeypatch.setattr(B, name, value)
    rows = library(6 + hot)
    df = fingerprints(spark, rows + rows[:7] + [fingerprint(None, 1, 0)])
    got = rows_of(B.repeated_images(crowded(df)), "image_id")
    assert len(got) == len(set(got)) and set(got) == brute(plain(rows))


def test_same_month_is_not_compared(spark):
    df = fingerprints(spark, [fingerprint(1, 1, 0, 0, at(1)), fingerprint(2, 1, 0, 0, at(1, 9)), fingerprint(3, 2, 7, 0, at(2)), fingerprint(4, 3, 15, 0, at(2))])
    assert rows_of(B.repeated_images(df)) == [(3,)]  # three bits differ; four are too many


def test_cases_are_not_accepted(spark):
    far = (1 << 6) - 1  # six bits from the first, three from the second
    df = fingerprints(spark, [fingerprint(1, 1, 0, 0, at(1)), fingerprint(2, 2, 7, 0, at(2)), fingerprint(3, 3, far, 0, at(3))])
    assert rows_of(B.repeated_images(df)) == [(2,)]


def test_empty_and_one_month(spark):
    assert B.repeated_images(fingerprints(spark, [])).count() == 0
    assert B.repeated_images(fingerprints(spark, [fingerprint(1), fingerprint(2)])).count() == 0


def rows(spark, *r):
    return spark.createDataFrame(list(r), "key bigint, hash bigint, digest binary")


def test_index_is_kept(spark):
    """A second session goes on from the stored cells; a batch taken before changes nothing; the nearest record comes out."""
    folder = shared_folder(spark)
    first = rows(spark, (1, 0, b"a"), (2, -1, None), (9, 0, b"z"))
    index = B.CellIndex.create(spark, f"{folder}/accepted", first, 100)
    assert B.take_batch(index, first, 3, f"{folder}/taken", "one").count() == 0
    index.close()
    index = B.CellIndex.open(spark, f"{folder}/accepted")
    second = rows(spark, (3, 7, b"b"), (4, 255, b"c"), (5, None, b"a"), (6, 1, b"z"), (7, None, None))
    want = [(3, 1, 3, False), (5, 1, None, True), (6, 9, 1, True)]
    assert rows_of(B.take_batch(index, second, 3, f"{folder}/taken", "two"), "key", "near", "distance", "same_file") == want
    assert rows_of(B.take_batch(index, second, 3, f"{folder}/taken", "two"), "key", "near", "distance", "same_file") == want  # not all repeats of themselves
    index.merge()
    index.close()
    index = B.CellIndex.open(spark, f"{folder}/accepted")
    assert index.taken("one") and index.taken("two") and not index.taken("three")
    assert rows_of(B.take_batch(index, rows(spark, (10, 254, None), (11, 7, b"c")), 3, f"{folder}/taken", "three"), "key", "near", "distance", "same_file") == [(10, 4, 1, False), (11, 4, 3, True)]
    index.close()


def test_failed_append_is_not_read(spark):
    folder = shared_folder(spark)
    index = B.CellIndex.create(spark, f"{folder}/accepted", rows(spark, (1, 0, b"a")), 100)
    index.append(rows(spark, (1, 0, b"a")), "one")
    state = dict(index.state, batches=["one"])
    index.append(rows(spark, (2, 255, b"b")), "two")
    index.state = state  # as if the state of batch two had not been written
    assert index.matches(rows(spark, (3, 255, b"b")), 3, folder, "m").count() == 0


@pytest.mark.parametrize("radius", [0, 3, 10, 20])
def test_any_radius_against_brute_force(spark, radius):
    r = np.random.default_rng(radius)
    base = r.integers(0, 2**64, 30, dtype=np.uint64)
    noisy = lambda n: base[r.integers(0, 30, n)] ^ np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, (n, 12), dtype=np.uint64) * (r.random((n, 12)) < 0.5).astype(np.uint64), axis=1)
    old, new = noisy(300), noisy(120)
    folder = shared_folder(spark)
    df = lambda v, at: rows(spark, *((at + i, int(h), None) for i, h in enumerate(v.view(np.int64))))
    index = B.CellIndex.create(spark, f"{folder}/accepted", df(old, 0), 300)
    assert len(index.centers) > 8
    index.append(df(old, 0), "one")
    got = {x.hash: (x.distance, x.near) for x in index.matches(df(new, 1000), radius, folder, "m").collect()}
    d = np.bitwise_count(new[:, None] ^ old[None, :]).astype(int)
    want = {int(h): (int(row.min()), int(np.flatnonzero(row == row.min())[0])) for h, row in zip(new.view(np.int64), d) if row.min() <= radius}
    assert got == want


def test_bounds_hold():
    r = np.random.default_rng(5)
    v = r.integers(0, 2**64, 400, dtype=np.uint64)
    centers = B.train(v, 16)
    cell, ring = B.assign(v, centers)
    low, high = np.full(len(centers), 99), np.full(len(centers), -1)
    np.minimum.at(low, cell, ring), np.maximum.at(high, cell, ring)
    q = r.integers(0, 2**64, 50, dtype=np.uint64)
    bound = B.bounds(np.bitwise_count(q[:, None] ^ centers[None, :]).astype(int), low, high)
    for c in np.unique(cell):
        assert (np.bitwise_count(q[:, None] ^ v[cell == c][None, :]).min(axis=1) >= bound[:, c]).all()


def test_history_is_not_shuffled(spark):
    folder = shared_folder(spark)
    batch = rows(spark, (1, 0, b"a"))
    index = B.CellIndex.create(spark, f"{folder}/accepted", batch, 100)
    index.append(batch, "one")
    sent = batch.selectExpr("true AS known", "hash", "digest").mapInPandas(index._router(3, True), B._SENT)
    found = sent.groupBy("part").cogroup(index._stored().groupBy("part")).applyInPandas(index._comparer(3, True), B._FOUND)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("hashpartitioning(part") == 1  # the batch's only


def test_large_cell_is_not_compared_in_whole(monkeypatch):
    """Of 20,000 hashes that lie in one cell a query meets those with a word alike, also where many have one; the nearest come out, the least id of equals."""
    r = np.random.default_rng(8)
    flip = lambda v, n: v ^ np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, (len(v), n), dtype=np.uint64), axis=1)
    stored = flip(np.zeros(20_000, np.uint64), 20)
    stored[:3000] &= np.uint64(0xFFFF)  # three words alike
    stored = np.unique(stored)
    stored = stored[np.argsort(np.bitwise_count(stored), kind="stable")]
    ids, q = r.permutation(len(stored)).astype(np.int64), np.concatenate([flip(stored[r.integers(0, len(stored), 3000)], 3), flip(np.zeros(3000, np.uint64), 20)])
    whole = np.array([[*min((int(d), int(i)) for d, i in zip(row[row <= 3], ids[row <= 3]))] if (row := np.bitwise_count(x ^ stored)).min() <= 3 else [99, 0] for x in q])
    compared, count = [0], np.bitwise_count

    def counted(x, *a, **k):
        compared[0] += x.size
        return count(x, *a, **k)

    monkeypatch.setattr(np, "bitwise_count", counted)
    at, far, near = B.nearest_in(q, stored, count(stored), ids, np.uint64(0), 3)
    assert compared[0] < len(q) * len(stored) / 10
    got = np.full((len(q), 2), [99, 0])
    got[at] = np.stack([far, near], axis=1)
    assert len(at) == len(set(at.tolist())) > 2500 and (got == whole).all()


def test_few_cells_and_parts(spark):
    """Each hash meets all centroids: their number doesn't grow with the root of the records, nor that of the parts with Spark's partitions."""
    first = spark.range(5000).selectExpr("xxhash64(id) AS hash")
    assert len(B.CellIndex.create(spark, shared_folder(spark), first, 100_000_000).centers) <= 512
    spark.conf.set("spark.sql.shuffle.partitions", "600")
    try:
        assert B.CellIndex.create(spark, shared_folder(spark), first, 1000).state["parts"] == 12
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_reached_as_bounded():
    r = np.random.default_rng(9)
    d, limit = r.integers(0, 65, (200, 40)).astype(np.uint8), r.integers(0, 100, 200)
    low, high = r.integers(0, 40, 40).astype(np.int16), r.integers(20, 65, 40).astype(np.int16)
    low[:5], high[:5] = 99, -1  # empty
    limit[:100] %= 4
    assert (B.reached(d, low, high, np.minimum(limit, 64)) == (B.bounds(d.astype(np.int16), low, high) <= np.minimum(limit, 64)[:, None])).all()


def test_other_layout_is_refused(spark):
    folder = shared_folder(spark)
    index = B.CellIndex.create(spark, folder, rows(spark, (1, 0, b"a")), 100)
    index.state["layout"] = 1
    index.save()
    with pytest.raises(ValueError, match="another version"):
        B.CellIndex.open(spark, folder)

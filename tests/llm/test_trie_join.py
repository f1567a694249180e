import random

import numpy as np
import pytest
from helpers import at, crowded, fingerprint, fingerprints, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st

from lumaframe.llm import trie_join as J


def signed(h):
    return h - 2**64 if h >= 2**63 else h


def family(n, seed=1, flips=9):
    r = random.Random(seed)
    base = [r.getrandbits(64) for _ in range(max(1, n // 4))]
    out = set()
    while len(out) < n:
        h = r.choice(base)
        for _ in range(r.randrange(flips)):
            h ^= 1 << r.randrange(64)
        out.add(h)
    return np.array(sorted(out), dtype=np.uint64)


def brute(v, budget):
    return {(i, int(i + 1 + j)) for i in range(len(v)) for j in np.flatnonzero(np.bitwise_count(v[i + 1 :] ^ v[i]) <= budget)}


@pytest.mark.parametrize("budget", [0, 1, 3, 6, 9])
def test_every_layout_finds_all_pairs_once(budget, monkeypatch):
    v = np.unique(np.concatenate([family(500), family(300, 2) & np.uint64(0xFFFF), family(300, 3) & np.uint64(0xFFFF00000000)]))
    want = brute(v, budget)
    for giant in (1 << 10, 1 << 40):
        monkeypatch.setattr(J, "GIANT_PAIRS", giant)
        for m in range(1, min(budget + 1, 6) + 1):
            edges = [round(i * 64 / m) for i in range(m + 1)]
            got = list(zip(*(x.tolist() for x in J.pairs_of(v, budget, J.cut([(a, b - a) for a, b in zip(edges, edges[1:])], budget)))))
            assert len(got) == len(set(got)) and set(got) == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=2, max_size=40, unique=True), st.integers(0, 12))
def test_any_values(values, budget):
    v = np.array(values, dtype=np.uint64)
    assert set(zip(*(x.tolist() for x in J.pairs_of(v, budget)))) == brute(v, budget)


def test_layout_shares_the_budget():
    for n in (10, 10**6, 10**9, 10**12):
        for budget in (0, 3, 6):
            parts = J.layout(n, budget)
            assert sum(p.budget + 1 for p in parts) == budget + 1 and sum(p.length for p in parts) == 64


@pytest.mark.parametrize("leaf", [24, 200, 10**6])
def test_plan_and_tasks(spark, monkeypatch, leaf):
    """Small leaves make many tasks, partners in several chunks, and nodes dealt into blocks."""
    monkeypatch.setattr(J, "LEAF_HASHES", leaf)
    v = np.unique(np.concatenate([family(300, 5), family(200, 6) & np.uint64(0xFF)]))
    got = rows_of(J.near_values(spark.createDataFrame([(signed(int(x)),) for x in v], "v bigint"), 6), "x", "y")
    want = {tuple(sorted((signed(int(v[i])), signed(int(v[j]))))) for i, j in brute(v, 6)}
    assert len(got) == len(set(got)) and set(got) == want


def brute_images(rows, budget=6):
    out = set()
    far = 99
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if a[1] is not None and a[1] == b[1]:
                continue
            d = min((bin((x ^ y) & (2**64 - 1)).count("1") if x is not None and y is not None else far) for x in a[2:4] for y in b[2:4])
            if d <= budget:
                out.add((min(a[0], b[0]), max(a[0], b[0])))
    return out


def library():
    v = [signed(int(x)) for x in family(160, 8)]
    r = random.Random(4)
    rows = [fingerprint(i, r.randrange(90), r.choice(v), r.choice(v)) for i in range(150)]
    rows += [fingerprint(1000 + i, 500, 0, 0) for i in range(75)]  # a third of all rows: one picture
    rows += [fingerprint(2000, 501, 3, 77), fingerprint(2001, 501, 0, 78), (2002, None, 0, 0, 1, 1, 1, at(1)), (2003, None, 0, None, 1, 1, 1, at(1)), (2004, "  ", None, None, 1, 1, 1, at(1))]
    rows += [fingerprint(2005, "sha256:" + f"{500:064x}", 1, 1), (2006, None, None, -1, None, None, None, None)]
    return rows


def test_images(spark):
    rows = library()
    plain = [(r[0], None if r[1] is None or not r[1].strip() else r[1].replace("sha256:", ""), r[2], r[3]) for r in rows]
    df = fingerprints(spark, rows + rows[:9] + [fingerprint(3, 900, 12345, 54321, at(1).replace(year=2023)), fingerprint(None, 1, 0)])
    want = brute_images(plain)
    assert set(rows_of(J.near_duplicate_images(df), "image_a", "image_b")) == want
    got = rows_of(J.near_duplicate_images(crowded(df)), "image_a", "image_b")
    assert len(got) == len(set(got)) and set(got) == want


def test_empty_and_single(spark):
    assert J.near_duplicate_images(fingerprints(spark, [])).count() == 0
    assert J.near_duplicate_images(fingerprints(spark, [fingerprint(1), fingerprint(1)])).count() == 0
    assert rows_of(J.near_duplicate_images(fingerprints(spark, [fingerprint(2, 1, 9), fingerprint(1, 2, 9)]))) == [(1, 2)]

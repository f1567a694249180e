from collections import defaultdict

import numpy as np
import pytest
from helpers import crowded, rows_of

from lumaframe.llm import mixing, packing
from lumaframe.llm.tokens import VOCABULARY, count_tokens, encoder

pytest.importorskip("tiktoken")
DOCS = "doc_id bigint, source string, text string"


def documents(spark):
    rows = [(i, ["Shop", "shop ", "my-app", "my app", None][i % 5], " ".join(f"word{j % 7} text" for j in range(1 + (i * 37) % 90))) for i in range(200)]
    rows += [(500, "shop", "long text, " * 3000), (501, "shop", None), (502, "shop", ""), (503, "shop", " "), (None, "shop", "no id"), (7, "shop", "a repeated id"), (504, None, "x")]
    return spark.createDataFrame(rows, DOCS)


def test_hilbert_curve_visits_neighbours():
    for d, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), axis=-1).reshape(-1, d)
        key = packing.hilbert_key(grid, bits)
        assert sorted(key) == list(range(len(grid)))
        path = grid[np.argsort(key)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("dress", [lambda x: x, crowded])
def test_packing_keeps_every_token_once(spark, dress):
    sizes = spark.createDataFrame([("s", 32), ("m", 100), ("m", 100), ("bad", 0), ("none", None), (None, 5)], "container string, capacity_tokens int")
    docs = documents(spark)
    rows = packing.pack(dress(docs), dress(sizes)).collect()
    want = defaultdict(int)
    for r in docs.collect():
        n = len(encoder(VOCABULARY).encode_ordinary(r.text)) if r.text else 0
        if n:
            want[r.doc_id] += n
    for name, capacity in (("s", 32), ("m", 100)):
        mine = [r for r in rows if r.container == name]
        room, have, pieces = defaultdict(int), defaultdict(int), defaultdict(list)
        for r in mine:
            room[r.container_id] += r.n_tokens
            have[r.doc_id] += r.n_tokens
            pieces[r.doc_id].append((r.first_token, r.n_tokens))
        assert have == want and max(room.values()) <= capacity
        for doc, cut in pieces.items():
            if doc == 7:
                continue
            assert [a for a, _ in sorted(cut)] == list(np.cumsum([0] + [n for _, n in sorted(cut)])[:-1])  # pieces follow each other
            assert len(cut) == 1 or want[doc] > capacity  # only longer texts are cut
        assert sum(room.values()) / (capacity * len(room)) > 0.97
    assert {r.container for r in rows} == {"s", "m"}
    report = {r.container: r for r in packing.fill_report(packing.pack(docs, sizes)).collect()}
    assert report["s"].n_tokens == sum(want.values()) and 0.97 < report["s"].filled <= 1


def test_packing_windows(spark, monkeypatch):
    f = packing._Filler("x", 10, 0)
    f.add([("a", 7), ("b", 25), ("c", 3)])
    f.add([("d", 5)])
    assert sorted((r[2], r[3], r[6]) for r in f.rows) == [(0, "b", 10), (1, "b", 10), (2, "a", 7), (2, "c", 3), (3, "b", 5), (3, "d", 5)]


def test_packing_empty(spark):
    docs, sizes = documents(spark), spark.createDataFrame([("s", 32)], "container string, capacity_tokens int")
    assert packing.pack(docs.limit(0), sizes).count() == 0
    assert packing.pack(docs, sizes.limit(0)).count() == 0


def test_token_counts(spark):
    got = {r.doc_id: r.tokens for r in count_tokens(documents(spark)).collect()}
    assert got[501] == got[502] == 0 and got[503] == 1 and got[500] > 3000


def test_rates_reach_the_targets(spark):
    def rates(available, targets, **more):
        rows = [(s, n, *targets[s]) for s, n in available.items() if s in targets]
        return {r.source: r.rate for r in mixing.rates(spark.createDataFrame(rows, "source string, available bigint, share double, cap int"), **more).collect()}

    sizes = {"a": 1000, "b": 100, "c": 500}
    rate = rates(sizes, {"a": (0.5, 2), "b": (0.2, 4), "c": (0.3, 3), "d": (0.1, 5)})
    got = {s: rate[s] * n for s, n in sizes.items()}
    assert sum(got.values()) == pytest.approx(2000) and rate["b"] == 4  # where b reaches its cap
    assert got["a"] / got["c"] == pytest.approx(0.5 / 0.3)
    exact = rates(sizes, {"a": (0.5, 2), "b": (0.2, 4), "c": (0.3, 3)}, least_epoch=0)
    assert [exact[s] * n / (0.4 * 5000) for s, n in sizes.items()] == pytest.approx([0.5, 0.2, 0.3])
    assert rates({"a": 100, "b": 100}, {"a": (0.5, 2), "b": (0.5, 3)}) == {"a": 2, "b": 2}  # the largest total at which both reach their share
    assert rates({}, {"a": (1.0, 2)}) == {} and rates({"a": 5}, {"a": (0.0, 2)}) == {}
    assert rates({"a": 100, "b": 100}, {"a": (0.5, 1), "b": (0.5, 1)}, total=10**9) == {"a": 1, "b": 1}
    steps = rates({c: 10 * 2**i for i, c in enumerate("abcdef")}, {c: (1.0, 1) for c in "abcdef"}, total=500)  # one source after the other gets full
    assert [round(v * 10 * 2**i, 6) for i, (_, v) in enumerate(sorted(steps.items()))] == [10, 20, 40, 80, 160, 190]


@pytest.mark.parametrize("dress", [lambda x: x, crowded])
def test_mix(spark, dress):
    targets = spark.createDataFrame([("SHOP", 0.4, 2), ("my_app", 0.3, 3), ("My-App", 0.3, 2), ("gone", 0.2, 5), (None, 0.1, 1), ("x", None, None)], "source string, target_share double, max_repeats int")
    chosen, report = mixing.mix(dress(documents(spark)), dress(targets))
    rows = chosen.collect()
    assert all(1 <= r.copies <= 2 for r in rows) and {r.source for r in rows} == {"shop", "my_app"}
    shares = {r.source: r for r in report.collect()}
    assert shares["gone"].available_tokens == 0 and shares["gone"].actual_share == 0 and shares["my_app"].target_share == pytest.approx(0.6)
    for s in ("shop", "my_app"):
        assert shares[s].mixed_tokens == sum(r.tokens * r.copies for r in rows if r.source == s)
    assert sum(r.actual_share for r in shares.values()) == pytest.approx(1)
    assert rows_of(chosen) == rows_of(mixing.mix(documents(spark), targets)[0])  # the same draw every time


def test_mix_comes_near(spark):
    rows = [(i, "a" if i % 3 else "b", "some words here " * (1 + i % 9)) for i in range(4000)]
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 3)], "source string, target_share double, max_repeats int")
    report = mixing.mix(spark.createDataFrame(rows, DOCS), targets, total=60_000)[1].collect()
    assert all(abs(r.actual_share - 0.5) < 0.02 for r in report)


def test_mix_empty(spark):
    targets = spark.createDataFrame([("a", 0.5, 2)], "source string, target_share double, max_repeats int")
    chosen, report = mixing.mix(documents(spark).limit(0), targets)
    assert chosen.count() == 0 and report.first().mixed_tokens == 0
    chosen, report = mixing.mix(documents(spark), targets.limit(0))
    assert chosen.count() == 0 and report.count() > 0


def test_mixing_thousands_of_sources(spark):
    n = 10_500
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('s', id) AS source", "'some words' AS text")
    targets = spark.range(n).selectExpr("concat('s', id) AS source", "1.0D AS target_share", "2 AS max_repeats")
    chosen, report = mixing.mix(docs, targets)
    assert report.count() == n and chosen.filter("copies <> 2").count() == 0


def test_null_ids_draw_apart(spark):
    docs = spark.range(400).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "'a' AS source", "concat('text ', id) AS text")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    n = mixing.mix(docs, targets, total=600)[0].count()
    assert 0 < n < 400


def test_thousands_of_container_sizes(spark, monkeypatch):
    monkeypatch.setattr(packing, "TOGETHER", 7)
    docs = documents(spark).limit(40)
    sizes = spark.range(1, 17).selectExpr("concat('c', id) AS container", "CAST(20 * id AS INT) AS capacity_tokens")
    got = packing.fill_report(packing.pack(docs, sizes)).collect()
    assert len(got) == 16 and len({r.n_tokens for r in got}) == 1


def test_ends_of_ranges(spark, monkeypatch):
    """Many ranges lose little: what is open at the end of each."""
    monkeypatch.setattr(packing, "RANGE_TOKENS", 2000)
    docs = documents(spark).filter("doc_id < 500")
    sizes = spark.createDataFrame([("s", 64)], "container string, capacity_tokens int")
    packed = packing.pack(docs, sizes)
    report = packing.fill_report(packed).first()
    want = sum(len(encoder(VOCABULARY).encode_ordinary(r.text)) for r in docs.collect() if r.text)
    assert report.n_tokens == want and report.filled > 0.93
    assert packed.selectExpr("container_id >> 40 AS r").distinct().count() > 4


def test_neighbours(spark):
    docs = documents(spark)
    r = packing.neighbour_report(docs, spark.createDataFrame([("s", 200)], "container string, capacity_tokens int")).first()
    assert r.n_pairs > 0 and -1 <= r.cosine_of_any <= r.cosine <= 1.3

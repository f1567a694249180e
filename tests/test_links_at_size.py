import random

import pyarrow as pa
import pytest
from helpers import images, rows_of

from lumaframe import schemas
from lumaframe.operators import sieve
from lumaframe.operators.link import matches_by_url, performers_by_url
from lumaframe.plans import texts as X


@pytest.mark.parametrize("shortest, longest", [(1, 5), (4, 9)])
def test_links_are_those_of_brute_force(spark, shortest, longest):
    draw = random.Random(3)

    def word(a, b):
        return "".join(draw.choice("abÄ漢_1") for _ in range(draw.randint(a, b)))

    people = [(str(draw.randint(1, 40)), draw.choice(["n", "m", None]), [draw.choice([f"x/{word(0, 20)}", None]) for _ in range(3)]) for _ in range(150)]
    names = {word(shortest, longest) for _ in range(150)} | {"x/"}
    got = rows_of(performers_by_url(spark.createDataFrame([(n,) for n in names], "username string"), spark.createDataFrame(people, schemas.PERFORMER), 4), "username", "performer_id", "place")
    want = []
    for n in names:
        ids = sorted({i for i, _, urls in people for u in urls if u and n.lower() in u.lower()})[:4]
        want += [(n, i, k + 1) for k, i in enumerate(ids)]
    assert got == sorted(want, key=repr)


def test_matches_are_the_links_as_lists(spark):
    people = spark.createDataFrame([("1", "n", ["x/@some_name"]), ("2", "m", ["y/SOME_NAME"])], schemas.PERFORMER)
    got = {r.username: sorted(tuple(m) for m in r.matches) for r in matches_by_url(spark.createDataFrame([("Some_Name",), ("some",)], "username string"), people).collect()}
    assert got == {"Some_Name": [("1", "n"), ("2", "m")], "some": [("1", "n"), ("2", "m")]}


def test_pieces_with_common_grams_are_not_met(spark):
    """Names and urls of the same grams: only what is equal leaves the urls, where every url met every name."""
    names = [f"user_{i:04d}" for i in range(200)]
    held = sieve.of(spark.createDataFrame([(n.encode(),) for n in names], "low binary"))
    rows, low = held.value.pieces(pa.array([f"http://x/@user_{i:04d}_".encode() for i in range(100, 2100)]))
    assert {(r, x.as_py().decode()) for r, x in zip(rows.to_pylist(), low)} >= {(i - 100, f"user_{i:04d}") for i in range(100, 200)}
    assert len(rows) < 150


def test_handles_shuffle_no_more_than_they_need(spark, tmp_path):
    images(spark, [("1", {"title": "a b", "details": "x", "rating100": 1}), ("1", {"title": "a b", "details": "y"}), ("2", {})]).write.parquet(f"{tmp_path}/images.parquet")
    rows = X._handles(spark, str(tmp_path))
    assert rows_of(rows, "image_id", "h", "details") == [(1, "a_b", "y"), (2, "user_2", None)]
    assert "visual_files" not in rows._jdf.queryExecution().executedPlan().toString()


def test_only_ids_that_come_again_are_shuffled_whole(spark):
    from lumaframe.operators.resolve import library_images, library_images_apart

    rows = images(spark, [(str(i), {"title": f"t{i}"}) for i in range(500)] + [(" 7", {"title": "t8"}), ("7", {"title": "t9", "details": "x"}), ("no", {"title": "t"}), (None, {})])
    assert rows_of(library_images_apart(rows)) == rows_of(library_images(rows))

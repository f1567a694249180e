import numpy as np
import pytest
from helpers import crowded, rows_of

from lumaframe.llm import prose as P
from lumaframe.llm.examples import examples

TABLE = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string"
COMMON = [("en", w) for w in "the and it is to of a in that for i was with but not my on this as have".split()] + [("ja", w) for w in "の は に を が です ます".split()]

HELD_OUT = [
    (False, "We bought this lamp for the hallway. It is bright enough, and my father likes the colour, but the switch is hard to reach."),
    (False, "Das Netzteil brummt leise und die Anleitung ist schlecht übersetzt. Trotzdem würde ich es wieder kaufen."),
    (False, "the strap broke on the second day and nobody answered my mail so i sent it back to the shop"),
    (False, "Not good"),
    (False, "この箱は思ったより小さいですが、とても気に入っています。また買います。"),
    (False, "Nice bag. Good zip. Came late."),
    (True, "cable\nlens cloth\nbattery\nmanual\npouch\nstrap\ncase\ncable"),
    (True, "weight: 35 g\nheight: 120 mm\ncable: 90 cm\ncase: 12 cm\nstrap: 33 g\nbattery: 8 h"),
    (True, "| cable | 35 | 9.1 |\n| --- | --- | --- |\n| pouch | 77 | strap |\n| case | 3 | 4 |"),
    (True, "%%%% $$$$$ ##### ~~~~ !!!!! ===== **** ++++ %%% $$$"),
    (True, "qzxv wprtkl mnbvcx lkjhgfd zxcvbnm qwrtypsd fghjklz xcvbqw rtplkj"),
    (True, "battery battery battery battery battery battery battery battery battery battery"),
    (True, "the of and to in a is that it for was on the of and to in a is"),
    (True, "<div class=\"c1\"></div><p></p>&nbsp;<br/></div>&amp;&lt;<p></p><br/>{{x}}"),
]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{TABLE}/documents.parquet").select("doc_id", "text")
    own = spark.createDataFrame([(10**6 + i, t) for i, (_, t) in enumerate(HELD_OUT)] + [(10**7, None), (10**7 + 1, ""), (10**7 + 2, " \n　")], DOCS)
    return docs.union(own), spark.createDataFrame(COMMON, "lang string, word string")


def test_held_out_texts(tables):
    docs, common = tables
    got = {r.doc_id for r in P.not_prose(docs, common).collect()}
    wrong = [t for i, (junk, t) in enumerate(HELD_OUT) if junk != (10**6 + i in got)]
    assert len(wrong) <= 1, wrong
    assert not {10**7, 10**7 + 1, 10**7 + 2} & got


def test_kinds_and_clashing_columns(tables):
    docs, common = tables
    got = {r.doc_id: r for r in P.classified(crowded(docs), crowded(common)).collect()}
    assert got[10**6 + 8].kind == "table" and got[10**6 + 6].kind == "list" and got[10**6 + 9].kind == "junk" and got[10**6].kind == "prose"
    assert all(0 <= r.not_prose <= 1 for r in got.values()) and 10**7 not in got


def test_few_entries_are_prose(tables, spark):
    docs, common = tables
    short = spark.createDataFrame([(1, "cable\npouch"), (2, "cable, pouch, strap")], DOCS)
    got = {r.doc_id: r.kind for r in P.classified(docs.filter("doc_id > 100").union(short), common).collect()}
    assert got[1] != "list" and got[2] != "list"


def test_empty_and_tiny(spark):
    common = spark.createDataFrame(COMMON, "lang string, word string")
    assert P.not_prose(spark.createDataFrame([], DOCS), common).count() == 0
    assert P.classified(spark.createDataFrame([(1, "One short text."), (1, "One short text.")], DOCS), common.limit(0)).count() == 2


def test_long_text(spark):
    common = spark.createDataFrame(COMMON, "lang string, word string")
    text = "It was a good day and we walked to the sea. " * 5000
    assert len(P.features(text, frozenset(w for _, w in COMMON))[0]) == len(P.FEATURES)
    row = P.statistics(spark.createDataFrame([(1, text)], DOCS), common).first()
    assert row.n_words == 55_000 and row.stop_line_share == 1


def test_statistics(spark):
    common = spark.createDataFrame(COMMON, "lang string, word string")
    docs = spark.createDataFrame([(1, "The cat sat.\n\nOn it!\nno stop"), (2, None), (3, ""), (4, "色のケース"), (5, "$$ %%"), (6, " \n ")], DOCS)
    got = {r.doc_id: r for r in P.statistics(crowded(docs), crowded(common)).collect()}
    assert got[1].n_words == 7 and got[1].stop_line_share == pytest.approx(2 / 3) and got[1].common_word_share == pytest.approx(3 / 7)
    assert got[2].symbol_share is None and got[3].symbol_share == 0 and got[3].mean_word_length == 0
    assert got[4].n_words == 3 and got[4].common_word_share == pytest.approx(1 / 3)
    assert got[5].n_words == 0 and got[5].symbol_share == pytest.approx(4 / 5)
    assert rows_of(P.statistics(docs.limit(0), common)) == []


def test_distributed_rounds_equal_local_ones(spark):
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(0, 1, (80, 3)), r.normal(4, 1, (60, 3))])
    start = [x[:10], x[-10:]]
    local = P.Mixture(start, np.eye(3))
    for _ in range(5):
        local.update(local.sums(x))
    table = spark.createDataFrame([(row.tolist(),) for row in x], "x array<double>").repartition(3)
    model = P.fit(table, start, 5)
    assert np.allclose(model.mean, local.mean) and np.allclose(model.cov, local.cov)
    assert model.shares(x)[:80, 0].mean() > 0.9


def test_examples_name_every_kind():
    assert {k for k, _, _ in examples()} == set(P.KINDS) and examples() == examples()


@pytest.mark.parametrize("n", [1, 39, 40, 41, 79, 80, 81, 119, 120])
def test_every_word_lies_in_a_window(n):
    """Distinct words, but the last one repeats the one before it: variety shows it wherever the text ends."""
    words = ["".join(chr(97 + (k // 26**i) % 26) for i in range(3)) for k in range(max(1, n - 1))]
    variety = lambda w: P.features(" ".join(w), frozenset())[0][P.FEATURES.index("variety")]
    assert variety(words) == 1
    assert n == 1 or variety([*words, words[-1]]) < 1


def test_repetition_at_the_end_of_a_text():
    """79 words, the last 44 of which repeat one phrase."""
    prose = "we bought this lamp for our hallway because it seemed bright enough while my father likes its colour although nobody can reach that tiny switch without standing on one old wooden chair near every large window upstairs".split()[:35]
    row = P.features(" ".join(prose + "very good shop here".split() * 11), frozenset())[0]
    assert len(set(prose)) == 35 and row[P.FEATURES.index("variety")] == (35 + 4 + 4) / 80

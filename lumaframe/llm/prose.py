"""Text quality: statistics of each text, and the texts that are not natural prose.

The statistics are standardized and a Gaussian mixture is fitted to those of all texts by expectation-maximization: each
round is one pass over the table of statistics, in which every partition sums what it contributes, and only sums per
component reach the driver. Components start at the inspected examples (examples.py) and are named prose, list, table or
junk by the examples that they hold when the fit has ended.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaframe.llm.examples import examples
from lumaframe.session import drop_stage, shared_folder, stage

KINDS = ("prose", "list", "table", "junk")
ROUNDS, SETTLED = 40, 5e-3  #: the fit ends when no mean (in standard deviations) and no weight moves by more, at the latest after ROUNDS
TRIGRAMS = 1 << 16  #: bins of the hashed counts of letter trigrams
WINDOW = 40  #: words among which repetition is measured, one window after the other, the last one ending with the text
MOST_COMMON = 10_000  #: common words
ENTRIES = 5  #: an enumeration of fewer bare entries is no case

_CJK = "々぀-ヿ一-鿿"
_WORD = re.compile(r"[぀-ゟ]+|[゠-ヿ]+|[々一-鿿]+|(?:(?![" + _CJK + r"])[^\W\d_])+(?:['’](?![" + _CJK + r"])[^\W\d_]+)*")
_HIRAGANA = re.compile(r"[぀-ゟ]")
_CUT = re.compile(r"[\n\r\t,;|/:#•*·│、，；：]+|<[^<>]*>|\s{3,}|[.!?。！？…]+(?=\s|$|[぀-ヿ一-鿿])")
_STOP = re.compile(r"[.!?。！？…](?=[\s\"'”»)]|$|[぀-ヿ一-鿿])")
_MARK = re.compile(r"<[^<>]*>|&\w+;|\{\{\w*\}\}")
_SPELLED = re.compile(r"&#\w+;|&(?:quot|apos);")  #: characters of prose that came through a web page
_SYMBOL = re.compile(r"[^\w \n\r\t.,!?'’\"\-():¡¿。、！？「」…]|_")  #: neither letter, digit nor plain punctuation
_DIGIT = re.compile(r"[\d²³¹⁰⁴-⁹₀-₉①-⑨]")
_ALNUM = re.compile(r"[^\W_]")
_WRAP = re.compile(r"(?<=[^\n.!?:。！？|]{24})\n(?=\w)")


def statistics(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """doc_id, n_words, mean_word_length, symbol_share, stop_line_share and common_word_share of each text.

    Words are runs of letters, marks and digits; where a script has no spaces, runs of one script. Symbols are characters
    other than these and white space, over all characters. A line counts if it isn't blank, and as ending in punctuation
    if its last character but white space is one of . ! ? … : ; and their wide forms. Common are the words of the table, of
    whatever language, as the language of a text may be wrong. A share of nothing is 0; null texts give null statistics,
    empty ones zeros. The list of common words goes to every task and must have MOST_COMMON rows at most.
    """
    text = F.col("text")
    spaced = F.regexp_replace(text, "([぀-ゟ]+|[゠-ヿ]+|[々一-鿿]+)", " $1 ")
    words = F.regexp_extract_all(F.lower(spaced), F.lit(r"([\p{L}\p{M}\p{N}]+)"), 1)
    listed = common_words.select(F.lower(F.trim("word")).alias("word")).filter("word <> ''").distinct().limit(MOST_COMMON + 1).collect()
    if len(listed) > MOST_COMMON:
        raise ValueError(f"more than {MOST_COMMON} common words")
    common = F.array(*(F.lit(r.word) for r in listed)) if listed else F.array().cast("array<string>")
    lines = F.filter(F.split(text, "[\r\n]+"), lambda x: F.regexp_replace(x, r"[\s\p{Z}]+", "") != "")
    share = lambda part, whole: F.when(text.isNotNull(), F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0)))
    rows = documents.select("doc_id", "text", words.alias("words"), lines.alias("lines"))
    symbols = F.length(F.regexp_replace(text, r"[\p{L}\p{M}\p{N}\s\p{Z}]+", ""))
    length = F.aggregate("words", F.lit(0), lambda a, w: a + F.length(w))
    stops = F.size(F.filter("lines", lambda x: x.rlike(r"[.!?…:;。！？：；][\s\p{Z}]*$")))
    return rows.select(
        "doc_id",
        F.size("words").alias("n_words"),
        share(length, F.size("words")).alias("mean_word_length"),
        share(symbols, F.length(text)).alias("symbol_share"),
        share(stops, F.size("lines")).alias("stop_line_share"),
        share(F.size(F.filter("words", lambda w: F.array_contains(common, w))), F.size("words")).alias("common_word_share"),
    )


def _trigrams(words: list[str]) -> np.ndarray:
    """Distinct bins of the letter trigrams of the words."""
    text = " ".join(words).lower()
    if not text:
        return np.empty(0, np.int64)
    c = np.frombuffer(f" {text} ".encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    h = (c[:-2] * np.uint64(0x9E3779B1) + c[1:-1] * np.uint64(0x85EBCA77) + c[2:] * np.uint64(0xC2B2AE3D)) >> np.uint64(9)
    return np.unique(h % np.uint64(TRIGRAMS)).astype(np.int64)


def trigram_counts(measured: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each bin of trigrams (column bins, packed) occurs, and the number of texts; 65,536 sums reach the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(TRIGRAMS, np.int64), 0
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch["bins"]), np.uint16), minlength=TRIGRAMS)
            n += len(batch)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bin": [*at, -1], "n": [*total[at], n]})

    sums = measured.select("bins").mapInPandas(count, "bin int, n long").groupBy("bin").agg(F.sum("n")).collect()
    counts, n = np.zeros(TRIGRAMS, np.int64), 0
    for at, c in sums:
        if at < 0:
            n = c
        else:
            counts[at] = c
    return counts, n


def familiarity(bins: Iterable[bytes], familiar: np.ndarray) -> np.ndarray:
    """The mean of `familiar` over the bins of each text; -8 without any."""
    size = np.array([len(b) // 2 for b in bins], dtype=np.int64)
    values = np.append(familiar[np.frombuffer(b"".join(bins), np.uint16)], 0.0)
    first = np.minimum(np.cumsum(size) - size, len(values) - 1)
    sums = np.add.reduceat(values, first) if len(size) else np.empty(0)
    return np.where(size > 0, sums / np.maximum(size, 1), -8.0)


FEATURES = ("common", "symbols", "digits", "cuts", "entry", "variety", "familiar", "stop_lines", "word_length", "words", "stops", "top_word")


FAMILIAR = FEATURES.index("familiar")


def features(text: str, common: frozenset[str]) -> tuple[list[float], int, bytes]:
    """The statistics of one whole text, its number of entries, and its bins of trigrams, from which `familiar` follows once all texts are counted."""
    text = _SPELLED.sub(lambda m: unescape(m[0]), text)
    n_chars = max(1, len(text.strip()))
    bare = _MARK.sub(" ", text)
    joined = _WRAP.sub(" ", text) if "\n" in text else text
    words = _WORD.findall(bare)
    n = len(words)
    japanese = sum(1 for w in words if "々" <= w[0] <= "鿿")
    if japanese * 2 > n:
        letters = "".join(words)
        share = len(_HIRAGANA.findall(letters)) / max(1, len(letters))
        little = 0.75 * share if share < 0.9 else 1.0
    else:
        little = sum(w.lower() in common for w in words) / max(1, n)
    marks = sum(len(m) for m in _MARK.findall(text))
    symbols = (marks + len(_SYMBOL.findall(bare))) / n_chars
    digits = len(_DIGIT.findall(text)) / n_chars
    entries = [e for e in _CUT.split(joined) if e and _ALNUM.search(e)]
    lines = [x.rstrip() for x in text.split("\n") if x.strip()]
    lower = [w.lower() for w in words]
    windows = [lower[i : i + WINDOW] for i in [*range(0, n - WINDOW, WINDOW), max(0, n - WINDOW)]]  # every word, and none too short to compare
    variety = sum(len(set(w)) for w in windows) / max(1, sum(map(len, windows)))
    top = max(Counter(lower).values(), default=0) / max(1, n)
    bins = _trigrams(words)
    row = [
        little,
        math.sqrt(symbols),
        math.sqrt(digits),
        math.log(max(1, len(entries)) + n) - math.log(n + 1),
        math.log((n + 0.5) / (len(entries) + 0.5)),
        variety,
        0.0,
        sum(1 for x in lines if x[-1] in ".!?…。！？\"”»)") / max(1, len(lines)),
        math.log(1 + sum(map(len, words)) / max(1, n)),
        math.log(1 + min(n, WINDOW)),
        math.log((len(_STOP.findall(text)) + 0.1) / (n + 1)),
        math.sqrt(top * min(1.0, n / 8)),
    ]
    return row, len(entries), bins.astype(np.uint16).tobytes()


def _design(x: np.ndarray) -> np.ndarray:
    """1, x and its outer product: what a component sums."""
    n, d = x.shape
    return np.concatenate([np.ones((n, 1)), x, (x[:, :, None] * x[:, None, :]).reshape(n, d * d)], axis=1)


class Mixture:
    """Gaussians with full covariance; priors hold each near the examples that it starts from."""

    MEAN_WEIGHT, SHAPE_WEIGHT = 8.0, 16.0

    def __init__(self, groups: list[np.ndarray], spread: np.ndarray):
        self.start = np.stack([g.mean(axis=0) for g in groups])
        inside = sum(((g - g.mean(axis=0)).T @ (g - g.mean(axis=0)) for g in groups)) / sum(map(len, groups))
        self.shape = 0.5 * np.stack([np.cov(g.T, bias=True) if len(g) > 2 else inside for g in groups]) + 0.5 * inside + 0.01 * spread
        self.weight = np.full(len(groups), 1 / len(groups))
        self.mean, self.cov = self.start.copy(), self.shape.copy()
        self._prepare()

    def _prepare(self) -> None:
        self.inverse = np.linalg.inv(self.cov)
        self.constant = np.log(self.weight) - 0.5 * np.linalg.slogdet(self.cov)[1]

    def shares(self, x: np.ndarray) -> np.ndarray:
        """Posterior of each component for each row."""
        out = np.empty((len(x), len(self.weight)))
        for k, (m, inv) in enumerate(zip(self.mean, self.inverse)):
            e = x - m
            out[:, k] = self.constant[k] - 0.5 * ((e @ inv) * e).sum(axis=1)
        out = np.exp(out - out.max(axis=1, keepdims=True))
        return out / out.sum(axis=1, keepdims=True)

    def sums(self, x: np.ndarray) -> np.ndarray:
        return self.shares(x).T @ _design(x)

    def update(self, sums: np.ndarray) -> float:
        """Take the sums of a round; returns how far the weighted means and the weights moved."""
        d = self.mean.shape[1]
        before = np.c_[self.weight[:, None] * self.mean, self.weight]
        n, first, second = sums[:, 0], sums[:, 1 : d + 1], sums[:, d + 1 :].reshape(-1, d, d)
        a, b = self.MEAN_WEIGHT, self.SHAPE_WEIGHT
        self.weight = (n + 1) / (n.sum() + len(n))
        self.mean = (first + a * self.start) / (n + a)[:, None]
        for k, m in enumerate(self.mean):
            about = second[k] - np.outer(m, first[k]) - np.outer(first[k], m) + n[k] * np.outer(m, m)
            off = m - self.start[k]
            self.cov[k] = (about + b * self.shape[k] + a * np.outer(off, off)) / (n[k] + b)
        self._prepare()
        return float(np.abs(np.c_[self.weight[:, None] * self.mean, self.weight] - before).max())


def fit(table: DataFrame, groups: list[np.ndarray], rounds: int = ROUNDS) -> Mixture:
    """Expectation-maximization over all rows of column x (array of standardized statistics)."""
    d = groups[0].shape[1]
    model = Mixture(groups, np.eye(d))
    width = 1 + d + d * d
    for _ in range(rounds):

        def part(batches: Iterator[pd.DataFrame], model: Mixture = model) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(model.weight), width))
            for batch in batches:
                if len(batch):
                    total += model.sums(np.stack(batch["x"].to_numpy()))
            yield pd.DataFrame({"at": np.arange(total.size), "v": total.ravel()})

        sums = np.zeros(len(model.weight) * width)
        for at, v in table.select("x").mapInPandas(part, "at int, v double").groupBy("at").agg(F.sum("v")).collect():  # some thousand sums
            sums[at] = v
        if model.update(sums.reshape(-1, width)) < SETTLED:
            break
    return model


def classified(documents: DataFrame, common_words: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, kind (prose, list, table, junk), not_prose (posterior of the three latter), n_entries.

    Null and blank texts are left out. An enumeration of fewer than ENTRIES entries is prose whatever its component.
    """
    spark = documents.sparkSession
    there = documents.filter(F.regexp_replace("text", r"[\s\p{Z}]+", "") != "").select("doc_id", "text")
    listed = common_words.select(F.lower(F.trim("word")).alias("word")).filter("word <> ''").distinct().limit(MOST_COMMON + 1).collect()
    if len(listed) > MOST_COMMON:
        raise ValueError(f"more than {MOST_COMMON} common words")
    common = frozenset(r.word for r in listed)
    folder = shared_folder(spark)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [features(t, common) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "x": [x for x, _, _ in rows], "n_entries": [e for _, e, _ in rows], "bins": [b for _, _, b in rows]})

    measured = stage(there.mapInPandas(measure, "doc_id bigint, x array<double>, n_entries int, bins binary"), folder, "measured")
    counts, n = trigram_counts(measured)
    if n == 0:
        return spark.createDataFrame([], "doc_id bigint, kind string, not_prose double, n_entries int")
    familiar = np.log((counts + 0.01) / n).clip(-8)
    shared = spark.sparkContext.broadcast(familiar)  # 65,536 numbers

    def complete(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch["x"].to_numpy())
                x[:, FAMILIAR] = familiarity(list(batch["bins"]), shared.value)
                yield batch[["doc_id", "n_entries"]].assign(x=list(x))

    table = stage(measured.mapInPandas(complete, "doc_id bigint, n_entries int, x array<double>"), folder, "features")
    drop_stage(spark, folder, "measured")
    d = len(FEATURES)
    moments = table.agg(*(F.avg(F.col("x")[i]) for i in range(d)), *(F.stddev_pop(F.col("x")[i]) for i in range(d))).first()
    shift, scale = np.array(moments[:d]), np.maximum(np.array(moments[d:]), 1e-3)
    seen = examples()
    read = [features(t, common) for _, _, t in seen]
    x = np.array([r for r, _, _ in read])
    x[:, FAMILIAR] = familiarity([b for _, _, b in read], familiar)
    x = (x - shift) / scale
    names = list(dict.fromkeys((kind, group) for kind, group, _ in seen))
    of = np.array([names.index((kind, group)) for kind, group, _ in seen])
    standard = table.withColumn("x", F.array(*((F.col("x")[i] - float(shift[i])) / float(scale[i]) for i in range(d))))
    model = fit(standard, [x[of == k] for k in range(len(names))], rounds)
    held = model.shares(x)
    votes = np.zeros((len(names), len(KINDS)))
    for row, k in zip(held, of):
        votes[:, KINDS.index(names[k][0])] += row / (of == k).sum()
    for k, (kind, _) in enumerate(names):
        votes[k, KINDS.index(kind)] += 0.05
    kinds = votes / votes.sum(axis=1, keepdims=True)

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            p = model.shares(np.stack(batch["x"].to_numpy())) @ kinds
            best = np.where(p[:, 0] >= 0.5, 0, 1 + p[:, 1:].argmax(axis=1))
            few = (best == 1) & (batch["n_entries"].to_numpy() < ENTRIES)
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "kind": np.array(KINDS)[np.where(few, 0, best)], "not_prose": 1 - p[:, 0], "n_entries": batch["n_entries"].to_numpy()})

    return standard.mapInPandas(name, "doc_id bigint, kind string, not_prose double, n_entries int")


def not_prose(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """doc_id of the texts most of which is no natural prose; see classified. Repeated rows of a document come out as often."""
    return classified(documents, common_words).filter("kind <> 'prose'").select("doc_id")

"""Filling containers of fixed capacity with texts along a space-filling curve.

A text's tokens are hashed to a vector, which is projected to three dimensions; its place on a Hilbert curve through them
is its key. Texts are sorted by range of the key, so texts of a kind lie side by side, and each range is packed along the
curve: a window of neighbours at a time, the longest first, each into the open container that it fills best. The OPEN youngest
of the containers that are still open after a window stay open for the next one, so those who share a container come from a
short stretch of the curve. Only older ones, and those open at the end of a range, are left unfilled, and ranges are made large
enough for these not to count.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaframe.llm.tokens import VOCABULARY, encoder
from lumaframe.session import shared_folder, stage

DIMENSIONS, LEVELS, FEATURES = 3, 10, 1024
RANGE_TOKENS = 1 << 22  #: tokens in a range of the curve
WINDOW = 256  #: texts that are put in order of length together
OPEN = 128  #: containers that stay open from one window to the next
TOGETHER = 1000  #: sizes of containers that are filled in one pass over the texts
SKETCH = 64  #: dimensions to which vectors are projected for the report on neighbours


def hilbert_key(points: np.ndarray, bits: int = LEVELS) -> np.ndarray:
    """Places on the Hilbert curve of points (n, d) with coordinates below 2**bits."""
    x = points.astype(np.int64).copy()
    n, d = x.shape
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations from the coarsest level on
        for i in range(d):
            set_ = (x[:, i] & q) != 0
            x[set_, 0] ^= q - 1
            swap = np.where(set_, 0, (x[:, 0] ^ x[:, i]) & (q - 1))
            x[:, 0] ^= swap
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(n, dtype=np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip[(x[:, d - 1] & q) != 0] ^= q - 1
        q >>= 1
    x ^= flip[:, None]
    key = np.zeros(n, dtype=np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[:, i] >> level) & 1)
    return key


def _vector(ids: np.ndarray) -> np.ndarray:
    """Token ids hashed with a sign to FEATURES."""
    h = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    sign = np.where(h & np.uint64(1 << 20), 1.0, -1.0)
    return np.bincount((h % np.uint64(FEATURES)).astype(np.int64), weights=sign, minlength=FEATURES)


def project(tokens: list[np.ndarray]) -> np.ndarray:
    """Coordinates on the curve's grid: token ids hashed with a sign to FEATURES, their mean projected, its ranks squeezed evenly."""
    plane = np.random.default_rng(20240229).standard_normal((FEATURES, DIMENSIONS))
    out = np.zeros((len(tokens), DIMENSIONS))
    for k, ids in enumerate(tokens):
        if len(ids):
            vector = _vector(ids)
            out[k] = vector @ plane / max(1e-9, np.sqrt((vector**2).sum()))
    even = 1 / (1 + np.exp(-1.702 * out))  # near the normal distribution function
    return np.minimum((even * (1 << LEVELS)).astype(np.int64), (1 << LEVELS) - 1)


def keyed(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, tokens and key (place on the curve) of each text that has a token."""

    def size(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary).encode_ordinary
        for batch in batches:
            ids = [np.array(encode(t), dtype=np.int64) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "tokens": [len(i) for i in ids], "key": hilbert_key(project(ids)) if len(ids) else []})

    return documents.filter(F.length("text") > 0).select("doc_id", "text").mapInPandas(size, "doc_id bigint, tokens long, key long")


class _Filler:
    """Containers of one capacity that are filled along a range."""

    def __init__(self, name: str, capacity: int, first: int):
        self.name, self.capacity, self.next = name, capacity, first
        self.open: list[tuple[int, int]] = []  # (room, container), least room first
        self.rows: list[tuple] = []

    def _put(self, container: int, doc: object, piece: int, at: int, size: int) -> None:
        self.rows.append((self.name, self.capacity, container, doc, piece, at, size))

    def add(self, window: list[tuple[object, int]]) -> None:
        rest = []
        for doc, size in window:
            whole, left = divmod(size, self.capacity)
            for piece in range(whole):
                self._put(self.next, doc, piece, piece * self.capacity, self.capacity)
                self.next += 1
            if left:
                rest.append((left, doc, whole))
        rest.sort(key=lambda r: -r[0])
        for size, doc, piece in rest:
            i = bisect_left(self.open, (size, -1))
            room, container = self.open.pop(i) if i < len(self.open) else (self.capacity, self._new())
            self._put(container, doc, piece, piece * self.capacity, size)
            if room > size:
                insort(self.open, (room - size, container))
        if len(self.open) > OPEN:
            oldest = sorted(container for _, container in self.open)[-OPEN]
            self.open = [o for o in self.open if o[1] >= oldest]

    def _new(self) -> int:
        self.next += 1
        return self.next - 1


def pack(documents: DataFrame, containers: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """container, capacity_tokens, container_id, doc_id, piece, first_token, n_tokens: which piece of a text lies in which container.

    Each row of `containers` is filled by itself with all documents. A text of more tokens than the capacity is cut into
    full pieces, each a container of its own, and a rest; no other text is cut. Texts without a token (null, empty) lie
    in no container. Repeated rows of a document are packed as often as they occur. Containers without name or with a
    capacity of null, zero or less are left out, repeated ones count once. Extra columns are ignored.
    """
    spark = documents.sparkSession
    table = stage(keyed(documents, vocabulary), shared_folder(spark), "keyed")
    sizes = containers.filter("capacity_tokens > 0 AND container IS NOT NULL").select("container", "capacity_tokens").distinct().orderBy("container", "capacity_tokens")
    total = table.agg(F.sum("tokens")).first()[0] or 0
    curve = table.repartitionByRange(int(max(1, -(-total // RANGE_TOKENS))), "key", "doc_id").sortWithinPartitions("key", "doc_id").select("doc_id", "tokens")
    out, some = None, []
    for r in [*sizes.toLocalIterator(), None]:  # however many sizes there are, TOGETHER of them are on the driver
        if r is not None:
            some.append((r.container, int(r.capacity_tokens)))
        if len(some) == TOGETHER or r is None:
            filled = curve.mapInPandas(_fill(some), _PACKED)
            out, some = filled if out is None else out.unionByName(filled), []
    return out


_PACKED = "container string, capacity_tokens int, container_id bigint, doc_id bigint, piece int, first_token bigint, n_tokens bigint"


def _fill(fillers: list[tuple[str, int]]):
    """Fill containers of these sizes along a range."""
    columns = ["container", "capacity_tokens", "container_id", "doc_id", "piece", "first_token", "n_tokens"]

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = TaskContext.get().partitionId() << 40
        work = [_Filler(name, capacity, first) for name, capacity in fillers]
        window: list[tuple[object, int]] = []

        def flush() -> pd.DataFrame:
            rows = []
            for w in work:
                w.add(window)
                rows += w.rows
                w.rows = []
            window.clear()
            return pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})

        for batch in batches:
            ids = batch["doc_id"].astype("Int64")
            for doc, size in zip(ids, batch["tokens"]):
                window.append((None if doc is pd.NA else int(doc), int(size)))
                if len(window) == WINDOW:
                    yield flush()
        yield flush()

    return fill


def fill_report(packed: DataFrame) -> DataFrame:
    """Per container: how many were used, their tokens, and the share of their room that is filled."""
    by = packed.groupBy("container", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces"))
    return by.groupBy("container", "capacity_tokens").agg(
        F.count("*").alias("n_containers"), F.sum("pieces").alias("n_pieces"), F.sum("n").alias("n_tokens"), (F.sum("n") / (F.count("*") * F.col("capacity_tokens"))).alias("filled")
    )


def packing_faults(packed: DataFrame) -> DataFrame:
    """container, capacity_tokens, n_documents, n_overfull, n_cut: the documents packed, containers above their capacity, and
    documents cut though they fit; both counts must be 0."""
    by = packed.groupBy("container", "capacity_tokens")
    full = packed.groupBy("container", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("n")).groupBy("container", "capacity_tokens").agg(F.count_if(F.col("n") > F.col("capacity_tokens")).alias("n_overfull"))
    whole = packed.groupBy("container", "capacity_tokens", "doc_id").agg(F.sum("n_tokens").alias("n"), F.max("piece").alias("last"))
    cut = whole.groupBy("container", "capacity_tokens").agg(F.count_if((F.col("last") > 0) & (F.col("n") <= F.col("capacity_tokens"))).alias("n_cut"))
    documents = by.agg(F.countDistinct("doc_id").alias("n_documents"))
    return documents.join(full, ["container", "capacity_tokens"]).join(cut, ["container", "capacity_tokens"])


def neighbour_report(documents: DataFrame, containers: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """container, capacity_tokens, n_pairs, cosine, cosine_of_any: how alike are texts that share a container.

    The mean cosine of the hashed vectors of two texts of a container, over all such pairs, and that of any two texts. It is
    computed from sums: of unit vectors v the pairs' cosines add up to (|sum v|^2 - sum |v|^2) / 2, and a random projection to
    SKETCH dimensions keeps these on average. A text without doc_id isn't counted; of one that is cut, the rest counts.
    """

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary).encode_ordinary
        plane = np.random.default_rng(7).standard_normal((FEATURES, SKETCH)) / np.sqrt(SKETCH)
        for batch in batches:
            vectors = [_vector(np.array(encode(t), dtype=np.int64)) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "s": [(v @ plane / max(1e-9, np.sqrt((v**2).sum()))).tolist() for v in vectors]})

    texts = documents.filter("doc_id IS NOT NULL AND length(text) > 0").select("doc_id", "text").dropDuplicates(["doc_id"])
    sketches = stage(texts.mapInPandas(sketch, "doc_id bigint, s array<double>"), shared_folder(documents.sparkSession), "sketches")

    def pairs(rows: DataFrame, *by: str) -> DataFrame:
        sums = rows.groupBy(*by).agg(F.count("*").alias("n"), *(F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(SKETCH)), F.sum(F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x)).alias("own"))
        whole = sum((F.col(f"s{i}") * F.col(f"s{i}") for i in range(SKETCH)), F.lit(0.0))
        return sums.select(*by, (F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("pairs"), ((whole - F.col("own")) / 2).alias("alike"))

    rests = pack(documents, containers, vocabulary).groupBy("container", "capacity_tokens", "doc_id").agg(F.max(F.struct("piece", "container_id")).alias("r"))
    shared = pairs(rests.select("container", "capacity_tokens", "r.container_id", "doc_id").join(sketches, "doc_id"), "container", "capacity_tokens", "container_id")
    any_ = pairs(sketches).select((F.col("alike") / F.nullif("pairs", F.lit(0))).alias("cosine_of_any"))
    found = shared.groupBy("container", "capacity_tokens").agg(F.sum("pairs").alias("n_pairs"), (F.sum("alike") / F.nullif(F.sum("pairs"), F.lit(0))).alias("cosine"))
    return found.crossJoin(F.broadcast(any_))  # one row

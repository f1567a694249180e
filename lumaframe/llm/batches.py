"""Duplicates of new batches among everything accepted so far.

The accepted hashes lie in persisted inverted-file cells: centroids are trained on a bounded sample of the first batch, and
a cell holds the full hashes that are nearest to its centroid, packed, with their distance to it (their ring) and the ids of
their records. What a cell can hold near a query q is bounded below by the triangle inequality: with d the distance from q
to the cell's centroid and d0 that to its nearest one, a hash of the cell is at least (d - d0) / 2 away, at least d less the
cell's widest ring, and at least its narrowest ring less d or d0. Cells are probed in order of the bound: first the nearest
cell, then every other one whose bound doesn't exceed the distance found there, or the radius if nothing was found. Then
nothing nearer can be left. Within a cell only rings that the bound allows are compared, in full, and of a large cell only what
shares one of radius + 1 words of bits with the query, wherever these are fewer: two hashes that differ in no more bits than the
radius have one of the words alike. So a cell may be large, and the cells few enough to be told apart at little cost. File digests
lie in cells of their own, by their first bytes, and are compared in full as well.

The cells are a Parquet table. Cells are dealt to parts of about PART records, and the table is bucketed by part. Probing
shuffles the batch to the parts; the history is never shuffled. A record is stored once, in a row per cell and batch; cells that
a small batch doesn't probe are left out of the scan. Every so many batches the rows of a cell are merged into one, the number
of parts grows with the records, and cells that have grown hot are dealt into several parts.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaframe.functions.bits import month
from lumaframe.operators.current import current_fingerprints
from lumaframe.session import free_shuffles, shared_folder, stage

SAMPLE = 1 << 17  #: hashes that the centroids are trained on, at most; every hash is indexed
MOST_CELLS = 1 << 16  #: centroids: 512 KB
CELLS = 1 << 7  #: centroids, unless cells of DEAL records need more of them
PART = 500_000  #: records in a part, about
FEW_PARTS = 12  #: parts however few the records are, unless Spark shuffles to fewer; more of them start tasks that have little to do
LAYOUT = 2  #: of the parts; an index is only read by the layout that wrote it
DEAL = 1 << 18  #: records of a cell in one piece of it, about
SMALL = 1000  #: records of a batch for which the probed cells are listed, so that the scan leaves out the others
FLUSH = 1 << 17  #: hashes that a task routes together
BLOCK = 1 << 16  #: distances computed together: half a megabyte
GATHER = 1 << 18  #: hashes with a word alike that are compared together
WORD = 16  #: bits of a word that are looked up, at most
SPLIT = 1 << 24  #: records of a batch that are probed together
MERGE_AFTER = 6  #: batches whose rows are merged with what was merged before

_SCHEMA = "part INT, key BIGINT, batch STRING, n INT, low INT, high INT, packed BINARY, rings BINARY, ids BINARY"
_SENT = "part int, key bigint, packed binary"
_FOUND = "of_file boolean, hash bigint, digest binary, distance int, near bigint"  # of a file the digest, else the hash
TOGETHER = 4  #: distances from the centroid whose queries are compared together
NONE = 99  #: the distance where nothing was found
_KEY_BITS = 20  #: of a key, below the cell: the piece of the cell


def _rows(v: np.ndarray, centers: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Distances to all centers, some rows at a time."""
    step = max(1, BLOCK // len(centers))
    for at in range(0, len(v), step):
        yield at, np.bitwise_count(v[at : at + step, None] ^ centers[None, :])


def assign(v: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest center of each hash, the first of equals, and the distance to it."""
    cell, ring = np.empty(len(v), np.int64), np.empty(len(v), np.int64)
    for at, d in _rows(v, centers):
        c = d.argmin(axis=1)
        cell[at : at + len(d)], ring[at : at + len(d)] = c, d[np.arange(len(d)), c]
    return cell, ring


def train(sample: np.ndarray, cells: int) -> np.ndarray:
    """`cells` centroids, at most as many as there are hashes: from the first hashes of a shuffled sample, one round of majority bits."""
    centers = sample[: max(1, cells)].copy()
    if not len(centers):
        return np.zeros(1, np.uint64)
    cell, _ = assign(sample, centers)
    size = np.bincount(cell, minlength=len(centers))
    for bit in range(64):
        ones = np.bincount(cell, weights=(sample >> np.uint64(bit) & np.uint64(1)).astype(float), minlength=len(centers))
        most = np.where(2 * ones == size, centers >> np.uint64(bit) & np.uint64(1), (2 * ones > size).astype(np.uint64)).astype(np.uint64)
        centers = (centers & ~np.uint64(1 << bit)) | (most << np.uint64(bit))
    return np.unique(centers)


def bounds(d: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Of distances d (queries x cells), the least distance at which each cell may hold a hash; 99 for an empty cell."""
    best = d.min(axis=1, keepdims=True)
    b = np.maximum((d - best + 1) // 2, np.maximum(d - high, np.maximum(low - d, low - best)))
    return np.where(high < 0, 99, b)


def reached(d: np.ndarray, low: np.ndarray, high: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Whether the bound of each cell is within the limit of each query, in bytes: bounds(d, low, high) <= limit. d as bytes."""
    best, limit = d.min(axis=1, keepdims=True), np.minimum(limit, 64).astype(np.uint8)[:, None]
    low, high = np.where(high < 0, 255, low).astype(np.uint8), np.maximum(high, 0).astype(np.uint8)
    return (d <= best + 2 * limit) & (d <= high + limit) & (d + limit >= low) & (low <= best + limit)


def _whole_digest() -> Column:
    """32 bytes whatever the digest: what isn't a digest of 32 bytes is digested."""
    other = F.unhex(F.sha2(F.concat(F.lit(b"?"), F.col("digest")), 256))
    return F.when(F.octet_length("digest") == 32, F.col("digest")).otherwise(other)


def _digests(values: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype=">u8").reshape(-1, 4).astype(np.uint64)


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    """In turn, so that parts hold as many cells."""
    return ((key >> _KEY_BITS) + (key & ((1 << _KEY_BITS) - 1))) % parts


def _packed(keys: np.ndarray, values: np.ndarray) -> list[tuple[int, bytes]]:
    """The values of each key, packed."""
    cell = keys >> _KEY_BITS
    undealt = len(keys) and int(cell.max()) < 1 << 16 and bool((cell << _KEY_BITS == keys).all())
    order = np.argsort(cell.astype(np.uint16) if undealt else keys, kind="stable")  # of 16 bits a radix sort
    keys, values = keys[order], values[order]
    edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)] if len(keys) else []
    return [(int(keys[a]), values[a:b].tobytes()) for a, b in zip(edges, edges[1:])]


def _by_key(rows: pd.DataFrame, *columns: str) -> dict[int, tuple[bytes, ...]]:
    """The packs of each key, one behind the other."""
    out: dict[int, list[list[bytes]]] = {}
    for key, *packs in zip(rows["key"].tolist(), *(rows[c] for c in columns)):
        for held, pack in zip(out.setdefault(key, [[] for _ in columns]), packs):
            held.append(pack)
    return {key: tuple(b"".join(p) for p in packs) for key, packs in out.items()}


def _batched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    kept, n = [], 0
    for batch in batches:
        kept.append(batch)
        n += len(batch)
        if n >= FLUSH:
            yield pd.concat(kept)
            kept, n = [], 0
    if n:
        yield pd.concat(kept)


def _least(at: np.ndarray, far: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each place the least distance, and the least id at it."""
    order = np.lexsort((near, far, at))
    at, far, near = at[order], far[order], near[order]
    first = np.ones(len(at), bool)
    first[1:] = at[1:] != at[:-1]
    return at[first], far[first], near[first]


def _alike(q: np.ndarray, stored: np.ndarray, radius: int) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """For each of radius + 1 words: an order of what is stored, and from where and how many in it have the word of each query;
    and how many these are for each query in all."""
    edges = [round(i * 64 / (radius + 1)) for i in range(radius + 2)]
    words, total = [], np.zeros(len(q), np.int64)
    for start, end in zip(edges, edges[1:]):
        bits = min(end - start, WORD, max(1, len(stored).bit_length()))
        of = lambda v: (v << np.uint64(start) >> np.uint64(64 - bits)).astype(np.uint16)  # noqa: E731, B023
        s = of(stored)
        ends = np.cumsum(np.bincount(s, minlength=1 << bits))
        w = of(q)
        n = np.diff(ends, prepend=0)[w]
        words.append((np.argsort(s, kind="stable"), ends[w] - n, n))
        total += n
    return words, total


def _by_words(q: np.ndarray, stored: np.ndarray, ids: np.ndarray, radius: int, words: list, few: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As nearest_in, of the queries at the places `few`, comparing them with what has a word alike."""
    found = [(np.empty(0, np.int64),) * 3]
    for order, start, n in words:
        rows = few[n[few] > 0]
        ends = np.cumsum(n[rows])
        a = 0
        while a < len(rows):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + GATHER, "right")))
            some, n_some = rows[a:b], n[rows[a:b]]
            at = np.repeat(some, n_some)
            of = order[np.arange(len(at)) + np.repeat(start[some] - np.cumsum(n_some) + n_some, n_some)]
            d = np.bitwise_count(q[at] ^ stored[of])
            hit = np.flatnonzero(d <= radius)
            if len(hit):
                found.append(_least(at[hit], d[hit].astype(np.int64), ids[of[hit]]))
            a = b
    return _least(*(np.concatenate(x) for x in zip(*found)))


def nearest_in(q: np.ndarray, stored: np.ndarray, rings: np.ndarray, ids: np.ndarray, center: np.uint64, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the queries with a stored hash within the radius: their places, the least distance, and the least id at it. stored in order of rings."""
    d = np.bitwise_count(q ^ center).astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(np.bincount(rings, minlength=65))])
    group = d // TOGETHER * TOGETHER
    in_rings = upto[np.minimum(group + TOGETHER - 1 + radius, 64) + 1] - upto[np.maximum(group - radius, 0)]
    at, far, near = [], [], []
    left = np.ones(len(q), bool)
    # what has a word alike is gathered, at about eight times the cost of a hash of the rings; the words are worth it only where many are compared
    if 64 // (radius + 1) >= 4 and in_rings.sum() > (radius + 1) * (50_000 + 10 * (len(q) + len(stored))):
        words, n = _alike(q, stored, radius)
        left = 8 * n > in_rings
        for part, x in zip((at, far, near), _by_words(q, stored, ids, radius, words, np.flatnonzero(~left))):
            part.append(x)
    for value in np.unique(group[left]):
        lo, hi = np.searchsorted(rings, value - radius, "left"), np.searchsorted(rings, value + TOGETHER - 1 + radius, "right")
        of = np.flatnonzero(left & (group == value))
        wide = min(BLOCK, max(1, hi - lo))  # where many are stored, some of them at a time
        step = max(1, BLOCK // wide)
        for a in range(0, len(of) if hi > lo else 0, step):
            rows = of[a : a + step]
            for s in range(lo, hi, wide):
                m = np.bitwise_count(q[rows, None] ^ stored[None, s : min(hi, s + wide)])
                i, j = np.nonzero(m <= np.minimum(radius, m.min(axis=1, keepdims=True)))
                if len(i):
                    for part, x in zip((at, far, near), _least(rows[i], m[i, j].astype(np.int64), ids[s + j])):
                        part.append(x)
    join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
    return _least(join(at), join(far), join(near))


class CellIndex:
    """Inverted-file cells of accepted hashes and digests below `path`.

    `matches` takes any radius. State is written as a new version after each batch; open() goes on from the last one. A batch
    that was taken before is known by its name, and rows of one that failed before its end are not read.
    """

    def __init__(self, spark: SparkSession, path: str, state: dict):
        self.spark, self.path, self.state = spark, path.rstrip("/"), state
        self.centers = np.array(state["centers"], dtype=np.int64).view(np.uint64)
        self.low, self.high = np.array(state["low"], dtype=np.int16), np.array(state["high"], dtype=np.int16)
        self.deals = {int(c): n for c, n in state["deals"].items()}
        self._register()

    def _register(self) -> None:
        self.table = f"lumaframe_cells_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {self.table} ({_SCHEMA}) USING parquet CLUSTERED BY (part) SORTED BY (part, key) INTO {self.state['bucketed']} BUCKETS LOCATION '{self._cells()}'")

    def _cells(self) -> str:
        return f"{self.path}/cells-{self.state['generation']}"

    @classmethod
    def create(cls, spark: SparkSession, path: str, first: DataFrame, expected: int, cells: int | None = None, buckets: int | None = None) -> CellIndex:
        """An empty index with centroids for the hashes of `first` (hash).

        expected: number of records the index shall hold in time; it only decides how many cells there are. The sample are the
        SAMPLE distinct hashes with the least hash of themselves.
        """
        cells = cells or min(MOST_CELLS, 1 << max(0, round(math.log2(max(min(CELLS, 2 * math.sqrt(max(1, expected))), expected / DEAL)))))
        mixed = F.xxhash64(F.col("hash"), F.lit(17))
        rows = first.filter(F.col("hash").isNotNull()).select("hash").distinct().orderBy(mixed, "hash").limit(min(SAMPLE, 16 * cells)).collect()
        centers = train(np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64), cells)
        parts = buckets or max(min(FEW_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions"))), min(4096, expected // PART))
        k = len(centers)
        return cls(spark, path, {"centers": centers.view(np.int64).tolist(), "low": [99] * k, "high": [-1] * k, "deals": {}, "parts": parts, "bucketed": parts, "layout": LAYOUT, "generation": 0, "merged": [], "batches": []})

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def save(self) -> None:
        """Write the state as the next version."""
        self.state |= {"low": self.low.tolist(), "high": self.high.tolist(), "deals": self.deals}
        path, fs = self._fs(f"{self.path}/state-{len(self.state['batches']) + len(self.state.get('taken', [])):08d}-{self.state['generation']:08d}.tmp")
        out = fs.create(path, True)
        out.write(bytearray(json.dumps(self.state).encode()))
        out.close()
        done, _ = self._fs(path.toString()[:-4])
        fs.delete(done, False)
        fs.rename(path, done)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> CellIndex:
        p = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
        names = sorted(s.getPath().toString() for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p) if s.getPath().getName().startswith("state-") and not s.getPath().getName().endswith(".tmp"))
        state = json.loads(spark.read.text(names[-1], wholetext=True).first()[0])
        if state.get("layout") != LAYOUT:
            raise ValueError(f"{path} was written by another version: its cells lie in other parts")
        return cls(spark, path, state)

    def _router(self, radius: int, first: bool):
        """Send what is asked to the cells. first: hashes to the nearest cell and digests to theirs; else hashes to the others."""
        shared = self.spark.sparkContext.broadcast((self.centers, self.low, self.high))  # bounded by MOST_CELLS
        keys, n_cells, parts = _Keys(self.deals), len(self.centers), self.state["parts"]

        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            centers, low, high = shared.value
            for rows in _batched(batches):
                out = []
                there = rows[rows["known"]]
                v = there["hash"].to_numpy(np.int64).view(np.uint64)
                if first:
                    v = np.unique(v)
                    key, at = keys(assign(v, centers)[0], v, True)
                    out += _packed(key, v[at])
                    known = rows.loc[rows["digest"].notna(), "digest"]
                    if len(known):
                        w = _digests(known)
                        key, at = keys(n_cells + (w[:, 0] % np.uint64(parts)).astype(np.int64), w[:, 1], True)
                        out += _packed(key, w[at])
                else:
                    limit = np.minimum(there["distance"].to_numpy(np.int64), radius)  # what is nearer, or as near: of equals the least id counts
                    qs, cells = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                    for at, d in _rows(v, centers):
                        there = reached(d, low, high, limit[at : at + len(d)])
                        there[np.arange(len(d)), d.argmin(axis=1)] = False  # it was probed first
                        q, cell = np.nonzero(there)
                        qs.append(at + q), cells.append(cell)
                    asked = v[np.concatenate(qs)]
                    key, where = keys(np.concatenate(cells), asked, True)
                    out += _packed(key, asked[where])
                if out:
                    yield _with_part(pd.DataFrame(out, columns=["key", "packed"]), parts)

        return route

    def _comparer(self, radius: int, all_: bool):
        shared = self.spark.sparkContext.broadcast(self.centers)
        n_cells = len(self.centers)

        def compare(asked: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
            held, mine = _by_key(stored, "packed", "rings", "ids"), _by_key(asked, "packed")
            nobody = (b"", b"", b"")
            hashes, distances, nears, digests, owners = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [], []
            for key, (packed,) in mine.items():
                cell, (there, ring, ids) = key >> _KEY_BITS, held.get(key, nobody)
                ids = np.frombuffer(ids, np.int64)
                if cell >= n_cells:
                    q, s = (np.frombuffer(x, np.uint64).reshape(-1, 4) for x in (packed, there))
                    order = np.argsort(s[:, 0], kind="stable")
                    s, ids = s[order], ids[order]
                    lo, hi = np.searchsorted(s[:, 0], q[:, 0], "left"), np.searchsorted(s[:, 0], q[:, 0], "right")
                    for i in np.flatnonzero(hi > lo):
                        same = (s[lo[i] : hi[i]] == q[i]).all(axis=1)
                        if same.any():  # repeated ones are grouped later
                            digests.append(q[i].astype(">u8").tobytes())
                            owners.append(ids[lo[i] : hi[i]][same].min())
                    continue
                q, rings = np.unique(np.frombuffer(packed, np.uint64)), np.frombuffer(ring, np.uint8)
                order = np.argsort(rings, kind="stable")
                at, far, near = nearest_in(q, np.frombuffer(there, np.uint64)[order], rings[order].astype(np.int64), ids[order], shared.value[cell], radius)
                if all_:
                    distance, who = np.full(len(q), NONE), np.zeros(len(q), np.int64)
                    distance[at], who[at] = far, near
                    hashes.append(q.view(np.int64)), distances.append(distance), nears.append(who)
                elif len(at):
                    hashes.append(q[at].view(np.int64)), distances.append(far), nears.append(near)
            hashes, n = np.concatenate(hashes), len(digests)
            return pd.DataFrame({
                "of_file": np.arange(len(hashes) + n) >= len(hashes), "hash": np.concatenate([hashes, np.zeros(n, np.int64)]), "digest": pd.Series([None] * len(hashes) + digests, dtype=object),
                "distance": np.concatenate([*distances, np.zeros(n, np.int64)]), "near": np.concatenate([*nears, np.array(owners, np.int64)]),
            })

        return compare

    def _stored(self) -> DataFrame:
        """The rows of committed batches."""
        return self.spark.table(self.table).filter(F.col("batch").isin(self.state["merged"] + self.state["batches"] or [""]))

    def matches(self, batch: DataFrame, radius: int, folder: str, name: str, n: int | None = None) -> DataFrame:
        """(of_file, hash, digest, distance, near): the nearest accepted hash within the radius of each hash of the batch (hash,
        digest) that has one, with the least id of the records at that distance, and for each known digest the least id.
        """
        return self._nearest(*self._matches(batch, radius, folder, name, n))

    @staticmethod
    def _nearest(*found: DataFrame) -> DataFrame:
        both = found[0] if len(found) == 1 else found[0].unionByName(found[1])
        best = both.groupBy("of_file", "hash", "digest").agg(F.min(F.struct("distance", "near")).alias("r"))
        return best.select("of_file", "hash", "digest", "r.distance", "r.near")

    def _matches(self, batch: DataFrame, radius: int, folder: str, name: str, n: int | None) -> tuple[DataFrame, DataFrame]:
        """What was found of hashes and of digests, each in all cells that were probed. The digests are found with the first cells already, so that
        who asks for them doesn't probe the others again."""
        known = F.col("hash").isNotNull().alias("known")
        rows = batch.select(known, F.coalesce("hash", F.lit(0)).alias("hash"), _whole_digest().alias("digest"))

        n = batch.count() if n is None else n

        def probe(asked: DataFrame, first: bool, to: str) -> DataFrame:
            sent, stored = asked.mapInPandas(self._router(radius, first), _SENT), self._stored()
            if not first:
                stored = stored.filter(F.col("key") < len(self.centers) << _KEY_BITS)  # no digests
            if n <= SMALL:
                sent = stage(sent, folder, f"{to}-sent")
                keys = [r[0] for r in sent.select("key").distinct().limit(MOST_CELLS).collect()]
                stored = stored.filter(F.col("key").isin(keys or [-1]))  # reaches the row groups, which are sorted by key
            stored = stored.select("part", "key", "packed", "rings", "ids")
            return sent.groupBy("part").cogroup(stored.groupBy("part")).applyInPandas(self._comparer(radius, first), _FOUND)

        splits = max(1, math.ceil(n / SPLIT))
        hashes, digests = [], []
        for i in range(splits):
            mine = rows if splits == 1 else rows.filter(F.pmod(F.xxhash64("hash"), F.lit(splits)) == i)
            one = stage(probe(mine, True, f"{name}-1-{i}"), folder, f"{name}-1-{i}")
            two = probe(one.filter(~F.col("of_file")).select(F.lit(True).alias("known"), "hash", "distance"), False, f"{name}-2-{i}")
            two = two if splits == 1 else stage(two, folder, f"{name}-2-{i}")
            hashes += [one.filter(~F.col("of_file") & (F.col("distance") < NONE)), two]
            digests.append(one.filter("of_file"))
        return reduce(DataFrame.unionByName, hashes), reduce(DataFrame.unionByName, digests)

    def append(self, accepted: DataFrame, name: str) -> None:
        """Add accepted records (key, hash, digest) to their cells as batch `name`, and save."""
        shared = self.spark.sparkContext.broadcast(self.centers)
        keys, n_cells, parts = _Keys(self.deals), len(self.centers), self.state["parts"]

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in _batched(batches):
                out = []
                there = rows[rows["known"]]
                v, ids = there["hash"].to_numpy(np.int64).view(np.uint64), there["id"].to_numpy(np.int64)
                key, _ = keys(assign(v, shared.value)[0], v, False)
                out += [(k, p, i) for (k, p), (_, i) in zip(_packed(key, v), _packed(key, ids))]
                known = rows[rows["digest"].notna()]
                if len(known):
                    w, ids = _digests(known["digest"]), known["id"].to_numpy(np.int64)
                    key, _ = keys(n_cells + (w[:, 0] % np.uint64(parts)).astype(np.int64), w[:, 1], False)
                    out += [(k, p, i) for (k, p), (_, i) in zip(_packed(key, w), _packed(key, ids))]
                yield _with_part(pd.DataFrame(out, columns=["key", "packed", "ids"]), parts)

        packs = accepted.select(F.col("key").alias("id"), F.col("hash").isNotNull().alias("known"), F.coalesce("hash", F.lit(0)).alias("hash"), _whole_digest().alias("digest")).mapInPandas(place, _PACKS)
        self._write(packs.repartition(self.state["bucketed"], "part").groupBy("part").applyInPandas(_merger(shared, name), _SCHEMA))
        self.state["batches"].append(name)
        self._measure(name)
        if len(self.state["batches"]) >= MERGE_AFTER:
            self.merge()
        self.save()

    def _write(self, rows: DataFrame) -> None:
        rows.write.format("parquet").mode("append").bucketBy(self.state["bucketed"], "part").sortBy("part", "key").option("path", self._cells()).option("compression", "zstd").option("parquet.block.size", 8 << 20).saveAsTable(self.table)

    def _measure(self, name: str) -> None:
        """Take the rings of the batch's rows into the bounds: a row per cell."""
        cell = F.shiftrightunsigned("key", _KEY_BITS)
        rows = self.spark.table(self.table).filter((F.col("batch") == name) & (cell < len(self.centers)))
        for c, low, high in rows.groupBy(cell.alias("cell")).agg(F.min("low"), F.max("high")).collect():
            self.low[c], self.high[c] = min(self.low[c], low), max(self.high[c], high)

    def merge(self) -> None:
        """Write the rows of each cell as one, in a new generation of the table, and deal cells that have grown hot."""
        old, rows = self.table, self._stored()
        cell = F.shiftrightunsigned("key", _KEY_BITS).alias("cell")
        hot = rows.groupBy(cell).agg(F.sum("n").alias("n")).filter(F.col("n") > DEAL).collect()  # a row per DEAL records at most
        deals = {**self.deals, **{c: 1 << math.ceil(math.log2(n / DEAL)) for c, n in hot}}
        shared, name = self.spark.sparkContext.broadcast(self.centers), f"merged-{self.state['generation'] + 1}"
        packs = rows.select("part", "key", "packed", "ids")
        total = rows.agg(F.sum("n")).first()[0] or 0
        parts = max(self.state["parts"], min(4096, 1 << math.ceil(math.log2(1 + total / (2 * PART)))))
        if deals != self.deals or parts != self.state["parts"]:
            packs = packs.mapInPandas(_dealer(_Keys(deals), len(self.centers), parts), _PACKS)
        merged = packs.groupBy("part").applyInPandas(_merger(shared, name), _SCHEMA)
        gone = self._cells()
        self.deals, self.state["generation"], self.state["merged"] = deals, self.state["generation"] + 1, [name]
        self.state["parts"] = self.state["bucketed"] = parts
        self.state.setdefault("taken", []).extend(self.state["batches"])
        self.state["batches"] = []
        self._register()
        self._write(merged)
        self.save()
        self.spark.sql(f"DROP TABLE {old}")
        path, fs = self._fs(gone)
        fs.delete(path, True)

    def taken(self, name: str) -> bool:
        return name in self.state["batches"] or name in self.state.get("taken", [])

    def close(self) -> None:
        """Forget the table; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


class _Keys:
    """Keys of cells, given the cells that are dealt into parts."""

    def __init__(self, deals: dict[int, int]):
        self.deals = dict(deals)

    def __call__(self, cell: np.ndarray, value: np.ndarray, everywhere: bool) -> tuple[np.ndarray, np.ndarray]:
        """Keys, and the places of the values that go there: all parts of a dealt cell, or the value's own."""
        at = np.arange(len(cell))
        if not self.deals or not len(cell):
            return cell << _KEY_BITS, at
        seen, back = np.unique(cell, return_inverse=True)
        parts = np.array([self.deals.get(int(c), 1) for c in seen])[back]
        if not everywhere:
            return (cell << _KEY_BITS) | ((value * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts), at
        at = np.repeat(at, parts)
        part = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
        return (cell[at] << _KEY_BITS) | part, at


_PACKS = "part int, key bigint, packed binary, ids binary"


def _with_part(rows: pd.DataFrame, parts: int) -> pd.DataFrame:
    rows.insert(0, "part", _part(rows["key"].to_numpy(np.int64), parts))
    return rows


def _dealer(keys: _Keys, n_cells: int, parts: int):
    """Rows of packs dealt anew."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, packed, ids in zip(batch["key"], batch["packed"], batch["ids"]):
                cell = int(key) >> _KEY_BITS
                v = np.frombuffer(packed, np.uint64)
                if cell >= n_cells:  # digests are dealt to as many cells as there are parts
                    v = v.reshape(-1, 4)
                    new, _ = keys(n_cells + (v[:, 0] % np.uint64(parts)).astype(np.int64), v[:, 1], False)
                else:
                    new, _ = keys(np.full(len(v), cell), v, False)
                out += [(k, p, i) for (k, p), (_, i) in zip(_packed(new, v), _packed(new, np.frombuffer(ids, np.int64)))]
            yield _with_part(pd.DataFrame(out, columns=["key", "packed", "ids"]), parts)

    return deal


def _merger(shared, name: str):
    """One row of all packs of a key: equal values once, with the least id, in order of their rings."""

    def merge(part: tuple, packs: pd.DataFrame) -> pd.DataFrame:
        out = []
        for key, (ids, v) in sorted(_by_key(packs, "ids", "packed").items()):
            cell = key >> _KEY_BITS
            ids, v = np.frombuffer(ids, np.int64), np.frombuffer(v, np.uint64)
            digests = cell >= len(shared.value)
            v = v.reshape(-1, 4) if digests else v
            order = np.lexsort((ids, *v.T[::-1])) if digests else np.lexsort((ids, v))
            ids, v = ids[order], v[order]
            first = np.ones(len(v), bool)
            first[1:] = (v[1:] != v[:-1]).any(axis=1) if digests else v[1:] != v[:-1]
            ids, v = ids[first], v[first]
            ring = np.zeros(len(v), np.uint8) if digests else np.bitwise_count(v ^ shared.value[cell])
            order = np.argsort(ring, kind="stable")
            out.append((part[0], key, name, len(v), int(ring.min()), int(ring.max()), v[order].tobytes(), b"" if digests else ring[order].tobytes(), ids[order].tobytes()))
        return pd.DataFrame(out, columns=["part", "key", "batch", "n", "low", "high", "packed", "rings", "ids"])

    return merge


_TAKEN = "key bigint, near bigint, distance int, same_file boolean"


def take_batch(index: CellIndex, batch: DataFrame, radius: int, folder: str, name: str, n: int | None = None) -> DataFrame:
    """Check the batch `name` (key, hash, digest) against the index and append what repeats nothing.

    n: its number of rows, if it is known. Returns key, near (the id of the nearest accepted record: with the same digest, else at the least distance), distance (of
    the hashes; null if only the digest is the same), same_file, of the rows that repeat one. Rows of the same batch aren't
    compared with each other. A batch that was taken before isn't taken again: its result, which lies in `folder`, is returned.
    """
    spark = index.spark
    if index.taken(name):
        return spark.read.schema(_TAKEN).parquet(f"{folder}/{name}")
    if not (index.state["batches"] or index.state["merged"]):
        repeats = stage(spark.createDataFrame([], _TAKEN), folder, name)
        index.append(batch, name)
        return repeats
    hashes, digests = index._matches(batch, radius, folder, f"found-{name}", n)
    of_hash = index._nearest(hashes).select("hash", F.col("near").alias("near_hash"), "distance")
    of_digest = index._nearest(digests).select(F.col("digest").alias("d32"), F.col("near").alias("near_digest"))
    rows = batch.withColumn("d32", _whole_digest()).join(of_hash, "hash", "left").join(of_digest, "d32", "left").filter("near_hash IS NOT NULL OR near_digest IS NOT NULL")
    repeats = stage(rows.select("key", F.coalesce("near_digest", "near_hash").alias("near"), "distance", F.col("near_digest").isNotNull().alias("same_file")), folder, name)
    index.append(batch.join(repeats.select("key"), "key", "left_anti"), name)
    return repeats


def _decided(fingerprints: DataFrame, radius: int) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Current fingerprints, their classes (digest, hash, period, key, n_images), and what take_batch says of the classes."""
    spark = fingerprints.sparkSession
    folder = shared_folder(spark)
    current = stage(
        current_fingerprints(fingerprints, "digest", "dhash_full").filter(F.col("created_at").isNotNull()).select(
            "image_id", month(F.col("created_at")).alias("period"), "digest", F.col("dhash_full").alias("hash")
        ),
        folder,
        "current",
    )
    # what has no digest has no copies: each such image is a class of its own
    own = F.when(F.col("digest").isNull(), F.col("image_id"))
    classes = current.groupBy("digest", "hash", own.alias("own")).agg(F.min("period").alias("period"), F.min("image_id").alias("key"), F.count("*").alias("n_images"))
    classes = stage(classes.drop("own"), folder, "classes", ("period",))
    free_shuffles(spark)
    sizes = {r["period"]: r["count"] for r in classes.groupBy("period").count().collect()}  # one row a month
    if len(sizes) < 2:
        return None
    periods = sorted(sizes)
    index = CellIndex.create(spark, f"{folder}/accepted", classes.filter(F.col("period") == periods[0]), sum(sizes.values()))
    for period in periods:
        take_batch(index, classes.filter(F.col("period") == period).select("key", "hash", "digest"), radius, f"{folder}/taken", f"period={period}", sizes[period])
        free_shuffles(spark)
    index.close()
    taken = spark.read.schema(_TAKEN).parquet(*(f"{folder}/taken/period={p}" for p in periods))
    return current, classes, taken


def repeated_images(fingerprints: DataFrame, radius: int = 3) -> DataFrame:
    """Images whose current fingerprint repeats one that was accepted in an earlier month (image_id).

    Month by month of created_at, an image that has the same digest as an accepted one, or a dhash_full within `radius`,
    is a case; the others are accepted and go into the cells. An unknown digest or hash equals nothing; an image without
    created_at belongs to no month, is compared with nothing and never a case. Images of one digest and hash are decided
    once, in the first month they occur: in later months they repeat whatever decided it then. That also keeps a picture
    with a third of all rows from being probed or stored more than once. Repeated rows, ties and extra columns: see
    current_fingerprints. An empty table gives no rows.
    """
    decided = _decided(fingerprints, radius)
    if decided is None:
        return fingerprints.sparkSession.createDataFrame([], "image_id bigint")
    current, classes, taken = decided
    known = classes.join(taken.select("key", F.lit(True).alias("repeats")), "key", "left").withColumn("repeats", F.col("repeats").isNotNull())
    single = known.filter("n_images = 1 AND repeats").select(F.col("key").alias("image_id"))
    many = known.filter("n_images > 1").select("digest", F.col("hash").alias("h"), F.col("period").alias("first"), "repeats")
    copies = (
        current.join(many, "digest")
        .filter(F.col("hash").eqNullSafe(F.col("h")) & (F.col("repeats") | (F.col("period") > F.col("first"))))
        .select("image_id")
    )
    return single.unionByName(copies)


def nearest_accepted(fingerprints: DataFrame, radius: int = 3) -> DataFrame:
    """class_id, near_id, distance, same_file of each class of images (one digest and hash, named by its least image) that repeats
    a class accepted in an earlier month: the least image of the nearest one. See repeated_images and take_batch."""
    decided = _decided(fingerprints, radius)
    if decided is None:
        return fingerprints.sparkSession.createDataFrame([], "class_id bigint, near_id bigint, distance int, same_file boolean")
    return decided[2].select(F.col("key").alias("class_id"), F.col("near").alias("near_id"), "distance", "same_file")

"""Near-duplicate hashes: self-join of binary tries over 64-bit hashes within a Hamming budget.

A trie node is a range of sorted hashes that share a prefix. The join walks pairs of nodes together, adds up the bits in
which their prefixes differ, and drops a pair as soon as the sum exceeds its budget. One trie in the hashes' own order
would spend the whole budget on its upper levels, where it prunes nothing. So the 64 bits are cut into parts, each part
heads a trie of its own (the hash rotated), and the budgets t of the parts are chosen with sum(t + 1) = budget + 1: two
hashes that exceed t in every part differ in more than `budget` bits, hence no pair is lost. A pair is kept only by the
first part whose budget it meets.

The upper levels are walked on the driver, over a histogram of 256 nodes a part; its leaves and the surviving node pairs
become the tasks. The lower levels are walked in the tasks, in numpy, many node pairs at a time.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaframe.operators.current import current_fingerprints
from lumaframe.session import drop_stage, free_shuffles, shared_folder, stage

BITS = 64
TOP = 8  #: levels of the trie that the driver walks
LEAF_PAIRS = 64  #: node pairs of no more hash pairs than this are compared at once
GIANT_PAIRS = 1 << 24  #: node pairs of more hash pairs than this, at the end of a part, are joined by their other parts
FRONTIER = 1 << 18  #: node pairs walked together
ROWS = 1 << 21  #: hashes compared together
PAIRS = 1 << 20  #: found pairs that a task hands on together
PARTNERS = 4  #: partner leaves that meet a host leaf in one task
ACROSS = 1 << 20  #: hashes of either side in a task of near_across, about
LEAF_HASHES = 1 << 17  #: hashes in a leaf of the upper trie, at least
LEAF_MOST = 1 << 22  #: and at most, as long as the histogram can tell leaves that small apart; 32 MB


class Part(NamedTuple):
    start: int
    length: int
    budget: int


def _ball(length: int, radius: int) -> int:
    return sum(math.comb(length, i) for i in range(min(length, radius) + 1))


def cut(spans: list[tuple[int, int]], budget: int) -> list[Part]:
    """Give each span of bits its share t of the budget, with sum(t + 1) = budget + 1."""
    spare = budget + 1 - len(spans)
    base, extra = divmod(max(0, spare), len(spans))
    parts = [Part(s, n, base + (i < extra)) for i, (s, n) in enumerate(spans)]
    return parts if spare >= 0 else parts[: budget + 1]


def layout(n: int, budget: int) -> list[Part]:
    """The cut of the 64 bits with the least expected work for n hashes; every cut finds the same pairs."""

    def cost(parts: list[Part]) -> float:
        total = 0.0
        for p in parts:
            depth = min(p.length, max(1, int(math.log2(max(2, n)))))
            total += 8 * n * _ball(depth, p.budget) + n * n * _ball(p.length, p.budget) / 2.0**p.length
        return total

    choices = []
    for m in range(1, min(budget + 1, 8) + 1):
        edges = [round(i * BITS / m) for i in range(m + 1)]
        choices.append(cut([(a, b - a) for a, b in zip(edges, edges[1:])], budget))
    return min(choices, key=cost)


def rotate(v: np.ndarray, start: int) -> np.ndarray:
    return v if start == 0 else (v << np.uint64(start)) | (v >> np.uint64(BITS - start))


def _differing(x: np.ndarray, part: Part) -> np.ndarray:
    return np.bitwise_count(rotate(x, part.start) >> np.uint64(BITS - part.length))


def _compare(a: np.ndarray, b: np.ndarray, r: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of the pairs within the budget, of all pairs of each row (a from, a to, b from, b to) of r."""
    r = r[np.argsort(r[:, 2] - r[:, 3], kind="stable")]  # most of b first, so that those with a k-th hash are a prefix
    ends = np.cumsum(r[:, 1] - r[:, 0])
    at = 0
    while at < len(r):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ROWS, "right")))
        q = r[at:to]
        n = q[:, 1] - q[:, 0]
        row = np.repeat(np.arange(len(q)), n)
        ia = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + q[row, 0]
        nb, va, ib = (q[:, 3] - q[:, 2])[row], a[ia], q[row, 2]
        for k in range(int(nb[0]) if len(nb) else 0):
            m = int(np.searchsorted(-nb, -k, "left"))
            hit = np.flatnonzero(np.bitwise_count(va[:m] ^ b[ib[:m] + k]) <= budget)
            if len(hit):
                yield ia[hit], ib[hit] + k
        at = to


def _walk(a: np.ndarray, b: np.ndarray, same: bool, part: Part, budget: int, others: list[Part], spent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of pairs within the budget of two sorted, rotated arrays, whose first part.length bits differ in part.budget at most.

    others: parts not used yet; spent: bits in which all pairs differ in the parts used before this one.
    """
    stack = [(0, np.array([[0, len(a), 0, len(b)]], dtype=np.int64), np.zeros(1, dtype=np.int64))]
    while stack:
        depth, r, errors = stack.pop()
        if len(r) > FRONTIER:
            half = len(r) // 2
            stack += [(depth, r[:half], errors[:half]), (depth, r[half:], errors[half:])]
            continue
        work = (r[:, 1] - r[:, 0]) * (r[:, 3] - r[:, 2])
        ended = depth == part.length
        giant = (work > GIANT_PAIRS) & ended & bool(others)
        leaf = ((work <= LEAF_PAIRS) | ended) & ~giant
        for i in np.flatnonzero(giant):
            (al, ah, bl, bh), gone = r[i], spent + int(errors[i])
            spans = [((p.start - part.start) % BITS, p.length) for p in others]
            for ia, ib in _local(a[al:ah], b[bl:bh], same and al == bl, budget, cut(spans, budget - gone), gone):
                yield ia + al, ib + bl
        if leaf.any():
            for ia, ib in _compare(a, b, r[leaf], budget):
                keep = (ia < ib) if same else slice(None)
                if len(ia[keep]):
                    yield ia[keep], ib[keep]
        go = ~leaf & ~giant
        if not go.any():
            continue
        r, errors = r[go], errors[go]
        prefix = np.uint64(0) if depth == 0 else np.uint64(((1 << depth) - 1) << (BITS - depth))
        bit = np.uint64(1 << (BITS - 1 - depth))
        am = np.clip(np.searchsorted(a, (a[r[:, 0]] & prefix) | bit), r[:, 0], r[:, 1])
        bm = np.clip(np.searchsorted(b, (b[r[:, 2]] & prefix) | bit), r[:, 2], r[:, 3])
        a0, a1, b0, b1 = (r[:, 0], am), (am, r[:, 1]), (r[:, 2], bm), (bm, r[:, 3])
        diagonal = (r[:, 0] == r[:, 2]) & same
        rows, sums = [], []
        for (x, y, more) in ((a0, b0, 0), (a1, b1, 0), (a0, b1, 1), (a1, b0, 1)):
            c = np.stack([*x, *y], axis=1)
            keep = (c[:, 0] < c[:, 1]) & (c[:, 2] < c[:, 3]) & (errors + more <= part.budget)
            if x is a1 and y is b0:
                keep &= ~diagonal
            rows.append(c[keep])
            sums.append(errors[keep] + more)
        rows, sums = np.concatenate(rows), np.concatenate(sums)
        if len(rows):
            stack.append((depth + 1, rows, sums))


def _one(a: np.ndarray, b: np.ndarray, same: bool, budget: int, parts: list[Part], i: int, spent: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of the pairs of a and b that part i finds first."""
    ra = rotate(a, parts[i].start)
    oa = np.argsort(ra, kind="stable")
    rb, ob = (ra, oa) if same else (rotate(b, parts[i].start), None)
    if ob is None:
        ob = np.argsort(rb, kind="stable")
    others = [p for j, p in enumerate(parts) if j != i]
    for ia, ib in _walk(ra[oa], rb[ob], same, parts[i], budget, others, spent):
        ia, ib = oa[ia], ob[ib]
        x = a[ia] ^ b[ib]
        keep = _differing(x, parts[i]) <= parts[i].budget  # leaves that were compared early hold other pairs too
        for p in parts[:i]:
            keep &= _differing(x, p) > p.budget
        if keep.any():
            yield ia[keep], ib[keep]


def _local(a: np.ndarray, b: np.ndarray, same: bool, budget: int, parts: list[Part], spent: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of the pairs of a and b within the budget, each pair once."""
    for i in range(len(parts)):
        yield from _one(a, b, same, budget, parts, i, spent)


def pairs_of(values: np.ndarray, budget: int, parts: list[Part] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs (each once) of distinct uint64 hashes that differ in `budget` bits at most, on one machine."""
    found = list(_local(values, values, True, budget, parts or layout(len(values), budget)))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = (np.concatenate(c) for c in zip(*found))
    return np.minimum(a, b), np.maximum(a, b)


class Plan(NamedTuple):
    first_leaf: list[np.ndarray]  #: by part, the leaf of each of the 256 upper nodes
    blocks: list[np.ndarray]  #: by part, the number of leaves into which the node's hashes are dealt
    targets: dict[int, list[tuple[int, int]]]  #: by leaf, (task, role); role 0 partner, 1 host, 2 host that also joins itself
    part_of: list[int]  #: by task


def plan(counts: np.ndarray, parts: list[Part], leaves_at_least: int = 32) -> Plan:
    """Walk the upper levels: counts[part, node] of 2**TOP nodes a part. Leaves and tasks are bounded by the histogram.

    A subtree of few hashes is one leaf. A node that holds too many even at the lowest of these levels is dealt into
    blocks by a hash, each a leaf, and all pairs of its blocks are joined: no task ever gets a third of all hashes.
    """
    n = int(counts[0].sum())
    cap = max(LEAF_HASHES, min(n // leaves_at_least, LEAF_MOST), n // 512)  # larger leaves have fewer partners, so hashes fewer copies
    first_leaf, blocks, targets, part_of, leaves = [], [], defaultdict(list), [], 0
    for i, part in enumerate(parts):
        top = min(TOP, part.length)
        count = counts[i][: 1 << top]
        first, dealt = np.full(1 << TOP, -1, dtype=np.int64), np.ones(1 << TOP, dtype=np.int64)

        def grow(prefix: int, depth: int):
            nonlocal leaves
            lo, hi = prefix << (top - depth), (prefix + 1) << (top - depth)
            c = int(count[lo:hi].sum())
            if c == 0:
                return None
            if c > cap and depth < top:
                return [grow(2 * prefix, depth + 1), grow(2 * prefix + 1, depth + 1)]
            k = -(-c // cap)
            first[lo:hi], dealt[lo:hi] = leaves, k
            leaves += k
            return range(leaves - k, leaves)

        met: list[tuple[int, int]] = []

        def walk(u, v, errors: int, one: bool) -> None:
            if u is None or v is None or errors > part.budget:
                return
            if isinstance(u, range) and isinstance(v, range):
                met.extend((x, y) for x in u for y in v if not one or x <= y)
            elif isinstance(u, range):
                walk(u, v[0], errors, False), walk(u, v[1], errors, False)
            elif isinstance(v, range):
                walk(u[0], v, errors, False), walk(u[1], v, errors, False)
            else:
                walk(u[0], v[0], errors, one), walk(u[1], v[1], errors, one), walk(u[0], v[1], errors + 1, False)
                if not one:
                    walk(u[1], v[0], errors + 1, False)

        root = grow(0, 0)
        walk(root, root, 0, True)
        partners = defaultdict(list)
        for x, y in met:
            if x == y:
                partners[x]
            else:  # hosts by turns, so that all leaves have about as many partners
                host, other = (x, y) if (x + y) % 2 else (y, x)
                partners[host].append(other)
        for host, others in sorted(partners.items()):
            for at in range(0, max(1, len(others)), PARTNERS):
                task = len(part_of)
                part_of.append(i)
                targets[host].append((task, 1 if at else 2))
                for other in others[at : at + PARTNERS]:
                    targets[other].append((task, 0))
        first_leaf.append(first)
        blocks.append(dealt)
    return Plan(first_leaf, blocks, dict(targets), part_of)


def _router(p: Plan, parts: list[Part]):
    """Send each hash, in packed arrays, to the tasks of its leaves."""

    def flush(v: np.ndarray) -> pd.DataFrame:
        out = []
        for i, part in enumerate(parts):
            node = (rotate(v, part.start) >> np.uint64(BITS - min(TOP, part.length))).astype(np.int64)
            k = p.blocks[i][node]
            deal = ((v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % k
            leaf = p.first_leaf[i][node] + deal
            order = np.argsort(leaf, kind="stable")
            leaf, w = leaf[order], v[order]
            edges = [0, *(np.flatnonzero(leaf[1:] != leaf[:-1]) + 1), len(leaf)]
            for lo, hi in zip(edges, edges[1:]):
                packed = w[lo:hi].tobytes()
                out += [(task, role, packed) for task, role in p.targets[int(leaf[lo])]]
        return pd.DataFrame(out, columns=["task", "role", "packed"])

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, n = [], 0
        for batch in batches:
            kept.append(batch["v"].to_numpy(np.int64).view(np.uint64))
            n += len(batch)
            if n >= 1 << 19:
                yield flush(np.concatenate(kept))
                kept, n = [], 0
        if n:
            yield flush(np.concatenate(kept))

    return route


def _joiner(part_of: list[int], parts: list[Part], budget: int):
    def join(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches)  # leaves, whose size is bounded; their pairs, which may be many more, leave as they are found
        i = part_of[int(key[0])]
        take = lambda mask: np.frombuffer(b"".join(rows.loc[mask, "packed"]), dtype=np.uint64)
        host, others = take(rows["role"] > 0), take(rows["role"] == 0)
        kept, n = [(host[:0], host[:0])], 0

        def flush() -> pd.DataFrame:
            x, y = (np.concatenate(c).view(np.int64) for c in zip(*kept))
            return pd.DataFrame({"x": np.minimum(x, y), "y": np.maximum(x, y)})

        own = _one(host, host, True, budget, parts, i) if (rows["role"] == 2).any() else ()
        across = _one(host, others, False, budget, parts, i) if len(others) and len(host) else ()
        for other, found in ((host, own), (others, across)):
            for x, y in found:
                kept.append((host[x], other[y]))
                n += len(x)
                if n >= PAIRS:
                    yield flush()
                    kept, n = kept[:1], 0
        yield flush()

    return join


def near_values(values: DataFrame, budget: int, leaves: int = 32) -> DataFrame:
    """Pairs (x, y), x < y, of the distinct BIGINTs in column v that differ in `budget` bits at most; each pair once.

    `values` should be a written table: it is counted, then read twice. The driver gets 256 counts a part. Each hash is
    shuffled, packed to 8 bytes, to the tasks of its leaf in each part, 8 or 9 in all at 10**6 hashes; larger leaves keep
    that number down as the hashes grow, until a leaf has LEAF_MOST of them. leaves: into how many the upper trie is cut,
    about, while they are larger than LEAF_HASHES; a large budget makes most of them meet, so fewer mean fewer copies.
    """
    spark = values.sparkSession
    empty = spark.createDataFrame([], "x bigint, y bigint")
    n = values.count()
    if n < 2:
        return empty
    parts = layout(n, budget)
    bits = F.col("v")

    def node(p: Part):
        turned = F.shiftleft(bits, p.start).bitwiseOR(F.shiftrightunsigned(bits, BITS - p.start)) if p.start else bits
        return F.shiftrightunsigned(turned, BITS - min(TOP, p.length))

    cells = F.explode(F.array(*(node(p) + (i << TOP) for i, p in enumerate(parts)))).alias("cell")
    counts = np.zeros((len(parts), 1 << TOP), dtype=np.int64)
    for cell, c in values.select(cells).groupBy("cell").count().collect():  # 256 rows a part at most
        counts[cell >> TOP, cell & ((1 << TOP) - 1)] = c
    p = plan(counts, parts, leaves)
    n_tasks = len(p.part_of)
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(n_tasks, 4096))
    routed = values.select("v").mapInPandas(_router(p, parts), "task int, role int, packed binary")
    return routed.repartition(width, "task").groupBy("task").applyInPandas(_joiner(p.part_of, parts, budget), "x bigint, y bigint")


def near_across(asked: DataFrame, values: DataFrame, budget: int) -> DataFrame:
    """Pairs (x, y) of the distinct BIGINTs in column v of `asked` and of `values` that differ in `budget` bits at most, equal ones too.

    Both should be written tables. The values are dealt into slices and each goes to one task for each ACROSS that are asked;
    what is asked goes to all slices. In a task tries of all parts are walked.
    """
    spark = values.sparkSession
    m, n = asked.count(), values.count()
    blocks, slices = max(1, -(-m // ACROSS)), max(spark.sparkContext.defaultParallelism, -(-n // ACROSS))
    parts = layout(math.isqrt(max(1, m // blocks) * max(1, n // slices)), budget)

    def dealt(df: DataFrame, role: int, own: int, others: int, own_name: str, other_name: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("v"), F.lit(own)).cast("int").alias(own_name)
        return df.select("v", F.lit(role).alias("role"), mine, F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other_name))

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches)  # 2 * ACROSS, about
        a, b = (rows.loc[rows["role"] == r, "v"].to_numpy(np.int64).view(np.uint64) for r in (1, 0))
        for i, j in _local(a, b, False, budget, parts) if len(a) and len(b) else ():
            yield pd.DataFrame({"x": a[i].view(np.int64), "y": b[j].view(np.int64)})

    both = dealt(asked, 1, blocks, slices, "block", "slice").unionByName(dealt(values, 0, slices, blocks, "slice", "block"))
    cells = both.repartition(min(4096, blocks * slices), "block", "slice").groupBy("block", "slice")
    return cells.applyInPandas(_chunks(join), "x bigint, y bigint")


def _chunks(join: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]):
    """As applyInPandas over batches wants it; found pairs are handed on PAIRS at a time."""

    def run(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, n = [pd.DataFrame({"x": np.empty(0, np.int64), "y": np.empty(0, np.int64)})], 0
        for found in join(batches):
            kept.append(found)
            n += len(found)
            if n >= PAIRS:
                yield pd.concat(kept)
                kept, n = kept[:1], 0
        yield pd.concat(kept)

    return run


def near_duplicate_images(fingerprints: DataFrame, budget: int = 6) -> DataFrame:
    """Pairs image_a < image_b of images with different file digests whose current hashes are near.

    Near: the least of the distances full-full, crop-crop, full-crop and crop-full is `budget` or less. Rows without
    image_id are left out, and unknown hashes are near to none; an unknown digest is different from every other. Images
    with the same digest and hashes are one class until the result is written out, so a picture that holds a third of
    all rows takes part once. Repeated rows, ties of created_at and extra columns: see current_fingerprints.
    """
    spark = fingerprints.sparkSession
    folder = shared_folder(spark)
    unknown = F.concat(F.lit(b"?"), F.encode(F.col("image_id").cast("string"), "UTF-8"))
    current = stage(
        current_fingerprints(fingerprints, "digest", "dhash_full", "dhash_crop").select(
            "image_id", F.coalesce("digest", unknown).alias("digest"), F.col("dhash_full").alias("full"), F.col("dhash_crop").alias("crop")
        ),
        folder,
        "current",
    )
    key = ["digest", "full", "crop"]
    classes = stage(current.groupBy(*key).agg(F.min("image_id").alias("rep"), F.count("*").alias("n_images")), folder, "classes")
    free_shuffles(spark)
    carriers = classes.select(F.explode(F.array_distinct(F.array("full", "crop"))).alias("v"), "rep", "digest").filter(F.col("v").isNotNull())
    values = stage(carriers.groupBy("v").agg(F.count("*").alias("n_classes")), folder, "values")
    free_shuffles(spark)
    near = stage(near_values(values, budget), folder, "near")
    free_shuffles(spark)
    links = near.unionByName(values.filter("n_classes > 1").select(F.col("v").alias("x"), F.col("v").alias("y")))
    left = carriers.select(F.col("v").alias("x"), F.col("rep").alias("rep_x"), F.col("digest").alias("digest_x"))
    right = carriers.select(F.col("v").alias("y"), F.col("rep").alias("rep_y"), F.col("digest").alias("digest_y"))
    between = (
        links.join(left, "x")
        .join(right, "y")
        .filter(F.col("digest_x") != F.col("digest_y"))
        .select(F.least("rep_x", "rep_y").alias("rep_a"), F.greatest("rep_x", "rep_y").alias("rep_b"))
        .distinct()
    )
    between = stage(between, folder, "between")
    drop_stage(spark, folder, "near")
    free_shuffles(spark)
    ends = between.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).distinct()
    many = classes.filter("n_images > 1").join(ends, "rep", "left_semi")
    members = current.join(
        many.select("rep", F.col("digest").alias("d"), F.col("full").alias("f"), F.col("crop").alias("c")),
        (F.col("digest") == F.col("d")) & F.col("full").eqNullSafe(F.col("f")) & F.col("crop").eqNullSafe(F.col("c")),
    ).select("rep", "image_id")
    single = ends.join(many.select("rep"), "rep", "left_anti").select("rep", F.col("rep").alias("image_id"))
    members = members.unionByName(single)
    a = members.select(F.col("rep").alias("rep_a"), F.col("image_id").alias("a"))
    b = members.select(F.col("rep").alias("rep_b"), F.col("image_id").alias("b"))
    return between.join(a, "rep_a").join(b, "rep_b").select(F.least("a", "b").alias("image_a"), F.greatest("a", "b").alias("image_b"))

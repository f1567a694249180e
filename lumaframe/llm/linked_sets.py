"""One identifier for everything that is linked, directly or over others.

Low-diameter decomposition: every vertex draws a delay from an exponential distribution; it starts a cluster of its own
unless an earlier cluster has reached it by then, growing by one link a round. Clusters stay of logarithmic radius however
long the chains are, and a constant share of the links falls inside them. Each cluster becomes one vertex of the next
level, which keeps only the links between clusters; when none is left, the assignments of the levels are composed. Rounds
and levels grow with the logarithm of the number of vertices, not with the length of the longest chain.

A group is a star: its least member is linked to each other member. So a group of k members has k - 1 links, and what its
hub receives is combined before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lumaframe.session import drop_stage, free_shuffles, shared_folder, stage

RATE = 0.7  #: of the exponential distribution: a larger one makes smaller clusters in fewer rounds
FEW_EDGES = 1 << 17  #: a level of no more edges (both directions; 2 MB) and those after it are decomposed in one task, by the same method


def _delay(vertex: Column, level: int, seed: int) -> Column:
    """Minus an exponential draw, the same each time it is computed: a lost task can be run again."""
    u = (F.pmod(F.xxhash64(vertex, F.lit(level), F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return F.log(u) / RATE


def _clusters(edges: DataFrame, level: int, seed: int, folder: str) -> DataFrame:
    """(v, center) for each vertex of the edges (src, dst), both directions given. Ties go to the lesser center."""
    state = edges.select(F.col("src").alias("v")).distinct()
    state = stage(state.select("v", _delay(F.col("v"), level, seed).alias("at"), F.col("v").alias("center"), F.lit(True).alias("moved")), folder, f"s{level}-0")
    step, moved = 0, 1
    while moved:
        step += 1
        heard = (
            state.filter("moved")
            .join(edges, F.col("v") == F.col("src"))
            .groupBy(F.col("dst").alias("v"))
            .agg(F.min(F.struct((F.col("at") + 1).alias("at"), "center")).alias("m"))
        )
        better = F.col("m").isNotNull() & (F.col("m") < F.struct(state["at"], state["center"]))
        new = state.join(heard, "v", "left").select(
            "v",
            F.when(better, F.col("m.at")).otherwise(F.col("at")).alias("at"),
            F.when(better, F.col("m.center")).otherwise(F.col("center")).alias("center"),
            better.alias("moved"),
        )
        seen = Observation()
        state = stage(new.observe(seen, F.count_if("moved").alias("n")), folder, f"s{level}-{step}")
        moved = seen.get["n"]
        drop_stage(edges.sparkSession, folder, f"s{level}-{step - 1}")
    return state.select("v", "center")


def _decompose(src: np.ndarray, dst: np.ndarray, level: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(v, center) with the clusters of all further levels contracted: one center per component. Edges in both directions."""
    vertices, ends = np.unique(np.concatenate([src, dst]), return_inverse=True)
    src, dst = ends[: len(src)], ends[len(src) :]
    final, random = np.arange(len(vertices)), np.random.default_rng([seed, level])
    while len(src):
        at, center = -random.exponential(1 / RATE, len(vertices)), np.arange(len(vertices))
        moved = np.ones(len(vertices), bool)
        while moved.any():
            e = np.flatnonzero(moved[src])
            to, when, who = dst[e], at[src[e]] + 1, center[src[e]]
            order = np.lexsort((who, when, to))
            to, when, who = to[order], when[order], who[order]
            first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else to
            to, when, who = to[first], when[first], who[first]
            better = (when < at[to]) | ((when == at[to]) & (who < center[to]))
            moved = np.zeros(len(vertices), bool)
            moved[to[better]] = True
            at[to[better]], center[to[better]] = when[better], who[better]
        final = center[final]
        src, dst = center[src], center[dst]
        between = np.unique(np.stack([src, dst], axis=1)[src != dst], axis=0)
        src, dst = between[:, 0], between[:, 1]
    return vertices, vertices[final]


def _finished(edges: DataFrame, level: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([b[["src", "dst"]] for b in batches] or [pd.DataFrame({"src": [], "dst": []}, dtype="int64")])
        v, center = _decompose(rows["src"].to_numpy(np.int64), rows["dst"].to_numpy(np.int64), level, seed)
        yield pd.DataFrame({"v": v, "center": center})

    return edges.coalesce(1).mapInPandas(run, "v bigint, center bigint")


def connected(links: DataFrame, seed: int = 7) -> DataFrame:
    """(v, root) for each vertex that has a link (a, b) to another one; root is the least vertex of its component."""
    spark = links.sparkSession
    folder = shared_folder(spark)
    links = links.filter(F.col("a") != F.col("b")).select("a", "b")
    edges = stage(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().toDF("src", "dst"), folder, "e0")
    levels: list[tuple[DataFrame, DataFrame]] = []
    label = None
    while n := edges.count():
        k = len(levels)
        few = n <= FEW_EDGES
        assigned = stage(_finished(edges, k, seed), folder, f"a{k}") if few else _clusters(edges, k, seed, folder)
        known = assigned.withColumn("label", F.col("v")) if label is None else assigned.join(label.select(F.col("center").alias("v"), "label"), "v")
        label = stage(known.groupBy("center").agg(F.min("label").alias("label")), folder, f"l{k}")
        levels.append((assigned, label))
        if few:
            break
        from_, to = assigned.select(F.col("v").alias("src"), F.col("center").alias("cs")), assigned.select(F.col("v").alias("dst"), F.col("center").alias("ct"))
        between = edges.join(from_, "src").join(to, "dst").filter(F.col("cs") != F.col("ct")).select(F.col("cs").alias("src"), F.col("ct").alias("dst")).distinct()
        edges = stage(between, folder, f"e{k + 1}")
        free_shuffles(spark)
    roots = None
    for k in reversed(range(len(levels))):
        assigned, label = levels[k]
        of_center = label.withColumnRenamed("label", "root")
        if roots is not None:
            up = roots.select(F.col("v").alias("center"), F.col("root").alias("above"))
            of_center = of_center.join(up, "center", "left").select("center", F.coalesce("above", "root").alias("root"))
        roots = stage(assigned.join(of_center, "center").select("v", "root"), folder, f"r{k}")
        free_shuffles(spark)
    return roots if roots is not None else spark.createDataFrame([], "v bigint, root bigint")


def group_name(tag_name: Column, group_id: Column) -> Column:
    """What a group is called: the number its tag name ends in, however written; without one, the group itself."""
    digits = F.regexp_extract(tag_name, r"(\d+)\D*$", 1)
    number = F.regexp_replace(digits, r"^0+(?=\d)", "")
    return F.when(F.coalesce(number, F.lit("")) != "", F.concat(F.lit("n"), number)).otherwise(F.concat(F.lit("g"), group_id.cast("string")))


def linked_images(group_members: DataFrame, dup_groups: DataFrame) -> DataFrame:
    """(image_id, root_id): each distinct image of group_members and the least image of its linked set.

    Images are linked if they share a group; groups are one if their tag names carry the same number. A null image_id is
    no image; a null group_id links nothing, but its image is listed. A group that dup_groups lacks, or whose tag is null
    or without number, is a group by its id. Repeated rows count once; a group with several tags joins all of them.
    Empty tables give no rows.
    """
    members = group_members.filter(F.col("image_id").isNotNull()).select("group_id", "image_id").distinct()
    names = dup_groups.select("group_id", "tag_name").distinct()
    named = members.filter(F.col("group_id").isNotNull()).join(names, "group_id", "left").select("image_id", group_name(F.col("tag_name"), F.col("group_id")).alias("hub"))
    hubs = named.groupBy("hub").agg(F.min("image_id").alias("a"))
    roots = connected(named.join(hubs, "hub").select("a", F.col("image_id").alias("b")))
    images = members.select("image_id").distinct()
    return images.join(roots.withColumnRenamed("v", "image_id"), "image_id", "left").select("image_id", F.coalesce("root", "image_id").alias("root_id"))

"""Usernames that occur in the addresses of known people."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumaframe.operators import sieve
from lumaframe.session import free_shuffles, shared_folder, stage, unbounded


def performers_by_url(usernames: DataFrame, performers: DataFrame, most: int = 10) -> DataFrame:
    """username, performer_id, name, place: performers one of whose urls contains the username, whatever its case.

    The first `most` by id as text, as the host's search returns. usernames: column username; performers: id, name, urls.
    Null and empty names match nothing.
    """
    hits, names = _hits(usernames, performers, most)
    return hits.join(unbounded(names), "low").select("username", "performer_id", "name", "place")


def matches_by_url(usernames: DataFrame, performers: DataFrame, most: int = 10) -> DataFrame:
    """username, matches: as performers_by_url, the performers of a username as one array of (performer_id, name)."""
    hits, names = _hits(usernames, performers, most)
    lists = hits.groupBy("low").agg(F.collect_list(F.struct("performer_id", "name")).alias("matches"))
    return lists.join(unbounded(names), "low").select("username", "matches")


def _hits(usernames: DataFrame, performers: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """low, performer_id, name, place of the names found, and the names: username, low.

    Every url is read once against a sieve of the names, and only the pieces of it that the sieve lets through are shuffled,
    to meet the names equal to them. Nothing is compared with everything, and a piece that all urls share costs nothing
    unless it is a name. low is the name in lower case, as bytes.
    """
    spark = usernames.sparkSession
    names = stage(usernames.select("username").filter("username <> ''").distinct().withColumn("low", F.lower("username").cast("binary")), shared_folder(spark), "names")
    free_shuffles(spark)
    held = sieve.of(names.select("low"))
    urls = performers.select(F.col("id").cast("string").alias("performer_id"), F.col("name").cast("string").alias("name"), F.explode("urls").alias("url")).filter("url <> ''")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, low = held.value.pieces(b.column("url"))
            found = pa.table({"low": low, "performer_id": b.column("performer_id").take(row), "name": b.column("name").take(row)})
            yield from _first(found, most).to_batches()

    pieces_ = urls.select("performer_id", "name", F.lower("url").cast("binary").alias("url")).mapInArrow(pieces, "low binary, performer_id string, name string")
    found = pieces_.repartition("low").groupBy("low", "performer_id").agg(F.min("name").alias("name"))
    place = F.row_number().over(Window.partitionBy("low").orderBy("performer_id"))
    return found.withColumn("place", place).filter(F.col("place") <= most), names


def _first(found: pa.Table, most: int) -> pa.Table:
    """Each (low, performer_id) once, with its least name, and of each low the `most` least ids: no other can be among the first of all."""
    once = found.group_by(["low", "performer_id"]).aggregate([("name", "min")]).rename_columns({"name_min": "name"}).select(["low", "performer_id", "name"])
    if once.num_rows <= most:
        return once
    code = pc.dictionary_encode(once.column("low").combine_chunks()).indices.to_numpy()
    if np.bincount(code).max() <= most:
        return once
    once = once.append_column("code", pa.array(code))
    order = pc.sort_indices(once, sort_keys=[("code", "ascending"), ("performer_id", "ascending")], null_placement="at_start")
    code = once.column("code").take(order).to_numpy()
    return once.take(order.filter(pa.array(np.arange(len(code)) - np.searchsorted(code, code) < most))).drop_columns(["code"])

"""Pictures to fingerprints. The decoder is pluggable; the one here reads portable gray and colour maps with numpy.

A decoder takes the bytes of a file and returns a two-dimensional array of gray values, or raises. Whatever it raises
becomes the row's error: one unreadable file doesn't stop the rest.
"""

from __future__ import annotations

import os
import re
import shutil
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaframe.functions.bits import RASTER_COLUMNS, RASTER_ROWS, difference_hash
from lumaframe.functions.media import sample_times

CROP = 0.6  #: share of each side that the central crop keeps


def portable_map(content: bytes) -> np.ndarray:
    """Gray values of a binary PGM (P5) or PPM (P6) of one byte a sample."""
    head = re.match(rb"P([56])(?:\s+(?:#[^\n]*\n)?)(\d+)\s+(\d+)\s+(\d+)\s", content)
    if not head or int(head[4]) > 255:
        raise ValueError("no portable map of one byte a sample")
    kind, width, height = int(head[1]), int(head[2]), int(head[3])
    samples = np.frombuffer(content, np.uint8, width * height * (1 if kind == 5 else 3), head.end()).astype(np.float64)
    return samples.reshape(height, width) if kind == 5 else samples.reshape(height, width, 3) @ np.array([0.299, 0.587, 0.114])


def gray_raster(gray: np.ndarray) -> bytes:
    """72 bytes: the picture shrunk to 9 columns and 8 rows, whatever its shape, by the mean of each cell."""
    rows, cols = (np.linspace(0, n, k + 1) for n, k in zip(gray.shape, (RASTER_ROWS, RASTER_COLUMNS)))
    sums = np.pad(gray.cumsum(0).cumsum(1), ((1, 0), (1, 0)))

    def at(edges: np.ndarray, axis: int, table: np.ndarray) -> np.ndarray:
        low = np.minimum(edges.astype(int), table.shape[axis] - 2)
        part = (edges - low).reshape((-1, 1) if axis == 0 else (1, -1))
        return np.take(table, low, axis) * (1 - part) + np.take(table, low + 1, axis) * part

    cells = np.diff(np.diff(at(cols, 1, at(rows, 0, sums)), axis=0), axis=1)
    area = np.outer(np.diff(rows), np.diff(cols))
    return np.clip(np.rint(cells / area), 0, 255).astype(np.uint8).tobytes()


def central(gray: np.ndarray) -> np.ndarray:
    h, w = (max(1, round(n * CROP)) for n in gray.shape)
    top, left = (gray.shape[0] - h) // 2, (gray.shape[1] - w) // 2
    return gray[top : top + h, left : left + w]


def fingerprinted(files: DataFrame, decode: Callable[[bytes], np.ndarray] = portable_map) -> DataFrame:
    """path, file_hash, dhash_full, dhash_crop, width, height, file_size, error of files (path, content)."""

    def rasters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    gray = decode(content)
                    rows.append((path, content, gray_raster(gray), gray_raster(central(gray)), gray.shape[1], gray.shape[0], None))
                except Exception as e:  # noqa: BLE001 any decoder, any file
                    rows.append((path, content, None, None, None, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["path", "content", "full", "crop", "width", "height", "error"]).astype({"width": "Int64", "height": "Int64"})

    decoded = files.select("path", "content").mapInPandas(rasters, "path string, content binary, full binary, crop binary, width bigint, height bigint, error string")
    return decoded.select(
        "path", F.sha2("content", 256).alias("file_hash"), difference_hash(F.col("full")).alias("dhash_full"), difference_hash(F.col("crop")).alias("dhash_crop"),
        "width", "height", F.octet_length("content").cast("bigint").alias("file_size"), "error",
    )


#: how a frame of a video, or an image, is treated before its text is read: treatment, level, and the reader's layout mode
OF_FRAME = (("original", 0, 3), ("negated", 0, 3), ("threshold", 200, 11), ("threshold", 180, 11))
OF_IMAGE = (("original", 0, 3), ("threshold", 200, 11), ("threshold", 180, 11))


def treated(gray: np.ndarray, treatment: str, level: int = 0, scale: int = 2) -> np.ndarray:
    """Gray values made ready for a reader: enlarged, and negated, or black where brighter than the level and white elsewhere."""
    large = np.kron(gray, np.ones((scale, scale)))
    if treatment == "negated":
        return 255 - large
    return np.where(large > level, 0.0, 255.0) if treatment == "threshold" else large


def portable_bytes(gray: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % gray.shape[::-1] + np.clip(np.rint(gray), 0, 255).astype(np.uint8).tobytes()


def portable_extract(path: str, at: float | None, treatment: str, level: int) -> bytes:
    """The extractor for still pictures in portable maps; the original is handed on as it is."""
    with open(path.removeprefix("file:"), "rb") as f:
        content = f.read()
    return content if treatment == "original" else portable_bytes(treated(portable_map(content), treatment, level))


def wanted_frames(items: DataFrame) -> DataFrame:
    """item_id, path, frame_no, at, variant_no, treatment, level, mode: what is to be extracted of items (item_type, item_id,
    path, duration). Of a scene each sample time in OF_FRAME's variants, of an image itself (at is null) in OF_IMAGE's."""
    scene = F.col("item_type") == "scene"
    times = F.when(scene, sample_times(F.col("duration"))).otherwise(F.array(F.lit(None).cast("double")))
    each = lambda variants: F.array(*(F.struct(F.lit(i).alias("variant_no"), F.lit(t).alias("treatment"), F.lit(n).alias("level"), F.lit(m).alias("mode")) for i, (t, n, m) in enumerate(variants)))
    rows = items.select("item_id", "path", scene.alias("scene"), F.posexplode(times).alias("frame_no", "at"))
    return rows.select("item_id", "path", "frame_no", "at", F.explode(F.when(F.col("scene"), each(OF_FRAME)).otherwise(each(OF_IMAGE))).alias("v")).select("item_id", "path", "frame_no", "at", "v.*")


def extracted(wanted: DataFrame, extract: Callable[[str, float | None, str, int], bytes] = portable_extract) -> DataFrame:
    """item_id, frame_no, variant_no, mode, content, error of wanted_frames. A frame that can't be extracted has no content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, at, treatment, level in zip(batch["path"], batch["at"], batch["treatment"], batch["level"]):
                try:
                    out.append((extract(path, None if pd.isna(at) else float(at), treatment, int(level)), None))
                except Exception as e:  # noqa: BLE001 any tool, any file
                    out.append((None, f"{type(e).__name__}: {e}"[:200]))
            yield batch[["item_id", "frame_no", "variant_no", "mode"]].assign(content=[c for c, _ in out], error=[e for _, e in out])

    return wanted.mapInPandas(run, "item_id string, frame_no int, variant_no int, mode int, content binary, error string")


def recognised(frames: DataFrame, read: Callable[[bytes, int], str]) -> DataFrame:
    """item_id, frame_no, variant_no, text of frames (item_id, frame_no, variant_no, mode, content): read(content, mode).

    A failure reads as empty text, and a frame without content isn't read.
    """

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for content, mode in zip(batch["content"], batch["mode"]):
                try:
                    out.append(read(content, int(mode)))
                except Exception:  # noqa: BLE001
                    out.append("")
            yield batch[["item_id", "frame_no", "variant_no"]].assign(text=out)

    there = frames.filter("content IS NOT NULL").select("item_id", "frame_no", "variant_no", "mode", "content")
    return there.mapInPandas(texts, "item_id string, frame_no int, variant_no int, text string")


def missing_tools(*names: str) -> list[str]:
    """Those of the programs that this machine lacks; asked before a run, on the driver or in a task."""
    return [n for n in names if shutil.which(n) is None]


def scratch_folder(*preferred: str) -> str:
    """Where a task's tools may put files of their own: the first folder that exists, else the machine's. Never for data that outlives the task."""
    return next((p for p in preferred if p and os.path.isdir(p)), tempfile.gettempdir())

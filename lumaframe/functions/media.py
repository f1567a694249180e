"""Fields of library items: files, tags, names, paths, sample times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GROUP_PREFIX, PROCESSED_TAG = "dedup:group:", "auto:dedup"
OCR_PROCESSED_TAG, OCR_QUEUE_TAG = "auto:ocr", "ocr:queue"


def first_path(files: Column) -> Column:
    """The first path that isn't empty."""
    return F.get(F.filter(files, lambda f: F.coalesce(f["path"], F.lit("")) != ""), F.lit(0))["path"]


def first_dimensions(files: Column) -> Column:
    """Struct of width, height, size of the first file that has both sides; zeros if none has. A missing size is 0."""
    zero = F.lit(0).cast("bigint")
    sized = F.get(F.filter(files, lambda f: (F.coalesce(f["width"], zero) != 0) & (F.coalesce(f["height"], zero) != 0)), F.lit(0))
    return F.struct(*(F.coalesce(sized[n], zero).alias(n) for n in ("width", "height", "size")))


def ids(entries: Column) -> Column:
    """The distinct ids of an array of structs, sorted as text; empty for null."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(entries, lambda e: e["id"]), lambda i: i.isNotNull())))


def ids_or_none(entries: Column) -> Column:
    return F.coalesce(ids(entries), F.array().cast("array<string>"))


def has_tag(tags: Column, name: str) -> Column:
    """One of the tags has this name, whatever its case; false for null."""
    return F.coalesce(F.exists(tags, lambda t: F.lower(t["name"]) == name.lower()), F.lit(False))


def is_group_tag(name: Column) -> Column:
    return name.startswith(GROUP_PREFIX) | (name == PROCESSED_TAG)


def group_tag(number: Column) -> Column:
    """The tag name of a group: at least four digits."""
    return F.format_string(GROUP_PREFIX + "%04d", number)


def extension(path: Column) -> Column:
    """The lower-case extension with its dot; empty if the last part of the path has none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def with_extension(path: Column, new: str) -> Column:
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", new)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def sample_times(duration: Column, frames: int = 5) -> Column:
    """Evenly spaced seconds within the duration: 0.5 if it is unknown or not positive, its half below three seconds, else
    as many as half its seconds, three at least and `frames` at most, rounded to hundredths."""
    n = F.least(F.lit(frames), F.greatest(F.lit(3), F.floor(duration / 2).cast("int")))
    many = F.transform(F.sequence(F.lit(1), n), lambda i: F.round(duration / (n + 1) * i, 2))
    return F.when(duration.isNull() | (duration <= 0), F.array(F.lit(0.5))).when(duration < 3, F.array(duration / 2)).otherwise(many)


def clamp(v: Column) -> Column:
    """Progress between 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))

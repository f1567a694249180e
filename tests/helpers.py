"""Small tables for tests."""

from datetime import datetime

from lumaframe import schemas

HEX = "0123456789abcdef" * 4


def hex_digest(n: int) -> str:
    return f"{n:064x}"


def at(month: int, day: int = 1, hour: int = 0) -> datetime:
    return datetime(2024, month, day, hour)


def fingerprint(image_id, digest=0, full=0, crop=None, created=None, width=100, height=100, size=1000):
    name = digest if digest is None or isinstance(digest, str) else hex_digest(digest)
    return (image_id, name, full, full if crop is None else crop, width, height, size, created or at(1))


def fingerprints(spark, rows):
    return spark.createDataFrame(rows, schemas.FINGERPRINT)


def members(spark, rows):
    return spark.createDataFrame(rows, schemas.GROUP_MEMBER)


def groups(spark, rows):
    return spark.createDataFrame([(g, t, 0, c) for g, t, c in rows], schemas.DUP_GROUP)


def events(spark, rows):
    return spark.createDataFrame(rows, schemas.HOOK_EVENT)


def images(spark, rows):
    """rows: (id, dict of fields)."""
    names = ["title", "details", "rating100", "visual_files", "studio", "tags", "performers", "galleries"]
    return spark.createDataFrame([(i, *(f.get(n) for n in names)) for i, f in rows], schemas.IMAGE)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in (columns or df.columns)) for r in df.collect()), key=repr)


def crowded(df):
    """The same rows with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    for name in ("digest", "hash", "rep", "v", "x", "y", "key", "state", "period", "root", "hub", "n", "r", "at", "center", "words", "lines", "tokens", "share", "rate", "listed", "class_id"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit("clash"))
    return df

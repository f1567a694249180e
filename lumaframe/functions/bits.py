"""Bits of 64-bit hashes, file digests and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RASTER_COLUMNS, RASTER_ROWS = 9, 8


def hamming(a: Column, b: Column) -> Column:
    """Number of differing bits of two BIGINT hashes."""
    return F.bit_count(a.bitwiseXOR(b))


def least_distance(full_a: Column, crop_a: Column, full_b: Column, crop_b: Column) -> Column:
    """The least of the four distances of two pairs of hashes; unknown hashes are left out."""
    return F.least(hamming(full_a, full_b), hamming(crop_a, crop_b), hamming(full_a, crop_b), hamming(crop_a, full_b))


def unsigned_text(h: Column) -> Column:
    """The hash as the unsigned number it stands for, as text."""
    wide = h.cast("decimal(20,0)")
    return F.when(h < 0, wide + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(wide).cast("string")


def difference_hash(px: Column) -> Column:
    """Difference hash of a raster of 9 columns and 8 rows of bytes: bit row*8+col is set where the left pixel is brighter.

    Null for a null raster or one of fewer than 72 bytes; further bytes are ignored.
    """
    digits = F.hex(px)
    width = 2 * RASTER_COLUMNS
    rows = F.array(*(F.substring(digits, width * r + 1, width) for r in range(RASTER_ROWS)))

    def row_bits(row: Column) -> Column:
        left, right = (F.conv(F.substring(row, 1 + shift, 16), 16, -10).cast("bigint") for shift in (0, 2))
        bits = F.lit(0).cast("bigint")
        # the eight pairs of bytes in two sets of four 16-bit lanes: 256 + left - right - 1 keeps bit 8 where left > right
        for odd in (0, 1):
            lanes = [F.shiftrightunsigned(v, 8 * odd).bitwiseAND(F.lit(0x00FF00FF00FF00FF)) for v in (left, right)]
            greater = lanes[0] + F.lit(0x0100010001000100 - 0x0001000100010001) - lanes[1]
            for lane in range(4):
                one = F.shiftrightunsigned(greater, 16 * lane + 8).bitwiseAND(F.lit(1).cast("bigint"))
                bits = bits.bitwiseOR(F.shiftleft(one, 7 - (2 * lane + odd)))
        return bits

    whole = F.aggregate(F.reverse(F.transform(rows, row_bits)), F.lit(0).cast("bigint"), lambda acc, r: F.shiftleft(acc, 8).bitwiseOR(r))
    return F.when(F.octet_length(px) >= RASTER_COLUMNS * RASTER_ROWS, whole)


def difference_hash_of(values: Column) -> Column:
    """As difference_hash, for an array of at least 72 comparable numbers."""

    def step(acc: Column, k: Column) -> Column:
        at = (F.floor(k / 8) * RASTER_COLUMNS + k % 8).cast("int")
        return acc.bitwiseOR(F.when(F.get(values, at) > F.get(values, at + 1), F.call_function("shiftleft", F.lit(1).cast("bigint"), k)).otherwise(F.lit(0).cast("bigint")))

    bits = F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), step)
    return F.when(F.size(values) >= RASTER_COLUMNS * RASTER_ROWS, bits)


def digest(file_hash: Column) -> Column:
    """The file digest behind its spelling, as bytes: case, blanks, separators and a leading name of the method don't count.

    What isn't 64 hex digits stays as its trimmed lower-case text, so that it equals only itself. Null and blank give null.
    """
    text = F.lower(F.trim(file_hash))
    bare = F.regexp_replace(F.regexp_replace(text, r"^\s*(?:sha-?_?256\s*[:=/-]*|0x)\s*", ""), r"[\s:_-]+", "")
    plain = text.rlike("^[0-9a-f]{64}$")
    return (
        F.when(plain, F.unhex(text))
        .when(bare.rlike("^[0-9a-f]{64}$"), F.unhex(bare))
        .when(text != "", F.encode(text, "UTF-8"))
    )


def id_number(spelled: Column) -> Column:
    """The number that an id spells: blanks and leading zeros don't count. Null for what is no whole number."""
    return F.regexp_extract(spelled, r"^\s*([+-]?\d+)\s*$", 1).try_cast("bigint")


def month(ts: Column) -> Column:
    """yyyy-MM."""
    return F.date_format(ts, "yyyy-MM")

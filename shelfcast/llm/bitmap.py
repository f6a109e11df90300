"""Bitmaps of hashed keys: they sift rows before a shuffle, and are small enough to broadcast whatever the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap, as a power of two. It is a table of at most 2 ** (BITS - 6) rows of two longs: some 8 MB.
BITS = 24


def _segment(key: Column) -> Column:
    return F.shiftrightunsigned(key, 64 - (BITS - 6))


def _bit(key: Column) -> Column:
    return key.bitwiseAND(F.lit(63)).cast("int")


def marks(keys: DataFrame, name: str) -> DataFrame:
    """(segment, bits) of the 64-bit hashes in column ``name``."""
    one = F.lit(1).cast("bigint")
    return keys.groupBy(_segment(F.col(name)).alias("segment")).agg(F.bit_or(F.call_function("shiftleft", one, _bit(F.col(name)))).alias("bits"))


def maybe(df: DataFrame, name: str, bitmap: DataFrame) -> DataFrame:
    """Rows of ``df`` whose hash in ``name`` may be among the marked ones: no marked row is lost, few others stay.

    Once the marked keys far outnumber the bits, nothing is sifted out; the exact join that follows is right either way.
    """
    key = F.col(name)
    held = df.join(F.broadcast(bitmap), _segment(key) == bitmap["segment"])
    return held.where(F.call_function("shiftright", F.col("bits"), _bit(key)).bitwiseAND(F.lit(1)) == 1).select(*df.columns)

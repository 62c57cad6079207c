"""Bloom filters from DataFrame functions: positions as Spark bitmaps, broadcast within a size bound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import pin
from .common import whole_rows

_PAGE = 32768  # bits in one of Spark's bitmaps
#: The largest filter, in bits for each of its two halves: bounds the broadcast at 2 x 32 MB.
MOST_BITS = 1 << 28


def _positions(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(half)), F.lit(bits)) for half in (0, 1)]


def filter_bits(rows: int, most: int = MOST_BITS) -> int:
    """Eight positions for each row, as a power of two; at least 2 ** 16, at most ``most``."""
    return min(most, max(1 << 16, 1 << (8 * max(rows, 1) - 1).bit_length()))


def bloom_pages(keys: DataFrame, column: str, bits: int, least: int = 1) -> DataFrame:
    """Bitmaps (half, page, bitmap) of the positions that ``least`` rows or more hit; pinned, at most ``2 * bits / 8`` bytes.

    Rows that share a key, be they a third of the table, are counted before the shuffle.
    """
    hits = keys.select(F.explode(F.array(*[F.struct(F.lit(i).alias("half"), p.alias("at"))
                                           for i, p in enumerate(_positions(F.col(column), bits))])).alias("p"))
    often = hits.groupBy("p.half", "p.at").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return pin(often.groupBy("half", F.floor(F.col("at") / _PAGE).alias("page")).agg(
        F.bitmap_construct_agg(F.pmod("at", F.lit(_PAGE))).alias("bitmap")))


def mark(rows: DataFrame, column: str, pages: DataFrame, bits: int, flag: str) -> DataFrame:
    """Add ``flag``: true where both positions of ``column`` are set. The bitmaps are broadcast (bounded by ``bits``)."""
    for half, at in enumerate(_positions(F.col(column), bits)):
        name = f"__half{half}"
        own = pages.filter(F.col("half") == half).select(F.col("page").alias("__page"), F.col("bitmap").alias(name))
        rows = rows.withColumn("__at", at).withColumn("__page", F.floor(F.col("__at") / _PAGE))
        rows = rows.join(F.broadcast(own), "__page", "left")
        byte = F.conv(F.hex(F.substring(F.col(name), (F.pmod("__at", F.lit(_PAGE)) / 8).cast("int") + 1, F.lit(1))), 16, 10)
        bit = F.getbit(byte.cast("long"), F.pmod("__at", F.lit(8)).cast("int"))
        rows = rows.withColumn(name, F.coalesce(bit == 1, F.lit(False))).drop("__page", "__at")
    return rows.withColumn(flag, F.col("__half0") & F.col("__half1")).drop("__half0", "__half1")


def without(df: DataFrame, id_col: str, ids: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows of ``df`` whose id is not in ``ids`` (one pinned column); null ids stay.

    Rows that miss the filter pass straight through; only the others are shuffled for the exact anti join.
    """
    name = ids.columns[0]
    bits = filter_bits(ids.count(), most_bits)
    rows = df.select(whole_rows(df).alias("row"), F.col(f"`{id_col}`").cast("long").alias("__id"))
    rows = mark(rows, "__id", bloom_pages(ids, name, bits), bits, "__maybe")
    found = rows.filter("__maybe").join(ids.select(F.col(name).alias("__id")), "__id", "left_anti")
    return rows.filter("not __maybe").select("row.*").unionByName(found.select("row.*"))


def within(df: DataFrame, id_col: str, ids: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows of ``df`` whose id is in ``ids`` (one pinned column); only rows that hit the filter are shuffled."""
    name = ids.columns[0]
    bits = filter_bits(ids.count(), most_bits)
    rows = df.select(whole_rows(df).alias("row"), F.col(f"`{id_col}`").cast("long").alias("__id"))
    rows = mark(rows, "__id", bloom_pages(ids, name, bits), bits, "__maybe").filter("__maybe")
    return rows.join(ids.select(F.col(name).alias("__id")), "__id", "left_semi").select("row.*")

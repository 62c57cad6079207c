"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only.

Pass one hits two positions of a Bloom filter per text digest and keeps, as bitmaps, the positions that were hit at least
twice. Pass two marks the rows whose two positions were both hit twice: only these may have a copy. They alone are shuffled
and grouped by digest; all other rows pass straight through. A false positive costs its row a shuffle and nothing else, so
the result is exact whatever the size of the filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import pin
from .bloom import MOST_BITS, bloom_pages, filter_bits, mark
from .common import SPACES, text_of, whole_rows


def normalised(text: Column) -> Column:
    return F.translate(text_of(text), SPACES, "")


def digest(text: Column) -> Column:
    """SHA-256 of the text without white space, lower-case hex."""
    return F.sha2(F.encode(normalised(text), "UTF-8"), 256)


def _groups(maybe: DataFrame) -> DataFrame:
    """(digest, size, keep) of the digests that really repeat. ``~id`` puts the smallest id first without overflow."""
    best = F.max(F.struct("n_chars", F.bitwise_not("doc_id").alias("turned"))).alias("best")
    groups = maybe.groupBy("digest").agg(F.count("*").alias("size"), best).filter("size > 1")
    return groups.select("digest", "size", F.bitwise_not("best.turned").alias("keep"))


def _keys(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`")
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), digest(text).alias("digest"),
                     F.length(text_of(text)).cast("long").alias("n_chars"))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space; null counts as empty, and all empty texts are one group. The row
    with the most code points in the original text stays, then the smallest doc_id; a null id comes after all others. Rows
    that share an id and a text are one document and share its verdict. An empty table gives no rows; further columns of
    the input are not read.
    """
    keys = pin(_keys(df, id_col, text_col))
    bits = filter_bits(keys.count(), most_bits)
    marked = mark(keys, "digest", bloom_pages(keys, "digest", bits, 2), bits, "maybe")
    groups = pin(_groups(marked.filter("maybe")))
    out = [F.col("doc_id"), F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"),
           F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
           (F.col("size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep"))).alias("kept"), F.col("digest").alias("text_sha256")]
    alone = marked.filter("not maybe").withColumns({"size": F.lit(None).cast("long"), "keep": F.lit(None).cast("long")})
    found = marked.filter("maybe").join(groups, "digest", "left")
    return alone.select(*out).unionByName(found.select(*out))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """The input rows without exact copies, all columns kept; of rows that repeat an id and a text one stays.

    Texts are read once for the digests and once for the output; only possibly repeated rows are shuffled with their text.
    """
    keys = pin(_keys(df, id_col, text_col))
    bits = filter_bits(keys.count(), most_bits)
    pages = bloom_pages(keys, "digest", bits, 2)
    groups = pin(_groups(mark(keys, "digest", pages, bits, "maybe").filter("maybe")))
    text = F.col(f"`{text_col}`")
    rows = df.select(whole_rows(df).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), digest(text).alias("digest"))
    rows = mark(rows, "digest", pages, bits, "maybe")
    found = rows.filter("maybe").join(groups, "digest", "left")
    single = found.filter(F.col("size").isNull())
    best = found.filter(F.col("size").isNotNull() & F.col("doc_id").eqNullSafe(F.col("keep"))).dropDuplicates(["digest"])
    return rows.filter("not maybe").select("row.*").unionByName(single.select("row.*")).unionByName(best.select("row.*"))

"""Near duplicates by SimHash, with candidates from pigeonring chains.

``simhash_groups`` links 64-bit fingerprints of whole texts that differ in two bits at most. A fingerprint is a ring of
three segments. If two fingerprints differ in d0 + d1 + d2 <= 2 bits, there is a segment from which every chain of l
segments along the ring differs in at most l * 2 / 3 bits: none in the first, one in the first two, two in all. The chain
of two is looked up by equality: a fingerprint stands in the table under its first two segments, and also under those with
one set bit of the second cleared. Only fingerprints that meet another one under such a key go on. Under a key the third
segments decide; each stands for itself and its one-bit neighbours, so whoever meets under (key, third segment) differs in
two bits at most, and at most 44 can meet. No pair is missed and no pairs of a group are listed.

``drop_near_copies`` keeps one document of each group that these links connect.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..core import pin
from .bloom import bloom_pages, filter_bits, mark
from .common import text_of, two_columns, whole_rows
from .components import connected

SEED = 42
_WIDTHS = (21, 21, 22)  # the segments of a 64-bit fingerprint
_STARTS = (0, 21, 42)
#: Distinct fingerprints that one task expands into keys.
CLASSES_IN_A_PART = 100_000
_SLICE = 1 << 15  # shingles whose bits are counted at a time


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, highest bit first."""
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _SLICE):
        raw = hashes[i:i + _SLICE].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    return counts


def fingerprint(text: str, words: int = 3) -> int:
    """The SimHash of a text's word shingles, as an unsigned number; 0 for a text without words."""
    found = text.encode().lower().split()
    if not found:
        return 0
    if len(found) < words:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(words))))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype=np.uint64)
    return int.from_bytes(np.packbits(_bit_counts(hashes) * 2 > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, hash, fp): the fingerprint as a signed 64-bit number, and a hash of the whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), pa.array(fps.view(np.int64))], ["doc_id", "hash", "fp"])

    docs = two_columns(df, id_col, text_col).withColumn("hash", F.xxhash64("text"))
    return docs.mapInArrow(run, "doc_id long, hash long, fp long")


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, _STARTS[i]).bitwiseAND(F.lit((1 << _WIDTHS[i]) - 1))


def _chain_keys(classes: DataFrame) -> DataFrame:
    """(key, exact, fp): each fingerprint under its chains of two segments, also with one set bit of the second cleared."""
    fp, keys = F.col("fp"), []
    for i in range(3):
        j = (i + 1) % 3
        second = _segment(fp, j)
        base = F.lit(i << 44).bitwiseOR(F.shiftleft(_segment(fp, i), 22)).bitwiseOR(second)
        keys.append(F.struct(base.alias("key"), F.lit(True).alias("exact")))
        for b in range(_WIDTHS[j]):
            cleared = F.struct(base.bitwiseXOR(F.lit(1 << b)).alias("key"), F.lit(False).alias("exact"))
            keys.append(F.when(F.getbit(second, F.lit(b)) == 1, cleared))
    return classes.select(F.explode(F.array_compact(F.array(*keys))).alias("k"), "fp").select("k.key", "k.exact", "fp")


def _close_links(classes: DataFrame) -> DataFrame:
    """(fp, other) links of distinct fingerprints within two bits: enough to connect all that are."""
    keys = _chain_keys(classes)
    shared = pin(keys.groupBy("key").agg(F.count("*").alias("n"), F.max("exact").alias("any_exact"))
                 .filter("n > 1 and any_exact").select("key"))
    members = keys.join(shared, "key")
    start = F.shiftright("key", 44)
    third = F.when(start == 0, _segment(F.col("fp"), 2)).when(start == 1, _segment(F.col("fp"), 0)).otherwise(_segment(F.col("fp"), 1))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b).cast("long") for b in range(22)])
    points = members.withColumn("third", third).select(
        "key", "fp", F.explode(F.when(F.col("exact"), flips).otherwise(F.array(F.lit(0).cast("long")))).alias("flip"), "third")
    points = points.select("key", F.col("third").bitwiseXOR(F.col("flip")).alias("point"), "fp")
    least = F.min("fp").over(Window.partitionBy("key", "point"))  # at most 44 fingerprints
    links = points.select("fp", least.alias("other")).filter("fp <> other")
    return links.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= 2).distinct()


def _grouped(df: DataFrame, words: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Pinned: (doc_id, hash of the text, fp) of all rows, and (fp, root) of all fingerprints, root being one of the group's."""
    docs = pin(fingerprints(df, words, id_col, text_col))
    classes = pin(docs.select("fp").distinct())
    roots = connected(_close_links(_dealt(classes))).select(F.col("node").alias("fp"), "root")
    return docs, pin(classes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")))


def _dealt(classes: DataFrame) -> DataFrame:
    """Pinned rows in even parts: each becomes some thirty keys, and few small parts would make few long tasks."""
    parts = max(classes.sparkSession.sparkContext.defaultParallelism, -(-classes.count() // CLASSES_IN_A_PART))
    return classes.repartition(parts)


def simhash_groups(df: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that links reach).

    Null and empty texts, and texts of white space alone, have fingerprint zero and link like any other. Copies share a
    fingerprint and are one node. A component whose ids are all null has a null component_id. An empty table gives no rows;
    further columns are not read.
    """
    docs, roots = _grouped(df, words, id_col, text_col)
    least = docs.join(roots, "fp").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = pin(roots.join(least, "root").select("fp", "component_id"))
    return docs.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(df: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows, all columns kept, of which one document of each group of linked fingerprints stays.

    That is the one of the smallest doc_id (a null id comes after all others), then of the smallest fingerprint. Rows that share
    an id and a fingerprint are one document and stay or go together. Texts are read once for the fingerprints and once for the
    output; only rows whose id may be among those that go are shuffled with their text. An empty table gives no rows.
    """
    docs, roots = _grouped(df, words, id_col, text_col)
    member = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp")
    stays = pin(docs.join(roots, "fp").groupBy("root").agg(F.min(member).alias("stays")))
    gone = docs.join(roots, "fp").join(stays, "root").filter(
        ~(F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("fp") == F.col("stays.fp"))))
    gone = pin(gone.select(F.col("doc_id").alias("gone_id"), F.col("hash").alias("gone_hash")).distinct())
    bits = filter_bits(gone.count())
    rows = df.select(whole_rows(df).alias("row"), F.col(f"`{id_col}`").cast("long").alias("own_id"),
                     F.xxhash64(text_of(F.col(f"`{text_col}`"))).alias("own_hash"))
    rows = mark(rows, "own_id", bloom_pages(gone, "gone_id", bits), bits, "maybe")
    same = F.col("own_id").eqNullSafe(F.col("gone_id")) & (F.col("own_hash") == F.col("gone_hash"))
    found = rows.filter("maybe").join(gone, same, "left_anti")
    return rows.filter("not maybe").select("row.*").unionByName(found.select("row.*"))

"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Every document draws an exponential key, divided by its quality weight; within a source the order of these keys is a
weighted random order without replacement. A source first gives as many complete epochs as its target holds; the rest of
the target takes the first documents of the order, found by prefix sums: over ranges of keys first (``RANGES`` per doubling, per
source), then over the documents of the one range where the budget ends. What leaves this module for the documents is a
cut (key, id) per source, so a document decides on its own, without a shuffle of the texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import pin
from .common import SPACES, WORD, join_checked, text_of, whole_rows

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
#: Ranges of keys for each doubling of the key; keys of a source lie within some twenty doublings.
RANGES = 1 << 12
#: Characters that lower the quality weight of a document: ASCII punctuation and digits.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789"


def size_of(text: Column) -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def quality_weight(text: Column) -> Column:
    """Share of a text's visible characters that are neither punctuation nor digits, in (0, 1]."""
    seen = F.translate(text_of(text), SPACES, "")
    return (F.length(F.translate(seen, _MARKS, "")) + 1).cast("double") / (F.length(seen) + 1).cast("double")


def exponential_key(doc_id: Column, weight: Column, seed: int) -> Column:
    """``-ln(u) / weight`` with u in (0, 1) from the id's MD5: reruns and retried tasks agree."""
    hexed = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13)
    u = (F.conv(hexed, 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): weights repeat along the sources in code point order, null last.

    The budget fills like water: a source that reaches ``most`` times its size stops there, and what it leaves is shared
    again by weight. Sorted by the level at which it stops, the sources that are full are a prefix of the list. The windows
    here run over the list of sources, which has one short row for each of them.
    """
    listed = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(listed) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    t = t.withColumn("level", (F.sum("source_size").over(whole) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                     / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    t = t.withColumn("nth", F.row_number().over(by_level))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("nth", "level"))
    t = t.withColumn("water", F.min(fits).over(whole)["level"])
    return t.select("source", "source_size", F.least(F.col("cap"), F.col("water") * F.col("weight")).cast("double").alias("target"))


def _keyed(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, row: bool = False) -> DataFrame:
    text, doc_id = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    out = df.select(*([whole_rows(df).alias("row")] if row else []), doc_id.cast("long").alias("doc_id"),
                    F.col(f"`{source_col}`").cast("string").alias("source"), size_of(text).alias("size"),
                    exponential_key(doc_id, quality_weight(text), seed).alias("key"))
    return out.withColumns({"no_source": F.col("source").isNull(), "named": F.coalesce("source", F.lit(""))})


def _spot(key: Column) -> Column:
    """The range of a key: of one width in its logarithm. Keys of any weight have the same spread there, so no range of a source holds
    more than about 0.4 ln 2 / ``RANGES`` of its rows, whatever their weights."""
    return F.floor(F.log2(key) * RANGES)


def _cuts(keys: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source: its target, complete epochs, and the (key, id) of the last document of the fractional epoch."""
    spot = _spot(F.col("key"))
    ranges = keys.groupBy("no_source", "named", spot.alias("spot")).agg(F.sum("size").alias("words"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.select(F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("named"),
                       "source_size", "target", epochs.alias("epochs"))
    plan = pin(plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    names = ["no_source", "named"]
    upto = Window.partitionBy(*names).orderBy("spot")
    sums = ranges.withColumn("upto", F.sum("words").over(upto)).join(plan.select(*names, "rest"), names)
    crossing = sums.filter("rest > 0 and upto >= rest and upto - words < rest").select(
        *names, "spot", "rest", (F.col("upto") - F.col("words")).alias("base"))
    inside = join_checked(keys.withColumn("spot", spot), crossing, [*names, "spot"], "inner")
    # rows with the same id tie; they are taken or left together
    inside = inside.groupBy(*names, "rest", "base", "key", "doc_id").agg(F.sum("size").alias("words"))
    order = Window.partitionBy(*names).orderBy("key", F.col("doc_id").asc_nulls_first())
    middle = F.col("base") + F.sum("words").over(order) - F.col("words") / 2
    taken = inside.withColumn("middle", middle).filter("middle <= rest")
    last = taken.groupBy(*names).agg(F.max(F.struct("key", "doc_id")).alias("last"))
    spots = crossing.select(*names, F.col("spot").alias("cut_spot"))
    return plan.drop("rest").join(spots, names, "left").join(last, names, "left").withColumns({
        "cut_key": F.col("last.key"), "cut_id": F.col("last.doc_id")}).drop("last")


def _times(spot: Column) -> Column:
    """How often a document is taken: the complete epochs, and once more before the source's cut."""
    at_cut = (F.col("key") < F.col("cut_key")) | ((F.col("key") == F.col("cut_key"))
                                                & (F.col("doc_id").isNull() | (F.col("doc_id") <= F.col("cut_id"))))
    more = (spot < F.col("cut_spot")) | ((spot == F.col("cut_spot")) & F.coalesce(at_cut, F.lit(False)))
    return F.col("epochs") + F.coalesce(more, F.lit(False)).cast("long")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS, seed: int = 9) -> DataFrame:
    """One row per input row: doc_id, size (words), source_size, target (of its source), taken (words, repeats counted).

    Documents are taken whole; the one at the end of a budget is taken if that ends nearer to it. Null text has size 0, a
    null source is a source of its own, rows with the same id share a draw and are taken or left together. A source without
    words has target 0. An empty table gives no rows; further columns are not read.
    """
    keys = pin(_keyed(df, id_col, text_col, source_col, seed))
    plan = targets(keys.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    rows = join_checked(keys, _cuts(keys, plan), ["no_source", "named"])
    spot = _spot(F.col("key"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * _times(spot)).alias("taken"),
                       "source", "key")


def mixed_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS, seed: int = 9) -> DataFrame:
    """The input rows, all columns kept, each as often as the mix takes it. The texts are not shuffled."""
    keys = pin(_keyed(df, id_col, text_col, source_col, seed))
    plan = targets(keys.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    rows = join_checked(_keyed(df, id_col, text_col, source_col, seed, row=True), _cuts(keys, plan), ["no_source", "named"])
    spot = _spot(F.col("key"))
    copies = F.array_repeat(F.lit(0), _times(spot).cast("int"))
    return rows.select("row", F.explode(copies)).select("row.*")

"""Best-fit packing with certified bin counts.

Documents are cut into pieces of at most one sequence. Whole sequences need no packing. The other pieces are dealt into
groups of bounded size; each group is packed best-fit decreasing, and a lower bound from dual feasible functions says how
many sequences it needs at least. A group that reaches its bound is certified. The others put their pieces together, are
dealt anew and packed again, for as long as that saves sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import pin
from .common import two_columns
from .tokens import encoder

CAPACITY = 2048
END_ID = 0
#: Pieces in a group, on average: bounds a packing task to a few MB.
GROUP_PIECES = 40_000
ROUNDS = 3


def pieces(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): ids with the end id, cut where a document exceeds ``capacity``."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer_path).encode
        for batch in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = ids_of(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    doc.append(doc_id), piece.append(k), start.append(at // 4), length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                                              pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                                             ["doc_id", "piece", "start", "length", "ids_crc32"])

    return two_columns(df, id_col, text_col).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that pieces need at least; ``counts[n]`` pieces have length n.

    The largest sum over three families of dual feasible functions: lengths as they are; for each threshold t, lengths
    above capacity - t count as whole and those below t as nothing; and lengths rounded to k-ths of the capacity.
    """
    n = np.arange(len(counts))
    bounds = [-(-int((n * counts).sum()) // capacity)]
    items = np.concatenate([[0], np.cumsum(counts)])
    words = np.concatenate([[0], np.cumsum(n * counts)])
    t = np.arange(1, capacity // 2 + 1)
    whole = items[-1] - items[capacity - t + 1]
    middle = words[capacity - t + 1] - words[t]
    bounds.append(int((whole + -(-middle // capacity)).max()))
    for k in range(2, 33):
        step = (k + 1) * n
        value = np.where(step % capacity == 0, n * k, (step // capacity) * capacity)  # in units of capacity * k
        bounds.append(-(-int((value * counts).sum()) // (capacity * k)))
    return max(bounds)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best-fit decreasing: (bin, offset) for each length, and the number of bins.

    Open bins lie in stacks by the room that they have left; the set bits of one integer name the stacks that aren't empty,
    so the tightest fit is a shift and a lowest bit.
    """
    where, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled, bins = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = filled >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = stacks[room].pop()
            if not stacks[room]:
                filled ^= 1 << room
        else:
            room, at, bins = capacity, bins, bins + 1
        where[i], offset[i] = at, capacity - room
        left = room - size
        if left:
            stacks[left].append(at)
            filled |= 1 << left
    return where, offset, bins


def _pack_groups(items: DataFrame, capacity: int, wave: int) -> DataFrame:
    """Pack each group of (group, ...) best-fit decreasing; ``gap`` is how far the group is from its lower bound."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        group = key[0].as_py()
        table = table.sort_by([(c, "ascending") for c in ("length", "doc_id", "piece", "start", "ids_crc32")])
        lengths = table.column("length").to_numpy()
        where, offset, bins = best_fit(lengths, capacity)
        gap = bins - lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        rows = table.num_rows
        return pa.table({**{c: table.column(c) for c in names}, "wave": pa.array(np.full(rows, wave, dtype=np.int32)),
                         "group": pa.array(np.full(rows, group)), "bin": pa.array(where), "offset": pa.array(offset),
                         "bins": pa.array(np.full(rows, bins)), "gap": pa.array(np.full(rows, gap))})

    return items.groupBy("group").applyInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, wave int, group long, bin long, offset long, bins long, gap long")


def _deal(items: DataFrame, groups: int, wave: int) -> DataFrame:
    """A group for each piece. Pieces of rows that repeat are told apart by their task, or one group would get them all."""
    hashed = F.xxhash64("doc_id", "piece", "length", "ids_crc32", F.monotonically_increasing_id(), F.lit(wave))
    return items.withColumn("group", F.pmod(hashed, F.lit(groups)))


def _totals(packed: DataFrame) -> tuple[int, int, int]:
    by_group = packed.groupBy("group").agg(F.max("bins").alias("bins"), F.max("gap").alias("gap"), F.count("*").alias("n"))
    row = by_group.agg(F.sum("n").alias("n"), F.sum("bins").alias("b"), F.sum("gap").alias("g")).first()
    return row["n"] or 0, row["b"] or 0, row["g"] or 0


def pack_pieces(items: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """``items`` with sequence_id and offset. ``items`` must be pinned; each round's packing is pinned as well."""
    whole = items.filter(F.col("length") == capacity).withColumns({
        "wave": F.lit(-1), "group": F.lit(0).cast("long"), "bin": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    names = [*items.columns, "wave", "group", "bin", "offset"]
    done = [pin(whole.select(*names))]
    rest, count = items.filter(F.col("length") < capacity), items.filter(F.col("length") < capacity).count()
    packed = pin(_pack_groups(_deal(rest, max(1, round(count / group_pieces)), 0), capacity, 0)) if count else None
    for wave in range(1, rounds + 1):
        if packed is None:
            break
        done.append(packed.filter("gap = 0").select(*names))
        open_ = packed.filter("gap > 0")
        n, bins, gap = _totals(open_)
        if not gap:
            packed = None
            break
        again = pin(_pack_groups(_deal(open_.select(*items.columns), max(1, round(n / group_pieces)), wave), capacity, wave))
        _, bins_again, _ = _totals(again)
        if bins_again >= bins:
            done.append(open_.select(*names))
            packed = None
            break
        packed = again
    if packed is not None:
        done.append(packed.select(*names))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    # wave, group and bin name a sequence; as one number: 4 bits, 28 bits and 31 bits; whole pieces count from the top
    number = F.when(F.col("wave") < 0, -1 - F.col("bin")).otherwise(
        F.shiftleft(F.col("wave").cast("long"), 59).bitwiseOR(F.shiftleft("group", 31)).bitwiseOR(F.col("bin")))
    return out.select(*items.columns, number.alias("sequence_id"), "offset")


def pack(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id",
         text_col: str = "text", group_pieces: int = GROUP_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text counts as empty and gives one piece, the end id alone. Rows that repeat an id are packed each for itself. An
    empty table gives no rows; further columns are not read. Texts are read once; only numbers are shuffled.
    """
    return pack_pieces(pin(pieces(df, tokenizer_path, capacity, end_id, id_col, text_col)), capacity, group_pieces, rounds)


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences used, and the lower bound for all pieces together (from at most ``capacity`` counts)."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in packed.groupBy("length").count().collect():  # one row per length, at most ``capacity``
        counts[row["length"]] = row["count"]
    bound = lower_bound(counts, capacity)
    return packed.agg(F.countDistinct("sequence_id").alias("sequences")).withColumn("lower_bound", F.lit(bound))

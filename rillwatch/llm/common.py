"""What the training-data operators share: words, white space, checked broadcasts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import pin

#: The white space of every contract here: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_BYTES = 32 << 20
#: Text that a task takes apart at a time, in bytes.
TEXT_AT_A_TIME = 4 << 20


def text_of(column: Column) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(column.cast("string"), F.lit(""))


def two_columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) under fixed names: whatever else the table has cannot clash with an operator's own columns."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(F.col(f"`{text_col}`")).alias("text"))


# Bytes of UTF-8 that belong to a word of letters and digits stay, A-Z in lower case; any other ASCII character is a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def folded_words(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and all characters beyond ASCII, with A-Z alone in lower case."""
    return text.translate(_FOLD).split()


def whole_rows(df: DataFrame) -> Column:
    """All columns of a row as one struct, so that helper columns beside it cannot clash."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows with about ``TEXT_AT_A_TIME`` bytes of text."""
    upto = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        done = upto[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, done + TEXT_AT_A_TIME, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def join_checked(df: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left",
                 limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join a table that is expected to be small.

    It is computed once and pinned; rows and widths are summed. Up to ``limit`` bytes it is broadcast. Beyond that both
    sides are shuffled directly, so that adaptive execution can split a hot key.
    """
    held = pin(table)
    width = sum((F.coalesce(F.length(F.col(c).cast("binary")), F.lit(0)) if t in ("string", "binary") else F.lit(16)
                 for c, t in held.dtypes), F.lit(48))
    size = held.agg(F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()["b"]
    return df.join(F.broadcast(held) if size <= limit else held, list(keys), how)

"""Token counts by byte-pair merging with a heap and a linked list; no ids are made.

The vocabulary cuts a text into parts before it merges. A part starts as one symbol per byte; the adjacent pair of lowest
rank is popped from a heap and merged in a linked list, until no pair has a rank. The count is symbols minus merges. Parts
repeat, so each worker keeps the counts of short ones (``MOST_PARTS`` at most, then it starts anew).
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import two_columns
from .tokens import byte_letters

MOST_PARTS = 200_000
LIMIT = 512
#: How byte-level vocabularies cut a text (a fixed value of the vocabulary).
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class MergeCounts(dict):
    """Part to its number of tokens."""

    def __init__(self, path: str):
        super().__init__()
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.letter = byte_letters()
        self.parts = regex.compile(PARTS)
        special = [regex.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(special)) if special else None

    def merges(self, part: str) -> int:
        """Merges that byte-pair encoding makes in one part."""
        symbols: list[str | None] = [self.letter[b] for b in part.encode()]
        n, rank = len(symbols), self.rank
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(rank[p], i) for i in range(n - 1) if (p := (symbols[i], symbols[i + 1])) in rank]
        heapq.heapify(heap)
        merged = 0
        while heap:
            order, i = heapq.heappop(heap)
            left = symbols[i]
            j = after[i]
            if left is None or j >= n or rank.get((left, symbols[j])) != order:
                continue  # one of its two symbols has been merged since
            symbols[i], symbols[j] = left + symbols[j], None
            merged += 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return merged

    def __missing__(self, part: str) -> int:
        count = len(part.encode()) - self.merges(part)
        if len(part) <= 64:
            self[part] = count
        return count

    def count(self, text: str) -> int:
        """Tokens of a whole text; a special token's string inside it counts as one, as in the library."""
        if len(self) > MOST_PARTS:
            self.clear()
        if self.special is None or not self.special.search(text):
            return sum(map(self.__getitem__, self.parts.findall(text)))
        between = self.special.split(text)
        return len(between) - 1 + sum(sum(map(self.__getitem__, self.parts.findall(t))) for t in between)


_OPEN: dict[str, MergeCounts] = {}


def counter(path: str) -> MergeCounts:
    """One counter per worker and vocabulary file."""
    if path not in _OPEN:
        _OPEN[path] = MergeCounts(path)
    return _OPEN[path]


def count_tokens(df: DataFrame, tokenizer_path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    Null text counts as empty, which has 0 bytes and 0 tokens. Each row is counted on its own, so repeated rows and ids give
    repeated results; an empty table gives no rows; further columns are not read. No shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path).count
        for batch in batches:
            texts = batch.column("text").to_pylist()
            tokens = np.fromiter(map(count, texts), dtype=np.int64, count=len(texts))
            size = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(tokens), pa.array(tokens > limit)],
                                             ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return two_columns(df, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

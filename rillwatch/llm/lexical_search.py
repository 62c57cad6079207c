"""Ranked lexical search, one part of the documents at a time: short lists term by term, long lists document by document.

One pass over the texts counts, for all terms of the items, the documents that hold them. The next takes the documents in
blocks; a block's postings of the items' terms are sorted into lists, each entry with its final share of a score. For an item,
the short lists are summed term at a time into accumulators. These are one list in document order with the largest sum as
bound, like each long list with its own. Document at a time, in windows of documents: the lists whose bounds together stay
below the item's lowest good score can't bring in a document alone, so only the others are walked, from window to window of
documents that they hold; the rest is looked up, largest bound first, for documents that may still reach that score. A task
carries its best documents, and so the lowest good score, from block to block; at the end the best of all tasks are ranked.
Bounds are exact integers and documents are left out only below the lowest good score, so the ranking is that of full sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..core import pin
from .common import folded_words, slices, text_of, two_columns

TOP = 50
#: Bytes of items that are searched for in one pass; more items make more passes.
ITEM_BYTES = 8 << 20
#: Postings of a block: bounds a task's arrays, at some 60 bytes each.
BLOCK_POSTINGS = 500_000
#: Documents that are scored at a time.
WINDOW = 4096
#: A list is short if it holds at most one of so many documents of the block.
SHORT_SHARE = 32
#: Tasks whose best documents are ranked together before all are.
TASKS_AT_A_TIME = 64

def weight(documents: int, held: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * held + 1)))


def _found(part: pa.RecordBatch) -> list[list[bytes]]:
    return [folded_words(t) for t in part.column("text").cast(pa.binary()).to_pylist()]


def _postings(found: list[list[bytes]], number: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, document, how often) of the numbered terms, by term, then document."""
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    terms = np.fromiter((n for words in found for n in map(number.get, words, repeat(-1))), dtype=np.int64, count=int(sizes.sum()))
    held = terms >= 0
    keys, tf = np.unique(terms[held] * len(found) + np.repeat(np.arange(len(found)), sizes)[held], return_counts=True)
    return keys // max(len(found), 1), keys % max(len(found), 1), tf


class Best:
    """The best documents of an item so far; ``least`` is the lowest score that can still enter."""

    def __init__(self, top: int):
        self.top, self.least = top, 1
        self.scores, self.ids, self.null = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        scores, ids, null = (np.concatenate(p) for p in ((self.scores, scores), (self.ids, ids), (self.null, null)))
        order = np.lexsort((ids, null, -scores))[:self.top]
        self.scores, self.ids, self.null = scores[order], ids[order], null[order]
        if len(order) == self.top:
            self.least = int(self.scores[-1])


class Block:
    """The lists of a run of documents: those of term t lie at ``first[t]:first[t + 1]``, in document order."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, terms: np.ndarray, docs: np.ndarray, shares: np.ndarray, vocabulary: int):
        order = np.argsort(terms, kind="stable")
        self.ids, self.null = ids, null
        self.docs, self.shares = docs[order], shares[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=vocabulary))])

    def _lists(self, terms: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(bound, documents, shares) of an item's lists: the sums of the short ones as one list, and the long ones; by bound."""
        first, last = self.first[terms], self.first[terms + 1]
        short = (last - first) * SHORT_SHARE <= len(self.ids)
        lists = [(self.docs[a:b], self.shares[a:b]) for a, b in zip(first[~short].tolist(), last[~short].tolist())]
        parts = [np.arange(a, b) for a, b in zip(first[short].tolist(), last[short].tolist()) if b > a]
        if parts:
            at = np.concatenate(parts)
            at = at[np.argsort(self.docs[at], kind="stable")]
            docs, start = np.unique(self.docs[at], return_index=True)
            lists.append((docs, np.add.reduceat(self.shares[at], start)))
        return sorted(((int(shares.max()), docs, shares) for docs, shares in lists), key=lambda found: found[0])

    def search(self, terms: np.ndarray, best: Best) -> None:
        """Put the documents of this block that belong to an item's best there."""
        lists = self._lists(terms)
        bounds = np.cumsum([b for b, _, _ in lists])
        at = 0
        while lists:
            looked_up = int(np.searchsorted(bounds, best.least, side="left"))  # together below the lowest good score
            walked = [(np.searchsorted(docs, at), docs, shares) for _, docs, shares in lists[looked_up:]]
            starts = [int(docs[k]) for k, docs, _ in walked if k < len(docs)]
            if not starts:
                return
            at = min(starts)
            sums = np.zeros(WINDOW, dtype=np.int64)
            for k, docs, shares in walked:
                stop = np.searchsorted(docs, at + WINDOW)
                sums[docs[k:stop] - at] += shares[k:stop]
            found = np.flatnonzero(sums)
            scores = sums[found]
            found += at
            for k in range(looked_up - 1, -1, -1):
                may = scores + bounds[k] >= best.least
                found, scores = found[may], scores[may]
                if not len(found):
                    break
                _, docs, shares = lists[k]
                place = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
                scores += np.where(docs[place] == found, shares[place], 0)
            good = scores >= best.least
            if good.any():
                best.add(scores[good], self.ids[found[good]], self.null[found[good]])
            at += WINDOW


def _statistics(docs: DataFrame, number: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and for each numbered term the documents that hold it."""
    held = docs.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, documents, terms = held.value, 0, 0
        df = np.zeros(len(number), dtype=np.int64)
        for batch in batches:
            for part in slices(batch):
                found = _found(part)
                documents += sum(map(bool, found))
                terms += sum(map(len, found))
                df += np.bincount(_postings(found, number)[0], minlength=len(number))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([some, [-1, -2]])), pa.array(np.concatenate([df[some], [documents, terms]]))],
                                         ["term", "n"])

    counts = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # at most one row a term
    of = {r["term"]: r["n"] for r in counts}
    return of.get(-1, 0), of.get(-2, 0), np.array([of.get(k, 0) for k in range(len(number))], dtype=np.int64)


def _best_of_tasks(docs: DataFrame, items: list[tuple[int, bytes]], top: int, block_postings: int) -> DataFrame:
    """(item, task, doc_id, score): the best documents of each task, for each item."""
    found = [(row, set(folded_words(text))) for row, text in items]
    number = {t: k for k, t in enumerate(sorted(set().union(*(terms for _, terms in found))))}
    documents, all_terms, df = _statistics(docs, number)
    weights = np.array([weight(documents, int(n)) for n in df], dtype=np.int64)
    wanted = [(row, np.array(sorted(k for k in map(number.__getitem__, terms) if df[k] and weights[k]), dtype=np.int64)) for row, terms in found]
    held = docs.sparkSession.sparkContext.broadcast((number, weights, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, weights, wanted = held.value
        best = [Best(top) for _ in wanted]
        parts, size, postings = [], 0, 0

        def search() -> None:
            ids, null, terms, docs, shares = (np.concatenate(c) for c in zip(*parts))
            block = Block(ids, null, terms, docs, shares, len(number))
            for (_, terms), own in zip(wanted, best):
                block.search(terms[block.first[terms] < block.first[terms + 1]], own)

        for part in (p for batch in batches for p in slices(batch)):
            found = _found(part)
            terms, docs, tf = _postings(found, number)
            n = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            m = 50 + 50 * n * documents // max(all_terms, 1)
            shares = weights[terms] * (1_000_000_000 * tf // (1000 * tf + 20 * m[docs]))
            ids = part.column("doc_id")
            parts.append((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), terms, docs + size, shares))
            size, postings = size + len(found), postings + len(terms)
            if postings >= block_postings:
                search()
                parts, size, postings = [], 0, 0
        if parts:
            search()
        task = TaskContext.get().partitionId()
        for (row, _), own in zip(wanted, best):
            if len(own.ids):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own.ids), row)), pa.array(np.full(len(own.ids), task)), pa.array(own.ids, mask=own.null), pa.array(own.scores)],
                    ["item", "task", "doc_id", "score"])

    return docs.mapInArrow(run, "item long, task long, doc_id long, score long")


def _ranked(rows: DataFrame, keys: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search(df: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", item_bytes: int = ITEM_BYTES, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """For each row of ``items`` its ``top`` best documents: item_id, rank (int, from 1), doc_id, score (long, above 0).

    Equal scores are in the order of doc_id, null last. Null texts have no terms; an item without terms, or without a document
    that scores, has no rows. Rows that repeat an item_id are items of their own, ranked each for itself, and repeated documents
    are documents of their own. Empty tables give no rows; further columns are not read. The items, whatever their number, are
    searched for in passes of ``item_bytes``; documents are not shuffled, only each task's best.
    """
    docs = two_columns(df, id_col, text_col)
    asked = pin(items.select(F.col(f"`{item_col}`").alias("item_id"), text_of(F.col(f"`{item_text_col}`")).alias("text"))
                .withColumn("item", F.monotonically_increasing_id()))
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    passes = max(1, -(-size // item_bytes))
    found = None
    for k in range(passes):
        own = asked.filter(F.pmod(F.xxhash64("item"), F.lit(passes)) == k).select("item", "text").collect()  # about item_bytes
        best = _best_of_tasks(docs, [(r["item"], r["text"].encode()) for r in own], top, block_postings)
        found = best if found is None else found.unionAll(best)
    near = _ranked(found.withColumn("task", F.floor(F.col("task") / TASKS_AT_A_TIME)), ["item", "task"], top).drop("rank")
    ranked = _ranked(near, ["item"], top)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")

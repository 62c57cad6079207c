"""Random forest grown from histograms: bootstrap by key, class weights, least rows to split, out-of-bag votes.

Features become bins once (edges are quantiles of the training rows). How often a tree draws a row is Poisson(1), read off a
digest of the row's key, so any task can tell a tree's rows, and those it never saw, without asking another. A tree grows in
two ways. Nodes of more than ``local_rows`` drawn rows are split level by level: every task counts (tree, node, feature, bin,
class) of its rows, the counts are summed in a shuffle, and the best split of each node comes back. The rows of smaller nodes
go to one task each, which grows the rest below them. Counts are whole numbers and the features of a node are drawn by hash,
so the trees are the same whichever way a node was split and however the table is partitioned. Only rows of nodes that may still be split are
dealt. Rows of the same bins and class that a task meets together are held, dealt and walked as one, with their draws added up.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import BENIGN, CLASSIFIER_DEPTH, CLASSIFIER_LEAF, CLASSIFIER_SPLIT, CLASSIFIER_TREES, SEED
from ..core import col, pin, present, require
from ..errors import ModelError
from . import metrics
from .classify import class_weights
from .select import ranked

#: Drawn rows of a node that one task holds, each as many bytes as there are features.
LOCAL_ROWS = 1 << 20
#: Rows that a task looks through at a time for equal ones.
_ROWS_AT_A_TIME = 1 << 16
#: Bytes of learning rows that a task splits or deals at a time.
_BYTES_AT_A_TIME = 8 << 20
#: Values of a feature that a task tells apart, rows it gathers before it sorts them, and values it sends on.
_DIGEST = 1 << 15
_DIGESTED_ROWS = 1 << 17
_SENT = 10_000
#: Bins of a feature; a bin fits into a byte.
BINS = 32
#: Bytes of trees that are shipped to the tasks at a time; a larger forest scores in several passes.
MODEL_BYTES = 256 << 20
#: Cells of histograms that are weighed at a time.
_CELLS = 1 << 21
#: Cells of histograms that a task adds up in a pass; more of them take more passes, each for its own nodes.
_HELD_CELLS = 1 << 23
_DEEPEST = 60  # nodes are numbered as in a heap, in 64 bits

#: Chances of at most 0, 1, 2, ... draws under Poisson(1).
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
#: The same chances as places on the ring of 2**32.
_PLACES = [np.uint32(p) for p in np.ceil(POISSON * 4294967296.0) if p < 4294967296.0]
_TREES = "tree int, root long, ids array<long>, feature array<int>, bin array<int>, counts array<long>"


@dataclass(frozen=True)
class Options:
    """What decides how trees grow; ``classes`` is the number of classes, ``weights`` one weight for each."""

    classes: int
    weights: tuple[float, ...]
    features: int
    tried: int
    trees: int
    depth: int
    min_split: int
    min_leaf: int
    bootstrap: bool
    criterion: str
    seed: int


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def feature_order(tree: int, nodes: np.ndarray, o: Options) -> np.ndarray:
    """The order in which each node tries the features: by a hash of tree, node and feature."""
    base = _mixed(np.uint64(o.seed) + np.arange(o.features, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((tree + 1) << 32))
    return np.argsort(_mixed(nodes.astype(np.uint64)[:, None] * np.uint64(0xD1342543DE82EF95) + base[None, :]), axis=1, kind="stable")


def drawn(lot: np.ndarray, step: np.ndarray, tree: int) -> np.ndarray:
    """How often a tree draws each row: Poisson(1) at the point ``lot + tree * step`` of a ring of 2**32."""
    point = lot.astype(np.uint32) + step.astype(np.uint32) * np.uint32(tree)  # both wrap
    times = np.zeros(len(point), dtype=np.uint8)
    for place in _PLACES:
        times += point >= place
    return times


def lots(key: Sequence[str], seed: int) -> list[Column]:
    """(lot, step): two numbers below 2**32 from a digest of the key; the step is odd."""
    text = F.md5(F.concat_ws("|", *[F.coalesce(col(k).cast("string"), F.lit("")) for k in key], F.lit(str(seed))))
    part = lambda at: F.conv(F.substring(text, at, 8), 16, 10).cast("long")
    return [part(1).alias("_lot"), part(9).bitwiseOR(F.lit(1)).alias("_step")]


def _quality(counts: np.ndarray, o: Options) -> np.ndarray:
    """How pure a side is, times its weight: larger is better, and adds up over the sides."""
    held = counts * np.asarray(o.weights)
    total = held.sum(axis=-1)
    if o.criterion == "gini":
        return np.divide((held * held).sum(axis=-1), total, out=np.zeros_like(total), where=total > 0)
    share = np.divide(held, total[..., None], out=np.zeros_like(held), where=total[..., None] > 0)
    return (held * np.log2(np.where(share > 0, share, 1.0))).sum(axis=-1)


def best_splits(hist: np.ndarray, o: Options) -> tuple[np.ndarray, np.ndarray]:
    """(feature's place, bin) of the best split of each node, -1 where no split leaves ``min_leaf`` rows on both sides.

    ``hist`` is (node, tried feature, bin, class). Of equal splits the first feature, then the lowest bin, is taken.
    """
    left = hist.cumsum(axis=2)
    total = left[:, :, -1:, :]
    left = left[:, :, :-1, :]
    right = total - left
    fits = (left.sum(axis=3) >= o.min_leaf) & (right.sum(axis=3) >= o.min_leaf)
    value = np.where(fits, np.round(_quality(left, o) + _quality(right, o), 9), -np.inf).reshape(len(hist), -1)
    at = value.argmax(axis=1)
    found = np.isfinite(value[np.arange(len(hist)), at])
    bins = hist.shape[2] - 1
    return np.where(found, at // bins, -1), np.where(found, at % bins, -1)


def _histograms(bins: np.ndarray, classes: np.ndarray, times: np.ndarray, slot: np.ndarray, tried: np.ndarray, o: Options) -> np.ndarray:
    """(node, tried feature, bin, class): drawn rows; ``slot`` is each row's node, ``tried`` the features of each node."""
    nodes, many = tried.shape
    out = np.empty((many, nodes * BINS * o.classes))
    row, flat = np.arange(len(slot)) * bins.shape[1], bins.reshape(-1)
    base = slot * (BINS * o.classes) + classes
    times = times.astype(np.float64, copy=False)
    for j in range(many):
        cell = (bins[:, tried[0, j]] if nodes == 1 else flat.take(row + tried[:, j].take(slot))).astype(np.int64)
        cell *= o.classes
        cell += base
        out[j] = np.bincount(cell, weights=times, minlength=out.shape[1])
    return out.reshape(many, nodes, BINS, o.classes).swapaxes(0, 1)


def _open(counts: np.ndarray, depth: int, o: Options) -> np.ndarray:
    """Nodes that may be split: large, shallow and mixed enough."""
    return (counts.sum(axis=1) >= o.min_split) & ((counts > 0).sum(axis=1) > 1) & (depth < o.depth)


def _split_level(tree: int, ids: np.ndarray, bins: np.ndarray, classes: np.ndarray, times: np.ndarray, slot: np.ndarray,
                 o: Options) -> tuple[np.ndarray, np.ndarray]:
    """(feature, bin) of the nodes of a level, -1 where none: each tries its features in turn until one can be split."""
    order, feature, cut = feature_order(tree, ids, o), np.full(len(ids), -1), np.full(len(ids), -1)
    todo = np.arange(len(ids))
    for start in range(0, o.features, o.tried):
        tried = order[:, start:start + o.tried]
        step = max(1, _CELLS // (tried.shape[1] * BINS * o.classes))
        for at in range(0, len(todo), step):
            part = todo[at:at + step]
            place = np.full(len(ids), -1)
            place[part] = np.arange(len(part))
            own = np.flatnonzero(place[slot] >= 0) if len(part) < len(ids) else slice(None)
            hist = _histograms(bins[own], classes[own], times[own], place[slot[own]], tried[part], o)
            which, b = best_splits(hist, o)
            found = which >= 0
            feature[part[found]], cut[part[found]] = tried[part[found], which[found]], b[found]
        todo = todo[feature[todo] < 0]
        if not len(todo):
            break
    return feature, cut


def grow(tree: int, root: int, bins: np.ndarray, classes: np.ndarray, times: np.ndarray, o: Options) -> dict[str, np.ndarray]:
    """The nodes below (and with) ``root``, in heap order: ids, feature (-1 for a leaf), bin, counts by class."""
    ids, slot, times = np.array([root], dtype=np.int64), np.zeros(len(classes), dtype=np.int64), times.astype(np.float64)
    depth, out = root.bit_length() - 1, []
    while len(ids):
        counts = np.bincount(slot * o.classes + classes, weights=times, minlength=len(ids) * o.classes).reshape(len(ids), o.classes).astype(np.int64)
        may = _open(counts, depth, o)
        feature, cut = np.full(len(ids), -1), np.full(len(ids), -1)
        if may.any():
            place = np.cumsum(may) - 1
            if not may.all():
                stay = np.flatnonzero(may.take(slot))
                bins, classes, times, slot = bins.take(stay, axis=0), classes.take(stay), times.take(stay), place.take(slot.take(stay))
            feature[may], cut[may] = _split_level(tree, ids[may], bins, classes, times, slot, o)
        out.append((ids, feature, cut, counts))
        if not (feature >= 0).any():
            break
        f, b, own = feature[may], cut[may], ids[may]
        split = f >= 0
        if not split.all():
            stay = np.flatnonzero(split.take(slot))
            bins, classes, times, slot = bins.take(stay, axis=0), classes.take(stay), times.take(stay), slot.take(stay)
        right = bins.reshape(-1).take(np.arange(len(slot)) * bins.shape[1] + f.take(slot)) > b.take(slot)
        slot = (np.cumsum(split) - 1).take(slot) * 2 + right
        ids = (own[split][:, None] * 2 + np.array([0, 1])).reshape(-1)
        depth += 1
    ids, feature, cut, counts = (np.concatenate(c) for c in zip(*out))
    return {"ids": ids, "feature": feature, "bin": cut, "counts": counts}


class Tree:
    """A tree, or the upper part of one, as arrays in heap order: the two children of a node stand side by side."""

    def __init__(self, ids: np.ndarray, feature: np.ndarray, cut: np.ndarray, counts: np.ndarray | None = None):
        order = np.argsort(ids)
        self.ids, feature, cut = ids[order], feature[order], cut[order]
        at = np.searchsorted(self.ids, self.ids * 2)
        leaf = feature < 0
        self.child = np.where(leaf, np.arange(len(ids)), at).astype(np.int32)
        self.feature, self.cut = np.where(leaf, 0, feature).astype(np.int16), np.where(leaf, 255, cut).astype(np.uint8)
        self.levels = int(self.ids.max()).bit_length() - int(self.ids.min()).bit_length()
        self.counts = None if counts is None else counts[order]

    def ends(self, bins: np.ndarray) -> np.ndarray:
        """The place of the node where each row ends."""
        at, row, flat = np.zeros(len(bins), dtype=np.int32), np.arange(len(bins)) * bins.shape[1], bins.reshape(-1)
        out, own = at, None  # of rows that go on, ``own`` are the places in ``out``
        for level in range(self.levels):
            if level % 3 == 2:
                on = np.flatnonzero(self.cut.take(at) != 255)
                if 4 * len(on) < 3 * len(at):
                    if own is None:
                        out, own = at, on
                    else:
                        out[own] = at
                        own = own[on]
                    at, row = at.take(on), row.take(on)
            at = self.child.take(at) + (flat.take(row + self.feature.take(at)) > self.cut.take(at))
        if own is None:
            return at
        out[own] = at
        return out


class Digest:
    """Values by their number, in order. Beyond ``_DIGEST`` of them, as many at even ranks stand for all, with the largest."""

    def __init__(self):
        self.values, self.many, self.waiting, self.n = np.empty(0), np.empty(0, dtype=np.int64), [], 0

    def add(self, values: np.ndarray) -> None:
        self.waiting.append(values)
        self.n += len(values)
        if self.n >= _DIGESTED_ROWS:
            self.settle()

    def settle(self, most: int | None = None) -> None:
        new = np.sort(np.concatenate([*self.waiting, np.empty(0)]))
        first = np.flatnonzero(np.append(True, new[1:] != new[:-1])) if len(new) else np.empty(0, dtype=np.int64)
        self.merge(new[first], np.diff(first, append=len(new)), most)
        self.waiting, self.n = [], 0

    def merge(self, values: np.ndarray, many: np.ndarray, most: int | None = None) -> None:
        values, many, most = np.concatenate([self.values, values]), np.concatenate([self.many, many]), most or _DIGEST
        order = np.argsort(values, kind="stable")
        values, many = values[order], many[order]
        first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.empty(0, dtype=np.int64)
        if len(first):
            values, many = values[first], np.add.reduceat(many, first)
        if len(values) > most:
            upto = many.cumsum()
            ends = np.linspace(0, upto[-1], most + 1).round().astype(np.int64)
            at = np.append(np.searchsorted(upto, (ends[:-1] + ends[1:] + 1) // 2), len(values) - 1)
            values, many = values[at], np.append(np.diff(ends), 0)
            many[-2:] = (many[-2] - 1, 1)
        self.values, self.many = values, many

    def at(self, shares: Sequence[float]) -> np.ndarray:
        """The values at these shares of all ranks."""
        upto = self.many.cumsum()
        return self.values[np.searchsorted(upto, np.clip(np.ceil(np.asarray(shares) * upto[-1]), 1, upto[-1]))]


def _edges(df: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    """Upper ends of all bins but the last, per feature: distinct quantiles below the maximum.

    Tasks send a digest of each feature: exact up to 10,000 values, beyond that off by about as many ten-thousandths of the ranks as
    ``percentile_approx``, whose state costs microseconds a value.
    """
    at = [k / BINS for k in range(1, BINS)] + [1.0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = [Digest() for _ in features]
        for batch in batches:
            for k, d in enumerate(digests):
                d.add(_numbers(batch.column(f"f{k}")))
        for k, d in enumerate(digests):
            d.settle(_SENT)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([d.values.tobytes()], pa.binary()), pa.array([d.many.astype(np.int64).tobytes()], pa.binary())],
                                             ["feature", "at", "many"])

    def meet(parts: pd.DataFrame) -> pd.DataFrame:
        whole = Digest()
        for values, many in zip(parts["at"], parts["many"]):
            whole.merge(np.frombuffer(values), np.frombuffer(many, dtype=np.int64), 1 << 20)
        return pd.DataFrame({"feature": parts["feature"].iloc[:1], "at": [whole.at(at)] if len(whole.values) else [None]})

    sent = df.select(*_sent(df, features)).mapInArrow(run, "feature int, at binary, many binary")
    found = {r["feature"]: r["at"] for r in sent.groupBy("feature").applyInPandas(meet, "feature int, at array<double>").collect()}  # one row a feature
    quantiles = [found.get(k) for k in range(len(features))]
    return [np.unique([v for v in q[:-1] if v < q[-1]]).astype(float) if q else np.empty(0) for q in quantiles]


def _value(df: DataFrame, name: str) -> Column:
    """A feature as a number; missing ones count as 0."""
    return F.coalesce(present(df, name).cast("double"), F.lit(0.0))


_PLAIN = {"double", "float", "bigint", "int", "smallint", "tinyint"}


def _sent(df: DataFrame, features: Sequence[str]) -> list[Column]:
    """The features as f0, f1, ... on their way to :func:`_binned`, plain numbers as they are."""
    types = dict(df.dtypes)
    return [(col(c) if types[c] in _PLAIN else _value(df, c)).alias(f"f{k}") for k, c in enumerate(features)]


def _numbers(column: pa.Array) -> np.ndarray:
    """Like :func:`_value`: missing ones count as 0."""
    found = column.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    lacking = np.isnan(found)
    return np.where(lacking, 0.0, found) if lacking.any() else found


def _binned(batch: pa.RecordBatch, edges: list[np.ndarray]) -> np.ndarray:
    columns = [np.searchsorted(e, _numbers(batch.column(f"f{k}")), side="left").astype(np.uint8) for k, e in enumerate(edges)]
    return np.ascontiguousarray(np.stack(columns, axis=1)) if columns else np.empty((batch.num_rows, 0), dtype=np.uint8)


def _learning_rows(df: DataFrame, features: Sequence[str], label: str, classes: Sequence[str], key: Sequence[str], o: Options,
                   edges: list[np.ndarray]) -> DataFrame:
    """(lot, step, class, bins): a row as its draws, its class and a byte for each feature; rows of one kind are one, with the draws of all."""
    code = F.array_position(F.array(*[F.lit(c) for c in classes]), F.trim(col(label).cast("string"))).cast("int") - 1
    rows = df.select(*_sent(df, features), code.alias("class"), *lots(key, o.seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _together(batches):
            code, lot, step = (np.concatenate([b.column(c).to_numpy() for b in some]) for c in ("class", "_lot", "_step"))
            bins = np.concatenate([_binned(b, edges) for b in some])
            own, inverse = _distinct(np.column_stack([bins, code.astype("<u2").view(np.uint8).reshape(-1, 2)]))
            order = np.argsort(inverse, kind="stable")
            at = np.append(0, np.cumsum(np.bincount(inverse, minlength=len(own))))
            yield pa.RecordBatch.from_arrays([_blobs(lot[order].astype("<u4"), at), _blobs(step[order].astype("<u4"), at), pa.array(code[own], pa.int32()),
                                              _blobs(bins[own], np.arange(len(own) + 1))], ["lot", "step", "class", "bins"])

    return rows.mapInArrow(run, "lot binary, step binary, class int, bins binary")


def _packed(rows: DataFrame) -> DataFrame:
    """Pinned: many learning rows in one, as they are read once a level: their draws, and the rows, class and bins of each kind."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                blob = lambda c: b"".join(batch.column(c).to_pylist())
                many = pc.binary_length(batch.column("lot")).to_numpy() // 4
                made = [blob("lot"), blob("step"), many.astype("<u4").tobytes(), batch.column("class").to_numpy().astype("<u2").tobytes(), blob("bins")]
                yield pa.RecordBatch.from_arrays([pa.array([m], pa.binary()) for m in made], ["lot", "step", "many", "class", "bins"])

    return pin(rows.mapInArrow(run, "lot binary, step binary, many binary, class binary, bins binary"))


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The batches in runs of about ``_ROWS_AT_A_TIME`` rows."""
    some, n = [], 0
    for batch in batches:
        some.append(batch)
        n += batch.num_rows
        if n >= _ROWS_AT_A_TIME:
            yield some
            some, n = [], 0
    if n:
        yield some


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of one row of each kind, kind of each row) of rows of bytes."""
    wide = -(-max(rows.shape[1], 1) // 8) * 8
    filled = np.zeros((len(rows), wide), dtype=np.uint8)
    filled[:, :rows.shape[1]] = rows
    words = filled.view(np.uint64)
    kinds = words[:, 0].copy()
    for k in range(1, words.shape[1]):
        kinds = _mixed(kinds + np.uint64(k)) ^ words[:, k]
    _, own, inverse = np.unique(kinds, return_index=True, return_inverse=True)
    inverse = inverse.reshape(-1)
    if words.shape[1] > 1 and not np.array_equal(words.take(own, axis=0).take(inverse, axis=0), words):  # two kinds share a hash
        _, own, inverse = np.unique(filled.view(np.dtype((np.void, wide))).reshape(-1), return_index=True, return_inverse=True)
    return own, inverse.reshape(-1)


def _blobs(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """One binary for each run of ``values`` between two places of ``at``."""
    starts = (at * (values.itemsize * (values.shape[1] if values.ndim > 1 else 1))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(starts.tobytes()), pa.py_buffer(values.tobytes())])


@dataclass(frozen=True)
class Held:
    """Learning rows as a task holds them: ``lot`` and ``step`` of all, and for each kind its class, bins and first row."""

    lot: np.ndarray
    step: np.ndarray
    first: np.ndarray
    classes: np.ndarray
    bins: np.ndarray

    def times(self, tree: int, o: Options) -> np.ndarray:
        """How often a tree draws the rows of each kind."""
        times = _times(self.lot, self.step, tree, o)
        if len(self.first) == len(self.lot):
            return times.astype(np.int64)
        return np.add.reduceat(times, self.first, dtype=np.int64)


def _held(batches: Iterator[pa.RecordBatch], features: int) -> Iterator[Held]:
    """The learning rows of a task, about ``_BYTES_AT_A_TIME`` at a time."""
    def joined(some: list[pa.RecordBatch]) -> Held:
        blob = lambda c, kind: np.frombuffer(b"".join(x for b in some for x in b.column(c).to_pylist()), dtype=kind)
        many = blob("many", "<u4").astype(np.int64)
        return Held(blob("lot", "<u4"), blob("step", "<u4"), np.cumsum(many) - many, blob("class", "<u2").astype(np.int64), blob("bins", np.uint8).reshape(-1, features))

    some, size = [], 0
    for batch in (b.slice(i, 1) for b in batches for i in range(b.num_rows)):
        some.append(batch)
        size += batch.nbytes
        if size >= _BYTES_AT_A_TIME:
            yield joined(some)
            some, size = [], 0
    if some:
        yield joined(some)


def _times(lot: np.ndarray, step: np.ndarray, tree: int, o: Options) -> np.ndarray:
    return drawn(lot, step, tree) if o.bootstrap else np.ones(len(lot), dtype=np.uint8)


def _upper(known: pd.DataFrame) -> dict[int, Tree]:
    """The parts of the trees that are split already."""
    return {int(t): Tree(*(g[c].to_numpy() for c in ("node", "feature", "bin"))) for t, g in known.groupby("tree")}


def _root_counts(rows: DataFrame, o: Options) -> dict[tuple[int, int], np.ndarray]:
    """The drawn rows of each class, by tree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((o.trees, o.classes))
        for rows in _held(batches, o.features):
            for tree in range(o.trees):
                sums[tree] += np.bincount(rows.classes, weights=rows.times(tree, o), minlength=o.classes)
        tree, code = np.divmod(np.arange(sums.size), o.classes)
        yield pa.RecordBatch.from_arrays([pa.array(tree, pa.int32()), pa.array(code, pa.int32()), pa.array(sums.reshape(-1), pa.int64())], ["tree", "class", "n"])

    held = {(t, 1): np.zeros(o.classes, dtype=np.int64) for t in range(o.trees)}
    for r in rows.mapInArrow(run, "tree int, class int, n long").groupBy("tree", "class").agg(F.sum("n").alias("n")).collect():  # trees x classes
        held[r["tree"], 1][r["class"]] = r["n"]
    return held


def _level_splits(rows: DataFrame, known: pd.DataFrame, turn: dict[tuple[int, int], int], o: Options) -> pd.DataFrame:
    """(tree, node, place, bin, left, right) of the nodes in ``turn``, one short row each: the best split of the features whose turn it is, and the
    class counts of its sides. Tasks send histograms, which are summed by node."""
    shipped = rows.sparkSession.sparkContext.broadcast((known, turn))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, turn = shipped.value
        upper, wanted, sums = _upper(known), {}, {}
        for tree, node in sorted(turn):
            wanted.setdefault(tree, []).append(node)
        slots, tries = {}, {}
        for tree, nodes in wanted.items():
            slots[tree] = np.full(len(upper[tree].ids), -1)
            slots[tree][np.searchsorted(upper[tree].ids, nodes)] = np.arange(len(nodes))
            order, start = feature_order(tree, np.array(nodes), o), np.array([turn[tree, n] for n in nodes]) * o.tried
            at = np.minimum(start[:, None] + np.arange(o.tried), o.features - 1)  # the last turn may have fewer; repeats lose to the first
            tries[tree] = np.take_along_axis(order, at, axis=1)

        for held in _held(batches, o.features):
            for tree, nodes in wanted.items():
                times = held.times(tree, o)
                own = np.flatnonzero(times)
                bins = held.bins.take(own, axis=0)
                slot = slots[tree].take(upper[tree].ends(bins))
                on = np.flatnonzero(slot >= 0)
                if len(on) < len(own):
                    own, slot, bins = own.take(on), slot.take(on), bins.take(on, axis=0)
                if len(own):
                    found = _histograms(bins, held.classes.take(own), times.take(own), slot, tries[tree], o)
                    sums[tree] = sums[tree] + found if tree in sums else found
        for tree, found in sums.items():
            found = found.reshape(len(found), -1)
            cells = [np.flatnonzero(h) for h in found]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(found), tree), pa.int32()), pa.array(wanted[tree], pa.int64()),
                pa.array([c.astype("<u4").tobytes() for c in cells], pa.binary()), pa.array([h[c].tobytes() for h, c in zip(found, cells)], pa.binary())],
                ["tree", "node", "cells", "counts"])

    def choose(parts: pd.DataFrame) -> pd.DataFrame:
        hist = np.zeros(o.tried * BINS * o.classes)
        for cells, counts in zip(parts["cells"], parts["counts"]):
            hist[np.frombuffer(cells, "<u4")] += np.frombuffer(counts)
        hist = hist.reshape(1, o.tried, BINS, o.classes)
        which, b = best_splits(hist, o)
        sides = hist[0, max(which[0], 0)].astype(np.int64)
        return pd.DataFrame({"tree": [parts["tree"].iloc[0]], "node": [parts["node"].iloc[0]], "place": which, "bin": b,
                             "left": [sides[:b[0] + 1].sum(axis=0)], "right": [sides[b[0] + 1:].sum(axis=0)]})

    sent = rows.mapInArrow(run, "tree int, node long, cells binary, counts binary")
    return sent.groupBy("tree", "node").applyInPandas(choose, "tree int, node long, place int, bin int, left array<long>, right array<long>").toPandas()


def _split_large(rows: DataFrame, local_rows: int, o: Options) -> tuple[pd.DataFrame, dict[tuple[int, int], np.ndarray]]:
    """The nodes that were split over the whole table (tree, node, feature, bin; feature -1 at an end, ``open`` where it may be split
    on), and the class counts of all.

    There are at most rows / ``local_rows`` of them on a level of a tree; the rows of an open end fit into a task.
    """
    known = pd.DataFrame({"tree": np.arange(o.trees), "node": 1, "feature": -1, "bin": -1, "open": True})
    held, many = _root_counts(rows, o), max(1, _HELD_CELLS // (o.tried * BINS * o.classes))
    may = lambda e: bool(_open(held[e][None, :], e[1].bit_length() - 1, o)[0])
    known["open"] = [may((int(t), 1)) for t in known["tree"]]
    while True:
        large = [(int(t), int(n)) for t, n, on in zip(known["tree"], known["node"], known["open"]) if on and held[int(t), int(n)].sum() > local_rows]
        if not large:
            return known, held
        turn, found, done = dict.fromkeys(large, 0), [], set()
        while turn:
            splits = {(int(s.tree), int(s.node)): s for at in range(0, len(turn), many)
                      for s in _level_splits(rows, known, dict(sorted(turn.items())[at:at + many]), o).itertuples()}
            for e, k in list(turn.items()):
                s = splits[e]
                if s.place >= 0:
                    feature = feature_order(e[0], np.array([e[1]]), o)[0, k * o.tried + s.place]
                    found.append((*e, int(feature), int(s.bin), False))
                    held[e[0], 2 * e[1]], held[e[0], 2 * e[1] + 1] = np.array(s.left), np.array(s.right)
                    del turn[e]
                elif (k + 1) * o.tried >= o.features:
                    done.add(e)
                    del turn[e]
                else:
                    turn[e] = k + 1
        new = pd.DataFrame(found, columns=known.columns)
        below = pd.DataFrame([(t, c, -1, -1, may((t, c))) for t, n, *_ in found for c in (2 * n, 2 * n + 1)], columns=known.columns)
        split = set(zip(new["tree"], new["node"]))
        rest = known[[(t, n) not in split for t, n in zip(known["tree"], known["node"])]].copy()
        rest["open"] = [on and (t, n) not in done for t, n, on in zip(rest["tree"], rest["node"], rest["open"])]
        known = pd.concat([f for f in (rest, new, below) if len(f)], ignore_index=True)


def _grow_small(rows: DataFrame, known: pd.DataFrame, o: Options) -> DataFrame:
    """One row per open end of the upper parts: the nodes below and with it, as arrays. Rows of other ends stay where they are."""
    shipped = rows.sparkSession.sparkContext.broadcast(known)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        upper = _upper(known)
        on = {int(t): np.isin(upper[int(t)].ids, g["node"].to_numpy()[g["open"].to_numpy(dtype=bool)]) for t, g in known.groupby("tree")}
        for rows in _held(batches, o.features):
            for tree in range(o.trees):
                if not on[tree].any():
                    continue
                times = rows.times(tree, o)
                own = np.flatnonzero(times)
                if len(upper[tree].ids) > 1:
                    end = upper[tree].ends(rows.bins.take(own, axis=0))
                    stay = np.flatnonzero(on[tree][end])
                    order = stay[np.argsort(end[stay].astype(np.uint16) if len(upper[tree].ids) < 65536 else end[stay], kind="stable")]
                    own, end = own[order], end[order]
                else:
                    end = np.zeros(len(own), dtype=np.int32)
                if not len(own):
                    continue
                start = np.flatnonzero(np.append(True, end[1:] != end[:-1]))
                at = np.append(start, len(own))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(start), tree), pa.int32()), pa.array(upper[tree].ids[end[start]], pa.int64()), _blobs(rows.bins.take(own, axis=0), at),
                    _blobs(rows.classes.take(own).astype("<u2"), at), _blobs(times.take(own).astype("<u4"), at)], ["tree", "node", "bins", "classes", "times"])

    def finish(part: pd.DataFrame) -> pd.DataFrame:
        tree, node = int(part["tree"].iloc[0]), int(part["node"].iloc[0])
        read = lambda c, kind: np.frombuffer(b"".join(part[c]), dtype=kind)
        made = grow(tree, node, read("bins", np.uint8).reshape(-1, o.features), read("classes", "<u2").astype(np.int64), read("times", "<u4").astype(np.int64), o)
        return pd.DataFrame({"tree": [tree], "root": [node], "ids": [made["ids"]], "feature": [made["feature"]], "bin": [made["bin"]],
                             "counts": [made["counts"].reshape(-1)]})

    parts = rows.mapInArrow(deal, "tree int, node long, bins binary, classes binary, times binary")
    return parts.groupBy("tree", "node").applyInPandas(finish, _TREES)


@dataclass(frozen=True)
class BaggedForest:
    """A grown forest. ``trees`` is a pinned table of parts of trees; the rest is small."""

    trees: DataFrame
    features: list[str]
    classes: list[str]
    edges: list[np.ndarray]
    options: Options
    stats: dict = field(default_factory=dict)

    def _in_passes(self) -> list[list[int]]:
        """Groups of trees of at most ``MODEL_BYTES``."""
        sizes = self.trees.groupBy("tree").agg(F.sum(F.size("ids")).alias("nodes")).orderBy("tree").collect()  # one row a tree
        groups, room = [], 0
        for r in sizes:
            size = r["nodes"] * (8 + 4 + 2 + 1 + 8 * len(self.classes))
            if not groups or room + size > MODEL_BYTES:
                groups.append([])
                room = 0
            groups[-1].append(r["tree"])
            room += size
        return groups

    def _walkers(self, group: list[int]) -> list[tuple[int, Tree]]:
        """The trees of a group, each with the class shares of its nodes."""
        by_tree: dict[int, list] = {}
        for part in self.trees.filter(col("tree").isin(group)).toArrow().to_batches():  # at most MODEL_BYTES
            lists = [part.column(c) for c in ("ids", "feature", "bin", "counts")]
            for i, tree in enumerate(part.column("tree").to_pylist()):
                by_tree.setdefault(tree, []).append([c[i].values.to_numpy() for c in lists])
        walkers = []
        for tree, parts in sorted(by_tree.items()):
            ids, feature, cut, counts = (np.concatenate(c) for c in zip(*parts))
            counts = counts.reshape(-1, len(self.classes)) * np.asarray(self.options.weights)
            walkers.append((tree, Tree(ids, feature, cut, counts / np.maximum(counts.sum(axis=1, keepdims=True), 1e-300))))
        return walkers

    def _votes(self, df: DataFrame, lots_of: Sequence[Column] = ()) -> DataFrame:
        """The rows with ``_votes``, the class shares summed over all trees, and ``_voters``; with ``lots_of`` only trees that never drew a row vote."""
        require(df, self.features)
        edges, o, context, unseen = self.edges, self.options, df.sparkSession.sparkContext, bool(lots_of)
        start = [F.array(*[F.lit(0.0)] * len(self.classes)).alias("_votes"), F.lit(0).alias("_voters")]
        types, place = dict(df.dtypes), {c: k for k, c in enumerate(self.features)}
        once = {c: col(f"f{place[c]}") for c in df.columns if c in place and types[c] in _PLAIN}  # these go to the tasks and back as features alone
        rest = F.struct(*[col(c) for c in df.columns if c not in once], F.lit(0).alias("_more"))
        held = df.select(rest.alias("_row"), *_sent(df, self.features), *lots_of, *start)
        shape = held.schema
        passes = self._in_passes()
        for k, group in enumerate(passes):
            shipped = context.broadcast(self._walkers(group))

            def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    bins, n = _binned(batch, edges), batch.num_rows
                    votes = np.asarray(batch.column("_votes").flatten()).reshape(n, -1).copy()
                    voters = batch.column("_voters").to_numpy().copy()
                    if unseen:
                        lot, step = (batch.column(c).to_numpy().astype(np.uint32) for c in ("_lot", "_step"))
                    own, kind = _distinct(bins)  # rows of the same bins walk once
                    alike = 2 * len(own) < n
                    if alike:
                        bins = bins[own]
                    for tree, walker in shipped.value:
                        out = np.flatnonzero(_times(lot, step, tree, o) == 0) if unseen else slice(None)
                        end = walker.ends(bins)[kind[out]] if alike else walker.ends(bins.take(out, axis=0) if unseen else bins)
                        votes[out] += walker.counts.take(end, axis=0)
                        voters[out] += 1
                    kept = [batch.column(c) for c in batch.schema.names[:-2]]
                    listed = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * votes.shape[1], pa.int32()), pa.array(votes.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([*kept, listed, pa.array(voters, pa.int32())], batch.schema.names)

            held = held.mapInArrow(run, shape)
            if k < len(passes) - 1:
                held = pin(held)  # the next trees are shipped when these are done with
        return held.select(*[(once[c] if c in once else col("_row").getField(c)).alias(c) for c in df.columns], "_votes", "_voters")

    def shares_column(self, df: DataFrame, flag: Column) -> Column | None:
        """The class shares (array, in the order of ``classes``) of the rows where ``flag`` is true, null elsewhere; a plain column, so
        that a frame is classified in the pass that made the flag. None if the trees take more than one shipment."""
        require(df, self.features)
        passes = self._in_passes()
        if len(passes) > 1:
            return None
        edges, shipped = self.edges, df.sparkSession.sparkContext.broadcast(self._walkers(passes[0]))

        @F.pandas_udf("array<double>")
        def shares(flagged: pd.Series, *columns: pd.Series) -> pd.Series:
            own = np.flatnonzero(flagged.to_numpy(dtype=bool))
            out = np.full(len(flagged), None, dtype=object)
            if len(own):
                bins = np.stack([np.searchsorted(e, c.to_numpy()[own], side="left") for e, c in zip(edges, columns)], axis=1).astype(np.uint8)
                votes = sum(walker.counts[walker.ends(bins)] for _, walker in shipped.value) / len(shipped.value)
                out[own] = list(votes)
            return pd.Series(out)

        return shares(F.coalesce(flag, F.lit(False)), *[_value(df, c) for c in self.features])

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds predicted_label, predicted_code, confidence, probabilities (map) and is_anomalous, like ``classify.Classifier``."""
        own = [col(c) for c in df.columns]
        names = F.array(*[F.lit(c) for c in self.classes])
        shares = F.transform("_votes", lambda v: v / col("_voters"))
        scored = self._votes(df).select(*own, shares.alias("_p"))
        code = F.array_position("_p", F.array_max("_p")).cast("int") - 1
        return scored.select(*own, F.element_at(names, code + 1).alias("predicted_label"), code.alias("predicted_code"),
                             F.array_max("_p").alias("confidence"), F.map_from_arrays(names, "_p").alias("probabilities")) \
            .withColumn("is_anomalous", F.trim("predicted_label") != BENIGN)

    def score(self, df: DataFrame, label: str) -> DataFrame:
        return metrics.accuracy(self.predict(df), label, "predicted_label")

    def out_of_bag(self, df: DataFrame, label: str, key: Sequence[str]) -> DataFrame:
        """(key..., label, trees, votes, oob_label): the votes of the trees that never drew a training row.

        ``votes`` is the mean of their class shares, in the order of ``classes``; without such a tree it and the label are null.
        """
        voted = self._votes(df.select(*dict.fromkeys([*key, label, *self.features])), lots(key, self.options.seed))
        shares = F.when(col("_voters") > 0, F.transform("_votes", lambda v: v / col("_voters")))
        names = F.array(*[F.lit(c) for c in self.classes])
        best = F.element_at(names, F.array_position(shares, F.array_max(shares)).cast("int"))
        return voted.select(*[col(k) for k in key], F.trim(col(label).cast("string")).alias("label"), col("_voters").alias("trees"),
                            shares.alias("votes"), F.when(col("_voters") > 0, best).alias("oob_label"))

    def importance(self) -> DataFrame:
        """(feature, importance, rank): the loss of impurity at the splits of a feature, each tree's adding up to one, averaged."""
        o, names = self.options, self.features

        def losses(parts: pd.DataFrame) -> pd.DataFrame:
            ids, feature, counts = (np.concatenate(parts[c].to_list()) for c in ("ids", "feature", "counts"))
            order = np.argsort(ids)
            ids, feature, quality = ids[order], feature[order], _quality(counts.reshape(-1, o.classes)[order].astype(float), o)
            split = np.flatnonzero(feature >= 0)
            below = np.searchsorted(ids, ids[split] * 2)
            gain = np.bincount(feature[split], weights=quality[below] + quality[below + 1] - quality[split], minlength=len(names))
            return pd.DataFrame({"feature": names, "gain": gain / gain.sum() if gain.sum() > 0 else gain})

        gains = self.trees.groupBy("tree").applyInPandas(losses, "feature string, gain double")
        return ranked(gains.groupBy("feature").agg(F.avg("gain").alias("importance")))

    def save(self, path: str) -> None:
        """The trees as Parquet, the rest as one row of JSON."""
        spark = self.trees.sparkSession
        self.trees.write.mode("overwrite").parquet(f"{path}/trees")
        meta = {"features": self.features, "classes": self.classes, "edges": [e.tolist() for e in self.edges],
                "options": vars(self.options), "stats": self.stats}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> BaggedForest:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        options = Options(**{k: tuple(v) if isinstance(v, list) else v for k, v in meta["options"].items()})
        return BaggedForest(spark.read.schema(_TREES).parquet(f"{path}/trees"), meta["features"], meta["classes"],
                            [np.array(e, dtype=float) for e in meta["edges"]], options, meta["stats"])


def _tried(max_features: str | float | int | None, features: int) -> int:
    if max_features == "sqrt":
        return max(1, int(math.sqrt(features)))
    if max_features == "log2":
        return max(1, int(math.log2(features)))
    if max_features is None:
        return features
    return max(1, min(features, int(max_features * features) if isinstance(max_features, float) else int(max_features)))


def train(df: DataFrame, features: Sequence[str], label: str, key: Sequence[str], trees: int = CLASSIFIER_TREES, depth: int = CLASSIFIER_DEPTH,
          min_split: int = CLASSIFIER_SPLIT, min_leaf: int = CLASSIFIER_LEAF, max_features: str | float | int | None = "sqrt", bootstrap: bool = True,
          oob_score: bool = True, weights: Mapping[str, float] | str | None = "balanced", criterion: str = "gini", seed: int = SEED,
          local_rows: int = LOCAL_ROWS) -> BaggedForest:
    """Random forest over the rows of ``df``; ``key`` names the columns that tell rows apart, and decides which trees draw them.

    Labels are trimmed; rows without one are left out. Least rows to split and in a leaf count rows as often as they are drawn.
    ``weights`` is balanced, a weight per class (others 1), or none. ``stats`` holds the sizes and, with ``oob_score``, the share of
    right out-of-bag labels among rows that have one. Missing numbers count as 0.
    """
    require(df, [*features, label, *key])
    if criterion not in ("gini", "entropy"):
        raise ModelError(f"unknown criterion {criterion!r}")
    if not features:
        raise ModelError("no features")
    df = df.filter(col(label).isNotNull())
    sizes = class_weights(df.withColumn(label, F.trim(col(label).cast("string"))), label).orderBy("label").collect()  # one row per class
    if not sizes:
        raise ModelError("cannot train on an empty table")
    classes = [r["label"] for r in sizes]
    given = {r["label"]: r["weight"] for r in sizes} if weights == "balanced" else weights or {}
    o = Options(len(classes), tuple(float(given.get(c, 1.0)) for c in classes), len(features), _tried(max_features, len(features)), trees,
                min(depth, _DEEPEST), max(2, min_split), max(1, min_leaf), bootstrap, criterion, seed)
    edges = _edges(df, features)
    rows = _packed(_learning_rows(df, features, label, classes, key, o, edges))
    kinds, n = rows.agg(F.sum(F.length("class") / 2).cast("long"), F.sum(F.length("lot") / 4).cast("long")).first()
    if kinds > local_rows:
        known, counts = _split_large(rows, local_rows, o)
    else:
        known, counts = pd.DataFrame({"tree": np.arange(trees), "node": 1, "feature": -1, "bin": -1, "open": True}), {}
    grown = _grow_small(rows, known, o)
    upper = known[~known["open"].astype(bool)]
    if len(upper):
        parts = [(int(t), 1, [int(x) for x in g["node"]], [int(x) for x in g["feature"]], [int(x) for x in g["bin"]],
                  [int(x) for e in g["node"] for x in counts[int(t), int(e)]]) for t, g in upper.groupby("tree")]
        grown = grown.unionByName(df.sparkSession.createDataFrame(parts, _TREES))
    forest = BaggedForest(pin(grown), list(features), classes, edges, o, {
        "n_samples": n, "n_features": len(features), "n_classes": len(classes), "class_names": classes, "n_estimators": trees, "max_depth": depth, "oob_score": None})
    if oob_score and bootstrap:
        right = forest.out_of_bag(df, label, key).agg(F.avg(F.when(col("trees") > 0, (col("oob_label") == col("label")).cast("int"))).alias("s")).first()["s"]
        forest = replace(forest, stats=forest.stats | {"oob_score": right})
    return forest

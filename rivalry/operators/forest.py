"""Random forest of the result model for large tables: Spark's algorithm by
histograms over binned columns. Its functions travel to the executors by value.

Rows are binned once and written as blocks (a byte a feature). A level of all
trees is one pass: every task counts (node, feature, bin, class) over its
blocks, the counts are added up by tree on the executors, and the best splits
(same candidates, impurity and order of ties as Spark's forest) come back. The
driver holds the trees only. The result is a ``RandomForestClassificationModel``.
"""

from __future__ import annotations

import math
import sys
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivalry.session import cut_lineage, ensure_checkpoint_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS = 131_072
COUNTS_MB = 64  # of counts held by a task in one pass
MAX_DEPTH = 12  # levels are dense arrays: deeper forests are Spark's


@dataclass
class Blocks:
    """The binned table (``block, n, label, codes``; ``codes`` row by row) and
    how it was binned: ``splits`` of a feature are its thresholds, or None for
    a categorical one with ``arity`` values."""

    df: DataFrame
    splits: list[np.ndarray | None]
    arity: list[int]
    classes: int
    max_bins: int

    @property
    def wide(self) -> bool:
        return self.bins > 256

    @property
    def bins(self) -> int:
        return max(len(s) + 1 if s is not None else a for s, a in zip(self.splits, self.arity, strict=True))


def categories_of(df: DataFrame, features: str = "features") -> dict[int, int]:
    """Number of values of each categorical slot of the assembled features."""
    attrs = df.schema[features].metadata.get("ml_attr", {}).get("attrs", {})
    nominal = {a["idx"]: len(a["vals"]) if "vals" in a else a.get("num_vals", 0) for a in attrs.get("nominal", [])}
    return nominal | {a["idx"]: 2 for a in attrs.get("binary", [])}


def thresholds(values: np.ndarray, bins: int) -> np.ndarray:
    """Candidate splits of one feature's sampled values, as Spark chooses them: half way
    between neighbours, all of them or about ``bins`` - 1 at equal shares of the rows."""
    found, counts = np.unique(values[~np.isnan(values)], return_counts=True)
    middle = (found[:-1] + found[1:]) / 2.0
    if len(middle) <= bins - 1:
        return middle
    stride = counts.sum() / bins
    out, target, before = [], stride, counts[0]
    for k in range(1, len(found)):
        now = before + counts[k]
        if abs(before - target) < abs(now - target):
            out.append(middle[k - 1])
            target += stride
        before = now
    return np.array(out)


def blocks_of(df: DataFrame, ready: Callable[[DataFrame], DataFrame] = lambda df: df, *, bins: int, label: str = "label", seed: int = 42) -> Blocks:
    """``ready(df)`` (label and assembled ``features``) binned and written. Candidate
    splits come from a sample, as in Spark's trees (about bins^2 rows, 10,000 at least)."""
    def pairs(df: DataFrame) -> DataFrame:
        return ready(df).select(F.col(label).cast("double").alias("label"), vector_to_array("features").alias("features"))

    c = F.col(label).cast("double")
    n, codes, top = df.agg(F.count(F.lit(1)), F.count_if((c >= 0) & (c < 65_536) & (c == F.floor(c))), F.max(c)).first()
    if codes < n:
        raise ValueError(f"{label}: classes must be codes 0, 1, ... and not NULL")
    wanted = max(bins * bins, 10_000)
    some = df if n <= wanted else df.sample(wanted / n, seed)
    sample = np.array(pairs(some).select("features").toPandas()["features"].tolist(), dtype=np.float64)
    kinds = categories_of(ready(df))
    width = sample.shape[1]
    # a feature with one category only is no category to Spark's trees either
    splits = [None if kinds.get(k, 0) > 1 else thresholds(sample[:, k], min(bins, n)) for k in range(width)]
    arity = [kinds.get(k, 0) for k in range(width)]
    out = Blocks(df, splits, arity, int(top) + 1, min(bins, n))
    code = np.uint16 if out.wide else np.uint8

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number, held, rows = TaskContext.get().partitionId() << 32, 0, [], 0

        def block() -> pa.RecordBatch:
            labels, codes = (np.concatenate(x) for x in zip(*held, strict=True))
            return pa.RecordBatch.from_pydict({
                "block": pa.array([first + number], pa.int64()), "n": pa.array([len(labels)], pa.int32()),
                "label": pa.array([labels.tobytes()], pa.binary()), "codes": pa.array([codes.tobytes()], pa.binary())})

        for batch in batches:
            if not len(batch):
                continue
            x = np.asarray(batch.column("features").flatten()).reshape(len(batch), width)
            codes = np.empty(x.shape, code)
            for k, at in enumerate(splits):
                codes[:, k] = x[:, k] if at is None else np.searchsorted(at, x[:, k])
            held.append((batch.column("label").to_numpy().astype(np.uint16), codes))
            rows += len(batch)
            if rows >= BLOCK_ROWS:
                yield block()
                number, held, rows = number + 1, [], 0
        if held:
            yield block()

    out.df = cut_lineage(pairs(df).mapInArrow(cut, "block long, n int, label binary, codes binary"))
    return out


# Poisson numbers of mean 1 from 32 random bits: the 16 leading bits decide, but for a few cells
_STEPS = np.floor(np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 12)])) * 2.0**32).astype(np.uint64)
_CELL = np.searchsorted(_STEPS, np.arange(65_536, dtype=np.uint64) << 16, "right").astype(np.uint8)
_OPEN = np.unique(_STEPS >> 16)
_CELL[_OPEN[_OPEN < 65_536].astype(np.int64)] = 255


def bag(seed: int, block: int, tree: int, n: int) -> np.ndarray:
    """How often each of a block's rows stands in the tree's bootstrap sample."""
    drawn = np.random.Generator(np.random.SFC64([seed, block, tree])).integers(0, 1 << 32, n, np.uint32)
    out = _CELL[drawn >> 16]
    unclear = np.flatnonzero(out == 255)
    out[unclear] = np.searchsorted(_STEPS, drawn[unclear].astype(np.uint64), "right")
    return out


def _asked(seed: int, tree: int, level: int, width: int, share: int) -> np.ndarray:
    """The features that each node of a level may split by."""
    if share == width:
        return np.tile(np.arange(width), (1 << level, 1))
    drawn = np.random.default_rng([seed, tree, level]).random((1 << level, width))
    return drawn.argsort(axis=1)[:, :share]


def _gini(counts: np.ndarray) -> np.ndarray:
    total = counts.sum(axis=-1)
    out = np.ones(total.shape)
    for c in range(counts.shape[-1]):
        out = out - (counts[..., c] / np.maximum(total, 1)) ** 2
    return np.where(total > 0, out, 0.0)


def best_splits(hist: np.ndarray, asked: np.ndarray, splits: list[np.ndarray | None], arity: list[int], max_bins: int) -> tuple:
    """``(feature, right, gain, left, total)`` of each node of ``hist`` (node,
    asked feature, bin, class): the split of largest gain, or feature -1, the
    bins that go right, and the classes of the left side and the whole node."""
    nodes, share, bins, classes = hist.shape
    total = hist[:, 0].sum(axis=1)
    whole, impurity = total.sum(axis=1), _gini(total)
    unordered = int(math.log2(max_bins // 2 + 1) + 1) if classes > 2 else 0
    gain = np.full((nodes, share), -np.inf)
    right = np.zeros((nodes, share, bins), bool)
    left_of = np.zeros((nodes, share, classes), np.int64)
    for f in np.unique(asked):
        at, k = np.nonzero(asked == f)
        width = arity[f] if splits[f] is None else len(splits[f]) + 1
        if width < 2:
            continue
        h = hist[at, k, :width].astype(np.int64)
        place = np.broadcast_to(np.arange(width), (len(at), width))
        if splits[f] is None and width <= unordered:
            subsets = (np.arange(1, 1 << (width - 1))[:, None] >> np.arange(width)) & 1
            left = np.einsum("sb,nbc->nsc", subsets, h)
        else:
            if splits[f] is None:
                seen = h.sum(axis=2)
                middle = _gini(h) if classes > 2 else h[:, :, 1].astype(float)
                order = np.argsort(np.where(seen > 0, middle, np.inf), axis=1, kind="stable")
                h = np.take_along_axis(h, order[:, :, None], axis=1)
                place = np.argsort(order, axis=1)
            left = np.cumsum(h, axis=1)[:, :-1]
        other = total[at][:, None, :] - left
        n_left, n_right = left.sum(axis=2), other.sum(axis=2)
        n = whole[at][:, None]
        each = impurity[at][:, None] - n_left / n * _gini(left) - n_right / n * _gini(other)
        each = np.where((n_left > 0) & (n_right > 0), each, -np.inf)
        best = each.argmax(axis=1)
        rows = np.arange(len(at))
        gain[at, k], left_of[at, k] = each[rows, best], left[rows, best]
        right[at, k, :width] = subsets[best] == 0 if splits[f] is None and width <= unordered else place > best[:, None]
    pick, rows = gain.argmax(axis=1), np.arange(nodes)
    top = gain[rows, pick]
    feature = np.where(top > 0, asked[rows, pick], -1)
    return feature, right[rows, pick], top, left_of[rows, pick], total


@dataclass
class Level:
    """One level of every tree, each an array (tree, node): ``feature`` is -1
    where no split is, ``right`` says which bins go right."""

    feature: np.ndarray
    right: np.ndarray
    gain: np.ndarray
    counts: np.ndarray


def _level(blocks: Blocks, levels: list[Level], open_nodes: np.ndarray, *, share: int, seed: int, bootstrap: bool) -> list[tuple]:
    """Best splits of a level: ``(tree, feature, right, gain, left, total)``, nodes in the order of ``open_nodes``."""
    spark = blocks.df.sparkSession
    depth, width, bins, classes = len(levels), len(blocks.splits), blocks.bins, blocks.classes
    code = np.uint16 if blocks.wide else np.uint8
    wide = np.uint8 if bins * classes <= 256 else np.uint32
    trees = [int(t) for t in np.flatnonzero(open_nodes.any(axis=1))]
    cells = share * bins * classes
    most = max(1, int(COUNTS_MB * 2**20 / (4 * cells * max(1, open_nodes.sum(axis=1).max()))))
    sent = spark.sparkContext.broadcast(([(x.feature, x.right) for x in levels], open_nodes, blocks.splits, blocks.arity))
    max_bins = blocks.max_bins

    def count(some: list[int]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            above, is_open, _, _ = sent.value
            slot = {t: np.where(is_open[t], np.cumsum(is_open[t]) - 1, -1) for t in some}
            ask = {t: np.asfortranarray(_asked(seed, t, depth, width, share)[is_open[t]]) for t in some}
            features = {t: [np.maximum(feature[t], 0).astype(np.int64) for feature, _ in above] for t in some}
            below = {t: [np.where(feature[t][:, None] < 0, -1, 2 * np.arange(len(feature[t]))[:, None] + right[t]).reshape(-1)
                         for feature, right in above] for t in some}
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for block, n, label, codes in zip(*(batch.column(c) for c in ("block", "n", "label", "codes")), strict=True):
                    block, n = block.as_py(), n.as_py()
                    values = np.frombuffer(codes.as_buffer(), code)
                    labels = np.frombuffer(label.as_buffer(), np.uint16)
                    # bin and class in one number
                    cell = (values.reshape(n, width).astype(wide) * wide(classes) + labels[:, None].astype(wide)).reshape(-1)
                    for t in some:
                        if bootstrap:
                            drawn = bag(seed, block, t, n)
                            row = np.flatnonzero(drawn)
                        else:
                            drawn, row = np.ones(n, np.uint8), np.arange(n)
                        at, begin = np.zeros(len(row), np.int64), row * width
                        # a row's place on each level: below the left or the right side, or nowhere
                        for feature, goes in zip(features[t], below[t], strict=True):
                            at = goes.take(at * bins + values.take(begin + feature.take(at)))
                            if len(goes) and goes.min() < 0:
                                inner = np.flatnonzero(at >= 0)
                                if len(inner) < len(row):
                                    row, at, begin = row[inner], at[inner], begin[inner]
                        at = slot[t].take(at)
                        inner = np.flatnonzero(at >= 0)
                        if len(inner) < len(row):
                            row, at, begin = row[inner], at[inner], begin[inner]
                        if not len(row):
                            continue
                        size = len(ask[t]) * bins * classes
                        if t not in sums:
                            sums[t] = np.zeros((share, size), np.int32)
                        weight, first = drawn.take(row).astype(np.float64), at * (bins * classes)
                        for k in range(share):
                            place = first + cell.take(begin + ask[t][:, k].take(at))
                            sums[t][k] += np.bincount(place, weight, size).astype(np.int32)
            for t, counts in sums.items():
                yield pa.RecordBatch.from_pydict({"tree": pa.array([t], pa.int32()), "counts": pa.array([counts.tobytes()], pa.binary())})

        return run

    def split(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        _, is_open, splits, arity = sent.value
        t = int(key[0])
        ask = _asked(seed, t, depth, width, share)[is_open[t]]
        hist = np.zeros(len(ask) * cells, np.int64)
        for part in parts["counts"]:
            hist += np.frombuffer(part, np.int32)
        found = best_splits(hist.reshape(share, len(ask), bins, classes).swapaxes(0, 1), ask, splits, arity, max_bins)
        kinds = (np.int32, np.bool_, np.float64, np.int64, np.int64)
        return pd.DataFrame([[t, *(x.astype(kind).tobytes() for x, kind in zip(found, kinds, strict=True))]], columns=["tree", "feature", "right", "gain", "left", "total"])

    out = []
    for lo in range(0, len(trees), most):
        counted = blocks.df.mapInArrow(count(trees[lo: lo + most]), "tree int, counts binary")
        found = counted.groupBy("tree").applyInPandas(split, "tree int, feature binary, right binary, gain binary, left binary, total binary")
        for t, feature, right, gain, left, total in found.collect():
            out.append((t, np.frombuffer(feature, np.int32), np.frombuffer(right, np.bool_).reshape(-1, bins), np.frombuffer(gain),
                        np.frombuffer(left, np.int64).reshape(-1, classes), np.frombuffer(total, np.int64).reshape(-1, classes)))
    sent.destroy()
    return out


def grow(blocks: Blocks, *, trees: int, depth: int, seed: int = 42, share: int | None = None, bootstrap: bool = True) -> list[Level]:
    """The levels of a forest, the last one without splits. ``share``: features
    tried at a node, by default the root of their number (all, for one tree)."""
    width, bins, classes = len(blocks.splits), blocks.bins, blocks.classes
    share = share or (width if trees == 1 else math.ceil(math.sqrt(width)))
    levels: list[Level] = []
    counts = np.zeros((trees, 1, classes), np.int64)
    is_open = np.ones((trees, 1), bool)
    for d in range(depth + 1):
        feature = np.full((trees, 1 << d), -1, np.int32)
        right = np.zeros((trees, 1 << d, bins), bool)
        gain = np.full((trees, 1 << d), -1.0)
        below = np.zeros((trees, 2 << d, classes), np.int64)
        # a pass also for depth 0: it counts the root
        if is_open.any() and (d < depth or d == 0):
            for t, f, go, g, left, total in _level(blocks, levels, is_open, share=share, seed=seed, bootstrap=bootstrap):
                at = np.flatnonzero(is_open[t])
                counts[t, at] = total
                if d < depth:
                    feature[t, at], right[t, at] = f, go
                    gain[t, at] = np.where(f >= 0, g, -1.0)
                    at, kept = at[f >= 0], f >= 0
                    below[t, 2 * at], below[t, 2 * at + 1] = left[kept], (total - left)[kept]
        levels.append(Level(feature, right, gain, counts))
        counts, is_open = below, _gini(below) > np.finfo(float).eps
    return levels


def _nodes(blocks: Blocks, levels: list[Level], t: int) -> list[tuple]:
    """A tree's nodes in Spark's stored order (a node, its left side, its right
    side); a split whose two sides predict the same class is taken back."""
    out: list = []

    def add(d: int, i: int) -> bool:
        """Adds the node and what is below; whether it is a leaf."""
        level, me = levels[d], len(out)
        counts = level.counts[t, i]
        n, f = int(counts.sum()), int(level.feature[t, i])
        stats, guess, impure = [float(c) for c in counts], float(counts.argmax()), float(_gini(counts))
        out.append(None)
        leaf = f < 0
        if not leaf:
            left = len(out)
            l_leaf = add(d + 1, 2 * i)
            right = len(out)
            leaf = add(d + 1, 2 * i + 1) and l_leaf and out[left][1] == out[right][1]
        if leaf:
            del out[me + 1:]
            out[me] = (me, guess, impure, stats, n, -1.0, -1, -1, (-1, [], -1))
        else:
            go = level.right[t, i]
            if blocks.splits[f] is None:
                rule = (f, [float(c) for c in np.flatnonzero(~go[:blocks.arity[f]])], blocks.arity[f])
            else:
                rule = (f, [float(blocks.splits[f][int((~go[:len(blocks.splits[f]) + 1]).sum()) - 1])], -1)
            out[me] = (me, guess, impure, stats, n, float(level.gain[t, i]), left, right, rule)
        return leaf

    add(0, 0)
    return out


def fit_forest(classifier: RandomForestClassifier, blocks: Blocks, *, share: int | None = None, bootstrap: bool = True) -> RandomForestClassificationModel:
    """The model of ``classifier`` (its depth, number of trees and seed) grown from ``blocks``."""
    spark = blocks.df.sparkSession
    trees, seed = classifier.getNumTrees(), classifier.getSeed()
    levels = grow(blocks, trees=trees, depth=classifier.getMaxDepth(), seed=seed, share=share, bootstrap=bootstrap)
    # the frame of a stored model: a forest of as many roots, over one row a class
    roots = spark.createDataFrame([(float(c), Vectors.dense([0.0] * len(blocks.splits))) for c in range(blocks.classes)], ["_label", "_features"])
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/rivalry-forest/{uuid.uuid4().hex}"
    plain = classifier.copy({classifier.labelCol: "_label", classifier.featuresCol: "_features"})
    plain.fit(roots).save(path)
    schema = spark.read.parquet(f"{path}/data").schema
    # nodes are bounded by trees x 2^depth, whatever the rows
    nodes = [(t, node) for t in range(trees) for node in _nodes(blocks, levels, t)]
    spark.createDataFrame(nodes, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/data")
    model = RandomForestClassificationModel.load(path)
    return model.setFeaturesCol(classifier.getFeaturesCol())

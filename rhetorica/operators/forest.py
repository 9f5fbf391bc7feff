"""A random forest for sparse features.

Spark ML's forest turns every row into a dense array with a bin for each feature, so a bag of words takes
as much room as the vocabulary. Here rows stay sparse: only values that aren't 0 are counted, what a
node has at 0 is the rest of its weight, and every midpoint of two values is a possible split.

As in Spark ML, trees grow level by level together, each from rows drawn with replacement (a Poisson
weight for each row and tree) and with a random set of features for each node, as many as the square root of all.
A single tree takes all rows and features.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.base import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasSeed, HasWeightCol
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rhetorica.sources.tables import stored

# Steps of the hash that draws features and weights.
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Chances of at most 0, 1, 2 ... draws of a row.
DRAWS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])


def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits for each number."""
    x = np.asarray(x).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def _salt(*numbers: int) -> np.uint64:
    x = np.zeros(1, np.uint64)
    for n in numbers:
        x = mixed(x + np.uint64(0x9E3779B97F4A7C15) + np.array([n], np.int64).astype(np.uint64))
    return x[0]


def sparse_parts(features: Column) -> list[Column]:
    """The places and the values of a vector, dense or sparse."""
    v = F.unwrap_udt(features)
    places = F.coalesce(v["indices"], F.transform(v["values"], lambda _, i: i))
    return [places.alias("at"), v["values"].alias("v")]


class Rows:
    """The values of a batch's rows that aren't 0, sorted by row and feature."""

    def __init__(self, at: pa.Array, v: pa.Array, n_features: int) -> None:
        self.n, self.width = len(at), n_features
        sizes = np.diff(at.offsets.to_numpy())
        self.row, self.feature, self.value = np.repeat(np.arange(self.n), sizes), at.flatten().to_numpy().astype(np.int64), v.flatten().to_numpy()
        self.key = self.row * n_features + self.feature

    def of(self, row: np.ndarray, feature: np.ndarray) -> np.ndarray:
        """The value of each row at its feature."""
        key = row * self.width + feature
        found = np.searchsorted(self.key, key)
        there = found < len(self.key)
        there[there] = self.key[found[there]] == key[there]
        out = np.zeros(len(row))
        out[there] = self.value[found[there]]
        return out

    def node(self, feature: np.ndarray, threshold: np.ndarray, split: np.ndarray) -> np.ndarray:
        """The node that each row comes to in a tree; nodes k have the children 2k and 2k + 1, the root is 1."""
        node = np.ones(self.n, np.int64)
        on = np.arange(self.n)
        while len(on := on[split[node[on]]]):
            now = node[on]
            node[on] = 2 * now + (self.of(on, feature[now]) > threshold[now])
        return node


def _impurity(counts: np.ndarray, total: np.ndarray, kind: str) -> np.ndarray:
    p = counts / np.maximum(total, 1e-300)[:, None]
    if kind == "gini":
        return 1 - (p * p).sum(1)
    return -(p * np.log2(np.where(p > 0, p, 1))).sum(1)


def _best(table: pa.Table, totals: dict, classes: int, kind: str) -> list[tuple]:
    """(tree, node, feature, threshold, gain, left counts) of the best split of each node in the table."""
    tree, node, feature, value, y, w = (table.column(c).to_numpy() for c in ("tree", "node", "feature", "value", "y", "w"))
    order = np.lexsort((value, feature, node, tree))
    tree, node, feature, value, y, w = (x[order] for x in (tree, node, feature, value, y, w))
    new = np.ones(len(tree), bool)
    new[1:] = (np.diff(tree) != 0) | (np.diff(node) != 0) | (np.diff(feature) != 0)
    group = np.cumsum(new) - 1
    step = new.copy()
    step[1:] |= np.diff(value) != 0
    counts = np.zeros((step.sum(), classes))
    np.add.at(counts, (np.cumsum(step) - 1, y), w)
    group, value = group[step], value[step]
    own = [totals[k] for k in zip(tree[new].tolist(), node[new].tolist())]
    every = np.stack(own)
    seen = np.zeros_like(every)
    np.add.at(seen, group, counts)
    # what the node has at 0, as one more value of each feature
    group, value, counts = np.concatenate([group, np.arange(len(every))]), np.concatenate([value, np.zeros(len(every))]), np.concatenate([counts, every - seen])
    order = np.lexsort((value, group))
    group, value, counts = group[order], value[order], counts[order]
    begin = np.flatnonzero(np.r_[True, np.diff(group) != 0])
    run = np.cumsum(counts, 0)
    left = run - (run[begin] - counts[begin])[group]
    right = every[group] - left
    lw, rw, all_w = left.sum(1), right.sum(1), every.sum(1)[group]
    after = np.r_[value[1:], np.inf]
    ends = np.r_[np.diff(group) != 0, True] | (after == value) | (lw <= 1e-9) | (rw <= 1e-9)
    gain = _impurity(every, every.sum(1), kind)[group] - lw / all_w * _impurity(left, lw, kind) - rw / all_w * _impurity(right, rw, kind)
    gain[ends] = -1
    t, n, f = tree[new][group], node[new][group], feature[new][group]
    order = np.lexsort((value, f, -gain, n, t))
    first = order[np.r_[True, (np.diff(t[order]) != 0) | (np.diff(n[order]) != 0)]]
    return [(int(t[i]), int(n[i]), int(f[i]), float((value[i] + after[i]) / 2), float(gain[i]), left[i].tolist()) for i in first if gain[i] > 1e-12]


class SparseForest(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasSeed, HasWeightCol):
    """Classes are numbers from 0 in the label column; the model adds the prediction and the mean of the trees' class shares."""

    numTrees = Param(Params._dummy(), "numTrees", "number of trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of splits", TypeConverters.toInt)
    impurity = Param(Params._dummy(), "impurity", "gini or entropy", TypeConverters.toString)

    def __init__(self, labelCol: str = "label", numTrees: int = 20, impurity: str = "gini", maxDepth: int = 5, seed: int = 0, weightCol: str | None = None) -> None:
        super().__init__()
        if impurity not in ("gini", "entropy"):
            raise ValueError("impurity: gini or entropy")
        self._set(labelCol=labelCol, numTrees=numTrees, impurity=impurity, maxDepth=maxDepth, seed=seed, **({"weightCol": weightCol} if weightCol else {}))

    def _fit(self, df: DataFrame) -> ForestModel:
        g = self.getOrDefault
        trees, depth, kind, seed = g(self.numTrees), g(self.maxDepth), g(self.impurity), g(self.seed)
        weight = F.col(self.getWeightCol()).cast("double") if self.isDefined(self.weightCol) else F.lit(1.0)
        y = F.col(self.getLabelCol()).cast("int").alias("y")
        rows = stored(df.select(F.monotonically_increasing_id().alias("row"), y, weight.alias("w"), *sparse_parts(F.col(self.getFeaturesCol()))), "forest-rows", free=True)
        head = df.select(F.unwrap_udt(self.getFeaturesCol())["size"].alias("size"), F.size(F.unwrap_udt(self.getFeaturesCol())["values"]).alias("n")).first()
        if head is None:
            raise ValueError("nothing to learn from")
        width = head["size"] or head["n"]
        classes = rows.agg(F.max("y")).first()[0] + 1
        asked = width if trees == 1 else math.ceil(math.sqrt(width))
        size = 1 << (depth + 1)
        feature, threshold, split = np.zeros((trees, size), np.int64), np.zeros((trees, size)), np.zeros((trees, size), bool)
        shares = np.zeros((trees, size, classes))

        def drawn(row: np.ndarray, w: np.ndarray, tree: int) -> np.ndarray:
            if trees == 1:
                return w
            return w * np.searchsorted(DRAWS, mixed(row.astype(np.uint64) + _salt(seed, tree)) / 2.0**64, side="right")

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                row, y, w = (b.column(c).to_numpy() for c in ("row", "y", "w"))
                for t in range(trees):
                    got = np.bincount(y, drawn(row, w, t), classes)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(classes, t, np.int32)), pa.array(np.arange(classes, dtype=np.int32)), pa.array(got)], ["tree", "y", "w"])

        for r in rows.select("row", "y", "w").mapInArrow(sums, "tree int, y int, w double").groupBy("tree", "y").agg(F.sum("w").alias("w")).collect():
            shares[r.tree, 1, r.y] = r.w
        open_nodes = [(t, 1) for t in range(trees) if (shares[t, 1] > 0).sum() > 1]
        for _ in range(depth):
            if not open_nodes:
                break
            salt, limit, is_open = np.zeros((trees, size), np.uint64), np.zeros((trees, size), np.uint64), np.zeros((trees, size), bool)
            for t, n in open_nodes:
                salt[t, n], is_open[t, n] = _salt(seed, t, n), True
                limit[t, n] = np.partition(mixed(np.arange(width, dtype=np.uint64) + salt[t, n]), asked - 1)[asked - 1]
            totals = {(t, n): shares[t, n] for t, n in open_nodes}

            def counted(batches: Iterator[pa.RecordBatch], now=(feature.copy(), threshold.copy(), split.copy(), salt, limit, is_open)) -> Iterator[pa.RecordBatch]:
                feature, threshold, split, salt, limit, is_open = now
                for b in batches:
                    x = Rows(b.column("at"), b.column("v"), width)
                    row, y, w = (b.column(c).to_numpy() for c in ("row", "y", "w"))
                    for t in range(trees):
                        node, own = x.node(feature[t], threshold[t], split[t]), drawn(row, w, t)
                        on = (is_open[t][node] & (own > 0))[x.row]
                        at = np.flatnonzero(on & (x.value != 0))
                        n, f = node[x.row[at]], x.feature[at]
                        some = mixed(f.astype(np.uint64) + salt[t][n]) <= limit[t][n]
                        at, n, f = at[some], n[some], f[some]
                        r = x.row[at]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), *map(pa.array, (n.astype(np.int32), f.astype(np.int32), x.value[at], y[r], own[r]))], ["tree", "node", "feature", "value", "y", "w"])

            def best(batches: Iterator[pa.RecordBatch], totals=totals) -> Iterator[pa.RecordBatch]:
                # all of a part at once: sums of drawn features, not rows
                if parts := [b for b in batches if b.num_rows]:
                    found = _best(pa.Table.from_batches(parts), totals, classes, kind)
                    if found:
                        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64()))
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], ["tree", "node", "feature", "threshold", "gain", "left"])

            stats = rows.mapInArrow(counted, "tree int, node int, feature int, value double, y int, w double").groupBy("tree", "node", "feature", "value", "y").agg(F.sum("w").alias("w"))
            parts = stats.repartition("tree", "node", "feature").mapInArrow(best, "tree int, node int, feature int, threshold double, gain double, left array<double>")
            top: dict = {}
            for r in parts.collect():  # one row for each part and open node
                k = (r.tree, r.node)
                if k not in top or (-r.gain, r.feature) < (-top[k].gain, top[k].feature):
                    top[k] = r
            open_nodes = []
            for (t, n), r in top.items():
                feature[t, n], threshold[t, n], split[t, n] = r.feature, r.threshold, True
                shares[t, 2 * n], shares[t, 2 * n + 1] = r.left, np.maximum(shares[t, n] - np.array(r.left), 0)
                open_nodes += [(t, k) for k in (2 * n, 2 * n + 1) if (shares[t, k] > 1e-9).sum() > 1]
        totals = shares.sum(2, keepdims=True)
        model = ForestModel(feature, threshold, split, shares / np.where(totals > 0, totals, 1), width)
        return self._copyValues(model)


class ForestModel(Model, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol):
    def __init__(self, feature: np.ndarray | None = None, threshold: np.ndarray | None = None, split: np.ndarray | None = None, shares: np.ndarray | None = None, width: int = 0) -> None:
        super().__init__()
        self.feature_, self.threshold_, self.split_, self.shares_, self.width_ = feature, threshold, split, shares, width

    def _transform(self, df: DataFrame) -> DataFrame:
        feature, threshold, split, shares, width = self.feature_, self.threshold_, self.split_, self.shares_, self.width_

        @F.arrow_udf("array<double>")
        def votes(at: pa.Array, v: pa.Array) -> pa.Array:
            x = Rows(at, v, width)
            p = sum(shares[t][x.node(feature[t], threshold[t], split[t])] for t in range(len(feature))) / len(feature)
            return pa.ListArray.from_arrays(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32), p.ravel())

        p = F.col("_votes")
        best = (F.array_position(p, F.array_max(p)) - 1).cast("double")
        return df.withColumn("_votes", votes(*sparse_parts(F.col(self.getFeaturesCol())))).withColumn(self.getProbabilityCol(), array_to_vector(p)).withColumn(self.getPredictionCol(), best).drop("_votes")

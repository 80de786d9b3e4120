"""A forest of the engine's kind, each tree grown in one task from all training rows, a byte per input.

The engine grows all trees level by level: a level is a pass in which every row looks up its node in every tree, though in
most trees its node has ended. Here a task holds all rows in bins and grows its trees one after the other; a row whose node
has ended is not touched again. As in the engine, each input is cut into bins of about equal weight, rows are drawn by
Poisson numbers, a node tries a random subset of the inputs, the split is the one with the highest gain in weighted Gini
impurity, and leaves of one parent that predict the same class are merged. Only the random draws are others: they hang on
the seed, the tree and the content of the rows, not on how rows are dealt to tasks.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HELD_BYTES = 200_000_000  # of the rows in bins, that a task may hold
POINTS = 2048  # values that stand for an input in a part of the rows
SLICE = 1 << 15  # rows that are counted at a time
NODES = 2048  # nodes whose splits are weighed at a time

_POINTS = "input INT, value DOUBLE, weight DOUBLE"
_BLOCK = "bins BINARY, label BINARY, place BINARY"
_NODE = (
    "tree INT, node INT, prediction DOUBLE, impurity DOUBLE, negative DOUBLE, positive DOUBLE, rows BIGINT, gain DOUBLE, "
    "left INT, right INT, feature INT, threshold DOUBLE"
)


@dataclass(frozen=True)
class Rules:
    """What all trees of a forest share."""

    trees: int
    depth: int
    bins: int
    leaf_rows: int
    split_rows: int
    weights: tuple[float, float]  # of a row of class 0 and of class 1
    seed: int


@dataclass
class Tree:
    """Nodes from the root on, children behind their parents; left, right and feature are -1 at a leaf."""

    counts: np.ndarray  # drawn rows of either class
    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray
    split: np.ndarray  # the last bin that goes left
    gain: np.ndarray


def fits(rows: int, inputs: int, bins: int) -> bool:
    """Whether a task may hold that many rows."""
    return rows * inputs <= HELD_BYTES and bins <= 256


def _ready(spark: SparkSession) -> None:
    """Let Python workers import this package from where it lies, as `--py-files` would; harmless if it is shipped."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def grow_forest(rows: DataFrame, inputs: list[Column], rules: Rules, tasks: int) -> DataFrame:
    """The nodes of all trees, from `rows` with a `label` of 0 or 1 and its `weight`; `inputs` are doubles.

    `rows` is read twice. The rows in bins are sent to each of `tasks` tasks.
    """
    _ready(rows.sparkSession)
    width = len(inputs)
    vectors = rows.select(F.array(*inputs).alias("x"), F.col("label").cast("byte").alias("label"), "weight")
    points = vectors.mapInArrow(lambda batches: _points(batches, width), _POINTS)
    found = points.groupBy("input").applyInPandas(lambda part: _cut_points(part, rules.bins), "input INT, cuts ARRAY<DOUBLE>")
    known = {r.input: r.cuts for r in found.collect()}  # a row per input
    cuts = [np.array(known[i]) for i in range(width)]
    placed = vectors.select("x", "label", F.xxhash64("x", "label").alias("place"))
    blocks = placed.mapInArrow(lambda batches: _blocks(batches, cuts), _BLOCK)
    dealt = blocks.withColumn("task", F.explode(F.array(*[F.lit(i) for i in range(tasks)]))).repartitionById(tasks, "task")
    return dealt.mapInArrow(lambda batches: _trees(batches, cuts, rules, tasks), _NODE)


# --- bins ----------------------------------------------------------------------------------------------------------


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    values = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    if np.isnan(values).any():
        raise ValueError("an input of the forest is not a number")
    return values


def _summed(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    different, at = np.unique(values, return_inverse=True)
    return different, np.bincount(at, weights, len(different))


def _fewer(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most POINTS + 1 of the ordered values, each with the weight of those below it; no rank moves by over 1 / POINTS."""
    if len(values) <= POINTS:
        return values, weights
    upto = weights.cumsum()
    last = np.flatnonzero(np.diff(np.floor((upto - weights) / upto[-1] * POINTS), append=np.inf))
    return values[last], np.diff(upto[last], prepend=0.0)


def _points(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Weighted values that stand for each input in a part of the rows."""
    held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(width)]
    for batch in batches:
        if not batch.num_rows:
            continue
        values, weights = _matrix(batch, width), batch.column("weight").to_numpy()
        for i in range(width):
            held[i].append(_summed(values[:, i], weights))
            if sum(len(v) for v, _ in held[i]) > 32 * POINTS:
                held[i] = [_fewer(*_joined(held[i]))]
    for i in range(width):
        if held[i]:
            values, weights = _fewer(*_joined(held[i]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(values), i, np.int32)), pa.array(values), pa.array(weights)], ["input", "value", "weight"]
            )


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return _summed(np.concatenate([v for v, _ in parts]), np.concatenate([w for _, w in parts]))


def _cut_points(part: pd.DataFrame, bins: int) -> pd.DataFrame:
    """Where an input is cut into at most `bins` bins, the engine's way: between all values, or after equal weights."""
    part = part.sort_values(["value", "weight"])  # sums in one order, whichever part came first
    values, weights = _summed(part["value"].to_numpy(), part["weight"].to_numpy())
    middle = values[:-1] / 2 + values[1:] / 2
    if len(values) > bins:
        upto, stride, kept = weights.cumsum(), weights.sum() / bins, []
        for i in range(len(middle)):
            target = stride * (len(kept) + 1)
            if abs(upto[i] - target) < abs(upto[i + 1] - target):
                kept.append(middle[i])
        middle = np.array(kept[: bins - 1])
    return pd.DataFrame({"input": [part["input"].iloc[0]], "cuts": [middle.tolist()]})


def _blocks(batches: Iterator[pa.RecordBatch], cuts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A row per batch: bins of all inputs row by row, labels, and the numbers that give the rows their order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = _matrix(batch, len(cuts))
        bins = np.empty(values.shape, np.uint8)
        for i, cut in enumerate(cuts):
            bins[:, i] = np.searchsorted(cut, values[:, i])
        cells = [bins.tobytes(), batch.column("label").to_numpy().tobytes(), batch.column("place").to_numpy().tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], ["bins", "label", "place"])


# --- trees ---------------------------------------------------------------------------------------------------------


def _trees(batches: Iterator[pa.RecordBatch], cuts: list[np.ndarray], rules: Rules, tasks: int) -> Iterator[pa.RecordBatch]:
    """The trees of one task: those whose number leaves its own when divided by `tasks`."""
    held: dict[str, list[np.ndarray]] = {"bins": [], "label": [], "place": []}
    task = None
    for batch in batches:
        for i in range(batch.num_rows):
            task = batch.column("task")[i].as_py()
            for name, kind in (("bins", np.uint8), ("label", np.int8), ("place", np.int64)):
                held[name].append(np.frombuffer(batch.column(name)[i].as_buffer(), kind))
    if task is None:
        return
    place, label = np.concatenate(held.pop("place")), np.concatenate(held.pop("label"))
    bins = np.concatenate(held.pop("bins")).reshape(len(label), len(cuts))
    order = np.argsort(place, kind="stable")
    for number in range(task, rules.trees, tasks):
        yield _node_rows(number, _finished(grow(bins, label, order, number, rules), rules), cuts, rules)


def _gini(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Impurity of the weights of two classes; 0 where there are none."""
    total = low + high
    some = total > 0
    total = np.where(some, total, 1.0)
    return np.where(some, 1.0 - (low / total) ** 2 - (high / total) ** 2, 0.0)


def _counted(bins: np.ndarray, rows: np.ndarray, times: np.ndarray, positive: np.ndarray, node: np.ndarray, tried: np.ndarray, most: int) -> np.ndarray:
    """Drawn rows by class, node, input tried and bin."""
    nodes, subset = tried.shape
    width, flat, inputs = bins.shape[1], bins.reshape(-1), np.ascontiguousarray(tried.T)
    found = np.zeros((2, subset, nodes * most))
    for start in range(0, len(rows), SLICE):
        part = slice(start, start + SLICE)
        at, weight, ones = node[part], times[part], np.flatnonzero(positive[part])
        first, base, weight_ones = rows[part] * width, at * most, weight[ones]
        for i in range(subset):
            key = flat.take(inputs[i].take(at) + first) + base
            found[0, i] += np.bincount(key, weight, nodes * most)
            if len(ones):
                found[1, i] += np.bincount(key.take(ones), weight_ones, nodes * most)
    found[0] -= found[1]
    return found.reshape(2, subset, nodes, most).swapaxes(1, 2)


def _best(found: np.ndarray, rules: Rules) -> tuple[np.ndarray, ...]:
    """Of each node: the place of its best split among the inputs tried, the last bin to the left, the gain, rows left and right."""
    w0, w1 = rules.weights
    left = found.cumsum(axis=3)
    total, left = left[..., -1:], left[..., :-1]
    right = total - left
    whole = total[0] * w0 + total[1] * w1
    (l0, l1), (r0, r1) = (left[0] * w0, left[1] * w1), (right[0] * w0, right[1] * w1)
    gain = _gini(total[0] * w0, total[1] * w1) - (l0 + l1) / whole * _gini(l0, l1) - (r0 + r1) / whole * _gini(r0, r1)
    enough = (left.sum(axis=0) >= rules.leaf_rows) & (right.sum(axis=0) >= rules.leaf_rows)
    gain = np.where(enough, gain, -1.0).reshape(len(gain), -1)
    best, each = gain.argmax(axis=1), np.arange(len(gain))
    place, split = np.divmod(best, rules.bins - 1)
    return place, split, gain[each, best], left[:, each, place, split], right[:, each, place, split]


def grow(bins: np.ndarray, label: np.ndarray, order: np.ndarray, number: int, rules: Rules) -> Tree:
    """One tree on a Poisson draw of the rows of `bins` (a byte per input); draws are dealt to the rows in `order`."""
    random = np.random.default_rng([rules.seed, number])
    width = bins.shape[1]
    subset = int(np.ceil(np.sqrt(width)))
    drawn = np.empty(len(bins), np.uint8)
    drawn[order] = random.poisson(1.0, len(bins))
    rows = np.flatnonzero(drawn)
    times, positive, node = drawn[rows].astype(np.float64), label[rows] == 1, np.zeros(len(rows), np.int64)
    ones = times[positive].sum()
    counts = [np.array([[times.sum() - ones], [ones]])]  # by level: drawn rows of either class of each node
    levels: list[tuple[np.ndarray, ...]] = []  # by level: nodes that are split, first child, feature, split, gain
    active = np.flatnonzero((counts[0] > 0).all(axis=0))
    while len(active) and len(levels) < rules.depth:
        tried = np.argsort(random.random((len(active), width)), axis=1)[:, :subset]
        parts = []
        for low in range(0, len(active), NODES):
            some = tried[low : low + NODES]
            inside = slice(None) if len(active) <= NODES else np.flatnonzero((node >= low) & (node < low + NODES))
            parts.append(_best(_counted(bins, rows[inside], times[inside], positive[inside], node[inside] - low, some, rules.bins), rules))
        place, split, gain, left, right = (np.concatenate(p, axis=-1) for p in zip(*parts))
        feature, splits = tried[np.arange(len(active)), place], gain > 0
        first = np.where(splits, 2 * (splits.cumsum() - 1), -1)
        levels.append((active[splits], first[splits], feature[splits], split[splits], gain[splits]))
        counts.append(np.stack([left[:, splits], right[:, splits]], axis=2).reshape(2, -1))
        goes_on = (counts[-1] > 0).all(axis=0)
        active = np.flatnonzero(goes_on)
        after = np.full(len(goes_on) + 1, -1)  # the last is for rows of nodes that are not split
        after[:-1][goes_on] = np.arange(len(active))
        child = np.where(splits[node], first[node] + (bins[rows, feature[node]] > split[node]), -1)
        node = after[child]
        kept = node >= 0
        rows, times, positive, node = rows[kept], times[kept], positive[kept], node[kept]
    return _numbered(counts, levels)


def _numbered(counts: list[np.ndarray], levels: list[tuple[np.ndarray, ...]]) -> Tree:
    """Nodes numbered level by level."""
    starts = np.cumsum([0, *[c.shape[1] for c in counts]])
    tree = Tree(np.concatenate(counts, axis=1), *(np.full(starts[-1], -1) for _ in range(4)), np.full(starts[-1], -1.0))
    for level, (nodes, first, feature, split, gain) in enumerate(levels):
        at = starts[level] + nodes
        tree.left[at], tree.right[at] = starts[level + 1] + first, starts[level + 1] + first + 1
        tree.feature[at], tree.split[at], tree.gain[at] = feature, split, gain
    return tree


def _classes(tree: Tree, rules: Rules) -> np.ndarray:
    return tree.counts[1] * rules.weights[1] > tree.counts[0] * rules.weights[0]


def _finished(tree: Tree, rules: Rules) -> Tree:
    """Leaves of one parent that predict the same are merged, then splits of too few rows undone; what is cut off goes."""
    left, right, of = tree.left.tolist(), tree.right.tolist(), _classes(tree, rules).tolist()
    for i in range(len(left) - 1, -1, -1):
        a, b = left[i], right[i]
        if a >= 0 and left[a] < 0 and left[b] < 0 and of[a] == of[b]:
            left[i] = right[i] = -1
    few = (tree.counts.sum(axis=0) < rules.split_rows).tolist()
    kept = np.zeros(len(left), bool)
    kept[0] = True
    for i in range(len(left)):
        if few[i]:
            left[i] = right[i] = -1
        if kept[i] and left[i] >= 0:
            kept[left[i]] = kept[right[i]] = True
    new = np.append(kept.cumsum() - 1, -1)
    left, right = new[left][kept], new[right][kept]
    leaf = left < 0
    feature, split, gain = (np.where(leaf, -1, a[kept]) for a in (tree.feature, tree.split, tree.gain))
    return Tree(tree.counts[:, kept], left, right, feature, split, gain)


def _node_rows(number: int, tree: Tree, cuts: list[np.ndarray], rules: Rules) -> pa.RecordBatch:
    low, high = (tree.counts[c] * rules.weights[c] for c in (0, 1))
    thresholds = np.full((len(cuts), rules.bins), np.nan)
    for i, cut in enumerate(cuts):
        thresholds[i, : len(cut)] = cut
    columns = {
        "tree": np.full(len(low), number, np.int32), "node": np.arange(len(low), dtype=np.int32),
        "prediction": _classes(tree, rules).astype(np.float64), "impurity": _gini(low, high),
        "negative": low, "positive": high, "rows": tree.counts.sum(axis=0).astype(np.int64), "gain": tree.gain.astype(np.float64),
        "left": tree.left.astype(np.int32), "right": tree.right.astype(np.int32), "feature": tree.feature.astype(np.int32),
        "threshold": thresholds[tree.feature, tree.split],
    }
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], list(columns))

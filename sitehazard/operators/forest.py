"""Random forests for regression over many rows: each task grows some of the trees over all rows.

The trees are those of Spark's own forest: up to 32 bins a feature, a Poisson(1) sample of the rows for each
tree, every feature tried at every node, the split with the most variance gained. Spark's forest adds each row
to sums of all trees' nodes at once, which fit no cache, and sends every task's sums of a level. Here rows
are binned once, a byte a feature. A task keeps them in its own temporary files and passes over them once a level
of a tree, in blocks, so that only a block and one tree's sums are in memory. Sums of the larger of two
children are those of the parent less those of the smaller. Nothing but the finished nodes is sent.

The result is a model of Spark's. Its predictions are made tree by tree for a batch of rows, so that one tree's
nodes stay in the cache.
"""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sitehazard.session import importable, shared_path

# As in Spark's forest: bins a feature, and the rows that places for splits are chosen from.
BINS = 32
SPLIT_ROWS = 10_000
# Rows of a block: a feature's bytes and the block's sums stay in a core's cache.
BLOCK = 1 << 16
# A gain below this share of the root's variance is rounding.
NOISE = 1e-10

NODE = pa.struct(
    [
        ("id", pa.int32()),
        ("prediction", pa.float64()),
        ("impurity", pa.float64()),
        ("impurityStats", pa.list_(pa.float64())),
        ("rawCount", pa.int64()),
        ("gain", pa.float64()),
        ("leftChild", pa.int32()),
        ("rightChild", pa.int32()),
        ("split", pa.struct([
            ("featureIndex", pa.int32()),
            ("leftCategoriesOrThreshold", pa.list_(pa.float64())),
            ("numCategories", pa.int32()),
        ])),
    ]
)
NODES = """treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>,
rawCount bigint, gain double, leftChild int, rightChild int,
split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>"""


def split_points(values: np.ndarray, most: int) -> np.ndarray:
    """Thresholds between values: all midpoints if there are at most so many, else at even counts."""
    held, counts = np.unique(values, return_counts=True)
    middles = (held[:-1] + held[1:]) / 2
    if len(middles) <= most:
        return middles
    stride = len(values) / (most + 1)
    chosen, aim = [], stride
    below = np.cumsum(counts)
    for i in range(1, len(held)):
        if abs(below[i - 1] - aim) < abs(below[i] - aim):
            chosen.append(middles[i - 1])
            aim += stride
    return np.array(chosen)


def _thresholds(rows: DataFrame, inputs: list[str], number: int) -> list[np.ndarray]:
    """Each feature's thresholds, from as many rows as Spark's forest takes for them.

    The rows are told by their hash, so a re-run takes the same.
    """
    chosen = rows.select(*inputs)
    if number > SPLIT_ROWS:
        dealt = F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 40))
        chosen = rows.where(dealt < int(SPLIT_ROWS / number * (1 << 40))).select(*inputs)
    held = chosen.toArrow()
    most = min(BINS, max(number, 2)) - 1
    return [split_points(held[name].to_numpy(), most) for name in inputs]


def _bin(thresholds: list[np.ndarray], inputs: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bins = np.empty((batch.num_rows, len(inputs)), np.uint8)
        for i, name in enumerate(inputs):
            bins[:, i] = np.searchsorted(thresholds[i], batch.column(name).to_numpy(zero_copy_only=False))
        packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(inputs)), len(bins), [None, pa.py_buffer(bins.tobytes())])
        kept = [batch.column(name) for name in ("location_id", "timestamp", "label")]
        yield pa.RecordBatch.from_arrays([*kept, packed.cast(pa.binary())], ["location_id", "timestamp", "label", "bins"])


def binned(rows: DataFrame, inputs: list[str], label: str, thresholds: list[np.ndarray]) -> DataFrame:
    """Every row's key and label, and one byte a feature: how many thresholds lie below its value."""
    types = dict(rows.dtypes)
    schema = f"location_id {types['location_id']}, timestamp {types['timestamp']}, label double, bins binary"
    source = rows.select("location_id", "timestamp", F.col(label).cast("double").alias("label"), *inputs)
    return source.mapInArrow(partial(_bin, thresholds, inputs), schema)


class _Column:
    """An array of each block, in one file of a task's own folder; it may be replaced by one no longer."""

    def __init__(self, path: str, kind: type):
        self.file = open(path, "w+b", buffering=0)  # noqa: SIM115: closed with its folder
        self.kind = np.dtype(kind)
        self.places: list[tuple[int, int]] = []

    def add(self, values: np.ndarray) -> None:
        end = self.file.seek(0, os.SEEK_END)
        self.places.append((end, values.size))
        self.file.write(np.ascontiguousarray(values, self.kind))

    def replace(self, number: int, values: np.ndarray) -> None:
        place, _ = self.places[number]
        self.places[number] = place, values.size
        self.file.seek(place)
        self.file.write(np.ascontiguousarray(values, self.kind))

    def __getitem__(self, number: int) -> np.ndarray:
        place, size = self.places[number]
        values = np.empty(size, self.kind)
        self.file.seek(place)
        if self.file.readinto(values) != values.nbytes:
            raise OSError(f"{self.file.name} is cut")
        return values

    def clear(self) -> None:
        self.file.truncate(0)
        self.places = []


class _Blocks:
    """All rows as files of a task's own folder, and the rows that a tree has drawn, with their nodes."""

    def __init__(self, folder: str, features: int, batches: Iterator[pa.RecordBatch], mean: float):
        self.features = features
        self.bins = _Column(f"{folder}/bins", np.uint8)
        self.label = _Column(f"{folder}/label", np.float64)
        self.at = _Column(f"{folder}/at", np.uint32)
        self.weight = _Column(f"{folder}/weight", np.uint8)
        self.node = _Column(f"{folder}/node", np.uint32)
        bins, labels, held = [], [], 0
        for batch in batches:
            packed = batch.column("bins").cast(pa.binary(features))
            start = packed.offset * features
            flat = np.frombuffer(packed.buffers()[1], np.uint8)[start : start + len(packed) * features]
            bins.append(flat.reshape(-1, features))
            labels.append(batch.column("label").to_numpy() - mean)
            held += len(packed)
            if held >= BLOCK:
                self._add(bins, labels)
                bins, labels, held = [], [], 0
        if held:
            self._add(bins, labels)

    def _add(self, bins: list[np.ndarray], labels: list[np.ndarray]) -> None:
        self.bins.add(np.concatenate(bins).T)
        self.label.add(np.concatenate(labels))

    def __len__(self) -> int:
        return len(self.label.places)

    def close(self) -> None:
        for column in (self.bins, self.label, self.at, self.weight, self.node):
            column.file.close()

    def draw(self, seed: int, tree: int, drawn: bool) -> None:
        """Give each row a Poisson(1) weight, or 1, and keep those above 0, all at the root."""
        for column in (self.at, self.weight, self.node):
            column.clear()
        for number, (_, size) in enumerate(self.label.places):
            weight = np.random.default_rng([seed, tree, number]).poisson(1.0, size) if drawn else np.ones(size, np.int64)
            at = np.flatnonzero(weight)
            self.at.add(at)
            self.weight.add(weight[at])
            self.node.add(np.zeros(len(at)))


def _sums(blocks: _Blocks, moves: tuple | None, nodes: int, slots: np.ndarray | None):
    """One pass over a tree's rows: each node's weight, sum and sum of squares, and those nodes' by feature and
    bin that have a slot.

    With ``moves`` (feature, bin, left child or -1 for each node of the level above) rows go to their children
    first; those whose node isn't split are left out from here on.
    """
    totals = np.zeros((3, nodes))
    by_bin = None
    width = 0 if slots is None else (int(slots.max()) + 1) * BINS
    if width:
        by_bin = np.zeros((2, blocks.features, width))
    for number in range(len(blocks)):
        bins, label = blocks.bins[number], blocks.label[number]
        at, node = blocks.at[number].astype(np.intp), blocks.node[number].astype(np.intp)
        weight = blocks.weight[number].astype(np.float64)
        if moves is not None:
            feature, cut, child = moves
            first = child.take(node)
            if first.min(initial=0) < 0:
                kept = np.flatnonzero(first >= 0)
                at, weight, node, first = at.take(kept), weight.take(kept), node.take(kept), first.take(kept)
                blocks.at.replace(number, at)
                blocks.weight.replace(number, weight)
            spot = feature.take(node) * len(label) + at
            node = first + (bins.take(spot) > cut.take(node))
            blocks.node.replace(number, node)
        value = label.take(at)
        square = value * value * weight
        value *= weight
        for total, share in zip(totals, (weight, value, square), strict=True):
            total += np.bincount(node, share, nodes)
        if by_bin is None:
            continue
        first = slots.take(node)
        if first.min(initial=0) < 0:
            counted = np.flatnonzero(first >= 0)
            at, weight, value, first = at.take(counted), weight.take(counted), value.take(counted), first.take(counted)
        first *= BINS
        for column, weights, values in zip(bins.reshape(blocks.features, -1), *by_bin, strict=True):
            spot = first + column.take(at)
            weights += np.bincount(spot, weight, width)
            values += np.bincount(spot, value, width)
    return totals, by_bin if by_bin is None else by_bin.reshape(2, blocks.features, -1, BINS).swapaxes(1, 2)


def _best(by_bin: np.ndarray, lengths: np.ndarray):
    """For each node the gain in variance, feature, bin and left weight of its best split; of equal ones the first."""
    weight, total = np.cumsum(by_bin, axis=-1)
    left, left_sum = weight[..., :-1], total[..., :-1]
    right, right_sum = weight[..., -1:] - left, total[..., -1:] - left_sum
    able = (left >= 1) & (right >= 1) & (np.arange(BINS - 1) < lengths[:, None])
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left_sum**2 / left + right_sum**2 / right - total[..., -1:] ** 2 / weight[..., -1:]
        gain = np.where(able, gain / weight[..., -1:], -1.0).reshape(len(weight), -1)
    best = gain.argmax(axis=1)
    every = np.arange(len(gain))
    return gain[every, best], best // (BINS - 1), best % (BINS - 1), left.reshape(gain.shape)[every, best]


def _tree(blocks: _Blocks, thresholds: list[np.ndarray], depth: int, mean: float) -> list[dict]:
    """One tree's nodes in the order of a walk from the root, left before right."""
    lengths = np.array([len(t) for t in thresholds])
    nodes: list[dict] = [{}]  # as they are found, level by level
    level, moves, slots, held = [0], None, np.zeros(1, np.int64), None
    for down in range(depth + 1):
        totals, sums = _sums(blocks, moves, len(level), slots if down < depth else None)
        for k, (weight, total, squares) in zip(level, totals.T.tolist(), strict=True):
            middle = total / weight if weight else 0.0
            spread = max(squares / weight - middle**2, 0.0) if weight else 0.0
            plain = [weight, total + mean * weight, squares + 2 * mean * total + mean**2 * weight]
            nodes[k].update(prediction=middle + mean, impurity=spread, impurityStats=plain, rawCount=round(weight))
        if down == depth or sums is None:
            break
        if held is None:
            by_bin = sums
        else:  # two children in turn: the one with a slot was counted, the other is what is left of the parent
            by_bin = np.empty((2, len(level), *sums.shape[2:]))
            counted = np.flatnonzero(slots >= 0)
            by_bin[:, counted] = sums
            by_bin[:, counted ^ 1] = held - sums
            by_bin[1][by_bin[0] == 0] = 0.0
        gain, feature, cut, left = _best(by_bin, lengths)
        split = gain > NOISE * nodes[0]["impurity"]
        child = np.where(split, 2 * (np.cumsum(split) - 1), -1)
        for i in np.flatnonzero(split):
            nodes[level[i]].update(gain=float(gain[i]), feature=int(feature[i]), cut=float(thresholds[feature[i]][cut[i]]), left=len(nodes))
            nodes += [{}, {}]
        level = [nodes[k]["left"] + side for k, is_split in zip(level, split, strict=True) if is_split for side in (0, 1)]
        if not level:
            break
        moves, held = (feature, cut.astype(np.uint8), child), by_bin[:, split]
        smaller = (left > by_bin[0, :, 0].sum(axis=-1) - left)[split].astype(np.int64)  # 0: the left child
        slots = np.full(len(level), -1)
        slots[2 * np.arange(len(smaller)) + smaller] = np.arange(len(smaller))
    walk, order = [0], []
    while walk:
        order.append(k := walk.pop())
        if "left" in nodes[k]:
            walk += [nodes[k]["left"] + 1, nodes[k]["left"]]
    place = {k: i for i, k in enumerate(order)}
    result = []
    for k in order:
        node = nodes[k]
        inner = "left" in node
        result.append({
            "id": place[k], "gain": node["gain"] if inner else -1.0,
            **{name: node[name] for name in ("prediction", "impurity", "impurityStats", "rawCount")},
            "leftChild": place[node["left"]] if inner else -1,
            "rightChild": place[node["left"] + 1] if inner else -1,
            "split": {"featureIndex": node["feature"] if inner else -1,
                      "leftCategoriesOrThreshold": [node["cut"]] if inner else [], "numCategories": -1},
        })
    return result


def _grow(
    thresholds: list[np.ndarray], trees: int, tasks: int, depth: int, seed: int, mean: float, drawn: bool,
    batches: Iterator[pa.RecordBatch],
) -> Iterator[pa.RecordBatch]:
    """The nodes of one task's trees: its own number and each that is so many tasks further."""
    own = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
    with tempfile.TemporaryDirectory(prefix="forest-", dir=own) as folder:
        first = next(batches, None)
        if first is None:
            return
        task = first.column("task")[0].as_py()

        def every():
            yield first
            yield from batches

        blocks = _Blocks(folder, len(thresholds), every(), mean)
        for tree in range(task, trees, tasks):
            blocks.draw(seed, tree, drawn)
            found = _tree(blocks, thresholds, depth, mean)
            yield pa.RecordBatch.from_arrays(
                [pa.array([tree] * len(found), pa.int32()), pa.array(found, NODE)], ["treeID", "nodeData"]
            )
        blocks.close()


def grown(rows: DataFrame, thresholds: list[np.ndarray], trees: int, depth: int, seed: int, mean: float, drawn: bool = True) -> DataFrame:
    """All nodes of a forest over binned rows, which are files: every task reads all of them.

    Without ``drawn`` each tree takes all rows once.
    """
    spark = importable(rows.sparkSession)
    tasks = min(trees, spark.sparkContext.defaultParallelism)
    read = rows.select("label", "bins").coalesce(1).hint("shuffle_replicate_nl")  # rows stream by, none is held
    numbers = spark.range(0, tasks, 1, tasks).withColumnRenamed("id", "task")
    dealt = read.crossJoin(numbers)
    return dealt.mapInArrow(partial(_grow, thresholds, trees, tasks, depth, seed, mean, drawn), NODES)


def _describe(version: str, kind: str, uid: str, forest: RandomForestRegressor, left_out: tuple[str, ...], **more) -> str:
    """A model's description as Spark's writers store it."""

    def named(params) -> dict:
        return {p.name: value for p, value in params.items() if p.name not in left_out}

    return json.dumps({
        "class": f"org.apache.spark.ml.regression.{kind}", "timestamp": 0, "sparkVersion": version, "uid": uid,
        "paramMap": named(forest._paramMap), "defaultParamMap": named(forest._defaultParamMap), **more,
    })


def fit(
    rows: DataFrame, inputs: list[str], label: str, number: int, mean: float, work: str, settled, **settings
) -> PipelineModel:
    """A forest over all rows, as a pipeline model of Spark's that reads the named inputs.

    ``number`` is about how many rows there are, ``mean`` the label's mean, ``settled`` what lays out the binned
    rows before they are written under ``work``. Only "all" is known as feature subset strategy.
    """
    assert settings["featureSubsetStrategy"] == "all"
    spark = importable(rows.sparkSession)
    forest = RandomForestRegressor(featuresCol="inputs", labelCol=label, predictionCol="predicted", **settings)
    thresholds = _thresholds(rows, inputs, number)
    settled(binned(rows, inputs, label, thresholds)).write.mode("overwrite").parquet(f"{work}/binned-{label}")
    kept = spark.read.parquet(f"{work}/binned-{label}")
    path, trees = f"{work}/forest-{label}", settings["numTrees"]
    nodes = grown(kept, thresholds, trees, settings["maxDepth"], settings["seed"], mean, settings.get("bootstrap", True))
    nodes.write.mode("overwrite").parquet(f"{path}/data")
    lone = ("numTrees", "featureSubsetStrategy", "bootstrap", "subsamplingRate")
    about = [
        (k, _describe(spark.version, "DecisionTreeRegressionModel", f"dtr_{uuid4().hex[:12]}", forest, lone), 1.0)
        for k in range(trees)
    ]
    spark.createDataFrame(about, "_1 int, _2 string, _3 double").coalesce(1).write.mode("overwrite").parquet(f"{path}/treesMetadata")
    whole = _describe(spark.version, "RandomForestRegressionModel", forest.uid, forest, (), numFeatures=len(inputs), numTrees=trees)
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    return PipelineModel([VectorAssembler(inputCols=inputs, outputCol="inputs"), RandomForestRegressionModel.load(path)])


@dataclass(frozen=True)
class Trees:
    """All nodes of a forest: row x goes from node k to ``below[k] + (x[feature[k]] > cut[k])``, at a leaf to itself."""

    feature: np.ndarray
    cut: np.ndarray
    below: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depths: list[int]

    def mean(self, rows: np.ndarray) -> np.ndarray:
        """The trees' mean for each row of a row-major array, added up in their order."""
        flat, first = rows.ravel(), np.arange(len(rows)) * rows.shape[1]
        total = np.zeros(len(rows))
        ends = [*self.roots[1:], len(self.value)]
        for root, end, depth in zip(self.roots, ends, self.depths, strict=True):
            feature, below = self.feature[root:end].astype(np.intp), self.below[root:end].astype(np.intp)
            cut, node = self.cut[root:end], np.zeros(len(rows), np.intp)
            for _ in range(depth):
                spot = feature.take(node)
                spot += first
                node = below.take(node) + (flat.take(spot) > cut.take(node))
            total += self.value[root:end].take(node)
        return total / len(self.roots)


def trees_of(spark: SparkSession, model: RandomForestRegressionModel) -> Trees:
    """The model's nodes, out of its files as Spark's writer stores them. They are read once a model."""
    if (known := getattr(model, "_trees", None)) is None:
        path = shared_path(spark, "trees")
        model.write().save(path)
        known = model._trees = _stored_trees(spark, path)
    return known


def _stored_trees(spark: SparkSession, path: str) -> Trees:
    """A tree's nodes are numbered anew from 0, both children of a node side by side."""
    split = "nodeData.split"
    held = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.leftChild", "nodeData.rightChild",
        f"{split}.featureIndex", f"{split}.numCategories", F.get(f"{split}.leftCategoriesOrThreshold", F.lit(0)).alias("cut"),
    ).orderBy("treeID", "id").toArrow()
    number, left, right, feature, value, kinds = (
        held[name].to_numpy() for name in ("treeID", "leftChild", "rightChild", "featureIndex", "prediction", "numCategories")
    )
    if (kinds >= 0).any():
        raise ValueError("splits on categories are not known")
    cut = held["cut"].fill_null(np.inf).to_numpy()
    roots = np.flatnonzero(np.diff(number, prepend=-1))
    order, below, depths = [], np.empty(len(held), np.int32), []
    for root in roots:
        level, placed, depth = np.array([root]), 1, -1
        while len(level):
            order.append(level)
            depth += 1
            inner = left[level] >= 0
            place = np.arange(placed - len(level), placed)
            below[root + place] = np.where(inner, placed + 2 * (np.cumsum(inner) - 1), place)
            level = (root + np.stack([left[level[inner]], right[level[inner]]], axis=1)).ravel()
            placed += len(level)
        depths.append(depth)
    order = np.concatenate(order)
    return Trees(np.maximum(feature[order], 0).astype(np.int16), cut[order], below, value[order], roots, depths)


def predicted(spark: SparkSession, model: PipelineModel, inputs: dict[str, Column]) -> Column:
    """The model's prediction from the given inputs, which must be numbers."""
    trees = trees_of(importable(spark), model.stages[-1])

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(trees.mean(np.stack([c.to_numpy(zero_copy_only=False) for c in batch], axis=1)))

    return F.arrow_udf(run, "double")(*[inputs[name] for name in model.stages[0].getInputCols()])

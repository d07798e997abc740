"""Boosted trees fitted in one gang-scheduled stage: all rows, spread over tasks that run side by side.

The library's boosting starts a job for every level of every tree, so a fit of 500 trees waits for some 3,000 jobs however
few the rows. Here a fit is one stage in Spark's barrier mode. Each task keeps its share of the rows binned (one byte a value),
and the tasks add up their histograms, of a size that the settings bound, in the folder that driver and executors share: the
barrier's own allGather answers once a second. Every task then takes the same splits, and the patience ends the fit itself.

Trees, targets, weights and losses are those of ``pyspark.ml``'s gradient boosting (first tree of weight 1, then the negative
gradient at the step size; variance gain; features drawn by node, rows by tree), and so is the model that comes out.
"""

from __future__ import annotations

import json
import math
import os
import sys
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext, cloudpickle
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotline.session import delete_folder, discard, ensure_checkpoint_dir, scratch_path, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need not have this package

_ROWS = 65_536  # a task of a gang has at least so many rows, if there are as many
_POINTS = 1_024  # values of a feature, at equal shares of a task's rows, that its thresholds are chosen from
_WAIT = 900.0  # seconds without a word of another task
_NODES = ("tree int, node int, feature int, threshold double, left int, right int, value double, gain double, weight double, "
          "rows long")


def best_tree(curve: list[float], patience: int) -> tuple[int, bool]:
    """The round (from 0) of the least error, up to where ``patience`` rounds brought no better one; and whether they did."""
    best = 0
    for i, error in enumerate(curve):
        if error < curve[best]:
            best = i
        elif i - best >= patience:
            return best, True
    return best, False


def slots(spark: SparkSession) -> int:
    """Tasks that run side by side; 0 where no gang can be sure of them or the shared folder is not one that tasks can open."""
    jsc = spark.sparkContext._jsc.sc()
    folder = spark._jvm.org.apache.hadoop.fs.Path(ensure_checkpoint_dir(spark))
    mounted = folder.getFileSystem(jsc.hadoopConfiguration()).getUri().getScheme() == "file"
    if not mounted or spark.sparkContext.getConf().get("spark.dynamicAllocation.enabled", "false") == "true":
        return 0
    return jsc.maxNumConcurrentTasks(jsc.resourceProfileManager().defaultResourceProfile())


@dataclass(frozen=True)
class Settings:
    """What a task needs to know of an estimator."""

    rounds: int
    step: float
    depth: int
    rows: float  # share drawn for a tree
    features: int  # drawn for a node
    least: int  # rows of a node
    seed: int
    classes: bool
    measure: str
    patience: int | None


def _drawn(strategy: str, n: int) -> int:
    """Features drawn for a node, as the library counts them."""
    if strategy in ("all", "auto"):
        return n
    if strategy == "sqrt":
        return math.ceil(math.sqrt(n))
    share = float(strategy)
    return min(n, int(strategy)) if strategy.isdigit() else math.ceil(share * n)


def _points(values: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values and their counts; of more than ``most`` those at equal shares of the rows, with the rows up to each."""
    found, at = np.unique(values, return_inverse=True)
    n = np.bincount(at, counts, len(found))
    if len(found) <= most:
        return found, n
    upto = np.cumsum(n)
    i = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, most + 1) / most).clip(max=len(found) - 1))
    return found[i], np.diff(upto[i], prepend=0)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's points of every feature; NaN is left out."""
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    held, n = [], 0

    def fold() -> None:
        x = np.concatenate(held)
        for f in range(x.shape[1]):
            v = x[~np.isnan(x[:, f]), f]
            if f == len(kept):
                kept.append((np.empty(0), np.empty(0)))
            kept[f] = _points(np.concatenate([kept[f][0], v]), np.concatenate([kept[f][1], np.ones(len(v))]), 4 * _POINTS)
        held.clear()

    for b in batches:
        if b.num_rows:
            held.append(b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
            n += b.num_rows
            if n >= _ROWS:
                fold()
                n = 0
    if held:
        fold()
    if kept:
        ends = [_points(v, c, _POINTS) for v, c in kept]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(ends)), pa.int32()), pa.array([v for v, _ in ends], pa.list_(pa.float64())),
                                          pa.array([c for _, c in ends], pa.list_(pa.float64()))], ["i", "v", "n"])


def edges(values: np.ndarray, counts: np.ndarray, bins: int) -> list[float]:
    """At most ``bins`` - 1 thresholds between values: all of them, or those nearest to equal shares, as the library takes them."""
    found, n = _points(values, counts, len(values))
    with np.errstate(invalid="ignore"):  # infinities
        between = (found[:-1] + found[1:]) / 2
    between = np.where(np.isfinite(between), between, found[:-1])
    if len(between) < bins:
        return between.tolist()
    stride, upto, kept = n.sum() / bins, n[0], []
    target = stride
    for i in range(1, len(found)):
        before, upto = upto, upto + n[i]
        if abs(before - target) < abs(upto - target):
            kept.append(float(between[i - 1]))
            target += stride
    return kept


def thresholds(rows: DataFrame, bins: int) -> list[list[float]]:
    """The thresholds of each feature, from points of all rows; at most ``_POINTS`` a feature and task reach the driver."""
    found = rows.select(vector_to_array("features").alias("x")).mapInArrow(_summaries, "i int, v array<double>, n array<double>").collect()
    parts: dict[int, list] = {}
    for r in found:
        parts.setdefault(r.i, []).append((r.v, r.n))
    return [edges(np.concatenate([v for v, _ in parts[i]]), np.concatenate([n for _, n in parts[i]]), bins) for i in sorted(parts)]


class _Sums:
    """Sums of equal arrays over the tasks of a gang. A task's array is a file of its own, put in place by a rename; all add
    them up in the same order. Who reads a round has written it, so files of the round before have been read by all."""

    def __init__(self, folder: str, rank: int, size: int):
        self.folder, self.rank, self.size, self.round = folder, rank, size, 0

    def _path(self, round_: int, rank: int) -> str:
        return f"{self.folder}/{round_}-{rank}"

    def __call__(self, mine: np.ndarray) -> np.ndarray:
        if self.size == 1:
            return mine
        mine.tofile(f"{self.folder}/.{self.rank}")
        os.rename(f"{self.folder}/.{self.rank}", self._path(self.round, self.rank))
        total = np.zeros_like(mine)
        for rank in range(self.size):
            total += (mine if rank == self.rank else self._read(rank)).reshape(mine.shape)
        if self.round:
            os.remove(self._path(self.round - 1, self.rank))
        self.round += 1
        return total

    def _read(self, rank: int) -> np.ndarray:
        path, until = self._path(self.round, rank), time.monotonic() + _WAIT
        while True:
            try:
                return np.fromfile(path)
            except FileNotFoundError:
                if time.monotonic() > until:
                    raise TimeoutError(f"task {rank} of the gang has not written round {self.round}") from None
                time.sleep(0.0005)


def _binned(batches: Iterator[pa.RecordBatch], cuts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """(codes by feature, label, weight, held out) of a task's rows, in an order that does not depend on how they came."""
    kind = np.uint8 if max(map(len, cuts), default=0) < 256 else np.uint16
    codes, rest = [np.empty((len(cuts), 0), kind)], [np.empty((4, 0))]
    keys = [np.empty(0, np.int64)]
    for b in batches:
        if b.num_rows:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(cuts))
            codes.append(np.array([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], kind).reshape(len(cuts), b.num_rows))
            rest.append(np.array([b.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w", "held", "key")], float))
            keys.append(b.column("key").to_numpy())
    order = np.argsort(np.concatenate(keys), kind="stable")
    y, w, held, _ = np.concatenate(rest, axis=1)[:, order]
    return np.ascontiguousarray(np.concatenate(codes, axis=1)[:, order]), y, w, held > 0


class _Tree:
    """A tree while it grows: node i has the children 2 i and 2 i + 1."""

    def __init__(self, depth: int):
        n = 2 ** (depth + 1)
        self.feature, self.cut = np.full(n, -1, np.int16), np.zeros(n, np.int32)
        self.gain, self.value, self.stats = np.full(n, -1.0), np.zeros(n), np.zeros((n, 3))

    def rows(self, tree: int, cuts: list[np.ndarray]) -> list[tuple]:
        """Its nodes in the order of the library's files: a node, its left side, its right side."""
        out: list[tuple] = []

        def add(i: int) -> int:
            me = len(out)
            out.append(())
            n, w, _ = self.stats[i]
            f = int(self.feature[i])
            left, right = (add(2 * i), add(2 * i + 1)) if f >= 0 else (-1, -1)
            out[me] = (tree, me, f, float(cuts[f][self.cut[i]]) if f >= 0 else None, left, right, float(self.value[i]),
                       float(self.gain[i]), float(w), int(n))
            return me

        add(1)
        return out


class _Grower:
    """One task's share of a fit."""

    def __init__(self, s: Settings, cuts: list[np.ndarray], data: tuple[np.ndarray, ...], rank: int, total: Callable[[np.ndarray], np.ndarray]):
        self.s, self.cuts, self.rank, self.total = s, cuts, rank, total
        self.codes, self.y, self.w, self.held = data
        self.n = len(self.y)
        self.y = 2 * self.y - 1 if s.classes else self.y
        self.margin = np.zeros(self.n)
        self.bins = [len(c) + 1 for c in cuts]
        self.starts = np.concatenate([[0], np.cumsum(self.bins)]).astype(int)
        self.of = np.repeat(np.arange(len(cuts)), self.bins)  # the feature of each bin
        self.last = np.isin(np.arange(self.starts[-1]), self.starts[1:] - 1)

    def target(self, tree: int) -> np.ndarray:
        if tree == 0:
            return self.y
        return 4 * self.y / (1 + np.exp(2 * self.y * self.margin)) if self.s.classes else 2 * (self.y - self.margin)

    def error(self) -> np.ndarray:
        """(weighted error, weight) of the rows held out."""
        y, m, w = self.y[self.held], self.margin[self.held], self.w[self.held]
        e = 2 * np.logaddexp(0, -2 * y * m) if self.s.classes else np.abs(y - m) if self.s.measure == "absolute" else (y - m) ** 2
        return np.array([np.sum(e * w), np.sum(w)])

    def histograms(self, nodes: list[int], at: np.ndarray, drawn: np.ndarray, g: np.ndarray) -> np.ndarray:
        """(node, count | weight | weighted target, bin) of the drawn rows at these nodes."""
        slot = np.full(2 ** (self.s.depth + 1), -1, np.int64)
        slot[nodes] = np.arange(len(nodes))
        row = drawn[slot[at[drawn]] >= 0]
        node, w = slot[at[row]], self.w[row]
        wg, plain = w * g[row], bool(np.all(w == 1))
        out = np.zeros((len(nodes), 3, self.starts[-1]))
        for f, b in enumerate(self.bins):
            key = node * b + self.codes[f][row]
            part = slice(self.starts[f], self.starts[f + 1])
            count = np.bincount(key, minlength=len(nodes) * b).reshape(-1, b)
            out[:, 0, part] = count
            out[:, 1, part] = count if plain else np.bincount(key, w, len(nodes) * b).reshape(-1, b)
            out[:, 2, part] = np.bincount(key, wg, len(nodes) * b).reshape(-1, b)
        return out

    def split(self, tree: _Tree, nodes: list[int], hist: np.ndarray, draw: np.random.Generator) -> list[int]:
        """Take the best split of each node, if there is one; the nodes that were split."""
        upto = np.cumsum(hist, axis=2)
        before = np.concatenate([np.zeros((*upto.shape[:2], 1)), upto], axis=2)[:, :, self.starts[self.of]]
        left = upto - before
        whole = left[:, :, [self.bins[0] - 1]]
        right = whole - left
        order = np.argsort(draw.random((len(nodes), len(self.cuts))), axis=1)[:, :self.s.features]
        mine = np.zeros((len(nodes), len(self.cuts)), bool)
        np.put_along_axis(mine, order, True, axis=1)
        least = max(1, self.s.least)
        ok = mine[:, self.of] & ~self.last & (left[:, 0] >= least) & (right[:, 0] >= least)
        with np.errstate(all="ignore"):
            flat = whole[:, 2] ** 2 / whole[:, 1]
            gain = np.where(ok, left[:, 2] ** 2 / left[:, 1] + right[:, 2] ** 2 / right[:, 1] - flat, -np.inf)
        done = []
        for k, (i, j) in enumerate(zip(nodes, np.argmax(gain, axis=1))):
            if gain[k, j] > 1e-12 * flat[k, 0]:
                tree.feature[i], tree.cut[i], tree.gain[i] = self.of[j], j - self.starts[self.of[j]], gain[k, j] / whole[k, 1, 0]
                tree.stats[2 * i], tree.stats[2 * i + 1] = left[k, :, j], right[k, :, j]
                done.append(i)
        return done

    def grow(self, number: int, judge: Callable[[np.ndarray], bool]) -> _Tree | None:
        """One tree and the margins with it; None if the error of the trees before, summed up on the way, ends the fit."""
        s, tree = self.s, _Tree(self.s.depth)
        fit = ~self.held if s.rows >= 1 else ~self.held & (np.random.default_rng([s.seed, number, self.rank, 1]).random(self.n) < s.rows)
        drawn, g = np.flatnonzero(fit), self.target(number)
        at, every = np.ones(self.n, np.int16), np.arange(self.n)
        said = self.total(np.concatenate([self.histograms([1], at, drawn, g).ravel(), self.error()]))
        if number and judge(said[-2:]):
            return None
        hist = {1: said[:-2].reshape(3, -1)}
        tree.stats[1] = hist[1][:, :self.bins[0]].sum(axis=1)
        for level in range(s.depth):
            ready = [i for i in hist if tree.stats[i, 0] >= 2 * s.least]
            if not ready:
                break
            done = self.split(tree, ready, np.array([hist[i] for i in ready]), np.random.default_rng([s.seed, number, level, 0]))
            if not done:
                break
            f = tree.feature[at]
            at = np.where(f >= 0, 2 * at + (self.codes[f, every] > tree.cut[at]), at).astype(np.int16)
            if level + 1 < s.depth:  # the smaller side is counted, the other is what is left
                small = [2 * i + int(tree.stats[2 * i, 0] > tree.stats[2 * i + 1, 0]) for i in done]
                counted = self.total(self.histograms(small, at, drawn, g))
                hist = {k: v for i, c, h in zip(done, small, counted) for k, v in ((c, h), (c ^ 1, hist[i] - h))}
        tree.value = np.divide(tree.stats[:, 2], tree.stats[:, 1], out=np.zeros(len(tree.value)), where=tree.stats[:, 1] > 0)
        self.margin += (s.step if number else 1.0) * tree.value[at]
        return tree

    def run(self) -> tuple[list[_Tree], list[float]]:
        """All trees and the validation curve (one error a tree; empty without patience)."""
        trees: list[_Tree] = []
        curve: list[float] = []

        def judge(said: np.ndarray) -> bool:
            if self.s.patience is None:
                return False
            curve.append(float(said[0] / said[1]) if said[1] else math.nan)
            return best_tree(curve, self.s.patience)[1]

        while len(trees) < self.s.rounds:
            tree = self.grow(len(trees), judge)
            if tree is None:
                return trees, curve
            trees.append(tree)
        judge(self.total(self.error()))
        return trees, curve


def _task(s: Settings, found: list[list[float]], folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = BarrierTaskContext.get()
        cuts = [np.array(c) for c in found]
        data = _binned(batches, cuts)
        rank, size, mine = ctx.partitionId(), len(ctx.getTaskInfos()), folder
        if size > 1:  # a folder of this attempt, whose name the first task gives
            mine = f"{folder}/{ctx.allGather(uuid.uuid4().hex)[0]}"
            os.makedirs(mine, exist_ok=True)
        trees, curve = _Grower(s, cuts, data, rank, _Sums(mine, rank, size)).run()
        if rank == 0:  # all tasks have the same
            rows = [r for t, tree in enumerate(trees) for r in tree.rows(t, cuts)]
            rows += [(t, -1, None, None, None, None, e, None, None, None) for t, e in enumerate(curve)]
            names = [c.split()[0] for c in _NODES.split(", ")]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], _SCHEMA)
    return run


_SCHEMA = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[t])
                     for n, t in (c.split() for c in _NODES.split(", "))])


def _model(estimator, nodes: DataFrame, trees: int, features: int):
    """The library's model of the first ``trees`` trees. Impurities are not kept: a node has its gain, rows and weight."""
    spark = nodes.sparkSession
    kind = GBTClassificationModel if isinstance(estimator, GBTClassifier) else GBTRegressionModel
    path = scratch_path(spark, f"ensemble-{uuid.uuid4().hex}")

    def described(name: str, uid: str, params: dict, **more) -> str:
        return json.dumps({"class": f"org.apache.spark.ml.{name}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version,
                           "uid": uid, "paramMap": params, "defaultParamMap": {}, **more})

    package = "classification" if kind is GBTClassificationModel else "regression"
    whole = described(f"{package}.{kind.__name__}", estimator.uid, {p.name: v for p, v in estimator.extractParamMap().items()},
                      numFeatures=features, numTrees=trees)
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    parts = [(t, described("regression.DecisionTreeRegressionModel", f"dtr_{uuid.uuid4().hex[:12]}", {}),
              estimator.getStepSize() if t else 1.0) for t in range(trees)]
    spark.createDataFrame(parts, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    leaf = F.col("left") < 0
    nodes.filter((F.col("node") >= 0) & (F.col("tree") < trees)).select(
        F.col("tree").alias("treeID"), F.struct(
            F.col("node").alias("id"), F.col("value").alias("prediction"), F.lit(0.0).alias("impurity"),
            F.array("weight", F.col("weight") * F.col("value"), F.col("weight") * F.col("value") ** 2).alias("impurityStats"),
            F.col("rows").alias("rawCount"), "gain", F.col("left").alias("leftChild"), F.col("right").alias("rightChild"),
            F.struct(F.col("feature").alias("featureIndex"),
                     F.when(leaf, F.array().cast("array<double>")).otherwise(F.array("threshold")).alias("leftCategoriesOrThreshold"),
                     F.lit(-1).alias("numCategories")).alias("split")).alias("nodeData")).coalesce(1).write.parquet(f"{path}/data")
    return kind.load(path)


def fit(estimator, rows: DataFrame, held: DataFrame | None = None, patience: int | None = None, loss: str | None = None,
        gang: int | None = None) -> tuple[object, list[float]]:
    """Fit a boosted estimator of the library on ``rows`` in at most ``gang`` tasks (those that run side by side): the model and
    the validation curve on ``held``. With patience the fit ends after so many rounds without a better error and the model is
    cut at its best tree; without, all of the estimator's rounds are kept. ``loss`` is the measure of a regression ("squared" or
    "absolute"); a classifier is measured by its log loss."""
    spark = rows.sparkSession
    label, weight = F.col(estimator.getLabelCol()).cast("double"), F.lit(1.0)
    if estimator.isSet("weightCol"):
        weight = F.col(estimator.getWeightCol()).cast("double")
    given = [df.select(vector_to_array("features").alias("x"), label.alias("y"), weight.alias("w"), F.lit(out).alias("held"))
             for df, out in ((rows, 0.0), (held, 1.0)) if df is not None]
    data = (given[0].unionByName(given[1]) if len(given) > 1 else given[0]).withColumn("key", F.xxhash64("x", "y", "held"))
    found = thresholds(rows, estimator.getMaxBins())
    s = Settings(estimator.getMaxIter(), estimator.getStepSize(), estimator.getMaxDepth(), estimator.getSubsamplingRate(),
                 _drawn(estimator.getFeatureSubsetStrategy(), len(found)), estimator.getMinInstancesPerNode(), estimator.getSeed(),
                 isinstance(estimator, GBTClassifier), loss or "squared", patience)
    tasks = max(1, min(gang or slots(spark), math.ceil(data.count() / _ROWS)))
    folder = scratch_path(spark, f"gang-{uuid.uuid4().hex}")
    local = folder.removeprefix("file://").removeprefix("file:")
    nodes = written(data.repartition(tasks).mapInArrow(_task(s, found, local), _NODES, barrier=True), "boosted")
    if tasks > 1:
        delete_folder(spark, folder)
    curve = [r.value for r in nodes.filter("node = -1").orderBy("tree").collect()]
    kept = best_tree(curve, patience)[0] + 1 if patience is not None else s.rounds
    model = _model(estimator, nodes, kept, len(found))
    discard(nodes)
    return model, curve

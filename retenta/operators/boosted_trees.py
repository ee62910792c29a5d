"""Gradient-boosted trees for a binary label: one pass over binned rows per level of a tree.

Features become bytes once: the bin of a value between quantiles of its feature, or a code for a
missing one. The bytes are written in blocks of many rows, feature by feature. To grow a level, tasks
find the node of each row by look-ups in a table per level and add up gradient and Hessian per
(node, feature, bin), of the rows in the nodes in question only; sums are whole numbers, so they are
the same in any order and on any layout. The driver holds bins x nodes and picks the splits. Of two
children only the smaller one is summed, the other is what is left of their parent. Each tree sees
a share of the rows, by a hash of their id, and one subset of the features.

A split sends values up to its threshold to the left, and missing values where the gain is larger.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retenta.session import new_shared_path, remove

#: A feature has up to this many bins for values; the code after them is for missing ones.
BINS = 255
MISSING = 255
#: Sums are whole numbers of this part of one.
UNIT = 1 << 24
#: Rows of one block at most; with fewer rows than would fill a block per core, blocks get smaller, down to this.
BLOCK_ROWS = 200_000
SMALL_BLOCK_ROWS = 10_000
#: Rows that a task takes at a time, so that what it makes of them stays in the processor's cache.
CHUNK_ROWS = 16_000
#: Margins are written anew after so many trees.
MARGIN_TREES = 20
#: From so many tasks on, their sums are added up by Spark and not by the driver.
DIRECT_TASKS = 16
#: Gains below this are no gains.
LEAST_GAIN = 1e-6


@dataclass(frozen=True)
class Settings:
    n_trees: int = 300
    depth: int = 5
    rate: float = 0.05
    row_share: float = 0.8
    feature_share: float = 0.8
    ridge: float = 1.0
    least_hessian: float = 1.0
    seed: int = 42


@dataclass(frozen=True)
class BoostedTrees:
    """Trees as arrays of (tree, place); the children of place i are 2i+1 (left) and 2i+2. ``feature`` is -1 at leaves."""

    features: tuple[str, ...]
    feature: np.ndarray
    threshold: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    cover: np.ndarray

    @property
    def n_trees(self) -> int:
        return len(self.feature)


BLOCK_SCHEMA = "n int, bins binary, labels binary, keys binary, margins binary"
NODE_SCHEMA = (
    "tree int, place int, feature int, threshold double, missing_left boolean, value double, gain double, cover double"
)


def walk_function():
    """A function of plain arrays that workers can use without this library: the place where each row ends up."""

    def walk(pick, is_missing, feature, cut, missing_left, depth):
        place = np.zeros(len(is_missing), np.int64)
        rows = np.arange(len(place))
        for _ in range(depth):
            own = feature[place]
            inner = own >= 0
            column = np.maximum(own, 0)
            left = np.where(is_missing[rows, column], missing_left[place], pick[rows, column] <= cut[place])
            place = np.where(inner, 2 * place + 2 - left, place)
        return place

    return walk


def descent_function():
    """As ``walk_function`` for rows of bins: tables of the levels once per job, one look-up per row and level."""

    def tables(feature, cut, missing_left, depth):
        codes, levels = np.arange(256), []
        for level in range(depth):
            first, last = 2**level - 1, 2 ** (level + 1) - 1
            place = np.arange(first, last)[:, None]
            left = np.where(codes == 255, missing_left[first:last, None], codes <= cut[first:last, None])
            # A row that ends at a leaf goes down on the left, to a place that no node has.
            child = np.where(feature[first:last, None] < 0, 2 * place + 1, 2 * place + 2 - left)
            levels.append((feature[first:last].clip(0), (child - last).astype(np.int32).ravel()))
        return levels

    def descend(codes, levels):
        """Place of each row within the last level, counted from its first place."""
        flat, n = codes.ravel(), codes.shape[1]
        rows, place = np.arange(n), np.zeros(n, np.int32)
        for feature, child in levels:
            at = (feature * n).take(place)
            at += rows
            cell = place << 8
            cell |= flat.take(at)
            place = child.take(cell)
        return place

    return tables, descend


def margin_function(model: BoostedTrees, cumulative: bool = False):
    """From a matrix of feature values to margins (log-odds); with ``cumulative`` those after each tree."""
    walk, arrays = walk_function(), (model.feature, model.threshold, model.missing_left, model.value)
    depth = (model.feature.shape[1] + 1).bit_length() - 2

    def margins(x: np.ndarray) -> np.ndarray:
        missing = np.isnan(x)
        steps = np.zeros((len(x), len(arrays[0])))
        for t, (feature, cut, missing_left, value) in enumerate(zip(*arrays)):
            steps[:, t] = value[walk(x, missing, feature, cut, missing_left, depth)]
        return np.cumsum(steps, axis=1) if cumulative else steps.sum(axis=1)

    return margins


def cut_points(rows: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Distinct quantiles of each feature; the last bin has what is above all of them."""
    shares = F.expr("array(" + ", ".join(f"{i / bins!r}D" for i in range(1, bins)) + ")")
    found = rows.agg(*[F.percentile_approx(_value(name), shares, 20 * bins).alias(name) for name in features]).first()
    return [np.unique(np.array(found[name] or [], float)) for name in features]


def _value(name: str) -> Column:
    """The feature as double, null for NaN."""
    return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))


def binned_blocks(rows: DataFrame, features: list[str], label: str, cuts: list[np.ndarray], row_key: Column) -> DataFrame:
    """Blocks of rows as bytes: n, bins (feature by feature), labels, keys, margins."""
    plain = [c.copy() for c in cuts]
    block_rows = BLOCK_ROWS

    def block(x: np.ndarray, label: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        codes = np.empty(x.shape[::-1], np.uint8)
        for j, own in enumerate(plain):
            codes[j] = np.where(np.isnan(x[:, j]), 255, np.searchsorted(own, x[:, j]))
        parts = [codes.tobytes(), label.astype(np.int8).tobytes(), key.astype(np.int64).tobytes(), np.zeros(len(x)).tobytes()]
        columns = [pa.array([len(x)], pa.int32()), *(pa.array([p], pa.binary()) for p in parts)]
        return pa.RecordBatch.from_arrays(columns, names=["n", "bins", "labels", "keys", "margins"])

    def pack(batches):
        held, n = [], 0
        for batch in batches:
            *x, label, key = (column.to_numpy(zero_copy_only=False).astype(float if k < len(plain) else np.int64) for k, column in enumerate(batch.columns))
            held.append((np.stack(x, axis=1), label, key))
            n += len(label)
            if n >= block_rows:
                yield block(*map(np.concatenate, zip(*held)))
                held, n = [], 0
        if n:
            yield block(*map(np.concatenate, zip(*held)))

    columns = [_value(name).alias(f"x{j}") for j, name in enumerate(features)]
    picked = rows.select(*columns, F.col(label).cast("bigint").alias("label"), row_key.alias("key"))
    return picked.mapInArrow(pack, BLOCK_SCHEMA)


def chunks_function(n_features: int, size: int = CHUNK_ROWS):
    """A function from a block to the arrays of a few rows at a time: bins as (feature, row), labels, keys, margins."""

    def chunks(row):
        n, bins, labels, keys, margins = row
        codes = np.frombuffer(bins, np.uint8).reshape(n_features, n)
        rest = np.frombuffer(labels, np.int8), np.frombuffer(keys, np.int64), np.frombuffer(margins, np.float64)
        for first in range(0, n, size):
            own = slice(first, first + size)
            yield np.ascontiguousarray(codes[:, own]), *(values[own] for values in rest)

    return chunks


def gradient_function(positive_weight: float, seed: int, row_share: float, unit: int = UNIT):
    """Whole-number gradients and Hessians of rows, and whether a tree sees them."""
    weight, limit = float(positive_weight), np.uint64(min(int(row_share * 2.0**64), 2**64 - 1))

    def gradients(margins, labels, keys, tree):
        p = 1.0 / (1.0 + np.exp(-margins))
        w = np.where(labels == 1, weight, 1.0)
        h = keys.astype(np.uint64) ^ np.uint64((0x9E3779B97F4A7C15 * (tree + 1) + seed) % 2**64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        chosen = (h ^ (h >> np.uint64(31))) < limit
        return np.rint(w * (p - labels) * unit), np.rint(np.maximum(w * p * (1.0 - p), 1e-16) * unit), chosen

    return gradients


class _Grower:
    """The rows' blocks while trees grow.

    There are five short jobs per tree, each a few sums per block, so the blocks are read as an RDD: a job
    on it starts in a fraction of the time that planning the same as a query takes. Margins after a tree are
    worked out along with the first sums of the next one and kept; from time to time they are written, so
    what a lost executor held comes from a file and a few trees.
    """

    def __init__(self, spark: SparkSession, path: str, n_features: int, settings: Settings, positive_weight: float):
        self.spark, self.settings, self.since = spark, settings, 0
        self.chunks = chunks_function(n_features)
        self.gradients = gradient_function(positive_weight, settings.seed, settings.row_share)
        self.stale: list = []
        self._read(path)

    def _read(self, path: str) -> None:
        self.path = path
        frame = self.spark.read.schema(BLOCK_SCHEMA).parquet(path)
        self.blocks = frame.rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK_DESER)
        self.n_tasks = self.blocks.getNumPartitions()

    def close(self) -> None:
        for blocks in (self.blocks, *self.stale):
            blocks.unpersist()
        remove(self.spark, self.path)

    def sums(self, tree: int, grown: tuple, level: int, nodes: list[int], subset: list[int]) -> np.ndarray:
        """Gradient and Hessian sums as (node, feature, bin, 2)."""
        chunks, gradients, (tables, descend) = self.chunks, self.gradients, descent_function()
        levels = tables(*grown[:3], level)
        slot_of = np.full(2**level, -1)
        slot_of[np.array(nodes) - (2**level - 1)] = np.arange(len(nodes))
        cells = len(nodes) * 256

        def add_up(rows):
            total = np.zeros((len(subset), cells, 2), np.int64)
            for codes, labels, keys, margins in chain.from_iterable(map(chunks, rows)):
                slot = slot_of.take(descend(codes, levels))
                own = np.flatnonzero(slot >= 0)
                g, h, chosen = gradients(margins[own], labels[own], keys[own], tree)
                own, g, h = own[chosen], g[chosen], h[chosen]
                first = slot[own] << 8
                for j, column in enumerate(subset):
                    cell = first + codes[column].take(own)
                    for k, weight in enumerate((g, h)):
                        total[j, :, k] += np.bincount(cell, weight, cells).astype(np.int64)
            yield total

        found = self.blocks.mapPartitions(add_up)
        total = found.treeReduce(lambda a, b: a + b) if self.n_tasks > DIRECT_TASKS else sum(found.collect())
        for blocks in self.stale:  # those that are read now have been kept
            blocks.unpersist()
        self.stale.clear()
        return total.reshape(len(subset), len(nodes), 256, 2).swapaxes(0, 1)

    def add(self, tree: tuple) -> None:
        """Take a grown tree into the margins."""
        chunks, (tables, descend), depth = self.chunks, descent_function(), self.settings.depth
        feature, cut, missing_left, value = tree
        levels = tables(feature, cut, missing_left, depth)
        reached = value.copy()
        for place in range(2**depth - 1):  # what a leaf further up gives is found at the end of its left side
            if feature[place] < 0:
                reached[2 * place + 1] = reached[place]
        reached = reached[2**depth - 1 :]

        def renewed(row):
            own = [margins + reached.take(descend(codes, levels)) for codes, _, _, margins in chunks(row)]
            return *row[:4], b"".join(part.tobytes() for part in own)

        before, path = self.blocks, self.path
        self.stale.append(before)
        self.blocks = before.map(renewed)
        self.since += 1
        if self.since < MARGIN_TREES:
            self.blocks = self.blocks.persist(StorageLevel.MEMORY_AND_DISK_DESER)
            return
        written = new_shared_path(self.spark, "margins")
        self.spark.createDataFrame(self.blocks, BLOCK_SCHEMA).write.parquet(written)
        self._read(written)
        remove(self.spark, path)
        self.since = 0


def best_split(sums: np.ndarray, cuts: list[np.ndarray], settings: Settings):
    """(gain, feature of the subset, cut, missing left, left sums) of one node, or None. ``sums`` are (feature, bin, 2).

    Of equal gains the first feature, the lowest cut and missing values to the right win.
    """
    best = None
    total = sums[0].sum(axis=0)

    def score(s: np.ndarray) -> np.ndarray:
        return (s[..., 0] / UNIT) ** 2 / (s[..., 1] / UNIT + settings.ridge)

    for j, own in enumerate(cuts):
        upto = np.cumsum(sums[j, : len(own) + 1], axis=0)
        for missing_left in (False, True):
            left = upto + sums[j, MISSING] if missing_left else upto
            right = total - left
            gain = 0.5 * (score(left) + score(right) - score(total))
            least = settings.least_hessian * UNIT
            gain = np.where((left[:, 1] >= least) & (right[:, 1] >= least), gain, -np.inf)
            k = int(np.argmax(gain))
            if gain[k] > LEAST_GAIN and (best is None or gain[k] > best[0]):
                best = float(gain[k]), j, k, missing_left, left[k]
    return best


def _grow(grower: _Grower, tree: int, subset: list[int], cuts: list[np.ndarray], settings: Settings):
    """Arrays of one tree: feature, bin, missing_left, value, gain, cover."""
    places = 2 ** (settings.depth + 1) - 1
    feature, cut = np.full(places, -1), np.zeros(places, np.int64)
    missing_left, gain = np.zeros(places, bool), np.zeros(places)
    total = np.zeros((places, 2), np.int64)
    least = 2 * settings.least_hessian * UNIT
    own_cuts = [cuts[j] for j in subset]
    pairs: list[tuple[int, list[int]]] = [(-1, [0])]
    known: dict[int, np.ndarray] = {}
    for level in range(settings.depth):
        # Children that can be split are summed; of two such the larger is what is left of their parent.
        wanted = {parent: [v for v in nodes if v == 0 or total[v, 1] >= least] for parent, nodes in pairs}
        summed = [min(nodes, key=lambda v: (total[v, 1], v)) for nodes in wanted.values() if nodes]
        if not summed:
            break
        sums = dict(zip(summed, grower.sums(tree, (feature, cut, missing_left), level, summed, subset)))
        for parent, nodes in wanted.items():
            for v in nodes:
                if v not in sums:
                    sums[v] = known[parent] - sums[v + 1 if v % 2 else v - 1]
        known, pairs = sums, []
        for v in sorted(sums):
            if v == 0:
                total[0] = sums[0][0].sum(axis=0)
            found = best_split(sums[v], own_cuts, settings)
            if found:
                gain[v], j, cut[v], missing_left[v], left = found
                feature[v] = subset[j]
                total[2 * v + 1], total[2 * v + 2] = left, total[v] - left
                pairs.append((v, [2 * v + 1, 2 * v + 2]))
    value = np.where(feature < 0, -settings.rate * total[:, 0] / (total[:, 1] + settings.ridge * UNIT), 0.0)
    return feature, cut, missing_left, value, gain, total[:, 1] / UNIT


def fit(
    rows: DataFrame, features: list[str], label: str, id_col: str, positive_weight: float, settings: Settings = Settings()
) -> BoostedTrees:
    """Boost trees on rows with a 0/1 label; positives count ``positive_weight`` times. Rows are known by their id.

    Give a written frame: it is read twice, for the cut points and for the blocks.
    """
    spark = rows.sparkSession
    key = F.xxhash64(F.col(id_col), F.lit(settings.seed))
    cuts = cut_points(rows, features)
    n_rows = rows.count()
    path = new_shared_path(spark, "blocks")
    n_blocks = max(-(-n_rows // BLOCK_ROWS), min(spark.sparkContext.defaultParallelism, -(-n_rows // SMALL_BLOCK_ROWS)), 1)
    sized = rows.repartition(n_blocks, id_col)
    binned_blocks(sized, features, label, cuts, key).write.parquet(path)
    grower = _Grower(spark, path, len(features), settings, positive_weight)
    n_subset = max(1, int(settings.feature_share * len(features)))
    trees = []
    try:
        for tree in range(settings.n_trees):
            drawn = np.random.default_rng([settings.seed, tree]).choice(len(features), n_subset, replace=False)
            grown = _grow(grower, tree, sorted(drawn.tolist()), cuts, settings)
            grower.add(grown[:4])
            trees.append(grown)
    finally:
        grower.close()
    feature, cut, missing_left, value, gain, cover = map(np.stack, zip(*trees))
    ends = [np.append(own, np.inf) for own in cuts]
    threshold = np.array([[ends[f][c] if f >= 0 else 0.0 for f, c in zip(fs, cs)] for fs, cs in zip(feature, cut)])
    return BoostedTrees(tuple(features), feature, threshold, missing_left, value, gain, cover)


def save(spark: SparkSession, model: BoostedTrees, path: str) -> None:
    """The nodes as a table, one row each, and the names of the features."""
    tree, place = np.nonzero((model.feature >= 0) | (model.cover > 0))
    arrays = (model.feature, model.threshold, model.missing_left, model.value, model.gain, model.cover)
    table = {"tree": tree, "place": place} | dict(zip(NODE_NAMES[2:], (a[tree, place] for a in arrays)))
    nodes = spark.createDataFrame(pd.DataFrame(table)).selectExpr(*[f"CAST({c} AS {t}) AS {c}" for c, t in NODE_TYPES])
    nodes.coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    about = (list(model.features), *model.feature.shape)
    spark.createDataFrame([about], "features array<string>, trees int, places int").coalesce(1).write.mode("overwrite").json(f"{path}/about")


NODE_TYPES = [tuple(field.split(" ")) for field in NODE_SCHEMA.split(", ")]
NODE_NAMES = [name for name, _ in NODE_TYPES]


def load(spark: SparkSession, path: str) -> BoostedTrees:
    about = spark.read.schema("features array<string>, trees int, places int").json(f"{path}/about").first()
    nodes = spark.read.schema(NODE_SCHEMA).parquet(f"{path}/nodes").toArrow()
    shape = about["trees"], about["places"]
    at = nodes.column("tree").to_numpy(), nodes.column("place").to_numpy()
    arrays = []
    for name, empty, kind in zip(NODE_NAMES[2:], (-1, 0.0, False, 0.0, 0.0, 0.0), (int, float, bool, float, float, float)):
        own = np.full(shape, empty, kind)
        own[at] = nodes.column(name).to_numpy()
        arrays.append(own)
    return BoostedTrees(tuple(about["features"]), *arrays)


def margins(model: BoostedTrees, rows: DataFrame, name: str = "margin") -> DataFrame:
    """Rows with the log-odds that the model gives them; a null or NaN feature is a missing one."""
    score = margin_function(model)

    @F.pandas_udf("double")
    def margin(columns: pd.DataFrame) -> pd.Series:
        return pd.Series(score(columns.to_numpy(dtype=float)))

    return rows.withColumn(name, margin(F.struct(*[_value(c).alias(c) for c in model.features])))


def scores_by_tree(model: BoostedTrees, rows: DataFrame, label: str) -> DataFrame:
    """(tree, margin, pos, neg): distinct margins after each tree, with the rows of either class that have them."""
    score = margin_function(model, cumulative=True)

    def count(batches):
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[:-1]], axis=1)
            positive = batch.columns[-1].to_numpy(zero_copy_only=False) == 1
            for low in range(0, len(x), 10_000):
                total, own = score(x[low : low + 10_000]), positive[low : low + 10_000]
                for tree in range(total.shape[1]):
                    value, at = np.unique(total[:, tree], return_inverse=True)
                    pos, neg = (np.bincount(at, weight, len(value)).astype(np.int64) for weight in (own, ~own))
                    columns = [pa.array(np.full(len(value), tree, np.int32)), *map(pa.array, (value, pos, neg))]
                    yield pa.RecordBatch.from_arrays(columns, names=["tree", "margin", "pos", "neg"])

    picked = rows.filter(F.col(label).isNotNull()).select(*[_value(c).alias(c) for c in model.features], F.col(label).cast("int"))
    counted = picked.mapInArrow(count, "tree int, margin double, pos bigint, neg bigint")
    return counted.groupBy("tree", "margin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def importance(model: BoostedTrees) -> dict[str, float]:
    """Mean gain of a feature's splits, as a share of the sum over all features."""
    inner = model.feature >= 0
    mean = [model.gain[inner & (model.feature == j)].mean() if (model.feature == j).any() else 0.0 for j in range(len(model.features))]
    total = sum(mean) or 1.0
    return {name: float(m / total) for name, m in zip(model.features, mean)}

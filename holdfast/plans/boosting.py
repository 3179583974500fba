"""Histogram gradient boosting for a binary label, grown level by level in Spark.

Numbers are binned by quantiles, text columns by their code in the index table. Rows are written once as
blocks, the bins of a block column by column. Each level of a tree is one
job: tasks send every row to its node and add up gradients and second derivatives per node, column
and bin. Both children of a split get their sums, and so their value, with it: the lowest level needs no job.
Leaves are Newton steps with an L2 penalty. A number is split between bins, a text column one value against
the rest, as its one-hot columns would be.

Where the sums of all tasks take at most ``MOST_SUMS`` bytes, a level is one stage: tasks count the smaller
child of each split, the driver adds their sums up and takes the other child as the rest of its parent.
Rows are persisted with their margins, which move every ``MOVE_EVERY`` trees. Else (many values of a text
column, very many tasks) the histograms of a node and column meet after a shuffle, in parts, and the driver sees at
most nodes times columns (and parts) rows a level; margins are written every ``STAGE_EVERY`` trees, and between
tasks add the last trees to them.

Gradients are rounded to 2**-20 and summed as whole numbers, so a model does not depend on how the rows are
dealt to tasks or on the order of sums. The loss of the held-out rows comes with the first level of the next tree,
and growing stops when it has not fallen for ``patience`` trees.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from holdfast.functions.exact import int_div
from holdfast.session import ensure_checkpoint_dir, stage

MOST_BINS = 255
STAGE_EVERY = 10
UNIT = float(1 << 20)
LEAST_CURVE = 1e-3
LOSS = -1  # node number under which the held-out loss travels
PART = 1 << 14  # values of a text column whose histograms meet in one place
GROUPS = 64  # histograms compared at once
DENSE = 1 << 18  # cells of a column's histogram that a task keeps as a table; larger ones as lists
MOST_SUMS = 128 << 20  # bytes of sums that all tasks together send the driver in a level
CHUNK = 1 << 16  # rows that a task handles at once
KEY = 1 << 8  # values of a key that stands for several columns
MOVE_EVERY = 3  # trees after which margins move; between, tasks add the last trees to them
CUT_EVERY = 20  # moves after which the rows are checkpointed, so that lineages stay short


@dataclass(frozen=True)
class Settings:
    rounds: int = 400
    patience: int = 20
    depth: int = 6
    rate: float = 0.05
    least_rows: int = 20
    penalty: float = 0.1


@dataclass
class Tree:
    """Nodes by number; a node without a feature is a leaf. Rows go left up to ``cut``, or at it for text columns."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        """Gives the node two children, the second one numbered after the first."""
        first = len(self.feature)
        self.feature[node], self.cut[node], self.left[node] = feature, cut, first
        for values, empty in ((self.feature, -1), (self.cut, 0), (self.left, -1), (self.value, 0.0)):
            values += [empty, empty]
        return first, first + 1

    def routed(self, n: int, goes_left: Callable, wanted: list[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """The wanted nodes, or all leaves, with those of ``n`` rows that reach them, ascending.

        ``goes_left`` tells for a feature, a cut and rows (None: all) which of them go left.
        """
        above = {c: node for node, left in enumerate(self.left) if left >= 0 for c in (left, left + 1)}
        ends = set(wanted or [node for node, feature in enumerate(self.feature) if feature < 0])
        on_path, open_ = set(), list(ends)
        while open_:
            on_path.add(node := open_.pop())
            if node in above:
                open_.append(above[node])
        stack = [(0, None)]
        while stack:
            node, rows = stack.pop()
            if node in ends:
                yield node, np.arange(n) if rows is None else rows
                continue
            goes = goes_left(self.feature[node], self.cut[node], rows)
            for child, some in ((self.left[node], goes), (self.left[node] + 1, ~goes)):
                if child in on_path:
                    stack.append((child, np.flatnonzero(some) if rows is None else rows.compress(some)))

    def nodes(self, bins: np.ndarray, is_text: np.ndarray) -> np.ndarray:
        """Leaf of every row."""

        def goes_left(feature: int, cut: int, rows: np.ndarray | None) -> np.ndarray:
            column = bins[:, feature] if rows is None else bins[:, feature].take(rows)
            return column == cut if is_text[feature] else column <= cut

        at = np.zeros(len(bins), np.int64)
        for node, rows in self.routed(len(bins), goes_left):
            at[rows] = node
        return at

    def margins(self, bins: np.ndarray, is_text: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins, is_text)]


@dataclass
class Bins:
    """How rows become bins: upper-open borders per numeric column, and the code columns as they are."""

    borders: dict[str, list[float]]
    codes: list[str]

    def is_text(self) -> np.ndarray:
        return np.array([False] * len(self.borders) + [True] * len(self.codes))

    def inputs(self) -> Column:
        """Numbers and codes of a row, null numbers as 0."""
        numbers = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in self.borders]
        return F.array(*numbers, *[F.col(f"`{c}`").cast("double") for c in self.codes])

    def of(self, inputs: np.ndarray) -> np.ndarray:
        """Bins of rows of inputs: the borders up to each number, and the codes themselves."""
        out = inputs.astype(np.int32, order="F")
        for k, borders in enumerate(self.borders.values()):
            out[:, k] = np.searchsorted(borders, inputs[:, k], side="right")
        return out

    def column(self) -> Column:
        width = len(self.borders) + len(self.codes)

        def cut(inputs: pa.Array) -> pa.Array:
            found = self.of(inputs.flatten().to_numpy().reshape(len(inputs), width))
            ends = pa.array(np.arange(len(inputs) + 1) * width, pa.int32())
            return pa.ListArray.from_arrays(ends, pa.array(found.ravel()))

        return F.arrow_udf(cut, "array<int>")(self.inputs())


def fit_bins(df: DataFrame, numeric: list[str], codes: list[str]) -> Bins:
    """Quantile borders, at most ``MOST_BINS`` - 1 a column: the values at every ``MOST_BINS``-th part of its rows.

    Values are counted before they are ordered. Ranges of values are blocks: a block is summed up on its own, and
    the totals of the blocks before it - one row per block - are added.
    """
    borders: dict[str, list[float]] = {c: [] for c in numeric}
    if not numeric:
        return Bins(borders, codes)
    filled = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in numeric]
    cells = F.array(*[F.struct(F.lit(k).alias("column"), c.alias("value")) for k, c in enumerate(filled)])
    counts = df.select(F.inline(cells)).groupBy("column", "value").agg(F.count("*").alias("n"))
    # Written with their block, so that the borders cannot move between the two readings.
    ranged = counts.repartitionByRange("column", "value").withColumn("block", F.spark_partition_id())
    counts = stage(ranged, "value_counts")
    whole = Window.partitionBy("column")
    earlier = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        counts.groupBy("column", "block")
        .agg(F.sum("n").alias("n"), F.min("value").alias("value"))
        .select(
            "column", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
            F.sum("n").over(whole).alias("total"), F.min("value").over(whole).alias("least"),
        )
    )
    inside = Window.partitionBy("column", "block").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    met = counts.join(totals, ["column", "block"]).withColumn("upto", F.col("before") + F.sum("n").over(inside))

    def parts(n: Column) -> Column:
        return int_div(n * MOST_BINS, F.col("total"))

    # Nothing lies below the least value, nothing above the greatest.
    last = (F.col("upto") < F.col("total")) | (parts(F.col("upto") - F.col("n")) < MOST_BINS - 1)
    found = met.filter((parts(F.col("upto")) > parts(F.col("upto") - F.col("n"))) & last & (F.col("value") > F.col("least")))
    for r in found.select("column", "value").collect():
        borders[numeric[r["column"]]].append(r["value"])
    return Bins({c: sorted(values) for c, values in borders.items()}, codes)


_CELLS = {"label": "f8", "weight": "f8", "margin": "f8", "held_out": "?"}
_BLOCK = "width int, bins binary, label binary, weight binary, margin binary, held_out binary"


def _to_blocks(base: float):
    """One row per batch: the bins column by column, in as few bytes as they need, and the other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = batch.column("bins").flatten().to_numpy().reshape(batch.num_rows, -1)
            width = np.min_scalar_type(bins.max(initial=0)).itemsize
            label, weight = (batch.column(c).to_numpy().astype(np.float64) for c in ("label", "weight"))
            held = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            cells = [bins.T.astype(f"u{width}"), label, weight, np.full(batch.num_rows, base), held]
            yield pa.RecordBatch.from_arrays(
                [pa.array([width], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in cells]],
                names=["width", "bins", "label", "weight", "margin", "held_out"],
            )

    return run


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """Bins (rows by columns), label, weight, margin and held-out of each block."""
    for i in range(batch.num_rows):
        label, weight, margin, held = (np.frombuffer(batch.column(c)[i].as_py(), kind) for c, kind in _CELLS.items())
        bins = np.frombuffer(batch.column("bins")[i].as_py(), f"u{batch.column('width')[i].as_py()}")
        yield bins.reshape(-1, len(label)).T, label, weight, margin, held


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Highest bin of each column in a task, and the columns before it that have the same bins in all its rows."""
    most, same = None, {}
    for batch in batches:
        for bins, *_ in _blocks(batch):
            columns = bins.T
            if most is None:
                most, same = np.zeros(len(columns), np.int64), {k: list(range(k)) for k in range(len(columns))}
            most = np.maximum(most, columns.max(axis=1))
            same = {k: [j for j in js if np.array_equal(columns[j], columns[k])] for k, js in same.items()}
    if most is not None:
        kinds = [pa.int32(), pa.int64(), pa.list_(pa.int32())]
        found = [range(len(most)), most.tolist(), [same[k] for k in range(len(most))]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, kind) for x, kind in zip(found, kinds)], names=["feature", "most", "same"]
        )


_TOTALS = ("g", "h", "n")
_PARTIAL = "node int, feature int, part int, bin binary, g binary, h binary, n binary, g_all bigint, h_all bigint, n_all bigint"
_PARTIAL_NAMES = [f.split()[0] for f in _PARTIAL.split(", ")]


class _Sums:
    """Sums per node and bin of one column."""

    def __init__(self, n_nodes: int, n_bins: int):
        self.n_bins, self.lists = n_bins, []
        # Whole numbers below 2**53 are exact as doubles.
        self.table = np.zeros((3, n_nodes * n_bins)) if n_nodes * n_bins <= DENSE else None

    def add(self, key: np.ndarray, g: np.ndarray, h: np.ndarray) -> None:
        if self.table is None:
            key, at = np.unique(key, return_inverse=True)
            self.lists.append((key, *(np.bincount(at, x, len(key)) for x in (g, h, None))))
            return
        for total, values in zip(self.table, (g, h, None)):
            total += np.bincount(key, values, len(total))

    def found(self) -> tuple[np.ndarray, ...]:
        """Keys that occur, ascending, and their sums."""
        if self.table is not None:
            key = np.flatnonzero(self.table[2])
            return key, *self.table[:, key].astype(np.int64)
        if not self.lists:
            return tuple(np.zeros((4, 0), np.int64))
        keys, *parts = (np.concatenate(x) for x in zip(*self.lists))
        key, at = np.unique(keys, return_inverse=True)
        return key, *(np.bincount(at, x, len(key)).astype(np.int64) for x in parts)


def _histograms(trees: list[Tree], tree: Tree, active: list[int], is_text: np.ndarray, most: list[int]):
    """Sums per node, column and bin over the rows of a task; held-out loss with the first level."""
    with_loss = active == [0]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(len(tree.feature), -1)
        place[active] = np.arange(len(active))
        columns = [_Sums(len(active), m + 1) for m in most]
        whole = _Sums(len(active), 1)
        loss, weights = 0.0, 0.0
        for batch in batches:
            for bins, label, weight, margin, held in _blocks(batch):
                node = place[tree.nodes(bins, is_text)]
                use = np.flatnonzero((node >= 0) & ~held)
                if with_loss and held.any():
                    own = margin[held] + sum(t.margins(bins[held], is_text) for t in trees)
                    signed = np.where(label[held] == 1, -own, own)
                    loss += float((weight[held] * np.logaddexp(0, signed)).sum())
                    weights += float(weight[held].sum())
                if not len(use):
                    continue
                node, label, weight, bins = node[use], label[use], weight[use], bins.T[:, use].T
                margin = margin[use] + sum(t.margins(bins, is_text) for t in trees)
                p = 1 / (1 + np.exp(-margin))
                g = np.rint(weight * (p - label) * UNIT)
                h = np.rint(weight * p * (1 - p) * UNIT)
                whole.add(node, g, h)
                for k, sums in enumerate(columns):
                    sums.add(node * sums.n_bins + bins[:, k], g, h)
        rows = []
        some, *totals = whole.found()
        totals = dict(zip(some.tolist(), zip(*(t.tolist() for t in totals))))
        for k, sums in enumerate(columns):
            key, *values = sums.found()
            at, bin_ = key // sums.n_bins, key % sums.n_bins
            # Every part of a column learns the sums of the whole node.
            for part in range(most[k] // PART + 1):
                inside = bin_ // PART == part
                for i in totals:
                    own = np.flatnonzero(inside & (at == i)) if len(totals) > 1 or most[k] >= PART else slice(None)
                    cells = [x[own].tobytes() for x in (bin_, *values)]
                    rows.append((active[i], k, part, *cells, *totals[i]))
        if weights:
            rows.append((LOSS, 0, 0, b"", b"", b"", b"", round(loss * UNIT), round(weights * UNIT), 1))
        if rows:
            kinds = [pa.int32()] * 3 + [pa.binary()] * 4 + [pa.int64()] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names=_PARTIAL_NAMES
            )

    return add_up


_BEST = (
    "node int, feature int, g bigint, h bigint, n bigint, "
    "gain double, bin bigint, g_left bigint, h_left bigint, n_left bigint"
)
_BEST_NAMES = [f.split()[0] for f in _BEST.split(", ")]


def _cuts(tables: list[np.ndarray], totals: list[np.ndarray], text: np.ndarray, settings: Settings):
    """Best bin of each row of the tables, its gain and the sums to its left, and which rows have none."""

    def strength(g, h):
        return g * g / (h + settings.penalty)

    text = text[:, None]
    left = [np.where(text, t, np.cumsum(t, axis=1)) for t in tables]
    g, h, gl, hl = (x / UNIT for x in (totals[0][:, None], totals[1][:, None], *left[:2]))
    gain = strength(gl, hl) + strength(g - gl, h - hl) - strength(g, h)
    good = (
        (left[2] >= settings.least_rows) & (totals[2][:, None] - left[2] >= settings.least_rows)
        & (hl >= LEAST_CURVE) & (h - hl >= LEAST_CURVE) & (gain > 0)
    )
    # Of equal gains the lowest bin.
    first = np.argmax(np.where(good, gain, -1.0), axis=1)
    i = np.arange(len(first)), first
    return first, gain[i], [x[i] for x in left], ~good[i]


def _best(settings: Settings, is_text: np.ndarray):
    """Sums of the node and best cut of each node, column and part, from the histograms of all tasks, sorted."""

    def best_of(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        """One row for each group of rows."""
        group = np.repeat(np.arange(len(starts)), np.diff([*starts, len(rows)]))
        node, feature, part = (rows.column(c).to_numpy()[starts] for c in ("node", "feature", "part"))
        raw = [rows.column(c).to_pylist() for c in ("bin", *_TOTALS)]
        bin_, *sums = (np.frombuffer(b"".join(cells), np.int64) for cells in raw)
        at = np.repeat(group, [len(cell) // 8 for cell in raw[0]])
        bin_ = bin_ - part[at] * PART
        n_bins = int(bin_.max(initial=0)) + 1
        tables = [
            np.bincount(at * n_bins + bin_, s, len(starts) * n_bins).astype(np.int64).reshape(-1, n_bins) for s in sums
        ]
        totals = [np.add.reduceat(rows.column(f"{c}_all").to_numpy(), starts) for c in _TOTALS]
        first, gain, left, none = _cuts(tables, totals, is_text[feature] & (node != LOSS), settings)
        found = [pa.array(x, mask=none) for x in (gain, first + part.astype(np.int64) * PART, *left)]
        return pa.RecordBatch.from_arrays([*map(pa.array, (node, feature, *totals)), *found], names=_BEST_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in chain(batches, [None]):
            if batch is not None:
                more = pa.Table.from_batches([batch])
                rest = more if rest is None else pa.concat_tables([rest, more])
            if rest is None or not len(rest):
                continue
            key = np.stack([rest.column(c).to_numpy() for c in ("node", "feature", "part")])
            starts = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))
            # The last group may go on in the next batch.
            whole = starts if batch is None else starts[:-1]
            ends = np.append(starts[1:], len(rest))
            for first in range(0, len(whole), GROUPS):
                some = whole[first : first + GROUPS]
                end = ends[first + len(some) - 1]
                yield best_of(rest.slice(some[0], end - some[0]), some - some[0])
            rest = rest.slice(starts[-1])

    return run


def _best_splits(histograms: DataFrame, settings: Settings, is_text: np.ndarray) -> DataFrame:
    """Best cut per node, column and part, and the sums of the node and of its left child."""
    key = ["node", "feature", "part"]
    met = histograms.repartition(*key).sortWithinPartitions(*key)
    return met.mapInArrow(_best(settings, is_text), _BEST)


def _leaf(g: int, h: int, settings: Settings) -> float:
    return -settings.rate * (g / UNIT) / (h / UNIT + settings.penalty)


def _grown(tree: Tree, active: list[int], table: list, depth: int, settings: Settings) -> list[int]:
    """Splits the nodes of a level by the best cuts found; gives the children to look at next."""
    following, own = [], {node: [] for node in active}
    for r in table:
        if r["node"] != LOSS:
            own[r["node"]].append(r)
    for node, found in own.items():
        if not found:
            continue
        sums = [found[0][c] for c in _TOTALS]
        tree.value[node] = _leaf(sums[0], sums[1], settings)
        able = [r for r in found if r["gain"] is not None]
        if able and depth < settings.depth:
            # Of equal gains the first column, then the lowest bin.
            r = max(able, key=lambda r: (r["gain"], -r["feature"], -r["bin"]))
            children = tree.split(node, r["feature"], r["bin"])
            left = [r[f"{c}_left"] for c in _TOTALS]
            for child, part in zip(children, (left, [s - x for s, x in zip(sums, left)])):
                tree.value[child] = _leaf(part[0], part[1], settings)
                # Fewer rows than two children need are not counted again.
                if part[2] >= 2 * settings.least_rows:
                    following.append(child)
    return following


def grow(rows: DataFrame, bins: Bins, base: float, settings: Settings) -> tuple[list[Tree], list[float]]:
    """Trees, and the mean held-out loss before each and after the last but one.

    ``rows`` has bins, label, weight and held_out; it is written as blocks, which are read once a level.
    """
    is_text = bins.is_text()
    # Dealt equally before: every level waits for the longest task.
    n_tasks = rows.sparkSession.sparkContext.defaultParallelism
    staged = stage(rows.mapInArrow(_to_blocks(base), _BLOCK).repartition(n_tasks), "margins")
    facts = staged.mapInArrow(_facts, "feature int, most bigint, same array<int>").groupBy("feature")
    found = sorted(facts.agg(F.max("most").alias("most"), F.collect_list("same").alias("same")).collect())
    most = [r["most"] for r in found]
    # A column that equals an earlier one of its kind never has a better split.
    columns = [k for k, r in enumerate(found) if not any(is_text[j] == is_text[k] for j in set.intersection(*map(set, r["same"])))]
    cells = sum(most[k] + 1 for k in columns)
    sums = 8 * len(_TOTALS) * cells * (1 << max(settings.depth - 2, 0)) * n_tasks
    if columns and sums <= MOST_SUMS:
        return _grow_by_sums(staged, _Keys.of(columns, most, is_text), settings)
    return _grow_by_shuffles(staged, is_text, most, settings)


def _grow_by_shuffles(
    staged: DataFrame, is_text: np.ndarray, most: list[int], settings: Settings
) -> tuple[list[Tree], list[float]]:
    trees, fresh, losses = [], [], []
    while len(trees) < settings.rounds:
        tree, active = Tree(), [0]
        for depth in range(max(settings.depth, 1)):
            found = staged.mapInArrow(_histograms(fresh, tree, active, is_text, most), _PARTIAL)
            table = _best_splits(found, settings, is_text).collect()
            losses += [r["g"] / r["h"] for r in table if r["node"] == LOSS]
            if active == [0] and stopped(losses, settings.patience):
                return trees, losses
            active = _grown(tree, active, table, depth, settings)
            if not active:
                break
        trees.append(tree)
        fresh = [*fresh, tree]
        if len(tree.feature) == 1:
            break  # nothing left to split
        if len(fresh) == STAGE_EVERY:
            staged = stage(_with_margins(staged, fresh, is_text), "margins")
            fresh = []
    return trees, losses


@dataclass(frozen=True)
class _Keys:
    """Columns with few bins share a key: the digits of a number that stays below ``KEY``."""

    groups: list[list[int]]
    sizes: dict[int, int]
    is_text: np.ndarray

    @classmethod
    def of(cls, columns: list[int], most: list[int], is_text: np.ndarray) -> _Keys:
        sizes, groups, width = {k: most[k] + 1 for k in columns}, [], KEY + 1
        for k in sorted(columns, key=lambda k: (sizes[k], k)):
            if width * sizes[k] > KEY:
                groups.append([])
                width = 1
            groups[-1].append(k)
            width *= sizes[k]
        return cls(groups, sizes, is_text)

    def digits(self, group: list[int]) -> Iterator[tuple[int, int]]:
        """Columns of a group with the numbers that their values are multiplied by."""
        place = 1
        for k in group:
            yield k, place
            place *= self.sizes[k]

    def width(self, group: list[int]) -> int:
        return int(np.prod([self.sizes[k] for k in group]))

    def of_bins(self, bins: np.ndarray) -> list[np.ndarray]:
        """A key of each row for every group; ``bins`` is columns by rows."""
        return [
            sum(bins[k].astype(np.min_scalar_type(self.width(g) - 1)) * place for k, place in self.digits(g))
            .astype(np.min_scalar_type(self.width(g) - 1))
            for g in self.groups
        ]

    def goes_left(self, keys: list[np.ndarray]) -> Callable:
        """For ``Tree.routed``."""
        at = {k: (i, place) for i, g in enumerate(self.groups) for k, place in self.digits(g)}

        def goes(feature: int, cut: int, rows: np.ndarray | None) -> np.ndarray:
            i, place = at[feature]
            key = keys[i] if rows is None else keys[i].take(rows)
            alone = len(self.groups[i]) == 1
            value = key if alone else np.arange(self.width(self.groups[i])) // place % self.sizes[feature]
            left = value == cut if self.is_text[feature] else value <= cut
            return left if alone else left.take(key)

        return goes


@dataclass
class _Chunk:
    """Rows of a task, all held out or none."""

    held: bool
    keys: list[np.ndarray]
    label: np.ndarray
    weight: np.ndarray
    margin: np.ndarray

    def moved(self, trees: list[Tree], goes_left: Callable) -> _Chunk:
        """With the trees added to the margins."""
        margin = self.margin.copy()
        for tree in trees:
            value = np.empty(len(margin))
            for node, rows in tree.routed(len(margin), goes_left):
                value[rows] = tree.value[node]
            margin += value
        return replace(self, margin=margin)

    def some(self, rows: np.ndarray) -> _Chunk:
        keys = [key.take(rows) for key in self.keys]
        return _Chunk(self.held, keys, self.label.take(rows), self.weight.take(rows), self.margin.take(rows))

    def loss(self) -> float:
        signed = np.where(self.label == 1, -self.margin, self.margin)
        return float((self.weight * np.logaddexp(0, signed)).sum())

    def gradients(self) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-self.margin))
        return np.rint(self.weight * (p - self.label) * UNIT), np.rint(self.weight * p * (1 - p) * UNIT)


def _chunks(keys: _Keys):
    """Written blocks put together, held-out rows apart."""

    def joined(parts: list[tuple[np.ndarray, ...]]) -> Iterator[_Chunk]:
        bins = np.concatenate([p[0] for p in parts], axis=1)
        label, weight, margin, held = (np.concatenate(x) for x in list(zip(*parts))[1:])
        whole = _Chunk(False, keys.of_bins(bins), label.astype("u1"), weight, margin)
        for which in (False, True):
            own = np.flatnonzero(held == which)
            if len(own):
                yield replace(whole.some(own), held=which)

    def run(rows: Iterator[Row]) -> Iterator[_Chunk]:
        parts, n = [], 0
        for r in rows:
            label, weight, margin, held = (np.frombuffer(r[c], kind) for c, kind in _CELLS.items())
            bins = np.frombuffer(r["bins"], f"u{r['width']}").reshape(-1, len(label))
            parts.append((bins, label, weight, margin, held))
            n += len(label)
            if n >= CHUNK:
                yield from joined(parts)
                parts, n = [], 0
        if parts:
            yield from joined(parts)

    return run


def _moved(keys: _Keys, trees: list[Tree]):
    return lambda chunks: (c.moved(trees, keys.goes_left(c.keys)) for c in chunks)


def _sums(keys: _Keys, trees: list[Tree], tree: Tree, counted: list[int]):
    """Held-out loss (with the root) and its weight, and the sums of the counted nodes, column after column."""
    at_root = counted == [0]

    def add_up(chunks: Iterator[_Chunk]) -> Iterator[tuple[float, float, bytes]]:
        widths = [keys.width(g) for g in keys.groups]
        # Whole numbers below 2**53 are exact as doubles.
        tables = [np.zeros((len(_TOTALS), len(counted) * w)) for w in widths]
        loss, weights = 0.0, 0.0
        for c in chunks:
            if c.held and not at_root:
                continue
            starts = dict.fromkeys(widths, 0)
            if not at_root:
                found = dict(tree.routed(len(c.margin), keys.goes_left(c.keys), counted))
                c = c.some(np.concatenate([found[i] for i in counted]))
                node = np.repeat(np.arange(len(counted)), [len(found[i]) for i in counted])
                starts = {w: node * w for w in starts}
            c = c.moved(trees, keys.goes_left(c.keys))
            if c.held:
                loss += c.loss()
                weights += float(c.weight.sum())
                continue
            g, h = c.gradients()
            for key, w, table in zip(c.keys, widths, tables):
                cell = key if at_root else starts[w] + key
                for total, values in zip(table, (g, h, None)):
                    total += np.bincount(cell, values, len(total))
        columns = {}
        for group, table in zip(keys.groups, tables):
            for k, place in keys.digits(group):
                # Summed over the digits above and below.
                split = table.reshape(len(_TOTALS), len(counted), -1, keys.sizes[k], place)
                columns[k] = split.sum(axis=(2, 4))
        yield loss, weights, np.concatenate([columns[k] for k in keys.sizes], axis=2).tobytes()

    return add_up


def _grow_by_sums(staged: DataFrame, keys: _Keys, settings: Settings) -> tuple[list[Tree], list[float]]:
    columns, sizes = list(keys.sizes), list(keys.sizes.values())
    starts = dict(zip(columns, np.cumsum([0, *sizes]).tolist()))
    # Columns side by side, short ones filled up with an empty cell.
    place = np.arange(max(sizes)) + np.array(list(starts.values()))[:, None]
    place = np.where(np.arange(max(sizes)) < np.array(sizes)[:, None], place, sum(sizes))
    text = keys.is_text[columns]

    def level(counted: list[int]) -> tuple[float | None, dict[int, np.ndarray]]:
        """Held-out loss, and the sums by columns and bins of every counted node."""
        found = rows.mapPartitions(_sums(keys, fresh, tree, counted)).collect()
        flat = np.zeros(len(_TOTALS) * len(counted) * sum(sizes))
        for *_, cells in found:
            flat += np.frombuffer(cells)
        flat = flat.astype(np.int64).reshape(len(_TOTALS), len(counted), -1)
        loss, weights = (sum(round(r[i] * UNIT) for r in found) for i in (0, 1))
        return loss / weights if weights else None, {node: flat[:, i] for i, node in enumerate(counted)}

    def best(sums: dict[int, np.ndarray]) -> list[dict]:
        """The best cut of each node, as the rows of ``_best``."""
        cells = np.stack(list(sums.values()), axis=1)
        cells = np.concatenate([cells, np.zeros((*cells.shape[:2], 1), np.int64)], axis=2)
        tables = cells[:, :, place]
        totals = tables[:, :, 0].sum(axis=2)
        n = len(columns)
        first, gain, left, none = _cuts(
            list(tables.reshape(len(_TOTALS), -1, max(sizes))), list(totals.repeat(n, axis=1)), np.tile(text, len(sums)), settings
        )
        # Of equal gains the first column.
        column = np.where(none, -1.0, gain).reshape(-1, n).argmax(axis=1)
        table = []
        for i, node in enumerate(sums):
            at = i * n + column[i]
            cut = (None if none[at] else float(gain[at]), int(first[at]), *(int(x[at]) for x in left))
            table.append(dict(zip(_BEST_NAMES, (node, columns[column[i]], *totals[:, i].tolist(), *cut))))
        return table

    def lighter(node: int, sums: np.ndarray) -> int:
        """The child of fewer rows."""
        start, cut = starts[tree.feature[node]], tree.cut[node]
        n = sums[2, start : start + keys.sizes[tree.feature[node]]]
        to_left = n[cut] if keys.is_text[tree.feature[node]] else n[: cut + 1].sum()
        return tree.left[node] + int(2 * to_left > n.sum())

    ensure_checkpoint_dir(staged.sparkSession)
    rows = staged.rdd.mapPartitions(_chunks(keys)).persist(StorageLevel.MEMORY_AND_DISK_DESER)
    trees, fresh, losses, moves = [], [], [], 0
    try:
        while len(trees) < settings.rounds:
            before = rows
            if len(fresh) == MOVE_EVERY:
                rows = before.mapPartitions(_moved(keys, fresh)).persist(StorageLevel.MEMORY_AND_DISK_DESER)
                fresh, moves = [], moves + 1
                if moves % CUT_EVERY == 0:
                    rows.checkpoint()
            tree, active = Tree(), [0]
            loss, sums = level(active)
            if rows is not before:
                before.unpersist()
            losses += [] if loss is None else [loss]
            if stopped(losses, settings.patience):
                break
            for depth in range(max(settings.depth, 1)):
                active = _grown(tree, active, best({i: sums[i] for i in active}), depth, settings)
                if not active or depth + 1 >= settings.depth:
                    break
                # The child of fewer rows is counted, the other one is the rest of its parent.
                parents = [i for i in sums if tree.left[i] >= 0 and {tree.left[i], tree.left[i] + 1} & set(active)]
                counted = [lighter(i, sums[i]) for i in parents]
                _, found = level(counted)
                for i, own in zip(parents, counted):
                    found[2 * tree.left[i] + 1 - own] = sums[i] - found[own]
                sums = found
            trees.append(tree)
            fresh = [*fresh, tree]
            if len(tree.feature) == 1:
                break  # nothing left to split
    finally:
        rows.unpersist()
    return trees, losses


def stopped(losses: list[float], patience: int) -> bool:
    """Whether the lowest loss is ``patience`` losses old."""
    return len(losses) > patience and min(losses[-patience:]) >= min(losses[:-patience])


def _with_margins(blocks: DataFrame, trees: list[Tree], is_text: np.ndarray) -> DataFrame:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("margin")
            margins = [
                (margin + sum(t.margins(bins, is_text) for t in trees)).tobytes()
                for bins, _, _, margin, _ in _blocks(batch)
            ]
            yield batch.set_column(at, "margin", pa.array(margins, pa.binary()))

    return blocks.mapInArrow(add, _BLOCK)


class BoostedTrees(Transformer, MLWritable, MLReadable):
    """Adds ``probability``, a vector of both classes' probabilities; null numbers count as 0."""

    def __init__(self, bins: Bins, base: float, trees: list[Tree]):
        super().__init__()
        self.bins, self.base, self.trees = bins, base, trees

    @property
    def getNumTrees(self) -> int:  # noqa: N802 - named as in MLlib
        return len(self.trees)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        trees, base, bins, is_text = self.trees, self.base, self.bins, self.bins.is_text()

        def score(inputs: pa.Array) -> pa.Array:
            matrix = bins.of(inputs.flatten().to_numpy().reshape(len(inputs), len(is_text)))
            margin = np.full(len(matrix), float(base))
            for t in trees:
                margin += t.margins(matrix, is_text)
            return pa.array(1 / (1 + np.exp(-margin)))

        p = F.arrow_udf(score, "double")(bins.inputs())
        both = F.transform(F.array(p), lambda x: F.array(1 - x, x))
        return dataset.withColumn("probability", array_to_vector(both[0]))

    def write(self) -> MLWriter:
        return _TreesWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TreesReader()


class _TreesWriter(MLWriter):
    def __init__(self, model: BoostedTrees):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model
        trees = [[t.feature, t.cut, t.left, t.value] for t in m.trees]
        extra = {"borders": m.bins.borders, "codes": m.bins.codes, "base": m.base, "trees": trees}
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extra)


class _TreesReader(MLReader):
    def load(self, path: str) -> BoostedTrees:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        bins = Bins(metadata["borders"], metadata["codes"])
        model = BoostedTrees(bins, metadata["base"], [Tree(*parts) for parts in metadata["trees"]])
        model._resetUid(metadata["uid"])
        return model

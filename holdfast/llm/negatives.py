"""Hard negatives by rotated one-bit codes with residual intervals.

An anchor's positives are its best other rows of the same label; for every positive, its hard negatives
are the best rows of other labels whose score lies between two percentages of the positive's. Scores
are inner products of the integer vectors ``floor(scale * x)``.

Every vector is turned by a fixed random rotation (sign flips and Hadamard transforms) and stored as
the signs of its turned components, one bit each, with its length and its alignment: the length of its
part along the code. A query is turned the same way and rounded to ``PLANES`` bits a component, so its
product with a code is a sum of popcounts. That product times the alignment estimates the score. What
the estimate leaves out is the product of the residuals of both beside the code, and of the rounding with
the vector; by Cauchy-Schwarz neither exceeds the product of the lengths. So every row has an
interval that certainly holds its score. Rows whose interval cannot reach the list are dropped, the others
are scored in integers. Rows of the highest estimates are scored first; scores to beat come from them, from the
lower ends and from the earlier shards of a task. No row that belongs to the result is ever dropped.

Rows are packed into shards, anchors into blocks. Anchors of up to ``BROADCAST_BYTES`` in all visit the
shards by a broadcast join, so that no shard moves; beyond that, blocks and shards meet in a join on both
numbers. Each task keeps the running best of its anchors and hands on at most that.

Rows with a null id, label or vector, or with a null or non-finite component, take no part. Shorter
vectors count as padded with zeros. Labels are whole numbers. Rows with one id are separate rows, but
an anchor never meets rows of its own id; a repeated anchor gives its results again. Ties go to the
smaller id. Where lengths are so large that a score could pass 64 bits, all rows are scored and sums wrap.
An empty table, or one without anchors, gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.common import column, own_columns, stage

SHARD_ROWS = 8192
ANCHOR_ROWS = 1024
BROADCAST_BYTES = 8 << 20
HELD_LISTS = 1 << 18
PLANES = 6
AHEAD = 4  # times the length of a list: rows that are scored first
MARGIN = 1e-9  # of the product of two lengths, for rounding in floating point
LEAST = np.iinfo(np.int64).min

_PACKED = pa.schema(
    [("block", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("matrix", pa.binary())]
)


def integer_rows(vectors: DataFrame, id_col: str, label_col: str, vector_col: str, scale: float) -> DataFrame:
    """id, label, components of the rows that take part."""
    own = own_columns(vectors, id_col, label_col, vector_col).toDF("id", "label", "vector")
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    return own.filter("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").filter(good).select(
        F.col("id").cast("bigint"),
        F.col("label").cast("bigint"),
        F.transform("vector", lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("components"),
    )


def _packed(rows: DataFrame, per_block: int) -> tuple[DataFrame, int]:
    """Rows in blocks of about ``per_block``, numbered from 0; and how many blocks there are at most."""
    n = max(1, -(-rows.count() // per_block))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches([b for b in batches if b.num_rows] or [_NONE])
        if held.num_rows == 0:
            return
        lists = column(held, "components")
        sizes = lists.value_lengths().to_numpy().astype(np.int64)
        width = max(int(sizes.max(initial=0)), 1)
        matrix = np.zeros((len(sizes), width), np.int64)
        matrix[np.arange(width)[None, :] < sizes[:, None]] = lists.flatten().to_numpy()
        ids, labels = (column(held, name).to_numpy() for name in ("id", "label"))
        order = np.lexsort((ids, labels))
        yield pa.RecordBatch.from_pydict(
            {
                "block": [TaskContext.get().partitionId()],
                "width": [width],
                "ids": [ids[order].astype(np.int64).tobytes()],
                "labels": [labels[order].astype(np.int64).tobytes()],
                "matrix": [_narrow(matrix[order]).tobytes()],
            },
            schema=_PACKED,
        )

    packed = rows.repartition(n).mapInArrow(pack, "block int, width int, ids binary, labels binary, matrix binary")
    return packed, n


_NONE = pa.RecordBatch.from_pydict(
    {"id": pa.array([], pa.int64()), "label": pa.array([], pa.int64()), "components": pa.array([], pa.list_(pa.int64()))}
)


def _narrow(matrix: np.ndarray) -> np.ndarray:
    """The same numbers in the fewest bytes."""
    for kind in (np.int16, np.int32):
        limits = np.iinfo(kind)
        if matrix.min(initial=0) >= limits.min and matrix.max(initial=0) <= limits.max:
            return matrix.astype(kind)
    return matrix


class Rows:
    """Ids, labels and integer vectors of a block, in order of label and id."""

    def __init__(self, ids: bytes, labels: bytes, matrix: bytes, width: int):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        size = len(matrix) // max(len(self.ids) * width, 1)
        self.matrix = np.frombuffer(matrix, f"<i{size}").reshape(len(self.ids), width)

    def wide(self, width: int) -> np.ndarray:
        """Vectors padded with zeros."""
        return np.pad(self.matrix, ((0, 0), (0, width - self.matrix.shape[1])))


# --- codes ---------------------------------------------------------------------------------------


def turned(matrix: np.ndarray) -> np.ndarray:
    """Vectors padded to a power of two, 64 at least, and rotated."""
    n, width = matrix.shape
    size = max(64, 1 << (width - 1).bit_length())
    out = np.zeros((n, size))
    out[:, :width] = matrix
    flips = np.random.default_rng(20).choice([-1.0, 1.0], (3, size))
    for signs in flips:
        out *= signs
        half = 1
        while half < size:
            pairs = out.reshape(n, size // (2 * half), 2, half)
            pairs = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2)
            out = pairs.reshape(n, size)
            half *= 2
        out /= np.sqrt(size)
    return out


def _bits(flags: np.ndarray) -> np.ndarray:
    return np.packbits(flags, axis=1, bitorder="little").view("<u8")


class Codes:
    """One-bit codes of vectors, their lengths, and their lengths along and beside the code."""

    def __init__(self, matrix: np.ndarray):
        y = turned(matrix)
        self.words = _bits(y >= 0)
        self.length = np.sqrt((y * y).sum(axis=1))
        self.along = np.abs(y).sum(axis=1) / np.sqrt(y.shape[1])
        self.beside = np.sqrt(np.maximum(self.length**2 - self.along**2, 0))


class Asked:
    """A block of queries, turned and rounded to bit planes."""

    def __init__(self, matrix: np.ndarray):
        z = turned(matrix)
        self.size = z.shape[1]
        low = z.min(axis=1, keepdims=True)
        step = (z.max(axis=1, keepdims=True) - low) / ((1 << PLANES) - 1)
        level = np.rint((z - low) / np.where(step > 0, step, 1)).astype(np.int64)
        rounded = low + level * step
        self.low, self.step = low[:, 0], step[:, 0]
        self.levels = level.sum(axis=1)
        self.planes = [_bits((level >> b) & 1 == 1) for b in range(PLANES)]
        self.length = np.sqrt((z * z).sum(axis=1))
        self.rounded_square = (rounded * rounded).sum(axis=1)
        self.lost = np.sqrt(((z - rounded) ** 2).sum(axis=1))

    def interval(self, i: int, codes: Codes, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """Ends that certainly enclose the scores of query ``i`` with some rows."""
        words = codes.words[rows]
        ones = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
        level = np.zeros(len(words), np.int64)
        for b, plane in enumerate(self.planes):
            level += np.bitwise_count(words & plane[i]).sum(axis=1, dtype=np.int64) << b
        # Product of the rounded query with the code of signs, over the code's length.
        code = (self.low[i] * (2 * ones - self.size) + self.step[i] * (2 * level - self.levels[i])) / np.sqrt(self.size)
        across = np.sqrt(np.maximum(self.rounded_square[i] - code * code, 0))
        length = codes.length[rows]
        half = codes.beside[rows] * across + (self.lost[i] + MARGIN * self.length[i]) * length + 1e-6
        middle = codes.along[rows] * code
        return middle - half, middle + half


# --- one visit -----------------------------------------------------------------------------------


class Best:
    """The best rows of one list so far."""

    __slots__ = ("ids", "k", "scores")

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def to_beat(self) -> float:
        return float(self.scores[-1]) if len(self.scores) == self.k else -np.inf

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(scores):
            return
        if len(scores) > self.k:
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[scores >= least], ids[scores >= least]
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


def _kth(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def _highest(values: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest values of some rows, in no order."""
    rows = np.flatnonzero(among)
    return rows if len(rows) <= k else rows[np.argpartition(-values[rows], k)[:k]]


class Shard:
    """Rows of a shard with their codes; counts the rows it scores in integers."""

    def __init__(self, rows: Rows, width: int):
        self.ids, self.labels = rows.ids, rows.labels
        self.matrix = rows.wide(width)
        self.codes = Codes(self.matrix)
        self.top = float(np.abs(self.matrix.astype(float)).max(initial=0))
        self.wide = self.matrix.astype(np.int64)
        self.exact = self.matrix.astype(np.float64)
        self.scored = 0

    def scores(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        self.scored += len(rows)
        bound = float(np.abs(query.astype(float)).max(initial=0)) * self.top * len(query)
        if bound < float(1 << 53):
            return (self.exact[rows] @ query.astype(np.float64)).astype(np.int64)
        with np.errstate(over="ignore"):
            return self.wide[rows] @ query.astype(np.int64)

    def may_wrap(self, query: np.ndarray) -> bool:
        return float(np.abs(query.astype(float)).max(initial=0)) * self.top * len(query) >= float(1 << 62)

    def positives(self, asked: Asked, i: int, query: np.ndarray, own: int, label: int, best: Best) -> None:
        first, last = np.searchsorted(self.labels, [label, label + 1])
        lower, upper = asked.interval(i, self.codes, slice(first, last))
        live = self.ids[first:last] != own
        if self.may_wrap(query):
            self._add(query, first + np.flatnonzero(live), [best])
            return
        live &= upper >= max(best.to_beat(), _kth(lower[live], best.k))
        # The rows of the highest estimates come first: their scores are what the others must beat.
        ahead = _highest(lower + upper, live, AHEAD * best.k)
        self._add(query, first + ahead, [best])
        live[ahead] = False
        live &= upper >= best.to_beat()
        self._add(query, first + np.flatnonzero(live), [best])

    def negatives(
        self, asked: Asked, i: int, query: np.ndarray, own: int, label: int,
        ranges: list[tuple[int, int]], lists: list[Best],
    ) -> None:
        other = (self.labels != label) & (self.ids != own)
        if self.may_wrap(query):
            self._add(query, np.flatnonzero(other), lists, ranges)
            return
        lower, upper = asked.interval(i, self.codes, slice(0, len(self.ids)))

        def may_enter() -> np.ndarray:
            wanted = np.zeros(len(other), bool)
            for (low, high), best in zip(ranges, lists):
                if low <= high:
                    wanted |= (upper >= max(float(low), best.to_beat())) & (lower <= high)
            return wanted & other

        live = may_enter()
        done = np.zeros(len(other), bool)
        for (_, high), best in zip(ranges, lists):
            ahead = _highest(lower + upper, live & ~done & (lower + upper <= 2 * high), AHEAD * best.k)
            self._add(query, ahead, lists, ranges)
            done[ahead] = True
        self._add(query, np.flatnonzero(may_enter() & ~done), lists, ranges)

    def _add(self, query: np.ndarray, rows: np.ndarray, lists: list[Best], ranges=None) -> None:
        """Scores rows in integers and offers them to the lists whose range they are in."""
        scores = self.scores(query, rows)
        for k, best in enumerate(lists):
            some = slice(None) if ranges is None else (scores >= ranges[k][0]) & (scores <= ranges[k][1])
            best.add(scores[some], self.ids[rows[some]])


_LISTS = "q_block int, q_row int, place int, anchor_id bigint, id bigint, score bigint"


def _visit(k: int, low_percent: int | None, high_percent: int | None):
    """Streams visits of anchor blocks to shards; the best rows of every list of a task."""

    def emit(held: dict) -> Iterator[pa.RecordBatch]:
        for block, (ids, lists) in held.items():
            rows = [(row, place, ids[row], best) for (row, place), best in lists.items() if len(best.ids)]
            if rows:
                sizes = [len(best.ids) for *_, best in rows]
                columns = [np.repeat([r[c] for r in rows], sizes) for c in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(sum(sizes), block), pa.int32()),
                        pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()),
                        pa.array(np.concatenate([best.ids for *_, best in rows])),
                        pa.array(np.concatenate([best.scores for *_, best in rows])),
                    ],
                    names=["q_block", "q_row", "place", "anchor_id", "id", "score"],
                )

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        n_held = 0
        shard_key, shard, asked_key = None, None, None
        for batch in batches:
            for row in range(batch.num_rows):
                value = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
                width = max(value["q_width"], value["width"])
                if asked_key != (value["q_block"], width):
                    asked_key = (value["q_block"], width)
                    anchors = Rows(value["q_ids"], value["q_labels"], value["q_matrix"], value["q_width"])
                    queries = anchors.wide(width)
                    asked = Asked(queries)
                if shard_key != (value["block"], width):
                    shard_key = (value["block"], width)
                    shard = Shard(Rows(value["ids"], value["labels"], value["matrix"], value["width"]), width)
                _, lists = held.setdefault(value["q_block"], (anchors.ids, {}))
                n_held -= len(lists)
                if low_percent is None:
                    for i in range(len(queries)):
                        best = lists.setdefault((i, 0), Best(k))
                        shard.positives(asked, i, queries[i], int(anchors.ids[i]), int(anchors.labels[i]), best)
                else:
                    positives: dict[int, list] = {}
                    for i, place, score in zip(value["q_rows"], value["q_places"], value["q_scores"]):
                        positives.setdefault(i, []).append((place, score))
                    for i, each in positives.items():
                        ranges = [(-(-low_percent * score // 100), high_percent * score // 100) for _, score in each]
                        some = [lists.setdefault((i, place), Best(k)) for place, _ in each]
                        own, label = int(anchors.ids[i]), int(anchors.labels[i])
                        shard.negatives(asked, i, queries[i], own, label, ranges, some)
                n_held += len(lists)
                if n_held > HELD_LISTS:
                    yield from emit(held)
                    held, n_held = {}, 0
        yield from emit(held)

    return visit


# --- Spark ---------------------------------------------------------------------------------------


def _visits(asked: DataFrame, n_asked: int, shards: DataFrame, n_shards: int, small: bool) -> DataFrame:
    """Every anchor block next to every shard."""
    if small:
        # One bucket of blocks, by a key that Spark cannot fold: a hash join, not a nested loop.
        bucket = lambda name: F.pmod(F.col(name), F.lit(1)).alias("bucket")
        return shards.select("*", bucket("block")).join(
            F.broadcast(asked.select("*", bucket("q_block"))), "bucket"
        ).drop("bucket")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return (
        shards.withColumn("q_block", every(n_asked))
        .join(asked.withColumn("block", every(n_shards)).hint("merge"), ["q_block", "block"])
    )


def _merged(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q_block", "q_row", "place").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    n_positives: int = 5,
    n_negatives: int = 3,
    low_percent: int = 50,
    high_percent: int = 95,
    scale: float = 256.0,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    anchor_rows: int = ANCHOR_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on the columns ``id`` and ``label``.
    """
    rows = stage(integer_rows(vectors, id_col, label_col, vector_col, scale), "integer_vectors")
    shards, n_shards = _packed(rows, shard_rows)
    shards = stage(shards, "shards")
    asked, n_asked = _packed(rows.filter(is_anchor), anchor_rows)
    names = {name: f"q_{name}" for name in _PACKED.names}
    asked = stage(asked.withColumnsRenamed(names), "anchors")
    size = asked.agg(F.sum(F.length("q_ids") + F.length("q_labels") + F.length("q_matrix"))).first()[0] or 0
    small = size <= broadcast_bytes

    first = _visits(asked, n_asked, shards, n_shards, small).mapInArrow(_visit(n_positives, None, None), _LISTS)
    best = stage(_merged(first, n_positives).drop("place"), "positives")
    # At most n_positives entries for each of the anchors of a block.
    known = best.groupBy(F.col("q_block")).agg(F.sort_array(F.collect_list(F.struct("q_row", "rank", "score"))).alias("p"))
    known = known.select(
        "q_block", F.col("p.q_row").alias("q_rows"), F.col("p.rank").alias("q_places"), F.col("p.score").alias("q_scores")
    )
    asked = stage(asked.join(known, "q_block"), "anchors_with_positives")
    second = _visits(asked, n_asked, shards, n_shards, small).mapInArrow(
        _visit(n_negatives, low_percent, high_percent), _LISTS
    )
    found = _merged(second, n_negatives).select(
        "q_block", "q_row", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    positives = best.select(
        "q_block", "q_row", F.col("rank").alias("place"), "anchor_id",
        F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
    )
    return found.join(positives, ["q_block", "q_row", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )

"""Spelling variants: words within one edit of each other, by k-d trees over letter counts.

Words are maximal runs of the letters a-z and U+00C0 to U+00FF; only A-Z is lower-cased. A word is
a point of letter counts. One replaced letter moves it by an L1 distance of two at the same length,
one inserted or deleted letter by one at the next length. So two kinds of range search find all
candidates: radius two among words of the same length, radius one between neighbouring lengths.

Counts are written in unary, two bits a letter: the number of differing bits never exceeds the L1
distance, and one bit is one axis of the tree. A split sends the points without the bit left, those
with it right; a node's box is the AND and the OR of its points, and a query leaves a node whose box is
beyond the radius. Candidates that survive are compared letter by letter, which decides.

The trees are distributed by length: the best balanced axes of a length cut it into cells (the upper
levels), every word is stored in one cell and asked in each cell within its radius. Cells that hold
more than ``CELL`` words are cut into chunks by hash, each asked in full. A task holds one chunk, streams
its queries in slices and returns one row per word and slice, not pairs. Points with equal counts cannot
be split by any axis; where a leaf has many of them they are matched by their spellings with one letter
masked or deleted, which is linear.

Null and empty texts have no words. A run of a document whose id is null is never changed by the planted
deletions of ``planted_every``. Repeated rows count as often as they occur. Ties go to the word that comes
first in code-point order. Long texts are read whole, in slices that end between words; long words
are words like any other. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import clustered, column, grouped, own_columns, stage

LEAST_LETTERS, LEAST_COUNT = 5, 3
CELL = 1 << 15  # stored words of a task
LEAF = 32
MOST_LEVELS = 16
PARTS = 4  # queries of a full chunk are read in so many parts
SLICE = 1 << 16  # queries in flight
TEXT_SLICE = 1 << 20
HELD_WORDS = 1 << 17
MOST_PAIRS = 1 << 20
BITS = 192  # 26 and 64 letters, two bits each, in three words
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_GAP = re.compile("[^A-Za-zÀ-ÿ]")
_LOWER = {65 + k: 97 + k for k in range(26)}


# --- words and their numbers ---------------------------------------------------------------------


def _runs(text: str) -> Iterator[Counter]:
    """Counts of the lower-cased runs, slice by slice."""
    at = 0
    while at < len(text):
        end = min(at + TEXT_SLICE, len(text))
        gap = _GAP.search(text, end) if end < len(text) else None
        end = gap.start() if gap else (end if end == len(text) else len(text))
        yield Counter(_RUN.findall(text[at:end].translate(_LOWER)))
        at = end


def words(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_letters: int = LEAST_LETTERS,
    least_count: int = LEAST_COUNT,
    planted_every: int | None = None,
) -> DataFrame:
    """word, n: all words of at least ``least_letters`` letters that occur ``least_count`` times.

    With ``planted_every``, a run whose CRC-32 of ``<id>:<run>`` it divides loses the letter at that
    CRC modulo its length.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for k in range(len(ids)):
                doc, text = ids[k].as_py(), texts[k].as_py()
                if not text:
                    continue
                prefix = zlib.crc32(f"{doc}:".encode())
                for found in _runs(text):
                    if planted_every and doc is not None:
                        for run, n in found.items():
                            h = zlib.crc32(run.encode(), prefix)
                            if h % planted_every == 0:
                                cut = h % len(run)
                                run = run[:cut] + run[cut + 1 :]
                            if len(run) >= least_letters:
                                held[run] += n
                    else:
                        for run, n in found.items():
                            if len(run) >= least_letters:
                                held[run] += n
                    if len(held) >= HELD_WORDS:
                        yield _counted(held)
                        held = Counter()
        if held:
            yield _counted(held)

    counted = own_columns(documents, id_col, text_col).mapInArrow(count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _counted(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"]
    )


# --- points --------------------------------------------------------------------------------------


def _masks() -> tuple[np.ndarray, np.ndarray]:
    """For each code below 256: the bits of a first and of a further occurrence of that letter."""
    once, twice = np.zeros((256, 3), np.uint64), np.zeros((256, 3), np.uint64)
    codes = [*range(97, 123), *range(0xC0, 0x100)]
    for k, code in enumerate(codes):
        once[code, 2 * k // 64] = np.uint64(1) << np.uint64(2 * k % 64)
        twice[code, 2 * k // 64] = np.uint64(1) << np.uint64(2 * k % 64 + 1)
    return once, twice


_ONCE, _TWICE = _masks()


def letters(values: pa.Array, length: int) -> np.ndarray:
    """Words of one length as a matrix of Latin-1 codes."""
    joined = "".join(values.to_pylist()).encode("latin-1")
    return np.frombuffer(joined, np.uint8).reshape(len(values), length)


def points(matrix: np.ndarray) -> np.ndarray:
    """Letter counts in unary, capped at two."""
    out = np.zeros((len(matrix), 3), np.uint64)
    for k in range(matrix.shape[1]):
        once, twice = _ONCE[matrix[:, k]], _TWICE[matrix[:, k]]
        out |= np.where((out & once) == once, twice, once)
    return out


def _bit(points_: np.ndarray, axis: int) -> np.ndarray:
    return (points_[:, axis >> 6] >> np.uint64(axis & 63)) & np.uint64(1) != 0


def _set_bits(points_: np.ndarray) -> np.ndarray:
    """How many points have each bit."""
    flat = np.ascontiguousarray(points_.astype("<u8")).view(np.uint8)
    return np.unpackbits(flat, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


class Tree:
    """k-d tree over points; a leaf holds at most ``LEAF`` points, or points that are all equal."""

    def __init__(self, points_: np.ndarray):
        self.points = points_
        self.order = np.arange(len(points_))
        # left and right child, or (-1, -1) and the range of ``order``
        self.children: list[tuple[int, int]] = []
        self.range: list[tuple[int, int]] = []
        self.all, self.any = [], []
        todo = [(0, len(points_), -1, 0)]
        while todo:
            a, b, up, side = todo.pop()
            node = len(self.children)
            own = points_[self.order[a:b]]
            self.children.append((-1, -1))
            self.range.append((a, b))
            self.all.append(np.bitwise_and.reduce(own, axis=0))
            self.any.append(np.bitwise_or.reduce(own, axis=0))
            if up >= 0:
                pair = list(self.children[up])
                pair[side] = node
                self.children[up] = tuple(pair)
            if b - a <= LEAF or (self.all[-1] == self.any[-1]).all():
                continue
            axis = int(np.argmin(np.abs(2 * _set_bits(own) - (b - a))))
            right = _bit(own, axis)
            self.order[a:b] = np.concatenate([self.order[a:b][~right], self.order[a:b][right]])
            cut = a + int((~right).sum())
            todo += [(cut, b, node, 1), (a, cut, node, 0)]

    def near(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Queries and the points of a leaf whose box they reach, leaf by leaf."""
        if not len(self.points):
            return
        todo = [(0, np.arange(len(queries)))]
        while todo:
            node, asked = todo.pop()
            q = queries[asked]
            outside = (q & ~self.any[node]) | (self.all[node] & ~q)
            asked = asked[np.bitwise_count(outside).sum(axis=1) <= radius]
            if not len(asked):
                continue
            left, right = self.children[node]
            if left < 0:
                a, b = self.range[node]
                yield asked, self.order[a:b]
            else:
                todo += [(left, asked), (right, asked)]


# --- letter order --------------------------------------------------------------------------------


def one_edit(long: np.ndarray, short: np.ndarray) -> np.ndarray:
    """Whether each word of ``long`` becomes the one of ``short`` by one replaced or one deleted letter."""
    width = short.shape[1]
    if long.shape[1] == width:
        return (long != short).sum(axis=1) == 1
    ahead = np.logical_and.accumulate(long[:, :width] == short, axis=1).sum(axis=1)
    behind = np.logical_and.accumulate((long[:, 1:] == short)[:, ::-1], axis=1).sum(axis=1)
    return ahead + behind >= width


def _as_keys(matrix: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(matrix).view(f"S{matrix.shape[1]}").ravel()


def _spellings(matrix: np.ndarray, delete: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of every spelling with one letter masked (the key says where) or deleted."""
    n, width = matrix.shape
    keys = []
    for k in range(width):
        if delete:
            part = np.delete(matrix, k, axis=1)
        else:
            part = matrix.copy()
            part[:, k] = 0
        keys.append(_as_keys(part))
    return np.tile(np.arange(n), width), np.concatenate(keys)


def _by_spelling(queries: np.ndarray, stored: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within one edit, by sorted spellings; for many stored words with equal counts."""
    longer = queries.shape[1] > stored.shape[1]
    rows, keys = _spellings(queries, longer)
    if longer:
        at, wanted = np.arange(len(stored)), _as_keys(stored)
    else:
        at, wanted = _spellings(stored, False)
    order = np.argsort(wanted, kind="stable")
    first = np.searchsorted(wanted[order], keys, side="left")
    counts = np.searchsorted(wanted[order], keys, side="right") - first
    total = int(counts.sum())
    ends = np.cumsum(counts)
    hits = np.arange(total) + np.repeat(first - (ends - counts), counts)
    pairs = np.unique(np.stack([np.repeat(rows, counts), at[order][hits]], axis=1), axis=0)
    q, s = pairs[:, 0], pairs[:, 1]
    good = one_edit(queries[q], stored[s])
    return q[good], s[good]


class _Best:
    """Number of near words and the best of them, for words of one matrix."""

    def __init__(self, size: int):
        self.count = np.zeros(size, np.int64)
        self.n = np.full(size, -1, np.int64)
        self.rank = np.zeros(size, np.int64)

    def add(self, rows: np.ndarray, n: np.ndarray, rank: np.ndarray) -> None:
        """Near words of ``rows`` with their numbers and their place in code-point order."""
        if not len(rows):
            return
        np.add.at(self.count, rows, 1)
        order = np.lexsort((rank, -n, rows))
        rows, n, rank = rows[order], n[order], rank[order]
        first = np.concatenate([[True], rows[1:] != rows[:-1]])
        rows, n, rank = rows[first], n[first], rank[first]
        better = (n > self.n[rows]) | ((n == self.n[rows]) & (rank < self.rank[rows]))
        rows, n, rank = rows[better], n[better], rank[better]
        self.n[rows], self.rank[rows] = n, rank


def _ranks(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(_as_keys(matrix), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return order, rank


_FOUND = pa.schema(
    [("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())]
)


def _rows(words_: pa.Array, best: _Best, of: pa.Array, order: np.ndarray) -> pa.RecordBatch:
    some = np.flatnonzero(best.count)
    return pa.RecordBatch.from_arrays(
        [
            words_.take(pa.array(some)), pa.array(best.count[some]), pa.array(best.n[some]),
            of.take(pa.array(order[best.rank[some]])),
        ],
        schema=_FOUND,
    )


class _Cell:
    """The stored words of one chunk."""

    def __init__(self, rows: pa.Table, length: int):
        self.words, self.n = column(rows, "word"), column(rows, "n").to_numpy()
        self.matrix = letters(self.words, length)
        self.tree = Tree(points(self.matrix))
        self.order, self.rank = _ranks(self.matrix)

    def ask(self, words_: pa.Array, n: np.ndarray, length: int) -> Iterator[pa.RecordBatch]:
        """What a slice of queries of one length finds, and what the stored words find in longer queries."""
        longer = length > self.matrix.shape[1]
        matrix = letters(words_, length)
        order, rank = _ranks(matrix)
        mine, theirs = _Best(len(n)), _Best(len(self.n))
        for q, s in self._pairs(matrix, points(matrix), 1 if longer else 2):
            mine.add(q, self.n[s], self.rank[s])
            if longer:
                theirs.add(s, n[q], rank[q])
        yield _rows(words_, mine, self.words, self.order)
        if longer:
            yield _rows(self.words, theirs, words_, order)

    def _pairs(self, matrix: np.ndarray, points_: np.ndarray, radius: int):
        held_q, held_s, held = [], [], 0
        for asked, leaf in self.tree.near(points_, radius):
            if len(leaf) > 2 * LEAF:
                q, s = _by_spelling(matrix[asked], self.matrix[leaf])
                yield asked[q], leaf[s]
                continue
            for first in range(0, len(asked), MOST_PAIRS // len(leaf)):
                some = asked[first : first + MOST_PAIRS // len(leaf)]
                apart = np.zeros((len(some), len(leaf)), np.uint8)
                for k in range(points_.shape[1]):
                    apart += np.bitwise_count(points_[some, k][:, None] ^ self.tree.points[leaf, k][None, :])
                i, j = np.nonzero(apart <= radius)
                held_q.append(some[i])
                held_s.append(leaf[j])
                held += len(i)
                if held >= MOST_PAIRS:
                    yield self._checked(matrix, held_q, held_s)
                    held_q, held_s, held = [], [], 0
        if held:
            yield self._checked(matrix, held_q, held_s)

    def _checked(self, matrix, held_q, held_s):
        q, s = np.concatenate(held_q), np.concatenate(held_s)
        good = one_edit(matrix[q], self.matrix[s])
        return q[good], s[good]


# --- cells ---------------------------------------------------------------------------------------


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    lengths = pc.utf8_length(batch.column("word")).to_numpy()
    for length in np.unique(lengths).tolist():
        part = batch.take(pa.array(np.flatnonzero(lengths == length)))
        yield length, part, points(letters(part.column("word"), length))


def _axis_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for length, part, own in _by_length(batch):
            n = _set_bits(own)
            yield pa.RecordBatch.from_pydict(
                {
                    "length": pa.array(np.full(BITS, length), pa.int32()), "axis": pa.array(np.arange(BITS), pa.int32()),
                    "n_set": pa.array(n), "n": pa.array(np.full(BITS, part.num_rows)),
                }
            )


def upper_levels(vocabulary: DataFrame, cell: int = CELL) -> dict[int, list[int]]:
    """Axes of the upper levels for every length of more than ``cell`` words, best balanced first.

    The driver sees at most ``BITS`` rows for each such length.
    """
    counts = vocabulary.select("word").mapInArrow(_axis_counts, "length int, axis int, n_set bigint, n bigint")
    totals = counts.groupBy("length", "axis").agg(F.sum("n_set").alias("n_set"), F.sum("n").alias("n"))
    out: dict[int, list] = {}
    for r in totals.filter(F.col("n") > cell).collect():
        out.setdefault(r.length, []).append((abs(2 * r.n_set - r.n), r.axis, r.n))
    return {
        length: [axis for _, axis, n in sorted(rows)[: min(MOST_LEVELS, (rows[0][2] // cell).bit_length())]]
        for length, rows in out.items()
    }


def _cells(own: np.ndarray, axes: list[int]) -> np.ndarray:
    cell = np.zeros(len(own), np.int64)
    for k, axis in enumerate(axes):
        cell |= _bit(own, axis).astype(np.int64) << k
    return cell


def _flips(levels: int, radius: int) -> list[int]:
    """Differences of cell numbers within ``radius`` levels."""
    return [
        sum(1 << k for k in some) for n in range(min(radius, levels) + 1) for some in combinations(range(levels), n)
    ]


def _routed(vocabulary: DataFrame, levels: dict[int, list[int]], queries: bool) -> DataFrame:
    """length (of the stored words), cell, word, n; one row where a word is stored, or each where it is asked."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, part, own in _by_length(batch):
                for stored, radius in ((length, 2), (length - 1, 1)) if queries else ((length, 0),):
                    axes = levels.get(stored, [])
                    cell = _cells(own, axes)
                    for flip in _flips(len(axes), radius):
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(part.num_rows, stored), pa.int32()), pa.array(cell ^ flip),
                                part.column("word"), part.column("n"),
                            ],
                            names=["length", "cell", "word", "n"],
                        )

    return vocabulary.mapInArrow(route, "length int, cell bigint, word string, n bigint")


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, cell = None, None
    for group in grouped(batches, ["length", "cell", "chunk", "part"]):
        *now, part = (column(group, name)[0].as_py() for name in ("length", "cell", "chunk", "part"))
        if part < 0:
            key, cell = now, _Cell(group, now[0])
            continue
        if key != now:
            continue  # nothing is stored here
        lengths = pc.utf8_length(column(group, "word")).to_numpy()
        for length in np.unique(lengths).tolist():
            rows = group.filter(pa.array(lengths == length))
            for first in range(0, rows.num_rows, SLICE):
                some = rows.slice(first, SLICE)
                yield from cell.ask(column(some, "word"), column(some, "n").to_numpy(), length)


def near_words(vocabulary: DataFrame, cell: int = CELL) -> DataFrame:
    """word, n_near, best_n, best: number of near words and the commonest, for words that have any.

    ``vocabulary`` holds each word once, with its number n.
    """
    levels = upper_levels(vocabulary, cell)
    stored = _routed(vocabulary, levels, queries=False)
    # Long words weigh more; a chunk stays near 64 bytes times ``cell``.
    weight = F.count("*") * (F.col("length") + 32) / (64 * cell)
    chunks = stored.groupBy("length", "cell").agg(
        F.ceil(weight).cast("int").alias("chunks"), F.ceil(PARTS * weight / F.ceil(weight)).cast("int").alias("parts")
    )
    chunks = stage(chunks, "chunks")
    at = F.xxhash64("word")
    homes = stored.join(chunks, ["length", "cell"]).select(
        "length", "cell", F.pmod(at, "chunks").cast("int").alias("chunk"), F.lit(-1).alias("part"), "word", "n"
    )
    asked = _routed(vocabulary, levels, queries=True).join(chunks, ["length", "cell"])
    asked = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    asked = asked.select(
        "length", "cell", "chunk", F.pmod(F.shiftrightunsigned(at, 20), "parts").cast("int").alias("part"),
        "word", "n",
    )
    found = clustered(homes.union(asked), ["length", "cell", "chunk"], ["part"]).mapInArrow(
        _ask, "word string, n_near bigint, best_n bigint, best string"
    )
    first = F.min(F.struct((-F.col("best_n")).alias("minus"), "best")).alias("first")
    return (
        found.groupBy("word")
        .agg(F.sum("n_near").alias("n_near"), first)
        .select("word", "n_near", (-F.col("first.minus")).alias("best_n"), F.col("first.best").alias("best"))
    )


def variants(vocabulary: DataFrame, times: int = 2, cell: int = CELL) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``vocabulary``.

    The form is the commonest near word, if it occurs at least ``times`` as often. A chain of forms
    grows by that factor at each step, so it ends after the logarithm of the largest number, and
    following it by doubling takes the logarithm of that.
    """
    vocabulary = stage(vocabulary.select("word", "n"), "vocabulary")
    found = vocabulary.join(near_words(vocabulary, cell), "word", "left")
    good = F.col("best_n") >= times * F.col("n")
    rows = stage(
        found.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n"),
        ),
        "forms",
    )
    # Only words with a form move; a word without one is its own root and needs no row.
    root = stage(rows.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        after = root.select(F.col("word").alias("root"), F.col("root").alias("further"))
        root = stage(
            root.join(after, "root", "left").select(
                "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
            ),
            "roots",
        )
        if root.filter("moved").isEmpty():
            break
        root = root.drop("moved")
    return rows.join(root.select("word", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )

"""Near-duplicates by HyperMinHash, confirmed on full shingle sets.

Each bucket of a sketch is the smallest of one hash over a document's shingles, kept as a count of
leading zeros and ten mantissa bits. Sketches are cut into bands; documents that agree in a band are
candidates. Band keys are counted first, and a bitmap of those met twice lets only rows that can find a
partner through the next shuffle. Compressed registers (a byte each) estimate Jaccard, corrected for
registers that collide by chance; a pair above the threshold less a margin is confirmed on the full
sets of 64-bit shingle hashes, made from whole texts.

Every member of a band group meets the group's first node, its hub: a group of m copies costs m pairs,
not m squared. Where members stay apart from their hub, the group's registers are compared, but for
pairs that the hub joins already, and a maximum spanning forest of the estimates is confirmed. Where
one of its edges fails, documents that the trees had joined may still be linked by pairs outside the
trees: such a cluster gets its full sets once, cut into chunks, and every pair of different components
whose estimate fits is compared there; only a forest of the links found leaves a task.

Documents with equal sets are one node. Band groups that repeat in other bands are compared once.
Large groups are cut into chunks, and every pair of chunks is a task of its own.

Null or blank text has no shingles and is linked with nothing. Rows without doc_id take part; a
component is named by its smallest doc_id. Rows of one doc_id are separate documents. An empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.common import (
    U64,
    Piece,
    RangeHash,
    clustered,
    column,
    combine,
    grouped,
    lower_ascii,
    mix,
    pieces,
    possibly_in,
    shielded,
    stage,
    words,
)
from holdfast.llm.components import components, stars

BANDS, ROWS = 40, 5
REGISTERS = BANDS * ROWS
MANTISSA = 10
CHUNK = 1024
MARGIN = 0.18  # a pair at 0.8 has a lower estimate with probability 4e-9; it shares no band with 1.3e-7

_random = np.random.default_rng(20240501)
_FACTOR = _random.integers(0, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1)
_FLIP = _random.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)


# --- sets and sketches ---------------------------------------------------------------------------


def shingle_sets(piece: Piece, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; one for the whole row if it has fewer words."""
    w = words(piece)
    counts = np.diff(w.bounds)
    h = RangeHash(lower_ascii(piece.data))(w.starts, w.ends)
    n = len(h)
    many = max(n - width + 1, 0)
    acc = h[:many]
    for j in range(1, width):
        acc = combine(acc, h[j : many + j])
    out = []
    bounds = w.bounds.tolist()
    for row in range(piece.rows):
        lo, size = bounds[row], int(counts[row])
        if size >= width:
            out.append(np.unique(acc[lo : lo + size - width + 1]))
        elif size:
            whole = h[lo : lo + 1]
            for j in range(1, size):
                whole = combine(whole, h[lo + j : lo + j + 1])
            out.append(mix(whole + U64(size)))
        else:
            out.append(h[:0])
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 16-bit registers for each non-empty set."""
    sizes = np.array([len(s) for s in sets], np.int64)
    values = np.concatenate(sets)
    low = (values ^ (values >> U64(32))).astype(np.uint32)
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sets), REGISTERS), np.uint16)
    with np.errstate(over="ignore"):
        for j in range(REGISTERS):
            least = np.minimum.reduceat((low ^ _FLIP[j]) * _FACTOR[j], starts)
            zeros = np.where(least > 0, 31 - np.floor(np.log2(np.maximum(least, 1).astype(np.float64))), 32)
            zeros = zeros.astype(np.uint32)
            after = np.where(zeros < 31, least << np.minimum(zeros + np.uint32(1), np.uint32(31)), 0)
            out[:, j] = (zeros << np.uint32(MANTISSA)) | (after >> np.uint32(32 - MANTISSA)).astype(np.uint32)
    return out


def compressed(sketches: np.ndarray) -> np.ndarray:
    """Registers folded to a byte: equal ones stay equal, others agree once in 256."""
    return (mix(sketches.astype(U64)) >> U64(56)).astype(np.uint8)


def chance(sizes: np.ndarray, size) -> np.ndarray:
    """Probability that registers of unrelated sets agree, for sets of these sizes."""
    edges = 0.5 ** np.arange(34)
    edges[-1] = 0
    at = lambda n: np.power(1 - edges[1:], n) - np.power(1 - edges[:-1], n)
    others = np.asarray(size, float).reshape(-1, 1)  # one size, or one for each
    same = (at(sizes[:, None].astype(float)) * at(others)).sum(axis=1) / (1 << MANTISSA)
    return 1 / 256 + same


_SKETCH = "doc_id bigint, text_key bigint, n_shingles bigint, set_id string, sketch binary"


def _sketcher(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(column(batch, "text")):
                sets = shingle_sets(piece, width)
                full = [s for s in sets if len(s)]
                sketches = iter(registers(full)) if full else iter(())
                ids = [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None for s in sets]
                data = [next(sketches).tobytes() if len(s) else None for s in sets]
                rows = batch.slice(piece.first, piece.rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        column(rows, "doc_id"), column(rows, "text_key"), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(ids, pa.string()), pa.array(data, pa.binary()),
                    ],
                    names=["doc_id", "text_key", "n_shingles", "set_id", "sketch"],
                )

    return run


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_key, n_shingles, set_id and sketch (both null without shingles) per document."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text"
    )
    return rows.mapInArrow(_sketcher(width), _SKETCH)


# --- candidates ----------------------------------------------------------------------------------


def _matrix(batch, name: str = "sketch") -> np.ndarray:
    raw = b"".join(column(batch, name).to_pylist())
    return np.frombuffer(raw, np.uint16).reshape(-1, REGISTERS)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows == 0:
            continue
        for first in range(0, batch.num_rows, 2000):
            part = batch.slice(first, 2000)
            rows = _matrix(part).astype(U64).reshape(part.num_rows, BANDS, ROWS)
            key = np.broadcast_to(mix(np.arange(BANDS, dtype=U64)), (part.num_rows, BANDS))
            for j in range(ROWS):
                key = combine(key, rows[:, :, j])
            node = np.repeat(column(part, "node").to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.ravel().view(np.int64)), pa.array(node)], names=["key", "node"]
            )


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        folded = [row.tobytes() for row in compressed(_matrix(batch))] if batch.num_rows else []
        yield pa.RecordBatch.from_arrays(
            [column(batch, "node"), column(batch, "n_shingles"), pa.array(folded, pa.binary())],
            names=["node", "n_shingles", "registers"],
        )


def _forest(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Positions of the edges, taken in order, that join different trees; nodes of a label are joined already."""
    parent = list(range(int(label.max()) + 1))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keep = []
    trees = len(np.unique(label))
    for i, (x, y) in enumerate(zip(label[a].tolist(), label[b].tolist())):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[rx] = ry
            keep.append(i)
            if len(keep) == trees - 1:
                break
    return np.array(keep, np.int64)


def _estimate(same: np.ndarray, sizes: np.ndarray, size) -> np.ndarray:
    """Jaccard of sets of these sizes from the share of equal registers."""
    c = chance(sizes, size)
    return (same - c) / (1 - c)


def _rows_of(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]:
    """Distinct nodes of a part: where they are, ids, sizes, chunks, registers, labels, and whether it joins two chunks."""
    node = column(group, "node").to_numpy()
    _, first = np.unique(node, return_index=True)
    data = column(group, "registers").to_pylist()
    sketches = np.frombuffer(b"".join(data[i] for i in first), np.uint8).reshape(-1, REGISTERS)
    across = column(group, "low")[0].as_py() != column(group, "high")[0].as_py()
    known = "component" if "component" in group.column_names else "node"  # a node is a label of its own
    _, label = np.unique(column(group, known).to_numpy()[first], return_inverse=True)
    size, chunk = (column(group, c).to_numpy()[first] for c in ("n_shingles", "chunk"))
    return first, node[first], size, chunk, sketches, label, across


def _partners(i: int, size, chunk, sketches, label, across: bool, threshold: float, least: float):
    """Rows after row i of other labels (and chunks) whose estimated Jaccard fits, and the estimates."""
    fits = label[i + 1 :] != label[i]
    if across:
        fits &= chunk[i + 1 :] != chunk[i]
    fits &= np.minimum(size[i + 1 :], size[i]) >= threshold * np.maximum(size[i + 1 :], size[i])
    j = np.flatnonzero(fits) + i + 1
    estimate = _estimate((sketches[j] == sketches[i]).mean(axis=1), size[j], size[i])
    near = estimate >= least
    return j[near], estimate[near]


def _trees(threshold: float, margin: float):
    """For each part of a band group a maximum spanning forest of the pairs whose estimate fits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["key", "low", "high"]):
            _, node, size, chunk, sketches, label, across = _rows_of(group)
            found = []
            for i in range(len(node) - 1):
                j, estimate = _partners(i, size, chunk, sketches, label, across, threshold, threshold - margin)
                if len(j):
                    found.append((np.full(len(j), i), j, estimate))
            if not found:
                continue
            a, b, estimate = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(-estimate, kind="stable")
            a, b = a[order], b[order]
            kept = _forest(a, b, label)
            yield pa.RecordBatch.from_arrays([pa.array(node[a[kept]]), pa.array(node[b[kept]])], names=["a", "b"])

    return run


def _links(threshold: float, margin: float, percent: int):
    """For each part of a cluster a forest of the links between different components, by full sets; a, b are components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["key", "low", "high"]):
            first, node, size, chunk, sketches, label, across = _rows_of(group)
            component = column(group, "component").to_numpy()[first]
            raw = column(group, "shingles")
            sets = [np.frombuffer(raw[int(i)].as_py(), U64) for i in first]
            a, b = [], []
            for i in range(len(node) - 1):
                near, _ = _partners(i, size, chunk, sketches, label, across, threshold, threshold - margin)
                for j in near.tolist():
                    if label[j] != label[i]:
                        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                        if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                            a.append(component[i])
                            b.append(component[j])
                            label[label == label[j]] = label[i]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _fitting(threshold: float, margin: float):
    """The pairs whose sizes allow the threshold and whose estimate fits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 2000):
                part = batch.slice(first, 2000)
                x, y = (
                    np.frombuffer(b"".join(column(part, c).to_pylist()), np.uint8).reshape(-1, REGISTERS)
                    for c in ("registers_a", "registers_b")
                )
                size_a, size_b = (column(part, c).to_numpy() for c in ("size_a", "size_b"))
                fits = np.minimum(size_a, size_b) >= threshold * np.maximum(size_a, size_b)
                fits &= _estimate((x == y).mean(axis=1), size_a, size_b) >= threshold - margin
                yield pa.RecordBatch.from_arrays(
                    [column(part, c).filter(pa.array(fits)) for c in ("a", "b")], names=["a", "b"]
                )

    return run


def _in_chunks(rows: DataFrame, n: str, salt: str) -> DataFrame:
    """Rows with a chunk of their group and, for each pair of chunks they belong to, low and high."""
    chunks = F.ceil(F.col(n) / CHUNK).cast("int")
    chunk = F.pmod(F.xxhash64(F.lit(salt), "node"), chunks).cast("int")
    placed = rows.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    return placed.withColumn("low", F.least("chunk", "other")).withColumn("high", F.greatest("chunk", "other"))


def _hash_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for piece in pieces(column(batch, "text")) for s in shingle_sets(piece, width)]
            yield pa.RecordBatch.from_arrays([column(batch, "node"), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return run


_PAIRS = "a bigint, b bigint"


# --- confirmation --------------------------------------------------------------------------------


def _confirm(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for name in ("text_a", "text_b"):
                sides.append([s for piece in pieces(column(batch, name)) for s in shingle_sets(piece, width)])
            linked = []
            for x, y in zip(*sides):
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "a"), column(batch, "b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"]
            )

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int, name: str) -> DataFrame:
    """a, b, linked for distinct staged pairs, by their full sets."""
    one = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
    two = one.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
    return stage(
        two.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(width, percent), "a bigint, b bigint, linked boolean"),
        f"confirmed_{name}",
    )


def _texts_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """node, text for the nodes in ``wanted``; nearly every other text is left behind before the shuffle."""
    first = stage(nodes.join(wanted.distinct(), "node").select("node", "first_id", "first_key"), f"wanted_{name}")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    some = possibly_in(rows, F.struct("text_key", "doc_id"), first, F.struct("first_key", "first_id"))
    found = some.join(
        first.hint("merge"), (F.col("text_key") == F.col("first_key")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    )
    return stage(found.select("node", "text"), f"texts_{name}")


def _renamed(rows: DataFrame, name: str, labels: DataFrame) -> DataFrame:
    """``rows`` with the node in column ``name`` replaced by its component, where it has another."""
    of = labels.select(F.col("node").alias(name), F.col("component").alias("_component"))
    new = F.coalesce("_component", name).alias(name)
    return rows.join(of, name, "left").select(*[new if c == name else c for c in rows.columns])


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, kept for every document.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets. ``kept`` marks
    the documents that name their component.
    """
    threshold = percent / 100
    sketches = stage(sketch(docs, width), "sketches")
    full = sketches.filter(F.col("set_id").isNotNull())
    # A document without an id stands for its set only where none has one.
    known = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_key")
    nodes = full.groupBy("set_id").agg(F.min(known).alias("first"))
    nodes = stage(
        nodes.select(
            F.monotonically_increasing_id().alias("node"), "set_id",
            F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("first_key"),
        ),
        "nodes",
    )
    # One document stands for its node.
    mine = full.join(nodes.hint("merge"), "set_id").filter(
        F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_key") == F.col("first_key"))
    )
    node_sketches = stage(mine.select("node", "n_shingles", "sketch"), "node_sketches")
    bands = node_sketches.select("node", "sketch").mapInArrow(_bands, "key bigint, node bigint")

    repeated = stage(bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "repeated_keys")
    some = possibly_in(bands, F.col("key"), repeated, F.col("key"))
    members = stage(some.join(repeated.hint("merge"), "key").select("key", "node"), "members")
    h = F.xxhash64("node")
    groups = members.groupBy("key").agg(
        F.count("*").alias("n"), F.min("node").alias("hub"), F.max("node").alias("most"),
        F.sum(F.shiftrightunsigned(h, 32)).alias("total"), F.bit_xor(h).alias("mixed"),
    ).filter("hub <> most")
    distinct_groups = stage(
        groups.groupBy("n", "hub", "most", "total", "mixed").agg(F.min("key").alias("key")).select("key", "n", "hub"),
        "groups",
    )
    members = stage(members.join(distinct_groups, "key"), "grouped")
    folded = stage(node_sketches.mapInArrow(_fold, "node bigint, n_shingles bigint, registers binary"), "folded")

    # Every member meets the hub of its group.
    spokes = stage(members.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "spokes")
    for side in ("b", "a"):
        of = folded.select(
            F.col("node").alias(side), F.col("n_shingles").alias(f"size_{side}"),
            F.col("registers").alias(f"registers_{side}"),
        )
        spokes = spokes.join(of.hint("merge"), side)
    spokes = spokes.select("a", "b", "size_a", "size_b", "registers_a", "registers_b")
    spokes = stage(spokes.mapInArrow(_fitting(threshold, MARGIN), _PAIRS).distinct(), "spokes_fitting")
    ends = lambda pairs: pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    texts = _texts_of(docs, nodes, ends(spokes), "spokes")
    near_hub = _confirmed(spokes, texts, width, percent, "spokes").filter("linked")
    links = near_hub.select("a", "b")

    # Groups in which some members stay apart from the hub: two members that do not are joined already.
    met = links.select(F.col("a").alias("hub"), F.col("b").alias("node")).withColumn("met", F.lit(True))
    marked = members.filter("n > 2").join(met, ["hub", "node"], "left").withColumn(
        "component", F.when((F.col("node") == F.col("hub")) | F.col("met"), F.col("hub")).otherwise(F.col("node"))
    )
    marked = stage(marked.select("key", "n", "node", "component"), "marked")
    apart = marked.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y")
    part = ["key", "low", "high"]
    placed = _in_chunks(marked.join(apart.select("key"), "key"), "n", "group").select("node", "component", "chunk", *part)
    trees = clustered(placed.join(folded, "node"), part).mapInArrow(_trees(threshold, MARGIN), _PAIRS)
    # A pair that met as hub and member is known; a cluster needs it only where it is linked.
    trees = stage(trees.distinct(), "trees")
    tested = None
    if not trees.isEmpty():
        texts = _texts_of(docs, nodes, ends(trees), "trees")
        tested = _confirmed(trees, texts, width, percent, "trees")
        links = links.union(tested.filter("linked").select("a", "b"))
    labels = stars(links)

    # Clusters of the trees that the confirmed links leave in several components.
    more = None
    if tested is not None and not tested.filter("not linked").isEmpty():
        between = tested.filter("not linked").select("a", "b")
        for side in ("a", "b"):
            between = _renamed(between, side, labels)
        cluster = stage(components(between).select("node", F.col("component").alias("key")), "clusters")
        inside = labels.join(cluster, labels["component"] == cluster["node"]).select(labels["node"], "component", "key")
        some = stage(cluster.select("node", F.col("node").alias("component"), "key").union(inside), "open_nodes")
        open_ = some.groupBy("key").agg(F.count("*").alias("n"))
        texts = _texts_of(docs, nodes, some.select("node"), "open")
        sets = some.select("node").join(texts, "node").select("node", "text").mapInArrow(
            _hash_sets(width), "node bigint, shingles binary"
        )
        full_rows = some.join(open_, "key").join(folded, "node").join(
            stage(sets.dropDuplicates(["node"]), "open_sets"), "node"
        )
        more = clustered(_in_chunks(full_rows, "n", "cluster").drop("other", "n"), part).mapInArrow(
            _links(threshold, MARGIN, percent), _PAIRS
        )

    named = nodes.select("set_id", "first_id", F.col("node").alias("component"))
    for found in [labels] if more is None else [labels, stars(more)]:
        named = _renamed(named, "component", found)
    named = stage(named, "named")
    smallest = stage(named.groupBy("component").agg(F.min("first_id").alias("component_id")), "smallest")
    by_set = stage(named.join(smallest, "component").select("set_id", "component_id"), "by_set")
    light = sketches.select("doc_id", "text_key", "n_shingles", "set_id")
    empty = light.filter(F.col("set_id").isNull()).withColumn("component_id", F.col("doc_id"))
    rows = light.join(by_set, "set_id").select(*empty.columns).union(empty)
    return rows.select(
        "doc_id", "text_key", "n_shingles", "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group, and every document without shingles."""
    docs, back = shielded(docs, "doc_id", "text")
    rows = near_duplicates(docs, width, percent)
    keep = stage(
        rows.filter("kept").select("doc_id", "text_key", (F.col("n_shingles") > 0).alias("_full")).distinct(), "kept"
    )
    marked = docs.withColumn("_key", F.xxhash64("text"))
    joined = marked.join(
        keep.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key2"), "_full"),
        (F.col("_key") == F.col("_key2")) & F.col("doc_id").eqNullSafe(F.col("_id")),
    )
    copy = F.row_number().over(Window.partitionBy("_key", "_id").orderBy("_key"))
    return back(joined.withColumn("_copy", copy).filter("_copy = 1 or not _full"))

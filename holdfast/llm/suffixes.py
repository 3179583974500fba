"""Repeated byte strings over all documents, by suffix sorting.

A byte is repeated if a string of ``length`` bytes that covers it also starts somewhere else, in the
same document or another.

The corpus is not sorted as one string. Every window of ``length`` bytes owns an anchor, the smallest
hash among its short substrings; equal windows own equal anchors at equal offsets, so suffixes need to
be compared only among the occurrences of one anchor. An occurrence is kept with the range of
windows it owns and a digest of the bytes under them, its context. Contexts that occur
twice are repeated as a whole and need no further look. Where one anchor has several different
contexts, one copy of each context is fetched, and the contexts of many anchors are joined to one string whose
suffix array is made by two-stage sorting: suffixes smaller than their successor are sorted
directly, the others are induced by one scan over the buckets of first bytes. Common
prefixes of neighbours in the array then tell which windows occur again.

An anchor with very many different contexts is not put in one task: blocks of its windows, then single
windows, are counted by digest, which gives the same answer without bringing them together.

Null text counts as empty. Rows of one doc_id are documents of their own. Rows shorter than ``length``
lose nothing. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import (
    U64,
    RangeHash,
    clustered,
    column,
    grouped,
    pieces,
    ragged,
    stage,
)

LENGTH = 200
GRAM = 48
MANY_CONTEXTS = 256
SORT_BYTES = 1 << 20


# --- suffix array --------------------------------------------------------------------------------


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; equal bytes take the type to their right."""
    n = len(s)
    differs = np.flatnonzero(s[:-1] != s[1:])
    if len(differs) == 0:
        return np.zeros(n, bool)  # one run: every suffix exceeds the shorter one after it
    rises = s[differs] < s[differs + 1]
    at = np.searchsorted(differs, np.arange(n))
    return np.where(at < len(differs), rises[np.minimum(at, len(differs) - 1)], False)


def _sort_direct(s: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ``at`` in order of their first ``depth`` symbols, by refining groups seven symbols at a time."""
    padded = np.concatenate([s.astype(np.uint16), np.zeros(depth + 8, np.uint16)])
    rank = np.zeros(len(at), np.int64)
    order = np.arange(len(at))
    offset = 0
    while offset < depth and len(order):
        # Seven symbols of nine bits make one key.
        key = np.zeros(len(order), U64)
        where = at[order] + offset
        for k in range(min(7, depth - offset)):
            key = (key << U64(9)) | padded[where + k].astype(U64)
        sort = np.lexsort((key, rank[order]))
        order, key = order[sort], key[sort]
        group = rank[order]
        first = np.ones(len(order), bool)
        first[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        # Ranks are positions: a group of n suffixes that begins at r spans r to r + n - 1.
        start = np.ones(len(order), bool)
        start[1:] = group[1:] != group[:-1]
        position = np.arange(len(order))
        base = position[start][np.cumsum(start) - 1]
        head = position[first][np.cumsum(first) - 1]
        rank[order] = group + head - base
        # Only groups with several members go on.
        size = np.bincount(np.cumsum(first) - 1)
        order = order[size[np.cumsum(first) - 1] > 1]
        offset += 7
    return at[np.argsort(rank, kind="stable")]


def suffix_array(s: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Suffixes of ``s`` ordered by their first ``depth`` symbols, by two-stage sorting.

    ``s`` holds integers from 0 to 511. If only the positions ``wanted`` are, just the rising suffixes at or
    next after them are sorted, and what these induce; the result holds the wanted ones among others. Suffixes that rise (smaller than their successor) are sorted directly.
    The buckets of first symbols are then scanned upwards: the predecessor of every suffix met that
    falls (exceeds its successor) takes the next place at the front of its own bucket.
    """
    n = len(s)
    if n == 0:
        return np.zeros(0, np.int64)
    rising = _types(s)
    rises = np.flatnonzero(rising)
    last_falls = True
    if wanted is not None and len(rises):
        next_ = np.unique(np.searchsorted(rises, wanted))
        last_falls = bool(next_[-1] == len(rises)) if len(next_) else False
        rises = rises[next_[next_ < len(rises)]]
    direct = _sort_direct(s, rises, depth + 8)
    direct_cut = np.searchsorted(s[direct], np.arange(int(s.max()) + 2))
    fronts: list[list[np.ndarray]] = [[] for _ in range(int(s.max()) + 1)]
    if last_falls:
        fronts[s[n - 1]].append(np.array([n - 1]))  # the last suffix falls: its successor is empty
    out = []

    def induce(found: np.ndarray) -> dict[int, np.ndarray]:
        """Falling predecessors, by their first symbol, in the order met."""
        before = found[found > 0] - 1
        before = before[~rising[before]]
        if len(before) == 0:
            return {}
        symbol = s[before]
        sort = np.argsort(symbol, kind="stable")
        symbol, before = symbol[sort], before[sort]
        cuts = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
        return {int(symbol[a]): before[a:b] for a, b in zip(cuts, [*cuts[1:], len(before)])}

    for c in np.unique(s).tolist():
        # The front grows by its own runs of one symbol until no more predecessor is in it.
        wave = np.concatenate(fronts[c]) if fronts[c] else np.zeros(0, np.int64)
        while len(wave):
            out.append(wave)
            to = induce(wave)
            for symbol, found in to.items():
                if symbol != c:
                    fronts[symbol].append(found)
            wave = to.get(c, np.zeros(0, np.int64))
        back = direct[direct_cut[c] : direct_cut[c + 1]]
        if len(back):
            out.append(back)
            for symbol, found in induce(back).items():
                fronts[symbol].append(found)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_prefixes(s: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``order``, ``depth`` at most.

    Compared eight symbols at a time, and only where all before were equal.
    """
    padded = np.concatenate([s.astype(np.int32), np.full(depth + 8, -1, np.int32)])
    out = np.zeros(len(order), np.int64)
    a, b = order[:-1], order[1:]
    # A suffix that ends early equals nothing beyond: the pad of one meets a symbol of the other.
    live = np.arange(len(a))
    offset = 0
    while offset < depth and len(live):
        same = np.ones(len(live), bool)
        for k in range(min(8, depth - offset)):
            same &= padded[a[live] + offset + k] == padded[b[live] + offset + k]
            out[live[same] + 1] += 1
        live = live[same]
        offset += 8
    return out


def repeated_starts(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text the starts of its windows of ``length`` bytes that also start elsewhere in the list."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    ends = np.cumsum(sizes)
    raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int16) + 1
    raw[ends - 1] = 0  # separators are smaller than any byte
    windows = np.maximum(sizes - length, 0)
    wanted = ragged(ends - sizes, windows)
    if len(wanted) == 0:
        return [wanted] * len(texts)
    is_window = np.zeros(len(raw), bool)
    is_window[wanted] = True
    order = suffix_array(raw, length, wanted)
    order = order[is_window[order]]
    # Neighbours with a full common prefix are one string.
    run = np.cumsum(common_prefixes(raw, order, length) < length)
    found = np.sort(order[np.bincount(run)[run] > 1])
    cuts = np.searchsorted(found, np.concatenate([[0], ends]))
    base = np.concatenate([[0], ends[:-1]])
    return [found[cuts[i] : cuts[i + 1]] - base[i] for i in range(len(texts))]


# --- anchors -------------------------------------------------------------------------------------


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hash, position, first and last window of every anchor of a text of at least ``length`` bytes.

    The anchor of a window is its smallest gram, the leftmost of equal ones.
    """
    n = len(data) - gram + 1
    h = RangeHash(data)(np.arange(n), np.arange(n) + gram)
    span = length - gram + 1  # grams of a window
    windows = len(data) - length + 1
    # Smallest of each span: from blocks of that size, running minima from both ends.
    blocks = -(-n // span)
    none = np.iinfo(np.uint64).max
    grid = np.full(blocks * span, none, U64)
    grid[:n] = h
    grid = grid.reshape(blocks, span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:windows], ahead[span - 1 : span - 1 + windows])
    # Positions: the windows of one anchor are consecutive; a new anchor enters at the right, or is the
    # leftmost gram equal to the minimum after the old one has left.
    equal = np.flatnonzero(np.isin(h, np.unique(least)))
    position = _leftmost(h, equal, least, windows)
    change = np.flatnonzero(np.concatenate([[True], position[1:] != position[:-1]]))
    last = np.concatenate([change[1:], [windows]]) - 1
    at = position[change]
    return h[at], at, change, last


def _leftmost(h: np.ndarray, candidates: np.ndarray, least: np.ndarray, windows: int) -> np.ndarray:
    """For each window the leftmost candidate at or after its start whose hash is its minimum."""
    window = np.arange(windows)
    # Sort candidates by hash and position, then look up (minimum, start) among them.
    order = np.lexsort((candidates, h[candidates]))
    sorted_at = candidates[order]
    sorted_hash = h[sorted_at]
    value, number = np.unique(sorted_hash, return_inverse=True)
    key = number * (len(h) + 1) + sorted_at
    wanted = np.searchsorted(value, least) * (len(h) + 1) + window
    return sorted_at[np.searchsorted(key, wanted)]


_OCCURRENCES = "row_id bigint, hash bigint, context bigint, first int, last int, at int"


def _find_anchors(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = column(batch, "row_id").to_numpy()
            for piece in pieces(column(batch, "text")):
                out = []
                for i in np.flatnonzero(piece.lengths >= length).tolist():
                    data = piece.data[piece.offsets[i] : piece.offsets[i + 1]]
                    h, at, first, last = anchors(data, length, gram)
                    raw = data.tobytes()
                    context = b"".join(
                        hashlib.blake2b(raw[a : b + length], digest_size=8).digest()
                        for a, b in zip(first.tolist(), last.tolist())
                    )
                    n = len(h)
                    out.append((np.full(n, ids[piece.first + i]), h.view(np.int64), np.frombuffer(context, np.int64), first, last, at))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(c), t) for c, t in zip(zip(*out), _OCCURRENCE_TYPES)],
                        names=[f.split()[0] for f in _OCCURRENCES.split(", ")],
                    )

    return run


_OCCURRENCE_TYPES = [pa.int64()] * 3 + [pa.int32()] * 3


# --- contexts of one anchor ----------------------------------------------------------------------


def _cut_contexts(length: int):
    """Texts with their wanted contexts -> a row per context with its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(column(batch, "text")):
                wanted = column(batch, "wanted").slice(piece.first, piece.rows).to_pylist()
                rows = []
                for i, items in enumerate(wanted):
                    raw = piece.row(i)
                    rows += [
                        {**{k: c[k] for k in ("hash", "context", "first", "last", "at")},
                         "bytes": raw[c["first"] : c["last"] + length]}
                        for c in items
                    ]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_CONTEXTS_ARROW)

    return run


_CONTEXTS = "hash bigint, context bigint, first int, last int, at int, bytes binary"
_CONTEXTS_ARROW = pa.schema(
    [("hash", pa.int64()), ("context", pa.int64()), ("first", pa.int32()), ("last", pa.int32()),
     ("at", pa.int32()), ("bytes", pa.binary())]
)
_RANGES = "hash bigint, context bigint, lows array<int>, highs array<int>"


def _ranges(starts: np.ndarray) -> tuple[list[int], list[int]]:
    """Consecutive numbers as inclusive ranges."""
    if len(starts) == 0:
        return [], []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return starts[np.concatenate([[0], cut + 1])].tolist(), starts[np.concatenate([cut, [len(starts) - 1]])].tolist()


def _sort_contexts(length: int):
    """Groups of contexts with one anchor, several groups to a suffix array; repeated windows of each."""

    def solve(groups: list[pa.Table]) -> pa.RecordBatch | None:
        rows = pa.concat_tables(groups)
        texts = column(rows, "bytes").to_pylist()
        found = repeated_starts(texts, length)
        hashes, contexts = column(rows, "hash").to_pylist(), column(rows, "context").to_pylist()
        out = [(h, c, *_ranges(f)) for h, c, f in zip(hashes, contexts, found) if len(f)]
        if not out:
            return None
        columns = list(zip(*out))
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
             *[pa.array(c, pa.list_(pa.int32())) for c in columns[2:]]],
            names=["hash", "context", "lows", "highs"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for group in grouped(batches, ["hash"]):
            held.append(group)
            size += pc.sum(pc.binary_length(column(group, "bytes"))).as_py()
            if size >= SORT_BYTES:
                solved = solve(held)
                held, size = [], 0
                if solved is not None:
                    yield solved
        if held:
            solved = solve(held)
            if solved is not None:
                yield solved

    return run


WINDOW_BLOCK = 16


def _digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _blocks(length: int):
    """Contexts -> blocks of windows at the same offsets from the anchor, with two digests.

    ``core`` covers the bytes that all windows of a block share, whichever of them a context owns;
    ``full`` covers the bytes and offsets of the windows it owns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                raw, zero = row["bytes"], row["first"] - row["at"]
                n = row["last"] - row["first"] + 1
                for block in range(zero // WINDOW_BLOCK, (zero + n - 1) // WINDOW_BLOCK + 1):
                    low = max(block * WINDOW_BLOCK, zero)
                    high = min((block + 1) * WINDOW_BLOCK, zero + n)
                    a, b = (block + 1) * WINDOW_BLOCK - 1 - zero, block * WINDOW_BLOCK + length - zero
                    bytes_ = raw[low - zero : high - 1 - zero + length]
                    out.append(
                        (row["hash"], row["context"], low - zero, block, _digest(raw[a:b]),
                         _digest(b"%d %d " % (low, high) + bytes_), bytes_)
                    )
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), _BLOCK_TYPES)], names=_names(_BLOCK_FIELDS)
                )

    return run


def _names(fields: str) -> list[str]:
    return [f.split()[0] for f in fields.split(", ")]


_BLOCK_FIELDS = "hash bigint, context bigint, start int, block int, core binary, full binary, bytes binary"
_BLOCK_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def _windows(length: int):
    """Blocks -> a row per window: its place in the block and a digest of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                (full, i, _digest(raw[i : i + length]))
                for full, raw in zip(column(batch, "full").to_pylist(), column(batch, "bytes").to_pylist())
                for i in range(len(raw) - length + 1)
            ]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int32(), pa.binary()))],
                    names=["full", "i", "digest"],
                )

    return run


def _repeats_by_digest(contexts: DataFrame, length: int) -> DataFrame:
    """hash, context, lows, highs of contexts whose anchor has too many of them for one task.

    Blocks that occur twice are repeated as a whole. Of the others only those are taken apart whose
    core also occurs in a different block, and their windows are counted.
    """
    blocks = stage(contexts.mapInArrow(_blocks(length), _BLOCK_FIELDS), "blocks")
    different = stage(
        blocks.groupBy("hash", "block", "core", "full").agg(F.count("*").alias("n"), F.first("bytes").alias("bytes")),
        "different_blocks",
    )
    alike = different.filter("n > 1").select("full")
    mixed = stage(
        different.groupBy("hash", "block", "core").agg(F.count("*").alias("k")).filter("k > 1").drop("k"), "mixed_cores"
    )
    windows = different.join(mixed, ["hash", "block", "core"]).select("full", "bytes").mapInArrow(
        _windows(length), "full binary, i int, digest binary"
    )
    windows = stage(windows, "windows")
    shared = stage(windows.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest"), "shared")
    parts = windows.join(shared, "digest").groupBy("full").agg(F.collect_set("i").alias("windows"))
    verdict = stage(
        parts.join(alike.withColumn("all", F.lit(True)), "full", "full"), "block_verdicts"
    )
    last = F.octet_length("bytes") - length
    at = F.when(F.col("all"), F.sequence(F.lit(0), last)).otherwise(F.col("windows"))
    starts = blocks.join(verdict, "full").select(
        "hash", "context", F.transform(at, lambda i: i + F.col("start")).alias("lows")
    )
    found = starts.groupBy("hash", "context").agg(F.flatten(F.collect_list("lows")).alias("lows"))
    return found.select("hash", "context", "lows", F.col("lows").alias("highs"))


# --- removal -------------------------------------------------------------------------------------


def _cut(length: int):
    """Texts with the starts of their repeated windows -> what is removed and what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(column(batch, "text")):
                lows = column(batch, "lows").slice(piece.first, piece.rows).to_pylist()
                highs = column(batch, "highs").slice(piece.first, piece.rows).to_pylist()
                out = []
                for i in range(piece.rows):
                    raw = piece.row(i)
                    spans: list[list[int]] = []
                    for a, b in sorted(zip(lows[i] or (), highs[i] or ())):
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], b + length)
                        else:
                            spans.append([a, b + length])
                    kept, at = [], 0
                    for a, b in spans:
                        kept.append(raw[at:a])
                        at = b
                    kept.append(raw[at:])
                    removed = sum(b - a for a, b in spans)
                    out.append((len(raw), removed, len(spans), hashlib.sha256(b"".join(kept)).hexdigest(), [a for a, _ in spans], [b for _, b in spans]))
                ids = column(batch, "doc_id").slice(piece.first, piece.rows)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays(
                    [ids, *[pa.array(c, t) for c, t in zip(zip(*out), kinds)]],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "span_starts", "span_ends"],
                )

    return run


_RESULT = (
    "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
    "span_starts array<int>, span_ends array<int>"
)


def repeated_windows(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """row_id, lows, highs: ranges of window starts that occur again; ``rows`` has row_id and text."""
    # Written once: the texts are read for anchors in one pass only.
    found = stage(rows.mapInArrow(_find_anchors(length, gram), _OCCURRENCES), "anchor_places")
    # Anchors that occur once own no repeated window.
    often = found.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash")
    often = stage(often, "anchors")
    kept = stage(found.join(often, "hash"), "occurrences")

    whole = kept.groupBy("hash", "context").agg(
        F.count("*").alias("n"), F.min(F.struct("row_id", "first", "last", "at")).alias("one")
    )
    whole = stage(whole, "contexts")
    several = stage(
        whole.groupBy("hash").agg(F.count("*").alias("contexts")).filter("contexts > 1"), "several_contexts"
    )
    wanted = (
        whole.join(several, "hash")
        .select("one.row_id", F.struct("hash", "context", "one.first", "one.last", "one.at").alias("item"), "contexts")
        .groupBy("row_id")
        .agg(F.collect_list("item").alias("wanted"))
    )
    bytes_ = rows.join(stage(wanted, "wanted"), "row_id").select("text", "wanted").mapInArrow(
        _cut_contexts(length), _CONTEXTS
    )
    bytes_ = stage(bytes_, "context_bytes").join(several, "hash")
    usual = clustered(bytes_.filter(F.col("contexts") <= MANY_CONTEXTS).drop("contexts"), ["hash"])
    by_array = usual.mapInArrow(_sort_contexts(length), _RANGES)

    crowded = bytes_.filter(F.col("contexts") > MANY_CONTEXTS).drop("contexts")
    by_count = _repeats_by_digest(crowded, length)
    partly = stage(by_array.union(by_count), "ranges")

    again = whole.filter("n > 1").select("hash", "context", F.lit(True).alias("all"))
    verdict = stage(partly.join(again, ["hash", "context"], "full"), "verdicts")
    placed = kept.join(verdict, ["hash", "context"]).select(
        "row_id",
        F.when(F.col("all"), F.array("first")).otherwise(F.transform("lows", lambda x: x + F.col("first"))).alias("lows"),
        F.when(F.col("all"), F.array("last")).otherwise(F.transform("highs", lambda x: x + F.col("first"))).alias("highs"),
    )
    return placed.groupBy("row_id").agg(
        F.flatten(F.collect_list("lows")).alias("lows"), F.flatten(F.collect_list("highs")).alias("highs")
    )


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per document what is removed, the digest of what is left, and the removed byte ranges."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # Rows are named by their id, or by id and text if ids repeat or are missing; rows that agree in
    # both are one text that occurs several times.
    unclear = rows.groupBy("doc_id").count().filter("count > 1 or doc_id is null")
    name = F.col("doc_id") if unclear.isEmpty() else F.xxhash64("doc_id", "text")
    named = rows.select("doc_id", "text", name.alias("row_id"))
    ranges = stage(repeated_windows(named.select("row_id", "text"), length, gram), "repeated")
    return named.join(ranges, "row_id", "left").mapInArrow(_cut(length), _RESULT)

"""SimHash fingerprints of documents, and all fingerprints within a Hamming radius.

Terms are words and pairs of neighbouring words; words longer than 16 bytes are cut into pieces of
16, so that text without spaces has terms too. A term weighs its length in bytes, 16 at most per
word, and votes with the bits of its 128-bit hash. Votes are not summed term by term: for each of
the 16 byte positions the weights of equal byte values are counted and multiplied with a table of
signs.

The radius search keeps a table per part of the 128 bits. Two fingerprints within ``radius`` bits differ in
at most ``radius // blocks`` bits, none to two, of at least one block, and so agree in at least one of its
``radius // blocks + 1`` parts. A fingerprint is filed under each part; where the corpus makes a table's groups
long, also under leading bits of the block's rest, as they are and with each one flipped. Inside a group
fingerprints meet by the rest of their block, as it is and with each single bit flipped: rests up to two bits
apart have a key in common. Groups that stay long are cut into chunks and each pair of chunks is a task of its own,
so nothing but counts leaves a task. Every pair is counted once, in the first block that is close, its
first equal part and the least common key. All pairs within the radius are found.

Null text counts as empty; text without words has the fingerprint of all zeros. Rows are ordered by
doc_id, null first, then text; repeated ids follow each other. With a single row the next document is
the row itself. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import (
    PIECE,
    U64,
    Piece,
    RangeHash,
    clustered,
    column,
    combine,
    grouped,
    mix,
    partitions,
    pieces,
    ragged,
    stage,
    words,
)

BITS = 128
LONGEST = 16
RADIUS = 3
BLOCKS = 4
NEAR_COPIES = 14  # bits within which a copy with some words in a hundred replaced lies
NEAR_BLOCKS = 5
CHUNK = 4096

_SIGNS = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64) * 2) - 1


# --- fingerprints --------------------------------------------------------------------------------


def fingerprints(piece: Piece) -> np.ndarray:
    """16 bytes for each row of a piece."""
    w = words(piece)
    parts = -(-(w.ends - w.starts) // LONGEST)
    starts = np.repeat(w.starts, parts) + LONGEST * (ragged(np.zeros(len(parts), np.int64), parts))
    ends = np.minimum(starts + LONGEST, np.repeat(w.ends, parts))
    bounds = np.searchsorted(starts, piece.offsets)
    row = np.repeat(np.arange(piece.rows), np.diff(bounds))
    h = RangeHash(piece.data)(starts, ends)
    weight = (ends - starts).astype(np.float64)
    near = row[1:] == row[:-1]
    pair = combine(h[:-1], h[1:])[near]
    terms = np.concatenate([h, pair])
    weights = np.concatenate([weight, (weight[:-1] + weight[1:])[near]])
    rows = np.concatenate([row, row[1:][near]]) * 256
    hashed = np.stack([terms, mix(terms ^ U64(0x5851F42D4C957F2D))], axis=1).view(np.uint8).reshape(-1, 16)
    votes = np.empty((piece.rows, 16, 8))
    for position in range(16):
        counts = np.bincount(rows + hashed[:, position], weights, piece.rows * 256)
        votes[:, position] = counts.reshape(piece.rows, 256) @ _SIGNS
    return np.packbits(votes.reshape(piece.rows, BITS) > 0, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits."""
    return 1 - np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) / BITS


def _packed(texts: list[bytes]) -> Piece:
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return Piece(0, np.frombuffer(b"".join(texts), np.uint8), bounds)


def _cut(text: bytes, code_points: int) -> int:
    """Bytes of the first ``code_points`` code points."""
    at = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return int(at[code_points]) if code_points < len(at) else len(text)


def edited(text: bytes, after: bytes) -> tuple[int, bytes]:
    """Code points of a text, and the text whose last quarter is the beginning of ``after``."""
    n = int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))
    quarter = n // 4
    return n, text[: _cut(text, n - quarter)] + after[: _cut(after, quarter)]


_FIELDS = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _compare(rows: list[tuple], texts: list[bytes], nexts: list[bytes]) -> pa.RecordBatch:
    """Result rows of consecutive documents; ``nexts`` ends with the document after the last."""
    changed = [edited(t, n) for t, n in zip(texts, nexts)]
    own = fingerprints(_packed(texts + nexts[-1:]))
    other = fingerprints(_packed([e for _, e in changed]))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(rows, pa.int64()),
            pa.array([n for n, _ in changed], pa.int64()),
            pa.array([hashlib.sha256(e).hexdigest() for _, e in changed]),
            pa.array([f.tobytes().hex() for f in own[:-1]]),
            pa.array([f.tobytes().hex() for f in other]),
            pa.array(likeness(own[:-1], other)),
            pa.array(likeness(own[:-1], own[1:])),
        ],
        names=[f.split()[0] for f in _FIELDS.split(", ")],
    )


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each bucket in order; the rows marked ahead belong to the next bucket."""
    ids: list = []
    texts: list[bytes] = []
    bucket, done = None, False

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        # The newest text is only the next one of those before, unless it will be compared itself.
        nonlocal ids, texts
        if len(texts) > 1:
            yield _compare(ids[:-1], texts[:-1], texts[1:])
        ids, texts = ([], []) if last else (ids[-1:], texts[-1:])

    for batch in batches:
        marks = column(batch, "ahead").to_pylist()
        buckets = column(batch, "bucket").to_pylist()
        doc_ids = column(batch, "doc_id").to_pylist()
        for piece in pieces(column(batch, "text")):
            for i in range(piece.rows):
                n = piece.first + i
                if buckets[n] != bucket:
                    yield from flush(True)
                    bucket, done = buckets[n], False
                if done:
                    continue  # only the first row ahead is the next document
                ids.append(doc_ids[n])
                texts.append(piece.row(i))
                done = bool(marks[n])
            if sum(map(len, texts)) > PIECE:
                yield from flush(False)
    yield from flush(True)


def _bucket_of(cuts: list[int]):
    edges = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        known = ids.notna()
        out = np.zeros(len(ids), np.int32)
        out[known] = np.searchsorted(edges, ids[known].astype(np.int64), side="right")
        return pd.Series(out)

    return bucket


def _targets(cuts: list[int], first: dict, before: dict):
    """The bucket of a row and, for the first id of a bucket, the bucket before."""
    edges = np.array(cuts, np.int64)

    @F.pandas_udf("array<int>")
    def targets(ids: pd.Series) -> pd.Series:
        out = []
        for i in ids:
            i = None if pd.isna(i) else int(i)
            b = 0 if i is None else int(np.searchsorted(edges, i, side="right"))
            out.append([b, before[b]] if first[b] == i else [b])
        return pd.Series(out)

    return targets


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document, of its edited text, and their likeness; see ``_FIELDS``.

    Documents are dealt to buckets of consecutive ids by quantiles of doc_id, and the first document of
    each bucket is sent to the bucket before as well, that of the first bucket to the last one. What the
    driver holds is the cuts and the first id of each bucket, four per shuffle partition.
    """
    spark = docs.sparkSession
    n = 4 * partitions(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n)).first()[0] or []
    bucket = _bucket_of(sorted(set(cuts)))
    ids = rows.select("doc_id").withColumn("bucket", bucket("doc_id"))
    # The first id of a bucket; null ids come first.
    found = ids.groupBy("bucket").agg(
        F.min("doc_id").alias("first"), F.count_if(F.col("doc_id").isNull()).alias("nulls")
    )
    firsts = sorted((r["bucket"], None if r["nulls"] else r["first"]) for r in found.collect())
    before = {b: firsts[i - 1][0] for i, (b, _) in enumerate(firsts)}

    to = F.posexplode(_targets(sorted(set(cuts)), dict(firsts), before)("doc_id"))
    placed = rows.select("doc_id", "text", to.alias("ahead", "bucket")).withColumn(
        "ahead", F.col("ahead").cast("boolean")
    )
    return clustered(placed, ["bucket"], ["ahead", "doc_id", "text"]).mapInArrow(_chain, _FIELDS)


# --- radius search -------------------------------------------------------------------------------


def _edges(blocks: int) -> list[tuple[int, int]]:
    at = [BITS * i // blocks for i in range(blocks + 1)]
    return list(zip(at[:-1], at[1:]))


def _block(hi: np.ndarray, lo: np.ndarray, first: int, end: int) -> np.ndarray:
    """Bits ``first`` to ``end`` of fingerprints, at most 64, as a number."""
    if end <= 64:
        value = hi >> U64(64 - end)
    elif first >= 64:
        value = lo >> U64(128 - end)
    else:
        value = (hi << U64(end - 64)) | (lo >> U64(128 - end))
    return value & U64((1 << (end - first)) - 1)


def _flips(blocks: int, radius: int) -> int:
    """Flipped bits that the closest block of two fingerprints within the radius has at most."""
    if radius // blocks > 2:
        raise ValueError(f"radius {radius} needs at least {radius // 3 + 1} blocks")
    return radius // blocks


def _tables(blocks: int, radius: int) -> list[tuple[int, int, int, int, int]]:
    """Block, first and end of the block, first and end of a part, for each table."""
    flips = _flips(blocks, radius)
    out = []
    for t, (first, end) in enumerate(_edges(blocks)):
        at = [first + (end - first) * i // (flips + 1) for i in range(flips + 2)]
        out += [(t, first, end, x, y) for x, y in zip(at[:-1], at[1:])]
    return out


def _rest(hi: np.ndarray, lo: np.ndarray, table: tuple) -> tuple[np.ndarray, int]:
    """The bits of a block outside the table's part, and how many they are."""
    _, first, end, x, y = table
    rest, width = np.zeros(len(hi), U64), 0
    for a, b in ((first, x), (y, end)):
        if b > a:
            rest = (rest << U64(b - a)) | _block(hi, lo, a, b)
            width += b - a
    return rest, width


def _filed(blocks: int, radius: int, prefix: int):
    """A row for each table and, with ``prefix`` leading bits of the rest, for each of them flipped."""
    tables, flips = _tables(blocks, radius), _flips(blocks, radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hi = column(batch, "hi").to_numpy().view(np.uint64)
            lo = column(batch, "lo").to_numpy().view(np.uint64)
            for number, table in enumerate(tables):
                rest, width = _rest(hi, lo, table)
                p = min(prefix, width)
                lead = rest >> U64(width - p)
                part = (_block(hi, lo, table[3], table[4]) << U64(p)) | lead
                for bit in [0, *[1 << k for k in range(p)]] if flips else [0]:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(hi), number, np.int32)), pa.array((part ^ U64(bit)).view(np.int64)),
                            column(batch, "hi"), column(batch, "lo"), column(batch, "n"),
                        ],
                        names=["table", "key", "hi", "lo", "n"],
                    )

    return run


def _close(x: np.ndarray, y: np.ndarray, blocks: int, radius: int, tables: list, number: int) -> np.ndarray:
    """Whether a table is the one in which pairs with these differing bits are counted."""
    flips, mine = _flips(blocks, radius), tables[number]
    once = np.bitwise_count(x).astype(np.int64) + np.bitwise_count(y) <= radius
    for t, (first, end) in enumerate(_edges(blocks)[: mine[0] + 1]):
        close = np.bitwise_count(_block(x, y, first, end)) <= flips
        once &= close if t == mine[0] else ~close
    for table in tables[:number]:
        if table[0] == mine[0]:
            once &= _block(x, y, table[3], table[4]) != 0
    return once


def _meetings(own: np.ndarray, rest: np.ndarray, width: int, flips: int) -> Iterator[tuple]:
    """Positions of pairs of a group that have a key in common, and that key; or all pairs, and no key.

    ``width`` bits of the rest tell rows of the group apart. Rows whose leading bits are the group's ``own`` have a
    key for each of them flipped, others only the rest as it is.
    """
    n = len(rest)
    tail = rest & U64((1 << width) - 1)
    rows, keys = [np.arange(n)], [tail]
    if flips:
        own = np.flatnonzero(own)
        for k in range(width):
            rows.append(own)
            keys.append(tail[own] ^ U64(1 << k))
    row, key = np.concatenate(rows), np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    row, key = row[order], key[order]
    run = np.diff(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])))
    if (run * (run - 1)).sum() >= n * (n - 1):  # near copies meet under many keys: compare rows once
        for i in range(n - 1):
            yield np.full(n - 1 - i, i), np.arange(i + 1, n), None
        return
    i = np.arange(len(key))
    for step in range(1, len(key)):
        i = i[i + step < len(key)]
        i = i[key[i + step] == key[i]]
        if len(i) == 0:
            return
        yield row[i], row[i + step], key[i]


_PART = ("table", "key", "low", "high")


def _count_near(blocks: int, radius: int, prefix: int):
    tables, flips = _tables(blocks, radius), _flips(blocks, radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, list(_PART)):
            if group.num_rows < 2:
                continue
            number, filed = column(group, "table")[0].as_py(), column(group, "key")[0].as_py()
            across = column(group, "low")[0].as_py() != column(group, "high")[0].as_py()
            hi, lo = (column(group, c).to_numpy().view(np.uint64) for c in ("hi", "lo"))
            n, chunk = column(group, "n").to_numpy(), column(group, "chunk").to_numpy()
            rest, width = _rest(hi, lo, tables[number])
            p = min(prefix, width)
            lead = rest >> U64(width - p)
            group_lead = U64(filed & ((1 << p) - 1))
            near = np.zeros(len(n), np.int64)

            def count(a: np.ndarray, b: np.ndarray, key=None) -> None:
                if across:
                    other = chunk[a] != chunk[b]
                    a, b, key = a[other], b[other], key[other] if key is not None else None
                x, y = hi[a] ^ hi[b], lo[a] ^ lo[b]
                fits = _close(x, y, blocks, radius, tables, number)
                a, b = a[fits], b[fits]
                # Of the keys that both have, with the group's lead in front, the least counts.
                ra, apart = rest[a], rest[a] ^ rest[b]
                low = apart & (~apart + U64(1))
                least = np.minimum(ra ^ low, ra ^ apart ^ low)
                if key is None:
                    mine = least >> U64(width - p) == group_lead
                else:
                    mine = least == (group_lead << U64(width - p)) | key[fits]
                a, b = a[mine], b[mine]
                np.add.at(near, a, n[b])
                np.add.at(near, b, n[a])

            for a, b, key in _meetings(lead == group_lead, rest, width - p, flips):
                count(a, b, key)
            some = near > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(hi[some].view(np.int64)), pa.array(lo[some].view(np.int64)), pa.array(near[some])],
                names=["hi", "lo", "near"],
            )

    return run


def neighbours(fingerprints_: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """hi, lo, n_near: other rows within ``radius`` bits of each distinct fingerprint, itself included n - 1 times.

    ``fingerprints_`` has the column fingerprint, 32 hex digits.
    """
    part = lambda at: F.conv(F.substring("fingerprint", at, 16), 16, -10).cast("bigint")
    distinct = stage(
        fingerprints_.groupBy("fingerprint").agg(F.count("*").alias("n")).select(
            "fingerprint", part(1).alias("hi"), part(17).alias("lo"), "n"
        ),
        "fingerprints",
    )
    tables = _tables(blocks, radius)
    part = min(y - x for *_, x, y in tables)
    # Leading bits for groups of about half a chunk, were fingerprints spread evenly.
    prefix = max(0, math.ceil(math.log2(max(distinct.count(), 1) / CHUNK * 2)) - part)
    filed = distinct.select("hi", "lo", "n").mapInArrow(
        _filed(blocks, radius, prefix), "table int, key bigint, hi bigint, lo bigint, n bigint"
    )
    # Groups beyond a chunk are found on the keys alone, which are counted before they are shuffled.
    large = stage(
        filed.groupBy("table", "key").agg(F.count("*").alias("members")).filter(f"members > {CHUNK}"), "large_groups"
    )
    chunks = F.coalesce(F.ceil(F.col("members") / CHUNK).cast("int"), F.lit(1))
    placed = filed.join(large, ["table", "key"], "left").withColumn("chunks", chunks)
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("hi", "lo"), F.col("chunks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "table", "key", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"),
        "chunk", "hi", "lo", "n",
    )
    counted = clustered(placed, list(_PART)).mapInArrow(
        _count_near(blocks, radius, prefix), "hi bigint, lo bigint, near bigint"
    )
    near = stage(counted.groupBy("hi", "lo").agg(F.sum("near").alias("near")), "near")
    return distinct.join(near, ["hi", "lo"], "left").select(
        "fingerprint", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_near")
    )


def fingerprinted(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``fingerprint_pairs`` with n_near, the number of other documents within ``radius`` bits."""
    rows = stage(fingerprint_pairs(docs), "fingerprint_rows")
    near = stage(neighbours(rows, radius, blocks), "neighbours")
    return rows.join(near, "fingerprint").select("doc_id", *[c for c in rows.columns if c != "doc_id"], "n_near")

"""Shared by the text operators: Arrow text as byte arrays, word bounds, 64-bit hashes, grouped streams.

The operators hand whole Arrow batches to numpy. ``pieces`` cuts a batch into runs of whole
rows of about ``PIECE`` bytes, so that temporary arrays stay small whatever the batch holds;
a single row longer than that is a piece of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from holdfast.session import stage as stage  # staged tables go to the shared folder

PIECE = 1 << 18
ARROW_ROWS = 500
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session; the operators scale their own numbers by it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def short_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``ARROW_ROWS`` rows from now on; a lower setting of the session stays.

    Spark cuts batches by rows, 10,000 by default, which for long texts is a large buffer in the JVM
    and one more in the worker, for every running task.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, ARROW_ROWS)


@dataclass
class Piece:
    """Rows ``first`` to ``first + len(offsets) - 2`` of a batch; ``data`` holds their UTF-8 bytes."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)

    def row(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type not in (pa.string(), pa.large_string(), pa.binary(), pa.large_binary()):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = column.type in (pa.large_string(), pa.large_binary())
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, bounds


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[Piece]:
    if len(column) == 0:
        return
    raw, bounds = text_buffers(column)
    first = 0
    while first < len(bounds) - 1:
        last = int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(bounds) - 1)
        yield Piece(first, raw[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])
        first = last


# --- hashes --------------------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_powers.get("up", ())) < n:
        size = max(n, PIECE + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            values = np.full(size, base, U64)
            values[0] = 1
            with np.errstate(over="ignore"):
                _powers[name] = np.cumprod(values, dtype=U64)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class RangeHash:
    """Hash of any byte range of an array, from one running sum."""

    def __init__(self, data: np.ndarray):
        up, self.down = _power_table(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U64)
        with np.errstate(over="ignore"):
            np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            raw = (self.sums[ends] - self.sums[starts]) * self.down[starts]
            return mix(raw + (ends - starts).astype(U64) * U64(0xD1B54A32D192ED03))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    with np.errstate(over="ignore"):
        return mix(a * U64(0xC2B2AE3D27D4EB4F) + (b ^ (b >> U64(29))) * U64(0x165667B19E3779F9))


# --- words ---------------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


@dataclass
class Words:
    """Byte ranges of all words of a piece; the words of row i are ``bounds[i]`` to ``bounds[i+1]``."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values, never across rows."""
    if len(member) == 0:
        none = np.zeros(0, np.int64)
        return none, none
    edge = np.zeros(len(member) + 1, bool)
    edge[offsets] = True
    opens, shuts = member.copy(), member.copy()
    opens[1:] &= ~member[:-1] | edge[1:-1]
    shuts[:-1] &= ~member[1:] | edge[1:-1]
    return np.flatnonzero(opens), np.flatnonzero(shuts) + 1


def words(piece: Piece) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+``, never across rows."""
    starts, ends = runs(~_SPACE[piece.data], piece.offsets)
    return Words(starts, ends, np.searchsorted(starts, piece.offsets))


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges ``starts[i] .. starts[i] + counts[i]``."""
    ends = np.cumsum(counts)
    if len(ends) == 0 or ends[-1] == 0:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - counts), counts)


def code_points_before(piece: Piece) -> np.ndarray:
    """Number of code points that begin before each byte of a piece, and before its end."""
    out = np.zeros(len(piece.data) + 1, np.int64)
    np.cumsum((piece.data & 0xC0) != 0x80, out=out[1:])
    return out


def byte_set(members: str) -> np.ndarray:
    """Membership of each byte value in a set of ASCII characters."""
    out = np.zeros(256, bool)
    out[list(members.encode("ascii"))] = True
    return out


# --- streams -------------------------------------------------------------------------------------


def column(batch: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    found = batch.column(name)
    return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of equal keys out of a stream that is sorted by them; only one group is held."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = pa.Table.from_batches([batch])
        change = np.zeros(rows.num_rows, bool)
        change[0] = True
        for k in keys:
            values = column(rows, k)
            differs = pc.not_equal(values.slice(1), values.slice(0, len(values) - 1))
            change[1:] |= pc.fill_null(differs, True).to_numpy(zero_copy_only=False)
        cuts = [*np.flatnonzero(change).tolist(), rows.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = rows.slice(a, b - a)
            key = tuple(column(part, k)[0].as_py() for k in keys)
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(part)
            last = key
    if held:
        yield pa.concat_tables(held)


def clustered(df: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows of equal keys next to each other, for ``grouped``."""
    n = partitions(df.sparkSession)
    return df.repartition(n, *keys).sortWithinPartitions(*keys, *(order or []))


FILTER_BITS = 1 << 26  # 8 MB in all, whatever the number of keys


def possibly_met(rows: DataFrame, key, keys: DataFrame, wanted) -> DataFrame:
    """``rows`` with ``_met``, false for most of those whose ``key`` is no ``wanted`` value of ``keys``, and for none of the others.

    A bitmap of hashed keys, ``FILTER_BITS`` long and so bounded, is broadcast. With more keys than bits all are true.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    place = keys.select(slot(wanted).alias("_slot"))
    bits = stage(
        place.groupBy(F.shiftright("_slot", 15).alias("_bucket")).agg(
            F.bitmap_construct_agg(F.col("_slot") % 32768).alias("_bits")
        ),
        "filter",
    )
    at = F.col("_at") % 32768
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = rows.withColumn("_at", slot(key)).withColumn("_bucket", F.shiftright("_at", 15))
    met = F.coalesce(F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1, F.lit(False))
    return marked.join(F.broadcast(bits), "_bucket", "left").select(*[F.col(f"`{c}`") for c in rows.columns], met.alias("_met"))


def possibly_in(rows: DataFrame, key, keys: DataFrame, wanted) -> DataFrame:
    """``rows`` without most of those whose ``key`` is no ``wanted`` value of ``keys``; none of the others is lost.

    Rows that cannot find a partner leave before they are shuffled.
    """
    return possibly_met(rows, key, keys, wanted).filter("_met").drop("_met")


def plus(schema: StructType, *fields: tuple[str, str]) -> StructType:
    """A schema with further fields; ``schema`` itself stays as it is."""
    return StructType(list(schema.fields) + [StructType.fromDDL(f"`{name}` {kind}")[0] for name, kind in fields])


def shielded(df: DataFrame, *needed: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The table with all but the needed columns under names of our own, and what names them back.

    Operators that hand on all columns of a table add some for themselves; so none can clash.
    """
    names = {c: c if c in needed else f"own_{i}" for i, c in enumerate(df.columns)}

    def back(out: DataFrame) -> DataFrame:
        return out.select(*[F.col(f"`{names[c]}`").alias(c) for c in names])

    return df.toDF(*names.values()), back


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns an operator reads, whatever else the table carries."""
    return df.select(*[F.col(f"`{n}`") for n in names])

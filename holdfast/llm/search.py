"""Exact top-k search by inner product: MaxScore over integer vectors.

A dimension is a term, the vectors with a component there are its postings. For a query, the
largest product that a term can give in a shard bounds it. Terms are ordered by bound; the
smallest ones whose bounds sum to less than the score to beat are non-essential: a vector
that occurs in none of the others cannot enter the result. The essential postings are
traversed first, in blocks of terms; the remaining terms are probed only for vectors whose
partial score plus remaining bound still reaches the score to beat, which rises meanwhile.

Vectors are packed into shards, queries into blocks; every block visits every shard through an
equi-join on the shard number, each visit returns k rows a query, and a second round merges
them. The first score to beat comes from a bounded sample of vectors: it is the k-th best of
real candidates, so it never exceeds the true one and only saves work.

Components are ``floor(scale * x)``, saturating at 64-bit limits. Vectors that are null, or hold
a null or non-finite component, take no part, neither as query nor as candidate; rows without an
id neither. A shorter vector counts as padded with zeros. Rows with one id are separate
candidates; a query never meets rows of its own id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.common import column, grouped, own_columns, stage

SHARD_ROWS = 8192
QUERY_ROWS = 1024
SEED_ROWS = 1024
EXACT = float(1 << 53)


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """id, components: rows that take part."""
    v = F.col(f"`{vector_col}`")
    good = F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf")))
    )
    return (
        own_columns(vectors, id_col, vector_col)
        .filter(F.col(f"`{id_col}`").isNotNull() & v.isNotNull() & good)
        .select(
            F.col(f"`{id_col}`").cast("bigint").alias("id"),
            F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("components"),
        )
    )


def _matrix(rows: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column as one integer matrix, padded with zeros."""
    lengths = rows.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(int(lengths.max(initial=0)), 1) if width is None else width
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block of the sorted stream: number, ids, matrix, width."""
    for group in grouped(batches, ["block"]):
        matrix = _matrix(column(group, "components"))
        yield pa.RecordBatch.from_pydict(
            {
                "block": [column(group, "block")[0].as_py()],
                "width": [matrix.shape[1]],
                "ids": [column(group, "id").to_numpy().astype(np.int64).tobytes()],
                "matrix": [matrix.tobytes()],
            },
            schema=_PACKED,
        )


_PACKED = pa.schema(
    [("block", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("matrix", pa.binary())]
)


def blocks(rows: DataFrame, block_rows: int) -> tuple[DataFrame, int]:
    """Packs id/components rows into blocks of about ``block_rows``; blocks, and how many at most."""
    n = max(1, -(-rows.count() // block_rows))
    numbered = rows.withColumn(
        "block", F.pmod(F.xxhash64("id", F.array_join(F.col("components"), ",")), F.lit(n)).cast("int")
    )
    packed = numbered.repartition(n, "block").sortWithinPartitions("block", "id")
    return packed.mapInArrow(_pack, "block int, width int, ids binary, matrix binary"), n


def _unpack(ids: bytes, matrix: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(matrix, np.int64).reshape(-1, width)


def _fit(matrix: np.ndarray, width: int) -> np.ndarray:
    return matrix if matrix.shape[1] == width else np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= least)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]


def maxscore(
    queries: np.ndarray, query_ids: np.ndarray, matrix: np.ndarray, ids: np.ndarray, to_beat: np.ndarray, k: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k best rows of one shard that reach ``to_beat``: position, ids, scores."""
    width = max(queries.shape[1], matrix.shape[1])
    queries, matrix = _fit(queries, width), _fit(matrix, width)
    top = float(np.abs(queries).astype(float).max(initial=0)) * float(np.abs(matrix).astype(float).max(initial=0))
    kind = np.float64 if top * width < EXACT else np.int64  # both exact, the first is faster
    postings = np.ascontiguousarray(matrix.T.astype(kind))  # a row per term
    high, low = postings.max(axis=1), postings.min(axis=1)
    asked = queries.astype(kind)
    for i in range(len(asked)):
        q = asked[i]
        bound = np.maximum(np.maximum(q * high, q * low), 0)
        order = np.argsort(-bound, kind="stable")
        order = order[q[order] != 0]
        left = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0]])  # bound of the terms from j on
        beat = to_beat[i]
        # Terms from here on are non-essential: together they cannot reach the score to beat.
        essential = int(np.searchsorted(-left, -beat, side="right")) if np.isfinite(beat) else len(order)
        live = np.flatnonzero(ids != query_ids[i])
        if beat > 0 and essential <= len(order):
            seen = (postings[order[:essential]] != 0).any(axis=0) if essential else np.zeros(len(ids), bool)
            live = live[seen[live]] if not seen.all() else live
        partial = np.zeros(len(live), kind)
        j = 0
        while j < len(order) and len(live):
            # Everything at first; short probes once few vectors are left.
            ahead = min(len(order), j + max(8, len(order) // 4))
            terms = order[j:ahead]
            some = postings[terms] if len(live) == len(ids) else postings[np.ix_(terms, live)]
            partial = partial + q[terms] @ some
            j = ahead
            if np.isfinite(beat):
                keep = partial + left[j] >= beat
                if not keep.all():
                    live, partial = live[keep], partial[keep]
        found = _best(partial, ids[live], k)
        yield i, ids[live][found], partial[found].astype(np.int64)


def _visit(k: int, first: bool):
    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                query_ids, queries = _unpack(row["q_ids"], row["q_matrix"], row["q_width"])
                ids, matrix = _unpack(row["ids"], row["matrix"], row["width"])
                beat = (
                    np.full(len(query_ids), -np.inf)
                    if first
                    else np.frombuffer(row["to_beat"], np.float64)
                )
                if first:
                    out = np.full(len(query_ids), -np.inf)
                    for i, _, scores in maxscore(queries, query_ids, matrix, ids, beat, k):
                        if len(scores) == k:
                            out[i] = scores[-1] if abs(int(scores[-1])) < EXACT else -np.inf
                    yield pa.RecordBatch.from_pydict(
                        {"q_block": [row["q_block"]], "to_beat": [out.tobytes()]}, schema=_BEAT
                    )
                    continue
                parts = [
                    (np.full(len(found), (row["q_block"] << 32) + i), np.full(len(found), query_ids[i]), found, scores)
                    for i, found, scores in maxscore(queries, query_ids, matrix, ids, beat, k)
                ]
                if parts:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(c), pa.int64()) for c in zip(*parts)],
                        names=["query_row", "query_id", "vec_id", "score"],
                    )

    return visit


_BEAT = pa.schema([("q_block", pa.int32()), ("to_beat", pa.binary())])


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    scale: float = 64.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows for each row for which ``is_query`` holds.

    ``is_query`` is a condition on the column ``id``.
    """
    rows = stage(integer_vectors(vectors, id_col, vector_col, scale), "integer_vectors")
    asked, n_asked = blocks(rows.filter(is_query), query_rows)
    asked = stage(
        asked.select(
            F.col("block").alias("q_block"), F.col("width").alias("q_width"),
            F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"),
        ),
        "query_blocks",
    )
    shards, n_shards = blocks(rows, shard_rows)
    shards = stage(shards, "shards")
    # A sample of at most SEED_ROWS rows sets the first score to beat.
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SEED_ROWS)
    seed, _ = blocks(stage(sample, "sample"), 2 * SEED_ROWS)
    every = F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1)))
    seeded = asked.join(seed.withColumn("q_block", every), "q_block")
    to_beat = stage(seeded.mapInArrow(_visit(k, True), "q_block int, to_beat binary"), "to_beat")
    visits = (
        asked.join(to_beat, "q_block", "left")
        .withColumn("to_beat", F.coalesce("to_beat", F.lit(b"")))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
        .join(shards, "block")
    )
    n_visits = max(1, asked.count() * n_shards)
    found = visits.repartition(n_visits, "q_block", "block").mapInArrow(
        _visit(k, False), "query_row bigint, query_id bigint, vec_id bigint, score bigint"
    )
    best = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )

"""Radius search with leading bits, and the bitmap that lets rows pass before a shuffle."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from holdfast.llm import common, simhash


@pytest.mark.parametrize(("radius", "blocks", "prefix"), [(14, 5, 0), (14, 5, 3), (14, 5, 17), (9, 5, 2), (3, 4, 0)])
def test_every_pair_within_the_radius_is_counted_once(radius, blocks, prefix):
    rng = np.random.default_rng(1)
    rows = []
    for base in rng.integers(0, 2, (15, 128)):
        for flips in rng.integers(0, 12, 15):
            x = base.copy()
            x[rng.choice(128, flips, replace=False)] ^= 1
            rows.append(x)
    bits = np.unique(np.array(rows), axis=0).astype(np.uint8)
    hi, lo = np.packbits(bits, axis=1).view(">i8").astype(np.int64).T
    n = rng.integers(1, 4, len(bits))
    near = (bits[:, None, :] != bits[None, :, :]).sum(axis=2) <= radius
    want = near @ n - n
    batch = pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo), pa.array(n)], names=["hi", "lo", "n"])
    filed = pa.Table.from_batches(list(simhash._filed(blocks, radius, prefix)(iter([batch]))))
    for name in ("low", "high", "chunk"):
        filed = filed.append_column(name, pa.array(np.zeros(len(filed), np.int32)))
    filed = filed.sort_by([("table", "ascending"), ("key", "ascending")])
    got = Counter()
    for out in simhash._count_near(blocks, radius, prefix)(iter(filed.to_batches(1000))):
        for h, l, count in zip(*(c.to_pylist() for c in out.columns)):
            got[h, l] += count
    assert [got[h, l] for h, l in zip(hi.tolist(), lo.tolist())] == want.tolist()


def test_no_row_with_a_partner_is_lost_by_the_bitmap(spark, monkeypatch):
    keys = spark.range(0, 3000, 7).withColumnRenamed("id", "wanted")
    rows = spark.range(3000).withColumn("other", F.lit("x"))
    for bits in (1 << 26, 1 << 10):
        monkeypatch.setattr(common, "FILTER_BITS", bits)
        got = {r.id for r in common.possibly_in(rows, F.col("id"), keys, F.col("wanted")).collect()}
        assert got >= set(range(0, 3000, 7)) and len(got) < (500 if bits > 1 << 20 else 3000)
    assert common.possibly_in(rows, F.col("id"), keys.limit(0), F.col("wanted")).count() == 0

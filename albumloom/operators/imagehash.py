"""Perceptual hash of decoded pictures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SIDE, LOW = 32, 8


def dct_hashes(pictures: DataFrame) -> DataFrame:
    """(photo_id, luma array<double> of 32x32) -> hash halves: low 8x8 cosine terms above their median.

    Pictures come decoded and scaled. Each Arrow batch is one matrix product; nothing is kept between batches.
    """
    basis = np.cos(np.pi * np.outer(np.arange(LOW), 2 * np.arange(SIDE) + 1) / (2 * SIDE))
    weight = 1 << np.arange(32, dtype=np.int64)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            luma = b.column("luma").flatten().to_numpy(zero_copy_only=False).reshape(-1, SIDE, SIDE)
            low = np.einsum("ki,nij,lj->nkl", basis, luma, basis).reshape(-1, LOW * LOW)
            on = low > np.median(low, axis=1, keepdims=True)
            half = [(on[:, i : i + 32] * weight).sum(axis=1) for i in (0, 32)]
            yield pa.RecordBatch.from_arrays([b.column("photo_id"), pa.array(half[0], pa.int64()), pa.array(half[1], pa.int64())], ["photo_id", "hash_hi", "hash_lo"])

    return pictures.select("photo_id", "luma").mapInArrow(run, "photo_id bigint, hash_hi bigint, hash_lo bigint")

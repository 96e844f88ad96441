"""Dense sums of fixed size over all tasks, added on executors before the driver sees them."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .session import lean


def summed(df: DataFrame, partial: Callable[[Iterable[pa.RecordBatch]], np.ndarray | None], size: int, block: int = 1 << 12) -> np.ndarray:
    """The float64 sum over tasks of ``partial(batches)``, a vector of ``size`` numbers (or None).

    Each task sends its vector in blocks; a block is added up by one task. The
    driver gets ``size`` numbers, however many tasks there are.
    """

    def run(batches):
        total = partial(batches)
        if total is not None:
            parts = [(k, total[at : at + block]) for k, at in enumerate(range(0, size, block))]
            parts = [(k, p) for k, p in parts if p.any()]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([np.ascontiguousarray(p, "<f8").tobytes() for _, p in parts], pa.binary())], ["block", "sums"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(raw, "<f8")
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.astype("<f8").tobytes() for v in sums.values()], pa.binary())], ["block", "sums"])

    out = np.zeros(size)
    for row in df.mapInArrow(lean(run), "block int, sums binary").repartition("block").mapInArrow(lean(add), "block int, sums binary").collect():
        part = np.frombuffer(row["sums"], "<f8")
        out[row["block"] * block : row["block"] * block + len(part)] = part
    return out

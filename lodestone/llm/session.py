"""Lineage cuts and small helpers that every corpus operator shares."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: So many cuts after which the driver lets go of what it does not use.
CUTS_A_RELEASE = 12
_cuts = count(1)


def release(spark: SparkSession) -> None:
    """Shuffle files and checkpoints that nothing refers to any more go now, and the driver's heap shrinks, not when it happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Memory that this process has freed goes back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` over batches, for mapInArrow. Spark keeps its Python workers for later tasks; each ends its task without the memory that the task has freed."""

    def over(batches):
        yield from run(batches)
        give_back()

    return over


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files.

    The folder is the session's ``spark.checkpoint.dir``; only where that is
    unset on a single machine (tests) is a temporary folder set.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lodestone-"))
    if next(_cuts) % CUTS_A_RELEASE == 0:
        release(spark)
    return df.checkpoint(eager)


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def fold_of(column: str, folds: int):
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def crc_fold(value, folds: int) -> int:
    return zlib.crc32(str(value).encode()) % folds


def fresh_name(base: str, *tables: DataFrame) -> str:
    """A column name that none of the tables has."""
    taken = {c.lower() for t in tables for c in t.columns}
    name = f"_{base}"
    while name in taken:
        name = "_" + name
    return name

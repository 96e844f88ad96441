"""A folder watched for documents, by Structured Streaming's file source.

Changes that come within one trigger interval are one batch, as a debounced
burst would be. A batch that fails is reported and the stream goes on; the paths of
its files are kept and tried again before the next batch, until they succeed.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def watch_folder(spark: SparkSession, folder: str, glob: str = "*.md") -> DataFrame:
    """A stream of (path, modified, content) of new files in a folder, not of those below it."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).option("recursiveFileLookup", "false").load(folder)
    return files.select("path", F.col("modificationTime").alias("modified"), "content")


def failed_batches(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """The paths of each batch that is still to be tried again, by its key."""
    try:
        rows = spark.read.schema("key string, path string, done boolean").json(f"{folder}/*")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return {}
        raise
    left = rows.groupBy("key").agg(F.array_sort(F.collect_set("path")).alias("paths"), F.bool_or("done").alias("done")).where("not done")  # a batch has few files
    return {r["key"]: r["paths"] for r in left.orderBy("key").collect()}


def _note(spark: SparkSession, folder: str, key: str, paths: DataFrame, done: bool) -> None:
    """Keep a batch's paths, or that it has succeeded; written again it is the same."""
    paths.select(F.lit(key).alias("key"), "path", F.lit(done).alias("done")).write.mode("overwrite").json(f"{folder}/{key}-{'done' if done else 'failed'}")


def retry_failed(spark: SparkSession, callback: Callable[..., None], folder: str, on_error: Callable[[Exception], None] | None = None) -> int:
    """Hand each failed batch, read again from its files, to ``callback``; returns how many succeeded. Files that have gone are left out."""
    good = 0
    for key, paths in failed_batches(spark, folder).items():
        held = spark.createDataFrame([(p,) for p in paths], "path string")
        try:
            files = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(sorted({p.rsplit("/", 1)[0] for p in paths}))
            again = files.join(F.broadcast(held), "path", "left_semi").select("path", F.col("modificationTime").alias("modified"), "content")  # a batch has few files
            _call(callback, again, key)
        except Exception as e:
            if on_error:
                on_error(e)
            continue
        _note(spark, folder, key, held, True)
        good += 1
    return good


def _call(callback: Callable[..., None], batch: DataFrame, key: str) -> None:
    callback(batch, key) if len(inspect.signature(callback).parameters) > 1 else callback(batch)


def on_changes(stream: DataFrame, callback: Callable[..., None], checkpoint: str, every: str | None = "800 milliseconds", on_error: Callable[[Exception], None] | None = None, retry: str | None = None):
    """Start a query that hands each batch of changed files to ``callback``.

    ``every`` None takes all there is and ends. An error in the callback goes
    to ``on_error`` and does not stop the stream: the batch's paths are kept in the folder ``retry``
    (below the checkpoint if not given) and tried again before the next batch. A callback of two
    parameters gets the batch's key as well, the same at each trial, by which a write can be made once. If not even the
    paths can be kept, the stream ends, and the batch comes again with its restart.
    """
    folder = retry or f"{checkpoint}/retry"

    def run(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        retry_failed(spark, callback, folder, on_error)
        if batch.isEmpty():
            return
        try:
            _call(callback, batch, f"batch-{n:012}")
        except Exception as e:
            _note(spark, folder, f"batch-{n:012}", batch.select("path"), False)
            if on_error:
                on_error(e)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def ingest_stream(stream: DataFrame, write: Callable[..., None], checkpoint: str, every: str | None = "800 milliseconds", on_error: Callable[[Exception], None] | None = None):
    """Documents of each batch, parsed and handed on as (path, meta, body), with the batch's key if ``write`` takes two parameters."""
    import json

    import pandas as pd

    from ..sources.parsers import split_front_matter

    def parse(batches):
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                meta, body = split_front_matter(bytes(content).decode("utf-8", "replace"))
                rows.append((path, json.dumps(meta, default=str, ensure_ascii=False), body))
            yield pd.DataFrame(rows, columns=["path", "meta", "body"])

    parsed = lambda batch: batch.select("path", "content").mapInPandas(parse, "path string, meta string, body string")
    return on_changes(stream, lambda batch, key: _call(write, parsed(batch), key), checkpoint, every, on_error)


def periodic(spark: SparkSession, job: Callable[[int], None], checkpoint: str, every: str = "1 hour"):
    """Run ``job`` once an interval, one run at a time; the first run comes after one interval."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda _, n: job(n) if n > 0 else None).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()

"""Python workers keep no memory that a task has freed."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.llm import session


def test_a_task_gives_its_memory_back(spark):
    def anon():
        return int(re.search(r"\nAnonymous:\s+(\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

    def run(batches):
        for batch in batches:
            kept = [np.ones(1000) for _ in range(25_000)]  # 200 MB in small parts, below a part that stays
            run.last = [np.ones(1000), len(kept)]
            del kept
            yield batch

    def size(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([anon()])], ["mb"])

    one = spark.range(1).coalesce(1)
    before = one.mapInArrow(size, "mb double").first()[0]
    one.mapInArrow(session.lean(run), "id long").count()
    after = [r["mb"] for r in spark.range(8).repartition(8).mapInArrow(size, "mb double").agg(F.max("mb").alias("mb")).collect()]
    assert max(after) < before + 120

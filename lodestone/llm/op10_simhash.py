"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the radius; two
fingerprints within the radius share a variant, so one shuffle on variants finds
every link. A variant's group holds at most 1 + 64 fingerprints at half radius 1,
all within the radius of each other, so a star to the smallest connects it.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import connected_components
from .session import cut, lean, read


def fingerprint_of(text: bytes, width: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of one text, as a signed long.

    Words of the A-Z lower-cased text, ``width``-word shingles with repeats,
    XXH64; a bit is 1 if set in over half of the hashes. Fewer words: the whole
    sequence is one shingle; none: zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) < width:
        hashes = digest(b" ".join(words), seed)
    else:
        hashes = b"".join([digest(b" ".join(x), seed) for x in zip(*(words[k:] for k in range(width)), strict=False)])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64)
    votes = np.zeros(64, np.int64)
    for k in range(0, len(bits), 65536):
        votes += bits[k : k + 65536].sum(0, dtype=np.int32)
    return int(np.packbits(2 * votes > len(bits)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, h, fp) for each row, h a 64-bit hash of the text; a null or wordless text has fingerprint 0."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([fingerprint_of(t.as_buffer().to_pybytes() if t.is_valid else b"", width) for t in texts], pa.int64())], ["id", "h", "fp"])

    return docs.select(F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("h"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"id {kind}, h long, fp long")


def text_hash(text: Column) -> Column:
    """What tells the texts of one id apart; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def ball_masks(radius: int) -> list[int]:
    """Signed 64-bit masks with up to ``radius // 2`` bits (rounded up) set."""
    half = (radius + 1) // 2
    masks = [sum(1 << b for b in bits) for k in range(half + 1) for bits in combinations(range(64), k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def link_fingerprints(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Verified links (src, dst) between representatives of distinct (fp, rep) rows.

    Radius 2 is exact through one star for each variant: its members are at
    most 1 bit from it. An odd or larger radius would need all pairs of a ball;
    it is refused.
    """
    if radius != 2:
        raise ValueError("only radius 2 links every member of a ball")
    masks = F.array(*[F.lit(m) for m in ball_masks(radius)])
    variants = prints.select("fp", "rep", F.explode(masks).alias("mask")).select(F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"), "fp", "rep")
    least = F.min(F.struct("rep", "fp")).over(Window.partitionBy("variant"))
    pairs = variants.select("fp", "rep", least.alias("least")).where(F.col("rep") != F.col("least.rep"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("least.fp"))) <= radius
    return pairs.where(near).select(F.col("rep").alias("src"), F.col("least.rep").alias("dst"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """One row (id, h, fp, root, component) for each row of ``docs``.

    Links are between fingerprints, so rows that share an id and differ stand on
    their own: root is one fingerprint of the linked ones, component the smallest id of all
    of them, itself included, and h a hash of the text. Ids may be of any type that has an order. Null text
    counts as empty (fingerprint 0, linked like any other). Rows with a null id have
    the component of their fingerprint too (null if no other row there has an id). Repeated rows give
    repeated results; ties cannot occur; texts of any length are read whole; an empty table gives an empty
    result. Other columns are not read.
    """
    prints = cut(fingerprints(docs, id_col, text_col))
    reps = cut(prints.groupBy("fp").agg(F.min("id").alias("rep")))
    groups = connected_components(link_fingerprints(reps.select("fp", F.col("fp").alias("rep")), radius), "src", "dst")
    classes = cut(reps.join(groups, reps.fp == groups.node, "left").select("fp", "rep", F.coalesce(groups.component, reps.fp).alias("root")))
    least = cut(classes.groupBy("root").agg(F.min("rep").alias("component")))
    classes = cut(classes.join(least, "root").select("fp", "root", "component"))
    return prints.join(classes, "fp").select("id", "h", "fp", "root", "component")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


QUERIES = {"op10_simhash": op10_simhash}
SQL: dict[str, str] = {}

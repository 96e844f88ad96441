"""Quality rules: base counts of each text, and a hashed n-gram log-likelihood ratio.

Word unigrams and bigrams are hashed to buckets. One pass counts all documents
(the raw corpus) and the trusted ones; a second pass scores every document by
the mean, over its n-grams, of log((t + m) / (e + m)), where t is the bucket's
trusted count, e what it would be at the raw corpus' rate, and m a shrinkage.
A document's own n-grams are left out of both counts, so that trusted documents
do not vouch for themselves. The threshold is the score that best parts the
labelled good from the labelled bad documents (all of them); it is the same at
every run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import cut, read
from .textkit import U64, WHITE, Slab, chained, slabs

BITS = 17
BLOCK_BITS = 12
SHRINK = 2.0
#: Used where the labels lack one of the two classes.
DEFAULT_THRESHOLD = -0.25
#: Up to so many trusted ids are sent to all executors (16 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def base_counts(slab: Slab) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text of a slab."""
    n, data = slab.n, slab.data
    begin, end, doc = slab.words()
    starts_char = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~WHITE[data] & ((data & 0xC0) != 0x80), out=starts_char[1:])
    symbols = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_SYMBOL[data], out=symbols[1:])
    per_text = lambda sums: sums[slab.offsets[1:]] - sums[slab.offsets[:-1]]
    out = {"n_words": np.bincount(doc, minlength=n), "word_chars": per_text(starts_char), "n_symbols": per_text(symbols)}

    first, last, line_doc = slab.lines()
    words_to = np.zeros(len(data) + 1, np.int64)
    words_to[1:] = np.cumsum(np.bincount(begin, minlength=len(data))[: len(data)])
    full = words_to[last] > words_to[first]
    first, last, line_doc = first[full], last[full], line_doc[full]
    key = slab.hashes(first, last, fold=False)
    order = np.lexsort((key, line_doc))
    again = (key[order][1:] == key[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])
    out["n_dup_lines"] = np.bincount(line_doc[order][1:][again], minlength=n)

    runs, at = chained(slab.hashes(begin, end, fold=False), WINDOW, doc)
    tagged = runs ^ (doc[at].astype(np.uint64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(tagged)
    same = tagged[order][1:] == tagged[order][:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    cover = np.zeros(len(begin) + 1, np.int64)
    np.add.at(cover, at[order[twice]], 1)
    np.add.at(cover, at[order[twice]] + WINDOW, -1)
    out["n_repeat_words"] = np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=n)
    return out


def grams(slab: Slab, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The text and the bucket of each unigram and bigram of a slab."""
    begin, end, doc = slab.words()
    h = slab.hashes(begin, end)
    pairs, at = chained(h, 2, doc)
    buckets = np.concatenate([h, pairs]) >> U64(64 - bits)
    return np.concatenate([doc, doc[at]]), buckets.astype(np.int64)


def _with_trust(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, quality, trusted); labels given twice count as their worst."""
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    marks = marks.select("_id", F.col("quality").cast("int").alias("quality"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("trusted"))
    if labels.count() <= BROADCAST_IDS:
        marks = F.broadcast(marks)
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    return slim.join(marks, "_id", "left").select("_id", "text", "quality", F.coalesce("trusted", F.lit(False)).alias("trusted"))


def gram_counts(docs: DataFrame, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts (trusted, raw) over all rows of (text, trusted).

    Each task sends one dense, fixed-size partial in blocks; the blocks are
    added on executors and 2**bits sums reach the driver.
    """
    block = 1 << min(bits, BLOCK_BITS)

    def count(batches):
        total = np.zeros((2, 1 << bits), np.int64)
        for batch in batches:
            trusted = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for slab in slabs(batch.column(0)):
                doc, bucket = grams(slab, bits)
                total[1] += np.bincount(bucket, minlength=1 << bits)
                total[0] += np.bincount(bucket[trusted[slab.lo : slab.hi][doc]], minlength=1 << bits)
        if total[1].any():
            parts = total.reshape(2, -1, block)
            yield pa.RecordBatch.from_arrays([pa.array(range(parts.shape[1]), pa.int32()), pa.array([parts[:, k].astype("<i4").tobytes() for k in range(parts.shape[1])], pa.binary())], ["block", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(raw, "<i4").astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.astype("<i8").tobytes() for v in sums.values()], pa.binary())], ["block", "counts"])

    partial = docs.select("text", "trusted").mapInArrow(count, "block int, counts binary")
    out = np.zeros((2, (1 << bits) // block, block), np.int64)
    for row in partial.repartition("block").mapInArrow(add, "block int, counts binary").collect():  # 2**bits counts, whatever the input
        out[:, row["block"]] = np.frombuffer(row["counts"], "<i8").reshape(2, block)
    return out[0].ravel(), out[1].ravel()


def scored(docs: DataFrame, trusted: np.ndarray, raw: np.ndarray, bits: int = BITS, shrink: float = SHRINK) -> DataFrame:
    """(_id, quality, the base counts, score) for each row of (_id, text, quality, trusted)."""
    model = docs.sparkSession.sparkContext.broadcast((trusted.astype(np.float64), raw.astype(np.float64)))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def score(slab: Slab, own_trust: np.ndarray) -> np.ndarray:
        good, all_ = model.value
        doc, bucket = grams(slab, bits)
        key = np.sort((doc << bits) | bucket)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        own = np.diff(np.append(first, len(key))).astype(np.float64)
        d, b = key[first] >> bits, key[first] & ((1 << bits) - 1)
        size = np.bincount(doc, minlength=slab.n).astype(np.float64)
        mine = own_trust.astype(np.float64)
        t_total, r_total = good.sum() - mine * size, np.maximum(all_.sum() - size, 1)
        t, r = good[b] - mine[d] * own, all_[b] - own
        ratio = np.log((t + shrink) / (r * (t_total / r_total)[d] + shrink))
        return np.bincount(d, own * ratio, slab.n) / np.maximum(size, 1)

    def run(batches):
        for batch in batches:
            trust = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            parts = [base_counts(s) | {"score": score(s, trust[s.lo : s.hi])} for s in slabs(batch.column(1))]
            if parts:
                columns = [pa.array(np.concatenate([p[k] for p in parts]).astype(np.float64 if k == "score" else np.int64)) for k in [*names, "score"]]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], ["_id", "quality", *names, "score"])

    kind = dict(docs.dtypes)["_id"]
    return docs.select("_id", "text", "quality", "trusted").mapInArrow(run, f"_id {kind}, quality int, " + "".join(f"{n} long, " for n in names) + "score double")


def best_threshold(scores: DataFrame, default: float = DEFAULT_THRESHOLD, step: float = 0.005) -> float:
    """The cut, in whole steps, with the best balanced accuracy on labelled rows; of equals, the middle.

    Only the labelled rows' histogram reaches the driver; scores are held to
    +-10, so it has at most 20 / step bins.
    """
    at = F.floor(F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.col("score"))) / step)
    rows = scores.where("quality in (0, 1) and not base_failed").groupBy(at.alias("bin")).agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad")).orderBy("bin").collect()
    good, bad = sum(r["good"] for r in rows), sum(r["bad"] for r in rows)
    if not good or not bad:
        return default
    g = b = 0
    cuts = [(1.0, rows[0]["bin"])]
    for this, after in zip(rows, [*rows[1:], None], strict=True):
        g, b = g + this["good"], b + this["bad"]
        cuts += [((good - g) / good + b / bad, k) for k in ((this["bin"] + 1, after["bin"]) if after else (this["bin"] + 1,))]
    top = max(c for c, _ in cuts)
    best = [k for c, k in cuts if c >= top - 1e-12]
    return (best[0] + best[-1]) // 2 * step


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, base counts, base_failed, kept, score, threshold.

    ``labels`` has the id, quality (1 good, 0 bad) and toxic; trusted documents
    are good and not toxic. Null text has no words and fails the base rule.
    Texts without words score 0. Repeated rows give repeated results. Ties at
    the threshold are kept. With no trusted rows or no bad ones the default
    threshold holds. Empty tables give an empty result. Other columns are not read.
    """
    marked = _with_trust(docs, labels, id_col, text_col)
    found = scored(marked, *gram_counts(marked))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    found = cut(found.withColumn("base_failed", failed))
    least = best_threshold(found)
    kept = ~F.col("base_failed") & (F.col("score") >= least)
    return found.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "score", F.lit(least).alias("threshold"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


QUERIES = {"op3_quality": op3_quality}
SQL: dict[str, str] = {}

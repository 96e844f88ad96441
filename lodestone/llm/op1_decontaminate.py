"""Benchmark decontamination by latent semantic retrieval.

Passages are runs of WINDOW words at every STRIDE-th word. Their words are hashed
to features and weighted by tf-idf, document frequencies being counted over all
passages of all documents. A distributed randomised SVD with power iterations
decomposes the tf-idf vectors of all passages of all documents, and of all items,
which weigh as much as those together. Its columns are the features of the items.
One pass over the texts adds up the products of these columns, in blocks of rows
that stay distributed. All documents' passages are folded into the latent space of
the leading right singular vectors. A passage is a candidate for each item whose
latent cosine (against the passage's full norm) reaches a threshold set by the
item's length and by how much of it the space holds; one with too little of its
energy on the items' features cannot reach any threshold, and is not projected.
Candidates are then checked on the words themselves: the longest common
subsequence with the item, and how many of its answer words (the rarest) are
there, so paraphrases that keep the order of most words are found and passages
that are only alike are not.

Items are searched in blocks of ITEM_BLOCK, which share one space, so the results
do not depend on it, and the search grows with the stated query set and not with
pairs of documents.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import cut, lean, read
from .textkit import U64, Slab, slabs
from .vectors import summed

BITS = 18
RANK = 128
#: Rows of a block of the columns' products, so many of which (4 bytes each) a task adds up in one reading, and partitions that one such task reads: each sends whole blocks.
BLOCK_ROWS, CELLS, PARTS_A_TASK = 64, 1 << 24, 4
WINDOW, STRIDE = 32, 16
#: Power iterations and seed of the sketch.
POWER_STEPS, SEED = 2, 11
ITEM_BLOCK = 1024
#: Latent cosine of a candidate, as a part of what a verbatim copy amid other words has.
COSINE = 0.45
#: Parts of an item's words in common order, and of its answer words, that make a leak.
MIN_LCS, MIN_ANSWER, ANSWER_WORDS = 0.6, 0.6, 5


def pieces(slab: Slab, bits: int = BITS):
    """Words of a slab: (hash, feature, text), and the first word of each run of STRIDE words of one text."""
    begin, end, doc = slab.words()
    h = slab.hashes(begin, end)
    new = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    place = np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))
    return h, (h >> U64(64 - bits)).astype(np.int64), doc, np.flatnonzero(place % STRIDE == 0)


def passage_ends(doc: np.ndarray, run: np.ndarray) -> np.ndarray:
    """For the passage that begins at each run, the word after its last."""
    ends = np.append(run[1:], len(doc))
    after = np.append(ends[1:], len(doc))
    same = np.append(doc[run[1:]] == doc[run[:-1]], False)
    return np.where(same, after, ends)


def passage_features(feature: np.ndarray, doc: np.ndarray, run: np.ndarray, bits: int):
    """(passage, feature, times) for the distinct features of each passage."""
    return features_between(feature, run, passage_ends(doc, run), bits)


def features_between(feature: np.ndarray, run: np.ndarray, end: np.ndarray, bits: int):
    """(span, feature, times) for the distinct features of each span of words."""
    size = end - run
    owner = np.repeat(np.arange(len(run)), size)
    at = np.repeat(run, size) + np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    key = np.sort((owner << bits) | feature[at])
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[new] >> bits, key[new] & ((1 << bits) - 1), np.diff(np.append(new, len(key)))


def document_frequencies(texts: DataFrame, bits: int = BITS) -> np.ndarray:
    """How many passages have each feature; last, how many passages there are. Over all rows."""

    def partial(batches):
        total = np.zeros((1 << bits) + 1)
        for batch in batches:
            for slab in slabs(batch.column(0)):
                _, feature, doc, run = pieces(slab, bits)
                total[:-1] += np.bincount(passage_features(feature, doc, run, bits)[1], minlength=1 << bits)
                total[-1] += len(run)
        return total

    return summed(texts, partial, (1 << bits) + 1)


def products(passages: DataFrame, columns: np.ndarray, idf: np.ndarray, bits: int = BITS, whole: bool = False, cells: int = CELLS) -> DataFrame:
    """(block, sums): A^T A of the unit tf-idf vectors A of all passages, its upper triangle in blocks of BLOCK_ROWS rows, as float64.

    ``passages`` has (text); with ``whole`` each text is one passage. ``columns`` maps a feature
    to its column, or to their number if it has none, and ascends with it. The texts are read once for each ``cells`` of the triangle.
    """
    spark, n = passages.sparkSession, int(columns.max(initial=0))
    held = spark.sparkContext.broadcast((columns, idf))
    first = np.concatenate([[0], np.cumsum(n - np.arange(n))])  # where each row of the triangle begins
    edges, parts = [*range(0, n, BLOCK_ROWS), n], []
    while len(edges) > 1:
        k = max(1, int(np.searchsorted(first[edges], first[edges[0]] + cells, "right")) - 1)
        parts.append(edges[: k + 1])
        edges = edges[k:]

    def adder(edges: list[int]):
        lo, hi = edges[0], edges[-1]
        at = first[lo:hi] - first[lo] - np.arange(lo, hi)

        def run(batches):
            columns, idf = held.value
            sums = np.zeros(first[hi] - first[lo], np.float32)
            for batch in batches:
                for slab in slabs(batch.column(0), 1 << 18):
                    _, feature, doc, run = pieces(slab, bits)
                    if not len(run):
                        continue
                    end = passage_ends(doc, run)
                    if whole:
                        run = run[np.concatenate([[True], doc[run[1:]] != doc[run[:-1]]])]
                        end = np.searchsorted(doc, doc[run], "right")
                    owner, f, times = features_between(feature, run, end, bits)
                    value = times * idf[f]
                    value = (value / np.sqrt(np.maximum(np.bincount(owner, value * value, len(run)), 1e-24))[owner]).astype(np.float32)
                    inside = columns[f] < n
                    owner, column, value = owner[inside], columns[f[inside]].astype(np.int64), value[inside]
                    left = np.flatnonzero((column >= lo) & (column < hi))  # of pairs so many columns apart, which one has as many at least
                    for apart in range(len(owner)):
                        left = left[left + apart < len(owner)]
                        left = left[owner[left + apart] == owner[left]]
                        if not len(left):
                            break
                        np.add.at(sums, at[column[left] - lo] + column[left + apart], value[left] * value[left + apart])
            for begin, after in zip(edges[:-1], edges[1:], strict=True):
                part = sums[first[begin] - first[lo] : first[after] - first[lo]]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([begin], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["block", "sums"])

        return run

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(raw.as_buffer(), np.float32)
                sums[k] = sums[k] + part if k in sums else part.astype(np.float64)
        for k, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "sums"])

    tasks = passages.rdd.getNumPartitions()
    few = passages.select("text").coalesce(max(1, min(tasks, max(spark.sparkContext.defaultParallelism, -(-tasks // PARTS_A_TASK)))))
    added = [few.mapInArrow(lean(adder(e)), "block int, sums binary").repartition("block").mapInArrow(lean(add), "block int, sums binary") for e in parts]
    found = cut(reduce(DataFrame.unionByName, added))
    held.destroy()
    return found


def singular_vectors(gram: DataFrame, n: int, rank: int = RANK, steps: int = POWER_STEPS) -> np.ndarray:
    """Leading right singular vectors (n x rank) of A, of which ``gram`` has the blocks (block, sums, weight) of ``products``, to be added up by weight."""
    spark = gram.sparkSession
    rank = min(rank, n)
    few = gram.coalesce(spark.sparkContext.defaultParallelism)

    def product(basis: np.ndarray) -> np.ndarray:
        """A^T A basis; each task adds its own part."""
        given = spark.sparkContext.broadcast(basis)

        def partial(batches):
            basis = given.value
            out = np.zeros(basis.shape)
            for batch in batches:
                for lo, raw, weight in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                    rows = np.zeros((min(BLOCK_ROWS, n - lo), n - lo))
                    rows[np.triu_indices(*rows.shape[:1], m=n - lo)] = np.frombuffer(raw.as_buffer(), "<f8")
                    out[lo : lo + len(rows)] += weight * (rows @ basis[lo:])
                    rows[np.arange(len(rows)), np.arange(len(rows))] = 0
                    out[lo:] += weight * (rows.T @ basis[lo : lo + len(rows)])
            return out.ravel()

        total = summed(few, partial, n * basis.shape[1], 1 << 16).reshape(n, -1)
        given.destroy()
        return total

    q = np.linalg.qr(np.random.default_rng(SEED).standard_normal((n, rank)))[0]
    for _ in range(steps):
        q = np.linalg.qr(product(q))[0]
    image = product(q)  # q^T A^T A q gives the rotation to singular vectors
    _, turn = np.linalg.eigh(q.T @ image)
    return (q @ turn[:, ::-1]).astype(np.float32)


def latent_space(texts: DataFrame, items: DataFrame, idf: np.ndarray, n_passages: int, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(columns, vectors): the items' features' columns, and the singular vectors of all ``n_passages`` passages and the items.

    ``texts`` and ``items`` have (text).
    """
    def partial(batches):
        seen = np.zeros(1 << bits)
        for batch in batches:
            for slab in slabs(batch.column(0)):
                seen[pieces(slab, bits)[1]] = 1
        return seen

    support = np.flatnonzero(summed(items.select("text"), partial, 1 << bits))
    columns = np.full(1 << bits, len(support), np.int32)
    columns[support] = np.arange(len(support))
    if not len(support):
        return columns, np.zeros((0, 1), np.float32)
    every = products(texts, columns, idf, bits).withColumn("weight", F.lit(1.0))
    heavy = products(items, columns, idf, bits, whole=True).withColumn("weight", F.lit(max(n_passages, 1) / max(items.count(), 1)))
    return columns, singular_vectors(every.unionByName(heavy), len(support))


def common_length(item_masks: dict[int, int], size: int, words: list[int]) -> int:
    """Longest common subsequence of an item (bit masks of each word's places) and ``words``, bit-parallel."""
    full, row = (1 << size) - 1, (1 << size) - 1
    for w in words:
        m = item_masks.get(w, 0) & row
        row = ((row + m) | (row - m)) & full
    return size - row.bit_count()


class Index:
    """A block of items: their latent vectors, thresholds and words, and the tables that fold passages in.

    Vectors are times x idf, and norms are theirs, so no cosine is over 1 and the share of a passage's
    energy on the items' features bounds its cosine with any item (``gate``).
    """

    gate = True

    def __init__(self, items: list[tuple], idf: np.ndarray, columns: np.ndarray, vectors: np.ndarray, bits: int = BITS):
        read_ = []
        for key, text in items:
            for slab in slabs(pa.array([text], pa.large_string())):
                begin, end, _ = slab.words()
                h = slab.hashes(begin, end)
                if len(h):
                    read_.append((key, h, (h >> U64(64 - bits)).astype(np.int64)))
        self.bits, self.columns = bits, columns
        self.idf = idf.astype(np.float32)
        support = np.flatnonzero(columns < len(vectors))
        self.table = np.concatenate([vectors * idf[support][:, None], np.zeros((1, vectors.shape[1]))]).astype(np.float32)
        self.items, latent, least = [], [], []
        for key, h, feature in read_:
            v = self.table[columns[feature]].sum(0)
            distinct, times = np.unique(feature, return_counts=True)
            full, size = np.sqrt(((times * self.idf[distinct]) ** 2).sum()), len(h)
            held = np.linalg.norm(v) / max(full, 1e-12)
            latent.append(v / max(np.linalg.norm(v), 1e-12))
            least.append(COSINE * min(held, 1.0) * np.sqrt(min(size, WINDOW) / max(size, WINDOW)))
            words = h.tolist()
            masks: dict[int, int] = {}
            for k, w in enumerate(words):
                masks[w] = masks.get(w, 0) | 1 << k
            feature_of = dict(zip(words, feature.tolist(), strict=True))
            rare = sorted(feature_of, key=lambda w: -idf[feature_of[w]])
            self.items.append((key, masks, size, rare[:ANSWER_WORDS], Counter(words)))
        self.latent, self.least = np.array(latent, np.float32).reshape(len(latent), vectors.shape[1]), np.array(least, np.float32)

    def candidates(self, feature: np.ndarray, doc: np.ndarray, run: np.ndarray):
        """(passage, item, cosine) of the candidates, by item and passage."""
        ends = passage_ends(doc, run)
        column = self.columns[feature]
        owner, own, times = features_between(feature, run, ends, self.bits)
        energy = (times * self.idf[own]) ** 2.0
        whole = np.bincount(owner, energy, len(run))
        on_items = np.bincount(owner, np.where(self.columns[own] < len(self.table) - 1, energy, 0), len(run))
        able = np.flatnonzero(on_items >= max(self.least.min() - 1e-4, 0.0) ** 2 * whole) if self.gate else np.arange(len(run))
        found = []
        for lo in range(0, len(able), 256):
            some = able[lo : lo + 256]
            at = run[some][:, None] + np.arange(WINDOW)
            columns = np.where(at < ends[some][:, None], column[np.minimum(at, len(column) - 1)], len(self.table) - 1)
            latent = self.table[columns].sum(1) / np.sqrt(np.maximum(whole[some], 1e-12))[:, None].astype(np.float32)
            cos = latent @ self.latent.T
            k, item = np.nonzero(cos >= self.least)
            found.append((some[k], item, cos[k, item]))
        at, which, cos = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((at, which))
        return at[order], which[order], cos[order], ends


def search(docs: DataFrame, index: Index, verify: bool = True) -> DataFrame:
    """(_id, item_id, cosine, lcs, answer, first_word, n_words) of the leaks of a block of items.

    ``docs`` has (_id, text). One row for each document and item: of several
    places the one with the longest common subsequence, of equals the first.
    Without ``verify`` every candidate is returned, with lcs and answer as they are.
    """
    held = docs.sparkSession.sparkContext.broadcast(vars(index))

    def leaks(slab: Slab):
        index = Index.__new__(Index)
        vars(index).update(held.value)
        h, feature, doc, run = pieces(slab, index.bits)
        if len(run) and index.items:
            at, which, cos, ends = index.candidates(feature, doc, run)
            k = 0
            while k < len(at):  # neighbouring candidates for one item in one text are one region
                j = k
                while j + 1 < len(at) and which[j + 1] == which[k] and at[j + 1] <= at[j] + 2 and doc[run[at[j + 1]]] == doc[run[at[k]]]:
                    j += 1
                key, masks, size, rare, words = index.items[which[k]]
                d = doc[run[at[k]]]
                start = np.searchsorted(doc, d)
                a, b = max(run[at[k]] - size, start), min(ends[at[j]] + size, np.searchsorted(doc, d, "right"))
                seen = h[a:b].tolist()
                there = set(seen)
                if not verify or sum(n for w, n in words.items() if w in there) >= MIN_LCS * size:
                    # the best stretch of the item's length and a half more, so that far-apart words do not add up
                    span, best = size + size // 2 + 4, (-1, 0, 0)
                    for s in range(0, max(1, len(seen) - span + size // 2 + 1), max(1, size // 4)):
                        got = common_length(masks, size, seen[s : s + span])
                        if got > best[0]:
                            best = (got, s, min(span, len(seen) - s))
                    near = set(seen[best[1] : best[1] + best[2]])
                    answer = sum(w in near for w in rare) / len(rare)
                    if not verify or best[0] >= MIN_LCS * size and answer >= MIN_ANSWER:
                        yield int(d), key, float(cos[k : j + 1].max()), best[0] / size, answer, int(a + best[1] - start), int(best[2])
                k = j + 1

    def run(batches):
        for batch in batches:
            best: dict = {}
            for slab in slabs(batch.column(1)):
                for d, key, *rest in leaks(slab):
                    old = best.get((slab.lo + d, key))
                    if old is None or (rest[1], -rest[3]) > (old[1], -old[3]):
                        best[slab.lo + d, key] = rest
            if best:
                rows = sorted(best)
                columns = list(zip(*(best[r] for r in rows), strict=True))
                yield pa.RecordBatch.from_arrays([pc.take(batch.column(0), pa.array([r[0] for r in rows])), pa.array([r[1] for r in rows], pa.int64()), *(pa.array(c, pa.float64()) for c in columns[:3]), *(pa.array(c, pa.int64()) for c in columns[3:])], ["_id", "item_id", "cosine", "lcs", "answer", "first_word", "n_words"])

    kind = dict(docs.dtypes)["_id"]
    return docs.select("_id", "text").mapInArrow(lean(run), f"_id {kind}, item_id long, cosine double, lcs double, answer double, first_word long, n_words long")


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_block: int = ITEM_BLOCK) -> DataFrame:
    """(id, item_id, cosine, lcs, answer, first_word, n_words): each document and item that it leaks.

    Null and wordless texts and items leak nothing. An item given twice is
    searched twice; a repeated document is reported for each of its rows. The
    answer words of items with fewer words are all of them. Items without an id
    are not searched. An empty table on either side gives an empty result.
    Texts of any length are read whole. Other columns, whatever their names, are not read.
    """
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    known = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    counts = document_frequencies(slim.select("text"))
    idf = np.log((counts[-1] + 1) / (counts[:-1] + 1)) + 0.1
    columns, vectors = latent_space(slim, known, idf, int(counts[-1]))
    found, block = None, []
    for row in chain(known.toLocalIterator(), [None]):
        if row is not None:
            block.append((row["item_id"], row["text"]))
        if len(block) == item_block or row is None and (block or found is None):
            part = search(slim, Index(block, idf, columns, vectors))
            found, block = part if found is None else found.unionByName(part), []
    return found.withColumnRenamed("_id", id_col)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))


QUERIES = {"op1_decontaminate": op1_decontaminate}
SQL: dict[str, str] = {}

"""Language of each word by a linear-chain conditional random field.

Features of a word are hashed: the word itself if it is in the lexicon of the
training rows, its prefixes and suffixes of 1 to 3 bytes, and its byte trigrams.
Transitions are learned from sequences in which pieces of documents in different
languages follow each other, as in code-switched text. Words are labelled by
forward-backward; a text's language is the one with the largest share of
posterior mass, each word weighing the root of its bytes.

The fit uses a bounded sample of labelled rows (TRAIN_DOCS, of TRAIN_BYTES at
most) and runs in one task of an executor; prediction reads every whole text.
Segments of SEGMENT words of many texts advance together. What a text's earlier
and later segments say about a segment is carried over the cuts exactly: each
segment's words are first multiplied into one matrix. Texts over LONG_TEXT bytes
are read in pieces, which are chains of their own.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import cut, fold_of, lean, read
from .textkit import U64, Slab, mix, pieces_of, slabs

BITS = 16
SEGMENT = 256
SLAB_BYTES, LONG_TEXT = 1 << 20, 8 << 20
#: Labelled rows used for the fit, the bytes each may have, and words of them.
TRAIN_DOCS = 1600
TRAIN_BYTES = 65_536
TRAIN_WORDS = 240_000
LEXICON_COUNT = 3
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def word_features(slab: Slab, begin: np.ndarray, end: np.ndarray, lexicon: np.ndarray, bits: int = BITS):
    """Hashed features: a (words, 7) table, and the words' trigrams as (owner, feature). -1: none."""
    def spot(h, salt):
        return (mix(h ^ (U64(salt * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF))) >> U64(64 - bits)).astype(np.int64)

    whole = slab.hashes(begin, end)
    at = np.minimum(np.searchsorted(lexicon, whole), max(len(lexicon) - 1, 0))
    known = lexicon[at] == whole if len(lexicon) else np.zeros(len(whole), bool)
    table = [np.where(known, spot(whole, 1), -1)]
    for k in (1, 2, 3):
        table.append(spot(slab.hashes(begin, np.minimum(begin + k, end)), 1 + k))
        table.append(spot(slab.hashes(np.maximum(end - k, begin), end), 4 + k))
    size = np.maximum(end - begin - 2, 0)
    owner = np.repeat(np.arange(len(begin)), size)
    first = np.repeat(begin, size) + np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    return np.stack(table, 1), owner, spot(slab.hashes(first, first + 3), 8)


def emissions(weights: np.ndarray, table: np.ndarray, owner: np.ndarray, trigrams: np.ndarray) -> np.ndarray:
    """Score of each label for each word; the last row of ``weights`` is zero, for -1."""
    out = weights[table[:, 0]].copy()
    for k in range(1, table.shape[1]):
        out += weights[table[:, k]]
    if len(owner):
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        sums = np.add.reduceat(weights[trigrams], first, axis=0)
        out[owner[first]] += sums / np.sqrt(np.diff(np.append(first, len(owner))))[:, None]
    return out


def segments(doc: np.ndarray, limit: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of each segment: runs of one text, cut every ``limit`` words; longest first."""
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    first = np.flatnonzero(new)
    place = np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))
    first = np.flatnonzero(place % limit == 0)
    size = np.diff(np.append(first, len(doc)))
    order = np.argsort(-size, kind="stable")
    return first[order], size[order]


def posteriors(score: np.ndarray, transition: np.ndarray, first: np.ndarray, size: np.ndarray, pairs: bool = False, doc: np.ndarray | None = None):
    """Marginals of each word; with ``pairs`` also the expected count of each transition.

    Segments come longest first. With ``doc``, the text of each word, neighbouring
    segments of one text are one chain; without it each is a chain of its own.
    """
    e = np.exp(score - score.max(1, keepdims=True)).astype(np.float32) + np.float32(1e-9)
    step = np.exp(transition - transition.max()).astype(np.float32)
    ahead, back = np.empty_like(e), np.empty_like(e)
    live = [int(np.searchsorted(-size, -t, "left")) for t in range(int(size[0]) if len(size) else 0)]
    before, after = carried(e, step, first, size, doc)
    for t, m in enumerate(live):
        at = first[:m] + t
        a = e[at] * (ahead[at - 1] @ step if t else before)
        ahead[at] = a / a.sum(1, keepdims=True)
    back[first + size - 1] = after
    for t in range(len(live) - 1, 0, -1):
        at = first[: live[t]] + t
        b = (back[at] * e[at]) @ step.T
        back[at - 1] = b / b.sum(1, keepdims=True)
    p = ahead * back
    p /= p.sum(1, keepdims=True)
    if not pairs:
        return p
    later = np.ones(len(e), bool)
    later[first] = False
    at = np.flatnonzero(later)
    joint = ahead[at - 1][:, :, None] * step[None] * (e[at] * back[at])[:, None, :]
    return p, (joint / joint.sum((1, 2), keepdims=True)).sum(0)


def carried(e: np.ndarray, step: np.ndarray, first: np.ndarray, size: np.ndarray, doc: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """What the words before and after each segment say about its first and its last word's label."""
    n, k = len(first), e.shape[1]
    before, after = np.ones((n, k), np.float32), np.ones((n, k), np.float32)
    if doc is None or not n:
        return before, after
    order = np.argsort(first)
    follows = np.append(False, doc[first[order][1:]] == doc[first[order][:-1]])
    if not follows.any():
        return before, after
    whole = np.zeros(n, bool)  # segments of texts that have several
    whole[order] = follows | np.append(follows[1:], False)
    some = np.flatnonzero(whole)  # still longest first
    product = np.tile(np.eye(k, dtype=np.float32), (len(some), 1, 1))
    begins = np.zeros(n, bool)
    begins[order] = ~follows
    for t in range(int(size[some[0]])):
        m = int(np.searchsorted(-size[some], -t, "left"))
        moved = (product[:m].reshape(-1, k) @ step).reshape(m, k, k) if t else np.where(begins[some[:m], None, None], product[:m], step)
        moved *= e[first[some[:m]] + t][:, None, :]
        product[:m] = moved / moved.max((1, 2), keepdims=True)
    of = np.full(n, -1)
    of[some] = np.arange(len(some))
    place = np.arange(n) - np.maximum.accumulate(np.where(follows, 0, np.arange(n)))  # of each segment in its text
    carry = np.ones((n, k), np.float32)  # the label of the word before each segment
    for j in range(1, int(place.max()) + 1):
        now = np.flatnonzero(place == j)
        v = np.einsum("ni,nij->nj", carry[now - 1], product[of[order[now - 1]]])
        carry[now] = v / v.sum(1, keepdims=True)
        before[order[now]] = carry[now] @ step
    for j in range(int(place.max()), 0, -1):
        now = np.flatnonzero(place == j)
        v = np.einsum("nij,nj->ni", product[of[order[now]]], after[order[now]])
        after[order[now - 1]] = v / v.sum(1, keepdims=True)
    return before, after


def fit(texts: list[str], langs: list[str], bits: int = BITS, words: int = TRAIN_WORDS, passes: int = 3, rate: float = 0.25, seed: int = 7):
    """(labels, weights, transitions, lexicon) from labelled texts, by Adagrad on the CRF's likelihood.

    Whole rows are taken in the order given until ``words`` words are reached.
    """
    labels = sorted(set(langs))
    rng = np.random.default_rng(seed)
    kept, table, grams, sizes, hashes, y = 0, [], [], [], [], []
    for slab in slabs(pa.array(texts, pa.large_string())):
        begin, end, doc = slab.words()
        if kept and kept + len(begin) > words:
            over = np.searchsorted(np.cumsum(np.bincount(doc, minlength=slab.n)), words - kept, "right")
            begin, end, doc = (x[: np.searchsorted(doc, max(over, 0))] for x in (begin, end, doc))
        hashes.append((slab, begin, end, doc, slab.hashes(begin, end)))
        kept += len(begin)
        if kept >= words:
            break
    seen, counts = np.unique(np.concatenate([h[4] for h in hashes]) if hashes else np.zeros(0, np.uint64), return_counts=True)
    lexicon = seen[counts >= LEXICON_COUNT]
    index = {k: i for i, k in enumerate(labels)}
    chunks, base = [], 0
    for slab, begin, end, doc, _ in hashes:
        t, owner, g = word_features(slab, begin, end, lexicon, bits)
        table.append(t)
        grams.append(g)
        sizes.append(np.bincount(owner, minlength=len(begin)))
        y.append(np.array([index[langs[slab.lo + d]] for d in range(slab.n)], np.int64)[doc])
        first, size = segments(doc, 24)
        chunks += [(base + f, s) for f, s in zip(first, size, strict=True)]
        base += len(begin)
    n_labels = len(labels)
    weights, transition = np.zeros(((1 << bits) + 1, n_labels), np.float32), np.zeros((n_labels, n_labels), np.float32)
    if n_labels < 2 or not base:
        return labels, weights, transition, lexicon
    table, grams, sizes, y = np.concatenate(table), np.concatenate(grams), np.concatenate(sizes), np.concatenate(y)
    gram_from = np.concatenate([[0], np.cumsum(sizes)])
    seen_w, seen_t = np.full_like(weights, 1e-3), np.full_like(transition, 1e-3)
    for _ in range(passes):
        order = rng.permutation(len(chunks))
        for lot in range(0, len(order), 256):
            ids, place, pieces = order[lot : lot + 256], [], []
            for k in range(0, len(ids), 6):  # six pieces of different documents make a sequence
                run = [np.arange(chunks[i][0], chunks[i][0] + chunks[i][1]) for i in ids[k : k + 6]]
                pieces.append(np.concatenate(run))
                place.append(np.full(len(pieces[-1]), k))
            at, seq = np.concatenate(pieces), np.concatenate(place)
            first, size = segments(seq, 1 << 20)
            owner = np.repeat(np.arange(len(at)), sizes[at])
            g = grams[np.repeat(gram_from[at], sizes[at]) + np.arange(len(owner)) - np.repeat(np.cumsum(sizes[at]) - sizes[at], sizes[at])]
            p, joint = posteriors(emissions(weights, table[at], owner, g), transition, first, size, pairs=True)
            miss = p
            miss[np.arange(len(at)), y[at]] -= 1
            told = np.ones(len(at), bool)
            told[first] = False
            told = np.flatnonzero(told)
            np.subtract.at(joint, (y[at[told - 1]], y[at[told]]), 1)
            scale = 1 / np.sqrt(np.maximum(sizes[at], 1))
            feature = np.concatenate([table[at].ravel(), g])
            per = np.concatenate([np.repeat(miss, table.shape[1], 0), miss[owner] * scale[owner][:, None]])
            keep = feature >= 0
            touched, where = np.unique(feature[keep], return_inverse=True)
            grad = np.stack([np.bincount(where, per[keep][:, c], len(touched)) for c in range(n_labels)], 1).astype(np.float32)
            seen_w[touched] += grad**2
            weights[touched] -= rate * grad / np.sqrt(seen_w[touched])
            joint = (joint / len(at)).astype(np.float32)
            seen_t += joint**2
            transition -= 0.1 * joint / np.sqrt(seen_t)
        weights *= np.float32(0.98)
    weights[-1] = 0
    return labels, weights, transition, lexicon


def label_words(slab: Slab, model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First byte, byte after the last, text, and posteriors of each word of a slab."""
    labels, weights, transition, lexicon = model
    begin, end, doc = slab.words()
    if not labels:
        return begin, end, doc, np.zeros((len(begin), 0), np.float32)
    score = emissions(weights, *word_features(slab, begin, end, lexicon, int(len(weights) - 1).bit_length() - 1))
    return begin, end, doc, posteriors(score, transition, *segments(doc), doc=doc) if len(begin) else np.zeros((0, len(labels)), np.float32)


def has_letter(slab: Slab) -> np.ndarray:
    """Whether each text has a letter of any script."""
    sums = np.zeros(len(slab.data) + 1, np.int64)
    np.cumsum(_LETTER[slab.data], out=sums[1:])
    out = sums[slab.offsets[1:]] > sums[slab.offsets[:-1]]
    np.cumsum(slab.data >= 0x80, out=sums[1:])
    for k in np.flatnonzero(~out & (sums[slab.offsets[1:]] > sums[slab.offsets[:-1]])):
        out[k] = any(c.isalpha() for c in slab.data[slab.offsets[k] : slab.offsets[k + 1]].tobytes().decode("utf-8", "replace"))
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES):
    """Fit on the ``rows`` labelled rows, of up to ``most_bytes`` each, whose ids hash lowest; with fewer, on all.

    The sample goes to one task; the driver gets the model alone.
    """
    pool = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.octet_length(F.col(text_col).cast("string")) <= most_bytes))
    h = F.xxhash64(F.col(id_col).cast("string"))
    most = pool.select(h.alias("h")).orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    if most is None:
        return [], np.zeros(((1 << BITS) + 1, 0), np.float32), np.zeros((0, 0), np.float32), np.zeros(0, np.uint64)
    sample = pool.where(h <= most).select(h.alias("h"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")).orderBy("h", "l", "t").limit(rows)

    def run(batches):
        texts, langs = [], []
        for batch in batches:
            texts += batch.column(1).to_pylist()
            langs += batch.column(2).to_pylist()
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, langs))], pa.binary())], ["model"])

    return pickle.loads(sample.coalesce(1).mapInArrow(lean(run), "model binary").first()["model"])


def languages(texts, model) -> tuple[list[str], np.ndarray]:
    """The language and its share of posterior mass, for each text of an Arrow column."""
    labels = model[0]
    mass, letter = np.zeros((len(texts), max(1, len(labels)))), np.zeros(len(texts), bool)
    for slab, *_ in pieces_of(texts, SLAB_BYTES, LONG_TEXT):
        begin, end, doc, p = label_words(slab, model)
        for c in range(len(labels)):
            mass[slab.lo : slab.hi, c] += np.bincount(doc, p[:, c] * np.sqrt(end - begin), slab.n)
        letter[slab.lo : slab.hi] |= has_letter(slab)
    total, best = mass.sum(1), mass.argmax(1)
    sure = letter & (total > 0)
    return [labels[b] if s else "und" for b, s in zip(best, sure, strict=True)], np.where(sure, mass[np.arange(len(texts)), best] / np.maximum(total, 1e-9), 0.0).clip(0, 1)


def identify(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for each row; score is the language's share of posterior mass.

    ``und`` with score 0 if the text is null or has no letter, or nothing was
    learned. Of equal shares the first language in order wins. Repeated rows
    give repeated results; an empty table gives an empty result; texts of any
    length are read whole. Other columns, whatever their names, are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            lang, share = languages(batch.column(1), held.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(share)], ["_id", "lang_pred", "score"])

    kind = dict(docs.dtypes)[id_col]
    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"_id {kind}, lang_pred string, score double")
    return out.withColumnRenamed("_id", id_col)


def in_known_language(docs: DataFrame, model, min_share: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is known and has ``min_share`` of the mass."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    where = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            lang, share = languages(batch.column(where), held.value)
            known = np.array([x != "und" for x in lang], bool)
            yield batch.filter(pa.array(known & (share >= min_share)))

    return docs.mapInArrow(lean(run), docs.schema)


def switched_words(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, position, word, lang, probability): the label of every word of every text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        labels = held.value[0]
        for batch in batches:
            for slab in slabs(batch.column(1)):
                begin, end, doc, p = label_words(slab, held.value)
                if len(begin) and labels:
                    first = np.searchsorted(doc, doc)
                    words = [slab.data[b:e].tobytes().decode("utf-8", "replace") for b, e in zip(begin, end, strict=True)]
                    yield pa.RecordBatch.from_arrays([pc.take(batch.column(0), pa.array(doc + slab.lo)), pa.array(np.arange(len(doc)) - first), pa.array(words, pa.string()), pa.array([labels[b] for b in p.argmax(1)], pa.string()), pa.array(p.max(1).astype(np.float64))], ["_id", "position", "word", "lang", "probability"])

    kind = dict(docs.dtypes)[id_col]
    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"_id {kind}, position long, word string, lang string, probability double")
    return out.withColumnRenamed("_id", id_col)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = train(docs.where(fold_of("doc_id", 4) != 2))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op8_langid": op8_langid}
SQL: dict[str, str] = {}

"""Models are fitted on all rows."""

import random

import numpy as np
import pytest

from lodestone.llm import op1_decontaminate as op1
from lodestone.llm import op9_mixing as op9
from lodestone.llm.textkit import slabs


@pytest.mark.parametrize("cells", [1 << 24, 5000])
def test_op1_space_is_that_of_all_passages(spark, cells, monkeypatch):
    rng = random.Random(5)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 400}"
    rows = [" ".join(word() for _ in range(rng.randrange(1, 90))) for _ in range(1500)] + [None, " "]
    items = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(5, 60))) for _ in range(20)]
    docs = spark.createDataFrame([(t,) for t in rows], "text string").repartition(3)
    counts = op1.document_frequencies(docs)
    idf = np.log((counts[-1] + 1) / (counts[:-1] + 1)) + 0.1
    monkeypatch.setattr(op1.products, "__defaults__", (*op1.products.__defaults__[:-1], cells))
    columns, vectors = op1.latent_space(docs, spark.createDataFrame([(t,) for t in items], "text string"), idf, int(counts[-1]))

    n = int(columns.max())

    def row(words):
        """A passage's unit vector on the columns, one feature at a time."""
        h = {}
        for slab in op1.slabs(op1.pa.array([" ".join(words)])):
            for f in op1.pieces(slab)[1].tolist():
                h[f] = h.get(f, 0) + 1
        out, norm = np.zeros(n), sum((k * idf[f]) ** 2 for f, k in h.items()) ** 0.5
        for f, k in h.items():
            if columns[f] < n:
                out[columns[f]] += k * idf[f] / norm
        return out

    passages = [w[k : k + op1.WINDOW] for t in rows if t for w in [t.split()] for k in range(0, len(w), op1.STRIDE)]
    assert len(passages) == counts[-1]
    a = np.array([row(p) for p in passages])
    b = np.array([row(t.split()) for t in items])
    gram = a.T @ a + len(passages) / len(items) * (b.T @ b)
    held = np.trace(vectors.T @ gram @ vectors) / np.linalg.eigvalsh(gram)[-vectors.shape[1] :].sum()
    assert vectors.shape == (n, op1.RANK) and 0.98 < held < 1 + 1e-5
    q = np.linalg.qr(np.random.default_rng(op1.SEED).standard_normal((n, op1.RANK)))[0]
    for _ in range(op1.POWER_STEPS):
        q = np.linalg.qr(gram @ q)[0]
    assert np.allclose(q @ q.T, vectors @ vectors.T, atol=1e-3)


def test_op9_weights_are_fitted_on_all_bits_of_all_rows(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: f"w{int(rng.paretovariate(0.8)) % 3000}"
    texts = [" ".join(word() for _ in range(rng.randrange(1, 25))) for _ in range(1500)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    met, fitted = [], op9.fitted
    monkeypatch.setattr(op9, "fitted", lambda cells, *rest: met.append((cells, fitted(cells, *rest))) or met[-1][1])
    monkeypatch.setattr(op9, "SLAB_BYTES", 5000)
    assert op9.score_texts(docs, docs).count() == len(texts)
    (cells, weights), (spelled, spell_weights) = met

    counts = {}
    for w in (w for t in texts for w in (t or "").split()):
        counts[w] = counts.get(w, 0) + 1
    heavy = sorted(((w.encode(), c) for w, c in counts.items() if c > 1), key=lambda x: (-x[1], x[0]))
    once = [w.encode() for w, c in counts.items() if c == 1]
    assert len(once) > 100
    table = op9.word_table(op9.pa.array([w for w, _ in heavy], op9.pa.binary()), np.array([c for _, c in heavy]), len(texts), len(once))
    slab = next(slabs(op9.pa.array(texts), 1 << 40))
    bits, *_ = op9.word_bits(slab, table, op9.slot_bits_for(sum(counts.values()) + len(texts)), np.zeros(2, np.uint64))
    for got, (bits, n_slots), weights, start in ((cells, (bits, 1 << 20), weights, (1, 0.1, 0.1)), (spelled, (op9.spelled_bits(op9.pa.array(once, op9.pa.binary()), op9.byte_code()), None), spell_weights, (0.2, 0.4, 0.4))):
        assert sum(got["n"].to_pylist()) == len(bits[0])  # each bit of each row
        if n_slots is None:  # their tables count all words, in which others are
            assert np.abs(weights[:, :3] - start).max() > 0.05
            continue
        counted = [np.zeros(n_slots, np.int64) for _ in bits[2]]
        for c, s in zip(counted, bits[2], strict=True):
            np.add.at(c, 2 * s.astype(np.int64) + bits[0], 1)
        xs, gate = op9.inputs(bits, [op9.states(c[::2], c[1::2]) for c in counted], own=True)
        xs = np.stack([*xs, np.ones(len(gate))], 1)
        found, best = np.tile([*start, 0.0], (op9.GATES, 1)), None
        for _ in range(op9.FIT_ROUNDS):
            p = 1 / (1 + np.exp(-np.clip((found[gate] * xs).sum(1), -op9.MAX_ODDS, op9.MAX_ODDS)))
            likely = np.log(np.where(bits[0], p, 1 - p)).sum()
            best = max(best or (-np.inf, 0, found), (likely, 0, found), key=lambda x: x[0])
            found = found.copy()
            for g in range(op9.GATES):
                x, q, y = xs[gate == g], p[gate == g], bits[0][gate == g]
                slope = x.T @ (y - q) - 20.0 * (found[g] - [*start, 0.0])
                found[g] = np.clip(found[g] + np.linalg.solve((x.T * (q * (1 - q))) @ x + 20.0 * np.eye(4), slope), -3, 3)
        assert np.allclose(weights, best[2], atol=0.05)


def test_op9_dense_counts_are_sent_two_to_a_byte(spark):
    def draws(k):
        r = np.random.default_rng(k)
        return np.concatenate([r.integers(0, 1 << 17, 150_000), r.integers(0, 3000, 30_000), np.full(9000, 7)]).astype(np.int32), r.integers(0, 2, 189_000).astype(np.uint8)

    def events(batches, add):
        for k in (k for batch in batches for k in batch.column(0).to_pylist()):
            slot, bit = draws(k)
            add(bit, [slot])
        return np.zeros(768)

    counted = np.zeros((1 << 17, 2), np.int64)
    for k in range(8):
        slot, bit = draws(k)
        np.add.at(counted, (slot, bit), 1)
    tables, _ = op9.counted_states(spark.range(8).repartition(4), events, 1, 17)
    assert (tables[0] == op9.states(counted[:, 0], counted[:, 1])).all()

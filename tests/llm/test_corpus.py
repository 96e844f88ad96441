"""The corpus operators against brute force, on small fixtures with nulls, ties, repeated and empty input."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import components, op1_decontaminate, op2_substrings, op3_quality, op4_revisit, op5_licence, op6_quotes, op7_mixing, op8_langid, op9_mixing, op10_simhash
from lodestone.llm.textkit import slabs

WORD = re.compile("[^\x20\x09-\x0d]+")
SYLLABLES = {"en": "the ing er tion and th re on at st".split(), "de": "sch ung der ein ver keit lich ach und zu".split(), "fr": "eau que ment eux oi le la tre ch é".split()}
DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def words(rng, n, lang="en"):
    return [rng.choice(SYLLABLES[lang]) + rng.choice(SYLLABLES[lang]) + rng.choice(["", rng.choice(SYLLABLES[lang])]) for _ in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "x") for i, t, lang, s in rows], DOCS)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows = []
    for i in range(60):
        lang = ("en", "de", "fr")[i % 3]
        lines = [" ".join(words(rng, rng.randrange(5, 40), lang)) for _ in range(rng.randrange(1, 6))]
        rows.append((i, "\n".join(lines), lang, f"s{i % 4}"))
    rows += [(60, None, "en", None), (61, "", None, "s1"), (62, " \t\n ", "en", "s1"), (63, "Zwei", "de", "s1"), (64, rows[0][1], "en", "s0"), (65, rows[0][1], "en", "s0"), (66, rows[3][1].upper(), "en", "s2")]
    rows += [(67, " ".join(words(rng, 9000)), "en", "s3"), (68, "dup dup\nline\nline\n x\n x\n" + "a b c d e f g h " * 5, "en", "s1"), (69, "ação über 東京 #$%", "de", "s2"), (70, "123 456 !!", None, "s2")]
    return rows


def test_words_and_lines_of_slabs(corpus):
    texts = [t for _, t, *_ in corpus]
    k = 0
    for slab in slabs(pa.array(texts), 500):
        begin, end, doc = slab.words()
        got = [[] for _ in range(slab.n)]
        for b, e, d in zip(begin, end, doc, strict=True):
            got[d].append(slab.data[b:e].tobytes().decode())
        assert got == [WORD.findall(t or "") for t in texts[slab.lo : slab.hi]]
        b, e, d = slab.lines()
        assert np.bincount(d, minlength=slab.n).tolist() == [(t or "").count("\n") + 1 for t in texts[slab.lo : slab.hi]]
        k += slab.n
    assert k == len(texts)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500, k) for k in range(501, 560)] + [(k, k + 1) for k in range(700, 760)] + [(None, 1), (5, 5)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in parent}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op10(spark, corpus, tmp_path):
    table(spark, corpus).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in op10_simhash.op10_simhash(spark, str(tmp_path)).collect()}
    prints = {i: brute_fingerprint(t) for i, t, *_ in corpus}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == prints
    parent = {i: i for i in prints}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2 and find(a) != find(b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert {i: r["component_id"] for i, r in got.items()} == {i: find(i) for i in prints}


def test_op10_links_at_every_distance(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = sorted({b ^ sum(1 << k for k in rng.sample(range(64), n)) for b in base for n in (0, 1, 2, 3, 4)})
    rows = [(p - (1 << 64) if p >> 63 else p, k) for k, p in enumerate(prints)]
    links = op10_simhash.link_fingerprints(spark.createDataFrame(rows, "fp long, rep long"))
    got = {r["node"]: r["component"] for r in components.connected_components(links, "src", "dst").collect()}
    near = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    assert {x for pair in near for x in pair} == set(got) and all(got[a] == got[b] for a, b in near)
    assert op10_simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_op3(spark, corpus, tmp_path):
    table(spark, corpus).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 10 != 3), 0) for i in range(50)] + [(1, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r["doc_id"]: r for r in op3_quality.op3_quality(spark, str(tmp_path)).collect()}
    assert set(got) == {i for i, *_ in corpus}
    for i, t, *_ in corpus:
        t = t or ""
        w, seen, dup, covered = WORD.findall(t), set(), 0, set()
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        times = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        for k in range(len(w) - 7):
            if times[tuple(w[k : k + 8])] > 1:
                covered |= set(range(k, k + 8))
        r = got[i]
        assert (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)) == tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r["base_failed"] and r["kept"])


def test_op3_score_by_brute_force(spark, corpus):
    docs, bits = table(spark, corpus), 8
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 40, 2)], "doc_id long, quality int, toxic int")
    marked = op3_quality._with_trust(docs, labels, "doc_id", "text")
    good, raw = op3_quality.gram_counts(marked, bits)
    mine = {}
    for slab in slabs(pa.array([t for _, t, *_ in corpus])):
        doc, bucket = op3_quality.grams(slab, bits)
        for d in range(slab.n):
            mine[corpus[slab.lo + d][0]] = np.bincount(bucket[doc == d], minlength=1 << bits)
    trusted = set(range(0, 40, 2))
    assert (raw == sum(mine.values())).all() and (good == sum(mine[i] for i in trusted)).all()
    got = {r["_id"]: r["score"] for r in op3_quality.scored(marked, good, raw, bits).collect()}
    for i, own in mine.items():
        t, r = good - own * (i in trusted), raw - own
        ratio = np.log((t + 2) / (r * t.sum() / max(r.sum(), 1) + 2))
        assert got[i] == pytest.approx(float((own * ratio).sum() / max(own.sum(), 1)), abs=1e-9)
    assert op3_quality.quality(docs.limit(0), labels).count() == 0
    assert op3_quality.quality(docs, labels.limit(0)).where("kept and base_failed").count() == 0


def test_op8(spark, corpus, tmp_path):
    table(spark, corpus).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in op8_langid.op8_langid(spark, str(tmp_path)).collect()}
    assert set(got) == {i for i, *_ in corpus}
    clear = [i for i in range(60) if len(corpus[i][1]) > 60]
    assert sum(got[i]["lang_pred"] == corpus[i][2] for i in clear) >= 0.95 * len(clear)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (60, 61, 62, 70))
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    docs = table(spark, corpus)
    model = op8_langid.train(docs)
    assert op8_langid.in_known_language(docs, model, 0.4).columns == docs.columns
    mixed = spark.createDataFrame([(1, " ".join([*words(random.Random(5), 30, "en"), *words(random.Random(6), 30, "de")]))], "doc_id long, text string")
    labels = [r["lang"] for r in op8_langid.switched_words(mixed, model).orderBy("position").collect()]
    assert labels[:28].count("en") >= 25 and labels[32:].count("de") >= 25
    assert op8_langid.identify(docs.limit(0), model).count() == 0
    assert {r["lang_pred"] for r in op8_langid.identify(docs, op8_langid.train(docs.limit(0))).collect()} == {"und"}


def test_op8_marginals_are_those_of_all_paths():
    rng = np.random.default_rng(2)
    score, step = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))
    p, joint = op8_langid.posteriors(score, step, np.array([0]), np.array([5]), pairs=True)
    want, pairs, total = np.zeros((5, 3)), np.zeros((3, 3)), 0.0
    for path in np.ndindex(*(3,) * 5):
        w = math.exp(sum(score[k, s] for k, s in enumerate(path)) + sum(step[a, b] for a, b in zip(path, path[1:], strict=False)))
        total += w
        for k, s in enumerate(path):
            want[k, s] += w
        for a, b in zip(path, path[1:], strict=False):
            pairs[a, b] += w
    assert np.allclose(p, want / total, atol=1e-4) and np.allclose(joint, pairs / total, atol=1e-3)


def test_op8_chains_run_over_their_cuts():
    """Cut every 256 words, 2,000 words have the marginals of one uncut chain."""
    rng = np.random.default_rng(7)
    sizes = [2000, 256, 257, 3, 700]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    score, transition = rng.normal(0, 1.5, (len(doc), 3)).astype(np.float32), rng.normal(0, 1, (3, 3)).astype(np.float32)
    whole = op8_langid.posteriors(score, transition, *op8_langid.segments(doc, 1 << 20))
    for limit in (1, 7, 256):
        cut = op8_langid.posteriors(score, transition, *op8_langid.segments(doc, limit), doc=doc)
        assert np.allclose(cut, whole, atol=1e-4)


def test_op8_long_texts_and_clashing_names(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(words(rng, 60, lang)), lang, "a") for i, lang in enumerate(["en", "de", "fr"] * 20)] + [(90, " ".join(words(rng, 60_000, "de")), None, "b"), (91, "x" * 300_000, None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    got = {r["doc_id"]: r for r in op8_langid.identify(docs, op8_langid.train(docs)).collect()}
    assert len(got) == len(rows) and got[90]["lang_pred"] == "de" and all(got[i]["lang_pred"] == lang for i, _, lang, _ in rows[:60])


def test_op9(spark, corpus, tmp_path):
    table(spark, corpus).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in op9_mixing.op9_mixing(spark, str(tmp_path)).collect()}
    read = {i: [*re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower()), None] for i, t, *_ in corpus}
    c = Counter(w for i, ws in read.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in read.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        assert r["score"] < 0 and r["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0)
    docs = table(spark, corpus)
    assert op9_mixing.score_texts(docs.limit(0), docs).count() == 0
    assert op9_mixing.score_texts(docs, docs.limit(0)).where("score < 0").count() == len(corpus)


def word_model(counts, ends=3, rare=2):
    return op9_mixing.word_table(pa.array([w for w, _ in counts], pa.binary()), np.array([c for _, c in counts]), ends, rare)


def trained_tables(texts, table, slot_bits):
    tables = [np.zeros(2 << slot_bits, np.int64) for _ in range(2)]
    for slab in slabs(pa.array(texts)):
        bits, *_ = op9_mixing.word_bits(slab, table, slot_bits, np.zeros(2, np.uint64))
        for t, s in zip(tables, bits[2], strict=True):
            np.add.at(t, 2 * s.astype(np.int64) + bits[0], 1)
    return [op9_mixing.states(t[::2], t[1::2]) for t in tables]


def test_op9_probabilities_add_up_to_one():
    """Of all words with a code, the escape and the end, one comes next; so too of all bytes of a spelled word."""
    rng = random.Random(2)
    vocabulary = words(rng, 40)
    counts = [(w.encode(), 2 + k) for k, w in enumerate(dict.fromkeys(vocabulary))]
    table = word_model(counts)
    tables = trained_tables([" ".join(rng.choice(vocabulary) for _ in range(50)) for _ in range(20)], table, 12)
    start = np.tile(np.array([0.8, 0.4, 0.5, 0.1], np.float32), (op9_mixing.GATES, 1))
    at, nodes, sides, odds = table[-1]
    assert len(at) == len(counts) + 3
    next_words = [*(w.decode() for w, _ in counts), "unseen", ""]
    firsts = [f"{vocabulary[0]} {w}".strip() for w in next_words]
    slab = next(slabs(pa.array(firsts)))
    bits, *_ = op9_mixing.word_bits(slab, table, 12, np.zeros(2, np.uint64))
    total = 0.0
    for k, text in enumerate(firsts):
        head = int(np.diff(at)[op9_mixing.leaves(table, slab.hashes(*slab.words()[:2]))[0]])  # bits of the first word
        lo = bits[4][k] + head
        leaf = 0 if k == len(firsts) - 1 else op9_mixing.leaves(table, next(slabs(pa.array([next_words[k]]))).hashes(np.array([0]), np.array([len(next_words[k])])))[0]
        hi = lo + int(np.diff(at)[leaf])
        one = (bits[0][lo:hi], [x[lo:hi] for x in bits[1]], [x[lo:hi] for x in bits[2]], bits[3][lo:hi], np.array([0, hi - lo]))
        total += math.exp(op9_mixing.mixed_log_prob(one, tables, start)[0])
    assert total == pytest.approx(1, abs=1e-3)
    at, nodes, sides, _ = op9_mixing.byte_code()
    paths = {tuple(zip(nodes[a:b].tolist(), sides[a:b].tolist(), strict=True)) for a, b in zip(at, at[1:], strict=False)}
    assert len(paths) == 256 and sum(2.0 ** -len(p) for p in paths) == pytest.approx(1)


def test_op9_mixing_by_brute_force():
    """The vectorised mixer against one bit at a time, weights brought up to date every CHUNK bits."""
    rng = random.Random(3)
    vocabulary = words(rng, 30)
    table = word_model([(w.encode(), 2 + k) for k, w in enumerate(dict.fromkeys(vocabulary))])
    texts = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (1, 30, 900, 0, 7)]
    tables = trained_tables(texts, table, 10)
    slab = next(slabs(pa.array(texts)))
    bits, *_ = op9_mixing.word_bits(slab, table, 10, np.zeros(2, np.uint64))
    start = np.random.default_rng(1).normal(0.4, 0.2, (op9_mixing.GATES, 4)).astype(np.float32)
    got = op9_mixing.mixed_log_prob(bits, tables, start)
    xs, gate = op9_mixing.inputs(bits, tables)
    for k in range(len(texts)):
        more, scale, total = np.zeros(4), 1.0, 0.0
        first, end = int(bits[4][k]), int(bits[4][k + 1])
        cuts = [*range(first, min(end, first + op9_mixing.FIRST), op9_mixing.CHUNK), *range(first + op9_mixing.FIRST, end, op9_mixing.LATER), end]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            add, more_scale = np.zeros(4), 0.0
            for i in range(lo, hi):
                s = np.array([*(x[i] for x in xs), 1.0])
                x = float(((start[gate[i]] + more) * s).sum())
                p = 1 / (1 + math.exp(-min(9, max(-9, x * scale))))
                total += math.log(p if bits[0][i] else 1 - p)
                e = bits[0][i] - p
                add += e * s
                more_scale += e * x
            more += add * np.array([op9_mixing.RATE] * 3 + [op9_mixing.RATE_OFFSET])
            scale += op9_mixing.RATE_SCALE * more_scale
        assert got[k] == pytest.approx(total, rel=1e-3)


def test_op9_states_keep_small_counts_and_give_one_back():
    n0, n1 = (x.ravel() for x in np.meshgrid(np.arange(9), np.arange(4)))
    kept = op9_mixing.states(n0, n1)
    assert len(set(kept.tolist())) == len(kept)
    assert (op9_mixing._LESS[0, op9_mixing.states(n0 + 1, n1)] == kept).all() and (op9_mixing._LESS[1, op9_mixing.states(n0, n1 + 1)] == kept).all()
    odds = op9_mixing._ODDS[op9_mixing.states(np.array([1000, 10, 70000]), np.array([3000, 900, 100]))]
    assert np.allclose(odds, np.log([3, 90, 1 / 700]), atol=0.1)


def test_op9_counts_beyond_a_byte_and_over_tasks(spark):
    """Counts come together from several tasks, whatever their size."""
    rows = spark.range(4000).selectExpr("'a' as text").repartition(8)

    def events(batches, add):
        n = 0
        for batch in batches:
            n += len(batch)
            add(np.ones(len(batch), np.uint8), [np.full(len(batch), 5, np.int32)])
        return np.full(768, n)

    tables, rest = op9_mixing.counted_states(rows, events, 1, 17)
    assert rest[0] == 4000 and tables[0][5] == op9_mixing.states(np.array([0]), np.array([4000]))[0] and (np.delete(tables[0], 5) == 0).all()


def test_op9_long_texts_are_read_in_pieces(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = words(rng, 200)
    texts = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (5000, 40, 300)] + ["x" * 30_000, None, ""]
    docs = spark.createDataFrame([(i, t, 1, "w") for i, t in enumerate(texts)], "doc_id long, text string, k int, word string")
    whole = {r["doc_id"]: r for r in op9_mixing.score_texts(docs, docs).collect()}
    monkeypatch.setattr(op9_mixing, "LONG_TEXT", 4000)
    monkeypatch.setattr(op9_mixing, "SLAB_BYTES", 2000)
    parts = {r["doc_id"]: r for r in op9_mixing.score_texts(docs.repartition(3), docs).collect()}
    for i, r in whole.items():
        assert (parts[i]["n_tokens"], parts[i]["n_known"], parts[i]["train_tokens"]) == (r["n_tokens"], r["n_known"], r["train_tokens"])
        assert parts[i]["base_score"] == pytest.approx(r["base_score"]) and parts[i]["score"] == pytest.approx(r["score"], rel=0.01)


def test_op9_model_beats_chance_and_its_bits_do_not_depend_on_the_batch(spark):
    rng = random.Random(4)
    vocabulary = words(rng, 300)
    texts = [" ".join(rng.choice(vocabulary) for _ in range(200)) for _ in range(30)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    a = {r["doc_id"]: r["score"] for r in op9_mixing.score_texts(docs.where("doc_id < 5"), docs.where("doc_id >= 5")).collect()}
    b = {r["doc_id"]: r["score"] for r in op9_mixing.score_texts(docs.repartition(7), docs.where("doc_id >= 5")).collect()}
    assert all(b[i] == pytest.approx(s, rel=1e-6) for i, s in a.items())
    assert all(-s / math.log10(2) / len(texts[i]) < 2.5 for i, s in a.items())


def test_op2_finds_pasted_passages_and_leaves_the_rest(spark):
    rng = random.Random(8)
    passage, line = words(rng, 60), words(rng, 130)
    rows = []
    for i in range(40):
        body = words(rng, 150)
        if i % 4 == 0:
            body[70:70] = passage
        rows.append([i, " ".join(body)])
    for k in (1, 5, 9):
        edited = [*line]
        edited[10 * k % 80] = "edited"
        rows[k][1] = rows[k][1] + "\n" + " ".join(edited) + "\n" + " ".join(words(rng, 45))
    rows += [[40, None], [41, ""], [42, rows[2][1]], [43, "the\n" * 30]]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, spans string")
    spans = op2_substrings.repeated_spans(docs)
    found = {r["id"]: [(s["b"], s["e"]) for s in r["spans"]] for r in spans.collect()}
    assert set(found) >= {4, 8, 12, 16, 20, 24, 28, 32, 36, 5, 9, 42} and set(found) <= {4, 8, 12, 16, 20, 24, 28, 32, 36, 5, 9, 42, 43}
    for i in range(4, 40, 4):
        (b, e), = found[i]
        assert abs(b - 70) <= 2 and abs(e - 130) <= 2
    assert found[42] == [(0, 150)]
    assert all(any(b <= 150 and e >= 278 for b, e in found[i]) for i in (5, 9))
    left = {r["doc_id"]: r["text"] for r in op2_substrings.without_spans(docs, spans).collect()}
    assert sum(" ".join(passage[5:55]) in (t or "") for t in left.values()) == 1 and left[40] is None and left[3] == rows[3][1]
    assert op2_substrings.repeated_spans(docs.limit(0)).count() == 0


def test_op2_bands_find_similar_lines():
    rng = random.Random(2)
    found = total = 0
    for _ in range(200):
        a = words(rng, 60)
        b = [*a]
        b[rng.randrange(60)] = "changed"
        slab = next(slabs(pa.array([" ".join(a), " ".join(b)])))
        h, _, first, last, _ = op2_substrings.long_lines(slab)
        sh, at = op2_substrings.line_shingles(h, first, last)
        x, y = set(sh[: at[1]].tolist()), set(sh[at[1] :].tolist())
        if len(x & y) >= 0.8 * len(x | y):
            total += 1
            keys = op2_substrings.band_keys(sh, at)
            found += bool((keys[0] == keys[1]).any())
    assert total > 100 and found >= 0.98 * total


def test_op2_links_edited_copies_of_a_line_to_each_other(spark, monkeypatch):
    monkeypatch.setattr(op2_substrings, "BLOCK", 40, raising=False)
    rng = random.Random(11)
    base = words(rng, 130)
    lines = [" ".join(base)]
    for k in range(250):
        edited = [*base]
        for at in rng.sample(range(130), 2):
            edited[at] = f"edited{k}x{at}"
        lines.append(" ".join(edited))
    lines += [" ".join([*base[:65], *words(rng, 65)]) for _ in range(20)]  # alike, but under the threshold
    drift = words(rng, 130)
    for k in range(60):  # a chain, of which no line is near all others
        drift[2 * k] = f"drift{k}"
        lines.append(" ".join(drift))
    slab = next(slabs(pa.array(lines)))
    h, _, first, last, _ = op2_substrings.long_lines(slab)
    shingles, at = op2_substrings.line_shingles(h, first, last)
    sets = [set(x.tolist()) for x in np.split(shingles, at[1:])]
    bands = op2_substrings.band_keys(shingles, at)
    root = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            if (bands[i] == bands[j]).any() and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root = [root[i] if r == root[j] else r for r in root]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    lines_, *rest = op2_substrings.near_lines(texts)
    listed = spark.createDataFrame([(int(k), [int(x) - (1 << 31) for x in s]) for k, s in zip(op2_substrings.long_lines(slab)[4].view(np.int64), [np.array(sorted(s), np.uint64) >> np.uint64(32) for s in sets])], "h long, shingles array<int>")
    got = {r["id"] for r in op2_substrings._line_spans(lines_, *rest, listed).where("e - b >= 130").collect()}
    first_of = {}
    want = {i for i, r in enumerate(root) if first_of.setdefault(r, i) != i}
    assert got == want and len(want) >= 300


def test_op2_spans_do_not_depend_on_how_full_the_bitmap_is(spark, monkeypatch):
    rng = random.Random(12)
    rows = []
    for k in range(60):
        passage = words(rng, 51)
        rows += [(2 * k + d, " ".join([*words(rng, 70), *passage, *words(rng, 70)])) for d in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = lambda: {r["id"]: [tuple(s) for s in r["spans"]] for r in op2_substrings.repeated_spans(docs).collect()}
    want, whole = spans(), op2_substrings.bitmap
    noise = np.random.default_rng(5).integers(0, 256, 1 << 24, dtype=np.uint8)
    for mask in (noise, np.uint8(255)):
        monkeypatch.setattr(op2_substrings, "bitmap", lambda *a, mask=mask: whole(*a) | mask)
        got = spans()
        assert got == want and len(want) >= 59, (len(got), len(want))


def test_op2_extends_as_far_as_any_copy_agrees(spark):
    rng = random.Random(14)
    rows, sides = [], []
    for k in range(240):
        around = [[rng.choice((1, 1, 2)) for _ in range(rng.choice((0, 3, 8, 8)))] for _ in range(2)]
        sides.append(around)
        rows.append((k, k % 12, 100, 110, *([zlib.crc32(repr(x[: n + 1]).encode()) - (1 << 31) for n in range(len(x))] for x in around)))
    found = spark.createDataFrame(rows, "id long, h long, b long, e long, left array<int>, right array<int>")
    got = {}
    for r in op2_substrings._short_spans(found).collect():
        b, e = got.get(r["id"], (r["b"], r["e"]))
        got[r["id"]] = min(b, r["b"]), max(e, r["e"])
        assert r["source"] == r["id"] % 12
    common = lambda x, y: next((n for n, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    reach = lambda k, side: max(common(sides[k][side], sides[i][side]) for i in range(k % 12, 240, 12) if i != k)
    assert got == {k: (100 - reach(k, 0), 110 + reach(k, 1)) for k in range(12, 240)}


def test_op1(spark, monkeypatch):
    rng = random.Random(6)
    items = [(k, " ".join(words(rng, rng.randrange(15, 55), ("en", "de", "fr")[k % 3]))) for k in range(30)] + [(30, None), (31, " "), (None, "no id")]
    rows, want = [], set()
    for i in range(120):
        body = words(rng, 200, ("en", "de", "fr")[i % 3])
        if i % 4 == 0:
            key, text = items[i // 4]
            leak = text.split()
            if i % 8 == 0:  # a paraphrase: some words changed, some added
                for k in range(0, len(leak), 6):
                    leak[k] = "other"
                leak.insert(len(leak) // 2, "added")
            body[50:50] = leak
            want.add((i, key))
        rows.append((i, " ".join(body)))
    rows += [(120, None), (121, ""), (122, items[3][1])]
    want.add((122, 3))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in op1_decontaminate.find_leaks(docs, bench).collect()}
    assert len(got & want) >= 0.9 * len(want) and not got - want
    assert {(i, k) for i, k in want if i % 8 == 4 or i == 122} <= got
    assert op1_decontaminate.find_leaks(docs.limit(0), bench).count() == 0 and op1_decontaminate.find_leaks(docs, bench.limit(0)).count() == 0
    assert {(r["doc_id"], r["item_id"]) for r in op1_decontaminate.find_leaks(docs, bench, item_block=7).collect()} == got
    # the latent search against a check of every passage for every item
    monkeypatch.setattr(op1_decontaminate, "COSINE", -1e9)
    every = {(r["doc_id"], r["item_id"]) for r in op1_decontaminate.find_leaks(docs, bench).collect()}
    assert got <= every and len(got) >= 0.95 * len(every)


def test_op1_more_items_than_dimensions(spark, monkeypatch):
    """With a space smaller than the items' span, and long texts, verbatim leaks are still found."""
    monkeypatch.setattr(op1_decontaminate, "RANK", 12)
    rng = random.Random(16)
    items = [(k, " ".join(words(rng, 40))) for k in range(40)]
    rows = [(i, " ".join([*words(rng, 150), items[i][1], *words(rng, 100)])) for i in range(40)] + [(100 + i, " ".join(words(rng, 300))) for i in range(60)]
    rows += [(200, " ".join([*words(rng, 100_000), items[7][1], *words(rng, 1000)])), (201, "x" * 200_000)]
    docs = spark.createDataFrame([(i, t, 1.0, 2) for i, t in rows], "doc_id long, text string, cosine double, item_id int")
    got = {(r["doc_id"], r["item_id"]) for r in op1_decontaminate.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, i) for i in range(40)} | {(200, 7)}


def test_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 20))] for _ in range(2))
        masks = {}
        for k, w in enumerate(a):
            masks[w] = masks.get(w, 0) | 1 << k
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert op1_decontaminate.common_length(masks, len(a), b) == best[-1][-1]


RECORD = "record_id long, url string, ts long, kind string, http_status int, etag string, last_modified string, headers map<string,string>, payload_digest string"


def test_op4(spark):
    full = lambda i, url, ts, etag, **k: (i, url, ts, "response", k.get("status", 200), etag, k.get("lm"), {"etag": etag or "", "content-type": "t", "age": "1"}, f"d{i}")
    visit = lambda i, url, ts, etag=None, lm=None: (i, url, ts, "revisit", 304, etag, lm, {"age": "9", "connection": "close"}, None)
    rows = [full(1, "http://www.A.com/x/", 10, '"a"'), full(2, "https://a.com/x?utm_source=f", 20, '"b"'), full(3, "http://a.com/x", 20, '"c"', lm="L"), full(4, "http://a.com/x", 25, '"z"', status=404), visit(5, "http://a.com/x#f", 20, '"a"'), visit(6, "http://a.com/x", 21, 'W/"c"'), visit(7, "http://a.com/x", 30, '"b"'), visit(8, "http://a.com/x", 30), visit(9, "http://a.com/x", 30, None, "L"), visit(10, "http://b.com", 30, '"c"'), visit(11, None, None), visit(11, None, None)]
    got = sorted((r["record_id"], r["status"], r["source_id"], r["payload_digest"]) for r in op4_revisit.resolve_revisits(spark.createDataFrame(rows, RECORD)).collect())
    assert got == [(5, "resolved", 1, "d1"), (6, "resolved", 3, "d3"), (7, "mismatch", 3, None), (8, "unverified", 3, "d3"), (9, "resolved", 3, "d3"), (10, "no-response", None, None), (11, "no-response", None, None), (11, "no-response", None, None)]
    merged = op4_revisit.resolve_revisits(spark.createDataFrame(rows, RECORD)).where("record_id = 6").first()["merged_headers"]
    assert merged == {"etag": '"c"', "content-type": "t", "age": "9"}
    assert op4_revisit.resolve_revisits(spark.createDataFrame([], RECORD)).count() == 0


def test_op4_carries_responses_over_time_cuts(spark):
    rng = random.Random(7)
    rows = [(k, f"http://h/{rng.randrange(3)}", rng.randrange(1000), "response" if rng.random() < 0.3 else "revisit", 200, None, None, None, f"d{k}") for k in range(400)]
    got = {r["record_id"]: r["source_id"] for r in op4_revisit.resolve_revisits(spark.createDataFrame(rows, RECORD), time_cuts=20).collect()}
    for k, url, ts, kind, *_ in rows:
        if kind == "revisit":
            before = [(t, i) for i, u, t, kd, *_ in rows if kd == "response" and u == url and t < ts]
            assert got[k] == (max(before)[1] if before else None)


def test_op5(spark):
    texts = ["hello\nReleased under the MIT License.", "Licensed under the Apache License, Version 2.0.\nand more", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "he lost his driving license after the accident", "Die Kinder gehen mit dem Hund", None, "", "© 2020 Foo. All rights reserved. Copyright holder.", "x " * 30000 + "\nReleased under the MIT License."]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(0, texts[0], "z")], "doc_id long, text string, family string")
    got = [(r["doc_id"], r["family"]) for r in op5_licence.scan_licences(docs).orderBy("doc_id").collect()]
    assert got == [(0, "MIT"), (0, "MIT"), (1, "Apache-2.0"), (2, "GPL"), (3, "CC-BY-NC"), (4, "none"), (5, "none"), (6, "none"), (7, "none"), (8, "Proprietary"), (9, "MIT")]
    assert op5_licence.scan_licences(docs.limit(0)).count() == 0


def test_op5_knows_its_templates(spark):
    rows = [(k, t) for k, (f, ts) in enumerate(op5_licence.TEMPLATES.items()) for t in ts]
    names = list(op5_licence.TEMPLATES)
    docs = spark.createDataFrame([(n, names[k], t) for n, (k, t) in enumerate(rows)], "doc_id long, want string, text string")
    got = op5_licence.scan_licences(docs).join(docs, "doc_id")
    right, total = got.where("family = want").count(), len(rows)
    assert right >= 0.9 * total


def test_op5_unknown_licences_and_wrapped_headers(spark):
    """Licences of no family, which no template and no made-up name has, are not confirmed as one; a wrapped header is one paragraph."""
    unknown = ["Licensed under the Eclipse Public License 2.0", "SPDX-License-Identifier: WTFPL", "Licensed under the EUPL, version 1.2", "Business Source License 1.1", "Licensed under the zlib license", "SPDX-License-Identifier: EPL-2.0", "Released under the Boost Software License 1.0", "This software is provided 'as-is', without any express or implied warranty."]
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version."
    known = [(gpl, "GPL"), ("SPDX-License-Identifier: MIT", "MIT"), ("SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("Released under GPL version 2", "GPL"), ("The text is under the\nCC BY-SA 4.0", "CC-BY-SA")]
    docs = spark.createDataFrame(list(enumerate([*unknown, *(t for t, _ in known)])), "doc_id long, text string")
    got = [r for r in op5_licence.scan_licences(docs).orderBy("doc_id").collect()]
    assert [r["family"] for r in got] == ["none"] * len(unknown) + [f for _, f in known]
    assert got[len(unknown)]["n_confirmed"] == 1 and got[len(unknown)]["n_unknown"] == 0


MESSAGE = "conv_id long, turn long, role string, text string"


def test_op6(spark):
    rows = [(1, 0, "user", "What is the answer here?\nSecond line of it."), (1, 1, "assistant", "It is forty-two, I think."), (1, 2, "user", "> What is the ANSWER   here?\nI ask again about it."), (1, 3, "user", ">> what is the answer here?\n> It is forty-two, I think.\nWhy is that so?\n\n\n\nTell me."), (1, 5, "user", "> never said by anyone\nok then"), (2, 0, "user", None), (2, 1, "user", ""), (None, 1, "user", "lost"), (1, 1, "assistant", "It is forty-two, I think.")]
    got = {(r["conv_id"], r["turn"]): r for r in op6_quotes.conversations_in_reply_order(spark.createDataFrame(rows, MESSAGE)).collect()}
    assert {k: r["parent_turn"] for k, r in got.items()} == {(1, 0): None, (1, 1): 0, (1, 2): 0, (1, 3): 1, (1, 5): None, (2, 0): None, (2, 1): 0, (None, 1): None}
    assert got[1, 3]["clean_text"] == "Why is that so?\n\nTell me." and got[1, 3]["n_quoted"] == got[1, 3]["n_linked"] == 2 and got[1, 3]["depth"] == 2
    assert got[1, 5]["n_linked"] == 0 and got[1, 5]["root_turn"] == 5 and got[2, 0]["clean_text"] == ""
    assert op6_quotes.conversations_in_reply_order(spark.createDataFrame(rows, MESSAGE)).count() == len(rows)
    assert op6_quotes.conversations_in_reply_order(spark.createDataFrame([], MESSAGE)).count() == 0


def test_op6_rewrapped_passages_and_inner_levels(spark):
    said = "A paragraph that one\nwriter wrapped here,\nand ends.\n\nYes."
    rows = [
        (1, 0, "user", said), (1, 1, "user", "Something else entirely, said in between."),
        (1, 2, "user", "> A paragraph that one writer\n> wrapped here, and   ENDS.\nMy reply."),
        (1, 4, "user", ">> a paragraph that one writer wrapped here, and ends.\n> never said in these words\nA reply to the reply."),
        (1, 6, "user", "> yes.\n>\n> Yes.\nShort ones count."),
    ]
    got = {r["turn"]: r for r in op6_quotes.conversations_in_reply_order(spark.createDataFrame(rows, MESSAGE)).collect()}
    assert {k: (r["parent_turn"], r["n_quoted"], r["n_linked"]) for k, r in got.items()} == {0: (None, 0, 0), 1: (0, 0, 0), 2: (0, 1, 1), 4: (2, 2, 1), 6: (0, 1, 1)}


def test_op6_long_texts_and_clashing_names(spark):
    text = "\n".join(f"> line {k} of a long quotation" for k in range(100_000))
    plain = text.replace("> ", "")
    rows = [(1, 0, "user", plain, "x", 1), (1, 5, "user", text, "y", 2)]
    got = op6_quotes.conversations_in_reply_order(spark.createDataFrame(rows, MESSAGE + ", level string, piece long")).where("turn = 5").first()
    assert (got["parent_turn"], got["n_quoted"], got["n_linked"], got["clean_text"]) == (0, 1, 1, "")


def test_op6_against_its_sql_on_random_quotations(spark, tmp_path):
    draw = np.random.default_rng(5)
    words = ["alpha beta gamma", "Delta epsilon", "ok", "a longer line of words", ""]
    rows = [(int(draw.integers(3)), int(draw.integers(12)), "user", "\n".join("> " * int(draw.integers(4)) + words[int(draw.integers(5))] for _ in range(int(draw.integers(1, 7))))) for _ in range(60)]
    rows += [(None, 1, "user", "> ok"), (1, None, "user", None), (2, 30, "user", None)]
    folder = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(rows, MESSAGE).coalesce(1).write.parquet(folder)
    got = [tuple(r) for r in op6_quotes.op6_quotes(spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"create view conversations as from '{folder}/*.parquet'")
    want = con.execute(op6_quotes.SQL["op6_quotes"]).fetchall()
    assert Counter(got) == Counter(want) and sum(r[8] or 0 for r in got) > 20


def test_op6_long_threads(spark):
    rows = [(1, k, "user", f"message number {k}") for k in range(100)]
    got = op6_quotes.conversations_in_reply_order(spark.createDataFrame(rows, MESSAGE)).agg(F.max("depth"), F.max("root_turn")).first()
    assert tuple(got) == (99, 0)


def test_op7_power():
    tokens = {"a": 9000, "b": 900, "c": 100}
    shares = {k: v / 10000 for k, v in tokens.items()}
    p = op7_mixing.solve_power(tokens, 0.8, None)
    assert op7_mixing.entropy(op7_mixing.weights_at(shares, p)) == pytest.approx(0.8 * math.log(3), abs=1e-6)
    p = op7_mixing.solve_power(tokens, 0.99, 3.0)
    assert max(w / shares[k] for k, w in op7_mixing.weights_at(shares, p).items()) == pytest.approx(3.0, abs=1e-6)
    assert op7_mixing.solve_power({"a": 5}) == 1.0 and op7_mixing.solve_power({"a": 5, "b": 5}) == 1.0
    with pytest.raises(ValueError):
        op7_mixing.solve_power(tokens, 0.9, 0.5, 1.0)
    p = op7_mixing.solve_power({"a": 500, "b": 400, "c": 300}, 0.8, None, exact=True)
    assert p > 1 and op7_mixing.entropy(op7_mixing.weights_at({"a": 5 / 12, "b": 4 / 12, "c": 3 / 12}, p)) == pytest.approx(0.8 * math.log(3), abs=1e-6)
    assert op7_mixing.solve_power({"a": 500, "b": 400, "c": 300}, 0.8, None) == 1.0
    with pytest.raises(ValueError):
        op7_mixing.solve_power({"a": 5, "b": 5}, 0.5, None, exact=True)
    p = op7_mixing.solve_power({"a": 500, "b": 400, "c": 300}, 0.6, 1.5, exact=True)
    assert 1 < p < 8 and max(w / s for w, s in zip(op7_mixing.weights_at({0: 5 / 12, 1: 4 / 12, 2: 3 / 12}, p).values(), (5 / 12, 4 / 12, 3 / 12), strict=True)) == pytest.approx(1.5, abs=1e-6)


def test_op7_draws_by_brute_force(spark, monkeypatch):
    """Which rows are drawn, how often and in which block, from the hashes alone."""
    monkeypatch.setattr(op7_mixing, "TOKENS_PER_BLOCK", 300)

    def h(*parts):
        x = 42
        for p in parts:
            x = xxhash.xxh64_intdigest(p.encode(), x)
        x = xxhash.xxh64_intdigest((42).to_bytes(4, "little"), x)
        return x - (1 << 64) if x >> 63 else x

    rng = random.Random(6)
    rows = [(i, " ".join(words(rng, rng.randrange(1, 60))), "en", rng.choice(["big"] * 9 + ["mid", "mid", None])) for i in range(200)] + [(300, "long " * 20_000, "en", "long")]
    got = Counter((r["doc_id"], r["block"]) for r in op7_mixing.mix(table(spark, rows), entropy_share=0.9, max_repeats=None, budget_factor=1.3).collect())
    size = {i: len(WORD.findall(t)) for i, t, *_ in rows}
    by = {}
    for i, _, _, s in rows:
        by.setdefault(s, []).append(i)
    tokens = {s: sum(size[i] for i in ids) for s, ids in by.items()}
    total = sum(tokens.values())
    shares = {s: n / total for s, n in tokens.items()}
    weights = op7_mixing.weights_at(shares, op7_mixing.solve_power(tokens, 0.9, None, 1.3))
    want = Counter()
    for s, ids in by.items():
        n = tokens[s]
        blocks = max(1, n // 300)
        whole, rest = divmod(round(weights[s] * total * 1.3), n)
        block = {i: h(str(i)) % blocks for i in ids}
        for b in sorted(set(block.values()), key=lambda b: (h(str(b), str(whole)), b)):
            left = rest
            for i in sorted((i for i in ids if block[i] == b), key=lambda i: (h(str(i), "in"), i)):
                if k := whole + (left > 0):
                    want[i, b] = k
                left -= size[i]
            rest -= sum(size[i] for i in ids if block[i] == b)
    assert got == want


def test_op7_quotas(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(words(rng, rng.randrange(1, 60))), "en", rng.choice(["big"] * 12 + ["mid", "mid", "small", None])) for i in range(400)] + [(400, None, "en", "big"), (401, "  ", "en", "new")]
    drawn = op7_mixing.mix(table(spark, rows), entropy_share=0.9, budget_factor=1.5).collect()
    tokens = Counter()
    for _, t, _, s in rows:
        tokens[s] += len(WORD.findall(t or ""))
    total, got = sum(tokens.values()), Counter()
    for r in drawn:
        got[r["source"]] += r["tokens"]
    weights = {r["source"]: r["weight"] for r in drawn}
    assert sum(weights.values()) == pytest.approx(1) and set(got) == {"big", "mid", "small", None}
    for s, w in weights.items():
        assert 0 <= got[s] - round(w * total * 1.5) < 60
    passes = Counter((r["doc_id"], r["pass_no"]) for r in drawn)
    assert max(passes.values()) == 1 and not {400, 401} & {r["doc_id"] for r in drawn}
    assert op7_mixing.mix(table(spark, []) if False else table(spark, rows).limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    rows = []
    for i in range(90):
        lang = ("en", "de", "fr")[i % 3]
        rows.append([i, " ".join(words(rng, 120, lang)), lang, f"s{i % 3}"])
    passage = words(rng, 60)
    for i in (10, 20, 30):
        rows[i][1] = rows[i][1] + " " + " ".join(passage)
    item = words(rng, 40)
    rows[40][1] = " ".join(words(rng, 60)) + " " + " ".join(item) + " " + " ".join(words(rng, 60))
    rows += [[90, rows[5][1], "en", "s1"], [91, None, "en", "s1"], [92, "123 456", None, "s2"], [92, "123 456", None, "s2"], [5, rows[5][1], "fr", "s2"]]
    docs = table(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, kept = docs, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"stage{k}"))
        now = spark.read.parquet(str(tmp_path / f"stage{k}"))
        kept[name] = [r["doc_id"] for r in now.select("doc_id").collect()]
    assert set(kept["language ID"]) == set(range(91)) and sorted(kept["SimHash near-dedup"]) == list(range(90))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "stage2")).collect()}
    assert sum(" ".join(passage[3:57]) in t for t in texts.values()) == 1
    assert set(kept["benchmark decontamination"]) == set(range(90)) - {40}
    assert set(kept["mixing"]) <= set(kept["benchmark decontamination"])

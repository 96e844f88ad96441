"""Search for many questions: the question grammar, stems, ranks by all spans, fusion, similar rows, grounding, and hashed vectors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import batch, retrieval, search

SCHEMA = "id string, type string, title string, intent_terms string, body string, language string, tags array<string>"


def rows_of(spark, *rows):
    return spark.createDataFrame([(i, kind, title, intent, body, lang, []) for i, kind, title, intent, body, lang in rows], SCHEMA)


def asked(spark, *questions):
    return spark.createDataFrame(list(enumerate(questions)), "q long, question string")


def ids(df, q=0):
    return [r["id"] for r in df.where(F.col("q") == q).orderBy("rank").collect()]


def test_questions():
    words = lambda q: [(b, i, neg, at, w) for b, i, _, _, neg, at, w in search.parse_question(q)]
    assert words("Pix de Chave") == [(0, 0, False, 0, "pix"), (0, 1, False, 0, "chave")]
    assert words('"chave de pix" -qr') == [(0, 0, False, 0, "chave"), (0, 0, False, 2, "pix"), (0, 1, True, 0, "qr")]
    assert words("a1 or -b1 or c1 c1") == [(0, 0, False, 0, "a1"), (1, 0, False, 0, "c1")]
    assert words("or") == words("-x1") == words('""') == words("") == []
    assert [x[2] for x in search.parse_question("-z1 x1 y1")] == [2, 2, 2]


def test_grammar(spark):
    df = rows_of(spark, ("1", "t", "", "", "red blue green", "en"), ("2", "t", "", "", "blue red", "en"), ("3", "t", "", "", "green", "en"), ("4", "t", None, None, None, None), ("5", "t", "Red", "blue", "", "en"))
    posted = search.postings(df)
    found = search.lexical_many(posted, asked(spark, '"red blue"', "red or green", "red -green", "green -red", "-red", "red blue", ""), 10)
    got = {q: sorted(ids(found, q)) for q in range(7)}
    assert got == {0: ["1", "5"], 1: ["1", "2", "3", "5"], 2: ["2", "5"], 3: ["3"], 4: [], 5: ["1", "2", "5"], 6: []}
    assert ids(search.lexical_hits(df, "red blue", 2).withColumn("q", F.lit(0))) == ["5", "2"]  # the title weighs more, then the shorter row
    assert search.lexical_many(posted.limit(0), asked(spark, "red"), 5).count() == search.lexical_many(posted, asked(spark, "red").limit(0), 5).count() == 0


def test_stems_by_language(spark):
    df = rows_of(spark, ("pt", "m", "Devolução de Pix", "", "devoluções de pix e estorno", "pt"), ("en", "m", "Credit Transfer", "", "credit transfers", "en"))
    posted = search.postings(df)
    found = search.lexical_many(posted, asked(spark, "devolução", "transferring"), 5)
    assert ids(found) == ["pt"] and found.where("score > 0").count() == 1
    one = rows_of(spark, ("pt", "m", "Devolução", "", "", "pt"), ("en", "m", "Transfer", "", "", "en"))
    questions = asked(spark, "devoluções", "transfers")
    assert search.lexical_many(search.postings(one), questions, 5).count() == 0  # recall is by the words as they are
    stemmed = search.lexical_many(search.postings(one), questions, 5, stemmed=True)
    assert ids(stemmed, 0) == ["pt"] and ids(stemmed, 1) == ["en"]
    assert search.stem_of("devoluções", "pt") == search.stem_of("devolução", "pt") and search.stem_of("as", "en") == "as"


def covers_by_all_spans(places, wanted):
    """Of all spans that hold each item, those that hold no smaller one."""
    ends = sorted({p for p, _, _ in places})
    holds = lambda a, b: len({k for p, k, _ in places if a <= p <= b}) == wanted
    spans = [(a, b) for a in ends for b in ends if a <= b and holds(a, b)]
    least = [s for s in spans if not any(t != s and s[0] <= t[0] and t[1] <= s[1] for t in spans)]
    total = 0.0
    for a, b in least:
        inside = [w for p, _, w in places if a <= p <= b]
        total += len(inside) / sum(1 / w for w in inside) / (1 + max(b - a + 1 - len(inside), 0))
    return total


def test_cover_density_by_all_spans(spark):
    rng = random.Random(5)
    vocabulary, rows = ["ab", "cd", "ef", "xx", "yy"], []
    for k in range(60):
        text = lambda n: " ".join(rng.choices(vocabulary, k=rng.randint(0, n)))
        rows.append((f"{k:02}", "t", text(3), text(2), text(25), "en"))
    found = search.lexical_many(search.postings(rows_of(spark, *rows)), asked(spark, "ab cd ef", "ab cd", "xx"), 100)
    got = {(r["q"], r["id"]): r["score"] for r in found.collect()}
    want = {}
    for q, words in enumerate((["ab", "cd", "ef"], ["ab", "cd"], ["xx"])):
        for key, _, title, intent, body, _ in rows:
            weighed = [(w, weight) for text, weight in ((title, 1.0), (intent, 0.4), (body, 0.1)) for w in text.split()]
            places = [(p, words.index(w), weight) for p, (w, weight) in enumerate(weighed) if w in words]
            if {k for _, k, _ in places} == set(range(len(words))):
                want[q, key] = covers_by_all_spans(places, len(words)) / (1 + np.log(len(weighed)))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)


def test_written_token_table_is_pruned_by_stem(spark, tmp_path):
    df = rows_of(spark, *[(f"{k}", "t", f"word{k}", "", "common words", "en") for k in range(50)])
    search.write_postings(df, str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    assert "PushedFilters: [In(stem" in table.where(F.col("stem").isin("word7", "word8"))._jdf.queryExecution().toString()
    assert ids(search.lexical_many(table, asked(spark, "word7 common"), 5)) == ["7"]


def test_multi_query_fuses_subqueries(spark):
    df = rows_of(spark, ("x", "t", "notificar via webhook pix", "", "notificação", "pt"), ("y", "t", "notificar via webhook pix", "", "", "pt"))
    latest = spark.createDataFrame([], "id string, vec array<float>")
    hits = batch.multi_many(df, search.postings(df), latest, asked(spark, "notificar via webhook pix"), batch.HashEmbedder(8)).orderBy("rank").collect()
    assert [r["id"] for r in hits] == ["x", "y"] and len(hits[0]["provenance"]) >= 2 and hits[0]["score"] > hits[1]["score"] > 0
    first = hits[0]["provenance"][0]
    assert first["query"] == "notificar via webhook pix" and first["arm"] == "fts"
    assert batch.multi_many(df, search.postings(df), latest, asked(spark, ""), batch.HashEmbedder(8)).count() == 0


def test_hybrid_of_many_is_that_of_each(spark, sf_dir):
    from lodestone.adapters import concepts

    c, latest = concepts(spark, sf_dir), retrieval.latest_vectors(spark, sf_dir)
    vec = [float(x) for x in retrieval._first_vector(spark, sf_dir)]
    questions = spark.createDataFrame([(0, "that from", vec), (1, "was with", vec)], "q long, question string, vec array<double>")
    many = batch.hybrid_many(c, search.postings(c), latest, questions)
    for q, question in ((0, "that from"), (1, "was with")):
        alone = [(r["id"], r["arm"], round(r["score"], 9)) for r in retrieval.hybrid(c, latest, question, vec).orderBy("rank").collect()]
        assert alone == [(r["id"], r["arm"], round(r["score"], 9)) for r in many.where(F.col("q") == q).orderBy("rank").collect()]


def test_similar_signals(spark):
    df = rows_of(spark, ("a.md", "Reference", "Refund Concept", "estorno", "Pix refund details.", "en"), ("endpoint.md", "ApiEndpoint", "Refund Concept estorno", "", "Pix refund details", "en"), ("neighbour.md", "Reference", "N", "", "other", "en"))
    latest = spark.createDataFrame([("a.md", [1.0, 0.0]), ("endpoint.md", [0.9, 0.1])], "id string, vec array<float>")
    links = spark.createDataFrame([("a.md", "neighbour.md", "link"), ("gone.md", "a.md", "link"), ("a.md", "a.md", "link")], "src string, dst string, kind string")
    seeds = spark.createDataFrame([("a.md",), ("neighbour.md",)], "id string")
    out = batch.similar_many(df, search.postings(df), latest, links, seeds, batch.HashEmbedder(2), 10)
    found = {r["id"]: r for r in out.where("q = 'a.md'").collect()}
    assert "a.md" not in found and {"domain", "lexical", "semantic"} <= set(found["endpoint.md"]["why"]) and found["endpoint.md"]["rank"] == 1
    assert found["neighbour.md"]["why"] == ["graph"] or "graph" in found["neighbour.md"]["why"]
    assert found["gone.md"]["type"] == "" and found["gone.md"]["why"] == ["graph"]
    signals = batch.signals_of(df, search.postings(df), latest, links, seeds, batch.HashEmbedder(2), 1)
    assert all(r["rank"] == 1 and r["id"] != r["q"] for s in signals.values() for r in s.collect())


def test_grounding(spark):
    df = rows_of(spark, ("a", "T", "A", "", " alpha ", "en"), ("b", "T", "B", "", "beta", "en"), ("c", "U", "C", "", "gamma", "en"), ("d", "U", "D", "", "  ", "en"), ("e", "U", "E", "", "x" * 50, "en"))
    hits = spark.createDataFrame([(0, "a", "T", 0.9, 1), (0, "b", "T", 0.5, 2), (0, "c", "U", 0.4, 3), (0, "gone", "U", 0.3, 4), (1, "a", "T", 0.01, 1)], "q long, id string, type string, score double, rank long")
    links = spark.createDataFrame([("a", "d", "link"), ("a", "e", "link"), ("b", "a", "link")], "src string, dst string, kind string")
    order = lambda **o: [(r["q"], r["id"]) for r in batch.grounding_many(df, hits, **o).orderBy("q", "ord").collect()]
    assert order() == [(0, "a"), (0, "b"), (0, "c"), (1, "a")]
    assert order(least=0.1, diverse=True) == [(0, "a"), (0, "c"), (0, "b")]
    assert order(least=0.1, links=links) == [(0, "a"), (0, "b"), (0, "c"), (0, "e")]
    assert order(least=0.1, budget=9) == [(0, "a"), (0, "b")] and order(least=0.1, budget=1) == [(0, "a")]
    like = spark.createDataFrame([("a", "e", 1), ("b", "d", 1)], "q string, id string, rank long")
    assert order(least=0.1, like=like)[-1] == (0, "e")


def test_cases(spark):
    hits = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (1, "c", 3)], "q long, id string, rank long")
    wanted = spark.createDataFrame([(0, "b"), (0, "b"), (0, "z"), (1, "c"), (2, "a")], "q long, id string")
    assert sorted(map(tuple, batch.coverage_many(hits, wanted).collect())) == [(0, 1, 2), (1, 1, 1), (2, 0, 1)]
    assert sorted(map(tuple, batch.best_rank_many(hits, wanted).collect())) == [(0, 2), (1, 3), (2, 0)]


def test_hashed_vectors_are_those_of_the_loop():
    def loop(text, dim):
        out = np.zeros(dim, np.float32)
        low = text.lower()
        for k in range(len(low) - 2):
            h = 2166136261
            for byte in low[k : k + 3].encode():
                h = (h ^ byte) * 16777619 & 0xFFFFFFFF
            out[h % dim] += 1
        norm = float(np.sqrt((out.astype(np.float64) ** 2).sum()))
        return out / np.float32(norm) if norm else out

    rng = random.Random(3)
    texts = ["", "ab", "abc", "ÀÉÎ", "日本語テキスト", "a😀b😀c"] + ["".join(rng.choices("abcdefg éçß日😀\n", k=rng.randint(0, 80))) for _ in range(1000)]
    assert np.array_equal(retrieval.hash_rows(texts, 37), np.stack([loop(t, 37) for t in texts]))


def test_words_in_place_are_found_as_by_postings(spark):
    r = random.Random(5)
    words = ["ação", "ações", "pix", "chave", "chaves", "de", "webhook", "red", "reds", "or1"]
    text = lambda n: " ".join(r.choice(words) for _ in range(r.randrange(n)))
    df = rows_of(spark, *[(str(k), "t", text(4), text(3), text(30), r.choice(["en", "pt", None])) for k in range(60)], ("x", "t", None, None, None, None))
    questions = asked(spark, "pix", "ação chave", '"pix chave"', '"chave de pix" or red webhook', "red -pix", "pix -chaves or ação red", "-red", "", "reds chaves", "pix")
    for stemmed in (False, True):
        old, new = (sorted((h["q"], h["id"], round(h["score"], 8), h["rank"]) for h in search.lexical_many(rows, questions, 7, stemmed).collect()) for rows in (search.postings(df), search.word_rows(df)))
        assert old == new and len({h[0] for h in new}) >= 7


def test_words_in_place_are_not_shuffled(spark):
    df = rows_of(spark, *[(str(k), "t", "", "", "pix chave " * 50, "pt") for k in range(300)])
    found = search.lexical_many(search.word_rows(df), asked(spark, "pix", "chave"), 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Explode" not in plan
    assert [h["id"] for h in found.where("q = 0").orderBy("rank").collect()] == ["0", "1", "10"]

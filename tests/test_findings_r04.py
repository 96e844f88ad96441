"""What the findings of round 4 named: questions are computed once and looked for once, and none of a question's subqueries is left out."""

import random

import duckdb
from pyspark.sql import functions as F

from lodestone.operators import batch, retrieval, search, search_queries


def test_questions_are_computed_once_for_all_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(f"{k:02}", "title", "", f"pix chave {'red ' * (k % 3)}", "pt") for k in range(40)], "id string, title string, intent_terms string, body string, language string")
    latest = spark.createDataFrame([(f"{k:02}", [float(k % 5), 1.0]) for k in range(40)], "id string, vec array<float>")
    texts = ["pix", "Pix", "red", "pix", "chave red", "none"]
    computed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            computed.add(len(b))
            yield b

    questions = spark.createDataFrame([(q, t, [1.0, float(q)]) for q, t in enumerate(texts)], "q int, question string, vec array<float>")
    questions = questions.mapInArrow(counted, questions.schema)
    rows = lambda d: sorted((h["q"], h["rank"], h["id"], h["score"]) for h in d.collect())
    whole = rows(search.lexical_many(search.word_rows(df), questions, 3)), rows(search.nearest_many(latest, questions, 3))
    assert computed.value == 2 * len(texts)  # once for each search
    monkeypatch.setattr(search, "BRANCHED_AT_ONCE", 2)
    monkeypatch.setattr(search, "VECTORS_AT_ONCE", 2)
    monkeypatch.setattr(search, "QUESTIONS_AT_ONCE", 2)
    monkeypatch.setattr(search, "HITS_HELD", 2)
    assert (rows(search.lexical_many(search.word_rows(df), questions, 3)), rows(search.nearest_many(latest, questions, 3))) == whole
    assert computed.value == 4 * len(texts)
    found = {q: [h[1:] for h in whole[0] if h[0] == q] for q in range(len(texts))}
    assert found[0] == found[1] == found[3] and len(found[0]) == 3 and not found[5]


def test_a_task_keeps_the_best_hits_of_a_question():
    r = random.Random(1)
    hits = [(r.randrange(3), r.randrange(6) / 4, f"{k:03}") for k in r.sample(range(300), 300)]
    best = search._Best(4)
    for hit in hits:
        best.add(*hit)
    assert all(len(held) < 8 for held in best.held.values())
    found = {}
    for n, name, score in (x for some in best.rows(5) for x in some):
        found.setdefault(n, []).append((score, name))
    assert found == {n: [(s, i) for s, i in sorted(((s, i) for m, s, i in hits if m == n), key=lambda x: (-x[0], x[1]))[:4]] for n in range(3)}


def test_words_of_a_text_are_its_tokens(spark):
    r = random.Random(2)
    texts = ["".join(r.choices("abÇé9_ ²Ⅷ½٣日̃'.-—\n\t 😀", k=r.randrange(60))) for _ in range(300)] + ["".join(f"x{chr(c)}" for c in range(0x2190, 0x2290)), "", "EN En en"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(F.lower("text").alias("low"), search.tokens(F.col("text")).alias("words"))
    assert all(search.words_of(x["low"]) == x["words"] for x in df.collect())


def test_no_subquery_is_left_out(spark):
    vocabulary = tuple(((w[:3],), f"{w} more") for w in "alpha beta gamma delta epsilon zeta".split())
    text = "Zeta, epsilon, delta, gamma, beta, alpha!"
    whole = [text, "zeta epsilon delta gamma beta alpha", *(s for _, s in vocabulary)]
    assert retrieval.expand_question(text, vocabulary) == whole
    found = batch.expanded(spark.createDataFrame([(1, text)], "q long, question string"), vocabulary).collect()
    sql = search_queries.expanded_sql("t", vocabulary, "")
    same = duckdb.sql(f"WITH t AS (SELECT 1::BIGINT AS q, '{text}' AS question), {sql} SELECT q, sub_no, question FROM sq_sub").fetchall()
    assert sorted(map(tuple, found)) == sorted(same) == [(1, n, s) for n, s in enumerate(whole)]
    assert not any("sub_no < 5" in search_queries.SQL[name] for name in ("R10_multi_query", "L08_subquery_limit"))

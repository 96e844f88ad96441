"""What the findings of round 3 named: results, and plans whose work stays in bounds."""

import random

import numpy as np
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.operators import relational, retrieval, search, temporal
from lodestone.sources import parsers


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nearest_rows_over_many_batches(spark):
    r = np.random.default_rng(4)
    rows = np.round(r.standard_normal((3000, 3)), 1)  # many ties, and some vectors of zeros
    rows[::500] = 0
    latest = spark.createDataFrame([(f"{k:04}", v.tolist()) for k, v in enumerate(rows)], "id string, vec array<float>").coalesce(1)
    asked = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows[1:40])] + [(99, [0.0, 0.0, 0.0])], "q int, vec array<float>")
    found = {}
    for h in search.nearest_many(latest, asked, 7).orderBy("q", "rank").collect():
        found.setdefault(h["q"], []).append(h["id"])
    near = rows.astype(np.float32).astype(float)
    unit = near / np.maximum(np.sqrt((near * near).sum(1)), 1e-300)[:, None]
    for q in range(39):
        score = np.round(unit @ unit[q + 1], 6)
        score[::500] = -9
        assert found[q] == [f"{k:04}" for k in np.lexsort((np.arange(3000), -score))[:7]]
    assert 99 not in found


def test_pages_are_counted_without_named_entities(spark):
    page = lambda s: f"<title> T </title><nav>{'n' * 90}</nav><h1>{s}</h1><footer>{'f' * 90}</footer>"
    rows = [("under", page("x" * 38 + "&lt;&gt;")), ("just", page("x" * 40)), ("digits", page("x" * 35 + "&#39;")), ("script", page("x" * 8 + "<script>" + "s" * 32 + "</script>")), ("null", None)]
    found = {r["url"]: r["title"] for r in parsers.page_documents(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert found == {"just": "T", "digits": "T", "script": "T"}


def test_a_stem_is_that_of_the_loop_and_needs_no_pattern(spark):
    r = random.Random(2)
    ends = [e for c in search.ENDINGS.values() for e in c.split("|")]
    words = sorted({"".join(r.choices("abcçã日1", k=r.randrange(5))) + r.choice(ends) for _ in range(2000)})
    df = spark.createDataFrame([(w, c) for w in words for c in ("en", "pt")], "term string, config string").withColumn("stem", search.stem(F.col("term"), F.col("config")))
    assert all(x["stem"] == search.stem_of(x["term"], x["config"]) for x in df.collect())
    assert "regexp_replace" not in plan_of(df)


def test_pairs_of_shared_terms_are_dealt_by_their_number(spark, monkeypatch):
    terms = spark.createDataFrame([(i, t) for t in range(30) for i in range(t % 7)] + [(k, 99) for k in range(40)], "id int, term int")
    whole = sorted(map(tuple, relational.shared_term_peers(terms).collect()))
    monkeypatch.setattr(relational, "PAIRS_A_TASK", 10)
    some = relational.shared_term_peers(terms)
    n = sum((t % 7) * (t % 7 - 1) for t in range(30))
    assert f", {n // 10 + 1})" in plan_of(some) or f", {n // 10 + 1}), REPARTITION_BY_NUM" in plan_of(some)
    assert sorted(map(tuple, some.collect())) == whole and whole


def test_a_first_epoch_moves_no_row(spark):
    new = spark.range(5).select(*[F.col("id").cast(f.dataType).alias(f.name) if f.dataType.simpleString() in ("string", "int") else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.CONCEPT])
    empty = schemas.empty(spark, schemas.CONCEPT)
    assert empty.schema.simpleString() == spark.createDataFrame([], schemas.CONCEPT).schema.simpleString() and not empty.count()
    for merged in (temporal.replace_concepts(empty, new), temporal.upsert_concepts(empty, new)):
        assert "Exchange" not in plan_of(merged) and merged.count() == 5
    old = new.withColumn("first_epoch", F.lit(-1)).withColumn("title", F.lit("old")).where("id > 2")
    whole = temporal.upsert_concepts(old, new).join(new.select("id"), "id", "left_semi").select(new.columns)
    again = temporal.replace_concepts(old, new)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, whole.collect()))
    assert plan_of(again).count("title") < plan_of(whole).count("title")


def test_vectors_are_made_of_arrow_batches(spark):
    df = spark.createDataFrame([("abcd",), (None,), ("",), ("日本語",)] * 300, "text string").withColumn("vec", retrieval.hash_vectors(F.col("text"), 16))
    assert "ArrowEvalPython" in plan_of(df)
    rows = df.collect()
    assert np.array_equal(np.array([r["vec"] for r in rows], np.float32), retrieval.hash_rows([r["text"] or "" for r in rows], 16))

"""Rows that share an id, clashing names, empty tables and long texts in the pipeline's stages; what was lost or damaged before."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import op1_decontaminate, op2_substrings, op4_revisit, op7_mixing, op10_simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def texts(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def bench_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("bench")
    rng = random.Random(4)
    items = [" ".join(words(rng, 30)), " ".join(["yes"] * 20 + words(rng, 12))]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder), items


def test_near_duplicates_tells_rows_of_one_id_apart(spark):
    rng = random.Random(1)
    a, b, c = (" ".join(words(rng, 60)) for _ in range(3))
    rows = [(3, a), (5, a), (5, b), (7, b), (9, c), (9, c), (None, c), (None, "x"), (11, None), (12, "")]
    for order in (rows, rows[::-1]):
        kept = texts(corpus_pipeline.near_duplicates(spark, table(spark, order), ""))
        assert kept == sorted([(3, a), (5, b), (9, c), (None, c), (None, "x"), (11, None)], key=repr)
    # a group of one id: the text of smaller hash, whatever the order of the rows
    similar = [(1, a), (1, a.upper())]
    assert len({tuple(texts(corpus_pipeline.near_duplicates(spark, table(spark, o), ""))) for o in (similar, similar[::-1])}) == 1
    assert corpus_pipeline.near_duplicates(spark, table(spark, similar), "").count() == 1


def test_near_duplicates_of_string_ids(spark):
    docs = spark.createDataFrame([("b", "one two three"), ("a", "one two three"), ("c", "other words here now")], "doc_id string, text string")
    assert {(r["id"], r["component"]) for r in op10_simhash.near_duplicates(docs).collect()} == {("a", "a"), ("b", "a"), ("c", "c")}


def test_repeated_passages_of_shared_ids(spark):
    rng = random.Random(2)
    passage, own = words(rng, 80), [words(rng, 150) for _ in range(4)]
    holds = lambda k: " ".join([*own[k][:70], *passage, *own[k][70:]])
    short, alone = " ".join(words(rng, 10)), " ".join(own[3])
    rows = [(1, holds(0)), (5, short), (5, holds(1)), (6, alone), (6, holds(2)), (None, short + " z")]
    out = texts(corpus_pipeline.repeated_passages(spark, table(spark, rows), ""))
    cut = lambda k: " ".join(own[k])
    assert {(1, holds(0)), (5, short), (6, alone), (None, short + " z")} <= set(out) and len(out) == 6
    rest = dict.fromkeys(t for _, t in out if t not in (holds(0), short, alone, short + " z"))
    assert {" ".join(t.split()) for t in rest} == {cut(1), cut(2)}
    # spans beyond a text's end cut nothing
    docs = table(spark, [(1, "a b c")])
    spans = spark.createDataFrame([(1, [(2, 9), (70, 130)])], "id long, spans array<struct<b:long,e:long>>")
    assert texts(op2_substrings.without_spans(docs, spans)) == [(1, "a b ")]


def test_leaks_of_shared_ids(spark, bench_dir):
    folder, items = bench_dir
    rng = random.Random(3)
    clean = [" ".join(words(rng, 100)) for _ in range(3)]
    rows = [(1, clean[0] + " " + items[0]), (1, clean[1]), (2, clean[2]), (None, items[0])]
    assert texts(corpus_pipeline.benchmark_leaks(spark, table(spark, rows), folder)) == sorted([(1, clean[1]), (2, clean[2])], key=repr)


def test_clashing_names_and_empty_tables(spark, bench_dir):
    folder, items = bench_dir
    rng = random.Random(5)
    passage = " ".join(words(rng, 70))
    rows = [(k, " ".join(words(rng, 60)) + (" " + passage if k < 3 else "")) for k in range(6)] + [(6, items[0])]
    names = ("_id", "_spans", "_key", "h", "component", "fp", "id", "root", "key", "spans", "_again", "item_id", "_least")
    plain = table(spark, rows)
    docs = plain.select("*", *[F.lit(n).alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and texts(out) == texts(stage(spark, plain, folder))
        assert all(r[n] == n for r in out.collect() for n in names)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, plain.limit(0), folder).count() == 0, k


def test_stages_read_a_text_of_megabytes(spark, bench_dir):
    folder, items = bench_dir
    rng = random.Random(6)
    pool = words(rng, 5000)
    long = " ".join(rng.choices(pool, k=1_800_000))
    rows = [(1, long + " " + items[0]), (2, long[: 200] + " short")]
    assert len(long) > 8_000_000
    docs = table(spark, rows)
    assert corpus_pipeline.near_duplicates(spark, docs, folder).count() == 2
    assert texts(corpus_pipeline.benchmark_leaks(spark, docs, folder)) == [rows[1]]


def test_stages_2_to_4_by_brute_force(spark, bench_dir):
    """Fingerprints, exact shared runs of words and subsequences by plain loops, on rows with shared ids."""
    from test_corpus import brute_fingerprint

    folder, items = bench_dir
    rng = random.Random(8)
    passage = words(rng, 64)
    rows = []
    for k in range(40):
        body = words(rng, 120)
        if k % 5 == 1:
            body[30:30] = passage
        if k % 11 == 3:
            body[110:110] = items[0].split()
        rows.append((k // 2 if k > 30 else k, " ".join(body)))
    rows += [(50, rows[0][1]), (0, rows[2][1]), (51, rows[6][1])]
    # 2: one row of each group of linked fingerprints, the least (id, hash)
    prints = [brute_fingerprint(t) for _, t in rows]
    kept = [r for r, p in zip(rows, prints, strict=True) if r[0] == min(q[0] for q, o in zip(rows, prints, strict=True) if (o ^ p).bit_count() <= 2)]
    now = corpus_pipeline.near_duplicates(spark, table(spark, rows), folder)
    assert texts(now) == sorted(set(kept), key=repr)
    # 3: the passage stays once, in the least id
    now = corpus_pipeline.repeated_passages(spark, now, folder)
    got, joined = texts(now), " ".join(passage)
    first = min(i for i, t in kept if joined in t)
    assert [i for i, t in got if joined in t] == [first]
    want = sorted(((i, " ".join(t.split()) if i == first else " ".join(t.replace(joined, "").split())) for i, t in set(kept)), key=repr)
    items_cut = lambda t: " ".join(t.split())
    assert [(i, len(items_cut(t).split())) for i, t in got if items[0] not in t] == [(i, len(t.split())) for i, t in want if items[0] not in t]
    # 4: texts that hold the item go
    left = texts(corpus_pipeline.benchmark_leaks(spark, now, folder))
    assert left == [x for x in got if items[0] not in x[1]]


def test_leaks_do_not_depend_on_other_items(spark, monkeypatch):
    """An item in which one word fills most places is found alone, in blocks of one and among others, and no cosine is over 1."""
    rng = random.Random(7)
    odd = ["yes"] * 20 + words(rng, 12)
    rng.shuffle(odd)
    items = [(0, " ".join(odd))] + [(k, " ".join(words(rng, 32))) for k in range(1, 6)]
    rows = [(k, " ".join([*words(rng, 90), *items[k][1].split(), *words(rng, 50)])) for k in range(6)] + [(10 + k, " ".join(words(rng, 150))) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = lambda some: spark.createDataFrame(some, "item_id long, text string")
    alone = op1_decontaminate.find_leaks(docs, bench(items[:1])).collect()
    assert [(r["doc_id"], r["item_id"]) for r in alone] == [(0, 0)]
    for block in (1, 2, 1024):
        found = op1_decontaminate.find_leaks(docs, bench(items), item_block=block).collect()
        assert {(r["doc_id"], r["item_id"]) for r in found} == {(k, k) for k in range(6)}
        assert all(-1e-5 <= r["cosine"] <= 1 + 1e-5 for r in [*found, *alone])
    monkeypatch.setattr(op1_decontaminate.Index, "gate", False)
    assert {(r["doc_id"], r["item_id"]) for r in op1_decontaminate.find_leaks(docs, bench(items)).collect()} == {(k, k) for k in range(6)}


def test_canonical_urls_keep_the_case_of_paths(spark):
    urls = ["HTTP://WWW.Example.com/Doc?id=AbC&utm_source=x#Top", "https://m.example.com/doc?id=abc", "http://example.com/A/", "x.com?Ref=1"]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(op4_revisit.canonical_url(F.col("u")).alias("c"))
    assert [r["c"] for r in df.collect()] == ["example.com/Doc?id=AbC", "example.com/doc?id=abc", "example.com/A", "x.com?Ref=1"]


def test_op7_query_solves_for_a_power(spark, sf_dir):
    rows = op7_mixing.op7_mixing(spark, sf_dir).select("power", "pass_no").distinct().collect()
    assert 0 < rows[0]["power"] < 1 and len({r["power"] for r in rows}) == 1

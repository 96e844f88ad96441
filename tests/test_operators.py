from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.functions import codec
from lodestone.functions import text as X
from lodestone.operators import quality, retrieval, temporal
from lodestone.operators.relational import shared_term_peers
from lodestone.sources import parsers, render


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_constraints(spark):
    two = spark.createDataFrame([("a", [1.0]), ("a", [1.0, 2.0])], "id string, vec array<float>")
    with pytest.raises(schemas.ConstraintError):
        schemas.require_unique(two, "id")
    with pytest.raises(schemas.ConstraintError):
        schemas.guard_dim(two)
    assert schemas.guard_dim(two.limit(0)).count() == 0


FACT = "id string, epoch int, type string, content_sha string, valid_from timestamp_ntz, valid_to timestamp_ntz, tx_from timestamp_ntz, tx_to timestamp_ntz"


def day(n, month=1):
    return datetime(2026, month, n)


def test_bitemporal_story(spark):
    first = spark.createDataFrame([("p8", 0, "m", "sha-008", day(1), None, day(1), None), ("p4", 5, "m", "sha-004", day(1), None, day(1), None)], FACT)
    new = spark.createDataFrame([("p8", 1, "m", "sha-008-v2", day(1, 6))], "id string, epoch int, type string, content_sha string, valid_from timestamp_ntz")
    facts = temporal.record_facts(first, new, F.lit(day(2, 6))).cache()
    sha = lambda df: {r["id"]: r["content_sha"] for r in df.collect()}
    assert sha(temporal.as_of_epoch(facts, 0)) == {"p8": "sha-008"}
    assert sha(temporal.as_of_epoch(facts, 1)) == {"p8": "sha-008-v2"}
    assert sha(temporal.current(facts)) == {"p8": "sha-008-v2", "p4": "sha-004"}
    assert temporal.as_of_time(facts, F.lit(datetime(2025, 1, 1))).count() == 0
    assert facts.where("tx_to is null").groupBy("id").count().where("count > 1").count() == 0
    assert schemas.overlapping_versions(facts).count() == 0
    assert values(temporal.epoch_diff(facts, 0, 5)) == [("p4", "added"), ("p8", "changed")]


def test_merges(spark):
    old = spark.createDataFrame([("1", "STR", datetime(2024, 1, 1)), ("2", "old", None)], "ispb string, name string, canonical_synced timestamp")
    new = spark.createDataFrame([("1", "PIX", None), ("2", "PIX", None), ("3", "PIX", None)], old.schema)
    assert [(r[0], r[1]) for r in temporal.upsert_secondary(old, new).orderBy("ispb").collect()] == [("1", "STR"), ("2", "PIX"), ("3", "PIX")]


def test_fusion_order_and_boosts(spark):
    hits = lambda *ids: spark.createDataFrame([(i, k + 1) for k, i in enumerate(ids)], "id string, rank long")
    fused = retrieval.fuse([hits("a", "b"), hits("b", "c")], 60, 0).orderBy(F.desc("score"), "first_seen", "id").collect()
    assert [r["id"] for r in fused] == ["b", "a", "c"]
    assert fused[0]["score"] == pytest.approx(1 / 61 + 1 / 60)
    q = spark.createDataFrame([("QR code estático", "QR Code Estático Pix"), ("QR code estático", "FULANO DE TAL EIRELI"), ("liquidação reservas", "Liquidação no SPI"), ("de", "x")], "q string, t string")
    assert [r[0] for r in q.select(X.title_boost(F.col("q"), F.col("t"))).collect()] == [1.5, 1.0, 1.25, 1.0]


def test_multi_query_provenance(spark):
    d = lambda *ids: spark.createDataFrame([(i, k + 1, "fts") for k, i in enumerate(ids)], "id string, rank long, arm string")
    out = retrieval.multi([("q0", d("x", "y")), ("q1", d("x"))]).collect()
    assert out[0]["id"] == "x" and len(out[0]["provenance"]) == 2 and out[0]["score"] == pytest.approx(2 / 6)
    assert retrieval.expand_question("notificar via webhook pix")[0] == "notificar via webhook pix"


def test_similar_names_its_reasons(spark):
    ids = lambda *x: spark.createDataFrame([(i, k + 1) for k, i in enumerate(x)], "id string, rank long")
    types = spark.createDataFrame([("a", "Reference"), ("e", "ApiEndpoint"), ("n", "WebPage")], "id string, type string")
    out = {r["id"]: r["why"] for r in retrieval.similar({"semantic": ids("a", "e"), "lexical": ids("e"), "graph": ids("n")}, "a", "Reference", types).collect()}
    assert out == {"e": ["lexical", "semantic", "domain"], "n": ["graph"]}


def test_hash_vectors():
    v = retrieval.hash_vector("abcd", 16)
    assert abs(float((v**2).sum()) - 1) < 1e-6 and not retrieval.hash_vector("ab", 16).any()


def test_budget_stops_at_the_first_overflow(spark):
    c = spark.createDataFrame([(0, 900), (1, 50), (2, 20), (3, 1)], "ord int, n int")
    assert [r[0] for r in retrieval.within_budget(c, F.col("n"), 100).orderBy("ord").collect()] == [0]
    assert [r[0] for r in retrieval.within_budget(c.where("ord > 0"), F.col("n"), 60).orderBy("ord").collect()] == [1]


def test_diversify_keeps_untyped_hits(spark):
    h = spark.createDataFrame([(1, "A"), (2, "A"), (3, ""), (4, "B"), (5, None)], "rank int, type string")
    assert [r["type"] for r in retrieval.diversify(h).orderBy("rank").collect()] == ["A", "", "B", None, "A"]


def test_edges_and_citations(spark):
    e = spark.createDataFrame([("a", "b", "link"), ("a", "c", "cites")], "src string, dst string, kind string")
    assert values(retrieval.replace_edges(e, spark.createDataFrame([("a", "d", "link")], e.schema))) == [("a", "d", "link")]
    docs = spark.createDataFrame([("x", "ver Resolução BCB nº 1, de 12 de agosto de 2020", ""), ("y", "", "RES-BCB-1"), ("z", "Resolução BCB nº 1", "RES-BCB-1")], "id string, body string, norm_ref string")
    assert values(retrieval.citation_edges(docs).select("src", "dst")) == [("x", "z")]


def test_cross_links(spark):
    t = spark.createDataFrame([("a", "pix"), ("b", "pix"), ("a", "cob"), ("b", "cob"), ("c", "cob")], "id string, term string")
    assert values(shared_term_peers(t).where("id = 'a'").select("peer", "shared")) == [("b", 2), ("c", 1)]
    docs = spark.createDataFrame([("a", "A", "x", ""), ("b", "B", "y", ""), ("d", "D", "z", "")], "id string, title string, body string, content_sha string")
    out = {r["id"]: r["body"] for r in retrieval.cross_link(docs, t).collect()}
    assert out["a"] == "x\n\n## Related\n\n- [B](b)" and out["d"] == "z"


def test_quality_rules(spark):
    cols = "id string, type string, title string, description string, body string, source_uri string, content_sha string, intent_terms string"
    rows = [
        ("1", "T", "Bom título", "", "uses Kafka and correlation_id " + "x" * 40, "s", "h1", "t"), ("2", "", "", "", "short", "", "h2", ""), ("3", "T", "ANEXO IV", "", "y" * 50 + " [a](gone.md)", "s", "h1", "t"), ("4", "T", "CONCLUÍDA é", "Fulano de Tal", "# T\n" + "z" * 10, "s", "h4", "t"), ("5", "T", "Previsão", "", "w" * 50, "s", "h5", "t"),
    ]
    df = spark.createDataFrame(rows, cols)
    found = {(r["concept_id"], r["check"]) for r in quality.scan(df).collect()}
    assert {("1", "deviation"), ("2", "missing-type"), ("2", "junk-title"), ("2", "stub-body"), ("2", "missing-provenance"), ("3", "junk-title"), ("3", "broken-link"), ("3", "duplicate"), ("4", "sample-data"), ("4", "stub-body"), ("4", "junk-title"), ("5", "junk-title")} == found
    agents = {r["concept_id"]: r["agent"] for r in quality.routes(quality.scan(df)).collect()}
    assert agents["1"] == "deviation" and agents["3"] == "hygiene" and agents["2"] == "hygiene"
    fixed, errors = quality.curate(df, lambda d: d.withColumn("body", F.lit("clean " * 20)), only=["1"])
    assert errors.isEmpty() and fixed.where("id = '1' and body like 'clean%'").count() == 1
    same, errors = quality.curate(df, lambda d: d.withColumn("body", F.lit("deploy to kubernetes " * 5)), only=["1"])
    assert not errors.isEmpty() and same.where("body like 'deploy%'").count() == 0
    assert quality.fails_under(0.2, 0.3) and not quality.fails_under(-1, 0.3) and not quality.fails_under(0.2, None)


def test_codec():
    assert codec.crc16(b"123456789") == 0x29B1
    assert codec.parse_code("00")["error"] and codec.parse_code("0002016304FFFF")["crc_valid"] is False


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(X.redact(F.lit("12.345.678/0001-90 123.456.789-01 12345678901 (11) 98765-4321 a.b@c.com 123"))) == "[REDACTED:CNPJ] [REDACTED:CPF] [REDACTED:CPF] ([REDACTED:PHONE] [REDACTED:EMAIL] 123".replace("([", "[")
    assert one(X.normal_url(F.lit("HTTPS://Host.COM:443/A/?b=2&a=1#x"))) == "https://host.com/A?a=1&b=2"
    assert one(X.first_bytes(F.lit("ação"), 3)) == "aç" and one(X.valid_utf8(F.lit("ok"))) == "ok"
    assert one(X.article_number(F.lit("31-A"))) == "0031-a" and one(X.slug(F.lit(" Ação & Reação! "))) == "acao-reacao"


def test_bundle_round_trip(spark, tmp_path):
    folder = str(tmp_path / "bundle")
    docs = spark.createDataFrame([("a/x.md", '{"title": "Olá", "tags": ["t"]}', "body\n"), ("y.md", "{}", "z")], "id string, meta string, body string")
    parsers.write_bundle(docs, folder)
    (tmp_path / "bundle" / "index.md").write_text("skip")
    (tmp_path / "bundle" / "bad.md").write_text("---\n{: x\n---\nbody")
    rows = {r["id"]: r for r in parsers.read_bundle(spark, folder).collect()}
    assert sorted(rows) == ["a/x.md", "bad.md", "y.md"] and rows["a/x.md"]["body"] == "body\n" and "Olá" in rows["a/x.md"]["meta"] and rows["bad.md"]["error"]
    with pytest.raises(parsers.SourceError):
        parsers.gather(docs, docs)


def test_office_files(spark):
    import io
    import zipfile

    w, x = parsers._W[1:-1], parsers._X[1:-1]
    d = io.BytesIO()
    with zipfile.ZipFile(d, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>Text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc><w:tc/></w:tr></w:tbl></w:body></w:document>')
    s = io.BytesIO()
    with zipfile.ZipFile(s, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{x}"><sheets><sheet name="S"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{x}"><si><t>h</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{x}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2</v></c></row><row><c r="B2"><v>5</v></c></row></sheetData></worksheet>')
    files = spark.createDataFrame([("p/a.docx", "a.docx", bytearray(d.getvalue())), ("p/b.xlsx", "b.xlsx", bytearray(s.getvalue())), ("p/c.xlsx", "c.xlsx", bytearray(b"broken"))], "path string, name string, content binary")
    rows = values(parsers.office_documents(files))
    assert rows[0] == ("p/a.docx", "", "# Top\n\nText\n\n| a\\|b |  |\n| --- | --- |") and rows[1] == ("p/b.xlsx", "S", "| h |  | 2 |\n| --- | --- | --- |\n|  | 5 |  |") and len(rows) == 2


def test_history_windows_and_empty_series(spark):
    assert parsers.history_windows("2000-01-01", "2015-06-30") == [("2000-01-01", "2009-12-31"), ("2010-01-01", "2015-06-30")]
    with pytest.raises(parsers.SourceError):
        parsers.series_points(spark.createDataFrame([("[]",)], "value string"), "1")


def test_render(spark):
    hits = spark.createDataFrame([(1, "a.md", "T|x", "Ref", 0.5)], "rank int, id string, title string, type string, score double")
    assert render.render(hits, "md").first()[0] == "| 1 | T\\|x | a.md | Ref | 0.5000 |"
    assert render.render(hits, "yaml").first()[0].startswith('- rank: 1\n  id: a.md\n  title: "T|x"')
    with pytest.raises(ValueError):
        render.render(hits, "xml")


def test_watched_folder(spark, tmp_path):
    from lodestone.streaming import watch

    folder, seen, errors = tmp_path / "in", [], []
    folder.mkdir()
    (folder / "a.md").write_text("---\nt: 1\n---\nbody")
    (folder / "b.txt").write_text("no")
    watch.ingest_stream(watch.watch_folder(spark, str(folder)), lambda d: seen.extend(r["body"] for r in d.collect()), str(tmp_path / "cp"), every=None).awaitTermination()
    (folder / "c.md").write_text("more")
    watch.on_changes(watch.watch_folder(spark, str(folder)), lambda d: 1 / 0, str(tmp_path / "cp2"), every=None, on_error=errors.append).awaitTermination()
    assert seen == ["body"] and len(errors) == 1


def test_store_runs(spark, tmp_path):
    from lodestone.operators import store as S

    store = S.Store(spark, str(tmp_path / "store"))
    batch = lambda *rows: spark.createDataFrame([(i, "T", i, b) for i, b in rows], "id string, type string, title string, body string")
    at = lambda n: F.lit(datetime(2024, 1, n)).cast("timestamp")
    link = spark.createDataFrame([("a", "b", "link")], "src string, dst string, kind string")
    assert values(S.run_epoch(store, batch(("a", "1"), ("b", "1"), ("c", "1")), link, at(1))) == [("a", "added"), ("b", "added"), ("c", "added")]
    assert values(S.run_epoch(store, batch(("a", "1"), ("b", "2"), ("d", "1")), None, at(2))) == [("b", "changed"), ("c", "removed"), ("d", "added")]
    assert values(S.upsert_batch(store, batch(("a", "3")), None, at(3))) == [("a", "changed")]
    assert values(store.read("concept").select("id", "first_epoch", "last_epoch")) == [("a", 0, 2), ("b", 0, 1), ("d", 1, 1)]
    assert store.next_epoch() == 3 and store.read("fact").where("id = 'a'").count() == 3 and store.read("fact").where("tx_to is null and id = 'a'").count() == 1
    assert S.prune_embeddings(store) == 3 and store.read("embedding").count() == 4
    cites = spark.createDataFrame([("a", "d", "cites"), ("a", "d", "cites")], "src string, dst string, kind string")
    assert S.cite(store, cites) == {"matched": 1, "new": 1} and S.cite(store, cites, apply=True)["new"] == 1 and S.cite(store, cites)["new"] == 0
    S.reindex(store, batch(("z", "1")), None, at(4))
    assert values(store.read("epoch").select("n")) == [(0,)] and values(store.read("concept").select("id")) == [("z",)]
    with pytest.raises(schemas.ConstraintError):
        S.run_epoch(store, batch(("a", "1"), ("a", "2")))
    messages = S.message_catalogue(spark).collect()
    assert len(messages) == 12 and messages[0]["id"] == "messages/camt.029.md" and "[camt.056](messages/camt.056.md)" in messages[0]["body"]


def test_answers():
    from lodestone.operators import answers as A

    assert A.without_marker("<<<EN<<<END>>>D>>>x", "<<<END>>>") == "x"
    assert A.json_in_prose('so: {"a": "}{", "b": {"c": 1}} done }') == '{"a": "}{", "b": {"c": 1}}' and A.json_in_prose("none") == "none"
    context = [("a.md", "t"), ("b.md", "u")]
    ask = lambda reply: A.synthesize(lambda _: reply, "q", context)
    assert ask('{"text": "yes", "citations": ["b.md", "x", "b.md"]}') == {"text": "yes", "citations": ["b.md"], "refused": False}
    assert ask('{"text": "yes", "citations": ["x"]}')["refused"] and ask('{"text": "", "citations": ["a.md"]}')["citations"] == []
    assert A.synthesize(lambda _: 1 / 0, "q", [])["refused"]
    cache = A.AnswerCache(2)
    for k in "abc":
        cache.put(k, k)
    assert cache.get("a") is None and cache.get("b") == "b"


def test_hash_embedding_covers_all_documents(spark, sf_dir):
    from lodestone.operators import retrieval

    ids = [f"doc/{r[0]:08d}.md" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()]
    got = retrieval.QUERIES["F05_hash_embedding"](spark, sf_dir).collect()
    assert sorted(r["id"] for r in got) == sorted(ids) and all(r["dim"] == len(r["vec"]) == 256 for r in got)


def test_junk_titles_end_in_any_case_and_at_the_very_end(spark):
    rows = [("1", "LA LEÈ UN ANÉRÉ"), ("2", "la leè un anéré"), ("3", "Um título de\r"), ("4", "LA LEÈ UN ANÉRÉ!")]
    df = spark.createDataFrame(rows, "id string, title string")
    assert sorted(r["concept_id"] for r in quality.junk_titles(df).collect()) == ["1", "2"]


def test_gate_reads_the_changed_rows_only(spark):
    cols = "id string, type string, title string, description string, body string, source_uri string, content_sha string, intent_terms string"
    old = spark.createDataFrame([("1", "T", "A title", "", "uses kafka " + "x" * 40, "s", "h1", "t"), ("2", "T", "A title", "", "y" * 50, "s", "h2", "t")], cols)
    worse = spark.createDataFrame([("2", "", "", "", "now on kafka", "s", "h1", "t")], cols)
    errors = quality.gate(old, worse)
    assert sorted((r["concept_id"], r["check"]) for r in errors.collect()) == [("2", "deviation"), ("2", "junk-title"), ("2", "missing-type")]
    plan = errors._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_crc_that_reads_as_its_own_head():
    head = lambda k: f"00020126180014br.gov.bcb.pix5802BR5902AB6002CD62{len(str(k)) + 4:02d}05{len(str(k)):02d}{k}6304"
    k = next(k for k in range(1_000_000) if codec.crc16(head(k).encode()) == 0x6304)
    found = codec.parse_code(head(k) + "6304")
    assert found["crc_valid"] and found["txid"] == str(k)
    assert not codec.parse_code(head(k) + "6305")["crc_valid"] and not codec.parse_code(head(k) + "63045802BR")["crc_valid"]


def test_deviations_are_found_in_any_case_and_looked_for_only_where_they_may_be(spark):
    texts = ["on PULSAR", "Topic: x", "a Helm Chart", "NameSpace=x", "pix-SVC-core", "Trace-ID", "Insert  into", 'Column "abc"', "acme.pix.v1.GetRequest", "plain text"]
    df = spark.createDataFrame([(str(k), t, "") for k, t in enumerate(texts)], "id string, title string, body string")
    found = quality.deviations(df)
    assert sorted(r["concept_id"] for r in found.collect()) == list("012345678")
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "contains(lower(" in plan

"""Queries that run the source parsers, on tables where they have input and on literal files elsewhere."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import CONCEPT_SQL, concepts, table
from ..functions.queries import TEXT_SQL
from ..plans.registry import Registry
from . import parsers as P

registry = Registry()
query = registry


def _lines(spark, text):
    return spark.createDataFrame([(x,) for x in text.split("\n")], "value string")


#: Small files with the values expected of them, for the tests.
LITERALS: dict = {}


def _values(name, make, sql):
    LITERALS[name] = (make, sql)


def _file(name, make, sql):
    """A format of which the given tables have nothing: a small file."""
    registry.add(name, lambda spark, d: make(spark), sql)


_STR = "﻿ISPB,Nome_Reduzido,Número_Código,Participa_da_Compe,Acesso_Principal,Nome_Extenso,Início_da_Operação\n00000000,BCO DO BRASIL,001,Sim,RSFN,Banco do Brasil S.A.,22/04/2002\n3456,COOP X,n/a,Não,RSFN,Cooperativa X,01/13/2002\nabc,RUIM,1,Sim,RSFN,Ruim,01/01/2000"
_values("S24_registry_csv", lambda s: P.registry_csv(_lines(s, _STR)), "SELECT * FROM (VALUES ('00000000', 'BCO DO BRASIL', 'Banco do Brasil S.A.', '001', DATE '2002-04-22'), ('00003456', 'COOP X', 'Cooperativa X', '', NULL)) t(ispb, name, legal_name, bank_code, started)")
_PIX = "Lista de participantes\n(n);ISPB;Nome Reduzido;CNPJ;Autorizada pelo BCB\n1;360305;CAIXA;00.360.305/0001-04;Sim\n2;99999999;CRÉDITO;;Não\n(n);ISPB;Nome Reduzido;CNPJ;Autorizada pelo BCB\n3;11111111;FORA;;Sim"
_values("S25_secondary_registry", lambda s: P.secondary_registry(s.createDataFrame([(bytearray(_PIX.encode("cp1252")),)], "content binary")), "SELECT * FROM (VALUES ('00360305', 'CAIXA', '00360305000104', true), ('99999999', 'CRÉDITO', '', false)) t(ispb, name, cnpj, authorized)")
_values("S26_newest_file", lambda s: P.newest_dated_file(s.createDataFrame([("p-20240101.csv",), ("p-20240315.csv",), ("p-x.csv",)], "path string")), "SELECT 'p-20240315.csv' AS path")
_values("S27_series_json", lambda s: P.series_points(s.createDataFrame([('[{"data":"02/01/2024","valor":"11.75"},{"data":"x","valor":"1"},{"data":"03/01/2024","valor":"a"},{"data":"04/01/2024","valor":"-0.5"}]',)], "value string"), "432"), "SELECT * FROM (VALUES ('432', DATE '2024-01-02', '11.75'), ('432', DATE '2024-01-04', '-0.5')) t(series_code, point_date, value)")
_values("S28_history_merge", lambda s: P.merge_history(s.createDataFrame([("1", "2020-01-01", "a", 0), ("1", "2020-01-01", "b", 1), ("1", "2019-01-01", "c", 0)], "series_code string, point_date string, value string, window_no int")), "SELECT * FROM (VALUES ('1', '2019-01-01', 'c'), ('1', '2020-01-01', 'b')) t(series_code, point_date, value)")
_file("S29_series_registry", lambda s: s.createDataFrame([P.find_series("selic"), P.find_series("433")], "name string, code string"), "SELECT * FROM (VALUES ('selic', '432'), ('ipca', '433')) t(name, code)")
_values("S30_tsv_cases", lambda s: P.tsv_cases(_lines(s, "# head\n\nq one\ta.md, b.md\nq two\tc.md"), ("query", "ids")).select("query", F.array_join("ids", "+").alias("ids")), "SELECT * FROM (VALUES ('q one', 'a.md+b.md'), ('q two', 'c.md')) t(query, ids)")
_values("S31_feedback", lambda s: P.feedback(_lines(s, '{"question":"q","vote":1}\nbroken\n{"vote":2}')).select("question", "vote"), "SELECT 'q' AS question, 1 AS vote")
_values("M10_concept_intake", lambda s: P.concept_intake(s.createDataFrame([('{"concepts":[{"id":"a","type":"T","title":"X","lang":"en"}]}',), ('[{"id":"b","type":"T","title":"Y","body":"# Y","lang":"fr"},{"id":"c"}]',), ('{"id":"d","type":"T","title":"Z","body":"t"}',)], "value string")).select("id", "body", "lang"), "SELECT * FROM (VALUES ('a', '# X' || chr(10) || chr(10), 'en'), ('b', '# Y', 'pt'), ('d', '# Z' || chr(10) || chr(10) || 't', 'pt')) t(id, body, lang)")
_LAW = "LEI Nº 1\nDispõe.\nLIVRO I\nDAS COISAS\nCAPÍTULO II\nArt.\n1º Um.\n§ 1º Dois.\nSEÇÃO ÚNICA\nArt. 2º-A Três.\nCAPÍTULO III\nArt. 3 Quatro.\nANEXO I\nCAPÍTULO X\nTabela"
_values("S11_statute_sections", lambda s: P.statute_sections(s.createDataFrame([("l", _LAW)], "doc string, text string")).select("kind", "number", "livro", "capitulo", "secao", F.length("body").cast("long").alias("n")), "SELECT kind, number, livro, capitulo, secao, n::BIGINT AS n FROM (VALUES ('ementa', '', '', '', '', 16), ('article', '1º', 'I', 'II', '', 22), ('article', '2º-A', 'I', 'II', 'ÚNICA', 15), ('article', '3', 'I', 'III', '', 14), ('anexo', 'I', '', '', '', 17)) t(kind, number, livro, capitulo, secao, n)")
_values("S12_statute_ids", lambda s: P.statute_ids(P.statute_sections(s.createDataFrame([("l", "Art. 1º A\nArt. 1º B\nArt. 31-A C")], "doc string, text string"))).select("id"), "SELECT unnest(['l/art-0001.md', 'l/art-0001-dup2.md', 'l/art-0031-a.md']) AS id")
_values("S14_markdown_sections", lambda s: P.markdown_sections(s.createDataFrame([("m", "# Doc\nlead\n<!-- rev:3 -->\n## One\na\nb\n## Two\n")], "doc string, text string")).select("doc_title", "title", "body"), "SELECT * FROM (VALUES ('Doc', 'Overview', 'lead'), ('Doc', 'One', 'a' || chr(10) || 'b'), ('Doc', 'Two', '')) t(doc_title, title, body)")
_values("S10_manual_sections", lambda s: P.manual_sections(s.createDataFrame([("m", "1 Sumário ........ 3\n1. Objetivo\ntexto um\nREGRAS GERAIS\ntexto dois")], "doc string, text string")).select("title", "body"), "SELECT * FROM (VALUES ('1. Objetivo', 'texto um'), ('REGRAS GERAIS', 'texto dois')) t(title, body)")
_SPEC = b"openapi: 3.0.0\npaths:\n  /cob/{txid}:\n    put:\n      summary: Criar\n      parameters:\n        - {name: txid, in: path}\n      responses: {'201': {}, '400': {}}\n    get: {summary: Ler}\n"
_values("S17_openapi_endpoints", lambda s: P.endpoints(s.createDataFrame([("a.yaml", bytearray(_SPEC)), ("b.yaml", bytearray(b"{: bad"))], "name string, content binary")).select("title", "summary", F.array_join("responses", ",").alias("responses")), "SELECT * FROM (VALUES ('GET /cob/{txid}', 'Ler', ''), ('PUT /cob/{txid}', 'Criar', '201,400')) t(title, summary, responses)")
_values("S18_intent_phrases", lambda s: P.intent_phrases(s.createDataFrame([("POST /cob",), ("GET /xyz/1",), ("odd",)], "title string")), "SELECT * FROM (VALUES ('POST /cob', 'criar cobrança imediata, gerar cobrança imediata, cadastrar cobrança imediata'), ('GET /xyz/1', 'consultar xyz, obter xyz, listar xyz'), ('odd', '')) t(title, intent_terms)")
_values("S21_issues", lambda s: P.issues(s.createDataFrame([('[{"number":1,"title":"a"},{"number":2,"title":"b","pull_request":{"url":"u"}}]',), ("broken",)], "value string")).select("number", "title"), "SELECT 1::BIGINT AS number, 'a' AS title")
_values("S23_inbox_routes", lambda s: P.inbox_routes(s.createDataFrame([("a.yaml", bytearray(_SPEC)), ("b.md", bytearray(b"x")), ("c.bin", bytearray(b"x")), ("d.json", bytearray(b"{}"))], "name string, content binary")).select("name", "route"), "SELECT * FROM (VALUES ('a.yaml', 'openapi'), ('b.md', 'markdown'), ('c.bin', 'attachment'), ('d.json', 'text')) t(name, route)")
_values("S06_folder_indexes", lambda s: P.folder_indexes(s.createDataFrame([("a/b/x.md",), ("a/y.md",), ("z.md",)], "id string")).select("folder", F.array_join("children", ",").alias("children"), F.array_join("subfolders", ",").alias("subfolders")), "SELECT * FROM (VALUES ('', 'z.md', 'a'), ('a', 'y.md', 'b'), ('a/b', 'x.md', '')) t(folder, children, subfolders)")
_values("S05_stale_documents", lambda s: P.stale_documents(s.createDataFrame([("a.md",), ("b.md",), ("README.md",)], "id string"), s.createDataFrame([("a.md",)], "id string")), "SELECT 'b.md' AS id")


@query("S08_gather_sources", f"WITH {CONCEPT_SQL} SELECT id, type FROM concept WHERE type IN ('Reference', 'LegalArticle') ORDER BY id")
def s08(spark, d):
    c = concepts(spark, d).select("id", "type")
    return P.gather(c.where("type = 'Reference'"), c.where("type = 'LegalArticle'"))


@query("S22_page_documents", "SELECT url, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages WHERE length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)^.*?(<h1)', '<h1'), '(?is)<footer.*$', ''), '(?s)<[^>]*>', '', 'g'), '\\s|&[a-z]+;', '', 'g')) >= 40")
def s22(spark, d):
    return P.page_documents(table(spark, d, "pages")).select("url", "title")


@query("S34_table_scan", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 5000")
def s34(spark, d):
    return table(spark, d, "customer").where("c_acctbal > 5000").select("c_custkey", "c_name", "c_acctbal")


@query("S33_render_rows", "SELECT 'n' || lpad(n_nationkey::VARCHAR, 2, '0') || ' | ' || n_name AS line FROM nation")
def s33(spark, d):
    return table(spark, d, "nation").select(F.format_string("n%02d | %s", "n_nationkey", "n_name").alias("line"))


# -- files made of the given rows ----------------------------------------------
def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


_c, _k = F.col, "substr(id, 5, 8)::BIGINT"


def _K():
    """The number in a row's id."""
    return F.substring("id", 5, 8).cast("long")



@query("S24_registry_csv", "SELECT lpad(s_suppkey::VARCHAR, 8, '0') AS ispb, s_name AS name, s_name || ' S.A.' AS legal_name, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE (100 + s_nationkey)::VARCHAR END AS bank_code, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE DATE '2002-01-01' + s_nationkey END AS started FROM supplier WHERE s_suppkey % 5 <> 0")
def s24(spark, d):
    k = _c("s_suppkey")
    code, bank = F.when(k % 5 == 0, _text("x", k)).otherwise(k.cast("string")), F.when(k % 3 == 0, "n/a").otherwise((100 + _c("s_nationkey")).cast("string"))
    day = F.when(k % 4 == 0, "01/13/2002").otherwise(F.date_format(F.date_add(F.lit("2002-01-01").cast("date"), _c("s_nationkey")), "dd/MM/yyyy"))
    lines = table(spark, d, "supplier").select(F.concat_ws(",", code, "s_name", bank, F.lit("Sim"), F.lit("RSFN"), _text(_c("s_name"), " S.A."), day).alias("value"))
    return P.registry_csv(_lines(spark, _STR).limit(1).unionAll(lines))


@query("S26_newest_file", "SELECT 'p-' || strftime(max(o_orderdate), '%Y%m%d') || '.csv' AS path FROM orders")
def s26(spark, d):
    dated = table(spark, d, "orders").select(_text("p-", F.date_format("o_orderdate", "yyyyMMdd"), ".csv").alias("path")).distinct()
    return P.newest_dated_file(dated.unionAll(table(spark, d, "nation").select(_text("p-", _c("n_name"), ".csv").alias("path"))))


@query("S27_series_json", "SELECT '432' AS series_code, ts::DATE AS point_date, printf('%.2f', value) AS value FROM events WHERE event_id % 3 <> 0")
def s27(spark, d):
    day, value = F.date_format("ts", "dd/MM/yyyy"), F.when(_c("event_id") % 3 == 0, "1,5").otherwise(F.format_string("%.2f", "value"))
    replies = table(spark, d, "events").select(_text('[{"data":"', day, '","valor":"', value, '"},{"data":"x","valor":"1"}]').alias("value"))
    return P.series_points(replies, "432")


@query("S28_history_merge", "SELECT event_type AS series_code, ts::DATE::VARCHAR AS point_date, arg_max(event_id, event_id)::VARCHAR AS value FROM events GROUP BY ALL ORDER BY ALL")
def s28(spark, d):
    e = table(spark, d, "events")
    return P.merge_history(e.select(_c("event_type").alias("series_code"), F.date_format("ts", "yyyy-MM-dd").alias("point_date"), _c("event_id").cast("string").alias("value"), _c("event_id").alias("window_no")))


@query("S30_tsv_cases", "SELECT c_name AS query, 'a.md+b' || c_custkey || '.md' AS ids FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 10 <> 0")
def s30(spark, d):
    k = _c("c_custkey")
    lines = table(spark, d, "customer").select(F.when(k % 7 == 0, " ").when(k % 10 == 0, _text("# ", _c("c_name"), "\tx.md")).otherwise(_text(" ", _c("c_name"), "\ta.md, b", k, ".md,")).alias("value"))
    return P.tsv_cases(lines, ("query", "ids")).select("query", F.array_join("ids", "+").alias("ids"))


@query("S31_feedback", "SELECT 'q' || o_orderkey AS question, (o_custkey % 3)::INTEGER AS vote FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0")
def s31(spark, d):
    k = _c("o_orderkey")
    lines = table(spark, d, "orders").select(F.when(k % 5 == 0, "broken").when(k % 7 == 0, '{"vote":2}').otherwise(_text('{"question":"q', k, '","vote":', _c("o_custkey") % 3, "}")).alias("value"))
    return P.feedback(lines).select("question", "vote")


@query("M10_concept_intake", f"WITH {CONCEPT_SQL} SELECT id, CASE WHEN {_k} % 3 = 1 THEN '# Y' ELSE '# X' || {_k} || chr(10) || chr(10) || CASE WHEN {_k} % 3 = 2 THEN 't' ELSE '' END END AS body, CASE WHEN {_k} % 3 = 0 AND language = 'en' THEN 'en' ELSE 'pt' END AS lang FROM concept")
def m10(spark, d):
    """An object with concepts, a list with an entry that lacks its type, and one object."""
    one = lambda *more: _text('{"id":"', _c("id"), '","type":"T","title":"X', _K(), '"', *more, "}")
    value = F.when(_K() % 3 == 0, _text('{"concepts":[', one(',"lang":"', _c("language"), '"'), "]}")).when(_K() % 3 == 1, _text("[", one(',"body":"# Y","lang":"fr"'), ',{"id":"c"}]')).otherwise(one(',"body":"t"'))
    return P.concept_intake(concepts(spark, d).select(value.alias("value"))).select("id", "body", "lang")


@query("S14_markdown_sections", f"WITH {CONCEPT_SQL} SELECT id AS doc, 'Doc ' || language AS doc_title, unnest(['Overview', 'One', 'Two ' || {_k}]) AS title, unnest(['lead', language || chr(10) || 'b', '']) AS body FROM concept")
def s14(spark, d):
    text = _text("# Doc ", _c("language"), "\nlead\n<!-- rev:", _K(), " -->\n## One\n", _c("language"), "\nb\n## Two ", _K(), "\n")
    return P.markdown_sections(concepts(spark, d).select(_c("id").alias("doc"), text.alias("text"))).select("doc", "doc_title", "title", "body")


@query("S18_intent_phrases", f"WITH {CONCEPT_SQL} SELECT id, CASE {_k} % 3 WHEN 0 THEN 'criar cobrança imediata, gerar cobrança imediata, cadastrar cobrança imediata' WHEN 1 THEN 'consultar x' || language || ', obter x' || language || ', listar x' || language ELSE '' END AS intent_terms FROM concept")
def s18(spark, d):
    title = F.when(_K() % 3 == 0, "POST /cob").when(_K() % 3 == 1, _text("GET /X", _c("language"), "/1")).otherwise("odd")
    return P.intent_phrases(concepts(spark, d).select("id", title.alias("title"))).select("id", "intent_terms")


@query("S21_issues", f"WITH {CONCEPT_SQL} SELECT {_k} AS number, language AS title FROM concept WHERE {_k} % 10 <> 0")
def s21(spark, d):
    value = F.when(_K() % 10 == 0, "broken").otherwise(_text('[{"number":', _K(), ',"title":"', _c("language"), '"},{"number":', _K(), ',"title":"b","pull_request":{"url":"u"}},{"title":"none"}]'))
    return P.issues(concepts(spark, d).select(value.alias("value"))).select("number", "title")


@query("S06_folder_indexes", f"""WITH {CONCEPT_SQL}, f AS (SELECT source_uri AS s, language AS l, substr(id, 5) AS n FROM concept)
SELECT '' AS folder, '' AS children, array_to_string(list_sort(list(DISTINCT s)), ',') AS subfolders FROM f
UNION ALL SELECT s, '', array_to_string(list_sort(list(DISTINCT l)), ',') FROM f GROUP BY s
UNION ALL SELECT s || '/' || l, array_to_string(list_sort(list(DISTINCT n)), ','), '' FROM f GROUP BY s, l""")
def s06(spark, d):
    docs = concepts(spark, d).select(F.concat_ws("/", "source_uri", "language", F.substring("id", 5, 100)).alias("id"))
    return P.folder_indexes(docs).select("folder", F.array_join("children", ",").alias("children"), F.array_join("subfolders", ",").alias("subfolders"))


@query("S05_stale_documents", f"WITH {CONCEPT_SQL} SELECT id FROM concept WHERE last_epoch >= 5")
def s05(spark, d):
    c = concepts(spark, d).select("id", "last_epoch")
    kept = table(spark, d, "nation").select(_text(_c("n_name"), "/README.md").alias("id"))
    return P.stale_documents(c.select("id").unionAll(kept), c.where("last_epoch < 5"))


def _sql_word(text, least, vowels):
    letters = "regexp_replace(lower(w), '[^a-z\u00e0-\uffff]', '', 'g')"
    return f"len(list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: length({letters}) >= {least} AND regexp_matches({letters}, '[{vowels}]'))) > 0"


_NUMBERED = P.NUMBERED
_MANUAL_SQL = f"""{CONCEPT_SQL},
ln AS (SELECT id AS doc, unnest(string_split(body, chr(10))) AS raw, unnest(range(len(string_split(body, chr(10))))) AS at_ FROM concept),
tr AS (SELECT *, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS t FROM ln WHERE NOT regexp_matches(regexp_replace(raw, '^\\s+|\\s+$', '', 'g'), '[^.\\s].*\\.{{4,}}\\s*\\d*$')),
hd AS (SELECT *, t <> '' AND len(regexp_split_to_array(t, '\\s+')) <= 12 AND CASE WHEN regexp_matches(t, '{_NUMBERED}') THEN {_sql_word(f"regexp_extract(t, '{_NUMBERED}', 1)", 3, P.VOWELS + 'ç')}
  ELSE strlen(t) BETWEEN 8 AND 80 AND NOT regexp_matches(t, '[a-z\u00e0-\u00ff]') AND len(regexp_split_to_array(t, '\\s+')) >= 2 AND length(regexp_replace(regexp_split_to_array(t, '\\s+')[1], '[^A-Z\u00c0-\uffff]', '', 'g')) >= 3 AND NOT regexp_matches(regexp_split_to_array(t, '\\s+')[1], '^[0-9]+$')
    AND length(regexp_replace(t, '[^A-Z\u00c0-\uffff]', '', 'g')) > length(regexp_replace(t, '[^0-9]', '', 'g')) AND {_sql_word('t', 4, P.VOWELS)} END AS h FROM tr),
nn AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc ORDER BY at_) AS n FROM hd),
se AS (SELECT doc, n, regexp_replace(coalesce(array_to_string(list(raw ORDER BY at_) FILTER (NOT h), chr(10)), ''), '^\\s+|\\s+$', '', 'g') AS body, min(raw) FILTER (h) AS head FROM nn GROUP BY doc, n),
ke AS (SELECT *, max((body <> '')::INT) OVER (PARTITION BY doc) AS full_, max(n) OVER (PARTITION BY doc) AS most FROM se)"""


@query("S10_manual_sections", f"WITH {_MANUAL_SQL} SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY n) AS n, coalesce(trim(regexp_replace(head, '\\s+', ' ', 'g')), 'Documento') AS title, sha256(body) AS sha FROM ke WHERE body <> '' OR full_ = 0 AND n = most")
def s10(spark, d):
    """Each document behind a contents block, of which nothing must be left."""
    block = "Sumário\nUm\n" + "......\n3\nDois\n" + "\n" * 30 + ".....\n\n 12 \n"
    texts = concepts(spark, d).select(F.col("id").alias("doc"), F.concat(F.lit(block), "body").alias("text"))
    return P.manual_sections(texts).select("doc", F.col("n").cast("long").alias("n"), "title", F.sha2("body", 256).alias("sha"))


@query("S19_api_pages", f"WITH t AS (SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS h, {TEXT_SQL} AS b FROM pages), u AS (SELECT page_id, b, CASE WHEN h = '' OR page_id % 4 = 0 THEN page_id || '-v1' ELSE h END AS title FROM t) SELECT 'apis/' || page_id || '-v1.md' AS id, title, md5('# ' || title || chr(10) || chr(10) || b) AS sha FROM u")
def s19(spark, d):
    """Pages under the names of files; some have lost their title."""
    html = F.when(_c("page_id") % 4 == 0, F.regexp_replace("html", "(?is)<title[^>]*>(.*?)</title>", "$1")).otherwise(_c("html"))
    pages = table(spark, d, "pages").select(_text("in/", _c("page_id"), ".v1.html").alias("path"), html.alias("html"))
    return P.api_documents(pages).select("id", "title", F.md5(F.col("body").cast("binary")).alias("sha"))


@query("S11_statute_sections", f"""WITH {CONCEPT_SQL}, x AS (SELECT id AS doc, {_k} AS k, unnest(range(5)) AS i FROM concept)
SELECT doc, (['ementa', 'article', 'article', 'article', 'anexo'])[i + 1] AS kind, (['', '1º', '2º-A', '3', 'I'])[i + 1] AS number, (['', 'I', 'I', 'I', ''])[i + 1] AS livro, (['', 'II', 'II', 'III', ''])[i + 1] AS capitulo, (['', '', 'ÚNICA', '', ''])[i + 1] AS secao, (CASE WHEN i = 0 THEN 15 + length(k::VARCHAR) ELSE ([0, 22, 15, 14, 17])[i + 1] END)::BIGINT AS n FROM x""")
def s11(spark, d):
    texts = concepts(spark, d).select(F.col("id").alias("doc"), _text("LEI Nº ", _K(), _LAW.removeprefix("LEI Nº 1")).alias("text"))
    return P.statute_sections(texts).select("doc", "kind", "number", "livro", "capitulo", "secao", F.length("body").cast("long").alias("n"))


@query("S12_statute_ids", f"WITH {CONCEPT_SQL} SELECT unnest([id || '/art-' || lpad(({_k} % 90 + 1)::VARCHAR, 4, '0') || '.md', id || '/art-' || lpad(({_k} % 90 + 1)::VARCHAR, 4, '0') || '-dup2.md', id || '/art-0131-a.md']) AS id FROM concept")
def s12(spark, d):
    texts = concepts(spark, d).select(F.col("id").alias("doc"), _text("Art. ", _K() % 90 + 1, "º A\nArt. ", _K() % 90 + 1, "º B\nArt. 131-A C").alias("text"))
    return P.statute_ids(P.statute_sections(texts)).select("id")


@query("S17_openapi_endpoints", "WITH x AS (SELECT s_suppkey, unnest(range(2)) AS i FROM supplier WHERE s_suppkey % 6 <> 0) SELECT CASE i WHEN 0 THEN 'GET' ELSE 'PUT' END || ' /s' || s_suppkey || '/{id}' AS title, CASE i WHEN 0 THEN 'Ler' ELSE 'Criar ' || s_suppkey END AS summary, CASE i WHEN 0 THEN '' ELSE '201,400' END AS responses FROM x")
def s17(spark, d):
    k = _c("s_suppkey")
    spec = _text("openapi: 3.0.0\npaths:\n  /s", k, "/{id}:\n    put:\n      summary: Criar ", k, "\n      responses: {'201': {}, '400': {}}\n    get: {summary: Ler}\n")
    files = table(spark, d, "supplier").select(_text("f", k, ".yaml").alias("name"), F.encode(F.when(k % 6 == 0, "{: bad").otherwise(spec), "UTF-8").alias("content"))
    return P.endpoints(files).select("title", "summary", F.array_join("responses", ",").alias("responses"))


@query("S23_inbox_routes", f"WITH {CONCEPT_SQL} SELECT {_k} || (['.yaml', '.md', '.bin', '.json'])[{_k} % 4 + 1] AS name, (['openapi', 'markdown', 'attachment', 'text'])[{_k} % 4 + 1] AS route FROM concept")
def s23(spark, d):
    pick = lambda *x: F.get(F.array(*map(F.lit, x)), (_K() % 4).cast("int"))
    files = concepts(spark, d).select(_text(_K(), pick(".yaml", ".md", ".bin", ".json")).alias("name"), F.encode(pick(_SPEC.decode(), "x", "x", "{}"), "UTF-8").alias("content"))
    return P.inbox_routes(files).select("name", "route")


@query("S25_secondary_registry", "SELECT lpad(s_suppkey::VARCHAR, 8, '0') AS ispb, s_name || ' CRÉDITO' AS name, CASE WHEN s_suppkey % 2 = 0 THEN lpad(s_suppkey::VARCHAR, 14, '0') ELSE '' END AS cnpj, s_suppkey % 3 = 0 AS authorized FROM supplier")
def s25(spark, d):
    """A file of each supplier, with a second table that does not count."""
    k, head = _c("s_suppkey"), "(n);ISPB;Nome Reduzido;CNPJ;Autorizada pelo BCB\n"
    text = _text("Lista de participantes\n", head, "1;", k, ";", _c("s_name"), " CRÉDITO;", F.when(k % 2 == 0, F.lpad(k.cast("string"), 14, "0")).otherwise(""), ";", F.when(k % 3 == 0, "Sim").otherwise("Não"), "\n", head, "2;11111111;FORA;;Sim")
    return P.secondary_registry(table(spark, d, "supplier").select(F.encode(text, "ISO-8859-1").alias("content")))


QUERIES, SQL = registry.queries, registry.sql

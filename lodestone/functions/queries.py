"""Queries that apply the scalar functions and the codec to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import CONCEPT_SQL, concepts, table
from ..plans.registry import Registry
from . import codec
from . import text as X

registry = Registry()
query = registry
_FOLD = f"translate(lower({{}}), '{X.ACCENTED}', '{X.PLAIN}')"
_STOP = ", ".join(f"'{w}'" for w in X.TITLE_STOP)
_TOKENS = f"list_filter(string_split(regexp_replace({_FOLD}, '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) >= 2 AND w NOT IN ({_STOP}))"


def _concept(name, columns, sql):
    registry.add(name, lambda spark, d: concepts(spark, d).select("id", *[c.alias(n) for n, c in columns().items()]), f"WITH {CONCEPT_SQL} SELECT id, {sql} FROM concept")


def _pages(name, columns, sql):
    registry.add(name, lambda spark, d: table(spark, d, "pages").select("page_id", *[c.alias(n) for n, c in columns().items()]), f"SELECT page_id, {sql} FROM pages")


_t = lambda n: F.col(n)
_concept("F01_fold_tokens", lambda: {"words": F.array_join(X.fold_tokens(_t("title")), " ")}, f"array_to_string({_TOKENS.format('title')}, ' ') AS words")
_concept("F02_title_boost", lambda: {"boost": X.title_boost(F.lit("das und que that"), _t("title"))}, f"1 + 0.5::DOUBLE * len(list_intersect(['das', 'und', 'que', 'that'], {_TOKENS.format('title')})) / 4 AS boost")
_concept("F03_type_weight", lambda: {"weight": X.type_weight(_t("type"))}, "CASE WHEN type IN ('ApiEndpoint', 'PacsMessage', 'CamtMessage') THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END AS weight")
_concept("F07_content_sha", lambda: {"sha": F.sha2("body", 256)}, "sha256(body) AS sha")
_concept("F13_slug", lambda: {"slug": X.slug(_t("title"))}, f"regexp_replace(regexp_replace({_FOLD.format('title')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug")
_concept("F17_clean_title", lambda: {"clean": X.clean_title(F.concat(F.lit("  "), "title", F.lit("  x")), 500)}, "trim(regexp_replace('  ' || title || '  x', '\\s+', ' ', 'g')) AS clean")
_concept("F18_prose_language", lambda: {"guess": X.prose_language(_t("body"))}, "CASE WHEN len(regexp_extract_all(body, '(?i)\\b(não|são|função|implementação|cobrança|devolução|reservas|liquidação|que|para|uma)\\b')) >= 5 THEN 'pt' ELSE 'en' END AS guess")
_concept("F39_redact_pii", lambda: {"sha": F.sha2(X.redact(_t("body")), 256)}, "sha256(" + "regexp_replace(" * 6 + "body" + "".join(f", '{p}', '[REDACTED:{m}]', 'g')" for p, m in (("\\b\\d{2}\\.\\d{3}\\.\\d{3}/\\d{4}-\\d{2}\\b", "CNPJ"), ("\\b\\d{3}\\.\\d{3}\\.\\d{3}-\\d{2}\\b", "CPF"), ("\\b\\d{14}\\b", "CNPJ"), ("\\b\\d{11}\\b", "CPF"), ("(?:\\+55\\s?)?\\(?\\d{2}\\)?[\\s.-]?\\d{4,5}-?\\d{4}\\b", "PHONE"), ("\\b[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}\\b", "EMAIL"))) + ") AS sha")
_concept("F40_cache_key", lambda: {"key": X.cache_key(_t("last_epoch"), _t("title"), F.lit("k=6"))}, "sha256(last_epoch || '|' || trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) || '|k=6') AS key")
_concept("F44_byte_truncate", lambda: {"bytes": F.octet_length(X.first_bytes(_t("body"), 500)).cast("long"), "starts": F.startswith("body", X.first_bytes(_t("body"), 500))}, "strlen(CASE WHEN strlen(body) <= 500 THEN body ELSE (SELECT max(left(body, n)) FROM (SELECT unnest(range(430, 501)) AS n) WHERE strlen(left(body, n)) <= 500) END) AS bytes, true AS starts")
_concept("F45_all_caps", lambda: {"caps": X.all_caps(_t("title"))}, "regexp_matches(title, '[A-Z]') AND NOT regexp_matches(title, '[a-z]') AS caps")
_concept("F46_without_heading", lambda: {"n": F.length(X.without_heading(F.concat(F.lit("# "), "body"))).cast("long")}, "length(regexp_replace('# ' || body, '^[\\n ]*# [^\\n]*\\n?', '')) AS n")
_concept("F48_domain_reconcile", lambda: {"domain": X.domain_and_tags(F.when(F.col("last_epoch") > 5, F.lit("x")), F.when(F.col("last_epoch") % 2 == 0, F.col("tags")))[0]}, "CASE WHEN last_epoch % 2 = 0 THEN language WHEN last_epoch > 5 THEN 'x' ELSE 'pix' END AS domain")
_concept("F49_official_tags", lambda: {"tags": F.array_join(X.official_tags(_t("source_uri"), _t("tags"), ("src1", "src7")), ",")}, "array_to_string(CASE WHEN contains(source_uri, 'src1') OR contains(source_uri, 'src7') THEN list_sort(list_distinct(list_append(tags, 'trusted:official'))) ELSE tags END, ',') AS tags")
_concept("F27_unaccented_search", lambda: {"hit": X.contains_unaccented(_t("title"), F.lit("E"))}, "contains(lower(strip_accents(title)), 'e') AS hit")
_concept("F29_digits_only", lambda: {"digits": X.digits_only(F.concat("title", F.lit("/"), "id"))}, "regexp_replace(title || '/' || id, '[^0-9]', '', 'g') AS digits")
_pages("F22_html_title", lambda: {"title": X.html_title(_t("html"))}, "trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title")
_pages("F23_simple_html_text", lambda: {"sha": F.md5(X.simple_html_text(_t("html")).cast("binary"))}, "md5(trim(regexp_replace(replace(replace(replace(replace(regexp_replace(html, '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g'))) AS sha")
_HTML = "regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?i)<(br|/p|/div|/li|/h[1-6]|/tr)[^>]*>', chr(10), 'g'), '(?s)<[^>]*>', ' ', 'g')"
for _e, _c in X.ENTITIES:
    _HTML = f"replace({_HTML}, '{_e}', '{_c.replace(chr(39), chr(39) * 2)}')"
TEXT_SQL = f"trim(regexp_replace(regexp_replace(regexp_replace({_HTML}, '[ \\t\\r\\f]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{{2,}}', chr(10), 'g'))"
_pages("F21_html_text", lambda: {"sha": F.md5(X.html_text(_t("html")).cast("binary"))}, f"md5({TEXT_SQL}) AS sha")
_URL = """regexp_replace(lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?]*)', 1)), ':(80|443)$', '') || regexp_replace(split_part(substr(u, length(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?]*)', 1)) + 1), '?', 1), '/$', '')
  || CASE WHEN contains(u, '?') AND split_part(u, '?', 2) <> '' THEN '?' || array_to_string(list_sort(string_split(split_part(u, '?', 2), '&')), '&') ELSE '' END"""
registry.add("F25_normal_url", lambda spark, d: table(spark, d, "pages").select("page_id", X.normal_url(F.col("url")).alias("url")), f"SELECT page_id, {_URL} AS url FROM (SELECT page_id, split_part(trim(url), '#', 1) AS u FROM pages)")
registry.add("F26_url_hash", lambda spark, d: table(spark, d, "pages").select("page_id", X.url_hash(X.normal_url(F.col("url"))).alias("hash")), f"SELECT page_id, substr(sha256({_URL}), 1, 12) AS hash FROM (SELECT page_id, split_part(trim(url), '#', 1) AS u FROM pages)")


@query("S35_url_staging", f"SELECT DISTINCT substr(sha256({_URL}), 1, 12) AS hash FROM (SELECT split_part(trim(url), '#', 1) AS u FROM pages)")
def s35(spark, d):
    return table(spark, d, "pages").select(X.url_hash(X.normal_url(F.col("url"))).alias("hash")).dropDuplicates(["hash"])


#: Small tables with the values expected of them, for the tests: what the queries below do not reach.
LITERALS: dict = {}


def _values(name, rows, columns, make, sql):
    LITERALS[name] = (lambda spark: make(spark.createDataFrame(rows, columns)), sql)


_values("F08_markdown_links", [("see [a](x/a.md), [b](./x/../b.md#t), [a](x/a.md), [c](http://h/c.md), [d](d.txt)",)], "body string", lambda t: t.select(F.explode(X.markdown_links(F.col("body"))).alias("target")), "SELECT unnest(['x/a.md', 'b.md']) AS target")
_values("F09_normal_path", [("./a/../b//c.md",), ("a\\b\\..\\c.md",)], "path string", lambda t: t.select("path", X.normal_path(F.col("path")).alias("normal")), "SELECT * FROM (VALUES ('./a/../b//c.md', 'b/c.md'), ('a\\b\\..\\c.md', 'a/c.md')) t(path, normal)")
_values("F10_sibling_links", [("dir/own.md", ["b.md", "x/c.md"])], "id string, links array<string>", lambda t: t.select(F.explode(X.resolve_links(F.col("id"), F.col("links"))).alias("target")), "SELECT unnest(['dir/b.md', 'x/c.md']) AS target")
_CITING = "A Resolução BCB nº 1, de 12 de agosto de 2020, a Circular nº 3.682 e a Carta Circular nº 4.006; Resolução CMN n° 4.893; Resolução BCB nº 1, de 12 de agosto de 2020."
_values("F11_citations", [(_CITING,)], "body string", lambda t: t.select(F.posexplode(X.citations(F.col("body"))).alias("n", "ref")), "SELECT * FROM (VALUES (0, 'RES-BCB-1-2020'), (1, 'CIR-3682'), (2, 'CC-4006'), (3, 'RES-CMN-4893')) t(n, ref)")
_values("F12_base_reference", [("RES-BCB-1-2020",), ("CIR-3682",)], "ref string", lambda t: t.select("ref", X.base_reference(F.col("ref")).alias("base")), "SELECT * FROM (VALUES ('RES-BCB-1-2020', 'RES-BCB-1'), ('CIR-3682', 'CIR-3682')) t(ref, base)")
_values("F14_first_line", [("\n uma ação\nresto",), ("ç" * 150,)], "s string", lambda t: t.select(X.first_line(F.col("s")).alias("line")), "SELECT unnest(['uma ação', repeat('ç', 100)]) AS line")
_values("F15_article_number", [("31-A",), ("5º",)], "raw string", lambda t: t.select(X.article_number(F.col("raw")).alias("n")), "SELECT unnest(['0031-a', '0005']) AS n")
_values("F19_path_root", [("POST /cob/{txid}",), ("GET",)], "title string", lambda t: t.select(X.path_root(F.col("title")).alias("root")), "SELECT unnest(['cob', '']) AS root")
_values("F20_salient_terms", [("POST /cob", "Cobrança via Pix", ["dict"], "ApiEndpoint")], "title string, description string, tags array<string>, type string", lambda t: t.select(F.explode(X.salient_terms(*map(F.col, t.columns))).alias("term")), "SELECT unnest(['cob', 'cobranca', 'pix', 'dict', 'path:cob']) AS term")
_values("F28_valid_ispb", [("12345678",), ("1234567",), ("1234567a",)], "code string", lambda t: t.select("code", X.valid_ispb(F.col("code")).alias("ok")), "SELECT * FROM (VALUES ('12345678', true), ('1234567', false), ('1234567a', false)) t(code, ok)")
_values("F30_valid_cnpj", [("11.222.333/0001-81",), ("11222333000182",), ("11111111111111",)], "cnpj string", lambda t: t.select("cnpj", X.valid_cnpj(F.col("cnpj")).alias("ok")), "SELECT * FROM (VALUES ('11.222.333/0001-81', true), ('11222333000182', false), ('11111111111111', false)) t(cnpj, ok)")
_values("F31_valid_series_point", [("12", "-1.50"), ("12", "1,5"), ("x", "1")], "code string, value string", lambda t: t.select("code", "value", X.valid_series_point(F.col("code"), F.col("value")).alias("ok")), "SELECT * FROM (VALUES ('12', '-1.50', true), ('12', '1,5', false), ('x', '1', false)) t(code, value, ok)")
_values("F37_valid_amount", [("10.00",), ("10.001",), (".5",)], "amount string", lambda t: t.select("amount", X.valid_amount(F.col("amount")).alias("ok")), "SELECT * FROM (VALUES ('10.00', true), ('10.001', false), ('.5', false)) t(amount, ok)")
_values("F36_crc16", [("123456789",)], "text string", lambda t: t.select(codec.checksum("text").alias("crc")), "SELECT '29B1' AS crc")
_values("F32_tlv_fields", [("000201",), ("0002",)], "code string", lambda t: t.select("code", F.get(codec.fields("code"), F.lit(0)).val.alias("first")), "SELECT * FROM (VALUES ('000201', '01'), ('0002', NULL)) t(code, first)")
_PAY = "key string, url string, description string, merchant_name string, city string, amount string, txid string"
_PAYLOADS = [("fulano@example.com", "", "", "ACME LTDA", "SAO PAULO", "10.00", "PEDIDO123"), ("", "", "", "ACME", "SP", "", ""), ("k", "u", "", "ACME", "SP", "", ""), ("k", "", "", "A" * 26, "SP", "", ""), ("k", "", "", "AÇO", "SP", "1.234", ""), ("k", "", "", "AÇO", "SP", "1.2", "")]


def _payload(t):
    return {c: F.col(c) for c in t.columns}


_values("F34_payload_validate", _PAYLOADS, _PAY, lambda t: t.select(codec.invalid_reason(_payload(t)).alias("reason")), "SELECT unnest([NULL, 'a key or a url is required', 'key and url exclude each other', 'merchant_name exceeds 25 bytes', 'amount is not a decimal with up to two places', 'merchant_name has other characters than printable ASCII']) AS reason")
_values("F35_payload_encode", _PAYLOADS[:1], _PAY, lambda t: t.select(F.substring(codec.encode(_payload(t)), 1, 10).alias("head")), "SELECT '0002010102' AS head")
_values("F33_parse_round_trip", _PAYLOADS[:1], _PAY, lambda t: t.select(codec.parse(codec.encode(_payload(t))).alias("p")).select("p.key", "p.merchant_name", "p.city", "p.amount", "p.txid", "p.dynamic", "p.crc_valid"), "SELECT 'fulano@example.com' AS key, 'ACME LTDA' AS merchant_name, 'SAO PAULO' AS city, '10.00' AS amount, 'PEDIDO123' AS txid, false AS dynamic, true AS crc_valid")

# -- the same on the given rows ------------------------------------------------
_k = "substr(id, 5, 8)::BIGINT"


def _K():
    """The number in a row's id."""
    return F.substring("id", 5, 8).cast("long")


_two = lambda: F.substring("content_sha", 1, 2)


def _text(*parts):
    """Texts (as they are) and columns, one after the other."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _rows(name, source, columns, sql):
    registry.add(name, lambda spark, d: table(spark, d, source).select(*[c.alias(n) for n, c in columns().items()]), sql)


_c = F.col
_concept("F08_markdown_links", lambda: {"targets": F.array_join(X.markdown_links(_text("see [a](", _c("source_uri"), "/", _two(), ".md), [b](./x/../", _c("language"), ".md#t), [a](", _c("source_uri"), "/", _two(), ".md), [c](http://h/c.md), [d](d.txt)")), ",")}, "source_uri || '/' || left(content_sha, 2) || '.md,' || language || '.md' AS targets")
_concept("F09_normal_path", lambda: {"normal": X.normal_path(_text("./", _c("source_uri"), "/../", _c("language"), "//a\\b\\..\\", _two(), ".md"))}, "language || '/a/' || left(content_sha, 2) || '.md' AS normal")
_concept("F10_sibling_links", lambda: {"targets": F.array_join(X.resolve_links(_c("id"), F.array(_text(_two(), ".md"), _text(_c("language"), "/c.md"))), ",")}, "'doc/' || left(content_sha, 2) || '.md,' || language || '/c.md' AS targets")


def _citing():
    dated = ("Resolução BCB nº ", _K(), ", de 12 de agosto de ", 2000 + _K() % 25)
    return _text("A ", *dated, ", a Circular nº 3.", F.lpad((_K() % 1000).cast("string"), 3, "0"), " e a Carta Circular nº 4.006; Resolução CMN n° 4.893; ", *dated, ".")


_concept("F11_citations", lambda: {"refs": F.array_join(X.citations(_citing()), " ")}, f"'RES-BCB-' || {_k} || '-' || (2000 + {_k} % 25) || ' CIR-3' || lpad(({_k} % 1000)::VARCHAR, 3, '0') || ' CC-4006 RES-CMN-4893' AS refs")
_concept("F12_base_reference", lambda: {"base": X.base_reference(F.when(_K() % 2 == 0, _text("RES-BCB-", _K(), "-2020")).otherwise(_text("CIR-", _K())))}, f"CASE WHEN {_k} % 2 = 0 THEN 'RES-BCB-' ELSE 'CIR-' END || {_k} AS base")
_LINE = "trim(split_part(regexp_replace(body, '^\\s+|\\s+$', '', 'g'), chr(10), 1))"
_concept("F14_first_line", lambda: {"line": X.first_line(_c("body"))}, f"CASE WHEN strlen({_LINE}) <= 200 THEN {_LINE} ELSE (SELECT max(left({_LINE}, n)) FROM (SELECT unnest(range(50, 201)) AS n) WHERE strlen(left({_LINE}, n)) <= 200) END AS line")
_concept("F15_article_number", lambda: {"n": X.article_number(_text(_K() % 500, F.when(_K() % 3 == 0, "º").when(_K() % 3 == 1, "-A").otherwise("")))}, f"lpad(({_k} % 500)::VARCHAR, 4, '0') || CASE WHEN {_k} % 3 = 1 THEN '-a' ELSE '' END AS n")
_concept("F19_path_root", lambda: {"root": X.path_root(F.when(_K() % 3 == 0, "GET").otherwise(_text("POST /X", _c("language"), _K() % 7, "/{id}")))}, f"CASE WHEN {_k} % 3 = 0 THEN '' ELSE 'x' || language || ({_k} % 7) END AS root")
_concept("F20_salient_terms", lambda: {"terms": F.array_join(X.salient_terms(F.when(_K() % 2 == 1, "POST /cob").otherwise("title"), F.when(_K() % 3 == 0, "Cobrança via Pix").otherwise("nada"), _c("tags"), _c("type")), ",")}, f"array_to_string(list_filter([CASE WHEN {_k} % 2 = 1 THEN 'cob' END, CASE WHEN {_k} % 3 = 0 THEN 'cobranca' END, CASE WHEN {_k} % 3 = 0 THEN 'pix' END, CASE WHEN {_k} % 2 = 1 AND type = 'ApiEndpoint' THEN 'path:cob' END], lambda x: x IS NOT NULL), ',') AS terms")
_CRC = "list_reduce(list_transform(range(0, strlen({0})), lambda i: ('0x' || substr(hex(encode({0})), (2 * i + 1)::INTEGER, 2))::UBIGINT), lambda c, b: list_reduce(range(8)::UBIGINT[], lambda y, i: CASE WHEN y & 32768 > 0 THEN xor(y << 1, 4129) & 65535 ELSE (y << 1) & 65535 END, xor(c, b << 8)), 65535::UBIGINT)"
_concept("F36_crc16", lambda: {"crc": codec.checksum("title")}, f"printf('%04X', {_CRC.format('title')}::BIGINT) AS crc")
_concept("F32_tlv_fields", lambda: {"ids": F.array_join(codec.fields(_text("0002", "01", "59", F.lpad(F.octet_length("language").cast("string"), 2, "0"), _c("language"), F.when(_K() % 4 == 0, "6005ab").otherwise("")))["id"], ",")}, f"CASE WHEN {_k} % 4 <> 0 THEN '00,59' END AS ids")
_rows("F28_valid_ispb", "customer", lambda: {"c_custkey": _c("c_custkey"), "ok": X.valid_ispb(F.when(_c("c_custkey") % 3 == 0, F.lpad(_c("c_custkey").cast("string"), 8, "0")).otherwise(_c("c_custkey").cast("string")))}, "SELECT c_custkey, c_custkey % 3 = 0 OR c_custkey >= 10000000 AS ok FROM customer")
_DIGITS = "list_transform(range(1, 15), lambda i: substr(c, i::INTEGER, 1)::INTEGER)"


def _check_sql(weights):
    total = "list_sum(list_transform(list_zip(" + f"d[1:{len(weights)}], {list(weights)}), lambda x: x[1] * x[2]))"
    return f"(CASE WHEN {total} % 11 < 2 THEN 0 ELSE 11 - {total} % 11 END)"


_rows("F30_valid_cnpj", "customer", lambda: {"c_custkey": _c("c_custkey"), "ok": X.valid_cnpj(F.lpad((_c("c_custkey") * 7919 + 81).cast("string"), 14, "0"))}, f"WITH a AS (SELECT c_custkey, lpad((c_custkey * 7919 + 81)::VARCHAR, 14, '0') AS c FROM customer), b AS (SELECT *, {_DIGITS} AS d FROM a) SELECT c_custkey, d[13] = {_check_sql((5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2))} AND d[14] = {_check_sql((6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2))} AND len(list_distinct(d)) > 1 AS ok FROM b")
_rows("F31_valid_series_point", "events", lambda: {"event_id": _c("event_id"), "ok": X.valid_series_point(F.when(_c("event_id") % 5 == 0, _c("event_type")).otherwise(_c("user_id").cast("string")), F.when(_c("event_id") % 3 == 0, F.translate(F.format_string("%.2f", "value"), ".", ",")).otherwise(F.format_string("%.2f", "value")))}, "SELECT event_id, event_id % 5 <> 0 AND event_id % 3 <> 0 AS ok FROM events")
_rows("F37_valid_amount", "customer", lambda: {"c_custkey": _c("c_custkey"), "ok": X.valid_amount(F.when(_c("c_custkey") % 4 == 0, F.format_string("%.3f", "c_acctbal")).otherwise(F.format_string("%.2f", "c_acctbal")))}, "SELECT c_custkey, c_custkey % 4 <> 0 AND NOT starts_with(printf('%.2f', c_acctbal), '-') AS ok FROM customer")


def _payloads(spark, d):
    """A payload of each supplier, some of them wrong in one way or another."""
    k, text = F.col("s_suppkey"), lambda c: c.cast("string")
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select("s_suppkey", F.when(k % 5 != 0, F.concat(F.lit("s"), text(k), F.lit("@x.com"))).otherwise("").alias("key"), F.when(k % 7 == 0, F.concat(F.lit("u.x/"), text(k))).otherwise("").alias("url"), F.lit("").alias("description"), F.when(k % 3 == 0, F.concat("s_name", "s_name")).otherwise(F.col("s_name")).alias("merchant_name"), F.col("n_name").alias("city"), F.when(k % 4 == 0, "1.234").otherwise(F.format_string("%.2f", F.abs("s_acctbal"))).alias("amount"), F.concat(F.lit("T"), text(k)).alias("txid"))


def _of(rows):
    return {c: rows[c] for c in ("key", "url", "description", "merchant_name", "city", "amount", "txid")}


_PAY_SQL = """pay AS (SELECT s_suppkey, s_suppkey AS k, CASE WHEN s_suppkey % 5 <> 0 THEN 's' || s_suppkey || '@x.com' ELSE '' END AS key, CASE WHEN s_suppkey % 7 = 0 THEN 'u.x/' || s_suppkey ELSE '' END AS url, CASE WHEN s_suppkey % 3 = 0 THEN s_name || s_name ELSE s_name END AS merchant_name, n_name AS city, CASE WHEN s_suppkey % 4 = 0 THEN '1.234' ELSE printf('%.2f', abs(s_acctbal)) END AS amount, 'T' || s_suppkey AS txid FROM supplier JOIN nation ON s_nationkey = n_nationkey),
why AS (SELECT *, CASE WHEN key = '' AND url = '' THEN 'a key or a url is required' WHEN key <> '' AND url <> '' THEN 'key and url exclude each other' WHEN strlen(merchant_name) > 25 THEN 'merchant_name exceeds 25 bytes' WHEN strlen(city) > 15 THEN 'city exceeds 15 bytes' WHEN k % 4 = 0 THEN 'amount is not a decimal with up to two places' END AS reason FROM pay)"""


@query("F34_payload_validate", f"WITH {_PAY_SQL} SELECT s_suppkey, reason FROM why")
def f34(spark, d):
    rows = _payloads(spark, d)
    return rows.select("s_suppkey", codec.invalid_reason(_of(rows)).alias("reason"))


@query("F33_parse_round_trip", f"WITH {_PAY_SQL} SELECT s_suppkey, key, url, merchant_name, city, amount, txid, true AS crc_valid FROM why WHERE reason IS NULL")
def f33(spark, d):
    rows = _payloads(spark, d)
    good = rows.where(codec.invalid_reason(_of(rows)).isNull()).select("s_suppkey", codec.parse(codec.encode(_of(rows))).alias("p"))
    return good.select("s_suppkey", *[f"p.{c}" for c in ("key", "url", "merchant_name", "city", "amount", "txid", "crc_valid")])


_F = "lpad(strlen({0})::VARCHAR, 2, '0') || {0}"
_CODE_SQL = f"""{_PAY_SQL},
acc AS (SELECT *, '0014br.gov.bcb.pix' || CASE WHEN url <> '' THEN '25' || {_F.format('url')} ELSE '01' || {_F.format('key')} END AS account, '05' || {_F.format('txid')} AS more FROM why WHERE reason IS NULL),
head AS (SELECT s_suppkey, '000201' || CASE WHEN url <> '' THEN '010212' ELSE '010211' END || '26' || {_F.format('account')} || '52040000' || '5303986' || '54' || {_F.format('amount')} || '5802BR' || '59' || {_F.format('merchant_name')} || '60' || {_F.format('city')} || '62' || {_F.format('more')} || '6304' AS t FROM acc)"""


@query("F35_payload_encode", f"WITH {_CODE_SQL} SELECT s_suppkey, t || printf('%04X', {_CRC.format('t')}::BIGINT) AS code FROM head")
def f35(spark, d):
    rows = _payloads(spark, d)
    return rows.select("s_suppkey", codec.encode(_of(rows)).alias("code")).where("code is not null")


QUERIES, SQL = registry.queries, registry.sql

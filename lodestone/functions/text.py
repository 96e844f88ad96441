"""Scalar functions on text, URLs, markup and identifiers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters of Portuguese and their plain forms.
ACCENTED, PLAIN = "áâãàäéêèëíîìïóôõòöúûùüçñ", "aaaaaeeeeiiiiooooouuuucn"
#: Words that carry no title intent.
TITLE_STOP = ("de", "da", "do", "e", "a", "o", "no", "na", "em", "para", "com", "por", "of", "the", "to", "in", "and")
#: Domain terms that relate concepts.
SALIENT = ("cobranca", "cobv", "cobr", "cob", "devolucao", "pix", "dict", "qrcode", "qr", "txid", "lote", "webhook", "recorrencia", "agendamento", "vinculo", "chave", "pagador", "recebedor", "psp", "spi", "pacs", "camt", "liquidacao", "arranjo", "participante", "saque", "troco", "reembolso", "conciliacao")
#: The edge of an ASCII word, where the Java engine's own would count all letters.
OPEN, CLOSE = "(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])", "(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])"


def fold(text: Column) -> Column:
    """Lower-cased, without Portuguese accents."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def fold_tokens(text: Column) -> Column:
    """Folded words of two characters and more, stop words left out, in order."""
    words = F.split(F.regexp_replace(fold(text), "[^a-z0-9]+", " "), " ")
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*TITLE_STOP))


def title_boost(query: Column, title: Column, weight: float = 0.5) -> Column:
    """1, plus up to ``weight`` for the share of the query's distinct words that the title has."""
    q = F.array_distinct(fold_tokens(query))
    share = F.size(F.array_intersect(q, fold_tokens(title))) / F.size(q)
    return F.when(F.size(q) == 0, F.lit(1.0)).otherwise(1.0 + weight * share)


def type_weight(kind: Column) -> Column:
    return F.when(kind.isin("ApiEndpoint", "PacsMessage", "CamtMessage"), 1.15).otherwise(1.0)


def matched_fields(query: Column, **fields: Column) -> Column:
    """Names of the fields that hold a word of the query, in the order given."""
    words = F.array_distinct(F.filter(F.split(F.lower(query), "[^\\p{L}\\p{Nd}]+"), lambda w: w != ""))
    hit = lambda c: F.exists(words, lambda w: F.contains(F.lower(F.coalesce(c, F.lit(""))), w))
    return F.filter(F.array(*[F.when(hit(c), F.lit(n)) for n, c in fields.items()]), lambda x: x.isNotNull())


def markdown_links(body: Column) -> Column:
    """Targets of relative links to .md files, each once, in order; without fragment, normalised."""
    found = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"\]\(([^)\s]+)\)"), F.lit(1))
    bare = F.transform(found, lambda x: F.substring_index(x, "#", 1))
    kept = F.filter(bare, lambda x: x.endswith(".md") & ~F.contains(x, F.lit("://")) & ~x.startswith("/"))
    return F.array_distinct(F.transform(kept, normal_path))


def normal_path(path: Column) -> Column:
    """A relative path without ``.`` and ``..`` steps and with forward slashes."""
    steps = F.split(F.translate(path, "\\", "/"), "/")
    add = lambda acc, s: F.when(s.isin("", "."), acc).when((s == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == "..", acc).otherwise(F.concat(acc, F.array(s)))
    return F.array_join(F.aggregate(steps, F.array().cast("array<string>"), add), "/")


def resolve_links(owner: Column, links: Column) -> Column:
    """Targets without a folder belong to the owner's folder."""
    folder = F.regexp_extract(owner, "^(.*/)[^/]*$", 1)
    return F.transform(links, lambda x: F.when(F.contains(x, F.lit("/")), x).otherwise(F.concat(folder, x)))


#: The instruments that citations name, and their prefixes.
INSTRUMENTS = (("RES-BCB", "Resolução\\s+BCB"), ("RES-CMN", "Resolução\\s+CMN"), ("IN-BCB", "Instrução\\s+Normativa\\s+BCB"), ("CC", "Carta\\s+Circular"), ("CIR", "(?<!Carta\\s)Circular"))
_NUMBER = "\\s+n[ºo°]\\.?\\s*(\\d[\\d.]*)"
_DATE = "(?:,?\\s+de\\s+\\d{1,2}\\s+de\\s+\\p{L}+\\s+de\\s+(\\d{4}))?"


def citations(body: Column) -> Column:
    """Normative ids that a text cites, each once, in order of first place: prefix, number, year if dated."""
    text = F.coalesce(body, F.lit(""))
    keyword = "(" + "|".join(f"(?:{k})" for _, k in INSTRUMENTS) + ")"
    found = F.regexp_extract_all(text, F.lit(f"(?iu){keyword}{_NUMBER}{_DATE}"), F.lit(0))

    def name(hit: Column) -> Column:
        prefix = F.coalesce(*[F.when(hit.rlike(f"(?iu)^{k}"), F.lit(p)) for p, k in INSTRUMENTS])
        number = F.regexp_replace(F.regexp_extract(hit, f"(?iu){_NUMBER}", 1), "[.]", "")
        year = F.regexp_extract(hit, "\\s(\\d{4})$", 1)
        return F.concat(prefix, F.lit("-"), number, F.when(hit.rlike("(?iu)\\sde\\s+\\d{4}$"), F.concat(F.lit("-"), year)).otherwise(""))

    return F.array_distinct(F.transform(found, name))


def base_reference(ref: Column) -> Column:
    """A citation without its year."""
    return F.regexp_replace(ref, "^([A-Z]+(?:-[A-Z]+)?-\\d+)-\\d{4}$", "$1")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def first_bytes(text: Column, n: int) -> Column:
    """The longest start of a text that has no more than n bytes of UTF-8 and ends with a whole character."""
    raw = F.substring(F.encode(text, "UTF-8"), 1, n)
    return F.when(F.octet_length(text) <= n, text).otherwise(F.regexp_replace(F.make_valid_utf8(raw.cast("string")), "�+$", ""))


def first_line(text: Column, n: int = 200) -> Column:
    return first_bytes(F.trim(F.substring_index(F.regexp_replace(text, "^\\s+|\\s+$", ""), "\n", 1)), n)


def clean_title(text: Column, n: int = 80) -> Column:
    return first_bytes(F.trim(F.regexp_replace(text, "\\s+", " ")), n)


def article_number(raw: Column) -> Column:
    """31-A as 0031-a."""
    return F.concat(F.lpad(F.regexp_extract(raw, "(\\d+)", 1), 4, "0"), F.lower(F.regexp_extract(raw, "(-[A-Za-z])$", 1)))


#: Words that mark Portuguese prose.
PORTUGUESE_MARKS = ("não", "são", "função", "implementação", "cobrança", "devolução", "reservas", "liquidação", "que", "para", "uma")


def prose_language(body: Column) -> Column:
    """pt with five marker words or more, else en."""
    marks = F.regexp_count(F.coalesce(body, F.lit("")), F.lit(f"(?iu){OPEN}(?:{'|'.join(PORTUGUESE_MARKS)}){CLOSE}"))
    return F.when(marks >= 5, "pt").otherwise("en")


def path_root(title: Column) -> Column:
    """cob of 'POST /cob/{txid}'."""
    return F.lower(F.trim(F.regexp_extract(title, "/([^/ {]*)", 1)))


def salient_terms(title: Column, description: Column, tags: Column, kind: Column) -> Column:
    words = F.split(F.regexp_replace(fold(F.concat_ws(" ", title, description, F.array_join(tags, " "))), "[^a-z0-9]+", " "), " ")
    path = F.when((kind == "ApiEndpoint") & (path_root(title) != ""), F.array(F.concat(F.lit("path:"), path_root(title)))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array_intersect(words, F.array(*map(F.lit, SALIENT))), path)


#: The entities that minimal markup stripping decodes; & comes last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def html_text(html: Column) -> Column:
    """Text of a page: no scripts or styles, block ends as line breaks, entities decoded, spaces single."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), "(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(F.regexp_replace(out, "(?i)<(br|/p|/div|/li|/h[1-6]|/tr)[^>]*>", "\n"), "(?s)<[^>]*>", " ")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.regexp_replace(out, "[ \\t\\r\\f]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, " ?\n ?", "\n"), "\n{2,}", "\n"))


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1))


def simple_html_text(html: Column) -> Column:
    out = F.regexp_replace(html, "(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, "\\s+", " "))


def valid_utf8(text: Column) -> Column:
    return F.replace(F.make_valid_utf8(text), F.lit("�"), F.lit(""))


def normal_url(url: Column) -> Column:
    """Scheme and host lower-cased, default ports, fragment and trailing slash gone, query sorted."""
    u = F.substring_index(F.trim(url), "#", 1)
    origin = F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?]*)", 1))
    rest = F.substring(u, F.length(origin) + 1, F.length(u))
    path, asked = F.substring_index(rest, "?", 1), F.regexp_extract(rest, "\\?(.*)$", 1)
    ordered = F.array_join(F.array_sort(F.split(asked, "&")), "&")
    return F.concat(F.regexp_replace(origin, ":(80|443)$", ""), F.regexp_replace(path, "/$", ""), F.when(asked == "", "").otherwise(F.concat(F.lit("?"), ordered)))


def url_hash(normal: Column) -> Column:
    return F.substring(F.sha2(normal, 256), 1, 12)


def contains_unaccented(text: Column, part: Column) -> Column:
    """Substring search that neither case nor accents matter to."""
    return F.contains(F.collate(text, "UNICODE_CI_AI"), F.collate(part, "UNICODE_CI_AI"))


def valid_ispb(code: Column) -> Column:
    return code.rlike("^[0-9]{8}$")


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def valid_cnpj(cnpj: Column) -> Column:
    """Fourteen digits, not all alike, with both modulo-11 check digits right."""
    digits = F.transform(F.split(digits_only(cnpj), ""), lambda c: c.cast("int"))

    def check(weights):
        total = F.aggregate(F.zip_with(F.slice(digits, 1, len(weights)), F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(0), lambda s, x: s + x)
        return F.when(total % 11 < 2, 0).otherwise(11 - total % 11)

    first, second = (5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2), (6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2)
    good = (F.get(digits, F.lit(12)) == check(first)) & (F.get(digits, F.lit(13)) == check(second)) & ~digits_only(cnpj).rlike("^(.)\\1*$")
    return F.when(F.length(digits_only(cnpj)) == 14, F.coalesce(good, F.lit(False))).otherwise(False)


def valid_series_point(code: Column, value: Column) -> Column:
    return code.rlike("^[0-9]+$") & value.rlike("^-?[0-9]+(\\.[0-9]+)?$")


def valid_amount(amount: Column) -> Column:
    return amount.rlike("^[0-9]+(\\.[0-9]{1,2})?$")


#: What is redacted, in order, and the mark in its place.
PERSONAL = (
    (f"{OPEN}\\d{{2}}\\.\\d{{3}}\\.\\d{{3}}/\\d{{4}}-\\d{{2}}{CLOSE}", "CNPJ"), (f"{OPEN}\\d{{3}}\\.\\d{{3}}\\.\\d{{3}}-\\d{{2}}{CLOSE}", "CPF"), (f"{OPEN}\\d{{14}}{CLOSE}", "CNPJ"), (f"{OPEN}\\d{{11}}{CLOSE}", "CPF"),
    (f"(?:\\+55\\s?)?\\(?\\d{{2}}\\)?[\\s.-]?\\d{{4,5}}-?\\d{{4}}{CLOSE}", "PHONE"), (f"{OPEN}[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{{2,}}{CLOSE}", "EMAIL"),
)


def redact(text: Column) -> Column:
    """The text with marks in place of personal data; one look passes texts without three digits in a row or an @, which hold none."""
    out = text
    for pattern, label in PERSONAL:
        out = F.regexp_replace(out, pattern, f"[REDACTED:{label}]")
    return F.when(text.rlike("[0-9]{3}|@"), out).otherwise(text)


def cache_key(epoch: Column, question: Column, options: Column) -> Column:
    normal = F.trim(F.regexp_replace(F.lower(question), "\\s+", " "))
    return F.sha2(F.concat_ws("|", epoch.cast("string"), normal, options), 256)


def all_caps(text: Column) -> Column:
    return text.rlike("[A-Z]") & ~text.rlike("[a-z]")


def without_heading(body: Column) -> Column:
    return F.regexp_replace(F.coalesce(body, F.lit("")), "^[\\n ]*# [^\\n]*\\n?", "")


def official_tags(source: Column, tags: Column, hosts=("bcb.gov.br", "planalto.gov.br")) -> Column:
    """The official tag added, and tags sorted, where the source is on one of the hosts."""
    known = F.exists(F.array(*map(F.lit, hosts)), lambda h: F.contains(F.coalesce(source, F.lit("")), h))
    return F.when(known, F.array_sort(F.array_distinct(F.array_append(F.coalesce(tags, F.array().cast("array<string>")), F.lit("trusted:official"))))).otherwise(tags)


def domain_and_tags(domain: Column, tags: Column) -> tuple[Column, Column]:
    """The domain of a row from its tags, else its column, else pix; in the last case the tag is added."""
    tags = F.coalesce(tags, F.array().cast("array<string>"))
    tag = F.substring(F.get(F.filter(tags, lambda t: t.startswith("domain:")), F.lit(0)), 8, 1000)
    given = F.when(F.coalesce(domain, F.lit("")) != "", domain)
    return F.coalesce(tag, given, F.lit("pix")), F.when(tag.isNull() & given.isNull(), F.array_append(tags, F.lit("domain:pix"))).otherwise(tags)

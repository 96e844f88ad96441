"""Answers over supplied replies: markers, JSON in prose, citation checks, refusals, caching, brand names."""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..adapters import CONCEPT_SQL, concepts, table
from ..functions.text import cache_key, contains_unaccented, redact
from ..plans.registry import Registry
from .retrieval import ADJACENT, VOCABULARY

registry = Registry()
query = registry
REFUSAL = "Não encontrado no contexto"
#: Trade names and what the registry calls them.
BRANDS = (
    ("nubank", "nu pagamentos"), ("nu bank", "nu pagamentos"), ("pagbank", "pagseguro"), ("pag bank", "pagseguro"), ("mercadopago", "mercado pago"), ("mercado livre", "mercado pago"), ("willbank", "will"), ("will bank", "will"), ("ame", "ame digital"), ("iti", "itau unibanco"), ("c6", "c6 bank"), ("recargapay", "recarga"), ("modal", "genial"), ("bancoob", "sicoob"), ("banese", "estado de sergipe"), ("banpara", "estado do para"),
)


def without_marker(text: str, marker: str) -> str:
    """A text in which the marker does not come up, not even by taking another one out."""
    while marker and marker in text:
        text = text.replace(marker, "")
    return text


def json_in_prose(reply: str) -> str:
    """The first whole JSON object of a reply, or its trimmed text if there is none."""
    fence = reply.split("```")
    text = (fence[1].split("\n", 1)[-1] if len(fence) > 1 else reply).strip()
    at = text.find("{")
    if at < 0:
        return text
    try:
        return text[at : at + json.JSONDecoder(strict=False).raw_decode(text[at:])[1]]
    except ValueError:
        return text


def intent_terms(replies: DataFrame) -> DataFrame:
    """(id, terms) of enrichment replies (value): {"concepts": [{"id", "intent_terms"}]}; the last of an id's wins."""
    @F.pandas_udf("string")
    def whole(values: pd.Series) -> pd.Series:
        return values.map(json_in_prose, na_action="ignore")

    bare = whole("value")
    rows = replies.select(F.posexplode(F.from_json(bare, "struct<concepts:array<struct<id:string,intent_terms:string>>>")["concepts"]).alias("n", "c"))
    rows = rows.select("n", F.trim("c.id").alias("id"), F.trim("c.intent_terms").alias("terms")).where("id <> ''")
    return rows.groupBy("id").agg(F.max_by("terms", "n").alias("terms"))


def synthesize(generate: Callable[[str], str], question: str, context: list[tuple[str, str]], redact_text: Callable[[str], str] | None = None) -> dict:
    """{text, citations, refused} from a generator's reply; only context ids count as citations, and an answer without one is a refusal."""
    if not context:
        return {"text": REFUSAL, "citations": [], "refused": True}
    prompt = "\n\n".join([f"Pergunta: {question}", *(f"[{i}]\n{without_marker(t, '<<<END>>>')}\n<<<END>>>" for i, t in context)])
    found = json.loads(json_in_prose(generate(prompt)))
    known = {i for i, _ in context}
    cited = [c for c in dict.fromkeys(found.get("citations") or []) if c in known]
    text, refused = (found.get("text") or "").strip(), bool(found.get("refused"))
    if not refused and (not cited or not text):
        refused, text, cited = True, text or REFUSAL, cited if text else []
    return {"text": redact_text(text) if redact_text else text, "citations": cited, "refused": refused}


class AnswerCache:
    """The answers used last, by a key that holds the epoch; an entry of an older epoch is never found."""

    def __init__(self, size: int = 128):
        self.size, self.kept = size, OrderedDict()

    def get(self, key: str):
        if key in self.kept:
            self.kept.move_to_end(key)
            return self.kept[key]
        return None

    def put(self, key: str, answer) -> None:
        self.kept[key] = answer
        self.kept.move_to_end(key)
        while len(self.kept) > self.size:
            self.kept.popitem(last=False)


def brand_fragments(questions: DataFrame, column: str = "q") -> DataFrame:
    """(q, fragment): registry names to search besides the question: brands that hold it or that it holds, and bco for banco."""
    spark = questions.sparkSession
    q = F.lower(F.trim(column))
    rows = questions.select(F.col(column), q.alias("_q")).where("_q <> ''")
    brands = F.broadcast(spark.createDataFrame(list(BRANDS), "brand string, fragment string"))  # the list's own size
    hit = (F.length("_q") >= 3) & (F.contains("brand", F.col("_q")) | F.contains(F.col("_q"), F.col("brand")))
    named = rows.join(brands, hit).select(column, "_q", "fragment")
    short = rows.where(F.col("_q").startswith("banco ")).select(column, "_q", F.concat(F.lit("bco "), F.substring("_q", 7, 1000)).alias("fragment"))
    return named.unionByName(short).where("fragment <> _q").select(column, "fragment").distinct()


def search_participants(participants: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Participants whose name or legal name holds a text, accents and case aside; by code."""
    hit = contains_unaccented(F.col("name"), F.lit(text)) | contains_unaccented(F.coalesce("legal_name", F.lit("")), F.lit(text))
    return participants.where(hit).orderBy("ispb").limit(limit)


def adjacent_types(rows: DataFrame, kind: Column) -> DataFrame:
    """``rows`` with whether their type belongs to the subject of ``kind``: a join with a small literal table."""
    table = F.broadcast(rows.sparkSession.createDataFrame([(a, b) for a, bs in ADJACENT.items() for b in bs], "_from string, _to string"))
    return rows.join(table, (F.col("_from") == kind) & (F.col("_to") == F.col("type")), "left").withColumn("adjacent", F.col("_from").isNotNull()).drop("_from", "_to")


def vocabulary_hits(words: DataFrame) -> DataFrame:
    """(word, subquery): vocabulary stems that begin a word."""
    stems = F.broadcast(words.sparkSession.createDataFrame([(stem, s) for stems, s in VOCABULARY for stem in stems], "stem string, subquery string"))
    return words.join(stems, F.col("word").startswith(F.col("stem"))).select("word", "subquery").distinct()


def grounding_bodies(order: DataFrame, concepts: DataFrame) -> DataFrame:
    """(ord, id, title, body) of the ids that exist, in order."""
    return order.join(concepts.select("id", "title", "body"), "id").select("ord", "id", "title", "body").orderBy("ord")


#: Small tables with the values expected of them, for the tests.
LITERALS: dict = {}


def _values(name, rows, columns, make, sql):
    LITERALS[name] = (lambda spark: make(spark.createDataFrame(rows, columns)), sql)


_values("J13_adjacent_types", [("a", "PacsMessage"), ("b", "WebPage")], "id string, type string", lambda t: adjacent_types(t, F.lit("ApiEndpoint")), "SELECT * FROM (VALUES ('a', 'PacsMessage', true), ('b', 'WebPage', false)) t(id, type, adjacent)")
_values("J14_stem_join", [("estornar",), ("apis",), ("x",)], "word string", vocabulary_hits, "SELECT * FROM (VALUES ('estornar', 'devolução pix refund'), ('apis', 'endpoint API')) t(word, subquery)")
_values("J15_brand_join", [("nubank",), ("Banco do Brasil",), ("nu",)], "q string", brand_fragments, "SELECT * FROM (VALUES ('nubank', 'nu pagamentos'), ('Banco do Brasil', 'bco do brasil')) t(q, fragment)")
_values("F43_intent_terms", [('ok ```json\n{"concepts":[{"id":"a","intent_terms":" x, y "},{"id":""}]}\n``` end',)], "value string", intent_terms, "SELECT 'a' AS id, 'x, y' AS terms")


_ADJACENT = " OR ".join(f"type = '{t}'" for t in ADJACENT["ApiEndpoint"])
_STEMS = ", ".join(f"('{stem}', '{s}')" for stems, s in VOCABULARY for stem in stems)
_BRANDS = ", ".join(f"('{a}', '{b}')" for a, b in BRANDS)


@query("J13_adjacent_types", f"WITH {CONCEPT_SQL} SELECT id, {_ADJACENT} AS adjacent FROM concept")
def j13(spark, d):
    return adjacent_types(concepts(spark, d).select("id", "type"), F.lit("ApiEndpoint")).select("id", "adjacent")


@query("J14_stem_join", f"WITH {CONCEPT_SQL}, w AS (SELECT DISTINCT (['estorn', 'api', 'dict', 'nada', 'chave'])[substr(id, 12, 1)::INT % 5 + 1] || language || substr(id, 11, 1) AS word FROM concept) SELECT DISTINCT word, subquery FROM w JOIN (VALUES {_STEMS}) t(stem, subquery) ON starts_with(word, stem)")
def j14(spark, d):
    """Words that begin with some of the stems, and one that does not."""
    some = F.array(*map(F.lit, ("estorn", "api", "dict", "nada", "chave")))
    word = F.concat(F.get(some, F.substring("id", 12, 1).cast("int") % 5), "language", F.substring("id", 11, 1))
    return vocabulary_hits(concepts(spark, d).select(word.alias("word")).distinct())


@query("J15_brand_join", f"WITH q AS (SELECT DISTINCT q FROM (SELECT 'Banco ' || n_name AS q FROM nation UNION ALL SELECT p_name FROM part UNION ALL SELECT unnest(string_split(p_name, ' ')) FROM part)), l AS (SELECT q, lower(trim(q)) AS w FROM q WHERE trim(q) <> '') SELECT DISTINCT q, fragment FROM (SELECT q, w, fragment FROM l JOIN (VALUES {_BRANDS}) t(brand, fragment) ON length(w) >= 3 AND (contains(brand, w) OR contains(w, brand)) UNION ALL SELECT q, w, 'bco ' || substr(w, 7) FROM l WHERE starts_with(w, 'banco ')) WHERE fragment <> w")
def j15(spark, d):
    names, parts = table(spark, d, "nation").select(F.concat(F.lit("Banco "), "n_name").alias("q")), table(spark, d, "part").select(F.col("p_name").alias("q"))
    return brand_fragments(names.unionAll(parts).unionAll(parts.select(F.explode(F.split("q", " ")).alias("q"))).distinct())


@query("F43_intent_terms", f"WITH {CONCEPT_SQL} SELECT id, 'x, ' || language AS terms FROM concept")
def f43(spark, d):
    """Replies in prose with a fenced object; of two entries of an id the last counts."""
    reply = F.concat(F.lit('ok ```json\n{"concepts":[{"id":"'), "id", F.lit('","intent_terms":"first"},{"id":"'), "id", F.lit('","intent_terms":" x, '), "language", F.lit(' "},{"id":""}]}\n``` end'))
    return intent_terms(concepts(spark, d).select(reply.alias("value")))


@query("J12_grounding_bodies", "WITH o AS (SELECT * FROM (VALUES (0, 2), (1, 999999), (2, 1)) t(ord, k)) SELECT ord, printf('doc/%08d.md', doc_id) AS id, left(split_part(text, chr(10), 1), 80) AS title, text AS body FROM o JOIN documents ON doc_id = k ORDER BY ord")
def j12(spark, d):
    order = spark.createDataFrame([(0, "doc/00000002.md"), (1, "doc/00999999.md"), (2, "doc/00000001.md")], "ord int, id string")
    return grounding_bodies(order, concepts(spark, d))


__all__ = ["cache_key", "redact"]
QUERIES, SQL = registry.queries, registry.sql

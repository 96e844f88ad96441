"""Structured queries: filters, predicates, ordering and projections over concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..adapters import CONCEPT_SQL, concepts
from ..plans.filterql import parse, predicate, query
from ..plans.registry import Registry

registry = Registry()
#: The columns of a full row; nulls read as empty text.
FULL = ("id", "type", "title", "description", "body", "language", "tags", "source_uri", "content_sha", "first_epoch", "last_epoch", "updated_at", "intent_terms", "domain")


def full_rows(df: DataFrame) -> DataFrame:
    return df.select(*[F.coalesce(c, F.lit("")).alias(c) if dict(df.dtypes)[c] == "string" else F.coalesce(c, F.array().cast("array<string>")).alias(c) if c == "tags" else F.col(c) for c in FULL])


def search_filter(df: DataFrame, types=(), include_types=(), tag: str = "", exclude=(), domains=(), where: str = "") -> DataFrame:
    """The filters of ranked search. Empty arguments put no predicate in the plan; types and include_types add up."""
    some = [*types, *include_types]
    if some:
        df = df.where(F.col("type").isin(*some))
    if tag:
        df = df.where(F.array_contains("tags", tag))
    if exclude:
        df = df.where(~F.col("id").isin(*exclude))
    if domains:
        df = df.where(F.col("domain").isin(*domains))
    return df.where(predicate(parse(where).where)) if where else df


def official(df: DataFrame) -> DataFrame:
    """With a flag for rows tagged as coming from an official source; null tags are not."""
    return df.withColumn("official", F.coalesce(F.array_contains("tags", "trusted:official"), F.lit(False)))


def _filter(name: str, text: str, sql: str, columns: str = "id, type, language, last_epoch") -> None:
    cols = [c.strip() for c in columns.split(",")]
    registry.add(name, lambda spark, d: query(concepts(spark, d), text).select(*cols), f"WITH {CONCEPT_SQL} SELECT {columns} FROM concept {sql}")


_filter("P01_lexer", "type = 'Reference' AND (title ~ \"th\" OR id ~ doc/0000001)", "WHERE type = 'Reference' AND (contains(lower(title), 'th') OR contains(id, 'doc/0000001'))")
_filter("P02_parser_precedence", "NOT language = en AND type = Reference or epoch > 8", "WHERE (NOT language = 'en' AND type = 'Reference') OR last_epoch > 8")
_filter("P03_field_resolution", "LANGUAGE = fr AND Epoch <= 3", "WHERE language = 'fr' AND last_epoch <= 3")
_filter("P04_and_or_not", "NOT (type = Reference OR type = LegalArticle) AND language = de", "WHERE NOT (type = 'Reference' OR type = 'LegalArticle') AND language = 'de'")
_filter("P05_equals", "language = en AND type != PacsMessage", "WHERE language = 'en' AND type <> 'PacsMessage'")
_filter("P06_contains", "text ~ 'ing THE' AND title !~ a", "WHERE contains(lower(body), 'ing the') AND NOT contains(lower(title), 'a')")
_filter("P07_in", "language IN (fr, es,) AND type NOT IN ('ApiEndpoint', Reference)", "WHERE language IN ('fr', 'es') AND type NOT IN ('ApiEndpoint', 'Reference')")
_filter("P08_is_empty", "intent_terms IS EMPTY AND title IS NOT EMPTY", "WHERE (intent_terms IS NULL OR intent_terms = '') AND NOT (title IS NULL OR title = '')")
_filter("P09_epoch_compare", "epoch >= 2 AND epoch < 7 AND epoch != 5", "WHERE last_epoch >= 2 AND last_epoch < 7 AND last_epoch <> 5")
_filter("P10_date_compare", "updated > 2024-01-10 AND updated <= '2024-01-25T12:00:00Z'", "WHERE updated_at > TIMESTAMPTZ '2024-01-10 00:00:00+00' AND updated_at <= TIMESTAMPTZ '2024-01-25 12:00:00+00'")
_filter("P11_tag_equals", "domain = en AND tag != 'source:src3'", "WHERE list_contains(tags, 'domain:en') AND NOT list_contains(tags, 'source:src3')")
_filter("P12_tag_in", "domain IN (fr, de) AND tag NOT IN ('source:src1', 'source:src2')", "WHERE list_has_any(tags, ['domain:fr', 'domain:de']) AND NOT list_has_any(tags, ['source:src1', 'source:src2'])")
_filter("P13_tag_is_empty", "tag IS NOT EMPTY AND epoch = 1", "WHERE NOT (tags IS NULL OR len(tags) = 0) AND last_epoch = 1")
_filter("P14_prefix_is_empty", "lei IS EMPTY AND domain IS NOT EMPTY AND epoch = 2", "WHERE len(list_filter(tags, lambda t: starts_with(t, 'lei:'))) = 0 AND len(list_filter(tags, lambda t: starts_with(t, 'domain:'))) > 0 AND last_epoch = 2")
_filter("P15_order_by", "type = LegalArticle ORDER BY language DESC, id LIMIT 25", "WHERE type = 'LegalArticle' ORDER BY language DESC, id LIMIT 25")
_filter("P16_limit", "ORDER BY id DESC LIMIT 7", "ORDER BY id DESC LIMIT 7")
_filter("P17_functions", "updated > endOfDay() AND updated > -7d AND epoch = 4", "WHERE last_epoch = 4")


@registry("P18_full_projection", f"WITH {CONCEPT_SQL} SELECT {', '.join(c for c in FULL if c != 'updated_at')}, epoch_ms(updated_at) AS updated_at FROM concept")
def p18(spark, d):
    return full_rows(concepts(spark, d)).withColumn("updated_at", F.unix_millis("updated_at"))


@registry("P20_structured_query", f"WITH {CONCEPT_SQL} SELECT id, type, title, language FROM concept WHERE type = 'ManualSection' AND list_contains(tags, 'domain:en') AND contains(lower(body), 'the') ORDER BY id LIMIT 20")
def p20(spark, d):
    return query(concepts(spark, d), "type = ManualSection AND domain = en AND text ~ 'the' ORDER BY id LIMIT 20").select("id", "type", "title", "language")


def _search(name: str, sql: str, **kw) -> None:
    registry.add(name, lambda spark, d: official(search_filter(concepts(spark, d), **kw)).select("id", "type", "domain", "official"), f"WITH {CONCEPT_SQL} SELECT id, type, domain, list_contains(tags, 'trusted:official') AS official FROM concept {sql}")


_search("P21_types", "WHERE type IN ('Reference', 'LegalArticle', 'ApiEndpoint')", types=["Reference"], include_types=["LegalArticle", "ApiEndpoint"])
_search("P22_tag", "WHERE list_contains(tags, 'source:src4')", tag="source:src4")
_search("P23_exclude_ids", "WHERE id NOT IN ('doc/00000001.md', 'doc/00000002.md')", exclude=["doc/00000001.md", "doc/00000002.md"])
_search("P24_domains", "WHERE domain IN ('fr', 'es')", domains=["fr", "es"])
_search("P24_no_domains", "", domains=[])
_search("P28_official_flag", "WHERE type = 'Reference'", types=["Reference"])

QUERIES, SQL = registry.queries, registry.sql

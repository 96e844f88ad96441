"""The engine's tables as views of TPC-H-like and corpus tables, in Spark and in SQL.

Each mapping is one projection, so predicates and column choices reach the
scan. The SQL strings are the same mappings as common table expressions, for
checking results with another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = ("ManualSection", "ApiEndpoint", "PacsMessage", "LegalArticle", "Reference")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    key = F.col("doc_id")
    text = F.coalesce("text", F.lit(""))
    kind = F.when(key % 5 == 0, TYPES[0]).when(key % 5 == 1, TYPES[1]).when(key % 5 == 2, TYPES[2]).when(key % 5 == 3, TYPES[3]).otherwise(TYPES[4])
    tags = F.concat(F.array(F.concat(F.lit("domain:"), "lang"), F.concat(F.lit("source:"), "source")), F.when(key % 7 == 0, F.array(F.lit("trusted:official"))).otherwise(F.array().cast("array<string>")))
    return d.select(
        F.format_string("doc/%08d.md", key).alias("id"), kind.alias("type"), F.substring(F.substring_index(text, "\n", 1), 1, 80).alias("title"), F.lit("").alias("description"), text.alias("body"), F.col("lang").alias("language"), tags.alias("tags"), F.col("source").alias("source_uri"),
        F.sha2(text, 256).alias("content_sha"), (key % 3).cast("int").alias("first_epoch"), (key % 10).cast("int").alias("last_epoch"), F.timestamp_seconds(F.lit(1704067200) + key * 3600).alias("updated_at"), F.when(key % 4 == 0, F.concat(F.lit("about "), "lang")).otherwise("").alias("intent_terms"), F.col("lang").alias("domain"),
    )


CONCEPT_SQL = """concept AS (
  SELECT printf('doc/%08d.md', doc_id) AS id,
    CASE doc_id % 5 WHEN 0 THEN 'ManualSection' WHEN 1 THEN 'ApiEndpoint' WHEN 2 THEN 'PacsMessage' WHEN 3 THEN 'LegalArticle' ELSE 'Reference' END AS type,
    left(split_part(coalesce(text, ''), chr(10), 1), 80) AS title, '' AS description, coalesce(text, '') AS body, lang AS language,
    list_concat(['domain:' || lang, 'source:' || source], CASE WHEN doc_id % 7 = 0 THEN ['trusted:official'] ELSE [] END) AS tags,
    source AS source_uri, sha256(coalesce(text, '')) AS content_sha, (doc_id % 3)::INTEGER AS first_epoch, (doc_id % 10)::INTEGER AS last_epoch,
    to_timestamp(1704067200 + doc_id * 3600) AS updated_at, CASE WHEN doc_id % 4 = 0 THEN 'about ' || lang ELSE '' END AS intent_terms, lang AS domain
  FROM documents)"""


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three epochs of each vector: the older ones are the vector turned round or negated."""
    e = table(spark, sf_dir, "embeddings").select(F.format_string("doc/%08d.md", "vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    epoch = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("epoch")
    return e.select("id", epoch, F.when(F.col("label") % 2 == 0, "hash-64").otherwise("hash-64b").alias("embed_model"), F.size("vec").alias("dim"), "vec", "label").select("id", "epoch", "embed_model", "dim", F.when(F.col("epoch") == 0, F.reverse("vec")).when(F.col("epoch") == 1, F.transform("vec", lambda x: -x)).otherwise(F.col("vec")).alias("vec"), "label")


EMBEDDING_SQL = """emb AS (
  SELECT printf('doc/%08d.md', vec_id) AS id, epoch, CASE WHEN label % 2 = 0 THEN 'hash-64' ELSE 'hash-64b' END AS embed_model, len(embedding)::INTEGER AS dim,
    CASE epoch WHEN 0 THEN list_reverse(embedding) WHEN 1 THEN list_transform(embedding, lambda x: -x) ELSE embedding END AS vec, label
  FROM embeddings, (SELECT unnest([0, 1, 2])::INTEGER AS epoch) t)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers point to nations, nations to regions; customers also cite a supplier."""
    t = lambda name: table(spark, sf_dir, name)
    link, tag = F.lit("link").alias("kind"), lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return (
        t("customer").select(tag("c", "c_custkey").alias("src"), tag("n", "c_nationkey").alias("dst"), link)
        .unionAll(t("supplier").select(tag("s", "s_suppkey").alias("src"), tag("n", "s_nationkey").alias("dst"), link))
        .unionAll(t("nation").select(tag("n", "n_nationkey").alias("src"), tag("r", "n_regionkey").alias("dst"), link))
        .unionAll(t("customer").select(tag("c", "c_custkey").alias("src"), F.concat(F.lit("s"), (F.col("c_custkey") % 50).cast("string")).alias("dst"), F.lit("cites").alias("kind")))
    )


EDGE_SQL = """edge AS (
  SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, 'link' AS kind FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'link' FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'link' FROM nation
  UNION ALL SELECT 'c' || c_custkey, 's' || (c_custkey % 50), 'cites' FROM customer)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, title, type) of the graph's vertices; parts are vertices without edges."""
    t = lambda name: table(spark, sf_dir, name)
    node = lambda name, p, key, title: t(name).select(F.concat(F.lit(p), F.col(key).cast("string")).alias("id"), F.col(title).alias("title"), F.lit(name).alias("type"))
    return node("customer", "c", "c_custkey", "c_name").unionAll(node("supplier", "s", "s_suppkey", "s_name")).unionAll(node("nation", "n", "n_nationkey", "n_name")).unionAll(node("region", "r", "r_regionkey", "r_name")).unionAll(node("part", "p", "p_partkey", "p_name"))


NODE_SQL = """node AS (
  SELECT 'c' || c_custkey AS id, c_name AS title, 'customer' AS type FROM customer
  UNION ALL SELECT 's' || s_suppkey, s_name, 'supplier' FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, n_name, 'nation' FROM nation
  UNION ALL SELECT 'r' || r_regionkey, r_name, 'region' FROM region
  UNION ALL SELECT 'p' || p_partkey, p_name, 'part' FROM part)"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unclosed versions from events: (id, epoch, type, content_sha, valid_from, version key)."""
    e = table(spark, sf_dir, "events")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("int")
    return e.select(F.format_string("user/%d.md", "user_id").alias("id"), day.alias("epoch"), F.col("event_type").alias("type"), F.sha2(F.concat_ws("|", "event_type", F.col("event_id").cast("string")), 256).alias("content_sha"), F.col("ts").alias("valid_from"), "event_id")


VERSION_SQL = """version AS (
  SELECT 'user/' || user_id || '.md' AS id, date_diff('day', DATE '2024-01-01', ts::DATE)::INTEGER AS epoch, event_type AS type,
    sha256(event_type || '|' || event_id) AS content_sha, ts AS valid_from, event_id
  FROM events),
fact AS (
  SELECT *, lead(valid_from) OVER (PARTITION BY id ORDER BY valid_from, event_id) AS valid_to,
    valid_from AS tx_from, lead(valid_from) OVER (PARTITION BY id ORDER BY valid_from, event_id) AS tx_to
  FROM version)"""


def series_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value of each event type and day, as text."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("series_code"), F.to_date("ts").alias("point_date")).agg(F.max_by(F.format_string("%.2f", "value"), F.struct("ts", "event_id")).alias("value"))


SERIES_SQL = """point AS (
  SELECT event_type AS series_code, ts::DATE AS point_date, printf('%.2f', arg_max(value, {'t': ts, 'e': event_id})) AS value FROM events GROUP BY ALL)"""

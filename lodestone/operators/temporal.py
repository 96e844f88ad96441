"""Bitemporal facts, epochs, snapshots and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..adapters import CONCEPT_SQL, EMBEDDING_SQL, SERIES_SQL, VERSION_SQL, concepts, embeddings, series_points, table, versions
from ..plans.registry import Registry
from .relational import close_versions, latest_per_key, snapshot_diff

registry = Registry()
query = registry
ORDER = ("epoch", "tx_from", "event_id")


def open_window(column: str = "tx_to") -> Column:
    """Whether a fact's window has no end; infinity is read as none when tables are loaded."""
    return F.col(column).isNull()


def _pick(facts: DataFrame) -> DataFrame:
    return latest_per_key(facts, "id", *[c for c in ORDER if c in facts.columns])


def as_of_epoch(facts: DataFrame, n: int, kind: str = "") -> DataFrame:
    """Of each id the fact of the greatest epoch up to n, whatever its transaction time; the type filter comes first."""
    rows = facts.where(F.col("epoch") <= n)
    return _pick(rows.where(F.col("type") == kind) if kind else rows)


def as_of_time(facts: DataFrame, at: Column, kind: str = "") -> DataFrame:
    """Of each id the open fact that was valid at a point of time."""
    rows = facts.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (at < F.col("valid_to"))) & open_window())
    return _pick(rows.where(F.col("type") == kind) if kind else rows)


def current(facts: DataFrame) -> DataFrame:
    return _pick(facts.where(open_window()))


def record_facts(facts: DataFrame, new: DataFrame, clock: Column) -> DataFrame:
    """``facts`` with each new version added open, and the open row of its id closed.

    ``new`` has one row an id: the facts' columns without the three ends. The
    old row's transaction time ends at ``clock``, its valid time at the new start.
    """
    starts = new.select("id", F.col("valid_from").alias("_next"))
    hit = F.col("_next").isNotNull() & F.col("tx_to").isNull()
    closed = facts.join(starts, "id", "left").withColumn("valid_to", F.when(hit, F.col("_next")).otherwise(F.col("valid_to"))).withColumn("tx_to", F.when(hit, clock).otherwise(F.col("tx_to"))).drop("_next")
    none = lambda c: F.lit(None).cast(dict(facts.dtypes)[c]).alias(c)
    return closed.select(facts.columns).unionByName(new.select("*", none("valid_to"), clock.alias("tx_from"), none("tx_to")).select(facts.columns))


def epoch_diff(facts: DataFrame, n: int, m: int) -> DataFrame:
    """(id, change) from epoch n to m; for n <= m nothing is ever removed, as closing a fact leaves its epoch."""
    return snapshot_diff(as_of_epoch(facts, n), as_of_epoch(facts, m))


# -- merges ----------------------------------------------------------------


def merge(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, Column] | None = None) -> DataFrame:
    """``old`` with ``new`` merged in on ``keys``; without a rule, a column is the new row's where there is one.

    Rules are expressions over struct columns ``o`` and ``n`` (null where the
    side has no row). Both sides have one row a key.
    """
    value = [c for c in old.columns if c not in keys]
    o, n = old.select(*keys, F.struct(*value).alias("o")), new.select(*keys, F.struct(*value).alias("n"))
    columns = [(rules or {}).get(c, F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))).alias(c) for c in value]
    return o.join(n, keys, "full_outer").select(*keys, *columns).select(old.columns)


def _filled(new: DataFrame) -> DataFrame:
    """Rows to be merged: '' as domain reads as pix, '' as norm_ref as null."""
    if "domain" in new.columns:
        new = new.withColumn("domain", F.when(F.coalesce("domain", F.lit("")) == "", "pix").otherwise(F.col("domain")))
    if "norm_ref" in new.columns:
        new = new.withColumn("norm_ref", F.when(F.col("norm_ref") != "", F.col("norm_ref")))
    return new


def upsert_concepts(old: DataFrame, new: DataFrame) -> DataFrame:
    """First and last epoch widen, the rest is overwritten; '' as domain reads as pix, '' as norm_ref as null."""
    rules = {"first_epoch": F.least("o.first_epoch", "n.first_epoch"), "last_epoch": F.greatest("o.last_epoch", "n.last_epoch")}
    return merge(old, _filled(new), ["id"], rules)


def replace_concepts(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of ``upsert_concepts`` that are in ``new``: of the old ones only the epochs are read."""
    epochs = old.select("id", F.col("first_epoch").alias("_first"), F.col("last_epoch").alias("_last"))
    rows = _filled(new).join(epochs, "id", "left")
    return rows.withColumns({"first_epoch": F.least("_first", "first_epoch"), "last_epoch": F.greatest("_last", "last_epoch")}).select(old.columns)


def upsert_latest(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """The union, new rows in place of old ones with their keys."""
    return merge(old, new, list(keys))


def upsert_secondary(old: DataFrame, new: DataFrame) -> DataFrame:
    """Participants from the secondary source: the name changes only while the canonical one was never read."""
    name = F.when(F.col("n").isNull() | F.col("o.canonical_synced").isNotNull(), F.col("o.name")).otherwise(F.col("n.name"))
    return merge(old, new, ["ispb"], {"name": F.coalesce(name, F.col("n.name")), "canonical_synced": F.col("o.canonical_synced")})


def truncated(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The five derived tables emptied; participants and series stay."""
    return {k: v.limit(0) if k in ("concept", "embedding", "edge", "fact", "epoch") else v for k, v in tables.items()}


def stamp_commit(epochs: DataFrame, n: int, commit: str) -> DataFrame:
    return epochs.withColumn("commit", F.when(F.col("n") == n, F.lit(commit)).otherwise(F.col("commit")))


def backfill_domain(df: DataFrame) -> DataFrame:
    """Domain from the first domain: tag where there is one."""
    tag = F.get(F.filter("tags", lambda t: t.startswith("domain:")), F.lit(0))
    return df.withColumn("domain", F.coalesce(F.substring(tag, len("domain:") + 1, 1000), "domain"))


def facts(spark, d) -> DataFrame:
    return close_versions(versions(spark, d), "valid_from", "event_id")


# -- queries ---------------------------------------------------------------
_PICK = "arg_max(event_id, {'e': epoch, 't': tx_from, 'k': event_id})"


@query("T01_record_fact", f"""WITH {VERSION_SQL}, n AS (SELECT id, max(epoch) + 1 AS epoch FROM version WHERE epoch <= 28 GROUP BY id)
SELECT f.id, f.epoch, (f.tx_to IS NULL AND n.id IS NULL) AS open FROM fact f LEFT JOIN n ON f.id = n.id AND f.tx_to IS NULL UNION ALL SELECT id, epoch, true FROM n""")
def t01(spark, d):
    f = facts(spark, d).select("id", "epoch", "type", "content_sha", "valid_from", "valid_to", "tx_from", "tx_to")
    clock = F.lit("2024-02-01").cast("timestamp_ntz")
    new = versions(spark, d).where("epoch <= 28").groupBy("id").agg((F.max("epoch") + 1).alias("epoch")).select("id", "epoch", F.lit("view").alias("type"), F.lit("new").alias("content_sha"), clock.alias("valid_from"))
    return record_facts(f, new, clock).select("id", "epoch", open_window().alias("open"))


@query("T02_asof_epoch", f"WITH {VERSION_SQL} SELECT id, {_PICK} AS event_id FROM fact WHERE epoch <= 12 GROUP BY id")
def t02(spark, d):
    return as_of_epoch(facts(spark, d), 12).select("id", "event_id")


@query("T03_asof_time", f"WITH {VERSION_SQL} SELECT id, {_PICK} AS event_id FROM fact WHERE valid_from <= TIMESTAMP '2024-01-29' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-29') AND tx_to IS NULL GROUP BY id")
def t03(spark, d):
    return as_of_time(facts(spark, d), F.lit("2024-01-29").cast("timestamp_ntz")).select("id", "event_id")


@query("T04_current", f"WITH {VERSION_SQL} SELECT id, {_PICK} AS event_id, arg_max(type, {{'e': epoch, 't': tx_from, 'k': event_id}}) AS type FROM fact WHERE tx_to IS NULL GROUP BY id")
def t04(spark, d):
    return current(facts(spark, d)).select("id", "event_id", "type")


@query("T05_filter_before_pick", f"WITH {VERSION_SQL} SELECT id, {_PICK} AS event_id FROM fact WHERE epoch <= 12 AND type = 'purchase' GROUP BY id")
def t05(spark, d):
    return as_of_epoch(facts(spark, d), 12, "purchase").select("id", "event_id")


@query("T06_open_window", f"WITH {VERSION_SQL} SELECT type, count(*) FILTER (tx_to IS NULL) AS open, count(*) AS n FROM fact GROUP BY type")
def t06(spark, d):
    return facts(spark, d).groupBy("type").agg(F.count_if(open_window()).alias("open"), F.count("*").alias("n"))


@query("T07_epoch_diff", f"""WITH {VERSION_SQL}, a AS (SELECT id, arg_max(content_sha, {{'e': epoch, 't': tx_from, 'k': event_id}}) AS s FROM fact WHERE epoch <= 0 GROUP BY id), b AS (SELECT id, arg_max(content_sha, {{'e': epoch, 't': tx_from, 'k': event_id}}) AS s FROM fact WHERE epoch <= 20 GROUP BY id)
SELECT id, CASE WHEN a.s IS NULL THEN 'added' WHEN b.s IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (id) WHERE a.s IS DISTINCT FROM b.s""")
def t07(spark, d):
    return epoch_diff(facts(spark, d), 0, 20)


@query("T08_current_shas", f"WITH {CONCEPT_SQL} SELECT id, content_sha FROM concept")
def t08(spark, d):
    return concepts(spark, d).select("id", "content_sha")


@query("T09_epoch_ledger", "SELECT date_diff('day', DATE '2024-01-01', ts::DATE)::INTEGER AS n, count(*) AS changes FROM events GROUP BY n")
def t09(spark, d):
    return versions(spark, d).groupBy(F.col("epoch").alias("n")).agg(F.count("*").alias("changes"))


@query("T13_prune_embeddings", f"WITH {EMBEDDING_SQL} SELECT id, max(epoch) AS epoch, count(*) - 1 AS pruned FROM emb GROUP BY id")
def t13(spark, d):
    return embeddings(spark, d).groupBy("id").agg(F.max("epoch").alias("epoch"), (F.count("*") - 1).alias("pruned"))


@query("T14_series_range", f"WITH {SERIES_SQL} SELECT series_code, point_date, value FROM point WHERE series_code = 'purchase' AND point_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-12' ORDER BY point_date")
def t14(spark, d):
    return series_points(spark, d).where("series_code = 'purchase' and point_date between date'2024-01-05' and date'2024-01-12'").orderBy("point_date")


@query("T15_latest_series_point", f"WITH {SERIES_SQL} SELECT max(point_date) AS point_date, arg_max(value, point_date) AS value FROM point WHERE series_code = 'view'")
def t15(spark, d):
    return series_points(spark, d).where("series_code = 'view'").agg(F.max("point_date").alias("point_date"), F.max_by("value", "point_date").alias("value"))


@query("M01_concept_upsert", f"""WITH {CONCEPT_SQL}, o AS (SELECT * FROM concept WHERE last_epoch < 7), n AS (SELECT id, 'New ' || title AS title, 1 AS f, 9 AS l, CASE WHEN domain = 'fr' THEN 'pix' ELSE domain END AS domain FROM concept WHERE last_epoch > 4)
SELECT coalesce(o.id, n.id) AS id, coalesce(n.title, o.title) AS title, least(o.first_epoch, n.f) AS first_epoch, greatest(o.last_epoch, n.l) AS last_epoch, coalesce(n.domain, o.domain) AS domain FROM o FULL JOIN n ON o.id = n.id""")
def m01(spark, d):
    c = concepts(spark, d).select("id", "title", "first_epoch", "last_epoch", "domain")
    new = c.where("last_epoch > 4").select("id", F.concat(F.lit("New "), "title").alias("title"), F.lit(1).alias("first_epoch"), F.lit(9).alias("last_epoch"), F.when(F.col("domain") == "fr", "").otherwise(F.col("domain")).alias("domain"))
    return upsert_concepts(c.where("last_epoch < 7"), new)


@query("M02_embedding_upsert", f"WITH {EMBEDDING_SQL} SELECT id, epoch, CASE WHEN epoch = 2 THEN 'new' ELSE embed_model END AS embed_model FROM emb WHERE epoch > 0")
def m02(spark, d):
    e = embeddings(spark, d).select("id", "epoch", "embed_model")
    return upsert_latest(e.where("epoch > 0"), e.where("epoch = 2").withColumn("embed_model", F.lit("new")), "id", "epoch")


def _participants(spark, d):
    key = lambda c: F.lpad(F.col(c).cast("string"), 8, "0").alias("ispb")
    at = F.lit("2024-01-01").cast("timestamp_ntz")
    str_ = table(spark, d, "supplier").select(key("s_suppkey"), F.col("s_name").alias("name"), at.alias("canonical_synced"))
    pix = table(spark, d, "customer").select(key("c_custkey"), F.col("c_name").alias("name"), F.lit(None).cast("timestamp_ntz").alias("canonical_synced"))
    return str_, pix


@query("M03_canonical_upsert", "SELECT lpad(coalesce(s_suppkey, c_custkey)::VARCHAR, 8, '0') AS ispb, coalesce(s_name, c_name) AS name, s_suppkey IS NOT NULL AS canonical FROM supplier FULL JOIN customer ON s_suppkey = c_custkey")
def m03(spark, d):
    str_, pix = _participants(spark, d)
    return merge(pix, str_, ["ispb"]).select("ispb", "name", F.col("canonical_synced").isNotNull().alias("canonical"))


@query("M04_secondary_upsert", "SELECT lpad(coalesce(s_suppkey, c_custkey)::VARCHAR, 8, '0') AS ispb, CASE WHEN c_custkey IS NULL OR s_nationkey < 12 THEN s_name ELSE c_name END AS name, coalesce(s_nationkey < 12, false) AS canonical FROM supplier FULL JOIN customer ON s_suppkey = c_custkey")
def m04(spark, d):
    """Participants of some nations have been read from the canonical source; the others take the secondary's name."""
    str_, pix = _participants(spark, d)
    read = table(spark, d, "supplier").where("s_nationkey < 12").select(F.lpad(F.col("s_suppkey").cast("string"), 8, "0").alias("ispb"), F.lit(True).alias("read"))
    str_ = str_.join(read, "ispb", "left").withColumn("canonical_synced", F.when(F.col("read"), F.col("canonical_synced"))).drop("read")
    return upsert_secondary(str_, pix).select("ispb", "name", F.col("canonical_synced").isNotNull().alias("canonical"))


@query("M05_series_upsert", f"WITH {SERIES_SQL} SELECT series_code, point_date, CASE WHEN point_date >= DATE '2024-01-20' THEN '0.00' ELSE value END AS value FROM point")
def m05(spark, d):
    p = series_points(spark, d)
    return upsert_latest(p, p.where("point_date >= date'2024-01-20'").withColumn("value", F.lit("0.00")), "series_code", "point_date")


@query("M06_truncate", "SELECT 0::BIGINT AS concepts, count(*) AS participants FROM supplier")
def m06(spark, d):
    left = truncated({"concept": concepts(spark, d).select("id"), "participant": table(spark, d, "supplier").select("s_suppkey")})
    return left["concept"].agg(F.count("*").alias("concepts")).join(left["participant"].agg(F.count("*").alias("participants")))


@query("M07_stamp_commit", "SELECT n, CASE WHEN n = 3 THEN 'abc123' ELSE '' END AS commit FROM (SELECT DISTINCT date_diff('day', DATE '2024-01-01', ts::DATE)::INTEGER AS n FROM events)")
def m07(spark, d):
    return stamp_commit(versions(spark, d).select(F.col("epoch").alias("n")).distinct().withColumn("commit", F.lit("")), 3, "abc123")


@query("M08_domain_backfill", f"WITH {CONCEPT_SQL} SELECT id, domain FROM concept")
def m08(spark, d):
    return backfill_domain(concepts(spark, d).withColumn("domain", F.lit("pix"))).select("id", "domain")


@query("M09_delete", f"WITH {CONCEPT_SQL} SELECT id FROM concept WHERE id NOT IN ('doc/00000003.md', 'doc/00000005.md')")
def m09(spark, d):
    return concepts(spark, d).select("id").where(~F.col("id").isin("doc/00000003.md", "doc/00000005.md"))


def known_at_epoch(rows: DataFrame, facts: DataFrame, n: int) -> DataFrame:
    """Rows whose id had any fact up to epoch n: membership, not a return to old contents."""
    return rows.join(facts.where(F.col("epoch") <= n).select("id"), "id", "left_semi")


def known_at_time(rows: DataFrame, facts: DataFrame, at: Column) -> DataFrame:
    """Rows whose id has an open fact that was valid at a point of time."""
    return rows.join(as_of_time(facts, at).select("id"), "id", "left_semi")


@query("P26_asof_epoch_filter", f"WITH {VERSION_SQL} SELECT id, count(*) AS n FROM version WHERE id IN (SELECT id FROM version WHERE epoch <= 0) GROUP BY id")
def p26(spark, d):
    rows = versions(spark, d).groupBy("id").agg(F.count("*").alias("n"))
    return known_at_epoch(rows, facts(spark, d), 0)


@query("P27_asof_time_filter", f"WITH {VERSION_SQL} SELECT id, count(*) AS n FROM version WHERE id IN (SELECT id FROM fact WHERE valid_from <= TIMESTAMP '2024-01-29' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-29') AND tx_to IS NULL) GROUP BY id")
def p27(spark, d):
    rows = versions(spark, d).groupBy("id").agg(F.count("*").alias("n"))
    return known_at_time(rows, facts(spark, d), F.lit("2024-01-29").cast("timestamp_ntz"))

QUERIES, SQL = registry.queries, registry.sql

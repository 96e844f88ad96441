"""Not-modified revisit resolution: an as-of join to the latest earlier full response.

Records of one canonical URL are cut at common points of time, so that a URL
with a third of all records is spread over many groups. Inside a group a window
finds the latest earlier response; the last response of each group is carried on
to the URL's later groups. The response's validators are then held against the
revisit's, and the revisit's permitted headers replace the stored ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .session import cut, read

#: Points of time at which the records are cut (quantiles, found within a thousandth of the rows).
TIME_CUTS = 255
#: Query parameters that do not name a resource.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"
#: Headers that a 304 answer may bring up to date; all others stay as stored.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """Host lower-cased; without scheme, leading www. or m., fragment, tracking parameters, and a trailing slash. Paths and queries keep their case."""
    out = F.regexp_replace(F.trim(url), "#.*$", "")
    out = F.regexp_replace(out, "^(?i)https?://(www\\.|m\\.)?", "")
    host = F.regexp_extract(out, "^[^/?]*", 0)
    out = F.concat(F.lower(host), F.substr(out, F.length(host) + 1))
    out = F.regexp_replace(out, f"([?&])(({TRACKING})=[^&]*&?)+", "$1")
    return F.regexp_replace(F.regexp_replace(out, "[?&]+$", ""), "/$", "")


def resolve_revisits(records: DataFrame, time_cuts: int = TIME_CUTS) -> DataFrame:
    """One row for each revisit of ``records``.

    Records have record_id, url, ts (long), kind ('response' or 'revisit'),
    http_status, etag, last_modified, headers (map of lower-case names) and
    payload_digest. A full response is a response with status 200. Earlier is
    a smaller ts; of equal ts the larger record_id is later. Results have
    record_id, canonical_url, ts, status, source_id, source_ts,
    payload_digest and merged_headers. status is 'resolved', 'unverified' (no
    validator on the revisit), 'mismatch' (the latest earlier response has
    other validators) or 'no-response'; only the first two carry digest and
    headers. An etag is compared weakly and outweighs last_modified. Revisits
    without url or ts are 'no-response'; repeated revisits give repeated
    results; empty tables give an empty result. Other columns are not read.
    """
    full = (F.col("kind") == "response") & (F.col("http_status") == 200) & F.col("ts").isNotNull() & F.col("url").isNotNull()
    rows = records.select("record_id", canonical_url(F.col("url")).alias("canonical_url"), "url", F.col("ts").cast("long").alias("ts"), "kind", "http_status", "etag", "last_modified", "headers", "payload_digest").where(full | (F.col("kind") == "revisit"))
    stored = F.when(full, F.struct("ts", F.col("record_id").alias("id"), "etag", "last_modified", "headers", "payload_digest"))
    rows = cut(rows.withColumn("stored", stored).drop("url", "http_status"))
    cuts = sorted(set(rows.where("ts is not null").approxQuantile("ts", [k / (time_cuts + 1) for k in range(1, time_cuts + 1)], 0.001))) or [0.0]
    # a binary search over the cuts, as nested conditions
    def place(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("ts") < F.lit(int(cuts[mid])), place(lo, mid)).otherwise(place(mid + 1, hi))

    rows = rows.withColumn("block", place(0, len(cuts)))
    inside = Window.partitionBy("canonical_url", "block").orderBy("ts", F.col("stored").isNotNull(), "record_id").rowsBetween(Window.unboundedPreceding, 0)
    near = rows.withColumn("near", F.last("stored", ignorenulls=True).over(inside)).where("kind = 'revisit'").drop("stored")
    ends = rows.where("stored is not null").groupBy("canonical_url", "block").agg(F.max_by("stored", F.struct("ts", "record_id")).alias("last"))
    asked = near.where("near is null and ts is not null and canonical_url is not null").select("canonical_url", "block").distinct().withColumn("last", F.lit(None).cast(ends.schema["last"].dataType))
    steps = Window.partitionBy("canonical_url").orderBy("block", F.col("last").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)  # at most two rows for each cut
    carried = ends.unionByName(asked).withColumn("far", F.last("last", ignorenulls=True).over(steps)).where("last is null").select("canonical_url", "block", "far")
    found = near.join(carried, ["canonical_url", "block"], "left").withColumn("source", F.coalesce("near", "far"))
    bare = lambda c: F.regexp_replace(c, "^W/", "")
    fits = F.when(F.col("etag").isNotNull(), F.coalesce(bare(F.col("etag")) == bare(F.col("source.etag")), F.lit(False))).when(F.col("last_modified").isNotNull(), F.coalesce(F.col("last_modified") == F.col("source.last_modified"), F.lit(False)))
    status = F.when(F.col("source").isNull(), "no-response").when(fits.isNull(), "unverified").when(fits, "resolved").otherwise("mismatch")
    found = found.withColumn("status", status)
    good = F.col("status").isin("resolved", "unverified")
    none = F.create_map().cast("map<string,string>")
    new = F.map_filter(F.coalesce("headers", none), lambda k, _: k.isin(*PERMITTED))
    old = F.map_filter(F.coalesce("source.headers", none), lambda k, _: ~F.coalesce(F.array_contains(F.map_keys(new), k), F.lit(False)))
    return found.select("record_id", "canonical_url", "ts", "status", F.col("source.id").alias("source_id"), F.col("source.ts").alias("source_ts"), F.when(good, F.col("source.payload_digest")).alias("payload_digest"), F.when(good, F.map_concat(old, new)).alias("merged_headers"))


def page_records(pages: DataFrame) -> DataFrame:
    """Capture records made from ``pages``: a full response of each page, and a revisit of three in four.

    Times, validators and headers follow from page_id alone, so that some
    revisits come too early, carry stale or weak etags, or only a date.
    """
    p = pages.select("page_id", "url", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"), F.length(F.coalesce("html", F.lit(""))).alias("size"))
    tag, text = F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"')), lambda c: c.cast("string")
    page = F.col("page_id")
    modified = F.concat(F.lit("day "), text(page % 1000))
    response = p.select(page.alias("record_id"), "url", (page * 10).alias("ts"), F.lit("response").alias("kind"), F.lit(200).alias("http_status"), tag.alias("etag"), modified.alias("last_modified"), F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("etag"), tag, F.lit("content-length"), text(F.col("size")), F.lit("cache-control"), F.lit("max-age=60")).alias("headers"), F.col("digest").alias("payload_digest"))
    sent = F.when(page % 3 == 0, F.lit(None)).when(page % 7 == 0, F.lit('"stale"')).when(page % 5 == 0, F.concat(F.lit("W/"), tag)).otherwise(tag)
    later = page * 10 + 5 + page % 13 * 7 - F.when(page % 11 == 0, 200).otherwise(0)
    revisit = p.where(page % 4 != 0).select(page.alias("record_id"), "url", later.alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("http_status"), sent.alias("etag"), F.when(page % 3 == 0, F.when(page % 2 == 0, modified)).alias("last_modified"), F.create_map(F.lit("cache-control"), F.concat(F.lit("max-age="), text(page % 600)), F.lit("date"), text(later), F.lit("content-length"), F.lit("0"), F.lit("connection"), F.lit("close")).alias("headers"), F.lit(None).cast("string").alias("payload_digest"))
    return response.unionByName(revisit)


def op4_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(page_records(read(spark, sf_dir, "pages", "page_id", "url", "html")))
    lines = F.array_join(F.transform(F.array_sort(F.map_entries("merged_headers")), lambda e: F.concat(e.key, F.lit(": "), e.value)), "\n")
    return found.select(F.col("record_id").alias("page_id"), "canonical_url", "ts", "status", F.col("source_id").alias("source_page_id"), "source_ts", "payload_digest", lines.alias("merged_headers"))


QUERIES = {"op4_revisit": op4_revisit}
SQL = {
    "op4_revisit": f"""
WITH p AS (
  SELECT page_id, sha1(coalesce(html, '')) AS digest, length(coalesce(html, '')) AS size,
    regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')) || substr(bare, length(regexp_extract(bare, '^[^/?]*')) + 1),
      '([?&])(({TRACKING})=[^&]*&?)+', '\\1', 'g'), '[?&]+$', ''), '/$', '') AS canonical_url
  FROM (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^(?i)https?://(www\\.|m\\.)?', '') AS bare FROM pages)),
r AS (
  SELECT page_id, canonical_url, page_id * 10 AS ts, 1 AS is_full, '"' || substr(digest, 1, 16) || '"' AS etag,
    'day ' || (page_id % 1000) AS last_modified, digest, size
  FROM p
  UNION ALL
  SELECT page_id, canonical_url,
    page_id * 10 + 5 + page_id % 13 * 7 - CASE WHEN page_id % 11 = 0 THEN 200 ELSE 0 END, 0,
    CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 7 = 0 THEN '"stale"'
      WHEN page_id % 5 = 0 THEN 'W/"' || substr(digest, 1, 16) || '"' ELSE '"' || substr(digest, 1, 16) || '"' END,
    CASE WHEN page_id % 3 = 0 AND page_id % 2 = 0 THEN 'day ' || (page_id % 1000) END, NULL, NULL
  FROM p WHERE page_id % 4 <> 0),
w AS (
  SELECT *, max(CASE WHEN is_full = 1 THEN {{'ts': ts, 'id': page_id, 'etag': etag, 'lm': last_modified, 'digest': digest, 'size': size}} END)
    OVER (PARTITION BY canonical_url ORDER BY ts, is_full, page_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS src
  FROM r),
j AS (
  SELECT page_id, canonical_url, ts, src,
    CASE WHEN src IS NULL THEN 'no-response' WHEN etag IS NULL AND last_modified IS NULL THEN 'unverified'
      WHEN etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = src.etag THEN 'resolved' ELSE 'mismatch' END
      WHEN last_modified = src.lm THEN 'resolved' ELSE 'mismatch' END AS status
  FROM w WHERE is_full = 0)
SELECT page_id, canonical_url, ts, status, src.id AS source_page_id, src.ts AS source_ts,
  CASE WHEN status IN ('resolved', 'unverified') THEN src.digest END AS payload_digest,
  CASE WHEN status IN ('resolved', 'unverified') THEN 'cache-control: max-age=' || (page_id % 600) || chr(10) || 'content-length: ' || src.size
    || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10) || 'etag: ' || src.etag END AS merged_headers
FROM j""",
}

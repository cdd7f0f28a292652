"""Resolution of not-modified revisits: an as-of join by canonical URL to the latest earlier full response.

The join is declarative and bounded for hot URLs: records are cut into time slices, each (URL, slice) is
reduced to its latest response, a window over a URL's slices carries responses on, and the as-of lookup itself
is a window within (URL, slice) that falls back to what was carried. A window holds the records of a URL within one
slice (a day, unless the caller takes shorter ones).

A revisit is valid if its ETag weakly equals the response's, or, without an ETag, its Last-Modified does. The merged
headers are the response's, replaced by those of the revisit that a 304 may update (`PERMITTED`). Field names are
compared without case, and keep the spelling of the record that they come from.

Defined results: a record without a URL, or with an empty one, resolves to nothing and no revisit resolves to it; records without a
time count as earlier than all others; records of another kind are ignored; of records with equal times those with smaller ids come first; a
revisit without an earlier response is kept with nulls; null headers count as no headers; repeated rows give a row each; null
validators never match; an empty table gives an empty result; columns beside the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Header fields that a 304 response may update (RFC 9110, section 15.4.5, with RFC 9111, section 3.2).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
SLICE_SECONDS = 86_400


def canonical_url(url: Column) -> Column:
    """Host in lower case without www and default port, no scheme, fragment, tracking parameters or trailing slash, the query's parameters sorted; null without a URL."""
    rest = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^[^/?]*", 0)), "^www[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "^$", "/"), "(.)/$", "$1")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(rest, "[?](.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|ref)=")))
    return F.when(F.coalesce(url, F.lit("")) != "", F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise("")))


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve(records: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Of each revisit of records (record_id long, url, ts long, kind 'response' or 'revisit', etag, last_modified, headers map):
    record_id, url (canonical), target_id, target_ts, valid, headers (merged)."""
    headers = F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers")
    rows = records.where(F.col("kind").isin("response", "revisit")).select(F.col("record_id").cast("long").alias("record_id"), canonical_url(F.col("url")).alias("url"), F.col("ts").cast("long").alias("ts"), (F.col("kind") == "response").alias("full"), "etag", "last_modified", headers)
    lost = rows.where(F.col("url").isNull() & ~F.col("full"))
    rows = rows.where("url is not null").withColumn("slice", F.floor(F.col("ts") / slice_seconds))
    as_target = F.when(F.col("full"), F.struct("ts", "record_id", "etag", "last_modified", "headers"))
    order = F.struct("ts", "record_id")
    latest = rows.groupBy("url", "slice").agg(F.max_by(as_target, F.when(F.col("full"), order)).alias("latest"))
    carried = latest.select("url", "slice", F.last("latest", ignorenulls=True).over(Window.partitionBy("url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    within = Window.partitionBy("url", "slice").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("own", F.last(as_target, ignorenulls=True).over(within)).where(~F.col("full"))
    joined = seen.join(carried, (seen["url"] == carried["url"]) & (seen["slice"].eqNullSafe(carried["slice"])), "left").select(seen["record_id"], seen["url"], seen["etag"], seen["last_modified"], seen["headers"], F.coalesce("own", "carried").alias("target"))
    joined = joined.union(lost.select("record_id", "url", "etag", "last_modified", "headers", F.lit(None).cast(joined.schema["target"].dataType)))
    valid = F.coalesce(F.when(F.col("etag").isNotNull(), _weak(F.col("etag")) == _weak(F.col("target.etag"))).otherwise(F.col("last_modified") == F.col("target.last_modified")), F.lit(False))
    permitted = F.map_filter("headers", lambda k, _: F.lower(k).isin(*PERMITTED))
    updated = F.transform(F.map_keys(permitted), F.lower)
    merged = F.map_concat(F.map_filter("target.headers", lambda k, _: ~F.array_contains(updated, F.lower(k))), permitted)
    return joined.select("record_id", "url", F.col("target.record_id").alias("target_id"), F.col("target.ts").alias("target_ts"), valid.alias("valid"), F.when(valid, merged).alias("headers"))


def page_records(pages: DataFrame) -> DataFrame:
    """Crawl records of pages: each page's full response, a minute apart, and two days on a revisit that found it not modified (without headers for every third page)."""
    etag = F.concat(F.lit('"'), F.md5(F.coalesce(F.col("html"), F.lit(""))), F.lit('"'))
    shared = pages.select("page_id", "url", etag.alias("etag"), F.length(F.coalesce(F.col("html"), F.lit(""))).cast("string").alias("length"))
    headers = F.create_map(F.lit("Content-Length"), F.col("length"), F.lit("Date"), (F.col("page_id") * 60).cast("string"), F.lit("ETag"), F.col("etag"))
    response = shared.select((F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 60).alias("ts"), F.lit("response").alias("kind"), "etag", F.lit(None).cast("string").alias("last_modified"), headers.alias("headers"))
    headers = F.when(F.col("page_id") % 3 > 0, F.create_map(F.lit("date"), (F.col("page_id") * 60 + 172_800).cast("string"), F.lit("server"), F.lit("cache")))
    revisit = shared.select((F.col("page_id") * 2 + 1).alias("record_id"), "url", (F.col("page_id") * 60 + 172_800).alias("ts"), F.lit("revisit").alias("kind"), F.concat(F.lit("W/"), F.col("etag")).alias("etag"), F.lit(None).cast("string").alias("last_modified"), headers.alias("headers"))
    return response.union(revisit)


def op8_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve(page_records(table(spark, sf_dir, "pages")))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return found.select("record_id", "url", "target_id", "target_ts", "valid", shown.alias("headers"))


SQL = r"""
WITH parts AS (
  SELECT page_id, html, coalesce(url, '') = '' AS empty, regexp_replace(regexp_replace(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS rest FROM pages
), pieces AS (
  SELECT page_id, html, empty,
    regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*', 0)), '^www[.]', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '^$', '/'), '(.)/$', '\1') AS path,
    list_sort(list_filter(string_split(regexp_extract(rest, '[?](.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref)='))) AS query
  FROM parts
), p AS (
  SELECT page_id, CASE WHEN empty THEN NULL ELSE host || path || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END END AS url,
    '"' || md5(coalesce(html, '')) || '"' AS etag, CAST(length(coalesce(html, '')) AS VARCHAR) AS length
  FROM pieces
), records AS (
  SELECT page_id, page_id * 2 AS record_id, url, page_id * 60 AS ts, TRUE AS is_full, etag, length FROM p
  UNION ALL SELECT page_id, page_id * 2 + 1, url, page_id * 60 + 172800, FALSE, etag, length FROM p
), seen AS (
  SELECT *, last_value(CASE WHEN is_full AND url IS NOT NULL THEN {'ts': ts, 'id': record_id, 'etag': etag, 'length': length} END IGNORE NULLS)
    OVER (PARTITION BY url ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS target
  FROM records
)
SELECT record_id, url, target.id AS target_id, target.ts AS target_ts, coalesce(etag = target.etag, FALSE) AS valid,
  CASE WHEN etag <> target.etag THEN NULL
    WHEN page_id % 3 > 0 THEN 'Content-Length=' || target.length || ';ETag=' || target.etag || ';date=' || ts
    ELSE 'Content-Length=' || target.length || ';Date=' || target.ts || ';ETag=' || target.etag END AS headers
FROM seen WHERE NOT is_full
"""

"""Not-modified revisits resolved to the response that they stand for.

A revisit record (304) has no payload. It is resolved by an as-of join on the
canonical URL: the latest full response captured strictly earlier. Its
validators are then checked (entity tag by weak comparison, else the
last-modified date), and the response's headers are merged with those of the
revisit that a 304 may update.

The join sorts all records by (URL, time): range partitions split a URL with
very many captures, a window looks inside a partition only, and what a URL
carries over from earlier partitions is one row for each partition it spans.
Only keys, times, validators and headers move, never payloads.

Defined results: a revisit without URL or time, or without an earlier full
response, is ``no_response``; responses captured at the revisit's own time are
not earlier; of responses at one time the greatest record id counts; repeated
rows give a row each; null headers are empty; an empty table gives an empty
result; extra columns of the records are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumen.llm.common import materialise, read

# fixed values: headers that a 304 response may update
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that do not name a document.
TRACKING = "^(utm_[a-z]+|fbclid|gclid|ref)="

_PARTS = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)([^?]*)[?]?(.*)$"


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, user, www, default port, index page, last slash, fragment and tracking; parameters sorted."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    part = lambda i: F.regexp_extract(u, _PARTS, i)
    host = F.regexp_replace(F.regexp_replace(F.lower(part(1)), "^[^@]*@", ""), ":(80|443)$", "")
    host = F.regexp_replace(host, r"^www[0-9]*\.", "")
    path = F.regexp_replace(F.regexp_replace(part(2), r"/index\.(html?|php)$", "/"), "/+$", "")
    params = F.array_join(F.filter(F.array_sort(F.split(part(3), "&")), lambda p: (p != "") & ~p.rlike(TRACKING)), "&")
    return F.when(u.rlike(_PARTS), F.concat(host, path, F.when(params != "", F.concat(F.lit("?"), params)).otherwise(""))) \
        .otherwise(F.lower(u))


def _lower(headers: Column) -> Column:
    """Headers with lower-case names; the last of equal names counts."""
    entries = F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>"))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(
        F.filter(entries, lambda e: F.lower(e["key"]) == n), -1)["value"]))


def merged(old: Column, new: Column) -> Column:
    """Headers of the response with the revisit's permitted ones in their place."""
    update = F.map_filter(new, lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(update), k)), update)


def as_of(records: DataFrame, key: list[str], order: list[str], value: Column) -> DataFrame:
    """``records`` plus ``found``: the last non-null ``value`` before the row, by ``order`` within ``key``.

    ``order`` must tell rows apart up to equal ones.
    """
    cols = records.columns
    d = records.withColumn("_value", value)
    d = materialise(d.repartitionByRange(*key, *order).withColumn("_part", F.spark_partition_id()), "as-of")
    inside = Window.partitionBy("_part", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    last = d.where("_value is not null").groupBy("_part", *key).agg(F.max_by("_value", F.struct(*order)).alias("_last"))
    spans = d.groupBy(*key, "_part").agg(F.count(F.lit(1)).alias("_n")).join(last, ["_part", *key], "left")
    earlier = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(*key, "_part", F.last("_last", ignorenulls=True).over(earlier).alias("_carried")).where("_carried is not null")
    out = d.withColumn("_inside", F.last("_value", ignorenulls=True).over(inside)).join(carried, ["_part", *key], "left")
    return out.select(*cols, F.coalesce("_inside", "_carried").alias("found"))


def resolve(records: DataFrame) -> DataFrame:
    """Every revisit of ``records`` with its verdict, response and merged headers.

    ``records``: record_id long, url, captured (seconds), kind ('response' or
    'revisit'), status int, truncated boolean, digest, headers map.
    """
    d = records.select("record_id", canonical_url(F.col("url")).alias("key"), "captured", "kind", "status",
                       F.coalesce("truncated", F.lit(False)).alias("truncated"), "digest", _lower(F.col("headers")).alias("headers"))
    full = (F.col("kind") == "response") & (F.col("status") == 200) & ~F.col("truncated")
    d = d.withColumn("full", F.coalesce(full, F.lit(False)))
    d = d.where(F.col("full") | (F.col("kind") == "revisit"))
    keyed = F.col("key").isNotNull() & F.col("captured").isNotNull()
    value = F.when(F.col("full"), F.struct("record_id", "captured", "digest", "headers"))
    # revisits sort before responses of their own time
    joined = as_of(d.where(keyed), ["key"], ["captured", "full", "record_id"], value)
    none = d.where(~keyed).withColumn("found", F.lit(None).cast(joined.schema["found"].dataType))
    v = joined.unionByName(none).where("not full")
    tag = lambda c: F.regexp_replace(c, "^W/", "")
    new, old = F.col("headers"), F.col("found.headers")
    same = F.when(new["etag"].isNotNull(), F.coalesce(tag(new["etag"]) == tag(old["etag"]), F.lit(False))) \
        .when(new["last-modified"].isNotNull(), F.coalesce(new["last-modified"] == old["last-modified"], F.lit(False)))
    verdict = F.when(F.col("found").isNull(), "no_response").when(same.isNull(), "no_validator") \
        .when(same, "resolved").otherwise("modified")
    v = v.withColumn("verdict", verdict)
    ok = F.col("verdict").isin("resolved", "no_validator")
    return v.select("record_id", "key", "captured", "verdict", F.col("found.record_id").alias("response_id"),
                    F.col("found.captured").alias("response_captured"), F.when(ok, F.col("found.digest")).alias("digest"),
                    F.when(ok, merged(old, new)).otherwise(new).alias("headers"))


def crawl(pages: DataFrame) -> DataFrame:
    """Capture records of the pages table: each page once in full and in three revisits.

    The revisits spell the URL another way; one precedes the page, one carries
    its entity tag, one another tag, a date or nothing.
    """
    at = F.col("page_id") * 7919 % 1_000_003 + 1_700_000_000
    etag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"'))
    modified, kind = F.concat(F.lit("day "), (F.col("page_id") % 5).cast("string")), F.col("page_id") % 3
    head = lambda **h: F.create_map(*[x for k, v in h.items() for x in (F.lit(k.replace("_", "-")), v)])
    rec = lambda n, url, t, what, status, headers: F.struct(
        (F.col("page_id") * 4 + n).alias("record_id"), url.alias("url"), t.alias("captured"), F.lit(what).alias("kind"),
        F.lit(status).alias("status"), F.lit(False).alias("truncated"),
        (F.md5("html") if what == "response" else F.lit(None).cast("string")).alias("digest"), headers.alias("headers"))
    text = lambda c: c.cast("string")
    full = head(Content_Type=F.lit("text/html"), Content_Length=text(F.octet_length("html")), ETag=etag,
                Last_Modified=modified, Date=text(at))
    weak = head(ETag=F.concat(F.lit("W/"), etag), Date=text(at + 3600), Content_Length=F.lit("0"), Expires=text(at + 9999))
    early = head(ETag=etag, Date=text(at - 1800))
    late = F.when(kind == 0, head(ETag=F.lit('"other"'), Date=text(at + 7200))) \
        .when(kind == 1, head(Last_Modified=modified, Date=text(at + 7200))).otherwise(head(Date=text(at + 7200)))
    loud = F.concat(F.upper(F.regexp_extract("url", "^([^:]*://[^/]*)", 1)), F.regexp_replace("url", "^[^:]*://[^/]*", ""), F.lit("#part"))
    marked = F.concat("url", F.when(F.col("url").contains("?"), "&utm_medium=x").otherwise("?utm_medium=x"))
    every = F.array(rec(0, F.col("url"), at, "response", 200, full), rec(1, loud, at + 3600, "revisit", 304, weak),
                    rec(2, F.col("url"), at - 1800, "revisit", 304, early), rec(3, marked, at + 7200, "revisit", 304, late))
    return pages.select(F.inline(every))


def op3_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve(crawl(read(spark, sf_dir, "pages")))
    flat = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))), "|")
    return out.select(F.expr("record_id div 4").alias("page_id"), *out.columns[:-1], flat.alias("headers"))


_URL_SQL = f"""
CASE WHEN regexp_matches(u, '{_PARTS}') THEN
  regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(u, '{_PARTS}', 1)), '^[^@]*@', ''), ':(80|443)$', ''), '^www[0-9]*\\.', '')
  || regexp_replace(regexp_replace(regexp_extract(u, '{_PARTS}', 2), '/index\\.(html?|php)$', '/'), '/+$', '')
  || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(ps, '&') ELSE '' END ELSE lower(u) END"""

ORACLE_SQL = {"op3_revisits": f"""
WITH p AS (SELECT page_id, url, md5(html) AS h, strlen(html) AS size, page_id * 7919 % 1000003 + 1700000000 AS t,
  '"' || substr(md5(html), 1, 16) || '"' AS tag, 'day ' || (page_id % 5) AS day FROM pages),
r AS (
  SELECT page_id * 4 AS record_id, url, t AS captured, true AS is_full, h AS digest, tag AS etag, day AS modified FROM p UNION ALL
  SELECT page_id * 4 + 1, upper(regexp_extract(url, '^([^:]*://[^/]*)', 1)) || regexp_replace(url, '^[^:]*://[^/]*', '') || '#part',
    t + 3600, false, NULL, tag, NULL FROM p UNION ALL
  SELECT page_id * 4 + 2, url, t - 1800, false, NULL, tag, NULL FROM p UNION ALL
  SELECT page_id * 4 + 3, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_medium=x', t + 7200, false, NULL,
    CASE WHEN page_id % 3 = 0 THEN '"other"' END, CASE WHEN page_id % 3 = 1 THEN day END FROM p),
c AS (SELECT *, regexp_replace(trim(url), '#.*$', '') AS u FROM r),
k AS (SELECT *, list_filter(list_sort(string_split(regexp_extract(u, '{_PARTS}', 3), '&')),
  lambda x: x <> '' AND NOT regexp_matches(x, '{TRACKING}')) AS ps FROM c),
n AS (SELECT *, {_URL_SQL.strip()} AS key FROM k),
f AS (SELECT key, captured, max(record_id) AS response_id, arg_max(digest, record_id) AS digest, arg_max(etag, record_id) AS etag,
  arg_max(modified, record_id) AS modified FROM n WHERE is_full GROUP BY key, captured),
j AS (SELECT v.record_id, v.key, v.captured, f.response_id, f.captured AS response_captured, f.digest, f.etag AS old_tag, f.modified AS old_day,
  v.etag, v.modified, CASE WHEN f.response_id IS NULL THEN 'no_response' WHEN v.etag IS NOT NULL THEN
    CASE WHEN v.etag = f.etag THEN 'resolved' ELSE 'modified' END
    WHEN v.modified IS NOT NULL THEN CASE WHEN v.modified = f.modified THEN 'resolved' ELSE 'modified' END ELSE 'no_validator' END AS verdict
  FROM (SELECT * FROM n WHERE NOT is_full) v ASOF LEFT JOIN f ON v.key = f.key AND v.captured > f.captured)
SELECT j.record_id // 4 AS page_id, j.record_id, j.key, j.captured, verdict, response_id, response_captured,
  CASE WHEN verdict IN ('resolved', 'no_validator') THEN j.digest END AS digest,
  array_to_string(list_sort(list_filter(CASE WHEN verdict IN ('resolved', 'no_validator') THEN
      ['content-type:text/html', 'content-length:' || q.size, 'date:' || j.captured,
       'etag:' || coalesce(CASE WHEN j.record_id % 4 = 1 THEN 'W/' ELSE '' END || j.etag, old_tag),
       'last-modified:' || coalesce(j.modified, old_day),
       CASE WHEN j.record_id % 4 = 1 THEN 'expires:' || (j.captured - 3600 + 9999) END]
    ELSE ['etag:' || CASE WHEN j.record_id % 4 = 1 THEN 'W/' ELSE '' END || j.etag, 'last-modified:' || j.modified, 'date:' || j.captured,
      CASE WHEN j.record_id % 4 = 1 THEN 'content-length:0' END, CASE WHEN j.record_id % 4 = 1 THEN 'expires:' || (j.captured - 3600 + 9999) END]
    END, lambda x: x IS NOT NULL)), '|') AS headers
FROM j LEFT JOIN p q ON q.page_id = j.response_id // 4"""}

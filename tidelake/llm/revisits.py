"""Not-modified revisits of an archive, resolved to the response they stand for.

A revisit (a capture answered with "not modified") belongs to the latest earlier full response of its canonical URL.
The as-of join is made of windows only: captures are cut into slices of time, so a URL that holds a large share of all
captures is spread over its slices; within a slice the last full response is carried along, and between slices only
each slice's last one is. All expressions are native.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers that a not-modified answer may replace in the stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that do not choose a page.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)"
SLICE_SECONDS = 6 * 3600


def canonical_url(url: Column) -> Column:
    """Host and path in one form: no scheme, user, www., default port, fragment, trailing slash or tracking
    parameters; host in lower case; parameters sorted. Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    params = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(params != "", F.concat(F.lit("?"), params)).otherwise(""))


def _opaque(etag: Column) -> Column:
    return F.regexp_replace(etag, r"^W/", "")


def resolve_revisits(records: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Resolve revisits among capture records.

    records: record_id long, kind ('response' or 'revisit'), url, ts long (seconds), etag, last_modified, digest and
    headers (map of lower-case names). Returns a row per revisit: record_id, url_key, ts, resolved_id, status, digest and
    headers. status is 'resolved', 'validator_mismatch' (the latest earlier response has another validator) or
    'no_response'. A revisit's validator is its entity tag, compared weakly, else its date of change, else its digest;
    without any it matches. resolved rows have the response's digest and headers with the permitted ones replaced;
    others keep their own. A response of the same second is not earlier; of responses of one second the larger
    record_id is later. A null URL or time resolves to nothing. Equal rows are resolved as often as they come; other
    columns are not read. An empty table gives no rows.
    """
    full = F.col("kind") == "response"
    kept = records.select("record_id", "kind", canonical_url(F.col("url")).alias("url_key"), "ts", "etag", "last_modified", "digest", "headers")
    usable = F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    rows = kept.where(usable).withColumn("slice", F.floor(F.col("ts") / slice_seconds)).withColumn("response", F.when(full, F.struct("record_id", "etag", "last_modified", "digest", "headers")))
    order = [F.col("ts"), full.cast("int"), F.col("record_id")]
    within = Window.partitionBy("url_key", "slice").orderBy(*order)
    carried = rows.withColumn("near", F.last("response", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # one row for each URL and slice
    latest = rows.where(full).groupBy("url_key", "slice").agg(F.max_by("response", F.struct("ts", "record_id")).alias("last"))
    asked = rows.where(F.col("kind") == "revisit").groupBy("url_key", "slice").agg(F.lit(None).cast(latest.schema["last"].dataType).alias("last"))
    steps = latest.unionByName(asked).groupBy("url_key", "slice").agg(F.first("last", ignorenulls=True).alias("last"))
    before = Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    earlier = steps.select("url_key", "slice", F.last("last", ignorenulls=True).over(before).alias("far"))
    revisits = carried.where(F.col("kind") == "revisit").join(earlier, ["url_key", "slice"], "left").withColumn("r", F.coalesce("near", "far"))
    none = kept.where(~usable & (F.col("kind") == "revisit")).withColumn("r", F.lit(None).cast(revisits.schema["r"].dataType))
    both = revisits.select(*none.columns).unionByName(none)
    r = F.col("r")
    same = F.when(F.col("etag").isNotNull(), F.coalesce(_opaque(F.col("etag")) == _opaque(r["etag"]), F.lit(False))).when(F.col("last_modified").isNotNull(), F.coalesce(F.col("last_modified") == r["last_modified"], F.lit(False))).when(F.col("digest").isNotNull(), F.coalesce(F.col("digest") == r["digest"], F.lit(False))).otherwise(True)
    status = F.when(r.isNull(), "no_response").when(same, "resolved").otherwise("validator_mismatch")
    own = F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>"))
    stored = F.coalesce(r["headers"], F.create_map().cast("map<string,string>"))
    new = F.map_filter(own, lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    merged = F.map_concat(F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)
    done = both.withColumn("status", status)
    ok = F.col("status") == "resolved"
    return done.select("record_id", "url_key", "ts", F.when(ok, r["record_id"]).alias("resolved_id"), "status", F.when(ok, r["digest"]).otherwise(F.col("digest")).alias("digest"), F.when(ok, merged).otherwise(own).alias("headers"))


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """Capture records of crawled pages: a response each, and revisits of some, at times and with validators that
    follow from the page's id."""
    p = F.col("page_id")
    ts = F.lit(1_700_000_000) + (p * 7919 % 100_000) * 60
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"'))
    day = F.concat(F.lit("day "), F.floor(ts / 86400).cast("string"))
    size = F.length("html").cast("string")
    text = lambda x: x.cast("string")
    response = pages.select((p * 3).alias("record_id"), F.lit("response").alias("kind"), "url", ts.alias("ts"), tag.alias("etag"), day.alias("last_modified"), F.md5("html").alias("digest"), F.create_map(F.lit("cache-control"), F.lit("max-age=60"), F.lit("content-length"), size, F.lit("content-type"), F.lit("text/html"), F.lit("etag"), tag, F.lit("server"), F.lit("s1")).alias("headers"))

    def revisit(step: int, when: Column, shift: int) -> DataFrame:
        at = ts + shift
        etag = F.when(p % 3 == 0, F.concat(F.lit("W/"), tag)).when(p % 3 == 2, F.lit('"stale"'))
        names = F.create_map(F.lit("cache-control"), F.concat(F.lit("max-age="), text(p % 7 * 100)), F.lit("content-length"), F.lit("0"), F.lit("content-type"), F.lit("x/y"), F.lit("date"), text(at), F.lit("etag"), etag)
        return pages.where(when).select((p * 3 + step).alias("record_id"), F.lit("revisit").alias("kind"), F.concat(F.col("url"), F.lit("#again")).alias("url"), at.alias("ts"), etag.alias("etag"), F.when(p % 3 == 1, day).alias("last_modified"), F.lit(None).cast("string").alias("digest"), F.map_filter(names, lambda _, v: v.isNotNull()).alias("headers"))

    return response.unionByName(revisit(1, p % 2 == 0, 3600)).unionByName(revisit(2, p % 5 == 0, -60))


def header_text(headers: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


ORACLE = r"""
WITH canon AS (
  SELECT page_id, url, html, 1700000000 + (page_id * 7919 % 100000) * 60 AS ts, '"' || substr(md5(html), 1, 16) || '"' AS tag,
    regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare
  FROM pages),
parts AS (
  SELECT *, 'day ' || CAST(floor(ts / 86400) AS BIGINT) AS day,
    regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^[^@]*@', ''), '^www\.', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)'))), '&') AS params
  FROM canon),
p AS (SELECT *, host || path || CASE WHEN params <> '' THEN '?' || params ELSE '' END AS url_key FROM parts),
asks AS (
  SELECT *, page_id * 3 + 1 AS record_id, ts + 3600 AS seen FROM p WHERE page_id % 2 = 0
  UNION ALL SELECT *, page_id * 3 + 2, ts - 60 FROM p WHERE page_id % 5 = 0),
checks AS (
  SELECT *, CASE WHEN page_id % 3 = 0 THEN 'W/' || tag WHEN page_id % 3 = 2 THEN '"stale"' END AS etag,
    CASE WHEN page_id % 3 = 1 THEN day END AS modified FROM asks),
found AS (
  SELECT c.record_id, arg_max({'id': r.page_id * 3, 'tag': r.tag, 'day': r.day, 'digest': md5(r.html), 'size': CAST(length(r.html) AS VARCHAR)}, {'t': r.ts, 'i': r.page_id}) AS r
  FROM checks c JOIN p r ON r.url_key = c.url_key AND r.ts < c.seen GROUP BY c.record_id),
done AS (
  SELECT c.*, f.r, CASE WHEN f.r IS NULL THEN 'no_response'
    WHEN CASE WHEN c.etag IS NOT NULL THEN regexp_replace(c.etag, '^W/', '') = f.r.tag WHEN c.modified IS NOT NULL THEN c.modified = f.r.day ELSE true END THEN 'resolved'
    ELSE 'validator_mismatch' END AS status
  FROM checks c LEFT JOIN found f ON f.record_id = c.record_id)
SELECT record_id, url_key, seen AS ts, CASE WHEN status = 'resolved' THEN r.id END AS resolved_id, status,
  CASE WHEN status = 'resolved' THEN r.digest END AS digest,
  'cache-control: max-age=' || CAST(page_id % 7 * 100 AS VARCHAR) || chr(10) || 'content-length: ' || CASE WHEN status = 'resolved' THEN r.size ELSE '0' END || chr(10) ||
  'content-type: ' || CASE WHEN status = 'resolved' THEN 'text/html' ELSE 'x/y' END || chr(10) || 'date: ' || CAST(seen AS VARCHAR) ||
  CASE WHEN coalesce(etag, CASE WHEN status = 'resolved' THEN r.tag END) IS NOT NULL THEN chr(10) || 'etag: ' || coalesce(etag, r.tag) ELSE '' END ||
  CASE WHEN status = 'resolved' THEN chr(10) || 'server: s1' ELSE '' END AS headers
FROM done
"""

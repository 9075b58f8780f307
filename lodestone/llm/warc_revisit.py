r"""WARC not-modified revisits: an as-of join by canonical URL to the latest earlier full response.

A revisit (status 304, no payload) takes its payload from the latest record before it (by time, then record id) that is a
response with status 200 and the same canonical URL. Validators are then checked: the ETag by weak comparison if the revisit has
one, else Last-Modified for equality, else the payload digest that the revisit names; a revisit without any is `unverified`. The
merged headers are the response's, with those that a 304 may update (`UPDATABLE`) taken from the revisit where it has them.

Captures of one URL may be a third of all rows, so the as-of join never holds a URL in one window: records are cut into time
buckets, the latest response inside the bucket is found there, and the one of earlier buckets is carried over a table that has
one pre-aggregated row for each URL and bucket. Payloads do not move; a result names the record that holds it.

`read_warc` reads records of uncompressed WARC files with Spark's text reader; `parsed` makes the records that `resolve` takes out of
raw ones.

Edge cases: null or empty URL resolves nothing (`no_url`); null time is `no_time`; no earlier response is `no_prior`; equal times
go by record id; a repeated response row counts once (the key is the record id; of equal ids any one, chosen by digest); revisits
that share a record id are each resolved by their own URL and time; null headers are empty; an empty table gives no rows; further
columns are not read. A join meets a hot response or the many revisits without one in more than one task: those without are dealt
out by a hash, and adaptive execution splits a hot key, as both sides of that join are dealt out for it alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common as C

#: Fields that a 304 response may update (fixed values; RFC 9110 section 15.4.5).
UPDATABLE = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that do not name content.
TRACKING = r"^(utm_[a-z]+|ref|gclid|fbclid|sessionid|phpsessid|jsessionid)(=|$)"
BUCKET_SECONDS = 3600


def canonical_url(url: Column) -> Column:
    """host (lower case, without user, default port and www), path without a closing slash, sorted parameters without tracking."""
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^[^@]*@", ""), ":(80|443)$", ""), r"^www[0-9]*\.", "")
    path = F.regexp_replace(F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), "/+$", "")
    parameters = F.array_sort(F.filter(F.split(F.regexp_extract(plain, r"\?(.*)$", 1), "&"), lambda x: (x != "") & ~F.lower(x).rlike(TRACKING)))
    query = F.array_join(parameters, "&")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^W/", "")


def resolve(records: DataFrame, *, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """records: record_id, kind (response, revisit), url, at (seconds), status, headers (map with lower-case names), digest, length.
    One row per revisit: record_id, url (canonical), at, response_id, outcome, digest, length, headers (map)."""
    none = F.create_map().cast("map<string,string>")
    rows = records.select("record_id", "kind", canonical_url(F.col("url")).alias("url"), F.col("at").cast("long").alias("at"), "status", F.coalesce("headers", none).alias("headers"), "digest", "length")
    rows = rows.withColumn("bucket", F.floor(F.col("at") / bucket_seconds))
    responses = rows.where("kind = 'response' AND status = 200 AND url IS NOT NULL AND at IS NOT NULL")
    revisits = rows.where("kind = 'revisit'")
    fit = revisits.where("url IS NOT NULL AND at IS NOT NULL")
    key = F.when(F.col("kind") == "response", F.struct("at", "record_id"))
    both = responses.select("url", "bucket", "at", "record_id", "kind").unionByName(fit.select("url", "bucket", "at", "record_id", "kind"))
    inside = both.withColumn("near", F.last(key, ignorenulls=True).over(Window.partitionBy("url", "bucket").orderBy("at", "record_id").rowsBetween(Window.unboundedPreceding, -1))).where("kind = 'revisit'")
    carried = both.groupBy("url", "bucket").agg(F.max(key).alias("top")).select(
        "url", "bucket", F.last("top", ignorenulls=True).over(Window.partitionBy("url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("far")
    )
    chosen = inside.join(carried, ["url", "bucket"], "left").select("url", "at", "record_id", F.coalesce("near.record_id", "far.record_id").alias("response_id")).distinct()
    stored = responses.groupBy(F.col("record_id").alias("response_id")).agg(F.max_by(F.struct("headers", "digest", "length"), F.coalesce("digest", F.lit(""))).alias("r"))
    own = chosen.select(F.col("url").alias("u"), F.col("at").alias("t"), F.col("record_id").alias("i"), "response_id")
    out = revisits.join(own, (F.col("url") == F.col("u")) & (F.col("at") == F.col("t")) & F.col("record_id").eqNullSafe(F.col("i")), "left").drop("u", "t", "i")
    # revisits without a response would all meet on the null key
    out = out.withColumn("spread", F.when(F.col("response_id").isNull(), F.pmod(F.xxhash64("record_id", "url"), F.lit(4096))).otherwise(F.lit(0).cast("long")))
    out = out.join(stored.withColumn("spread", F.lit(0).cast("long")), ["response_id", "spread"], "left")
    tag, date = F.col("headers")["etag"], F.col("headers")["last-modified"]
    outcome = (
        F.when(F.col("url").isNull(), "no_url").when(F.col("at").isNull(), "no_time").when(F.col("response_id").isNull(), "no_prior")
        .when(tag.isNotNull(), F.when(_weak(tag) == _weak(F.col("r.headers")["etag"]), "etag").otherwise("mismatch"))
        .when(date.isNotNull(), F.when(date == F.col("r.headers")["last-modified"], "last_modified").otherwise("mismatch"))
        .when(F.col("digest").isNotNull(), F.when(F.col("digest") == F.col("r.digest"), "digest").otherwise("mismatch"))
        .otherwise("unverified")
    )
    good = F.col("outcome").isin("etag", "last_modified", "digest", "unverified")
    update = F.map_filter("headers", lambda k, v: k.isin(*UPDATABLE) & v.isNotNull())
    kept = F.map_filter(F.col("r.headers"), lambda k, v: ~F.array_contains(F.map_keys(update), k))
    return out.withColumn("outcome", outcome).select(
        "record_id", "url", "at", F.when(good, F.col("response_id")).alias("response_id"), "outcome",
        F.when(good, F.col("r.digest")).alias("digest"), F.when(good, F.col("r.length")).alias("length"),
        F.when(good, F.map_concat(kept, update)).alias("headers"),
    )


_HEAD = r"(?s)^(.*?)\r?\n\r?\n"


def _fields(block: Column) -> Column:
    """Header lines `name: value` as a map with lower-case names; of equal names the first counts."""
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"^[^:\s]+:"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.regexp_extract(x, r"^([^:\s]+):", 1)).alias("key"), F.trim(F.regexp_extract(x, r"^[^:]+:(.*)$", 1)).alias("value")))
    names = F.transform(pairs, lambda x: x["key"])
    return F.map_from_entries(F.filter(pairs, lambda x, i: F.array_position(names, x["key"]) == i + 1))


def parsed(raw: DataFrame, column: str = "value") -> DataFrame:
    """Records for `resolve` from WARC records (text from `WARC/1.0` on, or after it, to the next record). record_id is a 64-bit hash of
    WARC-Record-ID, `at` WARC-Date in seconds; a revisit's digest is that of the payload it refers to, its headers those of its 304
    response. Other types of record (request, metadata, warcinfo) and fragments without a type are passed over."""
    text = F.regexp_replace(F.col(column).cast("string"), r"^WARC/[0-9.]+\r?\n", "")
    head = F.regexp_extract("text", _HEAD, 1)
    http = F.expr("substring(text, length(head) + 1)")
    one = raw.select(text.alias("text")).select("text", head.alias("head")).select(_fields(F.col("head")).alias("w"), F.regexp_replace(http, r"^(\r?\n)+", "").alias("http"))
    two = one.where(F.col("w")["warc-type"].isin("response", "revisit")).select("w", F.regexp_extract(F.concat("http", F.lit("\r\n\r\n")), _HEAD, 1).alias("block"))
    return two.select(
        F.xxhash64(F.col("w")["warc-record-id"]).alias("record_id"), F.col("w")["warc-type"].alias("kind"), F.regexp_replace(F.col("w")["warc-target-uri"], "^<|>$", "").alias("url"),
        F.unix_seconds(F.try_to_timestamp(F.col("w")["warc-date"])).alias("at"), F.regexp_extract("block", r"^HTTP/[0-9.]+ +([0-9]{3})", 1).try_cast("int").alias("status"),
        _fields(F.col("block")).alias("headers"), F.col("w")["warc-payload-digest"].alias("digest"), F.col("w")["content-length"].try_cast("long").alias("length"),
    )


def read_warc(spark, path: str) -> DataFrame:
    """`parsed` records of the uncompressed WARC files at path. Spark's text reader cuts them at `WARC/1.0` line ends, in parallel inside a
    file; a payload that holds that very line is cut there too, and its rest, which has no WARC-Type, is passed over."""
    return parsed(spark.read.option("lineSep", "WARC/1.0\r\n").text(path))


def captures(pages: DataFrame) -> DataFrame:
    """Records of a two-visit crawl of `pages`: a full response at 60 * page_id seconds, and a day and a second later a revisit under a
    link with tracking. Its validators go by a hash of the URL: a strong or weak ETag, Last-Modified, a stale ETag, the digest."""
    html = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select("page_id", "url", (F.col("page_id") * 60).alias("at"), F.md5(html.cast("binary")).alias("digest"), F.octet_length(html).cast("long").alias("length"), F.pmod(F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(F.col("url").cast("binary")), 1, 1)) - 1, F.lit(4)).alias("way"))
    stamp = F.date_format(F.timestamp_seconds("at"), "yyyy-MM-dd HH:mm:ss")
    tag = F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"'))
    first = base.select(
        (F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("kind"), "url", "at", F.lit(200).alias("status"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.col("length").cast("string"), F.lit("cache-control"), F.lit("max-age=600"), F.lit("etag"), tag, F.lit("last-modified"), stamp, F.lit("date"), stamp).alias("headers"),
        "digest", "length",
    )
    later = F.col("at") + 86_401
    shown = F.when(F.col("way") == 0, F.concat(F.lit("W/"), tag)).when(F.col("way") == 2, F.lit('"stale"'))
    headers = F.create_map(F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=60"), F.lit("date"), F.date_format(F.timestamp_seconds(later), "yyyy-MM-dd HH:mm:ss"), F.lit("etag"), shown, F.lit("last-modified"), F.when(F.col("way") == 1, stamp))
    link = F.concat(F.regexp_replace("url", "#.*$", ""), F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("utm_medium=revisit"))
    second = base.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), link.alias("url"), later.alias("at"), F.lit(304).alias("status"),
        F.map_filter(headers, lambda k, v: v.isNotNull()).alias("headers"), F.when(F.col("way") == 3, F.col("digest")).alias("digest"), F.lit(0).cast("long").alias("length"),
    )
    return first.unionByName(second)


def query(spark, sf_dir: str) -> DataFrame:
    out = resolve(captures(C.table(spark, sf_dir, "pages")))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), "\n")
    return out.withColumn("headers", text).withColumn("response_id", F.coalesce("response_id", F.lit(-1).cast("long"))).withColumn("length", F.coalesce("length", F.lit(0).cast("long")))


def _sql_url(u: str) -> str:
    plain = f"regexp_replace(trim({u}), '#.*$', '')"
    host = rf"lower(regexp_extract({plain}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1))"
    host = rf"regexp_replace(regexp_replace(regexp_replace({host}, '^[^@]*@', ''), ':(80|443)$', ''), '^www[0-9]*\.', '')"
    path = rf"regexp_replace(regexp_extract({plain}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '')"
    query = rf"array_to_string(list_sort(list_filter(string_split(regexp_extract({plain}, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '{TRACKING}'))), '&')"
    return f"({host}) || ({path}) || CASE WHEN coalesce({query}, '') <> '' THEN '?' || {query} ELSE '' END"



_STAMP = "strftime(make_timestamp(cast({} AS bigint) * 1000000), '%Y-%m-%d %H:%M:%S')"
SQL = rf"""
WITH p AS (SELECT page_id, url, page_id * 60 AS sec, md5(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS length,
  (instr('0123456789abcdef', substring(md5(url), 1, 1)) - 1) % 4 AS way,
  regexp_replace(url, '#.*$', '') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_medium=revisit' AS link FROM pages),
s AS (SELECT 2 * page_id AS record_id, {_sql_url("url")} AS url, sec, digest, length, '"' || substring(digest, 1, 16) || '"' AS etag, {_STAMP.format("sec")} AS modified FROM p),
v AS (SELECT 2 * page_id + 1 AS record_id, {_sql_url("link")} AS url, sec + 86401 AS sec, {_STAMP.format("sec + 86401")} AS date,
  CASE way WHEN 0 THEN 'W/"' || substring(digest, 1, 16) || '"' WHEN 2 THEN '"stale"' END AS etag,
  CASE way WHEN 1 THEN {_STAMP.format("sec")} END AS modified, CASE way WHEN 3 THEN digest END AS digest FROM p),
j AS (SELECT v.record_id, v.url, v.sec, v.date, v.etag, v.modified, v.digest, arg_max(s, (s.sec, s.record_id)) AS r
  FROM v LEFT JOIN s ON s.url = v.url AND (s.sec < v.sec OR (s.sec = v.sec AND s.record_id < v.record_id)) GROUP BY ALL),
o AS (SELECT *, CASE WHEN r IS NULL THEN 'no_prior'
  WHEN etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = r.etag THEN 'etag' ELSE 'mismatch' END
  WHEN modified IS NOT NULL THEN CASE WHEN modified = r.modified THEN 'last_modified' ELSE 'mismatch' END
  WHEN digest IS NOT NULL THEN CASE WHEN digest = r.digest THEN 'digest' ELSE 'mismatch' END ELSE 'unverified' END AS outcome FROM j)
SELECT cast(record_id AS bigint) AS record_id, url, cast(sec AS bigint) AS "at",
  CASE WHEN outcome NOT IN ('no_prior', 'mismatch') THEN cast(r.record_id AS bigint) ELSE -1 END AS response_id, outcome,
  CASE WHEN outcome NOT IN ('no_prior', 'mismatch') THEN r.digest END AS digest,
  CASE WHEN outcome NOT IN ('no_prior', 'mismatch') THEN cast(r.length AS bigint) ELSE 0 END AS length,
  CASE WHEN outcome NOT IN ('no_prior', 'mismatch') THEN 'cache-control=max-age=60' || chr(10) || 'content-length=' || r.length || chr(10) || 'content-type=text/html' || chr(10)
    || 'date=' || date || chr(10) || 'etag=' || coalesce(etag, r.etag) || chr(10) || 'last-modified=' || r.modified END AS headers
FROM o
"""
